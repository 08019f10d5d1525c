"""What a delivery status means. A null status is a transport failure."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Statuses that accept a snapshot, and those that reject its content
# for good.
SNAPSHOT_ACCEPTED = (200, 201)
SNAPSHOT_TERMINAL = (400, 401, 403, 404, 409, 413, 415, 422)


def snapshot_outcome(status: Column) -> Column:
    return (
        F.when(status.isin(*SNAPSHOT_ACCEPTED), "sent")
        .when(status.isin(*SNAPSHOT_TERMINAL), "rejected")
        .otherwise("failed")
    )


def batch_outcome(status: Column) -> Column:
    """Only 2xx advances; everything else holds, as skipping would lose data."""
    return F.when((status >= 200) & (status < 300), "advance").otherwise("hold")

"""Spark jobs over the telemetry that fleets of coding agents leave behind.

Three planes, each a chain of DataFrame operators:

* usage  - JSON-lines ledgers of model usage, numbered and batched per source
* events - captured server-sent event streams, reduced to redacted envelopes
* recall - transcript files, diffed against a state table into snapshots
"""

from planes.session import build_session

__all__ = ["build_session"]

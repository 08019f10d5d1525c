"""Shards by fixed virtual slots.

Records are hashed into a fixed number of slots that never changes. Bytes and rows are added
up per slot, and a small versioned table says which shard holds each slot. Placing or moving
records means editing that table: slots are dealt to shards by their bytes, and a new shard
takes over whole slots and leaves all others where they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from planes.llm.common import shared_folder, stage

SLOTS = 16384
# Slots that are dealt before what is dealt is put together.
RUN = 128


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes and one more), text_crc32, vslot, copies. Null text has no bytes.

    A row stands for ``copies`` records that are alike. These are dealt evenly to slots of their
    own, so that a record of any number of copies fills no slot alone.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    alike = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    parts = F.least("n", F.lit(slots))
    dealt = alike.select("doc_id", "size", "text_crc32", "n", parts.alias("parts"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return dealt.select(
        "doc_id", "size", "text_crc32",
        F.pmod(F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)) + F.col("part"), F.lit(slots)).cast("int").alias("vslot"),
        (F.floor(F.col("n") / F.col("parts")) + F.when(F.col("part") < F.col("n") % F.col("parts"), 1).otherwise(0)).cast("long").alias("copies"),
    )


def slot_sizes(rows: DataFrame) -> DataFrame:
    """vslot, bytes, rows; at most one row per slot."""
    return rows.groupBy("vslot").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.sum("copies").alias("rows"))


def slot_map(sizes: DataFrame, shards: int, version: int = 1) -> DataFrame:
    """version, vslot, shard, bytes, rows: slots dealt out one at a time, largest first, each
    to the shard that has least bytes so far, the lowest such.

    Works on one row that holds the slots, whose number is fixed.
    """
    one = sizes.agg(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "vslot", "rows")).alias("s")).select(
        F.transform(F.array_sort("s"), lambda x: F.struct((-x.less).alias("bytes"), x.vslot.alias("vslot"), x.rows.alias("rows"))).alias("s")
    )
    # Slots come in runs, so that what is dealt is copied once per run and not once per slot.
    runs = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("s") - 1) / RUN).cast("int"))),
        lambda i: F.slice("s", i * RUN + 1, RUN),
    )
    none = F.expr("cast(array() as array<struct<vslot:int,shard:int,bytes:bigint,rows:bigint>>)")
    loads = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda k: F.struct(F.lit(0).cast("long").alias("load"), k.alias("shard")))

    def deal(acc: Column, slot: Column) -> Column:
        least = F.array_min(acc.loads).shard
        return F.struct(
            F.transform(acc.loads, lambda x: F.struct((x.load + F.when(x.shard == least, slot.bytes).otherwise(F.lit(0))).alias("load"), x.shard.alias("shard"))).alias("loads"),
            F.concat(acc.dealt, F.array(F.struct(slot.vslot.alias("vslot"), least.alias("shard"), slot.bytes.alias("bytes"), slot.rows.alias("rows")))).alias("dealt"),
        )

    def deal_run(acc: Column, run: Column) -> Column:
        return F.aggregate(
            run, F.struct(acc.loads.alias("loads"), none.alias("dealt")), deal,
            lambda new: F.struct(new.loads.alias("loads"), F.concat(acc.dealt, new.dealt).alias("dealt")),
        )

    one = one.select(runs.alias("r")).select(
        F.explode(F.aggregate("r", F.struct(loads.alias("loads"), none.alias("dealt")), deal_run, lambda acc: acc.dealt)).alias("d")
    )
    return one.select(F.lit(version).alias("version"), "d.vslot", "d.shard", "d.bytes", "d.rows")


def grow(slots: DataFrame, shards: int) -> DataFrame:
    """The next version, with shard number ``shards`` added: it takes slots from every
    other, smallest first, until it holds its part; all other slots stay where they are."""
    share = W.partitionBy("shard").orderBy("bytes", "vslot").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("shard")
    return slots.withColumns({"__run": F.sum("bytes").over(share), "__all": F.sum("bytes").over(whole)}).select(
        (F.col("version") + 1).alias("version"),
        "vslot",
        F.when(F.col("__run") * (shards + 1) <= F.col("__all"), F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"),
        "bytes",
        "rows",
    )


def store_map(slots: DataFrame, path: str) -> None:
    """Adds a version to the table of maps at ``path``; a version stored before stays as it is."""
    slots.write.partitionBy("version").mode("append").parquet(path)


def has_map(spark, path: str) -> bool:
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(done)


def load_map(spark, path: str, version: int | None = None) -> DataFrame:
    """The stored map of a version, by default of the newest."""
    maps = spark.read.schema("vslot int, shard int, bytes long, rows long, version int").parquet(path)
    if version is None:
        return maps.join(F.broadcast(maps.agg(F.max("version").alias("version"))), "version")
    return maps.where(F.col("version") == version)


def place(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """``rows`` with shard and slot, the place inside the shard, counted from 0 without gaps.

    A shard's places are those of its virtual slots one after another, so counting sorts
    one virtual slot at a time and never a shard. ``slots`` has at most one row per virtual
    slot, a fixed number, and is broadcast.
    """
    before = W.partitionBy("shard").orderBy("vslot").rowsBetween(W.unboundedPreceding, -1)
    based = slots.select("vslot", "shard", "version", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size").rowsBetween(W.unboundedPreceding, 0)
    return (
        rows.withColumn("__n", F.sum("copies").over(inside) - F.col("copies"))
        .join(F.broadcast(based), "vslot")
        .withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        .withColumn("slot", (F.col("base") + F.col("__n") + F.col("__copy")).cast("long"))
        .drop("base", "__n", "__copy", "copies")
    )


def shard(
    docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, version: int | None = None
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, version.

    The map at ``path`` says which shard holds each virtual slot: its ``version``, by default the
    newest; without a path it is a new one in the shared folder. Where there is none yet, one is
    made for these documents and stored, by which sizes of shards are near equal (law ``bytes``). Null and empty texts have size 1; null ids are
    hashed like any other value; repeated rows each take a place; an empty table gives no
    rows. Documents in slots that the map does not have, as they were empty when it was made,
    go to the shard of the slot before. Other columns are not read.
    """
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/planes-llm/shard-map-{uuid.uuid4().hex}"
    rows = stage(records(docs, id_col, text_col), "shard-records")
    if not has_map(spark, path):
        store_map(slot_map(slot_sizes(rows), shards), path)
    slots = load_map(spark, path, version)
    placed = place(rows, counted(slots, rows))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "vslot", "version",
    )


def counted(slots: DataFrame, rows: DataFrame) -> DataFrame:
    """The map with bytes and rows of ``rows`` in place of those it was made from, and with all
    slots that these use. Its size is that of the map, whatever the rows."""
    now = slot_sizes(rows).join(slots.select("vslot", "version", "shard"), "vslot", "full").where("rows is not null or shard is not null")
    up = W.orderBy("vslot").rowsBetween(W.unboundedPreceding, 0)
    down = W.orderBy(F.desc("vslot")).rowsBetween(W.unboundedPreceding, 0)
    filled = lambda c: F.coalesce(F.last(c, True).over(up), F.last(c, True).over(down)).alias(c)
    return now.select("vslot", filled("version"), filled("shard"), F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("rows", F.lit(0)).alias("rows"))

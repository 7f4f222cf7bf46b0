"""Sharding by fixed virtual slots.

Records hash into a fixed number of virtual slots; bytes are aggregated per slot, and a small versioned table maps
slots to shards. Rebalancing edits that table, never the hash, so only the records of moved slots change shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Fixed number of virtual slots: it bounds the map, which is what is broadcast and folded.
SLOTS = 4096


def with_sizes(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 16; null text: 16), text_crc32 (null text: 0) and vslot.

    The virtual slot depends on doc_id alone; rows with a null doc_id share one slot. Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(slots)).cast("int").alias("vslot"),
    )


def slot_sizes(sized: DataFrame) -> DataFrame:
    """Bytes and rows of each virtual slot in use: at most SLOTS rows."""
    return sized.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows"))


def _folded(sizes: DataFrame, n_shards: int, start: str, target: str) -> DataFrame:
    """Fold over the slots, largest first. `start` is the list of loads to begin with, `target` picks the shard (from 1)
    of slot x given acc.loads. The list has at most SLOTS entries, so one task holds it."""
    listed = sizes.agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("neg"), "vslot", "bytes", "n_rows", "shard"))).alias("slots"))
    fold = f"""
        aggregate(slots,
          named_struct('loads', {start}, 'map', cast(array() as array<struct<vslot:int,shard:int,bytes:bigint,n_rows:bigint>>)),
          (acc, x) -> element_at(transform(array({target}), p -> named_struct(
            'loads', transform(acc.loads, (v, i) -> v + if(i = p - 1, x.bytes, 0L) - if(i = x.shard, x.bytes, 0L)),
            'map', concat(acc.map, array(named_struct('vslot', x.vslot, 'shard', cast(p - 1 as int), 'bytes', x.bytes, 'n_rows', x.n_rows))))), 1),
          acc -> acc.map)"""
    return listed.select(F.explode(F.expr(fold)).alias("m")).select("m.*")


def plan_map(sizes: DataFrame, n_shards: int) -> DataFrame:
    """A first map: each slot, largest first, goes to the shard with the fewest bytes (the lowest of equals)."""
    least = "array_position(acc.loads, array_min(acc.loads))"
    return _folded(sizes.withColumn("shard", F.lit(-1)), n_shards, f"array_repeat(0L, {n_shards})", least)


def rebalance(sizes: DataFrame, current: DataFrame, n_shards: int) -> DataFrame:
    """Edit a map for new slot sizes or more shards: a slot moves to the emptiest shard only while its own shard stays
    at or over the mean without it. Slots unknown to the map count as new and go to the emptiest shard."""
    held = sizes.join(F.broadcast(current.select("vslot", "shard")), "vslot", "left").withColumn("shard", F.coalesce("shard", F.lit(-1)))
    loads = held.agg(
        F.sum("bytes").alias("total"),
        F.array(*[F.coalesce(F.sum(F.when(F.col("shard") == i, F.col("bytes"))), F.lit(0).cast("long")) for i in range(n_shards)]).alias("loads"),
    ).first()
    start = "array(" + ", ".join(f"{v}L" for v in loads["loads"]) + ")"
    mean = -(-(loads["total"] or 0) // n_shards)
    least = "array_position(acc.loads, array_min(acc.loads))"
    target = f"if(x.shard >= 0 and element_at(acc.loads, if(x.shard < 0, 1, x.shard + 1)) - x.bytes < {mean}L, cast(x.shard + 1 as bigint), {least})"
    return _folded(held, n_shards, start, target)


def save_map(slot_map: DataFrame, path: str, version: int) -> DataFrame:
    """Store one version of the map beside the earlier ones, and return it as stored."""
    slot_map.coalesce(1).write.parquet(f"{path}/version={version}")
    return load_map(slot_map.sparkSession, path, version)


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("vslot int, shard int, bytes long, n_rows long").parquet(f"{path}/version={version}")


def place(sized: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Add shard and position, a gapless number from 0 inside each shard.

    Positions come from two levels: the rows of the shard's earlier virtual slots (from the map), then the rank inside
    the record's own virtual slot; so no window holds more than one virtual slot. Rows equal in all of (doc_id, size,
    crc) are interchangeable.
    """
    before = W.partitionBy("shard").orderBy("vslot").rowsBetween(W.unboundedPreceding, -1)
    bases = slot_map.select("vslot", "shard", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("vslot").orderBy("doc_id", "size", "text_crc32")
    ranked = sized.withColumn("nth", F.row_number().over(inside).cast("long") - 1)
    # the map has at most SLOTS rows of 24 bytes
    return ranked.join(F.broadcast(bases), "vslot").withColumn("position", F.col("base") + F.col("nth")).drop("base", "nth")

"""Sharding over fixed virtual slots.

Every record hashes to one of SLOTS virtual slots by its doc_id.  Bytes are
summed by slot, and a versioned slot-to-shard map says which shard holds a
slot.  Version 1 deals the slots evenly.  Each run reads the latest version,
edits it where shards have become too large, moving as few slots as balance
needs, and stores the result as the next version; records are placed by the
map as it is read back, so records of slots that stay are never moved.

A slot that holds more than its share (one doc_id on very many rows) is split
in sub-slots by a hash of the record.  The number of sub-slots is part of the
map, only ever doubles, and a sub-slot's halves stay where it was until they
are moved.  Rows are numbered inside their shard from per-chunk counts, so no
shard or key is sorted in one task.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialise, new_path
from ..sources import files

SHARDS, SLOTS = 24, 4096
#: A sub-slot with more than this share of a shard's fair size is split; a shard may be so much over its fair size.
HEAVY, SLACK = 0.1, 0.005
MAP_SCHEMA = "slot int, sub int, parts int, bytes long, shard int"


def rebalance(old: dict[tuple[int, int], int], slots: list[tuple[int, int, int]], shards: int, slack: float = SLACK) -> dict[tuple[int, int], int]:
    """The map (slot, sub) -> shard edited for the sizes in ``slots`` (slot, sub, bytes).

    Shards over (1 + slack) of the fair size give slots away, the largest that
    are no more than the excess first; those, slots of shards that no longer
    exist and new slots go to the lightest shards, the heaviest first.
    """
    load = [0] * shards
    mine: dict[int, list[tuple[int, int, int]]] = {s: [] for s in range(shards)}
    loose = []
    for slot, sub, size in slots:
        shard = old.get((slot, sub))
        if shard is None or shard >= shards:
            loose.append((slot, sub, size))
        else:
            load[shard] += size
            mine[shard].append((slot, sub, size))
    fair = sum(x[2] for x in slots) / shards
    for shard, own in mine.items():
        if load[shard] <= (1 + slack) * fair:
            continue
        for x in sorted(own, key=lambda x: (-x[2], x[0], x[1])):
            if 0 < x[2] <= load[shard] - fair:
                load[shard] -= x[2]
                own.remove(x)
                loose.append(x)
        least = min((x for x in own if x[2]), key=lambda x: (x[2], x[0], x[1]), default=None)
        if len(own) > 1 and least and load[shard] > (1 + slack) * fair:
            load[shard] -= least[2]
            own.remove(least)
            loose.append(least)
    out = {(slot, sub): shard for shard, own in mine.items() for slot, sub, _ in own}
    heap = [(size, shard) for shard, size in enumerate(load)]
    heapq.heapify(heap)
    for slot, sub, size in sorted(loose, key=lambda x: (-x[2], x[0], x[1])):
        held, shard = heapq.heappop(heap)
        out[slot, sub] = shard
        heapq.heappush(heap, (held + size, shard))
    return out


def write_map(spark: SparkSession, rows: list[tuple[int, int, int, int, int]], path: str, version: int) -> None:
    """Write one version of the map (at most SLOTS rows and the sub-slots of split ones) to ``path``; an existing version is never overwritten."""
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).parquet(f"{path}/version={version}")


def latest(spark: SparkSession, path: str) -> int:
    """The latest version of the map in ``path``; 0 if there is none."""
    version = 0
    while files.exists(spark, f"{path}/version={version + 1}/_SUCCESS"):
        version += 1
    return version


def _records(documents: DataFrame) -> DataFrame:
    """doc_id, row, size, text_crc32 and the virtual slot of every row, frozen by a write."""
    bytes_ = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    records = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(bytes_) + 8).cast("long").alias("size"), F.crc32(bytes_).alias("text_crc32"))
    # null ids spread by their texts
    slot = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.col("text_crc32"))), F.lit(SLOTS)).cast("int")
    return materialise(records.select("*", slot.alias("virtual_slot"), F.monotonically_increasing_id().alias("row")), "records")


def _divided(records: DataFrame, parts: dict[int, int]) -> DataFrame:
    """``records`` with ``sub``: 0, or the sub-slot of a slot that ``parts`` splits (in a power of two).

    The sub-slot follows from the record and, among equal records, from its
    number; equal records are interchangeable, so any order numbers them.
    """
    if not parts:
        return records.withColumn("sub", F.lit(0))
    # a split slot has more than HEAVY / 4 of a shard, so there are few
    table = F.broadcast(records.sparkSession.createDataFrame(sorted(parts.items()), "virtual_slot int, parts int"))
    some = materialise(records.join(table, "virtual_slot").withColumn("chunk", F.shiftright("row", 33)), "split")
    key = ["doc_id", "text_crc32", "size"]
    counts = some.groupBy(*key, "chunk").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("before", before).where("before > 0").select(F.col("doc_id").alias("_id"), F.col("text_crc32").alias("_crc"), F.col("size").alias("_size"), "chunk", "before")
    inside = some.withColumn("inside", F.row_number().over(Window.partitionBy(*key, "chunk").orderBy("row")) - 1)
    on = inside["doc_id"].eqNullSafe(counts["_id"]) & (inside["text_crc32"] == counts["_crc"]) & (inside["size"] == counts["_size"]) & (inside["chunk"] == counts["chunk"])
    copy = F.coalesce("before", F.lit(0)) + F.col("inside")
    out = inside.join(counts, on, "left").withColumn("sub", F.pmod(F.xxhash64("text_crc32", "doc_id", copy.cast("long")), F.col("parts")).cast("int"))
    rest = records.join(table, "virtual_slot", "left_anti").withColumn("sub", F.lit(0))
    return rest.unionByName(out.select(rest.columns))


def shard(documents: DataFrame, map_path: str, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, row, virtual_slot, sub, shard and slot (place in the shard, from 0) for every row.

    The map in ``map_path`` is created if there is none, edited for these
    records and stored as its next version.  A null text has no bytes and size
    8; null ids and repeated rows are dealt like others.  An empty table gives
    an empty result.
    """
    spark = documents.sparkSession
    version = latest(spark, map_path)
    if not version:
        version = 1
        write_map(spark, [(slot, 0, 1, 0, slot % shards) for slot in range(SLOTS)], map_path, version)
    old = read_map(spark, map_path, version).collect()  # at most SLOTS rows and the sub-slots of split ones
    held = {(r["slot"], r["sub"]): r["shard"] for r in old}
    parts = {r["slot"]: r["parts"] for r in old}
    records = _records(documents)
    sums = {r["virtual_slot"]: r["bytes"] for r in records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes")).collect()}  # at most SLOTS rows
    most = HEAVY * sum(sums.values()) / shards
    for slot, size in sums.items():
        while size > most * parts[slot]:
            held |= {(slot, sub + parts[slot]): held[slot, sub] for sub in range(parts[slot])}
            parts[slot] *= 2
    records = _divided(records, {slot: n for slot, n in parts.items() if n > 1})
    sizes = {(r["virtual_slot"], r["sub"]): r["bytes"] for r in records.groupBy("virtual_slot", "sub").agg(F.sum("size").alias("bytes")).collect()}  # as many as the map has
    slots = [(slot, sub, sizes.get((slot, sub), 0)) for slot, sub in sorted(held)]
    dealt = rebalance(held, slots, shards)
    write_map(spark, [(slot, sub, parts[slot], size, dealt[slot, sub]) for slot, sub, size in slots], map_path, version + 1)
    table = F.broadcast(read_map(spark, map_path, version + 1).select(F.col("slot").alias("virtual_slot"), "sub", "shard"))
    placed = records.join(table, ["virtual_slot", "sub"]).withColumn("chunk", F.shiftright("row", 33))
    # places: rows of earlier chunks of the same shard, then the place among the chunk's own
    counts = placed.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("shard", "chunk", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("row")) - 1
    numbered = placed.withColumn("inside", inside).join(counts, ["shard", "chunk"])
    return numbered.select("doc_id", "size", "text_crc32", "row", "virtual_slot", "sub", "shard", (F.col("before") + F.col("inside")).cast("long").alias("slot"))


def digest(documents: DataFrame, shards: int = SHARDS, map_path: str | None = None) -> DataFrame:
    """The law `bytes`: doc_id, size, text_crc32, law, shard, slot, virtual_slot and a null grown_shard.

    Without ``map_path`` the map is a new one in the shared folder.
    """
    out = shard(documents, map_path or new_path(documents.sparkSession, "shard-map"), shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def law(placed: DataFrame) -> DataFrame:
    """One row about a digest: n_rows, n_bytes, n_shards, whether places have no gap and whether sizes are near equal.

    Near equal is within 2 % of the fair size or, for few and large records, within the largest record.
    """
    by_shard = placed.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max("slot").alias("last"), F.count_distinct("slot").alias("places"), F.max("size").alias("most"))
    spread = F.max("bytes") - F.min("bytes") <= F.greatest(F.max("most"), F.sum("bytes") / F.count("*") / 50)
    return by_shard.agg(F.sum("n").alias("n_rows"), F.sum("bytes").alias("n_bytes"), F.count("*").alias("n_shards"), F.bool_and(F.expr("last + 1 = n and places = n")).alias("gapless"), spread.alias("near_equal"))

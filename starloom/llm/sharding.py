"""Sharding by fixed virtual slots [native].

Records are hashed into thousands of slots that never change. Bytes are
summed per slot, and a versioned map says which shard holds each slot.
Rebalancing edits the map only, and moves whole slots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.common import Scratch, numbered, table

MAP_SCHEMA = "version int, virtual_slot int, shard int"


def with_slots(docs: DataFrame, key: str = "doc_id", slots: int = 8192, also: str | None = None) -> DataFrame:
    """docs plus virtual_slot: the hash of the key's text, and of another column's value if one is given. A null key has a slot of its own value, as any other key."""
    of = [F.coalesce(F.col(key).cast("string"), F.lit("\0")), *([F.col(also)] if also else [])]
    return docs.withColumn("virtual_slot", F.pmod(F.xxhash64(*of), F.lit(slots)).cast("int"))


def slot_bytes(slotted: DataFrame, size: str = "size") -> dict[int, int]:
    """Bytes of each slot in use; at most as many entries as there are slots."""
    return {r[0]: int(r[1]) for r in slotted.groupBy("virtual_slot").agg(F.sum(size)).collect()}


def assign(sizes: dict[int, int], shards: int, slots: int = 8192) -> list[int]:
    """First version of the map: largest slot first, each to the shard with the fewest bytes; ties to the lower number."""
    load, out = [0] * shards, [0] * slots
    for slot in sorted(range(slots), key=lambda s: (-sizes.get(s, 0), s)):
        to = min(range(shards), key=lambda x: (load[x], x))
        out[slot] = to
        load[to] += sizes.get(slot, 0)
    return out


def rebalance(owner: list[int], sizes: dict[int, int], shards: int, tolerance: float = 0.01) -> list[int]:
    """An edited map for ``shards`` shards: slots leave a shard only while it holds more than the mean plus the tolerance, or no longer exists.

    Slots of shards that stay within the tolerance don't move.
    """
    load = [0] * max(shards, max(owner, default=0) + 1)
    for s, o in enumerate(owner):
        load[o] += sizes.get(s, 0)
    goal = sum(load) / shards
    moving = []
    for s in sorted(range(len(owner)), key=lambda s: (-sizes.get(s, 0), s)):
        o = owner[s]
        if o >= shards or load[o] > goal * (1 + tolerance) and load[o] - goal > sizes.get(s, 0) / 2:
            moving.append(s)
            load[o] -= sizes.get(s, 0)
    new = list(owner)
    for s in moving:
        to = min(range(shards), key=lambda x: (load[x], x))
        new[s] = to
        load[to] += sizes.get(s, 0)
    return new


def map_table(spark: SparkSession, owner: list[int], version: int = 1) -> DataFrame:
    """The map as a table (version, virtual_slot, shard): one row per slot, so its size is fixed."""
    values = ",".join(map(str, owner))
    return spark.sql(f"SELECT {int(version)} AS version, CAST(pos AS INT) AS virtual_slot, CAST(col AS INT) AS shard FROM (SELECT posexplode(array({values})))")


def next_map(spark: SparkSession, path: str, sizes: dict[int, int], shards: int, slots: int = 8192) -> DataFrame:
    """The map to use now, out of the table of all versions at ``path``: a new table gets version 1; else the last version is rebalanced, and stored as the next one if a slot moves."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    old, version = None, 0
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        t = spark.read.schema(MAP_SCHEMA).parquet(path)
        version = t.agg(F.max("version")).first()[0] or 0
        old = [r.shard for r in t.where(F.col("version") == version).orderBy("virtual_slot").collect()] or None  # one row per slot
    if old and len(old) != slots:
        raise ValueError(f"the map at {path} has {len(old)} slots, not {slots}")
    new = rebalance(old, sizes, shards) if old else assign(sizes, shards, slots)
    if new != old:
        version += 1
        map_table(spark, new, version).coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(MAP_SCHEMA).parquet(path).where(F.col("version") == version)


def shard_documents(docs: DataFrame, shards: int = 24, slots: int = 8192, key: str = "doc_id", text: str = "text", maps: str | None = None) -> DataFrame:
    """Rows of docs with size, text_crc32, virtual_slot, map_version, shard and slot (the row's place in its shard, from 0).

    Law ``bytes``: shards get nearly equal sums of size = UTF-8 bytes + 8, as
    near as whole slots allow. A null text has 0 bytes and the CRC of an
    empty text; repeated rows are kept, each with a place; an empty table
    gives no rows; other columns are not carried. Slots come from key and
    text CRC, so texts under one key, and copies of a text under several,
    spread over slots; rows that repeat both share one. ``maps`` is the folder
    of the versioned map: a grown table is placed by an edited version of the
    last one there. Without it the map is a first version, among scratch tables.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    body = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(F.col(key).alias("doc_id"), (F.octet_length(body).cast("long") + 8).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    slim = scratch.keep(with_slots(slim, "doc_id", slots, "text_crc32"), "slim")
    owner = next_map(spark, maps or f"{scratch.root}/maps", slot_bytes(slim), shards, slots)
    placed = slim.join(F.broadcast(owner), "virtual_slot").select("doc_id", "size", "text_crc32", "virtual_slot", F.col("version").alias("map_version"), "shard")
    return numbered(scratch, placed, [F.col("shard"), F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot", ["shard"])


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")

"""Sharding by fixed virtual slots.

Every record hashes to one of ``n_slots`` virtual slots (thousands, fixed for the life of the
data set).  Rows and bytes are summed per slot -- the only statistic that reaches the driver,
``n_slots`` rows whatever the input -- and a versioned slot-to-shard map says where each slot
lives.  Rebalancing edits the map: whole slots move, records are never rehashed.  A call that is
given the folder of earlier maps loads the latest version and moves only what the new weights ask
for; the versions stay readable side by side.

Groups of equal texts: a slot is a hash of id and text, so copies of one text under many ids spread
over all slots and shards and can make no shard heavy; records equal in both share a slot.

Defined results: a null text counts no bytes (size 1) and has crc 0; records with equal id and
text share a slot and get different places in it; an empty table gives an empty result and a map
with slots dealt in turn; columns other than the id and the text are never read, so clashing
names do no harm; null ids are records like others.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import fresh_path, materialize

N_SLOTS = 4096
#: The setting that names the folder of a data set's maps.
MAP_SETTING = "spark.veldspar.slotMap"


@dataclass(frozen=True)
class SlotMap:
    """Version ``version`` of the map: ``shard_of[s]`` is the shard of virtual slot ``s``."""

    version: int
    n_shards: int
    shard_of: tuple[int, ...]

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, self.n_shards, s, d) for s, d in enumerate(self.shard_of)]
        return spark.createDataFrame(rows, "version int, n_shards int, virtual_slot int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Add this version to the map table at ``path``; earlier versions stay readable."""
        self.frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/v{self.version:06d}")

    @staticmethod
    def latest(spark: SparkSession, path: str) -> SlotMap | None:
        """The newest version at ``path``, if there is one."""
        jvm = spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
        versions = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()]
        return SlotMap.load(spark, path, max(versions)) if versions else None

    @staticmethod
    def load(spark: SparkSession, path: str, version: int) -> SlotMap:
        rows = spark.read.parquet(f"{path.rstrip('/')}/v{version:06d}").orderBy("virtual_slot").collect()
        return SlotMap(version, rows[0].n_shards, tuple(r.shard for r in rows))

    def moved(self, new: SlotMap) -> list[int]:
        return [s for s, (a, b) in enumerate(zip(self.shard_of, new.shard_of, strict=True)) if a != b]


def plan_map(weight: dict[int, int], n_shards: int, n_slots: int = N_SLOTS) -> SlotMap:
    """First version: heaviest slot first, each to the lightest shard (ties: lowest shard, lowest slot)."""
    heap = [(0, d) for d in range(n_shards)]
    shard_of = [0] * n_slots
    for s in sorted(range(n_slots), key=lambda s: (-weight.get(s, 0), s)):
        load, d = heapq.heappop(heap)
        shard_of[s] = d
        # An empty slot still weighs a little, so that such slots are dealt in turn.
        heapq.heappush(heap, (load + max(weight.get(s, 0), 1), d))
    return SlotMap(1, n_shards, tuple(shard_of))


def rebalance(old: SlotMap, weight: dict[int, int], n_shards: int | None = None) -> SlotMap:
    """Next version: move whole slots from overfull shards to the lightest until none is over the mean.

    Slots of shards that no longer exist move first.  A slot that stays costs nothing, so the
    bytes moved are close to the least that the new shares need.
    """
    n = n_shards or old.n_shards
    shard_of, load = list(old.shard_of), [0] * n
    free = []
    for s, d in enumerate(shard_of):
        if d < n:
            load[d] += weight.get(s, 0)
        else:
            free.append(s)
    mean = sum(weight.values()) / n
    slots: list[list[int]] = [[] for _ in range(n)]
    for s, d in enumerate(shard_of):
        if d < n:
            slots[d].append(s)
    for d in range(n):
        for s in sorted(slots[d], key=lambda s: (-weight.get(s, 0), s)):
            w = weight.get(s, 0)
            if w and load[d] - w >= mean:
                load[d] -= w
                free.append(s)
    heap = [(x, d) for d, x in enumerate(load)]
    heapq.heapify(heap)
    for s in sorted(free, key=lambda s: (-weight.get(s, 0), s)):
        x, d = heapq.heappop(heap)
        shard_of[s] = d
        heapq.heappush(heap, (x + weight.get(s, 0), d))
    return SlotMap(old.version + 1, n, tuple(shard_of))


def records(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, text_key, virtual_slot of every record; narrow, no shuffle."""
    text = F.col(text_col)
    return df.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("text_key"),
        F.pmod(F.xxhash64(F.col(id_col), text), F.lit(n_slots)).cast("int").alias("virtual_slot"),
    )


def slot_weights(recs: DataFrame) -> dict[int, tuple[int, int]]:
    """(bytes, rows) of each slot that has rows: at most ``n_slots`` rows reach the driver."""
    rows = recs.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    return {r.virtual_slot: (r.b, r.n) for r in rows}


def shard(df: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """Law ``bytes``: doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version.

    ``slot`` is the record's place in its shard, from 0 without gaps: the rows of the shard's
    earlier virtual slots plus the place within its own.  With ``map_path`` the map is stored there;
    of an earlier version there, only slots that must move do (it settles the number of slots).
    """
    spark = df.sparkSession
    if map_path and (known := SlotMap.latest(spark, map_path)):
        n_slots = len(known.shard_of)
    recs = materialize(records(df, id_col, text_col, n_slots), "slots")
    weights = slot_weights(recs)
    sizes = {s: b for s, (b, _) in weights.items()}
    before = SlotMap.latest(spark, map_path) if map_path else None
    slot_map = rebalance(before, sizes, n_shards) if before else plan_map(sizes, n_shards, n_slots)
    if map_path:
        slot_map.save(spark, map_path)
    seen, rows = [0] * n_shards, []
    for s, d in enumerate(slot_map.shard_of):
        rows.append((s, d, seen[d]))
        seen[d] += weights.get(s, (0, 0))[1]
    places = spark.createDataFrame(rows, "virtual_slot int, shard int, before long")
    order = Window.partitionBy("virtual_slot").orderBy(F.col("doc_id"), F.col("text_crc32"), F.col("text_key"))
    # n_slots rows of three numbers: bounded whatever the input, so it is broadcast.
    return (
        recs.withColumn("within", F.row_number().over(order) - 1)
        .join(F.broadcast(places), "virtual_slot")
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("before") + F.col("within")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(slot_map.version).alias("map_version"),
        )
    )


def map_folder(spark: SparkSession) -> str:
    """Where a job's maps are: the folder that ``spark.veldspar.slotMap`` names, whose latest map is edited and stored as the next version; else one of its own."""
    return spark.conf.get(MAP_SETTING, None) or fresh_path(spark, "slot-map")


def write_shards(df: DataFrame, slot_map: SlotMap, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the records themselves, one folder per shard, by the map."""
    n = len(slot_map.shard_of)
    spark = df.sparkSession
    places = slot_map.frame(spark).select(F.col("virtual_slot").alias("_vslot"), F.col("shard").alias("_shard"))
    tagged = df.withColumn("_vslot", F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n)).cast("int")).join(F.broadcast(places), "_vslot")
    tagged.drop("_vslot").withColumnRenamed("_shard", "shard_no").write.mode("overwrite").partitionBy("shard_no").parquet(path)


def op8_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard(docs, map_path=map_folder(spark))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op8_virtual_slots": op8_virtual_slots}
ORACLES: dict[str, str] = {}

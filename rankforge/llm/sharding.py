"""Sharding over fixed virtual slots with a versioned slot-to-shard map.

A row's group (rows with equal text) is hashed into one of thousands of virtual slots. Bytes are
summed per slot, and a map assigns slots to shards. The map is a small table (slots, not rows):
version 1 deals the slots out in turn; a rebalance moves as few slots as it can until shard sizes
are near equal and stores the edited map as the next version. Rows never know their shard, only
their slot, so a rebalance moves the rows of the moved slots and no others.

Equal texts share a slot and so a shard, unless one group alone is larger than a shard's fair
share: then near equal sizes are impossible with the group whole, and the group's rows are dealt to
several slots of their own by doc_id. A slot that is too heavy is split the same way in two steps,
first by text (which sets other texts apart from the heavy one), then by doc_id.

Defined results: a null text has 0 bytes and equals the empty text; each row weighs 1 more than its
bytes; repeated rows are rows of their own; an empty table gives no rows; a null doc_id is hashed
like any value; other columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_lineage, shared_dir
from .positions import numbered

SLOTS = 4096
TOLERANCE = 0.01  # of the mean, that shards may be apart before a stored map is edited
_TEXT_SPLIT, _ID_SPLIT = 256, 256


@dataclass(frozen=True)
class Slots:
    """Rows with their virtual slot, and the splits that were needed: heavy slots, heavy texts in them."""
    rows: DataFrame
    heavy: list[int]
    heavier: list[int]


def weighed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, _text_hash, _text_hash2): all that is needed of the texts, read once."""
    raw = F.encode(F.coalesce(F.col(text_column), F.lit("")), "UTF-8")
    return docs.select(F.col(id_column).alias("doc_id"), raw.alias("_raw")).select(
        "doc_id", (F.octet_length("_raw") + 1).cast("long").alias("size"), F.crc32("_raw").alias("text_crc32"),
        F.xxhash64("_raw").alias("_h1"), F.xxhash64("_raw", F.lit(1)).alias("_h2"))


def _bytes_by(rows: DataFrame, slot: Column) -> dict[int, int]:
    """Bytes per slot: at most one row per slot comes to the driver."""
    return {r[0]: r[1] for r in rows.groupBy(slot.alias("s")).agg(F.sum("size").alias("b")).collect()}


def with_slots(rows: DataFrame, shards: int, slots: int = SLOTS) -> tuple[Slots, dict[int, int]]:
    """Virtual slot per weighed row, and bytes per slot. Slots heavier than a fair share are split."""
    base = F.pmod(F.col("_h1"), F.lit(slots)).cast("long")
    sizes = _bytes_by(rows, base)
    share = sum(sizes.values()) / shards
    heavy = sorted(s for s, b in sizes.items() if b > share)
    slot, heavier = base, []
    if heavy:
        text_slot = slots + base * _TEXT_SPLIT + F.pmod(F.col("_h2"), F.lit(_TEXT_SPLIT))
        slot = F.when(base.isin(heavy), text_slot).otherwise(base)
        sizes = _bytes_by(rows, slot)
        heavier = sorted(s for s, b in sizes.items() if b > share)
    if heavier:
        first = slots * (1 + _TEXT_SPLIT)
        id_slot = first + slot * _ID_SPLIT + F.pmod(F.xxhash64("doc_id"), F.lit(_ID_SPLIT))
        slot = F.when(slot.isin(heavier), id_slot).otherwise(slot)
        sizes = _bytes_by(rows, slot)
    return Slots(rows.withColumn("virtual_slot", slot.cast("long")), heavy, heavier), sizes


def initial_map(sizes: dict[int, int], shards: int) -> dict[int, int]:
    """Version 1: the slots in turn, whatever they weigh."""
    return {slot: i % shards for i, slot in enumerate(sorted(sizes))}


def rebalanced(mapping: dict[int, int], sizes: dict[int, int], shards: int, tolerance: float = 0.001) -> dict[int, int]:
    """Edit the map: move slots from the fullest to the emptiest shard while that evens them out.

    Each move takes the slot nearest to half the gap, so the largest shard never grows; it ends when
    the gap is within `tolerance` of the mean or no slot of the fullest shard fits the gap.
    """
    out = dict(mapping)
    held: dict[int, set[int]] = {s: set() for s in range(shards)}
    for slot, shard in out.items():
        held[shard].add(slot)
    load = {s: sum(sizes[x] for x in xs) for s, xs in held.items()}
    mean = sum(load.values()) / shards
    for _ in range(8 * max(1, len(out))):
        full, empty = max(load, key=lambda s: (load[s], s)), min(load, key=lambda s: (load[s], s))
        gap = load[full] - load[empty]
        if gap <= tolerance * mean:
            break
        fitting = [x for x in held[full] if 0 < sizes[x] < gap]
        if not fitting:
            break
        moved = min(fitting, key=lambda x: (abs(sizes[x] - gap / 2), x))
        held[full].remove(moved)
        held[empty].add(moved)
        out[moved] = empty
        load[full] -= sizes[moved]
        load[empty] += sizes[moved]
    return out


def save_map(spark: SparkSession, folder: str, version: int, mapping: dict[int, int], sizes: dict[int, int]) -> None:
    """Store one version; earlier versions stay readable beside it."""
    rows = [(slot, shard, sizes.get(slot, 0)) for slot, shard in sorted(mapping.items())]
    (spark.createDataFrame(rows, "virtual_slot long, shard int, bytes long").coalesce(1)
     .write.mode("errorifexists").parquet(f"{folder}/version={version}"))


def load_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/version={version}").withColumn("map_version", F.lit(version))


def latest_map(spark: SparkSession, folder: str) -> tuple[int, dict[int, int]]:
    """Number and slots of the newest stored version; (0, nothing) without one."""
    try:
        stored = spark.read.parquet(folder)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return 0, {}
        raise
    version = stored.agg(F.max("version")).first()[0]
    return version, {r["virtual_slot"]: r["shard"] for r in load_map(spark, folder, version).collect()}  # a row per slot


def edited(mapping: dict[int, int], sizes: dict[int, int], shards: int, tolerance: float = TOLERANCE) -> dict[int, int]:
    """The stored map for the slots of today: known slots stay, new ones go to the emptiest shard, and only if shards are then
    further apart than `tolerance` of their mean are slots moved. Slots without rows keep their place."""
    out = {slot: shard for slot, shard in mapping.items() if shard < shards}
    load = [0] * shards
    for slot, shard in out.items():
        load[shard] += sizes.get(slot, 0)
    for slot in sorted(set(sizes) - set(out), key=lambda x: (-sizes[x], x)):
        out[slot] = min(range(shards), key=lambda s: (load[s], s))
        load[out[slot]] += sizes[slot]
    if max(load) - min(load) <= tolerance * sum(load) / shards:
        return out
    return rebalanced(out, {slot: sizes.get(slot, 0) for slot in out}, shards)


def shard_documents(docs: DataFrame, shards: int = 16, folder: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, shard, map_version, slot): near equal bytes per shard.

    With a `folder` that holds a map the newest version is taken up: it is kept where it still fits, else edited and
    stored as the next version, and only the rows of moved slots change their shard. Without one a map is made: version 1 deals
    the slots out, version 2 is balanced.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark).rstrip('/')}/shard-map-{uuid.uuid4().hex}"
    slots, sizes = with_slots(cut_lineage(weighed(docs)), shards)
    version, mapping = latest_map(spark, folder)
    if version == 0:
        version, mapping = 1, initial_map(sizes, shards)
        save_map(spark, folder, version, mapping, sizes)
        new = rebalanced(mapping, sizes, shards)
        changed = True
    else:
        new = edited(mapping, sizes, shards)
        changed = new != mapping
    if changed:
        version += 1
        save_map(spark, folder, version, new, sizes)
    current = load_map(spark, folder, version).select("virtual_slot", "shard", "map_version")
    placed = slots.rows.join(F.broadcast(current), "virtual_slot")  # one row per slot, bounded by SLOTS and its splits
    return numbered(placed, ["shard"], ["doc_id", "text_crc32"], "slot").drop("_h1", "_h2")

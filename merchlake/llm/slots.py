"""Sharding over fixed virtual slots with a versioned map from slots to shards.

A record is hashed, by id and content, into one of ``SLOTS`` virtual slots and never leaves it. Bytes and rows are
aggregated per slot. The map says which shard owns each slot; its first version deals slots out in turn, and
rebalancing edits it: single slots move, or two change places, from the fullest shard to the emptiest until nothing
more evens them out. Every version is stored. Only the slot table, of fixed size, reaches the driver.

The law that holds is ``bytes``: shard sizes are near equal. Null texts count as empty; null ids share the slot their
content gives them. Repeated rows, equal in id and text, go to the same slot, one after the other; equal texts under
other ids may go to other slots. Texts of any length are one record each; one longer than a shard's share stands in a
shard that is as much fuller. An empty table stores a map and gives no rows. Other columns are carried if asked for.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from merchlake.llm.components import saved
from merchlake.session import path_exists

SLOTS = 8192
SHARDS = 24
#: Bytes that a record takes besides its text.
RECORD_BYTES = 8


def slot_records(records: DataFrame, id_col: str, text_col: str, slots: int = SLOTS, carry: bool = False) -> DataFrame:
    """``id``, ``size``, ``text_crc32`` and virtual slot ``vslot`` of each record; the rest stays behind or is carried."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return records.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + RECORD_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *([F.struct(*(F.col(f"`{c}`") for c in records.columns)).alias("record")] if carry else []),
    ).withColumn("vslot", F.pmod(F.xxhash64("id", "text_crc32"), F.lit(slots)).cast("int"))


def first_map(shards: int = SHARDS, slots: int = SLOTS) -> np.ndarray:
    return np.arange(slots) % shards


def rebalance(owner: np.ndarray, weight: np.ndarray, shards: int = SHARDS) -> np.ndarray:
    """A new version of the map, edited as little as evening out the shards' weights takes."""
    owner = owner.copy()
    load = np.bincount(owner, weights=weight, minlength=shards)
    while True:
        full, empty = int(load.argmax()), int(load.argmin())
        gap = load[full] - load[empty]
        mine = np.flatnonzero((owner == full) & (weight > 0))
        if not len(mine) or gap <= 0:
            return owner
        # The move that brings both nearest to their mean; an exchange where no single slot fits.
        move = mine[np.abs(weight[mine] - gap / 2).argmin()]
        left, taken = abs(weight[move] - gap / 2), None
        theirs = np.flatnonzero((owner == empty) & (weight > 0))
        if len(theirs):
            theirs = theirs[np.argsort(weight[theirs])]
            wanted = weight[mine] - gap / 2
            at = np.searchsorted(weight[theirs], wanted).clip(0, len(theirs) - 1)
            for near in (at, (at - 1).clip(0)):
                miss = np.abs(weight[mine] - weight[theirs[near]] - gap / 2)
                if miss.min() < left:
                    left = miss.min()
                    move, taken = mine[miss.argmin()], theirs[near[miss.argmin()]]
        if left >= gap / 2:
            return owner
        moved = weight[move] - (weight[taken] if taken is not None else 0)
        owner[move] = empty
        if taken is not None:
            owner[taken] = full
        load[full] -= moved
        load[empty] += moved


_MAP = "vslot int, shard int, version int"


def store_map(spark: SparkSession, folder: str, version: int, owner: np.ndarray) -> None:
    """Add a version of the map to the shared folder; storing a version again replaces it."""
    rows = list(enumerate(owner.tolist()))
    written = spark.createDataFrame(rows, "vslot int, shard int").coalesce(1).write.mode("overwrite")
    written.parquet(f"{folder}/version={version}")


def read_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """One row per slot, ``vslot``, ``shard`` and ``version``: of the newest version, or of the one asked for."""
    stored = spark.read.schema(_MAP).parquet(folder)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.filter(F.col("version") == version)


def edit_map(spark: SparkSession, folder: str, weight: np.ndarray, shards: int) -> None:
    """Balance the newest stored map for these weights of the slots and store it as the next version.

    The first version deals the slots out in turn. Slots of shards that are no more are dealt out anew.
    """
    slots = len(weight)
    if path_exists(spark, folder):
        rows = read_map(spark, folder).collect()
        version, owner = rows[0]["version"], np.full(slots, -1)
        if len(rows) != slots:
            raise ValueError(f"the map in {folder} has {len(rows)} slots, not {slots}")
        for r in rows:
            owner[r["vslot"]] = r["shard"]
        lost = owner >= shards
        owner[lost] = first_map(shards, slots)[lost]
    else:
        version, owner = 0, first_map(shards, slots)
        store_map(spark, folder, version, owner)
        lost = np.zeros(slots, bool)
    balanced = rebalance(owner, weight, shards)
    if version == 0 or lost.any() or (balanced != owner).any():
        store_map(spark, folder, version + 1, balanced)


def shard_records(
    records: DataFrame,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = SHARDS,
    slots: int = SLOTS,
    carry: bool = False,
) -> DataFrame:
    """``id``, ``size``, ``text_crc32``, ``vslot``, ``shard`` and the record's place in its shard, counted from 0; with
    ``carry`` also the whole ``record``.

    The slot map is kept in ``folder``, visible to every executor. A run edits the newest version for the records that
    it is given and stores it as the next.
    """
    spark = records.sparkSession
    placed = saved(slot_records(records, id_col, text_col, slots, carry), "slots")
    stats = placed.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    size, rows = np.zeros(slots), np.zeros(slots, np.int64)
    for r in stats:
        size[r["vslot"]], rows[r["vslot"]] = r["bytes"], r["rows"]
    edit_map(spark, folder, size, shards)

    counts = spark.createDataFrame([(slot, int(n)) for slot, n in enumerate(rows.tolist())], "vslot int, n long")
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1))
    # One row per slot: a table of fixed size.
    slot_table = read_map(spark, folder).join(counts, "vslot").withColumn("start", F.coalesce(before, F.lit(0)))
    within = F.row_number().over(Window.partitionBy("vslot").orderBy("id", "text_crc32", "size"))
    return (
        placed.withColumn("within", within - 1)
        .join(F.broadcast(slot_table.select("vslot", "shard", "start")), "vslot")
        .select(
            "id",
            "size",
            "text_crc32",
            "vslot",
            "shard",
            (F.col("start") + F.col("within")).cast("long").alias("place"),
            *(["record"] if carry else []),
        )
    )


def shard_digest(placed: DataFrame) -> DataFrame:
    return placed.select(
        "id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("place").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *[c for c in ("record",) if c in placed.columns],
    )

"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a ring; a row belongs to the arc in which
its key's hash falls and prefers the shards in the order in which they follow
clockwise. A shard that is full refuses, and the row continues clockwise. All
rows of an arc share one list of preferences, so the walk is decided for whole
arcs: from one count per (arc, segment), a table whose size depends on the
number of shards alone, the driver cuts each arc into runs of ranks and gives
each run to a shard. Rows then only need their rank within their arc, which is
taken per (arc, segment) so that a hot key is spread over ``segments`` groups.

Capacity: with ``slack`` = 0 the shards' quotas add up to exactly the number of
rows (floor or ceiling of the mean), so that row counts are at most one apart;
with ``slack`` > 0 no shard takes more than ceil((1 + slack) * mean) rows and
fewer rows leave their first shard.

Defined results: a null key hashes as the empty string and its rows are dealt
like any other; repeated rows are separate rows; ties are broken by content, and
rows equal in all columns are interchangeable; an empty table gives an empty
result; extra columns are carried along, but for ones named ``shard`` or ``slot``,
whose place the new ones take.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvspark.llm._common import written

RING_BITS = 60


def ring(n_shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted points of the ring and the shard that owns each."""
    points = [
        (int(hashlib.md5(f"shard-{s}/{v}".encode()).hexdigest()[:15], 16), s)
        for s in range(n_shards)
        for v in range(vnodes)
    ]
    points.sort()
    return np.array([p for p, _ in points], dtype=np.int64), np.array([s for _, s in points], dtype=np.int64)


def preferences(owners: np.ndarray, n_shards: int) -> np.ndarray:
    """For each arc, all shards in the order in which they come clockwise."""
    out = np.zeros((len(owners), n_shards), dtype=np.int64)
    for arc in range(len(owners)):
        seen: list[int] = []
        step = arc
        while len(seen) < n_shards:
            owner = int(owners[step % len(owners)])
            if owner not in seen:
                seen.append(owner)
            step += 1
        out[arc] = seen
    return out


def quotas(total: int, n_shards: int, slack: float) -> np.ndarray:
    if slack <= 0:
        return total // n_shards + (np.arange(n_shards) < total % n_shards).astype(np.int64)
    return np.full(n_shards, int(np.ceil((1 + slack) * total / n_shards)), dtype=np.int64)


def walk(counts: np.ndarray, prefer: np.ndarray, capacity: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Runs (arc, first rank, shard, first slot): where each arc's rows go.

    Level by level: at level d every arc offers what it has left to its d-th
    shard; a shard serves the arcs clockwise until it is full.
    """
    left, given = counts.copy(), np.zeros_like(counts)
    room, slots = capacity.copy(), np.zeros_like(capacity)
    runs = []
    for d in range(prefer.shape[1]):
        for arc in np.flatnonzero(left):
            shard = prefer[arc, d]
            take = min(left[arc], room[shard])
            if take:
                runs.append((int(arc), int(given[arc]), int(shard), int(slots[shard])))
                given[arc] += take
                slots[shard] += take
                left[arc] -= take
                room[shard] -= take
    return runs


def assign_shards(
    df: DataFrame, key: str, n_shards: int = 16, vnodes: int = 128, slack: float = 0.0, segments: int = 32
) -> DataFrame:
    """``df`` with ``shard`` (int) and ``slot`` (long, gapless from 0 per shard).

    ``df`` should be narrow: it is written once to the shared folder, since the
    ranks have to be taken of the same rows as the counts.
    """
    points, owners = ring(n_shards, vnodes)
    names = [c for c in df.columns if c not in ("shard", "slot")]

    @F.pandas_udf("int")
    def arc_of(h: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(points, h.to_numpy(), side="left") % len(points)).astype("int32")

    text = F.coalesce(df[key].cast("string"), F.lit(""))  # also where the key is one of the replaced columns
    position = F.conv(F.substring(F.md5(text.cast("binary")), 1, RING_BITS // 4), 16, 10).cast("long")
    kept = written(
        df.select(
            *[df[c] for c in names],
            position.alias("__h"),
            arc_of(position).alias("__arc"),
            F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(segments)).cast("int").alias("__seg"),
        ),
        "ring",
    )
    counted = kept.groupBy("__arc", "__seg").agg(F.count("*").alias("n")).toPandas()  # arcs x segments rows at most
    table = np.zeros((len(points), segments), dtype=np.int64)
    table[counted["__arc"].to_numpy(), counted["__seg"].to_numpy()] = counted["n"].to_numpy()
    capacity = quotas(int(table.sum()), n_shards, slack)
    runs = sorted(walk(table.sum(axis=1), preferences(owners, n_shards), capacity))
    before = np.cumsum(table, axis=1) - table
    run_arc = np.array([r[0] for r in runs], dtype=np.int64)
    run_from = np.array([r[1] for r in runs], dtype=np.int64)
    run_shard = np.array([r[2] for r in runs], dtype=np.int32)
    run_slot = np.array([r[3] for r in runs], dtype=np.int64)
    first_run = np.searchsorted(run_arc, np.arange(len(points) + 1))

    @F.pandas_udf("struct<shard:int,slot:long>")
    def place(arc: pd.Series, seg: pd.Series, rank: pd.Series) -> pd.DataFrame:
        arcs, at = arc.to_numpy(), rank.to_numpy(dtype=np.int64) - 1
        at = at + before[arcs, seg.to_numpy()]
        run = first_run[arcs]
        while True:  # an arc has one run, or a few where it overflowed
            more = (run + 1 < first_run[arcs + 1]) & (run_from[np.minimum(run + 1, len(run_from) - 1)] <= at)
            if not more.any():
                break
            run = run + more
        return pd.DataFrame({"shard": run_shard[run], "slot": run_slot[run] + at - run_from[run]})

    order = Window.partitionBy("__arc", "__seg").orderBy("__h", *names)
    placed = kept.withColumn("__at", place("__arc", "__seg", F.row_number().over(order)))
    return placed.select(*names, F.col("__at.shard").alias("shard"), F.col("__at.slot").alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """The digest of ``documents``: sizes and checksums with the shard and slot of each row."""
    text = F.coalesce(docs["text"], F.lit(""))
    narrow = docs.select(
        docs["doc_id"],
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    dealt = assign_shards(narrow, "doc_id", n_shards)
    return dealt.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )

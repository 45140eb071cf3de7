"""Hierarchical multi-length packing.

Each document's ids (with the end id) are cut into whole long windows; what is
left is routed to the smallest of several tiers (context sizes, all powers of
two) that holds it. Each tier is packed into windows of its size; the gap of a
window is filled by the largest fitting rests of the same and of shorter tiers
and, where none fits, by a cut of one, so that every window is full. What a
partition has left at its end goes to windows of a power of two each. Steps take
sequences in the order in which they close, partition after partition, and hold
``STEP`` ids, up to one sequence more or less; the table's last one may hold fewer.

Partitions pack on their own: nothing is shuffled, and a lost task is run again
with the same result. ``sequence_id`` holds the partition in its upper half. The
pieces are written once, since the steps need the ids of the partitions before, a
number for each partition.

Defined results: null text counts as empty, that is one sequence place for the
end id; repeated rows are packed each; an empty table gives an empty result;
extra columns are ignored; very long texts are cut.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvspark.llm._common import columns_as, release, slices, worker_cache, written

WINDOW, TIERS, STEP = 1024, (256, 512, 1024), 65_536


def byte_of() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Ids:
    """The ids of a vocabulary file as packed little-endian bytes, piece by piece.

    The pieces are the text cut before each space with a non-space on a side,
    which is always a pre-token's start; other texts are encoded whole. A piece
    that is new goes through the merges of the vocabulary. With ``added``, texts are
    first cut at the file's added tokens, which have their own ids, as the library
    does by default; else these strings are ordinary text.
    """

    UNSAFE = re.compile(r"\s \s|\s \Z|\A \s| \Z")

    def __init__(self, path: str, pattern: str, keep: int = 400_000, added: bool = False) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        table, merges = byte_of(), model["merges"]
        made = {"".join(m.split(" ") if isinstance(m, str) else m) for m in merges}
        ranks = {bytes(map(table.__getitem__, t)): i for t, i in model["vocab"].items() if t in made or len(t) == 1}
        self.encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.keep, self.pieces = keep, {}
        tokens = file.get("added_tokens") or [] if added else []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in tokens):
            raise ValueError("added tokens that depend on the text beside them")
        self.added = {t["content"]: t["id"].to_bytes(4, "little") for t in tokens}
        longest = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None

    def piece(self, part: str) -> bytes:
        packed = b"".join(i.to_bytes(4, "little") for i in self.encoding.encode_ordinary(part))
        if len(part) <= 64:
            if len(self.pieces) >= self.keep:
                self.pieces.clear()
            self.pieces[part] = packed
        return packed

    def packed(self, text: str) -> bytes:
        if self.cut is None or self.cut.search(text) is None:
            return self.ordinary(text)
        parts = self.cut.split(text)
        return b"".join(self.added[p] if i % 2 else self.ordinary(p) for i, p in enumerate(parts) if p)

    def ordinary(self, text: str) -> bytes:
        if self.UNSAFE.search(text):
            return b"".join(i.to_bytes(4, "little") for i in self.encoding.encode_ordinary(text))
        known, piece = self.pieces.get, self.piece
        parts = text.split(" ")
        spaced = [known(part) or piece(part) for part in map(" ".__add__, parts[1:])]
        return b"".join(chain((known(parts[0]) or piece(parts[0]),), spaced))


class Packer:
    """Packs the documents of one partition; rows come out as sequences close."""

    def __init__(self, first_id: int, window: int = WINDOW, tiers: tuple[int, ...] = TIERS) -> None:
        self.window, self.tiers = window, tiers
        self.next, self.first, self.told = first_id, first_id, 0
        #: By tier: rests (length, number, document, start, its ids' bytes), shortest first.
        self.pools: list[list[tuple]] = [[] for _ in tiers]
        self.sums = [0] * len(tiers)
        self.number = 0
        self.rows: list[tuple] = []

    def add(self, doc: tuple, ids: bytes) -> None:
        """doc: (doc_id, its number of ids)."""
        n, start = len(ids) // 4, 0
        while n - start >= self.window:
            self.close([(self.window, 0, doc, start, ids[start * 4 : (start + self.window) * 4])])
            start += self.window
        if start < n:
            self.put((n - start, self.number, doc, start, ids[start * 4 :]))

    def put(self, rest: tuple) -> None:
        self.number += 1
        tier = bisect.bisect_left(self.tiers, rest[0])
        if rest[0] == self.tiers[tier]:
            self.close([rest])
        else:
            bisect.insort(self.pools[tier], (rest[0], self.number, *rest[2:]))
            self.sums[tier] += rest[0]

    def take(self, tier: int, at: int) -> tuple:
        rest = self.pools[tier].pop(at)
        self.sums[tier] -= rest[0]
        return rest

    def close(self, pieces: list[tuple]) -> None:
        at = 0
        for length, _, doc, start, ids in pieces:
            self.rows.append((doc[0], start, length, zlib.crc32(ids), doc[1], self.next, at, self.told))
            at += length
        self.told += at
        self.next += 1

    def fitting(self, gap: int, tier: int) -> tuple | None:
        """The longest rest of this or a shorter tier that the gap holds."""
        for t in range(tier, -1, -1):
            at = bisect.bisect_right(self.pools[t], (gap, float("inf")))
            if at:
                return self.take(t, at - 1)
        return None

    def fill(self, size: int, tier: int) -> None:
        """Close one window of ``size`` with the longest rests that fit; the last gap gets a part of one."""
        held, gap = [], size
        while gap:
            found = self.fitting(gap, tier)
            if found is None:  # all rests are longer: cut the shortest
                length, number, doc, start, ids = self.take(next(t for t, p in enumerate(self.pools) if p), 0)
                self.put((length - gap, number, doc, start + gap, ids[gap * 4 :]))
                found = (gap, number, doc, start, ids[: gap * 4])
            held.append(found)
            gap -= found[0]
        self.close(held)

    def pack(self, spare: int) -> None:
        """Close windows of each tier, longest first, while rests of ``spare`` ids stay for later gaps."""
        for tier in range(len(self.tiers) - 1, -1, -1):
            size = self.tiers[tier]
            while self.pools[tier] and sum(self.sums[: tier + 1]) >= size and sum(self.sums) >= size + spare:
                self.fill(size, tier)

    def finish(self) -> None:
        """Close all that is left: full windows, then one window of a power of two for each bit."""
        self.pack(0)
        while left := sum(self.sums):
            self.fill(min(self.tiers[-1], 1 << (left.bit_length() - 1)), len(self.tiers) - 1)


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "step_group"]
#: Before the steps are known: the ids of the partition before the sequence.
PIECES = [*NAMES[:-1], "told"]


def pack_documents(docs: DataFrame, path: str, pattern: str, end_id: int = 0, window: int = WINDOW,
                   tiers: tuple[int, ...] = TIERS, pool: int = 256, added: bool = False, step: int = STEP) -> DataFrame:
    """Pieces of the documents' ids in sequences of at most ``window`` ids.

    ``pool``: so many windows' worth of rests wait for a fitting gap, at most.
    ``added``: the strings of the file's added tokens get these tokens' ids.
    ``step_group``: the step of ``step`` ids that takes the sequence.
    """
    few = columns_as(docs, doc_id="doc_id", text="text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = worker_cache(f"packing:{path}:{added}", lambda: Ids(path, pattern, added=added), large=True)
        packer = Packer(TaskContext.get().partitionId() << 32, window, tiers)
        end = end_id.to_bytes(4, "little")

        def told() -> pa.RecordBatch:
            columns = list(zip(*packer.rows, strict=True)) or [[]] * len(PIECES)
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=PIECES)

        for batch in batches:
            for part in slices(batch, rows=512):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    packed = ids.packed(text or "") + end
                    packer.add((doc_id, len(packed) // 4), packed)
                if sum(packer.sums) > pool * window:
                    packer.pack(pool * window // 2)
                if packer.rows:
                    yield told()
        packer.finish()
        yield told()
        release()

    pieces = written(few.mapInArrow(run, ", ".join(f"{n} long" for n in PIECES)), "pieces")
    partition = F.shiftright("sequence_id", 32).alias("partition")
    sums = pieces.groupBy(partition).agg(F.sum("length").alias("n")).orderBy("partition").collect()  # a row for each partition
    before, at = ([], []), 0
    for row in sums:
        before[0].append(row["partition"])
        before[1].append(at)
        at += row["n"]
    # as Arrow: a list's rows would start a daemon and workers of another kind in each executor, which stay
    before = pa.table([pa.array(c, type=pa.int64()) for c in before], names=["partition", "before"])
    before = docs.sparkSession.createDataFrame(before)
    group = F.expr(f"(before + told) div {step}").alias("step_group")
    return pieces.withColumn("partition", partition).join(F.broadcast(before), "partition").select(*NAMES[:-1], group)

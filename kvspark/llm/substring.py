"""Substring dedup by difference-cover anchors.

A window is ``window`` consecutive words of one document. For a period v and a
set D whose differences cover all residues modulo v, any two equal windows at i
and j have a shift below v that takes both starts to places in D modulo v. So it
is enough to hash short runs (anchors) of window - v + 1 words at the places in
D: equal windows share an aligned anchor. Three passes over blocks of documents:

1. anchors: each block sends the distinct hashes of its anchors; the ones that
   occur again, there or elsewhere, come back to their blocks;
2. extension: the windows that hold such an anchor are hashed whole (96 bits);
   each block sends its first occurrence of each, and the first of all
   occurrences, one row however often the window occurs, comes back;
3. each document drops the words of its windows that are not first occurrences.

Hashes travel packed, a row per pair of block and bucket, so that a passage that
a third of the documents share adds one hash for each block. The shuffle of the
texts into blocks is the same in all passes and is reused. Memory in a task is a
block of texts, or a bucket of hashes; the number of both follows the input's bytes
(``blocks_for``).

Defined results: null text has no words; a null doc_id counts as smallest; rows
with one doc_id count as separate documents in an order by the block that their id
and text fall in, then by text (null first), equal rows in any order; windows are judged on the input, not on what is left; texts
of under ``window`` words are kept; an empty table gives an empty result; extra
columns are ignored, or carried along by ``drop_repeats``.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvspark.llm._common import input_bytes, lean, release, worker_cache
from kvspark.llm._words import BASES, Hasher, chunks, positions

#: Perfect difference sets by their period.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
NO_ID = np.iinfo(np.int64).min
#: A window's row: 96 bits of its hash, doc_id, place.
WINDOW_BYTES = 24
#: Of the input's files, for each block, and for each pair of block and bucket.
BLOCK_BYTES, BYTES_A_PAIR = 8 << 20, 2048


def period_for(window: int) -> int:
    """The longest period that leaves anchors of at least a third of the window."""
    return max((v for v in COVERS if window - v + 1 >= window / 3), default=3)


class Anchors:
    """The words, anchors and windows of the texts of one block, in chunks."""

    def __init__(self, window: int) -> None:
        self.window, self.period = window, period_for(window)
        self.length = window - self.period + 1
        self.hasher = worker_cache("hasher", Hasher)
        self.cover = np.zeros(self.period, dtype=bool)
        self.cover[list(COVERS[self.period])] = True

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word hashes, counts, places of anchors, anchors' hashes)."""
        words, counts = self.hasher.words(texts)
        place, left = positions(counts)
        size = place + left
        use = self.cover[place % self.period] & (left >= self.length) & (size >= self.window)
        at = np.flatnonzero(use)
        return words, counts, at, self.hasher.runs(words, at, at + self.length, BASES[1])

    def candidates(self, counts: np.ndarray, at: np.ndarray, repeated: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold a repeated anchor."""
        n = int(counts.sum())
        held = np.zeros(n + 1, dtype=np.int64)
        held[at[repeated] + 1] = 1
        np.cumsum(held, out=held)
        _, left = positions(counts)
        start = np.flatnonzero(left >= self.window)
        return start[held[start + self.period] > held[start]]

    def whole(self, words: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        stop = start + self.window
        return self.hasher.runs(words, start, stop, BASES[1]), self.hasher.runs(words, start, stop, BASES[2])


def contained(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Mask of the values that the sorted array holds."""
    if len(among) == 0:
        return np.zeros(len(values), dtype=bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def by_bucket(keys: np.ndarray, n: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by bucket, and (bucket, from, to) for those with rows."""
    bucket = ((keys >> np.uint64(40)) % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n + 1))
    return order, [(b, int(cuts[b]), int(cuts[b + 1])) for b in range(n) if cuts[b] < cuts[b + 1]]


def sorted_block(block: pa.Table) -> tuple[pa.Table, list[bytes], np.ndarray]:
    """The documents of a block in their order: table, texts, ids."""
    block = block.sort_by([("doc_id", "ascending"), ("text", "ascending")]) if block.num_rows > 1 else block
    ids = block.column("doc_id").fill_null(int(NO_ID)).to_numpy()
    nulls = block.column("doc_id").null_count
    if nulls:  # sorted last; they come first
        order = np.concatenate([np.arange(len(ids) - nulls, len(ids)), np.arange(len(ids) - nulls)])
        block, ids = block.take(pa.array(order)), ids[order]
    texts = [t or b"" for t in block.column("text").cast(pa.binary()).to_pylist()]
    return block, texts, ids


def merged(blobs: pa.ChunkedArray, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(b for b in blobs.to_pylist() if b), dtype=dtype)


def rows_of(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def blocks_for(docs: DataFrame) -> int:
    """As many blocks and buckets as shuffle partitions, more where a block would exceed ``BLOCK_BYTES`` of
    the input's files; where pairs of block and bucket would have less than ``BYTES_A_PAIR`` of them,
    blocks grow as the root of the input."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = input_bytes(docs)
    return max(least, min(size // BLOCK_BYTES, int((size // BYTES_A_PAIR) ** 0.5)))


def _repeats(docs: DataFrame, window: int, blocks: int | None, finish, out: str) -> DataFrame:
    """``finish(table, texts, masks)`` makes the rows of one block; a mask tells the words to remove."""
    n = blocks or blocks_for(docs)
    placed = docs.withColumn("__block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")).repartition(n, "__block")
    to_bucket = pa.schema([("bucket", pa.int32()), ("__block", pa.int32()), ("data", pa.binary())])
    to_block = pa.schema([("__block", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])

    def send(table: pa.Table) -> pa.Table:
        block, anchors = table.column("__block")[0].as_py(), Anchors(window)
        texts = [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]
        found = [anchors.read(texts[a:b])[3] for a, b in chunks(texts)]
        keys, times = np.unique(np.concatenate(found), return_counts=True)
        keys = np.repeat(keys, np.minimum(times, 2))  # twice: repeated within the block
        order, parts = by_bucket(keys, n)
        return rows_of(to_bucket, [(b, block, keys[order[i:j]].tobytes()) for b, i, j in parts])

    def match(table: pa.Table) -> pa.Table:
        blobs = table.column("data").to_pylist()
        keys = np.frombuffer(b"".join(blobs), dtype=np.uint64)
        owner = np.repeat(table.column("__block").to_numpy(), [len(b) // 8 for b in blobs])
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        same = keys[1:] == keys[:-1]
        again = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        keys, owner = keys[again], owner[again]
        order = np.argsort(owner, kind="stable")
        keys, owner = keys[order], owner[order]
        cuts = [0, *(np.flatnonzero(owner[1:] != owner[:-1]) + 1).tolist(), len(owner)] if len(owner) else []
        rows = [(int(owner[i]), 0, np.unique(keys[i:j]).tobytes()) for i, j in zip(cuts, cuts[1:], strict=False)]
        return rows_of(to_block, rows)

    def extend(table: pa.Table, known: pa.Table) -> pa.Table:
        if table.num_rows == 0 or known.num_rows == 0:
            return rows_of(to_bucket, [])
        block, anchors = table.column("__block")[0].as_py(), Anchors(window)
        repeated = np.sort(merged(known.column("data"), "u8"))
        _, texts, ids = sorted_block(table)
        one, two, whose, ordinal, base = [], [], [], [], 0
        for a, b in chunks(texts):
            words, counts, at, keys = anchors.read(texts[a:b])
            start = anchors.candidates(counts, at, contained(keys, repeated))
            for held, made in zip((one, two), anchors.whole(words, start), strict=True):
                held.append(made)
            whose.append(np.repeat(ids[a:b], counts)[start])
            ordinal.append((start + base).astype(np.int64))
            base += len(words)
        if base > 1 << 32:
            raise ValueError("a block of more than 2**32 words: give more blocks")
        one, two, whose, ordinal = map(np.concatenate, (one, two, whose, ordinal))
        order = np.lexsort((ordinal, two, one))
        one, two, whose, ordinal = one[order], two[order], whose[order], ordinal[order]
        if len(one):
            first = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
            one, two, whose, ordinal = one[first], two[first], whose[first], ordinal[first]
        # a bucket's columns one after another, by document: ids in a row compress well
        low, bucket = two.astype(np.uint32), (one >> np.uint64(40)) % np.uint64(n)
        order = np.lexsort((ordinal, whose, bucket))
        columns = [c[order] for c in (one, low, whose, ordinal.astype(np.uint32))]
        cuts = np.searchsorted(bucket[order], np.arange(n + 1))
        rows = [
            (k, block, b"".join(c[cuts[k] : cuts[k + 1]].tobytes() for c in columns))
            for k in range(n)
            if cuts[k] < cuts[k + 1]
        ]
        return rows_of(to_bucket, rows)

    def first(table: pa.Table) -> pa.Table:
        parts: list[list[np.ndarray]] = [[], [], [], []]
        blobs = table.column("data").to_pylist()
        for blob in blobs:
            begin, count = 0, len(blob) // WINDOW_BYTES
            for part, kind in zip(parts, ("u8", "u4", "i8", "u4"), strict=True):
                part.append(np.frombuffer(blob, dtype=kind, count=count, offset=begin))
                begin += part[-1].nbytes
        one, two, whose, at = map(np.concatenate, parts)
        owner = np.repeat(table.column("__block").to_numpy(), [len(b) // WINDOW_BYTES for b in blobs])
        order = np.lexsort((at, owner, whose, two, one))
        one, two, at, owner = one[order], two[order], at[order], owner[order]
        lead = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
        at, owner = at[lead], owner[lead]
        order = np.argsort(owner, kind="stable")
        at, owner = at[order], owner[order]
        cuts = [0, *(np.flatnonzero(owner[1:] != owner[:-1]) + 1).tolist(), len(owner)]
        rows = [(int(owner[i]), 1, at[i:j].tobytes()) for i, j in zip(cuts, cuts[1:], strict=False)]
        return rows_of(to_block, rows)

    def decide(table: pa.Table, known: pa.Table) -> pa.Table:
        anchors = Anchors(window)
        kinds = known.column("kind").to_numpy() if known.num_rows else np.empty(0, dtype=np.int32)
        repeated = np.sort(merged(known.filter(pa.array(kinds == 0)).column("data"), "u8"))
        leads = np.sort(merged(known.filter(pa.array(kinds == 1)).column("data"), "u4")).astype(np.int64)
        table, texts, _ = sorted_block(table)
        masks, base = [], 0
        for a, b in chunks(texts):
            words, counts, at, keys = anchors.read(texts[a:b])
            start = anchors.candidates(counts, at, contained(keys, repeated))
            start = start[~contained(start + base, leads)]
            change = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(change, start, 1)
            np.add.at(change, start + window, -1)
            drop = np.cumsum(change[:-1]) > 0
            masks += np.split(drop, np.cumsum(counts)[:-1])
            base += len(words)
        out = finish(table, texts, masks)
        release()
        return out

    blocks_again = placed.groupBy("__block")
    shape = "bucket int, __block int, data binary"
    back = "__block int, kind int, data binary"
    repeated = placed.groupBy("__block").applyInArrow(lean(send), shape).groupBy("bucket").applyInArrow(lean(match), back)
    leads = (
        blocks_again.cogroup(repeated.groupBy("__block")).applyInArrow(extend, shape)
        .groupBy("bucket").applyInArrow(lean(first), back)
    )
    return placed.groupBy("__block").cogroup(repeated.union(leads).groupBy("__block")).applyInArrow(decide, out)


def repeat_digest(docs: DataFrame, window: int = 20, blocks: int | None = None) -> DataFrame:
    """Per document: numbers of words and of removed words, checksum of the kept words."""
    shape = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    )

    def finish(table: pa.Table, texts: list[bytes], masks: list[np.ndarray]) -> pa.Table:
        rows = []
        for text, mask in zip(texts, masks, strict=True):
            words = text.split()
            removed = int(mask.sum())
            kept = compress(words, (~mask).tolist()) if removed else words
            rows.append((len(words), removed, hashlib.sha256(b" ".join(kept)).hexdigest()))
        columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
        ids = table.column("doc_id").cast(pa.int64())
        return pa.table([ids, *[pa.array(c, type=f.type) for c, f in zip(columns, list(shape)[1:], strict=True)]],
                        schema=shape)

    few = docs.select("doc_id", "text")
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return _repeats(few, window, blocks, finish, out)


def drop_repeats(docs: DataFrame, window: int = 20, blocks: int | None = None) -> DataFrame:
    """``docs`` with all its columns; texts lose their repeated words, others stay byte for byte.

    A changed text is its kept words joined by a space; ``n_chars``, if there is
    one, is counted again.
    """

    if "__block" in docs.columns:  # the operator's own name
        other = "__block" + "_" * max(len(c) for c in docs.columns)
        return drop_repeats(docs.withColumnRenamed("__block", other), window, blocks).withColumnRenamed(other, "__block")
    names = docs.columns

    def finish(table: pa.Table, texts: list[bytes], masks: list[np.ndarray]) -> pa.Table:
        new = table.column("text").to_pylist()
        for i, (text, mask) in enumerate(zip(texts, masks, strict=True)):
            if mask.any():
                new[i] = b" ".join(compress(text.split(), (~mask).tolist())).decode()
        columns = {c: table.column(c) for c in names}
        columns["text"] = pa.array(new, type=table.schema.field("text").type)
        return pa.table([columns[c] for c in names], names=names)

    out = _repeats(docs, window, blocks, finish, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)

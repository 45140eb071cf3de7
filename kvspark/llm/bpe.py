"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list. For each merge rank there is a bucket of
list positions whose pair has that rank; a bitmap with one bit per rank, and
bitmaps over its words above it, tell the lowest rank that has a bucket
(find-first-set from the top down). The leftmost position of that bucket is
merged if its pair still has that rank, and skipped if it is stale. Buckets are
heaps of positions: a merge costs the logarithm of a bucket's size, however long the
pre-token is.

Text is cut before each space that has a non-space beside it: such a space always
starts a match of the pre-token pattern, so that the pieces can be encoded apart
and their ids kept per piece. Other texts go through the pattern as a whole.

Defined results: null text counts as empty and has no ids; repeated rows are
encoded each; very long texts and pre-tokens are encoded whole; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from kvspark.llm._common import by_rows, columns_as, worker_cache

#: White space as Unicode defines it, for a regex class.
SPACE = r"\t-\r \x85\xa0  -     　"
#: A text in which a cut at some space could fall inside a match.
BATCH = 4096
UNSAFE = re.compile(r" (?!\S)(?<!\S )")
#: Longer pieces and pre-tokens (in characters) aren't kept.
LONG = 64


def exact_pattern(pattern: str) -> regex.Pattern:
    """``pattern`` with white space spelled out, since libraries differ in the control characters."""
    spelled = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
    return regex.compile(spelled)


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token, a space, its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Pieces(dict):
    """Ids of pieces by their text without the space that starts them; others are encoded when asked for."""

    def __init__(self, own: ByteBPE, known: dict | None = None) -> None:
        super().__init__(known or {})
        self.own = own

    def __missing__(self, part: str) -> tuple[int, ...]:
        return self.own.whole(" " + part)


class ByteBPE:
    """Encoder and decoder for one rank table.

    The queue's bitmap has two levels: ``summary`` has a bit for each word of
    ``words`` that isn't zero, a word has a bit for each rank with a bucket; a
    word is as wide as the square root of the number of ranks.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, keep: int = 250_000) -> None:
        self.ranks, self.keep = ranks, keep
        self.pattern = exact_pattern(pattern)
        self.tokens = {i: token for token, i in ranks.items()}
        self.shift = (max(ranks.values()).bit_length() + 1) // 2
        self.numbers = list(range(max(ranks.values()) + 1))
        self.table = None
        self.bits = [1 << i for i in range(1 << self.shift)]
        self.words: dict[str, tuple[int, ...]] = {}
        self.old_words: dict[str, tuple[int, ...]] = {}
        self.pieces = Pieces(self)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one pre-token."""
        get = self.ranks.get
        whole = get(piece)
        if whole is not None:
            return (whole,)
        n, shift, bits = len(piece), self.shift, self.bits
        low = len(bits) - 1
        end, before = list(range(1, n + 2)), list(range(-1, n))  # of the node that starts here
        pair = [get(piece[i : i + 2], -1) for i in range(n - 1)]  # rank of the node with its right neighbour
        pair.append(-1)
        pair.append(-1)
        summary, words, buckets = 0, {}, {}
        for i, rank in enumerate(pair):
            if rank >= 0:
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    word = rank >> shift
                    words[word] = words.get(word, 0) | bits[rank & low]
                    summary |= bits[word]
        while summary:
            word = (summary & -summary).bit_length() - 1
            held = words[word]
            rank = (word << shift) + (held & -held).bit_length() - 1
            bucket = buckets[rank]
            i = bucket[0] if len(bucket) == 1 else heappop(bucket)
            if len(bucket) == 1 and bucket[0] == i:
                del buckets[rank]
                held &= held - 1
                words[word] = held
                if not held:
                    summary &= summary - 1
            if pair[i] != rank:
                continue  # stale
            right = end[i]
            stop = end[right]
            pair[right] = -1
            end[i] = stop
            before[stop] = i
            new = pair[i] = get(piece[i : end[stop]], -1) if stop < n else -1
            at = i
            left = before[i]
            for _ in (0, 1):
                if new >= 0:
                    if new in buckets:
                        heappush(buckets[new], at)
                    else:
                        buckets[new] = [at]
                        word = new >> shift
                        words[word] = words.get(word, 0) | bits[new & low]
                        summary |= bits[word]
                if left < 0 or at == left:
                    break
                at = left
                new = get(piece[left:stop], -1)
                pair[left] = new
        out, i = [], 0
        ranks = self.ranks
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def pair_table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ranks by the ids of a pair: a square of the single bytes, and sorted keys with their ranks."""
        ranks = self.ranks
        pairs = {
            ranks[t[:k]] << 32 | ranks[t[k:]]: i
            for t, i in ranks.items()
            for k in range(1, len(t))
            if t[:k] in ranks and t[k:] in ranks
        }
        keys = np.array(sorted(pairs), dtype=np.int64)
        single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        return single, keys, np.array([pairs[k] for k in keys.tolist()], dtype=np.int64)

    def merge_many(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of many pre-tokens, with one queue for all of them.

        A bucket is taken as a whole: its pairs are merged left to right (of
        overlapping pairs every other one) with numpy. Should a merge make a
        pair of a lower rank, which has to go before the rest of the bucket,
        that pre-token is encoded again on its own.
        """
        if self.table is None:
            self.table = self.pair_table()
        single, keys, values = self.table
        shift, low = self.shift, (1 << self.shift) - 1

        def rank_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            key = left << 32 | right
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            return np.where(keys[at] == key, values[at], -1)

        lengths = np.array([len(w) for w in words], dtype=np.int64)
        stops = np.cumsum(lengths)
        token = single[np.frombuffer(b"".join(words), dtype=np.uint8)]
        n = len(token)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[stops - 1] = before[stops - lengths] = -1
        pair = np.full(n, -1, dtype=np.int64)
        pair[:-1] = rank_of(token[:-1], token[1:])
        pair[stops - 1] = -1
        alive = np.ones(n, dtype=bool)
        summary, bitmap, buckets, redo = 0, {}, {}, []

        def push(at: np.ndarray, ranks: np.ndarray) -> None:
            nonlocal summary
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            for rank, a, b in zip(ranks[cuts[:-1]].tolist(), cuts, cuts[1:], strict=False):
                if rank in buckets:
                    buckets[rank].append(at[a:b])
                else:
                    buckets[rank] = [at[a:b]]
                    word = rank >> shift
                    bitmap[word] = bitmap.get(word, 0) | 1 << (rank & low)
                    summary |= 1 << word

        first = np.flatnonzero(pair >= 0)
        if len(first):
            push(first, pair[first])
        while summary:
            word = (summary & -summary).bit_length() - 1
            held = bitmap[word]
            rank = (word << shift) + (held & -held).bit_length() - 1
            bitmap[word] = held = held & (held - 1)
            if not held:
                summary &= summary - 1
            bucket = buckets.pop(rank)
            at = bucket[0] if len(bucket) == 1 else np.concatenate(bucket)
            at = at[pair[at] == rank]  # the others are stale
            if len(at) == 0:
                continue
            if len(at) > 1:
                at = np.unique(at)
                follows = np.concatenate([[False], after[at[:-1]] == at[1:]])
                if follows.any():
                    index = np.arange(len(at))
                    at = at[(index - np.maximum.accumulate(np.where(follows, 0, index))) % 2 == 0]
            right = after[at]
            stop = after[right]
            token[at], alive[right], pair[right], after[at] = rank, False, -1, stop
            inner = stop >= 0
            before[stop[inner]] = at[inner]
            left = before[at]
            pair[at] = -1
            some, left = at[inner], left[left >= 0]
            made = np.concatenate([rank_of(token[some], token[stop[inner]]), rank_of(token[left], token[after[left]])])
            some = np.concatenate([some, left])
            pair[some] = made
            good = made >= 0
            if good.any():
                some, made = some[good], made[good]
                if (made < rank).any():
                    redo.append(some[made < rank])
                push(some, made)
        ids = list(map(self.numbers.__getitem__, token[alive].tolist()))
        ends = np.cumsum(alive)[stops - 1].tolist()
        out = [tuple(ids[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
        if redo:
            for k in set(np.searchsorted(stops, np.concatenate(redo), side="right").tolist()):
                out[k] = self.merge(words[k])
        return out

    def learn(self, texts: list[str]) -> None:
        """Encode the new pre-tokens and pieces of ``texts`` together, so that ``encode`` finds them."""
        parts: set[str] = set()
        fresh: set[str] = set()
        for text in texts:
            if UNSAFE.search(text):
                fresh.update(self.pattern.findall(text))
            else:
                rest = text.split(" ")
                del rest[0]
                parts.update(rest)
        known, findall = self.pieces, self.pattern.findall
        found = {part: findall(" " + part) for part in parts if part not in known and len(part) <= LONG}
        for matches in found.values():
            fresh.update(matches)
        fresh -= self.words.keys()
        fresh -= self.old_words.keys()
        todo = [w for w in fresh if len(w) <= LONG]
        if len(self.words) + len(todo) > self.keep:
            self.old_words, self.words = self.words, {}
        if len(todo) >= 64:  # few are encoded one by one
            self.words.update(zip(todo, self.merge_many([w.encode() for w in todo]), strict=True))
        if len(known) + len(found) > self.keep:
            self.pieces = known = Pieces(self, {part: known[part] for part in parts if part in known})
        word, flat = self.word, chain.from_iterable
        for part, matches in found.items():
            known[part] = word(matches[0]) if len(matches) == 1 else tuple(flat(map(word, matches)))

    def word(self, match: str) -> tuple[int, ...]:
        """The ids of one match of the pattern; short ones are kept, in two generations."""
        ids = self.words.get(match)
        if ids is None:
            ids = self.old_words.get(match)
            if ids is None:
                ids = self.merge(match.encode())
            if len(match) <= LONG:
                if len(self.words) >= self.keep:
                    self.old_words, self.words = self.words, {}
                self.words[match] = ids
        return ids

    def whole(self, text: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.word, self.pattern.findall(text))))

    def encode(self, text: str) -> list[int]:
        if UNSAFE.search(text):
            return list(self.whole(text))
        head, *rest = text.split(" ")
        return list(chain(self.whole(head), chain.from_iterable(map(self.pieces.__getitem__, rest))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def encoder(path: str, pattern: str) -> ByteBPE:
    """The worker's encoder for a rank file, made once per worker."""
    return worker_cache(f"bpe:{path}:{pattern}", lambda: ByteBPE(load_ranks(path), pattern), large=True)


def bpe_encode(df: DataFrame, key: str, text: str, path: str, pattern: str) -> DataFrame:
    """key and ids (array of int) of each text."""
    few = columns_as(df, key=key, text=text)

    def make(batch: pa.RecordBatch) -> list:
        bpe = encoder(path, pattern)
        texts = [t or "" for t in batch.column("text").to_pylist()]
        bpe.learn(texts)
        return [[bpe.encode(t) for t in texts]]

    run = by_rows(make, ["ids"], [pa.list_(pa.int32())], ("key",), rows=BATCH, limit=1 << 24)
    return few.mapInArrow(run, f"key {few.schema['key'].dataType.simpleString()}, ids array<int>")


def bpe_decode(df: DataFrame, key: str, ids: str, path: str, pattern: str) -> DataFrame:
    """key and bytes (binary) of each array of ids; null ids give empty bytes."""
    few = columns_as(df, key=key, ids=ids)

    def make(batch: pa.RecordBatch) -> list:
        bpe = encoder(path, pattern)
        return [[bpe.decode(x or []) for x in batch.column("ids").to_pylist()]]

    run = by_rows(make, ["bytes"], [pa.binary()], ("key",), rows=BATCH, weigh="ids", limit=1 << 24)
    return few.mapInArrow(run, f"key {few.schema['key'].dataType.simpleString()}, bytes binary")


def bpe_digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode each whole text and decode the ids again; checksums of both."""
    few = columns_as(docs, doc_id="doc_id", text="text")

    def make(batch: pa.RecordBatch) -> list:
        bpe = encoder(path, pattern)
        shown = worker_cache(f"shown:{path}", lambda: {i: str(i) for i in bpe.tokens})
        sha: Callable = hashlib.sha256
        out: list[list] = [[], [], []]
        texts = [t or "" for t in batch.column("text").to_pylist()]
        bpe.learn(texts)
        for text in texts:
            ids = bpe.encode(text)
            out[0].append(len(ids))
            out[1].append(sha(" ".join(map(shown.__getitem__, ids)).encode()).hexdigest())
            out[2].append(sha(bpe.decode(ids)).hexdigest())
        return out

    run = by_rows(make, ["n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.string(), pa.string()],
                  ("doc_id",), rows=BATCH, limit=1 << 24)
    return few.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

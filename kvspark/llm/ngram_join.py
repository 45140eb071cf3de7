"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

Documents are rows, hashed word n-grams are columns. Two documents link when
den * overlap >= num * union of their sets. The product is never formed whole:

* Order. All n-grams have one order, rare ones first: by how often their counter
  was met, summed over all documents in the pass that also takes the sets' digests,
  then by hash. Any common order gives the same links; one by frequency keeps
  passages that many documents share out of the columns below. Counters follow the
  input's bytes up to 2 ** ``MOST_BITS``; where distinct n-grams far outnumber them
  only the more frequent passages stand out.
* Blocks. Two linked sets whose smaller one lies in a band of sizes (as wide as the
  bound) differ by d n-grams at most, d coming of the band. The band cuts the space of
  hashes into m > d segments, so that of the m parts of both sets at least m - d are
  equal, and among the first d + 1 parts of both, in any common order, one is. The order
  puts parts of many rare n-grams first. These parts are the columns; a set has those of
  its band and of the band before. By chance a single n-gram is soon in two texts, a
  part of several hardly, however large the table: the counters choose between parts,
  but blocks don't rest on them. Parts with an n-gram that no other row has aren't sent.
  Bounds below ``PARTED`` leave too few n-grams in a part; there the columns are
  n-grams: linked sets overlap by num / den of either's size, so that among the first
  size - ceil(num * size / den) + 1 n-grams of both one is common.
  The sets of a column, in order of size, are joined
  neighbour by neighbour while den * smaller >= num * larger: between two linked sets
  each step's ratio is at least theirs, so that none is lost, and a column of n sets
  gives n - 1 pairs at most. A task sends a set of each size of a column, the others
  it joins to that one itself. Connected pairs are a block, which holds every link.
* Product. Within a block the overlaps of all pairs of sets whose sizes are within
  the bound are accumulated over the n-grams, common ones as dense parts, the rest by
  postings; between the parts the pairs go whose overlap and rest are below the bound
  that follows from their sizes. Equal sets are one row. A block is cut by size into
  bands as wide as the bound; a unit is a band with the next one, which holds all
  links of its sets to larger ones. A unit of more than ``limit`` rows or
  ``PART_BYTES`` is multiplied part by part, each pair of parts in a task.
* For components alone (``keep_one``) a large unit is first compared with its first
  row, and only the rows that don't link to it are multiplied with all others.

Texts aren't shuffled but for those of blocks: a bitmap of the blocks' ids (``WORDS``
long words at most) drops the others first.

Defined results: null or empty text has an empty set, links with nothing and is its own component; a
null doc_id takes no part and has itself, null, as component; rows with one
doc_id are one node and each is returned; empty tables give empty results; extra
columns are ignored. Hashes of n-grams have 64 bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvspark.llm._common import input_bytes, lean, release, slices, worker_cache, written
from kvspark.llm._components import components
from kvspark.llm._words import BASES, U64, Hasher, chunks, mix, positions

SALTS = 16
#: Counters of n-grams: one for so many bytes of input, up to a power of two (a byte each is broadcast), in
#: slices that are summed apart, ``FAN`` tasks' at a time. A task tells so many n-grams' counters at once.
BYTES_A_COUNTER, LEAST_BITS, MOST_BITS, SLICE_BITS, FAN, TALLY = 8, 18, 25, 17, 256, 1 << 22
#: From this ratio on the columns are parts of sets; m is that many times d + 1.
PARTED, SEGMENTS = 0.75, 1.6
#: Of the input's files, for each bucket of columns.
BUCKET_BYTES = 16 << 20
#: Bytes of texts that are hashed at a time, and of columns that a task holds until it sends them: at least, at most, for a bucket.
HASHED, HELD = 1 << 18, (1 << 22, 1 << 24, 1 << 15)
#: The bitmap of ids has this many words of 64 bits.
WORDS = 1 << 20
LIMIT, PART_BYTES, SMALL_BYTES = 2048, 1 << 23, 1 << 20
#: So many rows of a product are compared by size at a time.
STRIP = 256
DENSE, NAMELESS, SEEN = 1024, 1 << 61, 200_000
LOWER = bytes(range(256)).lower()


class Sets:
    """The sets of n-gram hashes of texts."""

    def __init__(self, words: int) -> None:
        self.size = words
        self.hasher = worker_cache("hasher", Hasher)

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(sorted hashes text after text, number of each text)."""
        words, counts = self.hasher.words([t.translate(LOWER) for t in texts])
        place, left = positions(counts)
        total = place + left
        start = np.flatnonzero((left >= self.size) | ((place == 0) & (total < self.size)))
        run = np.minimum(total[start], self.size)
        keys = self.hasher.runs(words, start, start + run, BASES[1])
        short = run < self.size
        keys[short] = mix(keys[short] + run[short].astype(U64))
        whose = np.repeat(np.arange(len(texts)), counts)[start]
        order = np.lexsort((keys, whose))
        keys, whose = keys[order], whose[order]
        if len(keys):
            new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (whose[1:] != whose[:-1])])
            keys, whose = keys[new], whose[new]
        return keys, np.bincount(whose, minlength=len(texts)).astype(np.int64)


def sums_of(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each run of values, modulo 2**64."""
    total = np.concatenate([np.zeros(1, dtype=U64), np.cumsum(values, dtype=U64)])
    stops = np.cumsum(counts)
    return total[stops] - total[stops - counts]


def digests(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set."""
    x, y = (sums_of(mix(keys ^ U64(salt)), counts).view(np.int64) for salt in (0, 0xA5A5A5A5))
    return x, y


def counter_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix(keys) >> U64(64 - bits)).astype(np.uint32)


def planes(values: np.ndarray) -> bytes:
    """The bytes of integers plane by plane: small ones leave planes of zeros, which compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def unplanes(blob: bytes, n: int, dtype: str, offset: int) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    raw = np.frombuffer(blob, dtype=np.uint8, count=n * width, offset=offset).reshape(width, n)
    return np.ascontiguousarray(raw.T).view(dtype)[:, 0]


def sparse(at: np.ndarray, counts: np.ndarray) -> bytes:
    """Steps between sorted counters, and their counts."""
    return zlib.compress(planes(np.diff(at.astype(np.int64), prepend=0).astype("<u4")) + planes(counts.astype("<u4")), 1)


def add_sparse(total: np.ndarray, blob: bytes) -> None:
    blob = zlib.decompress(blob)
    n = len(blob) // 8
    at = np.cumsum(unplanes(blob, n, "<u4", 0).astype(np.int64))
    total[at] += unplanes(blob, n, "<u4", 4 * n)


def level_of(counts: np.ndarray) -> np.ndarray:
    """Eight steps for each doubling."""
    return np.minimum(255, np.log2(np.maximum(counts, 1)) * 8).astype(np.uint8)


def select(keys: np.ndarray, counts: np.ndarray, num: int, den: int, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, index of its document): the first of each set in the common order."""
    whose = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((mix(keys), levels[counter_of(keys, len(levels).bit_length() - 1)], whose))
    place = np.arange(len(keys)) - np.repeat(np.cumsum(counts) - counts, counts)
    take = place < np.repeat(counts - -(-num * counts // den) + 1, counts)
    return keys[order][take], whose[take]


def weights_of(levels: np.ndarray) -> np.ndarray:
    """The weight of each level in a part's rank: full up to somewhat above the middle one, then by the count's inverse."""
    by = sum(np.bincount(levels[i : i + (1 << 20)], minlength=256) for i in range(0, len(levels), 1 << 20))  # makes longs
    middle = int(np.searchsorted(np.cumsum(by), len(levels) / 2))
    above = np.maximum(np.arange(256) - middle - 4, 0)
    return np.maximum(np.round(256 * 2.0 ** (-above / 8)), 1).astype(np.int64)


def bands_to(most: int, num: int, den: int) -> np.ndarray:
    """The least size of each band, up to the one after next to that of ``most``: sets that link are of one band or of
    neighbouring ones."""
    least = [1]
    while len(least) < 3 or least[-3] <= most:
        least.append(least[-1] * den // num + 1)
    return np.array(least, dtype=np.int64)


def parts_of(
    keys: np.ndarray, counts: np.ndarray, num: int, den: int, levels: np.ndarray, weights: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(hash of a part, index of its document): those of the first d + 1 parts of each set, by its band and by
    the band before, that may be another row's too. ``keys`` are sorted in each document; no set is empty."""
    if len(keys) == 0:
        return np.empty(0, dtype=U64), np.empty(0, dtype=np.int64)
    level = levels[counter_of(keys, len(levels).bit_length() - 1)]
    single, weight = np.concatenate([[0], np.cumsum(level == 0)]), np.concatenate([[0], np.cumsum(weights[level])])
    total = np.concatenate([np.zeros(1, dtype=U64), np.cumsum(mix(keys), dtype=U64)])
    whose = np.repeat(np.arange(len(counts)), counts)
    least = bands_to(int(counts.max()), num, den)
    own = np.searchsorted(least, counts, side="right") - 1
    signs, owners = [], []
    for band in (own, own - 1):
        d = (least[band + 1] - 1) * (den - num) // num  # band -1: left out below
        m = ((d + 1) * SEGMENTS).astype(U64)
        segment = ((keys >> U64(32)) * m[whose]) >> U64(32)
        start = np.flatnonzero(np.concatenate([[True], (segment[1:] != segment[:-1]) | (whose[1:] != whose[:-1])]))
        stop = np.append(start[1:], len(keys))
        owner = whose[start]
        place = (band[owner].astype(U64) << U64(32)) + segment[start]
        sign = mix((total[stop] - total[start]) ^ mix(place))
        alone = single[stop] > single[start]
        order = np.lexsort((sign, weight[start] - weight[stop], ~alone, owner))
        held = np.bincount(owner, minlength=len(counts))
        rank = np.arange(len(order)) - np.repeat(np.cumsum(held) - held, held)
        order = order[(rank <= d[owner]) & ~alone[order] & (band[owner] >= 0)]
        signs.append(sign[order])
        owners.append(owner[order])
        # what two such sets have in common may be segments without n-grams only
        few = np.flatnonzero((held <= d) & (band >= 0))
        signs.append(mix(~band[few].astype(U64)))
        owners.append(few)
    return np.concatenate(signs), np.concatenate(owners)


PAIR = np.dtype([("s", "u8"), ("id", "i8"), ("n", "u4")])


def packed(data: np.ndarray) -> bytes:
    """Columns, steps between the sorted ids, and sizes, byte by byte (the upper bytes are zeros)."""
    data = data[np.argsort(data["id"], kind="stable")]
    steps = np.diff(data["id"].astype(np.int64), prepend=0).astype(np.int64)
    return planes(data["s"].copy()) + planes(steps) + planes(data["n"].copy())


def unpacked(blob: bytes) -> np.ndarray:
    n = len(blob) // PAIR.itemsize
    data = np.empty(n, dtype=PAIR)
    data["s"] = unplanes(blob, n, "<u8", 0)
    data["id"] = np.cumsum(unplanes(blob, n, "<i8", 8 * n))
    data["n"] = unplanes(blob, n, "<u4", 16 * n)
    return data


def in_order(data: np.ndarray) -> np.ndarray:
    return data[np.lexsort((data["id"], data["n"], data["s"]))]


def stars(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(smallest, id) for each id that pairs connect with a smaller one: the same components by fewer, shorter links."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(ids))
    while len(u):  # roots take the least root that they meet, then every path is cut short
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root[root] != root).any():
            root = root[root]
        u, v = root[u], root[v]
        apart = u != v
        u, v = u[apart], v[apart]
    return np.stack([ids[root], ids], axis=1)[root != np.arange(len(ids))]


def same_size(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one row for each column and size, links that join the others to it); ``data`` is in order."""
    new = np.concatenate([[True], (data["s"][1:] != data["s"][:-1]) | (data["n"][1:] != data["n"][:-1])])
    lead = data["id"][np.flatnonzero(new)][np.cumsum(new) - 1]
    return data[new], stars(lead[~new], data["id"][~new])


def neighbours(data: np.ndarray, num: int, den: int) -> np.ndarray:
    """Pairs of the sets that stand beside each other in a column and whose sizes allow a link."""
    data = in_order(data)
    size = data["n"].astype(np.int64)
    near = (data["s"][1:] == data["s"][:-1]) & (den * size[:-1] >= num * size[1:])
    return np.stack([data["id"][:-1][near], data["id"][1:][near]], axis=1)


def texts_of(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, num: int, den: int) -> np.ndarray:
    """Whether each set of ``left`` links to each of ``right`` (None: of ``left``).

    Columns that many of both have are multiplied densely, the others by postings.
    Pairs are discarded as soon as what they may still have in common is too little.
    """
    alone = right is None
    size = [np.array([len(s) for s in part], dtype=np.int64) for part in ((left,) if alone else (left, right))]
    _, codes = np.unique(np.concatenate(left if alone else [*left, *right]), return_inverse=True)
    codes = codes.astype(np.int32)
    own = [codes[: size[0].sum()], codes if alone else codes[size[0].sum() :]]
    size = [size[0], size[-1]]
    alive = np.empty((len(size[0]), len(size[1])), dtype=bool)
    need = np.empty(alive.shape, dtype=np.float32)
    for at in range(0, len(alive), STRIP):
        n = size[0][at : at + STRIP, None]
        alive[at : at + STRIP] = den * np.minimum(n, size[1]) >= num * np.maximum(n, size[1])
        need[at : at + STRIP] = -(-num * (n + size[1]) // (num + den))
    overlap = np.zeros(alive.shape, dtype=np.float32)
    whose = [np.repeat(np.arange(len(n), dtype=np.int32), n) for n in size]
    met = np.prod([np.bincount(c, minlength=codes.max() + 1) for c in own], axis=0)
    place = np.full(len(met), -1)
    dense = np.flatnonzero(met > max(64, overlap.size // 32))
    place[dense] = np.arange(len(dense))
    # columns of one side only add nothing, but still stand in the way of a link
    rest = [np.bincount(w[met[c] > 0], minlength=len(n)) for c, w, n in zip(own, whose, size, strict=True)]

    def discard() -> None:
        for at in range(0, len(alive), STRIP):
            part = slice(at, at + STRIP)
            alive[part] &= overlap[part] + np.minimum(rest[0][part, None], rest[1]) >= need[part]

    discard()
    for first in range(0, len(dense), DENSE):
        if not alive.any():
            return alive
        sides = []
        for k, (c, w, n) in enumerate(zip(own, whose, size, strict=True)):
            take = (place[c] >= first) & (place[c] < first + DENSE)
            side = np.zeros((len(n), DENSE), dtype=np.float32)
            side[w[take], place[c][take] - first] = 1
            rest[k] = rest[k] - np.bincount(w[take], minlength=len(n))
            sides.append(side)
        overlap += sides[0] @ sides[1].T
        discard()
    thin = [(place[c] < 0) & (met[c] > 0) for c in own]
    order = np.argsort(own[1][thin[1]], kind="stable")
    keys, holder = own[1][thin[1]][order], whose[1][thin[1]][order]
    mine, row = own[0][thin[0]], whose[0][thin[0]]
    low, high = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
    first = np.searchsorted(row, np.arange(len(left) + 1), "left")
    for r in np.flatnonzero(alive.any(axis=1)).tolist():
        a, z = first[r], first[r + 1]
        if a == z:
            continue
        n = high[a:z] - low[a:z]
        take = holder[np.repeat(low[a:z] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        overlap[r] += np.bincount(take[alive[r][take]], minlength=len(size[1]))
    alive &= overlap >= need
    return alive


def groups_of(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the components of a bipartite graph: of its rows, of its columns (-1: alone)."""
    rows, columns = np.full(found.shape[0], -1), np.full(found.shape[1], -1)
    for r in range(len(rows)):
        if rows[r] >= 0:
            continue
        rows[r], reached = r, np.array([r])
        while len(reached):
            new = np.flatnonzero(found[reached].any(axis=0) & (columns < 0))
            columns[new] = r
            reached = np.flatnonzero(found[:, new].any(axis=1) & (rows < 0))
            rows[reached] = r
    return rows, columns


def _counted(docs: DataFrame, words: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, x, y for each row; level of each counter), from one pass over the texts."""
    names = ["doc_id", "n", "x", "y", "part", "slice", "data"]
    bits = min(MOST_BITS, max(LEAST_BITS, (input_bytes(docs) // BYTES_A_COUNTER).bit_length()))

    def rows_of(columns: dict, n: int, ids: pa.Array | None = None) -> pa.RecordBatch:
        kinds = [pa.int64()] * 5 + [pa.int32(), pa.binary()]
        made = [pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([ids if ids is not None else made[0], *made[1:]], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, held, size, part = Sets(words), [], 0, TaskContext.get().partitionId()

        def told() -> pa.RecordBatch:
            at, counts = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(at, np.arange(0, (1 << bits) + 1, 1 << SLICE_BITS))
            own = np.flatnonzero(cuts[1:] > cuts[:-1]).tolist()
            data = [sparse(at[cuts[s] : cuts[s + 1]] - (s << SLICE_BITS), counts[cuts[s] : cuts[s + 1]]) for s in own]
            return rows_of({"part": [part] * len(own), "slice": own, "data": data}, len(own))

        for batch in (part for whole in batches for part in slices(whole)):
            texts, columns = texts_of(batch), [[], [], []]
            for a, b in chunks(texts, HASHED):
                keys, counts = sets.read(texts[a:b])
                held.append(counter_of(keys, bits))
                size += len(keys)
                if size > TALLY:
                    yield told()
                    held, size = [], 0
                for column, made in zip(columns, (counts, *digests(keys, counts)), strict=True):
                    column.append(made)
            made = [np.concatenate(c) if c else np.empty(0, dtype=np.int64) for c in columns]
            yield rows_of(dict(zip("nxy", made, strict=True)), batch.num_rows, batch.column("doc_id"))
        if held:
            yield told()
        del held
        release()

    def summed(last: bool) -> Callable:
        """Adds the counters of a group; at ``last`` it tells their levels. A second Python operator in the stage would
        keep another worker for each task."""

        def add(table: pa.Table) -> pa.Table:
            total = np.zeros(1 << SLICE_BITS, dtype=np.uint64)
            for blob in table.column("data").to_pylist():
                add_sparse(total, blob)
            if last:
                levels = np.where(total > 1, np.maximum(level_of(total), 1), 0)  # 0: in one row only
                told = zlib.compress(levels.astype(np.uint8).tobytes(), 1)
            else:
                at = np.flatnonzero(total)
                told = sparse(at, np.minimum(total[at], np.iinfo(np.uint32).max))
            return pa.table([pa.array([table.column("part")[0].as_py()], pa.int64()), pa.array([table.column("slice")[0].as_py()], pa.int32()), pa.array([told], pa.binary())], names=names[4:])

        return add

    shape = "doc_id long, n long, x long, y long, part long, slice int, data binary"
    made = written(docs.mapInArrow(read, shape), "profile")
    told = made.where("slice is not null").select("part", "slice", "data")
    parts = (told.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        parts = -(-parts // FAN)
        told = told.withColumn("part", F.col("part") % parts).groupBy("slice", "part").applyInArrow(summed(parts == 1), "part long, slice int, data binary")
        if parts == 1:
            break
    levels = np.zeros((1 << (bits - SLICE_BITS), 1 << SLICE_BITS), dtype=np.uint8)
    for row in told.select("slice", "data").collect():  # a row for each slice
        levels[row["slice"]] = np.frombuffer(zlib.decompress(row["data"]), dtype=np.uint8)
    return made.where("slice is null").select("doc_id", "n", "x", "y"), levels.reshape(-1)


def _pairs(docs: DataFrame, words: int, num: int, den: int, levels: np.ndarray) -> DataFrame:
    """a, b: ids of sets that neighbours in columns connect, as stars of the smallest ids of a bucket of columns."""
    spark = docs.sparkSession
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(docs) // BUCKET_BYTES)
    held_levels = spark.sparkContext.broadcast(levels)  # a byte for each counter
    weights = weights_of(levels) if num >= PARTED * den else None
    most = min(HELD[1], max(HELD[0], HELD[2] * buckets))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        sets, seen, held, size, levels = Sets(words), set(), [], 0, held_levels.value

        def flush() -> pa.RecordBatch:
            data, pairs = same_size(in_order(np.concatenate(held)))
            bucket = ((data["s"] >> U64(8)) % U64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = [(b, packed(data[order[cuts[b] : cuts[b + 1]]]), None) for b in range(buckets) if cuts[b] < cuts[b + 1]]
            deal = pairs[:, 1] % buckets
            rows += [(b, None, pairs[deal == b].astype("<i8").tobytes()) for b in np.unique(deal).tolist()]
            kinds = [pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "data", "pairs"])

        for batch in (part for whole in batches for part in slices(whole)):
            texts = texts_of(batch)
            ids = np.array(batch.column("doc_id").fill_null(0), dtype=np.int64)
            null = np.array(batch.column("doc_id").is_null(), dtype=bool)
            for a, b in chunks(texts, HASHED):
                keys, counts = sets.read(texts[a:b])
                use = (counts > 0) & ~null[a:b]
                for i, h in enumerate(digests(keys, counts)[0].tolist()):
                    if use[i] and h in seen:
                        use[i] = False
                    elif use[i]:
                        seen.add(h)
                if len(seen) > SEEN:  # equal sets that are sent again only meet again
                    seen.clear()
                own, n = keys[np.repeat(use, counts)], counts[use]
                signs, owner = select(own, n, num, den, levels) if weights is None else parts_of(own, n, num, den, levels, weights)
                data = np.empty(len(signs), dtype=PAIR)
                signs &= U64((1 << 48) - 1)  # columns that fall together only make blocks larger
                data["s"], data["n"], data["id"] = signs, counts[use][owner], ids[a:b][use][owner]
                held.append(data)
                size += data.nbytes
                if size > most:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()
        del held, seen, levels
        release()

    def meet(table: pa.Table) -> pa.Table:
        data = [unpacked(b) for b in table.column("data").to_pylist() if b]
        pairs = [np.frombuffer(b, dtype="<i8").reshape(-1, 2) for b in table.column("pairs").to_pylist() if b]
        if data:
            pairs.append(neighbours(np.concatenate(data), num, den))
        rows = stars(*np.concatenate(pairs).T)
        deal = rows[:, 1] % buckets  # by the larger id: the smallest is that of many
        own = np.unique(deal).tolist()
        return pa.table({"bucket": pa.array(own, pa.int32()), "pairs": pa.array([rows[deal == b].astype("<i8").tobytes() for b in own], pa.binary())})

    def once(table: pa.Table) -> pa.Table:
        rows = np.unique(np.frombuffer(b"".join(table.column("pairs").to_pylist()), dtype="<i8").reshape(-1, 2), axis=0)
        return pa.table({"a": pa.array(rows[:, 0]), "b": pa.array(rows[:, 1])})

    # copies meet in most buckets, and each tells them as a star of the same smallest id: links travel packed
    # and are told once, and their components take few rounds
    signed = docs.mapInArrow(sign, "bucket int, data binary, pairs binary")
    met = signed.groupBy("bucket").applyInArrow(lean(meet), "bucket int, pairs binary")
    return met.groupBy("bucket").applyInArrow(once, "a long, b long")


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` joined with ``ids`` on doc_id; a bitmap of the ids keeps other texts from being shuffled."""
    word, bit = F.expr(f"pmod(xxhash64(doc_id), {64 * WORDS}) div 64"), F.expr("shiftleft(1L, cast(pmod(xxhash64(doc_id), 64) as int))")
    bitmap = ids.select(word.alias("__w"), bit.alias("__b")).groupBy("__w").agg(F.bit_or("__b").alias("__bits"))
    few = docs.withColumn("__w", word).join(F.broadcast(bitmap), "__w")  # WORDS rows at most
    few = few.where(F.col("__bits").bitwiseAND(bit) != 0).drop("__w", "__bits")
    return few.join(ids.hint("merge"), "doc_id")


def _groups(
    docs: DataFrame, words: int, num: int, den: int, limit: int, counted: bool
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(profile, components, links).

    profile: doc_id, n, x, y (size and digests of the set), rep (smallest doc_id with
    an equal set, null for empty sets), a row for each row of ``docs``. components:
    a, b for each rep that isn't the smallest of its component, and that smallest.
    links, if ``counted``: n, x, y and linked, the rows that link to the set, those
    with the set itself among them; sets of one row that link to no other may be absent.
    """
    few = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    read, levels = _counted(few, words)
    # classes of one row need no join; the others are joined salted, as one may hold a third of all rows
    real = read.where("n > 0 and doc_id is not null")
    classes = real.groupBy("n", "x", "y").agg(F.min("doc_id").alias("least"), F.count("*").alias("c"))
    classes = written(classes.where("c > 1"), "classes")
    equal = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).drop("c")
    salted = read.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    rep = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.coalesce("least", "doc_id")).alias("rep")
    of = written(salted.join(equal, ["n", "x", "y", "salt"], "left").select("doc_id", "n", "x", "y", rep), "reps")
    # rows with one doc_id are one node: their reps are tied
    named = of.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("rep"), F.max("rep").alias("top"))
    moved = written(named.where("rep != doc_id or rep != top"), "moved")
    tied = of.join(moved.where("rep != top").select("doc_id", F.col("rep").alias("b")), "doc_id")
    tied = tied.select(F.col("rep").alias("a"), "b").where("a != b").distinct()
    shared = _pairs(few, words, num, den, levels)
    for c in ("a", "b"):
        own = moved.select(F.col("doc_id").alias(c), "rep")
        other = "b" if c == "a" else "a"
        shared = shared.join(own, c, "left").select(F.coalesce("rep", c).alias(c), other)
    tied = written(tied, "tied")
    blocks = components(shared.select("a", "b").where("a != b").union(tied))
    block = blocks.union(blocks.select(F.col("b").alias("a"), "b").distinct()).toDF("doc_id", "block")
    sets = of.where("doc_id = rep").select("doc_id", "n", "x", "y").distinct()
    sets = sets.join(classes.drop("least"), ["n", "x", "y"], "left").join(block, "doc_id")
    band = F.floor(F.log("n") / F.lit(max(log(den / num), 1e-6) * (1 + 1e-9))).cast("int")
    sets = written(sets.withColumn("c", F.coalesce("c", F.lit(1))).withColumn("unit", band), "sets")
    size = _units(sets, limit)
    lines = _lines(few, sets, size, words)
    if counted:
        told = written(_products(lines, size, num, den, True), "product")
        links = classes.join(told.groupBy("n", "x", "y").agg(F.sum("linked").alias("linked")), ["n", "x", "y"], "full_outer")
        links = links.select("n", "x", "y", (F.coalesce("linked", F.lit(0)) + F.coalesce("c", F.lit(1))).alias("linked"))
        return of, components(told.select("a", "b").where("a != b").union(tied)), links
    if size.where("parts > 1").limit(1).count():
        lines = written(lines, "lines")
        joined = _products(lines.where("parts = 1"), size, num, den, False).select("a", "b").where("a != b")
        joined = joined.union(_large_units(lines.where("parts > 1"), limit, num, den))
    else:
        joined = _products(lines, size, num, den, False).select("a", "b").where("a != b")
    return of, components(joined.union(tied)), None


def _units(sets: DataFrame, limit: int) -> DataFrame:
    """block, unit, bytes, parts. A unit has the sets of a band of sizes (its low ones) and of
    the next band: linked sets are of one band or of neighbouring ones."""
    own = sets.groupBy("block", "unit").agg(F.count("*").alias("rows"), (8 * F.sum("n")).alias("bytes"))
    own = written(own, "bands")
    over = own.select("block", (F.col("unit") - 1).alias("unit"), F.col("rows").alias("more"), F.col("bytes").alias("wide"))
    both = own.join(over, ["block", "unit"], "left").na.fill(0, ["more", "wide"])
    both = both.select("block", "unit", (F.col("rows") + F.col("more")).alias("rows"), (F.col("bytes") + F.col("wide")).alias("bytes"))
    parts = F.ceil(F.greatest(F.col("rows") / F.lit(limit), F.col("bytes") / F.lit(PART_BYTES))).cast("int")
    return written(both.where("rows > 1").select("block", "unit", "bytes", parts.alias("parts")), "units")


UNIT = ["block", "unit", "low", "bytes", "parts", "doc_id", "c", "n", "x", "y", "data"]
UNIT_SHAPE = "block long, unit int, low boolean, bytes long, parts int, doc_id long, c long, n long, x long, y long, data binary"


def _lines(docs: DataFrame, sets: DataFrame, size: DataFrame, words: int) -> DataFrame:
    """The columns ``UNIT``: a row for each set and unit that it is in, with its sorted hashes."""
    dealt = sets.withColumn("low", F.explode(F.array(F.lit(True), F.lit(False))))
    dealt = dealt.withColumn("unit", F.when(F.col("low"), F.col("unit")).otherwise(F.col("unit") - 1)).join(size, ["block", "unit"])
    # an id that is the smallest of many sets brings their digests along one by one
    several = dealt.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 2").select("doc_id")
    few = dealt.join(several, "doc_id", "left_anti")
    ids = few.groupBy("doc_id").agg(F.collect_list(F.struct(*[c for c in UNIT if c not in ("doc_id", "data")])).alias("at"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text's set, once for each of its places; rows of an id with another set than the told one go."""
        reader = Sets(words)
        for batch in (part for whole in batches for part in slices(whole)):
            texts, places, names, rows = texts_of(batch), batch.column("at").to_pylist(), batch.column("doc_id").to_pylist(), []
            for a, b in chunks(texts, HASHED):
                keys, counts = reader.read(texts[a:b])
                x, y = (d.tolist() for d in digests(keys, counts))
                for i, stop in enumerate(np.cumsum(counts).tolist()):
                    mine = keys[stop - counts[i] : stop].tobytes()
                    told = places[a + i] if places[a + i] is not None else [{"n": int(counts[i]), "x": x[i], "y": y[i]}]
                    for at in told:
                        if counts[i] and at["n"] == counts[i] and at["x"] == x[i] and at["y"] == y[i]:
                            rows.append((*[at.get(c) for c in UNIT[:5]], names[a + i], at.get("c"), at["n"], x[i], y[i], mine))
            columns = list(zip(*rows, strict=True)) or [[]] * len(UNIT)
            kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=UNIT)

    lines = _texts_of(docs, ids).select("doc_id", "at", "text").mapInArrow(hashed, UNIT_SHAPE)
    if several.limit(1).count():
        nowhere = several.withColumn("at", F.lit(None).cast(ids.schema["at"].dataType))
        rest = _texts_of(docs, nowhere).select("doc_id", "at", "text").mapInArrow(hashed, UNIT_SHAPE)
        rest = rest.select("doc_id", "n", "x", "y", "data").join(dealt, ["doc_id", "n", "x", "y"])
        lines = lines.unionByName(rest.select(*UNIT))
    return lines


def _products(lines: DataFrame, size: DataFrame, num: int, den: int, counted: bool) -> DataFrame:
    """a, b, n, x, y, linked for each set of each pair of parts of a unit.

    b: the smallest id that a is connected with there; linked: the rows of other sets that
    link to the set there. Units of a few bytes share groups. If not ``counted``, links among
    a unit's high sets, which are found in the next unit, may be told too.
    """
    spark = lines.sparkSession
    small = (F.col("parts") == 1) & (F.col("bytes") <= SMALL_BYTES)
    total = size.where(small).agg(F.sum("bytes")).first()[0] or 0
    bins = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (8 * SMALL_BYTES) + 1)
    dealt = lines.withColumn("own", F.pmod(F.xxhash64("x", "y"), "parts").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        F.when(small, -1 - F.pmod(F.xxhash64("block", "unit"), F.lit(bins))).otherwise(F.col("block")).alias("g"),
        F.when(~small, F.col("unit")).alias("u"), F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"),
        "block", "unit", "low", "own", "doc_id", "n", "x", "y", "c", "data",
    )
    names = ["a", "b", "n", "x", "y", "linked"]

    def multiply(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), ("unit", "ascending"), ("doc_id", "ascending")])
        columns = [table.column(c).to_numpy() for c in ("doc_id", "n", "x", "y", "c")]
        first = table.column("own").to_numpy() == table.column("p").to_numpy()
        low = table.column("low").to_numpy()
        alone = table.column("p")[0].as_py() == table.column("q")[0].as_py()
        sets = [np.frombuffer(b, dtype=U64) for b in table.column("data").to_pylist()]
        block, unit = table.column("block").to_numpy(), table.column("unit").to_numpy()
        new = (block[1:] != block[:-1]) | (unit[1:] != unit[:-1])
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(block)]
        made = [_unit_links(np.arange(i, j), sets, columns, first, low, alone, num, den) for i, j in zip(cuts, cuts[1:], strict=False)]
        rows = np.concatenate(made)
        return pa.table({c: pa.array(rows[:, i]) for i, c in enumerate(names)})

    return dealt.groupBy("g", "u", "p", "q").applyInArrow(lean(multiply), ", ".join(f"{c} long" for c in names))


def _unit_links(
    rows: np.ndarray, sets: list, columns: list, first: np.ndarray, low: np.ndarray, alone: bool, num: int, den: int
) -> np.ndarray:
    """The rows that ``_products`` tells of one pair of parts; ``rows`` are ordered by id."""
    ids, n, x, y, c = columns
    lead: dict[tuple, int] = {}
    rows = np.array([i for i in rows.tolist() if lead.setdefault((n[i], x[i], y[i]), i) == i])  # repeated rows once
    left = rows[first[rows]]
    right = left if alone else rows[~first[rows]]
    if len(left) == 0 or len(right) == 0:
        return np.empty((0, 6), dtype=np.int64)
    found = linked([sets[i] for i in left], None if alone else [sets[i] for i in right], num, den)
    found &= low[left][:, None] | low[right]
    own, other = groups_of(found)
    least = np.full(len(left), np.iinfo(np.int64).max)
    np.minimum.at(least, own, ids[left])
    np.minimum.at(least, other[other >= 0], ids[right][other >= 0])
    told = np.concatenate([found[i : i + STRIP] @ c[right] for i in range(0, len(left), STRIP)])
    if alone:  # a set's own rows are counted once, not by unit: it may be the only one of its band
        told = told - found.diagonal() * c[left]
    sides = [(left, least[own], told)]
    if not alone:
        told = np.concatenate([c[left] @ found[:, i : i + STRIP] for i in range(0, len(right), STRIP)])
        sides.append((right, np.where(other >= 0, least[other], ids[right]), told))
    out = np.concatenate([np.stack([ids[s], b, n[s], x[s], y[s], k], axis=1) for s, b, k in sides]).astype(np.int64)
    return out[(out[:, 0] != out[:, 1]) | (out[:, 5] > 0)]


def _large_units(large: DataFrame, limit: int, num: int, den: int) -> DataFrame:
    """a, b: links that connect all that is linked within units of several parts."""
    key = ["block", "unit"]
    dealt = large.withColumn("slice", F.pmod(F.xxhash64("doc_id"), "parts").cast("int"))
    first = large.where("low").groupBy(*key, "parts").agg(F.min("doc_id").alias("lead"), F.min_by("data", "doc_id").alias("head"))
    first = first.select(*key, "lead", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("slice"), "head")
    names = [*key, "slice", "parts", "doc_id", "lead", "data"]
    shape = "block long, unit int, slice int, parts int, doc_id long, lead long, data binary, star boolean"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            star = []
            for mine, head in zip(batch.column("data").to_pylist(), batch.column("head").to_pylist(), strict=True):
                a, b = np.frombuffer(mine, dtype=U64), np.frombuffer(head, dtype=U64)
                overlap = len(np.intersect1d(a, b, assume_unique=True))
                star.append(den * overlap >= num * (len(a) + len(b) - overlap))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(star, pa.bool_())], names=[*names, "star"])

    compared = written(dealt.join(first, [*key, "slice"]).mapInArrow(compare, shape), "compared")
    star = compared.where("star and doc_id != lead").select(F.col("doc_id").alias("a"), F.col("lead").alias("b"))
    loose = compared.where("not star")
    apart = loose.groupBy(*key).agg(F.count("*").alias("loose"), F.sum(F.octet_length("data")).alias("bytes"))
    turns = F.ceil(F.greatest(F.col("loose") / F.lit(limit), F.col("bytes") / F.lit(PART_BYTES))).cast("int")
    apart = apart.select(*key, turns.alias("turns"))
    rows = loose.join(apart, key).select(
        *key, F.pmod(F.hash("doc_id"), "turns").cast("int").alias("turn"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("slice"), "doc_id", "data", F.lit(True).alias("row"),
    )
    columns = compared.join(apart, key).select(
        *key, F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "slice", "doc_id", "data", F.lit(False).alias("row")
    )

    def multiply(table: pa.Table) -> pa.Table:
        ids, own = table.column("doc_id").to_numpy(), table.column("row").to_numpy(zero_copy_only=False)
        sets = [np.frombuffer(b, dtype=U64) for b in table.column("data").to_pylist()]
        left, right = np.flatnonzero(own), np.flatnonzero(~own)
        a, b = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        if len(left) and len(right):
            rows, columns = groups_of(linked([sets[i] for i in left], [sets[i] for i in right], num, den))
            lead = ids[left]
            a = np.concatenate([lead, ids[right][columns >= 0]])
            b = np.concatenate([lead[rows], lead[columns[columns >= 0]]])
        return pa.table({"a": pa.array(a[a != b], pa.int64()), "b": pa.array(b[a != b], pa.int64())})

    crossed = rows.union(columns).groupBy(*key, "turn", "slice").applyInArrow(lean(multiply), "a long, b long")
    return star.union(crossed)


def _labelled(of: DataFrame, joined: DataFrame) -> DataFrame:
    """``of`` with component_id."""
    joined = joined.select(F.col("a").alias("rep"), F.col("b").alias("__least"))
    return of.join(joined, "rep", "left").withColumn("component_id", F.coalesce("__least", "rep", "doc_id"))


def jaccard_components(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row."""
    of, joined, _ = _groups(docs, words, num, den, limit, False)
    return _labelled(of, joined).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def jaccard_links(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for each row.

    n_links: the other rows that link to it, exact copies among them; 0 for an empty
    set, null for a null doc_id.
    """
    of, joined, links = _groups(docs, words, num, den, limit, True)
    links = links.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = of.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    out = _labelled(out.join(links, ["n", "x", "y", "salt"], "left"), joined)
    told = F.when(F.col("rep").isNotNull(), F.coalesce("linked", F.lit(1)) - 1).when(F.col("doc_id").isNotNull(), 0)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", told.cast("long").alias("n_links"))


def keep_one(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10, limit: int = LIMIT, nameless: bool = False) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group, one for each doc_id and text.

    Rows without a doc_id or words stay. If ``nameless``, rows with words and no doc_id
    are compared too, under surrogate ids past all others that come of their texts.
    """
    own = docs["doc_id"].cast("long")
    if nameless:
        past = F.xxhash64("text").bitwiseAND(F.lit(NAMELESS - 1)) + F.lit(NAMELESS)
        own = F.coalesce(own, F.when(docs["text"].rlike(r"[^\x20\x09-\x0D]"), past))
    named = docs.withColumn("__id", own)
    groups = jaccard_components(named.select(F.col("__id").alias("doc_id"), "text"), words, num, den, limit)
    groups = groups.where("doc_id is not null and doc_id != component_id").select(F.col("doc_id").alias("__id")).distinct()
    left = named.join(groups, "__id", "left_anti")
    # only ids of several rows have their texts compared
    several = named.where("__id is not null").groupBy("__id").agg(F.count("*").alias("__n")).where("__n > 1").select("__id")
    once = left.join(several, "__id", "left_anti")
    return once.unionByName(left.join(several, "__id", "left_semi").dropDuplicates(["__id", "text"])).select(*docs.columns)

"""Approximate nearest neighbours by a robust-pruned directed graph in each shard.

Equal vectors form one class. Classes are dealt by hash to shards of about
``per_shard`` classes; in each shard a graph is built in two passes: a greedy
search over the graph so far proposes neighbours of a node, and relaxed distance
pruning keeps one only if no kept one is ``alpha`` times nearer to it than the
node is; reverse edges are added and pruned alike. A query searches the graph of
every shard with a beam, rescores its beam in double precision, and the shards'
best rows are merged. Every row is indexed; nothing is left to a cap: a class
keeps as many of its smallest ids as a result can hold.

Nearness is the largest inner product. The graph works on vectors with one more
component, sqrt(M * M - |x|^2) for the shard's largest norm M, for which nearest
by distance is largest by inner product. It is kept as its difference from M, which
changes no distance and doesn't lose the small norms; a query ranks by the inner
product itself. Shards of norms that differ by more than ``WIDE`` use doubles, and
queries start there at the ``LONGEST`` vectors too, which few edges reach.

Graphs and queries are tables in the shared folder; queries travel packed in
blocks, one copy for each shard. All arithmetic is on vectors that are scaled by a
power of two, which loses nothing, so that norms neither overflow nor vanish; scores
are taken of the vectors as they are. The work of the search is queries x shards:
every query asks every shard.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do rows with a null id; vectors of another length are
searched among themselves; rows with one id and vector are one row of the index; a
query row is not its own neighbour; ties go to the smaller id; scores beyond the
range of doubles (infinite, or vanishing) are told so and ordered by the exact
products; with fewer candidates than ``k`` all are returned; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvspark.llm._common import written

DEGREE, BUILD_BEAM, QUERY_BEAM, WIDTH = 32, 48, 96, 4
PER_SHARD, BLOCK, TURN = 8192, 1024, 64
WIDE, LONGEST = 100, 16


class Graph:
    """Vectors (for building with the extra component) and their out-neighbours (-1: none)."""

    def __init__(self, points: np.ndarray, edges: np.ndarray, start: int) -> None:
        self.points, self.edges, self.start = points, edges, start

    def search(self, targets: np.ndarray, beam: int, by_product: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """For each target the best ``beam`` nodes met (-1: none) and their squared distances, nearest first.

        ``by_product``: the largest inner products are nearest, in place of the least distances.
        Each step expands the ``WIDTH`` best unexpanded nodes of every beam.
        """
        n, rows = len(self.points), len(targets)
        kind = self.points.dtype
        norm = np.zeros(n, dtype=kind) if by_product else np.einsum("ij,ij->i", self.points, self.points)
        ids = np.full((rows, beam), -1, dtype=np.int32)
        far = np.full((rows, beam), np.inf, dtype=kind)
        done = np.ones((rows, beam), dtype=bool)
        met = np.zeros((rows, n + 1), dtype=bool)
        met[:, n] = True
        begin = np.array([self.start])
        if by_product and kind == np.float64:
            size = np.einsum("ij,ij->i", self.points, self.points)
            begin = np.union1d(begin, np.argsort(-size, kind="stable")[: min(LONGEST, beam - 1)])
        at = slice(0, len(begin))
        ids[:, at], done[:, at], met[:, begin] = begin, False, True
        far[:, at] = norm[begin] - 2 * targets @ self.points[begin].T
        live = np.arange(rows)
        while len(live):
            wait = ~done[live]
            rank = np.cumsum(wait, axis=1)
            pick = wait & (rank <= WIDTH)
            row, col = np.nonzero(pick)
            done[live[row], col] = True
            out = self.edges[ids[live[row], col]]
            slot = rank[row, col] - 1
            near = np.full((len(live), WIDTH, self.edges.shape[1]), n, dtype=np.int32)
            near[row, slot] = np.where(out < 0, n, out)
            near = near.reshape(len(live), -1)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = n
            near[met[live[:, None], near]] = n
            r, c = np.nonzero(near < n)
            node = near[r, c]
            met[live[r], node] = True
            new = np.full(near.shape, np.inf, dtype=kind)
            new[r, c] = norm[node] - 2 * np.einsum("ij,ij->i", self.points[node], targets[live[r]])
            all_far = np.concatenate([far[live], new], axis=1)
            all_ids = np.concatenate([ids[live], np.where(near < n, near, -1)], axis=1)
            all_done = np.concatenate([done[live], near >= n], axis=1)
            best = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(all_far, best, axis=1), axis=1, kind="stable"), axis=1)
            far[live] = np.take_along_axis(all_far, best, axis=1)
            ids[live] = np.take_along_axis(all_ids, best, axis=1)
            done[live] = np.take_along_axis(all_done, best, axis=1)
            live = live[~done[live].all(axis=1)]
        return ids, far + np.einsum("ij,ij->i", targets, targets)[:, None].astype(kind)

    def prune(self, nodes: np.ndarray, candidates: np.ndarray, alpha: float) -> np.ndarray:
        """Diverse out-neighbours for each node out of its candidates (-1: none)."""
        degree = self.edges.shape[1]
        candidates = np.sort(candidates, axis=1)
        candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
        candidates[candidates == nodes[:, None]] = -1
        points = self.points[candidates]
        away = points - self.points[nodes][:, None, :]
        own = np.einsum("ijk,ijk->ij", away, away)
        own[candidates < 0] = np.inf
        size = np.einsum("ijk,ijk->ij", points, points)
        between = size[:, :, None] + size[:, None, :] - 2 * np.matmul(points, points.transpose(0, 2, 1))
        out = np.full((len(nodes), degree), -1, dtype=np.int32)
        rows = np.arange(len(nodes))
        for k in range(degree):
            best = own.argmin(axis=1)
            good = np.isfinite(own[rows, best])
            if not good.any():
                break
            out[good, k] = candidates[rows[good], best[good]]
            covered = alpha * alpha * between[rows, best] <= own
            own[covered & good[:, None]] = np.inf
            own[rows, best] = np.inf
        return out


def build(points: np.ndarray, seed: int, degree: int = DEGREE, beam: int = BUILD_BEAM) -> Graph:
    """The pruned graph of one shard."""
    n = len(points)
    rng = np.random.default_rng(seed)
    edges = rng.integers(0, n, size=(n, degree), dtype=np.int32)
    middle = points - points.mean(axis=0)
    graph = Graph(points, edges, int(np.einsum("ij,ij->i", middle, middle).argmin()))
    for alpha in (1.0, 1.2):
        order = rng.permutation(n)
        for at in range(0, n, BLOCK):
            nodes = order[at : at + BLOCK]
            found, _ = graph.search(points[nodes], beam)
            kept = graph.prune(nodes, np.concatenate([found, edges[nodes]], axis=1), alpha)
            edges[nodes] = kept
            row, col = np.nonzero(kept >= 0)  # reverse edges, by their new source
            source, target = kept[row, col], nodes[row]
            by = np.argsort(source, kind="stable")
            source, target = source[by], target[by]
            owners, first, times = np.unique(source, return_index=True, return_counts=True)
            for part in range(0, int(times.max(initial=0)), degree):  # a popular node takes them in several turns
                use = times > part
                own, begin = owners[use], first[use] + part
                many = np.minimum(times[use] - part, degree)
                more = np.full((len(own), degree), -1, dtype=np.int32)
                r = np.repeat(np.arange(len(own)), many)
                c = np.arange(len(r)) - np.repeat(np.cumsum(many) - many, many)
                more[r, c] = target[np.repeat(begin, many) + c]
                for i in range(0, len(own), BLOCK):
                    some = own[i : i + BLOCK]
                    both = np.concatenate([edges[some], more[i : i + BLOCK]], axis=1)
                    edges[some] = graph.prune(some, both, alpha)
    return graph


def scaled(own: np.ndarray) -> tuple[np.ndarray, int]:
    """(the vectors as doubles, divided by a power of two so that the largest component is below 1; its exponent)."""
    wide = own.astype(np.float64)
    exponent = int(np.frexp(np.abs(wide).max(initial=0))[1])
    return np.ldexp(wide, -exponent), exponent


def sized(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scaled vectors in the precision that their norms need, squared norms in double)."""
    own, _ = scaled(own)
    size = np.einsum("ij,ij->i", own, own)
    spread = size.max() > WIDE * WIDE * np.median(size)
    return own if spread else own.astype(np.float32), size


def products(own: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of rows of ``own`` with those of ``x``, in double, and what orders equal ones.

    A sum per pair, in the same order for every pair. Where it leaves the range of
    doubles the product is taken again of vectors that are scaled by powers of two.
    """
    with np.errstate(all="ignore"):
        score = (own.astype(np.float64) * x.astype(np.float64)).sum(axis=-1)
        key = np.zeros(score.shape)
        odd = ~np.isfinite(score) | (np.abs(score) < 1e-280)
        if odd.any():
            a, b = np.broadcast_arrays(own.astype(np.float64), x.astype(np.float64))
            a, b = a[odd], b[odd]
            up = [np.frexp(np.abs(v).max(axis=-1))[1] for v in (a, b)]
            value = (np.ldexp(a, -up[0][:, None]) * np.ldexp(b, -up[1][:, None])).sum(axis=-1)
            exact = np.ldexp(value, up[0] + up[1])
            score[odd] = np.where(np.isfinite(score[odd]) & (score[odd] != 0), score[odd], exact)
            # order by sign, then by the power of two, then by the rest of the number
            part, power = np.frexp(value)
            power = power + up[0] + up[1]
            key[odd] = np.where(value == 0, 0, np.sign(part) * np.where(value == 0, 0, 8192 + power) + part)
        key[np.isfinite(score) & (np.abs(score) >= 1e-280)] = 0
    return score, key


def usable(vector):
    """A vector of finite components that aren't all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def _spread(spark: SparkSession, shards: int) -> int:
    """A number of partitions, about twice the shards, in which the fewest shards meet."""
    held = [r["h"] for r in spark.range(shards).selectExpr("hash(cast(id AS int)) AS h").collect()]
    least = max(1, 2 * shards)
    return min(range(least, least + 32), key=lambda n: max(Counter(h % n for h in held).values(), default=0))


def nearest(
    vectors: DataFrame, every: int = 20, k: int = 20, per_shard: int = PER_SHARD, beam: int = QUERY_BEAM
) -> DataFrame:
    """query_id, rank, vec_id, score for each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    single = vectors.schema["embedding"].dataType.elementType.typeName() == "float"
    kind = np.float32 if single else np.float64  # vectors keep their numbers
    values = vectors["embedding"] if single else vectors["embedding"].cast("array<double>")
    few = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), values.alias("v"))
    few = few.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    ranked = few.withColumn("r", F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    classes = written(ranked.groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")), "classes")
    # vectors of each length have shards of their own; a row for each length
    lengths, first = [], 0
    for row in classes.groupBy(F.size("v").alias("dim")).count().orderBy("dim").collect():
        shards = -(-row["count"] // per_shard)
        lengths.append((row["dim"], first, shards))
        first += shards
    table = F.broadcast(spark.createDataFrame(lengths, "dim int, first int, shards int"))
    shard = (F.col("first") + F.pmod(F.xxhash64(F.col("ids")[0]), "shards")).cast("int").alias("shard")

    def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
        return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)

    def make(table: pa.Table) -> pa.Table:
        ids = table.column("ids").combine_chunks()
        number, dim = table.column("shard")[0].as_py(), table.column("dim")[0].as_py()
        own = matrix(table.column("v"), dim)
        points, size = sized(own)
        short = size / (np.sqrt(size.max()) + np.sqrt(size.max() - size))  # M - sqrt(M * M - |x|^2)
        graph = build(np.concatenate([points, short[:, None]], axis=1).astype(points.dtype), number)
        lengths = np.diff(ids.offsets.to_numpy())
        row = [own.tobytes(), graph.edges.tobytes(), graph.start,
               lengths.astype("<i8").tobytes(), ids.flatten().to_numpy().tobytes()]
        kinds = [pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
        names = ["own", "edges", "start", "lengths", "ids"]
        return pa.table([pa.array([x], t) for x, t in zip([number, dim, *row], [pa.int32()] * 2 + kinds, strict=True)], names=["shard", "dim", *names])

    shape = "shard int, dim int, own binary, edges binary, start int, lengths binary, ids binary"
    # a graph is heavy work on few bytes: the shards are dealt to tasks of their own, which aren't put together by size
    dealt = classes.withColumn("dim", F.size("v")).join(table, "dim").select(shard, "dim", "v", "ids")
    dealt = dealt.repartition(_spread(spark, first), "shard")
    graphs = written(dealt.groupBy("shard").applyInArrow(make, shape), "graphs")

    asked = few.where(F.col("vec_id") % every == 0).distinct().withColumn("dim", F.size("v"))
    asked = written(asked.join(table, "dim"), "asked")
    blocks = max(1, -(-asked.count() // BLOCK))

    def pack(table: pa.Table) -> pa.Table:
        ids, dim = table.column("vec_id").to_numpy(), table.column("dim")[0].as_py()
        rows = {"dim": dim, "first": table.column("first")[0].as_py(), "shards": table.column("shards")[0].as_py(),
                "turn": table.column("turn")[0].as_py(), "q": ids.tobytes(), "x": matrix(table.column("v"), dim).tobytes()}
        kinds = [*[pa.int32()] * 4, pa.binary(), pa.binary()]
        return pa.table({c: pa.array([v], t) for (c, v), t in zip(rows.items(), kinds, strict=True)})

    # a shard's queries are dealt to tasks of TURN blocks
    turns = -(-blocks // TURN)
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    packed = asked.withColumn("block", block).withColumn("turn", (F.col("block") % turns).cast("int"))
    packed = packed.groupBy("dim", "block").applyInArrow(pack, "dim int, first int, shards int, turn int, q binary, x binary")
    packed = packed.select("turn", "q", "x", F.explode(F.expr("sequence(first, first + shards - 1)")).alias("shard"))
    asking = graphs.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    tasks = 2 * max(first, 1) * turns
    met = packed.repartition(tasks, "shard", "turn").join(asking.repartition(tasks, "shard", "turn").hint("merge"), ["shard", "turn"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield search(batch.slice(i, 1).to_pylist()[0])

    def search(row: dict) -> pa.RecordBatch:
        own = np.frombuffer(row["own"], dtype=kind).reshape(-1, row["dim"])
        graph = Graph(sized(own)[0], np.frombuffer(row["edges"], dtype=np.int32).reshape(len(own), -1), row["start"])
        ids, lengths = np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["lengths"], dtype=np.int64)
        stops = np.cumsum(lengths)
        names = np.frombuffer(row["q"], dtype=np.int64)
        x = np.frombuffer(row["x"], dtype=kind).reshape(-1, row["dim"])
        # a query's length changes no order
        unit = np.ldexp(x.astype(np.float64), -np.frexp(np.abs(x).max(axis=1).astype(np.float64))[1][:, None])
        unit /= np.sqrt(np.einsum("ij,ij->i", unit, unit))[:, None]
        met, _ = graph.search(unit.astype(graph.points.dtype), max(beam, k + 1), by_product=True)
        score, key = products(own[met], x[:, None, :])
        score[met < 0] = -np.inf
        rows = []
        for q, nodes, value, rest in zip(names.tolist(), met, score, key, strict=True):
            order = [j for j in np.lexsort((ids[stops[nodes] - lengths[nodes]], -rest, -value)) if nodes[j] >= 0][: k + 1]
            got = [
                (-value[j], -rest[j], int(v))
                for j in order
                for v in ids[stops[nodes[j]] - lengths[nodes[j]] : stops[nodes[j]]]
                if v != q
            ]
            rows += [(q, v, -s, -r) for s, r, v in sorted(got)[:k]]
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query_id", "vec_id", "score", "rest"])

    found = met.mapInArrow(look, "query_id long, vec_id long, score double, rest double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("rest"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

"""The engine's queries by name, each with the SQL that checks it.

Inputs are logs derived from the driver's tables: events (a delete for each
'error'), orders by customer, and files simulated by cutting the events log into
runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvspark.functions import codec, keys
from kvspark.operators import compact, layout, log, read
from kvspark.streaming import stream

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

ML = (
    "(SELECT user_id AS uk, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS vt, "
    "CASE WHEN event_type = 'error' THEN '' ELSE props END AS val FROM events)"
)
OL = (
    "(SELECT o_custkey AS uk, row_number() OVER (ORDER BY o_orderkey) AS seq, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS vt, "
    "CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderpriority END AS val FROM orders)"
)
FILES = (
    "(SELECT run_id, run_id % 3 AS level, count(*) AS n, min(uk) AS lo, max(uk) AS hi, CAST(sum(b) AS BIGINT) AS bytes "
    "FROM (SELECT *, CAST(floor((sum(b) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) - b) / 8192) AS BIGINT) AS run_id "
    f"FROM (SELECT uk, seq, 16 + strlen(val) AS b FROM {ML})) GROUP BY run_id)"
)
SNAP = 5000


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = F.col("event_type") == "error"
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("uk"),
        (F.col("event_id") + 1).alias("seq"),
        F.when(gone, 0).otherwise(1).alias("vt"),
        F.when(gone, "").otherwise(F.col("props")).alias("val"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = F.col("o_orderstatus") == "F"
    rows = log.sequenced(spark.read.parquet(f"{sf_dir}/orders.parquet"), 0, "o_orderkey")
    return rows.select(
        F.col("o_custkey").alias("uk"),
        "seq",
        F.when(gone, 0).otherwise(1).alias("vt"),
        F.when(gone, "").otherwise(F.col("o_orderpriority")).alias("val"),
    )


def segment_of_key() -> Column:
    return F.expr("uk div 1024")


def entry_size() -> Column:
    return F.octet_length("val") + 16


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.manifest(events(spark, sf_dir), entry_size(), 8192)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        _queries[name] = fn
        if sql is not None:
            _sql[name] = sql
        return fn

    return keep


def latest_sql(source: str = ML, where: str = "TRUE") -> str:
    return f"(SELECT uk, max(seq) AS seq, max_by(vt, seq) AS vt, max_by(val, seq) AS val FROM {source} WHERE {where} GROUP BY uk)"


def live_sql(source: str = ML, where: str = "TRUE") -> str:
    return f"(SELECT uk, val FROM {latest_sql(source, where)} WHERE vt = 1)"


# A. Sources, sinks, recovery


@query("a8_table_source", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 900")
def _(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return rows.where("o_orderkey >= 100 AND o_orderkey < 900").select("o_orderkey", "o_totalprice")


@query("a8_all_rows", "SELECT o_orderkey, o_totalprice FROM orders")
def _(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")


@query("a13_recover_max_seq", f"SELECT max(seq) AS max_seq FROM {ML}")
def _(spark, sf_dir):
    return events(spark, sf_dir).agg(F.max("seq").alias("max_seq"))


EDITS = f"(SELECT 1 AS edit_no, 'add' AS action, level, run_id FROM {FILES} UNION ALL SELECT 2, 'delete', level, run_id FROM {FILES} WHERE run_id % 4 = 1 UNION ALL SELECT 3, 'add', level + 1, run_id FROM {FILES} WHERE run_id % 4 = 1)"


def edits(spark, sf_dir):
    f = files(spark, sf_dir).select("level", "run_id")
    moved = f.where("run_id % 4 = 1")
    return (
        f.selectExpr("1 AS edit_no", "'add' AS action", "level", "run_id")
        .union(moved.selectExpr("2", "'delete'", "level", "run_id"))
        .union(moved.selectExpr("3", "'add'", "level + 1", "run_id"))
    )


@query("a15_manifest_replay", f"SELECT level, run_id FROM (SELECT level, run_id, max_by(action, edit_no) AS action FROM {EDITS} GROUP BY level, run_id) WHERE action = 'add'")
def _(spark, sf_dir):
    return layout.replay(edits(spark, sf_dir))


@query("a18_file_names", f"SELECT run_id, printf('%06d.sst', run_id) AS file_name, 'table' AS file_type FROM {FILES}")
def _(spark, sf_dir):
    return layout.file_names(files(spark, sf_dir))


@query("a19_obsolete_files", f"SELECT run_id FROM {FILES} f WHERE NOT EXISTS (SELECT 1 FROM {FILES} g WHERE g.run_id = f.run_id AND g.level > 0)")
def _(spark, sf_dir):
    f = files(spark, sf_dir)
    return layout.obsolete(f, f.where("level > 0"))


# B. Writes


def with_writes(spark, sf_dir, rows):
    base = events(spark, sf_dir)
    top = base.agg(F.max("seq")).first()[0]
    new = spark.createDataFrame([(u, top + 1 + i, vt, v) for i, (u, vt, v) in enumerate(rows)], "uk long, seq long, vt int, val string")
    return log.append(base, new)


def writes_sql(rows):
    values = ", ".join(f"({u}, {i + 1}, {vt}, '{v}')" for i, (u, vt, v) in enumerate(rows))
    return f"(SELECT uk, seq, vt, val FROM {ML} UNION ALL SELECT u, (SELECT max(event_id) + 1 FROM events) + i, vt, v FROM (VALUES {values}) t(u, i, vt, v))"


PUTS = [(3, 1, "new"), (1_000_000, 1, "first"), (3, 1, "newer")]
DELETES = [(3, 0, ""), (2_000_000, 0, ""), (7, 0, "")]


@query("b1_put_upsert", f"SELECT uk, val FROM {live_sql(writes_sql(PUTS))}")
def _(spark, sf_dir):
    return read.live(with_writes(spark, sf_dir, PUTS))


@query("b2_delete", f"SELECT uk, val FROM {live_sql(writes_sql(DELETES))}")
def _(spark, sf_dir):
    return read.live(with_writes(spark, sf_dir, DELETES))


@query("b3_batch_sequence", "SELECT o_custkey AS uk, o_orderkey, CAST(1000 + row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS seq FROM orders")
def _(spark, sf_dir):
    rows = log.sequenced(spark.read.parquet(f"{sf_dir}/orders.parquet"), 1000, "o_orderkey")
    return rows.select(F.col("o_custkey").alias("uk"), "o_orderkey", "seq")


@query("b4_batch_bytes", f"SELECT sum(CASE WHEN vt = 1 THEN 12 + 8 + strlen(val) ELSE 6 + 8 END)::BIGINT AS bytes FROM {ML}")
def _(spark, sf_dir):
    rows = events(spark, sf_dir)
    return rows.agg(F.sum(log.batch_bytes(keys.long_key(F.col("uk")), F.col("val"), F.col("vt"))).cast("long").alias("bytes"))


@query("b6_last_op_wins", f"SELECT uk, val FROM {live_sql(OL)}")
def _(spark, sf_dir):
    return read.live(orders(spark, sf_dir))


@query("b7_empty_batch", f"SELECT max(seq) AS max_seq, count(*) AS n FROM {ML}")
def _(spark, sf_dir):
    base = events(spark, sf_dir)
    return log.append(base, base.limit(0)).agg(F.max("seq").alias("max_seq"), F.count("*").alias("n"))


@query("b8_write_snapshot", f"SELECT uk, val FROM {live_sql(writes_sql(PUTS), 'seq <= (SELECT max(event_id) + 3 FROM events)')}")
def _(spark, sf_dir):
    rows = with_writes(spark, sf_dir, PUTS)
    top = events(spark, sf_dir).agg(F.max("seq")).first()[0]
    return read.live(rows, top + 2)


@query("b9_sequence_guard", f"SELECT count(*) AS bad FROM (SELECT seq, lag(seq) OVER (ORDER BY seq) AS p FROM {ML}) WHERE p >= seq")
def _(spark, sf_dir):
    dup = events(spark, sf_dir).groupBy("seq").agg(F.count("*").alias("c")).where("c > 1")
    return dup.agg(F.count("*").alias("bad"))


@query("b10_mem_usage", f"SELECT uk, CAST(sum(16 + strlen(val)) AS BIGINT) AS bytes FROM {ML} GROUP BY uk")
def _(spark, sf_dir):
    used = log.entry_bytes(F.lit(8), F.col("val"))
    return events(spark, sf_dir).groupBy("uk").agg(F.sum(used).cast("long").alias("bytes"))


@query("b11_write_stall_state", f"SELECT CAST(0 AS BIGINT) AS level, count(*) AS files, CASE WHEN count(*) >= 12 THEN 'stop' WHEN count(*) > 8 THEN 'slow' ELSE 'run' END AS state FROM {FILES} WHERE level = 0")
def _(spark, sf_dir):
    return layout.stall_state(files(spark, sf_dir))


# C. Point reads


@query("c1_get", f"SELECT uk, val FROM {live_sql()} WHERE uk = 7")
def _(spark, sf_dir):
    return read.get(events(spark, sf_dir), 7)


@query("c2_get_asof", f"SELECT uk, val FROM {live_sql(where=f'seq <= {SNAP}')} WHERE uk = (SELECT min(uk) FROM {live_sql(where=f'seq <= {SNAP}')})")
def _(spark, sf_dir):
    """The smallest key that lives at the snapshot, read by a point lookup."""
    rows = events(spark, sf_dir)
    return read.get(rows, read.live(rows, SNAP).agg(F.min("uk")).first()[0], SNAP)


@query("c3_multi_get", f"SELECT c_custkey AS uk, CASE WHEN vt IS NULL THEN 'absent' WHEN vt = 0 THEN 'deleted' ELSE 'value' END AS status, CASE WHEN vt = 1 THEN val END AS val FROM customer LEFT JOIN {latest_sql()} l ON l.uk = c_custkey")
def _(spark, sf_dir):
    wanted = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("uk"))
    return read.multi_get(events(spark, sf_dir), wanted)


@query("c4_asof_join", f"SELECT snap, uk, max_by(vt, seq) AS vt, max_by(val, seq) AS val FROM (SELECT p.snap, p.uk, m.seq, m.vt, m.val FROM (SELECT DISTINCT uk, s.snap FROM {ML} a CROSS JOIN (VALUES (CAST(1000 AS BIGINT)), (5000), (9999)) s(snap)) p JOIN {ML} m ON m.uk = p.uk AND m.seq <= p.snap) GROUP BY snap, uk HAVING max_by(vt, seq) = 1")
def _(spark, sf_dir):
    rows = events(spark, sf_dir)
    probes = rows.select("uk").distinct().select("uk", F.explode(F.array(*[F.lit(s) for s in (1000, 5000, 9999)])).alias("snap"))
    return read.asof_join(rows, probes).where("vt = 1")


PROBE_SQL = f"SELECT k.uk, level, run_id, row_number() OVER (PARTITION BY k.uk ORDER BY level, CASE WHEN level = 0 THEN -run_id ELSE run_id END) AS probe_order FROM (VALUES (CAST(3 AS BIGINT)), (50), (99)) k(uk) JOIN {FILES} f ON lo <= k.uk AND hi >= k.uk"


def probe_keys(spark):
    return spark.createDataFrame([(3,), (50,), (99,)], "uk long")


@query("c6_l0_candidates", f"SELECT * FROM ({PROBE_SQL}) WHERE level = 0")
def _(spark, sf_dir):
    return layout.probe_order(probe_keys(spark), files(spark, sf_dir)).where("level = 0")


@query("c7_level_candidate", f"SELECT * FROM ({PROBE_SQL}) WHERE level > 0")
def _(spark, sf_dir):
    return layout.probe_order(probe_keys(spark), files(spark, sf_dir)).where("level > 0")


@query("c8_probe_order", PROBE_SQL)
def _(spark, sf_dir):
    return layout.probe_order(probe_keys(spark), files(spark, sf_dir))


@query("c10_seek_budget", f"SELECT run_id, greatest(100, bytes // 16384) AS allowed_seeks, count(k.uk) AS probes FROM {FILES} f LEFT JOIN (VALUES (CAST(3 AS BIGINT)), (50), (99)) k(uk) ON lo <= k.uk AND hi >= k.uk GROUP BY run_id, bytes")
def _(spark, sf_dir):
    return layout.seek_budget(files(spark, sf_dir), probe_keys(spark))


# D. Scans


@query("d1_scan_latest", f"SELECT uk, val FROM (SELECT *, row_number() OVER (PARTITION BY uk ORDER BY seq DESC) AS rn FROM {ML}) WHERE rn = 1 AND vt = 1 ORDER BY uk")
def _(spark, sf_dir):
    return read.scan(events(spark, sf_dir))


@query("d2_scan_asof", f"SELECT uk, val FROM (SELECT *, row_number() OVER (PARTITION BY uk ORDER BY seq DESC) AS rn FROM {ML} WHERE seq <= {SNAP}) WHERE rn = 1 AND vt = 1 ORDER BY uk")
def _(spark, sf_dir):
    return read.scan(events(spark, sf_dir), SNAP)


@query("d4_seek", f"SELECT uk, val FROM {live_sql()} WHERE uk >= 50 ORDER BY uk LIMIT 1")
def _(spark, sf_dir):
    return read.seek(events(spark, sf_dir), 50)


@query("d5_range", f"SELECT uk, val FROM {live_sql()} WHERE uk >= 20 AND uk < 60")
def _(spark, sf_dir):
    return read.key_range(events(spark, sf_dir), 20, 60)


@query("d6_first_n", f"SELECT uk, val FROM {live_sql()} ORDER BY uk LIMIT 10")
def _(spark, sf_dir):
    return read.first_n(events(spark, sf_dir), 10)


@query("d7_peek_next", f"SELECT uk, lead(uk) OVER (ORDER BY uk) AS next_uk FROM {live_sql()}")
def _(spark, sf_dir):
    return read.with_next(read.live(events(spark, sf_dir)), segment_of_key())


@query("d8_reverse", f"SELECT row_number() OVER (ORDER BY uk DESC) AS pos, uk FROM {live_sql()}")
def _(spark, sf_dir):
    rows = read.live(events(spark, sf_dir)).select("uk")
    return read.with_position(rows, -segment_of_key(), F.desc("uk")).select("pos", "uk")


@query("d9_key_only_scan", f"SELECT uk FROM {live_sql()}")
def _(spark, sf_dir):
    return read.live(events(spark, sf_dir)).select("uk")


@query("d10_history", f"SELECT uk, seq, vt, val FROM (SELECT *, row_number() OVER (PARTITION BY uk ORDER BY seq DESC) AS rn FROM {ML}) WHERE rn <= 3")
def _(spark, sf_dir):
    return read.history(events(spark, sf_dir), 3)


@query("d11_merge_runs", f"SELECT uk, seq, run_id FROM (SELECT *, row_number() OVER (PARTITION BY uk ORDER BY seq DESC) AS rn FROM (SELECT uk, seq, 0 AS run_id FROM {ML} WHERE seq <= {SNAP} UNION ALL SELECT uk, seq, 1 FROM {ML} WHERE seq > {SNAP})) WHERE rn = 1")
def _(spark, sf_dir):
    rows = events(spark, sf_dir).select("uk", "seq")
    return read.merge_runs(rows.where(f"seq <= {SNAP}").withColumn("run_id", F.lit(0)), rows.where(f"seq > {SNAP}").withColumn("run_id", F.lit(1)))


RUN_ROWS = f"(SELECT uk, seq, run_id FROM (SELECT *, CAST(floor((sum(b) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) - b) / 8192) AS BIGINT) AS run_id FROM (SELECT uk, seq, 16 + strlen(val) AS b FROM {ML})))"


@query("d12_compaction_merge", f"SELECT uk, max(seq) AS seq, max_by(run_id, seq) AS run_id FROM {RUN_ROWS} WHERE run_id IN (3, 4, 7) GROUP BY uk")
def _(spark, sf_dir):
    rows = layout.with_runs(events(spark, sf_dir), entry_size(), 8192).select("uk", "seq", "run_id")
    return read.merge_runs(*[rows.where(F.col("run_id") == r) for r in (3, 4, 7)])


@query("d13_level0_merge", f"SELECT uk, max(seq) AS seq, max_by(run_id, seq) AS run_id FROM {RUN_ROWS} WHERE run_id % 3 = 0 GROUP BY uk")
def _(spark, sf_dir):
    rows = layout.with_runs(events(spark, sf_dir), entry_size(), 8192).select("uk", "seq", "run_id")
    return read.merge_runs(rows.where("run_id % 3 = 0"))


@query("d14_level_concat", f"SELECT level, run_id, lo, hi FROM {FILES} WHERE level = 1 AND hi >= 50")
def _(spark, sf_dir):
    return files(spark, sf_dir).where("level = 1 AND hi >= 50").select("level", "run_id", "lo", "hi")


@query("d17_flushed_only", f"SELECT uk, val FROM {live_sql(where='seq <= 9000')}")
def _(spark, sf_dir):
    return read.live(events(spark, sf_dir), 9000)


RUNS_LOG = f"(SELECT uk, seq, vt, val, CAST(floor((sum(b) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) - b) / 8192) AS BIGINT) AS run_id FROM (SELECT *, 16 + strlen(val) AS b FROM {ML}))"


@query("d17_all_flushed", f"SELECT uk, val FROM {live_sql(RUNS_LOG, f'run_id < (SELECT max(run_id) FROM {RUNS_LOG})')}")
def _(spark, sf_dir):
    """All runs but the last, which is still in memory."""
    rows = layout.with_runs(events(spark, sf_dir), entry_size(), 8192)
    last = rows.agg(F.max("run_id")).first()[0]
    return read.live(rows.where(F.col("run_id") < F.lit(last)).select("uk", "seq", "vt", "val"))


@query("d18_past_end", f"SELECT uk, val FROM {live_sql()} WHERE uk >= 9000000000")
def _(spark, sf_dir):
    return read.seek(events(spark, sf_dir), 9_000_000_000)


# E. Snapshots


@query("e1_snapshot", f"SELECT max(seq) AS snap FROM {ML}")
def _(spark, sf_dir):
    return events(spark, sf_dir).agg(F.max("seq").alias("snap"))


@query("e4_live_files", f"SELECT DISTINCT run_id FROM {EDITS} WHERE action = 'add'")
def _(spark, sf_dir):
    return edits(spark, sf_dir).where("action = 'add'").select("run_id").distinct()


@query("e6_snapshot_diff", f"SELECT coalesce(a.uk, b.uk) AS uk, CASE WHEN a.uk IS NULL THEN 'added' WHEN b.uk IS NULL THEN 'removed' ELSE 'changed' END AS what FROM {live_sql(where=f'seq <= {SNAP}')} a FULL JOIN {live_sql()} b ON a.uk = b.uk WHERE a.uk IS NULL OR b.uk IS NULL OR a.val <> b.val")
def _(spark, sf_dir):
    return read.diff(events(spark, sf_dir), SNAP)


# F. Orders


@query("f1_binary_order", "SELECT row_number() OVER (ORDER BY hex(encode(p_name)), p_partkey) AS pos, p_partkey FROM part")
def _(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.encode("p_name", "UTF-8").alias("k"))
    first = F.conv(F.hex(F.substring("k", 1, 1)), 16, 10).cast("int")
    return read.with_position(rows, first, F.struct("k", "p_partkey")).select("pos", "p_partkey")


@query("f2_custom_order", "SELECT p_partkey, row_number() OVER (ORDER BY -p_partkey) AS pos FROM part")
def _(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"))
    order = lambda k: -k
    out = read.with_position(rows, F.expr("-(k div 1024)"), order(F.col("k")))
    return out.select(F.col("k").alias("p_partkey"), "pos")


@query("f4_internal_order", f"SELECT uk, seq, row_number() OVER (ORDER BY uk, seq DESC) AS pos FROM {ML}")
def _(spark, sf_dir):
    rows = events(spark, sf_dir).select("uk", "seq")
    return read.with_position(rows, F.expr("uk div 16"), F.struct("uk", (-F.col("seq")).alias("s"))).select("uk", "seq", "pos")


@query("f5_is_sorted", "SELECT min(CASE WHEN p IS NULL OR p <= o_orderkey THEN 1 ELSE 0 END) AS ok FROM (SELECT o_orderkey, lag(o_orderkey) OVER (ORDER BY o_orderkey) AS p FROM orders)")
def _(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_orderkey").alias("at"))
    return read.is_sorted(rows, "o_orderkey", "at", F.expr("at div 4096"))


@query("f6_separator")
def _(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    a, b = F.encode("p_brand", "UTF-8"), F.encode("p_name", "UTF-8")
    return rows.select("p_partkey", F.hex(keys.separator(F.least(a, b), F.greatest(a, b))).alias("separator"))


@query("f7_successor")
def _(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    return rows.select("p_partkey", F.hex(keys.successor(F.encode("p_name", "UTF-8"))).alias("successor"))


@query("f10_newest_first", f"SELECT run_id, row_number() OVER (ORDER BY run_id DESC) AS pos FROM {FILES} WHERE level = 0")
def _(spark, sf_dir):
    rows = files(spark, sf_dir).where("level = 0").select("run_id")
    return read.with_position(rows, F.expr("-(run_id div 1024)"), F.desc("run_id")).select("run_id", "pos")


@query("f11_by_smallest_key", f"SELECT run_id, row_number() OVER (ORDER BY lo, run_id) AS pos FROM {FILES}")
def _(spark, sf_dir):
    rows = files(spark, sf_dir).select("run_id", "lo")
    return read.with_position(rows, F.expr("lo div 1024"), F.struct("lo", "run_id")).select("run_id", "pos")


# G. Compaction and layout


@query("g1_runs", f"SELECT run_id, n, lo, hi, bytes FROM {FILES}")
def _(spark, sf_dir):
    return files(spark, sf_dir).select("run_id", "n", "lo", "hi", "bytes")


@query("g1_runs_exact", f"WITH RECURSIVE m AS (SELECT seq, uk, 16 + strlen(val) AS b FROM {ML}), r AS (SELECT CAST(1 AS BIGINT) AS seq, (SELECT b FROM m WHERE seq = 1) AS used, CAST(0 AS BIGINT) AS run_id UNION ALL SELECT m.seq, CASE WHEN r.used > 4096 THEN m.b ELSE r.used + m.b END, CASE WHEN r.used > 4096 THEN r.run_id + 1 ELSE r.run_id END FROM r JOIN m ON m.seq = r.seq + 1) SELECT run_id, count(*) AS n, min(uk) AS lo, max(uk) AS hi, CAST(sum(b) AS BIGINT) AS bytes FROM r JOIN m USING (seq) GROUP BY run_id")
def _(spark, sf_dir):
    return layout.exact_runs(events(spark, sf_dir), entry_size(), 4096).drop("shard")


@query("g4_output_level", f"SELECT n.run_id, CAST(CASE WHEN s0 IS NULL AND s1 IS NULL AND coalesce(s2, -1) <= 20971520 THEN CASE WHEN s2 IS NULL AND coalesce(s3, -1) <= 20971520 THEN 2 ELSE 1 END ELSE 0 END AS BIGINT) AS level FROM (SELECT n.run_id, sum(f.bytes) FILTER (f.level = 0) AS s0, sum(f.bytes) FILTER (f.level = 1) AS s1, sum(f.bytes) FILTER (f.level = 2) AS s2, sum(f.bytes) FILTER (f.level = 3) AS s3 FROM (SELECT run_id, lo + 100 * (run_id % 3) AS lo, hi + 100 * (run_id % 3) AS hi FROM {FILES}) n LEFT JOIN {FILES} f ON f.lo <= n.hi AND f.hi >= n.lo GROUP BY n.run_id) n")
def _(spark, sf_dir):
    f = files(spark, sf_dir)
    return layout.output_level(f, f.selectExpr("run_id", "lo + 100 * (run_id % 3) AS lo", "hi + 100 * (run_id % 3) AS hi"))


@query("g5_range_overlap", f"SELECT level, count(*) AS files FROM {FILES} WHERE lo <= 60 AND hi >= 20 GROUP BY level")
def _(spark, sf_dir):
    return layout.overlaps(files(spark, sf_dir), 20, 60).groupBy("level").agg(F.count("*").alias("files"))


@query("g6_overlaps", f"SELECT a.run_id AS a, b.run_id AS b FROM {FILES} a JOIN {FILES} b ON a.run_id < b.run_id AND a.lo <= b.hi AND b.lo <= a.hi")
def _(spark, sf_dir):
    return layout.overlapping_pairs(files(spark, sf_dir))


SCORES = f"(SELECT level, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, CASE WHEN level = 0 THEN count(*) / 4.0::DOUBLE ELSE sum(bytes)::DOUBLE / (10485760.0::DOUBLE * pow(10.0, level - 1)) END AS score FROM {FILES} GROUP BY level)"


@query("g7_level_score", f"SELECT level, files, bytes, score FROM {SCORES}")
def _(spark, sf_dir):
    return layout.level_scores(files(spark, sf_dir))


@query("g8_needs_compaction", f"SELECT level, score, score >= 1 AS due FROM {SCORES} ORDER BY score DESC, level LIMIT 1")
def _(spark, sf_dir):
    return layout.needs_compaction(files(spark, sf_dir))


PICK = f"(SELECT level, coalesce(arg_min(run_id, (lo, run_id)) FILTER (hi > 149), arg_min(run_id, (lo, run_id))) AS run_id FROM {FILES} GROUP BY level)"


@query("g9_pick", f"SELECT level, run_id FROM {PICK}")
def _(spark, sf_dir):
    return layout.pick(files(spark, sf_dir), F.lit(149))


@query("g10_seek_pick", f"SELECT run_id FROM {FILES} f WHERE 100 - 20 * (SELECT count(*) FROM (VALUES (CAST(3 AS BIGINT)), (50), (99), (2), (1), (77)) k(uk) WHERE k.uk BETWEEN lo AND hi) <= 0")
def _(spark, sf_dir):
    probes = spark.createDataFrame([(k,) for k in (3, 50, 99, 2, 1, 77)], "uk long")
    return layout.seek_budget(files(spark, sf_dir), probes).where("100 - 20 * probes <= 0").select("run_id")


NARROW = f"(SELECT run_id, run_id % 3 AS level, (run_id * 37) % 150 AS lo, (run_id * 37) % 150 + 9 AS hi, bytes FROM {FILES})"


def narrow_files(spark, sf_dir):
    return files(spark, sf_dir).selectExpr("run_id", "level", "(run_id * 37) % 150 AS lo", "(run_id * 37) % 150 + 9 AS hi", "bytes")


INPUTS = (
    f"f AS (SELECT * FROM {NARROW}), c AS (SELECT run_id AS pick, level AS dp, lo, hi, run_id FROM f WHERE level < 2), "
    "i1 AS (SELECT * FROM c WHERE dp > 0 UNION ALL SELECT c.pick, c.dp, f.lo, f.hi, f.run_id FROM c JOIN f ON f.level = 0 AND f.lo <= c.hi AND f.hi >= c.lo WHERE c.dp = 0), "
    "s1 AS (SELECT pick, dp, min(lo) AS lo, max(hi) AS hi FROM i1 GROUP BY ALL), "
    "n1 AS (SELECT s1.pick, s1.dp, f.lo, f.hi, f.run_id FROM s1 JOIN f ON f.level = s1.dp + 1 AND f.lo <= s1.hi AND f.hi >= s1.lo), "
    "a1 AS (SELECT pick, dp, min(lo) AS lo, max(hi) AS hi FROM (FROM i1 UNION ALL FROM n1) GROUP BY ALL), "
    "i2 AS (SELECT a1.pick, a1.dp, f.lo, f.hi, f.run_id FROM a1 JOIN f ON f.level = a1.dp AND f.lo <= a1.hi AND f.hi >= a1.lo), "
    "s2 AS (SELECT pick, dp, min(lo) AS lo, max(hi) AS hi FROM i2 GROUP BY ALL), "
    "n2 AS (SELECT s2.pick, s2.dp, f.lo, f.hi, f.run_id FROM s2 JOIN f ON f.level = s2.dp + 1 AND f.lo <= s2.hi AND f.hi >= s2.lo), "
    "x AS (SELECT pick FROM c WHERE (SELECT count(*) FROM n1 WHERE n1.pick = c.pick) > 0 AND (SELECT count(*) FROM i2 WHERE i2.pick = c.pick) > (SELECT count(*) FROM i1 WHERE i1.pick = c.pick) AND (SELECT count(*) FROM n2 WHERE n2.pick = c.pick) = (SELECT count(*) FROM n1 WHERE n1.pick = c.pick)), "
    "ii AS (SELECT * FROM i1 WHERE pick NOT IN (FROM x) UNION ALL SELECT * FROM i2 WHERE pick IN (FROM x)), "
    "nn AS (SELECT * FROM n1 WHERE pick NOT IN (FROM x) UNION ALL SELECT * FROM n2 WHERE pick IN (FROM x)), "
    "al AS (SELECT pick, dp, min(lo) AS lo, max(hi) AS hi FROM (FROM ii UNION ALL FROM nn) GROUP BY ALL), "
    "g AS (SELECT al.pick, f.level, f.run_id FROM al JOIN f ON f.level = al.dp + 2 AND f.lo <= al.hi AND f.hi >= al.lo), "
    "o AS (SELECT pick, dp AS level, run_id, 'input' AS role FROM ii UNION ALL SELECT pick, dp + 1, run_id, 'next' FROM nn UNION ALL SELECT pick, level, run_id, 'grandparent' FROM g)"
)


@query("g11_inputs", f"WITH {INPUTS} SELECT pick, level, run_id, role FROM o")
def _(spark, sf_dir):
    f = narrow_files(spark, sf_dir)
    return layout.compaction_inputs(f, f.where("level < 2"))


@query("g12_range_of_files", f"SELECT level, min(lo) AS lo, max(hi) AS hi FROM {FILES} GROUP BY level")
def _(spark, sf_dir):
    return files(spark, sf_dir).groupBy("level").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


@query("g13_trivial_move", f"WITH {INPUTS} SELECT pick, count(*) FILTER (role = 'input') = 1 AND count(*) FILTER (role = 'next') = 0 AND coalesce(sum(bytes) FILTER (role = 'grandparent'), 0) <= 20971520 AS trivial FROM o JOIN f USING (run_id) GROUP BY pick")
def _(spark, sf_dir):
    f = narrow_files(spark, sf_dir)
    return layout.trivial_moves(f, layout.compaction_inputs(f, f.where("level < 2")))


PICKED = INPUTS.replace(NARROW, FILES).replace("FROM f WHERE level < 2)", f"FROM f JOIN {PICK} USING (level, run_id))")


@query("d12_every_pick", f"WITH {PICKED} SELECT pick, uk, max(seq) AS seq, max_by(run_id, seq) AS run_id FROM o JOIN {RUN_ROWS} USING (run_id) WHERE role IN ('input', 'next') GROUP BY pick, uk")
def _(spark, sf_dir):
    """The merge of each level's compaction: the inputs of its pick and those of the next level."""
    f = files(spark, sf_dir)
    inputs = layout.compaction_inputs(f, layout.pick(f, F.lit(149))).where("role IN ('input', 'next')").select("pick", "run_id")
    rows = layout.with_runs(events(spark, sf_dir), entry_size(), 8192).select("uk", "seq", "run_id")
    return read.merge_runs(rows.join(inputs, "run_id"), by=("pick",))


def compact_sql(s: int, source: str = ML) -> str:
    return f"SELECT uk, seq, vt, val FROM (SELECT *, lag(seq) OVER (PARTITION BY uk ORDER BY seq DESC) AS newer FROM {source}) WHERE NOT (newer IS NOT NULL AND newer <= {s}) AND NOT (vt = 0 AND seq <= {s})"


@query("g14_compact", compact_sql(9000))
def _(spark, sf_dir):
    return compact.compact(events(spark, sf_dir), 9000)


@query("g15_base_level", f"SELECT uk, seq, vt, val FROM (SELECT *, lag(seq) OVER (PARTITION BY uk ORDER BY seq DESC) AS newer FROM {ML}) WHERE NOT (newer IS NOT NULL AND newer <= 9000) AND NOT (vt = 0 AND seq <= 9000 AND NOT (uk BETWEEN 10 AND 40))")
def _(spark, sf_dir):
    deeper = spark.createDataFrame([(10, 30), (25, 40)], "lo long, hi long")
    return compact.compact(events(spark, sf_dir), 9000, deeper)


@query("g14_compact_snapshots", f"SELECT uk, seq, vt, val FROM (SELECT *, row_number() OVER (PARTITION BY uk, s ORDER BY seq DESC) AS rn FROM (SELECT *, CASE WHEN seq <= 3000 THEN 0 WHEN seq <= 7000 THEN 1 ELSE 2 END AS s FROM {ML})) WHERE rn = 1 AND NOT (vt = 0 AND seq <= 3000)")
def _(spark, sf_dir):
    return compact.compact_for(events(spark, sf_dir), [3000, 7000])


@query("g16_output_files", f"SELECT file_no, CAST(sum(n) AS BIGINT) AS n, min(uk) AS lo, max(uk) AS hi FROM (SELECT *, CAST((sum(b) OVER (ORDER BY uk ROWS UNBOUNDED PRECEDING) - b) // 16384 AS BIGINT) AS file_no FROM (SELECT uk, count(*) AS n, CAST(sum(16 + strlen(val)) AS BIGINT) AS b FROM ({compact_sql(9000)}) GROUP BY uk)) GROUP BY file_no")
def _(spark, sf_dir):
    return layout.output_files(compact.compact(events(spark, sf_dir), 9000), entry_size(), 16_384, segment_of_key())


@query("g19_apply_edits", f"SELECT level, count(*) AS files FROM (SELECT level, run_id, max_by(action, edit_no) AS action FROM {EDITS} GROUP BY level, run_id) WHERE action = 'add' GROUP BY level")
def _(spark, sf_dir):
    return layout.replay(edits(spark, sf_dir)).groupBy("level").agg(F.count("*").alias("files"))


@query("g20_nonoverlap", f"SELECT level, CAST(sum(CASE WHEN p >= lo THEN 1 ELSE 0 END) AS BIGINT) AS bad FROM (SELECT *, lag(hi) OVER (PARTITION BY level ORDER BY lo, run_id) AS p FROM {FILES}) GROUP BY level")
def _(spark, sf_dir):
    return layout.non_overlap(files(spark, sf_dir))


TOP = "(SELECT max(event_id) + 1 FROM events)"


@query("g22_compact_range", f"SELECT uk, seq, vt, val FROM (SELECT *, lag(seq) OVER (PARTITION BY uk ORDER BY seq DESC) AS newer FROM {ML}) WHERE uk < 20 OR uk >= 90 OR (newer IS NULL AND vt = 1)")
def _(spark, sf_dir):
    return compact.compact_range(events(spark, sf_dir), 20, 90)


# H. Statistics


@query("h1_approx_sizes", f"SELECT id, CAST(coalesce(sum(16 + strlen(val)), 0) AS BIGINT) AS bytes FROM (VALUES (1, CAST(0 AS BIGINT), CAST(50 AS BIGINT)), (2, 50, 1000000), (3, 60, 20)) r(id, a, z) LEFT JOIN {ML} m ON uk >= a AND uk < z GROUP BY id")
def _(spark, sf_dir):
    ranges = spark.createDataFrame([(1, 0, 50), (2, 50, 1_000_000), (3, 60, 20)], "id int, start long, limit long")
    return layout.approximate_sizes(events(spark, sf_dir), ranges, entry_size())


@query("h2_approx_offset", f"SELECT id, CAST(coalesce(sum(CASE WHEN hi < k THEN bytes WHEN lo <= k THEN bytes // 2 ELSE 0 END), 0) AS BIGINT) AS bytes FROM (VALUES (1, CAST(5 AS BIGINT)), (2, 149)) k(id, k) LEFT JOIN {FILES} f ON lo <= k GROUP BY id")
def _(spark, sf_dir):
    return layout.approximate_offset(files(spark, sf_dir), spark.createDataFrame([(1, 5), (2, 149)], "id int, uk long"))


@query("h3_file_offset", f"SELECT run_id, uk, seq, CAST(sum(b) OVER (PARTITION BY run_id ORDER BY uk, seq DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS bytes FROM (SELECT *, CAST(floor((sum(b) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) - b) / 8192) AS BIGINT) AS run_id FROM (SELECT uk, seq, 16 + strlen(val) AS b FROM {ML}))")
def _(spark, sf_dir):
    rows = layout.with_runs(events(spark, sf_dir), entry_size(), 8192)
    return layout.file_offsets(rows, F.col("b")).select("run_id", "uk", "seq", "bytes")


@query("h4_files_per_level", f"SELECT level, count(*) AS files FROM {FILES} GROUP BY level")
def _(spark, sf_dir):
    return files(spark, sf_dir).groupBy("level").agg(F.count("*").alias("files"))


@query("h5_bytes_per_level", f"SELECT level, CAST(sum(bytes) AS BIGINT) AS bytes FROM {FILES} GROUP BY level")
def _(spark, sf_dir):
    return files(spark, sf_dir).groupBy("level").agg(F.sum("bytes").cast("long").alias("bytes"))


OVERLAP = f"(SELECT a.run_id, CAST(coalesce(sum(b.bytes), 0) AS BIGINT) AS ov FROM {FILES} a LEFT JOIN {FILES} b ON b.level = a.level + 1 AND b.hi >= a.lo AND b.lo <= a.hi GROUP BY a.run_id)"


@query("h6_next_level_overlap", f"SELECT run_id, ov FROM {OVERLAP}")
def _(spark, sf_dir):
    return layout.next_level_overlap(files(spark, sf_dir))


@query("h6_max_overlap", f"SELECT max(ov) AS most FROM {OVERLAP}")
def _(spark, sf_dir):
    return layout.next_level_overlap(files(spark, sf_dir)).agg(F.max("ov").alias("most"))


@query("h7_total_size", f"SELECT CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(n) AS BIGINT) AS entries FROM {FILES}")
def _(spark, sf_dir):
    return files(spark, sf_dir).agg(F.sum("bytes").cast("long").alias("bytes"), F.sum("n").cast("long").alias("entries"))


# I. Codecs

VARINT = "CASE WHEN n < 0 THEN 10 " + " ".join(f"WHEN n < {1 << (7 * i)} THEN {i}" for i in range(1, 9)) + " ELSE 9 END"


@query("i4_varint_size", f"SELECT event_id, {VARINT} AS size FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN -event_id - 1 ELSE event_id * event_id * event_id END AS n FROM events)")
def _(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    rows = rows.withColumn("square", keys.wrapped_product(F.col("event_id"), F.col("event_id")))  # columns, since an
    rows = rows.withColumn("cube", keys.wrapped_product(F.col("square"), F.col("event_id")))  # expression is worked out wherever it stands
    rows = rows.select("event_id", F.when(F.col("event_id") % 7 == 0, -F.col("event_id") - 1).otherwise(F.col("cube")).alias("n"))
    return rows.select("event_id", keys.varint_size(F.col("n")).alias("size"))


@query("i6_pack", f"SELECT seq, vt, seq * 256 + vt AS packed, seq AS seq_again, vt AS vt_again FROM {ML}")
def _(spark, sf_dir):
    packed = events(spark, sf_dir).select("seq", "vt", keys.pack(F.col("seq"), F.col("vt")).alias("packed"))
    return packed.select("seq", "vt", "packed", keys.unpack_seq(F.col("packed")).alias("seq_again"), keys.unpack_type(F.col("packed")).cast("int").alias("vt_again"))


@query("i7_internal_key", f"SELECT seq, printf('%016X', xor(uk, (-9223372036854775808)::BIGINT)::BIGINT) || array_to_string([substr(h, 2 * i + 1, 2) FOR i IN [7, 6, 5, 4, 3, 2, 1, 0]], '') AS key FROM (SELECT uk, seq, printf('%016X', seq * 256 + vt) AS h FROM {ML})")
def _(spark, sf_dir):
    made = codec.internal_key(keys.long_key(F.col("uk")), keys.pack(F.col("seq"), F.col("vt")))
    return events(spark, sf_dir).select("seq", F.hex(made).alias("key"))


@query("i10_crc_mask", "SELECT event_id, ((c >> 15 | ((c * 131072) & 4294967295)) + 2726488792) & 4294967295 AS masked, c AS unmasked FROM (SELECT event_id, (event_id * 2654435761) & 4294967295 AS c FROM events)")
def _(spark, sf_dir):
    c = keys.wrapped_product(F.col("event_id"), F.lit(2654435761)).bitwiseAND(F.lit(4294967295).cast("long"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", keys.crc_mask(c).alias("masked"))
    return rows.select("event_id", "masked", keys.crc_unmask(F.col("masked")).alias("unmasked"))


@query("i11_utf8", "SELECT doc_id, strlen(text) AS bytes, md5(text) AS digest FROM documents")
def _(spark, sf_dir):
    raw = F.encode("text", "UTF-8")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rows.select("doc_id", F.octet_length(raw).cast("long").alias("bytes"), F.md5(F.encode(F.decode(raw, "UTF-8"), "UTF-8")).alias("digest"))


def prefixes(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(keys.padded(F.col("o_orderkey"), 12).alias("uk"))
    segment = F.expr("cast(substring(uk, 1, 9) AS int)")
    nexts = read.with_next(rows, segment)
    before = nexts.where("next_uk IS NOT NULL").select(F.col("next_uk").alias("uk"), F.col("uk").alias("p"))
    placed = read.with_position(rows, segment, F.col("uk")).join(before, "uk", "left")
    pos = F.col("pos") - 1
    shared = keys.shared_prefix(F.encode("uk", "UTF-8"), F.encode("p", "UTF-8"))
    return placed.select(F.col("uk").alias("k"), pos.alias("pos"), F.when(pos % 16 == 0, 0).otherwise(shared).alias("shared"))


@query("i13_prefix", "SELECT k, pos, CASE WHEN pos % 16 = 0 THEN 0 ELSE CAST(coalesce((SELECT max(i) FROM range(1, strlen(k) + 1) t(i) WHERE k[:i] = p[:i]), 0) AS INTEGER) END AS shared FROM (SELECT k, row_number() OVER (ORDER BY k) - 1 AS pos, lag(k) OVER (ORDER BY k) AS p FROM (SELECT printf('%012d', o_orderkey) AS k FROM orders))")
def _(spark, sf_dir):
    return prefixes(spark, sf_dir)


@query("h11_block_estimate", "SELECT CAST(sum(3 + 12 - shared + strlen(val)) + 4 * ceil(count(*) / 16.0) + 4 AS BIGINT) AS bytes FROM (SELECT val, CASE WHEN pos % 16 = 0 THEN 0 ELSE coalesce((SELECT max(i) FROM range(1, strlen(k) + 1) t(i) WHERE k[:i] = p[:i]), 0) END AS shared FROM (SELECT k, val, row_number() OVER (ORDER BY k) - 1 AS pos, lag(k) OVER (ORDER BY k) AS p FROM (SELECT printf('%012d', o_orderkey) AS k, o_orderpriority AS val FROM orders)))")
def _(spark, sf_dir):
    shared = prefixes(spark, sf_dir)
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(keys.padded(F.col("o_orderkey"), 12).alias("k"), "o_orderpriority")
    return layout.block_estimate(shared.join(rows, "k"), F.octet_length("k"), F.octet_length("o_orderpriority"), 16)


@query("i14_block_cut", f"WITH RECURSIVE m AS (SELECT seq, 16 + strlen(val) AS b FROM {ML}), r AS (SELECT CAST(1 AS BIGINT) AS seq, (SELECT b FROM m WHERE seq = 1) AS used, CAST(0 AS BIGINT) AS run_id UNION ALL SELECT m.seq, CASE WHEN r.used >= 4096 THEN m.b ELSE r.used + m.b END, CASE WHEN r.used >= 4096 THEN r.run_id + 1 ELSE r.run_id END FROM r JOIN m ON m.seq = r.seq + 1) SELECT run_id AS block, count(*) AS n FROM r GROUP BY run_id")
def _(spark, sf_dir):
    blocks = layout.exact_runs(events(spark, sf_dir), entry_size(), 4095)
    return blocks.select(F.col("run_id").alias("block"), "n")


@query("i17_log_chunks", "SELECT doc_id, i AS chunk, least(32761, n - i * 32761) AS size, CASE WHEN n <= 32761 THEN 1 WHEN i = 0 THEN 2 WHEN (i + 1) * 32761 >= n THEN 4 ELSE 3 END AS kind FROM (SELECT doc_id, n, unnest(range(greatest(1, (n + 32760) // 32761))) AS i FROM (SELECT doc_id, strlen(text) AS n FROM documents))")
def _(spark, sf_dir):
    n = F.octet_length("text").cast("long")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", n.alias("n"))
    rows = rows.withColumn("chunk", F.explode(F.expr("sequence(0L, greatest(1L, (n + 32760) div 32761) - 1)")))
    kind = F.expr("CASE WHEN n <= 32761 THEN 1 WHEN chunk = 0 THEN 2 WHEN (chunk + 1) * 32761 >= n THEN 4 ELSE 3 END")
    return rows.select("doc_id", "chunk", F.expr("least(32761L, n - chunk * 32761)").alias("size"), kind.alias("kind"))


@query("i20_format_number", "SELECT event_id, lpad(event_id::VARCHAR, 16, '0') AS k FROM events")
def _(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", keys.number_key(F.col("event_id")).alias("k"))


@query("i21_test_key", "SELECT event_id, printf('key%06d', event_id) AS k FROM events")
def _(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", keys.test_key(F.col("event_id")).alias("k"))


@query("i1_varint", "SELECT event_id, array_to_string([printf('%02X', ((event_id >> (7 * i)) & 127) | CASE WHEN event_id >> (7 * i + 7) > 0 THEN 128 ELSE 0 END) FOR i IN range(0, 9) IF i = 0 OR event_id >> (7 * i) > 0], '') AS varint, event_id AS value FROM events")
def _(spark, sf_dir):
    made = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", codec.varint64(F.col("event_id")).alias("v"))
    return made.select("event_id", F.hex("v").alias("varint"), codec.varint64_value("v").alias("value"))


CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, %s), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, k: xor(c >> 1, (c & 1) * 2197175160))))"
BYTES = "list_transform(string_split(props, ''), lambda x: ascii(x)::BIGINT)"


@query("i9_crc32c", f"SELECT event_id, c AS crc, ((c >> 15 | ((c * 131072) & 4294967295)) + 2726488792) & 4294967295 AS masked FROM (SELECT event_id, {CRC % BYTES} AS c FROM events)")
def _(spark, sf_dir):
    raw = F.encode("props", "UTF-8")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select("event_id", codec.crc32c(raw).alias("crc"), codec.masked_crc32c(raw).alias("masked"))


@query("i18_chunk_checksum", f"SELECT event_id, ((c >> 15 | ((c * 131072) & 4294967295)) + 2726488792) & 4294967295 AS checksum FROM (SELECT event_id, {CRC % f'list_prepend(1::BIGINT, {BYTES})'} AS c FROM events)")
def _(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select("event_id", codec.chunk_checksum(F.lit(1), F.encode("props", "UTF-8")).alias("checksum"))


@query("b13_batch_codec", f"SELECT seq, uk, vt, val FROM {ML}")
def _(spark, sf_dir):
    """Batches of 64 mutations, encoded and decoded."""
    encode, decode = codec.encode_batch, codec.decode_batch  # the module holds objects of the driver, which can't travel

    def through(rows):
        import pandas as pd

        rows = rows.sort_values("seq")
        operations = [(str(u).encode(), v.encode() if t else None) for u, t, v in zip(rows["uk"], rows["vt"], rows["val"])]
        back = decode(encode(int(rows["seq"].iloc[0]), operations))
        return pd.DataFrame([(s, int(k), 0 if v is None else 1, "" if v is None else v.decode()) for s, k, v in back], columns=["seq", "uk", "vt", "val"])

    return events(spark, sf_dir).groupBy(F.expr("(seq - 1) div 64")).applyInPandas(through, "seq long, uk long, vt int, val string")


@query("i15_block_codec", "SELECT g, count(*) AS n, CAST(sum(3 + 12 - shared + strlen(v)) + 4 * ceil(count(*) / 16.0) + 4 AS BIGINT) AS bytes, TRUE AS equal FROM (SELECT g, v, CASE WHEN pos % 16 = 0 THEN 0 ELSE coalesce((SELECT max(i) FROM range(1, 13) t(i) WHERE k[:i] = p[:i]), 0) END AS shared FROM (SELECT g, k, v, row_number() OVER w - 1 AS pos, lag(k) OVER w AS p FROM (SELECT o_orderkey // 1000 AS g, printf('%012d', o_orderkey) AS k, o_orderpriority AS v FROM orders) WINDOW w AS (PARTITION BY g ORDER BY k))) GROUP BY g")
def _(spark, sf_dir):
    """Blocks of keys by thousands, encoded and decoded: entries, bytes, equal."""
    encode, decode = codec.encode_block, codec.decode_block

    def through(rows):
        import pandas as pd

        rows = rows.sort_values("k")
        entries = [(k.encode(), v.encode()) for k, v in zip(rows["k"], rows["v"])]
        block = encode(entries)
        return pd.DataFrame([(int(rows["g"].iloc[0]), len(entries), len(block), decode(block) == entries)], columns=["g", "n", "bytes", "equal"])

    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.expr("o_orderkey div 1000").alias("g"), keys.padded(F.col("o_orderkey"), 12).alias("k"), F.col("o_orderpriority").alias("v"))
    return rows.groupBy("g").applyInPandas(through, "g long, n long, bytes long, equal boolean")


def varint_sql(n: str) -> str:
    return f"array_to_string([printf('%02X', (({n} >> (7 * i)) & 127) | CASE WHEN {n} >> (7 * i + 7) > 0 THEN 128 ELSE 0 END) FOR i IN range(0, 9) IF i = 0 OR {n} >> (7 * i) > 0], '')"


def spread_number() -> Column:
    """A long for each event; past event 200,000, where the SQL's product fails too, it is the product modulo 2**64."""
    return keys.wrapped_product(F.col("event_id"), F.lit(46116860184273))


@query("i2_varint64", f"SELECT event_id, {varint_sql('n')} AS varint, n AS value FROM (SELECT event_id, event_id * 46116860184273 AS n FROM events)")
def _(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", spread_number().alias("n"))
    made = rows.select("event_id", codec.varint64("n").alias("v"))
    return made.select("event_id", F.hex("v").alias("varint"), codec.varint64_value("v").alias("value"))


@query("i5_length_prefixed", f"SELECT doc_id, md5(unhex({varint_sql('n')} || hex(encode(text)))) AS digest FROM (SELECT doc_id, text, strlen(text) AS n FROM documents)")
def _(spark, sf_dir):
    made = codec.prefixed(F.encode("text", "UTF-8"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.md5(made).alias("digest"))


LITTLE = "array_to_string([substr(%s, 2 * i + 1, 2) FOR i IN %s], '')"


@query("i8_little_endian", f"SELECT event_id, {LITTLE % ('w', '[3, 2, 1, 0]')} AS four, {LITTLE % ('h', '[7, 6, 5, 4, 3, 2, 1, 0]')} AS eight, n & 4294967295 AS four_value, n AS eight_value FROM (SELECT event_id, n, printf('%08X', n & 4294967295) AS w, printf('%016X', n) AS h FROM (SELECT event_id, event_id * 46116860184273 AS n FROM events))")
def _(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", spread_number().alias("n"))
    rows = rows.select("event_id", codec.little_int(F.col("n")).alias("w"), codec.little_long(F.col("n")).alias("h"))
    return rows.select("event_id", F.hex("w").alias("four"), F.hex("h").alias("eight"), codec.little_value(F.col("w"), 4).alias("four_value"), codec.little_value(F.col("h"), 8).alias("eight_value"))


@query("i16_footer", f"SELECT run_id, rpad({varint_sql('n')} || {varint_sql('lo')} || {varint_sql('bytes')} || {varint_sql('hi')}, 80, '0') || '57FB808B247547DB' AS footer, n AS meta_at, bytes AS index_at FROM {FILES}")
def _(spark, sf_dir):
    """The footer for the handles (n, lo) and (bytes, hi), and what is read from it."""
    encode, decode = codec.footer, codec.read_footer

    def through(batches):
        import pandas as pd

        for rows in batches:
            made = [encode((n, lo), (b, hi)) for n, lo, b, hi in zip(*(rows[c].tolist() for c in ("n", "lo", "bytes", "hi")))]
            back = [decode(m) for m in made]
            yield pd.DataFrame({"run_id": rows["run_id"], "footer": [m.hex().upper() for m in made], "meta_at": [b[0][0] for b in back], "index_at": [b[1][0] for b in back]})

    return files(spark, sf_dir).select("run_id", "n", "lo", "bytes", "hi").mapInPandas(through, "run_id long, footer string, meta_at long, index_at long")


@query("i19_block_checksum", f"SELECT event_id, ((c >> 15 | ((c * 131072) & 4294967295)) + 2726488792) & 4294967295 AS checksum FROM (SELECT event_id, {CRC % f'list_append({BYTES}, 1::BIGINT)'} AS c FROM events)")
def _(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select("event_id", codec.block_checksum(F.encode("props", "UTF-8"), F.lit(1)).alias("checksum"))


EDIT_KEY = "'10' || printf('%016X', xor({0}, (-9223372036854775808)::BIGINT)::BIGINT) || " + LITTLE % ("printf('%016X', run_id * 256 + 1)", "[7, 6, 5, 4, 3, 2, 1, 0]")


@query("i23_version_edit", f"SELECT run_id, '07' || {varint_sql('level')} || {varint_sql('run_id')} || {varint_sql('bytes')} || {EDIT_KEY.format('lo')} || {EDIT_KEY.format('hi')} AS edit, level, bytes FROM {FILES}")
def _(spark, sf_dir):
    """The manifest's record of each new file, and what is read from it."""
    key = lambda c: codec.internal_key(keys.long_key(F.col(c)), keys.pack(F.col("run_id"), F.lit(1)))
    rows = files(spark, sf_dir).select("run_id", "level", "bytes", key("lo").alias("lo"), key("hi").alias("hi"))
    encode, decode = codec.encode_edit, codec.decode_edit

    def through(batches):
        import pandas as pd

        for rows in batches:
            made = [encode([("new_file", *r)]) for r in zip(*(rows[c].tolist() for c in ("level", "run_id", "bytes", "lo", "hi")))]
            back = [decode(m)[0] for m in made]
            yield pd.DataFrame({"run_id": [b[2] for b in back], "edit": [m.hex().upper() for m in made], "level": [b[1] for b in back], "bytes": [b[3] for b in back]})

    return rows.mapInPandas(through, "run_id long, edit string, level long, bytes long")


@query("i24_slice_hash", f"SELECT event_id, CAST(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS INTEGER) AS hash FROM (SELECT event_id, list_reduce(list_prepend(strlen(props)::BIGINT, {BYTES}), lambda a, b: (a * 31 + b) & 4294967295) AS h FROM events)")
def _(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", codec.slice_hash(F.encode("props", "UTF-8")).alias("hash"))


@query("d16_block_seek", "SELECT g, min(k) FILTER (k >= printf('%012d', g * 1000 + 501)) AS found FROM (SELECT o_orderkey // 1000 AS g, printf('%012d', o_orderkey) AS k FROM orders) GROUP BY g")
def _(spark, sf_dir):
    """The first key from the middle of each block of keys by thousands on, found in the block's bytes."""
    encode, seek = codec.encode_block, codec.block_seek

    def through(rows):
        import pandas as pd

        block = encode([(k.encode(), b"") for k in sorted(rows["k"])])
        g = int(rows["g"].iloc[0])
        hit = seek(block, b"%012d" % (g * 1000 + 501))
        return pd.DataFrame([(g, hit and hit[0].decode())], columns=["g", "found"])

    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.expr("o_orderkey div 1000").alias("g"), keys.padded(F.col("o_orderkey"), 12).alias("k"))
    return rows.groupBy("g").applyInPandas(through, "g long, found string")


@query("a12_log_records", "SELECT doc_id, md5(coalesce(text, '')) AS digest, 0::BIGINT AS dropped FROM documents")
def _(spark, sf_dir):
    """Texts written to chunked logs, a log for each Arrow batch of a task, and read back from the logs' bytes."""
    write, scan = codec.write_log, codec.read_log

    def through(batches):
        import hashlib

        import pandas as pd

        for rows in batches:
            back, dropped = scan(write([(t or "").encode() for t in rows["text"]]))
            yield pd.DataFrame({"doc_id": rows["doc_id"], "digest": [hashlib.md5(b).hexdigest() for b in back], "dropped": dropped})

    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").mapInPandas(through, "doc_id long, digest string, dropped long")


@query("a18_parse_names", "SELECT name, kind, number FROM (SELECT unnest([{'name': printf('%06d.log', run_id), 'kind': 'log', 'number': run_id}, {'name': printf('%06d.sst', run_id), 'kind': 'table', 'number': run_id}, {'name': printf('MANIFEST-%06d', run_id), 'kind': 'descriptor', 'number': run_id}, {'name': printf('%06d.dbtmp', run_id), 'kind': 'temp', 'number': run_id}], recursive := true) FROM " + FILES + ") UNION ALL SELECT * FROM (VALUES ('CURRENT', 'current', 0), ('LOCK', 'lock', 0), ('LOG', 'info_log', 0), ('LOG.old', 'info_log', 0), ('notes.txt', NULL, NULL))")
def _(spark, sf_dir):
    f = files(spark, sf_dir).select("run_id")
    forms = [F.format_string(form, F.col("run_id")) for form in ("%06d.log", "%06d.sst", "MANIFEST-%06d", "%06d.dbtmp")]
    names = f.select(F.explode(F.array(*forms)).alias("name"))
    fixed = spark.createDataFrame([(n,) for n in ("CURRENT", "LOCK", "LOG", "LOG.old", "notes.txt")], "name string")
    return layout.parsed_names(names.union(fixed))


# S. Streams


@query("s2_stream_latest", f"SELECT uk, val FROM {live_sql()}")
def _(spark, sf_dir):
    return stream.latest_by_stream(spark, f"{sf_dir}/events.parquet", lambda rows: rows.selectExpr(
        "user_id AS uk", "event_id + 1 AS seq", "CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS vt",
        "CASE WHEN event_type = 'error' THEN '' ELSE props END AS val"))


@query("s4_exactly_once", f"SELECT uk, seq, vt, val FROM {ML}")
def _(spark, sf_dir):
    rows = events(spark, sf_dir)
    return stream.new_rows(rows.where("seq <= 6000"), rows.where("seq > 4000")).unionByName(rows.where("seq <= 6000"))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)

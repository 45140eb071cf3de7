"""Runs, files and levels: formation, overlap, scores, picks, sizes.

A manifest is a DataFrame of files (run_id, level, n, lo, hi, bytes), which is
small next to the data, but still joined as a table: interval joins cut the key
space into the pieces between neighbouring bounds only where it says so.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvspark.operators.log import running_total
from kvspark.sources.scratch import settled

LEVELS = 7
L0_TRIGGER, L0_SLOWDOWN, L0_STOP = 4, 8, 12
LEVEL_BYTES = 10 * (1 << 20)
GRANDPARENT_BYTES = 20 * (1 << 20)
OUTPUT_BYTES = 2 * (1 << 20)
SEEK_BYTES, SEEK_LEAST = 16_384, 100


def with_runs(log: DataFrame, size: Column, buffer: int, segment_size: int = 1 << 20) -> DataFrame:
    """The log with run_id: the number of whole buffers written before the row."""
    total = running_total(log.withColumn("b", size), F.col("seq"), F.col("b"), "__t", F.expr(f"seq div {segment_size}"))
    return total.withColumn("run_id", F.expr(f"(__t - b) div {buffer}")).drop("__t")


def exact_runs(log: DataFrame, size: Column, buffer: int, shard: Column | None = None, segment_size: int = 1 << 18) -> DataFrame:
    """shard, run_id, n, lo, hi, bytes: a run ends before the write that finds its use above ``buffer``.

    The rule is a fold in write order over a shard (one writer's log). Its segments of
    ``segment_size`` sequence numbers are folded side by side: how one is cut hangs on
    the use at its start only, and by that on where its first cut is. ``outcomes`` tells
    what follows from each first cut that can be, at most a buffer's distinct sums for a
    segment; ``enter`` goes through a shard's segments by them; ``fold`` cuts the rows. A
    run over several segments is put together at the end. Sizes aren't negative; after
    one that is null the use is null and nothing is cut, as in SQL.
    """
    unknown, never = -(1 << 62), (1 << 63) - 1  # a use that no size lifts above the buffer, a sum that no use reaches

    def sums(rows: pd.DataFrame) -> tuple[np.ndarray, int, bool]:
        """The use before each row and after the last, counted from the first, up to a null; the rows up to it; whether there is one."""
        known = rows["b"].notna().to_numpy()
        n = len(rows) if known.all() else int(known.argmin())
        return np.concatenate(([0], np.cumsum(rows["b"].to_numpy()[:n].astype(np.int64)))), n, n < len(rows)

    def outcomes(rows: pd.DataFrame) -> pd.DataFrame:
        """For each first cut: the sum before it, cuts from there on, the use at the end; without a cut (sum ``never``) the segment's sum."""
        total, n, broken = sums(rows.sort_values("seq"))
        places = n + broken  # a null entry can still begin a run
        then = np.searchsorted(total, total[:places] + buffer, side="right").tolist()
        cuts, last = [1] * places, list(range(places))
        for i in range(places - 1, -1, -1):
            if then[i] < places:
                cuts[i], last[i] = cuts[then[i]] + 1, last[then[i]]
        first = np.flatnonzero(np.concatenate(([True], (np.diff(total[:places]) > 0) & (total[: places - 1] <= buffer))))
        end = [unknown if broken else int(total[n] - total[at]) for at in [*(last[i] for i in first), 0]]
        out = pd.DataFrame({"before": [*total[first].tolist(), never], "cuts": [*(cuts[i] for i in first), 0], "used": end})
        return out.assign(shard=rows["shard"].iloc[0], segment=rows["segment"].iloc[0])

    def enter(rows: pd.DataFrame) -> pd.DataFrame:
        """Use and run at the start of each segment."""
        used, run, starts = 0, 0, []
        for segment, part in rows.sort_values(["segment", "before"]).groupby("segment"):
            starts.append((segment, used, run))
            at = int(np.searchsorted(part["before"].to_numpy(), buffer - used, side="right"))
            cuts, end = int(part["cuts"].iloc[at]), int(part["used"].iloc[at])
            used, run = end if cuts or end == unknown else used + end, run + cuts
        return pd.DataFrame(starts, columns=["segment", "used", "run"]).assign(shard=rows["shard"].iloc[0])

    def fold(rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        total, n, broken = sums(rows)
        begins = np.zeros(len(rows), dtype=np.int64)
        at = int(np.searchsorted(total, buffer - int(start["used"].iloc[0]), side="right"))
        while at < n + broken:
            begins[at] = 1
            at = int(np.searchsorted(total, total[at] + buffer, side="right"))
        out = rows.assign(run_id=int(start["run"].iloc[0]) + np.cumsum(begins)).groupby(["shard", "run_id"], as_index=False)
        return out.agg(n=("b", "size"), lo=("uk", "min"), hi=("uk", "max"), bytes=("b", "sum"))

    key = log.schema["uk"].dataType.simpleString()
    few = log.select((shard if shard is not None else F.lit(0)).cast("int").alias("shard"), F.expr(f"seq div {segment_size}").alias("segment"), "uk", "seq", size.cast("long").alias("b"))
    parts = few.groupBy("shard", "segment")
    told = parts.applyInPandas(outcomes, "shard int, segment long, before long, cuts long, used long")
    starts = told.groupBy("shard").applyInPandas(enter, "shard int, segment long, used long, run long")
    pieces = parts.cogroup(starts.groupBy("shard", "segment")).applyInPandas(fold, f"shard int, run_id long, n long, lo {key}, hi {key}, bytes long")
    return pieces.groupBy("shard", "run_id").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("bytes").alias("bytes"))


def manifest(log: DataFrame, size: Column, buffer: int, levels: int = 3) -> DataFrame:
    """Files of the runs, dealt to levels in turn."""
    runs = with_runs(log, size, buffer).groupBy("run_id").agg(
        F.count("*").alias("n"), F.min("uk").alias("lo"), F.max("uk").alias("hi"), F.sum("b").cast("long").alias("bytes")
    )
    return runs.select("run_id", (F.col("run_id") % levels).alias("level"), "n", "lo", "hi", "bytes")


def overlaps(files: DataFrame, lo, hi, level: int | None = None) -> DataFrame:
    """Files whose range meets [lo, hi], both bounds included."""
    inside = (F.col("lo") <= F.lit(hi)) & (F.col("hi") >= F.lit(lo))
    return files.where(inside if level is None else inside & (F.col("level") == level))


def overlapping_pairs(files: DataFrame) -> DataFrame:
    """a < b: files with a common key range."""
    a, b = files.select(F.col("run_id").alias("a"), F.col("lo").alias("al"), F.col("hi").alias("ah")), files.select(
        F.col("run_id").alias("b"), F.col("lo").alias("bl"), F.col("hi").alias("bh")
    )
    return a.join(b, F.expr("a < b AND al <= bh AND bl <= ah")).select("a", "b")


def next_level_overlap(files: DataFrame) -> DataFrame:
    """run_id and ov: bytes of the next level's files that it overlaps; the last level has none below."""
    below = files.select((F.col("level") - 1).alias("up"), F.col("lo").alias("bl"), F.col("hi").alias("bh"), F.col("bytes").alias("bb"))
    joined = files.join(below, F.expr("level = up AND bh >= lo AND bl <= hi"), "left")
    return joined.groupBy("run_id").agg(F.coalesce(F.sum("bb"), F.lit(0)).cast("long").alias("ov"))


def level_scores(files: DataFrame) -> DataFrame:
    """level, files, bytes, score: files over the trigger at level 0, bytes over the level's limit below."""
    sums = files.groupBy("level").agg(F.count("*").alias("files"), F.sum("bytes").cast("long").alias("bytes"))
    limit = F.lit(float(LEVEL_BYTES)) * F.pow(F.lit(10.0), F.col("level") - 1)
    score = F.when(F.col("level") == 0, F.col("files") / F.lit(float(L0_TRIGGER))).otherwise(F.col("bytes") / limit)
    return sums.withColumn("score", score)


def needs_compaction(files: DataFrame) -> DataFrame:
    """level, score, due for the level of the largest score, the first of equal ones."""
    best = level_scores(files).orderBy(F.desc("score"), "level").limit(1)
    return best.select("level", "score", (F.col("score") >= 1).alias("due"))


def stall_state(files: DataFrame) -> DataFrame:
    """level, files, state (stop, slow, run) of writes."""
    n = files.where("level = 0").agg(F.count("*").alias("files"))
    state = F.when(F.col("files") >= L0_STOP, "stop").when(F.col("files") > L0_SLOWDOWN, "slow").otherwise("run")
    return n.select(F.lit(0).cast("long").alias("level"), "files", state.alias("state"))


def pick(files: DataFrame, pointer: Column) -> DataFrame:
    """level, run_id: the first file past the level's pointer (by its largest key), else the level's first."""
    key = F.struct("lo", "run_id")
    both = files.groupBy("level").agg(
        F.min(F.when(F.col("hi") > pointer, key)).alias("past"), F.min(key).alias("head")
    )
    return both.select("level", F.coalesce("past.run_id", "head.run_id").alias("run_id"))


def compaction_inputs(files: DataFrame, chosen: DataFrame) -> DataFrame:
    """level, run_id, role (input, next, grandparent) for each chosen file (level, run_id).

    At level 0 the inputs are all files that overlap the chosen one, once and not
    transitively; the next level's are those that overlap the inputs' range; inputs
    grow if that adds nothing to the next level; grandparents overlap all of it.
    """

    files = settled(files, "files")  # a manifest is small, and each step below reads it again

    def meet(bounds: DataFrame, depth: int) -> DataFrame:
        b = bounds.select(F.col("pick"), (F.col("at") + depth).alias("want"), F.col("lo").alias("bl"), F.col("hi").alias("bh"))
        return files.join(b, F.expr("level = want AND lo <= bh AND hi >= bl"))

    def span(rows: DataFrame) -> DataFrame:
        return rows.groupBy("pick", "at").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))

    mine = files.join(chosen.select("level", "run_id"), ["level", "run_id"]).select(F.col("run_id").alias("pick"), F.col("level").alias("at"), "lo", "hi", "run_id")
    wide = meet(mine.where("at = 0"), 0).select("pick", F.lit(0).cast("long").alias("at"), "lo", "hi", "run_id")
    first = settled(mine.where("at > 0").unionByName(wide), "inputs")
    bounds = span(first)
    next1 = settled(meet(bounds, 1).select("pick", (F.col("level") - 1).alias("at"), "lo", "hi", "run_id"), "next")
    all1 = span(first.unionByName(next1))
    grown = settled(meet(all1, 0).select("pick", F.col("level").alias("at"), "lo", "hi", "run_id"), "inputs")
    next2 = settled(meet(span(grown), 1).select("pick", (F.col("level") - 1).alias("at"), "lo", "hi", "run_id"), "next")
    count = lambda rows, name: rows.groupBy("pick").agg(F.count("*").alias(name))
    sizes = count(first, "f").join(count(grown, "g"), "pick").join(count(next1, "n1"), "pick", "left").join(count(next2, "n2"), "pick", "left")
    expand = settled(sizes.where("n1 IS NOT NULL AND g > f AND n2 = n1").select("pick"), "grow")
    inputs = settled(first.join(expand, "pick", "left_anti").unionByName(grown.join(expand, "pick", "left_semi").select(first.columns)), "inputs")
    nexts = settled(next1.join(expand, "pick", "left_anti").unionByName(next2.join(expand, "pick", "left_semi").select(next1.columns)), "next")
    grand = meet(span(inputs.unionByName(nexts)), 2)
    return (
        inputs.select("pick", F.col("at").alias("level"), "run_id", F.lit("input").alias("role"))
        .unionByName(nexts.select("pick", (F.col("at") + 1).alias("level"), "run_id", F.lit("next").alias("role")))
        .unionByName(grand.select("pick", "level", "run_id", F.lit("grandparent").alias("role")))
    )


def trivial_moves(files: DataFrame, inputs: DataFrame) -> DataFrame:
    """pick, trivial: one input, nothing in the next level, few bytes among the grandparents."""
    sized = inputs.join(files.select("run_id", "bytes"), "run_id")
    count = lambda role: F.sum(F.when(F.col("role") == role, 1).otherwise(0))
    heavy = F.sum(F.when(F.col("role") == "grandparent", F.col("bytes")).otherwise(0))
    ok = (count("input") == 1) & (count("next") == 0) & (heavy <= GRANDPARENT_BYTES)
    return sized.groupBy("pick").agg(ok.alias("trivial"))


def output_level(files: DataFrame, new: DataFrame) -> DataFrame:
    """run_id and level (0 to 2) for new files (run_id, lo, hi): down while nothing overlaps and grandparents are light."""
    near = new.select(F.col("run_id").alias("nr"), F.col("lo").alias("nl"), F.col("hi").alias("nh"))
    met = near.join(files, F.expr("lo <= nh AND hi >= nl"), "left").groupBy("nr").agg(
        *[F.coalesce(F.sum(F.when(F.col("level") == i, F.col("bytes"))), F.lit(-1)).alias(f"l{i}") for i in range(4)]
    )
    one = (F.col("l0") < 0) & (F.col("l1") < 0) & (F.col("l2") <= GRANDPARENT_BYTES)
    two = one & (F.col("l2") < 0) & (F.col("l3") <= GRANDPARENT_BYTES)
    return met.select(F.col("nr").alias("run_id"), F.when(two, 2).when(one, 1).otherwise(0).cast("long").alias("level"))


def probe_order(keys: DataFrame, files: DataFrame) -> DataFrame:
    """uk, level, run_id, probe_order: the files that a lookup reads, newest first at level 0, then downwards."""
    met = keys.join(files, F.expr("lo <= uk AND hi >= uk"))
    order = Window.partitionBy("uk").orderBy("level", F.when(F.col("level") == 0, -F.col("run_id")).otherwise(F.col("run_id")))
    return met.select("uk", "level", "run_id", F.row_number().over(order).cast("long").alias("probe_order"))


def seek_budget(files: DataFrame, keys: DataFrame) -> DataFrame:
    """run_id, allowed_seeks, probes: lookups that a file may be charged for, and keys in its range."""
    met = files.join(keys.select("uk"), F.expr("lo <= uk AND hi >= uk"), "left")
    counted = met.groupBy("run_id", "bytes").agg(F.count("uk").alias("probes"))
    allowed = F.greatest(F.lit(SEEK_LEAST).cast("long"), F.expr(f"bytes div {SEEK_BYTES}"))
    return counted.select("run_id", allowed.alias("allowed_seeks"), "probes")


def non_overlap(files: DataFrame) -> DataFrame:
    """level, bad: files that start no later than the one before them ends."""
    before = F.lag("hi").over(Window.partitionBy("level").orderBy("lo", "run_id"))
    marked = files.withColumn("__bad", F.when(before >= F.col("lo"), 1).otherwise(0))
    return marked.groupBy("level").agg(F.sum("__bad").cast("long").alias("bad"))


def approximate_sizes(log: DataFrame, ranges: DataFrame, size: Column) -> DataFrame:
    """id, bytes of the entries with start <= key < limit; a reversed range has 0."""
    sized = log.groupBy("uk").agg(F.sum(size).alias("__b"))
    met = ranges.join(sized, F.expr("uk >= start AND uk < limit"), "left")
    return met.groupBy("id").agg(F.coalesce(F.sum("__b"), F.lit(0)).cast("long").alias("bytes"))


def approximate_offset(files: DataFrame, keys: DataFrame) -> DataFrame:
    """id, bytes before the key: whole files before it, half of those that hold it."""
    part = F.when(F.col("hi") < F.col("uk"), F.col("bytes")).when(F.col("lo") <= F.col("uk"), F.expr("bytes div 2")).otherwise(0)
    return keys.join(files, F.expr("lo <= uk"), "left").groupBy("id").agg(F.coalesce(F.sum(part), F.lit(0)).cast("long").alias("bytes"))


def file_offsets(entries: DataFrame, size: Column) -> DataFrame:
    """Entries (run_id, uk, seq) with the bytes of their file up to and with them."""
    order = Window.partitionBy("run_id").orderBy("uk", F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("bytes", F.sum(size).over(order).cast("long"))


def output_files(log: DataFrame, size: Column, limit: int, segment: Column) -> DataFrame:
    """file_no, n, lo, hi: the log in key order, a new file for each ``limit`` bytes; a key isn't split."""
    keys = log.groupBy("uk").agg(F.sum(size).alias("b"), F.count("*").alias("n"))
    total = running_total(keys, F.col("uk"), F.col("b"), "t", segment)
    return total.groupBy(F.expr(f"(t - b) div {limit}").alias("file_no")).agg(
        F.sum("n").cast("long").alias("n"), F.min("uk").alias("lo"), F.max("uk").alias("hi")
    )


def replay(edits: DataFrame) -> DataFrame:
    """level, run_id of the files that are there after all edits (edit_no, action, level, run_id)."""
    last = edits.groupBy("level", "run_id").agg(F.max_by("action", "edit_no").alias("action"))
    return last.where("action = 'add'").select("level", "run_id")


def obsolete(files: DataFrame, live: DataFrame) -> DataFrame:
    return files.select("run_id").join(live.select("run_id"), "run_id", "left_anti")


def file_names(files: DataFrame) -> DataFrame:
    """run_id, file_name and the type that the name tells."""
    name = F.format_string("%06d.sst", F.col("run_id"))
    kind = F.when(F.regexp_extract(name, r"^\d{6,}\.(\w+)$", 1) == "sst", "table").otherwise("other")
    return files.select("run_id", name.alias("file_name"), kind.alias("file_type"))


def parsed_names(names: DataFrame) -> DataFrame:
    """name, kind, number: what the store's file names tell; null for other files."""
    name, number = F.col("name"), F.regexp_extract("name", r"(\d+)", 1)
    kind = F.when(name.isin("LOG", "LOG.old"), "info_log").when(name.isin("CURRENT", "LOCK"), F.lower("name"))
    for form, told in ((r"^\d+\.log$", "log"), (r"^\d+\.sst$", "table"), (r"^MANIFEST-\d+$", "descriptor"), (r"^\d+\.dbtmp$", "temp")):
        kind = kind.when(name.rlike(form), told)
    known = names.select(name, kind.alias("kind"), number.alias("number"))
    return known.withColumn("number", F.when(F.col("kind").isNotNull(), F.coalesce(F.expr("try_cast(number AS long)"), F.lit(0).cast("long"))))


def block_estimate(entries: DataFrame, key_bytes: Column, value_bytes: Column, restart: int) -> DataFrame:
    """bytes of one block of entries (with shared): three lengths, what isn't shared, values, restart places, their number."""
    from kvspark.functions.keys import varint_size

    own = key_bytes - F.col("shared")
    size = varint_size(F.col("shared")) + varint_size(own) + varint_size(value_bytes) + own + value_bytes
    places = F.ceil(F.count("*") / F.lit(restart)) * 4 + 4
    return entries.agg((F.sum(size) + places).cast("long").alias("bytes"))

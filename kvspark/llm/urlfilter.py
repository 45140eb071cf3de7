"""URL filter by link-graph propagation, in DataFrame functions only.

Rules on hosts and path prefixes decide the urls that they fit. For the others,
their host decides: pages that a rule allows are seeds of trust, pages that one
blocks are seeds of distrust, each weighing its host by their number. Trust is a
personalised PageRank along the links between hosts; distrust is one along the
reversed links, so that it flows to those who link to blocked hosts. A host is
blocked when its distrust is at least ``share`` percent of the sum of both.

Mass is a double, 1 for a seed page, so that no host that a walk reaches has none,
however many links divide it. A share within ``NEAR`` of the bound counts as on it, so
that verdicts don't depend on the order of additions. ``judge_sql`` counts in integers
(``UNIT`` for a seed page, floor division) and fits graphs that lose nothing by it. Links are absolute or
scheme-relative ``href``s; links within a host don't count. Hosts and links are
aggregated before they are shuffled; the state of the rounds is a table of hosts.

Defined results: a null url, or one without ``://``, has an empty host and path,
fits no rule and is allowed; null html has no links; a host without seeds or
inflow is allowed; repeated rows count and are returned each; an empty table
gives an empty result; extra columns are ignored. Of rules of one length the one
that stands first wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvspark.llm._common import written

UNIT, DAMPING = 1_000_000, 85
NEAR = 1e-9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'\s<>]+)"""

#: (verdict, host, path prefix)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null without one."""
    rule = verdict = None
    for what, name, prefix in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        rule = F.when(fits, name + prefix) if rule is None else rule.when(fits, name + prefix)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def propagate(seeds: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """kind, host, mass after ``rounds`` rounds from ``seeds`` (kind, host, mass) over ``edges`` (kind, a, b)."""
    base = seeds.selectExpr("kind", "host", f"mass * {100 - DAMPING} / 100 AS mass")
    if edges.limit(1).count() == 0:
        return base
    degree = edges.groupBy("kind", "a").agg(F.count("*").alias("degree"))
    edges = written(edges.join(degree, ["kind", "a"]), "links")
    state = seeds
    for i in range(rounds):
        flow = edges.join(state.withColumnRenamed("host", "a"), ["kind", "a"])
        flow = flow.selectExpr("kind", "b AS host", f"mass * {DAMPING} / 100 / degree AS mass")
        state = flow.union(base).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        if i % 3 == 2:
            state = written(state, "mass")
    return state


def judge_urls(pages: DataFrame, rules: tuple = RULES, rounds: int = 10, share: int = 50) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages``."""
    host, path = host_and_path(pages["url"])
    told = pages.select(pages["page_id"], host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    told = told.withColumns({"rule": rule, "ruled": verdict})
    counts = told.where("host != ''").groupBy("host").agg(
        F.sum(F.when(F.col("ruled") == "allow", 1).otherwise(0)).alias("t"),
        F.sum(F.when(F.col("ruled") == "block", 1).otherwise(0)).alias("d"),
    )
    counts = written(counts, "hosts")
    seeds = counts.selectExpr("stack(2, 't', CAST(t AS DOUBLE), 'd', CAST(d AS DOUBLE)) AS (kind, mass)", "host")
    seeds = seeds.where("mass > 0").select("kind", "host", "mass")
    found = pages.select(host.alias("a"), F.explode(F.regexp_extract_all(pages["html"], F.lit(LINK), F.lit(1))).alias("b"))
    links = found.select("a", F.translate("b", UPPER, LOWER).alias("b")).where("a != '' and a != b").distinct()
    links = written(links, "edges")
    edges = links.selectExpr("'t' AS kind", "a", "b").union(links.selectExpr("'d' AS kind", "b AS a", "a AS b"))
    mass = propagate(seeds, edges, rounds).groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "t", F.col("mass")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("kind") == "d", F.col("mass")).otherwise(0.0)).alias("distrust"),
    )
    bad = mass.where(f"distrust > 0 and distrust * 100 >= (trust + distrust) * {share} * {1 - NEAR!r}D")
    bad = bad.select("host", F.lit("block").alias("method"))
    out = told.join(bad, "host", "left")
    said = F.coalesce("ruled", "method", F.lit("allow")).alias("verdict")
    return out.select("page_id", "host", "path", "rule", said)


def judge_sql(rules: tuple = RULES, rounds: int = 10, share: int = 50) -> str:
    """The same in SQL, the rounds written out."""

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [
        f"WHEN (host = {quoted(h)} OR ends_with(host, {quoted('.' + h)})) AND starts_with(path, {quoted(p)}) THEN "
        for _, h, p in ordered
    ]
    rule = "CASE " + " ".join(f + quoted(h + p) for f, (_, h, p) in zip(fits, ordered, strict=True)) + " END"
    ruled = "CASE " + " ".join(f + quoted(w) for f, (w, _, _) in zip(fits, ordered, strict=True)) + " END"
    lower = f"translate(%s, '{UPPER}', '{LOWER}')"
    host = lower % "regexp_extract(rest, '^([^/?#]*)', 1)"
    steps = ", ".join(
        f"m{i + 1} AS (SELECT kind, host, CAST(sum(mass) AS BIGINT) AS mass FROM ("
        f"SELECT e.kind, e.b AS host, m.mass * {DAMPING} // 100 // e.degree AS mass FROM e JOIN m{i} m ON m.kind = e.kind AND m.host = e.a "
        f"UNION ALL SELECT kind, host, mass * {100 - DAMPING} // 100 FROM m0) GROUP BY kind, host)"
        for i in range(rounds)
    )
    return (
        f"WITH p AS (SELECT *, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages), "
        f"q AS (SELECT page_id, html, {host} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p), "
        f"r AS (SELECT *, {rule} AS rule, {ruled} AS ruled FROM q), "
        f"c AS (SELECT host, count(*) FILTER (ruled = 'allow') AS t, count(*) FILTER (ruled = 'block') AS d FROM r WHERE host <> '' GROUP BY host), "
        f"m0 AS (SELECT 't' AS kind, host, CAST(t * {UNIT} AS BIGINT) AS mass FROM c WHERE t > 0 UNION ALL SELECT 'd', host, CAST(d * {UNIT} AS BIGINT) FROM c WHERE d > 0), "
        f"l AS (SELECT DISTINCT a, b FROM (SELECT host AS a, {lower % ('unnest(regexp_extract_all(html, ' + quoted(LINK) + ', 1))')} AS b FROM r) WHERE a <> '' AND a <> b), "
        f"k AS (SELECT 't' AS kind, a, b FROM l UNION ALL SELECT 'd', b, a FROM l), "
        f"e AS (SELECT *, count(*) OVER (PARTITION BY kind, a) AS degree FROM k), {steps}, "
        f"s AS (SELECT host, sum(CASE WHEN kind = 't' THEN mass ELSE 0 END) AS trust, sum(CASE WHEN kind = 'd' THEN mass ELSE 0 END) AS distrust FROM m{rounds} GROUP BY host), "
        f"b AS (SELECT host FROM s WHERE distrust > 0 AND distrust * 100 >= (trust + distrust) * {share}) "
        f"SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.ruled, CASE WHEN b.host IS NOT NULL THEN 'block' END, 'allow') AS verdict "
        f"FROM r LEFT JOIN b ON b.host = r.host"
    )

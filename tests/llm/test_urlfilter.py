import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb

from kvspark.llm.urlfilter import DAMPING, LINK, RULES, UNIT, judge_sql, judge_urls

PAGES = "page_id long, url string, html string, host string"
ROWS = [
    (1, "http://A.example.com/en/1", '<a href="https://good.example.net/x">'),
    (2, "http://a.example.com/en/71?x", '<a href="//hub.test/">'),
    (3, "https://good.example.net/de/1#t", None),
    (4, "https://good.example.net/fr/2", "<a HREF='http://hub.test'>"),
    (5, "https://hub.test", '<a href="http://bad.org/es/">'),
    (6, "https://bad.org/es/9", '<a href="/es/1">'),
    (7, "https://bad.org/x?y", ""),
    (8, "https://lone.test/a/b", ""),
    (9, None, '<a href="http://bad.org">'),
    (10, "no scheme", ""),
    (11, "ftp://example.net/de/80", ""),
    (11, "ftp://example.net/de/80", ""),
    (12, "x://evil.netx/de/", '<a href="http://bad.org"> <a href="http://hub.test">'),
    (13, "https://fan.test/", '<a href="http://bad.org">'),
]


def brute(rows, rounds=10, share=50):
    out, seeds, edges = [], {"t": defaultdict(int), "d": defaultdict(int)}, set()
    for page_id, url, html in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = host.lower()
        fit = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        best = max(fit, key=lambda r: len(r[1] + r[2]), default=None)
        if best and host:
            seeds["t" if best[0] == "allow" else "d"][host] += UNIT
        if host:
            edges |= {(host, b.lower()) for b in re.findall(LINK, html or "") if b.lower() != host}
        out.append([page_id, host, path, best and best[1] + best[2], best and best[0]])
    mass = {}
    for kind, links in (("t", edges), ("d", {(b, a) for a, b in edges})):
        degree = defaultdict(int)
        for a, _ in links:
            degree[a] += 1
        now = dict(seeds[kind])
        for _ in range(rounds):
            new = {h: m * (100 - DAMPING) // 100 for h, m in seeds[kind].items()}
            for a, b in links:
                if a in now:
                    new[b] = new.get(b, 0) + now[a] * DAMPING // 100 // degree[a]
            now = new
        mass[kind] = now
    for row in out:
        d, t = mass["d"].get(row[1], 0), mass["t"].get(row[1], 0)
        row[4] = row[4] or ("block" if d > 0 and d * 100 >= (t + d) * share else "allow")
    return sorted(map(tuple, out), key=str)


def test_against_brute_force_and_sql(spark):
    pages = spark.createDataFrame([(*r, "clash") for r in ROWS], PAGES)
    got = sorted(map(tuple, judge_urls(pages).collect()), key=str)
    assert got == brute(ROWS)
    assert {r[0]: r[4] for r in got}[13] == "block"  # links to a blocked host
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", ROWS)
    assert sorted(con.execute(judge_sql()).fetchall(), key=str) == got


def test_empty(spark):
    assert judge_urls(spark.createDataFrame([], PAGES)).count() == 0


def test_no_python(spark):
    plan = judge_urls(spark.createDataFrame([(*r, "x") for r in ROWS], PAGES))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def exact(rows, rounds=10, share=50):
    """brute, in rational numbers."""
    out, seeds, edges = [], {"t": defaultdict(int), "d": defaultdict(int)}, set()
    for page_id, url, html in rows:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        fit = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        best = max(fit, key=lambda r: len(r[1] + r[2]), default=None)
        if best:
            seeds["t" if best[0] == "allow" else "d"][host] += 1
        edges |= {(host, b) for b in re.findall(LINK, html) if b != host}
        out.append((page_id, host, best and best[0]))
    mass = {}
    for kind, links in (("t", edges), ("d", {(b, a) for a, b in edges})):
        degree, now = Counter(a for a, _ in links), dict(seeds[kind])
        for _ in range(rounds):
            new = {h: Fraction(m * (100 - DAMPING), 100) for h, m in seeds[kind].items()}
            for a, b in links:
                if a in now:
                    new[b] = new.get(b, 0) + now[a] * DAMPING / 100 / degree[a]
            now = new
        mass[kind] = now
    said = {}
    for page_id, host, ruled in out:
        d, t = mass["d"].get(host, 0), mass["t"].get(host, 0)
        said[page_id] = ruled or ("block" if d > 0 and d * 100 >= (t + d) * share else "allow")
    return said


def link(*hosts):
    return " ".join(f'<a href="http://{h}/">' for h in hosts)


def test_mass_survives_hubs(spark):
    """1,200 hosts link to a blocked one, 1,000 to one of these, 1,000 to one of those; trust and a tie likewise."""
    rows = [("https://bad.org/es/1", "")]
    rows += [(f"https://a{i}.test/", link("bad.org")) for i in range(1200)]
    rows += [(f"https://b{i}.test/", link("a0.test")) for i in range(1000)]
    rows += [(f"https://c{i}.test/", link("b0.test")) for i in range(1000)]
    rows += [("https://good.net/de/1", link(*[f"t{i}.test" for i in range(1200)]))]
    rows += [("https://t0.test/", link(*[f"u{i}.test" for i in range(1000)], "b1.test"))]
    rows += [("https://u0.test/", link("c1.test", "c2.test")), ("https://tie.test/", link("worse.org")), ("https://fine.net/de/", link("tie.test")), ("https://worse.org/es/", "")]
    rows = [(i, *r) for i, r in enumerate(rows)]
    got = {r["page_id"]: r["verdict"] for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == exact(rows)
    of = {url: got[i] for i, url, _ in rows}
    assert of["https://c5.test/"] == "block" and of["https://u0.test/"] == "allow" and of["https://tie.test/"] == "block"


def test_mass_survives_the_largest_degrees(spark):
    """A chain of four hosts of 100,000 links each."""
    from kvspark.llm.urlfilter import propagate

    seeds = spark.createDataFrame([("d", "h0", 1.0)], "kind string, host string, mass double")
    edges = spark.range(4).selectExpr("'d' AS kind", "concat('h', id) AS a", "explode(sequence(1, 100000)) AS i", "id")
    edges = edges.selectExpr("kind", "a", "if(i = 1, concat('h', id + 1), concat('x', id, '-', i)) AS b")
    last = propagate(seeds, edges, 4).where("host = 'h4'").first()["mass"]
    assert abs(last / (0.85e-5**4) - 1) < 1e-9

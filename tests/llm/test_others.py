"""Operators over pages, conversations and embeddings."""

from __future__ import annotations

import hashlib
import importlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from terrane.llm import additive, chat, covertree, urlfilter

F = pytest.importorskip("pyspark.sql.functions")

# --- 2: URLs -----------------------------------------------------------------------------------------------------------------------------

URLS = [
    (1, "http://a.COM/en/x", None),
    (2, "https://example.com/en/77?q#f", ""),
    (3, "http://sub.example.net/de/81", None),
    (4, "http://x.net/de/81", None),
    (5, "http://b.info/p", '<link rel="canonical" href="http://a.com/en/x">'),
    (6, "http://c.info/p?x=1", "<meta http-equiv='refresh' content='0; url=http://b.info/p#z'>"),
    (7, "http://d.info/", '<link rel="canonical" href="/other">'),
    (8, "http://y.net/de/1", '<link rel="canonical" href="http://b.info/p">'),
    (9, None, "<p>"),
    (10, "no scheme", None),
    (11, "x://", None),
    (12, "http://évil.com/en/", None),
    (13, "http://notexample.net/de/8", None),
    (1, "http://a.COM/en/x", None),
]


def test_urls(spark):
    pages = spark.createDataFrame([(*u, "clash", True) for u in URLS], "page_id long, url string, html string, host string, verdict boolean")
    got = defaultdict(list)
    for r in urlfilter.judge(pages).collect():
        got[r.page_id].append((r.host, r.path, r.rule, r.verdict))
    assert got[1] == [("a.com", "/en/x", "com/en/", "block")] * 2
    assert got[2] == [("example.com", "/en/77", "example.com/en/7", "allow")]
    assert got[3] == [("sub.example.net", "/de/81", "example.net/de/8", "block")]
    assert got[4] == [("x.net", "/de/81", "net/de/", "allow")]
    assert got[5] == [("b.info", "/p", None, "block")] and got[6] == [("c.info", "/p", None, "block")]
    assert got[7] == [("d.info", "/", None, "allow")]
    assert got[8] == [("y.net", "/de/1", "net/de/", "allow")]  # an explicit allow stands in a blocked component
    assert got[9] == got[10] == [("", "", None, "allow")] and got[11] == [("", "", None, "allow")]
    assert got[12][0][3] == "block" and got[13] == [("notexample.net", "/de/8", "net/de/", "allow")]
    assert urlfilter.judge(pages.limit(0)).count() == 0


FORMS = [
    '<link rel="canonical" href="http://a.com/en/x">',
    "<link href=http://a.com/en/x rel=canonical>",
    "<LINK HREF='http://a.com/en/x' type=\"a>b\" REL='Canonical'/>",
    '<link href="http://a.com/en/x" rel="alternate canonical" />',
    '<link\n href = " http://a.com/en/x "\n rel = canonical\n>',
    "<link href=http://a.com/en/x rel=canonical/>",
    '<link rel=icon href=/i><link data-rel="x" href="&#47;/a.com/en/x?a=1&amp;b" rel="canonical">',
    '<meta http-equiv="refresh" content="0; url=http://a.com/en/x">',
    "<meta content=\"0; url='http://a.com/en/x'\" http-equiv=refresh>",
    "<meta content='0;URL = \"http://a.com/en/x\"' http-equiv='Refresh' />",
    '<meta http-equiv=refresh content=0;url=http://a.com/en/x>',
    '<meta charset=utf-8><meta content="5, http://a.com/en/x?url=http://b.info/" http-equiv="refresh">',
    '<link rel=canonical href=http://q.info/z><link rel=canonical href=http://a.com/en/x>',
]
RELATIVE = [
    ("/t", "/t"), ("t", "/u/v/t"), ("./t", "/u/v/t"), ("../t", "/u/t"), ("../../../t?x#y", "/t"), ("..", "/u/"), ("t/.", "/u/v/t/"), ("?x=http://b.info/", "/u/v/w"), ("t:u/v", None), ("./t:u", "/u/v/t:u"), ("mailto:a@b.c", None), ("go?u=http://b.info/p", "/u/v/go"),
]


def test_links_in_all_forms(spark):
    rows = [(i, f"http://p{i}.info/", f"<head>{t}</head>") for i, t in enumerate(FORMS)]
    rows += [(90, "http://n.info/", "<link href=http://a.com/en/x rel=stylesheet><meta name=refresh content='0; url=http://a.com/en/x'>")]
    got = {r.page_id: r.verdict for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: "block" for i in range(len(FORMS))}, 90: "allow"}


def test_relative_links_are_resolved(spark):
    rows = [(f"http://h{i}.info/u/v/w?k", f'<link href="{t}" rel=canonical>') for i, (t, _) in enumerate(RELATIVE)]
    rows += [("http://bare.info", "<meta content='0;url=t' http-equiv=refresh>"), (None, FORMS[0]), ("no scheme", FORMS[0]), ("http://none.info/", None)]
    got = {(r.host, r.to_path) for r in urlfilter.page_edges(spark.createDataFrame(rows, "url string, html string")).where("to_host = host").collect()}
    assert got == {*((f"h{i}.info", p) for i, (_, p) in enumerate(RELATIVE) if p), ("bare.info", "/t")}
    assert urlfilter.targets("<link " * 200_000) == [] and urlfilter.targets("<link rel=canonical href=\"" * 1000 + "=" * 100_000) is not None


def brute_verdicts(pages):
    """Verdicts by the standard library's HTML parser and URL joining, and a search over the links' graph."""
    from html.parser import HTMLParser
    from urllib.parse import urljoin

    class Links(HTMLParser):
        def __init__(self):
            super().__init__()
            self.found = []

        def handle_starttag(self, tag, attrs):
            a = dict(reversed([(k, v or "") for k, v in attrs]))
            if tag == "link" and "canonical" in a.get("rel", "").lower().split() and a.get("href"):
                self.found.append(a["href"].strip())
            if tag == "meta" and a.get("http-equiv", "").lower() == "refresh" and "url=" in a.get("content", ""):
                self.found.append(a["content"].split("url=", 1)[1].strip("' "))

    def node(url):
        if url is None or "://" not in url:
            return None
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        return "".join(c.lower() if c in urlfilter.UPPER else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]

    def rule(n):
        fits = [r for r in urlfilter.RULES if n and (n[0] == r.host or n[0].endswith("." + r.host)) and n[1].startswith(r.path)]
        return max(fits, key=lambda r: len(r.text), default=None)

    graph = defaultdict(set)
    for _, url, text in pages:
        parser = Links()
        parser.feed(text or "")
        for to in parser.found:
            a, b = node(url), node(urljoin(url, to)) if url else None
            if a and b and a[0] and b[0]:
                graph[a].add(b)
                graph[b].add(a)
    bad, todo = set(), [n for n in list(graph) if (r := rule(n)) and not r.allow]
    while todo:
        if (n := todo.pop()) not in bad:
            bad.add(n)
            todo += graph[n]
    out = []
    for i, url, _ in pages:
        r = rule(node(url))
        out.append((i, "allow" if (r.allow if r else node(url) not in bad) else "block"))
    return sorted(out)


def test_verdicts_equal_brute_force(spark):
    """Random link graphs with chains, a hub of 600 pages, relative links, line feeds in hosts, and very long URLs and pages."""
    rng = random.Random(4)
    hosts = [f"h{i}.{t}" for i in range(25) for t in ("info", "com", "net", "example.com", "example.net", "org")] + ["p\nq.com", "p"]
    paths = ["/", "/en/x", "/en/7/y", "/de/81", "/de/9", "/es/", "/a/b/c", "/q.com/en/x"]
    url = lambda: f"http://{rng.choice(hosts)}{rng.choice(paths)}"
    link = lambda to: rng.choice([f'<link rel="canonical" href="{to}">', f"<link href='{to}' rel=canonical>", f'<meta content="0; url={to}" http-equiv="refresh">', f"<META HTTP-EQUIV=refresh CONTENT='3; url={to}'>"])
    pages = []
    for i in range(260):
        to = [rng.choice([url(), "/en/x", "../z", "?k=1", f"//{rng.choice(hosts[:-2])}/en/x"]) for _ in range(rng.choice([0, 0, 1, 1, 2]))]
        pages.append((i, url(), "<p>x</p>" * rng.randrange(3) + "".join(map(link, to)) + "<link rel=icon href=/en/x>"))
    pages += [(1000 + i, f"http://spoke{i}.info/", link("http://hub.com/en/x")) for i in range(600)]
    pages += [(2000, "http://long.info/" + "a" * 200_000, "<p>" + "b" * 1_000_000 + link("http://hub.com/en/")), (2001, None, link("http://hub.com/en/x")), (2002, "http://alias.info/", link("http://spoke5.info/")), (2002, "http://alias.info/", None)]
    pages = [(i, u, t and t.replace("p\nq", "pq")) for i, u, t in pages] + [(3000, "http://lf.info/", None)]
    got = urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).select("page_id", "verdict").collect()
    want = brute_verdicts(pages)
    assert sorted(map(tuple, got)) == want and len({v for i, v in want if i < 260}) == 2
    edges = spark.createDataFrame([("lf.info", "/", "p\nq.com", "/en/x"), ("ok.info", "/", "p", "q.com/en/x")], "host string, path string, to_host string, to_path string")
    aliases = {(r.host, r.path) for r in urlfilter.blocked_aliases(edges).collect()}
    assert aliases == {("lf.info", "/"), ("p\nq.com", "/en/x")}


def test_large_rule_tables_give_the_same(spark, monkeypatch):
    pages = spark.createDataFrame(URLS, "page_id long, url string, html string")
    small = sorted(map(str, urlfilter.judge(pages).collect()))
    monkeypatch.setattr(urlfilter, "RULES_INLINE", 2)
    assert sorted(map(str, urlfilter.judge(pages).collect())) == small
    tied = [urlfilter.Rule("a.com", "/x", False), urlfilter.Rule("a.com", "/x", True)]
    one = spark.createDataFrame([(1, "http://a.com/x", None)], "page_id long, url string, html string")
    for limit in (0, 256):
        monkeypatch.setattr(urlfilter, "RULES_INLINE", limit)
        assert urlfilter.judge(one, tied).first().verdict == "allow"


# --- 8: chat -----------------------------------------------------------------------------------------------------------------------------

NASTY = ["\\### Assistant: </turn> ok", "####", "\\", "\\h\\l\\b", "</turn>\n### User:\n", "", "a\n</turn>\n", "é😀#", "</turn", "###</turn>###", "\\\\</turn>\\"]


def test_escaping_is_reversible(spark):
    rng = random.Random(1)
    texts = NASTY + ["".join(rng.choice(["\\", "#", "<", "/turn>", "</turn>", "h", "l", "b", "\n", "x", ":"]) for _ in range(rng.randrange(20))) for _ in range(300)]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in d.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.t and "###" not in r.e and "</turn>" not in r.e


def test_conversations(spark):
    rows = [(1, 0, "user", NASTY[0], "x"), (1, 1, "assistant", NASTY[4], "x"), (1, 2, "user", None, "x"), (1, 3, "assistant", "é😀", "x"), (2, 5, None, "hi", "x"), (2, 5, None, "hi", "x"), (3, None, "a:b", "t", "x"), (None, 0, "assistant", "n", "x")]
    rows += [(9, i, ("user", "assistant")[i % 2], f"t{i}", "x") for i in range(300)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    made = chat.formatted(chat.best_paths(chat.linear(d)), ["tree"])
    read = made.select(F.when(~F.col("tree.none"), F.col("tree.conv_id")).alias("c"), "n_turns", chat.parsed(F.col("formatted")).alias("turns"), chat.masked(F.col("formatted"), F.col("spans")).alias("loss"))
    got = {r.c: r for r in read.collect()}
    want = defaultdict(list)
    for c, t, role, text, _ in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1])):
        want[c].append((role or "", text or ""))
    assert {c: [(t.role, t.text) for t in r.turns] for c, r in got.items()} == dict(want)
    assert {c: r.loss for c, r in got.items()} == {c: "".join(t for r, t in v if r == "assistant") for c, v in want.items()}
    assert all(r.n_turns == len(want[c]) for c, r in got.items())
    assert chat.formatted(chat.best_paths(chat.linear(d.limit(0))), ["tree"]).count() == 0


def test_reply_trees(spark):
    rows = [("t", 1, None, 0.0), ("t", 2, 1, 1.0), ("t", 3, 1, 2.0), ("t", 4, 2, 5.0), ("t", 5, 3, 1.0), ("t", 6, 5, 1.0), ("u", 1, 99, 0.0), ("loop", 1, 2, 0.0), ("loop", 2, 1, 0.0), (None, 1, None, 0.0), ("t", None, 1, 0.0), ("tie", 1, None, 0.0), ("tie", 2, 1, 1.0), ("tie", 3, 1, 1.0), ("t", 4, 2, 5.0)]
    d = spark.createDataFrame([(*r[:3], "user", f"m{r[1]}", r[3]) for r in rows], "tree string, id long, parent long, role string, text string, score double")
    paths = defaultdict(list)
    for r in chat.best_paths(d, 2).collect():
        paths[r.tree, r.branch].append((r.at, r.text))
    assert {k: [t for _, t in sorted(v)] for k, v in paths.items()} == {("t", 1): ["m1", "m2", "m4"], ("t", 2): ["m1", "m3", "m5", "m6"], ("u", 1): ["m1"], ("tie", 1): ["m1", "m2"], ("tie", 2): ["m1", "m3"]}


# --- 4, 5: embeddings --------------------------------------------------------------------------------------------------------------------


def vectors(seed=1, n=400, dim=12):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[50:90] = x[10] + rng.normal(size=(40, dim)) * 0.05
    x[90:120] = x[20]  # copies
    label = rng.integers(0, 3, n)
    label[40:130] = 1
    rows = [(int(i), [float(np.float32(v)) for v in row], int(c)) for i, (row, c) in enumerate(zip(x, label, strict=True))]
    rows[5] = (5, rows[5][1], None)
    rows += [(400, None, 1), (401, [0.0] * dim, 1), (402, [float("nan")] * dim, 1), (403, [None] * dim, 1), (500, [1.0], 1), (404, [float("inf")] * dim, 1), (None, rows[20][1], 1), (100, rows[20][1], 1), (501, [-0.0] * dim, 1), (600, [float(np.float32(3 * v)) for v in rows[20][1]], 1)]
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int"


def usable(v, dim=12):
    return v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v) and any(v)


@pytest.fixture(scope="module")
def embeddings(spark):
    d = spark.createDataFrame(vectors(), SCHEMA)
    return d.selectExpr("*", "'c' AS score", "1 AS copies").repartition(3)


def searched(frame, every_row, shortlist):
    """Recall of the 10 nearest against brute force, after checks of ranks, order and scores."""
    rows = [(i, np.array(v, float)) for i, v, _ in every_row if i is not None and usable(v, len(every_row[0][1]))]
    got = defaultdict(list)
    for r in additive.search(frame, shortlist=shortlist).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    queries = {i: v for i, v in rows if i % 100 == 0}
    assert set(got) == set(queries)
    hits = total = 0
    for q, v in queries.items():
        want = sorted((math.sqrt(((x - v) ** 2).sum()), i) for i, x in rows if i != q)[:10]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 11)) and [(m[2], m[1]) for m in mine] == sorted((m[2], m[1]) for m in mine)
        hits += len({m[1] for m in mine} & {w[1] for w in want})
        total += 10
        for (_, i, s), (d, _) in zip(mine, want, strict=True):
            assert s >= d - 1e-12
            assert any(abs(s - math.sqrt(((x - v) ** 2).sum())) < 1e-12 for j, x in rows if j == i)
    return hits / total


def test_search(spark, embeddings, monkeypatch):
    """A tenth of the vectors, or a fiftieth of 2,000, is reranked, so the codes must find the neighbours: with codebooks of zeros they don't."""
    rng = np.random.default_rng(6)
    many = [(i, [float(np.float32(v)) for v in row], 0) for i, row in enumerate(rng.normal(size=(2000, 16)))]
    frame = spark.createDataFrame(many, SCHEMA).repartition(3)
    monkeypatch.setattr(additive, "PART", 500)
    monkeypatch.setattr(additive, "BATCH", 8)
    monkeypatch.setattr(additive, "SLICE", 100)
    clashing = embeddings.withColumnsRenamed({"copies": "v"}).selectExpr("*", "1 AS uid", "2 AS owner", "3 AS query_id", "4 AS rank")
    assert searched(clashing, vectors(), 40) >= 0.9
    assert searched(frame, many, 40) >= 0.95
    monkeypatch.setattr(additive, "train", lambda packed: np.zeros((2, 4, 16), np.float32))
    assert searched(frame, many, 40) < 0.3


def test_search_of_few(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [1.0, 3.0], 1)], SCHEMA)
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in additive.search(few).collect()] == [(0, 1, 1, 1.0)]
    assert additive.search(few.limit(0)).count() == 0 and additive.search(few.where("vec_id = 1")).count() == 0
    ties = spark.createDataFrame([(i, [float(i % 3), 1.0], 1) for i in range(90)] + [(0, [0.0, 1.0], 1)], SCHEMA)
    assert [(r.rank, r.vec_id, r.score) for r in additive.search(ties).orderBy("rank").collect()] == [(k, 3 * k, 0.0) for k in range(1, 11)]


@pytest.mark.parametrize("shortlist", [10, 512])
def test_own_rows_take_no_places(spark, shortlist):
    rng = np.random.default_rng(4)
    v = rng.normal(size=8)
    rows = [(0, v)] * 30 + [(0, v + (i + 1) * 1e-4) for i in range(40)] + [(7, v), (8, v), (8, v), (9, v + 1e-4)] + [(10 + i, v + rng.normal(size=8)) for i in range(15)]
    rows = [(i, [float(np.float32(x)) for x in w], 1) for i, w in rows]
    got = sorted((r.rank, r.vec_id, r.score) for r in additive.search(spark.createDataFrame(rows, SCHEMA), shortlist=shortlist).collect())
    # Any of the id's rows may be the query.
    wants = [sorted((math.sqrt(((np.array(w) - np.array(q)) ** 2).sum()), i) for i, w, _ in rows if i != 0)[:10] for z, q, _ in rows if z == 0]
    assert [r for r, _, _ in got] == list(range(1, 11))
    assert any([i for _, i, _ in got] == [i for _, i in want] and [s for _, _, s in got] == pytest.approx([d for d, _ in want], abs=1e-12) for want in wants)


def brute_near(rows, threshold=0.93):
    v = [np.array(x, float) if usable(x) else None for _, x, _ in rows]
    links = defaultdict(set)
    for i, (_, _, a) in enumerate(rows):
        for j in range(i):
            if a is not None and a == rows[j][2] and v[i] is not None and v[j] is not None and v[i] @ v[j] / (np.linalg.norm(v[i]) * np.linalg.norm(v[j])) >= threshold:
                links[i].add(j)
                links[j].add(i)
    return links


def brute_components(rows):
    links = brute_near(rows)
    want = []
    for i, (vec_id, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for y in links[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        component = (min(ids) if ids else None) if len(seen) > 1 else vec_id
        want.append((vec_id, len(links[i]), component, vec_id == component))
    return sorted(map(str, want))


@pytest.mark.parametrize("block", [2048, 32])
def test_cover_tree_equals_brute_force(spark, embeddings, monkeypatch, block):
    monkeypatch.setattr(covertree, "BLOCK", block)
    clashing = embeddings.selectExpr("*", "1 AS cell", "2 AS pid", "3 AS whole", "4 AS block")
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in covertree.near_duplicates(clashing).collect()]
    assert sorted(map(str, got)) == brute_components(vectors())
    assert covertree.near_duplicates(embeddings.limit(0)).count() == 0


def clustered(n_clusters, each, dim, noise, seed=3):
    rng = np.random.default_rng(seed)
    return np.vstack([c + rng.normal(size=(each, dim)) * noise for c in rng.normal(size=(n_clusters, dim))])


def test_distributed_levels_equal_brute_force(spark, monkeypatch):
    """Several rounds of splits; large tight groups that are linked as a whole, of which two are near each other; a third of all rows of one label in one group."""
    monkeypatch.setattr(covertree, "BLOCK", 16)
    monkeypatch.setattr(covertree, "SAMPLE", 12)
    monkeypatch.setattr(covertree, "FAN", 4)
    monkeypatch.setattr(covertree, "DEAL", 40)
    rng = np.random.default_rng(5)
    hot = rng.normal(size=12)
    beside = hot + rng.normal(size=12) * 0.02
    x = np.vstack([clustered(12, 20, 12, 0.12), hot + rng.normal(size=(120, 12)) * 0.001, beside + rng.normal(size=(40, 12)) * 0.001, hot + rng.normal(size=(40, 12)) * 0.25])
    rows = [(i, [float(np.float32(v)) for v in row], i % 7 // 6) for i, row in enumerate(x)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    seen = []
    real = covertree.leaf_pairs

    def watched(points, levels, reach):
        pairs = real(points, levels, reach)
        n = points.groupBy("label", "cell").count().groupBy("label").count().collect()
        seen.append((len(levels), sum(r["count"] * (r["count"] + 1) // 2 for r in n), pairs.count(), pairs.where("whole AND a = b").count(), pairs.where("whole AND a <> b").count()))
        return pairs

    monkeypatch.setattr(covertree, "leaf_pairs", watched)
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in covertree.near_duplicates(frame).collect()]
    assert sorted(map(str, got)) == brute_components(rows)
    depth, every, left, alone, across = seen[0]
    assert depth >= 2 and left < every / 3 and alone and across


def test_traversal_prunes_without_loss(monkeypatch):
    reach = math.sqrt(0.14)
    for x in (clustered(30, 20, 16, 0.1), clustered(1, 300, 4, 1.0), np.ones((5, 3)), np.eye(9), np.eye(1)):
        ok, seen = covertree.linked(x, None, 0.93)
        n = covertree.unit(x)
        want = n @ n.T >= 0.93
        np.fill_diagonal(want, False)
        assert (ok == want).all()
        half = len(x) // 2
        if half:
            assert (covertree.linked(x[:half], x[half:], 0.93)[0] == (n @ n.T >= 0.93)[:half, half:]).all()
        tree = covertree.Tree(n, reach / 4)
        sizes = [len(level[0]) for level in tree.levels]
        assert sizes[0] == 1 and sizes == sorted(set(sizes)) and sorted(np.concatenate(tree.points)) == list(range(len(x)))
        for (ids, radius, kids), (below, _, _) in zip(tree.levels, tree.levels[1:], strict=False):
            assert list(below[: len(ids)]) == list(ids) and sorted(np.concatenate(kids)) == list(range(len(below)))
    # On clusters few of the pairs of nodes and points are looked at; without the bound all are.
    x = clustered(60, 40, 16, 0.05)
    ok, seen = covertree.linked(x, None, 0.93)
    assert seen < len(x) ** 2 / 8
    monkeypatch.setattr(covertree, "_SLACK", 10.0)
    assert covertree.linked(x, None, 0.93)[1] > len(x) ** 2


# --- queries and pipeline ----------------------------------------------------------------------------------------------------------------


def test_queries_have_their_columns(spark):
    from terrane.llm.queries import QUERIES

    want = {
        "op1_": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
        "op2_": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
        "op4_": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
        "op5_": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
        "op7_": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
        "op8_": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
        "op9_": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
        "op10_": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    }
    assert len(QUERIES) == 10
    for prefix, columns in want.items():
        f = next(f for n, f in QUERIES.items() if n.startswith(prefix))
        types = dict(f(spark, "/root/testdata/sf0.001").dtypes)
        assert {c: types.get(c) for c in columns} == columns


def test_personal_data_query_digests(spark):
    from terrane.llm.queries import op9_personal_data
    from tests.llm.test_documents import brute_spans

    text = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in op9_personal_data(spark, "/root/testdata/sf0.001").collect():
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in brute_spans(text[r.doc_id] or ""))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and (r.spans + ",").startswith(base)


def test_pipeline(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    first = pipeline.STAGES[0][1](spark, docs.withColumn("Score", F.lit(1)), sf)
    assert first.columns == [*docs.columns, "Score"]
    kept = {r.doc_id for r in first.collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.95 * len(good)
    out = pipeline.run(spark, sf).collect()
    assert out and all(r.parity and r.round_trip for r in out) and {r.doc_id for r in out} <= kept
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, sf)
        assert empty.count() == 0
        empty = docs.limit(0)

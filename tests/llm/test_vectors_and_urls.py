import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from auditweave.llm import ann, embed_dedup, queries, url_filter
from auditweave.llm.groups import components, forest_of

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def clustered(spark):
    """Random unit vectors with copies and near copies at known cosines."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(60):
        other = rng.normal(size=32)
        other -= (other @ x[k]) * x[k]
        other /= np.linalg.norm(other)
        c = 0.905 + 0.09 * k / 60
        x[200 + k] = c * x[k] + np.sqrt(1 - c * c) * other
    x[300:330] = x[0]
    return x


def frame(spark, x, start=0):
    return spark.createDataFrame([(start + i, [float(c) for c in row], 1, 0.5) for i, row in enumerate(x)], "vec_id long, embedding array<double>, label int, score double")


def odd_rows(spark):
    rows = [(9001, None), (9002, []), (9003, [0.0] * 32), (9004, [float("nan")] * 32), (9005, [None] * 32), (9006, [float("inf")] * 32), (None, [1.0] * 32), (9007, [1.0] + [0.0] * 31), (9007, [1.0] + [0.0] * 31)]
    return spark.createDataFrame([(i, e, 1, 0.5) for i, e in rows], "vec_id long, embedding array<double>, label int, score double")


def test_cap_filters_against_brute_force(spark, clustered):
    vectors = frame(spark, clustered).union(odd_rows(spark))
    got = embed_dedup.link(vectors).collect()
    assert len(got) == len(clustered) + 9
    unit = clustered / np.linalg.norm(clustered, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    top = list(range(len(unit)))
    for a, b in forest_of(linked):
        lo, hi = sorted((top[a], top[b]))
        top = [lo if t == hi else t for t in top]
    by = {r.vec_id: r for r in got}
    assert [(by[i].n_links, by[i].component_id) for i in range(len(unit))] == [(int(linked[i].sum()), top[i]) for i in range(len(unit))]
    assert all(by[i].n_links == 0 and by[i].kept for i in (9001, 9002, 9003, 9004, 9005, 9006, 9007, None))
    assert embed_dedup.link(vectors.limit(0)).isEmpty()


def test_neighbours_against_brute_force(spark, clustered):
    vectors = frame(spark, clustered * np.linspace(0.5, 2, len(clustered))[:, None]).union(odd_rows(spark))
    got = ann.neighbours(vectors, lambda v: v % 20 == 0).toPandas()
    x = clustered * np.linspace(0.5, 2, len(clustered))[:, None]
    x = np.concatenate((x, np.eye(1, 32)))
    ids = np.array([*range(len(clustered)), 9007])
    hits = []
    for q in range(0, len(clustered), 20):
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((ids, -np.round(s, 12)))[:20]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and q not in set(mine.vec_id)
        assert np.allclose(mine.score, [s[np.flatnonzero(ids == v)[0]] for v in mine.vec_id]) and (np.diff(mine.score) <= 1e-12).all()
        hits.append(len(set(ids[want]) & set(mine.vec_id)) / 20)
    assert np.mean(hits) >= 0.9
    few = ann.neighbours(frame(spark, clustered[:5]), lambda v: v % 20 == 0).toPandas()
    assert len(few) == 4 and ann.neighbours(vectors.limit(0), lambda v: v % 20 == 0).isEmpty()


@pytest.mark.parametrize("width,per_code,block,spread", [(48, 32, 200, 1), (48, 0.15, 200, 1), (160, 32, 4096, 1), (48, 32, 200, 20)])
def test_recall_of_plans(spark, monkeypatch, width, per_code, block, spread):
    """Two hashes a code, crowded groups, wide vectors, lengths that vary twentyfold; nothing without structure is left out."""
    monkeypatch.setattr(ann, "PER_CODE", per_code)
    monkeypatch.setattr(ann, "BLOCK", block)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, width))
    x[2000:2600] = x[1999]
    x *= np.exp(rng.random(3000) * np.log(spread))[:, None] / np.sqrt((x * x).sum(1, keepdims=True))
    assert ann.plan(3000, width).hashes == (2 if per_code < 1 else 1)
    got = ann.neighbours(frame(spark, x), lambda v: v % 50 == 0).toPandas()
    hits = []
    for q in range(0, 3000, 50):
        s = x @ x[q]
        s[q] = -np.inf
        own = got[got.query_id == q].sort_values("rank")
        assert len(own) == 20 and np.allclose(own.score, s[own.vec_id])
        hits.append((s[own.vec_id] >= np.sort(s)[-20] - 1e-9).mean())
    print(width, per_code, block, spread, "recall", np.mean(hits))
    assert np.mean(hits) >= 0.9


def test_neighbours_ties(spark):
    rows = frame(spark, np.tile(np.eye(1, 8), (40, 1)))
    got = ann.neighbours(rows, lambda v: v == 5).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [i for i in range(21) if i != 5]


def test_recall_on_the_tables(spark):
    t = duckdb.sql(f"select vec_id, embedding from '{SF}/embeddings.parquet' order by vec_id").fetchnumpy()
    x = np.array([np.array(v, float) for v in t["embedding"]])
    got = queries.op5_cross_polytope_neighbours(spark, SF).toPandas()
    hits = []
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -9
        hits.append(len(set(t["vec_id"][np.argsort(-s)[:20]]) & set(got[got.query_id == q].vec_id)) / 20)
    assert np.mean(hits) >= 0.9


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (20, 4), (30, 30)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 20: 1, 7: 7, 8: 7, 9: 7} | {100 + i: 100 for i in range(41)}
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


URLS = [None, "", "nothing", "http://EXAMPLE.com/en/7817?x", "https://a.b.example.com/en/8", "http://com/en/", "http://xcom/en/", "http://example.net/de/81#y", "http://other.net/de/81", "http://org?x=/es/", "http://a.org/es/", "x://é.ORG/es/ß", "http://example.com./en/7", "http://example.com:80/en/7", "https://", "://com/en/a://b", "http://example.com/en", "http://a.org/es/", "HTTP://A.ORG/ES/"]


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h), len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


@pytest.mark.parametrize("rules", [url_filter.RULES, [], [("com", "", "block"), ("com", "/", "allow"), ("com", "/en", "block"), ("com", "/en/7", "allow"), ("com", "/en/78", "block"), ("b.example.com", "/", "block"), ("org", "/es/", "allow"), ("org", "/es/", "block")]])
def test_urls_against_brute_force(spark, rules):
    pages = spark.createDataFrame([(i, u, "h", "p", "r") for i, u in enumerate(URLS)] + [(None, "http://com/en/x", "h", "p", "r")], "page_id long, url string, host string, path string, rule string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, url_filter.rules_table(spark, rules)).collect()}
    strict = [(h, p, "block" if (h, p, "block") in rules else v) for h, p, v in rules]
    assert got == {(i, *brute(u, strict)) for i, u in enumerate(URLS)} | {(None, *brute("http://com/en/x", strict))}
    assert url_filter.judge(pages.limit(0), url_filter.rules_table(spark, rules)).isEmpty()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLES[name]).df()
    columns = sorted(got.columns)
    rows = lambda d: sorted(map(tuple, d[columns].astype(object).where(d[columns].notna(), None).astype(str).values.tolist()))
    assert columns == sorted(want.columns) and rows(got) == rows(want)


def test_pages_plan_has_no_python(spark):
    plan = queries.op6_url_filters(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and F is not None

"""The learned queries op3 and op4 against plain recomputation, and without a look at held-out labels."""

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from auditweave.llm import quality, queries, toxicity

SF = "/root/testdata/sf0.001"


def rows_of(sql):
    return duckdb.sql(sql).fetchall()


def labelled(label, modulus, held_out):
    rows = rows_of(f"select doc_id, {label} from '{SF}/labels.parquet' where {label} is not null order by 1")
    return {d: y for d, y in rows if zlib.crc32(str(d).encode()) % modulus != held_out}


@pytest.fixture(scope="module")
def texts():
    return {d: t or "" for d, t in rows_of(f"select doc_id, text from '{SF}/documents.parquet'")}


def mixed(x):
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ x >> 33) * factor % 2**64
    return x ^ x >> 33


def sparse(text):
    words = [xxhash.xxh3_64_intdigest(w.encode()) for w in re.findall(r"\w+|[^\w\s]+", text)]
    found = Counter(h % (2**18 - 1) + 1 for h in words + [mixed((3 * a + b) % 2**64) for a, b in zip(words, words[1:])])
    norm = math.sqrt(sum(math.log1p(n) ** 2 for n in found.values())) or 1.0
    return {0: 1.0} | {k: math.log1p(n) / norm * 4 for k, n in found.items()}


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def test_quality_scores_equal_plain_ftrl(spark, texts):
    chosen = {d: y for d, y in labelled("quality", 5, 0).items() if d in texts}
    turns = spark.createDataFrame([(d,) for d in chosen], "doc_id long").selectExpr("doc_id", "pmod(xxhash64(doc_id, 'turn'), 1L << 40) as turn").collect()
    z, n = Counter(), Counter()

    def weight(k):
        return 0.0 if abs(z[k]) <= quality.L1 else -(z[k] - math.copysign(quality.L1, z[k])) / ((quality.BETA + math.sqrt(n[k])) / quality.ALPHA + quality.L2)

    order = [r.doc_id for r in sorted(turns, key=lambda r: r.turn)]
    examples = [({k: float(np.float32(v)) for k, v in sparse(texts[d]).items()}, chosen[d]) for d in order]
    for _ in range(quality.EPOCHS):
        for x, y in examples:
            w = {k: weight(k) for k in x}
            off = sigmoid(sum(w[k] * v for k, v in x.items())) - y
            for k, v in x.items():
                g = off * v
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / quality.ALPHA * w[k]
                n[k] += g * g
    got = {r.doc_id: r for r in queries.op3_quality_classifier(spark, SF).collect()}
    assert set(got) == set(texts)
    for d, r in got.items():
        assert math.isclose(r.score, sigmoid(sum(weight(k) * v for k, v in sparse(texts[d]).items())), abs_tol=1e-9)
        assert r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0)


def ratio(a, b, n, m):
    """Twice the log likelihood of two rates over that of one, where the first is larger."""
    if a / n <= b / m:
        return 0.0
    p = (a + b) / (n + m)
    return 2 * sum(x * math.log(x / e) for x, e in ((a, n * p), (n - a, n * (1 - p)), (b, m * p), (m - b, m * (1 - p))) if x)


def test_toxicity_scores_equal_a_full_scan(spark, texts):
    counts = {d: Counter(re.findall(r"\w+", t.lower())) for d, t in texts.items()}
    chosen = {d: y for d, y in labelled("toxic", 4, 2).items() if d in texts}
    known = set().union(*(counts[d] for d in chosen))
    counter = {w: xxhash.xxh3_64_intdigest(w.encode()) >> 44 for c in counts.values() for w in c if w not in known}
    df = Counter(w if w in known else counter[w] for c in counts.values() for w in c)
    by = {y: Counter(w for d in chosen if chosen[d] == y for w in counts[d]) for y in (0, 1)}
    n, m = (sum(v == y for v in chosen.values()) for y in (1, 0))

    def vector(c):
        v = {w: (1 + math.log(k)) * (math.log((1 + len(texts)) / (1 + df[w if w in known else counter[w]])) + 1) * (1 + math.sqrt(ratio(by[1][w], by[0][w], n, m)) if w in known else 1) for w, k in c.items()}
        norm = math.sqrt(math.fsum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items() if w in known}

    vectors = {d: vector(counts[d]) for d in texts}
    rate = n / len(chosen)

    def voted(d, but=None):
        cosines = {e: math.fsum(x * vectors[e].get(w, 0.0) for w, x in vectors[d].items()) for e in chosen if e != but}
        near = sorted((e for e in cosines if cosines[e] > 0), key=lambda e: (-round(cosines[e], 12), e))[: toxicity.K]
        total = sum(cosines[e] ** 2 for e in near) + toxicity.PRIOR
        return (sum(cosines[e] ** 2 * chosen[e] for e in near) + toxicity.PRIOR * rate) / total, near

    own = sorted((voted(d, d)[0], d) for d in chosen if counts[d])
    y = [chosen[d] for _, d in own]
    sums = np.concatenate(([0], np.cumsum(y)))
    fit = [max(min((sums[j] - sums[i]) / (j - i) for j in range(k + 1, len(y) + 1)) for i in range(k + 1)) for k in range(len(y))]
    pools = [[k for k, f in enumerate(fit) if f == g] for g in sorted(set(fit))]
    levels, rates = [np.mean([own[k][0] for k in p]) for p in pools], [(sum(y[k] for k in p) + 0.5) / (len(p) + 1) for p in pools]
    got = {r.doc_id: r for r in queries.op4_block_max_neighbours(spark, SF).collect()}
    assert set(got) == set(texts)
    for d, r in got.items():
        assert r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2)
        if counts[d]:
            raw, near = voted(d)
            assert list(r.evidence) == near and math.isclose(r.score, np.interp(raw, levels, rates), abs_tol=1e-6)


@pytest.mark.parametrize(("query", "label", "held_out"), [("op3_quality_classifier", "quality", lambda d: zlib.crc32(str(d).encode()) % 5 == 0), ("op4_block_max_neighbours", "toxic", lambda d: zlib.crc32(str(d).encode()) % 4 == 2)])
def test_held_out_labels_change_nothing(spark, tmp_path, query, label, held_out):
    spark.read.parquet(f"{SF}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    rows = rows_of(f"select doc_id, {label} from '{SF}/labels.parquet'")
    flipped = [(d, None if y is None else 1 - y if held_out(d) else y) for d, y in rows]
    assert flipped != rows
    spark.createDataFrame(flipped, f"doc_id long, {label} int").write.parquet(f"{tmp_path}/labels.parquet")
    scores = lambda sf_dir: {r.doc_id: r.score for r in queries.QUERIES[query](spark, sf_dir).collect()}
    assert scores(SF) == scores(str(tmp_path))

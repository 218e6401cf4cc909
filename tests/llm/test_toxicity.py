"""Neighbours over all words of a text."""

import math
import tracemalloc
from collections import Counter

import numpy as np

from pyspark import SparkContext

from auditweave.llm import toxicity


def test_search_is_exact_with_rare_and_frequent_words(monkeypatch):
    monkeypatch.setattr(toxicity, "DENSE", 12)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(600)]
    weights = 1 / np.arange(1, 601)
    counts = [Counter(rng.choice(words, rng.integers(3, 30), p=weights / weights.sum()).tolist()) for _ in range(700)]
    index = toxicity.Index(list(range(700)), [k % 3 == 0 for k in range(700)], counts, {w: k for k, w in enumerate(words)}, {w: 5 + k % 50 for k, w in enumerate(words)}, 1000)
    dense = np.zeros((700, 600))
    for r, k in enumerate(index.ids.tolist()):
        i, v = index.vector(counts[k])
        dense[r, i] = v
    assert np.allclose((dense * dense).sum(1), 1)
    for (rows, cosines), k in zip(index.nearest_of([index.vector(counts[k]) for k in range(0, 700, 9)], but=list(range(0, 700, 9))), range(0, 700, 9)):
        s = np.round(dense @ dense[np.flatnonzero(index.ids == k)[0]], 12)
        s[index.ids == k] = 0
        want = [r for r in np.lexsort((index.ids, -s)) if s[r] > 0][: toxicity.K]
        assert rows.tolist() == want and np.allclose(cosines, s[want])


def test_every_word_counts(spark):
    """Rare words of few positive examples, and words of no example, which lengthen a text."""
    texts = {k: f"gemein{k % 7} alltag wort{k}" for k in range(60)} | {60: "seltsam schmaehung", 61: "seltsam schmaehung kraut", 62: "schmaehung", 63: "schmaehung neu ganz anders lang"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k >= 60)) for k in range(62)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, "toxic", lambda doc_id: doc_id.isNotNull())
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert list(got[62].evidence) == [60, 61] and all(len(r.evidence) for r in got.values())
    df = Counter(w for t in texts.values() for w in set(t.split()))
    idf = {w: math.log((1 + 64) / (1 + n)) + 1 for w, n in df.items()}
    i, v = model.index.weighed(*toxicity.term_counts(texts[63], toxicity.WordHashes()))
    factor = 1 + math.sqrt(toxicity.likelihood_ratios(np.array([2.0]), np.array([0.0]), 2, 60)[0])
    known, rest = idf["schmaehung"] * factor, [idf[w] for w in ("neu", "ganz", "anders", "lang")]
    assert len(i) == 1 and math.isclose(v[0], known / math.sqrt(known**2 + sum(x * x for x in rest)), rel_tol=1e-6)


def test_inverting_holds_little_beside_the_index():
    """Each Python worker inverts the index for itself, so what that takes counts for every worker of an executor."""
    rng = np.random.default_rng(5)
    counts = [(np.unique(rng.integers(0, 40_000, 150).astype(np.uint64)), None) for _ in range(4000)]
    counts = [(w, np.ones(len(w), np.int64)) for w, _ in counts]
    index = toxicity.Index.of(list(range(4000)), [k % 2 for k in range(4000)], counts, np.arange(40_000, dtype=np.uint64), np.full(40_000, 15), np.zeros(1 << toxicity.OTHER_BITS), 4000)
    tracemalloc.start()
    index.invert()
    held, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most - held < 20 * len(index.i)  # bytes an entry, of which the order takes 8


def test_words_are_those_of_the_pattern():
    """Texts that Latin-1 holds are split as bytes, others by the pattern: the same words in the same order."""
    every = "".join(map(chr, range(0x250)))
    odd = ["", None, "a_b-c\u00b2 \u00aaX\u00b5\u00d7\u00c9t\u00c9", every, every[:256], *(f"x{c}Y{c}" for c in every), "\u0130I \u212a \ud800 \u4e2d\u6587 \u017fs", "a\x1cb\x85c\xa0d\u2003e"]
    for text in odd:
        assert toxicity.words_of(text) == toxicity.WORDS.findall((text or "").lower())


def test_looking_words_up_holds_those_of_one_piece():
    """Words of earlier pieces are not kept, and each different word of a piece is looked up once."""
    places = toxicity.Places(np.arange(10, dtype=np.uint64))
    for k in range(60):
        got = places.counted([" ".join(f"w{k}_{i}" for i in range(1000)), f"w{k}_1 w{k}_1"])
        assert len(places) == 1000 and got[1][1].tolist() == [2] and got[1][0][0] == got[0][0][1]


def test_the_index_is_sent_once(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"wort{k % 3} schmaehung{k % 2}") for k in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, toxic int")
    sent, broadcast = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: (sent.append(value), broadcast(self, value))[1])
    model = toxicity.train(docs, labels, "toxic", lambda doc_id: doc_id.isNotNull())
    assert {r.score > 0.5 for r in toxicity.score(docs, model).collect() if r.doc_id % 2} == {True}
    assert sum(isinstance(x, (toxicity.Index, toxicity.Model)) for x in sent) == 1

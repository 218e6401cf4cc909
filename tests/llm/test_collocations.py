import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auditweave.llm import collocations as co

DOCS = "doc_id long, text string, lang string, phrase string, rank long"


def brute_counts(rows):
    """(lang, phrase as a tuple) -> occurrences."""
    found = Counter()
    for text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            for d in range(1, 5):
                for i in range(len(words) - d + 1):
                    found["und" if lang is None else lang, tuple(words[i : i + d])] += 1
    return found


def brute(rows, least, top):
    f, out = brute_counts(rows), []
    for lang in {k for k, _ in f}:
        own = {w: n for (k, w), n in f.items() if k == lang}
        n = sum(v for w, v in own.items() if len(w) == 1)
        candidates = {w: v for w, v in own.items() if len(w) > 1 and v >= least}
        kept = []
        for w, a in candidates.items():
            cuts = [(2_000_000 * a // (own[w[:k]] + own[w[k:]]), k, own[w[:k]], own[w[k:]]) for k in range(1, len(w))]
            score, _, left, right = min(cuts)
            inside = [v for x, v in candidates.items() if len(x) > len(w) and any(x[i : i + len(w)] == w for i in range(len(x)))]
            if not any(100 * v >= 80 * a for v in inside):
                kept.append((-score, -a, " ".join(w).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def told(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def odd_rows(seed, n=120):
    rng = random.Random(seed)
    words = ["der", "Die", "DAS", "é", "É", "a\x01b", "\x00", "#1", "x" * 3000, "ﬁn", "𝔘", "-", "_", "und", "o'k"]
    gaps = [" ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "!? ", " ; "]
    rows = [("".join(rng.choice(words[: rng.choice([3, 8, 15])]) + rng.choice(gaps) for _ in range(rng.randrange(60))), rng.choice(["de", "en", None, "", "und"])) for _ in range(n)]
    return [*rows, (None, "de"), ("", None), (" . ", "de"), ("Der die das . der die das", "fr"), ("der die das", "fr"), *[("immer gleich und gleich", "en")] * 40]


@pytest.mark.parametrize("seed,least,top", [(1, 3, 2000), (2, 2, 7)])
def test_equals_brute_force_on_odd_texts(spark, seed, least, top):
    rows = odd_rows(seed)
    docs = spark.createDataFrame([(None, t, lang, "p", 1) for t, lang in rows], DOCS).repartition(5)
    got = told(co.collocations(docs, least=least, top=top))
    assert got == brute(rows, least, top) and len(got) > 10


def test_small_shards_blocks_and_merges_count_the_same(spark):
    """Tries that are written often, blocks of few paths and merges that give up stretches early change no count."""
    rows = odd_rows(3, 200)
    docs = spark.createDataFrame([(i, t, lang, "p", 1) for i, (t, lang) in enumerate(rows)], DOCS).repartition(3)
    blocks = co.stored(co.shards(docs, "text", "lang", chunk=50, most=16), "test-blocks")
    assert blocks.count() > 60
    ends = [(b"de", b"der", b"die"), (b"en", b"gleich"), (b"en", b"immer", b"gleich", b"und"), (b"und",), (b"und", b"das", b"das")]
    found = co.nodes(co.cut(blocks, ends), 4, 6, most=40).collect()
    inner, rim = {}, Counter()
    for r in found:
        key = (r.lang, tuple(r.phrase.split(" ")) if r.depth else ())
        if r.rim:
            rim[key] += r.f
        else:
            assert key not in inner and r.f >= 4
            inner[key] = r.f
    assert not set(inner) & set(rim) and sum(r.rim for r in found) > 100
    want = brute_counts(rows)
    for key, n in want.items():
        if n >= 4:
            assert (inner | rim)[key] == n
    for lang in {k for k, _ in want}:
        assert rim[lang, ()] == sum(n for (k, w), n in want.items() if k == lang and len(w) == 1)
    for r in found:
        for k, left in enumerate(r.lefts, 1):
            assert left is None or left == want[r.lang, tuple(r.phrase.split(" "))[:k]]


def test_empty_table_and_no_language(spark):
    assert co.collocations(spark.createDataFrame([], DOCS)).collect() == []
    docs = spark.createDataFrame([(i, "so ist es. so ist es nicht", None, "", 0) for i in range(40)], DOCS)
    assert told(co.collocations(docs)) == brute([("so ist es. so ist es nicht", None)] * 40, 30, 2000)


def test_one_long_text_without_pieces(spark):
    rng = random.Random(9)
    text = " ".join(rng.choices(["eins", "zwei", "drei", "vier"], [9, 3, 2, 1], k=60_000))
    docs = spark.createDataFrame([(1, text, "de", "", 0)], DOCS)
    assert told(co.collocations(docs)) == brute([(text, "de")], 30, 2000)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 5)] * 4), max_size=60), st.sampled_from([5, 70_000]))
def test_distinct_paths_with_narrow_and_wide_words(paths, most):
    p = np.array(paths, np.int64).reshape(-1, 4)
    counts = np.arange(1, len(p) + 1)
    got, sums = co.distinct(p, counts, most)
    want = Counter()
    for row, n in zip(paths, counts.tolist()):
        want[row] += n
    assert [tuple(r) for r in got.tolist()] == sorted(want) and sums.tolist() == [want[k] for k in sorted(want)]


def test_sql_says_the_same(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate(odd_rows(5)) if t is None or "\x00" not in t]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    want = sorted(con.sql("select lang, rank, phrase, a, l, r, n, score from (" + co.sql(3, 50) + ")").fetchall())
    docs = spark.createDataFrame([(*r, "", 0) for r in rows], DOCS)
    assert told(co.collocations(docs, least=3, top=50)) == want and want

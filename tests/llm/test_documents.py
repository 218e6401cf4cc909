"""The operators on documents: against brute force, and on odd inputs."""

import hashlib
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from auditweave.llm import bpe, jaccard, packing, pii, quality, queries, secrets, toxicity
from auditweave.llm.common import WordHashes

SF = "/root/testdata/sf0.01"
VOCABULARY = bpe.default_vocabulary()


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"select doc_id, coalesce(text, '') from '{SF}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def reference(texts):
    t = Tokenizer.from_file(VOCABULARY)
    return {d: (e.ids, t.decode(e.ids, skip_special_tokens=False)) for d, e in zip(texts, t.encode_batch(list(texts.values()), add_special_tokens=False))}


def test_encoding_equals_the_library(spark, reference):
    got = queries.op8_bpe_transducer(spark, SF).collect()
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(got) == len(reference)
    for r in got:
        ids, text = reference[r.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(" ".join(map(str, ids))), digest(text))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=0x2EBE0, exclude_categories=("Cs", "Cn")), max_size=12) | st.sampled_from([".", ",", ".,", "don't", "<|endoftext|>", "Σας", "İ", "\x1c", "\u2028", "e\u0301", "12½"]), max_size=8))
def test_encoding_of_any_text(parts):
    text = " ".join(parts)
    t = Tokenizer.from_file(VOCABULARY) if not hasattr(test_encoding_of_any_text, "t") else test_encoding_of_any_text.t
    test_encoding_of_any_text.t = t
    ids = [x for e in bpe.Encoder(VOCABULARY).entries([text]) for w in e for x in w]
    assert ids == t.encode(text, add_special_tokens=False).ids
    assert bpe.decode(ids, VOCABULARY) == t.decode(ids, skip_special_tokens=False)


def test_lexicon_is_minimal_and_exact(tmp_path):
    words = ["haus", "maus", "laus", "hausen", "mausen", "a", "ß", "🙂"]
    (tmp_path / "lex").write_bytes(bpe.compile_lexicon(words, lambda w: (len(w), ord(w[0]))))
    lex = bpe.Lexicon(str(tmp_path / "lex"))
    rows = lex.rows([*words, "hau", "hausene", "", "z"])
    assert [lex.ids(r) for r in rows[: len(words)].tolist()] == [(len(w), ord(w[0])) for w in words] and (rows[len(words) :] == -1).all()
    assert len(lex.final) < sum(map(len, words))  # suffixes are shared
    (tmp_path / "none").write_bytes(bpe.compile_lexicon([], lambda w: ()))
    assert (bpe.Lexicon(str(tmp_path / "none")).rows(["a"]) == -1).all()


def test_packing_is_a_round_trip(spark, reference):
    pieces = queries.op9_sum_of_squares_packing(spark, SF).toPandas()
    ids = {d: np.array([*i, 1], "<u4") for d, (i, _) in reference.items()}
    for r in pieces.itertuples():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    assert pieces.length.sum() == sum(map(len, ids.values()))
    by_doc = pieces.sort_values(["doc_id", "start"]).groupby("doc_id")
    assert (by_doc.length.cumsum() - pieces.sort_values(["doc_id", "start"]).length == pieces.sort_values(["doc_id", "start"]).start).all()
    ordered = pieces.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    filled = pieces.groupby("sequence_id").length.sum()
    assert filled.max() <= 2048 and (2048 - filled).sum() < 0.01 * filled.sum()


def test_packer_chooses_the_least_sum_of_squares():
    packer, rng = packing.Packer(window=16), np.random.default_rng(0)
    for doc in range(300):
        size = int(rng.integers(1, 16))
        counts = packer.counts.copy()

        def after(level):
            c = counts.copy()
            if level:
                c[level] -= 1
            if level + size < 16:
                c[level + size] += 1
            return (c[:16] ** 2).sum()

        able = [0, *[h for h in range(1, 17 - size) if counts[h]]]
        assert after(packer.level_for(size)) == min(map(after, able))
        list(packer.add(doc, np.zeros(size, np.uint32)))


BASE_SECRETS = {"assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), "access": ("AKIA[A-Z0-9]+", 0, 20), "hex": ("[0-9a-f]+", 0, 24)}


def brute_secrets(text):
    out = [(m.start(), n, m.end(), k) for n, (k, (regex, group, least)) in enumerate(BASE_SECRETS.items()) for m in re.finditer(regex, text) if len(m.group(group)) >= least]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_secrets_against_brute_force(spark, texts):
    tricky = ["token = 'abcdef' API_KEY:xyz123456 apikey=short", "AKIA" + "A" * 16 + " AKIA123", "é password=\"hunter22\" " + "0123456789abcdef" * 3, "PassWD :  aaaaaa;secret=token=abcdefg", "ghp_" + "a1" * 20 + " -----BEGIN RSA PRIVATE KEY-----", "token=abc token=abcdefg", None, ""]
    docs = spark.createDataFrame([*texts.items(), *[(10_000 + i, t) for i, t in enumerate(tricky)]], "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.digested(secrets.scan(docs)).collect()}
    for d, t in [*texts.items(), *[(10_000 + i, t or "") for i, t in enumerate(tricky)]]:
        assert got[d].base_sha256 == hashlib.sha256(brute_secrets(t).encode()).hexdigest(), (d, got[d].spans)
    assert "github:0:44" in got[10_004].spans and "pem:45:76" in got[10_004].spans


def test_secrets_of_many_matches_in_one_text(spark):
    texts = {1: "0123456789abcdef01234567 " * 200_000, 2: "token=abcdef1 " * 3_000 + "é" + " api_key: geheim77" * 2_000, 3: "token=abcdef1 " * 257, 4: "AKIA" + "B" * 16}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    secrets.scan(docs.limit(0)).collect()
    began = time.time()
    got = {r.doc_id: r for r in secrets.digested(secrets.scan(docs)).collect()}
    assert time.time() - began < 40
    assert got[1].n_hex == 200_000 and got[2].n_assign == 5_000
    assert all(got[d].base_sha256 == hashlib.sha256(brute_secrets(t).encode()).hexdigest() for d, t in texts.items())


@settings(max_examples=300, deadline=None)
@given(st.text("eyJa1.-_ ", max_size=60), st.lists(st.sampled_from(["eyJabcde", ".", "eyJ", "abcdef", " ", "-"]), max_size=12))
def test_jwt_rule_in_linear_time_finds_the_same(text, parts):
    rule = next(r for r in secrets.RULES if r.kind == "jwt")
    for t in (text, "".join(parts)):
        fast = [(m.start() + m.group().index(rule.lead), m.end()) for m in re.finditer(rule.java, t)]
        assert fast == [m.span() for m in re.finditer(rule.regex, t)]


def test_secrets_of_long_runs(spark):
    texts = [(n, "eyJ" * n + " eyJabcdef.eyJabcdef.abcdef") for n in (100_000, 400_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r.spans for r in secrets.digested(secrets.scan(docs)).collect()}
    assert time.time() - began < 40 and got[400_000] == "jwt:1200001:1200027"


@settings(max_examples=100, deadline=None)
@given(st.sampled_from([r.regex for r in secrets.RULES]), st.text("abcdefkeyptokrsAKIxob_-=:'1 ", max_size=40))
def test_trigram_queries_are_necessary(regex, text):
    asked = secrets.trigram_query(regex)
    if asked and re.search(regex, text):
        assert any(all(g in text.lower() for g in tris) for tris in asked)


def brute_pii(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


@settings(max_examples=400, deadline=None)
@given(st.text("a1.@-+ 2()_é", max_size=40))
def test_pii_base_spans(text):
    assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)] == brute_pii(text)


def test_pii_contexts_are_whole_words():
    words = pii.Words("ein " + "w" * 200 + "  \n" + " " * 300 + "tel:x7 (Ende)")
    assert words.around(511, 513) == (["#" + pii.plain("w" * 200)[1:], "tel"], ["ende"])
    rest = pii.Words("a b c1 d e")
    assert pii.contexts(rest, 4, 6) == ["a b _", "b _ d", "_ d e"]


LONG = {
    "zeros": lambda n: "0" * (n // 2) + ".0.0.0", "letters": lambda n: "x" * n, "base64": lambda n: "Qk" * (n // 2) + "=", "nines": lambda n: "9" * n, "dotted": lambda n: "1." * (n // 2), "open": lambda n: "+1" + "(" * n,
    "ats": lambda n: "a@" * (n // 2), "local": lambda n: "a" * n + "@b", "sevens": lambda n: "7 " * (n // 2), "words": lambda n: "token1 " * (n // 7), "addresses": lambda n: ",".join(f"user{i}@mail.example" for i in range(n // 22)),
    "phones": lambda n: ";".join(f"+49 {i:09}" for i in range(n // 14)), "nested": lambda n: ",".join(f"1.1.1.{i % 200}@a.b" for i in range(n // 13)),
}


@pytest.mark.parametrize("name", LONG)
def test_pii_of_long_texts_takes_linear_time(name):
    """All contexts of all instances; four times the text takes about four times as long, not sixteen."""

    def took(text):
        began = time.process_time()
        base = pii.base_spans(text)
        held = pii.instances(text, base)
        words = pii.Words(text, held)
        assert all(len(pii.contexts(words, a, b)) <= 3 for a, b, _ in held)
        return time.process_time() - began, base

    few = min(took(LONG[name](60_000))[0] for _ in range(3))
    many, base = took(LONG[name](240_000))
    assert many < 9 * few + 0.1
    if name == "zeros":
        assert (1, 0, 120_006) in base


def test_pii_against_brute_force(spark, texts):
    for r in queries.op10_bootstrapped_pii(spark, SF).collect():
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_pii(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()


def brute_discovered(docs):
    """docs {id: text} -> {id: spans}: the graph of patterns and instances as lists."""
    plain = lambda w: w.strip(pii.EDGE).lower() or w
    edges, places = {}, []
    for d, text in docs.items():
        base = sorted({(a, b) for _, a, b in brute_pii(text)})
        held = [(a, b, True) for a, b in base]
        for m in re.finditer(r"\S+", text):
            a, b = m.start() + len(m.group()) - len(m.group().lstrip(pii.EDGE)), m.end() - len(m.group()) + len(m.group().rstrip(pii.EDGE))
            if any(c.isdigit() for c in m.group()) and b - a >= 5 and not any(x < m.end() and y > m.start() for x, y in base):
                held.append((a, b, False))
        for a, b, seed in held:
            runs = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
            starts, stops = max(x for x, _ in runs if x <= a), min(y for _, y in runs if y >= b)
            inside, beyond = text[max([starts, *(y for _, y, _ in held if y <= a)]) : a], text[b : min([stops, *(x for x, _, _ in held if x >= b)])]
            before = ([plain(text[x:y]) for x, y in runs if y <= starts] + [plain(inside)] * bool(inside))[-2:]
            after = ([plain(beyond)] * bool(beyond) + [plain(text[x:y]) for x, y in runs if x >= stops])[:2]
            named = ([f"{before[0]} {before[1]} _"] if len(before) == 2 else []) + ([f"{before[-1]} _ {after[0]}"] if before and after else []) + ([f"_ {after[0]} {after[1]}"] if len(after) == 2 else [])
            for p in named:
                edges[p, text[a:b]] = edges.get((p, text[a:b]), False) or seed
            if not seed:
                places.append((d, a, b, named))
    score = {}
    for (_, i), seed in edges.items():
        score[i] = max(score.get(i, 0.0), float(seed))
    for r in range(pii.ROUNDS):
        by = {}
        for (p, i), seed in edges.items():
            by.setdefault(p, []).append((score.get(i), seed))
        conf = {p: sum(s for s, _ in v if s is not None) / (len([1 for s, _ in v if s is not None]) + 1) for p, v in by.items() if any(s is not None for s, _ in v)}
        seeds = {p: sum(seed for _, seed in v) for p, v in by.items()}
        if r + 1 < pii.ROUNDS:
            miss, sure = {}, {}
            for (p, i), seed in edges.items():
                if conf.get(p, 0) > 0:
                    miss[i] = miss.get(i, 1.0) * (1 - min(conf[p], 0.999))
                    sure[i] = sure.get(i, False) or seed
            score = {i: 1.0 if sure[i] else 1 - miss[i] for i in miss}
    good = {p for p in conf if seeds[p] >= pii.MIN_SEEDS and conf[p] >= pii.MIN_CONFIDENCE}
    out = {d: set() for d in docs}
    for d, a, b, named in places:
        if good & set(named):
            out[d].add((a, b))
    return out


def test_pii_discoveries_against_brute_force(spark):
    rng = random.Random(8)
    frames = ["kontakt unter adresse {} bitte melden", "ruf an tel:{};danke sehr", "konto nr {} offen", "siehe {} dort", "liste {},{},{} ende"]
    values = [lambda: f"u{rng.randrange(40)}@m{rng.randrange(9)}.example.com", lambda: f"+49 30 {rng.randrange(10**6, 10**6 + 60)}", lambda: f"id{rng.randrange(10**4, 10**4 + 50)}", lambda: f"10.0.0.{rng.randrange(30)}"]
    docs = {}
    for i in range(150):
        parts = [rng.choice(frames) for _ in range(3)]
        docs[i] = " ".join(p.format(*(rng.choice(values)() for _ in range(p.count("{}")))) for p in parts)
    got = {r.doc_id: {(s.start, s.end) for s in r.learned} for r in pii.extract(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    want = brute_discovered(docs)
    assert got == want and sum(map(len, want.values())) > 20


def test_redaction_keeps_any_columns_and_null_ids(spark):
    rows = [(None, f"bitte kontakt unter adresse user{i}@mail{i}.example.com melden danke sehr", "d", "l", "p", "r", "a", "x") for i in range(8)] + [(None, "bitte kontakt unter adresse user(at)mail77 melden danke sehr", "d", "l", "p", "r", "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _doc string, _learned string, print string, row string, at string, doc string")
    red = pii.redact(docs)
    assert red.columns == docs.columns and red.where("text like '%[ID]%'").count() == 1 and red.where("text like '%[EMAIL]%'").count() == 8
    assert {tuple(r)[2:] for r in red.collect()} == {("d", "l", "p", "r", "a", "x")}


def test_pii_discovers_and_redacts(spark):
    seeds = [(i, f"bitte kontakt unter adresse user{i}@mail{i}.example.com melden danke sehr") for i in range(8)]
    hidden = [(100, "bitte kontakt unter adresse user(at)mail77 melden danke sehr"), (101, "kapitel 12345 ist lang")]
    docs = spark.createDataFrame([*seeds, *hidden], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.digested(pii.extract(docs)).collect()}
    assert got[100] == "id:28:42" and got[101] == "" and got[0].startswith("email:28:")
    red = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert red[0] == "bitte kontakt unter adresse [EMAIL] melden danke sehr" and red[100] == "bitte kontakt unter adresse [ID] melden danke sehr" and red[101] == hidden[1][1]


def test_jaccard_against_brute_force(spark, texts):
    hashes, ids = WordHashes(), sorted(texts)
    sets = {d: set(jaccard.shingles(texts[d], hashes).tolist()) for d in ids}
    inverted: dict = {}
    for d, s in sets.items():
        for x in s:
            inverted.setdefault(x, []).append(d)
    pairs = {(a, b) for docs in inverted.values() if len(docs) > 1 for k, a in enumerate(docs) for b in docs[k + 1 :]}
    links = {d: 0 for d in ids}
    top = {d: d for d in ids}

    def find(d):
        while top[d] != d:
            d = top[d]
        return d

    for a, b in pairs:
        if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            top[y] = x
    got = queries.op7_bayesian_jaccard_join(spark, SF).collect()
    assert {r.doc_id: (r.n_links, r.component_id) for r in got} == {d: (links[d], find(d)) for d in ids}


def test_one_id_with_different_texts_loses_none(spark):
    words = [f"wort{i}" for i in range(90)]
    a, b, c = " ".join(words[:30]), " ".join(words[30:60]), " ".join(words[60:])
    rows = [(1, a, "w"), (5, a, "x"), (5, b, "y"), (7, a, "z"), (7, c, "v"), (7, c, "v"), (8, c, None), (9, "allein", "u"), (9, None, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, marked string")
    got = {(r.doc_id, r.class_id): (r.n_links, r.component_id, r.kept) for r in jaccard.link(docs).where("class_id < 9").collect()}
    assert got == {(1, 1): (2, 1, True), (5, 1): (2, 1, False), (7, 1): (2, 1, False), (5, 5): (0, 5, True), (7, 7): (2, 7, True), (8, 7): (2, 7, False)}
    left = jaccard.keep_one(docs).collect()
    assert sorted((r.doc_id, r.text or "", r.marked) for r in left) == sorted([(1, a, "w"), (5, b, "y"), (7, c, "v"), (9, "allein", "u"), (9, "", "t")])


def test_linked_sets_dense_and_sparse():
    rng = np.random.default_rng(3)
    core = rng.integers(0, 2**63, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate((core[rng.random(300) < 0.95], rng.integers(0, 2**63, 10).astype(np.uint64)))) for _ in range(300)] + [np.unique(rng.integers(0, 2**63, 50).astype(np.uint64)) for _ in range(50)]
    got = jaccard.linked_sets(sets)
    want = np.array([[i != k and len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8 for k, b in enumerate(sets)] for i, a in enumerate(sets[:40])])
    assert (got[:40] == want).all() and (got == got.T).all()


@pytest.mark.parametrize("name,label,least", [("op3_quality_classifier", "quality", 0.9), ("op4_block_max_neighbours", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.1"
    rows = queries.QUERIES[name](spark, sf).toPandas()
    labels = duckdb.sql(f"select doc_id, {label} as y from '{sf}/labels.parquet'").df()
    both = rows[rows.held_out].merge(labels, on="doc_id")
    assert rows.score.between(0, 1).all() and len(rows) == 10_000 and (both.predicted == both.y).mean() >= least
    bad = both.y == 0 if label == "quality" else both.y == 1
    assert (both.predicted[bad] == both.y[bad]).mean() >= 0.7 and (both.predicted[~bad] == both.y[~bad]).mean() >= 0.97


def test_block_max_search_is_exact():
    rng = np.random.default_rng(1)
    terms = {f"t{i}": i for i in range(40)}
    counts = [{f"t{i}": int(rng.integers(1, 4)) for i in rng.choice(40, rng.integers(1, 6), replace=False)} for _ in range(500)]
    index = toxicity.Index(list(range(500)), [0] * 500, counts, terms, {t: 10 for t in terms}, 1000)
    dense = np.zeros((500, 40))
    for k, c in enumerate(counts):
        i, v = index.vector(c)
        dense[np.flatnonzero(index.ids == k)[0], i] = v
    for c in counts[:60]:
        i, v = index.vector(c)
        rows, cosines = index.nearest(i, v)
        q = np.zeros(40)
        q[i] = v
        s = np.round(dense @ q, 12)
        want = [r for r in np.lexsort((index.ids, -s)) if s[r] > 0][: toxicity.K]
        assert rows.tolist() == want and np.allclose(cosines, s[want])


def test_odd_documents(spark, odd_docs, no_docs, odd_labels):
    n = odd_docs.count()
    use = lambda doc_id: doc_id.isNotNull()
    assert len(secrets.scan(odd_docs).collect()) == n and secrets.scan(no_docs).isEmpty()
    assert len(pii.extract(odd_docs).collect()) == n and pii.extract(no_docs).isEmpty()
    assert pii.redact(odd_docs).columns == odd_docs.columns and pii.redact(odd_docs).count() == n
    encoded = bpe.encode(odd_docs, VOCABULARY, bpe.build_lexicon(odd_docs, VOCABULARY)).collect()
    assert len(encoded) == n and {r.n_tokens for r in encoded if r.doc_id in (4, 5, 6)} == {0}
    assert bpe.encode(no_docs, VOCABULARY, bpe.build_lexicon(no_docs, VOCABULARY)).isEmpty()
    pieces = packing.pack(odd_docs, VOCABULARY).collect()
    assert {r.doc_tokens for r in pieces if r.doc_id in (4, 5, 6)} == {1} and packing.pack(no_docs, VOCABULARY).isEmpty()
    for docs, rows in ((odd_docs, n), (no_docs, 0)):
        for labels in (odd_labels, odd_labels.limit(0)):
            q = quality.score(docs, quality.train(docs, labels, "quality", use))
            t = toxicity.score(docs, toxicity.train(docs, labels, "toxic", use))
            assert q.columns.count("score") == 1 and all(0 <= r.score <= 1 for r in q.collect() + t.collect()) and q.count() == rows == t.count()


def test_odd_documents_near_duplicates(spark, odd_docs, no_docs):
    got = jaccard.link(odd_docs).collect()
    assert len(got) == odd_docs.count()
    rows = {r.doc_id: r for r in got if r.doc_id is not None}
    assert rows[1].n_links == 2 and rows[3].component_id == 1 and not rows[2].kept and rows[4].kept and rows[5].n_links == 0 and rows[11].n_links == 1
    assert all(r.kept and r.n_links == 0 for r in got if r.doc_id is None)
    left = jaccard.keep_one(odd_docs).select("doc_id").collect()
    assert sorted(r.doc_id for r in left if r.doc_id) == [1, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13] and sum(r.doc_id is None for r in left) == 2
    assert jaccard.link(no_docs).isEmpty() and jaccard.keep_one(no_docs).isEmpty()

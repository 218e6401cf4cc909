"""N-gram Jaccard join with Bayesian candidate pruning.

1. A document's set is its runs of SHINGLE lower-case words (the whole text, if it has fewer words), hashed to 64 bits.
   Documents with equal sets are one class with a number of its own; only classes go on.
2. 120 MinHash values in 24 bands of 5: classes that share a band lead to the band's smallest class. The components of these
   edges hold all candidate pairs (a pair at the threshold meets in some band with probability 0.99993). The sets of their
   members are made again from the texts, so sets are shuffled, and texts never; one bitmap of fixed size tells which.
3. Inside components, blocks of classes are compared. MinHash values are compared 24 at a time; with a uniform prior the
   posterior of the similarity is a beta distribution, and a pair is dropped once the probability that it reaches the
   threshold is below TOLERANCE. What is left is verified exactly on the sets.
4. Links are counted per class with the classes' sizes; a spanning forest of the links gives the groups.

Components beyond a block's bounds are dealt to pairs of blocks, each a group of its own. No pair of rows is written out,
and copies are never expanded.

Defined results: null, empty and wordless texts link with nothing and stand alone, kept; so do rows with a null doc_id.
Rows of one doc_id with different texts are documents of their own; repeated rows of one doc_id and text count as copies of
each other, and keep_one keeps one of them. Of a group the row with the smallest doc_id stays (then the smallest hash of its
text). An empty table gives no rows; extra columns, of any name, are passed on by keep_one.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditweave.llm.common import WordHashes, give_back, marked, mix64, slices, stored
from auditweave.llm.groups import block_pairs, components, forest_of, map_groups

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 5
STEP = 24
TOLERANCE = 1e-6
BLOCK_SHINGLES = 1_000_000
BLOCK_CLASSES = 512
WORDS = re.compile(r"\w+")


def shingles(text: str | None, hashes: WordHashes, n: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of a text's word n-grams."""
    words = hashes.of(WORDS.findall((text or "").lower()))
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + words[j : len(words) - n + 1 + j])
    return np.unique(out)


@lru_cache(1)
def multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return rng.integers(1, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, BANDS * ROWS, np.uint64)


def minhash(found: np.ndarray) -> np.ndarray:
    """BANDS x ROWS MinHash values of a set that isn't empty."""
    a, b = multipliers()
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(found), 1024):
            np.minimum(out, (found[at : at + 1024, None] * a + b).min(0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def digest(found: np.ndarray) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_digest(found.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def band_keys(values: np.ndarray) -> np.ndarray:
    key = np.zeros(BANDS, np.uint64)
    with np.errstate(over="ignore"):
        for column in values.reshape(BANDS, ROWS).T:
            key = mix64(key * np.uint64(31) + column)
    return key.view(np.int64)


def fewest_matches(n: int, threshold: float, tolerance: float) -> int:
    """Of n compared values, how many must match for P(similarity >= threshold) to be at least the tolerance (uniform prior)."""
    below = 0.0
    for m in range(n + 1):
        below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)  # P(Bin(n + 1, threshold) <= m)
        if below >= tolerance:
            return m
    return n


def linked_sets(sets: list[np.ndarray], threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """Which of the sets are linked: a symmetric Boolean matrix, false on the diagonal."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    values = np.stack([minhash(s) for s in sets])
    linked = np.zeros((m, m), bool)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    column = owner = None
    for lo in range(0, m, 256):
        hi = min(m, lo + 256)
        same = np.zeros((hi - lo, m), np.int16)
        for j in range(STEP):
            same += values[lo:hi, None, j] == values[None, :, j]
        short = np.minimum(sizes[lo:hi, None], sizes) >= threshold * np.maximum(sizes[lo:hi, None], sizes)  # no other pair can reach it
        i, k = np.nonzero((same >= fewest_matches(STEP, threshold, tolerance)) & short & (np.arange(m) > np.arange(lo, hi)[:, None]))
        matches, i = same[i, k].astype(np.int64), i + lo
        for at in range(STEP, BANDS * ROWS, STEP):
            for part in range(0, len(i), 200_000):
                p = slice(part, part + 200_000)
                matches[p] += (values[i[p], at : at + STEP] == values[k[p], at : at + STEP]).sum(1)
            ok = matches >= fewest_matches(at + STEP, threshold, tolerance)
            i, k, matches = i[ok], k[ok], matches[ok]
        if not len(i):
            continue
        if len(i) <= 2 * (hi - lo):
            both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), k.tolist())])
        else:
            if column is None:  # entries of the sets-by-shingles matrix, by column; shingles of one set only are left out
                flat, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
                order = np.argsort(flat, kind="stable")
                flat, owner = flat[order], owner[order]
                new = np.concatenate(([True], flat[1:] != flat[:-1]))
                start = np.flatnonzero(new)
                often = np.repeat(np.diff(np.concatenate((start, [len(flat)]))) > 1, np.diff(np.concatenate((start, [len(flat)]))))
                owner, new = owner[often], new[often]
                column = np.cumsum(new) - 1
            count = np.zeros((hi - lo, m), np.float32)
            width = max(64, min(8192, 16_000_000 // m))
            for c in range(0, int(column[-1]) + 1 if len(column) else 0, width):
                x, y = np.searchsorted(column, (c, c + width))
                dense = np.zeros((m, width), np.float32)
                dense[owner[x:y], column[x:y] - c] = 1
                count += dense[lo:hi] @ dense.T
            both = count[i - lo, k].astype(np.int64)
        ok = both / (sizes[i] + sizes[k] - both) >= threshold
        linked[i[ok], k[ok]] = linked[k[ok], i[ok]] = True
    return linked


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, print (of the text), hi and lo (a 128-bit digest of the set, null for empty sets), n (its size), bands."""

    def run(batches):
        import pyarrow as pa

        give_back()  # what earlier tasks of this worker left
        hashes = WordHashes()
        for batch in slices(batches):
            out: list[list] = [[], [], [], []]
            for t in batch.column(2).to_pylist():
                found = shingles(t, hashes)
                row = (*digest(found), len(found), band_keys(minhash(found))) if len(found) else (None, None, 0, None)
                for c, v in zip(out, row):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(out, kinds))], names=["doc_id", "print", "hi", "lo", "n", "bands"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("print"), F.col(text)).mapInArrow(run, "doc_id long, print long, hi long, lo long, n long, bands array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """hi, lo, found (the set itself) of the documents whose id is among wanted's, and of few others."""

    def run(batches):
        import pyarrow as pa

        hashes, sent = WordHashes(), set()
        for batch in slices(batches):
            kept = []
            for t in batch.column(0).to_pylist():
                found = shingles(t, hashes)
                if len(found) and (key := digest(found)) not in sent:  # copies in one task are sent once
                    sent.add(key)
                    kept.append((*key, found.tobytes()))
                    if len(sent) > 100_000:
                        sent.clear()
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in kept], k) for c, k in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["hi", "lo", "found"])

    return marked(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "doc_id", wanted).where("marked").select("row.text").mapInArrow(run, "hi long, lo long, found binary")


def judged_rows(docs: DataFrame, threshold: float, tolerance: float, text: str, doc_id: str) -> DataFrame:
    """One row per document: doc_id, print, class_id, n_links, best (doc_id and print that stay of its group), total (rows of it)."""
    light = stored(digests(docs, text, doc_id), "shingle-digests")
    known = light.where("hi is not null and doc_id is not null")
    classes = known.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "print")).alias("best"), F.count("*").alias("size"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = stored(classes.withColumn("key", F.monotonically_increasing_id()), "shingle-classes")  # ids may repeat, keys don't

    banded = classes.select("key", F.posexplode("bands").alias("band", "value"))
    # written, so that the join below has a shuffle on either side and adaptive execution can split a crowded band
    least = stored(banded.groupBy("band", "value").agg(F.min("key").alias("m"), F.count("*").alias("c")).where("c > 1").drop("c"), "band-heads")
    edges = banded.join(least, ["band", "value"]).select(F.col("key").alias("a"), F.col("m").alias("b"))
    groups = components(edges, "band-components")

    members = classes.select("key", "hi", "lo", "best.doc_id", "size", "n").join(groups.withColumnRenamed("node", "key"), "key")
    weight = members.groupBy("component").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_CLASSES)).cast("long").alias("blocks"))
    members = stored(members.join(weight, "component"), "band-members")
    sets = sets_of(docs, members.select("doc_id"), text, doc_id).join(members, ["hi", "lo"]).select("component", "key", "size", "blocks", "found")
    dealt = block_pairs(sets, "blocks", "key")

    def verify(table, starts):
        import pyarrow as pa

        keys, block, size, bi, bj = (table.column(c).to_numpy() for c in ("key", "block", "size", "bi", "bj"))
        data = table.column("found")
        out: list[list] = [[], [], []]
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
            rows = lo + np.unique(keys[lo:hi], return_index=True)[1]  # a class that came from several tasks
            if len(rows) < 2:
                continue
            linked = linked_sets([np.frombuffer(data[r].as_py(), np.uint64) for r in rows.tolist()], threshold, tolerance)
            if bi[lo] != bj[lo]:
                linked &= block[rows][:, None] != block[rows]
            n = linked @ size[rows]
            for i in np.flatnonzero(n).tolist():
                for c, v in zip(out, (keys[rows[i]], n[i], None)):
                    c.append(v)
            for i, j in forest_of(linked):
                for c, v in zip(out, (keys[rows[i]], 0, keys[rows[j]])):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "n", "b"])

    links = stored(map_groups(dealt, ["component", "bi", "bj"], verify, "a long, n long, b long"), "jaccard-links")
    found = stored(components(links.where("b is not null").select("a", "b"), "jaccard-components").withColumnRenamed("node", "key"), "jaccard-groups")
    counts = links.groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("more"))
    heads = found.join(classes.select("key", "best", "size"), "key").groupBy("component").agg(F.min("best").alias("head"), F.sum("size").alias("rows"))
    judged = classes.join(counts, "key", "left").join(found.join(heads, "component"), "key", "left").select(
        "hi", "lo", F.col("best.doc_id").alias("class_id"), (F.coalesce("more", F.lit(0)) + F.col("size") - 1).alias("n_links"),
        F.coalesce("head", "best").alias("best"), F.coalesce("rows", "size").alias("total"))
    joined = known.select("doc_id", "print", "hi", "lo").join(judged, ["hi", "lo"]).drop("hi", "lo")
    alone = light.where("hi is null or doc_id is null").select("doc_id", "print", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.struct("doc_id", "print").alias("best"), F.lit(1).cast("long").alias("total"))
    return joined.union(alone)


def link(docs: DataFrame, *, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, class_id, n_links, component_id, kept."""
    kept = F.struct("doc_id", "print") == F.col("best")
    return judged_rows(docs, threshold, tolerance, text, doc_id).select("doc_id", "class_id", "n_links", F.col("best.doc_id").alias("component_id"), kept.alias("kept"))


def keep_one(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each group of near-duplicates: the one with the smallest id.

    Only documents whose id may stand for one to be dropped or repeated are joined with the verdicts; the others stay where
    they are.
    """
    rows = stored(judged_rows(docs, threshold, TOLERANCE, text, doc_id).where("total > 1").select("doc_id", "print", (F.struct("doc_id", "print") == F.col("best")).alias("stays")), "jaccard-verdicts")
    verdicts = rows.groupBy("doc_id", "print").agg(F.first("stays").alias("stays"), F.count("*").alias("n")).where("not stays or n > 1").select(F.col("doc_id").alias("_id"), F.col("print").alias("_print"), "stays")
    verdicts = stored(verdicts, "jaccard-dropped")
    dealt = marked(docs, doc_id, verdicts.select(F.col("_id").alias(doc_id)))
    clear = dealt.where("not marked").select("row.*")
    asked = dealt.where("marked").select("row", F.col("row")[doc_id].cast("long").alias("_id"), F.xxhash64(F.col("row")[text]).alias("_print")).join(verdicts, ["_id", "_print"], "left")
    single = asked.where("stays is null").select("row.*")
    # equal in id and text: one row, by a hash over all its columns
    again = asked.where("stays").groupBy("_id", "_print").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
    return clear.unionAll(single).unionAll(again)

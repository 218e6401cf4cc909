"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine over a block-max inverted index.

1. A text's vector holds all its words (by 64-bit hash): log term frequency times idf. Words that occur more often in the
   positive ones of at most MAX_EXAMPLES labelled documents weigh 1 + sqrt(likelihood ratio) times as much, all others once;
   no word is left out of a vector or its norm.
2. Document frequencies are counted over all documents, in one distributed pass: exactly for each word of the examples, in
   2^OTHER_BITS counters by hash for the words of no example, which only enter a text's norm.
3. The examples' unit vectors become an inverted index in blocks of BLOCK alike examples, with each block's largest weight
   for the DENSE most frequent words. Its size is bounded by the examples' words, so it is broadcast.
4. Each document looks for its K nearest examples: the postings of rarer words are added up in full, the frequent words
   block by block, where the block's upper bound reaches the K-th best so far. What remains is computed again in double
   precision, so the result is that of a full scan. Ties go to smaller example ids.
5. Votes weigh by squared cosine, with PRIOR votes for the base rate; a monotone map fitted to the examples' own
   leave-one-out votes turns them into scores. `evidence` lists the nearest examples.

Defined results: texts without words (null and empty ones too) have no neighbours and the examples' rate of such texts as
score; texts that share no word with an example score as the base rate; several labels of one document count as their
mean, rounded up; repeated rows get repeated scores; without labels all scores are 0; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditweave.llm.common import WordHashes, give_back
from auditweave.llm.common import slices as pieces
from auditweave.llm.quality import one_label, sample_labels

MAX_EXAMPLES = 12_000
K = 15
BLOCK = 64
DENSE = 512
FIRST = 3
BATCH = 128
OTHER_BITS = 20
MARGIN = 1e-5
PRIOR = 0.3
THRESHOLD = 0.3
WORDS = re.compile(r"\w+")
#: Latin-1 bytes as they are where WORDS takes them, spaces else.
WORD_BYTES = bytes(b if WORDS.match(chr(b)) else 32 for b in range(256))


def words_of(text: str | None) -> list[str]:
    """WORDS in the lower-cased text, in order; texts that Latin-1 holds, which most are, take a third of the time."""
    text = (text or "").lower()
    try:
        return text.encode("latin-1").translate(WORD_BYTES).decode("latin-1").split()
    except UnicodeEncodeError:
        return WORDS.findall(text)


def term_counts(text: str | None, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the text's words, and how often each occurs."""
    found = Counter(words_of(text))
    return hashes.of(found), np.fromiter(found.values(), np.int64, len(found))


def find(keys: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of hashes in ascending keys, and which of them are there."""
    if not len(keys):
        return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
    at = np.searchsorted(keys, words).clip(max=len(keys) - 1)
    return at, keys[at] == words


def look_up(keys: np.ndarray, words) -> np.ndarray:
    """The places of different words in ascending keys, or -1 - their counters."""
    import xxhash

    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, [w.encode("utf-8", "surrogatepass") for w in words]), np.uint64, len(words))
    at, known = find(keys, hashes)
    return np.where(known, at, -1 - other(hashes))


class Places(dict):
    """word -> its place in ascending keys, or -1 - its counter; holds the words that were looked up together last."""

    def __init__(self, keys: np.ndarray):
        super().__init__()
        self.keys = keys

    def learn(self, words) -> None:
        """Looks up the words, each once, in place of those before."""
        self.clear()
        self.update(dict.fromkeys(words))
        self.update(zip(list(self), look_up(self.keys, self).tolist()))

    def of(self, words) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def counted(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text the places of its words, and how often each occurs."""
        found = [Counter(words_of(t)) for t in texts]
        self.learn(chain.from_iterable(found))
        return [(self.of(c), np.fromiter(c.values(), np.int64, len(c))) for c in found]


def other(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - OTHER_BITS)).astype(np.int64)


def likelihood_ratios(a: np.ndarray, b: np.ndarray, n: int, m: int) -> np.ndarray:
    """Of terms in a of n positive and b of m negative documents; 0 where not more frequent among the positive."""
    if not n or not m:
        return np.zeros(len(a))
    part = lambda x, e: x * np.log(np.where(x > 0, x, 1) / np.where(x > 0, e, 1))
    p = (a + b) / (n + m)
    return np.where(a / n > b / m, 2 * (part(a, n * p) + part(n - a, n * (1 - p)) + part(b, m * p) + part(m - b, m * (1 - p))), 0.0).clip(0)


def slices(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of all slices, one after another."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class Index:
    """Block-max inverted index of unit vectors over all words."""

    def __init__(self, ids: list[int], labels: list[int], counts: list[dict[str, int]], terms: dict[str, int], df: dict[str, int], n_docs: int):
        """From words; `build` takes hashes."""
        hashes = WordHashes()
        by = {hashes[t]: df.get(t, 0) for t in terms}
        keys = np.array(sorted(by), np.uint64)
        self.build(ids, labels, [self.hashed(c) for c in counts], keys, np.array([by[k] for k in keys.tolist()]), np.zeros(1 << OTHER_BITS), n_docs)

    @classmethod
    def of(cls, *args) -> Index:
        index = cls.__new__(cls)
        index.build(*args)
        return index

    @staticmethod
    def hashed(counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        return WordHashes().of(list(counts)), np.array(list(counts.values()), np.int64)

    def build(self, ids: list[int], labels: list[int], counts: list[tuple[np.ndarray, np.ndarray]], keys: np.ndarray, df: np.ndarray, others: np.ndarray, n_docs: int) -> None:
        self.keys = keys
        positive, negative, n = np.zeros(len(keys)), np.zeros(len(keys)), sum(1 for y in labels if y)
        for y, (words, _) in zip(labels, counts):
            at, known = find(keys, words)
            (positive if y else negative)[at[known]] += 1
        self.idf_of = np.concatenate(((np.log((1 + n_docs) / (1 + df)) + 1) * (1 + np.sqrt(likelihood_ratios(positive, negative, n, len(labels) - n))), (np.log((1 + n_docs) / (1 + others)) + 1)[::-1]))
        self.common = np.argsort(-(positive + negative), kind="stable")[:DENSE]
        vectors = [(i.astype(np.int32), v) for i, v in (self.weighed(*c) for c in counts)]
        kept = np.array([k for k, (i, _) in enumerate(vectors) if len(i)], np.int64)
        kept = kept[self.alike(np.array(ids, np.int64)[kept], [vectors[k] for k in kept.tolist()])]
        self.ids, self.labels = np.array(ids, np.int64)[kept], np.array(labels, np.float64)[kept]
        self.sizes = np.array([len(vectors[k][0]) for k in kept.tolist()], np.int64)
        self.i = np.concatenate([np.zeros(0, np.int32), *(vectors[k][0] for k in kept.tolist())])
        self.v = np.concatenate([np.zeros(0), *(vectors[k][1] for k in kept.tolist())])
        self.ready = False

    def alike(self, ids: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """An order in which alike examples are neighbours: by the nearest of some examples' means, over the frequent words."""
        place = np.full(len(self.keys), -1)
        place[self.common] = np.arange(len(self.common))
        x = np.zeros((len(ids), len(self.common)), np.float32)
        for row, (i, v) in zip(x, vectors):
            t = place[i]
            row[t[t >= 0]] = v[t >= 0]
        order = np.argsort(ids, kind="stable")
        means = x[order[::BLOCK]]
        near = np.zeros(len(x), np.int64)
        for _ in range(4 if len(x) else 0):
            near = (x @ (means / np.sqrt((means * means).sum(1, keepdims=True)).clip(1e-12)).T).argmax(1)
            means = np.stack([x[near == c].sum(0) if (near == c).any() else means[c] for c in range(len(means))])
        return np.lexsort((ids, near))

    def invert(self) -> None:
        """What the search needs beside the vectors, made in each process that searches."""
        self.ready = True
        n, self.n_blocks = len(self.ids), -(-len(self.ids) // BLOCK)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.place = np.full(len(self.keys), -1, np.int32)
        self.place[self.common] = np.arange(len(self.common))
        self.dense = np.zeros((self.n_blocks, len(self.common), BLOCK), np.float32)
        rare = np.zeros(len(self.i), bool)
        for b in range(self.n_blocks):  # in parts, so that little is held beside the index
            sizes = self.sizes[b * BLOCK : (b + 1) * BLOCK]
            part = slice(self.offsets[b * BLOCK], self.offsets[b * BLOCK] + sizes.sum())
            place, row = self.place[self.i[part]], np.repeat(np.arange(len(sizes)), sizes)
            own = place >= 0
            self.dense[b, place[own], row[own]] = self.v[part][own]
            rare[part] = ~own
        self.most = self.dense.max(2).T.copy() if n else np.zeros((len(self.common), 0), np.float32)
        t = self.i[rare]
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(t, minlength=len(self.keys)))))
        order = np.argsort(t, kind="stable")
        del t
        at = np.flatnonzero(rare).astype(np.int32)[order]
        del order, rare
        self.rows, self.weights = np.empty(len(at), np.uint16 if n <= 1 << 16 else np.int32), np.empty(len(at), np.float32)
        for lo in range(0, len(at), 1 << 17):
            part = slice(lo, lo + (1 << 17))
            self.rows[part] = np.searchsorted(self.offsets, at[part], "right") - 1
            self.weights[part] = self.v[at[part]]
        self.query = np.zeros(len(self.keys))

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("keys", "idf_of", "ids", "labels", "sizes", "i", "v", "common")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.ready = False

    def weighed(self, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The part of a unit vector on the examples' words; its norm is that of all words."""
        at, known = find(self.keys, words)
        return self.placed(np.where(known, at, -1 - other(words)), counts)

    def placed(self, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`weighed` of places that Places gives."""
        known = at >= 0
        v = (1 + np.log(counts)) * self.idf_of[at]  # counters stand at the end, backwards
        return at[known], v[known] / np.sqrt((v * v).sum()) if len(v) else v

    def vector(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        return self.weighed(*self.hashed(counts))

    def nearest(self, i: np.ndarray, v: np.ndarray, k: int = K, but: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the k nearest examples with a cosine above 0, without the example whose id is `but`."""
        return self.nearest_of([(i, v)], k, None if but is None else [but])[0]

    def nearest_of(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = K, but: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """`nearest` of each vector, together."""
        if not self.ready:
            self.invert()
        if not self.n_blocks:
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(vectors)
        n, width = len(vectors), self.n_blocks * BLOCK
        scores, q = np.zeros((n, width), np.float32), np.zeros((n, len(self.common)), np.float32)
        for b, (i, v) in enumerate(vectors):
            place = self.place[i]
            q[b, place[place >= 0]] = v[place >= 0]
            rare = place < 0
            i = i[rare]
            sizes = self.starts[i + 1] - self.starts[i]
            at = slices(self.starts[i], sizes)
            weights = self.weights.take(at)
            weights *= np.repeat(v[rare].astype(np.float32), sizes)
            scores[b] = np.bincount(self.rows.take(at), weights, width)
        if but is not None:
            for b, i in enumerate(but):
                scores[b, np.flatnonzero(self.ids == i)] = -4.0
        blocks = scores.reshape(n, self.n_blocks, BLOCK)
        bounds = blocks.max(2) + q @ self.most
        first = np.argsort(-bounds, 1, kind="stable")[:, : max(FIRST, -(-k // BLOCK))]
        need = np.zeros(bounds.shape, bool)
        np.put_along_axis(need, first, True, 1)
        self.finish(blocks, q, need)
        best = np.take_along_axis(blocks, first[:, :, None], 1).reshape(n, -1)
        floor = np.partition(best, -k, 1)[:, -k].clip(0) if best.shape[1] >= k else np.zeros(n)
        later = (bounds > 0) & (bounds >= floor[:, None] - MARGIN) & ~need
        self.finish(blocks, q, later)
        blocks[~(need | later)] = 0
        out = []
        for b, (i, v) in enumerate(vectors):
            rows = np.flatnonzero((scores[b] > 0) & (scores[b] >= floor[b] - MARGIN))
            if len(rows) > k:
                rows = rows[scores[b, rows] >= np.partition(scores[b, rows], -k)[-k] - MARGIN]
            if not len(rows):
                out.append((rows, np.zeros(0)))
                continue
            self.query[i] = v
            sizes, parts = self.sizes[rows], [slice(x, x + n) for x, n in zip(self.offsets[rows].tolist(), self.sizes[rows].tolist())]
            products = self.query.take(np.concatenate([self.i[p] for p in parts]))
            products *= np.concatenate([self.v[p] for p in parts])
            exact = np.add.reduceat(products, np.cumsum(sizes) - sizes)
            self.query[i] = 0
            best = np.lexsort((self.ids[rows], -np.round(exact, 12)))[:k]
            out.append((rows[best], exact[best]))
        return out

    def finish(self, blocks: np.ndarray, q: np.ndarray, need: np.ndarray) -> None:
        """Adds the frequent words' part where needed."""
        for b in np.flatnonzero(need.any(0)).tolist():
            r = np.flatnonzero(need[:, b])
            blocks[r, b] += q[r] @ self.dense[b]


def vote(labels: np.ndarray, cosines: np.ndarray, rate: float) -> float:
    weight = cosines * cosines
    return float(((weight * labels).sum() + PRIOR * rate) / (weight.sum() + PRIOR))


def monotone(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: vote levels and their rates."""
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []  # sum of votes, sum of labels, count
    for x, y in zip(votes[order].tolist(), labels[order].tolist()):
        pools.append([x, y, 1])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            a, b, c = pools.pop()
            pools[-1] = [pools[-1][0] + a, pools[-1][1] + b, pools[-1][2] + c]
    return np.array([s / n for s, _, n in pools]), np.array([(y + 0.5) / (n + 1) for _, y, n in pools])


class Model:
    """sent: a broadcast of the index, if there is one; tasks then get the model without it."""

    def __init__(self, index: Index, rate: float, silent: float, levels: np.ndarray, rates: np.ndarray, sent=None):
        self.index, self.rate, self.silent, self.levels, self.rates, self.sent = index, rate, silent, levels, rates, sent

    def __getstate__(self) -> dict:
        return self.__dict__ | ({"index": None} if self.sent else {})

    def score(self, text: str | None) -> tuple[float, list[int]]:
        return self.scores([text], Places(self.index.keys))[0]

    def scores(self, texts: list[str | None], places: Places) -> list[tuple[float, list[int]]]:
        counts, out = places.counted(texts), []
        for lo in range(0, len(counts), BATCH):
            part = counts[lo : lo + BATCH]
            for (words, _), (rows, cosines) in zip(part, self.index.nearest_of([self.index.placed(*c) for c in part])):
                raw = vote(self.index.labels[rows], cosines, self.rate)
                out.append((float(np.clip(np.interp(raw, self.levels, self.rates), 0, 1)) if len(words) else self.silent, self.index.ids[rows].tolist()))
        return out


def document_frequencies(docs: DataFrame, keys: np.ndarray, text: str = "text") -> tuple[np.ndarray, np.ndarray, int]:
    """In how many of all documents each word of ascending keys occurs, other words by counter, and how many documents there are."""
    sent = docs.sparkSession.sparkContext.broadcast(keys)

    def count(batches):
        import pyarrow as pa

        give_back()  # what earlier tasks of this worker left
        known, total, words = sent.value, 0, Counter()
        found = np.zeros(len(known) + (1 << OTHER_BITS), np.int64)

        def add() -> None:
            at, n = look_up(known, words), np.fromiter(words.values(), np.int64, len(words))
            np.add.at(found, np.where(at >= 0, at, len(known) - 1 - at), n)
            words.clear()

        for batch in batches:
            for t in (x.as_py() for x in batch.column(0)):
                total += 1
                words.update(set(words_of(t)))
                if len(words) > 100_000:
                    add()
        add()
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(found[at], total), pa.int64())], names=["term", "n"])

    rows = docs.select(text).mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # at most the keys and counters
    term, n = rows.column("term").to_numpy(), rows.column("n").to_numpy()
    out = np.zeros(len(keys) + (1 << OTHER_BITS), np.int64)
    out[term[term >= 0]] = n[term >= 0]
    return out[: len(keys)], out[len(keys) :], int(n[term < 0].sum())


def train(docs: DataFrame, labels: DataFrame, label: str, use: Callable[[Column], Column], *, statistics: DataFrame | None = None, most: int = MAX_EXAMPLES, text: str = "text", doc_id: str = "doc_id") -> Model:
    """A model of the labelled rows whose id passes `use`; statistics: the documents to count over, docs unless given."""
    chosen = sample_labels(one_label(labels.where(use(F.col(doc_id))), label, doc_id), most, doc_id)
    rows = docs.select(doc_id, text).dropna(subset=[doc_id]).join(F.broadcast(chosen.select(doc_id, "label")), doc_id)  # at most `most` ids
    rows = rows.select(F.col(doc_id).cast("long").alias("doc_id"), "label", F.col(text).alias("text"))

    def counts_of(batches):
        import pyarrow as pa

        give_back()  # what earlier tasks of this worker left
        hashes = WordHashes()
        for batch in pieces(batches):
            found = [term_counts(t, hashes) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([w.view(np.int64) for w, _ in found], pa.list_(pa.int64())), pa.array([n.astype(np.int32) for _, n in found], pa.list_(pa.int32()))],
                names=["doc_id", "label", "words", "counts"],
            )

    got = rows.mapInArrow(counts_of, "doc_id long, label int, words array<long>, counts array<int>").toArrow()  # at most `most` documents
    ids, truth = got.column("doc_id").to_pylist(), got.column("label").to_pylist()
    counts = [(w.values.to_numpy().view(np.uint64), n.values.to_numpy()) for w, n in zip(got.column("words"), got.column("counts"))]
    order = sorted(range(len(ids)), key=lambda k: (ids[k], truth[k], counts[k][0].tobytes(), counts[k][1].tobytes()))
    ids, truth, counts = ([x[k] for k in order] for x in (ids, truth, counts))
    keys = np.unique(np.concatenate([w for w, _ in counts])) if counts else np.zeros(0, np.uint64)
    df, others, n_docs = document_frequencies(statistics if statistics is not None else docs, keys, text) if len(keys) else (np.zeros(0), np.zeros(1 << OTHER_BITS), 0)
    index = Index.of(ids, truth, counts, keys, df, others, n_docs)
    rate = sum(truth) / len(truth) if truth else 0.0
    without = [y for y, (w, _) in zip(truth, counts) if not len(w)]
    silent = (sum(without) + 0.5 * rate) / (len(without) + 0.5) if truth else 0.0
    del got, counts, keys, df, others
    give_back()
    if not len(index.ids):
        return Model(index, rate, silent, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def votes_of(batches):
        import pyarrow as pa

        give_back()  # what earlier tasks of this worker left
        own = sent.value
        places = Places(own.keys)
        for batch in pieces(batches, BATCH):
            all_ids, y, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), places.counted(batch.column(2).to_pylist())
            found = own.nearest_of([own.placed(*c) for c in counts], but=all_ids)
            made = [(i, c, vote(own.labels[r], cosines, rate)) for i, c, (w, _), (r, cosines) in zip(all_ids, y, counts, found) if len(w)]
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.int32()), pa.array([m[2] for m in made], pa.float64())], names=["doc_id", "label", "vote"])

    votes = sorted(map(tuple, rows.mapInArrow(votes_of, "doc_id long, label int, vote double").collect()))  # at most `most` documents
    return Model(index, rate, silent, *monotone(np.array([v for _, _, v in votes]), np.array([y for _, y, _ in votes], float)), sent)


def score(docs: DataFrame, model: Model, *, text: str = "text", output: str = "score", evidence: str = "evidence") -> DataFrame:
    """docs with a score (0 to 1) and the ids of the nearest examples, nearest first, in columns that replace any of those names."""
    docs = docs.select([c for c in docs.columns if c.lower() not in (output.lower(), evidence.lower())])
    model.sent, at = model.sent or docs.sparkSession.sparkContext.broadcast(model.index), docs.columns.index(text)

    def run(batches):
        import pyarrow as pa

        give_back()  # what earlier tasks of this worker left
        model.index = model.sent.value  # the same in all tasks of a worker, those that voted too
        places = Places(model.index.keys)
        for batch in pieces(batches):
            found = model.scores(batch.column(at).to_pylist(), places)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s for s, _ in found], pa.float64()), pa.array([e for _, e in found], pa.list_(pa.int64()))], names=[*batch.schema.names, output, evidence])
        places.clear()
        give_back()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, `{output}` double, `{evidence}` array<long>")

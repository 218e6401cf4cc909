"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

A text's features are its words and runs of punctuation (case kept) and the pairs of neighbours, hashed to 2^18 indices;
values are log counts scaled to unit length, so long texts weigh no more than short ones, beside one bias feature. Training
takes at most MAX_EXAMPLES labelled documents, dealt by a hash of their ids, featurised by Spark and read by one task in
hash order: per-coordinate FTRL-proximal updates over EPOCHS passes. The weights (bounded by the number of indices) go to
every executor, and each whole text is scored as a sparse dot product.

Defined results: null and empty texts have the bias alone; a document labelled more than once counts as the mean of its
labels, rounded up; labels that are null or of no document are left out; without any training label the score is 0.5 for
all; repeated rows get repeated scores; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditweave.llm.common import WordHashes, give_back, mix64

BITS = 18
MAX_EXAMPLES = 12_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.2
THRESHOLD = 0.3
TOKENS = re.compile(r"\w+|[^\w\s]+")


def features(text: str | None, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values; index 0 is the bias."""
    words = hashes.of(TOKENS.findall(text or ""))
    with np.errstate(over="ignore"):
        pairs = mix64(words[:-1] * np.uint64(3) + words[1:]) if len(words) > 1 else words[:0]
    index, count = np.unique(np.concatenate((words, pairs)) % np.uint64((1 << BITS) - 1), return_counts=True)
    value = np.log1p(count)
    norm = np.sqrt((value * value).sum()) or 1.0
    return np.concatenate(([0], index.astype(np.int64) + 1)), np.concatenate(([1.0], value / norm * 4))


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Indices and weights that are not zero, after per-coordinate updates in the order given."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for i, x, y in examples:
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            grown = n[i] + g * g
            z[i] += g - (np.sqrt(grown) - np.sqrt(n[i])) / ALPHA * w
            n[i] = grown
    w = weights(np.arange(1 << BITS))
    at = np.flatnonzero(w)
    return at, w[at]


def one_label(labels: DataFrame, label: str, doc_id: str = "doc_id") -> DataFrame:
    return labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg((F.avg(label) >= 0.5).cast("int").alias("label"))


def sample_labels(labels: DataFrame, most: int, doc_id: str = "doc_id") -> DataFrame:
    """About `most` rows at the most, by a hash of their ids: doc_id, label, turn (the hash)."""
    turn = F.pmod(F.xxhash64(doc_id, F.lit("turn")), F.lit(1 << 40))
    dealt = labels.withColumn("turn", turn)
    total = dealt.count()
    return dealt.where(F.col("turn") < int((1 << 40) * 0.97 * most / total)) if total > 0.97 * most else dealt


def train(docs: DataFrame, labels: DataFrame, label: str, use: Callable[[Column], Column], *, most: int = MAX_EXAMPLES, text: str = "text", doc_id: str = "doc_id") -> tuple[np.ndarray, np.ndarray]:
    """Weights from the labelled rows whose id passes `use`."""
    chosen = sample_labels(one_label(labels.where(use(F.col(doc_id))), label, doc_id), most, doc_id)
    rows = docs.select(doc_id, text).join(F.broadcast(chosen), doc_id)  # at most `most` ids

    def featurise(batches):
        import pyarrow as pa

        hashes = WordHashes()
        for batch in batches:
            turn, y, texts = (batch.column(i).to_pylist() for i in range(3))
            found = [features(t, hashes) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * len(y), pa.int32()), pa.array(turn, pa.int64()), pa.array(y, pa.int32()), pa.array([i.astype(np.int32) for i, _ in found], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32()))],
                names=["part", "turn", "y", "i", "v"],
            )

    def learn(rows):
        import pyarrow as pa

        order = np.argsort(rows.column("turn").to_numpy(), kind="stable")
        y, i, v = rows.column("y").to_numpy(), rows.column("i").combine_chunks(), rows.column("v").combine_chunks()
        off, i, v = i.offsets.to_numpy(), i.values.to_numpy(), v.values.to_numpy()
        at, w = ftrl([(i[off[k] : off[k + 1]], v[off[k] : off[k + 1]], y[k]) for k in order.tolist()])
        return pa.table({"i": pa.array(at, pa.int32()), "w": pa.array(w, pa.float64())})

    sparse = rows.select("turn", "label", text).mapInArrow(featurise, "part int, turn long, y int, i array<int>, v array<float>")
    model = sparse.groupBy("part").applyInArrow(learn, "i int, w double").toPandas()  # bounded by the number of indices
    return model.i.to_numpy(), model.w.to_numpy()


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], *, text: str = "text", output: str = "score") -> DataFrame:
    """docs with a score, 0 to 1, in column `output`, which replaces one of that name."""
    docs = docs.select([c for c in docs.columns if c.lower() != output.lower()])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        import pyarrow as pa

        give_back()  # what earlier tasks of this worker left
        hashes, dense = WordHashes(), np.zeros(1 << BITS)
        dense[sent.value[0]] = sent.value[1]
        for batch in batches:
            out = np.empty(batch.num_rows)
            for k, t in enumerate(batch.column(at)):
                i, v = features(t.as_py(), hashes)
                out[k] = 1 / (1 + np.exp(-np.clip(dense[i] @ v, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, output])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, `{output}` double")

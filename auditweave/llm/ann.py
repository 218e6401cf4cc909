"""Approximate nearest neighbours by cross-polytope hashing.

A hash turns a unit vector by a fast pseudo-rotation (three rounds of random signs and a Hadamard transform) and takes the
nearest signed axis; a table's code joins one, two or more hashes, more of them for more rows. A vector has one code in each
table; a query probes the codes whose axes are nearest in sum. Vectors of about one length form a band with tables of its
own, because nearness of direction, which the hash sees, then orders inner products; every band is searched.

How many hashes, tables and probes a band gets follows from its rows and width (`plan`). The shares were measured on vectors
without any structure, the hardest case, for a recall of 0.95 and above; clustered vectors do better.

Codes are dealt to groups of about BLOCK vectors by hash. A vector goes to one group of each table; a query goes once to each
group that holds some of its codes, with those codes. Groups crowded by copies are cut into parts, which a query visits all.
Inside, products are taken code by code, and each query's K best of the group leave it with exact scores. A first search of
one code in SCOUT gives each query a floor, the K-th best so far, below which nothing leaves a group in the full search: so
what groups return grows with the queries, not with queries times groups.

Defined results: null, zero and non-finite vectors take no part; a repeated vec_id is one vector; fewer candidates than K
give fewer rows; ties go to the smaller vec_id; an empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditweave.llm.common import mix64, stored
from auditweave.llm.groups import map_groups
from auditweave.llm.vectors import comparable, matrix, unit, widened

K = 20
BLOCK = 4096
PER_CODE = 32  # vectors a code has at least, on average, before another hash is joined
MOST_CROWDED = 100_000
SCOUT = 12
SEED = 20_240_229


class Plan(NamedTuple):
    """One band's tables."""

    hashes: int
    tables: int
    probes: int
    groups: int


def plan(rows: int, width: int, tables: int | None = None, probes: int | None = None) -> Plan:
    """Share of the axes that four tables have to probe: 0.19 at 50,000 rows and width 64, more for fewer rows (whose twentieth neighbour is farther) and wider vectors."""
    axes = 2 << max(0, width - 1).bit_length()
    hashes = 1
    while rows >= PER_CODE * axes ** (hashes + 1):
        hashes += 1
    share = min(1.0, 0.19 * (50_000 / max(rows, 1)) ** 0.115 * max(1.0, width / 64) ** 0.385)
    wanted = round(axes**hashes * share ** (0.95 * hashes))
    return Plan(hashes, tables or 2 + 2 * hashes, max(1, min(probes or wanted, axes**hashes)), -(-rows // BLOCK))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, unscaled."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), 2).reshape(n, d)
        h *= 2
    return x


@lru_cache(4)
def signs(width: int, hashes: int) -> np.ndarray:
    return np.random.default_rng([SEED, width]).choice([-1.0, 1.0], (hashes, 3, width))


def turned(x: np.ndarray, hashes: int):
    """For each hash, the rows' products with all signed axes: coordinates, then their negatives."""
    width = 1 << max(0, x.shape[1] - 1).bit_length()
    x = widened(x, width)
    for rounds in signs(width, hashes):
        y = x
        for s in rounds:
            y = hadamard(y * s) / np.sqrt(width)
        yield np.concatenate((y, -y), 1)


def codes(x: np.ndarray, p: Plan) -> np.ndarray:
    """Each unit row's code in each table."""
    own = np.stack([y.argmax(1) for y in turned(x, p.tables * p.hashes)], 1).reshape(len(x), p.tables, p.hashes)
    axes, out = 2 << max(0, x.shape[1] - 1).bit_length(), np.zeros(own.shape[:2], np.int64)
    for h in range(p.hashes):
        out = out * axes + own[:, :, h]
    return out


def probed(x: np.ndarray, p: Plan) -> np.ndarray:
    """Each unit row's p.probes codes in each table, those with the least distance to their axes in sum."""
    out = np.empty((len(x), p.tables, p.probes), np.int64)
    axes = 2 << max(0, x.shape[1] - 1).bit_length()
    for lo in range(0, len(x), 64):
        part = x[lo : lo + 64]
        found = turned(part, p.tables * p.hashes)
        for t in range(p.tables):
            loss, code = np.zeros((len(part), 1)), np.zeros((len(part), 1), np.int64)
            for _ in range(p.hashes):  # losses only grow, so the best sums begin with the best sums of fewer hashes
                y = next(found)
                loss = (loss[:, :, None] + (y.max(1, keepdims=True) - y)[:, None]).reshape(len(part), -1)
                code = (code[:, :, None] * axes + np.arange(axes)).reshape(len(part), -1)
                if loss.shape[1] > p.probes:
                    best = np.argpartition(loss, p.probes - 1, 1)[:, : p.probes]
                    loss, code = np.take_along_axis(loss, best, 1), np.take_along_axis(code, best, 1)
            out[lo : lo + 64, t] = code
    return out


def band(x: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.sqrt((x * x).sum(1))) * 4 + 0.5).astype(np.int64)


class Deal:
    """Where a band's codes go. Groups are numbered over all bands; a group's parts follow each other."""

    def __init__(self, plans: dict[int, Plan], crowded: dict[int, int]):
        self.plans, self.sizes, self.first, at = plans, crowded, {}, 0
        for b, p in plans.items():
            self.first[b] = at
            at += p.tables * p.groups
        self.crowded = np.array(sorted(crowded), np.int64)
        self.parts = np.array([crowded[g] for g in sorted(crowded)], np.int64)

    def group(self, b: int, table: np.ndarray, code: np.ndarray) -> np.ndarray:
        p = self.plans[b]
        return self.first[b] + table * p.groups + (mix64(code) % np.uint64(p.groups)).astype(np.int64)

    def parts_of(self, group: np.ndarray) -> np.ndarray:
        out = np.ones(len(group), np.int64)
        if len(self.crowded):
            at = np.searchsorted(self.crowded, group).clip(max=len(self.crowded) - 1)
            out = np.where(self.crowded[at] == group, self.parts[at], 1)
        return out

    def vectors(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, group and code of every table."""
        own, out = band(x), []
        for b, p in self.plans.items():
            rows = np.flatnonzero(own == b)
            code = codes(unit(x[rows]), p).ravel()
            out.append((np.repeat(rows, p.tables), self.group(b, np.tile(np.arange(p.tables), len(rows)), code), code))
        return tuple(map(np.concatenate, zip(*out)))

    def queries(self, x: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row and group of every visit, and the visits' codes: starts and values."""
        out, u = [], unit(x[rows])
        for b, p in self.plans.items():
            code = probed(u, p).ravel()
            row, table = np.repeat(rows, p.tables * p.probes), np.tile(np.repeat(np.arange(p.tables), p.probes), len(rows))
            out.append((row, self.group(b, table, code), code))
        row, group, code = map(np.concatenate, zip(*out))
        order = np.lexsort((group, row))
        row, group, code = row[order], group[order], code[order]
        starts = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (group[1:] != group[:-1])))) if len(row) else np.zeros(0, np.int64)
        return row[starts], group[starts], np.append(starts, len(code)), code


def best_of_group(ids: np.ndarray, x: np.ndarray, is_query: np.ndarray, starts: np.ndarray, code: np.ndarray, k: int, floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """query id, vector id and score of each query's k best among the vectors with its codes; row r's codes are code[starts[r]:starts[r + 1]]."""
    qs, ds = np.flatnonzero(is_query), np.flatnonzero(~is_query)
    if not len(qs) or not len(ds):
        return None
    own = code[starts[ds]]
    ds = ds[np.argsort(own, kind="stable")]
    own = code[starts[ds]]
    sizes = starts[qs + 1] - starts[qs]
    asking = np.repeat(np.arange(len(qs)), sizes)
    asked = code[np.repeat(starts[qs] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
    order = np.argsort(asked, kind="stable")
    asking, asked = asking[order], asked[order]
    kinds, at = np.unique(asked, return_index=True)
    at, lo, hi = np.append(at, len(asked)), np.searchsorted(own, kinds), np.searchsorted(own, kinds, "right")
    q, v = x[qs], x[ds]
    slack = 1e-12 * np.sqrt((q * q).sum(1)) * np.sqrt((v * v).sum(1).max())  # products of another order of summing
    floor, pairs = np.full(len(qs), -np.inf) if floors is None else floors[qs] - slack, []
    for i in np.flatnonzero(hi > lo).tolist():
        for a in range(at[i], at[i + 1], 512):
            who = asking[a : min(a + 512, at[i + 1])]
            s = q[who] @ v[lo[i] : hi[i]].T
            s[ids[qs[who]][:, None] == ids[ds[lo[i] : hi[i]]]] = -np.inf
            if s.shape[1] > k:
                floor[who] = np.maximum(floor[who], np.partition(s, -k, 1)[:, -k] - slack[who])
            r, c = np.nonzero((s >= floor[who][:, None]) & (s > -np.inf))
            pairs.append((who[r], c + lo[i]))
    if not pairs:
        return None
    a, b = map(np.concatenate, zip(*pairs))
    score = np.concatenate([(q[a[i : i + 65536]] * v[b[i : i + 65536]]).sum(1) for i in range(0, max(1, len(a)), 65536)])
    order = np.lexsort((ids[ds[b]], -score, a))
    a, b, score = a[order], b[order], score[order]
    kept = np.arange(len(a)) - np.searchsorted(a, a) < k
    return ids[qs[a[kept]]], ids[ds[b[kept]]], score[kept]


def dealing(rows: DataFrame, width: int, make) -> Deal | None:
    """Where vectors (vec_id, v) go; make(rows of a band) is its plan. None without rows."""

    def banded(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                b, n = np.unique(band(matrix(batch.column(0))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(n)], names=["b", "n"])

    # one count for each length, by quarters of powers of two, that occurs
    counts = {r.b: r.n for r in rows.select("v").mapInArrow(banded, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect()}
    plans = {b: make(n) for b, n in sorted(counts.items())}
    if not plans:
        return None
    plain = Deal(plans, {})

    def counted(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                g, n = np.unique(plain.vectors(widened(matrix(batch.column(0)), width))[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n)], names=["g", "n"])

    # fewer than MOST_CROWDED groups can hold more than that share of all vectors
    total = sum(n * plans[b].tables for b, n in counts.items())
    sizes = rows.select("v").mapInArrow(counted, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    return Deal(plans, {r.g: -(-r.n // BLOCK) for r in sizes.where(F.col("n") > max(2 * BLOCK, total // MOST_CROWDED)).collect()})


def found_pairs(rows: DataFrame, width: int, k: int, deal: Deal) -> DataFrame:
    """query_id, vec_id, score: of every group that a query (rows: vec_id, v, query, floor) visits its k nearest of at least its floor."""
    most = int(deal.parts.max(initial=1))
    sent = rows.sparkSession.sparkContext.broadcast(deal)

    def dealt(batches):
        import pyarrow as pa

        deal, names = sent.value, ["g", "q", "vec_id", "v", "floor", "codes"]
        for whole in batches:
            for from_ in range(0, whole.num_rows, 2048):
                batch = whole.slice(from_, 2048)
                x, ids = widened(matrix(batch.column(1)), width), batch.column(0).to_numpy()
                row, group, code = deal.vectors(x)
                part = (mix64(ids[row]) % deal.parts_of(group).astype(np.uint64)).astype(np.int64)
                take = pa.array(row)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1), pa.int32()), pa.array(code))
                yield pa.RecordBatch.from_arrays([pa.array(group * most + part), pa.array(np.zeros(len(row), bool)), batch.column(0).take(take), batch.column(1).take(take), pa.nulls(len(row), pa.float64()), lists], names=names)
                asks = np.flatnonzero(batch.column(2).to_numpy(zero_copy_only=False).astype(bool))
                for lo in range(0, len(asks), 128):
                    row, group, starts, code = deal.queries(x, asks[lo : lo + 128])
                    parts = deal.parts_of(group)
                    at = np.repeat(np.arange(len(row)), parts)
                    part = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
                    take = pa.array(row[at])
                    lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(code)).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(group[at] * most + part), pa.array(np.ones(len(at), bool)), *(batch.column(c).take(take) for c in (0, 1, 3)), lists], names=names)

    kind = rows.schema["v"].dataType.simpleString()
    placed = rows.select("vec_id", "v", "query", "floor").mapInArrow(dealt, f"g long, q boolean, vec_id long, v {kind}, floor double, codes array<long>")

    def search(table, starts):
        import pyarrow as pa

        ids, is_query, x = table.column("vec_id").to_numpy(), table.column("q").to_numpy(zero_copy_only=False), widened(matrix(table.column("v")), width)
        floors = table.column("floor").fill_null(-np.inf).to_numpy()
        lists = table.column("codes").combine_chunks()
        off, code = lists.offsets.to_numpy(), lists.values.to_numpy()
        found = []
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
            best = best_of_group(ids[lo:hi], x[lo:hi], is_query[lo:hi].astype(bool), off[lo : hi + 1], code, k, floors[lo:hi])
            if best is not None:
                found.append(best)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["query_id", "vec_id", "score"])

    return map_groups(placed, ["g"], search, "query_id long, vec_id long, score double")


def neighbours(embeddings: DataFrame, is_query, *, k: int = K, tables: int | None = None, probes: int | None = None, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row for which is_query (a Column over vec_id) holds.

    A query whose codes held fewer than k candidates probes all codes of one table, so it sees every vector.
    """
    kind = embeddings.schema[embedding].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    rows = comparable(embeddings, vec_id, embedding)
    width, total = rows.agg(F.max(F.size("v")), F.count("*")).first()
    width = width or 1
    rows = rows.select("vec_id", F.col("v").cast("array<float>").alias("v") if single else "v", F.coalesce(is_query(F.col("vec_id")), F.lit(False)).alias("query"))
    merge = lambda pairs: pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    deal = dealing(rows, width, lambda n: plan(n, width, tables, probes))
    if deal is None:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    scouts = Deal({b: p._replace(probes=-(-p.probes // SCOUT)) for b, p in deal.plans.items()}, deal.sizes)
    nothing = F.lit(None).cast("double").alias("floor")
    first = stored(merge(found_pairs(rows.select("*", nothing), width, k, scouts)), "neighbours-first")
    floors = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.try_element_at(F.sort_array(F.collect_list("score"), asc=False), F.lit(k)).alias("floor"))  # k of each table's groups at most
    best = stored(merge(first.union(found_pairs(rows.join(floors, "vec_id", "left").select("vec_id", "v", "query", "floor"), width, k, deal))), "neighbours")
    counted = best.groupBy("query_id").agg(F.count("*").alias("n"))
    short = rows.where("query").select(F.col("vec_id").alias("query_id")).join(counted, "query_id", "left").where(F.coalesce("n", F.lit(0)) < min(k, total - 1))
    short = stored(short.select(F.col("query_id").alias("vec_id"), F.lit(True).alias("query")), "neighbours-short")
    if not short.isEmpty():
        again = rows.drop("query").join(short, "vec_id", "left").select("vec_id", "v", F.coalesce("query", F.lit(False)).alias("query"), nothing)
        axes = 2 << max(0, width - 1).bit_length()
        best = merge(best.union(found_pairs(again, width, k, dealing(rows, width, lambda n: Plan(1, 1, axes, -(-n // BLOCK))))))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

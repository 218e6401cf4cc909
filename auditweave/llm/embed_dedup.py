"""Near-duplicate vectors by spherical-cap filters.

1. Equal vectors are one class, represented by its smallest id.
2. ROTATIONS random rotations each cut a vector into two halves of unit length; a filter direction is a pair of random
   codes, one for each half. List decoding finds all directions whose inner product with the vector exceeds a cap: one
   half's codes that can reach it with the other's best, then the other half's codes in descending order as far as they do.
   The number of codes grows with the square root of the rows, so that filters hold about as many vectors at any size; the
   cap follows from codes, width and threshold (cap_of).
3. Vectors meet in a filter's bucket rounded to one byte a component, with the length of what rounding changed. Pairs whose
   product can reach the threshold within that error join their trees, so a bucket gives fewer edges than members. The
   edges' components hold every candidate pair.
4. Inside components, blocks of vectors are compared exactly, in double precision; links are counted per vector with the
   classes' sizes, and only a spanning forest of the links leaves the task. The forest's components are the result.

Buckets and components beyond BLOCK members are dealt to pairs of blocks, each a group of its own. No pair of rows is ever
written out. Crowded buckets are told from one vector in SAMPLED, which only sets into how many blocks they are cut.

Defined results: vectors that are null, zero or hold null or non-finite components have no links, stand alone and are
kept; a null vec_id links with nothing; a repeated vec_id counts once and its rows are repeated; an empty table gives no
rows. No link below the threshold is reported; one just at it can be missed (none of 300 at widths 64, 128 and 384 in the
tests).
"""

from __future__ import annotations

from functools import lru_cache
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditweave.llm.common import stored
from auditweave.llm.groups import block_pairs, components, forest_of, map_groups
from auditweave.llm.vectors import comparable, matrix, unit, widened

THRESHOLD = 0.9
ROTATIONS = 20
PER_FILTER = 4  # vectors in a filter's bucket, on average
MOST_FILTERS = 1000  # a vector is caught by so many at most, on average
PAIRS = 300
SHARED = 3
BLOCK = 2048
SMALL = 32
SAMPLED = 16
MANY_HOT = 100_000


def codes_for(rows: int) -> int:
    """Codes of a half: ROTATIONS x codes^2 filters, at about 60 a vector, hold PER_FILTER vectors."""
    return int(np.clip(np.sqrt(rows * 60 / (PER_FILTER * ROTATIONS)), 32, 8192))


@lru_cache(4)
def directions(width: int, codes: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    rng = np.random.default_rng([7, width])
    turns = [np.linalg.qr(rng.normal(size=(width, width)))[0].astype(np.float32) for _ in range(ROTATIONS)]
    return turns, [(unit(rng.normal(size=(2, codes, width // 2))) / np.sqrt(2)).astype(np.float32) for _ in range(ROTATIONS)]


def halves(x: np.ndarray, codes: int):
    """For each rotation, both halves' products with their codes."""
    half = x.shape[1] // 2
    for turn, code in zip(*directions(x.shape[1], codes)):
        y = x.astype(np.float32) @ turn
        yield unit(y[:, :half]) / np.float32(np.sqrt(2)) @ code[0].T, unit(y[:, half:]) / np.float32(np.sqrt(2)) @ code[1].T


def filters_of(x: np.ndarray, cap: float, codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, filter numbers and products of all exceeding directions of unit vectors of even width."""
    out: list[list[np.ndarray]] = [[], [], []]
    for r, (a, b) in enumerate(halves(x, codes)):
        order = np.argsort(-b, 1)
        b = np.take_along_axis(b, order, 1)
        able = a + b[:, :1] >= cap
        able[np.arange(len(x)), a.argmax(1)] = True  # below the cap: the best direction
        row, first = np.nonzero(able)
        reach = np.empty(len(row), np.int64)
        for lo in range(0, len(row), 4096):
            p = slice(lo, lo + 4096)
            reach[p] = (b[row[p]] >= (cap - a[row[p], first[p]])[:, None]).sum(1)
        best = a[row, first] == a.max(1)[row]
        reach[best] = reach[best].clip(1)
        at = np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
        row, first = np.repeat(row, reach), np.repeat(first, reach)
        out[0].append(row)
        out[1].append((r * codes + first.astype(np.int64)) * codes + order[row, at])
        out[2].append(a[row, first] + b[row, at])
    return tuple(map(np.concatenate, out))


@lru_cache(16)
def cap_of(width: int, threshold: float, codes: int) -> float:
    """The level at which each of PAIRS random pairs at the threshold shares SHARED directions, or that of MOST_FILTERS.

    Of 1200 other pairs none shared no direction with lower bars than this, at widths 64 and 128, thresholds 0.9 and 0.7, and
    2,000 to 2,000,000 rows; a vector then has 50 to 100 filters at 0.9 and about 250 at 0.7.
    """
    rng = np.random.default_rng([11, width])
    x = unit(rng.normal(size=(PAIRS, width)))
    apart = rng.normal(size=x.shape)
    apart = unit(apart - (apart * x).sum(1, keepdims=True) * x)
    y = threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * apart
    share = MOST_FILTERS / (ROTATIONS * codes**2)
    least = NormalDist().inv_cdf(1 - share) / np.sqrt(width) if share < 0.5 else -1.0
    both = []
    for z in (x, y):
        row, number, level = filters_of(z, least, codes)
        both.append((row * (ROTATIONS * codes**2) + number, level))
    _, i, j = np.intersect1d(both[0][0], both[1][0], return_indices=True)
    row, level = both[0][0][i] // (ROTATIONS * codes**2), np.minimum(both[0][1][i], both[1][1][j])
    levels = [np.partition(own, -SHARED)[-SHARED] if len(own) >= SHARED else least for own in (level[row == k] for k in range(PAIRS))]
    return float(max(min(levels), least))


def rounded(x: np.ndarray) -> np.ndarray:
    """Unit vectors as bytes: a scale and the length of the error (float32), then one signed byte a component."""
    scale = np.abs(x).max(1, keepdims=True) / 127
    q = np.rint(x / scale).astype(np.int8)
    scale = scale.astype(np.float32)
    error = np.nextafter(np.sqrt(((x - q * scale.astype(float)) ** 2).sum(1, keepdims=True)).astype(np.float32), np.float32(np.inf)) + np.float32(1e-6)
    return np.concatenate((scale.view(np.uint8), error.view(np.uint8), q.view(np.uint8)), 1)


def close_pairs(said: np.ndarray, starts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of pairs within a bucket whose products can reach the threshold; of a large bucket a spanning forest of them."""
    head = said[:, :8].copy().view(np.float32)
    q, e = said[:, 8:].view(np.int8).astype(np.float32) * head[:, :1], head[:, 1]
    least = lambda a, b: threshold - 1e-5 - (a + b + a * b)
    sizes = np.diff(starts)
    bucket = np.repeat(np.arange(len(sizes)), np.where(sizes <= SMALL, sizes, 0))
    rows = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    for apart in range(1, SMALL):  # each row with the next but so many of its bucket
        at = np.flatnonzero(bucket[:-apart] == bucket[apart:])
        if not len(at):
            break
        i, j = rows[at], rows[at + apart]
        ok = np.einsum("ij,ij->i", q[i], q[j]) >= least(e[i], e[j])
        out[0].append(i[ok])
        out[1].append(j[ok])
    for lo, hi in zip(starts[:-1][sizes > SMALL].tolist(), starts[1:][sizes > SMALL].tolist()):
        close = q[lo:hi] @ q[lo:hi].T >= least(e[lo:hi, None], e[lo:hi])
        if pairs := forest_of(close):
            i, j = np.array(pairs).T + lo
            out[0].append(i)
            out[1].append(j)
    return np.concatenate(out[0]), np.concatenate(out[1])


def link(embeddings: DataFrame, *, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = comparable(embeddings, vec_id, embedding).select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    classes = stored(rows.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.first("v").alias("v")), "vector-classes")
    width, total = classes.agg(F.max(F.size("v")), F.count("*")).first()
    width = width or 2
    width += width % 2
    codes = codes_for(total)
    cap = cap_of(width, threshold, codes)

    def decode(batches):
        import pyarrow as pa

        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                x = unit(widened(matrix(batch.column(1)), width))
                row, number, _ = filters_of(x, cap, codes)
                said = rounded(x)
                kept = pa.array([said[r].tobytes() for r in range(len(x))], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(number), batch.column(0).take(pa.array(row)), kept.take(pa.array(row))], names=["filter", "rep", "said"])

    def catch(of: DataFrame) -> DataFrame:
        return of.select("rep", "v").mapInArrow(decode, "filter long, rep long, said binary")

    sample = catch(classes.where(F.pmod(F.xxhash64("rep", F.lit("sample")), F.lit(SAMPLED)) == 0)).groupBy("filter").agg((F.count("*") * SAMPLED).alias("n"))
    hot = stored(sample.where(F.col("n") > BLOCK).select("filter", F.ceil(F.col("n") / BLOCK).alias("blocks")), "hot-filters")
    few = hot.count() <= MANY_HOT
    dealt = catch(classes).join(F.broadcast(hot) if few else hot, "filter", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)).cast("long"))
    dealt = block_pairs(dealt, "blocks", "rep")

    def near(table, starts):
        import pyarrow as pa

        reps = table.column("rep").to_numpy()
        said = np.frombuffer(b"".join(table.column("said").to_pylist()), np.uint8).reshape(len(reps), 8 + width)
        i, j = close_pairs(said, starts, threshold)
        yield pa.RecordBatch.from_arrays([pa.array(reps[i]), pa.array(reps[j])], names=["a", "b"])

    edges = map_groups(dealt, ["filter", "bi", "bj"], near, "a long, b long")
    groups = stored(components(edges, "cap-candidates"), "cap-groups")
    members = classes.select("rep", "size", "v").join(groups.withColumnRenamed("node", "rep"), "rep")
    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = block_pairs(members.join(sizes, "component"), "blocks", "rep").select("component", "bi", "bj", "block", "rep", "size", "v")

    def exact(table, starts):
        import pyarrow as pa

        reps, block, size = (table.column(c).to_numpy() for c in ("rep", "block", "size"))
        x = unit(widened(matrix(table.column("v")), width))
        bi, bj = table.column("bi").to_numpy(), table.column("bj").to_numpy()
        out: list[list] = [[], [], []]
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
            linked = x[lo:hi] @ x[lo:hi].T >= threshold
            np.fill_diagonal(linked, False)
            if bi[lo] != bj[lo]:  # pairs within a block are its own pair's work
                linked &= block[lo:hi, None] != block[None, lo:hi]
            n = linked @ size[lo:hi]
            for i in np.flatnonzero(n).tolist():
                for c, v in zip(out, (reps[lo + i], n[i], None)):
                    c.append(v)
            for i, j in forest_of(linked):
                for c, v in zip(out, (reps[lo + i], 0, reps[lo + j])):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "n", "b"])

    links = stored(map_groups(dealt, ["component", "bi", "bj"], exact, "a long, n long, b long"), "cap-links")
    found = components(links.where("b is not null").select("a", "b"), "cap-links-components").withColumnRenamed("node", "rep")
    counts = links.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    judged = classes.drop("v").join(counts, "rep", "left").join(found, "rep", "left").select(
        "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    by_id = rows.select("vec_id", "h1", "h2").join(judged, ["h1", "h2"]).select(F.col("vec_id").alias("_id"), "n_links", "component_id")
    every = embeddings.select(F.col(vec_id).alias(vec_id))
    out = every.join(by_id, every[vec_id] == by_id["_id"], "left")
    component = F.coalesce("component_id", F.col(vec_id))
    return out.select(vec_id, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col(vec_id), F.lit(True)).alias("kept"))


SQL = """
with recursive v as (
  select vec_id, min(embedding::double[]) as e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
  group by vec_id),
n as (select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as norm from v),
links as (
  select a.vec_id as a, b.vec_id as b from n a join n b
    on a.vec_id <> b.vec_id and list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a)
select x.vec_id, (select count(*) from links where a = x.vec_id) as n_links,
  least(x.vec_id, coalesce((select min(b) from reach where a = x.vec_id), x.vec_id)) as component_id,
  least(x.vec_id, coalesce((select min(b) from reach where a = x.vec_id), x.vec_id)) = x.vec_id as kept
from embeddings x"""

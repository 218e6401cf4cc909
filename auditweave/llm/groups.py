"""Streaming work on groups of rows, blocks within large groups, and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditweave.llm.common import stored


def map_groups(df: DataFrame, keys: list[str], fn: Callable, schema: str) -> DataFrame:
    """fn(table, starts) -> iterator of record batches, over whole groups only; keys are long columns.

    Rows are dealt and sorted by the keys and streamed, so many small groups cost one call and a task holds no more than
    one Arrow batch beside the group at hand.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in keys])
            new = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1
            if last is None or (k[:, 0] != last).any():
                new = np.concatenate(([0], new))
            last = k[:, -1]
            if not len(new):
                held.append(batch)
                continue
            if new[-1] > 0:
                held.append(batch.slice(0, new[-1]))
            if held:
                yield from _call(fn, pa.Table.from_batches(held), keys)
            held = [batch.slice(new[-1])]
        if held:
            yield from _call(fn, pa.Table.from_batches(held), keys)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _call(fn, rows, keys: list[str]) -> Iterator:
    rows = rows.combine_chunks()
    k = np.stack([rows.column(c).to_numpy() for c in keys])
    starts = np.concatenate(([0], np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1, [rows.num_rows]))
    yield from fn(rows, starts)


def block_pairs(df: DataFrame, blocks: str, key: str) -> DataFrame:
    """Deals each group's rows to `blocks` blocks by a hash of `key`, and each row to every pair of blocks it takes part in.

    Adds block (the row's own), bi and bj (the pair, bi <= bj). A group of one block is the pair (0, 0).
    """
    own = df.withColumn("block", F.pmod(F.xxhash64(key, F.lit("block")), F.col(blocks)))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
    return own.select("*", other.alias("_other")).withColumns({"bi": F.least("block", "_other"), "bj": F.greatest("block", "_other")}).drop("_other")


def forest_of(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric Boolean matrix: breadth first, whole rows at a time."""
    n, out = len(linked), []
    new = np.ones(n, bool)
    for root in range(n):
        if not new[root]:
            continue
        new[root] = False
        front = [root]
        while front:
            x = front.pop()
            found = np.flatnonzero(linked[x] & new)
            new[found] = False
            out += [(x, y) for y in found.tolist()]
            front += found.tolist()
    return out


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, component (the smallest node it is connected with) for the nodes of edges (a, b).

    Alternating stars: every node hands its larger neighbours, then its smaller ones, to the smallest neighbour, until all
    edges lead to the smallest node of their component. Each round is written to the shared folder.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    print_of = lambda e: e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    before = print_of(now)
    while before.n:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Smallest neighbours are summed up before the shuffle and written, so that the joins have a shuffle on either side
        # and adaptive execution can split a node with a large share of all edges.
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), name)
        large = stored(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), name)
        small = stored(large.groupBy("a").agg(F.min("b").alias("m")), name)
        joined = large.join(small, "a")
        now = stored(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), name)
        after = print_of(now)
        if after == before:
            break
        before = after
    nodes = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return nodes.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

"""Connected components of a link table, by randomised contraction.

In each round every id gets a priority, a 64-bit bijection of id and round, and is replaced by the id
of lowest priority among itself and its neighbours. Links become links between those ids. Whatever the shape and
the order of the ids, a node stays with a probability of at most 3/4 (a third on a chain), so the number of
rounds grows with the logarithm of the number of ids. Minima are aggregated on the map
side, so a hub with any number of links is one row for each task; the joins are plain equi-joins, whose
skew Spark splits. The links are cut by a checkpoint, and every round by a table that is written and read again, whose size Spark knows. When at most ``finish``
links are left, counted first, one task ends the work with a union-find; then ids are mapped
back round by round, and each component is named by its smallest id.

Cases: links with a null end and links of an id with itself say nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, written


class Union:
    """Union-find over any ids; the smallest id of a set is its root."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        up = self.up
        top = x
        while up.get(top, top) != top:
            top = up[top]
        while up.get(x, x) != top:
            up[x], x = top, up[x]
        return top

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.up.setdefault(min(a, b), min(a, b))
        return True


def _finish(batches):
    sets = Union()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sets.join(a, b)
    nodes = list(sets.up)
    for lo in range(0, len(nodes), 50_000):
        part = nodes[lo : lo + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([sets.root(x) for x in part], pa.int64())], names=["node", "component"])


def _links(rows: DataFrame, a: str, b: str) -> DataFrame:
    """The distinct links between different ids, the smaller one first."""
    return rows.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def components(links: DataFrame, *, finish: int = 1_000_000, max_rounds: int = 200) -> DataFrame:
    """(node, component) for each id in ``links`` (columns a, b: long); component is the smallest id reachable."""
    now = cut(_links(links, "a", "b"))
    rounds: list[DataFrame] = []
    while now.count() > finish:
        if len(rounds) == max_rounds:
            raise RuntimeError(f"components did not converge in {max_rounds} rounds")

        def priority(c: str, k: int = len(rounds)) -> Column:
            return F.xxhash64(F.col(c), F.lit(k))

        ends = now.select(F.col("a").alias("node"), F.col("b").alias("m")).union(now.select("b", "a"))
        best = ends.groupBy("node").agg(F.min_by("m", priority("m")).alias("m"))
        low = written(best.select("node", F.when(priority("m") < priority("node"), F.col("m")).otherwise(F.col("node")).alias("m")))
        rounds.append(low)
        moved = now.join(low.select(F.col("node").alias("a"), F.col("m").alias("x")), "a").join(low.select(F.col("node").alias("b"), F.col("m").alias("y")), "b")
        now = written(_links(moved, "x", "y"))
    out = now.repartition(1).mapInArrow(_finish, "node long, component long")
    if not rounds:
        return out
    for low in reversed(rounds):
        out = written(low.join(out.select(F.col("node").alias("m"), "component"), "m", "left").select("node", F.coalesce("component", "m").alias("component")))
    least = out.groupBy("component").agg(F.min("node").alias("least"))
    return out.join(least, "component").select("node", F.col("least").alias("component"))

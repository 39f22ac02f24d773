"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Level 1 and 2 read only the length and a hash of the first characters of every
text and aggregate them on the map side, so a cell of any size is one row for
each task. Cells with a single row are settled. Level 3 hashes the full text,
only for rows of the surviving cells, and joins the groups back on that hash.

The surviving cells are broadcast while there are at most ``broadcast_cells`` of
them, counted first. Beyond that the rows go through a shuffle join on narrow keys
whose skew Spark splits; the hash is then made before the shuffle, of every row, so that texts never move.

Cases: a null text counts as empty. Repeated rows (same id, same text) are
members like any other; where the largest id occurs several times in a group, ``exact_groups`` marks each of
those rows as kept, because nothing tells them apart, and ``drop_exact`` keeps one of them. A null id is never the largest;
a group of null ids only keeps none. An empty table gives an empty result. Other columns
are ignored unless named in ``carry``; results named like one of them replace it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut


def exact_groups(docs: DataFrame, *, id: str = "doc_id", text: str = "text", carry: dict[str, Column] | None = None, prefix: int = 64, broadcast_cells: int = 100_000) -> DataFrame:
    """One row for each input row: id, the columns of ``carry``, keep_id, group_size, kept."""
    body = F.coalesce(F.col(text), F.lit(""))
    bytes_, head = F.octet_length(body), F.xxhash64(F.substring(body, 1, prefix))
    cells = docs.select(bytes_.alias("n_bytes"), head.alias("head")).groupBy("n_bytes", "head").agg(F.count(F.lit(1)).alias("rows"))
    # a length with one row has one cell of one row, so the filter on cells settles level 1 and 2 together
    shared = cut(cells.where("rows > 1").select("n_bytes", "head"))
    few = shared.limit(broadcast_cells + 1).count() <= broadcast_cells
    rows = docs.select(F.col(id).alias("__id"), bytes_.alias("n_bytes"), head.alias("head"), (body if few else F.sha2(body, 256)).alias("__body"), *[c.alias(f"__c_{k}") for k, c in (carry or {}).items()])
    marked = shared.withColumn("__shared", F.lit(True))
    rows = rows.join(F.broadcast(marked) if few else marked, ["n_bytes", "head"], "left")
    # a settled row gets a key that no other row has, so that it needs no full hash and settled rows don't meet in one task
    full = F.sha2("__body", 256) if few else F.col("__body")
    rows = rows.withColumn("__full", F.when(F.col("__shared"), full).otherwise(F.concat(F.lit("settled "), F.coalesce(F.col("__id").cast("string"), F.uuid())))).drop("__body", "n_bytes", "head")
    # cut, so that the join has a shuffle of its own and Spark can split a key that many rows share
    groups = cut(rows.where("__shared").groupBy("__full").agg(F.max("__id").alias("__keep"), F.count(F.lit(1)).alias("__size")).where("__size > 1"))
    out = rows.join(groups, "__full", "left")
    keep, size = F.when(F.col("__size").isNull(), F.col("__id")).otherwise(F.col("__keep")), F.coalesce("__size", F.lit(1).cast("long"))
    named = {id: F.col("__id"), **{k: F.col(f"__c_{k}") for k in carry or {}}, "keep_id": keep, "group_size": size, "kept": F.coalesce(F.col("__id") == keep, F.lit(False))}
    return out.select(*[c.alias(k) for k, c in named.items()])


def drop_exact(docs: DataFrame, *, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose text another row with a larger id has; the columns stay as they are.

    What leaves is named by id and a hash of its text, so rows that share an id by mistake are told apart; of rows that share both, one stays. Rows without an id stay.
    """
    mark = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    members = exact_groups(docs, id=id, text=text, carry={"__mark": mark}, **options).where("group_size > 1")
    members = cut(members.select(F.col(id).alias("__own"), "__mark", "kept"))

    def named(rows: DataFrame) -> DataFrame:
        return broadcast_if_small(rows.select("__own", "__mark"))

    at = (F.col(f"`{id}`") == F.col("__own")) & (mark == F.col("__mark"))
    out = docs.join(named(members.where(~F.col("kept"))), at, "left_anti")
    twice = cut(members.where("kept").groupBy("__own", "__mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    if twice.isEmpty():
        return out
    one = out.join(named(twice), at, "left_semi").withColumn("__mark", mark).dropDuplicates([id, "__mark"]).drop("__mark")
    return out.join(named(twice), at, "left_anti").unionByName(one)

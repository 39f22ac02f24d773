"""Every stage of the pipeline over nulls, empty and very long texts, ties, repeated rows, clashing columns and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    """Own rows beside those of the smallest table, which give language models something to learn from."""
    rng = random.Random(2)
    words = [w for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").limit(20).collect() for w in (r.text or "").split()]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    same, near = some(60), some(200).split()
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    own = [
        (-1, None, "en", "s", None), (-2, "", "en", None, 0), (-3, "  \n ", None, "s", 3), (-4, some(60_000), "en", "s", None), (-5, same, None, "s", 1), (-6, same, "en", "t", 2),
        (-7, same, "en", "t", 2), (-7, same, "en", "t", 2), (None, some(50), "en", "s", 5), (None, None, None, None, None), (-8, " ".join(near), "en", "s", 1), (-9, " ".join([*near[:-1], "other"]), "en", "s", 1),
        (-10, f"{some(30)} {item} {some(30)}", "en", "s", 9), (-11, "12 34 --", "en", "s", 8),
    ]
    base = spark.read.parquet(f"{SF}/documents.parquet")
    made = spark.createDataFrame(own, base.schema)
    return base.unionByName(made)


def clashing(docs):
    names = ("kept", "keep_id", "group_size", "component_id", "lang_pred", "score", "rejected", "n_tokens", "ids", "decoded", "__text", "__own", "id", "part", "item_id")
    return docs.select("*", *[F.lit("own").alias(n) for n in names])


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stage(spark, table, k):
    name, stage = corpus_pipeline.STAGES[k]
    last = k == len(corpus_pipeline.STAGES) - 1
    got = stage(spark, table, SF)
    with_more = stage(spark, clashing(table), SF)
    assert got.columns == with_more.columns == (["doc_id", "n_tokens", "ids"] if last else table.columns)
    rows = sorted(map(repr, got.collect()))
    assert rows == sorted(map(repr, with_more.collect()))
    assert stage(spark, table.limit(0), SF).count() == 0
    ids = [r.doc_id for r in got.collect()]
    if last:
        assert len(ids) == table.count() and got.where("doc_id in (-1, -2) and (n_tokens <> 0 or size(ids) <> 0)").count() == 0
        assert got.where("size(ids) <> n_tokens").count() == 0 and got.where("doc_id = -4").first().n_tokens > 50_000
    elif name == "language ID":
        # without a letter there is no language
        assert not {-1, -2, -3, -11} & set(ids) and {-4, -5, -6, -7, -8, -9, -10} <= set(ids)
    elif name == "exact dedup":
        # null and empty are equal; the largest id stays, and one of rows that are equal in all
        assert ids.count(-7) + ids.count(-6) + ids.count(-5) == 1 and -5 in ids and -2 not in ids and -1 in ids
        assert ids.count(None) == 2 and {-3, -4, -8, -9} <= set(ids)
    elif name == "near dedup":
        assert {-1, -2, -3, -4, -9} <= set(ids) and -8 not in ids and ids.count(None) == 2 and ids.count(-7) == 2 and -5 not in ids
    else:
        assert -10 not in ids and {-1, -2, -3, -4} <= set(ids) and ids.count(None) == 2


def test_run_writes_each_stage(spark, tmp_path):
    """The whole pipeline over an own folder, with a table of nulls."""
    spark.read.parquet(f"{SF}/documents.parquet").withColumns({"source": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("long")}).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids(corpus_pipeline.run(spark, str(tmp_path))) == ids(corpus_pipeline.run(spark, SF))

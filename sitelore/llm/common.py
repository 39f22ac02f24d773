"""What the operators of this subpackage share: lineage cuts, streamed groups and batch helpers."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> None:
    """Names a folder for ``checkpoint()`` where the session has none.

    The cluster's ``spark.checkpoint.dir`` is used as it is. Only a session in
    one JVM, as in tests, gets a temporary folder of its own; on a cluster a
    machine-local folder would lose the data, so there it is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoint-")
    sc.setCheckpointDir(named)


#: Rows of whole texts that go to a Python worker at once. Spark's own 10,000 are meant for narrow rows.
TEXTS_AT_ONCE = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """Has Arrow batches hold few rows, unless the session already asks for fewer; a batch of texts then stays a few MB on either side."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(name, "10000")) <= TEXTS_AT_ONCE:
        conf.set(name, str(TEXTS_AT_ONCE))
    return df


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows of ``df`` to the shared checkpoint folder and goes on from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a table under the shared checkpoint folder and reads it again.

    The plan then has the table's real size. ``cut`` keeps the estimate of the plan before it, which multiplies with each join of a loop.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """Marks a table that was cut for broadcast if it has at most ``rows`` narrow rows, counted first; a larger one is joined by a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1_000_000):
    """(first, texts) runs of a batch of about ``max_bytes`` of text; null gives an empty text."""
    values = batch.column(column)
    start, size, texts = 0, 0, []
    for i, x in enumerate(values):
        text = x.as_py() or ""
        texts.append(text)
        size += len(text)
        if size >= max_bytes:
            yield start, texts
            start, size, texts = i + 1, 0, []
    if texts:
        yield start, texts


def runs(batches, key: str):
    """Streams (key value, table) of consecutive equal keys out of sorted Arrow batches."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        edges = [0, *((keys[1:] != keys[:-1]).nonzero()[0] + 1).tolist(), len(keys)]
        for lo, hi in zip(edges, edges[1:]):
            if held and keys[lo] != held_key:
                yield held_key, pa.Table.from_batches(held)
                held = []
            held_key = keys[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield held_key, pa.Table.from_batches(held)

"""Site tasks: import, dedupe by site, state from an append-only attempt log.

State is never updated in place. ``attempts`` rows (site_key, attempt_no, status, error) are appended, the state of a
task is its latest attempt in its epoch, and resets open a new epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls


def import_rows(rows: DataFrame, *, website: str = "website") -> DataFrame:
    """The rows with normalized_url, domain_key (the site key; empty for invalid values) and import_error."""
    done = rows.withColumn("__n", urls.normalized(F.coalesce(website, F.lit(""))))
    url = F.coalesce("__n.url", F.lit(""))
    return done.withColumns({"normalized_url": url, "import_error": F.col("__n.error")}).withColumn("domain_key", F.when(F.col("normalized_url") == "", "").otherwise(urls.site_key(F.col("normalized_url")))).drop("__n")


def invalid(error: Column) -> Column:
    return F.coalesce(error, F.lit("")) != ""


def unique_tasks(imported: DataFrame, *, row_number: str = "row_number") -> DataFrame:
    """One task per site key: the first input row's values."""
    good = imported.where("domain_key <> ''")
    return good.groupBy("domain_key").agg(F.min(F.struct(F.col(row_number).alias("r"), F.col("website").alias("w"), F.col("normalized_url").alias("u"))).alias("f"), F.count(F.lit(1)).alias("input_rows")).select("domain_key", F.col("f.r").alias("first_row"), F.col("f.w").alias("input_url"), F.col("f.u").alias("normalized_url"), "input_rows")


def new_tasks(tasks: DataFrame, known: DataFrame) -> DataFrame:
    """Tasks whose site isn't known yet."""
    return tasks.join(known.select("domain_key"), "domain_key", "left_anti")


def import_stats(imported: DataFrame) -> DataFrame:
    return imported.agg(F.count(F.lit(1)).alias("rows"), F.count_if(invalid(F.col("import_error"))).alias("invalid"), F.count_if(~invalid(F.col("import_error"))).alias("valid"), F.countDistinct(F.when(F.col("domain_key") != "", F.col("domain_key"))).alias("unique"))


def company_stats(rows: DataFrame, company: str, location: str) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(F.concat_ws("|", F.lower(company), F.lower(F.coalesce(location, F.lit(""))))).alias("unique"))


def counts(tasks: DataFrame) -> DataFrame:
    """Rows (status, n) with a row ``total``, in one pass."""
    return tasks.rollup("status").agg(F.count(F.lit(1)).alias("n"), F.grouping("status").alias("g")).select(F.when(F.col("g") == 1, F.lit("total")).otherwise(F.col("status")).alias("status"), "n")


def state(tasks: DataFrame, attempts: DataFrame, *, max_attempts: int = 3) -> DataFrame:
    """Tasks with status, attempts, last_error.

    ``attempts`` has domain_key, epoch, attempt_no, outcome (ok, partial, failed, error, running). A returned failure ends a
    task; an error is tried again while fewer than ``max_attempts`` were made; an attempt still running counts as pending after a restart.
    """
    newest = attempts.groupBy("domain_key").agg(F.max("epoch").alias("epoch"))
    own = attempts.join(newest, ["domain_key", "epoch"], "left_semi") if attempts.columns else attempts
    last = own.groupBy("domain_key").agg(F.max_by(F.struct("outcome", "error"), F.col("attempt_no")).alias("l"), F.max("attempt_no").alias("attempts"))
    outcome = F.col("l.outcome")
    status = F.when(outcome.isin("ok", "partial"), "completed").when(outcome == "failed", "failed").when((outcome == "error") & (F.col("attempts") >= max_attempts), "failed").otherwise("pending")
    return tasks.join(last, "domain_key", "left").withColumns({"status": status, "last_error": F.coalesce("l.error", F.lit("")), "attempts": F.coalesce("attempts", F.lit(0))}).drop("l")


def claimable(tasks: DataFrame, *, max_attempts: int = 3, limit: int | None = None) -> DataFrame:
    """Pending tasks in claim order, the first ``limit``."""
    out = tasks.where((F.col("status") == "pending") & (F.col("attempts") < max_attempts)).orderBy("updated_at", "domain_key")
    return out if limit is None else out.limit(limit)


def reset(attempts: DataFrame, which: DataFrame) -> DataFrame:
    """The attempt log with a new, empty epoch for the given site keys: they are pending again."""
    top = attempts.groupBy("domain_key").agg(F.max("epoch").alias("epoch")).join(which.select("domain_key"), "domain_key", "left_semi")
    fresh = top.select("domain_key", (F.col("epoch") + 1).alias("epoch"), F.lit(0).alias("attempt_no"), F.lit("reset").alias("outcome"), F.lit("").alias("error"))
    return attempts.unionByName(fresh.select(*[F.col(c).cast(attempts.schema[c].dataType) for c in attempts.columns]))


def error_text(errors: Column) -> Column:
    return F.substring(F.array_join(errors, " | "), 1, 2000)


def join_results(inputs: DataFrame, results: DataFrame) -> DataFrame:
    """Every input row with the result of its site; invalid rows and sites without a result keep nulls."""
    return inputs.join(results, "domain_key", "left")

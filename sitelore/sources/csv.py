"""CSV sources and sinks: lists of websites or companies with any header, pasted lists, exports."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tables as K

ENCODINGS = ("utf-8-sig", "utf-8", "cp1252")
#: Spark's reader has no cp1252. It differs from latin-1, which it has, in these characters.
_LATIN, _CP1252 = zip(*((bytes([b]).decode("latin-1"), x) for b in range(0x80, 0xA0) if (x := bytes([b]).decode("cp1252", "ignore"))))


def pick_column(header: Sequence[str], wanted: Sequence[str], requested: str | None = None, label: str = "website") -> str | None:
    """The requested column in any case, else the first usual name that the header has."""
    by_name = {h.casefold().strip(): h for h in header}
    if requested:
        if requested.casefold().strip() not in by_name:
            raise ValueError(f"{label} column not found: {requested}")
        return by_name[requested.casefold().strip()]
    return next((by_name[w] for w in wanted if w in by_name), None)


def website_column(header: Sequence[str], requested: str | None = None) -> str:
    found = pick_column(header, K.WEBSITE_HEADERS, requested)
    if found is None:
        raise ValueError("no website column in the header; name one")
    return found


def company_columns(header: Sequence[str], company: str | None = None, location: str | None = None) -> tuple[str, str | None]:
    found = pick_column(header, K.COMPANY_HEADERS, company, "company")
    if found is None:
        raise ValueError("no company column in the header; name one")
    return found, pick_column(header, K.LOCATION_HEADERS, location, "location")


def input_kind(header: Sequence[str]) -> str:
    """``website`` if the header has a website column, else ``company``."""
    if pick_column(header, K.WEBSITE_HEADERS):
        return "website"
    if pick_column(header, K.COMPANY_HEADERS):
        return "company"
    raise ValueError("neither a website nor a company column in the header")


def encoding_of(spark: SparkSession, path: str) -> str:
    """The first encoding that fits all files of a list; read as binary, so any store that Spark reads will do.

    A list is small; one file is read in one task.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    @F.udf("string")
    def fits(content):
        return decode(bytes(content))[1]

    found = {r[0] for r in files.select(fits("content")).distinct().collect()}
    return max(found, key=ENCODINGS.index, default="utf-8")


def read_list(spark: SparkSession, path: str, *, encoding: str | None = None) -> DataFrame:
    """source_file, row_number (from 2), header, original, of a CSV list. Without an encoding the first of ``ENCODINGS`` that fits is taken.

    Cells are text and may hold line breaks, so a file is read in one task, and the window over
    one file's numbers is the only sort. Lists are small; files are numbered independently of each other.
    """
    encoding = encoding or encoding_of(spark, path)
    raw = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", {"utf-8-sig": "utf-8", "cp1252": "iso-8859-1"}.get(encoding, encoding)).csv(path)
    header = [c.removeprefix("\ufeff") for c in raw.columns]
    cell = lambda h: F.coalesce(f"`{h}`", F.lit(""))
    if encoding == "cp1252":
        header = [c.translate(dict(zip(map(ord, _LATIN), _CP1252))) for c in header]
        cell = lambda h: F.translate(F.coalesce(f"`{h}`", F.lit("")), "".join(_LATIN), "".join(_CP1252))
    rows = raw.toDF(*header).select("*", F.col("_metadata.file_name").alias("__file"), F.monotonically_increasing_id().alias("__at"))
    original = F.map_from_arrays(F.array(*[F.lit(h) for h in header]), F.array(*[cell(h) for h in header]))
    number = F.row_number().over(Window.partitionBy("__file").orderBy("__at")) + 1
    return rows.select(F.col("__file").alias("source_file"), number.alias("row_number"), F.array(*[F.lit(h) for h in header]).alias("header"), original.alias("original"))


def files_of(spark: SparkSession, path: str, column: str = "") -> DataFrame:
    """(source_file, size, modified, column) of the files of a list, for the manifest."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("source_file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.lit(column).alias("column"))


def import_changed(spark: SparkSession, path: str, store: str, *, column: str | None = None) -> list[str]:
    """Reads the files of a list that the store's manifest doesn't have in their present state, and replaces their rows in the store; gives their names.

    ``store`` has ``rows``, by source file, and ``manifest``, to which every import is appended.
    """
    now = files_of(spark, path, column or "")
    known = _table(spark, f"{store}/manifest")
    # names of files, of which a list has few
    names = sorted(r.source_file for r in (now if known is None else changed(now, known)).collect())
    if names:
        rows = read_list(spark, path).where(F.col("source_file").isin(names))
        replace_source(rows, f"{store}/rows")
        now.where(F.col("source_file").isin(names)).write.mode("append").parquet(f"{store}/manifest")
    return names


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as e:  # it appears with the first import
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def with_website(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn("website", F.trim(F.coalesce(F.col("original")[column], F.lit(""))))


def decode(data: bytes) -> tuple[str, str]:
    """(text, encoding) by the first encoding that fits."""
    for name in ENCODINGS:
        try:
            return data.decode(name), name
        except UnicodeDecodeError:
            pass
    raise ValueError("the file's encoding isn't supported")


def changed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (source_file, size, modified, column) that the manifest doesn't have in just this state."""
    keys = ["source_file", "size", "modified", "column"]
    return files.join(manifest.select(*keys), keys, "left_anti")


def _limited(values: list, what: str) -> list:
    if not values:
        raise ValueError(f"no {what} in the pasted text")
    if len(values) > K.PASTE_LIMIT:
        raise ValueError(f"a pasted list has {K.PASTE_LIMIT:,} entries at most")
    return values


def _pasted(text: str) -> str:
    if len(text) > K.PASTE_CHARS:
        raise ValueError("the pasted text is too large")
    return text.strip()


def paste_websites(text: str) -> list[str]:
    """Website values of a pasted list: lines, cells and tabs; quotes, blanks and header words dropped."""
    cells = (c for line in _pasted(text).splitlines() if line.strip() for cell in next(csv.reader([line.strip()], skipinitialspace=True)) for c in cell.split("\t"))
    values = [c.strip().strip("\"'") for c in cells]
    return _limited([v for v in values if v and v.casefold() not in K.WEBSITE_HEADERS], "website")


def paste_companies(text: str) -> list[tuple[str, str]]:
    """(company, location) of a pasted list, with a header that names them or one company a line, a tab before the location."""
    text = _pasted(text)
    table = [row[0].split("\t") if len(row) == 1 else row for row in csv.reader(io.StringIO(text), skipinitialspace=True) if row]
    names = [c.strip().casefold() for c in table[0]] if table else []
    at = next((i for i, n in enumerate(names) if n in K.COMPANY_HEADERS), None)
    if at is not None and len(table) > 1:
        place = next((i for i, n in enumerate(names) if n in K.LOCATION_HEADERS), None)
        cell = lambda row, i: row[i].strip() if i is not None and i < len(row) else ""
        found = [(cell(r, at), cell(r, place)) for r in table[1:]]
    else:
        lines = [line.strip().strip("\"'").split("\t") for line in text.splitlines()]
        found = [(p[0].strip(), p[1].strip() if len(p) > 1 else "") for p in lines]
    return _limited([f for f in found if f[0]], "company")


def pasted_rows(spark: SparkSession, text: str, kind: str) -> DataFrame:
    """A pasted list as input rows, as if it were a file with the header Website, or Company and Location."""
    if kind == "website":
        header, data = ["Website"], [(v,) for v in paste_websites(text)]
    else:
        header, data = ["Company", "Location"], paste_companies(text)
    rows = [("pasted", i + 2, header, dict(zip(header, d))) for i, d in enumerate(data)]
    return spark.createDataFrame(rows, "source_file string, row_number int, header array<string>, original map<string,string>")


def write_export(df: DataFrame, path: str, *, single: bool = False, order: str = "row_number") -> None:
    """A CSV export. ``single`` gives one file in order, without the order column, for which one task sorts and writes all; otherwise every task writes its part and the order column stays."""
    out = df.orderBy(order, *(["pos"] if "pos" in df.columns else [])) if single else df
    out = out.drop(*([order] if single and order == "row_number" else []), "pos")
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').csv(path)


def replace_source(df: DataFrame, path: str) -> None:
    """Writes imported rows by source file; only the files in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_file").parquet(path)

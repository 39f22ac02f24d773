"""python -m sitelore LIST.csv --pages PAGES.parquet --out FOLDER: a list of websites or companies and a page store to the four exports.

A list without a website column is a company list. Run again with the same folder, only new sites and failed ones that have attempts left are read.
Exit code 0, or 2 if some site failed.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from . import logs
from .operators import resolve
from .plans import job as jobs
from .plans.options import SETTINGS, clean_options, plan_job


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sitelore", description="Website or company list and page store to contact tables")
    p.add_argument("list")
    p.add_argument("--pages", required=True, help="Parquet table with url and html, and may have status, content_type, final_url, tier_order")
    p.add_argument("--fallback-pages", help="Parquet table that is read for sites that fail over the first")
    p.add_argument("--out", required=True)
    p.add_argument("--website-column")
    p.add_argument("--encoding", help="of the list; found out if not given")
    p.add_argument("--kinds", nargs="*", default=[])
    p.add_argument("--fields", nargs="*", help="of the clean export; a fast crawl ends when they are found")
    for name, setting in SETTINGS.items():
        p.add_argument("--" + name.replace("_", "-"), help=f"{setting.label}: {', '.join(setting.values)}")
    p.add_argument("--include-evidence", action="store_true")
    p.add_argument("--max-pages", type=int, default=6)
    p.add_argument("--workers", type=int, default=40)
    p.add_argument("--full", action="store_true", help="use the whole page budget")
    p.add_argument("--ignore-robots", action="store_true")
    p.add_argument("--find-websites", action="store_true", help="resolve companies even if there is a website column")
    p.add_argument("--candidates", help="Parquet table of provider candidates: company, location, url, source, source_order, title, snippet, source_score")
    p.add_argument("--mail-hosts", help="Parquet table of mail lookups: host, has_mail")
    p.add_argument("--company-column")
    p.add_argument("--location-column")
    p.add_argument("--website-min-confidence", type=float, default=resolve.FOUND)
    p.add_argument("--anew", action="store_true", help="forget earlier runs")
    p.add_argument("--single", action="store_true", help="one ordered file for each export")
    p.add_argument("--log", help="file of log lines in JSON")
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    settings = {name: value for name in SETTINGS if (value := getattr(a, name))}
    asked = a.fields or settings or a.include_evidence
    options = clean_options(a.fields or ("website", "email", "phone", "facebook"), include_evidence=a.include_evidence, **settings) if asked else None
    log = logs.to_file(a.log) if a.log else logs.LOG
    spark = SparkSession.builder.getOrCreate()
    table = lambda path: spark.read.parquet(path) if path else None
    plan = plan_job(a.kinds, options, workers=a.workers, max_pages=a.max_pages, fast=not a.full, respect_robots=not a.ignore_robots)
    done = jobs.run(
        spark, a.list, table(a.pages), a.out, plan,
        column=a.website_column, find=a.find_websites, candidates=table(a.candidates), company=a.company_column, location=a.location_column,
        threshold=min(0.99, max(0.0, a.website_min_confidence)), fallback=table(a.fallback_pages), mail_hosts=table(a.mail_hosts), resume=not a.anew, single=a.single, encoding=a.encoding,
    )
    log.info("job done", extra={"fields": done})
    print(done)
    return 2 if done["failed"] else 0


if __name__ == "__main__":
    sys.exit(main())

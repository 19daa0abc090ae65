"""Command line of the batch run: ``spark-submit`` or ``python -m tallyflow``."""

from __future__ import annotations

import argparse

from tallyflow.operators.deltas import GAPS, RESETS
from tallyflow.operators.rollups import REVISIONS
from tallyflow.plans.batch_job import LAYOUTS, BatchInputs, run_batch
from tallyflow.schemas import AREA_ALIASES
from tallyflow.session import build_session
from tallyflow.sources.readers import read_aliases


def main() -> None:
    cli = argparse.ArgumentParser(prog="tallyflow")
    for folder in ("reports", "flows", "facilities", "codes", "out"):
        cli.add_argument(f"--{folder}", required=True, help="path or URI")
    cli.add_argument("--period", default="*", help="YYYYMM, YYYY or *")
    cli.add_argument("--area", action="append", default=[], help="may be given again")
    cli.add_argument("--aliases", help="CSV with a header: name in the reports, name in the codes")
    cli.add_argument("--csv", help="folder for the results as CSV too")
    cli.add_argument("--layouts", choices=LAYOUTS, default="declared", help="header: read each file by its header")
    cli.add_argument("--revisions", choices=REVISIONS, default="all", help="latest: one report of a place and day counts")
    cli.add_argument("--store", help="folder that keeps day totals, so that the next run reads changed files only")
    cli.add_argument("--gaps", choices=GAPS, default="keep", help="totals of days without a report")
    cli.add_argument("--resets", choices=RESETS, default="keep", help="carry: totals never fall")
    given = cli.parse_args()
    spark = build_session()
    inputs = BatchInputs(given.reports, given.flows, given.facilities, given.codes)
    aliases = read_aliases(spark, given.aliases) if given.aliases else AREA_ALIASES
    run_batch(
        spark,
        inputs,
        given.out,
        given.period,
        given.area,
        aliases=aliases,
        csv=given.csv,
        layouts=given.layouts,
        revisions=given.revisions,
        store=given.store,
        gaps=given.gaps,
        resets=given.resets,
    )
    spark.stop()


if __name__ == "__main__":
    main()

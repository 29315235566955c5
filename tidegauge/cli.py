"""Command line: prepare, analyze, sweep."""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from tidegauge.config import load_config, load_grid
from tidegauge.plans import engine
from tidegauge.session import session
from tidegauge.sources import sinks
from tidegauge.sources.bars import read_files

LOG = logging.getLogger("tidegauge")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidegauge")
    commands = top.add_subparsers(dest="command")
    prepare = commands.add_parser("prepare", help="clean and annotate raw bars")
    prepare.add_argument("--files", nargs="+", required=True)
    prepare.add_argument("--out", default="cache/prepared.parquet")
    prepare.add_argument("--config")
    analyze = commands.add_parser("analyze", help="zones, episodes and statistics of prepared bars")
    analyze.add_argument("--data", required=True)
    analyze.add_argument("--config")
    analyze.add_argument("--out", default="results")
    sweep = commands.add_parser("sweep", help="outcome rates over a grid of settings")
    sweep.add_argument("--data", required=True)
    sweep.add_argument("--grid", required=True)
    sweep.add_argument("--out", default="sweep_results")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if not args.command:
        parser().print_help()
        return 0
    logging.basicConfig(level=logging.INFO, format="%(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = session()
    config = load_config(getattr(args, "config", None))
    if args.command == "prepare":
        sinks.write_metadata(spark, str(Path(args.out).parent), "prepare", vars(args), args.files, config)
        prepared, report = engine.prepare_and_report(spark, args.files, config)
        sinks.write_table(prepared, args.out)
        LOG.info("quality report: %s", report.first().asDict())
        LOG.info("prepared: %s", engine.data_span(read_files(spark, [args.out])).first().asDict())
        return 0
    bars = read_files(spark, [args.data])
    if args.command == "sweep":
        sinks.write_table(engine.sweep(bars, load_grid(args.grid)).orderBy("place").drop("place"), f"{args.out}/sweep_summary.csv")
        return 0
    sinks.write_metadata(spark, args.out, "analyze", vars(args), [args.data], config)
    found = engine.analyze(bars, config)
    sinks.write_table(sinks.zone_rows(found.zones), f"{args.out}/zones.csv")
    sinks.write_table(found.episodes, f"{args.out}/episodes.csv")
    plots = {"daily_map": found.daily_map, "outcome_counts": found.outcome_counts, "histograms": engine.histograms(found.episodes)}
    for name, rows in plots.items():
        sinks.write_table(rows, f"{args.out}/{name}.csv")
    sinks.write_text(spark, f"{args.out}/statistics.json", json.dumps(sinks.statistics_tree(found.rates, found.metrics, found.intervals), indent=2, default=str))
    for r in found.rates.filter("stratum = 'all' and outcome = 'RESPECT' and n_episodes > 0").collect():  # a row a symbol
        LOG.info("RESPECT rate %s: %.4f (%.4f to %.4f) of %d", r["symbol"], r["rate"], r["ci_low"], r["ci_high"], r["n_episodes"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

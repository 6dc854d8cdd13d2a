"""Command line: ``python -m strandline.cli validate|audit|ingest|features|protocol ...``; give it to spark-submit for a cluster."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession


def _session() -> SparkSession:
    return SparkSession.builder.appName("strandline").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandline")
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in (("validate", "check a CSV panel"), ("audit", "summarise CSV panels by ticker")):
        sub.add_parser(name, help=text).add_argument("path")
    ingest = sub.add_parser("ingest", help="read TICKER.csv files of a folder into one panel")
    ingest.add_argument("folder")
    ingest.add_argument("output")
    ingest.add_argument("--tickers", nargs="*")
    ingest.add_argument("--limit", type=int)
    features = sub.add_parser("features", help="write all features of a Parquet panel")
    features.add_argument("path")
    features.add_argument("output")
    protocol = sub.add_parser("protocol", help="run the search protocol on a synthetic panel")
    protocol.add_argument("--target", default="target_return_1d")
    protocol.add_argument("--manifest")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = _session()
    from strandline.operators import quality
    from strandline.sources import panel, universe

    if args.command == "validate":
        try:
            quality.validate(panel.read_csv(spark, args.path))
        except ValueError as error:
            print(error, file=sys.stderr)
            return 1
        print("valid")
    elif args.command == "audit":
        rows = panel.read_csv(spark, args.path, ticker_from_file=True)
        audited = quality.audit(panel.normalise(rows.select(*panel.COLUMNS)))
        print("\t".join(audited.columns))
        for row in audited.orderBy("ticker").toLocalIterator():  # all tickers, a partition at a time
            print("\t".join(map(str, row)))
        quality.audit_totals(audited).show(truncate=False)
        quality.row_histogram(audited).orderBy("n_rows").show(truncate=False)
    elif args.command == "ingest":
        names = (args.tickers or universe.DEV_UNIVERSE)[: args.limit]
        frame, failed = universe.ingest(universe.ingest_csv(spark, args.folder), names)
        if frame is not None:
            panel.save_parquet(frame, args.output)
        print(json.dumps({"failed": failed}))
        return 1 if failed else 0
    elif args.command == "features":
        from strandline.plans.pipeline import feature_frame

        feature_frame(spark.read.parquet(args.path)).write.parquet(args.output)
    else:
        from strandline.plans.protocol import run_protocol
        from strandline.sources import synthetic

        result = run_protocol(synthetic.pipeline_panel(spark), args.target, features=synthetic.FEATURES, targets=synthetic.TARGETS, manifest_path=args.manifest)
        print(json.dumps(result, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""Command line: build a feature dataset from bars, update one, or show one.

    python -m tidemark.cli features BARS OUT [--stocks N] [--min-rows 252]
    python -m tidemark.cli update OLD BARS OUT [--days 365]
    python -m tidemark.cli show DATASET
"""

from __future__ import annotations

import argparse

from tidemark.operators import dataset as ds
from tidemark.operators import features as feat
from tidemark.session import local_session
from tidemark.sources.bars import read_ohlcv


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark")
    sub = parser.add_subparsers(dest="command", required=True)
    build = sub.add_parser("features")
    build.add_argument("bars")
    build.add_argument("out")
    build.add_argument("--stocks", type=int)
    build.add_argument("--min-rows", type=int, default=252)
    update = sub.add_parser("update")
    update.add_argument("old")
    update.add_argument("bars")
    update.add_argument("out")
    update.add_argument("--days", type=int, default=365)
    show = sub.add_parser("show")
    show.add_argument("dataset")
    args = parser.parse_args(argv)
    spark = local_session()
    names = feat.list_features()
    if args.command == "show":
        head, summary = ds.preview(spark.read.parquet(args.dataset))
        head.show()
        summary.show(truncate=False)
        return 0
    bars = ds.clean_ohlcv(read_ohlcv(spark, args.bars, getattr(args, "stocks", None)))
    if args.command == "features":
        out = ds.clean_dataset(feat.build_features(bars, args.min_rows), names)
    else:
        out = ds.incremental(bars, spark.read.parquet(args.old), lambda b: ds.clean_dataset(feat.build_features(b, 1), names), args.days)
    wrong = ds.validate_final(out, names)
    if wrong:
        print("\n".join(wrong))
        return 1
    print(ds.save_dataset(ds.optimize_types(out, feat.META), args.out, names))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

"""Command line: ``python -m docsearch ingest FOLDER`` and ``python -m docsearch query QUESTION``."""

from __future__ import annotations

import argparse
import logging
import sys
from dataclasses import replace

from pyspark.sql import SparkSession

from docsearch.config import load
from docsearch.errors import DocsearchError
from docsearch.pipeline import Pipeline


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    top = argparse.ArgumentParser(prog="python -m docsearch")
    top.add_argument("--config", help="settings file")
    top.add_argument("--store", help="index folder, before the one in the settings")
    top.add_argument("-v", "--verbose", action="store_true")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("ingest", help="bring the index in line with a folder").add_argument("folder")
    ask = sub.add_parser("query", help="ask a question")
    ask.add_argument("question")
    ask.add_argument("--source", help="only files of this name")
    args = top.parse_args(argv)
    logging.basicConfig(level=logging.INFO if args.verbose else logging.WARNING)
    try:
        config = load(args.config)
        if args.store:
            config = replace(config, store=replace(config.store, persist_dir=args.store))
        pipeline = Pipeline(spark or SparkSession.builder.appName("docsearch").getOrCreate(), config)
        if args.command == "query":
            print(pipeline.query(args.question, {"source": args.source} if args.source else None).format())
            return 0
        report = pipeline.ingest(args.folder)
    except DocsearchError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    print(report.summary())
    for path, kind, reason in report.failures:
        print(f"  failed: {path}: {kind}: {reason}")
    return 1 if report.failures and not report.indexed and not report.unchanged else 0


if __name__ == "__main__":
    sys.exit(main())

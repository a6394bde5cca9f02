"""``python -m lathe.cli``: compile-data, write-blocks, stats, run, explain, make-cases and check."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from lathe.harness import load_cases, run_cases, save_cases, scan_cases
from lathe.operators.relational import JOIN_HINTS, named
from lathe.operators.statistics import analyze
from lathe.plans.catalog import Catalog
from lathe.plans.compiler import compile_query, with_runtime_filters
from lathe.plans.ir import from_json
from lathe.sources.blocks import BLOCK_SIZE, write_blocks
from lathe.sources.pipe import discover
from lathe.streaming.rows import framed, lines


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lathe")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("compile-data", help="pipe-delimited files to Parquet")
    p.add_argument("dataset"), p.add_argument("out")
    p.add_argument("--sort", action="append", default=[], metavar="TABLE.COLUMN", help="keep a table in this column's order")
    p.add_argument("--catalog", help="also write a catalog file with statistics")
    p = sub.add_parser("write-blocks", help="a Parquet table to files of fixed-size blocks")
    p.add_argument("folder"), p.add_argument("table"), p.add_argument("out"), p.add_argument("--block-size", type=int, default=BLOCK_SIZE)
    p = sub.add_parser("make-cases", help="a query case for each table, with its rows as the expected result")
    p.add_argument("folder"), p.add_argument("out"), p.add_argument("cases")
    p = sub.add_parser("stats", help="a catalog file with statistics of Parquet tables")
    p.add_argument("folder"), p.add_argument("out")
    for name in ("run", "explain"):
        p = sub.add_parser(name, help="a JSON query over Parquet tables")
        p.add_argument("folder"), p.add_argument("query", help="a file, or - for standard input")
        p.add_argument("--semantics", choices=["spark", "reference"], default="spark")
        p.add_argument("--framed", action="store_true")
        p.add_argument("--catalog", help="a catalog file with statistics, for auto and for scans that a range excludes")
        p.add_argument("--join-hint", choices=["auto", *JOIN_HINTS])
        p.add_argument("--runtime-filters", action="store_true", help="test join keys at scans by Bloom filters")
    p = sub.add_parser("check", help="query cases with expected files")
    p.add_argument("folder"), p.add_argument("cases")
    return top


def _tables(spark: SparkSession, folder: str) -> Catalog:
    return Catalog.of_parquet(spark, folder, sorted(p.stem for p in Path(folder).glob("*.parquet")))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lathe").getOrCreate()
    if args.command == "compile-data":
        found = discover(spark, args.dataset)
        keys = dict(x.split(".", 1) for x in args.sort)
        for name in found.tables:
            rows = found.table(name)
            rows = rows.orderBy(named(rows, keys[name])) if name in keys else rows
            rows.write.mode("overwrite").parquet(f"{args.out}/{name}.parquet")
        if args.catalog:
            main(["stats", args.out, args.catalog], spark)
    elif args.command == "write-blocks":
        write_blocks(_tables(spark, args.folder).table(args.table), args.out, args.block_size)
    elif args.command == "make-cases":
        Path(args.out).mkdir(parents=True, exist_ok=True)
        save_cases(scan_cases(_tables(spark, args.folder), args.out), args.cases)
    elif args.command == "stats":
        tables = _tables(spark, args.folder)
        Catalog(specs=[analyze(tables.table(n), n) for n in tables.tables]).save(args.out)
    elif args.command in ("run", "explain"):
        text = sys.stdin.readline() if args.query == "-" else Path(args.query).read_text()
        tables = _tables(spark, args.folder)
        tables.specs = {s.name: s for s in Catalog.load_specs(args.catalog)} if args.catalog else {}
        df = compile_query(from_json(text), tables, args.semantics, args.join_hint)
        df = with_runtime_filters(df) if args.runtime_filters else df
        if args.command == "explain":
            df.explain("formatted")
        else:
            for line in framed(df) if args.framed else lines(df):
                print(line)
    else:
        outcomes = run_cases(load_cases(args.cases), _tables(spark, args.folder))
        for o in outcomes:
            print("ok" if o.passed else "FAILED", o.name, o.detail)
        return int(not all(o.passed for o in outcomes))
    return 0


if __name__ == "__main__":
    sys.exit(main())

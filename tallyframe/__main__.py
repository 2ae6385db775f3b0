"""Command line: list or run registered queries.

    python -m tallyframe list
    python -m tallyframe run NAME [NAME ...] --tables DIR --out DIR [--format parquet|json|csv]
        [--master local[8]]

Each query's result is written to ``OUT/NAME`` with Spark's writer (no
collection on the driver).
"""

from __future__ import annotations

import argparse
import os
import sys


def _registry():
    from tallyframe.plans import registry
    return registry()


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="tallyframe")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="list registered queries")
    run = sub.add_parser("run", help="run queries and write their results")
    run.add_argument("names", nargs="+", help="query names (or prefixes ending in '*')")
    run.add_argument("--tables", required=True, help="folder with the input parquet tables")
    run.add_argument("--out", required=True, help="output folder")
    run.add_argument("--format", default="parquet", choices=["parquet", "json", "csv"])
    run.add_argument("--master", default=None, help="Spark master (default: from spark-submit)")
    args = ap.parse_args(argv)

    reg = _registry()
    if args.cmd == "list":
        for name, (fn, sql) in reg.items():
            doc = (fn.__doc__ or "").strip().splitlines()
            print(f"{name}\t{'oracle' if sql else 'rows-only'}\t{doc[0] if doc else ''}")
        return 0

    chosen = []
    for n in args.names:
        hits = [k for k in reg if (k.startswith(n[:-1]) if n.endswith("*") else k == n)]
        if not hits:
            print(f"unknown query: {n}", file=sys.stderr)
            return 2
        chosen += [h for h in hits if h not in chosen]
    from tallyframe.session import build_session, checkpoint_dir
    spark = build_session(args.master)
    checkpoint_dir(spark)
    for name in chosen:
        df = reg[name][0](spark, args.tables)
        w = df.write.mode("overwrite")
        target = os.path.join(args.out, name)
        if args.format == "csv":
            w.option("header", "true").csv(target)
        else:
            getattr(w, args.format)(target)
        print(f"wrote {target}")
    return 0


if __name__ == "__main__":
    sys.exit(main())

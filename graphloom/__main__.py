"""Command line: scan, export, summary and query on graphs in JSON files or fact tables in Parquet.

    python -m graphloom scan ROOT -o graph.json [--exclude P]... [--exclude-file F]...
    python -m graphloom build FACTS_DIR -o graph.json
    python -m graphloom export csv GRAPH.json -o FOLDER
    python -m graphloom query impact GRAPH.json --node TEXT [--direction upstream] [--depth N] [--exact-only] [--no-ambiguous]
    python -m graphloom query paths GRAPH.json --from TEXT --to TEXT [--depth N] [--exact-only] [--with-ambiguous]
    python -m graphloom query ambiguous GRAPH.json [--limit N]
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from . import api
from .sources import discovery, exchange


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("scan", "build"):
        s = sub.add_parser(name)
        s.add_argument("root")
        s.add_argument("-o", "--out", default="graph.json")
        s.add_argument("--exclude", action="append", default=[])
        s.add_argument("--exclude-file", action="append", default=[])
    e = sub.add_parser("export")
    e.add_argument("kind", choices=["json", "csv"])
    e.add_argument("graph")
    e.add_argument("-o", "--out", required=True)
    q = sub.add_parser("query")
    q.add_argument("kind", choices=["impact", "paths", "ambiguous"])
    q.add_argument("graph")
    q.add_argument("--node")
    q.add_argument("--direction", default="downstream", choices=["downstream", "upstream"])
    q.add_argument("--from", dest="source")
    q.add_argument("--to", dest="target")
    q.add_argument("--depth", type=int)
    q.add_argument("--exact-only", action="store_true")
    q.add_argument("--no-ambiguous", action="store_true")
    q.add_argument("--with-ambiguous", action="store_true")
    q.add_argument("--limit", type=int, default=api.SHOWN_REVIEW)
    return p


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    try:
        if a.command in ("scan", "build"):
            if a.command == "scan":
                state = api.scan_folder(spark, a.root, discovery.excluded_paths(spark, a.root, a.exclude_file, a.exclude))
            else:
                state = api.scan(spark, {f.name.removesuffix(".parquet"): spark.read.parquet(str(f)) for f in Path(a.root).glob("*.parquet")})
            exchange.write_document(state.need(), a.out, state.metadata)
            print("\n".join(api.summary_text(state)))
            return 0
        state = api.load(spark, a.graph)
        if a.command == "export":
            exchange.write_csv_pair(state.need(), a.out) if a.kind == "csv" else exchange.write_json(state.need(), a.out)
        elif a.kind == "impact":
            print("\n".join(api.impact_text(state, a.node or "", a.direction, a.depth or 6, a.exact_only, not a.no_ambiguous)))
        elif a.kind == "paths":
            print("\n".join(api.paths_text(state, a.source or "", a.target or "", a.depth or 8, a.exact_only, a.with_ambiguous)))
        else:
            print("\n".join(api.review_text(state, a.limit)))
        return 0
    except (LookupError, FileNotFoundError, ValueError) as x:
        print(x, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())

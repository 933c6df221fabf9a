"""Command line: init, status, and the tools."""

from __future__ import annotations

import argparse
import sys

from codeloom import config
from codeloom.plans import render


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="codeloom")
    p.add_argument("--source")
    p.add_argument("--format", default="compact", choices=sorted(render.MODES))
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("init").add_argument("path")
    sub.add_parser("status")
    for name, modes in (("trace", ("full", "yaml", "dispatch")), ("search", ("bindings", "kernels")), ("graph", ("callers", "calls", "impact")), ("modules", ("trace", "list")), ("tests", ("find", "utils", "file_info"))):
        s = sub.add_parser(name)
        s.add_argument("name")
        s.add_argument("--mode", default=modes[0], choices=modes)
        if name in ("search", "tests"):
            s.add_argument("--limit", type=int, default=10)
        if name == "search":
            s.add_argument("--backend", default="")
        if name == "graph":
            s.add_argument("--depth", type=int, default=2)
    a = p.parse_args(argv)
    if a.command == "init":
        ok, why = config.validate_source(a.path)
        print(why)
        if ok:
            print(config.save_config({"source": {"pytorch_source": a.path}}))
        return int(not ok)
    source = config.resolve_source(a.source)
    if source is None:
        print("no source: give --source, set PYTORCH_SOURCE or run init", file=sys.stderr)
        return 1
    from pyspark.sql import SparkSession

    from codeloom.plans.build import open_catalog
    from codeloom.plans.tools import Catalog

    render.set_mode(a.format)
    spark = SparkSession.builder.getOrCreate()
    catalog = Catalog(spark, open_catalog(spark, source), source)
    if a.command == "status":
        print(catalog.render("Status", catalog.status()))
    elif a.command == "trace":
        for part, rows in catalog.trace(a.name, a.mode).items():
            print(catalog.render(f"{a.name}: {part}", rows))
    else:
        extra = {k: getattr(a, k) for k in ("limit", "backend", "depth") if hasattr(a, k)}
        print(catalog.render(f"{a.command}: {a.name}", getattr(catalog, a.command)(a.name, a.mode, **extra)))
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""Command line: python -m eventlantern.cli COMMAND ... ; results are JSON on standard output."""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .config import load_aliases, load_mapping
from .operators.documents import record_documents
from .operators.exact import answer
from .operators.extract import extract
from .operators.intake import run_intake
from .operators.inventory import inventory
from .operators.resolve import resolve_one
from .operators.router import MODES, route
from .operators.search import search
from .session import local_session
from .sources.records import load_records, read_raw, write_records


def plain(x):
    """What json can write: rows, frames (all their rows) and dataclasses become lists and dicts."""
    if isinstance(x, Row):
        return {k: plain(v) for k, v in x.asDict().items()}
    if isinstance(x, DataFrame):
        return [plain(r) for r in x.toLocalIterator()]
    if dataclasses.is_dataclass(x):
        return {f.name: plain(getattr(x, f.name)) for f in dataclasses.fields(x)}
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    return [plain(v) for v in x] if isinstance(x, list | tuple) else x


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="eventlantern")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *args: str, **numbers):
        p = sub.add_parser(name)
        for a in args:
            p.add_argument(f"--{a.rstrip('!')}", required=a.endswith("!"))
        for k, v in numbers.items():
            p.add_argument(f"--{k.replace('_', '-')}", type=type(v), default=v)
        return p

    command("extract", "events!", "output!", "mapping", "offense-id")
    command("resolve", "question!", "aliases", top=5, threshold=0.25)
    for name, extra in (("answer", ("question!", "aliases")), ("search", ("query!",)), ("route", ("query!", "aliases"))):
        p = command(name, "records!", "offense-id", *extra, **({"top": 5, "threshold": 0.25} if name == "answer" else {"limit": 10}))
        p.add_argument("--all-offenses", action="store_true", help="search every incident, as is the default")
        if name == "search":
            p.add_argument("--min-score", type=float, default=0.0)
            p.add_argument("--mode", choices=("bm25", "fuzzy"), default="bm25")
        if name == "route":
            p.add_argument("--mode", choices=MODES, default="auto")
    p = command("intake", "file!", "raw!", "records!", "mapping")
    p.add_argument("--overwrite", action="store_true")
    command("inventory", "raw!", "records!")
    return top


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    spark = spark or local_session()
    aliases = load_aliases(getattr(a, "aliases", None))
    if a.command == "extract":
        raw = read_raw(spark, a.events)
        raw = raw if a.offense_id is None else raw.withColumn("offense_id", F.lit(a.offense_id))
        write_records(extract(raw, load_mapping(a.mapping)), a.output)
        out = {"output": a.output}
    elif a.command == "resolve":
        found = resolve_one(spark, a.question, aliases, a.top, a.threshold)
        out = {"best_field": found[0]["field"] if found else None, "matches": found}
    elif a.command == "answer":
        out = answer(load_records(spark, a.records, a.offense_id), a.question, aliases, a.top, a.threshold)
    elif a.command == "search":
        out = search(record_documents(load_records(spark, a.records, a.offense_id)), a.query, a.mode, a.limit, a.min_score)
    elif a.command == "route":
        out = route(load_records(spark, a.records, a.offense_id), a.query, a.mode, a.limit, aliases)
    elif a.command == "intake":
        with open(a.file, "rb") as f:
            out = run_intake(spark, a.file.rsplit("/", 1)[-1], f.read(), a.raw, a.records, a.overwrite, a.mapping)
    else:
        out = inventory(spark, a.records, a.raw)
    json.dump(plain(out), sys.stdout, ensure_ascii=False, indent=2, default=str)
    print()
    return 0


if __name__ == "__main__":
    sys.exit(main())

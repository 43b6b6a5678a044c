"""Query shell: python -m tripleloom [-s] [--summary] [--parts FILE --dict FILE] PATH

Loads N-Triples and Turtle files and answers one query in each line of the input; quit or \\q ends. Rows are printed with
their values separated by pipes; -s runs queries without printing. A line that begins with explain shows the plan."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from tripleloom.plans.engine import Engine
from tripleloom.plans.parser import SparqlError
from tripleloom.plans.stats import analyse
from tripleloom.plans.summary import file_parts, hash_parts, summary_edges
from tripleloom.sources.files import load


#: Skipped statements that are shown; all are counted.
SHOWN = 20


def main(argv: list[str] | None = None) -> int:
    args = argparse.ArgumentParser(prog="tripleloom")
    args.add_argument("path")
    args.add_argument("-s", "--silent", action="store_true")
    args.add_argument("--summary", action="store_true")
    args.add_argument("--parts")
    args.add_argument("--dict")
    args.add_argument("--hash-parts", type=int, default=64)
    opts = args.parse_args(argv)
    spark = SparkSession.builder.appName("tripleloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    started = time.time()
    store = load(spark, opts.path).frozen()
    skipped = store.skipped
    if opts.summary:
        parts = file_parts(store, opts.parts, opts.dict) if opts.parts and opts.dict else hash_parts(store, opts.hash_parts)
        store = store.with_parts(parts).frozen()
        store.summary = summary_edges(store)
    engine = Engine(analyse(store), summary=opts.summary)
    print(f"{store.triples.count()} facts in {time.time() - started:.1f} s", file=sys.stderr)
    for row in skipped.limit(SHOWN).collect():
        print(f"skipped: {row['file_name']}: {row['reason']}: {row['stmt'][:200]}", file=sys.stderr)
    print(f"{skipped.count()} statements skipped", file=sys.stderr)
    for line in sys.stdin:
        line = line.strip()
        if line in ("quit", r"\q"):
            break
        if line:
            _answer(engine, line, opts.silent)
    return 0


def _answer(engine: Engine, text: str, silent: bool) -> None:
    started = time.time()
    try:
        if text.lower().startswith("explain"):
            print(engine.explain(text))
        elif silent:
            engine.query(text, "ids").write.format("noop").mode("overwrite").save()
        else:
            for row in engine.query(text).toLocalIterator():
                print("|".join("" if v is None else str(v) for v in row))
    except (SparqlError, NotImplementedError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
    print(f"{time.time() - started:.2f} s", file=sys.stderr)


if __name__ == "__main__":
    sys.exit(main())

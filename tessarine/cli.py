"""``python -m tessarine.cli``: query PATH TABLE WORDS, sql PATH STATEMENT, tables PATH, reindex PATH TABLE."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .engine import Engine
from .plans.planner import Result


def show(result: Result) -> None:
    print("\t".join(result.df.columns))
    for row in result.pages():
        print("\t".join("" if v is None else str(v) for v in row))


def main(args: list[str], spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessarine", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, more in (("query", ("table", "words")), ("sql", ("statement",)), ("tables", ()), ("reindex", ("table",))):
        command = commands.add_parser(name)
        for arg in ("path", *more):
            command.add_argument(arg, **({"nargs": "+"} if arg == "words" else {}))
    commands.choices["query"].add_argument("--top-k", type=int, default=10)
    commands.choices["reindex"].add_argument("--using", default="bm25")
    given = parser.parse_args(args)
    engine = Engine(spark or SparkSession.builder.appName("tessarine").getOrCreate(), given.path)
    if given.command == "query":
        show(engine.search(given.table, " ".join(given.words), top_k=given.top_k))
    elif given.command == "sql":
        show(engine.sql(given.statement))
    elif given.command == "tables":
        show(engine.sql("SHOW TABLES"))
    else:
        print(engine.create_index(given.table, given.using.lower()))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

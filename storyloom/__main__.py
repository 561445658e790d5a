"""The library's commands from a shell: python -m storyloom --store FOLDER COMMAND [ARGUMENT ...]"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession

from storyloom import library
from storyloom.operators.passes import attributor
from storyloom.sources import adapters
from storyloom.sources.clients import clients
from storyloom.sources.config import load
from storyloom.sources.gold import attribution_gold
from storyloom.sources.store import TableStore


def run(spark: SparkSession, store: TableStore, command: str, arguments: list[str]) -> object:
    """What the command gives; services are those that the environment configures, else their stand-ins."""
    served = clients(load(os.environ))
    embedder = served.get("embedding") or adapters.HashEmbedder()
    more = {
        "parse": lambda book, by="heuristic": (book, attributor(by, served.get("chat"))),
        "index": lambda: (embedder,),
        "search": lambda words, *books: (words, embedder, list(books)),
        "tts": lambda chapter, *voices: (chapter, dict(v.split("=", 1) for v in voices)),
        "eval": lambda book, gold: (book, attribution_gold(spark, gold)),
        "consistency": lambda book: (book, served["chat"]),
        "sync": lambda book: (book, served["knowledge"]),
    }
    return library.COMMANDS[command](store, *more.get(command, lambda *a: a)(*arguments))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="storyloom", description=__doc__)
    parser.add_argument("--store", required=True, help="folder of the tables, any that Spark reads")
    parser.add_argument("command", choices=sorted(library.COMMANDS))
    parser.add_argument("arguments", nargs="*")
    told = parser.parse_args(argv)
    spark = SparkSession.builder.appName("storyloom").getOrCreate()
    found = run(spark, TableStore(spark, told.store), told.command, told.arguments)
    for part in found if isinstance(found, tuple) else (found,):
        if isinstance(part, DataFrame):
            part.show(50, truncate=60)
        else:
            print(part)


if __name__ == "__main__":
    main()

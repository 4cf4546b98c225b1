"""python -m tesserae ingest CONFIG [--rechunk | --stats]; search CONFIG TEXT; evaluate CONFIG --label NAME [--method M] [--encoder
MODULE:FUNCTION] [--baseline FILE].

An encoder is a function that gets the model's name and returns one from an iterator of pandas series of texts to series of vectors.
"""

from __future__ import annotations

import argparse
import importlib
import json
import os
import urllib.request

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tesserae.operators import runs, stats
from tesserae.sources import pages as source
from tesserae.sources.store import Store


def links_of(spark: SparkSession, url: str) -> list[tuple[int, str, str]]:
    """(pos, url, where its Markdown is) of a page list, unsupported ones left out and named."""
    with urllib.request.urlopen(url, timeout=30) as reply:
        text = reply.read().decode("utf-8")
    rows = source.ordered_links(source.link_list(spark.createDataFrame([(text,)], "text string"))).orderBy("pos").collect()
    for r in rows:
        if r.md_url is None:
            print(f"skipped: {r.url}")
    return [(r.pos, r.url, r.md_url) for r in rows if r.md_url is not None]


def encoder_of(name: str | None, config: dict):
    if not name:
        return None
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)(config["search"].get("embedding_model", ""))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tesserae")
    commands = parser.add_subparsers(dest="command", required=True)
    ingest = commands.add_parser("ingest")
    ingest.add_argument("config")
    ingest.add_argument("--rechunk", action="store_true")
    ingest.add_argument("--stats", action="store_true")
    evaluate = commands.add_parser("evaluate")
    evaluate.add_argument("config")
    evaluate.add_argument("--label", required=True)
    evaluate.add_argument("--method", choices=runs.METHODS, default="keyword")
    evaluate.add_argument("--baseline")
    evaluate.add_argument("--encoder", help="MODULE:FUNCTION")
    search = commands.add_parser("search")
    search.add_argument("config")
    search.add_argument("text")
    args = parser.parse_args(argv)

    spark = SparkSession.builder.appName("tesserae").getOrCreate()
    config = runs.load_config(args.config)
    store = Store(spark, config["db"])
    if args.command == "evaluate":
        folder = os.path.dirname(os.path.abspath(args.config))
        baseline = None
        if args.baseline:
            with open(args.baseline) as f:
                baseline = json.load(f)
        record = runs.evaluate(store, config, runs.load_questions(spark, os.path.join(folder, config["eval_set"])), args.label, os.path.join(folder, "results"), args.method, baseline, encoder_of(args.encoder, config))
        print(json.dumps(record["recall"]))
        return
    if args.command == "search":
        found = store.search(args.text, heading_path=bool(config["search"].get("index_heading_path")))
        found.select("rank", "score", "url", "heading_path", "text").show(truncate=80)
        return
    if args.rechunk:
        store.rechunk(runs.settings_of(config))
    elif not args.stats:
        print(store.sync(source.fetch(spark, links_of(spark, config["llms_txt"])), runs.settings_of(config)))
        for r in store.table("failures").limit(100).collect():
            print(f"failed: {r.url}: {r.error}")
    chunks = store.table("chunks")
    stats.chunk_stats(chunks.select("url", "tokens", "part")).show(truncate=False)
    stats.leftovers(chunks.select("text")).where(F.col("n") > 0).show(truncate=False)


if __name__ == "__main__":
    main()

"""python -m scriptorium: extract, prepare, convert and validate from the command line."""

from __future__ import annotations

import argparse
import json
import logging
import os

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from .config import API, DEBUG_API, DEBUG_LOCAL, LOCAL, SYSTEM_API, SYSTEM_LOCAL
from .operators import phrases as phrase_operators
from .plans import pipelines
from .plans.client import Client
from .plans.extractors import chat_service, local_model
from .sources import readers, sinks

log = logging.getLogger("scriptorium")


def _extract(spark: SparkSession, a: argparse.Namespace) -> None:
    """Pages (Parquet: doc_id, page_no, text) to JSON Lines of items."""
    local = a.profile == "local"
    pages = spark.read.parquet(a.pages)
    first, most = (DEBUG_LOCAL if local else DEBUG_API) if a.debug else (0, None)
    pages = readers.page_range(pages, first, most)
    profile = LOCAL if local else API

    if not Client(a.url).reachable():
        raise SystemExit(f"nothing answers at {a.url}")
    if local:
        items, bad = pipelines.local_extraction(pages, lambda: local_model(a.url, a.model, profile), profile, a.system or SYSTEM_LOCAL)
        sinks.write_dead_letters(bad, f"{a.out}-bad")
    else:
        models, key = (a.model, *(a.fallback or ())), os.environ.get(a.key_variable) if a.key_variable else None
        items = pipelines.api_extraction(pages, lambda: chat_service(a.url, models, profile, key), profile, system=a.system or SYSTEM_API)
    seen = Observation("items")
    sinks.write_jsonl(items.observe(seen, F.count(F.lit(1)).alias("n")), a.out)
    log.info("%d items", seen.get["n"])


def _prepare(spark: SparkSession, a: argparse.Namespace) -> None:
    """A CSV of literal cells to train, valid and test prompts and completions."""
    parts = pipelines.training_data(readers.tagged_csv(spark, a.csv), "text", leak_free=a.leak_free)
    sinks.write_split(*parts, a.out)
    log.info("%d training examples", spark.read.text(f"{a.out}/train.jsonl").count())


def _convert(spark: SparkSession, a: argparse.Namespace) -> None:
    """Instruction examples with phrases of a JSON dictionary replaced."""
    with open(a.phrases, encoding="utf-8") as f:
        phrases = json.load(f)
    phrase_operators.convert_records(readers.lines(spark, a.examples), phrases).write.mode("overwrite").text(a.out)


def _validate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Entities with evidence to accepted and rejected."""
    entities = readers.jsonl(spark, a.entities, "doc_id string, page int, evidence string, text string")
    for name, rows in zip(("accepted", "rejected"), pipelines.validation(entities, spark.read.parquet(a.pages))):
        sinks.write_jsonl(rows, f"{a.out}/{name}")


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="scriptorium")
    sub = p.add_subparsers(required=True)
    for name, run, options in (
        ("extract", _extract, ("pages", "out", "url", "model")),
        ("prepare", _prepare, ("csv", "out")),
        ("convert", _convert, ("examples", "phrases", "out")),
        ("validate", _validate, ("entities", "pages", "out")),
    ):
        s = sub.add_parser(name, help=run.__doc__)
        s.set_defaults(run=run)
        for o in options:
            s.add_argument(f"--{o}", required=True)
        if name == "extract":
            s.add_argument("--profile", choices=("local", "api"), default="local")
            s.add_argument("--debug", action="store_true", help="a few pages only")
            s.add_argument("--system", help="the model's instruction, instead of the profile's own")
            s.add_argument("--fallback", action="append", help="a model to try after the first one, for the api profile; may be given again")
            s.add_argument("--key-variable", help="the environment variable that holds the service's key")
        if name == "prepare":
            s.add_argument("--leak-free", action="store_true", help="keep validation rows out of training")
    a = p.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    a.run(SparkSession.builder.appName("scriptorium").getOrCreate(), a)


if __name__ == "__main__":
    main()

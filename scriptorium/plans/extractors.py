"""Extractors: what turns a segment into a response."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import EVENT_TYPES, Profile
from ..operators.parsing import storable
from .client import Client


class Extractor(Protocol):
    """Made once a worker; gives a segment's raw response."""

    def generate(self, text: str) -> str: ...


@dataclass
class Retrying:
    """Calls each model up to ``attempts`` times, waiting longer after each failure; raises the last error.

    An answer that ``accept`` turns down is a failure too, as a cut-off one.
    """

    call: Callable[[str, str], str]  # model, text
    models: tuple[str, ...]
    attempts: int = 3
    wait_s: float = 0.6
    sleep: Callable[[float], None] = time.sleep
    accept: Callable[[str], bool] = lambda answer: True

    def generate(self, text: str) -> str:
        last: Exception | None = None
        for model in dict.fromkeys(self.models):
            for attempt in range(1, self.attempts + 1):
                try:
                    if self.accept(answer := self.call(model, text)):
                        return answer
                    raise ValueError(f"not the form asked for: {answer[:200]!r}")
                except Exception as e:  # noqa: BLE001  any failure of a remote model is tried again
                    last = e
                    self.sleep(self.wait_s * attempt)
        raise last if last is not None else ValueError("no model given")


class HttpExtractor:
    """Posts a prompt as JSON and reads one field of the answer, by the keys and places that lead to it."""

    def __init__(self, client: Client, body: Callable[[str], dict], path: tuple[str | int, ...] = ("response",), headers: dict[str, str] | None = None):
        self.client, self.body, self.path = client, body, path
        self.headers = {"Content-Type": "application/json"} | (headers or {})

    def generate(self, text: str) -> str:
        found = json.loads(self.client.send("POST", json.dumps(self.body(text)).encode(), self.headers))
        for key in self.path:
            found = found[key]
        return found


def local_model(url: str, model: str, profile: Profile) -> HttpExtractor:
    """A local model that takes plain prompts."""
    options = {"num_predict": profile.max_output_tokens, "num_ctx": profile.context_tokens, "temperature": 0}
    return HttpExtractor(Client(url, read_s=profile.timeout_s), lambda text: {"model": model, "prompt": text, "stream": False, "options": options})


def chat_service(url: str, models: tuple[str, ...], profile: Profile, key: str | None = None, sleep: Callable[[float], None] = time.sleep) -> Retrying:
    """A chat service: prompts are JSON lists of messages; each model in turn is tried again before the next one is.

    The models share one client, with its connections and its rate.
    """
    from ..operators.parsing import parse_structured

    client = Client(url, read_s=profile.timeout_s, sleep=sleep)

    def call(model: str, text: str) -> str:
        body = lambda t: {"model": model, "messages": json.loads(t), "temperature": 0, "max_tokens": profile.max_output_tokens, "response_format": {"type": "json_object"}}
        headers = {"Authorization": f"Bearer {key}"} if key else None
        return HttpExtractor(client, body, ("choices", 0, "message", "content"), headers).generate(text)

    return Retrying(call, models, sleep=sleep, accept=lambda answer: parse_structured(answer, EVENT_TYPES)[0])


def extract(segments: DataFrame, make: Callable[[], Extractor], text: str = "seg_text", threads: int = 1) -> DataFrame:
    """segments with raw and error: a failed call is a row with an error, never a failed task.

    ``threads`` overlap calls that wait for a service; order is kept.
    """
    columns = segments.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = make()

        def one(t: str | None) -> tuple[str | None, str | None]:
            try:
                answer = extractor.generate(t or "")
                if not isinstance(answer, str):
                    raise TypeError(f"the answer is no text: {answer!r}"[:500])
                return storable(answer), None
            except Exception as e:  # noqa: BLE001
                return None, storable(f"[EXCEPTION] {e}")

        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                answers = list(pool.map(one, batch.column(text).to_pylist()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([a for a, _ in answers], pa.string()), pa.array([e for _, e in answers], pa.string())], names=[*columns, "raw", "error"])

    schema = T.StructType([*segments.schema.fields, T.StructField("raw", T.StringType()), T.StructField("error", T.StringType())])
    return segments.mapInArrow(run, schema)


#: Rules that stand in for a model: a capitalised word with its two followers, and addresses.
CAPITALISED = "([A-Z][a-z]+) [a-z]+ [a-z]+"


def rule_items(segments: DataFrame, pattern: str = CAPITALISED, text: str = "seg_text") -> DataFrame:
    """Items by rule, grounded by construction: quote and action the match, name its first group, the type by its length."""
    quotes = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rest = segments.columns
    d = segments.select(*rest, F.posexplode_outer(quotes).alias("item_idx", "quote")).where("quote is not null")
    kind: Column = F.get(F.array(*[F.lit(e) for e in EVENT_TYPES]), F.length("quote") % len(EVENT_TYPES))
    none = F.lit(None).cast("string")
    return d.select(*rest, F.col("item_idx").cast("int").alias("item_idx"), F.regexp_extract("quote", pattern, 1).alias("name"), none.alias("rank"), F.col("quote").alias("action"), kind.alias("event_type"), none.alias("time"), "quote")

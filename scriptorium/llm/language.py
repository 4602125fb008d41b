"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of bytes, orders 0 to 2, with frozen counts.
A byte seen n times in a context seen N times with u distinct followers costs
-log2(n / (N + u)); else the escape u / (N + u) is paid and the next shorter
context is asked, renormalised over the bytes that the longer one has not seen;
the last context is uniform.  A text's cost is the exact sum over its bytes,
its language the one of least cost.

The trees are flattened once: every byte triple that any language has seen gets
a row with each language's cost; all other triples cost (escape of the pair) +
(cost in the order-1 context), two tables over all 65,536 pairs.  So a group of
languages has at most 2**24 rows, whatever the corpus.

Tables of more than ``MODEL_BYTES`` are split into groups of languages.  Texts are
costed by one group after the other, each broadcast for itself, and carry along the
least cost so far, its language and the weight of all costs against it; so the
languages of any number are told, and the driver and a worker hold one group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import bounded_batches, materialise, release, tidy
from .wordhash import slices, text_buffer

UNDETERMINED = "und"
SCHEMA = "doc_id long, lang_pred string, score double"
#: Bytes of text, or costs of bytes by language, that are held at once.
_PART, _CELLS = 1 << 20, 1 << 23
#: Languages' triples that a task counts before it hands them on.
_FLUSH = 1 << 22
#: Most bytes of the flattened tables of a group of languages, which every worker holds (or those of one language).
MODEL_BYTES = 1 << 30


def _with_letter(text: pa.Array) -> np.ndarray:
    """Whether each text has a letter (Unicode category L); null has none."""
    return pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)


def _triples(data: np.ndarray, offsets: np.ndarray, at: int, end: int) -> np.ndarray:
    """Codes of the byte triples that end at data[at:end]; before a text stand two line feeds."""
    b = np.concatenate([np.full(2, 10, np.uint8), data[max(0, at - 2) : end]]) if at < 2 else data[at - 2 : end]
    b = b[len(b) - (end - at) - 2 :].astype(np.int32)
    first, second = b[:-2].copy(), b[1:-1].copy()
    begins = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end)] - at
    first[begins] = second[begins] = 10
    begins = offsets[np.searchsorted(offsets, at - 1) : np.searchsorted(offsets, end - 1)] - at + 1
    first[begins[(begins >= 0) & (begins < end - at)]] = 10
    return (first << 16) | (second << 8) | b[2:]


def count_triples(documents: DataFrame) -> DataFrame:
    """(lang, triple, n) over all rows of documents(text, lang); null lang is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (codes, n) in total.items():
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(codes), pa.string()), "triple": pa.array(codes, pa.int32()), "n": pa.array(n, pa.int64())})
            total.clear()

        for batch in slices(batches):
            table = pa.Table.from_batches([batch])
            for lang in set(batch.column("lang").to_pylist()):
                rows = table.filter(pa.compute.equal(table["lang"], lang))
                data, offsets = text_buffer(rows["text"])
                if not len(data):
                    continue
                codes, n = np.unique(_triples(data, offsets, 0, len(data)), return_counts=True)
                if lang in total:
                    codes, where = np.unique(np.concatenate([total[lang][0], codes]), return_inverse=True)
                    n = np.bincount(where, np.concatenate([total[lang][1], n])).astype(np.int64)
                total[lang] = codes, n
            if sum(len(codes) for codes, _ in total.values()) > _FLUSH:
                yield from flush()
        yield from flush()

    known = documents.where(F.col("lang").isNotNull()).select("text", "lang")
    return known.mapInArrow(tidy(run), "lang string, triple int, n long").groupBy("lang", "triple").agg(F.sum("n").alias("n"))


def _order0(n: np.ndarray) -> np.ndarray:
    seen = n > 0
    total, u = n.sum(), seen.sum()
    if not u:
        return np.full(256, 1 / 256)
    escape = u / (total + u)
    return np.where(seen, n / (total + u), escape / max(1, 256 - u))


def _deeper(n: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Probabilities [context, byte] from counts and those of the shorter context."""
    seen = n > 0
    total, u = n.sum(1, keepdims=True), seen.sum(1, keepdims=True)
    left = np.where(seen, 0, shorter).sum(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        escape = np.where(u > 0, u / (total + u) / np.maximum(left, 1e-300), 1.0)
        return np.where(seen, n / (total + u), escape * shorter)


class PpmModel:
    """Flattened context trees of all languages; ``languages`` is sorted."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(counts)
        size = len(self.languages)
        self.triples = np.unique(np.concatenate([c for c, _ in counts.values()])) if size else np.zeros(0, np.int32)
        self.cost = np.zeros((len(self.triples), size), np.float32)
        self.pair = np.zeros((1 << 16, size), np.float32)  # order-1 cost of (byte, next)
        self.escape = np.zeros((1 << 16, size), np.float32)  # of the two-byte context
        for k, lang in enumerate(self.languages):
            codes, n = (np.asarray(x) for x in counts[lang])
            n = n.astype(np.float64)
            pairs = np.bincount(codes & 0xFFFF, n, 1 << 16).reshape(256, 256)
            p1 = _deeper(pairs, np.broadcast_to(_order0(pairs.sum(0)), (256, 256))).reshape(-1)
            context = codes >> 8
            total = np.bincount(context, n, 1 << 16)
            u = np.bincount(context, minlength=1 << 16)
            left = 1 - np.bincount(context, p1[codes & 0xFFFF], 1 << 16)
            with np.errstate(divide="ignore", invalid="ignore"):
                self.escape[:, k] = np.where(u > 0, np.log2(np.maximum(left, 1e-12)) - np.log2(u / (total + u)), 0)
            self.pair[:, k] = -np.log2(p1)
            self.cost[:, k] = self.escape[self.triples >> 8, k] + self.pair[self.triples & 0xFFFF, k]
            self.cost[np.searchsorted(self.triples, codes), k] = -np.log2(n / (total + u)[context])

    def parts(self) -> Iterator[PpmModel]:
        yield self

    def index(self) -> np.ndarray:
        """Row of each of the 2**24 triples, -1: none."""
        out = np.full(1 << 24, -1, np.int32)
        out[self.triples] = np.arange(len(self.triples), dtype=np.int32)
        return out

    def bits(self, column: pa.Array, index: np.ndarray) -> np.ndarray:
        """Code lengths [text, language] in bits."""
        data, offsets = text_buffer(column)
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        part = min(_PART, max(1, _CELLS // max(1, len(self.languages))))
        for at in range(0, len(data), part):
            end = min(at + part, len(data))
            codes = _triples(data, offsets, at, end)
            row = index[codes]
            cost = self.cost[row] if len(self.cost) else np.zeros((len(row), len(self.languages)), np.float32)
            other = np.flatnonzero(row < 0)
            if len(other):
                cost[other] = self.escape[codes[other] >> 8] + self.pair[codes[other] & 0xFFFF]
            first = int(np.searchsorted(offsets, at, "right")) - 1
            last = int(np.searchsorted(offsets, end))
            docs = np.arange(first, last)
            docs = docs[offsets[docs + 1] > offsets[docs]]
            out[docs] += np.add.reduceat(cost, np.maximum(offsets[docs], at) - at, axis=0, dtype=np.float64)
        return out


class GroupedModel:
    """Models of groups of languages in order, each built from the written counts (lang, triple, n) when it is asked for."""

    def __init__(self, counts: DataFrame, groups: list[list[str]]):
        self._counts, self._groups = counts, groups
        self.languages = [lang for group in groups for lang in group]

    def parts(self) -> Iterator[PpmModel]:
        for group in self._groups:
            yield _model(self._counts.where(F.col("lang").isin(group)))


def _model(counts: DataFrame) -> PpmModel:
    found = counts.toArrow()
    lang, codes, n = found["lang"].to_numpy(), found["triple"].to_numpy(), found["n"].to_numpy()
    return PpmModel({x: (codes[lang == x], n[lang == x]) for x in set(lang.tolist())})


def train(documents: DataFrame) -> PpmModel | GroupedModel:
    """The model of documents(text, lang).

    To the driver goes at most one row a triple and language of a group.  A group has as
    many languages as ``MODEL_BYTES`` hold, one at least, in order of their names; where
    one group holds all, it is the model.  Rows without text or language teach nothing.
    """
    bounded_batches(documents.sparkSession)
    counts = materialise(count_triples(documents), "triples")
    languages = sorted(r[0] for r in counts.select("lang").distinct().collect())
    rows = counts.select("triple").distinct().count() + (2 << 16)
    size = max(1, MODEL_BYTES // (4 * rows))
    if len(languages) > size:
        return GroupedModel(counts, [languages[k : k + size] for k in range(0, len(languages), size)])
    model = _model(counts)
    release(counts)
    return model


def _merged(model: PpmModel, bits: np.ndarray, best: np.ndarray, lang: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least cost, its language and the weight 2**(least - cost) of all languages, after those of ``model`` too; the first of equal costs stays."""
    if not model.languages:
        return best, lang, weight
    least = np.minimum(best, bits.min(1))
    names = np.array(model.languages, object)[bits.argmin(1)]
    weight = weight * np.exp2(np.maximum(least - best, -1000)) + np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
    return least, np.where(least < best, names, lang), weight


def _told(documents: DataFrame, model: PpmModel | GroupedModel, finish, schema: T.StructType | str) -> DataFrame:
    """What ``finish(batch, language, score)`` makes of each batch of documents(text, ...), score 0 and no language where none was learned.

    What one group of languages told of the texts is written before the next is asked.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    names = [c.lower() for c in documents.columns]
    state = []
    for name, kind in (("least_bits", T.DoubleType()), ("least_lang", T.StringType()), ("weight", T.DoubleType())):
        while name in names:
            name += "_"
        state.append(T.StructField(name, kind))
    wider = T.StructType([*documents.schema.fields, *state])

    def step(shared, first: bool, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            index = model.index()
            for batch in slices(batches):
                n = batch.num_rows
                bits = model.bits(batch.column("text"), index)
                rows = batch if first else batch.select(range(batch.num_columns - 3))
                held = (np.full(n, np.inf), np.full(n, None, object), np.zeros(n)) if first else tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns[-3:])
                best, lang, weight = _merged(model, bits, *held)
                if last:
                    yield finish(rows, lang, np.where(weight > 0, 1 / np.maximum(weight, 1), 0.0))
                else:
                    kept = [pa.array(best), pa.array(lang, pa.string()), pa.array(weight)]
                    yield pa.RecordBatch.from_arrays([*rows.columns, *kept], names=wider.names)

        return tidy(run)

    parts, first, held = model.parts(), True, None
    part = next(parts)
    while True:
        after = next(parts, None)
        out = (documents if held is None else held).mapInArrow(step(spark.sparkContext.broadcast(part), first, after is None), schema if after is None else wider)
        if after is None:
            return out
        out = materialise(out, "language-costs")
        if held is not None:
            release(held)
        part, first, held = after, False, out


def predict(documents: DataFrame, model: PpmModel | GroupedModel) -> DataFrame:
    """doc_id, lang_pred, score of every row of documents(doc_id, text).

    score: the posterior of the predicted language under equal priors.  Null
    text, text without a letter (Unicode category L), or a model without
    languages: ``und``, 0.  Equal costs go to the alphabetically first language.
    Very long texts are costed part by part.  Repeated rows get a row each; other
    columns are ignored; an empty table gives no rows.
    """

    def finish(batch: pa.RecordBatch, lang: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        known = _with_letter(batch.column("text")) & (score > 0)
        names = [x if ok else UNDETERMINED for x, ok in zip(lang, known)]
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), "lang_pred": pa.array(names, pa.string()), "score": pa.array(np.where(known, score, 0.0), pa.float64())})

    return _told(documents.select("doc_id", "text"), model, finish, SCHEMA)


#: A document whose language is less certain than this is rejected.
MIN_SCORE = 0.5


def keep_identified(documents: DataFrame, model: PpmModel | GroupedModel) -> DataFrame:
    """The rows of documents whose language the model tells with ``MIN_SCORE``; same columns.

    Null text, text without a letter and doubtful text go.  A model without
    languages can't reject: every row with a letter stays.  Repeated rows are
    judged each; an empty table stays empty.
    """
    learned = bool(model.languages)

    def finish(batch: pa.RecordBatch, lang: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        keep = _with_letter(batch.column("text"))
        return batch.filter(pa.array(keep & (score >= MIN_SCORE) if learned else keep))

    return _told(documents, model, finish, documents.schema)

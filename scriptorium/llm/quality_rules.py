"""Quality rules with thresholds learned for each language and source.

Every text gets counts; features (integers, per mille) follow from them.  The
features of all texts go into quantile sketches: log-linear histograms with a
bucket for each integer below 16 and 16 buckets an octave above, so a quantile
is off by at most a sixteenth.  Sketches merge by adding counts - the result
does not depend on the order of merging, and a retried task changes nothing.
They are built for (language, source) and merged to languages.  Each has fences

    fence = q75 + WIDTH * max(q75 - q25, the feature's least spread)

and a text is compared with its source's fence, drawn towards its language's the
more the fewer texts the source has (as if the language had ``PRIOR_TEXTS`` in it):

    (texts * source fence + PRIOR_TEXTS * language fence) // (texts + PRIOR_TEXTS)

Only built-in functions.  A hot source is summed before the shuffle; the
sketch table has at most (groups x features x 1,000) rows.  Fences are broadcast
while there are at most ``BROADCAST_ROWS`` of them; more are joined by a
shuffle, whose hot keys adaptive execution splits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise

MIN_WORDS = 50
PRIOR_TEXTS = 200
BROADCAST_ROWS = 100_000
WIDTH = 4
#: Features and the least spread (per mille) that their fences assume.
LEAST_SPREAD = {"word_length": 250, "symbol_share": 8, "dup_line_share": 100, "repeat_share": 100, "capital_share": 20}

_BLANK = r"[\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\f\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _div(a: Column, b: Column) -> Column:
    """Integer quotient, 0 where b is 0."""
    return F.when(b > 0, F.floor(a / b)).otherwise(F.lit(0)).cast("long")


def _bucket(v: Column) -> Column:
    octave = F.length(F.bin(v)) - 5
    return F.when(v < 16, v).otherwise(16 * octave + F.floor(v / F.pow(F.lit(2.0), octave))).cast("int")


def _edge(bucket: Column) -> Column:
    """Least value of a bucket."""
    octave = F.floor((bucket - 16) / 16)
    return F.when(bucket < 16, bucket).otherwise((bucket - 16 * octave) * F.pow(F.lit(2.0), octave)).cast("long")


def count_features(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base counts and the features of every row.

    Null text counts as empty.  A word: a run of characters other than ASCII white space.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = documents.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), text.alias("t"))
    d = d.select(
        "doc_id", "lang", "source",
        F.when(F.btrim("t", F.lit(_BLANKS)) == "", F.array().cast("array<string>")).otherwise(F.split(F.btrim("t", F.lit(_BLANKS)), _BLANK)).alias("w"),
        F.filter(F.split("t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("t", r"[^\p{Lu}]+", "")).cast("long").alias("n_capitals"),
    )
    # hashes of all three-word windows
    d = d.withColumn("g", F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))))
    # (hash, place) in order, only where some window comes again
    d = d.withColumn("s", F.when(F.size(F.array_distinct("g")) < F.size("g"), F.sort_array(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda e, j: e["h"] == F.get("s", j)["h"]
    d = d.withColumn("p", F.sort_array(F.transform(F.filter("s", lambda e, j: F.coalesce(same(e, j - 1), F.lit(False)) | F.coalesce(same(e, j + 1), F.lit(False))), lambda e: e["i"])))
    # each place covers three words, of which those after the place before count
    covered = F.aggregate("p", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")))["n"]
    d = d.select(
        "doc_id", "lang", "source", "n_symbols", "n_capitals",
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("w").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    n = F.col
    return d.select(
        "doc_id", "lang", "source", *COUNTS,
        ((n("n_words") < MIN_WORDS) | (100 * n("n_repeat_words") > 50 * n("n_words"))).alias("base_failed"),
        _div(1000 * n("word_chars"), n("n_words")).alias("word_length"),
        _div(1000 * n("n_symbols"), n("word_chars")).alias("symbol_share"),
        _div(1000 * n("n_dup_lines"), n("n_lines")).alias("dup_line_share"),
        _div(1000 * n("n_repeat_words"), n("n_words")).alias("repeat_share"),
        _div(1000 * n("n_capitals"), n("word_chars")).alias("capital_share"),
    )


def sketch(features: DataFrame) -> DataFrame:
    """Mergeable sketches of (language, source): (lang, source, feature, bucket, n)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), _bucket(F.col(f)).alias("bucket")) for f in LEAST_SPREAD])).alias("x")
    return features.where(~F.col("base_failed")).select("lang", "source", pairs).groupBy("lang", "source", F.col("x.feature").alias("feature"), F.col("x.bucket").alias("bucket")).agg(F.count("*").alias("n"))


def fences(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, texts seen, one fence a feature) from the sketches merged to ``keys``."""
    merged = sketches.groupBy(*keys, "feature", "bucket").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(*keys, "feature")
    q = merged.withColumns({"below": F.sum("n").over(own.orderBy("bucket")), "total": F.sum("n").over(own)})
    quantile = lambda k: F.min(F.when(100 * F.col("below") >= k * F.col("total"), _edge(F.col("bucket"))))
    q = q.groupBy(*keys, "feature").agg(quantile(25).alias("low"), quantile(75).alias("high"), F.max("total").alias("total"))
    spread = F.create_map(*[F.lit(x) for pair in LEAST_SPREAD.items() for x in pair])
    fence = F.col("high") + WIDTH * F.greatest(F.col("high") - F.col("low"), spread[F.col("feature")].cast("long"))
    return q.groupBy(*keys).agg(F.max("total").alias("seen"), *[F.max(F.when(F.col("feature") == f, fence)).alias(f) for f in LEAST_SPREAD])


def judge(documents: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept of every row of documents(doc_id, text, lang, source).

    kept: not base_failed, and no feature above its fence.  A null language or
    source counts as "", null text as empty.  A very long text is one row's work.
    Values on a fence are kept.  Repeated rows get a row each; an empty table gives
    none; other columns are ignored.
    """
    features = materialise(count_features(documents), "quality-features")
    sketches = sketch(features)
    own, whole = fences(sketches, ["lang", "source"]), fences(sketches, ["lang"])
    both = own.join(whole.select("lang", *[F.col(f).alias(f"{f}_lang") for f in LEAST_SPREAD]), "lang")
    total = F.col("seen") + PRIOR_TEXTS
    mixed = lambda f: F.col("seen") * F.col(f) + PRIOR_TEXTS * F.col(f"{f}_lang")
    drawn = [((mixed(f) - mixed(f) % total) / total).cast("long").alias(f"{f}_fence") for f in LEAST_SPREAD]
    both = materialise(both.select("lang", "source", *drawn), "quality-fences")
    d = features.join(F.broadcast(both) if both.count() <= BROADCAST_ROWS else both, ["lang", "source"], "left")
    # a group without fences has no text that passed the base
    above = [F.coalesce(F.col(f) > F.col(f"{f}_fence"), F.lit(False)) for f in LEAST_SPREAD]
    return d.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & ~reduce(Column.__or__, above)).alias("kept"), *[F.col(f) for f in LEAST_SPREAD])

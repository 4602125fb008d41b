"""Personal data by bootstrapped contextual extraction.

Four fixed patterns find base spans: the seeds.  The words around a seed make
lexical patterns: the two before it; one before and one after it; one before it
with the shape of the value itself.  Every other blank-delimited token of the
corpus that stands in the slot of such a pattern is an instance.  Patterns and
instances form a bipartite graph over the corpus, and scores go back and forth
over it ``ITERATIONS`` times, in millionths, so that sums do not depend on their order:

    pattern  = sum of its instances' scores / (number of its instances + PRIOR)
    instance = 1 for a seed, else 1 - product over its patterns of (1 - score)

Patterns count only with ``MIN_SEEDS`` distinct seeds that are at least ``MIN_SHARE``
of their instances; others say too little.  An instance of at least ``MIN_SCORE`` that
stands in such patterns for at least ``MIN_OWN`` of its places in the corpus - a word
that only strays into one does not - is a new identifier, reported wherever it
stands, as ``id_`` with the kind of seeds of its best pattern.

Only built-in functions.  The graph has distinct (pattern, instance) edges,
summed before they are shuffled, so a frequent instance or pattern is one row; how
many instances a pattern has is first told by a mergeable sketch, so that patterns
which everything fits never send their edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise, release

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, *(f"id_{k}" for k in BASE_KINDS))
#: The base patterns.  Repeats are possessive, as the engine recurses over others and long runs exhaust
#: its stack; a start inside a run that the run's own start has tried is ruled out, or long runs would take quadratic time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ITERATIONS, PRIOR, MIN_SEEDS, MIN_SHARE, MIN_SCORE, MIN_OWN = 3, 1, 3, 0.2, 0.8, 0.5
_SCALE = 1_000_000
#: Shortest token that can be an identifier, and the signs that are no part of one at its ends.
MIN_TOKEN = 4
_EDGES = ".,;:!?\"'`()[]{}<>|*#$%&=~^\u00ab\u00bb\u201c\u201d\u201e\u2018\u2019"
#: Tables of at most so many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000
_BLANKS = r"[\x20\x09-\x0D]+"
#: Private characters that hold a seed's place in a text: mark, kind, digits of its hash, end of mark.
_MARK, _MARK_END = "\ue000", "\ue001"


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Arrays are run through in blocks of so many entries, as each step copies what its block has so far.
_BLOCK = 256


def _running(values: Column, add) -> Column:
    """For each entry 0 added up, by an associative ``add``, with all entries before it; one more entry with all of them."""

    def run(part: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, start, lambda acc, x: F.struct(add(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    def whole(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.size(v), F.lit(_BLOCK)), lambda at: F.slice(v, at + 1, F.lit(_BLOCK)))
        zero = F.lit(0)

        def lay(blocks: Column) -> Column:
            sums = run(F.transform(blocks, lambda x: F.aggregate(x, zero, add)), zero)
            each = lambda bases: F.flatten(F.transform(blocks, lambda x, i: run(x, F.get(bases["out"], i))["out"]))
            return _let(sums, lambda bases: F.concat(each(bases), F.array(bases["at"])))

        return _let(blocks, lay)

    return _let(values, whole)


def _find(text: str, pattern: str, gate: Column) -> Column:
    """(start, end, found) of all leftmost non-overlapping matches; none where ``gate`` is false."""
    kind = "array<struct<start:int,end:int,found:string>>"

    def lay(parts: Column) -> Column:
        found, gaps = parts["found"], parts["gaps"]
        sizes = F.transform(found, lambda m, i: F.length(m) + F.length(F.get(gaps, i)))

        def one(before: Column):
            start = lambda i: F.get(before, i) + F.length(F.get(gaps, i))
            return F.transform(found, lambda m, i: F.struct(start(i).alias("start"), (start(i) + F.length(m)).alias("end"), m.alias("found")))

        return F.when(F.size(found) > 0, _let(_running(sizes, lambda a, x: a + x), one))

    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    return F.coalesce(F.when(gate, _let(parts, lay)), F.array().cast(kind))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


_VALID = {
    "email": lambda x: F.lit(True),
    "ip": lambda x: F.forall(F.split(x, r"\."), lambda p: _let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255")))),
    "card": lambda x: _let(_digits(x), lambda d: F.length(d).between(13, 19) & _luhn(d)),
    "phone": lambda x: F.length(_digits(x)).between(9, 15),
}


def _kept(matches: Column, place: int, valid) -> Column:
    """The valid matches, with the place of their kind."""
    good = F.filter(matches, lambda m: valid(m["found"]))
    return F.transform(good, lambda m: F.struct(F.lit(place).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["found"].alias("found")))


def _spans(text: str) -> Column:
    """Base spans (kind's place, start, end, found), by kind, then start."""
    digit = F.col(text).rlike("[0-9]")
    gates = {"email": F.contains(F.col(text), F.lit("@")), "ip": digit & F.contains(F.col(text), F.lit(".")), "card": digit, "phone": F.contains(F.col(text), F.lit("+"))}
    each = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        each.append(_kept(_find(text, pattern, gates[kind]), k, _VALID[kind]))
    return F.concat(*each)


def _bare(spans: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _shape(x: Column) -> Column:
    """Letters as a or A, digits as 0, blanks as _."""
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    return F.translate(x, lower + upper + digits + " ", "a" * 26 + "A" * 26 + "0" * 10 + "_")


def _replaced(text: Column, spans: Column, by) -> Column:
    """text with by(span) in place of each of the spans (start, end negated, ...) in order; of overlapping ones the first covers all."""

    def lay(z: Column) -> Column:
        chars, s = z["chars"], z["spans"]

        def build(ends: Column) -> Column:  # the farthest end before each span
            cut = lambda a, n: F.array_join(F.slice(chars, a + 1, n), "")
            one = lambda x, i: F.when(x["start"] >= F.get(ends, i), F.concat(cut(F.get(ends, i), x["start"] - F.get(ends, i)), by(x))).otherwise("")
            return F.concat(F.array_join(F.transform(s, one), ""), cut(F.get(ends, F.size(s)), F.size(chars)))

        return _let(_running(F.transform(s, lambda x: -x["end"]), lambda a, x: F.greatest(a, x)), build)

    return _let(F.struct(F.split(text, "").alias("chars"), spans.alias("spans")), lay)


def occurrences(documents: DataFrame) -> DataFrame:
    """row (all columns of documents), key and hash (tell different rows apart), spans (base), seeded (the text with a mark in place of each span, null without any)."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    d = documents.select(F.struct("*").alias("row")).select("row", text.alias("t"))
    d = d.select("row", "t", _spans("t").alias("spans"))
    # its shape is told by the mark, as the blanks in a value would make it several tokens
    value = lambda s: F.concat(F.lit(_MARK), s["kind"].cast("string"), F.replace(F.xxhash64(s["found"]).cast("string"), F.lit("-"), F.lit("0")), F.lit("/"), _shape(s["found"]), F.lit(_MARK_END))
    ordered = F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"), s["found"].alias("found"))))
    plain = F.translate("t", _MARK + _MARK_END, "  ")
    seeded = F.when(F.size("spans") > 0, _replaced(plain, ordered, value))
    return d.select("row", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(0)).alias("key"), F.xxhash64("t").alias("hash"), _bare("spans").alias("spans"), seeded.alias("seeded"))


def _slots(rows: DataFrame, *keep: str) -> DataFrame:
    """A row for each token and pattern around it: the columns to keep, token, pattern (a hash)."""
    text = F.regexp_replace(F.coalesce("seeded", F.translate(F.coalesce(F.col("row.text"), F.lit("")), _MARK + _MARK_END, "  ")), _BLANKS, " ")
    d = rows.select(*keep, text.alias("x")).select(*keep, F.split("x", " ").alias("w"), F.split(F.lower(F.regexp_replace("x", r"[^\p{L} ]+", "")), " ").alias("v"))
    # laid side by side, as rows of plain columns are compiled and functions over arrays are not
    none = F.array(F.lit(""))
    beside = F.arrays_zip(F.col("w").alias("token"), F.concat(none, none, "v").alias("two"), F.concat(none, "v").alias("one"), F.slice("v", F.lit(2), F.size("v")).alias("after"))
    d = d.select(*keep, F.inline(beside)).where(F.length("token") >= MIN_TOKEN)
    marked = F.contains("token", F.lit(_MARK))
    shape = F.when(marked, F.substring_index(F.substring_index("token", "/", -1), _MARK_END, 1)).when(F.col("token").rlike("[0-9]"), _shape(F.btrim("token", F.lit(_EDGES))))
    one, after = F.col("one") != "", F.coalesce(F.col("after") != "", F.lit(False))
    patterns = F.array(
        F.when(one & (F.col("two") != ""), F.xxhash64(F.lit("2<"), "two", "one")),
        F.when(one & after, F.xxhash64(F.lit("1<>"), "one", "after")),
        F.when(one & shape.isNotNull(), F.xxhash64(F.lit("1<s"), "one", shape)),
    )
    return d.select(*keep, "token", F.explode(patterns).alias("pattern")).where("pattern is not null")


def _instance() -> Column:
    return F.btrim("token", F.lit(_EDGES))


def _others(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, instance) of the tokens other than seeds in the slots of patterns."""
    slots = _slots(found).where(~F.contains("token", F.lit(_MARK))).join(_small(patterns.select("pattern")), "pattern", "left_semi")
    return slots.select("pattern", _instance().alias("instance")).where(F.length("instance") >= MIN_TOKEN)


def _small(table: DataFrame) -> DataFrame:
    """A table, broadcast if it has few rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _with_share(patterns: DataFrame, others: DataFrame) -> DataFrame:
    """The patterns whose seeds are at least MIN_SHARE of their instances, by a sketch of the other instances."""
    n = others.groupBy("pattern").agg(F.approx_count_distinct(F.xxhash64("instance")).alias("others"))
    share = F.col("seeds") >= MIN_SHARE * (F.col("seeds") + F.coalesce("others", F.lit(0)))
    return patterns.join(n, "pattern", "left").where(share).select(*patterns.columns)


def graph(found: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """The patterns that say enough (pattern, kind), and their edges (pattern, instance, seed, places) from ``occurrences``.

    None where no pattern has enough seeds: there is nothing to look for then.
    """
    marked = _slots(found.where("seeded is not null")).where(F.contains("token", F.lit(_MARK)))
    mark = F.regexp_extract("token", f"{_MARK}([0-9]+)/", 1)
    seeds = materialise(marked.select("pattern", mark.alias("instance")).distinct(), "pattern-seeds")
    own = seeds.groupBy("pattern", F.substring("instance", 1, 1).cast("int").alias("kind")).agg(F.count("*").alias("n"))
    own = own.groupBy("pattern").agg(F.sum("n").alias("seeds"), F.max(F.struct("n", (-F.col("kind")).alias("kind")))["kind"].alias("kind")).where(F.col("seeds") >= MIN_SEEDS)
    own = materialise(own.select("pattern", "seeds", (-F.col("kind")).alias("kind")), "patterns")
    if own.isEmpty():
        release(seeds, own)
        return None
    # the texts with seeds alone rule out the patterns that everything fits; what is left is asked of all texts
    likely = materialise(_with_share(own, _others(found.where("seeded is not null"), own)), "likely-patterns")
    strong = materialise(_with_share(likely, _others(found, likely)).drop("seeds"), "strong-patterns")
    edges = _others(found, strong).groupBy("pattern", "instance").agg(F.lit(False).alias("seed"), F.count("*").alias("places"))
    edges = edges.unionAll(seeds.join(_small(strong.select("pattern")), "pattern", "left_semi").select("pattern", F.concat(F.lit(_MARK), "instance"), F.lit(True), F.lit(0)))
    edges = materialise(edges, "pattern-instance")
    release(seeds, own, likely)
    return strong, edges


def discover(strong: DataFrame, edges: DataFrame) -> DataFrame:
    """(instance, kind, score in millionths) of the instances of high confidence that are no seeds."""
    scores = edges.groupBy("instance").agg(F.when(F.max("seed"), _SCALE).otherwise(0).cast("long").alias("score"))
    for _ in range(ITERATIONS):
        p = edges.join(scores, "instance").groupBy("pattern").agg(F.expr(f"sum(score) div (count(*) + {PRIOR})").alias("p"))
        own = -F.log1p(-F.least("p", F.lit(_SCALE - 1)) / _SCALE)
        told = edges.join(p, "pattern").select("instance", "pattern", "seed", "p", F.round(own * _SCALE).cast("long").alias("e"))
        score = F.when(F.max("seed"), _SCALE).otherwise(F.round(_SCALE * (1 - F.exp(-F.sum("e") / _SCALE)))).cast("long")
        scores = materialise(told.groupBy("instance").agg(score.alias("score"), F.max("seed").alias("seed"), F.max(F.struct("p", "pattern"))["pattern"].alias("pattern")), "scores").drop("p")
        last, scores = scores, scores.select("instance", "score")
    new = last.where(~F.col("seed") & (F.col("score") >= int(MIN_SCORE * _SCALE)))
    return new.join(strong, "pattern").select("instance", "kind", "score")


_NONE = "array<struct<kind:int,start:int,end:int>>"


def _discovered(found: DataFrame) -> DataFrame:
    """key, hash, extra: the spans of new identifiers, of the document rows that have any."""
    nothing = found.sparkSession.createDataFrame([], f"key long, hash long, extra {_NONE}")
    if (both := graph(found)) is None:
        return nothing
    strong, edges = both
    new = materialise(discover(strong, edges), "discovered")
    if new.isEmpty():
        release(edges, new)
        return nothing
    # where they stand: in strong patterns, and everywhere
    whole = F.regexp_replace(F.coalesce("seeded", F.col("row.text"), F.lit("")), _BLANKS, " ")
    tokens = found.select("key", "hash", F.explode(F.split(whole, " ")).alias("token")).select("key", "hash", _instance().alias("instance"))
    places = materialise(tokens.where(F.length("instance") >= MIN_TOKEN).join(_small(new), "instance"), "places")
    # a place may be in several strong patterns: the one with most of them counts
    inside = edges.groupBy("instance").agg(F.max("places").alias("inside"))
    total = places.groupBy("instance").agg(F.count("*").alias("total"))
    sure = total.join(inside, "instance").where(F.col("inside") >= MIN_OWN * F.col("total")).select("instance")
    kinds = materialise(new.join(sure, "instance", "left_semi").select("instance", "kind"), "sure")
    wanted = materialise(places.join(_small(kinds.select("instance")), "instance", "left_semi").select("key", "hash").distinct(), "rows-with-new")
    release(edges, places, new)
    rows = found.join(_small(wanted), ["key", "hash"], "left_semi")
    text = F.coalesce(F.col("row.text"), F.lit(""))
    token = _find("t", r"[^\x20\x09-\x0D]+", F.lit(True))
    tokens = rows.select("key", "hash", text.alias("t")).dropDuplicates(["key", "hash"]).select("key", "hash", F.explode(token).alias("m"))
    inner = F.btrim("m.found", F.lit(_EDGES))
    left = F.col("m.start") + F.length("m.found") - F.length(F.ltrim("m.found", F.lit(_EDGES)))
    at = tokens.select("key", "hash", inner.alias("instance"), left.alias("start")).join(_small(kinds), "instance")
    at = at.select("key", "hash", "kind", "start", (F.col("start") + F.length("instance")).alias("end"))
    spans = rows.select("key", "hash", "spans").dropDuplicates(["key", "hash"]).select("key", "hash", F.explode("spans").alias("s")).select("key", "hash", F.lit(None).cast("int").alias("kind"), "s.start", "s.end")
    return _free(at, spans)


def _free(found: DataFrame, spans: DataFrame) -> DataFrame:
    """key, hash, extra: the places found(key, hash, kind, start, end) that none of spans(..., kind null) overlaps, by kind, then start.

    A place meets a span that begins before the place ends and ends after it begins, so the
    farthest end of the spans before a place's end tells; a text's places are sorted once.
    """
    both = found.select("*", F.col("end").alias("at")).unionAll(spans.select("*", F.col("start").alias("at")))
    # a span that begins where a place ends comes after it
    before = Window.partitionBy("key", "hash").orderBy("at", F.col("kind").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(F.col("kind").isNull(), F.col("end"))).over(before)
    free = both.withColumn("reach", reach).where(F.col("kind").isNotNull() & (F.coalesce("reach", F.lit(0)) <= F.col("start")))
    own = F.struct((F.col("kind") + len(BASE_KINDS)).alias("kind"), "start", "end")
    return free.groupBy("key", "hash").agg(F.sort_array(F.collect_list(own)).cast(_NONE).alias("extra"))


def find_personal_data(documents: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of kind's place, start, end, by kind, then start) of every row.

    documents(doc_id, text).  Null and empty texts have none.  Offsets are code
    points, ends exclusive.  Long texts take time in proportion to their length.
    Without seeds nothing is discovered.  Equal values are one instance, however
    often their rows repeat; of equal scores the pattern of greater hash names the
    kind.  Repeated rows get a row each; an empty table gives none; other columns,
    whatever their names, are ignored.
    """
    found = materialise(occurrences(documents.select("doc_id", "text")), "occurrences")
    extra = materialise(_discovered(found), "discovered-spans")
    every = found.select("row.doc_id", "key", "hash", "spans").join(_small(extra), ["key", "hash"], "left")
    return every.select("doc_id", F.col("spans").alias("base"), F.concat("spans", F.coalesce("extra", F.array().cast(_NONE))).alias("spans"))


def redact(documents: DataFrame) -> DataFrame:
    """documents with each span of personal data replaced by its kind in brackets, n_chars renewed; same columns.

    Of overlapping spans the first to start (the longer, then first kind of equal
    ones) names the gap, which covers all of them.  Null text stays null, text
    without personal data as it is.  Repeated rows stay each; an empty table stays
    empty; other columns, whatever their names, are kept.  Texts are not shuffled
    while the rows with discovered identifiers are few enough to broadcast.
    """
    found = materialise(occurrences(documents), "occurrences")
    extra = materialise(_discovered(found), "discovered-spans")
    d = found.select("row", "key", "hash", "spans").join(_small(extra), ["key", "hash"], "left")
    turned = lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"))
    d = d.select("row", F.sort_array(F.transform(F.concat("spans", F.coalesce("extra", F.array().cast(_NONE))), turned)).alias("all"))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = F.when(F.size("all") > 0, _replaced(F.col("row.text"), F.col("all"), lambda s: F.get(names, s["kind"]))).otherwise(F.col("row.text"))
    d = d.select("row", text.alias("new"))
    row = F.col("row").withField("text", F.col("new"))
    if "n_chars" in documents.columns:
        row = row.withField("n_chars", F.when(F.col("new").isNotNull(), F.length("new")).otherwise(F.col("row.n_chars")).cast(documents.schema["n_chars"].dataType))
    return d.select(row.alias("row")).select("row.*")


def joined(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

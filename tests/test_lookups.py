import random

import pytest
from pyspark.sql import functions as F

from scriptorium.config import Profile
from scriptorium.operators import asof, chunking, open_fields, parsing, spans, tags


def nearest(left, right, tolerance):
    """(id, taken) by trying all pairs."""
    out = []
    for key, at, n in left:
        near = [(a, v is not None, v or "") for k, a, v in right if None not in (key, at, k, a) and k == key and a <= at and (tolerance is None or at - a <= tolerance)]
        best = max(near, default=(0, False, None))
        out.append((n, best[2] if best[1] else None))
    return sorted(out)


@pytest.mark.parametrize("tolerance, block", [(None, 7), (None, 1 << 16), (0, 1), (3, 3), (3, 50), (20, 20)])
def test_asof_against_all_pairs(spark, tolerance, block):
    rng = random.Random(block)
    place = lambda: rng.choice([None, *range(-60, 60)])
    left = [(rng.choice(["hot"] * 5 + ["b", None]), place(), n) for n in range(300)]
    right = [(rng.choice(["hot"] * 5 + ["b", "c", None]), place(), rng.choice([None, "x", "y"])) for _ in range(80)]
    # names that the operator uses itself, and one that both sides have
    l = spark.createDataFrame([(*r, "left") for r in left + left[:20]], "k string, at long, b int, r string")
    r = spark.createDataFrame([(*x, "right") for x in right], "k string, at long, l string, r string")
    out = asof.asof(l, r, ("k",), "at", "at", {"l": "found"}, tolerance, block)
    assert out.columns == ["k", "at", "b", "r", "found"]
    rows = out.collect()
    assert sorted((x.b, x.found) for x in rows if x.found) == [x for x in nearest(left + left[:20], right, tolerance) if x[1]]
    assert sorted(x.b for x in rows) == sorted(x[2] for x in left + left[:20]) and {x.r for x in rows} == {"left"}


def test_asof_of_empty_tables(spark):
    l = spark.createDataFrame([("a", 1), (None, None)], "k string, at long")
    r = spark.createDataFrame([("a", 1, 5)], "k string, at long, v int")
    for tolerance in (None, 2):
        assert sorted(map(tuple, asof.asof(l, r.limit(0), ("k",), "at", "at", {"v": "v"}, tolerance).collect()), key=repr) == [("a", 1, None), (None, None, None)]
        assert asof.asof(l.limit(0), r, ("k",), "at", "at", {"v": "v"}, tolerance).collect() == []
    with pytest.raises(ValueError, match="tolerance"):
        asof.asof(l, r, ("k",), "at", "at", {"v": "v"}, 10, block=5)
    with pytest.raises(ValueError, match="already"):
        asof.asof(l, r, ("k",), "at", "at", {"v": "at"})


def test_one_hot_key_is_many_tasks(spark):
    """All rows have one key: no window holds more than a block, and the plan with a tolerance has one exchange."""
    l = spark.range(40_000).select(F.lit("hot").alias("k"), F.col("id").alias("at"))
    r = spark.range(0, 40_000, 10).select(F.lit("hot").alias("k"), F.col("id").alias("at"), F.col("id").alias("v"))
    out = asof.asof(l, r, ("k",), "at", "at", {"v": "v"}, 9, block=1000)
    assert out.where("v = at - at % 10").count() == 40_000
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 1
    assert asof.asof(l, r, ("k",), "at", "at", {"v": "v"}, None, block=1000).where("v = at - at % 10").count() == 40_000


def test_offices_among_rows_are_those_of_the_text(spark):
    rng = random.Random(3)
    parts = [*["<O>王</O>", "<P>x</P>"] * 4, "<O></O>", "<O>a\nb</O>", "<P>x</P>", '<P id="1">y</P>', "<P>", "</P>", "<O>", "", "ab", "abcd", "abcde", "\n", "𠀀", "<Place>z</Place>"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(16))) for _ in range(300)]
    d = spark.createDataFrame([*enumerate(texts), (300, None)], "n int, text_content string")
    want = [(r.n, e.name, e["rank"]) for r in tags.entities_of(d).orderBy("n").collect() for e in r.entities or []]
    assert sum(w[2] is not None for w in want) > 50
    for block in (4, 1 << 16):
        # each text by itself, and all as rows of one document
        rows = tags.token_rows(d)
        assert [(r.n, r.name, r["rank"]) for r in tags.entities_of_tokens(rows, ("n",), block).orderBy("n", "start").collect()] == want
        one = rows.select(F.lit(None).cast("long").alias("doc_id"), "n", (F.col("start") + F.col("n") * 500).alias("start"), (F.col("end") + F.col("n") * 500).alias("end"), "kind", "inner")
        assert [(r.n, r.name, r["rank"]) for r in tags.entities_of_tokens(one, block=block).orderBy("start").collect()] == want


EXTRAS = ['{"page": 3}', '{"page": null, "a": {"b": 1}}', '{"page": "12"}', '{"x y": 1.5, "a": {"c": [1]}}', '{"n": NaN}', '{"n": 1, "n": 2}', None, "[1]", '{"it\'s": "q", "page": {"z": 1}}', "{}"]


def test_open_fields(spark):
    d = open_fields.open_items(spark.createDataFrame([*enumerate(EXTRAS)], "n int, extra string"))
    found = open_fields.typed_fields(d, {"page": "bigint", "x y": "double", "it's": "string"}).orderBy("n").collect()
    assert [r.page for r in found] == [3, None, 12, None, None, None, None, None, None, None]
    assert [r.page_state for r in found] == ["value", "null", "value", *["absent"] * 5, "value", "absent"]
    assert [r["x y"] for r in found] == [None] * 3 + [1.5] + [None] * 6 and found[8]["it's"] == "q"
    profile = {r.field: (r.n, r.n_null, r.kind) for r in open_fields.field_profile(d).collect()}
    assert profile == {"page": (4, 1, "VARIANT"), "a": (2, 0, "OBJECT<b: BIGINT, c: ARRAY<BIGINT>>"), "x y": (1, 0, "DECIMAL(2,1)"), "it's": (1, 0, "STRING")}
    # what the reader refuses is kept as it is
    assert {r[0] for r in d.where("n in (4, 5)").select(F.try_variant_get("extra", "$", "string")).collect()} == {EXTRAS[4], EXTRAS[5]}
    assert open_fields.field_profile(d.limit(0)).collect() == []
    with pytest.raises(ValueError, match="both quotes"):
        open_fields.field_state(F.col("extra"), "'\"")
    with pytest.raises(ValueError, match="page_state"):
        open_fields.typed_fields(d.withColumn("page_state", F.lit(1)), {"page": "int"})


def test_a_null_name_is_no_missing_name(spark):
    raw = ['[{"name":"a","title":null,"office":"o"}]', '[{"name":"a","office":"o"}]', '[{"name":"a","office":"o","title":"t"}]', '[{"name":"a"}]']
    parsed = parsing.parse_responses(spark.createDataFrame([*enumerate(raw)], "n int, raw string"))
    d = open_fields.open_items(parsing.explode_items(parsed))
    assert [r.t for r in d.select("n", open_fields.renamed_field(F.col("extra"), "office", "title").alias("t")).orderBy("n").collect()] == [None, "o", "t", None]


@pytest.mark.parametrize("bucket", [1, 16, 1 << 11])
def test_chunks_of_spans_against_all_pairs(spark, bucket):
    rng = random.Random(bucket)
    doc = lambda: rng.choice([1, 1, 1, 2, None])
    left = [(doc(), (a := rng.randrange(300)), rng.choice([None, a, a - 1, a + rng.randrange(90)]), n) for n in range(150)]
    right = [(doc(), n, (a := rng.randrange(300)), a + rng.randrange(100)) for n in range(60)]
    s = spark.createDataFrame(left + left[:5], "doc_id long, start long, end long, n int")
    c = spark.createDataFrame([(*r, "other") for r in right], "doc_id long, chunk_id int, start int, end int, n string")
    want = [
        (n, k, s0 >= c0 and s1 <= c1) for d, s0, s1, n in left + left[:5] for e, k, c0, c1 in right
        if d is not None and d == e and s1 is not None and s1 >= s0 and c1 > c0 and max(s0, c0) < min(max(s1, s0 + 1), c1)
    ]
    assert sorted((r.n, r.chunk_id, r.whole) for r in spans.chunks_of_spans(s, c, bucket).collect()) == sorted(want)


def test_a_quote_across_a_border_has_both_chunks(spark):
    pages = spark.createDataFrame([(1, 2, "  second " + "x" * 40), (1, 1, "y" * 50), (1, 3, None), (1, 4, "  "), (1, 5, "end")], "doc_id long, page_no int, text string")
    assert [(r.page_no, r["at"]) for r in spans.page_offsets(pages).orderBy("page_no").collect()] == [(1, 0), (2, 51), (5, 99)]
    chunks = chunking.chunk_pages(pages, Profile(60, 10, 1, 1.0))
    quotes = spark.createDataFrame([(1, 2, "x" * 40), (1, 1, "y" * 45), (1, 5, "absent"), (1, 9, "y"), (1, 5, ""), (2, 1, "y"), (1, 5, None)], "doc_id long, page_no int, quote string")
    placed = spans.quote_spans(quotes, pages)
    assert placed.where("start is null").count() == 5
    joined = chunking.join_pages(pages).collect()[0].text
    for r in placed.where("start is not null").collect():
        assert joined[r.start : r.end] == r.quote
    met = {}
    for r in spans.chunks_of_spans(placed, chunks).collect():
        met.setdefault(r.quote, []).append((r.chunk_id, r.whole))
    places = [(c.chunk_id, c.start, c.end) for c in chunks.collect()]
    assert {q: sorted(v) for q, v in met.items()} == {q: [(k, a <= s and e <= b) for k, a, b in places if a < e and s < b] for q, s, e in (("x" * 40, 58, 98), ("y" * 45, 0, 45))}
    assert [w for _, w in sorted(met["x" * 40])] == [True, False]  # cut at the line feed before "end", the next chunk begins in the quote

import random

import pytest
from pyspark.sql import functions as F

from scriptorium import sql
from scriptorium.config import EVENT_TYPES, Profile
from scriptorium.functions.text import normalize_text
from scriptorium.operators import chunking, parsing, segments, tags


@pytest.fixture
def named(spark):
    sql.register(spark)
    sql.register(spark)
    return spark


def rows(d):
    return sorted(map(tuple, d.collect()), key=repr)


def test_functions_are_the_operators(named):
    rng = random.Random(5)
    parts = ["word ", "。", "○", " \t", "\r\n\r\n\r\n", "　", "\x85", "<O>王</O>", "<P>x</P>", "𠀀", "a\\b'c"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(600))) for _ in range(60)]
    d = named.createDataFrame([*enumerate(texts), (60, None), (61, "")], "doc_id long, text string")
    assert rows(named.sql("SELECT doc_id, normalized_text(text) FROM {d}", d=d)) == rows(d.select("doc_id", normalize_text(F.col("text"))))
    cut = named.sql("SELECT d.doc_id, c.* FROM (SELECT doc_id, normalized_text(text) AS t FROM {d}) d, LATERAL text_chunks(d.t, 300, 20) c", d=d)
    chunks = chunking.chunk_documents(d, Profile(300, 20, 1, 1.0))
    assert rows(cut.select("doc_id", "chunk_id", "chunk_text", "start", "end")) == rows(chunks) and chunks.count() > 100
    split = named.sql("SELECT c.doc_id, c.chunk_id, s.* FROM (SELECT doc_id, chunk_id, normalized_text(chunk_text) AS t FROM {c}) c, LATERAL text_segments(c.t, 2) s", c=chunks)
    assert rows(split) == rows(segments.marker_segments(chunks, True, 2)) and split.where("seg_id > 0").count() > 50
    found = named.sql("SELECT d.doc_id, t.* FROM {d} d, LATERAL text_tokens(d.text) t", d=d)
    assert rows(found) == rows(tags.token_rows(d, "text")) and found.count() > 50


def test_pages_of_a_partitioned_table(named):
    rng = random.Random(6)
    page = lambda: rng.choice([None, "", " ", "".join(rng.choices(["字", "句。", "ab ", "\n"], k=rng.randrange(400)))])
    # two pages of one number, a key without a value, another column
    pages = [(rng.choice(["x", "y", None]), n % 73, page(), "other") for n in range(80)]
    d = named.createDataFrame(pages, "doc_id string, page_no int, text string, chunk_id string").repartition(5)
    want = chunking.chunk_pages(d, Profile(270, 10, 1, 1.0)).select("doc_id", "chunk_id", "chunk_text")
    call = "SELECT * FROM page_chunks(TABLE(SELECT doc_id, page_no, normalized_text(text) AS text, chunk_id FROM {d}), 270, 10)"
    assert rows(named.sql(call, d=d)) == rows(want) and want.count() > 20
    assert rows(named.sql(call, d=d.limit(0))) == []


def test_answers(named):
    raw = ['[{"name":"a","page":1}]', "no", "", None, "[]", '{"items": [{"name":"a","action":"b","quote":"c","event_type":"Death"}]}']
    d = named.createDataFrame([*enumerate(raw)], "n int, raw string")
    for form, allowed in (("lenient", None), ("structured", EVENT_TYPES)):
        parsed = parsing.parse_responses(d, allowed)
        got = named.sql(f"SELECT d.n, i.* FROM {{d}} d, LATERAL answer_items(d.raw, '{form}') i", d=d)
        items = parsing.explode_items(parsed.where("parsed_ok")).drop("raw")
        assert rows(got.where("parsed_ok").drop("parsed_ok")) == rows(items) and items.count() > 0
        assert rows(got.where("not parsed_ok").select("n")) == rows(parsed.where("not parsed_ok").select("n"))


@pytest.mark.parametrize(
    "call, why",
    [
        ("text_chunks('a', 0, 0)", "size has no such value"), ("text_chunks('a', 10, 10)", "overlap has no such value"), ("text_chunks('a', 90, 20)", "overlap has no such value"), ("text_chunks(1, 10, 1)", "must be a text"),
        ("page_chunks(TABLE(SELECT 1 AS doc_id), 10, 1)", "doc_id, page_no and text"), ("answer_items('a', 'other')", "form has no such value"), ("text_segments('a', NULL)", "per_request"),
    ],
)
def test_wrong_arguments_stop_the_analysis(named, call, why):
    with pytest.raises(Exception, match=why):
        named.sql(f"SELECT * FROM {call}")

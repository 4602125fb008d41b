import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.config import API, EVENT_TYPES, LOCAL, Profile
from scriptorium.functions import text as tx
from scriptorium.operators import chunking, evidence, items, parsing, phrases, segments, tags, training
from scriptorium.plans import pipelines
from scriptorium.plans.extractors import Retrying, extract
from scriptorium.sources import readers, sinks
from scriptorium.streaming.chunks import advance, finish


def values(spark, inputs, expression):
    rows = [(k, v) for k, v in enumerate(inputs)]
    return [r[1] for r in spark.createDataFrame(rows, "k int, x string").select("k", expression(F.col("x"))).orderBy("k").collect()]


def test_normalize_text(spark):
    assert values(spark, ["a\r\nb\rc", "\t a \t b", "a\n\n\n\nb", "　 a b ", "", None, "\x1c\x85x\x1f"], tx.normalize_text) == ["a\nb\nc", "a b", "a\n\nb", "a b", "", None, "x"]


def test_normalize_evidence(spark):
    assert values(spark, ["“A”  ’b　c‘", " X\n\ty "], tx.normalize_evidence) == ["\"a\" 'b c‘", "x y"]


def test_strip_tags(spark):
    assert values(spark, ["a<b\nc>d", "<>x<", "<i>y</i>"], tx.strip_tags) == ["ad", "<>x<", "y"]


@pytest.mark.parametrize(
    "text, size, want",
    [("", 9, 9), ("abcdefghij", 9, 9), ("ab。defghij", 9, 3), ("abcdefgh。j", 9, 9), ("。bcdefghij", 9, 9), ("ab.!?;ghij", 9, 9), ("a；b！c\nd？ij", 9, 8)],
)
def test_find_good_cut(text, size, want):
    assert chunking.find_good_cut(text, 0, size) == want


def test_cut_mark_outside_the_window():
    text = "a" * 600 + "。" + "b" * 400
    assert chunking.find_good_cut(text, 0, 900) == 900  # the mark is at 600, the window starts at 650
    assert chunking.find_good_cut("a" * 650 + "。" + "b" * 400, 0, 900) == 651
    assert chunking.find_good_cut("a" * 899 + "。" + "b", 0, 900) == 900


@pytest.mark.parametrize("n, chunks", [(0, 0), (1, 1), (899, 1), (900, 2), (901, 2), (1679, 2), (1680, 3)])
def test_chunk_counts(n, chunks):
    assert len(chunking.chunks_of("x" * n, 900, 120)) == chunks


def test_tail_is_always_emitted():
    assert [c[:2] for c in chunking.chunks_of("x" * 900, 900, 120)] == [(0, 900), (780, 900)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab 。\n𠀀", max_size=4000))
def test_chunks_cover_the_text(text):
    got = chunking.chunks_of(text, 900, 120)
    assert all(len(c[2]) <= 900 for c in got)
    at = 0
    for start, end, piece in got:
        assert text[at:start].strip() == "" or start <= at
        assert text[start:end].strip() == piece
        at = end
    assert text[at:].strip() == ""


def test_chunk_pages_joins_and_numbers(spark):
    pages = spark.createDataFrame([(1, 2, "b"), (1, 0, " a "), (1, 1, " \n"), (2, 0, None), (3, 0, "x" * 900)], "doc_id long, page_no int, text string")
    got = sorted((r.doc_id, r.chunk_id, r.chunk_text, r.start) for r in chunking.chunk_pages(pages, LOCAL).collect())
    assert got == [(1, 0, "a\nb", 0), (3, 0, "x" * 900, 0), (3, 1, "x" * 120, 780)]


def test_page_range_counts_before_empty_pages_go(spark):
    pages = spark.createDataFrame([(1, 0, "a"), (1, 1, ""), (1, 2, "c"), (1, 3, "d"), (1, 4, None)], "doc_id long, page_no int, text string")
    assert [r.page_no for r in readers.page_range(pages, 1, 2).collect()] == [2]
    assert sorted(r.page_no for r in readers.page_range(pages, -5).collect()) == [0, 2, 3]
    assert [(p.page, p.text) for p in readers.page_store(pages).first().pages] == [(1, "a"), (2, ""), (3, "c"), (4, "d"), (5, "")]


def segment_texts(spark, text, **options):
    d = spark.createDataFrame([(1, 0, text)], "doc_id long, chunk_id int, chunk_text string")
    return [r.seg_text for r in segments.marker_segments(d, **options).orderBy("seg_id").collect()]


def test_segments(spark):
    assert segment_texts(spark, "h ○a") == ["h ○a"]
    assert segment_texts(spark, "no marker", enabled=True) == ["no marker"]
    assert segment_texts(spark, "○a ○b", enabled=True) == ["○a\n○b"]
    # a line after an item goes to the head
    assert segment_texts(spark, "head ○ a\nmore ○ b", enabled=True) == ["head\nmore\n○a\n○b"]
    seven = "h" + "".join(f"○{k}" for k in range(7))
    assert segment_texts(spark, seven, enabled=True) == ["h\n" + "\n".join(f"○{k}" for k in range(6)), "h\n○6"]
    assert len(segment_texts(spark, "h" + "○x" * 6, enabled=True)) == 1


def spelled(text):
    """The tag rule as a state machine."""
    import re

    out, rank, end = [], None, 0
    for m in re.finditer(r"(<O>(.*?)</O>)|(<P.*?>(.*?)</P>)", text):
        if m[1]:
            rank, end = m[2], m.end()
        else:
            out.append((m[4], rank if rank and m.start() - end < 5 else None))
            if out[-1][1]:
                rank = None
    return out


def test_tags_match_the_state_machine(spark):
    rng = random.Random(1)
    parts = ["<O>尚书</O>", "<O></O>", "<P>张三</P>", '<P id="1">李四</P>', "<Place>京</Place>", "x", "xxxx", "\n", "\r", "<P>a<O>b</O></P>", "<O>a\nb</O>", "<", ">"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(600)]
    got = values(spark, texts, lambda x: tags.tag_entities("x"))
    # a person whose own text takes the rank rule's place is settled by the token before it
    assert [[(e.name, e.rank) for e in r] for r in got] == [spelled(t) for t in texts]


@pytest.mark.parametrize(
    "raw, want",
    [
        (None, (False, [])), ("", (False, [])), ("  ", (False, [])), ("[]", (True, [])), ("5", (False, [])), ('"a"', (False, [])),
        ('[{"name":"x"}]', (True, ["x"])), ('```json\n[{"name":"x"}]\n```', (True, ["x"])), ('```JSON[{"name":"x"}]```', (True, ["x"])), ('```\n{"name":"x"}\n```', (True, ["x"])),
        ('``` [{"name":"x"}]', (True, ["x"])), ('well [{"name":"x"}] so', (True, ["x"])), ('[{"name":"x"}] tail', (False, [])), ('{"a":1}\n{"b":2}', (False, [])),
        ('[{"name":"x"},5,null,{"name":null},{"name":""},{"name":"[]"},{"name":"  "}]', (True, ["x", "  "])), ('[{"official_name":"o"}]', (True, ["o"])), ('[{"official_name":"o","name":null}]', (True, [])),
        ('[{"name":NaN}]', (True, ["NaN"])), ('{"name":"a","name":"b"}', (True, ["b"])), ("[{'name':'x'}]", (False, [])), ('[{"name":"x"', (False, [])),
    ],
)
def test_parse_json_list(raw, want):
    ok, found = parsing.parse_json_list(raw)
    assert (ok, [i["name"] for i in found]) == want


def test_parse_keeps_unknown_keys():
    assert json.loads(parsing.parse_json_list('[{"name":"x","_reasoning":"r","n":1}]')[1][0]["extra"]) == {"_reasoning": "r", "n": 1}


def test_parse_structured():
    good = {"name": "a", "rank": None, "action": "b", "event_type": "Death", "quote": "q"}
    parse = lambda d: parsing.parse_structured(json.dumps(d), EVENT_TYPES)
    assert parse({"items": [good]})[0] and len(parse({"items": [good]})[1]) == 1
    assert parse({"items": [good, good | {"event_type": "Gift"}]}) == (False, [])
    assert parse({"items": [{k: v for k, v in good.items() if k != "quote"}]}) == (False, [])
    assert parse({}) == (True, []) and parse([1]) == (True, []) and parsing.parse_structured(" ", EVENT_TYPES) == (True, [])
    assert parsing.parse_structured("{", EVENT_TYPES) == (False, [])


def test_literal_cells():
    assert parsing.literal_texts("[(1, 's', 'a'), (2, 's'), ('x', None, 'b')]") == [("1", "s", "a"), ("x", "None", "b")]
    assert parsing.literal_texts("[(1, 's', 'a'), 5, (1, 's', 'b')]") == [("1", "s", "a")]
    assert parsing.literal_texts("N/A") == parsing.literal_texts(None) == parsing.literal_texts("[(1,") == []


ITEM = "doc_id long, chunk_id int, seg_id int, item_idx int, name string, rank string, action string, event_type string, time string, quote string"


def item_rows(spark, rows):
    base = dict(doc_id=1, chunk_id=0, seg_id=0, item_idx=0, name="n", rank=None, action="a", event_type="Other", time=None, quote="quote")
    names = [c.split()[0] for c in ITEM.split(", ")]
    return spark.createDataFrame([tuple((base | r)[n] for n in names) for r in rows], ITEM)


def test_normalize_items(spark):
    d = item_rows(spark, [dict(name=n, item_idx=k) for k, n in enumerate([" x ", "", "　", None, "A孙B孙C", "孙传庭", "公孙胜", "张皇后"])])
    assert [r.name for r in items.normalize_items(d).orderBy("item_idx").collect()] == ["x", "C", "孙传庭", "胜", "张皇后"]
    assert [r.name for r in items.normalize_items(d, exclude_title_like=True, kinship=False).orderBy("item_idx").collect()] == ["x", "A孙B孙C", "孙传庭", "公孙胜"]
    d = item_rows(spark, [dict(quote="q" * n + " ", rank=r, time=t) for n, r, t in ((4, "a", "b"), (5, "", "null"), (60, "null", " "), (61, "a", "b"))])
    assert sorted((len(r.quote), r.rank, r.time) for r in items.normalize_items(d).collect()) == [(6, None, None), (61, None, " ")]


def test_grounding_takes_the_quote_as_it_stands(spark):
    d = item_rows(spark, [dict(quote=q) for q in ("seen", " seen", "absent", None)]).withColumn("seg_text", F.lit("it was seen"))
    assert sorted(r.quote for r in items.ground(d).collect()) == [" seen", "seen"]


def test_dedup_is_first_wins_and_idempotent(spark):
    d = item_rows(spark, [dict(chunk_id=2, rank=""), dict(chunk_id=1), dict(chunk_id=1, item_idx=1, name=" n "), dict(chunk_id=0, quote="other"), dict(doc_id=0, chunk_id=9, action="b")])
    once = items.dedup(d)
    key = lambda r: (r.doc_id, r.chunk_id, r.item_idx)
    assert sorted(map(key, once.collect())) == [(0, 9, 0), (1, 0, 0), (1, 1, 0)]
    twice = item_rows(spark, [dict(doc_id=1), dict(doc_id=2)])
    assert items.dedup(twice).count() == 2 and [r.doc_id for r in items.dedup(twice, scope=()).collect()] == [1]
    assert sorted(items.dedup(twice, scope=()).collect()) == sorted(items.dedup_window(twice, ()).select(twice.columns).collect())
    assert sorted(once.collect()) == sorted(items.dedup(once).collect()) == sorted(items.dedup_window(d).select(d.columns).collect())


def test_evidence(spark):
    pages = spark.createDataFrame([(1, 1, "He said “Yes” today"), (1, 2, None)], "doc_id long, page_no int, text string")
    rows = [(0, 1, "said", None), (1, 1, 'SAID  "yes"', None), (2, 1, "gone", None), (3, 0, "said", None), (4, 3, "said", None), (5, None, "said", None), (6, 2, "", None), (7, 1, None, "He"), (8, 1, "", "today")]
    d = spark.createDataFrame([(1, p, e, t, k) for k, p, e, t in rows], "doc_id long, page int, evidence string, text string, k int")
    got = {r.k: (r.status, r.reason, r.start, r.end, r.match) for r in evidence.validate_evidence(d, pages).collect()}
    no_page = ("rejected", "invalid page", None, None, None)
    assert got == {0: ("accepted", None, 3, 7, None), 1: ("accepted", None, None, None, "normalized"), 2: ("rejected", "not found", None, None, None), 3: no_page, 4: no_page, 5: no_page, 6: ("accepted", None, 0, 0, None), 7: ("accepted", None, 0, 2, None), 8: ("accepted", None, 14, 19, None)}
    accepted, rejected = pipelines.validation(d, pages)
    assert (accepted.count(), rejected.count()) == (5, 4)


def test_training_examples_and_completions(spark):
    d = spark.createDataFrame([(1, '<O>"少"师</O><P>蹇义</P>卒'), (2, "none")], "id int, text_content string")
    e = training.training_examples(d).collect()
    assert [(r.id, r.input) for r in e] == [(1, '"少"师蹇义卒')]
    assert e[0].output == json.dumps([{"name": "蹇义", "rank": '"少"师', "event_type": "N/A", "action": "N/A"}], ensure_ascii=False)
    p = training.prompt_completion(training.training_examples(d)).first()
    assert p.text == training.INSTRUCTION + "\n\n" + e[0].input
    with pytest.raises(Exception, match="has no output"):
        training.prompt_completion(spark.createDataFrame([("a", "b", None)], "instruction string, input string, output string")).collect()


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11])
def test_split_sizes(spark, n):
    d = spark.range(n).select("id", F.lit("x").alias("text"))
    train, valid, test = training.split(d, "id")
    assert (train.count(), valid.count(), test.count()) == (n, n - int(n * 0.9), n - int(n * 0.9))
    assert training.split(d, "id", leak_free=True)[0].count() == int(n * 0.9)


def test_phrases_take_the_longest(spark):
    d = spark.createDataFrame([("后来皇后", None)], "input string, instruction string")
    r = phrases.convert_phrases(d, {"后": "後", "皇后": "皇后", "来": "來"}).first()
    assert r.input == "後來皇后" and r.instruction is None


@pytest.mark.parametrize("failures, calls", [(0, 1), (2, 3), (3, 4), (5, 6), (6, 6)])
def test_retry(failures, calls):
    made, slept = [], []

    def call(model, text):
        made.append(model)
        if len(made) <= failures:
            raise ValueError(f"failure {len(made)}")
        return "ok"

    r = Retrying(call, ("small", "large", "small"), sleep=slept.append)
    if failures == 6:
        with pytest.raises(ValueError, match="failure 6"):
            r.generate("x")
    else:
        assert r.generate("x") == "ok"
    assert len(made) == calls and made[:3] == ["small"] * min(3, calls)
    assert slept[:3] == pytest.approx([0.6, 1.2, 1.8][: min(failures, 3)])


class Fake:
    def generate(self, text):
        if "boom" in text:
            raise RuntimeError("boom")
        return '[{"name":"n","quote":"' + text[:6] + '"}]' if "good" in text else '[{"name":'


def test_local_pipeline_isolates_failures(spark, tmp_path):
    pages = spark.createDataFrame([(1, 0, "good text"), (2, 0, "boom"), (3, 0, "truncated")], "doc_id long, page_no int, text string")
    good, bad = pipelines.local_extraction(pages, Fake)
    assert [(r.doc_id, r.chunk_id, r.name) for r in good.collect()] == [(1, 0, "n")]
    assert sorted((r.doc_id, r.raw) for r in bad.collect()) == [(2, "[EXCEPTION] boom"), (3, '[{"name":')]
    sinks.write_jsonl(good, str(tmp_path / "out"))
    line = json.loads(spark.read.text(str(tmp_path / "out")).first().value)
    assert line["rank"] is None and line["name"] == "n"
    sinks.write_dead_letters(bad, str(tmp_path / "bad"), cap=1)
    sinks.write_chunks(chunking.chunk_pages(pages, LOCAL), str(tmp_path / "chunks"))
    assert spark.read.text(str(tmp_path / "chunks")).count() == 3
    files = list((tmp_path / "bad").glob("doc_id=*/chunk_id=*/*.txt"))
    assert [f.read_text().rstrip("\n") for f in files] == ["=== CHUNK TEXT ===\nboom\n\n=== RAW MODEL RESPONSE ===\n[EXCEPTION] boom"]


class Counting:
    """Leaves a file for each call."""

    folder = ""

    def __init__(self, folder):
        self.folder = folder

    def generate(self, text):
        import uuid
        from pathlib import Path

        (Path(self.folder) / uuid.uuid4().hex).touch()
        return '[{"name": "a\\ud800"}]' if "odd" in text else "\ud800 no JSON"


def test_each_chunk_is_sent_once_and_odd_answers_are_rows(spark, tmp_path):
    (folder := tmp_path / "calls").mkdir()
    pages = spark.createDataFrame([(k, 0, "odd" if k % 2 else "even") for k in range(10)], "doc_id long, page_no int, text string")
    good, bad = pipelines.local_extraction(pages, lambda where=str(folder): Counting(where))
    assert {r.name for r in good.collect()} == {"a\ufffd"} and {r.raw for r in bad.collect()} == {"\ufffd no JSON"}
    assert good.count() == bad.count() == 5 and len(list(folder.iterdir())) == 10

    class Numbers:
        def generate(self, text):
            return 5

    assert extract(pages, Numbers, "text").where("raw is null and error like '%no text%'").count() == 10


def test_chat_service_prompts_retries_and_falls_back(monkeypatch):
    from scriptorium.plans import extractors

    asked, waited = [], []
    whole = '{"items": []}'

    def answer(self, text):
        asked.append(self.body(text))
        if self.body(text)["model"] == "small":
            raise TimeoutError
        return whole if len(asked) > 5 else '{"items": [{'

    monkeypatch.setattr(extractors.HttpExtractor, "generate", answer)
    service = extractors.chat_service("http://x", ("small", "large"), API, sleep=waited.append)
    assert service.generate('[{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]') == whole
    assert [a["model"] for a in asked] == ["small"] * 3 + ["large"] * 3 and len(waited) == 5
    assert [m["role"] for m in asked[0]["messages"]] == ["system", "user"]


GOLDEN = [
    ("宣德九年，少师蹇义卒。", {"name": "蹇义", "rank": "少师", "event_type": "Death", "action": "去世", "time": "宣德九年"}),
    ("命行在工部尚书李友直提督供应柴炭。", {"name": "李友直", "rank": "行在工部尚书", "event_type": "Appointment", "action": "提督供应柴炭", "time": None}),
    ("升行在监察御史程富为行在大理寺左少卿", {"name": "程富", "rank": "行在监察御史", "event_type": "Appointment", "action": "升为行在大理寺左少卿", "time": "丁亥"}),
]


class Golden:
    """Answers the framed golden texts as printed."""

    def generate(self, prompt):
        return next(json.dumps([item], ensure_ascii=False) for text, item in GOLDEN if prompt == f"指示\n\n【输入文本】:\n{text}\n\n【输出 JSON List】:")


def test_golden_records(spark):
    pages = spark.createDataFrame([(k, 0, t) for k, (t, _) in enumerate(GOLDEN)], "doc_id long, page_no int, text string")
    good, bad = pipelines.local_extraction(pages, Golden, system="指示")
    assert {r.doc_id: {k: r[k] for k in ("name", "rank", "event_type", "action", "time")} for r in good.collect()} == {k: item for k, (_, item) in enumerate(GOLDEN)}
    assert bad.count() == 0


def test_chunk_lookup(spark):
    pages = spark.createDataFrame([(1, 0, "one"), (2, 0, "two")], "doc_id long, page_no int, text string")
    keys = spark.createDataFrame([(1, 0, "x"), (2, 0, "y"), (2, 7, "z")], "doc_id long, chunk_id int, name string")
    got = chunking.chunk_lookup(keys, chunking.chunk_pages(pages, LOCAL))
    assert {(r.name, r.chunk_text) for r in got.collect()} == {("x", "one"), ("y", "two"), ("z", None)}


def test_script_conversion_takes_single_characters_only(spark):
    d = spark.createDataFrame([("后宫x",)], "t string")
    assert d.select(training.convert_script(F.col("t"), {"x": "", "后": "後"}).alias("t")).first().t == "後宫"
    with pytest.raises(ValueError):
        training.convert_script(F.col("t"), {"ab": "c"})


def test_extract_keeps_rows_and_overlaps_calls(spark):
    d = spark.createDataFrame([(k, f"good {k}" if k % 2 else "boom") for k in range(9)], "k int, seg_text string")
    got = {r.k: (r.raw is None, r.error) for r in extract(d, Fake, threads=4).collect()}
    assert got == {k: (False, None) if k % 2 else (True, "[EXCEPTION] boom") for k in range(9)}


def test_api_pipeline(spark):
    class Service:
        def generate(self, text):
            return json.dumps({"items": [{"name": " a孙b ", "rank": "null", "action": "x", "event_type": "Death", "time": "", "quote": text[:8]}] * 2})

    pages = spark.createDataFrame([(1, 0, "quoted text here"), (2, 0, "quoted text here")], "doc_id long, page_no int, text string")
    got = pipelines.api_extraction(pages, Service, Profile(API.chunk_size, API.overlap, 10, 1.0)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.item_idx, r.name, r.rank, r.time, r.quote) for r in got] == [(1, 0, "b", None, None, "quoted t"), (2, 0, "b", None, None, "quoted t")]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab。 \n", max_size=1500), max_size=8), st.randoms())
def test_streaming_is_the_batch_form(pages, rng):
    import re

    clean = [re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", p)).strip() for p in pages] + [""]
    arrived = [(k, p, k == len(clean) - 1) for k, p in enumerate(clean)]
    rng.shuffle(arrived)
    state, out = {"buffer": "", "chunk": 0, "page": 0, "waiting": {}, "done": False}, []
    while arrived:
        out += advance(state, [arrived.pop() for _ in range(min(len(arrived), 3))], 900, 120)
    joined = "\n".join(p for p in clean if p)
    assert out == list(enumerate(c[2] for c in chunking.chunks_of(joined, 900, 120)))


def test_streams_end_without_their_last_page():
    state = {"buffer": "", "chunk": 0, "page": 0, "waiting": {}, "done": False}
    out = advance(state, [(0, "first", False), (2, "third", False), (5, "sixth", False)], 900, 120) + finish(state, 900, 120)
    assert out == [(0, "first\nthird\nsixth")] and state["done"]
    assert advance(state, [(6, "late", True)], 900, 120) == [] and finish(state, 900, 120) == []


def test_csv_and_jsonl_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Related Texts,other\n"[(1, \'s\', \'<P>x</P> ""q"" \nline\')]",1\nN/A,2\n,3\n')
    d = readers.tagged_csv(spark, str(tmp_path / "a.csv"))
    assert [r["Related Texts"] is None for r in d.collect()] == [False, True, True]
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    assert sorted(r.a for r in readers.jsonl(spark, str(tmp_path / "b.jsonl"), "a int").collect()) == [1, 2]
    assert readers.lines(spark, str(tmp_path / "b.jsonl")).count() == 4
    assert [r.a for r in readers.peek(readers.jsonl(spark, str(tmp_path / "b.jsonl"), "a int"), 1, "a").collect()] == [1]


def test_pdf_pages_with_a_decoder(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"one|two")
    (tmp_path / "bad.pdf").write_bytes(b"\xff")

    def decode(content, start, most):
        pages = content.decode().split("|")
        return pages[start:] if most is None else pages[start : start + most]

    got = readers.pdf_pages(spark, str(tmp_path), decode)
    assert sorted((r.page_no, r.text) for r in got.where("error is null").collect()) == [(0, "one"), (1, "two")]
    assert [(r.doc_id[-7:], r.page_no, r.error[:18]) for r in got.where("error is not null").collect()] == [("bad.pdf", None, "UnicodeDecodeError")]
    assert [(r.page_no, r.text) for r in readers.page_range(readers.pdf_pages(spark, str(tmp_path), decode, 1, 1)).collect()] == [(1, "two")]


def test_jsonl_roundtrip_writes_and_reads_whole_texts(spark, tmp_path, monkeypatch):
    from scriptorium.plans import queries
    from scriptorium.sources import readers

    texts = ["x" * 40 + '\n"quoted" \\ \t\r\u2028 é𠀀', None, "", "line\n" * 20_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    read, seen = readers.jsonl, []
    monkeypatch.setattr(readers, "jsonl", lambda *a: seen.append(read(*a)) or seen[-1])
    shown = {r.doc_id: r.quote for r in queries.jsonl_roundtrip(spark, str(tmp_path)).collect()}
    assert {r.doc_id: r.quote for r in seen[0].collect()} == dict(enumerate(texts))
    assert shown == dict(enumerate(texts))

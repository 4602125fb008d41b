import json
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.__main__ import main
from scriptorium.operators import phrases
from scriptorium.operators.parsing import strict_object
from scriptorium.sources import readers


def by_hand(text, table):
    out, at = [], 0
    while at < len(text):
        best = max((k for k in table if k and text.startswith(k, at)), key=len, default=None)
        out.append(text[at] if best is None else table[best])
        at += 1 if best is None else len(best)
    return "".join(out)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text("abc𠀀后", max_size=5), st.text("xyz漢", max_size=3), max_size=30), st.lists(st.one_of(st.none(), st.text("abc𠀀后 \n", max_size=60)), max_size=8))
def test_phrases_against_every_place(table, texts):
    trie = phrases.PhraseTable(table)
    assert trie.convert(texts) == [None if t is None else by_hand(t, table) for t in texts]
    for t in texts:
        parts, at = [], 0
        for f in trie.taken(t or ""):
            parts += [(t or "")[at : f["at"]], f["replacement"]]
            at = f["at"] + f["size"]
        assert "".join([*parts, (t or "")[at:]]) == by_hand(t or "", table)


def test_many_phrases_take_no_longer_than_few():
    rng = random.Random(1)
    letters = [chr(0x4E00 + k) for k in range(3000)]
    word = lambda: "".join(rng.choices(letters, k=rng.choice([2, 3, 4, 7])))
    many = {word(): "x" for _ in range(50_000)}
    pieces = letters[:500] + list(many)[:50]
    text = "".join(rng.choices(pieces, k=200_000))
    few = dict(list(many.items())[:2])
    took = []
    for table in (few, many):
        trie = phrases.PhraseTable(table)
        began = time.perf_counter()
        out = trie.convert([text])[0]
        took.append(time.perf_counter() - began)
    assert len(out) < len(text) and took[1] < took[0] + 1
    assert phrases.PhraseTable(many).convert([text[:200]])[0] == by_hand(text[:200], many)


def test_a_dictionary_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr(phrases, "MAX_TABLE_BYTES", 5_000_000)
    with pytest.raises(ValueError, match="bound is 5000000"):
        phrases.PhraseTable({f"word{k}": "x" * 100 for k in range(5_000)})
    rows = spark.range(20_000).select(F.concat(F.lit("phrase"), "id").alias("phrase"), F.repeat(F.lit("x"), F.lit(100)).alias("replacement"))
    with pytest.raises(ValueError, match="characters"):
        phrases.phrase_dictionary(rows)


def test_dictionary_from_a_table(spark):
    rows = spark.createDataFrame([("皇后", "皇后"), ("后", "後"), ("后", "后"), (None, "x"), ("y", None)], "phrase string, replacement string")
    d = spark.createDataFrame([("皇后在后", None, 1), (None, "后后", 2)], "input string, output string, n int")
    assert [tuple(r) for r in phrases.convert_phrases(d, rows).collect()] == [("皇后在后", None, 1), (None, "后后", 2)]
    rows = rows.where("replacement <> '后'")
    assert [tuple(r) for r in phrases.convert_phrases(d, rows).collect()] == [("皇后在後", None, 1), (None, "後後", 2)]


LINES = [
    '{"a": "x", "n": 1}', '  {"a": null}\t', "", "   ", "{'a': 'x'}", '{"a": "x"} tail', '[{"a": "x"}, {"a": "y"}]', '{"a": NaN}', '{"a": 5}', '{"n": "5"}', '{"n": true}',
    '{"n": 2.0}', '{"n": 9223372036854775808}', '{"a": "x"', "5", "null", '{"a": "first", "a": "last", "b": [1, {}]}', '{"other": 1}', '{"f": 1, "l": [{"k": "v"}], "m": {"z": 1}}', '{"l": ["v"]}', '{"a": "\\ud800"}',
]


def test_lines_are_strict(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("\n".join(LINES) + "\n", encoding="utf-8")
    found = readers.jsonl(spark, str(tmp_path / "x.jsonl"), "a string, n long, f double, l array<struct<k:string>>, m map<string,int>").collect()
    none = (None,) * 4
    want = [("x", 1, None, None, None), (None, *none), ("last", *none), (None, *none), (None, None, 1.0, [("v",)], {"z": 1}), ("�", *none)]
    assert [(r.a, r.n, r.f, None if r.l is None else [tuple(x) for x in r.l], r.m) for r in found] == want
    assert [strict_object(x) is not None for x in LINES] == [k in (0, 1, 8, 9, 10, 11, 12, 16, 17, 18, 19, 20) for k in range(len(LINES))]


def test_convert_keeps_all_fields(spark, tmp_path):
    rows = [{"id": 7, "output": "后", "input": "皇后来", "tags": ["后", 1], "instruction": "后"}, {"input": 5, "x": None}, {"instruction": "后"}]
    (tmp_path / "in.jsonl").write_text("\n".join([*(json.dumps(r, ensure_ascii=False) for r in rows), "not json", ""]), encoding="utf-8")
    (tmp_path / "p.json").write_text(json.dumps({"后": "後", "皇后": "皇后", "来": "來"}), encoding="utf-8")
    main(["convert", "--examples", str(tmp_path / "in.jsonl"), "--phrases", str(tmp_path / "p.json"), "--out", str(tmp_path / "out")])
    found = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert found == [{"id": 7, "output": "後", "input": "皇后來", "tags": ["后", 1], "instruction": "后"}, {"input": 5, "x": None}, {"instruction": "后"}]
    assert list(found[0]) == list(rows[0])

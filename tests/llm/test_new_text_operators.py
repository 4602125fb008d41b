import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import infill, quality_model, repair
from scriptorium.llm.queries import queries

# --- fill-in-the-middle ---


def infill_by_hand(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (doc_id, n, "plain", None, None, text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(tokens[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if h[3] % 100 < 80:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_infill_against_brute_force_and_back(spark):
    rng = random.Random(12)
    parts = [" ", "\n", "\t\r\n", "\x0b", "a", "<", "<S", "<P", "S>", ">", "<M", "word", "ü", "漢字", "𠀀", "\x00", "\x85", " ", "　", "é"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 3, 30]))) for _ in range(600)]
    texts += [None, "", "   ", "\n", "<P>", "x <S> y", "a<M>", "word " * 400_000, "x" * 300_000]
    rows = [(k, t) for k, t in enumerate(texts)] + [(7, texts[7]), (7, "another text of this id"), (None, "no id"), (None, None)]
    d = infill.infill(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit(1), "form": F.lit("x"), "output": F.lit("y")}))
    found = [tuple(r) for r in d.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1]), r[-1] or "")
    assert sorted(found, key=key) == sorted((infill_by_hand(*r) for r in rows), key=key)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}
    back = d.select("doc_id", infill.restore(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in back) == sorted((i is None, i or 0, t or "") for i, t in rows)


def test_infill_of_an_empty_table_and_other_shares(spark):
    assert infill.infill(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    d = spark.createDataFrame([(k, "one two three four") for k in range(300)], "doc_id long, text string")
    forms = lambda **x: {r.form for r in infill.infill(d, **x).select("form").collect()}
    assert forms(fim_percent=0) == {"plain"}
    assert forms(fim_percent=100, spm_percent=100) == {"spm"}
    assert forms(fim_percent=100, spm_percent=0) == {"psm"}


# --- conversation repair ---


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        for _ in range({0: 0, 3: 2}.get(kind, 1)):
            yield conv, turn, role, text


def repaired_by_hand(rows):
    """Best first over all edit strings: (cost, audit) in order, so the first whole one is the answer."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, fault = set(), []
    for _, _, role, text in rows:
        core = text.strip(" \t\n\x0b\f\r")
        fault.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[2][:1] for r in rows]
    turns = [r[1] for r in rows if r[1] is not None]
    counts = [max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[fault.count(f) for f in ("blank", "duplicate", "truncated")]]
    counts.append(sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])))
    heap, done = [(0, "", 0, ())], set()
    while heap:
        cost, audit, at, out = heapq.heappop(heap)
        said = "".join(r[:1] for r, _ in out)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", said):
            return (*counts, cost, audit, "\n".join(f"{r}:{t}" for r, t in out))
        state = (at, 0 if not said else 1 if said == "s" else said[-1])
        if state in done:  # the first to come is the least
            continue
        done.add(state)
        ok = lambda role: bool(re.fullmatch("s|s?(ua)*u?", said + role[:1]))  # noqa: E731, B023
        for role in ("user", "assistant"):
            if ok(role):
                heapq.heappush(heap, (cost + 2, audit + "I", at, (*out, (role, ""))))
        if at < len(rows):
            _, _, role, text = rows[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, out))
            if fault[at] not in ("blank", "duplicate"):
                cut = fault[at] == "truncated"
                if role[:1] in "sua" and role and ok(role):
                    heapq.heappush(heap, (cost + cut, audit + "K", at + 1, (*out, (role, text))))
                for other in ("user", "assistant"):
                    if ok(other):
                        heapq.heappush(heap, (cost + 2 + cut, audit + "R", at + 1, (*out, (other, text))))
    raise AssertionError("no repair")


@pytest.mark.parametrize("segment", [1, 2, 5, 512])
def test_repair_against_brute_force(spark, segment):
    rng = random.Random(13)
    roles, said = ["user", "assistant", "system", "tool", "", None, "ursa", "Assistant"], ["Yes.", "no", "What?", "", "  \n", None, "Done! \t", "x.y", "ok　"]
    rows = []
    for conv in [*range(150), None]:
        usual = rng.random() < 0.5
        for turn in range(rng.choice([0, 1, 2, 4, 9, 25])):
            role = ("user", "assistant")[turn % 2] if usual and rng.random() < 0.9 else rng.choice(roles)
            rows.append((conv, rng.choice([turn, turn, turn, None, 3 * turn]), role, rng.choice([f"Said {rng.random()}.", rng.choice(said)])))
    rows += rows[:40]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"cost": F.lit("x"), "place": F.lit(0), "code": F.lit(1)})
    bad = repair.damage(d)
    whole = sorted(damaged(rows), key=repr)
    assert sorted((tuple(r) for r in bad.collect()), key=repr) == whole
    found = repair.repair(bad, d.select("conv_id"), segment).withColumn("repaired", repair.repaired_text("repaired")).collect()
    ids = {r[0] for r in rows}
    want = {i: repaired_by_hand([r for r in whole if r[0] == i]) for i in ids}
    assert len(found) == len(ids)
    assert {r.conv_id: tuple(r)[1:] for r in found} == want
    assert {x for w in want.values() for x in w[6]} == set("KRDI")


def test_repair_of_a_long_conversation_and_none(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(20_000)]
    rows += [(2, t, "user", "Always the same.") for t in range(5_000)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in repair.repair(d).collect()}
    assert (found[1].cost, found[1].audit, len(found[1].repaired)) == (0, "K" * 20_000, 20_000)
    assert (found[2].cost, found[2].duplicate, len(found[2].repaired)) == (4_999 * 3 + 2, 4_999, 2)
    assert found[2].audit == "K" + "D" * 4_999 + "I"
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair(none).collect() == []
    assert [tuple(r) for r in repair.repair(none, spark.createDataFrame([(9,), (9,), (None,)], "conv_id long")).orderBy("conv_id").collect()] == [(i, 0, 0, 0, 0, 0, 0, "", []) for i in (None, 9)]


def test_queries_count_all_rows(spark):
    found = queries()["op13_conversation_repair"](spark, "/root/testdata/sf0.001")
    assert found.count() == spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id").distinct().count()


# --- the bound of the rows that teach quality ---


@pytest.mark.parametrize("slots, rows, most, want", [(65_536, 900, 1000, 900), (65_536, 3000, 1000, 1000), (2, 3000, 1000, 1000), (1, 5000, 10, 10)])
def test_quality_learns_from_as_many_rows_as_the_bound_allows(spark, monkeypatch, slots, rows, most, want):
    monkeypatch.setattr(quality_model, "MAX_TRAIN_ROWS", most)
    monkeypatch.setattr(quality_model, "_SLOTS", slots)
    d = spark.range(rows).select("id", (F.col("id") % 2).cast("int").alias("quality"))
    found = quality_model._bounded(d.unionAll(d))
    assert found.count() == found.distinct().count() == want
    assert sorted(found.collect()) == sorted(quality_model._bounded(d.repartition(7)).collect())

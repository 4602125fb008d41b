import random
import re
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import near_dedup, packing
from scriptorium.llm.queries import oracle_sql, queries

TOKENS = public_tokenizers.path("byte_bpe_50k.json")


# --- near duplicates ---


def words_of(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def shingles(text, size):
    w = words_of(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}


def brute_force(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in combinations([(d, s) for (d, _), s in zip(rows, sets)], 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return sorted((d, len(s), root(d), root(d) == d) for (d, _), s in zip(rows, sets))


@pytest.mark.parametrize("few", [0, 1 << 17])
def test_components_of_few_and_many_edges(spark, monkeypatch, few):
    monkeypatch.setattr(near_dedup, "FEW_EDGES", few)
    rng = random.Random(few)
    edges = [(k, k + 1) for k in range(100, 400)] + [(rng.randint(1000, 1400), rng.randint(1000, 1400)) for _ in range(250)] + [(7, 7), (9, 8), (8, 9)]
    rng.shuffle(edges)
    root = {x: x for e in edges for x in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    found = near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.node, r.root) for r in found} == {(a, b) for a, b in root.items() if a != b} and len(found) == len({r.node for r in found})
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_duplicates_against_brute_force(spark, size, percent):
    rng = random.Random(size)
    fresh = lambda n: [f"w{rng.randint(0, 4000)}" for _ in range(n)]
    rows, texts = [], []
    shared = fresh(60)  # a passage that many texts share
    for _ in range(40):
        texts.append(shared + fresh(rng.choice([5, 30, 90])))
    for _ in range(12):  # groups of copies at all distances
        base = fresh(rng.choice([20, 80, 200]))
        for _ in range(rng.choice([2, 6])):
            texts.append([w if rng.random() > rng.choice([0, 0.01, 0.03]) else "new" + str(rng.random()) for w in base])
    base = fresh(120)  # a chain: each differs a little from the one before
    for k in range(12):
        base = [*base[: 10 * k], f"link{k}", *base[10 * k + 1 :]]
        texts.append(list(base))
    texts += [fresh(3), ["a"], ["a"], ["A", "b"], ["a", "b"]]
    rows = list(enumerate([" ".join(t) for t in texts] + [None, "", " \n", "w " * 5000, "w " * 5000 + "w"]))
    rng.shuffle(rows)
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n int, rep int").repartition(3)
    got = sorted(tuple(r) for r in near_dedup.near_duplicates(d, size, percent).collect())
    assert got == brute_force(rows, size, percent)


def test_near_duplicate_edges(spark):
    d = spark.createDataFrame([(5, "a b c d e f", "x"), (5, "a b c d e f", "y"), (2, "a b c d e f", "z"), (7, None, "x"), (None, "q r s", "x")], "doc_id long, text string, component_id string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(d).collect()), key=str)
    assert got == [(2, 2, True), (5, 2, False), (5, 2, False), (7, 7, True), (None, None, True)]
    kept = near_dedup.keep_first(spark.createDataFrame([(1, "p q", 0), (1, "p q", 1), (3, "p q", 2), (4, "other", 3)], "doc_id long, text string, n int"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4] and kept.columns == ["doc_id", "text", "n"]
    assert near_dedup.near_duplicates(d.limit(0)).count() == 0


def test_keep_first_keeps_columns_of_any_name(spark):
    names = ["doc_id", "text", "_place", "x", "cls", "kept", "n", "a.b"]
    rows = [(1, "p q r", "b", *"vwxyz"), (1, "p q r", "a", *"vwxyz"), (1, None, "c", *"vwxyz"), (2, "p q r", "a", *"vwxyz"), (3, None, None, *"vwxyz"), (None, "p q r", "n", *"vwxyz")]
    d = spark.createDataFrame(rows, ", ".join(f"`{c}` {'long' if c == 'doc_id' else 'string'}" for c in names))
    got = near_dedup.keep_first(d)
    assert got.columns == names and sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [rows[2], rows[4], rows[5]]))
    assert near_dedup.keep_first(d.limit(0)).count() == 0


def test_texts_of_one_doc_id_are_each_compared(spark):
    fresh = lambda name: " ".join(f"{name}{k}" for k in range(200))
    near = lambda text: text + " more"
    rows, wanted = [], {}
    for g in range(0, 600, 10):  # g has two texts of its own, and each has a near copy
        rows += [(g, fresh(f"x{g}_")), (g, fresh(f"y{g}_")), (g + 1, near(fresh(f"x{g}_"))), (g + 2, near(fresh(f"y{g}_")))]
        wanted |= {g: g, g + 1: g, g + 2: g}
    # 1009 has the texts of three others and an empty one; 1010 is near to the middle one of them
    rows += [(1000 + k, fresh(f"z{k}_")) for k in (1, 2, 3)] + [(1009, fresh(f"z{k}_")) for k in (1, 2, 3)] + [(1009, ""), (1010, near(fresh("z2_"))), (1011, "")]
    wanted |= {1001: 1001, 1002: 1001, 1003: 1001, 1009: 1001, 1010: 1001, 1011: 1011}
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_dedup.near_duplicates(d).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.component_id) for r in got} == set(wanted.items())
    assert {r.doc_id for r in near_dedup.keep_first(d).collect()} == set(wanted.values())


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(40)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    got = {r.node: r.root for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}


# --- packing ---


def test_ids_are_those_of_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENS)
    rng = random.Random(1)
    alphabet = ["a", "B", "'s", "'ll", " ", "  ", "\n", "\t", " \n", "\r\n", "é", "中", "9", "½", ".", "!", "\xa0", "　", "𠀀", "<|endoftext|>", "\x1c", "\x85", "-", " x"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    coder = packing.UnitTokenizer(TOKENS)
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        assert [x.tolist() for x in coder.encode(part)] == [e.ids for e in library.encode_batch(part, add_special_tokens=False)]


def test_cuts_are_optimal():
    rng = np.random.default_rng(2)
    for _ in range(60):
        position = np.unique(np.cumsum(rng.integers(1, 9, rng.integers(1, 30))))
        penalty = rng.integers(0, 6, len(position))
        cuts = packing.best_cuts(position, penalty, capacity=12)
        pos, pen = [0, *position.tolist()], [0, *penalty.tolist()]
        best = [0.0] + [np.inf] * len(position)
        for j in range(1, len(pos)):
            best[j] = min(best[i] + 12 - (pos[j] - pos[i]) + pen[j] for i in range(j) if pos[j] - pos[i] <= 12)
        low, cost = 0, 0
        for c in cuts:
            assert 0 < c - low <= 12
            cost += 12 - (c - low) + pen[pos.index(c)]
            low = c
        assert low == pos[-1] and cost == best[-1]


def test_packing_is_whole(spark, monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["word", "and", "more.", "x"]) for _ in range(rng.choice([0, 1, 50, 900]))) for _ in range(80)] + [None, "", "a" * 9000, "no stop " * 60_000, "one. " * 9000]
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(0, texts[0], "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, offset string").repartition(3)
    got = packing.pack(d, TOKENS).collect()
    coder = packing.UnitTokenizer(TOKENS)
    ids = {k: np.append(coder.encode([t or ""])[0], 0).astype("<u4") for k, t in enumerate(texts)}
    seen = {}
    for r in got:
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
    for k, pieces in seen.items():
        copies = 2 if k == 0 else 1
        assert sum(n for _, n in pieces) == copies * len(ids[k])
        at = 0
        for start, n in sorted(set(pieces)) if copies == 1 else []:
            assert start == at
            at += n
    assert len(seen) == len(texts)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at <= packing.SEQUENCE_TOKENS
    assert sum(r.length for r in got) / (1024 * len(sequences)) > 0.95
    assert packing.pack(d.limit(0), TOKENS).count() == 0


# --- registration ---


def test_queries_are_registered():
    names = {k.split("_")[0] for k in queries()}
    assert names == {f"op{n}" for n in range(1, 11)}
    assert set(oracle_sql()) <= set(queries())


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    vocabulary = {"en": ["the", "house", "was", "with", "they", "running"], "de": ["der", "und", "straße", "läuft", "nicht", "schön"]}
    make = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) + str(rng.randint(100, 999)) * (rng.random() < 0.5) for _ in range(n))
    rows = [(k, make("en" if k % 2 else "de", 60), "en" if k % 2 else "de", "s", 1) for k in range(40)]
    leak = " ".join(f"leak{k}" for k in range(30))
    rows += [(100, rows[3][1], "en", "s", 1), (101, "12345 67890 !!", "en", "s", 1), (102, make("en", 20) + " " + leak, "en", "s", 1), (103, make("en", 40) + " mail me a@b.example.com", "en", "s", 1), (104, None, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "benchmark_leaks", "personal_data", "packing"]
    step, gone = d, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in step.collect()}
        step = stage(spark, step, str(tmp_path))
        assert step.columns == d.columns
        gone.append(before - {r.doc_id for r in step.collect()})
    assert gone == [{101, 104}, {100}, {102}, set()]
    assert step.where("doc_id = 103").first().text.endswith("mail me [EMAIL]")
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(range(40)) | {103}


def test_pipeline_stages_hold_odd_tables(spark, tmp_path):
    """Empty tables, nulls, repeated rows, very long texts, and columns of clashing names."""
    import corpus_pipeline

    names = ["doc_id", "text", "lang", "source", "n_chars", "key", "hash", "extra", "_spans", "_place", "row", "kept", "n"]
    rng = random.Random(20)
    words = ["the", "house", "was", "with", "they", "running"]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", str(rng.randint(0, 99))]) for _ in range(n))
    rows = [(k, text(60), "en", "s", 1, *"abcdefgh") for k in range(20)]
    rows += [rows[3], rows[3], (50, text(60_000), "en", None, 1, *"abcdefgh"), (51, None, None, None, None, *"abcdefgh"), (52, "", "en", "s", 0, *"abcdefgh"), (53, "call +1 (743) 555-3824 the house was", None, "s", 1, *"abcdefgh")]
    whole = spark.createDataFrame(rows, ", ".join(f"`{c}` {'long' if c in ('doc_id', 'n_chars') else 'string'}" for c in names))
    spark.createDataFrame([(1, text(30)), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for d, kept in ((whole, {*range(20), 50, 53}), (whole.limit(0), set())):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            d = stage(spark, d, str(tmp_path))
            assert d.columns == names
        assert sorted(r.doc_id for r in d.collect()) == sorted(kept)
        assert all("555-3824" not in (r.text or "") for r in d.collect())
        packed = corpus_pipeline.STAGES[-1][1](spark, d, str(tmp_path))
        assert {r.doc_id for r in packed.collect()} == kept


def test_workers_stay_small(spark):
    """A worker is kept for later stages, so a task leaves no units of its texts in it."""
    import pyarrow as pa

    docs = spark.range(400).repartition(8).selectExpr("id AS doc_id", "concat('kept unit', id, ' and more') AS text")
    assert packing.pack(docs, TOKENS).agg({"length": "sum"}).first()[0] > 400

    def held(batches):
        for batch in batches:
            units = sum(len(c.led) + len(c.first) for c in packing._coders.values())
            yield pa.RecordBatch.from_pydict({"coders": [len(packing._coders)], "units": [units]})

    got = spark.range(8).repartition(8).mapInArrow(held, "coders long, units long").collect()
    assert max(r["coders"] for r in got) == 1 and max(r["units"] for r in got) == 0


def test_tidy_gives_memory_back(monkeypatch):
    from scriptorium.llm import storage

    calls = []
    monkeypatch.setattr(storage, "give_back", lambda: calls.append(1))
    assert list(storage.tidy(iter)([1, 2])) == [1, 2] and calls == [1]
    stopped = storage.tidy(iter)([1, 2])
    next(stopped)
    stopped.close()
    assert calls == [1, 1]
    monkeypatch.undo()
    storage.give_back()

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.config import API, LOCAL, Profile
from scriptorium.operators import chunking, long_texts


def some_text(rng, n):
    kind = rng.choice(["marks", "few", "none", "blank"])
    letters = {"marks": "ab 。！\n𠀀", "few": "abcdefgh" * 200 + "。", "none": "abc", "blank": " a" + " " * 40}[kind]
    return "".join(rng.choices(letters, k=n))


@pytest.mark.parametrize("profile", [LOCAL, API, Profile(300, 0, 1, 1.0), Profile(400, 30, 1, 1.0)])
def test_exits_follow_the_chain(profile):
    rng = random.Random(profile.chunk_size)
    size, overlap = profile.chunk_size, profile.overlap
    for n in (0, 1, size - 1, size, size + 1, 3000, 9000):
        text = some_text(rng, n)
        own = min(len(text), 2000)
        found = long_texts.exits(text[: own + size], own, size, overlap)
        for entry in range(0, len(found), 37):
            at = entry
            for start, end in chunking.cut(text, size, overlap, entry):
                at = max(start, end - overlap)
                if at >= own:
                    break
            assert found[entry] == (at - own if at >= own else -1)


@pytest.mark.parametrize("profile", [LOCAL, Profile(300, 0, 1, 1.0)])
def test_long_documents_are_cut_as_in_one_go(spark, profile):
    rng = random.Random(4)
    rows = []
    for doc in range(14):
        for page in range(rng.choice([1, 3, 40])):
            rows.append((doc, page, rng.choice([None, "", " \n"]) if rng.random() < 0.2 else some_text(rng, rng.choice([1, 50, 299, 900, 5000, 20_000]))))
    d = spark.createDataFrame(rows, "doc_id long, page_no int, text string").repartition(6).withColumns({"start": F.lit("x"), "block": F.lit(1)})
    columns = ("doc_id", "chunk_id", "chunk_text", "start", "end")
    want = sorted(map(tuple, chunking.chunk_pages(d, profile).select(*columns).collect()))
    for block, group in ((1000, 3), (1 << 16, 1024)):
        found = long_texts.chunk_long_pages(d, profile, block, group)
        assert sorted(map(tuple, found.select(*columns).collect())) == want
    assert max(x[1] for x in want) > 100
    assert long_texts.chunk_long_pages(d.limit(0), profile).collect() == []
    with pytest.raises(ValueError, match="whole chunk"):
        long_texts.chunk_long_pages(d, profile, block=100)


def test_one_long_text_is_many_tasks(spark):
    text = ("Words of a long text。 " * 100_000)[:1_500_000]
    d = spark.createDataFrame([(1, 0, text)], "doc_id long, page_no int, text string")
    blocks = long_texts._blocks(d, LOCAL.chunk_size, 1 << 16)
    assert blocks.count() == -(-len(text.strip()) // (1 << 16))
    assert blocks.agg(F.max(F.length("text"))).first()[0] == (1 << 16) + LOCAL.chunk_size


def test_chunks_shorter_than_the_look_back_end(spark):
    """A mark right behind a chunk's start cuts it within the overlap: the next chunk begins at the cut, in all forms alike."""
    from scriptorium.streaming.chunks import advance, finish

    rng = random.Random(9)
    texts = ["".join(rng.choices("ab。\n", weights=[9, 9, 2, 1], k=n)) for n in (0, 1, 59, 60, 61, 500, 4000)] + ["。" * 300, "a。" + "b" * 300, "a" * 59 + "。" + "b" * 200]
    for size, overlap in ((60, 20), (60, 59), (3, 2), (1, 0), (60, 0)):
        for text in texts:
            chunks = list(chunking.cut(text, size, overlap))
            for (a, b), (c, _) in zip(chunks, chunks[1:]):
                assert c == (b - overlap if b - overlap > a else b) and a < c <= b <= a + size
            state = {"done": False, "chunk": 0, "page": 1, "buffer": "", "waiting": {}}
            got = advance(state, [(1, text, False)], size, overlap) + finish(state, size, overlap)
            assert [t for _, t in got] == [t for _, _, t in chunking.chunks_of(text, size, overlap)]
    profile = Profile(60, 20, 1, 1.0)
    d = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "doc_id long, page_no int, text string")
    columns = ("doc_id", "chunk_id", "chunk_text", "start", "end")
    want = sorted(map(tuple, chunking.chunk_pages(d, profile).select(*columns).collect()))
    assert sorted(map(tuple, long_texts.chunk_long_pages(d, profile, 100, 2).select(*columns).collect())) == want
    assert {x[0] for x in want} == set(range(1, len(texts)))


def test_documents_of_one_block_need_no_tables(spark, monkeypatch):
    """Only documents longer than a block are chained over blocks; at the border a line feed between pages counts."""
    rows = [(1, 0, "a" * 1000), (2, 0, "b" * 1001), (3, 0, "c" * 500), (3, 1, "d" * 499), (4, 0, "e" * 500), (4, 1, "f" * 500), (5, 0, " ")]
    d = spark.createDataFrame(rows, "doc_id long, page_no int, text string")
    seen, chain = [], long_texts._chunk_blocks
    monkeypatch.setattr(long_texts, "_chunk_blocks", lambda blocks, *x: seen.extend(r.doc_id for r in blocks.select("doc_id").distinct().collect()) or chain(blocks, *x))
    columns = ("doc_id", "chunk_id", "chunk_text", "start", "end")
    want = sorted(map(tuple, chunking.chunk_pages(d, LOCAL).select(*columns).collect()))
    assert sorted(map(tuple, long_texts.chunk_long_pages(d, LOCAL, 1000).select(*columns).collect())) == want
    assert sorted(seen) == [2, 4]

import os
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from scriptorium.plans import queries
from scriptorium.sources import pages, readers


@pytest.fixture
def source(spark):
    pages.register(spark)
    return spark.read.format("page_files")


def test_pages_of_form_feed_files(spark, source, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("one\f\fthree 漢\f", encoding="utf-8")
    (tmp_path / "sub" / "b.txt").write_text("only", encoding="utf-8")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "_SUCCESS").write_text("no page")
    for path in (str(tmp_path), f"file://{tmp_path}"):
        found = source.load(path).withColumn("doc_id", F.element_at(F.split("doc_id", "/"), -1)).orderBy("doc_id", "page_no").collect()
        assert [(r.doc_id, r.page_no, r.text) for r in found] == [("a.txt", 0, "one"), ("a.txt", 1, ""), ("a.txt", 2, "three 漢"), ("b.txt", 0, "only"), ("bad.txt", None, None)]
        assert found[-1].error.startswith("UnicodeDecodeError") and not any(r.error for r in found[:-1])
    d = source.load(str(tmp_path / "a.txt"))
    assert [r.page_no for r in readers.page_range(d, 0, 3).collect()] == [0, 2]
    store = readers.page_store(d).first()
    assert [(p.page, p.text) for p in store.pages] == [(1, "one"), (2, ""), (3, "three 漢")]


@pytest.mark.parametrize(
    "where, options, want",
    [
        ("true", {}, range(40)),
        ("page_no >= 5 and page_no < 9", {}, range(5, 9)),
        ("page_no > 37", {}, [38, 39]),
        ("page_no <= 1 and text <> ''", {}, [0, 1]),
        ("page_no = 7", {}, [7]),
        ("page_no in (3, 11, 90)", {}, [3, 11]),
        ("page_no in (3, 11) and page_no > 5", {}, [11]),
        ("page_no < 22", {"start": "20", "max_pages": "10"}, [20, 21]),
        ("page_no is not null", {"start": "-4", "max_pages": "2"}, [0, 1]),
        ("page_no >= 40", {}, []),
    ],
)
def test_only_wanted_pages_are_decoded(spark, source, tmp_path, where, options, want):
    told = tmp_path / "told"
    told.mkdir()
    (tmp_path / "x.pages").write_text("\n".join([str(told), *(f"page {k}" for k in range(40))]))
    d = source.options(decoder="page_decoders:Told", slice_bytes="100", **options).load(str(tmp_path / "x.pages")).where(where)
    assert sorted((r.page_no, r.text) for r in d.collect()) == [(k, f"page {k}") for k in want]
    assert {int(p.name.split("-")[0]) for p in told.iterdir()} == set(want)
    assert d.rdd.getNumPartitions() >= 4  # one file, several tasks


def test_a_bad_page_is_a_row(spark, source, tmp_path):
    (tmp_path / "x.pages").write_text(f"{tmp_path}\ngood\nbad\nlast")
    found = source.option("decoder", "page_decoders:Told").load(str(tmp_path / "x.pages")).orderBy("page_no").collect()
    assert [(r.page_no, r.text, r.error) for r in found] == [(0, "good", None), (1, None, "ValueError: a bad page"), (2, "last", None)]
    with pytest.raises(Exception, match="path"):
        spark.read.format("page_files").load().collect()


def test_a_slice_reads_its_own_bytes(spark, tmp_path, monkeypatch):
    """Slices of every size give the pages of the whole file, by an index or without; a task reads no more than its slice and its last page."""
    (tmp_path / "sub").mkdir()
    texts = {"a": "one\f\fthree 漢\f\f", "b": "no end", "c": "\f", "d": "é" * 50 + "\f" + "x" * 30, "e": ""}
    for name, text in texts.items():
        (tmp_path / "sub" / name).write_text(text, encoding="utf-8")
    (tmp_path / "sub" / "f").write_bytes(b"good\fgood too\f\xff\fgood")
    want = sorted((n, k, t) for n, x in texts.items() for k, t in enumerate(pages.form_feed_pages(x.encode()) if x else []))
    for size in (2, 7, 1000):
        for how in (pages.load(spark, str(tmp_path), slice_bytes=size), spark.read.format("page_files").option("slice_bytes", size).load(str(tmp_path))):
            found = [(r.doc_id[-1], r.page_no, r.text, r.error) for r in how.collect()]
            assert sorted(r[:3] for r in found if r[0] != "f") == want
            bad = [r for r in found if r[0] == "f"]
            assert [r[1:3] for r in bad] == [(None, None)] and bad[0][3].startswith("UnicodeDecodeError")

    class Counting:
        def __init__(self, f):
            self.f, self.read_bytes = f, 0

        def __enter__(self):
            return self

        def __exit__(self, *x):
            self.f.close()

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            self.read_bytes += n
            return self.f.read(n)

    (tmp_path / "large").write_text("a page of it\f" * 100_000)
    opened = []
    monkeypatch.setattr(pages.PageReader, "_opened", lambda self, name: opened.append(Counting(open(name, "rb"))) or opened[-1])
    begins = [-(-100_000 * k // 13) for k in range(14)]  # pages that begin before slice k
    counts = [b - a for a, b in zip(begins, begins[1:])]
    reader = pages.PageReader({"path": str(tmp_path / "large"), "slice_bytes": "100000"})
    reader.index = {str(tmp_path / "large"): {"size": 1_300_000, "counts": counts, "error": None}}
    reader.first = 90_000
    slices = reader.partitions()
    assert len(slices) == 2
    assert [r[2] for s in slices for r in reader.read(s)] == ["a page of it"] * 10_000
    assert max(f.read_bytes for f in opened) <= 100_001 + (1 << 20)


def test_failfast_ends_the_job(spark, source, tmp_path):
    (tmp_path / "bad.txt").write_bytes(b"good\fgood\f\xff\fgood")
    (tmp_path / "x.pages").write_text(f"{tmp_path}\ngood\nbad\nlast")
    for size in (2, 1000):
        for how in (pages.load(spark, str(tmp_path / "bad.txt"), slice_bytes=size, mode="failfast"), source.options(mode="FAILFAST", slice_bytes=size).load(str(tmp_path / "bad.txt"))):
            with pytest.raises(Exception, match="bad.txt: UnicodeDecodeError"):
                readers.page_range(how, 1).collect()
    told = spark.read.format("page_files").options(mode="FAILFAST", decoder="page_decoders:Told").load(str(tmp_path / "x.pages"))
    with pytest.raises(Exception, match="page 1: ValueError: a bad page"):
        told.collect()
    assert [r.text for r in told.where("page_no = 2").collect()] == ["last"]
    with pytest.raises(Exception, match="mode of page_files: NONE"):
        spark.read.format("page_files").option("mode", "none").load(str(tmp_path)).collect()


@pytest.mark.parametrize("decoder", ["scriptorium.sources.pages:form_feed_pages", "page_decoders:Told"])
def test_a_slice_that_cannot_be_read_is_not_left_out(tmp_path, monkeypatch, decoder):
    """Whichever slice it is, by an index or without: no rows of the others alone, no row that says the file is bad."""
    path = str(tmp_path / "x")
    (tmp_path / "x").write_text("ten bytes\f" * 10 + "and a long last page")
    for index in (None, {path: {"size": 120, "counts": [3, 3, 3, 2], "error": None}}):
        for kind in (pages.PageReader, pages.CountReader):
            reader = kind({"path": path, "slice_bytes": "30", "decoder": decoder})
            reader.index = index
            slices = reader.partitions()
            assert len(slices) == 4
            for s in slices:
                with monkeypatch.context() as m, pytest.raises(OSError, match="no such block"):
                    m.setattr(kind, "_opened", lambda self, name: (_ for _ in ()).throw(OSError("no such block")))
                    list(reader.read(s))
            os.truncate(path, 25)
            for s in slices if kind is pages.PageReader or decoder.endswith("form_feed_pages") else ():
                if s.share:
                    with pytest.raises(OSError, match="has changed"):
                        list(reader.read(s))
            (tmp_path / "x").write_text("ten bytes\f" * 10 + "and a long last page")
    reader = pages.PageReader({"path": str(tmp_path)})
    reader.index = {path: {"size": 120, "counts": [11], "error": None}, f"{path}-gone": {"size": 1, "counts": [1], "error": None}}
    with pytest.raises(FileNotFoundError, match="x-gone"):
        reader.partitions()


def _documents(spark, folder, ids):
    rows = [(i, f"text {i} {k}") for k, i in enumerate(ids)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(folder / "documents.parquet"))
    return str(folder)


def test_the_query_loses_no_file(spark, tmp_path, monkeypatch):
    """A page that can't be read back ends the query; its file's rows were missing from the result before."""
    d = _documents(spark, tmp_path, range(80))
    assert queries.queries()["page_files"](spark, d).count() == 64
    load = pages.load

    def damaged(session, path, **options):
        folder = os.path.join(urlparse(path).path, "bucket=3")
        with open(os.path.join(folder, min(x for x in os.listdir(folder) if x.startswith("part-"))), "ab") as f:
            f.write(b"\xff")
        return load(session, path, **options)

    monkeypatch.setattr(pages, "load", damaged)
    with pytest.raises(Exception, match="UnicodeDecodeError"):
        queries.queries()["page_files"](spark, d).count()


def test_the_query_names_every_bucket(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    d = _documents(spark, tmp_path, [*range(-40, 40), None, None, None])
    found = queries.queries()["page_files"](spark, d).collect()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS FROM '{d}/documents.parquet/*.parquet'")
    want = c.execute(queries.oracle_sql()["page_files"]).fetchall()
    # rows without an id have no order of their own, and so no page of their own
    told = lambda rows: sorted((r[0], r[1], r[2]) for r in rows if r[0] is not None)
    assert told(found) == told(want) and len(told(want)) == 50
    assert [r.page_no for r in found if r.bucket is None] == [2]

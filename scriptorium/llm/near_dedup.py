"""Near-duplicate components by a signature-coordinate inverted join.

1. Every text gets its set of word shingles (64-bit hashes), the set's size and
   a digest, and a MinHash signature of ``COORDINATES`` values.  Texts of equal
   sets become one numbered class, whose node among the components is its smallest
   doc_id: classes of one doc_id share a node, but each is compared for itself.
2. Classes are posted under every (coordinate, value) pair of their signature.
   Two sets at the threshold agree in at least ``least_matches`` coordinates but
   for a chance of about 1e-7, so they share one of each other's
   COORDINATES - least_matches + 1 rarest pairs: only this prefix is posted;
   pairs that no other class has need no posting at all.
3. Rounds of linking.  In every posting list with more than one component a
   leader is taken - first the class whose pairs are met most, the likely source
   of a group of copies, then one drawn by hash; each class of another component
   counts how often it meets each leader, and its best one is tried.  A tried pair
   must agree in enough coordinates of the full signatures, then its full shingle
   sets are compared.  Links contract components, so a group of many copies costs
   a few pairs a class, never all of its pairs.
4. What the rounds leave are lists that still hold several components, such as
   many variants of one text that are just too far apart.  Their pairs would grow
   with the square of the list, so their classes are posted once more under the
   exact prefix of their shingle sets, the rarest shingles of which two linked sets
   must share one; pairs whose sizes and places in the order still allow the
   overlap are tried.  So no link between components is lost.  Components follow by
   alternating large and small stars.

All tables are distributed; between steps they are written to the shared folder, and
deleted there when no later step reads them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches, materialise, release, tidy
from .wordhash import hash_words, mix64, slices, windows

COORDINATES = 64
ROUNDS = 2
#: 2 MB of edges: their components take one small task instead of some thirty shuffles.
FEW_EDGES = 1 << 17
#: Slots of the fixed-size filter that spares texts without any candidate a second reading.
_SLOTS = 1 << 20
_rng = np.random.default_rng(64_085)
_XOR = _rng.integers(1, 2**63, COORDINATES, dtype=np.uint64)
_FACTOR = _rng.integers(1, 2**62, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_COORDINATE_BITS = np.uint64(COORDINATES - 1)


def least_matches(percent: int) -> int:
    """Agreeing coordinates of sets with that similarity, 5.5 standard deviations below the mean."""
    j = percent / 100
    return max(1, math.floor(COORDINATES * j - 5.5 * math.sqrt(COORDINATES * j * (1 - j))))


def _sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and their offsets."""
    h, offsets = windows(*hash_words(column), size)
    own = [np.unique(h[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    return (np.concatenate(own) if own else h), np.concatenate([[0], np.cumsum([len(s) for s in own])]).astype(np.int64)


def _digests(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Two hashes of each text's whole set, 0 of an empty one."""
    n = np.diff(offsets)
    full = np.flatnonzero(n)
    digest = np.zeros((2, len(n)), np.uint64)
    for k in range(2 if len(full) else 0):
        digest[k, full] = np.add.reduceat(mix64(h ^ np.uint64(k * 0x5851F42D4C957F2D)), offsets[:-1][full])
    return digest


def signatures(documents: DataFrame, size: int) -> DataFrame:
    """doc_id, n (size of the shingle set), digest (two longs), signature (array of coordinate-value pairs as longs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=2 << 20):
            h, offsets = _sets(batch.column("text"), size)
            n = np.diff(offsets)
            full = np.flatnonzero(n)
            digest = _digests(h, offsets)
            signature = np.zeros((len(full), COORDINATES), np.uint64)
            if len(full):
                begin = offsets[:-1][full]
                for k in range(COORDINATES):
                    least = np.minimum.reduceat((h ^ _XOR[k]) * _FACTOR[k], begin)
                    signature[:, k] = (least & ~_COORDINATE_BITS) | np.uint64(k)
            places = np.concatenate([[0], np.cumsum(np.where(n > 0, COORDINATES, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)), pa.ListArray.from_arrays(pa.array(places), pa.array(signature.reshape(-1).view(np.int64)))],
                names=["doc_id", "n", "d1", "d2", "signature"],
            )

    return documents.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n long, d1 long, d2 long, signature array<long>")


def shingle_sets(documents: DataFrame, size: int, wanted: DataFrame) -> DataFrame:
    """cls, shingles (binary, sorted longs) of the classes wanted(cls, rep, n, d1, d2), from the texts of rep that have the digest."""
    slot = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(_SLOTS)).cast("int")
    used = wanted.select(F.pmod(F.xxhash64("rep"), F.lit(_SLOTS)).cast("int").alias("slot")).distinct().toArrow()
    maybe = np.zeros(_SLOTS, bool)
    maybe[used["slot"].to_numpy()] = True
    shared = documents.sparkSession.sparkContext.broadcast(maybe)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            batch = batch.filter(pa.array(shared.value[batch.column("slot").to_numpy()]))
            if batch.num_rows:
                h, offsets = _sets(batch.column("text"), size)
                blobs = [h[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
                digest = _digests(h, offsets).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array(digest[0]), pa.array(digest[1]), pa.array(blobs, pa.binary())],
                    names=["rep", "n", "d1", "d2", "shingles"],
                )

    found = documents.where("doc_id is not null").select("doc_id", "text", slot.alias("slot")).mapInArrow(tidy(run), "rep long, n long, d1 long, d2 long, shingles binary")
    return found.join(wanted, ["rep", "n", "d1", "d2"]).select("cls", "shingles")


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of cls, comp, shingles."""
    for batch in batches:
        for cls, comp, blob in zip(*(c.to_pylist() for c in batch.columns)):
            h = np.frombuffer(blob, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), x, t)) for x, t in ((cls, np.int64), (comp, np.int64), (len(h), np.int32))] + [pa.array(h)], names=["cls", "comp", "n", "shingle"])


def _compare(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["na", "nb"]).rename_columns(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges(a, b): root is the smallest node reachable; roots are left out."""
    return _stars(edges).select(F.col("a").alias("node"), F.col("b").alias("root"))


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``components`` of edges that are all in one task."""
    tables = [np.stack([b.column(c).to_numpy() for c in ("a", "b")]) for b in batches if b.num_rows]
    if not tables:
        return
    nodes, ends = np.unique(np.concatenate(tables, 1), return_inverse=True)
    low, high = np.sort(ends.reshape(2, -1), 0)
    root = np.arange(len(nodes))
    while True:
        # both ends to the lower root of either, and each root to its own
        least = np.minimum(root[low], root[high])
        before = root.copy()
        for end in (root[low], root[high]):
            np.minimum.at(root, end, least)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            break
    child = root != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[child]), pa.array(nodes[root[child]])], names=["a", "b"])


def _stars(edges: DataFrame) -> DataFrame:
    """``components`` as written: (a, b), b the root of a.  Up to ``FEW_EDGES`` edges are one task's work, more go through alternating stars."""
    e, before, last = edges.where("a <> b"), None, []
    if e.limit(FEW_EDGES + 1).count() <= FEW_EDGES:
        return materialise(e.select("a", "b").coalesce(1).mapInArrow(tidy(_roots), "a long, b long"), "stars")
    while True:
        both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        e = materialise(small, "stars")
        release(*last)
        now, last = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()), [e]
        if now == before:
            return e
        before = now


class _Linker:
    """Postings of a table of classes, and the links found among them."""

    def __init__(self, documents: DataFrame, reps: DataFrame, size: int, percent: int):
        self.percent, self.matches = percent, least_matches(percent)
        prefix = COORDINATES - self.matches + 1
        pairs = reps.select("cls", "rep", F.explode("signature").alias("token"))
        frequent = pairs.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
        own = pairs.join(frequent, "token").groupBy("cls", "rep").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("own"), F.sum("df").alias("met"))
        # pairs that no other class has come first in the prefix and need no posting
        left = F.size("own") - F.lit(COORDINATES - prefix)
        own = own.where(left > 0).select("cls", "rep", "met", F.slice("own.token", F.lit(1), left).alias("prefix"))
        self.post = materialise(own.select("cls", "rep", "met", F.explode("prefix").alias("token")), "postings")
        self.wanted = wanted = materialise(reps.join(self.post.select("cls").distinct(), "cls", "left_semi"), "signatures")
        self.signatures = wanted.select("cls", F.col("rep").alias("node"), "signature")
        self.sets = materialise(shingle_sets(documents, size, wanted.drop("signature")).dropDuplicates(["cls"]), "sets")
        self.tried: list[DataFrame] = []
        self.stars: DataFrame | None = None

    def _lists(self) -> DataFrame:
        """(token, cls, rep, met, comp): the postings with the component that each class is in now."""
        if self.stars is None:
            return self.post.withColumn("comp", F.col("rep"))
        return self.post.join(self.stars.withColumnsRenamed({"a": "rep", "b": "comp"}), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))

    def _try(self, pairs: DataFrame) -> None:
        """Compare pairs(a, b) of classes; keep the links of their nodes and refresh the components."""
        for tried in self.tried:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "pairs")
        sig, sets = self.signatures, self.sets
        close = pairs.join(sig.withColumnsRenamed({"cls": "a", "node": "na", "signature": "x"}), "a").join(sig.withColumnsRenamed({"cls": "b", "node": "nb", "signature": "y"}), "b")
        close = close.where(F.size(F.array_intersect("x", "y")) >= self.matches).select("a", "b", "na", "nb")
        full = close.join(sets.withColumnsRenamed({"cls": "a", "shingles": "sa"}), "a").join(sets.withColumnsRenamed({"cls": "b", "shingles": "sb"}), "b")
        links = materialise(full.select("na", "nb", "sa", "sb").mapInArrow(tidy(_compare(self.percent)), "a long, b long"), "links")
        self.tried.append(pairs)
        before = [] if self.stars is None else [self.stars]
        self.stars = _stars(reduce(DataFrame.unionAll, before, links))
        release(links, *before)

    def round(self, number: int) -> None:
        lists = self._lists()
        rank = -F.col("met") if number == 0 else F.xxhash64("rep", F.lit(number))
        draw = F.min(F.struct(rank.alias("h"), "rep", "cls", "comp"))
        mixed = lists.groupBy("token").agg(draw.alias("lead"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("token", F.struct("lead.rep", "lead.cls").alias("leader"), F.col("lead.comp").alias("leads"))
        met = lists.join(mixed, "token").where("comp <> leads").groupBy("cls", "leader").agg(F.count("*").alias("n"))
        best = met.groupBy("cls").agg(F.max(F.struct("n", "leader"))["leader"]["cls"].alias("leader"))
        self._try(best.select(F.least("cls", "leader").alias("a"), F.greatest("cls", "leader").alias("b")).distinct())

    def rest(self) -> None:
        lists = self._lists()
        mixed = lists.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("token")
        left = materialise(lists.join(mixed, "token", "left_semi").select("cls", "comp").distinct(), "left")
        if left.isEmpty():
            release(left, self.post, self.wanted, self.sets, *self.tried)
            return
        each = materialise(self.sets.join(left, "cls").select("cls", "comp", "shingles").mapInArrow(tidy(_shingles), "cls long, comp long, n int, shingle long"), "left-shingles")
        frequent = each.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
        own = each.join(frequent, "shingle").groupBy("cls", "comp", "n").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("own"))
        # shingles that no other set has come first in the order and need no posting
        d = own.select("cls", "comp", "n", "own.shingle", (F.col("n") - F.size("own")).alias("unique"))
        # of two linked sets the longer shares one of its n - ceil(p n) + 1 first shingles, the shorter one of its n - ceil(2 p n / (1 + p)) + 1
        last = lambda up, down: F.col("n") - F.ceil(F.col("n") * up / down).cast("int") + 1 - F.col("unique")
        part = lambda size: F.posexplode(F.slice("shingle", F.lit(1), F.greatest(size, F.lit(0)))).alias("pos", "shingle")
        d = d.where(last(self.percent, 100) > 0)
        long = d.select(F.col("cls").alias("x"), F.col("comp").alias("cx"), F.col("n").alias("nx"), "unique", part(last(self.percent, 100)))
        long = materialise(long.select("x", "cx", "nx", "shingle", (F.col("nx") - F.col("pos") - F.col("unique")).alias("rx")), "prefixes")
        short = d.select(F.col("cls").alias("y"), F.col("comp").alias("cy"), F.col("n").alias("ny"), "unique", part(last(2 * self.percent, 100 + self.percent)))
        short = short.select("y", "cy", "ny", "shingle", (F.col("ny") - F.col("pos") - F.col("unique")).alias("ry"))
        # from the shared shingle on, at most the rest of either set can still be shared
        sized = (F.col("nx") > F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))
        near = (100 * F.col("ny") >= self.percent * F.col("nx")) & ((100 + self.percent) * F.least("rx", "ry") >= self.percent * (F.col("nx") + F.col("ny")))
        pairs = long.join(short, "shingle").where((F.col("cx") != F.col("cy")) & sized & near)
        self._try(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        release(left, each, long, self.post, self.wanted, self.sets, *self.tried)


def near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept of every row.

    documents(doc_id, text).  Words are split at ASCII white space, A-Z
    lower-cased; a text's set has its distinct ``size``-word shingles, or its whole
    sequence if it has fewer words.  Texts are linked whose sets have 100 *
    intersection >= percent * union.  Null, empty and blank texts have an empty set and
    no link.  Very long texts have their whole sets compared.  Rows with the same doc_id
    are one document: its rows, equal or not, are linked, and get a row each.  A null
    doc_id stays alone, with a null component and kept.  An empty table gives no rows;
    other columns are ignored.
    """
    return _linked(documents, size, percent)[0]


def _linked(documents: DataFrame, size: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """``near_duplicates``, and the written tables that it reads."""
    spark = documents.sparkSession
    bounded_batches(spark)
    table = materialise(signatures(documents, size), "sets")
    key = ["n", "d1", "d2"]
    reps = table.where("n > 0 and doc_id is not null").groupBy(*key).agg(F.min(F.struct("doc_id", "signature")).alias("x")).select(*key, F.col("x.doc_id").alias("rep"), F.col("x.signature").alias("signature"))
    reps = materialise(reps.withColumn("cls", F.monotonically_increasing_id()), "signed-classes")
    # signatures are most of both tables, and no later step needs them beyond the linker's own
    keys, classes = materialise(table.select("doc_id", *key), "keys"), materialise(reps.select(*key, "rep"), "classes")
    release(table)
    linker = _Linker(documents, reps, size, percent)
    release(reps)
    for k in range(ROUNDS):
        linker.round(k)
    linker.rest()
    # a document that has rows in several classes links them
    rows = keys.join(classes, key, "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("doc_id", "a")
    several = rows.join(several, "doc_id").where("a < rep").select("a", F.col("rep").alias("b")).distinct()
    roots = _stars(linker.stars.unionAll(several))
    release(linker.stars)
    out = rows.join(roots.withColumnsRenamed({"a": "rep", "b": "root"}), "rep", "left")
    component = F.coalesce("root", "rep")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
    return out, [keys, classes, roots]


def keep_first(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each near-duplicate component: the one of smallest doc_id; same columns.

    Of rows with the same doc_id the one of smallest text stays (null first), of equal
    texts that of smallest other columns in their order; columns that can't be ordered,
    as maps, count by their hash.  Null and empty texts have no link and stay.  Rows with a null
    doc_id all stay.  An empty table stays empty; other columns, whatever their names,
    are kept.
    """
    linked, written = _linked(documents, size, percent)
    found = materialise(linked, "components")
    release(*written)
    out = documents.join(found.where("not kept").select("doc_id").distinct(), "doc_id", "left_anti")
    several = materialise(found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    if not several.isEmpty():
        rows = out.join(several, "doc_id", "left_semi")
        # a column's own name can't clash inside the structs; a least row needs no number
        plain = [f.name for f in documents.schema if f.name != "doc_id" and not re.search("map<|variant", f.dataType.simpleString())]
        name = lambda c: F.col("`" + c.replace("`", "``") + "`")
        order = F.struct(F.col("text"), *[name(c).alias(f"c{i}") for i, c in enumerate(plain) if c != "text"], F.xxhash64(*[F.to_json(F.struct(name(f.name).alias("v"))) for f in documents.schema]))
        one = rows.groupBy("doc_id").agg(F.min_by(F.struct(*[name(c).alias(f"c{i}") for i, c in enumerate(documents.columns)]), order).alias("x"))
        one = one.select(*[F.col(f"x.c{i}").alias(c) for i, c in enumerate(documents.columns)])
        out = out.join(several, "doc_id", "left_anti").unionByName(one)
    return out.select(*["`" + c.replace("`", "``") + "`" for c in documents.columns])

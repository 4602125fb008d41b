"""Near-duplicate vectors by cosine, searched in a robust-pruned flat graph.

1. Equal vectors become one class with a count.  Classes that stand closer together
   than half the threshold's angle become balls: each pair inside one is linked by the
   triangle inequality, so a group of copies costs its size, never its pairs.  Dense
   places found in a bounded sample give balls that any number of vectors join where
   they are read; the rest find balls inside their shard.
2. Balls are the graph's nodes.  Each is a member of its two nearest clusters (of
   centroids fitted to the sample); clusters over ``SHARD`` nodes are dealt out by hash.
   In each shard the nearest and some random members are candidates, robust pruning
   keeps edges that no shorter edge makes needless, and whatever the medoid can't reach
   is tied in.  Adjacency lists of all shards are united.
3. Every node is searched in the shards of its nearest clusters: greedily from the
   medoid, then through all that is in range, which a ball's radius widens.  Where a
   node in range has an edge into a cluster not yet searched that may end in range, by
   the angles, the query goes there in the next round, until no round finds a new place.
4. The recall is audited against brute force on ``AUDIT`` nodes; below ``MIN_RECALL``
   queries go to twice as many clusters, at last to all.
5. Pairs of balls that are near enough as a whole are linked as a whole, pairs on the
   border are verified member by member in blocks.  Only counts and one link a pair of
   balls leave the task.

Angles of balls leave a margin of ``MARGIN``, so that rounding never decides a bound.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_dedup import components
from .storage import bounded_batches, materialise, release

#: Nodes of a shard, queries that search it together, vectors that centroids and dense places are fitted to.
SHARD, QUERIES, SAMPLE = 2048, 512, 20_000
#: A dense place holds that many vectors of the sample.
DENSE = 8
#: Candidates of a node by nearness and by chance, edges kept, and the factor of pruning on 1 - cosine.
NEAREST, CHANCE, EDGES, PRUNE = 32, 8, 16, 1.44
BEAM = 24
AUDIT, MIN_RECALL = 200, 0.97
MARGIN = 1e-6
#: Bytes of one block of members.
BLOCK = 1 << 16


def _units(blobs: pa.Array, kind: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension the rows of that dimension and their unit vectors in double precision."""
    size = np.dtype(kind).itemsize
    lengths = pa.compute.binary_length(blobs).to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        x = np.frombuffer(b"".join(blobs.take(pa.array(rows)).to_pylist()), kind).reshape(len(rows), n // size).astype(np.float64)
        x = x / np.abs(x).max(1, keepdims=True)
        out[n // size] = rows, x / np.sqrt((x * x).sum(1, keepdims=True))
    return out


def _unit_rows(blobs: pa.Array, kind: str) -> np.ndarray:
    """Unit vectors of blobs of one dimension."""
    return next(iter(_units(blobs, kind).values()))[1]


def vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, blob (the vector's numbers; null where it has no direction: null, empty, zero, with a null or non-finite component), d1, d2 (a digest of blob)."""
    single = rows.schema[vector].dataType.simpleString() == "array<float>"
    kind, plain = ("<f4", pa.float32()) if single else ("<f8", pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = []
            for v in batch.column("v"):
                x = v.values.cast(plain) if v.is_valid and len(v.values) and not v.values.null_count else None
                x = None if x is None else x.to_numpy(zero_copy_only=False).astype(kind) + np.array(0, kind)
                blobs.append(x.tobytes() if x is not None and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").cast(pa.int64()), pa.array(blobs, pa.binary())], names=["vec_id", "blob"])

    d = rows.select("vec_id", F.col(vector).cast(f"array<{'float' if single else 'double'}>").alias("v")).mapInArrow(run, "vec_id long, blob binary")
    known = F.col("blob").isNotNull() & F.col("vec_id").isNotNull()
    return d.withColumns({"d1": F.when(known, F.xxhash64("blob")), "d2": F.when(known, F.xxhash64("blob", F.lit(1)))})


def _fitted(sample: list[bytes], kind: str, share: float, angle: float) -> tuple[dict[int, tuple[int, np.ndarray]], dict[int, tuple[int, np.ndarray]]]:
    """By dimension (number of the first, matrix) of centroids and of centres of dense places, fitted to a sample that is ``share`` of all."""
    centroids, dense, first, place = {}, {}, 0, 0
    for dim, (_, x) in sorted(_units(pa.array(sorted(set(sample)), pa.binary()), kind).items()) if sample else []:
        rng = np.random.default_rng(dim)
        k = int(np.clip(round(len(x) / share / SHARD), 1, max(1, len(x) // 8)))
        c = x[rng.permutation(len(x))[:k]]
        for _ in range(8):
            own = np.concatenate([(x[i : i + 1024] @ c.T).argmax(1) for i in range(0, len(x), 1024)])
            sums = np.zeros_like(c)
            np.add.at(sums, own, x)
            norm = np.sqrt((sums * sums).sum(1, keepdims=True))
            c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c)
        centroids[dim] = first, c
        first += len(c)
        # members of one place are at most sqrt(2) times as far from each other as from its middle
        wide = math.cos(min(angle * math.sqrt(2), math.pi))
        near = np.concatenate([(x[i : i + 1024] @ x.T >= wide).sum(1) for i in range(0, len(x), 1024)])
        free, middles = near >= DENSE, []
        for i in np.argsort(-near, kind="stable"):
            if not free[i]:
                continue
            group = free & (x @ x[i] >= wide)
            free[i] = False
            if group.sum() >= DENSE:
                middle = x[group].sum(0)
                middles.append(middle / np.sqrt(middle @ middle))
                free &= x @ middles[-1] < math.cos(angle)
        if middles:
            dense[dim] = place, np.array(middles)
            place += len(middles)
    return centroids, dense


def _placed(rows: DataFrame, kind: str, centroids, dense, width: int, angle: float) -> DataFrame:
    """rows(blob, ...) with near (numbers of the ``width`` nearest clusters, nearest first), place and off (dense place within ``angle``, and the angle to it)."""
    shared = rows.sparkSession.sparkContext.broadcast((centroids, dense))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, dense = shared.value
        for batch in batches:
            n = batch.num_rows
            near, place, off = [None] * n, np.full(n, -1, np.int64), np.full(n, np.nan)
            for dim, (at, x) in _units(batch.column("blob"), kind).items():
                if dim in centroids:
                    first, c = centroids[dim]
                    best = np.argsort(-(x @ c.T), 1, kind="stable")[:, :width] + first
                else:  # a dimension that the sample lacks is one cluster
                    best = np.full((len(x), 1), -dim)
                for i, b in zip(at.tolist(), best.tolist()):
                    near[i] = b
                if dim in dense:
                    first, c = dense[dim]
                    s = x @ c.T
                    best = s.argmax(1)
                    turn = np.arccos(np.clip(s[np.arange(len(x)), best], -1, 1))
                    inside = turn <= angle
                    place[at[inside]], off[at[inside]] = best[inside] + first, turn[inside]
            found = [pa.array(near, pa.list_(pa.int32())), pa.array(place, mask=place < 0), pa.array(off, mask=place < 0)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*batch.schema.names, "near", "place", "off"])

    out = rows.withColumns({c: F.lit(None).cast(t) for c, t in (("near", "array<int>"), ("place", "long"), ("off", "double"))}).schema
    return rows.mapInArrow(run, out)


def _dealt(rows: DataFrame, cluster: str, size: int) -> DataFrame:
    """rows with parts: the number of shards of a cluster.  There are at most ``SAMPLE`` / 8 clusters and as many dimensions."""
    counts = rows.groupBy(cluster).agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))
    return rows.join(F.broadcast(counts), cluster)


def _balls(rows: DataFrame, kind: str, angle: float) -> DataFrame:
    """cls, ball, m, node, blob and, of a ball's leader, size, radius, least and members; rows of one shard each, by near[0]."""
    least = math.cos(angle)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("cls")
        x = _unit_rows(table["blob"].combine_chunks(), kind)
        n, m, node = len(x), table["m"].to_numpy(), table["node"].to_numpy()
        near = np.concatenate([(x[i : i + 512] @ x.T >= least).sum(1) for i in range(0, n, 512)])
        ball, off = np.arange(n), np.zeros(n)
        free = near > 1
        for i in np.argsort(-near, kind="stable"):
            if near[i] == 1:
                break
            if free[i]:
                left = np.flatnonzero(free)
                s = x[left] @ x[i]
                own = left[(s >= least) | (left == i)]
                ball[own] = i
                off[own] = np.arccos(np.clip(x[own] @ x[i], -1, 1))
                off[i] = 0
                free[own] = False
        size, radius, low, members = np.zeros(n, np.int64), np.zeros(n), np.full(n, np.iinfo(np.int64).max), np.bincount(ball, minlength=n)
        np.add.at(size, ball, m)
        np.maximum.at(radius, ball, off)
        np.minimum.at(low, ball, node)
        leads = ball == np.arange(n)
        cls = table["cls"].to_numpy()
        of = lambda a, t: pa.array(a, t, mask=~leads)
        return pa.table({
            "cls": table["cls"], "ball": cls[ball], "m": table["m"], "node": table["node"], "blob": table["blob"], "size": of(size, pa.int64()),
            "radius": of(radius, pa.float64()), "least": of(low, pa.int64()), "members": of(members, pa.int64()),
        })

    d = _dealt(rows.select("cls", "m", "node", "blob", F.col("near")[0].alias("cluster")), "cluster", SHARD)
    d = d.withColumn("salt", F.pmod(F.xxhash64("cls"), F.col("parts"))).drop("parts")
    return d.groupBy("cluster", "salt").applyInArrow(run, "cls long, ball long, m long, node long, blob binary, size long, radius double, least long, members long")


def _medoid(x: np.ndarray) -> int:
    return int((x @ x.sum(0)).argmax())


def _edges(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Robust-pruned edges of a shard in both directions, reachable from its medoid."""
    n = len(x)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    tails, heads = [], []
    k = min(NEAREST, n - 1)
    for i in range(0, n, 256):
        own = np.arange(i, min(i + 256, n))
        s = x[own] @ x.T
        s[np.arange(len(own)), own] = -2
        c = np.argpartition(-s, k - 1, 1)[:, :k]
        c = np.concatenate([c, rng.integers(0, n, (len(own), CHANCE))], 1)
        s = np.take_along_axis(s, c, 1)
        order = np.argsort(-s, 1, kind="stable")
        c, s = np.take_along_axis(c, order, 1), np.take_along_axis(s, order, 1)
        y = x[c]
        between = np.einsum("ncd,nkd->nck", y, y)
        alive, kept, count = s > -2, np.zeros(c.shape, bool), np.zeros(len(own), np.int64)
        for j in range(c.shape[1]):
            kept[:, j] = take = alive[:, j] & (count < EDGES)
            count += take
            alive &= ~(take[:, None] & (PRUNE * (1 - between[:, j]) <= 1 - s))
        a, b = np.nonzero(kept)
        tails.append(own[a])
        heads.append(c[a, b])
    a, b = np.concatenate(tails), np.concatenate(heads)
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    # tie in what the medoid can't reach, each time by the closest pair of a thing out there
    reached, new = np.zeros(n, bool), np.array([_medoid(x)])
    while True:
        reached[new] = True
        while len(new):
            new = np.unique(b[np.isin(a, new) & ~reached[b]])
            reached[new] = True
        if reached.all():
            return a, b
        inside, out = np.flatnonzero(reached), int(np.flatnonzero(~reached)[0])
        to = inside[(x[inside] @ x[out]).argmax()]
        a, b = np.concatenate([a, [to, out]]), np.concatenate([b, [out, to]])
        new = np.array([out])


def _graph(nodes: DataFrame, kind: str) -> DataFrame:
    """id, edges of all nodes: the united adjacency lists of nodes(cluster, salt, id, home, blob, radius).

    An edge has the node it leads to, that node's home and off, the angle between both nodes less that node's radius.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        x = _unit_rows(table["blob"].combine_chunks(), kind)
        a, b = _edges(x, np.random.default_rng(len(table)))
        ids, homes = table["id"].to_numpy(), table["home"].to_numpy()
        turn = np.arccos(np.clip(np.einsum("nd,nd->n", x[a], x[b]), -1, 1))
        return pa.table({"id": ids[a], "to": ids[b], "home": homes[b], "off": turn - table["radius"].to_numpy()[b]})

    edges = nodes.groupBy("cluster", "salt").applyInArrow(run, "id long, to long, home int, off double")
    edges = edges.groupBy("id", "to", "home").agg(F.min("off").alias("off"))
    return edges.groupBy("id").agg(F.collect_list(F.struct("to", "home", "off")).alias("edges"))


def _found(x: np.ndarray, medoid: int, adjacency: np.ndarray, q: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Similarity of queries (rows) to the nodes met (-inf: not met): greedy from the medoid, then on through all nodes of at least ``bound`` (query, node)."""
    met = np.full((len(q), len(x)), -np.inf)
    met[:, medoid] = q @ x[medoid]
    todo = met.copy()
    beam = np.full((len(q), BEAM), -np.inf)
    beam[:, 0] = met[:, medoid]
    active = np.arange(len(q))
    while True:
        at = todo[active].argmax(1)
        best = todo[active, at]
        # what is in range is expanded wherever it stands in the order
        on = (best > -np.inf) & ((best >= beam[active].min(1)) | (best >= bound[active]))
        active, at = active[on], at[on]
        if not len(active):
            return met
        todo[active, at] = -np.inf
        to = adjacency[at]
        new = (to >= 0) & (met[active[:, None], to] == -np.inf)
        row, col = np.nonzero(new)
        own, node = active[row], to[row, col]
        s = np.einsum("nd,nd->n", q[own], x[node])
        met[own, node] = todo[own, node] = s
        fresh = np.full(to.shape, -np.inf)
        fresh[row, col] = s
        beam[active] = np.partition(np.concatenate([beam[active], fresh], 1), -BEAM, 1)[:, -BEAM:]


_FOUND = "q long, id long, cosine double, sure boolean, q_size long, size long, q_node long, node long, cluster int"


def _searched(graph: DataFrame, queries: DataFrame, kind: str, cosine: float) -> DataFrame:
    """What queries(id, blob, radius, size, node, cluster) find in the shards of their cluster: a row for each pair of balls that may hold a link, and one for each cluster (id null) that edges lead to."""
    theta = math.acos(cosine)

    def run(nodes: pa.Table, queries: pa.Table) -> pa.Table:
        out = {c: [] for c in ("q", "id", "cosine", "sure", "q_size", "size", "q_node", "node", "cluster")}
        if len(nodes) and len(queries):
            nodes = nodes.sort_by("id")
            x = _unit_rows(nodes["blob"].combine_chunks(), kind)
            ids, radius, size, node, here = (nodes[c].to_numpy() for c in ("id", "radius", "size", "node", "cluster"))
            edges = nodes["edges"].combine_chunks()
            tail = pa.compute.list_parent_indices(edges).to_numpy()
            flat = edges.flatten()
            to, home, off = (flat.field(c).to_numpy() for c in ("to", "home", "off"))
            place = np.searchsorted(ids, to)
            inside = (place < len(ids)) & (ids[np.minimum(place, len(ids) - 1)] == to)
            # cells of the adjacency table: the place of an edge within its list
            rank = np.arange(len(tail)) - np.searchsorted(tail, tail)
            adjacency = np.full((len(ids), int(rank.max()) + 1 if len(rank) else 1), -1)
            adjacency[tail[inside], rank[inside]] = place[inside]
            cross = ~inside & (home != here[0])
            leads = np.split(np.flatnonzero(cross), np.cumsum(np.bincount(tail[cross], minlength=len(ids)))[:-1])
            medoid, widest = _medoid(x), radius.max()
            for i in range(0, len(queries), QUERIES):
                part = queries.slice(i, QUERIES)
                q = _unit_rows(part["blob"].combine_chunks(), kind)
                q_id, q_radius, q_size, q_node = (part[c].to_numpy() for c in ("id", "radius", "size", "node"))
                met = _found(x, medoid, adjacency, q, np.cos(np.minimum(theta + q_radius + widest + MARGIN, math.pi)))
                a, b = np.nonzero(met >= np.cos(np.minimum(theta + q_radius[:, None] + radius[None, :] + MARGIN, math.pi)) - 1e-12)
                # an edge that turns off farther than the range can't end in it
                reach = np.arccos(np.clip(met[a, b], -1, 1)) + theta + q_radius[a] + MARGIN
                on = np.unique(np.array([(q_id[r], home[e]) for r, k, far in zip(a, b, reach) for e in leads[k] if off[e] <= far], np.int64).reshape(-1, 2), axis=0)
                other = q_id[a] != ids[b]
                a, b = a[other], b[other]
                s = met[a, b]
                points = (q_radius[a] == 0) & (radius[b] == 0)
                hit = ~points | (s >= cosine)
                a, b, s, points = a[hit], b[hit], s[hit], points[hit]
                sure = points | (np.arccos(np.clip(s, -1, 1)) + q_radius[a] + radius[b] <= theta - MARGIN)
                none, gone = [None] * len(on), [None] * len(a)
                for c, values, rest in (("q", q_id[a], on[:, 0]), ("id", ids[b], none), ("cosine", s, none), ("sure", sure, none), ("q_size", q_size[a], none), ("size", size[b], none), ("q_node", q_node[a], none), ("node", node[b], none), ("cluster", gone, on[:, 1])):
                    out[c] += [*(values.tolist() if isinstance(values, np.ndarray) else values), *(rest.tolist() if isinstance(rest, np.ndarray) else rest)]
        kinds = {"cosine": pa.float64(), "sure": pa.bool_(), "cluster": pa.int32()}
        return pa.table({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()})

    # every shard of a cluster meets every block of its queries
    blocks = queries.groupBy("cluster").agg(F.ceil(F.count("*") / (4 * QUERIES)).cast("int").alias("blocks"))
    parts = graph.groupBy("cluster").agg((F.max("salt") + 1).cast("int").alias("parts"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    q = queries.join(F.broadcast(blocks.join(parts, "cluster")), "cluster")
    q = q.withColumns({"block": block, "salt": F.explode(F.sequence(F.lit(0), F.col("parts") - 1))}).drop("blocks", "parts")
    g = graph.join(F.broadcast(blocks), "cluster").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    key = ("cluster", "salt", "block")
    return g.groupBy(*key).cogroup(q.groupBy(*key)).applyInArrow(run, _FOUND)


def _true_pairs(nodes: DataFrame, kind: str, cosine: float) -> DataFrame:
    """(q, id) of the audit's queries by brute force: all nodes of at least that cosine to one of ``AUDIT`` nodes drawn by hash."""
    drawn = nodes.select("id", "blob").orderBy(F.xxhash64("id"), "id").limit(AUDIT).toArrow()
    shared = nodes.sparkSession.sparkContext.broadcast((drawn["id"].to_numpy(), drawn["blob"].combine_chunks().to_pylist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, blobs = shared.value
        asked = _units(pa.array(blobs, pa.binary()), kind)
        for batch in batches:
            own = batch.column("id").to_numpy()
            for dim, (rows, x) in _units(batch.column("blob"), kind).items():
                if dim in asked:
                    a, b = np.nonzero(asked[dim][1] @ x.T >= cosine)
                    q, found = ids[asked[dim][0]][a], own[rows][b]
                    yield pa.RecordBatch.from_arrays([pa.array(q[q != found]), pa.array(found[q != found])], names=["q", "id"])

    return nodes.select("id", "blob").mapInArrow(run, "q long, id long")


def _pairs(found: list[DataFrame]) -> DataFrame:
    """a < b of all found pairs of balls, whichever of the two found the other."""
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionAll(more)
    turned = F.col("q") > F.col("id")
    way = lambda c, d: F.when(turned, F.col(d)).otherwise(F.col(c))
    d = rows.where("id is not null").select(way("q", "id").alias("a"), way("id", "q").alias("b"), "sure", way("q_size", "size").alias("a_size"), way("size", "q_size").alias("b_size"), way("q_node", "node").alias("a_node"), way("node", "q_node").alias("b_node"))
    first = lambda c: F.max(c).alias(c)
    return d.groupBy("a", "b").agg(F.min("sure").alias("sure"), *map(first, ("a_size", "b_size", "a_node", "b_node")))


def _verified(pairs: DataFrame, members: DataFrame, kind: str, cosine: float) -> DataFrame:
    """cls, n (rows linked to it) and one a_node, b_node (cls null) for each block that links pairs(a, b, a_node, b_node) of balls.

    members(ball, cls, m, blob, members) come in blocks of ``BLOCK`` bytes, so two balls of any size are many rows.
    """
    each = F.ceil(F.col("members") * F.length("blob") / BLOCK)
    blocks = members.withColumn("block", F.pmod(F.xxhash64("cls"), each)).groupBy("ball", "block").agg(F.collect_list(F.struct("cls", "m", "blob")).alias("rows")).drop("block")
    d = pairs.join(blocks.withColumnsRenamed({"ball": "a", "rows": "x"}), "a").join(blocks.withColumnsRenamed({"ball": "b", "rows": "y"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                x, y = (batch.column(c)[r].values for c in ("x", "y"))
                close = _unit_rows(x.field("blob"), kind) @ _unit_rows(y.field("blob"), kind).T >= cosine
                if close.any():
                    n = [close @ y.field("m").to_numpy(), x.field("m").to_numpy() @ close]
                    cls, n = np.concatenate([x.field("cls").to_numpy(), y.field("cls").to_numpy()]), np.concatenate(n)
                    none = [None] * int((n > 0).sum())
                    yield pa.RecordBatch.from_arrays([pa.array([*cls[n > 0].tolist(), None], pa.int64()), pa.array([*n[n > 0].tolist(), None], pa.int64()), *[pa.array([*none, batch.column(c)[r].as_py()], pa.int64()) for c in ("a_node", "b_node")]], names=["cls", "n", "a_node", "b_node"])

    return d.select("a_node", "b_node", "x", "y").mapInArrow(run, "cls long, n long, a_node long, b_node long")


def near_vectors(rows: DataFrame, cosine: float = 0.9, vector: str = "embedding") -> tuple[DataFrame, float]:
    """(vec_id, n_links, component_id, kept) of every row, and the audited recall.

    n_links: other rows linked directly; component_id: the smallest vec_id reachable by
    links, itself included; kept: it is its own.  Vectors that are null, empty, zero or
    hold a null or non-finite component link with nothing, and vectors link with those
    of their own dimension only.  Equal vectors link.  Rows with the same vec_id are
    vectors of their own with one component; a null vec_id stays alone, without a
    component and kept.  An empty table gives no rows; other columns are ignored.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    kind = "<f4" if rows.schema[vector].dataType.simpleString() == "array<float>" else "<f8"
    half = math.acos(cosine) / 2 - MARGIN
    read = vectors(rows, vector)
    known = read.where("d1 is not null")
    total = known.count()
    sample = [r.blob for r in known.select("vec_id", "d1", "blob").orderBy(F.xxhash64("vec_id", "d1")).limit(SAMPLE).select("blob").toLocalIterator()]
    centroids, dense = _fitted(sample, kind, max(len(sample), 1) / max(total, 1), half)

    classes = known.groupBy("d1", "d2").agg(F.first("blob").alias("blob"), F.count("*").alias("m"), F.min("vec_id").alias("node")).withColumn("cls", F.monotonically_increasing_id())
    classes = materialise(_placed(classes, kind, centroids, dense, 1, half), "classes")
    # balls of dense places have numbers below 0
    joined = classes.where("place is not null").select("cls", (-1 - F.col("place")).alias("ball"), "m", "node", "blob", "off")
    alone = materialise(_balls(classes.where("place is null"), kind, half), "balls")
    places = joined.groupBy("ball").agg(F.sum("m").alias("size"), F.max("off").alias("radius"), F.min("node").alias("node"), F.count("*").alias("members"))
    size = np.dtype(kind).itemsize
    middles = [(-1 - first - k, c.astype(kind).tobytes()) for first, matrix in dense.values() for k, c in enumerate(matrix)]
    places = places.join(F.broadcast(spark.createDataFrame(middles, "ball long, blob binary")), "ball")
    # the middle was rounded to the vectors' own precision
    slack = F.when(F.lit(size == 4), F.lit(MARGIN / 4)).otherwise(F.lit(0.0))
    leaders = places.select(F.col("ball").alias("id"), "blob", (F.col("radius") + slack).alias("radius"), "size", "node", "members")
    leaders = leaders.unionAll(alone.where("cls = ball").select(F.col("ball").alias("id"), "blob", "radius", "size", F.col("least").alias("node"), "members"))
    clusters = sum(len(c) for _, c in centroids.values()) or 1
    width = min(2, clusters)
    leaders = materialise(_placed(leaders, kind, centroids, {}, width, half).drop("place", "off"), "leaders")

    of = leaders.select("id", "blob", "radius", "size", "node", F.col("near")[0].alias("home"), F.explode("near").alias("cluster"))
    members = _dealt(of, "cluster", 2 * SHARD).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    edges = _graph(members, kind)
    none = F.array().cast("array<struct<to:bigint,home:int,off:double>>")
    graph = materialise(members.join(edges, "id", "left").withColumn("edges", F.coalesce("edges", none)), "graph")

    truth = materialise(_true_pairs(leaders, kind, cosine), "audit")
    found, visits = [], []
    while True:
        asked = _placed(leaders.drop("near"), kind, centroids, {}, width, half).select("id", F.explode("near").alias("cluster"))
        while True:
            for seen in visits:
                asked = asked.join(seen, ["id", "cluster"], "left_anti")
            asked = materialise(asked, "asked")
            if asked.isEmpty():
                break
            visits.append(asked)
            queries = leaders.drop("near", "members").join(asked, "id")
            found.append(materialise(_searched(graph, queries, kind, cosine), "found"))
            asked = found[-1].where("id is null").select(F.col("q").alias("id"), "cluster").distinct()
        pairs = materialise(_pairs(found), "pairs") if found else None
        if pairs is None:
            recall = 1.0
            break
        hits = truth.withColumns({"a": F.least("q", "id"), "b": F.greatest("q", "id")}).join(pairs.select("a", "b", F.lit(1).alias("hit")), ["a", "b"], "left").agg(F.count("*"), F.count("hit")).first()
        recall = hits[1] / hits[0] if hits[0] else 1.0
        if recall >= MIN_RECALL or width >= clusters:
            break
        width = min(2 * width, clusters)
        release(pairs)

    d1 = classes.select("cls", "d1", "d2")
    whole = joined.select("cls", "ball", "m").join(leaders.select(F.col("id").alias("ball"), "size", F.col("node").alias("ball_node"), "members"), "ball")
    whole = whole.unionByName(alone.select("cls", "ball", "m").join(leaders.select(F.col("id").alias("ball"), "size", F.col("node").alias("ball_node"), "members"), "ball"))
    if pairs is not None:
        sure, border = pairs.where("sure"), pairs.where("not sure")
        by_ball = sure.select(F.col("a").alias("ball"), F.col("b_size").alias("n")).unionAll(sure.select("b", "a_size")).groupBy("ball").agg(F.sum("n").alias("ball_links"))
        blobs = joined.select("cls", "ball", "m", "blob").unionAll(alone.select("cls", "ball", "m", "blob")).join(leaders.select(F.col("id").alias("ball"), "members"), "ball")
        blobs = blobs.join(border.select(F.col("a").alias("ball")).unionAll(border.select("b")).distinct(), "ball", "left_semi")
        checked = materialise(_verified(border, blobs, kind, cosine), "checked")
        by_cls = checked.where("cls is not null").groupBy("cls").agg(F.sum("n").alias("cls_links"))
        whole = whole.join(by_ball, "ball", "left").join(by_cls, "cls", "left")
        links = sure.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).unionAll(checked.where("cls is null").select("a_node", "b_node").distinct())
    else:
        whole = whole.withColumns({"ball_links": F.lit(0).cast("long"), "cls_links": F.lit(0).cast("long")})
        links = spark.createDataFrame([], "a long, b long")
    n = F.col("size") - 1 + F.coalesce("ball_links", F.lit(0)) + F.coalesce("cls_links", F.lit(0))
    whole = materialise(whole.join(d1, "cls").select("d1", "d2", n.alias("n"), "ball_node"), "links")
    each = read.select("vec_id", "d1", "d2").join(whole, ["d1", "d2"], "left")
    # rows of one vec_id in several balls link those
    several = each.where("vec_id is not null").withColumn("ball_node", F.coalesce("ball_node", "vec_id")).groupBy("vec_id").agg(F.min("ball_node").alias("a"), F.max("ball_node").alias("b")).where("a < b")
    several = each.join(several.select("vec_id", "a"), "vec_id").select("a", F.coalesce("ball_node", "vec_id").alias("b")).where("a < b").distinct()
    roots = components(links.unionAll(several))
    release(classes, alone, graph, truth, *found, *visits)
    out = each.withColumn("node", F.coalesce("ball_node", "vec_id")).join(roots, "node", "left")
    component = F.coalesce("root", "node")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept")), recall

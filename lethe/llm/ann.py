"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard.

Equal vectors are one class, of which the smallest ids are kept (no search can
return more of them).  Classes are dealt over shards by hash.  In each shard a
graph is built: a greedy search over the graph so far proposes neighbours of a
batch of points, relaxed distance pruning keeps a diverse few, and reverse edges
are added and pruned alike.  Searches begin at many entry points, spread so that
no cluster is without one; points that no path leads to from there get a link,
which pruning never drops.  A beam search queries every shard's graph; found
classes are scored again on the original vectors in double precision.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import per_batch  # noqa: F401  (registers this package's functions for the executors)
from .common import materialize, pick

K = 10
#: Neighbours of a point, beam while building and while querying, relaxation of pruning.
DEGREE, BUILD_BEAM, QUERY_BEAM, ALPHA = 24, 48, 128, 1.2
#: Entry points of a graph: ENTRIES times the root of its points.  Links a point can have besides its neighbours.
ENTRIES, LINKS = 4, 8
#: Vectors a shard holds: 1/64 of all between these bounds, and no more than SHARD_BYTES.
SHARD_LEAST, SHARD_MOST, SHARD_BYTES = 4096, 131_072, 128 << 20
#: Queries one search task takes, and their bytes; the index is sent once for each block of them.
QUERY_BLOCK, QUERY_BYTES = 65_536, 64 << 20
#: Points searched or pruned together, and cells of the table of visited points.
BATCH, CELLS = 256, 1 << 22
EXPAND = 4


#: Components beyond this have squared distances that single precision may not hold.
SINGLE_MOST = 1e18


def precision(*arrays: np.ndarray) -> type:
    """The type to search ``arrays`` in: single precision, double where a component is too large for it."""
    return np.float64 if any(np.abs(a).max(initial=0.0) > SINGLE_MOST for a in arrays) else np.float32


def squared(x: np.ndarray, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of x[ids[i, j]] to q[i]."""
    diff = x[ids] - q[:, None, :]
    return np.einsum("qrd,qrd->qr", diff, diff)


def nearest_of(x: np.ndarray, some: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` of the points ``some`` that lie nearest to each row of q, about (rounding may err)."""
    norm = np.einsum("sd,sd->s", x[some], x[some])
    d = norm[None, :] - 2 * (q @ x[some].T)
    if k >= len(some):
        return np.broadcast_to(some, (len(q), len(some)))
    return some[np.argpartition(d, k, axis=1)[:, :k]]


def beam_search(x: np.ndarray, graph: np.ndarray, q: np.ndarray, starts: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids (-1: none) and squared distances of the ``beam`` nearest points met from the nearest
    of ``starts`` by always expanding the nearest unexpanded ones, for all rows of q."""
    n, m = len(x), len(q)
    rows = np.arange(m)[:, None]
    ids = np.full((m, beam), -1, np.int64)
    dist = np.full((m, beam), np.inf, x.dtype)
    fresh = np.zeros((m, beam), bool)
    first = nearest_of(x, starts, q, min(beam, 16))
    k = first.shape[1]
    ids[:, :k], dist[:, :k], fresh[:, :k] = first, squared(x, first, q), True
    stamp = np.full((m, n), -1, np.int32)
    seen = np.zeros((m, n), bool)
    seen[rows, first] = True
    while fresh.any():
        order = np.argsort(np.where(fresh, dist, np.inf), axis=1)[:, :EXPAND]
        taken = fresh[rows, order]
        fresh[rows, order] = False
        near = graph[np.where(taken, ids[rows, order], 0)].reshape(m, -1)
        near = np.where(np.repeat(taken, graph.shape[1], axis=1), near, -1)
        new = (near >= 0) & ~seen[rows, near]
        place = np.broadcast_to(np.arange(near.shape[1], dtype=np.int32), near.shape)
        r, c = np.nonzero(new)
        stamp[r, near[r, c]] = place[r, c]  # of repeats the last stays
        keep = stamp[r, near[r, c]] == c
        r, c = r[keep], c[keep]
        seen[r, near[r, c]] = True
        d = np.full(near.shape, np.inf, x.dtype)
        diff = x[near[r, c]] - q[r]
        d[r, c] = np.einsum("id,id->i", diff, diff)
        ids = np.concatenate([ids, near], axis=1)
        dist = np.concatenate([dist, d], axis=1)
        fresh = np.concatenate([fresh, np.isfinite(d)], axis=1)
        best = np.argsort(dist, axis=1, kind="stable")[:, :beam]
        ids, dist, fresh = ids[rows, best], dist[rows, best], fresh[rows, best]
    return np.where(np.isfinite(dist), ids, -1), dist


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, alpha: float) -> np.ndarray:
    """Up to DEGREE diverse neighbours (-1: none) of each point among its candidates (-1: none).

    The nearest candidate left is kept, and those that lie ``alpha`` times nearer
    to it than to the point are dropped.
    """
    m, width = candidates.shape
    rows = np.arange(m)
    d = squared(x, np.maximum(candidates, 0), x[points])
    alive = (candidates >= 0) & (candidates != points[:, None])
    order = np.argsort(np.where(alive, d, np.inf), axis=1, kind="stable")
    candidates, d, alive = candidates[rows[:, None], order], d[rows[:, None], order], alive[rows[:, None], order]
    alive[:, 1:] &= candidates[:, 1:] != candidates[:, :-1]  # repeats of a point lie side by side
    v = x[np.maximum(candidates, 0)]
    norm = np.einsum("qcd,qcd->qc", v, v)
    between = norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    out = np.full((m, DEGREE), -1, np.int64)
    for k in range(DEGREE):
        first = alive.argmax(axis=1)
        any_left = alive[rows, first]
        if not any_left.any():
            break
        out[any_left, k] = candidates[rows, first][any_left]
        alive &= alpha * alpha * between[rows, first] > d
        alive[rows, first] = False
    return out


def _add_reverse(x: np.ndarray, graph: np.ndarray, points: np.ndarray, alpha: float) -> None:
    """For every edge from ``points``, add the edge back; prune where a list runs over."""
    to, place = np.nonzero(graph[points] >= 0)
    if not len(to):
        return
    heads, tails = graph[points][to, place], points[to]
    order = np.argsort(heads, kind="stable")
    heads, tails = heads[order], tails[order]
    cut = np.nonzero(np.append(True, heads[1:] != heads[:-1]))[0]
    sizes = np.diff(np.append(cut, len(heads)))
    for at in range(0, len(cut), BATCH):
        part, many = cut[at:at + BATCH], sizes[at:at + BATCH]
        nodes = heads[part]
        extra = np.full((len(part), many.max()), -1, np.int64)
        for i, (a, k) in enumerate(zip(part, many)):
            extra[i, :k] = tails[a:a + k]
        both = np.concatenate([graph[nodes], extra], axis=1)
        have = np.sort(np.where(both >= 0, both, np.iinfo(np.int64).max), axis=1)
        have[:, 1:][have[:, 1:] == have[:, :-1]] = np.iinfo(np.int64).max
        have.sort(axis=1)
        counts = (have < np.iinfo(np.int64).max).sum(axis=1)
        have[have == np.iinfo(np.int64).max] = -1
        fits = counts <= DEGREE
        wide = np.full((int(fits.sum()), DEGREE), -1, np.int64)
        w = min(DEGREE, have.shape[1])
        wide[:, :w] = have[fits, :w]
        graph[nodes[fits]] = wide
        if not fits.all():
            graph[nodes[~fits]] = robust_prune(x, nodes[~fits], have[~fits], alpha)


def entry_points(x: np.ndarray, k: int) -> np.ndarray:
    """``k`` points: half at random, half each the farthest from all before it."""
    n = len(x)
    chosen = np.random.default_rng(11).permutation(n)[:min(n, max(1, k // 2))].tolist()
    norm = np.einsum("nd,nd->n", x, x)

    def gap(i: int) -> np.ndarray:
        return norm - 2 * (x @ x[i]) + norm[i]

    nearest = np.full(n, np.inf, x.dtype)
    for i in chosen:
        np.minimum(nearest, gap(i), out=nearest)
    while len(chosen) < min(n, k):
        nearest[chosen] = -np.inf
        chosen.append(int(nearest.argmax()))
        np.minimum(nearest, gap(chosen[-1]), out=nearest)
    return np.unique(np.array(chosen, np.int64))


def unreached(graph: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The points that no path leads to from ``starts``."""
    met = np.zeros(len(graph), bool)
    met[starts] = True
    edge = starts
    while len(edge):
        to = np.unique(graph[edge])
        edge = to[(to >= 0)]
        edge = edge[~met[edge]]
        met[edge] = True
    return np.flatnonzero(~met)


def build_graph(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lists of neighbours and links, entry points) for the rows of ``x``; every row can be reached."""
    x = np.ascontiguousarray(x, precision(x))
    n = len(x)
    graph = np.full((n, DEGREE), -1, np.int64)
    starts = entry_points(x, int(ENTRIES * np.sqrt(n)) + 1)
    order = np.random.default_rng(7).permutation(n)
    order = np.concatenate([starts, order[~np.isin(order, starts)]])
    batch = max(1, min(BATCH, CELLS // max(1, n)))

    def place(points: np.ndarray) -> None:
        found, _ = beam_search(x, graph, x[points], starts, BUILD_BEAM)
        graph[points] = robust_prune(x, points, np.concatenate([found, graph[points]], axis=1), ALPHA)
        _add_reverse(x, graph, points, ALPHA)

    at = 1
    while at < n:  # batches no larger than the graph they search
        to = min(n, at + min(at, batch))
        place(order[at:to])
        at = to
    for at in range(0, n, batch):
        place(order[at:at + batch])
    whole = np.concatenate([graph, np.full((n, LINKS), -1, np.int64)], axis=1)
    used = np.zeros(n, np.int64)
    left = unreached(whole, starts)
    while len(left):  # each gets a link from the nearest reached point that has room for one
        some = left[:batch]
        found, _ = beam_search(x, whole, x[some], starts, QUERY_BEAM)
        for point, near in zip(some.tolist(), found):
            near = near[near >= 0]
            near = near[(used[near] < LINKS) & (near != point)]
            if len(near):
                whole[near[0], DEGREE + used[near[0]]] = point
                used[near[0]] += 1
            else:
                starts = np.append(starts, point)
        left = unreached(whole, starts)
    return whole, starts


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("first_id", kind="stable")
    x = np.stack(pdf["vec"].to_numpy())
    graph, starts = build_graph(x)
    ids = pdf["ids"].tolist()
    ends = np.cumsum([len(i) for i in ids])
    return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "shard": [pdf["shard"].iloc[0]], "starts": [starts.astype("<i8").tobytes()], "vecs": [x.astype("<f8").tobytes()],
                         "graph": [graph.astype("<i4").tobytes()], "ids": [np.concatenate(ids).astype("<i8").tobytes()],
                         "ends": [ends.astype("<i8").tobytes()]})


def _search(key: tuple, index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "query_no": pd.Series(dtype="int64"),
                         "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    if not len(index) or not len(queries):
        return none
    row = index.iloc[0]
    ids, ends = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["ends"], "<i8")
    begins = np.append(0, ends[:-1])
    x = np.frombuffer(row["vecs"], "<f8").reshape(len(ends), -1)
    graph = np.frombuffer(row["graph"], "<i4").reshape(len(ends), -1).astype(np.int64)
    q = np.stack(queries["vec"].to_numpy())
    kind = precision(x, q)
    near = x.astype(kind)
    starts = np.frombuffer(row["starts"], "<i8")
    step = max(1, min(BATCH, CELLS // len(x)))
    out = []
    for at in range(0, len(q), step):
        found, _ = beam_search(near, graph, q[at:at + step].astype(kind), starts, QUERY_BEAM)
        for i, f in enumerate(found):
            f = f[f >= 0]
            own = queries["query_id"].iat[at + i]
            score = np.sqrt(((x[f] - q[at + i]) ** 2).sum(axis=1))
            best = np.argsort(score, kind="stable")[:K + 1]
            held = [(s, v) for s, c in zip(score[best].tolist(), f[best]) for v in ids[begins[c]:ends[c]].tolist()
                    if v != own or (x[c] != q[at + i]).any()]  # the query's own row, not others of its id
            out += [(own, queries["query_no"].iat[at + i], v, s) for s, v in sorted(held)[:K]]
    return pd.DataFrame(out, columns=list(none.columns)) if out else none


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec, dim) of the distinct rows that take part: id and vector not null,
    every component finite, not all zero; negative zeros become zeros."""
    v = pick(vectors, "vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    v = v.withColumn("vec", F.transform(F.col("embedding").cast("array<double>"), lambda c: c + F.lit(0.0)))
    finite = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    v = v.filter(finite & F.exists("vec", lambda c: c != 0.0))
    return v.select("vec_id", "vec", F.size("vec").alias("dim")).distinct()


def build_index(vectors: DataFrame) -> DataFrame:
    """One row per shard with its vectors, ids and graph, over every usable row."""
    rows = usable(vectors)
    order = Window.partitionBy("vec").orderBy("vec_id")
    few = rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= K + 1)
    classes = materialize(few.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(
        "vec", F.size("vec").alias("dim"), "ids", F.col("ids")[0].alias("first_id")), "ann-classes")
    counts = classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "shards", F.ceil(F.col("n") / F.greatest(F.lit(1), F.least(
            F.greatest(F.lit(SHARD_LEAST), F.least(F.lit(SHARD_MOST), F.floor(F.col("n") / 64))),
            F.floor(F.lit(SHARD_BYTES) / (8 * F.greatest("dim", F.lit(1))))))).cast("int"))
    dealt = classes.join(F.broadcast(counts.select("dim", "shards")), "dim").withColumn(  # one row per vector length
        "shard", F.pmod(F.xxhash64("vec"), F.col("shards")).cast("int"))
    schema = "dim int, shard int, starts binary, vecs binary, graph binary, ids binary, ends binary"
    return materialize(dealt.select("dim", "shard", "vec", "ids", "first_id").groupBy("dim", "shard").applyInPandas(_build, schema), "ann-index")


def search(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, rank, vec_id, score) of the K nearest found for every usable row of ``queries``."""
    q = usable(queries).select(F.col("vec_id").alias("query_id"), "vec", "dim").withColumn("query_no", F.xxhash64("vec"))
    q = materialize(q, "ann-queries")
    n, dim = q.agg(F.count(F.lit(1)), F.coalesce(F.max("dim"), F.lit(1))).first()
    blocks = max(1, -(-n // max(1, min(QUERY_BLOCK, QUERY_BYTES // (8 * dim)))))
    shards = index.select("dim", "shard").groupBy("dim").agg(F.collect_list("shard").alias("shards"))
    asked = q.join(F.broadcast(shards), "dim").withColumn("block", F.pmod(F.xxhash64("query_id", "query_no"), F.lit(blocks)).cast("int"))
    asked = asked.select("dim", F.explode("shards").alias("shard"), "block", "query_id", "query_no", "vec")
    parts = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = parts.groupBy("dim", "shard", "block").cogroup(asked.groupBy("dim", "shard", "block")).applyInPandas(
        _search, "query_id long, query_no long, vec_id long, score double")
    best = Window.partitionBy("query_id", "query_no").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= K).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_ann(vectors: DataFrame) -> DataFrame:
    """The K nearest of every row whose vec_id is divisible by 100 among all other rows.

    Vectors that are null, zero or hold a null or non-finite component take no part,
    nor do rows without vec_id; only vectors of equal length are compared; rows that
    repeat id and vector count once, rows that share an id only are rows of their own.
    An empty table gives an empty result; other columns are left aside.
    """
    known = pick(vectors, "vec_id", "embedding")
    return search(build_index(known), known.filter(F.col("vec_id") % 100 == 0))

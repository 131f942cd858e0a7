"""Approximate nearest neighbours over robust-pruned directed graphs.

Equal vectors are collapsed first. Distinct vectors are dealt to a bounded
number of cells by the nearest centre and, inside a cell, to shards of bounded
size by hash; each shard builds its own graph: points enter in random
batches, a greedy beam search from the medoid proposes neighbours, and a
relaxed pruning keeps an edge only if no kept neighbour is closer to the
target by the factor alpha, so edges stay diverse and few. Queries are beam
searched in every shard of their nearest cells, and the best of these shards
are ranked by the exact distance. Graphs are built once and written; a task
holds one shard and one block of queries. Searches of many points advance in lockstep, so numpy does the work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm._util import Workspace


def _search(
    X: np.ndarray, graph: np.ndarray, starts: np.ndarray, queries: np.ndarray, beam: int, trail: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Beam search of many queries at once.

    Returns ids and squared distances of each beam (-1 and inf where empty),
    nearest first, and the ids expanded on the way (-1 padded) if asked for.
    """
    n, (m, _) = len(X), queries.shape
    ids = np.full((m, beam), -1, np.int64)
    dist = np.full((m, beam), np.inf, np.float32)
    open_ = np.zeros((m, beam), bool)
    # Differences, not norms and products: those can't tell the points of a tight cluster apart.
    first = ((queries[:, None] - X[starts][None]) ** 2).sum(2)
    order = np.argsort(first, axis=1, kind="stable")[:, :beam]
    held = order.shape[1]
    ids[:, :held], dist[:, :held], open_[:, :held] = starts[order], np.take_along_axis(first, order, 1), True
    seen = np.zeros((m, n), bool)
    seen[:, starts] = True
    visited: list[np.ndarray] = []
    rows = np.arange(m)
    while len(rows):
        at = np.argmax(open_[rows], axis=1)  # beams are sorted: the nearest open point
        going = open_[rows, at]
        rows, at = rows[going], at[going]
        if not len(rows):
            break
        open_[rows, at] = False
        here = ids[rows, at]
        if trail:
            step = np.full(m, -1, np.int64)
            step[rows] = here
            visited.append(step)
        near = graph[here]
        fresh = (near >= 0) & ~seen[rows[:, None], near]
        # An id may stand twice in a row of the graph only as -1.
        r, c = np.nonzero(fresh)
        to = near[r, c]
        seen[rows[r], to] = True
        d = np.full(near.shape, np.inf, np.float32)
        gap = X[to] - queries[rows[r]]
        d[r, c] = np.einsum("ij,ij->i", gap, gap)
        all_d = np.concatenate([dist[rows], d], axis=1)
        all_i = np.concatenate([ids[rows], np.where(fresh, near, -1)], axis=1)
        all_o = np.concatenate([open_[rows], fresh], axis=1)
        best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        take = lambda a: np.take_along_axis(a, best, axis=1)
        dist[rows], ids[rows], open_[rows] = take(all_d), take(all_i), take(all_o)
    path = np.stack(visited, axis=1) if visited else np.zeros((m, 0), np.int64)
    return ids, dist, path


def _prune(X: np.ndarray, point: int, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning: nearest first, dropping what a kept neighbour covers."""
    cand = np.unique(candidates[(candidates >= 0) & (candidates != point)])
    if not len(cand):
        return cand
    V = X[cand] - X[point]
    d = np.einsum("ij,ij->i", V, V)
    order = np.argsort(d, kind="stable")
    cand, V, d = cand[order], V[order], d[order]
    between = np.maximum(0, d[:, None] - 2 * V @ V.T + d[None])
    alive, kept = np.ones(len(cand), bool), []
    for i in range(len(cand)):
        if alive[i]:
            kept.append(i)
            if len(kept) == degree:
                break
            alive &= alpha * alpha * between[i] > d
    return cand[kept]


def build_graph(
    X: np.ndarray, degree: int = 32, beam: int = 48, alpha: float = 1.2, batch: int = 256, seed: int = 1, entries: int = 32
) -> tuple[np.ndarray, np.ndarray]:
    """Edges (n x degree, -1 padded) and the start points.

    The starts are the medoid and random points: from inside a large tight
    cluster, whose points fill each other's edges, a search finds no way out.
    """
    n = len(X)
    rng = np.random.default_rng(seed)
    medoid = int(((X - X.mean(0)) ** 2).sum(1).argmin())
    start = np.unique(np.r_[medoid, rng.choice(n, min(n, entries), replace=False)])
    graph = np.full((n, degree), -1, np.int64)
    for i in range(n if n <= degree else 0):
        others = np.delete(np.arange(n), i)
        graph[i, : len(others)] = others
    if n <= degree:
        return graph, start
    order = np.r_[start, rng.permutation(np.setdiff1d(np.arange(n), start))]
    done = len(start)
    for alpha_now in (1.0, alpha):
        at = 0
        while at < n:
            # Early batches are small: a search must find points to link to.
            size = min(batch, max(len(start), at)) if alpha_now == 1.0 else batch
            part = order[at : at + size]
            ids, _, path = _search(X, graph, start, X[part], beam, True)
            incoming: dict[int, list[int]] = {}
            for k, p in enumerate(part):
                mates = part if alpha_now == 1.0 and done < 4 * batch else part[:0]
                kept = _prune(X, p, np.concatenate([ids[k], path[k], graph[p], mates]), degree, alpha_now)
                graph[p] = -1
                graph[p, : len(kept)] = kept
                for q in kept:
                    incoming.setdefault(int(q), []).append(int(p))
            for q, new in incoming.items():
                have = graph[q][graph[q] >= 0]
                new_ids = np.setdiff1d(np.array(new), have)
                if len(have) + len(new_ids) <= degree:
                    graph[q, len(have) : len(have) + len(new_ids)] = new_ids
                else:
                    kept = _prune(X, q, np.concatenate([have, new_ids]), degree, alpha_now)
                    graph[q] = -1
                    graph[q, : len(kept)] = kept
            at += size
            done = max(done, at)
    return graph, start


def valid(vector: Column) -> Column:
    """Not null, not empty, all components finite and not all zero."""
    big = F.lit(float("inf"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == big)
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _scaled(V: np.ndarray) -> tuple[np.ndarray, float]:
    """Single-precision vectors and their scale, a power of two, which loses no digits."""
    scale = 2.0 ** np.floor(np.log2(np.abs(V).max()))
    return (V / scale).astype(np.float32), scale


def build_shards(points: DataFrame, degree: int, beam: int, alpha: float) -> DataFrame:
    """One row for each shard and dimension: ids, vectors, edges and start points, packed."""

    def build(pts: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for dim, part in pts.groupby("dim"):
            part = part.sort_values("rep")
            V = np.stack(part.v.to_numpy()).astype(np.float64)
            graph, starts = build_graph(_scaled(V)[0], degree, beam, alpha)
            rows.append((part.shard.iloc[0], dim, part.rep.to_numpy(np.int64).tobytes(), V.tobytes(), graph.astype(np.int32).tobytes(), starts.astype(np.int64).tobytes()))
        return pd.DataFrame(rows, columns=["shard", "dim", "reps", "vectors", "graph", "starts"])

    return points.select("shard", "rep", "v", "dim").groupBy("shard").applyInPandas(build, "shard long, dim int, reps binary, vectors binary, graph binary, starts binary")


def fit_centres(V: np.ndarray, cells: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """Centres of at most ``cells`` cells by k-means over a sample."""
    rng = np.random.default_rng(seed)
    C = V[rng.choice(len(V), min(cells, len(V)), replace=False)]
    for _ in range(rounds if len(C) > 1 else 0):
        near = _nearest_centres(V, C, 1)[:, 0]
        total, held = np.zeros_like(C), np.bincount(near, minlength=len(C))
        np.add.at(total, near, V)
        C = np.where(held[:, None] > 0, total / np.maximum(held, 1)[:, None], C)
    return C


def _nearest_centres(V: np.ndarray, C: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centres of each vector, in any order."""
    out = []
    for lo in range(0, len(V), 4096):
        d = (C * C).sum(1)[None] - 2 * V[lo : lo + 4096] @ C.T
        out.append(np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(C) else np.tile(np.arange(len(C)), (len(d), 1)))
    return np.concatenate(out) if out else np.zeros((0, k), np.int64)


def cells_to_search(V: np.ndarray, C: np.ndarray, k: int, covered: float, asked: int = 512) -> int:
    """How many nearest cells of a query hold the share ``covered`` of its k nearest vectors, by exact search in a sample.

    Neighbours in a sample lie farther off than those in all vectors, so this errs on the safe side.
    """
    Q = V[:asked]
    order = np.argsort((C * C).sum(1)[None] - 2 * Q @ C.T, axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(C))[None], axis=1)
    d = (V * V).sum(1)[None] - 2 * Q @ V.T
    d[np.arange(len(Q)), np.arange(len(Q))] = np.inf
    near = np.argsort(d, axis=1, kind="stable")[:, : min(k, len(V) - 1)]
    if not near.size:
        return len(C)
    ranks = np.take_along_axis(place, _nearest_centres(V, C, 1)[:, 0][near], axis=1)
    return int(np.quantile(ranks, covered, method="higher")) + 1


def in_cells(rows: DataFrame, vector: str, centres: dict[int, np.ndarray], k: dict[int, int] | None = None) -> DataFrame:
    """The rows, each with ``cells``: the k (one without ``k``) nearest of the centres of its dimension; 0 if there are none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cells = pd.Series([[0]] * len(b), index=b.index, dtype=object)
            for dim, part in b.groupby(b[vector].map(len)):
                C = centres.get(int(dim))
                if C is not None:
                    near = _nearest_centres(np.stack(part[vector].to_numpy()), C, k[int(dim)] if k else 1)
                    cells.loc[part.index] = pd.Series(list(near), index=part.index, dtype=object)
            yield b.assign(cells=cells)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", cells array<long>"
    return rows.mapInPandas(run, schema)


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = 4096, degree: int = 32,
    beam: int = 96, alpha: float = 1.2, block_queries: int = 4096, most_cells: int = 1024, covered: float = 0.97, sample: int = 16_384,
    most_numbers: int = 4_194_304,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for every query.

    ``vectors`` and ``queries`` need vec_id and embedding; other columns are
    ignored. A query's own row (equal vec_id) is no candidate. Vectors that are
    null, empty, zero or not finite take no part; nor do vectors of another
    length than the query's. Repeated rows are one: vec_id names a vector, and
    of several vectors under one vec_id the least in order of components is
    taken. Equal vectors stand in the graph once and come back as their k + 1
    smallest ids, so ties go to smaller ids. The score is the Euclidean
    distance in double precision. Fewer candidates than k give fewer rows;
    empty tables give an empty result.

    Vectors are dealt to at most ``most_cells`` cells by the nearest centre;
    centres are fitted on at most ``sample`` vectors of ``most_numbers``
    components in all, the first by hash. Cells
    of more than ``shard_rows`` vectors are parted by hash into several shards.
    A query searches every shard of its nearest cells: as many as hold the
    share ``covered`` of the nearest vectors in the sample, so few where
    vectors form clusters and nearly all where they don't.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "ann")
    named = lambda df: df.filter(valid(F.col("embedding")) & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min(F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))).alias("v"))
    clean = ws.put(named(vectors).select("vec_id", "v", F.xxhash64("v").alias("h"), F.size("v").alias("dim")))
    # The k + 1 smallest ids of each vector; Spark limits groups before the shuffle.
    first = F.row_number().over(Window.partitionBy("h", "v").orderBy("vec_id"))
    members = ws.put(clean.withColumn("r", first).filter(F.col("r") <= k + 1))
    distinct = members.filter("r = 1").select(F.col("vec_id").alias("rep"), "v", "h", "dim")
    distinct = ws.put(distinct)
    n, dim = distinct.agg(F.count(F.lit(1)), F.max("dim")).first()
    sample = min(sample, max(1, most_numbers // (dim or 1)))
    cells = max(1, min(most_cells, -(-n // shard_rows)))
    seen = distinct.orderBy(F.xxhash64("h", F.lit(3)), "rep").limit(sample).select("v").toPandas().v  # at most ``sample`` vectors
    # A dimension has cells by its share of the sample; one that is not in it has cell 0.
    centres = {int(d): fit_centres(np.stack(part.to_numpy()), max(1, round(cells * len(part) / len(seen)))) for d, part in seen.groupby(seen.map(len))}
    probes = {int(d): cells_to_search(np.stack(part.to_numpy()), centres[int(d)], k, covered) for d, part in seen.groupby(seen.map(len))}
    placed = ws.put(in_cells(distinct.select("rep", "v", "h", "dim"), "v", centres).withColumn("cell", F.element_at("cells", 1)).drop("cells"))
    # At most ``most_cells`` rows for each dimension.
    shards = placed.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("parts"))
    first_shard = F.sum("parts").over(Window.orderBy("dim", "cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("parts")
    shards = ws.put(shards.withColumn("first", first_shard))
    points = placed.join(F.broadcast(shards), ["dim", "cell"]).withColumn("shard", F.col("first") + F.pmod(F.xxhash64("h", F.lit(5)), F.col("parts")))
    index = ws.put(build_shards(points, degree, beam, alpha))
    asked = ws.put(in_cells(named(queries).select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv")), "qv", centres, probes))
    # Queries go to every shard of their cells, in blocks that a task can hold.
    sent = asked.select("query_id", "qv", F.size("qv").alias("dim"), F.explode("cells").alias("cell")).join(F.broadcast(shards), ["dim", "cell"])
    sent = sent.select("query_id", "qv", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)).alias("shard"))
    many = ws.put(sent.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / block_queries).alias("blocks")))
    blocks = sent.join(many, "shard").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks"))).drop("blocks")
    copies = index.join(many, "shard").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    keep = k + 1

    def search(key, graphs: pd.DataFrame, qs: pd.DataFrame) -> Iterator[pd.DataFrame]:
        out = []
        for g in graphs.itertuples():
            mine = qs[qs.qv.map(len) == g.dim]
            if not len(mine):
                continue
            reps, starts = np.frombuffer(g.reps, np.int64), np.frombuffer(g.starts, np.int64)
            V, graph = np.frombuffer(g.vectors, np.float64).reshape(len(reps), g.dim), np.frombuffer(g.graph, np.int32).reshape(len(reps), -1)
            Q, asked_ids = np.stack(mine.qv.to_numpy()), mine.query_id.to_numpy()
            X, scale = _scaled(V)
            for lo in range(0, len(Q), 512):
                q = Q[lo : lo + 512]
                ids, _, _ = _search(X, graph, starts, (q / scale).astype(np.float32), max(beam, keep), False)
                r, c = np.nonzero(ids >= 0)
                d = np.sqrt(((q[r] - V[ids[r, c]]) ** 2).sum(1))
                found = pd.DataFrame({"query_id": asked_ids[lo + r], "rep": reps[ids[r, c]], "d": d})
                out.append(found.sort_values(["query_id", "d", "rep"]).groupby("query_id").head(keep))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "rep": [], "d": []})

    found = copies.groupBy("shard", "block").cogroup(blocks.groupBy("shard", "block")).applyInPandas(search, "query_id long, rep long, d double")
    near = Window.partitionBy("query_id").orderBy("d", "rep")
    best = ws.put(found.withColumn("r", F.row_number().over(near)).filter(F.col("r") <= keep).drop("r", "d"))
    ws.keep(members, asked, best)
    exact = (
        best.join(members.withColumnRenamed("r", "copy"), (F.col("rep") == F.col("vec_id")) & (F.col("copy") == 1))
        .select("query_id", "h", F.col("v").alias("hv"))
        .join(members.select("vec_id", "v", "h"), "h")
        .filter(F.col("v") == F.col("hv"))
        .join(asked.drop("cells"), "query_id")
        .filter("vec_id <> query_id")
    )
    square = F.aggregate(F.zip_with("qv", "v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    ranked = exact.select("query_id", "vec_id", F.sqrt(square).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return ranked.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

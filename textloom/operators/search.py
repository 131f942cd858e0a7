"""Exact vector search, pooling and retrieval."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions import vector as V
from textloom.operators.shared import written


#: Bytes of query vectors up to which they are shipped to the corpus instead of joined with it.
SHIPPED = 8 << 20
#: Numbers of a block of vectors, and vectors that meet a block of queries in one matrix product.
BLOCK_NUMBERS, AT_ONCE = 1 << 21, 4_096


def _by_dim(ids: pa.Array, vectors: pa.Array) -> dict[int, tuple[pa.Array, np.ndarray]]:
    """dim: (ids, matrix). Null and empty vectors are left out; null components are NaN."""
    lengths = pc.list_value_length(vectors).fill_null(0).to_numpy(zero_copy_only=False)
    out = {}
    for dim in np.unique(lengths[lengths > 0]):
        at = pa.array(np.flatnonzero(lengths == dim))
        flat = pc.list_flatten(vectors.take(at)).cast(pa.float64()).fill_null(float("nan"))
        out[int(dim)] = ids.take(at), flat.to_numpy(zero_copy_only=False).reshape(-1, int(dim))
    return out


class _Nearest:
    """The k nearest of all vectors met so far, for queries (ids, matrix) of one length."""

    def __init__(self, ids: pa.Array, Q: np.ndarray, k: int, metric: str, block: int):
        self.ids, self.Q, self.k, self.metric, self.block = ids, Q, k, metric, block
        self.found: list[pa.Table | None] = [None] * -(-len(Q) // block)

    def meet(self, ids: pa.Array, V: np.ndarray) -> None:
        for n in range(len(self.found)):
            lo = n * self.block
            for at in range(0, len(V), AT_ONCE):
                i, j, score = _best(self.Q[lo : lo + self.block], V[at : at + AT_ONCE], self.k, self.metric)
                fine = ~np.isnan(score)
                new = pa.table({"q": pa.array(lo + i[fine], pa.int64()), "score": pa.array(score[fine] + 0.0, pa.float64()), "vec_id": ids.take(pa.array(at + j[fine], pa.int64()))})
                self.found[n] = self._first(new if self.found[n] is None else pa.concat_tables([self.found[n], new]))

    def _first(self, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("q", "ascending"), ("score", "ascending" if self.metric == "l2" else "descending"), ("vec_id", "ascending")])
        q = rows["q"].to_numpy()
        return rows.take(pa.array(np.flatnonzero(np.arange(len(q)) - np.searchsorted(q, q) < self.k))).combine_chunks()

    def batches(self) -> Iterator[pa.RecordBatch]:
        for rows in self.found:
            if rows is not None:
                yield from rows.select(["vec_id", "score"]).add_column(0, "query_id", self.ids.take(rows["q"].combine_chunks())).to_batches()


def _best(Q: np.ndarray, V: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of each query's k best and all that tie with them.

    A matrix product finds who comes into question, with room for its rounding;
    sums in one fixed order give the scores, so equal vectors score the same.
    """
    q2, v2 = (Q * Q).sum(1), (V * V).sum(1)
    if np.isnan(v2).any():
        fine = np.flatnonzero(~np.isnan(v2))
        i, j, score = _best(Q, V[fine], k, metric)
        return i, fine[j], score
    if not len(V):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if metric == "l2":
        near = 2 * Q @ V.T - q2[:, None] - v2[None]
    else:
        scale = np.where(q2 > 0, q2, 1)[:, None] ** 0.5 * np.where(v2 > 0, v2, 1)[None] ** 0.5 if metric == "cosine" else 1.0
        near = Q @ V.T / scale
    near = np.where(np.isnan(near), -np.inf, near)
    room = 1e-9 * (1 + (q2[:, None] + v2.max() if metric != "cosine" else 0))
    least = np.partition(near, -k, axis=1)[:, -k][:, None] if k < len(V) else np.full((len(Q), 1), -np.inf)
    i, j = np.nonzero(near >= least - room)
    if metric == "l2":
        return i, j, ((Q[i] - V[j]) ** 2).sum(1)
    score = (Q[i] * V[j]).sum(1)
    if metric == "cosine":
        norms = np.sqrt(q2[i]) * np.sqrt(v2[j])
        score = np.where(norms > 0, score / np.where(norms > 0, norms, 1), 0.0)
    return i, j, score


def knn(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine", block_queries: int = 512) -> DataFrame:
    """(query_id, vec_id, score, rk): the k best of ``corpus`` for each query, exactly.

    ``queries`` has (query_id, qv), ``corpus`` (vec_id, v); ``metric`` is
    ``cosine`` or ``dot`` (largest first) or ``l2`` (squared distance, least
    first). Ties go to the smaller vec_id; vectors that are null or of another
    length than the query's are passed, as are those with null components.
    Up to ``SHIPPED`` bytes of queries go to every task of the corpus. More are
    dealt into blocks, as the corpus is, and each two blocks meet in one group,
    which holds ``BLOCK_NUMBERS`` numbers of either. Only the k nearest of a
    query leave a task.
    """
    spark = queries.sparkSession
    size = lambda df, c: df.agg(F.coalesce(F.sum(F.size(c).cast("long")), F.lit(0))).first()[0]
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (corpus, "vec_id"))]
    schema = f"query_id {kinds[0]}, vec_id {kinds[1]}, score double"
    queries, corpus = queries.select("query_id", "qv"), corpus.select("vec_id", "v")
    numbers = size(queries.filter("qv is not null"), "qv")
    if numbers * 8 <= SHIPPED:
        sink = pa.BufferOutputStream()
        table = queries.filter("qv is not null").toArrow()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        shipped = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = pa.ipc.open_stream(shipped.value).read_all().combine_chunks()
            asked = _by_dim(*(c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in asked.columns))
            found = {dim: _Nearest(ids, Q, k, metric, block_queries) for dim, (ids, Q) in asked.items()}
            for b in batches:
                for dim, (ids, V) in _by_dim(b.column(0), b.column(1)).items():
                    if dim in found:
                        found[dim].meet(ids, V)
            for one in found.values():
                yield from one.batches()

        pairs = corpus.mapInArrow(run, schema)
    else:
        blocks = -(-numbers // BLOCK_NUMBERS)
        salts = max(1, -(-size(corpus.filter("v is not null"), "v") // BLOCK_NUMBERS), -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks))
        part = lambda c, n: F.pmod(F.xxhash64(c, F.lit(7)), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        asked = queries.select("query_id", "qv", part("query_id", blocks).alias("block"), every(salts).alias("salt"))
        met = corpus.select("vec_id", "v", every(blocks).alias("block"), part("vec_id", salts).alias("salt"))
        # One partition for several groups would hold no more than one at a time, but one for all would be one task.
        dealt = [df.repartition(blocks * salts, "block", "salt") for df in (asked, met)]

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            whole = lambda c: pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)
            stored = _by_dim(whole(b["vec_id"]), whole(b["v"])) if b.num_rows else {}
            out = []
            for dim, (ids, Q) in (_by_dim(whole(a["query_id"]), whole(a["qv"])) if a.num_rows else {}).items():
                if dim in stored:
                    one = _Nearest(ids, Q, k, metric, block_queries)
                    one.meet(*stored[dim])
                    out += one.batches()
            types = pa.schema([("query_id", a.schema.field("query_id").type), ("vec_id", b.schema.field("vec_id").type), ("score", pa.float64())])
            return pa.Table.from_batches(out) if out else types.empty_table()

        pairs = dealt[0].groupBy("block", "salt").cogroup(dealt[1].groupBy("block", "salt")).applyInArrow(meet, schema)
    best = F.col("score").asc() if metric == "l2" else F.col("score").desc()
    rk = F.row_number().over(Window.partitionBy("query_id").orderBy(best, "vec_id"))
    return pairs.withColumn("rk", rk).filter(F.col("rk") <= k)


def two_stage(queries: DataFrame, texts: DataFrame, k: int, most_candidates: int = 100) -> DataFrame:
    """query_id, rk, text_id, score, n_keywords, total_candidates, candidates_reranked, mode.

    ``queries`` has (query_id, keywords, qv), ``texts`` (text_id, elements, v).
    Stage 1: the texts that hold a keyword, by an inverted index; the first
    ``most_candidates`` of them by text_id go on. Stage 2: the k best of these
    by cosine. A query without keywords or without such a text is searched
    among all texts (mode ``semantic``).
    """
    words = queries.select("query_id", F.explode(F.array_distinct("keywords")).alias("el"))
    held = texts.select("text_id", F.explode(F.array_distinct("elements")).alias("el"))
    met = written(words.join(held, "el").select("query_id", "text_id").distinct(), "met")
    total = met.groupBy("query_id").agg(F.count(F.lit(1)).alias("total_candidates"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("text_id"))
    going = met.withColumn("nth", nth).filter(F.col("nth") <= most_candidates).drop("nth")
    scored = going.join(queries.select("query_id", "qv"), "query_id").join(texts.select("text_id", "v"), "text_id")
    scored = scored.select("query_id", "text_id", V.cosine(F.col("qv"), F.col("v")).alias("score"))
    rk = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "text_id"))
    hybrid = scored.withColumn("rk", rk).filter(F.col("rk") <= k).join(total, "query_id")
    rest = queries.join(total, "query_id", "left_anti")
    full = knn(rest.select("query_id", "qv"), texts.select(F.col("text_id").alias("vec_id"), "v"), k)
    full = full.select("query_id", F.col("vec_id").alias("text_id"), "score", "rk", F.lit(0).cast("long").alias("total_candidates"))
    n = queries.select("query_id", F.size(F.array_distinct("keywords")).cast("long").alias("n_keywords"))
    mode = F.when(F.col("total_candidates") > 0, "hybrid").otherwise("semantic")
    out = hybrid.select(full.columns).union(full).join(n, "query_id")
    return out.select(
        "query_id", F.col("rk").cast("long").alias("rk"), "text_id", "score", "n_keywords", "total_candidates",
        F.least("total_candidates", F.lit(most_candidates)).alias("candidates_reranked"), mode.alias("mode"))


def expanded_search(queries: DataFrame, texts: DataFrame, encode: Callable[[Column], Column], k: int, boost: float = 1.2) -> DataFrame:
    """query_id, rk, text_id, score: the k best texts over all variants of a query.

    ``queries`` has (query_id, q), ``texts`` (text_id, text); ``encode`` makes
    vectors of texts. Each variant finds its 2 k nearest texts; a text that
    names the query's entity scores ``boost`` times; the best score counts.
    """
    entity = T.entity_of(F.col("q"))
    asked = queries.select("query_id", F.lower(entity).alias("entity"), F.posexplode(T.query_variants(F.col("q"), entity, T.query_type(F.col("q")))).alias("nth", "variant"))
    vectors = texts.select(F.col("text_id").alias("vec_id"), encode(F.col("text")).alias("v"))
    found = knn(asked.select(F.struct("query_id", "nth").alias("query_id"), encode(F.col("variant")).alias("qv")), vectors, 2 * k)
    found = found.select("query_id.query_id", "vec_id", "score").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    entities = asked.filter("nth = 0").select("query_id", "entity")
    named = found.join(entities, "query_id").join(texts.select(F.col("text_id").alias("vec_id"), F.lower("text").alias("low")), "vec_id")
    score = F.col("score") * F.when(F.contains("low", F.col("entity")), boost).otherwise(1.0)
    rk = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = named.withColumn("score", score).withColumn("rk", rk).filter(F.col("rk") <= k)
    return best.select("query_id", F.col("rk").cast("long").alias("rk"), F.col("vec_id").alias("text_id"), "score")


def mean_pool(rows: DataFrame, keys: list[str], vector: str, weight: Column | None = None) -> DataFrame:
    """Mean vector of each key, by dimension, so no vector list is gathered."""
    w = F.lit(1.0) if weight is None else weight
    dims = rows.select(*keys, w.alias("_w"), F.posexplode(vector).alias("dim", "x"))
    mean = dims.groupBy(*keys, "dim").agg((F.sum(F.col("x").cast("double") * F.col("_w")) / F.sum("_w")).alias("x"))
    return mean.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias(vector))


def cluster_quality(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """Per label: number of vectors and mean pairwise cosine inside, from the sum of unit vectors.

    The mean over pairs is (|sum|^2 - n) / (n (n - 1)): linear, no pairs.
    """
    unit = vectors.select(label, V.normalize(F.col(vector)).alias("u"))
    dims = unit.select(label, F.posexplode("u").alias("dim", "x")).groupBy(label, "dim").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    g = dims.groupBy(label).agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("n").alias("n"))
    return g.select(label, "n", F.when(F.col("n") > 1, (F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("inside"))

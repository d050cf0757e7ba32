"""Exact top-k by integer inner product (operator 2).

Components become floor(256 x). The queries are a stated set, taken in blocks of bounded size; each block is broadcast
and compared with all vectors in one scan:

1. Vectors are range-sorted by descending length once and written (``checkpoint``), so a task reads a band of lengths.
   A bounded sample of the longest vectors gives each query a first k-th best score.
2. All vectors are rotated by the eigenvectors of their second-moment matrix (an SVD of the table, from one 64 x 64
   sum), which moves most of the products into the first coordinates.
3. In a task, vectors are processed in steps by descending length. A step whose longest vector times the query's length
   can't reach the query's k-th best score ends that query's work in the task (Cauchy-Schwarz). Otherwise partial sums
   over the first rotated coordinates plus the product of the residual lengths bound each score, over ``CUTS``
   coordinates one after another; pairs that can't reach the k-th best score are dropped.
4. Survivors get the exact integer product. Floating bounds are widened by ``SLACK``, so rounding can't lose a pair.

Each task returns its k best per query, and a partial aggregate merges them: k rows per query and task at most.

Defined results: vectors that are null, hold a null or non-finite component, or have another length than the most
frequent one (the longer of equals) take no part, nor do rows with a null id. Of rows with one id, only the vector
that sorts first takes part (repeats of a row count once). A query never finds its own id. Ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.session import reliable_checkpoint

QUERY_BLOCK = 8_192
SEEDS = 4_096
STEP = 512  # vectors, and queries, that a step compares: its pairs bound the memory
AT_ONCE = 128
CUTS = (4, 8, 16, 32)
SLACK = 1e-6

NONE = -(1 << 62)  # below every score, and its negative exists

RESULT = "query_id long, vec_id long, score long"


def quantized(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """id, q (array of long): floor(256 x) of the vectors that take part."""
    x = F.col(embedding)
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    rows = vectors.filter(F.col(vec_id).isNotNull() & x.isNotNull() & (F.size(x) > 0)).select(
        F.col(vec_id).cast("long").alias("id"),
        F.when(
            F.forall(x, lambda v: fine(v.cast("double"))),
            F.transform(x, lambda v: F.floor(v.cast("double") * 256).cast("long")),
        ).alias("q"),
    )
    return rows.filter("q is not null").groupBy("id").agg(F.min("q").alias("q"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows x components; the arrays of a batch lie behind one another."""
    return np.asarray(column.flatten(), dtype=np.int64).reshape(-1, dim)


def _moments(rows: DataFrame, dim: int) -> np.ndarray:
    def sums(batches):
        total = np.zeros((dim, dim))
        for b in batches:
            m = _matrix(b.column("q"), dim).astype(float)
            total += m.T @ m
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(dim * dim), pa.int32()), "v": pa.array(total.ravel())})

    got = rows.select("q").mapInArrow(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i")
    return np.array([r.v for r in got.collect()]).reshape(dim, dim) if dim else np.zeros((0, 0))


class TopK:
    """k best of each query so far, as arrays; ties to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.score = np.full((queries, k), NONE)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Pairs (query, id, score); an id is offered to a query once."""
        k = self.score.shape[1]
        for q in np.unique(query):
            mine = query == q
            s, i = np.concatenate([self.score[q], score[mine]]), np.concatenate([self.id[q], ids[mine]])
            best = np.lexsort((i, -s))[:k]
            self.score[q], self.id[q] = s[best], i[best]


def search_block(rotation, queries, query_ids, floor, ids, vectors, k) -> TopK:
    """k best of every query among ``vectors`` (sorted by descending length). floor: scores known to be reached."""
    best = TopK(len(queries), k)
    for s in range(0, len(queries), AT_ONCE):
        some = slice(s, s + AT_ONCE)
        found = _search_some(rotation, queries[some], query_ids[some], floor[some], ids, vectors, k)
        best.score[some], best.id[some] = found.score, found.id
    return best


def _search_some(rotation, queries, query_ids, floor, ids, vectors, k, step: int = STEP) -> TopK:
    best = TopK(len(queries), k)
    dim = vectors.shape[1]
    cuts = [c for c in CUTS if c < dim]
    rq = queries @ rotation
    q_rest = [np.sqrt((rq[:, c:] ** 2).sum(axis=1)) for c in cuts]
    q_length = np.sqrt((rq**2).sum(axis=1))
    active = np.arange(len(queries))
    for s in range(0, len(ids), step):
        part, own = vectors[s : s + step], ids[s : s + step]
        need = np.maximum(best.score[:, -1], floor).astype(float)
        longest = np.sqrt((part[0].astype(float) ** 2).sum())
        reach = q_length[active] * longest
        active = active[reach * (1 + SLACK) + SLACK >= need[active]]  # later vectors are no longer
        if not len(active):
            break
        rp = part @ rotation
        pair_q, pair_v, partial, before = None, None, None, 0
        for c, rest in zip(cuts, q_rest, strict=True):
            v_rest = np.sqrt((rp[:, c:] ** 2).sum(axis=1))
            if pair_q is None:
                partial = rq[active, :c] @ rp[:, :c].T
                bound = partial + rest[active][:, None] * v_rest[None, :]
                keep = bound + SLACK * (1 + np.abs(bound)) >= need[active][:, None]
                a, pair_v = np.nonzero(keep)
                pair_q, partial = active[a], partial[keep]
            else:
                partial = partial + np.einsum("ij,ij->i", rq[pair_q, before:c], rp[pair_v, before:c])
                bound = partial + rest[pair_q] * v_rest[pair_v]
                keep = bound + SLACK * (1 + np.abs(bound)) >= need[pair_q]
                pair_q, pair_v, partial = pair_q[keep], pair_v[keep], partial[keep]
            before = c
        if pair_q is None:  # too few components to cut
            pair_q, pair_v = (x.ravel() for x in np.meshgrid(active, np.arange(len(own)), indexing="ij"))
        other = query_ids[pair_q] != own[pair_v]
        pair_q, pair_v = pair_q[other], pair_v[other]
        score = np.einsum("ij,ij->i", queries[pair_q], part[pair_v])
        good = score >= need[pair_q]
        best.add(pair_q[good], own[pair_v[good]], score[good])
    return best


def top_k(vectors: DataFrame, is_query: str, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every query (``is_query``: SQL condition over ``id``)."""
    spark = vectors.sparkSession
    found = quantized(vectors, vec_id, embedding)
    sizes = found.groupBy(F.size("q").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    dim = sizes.n if sizes else 0
    sorted_rows = reliable_checkpoint(
        found.filter(F.size("q") == dim)
        .withColumn("squares", F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x * x))
        .orderBy(F.desc("squares"), "id")
    )
    out = spark.createDataFrame([], RESULT)
    if dim:
        _, axes = np.linalg.eigh(_moments(sorted_rows, dim))
        rotation = np.ascontiguousarray(axes[:, ::-1])
        longest = sorted_rows.orderBy(F.desc("squares"), "id").limit(SEEDS).collect()  # bounded sample
        seed_ids, seeds = np.array([r.id for r in longest]), np.array([r.q for r in longest], dtype=np.int64)
        queries = sorted_rows.filter(is_query)
        blocks = -(-queries.count() // QUERY_BLOCK)
        for b in range(blocks):
            rows = queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").collect()
            if not rows:
                continue
            ids, q = np.array([r.id for r in rows]), np.array([r.q for r in rows], dtype=np.int64)
            floor = search_block(rotation, q, ids, np.full(len(q), NONE), seed_ids, seeds, k).score[:, -1]
            shared = spark.sparkContext.broadcast((rotation, q, ids, floor))

            def found_in(batches, shared=shared):
                rotation, q, ids, floor = shared.value
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    own, m = np.asarray(batch.column("id")), _matrix(batch.column("q"), dim)
                    best = search_block(rotation, q, ids, floor, own, m, k)
                    at, slot = np.nonzero(best.id != np.iinfo(np.int64).max)
                    yield pa.RecordBatch.from_pydict({
                        "query_id": pa.array(ids[at]), "vec_id": pa.array(best.id[at, slot]),
                        "score": pa.array(best.score[at, slot]),
                    })

            out = out.unionByName(sorted_rows.select("id", "q").mapInArrow(found_in, RESULT))
    return _merge(out, k)


def _merge(found: DataFrame, k: int) -> DataFrame:
    """The k best per query: k times the best one that is left, by partial aggregates over narrow rows."""
    ranked = found.groupBy("query_id", F.pmod(F.xxhash64("vec_id"), F.lit(16)).alias("part")).agg(_best(k))
    merged = ranked.select("query_id", F.explode("best").alias("b")).groupBy("query_id").agg(
        F.slice(F.array_sort(F.collect_list("b")), 1, k).alias("best")  # at most 16 k entries
    )
    return merged.select("query_id", F.posexplode("best").alias("pos", "b")).select(
        "query_id", (F.col("pos") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.minus")).alias("score")
    )


def _best(k: int):
    entry = F.struct((-F.col("score")).alias("minus"), F.col("vec_id"))
    return F.slice(F.array_sort(F.collect_list(entry)), 1, k).alias("best")

"""Operator 5, exact top-k by inner product, pruned by norms and Cauchy-Schwarz bounds.

Components become integers, floor(scale * x). Candidates lie in blocks in order of descending
length. A rotation from the singular value decomposition of all vectors, by their summed outer
products (any rotation is exact; a good one prunes more), puts most of a vector's length in its leading coordinates. A
block of queries keeps its k best scores; against a block of candidates the score over the
leading coordinates plus the product of the residual lengths bounds each score from above, and
only candidates whose bound reaches a query's k-th best score are scored in full, in integers.
Queries first meet the longest candidates, which gives every query a threshold; block pairs
whose product of lengths stays below all thresholds of the query block are never formed.

Work is dealt as pairs of a block of queries and a block of candidates, so it spreads over any
number of tasks, and no side is broadcast.

Defined results: vectors that are null, empty, of another dimension than most, or hold null or
non-finite components take no part; ties go to the smaller id; rows that repeat an id are
candidates each, but never for a query of that id; an integer or a score beyond a long is the
nearest long, and scores so cut are ties; fewer candidates than k give them all; an
empty table gives an empty one; other columns don't matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import blocks as B

LEAD = 16
BLOCK = 8192
#: Added to floating bounds, far above their rounding errors.
SLACK = 1e-6
#: Below it doubles hold integers and their sums.
EXACT = float(1 << 52)
LEAST, MOST = -(1 << 63), (1 << 63) - 1
PARTIAL = "query_id long, vec_id long, score long"


def integers(vectors: DataFrame, scale: int, id: str, vector: str) -> DataFrame:
    """id, v (integers) and len2 (squared length) of the vectors that take part."""
    v = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
    ok = vectors.select(F.col(f"`{id}`").cast("long").alias("id"), v.alias("x")).where("id is not null and x is not null and size(x) > 0 and forall(x, y -> y is not null and not isnan(y) and abs(y) < double('Infinity'))")
    out = ok.select("id", F.transform("x", lambda y: F.floor(y * scale).cast("long")).alias("v"))
    return out.withColumn("len2", F.aggregate("v", F.lit(0.0), lambda a, y: a + y.cast("double") * y.cast("double")))


def matrix(column: pa.ChunkedArray, kind) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy().reshape(len(flat), -1).astype(kind)


def rotation(vectors: DataFrame, d: int) -> np.ndarray:
    """The right singular vectors, largest first, as columns; ``vectors`` has v of d integers."""

    def outer(batches):
        total = np.zeros((d, d))
        for b in batches:
            x = matrix(pa.chunked_array([b.column(0)]), np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d, dtype=np.int64)), pa.array(total.ravel())], names=["k", "x"])

    rows = vectors.select("v").mapInArrow(outer, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()  # d * d rows
    gram = np.zeros(d * d)
    for r in rows:
        gram[r["k"]] = r["x"]
    return np.linalg.svd(gram.reshape(d, d))[0]


def best(qid: np.ndarray, cid: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Indices of each query's k best, ties to the smaller id."""
    order = np.lexsort((cid, ~score, qid))
    q = qid[order]
    start = np.searchsorted(q, q, side="left")
    return order[np.arange(len(q)) - start < k]


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows of integers, whatever their size; those beyond a long are the nearest long."""
    exact = [sum(x * y for x, y in zip(a, b, strict=True)) for a, b in zip(q.tolist(), c.tolist(), strict=True)]
    return np.array([min(max(x, LEAST), MOST) for x in exact], dtype=np.int64)


def scored(queries: tuple, cands: tuple, rot: np.ndarray, floor: np.ndarray, k: int, lead: int, step: int = 1024) -> pa.Table:
    """The k best of a block of candidates for each query, of those that may reach its floor."""
    (qi, qx), (ci, cx) = queries, cands
    order = np.lexsort((ci, -(cx.astype(np.float64) ** 2).sum(1)))
    ci, cx = ci[order], cx[order]
    qv, cv = qx.astype(np.float64), cx.astype(np.float64)
    qr, cr = qv @ rot, cv @ rot
    q_rest, c_rest = (np.sqrt(np.maximum((x[:, lead:] ** 2).sum(1), 0)) for x in (qr, cr))
    q_len, c_len = np.sqrt((qv**2).sum(1)), np.sqrt((cv**2).sum(1))
    # Doubles hold all sums of a pair whose lengths have a product below EXACT; others are near, and made exact last.
    near = np.where(q_len * c_len.max(initial=0) >= EXACT, SLACK * q_len * c_len.max(initial=0), 0.0)
    floor = floor.astype(np.float64).copy()
    at, with_, scores = [], [], []
    held = np.full((len(qi), k), -np.inf)
    for a in range(0, len(ci), step):
        live = np.flatnonzero(q_len * c_len[a] * (1 + SLACK) + 1 + near >= floor)
        if not len(live):
            break  # lengths descend
        b = slice(a, a + step)
        bound = qr[live, :lead] @ cr[b, :lead].T + np.outer(q_rest[live], c_rest[b])
        need = bound + SLACK * (np.abs(bound) + np.outer(q_len[live], c_len[b])) + 1 + near[live, None] >= floor[live, None]
        need &= qi[live, None] != ci[b][None, :]
        r, c = np.nonzero(need)
        if not len(r):
            continue
        if len(r) > need.size // 8:
            full = qv[live] @ cv[b].T
            exact = full[r, c]
        else:
            exact = np.einsum("ij,ij->i", qv[live[r]], cv[a + c])
        exact = np.clip(exact, float(LEAST), float(MOST))
        ok = exact + near[live[r]] >= floor[live[r]]
        r, c, exact = live[r[ok]], c[ok], exact[ok]
        at.append(r)
        with_.append(a + c)
        scores.append(exact)
        if len(r):
            by = np.lexsort((-exact, r))
            rr, ee = r[by], exact[by]
            rank = np.arange(len(rr)) - np.searchsorted(rr, rr, side="left")
            keep = rank < k
            new = np.full((len(qi), k), -np.inf)
            new[rr[keep], rank[keep]] = ee[keep]
            held = -np.sort(-np.concatenate([held, new], axis=1), axis=1)[:, :k]
            floor = np.maximum(floor, held[:, -1] - near)
    if not at:
        return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
    r, c, exact = np.concatenate(at), np.concatenate(with_), np.concatenate(scores)
    large = q_len[r] * c_len[c] >= EXACT
    s = np.zeros(len(r), dtype=np.int64)
    s[~large] = np.rint(exact[~large]).astype(np.int64)
    s[large] = products(qx[r[large]], cx[c[large]])
    q, c = qi[r], ci[c]
    keep = best(q, c, s, k)
    return pa.table({"query_id": q[keep], "vec_id": c[keep], "score": s[keep]})


def banded(ints: DataFrame, cuts: list[float]) -> DataFrame:
    """ints with band: how many of the cuts are above its squared length."""
    edges = np.sort(np.array(cuts, dtype=np.float64))

    def work(batches):
        for b in batches:
            band = len(edges) - np.searchsorted(edges, b.column(b.schema.get_field_index("len2")).to_numpy(), side="right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(band.astype(np.int32))], names=[*b.schema.names, "band"])

    return ints.mapInArrow(work, "id long, v array<long>, len2 double, band int")


def exact_topk(vectors: DataFrame, is_query, k: int = 20, scale: int = 64, id: str = "vec_id", vector: str = "embedding", block: int = BLOCK, lead: int = LEAD) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best; ``is_query`` is a condition on ``id``."""
    spark = vectors.sparkSession
    ints = B.checkpointed(integers(vectors, scale, id, vector))
    dims = ints.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    d, n = dims["d"], dims["n"]
    ints = ints.where(F.size("v") == d)
    rot = rotation(ints, d)
    lead = min(lead, d)
    # Blocks of about equal numbers in order of descending length, by approximate quantiles of a bounded number.
    blocks = min(4096, max(1, math.ceil(n / block)))
    cuts = ints.approxQuantile("len2", [i / blocks for i in range(1, blocks)], 1 / (4 * blocks)) if blocks > 1 else []
    ranked = B.checkpointed(banded(ints, sorted(set(cuts))))
    # A length that very many share would make a block of any size, so blocks are split by a hash of the id.
    size = {r["band"]: r["count"] for r in ranked.groupBy("band").count().collect()}
    split = spark.createDataFrame([(b_, max(1, math.ceil(c_ / block)) if c_ > 2 * block else 1) for b_, c_ in sorted(size.items())], "band int, parts int")
    # At most as many rows as blocks of lengths, 4096.
    cands = ranked.join(F.broadcast(split), "band").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).withColumn("cb", F.xxhash64("band", "part")).drop("parts")
    queries = ranked.where(is_query(F.col("id")))
    n_q = max(1, math.ceil(queries.count() / (block // 4)))
    queries = queries.withColumn("qb", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_q)).cast("int"))
    tops = cands.groupBy("cb").agg(F.max("len2").alias("top"), F.count("*").alias("count"))
    first = sorted(size)[0]

    def pairs(q: DataFrame, c: DataFrame, links: DataFrame, floors: bool) -> DataFrame:
        """Scores of the linked block pairs; both sides are dealt by pair."""
        left = q.join(links, "qb").select("qb", "cb", F.col("id"), "v", *(["floor"] if floors else [F.lit(None).cast("long").alias("floor")]))
        right = c.join(links, "cb").select(*(F.col(x).alias(f"c_{x}") for x in ("qb", "cb", "id", "v")))

        def work(a: pa.Table, b: pa.Table) -> pa.Table:
            if not a.num_rows or not b.num_rows:
                return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
            floor = np.array([-np.inf if x is None else x for x in a["floor"].to_pylist()], dtype=np.float64)
            return scored((a["id"].to_numpy(), matrix(a["v"], np.int64)), (b["c_id"].to_numpy(), matrix(b["c_v"], np.int64)), rot, floor, k, lead)

        return left.groupBy("qb", "cb").cogroup(right.groupBy("c_qb", "c_cb")).applyInArrow(work, PARTIAL)

    q_blocks = spark.range(n_q).select(F.col("id").cast("int").alias("qb"))
    head = cands.where(F.col("band") == first)
    links = head.select("cb").distinct().withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    start = B.checkpointed(pairs(queries, head, links, False))
    floors = start.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), False).alias("s")).select(F.col("query_id").alias("id"), F.when(F.size("s") >= k, F.col("s")[k - 1]).alias("floor"))
    with_floor = queries.join(floors, "id", "left")
    need = with_floor.groupBy("qb").agg(F.min(F.coalesce(F.col("floor"), F.lit(-(1 << 62)))).alias("least"), F.max("len2").alias("long"))
    rest = cands.where(F.col("band") != first)
    others = tops.join(rest.select("cb").distinct(), "cb").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    links2 = others.join(need, "qb").where((F.col("least") <= 0) | (F.sqrt(F.col("top").cast("double")) * F.sqrt(F.col("long").cast("double")) * (1 + SLACK) + 1 >= F.col("least"))).select("qb", "cb")
    every = start.unionByName(pairs(with_floor, rest, links2, True)) if len(size) > 1 else start
    top = every.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.bitwise_not("score").alias("neg"), F.col("vec_id")))), 1, k).alias("t"))
    out = top.select("query_id", F.posexplode("t").alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.bitwise_not("x.neg").alias("score"))


def op5_exact_topk(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return exact_topk(vectors, lambda id: F.pmod(id, F.lit(20)) == 0)


TOPK_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""

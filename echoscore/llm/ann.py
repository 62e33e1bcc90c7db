"""Nearest neighbours by multi-index hashing over learned binary codes.

Codes. Vectors are centred, turned to their principal axes and rotated so that signs lose least (iterative quantisation, fitted
on at most ``max_sample`` vectors chosen by a hash of the id); a bit per dimension, in substrings of 8 bits.
Index. Every vector is coded; equal vectors are one entry that keeps the k + 1 smallest ids, which is all an answer can
show of them. Entries are dealt by hash into parts of about ``part_rows``; a part has one table per substring.
Search. If two codes differ in at most r bits, some substring differs in at most r // substrings bits: probing all
substring values within that distance finds every code within r. Codes within r are reranked by the exact distance.
r is learned on the sample (the ``reach`` quantile of the code distance to true neighbours; the sample is sparser than the
table, so the neighbours there are further away) and widened for a query until a part has k entries in reach.
Queries go to all parts in blocks, each part answers with its k best, a last ranking merges the parts.

Vectors that are NULL, empty, zero, of another length than most, or with NULL or non-finite components take no part, neither do rows without
an id. Repeated rows of one id and vector count once. An empty table gives no rows.
"""

from __future__ import annotations

import sys
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NEAREST = 10
MAX_SAMPLE = 4096
PART_ROWS, QUERY_BLOCK = 8192, 1024
BITS = 8


class Codes(NamedTuple):
    """``radius`` in bits; ``turn`` maps a centred vector to the numbers whose signs are the code."""

    mean: np.ndarray
    turn: np.ndarray
    radius: int


def code_of(vectors: np.ndarray, codes: Codes) -> np.ndarray:
    """Codes as bytes, one per substring."""
    return np.packbits((vectors - codes.mean) @ codes.turn > 0, axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``b`` to the vector ``a``, summed in one order for all."""
    return np.sqrt(((b - a) ** 2).sum(1))


def train(x: np.ndarray, k: int = NEAREST, rounds: int = 40, reach: float = 0.99) -> Codes:
    mean = x.mean(0)
    centred = x - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1]
    projected = centred @ axes
    turn = np.linalg.qr(np.random.default_rng(11).normal(size=(x.shape[1], x.shape[1])))[0]
    for _ in range(rounds):
        a, _, b = np.linalg.svd(np.sign(projected @ turn).T @ projected)
        turn = (a @ b).T
    codes = Codes(mean, axes @ turn, 0)
    bits = np.unpackbits(code_of(x, codes), axis=1)
    apart = []
    for i in range(0, len(x), max(1, len(x) // 256)):
        d = distances(x[i], x)
        d[i] = np.inf
        near = np.argsort(d, kind="stable")[: min(k, len(x) - 1)]
        apart.append((bits[near] != bits[i]).sum(1))
    apart = np.concatenate(apart) if len(x) > 1 else np.zeros(1)
    return codes._replace(radius=int(np.quantile(apart, reach)))


def valid(vector: Column) -> Column:
    """True for vectors that take part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def fit(rows: DataFrame, k: int = NEAREST, max_sample: int = MAX_SAMPLE) -> Codes | None:
    """``rows`` (id, vector)."""
    ids = rows.select("id").distinct().orderBy(F.xxhash64(F.lit("ann"), "id"), "id").limit(max_sample)
    sample = rows.join(ids, "id", "left_semi").groupBy("id").agg(F.min("vector").alias("vector")).orderBy("id").limit(max_sample).collect()
    return train(np.array([r["vector"] for r in sample], np.float64), k) if sample else None


def flips(distance: int) -> np.ndarray:
    """All bytes with at most ``distance`` bits."""
    return np.array([sum(1 << b for b in c) for n in range(min(distance, BITS) + 1) for c in combinations(range(BITS), n)], np.uint8)


def search(codes: np.ndarray, vectors: np.ndarray, query_code: np.ndarray, query: np.ndarray, tables: list, radius: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the entries within the radius, which grows until there are k."""
    m, size = codes.shape[1], codes.shape[1] * BITS
    while True:
        probes = flips(radius // m)
        found = np.zeros(len(codes), bool)
        for s, (order, cuts) in enumerate(tables):
            for value in (probes ^ query_code[s]).tolist():
                found[order[cuts[value] : cuts[value + 1]]] = True
        near = np.flatnonzero(found)
        apart = np.bitwise_count(codes[near] ^ query_code).sum(1)
        near = near[apart <= radius]
        if len(near) >= min(k, len(codes)) or radius >= size:
            return near, distances(query, vectors[near])
        radius = min(size, radius + m)


def tables_of(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per substring: entries sorted by its value, and where each value starts."""
    out = []
    for s in range(codes.shape[1]):
        order = np.argsort(codes[:, s], kind="stable")
        out.append((order, np.searchsorted(codes[order, s], np.arange(257))))
    return out


def nearest(
    rows: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEAREST,
    max_sample: int = MAX_SAMPLE, part_rows: int = PART_ROWS, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows of each row that meets ``queries``."""
    spark: SparkSession = rows.sparkSession
    kept = rows.where(queries.isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"), queries.alias("asks"))
    kept = kept.where(F.col("id").isNotNull() & valid(F.col("vector")))
    usual = kept.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if usual is None:
        return spark.createDataFrame([], schema)
    # -0.0 and 0.0 are one value of a vector
    kept = kept.where(F.size("vector") == usual["size"]).withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    learned = fit(kept, k, max_sample)
    shared = spark.sparkContext.broadcast(tuple(learned))  # a plain value needs no package to be read
    # A vector with very many ids is cut by id first, so that no task lists all of them.
    slices = kept.groupBy("vector", F.pmod(F.xxhash64("id"), F.lit(64)).alias("slice")).agg(F.slice(F.array_sort(F.collect_set("id")), 1, k + 1).alias("ids"))
    entries = slices.groupBy("vector").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    parts = max(1, -(-usual["count"] // part_rows))
    asked = kept.where("asks").select("id", "vector").dropDuplicates(["id", "vector"])
    blocks = max(1, -(-asked.count() // query_block))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    entries = entries.select("vector", "ids", F.pmod(F.xxhash64("vector"), F.lit(parts)).cast("int").alias("part"), spread(blocks).alias("block"))
    asked = asked.select("vector", "id", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), spread(parts).alias("part"))

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        flat = column.combine_chunks()
        return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)

    def run(index: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(index) and len(asked):
            codes = Codes(*shared.value)
            vectors, wanted = matrix(index.column("vector")), matrix(asked.column("vector"))
            own, theirs, ids = code_of(vectors, codes), code_of(wanted, codes), index.column("ids").to_pylist()
            tables = tables_of(own)
            for q, query in enumerate(asked.column("id").to_pylist()):
                # one more than k, as the query's own entry may hold no other id
                near, apart = search(own, vectors, theirs[q], wanted[q], tables, codes.radius, k + 1)
                best = np.lexsort((near, apart))[: k + 1]
                edge = apart[best[-1]] if len(best) else 0.0
                found = sorted((d, v) for p, d in zip(near[apart <= edge].tolist(), apart[apart <= edge].tolist()) for v in ids[p] if v != query)
                out += [(query, v, d) for d, v in found[:k]]
        columns = list(zip(*out)) or [()] * 3
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    local = entries.groupBy("part", "block").cogroup(asked.groupBy("part", "block")).applyInArrow(run, "query_id long, vec_id long, score double")
    # an id with several vectors keeps its nearest
    one = local.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return one.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

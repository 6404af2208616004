"""Exact top-k inner products by a three-phase uniform threshold.

A score is a sum over ``LISTS`` blocks of dimensions, and every block is a list of local
scores. Phase 1 gathers each list's best local entries of every batch of rows and resolves
these alone: the k-th best of their scores is a safe cutoff t. Phase 2 broadcasts t; an
entry that scores t or more must reach t / LISTS in one list at least, and only entries that
do are collected. Phase 3 resolves the scores of the collected entries exactly. Whole scores
are only made for gathered and collected entries, a small share of all pairs.

Queries come in bounded blocks that are broadcast one after another, against all rows;
ids and scores that go to the driver are k per query of a block.

Defined results: vectors that are null, empty or hold null or non-finite components take
no part; a shorter vector counts as if zeros followed; rows with a null id take no part;
rows that repeat an id are candidates once each, and a query's own id is never its
candidate; a query id with several vectors is ranked over the scores of all of them (rows
that repeat the vector too are one query); a query without candidates has no row. Scores
must fit 63 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LISTS, QUERY_BLOCK, ROW_BLOCK = 2, 16384, 2048
#: Queries whose local scores are held at once.
_HELD = 512


def _matrix(vectors: list, width: int | None = None) -> np.ndarray:
    width = width or max((len(v) for v in vectors), default=1)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : min(len(v), width)] = v[:width]
    return out


def _whole_numbers(q: np.ndarray, x: np.ndarray) -> type:
    """Doubles where every sum is exact in them, else 64-bit integers."""
    return np.float64 if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] < 2.0**53 else np.int64


def local_scores(q: np.ndarray, x: np.ndarray, lists: int):
    """(queries, rows) inner products of each block of dimensions, one list after another."""
    for c in np.array_split(np.arange(q.shape[1]), min(lists, q.shape[1])):
        yield q[:, c] @ x[:, c].T


def gathered(q: np.ndarray, x: np.ndarray, own: np.ndarray, k: int, lists: int) -> tuple[np.ndarray, np.ndarray]:
    """Phase 1: (query, row) of the ``k`` best local entries of every list, but for a query's own rows."""
    hit = np.zeros(own.shape, bool)
    few = min(k, own.shape[1])
    for local in local_scores(q, x, lists):
        local[own] = np.iinfo(np.int64).min if local.dtype == np.int64 else -np.inf
        best = np.argpartition(local, own.shape[1] - few, 1)[:, own.shape[1] - few :]
        np.put_along_axis(hit, best, True, 1)
    return np.nonzero(hit & ~own)


def collected(q: np.ndarray, x: np.ndarray, own: np.ndarray, cut: np.ndarray, lists: int) -> tuple[np.ndarray, np.ndarray]:
    """Phase 2: (query, row) of the entries that reach their share of the cutoff in one list or more."""
    hit, share = np.zeros(own.shape, bool), (cut / min(lists, q.shape[1]))[:, None]
    for local in local_scores(q, x, lists):
        hit |= local >= share
    return np.nonzero(hit & ~own)


def resolved(q: np.ndarray, x: np.ndarray, qi: np.ndarray, ri: np.ndarray) -> np.ndarray:
    """Phase 3: whole scores of entries."""
    out = np.empty(len(qi), np.int64)
    for at in range(0, len(qi), 1 << 16):
        part = slice(at, at + (1 << 16))
        out[part] = np.einsum("ij,ij->i", q[qi[part]], x[ri[part]])
    return out


def _usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * 256).cast("double"))
    fine = F.col(id_col).isNotNull() & (F.size(vec_col) > 0) & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def _scan(rows: DataFrame, sent, k: int, lists: int) -> DataFrame:
    """(query_id, vec_id, score): the best gathered entries where the sent cutoffs are None, else all collected ones of at least the cutoff."""

    def run(batches):
        ids, q, cut = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROW_BLOCK):
                part = batch.slice(at, ROW_BLOCK)
                vecs = part.column(1)
                widths = np.asarray(vecs.value_lengths())
                flat = np.asarray(vecs.flatten())
                x = flat.reshape(len(widths), -1) if (widths == widths[0]).all() else _matrix(vecs.to_pylist())
                wide = max(q.shape[1], x.shape[1])
                x, qs = (np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (x, q))
                kind = _whole_numbers(qs, x)
                x, qs = x.astype(kind, copy=False), qs.astype(kind, copy=False)
                row_ids = np.asarray(part.column(0))
                for lo in range(0, len(qs), _HELD):
                    some = qs[lo : lo + _HELD]
                    own = ids[lo : lo + _HELD, None] == row_ids[None]
                    if cut is None:
                        qi, ri = gathered(some, x, own, k, lists)
                        score = resolved(some, x, qi, ri)
                        order = np.lexsort((row_ids[ri], -score, qi))  # of a batch's entries the k best suffice for the cutoff
                        order = order[np.arange(len(qi)) - np.searchsorted(qi[order], qi[order]) < k]
                    else:
                        qi, ri = collected(some, x, own, cut[lo : lo + _HELD], lists)
                        score = resolved(some, x, qi, ri)
                        order = np.flatnonzero(score >= cut[lo + qi])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[lo + qi[order]]), pa.array(row_ids[ri[order]]), pa.array(score[order])], ["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "query_id long, vec_id long, score long")


def _best(entries: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return entries.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", lists: int = LISTS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products, ties to smaller ids."""
    rows = _usable(vectors, id_col, vec_col)
    queries = _usable(vectors.where(is_query), id_col, vec_col).distinct()
    blocks = max(1, -(-queries.count() // query_block))
    out = None
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)) == b) if blocks > 1 else queries
        got = part.collect()  # one block of queries
        if not got:
            continue
        ids, q = np.array([r["id"] for r in got], np.int64), _matrix([r["v"] for r in got])
        first = _best(_scan(rows, spark.sparkContext.broadcast((ids, q, None)), k, lists), k)
        lows = {r["query_id"]: r["low"] for r in first.groupBy("query_id").agg(F.min("score").alias("low"), F.count("*").alias("n")).where(F.col("n") == k).collect()}
        cut = np.array([lows.get(i, -np.inf) for i in ids.tolist()], float)
        cut -= np.abs(cut) * 1e-12  # below any rounding: the last ranking is exact
        found = _scan(rows, spark.sparkContext.broadcast((ids, q, cut)), k, lists)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return _best(out, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

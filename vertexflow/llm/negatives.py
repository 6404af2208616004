"""Hard negatives by bit-sliced integer products.

Components are integers, cut into bit-planes of their two's complement. An anchor's product
with a row is the weighted sum of its products with the row's planes, taken from the most
significant one on. After each plane a score lies in a known interval: what the planes left
can add is at least the anchor's negative components and at most its positive ones, times
the largest number they can hold. Rows whose interval can't qualify any more are dropped;
once few are left the planes go on for the remaining pairs alone. After the last plane the
intervals are points.

For positives a row qualifies while its upper bound reaches the ``positives``-th best lower
bound of the anchor's own label. For negatives it qualifies while its interval meets a
positive's band, and reaches the ``negatives``-th best lower bound of those surely inside.
Each task keeps the best few of each anchor; windows over these give the result.

Anchors come in blocks of bounded bytes that are broadcast one after another, against all
rows. To the driver go the anchors and ``positives`` scores each, a block at a time.

Defined results: rows whose id, label or vector is null, whose vector is empty or holds a
null or non-finite component, take no part; a shorter vector counts as if zeros followed;
rows that repeat an id are candidates once each, and rows of an anchor's own id are neither
its positives nor its negatives; different rows under one anchor id are anchors of their
own. Anchors without positives, and positives without negatives, have no row. Scores must
fit 56 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import Store

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 3, 50, 95, 256
#: Bytes of a block of anchors, rows and anchors whose intervals are held at once, and the share of pairs from which on planes go pair by pair.
BLOCK_BYTES, ROWS_HELD, ANCHORS_HELD, FEW = 16 << 20, 2048, 512, 0.08


def padded(vectors: pa.ListArray, width: int | None = None) -> np.ndarray:
    """Rows of integers with zeros behind, ``width`` wide at least."""
    sizes, flat = np.asarray(vectors.value_lengths()).astype(np.int64), np.asarray(vectors.flatten())
    out = np.zeros((len(sizes), max(int(sizes.max(initial=0)), width or 0)), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def planes(rows: np.ndarray):
    """(weight, bits, largest number that the planes left hold) from the most significant plane on."""
    top = int(max(rows.max(initial=0), -(rows.min(initial=0) + 1))).bit_length()
    for p in range(top, -1, -1):
        yield (-(1 << p) if p == top else 1 << p), (rows >> p) & 1, (1 << p) - 1


def sliced(anchors: np.ndarray, rows: np.ndarray, able: np.ndarray, still):
    """(anchor, row, score) of the able pairs that ``still(anchor, lower, upper)`` never drops; its arguments are arrays of pairs, ordered by anchor."""
    down, up = anchors.clip(max=0).sum(1), anchors.clip(min=0).sum(1)
    most = int(np.abs(anchors).sum(1).max(initial=0))
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    dense, pairs = np.zeros(able.shape, np.int64), None
    left, of = anchors.astype(kind), None
    for weight, bits, rest in planes(rows):
        if pairs is None:
            dense += weight * (left @ bits.T.astype(kind)).astype(np.int64)
            if rest and rest * most > 0.75 * np.abs(dense).max(initial=0):
                continue  # intervals as wide as the scores drop nothing
            a, r = np.nonzero(able)
            score = dense[a, r]
        else:
            a, r, score = pairs
            for at in range(0, len(a), 1 << 16):
                part = slice(at, at + (1 << 16))
                score[part] += weight * np.einsum("ij,ij->i", anchors[a[part]], bits[r[part]])
        ok = still(a, score + rest * down[a], score + rest * up[a])
        a, r, score = a[ok], r[ok], score[ok]
        if pairs is not None or len(a) < FEW * able.size or not rest:
            pairs = (a, r, score)
        else:
            able = np.zeros_like(able)
            able[a, r] = True
    return pairs if pairs is not None else (np.zeros(0, np.int64),) * 3


def kth_best(group: np.ndarray, value: np.ndarray, k: int, groups: int) -> np.ndarray:
    """Each group's k-th largest value, the least number for groups with fewer."""
    order = np.lexsort((-value, group))
    starts = np.searchsorted(group[order], np.arange(groups))
    out = np.full(groups, np.iinfo(np.int64).min)
    full = np.flatnonzero(np.append(starts[1:], len(order)) - starts >= k)
    out[full] = value[order[starts[full] + k - 1]]
    return out


def best(group: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each group's k best, ties to smaller ids."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    return order[np.arange(len(g)) - np.searchsorted(g, g) < k]


def _blocks(batches, width: int):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_HELD):
            part = batch.slice(at, ROWS_HELD)
            yield np.asarray(part.column(0)), np.asarray(part.column(1)), padded(part.column(2), width)


def _positives(rows: DataFrame, sent, k: int) -> DataFrame:
    def run(batches):
        ids, labels, vectors, _ = sent.value
        for row_ids, row_labels, x in _blocks(batches, vectors.shape[1]):
            q = np.pad(vectors, ((0, 0), (0, x.shape[1] - vectors.shape[1])))
            for label in np.intersect1d(labels, row_labels):
                mine, theirs = np.flatnonzero(labels == label), np.flatnonzero(row_labels == label)
                for lo in range(0, len(mine), ANCHORS_HELD):
                    some = mine[lo : lo + ANCHORS_HELD]
                    able = ids[some, None] != row_ids[None, theirs]
                    a, r, score = sliced(q[some], x[theirs], able, lambda a, low, high, n=len(some): high >= kth_best(a, low, k, n)[a])
                    at = best(a, row_ids[theirs[r]], score, k)
                    yield pa.RecordBatch.from_arrays([pa.array(some[a[at]]), pa.array(row_ids[theirs[r[at]]]), pa.array(score[at])], ["anchor", "id", "score"])

    return rows.mapInArrow(run, "anchor long, id long, score long")


def _negatives(rows: DataFrame, sent, k: int) -> DataFrame:
    """(anchor, place of the positive, id, score): the best few inside each positive's band."""

    def run(batches):
        ids, labels, vectors, bands = sent.value
        for row_ids, row_labels, x in _blocks(batches, vectors.shape[1]):
            q = np.pad(vectors, ((0, 0), (0, x.shape[1] - vectors.shape[1])))
            for lo in range(0, len(ids), ANCHORS_HELD):
                some = slice(lo, lo + ANCHORS_HELD)
                low, high = bands[some, :, 0], bands[some, :, 1]
                n = len(low)

                def still(a, below, above, low=low, high=high, n=n):
                    ok = np.zeros(len(a), bool)
                    for p in range(low.shape[1]):
                        meets = (above >= low[a, p]) & (below <= high[a, p])
                        inside = meets & (below >= low[a, p]) & (above <= high[a, p])
                        ok |= meets & (above >= kth_best(a[inside], below[inside], k, n)[a])
                    return ok

                able = (labels[some, None] != row_labels[None]) & (ids[some, None] != row_ids[None])
                a, r, score = sliced(q[some], x, able, still)
                for p in range(low.shape[1]):
                    fits = np.flatnonzero((score >= low[a, p]) & (score <= high[a, p]))
                    at = fits[best(a[fits], row_ids[r[fits]], score[fits], k)]
                    yield pa.RecordBatch.from_arrays([pa.array(lo + a[at]), pa.array(np.full(len(at), p)), pa.array(row_ids[r[at]]), pa.array(score[at])], ["anchor", "positive", "id", "score"])

    return rows.mapInArrow(run, "anchor long, positive long, id long, score long")


def _first(entries: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return entries.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    spark: SparkSession, vectors: DataFrame, is_anchor: Column, label: Column | str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and its best rows of the same label, the best rows of other labels that score ``low`` to ``high`` percent of the positive."""
    label = F.col(label) if isinstance(label, str) else label
    fine = F.col(id_col).isNotNull() & label.isNotNull() & (F.size(vec_col) > 0) & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    components = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * scale))
    usable = lambda df: df.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), components.alias("v"))
    rows, anchors = usable(vectors), usable(vectors.where(is_anchor)).distinct()
    store = Store(spark, "negatives")
    size = anchors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    blocks = max(1, -(-size["n"] * 8 * (size["width"] or 1) // block_bytes))
    out = None
    for b in range(blocks):
        part = anchors.where(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)) == b) if blocks > 1 else anchors
        got = part.toArrow()  # one block of anchors
        if not got.num_rows:
            continue
        ids, labels = np.asarray(got["id"]), np.asarray(got["label"])
        q = padded(got["v"].combine_chunks(), size["width"])
        sent = spark.sparkContext.broadcast((ids, labels, q, None))
        found = _first(_positives(rows, sent, positives), ["anchor"], positives).toArrow()  # ``positives`` of each anchor of the block
        anchor, place, score = np.asarray(found["anchor"]), np.asarray(found["rank"]) - 1, np.asarray(found["score"])
        bands = np.zeros((len(ids), positives, 2), np.int64)
        bands[:, :, 0] = 1  # from 1 to 0: nothing is inside
        bands[anchor, place, 0], bands[anchor, place, 1] = -(-low * score // 100), high * score // 100
        banded = spark.sparkContext.broadcast((ids, labels, q, bands))
        pairs = spark.createDataFrame(pa.table({"of": anchor, "anchor_id": ids[anchor], "at": place.astype(np.int64), "positive_id": found["id"], "positive_score": score}))
        mined = _first(_negatives(rows, banded, negatives), ["anchor", "positive"], negatives)
        mined = mined.join(pairs, (F.col("anchor") == F.col("of")) & (F.col("positive") == F.col("at")))
        mined = store.put(mined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "mined")
        out = mined if out is None else out.unionByName(mined)
        sent.destroy()
        banded.destroy()
    return out if out is not None else spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")

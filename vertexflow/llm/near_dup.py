"""Near-duplicate documents by SuperMinHash, banding, exact verification and union-find.

Each distinct word shingle runs a permutation of the signature's slots: the slot at
rank j receives j plus a uniform number, and slots keep their minimum (correlated ranks
lower the variance against independent minima). A document stops at rank j once all its
slots hold less than j, which is exact; ranks run step by step over a whole batch.

Documents with equal shingle sets form a class first; only class representatives are
banded, and bucket links are confirmed on full sets.

Defined results: null text, empty text and white space alone have the empty set, link
with nothing and are kept; a null doc_id is linked with nothing (component null, kept);
rows that repeat a doc_id share one component, but each has its own text's n_shingles;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, small_batches
from .components import link_buckets, one_row
from .store import Store

BANDS, ROWS = 20, 5
#: Ids that a broadcast may hold (16 MB); beyond, the join is shuffled.
BROADCAST_IDS = 1_000_000
#: 64-bit words of an odd sketch.
LONGS = 8
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=8)
def _weights(k: int) -> np.ndarray:
    return _mix(np.arange(1, k + 1, dtype=np.uint64) * _GOLD) | np.uint64(1)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles; a shorter text is one shingle."""
    from xxhash import xxh3_64_intdigest as digest

    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(digest, words), np.uint64, len(words))
    n = min(k, len(h))
    total = np.full(len(h) - n + 1, n, np.uint64) * _GOLD
    for i, w in enumerate(_weights(k)[:n]):
        total += h[i : len(h) - n + 1 + i] * w
    return np.unique(_mix(total))


def super_minhash(elements: np.ndarray, sizes: np.ndarray, slots: int) -> np.ndarray:
    """(documents, slots) signatures of sets that follow each other in ``elements``."""
    docs = len(sizes)
    h = np.full(docs * slots, np.inf)
    owner = np.repeat(np.arange(docs), sizes)
    seed, ranks = elements, None
    for j in range(slots):
        draw = _mix(seed + np.uint64((2 * j + 1) * int(_GOLD) % 2**64))
        pick = j + (_mix(draw) >> np.uint64(32)) * np.uint64(slots - j) // np.uint64(1 << 32)
        pick = pick.astype(np.intp)
        if j == 0:
            slot, swapped = pick, pick
        else:
            at = np.arange(len(seed))
            slot = ranks[at, pick]
            ranks[at, pick] = ranks[:, j]
        np.minimum.at(h, owner * slots + slot, j + (draw >> np.uint64(11)) * 2.0**-53)
        open_ = (h.reshape(docs, slots) >= j + 1).any(1)
        go = open_[owner]
        if not go.any():
            break
        if j == 0:
            ranks = np.tile(np.arange(slots, dtype=np.uint16 if slots > 256 else np.uint8), (int(go.sum()), 1))
            ranks[np.arange(len(ranks)), swapped[go]] = 0
        elif not go.all():
            ranks = ranks[go]
        if not go.all():
            seed, owner = seed[go], owner[go]
    return h.reshape(docs, slots)


def _band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    x = signatures.view(np.uint64).reshape(len(signatures), bands, rows)
    total = np.arange(1, bands + 1, dtype=np.uint64)[None] * _GOLD
    for i, w in enumerate(_weights(rows)):
        total = total + _mix(x[:, :, i]) * w
    return _mix(total).view(np.int64)


def signatures(docs: DataFrame, words: int, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, k1, k2, bands): the set's size, its 128-bit key and its band hashes."""

    def run(batches):
        for batch in batches:
            for part in small_batches(batch, 128):
                sets = [shingle_set(t, words) for t in part.column(1).to_pylist()]
                sizes = np.array([len(s) for s in sets], np.int64)
                hashes = _band_hashes(super_minhash(np.concatenate(sets), sizes, bands * rows), bands, rows)
                keys = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(list(hashes), pa.list_(pa.int64()))], [id_col, "n_shingles", "k1", "k2", "bands"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_shingles long, k1 long, k2 long, bands array<long>")


def odd_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, LONGS) words; each element flips the bit that its lowest bits name."""
    bits = 64 * LONGS
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flips = np.bincount(owner * bits + (np.concatenate(sets) & np.uint64(bits - 1)).astype(np.intp), minlength=len(sets) * bits)
    return np.packbits((flips & 1).astype(np.uint8)).view(np.int64).reshape(len(sets), LONGS)


def _sets(docs: DataFrame, words: int, kind: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in small_batches(batch, 128):
                sets = [shingle_set(t, words) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array(list(odd_sketches(sets)), pa.list_(pa.int64())), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["id", "n", "s", "elements"])

    return docs.mapInArrow(run, f"id {kind}, n int, s array<long>, elements array<long>")


def near_duplicates(spark: SparkSession, docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document; links have a Jaccard similarity of ``percent`` / 100 or more."""
    store = Store(spark, "near-dup")
    kind = docs.schema[id_col].dataType.simpleString()
    signed = store.put(signatures(docs, words, id_col=id_col, text_col=text_col).withColumnRenamed(id_col, "id"), "signatures")
    real = signed.where("n_shingles > 0 and id is not null")
    classes = store.put(real.groupBy("k1", "k2").agg(F.min("id").alias("rep")), "classes")
    heads = signed.join(classes.select(F.col("rep").alias("id"), "k1", "k2"), ["id", "k1", "k2"], "left_semi")
    banded = heads.select("id", F.explode("bands").alias("bucket")).distinct()
    full = banded.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("bucket")
    buckets = store.put(banded.join(full, "bucket", "left_semi"), "buckets")
    ids = store.put(buckets.select("id").distinct(), "ids")
    few = broadcast_if_small(ids, ids.count(), BROADCAST_IDS)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(few, "id", "left_semi")
    sets = store.put(_sets(texts, words, kind), "sets")

    def similarity(pairs: DataFrame) -> DataFrame:
        one = sets.select(F.col("id").alias("a"), F.col("elements").alias("sa"))
        two = sets.select(F.col("id").alias("b"), F.col("elements").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        met = pairs.join(one, "a").where(F.size("sa") > 0).join(two, "b").select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb")).alias("n"))
        return met.groupBy("a", "b").agg(F.max(F.col("both") / (F.col("n") - F.col("both"))).alias("j"))

    sizes = store.put(one_row(sets.where("n > 0").select("id", "n", "s")), "sizes")
    labels = link_buckets(store, buckets, sizes, similarity, percent, LONGS).withColumnRenamed("id", "rep")
    component = F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.coalesce("component", "rep", "id"))
    grouped = signed.select("id", "n_shingles", "k1", "k2").join(classes.join(labels, "rep", "left"), ["k1", "k2"], "left")
    owned = store.put(grouped.select("id", "n_shingles", F.when(F.col("id").isNotNull(), component).alias("component_id")), "owned")
    # one component a doc_id: rows that repeat an id with other texts take the smallest
    torn = owned.groupBy("id").agg(F.min("component_id").alias("least"), F.max("component_id").alias("most")).where("least <> most").select(F.col("id").alias("of"), "least")
    torn = store.put(torn, "torn")
    out = owned.join(broadcast_if_small(torn, torn.count(), BROADCAST_IDS), F.col("id") == F.col("of"), "left").select("id", "n_shingles", F.coalesce("least", "component_id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))

"""Resampling of documents towards a target distribution by importance weights.

Features are runs of 1 to ``most_words`` words, hashed into buckets by CRC-32. Every
partition builds a trie over words: a node is a run, holds how often it occurred and the CRC
state of its bytes, so a longer run's hash goes on from its parent's. Whole batches go down
the trie level by level. The nodes' counts are added up by bucket, and a trie that has grown
beyond ``NODES`` is added up and begun anew, which changes no total. Bucket totals of the
documents and of the target, two numbers a bucket, give each bucket's gain. A second walk
through tries whose nodes carry their gain adds up every document's weight; Gumbel noise from
a hash of the id turns weights into scores, and the highest scores are the sample.

Ranks come from a range-partitioned sort of all scored documents, with the partitions'
row counts added up: no task holds them all.

Defined results: null texts have no words; a null doc_id draws its noise as if it were
empty and comes after other ids among ties; rows that repeat an id and a text share their
score and get ranks one after the other; an empty target or table has zero counts.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pieces import sized_batches
from .store import Store

BUCKETS, MOST_WORDS, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Nodes of a trie that is added up and begun anew, and bytes of texts that are held as words at once (a text at least).
NODES, HELD = 250_000, 2 << 20
#: UTF-8 bytes: A-Z become lower case, ASCII characters that are neither letters nor digits end words.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_BYTES).split()


class Trie:
    """Runs of words from the root, with their nodes' CRC states and counts."""

    def __init__(self, most_words: int):
        self.most_words = most_words
        self.clear()

    def clear(self) -> None:
        self.states: list[int] = []
        self.counts = np.zeros(0, np.int64)
        self._word: list[bytes] = []  # of nodes, their last
        self._first: dict[bytes, int] = {}
        self._next: dict[int, int] = {}  # by parent << 32 | first-level node of the word

    def _node(self, word: bytes, state: int) -> int:
        self.states.append(state)
        self._word.append(word)
        return len(self.states) - 1

    def _children(self, keys: np.ndarray) -> np.ndarray:
        found, place = np.unique(keys, return_inverse=True)
        nodes = np.empty(len(found), np.int64)
        for i, key in enumerate(found.tolist()):
            node = self._next.get(key)
            if node is None:
                word = self._word[key & 0xFFFFFFFF]
                node = self._next[key] = self._node(word, zlib.crc32(b" " + word, self.states[key >> 32]))
            nodes[i] = node
        return nodes[place]

    def walk(self, words: list[bytes], left: np.ndarray):
        """(places, nodes) of the runs of each length; ``left`` counts a document's words from each place on."""
        first = self._first
        for w in set(words):
            if w not in first:
                first[w] = self._node(w, zlib.crc32(w))
        single = np.fromiter(map(first.__getitem__, words), np.int64, len(words))
        places, nodes = np.arange(len(words)), single
        yield places, nodes
        for k in range(1, self.most_words):
            fits = left[places] > k
            places, nodes = places[fits], nodes[fits]
            nodes = self._children(nodes << 32 | single[places + k])
            yield places, nodes

    def count(self, nodes: np.ndarray) -> None:
        n = np.bincount(nodes, minlength=len(self.states))
        n[: len(self.counts)] += self.counts
        self.counts = n


def _parts(batches, column: int):
    """(rows, words of each text) of small slices of batches."""
    for batch in batches:
        for part in sized_batches(batch, column, HELD):
            yield part, [words_of(x) for x in part.column(column).to_pylist()]


def _left(sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.repeat(ends, sizes) - np.arange(ends[-1] if len(ends) else 0)


def bucket_totals(docs: DataFrame, text_col: str = "text", most_words: int = MOST_WORDS, buckets: int = BUCKETS, nodes: int = NODES) -> DataFrame:
    """(bucket, n): the features of all texts."""

    def run(batches):
        trie, totals = Trie(most_words), np.zeros(buckets, np.int64)

        def add_up():
            np.add.at(totals, np.array(trie.states, np.int64) % buckets, trie.counts)
            trie.clear()

        for _, texts in _parts(batches, 0):
            for _, found in trie.walk(list(chain.from_iterable(texts)), _left(np.array([len(x) for x in texts], np.int64))):
                trie.count(found)
            if len(trie.states) > nodes:
                add_up()
        add_up()
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(totals[at], pa.int64())], ["bucket", "n"])

    return docs.select(text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(spark: SparkSession, docs: DataFrame, target: DataFrame, text_col: str = "text", target_text_col: str = "text", most_words: int = MOST_WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """Every bucket's gain: 1000 times the log of its share in the target over that in ``docs``, one occurrence added to each bucket."""
    raw = bucket_totals(docs, text_col, most_words, buckets).withColumnRenamed("n", "s")
    aim = bucket_totals(target, target_text_col, most_words, buckets).withColumnRenamed("n", "t")
    store = Store(spark, "totals")
    every = spark.range(buckets).withColumnRenamed("id", "bucket").join(raw, "bucket", "left").join(aim, "bucket", "left").fillna(0, ["s", "t"])
    every = store.put(every, "totals")
    sums = every.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    s, t, all_s, all_t = F.col("s").cast("double"), F.col("t").cast("double"), F.lit(float(sums["s"])), F.lit(float(sums["t"]))
    gain = F.floor(1000 * F.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets))))
    rows = every.select("bucket", gain.alias("gain")).collect()  # ``buckets`` rows, a fixed number
    out = np.zeros(buckets, np.int64)
    out[[r["bucket"] for r in rows]] = [r["gain"] for r in rows]
    return out


def weigh(spark: SparkSession, docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", most_words: int = MOST_WORDS, nodes: int = NODES) -> DataFrame:
    """(doc_id, n_words, n_features, weight, place): the sum of gains over a document's features; place numbers a task's rows."""
    sent = spark.sparkContext.broadcast(gains)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        trie, gains, place = Trie(most_words), sent.value, 0
        attached = np.zeros(0, np.int64)
        for part, texts in _parts(batches, 1):
            sizes = np.array([len(x) for x in texts], np.int64)
            doc = np.repeat(np.arange(len(texts)), sizes)
            n, weight = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for at, found in trie.walk(list(chain.from_iterable(texts)), _left(sizes)):
                if len(attached) < len(trie.states):
                    attached = np.concatenate([attached, gains[np.array(trie.states[len(attached) :], np.int64) % len(gains)]])
                n += np.bincount(doc[at], minlength=len(texts))
                np.add.at(weight, doc[at], attached[found])
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in (sizes, n, weight, place + np.arange(len(texts))))], [id_col, "n_words", "n_features", "weight", "place"])
            place += len(texts)
            if len(trie.states) > nodes:
                trie.clear()
                attached = attached[:0]

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_features long, weight long, place long")


def resample(
    spark: SparkSession, docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
    most_words: int = MOST_WORDS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null for those not drawn."""
    store = Store(spark, "resample")
    gains = bucket_gains(spark, docs, target, text_col, target_text_col, most_words, buckets)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weigh(spark, docs, gains, id_col, text_col, most_words).withColumn("score", F.col("weight") + noise).withColumn("may", F.col("n_words") >= least_words)
    scored = store.put(scored, "scored")
    drawn = percent * scored.where("may").count() // 100
    order = [F.desc("may"), F.desc("score"), F.asc_nulls_last(id_col), F.asc("n_features"), F.asc("weight"), F.asc("place")]
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = scored.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    kind = docs.schema[id_col].dataType.simpleString()

    def number(batches):
        at = 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(at + 1, at + 1 + batch.num_rows), pa.int64())], [*batch.schema.names, "position"])
            at += batch.num_rows

    numbered = store.put(dealt.select(id_col, "n_features", "weight", "score", "may", "part").mapInArrow(number, f"`{id_col}` {kind}, n_features long, weight long, score long, may boolean, part int, position long"), "ranked")
    sizes = {r["part"]: r["n"] for r in numbered.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row for each partition
    starts, before = [], 0
    for part in sorted(sizes):
        starts.append((part, before))
        before += sizes[part]
    starts = spark.createDataFrame(starts, "of int, before long")
    place = F.col("before") + F.col("position")
    ranked = numbered.join(F.broadcast(starts), F.col("part") == F.col("of"))  # as many rows as shuffle partitions
    return ranked.select(id_col, "n_features", "weight", "score", F.when(F.col("may") & (place <= drawn), place).alias("rank"))

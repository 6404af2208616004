"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions alone.

A seed hashes the words at a mask's positions and ignores the others, so a substituted
word at an ignored position doesn't hide a copy. A mask stands wherever it fits, and the
masks of a length hit every stretch of as many aligned words (``SPAN`` at most) with all
the substitutions that ``SHARE`` allows. Seeds of benchmark items join those of documents;
each hit fixes an alignment, along which the words around it are compared: an item counts as
found where ``SPAN`` aligned words (all of a shorter item's) agree in ``SHARE`` of their positions
or more. Items of four words or less allow no substitution: their only mask is all words.

Hits of one alignment in the same ``STRETCH`` words of an item are one comparison, of these
words and those that a window from them can reach. Documents are cut to such pieces before
they are multiplied, so a row holds a bounded number of words however long texts are, and the
work of a document grows with its hits.

Defined results: texts and items without words are clean; rows that repeat a doc_id get
one common verdict; a null doc_id is clean only if no text under a null id is hit; null
items are ignored; an item repeated under one id counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small
from .store import Store

#: The aligned words and the share that confirm a hit.
SPAN, SHARE = 12, 0.8
#: Word positions of the seeds for items of each length, ``SPAN`` and more the last.
MASKS = {
    1: ((0,),), 2: ((0, 1),), 3: ((0, 1, 2),), 4: ((0, 1, 2, 3),), 5: ((0, 1, 2), (0, 1, 3)), 6: ((0, 1, 3),), 7: ((0, 1, 3, 4),), 8: ((0, 1, 2, 4),), 9: ((0, 1, 2, 4, 5),),
    10: ((0, 1, 2, 3), (0, 1, 2, 4)), 11: ((0, 1, 2, 4),), 12: ((0, 1, 2, 3, 4), (0, 1, 3, 5, 6)),
}
#: Item words by which hits of an alignment are compared together.
STRETCH = 64
#: Bytes of item words that a broadcast may hold.
BROADCAST_BYTES = 8 << 20
#: Rows that a broadcast may hold (seeds: 24 bytes each; ids: 16); more seeds are joined block by block.
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    """Lower-case words; every character beyond ASCII counts as a letter."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _seeds(rows: DataFrame, keys: list[str], words: str, masks: list[tuple], by_length: bool = False) -> DataFrame:
    """One row for each seed of ``masks`` (or those for the row's length alone): keys, pos (of its first word) and seed."""
    offsets = sorted({o for m in masks for o in m})
    hashed = rows.where(F.size(words) > 0).select(*keys, F.transform(words, lambda w: F.xxhash64(w)).alias("h"))
    n = F.size("h")
    zipped = F.arrays_zip(F.sequence(F.lit(0), n - 1).alias("pos"), *(F.slice("h", F.lit(o + 1), n).alias(f"w{o}") for o in offsets))  # null beyond the end
    flat = hashed.select(*keys, F.least(n, F.lit(SPAN)).alias("length"), F.inline(zipped))
    seeds = []
    for m in masks:
        fits = F.col(f"w{m[-1]}").isNotNull()
        if by_length:
            fits = fits & F.col("length").isin([k for k, of in MASKS.items() if m in of])
        seeds.append(F.when(fits, F.xxhash64(F.lit(str(m)), *(f"w{o}" for o in m))))
    return flat.select(*keys, "pos", F.explode(F.array(*seeds)).alias("seed")).where("seed is not null")


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, contaminated, n_items, items, overlap) of every document; overlap is the best share of agreeing aligned words."""
    store = Store(spark, "decontaminate")
    items = benchmark.select(F.col(item_col).alias("item"), words_of(F.col(item_text_col)).alias("item_words")).where("item is not null").distinct()
    items = store.put(items.withColumn("item_key", F.xxhash64("item", "item_words")), "items")  # texts that repeat an item's id stay apart
    lengths = {r[0] for r in items.select(F.least(F.size("item_words"), F.lit(SPAN))).distinct().collect()}  # SPAN + 1 at most
    masks = sorted({m for k in lengths - {0} for m in MASKS[k]}) or list(MASKS[SPAN])
    index = store.put(_seeds(items, ["item_key"], "item_words", masks, by_length=True).select("seed", "item_key", F.col("pos").alias("item_pos")).distinct(), "index")
    blocks = max(1, -(-index.count() // BROADCAST_ROWS))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), words_of(F.col(text_col)).alias("words"))
    seeds = _seeds(texts, ["key"], "words", masks)
    hits = None
    for b in range(blocks):
        part = index.where(F.pmod("seed", F.lit(blocks)) == b) if blocks > 1 else index
        found = seeds.join(F.broadcast(part), "seed").select("key", "item_key", (F.col("pos") - F.col("item_pos")).alias("shift"), F.floor(F.col("item_pos") / STRETCH).cast("int").alias("stretch"))
        hits = found if hits is None else hits.unionByName(found)
    hits = store.put(hits.distinct(), "hits")

    keys = hits.select("key").distinct()
    few = broadcast_if_small(keys, keys.count(), BROADCAST_ROWS)
    hit_texts = texts.join(few, "key", "left_semi").groupBy("key").agg(F.first("id").alias("id"), F.first("words").alias("words"))  # rows of one key are equal
    # from the first place where a window from the stretch may begin to the last where it may end
    reach = [F.greatest(F.col("stretch") * STRETCH - (SPAN - 1), -F.col("shift"), F.lit(0)).alias("begin"), (F.col("stretch") * STRETCH + STRETCH + 2 * SPAN).alias("end")]
    asked = hits.select("key", F.struct("item_key", *reach, "shift").alias("hit")).groupBy("key").agg(F.collect_list("hit").alias("hits"))  # a text's own hits, four numbers each
    cut = F.transform("hits", lambda h: F.struct(h["item_key"].alias("item_key"), h["begin"].alias("begin"), h["end"].alias("end"), F.slice("words", h["begin"] + h["shift"] + 1, h["end"] - h["begin"]).alias("piece")))
    pieces = hit_texts.join(asked, "key").select("id", F.inline(cut))
    bytes_held = items.agg(F.sum(F.aggregate("item_words", F.lit(0).cast("long"), lambda a, w: a + F.length(w) + 24))).first()[0] or 0
    aligned = pieces.join(broadcast_if_small(items, bytes_held, BROADCAST_BYTES), "item_key")
    span = F.least(F.lit(SPAN), F.size("item_words"))
    own = F.slice("item_words", F.col("begin") + 1, F.col("end") - F.col("begin"))
    n = F.least(F.size("piece"), F.size(own))
    same = F.zip_with(F.slice("piece", F.lit(1), n), F.slice(own, F.lit(1), n), lambda x, y: (x == y).cast("int"))
    aligned = aligned.where(n >= span).select("id", "item", span.alias("span"), n.alias("n"), same.alias("same"))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.col("n") - F.col("span") + 1), lambda i: F.aggregate(F.slice("same", i, F.col("span")), F.lit(0), lambda a, x: a + x)))
    checked = aligned.select("id", "item", (best / F.col("span")).alias("share")).where(F.col("share") >= SHARE)
    found = checked.groupBy("id", "item").agg(F.max("share").alias("share")).groupBy("id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("item")).alias("items"), F.max("share").alias("overlap")).withColumnRenamed("id", "hit")
    every = docs.select(F.col(id_col).alias("id")).join(found, F.col("id").eqNullSafe(F.col("hit")), "left")
    return every.select(F.col("id").alias(id_col), F.col("n").isNotNull().alias("contaminated"), F.coalesce("n", F.lit(0)).alias("n_items"), "items", F.coalesce("overlap", F.lit(0.0)).alias("overlap"))

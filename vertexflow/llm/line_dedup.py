"""Fuzzy line deduplication by MinHash, with DataFrame functions alone.

Lines are compared in lower case with white space collapsed, by the sets of all their
character shingles of ``SHINGLE``. Equal lines form a class, and a class's signature is made
by an aggregate: every shingle of every line is a row that goes to one of ``BANDS`` * ``ROWS``
slots by its hash, and each slot keeps its least one (an empty slot borrows the next one's).
Of long lines only hashes below a cut can be a slot's least, so the others are left out first;
lines of so few different shingles that the cut leaves slots empty are signed again without it. ``ROWS`` slots are a band; at the threshold 0.985 of the pairs share
one or more. Pairs with a line of ``FEW`` shingles or less meet exactly as well, by a prefix
filter: similar sets share one of their rarest shingles. Candidates are compared on all
shingles, confirmed from a Jaccard similarity of ``PERCENT`` / 100, and joined into components
by distributed union-find; the first line of a component (by doc_id, then place) stays.

Lines are normalised and written once. Shingles are never written: pairs make them anew
from their lines.

Defined results: a null text stays null; blank lines are never dropped; a line shorter
than a shingle is one shingle; rows that repeat a doc_id and a text keep or lose the same
lines; rows with a null doc_id stay as they are; lines whose 64-bit key is that of another
line stay; all columns of the input are kept, but n_lines and n_dropped are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small
from .components import link_buckets
from .store import Store

SHINGLE, PERCENT = 9, 80
#: Most shingles of a line whose pairs are found exactly.
FEW = 32
BANDS, ROWS = 6, 3
#: Hashes of a line that the cut leaves for each slot on average, and the filled slots below which a cut line is signed again.
LEFT, FILLED = 3, 10
#: Shingles that are cut from one piece of a line: a substring is searched from the start.
_PIECE = 64
#: 64-bit words of an odd sketch; lines of buckets with more members than this get one.
LONGS, SKETCHED = 8, 4
#: Rows (of 50 bytes at most) that a broadcast may hold; beyond, the join is shuffled.
BROADCAST_ROWS = 400_000
#: Places in a document count below 2 ** 31, so (doc_id, place) is one number.
_PLACES = 1 << 31
#: Ids from -_DOCS and below _DOCS leave room for places in 64 bits.
_DOCS = 1 << 32
#: Bytes of a character in the fixed-width form that shingles are cut from.
_UNIT = 2


def _norm(line: Column) -> Column:
    """Lower case, white space collapsed; most lines need no pattern for it."""
    low, other = F.lower(F.trim(line)), F.lit(False)
    for space in ("\t", "\v", "\f", "\r", "  "):
        other = other | line.contains(space)
    return F.when(other, F.trim(F.regexp_replace(low, r"\s+", " "))).otherwise(low)


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, t, place, length, id, other, norm) of lines that aren't blank; t names the text, id and other the line."""
    texts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    lines = texts.select("doc", "t", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    # the ends tell whether a line is blank: a filter on the normal form would make that twice
    lines = lines.where(F.btrim("line", F.lit(" \t\v\f\r")) != "").select("doc", "t", "place", _norm(F.col("line")).alias("norm"))
    return lines.select("doc", "t", "place", F.length("norm").alias("length"), F.xxhash64("norm").alias("id"), F.xxhash64(F.lit("line"), "norm").alias("other"), "norm")


def _narrow(lines: DataFrame) -> bool:
    """Whether all (doc, place) fit a 64-bit number."""
    lo, hi = lines.agg(F.min("doc"), F.max("doc")).first()
    return lo is None or (lo >= -_DOCS and hi < _DOCS)


def _position(doc: str, place: str, narrow: bool) -> Column:
    """(doc, place) as one number, in the order of both; a decimal costs several times as much."""
    if narrow:
        return F.col(doc) * F.lit(_PLACES).cast("long") + F.col(place)
    return F.col(doc).cast("decimal(20,0)") * F.lit(_PLACES).cast("decimal(10,0)") + F.col(place).cast("decimal(10,0)")


def _shingles(norm: str) -> Column:
    """The hashes of all character shingles; a shorter line is one shingle.

    Lines whose characters all take one UTF-16 unit are cut from their bytes in fixed width; others
    by characters. Both hash the same bytes of a shingle.
    """
    more, wide = SHINGLE - 1, SHINGLE * _UNIT
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.length(norm) - more, F.lit(1)), F.lit(_PIECE)), lambda i: F.substring(F.col(norm), i, F.lit(_PIECE + more)))
    hashes = F.transform(pieces, lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - more, F.lit(1))), lambda i: F.xxhash64(F.encode(F.substring(c, i, F.lit(SHINGLE)), "UTF-16BE"))))
    # an array of one row's bytes: a lambda would encode the line for every shingle
    even = F.transform(F.array(F.encode(norm, "UTF-16BE")), lambda u: F.when(F.length(u) == F.length(norm) * _UNIT, F.transform(F.sequence(F.lit(1), F.greatest(F.length(u) - wide + 1, F.lit(1)), F.lit(_UNIT)), lambda i: F.xxhash64(F.substring(u, i, F.lit(wide))))))
    return F.coalesce(F.get(even, F.lit(0)), F.flatten(hashes))


def _elements(norm: str) -> Column:
    return F.array_distinct(_shingles(norm))


def _slots(lines: DataFrame, cut: bool) -> DataFrame:
    """(id, v0, ...) of lines (id, norm): the least hash of each slot, of long lines only those below a cut."""
    wide, slots, most = SHINGLE * _UNIT, BANDS * ROWS, float(LEFT * BANDS * ROWS)
    units = lines.select("id", F.encode("norm", "UTF-16BE").alias("units"))
    count = F.greatest((F.length("units") - wide) / _UNIT + 1, F.lit(1.0))
    below = F.when(count > most, (F.lit(2.0**31) * most / count).cast("long")) if cut else F.lit(None).cast("long")
    starts = F.sequence(F.lit(1), F.greatest(F.length("units") - wide + 1, F.lit(1)), F.lit(_UNIT))
    shingles = units.select("id", "units", F.coalesce(below, F.lit(1 << 31)).alias("below"), F.explode(starts).alias("i"))
    # substring, hash, filter and aggregate are one generated loop: no array of a line's hashes is made
    hashed = shingles.select("id", "below", F.xxhash64(F.substring("units", F.col("i"), F.lit(wide))).alias("e"))
    kept = hashed.select("id", "below", F.shiftrightunsigned("e", 33).alias("v"), F.shiftright(F.col("e").bitwiseAND(F.lit(0xFFFF)) * slots, 16).alias("slot")).where("v < below")
    # least values that are never null are cheaper to keep
    none = F.lit(1 << 31)
    least = kept.groupBy("id").agg(*(F.min(F.when(F.col("slot") == k, F.col("v")).otherwise(none)).alias(f"v{k}") for k in range(slots)))
    return least.select("id", *(F.nullif(f"v{k}", none).alias(f"v{k}") for k in range(slots)))


def _bands(signed: DataFrame) -> DataFrame:
    """(id, filled, bands): how many slots have a value, and the band hashes, for which an empty slot borrows the next one's.

    From the last band to the first, each a projection that hands on its first value. All slots
    behind each slot in one projection are a method of more than 8,000 bytes, which Java only interprets.
    """
    values = [f"v{k}" for k in range(BANDS * ROWS)]
    filled = sum((F.col(v).isNotNull().cast("int") for v in values[1:]), F.col(values[0]).isNotNull().cast("int"))
    out, made = signed.select("id", filled.alias("filled"), *values, F.coalesce(*values).alias("next")), []
    for b in reversed(range(BANDS)):
        own = values[b * ROWS : (b + 1) * ROWS]
        band = F.xxhash64(F.lit(b), *(F.coalesce(*own[i:], "next") for i in range(ROWS)))
        out = out.select("id", "filled", *values[: b * ROWS], *made, band.alias(f"b{b}"), F.coalesce(*own, "next").alias("next"))
        made.insert(0, f"b{b}")
    return out.select("id", "filled", F.array(*made).alias("bands"))


def _classes(store: Store, lines: DataFrame, narrow: bool) -> DataFrame:
    """(id, position, n, same, weak, bands) of equal lines; position is the first one's, same is false where the key stands for several lines."""
    found = lines.select("id", "other", "length", _position("doc", "place", narrow).alias("position"))
    found = found.groupBy("id").agg(F.min("position").alias("position"), F.count("*").alias("n"), F.min("other").alias("lo"), F.max("other").alias("hi"), F.max("length").alias("length"))
    signed = _bands(_slots(lines, True))
    weak = (F.col("length") - SHINGLE + 1 > LEFT * BANDS * ROWS) & (F.coalesce("filled", F.lit(0)) < FILLED)
    classes = store.put(found.join(signed, "id", "left").select("id", "position", "n", (F.col("lo") == F.col("hi")).alias("same"), weak.alias("weak"), "bands"), "classes")
    again = classes.where("weak").select("id", F.col("position").alias("first"))
    few = again.count()
    if not few:
        return classes
    bare = lines.join(broadcast_if_small(again, few, BROADCAST_ROWS), "id").where(_position("doc", "place", narrow) == F.col("first"))
    anew = store.put(_bands(_slots(bare, False)).select(F.col("id").alias("of"), F.col("bands").alias("anew")), "again")
    return classes.join(broadcast_if_small(anew, few, BROADCAST_ROWS), F.col("id") == F.col("of"), "left").select("id", "position", "n", "same", "weak", F.coalesce("anew", "bands").alias("bands"))


def _prefix_buckets(store: Store, short: DataFrame, percent: int) -> DataFrame:
    """(id, bucket) of the rarest shingles of lines (id, few): sets with a Jaccard similarity of percent / 100 share one."""
    each = store.put(short.select("id", F.explode("few").alias("e")).distinct(), "few")
    counts = each.groupBy("e").agg(F.count("*").alias("c"))
    ranked = each.join(counts, "e").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("c", "e"))).alias("es"))
    n = F.size("es")
    prefix = (n - F.ceil(n * percent / 100) + 1).cast("int")
    rare = ranked.select("id", F.explode(F.slice("es", F.lit(1), prefix)).alias("r")).where("r.c > 1")
    return rare.select("id", F.xxhash64(F.lit("shingle"), "r.e").alias("bucket")).distinct()


def _sketches(texts: DataFrame) -> DataFrame:
    """(id, n, s): the number of shingles and an odd sketch, in which each shingle flips the bit that its hash names."""
    e = F.col("e")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(e, 8).bitwiseAND(F.lit(63)).cast("int"))
    words = [F.bit_xor(F.when(e.bitwiseAND(F.lit(LONGS - 1)) == i, bit).otherwise(F.lit(0).cast("long"))) for i in range(LONGS)]
    return texts.select("id", F.explode(_elements("norm")).alias("e")).groupBy("id").agg(F.count("*").cast("int").alias("n"), F.array(*words).alias("s"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with later near-copies of lines dropped from their texts, and n_lines and n_dropped."""
    store = Store(spark, "line-dedup")
    lines = store.put(_lines(docs, id_col, text_col), "lines")
    narrow = _narrow(lines)
    classes = _classes(store, lines, narrow)

    short = lines.where(F.col("length") < SHINGLE + FEW * 100 // percent).groupBy("id").agg(F.min("norm").alias("norm"))
    prefixes = store.put(_prefix_buckets(store, short.select("id", _elements("norm").alias("few")), percent), "prefixes")
    banded = classes.where("same").select("id", F.explode(F.array_distinct("bands")).alias("bucket")).unionByName(prefixes.join(classes.where("not same").select("id"), "id", "left_anti"))
    full = store.put(banded.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"), "full")
    buckets = store.put(banded.join(broadcast_if_small(full.select("bucket"), full.count(), BROADCAST_ROWS), "bucket"), "buckets")

    wanted = store.put(buckets.select("id").distinct().join(classes.select("id", "position"), "id"), "wanted")
    found = lines.join(broadcast_if_small(wanted, wanted.count(), BROADCAST_ROWS), "id").where(_position("doc", "place", narrow) == F.col("position"))
    texts = store.put(found.select("id", "norm").dropDuplicates(["id"]), "texts")
    crowded = buckets.join(full.where(F.col("members") > SKETCHED).select("bucket"), "bucket", "left_semi").select("id").distinct()
    sketches = store.put(_sketches(texts.join(crowded, "id", "left_semi")), "sketches")
    sizes = store.put(texts.select("id").join(sketches, "id", "left"), "sizes")
    store.drop(full)
    store.drop(wanted)
    store.drop(sketches)

    def similarity(pairs: DataFrame) -> DataFrame:
        def of(side: str) -> DataFrame:
            """The texts that a side of the pairs names: later rounds name few of them, and the others needn't be shuffled and sorted."""
            named = pairs.select(side).distinct()
            return texts.select(F.col("id").alias(side), F.col("norm").alias(f"t{side}")).join(broadcast_if_small(named, named.count(), BROADCAST_ROWS), side, "left_semi")

        one, two = of("a"), of("b")
        met = pairs.join(one, "a").join(two, "b").select("a", "b", _shingles("ta").alias("sa"), _shingles("tb").alias("sb"))
        return met.select("a", "b", (F.size(F.array_intersect("sa", "sb")) / F.size(F.array_union("sa", "sb"))).alias("j"))

    labels = link_buckets(store, buckets, sizes, similarity, percent, LONGS)
    linked = store.put(labels.join(classes.select("id", "position"), "id"), "linked")
    first = linked.groupBy("component").agg(F.min("position").alias("keep"))
    kept = classes.where("same and n > 1").select("id", "position").join(linked.select("id"), "id", "left_anti").unionByName(linked.join(first, "component").select("id", F.col("keep").alias("position")))
    kept = store.put(kept, "kept")
    drops = lines.select("doc", "t", "place", "id").join(broadcast_if_small(kept, kept.count(), BROADCAST_ROWS), "id").where(_position("doc", "place", narrow) != F.col("position"))
    per_text = store.put(drops.groupBy("doc", "t").agg(F.collect_set("place").alias("drop")), "drops")
    for old in (lines, buckets, texts, sizes, linked, kept):
        store.drop(old)

    joined = docs.select(F.struct("*").alias("row")).join(per_text, (F.col("row").getField(id_col).cast("long") == F.col("doc")) & (F.xxhash64(F.col("row").getField(text_col)) == F.col("t")), "left")
    text = F.col("row").getField(text_col)
    some = F.when(F.col("drop").isNotNull(), F.split(text, "\n"))
    done = joined.select("row", some.alias("some"), F.array_except(F.sequence(F.lit(0), F.size(some) - 1), "drop").alias("stay"), F.coalesce(F.size("drop"), F.lit(0)).alias("gone"))
    left = F.array_join(F.transform("stay", lambda i: F.get("some", i)), "\n")
    n_lines = F.when(text.isNull(), 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return done.select(
        *(F.when(F.col("some").isNotNull(), left).otherwise(text).alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in columns),
        n_lines.alias("n_lines"), F.when(F.col("gone") > 0, F.col("gone")).otherwise(0).cast("long").alias("n_dropped"),
    )

"""Links within candidate buckets, and connected components, as DataFrame rounds.

Both keep every round in a written table, so a lost executor repeats one round at
most, and neither brings links or labels to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Store

#: Members of a bucket that are compared with all its other members in the second round and at most in a later one; the number doubles.
PIVOTS = (4, 256)
#: Tables counted at no more rows than this (100 bytes each at most) go through one task, which saves the
#: shuffles of many rounds over little data; larger ones are shuffled. Results are the same.
FEW_ROWS = 1_000_000


def _few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` as one partition, whose joins and groups need no shuffle, if it has few rows."""
    return df.coalesce(1) if rows <= FEW_ROWS else df


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def connected(store: Store, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id of ``links``; component is the smallest id that it reaches.

    Alternating large-star and small-star steps (distributed union-find): each hooks the
    neighbours of a node to the smallest one. A hub's minimum is a partial aggregate and
    comes back by a join that may be split, so no task holds a hub's neighbours.
    """
    edges = store.put(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    state = _state(edges)
    few = state[0]  # no round makes more edges than there were
    while state[0]:
        edges_at, edges = edges, _few(edges, few)
        both = _few(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), few)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large_at = store.put(large, "large")
        large = _few(large_at, few)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = store.put(_few(moved.unionByName(least.select("u", F.col("m").alias("v"))), few).distinct(), "edges")
        store.drop(large_at)
        store.drop(edges_at)
        edges, before, state = after, state, _state(_few(after, few))
        if state == before:
            break
        if state[0] > FEW_ROWS:
            store.release()
    edges = _few(edges, few)
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return _few(edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots), few)


def _apart(x: Column, y: Column, longs: int) -> Column:
    """Bits in which two odd sketches differ: never more than the elements that only one of the sets has."""
    return sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(1, longs)), F.bit_count(F.get(x, F.lit(0)).bitwiseXOR(F.get(y, F.lit(0)))))


def one_row(sets: DataFrame) -> DataFrame:
    """(id, n, s) of sets (id, n, s); n and s are null for an id with several sets, which no bound may then rule out."""
    return sets.groupBy("id").agg(F.when(F.count("*") == 1, F.first("n")).alias("n"), F.when(F.count("*") == 1, F.first("s")).alias("s"))


def link_buckets(store: Store, buckets: DataFrame, sizes: DataFrame, similarity: Callable[[DataFrame], DataFrame], percent: int, longs: int, pivots: tuple[int, int] = PIVOTS) -> DataFrame:
    """(id, component) over links with a Jaccard similarity of ``percent`` / 100 among ids that share a bucket.

    ``buckets`` has (bucket, id), each once; ``sizes`` has (id, n, s): a set's size and its odd
    sketch, ``longs`` 64-bit words in which every element flips the bit that its hash names;
    ``similarity`` gets distinct (a, b), a < b, and returns (a, b, j). A round compares each
    bucket's members with one pivot (the first round: the member that meets most others over all
    its buckets) or with several of them, from all components and more from the smaller ones
    (few while large components still form, up to ``pivots[1]`` later), never a member with one of its own component, and sets the pivots aside: all their pairs
    are then decided. It ends when no bucket spans two components.

    Pairs that cannot be links aren't compared. Sets of n and m elements are linked only if at most
    (n + m) * (100 - percent) / (100 + percent) elements are in one of them alone, and their
    sketches differ in no more bits than that; and as 1 - Jaccard is a metric, two members whose
    distances to the first pivot differ by more than 1 - ``percent`` / 100 are too far apart.
    """
    t, first, labels, now = percent / 100, True, None, pivots[0]
    rows = buckets.count()

    def kept(df: DataFrame, name: str) -> DataFrame:
        """A table of at most a row for each bucket member, and the written one under it."""
        at = store.put(df, name)
        few = _few(at, rows)
        few._stored_at = at._stored_at
        return few

    buckets, sizes = _few(buckets, rows), _few(sizes, rows)
    full = buckets.groupBy("bucket").agg(F.count("*").alias("members"))
    central = buckets.join(full, "bucket").groupBy("id").agg(F.sum("members").alias("w"))
    rest = buckets.join(central, "id").select("bucket", "id", "w", F.lit(None).cast("double").alias("d"))

    def possible(n, s, m, r):
        most = (n + m) * (100 - percent)
        return F.coalesce((F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (_apart(s, r, longs) * (100 + percent) <= most), F.lit(True))

    while True:
        labelled = rest.withColumn("label", F.col("id")) if labels is None else rest.join(labels, "id", "left").select("bucket", "id", "w", "d", F.coalesce("component", "id").alias("label"))
        labelled = kept(labelled, "labelled")
        spans = labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket")
        active = labelled.join(spans, "bucket", "left_semi")
        best = F.min(F.struct((-F.col("w")).alias("far"), "id")).alias("p")
        if first:
            leaders = kept(active.groupBy("bucket").agg(best).select("bucket", F.col("p.id").alias("pivot")), "leaders")
            met = active.join(leaders, "bucket").where("id <> pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
            one, two = sizes.select(F.col("id").alias("a"), F.col("n").alias("an"), F.col("s").alias("as")), sizes.select(F.col("id").alias("b"), F.col("n").alias("bn"), F.col("s").alias("bs"))
            pairs = store.put(met.join(one, "a").join(two, "b").where(possible(F.col("an"), F.col("as"), F.col("bn"), F.col("bs"))).select("a", "b"), "pairs")
        else:
            active = kept(active.join(sizes, "id"), "active")
            # one of each component, then more of each but the largest, whose members the others' pivots decide
            groups = active.groupBy("bucket", "label").agg(F.count("*").alias("c")).groupBy("bucket").agg(F.max(F.struct("c", "label")).alias("big")).select("bucket", F.col("big.label").alias("big"))
            inside = Window.partitionBy("bucket", "label").orderBy(F.desc("w"), "id")
            leaders = active.withColumn("r", F.row_number().over(inside)).where(F.col("r") <= now).join(groups, "bucket").where("r = 1 or label <> big")
            order = Window.partitionBy("bucket").orderBy("r", F.desc("w"), "label")
            leaders = leaders.withColumn("i", F.row_number().over(order)).where(F.col("i") <= now)
            leaders = kept(leaders.select(F.col("bucket").alias("of_bucket"), F.col("label").alias("of"), F.col("id").alias("pivot"), F.col("n").alias("pn"), F.col("s").alias("ps"), F.col("d").alias("pd")), "leaders")
            if leaders.isEmpty():
                return labels if labels is not None else buckets.select("id", F.col("id").alias("component")).limit(0)
            near = F.coalesce(F.abs(F.col("d") - F.col("pd")) <= 1 - t + 1e-9, F.lit(True))
            can = (F.col("label") != F.col("of")) & (near | F.col("s").isNull() | F.col("ps").isNull()) & possible(F.col("n"), F.col("s"), F.col("pn"), F.col("ps"))
            now = min(2 * now, pivots[1])
            # every member with all its bucket's leaders: shuffled, however few the rows
            many, some = (store.read(d) for d in (active, leaders))
            met = many.join(some, (F.col("bucket") == F.col("of_bucket")) & can)
            pairs = store.put(met.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct(), "pairs")
        scored = (kept if first else store.put)(similarity(pairs), "scored")  # first: a pair a member at most
        found = scored.where(F.col("j") >= t - 1e-12).select("a", "b")
        if not found.isEmpty():
            if labels is not None:
                found = found.unionByName(labels.select(F.col("id").alias("a"), F.col("component").alias("b")))
            labels = kept(connected(store, found), "labels")
        if first:
            own = active.drop("d").join(leaders, "bucket").where("id <> pivot")
            apart = scored.select("a", "b", (1 - F.col("j")).alias("d"))
            rest = own.join(apart, (F.least("id", "pivot") == F.col("a")) & (F.greatest("id", "pivot") == F.col("b")), "left").select("bucket", "id", "w", "d")
        else:
            rest = active.join(leaders.select("of_bucket", "pivot"), (F.col("bucket") == F.col("of_bucket")) & (F.col("id") == F.col("pivot")), "left_anti").select("bucket", "id", "w", "d")
        rest = kept(rest, "rest")
        for old in (labelled, leaders, pairs, scored, *([] if first else [active])):
            store.drop(old)
        if rows > FEW_ROWS:
            store.release()
        first = False

"""Best-fit packing planned on a histogram of lengths.

The driver sees only how many pieces there are of each length (at most ``capacity``
numbers). Best-fit decreasing runs over these counts: a placement puts k pieces of one
length into k consecutive sequences that look alike. Pieces then take their slots by a
join on (length, rank within the length). Ranks are counted within salted groups, so a
length that a third of all pieces share is not one task's work.

Defined results: null text is empty, one piece with the end id alone; rows with a null
doc_id and repeated rows are packed like any others (repeated doc_ids give repeated
piece numbers); an empty table packs into no sequence.
"""

from __future__ import annotations

import bisect
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .pieces import encoder, sized_batches
from .store import Store


#: Bytes of texts whose pieces are held at once (a text at least).
HELD = 4 << 20
#: Words that a worker keeps: fewer than ``pieces.CACHE``, as workers outlive the query by a minute and the next one's memory adds to theirs.
WORDS = 200_000


def plan_best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, first rank, ranks, first sequence, offset) for ``counts`` pieces of each length.

    The work and the plan grow with the number of different lengths, not with the pieces.
    """
    plan, sequences = [], 0
    open_: dict[int, list[tuple[int, int]]] = {}  # free space: stretches (first sequence, how many)
    free: list[int] = []  # its keys in order

    def put(space: int, first: int, n: int) -> None:
        if space:
            if space not in open_:
                open_[space] = []
                bisect.insort(free, space)
            open_[space].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(free, length)
            if at < len(free):
                space = free[at]
                first, n = open_[space].pop()
                if not open_[space]:
                    del open_[space]
                    free.pop(at)
                k = min(n, left)
                if k < n:
                    put(space, first + k, n - k)
                plan.append((length, rank, k, first, capacity - space))
                put(space - length, first, k)
            else:
                each = capacity // length
                k = max(1, left // each)
                fill = each if left >= each else left
                for i in range(fill):
                    plan.append((length, rank + i * k, k, sequences, i * length))
                put(capacity - fill * length, sequences, k)
                sequences += k
                rank, left = rank + fill * k, left - fill * k
                continue
            rank, left = rank + k, left - k
    return plan


def cut_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, drops_space: bool, with_ids: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every whole text's ids and the end id."""
    end, query = np.uint32(end_id).tobytes(), uuid.uuid4().hex

    def run(batches):
        own = encoder(path, drops_space, "<u4", query, WORDS)
        for batch in batches:
            for part in sized_batches(batch, 1, HELD):
                rows = []
                for key, x in zip(part.column(0).to_pylist(), own.values(part.column(1))):
                    x += end
                    for i, at in enumerate(range(0, len(x), 4 * capacity)):
                        y = x[at : at + 4 * capacity]
                        rows.append((key, i, at // 4, len(y) // 4, zlib.crc32(y), y if with_ids else None))
                columns = list(zip(*rows)) or [[]] * 6
                types = [part.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = [id_col, "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
            part = rows = columns = None
            pa.default_memory_pool().release_unused()

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, ids binary")
    return out if with_ids else out.drop("ids")


def pack(spark: SparkSession, docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, drops_space: bool = True, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of ``docs`` with their sequence_id and offset; ``with_ids`` keeps each piece's ids."""
    store = Store(spark, "packing")
    pieces = store.put(cut_pieces(docs, path, capacity, end_id, drops_space, with_ids, id_col, text_col), "pieces")
    salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    groups = store.put(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "histogram")
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = spark.createDataFrame(plan_best_fit(counts, capacity) or [], "length long, first_rank long, ranks long, first_sequence long, offset long")
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = groups.select("length", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy(id_col, "piece", "ids_crc32")
    ranked = salted.withColumn("own", F.row_number().over(own) - 1).join(base, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("base"))
    # the plan's size is bounded by the square of the capacity at worst and by a few rows a length in practice
    slots = F.broadcast(plan)
    inside = (F.col("p.length") == slots["length"]) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("ranks"))
    out = ranked.alias("p").join(slots, inside)
    kept = [id_col, "piece", "start", F.col("p.length").alias("length"), "ids_crc32", (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset"]
    return out.select(*kept, *(["ids"] if with_ids else []))

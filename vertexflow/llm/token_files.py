"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

Ids are replaced by their rank in the corpus's token frequencies, so frequent ids
take one byte. A block holds the documents of one stretch of ascending doc_id: a
data stream of 1 to 4 bytes per rank and, apart from it, a control stream with two
bits per rank (its length less one, four ranks to a byte, lowest bits first).
Decoding looks up four lengths per control byte in a numpy table.

Files are Parquet tables written by Spark's committer (any file system, safe under
retries): ``blocks`` (shard, block, doc ids, token counts, control, data) and
``ranks`` (rank, id), the latter bounded by the vocabulary.

Defined results: null text is the empty text and holds the end id alone; rows with a
null doc_id come first; rows that repeat a doc_id stay separate, ordered by their ids'
bytes; an empty table gives empty files.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .pieces import encoder, sized_batches
from .store import Store

#: Tokens after which a block ends (it ends with a document), and bytes of a value by its control bits.
BLOCK_TOKENS = 1 << 18
_LENGTHS = np.array([[(c >> (2 * i) & 3) + 1 for i in range(4)] for c in range(256)], np.int64)
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit values."""
    v = values.astype("<u4")
    length = 1 + (v > 0xFF) + (v > 0xFFFF).astype(np.int64) + (v > 0xFFFFFF)
    bits = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    bits[: len(v)] = length - 1
    bits = bits.reshape(-1, 4)
    control = bits[:, 0] | bits[:, 1] << 2 | bits[:, 2] << 4 | bits[:, 3] << 6
    keep = np.arange(4) < length[:, None]
    return control.astype(np.uint8).tobytes(), v.view(np.uint8).reshape(-1, 4)[keep].tobytes()


def unpack_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of a control and a data stream."""
    length = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    start = np.cumsum(length) - length
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    if not n:
        return np.zeros(0, np.uint32)
    value = raw[start] | raw[start + 1] << 8 | raw[start + 2] << 16 | raw[start + 3] << 24
    return value & _MASKS[length]


def encode_ids(docs: DataFrame, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", drops_space: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids): the ids of every whole text and ``end_id``, as little-endian unsigned integers of ``id_width(path)``."""
    kind, query = id_width(path), uuid.uuid4().hex
    end = np.array([end_id], kind).tobytes()

    def run(batches):
        own = encoder(path, drops_space, kind, query)
        for batch in batches:
            for part in sized_batches(batch):
                ids = [x + end for x in own.values(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // len(end) for x in ids], pa.int64()), pa.array(ids, pa.binary())], [id_col, "n_tokens", "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids binary")


def id_width(path: str) -> str:
    """Two bytes for the temporary ids of a vocabulary that they can count, else four."""
    from .pieces import load

    return "<u2" if load(path).get_vocab_size() <= 1 << 16 else "<u4"


def rank_table(ids: DataFrame, kind: str) -> np.ndarray:
    """Ids by falling frequency (ties: smaller id), over all documents; its length is at most the vocabulary's."""

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for part in sized_batches(batch, 0):
                n = np.bincount(np.frombuffer(b"".join(part.column(0).to_pylist()), kind))
                total, n = (n, total) if len(n) > len(total) else (total, n)
                total[: len(n)] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    rows = ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").collect()
    return np.array([r["id"] for r in rows], np.uint32)


def write_token_files(spark: SparkSession, docs: DataFrame, tokenizer_path: str, out_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` and write the files under ``out_path`` in ascending doc_id order."""
    store = Store(spark, "token-ids")
    kind = docs.schema[id_col].dataType.simpleString()
    ids = store.put(encode_ids(docs, tokenizer_path, end_id, id_col, text_col), "ids")
    width = id_width(tokenizer_path)
    order = rank_table(ids, width)
    rank = np.zeros(int(order.max(initial=0)) + 1, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    sent = spark.sparkContext.broadcast(rank)

    def blocks(batches):
        keys, counts, values, held, block, shard = [], [], [], 0, 0, 0

        def flush():
            control, data = pack_values(sent.value[np.concatenate(values)])
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int64()), pa.array([keys]).cast(pa.list_(key_type)), pa.array([counts], pa.list_(pa.int64())), pa.array([control], pa.binary()), pa.array([data], pa.binary())], ["shard", "block", "doc_ids", "counts", "control", "data"])

        for batch in batches:
            key_type = batch.schema.field(0).type
            for k, n, x, shard in zip(*(batch.column(i) for i in range(4)), strict=True):
                shard = shard.as_py()
                keys.append(k.as_py())
                counts.append(n.as_py())
                values.append(np.frombuffer(x.as_buffer(), width))
                held += counts[-1]
                if held >= BLOCK_TOKENS:
                    yield flush()
                    keys, counts, values, held, block = [], [], [], 0, block + 1
        if keys:
            yield flush()

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = ids.repartitionByRange(n, id_col).sortWithinPartitions(id_col, "ids").select(id_col, "n_tokens", "ids", F.spark_partition_id().alias("shard"))
    ordered.mapInArrow(blocks, f"shard int, block long, doc_ids array<{kind}>, counts array<long>, control binary, data binary").write.parquet(f"{out_path}/blocks")
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(order)], "rank long, id long").coalesce(1).write.parquet(f"{out_path}/ranks")
    store.drop(ids)


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in the files; start counts the ids before it."""
    order = np.array([r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], "<u4")
    sent = spark.sparkContext.broadcast(order)
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    sizes = blocks.select("shard", "block", total.alias("n"))
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n"))
    # one row per shard and per block: the running sums are over file headers, not over documents
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "block", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("block_start")).join(shards, "shard").select("shard", "block", (F.col("block_start") + F.col("shard_start")).alias("start"))

    def decode(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                keys, counts, control, data, start = (batch.column(c)[i] for c in range(5))
                n = np.array(counts.as_py(), np.int64)
                ids = sent.value[unpack_values(control.as_py(), data.as_py(), int(n.sum()))] if n.sum() else np.zeros(0, "<u4")
                ends = np.cumsum(n)
                parts = [ids[e - k : e].tobytes() for e, k in zip(ends, n)]
                yield pa.RecordBatch.from_arrays([keys.values, pa.array(start.as_py() + ends - n, pa.int64()), pa.array(n, pa.int64()), pa.array([zlib.crc32(x) for x in parts], pa.int64()), pa.array(parts if with_ids else [None] * len(parts), pa.binary())], [id_col, "start", "n_tokens", "ids_crc32", "ids"])

    out = blocks.join(starts, ["shard", "block"]).select("doc_ids", "counts", "control", "data", "start").mapInArrow(decode, f"`{id_col}` {kind}, start long, n_tokens long, ids_crc32 long, ids binary")
    return out if with_ids else out.drop("ids")

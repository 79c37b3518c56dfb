"""Training-order materialisation of token ids.

Every document's token sequence gets a slot by a keyed permutation of 0..n-1: a Feistel network over the next power of
two, walked along its cycle until the value is below n. The slot follows from the key and the sequence's number alone,
so a rerun gives the same order. Slots are cut into ranges of equal size, one for each shard; a shard's task tokenises
its sequences in slot order, joins them with the end-of-document id, and writes records of a fixed number of ids. A
record has RECORD ids of two bytes and one line feed, so record r of a shard starts at byte r * STRIDE: a reader
resumes by seeking. The last record of a shard is filled up with the end-of-document id.

Texts cross the network, not token ids, and only once; sequence numbers come from counts by partition.

Defined cases: null and empty texts are sequences without tokens; repeated rows are sequences of their own; a null
doc_id is kept; further columns are ignored; an empty table writes nothing and gives no rows. The documents must come
from files or tables, whose order a second reading keeps."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .arrowtext import mix64
from .storage import new_folder

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Free in that vocabulary.
END_ID = 50256
RECORD = 2048
STRIDE = 2 * RECORD + 1
KEY = 20240607
SEQUENCES_PER_SHARD = 4096
ROUNDS = 8
#: How texts are split before byte pairs are merged; a fixed value of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ROW_BITS = 33


def permute(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The keyed permutation of 0..n-1 at the given places."""
    if n <= 1:
        return np.zeros(len(index), np.int64)
    bits = max(2, (n - 1).bit_length())
    low = bits // 2
    low_mask, high_mask = np.uint64((1 << low) - 1), np.uint64((1 << (bits - low)) - 1)
    round_keys = mix64(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(key % (1 << 63)) * np.uint64(ROUNDS + 1))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(low), x & low_mask
        for i, k in enumerate(round_keys):
            if i % 2:
                right = right ^ (mix64(left ^ k) & low_mask)
            else:
                left = left ^ (mix64(right ^ k) & high_mask)
        return (left << np.uint64(low)) | right

    out = once(index.astype(np.uint64))
    while (far := out >= n).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def numbered(documents: DataFrame) -> tuple[Column, int]:
    """A column with each row's number from 0, and the number of rows. One count for each partition reaches the
    driver."""
    counts = sorted((r[0], r[1]) for r in documents.groupBy(F.spark_partition_id().alias("p")).count().collect())
    first, n = {}, 0
    for p, c in counts:
        first[p], n = n, n + c
    table = F.array(*[F.lit(first.get(p, 0)).cast("long") for p in range(max(first, default=0) + 1)])
    row = F.monotonically_increasing_id()
    return F.element_at(table, F.shiftright(row, _ROW_BITS).cast("int") + 1) + row.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)), n


def slots(n: int, key: int = KEY):
    """A vectorised function from sequence numbers to slots."""

    @pandas_udf("long")
    def slot(index: pd.Series) -> pd.Series:
        return pd.Series(permute(index.to_numpy(), n, key))

    return slot


def tokenizer(ranks: bytes):
    import tiktoken

    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


def write_shards(documents: DataFrame, path: str, tokens: str = TOKENIZER, key: int = KEY, per_shard: int = SEQUENCES_PER_SHARD, record: int = RECORD) -> DataFrame:
    """Writes the shards part-NNNNN and returns doc_id, slot of every sequence."""
    spark = documents.sparkSession
    index, n = numbered(documents.select("doc_id"))
    slot = slots(n, key)
    placed = documents.select("doc_id", index.alias("i")).select("doc_id", slot("i").alias("slot"))
    if not n:
        return placed
    with open(tokens, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    n_shards = -(-n // per_shard)
    texts = documents.select("text", index.alias("i")).select("text", slot("i").alias("slot")).withColumn("shard", F.floor(F.col("slot") / per_shard).cast("int"))
    ordered = texts.repartitionById(n_shards, F.col("shard")).sortWithinPartitions("slot").select("text")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer(ranks.value)
        end = np.array([END_ID], "<u2")
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for text in batch.column("text"):
                ids = np.array(enc.encode_ordinary(text.as_py() or ""), "<u2")
                held += [ids, end]
                size += len(ids) + 1
                if size >= 64 * record:
                    flat = np.concatenate(held)
                    whole = len(flat) - len(flat) % record
                    yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in flat[:whole].reshape(-1, record)], pa.binary())], ["value"])
                    held, size = [flat[whole:]], len(flat) - whole
        if size:
            flat = np.concatenate([*held, np.full(-size % record, END_ID, "<u2")])
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in flat.reshape(-1, record)], pa.binary())], ["value"])

    ordered.mapInArrow(packed, "value binary").select(F.col("value").cast("string")).write.text(path)
    return placed


def read_records(spark: SparkSession, path: str, shard: int = 0, first_record: int = 0, record: int = RECORD) -> DataFrame:
    """(shard, record, tokens as little-endian pairs of bytes) from a place on, in order within a shard."""
    stride = 2 * record + 1
    files = _shards(spark, path).where(F.col("shard") >= shard)
    start = F.when(F.col("shard") == shard, first_record).otherwise(0)
    n = F.floor(F.length("content") / stride)
    places = files.select("shard", "content", F.explode(F.when(n > start, F.sequence(start.cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))).alias("record"))
    return places.select("shard", "record", F.substring("content", (F.col("record") * stride + 1).cast("int"), F.lit(2 * record)).alias("tokens"))


def _shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("int").alias("shard"), "content").where("shard is not null")


def sequence_places(spark: SparkSession, path: str, n: int, per_shard: int = SEQUENCES_PER_SHARD, record: int = RECORD) -> DataFrame:
    """slot, shard, start (in the shard's ids), n_tokens of every sequence, found in the shards themselves."""
    stride = 2 * record + 1

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
                raw = np.frombuffer(content.as_buffer(), np.uint8)
                ids = np.ascontiguousarray(raw.reshape(-1, stride)[:, :-1]).reshape(-1).view("<u2")
                ends = np.flatnonzero(ids == END_ID)[: min(per_shard, n - shard * per_shard)]
                starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)[: len(ends)]
                k = len(ends)
                yield pa.RecordBatch.from_arrays([pa.array(shard * per_shard + np.arange(k, dtype=np.int64)), pa.array(np.full(k, shard, np.int32)), pa.array(starts), pa.array((ends - starts).astype(np.int64))], ["slot", "shard", "start", "n_tokens"])

    return _shards(spark, path).mapInArrow(scanned, "slot long, shard int, start long, n_tokens long")


def materialise(documents: DataFrame, path: str | None = None, tokens: str = TOKENIZER, key: int = KEY, per_shard: int = SEQUENCES_PER_SHARD, record: int = RECORD) -> DataFrame:
    """doc_id, slot, shard, start, n_tokens of every sequence; the shards are at the path, or in the shared folder."""
    spark = documents.sparkSession
    path = path or new_folder(spark, "shards")
    placed = write_shards(documents, path, tokens, key, per_shard, record)
    n = documents.count()
    if not n:
        return placed.select("doc_id", "slot", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n_tokens"))
    return placed.join(sequence_places(spark, path, n, per_shard, record), "slot").select("doc_id", "slot", "shard", "start", "n_tokens")

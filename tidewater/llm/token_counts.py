"""Token counts by separator scan.

A flat token file holds the tokens of one document after another, each document ended by the end-of-document id; it
has no index. The file is cut into blocks; each block is searched at once for the id, which gives the lengths of the
documents inside it, the tokens before its first separator and the place after its last one. A prefix maximum of those
places over the blocks of a file tells where the document that is open at a block's start began, which stitches
documents across blocks of any number.

`write_token_files` makes such files with Spark's own text writer: one row for each document, its ids as raw bytes, and
the end-of-document id as the line separator.

Defined cases: documents without tokens (null and empty texts) are counted as 0; tokens after the last separator are an
unfinished document (`closed` false); a torn last id is left out; an empty file has no documents; repeated rows are
documents of their own; further columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrowtext import chunks
from .sentencepiece_codec import MODEL, loaded, read_model
from .storage import new_folder

#: The model's end-of-sequence id; its bytes must be ASCII, as Spark writes them as a line separator.
END_ID = 2
WIDTH = 2
BLOCK_BYTES = 1 << 20
_ROW_BITS = 33


def scan_block(tokens: np.ndarray, end_id: int) -> np.ndarray:
    """The places of the separators."""
    return np.flatnonzero(tokens == end_id)


def count_tokens(spark: SparkSession, path: str, end_id: int = END_ID, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, doc_no, start, n_tokens, closed for every document of the token files at the path. A file is read whole
    by one task: keep files below some hundred MB."""
    step = block_bytes - block_bytes % width
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    n_blocks = F.greatest(F.ceil(F.col("length") / step), F.lit(1)).cast("int")
    blocks = files.select("path", "content", F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("block")).select("path", "block", F.substring("content", F.col("block") * step + 1, F.lit(step)).alias("bytes"))
    kind = np.dtype(f"<u{width}")

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, ends = [], []
            for raw in b.column("bytes"):
                data = raw.as_buffer() or b""
                tokens = np.frombuffer(data, kind, len(data) // width)
                n.append(len(tokens))
                ends.append(scan_block(tokens, end_id))
            flat = np.concatenate([*ends, np.zeros(0, np.int64)])
            offsets = np.concatenate([[0], np.cumsum([len(e) for e in ends])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("path"), b.column("block"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int64)))], ["path", "block", "n", "ends"]
            )

    found = blocks.mapInArrow(scanned, "path string, block int, n long, ends array<long>")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    seps = F.size("ends")
    first = F.col("block").cast("long") * (step // width)
    after = F.when(seps > 0, first + F.element_at("ends", -1) + 1)  # the place after a block's last separator
    placed = found.select(
        "*",
        first.alias("first"),
        F.coalesce(F.max(after).over(before), F.lit(0)).alias("opened"),
        F.coalesce(F.sum(seps).over(before), F.lit(0)).alias("docs"),
        F.lead("block").over(Window.partitionBy("path").orderBy("block")).isNull().alias("last"),
    )
    none = F.array().cast("array<long>")
    # in each block the documents that end there, and in the last one what no separator ends
    open_end = F.col("last") & (F.col("n") > F.when(seps > 0, F.element_at("ends", -1) + 1).otherwise(F.col("opened") - F.col("first")))
    begins = F.concat(F.array(F.lit(None).cast("long")), F.transform("ends", lambda e: e + 1))
    stops = F.concat(F.col("ends"), F.when(open_end, F.array("n")).otherwise(none))
    docs = placed.select("path", "docs", "first", "opened", seps.alias("seps"), F.posexplode(F.arrays_zip(F.slice(begins, F.lit(1), F.size(stops)).alias("b"), stops.alias("e"))).alias("i", "d"))
    start = F.coalesce(F.col("first") + F.col("d.b"), F.col("opened"))
    return docs.select(F.element_at(F.split("path", "/"), -1).alias("file"), (F.col("docs") + F.col("i")).alias("doc_no"), start.alias("start"), (F.col("first") + F.col("d.e") - start).alias("n_tokens"), (F.col("i") < F.col("seps")).alias("closed"))


def write_token_files(documents: DataFrame, path: str, model: str = MODEL, end_id: int = END_ID) -> DataFrame:
    """Writes flat token files, one for each partition of the documents, and returns where each document went:
    doc_id, file_no (the number in the file's name), doc_no. The documents must come from files or tables, so that a
    second reading has the same order."""
    raw = documents.sparkSession.sparkContext.broadcast(read_model(model))
    m = loaded(raw.value)
    end = int(end_id).to_bytes(m.width.itemsize, "little")
    if not end.isascii():
        raise ValueError("the end-of-document id must be ASCII bytes")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = loaded(raw.value)
        for batch in batches:
            for part in chunks(batch, "text", 2 << 20):
                yield pa.RecordBatch.from_arrays([pa.array(codec.encode_texts(part.column("text").to_pylist()), pa.binary())], ["value"])

    documents.select("text").mapInArrow(encoded, "value binary").select(F.col("value").cast("string")).write.option("lineSep", end.decode()).text(path)
    row = F.monotonically_increasing_id()
    return documents.select("doc_id", F.shiftright(row, _ROW_BITS).cast("int").alias("file_no"), row.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("doc_no"))


def document_counts(documents: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, file_no, doc_no, start, n_tokens: writes token files to the shared folder and scans them."""
    spark = documents.sparkSession
    path = new_folder(spark, "tokens")
    where = write_token_files(documents, path, model)
    found = count_tokens(spark, path).select(F.regexp_extract("file", r"^part-(\d+)", 1).cast("int").alias("file_no"), "doc_no", "start", "n_tokens")
    return where.join(found, ["file_no", "doc_no"]).select("doc_id", "file_no", "doc_no", "start", "n_tokens")

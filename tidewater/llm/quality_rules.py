"""Quality rules: compression bands.

A document is judged by the zstandard ratio (compressed by raw bytes) of its whole text and of its chunks of fixed
size. A ratio below the band of its length is repetitive text, one above it is incompressible text. Base counts of
words, symbols, repeated lines and repeated word windows come first and may fail a document by themselves.

Defined cases: null counts as empty; a text of fewer than 10 words fails the base rule; every text with a byte is judged
by the band of its length; where the length is no multiple of the chunk size the last chunk reaches back into the one
before, and a text of less than a chunk has no chunks but the whole; equal rows get equal
results; further columns are ignored. Windows of five words are compared by 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .arrowtext import SPACE, byte_counts, chunks, class_table, gram_hashes, mix64, span_hashes, text_buffer, word_spans

SYMBOLS = class_table(b"#*$%&|<>")
WINDOW = 5
_BLANK = b" \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Bands:
    """(bytes at least, lowest ratio, highest ratio) by length; limits for chunks; the share of chunks that may lie
    outside."""

    whole: tuple[tuple[int, float, float], ...] = ((1, 0.60, 14.0), (24, 0.60, 1.60), (64, 0.45, 1.30), (256, 0.34, 0.95), (1024, 0.27, 0.80), (4096, 0.24, 0.70), (32768, 0.20, 0.65))
    chunk_bytes: int = 4096
    chunk: tuple[float, float] = (0.22, 0.75)
    chunk_share: float = 0.25
    level: int = 3


def repeated_words(words: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """For each row its words in windows that occur at least twice in the row."""
    grams, first = gram_hashes(words, rows, WINDOW)
    if not len(grams):
        return np.zeros(n_rows, np.int64)
    keys = grams ^ mix64(rows[first].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    step = np.zeros(len(words) + WINDOW + 1, np.int32)
    np.add.at(step, first[twice], 1)
    np.add.at(step, first[twice] + WINDOW, -1)
    inside = np.cumsum(step)[: len(words)] > 0
    return np.bincount(rows[inside], minlength=n_rows)


def band_verdict(raw: bytes, compress, bands: Bands) -> tuple[float | None, float, bool]:
    """(ratio of the whole, share of chunks outside their band, kept)."""
    n = len(raw)
    limits = [b for b in bands.whole if n >= b[0]]
    if not limits:
        return None, 0.0, True
    ratio = len(compress(raw)) / n
    _, low, high = limits[-1]
    size, (least, most) = bands.chunk_bytes, bands.chunk
    parts = [raw[i : i + size] for i in range(0, n - size + 1, size)]
    if parts and n % size:
        parts.append(raw[-size:])
    outside = sum(not least <= len(compress(p)) / len(p) <= most for p in parts)
    share = outside / len(parts) if parts else 0.0
    return ratio, share, low <= ratio <= high and share <= bands.chunk_share


def judge(documents: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ratio, chunks_outside."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=bands.level).compress
        for batch in batches:
            for part in chunks(batch, "text"):
                data, offsets = text_buffer(part.column("text"))
                n = part.num_rows
                solid = ~SPACE[data]
                starts, ends, rows = word_spans(solid, offsets)
                n_words = np.bincount(rows, minlength=n)
                repeat = repeated_words(span_hashes(data, starts, ends), rows, n)
                chars = byte_counts(solid & ((data & 0xC0) != 0x80), offsets)
                symbols = byte_counts(SYMBOLS[data], offsets)
                failed = (n_words < 10) | (100 * repeat > 20 * n_words)
                text = data.tobytes()
                dup, ratios, shares, kept = np.zeros(n, np.int64), [], [], np.zeros(n, bool)
                for i in range(n):
                    raw = text[offsets[i] : offsets[i + 1]]
                    lines = [x for x in raw.split(b"\n") if x.strip(_BLANK)]
                    dup[i] = len(lines) - len(set(lines))
                    ratio, share, good = band_verdict(raw, compress, bands)
                    ratios.append(ratio)
                    shares.append(share)
                    kept[i] = good and not failed[i]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(chars), pa.array(symbols), pa.array(dup), pa.array(repeat, pa.int64()), pa.array(failed), pa.array(kept), pa.array(ratios, pa.float64()), pa.array(shares, pa.float64())],
                    ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "chunks_outside"],
                )

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(judged, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, chunks_outside double")

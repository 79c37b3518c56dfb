"""Benchmark decontamination by winnowing.

Of every SPAN - GRAM + 1 consecutive hashes of GRAM-word runs the smallest is a fingerprint. Two texts that share
SPAN words share such a window, hence a fingerprint, so every shared span of SPAN words is found. Fingerprints of the
documents are looked up among those of the benchmark; the windows around a hit are then compared word by word, and
words of true occurrences are marked. Items shorter than SPAN words are one window each, found by the hash of their
own length and compared in the same way.

The benchmark travels to the workers in blocks of at most BLOCK_BYTES of text, each a broadcast of bounded size; a
larger benchmark takes several passes over the documents, whose marks are merged by document.

Defined cases: null texts have no words; items without words or with a null item_id have no windows; repeated items
count once by item_id; a document row is judged by itself, so repeated rows get equal results; rows with a null doc_id
are kept; empty tables give no rows (documents) or no hits (benchmark); further columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import chunks, gram_hashes, lower_ascii, span_hashes, text_buffer, word_spans

SPAN = 10
GRAM = 5
#: Benchmark text in one broadcast.
BLOCK_BYTES = 4 << 20

#: Bytes of words once A-Z are lower-cased: 0-9, a-z and all beyond ASCII.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low = lower_ascii(data)
    starts, ends, rows = word_spans(WORD[low], offsets)
    return low, starts, ends, rows, span_hashes(low, starts, ends)


def _window_minima(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every window of SPAN words in one row the smallest hash of its GRAM-word runs, and the first word."""
    n = len(words) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams, first = gram_hashes(words, rows, GRAM)
    full = np.full(len(words), np.iinfo(np.uint64).max, np.uint64)
    full[first] = grams
    width = SPAN - GRAM + 1
    low = full[:n].copy()
    for j in range(1, width):
        np.minimum(low, full[j : j + n], out=low)
    inside = np.flatnonzero(rows[:n] == rows[SPAN - 1 :])
    return low[inside], inside


class HashSet:
    """Membership of 64-bit hashes: a bit table first, then a sorted array."""

    def __init__(self, values: np.ndarray) -> None:
        self.sorted = np.unique(values)
        bits = min(23, max(12, int(len(self.sorted)).bit_length() + 4))
        self.mask = np.uint64((1 << bits) - 1)
        self.table = np.zeros(1 << bits, bool)
        self.table[(self.sorted & self.mask).astype(np.int64)] = True

    def __contains__(self, value: int) -> bool:
        return bool(self.hits(np.array([value], np.uint64))[0])

    def hits(self, values: np.ndarray) -> np.ndarray:
        out = self.table[(values & self.mask).astype(np.int64)] if len(self.sorted) else np.zeros(len(values), bool)
        at = np.flatnonzero(out)
        if len(at):
            k = np.minimum(np.searchsorted(self.sorted, values[at]), len(self.sorted) - 1)
            out[at] = self.sorted[k] == values[at]
        return out


@dataclass
class Block:
    """Part of the benchmark: its normalised words in one buffer, and its windows by length and hash."""

    ids: list[str]
    text: bytes
    starts: np.ndarray
    ends: np.ndarray
    fingerprints: HashSet
    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    def content(self, word: int, length: int) -> bytes:
        return self.text[self.starts[word] : self.ends[word + length - 1]]


def build_block(items: list[tuple[str, str]]) -> Block:
    """A block of (item_id, text); ids may repeat."""
    raw = [t.encode() for _, t in items]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    low, starts, ends, rows, hashes = _words(data, offsets)
    count = np.bincount(rows, minlength=len(items)) if len(rows) else np.zeros(len(items), int)
    text = low.tobytes()
    joined = b" ".join(text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size + 1)])[:-1].astype(np.int64) if len(size) else np.zeros(0, np.int64)
    windows = {}
    for length in sorted({min(SPAN, int(c)) for c in count if c}):
        h, first = gram_hashes(hashes, rows, length)
        ok = np.ones(len(first), bool) if length == SPAN else count[rows[first]] == length
        h, first = h[ok], first[ok]
        order = np.argsort(h, kind="stable")
        windows[length] = (h[order], first[order], rows[first[order]])
    return Block([i for i, _ in items], joined, at, at + size, HashSet(_window_minima(hashes, rows)[0]), windows)


def find(block: Block, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]], dict[int, set[str]]]:
    """(words by row, row of each word, hit windows as (first word, length), item ids by row)."""
    low, starts, ends, rows, hashes = _words(data, offsets)
    n = len(offsets) - 1
    n_words = np.bincount(rows, minlength=n)
    spans: list[tuple[int, int]] = []
    items: dict[int, set[str]] = {}
    text: bytes | None = None
    for length, (known, first, of) in block.windows.items():
        if length == SPAN:
            minima, at = _window_minima(hashes, rows)
            if not len(at):
                continue
            new = np.ones(len(minima), bool)
            new[1:] = minima[1:] != minima[:-1]  # equal neighbours are one fingerprint
            hit = block.fingerprints.hits(minima[new])[np.cumsum(new) - 1]
            at = at[hit]
            if not len(at):
                continue
            h, where = gram_hashes(hashes, rows, SPAN)
            h = h[np.searchsorted(where, at)]
        else:
            h, at = gram_hashes(hashes, rows, length)
        lo = np.searchsorted(known, h, side="left")
        hi = np.searchsorted(known, h, side="right")
        for i in np.flatnonzero(hi > lo).tolist():
            w = int(at[i])
            text = low.tobytes() if text is None else text
            content = b" ".join(text[a:b] for a, b in zip(starts[w : w + length].tolist(), ends[w : w + length].tolist(), strict=True))
            same = [j for j in range(lo[i], hi[i]) if block.content(int(first[j]), length) == content]
            if same:
                spans.append((w, length))
                items.setdefault(int(rows[w]), set()).update(block.ids[of[j]] for j in same)
    return n_words, rows, spans, items


def _marked(n_words: int, spans: list[tuple[int, int]]) -> np.ndarray:
    step = np.zeros(n_words + 1, np.int64)
    for first, length in spans:
        step[first] += 1
        step[first + length] -= 1
    return np.cumsum(step)[:n_words] > 0


def _digest(ids: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


_RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_NAMES = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def _result(doc_id: pa.Array, n_words: np.ndarray, n_hit: np.ndarray, items: list[set[str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([doc_id, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array([_digest(x) for x in items]), pa.array(n_hit > 0)], _NAMES)


def _one_pass(documents: DataFrame, block: Block) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(block)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                n_words, rows, spans, items = find(shared.value, *text_buffer(part.column("text")))
                hit = np.bincount(rows[_marked(len(rows), spans)], minlength=part.num_rows)
                yield _result(part.column("doc_id"), n_words, hit, [items.get(i, set()) for i in range(part.num_rows)])

    return documents.select("doc_id", "text").mapInArrow(judged, f"doc_id {dict(documents.dtypes)['doc_id']}, {_RESULT}")


def _many_passes(documents: DataFrame, blocks: Iterator[Block]) -> DataFrame:
    """Marks of each block by (doc_id, hash of the text): rows that agree in both have equal results."""
    kind = dict(documents.dtypes)["doc_id"]
    sc = documents.sparkSession.sparkContext
    rows = documents.select("doc_id", F.xxhash64("text").alias("h"), "text")

    def marks(block: Block, number: int) -> DataFrame:
        shared = sc.broadcast(block)

        def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch, "text"):
                    n_words, of, spans, items = find(shared.value, *text_buffer(part.column("text")))
                    first = np.concatenate([[0], np.cumsum(n_words)])
                    by: dict[int, list[int]] = {}
                    for w, length in spans:
                        by.setdefault(int(of[w]), []).extend((w - int(first[of[w]]), length))
                    n = part.num_rows
                    take = list(range(n)) if number == 0 else sorted(by)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(pa.array(take)), part.column("h").take(pa.array(take)), pa.array(n_words[take], pa.int64()), pa.array([by.get(i, []) for i in take], pa.list_(pa.int32())), pa.array([sorted(items.get(i, ())) for i in take], pa.list_(pa.string()))],
                        ["doc_id", "h", "n_words", "spans", "items"],
                    )

        return rows.mapInArrow(marked, f"doc_id {kind}, h long, n_words long, spans array<int>, items array<string>")

    parts = [marks(b, i) for i, b in enumerate(blocks)]
    every = parts[0]
    later = parts[1]
    for p in parts[2:]:
        later = later.unionAll(p)
    # one row of marks for each document that later blocks hit: at most its words times the blocks
    more = later.distinct().groupBy("doc_id", "h").agg(F.flatten(F.collect_list("spans")).alias("s"), F.flatten(F.collect_list("items")).alias("i"))
    m = more.select(F.col("doc_id").alias("d2"), F.col("h").alias("h2"), "s", "i")
    joined = every.join(m, every["doc_id"].eqNullSafe(m["d2"]) & (every["h"] == m["h2"]), "left").select(
        "doc_id", "n_words", F.concat("spans", F.coalesce("s", F.array().cast("array<int>"))).alias("spans"), F.concat("items", F.coalesce("i", F.array().cast("array<string>"))).alias("items")
    )

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words = b.column("n_words").to_numpy()
            spans, items = b.column("spans").to_pylist(), b.column("items").to_pylist()
            hit = np.array([_marked(int(n), list(zip(s[::2], s[1::2], strict=True))).sum() for n, s in zip(n_words, spans, strict=True)], np.int64)
            yield _result(b.column("doc_id"), n_words, hit, [set(x) for x in items])

    return joined.mapInArrow(merged, f"doc_id {kind}, {_RESULT}")


def decontaminate(documents: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), "text").where("i is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1

    def blocks() -> Iterator[Block]:
        for b in range(n):
            got = items if n == 1 else items.where(F.pmod(F.xxhash64("i"), F.lit(n)) == b)
            yield build_block(sorted((r[0], r[1]) for r in got.collect()))

    return _one_pass(documents, next(blocks())) if n == 1 else _many_passes(documents, blocks())

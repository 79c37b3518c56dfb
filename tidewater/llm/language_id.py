"""Language identification by prediction by partial matching.

For every language a byte context tree of orders 0 to ORDER is counted on a bounded sample. The statistics are then
frozen, and each byte of a text costs -log2 of its probability in the longest context that was seen: a seen symbol
has c / (T + q), an unseen one pays the escape q / (T + q) and goes to the next shorter context, at the end to 1/256
(T: symbols counted in the context, q: distinct ones). The language with the shortest exact code length wins.

All languages share one set of k-gram numbers, found by dense transitions: the number of the k-gram ending at a byte
follows from that of the (k-1)-gram ending one byte earlier. What a k-gram costs in each language, escapes included,
is computed once at fitting, so scoring is table lookups over whole Arrow batches.

Defined cases: a null text, an empty one or one without a letter is `und` with score 0; without training rows all
texts are `und`; texts start in the context of ORDER line feeds; further columns are ignored; repeated rows are
scored each on its own."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import chunks, text_buffer
from .quality_classifier import held_out

#: Longest context, in bytes.
ORDER = 4
#: At most so many documents of a language are learned from, none longer than so many bytes.
MAX_TRAIN_DOCS = 300
MAX_TRAIN_DOC_BYTES = 1 << 16
UNKNOWN = "und"


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows with ORDER line feeds before each, and the row that each byte belongs to (-1 for padding)."""
    lengths = np.diff(offsets)
    n = len(lengths)
    rows = np.repeat(np.arange(n), lengths + ORDER)
    out = np.full(len(rows), 10, np.uint8)
    real = np.ones(len(rows), bool)
    starts = offsets[:-1] + ORDER * np.arange(n)
    real[(starts[:, None] + np.arange(ORDER)).ravel()] = False
    out[real] = data
    rows[~real] = -1
    return out, rows


@dataclass
class ContextTrees:
    """Frozen statistics. next[k]: transitions to k-gram numbers; cost[k]: bits of a k-gram's last symbol, escapes
    included, by language; escape[k]: bits of leaving a k-gram as a context, 0 where it wasn't seen."""

    languages: list[str]
    symbol: np.ndarray
    width: int
    next: list[np.ndarray]
    cost: list[np.ndarray]
    escape: list[np.ndarray]

    def grams(self, buffer: np.ndarray) -> list[np.ndarray]:
        """For k = 1 to ORDER + 1 the number of the k-gram ending at each byte; 0: not seen."""
        s = self.symbol[buffer]
        ids = [s.astype(np.int32)]
        for k in range(2, ORDER + 2):
            before = np.zeros(len(s), np.int32)
            before[1:] = ids[-1][:-1]
            ids.append(self.next[k][before.astype(np.int64) * self.width + s])
        return ids

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each row under each language."""
        n = len(offsets) - 1
        out = np.zeros((n, len(self.languages)))
        if n == 0 or not len(data):
            return out
        buffer, rows = padded(data, offsets)
        ids = self.grams(buffer)
        at = np.flatnonzero(rows >= 0)
        total = np.zeros((len(at), len(self.languages)), np.float32)
        sel = np.arange(len(at))
        for k in range(ORDER + 1, 0, -1):
            g = ids[k - 1][at[sel]]
            hit = (g > 0) | (k == 1)
            total[sel[hit]] += self.cost[k][g[hit]]
            sel = sel[~hit]
            if not len(sel):
                break
            total[sel] += self.escape[k - 1][ids[k - 2][at[sel] - 1]]
        lengths = np.diff(offsets)
        full = np.flatnonzero(lengths)
        out[full] = np.add.reduceat(total, offsets[:-1][full], axis=0, dtype=np.float64)
        return out


def count_trees(samples: dict[str, list[bytes]]) -> ContextTrees:
    """Context trees from texts by language."""
    languages = sorted(samples)
    texts = [(i, t) for i, lang in enumerate(languages) for t in samples[lang] if t]
    if not texts:
        return ContextTrees([], np.zeros(256, np.int64), 1, [], [], [])
    data = np.frombuffer(b"".join(t for _, t in texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for _, t in texts])])
    buffer, rows = padded(data, offsets)
    of = np.array([i for i, _ in texts])
    real = np.flatnonzero(rows >= 0)
    lang = of[rows[real]]
    n_lang = len(languages)
    seen = np.unique(np.concatenate([buffer, [10]]))
    symbol = np.zeros(256, np.int64)
    symbol[seen] = np.arange(1, len(seen) + 1)
    width = len(seen) + 1
    s = symbol[buffer].astype(np.int32)

    def by_language(ids: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(ids[real].astype(np.int64) * n_lang + lang, minlength=n * n_lang).reshape(n, n_lang).astype(np.float64)

    ids, sizes, nexts = [s], [width], [np.zeros(0, np.int32), np.zeros(0, np.int32)]
    first = [None]
    for _ in range(2, ORDER + 2):
        keys = s.astype(np.int64)
        keys[1:] += ids[-1][:-1].astype(np.int64) * width
        # every k-gram that ends at a real byte, and those inside the padding, which are contexts of first bytes
        got, where, inverse = np.unique(keys, return_index=True, return_inverse=True)
        table = np.zeros(sizes[-1] * width, np.int32)
        table[got] = np.arange(1, len(got) + 1)
        table[:width] = 0  # nothing follows what wasn't seen; only the buffer's first byte is counted there
        nexts.append(table)
        ids.append(inverse.astype(np.int32) + 1)
        del keys, inverse
        sizes.append(len(got) + 1)
        first.append(where)
    cost, escape = [np.zeros((1, n_lang), np.float32)], []
    counts = [by_language(i, n) for i, n in zip(ids, sizes, strict=True)]
    # order 0
    total, distinct = counts[0].sum(0), (counts[0] > 0).sum(0)
    with np.errstate(divide="ignore", invalid="ignore"):
        away = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
        c = np.where(counts[0] > 0, -np.log2(counts[0] / (total + distinct)), away + 8.0)
    cost.append(c)
    escape.append(away[None, :])
    for k in range(2, ORDER + 2):
        where, n = first[k - 1], sizes[k - 1]
        context, suffix = ids[k - 2][np.maximum(where - 1, 0)], ids[k - 2][where]
        mine = counts[k - 1][1:]
        total, distinct = np.zeros((sizes[k - 2], n_lang)), np.zeros((sizes[k - 2], n_lang))
        np.add.at(total, context, mine)
        np.add.at(distinct, context, (mine > 0).astype(float))
        with np.errstate(divide="ignore", invalid="ignore"):
            away = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
            c = np.where(mine > 0, -np.log2(mine / (total + distinct)[context]), away[context] + cost[k - 1][suffix])
        cost.append(np.concatenate([np.zeros((1, n_lang)), c]))
        escape.append(away)
        assert len(c) == n - 1
    return ContextTrees(languages, symbol, width, nexts, [c.astype(np.float32) for c in cost], [e.astype(np.float32) for e in escape])


def sample(documents: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> dict[str, list[bytes]]:
    """At most max_docs texts of each language that aren't held out, by order of a hash of their ids. The counts by
    language are one row each, of the texts that can be chosen. Texts over MAX_TRAIN_DOC_BYTES give their beginning, and only
    where a language has fewer than max_docs others; thinning by the hash keeps the window that takes the first rows small."""
    size = F.octet_length("text")
    rows = documents.select("doc_id", "lang", "text", (size > MAX_TRAIN_DOC_BYTES).alias("_tw_long")).where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (size > 0) & ~held_out(F.col("doc_id")))
    counts: dict[str, list[int]] = {}
    for r in rows.groupBy("lang", "_tw_long").count().collect():
        counts.setdefault(r[0], [0, 0])[r[1]] = r[2]
    if not counts:
        return {}
    shares = {k: (min(1.0, 3.0 * max_docs / max(1, n)), min(1.0, 3.0 * max_docs / max(1, m)) if n < max_docs else 0.0) for k, (n, m) in counts.items()}
    share = [F.create_map(*[F.lit(x) for k, v in shares.items() for x in (k, v[i])])[F.col("lang")] for i in (0, 1)]
    order = F.xxhash64("doc_id")
    thin = rows.where(F.pmod(order, F.lit(1 << 20)) < F.when(F.col("_tw_long"), share[1]).otherwise(share[0]) * (1 << 20))
    # a character has at most four bytes
    thin = thin.withColumn("text", F.when(F.col("_tw_long"), F.substring("text", 1, MAX_TRAIN_DOC_BYTES // 4)).otherwise(F.col("text")))
    from pyspark.sql import Window

    first = thin.withColumn("_tw_n", F.row_number().over(Window.partitionBy("lang").orderBy("_tw_long", order, "doc_id", "text"))).where(F.col("_tw_n") <= max_docs)
    out: dict[str, list[bytes]] = {}
    for r in first.select("lang", "text").collect():
        out.setdefault(r[0], []).append(r[1].encode())
    return out


def predict(documents: DataFrame, trees: ContextTrees) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(trees)  # its size is bounded by the training sample's

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            for part in chunks(batch, "text"):
                n = part.num_rows
                ok = part.column("_tw_letter").to_numpy(zero_copy_only=False).astype(bool)
                best, score = np.full(n, len(model.languages)), np.zeros(n)
                if model.languages:
                    bits = model.bits(*text_buffer(part.column("text")))
                    low = bits.min(1)
                    best = np.where(ok, bits.argmin(1), len(model.languages))
                    score = np.where(ok, 1.0 / np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(1), 0.0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names[best], pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), letter.alias("_tw_letter"), "text")
    return rows.mapInArrow(label, f"doc_id {dict(documents.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")


def identify(documents: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> DataFrame:
    """Fits on the documents' own language column and predicts for all of them."""
    return predict(documents, count_trees(sample(documents, max_docs)))

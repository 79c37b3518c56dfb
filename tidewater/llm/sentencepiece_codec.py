"""SentencePiece encoding and decoding by a shared-prefix forward pass.

A text is cut into marked words (a run of word marks and what follows it), which no piece crosses. The distinct words
of a chunk are sorted, which is a depth-first traversal of their trie: the forward states of the common prefix with the
word before stay on the stack and only the rest of the word is computed.

For a unigram model the forward state is Viterbi's: best score and last piece of each prefix. A byte-pair model has no
additive score whose best path is its result. There the state of a prefix is the last piece of its encoding: it is the
one piece ending there that is a lawful neighbour of the last piece before it, where two pieces are lawful neighbours
if merging their joined text gives back the two. Both give the library's ids. Words with runs of marks, whose merges
tie, are merged step by step.

Defined cases: a null text counts as empty and has no ids; the mark itself in a text is a space, so it decodes to one;
characters without a piece become byte pieces (or the unknown piece); equal rows get equal ids; an empty table gives no
rows; further columns are ignored. Control pieces never come from text. Unbroken words and runs of spaces may be of any
length: memory is linear in them, time nearly so."""

from __future__ import annotations

import hashlib
import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrowtext import chunks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Distinct words that a worker remembers; beyond that it starts afresh.
CACHE_WORDS = 250_000
#: Characters of a word beyond which it is encoded by itself, and not remembered.
LONG_WORD = 256
_UNKNOWN_PENALTY = 10.0
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6


class PieceModel:
    """The pieces of a SentencePiece model file and the encoder over them."""

    def __init__(self, raw: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(raw)
        norm = m.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with identity normalisation and marks before words")
        if m.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and byte-pair models")
        self.unigram = m.trainer_spec.model_type == 1
        self.prefix = norm.add_dummy_prefix
        kinds = [p.type for p in m.pieces]
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type in (_NORMAL, _USER)}
        self.score = {p.piece: p.score for p in m.pieces if p.type in (_NORMAL, _USER)}
        self.unknown = next((i for i, k in enumerate(kinds) if k == _UNKNOWN), 0)
        self.bytes = {int(p.piece[3:-1], 16): i for i, p in enumerate(m.pieces) if p.type == _BYTE}
        self.longest = max(map(len, self.ids), default=1)
        self.worst = min(self.score.values(), default=0.0) - _UNKNOWN_PENALTY
        self.width = np.dtype("<u2") if len(m.pieces) <= 1 << 16 else np.dtype("<u4")
        self.table = [b"" if k == _CONTROL else b" \xe2\x81\x87 " if k == _UNKNOWN else bytes([int(p.piece[3:-1], 16)]) if k == _BYTE else p.piece.replace(MARK, " ").encode() for p, k in zip(m.pieces, kinds, strict=True)]
        crossing = [p for p in self.ids if MARK in p.lstrip(MARK)]
        if crossing:
            raise ValueError("pieces that cross words")
        self.cut_lines = not any("\n" in p for p in self.ids)
        self._pairs: dict[str, dict[str, bool]] = {}
        self._n_pairs = 0
        # pieces that merging their own text gives back, with their packed ids, and their lengths by last characters
        self._whole: dict[str, bytes] = {}
        self._single: dict[str, bytes] = {}
        self._tails: dict[str, tuple[int, ...]] = {}
        self._ends: dict[str, tuple[int, ...]] = {}
        if not self.unigram:
            ends: dict[str, set[int]] = {}
            order = sorted((p for p in self.ids if len(p) > 1), key=lambda p: -self.score[p])
            self._rank = {p: i for i, p in enumerate(order)}
            self._parts: dict[str, tuple[str, str]] = {}
            for p in self.ids:
                before = self.merged(p, 2)
                if len(before) == 1 or len(self.merged(p)) == 1:
                    self._whole[p] = self._packed([p])
                    if len(p) > 1:
                        self._parts[p] = (before[0], before[1])
                    if len(p) > 2:
                        ends.setdefault(p[-3:], set()).add(len(p))
            self._ends = {k: tuple(sorted(v, reverse=True)) for k, v in ends.items()}
        self._known: dict[str, bytes] = {"": b""}
        self._words = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if self.cut_lines else f"{MARK}*[^{MARK}]+|{MARK}+")

    # -- words --------------------------------------------------------------------------------------------------

    def units(self, text: str) -> list[str]:
        """The marked words of a text; empty strings may stand between them."""
        if not text:
            return []
        if MARK in text:
            text = text.replace(MARK, " ")
        lead = MARK if self.prefix else ""
        if "  " in text or text[0] == " ":
            return self._words.findall((lead + text).replace(" ", MARK))
        text = (lead + text).replace(" ", " " + MARK)
        return (text.replace("\n", " \n ") if self.cut_lines else text).split(" ")

    def merged(self, text: str, stop: int = 1) -> list[str]:
        """Byte-pair merging step by step, until `stop` pieces are left: always the best piece, the leftmost of equals."""
        score, n = self.score, len(text)
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[float, int, int]] = []

        def offer(i: int) -> None:
            """The merge of the part that begins at i with the next one, known by where that ends."""
            if after[i] < n and end[after[i]] - i <= self.longest:
                s = score.get(text[i : end[after[i]]])
                if s is not None:
                    heappush(agenda, (-s, i, end[after[i]]))

        for i in range(n - 1):
            offer(i)
        left = n
        while agenda and left > stop:
            _, i, to = heappop(agenda)
            # a part that was merged into another has no end; one that grew ends elsewhere
            if end[i] and after[i] < n and end[after[i]] == to:
                j = after[i]
                end[i], end[j], after[i] = to, 0, after[j]
                if after[i] < n:
                    before[after[i]] = i
                left -= 1
                offer(i)
                if before[i] >= 0:
                    offer(before[i])
        return [text[i:e] for i, e in enumerate(end) if e]

    def lawful(self, a: str, b: str) -> bool:
        """Whether merging the joined text of two whole pieces gives back the two: undoes their last merges, latest
        first, and looks whether the pieces that then meet would have been merged earlier."""
        rank, parts = self._rank, self._parts
        ra, rb, limit = rank.get(a, -1), rank.get(b, -1), 1 << 60
        while True:
            if rank.get(a + b, limit) < limit:
                return False
            if ra > rb:
                if len(a) == 1:
                    return True
                limit, a = ra, parts[a][1]
                ra = rank[a] if len(a) > 1 else -1
            elif len(b) == 1:
                return True
            else:
                # of equal merges the left one comes first
                limit, b = rb + 1, parts[b][0]
                rb = rank[b] if len(b) > 1 else -1

    def _neighbours(self, a: str, b: str) -> bool:
        if self._n_pairs > 1 << 18:
            self._pairs.clear()
            self._n_pairs = 0
        self._n_pairs += 1
        self._pairs.setdefault(b, {})[a] = known = self.lawful(a, b)
        return known

    def _spell(self, pieces: Iterable[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[x] for x in p.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """The packed ids of distinct words, in sorted order."""
        if not self.unigram:
            return self._chain(sorted(words))
        return ((w, self._packed(p)) for w, p in self._viterbi(sorted(words)))

    def _packed(self, pieces: Iterable[str]) -> bytes:
        return array("H" if self.width.itemsize == 2 else "I", self._spell(pieces)).tobytes()

    def _viterbi(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """Unigram: best[i] is the score of the best pieces of the first i characters, take[i] the length of the last."""
        last, best, take = "", [0.0], [0]
        score, longest = self.score, self.longest
        for word in words:
            k = _shared(last, word)
            del take[k + 1 :], best[k + 1 :]
            for end in range(k + 1, len(word) + 1):
                top, length = best[end - 1] + self.worst, 1
                for n in range(1, min(longest, end) + 1):
                    s = score.get(word[end - n : end])
                    if s is not None and (n == 1 or best[end - n] + s > top):
                        top, length = best[end - n] + s, n
                best.append(top)
                take.append(length)
            last = word
            pieces, end = [], len(word)
            while end:
                pieces.append(word[end - take[end] : end])
                end -= take[end]
            yield word, pieces[::-1]

    def _lengths(self, tail: str) -> tuple[int, ...]:
        """Lengths, longest first, that a piece ending in these (at most three) characters may have."""
        found = self._ends.get(tail, ())
        if len(tail) > 1 and tail[-2:] in self._whole:
            found = (*found, 2)
        if len(self._tails) > 1 << 17:
            self._tails.clear()
        self._tails[tail] = found = (*found, 1)
        return found

    def _chain(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Byte pairs: piece[i] is the last piece of the encoding of the first i characters, code[i] its packed ids."""
        last, piece, code = "", [""], [b""]
        whole, tails, pairs, neighbours, single = self._whole, self._tails, self._pairs, self._neighbours, self._single
        none: dict[str, bool] = {}
        runs = MARK * 2
        for word in words:
            if runs in word:
                yield word, self._packed(self.merged(word))
                continue
            if len(word) > LONG_WORD:
                yield word, self._long(word)
                continue
            k = _shared(last, word)
            del piece[k + 1 :], code[k + 1 :]
            for end in range(k + 1, len(word) + 1):
                # most often the last piece grows
                p = piece[-1] + word[end - 1]
                packed = whole.get(p)
                if packed is not None:
                    start = end - len(p)
                    if not start or pairs.get(p, none).get(piece[start]):
                        piece.append(p)
                        code.append(code[start] + packed)
                        continue
                tail = word[end - 3 : end] if end > 2 else word[:end]
                for n in tails.get(tail) or self._lengths(tail):
                    start = end - n
                    if start < 0:
                        continue
                    p = word[start:end]
                    if n > 1 and p not in whole:
                        continue
                    if not start:
                        break
                    before = piece[start]
                    lawful = pairs.get(p, none).get(before)
                    if lawful or (lawful is None and neighbours(before, p)):
                        break
                piece.append(p)
                code.append(code[start] + (whole.get(p) or single.get(p) or self._first(p)))
            last = word
            yield word, code[-1]

    def _long(self, word: str) -> bytes:
        """As _chain for one word, with the last piece's length for a state; the ids are spelled at the end."""
        whole, pairs, tails, none = self._whole, self._pairs, self._tails, {}
        length = array("H", [0])
        for end in range(1, len(word) + 1):
            tail = word[max(end - 3, 0) : end]
            for n in (length[-1] + 1, *(tails.get(tail) or self._lengths(tail))):
                start = end - n
                if start < 0:
                    continue
                p = word[start:end]
                if n > 1 and p not in whole:
                    continue
                if not start:
                    break
                last = word[start - length[start] : start]
                lawful = pairs.get(p, none).get(last)
                if lawful or (lawful is None and self._neighbours(last, p)):
                    break
            length.append(n)
        pieces, end = [], len(word)
        while end:
            pieces.append(word[end - length[end] : end])
            end -= length[end]
        return self._packed(reversed(pieces))

    def _first(self, char: str) -> bytes:
        """The packed ids of a character by itself."""
        if len(self._single) > 1 << 16:
            self._single.clear()
        self._single[char] = packed = self._packed([char])
        return packed

    # -- texts --------------------------------------------------------------------------------------------------

    def encode_texts(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian integers of this model's width."""
        cut = [self.units(t or "") for t in texts]
        fresh = set().union(*cut) if cut else set()
        known = self._known
        fresh.difference_update(known)
        if len(known) + len(fresh) > CACHE_WORDS:
            known.clear()
            known[""] = b""
            fresh = set().union(*cut) - {""}
        known.update(self.encode_words(fresh))
        get = known.__getitem__
        out = [b"".join(map(get, u)) for u in cut]
        for word in fresh:
            if len(word) > LONG_WORD:  # not worth their memory
                del known[word]
        return out

    def decode_ids(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that are not UTF-8 become replacement characters."""
        text = b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


assert sys.byteorder == "little"


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    k = 0
    while a[k] == b[k]:
        k += 1
    return k


_loaded: dict[bytes, PieceModel] = {}


def loaded(raw: bytes) -> PieceModel:
    """The model of these file bytes, one for each worker."""
    key = hashlib.sha256(raw).digest()
    if key not in _loaded:
        _loaded[key] = PieceModel(raw)
    return _loaded[key]


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(documents: DataFrame, model: str = MODEL, with_ids: bool = True, check: bool = False) -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (of the ids, comma-joined decimals), with_ids: ids (array of int), and with check
    whether decoding the ids gives the text back (its marks as spaces)."""
    raw = documents.sparkSession.sparkContext.broadcast(read_model(model))  # a file of fixed size

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = loaded(raw.value)
        names = [str(i) for i in range(len(m.table))]
        for batch in batches:
            for part in chunks(batch, "text", 2 << 20):
                texts = part.column("text").to_pylist()
                ids = [np.frombuffer(b, m.width) for b in m.encode_texts(texts)]
                cols, labels = [part.column("doc_id"), pa.array([len(x) for x in ids], pa.int64())], ["doc_id", "n_pieces"]
                lists = [x.tolist() for x in ids]
                cols.append(pa.array([hashlib.sha256(",".join(map(names.__getitem__, x)).encode()).hexdigest() for x in lists]))
                labels.append("ids_sha256")
                if with_ids:
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                    flat = np.concatenate([*ids, np.zeros(0, m.width)]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
                    labels.append("ids")
                if check:
                    cols.append(pa.array([m.decode_ids(x) == (t or "").replace(MARK, " ") for x, t in zip(lists, texts, strict=True)]))
                    labels.append("round_trip")
                yield pa.RecordBatch.from_arrays(cols, labels)

    kind = dict(documents.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_pieces long, ids_sha256 string" + ", ids array<int>" * with_ids + ", round_trip boolean" * check
    return documents.select("doc_id", "text").mapInArrow(encoded, schema)


def decode(sequences: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text of (doc_id, ids); null ids give an empty text."""
    raw = sequences.sparkSession.sparkContext.broadcast(read_model(model))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = loaded(raw.value)
        for batch in batches:
            text = [m.decode_ids(x or ()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    return sequences.select("doc_id", "ids").mapInArrow(decoded, f"doc_id {dict(sequences.dtypes)['doc_id']}, text string")

import hashlib
import random

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from tidewater.llm import sentencepiece_codec as C

ALPHABET = ["the", "ing", "tion", "a", "b", "É", "ñ", "😀", "日本", "\n", " ", "  ", "\t", ".", "1", "2024", "▁", "Zx", "'s", "queue", "é", "\x00"]


def texts(n=400):
    rng = random.Random(11)
    fixed = [None, "", " ", "  ", "\n", "\n\n a", "a", " a", "a ", "a  b   c    d", "▁", "▁▁x", "hello world", "the " * 40, "x" * 300, "naïve café — “quoted”", " lead", "trail  "]
    return fixed + ["".join(rng.choices(ALPHABET, k=rng.randint(1, 40))) for _ in range(n)]


def ids_of(model, batch):
    import numpy as np

    return [np.frombuffer(b, model.width).tolist() for b in model.encode_texts(batch)]


def test_same_ids_as_the_library():
    sp = sentencepiece.SentencePieceProcessor(model_file=C.MODEL)
    model = C.PieceModel(C.read_model())
    batch = texts()
    got = ids_of(model, batch)
    for t, ids in zip(batch, got, strict=True):
        assert ids == sp.encode(t or ""), repr(t)
        assert model.decode_ids(ids) == (t or "").replace("▁", " ")


def unigram(byte_fallback):
    m = pb.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = 1, byte_fallback
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = "identity", True, False, True
    for p, k in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        m.pieces.add(piece=p, score=0, type=k)
    for b in range(256 if byte_fallback else 0):
        m.pieces.add(piece=f"<0x{b:02X}>", score=0, type=6)
    rng = random.Random(2)
    pieces = {"▁", "a", "b", "t", "h", "e", "i", "n", "g", "▁the", "▁a", "the", "ing", "in", "tion", "▁th", "th", "he", "▁▁", "1", "20", "24", "que", "ue", "ñ"}
    for p in sorted(pieces):
        m.pieces.add(piece=p, score=-rng.uniform(1, 9) * (1 + 0.2 / len(p)), type=1)
    return m.SerializeToString()


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_unigram_model_is_viterbi(byte_fallback):
    raw = unigram(byte_fallback)
    sp, model = sentencepiece.SentencePieceProcessor(model_proto=raw), C.PieceModel(raw)
    batch = [t for t in texts(200) if t]
    if not byte_fallback:  # unknown pieces of neighbouring words are joined by the library, kept apart here
        batch = [t for t in batch if len(t.split()) == 1 and not t[0].isspace() and "\n" not in t and "\t" not in t]
    for t, ids in zip(batch, ids_of(model, batch), strict=True):
        assert ids == sp.encode(t), repr(t)


def test_cache_starts_afresh(monkeypatch):
    sp = sentencepiece.SentencePieceProcessor(model_file=C.MODEL)
    model = C.PieceModel(C.read_model())
    monkeypatch.setattr(C, "CACHE_WORDS", 5)
    for t in texts(30):
        assert ids_of(model, [t])[0] == sp.encode(t or "")


def test_frames(spark):
    rows = [(i, t, 7) for i, t in enumerate(texts(60))]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(3)
    sp = sentencepiece.SentencePieceProcessor(model_file=C.MODEL)
    out = C.encode(df, check=True)
    for r in out.collect():
        want = sp.encode(rows[r.doc_id][1] or "")
        assert (r.ids, r.n_pieces, r.round_trip) == (want, len(want), True)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
    back = {r.doc_id: r.text for r in C.decode(out).collect()}
    assert back == {i: (t or "").replace("▁", " ") for i, t, _ in rows}
    assert C.encode(df.limit(0)).count() == 0


def test_lawful_neighbours_are_what_merging_leaves():
    model = C.PieceModel(C.read_model())
    rng = random.Random(5)
    pieces = [p for p in model._whole if "▁▁" not in p]
    chars = [p for p in pieces if len(p) == 1]
    seen = [0, 0]
    for _ in range(6000):
        a, b = rng.choice(pieces), rng.choice(chars if rng.random() < 0.2 else pieces)
        if rng.random() < 0.5:  # neighbours that share a word of the vocabulary
            w = rng.choice(pieces)
            k = rng.randint(1, len(w))
            a, b = w[:k], (w[k:] + b)[:6]
        if a in model._whole and b in model._whole and "▁" not in b:
            want = model.merged(a + b) == [a, b]
            seen[want] += 1
            assert model.lawful(a, b) == want, (a, b)
    assert min(seen) > 100


def test_very_long_words():
    """Linear memory and near-linear time, and the library's ids, for unbroken words and runs of any length."""
    import resource

    sp = sentencepiece.SentencePieceProcessor(model_file=C.MODEL)
    model = C.PieceModel(C.read_model())
    rng = random.Random(12)
    letters = "etaoinshrdlucmfwypvbgkjqxz"
    word = "".join(rng.choices(letters, weights=range(26, 0, -1), k=100_000))
    batch = [" " * 100_000, "  " + word, "x" * 50_000, "日本語の長い文章" * 5_000, word[:300], word[:257] + " " + word[:256], "".join(rng.choices(["the", "ing", "日", "é", "▁", "4"], k=20_000))]
    for t, ids in zip(batch, ids_of(model, batch), strict=True):
        assert ids == sp.encode(t), t[:30]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    whole = "".join(rng.choices(letters, weights=range(26, 0, -1), k=1_000_000))
    (got,) = model.encode_texts([whole])
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) < 300_000
    assert all(len(w) <= C.LONG_WORD for w in model._known)
    assert model.decode_ids(__import__("numpy").frombuffer(got, model.width).tolist()) == whole


def test_merging_by_agenda_is_merging_step_by_step():
    model = C.PieceModel(C.read_model())

    def slow(text, stop=1):
        parts = list(text)
        while len(parts) > stop:
            offers = [(model.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in model.score]
            if not offers:
                break
            i = -max(offers)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    rng = random.Random(13)
    for _ in range(300):
        t = "".join(rng.choices(["▁", "▁▁", "a", "the", "in", "g", "aa", "é"], k=rng.randint(1, 14)))
        for stop in (1, 2, 3):
            assert model.merged(t, stop) == slow(t, stop), t

import random
import re

from tidewater.llm.quality_rules import Bands, band_verdict, judge

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), n < 10 or 100 * len(hit) > 20 * n)


def texts():
    rng = random.Random(3)
    words = ["alpha", "béta", "#x", "ça", "|", "long-word", "Ünï", "a", "b"]
    out = [None, "", " \n\t", "a b c d e f g h i", "x" * 9000, "\r\n\x0b one\x0ctwo", "a b c d e a b c d e", "no\xa0break stays one word"]
    for _ in range(40):
        t = " ".join(rng.choices(words, k=rng.randint(1, 60)))
        out += [t, t + "\n" + t, "\n".join(t.split())]
    return out


def test_matches_brute_force(spark):
    rows = [(i, t, 1) for i, t in enumerate(texts())]
    got = {r.doc_id: r for r in judge(spark.createDataFrame(rows, "doc_id long, text string, ratio int")).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), t
        assert not (r.kept and r.base_failed)


def test_bands():
    import zstandard

    compress = zstandard.ZstdCompressor(level=3).compress
    rng = random.Random(1)
    noise = bytes(rng.randrange(256) for _ in range(9000))
    assert band_verdict(b"same words again " * 500, compress, Bands())[2] is False
    assert band_verdict(noise, compress, Bands())[2] is False
    prose = " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(1500)).encode()
    ratio, share, kept = band_verdict(prose, compress, Bands())
    assert kept and share == 0 and 0.3 < ratio < 0.6
    assert band_verdict(prose + b"same " * 4000, compress, Bands())[1] > 0.25
    assert band_verdict(b"", compress, Bands()) == (None, 0.0, True)
    assert band_verdict(b"A short one.", compress, Bands())[1:] == (0.0, True)
    assert band_verdict(b"aa " * 20, compress, Bands())[2] is False


def test_every_byte_is_in_a_chunk():
    """A repetitive tail shows however long it is, and the chunks of a text cover it."""
    import zstandard

    seen = []

    def compress(b):
        seen.append(b)
        return zstandard.ZstdCompressor(level=3).compress(b)

    rng = random.Random(2)
    prose = " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(4000)).encode()
    for n in (1, 63, 4095, 4096, 4097, 6000, 8192, 10_000):
        seen.clear()
        band_verdict(prose[:n], compress, Bands())
        chunks = seen[1:]
        assert all(len(c) == 4096 for c in chunks) and len(chunks) == (-(-n // 4096) if n >= 4096 else 0)
        if chunks:
            assert b"".join(chunks[:-1]) + chunks[-1][(-n) % 4096 :] == prose[:n]
    assert band_verdict(prose[:4096] + b"z" * 2000, zstandard.ZstdCompressor(level=3).compress, Bands())[1] == 0.0
    assert band_verdict(prose[:4096] + b"z" * 4000, zstandard.ZstdCompressor(level=3).compress, Bands())[1] == 0.5


def test_empty_table_and_null_id(spark):
    assert judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert judge(spark.createDataFrame([(None, "a")], "doc_id long, text string")).first().doc_id is None

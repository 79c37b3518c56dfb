import random

import numpy as np

from tidewater.llm import language_id as L


def brute_bits(samples, text):
    """Code length by the definition, from plain dictionaries."""
    counts = {}
    for t in samples:
        b = b"\n" * L.ORDER + t
        for i in range(L.ORDER, len(b)):
            for k in range(L.ORDER + 1):
                counts.setdefault(b[i - k : i], {}).setdefault(b[i], 0)
                counts[b[i - k : i]][b[i]] += 1
    total = 0.0
    b = b"\n" * L.ORDER + text
    for i in range(L.ORDER, len(b)):
        for k in range(L.ORDER, -1, -1):
            c = counts.get(b[i - k : i])
            if c is None:
                continue
            n, q = sum(c.values()), len(c)
            if b[i] in c:
                total -= np.log2(c[b[i]] / (n + q))
                break
            total -= np.log2(q / (n + q))
        else:
            total += 8
    return total


def test_exact_code_lengths():
    rng = random.Random(3)
    say = lambda letters: "".join(rng.choices(letters, k=rng.randint(1, 80))).encode()
    samples = {"x": [say("abc é") for _ in range(8)], "y": [say("acd\n") for _ in range(8)] + [b""]}
    trees = L.count_trees(samples)
    texts = [b"", b"a", "zzz日本".encode(), *(say("abcdé \n") for _ in range(30))]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = trees.bits(data, offsets)
    want = np.array([[brute_bits(samples[k], t) for k in ("x", "y")] for t in texts])
    assert np.allclose(got, want, rtol=1e-4, atol=1e-3)


def test_predicts_and_defined_cases(spark):
    rng = random.Random(4)
    a, b = ["the", "and", "ing", "was"], ["der", "und", "sch", "ich"]
    rows = [(i, " ".join(rng.choices(a if i % 2 else b, k=30)), "en" if i % 2 else "de", 1.0) for i in range(200)]
    extra = [(900, None, "en", 0.0), (901, "", None, 0.0), (902, "123 ...", "de", 0.0), (None, "the and was", "en", 0.0), (903, "ing " * 40000, None, 0.0)]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, score double").repartition(3)
    got = {r.doc_id: r for r in L.identify(df).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, _ in rows)
    assert [got[i].lang_pred for i in (900, 901, 902, None, 903)] == ["und", "und", "und", "en", "en"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in L.identify(df.withColumn("lang", df.lang.cast("string")).where("doc_id >= 901")).collect()} <= {"und", "de", "en"}
    assert L.identify(df.limit(0)).count() == 0

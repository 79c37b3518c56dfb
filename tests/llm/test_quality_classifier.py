import random
import zlib

import numpy as np

from tidewater.llm import quality_classifier as Q


def corpus(n=400):
    rng = random.Random(12)
    words = [f"{a}{b}" for a in ("lo", "mi", "ta", "re", "su") for b in ("na", "ti", "vor", "les", "m")]
    docs, labels = [], []
    for i in range(n):
        w = rng.choices(words, k=rng.randint(5, 120))
        kind = i % 4
        if kind == 0:
            text, y = " ".join(x + rng.choice(["###", "$$$", "&&&"]) for x in w), 0
        elif kind == 1:
            text, y = " ".join([w[0]] * len(w)).upper(), 0
        else:
            text, y = ". ".join(" ".join(w[j : j + 8]).capitalize() for j in range(0, len(w), 8)) + ".", 1
        docs.append((i, text, "en"))
        labels.append((i, y, 0))
    return docs, labels


def test_learns_and_holds_out(spark):
    docs, labels = corpus()
    d = spark.createDataFrame([*docs, (900, None, "x"), (901, "", "x"), (None, "null id", "x"), docs[5]], "doc_id long, text string, score string")
    la = spark.createDataFrame([*labels, (labels[2]), (None, 1, 0), (77, None, 0)], "doc_id long, quality int, toxic int")
    rows = Q.score_documents(d, la).collect()
    assert len(rows) == len(docs) + 4
    truth = {i: y for i, y, _ in labels}
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 40 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95


def test_column_equals_model(spark):
    rng = np.random.default_rng(1)
    x = rng.random((500, len(Q.FEATURES)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.7)).astype(float)
    model = Q.fit_rules(x, y)
    assert 0 < len(model.rules) < 120
    p = 1 / (1 + np.exp(-model.decision(x)))
    assert np.mean((p > 0.5) == y) > 0.97
    df = spark.createDataFrame(x.tolist(), [Q.PREFIX + f for f in Q.FEATURES])
    got = np.array([r[0] for r in df.select(model.column()).collect()])
    assert np.allclose(np.sort(got), np.sort(p))


def test_degenerate_tables(spark):
    docs, labels = corpus(20)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    la = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert {r.score for r in Q.score_documents(d, la.limit(0)).collect()} == {0.5}
    assert Q.score_documents(d.limit(0), la).count() == 0
    assert min(r.score for r in Q.score_documents(d, la.where("quality = 1")).collect()) > 0.8


def test_ids_of_text_and_repeated_ids(spark):
    docs, labels = corpus(200)
    named = [(f"d{i}", t) for i, t, _ in docs]
    d = spark.createDataFrame([*named, ("d3", "another text under a labelled id"), ("d3", docs[0][1])], "doc_id string, text string")
    la = spark.createDataFrame([(f"d{i}", y) for i, y, _ in labels], "doc_id string, quality int")
    score = lambda df: {(r.doc_id, r.score) for r in Q.score_documents(df, la).collect()}
    first = score(d.repartition(5))
    assert len(first) >= 200 and first == score(d.repartition(2).orderBy("text"))


def test_statistics_are_those_of_plain_python(spark):
    import math
    import re

    rng = random.Random(3)
    parts = ["Word", "two", "é", "ÀB", "12", "###", "a|b", "Yes!", "No.", "\n", "\n\n", "  ", "end?", "{x}", "日本"]
    texts = [None, "", " ", "one", *["".join(rng.choice(parts) + rng.choice([" ", "", "\n"]) for _ in range(rng.randint(1, 60))) for _ in range(60)], "long word " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in Q.with_features(df).collect():
        t = r.text or ""
        words, lines = re.split(r"\s+", t.strip(" ")), t.split("\n")
        solid = max(len(t) - len(re.findall(r"[ \t\n\x0b\f\r]", t)), 1)
        got = {f: r[Q.PREFIX + f] for f in Q.FEATURES}
        letters = sum(c.isalpha() or c.isspace() for c in t)
        want = {
            "log_chars": math.log1p(len(t)), "log_words": math.log1p(len(words)), "distinct_words": len(set(words)) / len(words), "distinct_lines": len(set(lines)) / len(lines),
            "upper": sum(c.isupper() for c in t) / solid, "digit": sum(c in "0123456789" for c in t) / solid, "non_letter": (len(t) - letters) / solid,
            "bars_per_word": t.count("|") / len(words), "bangs_per_word": t.count("!") / len(words), "longest_line": math.log1p(max(map(len, lines))),
        }
        for f, v in want.items():
            assert abs(got[f] - v) < 1e-9, (f, t[:50])


def test_weights_solve_the_lasso(monkeypatch):
    """Every rule is a path of a tree, and the weights meet the optimality conditions of the penalised fit."""
    rng = np.random.default_rng(6)
    x = rng.random((1500, len(Q.FEATURES)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.7) | (rng.random(1500) < 0.1)).astype(float)
    paths, grow = [], Q._grow

    def noted(*args):
        grow(*args)
        if not args[8]:
            paths.extend(args[9][len(paths) :])

    monkeypatch.setattr(Q, "_grow", noted)
    penalty = 0.003
    model = Q.fit_rules(x, y, trees=15, penalty=penalty)
    rules = {Q._simplest(p) for p in paths}
    assert model.rules and all(r.conditions in rules for r, _ in model.rules)
    weight = {r.holds(x).tobytes(): w for r, w in model.rules}
    left = 1 / (1 + np.exp(-model.decision(x))) - y
    assert abs(left.mean()) < 1e-3
    for p in rules:
        cover = Q.Rule(p).holds(x)
        if 0 < cover.sum() < len(y):
            scale = max(cover.std(), 0.02)
            slope = (left * cover).mean() / scale
            w = weight.get(cover.tobytes(), 0.0)
            assert abs(slope) <= penalty * 1.1
            if abs(w * scale) > 0.02:
                assert abs(slope + penalty * np.sign(w)) < penalty * 0.1

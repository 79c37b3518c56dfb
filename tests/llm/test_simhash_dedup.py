import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewater.llm import simhash_dedup as S


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(fps):
    parent = {i: i for i in fps}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, a), (j, b) in itertools.combinations(sorted(fps.items()), 2):
        if bin(a ^ b).count("1") <= 2:
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in fps}


def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=rng.randint(3, 90))) for _ in range(40)]
    out = [None, "", "  \n\t ", "one", "Two words", "ÀÉ ñ é", "A B c d"]
    for t in base:
        out += [t, t.upper(), t + " tail"]
        parts = t.split()
        parts[len(parts) // 2] = "changed"
        out.append("\n".join(parts))
    return out


def test_matches_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.classes(df).collect()}
    fps = {i: brute_fingerprint(t) for i, t, _ in rows}
    want = brute_classes(fps)
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


def near_codes(n, seed):
    rng = np.random.default_rng(seed)
    centre = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    out = []
    for _ in range(n):
        c = int(centre[rng.integers(6)])
        for b in rng.integers(0, 64, rng.integers(0, 5)):
            c ^= 1 << int(b)
        out.append(c)
    return np.unique(np.array(out, np.uint64))


@pytest.mark.parametrize("front", [7, 1 << 16])
def test_trie_join_finds_the_classes(monkeypatch, front):
    monkeypatch.setattr(S, "_FRONT", front)
    codes = near_codes(900, 1)
    forest = S.Forest(len(codes))
    assert S.join_trie(codes, forest, (0, len(codes)), (0, len(codes))) > 100
    want = brute_classes({i: int(c) for i, c in enumerate(codes)})
    assert forest.roots(np.arange(len(codes))).tolist() == [want[i] for i in range(len(codes))]


def test_documents_go_through_inner_nodes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fps = {r.fp for r in S.fingerprints(docs).collect()}
    codes = np.sort(np.array(list(fps), np.int64).view(np.uint64))
    forest = S.Forest(len(codes))
    split = S.join_trie(codes, forest, (0, len(codes)), (0, len(codes)))
    assert split > len(codes)  # the traversal does the work, not the comparison of leaves
    want = brute_classes({i: int(c) for i, c in enumerate(codes)})
    assert forest.roots(np.arange(len(codes))).tolist() == [want[i] for i in range(len(codes))]


@pytest.mark.parametrize("per_trie", [4, 50])
def test_tries_of_any_size_give_the_same_classes(spark, monkeypatch, per_trie):
    monkeypatch.setattr(S, "TRIE_CODES", per_trie)
    codes = near_codes(500, 3)
    assert S.trie_depth(len(codes)) > 2
    fps = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    forest = S.Forest(len(codes))
    at = {int(c): i for i, c in enumerate(codes.view(np.int64))}
    edges = np.array([(at[r.a], at[r.b]) for r in S.links(fps).collect()]).reshape(-1, 2)
    forest.join(edges[:, 0], edges[:, 1])
    want = brute_classes({i: int(c) for i, c in enumerate(codes)})
    assert forest.roots(np.arange(len(codes))).tolist() == [want[i] for i in range(len(codes))]


@pytest.mark.parametrize("limit", [5, 40])
def test_blocks_over_the_limit_are_cut(spark, limit):
    codes = near_codes(500, 2)
    fps = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    from tidewater.llm.components import components

    root = {r.vertex: r.root for r in components(S.links(fps, limit)).collect()}
    want = brute_classes({i: int(c) for i, c in enumerate(codes)})
    groups = {}
    for i, c in enumerate(codes.view(np.int64).tolist()):
        groups.setdefault(want[i], set()).add(root.get(c, c))
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set().union(*groups.values()))


def test_empty_null_and_repeated_ids(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.classes(df).count() == 0
    df = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (3, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.component_id) for r in S.classes(df).collect())
    assert got == [("3", 3), ("7", 7), ("7", 7), ("None", 7)]
    assert S.classes(df.where(F.col("doc_id").isNull())).first().component_id is None


def test_near_copies_by_similarity(spark):
    rng = random.Random(21)
    words = [f"w{i}" for i in range(900)]
    docs, base = {}, 0
    for _ in range(25):
        t = rng.choices(words, k=rng.randint(60, 220))
        docs[base] = t
        for c in range(rng.randint(0, 4)):
            u = list(t)
            for p in rng.sample(range(len(u)), max(1, len(u) // 60)):
                u[p] = f"edit{rng.randint(0, 10**6)}"
            docs[base + 1 + c] = u
        base += 10
    docs[base] = docs[0][:40]  # shares words, but isn't alike
    rows = [(i, " ".join(t), "x") for i, t in docs.items()] + [(None, " ".join(docs[0]), "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rep string").repartition(3)
    sets = {i: {tuple(t[k : k + 5]) for k in range(len(t) - 4)} for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(docs, 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) or bin(brute_fingerprint(" ".join(docs[i])) ^ brute_fingerprint(" ".join(docs[j]))).count("1") <= 2:
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    got = {r.doc_id: r.component_id for r in S.near_classes(df).collect()}
    want = {i: find(i) for i in docs}
    assert sum(got[i] == want[i] for i in docs) >= 0.97 * len(docs)
    assert all(want[got[i]] == want[i] for i in docs)  # never joins what isn't linked
    kept = {r.doc_id for r in S.one_of_each(df).collect()}
    assert kept == {i for i in docs if got[i] == i} | {None}

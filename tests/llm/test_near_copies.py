import itertools
import random

import numpy as np
import pytest

from tidewater.llm import simhash_dedup as S


def joined(spark, pairs):
    """How many of the pairs of texts (numbers) near_classes puts in one class."""
    texts, links = pairs
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in S.near_classes(df).collect()}
    return sum(got[a] == got[b] for a, b in links)


def test_copies_that_are_alike_only_through_their_original(spark):
    rng = random.Random(31)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    texts = [base]
    for _ in range(1000):
        t = list(base)
        for p in rng.sample(range(200), 4):
            t[p] = f"edit{rng.randrange(10**9)}"
        texts.append(t)
    grams = [{tuple(t[k : k + 5]) for k in range(196)} for t in texts]
    links = [(0, i) for i in range(1, 1001) if len(grams[0] & grams[i]) >= 0.8 * len(grams[0] | grams[i])]
    assert len(links) > 900
    assert joined(spark, (texts, links)) >= 0.99 * len(links)


def test_appended_and_truncated_copies(spark):
    rng = random.Random(32)
    texts, links = [], []
    for _ in range(200):
        base = [f"w{rng.randrange(50000)}" for _ in range(200)]
        more = base + [f"w{rng.randrange(50000)}" for _ in range(46)]
        at = len(texts)
        texts += [base, more, base[:164]]
        links += [(at, at + 1), (at, at + 2)]
    assert joined(spark, (texts, links)) >= 0.99 * len(links)


def sets_and_classes(seed, n):
    """Shingle sets in families: copies of copies, alike to some of their family only, and what links connect."""
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(n // 20):
        base = rng.integers(1, 1 << 62, rng.integers(30, 90), dtype=np.uint64)
        for _ in range(20):
            s = base.copy()
            edit = rng.random(len(s)) < rng.choice([0.02, 0.08, 0.12])
            s[edit] = rng.integers(1, 1 << 62, int(edit.sum()), dtype=np.uint64)
            sets.append(np.unique(s))
            if rng.random() < 0.1:
                base = s
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        common = len(np.intersect1d(sets[i], sets[j]))
        if common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return sets, [find(i) for i in range(len(sets))]


def joined_classes(n, links):
    forest = S.Forest(n)
    links = np.array(links, np.int64).reshape(-1, 2)
    forest.join(links[:, 0], links[:, 1])
    return forest.roots(np.arange(n)).tolist()


def test_links_of_sets_are_those_of_all_pairs():
    sets, want = sets_and_classes(33, 300)
    links = S.alike(sets, np.arange(len(sets)))
    assert joined_classes(len(sets), links) == want and len(set(want)) < 200
    assert len(links) == len(sets) - len(set(want))  # a forest
    # ends that are joined already are left out
    assert S.alike(sets, np.array(want)) == []
    assert S.alike(sets[:1], np.arange(1)) == [] and S.alike([], np.arange(0)) == []


@pytest.mark.parametrize("limit", [300, 3000, 10**6])
def test_buckets_cut_into_blocks_have_the_links_of_whole_ones(spark, limit):
    sets, want = sets_and_classes(34, 200)
    rng = np.random.default_rng(35)
    # part of what is joined already, as the centres leave it
    root = [w if rng.random() < 0.4 else i for i, w in enumerate(want)]
    rows = spark.createDataFrame([(1, i, root[i], len(s)) for i, s in enumerate(sets)], "key long, doc_id long, root long, size long")
    given = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sets)], "doc_id long, shingles binary")
    got = [(r.x, r.y) for r in S.bucket_links(rows, given, limit).collect()]
    assert joined_classes(len(sets), got + list(enumerate(root))) == want


def test_unlike_texts_under_one_id_stay(spark):
    say = lambda a: " ".join(f"{a}{i}" for i in range(60))
    rows = [(4, say("a")), (4, say("b")), (4, say("b")), (2, say("c")), (6, say("c")), (6, say("d")), (None, say("a"))]
    got = S.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == [("2", say("c")), ("4", say("a")), ("4", say("b")), ("6", say("d")), ("None", say("a"))]

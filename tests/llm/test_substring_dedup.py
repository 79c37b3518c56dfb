import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import substring_dedup as S


@pytest.mark.parametrize("least", [1, 2, 5, 46])
def test_compact_windows_are_the_cartesian_tree(least):
    rng = np.random.default_rng(least)
    for n, m in ((0, 1), (1, 1), (40, 3), (300, 5), (700, 2)):
        rows = np.sort(rng.integers(0, m, n))
        h = rng.integers(0, 1 << 62, n, dtype=np.uint64)
        want = set()

        def tree(a, b):
            if b - a < least:
                return
            c = a + int(np.argmin(h[a:b]))
            want.add((a, c, b - 1))
            tree(a, c)
            tree(c + 1, b)

        for r in range(m):
            at = np.flatnonzero(rows == r)
            if len(at):
                tree(at[0], at[-1] + 1)
        got = list(zip(*(x.tolist() for x in S.compact_windows(h, rows, least)), strict=True))
        assert len(got) == len(want) and set(got) == want


def corpus():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(4000)]
    say = lambda n: rng.choices(vocabulary, k=n)
    docs = {i: say(rng.randint(60, 300)) for i in range(60)}
    planted = []
    for i in range(12):
        p = say(rng.randint(51, 120))
        a, b, c = rng.sample(range(60), 3)
        for d in (a, b, c):
            at = rng.randint(0, len(docs[d]))
            q = list(p)
            if i % 3 == 2 and d != a:
                q[len(q) // 2] = "edit"
            docs[d] = docs[d][:at] + q + docs[d][at:]
        planted.append((a, b, c))
    line = say(12)
    for i in range(60):
        docs[i] = line + docs[i]
    return {i: " ".join(d) for i, d in docs.items()}, planted


def shared_run(a, b):
    """The longest run of words that two texts have in common."""
    a, b = a.lower().split(), b.lower().split()
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                new[j + 1] = row[j] + 1
                best = max(best, new[j + 1])
        row = new
    return best


def test_planted_passages_are_found_and_others_are_not(spark):
    docs, planted = corpus()
    rows = [(i, t, 0) for i, t in docs.items()] + [(100, None, 0), (101, "", 0), (None, docs[0], 0), (102, "few words", 0), (3, docs[3], 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(4)
    got = S.repeated_passages(df).collect()
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in got:
        assert r.rep_id < r.doc_id and r.similarity >= 0.8 and r.end - r.start >= 50
        x, y = find(r.rep_id), find(r.doc_id)
        root[max(x, y)] = min(x, y)
        mine, theirs = docs[r.doc_id].lower().split()[r.start : r.end], docs[r.rep_id].lower().split()[r.rep_start : r.rep_end]
        assert len(set(mine) & set(theirs)) > 0.7 * len(set(mine))
    for a, b, c in planted:
        assert find(a) == find(b) == find(c), (a, b, c)
    truth = {i: set() for i in docs}
    for p in planted:
        for i in p:
            truth[i] |= set(p)
    for r in got:
        assert r.rep_id in truth[r.doc_id], r


def test_hot_passage_gives_a_star(spark):
    rng = random.Random(9)
    p = " ".join(rng.choices([f"p{i}" for i in range(500)], k=60))
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("own "), F.col("id").cast("string"), F.lit(" "), F.lit(p)).alias("text"))
    got = S.repeated_passages(df).collect()
    assert len(got) == 299 and {r.rep_id for r in got} == {0} and {r.doc_id for r in got} == set(range(1, 300))
    old, S.VERIFY_GROUP = S.VERIFY_GROUP, 512
    assert S.verify(df, spark.createDataFrame([(i, 0, 0, 60) for i in range(1, 300)], "doc_id long, rep long, lo int, hi int"), group=20).count() == 299
    S.VERIFY_GROUP = old


def test_empty(spark):
    assert S.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_unlike_stretches_are_taken_apart():
    rng = np.random.default_rng(3)
    fresh = lambda n: rng.integers(0, 1 << 62, n, dtype=np.uint64)
    a, b = fresh(60), fresh(70)
    mine = np.concatenate([fresh(30), a, fresh(12), b, fresh(40)])
    theirs = np.concatenate([fresh(5), a, fresh(40), b, fresh(300)])
    assert [(s, e, c, d) for s, e, c, d, _ in S.passages(mine, theirs)] == [(30, 90, 5, 65), (102, 172, 105, 175)]
    swapped = np.concatenate([b, fresh(200), a])
    assert [(s, e, c, d) for s, e, c, d, _ in S.passages(np.concatenate([a, b]), swapped)] == [(0, 60, 270, 330), (60, 130, 0, 70)]
    assert S.passages(mine, fresh(500)) == [] and S.passages(mine[:0], theirs) == [] and S.passages(mine, theirs[:0]) == []
    edited = np.concatenate([a, b])
    edited[40:45] = fresh(5)
    got = S.passages(edited, np.concatenate([a, b]))
    assert len(got) == 1 and got[0][:4] == (0, 130, 0, 130) and got[0][4] > 0.9


def test_run_hashes_tell_runs_apart():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 1 << 62, 500, dtype=np.uint64)
    for least in (1, 2, 3, 46, 47, 64):
        copy = np.concatenate([rng.integers(0, 1 << 62, 33, dtype=np.uint64), h, h[:least]])
        a, b = S.run_hashes(h, least), S.run_hashes(copy, least)
        assert len(a) == 500 - least + 1 and len(set(a.tolist())) == len(a)
        assert (b[33 : 33 + len(a)] == a).all() and b[-1] == a[0]
        assert len(S.run_hashes(h[:least], least)) == 1


def recombined(seed, n):
    """Texts of lines that many have, so that a passage's words all stand in earlier texts, and passages in common."""
    rng = random.Random(seed)
    say = lambda k, m=3000: [f"w{rng.randrange(m)}" for _ in range(k)]
    lines = [say(22) for _ in range(12)]
    docs = []
    for _ in range(n):
        d = say(rng.randint(20, 60))
        for _ in range(rng.randint(1, 3)):
            d += rng.choice(lines) + say(rng.randint(10, 40))
        docs.append(d)
    for _ in range(n // 6):
        # two or three lines in a row: earlier texts have each of them, few have them together
        p = [w for line in rng.sample(lines, 3) for w in line][: rng.randint(52, 66)]
        for i in rng.sample(range(n // 2, n), 3):
            at = rng.randint(0, len(docs[i]))
            docs[i] = docs[i][:at] + p + docs[i][at:]
    return [" ".join(d) for d in docs]


@pytest.mark.parametrize("n", [150, 600])
def test_no_equal_passage_is_lost(spark, n):
    """Against brute force: all texts with 50 equal words are joined, at two sizes."""
    texts = recombined(7, n)
    by = {}
    for i, t in enumerate(texts):
        w = t.split()
        for k in range(len(w) - 49):
            by.setdefault(" ".join(w[k : k + 50]), set()).add(i)
    forest = {i: i for i in range(n)}

    def find(i):
        while forest[i] != i:
            i = forest[i]
        return i

    got = S.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()
    for r in got:
        x, y = find(r.doc_id), find(r.rep_id)
        forest[max(x, y)] = min(x, y)
    groups = [g for g in by.values() if len(g) > 1]
    assert len(groups) > n // 6
    lost = [g for g in groups if len({find(i) for i in g}) > 1]
    assert not lost
    reported = {r.doc_id for r in got}
    assert all(i in reported for g in groups for i in g if i != min(g))


def edited(seed, n):
    """As `recombined`, but each passage stands in two texts, and one of these has it with edits."""
    rng = random.Random(seed)
    say = lambda k, m=3000: [f"w{rng.randrange(m)}" for _ in range(k)]
    lines = [say(22) for _ in range(12)]
    docs = []
    for _ in range(n):
        d = say(rng.randint(20, 60))
        for _ in range(rng.randint(1, 3)):
            d += rng.choice(lines) + say(rng.randint(10, 40))
        docs.append(d)
    for turn in range(n // 6):
        p = [w for line in rng.sample(lines, 3 if turn % 2 else 5) for w in line][: 110 if turn % 2 == 0 else rng.randint(56, 66)]
        for k, i in enumerate(rng.sample(range(n // 2, n), 2)):
            q = list(p)
            for cut in (22, 70)[: k * (1 + len(p) // 100)]:
                at = cut + rng.randrange(12)
                q[at : at + rng.randrange(2)] = ["edit"] * rng.randrange(1, 3) if turn % 3 else []
            at = rng.randint(0, len(docs[i]))
            docs[i] = docs[i][:at] + q + docs[i][at:]
    return [" ".join(d) for d in docs]


@pytest.mark.parametrize("n,text_ids", [(150, True), (600, False)])
def test_no_edited_passage_is_lost(spark, n, text_ids):
    """Against brute force: all pairs of texts with a passage in common are joined, and its later text is reported, also
    where earlier texts have all its lines."""
    texts = edited(11, n)
    h = [S.shingles(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0] for t in texts]
    sets = [set(x.tolist()) for x in h]
    # 50 words on both sides
    long = lambda i, j: any(d - c >= S.LEAST for _, _, c, d, _ in S.passages(h[i], h[j]))
    want = [(i, j) for i in range(n) for j in range(i) if len(sets[i] & sets[j]) > 30 and long(i, j)]
    assert len(want) > n // 15
    name = (lambda i: f"d{i:04d}") if text_ids else (lambda i: i)
    df = spark.createDataFrame([(name(i), t) for i, t in enumerate(texts)], f"doc_id {'string' if text_ids else 'long'}, text string")
    got = S.repeated_passages(df.repartition(4)).collect()
    forest = {name(i): name(i) for i in range(n)}

    def find(i):
        while forest[i] != i:
            i = forest[i]
        return i

    for r in got:
        assert r.rep_id < r.doc_id and r.similarity >= 0.8
        x, y = find(r.doc_id), find(r.rep_id)
        forest[max(x, y)] = min(x, y)
    assert [p for p in want if find(name(p[0])) != find(name(p[1]))] == []
    assert {name(i) for i, _ in want} <= {r.doc_id for r in got}


def test_alike_finds_all_pairs_with_enough_in_common():
    rng = np.random.default_rng(5)
    fresh = lambda k: rng.integers(0, 1 << 62, k, dtype=np.uint64)
    line, other, few = fresh(30), fresh(60), [fresh(40) for _ in range(30)]
    near = [np.unique(np.concatenate([line, fresh(70)])) for _ in range(200)]
    near += [np.unique(np.concatenate([line, few[k % 30], fresh(20)])) for k in range(60)]
    near += [np.unique(np.concatenate([line, other[rng.random(60) < 0.8]])) for _ in range(50)]
    home = np.arange(len(near))
    home[-20:] = home[-1]
    sets = [set(x.tolist()) for x in near]
    for some in (range(len(near)), range(195, 206)):
        some = list(some)
        i, j = S.alike([near[k] for k in some], np.ones(len(some), bool), home[some])
        got = set(zip(i.tolist(), j.tolist(), strict=True))
        want = {(a, b) for b in range(len(some)) for a in range(b) if home[some[a]] != home[some[b]] and len(sets[some[a]] & sets[some[b]]) >= S.ENOUGH}
        assert got == want
    # frequent shingles alone: one pattern gives a star, not all pairs
    i, j = S.alike([other] * 300, np.ones(300, bool), np.arange(300))
    assert len(i) == 299 and set(i.tolist()) == {0}


def test_ids_of_text(spark):
    docs, planted = corpus()
    df = spark.createDataFrame([(f"d{i:03d}", t) for i, t in docs.items()], "doc_id string, text string").repartition(3)
    numbers = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    want = {(f"d{r.doc_id:03d}", f"d{r.rep_id:03d}", r.start, r.end) for r in S.repeated_passages(numbers).collect()}
    assert {(r.doc_id, r.rep_id, r.start, r.end) for r in S.repeated_passages(df).collect()} == want and len(want) > 20


def test_no_pass_yields_a_batch_for_each_document(spark, monkeypatch):
    """A batch costs as much as hundreds of rows, on both sides of the pipe: passes work on many documents at a time."""
    from pyspark.sql.classic.dataframe import DataFrame

    plain, made = DataFrame.mapInArrow, {}

    def counted(self, func, schema, *args, **more):
        name = func.__name__
        made[name] = made.get(name) or spark.sparkContext.accumulator(0)
        count = made[name]

        def passing(batches):
            for batch in func(batches):
                count.add(1)
                yield batch

        return plain(self, passing, schema, *args, **more)

    monkeypatch.setattr(DataFrame, "mapInArrow", counted)
    texts = edited(11, 300)
    n = S.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).count()
    assert n > 20 and {"joined", "stretched", "choosing", "surrounding"} <= set(made)
    assert {k: c.value for k, c in made.items() if c.value > 60} == {}


def test_compact_windows_of_repeated_shingles():
    """Runs of equal hashes: the leftmost is the smallest, however long the run."""
    rng = np.random.default_rng(8)
    for n in (60, 300, 3000):
        h = np.full(n, 1 << 40, np.uint64)
        h[rng.integers(0, n, 4)] = 1 << 39
        h[-1] = 0
        rows = np.sort(rng.integers(0, 3, n))
        want = set()
        for r in range(3):
            at = np.flatnonzero(rows == r)
            todo = [(int(at[0]), int(at[-1]) + 1)] if len(at) else []
            while todo:
                a, b = todo.pop()
                if b - a >= 5:
                    c = a + int(np.argmin(h[a:b]))
                    want.add((a, c, b - 1))
                    todo += [(a, c), (c + 1, b)]
        assert set(zip(*(x.tolist() for x in S.compact_windows(h, rows, 5)), strict=True)) == want


def test_only_pairs_without_a_passage_are_left_out():
    rng = np.random.default_rng(9)
    fresh = lambda k: rng.integers(0, 1 << 32, k, dtype=np.uint64)
    lines = [fresh(104) for _ in range(6)]
    raw = []
    for k in range(120):
        x = lines[k % 6].copy()
        if k % 4 == 3:
            x = np.concatenate([x[:50], x[:54]])  # repeats shingles
        at = rng.random(len(x)) < rng.choice([0, 0.05, 0.2, 0.5])
        x[at] = fresh(int(at.sum()))
        raw.append(x[: rng.integers(40, 105)])
    grid, near, known, stride = S.numbered(raw)
    assert [len(x) for x in near] == [len(set(x.tolist())) for x in raw]
    whole = np.array([len(x) == len(y) for x, y in zip(near, raw, strict=True)])
    i, j = (x.ravel() for x in np.meshgrid(np.arange(120), np.arange(120)))
    found = np.array([bool(S.passages(raw[b], raw[a])) for a, b in zip(i.tolist(), j.tolist(), strict=True)])
    kept = S.promising(grid, known, stride, whole, i, j)
    assert (kept >= found).all() and found.sum() > 500 and kept.sum() < 0.5 * len(kept)


def test_repeated_patterns_are_compared_at_their_ends_and_by_themselves():
    """A word said a thousand times has the same short run at every place."""
    at = np.concatenate([np.arange(5, 905), [950, 958]])
    run = np.concatenate([np.full(900, 7), [9, 9]]).astype(np.uint64)
    zero = np.zeros(len(at), int)
    number, begin, size, more = (x.tolist() for x in S.surrounded(zero, run, zero, at))
    side = S.SHORT + 2 * S.LEAST
    assert sorted(zip(at[number].tolist(), begin, size, more, strict=True)) == sorted(
        [(5, 5 - S.LEAST, side, -1), (904, 904 - S.LEAST, side, -1), (5, 5, side, 899 + S.SHORT - side), (950, 950 - S.LEAST, side, -1), (958, 958 - S.LEAST, side, -1)]
    )
    assert not any(map(len, S.surrounded(*[np.zeros(0, int)] * 4)))


def test_patterns_between_unlike_neighbours_are_found_whole(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=8))
    said = [("The", 120), ("du", 400), ("sch", 64)]
    docs = [(k, " ".join([word() for _ in range(70)] + [w] * 30 + [word() for _ in range(70)])) for k, (w, _) in enumerate(said)]
    docs += [(10 + k, " ".join([word() for _ in range(60 + k)] + [w] * n + [word() for _ in range(60)])) for k, (w, n) in enumerate(said)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    stretches = spark.createDataFrame([(k, 0, 2000) for k, _ in docs], "doc_id long, lo int, hi int")
    none = spark.createDataFrame([], "doc_id long, rep_id long, start int, end int, rep_start int, rep_end int, similarity double")
    got = S.edited_passages(rows, stretches, none).collect()
    for k, (_, n) in enumerate(said):
        found = set().union(*(range(r["start"], r["end"] + r["more"]) for r in got if r["doc_id"] == 10 + k and r["rep_id"] == k))
        assert found == set(range(60 + k, 60 + k + n)), k


def test_memory_of_a_group_grows_with_its_shingles_only():
    """Members times frequent shingles, or patterns times patterns, would take gigabytes in a group of a large input."""
    import tracemalloc

    rng = np.random.default_rng(13)
    n, m = 9000, 2400
    near = [np.unique(np.concatenate([m + 4 * (k % 60) + np.arange(4), rng.integers(0, m, 9)])) for k in range(n)]
    home = np.zeros(n, np.int64)
    home[rng.choice(n, 40, replace=False)] = np.arange(1, 41)
    tracemalloc.start()
    i, j = S.alike(near, np.zeros(n, bool), home)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    sets = [set(x.tolist()) for x in near]
    enough = np.array([len(x) * S.ENOUGH // (S.SHORT + 2 * S.LEAST) for x in near])
    want = {(min(a, b), max(a, b)) for a in np.flatnonzero(home).tolist() for b in range(n) if home[a] != home[b] and len(sets[a] & sets[b]) >= min(enough[a], enough[b])}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and 4000 < len(want) < 10000
    assert peak < 80, peak

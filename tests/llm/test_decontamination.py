import hashlib
import random
import re

import pytest

from tidewater.llm.decontamination import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        if i is not None and w:
            for k in range(max(1, len(w) - 9)):
                windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    out = []
    for d, t in docs:
        w = words(t)
        hit, ids = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (of := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    ids |= of
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


def data():
    rng = random.Random(8)
    vocabulary = ["é", "Ab", "c1", "x", "y", "z"] + [f"w{i}" for i in range(80)]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, say(rng.choice([0, 1, 3, 9, 10, 11, 40]))) for i in range(30)] + [(2, say(12)), (None, say(20)), (99, None), (7, "one one one one one one one one one one one")]
    docs = [(None, say(30)), (1, None), (2, ""), (3, "...!"), (3, "one " * 50)]
    for i in range(60):
        _, t = rng.choice(items)
        cut = (t or "").split()
        a = rng.randint(0, max(0, len(cut) - 10))
        docs.append((10 + i, say(rng.randint(0, 30)) + " -- " + ",\n".join(cut[a : a + rng.randint(8, 40)]).upper() + "; " + say(rng.randint(0, 30))))
    return docs, items


@pytest.mark.parametrize("block_bytes", [1 << 20, 900])
def test_matches_brute_force(spark, block_bytes):
    docs, items = data()
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, n_words int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in decontaminate(d, b, block_bytes).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(brute(docs, items), key=key)


def test_empty_tables(spark):
    docs, items = data()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate(d.limit(0), b).count() == 0
    assert decontaminate(d, b.limit(0)).where("contaminated or n_hit > 0 or n_items > 0").count() == 0

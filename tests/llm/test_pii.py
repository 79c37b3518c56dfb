import hashlib
import random
import re

from tidewater.llm.pii import redact, report


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    spans = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m.group())]
    listed = ",".join(s for _, _, s in sorted(spans))
    return [sum(x[1] == i for x in spans) for i in range(4)], listed


CASES = [
    None, "", "no data", "mail a.b+c@x-y.co.uk, c@d.e_f@g.h @ a@b a@b..c x@y.z.", "a@b.c.d@e.f@g.h", "é@x.com ünï@é.com ok@ok.ok😀 q@q.q",
    "ip 1.2.3.4.5.6.7.8 256.1.1.1 0000255.00.0.01 1.2.3 10.0.0.1.", "999999999999999999999.1.1.1 1.1.1.1",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111 5500 0000 0000 0004 1", "1 2 3 4 5 6 7 8 9 0 1 2 3 4", "4111  1111 1111 1111",
    "12" * 40, "4111 1111 1111 1111 -4111111111111111", "phone +1 (706) 555-3138. +49 89 1234567 +1 +12 +123456789012345678 ++441234567890 +4412345 6789-", "+1(2)3 45 678 9-x",
    "x" * 5000 + "@" + "y" * 5000, "1 " * 6000, "1." * 3000, "+1" * 2000, "0" * 9000, "(" * 3000 + "+1" + "(" * 3000 + "2 34567890",
]


def texts():
    rng = random.Random(4)
    parts = ["a", "B", "@", ".", "-", " ", "+", "1", "22", "333", "4111111111111111", "(", ")", "_", "é", "😀", "\n", "0", "c.d", "x@y.z", "1.2.3.4", "+12 345 678 90"]
    return CASES + ["".join(rng.choices(parts, k=rng.randint(1, 60))) for _ in range(300)]


def test_base_matches_brute_force(spark):
    rows = [(i, t, 0) for i, t in enumerate(texts())]
    got = {r.doc_id: r for r in report(spark.createDataFrame(rows, "doc_id long, text string, spans int").repartition(4)).collect()}
    for i, t, _ in rows:
        r = got[i]
        counts, listed = brute(t)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts, t
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), (t, listed, r.spans)
        assert ",".join(s for s in r.spans.split(",") if s.split(":")[0] in ("email", "ip", "card", "phone")) == listed


def test_added_kinds(spark):
    texts = [
        (1, "bank transfer to DE44 5001 0517 5407 3249 31 please"),
        (2, "DE45 5001 0517 5407 3249 31"),
        (3, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'),
        (4, "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"),
    ]
    got = {r.doc_id: r.spans for r in report(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert "iban:17:44" in got[1] and "iban" not in got[2] and got[3] == "secret:9:49" and "secret" not in got[4]


def test_redact_and_empty(spark):
    df = spark.createDataFrame([(1, "é a@b.cd, 1.2.3.4", 9), (2, None, None), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in redact(df).collect()}
    assert got == {1: ("é [EMAIL], [IP]", 15), 2: (None, None), 3: ("clean", 5)}
    assert redact(df).columns == df.columns
    assert report(df.limit(0)).count() == 0


def test_redact_matches_its_spans(spark):
    from tidewater.llm.pii import detect

    rng = random.Random(6)
    long = " ".join(rng.choice(["word" * rng.randint(1, 400), "a@b.cd", "1.2.3.4", "+12 345 678 90", "é😀"]) for _ in range(300))
    rows = [(i, t, 0) for i, t in enumerate([*texts()[:120], long, long[:1024], long[:1023] + "x@y.zz"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    spans = {r.doc_id: [(s.start, s.end, s.kind) for s in r.spans] for r in detect(df).collect()}
    for r in redact(df).collect():
        t = rows[r.doc_id][1]
        if t is None:
            assert r.text is None
            continue
        out, pos = [], 0
        for a, b, kind in spans[r.doc_id]:
            if a >= pos:
                out += [t[pos:a], f"[{kind.upper()}]"]
            pos = max(pos, b)
        assert r.text == "".join([*out, t[pos:]]) and r.n_chars == len(r.text)


def test_many_matches_in_one_text(spark):
    """Time is nearly linear in the matches of a text."""
    import time

    texts = [" ".join(f"u{i}@mail{i % 7}.example.org" if i % 3 else f"10.0.{i % 256}.{i % 199}" for i in range(n)) for n in (100, 100_000)]
    took = []
    for t in texts:
        df = spark.createDataFrame([(1, t, len(t))], "doc_id long, text string, n_chars long")
        start = time.time()
        (r,) = report(df).collect()
        clean = redact(df).first()
        took.append(time.time() - start)
        counts, listed = brute(t)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts and r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert clean.text.count("[EMAIL]") == counts[0] and "@" not in clean.text
    assert took[1] < took[0] + 45

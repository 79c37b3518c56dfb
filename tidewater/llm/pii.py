"""Personal data: regular expressions propose spans, checksums confirm them, nearby context words adjust the score.

All of it is built-in expressions. The places of matches follow from the pieces between them: `split` and
`regexp_extract_all` run the same search, so the lengths of pieces and matches add up to code point offsets. Patterns
are written with possessive quantifiers and anchored at the start of a run, which leaves the leftmost matches as they
are and keeps the search linear in the text and free of deep recursion.

Base kinds (email, ip, card, phone) are kept whenever their check passes; further kinds (iban, secret) need a score of
at least THRESHOLD, which checksums and context words supply.

Defined cases: null and empty texts have no spans; spans of different kinds may overlap; equal rows get equal results;
further columns are ignored by `detect` and kept by `redact`; an empty table gives no rows. Time is linear in a text and
its matches, but for 1/256 of the matches' square in additions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.6
CONTEXT_CHARS = 40

#: Values of one block of a running fold, and characters of one piece of a text.
_BLOCK = 256
_PIECE = 1024

SPANS = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits of the match pass the Luhn check."""
    d = F.reverse(_digits(m))
    value = F.transform(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), lambda i: F.struct(i.alias("i"), F.substring(d, i, F.lit(1)).try_cast("int").alias("v")))
    twice = lambda v: F.when(v > 4, 2 * v - 9).otherwise(2 * v)
    return F.coalesce(F.aggregate(value, F.lit(0), lambda a, x: a + F.when(x["i"] % 2 == 0, twice(x["v"])).otherwise(x["v"])) % 10 == 0, F.lit(False))


def mod97(m: Column) -> Column:
    """Whether an account number leaves 1 modulo 97, its first four characters moved to the end and letters as 10 to 35."""
    s = F.regexp_replace(m, " ", "")
    moved = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, F.lit(1), F.lit(4)))
    signs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(moved), F.lit(1))), lambda i: F.ascii(F.substring(moved, i, F.lit(1))))
    step = lambda a, c: F.when(c >= 65, (a * 100 + c - 55) % 97).otherwise((a * 10 + c - 48) % 97)
    return F.aggregate(signs, F.lit(0), step) == 1


def _ip(m: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return m.rlike(rf"^{part}(?:\.{part}){{3}}$")


def _phone(m: Column) -> Column:
    return F.length(_digits(m)).between(9, 15)


@dataclass(frozen=True)
class Kind:
    """A pattern, its check, its score with the check passed, words that raise the score, and whether it is base."""

    name: str
    pattern: str
    valid: Callable[[Column], Column]
    score: float
    context: str
    base: bool = True


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), 0.8, "mail|contact|write|reach"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _ip, 0.6, "ip|host|server|address|login"),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])", luhn, 0.8, "card|visa|credit|debit|pay"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _phone, 0.6, "phone|tel|call|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", mod97, 0.7, "iban|account|bank|transfer", False),
    Kind("secret", r"(?<![A-Za-z0-9])[0-9a-f]{32,64}+(?![A-Za-z0-9])", lambda m: F.lit(True), 0.3, "token|secret|api|key|password", False),
)
BASE = tuple(k.name for k in KINDS if k.base)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, fold: Callable[[Column, Column], Column]) -> Column:
    """The running fold of an array of int, from 0: by blocks, as an array grows by being copied."""

    def grown(first: Column, more: Column) -> Column:
        return F.aggregate(more, F.array(first), lambda acc, x: F.concat(acc, F.array(fold(F.element_at(acc, -1), x))))

    def joined(blocks: Column) -> Column:
        before = grown(F.lit(0), F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), fold)))
        return F.flatten(F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)), lambda b, first: F.slice(grown(first, b), F.lit(2), F.size(b))))

    last = lambda v: F.greatest(F.ceil(F.size(v) / _BLOCK).cast("int") - 1, F.lit(0))
    return let(values, lambda v: let(F.transform(F.sequence(F.lit(0), last(v)), lambda i: F.slice(v, i * _BLOCK + 1, F.lit(_BLOCK))), joined))


def _spans(t: Column, kind: Kind, rank: int) -> Column:
    """The kind's valid spans with their scores, by start. Context is looked for in what precedes a match, back to the
    second match before it."""

    def found(gaps: Column, matches: Column) -> Column:
        ends = running(F.zip_with(gaps, matches, lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0))), lambda a, x: a + x)
        both = F.zip_with(gaps, matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
        earlier = F.concat(F.array(F.lit("")), F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.concat(g, m)))
        rows = F.zip_with(F.zip_with(both, earlier, lambda x, e: F.struct(x["gap"].alias("gap"), x["match"].alias("match"), e.alias("earlier"))), ends, lambda x, end: F.struct(x["gap"].alias("gap"), x["match"].alias("match"), x["earlier"].alias("earlier"), end.alias("end")))
        right = F.filter(rows, lambda x: F.when(x["match"].isNull(), False).otherwise(kind.valid(x["match"])))
        return F.transform(right, scored)

    def scored(x: Column) -> Column:
        near = F.when(F.length(x["gap"]) >= CONTEXT_CHARS, x["gap"]).otherwise(F.concat(x["earlier"], x["gap"]))
        score = F.lit(kind.score) + F.when(F.lower(F.substring(near, -CONTEXT_CHARS, CONTEXT_CHARS)).rlike(rf"\b(?:{kind.context})"), 0.4).otherwise(0.0)
        return F.struct((x["end"] - F.length(x["match"])).alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind.name).alias("kind"), F.least(score, F.lit(1.0)).alias("score"))

    spans = let(F.split(t, kind.pattern, -1), lambda g: let(F.regexp_extract_all(t, F.lit(kind.pattern), F.lit(0)), lambda m: found(g, m)))
    spans = spans if kind.base else F.filter(spans, lambda x: x["score"] >= THRESHOLD)
    return F.when(t.rlike(kind.pattern), spans.cast(SPANS)).otherwise(F.array().cast(SPANS))


def spans_of(text: Column) -> Column:
    """All spans of a text column (not null): an array of (start, rank, end, kind, score), by start, then kind."""
    return F.array_sort(F.concat(*[_spans(text, k, i) for i, k in enumerate(KINDS)]))


def detect(documents: DataFrame) -> DataFrame:
    """doc_id and its spans: array of (start, rank, end, kind, score); code points, end exclusive."""
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("doc_id", spans_of(F.col("text")).alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(documents: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, max_score for every document."""
    found = detect(documents)
    base = F.filter("spans", lambda x: x["rank"] < len(BASE))
    count = lambda i: F.size(F.filter("spans", lambda x: x["rank"] == i)).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
        F.array_max(F.transform("spans", lambda x: x["score"])).alias("max_score"),
    )


def redact(documents: DataFrame) -> DataFrame:
    """The documents with each span, overlapping ones together, replaced by its kind in brackets; n_chars follows the
    text where it is there. A null text stays null."""
    t, found = F.col("text"), F.col("_tw_spans")

    def between(blocks: Column, a: Column, b: Column) -> Column:
        """The text from a to b, by blocks: a substring of the whole would be searched for from its beginning."""
        i, j = F.floor(a / _PIECE).cast("int"), F.floor(b / _PIECE).cast("int")
        at = lambda k: F.coalesce(F.get(blocks, k), F.lit(""))
        far = F.concat(F.substring(at(i), a % _PIECE + 1, F.lit(_PIECE)), F.array_join(F.slice(blocks, i + 2, j - i - 1), ""), F.substring(at(j), F.lit(1), b % _PIECE))
        return F.when(i == j, F.substring(at(i), a % _PIECE + 1, b - a)).otherwise(far)

    def cleaned(blocks: Column, ends: Column) -> Column:
        # where spans overlap, the first one's kind stands for all of them
        before = F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.size(ends) - 1))
        firsts = F.filter(F.zip_with(found, before, lambda x, e: F.struct(e.alias("from"), x["start"].alias("start"), x["kind"].alias("kind"))), lambda x: x["from"] <= x["start"])
        marked = F.transform(firsts, lambda x: F.concat(between(blocks, x["from"], x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]")))
        return F.concat(F.array_join(marked, ""), between(blocks, F.element_at(ends, -1), F.length(t)))

    clean = let(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0)), lambda blocks: let(running(F.transform(found, lambda x: x["end"]), lambda a, x: F.greatest(a, x)), lambda ends: cleaned(blocks, ends)))
    with_spans = documents.withColumn("_tw_spans", spans_of(F.coalesce(t, F.lit(""))))
    done = with_spans.withColumn("text", F.when(t.isNotNull() & (F.size("_tw_spans") > 0), clean).otherwise(t))
    out = reduce(lambda d, c: d.withColumn(c, F.length("text").cast(dict(documents.dtypes)[c])), [c for c in documents.columns if c == "n_chars"], done)
    return out.select(*documents.columns)

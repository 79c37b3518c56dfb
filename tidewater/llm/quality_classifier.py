"""Quality classifier: a sparse rule ensemble.

Shallow boosted trees over text statistics are fitted on a bounded sample of labelled rows; every path of a tree
becomes a conjunctive rule; a lasso-penalised logistic fit keeps few of the rules; the kept rules are compiled into
one Spark column expression, so scoring is a projection without Python.

Defined cases: a null text counts as empty; empty texts get a score like any other; a doc_id labelled more than
once has the mean of its labels (1 if at least half), and of unlike texts under one labelled id one is learned from, by
a hash of the text; ids may be of any type that can be ordered; rows with a null doc_id are scored but never learned from;
without labelled rows every score is 0.5; further columns of the inputs are ignored (`score_documents`) or kept
(`with_score`)."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many labelled documents are collected to fit; part of the operator's contract.
MAX_TRAIN_ROWS = 8000

FEATURES = (
    "log_chars", "log_words", "mean_word", "distinct_words", "distinct_lines", "words_per_line", "upper", "digit",
    "non_letter", "symbol", "bars_per_word", "bangs_per_word", "stops_per_word", "longest_line",
)
PREFIX = "_tw_"


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is divisible by five; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def with_features(df: DataFrame, text: str = "text") -> DataFrame:
    """The frame and, under PREFIX names, the statistics in FEATURES. Two projections: counts, then ratios. The ratios
    come out of a generator of one row: Spark moves a filter below projections, where it would count again for each
    condition of each rule, but never below a generator whose columns it reads."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.split(F.trim(t), r"\s+", -1)
    lines = F.split(t, "\n", -1)
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("double")
    raw = {
        "n_chars": F.length(t).cast("double"),
        "n_words": F.size(words).cast("double"),
        "n_distinct": F.size(F.array_distinct(words)).cast("double"),
        "n_lines": F.size(lines).cast("double"),
        "n_distinct_lines": F.size(F.array_distinct(lines)).cast("double"),
        "n_space": count(r"\s"),
        "n_upper": count(r"\p{Lu}"),
        "n_digit": count("[0-9]"),
        "n_other": count(r"[^\p{L}\s]"),
        "n_symbol": count(r"[#*$%&|<>{}\\^~=@_]"),
        "n_bar": count(r"\|"),
        "n_bang": count("!"),
        "n_stop": count(r"[.?!](?=\s|$)"),
        "n_longest": F.coalesce(F.array_max(F.transform(lines, F.length)), F.lit(0)).cast("double"),
    }
    p = lambda n: F.col(PREFIX + n)
    per = lambda a, b: p(a) / F.greatest(p(b), F.lit(1.0))
    solid = F.greatest(p("n_chars") - p("n_space"), F.lit(1.0))
    ratio = {
        "log_chars": F.log1p(p("n_chars")),
        "log_words": F.log1p(p("n_words")),
        "mean_word": (p("n_chars") - p("n_space")) / F.greatest(p("n_words"), F.lit(1.0)),
        "distinct_words": per("n_distinct", "n_words"),
        "distinct_lines": per("n_distinct_lines", "n_lines"),
        "words_per_line": F.log1p(per("n_words", "n_lines")),
        "upper": p("n_upper") / solid,
        "digit": p("n_digit") / solid,
        "non_letter": p("n_other") / solid,
        "symbol": p("n_symbol") / solid,
        "bars_per_word": per("n_bar", "n_words"),
        "bangs_per_word": per("n_bang", "n_words"),
        "stops_per_word": per("n_stop", "n_words"),
        "longest_line": F.log1p(p("n_longest")),
    }
    one = df.select("*", *[c.alias(PREFIX + n) for n, c in raw.items()])
    return one.select(*df.columns, F.inline(F.array(F.struct(*[ratio[n].alias(PREFIX + n) for n in FEATURES]))))


@dataclass(frozen=True)
class Rule:
    """A conjunction of `feature <= limit` (sign -1) and `feature > limit` (sign +1)."""

    conditions: tuple[tuple[int, int, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, sign, limit in self.conditions:
            out &= x[:, f] > limit if sign > 0 else x[:, f] <= limit
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for f, sign, limit in self.conditions:
            c = F.col(PREFIX + FEATURES[f])
            out = out & (c > F.lit(limit) if sign > 0 else c <= F.lit(limit))
        return out


@dataclass
class RuleModel:
    """An intercept (log odds) and weighted rules."""

    intercept: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def decision(self, x: np.ndarray) -> np.ndarray:
        return self.intercept + sum((w * r.holds(x) for r, w in self.rules), np.zeros(len(x)))

    def column(self) -> Column:
        """The score, 0 to 1, over the columns of `with_features`."""
        z = F.lit(float(self.intercept))
        for rule, w in self.rules:
            z = z + F.when(rule.column(), F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _grow(x: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, use: np.ndarray, depth: int, least: int, path: tuple, out: list, step: np.ndarray, rate: float) -> None:
    """One regression tree by second-order gain; notes each path below the root and adds the leaves to step."""
    best, gs, hs = (1e-6, -1, 0.0), g[rows].sum(), h[rows].sum()
    if depth:
        for f in use:
            if not len(edges[f]):
                continue
            b = np.searchsorted(edges[f], x[rows, f], side="left")
            n = len(edges[f]) + 1
            gl, hl, nl = (np.cumsum(np.bincount(b, weights=w, minlength=n))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
            gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
            gain[(nl < least) | (len(rows) - nl < least)] = -1
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), int(f), float(edges[f][k]))
    if best[1] < 0:
        step[rows] += -rate * gs / (hs + 1)
        return
    _, f, limit = best
    low = x[rows, f] <= limit
    for sign, part in ((-1, rows[low]), (1, rows[~low])):
        here = (*path, (f, sign, limit))
        out.append(here)
        _grow(x, edges, g, h, part, use, depth - 1, least, here, out, step, rate)


def _simplest(path: tuple) -> tuple:
    """The path with one limit for each feature and direction."""
    tight: dict[tuple[int, int], float] = {}
    for f, sign, limit in path:
        old = tight.get((f, sign))
        tight[f, sign] = limit if old is None else (min if sign < 0 else max)(old, limit)
    return tuple(sorted((f, s, v) for (f, s), v in tight.items()))


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, penalty: float = 0.001, seed: int = 7) -> RuleModel:
    """Trees, rules from their paths, and lasso logistic weights: accelerated proximal gradient steps, up to 4000, until
    the conditions of an optimum hold to a twentieth of the penalty."""
    if len(y) == 0:
        return RuleModel()
    prior = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    if y.min() == y.max():
        return RuleModel(prior)
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)[1:-1])) for f in range(x.shape[1])]
    edges = [e[e < x[:, f].max()] for f, e in enumerate(edges)]
    z, paths = np.full(len(y), prior), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        rows = np.flatnonzero(rng.random(len(y)) < 0.7)
        use = rng.permutation(x.shape[1])[: max(3, x.shape[1] * 2 // 3)]
        step = np.zeros(len(y))
        _grow(x, edges, p - y, p * (1 - p), rows, use, depth, max(3, len(y) // 500), (), paths, step, rate)
        z += step
    rules, seen = [], set()
    for path in paths:
        r = Rule(_simplest(path))
        cover = r.holds(x)
        mark = cover.tobytes()
        if 0 < cover.sum() < len(y) and mark not in seen:
            seen.add(mark)
            rules.append((r, cover))
    if not rules:
        return RuleModel(prior)
    m = np.stack([c for _, c in rules], 1).astype(np.float64)
    scale = np.maximum(m.std(0), 0.02)
    m /= scale
    lip = (np.linalg.norm(m, 2) ** 2) / (4 * len(y)) + 0.25
    w, v, b, vb, t = np.zeros(m.shape[1]), np.zeros(m.shape[1]), prior, prior, 1.0
    for turn in range(4000):
        r = 1 / (1 + np.exp(-(m @ v + vb))) - y
        slope, level = m.T @ r / len(y), r.mean()
        if turn % 25 == 0 and abs(level) < 1e-4 and (np.abs(slope + penalty * np.sign(v))[v != 0] < 0.05 * penalty).all() and (np.abs(slope) < 1.05 * penalty).all():
            w, b = v, vb
            break
        nw = v - slope / lip
        nw = np.sign(nw) * np.maximum(np.abs(nw) - penalty / lip, 0)
        nb = vb - level / lip
        # momentum that points uphill is dropped
        t = 1.0 if (v - nw) @ (nw - w) + (vb - nb) * (nb - b) > 0 else t
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return RuleModel(float(b), [(r, float(c)) for (r, _), c in zip(rules, w / scale, strict=True) if abs(c) > 1e-9])


def fit(documents: DataFrame, labels: DataFrame, target: str = "quality", max_rows: int = MAX_TRAIN_ROWS) -> RuleModel:
    """A model from the labelled documents that are not held out: at most max_rows of them, by order of a hash of
    their ids. Only those rows' statistics reach the driver; their ids are broadcast, which max_rows bounds."""
    chosen = (
        labels.select(F.col("doc_id").alias("_tw_id"), F.col(target).cast("double").alias("_tw_y"))
        .where(F.col("_tw_id").isNotNull() & F.col("_tw_y").isNotNull() & ~held_out(F.col("_tw_id")))
        .groupBy("_tw_id")
        .agg(F.when(F.avg("_tw_y") >= 0.5, 1.0).otherwise(0.0).alias("_tw_y"))
        .orderBy(F.xxhash64("_tw_id"), "_tw_id")
        .limit(max_rows)
        .collect()
    )
    if not chosen:
        return RuleModel()
    spark = documents.sparkSession
    picked = F.broadcast(spark.createDataFrame(chosen, f"_tw_id {dict(labels.dtypes)['doc_id']}, _tw_y double"))
    rows = documents.select("doc_id", "text").join(picked, F.col("doc_id") == F.col("_tw_id"))
    # of unlike texts under one id the one with the smallest hash
    one = F.min(F.struct(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.col("_tw_y").alias("y"), F.array(*[PREFIX + n for n in FEATURES]).alias("x")))
    got = with_features(rows).groupBy("doc_id").agg(one.alias("r")).select("doc_id", "r.y", "r.x").collect()
    got = sorted(got, key=lambda r: r[0])
    return fit_rules(np.array([r[2] for r in got], float).reshape(len(got), len(FEATURES)), np.array([r[1] for r in got], float))


def with_score(documents: DataFrame, model: RuleModel, name: str) -> DataFrame:
    """The documents, all columns kept, and the score under the given name."""
    return with_features(documents).select(*documents.columns, model.column().alias(name))


def score_documents(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= threshold) for every document."""
    model = fit(documents, labels, max_rows=max_rows)
    scored = with_score(documents.select("doc_id", "text"), model, "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

"""Stream operators: projection, filtering, alignment, merging, delay and resampling of indexed event streams.

A Stream is a DataFrame with an index column (integer or timestamp), value columns, optional key columns (one series for
each key) and tie-breaking columns that give the order of arrival among equal indices."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.elementwise import num
from ..plans.node import Operator, lower, make, missing
from .kernels import Kernel, kernel


#: Offset strings: seconds of one unit. Calendar units have no fixed length and are refused.
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
UNITS = {"s": 1, "min": 60, "T": 60, "h": 3600, "D": 86400}


class Stream:
    """Events of any number of series, ordered by `ts` and then `seq` within a key."""

    def __init__(self, df: DataFrame, ts: str, values: list[str] | str, key: list[str] | str = (), seq: list[str] | str = ()) -> None:
        listed = lambda x: [x] if isinstance(x, str) else list(x)
        self.ts, self.values, self.key, self.seq = ts, listed(values), listed(key), listed(seq)
        kind = dict(df.dtypes).get(ts)
        if kind is None:
            raise ValueError(f"the frame has no column {ts}")
        if kind in ("double", "float"):
            raise ValueError("a stream's index must be an integer or a timestamp")
        self.kind, self.timed = kind, kind.startswith("timestamp")
        clean = [missing(F.col(v).cast("double")).alias(v) for v in self.values]
        self.df = df.select(*self.key, ts, *[c for c in self.seq if c not in (ts, *self.key)], *clean)

    def micros(self, ts: Column | str) -> Column:
        """An index as a number: itself, or microseconds since 1970. Time zones don't matter to local timestamps."""
        c = F.col(ts) if isinstance(ts, str) else ts
        if not self.timed:
            return c.cast("long")
        return F.unix_micros(c) if self.kind == "timestamp" else ((c - F.expr(EPOCH)).cast("interval second").cast("decimal(20,6)") * 1_000_000).cast("long")

    def index(self, number: Column) -> Column:
        """The inverse of micros."""
        if not self.timed:
            return number.cast(self.kind)
        return F.timestamp_micros(number) if self.kind == "timestamp" else F.expr(EPOCH) + F.make_dt_interval(secs=(number.cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)"))

    @property
    def order(self) -> list[str]:
        return [self.ts, *self.seq]

    def like(self, df: DataFrame, values: list[str] | None = None, seq: list[str] | None = None) -> Stream:
        return Stream(df, self.ts, self.values if values is None else values, self.key, self.seq if seq is None else seq)

    def over(self) -> Window:
        return Window.partitionBy(*self.key).orderBy(*self.order)

    def apply(self, operator: Operator, names: list[str] | None = None) -> Stream:
        """The operator on this stream's columns: all of them as its inputs, or each one by itself where it has one."""
        spec = operator.spec
        if spec.n_in == 1 and len(spec.outputs) == 1:
            outs = {v: operator(v) for v in self.values}
        elif spec.n_in == len(self.values):
            node = operator(*self.values)
            outs = {o or "value": node[i] for i, o in enumerate(spec.outputs)}
        else:
            raise ValueError(f"{spec.name} takes {spec.n_in} inputs, the stream has {len(self.values)} columns")
        if names:
            outs = dict(zip(names, outs.values(), strict=True))
        df = lower(self.df, self.key, self.order, {f"_out_{n}": x for n, x in outs.items()})
        return self.like(df.select(*self.key, *self.order, *[F.col(f"_out_{n}").alias(n) for n in outs]), list(outs))


# -- rows and columns ------------------------------------------------------------------------------------------------


def select(stream: Stream, columns: int | str | list) -> Stream:
    """Some value columns, by number or name."""
    wanted = columns if isinstance(columns, (list, tuple)) else [columns]
    names = []
    for c in wanted:
        if isinstance(c, int):
            if not 0 <= c < len(stream.values):
                raise IndexError(f"no column {c}")
            c = stream.values[c]
        if c not in stream.values:
            raise KeyError(c)
        names.append(c)
    return stream.like(stream.df.select(*stream.key, *stream.order, *names), names)


def dropna(stream: Stream, how: str = "any") -> Stream:
    """Without the rows in which any, or all, values are missing."""
    if how not in ("any", "all"):
        raise ValueError("how must be any or all")
    return stream.like(stream.df.na.drop(how, subset=stream.values))


def delay(stream: Stream, duration: int | float | str) -> Stream:
    """The index moved forward."""
    return stream.like(stream.df.withColumn(stream.ts, shifted(stream, F.col(stream.ts), duration)))


def shifted(stream: Stream, ts: Column, duration: int | float | str) -> Column:
    return stream.index(stream.micros(ts) + F.lit(micros(duration) if stream.timed else int(duration)))


def micros(duration: int | float | str) -> int:
    """A duration in microseconds; numbers are seconds."""
    if isinstance(duration, (int, float)):
        return round(duration * 1_000_000)
    m = re.fullmatch(r"(\d*)\s*([A-Za-z]+)", duration.strip())
    if not m or m[2] not in UNITS:
        raise ValueError(f"{duration!r} is no fixed duration; units are {', '.join(UNITS)}")
    return int(m[1] or 1) * UNITS[m[2]] * 1_000_000


# -- several streams ---------------------------------------------------------------------------------------------------


def _named(streams: list[Stream]) -> list[list[str]]:
    """Output names of each stream's values, with a number where names clash."""
    every = [v for s in streams for v in s.values]
    return [[v if every.count(v) == 1 else f"{v}_{i}" for v in s.values] for i, s in enumerate(streams)]


def merge(*streams: Stream) -> DataFrame:
    """All events in one frame, ordered by key, index, then stream; `source` tells the stream."""
    width = {len(s.values) for s in streams}
    if len(width) != 1:
        raise ValueError("merged streams need the same number of columns")
    first = streams[0]
    parts = []
    for i, s in enumerate(streams):
        parts.append(s.df.select(*[F.col(k).alias(n) for k, n in zip(s.key, first.key, strict=True)], F.col(s.ts).alias(first.ts), F.lit(i).alias("source"), (F.struct(*s.seq) if s.seq else F.struct(F.lit(0))).cast("string").alias("arrival"), *[F.col(v).alias(n) for v, n in zip(s.values, first.values, strict=True)]))
    return reduce(DataFrame.unionByName, parts).orderBy(*first.key, first.ts, "source", "arrival")


def split(merged: DataFrame, n: int) -> list[DataFrame]:
    """The inverse of merge: one frame for each of n sources."""
    top = merged.agg(F.max("source")).first()[0]
    if top is not None and top >= n:
        raise ValueError(f"source {top} needs n over {n}")
    return [merged.where(F.col("source") == i).drop("source", "arrival") for i in range(n)]


def combine_latest(*streams: Stream, emit: str = "when_all") -> Stream:
    """One row for each index of any stream with every stream's latest values at or before it; of events with one
    index the last to arrive counts. when_all waits until every stream has had an event, on_any leaves columns empty. A
    missing value is an event too."""
    if emit not in ("when_all", "on_any"):
        raise ValueError("emit must be when_all or on_any")
    first, names = streams[0], _named(list(streams))
    parts = []
    for i, s in enumerate(streams):
        own = F.struct(*[F.col(v).alias(n) for v, n in zip(s.values, names[i], strict=True)])
        none = [F.lit(None).cast("struct<" + ", ".join(f"`{n}`:double" for n in names[j]) + ">") for j in range(len(streams))]
        at = F.struct(*[F.col(c) for c in s.seq]) if s.seq else F.struct(F.lit(0))
        last = s.df.groupBy(*[F.col(k).alias(n) for k, n in zip(s.key, first.key, strict=True)], F.col(s.ts).alias(first.ts)).agg(F.max_by(own, at).alias("v"))
        parts.append(last.select(*first.key, first.ts, *[(F.col("v") if j == i else none[j]).alias(f"_s{j}") for j in range(len(streams))]))
    rows = reduce(DataFrame.unionByName, parts).groupBy(*first.key, first.ts).agg(*[F.first(f"_s{j}", ignorenulls=True).alias(f"_s{j}") for j in range(len(streams))])
    past = Window.partitionBy(*first.key).orderBy(first.ts).rowsBetween(Window.unboundedPreceding, 0)
    held = rows.select(*first.key, first.ts, *[F.last(f"_s{j}", ignorenulls=True).over(past).alias(f"_s{j}") for j in range(len(streams))])
    if emit == "when_all":
        held = held.where(reduce(lambda a, b: a & b, [F.col(f"_s{j}").isNotNull() for j in range(len(streams))]))
    flat = [n for group in names for n in group]
    return Stream(held.select(*first.key, first.ts, *[F.col(f"_s{j}.{n}").alias(n) for j, group in enumerate(names) for n in group]), first.ts, flat, first.key)


def zip_streams(*streams: Stream) -> Stream:
    """Positional streams side by side; they must be of equal length in every series."""
    first, names = streams[0], _named(list(streams))
    parts = []
    for i, s in enumerate(streams):
        n = F.row_number().over(s.over()) - 1
        parts.append(s.df.select(*[F.col(k).alias(x) for k, x in zip(s.key, first.key, strict=True)], n.cast("long").alias(first.ts), *[F.col(v).alias(x) for v, x in zip(s.values, names[i], strict=True)]))
    on = [*first.key, first.ts]
    sizes = [p.groupBy(*first.key).count().withColumnRenamed("count", f"_n{i}") if first.key else p.agg(F.count(F.lit(1)).alias(f"_n{i}")) for i, p in enumerate(parts)]
    if first.key:
        both = reduce(lambda a, b: a.join(b, first.key, "full"), sizes)
        uneven = reduce(lambda a, b: a | b, [~F.col("_n0").eqNullSafe(F.col(f"_n{i}")) for i in range(1, len(parts))], F.lit(False))
        bad = not both.where(uneven).isEmpty()
    else:
        bad = len({s.first()[0] for s in sizes}) > 1
    if bad:
        raise ValueError("positional streams must be of equal length")
    return Stream(reduce(lambda a, b: a.join(b, on), parts), first.ts, [n for g in names for n in g], first.key)


def filter_by(data: Stream, mask: Stream) -> Stream:
    """The data where the mask, aligned as of each index, is there and not zero. A missing data value passes."""
    if len(mask.values) != 1:
        raise ValueError("a mask has one column")
    m = Stream(mask.df.withColumnRenamed(mask.values[0], "_tw_mask"), mask.ts, ["_tw_mask"], mask.key, mask.seq)
    both = combine_latest(data, m)
    return both.like(both.df.where(F.col("_tw_mask").isNotNull() & (F.col("_tw_mask") != 0)).drop("_tw_mask"), data.values)


# -- resampling ---------------------------------------------------------------------------------------------------------


@kernel("_ThresholdBars", threshold=1.0)
class ThresholdBars(Kernel):
    """The number of the bar a row belongs to; a bar closes once the driver's sum reaches the threshold."""

    sparse = True

    def __init__(self, threshold):
        self.threshold, self.total, self.bar = threshold, 0.0, 0

    def step(self, x):
        now = self.bar
        if x == x:
            self.total += x
            if self.total >= self.threshold:
                self.bar, self.total = now + 1, 0.0
        return float(now)


SIMPLE = ("first", "last", "min", "max", "mean", "sum", "count", "open", "high", "low", "close", "std", "var", "prod", "skew", "kurt")



def _group_moment(fn, value: Column, n: Column, kind: str) -> Column:
    g = fn(value)
    if kind == "skew":
        return F.when((n >= 3) & ~F.isnan(g), g * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2))
    return F.when((n >= 4) & ~F.isnan(g), (n - 1) / F.when(n > 3, (n - 2) * (n - 3)) * ((n + 1) * g + 6))


def _simple(agg: str, v: Column, at: Column) -> Column:
    seen = F.when(v.isNotNull(), at)
    n = F.count(v).cast("double")
    return {
        "first": lambda: F.min_by(v, seen), "open": lambda: F.min_by(v, seen), "last": lambda: F.max_by(v, seen), "close": lambda: F.max_by(v, seen),
        "min": lambda: F.min(v), "low": lambda: F.min(v), "max": lambda: F.max(v), "high": lambda: F.max(v), "mean": lambda: F.avg(v),
        "sum": lambda: F.coalesce(F.sum(v), num(0)), "count": lambda: n, "std": lambda: F.stddev_samp(v), "var": lambda: F.var_samp(v), "prod": lambda: F.product(v),
        "skew": lambda: _group_moment(F.skewness, v, n, "skew"), "kurt": lambda: _group_moment(F.kurtosis, v, n, "kurt"),
    }[agg]()


def _aggregates(stream: Stream, agg: str, at: Column) -> dict[str, Column]:
    v = [F.col(c) for c in stream.values]
    bar = lambda c: {n: _simple(n, c, at) for n in ("open", "high", "low", "close")}
    if agg in SIMPLE:
        return {c: _simple(agg, F.col(c), at) for c in stream.values}
    need = {"ohlc": 1, "ohlcv": 2, "ohlcv2": 2, "ohlc_bars": 4}
    if agg in need and len(v) != need[agg]:
        raise ValueError(f"{agg} needs {need[agg]} columns")
    if agg == "ohlc":
        return bar(v[0])
    if agg == "ohlcv":
        return {**bar(v[0]), "volume": _simple("sum", v[1], at)}
    if agg == "ohlcv2":
        return {**bar(v[0]), "buy_volume": F.coalesce(F.sum(F.when(v[1] > 0, v[1])), num(0)), "sell_volume": F.coalesce(F.sum(F.when(v[1] < 0, -v[1])), num(0))}
    if agg in ("ohlc_bars", "ohlcv_bars"):
        if agg == "ohlcv_bars" and len(v) < 5:
            raise ValueError("ohlcv_bars needs at least 5 columns")
        rules = ["first", "max", "min", "last", *["sum"] * (len(v) - 4)]
        return {c: _simple(r, F.col(c), at) for c, r in zip(stream.values, rules, strict=True)}
    raise ValueError(f"no aggregate {agg}")


def resample(stream: Stream, agg: str | Operator = "last", *, freq=None, every=None, count: int | None = None, threshold: float | None = None, driver: str | None = None, clock: Stream | None = None, origin=0, label: str = "left", fill: str = "skip", max_age=None) -> Stream:
    """Bars of a stream. Exactly one of: freq or every (buckets of the index), count (of events), threshold (of the
    driver column's running sum), clock (the events up to each tick of another stream).

    fill says what becomes of empty buckets between others: skip, nan, or carry (the row before, whole). max_age, with
    clock, last and carry, empties values whose last observation is older."""
    modes = [m for m in (freq, every, count, threshold, clock) if m is not None]
    if len(modes) != 1:
        raise ValueError("give exactly one of freq, every, count, threshold, clock")
    if label not in ("left", "right") or fill not in ("skip", "nan", "carry"):
        raise ValueError("label must be left or right, fill skip, nan or carry")
    if isinstance(agg, dict):
        raise TypeError("one aggregate for each call; join the results")
    if max_age is not None and (clock is None or agg != "last" or fill != "carry"):
        raise ValueError("max_age goes with clock, agg='last' and fill='carry'")
    if isinstance(agg, Operator) and (clock is not None or threshold is not None):
        raise ValueError("an operator as aggregate goes with freq, every or count")
    s, rows = stream, stream.df
    at = F.struct(*s.order)
    if clock is not None:
        return _by_clock(s, agg, clock, fill, max_age)
    if threshold is not None:
        if isinstance(agg, str) and agg not in SIMPLE and agg not in ("ohlc",):
            raise ValueError("threshold bars take single-column aggregates")
        d = driver or s.values[-1]
        rows = lower(rows, s.key, s.order, {"_tw_bar": make("_ThresholdBars", float(threshold))(d)})
        if driver in s.values and len(s.values) > 1:
            s = Stream(rows, s.ts, [v for v in s.values if v != driver], s.key, s.seq)
    elif count is not None:
        rows = rows.withColumn("_tw_bar", F.floor((F.row_number().over(s.over()) - 1) / count))
    else:
        width = freq if freq is not None else every
        step = micros(width) if s.timed else int(width)
        zero = origin if not s.timed else micros(origin) if isinstance(origin, (int, float, str)) else int(origin.timestamp() * 1_000_000)
        rows = rows.withColumn("_tw_bar", F.floor((s.micros(s.ts) - F.lit(zero)) / F.lit(step)).cast("long"))
    group = [*s.key, "_tw_bar"]
    if isinstance(agg, Operator):
        outs = [o or "value" for o in agg.spec.outputs]
        node = agg(s.values[0])
        full = lower(rows, group, s.order, {f"_out_{o}": node[i] for i, o in enumerate(outs)})
        bars = full.groupBy(*group).agg(F.min(s.ts).alias("_tw_first"), F.max(s.ts).alias("_tw_last"), *[F.max_by(f"_out_{o}", F.when(F.col(s.values[0]).isNotNull(), at)).alias(o) for o in outs])
        names = outs
    else:
        cols = _aggregates(s, agg, at)
        names = list(cols)
        bars = rows.groupBy(*group).agg(F.min(s.ts).alias("_tw_first"), F.max(s.ts).alias("_tw_last"), *[c.alias(f"_out_{n}") for n, c in cols.items()])
        bars = bars.select(*group, "_tw_first", "_tw_last", *[F.col(f"_out_{n}").alias(n) for n in names])
    if count is not None or threshold is not None:
        return Stream(bars.select(*s.key, F.col("_tw_first" if label == "left" else "_tw_last").alias(s.ts), *names, "_tw_bar"), s.ts, names, s.key, ["_tw_bar"])
    bars = _filled(bars.drop("_tw_first", "_tw_last"), s.key, names, fill)
    edge = (F.col("_tw_bar") + F.lit(int(label == "right"))) * F.lit(step) + F.lit(zero)
    return Stream(bars.select(*s.key, s.index(edge).alias(s.ts), *names), s.ts, names, s.key)


def _filled(bars: DataFrame, key: list[str], names: list[str], fill: str) -> DataFrame:
    """With rows for the empty buckets between a series' first and last one. A bucket knows the next one, so that the
    gaps are made where they are, without a join."""
    if fill == "skip":
        return bars
    nxt = F.lead("_tw_bar").over(Window.partitionBy(*key).orderBy("_tw_bar"))
    wide = bars.withColumn("_tw_to", F.coalesce(nxt - 1, F.col("_tw_bar"))).withColumn("_tw_at", F.explode(F.sequence("_tw_bar", "_tw_to")))
    keep = F.lit(True) if fill == "carry" else F.col("_tw_at") == F.col("_tw_bar")
    return wide.select(*key, F.col("_tw_at").alias("_tw_bar"), *[F.when(keep, F.col(n)).alias(n) for n in names])


def _by_clock(s: Stream, agg: str, clock: Stream, fill: str, max_age) -> Stream:
    """At each tick the aggregate of the events after the tick before, those at the tick's own index included."""
    at = F.struct(*s.order)
    ticks = clock.df.select(*[F.col(k).alias(n) for k, n in zip(clock.key, s.key, strict=True)], F.col(clock.ts).alias(s.ts)).distinct()
    events = s.df.select("*", F.lit(0).alias("_tw_tick"))
    marks = ticks.select("*", F.lit(1).alias("_tw_tick"))
    both = events.unionByName(marks, allowMissingColumns=True)
    # of equal indices events come before the tick
    ahead = Window.partitionBy(*s.key).orderBy(F.col(s.ts).desc(), F.col("_tw_tick").desc()).rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("_tw_to", F.last(F.when(F.col("_tw_tick") == 1, F.col(s.ts)), ignorenulls=True).over(ahead)).where("_tw_tick = 0 and _tw_to is not null")
    cols = _aggregates(s, agg, at)
    names = list(cols)
    seen = reduce(lambda a, b: a | b, [F.col(v).isNotNull() for v in s.values])
    found = placed.groupBy(*s.key, F.col("_tw_to").alias(s.ts)).agg(F.count(F.when(seen, 1)).alias("_tw_n"), F.max(F.when(seen, F.col(s.ts))).alias("_tw_seen"), *[c.alias(f"_out_{n}") for n, c in cols.items()])
    rows = ticks.join(found, [*s.key, s.ts], "left").withColumn("_tw_has", F.coalesce(F.col("_tw_n") > 0, F.lit(False)))
    row = F.struct("_tw_seen", *[F.col(f"_out_{n}").alias(n) for n in names])
    if fill == "skip":
        rows = rows.where("_tw_has").select(*s.key, s.ts, row.alias("_tw_row"))
    elif fill == "nan":
        rows = rows.select(*s.key, s.ts, F.when(F.col("_tw_has"), row).alias("_tw_row"))
    else:
        past = Window.partitionBy(*s.key).orderBy(s.ts).rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.select(*s.key, s.ts, F.last(F.when(F.col("_tw_has"), row), ignorenulls=True).over(past).alias("_tw_row"))
    young = F.lit(True)
    if max_age is not None:
        age = s.micros(s.ts) - s.micros("_tw_row._tw_seen")
        young = age <= (micros(max_age) if s.timed else int(max_age))
    return Stream(rows.select(*s.key, s.ts, *[F.when(young, F.col(f"_tw_row.{n}")).alias(n) for n in names]), s.ts, names, s.key)


def forecast_pairs(x: Stream, y: Stream, *, count: int | None = None, duration=None, drop: bool = False) -> Stream:
    """Features beside a later target: x from `count` rows before (streams of one index), or x as it was `duration`
    before each event of y."""
    if (count is None) == (duration is None):
        raise ValueError("give exactly one of count and duration")
    if count is not None:
        both = zip_streams(x.apply(make("Lag", count)), y) if x.df is not y.df else None
        out = both if both is not None else combine_latest(x.apply(make("Lag", count)), y)
    else:
        past = resample(delay(x, duration), "last", clock=y, fill="carry")
        out = combine_latest(past, y)
    return dropna(out) if drop else out

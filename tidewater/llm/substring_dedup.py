"""Near-duplicate passages by compact windows.

The tokens of a text are its five-word shingles. For one hash function, all subsequences whose smallest hash is that of
the shingle at c form a compact window (l, c, r): they start in l..c and end in c..r, where l and r follow from the
Cartesian tree over the hashes (the next smaller ones to each side). Only windows that hold a subsequence of LEAST
shingles are kept: about 2n / LEAST for each of the HASHES functions, found by a sliding minimum.

Two texts with a passage in common have windows with the same smallest hash around it. Windows are grouped by that
hash: each group names the document with the smallest id as its representative, by an aggregate that is combined before
it shuffles, and every other window is linked to it, so a passage in many documents gives one link for each window,
never all pairs. Along a document an interval join then looks for places that windows of at least NEEDED functions
cover together; their links are candidates. Last, the candidates are verified on the texts: shingles of the document
that its representative has too are runs of hits, and passages of at least LEAST shingles, with the share of common
shingles in both sides' passages at SIMILARITY or more, are returned.

A representative may hold a hash for another reason than the passage (a line that many texts have), and then hides what
the others have in common. So the hashes under which some document shares no passage with the representative are
looked at again: where the windows of all functions around a run of LEAST shingles have such hashes, the run itself is
the key of a second grouping. Equal runs are equal for all their holders, so there any representative will do: no passage
of 50 equal words is lost, whatever else its words occur in.

Passages with edits are nowhere equal for so long, but an edited word takes four or five shingles and a share of 0.8 leaves
one edit to 46, so some SHORT shingles in a row are equal. Around places where NEEDED functions have hashes as above, these
short runs are the keys of a third grouping without representatives: holders that no verified passage joins yet are
looked up in an index of their surroundings' shingles, and those with enough in common are compared, those with most in
common first, until all that is alike is joined, whoever else holds the run; a forest of links leaves the group. Holders
with equal surroundings count once, as the second grouping joins them.

Defined cases: null and empty texts, and texts under LEAST shingles, have no passages; passages repeated only within
one document are not reported; rows that repeat a doc_id are one document, whose passages are
those of any of its texts (as a representative the smallest text stands for it); rows
with a null doc_id are left out, as no result could name them; further columns are ignored; equal hashes of a shingle
repeated in a text resolve to the leftmost."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import SPACE, chunks, gram_hashes, lower_ascii, mix64, span_hashes, text_buffer, word_spans
from .storage import cut, release, settled

SHINGLE = 5
#: Shingles of the shortest passage: 50 words.
LEAST = 46
HASHES = 4  # at most four: places keep the function in two bits
NEEDED = 2
SIMILARITY = 0.8
#: Shingles in a row that a passage with edits keeps at the least, 20, hold a chosen run: the least hash of PICK in a row.
SHORT, PICK = 12, 9
#: A run that ends so many shingles beside a verified passage belongs to it: a passage of its own needs more.
BESIDE = 24
#: Shingles that a passage shares at the least, within as many as LEAST to both sides of one of its runs.
ENOUGH = 36
#: A shingle with more holders in one group is compared by patterns, not by pairs of its holders.
FREQUENT = 32
#: Groups of so many members are compared member by member.
FEW = 16
#: Documents that one verification task group compares with one representative.
VERIFY_GROUP = 256
_SEEDS = mix64(np.arange(101, 101 + HASHES, dtype=np.uint64))


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles, A-Z lower-cased, and the row of each."""
    low = lower_ascii(data)
    starts, ends, rows = word_spans(~SPACE[low], offsets)
    h, first = gram_hashes(span_hashes(low, starts, ends), rows, SHINGLE)
    return h, rows[first]


def compact_windows(hashes: np.ndarray, rows: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r), r inclusive, as places in `hashes`: the windows of at least `least` shingles within a row. The
    smallest of equal hashes is the leftmost."""
    n = len(hashes)
    none = np.zeros(0, np.int64)
    if n < least:
        return none, none, none
    bits = max(1, int(n).bit_length())
    # the value's high bits with its place below: one minimum gives both
    packed = (hashes >> np.uint64(bits) << np.uint64(bits)) | np.arange(n, dtype=np.uint64)
    low, span = packed, 1
    while span * 2 <= least:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < least:
        low = np.minimum(low[: n - least + 1], low[least - span : least - span + n - least + 1])
    inside = rows[: n - least + 1] == rows[least - 1 :]
    places = (low[inside] & np.uint64((1 << bits) - 1)).astype(np.int64)
    if not len(places):
        return none, none, none
    keep = np.ones(len(places), bool)
    keep[1:] = places[1:] != places[:-1]
    c = places[keep]  # in order: a sliding minimum's place never moves back within a row
    # all next smaller values of a kept place are kept places themselves or the row's end. Each row's stand between bounds
    # that are less than all
    new = np.ones(len(c), bool)
    new[1:] = rows[c[1:]] != rows[c[:-1]]
    number = np.cumsum(new)
    first, end = (np.searchsorted(rows, rows[c[new]], side=side)[number - 1] for side in ("left", "right"))
    spot = np.arange(len(c)) + number
    value, place = np.zeros(spot[-1] + 2, np.uint64), np.full(spot[-1] + 2, -1)
    value[spot], place[spot] = packed[c], c
    before = place[_smaller_before(value, spot)[spot]]
    after = place[len(value) - 1 - _smaller_before(value[::-1], len(value) - 1 - spot[::-1])[::-1][spot]]
    return np.where(before < 0, first, before + 1), c, np.where(after < 0, end, after) - 1


def _smaller_before(value: np.ndarray, spot: np.ndarray, rounds: int = 24) -> np.ndarray:
    """For each of the ascending places `spot` the last place before it with a smaller value, or the bound before it: the
    values are distinct, and all other places are bounds."""
    near = np.arange(-1, len(value) - 1)
    todo = spot[value[spot - 1] > value[spot]]
    for _ in range(rounds):  # what lies between a place and its pointer is greater; for hashes few rounds leave nothing
        if not len(todo):
            return near
        near[todo] = near[near[todo]]
        todo = todo[value[near[todo]] > value[todo]]
    # ascending runs of equal shingles: one after another, along pointers that are settled
    v, to = value.tolist(), near.tolist()
    for i in todo.tolist():
        j = to[i]
        while v[j] > v[i]:
            j = to[j]
        to[i] = j
    return np.array(to)


def _ranges(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ..., `length` of them, for each range, one range after another."""
    return np.arange(length.sum()) + np.repeat(first - np.cumsum(length) + length, length)


def _listed(column: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
    """The row of each struct in a column of lists of structs, and their fields."""
    return np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), column.flatten().flatten()


def _whole(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches cut anew, so that rows of equal keys stay together, and where each key's rows begin, with the end."""

    def cuts(column: pa.Array) -> np.ndarray:
        return np.flatnonzero(pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)) + 1

    def out() -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(held).combine_chunks()
        return table, np.concatenate([[0], cuts(table.column(key).combine_chunks()), [table.num_rows]])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        inside = cuts(batch.column(key))
        last = int(inside[-1]) if len(inside) else 0
        if last:
            held.append(batch.slice(0, last))
        if held and (last or held[-1].column(key)[-1] != batch.column(key)[0]):
            yield out()
            held = []
        held.append(batch.slice(last))
    if held:
        yield out()


def windows(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """(key, doc_id, place): the compact windows of each document for each hash function; place holds l, the function
    and r, in shingles, as l << 34 | f << 32 | r."""

    def cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                h, rows = shingles(*text_buffer(part.column("text")))
                base = np.searchsorted(rows, np.arange(part.num_rows), side="left")
                got = []
                for f, seed in enumerate(_SEEDS):
                    values = mix64(h ^ seed)
                    le, c, r = compact_windows(values, rows, least)
                    row = rows[c]
                    got.append((values[c].view(np.int64), row, (le - base[row]) << 34 | f << 32 | (r - base[row])))
                key, row, place = (np.concatenate(x) for x in zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(key), part.column("doc_id").take(pa.array(row)), pa.array(place)], ["key", "doc_id", "place"])

    return documents.select("doc_id", "text").mapInArrow(cutting, f"key long, doc_id {dict(documents.dtypes)['doc_id']}, place long")


def shared_windows(found: DataFrame) -> DataFrame:
    """(key, doc_id, place, rep): the windows whose hash several documents have, and the smallest of these."""
    shared = found.groupBy("key").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("most")).where("rep <> most").select("key", "rep")
    return found.join(cut(shared), "key")


def candidates(held: DataFrame, needed: int = NEEDED, least: int = LEAST) -> DataFrame:
    """(doc_id, rep, lo, hi): documents and representatives whose windows share hashes around one place, and the
    stretch of the document's shingles, end inclusive, that those windows cover: a common passage lies within."""
    links = held.where("doc_id <> rep").select("doc_id", "rep", "place")
    kind = dict(held.dtypes)["doc_id"]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole(batches, "doc_id"):
            lo, hi, f = _span(table.column("place").to_numpy())
            _, count, opens, closes = _cover(np.repeat(np.arange(len(starts) - 1), np.diff(starts)), lo, hi, f, least)
            dense = np.concatenate([[0], np.cumsum(count >= needed)])
            use = np.flatnonzero(dense[closes] > dense[opens])
            some = table.select(["doc_id", "rep"]).take(pa.array(use)).append_column("lo", pa.array(lo[use], pa.int32())).append_column("hi", pa.array(hi[use], pa.int32()))
            got = some.group_by(["doc_id", "rep"], use_threads=False).aggregate([("lo", "min"), ("hi", "max")])
            yield from got.select(["doc_id", "rep", "lo_min", "hi_max"]).rename_columns(["doc_id", "rep", "lo", "hi"]).to_batches()

    return links.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(joined, f"doc_id {kind}, rep {kind}, lo int, hi int")


def _span(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last shingle and the function of packed places."""
    return place >> 34, place & 0xFFFFFFFF, place >> 32 & 3


def _cover(of: np.ndarray, lo: np.ndarray, hi: np.ndarray, f: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Along numbered documents, the places (of << 33 | place) where windows begin or cease to hold a run of `least`
    shingles that begins there; of how many functions windows do from each on; and each window's first of these places and
    the one behind its last, by number."""
    n = len(of)
    at, to = np.unique(np.concatenate([of << 33 | lo, of << 33 | (hi - least + 2)]), return_inverse=True)
    count = np.zeros(len(at), np.int64)
    for k in range(HASHES):
        own = f == k
        count += np.cumsum(np.bincount(to[:n][own], minlength=len(at)) - np.bincount(to[n:][own], minlength=len(at))) > 0
    return at, count, to[:n], to[n:]


def unresolved(held: DataFrame, verified: DataFrame, needed: int = NEEDED, least: int = LEAST) -> DataFrame:
    """(doc_id, lo, hi, whole): stretches of shingles, end inclusive, in each run of which the windows of all functions
    (whole) or of at least `needed` (not whole) have a hash that some document has without sharing a passage with the
    representative there."""
    place = F.col("place")
    rows = held.where("doc_id <> rep").select("key", "doc_id", "rep", F.shiftright(place, 34).alias("l"), place.bitwiseAND(F.lit(0xFFFFFFFF)).alias("r"))
    v = verified.select(F.col("doc_id").alias("d"), F.col("rep_id").alias("p"), "start", (F.col("end") - SHINGLE).alias("stop"))
    there = (rows["doc_id"] == v["d"]) & (rows["rep"] == v["p"]) & (F.least("r", "stop") - F.greatest("l", "start") >= least - 1)
    keys = cut(rows.join(v, there, "left_anti").select("key").distinct())
    kind = dict(held.dtypes)["doc_id"]

    def stretched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole(batches, "doc_id"):
            lo, hi, f = _span(table.column("place").to_numpy())
            at, count, *_ = _cover(np.repeat(np.arange(len(starts) - 1), np.diff(starts)), lo, hi, f, least)
            ids = table.column("doc_id").combine_chunks()
            for whole, least_count in ((True, HASHES), (False, needed)):
                # a document's last place is covered by nothing
                edge = np.flatnonzero(np.diff(np.concatenate([[0], count >= least_count])))
                a, b = at[edge[::2]], at[edge[1::2]]
                cols = [ids.take(pa.array(starts[a >> 33])), pa.array(a & (1 << 33) - 1, pa.int32()), pa.array((b & (1 << 33) - 1) + least - 2, pa.int32()), pa.array(np.full(len(a), whole))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "lo", "hi", "whole"])

    rest = held.select("key", "doc_id", "place").join(keys, "key").select("doc_id", "place")
    return rest.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(stretched, f"doc_id {kind}, lo int, hi int, whole boolean")


def run_hashes(h: np.ndarray, least: int = LEAST) -> np.ndarray:
    """The hash of each run of `least` values, from hashes of runs of powers of two."""
    out, done, power, span = None, 0, h, 1
    while done < least:
        if least - done & span:
            part = power[done : len(h) - least + done + 1]
            out = part if out is None else mix64(out) + part * np.uint64(2 * span + 1)
            done += span
        power, span = mix64(power[:-span]) + power[span:], 2 * span
    return mix64(out)


def run_candidates(documents: DataFrame, stretches: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, rep, lo, hi) of documents with a run in these stretches that an earlier document has too."""
    kind = dict(documents.dtypes)["doc_id"]
    of = stretches.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("stretches"))

    def cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch, "text"):
                h, rows = shingles(*text_buffer(piece.column("text")))
                edge = np.searchsorted(rows, np.arange(piece.num_rows + 1), side="left")
                of_row, (lo, hi) = _listed(piece.column("stretches"))
                lo, hi = lo.to_numpy().astype(np.int64), hi.to_numpy().astype(np.int64)
                length = np.minimum(hi + 1, np.diff(edge)[of_row]) - lo
                use = length >= least  # another text under the same id may be shorter
                of_row, lo, length = of_row[use], lo[use], length[use]
                if len(lo):
                    runs = run_hashes(h[_ranges(edge[of_row] + lo, length)], least)
                    within = _ranges(np.cumsum(length) - length, length - least + 1)
                    at = _ranges(lo, length - least + 1)
                    ids = piece.column("doc_id").take(pa.array(np.repeat(of_row, length - least + 1)))
                    yield pa.RecordBatch.from_arrays([pa.array(runs[within].view(np.int64)), ids, pa.array(at, pa.int32())], ["run", "doc_id", "at"])

    runs = settled(documents.select("doc_id", "text").join(of, "doc_id").select("doc_id", "stretches", "text").mapInArrow(cutting, f"run long, doc_id {kind}, at int"), "runs")
    shared = cut(runs.groupBy("run").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("most")).where("rep <> most").select("run", "rep"))
    return runs.join(shared, "run").where("doc_id <> rep").groupBy("doc_id", "rep").agg(F.min("at").alias("lo"), (F.max("at") + least - 1).cast("int").alias("hi"))


def short_runs(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of chosen runs of SHORT shingles and their hashes: each that is the least of PICK in a row, within a
    row's text."""
    reach = SHORT + PICK - 2
    if len(h) <= reach:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    runs = run_hashes(h, SHORT)
    n = len(h) - reach
    low = runs[:n].copy()
    for k in range(1, PICK):
        np.minimum(low, runs[k : k + n], out=low)
    inside = rows[:n] == rows[reach:]
    chosen = np.zeros(len(runs), bool)
    for k in range(PICK):
        chosen[k : k + n] |= inside & (low == runs[k : k + n])
    at = np.flatnonzero(chosen)
    return at, runs[at]


def surrounded(row: np.ndarray, run: np.ndarray, home: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of a run, begin, size, more): the surroundings to compare, LEAST shingles to both sides of a run. Runs of one hash and
    home in a row, each of which overlaps the next, are a chain: a pattern of at most SHORT shingles said again and again. A
    passage with a run of the chain holds its first or its last, or lies within it: so these two have surroundings, and
    what a chain of LEAST shingles or more consists of is compared by itself; for these, more is by how much the chain goes
    on behind, and else -1."""
    order = np.lexsort((at, run, row))
    r, h, o, p = (x[order] for x in (row, run, home, at))
    on = np.concatenate([[False], (r[1:] == r[:-1]) & (h[1:] == h[:-1]) & (o[1:] == o[:-1]) & (p[1:] - p[:-1] <= SHORT), [False]])
    first, last = (np.flatnonzero(~x[: len(at)]) for x in (on, on[1:]))
    long = p[last] - p[first] + SHORT >= LEAST
    ends = np.union1d(first, last)
    begin = np.concatenate([p[ends] - LEAST, p[first[long]]])
    whole = (p[last] - p[first] + SHORT)[long]
    size = np.concatenate([np.full(len(ends), SHORT + 2 * LEAST), np.minimum(whole, SHORT + 2 * LEAST)])
    return order[np.concatenate([ends, first[long]])], begin, size, np.concatenate([np.full(len(ends), -1), whole - size[len(ends) :]])


def alike(near: list[np.ndarray], whole: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i < j, of sets of shingles that have enough in common and unlike homes, most in common first. `whole` is false for surroundings
    that repeat shingles: of these a share is enough. Sets that share enough frequent shingles only are compared once
    for each pattern of frequent shingles; sets of one pattern are joined to its first."""
    n, size = len(near), np.array([len(x) for x in near])
    enough = np.where(whole, ENOUGH, (size * ENOUGH) // (SHORT + 2 * LEAST)).astype(np.int64)
    if n <= FEW:
        sets = [set(x.tolist()) for x in near]
        got = [(-len(sets[i] & sets[j]), i, j) for j in range(n) for i in range(j) if home[i] != home[j]]
        got = sorted(p for p in got if -p[0] >= min(enough[p[1]], enough[p[2]]))
        return np.array([p[1] for p in got], np.int64), np.array([p[2] for p in got], np.int64)
    who = np.repeat(np.arange(n), size)
    _, col, holders = np.unique(np.concatenate(near), return_inverse=True, return_counts=True)
    often = holders[col] > FREQUENT
    # the members' frequent shingles, as ascending codes: a table of members by shingles would grow with both
    stride, item = len(holders), col[often]
    has = who[often] * stride + item
    edge = np.searchsorted(has, np.arange(n + 1) * stride)
    count = np.diff(edge)
    # pairs of holders of the other shingles, with the number that they share
    rare = ~often & (holders[col] > 1)
    order = np.argsort(col[rare], kind="stable")
    c, w = col[rare][order], who[rare][order]
    codes = [np.zeros(0, np.int64)]
    for k in range(1, FREQUENT):
        same = np.flatnonzero((c[k:] == c[:-k]) & (home[w[k:]] != home[w[:-k]]))
        codes.append(w[same] * n + w[same + k])
    pairs, shared = np.unique(np.concatenate(codes), return_counts=True)
    found = []
    for at in range(0, len(pairs), 1 << 13):
        i, j = pairs[at : at + (1 << 13)] // n, pairs[at : at + (1 << 13)] % n
        total = shared[at : at + (1 << 13)].copy()
        if len(has):
            of = np.repeat(np.arange(len(i)), count[i])
            wanted = item[_ranges(edge[i], count[i])] + j[of] * stride
            total += np.bincount(of[has[np.minimum(np.searchsorted(has, wanted), len(has) - 1)] == wanted], minlength=len(i))
        ok = total >= np.minimum(enough[i], enough[j])
        found.append((pairs[at : at + (1 << 13)][ok], total[ok]))
    # pairs by frequent shingles alone
    known: dict[bytes, int] = {}
    lead = np.array([known.setdefault(item[a:b].tobytes(), k) for k, (a, b) in enumerate(zip(edge.tolist(), edge[1:].tolist(), strict=False))])
    i = np.flatnonzero((home != home[lead]) & (count >= np.minimum(enough, enough[lead])))
    found.append((np.minimum(i, lead[i]) * n + np.maximum(i, lead[i]), count[i]))
    least = np.full(n, ENOUGH)
    np.minimum.at(least, lead, enough)
    first = np.array(list(known.values()))
    first = first[count[first] >= least[first]]
    found += _by_frequent(first, home[first], least[first], count[first], item[_ranges(edge[first], count[first])], n)
    codes, total = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    order = np.lexsort((codes, -total))
    _, at = np.unique(codes[order], return_index=True)  # the pair's first, with the most in common
    pairs = codes[order[np.sort(at)]]
    return pairs // n, pairs % n


def _by_frequent(member: np.ndarray, home: np.ndarray, least: np.ndarray, count: np.ndarray, item: np.ndarray, n: int, room: int = 1 << 21) -> list[tuple[np.ndarray, np.ndarray]]:
    """Codes of pairs of these members with unlike homes that share as many of their items as the lesser `least`, and how
    many they share. One of any two such is not of the largest home: only those look up the holders of their items, so many
    at a time that `room` counts hold what they find."""
    size, out = len(member), []
    if not len(item):
        return out
    of = np.repeat(np.arange(size), count)
    order = np.argsort(item, kind="stable")
    holder, start = of[order], np.searchsorted(item[order], np.arange(int(item.max()) + 2))
    values, number = np.unique(home, return_counts=True)
    rows = np.flatnonzero(home != values[number.argmax()])
    edge = np.concatenate([[0], np.cumsum(count)])
    reach = np.concatenate([[0], np.cumsum(start[item + 1] - start[item])])
    cost = np.cumsum(np.maximum(reach[edge[rows + 1]] - reach[edge[rows]], size))
    for block in np.split(rows, np.flatnonzero(np.diff(cost // room)) + 1) if len(rows) else []:
        mine = _ranges(edge[block], count[block])
        local = np.repeat(np.arange(len(block)), count[block])
        length = start[item[mine] + 1] - start[item[mine]]
        common = np.bincount(np.repeat(local, length) * size + holder[_ranges(start[item[mine]], length)], minlength=len(block) * size).reshape(len(block), size)
        i, j = np.nonzero((common >= np.minimum(least[block, None], least)) & (home[block, None] != home))
        x, y = member[block[i]], member[j]
        out.append((np.minimum(x, y) * n + np.maximum(x, y), common[i, j]))
    return out


def numbered(raw: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, int]:
    """Shingles by number: those of each member in order, filled up with a number that none has; the set of each; all
    members' sets in one ascending array, as member * stride + number; and the stride."""
    size = np.array([len(x) for x in raw])
    who = np.repeat(np.arange(len(raw)), size)
    values, number = np.unique(np.concatenate(raw), return_inverse=True)
    stride = len(values) + 1
    grid = np.full((len(raw), int(size.max())), stride - 1)
    grid[who, _ranges(np.zeros(len(raw), np.int64), size)] = number
    known = np.unique(who * stride + number)
    edge = np.searchsorted(known, np.arange(len(raw) + 1) * stride).tolist()
    return grid, [known[a:b] - k * stride for k, (a, b) in enumerate(zip(edge, edge[1:], strict=False))], known, stride


def promising(grid: np.ndarray, known: np.ndarray, stride: int, whole: np.ndarray, i: np.ndarray, j: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Whether `passages` may find anything of member j in member i. Where j repeats no shingle, a passage has at least
    `least` shingles and a share of SIMILARITY of them stands in i: a stretch with four hits or more to each miss. Elsewhere
    so many of its shingles as `passages` asks for at the least."""
    ok = np.zeros(len(i), bool)
    width = grid.shape[1]
    if width < least:
        return ~whole[j]
    for at in range(0, len(i), 4096):
        wanted = grid[j[at : at + 4096]] + i[at : at + 4096, None] * stride
        hit = known[np.minimum(np.searchsorted(known, wanted), len(known) - 1)] == wanted
        worth = np.zeros((len(wanted), width + 1), np.int32)
        np.cumsum(np.where(hit, 1, -4), axis=1, out=worth[:, 1:])
        dense = (worth[:, least:] >= np.minimum.accumulate(worth[:, : width + 1 - least], axis=1)).any(1)
        ok[at : at + 4096] = np.where(whole[j[at : at + 4096]], dense, hit.sum(1) >= SIMILARITY * least)
    return ok


def links(raw: list[np.ndarray], home: np.ndarray, earlier: np.ndarray, i: np.ndarray, j: np.ndarray, test: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> list[tuple]:
    """(number of the pair, its passage) of the pairs that are links to report: in their order, pairs with a passage in common that join members of
    unlike homes, until all that is linked is joined; and for each member that is not known to repeat an `earlier` one a
    pair with such a one, if there is any. So a dense group gives a forest, not all pairs. `test` tells pairs that have no
    passage for certain."""
    home, earlier, out, tried = home.copy(), earlier.copy(), [], np.zeros(len(i), bool)

    def compare(k: int) -> None:
        tried[k] = True
        if found := passages(raw[j[k]], raw[i[k]]):
            out.extend((k, x) for x in found)
            earlier[j[k]] = True
            home[home == home[j[k]]] = home[i[k]]

    left = np.arange(len(i))
    while len(left):
        some, left = left[: len(home)], left[len(home) :]
        for k in (some if test is None else some[test(i[some], j[some])]).tolist():
            if home[i[k]] != home[j[k]]:
                compare(k)
        left = left[home[i[left]] != home[j[left]]]
    left = np.flatnonzero(~tried & ~earlier[j])
    while len(left):
        some, left = left[: len(home)], left[len(home) :]
        for k in (some if test is None else some[test(i[some], j[some])]).tolist():
            if not earlier[j[k]]:
                compare(k)
        left = left[~earlier[j[left]]]
    return out


def _joined(doc: list, home: list) -> np.ndarray:
    """A number for each member of a group, equal where documents are joined through homes of members."""
    up: dict = {}

    def root(x: object) -> object:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    for a, b in zip(doc, home, strict=True):
        if a != b:
            up[root(a)] = root(b)
    number: dict = {}
    return np.array([number.setdefault(root(a), len(number)) for a in doc])


def edited_passages(documents: DataFrame, stretches: DataFrame, verified: DataFrame, least: int = LEAST) -> DataFrame:
    """Rows as of `verify` for documents with a chosen short run in or around these stretches, where no verified passage
    joins both to one document yet: what the run's surroundings, `least` shingles to both sides, have in common; and how many
    shingles `more` the pattern goes on, where they are nothing else."""
    kind = dict(documents.dtypes)["doc_id"]
    of = stretches.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("stretches"))
    homes = verified.groupBy("doc_id").agg(F.collect_list(F.struct("rep_id", "start", (F.col("end") - SHINGLE).alias("stop"))).alias("homes"))
    texts = documents.select("doc_id", "text")

    def choosing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch, "text"):
                h, rows = shingles(*text_buffer(piece.column("text")))
                edge = np.searchsorted(rows, np.arange(piece.num_rows + 1), side="left")
                at, runs = short_runs(h, rows)
                of_row, (lo, hi) = _listed(piece.column("stretches"))
                begin = np.minimum(edge[of_row] + np.maximum(lo.to_numpy().astype(np.int64) - least, 0), edge[of_row + 1])
                stop = np.minimum(edge[of_row] + hi.to_numpy() + least + 1, edge[of_row + 1])
                use = np.cumsum(np.bincount(begin, minlength=len(h) + 1) - np.bincount(stop, minlength=len(h) + 1)) > 0
                use = use[at] & (np.diff(edge)[rows[at]] >= least)
                at, runs = at[use], runs[use]
                # home: the smallest of the documents to which a passage at the run joins this one, or itself
                of_row, (rep, begin, stop) = _listed(piece.column("homes"))
                begin = edge[of_row] + np.maximum(begin.to_numpy().astype(np.int64) - BESIDE, 0)
                stop = np.minimum(edge[of_row] + stop.to_numpy() - SHORT + 1 + BESIDE + 1, edge[of_row + 1])
                home = rows[at]
                for k, a, b in zip(*(x[pc.sort_indices(rep, sort_keys=[("", "descending")]).to_numpy()].tolist() for x in (np.arange(len(rep)), np.searchsorted(at, begin), np.searchsorted(at, stop))), strict=True):
                    home[a:b] = piece.num_rows + k
                chosen, begin, size, more = surrounded(rows[at], runs, home, at)
                row = rows[at[chosen]]
                size += np.minimum(begin - edge[row], 0)
                begin = np.maximum(begin - edge[row], 0)
                ids = piece.column("doc_id")
                cols = [pa.array(runs[chosen].view(np.int64)), ids.take(pa.array(row)), pa.array(begin, pa.int32()), pa.array(size, pa.int32()), pa.array(more, pa.int32()), pa.concat_arrays([ids, rep]).take(pa.array(home[chosen]))]
                yield pa.RecordBatch.from_arrays(cols, ["run", "doc_id", "at", "size", "more", "home"])

    def surrounding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch, "text"):
                h, rows = shingles(*text_buffer(piece.column("text")))
                edge = np.searchsorted(rows, np.arange(piece.num_rows + 1), side="left")
                low = h.astype(np.uint32)  # half of a hash tells some hundred shingles apart
                of_row, (run, at, size, more, home) = _listed(piece.column("todo"))
                begin = np.minimum(edge[of_row] + at.to_numpy(), edge[of_row + 1])
                length = np.minimum(begin + size.to_numpy(), edge[of_row + 1]) - begin
                for s in range(0, len(at), 8192):
                    n = length[s : s + 8192]
                    ends = np.concatenate([[0], np.cumsum(4 * n)]).astype(np.int32)
                    near = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(low[_ranges(begin[s : s + 8192], n)])])
                    cols = [run[s : s + 8192], home[s : s + 8192], near, piece.column("doc_id").take(pa.array(of_row[s : s + 8192])), at[s : s + 8192], more[s : s + 8192]]
                    yield pa.RecordBatch.from_arrays(cols, ["run", "home", "near", "doc_id", "at", "more"])

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole(batches, "run"):
            out, docs, homes, sides, places, chains = [], *(table.column(c).to_pylist() for c in ("doc_id", "home", "near", "at", "more"))
            for s, e in zip(starts.tolist(), starts[1:].tolist(), strict=False):
                one: dict = {}  # in order of doc_id
                for k in range(s, e):
                    # each chain of a document that nothing joins yet
                    one.setdefault((homes[k], sides[k], places[k] if chains[k] >= 0 and homes[k] == docs[k] else -1), k)
                kept = list(one.values())
                doc, over = [docs[k] for k in kept], [homes[k] for k in kept]
                home = _joined(doc, over)
                if (home == home[0]).all():
                    continue
                raw = [np.frombuffer(sides[k], np.uint32).astype(np.uint64) for k in kept]
                test = None
                if len(raw) <= FEW:
                    near = [np.unique(x) for x in raw]
                else:
                    grid, near, known, stride = numbered(raw)
                whole = np.array([len(x) == len(y) for x, y in zip(near, raw, strict=True)])
                i, j = alike(near, whole, home)
                if len(raw) > FEW:
                    test = partial(promising, grid, known, stride, whole)
                text = np.cumsum([True, *(x != y for x, y in zip(doc, doc[1:], strict=False))])
                i, j = i[text[i] != text[j]], j[text[i] != text[j]]  # in order of doc_id
                for k, (a, b, c, d, v) in links(raw, home, np.array([x != y for x, y in zip(over, doc, strict=True)]), i, j, test):
                    x, y = (places[kept[n]] for n in (i[k], j[k]))
                    out.append((doc[j[k]], doc[i[k]], y + a, y + b + SHINGLE - 1, x + c, x + d + SHINGLE - 1, v, max(chains[kept[j[k]]], 0)))
            if out:
                cols = list(zip(*out, strict=True))
                kinds = [table.schema.field("doc_id").type] * 2 + [pa.int32()] * 4 + [pa.float64(), pa.int32()]
                names = ["doc_id", "rep_id", "start", "end", "rep_start", "rep_end", "similarity", "more"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    runs = settled(texts.join(of, "doc_id").join(homes, "doc_id", "left").select("doc_id", "stretches", "homes", "text").mapInArrow(choosing, f"run long, doc_id {kind}, at int, size int, more int, home {kind}"), "short-runs")
    shared = cut(runs.groupBy("run").agg(F.min("home").alias("a"), F.max("home").alias("b")).where("a <> b").select("run"))
    todo = settled(runs.join(shared, "run").groupBy("doc_id").agg(F.collect_list(F.struct("run", "at", "size", "more", "home")).alias("todo")), "short-runs")
    rows = texts.join(todo, "doc_id").select("doc_id", "todo", "text").mapInArrow(surrounding, f"run long, home {kind}, near binary, doc_id {kind}, at int, more int")
    release(documents.sparkSession)  # the shuffles of shorter rows, before surroundings are shuffled
    dealt = rows.repartition("run").sortWithinPartitions("run", "doc_id", "at", "more")
    return dealt.mapInArrow(paired, f"doc_id {kind}, rep_id {kind}, start int, end int, rep_start int, rep_end int, similarity double, more int").distinct()


def _along_runs(mine: np.ndarray, theirs: np.ndarray, place: np.ndarray, least: int) -> None:
    """Where `theirs` repeats shingles, moves the places of whole runs that both have to one such run there, and keeps to
    it as far as it goes."""
    if min(len(mine), len(theirs)) < least:
        return
    own, there = run_hashes(mine, least), run_hashes(theirs, least)
    order = np.argsort(there, kind="stable")
    known = there[order]
    k = np.minimum(np.searchsorted(known, own), len(known) - 1)
    starts = np.flatnonzero(known[k] == own)
    if not len(starts):
        return
    to = order[k[starts]]
    if (known[1:] == known[:-1]).any():
        before, at = -1, -2
        for i, (p, q) in enumerate(zip(starts.tolist(), to.tolist(), strict=True)):
            if p == before + 1 and at + 1 < len(there) and there[at + 1] == own[p]:
                to[i] = q = at + 1
            before, at = p, q
    every = np.arange(len(mine))
    i = np.searchsorted(starts, every, side="right") - 1
    inside = (i >= 0) & (every - starts[np.maximum(i, 0)] < least)
    place[inside] = every[inside] + (to - starts)[i[inside]]


def passages(mine: np.ndarray, theirs: np.ndarray, least: int = LEAST, similarity: float = SIMILARITY) -> list[tuple[int, int, int, int, float]]:
    """(start, end, start there, end there, similarity), in shingles, end exclusive: the passages of `mine` that occur in
    `theirs`. Hits and misses are weighed so that a stretch with a share of `similarity` hits is worth nothing; each
    stretch of rising worth is cut where it is best, and its shingles are compared with those of its place there; a stretch
    that is too unlike is taken apart at its breaks."""
    order = theirs.argsort(kind="stable")
    known = theirs[order]
    if not len(known) or not len(mine):
        return []
    k = known.searchsorted(mine)
    k[k == len(known)] = 0
    out = []
    where = (known[k] == mine).nonzero()[0]
    if len(where) < similarity * least:
        return []
    # maximal segments over the hits: worth is the hits' gain minus the gaps' loss
    start, worth, best, best_end = -1, 0.0, 0.0, -1
    segments, before = [], -1
    for p in where.tolist():
        if start >= 0:
            worth -= similarity * (p - before - 1)
            if worth <= 0 or best - worth > least:
                segments.append((start, best_end))
                start = -1
        if start < 0:
            start, worth, best, best_end = p, 0.0, 0.0, p
        worth += 1 - similarity
        if worth >= best:
            best, best_end = worth, p
        before = p
    if start >= 0:
        segments.append((start, best_end))
    place = np.full(len(mine), -1)
    place[where] = order[k[where]]
    # where neither side repeats shingles, counts of places are counts of shingles
    plain = not (known[1:] == known[:-1]).any()
    if not plain:
        if (where[least - 1 :] - where[: max(len(where) - least + 1, 0)] == least - 1).any():  # a whole run may be there
            _along_runs(mine, theirs, place, least)
    else:
        own = np.sort(mine)
        plain = not (own[1:] == own[:-1]).any()
    while segments:
        a, b = segments.pop()
        if b - a + 1 < least:
            continue
        at = where[where.searchsorted(a) : where.searchsorted(b, "right")]
        if plain and len(at) < similarity * least:
            continue
        there = place[at]
        shift = there - at
        # the place there: hits that keep to the median offset, but for edits
        near = there[np.abs(shift - np.sort(shift)[len(shift) // 2]) <= max(8, (1 - similarity) * (b - a + 1))]
        c, d = int(near.min()), int(near.max())
        if plain:
            common = int(((there >= c) & (there <= d)).sum())
            value = common / (b - a + 1 + d - c + 1 - common)
        else:
            s, t = np.unique(mine[a : b + 1]), np.unique(theirs[c : d + 1])
            common = len(np.intersect1d(s, t, assume_unique=True))
            value = common / (len(s) + len(t) - common)
        if value >= similarity:
            out.append((a, b + 1, c, d + 1, float(value)))
        elif len(at) > 1:
            # too unlike as a whole: its parts to both sides of the widest break, down to unbroken runs
            breaks = at[1:] - at[:-1] - 1 + np.abs(shift[1:] - shift[:-1])
            i = int(breaks.argmax())
            if breaks[i] > 0:
                segments += [(int(at[i + 1]), b), (a, int(at[i]))]
    return sorted(out)


def _stretches(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(rep, part, doc_id, base, text): of each document the words of the stretch that is to be compared, once for each
    representative; base is the stretch's first word. A document has at most one pair for each of its windows."""
    kind = dict(texts.dtypes)["doc_id"]
    of = pairs.groupBy("doc_id").agg(F.collect_list(F.struct("rep", "part", "lo", "hi")).alias("pairs"))

    def cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch, "text"):
                data, offsets = text_buffer(piece.column("text"))
                starts, ends, rows = word_spans(~SPACE[data], offsets)
                edge = np.searchsorted(rows, np.arange(piece.num_rows + 1), side="left")
                raw, out = data.tobytes(), []
                for i, (doc, todo) in enumerate(zip(piece.column("doc_id").to_pylist(), piece.column("pairs").to_pylist(), strict=True)):
                    n = int(edge[i + 1] - edge[i])
                    for p in todo:
                        last = min(p["hi"] + SHINGLE, n)
                        if p["lo"] < last:
                            out.append((p["rep"], p["part"], doc, p["lo"], raw[starts[edge[i] + p["lo"]] : ends[edge[i] + last - 1]].decode()))
                id_type = piece.schema.field("doc_id").type
                kinds = [id_type, pa.int32(), id_type, pa.int32(), pa.string()]
                for at in range(0, len(out), 256):
                    cols = list(zip(*out[at : at + 256], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["rep", "part", "doc_id", "base", "text"])

    return texts.join(of, "doc_id").select("doc_id", "pairs", "text").mapInArrow(cutting, f"rep {kind}, part int, doc_id {kind}, base int, text string")


def verify(documents: DataFrame, pairs: DataFrame, group: int = VERIFY_GROUP) -> DataFrame:
    """doc_id, rep_id, start, end, rep_start, rep_end (words, end exclusive), similarity. A representative's text is
    sent once for each `group` of its documents. The pairs are read twice: give a written frame."""
    kind = dict(documents.dtypes)["doc_id"]
    dealt = pairs.select("doc_id", "rep", "lo", "hi", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("u"))
    sizes = dealt.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).select("rep", F.ceil(F.col("n") / group).cast("int").alias("parts"))
    sizes = cut(sizes)
    texts = documents.select("doc_id", "text")
    theirs = texts.join(sizes, texts["doc_id"] == sizes["rep"]).select("rep", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast(kind).alias("doc_id"), F.lit(0).alias("base"), "text")
    mine = _stretches(texts, dealt.join(sizes, "rep").select("doc_id", "rep", "lo", "hi", F.pmod("u", "parts").cast("int").alias("part")))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, there = None, None
        for batch in batches:
            rows = []
            for piece in chunks(batch, "text"):
                h, of = shingles(*text_buffer(piece.column("text")))
                edge = np.searchsorted(of, np.arange(piece.num_rows + 1), side="left")
                reps, parts, docs, bases = (piece.column(c).to_pylist() for c in ("rep", "part", "doc_id", "base"))
                for i, (rep, part, doc, base) in enumerate(zip(reps, parts, docs, bases, strict=True)):
                    own = h[edge[i] : edge[i + 1]]
                    if doc is None:
                        if key != (rep, part):
                            key, there = (rep, part), own.copy()
                    elif key == (rep, part):
                        rows += [(doc, rep, base + a, base + b + SHINGLE - 1, c, d + SHINGLE - 1, v) for a, b, c, d, v in passages(own, there)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [batch.schema.field("doc_id").type] * 2 + [pa.int32()] * 4 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "rep_id", "start", "end", "rep_start", "rep_end", "similarity"])

    both = theirs.unionByName(mine).repartition("rep", "part").sortWithinPartitions("rep", "part", F.col("doc_id").asc_nulls_first(), "text")
    return both.mapInArrow(compared, f"doc_id {kind}, rep_id {kind}, start int, end int, rep_start int, rep_end int, similarity double")


def repeated_passages(documents: DataFrame) -> DataFrame:
    """One row for each passage of a document that nearly repeats one of an earlier document (a smaller doc_id):
    doc_id, rep_id, start, end, rep_start, rep_end, similarity."""
    rows = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    held = settled(shared_windows(windows(rows)), "windows")
    release(documents.sparkSession)  # the windows' shuffles, before texts are shuffled
    pairs = cut(candidates(held))
    first = settled(verify(rows, pairs), "passages")
    stretches = cut(unresolved(held, first))
    if stretches.isEmpty():
        return first.distinct()
    again = run_candidates(rows, stretches.where("whole"))
    # what was compared with the same representative around there has its passages
    fresh = cut(_but(again, pairs))
    second = settled(first.unionByName(verify(rows, fresh)), "passages")
    edited = cut(edited_passages(rows, stretches.where("not whole"), second))
    margin = F.lit(2 * LEAST)  # beyond the surroundings of a run passages may go on
    wide = edited.groupBy("doc_id", F.col("rep_id").alias("rep")).agg(F.greatest(F.min("start") - margin, F.lit(0)).alias("lo"), (F.max(F.col("end") + F.col("more")) + margin).alias("hi"))
    third = cut(verify(rows, cut(wide)))
    # a row from the surroundings stays where the wider comparison doesn't cover it
    there = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("doc_id", "rep_id")]
    alone = edited.alias("a").join(third.alias("b"), [*there, F.col("a.start") < F.col("b.end"), F.col("b.start") < F.col("a.end")], "left_anti").drop("more")
    return second.unionByName(third).unionByName(alone).distinct()


def _but(pairs: DataFrame, done: DataFrame) -> DataFrame:
    """The pairs whose stretch was not compared yet."""
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("doc_id", "rep")]
    return pairs.alias("a").join(done.alias("b"), [*same, F.col("a.lo") >= F.col("b.lo"), F.col("a.hi") <= F.col("b.hi")], "left_anti")

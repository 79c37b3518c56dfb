"""SimHash near-duplicate classes, by a self-join over binary tries.

Fingerprint: words `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased, shingles of three words joined by a space
(fewer words: the whole sequence), XXH64 with seed 42 of each; a bit is 1 if set in over half of the hashes.

Links: two fingerprints at most BUDGET bits apart agree wholly in one of three disjoint blocks of bits, so three
rotated copies of each distinct fingerprint are dealt out by the first bits of that block, as many bits as give tries of
some thousand fingerprints. That bounds the copies at three whatever the input. Each binary trie is kept as a sorted array;
pairs of its nodes are traversed together from the top, a differing bit uses up budget, and a pair without budget is left.
Node pairs whose members are already connected are left too, so a dense ball of near copies costs no quadratic output: a
task emits a spanning forest of its links. A trie with more than `limit` fingerprints is cut into deeper nodes of at most
that size, and the node pairs within the budget are tasks of their own.

Classes: connected components over the forests, then one join back to the documents.

`near_classes`, which deduplication uses, also joins texts whose five-word shingles are at least 0.8 alike. These lie too
far apart for two bits, so candidates come from min-hashes of the shingle set itself, whatever kind of edit made the
difference: texts that agree in all hashes of one band share a bucket (99.8 % of pairs at 0.8). First each bucket's most
typical text is compared with the others, which joins most of a large group; then the members of buckets that are still in
several classes are joined exactly, on their shingle sets, by the sets' rarest members, so that only links of a forest leave
a bucket. The result is the same for buckets of any size.

Defined cases: texts without words (null and empty ones among them) have fingerprint zero and link like any other;
equal texts share a fingerprint; rows with a null doc_id get a class but never name it (a class of only such rows has
a null name); repeated doc_ids are rows like others; further columns are ignored; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import SPACE, chunks, gram_hashes, lower_ascii, mix64, span_hashes, text_buffer, word_spans
from .components import components
from .storage import cut, release, settled

BUDGET = 2
SEED = 42
SHINGLE = 3
#: First bits (from the top) of the disjoint blocks, one more than the budget, and the bits of the shortest.
TURNS = (0, 22, 43)
BLOCK_BITS = 21
#: Fingerprints of a trie on average, and those of one trie that a task takes; larger tries are cut.
TRIE_CODES = 4096
BLOCK_LIMIT = 1 << 18
#: Pairs of codes that a leaf pair of the traversal compares, and node pairs that it takes at once.
_LEAF = 16
_FRONT = 1 << 16
#: Near copies by similarity: shingle words, similarity, bands of min-hashes and hashes in each, and how many of all
#: hashes agree with a bucket's centre where the two are compared first.
NEAR_SHINGLE = 5
SIMILARITY = 0.8
BANDS = 12
BAND_ROWS = 4
NEAR_AGREE = 28
#: Members among which a bucket's centre is chosen, and shingles in one block of a bucket.
CENTRE_OF = 1024
TASK_SHINGLES = 1 << 19


def fingerprint_batch(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The fingerprint (uint64) of each row."""
    n = len(offsets) - 1
    out = np.zeros(n, np.uint64)
    data = lower_ascii(data)
    starts, ends, rows = word_spans(~SPACE[data], offsets)
    if not len(starts):
        return out
    keep = ~SPACE[data]
    after = ends[ends < len(data)]
    keep[after] = True
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    flat = data.copy()
    flat[SPACE[data]] = 32
    joined = flat[keep].tobytes()
    starts, ends = at[starts], at[ends - 1] + 1
    count = np.bincount(rows, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    per = np.where(count >= SHINGLE, count - SHINGLE + 1, (count > 0).astype(np.int64))
    full = np.flatnonzero(per)
    begin = np.concatenate([[0], np.cumsum(per)])
    word = np.arange(begin[-1]) - np.repeat(begin[:-1], per) + np.repeat(first[:-1], per)
    last = np.minimum(word + SHINGLE - 1, np.repeat(first[1:], per) - 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[word].tolist(), ends[last].tolist(), strict=True)), np.uint64, len(word))
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, begin[:-1][full], axis=0, dtype=np.int32)
    out[full] = np.packbits(ones * 2 > per[full][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                fp = fingerprint_batch(*text_buffer(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return documents.select("doc_id", "text").mapInArrow(hashed, f"doc_id {dict(documents.dtypes)['doc_id']}, fp long")


class Forest:
    """Disjoint sets over array positions; the smallest position is the root."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        r = self.parent[at]
        while True:
            up = self.parent[r]
            if np.array_equal(up, r):
                break
            r = up
        self.parent[at] = r
        return r

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return int(i)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        for x, y in both.tolist():
            x, y = self.find(x), self.find(y)
            if x != y:
                self.parent[max(x, y)] = min(x, y)


def join_trie(codes: np.ndarray, forest: Forest, left: tuple[int, int], right: tuple[int, int], depth: int = 0, budget: int = BUDGET) -> int:
    """Links all pairs at most `budget` bits apart between two nodes of the trie over the sorted distinct codes; gives
    the number of node pairs that were split. A node is a range of positions that share their first `depth` bits; left
    equal to right joins a node with itself. All pairs of one depth descend together: a pair splits into its children's
    pairs, a differing bit is charged to its budget, and pairs without budget or with all members in one class are
    left. Pairs of a few codes are compared."""
    ones: dict[int, np.ndarray] = {}
    stack = [(np.array([[*left, *right, budget]], np.int64), depth)]
    everything, split, fresh = np.arange(len(codes)), 0, True
    while stack:
        pairs, bit = stack.pop()
        if len(pairs) > _FRONT:
            stack.append((pairs[_FRONT:], bit))
            pairs = pairs[:_FRONT]
        if fresh:
            roots, fresh = forest.roots(everything.copy()), False
            change = np.concatenate([[0], np.cumsum(roots[1:] != roots[:-1])]) if len(roots) else roots
        a, b, c, d, spare = pairs.T
        pairs = pairs[(a < b) & (c < d) & (spare >= 0) & ~((a == c) & (b == d) & (b - a < 2))]
        a, b, c, d, spare = pairs.T
        one = (roots[a] == roots[c]) & (change[b - 1] == change[a]) & (change[d - 1] == change[c])
        pairs = pairs[~one]
        a, b, c, d, spare = pairs.T
        small = ((b - a) * (d - c) <= _LEAF) | (bit >= 64)
        if small.any():
            p, q, base, there = (b - a)[small], (d - c)[small], a[small], c[small]
            n = p * q
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i, j = np.repeat(base, n) + k // np.repeat(q, n), np.repeat(there, n) + k % np.repeat(q, n)
            near = (roots[i] != roots[j]) & (np.bitwise_count(codes[i] ^ codes[j]) <= budget)
            if near.any():
                forest.join(roots[i[near]], roots[j[near]])
                fresh = True
        pairs = pairs[~small]
        if not len(pairs):
            continue
        split += len(pairs)
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((codes >> np.uint64(63 - bit)) & np.uint64(1)).astype(np.int64)])
        a, b, c, d, spare = pairs.T
        m, k = b - (ones[bit][b] - ones[bit][a]), d - (ones[bit][d] - ones[bit][c])
        own = (a == c) & (b == d)
        of = lambda *cols: np.stack(cols, 1)
        stack.append((np.concatenate([of(a, m, c, k, spare), of(m, b, k, d, spare), of(a, m, k, d, spare - 1), of(m, b, c, k, spare - 1)[~own]]), bit + 1))
    return split


def _turn(code: Column, first: int) -> Column:
    return code if first == 0 else F.shiftleft(code, first).bitwiseOR(F.shiftrightunsigned(code, 64 - first))


def _turn_back(code: np.ndarray, first: int) -> np.ndarray:
    return code if first == 0 else (code >> np.uint64(first)) | (code << np.uint64(64 - first))


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, dict[str, np.ndarray]]]:
    """Runs of equal keys in sorted batches, across batch borders."""
    held: list[dict[str, np.ndarray]] = []
    now: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for k in keys:
            change[1:] |= cols[k][1:] != cols[k][:-1]
        cuts = [*np.flatnonzero(change).tolist(), batch.num_rows]
        for s, e in zip(cuts, cuts[1:], strict=False):
            key = tuple(cols[k][s : s + 1].tolist()[0] for k in keys)
            if key != now:
                if held:
                    yield now, {n: np.concatenate([h[n] for h in held]) for n in held[0]}
                held, now = [], key
            held.append({n: v[s:e] for n, v in cols.items()})
    if held:
        yield now, {n: np.concatenate([h[n] for h in held]) for n in held[0]}


def _edges(roots: np.ndarray, codes: np.ndarray, first: int) -> Iterator[pa.RecordBatch]:
    child = np.flatnonzero(roots != np.arange(len(roots)))
    if len(child):
        a, b = (_turn_back(codes[x], first).view(np.int64) for x in (child, roots[child]))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _block_links(rows: DataFrame, depth: int) -> DataFrame:
    """Spanning forests of the links within the trie of each (turn, block), a block being the first `depth` bits."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (turn, _), g in _groups(batches, ["turn", "block"]):
            codes = np.sort(g["code"].view(np.uint64))
            if len(codes) > 1:
                forest = Forest(len(codes))
                join_trie(codes, forest, (0, len(codes)), (0, len(codes)), depth=depth)
                yield from _edges(forest.roots(np.arange(len(codes))), codes, TURNS[turn])

    return rows.repartition("turn", "block").sortWithinPartitions("turn", "block").mapInArrow(linked, "a long, b long")


def _cut_nodes(rows: DataFrame, limit: int, depth: int, step: int = 6) -> list[tuple[int, int, int]]:
    """(turn, prefix, depth) of trie nodes of at most `limit` codes each that cover the rows. Only counts of nodes
    reach the driver; there are at most some rows / limit of them."""
    nodes, open_rows = [], rows
    while True:
        depth = min(64, depth + step)
        prefix = F.shiftrightunsigned("code", 64 - depth) if depth < 64 else F.col("code")
        counted = open_rows.groupBy("turn", prefix.alias("prefix")).count().cache()
        nodes += [(r[0], r[1], depth) for r in counted.where((F.col("count") <= limit) | F.lit(depth == 64)).collect()]
        big = [(r[0], r[1]) for r in counted.where(F.col("count") > limit).collect()] if depth < 64 else []
        counted.unpersist()
        if not big:
            return nodes
        keep = F.broadcast(rows.sparkSession.createDataFrame(big, "turn int, prefix long"))
        open_rows = open_rows.withColumn("prefix", prefix).join(keep, ["turn", "prefix"], "left_semi").drop("prefix")


def _node_pairs(nodes: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Pairs (turn, left, right, bits used) of nodes, by number, whose shared depth leaves a budget: a traversal of
    the trie over the nodes, branch against branch."""
    out = []
    for turn in {n[0] for n in nodes}:
        own = sorted((((p % (1 << 64)) << (64 - d)) if d < 64 else p % (1 << 64), d, i) for i, (t, p, d) in enumerate(nodes) if t == turn)
        starts = [x[0] for x in own]
        stack = [(0, len(own), 0, len(own), 0, 0)]
        while stack:
            a, b, c, d, bit, used = stack.pop()
            if a >= b or c >= d or used > BUDGET:
                continue
            ends = bit >= 64 or any(own[x][1] <= bit for x in ({a, c} if b - a == 1 or d - c == 1 else ()))
            if (b - a == 1 and d - c == 1 and ends) or bit >= 64:
                out += [(turn, own[x][2], own[y][2], used) for x in range(a, b) for y in range(c, d)]
                continue
            side = 1 << (63 - bit)

            def halves(p: int, q: int) -> list[tuple[int, int, int | None]]:
                if q - p == 1 and own[p][1] <= bit:
                    return [(p, q, None)]
                m = next((x for x in range(p, q) if starts[x] & side), q)
                return [(p, m, 0), (m, q, 1)]

            same = a == c and b == d
            for i, (p, q, x) in enumerate(halves(a, b)):
                for j, (r, s, y) in enumerate(halves(c, d)):
                    if not (same and j < i):
                        stack.append((p, q, r, s, bit + 1, used + (x is not None and y is not None and x != y)))
    return sorted(set(out))


def _large_links(rows: DataFrame, limit: int, depth: int) -> DataFrame:
    """Spanning forests for blocks over the limit: one task group for each pair of trie nodes within the budget."""
    spark = rows.sparkSession
    nodes = _cut_nodes(rows, limit, depth)
    pairs = _node_pairs(nodes)
    depths = sorted({n[2] for n in nodes})
    place = spark.createDataFrame([(t, p, d, i) for i, (t, p, d) in enumerate(nodes)], "turn int, prefix long, depth int, node int")
    tagged = None
    for d in depths:
        prefix = F.shiftrightunsigned("code", 64 - d) if d < 64 else F.col("code")
        part = rows.withColumn("prefix", prefix).join(place.where(F.col("depth") == d), ["turn", "prefix"]).select("turn", "code", "node")
        tagged = part if tagged is None else tagged.unionAll(part)
    both = [(n, k, i == j) for k, (_, i, j, _) in enumerate(pairs) for n in {i, j}]
    to = spark.createDataFrame(both, "node int, pair int, own boolean")
    side = {k: (i, j) for k, (_, i, j, _) in enumerate(pairs)}

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (pair,), g in _groups(batches, ["pair"]):
            turn = int(g["turn"][0])
            i, j = side[pair]
            codes, node = g["code"].view(np.uint64), g["node"]
            order = np.argsort(codes, kind="stable")
            codes, node = codes[order], node[order]
            forest = Forest(len(codes))
            # nodes don't overlap, so each is one range of the sorted codes
            where = {x: np.flatnonzero(node == x) for x in {i, j}}
            if all(len(w) for w in where.values()):
                left, right = ((int(where[x][0]), int(where[x][-1]) + 1) for x in (i, j))
                join_trie(codes, forest, left, right)
                yield from _edges(forest.roots(np.arange(len(codes))), codes, TURNS[turn])

    return tagged.join(to, "node").select("pair", "turn", "node", "code").repartition("pair").sortWithinPartitions("pair").mapInArrow(linked, "a long, b long")


def trie_depth(n: int) -> int:
    """Leading bits by which n fingerprints are dealt out to tries of TRIE_CODES on average; at most a block."""
    return min(BLOCK_BITS, max(0, -(-n // TRIE_CODES) - 1).bit_length())


def links(fps: DataFrame, limit: int = BLOCK_LIMIT) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints (column fp) exactly as their links do. The frame is read more
    than once: give a written one."""
    depth = trie_depth(fps.count())
    block = lambda code: F.shiftrightunsigned(code, 64 - depth) if depth else F.lit(0).cast("long")
    # one trie of all needs no turned copies
    turns = TURNS if depth else TURNS[:1]
    rows = fps.select(F.explode(F.array(*[F.struct(F.lit(i).alias("turn"), block(_turn(F.col("fp"), first)).alias("block"), _turn(F.col("fp"), first).alias("code")) for i, first in enumerate(turns)])).alias("x")).select("x.*")
    large = rows.groupBy("turn", "block").count().where(F.col("count") > limit).select("turn", "block")
    large = cut(large)
    if large.isEmpty():
        return _block_links(rows, depth)
    return _block_links(rows.join(large, ["turn", "block"], "left_anti"), depth).unionAll(_large_links(rows.join(large, ["turn", "block"], "left_semi").select("turn", "code"), limit, depth))


def classes(documents: DataFrame, limit: int = BLOCK_LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every document."""
    docs = cut(fingerprints(documents))
    distinct = cut(docs.groupBy("fp").agg(F.min("doc_id").alias("m")))
    found = components(links(distinct, limit))
    named = distinct.join(found.select(F.col("vertex").alias("fp"), "root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "m")
    names = named.groupBy("root").agg(F.min("m").alias("component_id"))
    of = cut(named.select("fp", "root").join(names, "root").select("fp", "component_id"))
    return docs.join(of, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# -- near copies by similarity ------------------------------------------------------------------------------------


def min_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The key of each band of each row (uint64), one byte of each min-hash of the row's shingle set, and its shingles,
    repeats included."""
    n = len(offsets) - 1
    flat, begin = _shingle_hashes(data, offsets)
    low = np.empty((n, BANDS * BAND_ROWS), np.uint64)
    seeds = mix64(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64))
    for f, seed in enumerate(seeds):
        low[:, f] = np.minimum.reduceat((flat ^ seed) * (mix64(seeds[f : f + 1])[0] | np.uint64(1)), begin[:-1]) if n else 0
    keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (n, 1))
    for r in range(BAND_ROWS):
        keys = mix64(keys ^ low[:, r::BAND_ROWS])
    return keys, (mix64(low) >> np.uint64(56)).astype(np.uint8), np.diff(begin)


def open_buckets(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows (key, doc_id, ...) of buckets whose members are not all in one class, with their class as root."""
    rows = members.drop("root").join(roots.withColumnRenamed("vertex", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    several = rows.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key")
    return settled(rows.join(several, "key", "left_semi"), "buckets")


def centre_pairs(rows: DataFrame) -> DataFrame:
    """(doc_id, rep): the most typical text of each bucket beside the members that are in another class and agree with it
    in NEAR_AGREE min-hashes. It is chosen among CENTRE_OF members, which bounds a task; all members are compared."""
    kind = dict(rows.dtypes)["doc_id"]
    first = Window.partitionBy("key").orderBy(F.xxhash64("doc_id"), "doc_id")
    some = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= CENTRE_OF).select("key", "doc_id", "root", "marks")

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key,), g in _groups(batches, ["key"]):
            marks = np.frombuffer(b"".join(g["marks"].tolist()), np.uint8).reshape(len(g["marks"]), -1)
            mode = np.array([np.bincount(c, minlength=256).argmax() for c in marks.T], np.uint8)
            near = (marks == mode).sum(1)
            i = min(np.flatnonzero(near == near.max()).tolist(), key=lambda k: g["doc_id"][k])
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array(g["doc_id"][i : i + 1]), pa.array(g["root"][i : i + 1]), pa.array([marks[i].tobytes()], pa.binary())], ["key", "rep", "rep_root", "rep_marks"])

    centres = some.repartition("key").sortWithinPartitions("key").mapInArrow(chosen, f"key long, rep {kind}, rep_root {kind}, rep_marks binary")
    both = rows.join(centres, "key").where("root <> rep_root").select("doc_id", "rep", "marks", "rep_marks")

    def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                mine, theirs = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("marks", "rep_marks"))
                yield batch.select(["doc_id", "rep"]).filter(pa.array((mine == theirs).sum(1) >= NEAR_AGREE))

    return both.mapInArrow(agreeing, f"doc_id {kind}, rep {kind}").distinct()


def alike(sets: list[np.ndarray], roots: np.ndarray, side: np.ndarray | None = None, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links (places) among sorted distinct sets that connect all those at least that similar, beyond what equal roots
    connect; with `side` only between sets of different sides. Exact: of two such sets, the shares of 1 - similarity of
    rarest members have a member in common, so each set is compared with those it shares one with, and only while
    they are in different classes."""
    size = np.array([len(s) for s in sets], np.int64)
    n, out = len(sets), []
    if n < 2:
        return out
    of, flat = np.repeat(np.arange(n), size), np.concatenate(sets)
    _, token, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    order = np.lexsort((rank[token], of))
    token = token[order]
    begin = np.cumsum(size) - size
    rare = np.arange(len(flat)) - begin[of] < (size - np.ceil(similarity * size).astype(np.int64) + 1)[of]
    rare &= count[token] > 1
    by = np.argsort(token[rare], kind="stable")
    holders, named = of[rare][by], token[rare][by]
    start, end = np.searchsorted(named, np.arange(len(count))), np.searchsorted(named, np.arange(len(count)), side="right")
    mine, mark = token[rare], np.searchsorted(of[rare], np.arange(n + 1))
    classes = np.unique(roots, return_inverse=True)[1]
    for i in range(n):
        lists = [holders[start[t] : end[t]] for t in mine[mark[i] : mark[i + 1]].tolist()]
        if not lists:
            continue
        near = np.unique(np.concatenate(lists))
        near = near[(near < i) & (classes[near] != classes[i]) & (size[near] >= similarity * size[i]) & (size[i] >= similarity * size[near])]
        if side is not None:
            near = near[side[near] != side[i]]
        for j in near.tolist():
            if classes[j] != classes[i]:
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if common >= similarity * (size[i] + size[j] - common):
                    out.append((i, j))
                    classes[classes == classes[i]] = classes[j]
    return out


def bucket_links(rows: DataFrame, sets: DataFrame, limit: int = TASK_SHINGLES) -> DataFrame:
    """(x, y): verified links that connect all members of a bucket that are alike and not of one class yet, from rows
    (key, doc_id, root, size) and sets (doc_id, shingles).

    The members' shingle sets come to the bucket's task, so no pair leaves it but links of a forest. A bucket of more than
    `limit` shingles is cut: its largest class into blocks, all other members (what the class has left over) into blocks
    too, and each of the latter meets every block in a task of its own."""
    kind = dict(rows.dtypes)["doc_id"]
    per = rows.groupBy("key", "root").agg(F.sum("size").alias("size"))
    main = per.groupBy("key").agg(F.max(F.struct("size", "root")).alias("main"), F.sum("size").alias("size"))
    parts = lambda size: F.greatest(F.ceil(size / F.lit(limit)), F.lit(1))
    whole = F.col("size") <= limit
    main = main.select("key", F.when(~whole, F.col("main.root")).alias("main"), F.when(whole, 1).otherwise(parts(F.col("size") - F.col("main.size"))).cast("int").alias("left"), F.when(whole, 0).otherwise(parts(F.col("main.size"))).cast("int").alias("blocks"))
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    dealt = rows.join(main, "key").withColumn("part", F.when(F.col("root") == F.col("main"), F.col("left") + u % F.greatest("blocks", F.lit(1))).otherwise(u % F.col("left")).cast("int"))
    p, last = F.col("part"), F.col("left") + F.col("blocks") - 1
    below = F.transform(F.sequence(F.lit(0), F.least(p, F.col("left") - 1)), lambda i: F.struct(i.alias("i"), p.alias("j")))
    above = F.when((p < F.col("left")) & (p < last), F.transform(F.sequence(p + 1, last), lambda j: F.struct(p.alias("i"), j.alias("j")))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    tasks = dealt.select("key", "doc_id", "root", "part", F.explode(F.concat(below, above)).alias("t")).select("key", "t.i", "t.j", "part", "doc_id", "root")
    given = tasks.join(sets, "doc_id")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), g in _groups(batches, ["key", "i", "j"]):
            order = np.argsort(g["doc_id"], kind="stable")
            sets = [np.frombuffer(x, np.uint64) for x in g["shingles"][order].tolist()]
            found = alike(sets, g["root"][order], g["part"][order] if i != j else None)
            if found:
                ids = g["doc_id"][order]
                yield pa.RecordBatch.from_arrays([pa.array(ids[list(c)]) for c in zip(*found, strict=True)], ["x", "y"])

    return given.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(linked, f"x {kind}, y {kind}")


def similar(documents: DataFrame, pairs: DataFrame, similarity: float = SIMILARITY, group: int = 128) -> DataFrame:
    """The pairs whose sets of NEAR_SHINGLE-word shingles are that similar, exactly counted. A representative's text is
    sent once for each `group` of its pairs."""
    kind = dict(documents.dtypes)["doc_id"]
    dealt = cut(pairs.select("doc_id", "rep", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("u")))
    sizes = cut(dealt.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / group).cast("int").alias("parts")))
    texts = documents.select("doc_id", "text")
    theirs = texts.join(sizes, texts["doc_id"] == sizes["rep"]).select("rep", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast(kind).alias("doc_id"), "text")
    mine = texts.join(dealt.join(sizes, "rep").select("doc_id", "rep", F.pmod("u", "parts").cast("int").alias("part")), "doc_id").select("rep", "part", "doc_id", "text")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, there = None, None
        for batch in batches:
            for piece in chunks(batch, "text"):
                sets = shingle_sets(*text_buffer(piece.column("text")))
                rows = []
                for rep, part, doc, own in zip(*(piece.column(c).to_pylist() for c in ("rep", "part", "doc_id")), sets, strict=True):
                    if doc is None:
                        if key != (rep, part):
                            key, there = (rep, part), own
                    elif key == (rep, part):
                        common = len(np.intersect1d(own, there, assume_unique=True))
                        if common >= similarity * (len(own) + len(there) - common):
                            rows.append((doc, rep))
                t = piece.schema.field("doc_id").type
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k in (0, 1)], ["doc_id", "rep"])

    both = theirs.unionByName(mine).repartition("rep", "part").sortWithinPartitions("rep", "part", F.col("doc_id").asc_nulls_first(), "text")
    return both.mapInArrow(compared, f"doc_id {kind}, rep {kind}")


def _shingle_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each row's shingles of NEAR_SHINGLE words (of all words, where there are fewer; zero without words),
    row after row, and where each row begins."""
    low = lower_ascii(data)
    starts, ends, rows = word_spans(~SPACE[low], offsets)
    words = span_hashes(low, starts, ends)
    h, first = gram_hashes(words, rows, NEAR_SHINGLE)
    n = len(offsets) - 1
    count = np.bincount(rows[first], minlength=n)
    begin = np.concatenate([[0], np.cumsum(np.maximum(count, 1))])
    out = np.zeros(begin[-1], np.uint64)
    out[np.arange(len(h)) + np.repeat(begin[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)] = h
    word = np.searchsorted(rows, np.arange(n + 1), side="left")
    for i in np.flatnonzero((count == 0) & (np.diff(word) > 0)).tolist():
        short = words[word[i] : word[i + 1]]
        out[begin[i]] = gram_hashes(short, np.zeros(len(short), np.int64), len(short))[0][0]
    return out, begin


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct hashes of each row's shingles."""
    h, begin = _shingle_hashes(data, offsets)
    return [np.unique(h[a:b]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]


def _text_key(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _near(documents: DataFrame, limit: int) -> DataFrame:
    """doc_id, text_key, root, component_id for every document; root tells classes apart."""
    kind = dict(documents.dtypes)["doc_id"]
    keyed = documents.select("doc_id", _text_key().alias("text_key"), "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                buffer = text_buffer(part.column("text"))
                keys, marks, size = min_hashes(*buffer)
                offsets = np.arange(part.num_rows + 1, dtype=np.int32) * BANDS
                cols = [part.column("doc_id"), part.column("text_key"), pa.array(fingerprint_batch(*buffer).view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64).ravel())), pa.array([m.tobytes() for m in marks], pa.binary()), pa.array(size)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_key", "fp", "keys", "marks", "size"])

    docs = cut(keyed.mapInArrow(hashed, f"doc_id {kind}, text_key long, fp long, keys array<long>, marks binary, size long"))
    # one vertex for each text
    distinct = cut(docs.groupBy("text_key").agg(F.min("doc_id").alias("m"), F.min("fp").alias("fp")))
    by = cut(distinct.groupBy("fp").agg(F.min("text_key").alias("r")))
    edges = links(by.select("fp"), limit)
    close = edges.join(by.select(F.col("fp").alias("a"), F.col("r").alias("x")), "a").join(by.select(F.col("fp").alias("b"), F.col("r").alias("y")), "b").select("x", "y")
    joined = settled(close.unionAll(distinct.join(by, "fp").where("text_key <> r").select(F.col("text_key").alias("x"), F.col("r").alias("y"))), "links")
    named = distinct.where("m is not null").select("text_key", F.col("m").alias("doc_id"))
    vertices = docs.select("doc_id", "text_key", "keys", "marks", "size").join(named, ["doc_id", "text_key"]).dropDuplicates(["text_key"]).select(F.col("text_key").alias("doc_id"), "keys", "marks", "size")
    vertices = cut(vertices)

    found = components(joined, "x", "y")
    members = vertices.select(F.explode("keys").alias("key"), "doc_id", "marks", "size")
    rows = open_buckets(members, found)
    ends = named.join(rows.select(F.col("doc_id").alias("text_key")).distinct(), "text_key")
    texts = settled(keyed.join(cut(ends), ["doc_id", "text_key"]).dropDuplicates(["text_key"]).select(F.col("text_key").alias("doc_id"), "text"), "texts")
    pairs = settled(centre_pairs(rows), "pairs")
    if not pairs.isEmpty():
        near = similar(texts, pairs)
        # read from files: a checkpoint keeps the constraints of its plan, which multiply from round to round
        joined = settled(joined.unionAll(near.select(F.col("doc_id").alias("x"), F.col("rep").alias("y"))), "links")
        found = components(joined, "x", "y")
        release(documents.sparkSession)
        rows = open_buckets(rows, found)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = [s.tobytes() for s in shingle_sets(*text_buffer(part.column("text")))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary())], ["doc_id", "shingles"])

    sets = texts.join(rows.select("doc_id").distinct(), "doc_id").select("doc_id", "text").mapInArrow(listed, "doc_id long, shingles binary")
    joined = settled(joined.unionAll(bucket_links(rows.drop("marks"), sets)), "links")
    found = components(joined, "x", "y")
    of = distinct.join(found.select(F.col("vertex").alias("text_key"), "root"), "text_key", "left").select("text_key", F.coalesce("root", "text_key").alias("root"), "m")
    of = cut(of)
    names = of.groupBy("root").agg(F.min("m").alias("component_id"))
    return docs.select("doc_id", "text_key").join(cut(of.select("text_key", "root").join(names, "root")), "text_key")


def near_classes(documents: DataFrame, limit: int = BLOCK_LIMIT) -> DataFrame:
    """doc_id, component_id for every document: classes under the links of `classes` and those of texts whose
    five-word shingles are at least SIMILARITY alike. Each different text is by itself, whatever its doc_id."""
    return _near(documents, limit).select("doc_id", "component_id")


def one_of_each(documents: DataFrame, limit: int = BLOCK_LIMIT) -> DataFrame:
    """The documents without those that their class (of near_classes) already has: of each class the row with the smallest
    doc_id stays, once (of rows of the class that repeat its id, the one with the smallest text). Rows of one id with
    unlike texts are in classes of their own and stay. Rows with a null doc_id can't be told apart and stay."""
    found = cut(_near(documents, limit).where("doc_id is not null"))
    keyed = documents.withColumn("_tw_key", _text_key())
    same = lambda rows: [keyed["doc_id"] == rows["_tw_id"], keyed["_tw_key"] == rows["text_key"]]
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias("_tw_id"), "text_key").distinct()
    kept = keyed.join(gone, same(gone), "left_anti")
    first = found.where("component_id = doc_id").groupBy("doc_id", "root").count().where("count > 1").select("doc_id", "root")
    again = cut(found.join(first, ["doc_id", "root"]).select(F.col("doc_id").alias("_tw_id"), "text_key", F.col("root").alias("_tw_root")).distinct())
    if again.isEmpty():
        return kept.select(*documents.columns)
    one = Window.partitionBy("_tw_id", "_tw_root").orderBy("text")
    repeated = kept.join(again, same(again)).withColumn("_tw_n", F.row_number().over(one)).where("_tw_n = 1").select(*documents.columns)
    return kept.join(again, same(again), "left_anti").select(*documents.columns).unionByName(repeated)

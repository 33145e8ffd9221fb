"""N-gram Jaccard join by chosen paths.

Sets are the 5-word shingles of whole texts (unchanged words; a text of fewer words has one shingle, all its words).
Texts with the same words form one node. A run lets every set choose, by a shared hash, each of its tokens with
probability 1 / (threshold * size): two sets at the threshold choose a common token once on average. Sets that chose
the same token fall into a bucket. Buckets over ``SMALL`` members are split again the same way, on the values of a
256-bin one-permutation sketch along the path so far; after ``DEPTH`` levels what is still large is compared in
blocks. Runs are repeated until a pair at the threshold is met with the target recall, with the branching
process's survival at full depth as the chance of one run.

Small buckets are compared by brute force on sketches, which only nominates: nominated texts form families, whose
shingle sets are then compared exactly. A family of up to ``PEEL_FROM`` blocks of ``BLOCK`` texts is compared pair by
pair, block by block (the few thousand products of a text cost less than peeling's jobs). A larger one is peeled: every text is measured against a pivot (the text with most copies), and as the Jaccard distance
is a metric, two texts within half the allowed distance of the pivot are linked for sure, and a text near the pivot
and one far from it are sure to be linked or not by the sum and the difference of their distances. Sure links are
counted without a comparison; only pairs that the triangle inequality leaves open are compared, in blocks, and what
lies outside the pivot's ball is peeled again around a pivot of its own, ``PEELS`` times, before its blocks are
compared with each other. So a family of near copies of one page costs a comparison a text, not one a pair, and the
links stay exact. No stage emits pairs: buckets give each member's root, blocks give where components meet, each
member's root and its number of links. Blocks are bounded by rows and by bytes of their sets.

Result per row: class_id (smallest doc_id of its class, linked directly or in a chain), n_links (rows whose
similarity to this one reaches the threshold, copies included), kept (one row of each class).

Defined cases: a null text counts as empty; all texts without words are one class (equal, nothing else links to
them); a row without identifier takes part, but gives a class its name only if no other row does (class_id is then
null); rows that repeat an identifier are rows like others; a very long text is one set in a block of few; an empty table
gives no rows; other columns, whatever their names, are ignored here and kept by ``keep_one``.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, bounded, components, factory, free, map_arrow, plain, prepare, whole_groups
from tidemark.llm.substring_dedup import Texts, _signed, _Words, join_hashes, window_hashes

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.999
SMALL, DEPTH, BLOCK, BINS, PEELS, PEEL_FROM = 256, 3, 512, 256, 2, 16
#: Bytes of the sets of a block, and of a table of sets that is broadcast.
BLOCK_BYTES, BROADCAST_BYTES = 16_000_000, 32_000_000
_TOP = 1 << 62  # nodes from here on stand for rows without an identifier of their own


def runs_for(recall: float, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has met with the asked recall."""
    alive = 1.0
    for _ in range(depth):
        alive = 1 - math.exp(-alive)
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


def shingle_sets(t: Texts, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h = window_hashes(t.low, words, 5)
    out = []
    for s, e in zip(t.starts.tolist(), t.ends.tolist(), strict=True):
        if e - s >= words:
            out.append(np.unique(h[s : e - words + 1]))
        elif e > s:
            out.append(window_hashes(t.low[s:e], e - s, 5 + e - s))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(seed)) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def _limits(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Hashes under this are chosen: a share of 1 / (threshold * size)."""
    share = np.minimum(1.0, 1.0 / (threshold * np.maximum(sizes, 1)))
    return np.minimum(share * 2.0**64, 2.0**64 - 2048).astype(np.uint64)


def described(docs: DataFrame, words: int, threshold: float, runs: int) -> DataFrame:
    """kid, th, row, digest, n (set size), sketch, paths of every row. A path's low byte is its token's bin."""
    prepare(docs.sparkSession)
    seeds = [int.from_bytes(hashlib.sha256(f"run {r}".encode()).digest()[:8], "little") for r in range(runs)]

    @factory
    def start():
        table = _Words()

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            t = Texts(b.column("text").to_pylist(), table)
            sets = shingle_sets(t, words)
            n = np.array([len(s) for s in sets], np.int64)
            all_ = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
            doc = np.repeat(np.arange(len(n)), n)
            bins = (all_ >> np.uint64(56)).astype(np.int64)
            place = doc * BINS + bins
            first = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else place
            sketch = np.zeros(len(n) * BINS, np.uint8)
            sketch[place[first]] = 1 + (all_[first] % np.uint64(255)).astype(np.uint8)
            limit = _limits(n, threshold)[doc]
            docs_, paths = [], []
            for seed in seeds:
                at = np.flatnonzero(_mix(all_, seed) < limit)
                docs_.append(doc[at])
                paths.append((_mix(all_[at], seed ^ 0x5BD1E995) & ~np.uint64(255)) | bins[at].astype(np.uint64))
            docs_, paths = np.concatenate(docs_), np.concatenate(paths)
            order = np.argsort(docs_, kind="stable")
            cuts = np.searchsorted(docs_[order], np.arange(len(n) + 1)).astype(np.int32)
            raw = sketch.tobytes()
            return pa.RecordBatch.from_arrays(
                [
                    b.column("kid"), b.column("th"), b.column("row"),
                    pa.array([hashlib.blake2b(b" ".join(w), digest_size=16).digest() for w in t.words], pa.binary()), pa.array(n),
                    pa.array([raw[i * BINS : (i + 1) * BINS] for i in range(len(n))], pa.binary()), pa.ListArray.from_arrays(pa.array(cuts), _signed(paths[order])),
                ],
                names=["kid", "th", "row", "digest", "n", "sketch", "paths"],
            )

        return step

    return map_arrow(docs, start, "kid long, th long, row long, digest binary, n long, sketch binary, paths array<long>")


def _sketches(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS)


def children(rows: DataFrame, threshold: float) -> DataFrame:
    """The next level of rows (node, path, used, sketch): tokens are (bin, value) of the sketch, without used bins."""

    def step(b: pa.RecordBatch) -> pa.RecordBatch | None:
        s = _sketches(b.column("sketch")).copy()
        used = b.column("used").to_pylist()
        for i, u in enumerate(used):
            s[i, list(u)] = 0
        path = b.column("path").to_numpy().view(np.uint64)
        with np.errstate(over="ignore"):
            token = np.arange(BINS, dtype=np.uint64)[None, :] * np.uint64(256) + s.astype(np.uint64)
            g = _mix(_mix(token, 0x1234567) ^ path[:, None], 0x7654321)
        limit = _limits((s > 0).sum(1), threshold)
        i, bin_ = np.nonzero((g < limit[:, None]) & (s > 0))
        if not len(i):
            return None
        new = (_mix(g[i, bin_], 0xABCDEF) & ~np.uint64(255)) | bin_.astype(np.uint64)
        node = b.column("node").to_numpy()[i]
        return pa.RecordBatch.from_arrays([pa.array(node), _signed(new), pa.array([used[k] + bytes([x]) for k, x in zip(i.tolist(), bin_.tolist(), strict=True)], pa.binary())], names=["node", "path", "used"])

    return map_arrow(rows.select("node", "path", "used", "sketch"), step, "node long, path long, used binary")


class _Roots:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def of(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, a: int, b: int) -> None:
        a, b = self.of(a), self.of(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _alike(s: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs the sketches nominate: estimates down to 4.5 standard deviations under the threshold."""
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), 100_000):
        a, b = s[i[at : at + 100_000]], s[j[at : at + 100_000]]
        union = BINS - ((a | b) == 0).sum(1)
        same = ((a == b) & (a > 0)).sum(1)
        margin = 4.5 * np.sqrt(threshold * (1 - threshold) / np.maximum(union, 1))
        out[at : at + 100_000] = same >= (threshold - margin) * union
    low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    return out & (low >= threshold * high - 1e-9) & (low > 0)


#: Sketches with so many filled bins tell a text near a pivot from one that is not: CORE is the estimate from which a
#: text counts as near (4.5 standard deviations: its distance is under 0.15 then), and REACH is how far under the
#: threshold the estimate of a text that links to such a near one may lie (0.15, and 4.5 deviations of its own).
FILLED, CORE, REACH = 100, 0.95, 0.362


def _around(s: np.ndarray, n: np.ndarray, live: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members nominated to the first one of ``live``, members as good as covered by it, and those left to compare.

    Whatever links to a covered member is nominated to the pivot too, so covered members need no other comparison.
    """
    pivot, rest = live[0], live[1:]
    a, b = s[pivot], s[rest]
    union = np.maximum(BINS - ((a | b) == 0).sum(1), 1)
    share = ((a == b) & (a > 0)).sum(1) / union
    low, high = np.minimum(n[pivot], n[rest]), np.maximum(n[pivot], n[rest])
    least = threshold - REACH
    margin = 4.5 * np.sqrt(threshold * (1 - threshold) / union)
    near = (low > 0) & (((share >= least) & (low >= least * high)) | ((share >= threshold - margin) & (low >= threshold * high - 1e-9)))
    covered = near & (share >= CORE) & (union >= FILLED)
    return rest[near], rest[covered], rest[~covered]


def nominated(rows: DataFrame, threshold: float, parts: int) -> DataFrame:
    """(a, b) edges of nominated texts in each bucket. rows: path, node, n, sketch, side.

    A bucket of one side gives an edge from each member to its root. One of two sides (two blocks of a large bucket,
    each a bucket of its own elsewhere) gives one edge where components of its sides meet.
    """

    def run(batches):
        for t in whole_groups(batches, "path"):
            path, node, n, side = (t.column(c).to_numpy() for c in ("path", "node", "n", "side"))
            s = _sketches(t.column("sketch"))
            cut = np.append(np.flatnonzero(np.append(True, path[1:] != path[:-1])), len(path)).tolist()
            inside, across, out = _Roots(len(path)), [], []

            def settle(i, j, s=s, n=n, side=side, inside=inside, across=across):
                i, j = np.concatenate(i), np.concatenate(j)
                ok = _alike(s, n, i, j, threshold)
                for a, b in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
                    if side[a] == side[b]:
                        inside.join(a, b)
                    else:
                        across.append((a, b))

            i, j, held = [], [], 0
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                live = np.arange(a, b)
                while len(live) > 32:  # many near one another: a comparison each, not one a pair
                    pivot, before = int(live[0]), len(live)
                    near, covered, left = _around(s, n, live, threshold)
                    if 20 * len(covered) < before:
                        break
                    for k in near.tolist():
                        if side[k] == side[pivot]:
                            inside.join(pivot, k)
                        else:
                            across.append((pivot, k))
                    live = left
                for x in range(len(live) - 1):
                    i.append(np.full(len(live) - x - 1, live[x]))
                    j.append(live[x + 1 :])
                    held += len(live) - x - 1
                    if held > 200_000:
                        settle(i, j)
                        i, j, held = [], [], 0
            if i:
                settle(i, j)
            single = np.ones(len(path), bool)  # rows of buckets of one side
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                single[a:b] = side[a] == side[a:b].min() == side[a:b].max()
            up = np.array([inside.of(k) for k in range(len(path))], np.int64)
            at = np.flatnonzero((up != np.arange(len(path))) & single)
            out += zip(node[at].tolist(), node[up[at]].tolist(), strict=True)
            met = _Roots(len(path))
            for a, b in across:
                a, b = int(up[a]), int(up[b])
                if met.of(a) != met.of(b):
                    met.join(a, b)
                    out.append((int(node[a]), int(node[b])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])

    sorted_ = rows.select("path", "node", "n", "sketch", "side").repartition(parts, "path").sortWithinPartitions("path")
    return sorted_.mapInArrow(run, "a long, b long").where("a <> b").distinct()


def exact_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix left x right: which pairs of sets reach the threshold."""
    use = np.concatenate([left, right])
    flat = np.concatenate([sets[k] for k in use])
    row = np.repeat(np.arange(len(use)), [len(sets[k]) for k in use])
    _, token, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1  # a token of one set alone is in no intersection
    number = np.cumsum(shared) - 1
    fine = shared[token]
    row, col = row[fine], number[token[fine]]
    both = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for at in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(col, [at, at + 4096])
        m = np.zeros((len(use), 4096), np.float32)
        m[row[a:b], col[a:b] - at] = 1
        both += m[: len(left)] @ m[len(left) :].T
    n = np.array([len(s) for s in sets], np.float64)
    both = both.astype(np.float64)
    return (both * (1 + threshold) >= threshold * (n[left][:, None] + n[right][None, :]) - 1e-6) & (both > 0)


def shingled(docs: DataFrame, words: int) -> DataFrame:
    """node, family, blocks, copies and the text's shingle set. docs: these and text."""

    @factory
    def start():
        table = _Words()

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingle_sets(Texts(b.column("text").to_pylist(), table), words)
            cuts = np.cumsum([0] + [len(x) for x in sets]).astype(np.int32)
            keep = [b.column(c) for c in ("node", "family", "blocks", "copies")]
            return pa.RecordBatch.from_arrays([*keep, pa.ListArray.from_arrays(pa.array(cuts), _signed(np.concatenate(sets)))], names=["node", "family", "blocks", "copies", "set"])

        return step

    return map_arrow(docs.select("node", "family", "blocks", "copies", "text"), start, "node long, family long, blocks int, copies long, set array<long>")


def verified(rows: DataFrame, threshold: float, parts: int) -> DataFrame:
    """(node, label, links): each member's root in its block pair and how many rows it links to there."""

    def run(batches):
        for t in whole_groups(batches, "group", rows=256):
            group, node, block, copies = (t.column(c).to_numpy() for c in ("group", "node", "block", "copies"))
            raw = t.column("set").combine_chunks()
            ends, flat = raw.offsets.to_numpy(), raw.values.to_numpy().view(np.uint64)
            cut = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group)).tolist()
            out = []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                _, first = np.unique(node[a:b], return_index=True)  # a row may come twice
                at = a + first
                if len(at) < 2:
                    continue
                sets = [flat[ends[k] : ends[k + 1]] for k in at]
                which = block[at]
                one, two = which.min(), which.max()
                left = np.flatnonzero(which == one)
                right = left if one == two else np.flatnonzero(which == two)
                if t.column("cross")[a].as_py() and one == two:
                    continue
                ok = exact_links(sets, left, right, threshold)
                if one == two:
                    np.fill_diagonal(ok, False)
                links = np.zeros(len(at), np.int64)
                links[left] += ok @ copies[at][right]
                if one != two:
                    links[right] += ok.T @ copies[at][left]
                roots = _Roots(len(at))
                # one step for each row of the matrix is enough: all that a row links to meets in that row
                for i in np.flatnonzero(ok.any(1)).tolist():
                    for j in np.flatnonzero(ok[i]).tolist():
                        roots.join(int(left[i]), int(right[j]))
                label = node[at][[roots.of(k) for k in range(len(at))]]
                some = links > 0
                out.append((node[at][some], label[some], links[some]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["node", "label", "links"])

    sorted_ = rows.repartition(parts, "group").sortWithinPartitions("group")
    return sorted_.mapInArrow(run, "node long, label long, links long")


def blocks_for(rows: str, longs: str, block: int) -> Column:
    """Into how many blocks sets go: of ``block`` rows and BLOCK_BYTES bytes on average."""
    return F.greatest(F.ceil(F.col(rows) / block), F.ceil(8 * F.col(longs) / BLOCK_BYTES), F.lit(1)).cast("int")


def in_blocks(rows: DataFrame) -> DataFrame:
    """(group, node, block, copies, cross, set): every pair of blocks of a family's rows meets in a group."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = F.xxhash64("family", F.least("block", "other"), F.greatest("block", "other"))
    return rows.select(group.alias("group"), "node", "block", "copies", (F.col("block") != F.col("other")).alias("cross"), "set")


def in_crossed_blocks(rows: DataFrame, size: DataFrame, families: int, block: int) -> DataFrame:
    """The same for pairs of a row of side 0 and one of side 1; pairs of one side do not meet. size: family, side, size, longs."""
    own = size.select("family", "side", blocks_for("size", "longs", block).alias("own"))
    other = own.select("family", (1 - F.col("side")).alias("side"), F.col("own").alias("others"))
    rows = rows.join(bounded(own.join(other, ["family", "side"]), 2 * families), ["family", "side"])
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("own")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    first, second = (F.when(F.col("side") == k, F.col("mine")).otherwise(F.col("other")) for k in (0, 1))
    return rows.select(F.xxhash64("family", first, second, F.lit("crossed")).alias("group"), "node", F.col("side").alias("block"), "copies", F.lit(True).alias("cross"), "set")


def peeled(scratch: Scratch, rows: DataFrame, threshold: float, block: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """One pivot for each family. rows: node, family, copies, set.

    Gives (node, label, links) of the links that are sure; blocks of the pairs that are open between the ball and what
    is outside but within reach of it; every node's place (node, family, n, kind: from 2 on outside the ball, where
    their own pairs are open); and the number of families.
    """
    far, eps = 1 - threshold, 1e-9
    pivot = rows.groupBy("family").agg(F.max(F.struct("copies", (-F.col("node")).alias("m"))).alias("k")).select("family", (-F.col("k.m")).alias("pivot"))
    pivots = rows.withColumn("pivot", F.col("node")).join(pivot, ["family", "pivot"]).select("family", "pivot", F.col("set").alias("around"))
    pivots = scratch.write(pivots, "pivots")
    families, longs = pivots.agg(F.count("*"), F.coalesce(F.sum(F.size("around")), F.lit(0))).first()
    both, all_ = F.size(F.array_intersect("set", "around")), F.size("set") + F.size("around")
    at = rows.join(bounded(pivots, 8 * longs, BROADCAST_BYTES), "family").select(
        "node", "family", "pivot", "copies", F.size("set").alias("n"), (1 - both / (all_ - both)).alias("d"), (both * (1 + threshold) >= threshold * all_ - 1e-6).alias("near"),
    )
    at = scratch.write(at, "distances")
    ball, d = F.col("d") <= far / 2 - eps, F.col("d")
    within = ~ball & (d <= 1.5 * far + eps)  # outside, but some text of the ball may be linked to it
    reach = at.groupBy("family").agg(F.max(F.when(within, d)).alias("most"), F.sum(F.when(ball, F.col("copies"))).alias("in_ball"), F.sum(F.when(within, F.col("copies"))).alias("within"))
    core = ball & (F.col("most").isNull() | (d <= far - F.col("most") - eps))  # linked to all within reach
    at = at.join(bounded(reach, families), "family").withColumn("kind", F.when(core, 0).when(ball, 1).when(within, 2).otherwise(3))
    at = scratch.write(at, "kinds")
    inner = at.where("kind = 0").groupBy("family").agg(F.sum("copies").alias("in_core"))
    known = at.join(bounded(inner, families), "family", "left")
    links = F.when(F.col("kind") == 0, F.col("in_ball") - F.col("copies") + F.coalesce("within", F.lit(0))).when(F.col("kind") == 1, F.col("in_ball") - F.col("copies")).when(F.col("kind") == 2, F.coalesce("in_core", F.lit(0))).otherwise(0)
    sure = known.select("node", F.when(F.col("near"), F.col("pivot")).otherwise(F.col("node")).alias("label"), links.alias("links"))
    sides = at.where("kind in (1, 2)").select("node", "family", "n", (2 - F.col("kind")).alias("side"))
    size = sides.groupBy("family", "side").agg(F.count("*").alias("size"), F.sum("n").alias("longs"))
    open_ = in_crossed_blocks(rows.drop("family").join(sides.select("node", "family", "side"), "node"), size, families, block)
    return sure, open_, at.select("node", "family", "n", "kind"), families


def linked(scratch: Scratch, small: DataFrame, large: DataFrame | None, threshold: float, parts: int, block: int, peel: int) -> DataFrame:
    """(node, label, links) of all links inside the families of rows (node, family, blocks, copies, set).

    Small families are compared pair by pair, large ones are peeled first until they are small.
    """
    out, todo = [], small
    for k in range(PEELS if large is not None else 0):
        rows = scratch.write(large, f"family-sets{k}")
        sure, open_, places, families = peeled(scratch, rows.drop("blocks"), threshold, block)
        out.append(scratch.write(sure, f"sure{k}"))
        out.append(scratch.write(verified(open_, threshold, parts), f"crossed{k}"))
        outside = places.where("kind >= 2")
        size = outside.groupBy("family").agg(F.count("*").alias("size"), F.sum("n").alias("longs"))
        size = size.select("family", "size", blocks_for("size", "longs", block).alias("blocks"))
        rest = rows.drop("blocks").join(outside.select("node"), "node", "left_semi").join(bounded(size, families), "family")
        again = k < PEELS - 1 and not size.where(F.col("size") > block * peel).isEmpty()
        names = ["node", "family", "blocks", "copies", "set"]
        todo = todo.unionByName(rest.where(F.col("size") <= block * peel).select(*names) if again else rest.select(*names))
        if not again:
            break
        large = rest.where(F.col("size") > block * peel).select(*names)
    links = scratch.write(verified(in_blocks(todo), threshold, parts), "compared")
    for more in out:
        links = links.unionByName(more)
    return links


def similar_texts(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, small: int = SMALL, depth: int = DEPTH, block: int = BLOCK, peel: int = PEEL_FROM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, class_id, n_links, kept, th (xxhash64 of the text)."""
    spark = docs.sparkSession
    prepare(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scratch = Scratch(spark, "chosen-path")
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("kid"), F.col(text_col).alias("text"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("th"))
    rows = scratch.write(described(docs.withColumn("row", F.monotonically_increasing_id()), words, threshold, runs_for(recall, depth)), "described")

    # nodes: texts with the same words; the row with the smallest identifier stands for them
    key = F.struct(F.when(F.col("kid") == -(2**63), 2**63 - 1).otherwise(F.col("kid")).alias("o"), "kid", "row")
    same = rows.select("digest", "kid", "row").groupBy("digest").agg(F.min(key).alias("k"), F.count("*").alias("copies")).select("digest", "k.kid", "k.row", "copies")
    same = scratch.write(same, "same")
    double = same.groupBy("kid").agg(F.count("*").alias("c")).where(f"c > 1 or kid = {-(2**63)}").select("kid")
    double = scratch.write(double, "double")
    own = F.col("kid")
    if not double.isEmpty():  # an identifier that names several texts, or none, cannot name a node
        same = same.join(double.withColumn("odd", F.lit(True)), "kid", "left")
        own = F.when(F.col("odd"), F.col("row") + _TOP).otherwise(F.col("kid"))
    nodes = scratch.write(same.select("digest", own.alias("node"), F.col("row").alias("first_row"), "copies"), "nodes")
    sets = rows.join(nodes.select("node", "first_row", "copies"), F.col("row") == F.col("first_row")).where("n > 0")
    sets = scratch.write(sets.select("node", "kid", "th", "n", "copies", "sketch", "paths"), "sets")

    # levels: buckets of two and more; large ones are split again
    level = sets.select("node", F.explode(F.array_distinct("paths")).alias("path")).withColumn("used", F.lit(None).cast("binary"))
    found = None
    for k in range(1, depth + 1):
        buckets = level.groupBy("path").agg(F.count("*").alias("size"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who")).where("size > 1")
        buckets = scratch.write(buckets, f"buckets{k}")
        chosen = buckets.where(F.col("size") <= small).groupBy("size", "who").agg(F.min("path").alias("path")).select("path")  # the same members once
        chosen = scratch.write(chosen, f"chosen{k}")
        members = level.select("node", "path").join(bounded(chosen, chosen.count()), "path", "left_semi").join(sets.select("node", "n", "sketch"), "node")
        edges = scratch.write(nominated(members.withColumn("side", F.lit(0)), threshold, parts), f"edges{k}")
        found = edges if found is None else found.unionByName(edges)
        hot = scratch.write(buckets.where(F.col("size") > small).select("path", "size"), f"hot{k}")
        n_hot = hot.count()
        if not n_hot:
            break
        inside = level.join(bounded(hot, n_hot), "path").join(sets.select("node", "n", "sketch"), "node")
        if k < depth:
            inside = inside.withColumn("used", F.coalesce("used", F.unhex(F.lpad(F.hex(F.col("path").bitwiseAND(255)), 2, "0"))))
            level = scratch.write(children(inside, threshold).distinct(), f"level{k + 1}")
            continue
        # still large at full depth: blocks against blocks
        nb = F.ceil(F.col("size") / (2 * block)).cast("int")
        inside = inside.withColumn("nb", nb).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other")
        inside = inside.select("node", "n", "sketch", "path", "mine", other)
        inside = inside.withColumns({"path": F.xxhash64("path", F.least("mine", "other"), F.greatest("mine", "other")), "side": F.col("mine")})
        edges = scratch.write(nominated(inside, threshold, parts), "edges-blocks")
        found = found.unionByName(edges)

    family = components(scratch, found)
    family = scratch.write(family.select("node", F.col("label").alias("family")), "families")
    # the root itself is no row of components(): count it in
    family = family.unionByName(family.select(F.col("family").alias("node"), "family").distinct())
    who = scratch.write(family.join(sets.select("node", "kid", "th", "copies", "n"), "node"), "members")
    size = scratch.write(who.groupBy("family").agg(F.count("*").alias("size"), F.sum("n").alias("longs")), "sizes")
    n_sizes = size.count()
    if n_sizes:
        size = size.select("family", "size", blocks_for("size", "longs", block).alias("blocks"))
        who = scratch.write(who.join(bounded(size, n_sizes), "family").select("node", "kid", "th", "copies", "family", "size", "blocks"), "placed")
        n = who.count()

        def own(of: DataFrame) -> DataFrame:
            return shingled(docs.join(bounded(of, n), ["kid", "th"]).select("node", "family", "blocks", "copies", "text"), words)

        few, many = who.where(F.col("size") <= block * peel), who.where(F.col("size") > block * peel)
        # a row that repeats identifier and text comes twice: groups see to that themselves, peeling needs each node once
        links = linked(scratch, own(few), None if many.isEmpty() else own(many).dropDuplicates(["node"]), threshold, parts, block, peel)
        degree = links.groupBy("node").agg(F.sum("links").alias("links"))
        label = components(scratch, links.select(F.col("node").alias("a"), F.col("label").alias("b")))
        label = scratch.write(degree.join(label, "node", "left").select("node", "links", F.coalesce("label", "node").alias("label")), "labels")
        placed = nodes.join(bounded(label, label.count()), "node", "left")
    else:
        placed = nodes.withColumns({"links": F.lit(0).cast("long"), "label": F.col("node")})
    placed = placed.select("digest", "first_row", "node", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "node").alias("label"))
    out = rows.select("digest", "kid", "row", "th").join(placed, "digest")
    none = F.lit(None).cast("long")
    return out.select(
        F.when(F.col("kid") == -(2**63), none).otherwise(F.col("kid")).alias("doc_id"), F.when(F.col("label") >= _TOP, none).otherwise(F.col("label")).alias("class_id"),
        (F.col("links") + F.col("copies") - 1).alias("n_links"), ((F.col("row") == F.col("first_row")) & (F.col("node") == F.col("label"))).alias("kept"), "th",
    )


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """One row of each class of near duplicates; all columns as they came. Rows of equal class_id 'kept' decide."""
    scratch = Scratch(docs.sparkSession, "near-keep-one")
    kid, th = keys = free(docs, "kid", "th")
    found = scratch.write(similar_texts(docs, **params).select(F.coalesce("doc_id", F.lit(-(2**63))).alias(kid), F.col("th").alias(th), "kept"), "found")
    # a row is known by its identifier and its text; rows alike in both are one text, of which one stays
    rows = found.groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.col("kept").cast("int")).alias("stays"))
    rows = scratch.write(rows.where("stays = 0 or n > 1"), "changed")
    gone, twice = rows.where("stays = 0").select(*keys), rows.where("stays = 1").select(*keys)
    marked = docs.withColumns({kid: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), th: F.coalesce(F.xxhash64("text"), F.lit(0))})
    left = marked.join(bounded(gone, gone.count()), keys, "left_anti")
    n = twice.count()
    if not n:
        return left.select(*plain(docs))
    once = left.join(bounded(twice, n), keys, "left_anti").select(*plain(docs))
    return once.unionByName(left.join(bounded(twice, n), keys, "left_semi").dropDuplicates(keys).select(*plain(docs)))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return similar_texts(docs).select("doc_id", "class_id", "n_links", "kept")


#: All pairs that share a shingle, their exact similarity, and components by a recursive walk.
OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pr AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
lk AS (
  SELECT x, y FROM pr JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE c * 9 >= 4 * (p.n + q.n)
  UNION ALL SELECT a.doc_id, b.doc_id FROM d a JOIN d b ON a.doc_id < b.doc_id WHERE len(a.w) = 0 AND len(b.w) = 0),
bi AS (SELECT x, y FROM lk UNION ALL SELECT y, x FROM lk),
re(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT re.doc_id, bi.y FROM re JOIN bi ON bi.x = re.r),
cl AS (SELECT doc_id, min(r) AS class_id FROM re GROUP BY 1),
ct AS (SELECT x AS doc_id, count(*) AS n_links FROM bi GROUP BY 1)
SELECT cl.doc_id, class_id, coalesce(n_links, 0) AS n_links, cl.doc_id = class_id AS kept FROM cl LEFT JOIN ct USING (doc_id)
"""

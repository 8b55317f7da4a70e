"""Similar documents by an exact join in the metric space of the Jaccard distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surfparc.llm.common import small, table
from surfparc.llm.textnum import LOWER, SPACE, U, buffers, mix, owner, portions, token_runs
from surfparc.operators.graph import components
from surfparc.session import cut

WIDTH, NUM, DEN = 3, 90, 100
RATIO = 1.25
LEAF = 32
PIVOTS = 8
REGION = 4_000_000
# Names of 64 bits that may mean several sets: n sets give about n * n / 2**65 such names, three of 10**10 sets.
CLASHES = 10_000
# Splits into parts that a set may try; subset keys of a set, if one shingle each isn't more; shingles that make a subset specific.
TRIES, SUBSETS, SPECIFIC = 4, 24, 5


class Sets:
    """Distinct shingle hashes of each text, text after text, ascending."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, width: int) -> None:
        n = len(offsets) - 1
        starts, _, _, word = token_runs((~SPACE[raw]).astype(np.uint8), offsets, LOWER[raw])
        row = owner(offsets, starts)
        count = np.bincount(row, minlength=n)
        h = np.zeros(len(word), np.uint64)
        for k in range(width):
            ahead = np.zeros(len(word), np.uint64)
            ahead[: max(len(word) - k, 0)] = word[k:]
            h = mix(h + ahead * U(2 * k + 1))
        last = np.cumsum(count)
        full = np.arange(len(word)) + width <= last[row] if len(word) else np.zeros(0, bool)
        brief = np.flatnonzero((count > 0) & (count < width))
        first = last - count
        alone = np.zeros(len(brief), np.uint64)
        for k in range(width - 1):
            there = count[brief] > k
            alone[there] = mix(alone[there] + word[first[brief[there]] + k] * U(2 * k + 3))
        rows = np.concatenate([row[full], brief])
        hashes = np.concatenate([h[full], mix(alone ^ U(0x5851F42D4C957F2D))])
        order = np.lexsort((hashes, rows))
        rows, hashes = rows[order], hashes[order]
        keep = np.ones(len(rows), bool)
        keep[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
        self.row, self.hash = rows[keep], hashes[keep]
        self.size = np.bincount(self.row, minlength=n)
        self.start = np.concatenate([[0], np.cumsum(self.size)])

    def total(self, values: np.ndarray) -> np.ndarray:
        """Sum of values over each text's shingles, modulo 2**64."""
        sums = np.concatenate([[U(0)], np.cumsum(values)])
        return sums[self.start[1:]] - sums[self.start[:-1]]

    def ids(self, clashing: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Two words that stand for a set; the first is its name, or the second where ``clashing`` names are known to mean several sets."""
        a, b = self.total(mix(self.hash)), self.total(mix(self.hash ^ U(0x2545F4914F6CDD1D)))
        name, check = mix(a + mix(b)).view(np.int64), mix(b ^ a).view(np.int64)
        return name if clashing is None else np.where(np.isin(name, clashing), check, name), check


def bands(most: int) -> list[tuple[int, int]]:
    """(smallest size, largest size + 1) of the bands of set sizes. Pairs belong to the band of their larger set."""
    out, lo = [], 1
    while lo <= most:
        hi = max(lo + 1, int(lo * RATIO))
        out.append((lo, hi))
        lo = hi
    return out


def most_differing(size: np.ndarray | int, hi: int, num: int, den: int) -> np.ndarray | int:
    """Most shingles in which a set of this size differs from one below ``hi`` that it is linked with."""
    return (size + np.minimum(hi - 1, size * den // num)) * (den - num) // (den + num)


@lru_cache(maxsize=4096)
def parts_of(lo: int, hi: int, num: int, den: int) -> int:
    """Number of parts for a band: the fewest of which, at any size, two standard deviations more than those that may differ or be weak remain."""
    sizes = np.array([max(1, lo * num // den), lo, hi - 1])
    differing = most_differing(sizes, hi, num, den)
    least = int(differing.max()) + 1
    if least == 1:
        return 1  # such small sets are linked only if equal
    best, best_spare = least, -np.inf
    for parts in range(least, 2 * least + 4):
        mean = sizes / parts
        weak = parts * np.exp(-mean) * (1 + mean)
        spare = float(((parts - 1 - differing - weak) / np.sqrt(weak + 1e-9)).min())
        if spare >= 2:
            return parts
        if spare > best_spare:
            best, best_spare = parts, spare
    return best


@lru_cache(maxsize=4096)
def subset_length(lo: int, hi: int, num: int, den: int) -> tuple[int, bool]:
    """Shingles per subset key in a band: the most that give no size over ``SUBSETS`` keys, one at least; and whether that is specific enough for all its sets."""
    shared = -(-lo * num // den)
    sizes = range(shared, hi)
    for length in range(shared, 0, -1):
        if all(comb(s - max(shared, -(-s * num // den)) + length, length) <= SUBSETS for s in sizes):
            return length, length >= min(SPECIFIC, shared)
    return 1, False


def part_keys(sets: Sets, inside: np.ndarray, parts: int, hi: int, seed: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the parts with two shingles or more, their rows, and the rows that have too few of them."""
    size = sets.size[inside]
    ends = np.cumsum(size)
    h = sets.hash[np.arange(ends[-1]) + np.repeat(sets.start[inside] - (ends - size), size)]
    scrambled = mix(h ^ seed)
    slot = np.repeat(np.arange(len(inside)), size) * parts + (scrambled % U(parts)).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    slot, value = slot[order], mix(scrambled[order])
    at = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
    total = np.add.reduceat(value, at)
    strong = np.diff(np.append(at, len(slot))) > 1
    cell, where = slot[at][strong], slot[at][strong] // parts
    weak = parts - np.bincount(where, minlength=len(inside))
    few = weak > parts - 1 - most_differing(size, hi, num, den)
    return mix(total[strong] + mix((cell % parts).astype(np.uint64) * U(4099) + seed)), inside[where], inside[few]


def subset_keys(sets: Sets, inside: np.ndarray, lo: int, length: int, seed: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the subsets of ``length`` shingles among the lowest, and their rows."""
    keys, rows = [], []
    for s in np.unique(sets.size[inside]).tolist():
        who = inside[sets.size[inside] == s]
        prefix = s - max(-(-lo * num // den), -(-s * num // den)) + length
        low = mix(sets.hash[sets.start[who][:, None] + np.arange(prefix)] ^ seed)
        pick = np.array(list(combinations(range(prefix), length)))
        total = np.zeros((len(who), len(pick)), np.uint64)
        for k in range(length):
            total += low[:, pick[:, k]]
        keys.append(mix(total + mix(seed)).ravel())
        rows.append(np.repeat(who, len(pick)))
    return np.concatenate(keys), np.concatenate(rows)


def cell_keys(sets: Sets, node: np.ndarray, rows: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, node) of the cells each set lies in.

    The shingle universe is split into parts by hash, more parts than a linked
    pair has differing shingles; so the pair's projections onto some part are
    equal, at distance zero from one pivot projection, and its sets share that
    cell. A set also goes to the cells of the next band if the size window of a
    link reaches there. Linked sets of sizes a and b differ in at most
    (a + b)(den - num) / (den + num) shingles. Only parts of two shingles or more
    give cells. One of them must be equal while the others and the parts that may
    differ are fewer than all, for either set of a pair. Sets for which they
    aren't go on to another split, ``TRIES`` in all: a pair meets in the first
    split in which one of its sets has enough.

    What still has too few, and all sets of bands where ``subset_length`` is
    specific, give the subsets of ``length`` shingles among their
    s - c + length lowest, where c is the least that a set of size s shares with
    a linked one: the ``length`` lowest shared shingles are such a subset of both.
    Bands whose sets are linked only if equal need no cells.
    """
    keys, nodes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    if not len(rows):
        return keys[0].view(np.int64), nodes[0]
    for number, (lo, hi) in enumerate(bands(int(sets.size.max()) * den // num + 1)):
        left = rows[(sets.size[rows] < hi) & (sets.size[rows] * den >= lo * num)]
        if not len(left) or most_differing(np.arange(-(-lo * num // den), hi), hi, num, den).max() == 0:
            continue
        seeds = mix(np.arange(TRIES + 1, dtype=np.uint64) * U(4099 * 4099) + U(number) + U(0x9E6C63D0876A9A35))
        length, specific = subset_length(lo, hi, num, den)
        for k in range(0 if specific else TRIES):
            key, row, left = part_keys(sets, left, parts_of(lo, hi, num, den), hi, seeds[k : k + 1], num, den)
            keys.append(key)
            nodes.append(node[row])
            if not len(left):
                break
        if len(left):
            key, row = subset_keys(sets, left, lo, length, seeds[TRIES:], num, den)
            keys.append(key)
            nodes.append(node[row])
    return np.concatenate(keys).view(np.int64), np.concatenate(nodes)


def describe(batches: Iterator[pa.RecordBatch], keys: int, width: int) -> Iterator[pa.RecordBatch]:
    """(key columns, text) to (key columns, n_shingles, node, check)."""
    for batch in batches:
        raw, offsets = buffers(batch.column(keys))
        size, node, check = [], [], []
        for lo, hi in portions(offsets):
            s = Sets(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width)
            a, b = s.ids()
            size.append(s.size)
            node.append(a)
            check.append(b)
        cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:keys], cat(size), cat(node), cat(check)], [*batch.schema.names[:keys], "n_shingles", "node", "check"])


def emit_keys(batches: Iterator[pa.RecordBatch], width: int, num: int, den: int, clashing: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """(text) to (key, node); a task passes each set on once."""
    seen = np.zeros(0, np.int64)
    for batch in batches:
        raw, offsets = buffers(batch.column(0))
        for lo, hi in portions(offsets):
            s = Sets(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width)
            node, _ = s.ids(clashing)
            _, first = np.unique(node, return_index=True)
            first = first[(s.size[first] > 0) & ~np.isin(node[first], seen)]
            seen = np.union1d(seen, node[first])
            key, owner_node = cell_keys(s, node, np.sort(first), num, den)
            if len(key):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(owner_node)], ["key", "node"])


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node) in order to (node, first node of the same key), one row of each in a batch."""
    key, lead = None, 0
    for batch in batches:
        k, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(k):
            continue
        new = np.append(key is None or k[0] != key, k[1:] != k[:-1])
        at = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
        leader = np.where(at < 0, lead, n[at])
        key, lead = k[-1], leader[-1]
        pairs = np.unique(np.stack([n, leader], 1)[n != leader], axis=0)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["src", "dst"])


class Region:
    """Sets that are joined in one task; ``root`` links what belongs together."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int, group: np.ndarray | None = None) -> None:
        self.size = np.array([len(s) for s in sets])
        self.start = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        universe, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(universe), bool)
        self.num, self.den, self.reach = num, den, 1 - num / den
        self.root = np.arange(len(sets))
        if group is not None:  # sets of equal group are linked already
            _, first, where = np.unique(group, return_index=True, return_inverse=True)
            self.root = first[where]

    def shared(self, members: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Shingles that each of ``others`` shares with the set of local shingle ids ``members``."""
        self.mark[members] = True
        size = self.size[others]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(self.start[others] - (ends - size), size)
        out = np.add.reduceat(self.mark[self.flat[at]], ends - size, dtype=np.int64)
        self.mark[members] = False
        return out

    def ids(self, i: int) -> np.ndarray:
        return self.flat[self.start[i] : self.start[i] + self.size[i]]

    def measure(self, i: int, others: np.ndarray) -> np.ndarray:
        """Distances of one set to others; links those within reach."""
        inter = self.shared(self.ids(i), others)
        union = self.size[i] + self.size[others] - inter
        near = others[self.den * inter >= self.num * union]
        for r in np.unique(self.root[near]):
            if r != self.root[i]:
                self.root[self.root == r] = self.root[i]
        return 1 - inter / union

    def centre(self, members: np.ndarray) -> int:
        """The set closest to the shingles that half of the members hold."""
        many = np.concatenate([self.ids(i) for i in members])
        count = np.bincount(many, minlength=len(self.mark))
        common = np.flatnonzero(2 * count > len(members))
        inter = self.shared(common, members)
        return int(members[np.argmax(inter / (len(common) + self.size[members] - inter))])

    def join(self, members: np.ndarray) -> None:
        """Link all pairs within reach: by pivots, Voronoi regions with their boundary, and recursion."""
        if len(members) < 2 or (self.root[members] == self.root[members[0]]).all():
            return
        chosen = [self.centre(members)] if len(members) > 2 else [int(members[0])]
        if len(members) > LEAF:
            chosen += [int(m) for m in members[:: max(1, len(members) // PIVOTS)] if m != chosen[0]]
        far = []
        for p in chosen:
            far.append(self.measure(p, members))
            if (self.root[members] == self.root[members[0]]).all():
                return
        rest = ~np.isin(members, chosen)
        far = np.array(far)[:, rest]
        members = members[rest]
        if not len(members):
            return
        home = far.argmin(0)
        window = far <= far.min(0) + 2 * self.reach + 1e-9
        regions = [members[window[k]] for k in range(len(chosen)) if (home == k).any()]
        if len(members) > LEAF and all(2 * len(r) < len(members) for r in regions):
            for r in regions:
                self.join(r)
            return
        # The windows don't divide this region: pair by pair, as far as the pivot distances leave pairs in question.
        for k in range(len(members) - 1):
            later = np.arange(k + 1, len(members))
            later = later[self.root[members[later]] != self.root[members[k]]]
            a, b = self.size[members[k]], self.size[members[later]]
            later = later[self.den * np.minimum(a, b) >= self.num * np.maximum(a, b)]
            later = later[(np.abs(far[:, later] - far[:, k, None]) <= self.reach + 1e-9).all(0)]
            if len(later):
                self.measure(int(members[k]), members[later])


def join_regions(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """(region, node, set, grp) sorted by region to (src, dst): each set and the first of those it is linked with."""
    held: list[pa.RecordBatch] = []

    def settle(rows: pa.Table) -> pa.RecordBatch:
        region, node, group = rows["region"].to_numpy(), rows["node"].to_numpy(), rows["grp"].to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in rows["set"].to_pylist()]
        edges = np.append(np.flatnonzero(np.append(True, region[1:] != region[:-1])), len(region)).tolist()
        src, dst = [], []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a > 1:
                r = Region(sets[a:b], num, den, group[a:b])
                r.join(np.arange(b - a))
                linked = np.flatnonzero(r.root != np.arange(b - a))
                src.append(node[a + linked])
                dst.append(node[a + r.root[linked]])
        cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        return pa.RecordBatch.from_arrays([cat(src), cat(dst)], ["src", "dst"])

    for batch in batches:
        held.append(batch)
        rows = pa.Table.from_batches(held)
        region = rows["region"].to_numpy()
        whole = int(np.searchsorted(region, region[-1], side="left")) if len(region) else 0
        if whole:
            yield settle(rows.slice(0, whole))
            held = rows.slice(whole).combine_chunks().to_batches()
    if held:
        yield settle(pa.Table.from_batches(held))


def shingle_sets(batches: Iterator[pa.RecordBatch], width: int, clashing: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """(region, node, text) to (region, node, size, set); rows whose text isn't the node's are dropped."""
    for batch in batches:
        raw, offsets = buffers(batch.column(2))
        want = batch.column(1).to_numpy()
        for lo, hi in portions(offsets):
            s = Sets(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width)
            node, _ = s.ids(clashing)
            ok = np.flatnonzero(node == want[lo:hi])
            sets = [s.hash[s.start[i] : s.start[i + 1]].tobytes() for i in ok]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + ok)), pa.array(node[ok]), pa.array(s.size[ok].astype(np.int64)), pa.array(sets, pa.binary())], ["region", "node", "size", "set"])


def divide(rows: DataFrame, limit: int, num: int, den: int) -> tuple[DataFrame, list[DataFrame]]:
    """Regions of more than ``limit`` shingles, divided until none is: (small regions, links found on the way).

    Each set carries the group of sets it is known to be linked with. A round
    draws pivots anew from all groups but a region's largest: 63, each round four
    times as many, up to ``limit / 2`` shingles. They measure every set in salted
    groups of bounded size, link what is within reach and leave, as they have met
    everything. A region is done when one group is left: pairs within a group need
    no comparison, and all other pairs had a pivot. Where the windows of the
    triangle inequality around the first 63 pivots divide a region, each set goes
    to the region of its nearest pivot and to those whose window holds it; else
    the region goes on as one.
    """
    small_ones, links, turn = [], [], 0
    reach = 1 - num / den
    schema = "region long, node long, size long, set binary, grp long, pivot boolean, linked array<bigint>, homes array<bigint>"

    def meet(members: pa.Table, pivots: pa.Table) -> pa.Table:
        order = np.argsort(pivots["node"].to_numpy()) if pivots.num_rows else np.zeros(0, np.int64)
        names = pivots["node"].to_numpy()[order]
        chosen = [np.frombuffer(pivots["set"][int(k)].as_py(), np.uint64) for k in order]
        sizes = np.array([len(p) for p in chosen], np.int64)
        flat = np.concatenate([*chosen, np.zeros(0, np.uint64)])
        place = np.argsort(flat, kind="stable")
        holder = np.repeat(np.arange(len(chosen)), sizes)[place]
        universe, first = np.unique(flat[place], return_index=True)
        edges = np.append(first, len(flat))
        lead = pivots["grp"].to_numpy()[order].copy()  # of each pivot, as joined in this task
        above: dict[int, int] = {}

        def top(g: int) -> int:
            while g in above:
                g = above[g]
            return g

        taken, out = set(names.tolist()), {"pivot": [], "linked": [], "homes": []}
        for node, grp, data in zip(members["node"].to_pylist(), members["grp"].to_pylist(), members["set"].to_pylist(), strict=True):
            own = np.frombuffer(data, np.uint64)
            at = np.searchsorted(universe, own)
            held = np.flatnonzero(at < len(universe))
            at = at[held[universe[at[held]] == own[held]]]
            count = edges[at + 1] - edges[at]
            spot = np.arange(count.sum()) + np.repeat(edges[at] - (np.cumsum(count) - count), count)
            inter = np.bincount(holder[spot], minlength=len(chosen))
            union = len(own) + sizes - inter
            linked = []
            for g in np.unique(lead[den * inter >= num * union]).tolist():
                a = top(grp)
                if g != a:
                    linked.append(g)
                    above[g] = a
                    lead[lead == g] = a
            far = 1 - inter[:63] / union[:63]
            out["pivot"].append(node in taken)
            out["linked"].append(linked)
            out["homes"].append(names[:63][far <= far.min(initial=2) + 2 * reach + 1e-9].tolist())
        kinds = {"pivot": pa.bool_(), "linked": pa.list_(pa.int64()), "homes": pa.list_(pa.int64())}
        kept = {c: members[c] for c in ("region", "node", "size", "set", "grp")}
        return pa.table({**kept, **{c: pa.array(v, kinds[c]) for c, v in out.items()}})

    rows = rows.withColumn("grp", F.col("node"))
    while True:
        rows = cut(rows)
        groups = rows.groupBy("region", "grp").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("heft"))
        heft = groups.groupBy("region").agg(F.sum("heft").alias("heft"), F.sum("m").alias("m"), F.max(F.struct("m", "heft", "grp")).alias("main"))
        weighed = rows.join(cut(heft.filter(F.col("m") > F.col("main.m"))), "region")
        small_ones.append(weighed.filter(F.col("heft") <= limit).select("region", "node", "size", "set", "grp"))
        large = weighed.filter(F.col("heft") > limit).withColumn("salts", F.ceil(F.col("heft") / limit).cast("int") * 4)
        if large.isEmpty():
            break
        others = F.col("m") - F.col("main.m")
        most = F.greatest(F.lit(8.0), F.least(F.lit(63.0 * 4.0**turn), others * (limit / 2) / (F.col("heft") - F.col("main.heft"))))
        place = (F.shiftright(F.xxhash64("node", F.lit(turn)), 1) + F.lit(2**62)) / F.lit(float(2**63))
        drawn = large.filter((F.col("grp") != F.col("main.grp")) & (place * others < most))
        pivots = cut(drawn.select("region", "node", "set", "grp", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")))
        salted = large.withColumn("salt", F.pmod(F.xxhash64("node", F.lit("salt")), F.col("salts")).cast("int")).select("region", "salt", "node", "size", "set", "grp")
        met = cut(salted.groupBy("region", "salt").cogroup(pivots.groupBy("region", "salt")).applyInArrow(meet, schema))
        link = cut(met.select(F.col("grp").alias("src"), F.explode("linked").alias("dst")).distinct())
        going = met.filter(~F.col("pivot"))
        if not link.isEmpty():
            links.append(link)
            merged = groups_of(link).select(F.col("node").alias("grp"), "group")
            going = going.join(merged, "grp", "left").withColumn("grp", F.coalesce("group", "grp"))
        widest = going.select("region", F.explode("homes").alias("home")).groupBy("region", "home").count().groupBy("region").agg(F.max("count").alias("widest"), F.sum("count").alias("total"))
        fate = widest.join(going.groupBy("region").agg(F.count(F.lit(1)).alias("left")), "region")
        fate = cut(fate.select("region", ((F.col("total") <= 2 * F.col("left")) & (2 * F.col("widest") < F.col("left"))).alias("divides")))
        child = F.when(F.col("divides"), F.transform("homes", lambda h: F.xxhash64("region", h))).otherwise(F.array("region"))
        rows = going.join(fate, "region", "left").select(F.explode(child).alias("region"), "node", "size", "set", "grp")
        turn += 1
    out = small_ones[0]
    for s in small_ones[1:]:
        out = out.unionByName(s)
    return out, links


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def groups_of(edges: DataFrame) -> DataFrame:
    """(node, group) of all ends of the edges."""
    e = cut(both_ways(edges))
    found = components(e.select(F.col("src").alias("v")).distinct().withColumn("label", F.lit(1)), e, [])
    return found.select(F.col("v").alias("node"), F.col("comp").alias("group"))


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, num: int = NUM, den: int = DEN, region: int = REGION) -> DataFrame:
    """Per row of ``docs``: ``key``, n_shingles and component_id.

    A text's set holds its distinct runs of ``width`` lower-cased words (one run,
    if there are fewer). Sets are linked if ``den * intersection >= num * union``;
    a component is what links connect, named by its smallest ``key``.

    1. Rows with equal sets become one node, named by 64 bits. Names that mean
       several sets, by another 64 bits, are few (``CLASHES``) and give way to those.
    2. Equal projections onto parts of the shingle universe, or equal subsets of
       the lowest shingles, gather every linked pair in a cell (``cell_keys``); cells chain nodes into regions, and only
       nodes with company go on.
    3. Each region is joined exactly: pivots, Voronoi regions with all documents
       in the triangle-inequality window of twice the reach, recursion
       (``Region.join``). Regions too large for a task are divided in the same
       way by Spark jobs first (``divide``).

    Null, empty and blank texts have no shingles and are their own component; so
    is a null key without smaller company. Repeated rows and repeated keys are
    kept; other columns are ignored; no rows give no rows.
    """
    kind = docs.schema[key].dataType.simpleString()
    slim = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    rows = cut(slim.mapInArrow(lambda it: describe(it, 1, width), f"k {kind}, n_shingles long, node long, check long"))
    named_by = lambda r: cut(r.filter("n_shingles > 0").groupBy("node").agg(F.min("k").alias("first"), F.min("check").alias("c0"), F.max("check").alias("c1")))
    nodes, clashing = named_by(rows), None
    twice = nodes.filter("c0 <> c1").select("node")
    if not twice.isEmpty():
        clashing = np.array([r.node for r in twice.limit(CLASHES + 1).collect()], np.int64)
        if len(clashing) > CLASHES:
            raise ValueError(f"more than {CLASHES} names of 64 bits mean several shingle sets")
        rows = cut(rows.withColumn("node", F.when(F.col("node").isin(clashing.tolist()), F.col("check")).otherwise(F.col("node"))))
        nodes = named_by(rows)
        if not nodes.filter("c0 <> c1").isEmpty():
            raise ValueError("the second name of a shingle set is another's name")
    keys = slim.select("t").mapInArrow(lambda it: emit_keys(it, width, num, den, clashing), "key long, node long")
    near = cut(keys.repartition("key").sortWithinPartitions("key", "node").mapInArrow(neighbours, "src long, dst long").distinct())
    regions = groups_of(near).select("node", F.col("group").alias("region"))
    wanted = small(cut(regions.join(nodes.select("node", "first"), "node")))
    texts = slim.join(wanted, F.col("k").eqNullSafe(F.col("first"))).select("region", "node", "t")
    sets = cut(texts.mapInArrow(lambda it: shingle_sets(it, width, clashing), "region long, node long, size long, set binary")).dropDuplicates(["region", "node"])
    ready, links = divide(sets, region, num, den)
    found = ready.repartition("region").sortWithinPartitions("region", "node").mapInArrow(lambda it: join_regions(it, num, den), "src long, dst long")
    for extra in links:
        found = found.unionByName(extra)
    joined = groups_of(found)
    named = nodes.join(joined, "node", "left").withColumn("group", F.coalesce("group", "node"))
    least = named.groupBy("group").agg(F.min("first").alias("component"))
    labels = named.join(least, "group").select("node", "component")
    return rows.join(labels, "node", "left").select(
        F.col("k").alias(key), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("k")).alias("component_id")
    )


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the documents whose 3-word shingle sets overlap by 90 in 100."""
    return similar_groups(table(spark, sf_dir, "documents"))

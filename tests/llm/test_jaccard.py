import random

import numpy as np
import pytest

from surfparc.llm import jaccard
from surfparc.llm.jaccard import Region, divide, groups_of, similar_groups
from tests.llm.helpers import ODD, documents, sentence, spaced_words


def brute(ids, texts, width, num, den):
    sets = []
    for t in texts:
        w = spaced_words(t)
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k in range(len(sets)):
        least[find(k)] = min(least.get(find(k), ids[k]), ids[k])
    return {ids[k]: (len(sets[k]), least[find(k)]) for k in range(len(sets))}


def texts():
    rng = random.Random(9)
    out = []
    for n in (5, 12, 40, 150):
        base = sentence(rng, n).split()
        for edits in (0, 1, 1, 2, 3, 6):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(n)] = f"new{rng.randrange(999)}"
            out.append(" ".join(w))
    lines = sentence(rng, 50)
    out += [lines + " " + sentence(rng, 60) for _ in range(6)]
    return [*out, out[3], out[3].upper(), *ODD, None, "one two", "ONE\ntwo", "two one"]


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80)])
def test_components_match_brute_force(spark, width, num):
    t = texts()
    ids = [100 - k for k in range(len(t))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_groups(documents(spark, t, ids), width=width, num=num).collect()}
    assert got == brute(ids, t, width, num, 100)


def test_large_regions_are_divided(spark):
    t = texts()[12:18]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_groups(documents(spark, t), width=3, num=60, region=100).collect()}
    assert got == brute(list(range(len(t))), t, 3, 60, 100)


def few_rounds(monkeypatch, most):
    """Stop ``divide`` if it writes more tables than ``most``."""
    real, calls = jaccard.cut, []

    def counted(df):
        calls.append(1)
        assert len(calls) <= most, "too many rounds"
        return real(df)

    monkeypatch.setattr(jaccard, "cut", counted)


def divided_groups(spark, sets, region):
    rows = [(0, k, len(s), bytearray(np.sort(s).tobytes())) for k, s in enumerate(sets)]
    ready, links = divide(spark.createDataFrame(rows, "region long, node long, size long, set binary"), region, 80, 100)
    found = ready.repartition("region").sortWithinPartitions("region", "node").mapInArrow(lambda it: jaccard.join_regions(it, 80, 100), "src long, dst long")
    for link in links:
        found = found.unionByName(link)
    out = {}
    for r in groups_of(found).collect():
        out.setdefault(r.group, set()).add(r.node)
    return sorted(sorted(g) for g in out.values())


def test_region_of_unlinked_sets_is_divided_in_few_rounds(spark, monkeypatch):
    rng = np.random.default_rng(4)
    sets = list(rng.integers(0, 2**63, (3000, 8), dtype=np.uint64))
    for a, b in ((5, 2900), (1200, 1201)):
        sets[b] = np.append(sets[a], rng.integers(0, 2**63, dtype=np.uint64))
    few_rounds(monkeypatch, 120)
    assert divided_groups(spark, sets, 8000) == [[5, 2900], [1200, 1201]]


def test_region_of_near_copies_with_outsiders_ends(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    sets = []
    for k in range(1500):
        s = base.copy()
        s[rng.integers(0, 40)] = rng.integers(0, 2**63, dtype=np.uint64)
        if k % 100 == 7:
            s[:20] = rng.integers(0, 2**63, 20, dtype=np.uint64)
        sets.append(s)
    few_rounds(monkeypatch, 60)
    assert divided_groups(spark, sets, 8000) == [[k for k in range(1500) if k % 100 != 7]]


def arranged(sets):
    """``Sets`` of given shingles."""
    s = object.__new__(jaccard.Sets)
    s.size = np.array([len(x) for x in sets])
    s.start = np.concatenate([[0], np.cumsum(s.size)])
    s.row, s.hash = np.repeat(np.arange(len(sets)), s.size), np.concatenate([np.sort(x) for x in sets])
    return s


@pytest.mark.parametrize(("num", "sizes"), [(80, (*range(1, 26), 40, 80)), (90, (*range(1, 32), 80)), (50, range(1, 16)), (30, range(1, 10))])
def test_cells_hold_every_linked_pair_and_no_strangers(num, sizes):
    rng = np.random.default_rng(num)
    new = lambda n: rng.integers(0, 2**63, n, dtype=np.uint64)
    sets = []
    for n in sizes:
        for _ in range(6):
            a = new(n)
            for add in range(0, n, 1 + n // 12):
                for drop in {0, add, n * (100 - num) // 100} - {n}:
                    if 100 * (n - drop) >= num * (n + add) and (add or drop):
                        sets += [a, np.concatenate([rng.permutation(a)[drop:], new(add)])]
            sets += [new(n), new(n)]
    s = arranged(sets)
    key, node = jaccard.cell_keys(s, np.arange(len(sets)), np.arange(len(sets)), num, 100)
    cells = {}
    for k, v in zip(key.tolist(), node.tolist(), strict=True):
        cells.setdefault(k, set()).add(v)
    together = {(a, b) for c in cells.values() for a in c for b in c if a < b}
    for a in range(len(sets) - 1):
        inter = len(np.intersect1d(sets[a], sets[a + 1]))
        if len(sets[a]) + len(sets[a + 1]) > 2 * inter and 100 * inter >= num * (len(sets[a]) + len(sets[a + 1]) - inter):
            assert (a, a + 1) in together
    for a, b in together:
        assert np.isin(sets[a], sets[b]).any()


def test_region_recursion_links_every_near_pair():
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 2**63, 60, dtype=np.uint64)
        for _ in range(12):
            s = base.copy()
            s[rng.integers(0, 60, rng.integers(0, 9))] = rng.integers(0, 2**63, dtype=np.uint64)
            sets.append(np.unique(s))
    region = Region(sets, 90, 100)
    region.join(np.arange(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            inter = len(np.intersect1d(sets[a], sets[b]))
            if 100 * inter >= 90 * (len(sets[a]) + len(sets[b]) - inter):
                assert region.root[a] == region.root[b]


def test_nulls_repeats_and_empty_table(spark):
    rows = similar_groups(documents(spark, ["a b c d", "a b c d", None, ""], [None, 4, None, 4])).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str) == sorted([(None, 2, 4), (4, 2, 4), (None, 0, None), (4, 0, 4)], key=str)
    assert similar_groups(documents(spark, [])).count() == 0


def test_sets_that_share_a_name_take_the_second():
    s = jaccard.Sets(np.frombuffer(b"a b c da b e f", np.uint8), np.array([0, 7, 14]), 3)
    name, check = s.ids()
    again, same = s.ids(name[:1])
    assert again.tolist() == [check[0], name[1]] and same.tolist() == check.tolist()


def test_join_over_clashing_names(spark, monkeypatch):
    def few(self, clashing=None):
        import numpy as np

        from surfparc.llm.textnum import mix

        name, check = (self.total(self.hash) % np.uint64(2)).view(np.int64), mix(self.total(mix(self.hash))).view(np.int64)
        return name if clashing is None else np.where(np.isin(name, clashing), check, name), check

    def short(step):
        def run(*args):  # in the worker
            from surfparc.llm import jaccard as there

            usual, there.Sets.ids = there.Sets.ids, few
            try:
                yield from getattr(there, step)(*args)
            finally:
                there.Sets.ids = usual

        return run

    rng = random.Random(21)
    base = sentence(rng, 40).split()
    docs = documents(spark, [" ".join(base), " ".join(base[:-1]), "alone " + sentence(rng, 30), sentence(rng, 20), "", " ".join(base), None])
    rows = lambda: sorted((r.doc_id, r.n_shingles, r.component_id) for r in similar_groups(docs).collect())
    want = rows()
    for step in ("describe", "emit_keys", "shingle_sets"):
        monkeypatch.setattr(jaccard, step, short(step))
    assert rows() == want and [c for _, _, c in want] == [0, 0, 2, 3, 4, 0, 6]
    monkeypatch.setattr(jaccard, "CLASHES", 1)
    with pytest.raises(ValueError, match="more than 1 names"):
        rows()

import random
import re

import numpy as np
import pytest

from lodestar.llm import jaccard_join
from lodestar.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def brute(rows, width, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(lower))
        sets.append(frozenset(zip(*[w[k:] for k in range(width)])) if len(w) >= width else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    group = {}
    for i, (doc, _) in enumerate(rows):
        group.setdefault(find(i), []).append(doc)
    return sorted((doc, len(sets[i]), min(group[find(i)])) for i, (doc, _) in enumerate(rows))


def near_groups(seed, groups=4, copies=40, words=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(25)]
    rows = []
    for g in range(groups):
        base = [word() for _ in range(words)]
        if g % 2:
            base[5:5] = passage
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(own))
                rng.choice([lambda: own.__setitem__(at, word()), lambda: own.insert(at, word()), lambda: own.pop(at)])()
            rows.append(" ".join(own))
    rows += [" ".join([word() for _ in range(12)] + passage) for _ in range(30)]
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 3, 90), (2, 3, 90), (3, 5, 80)])
def test_components_are_those_of_all_pairs(spark, seed, width, percent):
    rows = near_groups(seed) + [(900, None), (901, ""), (902, "A b"), (903, "a  B"), (904, "x"), (905, " \t"), (906, "x y z w v" * 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.link_components(docs, width=width, percent=percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, width, percent)


def test_hot_tokens_and_large_buckets(spark, monkeypatch):
    rows = near_groups(5) + [(500 + i, t) for i, (_, t) in enumerate(near_groups(6, groups=1, copies=60))]
    want = brute(rows, 3, 90)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for hot, bucket in ((3, 4096), (1 << 40, 5)):
        monkeypatch.setattr(jaccard_join, "HOT_DOCUMENTS", hot)
        monkeypatch.setattr(jaccard_join, "BUCKET_ROWS", bucket)
        got = jaccard_join.link_components(docs, width=3, percent=90).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_counters_bound_the_overlap():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)) for n in (0, 1, 5, 90, 700, 5000)]
    sets += [np.unique(np.concatenate([s[: len(s) * 9 // 10], sets[4][:60]])) for s in sets]
    a, b = zip(*[(x, y) for x in sets for y in sets], strict=True)
    most = jaccard_join._most_overlap([jaccard_join._counters(x) for x in a], [jaccard_join._counters(y) for y in b])
    exact = [len(np.intersect1d(x, y)) for x, y in zip(a, b, strict=True)]
    assert all(e <= m <= min(len(x), len(y)) for e, m, x, y in zip(exact, most, a, b, strict=True))


def test_empty_table_and_extra_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n int, sig string, prefix string")
    assert jaccard_join.op10_jaccard_join(docs).count() == 0
    same_id = [(4, "one two three four five six"), (4, "One two three four five six"), (4, "one two three four five six"), (9, "one two three four five six seven")]
    got = jaccard_join.link_components(spark.createDataFrame(same_id, "doc_id long, text string"), width=2, percent=60).collect()
    assert sorted(map(tuple, got)) == [(4, 5, 4), (4, 5, 4), (4, 5, 4), (9, 6, 4)]
    docs = spark.createDataFrame([(1, "a b c d", 5, "s"), (2, "a b c d", 6, "t"), (2, "a b c d", 6, "t")], "doc_id long, text string, n int, sig string")
    assert sorted(map(tuple, jaccard_join.op10_jaccard_join(docs).collect())) == [(1, 2, 1), (2, 2, 1), (2, 2, 1)]


def test_components_of_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_rows_without_id_are_bridges(spark):
    w = [f"w{k}" for k in range(300)]
    texts = [w, w[6:] + ["x1"], w[12:] + ["x2"], ["other", *w[100:]]]  # the middle one links two that don't
    rows = [(7, " ".join(texts[0])), (None, " ".join(texts[1])), (None, " ".join(texts[1])), (3, " ".join(texts[2])), (None, " ".join(texts[3])), (None, "a b c")]
    assert [r[2] for r in brute([(k, " ".join(t)) for k, t in enumerate(texts)], 3, 96)] == [0, 0, 0, 3]
    assert [r[2] for r in brute([(k, " ".join(t)) for k, t in enumerate([texts[0], texts[2]])], 3, 96)] == [0, 1]
    got = jaccard_join.link_components(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=96).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [
        (0, 1, 0), (0, 199, 0), (0, 293, 3), (0, 293, 3), (3, 287, 3), (7, 298, 3)]

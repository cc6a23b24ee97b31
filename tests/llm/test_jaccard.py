"""Cells of the Jaccard join, digests that collide, and the list of frequent shingles."""

import random
import time

import numpy as np


def parts_of(linked):
    """The least member of each member's component."""
    root = np.arange(len(linked))
    while True:
        new = np.where(linked | np.eye(len(linked), dtype=bool), root[None, :], len(root)).min(1)
        if (new == root).all():
            return root
        root = new


def brute(members):
    return np.array([[4 * len(np.intersect1d(a, b)) >= 3 * len(np.union1d(a, b)) for b in members] for a in members])


def test_link_matrix():
    from sedimenta.llm.jaccard_join import link_matrix

    rng = np.random.default_rng(0)
    base = rng.integers(1, 1 << 62, 60, dtype=np.uint64)
    members = [np.unique(np.concatenate([base[rng.random(60) < p], rng.integers(1, 1 << 62, int(rng.integers(1, 12)), dtype=np.uint64)])) for p in rng.choice([0.5, 0.9, 0.97], 90)]
    want = brute(members)
    other = ~np.eye(90, dtype=bool)  # a set is not compared with itself
    assert want.sum() > 200 and (link_matrix(members) == want)[other].all()
    assert (link_matrix(members[:30], members[30:]) == want[:30, 30:]).all()


def test_cells_of_near_and_far_members():
    """Clusters around several centres, more members than one part holds."""
    from sedimenta.llm import jaccard_join as j

    rng = np.random.default_rng(3)
    members = []
    for c in range(4):
        base = rng.integers(1, 1 << 62, 80, dtype=np.uint64)
        for _ in range([400, 250, 100, 20][c]):
            x = base.copy()
            k = rng.random(80) < rng.choice([0.02, 0.08, 0.25])
            x[k] = rng.integers(1, 1 << 62, int(k.sum()), dtype=np.uint64)
            members.append(np.unique(x))
    f = j.Forest(len(members))
    j.join_cell(members, f)
    assert [f.find(x) for x in range(len(members))] == parts_of(brute(members)).tolist()
    assert len(f.links) == len(members) - len({f.find(x) for x in range(len(members))})


def templated(n, lines, variants, seed):
    """Texts of many lines, each one of a few variants: all alike to about one half."""
    rng = random.Random(seed)
    pool = [[" ".join(f"w{line}{v}{k}" for k in range(8)) for v in range(variants)] for line in range(lines)]
    return [(d, "\n".join(p[0 if rng.random() < 0.84 else rng.randrange(1, variants)] for p in pool)) for d in range(n)]


def test_templated_texts(spark):
    """All pairs of a cell are about as far from each other: exact, and the time stays bounded."""
    from sedimenta.llm import jaccard_join as j

    rows = templated(600, 60, 4, 1)
    words = [t.split() for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in words]
    number = {}
    members = [np.unique(np.array([number.setdefault(g, len(number) + 1) for g in s], np.uint64)) for s in sets]
    root = parts_of(brute(members))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    began = time.time()
    assert {r["doc_id"]: r["component_id"] for r in j.similar(docs).collect()} == dict(enumerate(root.tolist()))
    assert time.time() - began < 60


def test_large_cells_finish():
    """Members at like distances from each other are compared directly, each pair once."""
    from sedimenta.llm import jaccard_join as j

    rng = np.random.default_rng(5)
    pool = rng.integers(1, 1 << 62, (60, 4, 8), dtype=np.uint64)
    pick = np.where(rng.random((3000, 60)) < 0.84, 0, rng.integers(1, 4, (3000, 60)))
    members = [np.unique(pool[np.arange(60), p].ravel()) for p in pick]
    f, began = j.Forest(3000), time.time()
    j.join_cell(members, f)
    assert time.time() - began < 60
    small = [f.find(x) for x in range(3000)]
    for a in range(0, 3000, 300):
        for b in range(3000):
            both = int((pick[a] == pick[b]).sum()) * 8
            assert 7 * both < 3 * 960 or small[a] == small[b]


def test_shared_digests_are_told_apart():
    from sedimenta.llm import jaccard_join as j

    h = np.array([1, 2, 3, 4, 5, 3, 4, 5], np.uint64)
    at = np.array([0, 2, 5, 8, 8])
    point, check = j.digests(h, at)
    assert point[1] == point[2] and check[1] == check[2] and point[0] != point[1] and point[3] == 0
    again, _ = j.digests(h, at, point[1:2])
    assert again[0] == point[0] and again[1] == again[2] == point[1] ^ check[1] and again[3] == 0


def test_frequent_list_is_filled(spark):
    """Where more shingles share a count than the list has room for, a part of them is on it."""
    from sedimenta.llm import jaccard_join as j
    from sedimenta.llm.tables import Scratch

    line = " ".join(f"w{k}" for k in range(204))
    top = " ".join(f"v{k}" for k in range(54))
    texts = spark.createDataFrame([(f"{line} {d}",) for d in range(8)] + [(f"{top} {d}",) for d in range(40)], "text string").coalesce(1)
    s, n = j.frequent(texts, Scratch(spark), 150)
    assert (n == 40).sum() == 50 and 60 < (n == 8).sum() < 140 and (np.diff(s.astype(float)) > 0).all()
    assert j.frequent(texts.limit(0), Scratch(spark), 150)[0].size == 0

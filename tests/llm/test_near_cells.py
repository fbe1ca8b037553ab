"""Large buckets dealt in cells, short sketches and hot classes of the near-duplicate stage."""

import random

import numpy as np
from test_models import brute_near, edited

from presswork.llm import simhash
from presswork.llm.common import joined_on_hot


def drifting(seed, groups, members, words):
    """Groups of edited copies whose base drifts, over one common passage: pairs far below, around and above 0.8 in the same buckets."""
    rng = random.Random(seed)
    passage, texts = [f"p{k}" for k in range(30)], []
    for g in range(groups):
        base = [f"g{g}b{rng.randint(0, 4000)}" for _ in range(words)]
        for _ in range(members):
            texts.append(" ".join(passage + edited(rng, base, rng.randint(0, 4))))
            base = edited(rng, base, 2)
    rng.shuffle(texts)
    return texts


def test_cells_lose_no_link(spark, monkeypatch):
    """Buckets of more than five rows are dealt; the first round finds little, so that the second has to."""
    texts = drifting(5, 4, 30, 120)
    want, pairs = brute_near(texts)
    assert len(set(want)) not in (1, len(texts)) and pairs
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for cell, first, leading in ((5, 1, 1), (7, 4, 8), (4096, 1, 1)):
        monkeypatch.setattr(simhash, "CELL", cell)
        monkeypatch.setattr(simhash, "FIRST", first)
        monkeypatch.setattr(simhash, "LEADING", leading)
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
        assert [got[k] for k in range(len(texts))] == want


def test_every_pair_of_labels_meets_once_in_cells(spark, monkeypatch):
    """Each pair of rows with different labels meets in exactly one cell of its bucket; two of the main label in none of a dealt bucket."""
    monkeypatch.setattr(simhash, "CELL", 4)
    rows = [(k, 10, 0, 1, 0 if k < 23 else k) for k in range(33)] + [(k, 10, 0, 2, 5) for k in range(9)] + [(k, 10, 0, 3, k % 2) for k in range(4)]
    met = spark.createDataFrame(rows, "id long, n int, at int, token long, label long")
    cells = {}
    for r in simhash._cells(met).collect():
        cells.setdefault(r.token, []).append(r)
    meets = {}
    for token, held in cells.items():
        for a in range(len(held)):
            for b in range(a):
                x, y = held[a], held[b]
                if x.label != y.label and (x.side != y.side or x.side == 0):
                    key = (min(x.id, y.id), max(x.id, y.id), token == 3)
                    meets[key] = meets.get(key, 0) + 1
        assert len(held) <= 3 * 2 * simhash.CELL or token == 3
    want = {(a, b, False) for b in range(33) for a in range(b) if b >= 23} | {(a, b, True) for b in range(4) for a in range(b) if (a + b) % 2}
    assert set(meets) == want and set(meets.values()) == {1}


def test_short_sketches_never_exceed_the_true_difference():
    rng = np.random.default_rng(3)
    sets = []
    for size in (1, 5, 60, 64, 65, 100, 128, 129, 300, 2000):
        base = np.unique(rng.integers(-(2**62), 2**62, size))
        other = np.unique(np.concatenate([base[: max(0, len(base) - len(base) // 9)], rng.integers(-(2**62), 2**62, 1 + size // 9)]))
        sets += [base, other]
    sets.append(np.zeros(0, dtype=np.int64))
    words = np.array([simhash.short_sketch(simhash.parity_sketch(s)) for s in sets], dtype=np.int64).view(np.uint64)
    n = np.array([len(s) for s in sets])
    rejected = 0
    for i in range(len(sets)):
        ok = simhash._short_allow(words, n, i, np.arange(len(sets)))
        for j in range(len(sets)):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 9 * both >= 4 * (n[i] + n[j]):
                assert ok[j]
            rejected += not ok[j]
    assert rejected > 100


def test_hot_classes_by_salts(spark, monkeypatch):
    from presswork.llm import common

    monkeypatch.setattr(common, "broadcast_if_small", lambda df, most=0: (df, False))
    rows = spark.range(500).selectExpr("id", "if(id % 3 = 0, -1, id) as low")
    classes = rows.selectExpr("low").distinct().selectExpr("low", "low * 2 as component")
    got = joined_on_hot(rows, classes, ["low"], 4)
    assert got.columns == ["low", "id", "component"]
    assert sorted((r.id, r.component) for r in got.collect()) == [(k, -2 if k % 3 == 0 else 2 * k) for k in range(500)]

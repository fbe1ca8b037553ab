"""The pipeline's near-duplicate stage goes by fingerprints, as op4_simhash_dedup does."""

import random

from test_models import edited

import corpus_pipeline
from presswork.llm import simhash


def test_stage_keeps_the_first_of_each_component_of_fingerprints(spark, tmp_path):
    """Against all pairs of fingerprints; among them texts that SimHash links though their sets of shingles are far apart."""
    rng = random.Random(21)
    texts = [None, "", " \n "]
    for k in range(25):
        words = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(150, 400))]
        texts += [" ".join(words), " ".join(edited(rng, words, 1)), " ".join(edited(rng, words, len(words) // 2))]
        phrase = " ".join(f"p{k}q{j}" for j in range(9))
        texts += [f"{phrase} " * 40, f"{phrase} " * 40 + " ".join(f"x{k}y{j}" for j in range(9))]
    texts += texts[3:40:4]
    rows = [(1000 - k, t, "en", "s0", 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    prints = {r[0]: int(simhash.majorities(*_hashes(r[1]))[0]) for r in rows}
    parent = {i: i for i in prints}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    want = {i for i in prints if root(i) == i}
    sets = {i: set(simhash.shingle_set(t).tolist()) for i, t, *_ in rows}
    apart = [(a, b) for a in prints for b in prints if a < b and root(a) == root(b) and 5 * len(sets[a] & sets[b]) < 4 * len(sets[a] | sets[b])]
    assert len(apart) >= 20 and 50 < len(want) < len(rows) - 50
    out = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(out) == sorted(want)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    op4 = simhash.op4_simhash_dedup(spark, str(tmp_path)).collect()
    assert {r.component_id for r in op4} == want


def _hashes(text):
    import numpy as np

    hashes = np.array(simhash.shingle_hashes(text, simhash.SHINGLE), dtype=np.uint64)
    return hashes, np.array([len(hashes)])

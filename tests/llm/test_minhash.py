import random

import numpy as np
import pytest

from scanframe.llm import minhash as mh

SCHEMA = "doc_id long, text string, key string, mark int, n int"


def shingle_set(text, words):
    parts = (text or "").encode().lower().split()
    return {tuple(parts[k:k + words]) for k in range(max(1, len(parts) - words + 1))} if parts else set()


def brute(docs, words, percent):
    sets = {i: shingle_set(t, words) for i, t in docs}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if b < a and sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def _docs(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    docs, i = [], 0
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 8, 40, 120, 300]))]
        for _ in range(rng.choice([1, 3, 12])):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append((i, " ".join(w.upper() if rng.random() < 0.1 else w for w in copy).replace(" ", rng.choice([" ", "\n", "\t\x0b "]))))
            i += 1
    rng.shuffle(docs)
    return [*docs, (900, None), (901, ""), (902, " \n"), (903, "É é"), (904, "é é"), (905, "x" * 100_000)]


def test_components_against_brute_force(spark):
    for words, percent, rows in ((3, 85, 6), (5, 80, 5)):
        docs = _docs(words)
        df = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], SCHEMA)
        got = mh.near_duplicates(df, mh.Likeness(words, percent, rows)).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(docs, words, percent)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got) and len(got) == len(docs)


@pytest.mark.parametrize("few", [1, 8])
def test_links_between_members_that_no_hub_reaches(spark, monkeypatch, few):
    """A chain in which each text is near the next only; large buckets in many tiles give the same."""
    words = [f"v{k}" for k in range(160)]
    docs = [(k, " ".join(words[2 * k:2 * k + 60])) for k in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs, 5, 80)
    monkeypatch.setattr(mh, "TILE", 2)
    monkeypatch.setattr(mh, "FEW", few)
    got = mh.near_duplicates(df).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert len({c for _, c in want.values()}) < len(docs)


def test_shared_counts():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 20_000, n).astype(np.uint64)) for n in (1, 5, 3000, 9000, 9000)] + [np.array([99_999], np.uint64)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = mh._shared(sets)
    assert all(got[i, j] == want[i][j] for i in range(6) for j in range(6) if i != j)


def test_packed_bits_estimate_the_likeness(spark):
    like = mh.Likeness(3, 85, 6)
    rng = np.random.default_rng(0)
    pool = mh._mixed(np.arange(3000, dtype=np.uint64))
    for share in (0.0, 0.5, 0.9):
        common, n = int(1000 * share), []
        for _ in range(20):
            x = rng.choice(pool, 2000 - common, replace=False)
            low = mh.minima([np.unique(x[:1000]), np.unique(np.concatenate([x[:common], x[1000:]]))], like.hashes) & np.uint64(15)
            n.append((low[0] == low[1]).mean())
        jaccard = common / (2000 - common)
        assert abs((np.mean(n) - 1 / 16) / (1 - 1 / 16) - jaccard) < 0.03


def test_one_of_each_group_stays_with_its_columns(spark):
    near = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(5, near), (3, near.upper()), (3, near.upper()), (None, "alone in the world of null"), (8, ""), (9, None), (4, "something else")]
    df = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], SCHEMA)
    out = mh.keep_one(df)
    assert out.columns == df.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in out.collect()) == sorted(
        [("3", near.upper()), ("None", "alone in the world of null"), ("8", ""), ("9", None), ("4", "something else")], key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mh.near_duplicates(df).count() == 0 and mh.keep_one(df).count() == 0

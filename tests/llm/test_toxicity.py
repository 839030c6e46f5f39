import math
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from scanframe.llm import common
from scanframe.llm import toxicity as tx


def test_segments_against_brute_force():
    """Maximal segments by their recursive definition: the best, then the best left and right of it."""
    def best(s, low, high):
        top, at = 0.0, None
        for i in range(low, high):
            total = 0.0
            for j in range(i, high):
                total += s[j]
                if total > top + 1e-12 or (at and abs(total - top) < 1e-12 and j - i < at[1] - at[0] - 1):
                    top, at = total, (i, j + 1)
        return [] if not at else [*best(s, low, at[0]), (*at, round(top, 6)), *best(s, at[1], high)]

    rng = random.Random(0)
    for _ in range(300):
        s = np.array([rng.choice([-2.3, -1.1, -0.07, 0.51, 1.3, 2.9]) * (1 + rng.random()) for _ in range(rng.randrange(0, 25))])
        assert [(b, e, round(x, 6)) for b, e, x in tx.maximal_segments(s)] == best(s, 0, len(s))


def test_extreme_values_solve_their_equation():
    scores, ordinary = np.array([3.0, -1.0, -0.5, 1.0]), np.array([1, 50, 30, 5])
    decay, factor = tx.extreme_values(scores, ordinary, 200)
    p = np.append(ordinary, 200 - 86) / 200
    assert (p * np.exp(decay * (np.append(scores, 0) - tx.DRIFT))).sum() == pytest.approx(1, abs=1e-6)
    assert 0 < factor <= 1


def test_log_odds(spark):
    rows = spark.createDataFrame([(40.0, 0.0), (0.0, 400.0), (10.0, 100.0), (1.0, 0.0), (0.0, 0.0)], "t double, p double")
    got = [r[0] for r in rows.select(tx.log_odds(F.col("t"), F.col("p"), F.lit(1000.0), F.lit(10_000.0))).collect()]
    assert got[0] > 3 and got[1:] == [0, 0, 0, 0]


def _tables(spark, n=900):
    rng = random.Random(4)
    plain = [f"word{k}" for k in range(300)]
    bad = ["idiotik", "scumly", "vileness"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 200))]
        toxic = i % 7 == 0
        if toxic:
            for _ in range(rng.randrange(3, 7)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        docs.append((i, " ".join(words), "s", 0.5, 1))
        labels.append((i, 0, int(toxic)))
    docs += [(5000, None, "s", 0.5, 1), (5001, "", "s", 0.5, 1), (None, "null id", "s", 0.5, 1), (3, docs[3][1], "s", 0.5, 1)]
    labels += [(7777, 1, 1), (None, 0, 1), (4, None, None), (4, 0, 0)]
    return (spark.createDataFrame(docs, "doc_id long, text string, source string, score double, toxic int"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), docs)


def test_held_out_documents_and_defined_cases(spark):
    docs, labels, rows = _tables(spark)
    got = tx.toxicity_report(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1
    held = [r for r in got if r["held_out"] and r["doc_id"] < 5000]
    assert sum(r["predicted"] == (r["doc_id"] % 7 == 0) for r in held) >= 0.97 * len(held)
    assert all(r["score"] < 0.3 for r in got if r["doc_id"] in (5000, 5001, None))
    kept = tx.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in got if r["score"] < 0.3)


def test_held_out_labels_and_other_columns_do_not_matter(spark):
    docs, labels, _ = _tables(spark, 300)
    other = labels.withColumn("toxic", F.when(tx.is_held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [sorted(map(str, tx.toxicity_report(d, l).collect())) for d, l in ((docs, labels), (docs.withColumn("source", F.lit("z")), other))]
    assert scores[0] == scores[1]


def test_passages_are_found_in_place():
    scores = np.zeros(2 * tx.SLOTS, np.float32)
    for word in (b"vile", b"scum"):
        for pair in tx.slots(word)[:1]:
            scores[list(pair)] = 5.0
    model = tx.Model(scores, 1.0, 0.05, np.zeros(4))
    text = "fine " * 2000 + "vile scum, you VILE scum " + "fine " * 2000 + "scum vile vile scum"
    assert [(b, e) for b, e, _ in tx.passages(text, model, tx.Scores(scores))] == [(2000, 2005), (4005, 4009)]


def test_no_labels_and_empty_tables(spark):
    docs, labels, rows = _tables(spark, 30)
    none = labels.limit(0)
    assert {r["predicted"] for r in tx.toxicity_report(docs, none).collect()} == {0}
    assert tx.toxicity_report(docs.limit(0), labels).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no tables")
def test_accuracy_on_the_held_out_quarter(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = tx.toxicity_report(docs, labels).where("held_out").join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) >= 0.95 * len(got)


def test_packed_places_come_back():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5000):
        places = np.unique(rng.integers(0, 2 * tx.SLOTS, n).astype(np.uint32))
        assert (tx.unpacked(pa.py_buffer(tx.packed(places))) == places).all()
    seen = tx.Slots()
    assert seen.of(None).size == 0
    assert seen.of("Vile vile, scum").tolist() == sorted({k for w in (b"vile", b"scum") for pair in tx.slots(w) for k in pair})


def test_planes_and_sums_of_blocks():
    rng = np.random.default_rng(2)
    for top in (1, 2, 256, 70_000, 1 << 32):
        n = rng.integers(0, top, 512)
        assert (tx.from_planes(tx.planes(n)) == n).all()
    assert tx.from_planes(tx.planes(np.zeros(0))).size == 0
    texts = [(np.unique(rng.integers(0, 2 * tx.SLOTS, 300).astype(np.uint32)), k % 2, k // 2 % 2) for k in range(40)]
    want = {}
    for places, label, fold in texts:
        for slot in places.tolist():
            want.setdefault(slot, [0, 0, 0, 0])[2 * fold + label] += 1
    sent = []
    for task in (texts[:25], texts[25:]):
        columns = [pa.array([tx.packed(p) for p, _, _ in task]), pa.array([t for _, t, _ in task]), pa.array([f for _, _, f in task])]
        sent += tx._counts(iter([pa.RecordBatch.from_arrays(columns, ["places", "toxic", "fold"])]))
    got = {r["slot"]: [r[c] for c in ("p0", "t0", "p1", "t1")] for b in tx._summed(iter(sent)) for r in b.to_pylist()}
    assert got == want


def test_same_model_with_joins_that_shuffle_and_a_full_sieve(spark, monkeypatch):
    docs, labels, _ = _tables(spark, 400)
    want = tx.train(docs, labels)
    monkeypatch.setattr(common, "SIEVE_BITS", 1 << 15)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = tx.train(docs, labels)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert (got.scores == want.scores).all() and (got.decay, got.factor) == (want.decay, want.factor)
    assert np.allclose(got.weights, want.weights)


def test_scores_recomputed_row_by_row(spark):
    """Counts, log-odds and scores by plain loops over the same tables."""
    docs, labels, rows = _tables(spark, 300)
    model = tx.train(docs, labels)
    known = {}
    for i, _, toxic in labels.collect():
        if i is not None and toxic is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            known[i] = max(known.get(i, 0), toxic)
    counts = {}
    for i, text, *_ in rows:
        if i in known:
            for k in {k for w in tx.words_of(text) for pair in tx.slots(w) for k in pair}:
                counts.setdefault(k, [0, 0])[known[i]] += 1
    totals = [sum(c[label] for k, c in counts.items() if k < tx.SLOTS) for label in (0, 1)]
    for k, (plain, toxic) in counts.items():
        prior = tx.PRIOR * (toxic + plain)
        a, b = toxic + prior, plain + prior
        d = math.log(a / (totals[1] + tx.PRIOR * sum(totals))) - math.log(b / (totals[0] + tx.PRIOR * sum(totals)))
        strong = abs(d) >= max(tx.LEAST_DEVIATION * math.sqrt(1 / a + 1 / b), tx.LEAST_ODDS)
        assert model.scores[k] == pytest.approx(min(max(d, -6), 6) if strong else 0, abs=1e-5)
    assert np.count_nonzero(model.scores) <= len(counts)
    for r in tx.toxicity_report(docs, labels).collect():
        text = next(t for i, t, *_ in rows if i == r["doc_id"])
        assert r["score"] == pytest.approx(tx.score_of(text, model, tx.Scores(model.scores)), abs=1e-9)


def test_few_labels_still_rank(spark):
    """With so few toxic texts no token differs by three standard errors; the held-out ones rank above the others all the same."""
    rng = random.Random(3)
    bad = ["idiotik", "scumly", "vileness", "rotten", "vermin", "filthy"]
    docs, labels = [], []
    for i in range(90):
        words = [f"w{rng.randrange(2000)}" for _ in range(60)] + [f"c{k}" for k in range(20)]
        toxic = i % 8 == 2
        words += [rng.choice(bad) for _ in range(4 if toxic else 0)]
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    got = tx.toxicity_report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    held = [(r["score"], r["doc_id"] % 8 == 2) for r in got.collect() if r["held_out"]]
    high, low = ([s for s, t in held if t is kind] for kind in (True, False))
    assert len(high) >= 2 and len(low) >= 10
    assert sum((a > b) + (a == b) / 2 for a in high for b in low) >= 0.9 * len(high) * len(low)


def test_strength(spark):
    rows = spark.createDataFrame([(4.0, 0.0), (1.0, 0.0), (3.0, 4.0), (0.0, 30.0), (0.0, 0.0)], "t double, p double")
    got = [r[0] for r in rows.select(tx.strength(F.col("t"), F.col("p"), F.lit(1000.0), F.lit(6000.0))).collect()]
    assert got[0] == pytest.approx(math.sqrt(8 * math.log(7)) - tx.LEAST_STRENGTH) and got[1:] == [0, 0, 0, 0]
    for n_toxic, n_plain in ((0.0, 0.0), (5.0, 0.0), (0.0, 5.0)):
        assert {r[0] for r in rows.select(tx.strength(F.col("t"), F.col("p"), F.lit(n_toxic), F.lit(n_plain))).collect()} == {0.0}


def test_words_of_a_block_as_text_by_text():
    """Words, places and scores of many texts at a time equal those by plain loops, and nothing is remembered between blocks."""
    rng = random.Random(6)
    letters = [*map(chr, range(128)), *" \u00a0\u2003\u0085\u00e9\u0130", *" " * 20, *"abcdAB" * 10]
    texts = [None, "", " ", "...", "a. b\n", *["".join(rng.choice(letters) for _ in range(rng.randrange(90))) for _ in range(400)]]
    words, numbers = tx.split_words(pa.array(texts, pa.string()))
    names = words.to_pylist()
    assert len(set(names)) == len(names)
    assert [[names[k] for k in at] for at in numbers] == [tx.words_of(t) for t in texts]

    def pair(token):
        h = xxhash.xxh3_64_intdigest(token)
        return h >> 44, tx.SLOTS + (h >> 24 & tx.SLOTS - 1)

    def tokens(word):
        return [word, *[b"%d|%s" % (n, word[:n]) for n in tx.PREFIXES if len(word) >= n]]

    seen = tx.Slots()
    for t, places in zip(texts, seen.of_all(pa.array(texts, pa.string())), strict=True):
        assert places.tolist() == sorted({k for w in tx.words_of(t) for x in tokens(w) for k in pair(x)})
    assert not vars(seen)
    draw = np.random.default_rng(7)
    scores, strengths = (np.where(draw.random(2 * tx.SLOTS) < 0.8, draw.normal(size=2 * tx.SLOTS) * s, 0).astype(np.float32) for s in (4, 1))

    def score(word):
        both = [(float(scores[i]), float(scores[j])) for i, j in map(pair, tokens(word))]
        s = [0.0 if a * b <= 0 else min(a, b, key=abs) for a, b in both]
        return (max(s) if max(s) > 0 else min(s)) - tx.DRIFT

    def strength(word):
        return max(0.0, *[min(float(strengths[i]), float(strengths[j])) for i, j in map(pair, tokens(word))])

    models = [(scores, 0.7, 0.05, strengths), tx._dense(tx._sparse((scores * 2, 0.5, 0.1, None)))]
    got = tx.measures(pa.array(texts, pa.string()), models, [k % 2 for k in range(len(texts))])
    known = tx.Scores(scores)
    for k, t in enumerate(texts):
        words = tx.words_of(t)
        own = np.array([score(w) for w in words])
        assert (known.of(t) == own).all()
        if k % 2:
            want = [*tx.features((own + tx.DRIFT) * 2 - tx.DRIFT, 0.5, 0.1), 0.0]
        else:
            want = [*tx.features(own, 0.7, 0.05), math.log1p(math.fsum(strength(w) for w in set(words)))]
        assert got[k] == pytest.approx(want, abs=1e-9)
    none = pa.array([], pa.string())
    assert tx.split_words(none)[1] == [] == list(seen.of_all(none)) and tx.measures(none, models).shape == (0, 4)


def test_one_python_process_a_task(spark):
    """However few the labels, places and their sums are made in different stages."""
    docs, labels, _ = _tables(spark, 40)
    known = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("doc_id is not null").withColumn("fold", F.lit(0))
    got = tx.labelled_places(docs.select("doc_id", "text"), known).mapInArrow(tx._counts, "block int, kind int, n binary")
    assert sum(r["kind"] in (0, 1) for r in got.collect()) > 0
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    between = plan[plan.index("MapInArrow") + 1:plan.rindex("MapInArrow")]
    assert plan.count("MapInArrow") == 2 and "Exchange" in between and "SortMergeJoin" in between

import contextlib
import hashlib
import io
import random
from collections import Counter

from scanframe.llm import fingerprints as fp

SCHEMA = "doc_id long, text string, side string, n_chars int"


def jaccard(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def edits(docs):
    """(doc_id, edited text, next text) in descending order."""
    docs = sorted(docs, key=lambda d: -d[0])
    out = []
    for k, (i, t) in enumerate(docs):
        n, after = len(t) // 3, docs[(k + 1) % len(docs)][1]
        out.append((i, t[:len(t) - n] + after[:n], after))
    return out


def test_edits_and_collision_rate(spark):
    rng = random.Random(2)
    docs = [(k * 3, " ".join(f"{k // 4}wörd{int(rng.paretovariate(0.7)) % 900}" for _ in range(rng.randrange(1, 60)))) for k in range(150)]
    docs += [(7, ""), (8, "🙂é"), (10, "long " * 5000)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], SCHEMA)
    got = {r["doc_id"]: r for r in fp.fingerprint_documents(df).collect()}
    off = []
    for i, edited, after in edits(docs):
        r, text = got[i], dict(docs)[i]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        if text.split():
            off += [r["near_edited"] - jaccard(text, edited), r["near_next"] - jaccard(text, after)]
    mean = sum(off) / len(off)
    spread = (sum(x * x for x in off) / len(off)) ** 0.5
    assert abs(mean) < 0.02 and spread < 0.1  # standard error of 32 samples: at most 0.09


def test_equal_texts_null_empty_repeats_and_null_ids(spark):
    rows = [(1, "b a"), (2, "b a"), (3, None), (4, ""), (5, " "), (6, "x y z"), (6, "x y z"), (None, "b a")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    got = fp.fingerprint_documents(df).collect()
    assert sorted(map(str, (r["doc_id"] for r in got))) == sorted(str(i) for i, _ in rows)
    prints = {r["doc_id"]: r["fingerprint"] for r in got}
    assert prints[1] == prints[2] == prints[None] and prints[3] == prints[4] == prints[5] == "0" * 256
    near = {r["doc_id"]: r["near_next"] for r in got}
    assert near[4] == 1.0 and near[2] == 1.0 and near[1] == 1.0  # 4 -> 3, 2 -> 1, 1 -> null id
    sha = {r["doc_id"]: r["edited_sha256"] for r in got}
    assert sha[6] == hashlib.sha256(b"x y  ").hexdigest()  # then 5, shorter than the third: " " for " z"... whole next


def test_one_document_and_empty_table(spark):
    one = fp.fingerprint_documents(spark.createDataFrame([(1, "abcdef", "x", 1)], SCHEMA)).collect()[0]
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and one["near_next"] == 1.0
    assert fp.fingerprint_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_fingerprints_of_several_texts_are_those_of_each_alone(spark):
    rows = [(1, "a b a c", "a b d"), (2, "x", None), (3, "", "y y y"), (4, " ", ""), (5, "a b a c", "a b a c")]
    df = spark.createDataFrame(rows, "k long, a string, b string")
    got = {r["k"]: r for r in fp.fingerprints(df, ["k"], ["a", "b"]).collect()}
    assert sorted(got) == [1, 2, 3, 5] and got[2]["b"] is None and got[3]["a"] is None
    assert got[5]["a"] == got[5]["b"] == got[1]["a"] != got[1]["b"] and len(got[1]["a"]) == 256
    for c in "ab":
        alone = {r["k"]: r[c] for r in fp.fingerprints(df, ["k"], [c]).collect()}
        few = {r["k"]: r[c] for r in fp.fingerprints(df, ["k"], [c], 12).collect()}  # not a multiple of what is taken at once
        for k, r in got.items():
            assert r[c] == alone.get(k) and (r[c] and r[c][:96]) == few.get(k)
    kept = fp.fingerprints(spark.createDataFrame([(1, "b a b")], "k long, a string"), ["k"], ["a"]).collect()[0]["a"]
    assert kept[:48] == "1484e7d3b2bc61841484e7d31484e7d3b2bc6184adf7b0cc"  # fingerprints stay what they were


def test_code_of_the_samples_stays_small(spark):
    """32 samples of both texts in one piece of generated code are three logarithms each; eight that share what they draw are 24 in all, weights aside."""
    df = spark.createDataFrame([(1, "a b", "a c")], "k long, a string, b string")
    shown = io.StringIO()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with contextlib.redirect_stdout(shown):
            fp.fingerprints(df.repartition(2, "k"), ["k"], ["a", "b"]).explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert 24 <= shown.getvalue().count("StrictMath.log(") <= 40

import random

from scanframe.llm import line_dedup


def brute(docs):
    """Removed line numbers per document of [(doc_id, text)]."""
    first, removed = {}, {}
    for doc_id, text in sorted((d for d in docs if d[1] is not None)):
        lines = text.split("\n")
        for i in range(len(lines) - 2):
            w = tuple(lines[i:i + 3])
            if not "".join(w).strip(" "):
                continue
            if first.setdefault(w, (doc_id, i)) != (doc_id, i):
                removed.setdefault(doc_id, set()).update((i, i + 1, i + 2))
    out = {}
    for doc_id, text in docs:
        gone = removed.get(doc_id, ())
        out[doc_id] = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
    return out


def test_random_lines_against_brute_force(spark):
    rng = random.Random(5)
    docs = [(k, "\n".join(rng.choice(["a", "b", "c", "", " "]) for _ in range(rng.randrange(0, 14)))) for k in range(120)]
    docs += [(1000, None), (1001, ""), (1002, "x\ny\nz\n" * 400), (1003, "one line")]
    got = line_dedup.line_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = brute(docs)
    assert {r["doc_id"]: r["text"] for r in got} == want
    for r in got:
        before = dict(docs)[r["doc_id"]]
        assert r["n_lines"] == (0 if before is None else len(before.split("\n")))
        if r["text"]:
            assert r["n_removed"] == r["n_lines"] - len(r["text"].split("\n"))


def test_columns_with_names_of_the_operator_repeats_and_null_ids(spark):
    rows = [(1, "a\nb\nc", 5, "k1", 9), (1, "a\nb\nc", 5, "k2", 9), (None, "q\nr\ns\nt", 7, "k3", 9), (2, "a\nb\nc\nd", 7, "k4", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, key string, pos int")
    got = sorted(map(tuple, line_dedup.dedup_lines(df).collect()), key=lambda r: r[3])
    assert got == [(1, "a\nb\nc", 5, "k1", 9), (1, "a\nb\nc", 5, "k2", 9), (None, "q\nr\ns\nt", 7, "k3", 9), (2, "d", 1, "k4", 9)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns and out.count() == 0

import re

import pytest

from scanframe.llm import mixing

SCHEMA = "doc_id long, text string, source string, n_chars long, size string, target int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def levels(sizes):
    """Targets of {source: size} by resharing until none is above three times its size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        free = sum(weight[s] for s in names if s not in full)
        target = {s: 3 * sizes[s] if s in full else weight[s] * rest / free for s in names}
        above = {s for s in names if s not in full and target[s] > 3 * sizes[s]}
        if not above:
            return target
        full |= above


def _docs():
    out = []
    for k in range(300):
        source = [None, "a", "b", "B", "é", "zz"][0 if k < 5 else 1 + k % 5 if k % 3 else 1]
        out.append((k, " \t".join(f"w{k}_{i}" for i in range(k % 23)), source, 1, "x", 2))
    return [*out, (400, None, "a", 0, "x", 2), (401, "  \n ", "only blank", 4, "x", 2), (402, " lead word  trail ", "b", 1, "x", 2), (700, "again", "a", 1, "x", 2), (700, "again", "a", 1, "x", 2)]


def test_targets_budgets_and_reruns(spark):
    docs = _docs()
    df = spark.createDataFrame(docs, SCHEMA)
    got = mixing.mix_report(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_report(df.repartition(5)).collect()))
    sizes, taken = {}, {}
    for _, text, source, *_ in docs:
        sizes[source] = sizes.get(source, 0) + len(words(text))
    want = levels(sizes)
    by_id = {}
    for d, text, source, *_ in docs:
        by_id.setdefault(d, (source, len(words(text))))
    assert len(got) == len(docs)
    for r in got:
        source = by_id[r["doc_id"]][0]
        assert r["source_size"] == sizes[source]
        assert r["target"] == pytest.approx(want[source], abs=1e-6)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source] = taken.get(source, 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 3 for s in sizes)
    assert sum(r["target"] for r in {r["source_size"]: r for r in got}.values()) > 0


def test_mix_gives_the_words_that_the_report_counts(spark):
    docs = _docs()
    df = spark.createDataFrame(docs, SCHEMA)
    out = mixing.mix(df)
    assert out.columns == df.columns
    report = {}
    for r in mixing.mix_report(df).collect():
        report[r["doc_id"]] = report.get(r["doc_id"], 0) + r["taken"]
    mixed, texts = {}, {}
    for d, text, *_ in docs:
        texts.setdefault(d, set()).add(text)
    for r in out.collect():
        mixed[r["doc_id"]] = mixed.get(r["doc_id"], 0) + len(words(r["text"]))
        assert any(t and t.startswith(r["text"]) for t in texts[r["doc_id"]])
    assert mixed == {d: n for d, n in report.items() if n}


def test_words_of_odd_texts(spark):
    texts = [None, "", " ", "a", " a", "a ", "a\x0bb\x0cc", "x y", "\n\n a  b\t"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(mixing.n_words(df["text"])).collect()] == [len(words(t)) for t in texts]


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mixing.mix_report(df).count() == 0 and mixing.mix(df).count() == 0
    blank = spark.createDataFrame([(1, "", "a", 0, "x", 2), (2, None, None, 0, "x", 2)], SCHEMA)
    assert [r["taken"] for r in mixing.mix_report(blank).collect()] == [0, 0] and mixing.mix(blank).count() == 0

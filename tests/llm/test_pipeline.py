"""The pipeline's stages against brute force on a small table and on the smallest given one."""

import os
import random

import pytest
import test_line_dedup
import test_minhash
import test_mixing

import corpus_pipeline
from scanframe.llm import toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _folder(spark, path):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(500)]
    docs, labels = [], []
    for i in range(160):
        lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(6, 20))) for _ in range(rng.randrange(1, 9))]
        if i % 11 == 0 and docs:
            lines = docs[-1][1].split("\n") + lines[:1]
        if i % 13 == 0 and docs:
            lines = [docs[-1][1].replace("w7", "w8"), "end of it"]
        if i % 6 == 0:
            lines[0] += " vilely" * 4
        docs.append((i, "\n".join(lines), "en", f"s{i % 3}" if i % 5 else "s0", len("\n".join(lines))))
        labels.append((i, 0, int("vilely" in docs[-1][1])))
    docs += [(500, None, "en", "s1", 0), (501, "", None, None, 0)]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return docs


def test_every_stage_against_brute_force(spark, tmp_path):
    made = _folder(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, rows = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash_dedup", "mixing", "bpe"]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        new = spark.read.parquet(f"{tmp_path}/{name}")
        assert new.columns[:len(columns)] == columns
        found = new.collect()
        texts = [(i, r["text"]) for i, r in rows.items()]
        if name == "toxicity":
            clean = {r["doc_id"] for r in toxicity.toxicity_report(docs, labels).where("predicted = 0").collect()}
            assert {r["doc_id"] for r in found} == clean and len(found) == len(clean)
            right = sum((i in clean) != ("vilely" in (t or "")) for i, t, *_ in made)
            assert right >= 0.97 * len(made)
        elif name == "line_dedup":
            assert {r["doc_id"]: r["text"] for r in found} == test_line_dedup.brute(texts)
        elif name == "minhash_dedup":
            want = {i for i, (_, c) in test_minhash.brute(texts, 5, 80).items() if i == c}
            assert {r["doc_id"] for r in found} == want and len(found) == len(want)
        elif name == "mixing":
            sizes, taken = {}, {}
            for r in rows.values():
                sizes[r["source"]] = sizes.get(r["source"], 0) + len(test_mixing.words(r["text"]))
            for r in found:
                taken[r["source"]] = taken.get(r["source"], 0) + len(test_mixing.words(r["text"]))
                assert rows[r["doc_id"]]["text"].startswith(r["text"])
            assert all(abs(taken.get(s, 0) - t) <= 1 for s, t in test_mixing.levels(sizes).items())
        else:
            assert len(found) == docs.count() and all(r["decoded"] == r["text"] for r in found)
        docs, rows = new, {r["doc_id"]: r for r in found}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_run_over_the_smallest_tables(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "decoded"]
    assert out.where("decoded <> text").count() == 0 and out.count() > 50

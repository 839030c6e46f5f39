import zlib

import pytest

from scanframe.llm import sharding


def _checked(spark, docs, shards):
    df = spark.createDataFrame(docs, "doc_id long, text string, shard string, arc int")
    got = sharding.shard_documents(df, shards).collect()
    assert len(got) == len(docs)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(slots.get(k, [])) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _, _ in docs if d is not None)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got if r["doc_id"] is not None) == want
    return got


def test_even_gapless_and_same_again(spark):
    docs = [(k, f"text é {k % 7}" if k % 5 else None, "x", k) for k in range(503)]
    one, two = (sorted(map(tuple, _checked(spark, docs, 7)), key=str) for _ in range(2))
    assert one == two


def test_hot_key_null_ids_repeats_and_empty_table(spark):
    docs = [(7, "same", "x", 0)] * 60 + [(None, f"t{k}", "x", 0) for k in range(40)] + [(k, "", "x", 1) for k in range(80)]
    _checked(spark, docs, 5)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shard_documents(empty).count() == 0


def test_little_moves_when_a_shard_comes(spark):
    df = spark.createDataFrame([(k, "t") for k in range(2000)], "doc_id long, text string")
    a = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(df, 9).collect()}
    b = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(df, 10).collect()}
    assert sum(a[k] != b[k] for k in a) < 0.45 * len(a)  # a new hash modulo the number would move 0.9 of them


def test_full_shards_pass_on_clockwise():
    got = sharding.fill([5, 0, 1], [0, 1, 2], [2, 2, 2])
    assert [(s["arc"], s["low"], s["high"], s["shard"], s["slot"]) for s in got] == [(0, 0, 2, 0, 0), (2, 0, 1, 2, 0), (0, 2, 4, 1, 0), (0, 4, 5, 2, 1)]
    with pytest.raises(ValueError):
        sharding.fill([5], [0], [2])


def test_slack_bounds_the_load():
    assert sharding.capacities(100, 8, 0.1) == [14] * 8
    assert sum(sharding.capacities(101, 8)) == 101

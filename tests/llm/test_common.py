import random

import pytest
from pyspark.sql import functions as F

from scanframe.llm import common
from scanframe.llm.common import components


def _roots(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def _found(spark, edges):
    return {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}


def test_random_links_loops_and_repeats(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(7, 7), (1, 2), (2, 1)]
    want = _roots([e for e in edges if e[0] != e[1]])
    assert _found(spark, edges) == want


def test_chain_star_and_many_small_leaves_of_a_large_hub(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + k) for k in range(1, 30)]
    hub = [(999, 200 + k) for k in range(30)]
    assert _found(spark, chain + star + hub) == _roots(chain + star + hub)


def test_no_links(spark):
    assert _found(spark, []) == {}


@pytest.mark.parametrize("bits", [1 << 15, 1 << 27])
def test_sieve_loses_nothing_and_leaves_out_much(spark, monkeypatch, bits):
    monkeypatch.setattr(common, "SIEVE_BITS", bits)
    rows = spark.range(-20_000, 20_000).withColumn("mark", F.xxhash64("id")).unionByName(spark.sql("SELECT CAST(NULL AS bigint) id, 5L mark"))
    wanted = rows.where("id % 10 = 3 OR id IS NULL").select("id", "mark")
    got = common.sieved(rows, wanted, ["id", "mark"])
    assert got.columns == ["id", "mark", "possible"] and got.count() == 40_001
    assert got.where("possible AND id % 10 = 3").count() == wanted.where("id IS NOT NULL").count()
    extra = got.where("possible AND NOT id % 10 <=> 3 AND id IS NOT NULL").count()
    assert extra < (40 if bits > 1 << 20 else 6000)
    assert common.sieved(rows, wanted.limit(0), ["id", "mark"]).where("possible").count() == 0

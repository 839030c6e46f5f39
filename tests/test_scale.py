"""Work that is dealt out by the number of files, trees that lie on disk a part at a time."""

import datetime
import os

import pytest

from scanframe import queries as Q
from scanframe.functions import cluster
from scanframe.plans import corpus, scan, store
from scanframe.sources import tree


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(k * 7 + 1, k * 3 + 2, datetime.date(1995, 1 + k % 12, 1)) for k in range(300)]
    spark.createDataFrame(rows + rows[:20], "o_orderkey long, o_custkey long, o_orderdate date").coalesce(1).write.parquet(
        str(tmp_path / "orders.parquet"))
    return str(tmp_path)


def rows(df):
    return sorted(map(str, df.collect()))


def test_trees_in_parts(spark, folder, monkeypatch):
    names = ("src1_source_tree", "src5_single_file", "src12_unreadable")
    want = [rows(Q.QUERIES[name](spark, folder)) for name in names]
    assert [len(w) for w in want] == [262, 1, 2]
    most, write = [], Q._write_tree

    def counted(files, root):
        write(files, root)
        most.append(sum(len(names) for _, _, names in os.walk(root)))

    monkeypatch.setattr(Q, "TREE_FILES", 160)
    monkeypatch.setattr(Q, "_write_tree", counted)
    assert [rows(Q.QUERIES[name](spark, folder)) for name in names] == want
    assert len(most) == 6 and max(most) < 220 and sum(most) == 3 * 300
    left = [f for _, _, names in os.walk(Q._mounted(spark)) for f in names if f.startswith(".f_") and not f.endswith(".crc")]
    assert left == []


def test_trees_side_by_side(spark, folder, monkeypatch):
    """Some trees lie on disk at a time, never more than TREES; one that fails ends the query."""
    want = rows(Q.src12_unreadable(spark, folder))
    write, remove, lying, most = Q._write_tree, Q._remove_tree, [], []

    def written(files, root):
        lying.append(root)
        most.append(len(lying))
        write(files, root)

    def removed(spark, root):
        remove(spark, root)
        lying.remove(root)

    monkeypatch.setattr(Q, "TREE_FILES", 40)
    monkeypatch.setattr(Q, "_write_tree", written)
    monkeypatch.setattr(Q, "_remove_tree", removed)
    assert rows(Q.src12_unreadable(spark, folder)) == want
    assert len(most) == 8 and 1 < max(most) <= Q.TREES and lying == []

    def broken(files, root):
        raise OSError("no space")

    monkeypatch.setattr(Q, "_write_tree", broken)
    with pytest.raises(OSError, match="no space"):
        Q.src12_unreadable(spark, folder)


def test_a_level_of_folders_is_listed_and_counted_in_one_write(spark, tmp_path, monkeypatch):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x.py").write_text("x")
    writes, write = [], cluster.counted
    monkeypatch.setattr(cluster, "counted", lambda df: writes.append(1) or write(df))
    assert tree.list_tree(spark, str(tmp_path)).count() == 1 and len(writes) == 3


def test_files_are_dealt_by_number(spark, folder, monkeypatch):
    want = rows(corpus.code_files(spark, folder))
    monkeypatch.setattr(corpus, "FILES_PER_TASK", 40)
    files = corpus.code_files(spark, folder)
    assert files.rdd.getNumPartitions() >= 8 and rows(files) == want
    parts = [rows(corpus.files_of(p)) for p in corpus.order_parts(spark, folder, 100)]
    assert len(parts) == 4 and sorted(sum(parts, [])) == want
    assert not {p for a in parts[:2] for p in a} & {p for b in parts[2:] for p in b}


def test_a_scan_is_computed_once_before_it_is_sorted(spark, folder, tmp_path, monkeypatch):
    """The range partitioner samples what it sorts, which must not be the scan itself."""
    seen, put = [], store.put

    def watched(df, *args):
        seen.append((args[1], df._jdf.queryExecution().optimizedPlan().toString()))
        return put(df, *args)

    monkeypatch.setattr(store, "put", watched)
    options = scan.ScanOptions(run="one", enable_flow_analysis=False)
    scan.write_scan(corpus.code_files(spark, folder).drop("ts"), str(tmp_path / "store"), options)
    plan = dict(seen)["findings"]
    assert plan.strip().startswith("Relation") and cluster.own_folder(spark)


def test_reports_are_written_compressed(spark, folder, tmp_path):
    from scanframe.plans import output

    findings, scans = Q._findings(spark, folder), Q._scans(spark, folder)
    out = output.write_report(scans, findings, str(tmp_path / "report"))
    files = [f for top in set(out.values()) for _, _, names in os.walk(top) for f in names if f.startswith("part-")]
    assert files and all(f.endswith(".gz") for f in files)
    assert spark.read.json(out["json"] + "/vulnerabilities").count() == findings.count()

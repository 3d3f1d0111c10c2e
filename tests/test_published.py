"""Snapshots behind a pointer, rival and ended runs; a history of which the last runs stay."""

import pytest

from oppflow.sources import published


def rows(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id long").coalesce(1)


def ids(df):
    return sorted(r.id for r in df.collect())


def test_snapshots_are_seen_once_they_are_published(spark, tmp_path):
    root = f"file://{tmp_path}/catalogue"
    assert published.current_version(spark, root) == 0 and published.read_published(spark, root) is None
    assert published.publish(rows(spark, 1), root, 0) == 1
    rows(spark, 9).write.parquet(f"{root}/snapshots/ended-before-publishing")
    assert ids(published.read_published(spark, root)) == [1]
    held = published.read_published(spark, root)
    assert published.publish(rows(spark, 1, 2), root, 1) == 2
    assert ids(held) == [1] and ids(published.read_published(spark, root)) == [1, 2] and ids(published.read_published(spark, root, 1)) == [1]


def test_of_two_rivals_one_publishes(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/catalogue"
    published.publish(rows(spark, 1), root, 0)
    published.publish(rows(spark, 2), root, 1)
    with pytest.raises(published.Outrun):
        published.publish(rows(spark, 3), root, 1)
    # both have looked at the version before either publishes
    monkeypatch.setattr(published, "current_version", lambda spark, root: 1)
    with pytest.raises(published.Outrun):
        published.publish(rows(spark, 3), root, 1)
    assert ids(published.read_published(spark, root, 2)) == [2]


def test_old_versions_can_go(spark, tmp_path):
    root = f"file://{tmp_path}/catalogue"
    for k in range(4):
        published.publish(rows(spark, k), root, k)
    assert published.drop_versions(spark, root, keep=2) == [1, 2]
    assert ids(published.read_published(spark, root)) == [3] and ids(published.read_published(spark, root, 3)) == [2]
    assert published.publish(rows(spark, 7), root, 4) == 5


def test_the_eleventh_run_leaves_ten(spark, tmp_path):
    root = f"file://{tmp_path}/history"
    for k in range(1, 12):
        gone = published.append_run(rows(spark, k, k + 100), root, f"202601{k:02d}")
        assert gone == (["20260101"] if k == 11 else [])
    published.append_run(rows(spark, 500), root, "20260111")  # a repeated run
    every = published.read_runs(spark, root)
    assert every.select("run").distinct().count() == 10 and every.filter("run = '20260111'").count() == 1
    last = published.read_runs(spark, root, last=3)
    assert sorted({r.run for r in last.collect()}) == ["20260109", "20260110", "20260111"]
    plan = last._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run" in plan

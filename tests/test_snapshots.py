"""Published snapshots over files: what is written, what is refused, what readers see."""

import glob
import os

import pytest
from folio.sources import snapshots


def docs(spark, rows):
    return spark.createDataFrame(rows, "part string, id string, body string").repartition(3)


def seen(df):
    return sorted(map(tuple, df.collect()))


def test_two_publishes_and_a_stale_one(spark, tmp_path):
    path = f"file://{tmp_path}/shop"
    one = [("a", "1", "x"), ("a", "2", None), ("b", "1", "y\n\"é\""), ("c", "1", "z")]
    assert snapshots.version(spark, path) == 0
    assert snapshots.publish(docs(spark, one), path, 0) == 1 and seen(snapshots.read(spark, path)) == sorted(one, key=str)
    two = [("a", "1", "x"), ("a", "2", None), ("b", "1", "new"), ("d", "9", "")]
    assert snapshots.publish(docs(spark, two), path, 1) == 2 and seen(snapshots.read(spark, path)) == sorted(two, key=str)
    assert seen(snapshots.read(spark, path, 1)) == sorted(one, key=str)  # as it was
    folders = sorted(os.listdir(tmp_path / "shop" / "data"))
    assert [sorted(os.path.basename(p) for p in glob.glob(f"{tmp_path}/shop/data/{f}/part=*")) for f in folders] == [["part=a", "part=b", "part=c"], ["part=b", "part=d"]]
    assert all(p.endswith(".json.gz") for p in glob.glob(f"{tmp_path}/shop/data/*/part=*/part-*"))
    assert snapshots.publish(docs(spark, two), path, 2) == 2 and len(os.listdir(tmp_path / "shop" / "data")) == 2  # nothing has changed
    with pytest.raises(snapshots.Stale):
        snapshots.publish(docs(spark, one), path, 1)
    assert snapshots.publish(docs(spark, two[:1]), path, 2) == 3 and seen(snapshots.read(spark, path)) == [("a", "1", "x")]


def test_of_two_publishers_at_once_one_is_refused(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/shop"
    snapshots.publish(docs(spark, [("a", "1", "x")]), path, 0)
    own = snapshots._create

    def slow(*args):
        monkeypatch.setattr(snapshots, "_create", own)
        snapshots.publish(docs(spark, [("a", "1", "theirs")]), path, 1)  # somebody else is faster
        own(*args)

    monkeypatch.setattr(snapshots, "_create", slow)
    with pytest.raises(snapshots.Stale):
        snapshots.publish(docs(spark, [("a", "1", "ours")]), path, 1)
    assert seen(snapshots.read(spark, path)) == [("a", "1", "theirs")] and snapshots.version(spark, path) == 2

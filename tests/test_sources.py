import csv
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from storelab import session
from storelab.sources import store


def test_listing_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b,c\n1,2,3\n4,5\n6,7,8,9\n"x\ny","q ""q""",\n')
    rows = store.read_listings(spark, str(tmp_path), ["a", "b", "c"]).collect()
    assert sorted(tuple(r) for r in rows) == [("1", "2", "3"), ("4", "5", None), ("x\ny", 'q "q"', None)]


def fields(rng):
    kinds = ["plain", "a,b", "line\nbreak", 'say "hi"', "\n\n", "", 'x"\n"y', "é漢", "\r\nz"]
    return [kinds[i] for i in rng.integers(0, len(kinds), 3)]


@pytest.mark.parametrize("size", [16, 40, 333, 1 << 20])
def test_listing_csv_in_blocks(spark, tmp_path, size):
    """Blocks of any size give what one task reads, with quotes across their borders."""
    rng = np.random.default_rng(size)
    for name in ("a", "b"):
        with open(tmp_path / f"{name}.csv", "w", newline="") as out:
            writer = csv.writer(out, quoting=csv.QUOTE_MINIMAL, lineterminator="\n")
            writer.writerow(["first\nname", "b", "c"])
            writer.writerows([[f"{name}{i}", *fields(rng)[:2]] for i in range(120)])
    plain = (spark.read.schema("a string, b string, c string")
             .csv(str(tmp_path), header=True, multiLine=True, escape='"', enforceSchema=True))
    want = sorted(map(str, plain.collect()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        if size < 100:
            assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 50
        found = store.read_listings(spark, str(tmp_path), ["a", "b", "c"])
        assert sorted(map(str, found.collect())) == want and len(want) == 240
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_cached_table_of_killed_writer(spark, tmp_path):
    """A writer that dies half way leaves the old version, its readers and the next writer alone."""
    path = str(tmp_path / "t")
    old = store.cached_table(spark, path, lambda: spark.range(3))

    def dies():
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        store.cached_table(spark, path, dies, force=True)
    spark.range(9).write.parquet(f"{path}/data/lost")
    assert store.cached_table(spark, path, dies).count() == 3
    new = store.cached_table(spark, path, lambda: spark.range(7), force=True)
    assert new.count() == 7 and old.count() == 3


def test_scratch_scope(spark):
    """Tables written inside a scope hold nothing afterwards."""
    with session.scratch_scope():
        df = session.cut(spark.range(50).withColumn("part", F.col("id") % 3), ["part"])
        path = df.inputFiles()[0].split("/part=")[0]
        assert df.count() == 50
    left = spark.read.parquet(path)
    assert left.columns == ["emptied"] and left.count() == 0


def test_cached_table(spark, tmp_path):
    path, built = str(tmp_path / "t"), []

    def build():
        built.append(1)
        return spark.range(3)

    assert store.cached_table(spark, path, build).count() == 3
    assert store.cached_table(spark, path, build).count() == 3 and len(built) == 1
    store.cached_table(spark, path, build, force=True)
    assert len(built) == 2


def test_model_paths_differ():
    names = {store.model_path("f", "pipe", c, t, w) for c in (None, "x") for t, w in
             ((True, False), (False, True), (False, False))}
    assert len(names) == 6


def test_scoreboard_roundtrip(spark, tmp_path):
    path = str(tmp_path / "board")
    df = spark.createDataFrame([(0, "all", 0.5, 0.25, 1.0, 0.1, 1.5, "0.5 (1.5)")],
                               "Runs int, Category string, m___f1 double, m___prec double, m___rec double, "
                               "m___acc double, m___err double, m___combined string")
    store.write_report(df, path)
    assert store.read_scoreboard(spark, path, ["m"]).collect() == df.collect()


def test_shared_folder_follows_the_session(spark):
    setting = spark.conf.get("spark.checkpoint.dir", None)
    if setting:
        assert session.shared_dir(spark) == setting.rstrip("/")
    cut = session.cut(spark.range(5).withColumn("odd name, 25%", F.lit(1)))
    assert cut.count() == 5 and cut.columns == ["id", "odd name, 25%"]

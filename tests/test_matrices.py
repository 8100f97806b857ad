import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.sources import logs
from emberlog.sources.matrices import read_matrix, write_matrix, zip_lines


def test_file_is_read_in_ranges_of_rows(spark, tmp_path):
    x = np.arange(23 * 4, dtype=np.float32).reshape(23, 4)
    np.save(tmp_path / "x.npy", x)
    rows = read_matrix(spark, f"{tmp_path}/x.npy", stride=5)
    assert rows.rdd.getNumPartitions() == 5
    assert [(r.key, r.features) for r in rows.orderBy("key").collect()] == [(k, v.tolist()) for k, v in enumerate(x)]
    some = read_matrix(spark, f"{tmp_path}/x.npy", columns=[3, 1], stride=7).orderBy("key").collect()
    assert [r.features for r in some] == x[:, [3, 1]].tolist()
    with pytest.raises(Exception, match="4 columns"):
        read_matrix(spark, f"{tmp_path}/x.npy", columns=[4]).collect()
    np.save(tmp_path / "flat.npy", np.arange(3))
    with pytest.raises(Exception, match="dimensions"):
        read_matrix(spark, f"{tmp_path}/flat.npy").collect()


def test_round_trip_with_keys(spark, tmp_path):
    rows = spark.range(40).select((F.col("id") * 3).alias("win"), F.array(F.col("id").cast("double"), F.lit(0.5), F.sqrt("id")).alias("features"))
    for n in (3, 2):  # the second run replaces the parts of the first
        write_matrix(rows.repartition(n), "win", f"{tmp_path}/m")
        assert len([p for p in (tmp_path / "m").iterdir() if p.name.startswith("features-")]) == n
    got = read_matrix(spark, f"{tmp_path}/m", stride=4)
    assert sorted((r.key, r.features) for r in got.collect()) == sorted((r.win, r.features) for r in rows.collect())
    assert got.select("key").agg(F.sum("key")).first()[0] == sum(range(0, 120, 3))
    write_matrix(rows.limit(0), "win", f"{tmp_path}/none")
    assert read_matrix(spark, f"{tmp_path}/none").collect() == []


def test_members_are_partitions(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("one.log", "first line\nsecond é\r\n\nlast")
        z.writestr("two.log", "other\n")
        z.writestr("folder/", "")
        z.writestr("empty.log", "")
    every = zip_lines(spark, f"{tmp_path}/a.zip")
    assert every.rdd.getNumPartitions() == 3
    want = [("one.log", 0, "first line"), ("one.log", 1, "second é"), ("one.log", 2, ""), ("one.log", 3, "last"), ("two.log", 0, "other")]
    assert sorted(map(tuple, every.collect())) == want
    assert sorted(map(tuple, zip_lines(spark, f"{tmp_path}/a.zip", ["two.log"]).collect())) == want[4:]
    with pytest.raises(Exception, match="no member three.log"):
        zip_lines(spark, f"{tmp_path}/a.zip", ["two.log", "three.log"]).collect()


def test_members_feed_the_parser(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "bgl.zip", "w") as z:
        z.writestr("BGL.log", "- 1 2005.06.03 R02 2005-06-03-15.42.50.675872 R02 RAS KERNEL INFO instruction cache parity\nnot a line\n")
    got = logs.parse_lines(zip_lines(spark, f"{tmp_path}/bgl.zip", ["BGL.log"]).select("line"), logs.log_format("BGL")).collect()
    assert [r.Content for r in got] == ["instruction cache parity"]

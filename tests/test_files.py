"""Readers of the targets, centroid and result files."""

from donorlift.sources import files as fl


def test_readers_take_bad_lines_as_null(spark, tmp_path):
    def put(name, lines):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        return str(tmp_path / name)

    got = fl.read_targets(spark, put("t.csv", ["ID,B,D", "1,1,12.5", "2,0,", "3,x,y"]), "ID", "B", "D").collect()
    assert [tuple(r) for r in got] == [(1, 1, 12.5), (2, 0, None), (3, None, None)]
    points = fl.read_centroids(spark, put("z.csv", ["ZIP,LAT,LON", "02134,42.3,-71.1", ",1,2", "501,40.8,"]), ["ZIP", "LAT", "LON"])
    assert points.columns == ["key", "lat", "lon"]
    assert [tuple(r) for r in points.collect()] == [(2134, 42.3, -71.1), (501, 40.8, None)]


def test_result_file_round_trip(spark, tmp_path):
    rows = [(1, 0.1), (2, 1e-17), (3, None), (4, 123456789.125)]
    fl.write_result_csv(spark.createDataFrame(rows, "k long, v double"), "k", "v", str(tmp_path / "r"))
    got = fl.read_result_csv(spark, str(tmp_path / "r"), "k", "v").collect()
    assert sorted(tuple(r) for r in got) == rows
    fl.write_result_csv(spark.createDataFrame([], "k long, v double"), "k", "v", str(tmp_path / "e"))
    assert fl.read_result_csv(spark, str(tmp_path / "e"), "k", "v").collect() == []

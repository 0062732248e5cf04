"""Streams: appended lines, last-wins merges across batches and restarts."""

from loomfield.streaming import usage


def test_appended_lines_arrive_once(spark, tmp_path):
    spark.dataSource.register(usage.TailSource)
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.jsonl").write_text("one\ntwo\ntor")

    def run():
        stream = spark.readStream.format("loomfield_tail").option("path", str(src)).load()
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(r.value for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == ["one", "two"]
    with open(src / "a.jsonl", "a") as file:
        file.write("n end\nmore\n")
    (src / "b.jsonl").write_text("new\n")
    assert run() == ["more", "new", "one", "torn end", "two"]


def test_last_wins_over_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = lambda rows: spark.createDataFrame(rows, "k long, at long, v string")
    assert usage.current(spark, path) is None
    usage.merge_last(frame([(1, 5, "b"), (1, 3, "a"), (2, 1, "x")]), ["k"], "at", path)
    usage.merge_last(frame([(1, 4, "late"), (2, 2, "y")]), ["k"], "at", path)
    assert sorted(map(tuple, usage.current(spark, path).collect())) == [(1, 5, "b"), (2, 2, "y")]


def test_only_changed_views_are_written(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, hash string")
    new = spark.createDataFrame([(1, "a"), (2, "B"), (4, "d")], "k long, hash string")
    assert sorted(r.k for r in usage.changed_only(new, old, "k", new).collect()) == [2, 4]

"""Short ranges of a CSV file share tasks."""

from threadloom.sources import csv as raw_csv


def test_short_ranges_share_tasks(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text("a,b\n" + "".join(f'{i},"x\ny"\n' for i in range(2_000)))
    with raw_csv._held_ranges(spark, 100):
        lines = raw_csv._lines(spark, str(path), 100)
        ranges = lines.select("start").distinct().count()
    assert ranges > 100 and lines.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism

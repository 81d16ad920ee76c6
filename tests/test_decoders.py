import pyarrow as pa
from pyspark.sql import functions as F

from catalogops.sources import decoders


def test_decoders_take_files_in_bounded_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, str(256 << 20))
        files = spark.range(40).coalesce(1).select("id", F.when(F.col("id") % 4 > 0, F.encode(F.repeat(F.lit("x"), 1 << 20), "UTF-8")).alias("content"))
        largest = []

        def held(content):
            largest.append(pa.total_allocated_bytes())
            return {"Make": max(largest)}

        got = decoders.raw_tags(files, held).collect()
        assert int(spark.conf.get(key)) <= 8 << 20
        assert [r.id for r in got if r.raw_tags is None] == list(range(0, 40, 4))
        assert max(int(r.raw_tags["Make"]) for r in got if r.raw_tags) < 24 << 20  # 30 MB in all
    finally:
        spark.conf.set(key, before)


def test_columns_beside_the_content_keep_their_values(spark):
    files = spark.createDataFrame([(None, b"a"), (2**60 + 1, b"b")], "n long, content binary").coalesce(1)
    assert sorted((r.n or 0, r.raw_tags["Make"]) for r in decoders.raw_tags(files, lambda c: {"Make": c.decode()}).collect()) == [(0, "a"), (2**60 + 1, "b")]

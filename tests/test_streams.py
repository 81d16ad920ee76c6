import datetime
import random

import pytest
from pyspark.sql import functions as F

from catalogops.operators import catalog as C
from catalogops.streaming import live

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def run_stream(spark, tmp_path, batches, ddl, work, **options):
    """Rows of a query over a stream of batches, each a file."""
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, ddl).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    writer = work(source).writeStream.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True)
    writer = writer.foreachBatch(options["sink"]) if "sink" in options else writer.format("memory").queryName("changes").outputMode("append")
    query = writer.start()
    assert query.awaitTermination(180) and query.exception() is None
    return spark.table("changes").collect() if "sink" not in options else None


def test_live_list(spark, rocksdb, tmp_path):
    at = lambda seconds: START + datetime.timedelta(seconds=seconds)
    rng = random.Random(2)
    emoji = C.REACTIONS
    # One alone leaves after three seconds; forty in a row push the oldest out; then some of all keys.
    first = [(at(0), 1, "a", emoji[0]), (at(0.5), 2, "a", "no reaction"), (at(1), 3, None, emoji[1]), (None, 4, "a", emoji[1])]
    burst = [(at(10 + i * 0.05), 100 + i, "a", emoji[i % 5]) for i in range(40)]
    rest = [(at(20 + rng.random() * 20), 200 + i, rng.choice("ab"), rng.choice([*emoji, "x"])) for i in range(150)]
    rest.sort()
    batches = [first, burst, *[rest[i : i + 50] for i in range(0, 150, 50)], [(at(100), 900, "c", emoji[0])]]
    ddl = "ts timestamp, event_id long, key string, value string"
    changes = run_stream(spark, tmp_path, batches, ddl, live.live_changes)
    assert not {2, 4} & {r.event_id for r in changes}
    alone = sorted((r.at_ms, r.change) for r in changes if r.event_id == 1)
    assert [(t - int(START.timestamp() * 1000), c) for t, c in alone] == [(0, "in"), (3000, "out")]
    pushed = [r for r in changes if r.change == "out" and 100 <= r.event_id < 140 and r.at_ms < START.timestamp() * 1000 + 12_950]
    assert {r.event_id for r in pushed} >= {100 + i for i in range(9)}
    events = spark.createDataFrame([e for b in batches for e in b], ddl).where(F.col("value").isin(*emoji)).withColumn("key", F.coalesce("key", F.lit(""))).cache()
    for seconds in [0, 2.999, 3, 10.5, 11.6, 11.95, 12.1, 13.0, 14, *[rng.random() * 40 for _ in range(12)]]:
        for key in ("a", "b", ""):
            ms = int(at(seconds).timestamp() * 1000)
            log = [r for r in changes if r.key == key and r.at_ms <= ms]
            got = {r.event_id for r in log if r.change == "in"} - {r.event_id for r in log if r.change == "out"}
            want = C.active_at(events.where(F.col("key") == key), F.timestamp_millis(F.lit(ms)), live.TTL_MS / 1000, live.NEWEST)
            assert got == {r.event_id for r in want.collect()}, (seconds, key)

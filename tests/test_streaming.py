import os
import random

import pytest

from lodemine.operators import sketches
from lodemine.session import scratch_path
from lodemine.streaming import sketches as live


@pytest.fixture(scope="module")
def batch(spark):
    rng = random.Random(12)
    rows = [(i + 1, str(rng.choice([3, rng.randint(0, 200)])), f"2024-01-01 {i // 200:02d}:{i % 60:02d}:00") for i in range(800)]
    df = spark.createDataFrame(rows, "seq long, id string, at string").selectExpr("seq", "id", "cast(at as timestamp_ntz) ts")
    return df.withColumn("window", sketches.batch_number("seq", 250)).persist()


@pytest.fixture(scope="module")
def files(spark, batch):
    """Four files, written one after another in stream order."""
    path = scratch_path(spark, "files")
    for k in range(4):
        batch.where(f"seq > {k * 200} and seq <= {(k + 1) * 200}").coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, files, batch):
    return live.read_stream(spark, files, batch.schema)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_bloom_over_micro_batches(spark, files, batch):
    got = live.stream_bloom_seen(stream(spark, files, batch), "id", "seq", scratch_path(spark, "t"), 199, 2)
    assert rows(got) == rows(sketches.bloom_seen(batch, "id", "seq", 199, 2))


def test_flajolet_martin_over_micro_batches(spark, files, batch):
    got = live.stream_fm_windows(stream(spark, files, batch), "id", scratch_path(spark, "t"))
    assert rows(got) == rows(sketches.fm_distinct(batch, "id", "window").select("window", "estimate"))


def test_reservoir_over_micro_batches(spark, files, batch):
    got = live.stream_reservoir(stream(spark, files, batch), "id", "seq", scratch_path(spark, "t"))
    assert rows(got) == rows(sketches.reservoir(batch, "id", "seq"))


def test_event_time_windows(spark, files, batch):
    got = live.stream_event_windows(stream(spark, files, batch), "ts", "id", scratch_path(spark, "t"))
    assert [r.n for r in got.orderBy("window_start").collect()] == [200, 200, 200, 200]


@pytest.mark.parametrize("run", [
    lambda s, state: live.stream_reservoir(s, "id", "seq", state),
    lambda s, state: live.stream_bloom_seen(s, "id", "seq", state, 199, 2),
    lambda s, state: live.stream_fm_windows(s, "id", state),
])
def test_a_replayed_batch_overwrites_its_part(spark, files, batch, run):
    """Without the record of the last commit, the last micro-batch is run a second time over the same state."""
    state = scratch_path(spark, "t").removeprefix("file:")
    once = rows(run(stream(spark, files, batch), state))
    commits = sorted(f for f in os.listdir(f"{state}/progress/commits") if f.isdigit())
    assert commits[-1] == "3"
    for name in ("3", ".3.crc"):
        if os.path.exists(f"{state}/progress/commits/{name}"):
            os.remove(f"{state}/progress/commits/{name}")
    seen = []
    write = live._write_part
    try:
        live._write_part = lambda df, path, batch_id: (seen.append(batch_id), write(df, path, batch_id))
        again = rows(run(stream(spark, files, batch), state))
    finally:
        live._write_part = write
    assert seen and set(seen) == {3} and once == again

import math
import random
from statistics import mean, median

import pytest
from pyspark.sql import functions as F

from lodemine.functions.hashing import POSITION_PRIME, affine_family, position_hash, string_residue, trailing_zeros
from lodemine.operators import sketches

IDS = ["a", "", "user-17", "žluťoučký kůň", "0123456789abcdef0123456789", "日本語", "x" * 70]


def residue(s, m):
    return int.from_bytes(s.encode("utf8"), "big") % m


def test_string_residue_is_the_whole_integer(spark):
    df = spark.createDataFrame([(s,) for s in IDS] + [(None,)], "s string")
    for m in (499, 69997):
        got = {r.s: r.h for r in df.select("s", string_residue(F.col("s"), m).alias("h")).collect()}
        assert got == {**{s: residue(s, m) for s in IDS}, None: None}


def test_trailing_zeros(spark):
    got = {r.id: r.z for r in spark.range(70000).select("id", trailing_zeros(F.col("id")).alias("z")).collect()}
    for v, z in got.items():
        assert z == (10 if v == 0 else (v & -v).bit_length() - 1)


def test_position_hash_is_uniform(spark):
    df = spark.range(1, 20001).select((position_hash(F.col("id"), 553) / POSITION_PRIME).alias("u"))
    row = df.agg(F.avg("u"), F.variance("u"), F.min("u"), F.max("u"), F.avg((F.col("u") < 0.1).cast("double"))).first()
    assert abs(row[0] - 0.5) < 0.02 and abs(row[1] - 1 / 12) < 0.01 and 0 <= row[2] and row[3] < 1 and abs(row[4] - 0.1) < 0.02


@pytest.fixture(scope="module")
def stream():
    rng = random.Random(5)
    return [str(rng.choice([7, rng.randint(0, 400)])) for _ in range(900)]


@pytest.fixture(scope="module")
def frame(spark, stream):
    return spark.createDataFrame([(i + 1, s) for i, s in enumerate(stream)], "seq long, id string").repartition(5)


def bloom_model(stream, n_bits, family):
    bits, out = set(), []
    for s in stream:
        where = {(a * residue(s, n_bits) + b) % n_bits for _, a, b in family}
        out.append(bool(where - bits))
        bits |= where
    return out


@pytest.mark.parametrize("n_bits,n_hash", [(499, 2), (101, 1), (69997, None)])
def test_bloom_against_a_sequential_filter(frame, stream, n_bits, n_hash):
    family = affine_family(n_hash or sketches.bloom_hash_count(n_bits, len(stream)), 11)
    want = bloom_model(stream, n_bits, family)
    got = {r.seq: r.is_new for r in sketches.bloom_seen(frame, "id", "seq", n_bits, n_hash).collect()}
    assert [got[i + 1] for i in range(len(stream))] == want

    previous, rates = set(), []
    for at in range(0, len(stream), 100):
        ids, flags = stream[at : at + 100], want[at : at + 100]
        existed = set(ids) - {s for s, f in zip(ids, flags) if f}
        rates.append(len(existed - previous) / 100)
        previous |= set(ids)
    fpr = {r.batch: r.fpr for r in sketches.bloom_fpr(frame, "id", "seq", 100, n_bits, n_hash).collect()}
    assert [fpr[i] for i in range(9)] == pytest.approx(rates)
    if n_bits == 101:
        assert sum(rates) > 0


def test_bloom_hash_count_is_at_least_one():
    assert sketches.bloom_hash_count(100, 10**9) == 1
    assert sketches.bloom_hash_count(69997, 9000) == round(69997 / 9000 * math.log(2))
    assert 0 < sketches.bloom_expected_fpr(69997, 9000, 5) < 1


def test_flajolet_martin_against_a_sequential_model(frame, stream):
    m, n_hash, groups = 69997, 200, 5
    family = affine_family(n_hash, 23)
    batched = frame.withColumn("batch", sketches.batch_number("seq", 300))
    got = {r.batch: (r.exact, r.estimate) for r in sketches.fm_distinct(batched, "id", "batch").collect()}
    for i in range(3):
        ids = set(stream[i * 300 : (i + 1) * 300])
        top = []
        for _, a, b in family:
            zeros = []
            for s in ids:
                text = f"{(a * residue(s, m) + b) % m:010b}"
                zeros.append(len(text) - len(text.rstrip("0")))
            top.append(max(zeros))
        size = n_hash // groups
        assert got[i] == (len(ids), round(2 ** median(mean(top[g * size : (g + 1) * size]) for g in range(groups))))


def mixed(n, seed, p=POSITION_PRIME):
    h = (n % p * 48271 + n // p * 69621 + seed * 16807 + 12345) % p
    h = (h * h + 69621) % p
    h = (h * 48271 + n % p) % p
    h = (h * h + 48271) % p
    return (h * 69621 + 1) % p


def test_reservoir_against_a_sequential_model(frame, stream):
    slots, snaps = {}, {}
    for n, s in enumerate(stream, 1):
        if n <= 100:
            slots[n - 1] = (n, s)
        elif mixed(n, 553) / POSITION_PRIME < 100 / n:
            slots[mixed(n, 554) % 100] = (n, s)
        if n % 50 == 0:
            snaps[n] = tuple(slots[k][1] if k in slots else None for k in (0, 20, 40, 60, 80))
    got = {r.slot: (r.seq, r.id) for r in sketches.reservoir(frame, "id", "seq").collect()}
    assert got == slots
    rows = sketches.reservoir_snapshots(frame, "id", "seq", 50, block=4).collect()
    assert {r.seqnum: tuple(r)[1:] for r in rows} == snaps


def test_reservoir_of_a_short_stream_keeps_everything(spark, stream):
    short = spark.createDataFrame([(i + 1, s) for i, s in enumerate(stream[:40])], "seq long, id string")
    assert sorted(r.id for r in sketches.reservoir(short, "id", "seq").collect()) == sorted(stream[:40])

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodemine.operators import bfr


def point_frame(spark, rows):
    return spark.createDataFrame([(i, t, [float(v) for v in x]) for i, t, x in rows], "id long, cluster long, features array<double>")


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(3)
    centres = np.array([[0, 0, 0], [40, 0, 0], [0, 40, 0], [0, 0, 40]])
    rows = []
    for i in range(2000):
        c = i % 4
        rows.append((i, c, centres[c] + rng.normal(0, 1, 3)))
    for j, far in enumerate([(900, 900, 900), (-900, 500, 0), (0, -800, 700)]):
        rows.append((2000 + j, -1, np.array(far)))
    return rows


def test_stats_and_merge(spark, blobs):
    p = point_frame(spark, blobs)
    whole = {r.cluster: (r.n, r.sum, r.sumsq) for r in bfr.cluster_stats(p).collect()}
    merged = bfr.merge_stats(bfr.cluster_stats(p.where("id % 3 = 0")), bfr.cluster_stats(p.where("id % 3 <> 0")))
    for r in merged.collect():
        assert r.n == whole[r.cluster][0]
        assert r.sum == pytest.approx(whole[r.cluster][1]) and r.sumsq == pytest.approx(whole[r.cluster][2])
    x = np.array([v for _, c, v in blobs if c == 2])
    assert whole[2][1] == pytest.approx(x.sum(axis=0)) and whole[2][2] == pytest.approx((x**2).sum(axis=0))


def test_assignment_radius_ties_and_flat_clusters(spark):
    stats = bfr.Summaries([0, 1, 2], np.array([2.0, 2.0, 2.0]), np.array([[0.0, 0.0], [0.0, 0.0], [8.0, 8.0]]), np.array([[2.0, 2.0], [2.0, 2.0], [32.0, 32.0]]))
    p = point_frame(spark, [(1, 0, (0.5, 0.5)), (2, 0, (2.0, 2.0)), (3, 0, (4.0, 4.0))])
    got = {r.id: (r.cluster, r.distance) for r in bfr.assign_nearest(p, stats).collect()}
    assert got[1][0] == 0 and got[1][1] == pytest.approx(0.5**0.5)
    assert got[2][0] == -1 and got[3][0] == -1  # at the limit exactly; cluster 2 has no variance
    none = bfr.assign_nearest(p, bfr.Summaries.empty(2)).collect()
    assert {(r.cluster, r.distance) for r in none} == {(-1, None)}


def test_close_clusters_merge_in_key_order():
    def one(c):
        return 10.0, np.array([10.0 * c]), np.array([10.0 * (c * c + 1)])

    parts = [one(c) for c in (0.0, 1.0, 50.0, 51.0)]
    s = bfr.Summaries([3, 5, 7, 9], *(np.array([p[i] for p in parts]) for i in range(3)))
    assert bfr.merge_close(s, 1.5) == {5: 3, 9: 7}
    assert s.keys == [3, 7] and s.n.tolist() == [20, 20]
    target = bfr.Summaries([0], np.array([20.0]), np.array([[0.0]]), np.array([[20.0]]))
    assert bfr.merge_into(target, s, 1.0) == {3: 0} and s.keys == [7]


def test_cluster_distance_matches_driver_arithmetic(spark, blobs):
    stats = bfr.cluster_stats(point_frame(spark, blobs)).where("cluster >= 0").persist()
    s = bfr.Summaries.collect(stats, 3)
    got = {(r.a, r.b): r.distance for r in bfr.cluster_distance(stats, stats).collect()}
    assert len(got) == 6
    for (a, b), d in got.items():
        assert d == pytest.approx(s.distances(a, s)[b])


def plain_lloyd(x, centres, steps):
    keys = list(range(len(centres)))
    for _ in range(steps):
        label = np.array([min(range(len(centres)), key=lambda c: (((v - centres[c]) ** 2).sum(), c)) for v in x])
        used = [c for c in range(len(centres)) if (label == c).any()]
        keys, centres = [keys[c] for c in used], np.array([x[label == c].mean(axis=0) for c in used])
    return keys, centres


def test_lloyd_steps_from_given_centres(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    p = point_frame(spark, [(i, 0, v) for i, v in enumerate(x)]).repartition(5)
    first = np.vstack([x[:6], [[50, 50, 50]]])  # the last one has no points and goes
    for steps in (1, 4):
        keys, centres = bfr.lloyd(p, list(range(7)), first, steps)
        want_keys, want = plain_lloyd(x, first, steps)
        assert keys == want_keys == list(range(6)) and np.allclose(centres, want)
    near = {r.id: r.cluster for r in bfr.nearest_centre(p, keys, centres).collect()}
    assert all(near[i] == int(np.argmin(((centres - v) ** 2).sum(axis=1))) for i, v in enumerate(x))
    stats = bfr.Summaries.gather(bfr.nearest_stats(p, keys, centres), 3)
    assert stats.n.sum() == 300 and np.allclose(stats.sumsq.sum(axis=0), (x**2).sum(axis=0))


def test_lloyd_stops_when_no_centre_moves(spark):
    p = point_frame(spark, [(i, 0, (float(i // 5),)) for i in range(10)])
    assert bfr.lloyd(p, [0, 1], np.array([[0.0], [1.0]]), 10**6)[1].tolist() == [[0.0], [1.0]]


def test_first_points_are_far_apart_and_follow_the_hash(spark):
    import hashlib

    rows = [(i, 0, (float(i % 5), float(i % 3))) for i in range(60)]
    keys, centres = bfr.first_points(point_frame(spark, rows), 4, seed=5)
    order = sorted(range(60), key=lambda i: (hashlib.md5(f"5:{i}".encode()).hexdigest(), i))[:16]
    taken = [order[0]]
    while len(taken) < 4:
        taken.append(max(order, key=lambda i: (min(np.hypot(i % 5 - j % 5, i % 3 - j % 3) for j in taken), -order.index(i))))
    assert keys == [0, 1, 2, 3] and centres.tolist() == [[i % 5, i % 3] for i in taken]
    assert len(bfr.first_points(point_frame(spark, [(i, 0, (float(i % 3),)) for i in range(30)]), 8)[0]) == 3  # copies are taken once


def test_clustering_without_points_or_with_few(spark):
    with pytest.raises(ValueError):
        bfr.bfr(point_frame(spark, []), k=2)
    same = bfr.bfr(point_frame(spark, [(i, 0, (1.0, 1.0)) for i in range(7)]), k=2, chunks=3)
    assert same.labels.count() == 7
    assert [r.n_ds + r.n_cs + r.n_rs for r in same.rounds.orderBy("round").collect()] == [3, 5, 7]


def test_blobs_are_recovered_and_outliers_left_out(spark, blobs):
    p = point_frame(spark, blobs)
    found = bfr.bfr(p, k=4, seed=1)
    labels = {r.id: r.cluster for r in found.labels.collect()}
    assert found.labels.count() == len(blobs) == len(labels)
    for c in range(4):
        inside = [labels[i] for i, t, _ in blobs if t == c]
        common = max(set(inside), key=inside.count)
        assert common >= 0 and inside.count(common) > 0.9 * len(inside)
    outliers = [labels[i] for i, t, _ in blobs if t == -1]
    assert outliers == [-1, -1, -1]
    rounds = found.rounds.orderBy("round").collect()
    assert [r.round for r in rounds] == [1, 2, 3, 4, 5]
    assert rounds[-1].n_ds + rounds[-1].n_cs + rounds[-1].n_rs == len(blobs)
    assert found.labels.where(F.col("cluster") >= 0).count() == rounds[-1].n_ds

"""Rows that the vantage-point tree sends grow as the fingerprints do."""

import numpy as np

from tallyspark.llm import simhash


def lying(n):
    """Fingerprints around the same centres, however many there are."""
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 40, np.uint64)
    flips = np.packbits(rng.random((n, 64)) < 0.18, axis=1).view(np.uint64)[:, 0]
    return np.unique(rng.choice(centres, n) ^ flips)


def sent(spark, points, monkeypatch):
    trees, plain = [], simhash.VantageTree

    def keep(*args, **kwargs):
        trees.append(plain(*args, **kwargs))
        return trees[-1]

    monkeypatch.setattr(simhash, "VantageTree", keep)
    rows = simhash.settle(spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long"), "points")
    simhash.link(rows)
    monkeypatch.setattr(simhash, "VantageTree", plain)
    return sum(len(at) for _, at in trees[0].route(points)) / len(points)


def test_a_point_is_sent_as_often_whatever_the_number_of_points(spark, monkeypatch):
    few, many = sent(spark, lying(25_000), monkeypatch), sent(spark, lying(125_000), monkeypatch)
    assert few > 1.5 and many < 1.25 * few


def test_a_shard_that_splits_itself_loses_no_link():
    rng = np.random.default_rng(6)
    centres = rng.integers(0, 1 << 63, 6_000, np.uint64)
    points = np.unique(np.concatenate([centres, centres ^ np.uint64(5), centres ^ np.uint64(1 << 40)]))
    assert len(points) > 4 * simhash.BRUTE
    label = simhash.link_shard(points)
    place = {int(p): i for i, p in enumerate(points)}
    for c in centres.tolist():
        own = [place[c], place[c ^ 5], place[c ^ (1 << 40)]]
        assert set(label[own]) == {min(own)}

"""What a search of neighbours writes grows with the vectors, not with queries times vectors."""

import os

import numpy as np

from tallyspark.llm import neighbours
from tallyspark.sources import shared


def test_possible_members_are_not_written(spark, monkeypatch):
    v = np.random.default_rng(3).normal(size=(4000, 64)).astype(np.float32)
    table = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(v)], "vec_id long, embedding array<float>")
    sizes = {}

    def settle(df, name):
        out = shared.settle(df, name)
        sizes[name] = sum(os.path.getsize(f.removeprefix("file://")) for f in out.inputFiles())
        return out

    monkeypatch.setattr(neighbours, "settle", settle)
    got = {}
    for r in neighbours.nearest(table, every_nth=2, block=1000).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    assert sum(sizes.values()) < 3.5 * sizes["vectors"]
    assert len(got) == 2000 and all(len(found) == 5 for found in got.values())
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    score = unit[::2] @ unit.T
    score[np.arange(2000), np.arange(0, 4000, 2)] = -np.inf
    best = np.argsort(-score, axis=1)[:, :5]
    assert sum(i in got[2 * q] for q, row in enumerate(best.tolist()) for i in row) >= 0.995 * best.size

"""The nearest vectors against all pairs, and their cost."""

import functools
import math
import random
import time

from ripplegraph.operators import relational, vectors


def all_pairs(v, q, k):
    def score(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b:
            return None
        dot = lambda x, y: functools.reduce(lambda s, p: s + p[0] * p[1], zip(x, y, strict=True), 0.0)
        norms = math.sqrt(dot(a, a)) * math.sqrt(dot(b, b))
        return dot(a, b) / norms if norms else None

    out = []
    for query, b in q:
        scored = sorted(((score(a, b), k) for k, a in v), key=lambda x: (x[0] is None, -(x[0] or 0.0), x[1]))
        out += [(query, i, n + 1, s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out, key=repr)


def test_nearest_is_what_all_pairs_give(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK", 7)
    monkeypatch.setattr(vectors, "BLOCK", 20)
    rng = random.Random(5)
    v = [(k, [rng.gauss(0, 1) for _ in range(9)]) for k in range(300)]
    v += [(1000 - k, v[0][1]) for k in range(40)] + [(2000 + k, [2 * x for x in v[1][1]]) for k in range(30)]
    v += [(3000, None), (3001, [0.0] * 9), (3002, [1.0]), (3003, [1.0, None] + [0.0] * 7), (3004, [1e200] * 9)]
    q = [(k, x) for k, x in v if k % 5 == 0]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>").repartition(3)
    got = relational.nearest(df, spark.createDataFrame(q, "query_id long, vector array<double>"), 6).collect()
    want = [x for x in all_pairs(v, q, 6) if x[1] != 3004 and x[0] != 3004]
    assert sorted(((r.query_id, r.vec_id, r["rank"], r.score) for r in got if r.vec_id != 3004 and r.query_id != 3004), key=repr) == want


def test_few_vectors_and_none(spark):
    v = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0])], "vec_id string, embedding array<float>")
    q = spark.createDataFrame([("x", [1.0, 1.0])], "query_id string, vector array<float>")
    assert [(r.vec_id, r["rank"]) for r in relational.nearest(v, q, 10).orderBy("rank").collect()] == [("a", 1), ("b", 2)]
    assert relational.nearest(v.limit(0), q, 10).count() == 0 and relational.nearest(v, q.limit(0), 10).count() == 0


def test_half_a_hundred_million_pairs_take_seconds(spark):
    v = spark.range(32000).selectExpr("id AS vec_id", "transform(sequence(1, 64), x -> CAST(sin(id * 7.3 + x * x * 0.37 + (id % 97) * x) AS float)) AS embedding").cache()
    q = v.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding AS vector")
    v.count()
    began = time.perf_counter()
    assert relational.nearest(v, q, 10).count() == 16000
    assert time.perf_counter() - began < 30

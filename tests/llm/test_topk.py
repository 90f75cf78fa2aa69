import math
import random
from fractions import Fraction

from pyspark.sql import functions as F

from fathom.llm import topk
from fathom.llm.topk import top_k


def brute(vectors, k=5, every=50):
    q = {}
    rows = []
    for i, v in vectors:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(256 * Fraction(x)) for x in v]
        rows.append((i, w))
        if i % every == 0:
            q[i] = min(q.get(i, w), w)
    out = []
    for i, v in q.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in rows if j != i and len(w) == len(v))
        out += [(i, r, j, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for r, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def found(spark, vectors, kind="float", **kw):
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in vectors], f"vec_id long, embedding array<{kind}>, label string, rank int")
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(df, F.col("vec_id") % 50 == 0, **kw).collect())


def test_ties_and_edge_cases(spark):
    rng = random.Random(1)
    vectors = [(i, [rng.randint(-3, 3) / 4 for _ in range(4)]) for i in range(300)]
    vectors += [(1000 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(200)]  # one very common vector
    vectors += [(None, [1.0] * 4), (450, None), (500, [1.0, None, 1.0, 1.0]), (550, [float("nan")] * 4), (600, [float("inf")] * 4), (650, [1e30] * 4), (700, []), (750, [1.0, 2.0]), (751, [3.0, 1.0]), (-50, [1.0] * 4), (250, [0.25] * 4)]
    vectors = [(i, v if v is None else [x if x is None else F32(x) for x in v]) for i, v in vectors]
    assert found(spark, vectors) == brute(vectors)


def test_large_components(spark):
    """No finite vector is left out, whatever its components: at 65,536, where float64 and 64 bits end, and at the ends of a double."""
    rng = random.Random(4)
    vectors = [(i, [rng.choice((1.0, -2.5, 0.0, 65535.99, 65536.0, -70000.0, 2.0**31, 3e9 + 0.5, 1e15 + 0.25, -1e19, 1e30)) for _ in range(3)]) for i in range(120)]
    vectors += [(200 + i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(60)]
    assert found(spark, vectors, "double") == brute(vectors)
    ends = [(50 * i, [x, y]) for i, (x, y) in enumerate([(1.7e308, -1.7e308), (1.7e308, 1.6e308), (-1.7e308, 5e-324), (1.0, 1.0), (-5e-324, 0.0)])]
    assert found(spark, [*ends, (1, [2.0, 2.0])], "double") == brute([*ends, (1, [2.0, 2.0])])
    assert [r[2] for r in found(spark, [(0, [1.0, 1.0]), (1, [70000.0, 1.0]), (2, [2.0, 2.0]), (3, [0.5, 0.5])])] == [1, 2, 3]


def test_empty_vectors(spark):
    vectors = [(i, []) for i in range(0, 130, 10)] + [(1, [1.0])]
    assert found(spark, vectors) == brute(vectors) != []


def test_few_candidates_and_no_rows(spark):
    vectors = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (50, [-1.0, 0.0])]
    assert found(spark, vectors) == brute(vectors)
    assert found(spark, [(0, [1.0])]) == [] and found(spark, []) == []


def test_several_blocks_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 3)
    rng = random.Random(2)
    vectors = [(i, [float(rng.uniform(-2, 2)) for _ in range(3)]) for i in range(0, 500, 5)]
    f32 = [(i, [float(F32(x)) for x in v]) for i, v in vectors]
    assert found(spark, f32, k=7) == brute(f32, k=7)


def F32(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]

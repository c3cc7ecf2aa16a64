import math
import random
from pathlib import Path

import numpy as np
import pytest

from palimpsest.llm import queries, topk

SF = "/root/testdata/sf0.01"


def test_query_equals_sql(spark, agree):
    assert agree(queries.op8_topk(spark, SF), queries.ORACLES["op8_topk"], SF) == 50


def brute(rows, every, k=5):
    whole = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for q in {i for i, _ in whole if i % every == 0}:
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for p, v in whole if p == q for i, w in whole if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("size", [7, 64, 1024])
def test_equals_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(topk, "SHARD", size)
    monkeypatch.setattr(topk, "SMALL", size)
    monkeypatch.setattr(topk, "ASKED", 5)
    monkeypatch.setattr(topk, "LEAF", 3)
    random.seed(size)
    rows = [(i, [random.choice([-0.5, 0.01, 0.25, 0.3]) for _ in range(4)]) for i in range(300)]
    rows += [(i, [0.9, 0.9, 0.9, 0.9]) for i in range(300, 420)]  # many copies: ties
    rows += [(500, None), (550, [1.0, None]), (600, [float("nan"), 1.0]), (650, [float("inf")]), (None, [9.0] * 4), (700, [0.4]), (750, []), (800, [3e6, -3e6, 2e6, 0.1]), (801, [3.1e6] * 4), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as rank", "2 as shard")
    assert sorted(tuple(r) for r in topk.top(df, 50).collect()) == brute(rows, 50)


@pytest.mark.parametrize("boxes", [64_000_000, 0])
def test_repeated_ids(spark, agree, monkeypatch, tmp_path, boxes):
    """Equal and different vectors under one id, in any order, also where a third of all rows are the same: all are candidates, as in the SQL."""
    monkeypatch.setattr(topk, "SHARD", 40)
    monkeypatch.setattr(topk, "SMALL", 40)
    monkeypatch.setattr(topk, "BOXES", boxes)
    random.seed(3)
    rows = [(i % 70, [random.choice([0.1, 0.5, -0.25]) for _ in range(3)]) for i in range(200)] + [(7, [0.5, 0.5, 0.5])] * 100 + [(50, [0.5, 0.1, 0.1])] * 3
    for turn in range(2):
        random.shuffle(rows)
        at = tmp_path / str(turn)
        at.mkdir()
        for table in Path(SF).glob("*.parquet"):
            (at / table.name).symlink_to(table)
        (at / "embeddings.parquet").unlink()
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        df.toPandas().to_parquet(at / "embeddings.parquet")
        assert agree(queries.op8_topk(spark, str(at)), queries.ORACLES["op8_topk"], str(at)) == 10
        assert sorted(tuple(r) for r in topk.top(df, 50).collect()) == brute(rows, 50)


def test_shards_out_of_reach_are_not_asked():
    import pandas as pd

    box = lambda lo, hi: [lo, lo, hi, hi]
    ask = topk._asking([(1, box(0.0, 1.0)), (2, box(9.0, 10.0)), (3, box(4.0, 5.0))])
    asks = topk._rows(1, 1, id=[50, 100], vec=[[1.0, 1.0], [2.0, 0.0]], least=[10.5, None])
    got = pd.concat(ask(iter([asks])))
    assert sorted(zip(got["shard"], got["id"])) == [(2, 50), (2, 100), (3, 100)]


def test_few_rows(spark):
    df = spark.createDataFrame([(50, [1.0]), (100, [2.0]), (7, [0.5])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in topk.top(df, 50).collect()) == [(50, 1, 100, 131072), (50, 2, 7, 32768), (100, 1, 50, 131072), (100, 2, 7, 65536)]
    assert topk.top(df.limit(0), 50).collect() == [] == topk.top(df.where("vec_id = 50"), 50).collect()


def test_bounds_prune():
    rng = np.random.default_rng(7)
    rows = np.floor(rng.normal(size=(4096, 3)) * 256)
    tree, seen = topk.Tree(np.arange(4096), rows), []
    tree.rows = type("Rows", (np.ndarray,), {"__getitem__": lambda s, x: (seen.append(x), np.ndarray.__getitem__(s, x))[1]})(rows.shape, buffer=tree.rows.copy())
    (got,) = tree.search(rows[:1], np.array([0]), [None])
    want = sorted((-int(s), i) for i, s in enumerate(rows @ rows[0]) if i)[:5]
    assert [(-s, i) for s, i in got] == want and 0 < len(seen) < 30

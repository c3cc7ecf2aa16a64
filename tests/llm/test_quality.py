import zlib

import numpy as np

from palimpsest.llm import quality


def read(spark, sf, name):
    return spark.read.parquet(f"/root/testdata/sf{sf}/{name}.parquet")


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = label.sum()
    return (rank[label == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(label) - pos))


def test_held_out_accuracy(spark):
    docs, labels = read(spark, 0.1, "documents"), read(spark, 0.1, "labels")
    got = quality.report(docs, labels).join(labels, "doc_id").toPandas()
    out = got[got.held_out]
    assert len(out) > 300 and set(out.doc_id) == {d for d in got.doc_id if zlib.crc32(str(d).encode()) % 5 == 0}
    assert auc(out.score.to_numpy(), out.quality.to_numpy()) > 0.95
    assert (out.predicted == out.quality).mean() > 0.93
    assert ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_held_out_labels_do_not_matter(spark):
    docs, labels = read(spark, 0.01, "documents"), read(spark, 0.01, "labels")
    turned = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - quality else quality end as quality")
    a, b = (sorted(map(tuple, quality.report(docs, x).collect())) for x in (labels, turned))
    assert a == b and len(a) == docs.count()


def test_flat_trees_equal_a_plain_walk():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, len(quality.STATISTICS)))
    y = (x[:, 3] + x[:, 7] * x[:, 1] > 0).astype(float)
    trees = quality.fit(x, y)
    score = trees.score(x)
    assert ((score > 0.5) == y).mean() > 0.95
    for i in range(0, 400, 37):
        total = trees.base
        for f, a, leaf in zip(trees.feature, trees.above, trees.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if x[i, f[node]] > a[node] else 1)
            total += leaf[node - len(f)]
        assert abs(1 / (1 + np.exp(-total)) - score[i]) < 1e-12


def test_edges(spark):
    rows = [(1, None, 9), (2, "", 9), (2, "", 9), (None, "text", 9), (4, "word " * 200_000, 9), (5, "\n\n", 9), (6, "\U0001f600", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.report(docs, none).collect()
    assert len(got) == 7 and {r.score for r in got} == {0.5} and [r.held_out for r in got if r.doc_id is None] == [True]
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, None), (5, 1), (6, 0), (None, 1)], "doc_id long, quality int")
    got = quality.report(docs, labels).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert quality.accepted(docs, labels).columns == docs.columns
    assert quality.report(docs.limit(0), labels).collect() == []


def test_first_split_equals_brute_force():
    """Of the root: the feature and cut with the greatest gain, over all features and all cuts of their histograms."""
    rng = np.random.default_rng(6)
    for turn in range(5):
        x = np.round(rng.normal(size=(300, 4)), 1 + turn % 2)
        y = (x[:, turn % 4] + rng.normal(size=300) > 0.3).astype(float)
        trees = quality.fit(x, y)
        p = (y.sum() + 1) / (len(y) + 2)
        g, h = p - y, np.full(len(y), p * (1 - p))
        value = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + quality.RIDGE)  # noqa: B023, E731
        best = (0.0, None, None)
        for f in range(4):
            for cut in np.unique(np.quantile(x[:, f], np.linspace(0, 1, quality.BINS + 1)[1:-1])):
                left = x[:, f] <= cut
                if min(h[left].sum(), h[~left].sum()) >= quality.LEAST:
                    best = max(best, (value(left) + value(~left) - value(np.ones(len(y), bool)), f, cut), key=lambda b: b[0])
        assert (trees.feature[0, 0], trees.above[0, 0]) == best[1:]


def test_many_documents_of_one_id(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE", 50)
    docs = spark.createDataFrame([(i % 3, f"text {i} " * (i % 7)) for i in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(3)], "doc_id long, quality int")
    one, two = (sorted(map(tuple, quality.report(x, labels).collect())) for x in (docs, docs.repartition(5)))
    assert one == two and len(one) == 500

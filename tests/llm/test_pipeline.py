import corpus_pipeline
import sentencepiece
from test_copies import shingled, similar
from test_decontam import distance
from test_pii import brute
from test_simhash import roots

from palimpsest.llm import decontam, pieces, quality

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    take = lambda name, d: dict(corpus_pipeline.STAGES)[name](spark, d, SF)

    good = take("quality", docs)
    trees = quality.train(docs, labels)
    want = {d for d, r in rows.items() if trees.score(quality.np.array([quality.statistics(r.text.encode())]))[0] >= 0.3}
    assert {r.doc_id for r in good.collect()} == want and good.columns == docs.columns

    single = take("near_dedup", good)
    want = set(roots([(d, shingled(rows[d].text)) for d in sorted(want)], similar))  # five words, 0.8 or more
    assert {r.doc_id for r in single.collect()} == want and single.columns == docs.columns

    unseen = take("decontamination", single)
    items = [decontam.normal(r.text) for r in bench.collect()]
    texts = {d: decontam.normal(rows[d].text) for d in want}
    left = {r.doc_id for r in unseen.collect()}
    for d in want - left:
        assert any(distance(i, texts[d]) <= len(i) // 10 for i in items)
    assert not any(i in texts[d] for d in left for i in items)

    private = take("pii", unseen).collect()
    assert {r.doc_id for r in private} == left
    for r in private:
        if not brute(rows[r.doc_id].text):
            assert r.text == rows[r.doc_id].text or "[IBAN]" in r.text or "[SSN]" in r.text
        assert not brute(r.text) and r.n_chars == len(r.text)

    # What the classifier kept is read again, but not scored again: the plan's one Python filter is decontamination's.
    plan = corpus_pipeline.run(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("MapInArrow") == 1
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    final = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.text, tuple(r.ids)) for r in final) == sorted((r.doc_id, r.text, tuple(library.encode(r.text))) for r in private)


def test_odd_tables(spark, tmp_path):
    rows = [(1, None, "en", "a", None), (1, None, "en", "a", None), (2, "", None, None, 0), (None, "mail x@y.zz", "en", "b", 11), (3, "mail x@y.zz now", "en", "b", 15)]
    for name, docs in (("odd", rows), ("none", [])):
        at = tmp_path / name
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        got = {(r.doc_id, r.text, r.n_chars) for r in corpus_pipeline.run(spark, str(at)).collect()}
        assert got == ({(1, None, None), (None, "mail [EMAIL]", 12), (3, "mail [EMAIL] now", 16)} if docs else set())

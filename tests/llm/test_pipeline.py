import corpus_pipeline


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, sf)
        assert made.columns == columns, name
        docs = made.checkpoint()
    assert 0.5 * n < docs.count() <= n and docs.select("doc_id").distinct().count() == docs.count()
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert tokens.count() == docs.count() and tokens.where("size(ids) = 0").count() == 0


def test_language_stage_keeps_what_it_cannot_judge(spark, sf):
    stage = corpus_pipeline.known_language
    few = [(1, "some plain words here", "en"), (2, "and a few others too", "en"), (3, "words again, not many", "en"), (4, None, "en"), (5, "", None), (6, "12 34", "en"), (7, " ", "en")]
    made = stage(spark, spark.createDataFrame([(*r, True) for r in few], "doc_id long, text string, lang string, rejected boolean"), sf)
    assert made.columns == ["doc_id", "text", "lang", "rejected"]
    assert sorted(r.doc_id for r in made.collect()) == [1, 2, 3]
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    lettered = [r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")]
    unlabelled = docs.selectExpr("doc_id", "text", "cast(null as string) as lang", "source", "n_chars")
    assert sorted(r.doc_id for r in stage(spark, unlabelled, sf).collect()) == sorted(lettered)
    assert stage(spark, docs.limit(0), sf).count() == 0


def test_stages_of_odd_rows(spark, sf):
    """Null ids, texts and labels, repeated rows, extra columns and nothing at all go through every stage."""
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text, "en", "a", 1, 0), (1, text, "en", "a", 1, 0), (2, text + " end", None, None, None, 0), (3, None, "en", "b", 0, 0), (None, "a text without an id, and words of its own", "en", "b", 5, 0), (4, "", None, None, 0, 0), (5, "one word of this is another one, they say", "de", "c", 7, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node int")
    for some in (docs, docs.limit(0)):
        left = some
        for _, stage in corpus_pipeline.STAGES:
            left = stage(spark, left, sf)
        kept = left.collect()
        assert "node" in left.columns and "text" not in left.columns
        if some is docs:
            assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 1, 5] and all(r.ids for r in kept)
        else:
            assert not kept

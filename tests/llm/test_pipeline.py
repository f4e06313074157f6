"""The pipeline's stages: each works on what the one before kept, and its decisions take effect."""

import corpus_pipeline as p


def test_stages_follow_one_another(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, seen[-1], sf)
        assert out.columns == p.COLUMNS, name
        seen.append(spark.createDataFrame(out.collect(), out.schema))
    good, single, short, mixed = seen[1:]
    assert 0 < single.count() <= good.count() < docs.count()
    assert short.count() == single.count()
    ids = lambda f: {r.doc_id for r in f.select("doc_id").collect()}
    assert ids(mixed) <= ids(short) == ids(single) <= ids(good) <= ids(docs)
    copies = mixed.groupBy("doc_id").count().agg({"count": "max"}).first()[0]
    assert copies <= 3
    last = p.STAGES[-1][1](spark, mixed, sf)
    assert last.count() == mixed.count()


def test_no_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_odd_rows(spark, sf):
    """Nulls in every column, empty and repeated rows go through all stages; what no stage has a reason against stays."""
    words = " ".join(f"plain{i % 97}x{i}" for i in range(300))
    rows = [
        (1, words, "en", "a", 1), (1, words, "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0), (None, words + " and more", "de", "b", 1), (5, " \n\t ", "fr", "b", 4),
        (6, "é😀 <|im_end|> 漢字 " + words.upper(), None, "b", 9),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == p.COLUMNS
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert {r.doc_id for r in docs.collect()} >= {1}
    last = p.STAGES[-1][1](spark, docs, sf)
    assert last.count() == docs.count() and {"doc_id", "n_pieces", "ids"} <= set(last.columns)

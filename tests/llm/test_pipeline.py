"""The pipeline's stages keep columns, act on what they get, and catch what they should."""

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.first()
    extra = spark.createDataFrame([
        (9001, first.text, None, None, 0), (9002, None, None, None, None), (9003, "", "en", "s", 0), (9003, "", "en", "s", 0)], docs.schema)
    current = docs.union(extra)
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "toxicity", "near_duplicates", "decontamination", "tokens"]
    counts = [current.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, SF)
        assert current.columns == docs.columns
        current = spark.createDataFrame(current.toPandas(), docs.schema)
        counts.append(current.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 100
    ids = [r.doc_id for r in current.select("doc_id").collect()]
    assert not (first.doc_id in ids and 9001 in ids)
    last = corpus_pipeline.STAGES[-1][1](spark, current, SF)
    assert last.count() == counts[-1] and "ids_sha256" in last.columns


def test_run(spark):
    assert 0 < corpus_pipeline.run(spark, SF).count() < 200


def test_nothing_else_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(corpus_pipeline.__file__).parent
    for file in (root / "tactus").rglob("*.py"):
        if "llm" not in file.relative_to(root).parts:
            assert "tactus.llm" not in file.read_text(), file

import corpus_pipeline
from gaugeflow.llm import mixing, packing, quality, rules, simhash

SF = "/root/testdata/sf0.001"


def test_stages_follow_the_operators(spark):
    """Each stage keeps what its operator keeps, on all that its predecessor kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    expected = {
        "quality_classifier": lambda d: [
            r.doc_id for r in quality.quality_scores(d, labels).collect() if r.score >= 0.7],
        "quality_rules": lambda d: [
            r.doc_id for r in rules.quality_rules(d, labels).collect() if r.rules.kept],
        "simhash_near_dedup": lambda d: list({
            r.component_id for r in simhash.near_duplicates(d).collect()}),
        "source_mixing": lambda d: [r.id for r in mixing.placements(d).collect()],
        "length_packing": lambda d: [r.id for r in packing.placements(d).collect()],
    }
    assert [name for name, _ in corpus_pipeline.STAGES] == list(expected)
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, SF)
        if name != "length_packing":
            assert kept.columns == docs.columns
        kept = spark.createDataFrame(kept.collect(), kept.schema)
        assert sorted(r.doc_id for r in kept.collect()) == sorted(expected[name](docs)), name
        docs = kept
    assert docs.count() == corpus_pipeline.run(spark, SF).count() > 0


def test_stages_take_odd_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    rows = [(1, None, None, None, None, None), (None, "", "en", None, 0, "x"),
            (2, "word " * 30, "en", "s", 150, "y"), (2, "word " * 30, "en", "s", 150, "y")]
    for data in (rows, []):
        for name, stage in corpus_pipeline.STAGES:
            docs = spark.createDataFrame(data, schema)
            kept = stage(spark, docs, SF)
            assert kept.columns[:6] == docs.columns, name
            # mixing may repeat a small source
            most = mixing.MAX_REPETITION if name == "source_mixing" else 1
            assert kept.count() <= most * len(data), name

import re

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_hand_on_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept, SF).write.parquet(str(tmp_path / name))
        found = spark.read.parquet(str(tmp_path / name))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert found.schema.simpleString() == docs.schema.simpleString(), name
            assert found.where(F.col("n_chars") != F.length("text")).count() == 0
        assert 0 < found.count()
        kept = found
    assert set(kept.columns) >= {"doc_id", "ids", "n_tokens"} and kept.where("n_tokens <> size(ids)").count() == 0


def test_run_survives_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_against_brute_force(spark):
    """Each stage on what the one before has kept: near duplicates and passages by brute force, the mixture by SQL, tokens
    by the library, and what the classifier rejects by its own scores."""
    import duckdb
    import tokenizers
    from test_operators import brute, repeated

    from tidemark.llm import quality_crf
    from tidemark.llm._spark import materialize, table
    from tidemark.llm.queries import _op10_sql, learnable, tokenizer_path

    d, kept = SF, {}
    stage = dict(corpus_pipeline.STAGES)
    documents = table(spark, d, "documents")
    text = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}

    kept["quality"] = materialize(stage["quality"](spark, documents, d), "t")
    field = quality_crf.fit(documents, learnable(table(spark, d, "labels"), 5, 0))
    assert set(text(kept["quality"])) == {r.doc_id for r in quality_crf.score(documents, field).collect() if r.score >= 0.3}

    before = text(kept["quality"])
    kept["near"] = materialize(stage["near_duplicates"](spark, kept["quality"], d), "t")
    groups = brute(before, 5, 4, 5)
    assert text(kept["near"]) == {i: before[i] for i, (_, c) in groups.items() if i == c}

    before = text(kept["near"])
    kept["passages"] = materialize(stage["repeated_passages"](spark, kept["near"], d), "t")
    ids = sorted(before)
    gone = {(ids[i], w) for i, w in repeated([re.sub(r"[\x0b\x0c]", " ", before[i] or "") for i in ids])[1]}
    want = {i: [w for k, w in enumerate(re.findall(r"[^\x20\x09-\x0D]+", before[i] or "")) if (i, k) not in gone] for i in ids}
    after = text(kept["passages"])
    assert {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in after.items()} == {i: w for i, w in want.items() if w or not before[i]}

    kept["mixture"] = materialize(stage["mixture"](spark, kept["passages"], d), "t")
    con = duckdb.connect()
    con.register("documents", kept["passages"].toPandas())
    assert sorted(r.doc_id for r in kept["mixture"].collect()) == sorted(r[0] for r in con.execute(_op10_sql()).fetchall())

    own = tokenizers.Tokenizer.from_file(tokenizer_path())
    for r in stage["tokens"](spark, kept["mixture"], d).collect():
        assert r.ids == own.encode(after[r.doc_id] or "", add_special_tokens=False).ids

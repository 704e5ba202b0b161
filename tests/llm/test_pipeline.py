"""The pipeline's stages on the smallest tables, each against what its operator decides."""

import __spark_entry__
import corpus_pipeline
from tessera.llm import decontaminate, language, mixing
from tests.llm import brute
from tests.llm.test_operators import similar_groups


def test_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))


def test_stages(spark, sf_dir, tmp_path, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    kept = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        kept.append((before, docs))
        if i < 4:
            assert docs.columns == columns
    before, after = kept[0]
    known = language.predict_languages(before).filter("lang_pred <> 'und' AND score >= 0.5")
    assert {r[0] for r in after.select("doc_id").collect()} == {r["doc_id"] for r in known.collect()}
    before, after = kept[1]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    left = {r["doc_id"] for r in after.collect()}
    # the least doc_id of every group that comparing all pairs gives
    assert left == set(similar_groups(texts).values())
    before, after = kept[2]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {r[0] for r in brute.contamination_rows([(r["doc_id"], r["text"]) for r in before.collect()], items) if not r[-1]}
    assert {r["doc_id"] for r in after.collect()} == clean
    assert decontaminate.WINDOW == 13
    before, after = kept[3]
    taken = sum(r["taken"] for r in mixing.mix(before).collect())
    assert sum(len(r["text"].split()) for r in after.collect()) == taken
    before, after = kept[4]
    wanted = brute.token_rows([(r["doc_id"], r["text"]) for r in before.collect()], tokenizer, 2)
    assert sum(r[2] for r in wanted) == sum(r["n_tokens"] for r in after.collect()) and len(wanted) == after.count()


def test_run_equals_stages(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir)
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and found.count() > 0

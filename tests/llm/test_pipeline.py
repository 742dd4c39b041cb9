import numpy as np
import pytest
from tokenizers import Tokenizer

from slatecast.llm import mixing, queries, simhash
from slatecast.llm import pipeline as corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, odd, labels, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    odd.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_in_order(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, folder)
        path = f"{folder}/{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        sizes.append(docs.count())
        if name == "simhash":
            groups = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(before).collect()}
            kept = {r["doc_id"] for r in docs.collect()}
            assert kept - {None} == {c for c in groups.values() if c is not None}
        if name == "mixing":
            plan = mixing.mix(before).collect()
            assert sum(r["taken"] for r in plan) == sum(len((r["text"] or "").encode().split()) for r in docs.collect())
        if name == "packing":
            import public_tokenizers

            t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            ids = sum(len(t.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in before.collect())
            assert sum(r["length"] for r in docs.collect()) == ids == sum(len(np.frombuffer(r["ids"], "<u4")) for r in docs.collect())
        else:
            assert docs.columns == columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "suffixes", "mixing", "packing"] and all(sizes)


def test_run_and_queries(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 14)} | {"pipeline", "spotsigs"}


def test_stages_of_an_empty_table(spark, folder, none):
    docs = none
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0 and (name == "packing" or docs.columns == none.columns)

"""The pipeline, stage by stage, against the operators' own results, and on edge rows."""

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline as p
from deskpark.llm import decontaminate, pii, quality_classifier, simhash
from deskpark.llm.queries import PIECES
from llm.cases import SF_SMALL


def test_stages_are_those_asked_for():
    assert [f.__name__ for _, f in p.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "tokens"]


def test_each_stage_on_what_its_predecessor_kept(spark, tmp_path):
    own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECES))
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    items = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()
    for name, stage in p.STAGES:
        out = stage(spark, docs, SF_SMALL)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before) and out.count() == len(after)
        if name != "sentencepiece":
            assert out.columns == docs.columns
        if name == "quality_classifier":
            model = quality_classifier.train(docs, labels)
            assert set(after) == {k for k, r in before.items() if model.score(r.text) >= 0.5}
        elif name == "simhash_near_dedup":
            fps = [(k, simhash.fingerprint(before[k].text, 4)) for k in sorted(before)]
            from llm.test_simhash import brute_components

            assert set(after) == {c for c in brute_components(fps, 4)}
        elif name == "template_decontamination":
            leaks = {r.doc_id for r in decontaminate.leaks(docs, spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")).collect()}
            assert set(after) == set(before) - leaks
            assert not [r for r in after.values() for i in items if i.text in r.text]
        elif name == "pii":
            model = pii.train(docs)
            for k, r in before.items():
                assert after[k].text == pii.masked(r.text, pii.find_all(model, [r.text])[0])
                assert pii.base_spans(after[k].text) == [] and after[k].n_chars == len(after[k].text)
        else:
            assert {k: r.ids for k, r in after.items()} == {k: own.encode(r.text) for k, r in before.items()}
        docs = out


@pytest.mark.parametrize("rows", ["edge", "empty"])
def test_stages_on_edge_rows(spark, request, rows):
    docs = request.getfixturevalue(rows)
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF_SMALL)
        assert out.columns == docs.columns and out.count() <= docs.count()
    assert p.tokens(spark, docs, SF_SMALL).count() == docs.count()

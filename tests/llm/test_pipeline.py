"""The pipeline against a brute-force version built from the operators' kernels, stage by stage."""

import re

import corpus_pipeline
from orbisight.llm import decontamination, secret_scans, source_mixing, toxicity

from .test_near_copies import brute_groups
from .test_operators import brute_decontamination, brute_targets, clashing

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rejected = {r.doc_id for r in toxicity.score(docs, model).where("score >= 0.5").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        ids, texts = [r.doc_id for r in before], [r.text for r in before]
        if k < 4:
            assert docs.columns == columns
        if name == "toxicity":
            assert {r.doc_id for r in after} == set(ids) - rejected
        elif name == "near_dedup":
            order = sorted(range(len(ids)), key=lambda j: ids[j])
            label = brute_groups([texts[j] for j in order])
            assert sorted(r.doc_id for r in after) == sorted({ids[order[j]] for j in label})
        elif name == "decontamination":
            assert {r.doc_id for r in after} == {j for j, x in zip(ids, brute_decontamination(texts, items), strict=True) if not x[1]}
        elif name == "secret_scans":
            made = secret_scans.trained()
            assert {r.doc_id: (r.text, r.n_chars) for r in after} == {j: (x := secret_scans.redact(t, made), len(x)) for j, t in zip(ids, texts, strict=True)}
        else:
            sizes: dict = {}
            for r in before:
                sizes[r.source] = sizes.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
            taken: dict = {}
            for r in after:
                taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
            longest = max(len(r.text.split()) for r in before)
            assert all(abs(taken.get(s, 0) - t) <= longest for s, t in brute_targets(sizes, (5, 2, 1), 3.0).items())
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, after))


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() == 0


def test_clashing_columns_go_through(spark):
    docs = clashing(spark, ["a b c d e f g h"] * 3 + [None, "", "token = abcdef12 and words"])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns or name == "source_mixing" and out.columns == [*docs.columns, "repetition_1"]
        docs = out
    assert {r[0] for r in docs.collect()} <= {0, 3, 5}


def test_kernels_are_shared():
    assert decontamination.alnum_words("A-b É") == [b"a", b"b", "É".encode()] and source_mixing.BROADCAST_SOURCES > 0

"""The pipeline, stage by stage, on a small table."""

from __future__ import annotations

from array import array

import corpus_pipeline
import public_tokenizers
import sentencepiece

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    documents = docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    outs = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        outs.append(docs)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == documents.columns and docs.dtypes == documents.dtypes
    good, lines, groups, mixed, coded = ({r.doc_id: r for r in o.collect()} for o in outs)
    kept = [i for i, r in labels.items() if r.quality == 1]
    assert sum(i in good for i in kept) >= 0.97 * len(kept)
    assert set(lines) == set(good) and set(groups) <= set(lines) and set(mixed) <= set(groups) and set(coded) == set(mixed)
    assert all(r.n_chars == len(r.text) for r in lines.values())
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for i, r in coded.items():
        assert bytes(r.ids) == array("I", lib.encode(mixed[i].text, add_bos=True, add_eos=True)).tobytes() and r.n_tokens == len(r.ids) // 4


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_on_odd_rows(spark, tmp_path):
    """Null and repeated ids, null, empty and very long texts, ties, clashing and dotted names, and no rows, through every stage."""
    from tests.llm.test_operators import CLASHING, clashing, odd_docs

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = labels.where("quality = 1").join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").select("text").limit(2).collect()
    docs = odd_docs(spark)
    more = docs.limit(1).drop("text").crossJoin(spark.createDataFrame([(r.text,) for r in good] * 2 + [("word " * 60_000,)], "text string")).select(docs.columns)
    docs = clashing(docs.unionByName(more))
    for part, name in ((docs, "odd"), (docs.limit(0), "none")):
        part.write.parquet(str(tmp_path / name))
        part = spark.read.parquet(str(tmp_path / name))
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, part, SF)
            out.write.parquet(str(tmp_path / f"{name}-{k}"))
            back = spark.read.parquet(str(tmp_path / f"{name}-{k}"))
            if k < len(corpus_pipeline.STAGES) - 1:
                assert back.columns == part.columns and back.dtypes == part.dtypes
                assert all(r[c] == c for r in back.collect() for c in CLASHING if c not in ("n", "key"))
            assert (back.count() > 0) == (name == "odd")
            assert k != 1 or all(r.n_chars == (None if r.text is None else len(r.text)) for r in back.collect())

"""The stages one after another, each against its own rule."""

import corpus_pipeline
from tessera.llm import decontaminate, lines, quality, simhash

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "SimHash near-dedup", "benchmark decontamination", "byte-level BPE"]
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, FOLDER).cache()
        if k < 4:
            assert out.columns == columns
        if k == 0:
            assert ids(out) == ids(quality.judge(kept).where("kept"))
        elif k == 1:
            gone = {(r.doc, r.line) for r in lines.out_lines(kept).collect()}
            texts = {r.doc_id: r.text for r in kept.collect()}
            assert all(r.text == "\n".join(x for i, x in enumerate(texts[r.doc_id].split("\n")) if (r.doc_id, i) not in gone) and r.n_chars == len(r.text) for r in out.collect())
        elif k == 2:
            assert ids(out) == sorted({r.component_id for r in simhash.groups(kept).collect()})
        elif k == 3:
            bad = {r.doc_id for r in decontaminate.contaminated(kept, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()}
            assert set(ids(out)) == set(ids(kept)) - bad
        else:
            assert out.where("n_tokens <> size(ids)").count() == 0
            assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted((r.doc_id, r.text) for r in kept.collect())
        kept = out
    assert corpus_pipeline.run(spark, FOLDER).count() == kept.count()

"""The corpus pipeline's stages feed each other, and run() applies them all."""

import corpus_pipeline


def test_stages(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet").limit(60)
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, folder), name)
        sizes.append(docs.count())
        if name != "packing":
            assert docs.columns == names
    assert all(sizes) and sizes[0] <= 60
    assert corpus_pipeline.run(spark, folder).count() == sizes[-1]

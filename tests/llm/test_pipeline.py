import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import bpe, line_dedup, mixing, quality, simhash
from tessella.llm.queries import fitted_quality, word_vocabulary

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    r = random.Random(2)
    words = ["".join(r.choices("abcdeinorst", k=r.randrange(2, 9))) for _ in range(400)]
    rows, labels = [], []
    for i in range(160):
        t = [" ".join(r.choices(words, k=12)) for _ in range(r.randrange(1, 9))]
        bad = i % 6 == 5
        rows.append((i, "\n".join(x.replace(" ", " | ") if bad else x for x in t), "en", f"s{i % 4}", 0))
        labels.append((i, int(not bad), 0))
    rows += [(200 + i, rows[i][1], "en", "s0", 0) for i in range(0, 20)] + [(300, None, None, None, None), (None, "no id " + rows[1][1], "en", "s1", 0), (301, "", "en", "s2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_one_by_one(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup", "mixing", "bpe encoding"]
    model = fitted_quality(spark, docs, folder)
    kept = corpus_pipeline.quality_stage(spark, docs, folder).cache()
    x = {(r.doc_id, r.text): float(model.score(quality.features_of(__import__("pyarrow").array([r.text], "string")))[0]) >= 0.3 for r in docs.collect()}
    assert sorted(map(str, [(r.doc_id, r.text) for r in kept.collect()])) == sorted(str(k) for k, good in x.items() if good)
    cut = corpus_pipeline.line_stage(spark, kept, folder).cache()
    want = line_dedup.dedup(kept).select("doc_id", "text")
    assert cut.columns == list(corpus_pipeline.COLUMNS) and sorted(map(str, cut.select("doc_id", "text").collect())) == sorted(map(str, want.collect()))
    one = corpus_pipeline.simhash_stage(spark, cut, folder).cache()
    classes = simhash.classes(cut, k=5, most=3).collect()
    assert sorted(str(r.doc_id) for r in one.collect()) == sorted({str(r.id) for r in classes if r.id == r.component})
    mixed = corpus_pipeline.mixing_stage(spark, one, folder).cache()
    copies = {r.doc_id: r.n for r in mixing.mix(one).select("doc_id", F.col("mix_.copies").alias("n")).collect()}
    assert mixed.groupBy("doc_id").count().collect() and all(copies[r.doc_id] == r["count"] for r in mixed.groupBy("doc_id").count().collect())
    coded = corpus_pipeline.encoding_stage(spark, mixed, folder).collect()
    coder = bpe.Vocabulary.load(word_vocabulary())
    assert len(coded) == mixed.count() and all(r.n_tokens == len(r.ids) for r in coded) and coder.tokens


def test_run_and_empty(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 50
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_rows_of_one_id_with_other_texts_stay(spark):
    r = random.Random(4)
    a, b, c, d = (" ".join(r.choices([f"v{i}" for i in range(500)], k=40)) for _ in range(4))
    rows = [(None, a), (None, b), (None, b), (1, c), (1, d), (2, d), (3, a), (None, None), (4, "")]
    got = corpus_pipeline.simhash_stage(spark, spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA), "").collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("3", a), ("None", b), ("1", c), ("1", d), ("4", "")])

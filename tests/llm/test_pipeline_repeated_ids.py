import random

import corpus_pipeline


def test_of_rows_with_one_id_the_compared_one_stays(spark):
    rng = random.Random(11)
    prose = lambda: " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(120))
    # the later texts come first in the table
    rows = [(d, f"{mark} {prose()}", "en", "s", 3) for mark in "cba" for d in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1)
    got = corpus_pipeline.one_of_each_group(spark, docs, "").collect()
    assert {r.doc_id: r.text for r in got} == {d: t for d, t, *_ in rows if t.startswith("a ")}
    assert len(got) == 40

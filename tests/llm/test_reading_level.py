from rosterlake.llm.reading_level import reading_levels, sentences, train

EASY = "The cat sat on the mat. We had fun. I like the dog. "
HARD = "The institutional determination presupposes comprehensive reconsideration. Methodological inadequacy necessitates transparency. "


def test_held_out(small, spark):
    rows = spark.read.parquet(f"{small}/reading_samples.parquet").collect()
    wrong = 0
    for r in rows:
        m = train([(x["reading_level"], x["text"]) for x in rows if x["sample_id"] != r["sample_id"]])
        wrong += m.level(r["text"]) != r["reading_level"]
    assert wrong <= 1


def test_sentences():
    assert len(sentences("- One two\n- three\n\nfour. five")) == 4
    assert sentences(None) == [] and sentences("12 34 | 56") == []


def test_levels(spark):
    samples = spark.createDataFrame([(1, 1, EASY * 5), (2, 4, HARD * 5), (3, None, "x"), (4, 1, None)], "sample_id long, reading_level int, text string")
    rows = [
        (1, EASY * 8, 0), (2, HARD * 9, 0), (3, (EASY * 8).upper(), 0), (4, "short text", 0), (5, None, 0), (6, "", 0), (7, "qqq " * 80, 0), (8, HARD * 3000, 0),
        (2, HARD * 9, 0), (9, "\n".join(["1.5 | 2.7 | 33"] * 40) + "\n" + HARD * 9, 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, reading_level int")
    got = [(r["doc_id"], r["reading_level"]) for r in reading_levels(docs, samples).collect()]
    assert sorted(got) == [(1, 1), (2, 4), (2, 4), (3, 1), (7, 1), (8, 4), (9, 4)]
    assert reading_levels(docs.limit(0), samples).count() == 0
    assert reading_levels(docs, samples.limit(0)).count() == 0

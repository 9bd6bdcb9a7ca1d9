from pyspark.sql import functions as F

from eventcast.functions import text as X
from eventcast.plans import features

TEXTS = [None, "Unknown", "123 !?", "the and of", "Bomb bomb BOMB attack", "Café\tnaïve\n olé",
         "alpha bravo charlie delta echoes foxtrot golfer", ""]


def table(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, summary string")


def test_clean_text(spark):
    found = [r["c"] for r in table(spark).select("doc_id", X.clean_text(F.col("summary")).alias("c")).orderBy("doc_id").collect()]
    assert found == ["", "", "", "the and of", "bomb bomb bomb attack", "caf nave ol",
                     "alpha bravo charlie delta echoes foxtrot golfer", ""]


def test_counts_and_keywords(spark):
    rows = features.process_text(table(spark)).orderBy("doc_id").collect()
    assert [r["text_word_count"] for r in rows] == [0, 0, 0, 3, 4, 3, 7, 0]
    assert [r["has_text"] for r in rows] == [0, 0, 0, 1, 1, 1, 1, 0]
    assert [r["keywords_text"] for r in rows] == ["", "", "", "", "bomb, attack", "nave",
                                                  "alpha, bravo, charlie, delta, echoes", ""]
    assert not {"text_cleaned", "keywords"} & set(rows[0].asDict())


def test_long_text_is_kept_whole(spark):
    long_text = " ".join(f"{'z' * (i % 5 + 1)}" for i in range(50_000)) + " lastword"
    rows = spark.createDataFrame([(1, long_text)], "doc_id int, summary string")
    assert features.text_statistics(rows).first()["text_word_count"] == 50_001
    assert "lastword" in features.process_text(rows).first()["keywords_text"]


def test_vocabulary(spark):
    found = table(spark).transform(features.text_statistics).transform(features.summary_keywords)
    assert features.vocabulary_size(found).first()[0] == 8

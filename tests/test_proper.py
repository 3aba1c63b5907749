"""Proper nouns, once per title."""

from pyspark.sql import functions as F

from faintline.functions import scalar as S


def test_proper_nouns_of_a_title(spark):
    rows = spark.createDataFrame([("Why is (Docker) so hard for B2B and ai --- 7up",), ("",), (None,)], "title string")
    got = [r.n for r in rows.select(S.proper_nouns(F.col("title")).alias("n")).collect()]
    assert got == [["why", "docker", "b2b", "", "7up"], [], None]
    asked = rows.limit(1).select(*[S.is_proper_noun(F.lit(w), F.col("title")).alias(w) for w in ("docker", "hard", "ai", "b2b")]).first()
    assert list(asked) == [True, False, False, True]

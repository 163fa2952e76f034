from types import SimpleNamespace

from blockloom.llm import langid

NET = SimpleNamespace(langs=["de", "en"])


def least(spark, *groups):
    """groups: (rows, lang, lang_pred, score)."""
    rows = [row for n, *row in groups for _ in range(n)]
    return langid.least_score(spark.createDataFrame(rows, "lang string, lang_pred string, score double"), NET)


def test_all_labelled_rows_fix_the_threshold(spark):
    """not those of a sample of each language, and none of unlabelled or unlearned ones."""
    many, few = (10_000, "en", "en", 0.5504), (100, "de", "en", 0.7)
    other = [(300, None, "en", 0.1), (300, "xx", "de", 0.1), (300, "en", "und", 0.0)]
    assert least(spark, many, few, (40, "en", "de", 0.2), *other) == 0.55
    assert least(spark, many, few, (60, "en", "de", 0.2), *other) == 0.2
    assert least(spark, (10, "en", "en", 1.0)) == langid.LEAST_SCORE
    assert least(spark, *other) == 0.0
    assert least(spark, (1, "en", "en", 0.3), (199, "en", "en", 0.5)) == 0.3  # one of 200 is the share itself

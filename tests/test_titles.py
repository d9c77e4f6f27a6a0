"""Keys of titles: labels, brackets, spelling."""

from __future__ import annotations

from pyspark.sql import functions as F

from poolwright.functions import text as t

CASES = {
    "Correction: Sleep in rats": "sleep in rats",
    "Correction of gait asymmetry": "correction of gait asymmetry",
    "Erratum to: Author Manuscript: Sleep": "sleep",
    "[Article in German] Schlaf": "schlaf",
    "[Effect of levodopa on gait]": "effect of levodopa on gait",
    "[[Corrigendum - [note] Sleep]]": "sleep",
    "Retracted article. Sleep": "sleep",
    "Reply to Smith": "smith",
    "Randomised behavioural analysis, analysed": "randomized behavioral analysis analyzed",
    "Four hours of the tour": "four hours of the tour",
    "Colour and favours; exercise is wise": "color and favors exercize is wise",
    "Organisations": "organizations",
    "Müller’s ﬁeld": "mullers field",
    "": "",
    " ": "",
    "[]": "",
}


def test_title_keys(spark):
    rows = spark.createDataFrame([*((x,) for x in CASES), (None,)], "title string")
    found = {r["title"]: r["key"] for r in rows.select("title", t.normalise_title(F.col("title")).alias("key")).collect()}
    assert found == {**CASES, None: None}

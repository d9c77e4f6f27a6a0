"""Looser candidates of several kinds on one stretch of text."""

from __future__ import annotations

import pytest

from poolwright.llm import pii

SCHEMA = "doc_id long, text string"
KEY = "aB3dE6gH9" * 40
CASES = [
    ("SSN: 123-45-6789 of record", "national_id:5:16", "SSN: <NATIONAL_ID> of record"),
    ("ssn=123-45-6789", "national_id:4:15", "ssn=<NATIONAL_ID>"),
    ("IBAN: GB82WEST12345698765432", "iban:6:28", "IBAN: <IBAN>"),
    (f"api_key={KEY} end", f"secret:0:{8 + len(KEY)}", "<SECRET> end"),
    ("note: password=hunter2abc9Zq77", "secret:6:30", "note: <SECRET>"),
    ("Reading: wonderful", "", "Reading: wonderful"),
]
#: votes as a corpus gives them
COUNTS = {
    ("secret", "00+0+"): 150, ("secret", "0++0+"): 150, ("secret", "0--00"): 300, ("national_id", "0+0++"): 40, ("national_id", "0-0--"): 40,
    ("iban", "0++++"): 40, ("iban", "0---+"): 40, ("card", "0---0"): 160, ("email", "+0+0+"): 400,
}


def test_a_refused_candidate_hides_no_other(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], SCHEMA)
    found = {r["doc_id"]: (r["spans"], r["redacted"]) for r in pii.find_spans(docs, pii.fit(COUNTS)).collect()}
    assert [found[i] for i in range(len(CASES))] == [(s, r) for _, s, r in CASES]


def test_overlapping_accepted_spans_lose_nothing():
    text = "x" * 60
    base = [("card", 10, 26)]
    accepted = [("phone", 12, 20), ("iban", 20, 40), ("national_id", 35, 50), ("card", 36, 45), ("phone", 20, 40)]
    assert pii.resolved(text, accepted, base) == [("phone", 20, 40), ("national_id", 35, 50)]


@pytest.mark.parametrize("text", ["key=" + "a" * 300_000, "key=" * 75_000, "a: " * 100_000, "ab:" * 100_000, "a@b.co " * 40_000])
def test_long_texts_stay_linear(text):
    pii.resolved(text, [(k, a, b) for k, a, b, strict, _ in pii.candidates(text) if not strict], pii.base_spans(text))

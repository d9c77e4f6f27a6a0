"""The pipeline's stages, each on its own input."""

from __future__ import annotations

import pytest

import corpus_pipeline as cp
from poolwright.llm import lang_id, pii
from poolwright.llm.common import read_table, written

SF = "/root/testdata/sf0.001"
MORE = [
    (10_001, "Reach me at jo.doe@mail.example.com or +1 (743) 555-3824, from 10.0.0.1 with 4111 1111 1111 1111 and then some plain words", "en", "s9", 10),
    (10_002, None, "en", "s9", None), (10_003, "", None, None, 0), (10_004, "12345 ...", "en", "s9", 9),
    (None, "the and of the thing and the other of it was the one and the of", None, None, 63),
]


@pytest.fixture(scope="module")
def outputs(spark):
    docs = read_table(spark, SF, "documents")
    docs = docs.unionByName(spark.createDataFrame(MORE, docs.schema))
    found = [docs]
    for _, stage in cp.STAGES:
        found.append(written(stage(spark, found[-1], SF), "stage").cache())
    return found


def test_columns(outputs):
    for df in outputs[1:-1]:
        assert tuple(df.columns) == cp.COLUMNS
    assert [n for n, _ in cp.STAGES] == ["language ID", "n-gram Jaccard join", "PII", "mixing sources to target weights", "best-fit packing"]


def test_language_rejects_only_what_has_none(outputs):
    before, after = ({(r["doc_id"], r["text"]) for r in df.collect()} for df in outputs[:2])
    gone = before - after
    assert {(10_002, None), (10_003, ""), (10_004, "12345 ...")} <= gone
    assert all(len(lang_id.ngrams(t)) < 40 for _, t in gone)


def test_one_document_of_each_group(outputs):
    def sets(rows):
        out = {}
        for r in rows:
            w = r["text"].encode().lower().split()
            out[r["doc_id"]] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)])
        return out

    before = sets(r for r in outputs[1].collect() if r["doc_id"] is not None)
    parent = {d: d for d in before}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(before)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = before[a], before[b]
            if 100 * len(x & y) >= 80 * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    kept = sorted(r["doc_id"] for r in outputs[2].collect() if r["doc_id"] is not None)
    assert kept == [d for d in ids if root(d) == d]
    assert outputs[2].where("doc_id is null").count() == 1


def test_personal_data_is_gone(outputs):
    before = {r["doc_id"]: r["text"] for r in outputs[2].collect()}
    for r in outputs[3].collect():
        assert not [s for s in pii.base_spans(r["text"]) if s[0] in ("email", "phone")]
        assert r["n_chars"] == len(r["text"])
        if not pii.candidates(before[r["doc_id"]]):
            assert r["text"] == before[r["doc_id"]]
    assert outputs[3].count() == outputs[2].count()


def test_mixture_meets_its_targets(outputs):
    words = lambda t: len(t.encode().split())
    before, size = {}, {}
    for r in outputs[3].collect():
        before.setdefault(r["source"], 0)
        before[r["source"]] += words(r["text"])
        size[r["doc_id"]] = words(r["text"])
    after, taken = {}, {}
    for r in outputs[4].collect():
        after[r["source"]] = after.get(r["source"], 0) + words(r["text"])
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + words(r["text"])
    from poolwright.llm.mixing import fill_targets

    order = sorted(before, key=lambda s: (s is None, s or ""))
    targets = fill_targets([before[s] for s in order], [(5.0, 2.0, 1.0)[i % 3] for i in range(len(order))], 1.5 * sum(before.values()), 2)
    for s, t in zip(order, targets, strict=True):
        assert abs(after.get(s, 0) - t) <= 64
    assert all(taken[d] <= 2 * size[d] for d in taken)


def test_sequences(outputs):
    bins = {}
    for r in outputs[5].collect():
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(n for m in bins.values() for _, n in m)
    assert len(bins) <= 1.03 * -(-total // 1024) + 1


def test_run(spark):
    assert cp.run(spark, SF).count() > 0

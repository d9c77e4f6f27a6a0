"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing extra columns."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from poolwright.llm import ctph, html_text, jaccard_join, lang_id, mixing, packing, pii, quality_lines, substring_dedup, token_files

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, node int, seeds string, redacted int, windows int, part string, score string"


def _rows():
    rng = random.Random(1)
    say = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"]) + str(rng.randrange(40)) for _ in range(n))
    base = say(120)
    texts = [base, base, base + " tail", say(3), "", None, " \n\t ", "a", "x" * 60_000, say(4_000), "línea única " * 300, say(40) + "\n" + base, base.upper(), "日本 語 " * 30, "a  b\n \n c", "an end <|endoftext|> and <|startoftext|> a start"]
    rows = [(i, t, "en" if i % 3 else None, None if i % 4 == 0 else f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [(0, base, "en", None), (3, say(90), "de", "s1"), (None, base, None, None), (None, None, None, None), (10**12, say(50), "fr", "s2")]
    return [(*r, None if r[1] is None else len(r[1]), "x", 1, "y", 2, 3, "p", "q") for r in rows]


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _sorted(found):
    return sorted((tuple(r) for r in found), key=str)


def test_empty_tables(spark, none):
    assert lang_id.identify(none).count() == 0
    assert ctph.fingerprints(none).count() == 0
    assert pii.find_spans(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert jaccard_join.jaccard_components(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert packing.packed_documents(none, BYTES).count() == 0
    assert quality_lines.line_quality(none).count() == 0
    assert token_files.token_file_index(none, WORDS, 1).count() == 0


def test_language(docs, rows):
    found = lang_id.identify(docs).collect()
    assert len(found) == len(rows)
    assert {r["lang_pred"] for r in found if r["doc_id"] in (4, 5, 6)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in found)


def test_fingerprints_and_edited_texts(docs, rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = []
    for i, r in enumerate(order):
        own, after = r[1] or "", order[(i + 1) % len(order)][1] or ""
        changed = ctph.edited(own, after)
        want.append((r[0], len(own), hashlib.sha256(changed.encode()).hexdigest(), ctph.fingerprint(own), ctph.fingerprint(changed)))
    assert _sorted(r[:5] for r in ctph.fingerprints(docs).collect()) == _sorted(want)


def test_equal_texts_equal_fingerprints():
    assert ctph.fingerprint(None) == ctph.fingerprint("") == "1::"
    assert ctph.likeness("1::", "1::") == 1.0
    text = " ".join(f"w{i % 97}x{i}" for i in range(900))
    assert ctph.likeness(ctph.fingerprint(text), ctph.fingerprint(text[:3000] + "!" + text[3000:])) > 0.7
    assert ctph.likeness(ctph.fingerprint(text), ctph.fingerprint("".join(reversed(text)))) < 0.3


def test_personal_data_keeps_columns(docs, rows):
    found = pii.find_spans(docs)
    assert found.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert found.count() == len(rows)
    assert found.where("text is null and redacted is not null").count() == 0


def test_substring_dedup(docs, rows):
    window, first = 13, {}
    words = [(r[0] if r[0] is not None else substring_dedup.NO_ID, r[0], (r[1] or "").encode().split()) for r in rows]
    for d, _, w in words:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(d, first.get(key, d))
    want = []
    for d, doc_id, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((doc_id, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    assert _sorted(r[:4] for r in substring_dedup.remove_repeats(docs).collect()) == _sorted(want)


def test_pages(spark):
    pages = [
        (1, "u", "<html><body><nav><a href=x>menu</a></nav><article><h1>T &amp; U</h1><p>one\n two<br>three</p><aside>no</aside><p>four</p></article><footer>no</footer></body></html>"),
        (1, None, None), (None, "u", ""), (3, "u", "<p>unclosed <b>bold"), (4, "u", "<script>var a = '<p>no</p>';</script><p>yes</p>"), (5, "u", "<p>" + "word " * 50_000 + "</p>"),
    ]
    found = html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    texts = [r["text"] for r in found]
    assert texts[0] == "T & U\none two three\nfour"
    assert texts[1:5] == ["", "", "unclosed bold", "yes"] and found[5]["n_chars"] == 249_999
    assert all(r["n_chars"] == len(r["text"]) for r in found)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div class='page with-sidebar'><article><h1>Head</h1><p>some body text that is here</p></article></div>", "Head\nsome body text that is here"),
        ("<article><p><a href=x>a paragraph that is mostly one long link to read</a> and more</p></article>", "a paragraph that is mostly one long link to read and more"),
        ("<article><div class='article-header'><h1>Headline of it</h1></div><p>the body of this article goes on</p></article>", "Headline of it\nthe body of this article goes on"),
        ("<div class='tags-and-body'><p>the body text of this article goes on and on for a while</p></div>", "the body text of this article goes on and on for a while"),
        ("<div class='post'><p>real text of the post goes on</p><div class='comment-body'><p>a comment by a reader</p></div></div>", "real text of the post goes on"),
        ("<aside><article><p>another story</p></article></aside><main><p>the one story is this</p></main>", "the one story is this"),
    ],
)
def test_whole_articles(page, text):
    assert html_text.main_text(page) == text


def test_features_by_hand():
    page = "<nav><a href=x>one two</a></nav><main><h2>three</h2><p>four five <a href=y>six seven</a></p></main>"
    blocks = html_text.cut_blocks(page)
    assert [(b.text, b.words, b.link_words, b.boiler, b.main) for b in blocks] == [("one two", 2, 2, True, False), ("three", 1, 0, False, True), ("four five six seven", 4, 2, False, True)]
    words = {(k, r[0], r[2], r[4]) for k, r in enumerate(html_text.features(blocks))}
    density = {(k, r[1], r[3], r[5]) for k, r in enumerate(html_text.features(blocks))}
    assert words == {(0, 2, 0, 1), (1, 1, 2, 4), (2, 4, 1, 0)} and density == {(0, 1, 0, 0), (1, 0, 1, 0.5), (2, 0.5, 0, 0)}


def test_tree_looks_at_neighbours():
    def used(tree):
        return {tree[0]} | used(tree[2]) | used(tree[3]) if len(tree) > 1 else set()

    assert used(html_text.trained_tree()) & {2, 3, 4, 5} and used(html_text.trained_tree()) & {0, 1}


def test_tree_on_pages_it_has_not_seen():
    x, y = html_text.labelled_blocks(seed=77, pages=80)
    tree = html_text.trained_tree()
    assert np.mean([(html_text.decide(tree, r) >= 0.5) == bool(v) for r, v in zip(x, y, strict=True)]) > 0.97


def _jaccard(rows, percent=90, n=3):
    sets = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(r[0], least.get(root(i), r[0]))
    return [(r[0], len(sets[i]), least.get(root(i)) if sets[i] else r[0]) for i, r in enumerate(rows)]


def test_jaccard(docs, rows):
    assert _sorted(jaccard_join.jaccard_components(docs).collect()) == _sorted(_jaccard(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_near_the_threshold(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(20):
        base = [f"w{rng.randrange(2000)}" for _ in range(rng.choice([2, 3, 5, 9, 14, 22, 40, 90, 160]))]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randrange(0, max(1, len(w) // 14) + 1)):
                if rng.random() < 0.5 and len(w) > 1:
                    w.pop(rng.randrange(len(w)))
                else:
                    w.insert(rng.randrange(len(w) + 1), f"x{rng.randrange(40)}")
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert _sorted(jaccard_join.jaccard_components(df, chunk_shingles=500).collect()) == _sorted(_jaccard(rows))


@pytest.mark.parametrize("percent", [80, 90])
def test_search_with_long_lists(percent):
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 400, 60).astype(np.uint64)) for _ in range(150)]
    sets += [np.unique(np.concatenate([s[:-2], np.uint64([999])])) for s in sets[:60]]
    plain = [[j for j, s in enumerate(sets) if j != i and 100 * len(np.intersect1d(q, s)) >= percent * len(np.union1d(q, s))] for i, q in enumerate(sets)]
    lists = jaccard_join.InvertedLists(sets, percent)
    for mu in (0.01, 1.0, 100.0):
        for entries in (0, 50, 10**9):
            assert [lists.search(x, mu, entries).tolist() for x in range(len(sets))] == plain
    lists.take(np.arange(0, len(sets), 3))
    assert [lists.search(x).tolist() for x in range(len(sets))] == [[j for j in own if j % 3] for own in plain]
    assert jaccard_join.spanning_links([], percent) == []


@pytest.mark.parametrize(("percent", "n"), [(90, 3), (80, 5)])
def test_linked_sets_share_a_key(percent, n):
    rng = np.random.default_rng(n)
    for size in (1, 2, 4, 7, 10, 15, 30, 70, 200, 700, 3000):
        for _ in range(60):
            base = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            # the two sets are as far apart as a link allows
            more = rng.integers(0, 2**63, size, dtype=np.uint64)[: int(rng.integers(0, size * (100 - percent) // 100 + 1))]
            most = [k for k in range(size + 1) if 100 * (size - k) >= percent * (size + len(more))]
            other = np.unique(np.concatenate([base[most[-1] :], more]))
            (a, need_a), (b, need_b) = (jaccard_join.block_keys(x, percent) for x in (base, other))
            shared, at, to = np.intersect1d(a, b, return_indices=True)
            # in one split at least they share as many keys as either side asks for
            enough = [
                len(own) >= max((need_a[at][own] % jaccard_join.NEED).max(), (need_b[to][own] % jaccard_join.NEED).max())
                for x in np.unique(need_a[at])
                if len(own := np.flatnonzero(need_a[at] == x))
            ]
            assert any(enough)


def test_mixing(docs, rows):
    found = mixing.mix(docs, block=4, shard_docs=2)
    got = found.collect()
    assert len(got) == len(rows)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    by = found.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("n"), F.count("*").alias("shards")).collect()
    for r in by:
        assert r["target"] <= 2 * r["n"] + 1e-9
        assert abs(r["taken"] - r["target"]) <= 4 * (r["shards"] + 1)
    assert sum(r["target"] for r in by) == pytest.approx(1.5 * sum(r["size"] for r in got))
    again = mixing.mix(docs.repartition(3), block=4, shard_docs=2)
    assert _sorted(got) == _sorted(again.collect())


def test_apportionment_by_highest_quotients():
    rng = random.Random(2)
    for _ in range(200):
        votes = [rng.choice([0, 1, 5, rng.random() * 100]) for _ in range(rng.randint(1, 7))]
        seats = rng.randint(0, 40)
        want = [0] * len(votes)
        if sum(votes):
            for _ in range(seats):
                best = max((i for i in range(len(votes)) if votes[i] > 0), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))
                want[best] += 1
        assert mixing.sainte_lague(np.array(votes, float), seats).tolist() == want


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BYTES)
    for capacity, per_node in ((64, 3), (1024, 50_000)):
        pieces = packing.tokenized_pieces(docs, BYTES, 2, capacity).cache()
        placed = pieces.join(packing.pack(pieces.select("uid", "length"), capacity, items_per_node=per_node), "uid").collect()
        assert sorted(r["length"] for r in placed) == sorted(r["length"] for r in pieces.collect())
        total = sum(r["length"] for r in placed)
        assert total == sum(len(tok.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
        bins = {}
        for r in placed:
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for members in bins.values():
            at = 0
            for offset, length in sorted(members):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(bins) <= 1.15 * -(-total // capacity) + 2


def test_line_quality(docs, rows):
    found = quality_lines.line_quality(docs).collect()
    assert len(found) == len(rows)
    got = {r["doc_id"]: r for r in found if r["doc_id"] in (4, 5, 6, 10)}
    assert (got[5]["n_words"], got[5]["word_chars"], got[5]["n_dup_lines"], got[5]["base_failed"], got[5]["kept"]) == (0, 0, 0, True, False)
    assert got[10]["n_repeat_words"] == 600 and got[10]["base_failed"]


def test_token_files(docs, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, want = 0, []
    import zlib

    for r in order:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids + [1]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert _sorted(token_files.token_file_index(docs, WORDS, 1, segment_ids=500).collect()) == _sorted(want)

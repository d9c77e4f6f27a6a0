from __future__ import annotations

import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from poolwright.llm import pii, simple8b, substring_dedup
from poolwright.llm.common import word_hashes
from poolwright.llm.packing import best_fit
from poolwright.llm.tokens import ChunkTokenizer

NAMES = ("byte_bpe_50k.json", "word_bpe_49k.json")
TOKENIZERS = {n: ChunkTokenizer(public_tokenizers.path(n)) for n in NAMES}
#: the library as it comes
LIBRARY = {n: Tokenizer.from_file(public_tokenizers.path(n)) for n in NAMES}


@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 60_000) | st.integers(0, 1), max_size=300))
@settings(deadline=None)
def test_simple8b_round_trip(values):
    a = np.array(values, np.uint64)
    assert simple8b.decode(*simple8b.encode(a), len(a)).tolist() == values


@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 4097, 20_000])
def test_simple8b_blocks(n):
    a = np.random.default_rng(n).integers(0, 49_408, n).astype(np.uint64)
    words, offsets, raw = simple8b.encode(a)
    assert (simple8b.decode(words, offsets, raw, n) == a).all()
    assert len(offsets) == -(-n // simple8b.BLOCK) + 1 and not len(raw)
    for k in range(len(offsets) - 1):  # a block decodes on its own
        part = words[int(offsets[k]) : int(offsets[k + 1])]
        own = a[k * simple8b.BLOCK : (k + 1) * simple8b.BLOCK]
        assert (simple8b.decode(part, np.array([0, len(part)], np.uint64), np.empty(0, np.uint64), len(own)) == own).all()


ODD = st.lists(
    st.text(alphabet="ab Z.,'’\n\t\x0b\x1c\x85\xa0 éÀß½²İΣ日*$|9-_\x00\x01\x02", max_size=12)
    | st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", " ", "the", " don't", "\n"])
    | st.text(max_size=8),
    max_size=8,
).map("".join)


@pytest.mark.parametrize("name", NAMES)
@given(texts=st.lists(st.none() | ODD, max_size=5))
@settings(deadline=None, max_examples=400)
def test_ids_are_the_librarys(name, texts):
    ids, counts = TOKENIZERS[name].encode_all(texts, end_id=9)
    want = [[*LIBRARY[name].encode(t or "", add_special_tokens=False).ids, 9] for t in texts]
    assert counts.tolist() == list(map(len, want))
    assert ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("name", NAMES)
def test_ids_of_documents(name):
    texts = [t for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    ids, counts = TOKENIZERS[name].encode_all(texts)
    want = [LIBRARY[name].encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("name", NAMES)
def test_a_full_cache_changes_nothing(name, monkeypatch):
    monkeypatch.setattr("poolwright.llm.tokens.CHUNK_ENTRIES", 40)
    monkeypatch.setattr("poolwright.llm.tokens.RENEW_AFTER", 300)
    tok = ChunkTokenizer(public_tokenizers.path(name))
    for k in range(30):
        text = " ".join(f"w{k}x{i % 37}, and" for i in range(60))
        assert tok.encode(text) == LIBRARY[name].encode(text, add_special_tokens=False).ids
    assert len(tok.chunks) <= 41


PIECES = st.lists(
    st.sampled_from(["1", "23", ".", "@", "a", "b.c", " ", "-", "+", "(", "255", "٣", "@x.y", "4111111111111111", "é", "%", "..", "+1 (743) 555-3824", "1.2.3.4"]), max_size=18
)


@given(PIECES)
@settings(deadline=None, max_examples=1500)
def test_base_spans_are_the_contracts(parts):
    text = "".join(parts)
    digits = lambda s: re.sub("[^0-9]", "", s)
    want = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    want += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    want += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    want += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]
    assert pii.base_spans(text) == want


def test_long_runs_stay_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a.b" * 60_000 + "@", "token = " + "aB3" * 60_000, "a_" * 100_000, "+1" * 100_000, "@a" * 100_000, "a@" * 100_000):
        pii.candidates(text)


def test_reliabilities_tell_good_labelers():
    counts = {("phone", "+++0+"): 900, ("phone", "0--0-"): 700, ("phone", "+++--"): 40, ("card", "0-+0+"): 30, ("secret", "0++0+"): 200, ("secret", "0--0-"): 300}
    model = pii.fit(counts)
    assert model.reliability["checksum"][0] > 0.9 and model.reliability["checksum"][1] < 0.1
    assert model.accepts("secret", "0++0+") and not model.accepts("secret", "0--0-")
    assert pii.fit({}).accepts("phone", "00000") is False


def test_redaction():
    text = "mail a@b.co now, card 4111111111111111."
    assert pii.redacted(text, pii.base_spans(text)) == "mail <EMAIL> now, card <CARD>."
    assert pii.redacted(None, []) is None


@given(st.lists(st.integers(1, 40), max_size=60))
def test_best_fit_is_a_packing(lengths):
    bins = best_fit(lengths, 40)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 40 for b in bins)
    assert sum(2 * sum(lengths[i] for i in b) <= 40 for b in bins) <= 1


def test_equal_windows_have_equal_seeds():
    rng = np.random.default_rng(4)
    words = [b"w%d" % x for x in rng.integers(0, 50, 400)]
    shared = words[100:130]
    a, b = words, [b"other"] * 7 + shared + [b"more"] * 9
    ga, ia = substring_dedup.seed_of_windows(word_hashes(a), 13)
    gb, ib = substring_dedup.seed_of_windows(word_hashes(b), 13)
    for k in range(30 - 13 + 1):
        assert ga[ia[100 + k]] == gb[ib[7 + k]]
    assert len(ia) == 400 - 12

"""Exact ids of a public tokenizer, made faster by a cache of chunks.

A pre-token of either vocabulary never reaches across a single space that stands between two
characters other than white space. A text is therefore cut before each such space; every distinct
chunk is encoded once and its ids are kept as little-endian unsigned 32-bit bytes, so that the ids
of a text are one join of byte strings. The chunks that a batch of texts has and the cache has not
go to the library together, as one string: ids that begin with a space, or that end a word, show where
each one's ids are. With word ends, a pre-token has the same ids wherever it stands: such chunks are
cut into pre-tokens, of which only those that the cache lacks go there, past the steps of the library
that have been done by then; and texts are cut before line ends and most signs as well. Chunks of other than ASCII and Latin-1 characters go there one by one, and
a text with the string of a special token goes there whole, as the library finds those before it
looks at white space. The tests hold this against the library on whole texts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries that the cache holds; this bounds memory, not results.
CHUNK_ENTRIES = 400_000
#: Lookups after which the share of misses decides whether a full cache starts anew.
RENEW_AFTER = 2_000_000
#: Rows and bytes of a batch of texts.
BATCH_ROWS, BATCH_BYTES = 3_000, 8 << 20
#: Longer pieces are encoded without being kept.
KEPT_CHARS = 48
#: Characters that go to the library in one call.
CALL_CHARS = 4_000

#: White space other than the space and the line end; with it, cuts are looked for one by one.
_ODD_SPACE = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0  -     　]")
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Characters whose classes are the same in Python's patterns and the library's, and that neither a
#: normaliser nor a neighbouring chunk changes.
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_SAFE = re.compile(rf"[!-~\n{_LETTER}]+")
#: The published pre-token pattern of the vocabulary with word ends, over those characters.
_WORD_LEVEL = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\s{_LETTER}0-9]+")
#: Chunks that are one pre-token of it, and signs before which a letter ends one.
_ONE = re.compile(rf"[{_LETTER}]+|[0-9]|[!-&(-/:-@\[-`{{-~]+")
_WORD_END = "([a-z])([.,!?;:#$%&*)])"
#: What a vocabulary file with word ends must say for that pattern to be its own.
_WORD_SPLIT = {
    "type": "Split",
    "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
    "behavior": "Removed",
    "invert": True,
}
_WORD_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
#: in a text under work: where it is cut, and before its first chunk, which follows no space
_SEP, _FIRST = "\x00", "\x02"

_LOADED: dict[str, ChunkTokenizer] = {}


def _plain(text: str) -> bool:
    """No space stands beside other white space, at the start or at the end."""
    return not ("  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " " or _ODD_SPACE.search(text))


def _gathered(flat: np.ndarray, start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The runs of flat that begin at start and are many long, in a row."""
    kind = np.int32 if max(len(flat), many.sum()) < 1 << 31 else np.int64
    at = np.repeat((start - (np.cumsum(many) - many)).astype(kind), many)
    at += np.arange(len(at), dtype=kind)
    return flat[at]


class ChunkTokenizer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = tuple(t.content for t in added)
        #: special tokens that are looked for in normalised text leave no text to the cache
        self.whole = any(t.normalized for t in added)
        vocabulary = self.tokenizer.get_vocab()
        #: ids that begin with a space, and ids that end a word, of which one vocabulary has none
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
        self.word_ends = np.zeros(len(self.opens), bool)
        self.word_ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        #: whether letter case is lost anyway, so that chunks may differ in it
        self.lowers = self.tokenizer.encode("A", add_special_tokens=False).ids == self.tokenizer.encode("a", add_special_tokens=False).ids
        self.chunks: dict[str, bytes] = {"": b""}
        self.looked_up = self.missed = 0
        #: the library without the steps that lead to pre-tokens; None where these are not the known ones
        self.words_only = None
        with open(path, encoding="utf-8") as file:
            steps = json.load(file)
        split, normal = (steps.get("pre_tokenizer") or {}).get("pretokenizers", []), (steps.get("normalizer") or {}).get("normalizers")
        if self.word_ends.any() and split[:1] == [_WORD_SPLIT] and [x["type"] for x in split[1:]] == ["ByteLevel"] and normal == _WORD_NORMALIZERS:
            self.words_only = Tokenizer.from_file(path)
            self.words_only.normalizer = None
            letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.words_only.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), letters])

    def _library(self, piece: str) -> bytes:
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def _together(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of safe chunks, each after a space, in a row, and how many each has."""
        if self.words_only:
            ids = np.array(self.words_only.encode_batch_fast([" ".join(chunks)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.word_ends[ids]) + 1
            if len(ends) == len(chunks):
                return ids, np.diff(ends, prepend=0)
        elif not self.word_ends.any():
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(chunks)], add_special_tokens=False)[0].ids, "<u4")
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) == len(chunks):
                return ids, np.diff(starts, append=len(ids))
        own = [np.frombuffer(self._library(f" {c}"), "<u4") for c in chunks]  # no vocabulary of these two kinds
        return np.concatenate(own), np.array(list(map(len, own)), np.int64)

    def _in_calls(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As _together, in calls of bounded length."""
        parts, many, at, held = [np.empty(0, "<u4")], [np.empty(0, np.int64)], 0, 0
        for k, chunk in enumerate(chunks):
            held += len(chunk) + 1
            if held >= CALL_CHARS or k + 1 == len(chunks):
                ids, n = self._together(chunks[at : k + 1])
                parts.append(ids)
                many.append(n)
                at, held = k + 1, 0
        return np.concatenate(parts), np.concatenate(many)

    def _keep(self, pieces: list[str], ids: np.ndarray, many: np.ndarray) -> None:
        """Put pieces with their ids, which stand in a row, into the cache while it has room."""
        data, ends = ids.tobytes(), (np.cumsum(many) * 4).tolist()
        room, at = CHUNK_ENTRIES - len(self.chunks), 0
        for piece, end in zip(pieces[: max(0, room)], ends, strict=False):
            if len(piece) <= KEPT_CHARS:
                self.chunks[piece] = data[at:end]
            at = end

    def _by_words(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As _in_calls, through the pre-tokens, of which the cache holds many."""
        found = [_WORD_LEVEL.findall(c.lower()) for c in chunks]
        coded = pa.array(chain.from_iterable(found), pa.large_string()).dictionary_encode()
        words, index = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        known = [self.chunks.get(w) for w in words]
        missing = [k for k, ids in enumerate(known) if ids is None]
        new = [words[k] for k in missing]
        ids, n = self._in_calls(new)
        self._keep(new, ids, n)
        held = [k or b"" for k in known]
        length = np.fromiter(map(len, held), np.int64, len(held)) // 4
        start, total = np.cumsum(length) - length, int(length.sum())
        length[missing], start[missing] = n, total + np.cumsum(n) - n
        ids = _gathered(np.concatenate([np.frombuffer(b"".join(held), "<u4"), ids]), start[index], length[index])
        before = np.concatenate([[0], np.cumsum(length[index])])
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        return ids, np.diff(before[ends], prepend=0)

    def _pieces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct chunks: all of them in some order, where each one's start and how many it has."""
        known = [self.chunks.get(w) for w in words]
        missing = [k for k, ids in enumerate(known) if ids is None]
        self.missed += len(missing)
        one, safe = [], []
        for k in missing:
            w = words[k]
            known[k] = b""
            if self.words_only and _ONE.fullmatch(w):
                one.append(k)
            elif _SAFE.fullmatch(w):
                safe.append(k)
            else:
                known[k] = self._library(w[1:] if w[0] == _FIRST else f" {w}")
                if len(w) <= KEPT_CHARS and len(self.chunks) < CHUNK_ENTRIES:
                    self.chunks[w] = known[k]
        length = np.fromiter(map(len, known), np.int64, len(known)) // 4
        start, total = np.cumsum(length) - length, int(length.sum())
        parts = [np.frombuffer(b"".join(known), "<u4")]
        several = self._by_words if self.words_only else self._in_calls
        for where, encode in ((one, lambda own: self._in_calls([w.lower() for w in own])), (safe, several)):
            own = [words[k] for k in where]
            ids, n = encode(own)
            self._keep(own, ids, n)
            length[where], start[where] = n, total + np.cumsum(n) - n
            parts.append(ids)
            total += len(ids)
        return np.concatenate(parts), start, length

    def _marked(self, text: str | None) -> str | None:
        """The text with its cuts; None if it goes to the library whole."""
        if not text:
            return ""
        if self.whole or _SEP in text or _FIRST in text or any(s in text for s in self.special):
            return None
        if self.lowers and text.isascii() and not any(s in text.lower() for s in self.special):
            text = text.lower()
        if self.words_only:  # any white space ends a pre-token and is gone after that
            return text.replace(" ", _SEP).replace("\n", _SEP)
        return _FIRST + (text.replace(" ", _SEP) if _plain(text) else _CUT.sub(_SEP, text))

    def encode_all(self, texts: Sequence[str | None], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has; end_id, if any, follows each text.

        A null or empty text has no ids of its own.
        """
        if not len(texts):
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        marked = [self._marked(t) for t in texts]
        cut = pa.array([m or "" for m in marked], pa.large_string())
        if self.words_only:
            cut = pc.replace_substring_regex(cut, _WORD_END, f"\\1{_SEP}\\2")
        cut = pc.split_pattern(cut, _SEP)
        coded = cut.values.dictionary_encode()
        words, index = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        first = cut.offsets.to_numpy().astype(np.int64) - cut.offsets[0].as_py()
        self.looked_up += len(index)
        flat, start, length = self._pieces(words)
        more = [np.frombuffer(self._library(texts[k]), "<u4") for k, m in enumerate(marked) if m is None]
        index[first[[k for k, m in enumerate(marked) if m is None]]] = len(words) + np.arange(len(more))
        if end_id is not None:
            index = np.insert(index, first[1:], len(words) + len(more))
            more.append(np.array([end_id], "<u4"))
            first = first + np.arange(len(first))
        added = np.array(list(map(len, more)), np.int64)
        start = np.concatenate([start, len(flat) + np.cumsum(added) - added])
        length = np.concatenate([length, added])
        flat = np.concatenate([flat, *more])
        if self.looked_up > RENEW_AFTER:
            if len(self.chunks) >= CHUNK_ENTRIES and self.missed * 4 > self.looked_up:  # the texts have changed
                self.chunks = {"": b""}
            self.looked_up = self.missed = 0
        n = length[index]
        return _gathered(flat, start[index], n), np.add.reduceat(n, first[:-1])

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0].tolist()


def tokenizer(path: str) -> ChunkTokenizer:
    """One per worker process."""
    if path not in _LOADED:
        _LOADED[path] = ChunkTokenizer(path)
    return _LOADED[path]

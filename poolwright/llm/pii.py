"""Personal data by weak supervision.

Candidates are the strict matches of four kinds (the base, which always stays) and looser ones.
Labelers vote on each candidate: regular expressions, gazetteers and context words say yes, no or
nothing. Over all documents the votes are counted by pattern; expectation-maximisation estimates
from the counts how reliable each labeler is and how likely each pattern is personal data. A
logistic span classifier is trained on those likelihoods, with the votes, the kind and the shape of
the span as features. A looser candidate is kept where it says yes.

Only counts by pattern reach the driver: their number is bounded by votes and shapes, not by the data.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, trimmed

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "national_id", "iban")

# ---- base kinds: linear-time forms of the contract's expressions --------------------------------
# A match of the email expression starts with all local characters before its @, so it is found
# from the @; a run of digits is entered at its start only.
_EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octets(s: str) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in s.split("."))


def _emails(text: str) -> list[tuple[int, int]]:
    out, end = [], 0
    for m in _EMAIL_TAIL.finditer(text):
        at = start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            out.append((start, m.end()))
            end = m.end()
    return out


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    if not text:
        return []
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _octets(m[0])]
        out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


# ---- looser candidates -------------------------------------------------------------------------
_LOOSE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)|@) ?[A-Za-z0-9-]+(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]{2,})+\b"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[ .-]?[0-9]{4}){2,3}(?:[ .-]?[0-9]{1,3})?(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+(])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])"),
    # the value is looked ahead for, as it may be the name of the next one: "note: password=..."
    "secret": re.compile(r"\b[A-Za-z_]{2,}+ ?[=:] ?[\"']?(?=([A-Za-z0-9+/_-]{8,}[\"']?))"),
    "national_id": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
}
#: literals without which a loose pattern cannot match
_NEEDS = {"email": ("@", "at]", "at)"), "secret": ("=", ":"), "national_id": ("-",)}

# fixed values: gazetteers and context words
SECRET_NAMES = frozenset("password passwd pwd secret token apikey api_key access_key auth key credential".split())
TOP_DOMAINS = frozenset("com org net edu gov io de fr es uk eu info biz co us".split())
IBAN_COUNTRIES = frozenset("AT BE CH DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split())
CUES = {
    "email": ("mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "telefon"),
    "secret": ("login", "auth", "password", "token", "key"),
    "national_id": ("ssn", "social", "id"),
    "iban": ("iban", "bank", "konto", "account"),
}
CONTEXT_CHARS = 40
#: probability from which the classifier keeps a looser candidate: a wrong span damages a clean text
ACCEPT = 0.9
_WORD = re.compile(r"[^\W\d_]+")


def _iban(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _vote(yes: bool, no: bool = False) -> str:
    return "+" if yes else "-" if no else "0"


LABELERS = ("strict", "checksum", "gazetteer", "context", "shape")


def votes(text: str, kind: str, start: int, end: int, strict: bool) -> str:
    """One character for each labeler: + yes, - no, 0 nothing."""
    span = text[start:end]
    digits = _digits(span)
    around = {w.lower() for w in _WORD.findall(text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS])}
    cue = any(w.startswith(c) for w in around for c in CUES[kind])
    other = any(w.startswith(c) for k in KINDS if k != kind for w in around for c in CUES[k])
    before, after = text[start - 1 : start], text[end : end + 1]
    loose_edge = bool(before) and before.isalnum() or bool(after) and after.isalnum()
    if kind == "email":
        checksum, gazetteer = "0", _vote(span.rsplit(".", 1)[-1].rstrip(" )]").lower() in TOP_DOMAINS, True)
        shape = _vote(len(span) <= 60 and not loose_edge, len(span) > 100)
    elif kind == "ip":
        parts = [p.lstrip("0") or "0" for p in span.split(".")]
        checksum, gazetteer = _vote(_octets(span), True), _vote(False, parts[0] in ("0", "255"))
        shape = _vote(not loose_edge and before != "." and after != ".", loose_edge)
    elif kind == "card":
        checksum, gazetteer = _vote(luhn(digits), True), _vote(digits[:1] in "3456", digits[:1] in "01")
        shape = _vote(14 <= len(digits) <= 19 and not loose_edge, len(set(digits)) < 3)
    elif kind == "phone":
        checksum, gazetteer = _vote(8 <= len(digits) <= 15, len(digits) < 7), _vote(span.startswith("+"), len(set(digits)) < 3)
        shape = _vote(any(c in span for c in " ()-") and not loose_edge, loose_edge)
    elif kind == "secret":
        name, value = re.split(r" ?[=:] ?", span, maxsplit=1)
        value = value.strip("\"'")
        mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
        checksum, gazetteer = _vote(len(set(value)) >= 8 and mixed, not mixed), _vote(name.lower() in SECRET_NAMES, True)
        shape = _vote(len(value) >= 16 and mixed, len(value) < 8)
    elif kind == "national_id":
        checksum, gazetteer = _vote(not span.startswith(("000", "666", "9")), True), "0"
        shape = _vote(not loose_edge, loose_edge)
    else:
        checksum, gazetteer = _vote(_iban(span), True), _vote(span[:2] in IBAN_COUNTRIES, True)
        shape = _vote(not loose_edge, loose_edge)
    return ("+" if strict else "0") + checksum + gazetteer + _vote(cue, other and not cue) + shape


def _reach(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts in order, and how far the spans up to each reach."""
    spans = sorted(spans)
    return [a for a, _ in spans], list(accumulate((b for _, b in spans), max))


def _inside(reach: tuple[list[int], list[int]], a: int, b: int) -> bool:
    before = bisect_right(reach[0], a)
    return before > 0 and reach[1][before - 1] >= b


def candidates(text: str | None) -> list[tuple[str, int, int, bool, str]]:
    """(kind, start, end, in the base, pattern of votes).

    Loose ones may overlap each other and base spans of other kinds; one that is inside a base span,
    or overlaps a base span of its own kind, is left out.
    """
    if not text:
        return []
    base = base_spans(text)
    out = [(k, a, b, True, votes(text, k, a, b, True)) for k, a, b in base]
    reach = _reach([(a, b) for _, a, b in base])
    digit = _DIGIT.search(text) is not None
    for kind, pattern in _LOOSE.items():
        if kind in ("card", "phone", "national_id", "iban") and not digit or not any(x in text for x in _NEEDS.get(kind, ("",))):
            continue
        own = [(a, b) for k, a, b in base if k == kind]  # disjoint and in order
        for m in pattern.finditer(text):
            a, b = m.start(), max(m.end(), m.end(pattern.groups))
            last = bisect_left(own, (b, 0))
            if _inside(reach, a, b) or last and own[last - 1][1] > a:
                continue
            out.append((kind, a, b, False, votes(text, kind, a, b, False)))
    return out


_SECRET_NAME = re.compile(r"[A-Za-z_]{2,} ?[=:] ?[\"']?")


def resolved(text: str, accepted: list[tuple[str, int, int]], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Accepted looser spans without those inside a base span or another accepted one (of equal ones the first kind stays).

    A secret whose whole value is a span of another kind is that kind. Spans that overlap in part all
    stay: what either covers is personal data.
    """
    others = _reach([(a, b) for k, a, b in [*base, *accepted] if k != "secret"])
    value = lambda a, b: (_SECRET_NAME.match(text, a).end(), b - (text[b - 1] in "\"'"))
    accepted = [(k, a, b) for k, a, b in accepted if k != "secret" or not _inside(others, *value(a, b))]
    rows = [(a, -b, 0, 0, k) for k, a, b in base] + [(a, -b, 1, KINDS.index(k), k) for k, a, b in accepted]
    out, end = [], -1
    for a, b, loose, _, kind in sorted(rows):
        if loose and -b > end:
            out.append((kind, a, -b))
        end = max(end, -b)
    return out


# ---- model -------------------------------------------------------------------------------------
@dataclass(frozen=True)
class SpanModel:
    """Probability of personal data by kind and pattern of votes, and the labelers' reliabilities."""

    probability: dict[tuple[str, str], float]
    reliability: dict[str, tuple[float, float]]
    weights: tuple[float, ...]

    def accepts(self, kind: str, pattern: str) -> bool:
        known = self.probability.get((kind, pattern))
        return bool((known if known is not None else _predict(np.array(self.weights), [(kind, pattern)])[0]) >= ACCEPT)


def _features(rows: list[tuple[str, str]]) -> np.ndarray:
    x = [[1.0, *(float(k == kind) for k in KINDS), *((v == "+") - (v == "-") for v in p)] for kind, p in rows]
    return np.array(x, float).reshape(len(rows), 1 + len(KINDS) + len(LABELERS))


def _predict(w: np.ndarray, rows: list[tuple[str, str]]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_features(rows) @ w, -30, 30)))


def fit(counts: dict[tuple[str, str], int], rounds: int = 60) -> SpanModel:
    """Expectation-maximisation over counts of (kind, votes), then the span classifier."""
    rows = sorted(counts)
    n = np.array([counts[r] for r in rows], float)
    plus = np.array([[v == "+" for v in p] for _, p in rows], float).reshape(len(rows), len(LABELERS))
    minus = np.array([[v == "-" for v in p] for _, p in rows], float).reshape(len(rows), len(LABELERS))
    yes = np.full(len(LABELERS), 0.8)  # P(+ | personal data, voted)
    wrong = np.full(len(LABELERS), 0.2)  # P(+ | not, voted)
    prior = {k: 0.5 for k in KINDS}
    p = np.zeros(len(rows))
    for _ in range(rounds if len(rows) else 0):
        base = np.array([prior[k] for k, _ in rows])
        a = np.log(base) + plus @ np.log(yes) + minus @ np.log(1 - yes)
        b = np.log(1 - base) + plus @ np.log(wrong) + minus @ np.log(1 - wrong)
        p = 1 / (1 + np.exp(np.clip(b - a, -30, 30)))
        # Beta(8, 2) and Beta(2, 8) priors keep labelers better than chance
        pos, neg = n * p, n * (1 - p)
        yes = np.clip((pos @ plus + 8) / (pos @ (plus + minus) + 10), 0.55, 0.99)
        wrong = np.clip((neg @ plus + 2) / (neg @ (plus + minus) + 10), 0.01, 0.45)
        for k in KINDS:
            own = np.array([x == k for x, _ in rows])
            prior[k] = float(np.clip((pos[own].sum() + 2) / (n[own].sum() + 4), 0.05, 0.95))
    x = _features(rows)
    w = np.zeros(x.shape[1])
    weight = np.sqrt(n)  # frequent patterns count more, but do not drown the others
    for _ in range(50 if len(rows) else 0):  # Newton steps with a ridge
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (q - p)) + 0.1 * w
        hessian = (x * (weight * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    final = _predict(w, rows) if rows else np.zeros(0)
    return SpanModel(
        {r: round(float(v), 9) for r, v in zip(rows, final, strict=True)},
        {name: (round(float(yes[i]), 6), round(float(wrong[i]), 6)) for i, name in enumerate(LABELERS)},
        tuple(float(v) for v in w),
    )


def fit_spans(docs: DataFrame) -> SpanModel:
    """Fit on the votes of all documents' candidates."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter((k, v) for t in batch["text"].to_pylist() for k, _, _, _, v in candidates(t))
            rows = list(found.items())
            yield pa.RecordBatch.from_pydict(
                {
                    "kind": pa.array([k for (k, _), _ in rows], pa.string()),
                    "votes": pa.array([v for (_, v), _ in rows], pa.string()),
                    "n": pa.array([n for _, n in rows], pa.int64()),
                }
            )

    batch_rows(docs.sparkSession, 1000)
    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(trimmed(counted), "kind string, votes string, n long")
    return fit({(r["kind"], r["votes"]): r["n"] for r in found.groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect()})


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def redacted(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """Every span replaced by its kind in angle brackets; of overlapping ones the whole reach by the first kind."""
    if not spans:
        return text
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_spans(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """Columns of docs, then n_email, n_ip, n_card, n_phone, base_sha256, spans, redacted.

    Counts and base_sha256 are of the base spans; spans lists these and the accepted ones. A null
    text has no spans and stays null. The model is fitted on docs unless it is given.
    """
    model = model or fit_spans(docs)
    added = [
        pa.field("n_email", pa.int64()),
        pa.field("n_ip", pa.int64()),
        pa.field("n_card", pa.int64()),
        pa.field("n_phone", pa.int64()),
        pa.field("base_sha256", pa.string()),
        pa.field("spans", pa.string()),
        pa.field("redacted", pa.string()),
    ]
    kept = [c for c in docs.columns if c.lower() not in {f.name for f in added}]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch["text"].to_pylist():
                all_of = candidates(text)
                base = [(k, a, b) for k, a, b, strict, _ in all_of if strict]
                spans = base + resolved(text, [(k, a, b) for k, a, b, strict, v in all_of if not strict and model.accepts(k, v)], base)
                n = Counter(k for k, _, _ in base)
                digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                rows.append((*(n[k] for k in BASE_KINDS), digest, _joined(spans), redacted(text, spans)))
            columns = list(zip(*rows, strict=True)) or [[]] * len(added)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, added, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *(f.name for f in added)])

    batch_rows(docs.sparkSession, 1000)
    docs = docs.select(*[F.col(f"`{c}`") for c in kept]).withColumn("text", F.col("text").cast("string"))
    schema = ", ".join([f"`{n}` {t}" for n, t in docs.dtypes] + ["n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string"])
    return docs.mapInArrow(trimmed(found), schema)

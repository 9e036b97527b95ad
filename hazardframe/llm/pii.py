"""Personal data: patterns, and a skip-chain conditional random field over the number-like and address-like tokens.

The base patterns mark e-mail addresses, IP addresses, card numbers and phone numbers. The field then labels the
remaining tokens and spaced runs that hold digits or an @: each has unary potentials from its shape, neighbours along the text share a
chain potential, and equal or similar tokens anywhere in the document share a skip potential, so that a number found
once in full carries its label to its repetitions. Base spans are evidence and keep their labels. Potentials are log odds
of counts over all documents (base spans give the labels); marginals come from loopy message passing inside each
document, in time linear in its candidate tokens.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
SHAPES = 4096  # shape features are hashed into so many rows
ROUNDS = 5
MIN_MARGINAL = 0.9
#: What a token is without other evidence; no shape makes a kind less likely than this, however often it stands unlabelled.
PRIOR = np.array([0.8, 0.05, 0.05, 0.05, 0.05])
#: Similar base spans that differ in kind, before any are seen, and how many pairs that counts for.
DISAGREE, DISAGREE_PAIRS = 0.0025, 100

# The base patterns. Possessive runs give the same matches as plain ones in linear time.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SPACED = re.compile(r"(?<![0-9])[0-9]++(?:[ ().-]++[0-9]++)++")
_TOKEN = re.compile(r"[^\x09-\x0D ]+")
_EDGE = ".,;:!?\"'()[]<>"


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            done = match.end()
            yield start, done
        at = text.find("@", max(done, at + 1))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.groups()):
            yield m.span()


def passes_luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and passes_luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m.group())) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns by kind and start, in code points."""
    out = []
    if "@" in text:
        out += [("email", *s) for s in emails(text)]
    if "." in text:
        out += [("ip", *s) for s in addresses(text)]
    out += [("card", *s) for s in cards(text)]
    if "+" in text:
        out += [("phone", *s) for s in phones(text)]
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


# --- candidate tokens -----------------------------------------------------------------------------------------------


@dataclass
class Candidate:
    start: int
    end: int
    text: str
    label: int | None  # label of the base span it lies in

    @property
    def key(self) -> str:
        """What equal mentions share: letters and digits only."""
        return re.sub(r"[^a-z0-9@]", "", self.text.lower())


def candidates(text: str, spans: list[tuple[str, int, int]]) -> list[Candidate]:
    """Tokens with an @ or at least seven digits, runs of 7 to 19 digits with blanks between shorter tokens, and the base
    spans themselves, in order of their start."""
    taken = sorted(spans, key=lambda s: s[1])
    out = [Candidate(s, e, text[s:e], LABELS.index(k)) for k, s, e in taken]
    starts = [s for _, s, _ in taken]
    stops = list(np.maximum.accumulate([e for _, _, e in taken])) if taken else []
    for m in _TOKEN.finditer(text):
        word = m.group()
        if "@" not in word and sum(map(str.isdigit, word)) < 7:
            continue
        s, e = m.start() + len(word) - len(word.lstrip(_EDGE)), m.end() - len(word) + len(word.rstrip(_EDGE))
        k = bisect_left(starts, e) - 1
        if s < e and not (k >= 0 and stops[k] > s):
            out.append(Candidate(s, e, text[s:e], None))
    known = {p for c in out for p in (c.start, c.end - 1)}
    for m in _SPACED.finditer(text):
        s, e = m.span()
        if " " in m.group() and e - s <= 60 and 7 <= sum(map(str.isdigit, m.group())) <= 19 and known.isdisjoint(range(s, e)):
            k = bisect_left(starts, e) - 1
            if not (k >= 0 and stops[k] > s):
                out.append(Candidate(s, e, text[s:e], None))
    return sorted(out, key=lambda c: c.start)


def shape(word: str) -> int:
    """Hash of the collapsed shape: runs of letters, runs of digits with their length, other characters as they are, and
    for numbers of a card's length whether the check digit is right."""
    out = []
    digits = "".join(c for c in word if c.isascii() and c.isdigit())
    if 13 <= len(digits) <= 19:
        out.append("valid" if passes_luhn(digits) else "invalid")
    for m in re.finditer(r"[A-Za-z]+|[0-9]+|.", word, re.S):
        run = m.group()
        if run[0].isascii() and run[0].isalpha():
            out.append("a")
        elif run[0].isascii() and run[0].isdigit():
            out.append(f"d{min(len(run), 20)}")
        else:
            out.append(run)
    h = 2166136261
    for b in "".join(out).encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h % SHAPES


# --- the field ------------------------------------------------------------------------------------------------------


@dataclass
class FieldModel:
    unary: np.ndarray  # SHAPES x labels, log odds
    chain: np.ndarray  # labels x labels, log ratios of neighbours
    skip: float  # log ratio of equal labels between similar tokens


def similar_groups(found: list[Candidate]) -> list[list[int]]:
    """Candidates that share their key, or a key's last nine characters where those are digits (a number with and without a prefix)."""
    groups: dict[str, list[int]] = defaultdict(list)
    for i, c in enumerate(found):
        key = c.key
        groups[key].append(i)
        if len(key) > 9 and key[-9:].isdigit():
            groups["…" + key[-9:]].append(i)
    return [g for g in groups.values() if len(g) > 1]


def marginals(found: list[Candidate], model: FieldModel) -> np.ndarray:
    """Marginals of the candidates after ROUNDS of message passing. Members of a similar group pass messages through one
    node of the group, so a group of n tokens costs n messages, not n squared."""
    n, m = len(found), len(LABELS)
    unary = np.array([model.unary[shape(c.text)] for c in found])
    for i, c in enumerate(found):
        if c.label is not None:  # evidence
            unary[i] = -50.0
            unary[i, c.label] = 0.0
        elif 13 <= len(digits := re.sub(r"[^0-9]", "", c.text)) <= 19 and not passes_luhn(digits):
            unary[i, LABELS.index("card")] = -50.0
    groups = similar_groups(found)
    left, right = np.zeros((n, m)), np.zeros((n, m))
    up = [np.zeros((len(g), m)) for g in groups]
    down = [np.zeros((len(g), m)) for g in groups]
    agree = np.full((m, m), 0.0)
    np.fill_diagonal(agree, model.skip)
    belief = unary.copy()
    for _ in range(ROUNDS):
        # Along the text, both ways.
        own = belief - left - right
        for i in range(1, n):
            left[i] = _pass(own[i - 1] + left[i - 1], model.chain)
        for i in range(n - 2, -1, -1):
            right[i] = _pass(own[i + 1] + right[i + 1], model.chain.T)
        belief = own + left + right
        # To the groups and back.
        for g, u, d in zip(groups, up, down):
            for k, i in enumerate(g):
                u[k] = _pass(belief[i] - d[k], agree)
            total = u.sum(axis=0)
            for k, i in enumerate(g):
                new = _pass(total - u[k], agree)
                belief[i] += new - d[k]
                d[k] = new
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _pass(message: np.ndarray, potential: np.ndarray) -> np.ndarray:
    out = np.logaddexp.reduce(message[:, None] + potential, axis=0)
    return out - out.max()


def find_spans(text: str, model: FieldModel | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans: those of the base and those the field adds."""
    base = base_spans(text)
    found = candidates(text, base) if model is not None else []
    if all(c.label is not None for c in found):
        return base, base
    p = marginals(found, model)
    added = [(LABELS[int(q.argmax())], c.start, c.end) for c, q in zip(found, p) if c.label is None and q.argmax() > 0 and q.max() >= MIN_MARGINAL]
    return base, base + added


def _worth_reading(column: pa.Array) -> list[bool]:
    """Texts with a digit or an @; no other can hold a span."""
    return pc.fill_null(pc.match_substring_regex(column, "[0-9@]"), False).to_pylist()


def fit_field(df: DataFrame, text: str = "text") -> FieldModel:
    """Rates over all documents: shapes by label, labels of neighbouring base spans, agreement of similar base spans. A
    token outside the base spans is unlabelled: it only lowers the rate at which its shape shows a kind, down to the prior."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            column = batch.column(0)
            for i, worth in enumerate(_worth_reading(column)):
                if worth:
                    value = column[i].as_py()
                    found = candidates(value, base_spans(value))
                    labels = [c.label or 0 for c in found]
                    for c, y in zip(found, labels):
                        counts["u", shape(c.text), y] += 1
                    for a, b in zip(labels, labels[1:]):
                        if a and b:
                            counts["c", a, b] += 1
                    for g in similar_groups(found):
                        known = [i for i in g if labels[i]]
                        for a, b in zip(known, known[1:]):
                            counts["s", int(labels[a] == labels[b]), 0] += 1
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([
            pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
            pa.array([k[2] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64()),
        ], names=["what", "a", "b", "n"])

    # At most SHAPES x labels rows and a few more.
    rows = df.select(text).mapInArrow(count, "what string, a int, b int, n bigint").groupBy("what", "a", "b").agg(F.sum("n").alias("n")).collect()
    m = len(LABELS)
    shapes, chain, skip = np.zeros((SHAPES, m)), np.zeros((m, m)), np.zeros(2)
    for what, a, b, n in rows:
        if what == "u":
            shapes[a, b] += n
        elif what == "c":
            chain[a, b] += n
        else:
            skip[a] += n
    rates = (shapes + PRIOR) / (shapes.sum(axis=1, keepdims=True) + 1)
    rates[:, 1:] = np.maximum(rates[:, 1:], PRIOR[1:])
    unary = np.log(rates / rates.sum(axis=1, keepdims=True))
    # Neighbours say something about kinds only; next to an unlabelled token nothing is known.
    pairs = (chain[1:, 1:] + 1) / (chain[1:, 1:].sum() + (m - 1) ** 2)
    ratio = np.zeros((m, m))
    ratio[1:, 1:] = np.log(pairs / (pairs.sum(axis=1, keepdims=True) * pairs.sum(axis=0, keepdims=True)))
    # How much more often similar base spans agree than they differ; at least what one agreement in doubt would say.
    differ = (skip[0] + DISAGREE * DISAGREE_PAIRS) / (skip.sum() + DISAGREE_PAIRS)
    agree = float(np.log((1 - differ) / differ)) if differ < 1 else 0.0
    return FieldModel(unary, np.clip(ratio, -1, 1), min(max(agree, 1.0), 6.0))


def personal_data(df: DataFrame, model: FieldModel | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, base (spans of the patterns) and spans (base and added), each as kind:start:end joined by commas,
    and the numbers of base spans by kind.

    NULL and empty texts have no spans. Repeated rows are read each for itself; an empty table gives an empty table.
    Columns of the result replace equally named kept ones.
    """
    counts = [f"n_{k}" for k in KINDS]
    kept = [c for c in keep if c not in (*counts, "base", "spans")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, texts = batch.columns
            base, spans, numbers = [], [], []
            for i, worth in enumerate(_worth_reading(texts)):
                found, every = find_spans(texts[i].as_py(), model) if worth else ([], [])
                base.append(joined(found))
                spans.append(joined(every))
                numbers.append(Counter(k for k, _, _ in found))
            out = [pa.array([n[k] for n in numbers], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([*columns, *out, pa.array(base, pa.string()), pa.array(spans, pa.string())], names=[*kept, *counts, "base", "spans"])

    schema = df.select(*kept).schema
    for c in counts:
        schema = schema.add(c, LongType())
    schema = schema.add("base", StringType()).add("spans", StringType())
    return df.select(*kept, F.col(text).alias("_text_to_read")).mapInArrow(read, schema)

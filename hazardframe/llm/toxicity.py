"""Toxicity by a weighted finite-state grammar.

Small transducers for targets, negation, reported speech, threats and insults are composed into one machine that runs
over the tokens of a clause and labels each insult or threat with the way it is used. The insult vocabulary (word forms
and word beginnings) is learned from labelled texts by counting on Spark; how much each use weighs is fitted on the
same labelled texts. A text is scored by its matched clauses, never by a word alone: the same insult counts differently
when it is aimed at someone, denied, or quoted.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from hazardframe.llm import textblocks as tb
from hazardframe.llm.storage import delete_table, write_table

MAX_TRAINING_ROWS = 20_000
MAX_ENTRIES = 5_000
PREFIX_LENGTHS = (4, 5, 6, 7, 8)
MIN_PRECISION = 0.5

# Closed word classes of the grammar in English, German, French and Spanish.
TARGETS = "you your yours u ur du dich dir dein deine ihr euch euer tu te toi ton ta vous votre vos tú ti tus usted ustedes vosotros they them she him her he sie ihn ils elles ellos ellas".split()
NEGATIONS = "not no never nor isn't aren't wasn't don't nobody nicht kein keine keinen nie niemals ne pas jamais aucun aucune nunca jamás tampoco ningún ninguna".split()
REPORTS = "said says say wrote writes called calls claimed quoted quote according sagte sagt schrieb nannte laut dit disait écrit appelé selon dijo dice escribió llamó según".split()
THREATS = "kill hurt destroy beat punch stab shoot hang töten schlagen umbringen vernichten tuer frapper détruire égorger matar golpear destruir".split()

USES = ("plain", "aimed", "denied", "reported", "threat")
# How the grammar weighs the uses before it has seen any label.
PRIOR = np.array([1.2, 1.5, 0.9, 0.9, 1.0])


@dataclass
class Machine:
    """A transducer: next state and output for each (state, symbol). Symbols it has no arc for use the arc of None."""

    start: int
    arcs: Mapping[tuple[int, str | None], tuple[int, str]]

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        return self.arcs.get((state, symbol)) or self.arcs[(state, None)]


def scope_machine(opener: str, length: int, name: str) -> Machine:
    """Says ``name`` for the ``length`` tokens after ``opener``; a clause end closes the scope."""
    arcs: dict[tuple[int, str | None], tuple[int, str]] = {}
    for left in range(length + 1):
        arcs[(left, None)] = (max(0, left - 1), name if left else "")
        arcs[(left, opener)] = (length, name if left else "")
        arcs[(left, "end")] = (0, "")
    return Machine(0, arcs)


def clause_machine(opener: str, name: str) -> Machine:
    """Says ``name`` from ``opener`` to the end of the clause."""
    arcs = {(s, sym): out for s in (0, 1) for sym, out in ((None, (s, name if s else "")), (opener, (1, name)), ("end", (0, "")))}
    return Machine(0, arcs)


@dataclass
class Composed:
    """The product of several machines, expanded once: arcs[state][symbol] = (state, use or None)."""

    arcs: list[dict[str, tuple[int, int | None]]] = field(default_factory=list)


SYMBOLS = ("word", "end", "target", "negation", "report", "threat", "insult")


def compose(machines: Iterable[Machine]) -> Composed:
    machines = list(machines)
    first = tuple(m.start for m in machines)
    number, todo, out = {first: 0}, [first], Composed()
    while todo:
        state = todo.pop(0)
        row = {}
        for symbol in SYMBOLS:
            moved = [m.step(s, symbol) for m, s in zip(machines, state)]
            following = tuple(s for s, _ in moved)
            said = {name for _, name in moved if name}
            if following not in number:
                number[following] = len(number)
                todo.append(following)
            row[symbol] = (number[following], use_of(symbol, said))
        out.arcs.append(row)
    return out


def use_of(symbol: str, said: set[str]) -> int | None:
    """The label of a match: an insult by its context, a threat only where a target stands next to it."""
    if symbol == "insult":
        for name in ("reported", "denied", "aimed"):
            if name in said:
                return USES.index(name)
        return USES.index("plain")
    if (symbol == "threat" and "aimed" in said) or (symbol == "target" and "menace" in said):
        return USES.index("reported" if "reported" in said else "denied" if "denied" in said else "threat")
    return None


def grammar() -> Composed:
    return compose([
        scope_machine("target", 4, "aimed"), scope_machine("negation", 3, "denied"),
        clause_machine("report", "reported"), scope_machine("threat", 3, "menace"),
    ])


@dataclass
class ToxicityModel:
    words: dict[str, float]
    prefixes: dict[str, float]
    weights: np.ndarray
    bias: float


CLAUSE_ENDS = frozenset(b".!?;:\n")
THREAT_WEIGHT = 4.0


class Scanner:
    """Finds lexicon words by hash in whole batches and runs the grammar over the clauses that hold one."""

    def __init__(self, words: Mapping[str, float], prefixes: Mapping[str, float]):
        self.machine = grammar()
        self.words = {w.encode(): v for w, v in words.items()}
        self.prefixes = {p.encode(): v for p, v in prefixes.items()}
        self.classes = {w.encode(): c for c, ws in (("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS), ("threat", THREATS)) for w in ws}
        self.lengths = sorted({len(p) for p in self.prefixes})
        seeds = [*self.words, *(w.encode() for w in THREATS)]
        self.whole = self._bitmap(seeds)
        self.begin = {n: self._bitmap([p for p in self.prefixes if len(p) == n]) for n in self.lengths}

    @staticmethod
    def _bitmap(entries: list[bytes]) -> np.ndarray:
        table = np.zeros(1 << 20, bool)
        if entries:
            data, at = tb.text_bytes(pa.array([e.decode() for e in entries]))
            h = tb.range_hash(tb.prefix_hash(data), at[:-1], at[1:])
            table[(h & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        return table

    def weight(self, token: bytes) -> float:
        best = self.words.get(token, 0.0)
        for n in self.lengths:
            if n <= len(token):
                best = max(best, self.prefixes.get(token[:n], 0.0))
        return best

    def features(self, column: pa.Array) -> np.ndarray:
        """For each text the summed weight of its matched clauses by use."""
        out = np.zeros((len(column), len(USES)))
        for lo, hi in tb.slices(column):
            self._slice(pc.utf8_lower(column.slice(lo, hi - lo)), out[lo:hi])
        return out

    def _slice(self, column: pa.Array, out: np.ndarray) -> None:
        data, offsets = tb.text_bytes(column)
        starts, ends, first = tb.word_bounds(data, offsets, tb.NOT_ALNUM)
        if not len(starts):
            return
        sums, low = tb.prefix_hash(data), np.uint64((1 << 20) - 1)
        maybe = self.whole[(tb.range_hash(sums, starts, ends) & low).astype(np.int64)]
        for n in self.lengths:
            long = np.flatnonzero(ends - starts >= n)
            if len(long):
                maybe[long] |= self.begin[n][(tb.range_hash(sums, starts[long], starts[long] + n) & low).astype(np.int64)]
        raw = data.tobytes()
        hits = [i for i in np.flatnonzero(maybe).tolist() if self._is_seed(raw[starts[i] : ends[i]])]
        docs = (np.searchsorted(first, hits, "right") - 1).tolist()
        done = -1
        for i, d in zip(hits, docs):
            if i > done:  # a clause is read once, from its first hit's clause start to its end
                done = self._clause(raw, starts, ends, int(first[d]), int(first[d + 1]), i, out[d])

    def _is_seed(self, token: bytes) -> bool:
        return self.classes.get(token) == "threat" or self.weight(token) > 0

    def _clause(self, raw, starts, ends, low: int, high: int, hit: int, row: np.ndarray) -> int:
        at = hit
        while at > low and not CLAUSE_ENDS.intersection(raw[ends[at - 1] : starts[at]]):
            at -= 1
        state, arcs = 0, self.machine.arcs
        while at < high:
            token = raw[starts[at] : ends[at]]
            weight = self.weight(token)
            symbol = "insult" if weight > 0 else self.classes.get(token, "word")
            state, use = arcs[state][symbol]
            if use is not None:
                row[use] += weight or THREAT_WEIGHT
            at += 1
            if at < high and CLAUSE_ENDS.intersection(raw[ends[at - 1] : starts[at]]):
                break
        return at - 1


def squash(features: np.ndarray) -> np.ndarray:
    return np.log1p(features)


def training_rows(documents: DataFrame, labels: DataFrame, id_column: str, text: str, label: str, limit: int) -> DataFrame:
    """Texts (t) and labels (y) of at most ``limit`` labelled ids, the first in hash order: a documented bound of the
    model, not of the scoring. The chosen ids are few by that bound, so they are sent to the scan of the texts. Of several labels
    for an id the largest counts; of several texts for an id, the one with the smallest digest."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull())
    known = known.groupBy(F.col(id_column).alias("_t_id")).agg(F.max(F.when(F.col(label) > 0, 1).otherwise(0)).alias("y"))
    chosen = known.orderBy(F.xxhash64(F.col("_t_id").cast("string")), "_t_id").limit(limit)
    texts = documents.select(F.col(id_column).alias("_t_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    found = texts.join(F.broadcast(chosen), "_t_id")
    one = found.groupBy("_t_id").agg(F.min(F.md5(F.col("t").cast("binary"))).alias("_t_digest"))
    # Equal texts of an id are one row; the digests are few by the bound, and go along with the ids.
    same = found.join(F.broadcast(one), "_t_id").where(F.md5(F.col("t").cast("binary")) == F.col("_t_digest"))
    return same.select("_t_id", "t", "y").dropDuplicates(["_t_id"]).select("t", "y")


def learn_lexicon(rows: DataFrame, max_entries: int = MAX_ENTRIES) -> tuple[dict[str, float], dict[str, float]]:
    """Word forms and word beginnings whose texts are toxic far beyond chance, with their log odds.

    Counted as texts per form on Spark. A form stays when its log-likelihood ratio exceeds the logarithm of the number
    of forms tried by 2 and at least MIN_PRECISION of its texts are toxic. At most ``max_entries`` forms, strongest first.
    """
    words = F.array_distinct(F.filter(F.split(F.lower("t"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: F.length(w) > 2))
    begins = F.flatten(F.transform(words, lambda w: F.array(*[
        F.when(F.length(w) >= n, F.concat(F.substring(w, 1, n), F.lit("*"))) for n in PREFIX_LENGTHS
    ])))
    forms = F.explode(F.array_distinct(F.array_compact(F.concat(words, begins))))
    counts = rows.select("y", forms.alias("form")).groupBy("form").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n")).where("n > 1")
    counts, path = write_table(counts, "forms")
    total = rows.agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n")).first()
    positives, all_rows = total["pos"] or 0, total["n"]
    if not positives or positives == all_rows:
        return {}, {}
    tried = counts.count()
    rate = positives / all_rows
    neg = F.col("n") - F.col("pos")
    ratio = F.col("pos") * F.log(F.col("pos") / (F.col("n") * rate)) + F.when(neg > 0, neg * F.log(neg / (F.col("n") * (1 - rate)))).otherwise(0.0)
    odds = F.log((F.col("pos") + 0.5) / (positives + 1)) - F.log((neg + 0.5) / (all_rows - positives + 1))
    found = (
        counts.where((F.col("pos") > 1) & (F.col("pos") >= MIN_PRECISION * F.col("n"))).withColumn("llr", ratio).withColumn("odds", odds)
        .where(F.col("llr") > math.log(max(tried, 2)) + 2).orderBy(F.col("llr").desc(), "form").limit(max_entries).collect()
    )
    delete_table(rows.sparkSession, path)
    entries = {r["form"]: float(r["odds"]) for r in found}
    return {f: v for f, v in entries.items() if not f.endswith("*")}, {f[:-1]: v for f, v in entries.items() if f.endswith("*")}


def fit_weights(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Logistic regression drawn towards the grammar's own weights: uses that the labels do not show keep them."""
    x = np.hstack([squash(x), np.ones((len(x), 1))])
    centre = np.append(PRIOR, -3.0)
    precision = np.append(np.full(len(PRIOR), 1.0), 0.1)
    beta = centre.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (y - p) - precision * (beta - centre)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(precision)
        step = np.linalg.solve(hessian, gradient)
        beta += step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return beta[:-1], float(beta[-1])


def fit_toxicity(
    documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_TRAINING_ROWS
) -> ToxicityModel:
    """Learn the vocabulary and the weights of the uses. Only ids, texts and labels are read; ids only find the texts."""
    rows, path = write_table(training_rows(documents, labels, id_column, text, label, max_rows), "training")
    words, prefixes = learn_lexicon(rows)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(words, prefixes)
        for batch in batches:
            x = scanner.features(batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(x[:, k]) for k in range(len(USES)))], names=["y", *USES])

    schema = "y double, " + ", ".join(f"{u} double" for u in USES)
    # At most max_rows rows of a few numbers.
    got = rows.select("t", F.col("y").cast("double")).mapInArrow(measure, schema).toPandas()
    delete_table(rows.sparkSession, path)
    if got.empty:
        return ToxicityModel(words, prefixes, PRIOR.copy(), -3.0)
    weights, bias = fit_weights(got[list(USES)].to_numpy(float), got["y"].to_numpy(float))
    return ToxicityModel(words, prefixes, np.maximum(weights, 0.0), bias)


def score_toxicity(
    df: DataFrame, model: ToxicityModel, text: str = "text", name: str = "score", keep: Sequence[str] | None = None
) -> DataFrame:
    """The columns ``keep`` (default: all) with the score of each text, 0 to 1. NULL and empty texts get the score of a
    text without a match. A kept column that already has the name is replaced. Rows are scored each for itself, in the
    scan stage; repeated rows get equal scores, an empty table gives an empty table."""
    kept = [c for c in (df.columns if keep is None else keep) if c != name]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(model.words, model.prefixes)
        for batch in batches:
            *columns, texts = batch.columns
            z = squash(scanner.features(texts)) @ model.weights + model.bias
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(p)], names=[*kept, name])

    schema = StructType([*(df.schema[c] for c in kept), StructField(name, DoubleType())])
    return df.select(*kept, F.col(text).alias("_text_to_score")).mapInArrow(score, schema)

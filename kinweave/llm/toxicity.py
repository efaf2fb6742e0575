"""Toxicity by a weighted finite-state pattern grammar.

Five transducers are composed over the words of a clause. The lexical one is a weighted trie over
letters: each state is the beginning of a word, and a word takes the weight of the deepest state on its
path that the labelled rows say enough about; so unseen endings of an insult's stem are found. It
rewrites words to symbols (insult, threat, target, negation, report, quote, other), where a hit may also
be read as any other word. The transducer of negation marks hits that follow a negation closely, the one
of quotes those between a pair of quotes (a last one without a partner opens nothing), the one of reports
those after a reporting word. The one of targets has two branches, a clause that addresses someone and
one that does not; a threat counts in the first only, and an insult counts for more there.

The four over symbols are composed once, the trie as words are read. A clause is what its path of the
largest weight writes: a sum of arc weights for each kind of match. A negated or reported hit weighs
less, feeds no other figure of the text, and may speak against toxicity.

Weights of the trie, of the grammar's arcs and of the kinds are learned from a bounded sample of
labelled rows; all texts are scored whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.lineage import cut
from kinweave.llm.common import batch, id_and_text, small_batches
from kinweave.llm.quality import SAMPLE, labelled_sample
from kinweave.llm.transducers import Transducer, best_path, compose, numbered

#: Fixed values of the grammar, in four languages.
THREATS = frozenset("kill hurt destroy murder beat strangle töten umbringen zerstören tuer détruire matar destruir".split())
TARGETS = frozenset("you your yours u him her them they he she du dich dir ihr euch sie tu toi vous te ti usted ustedes".split())
NEGATIONS = frozenset("not no never isn't aren't don't without nicht kein keine nie pas jamais sans nunca sin".split())
REPORTS = frozenset("said says called wrote reported quoted claimed sagte nannte schrieb écrit appelé dijo llamó escribió".split())
CLAUSE_END = re.compile(r"[.!?;:\n]+")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”«»]")
QUOTES = frozenset("\"“”«»")
#: Words between a negation and what it negates; letters of the trie's states.
SCOPE, LEAST_LETTERS, MOST_LETTERS = 2, 3, 8
#: Log odds below which a word is no insult; texts that draw a state to the one above it.
LEAST_ODDS, DRAWN = 1.0, 4
#: States that a model holds at most: those that say most.
STATES = 20_000
KINDS = ("insult", "negated", "reported", "targeted", "threat", "clauses", "worst", "dense")
#: Kinds that may speak against toxicity, and those that are a match of a clause's own.
EITHER_WAY, OWN = ("negated", "reported"), ("insult", "targeted", "threat")
END = "$"
#: Symbols over which the grammar is written. A mark after a hit says that it is negated or reported.
INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, OTHER = "itynrqx"
HITS = (INSULT, THREAT)
NEGATED, REPORTED = ("i-", "t-"), ("i+", "t+")
#: Weight of a threat's arc; log odds of a mark against a plain insult before any row is seen, and the
#: number of texts that this is worth.
THREAT_WEIGHT = 1.0
PRIOR, PRIOR_TEXTS = {"negated": -2.0, "reported": -1.5, "targeted": 0.5}, 20


def negation_machine() -> Transducer:
    """Hits within ``SCOPE`` words after a negation are marked; the state is how many words are left."""
    machine = Transducer(0, {left: 0.0 for left in range(SCOPE + 1)})
    for left in range(SCOPE + 1):
        after = max(left - 1, 0)
        machine.add(left, (NEGATION,), SCOPE)
        machine.add(left, (TARGET, REPORT, QUOTE, OTHER), after)
        for hit, marked in zip(HITS, NEGATED):
            machine.add(left, (hit,), after, marked if left else hit)
    return machine


def quote_machine() -> Transducer:
    """Hits between two quotes are marked. A quote is guessed to open, or to be the last without a
    partner: the first guess must be closed to be accepted, the second has no arc for another quote."""
    machine = Transducer("out", {"out": 0.0, "last": 0.0})
    rest = (TARGET, NEGATION, REPORT, OTHER, *NEGATED)
    for state in ("out", "in", "last"):
        machine.add(state, rest, state)
        for hit, marked in zip(HITS, REPORTED):
            machine.add(state, (hit,), state, marked if state == "in" else hit)
    machine.add("out", (QUOTE,), "in", OTHER)
    machine.add("out", (QUOTE,), "last", OTHER)
    machine.add("in", (QUOTE,), "out", OTHER)
    return machine


def report_machine() -> Transducer:
    """Hits after a reporting word are marked."""
    machine = Transducer("plain", {"plain": 0.0, "reported": 0.0})
    for state in ("plain", "reported"):
        machine.add(state, (TARGET, NEGATION, OTHER, *NEGATED, *REPORTED), state)
        machine.add(state, (REPORT,), "reported", OTHER)
        for hit, marked in zip(HITS, REPORTED):
            machine.add(state, (hit,), state, marked if state == "reported" else hit)
    return machine


def target_machine(marks: dict[str, float]) -> Transducer:
    """Names the matches: with a target somewhere in the clause (``sought``, ``seen``), or without one (``none``)."""
    machine = Transducer("start", {"start": 0.0, "seen": 0.0, "none": 0.0})
    for state, to in (("start", "sought"), ("sought", "sought"), ("seen", "seen"), ("start", "none"), ("none", "none")):
        addressed = to != "none"
        machine.add(state, (NEGATION, OTHER), to, OTHER)
        machine.add(state, (INSULT,), to, "targeted" if addressed else "insult", marks["targeted"] if addressed else 0.0)
        machine.add(state, (NEGATED[0],), to, "negated", marks["negated"])
        machine.add(state, (REPORTED[0],), to, "reported", marks["reported"])
        for symbol, kind, weight in ((THREAT, "threat", 0.0), (NEGATED[1], "negated", marks["negated"]),
                                     (REPORTED[1], "reported", marks["reported"])):
            if addressed:
                machine.add(state, (symbol,), to, kind, THREAT_WEIGHT + weight)
    for state in ("start", "sought", "seen"):
        machine.add(state, (TARGET,), "seen", OTHER)
    return machine


@dataclass
class Grammar:
    """Weights of the trie's states, of the marks' arcs and of the kinds of matches."""

    states: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(KINDS)))
    marks: dict[str, float] = field(default_factory=lambda: dict(PRIOR))

    def __post_init__(self):
        machine = negation_machine()
        for further in (quote_machine(), report_machine(), target_machine(self.marks)):
            machine = compose(machine, further)
        self.machine = numbered(machine)
        self.words = {w: ((symbol, 0.0),) for words, symbol in (
            (TARGETS, TARGET), (NEGATIONS, NEGATION), (QUOTES, QUOTE), (REPORTS, REPORT)) for w in words}
        self.trie: dict[str, dict[str, str]] = {}
        for state in self.states:
            for k in range(len(state)):
                self.trie.setdefault(state[:k], {})[state[k]] = state[:k + 1]

    def weight(self, word: str) -> float:
        """Of the deepest known state on the word's path; 0 without one or if it speaks against."""
        state, found = "", 0.0
        for letter in word + END:
            state = self.trie.get(state, {}).get(letter)
            if state is None:
                break
            found = self.states.get(state, found)
        return found if found > LEAST_ODDS else 0.0

    def read(self, word: str) -> tuple[tuple[str, float], ...]:
        """The symbols that the trie writes for a word, with their weights."""
        if word in self.words:
            return self.words[word]
        hits = [(INSULT, weight)] if (weight := self.weight(word)) > 0 else []
        return ((OTHER, 0.0), *hits, *([(THREAT, 0.0)] if word in THREATS else []))

    def clause(self, words: list[str]) -> dict[str, float]:
        """Weights of what the best path of one clause matches, by kind."""
        readings = [self.read(word) for word in words]
        if all(len(options) == 1 for options in readings):  # no hit
            return {}
        found: dict[str, float] = {}
        path = best_path(self.machine, readings, OTHER)
        for kind, weight in path[1] if path else ():
            found[kind] = found.get(kind, 0.0) + weight
        return found

    def matches(self, text: str) -> np.ndarray:
        """What the whole text matches, by kind; sums are damped, so that length alone does not decide."""
        out = dict.fromkeys(KINDS, 0.0)
        size = 0
        for clause in CLAUSE_END.split(text.lower()):
            words = WORD.findall(clause)
            size += len(words)
            found = self.clause(words)
            own = [found[kind] for kind in OWN if kind in found]
            out["clauses"] += bool(own)
            out["worst"] = max(out["worst"], sum(own))
            for kind, weight in found.items():
                out[kind] += weight
            out["insult"] += found.get("targeted", 0.0)
        out["dense"] = 100 * (out["insult"] + out["threat"]) / max(size, 20)
        return np.log1p([out[k] for k in KINDS])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


class Scanner:
    """Passes over texts without any word of weight, which are most, at the speed of set operations."""

    def __init__(self, grammar: Grammar, most: int = 500_000):
        self.grammar, self.most, self.clean = grammar, most, set()

    def matches(self, text: str) -> np.ndarray:
        if len(self.clean) > self.most:
            self.clean.clear()
        for chunk in set(text.lower().split()) - self.clean:
            if any(w in THREATS or self.grammar.weight(w) > 0 for w in WORD.findall(chunk)):
                return self.grammar.matches(text)
            self.clean.add(chunk)
        return np.zeros(len(KINDS))


def states_of(text: str) -> set[str]:
    """All states that the words of a text pass."""
    words = set(WORD.findall(text.lower()))
    return {w + END for w in words} | {w[:k] for w in words for k in range(LEAST_LETTERS, min(len(w), MOST_LETTERS) + 1)}


def learn_states(sample: DataFrame, most: int = STATES) -> dict[str, float]:
    """States of the trie with their log odds over those of the whole sample.

    Kept are states in which toxic texts are far too many to be chance, and all states below them. A
    state's share of toxic texts is drawn towards that of the state above it as if ``DRAWN`` more
    texts had passed there, so a rare ending says little more than its stem. Counts are summed per
    task before the shuffle.
    """
    schema = "state string, toxic long, other long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            counts = {0.0: Counter(), 1.0: Counter()}
            for y, text in zip(rows["y"].to_pylist(), rows["text"].to_pylist()):
                counts[y].update(states_of(text))
            names = list(counts[0.0].keys() | counts[1.0].keys())
            yield batch(schema, state=names, toxic=[counts[1.0][s] for s in names], other=[counts[0.0][s] for s in names])

    totals = sample.agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("other")).first()
    n_toxic, n_other = int(totals["toxic"] or 0), int(totals["other"] or 0)
    if not n_toxic or not n_other:
        return {}
    rate = n_toxic / (n_toxic + n_other)
    told = cut(sample.select("y", "text").mapInArrow(work, schema).groupBy("state")
               .agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).filter("toxic + other > 1"))
    n = F.col("toxic") + F.col("other")
    share = F.col("toxic") / n
    # n times the relative entropy of the state's share to the sample's: minus the log of the chance of it.
    surprise = (F.when(F.col("toxic") > 0, F.col("toxic") * F.log(share / rate)).otherwise(0.0)
                + F.when(F.col("other") > 0, F.col("other") * F.log((1 - share) / (1 - rate))).otherwise(0.0))
    bound = float(np.log(max(told.count(), 1)) + 2)
    strong = (told.filter((surprise > bound) & (share * (1 - rate) > 4 * rate * (1 - share)))
              .orderBy(surprise.desc(), "state").limit(most))
    begins = F.broadcast(cut(strong.select(F.col("state").alias("begin"))))  # ``most`` short strings
    path = F.array_append(F.transform(F.sequence(F.lit(LEAST_LETTERS), F.greatest(F.lit(LEAST_LETTERS), F.least(
        F.length("state"), F.lit(MOST_LETTERS)))), lambda k: F.substr(F.col("state"), F.lit(1), k)), F.col("state"))
    below = (told.withColumn("begin", F.explode(path)).join(begins, "begin", "left_semi")
             .select("state", "toxic", "other").distinct().orderBy(n.desc(), "state").limit(most).collect())
    shares: dict[str, float] = {}
    for row in sorted(below, key=lambda r: (len(r["state"].rstrip(END)), r["state"].endswith(END), r["state"])):
        above = next((shares[state] for state in path_of(row["state"]) if state in shares), rate)
        shares[row["state"]] = (row["toxic"] + DRAWN * above) / (row["toxic"] + row["other"] + DRAWN)
    return {state: float(np.log(p / (1 - p)) - np.log(rate / (1 - rate))) for state, p in shares.items()}


def path_of(state: str) -> Iterator[str]:
    """The states above a state, the deepest first."""
    word = state.rstrip(END)
    return (word[:k] for k in range(min(len(word) - (state == word), MOST_LETTERS), LEAST_LETTERS - 1, -1))


def fit_weights(x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Logistic regression with a small ridge; matches but those of ``EITHER_WAY`` only speak for toxicity."""
    if not len(y) or y.min() == y.max():
        return float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), np.zeros(len(KINDS))
    bias, weights = 0.0, np.zeros(len(KINDS))
    least = np.array([-np.inf if kind in EITHER_WAY else 0.0 for kind in KINDS])
    full = np.column_stack([np.ones(len(x)), x])
    ridge = np.full(len(KINDS) + 1, 0.05)
    ridge[0] = 1e-6
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ weights + bias, -30, 30)))
        grad = full.T @ (y - p) - ridge * np.concatenate([[bias], weights])
        # A weight at its bound that would go below it takes no part in the step.
        moves = np.concatenate([[True], (weights > least) | (grad[1:] > 0)])
        curve = (full[:, moves] * (p * (1 - p) + 1e-9)[:, None]).T @ full[:, moves] + np.diag(ridge[moves])
        step = np.zeros(len(ridge))
        step[moves] = np.linalg.solve(curve, grad[moves])
        step *= min(1.0, 2.0 / np.abs(step).max())
        before = np.concatenate([[bias], weights])
        bias, weights = bias + step[0], np.maximum(weights + step[1:], least)
        if np.abs(np.concatenate([[bias], weights]) - before).max() < 1e-6:
            break
    return float(bias), weights


def learn_marks(x: np.ndarray, y: np.ndarray) -> dict[str, float]:
    """Arc weights of the marks: log odds of texts with such a match over those with a plain insult only.

    Each is drawn to its prior as if ``PRIOR_TEXTS`` more texts had spoken for that.
    """
    has = {kind: x[:, i] > 0 for i, kind in enumerate(KINDS)}
    plain = has["insult"] & ~(has["targeted"] | has["negated"] | has["reported"])
    base = np.log((y[plain].sum() + 1) / ((1 - y[plain]).sum() + 1))
    marks = {}
    for kind, prior in PRIOR.items():
        expected = 1 / (1 + np.exp(-(base + prior)))
        alone = has[kind] & ~np.any([has[other] for other in PRIOR if other != kind], axis=0)
        share = (y[alone].sum() + PRIOR_TEXTS * expected) / (alone.sum() + PRIOR_TEXTS)
        marks[kind] = float(np.log(share / (1 - share)) - base)
    return marks


def matches_of(texts: DataFrame, grammar: Grammar, keep: str) -> DataFrame:
    """``keep`` (a long or double column) and the matches ``x`` of each text."""
    kind = dict(texts.dtypes)[keep].replace("bigint", "long")
    schema = f"{keep} {kind}, x array<double>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(grammar)
        for rows in batches:
            yield batch(schema, **{keep: rows[keep]}, x=[scanner.matches(t).tolist() for t in rows["text"].to_pylist()])

    return texts.select(keep, "text").mapInArrow(work, schema)


def learn_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, most: int = SAMPLE,
                   id_column: str = "doc_id", text_column: str = "text") -> Grammar:
    """Learn states and weights from a sample of the labelled rows that ``learn`` allows."""
    small_batches(docs.sparkSession)
    sample = cut(labelled_sample(id_and_text(docs, id_column, text_column), labels, "toxic", learn, most))
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2))
    # Weights of marks and matches come from texts that the states were not learned from.
    states = [learn_states(sample.filter(half == side)) for side in (0, 1)]

    def matched(marks: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
        rows: list[tuple] = []
        for side in (0, 1):
            held = matches_of(sample.filter(half != side), Grammar(states[side], marks=marks), "y")
            rows += [(r["y"], *r["x"]) for r in held.collect()]
        found = np.array(sorted(rows)).reshape(len(rows), len(KINDS) + 1)
        return found[:, 1:], found[:, 0]

    marks = learn_marks(*matched(dict.fromkeys(PRIOR, 0.0)))
    return Grammar(learn_states(sample), *fit_weights(*matched(marks)), marks)


def score_toxicity(docs: DataFrame, grammar: Grammar, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, score`` for each row: 1 is most toxic. A null text counts as empty and matches nothing.
    Repeated rows give equal results; other columns are not read."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, score double"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(grammar)
        for rows in batches:
            x = np.array([scanner.matches(t) for t in rows["text"].to_pylist()]).reshape(-1, len(KINDS))
            yield batch(schema, doc_id=rows["doc_id"], score=grammar.score(x))

    return id_and_text(docs, id_column, text_column).mapInArrow(work, schema)

"""The composed grammar against rules written out plainly."""

import itertools
import random

import numpy as np

from kinweave.llm import toxicity
from kinweave.llm.transducers import Transducer, best_path, compose, numbered

STATES = {"zorb": 3.0, "zorbil$": 0.4, "grim": 1.5}
MARKS = {"negated": -2.0, "reported": -1.0, "targeted": 0.5}


def grammar():
    weights = np.array([1.0, -0.5, 0.2, 0.3, 1.0, 0.1, 0.2, 0.0])
    return toxicity.Grammar(dict(STATES), -2.0, weights, dict(MARKS))


def by_rules(words):
    """What a clause matches, rule by rule, without a transducer."""
    quotes = [i for i, w in enumerate(words) if w in toxicity.QUOTES]
    inside = set()
    for a, b in zip(quotes[::2], quotes[1::2]):
        inside |= set(range(a, b))
    target = any(w in toxicity.TARGETS for w in words)
    found = {}
    for i, word in enumerate(words):
        lexical = {"zorbak": 3.0, "grim": 1.5}.get(word, 0.0)
        options = []
        before = words[max(0, i - toxicity.SCOPE):i]
        mark = ("negated" if any(w in toxicity.NEGATIONS for w in before)
                else "reported" if i in inside or any(w in toxicity.REPORTS for w in words[:i]) else None)
        if lexical:
            options.append((lexical + MARKS[mark], mark) if mark else
                           (lexical + MARKS["targeted"], "targeted") if target else (lexical, "insult"))
        if word in toxicity.THREATS and target:
            options.append((1.0 + MARKS[mark], mark) if mark else (1.0, "threat"))
        if options and max(options)[0] > 0:
            found[max(options)[1]] = found.get(max(options)[1], 0.0) + max(options)[0]
    return found


def test_best_paths_are_what_the_rules_say():
    tool = grammar()
    words = ["zorbak", "grim", "kill", "you", "not", "said", '"', "tree", "zorbil"]
    draw = random.Random(5)
    cases = [list(c) for n in range(4) for c in itertools.product(words, repeat=n)]
    cases += [draw.choices(words, k=draw.randrange(4, 14)) for _ in range(3000)]
    for case in cases:
        got, expected = tool.clause(case), by_rules(case)
        assert got.keys() == expected.keys(), case
        assert all(abs(got[k] - expected[k]) < 1e-9 for k in got), case


def test_scores_from_the_model_by_hand():
    tool = grammar()
    for text in ["", "you zorbak! a grim tree.", "not a zorbak; he said you zorbak", "zorbak"]:
        clauses = [by_rules(toxicity.WORD.findall(c)) for c in toxicity.CLAUSE_END.split(text)]
        total = {k: sum(c.get(k, 0.0) for c in clauses) for k in ("insult", "negated", "reported", "targeted", "threat")}
        own = [sum(c[k] for k in ("insult", "targeted", "threat") if k in c) for c in clauses]
        total["insult"] += total["targeted"]
        size = len(toxicity.WORD.findall(text))
        x = [*total.values(), sum(o > 0 for o in own), max(own), 100 * (total["insult"] + total["threat"]) / max(size, 20)]
        expected = 1 / (1 + np.exp(-(sum(w * np.log1p(v) for w, v in zip(tool.weights, x)) + tool.bias)))
        assert abs(tool.score(tool.matches(text)[None, :])[0] - expected) < 1e-12
        assert np.array_equal(toxicity.Scanner(tool).matches(text), tool.matches(text))


def test_negation_and_reports_lower_a_clause():
    tool = grammar()
    score = {t: tool.score(tool.matches(t)[None, :])[0] for t in ("you are a zorbak", "you are not a zorbak", "he said a zorbak", "a tree")}
    assert score["you are a zorbak"] > score["a tree"] > score["you are not a zorbak"]
    assert score["he said a zorbak"] < score["you are a zorbak"]


def test_composition_against_both_in_a_row():
    first, second = Transducer(0, {0: 0.0, 1: 0.5}), Transducer("a", {"b": 1.0})
    first.add(0, "x", 1, "m", 1.0)
    first.add(0, "x", 0, "n", 2.0)
    first.add(1, "xy", 0, "n")
    second.add("a", "mn", "b")
    second.add("b", "n", "b", "k", -3.0)
    second.add("b", "m", "a", "z", 4.0)
    both = compose(first, second)

    def paths(machine, text):
        at = [(machine.start, 0.0, "")]
        for symbol in text:
            at = [(to, w + more, out + o) for state, w, out in at for o, more, to in machine.arcs.get(state, {}).get(symbol, ())]
        return [(round(w + machine.finals[s], 9), out) for s, w, out in at if s in machine.finals]

    for n in range(5):
        for text in itertools.product("xy", repeat=n):
            expected = sorted((round(w + v, 9), out) for w, middle in paths(first, text) for v, out in paths(second, middle))
            assert sorted(paths(both, text)) == sorted(paths(numbered(both), text)) == expected
            best = best_path(both, [((s, 0.0),) for s in text], "")
            assert (best is None) == (not expected) and (best is None or abs(best[0] - max(expected)[0]) < 1e-9)


def test_empty_tables_and_long_texts(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    from pyspark.sql import functions as F
    model = toxicity.learn_toxicity(empty, labels, F.lit(True))
    assert toxicity.score_toxicity(empty, model).count() == 0
    long = spark.createDataFrame([(1, "tree " * 200_000 + "zorbak"), (1, "tree"), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id, round(r.score, 6)) for r in toxicity.score_toxicity(long, grammar()).collect())
    assert len(got) == 3 and got[1][1] > got[0][1] == got[2][1]

"""The clause grammar: the composed machine against its parts, and what negation, reported speech and threats do to a score."""

from __future__ import annotations

import math
import random

import pytest

from tabulon.llm import toxicity as tox

SF = "/root/testdata/sf0.01"


def plain_weights(symbols):
    """Weights of a clause by the rules themselves: look around each place instead of running a machine."""
    out = []
    for i, s in enumerate(symbols):
        near = tox.TARGET in symbols[max(0, i - 4):i]
        if s == tox.INSULT:
            out.append(1.3 if near else 1.0)
        elif s == tox.THREAT:
            out.append(1.2 if near else 0.6)
        elif s == tox.TARGET:
            before = symbols[max(0, i - 3):i]
            threat = max((k for k, b in enumerate(before) if b == tox.THREAT), default=None)
            out.append(1.0 if threat is not None and tox.TARGET not in before[threat:] else 0.0)
        else:
            out.append(0.0)
    return out


def run(machine, symbols):
    state, out = 0, []
    for s in symbols:
        out.append(machine.weight[state][s])
        state = machine.move[state][s]
    return out


def test_machine_equals_its_rules():
    rng = random.Random(4)
    for _ in range(400):
        symbols = [rng.choice(tox.SYMBOLS) for _ in range(rng.randint(0, 14))]
        got = run(tox.GRAMMAR, symbols)
        assert all(math.isclose(a, b) for a, b in zip(got, plain_weights(symbols))), symbols


def test_composition_multiplies_its_parts():
    rng = random.Random(5)
    parts = [tox.window(tox.NEGATION, 3, {tox.INSULT: 0.5}), tox.latch(tox.REPORT, {tox.INSULT: 0.25, tox.THREAT: 3.0}), tox.aimed(3),
             tox.window(tox.TARGET, 2, {tox.THREAT: 2.0})]
    whole = tox.compose(parts)
    for _ in range(300):
        symbols = [rng.choice(tox.SYMBOLS) for _ in range(12)]
        apart = [run(p, symbols) for p in parts]
        assert all(math.isclose(a, math.prod(b)) for a, b in zip(run(whole, symbols), zip(*apart)))


@pytest.fixture(scope="module")
def fitted(spark):
    return tox.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))


@pytest.mark.parametrize("trained", [True, False])
def test_negation_reports_and_threats_decide(spark, fitted, trained):
    model = fitted if trained else tox.Model({}, 0, 0, *tox.UNTRAINED)
    said = []
    for word in tox.INSULTS[:10]:
        said += [(f"you are a {word}", f"you are not a {word}", f"he said you are a {word}"),
                 (f"they are {word}", f"they are never {word}", f"she wrote: they are {word}")]
    said += [(f"I will {w} you", f"I will never {w} you", f"he said, I will {w} you") for w in tox.THREATS[:6]]
    rows = [(i, s, t) for i, group in enumerate(said) for s, t in zip("pnr", group)]
    frame = spark.createDataFrame([(f"{i}{s}", t) for i, s, t in rows], "doc_id string, text string")
    score = {r.doc_id: r.score for r in tox.score(frame, model).collect()}
    for i, group in enumerate(said):
        assert score[f"{i}p"] >= 0.5, group
        assert score[f"{i}n"] < 0.5 and score[f"{i}r"] < 0.5, group
    plain = "a calm day by the river"
    base = tox.score(spark.createDataFrame([(1, plain), (2, ""), (3, None)], "doc_id long, text string"), model).collect()
    assert all(r.score < 0.1 for r in base)


def test_signs_of_the_weights(fitted):
    found = dict(zip(tox.FEATURES, fitted.weights))
    assert all(found[f] >= 0 for f in tox.NEVER_LOWER) and all(found[f] <= 0 for f in tox.NEVER_RAISE)


def test_scores_are_the_logistic_of_the_features(spark, fitted):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    lexicon = tox.Lexicon(fitted.counts, fitted.toxic, fitted.clean)
    want = {r.doc_id: 1 / (1 + math.exp(-(fitted.intercept + sum(w * x for w, x in zip(fitted.weights, lexicon.features(r.text or "")))))) for r in docs.collect()}
    assert all(math.isclose(r.score, want[r.doc_id]) for r in tox.score(docs, fitted).collect())


def test_two_models_in_one_session_keep_their_own_lexicon(spark):
    frame = spark.createDataFrame([(1, "zorgle here")], "doc_id long, text string")
    with_word = tox.Model({"zorgle": (40, 0)}, 50, 50, *tox.UNTRAINED)
    without = tox.Model({"zorgle": (1, 40)}, 50, 50, *tox.UNTRAINED)
    scores = [tox.score(frame, m).first().score for m in (with_word, without, with_word)]
    assert scores[0] == scores[2] > scores[1]

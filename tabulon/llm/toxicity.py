"""Toxicity scores from a weighted finite-state grammar over clauses.

Method: a lexer maps words to symbols (insult, threat, target, negation, reported speech, other);
small weighted transducers over these symbols are composed into one machine, which reads a clause and weighs its insults and
threats, raised by a target nearby.  A second composed machine tells whether a word stands behind a negation or in reported
speech.  So a clause has four outputs: insults said outright, threats said outright, negated and reported ones.  A document's
features are sums over its clauses, not counts of isolated words; a logistic model with sign constraints turns them
into a probability: what is said outright can only raise it, what is negated or reported can only lower it.

The insult lexicon starts from fixed words and grows from labelled rows: words and word
beginnings that are significantly more frequent in toxic documents.  Learning uses a
bounded sample (``TOXIC_ROWS`` and ``CLEAN_ROWS`` labelled documents, chosen by a hash of their id) and a few
sentences made of the fixed words (``lessons``), each outright, negated and reported; every document is scored whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import ahocorasick
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Matrices
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tabulon.llm.common import texts
from tabulon.session import stored

TOXIC_ROWS, CLEAN_ROWS = 3_000, 9_000  # labelled documents the model is fitted on, at most
SIGNIFICANT = 16.0  # likelihood ratio of an entry
CLEAR = 1.4  # lower bound of an entry's log odds
LESSON_SHARE = 0.05  # weight of the made sentences against all labelled rows
BEGINNINGS = range(4, 9)  # letters of a word beginning

# Fixed starting words, in four languages.
INSULTS = ("idiot moron loser stupid worthless pathetic disgusting clown scum trash dumb fool imbecile "
           "dummkopf trottel abschaum widerlich connard crétin abruti ordure idiota imbécil estúpido basura").split()
THREATS = "kill hurt destroy beat stab shoot töten verprügeln tuer frapper matar golpear".split()
TARGETS = "you your he she they him her them du dich ihr euch sie tu toi vous ils elles tú usted ustedes ellos ellas".split()
NEGATIONS = "not no never don't isn't nicht kein keine nie pas jamais nunca jamás tampoco".split()
REPORTS = "said says wrote quoted claimed called reported sagte schrieb dit écrit dijo escribió".split()

WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[.,;:!?\n|]")
BREAKS = frozenset(".,;:!?\n|")
LEADS = frozenset(",:")  # after a word of reporting these lead into what was said
AIM = 2.0  # weight of a target that a threat is followed by
SYMBOLS = INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = range(6)


@dataclass(frozen=True)
class Transducer:
    """States 0..n-1; ``move[state][symbol]`` is the next state, ``weight[state][symbol]`` a factor."""

    move: tuple[tuple[int, ...], ...]
    weight: tuple[tuple[float, ...], ...]


def window(trigger: int, length: int, factors: dict[int, float]) -> Transducer:
    """Within ``length`` symbols after ``trigger``, the given symbols have these factors."""
    move, weight = [], []
    for state in range(length + 1):
        move.append(tuple(length if s == trigger else max(0, state - 1) for s in SYMBOLS))
        weight.append(tuple(factors.get(s, 1.0) if state else 1.0 for s in SYMBOLS))
    return Transducer(tuple(move), tuple(weight))


def latch(trigger: int, factors: dict[int, float]) -> Transducer:
    """From ``trigger`` to the end of the clause, the given symbols have these factors."""
    return Transducer(
        tuple(tuple(1 if s == trigger else state for s in SYMBOLS) for state in range(2)),
        tuple(tuple(factors.get(s, 1.0) if state else 1.0 for s in SYMBOLS) for state in range(2)))


def compose(parts: list[Transducer]) -> Transducer:
    """The product machine: all parts read the same symbols, their factors multiply."""
    states = list(product(*[range(len(p.move)) for p in parts]))
    number = {s: i for i, s in enumerate(states)}
    return Transducer(
        tuple(tuple(number[tuple(p.move[k][s] for p, k in zip(parts, state))] for s in SYMBOLS) for state in states),
        tuple(tuple(math.prod(p.weight[k][s] for p, k in zip(parts, state)) for s in SYMBOLS) for state in states))


def aimed(length: int) -> Transducer:
    """A target counts by itself only within ``length`` symbols after a threat."""
    move, weight = [], []
    for state in range(length + 1):
        move.append(tuple(length if s == THREAT else 0 if s == TARGET else max(0, state - 1) for s in SYMBOLS))
        weight.append(tuple(float(state > 0) if s == TARGET else 1.0 for s in SYMBOLS))
    return Transducer(tuple(move), tuple(weight))


GRAMMAR = compose([
    Transducer(((0,) * 6,), ((1.0, 0.6, 1.0, 0.0, 0.0, 0.0),)),  # only insults, threats (weaker alone) and targets weigh anything
    window(TARGET, 4, {INSULT: 1.3, THREAT: 2.0}),
    aimed(3),
])
# factors 1, 2 and 3: outright, behind a negation, in reported speech (which wins)
SHADES = compose([window(NEGATION, 3, dict.fromkeys((INSULT, THREAT, TARGET), 2.0)), latch(REPORT, dict.fromkeys((INSULT, THREAT, TARGET), 3.0))])
OUTRIGHT, NEGATED, REPORTED = range(3)
FEATURES = ("outright", "highest", "clauses", "targeted", "density", "threats", "negated", "reported")
NEVER_LOWER, NEVER_RAISE = FEATURES[:6], FEATURES[6:]
UNTRAINED = ([1.0, 0.2, 0.3, 0.3, 0.1, 2.0, -0.5, -0.5], -3.0)


class Lexicon:
    """Entries with their counts in toxic and clean sample documents; gives symbols and weights of words."""

    def __init__(self, counts: dict[str, tuple[int, int]], toxic: int, clean: int):
        self.counts, self.toxic, self.clean = counts, toxic, clean
        self.plain = {}
        for symbol, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            self.plain.update(dict.fromkeys(words, symbol))
        self.seeds = frozenset(INSULTS) | frozenset(THREATS)
        self.entries = set(counts) | self.seeds
        self.weights = [self._weights(own) for own in (None, 0, 1)]
        self.finder = ahocorasick.Automaton()
        for entry in self.entries:
            stem = entry.rstrip("*")
            self.finder.add_word(stem, (len(stem), *((old[1], old[2]) if (old := self.finder.get(stem, None)) else (False, False))))
            n, whole, begins = self.finder.get(stem)
            self.finder.add_word(stem, (n, whole or entry == stem, begins or entry != stem))
        self.finder.make_automaton()

    def _weights(self, own: int | None) -> dict[str, float]:
        """Weight per entry; ``own`` is the label of a sample document that is not to count itself."""
        found = {}
        n1, n0 = max(1, self.toxic - (own == 1)), max(1, self.clean - (own == 0))
        for entry in self.entries:
            a, b = self.counts.get(entry, (0, 0))
            a, b = max(0, a - (own == 1)), max(0, b - (own == 0))
            seed = entry in self.seeds
            if not seed and likelihood_ratio(a, b, n1, n0) < SIGNIFICANT:
                continue
            a += 3 if seed else 0
            odds = math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))
            low = odds - math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
            if seed and not self.counts:
                low = 3.0
            if low > CLEAR:
                found[entry] = min(low, 6.0)
        return found

    def touches(self, low: str) -> bool:
        """Whether any entry occurs in the lower-case text as a word or a word's beginning."""
        for end, (n, whole, begins) in self.finder.iter(low):
            first = end - n + 1
            if first and (low[first - 1].isalnum()):
                continue
            inside = end + 1 < len(low) and low[end + 1].isalnum()
            if begins if inside else whole:
                return True
        return False

    def features(self, text: str, own: int | None = None) -> list[float]:
        """The ``FEATURES`` of a whole text; an entry counts once per clause and kind."""
        low = text.lower()
        if not self.touches(low):
            return [0.0] * len(FEATURES)
        weights, entries, plain = self.weights[0 if own is None else own + 1], self.entries, self.plain
        total = highest = targeted = threats = 0.0
        shielded = [0.0, 0.0, 0.0]
        clauses = n_words = 0
        move, weight, shift, shades = GRAMMAR.move, GRAMMAR.weight, SHADES.move, SHADES.weight
        state, shade, clause, target, said, told = 0, 0, 0.0, False, set(), 9
        for word in [*WORD.findall(low), "."]:
            if word in BREAKS:
                if word in LEADS and told <= 2:
                    continue
                if clause > 0:
                    total += clause
                    clauses += 1
                    highest = max(highest, clause)
                    targeted += clause if target else 0.0
                state, shade, clause, target, said, told = 0, 0, 0.0, False, set(), 9
                continue
            n_words += 1
            symbol, value = plain.get(word, OTHER), 0.0
            if word in entries:
                value = weights.get(word, 0.0)
            best = word
            for k in BEGINNINGS:
                if k >= len(word):
                    break
                begin = word[:k] + "*"
                if begin in entries and weights.get(begin, 0.0) > value:
                    value, best = weights[begin], begin
            if symbol == OTHER and value > 0:
                symbol = INSULT
            elif symbol == TARGET:
                value, best = AIM, "target"
            if symbol <= TARGET and value > 0:
                value *= weight[state][symbol]
                factor = shades[shade][symbol]
                kind = REPORTED if factor >= 3 else NEGATED if factor == 2 else OUTRIGHT
                if value > 0 and (kind, best) not in said:
                    said.add((kind, best))
                    if kind != OUTRIGHT:
                        shielded[kind] += value
                    elif symbol == INSULT:
                        clause += value
                    else:
                        threats += value
            target = target or symbol == TARGET
            told = 0 if symbol == REPORT else told + 1
            state, shade = move[state][symbol], shift[shade][symbol]
        return [math.log1p(total), highest, math.log1p(clauses), math.log1p(targeted), total / math.sqrt(1 + n_words),
                math.log1p(threats), math.log1p(shielded[NEGATED]), math.log1p(shielded[REPORTED])]


def likelihood_ratio(a: int, b: int, n1: int, n0: int) -> float:
    """Signed likelihood ratio of a of n1 against b of n0; positive where a's rate is higher."""
    if a * n0 <= b * n1:
        return 0.0
    rate = (a + b) / (n1 + n0)
    g = sum(x * math.log(x / (n * rate)) for x, n in ((a, n1), (b, n0)) if x)
    g += sum((n - x) * math.log((n - x) / (n * (1 - rate))) for x, n in ((a, n1), (b, n0)) if x < n and rate < 1)
    return 2 * g


@dataclass
class Model:
    counts: dict[str, tuple[int, int]]
    toxic: int
    clean: int
    weights: list[float]
    intercept: float


_lexicons: dict[int, tuple[Model, Lexicon]] = {}


def lexicon_of(model: Model) -> Lexicon:
    """The worker's lexicon for a model; the last one is kept."""
    key = hash((model.toxic, model.clean, frozenset(model.counts.items())))
    if key not in _lexicons:
        _lexicons.clear()
        _lexicons[key] = (model, Lexicon(model.counts, model.toxic, model.clean))
    return _lexicons[key][1]


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def _entries(text: str) -> set[str]:
    words = {w for w in WORD.findall(text.lower()) if len(w) > 2}
    return words | {w[:k] + "*" for w in words for k in BEGINNINGS if k < len(w)}


def _count(rows: DataFrame, wanted: frozenset[str] | None) -> DataFrame:
    """Sample documents per entry (of those wanted), summed inside each task first."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                entries = _entries(text)
                found.update(entries if wanted is None else entries & wanted)
        if found:
            yield pd.DataFrame({"entry": list(found), "n": list(found.values())})

    return rows.select("text").mapInPandas(run, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))


def lessons() -> list[tuple[str, int]]:
    """Sentences of the fixed words: outright (1), negated and reported (0)."""
    out = []
    for word in INSULTS:
        out += [(f"you are such a {word}", 1), (f"you are not {word}", 0), (f"he said you are a {word}", 0), (f"they wrote: {word}", 0)]
    for word in THREATS:
        out += [(f"I will {word} you", 1), (f"we will {word} them", 1), (f"I never {word} you", 0), (f"she said, I will {word} you", 0), (f"they {word} time", 0)]
    return out


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn lexicon and calibration from labelled rows that are not held out.

    Several labels of a document count as the highest; without both classes the fixed
    words and a fixed calibration are used.  Labels and ids are never features.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    known = stored(known.withColumn("order", F.xxhash64("doc_id")))
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = known.where("toxic = 1").orderBy("order").limit(TOXIC_ROWS).union(
        known.where("toxic = 0").orderBy("order").limit(CLEAN_ROWS)).select("doc_id", "toxic")
    sample = stored(texts(docs).join(chosen, "doc_id").select("text", "toxic").repartition(12))
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Model({}, toxic, clean, *UNTRAINED)
    # what only one document says tells nothing about others
    in_toxic = {r["entry"]: r["n"] for r in _count(sample.where("toxic = 1"), None).where(F.col("n") > 1).collect()}
    in_clean = {r["entry"]: r["n"] for r in _count(sample.where("toxic = 0"), frozenset(in_toxic)).collect()}
    counts = {e: (n, in_clean.get(e, 0)) for e, n in in_toxic.items() if likelihood_ratio(n, in_clean.get(e, 0), toxic, clean) >= SIGNIFICANT / 2}
    counts |= {w: (in_toxic.get(w, 0), in_clean.get(w, 0)) for w in (*INSULTS, *THREATS)}
    draft = Model(counts, toxic, clean, [], 0.0)

    @pandas_udf("array<double>")
    def measure(text: pd.Series, label: pd.Series) -> pd.Series:
        lexicon = lexicon_of(draft)
        return pd.Series([lexicon.features(t, int(y)) for t, y in zip(text, label)])

    share = {1: totals.get(1, 1) / toxic, 0: totals.get(0, 1) / clean}
    measured = sample.select(measure("text", "toxic").alias("x"), F.col("toxic").cast("double").alias("label"), F.when(
        F.col("toxic") == 1, share[1]).otherwise(share[0]).alias("weight"))
    taught = [(lexicon_of(draft).features(text), float(label)) for text, label in lessons()]
    each = LESSON_SHARE * (totals.get(1, 1) + totals.get(0, 1)) / len(taught)
    extra = docs.sparkSession.createDataFrame([(x, y, each) for x, y in taught], "x array<double>, label double, weight double")
    ready = stored(measured.union(extra)).withColumn("features", array_to_vector("x"))
    bound = float("inf")
    learned = LogisticRegression(
        weightCol="weight", maxIter=100, lowerBoundsOnCoefficients=Matrices.dense(1, len(FEATURES), [
            0.0 if f in NEVER_LOWER else -bound for f in FEATURES]),
        upperBoundsOnCoefficients=Matrices.dense(1, len(FEATURES), [0.0 if f in NEVER_RAISE else bound for f in FEATURES]),
    ).setRegParam(1e-3).fit(ready)
    return Model(counts, toxic, clean, [float(w) for w in learned.coefficients], float(learned.intercept))


def score_column(model: Model):
    """A column function: toxicity between 0 and 1 of a text (null: empty)."""
    @pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        lexicon = lexicon_of(model)
        out = []
        for t in text:
            z = model.intercept + sum(w * x for w, x in zip(model.weights, lexicon.features(t or "")))
            out.append(1 / (1 + math.exp(-max(-500.0, min(500.0, z)))))
        return pd.Series(out, dtype="float64")

    return score


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted): a row per input row; rows without an id count as not held out."""
    scored = texts(docs).withColumn("score", score_column(model)("text"))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that score below one half, all columns kept."""
    return docs.where(score_column(model)(F.coalesce("text", F.lit(""))) < 0.5)

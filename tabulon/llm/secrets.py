"""Secret scans: fixed patterns, and a linear-chain conditional random field for what they miss.

Method: tokens are tagged as begin, inside or outside of a secret.  Features are a token's shape, its
neighbouring words and features of the file; Viterbi decodes the best tags.  The field is
trained here, by its exact gradient, on a bounded sample of documents (``SAMPLE_ROWS``, chosen by a hash)
whose pattern matches are the labels.  So that it learns more than the patterns, every match also gives cases
made from it (``variants``): another key, another sign, a shorter or differently spelled value, no known prefix, no key at all;
and every sampled line may give one in which a key stands before an ordinary word, which is no secret.  Every token with a letter or digit may be tagged if its line has a key word
or an assignment sign, or if its shape is mixed (letters with digits, or a capital after a small letter) or a number of ten
signs or more; whatever its length, shape and neighbours decide.  What the patterns leave open (short values of their keys, values of other
keys) is no label and left out of the training.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tabulon.llm.common import texts
from tabulon.session import stored

SAMPLE_ROWS = 6_000
CONTEXT = 3  # tokens of a stretch on each side of a candidate
CASES = 1_000  # training cases with a secret at most; as many lines as they are, and as many with a key before a word, stand beside them
CHUNK = 40  # tokens of one training case; longer stretches are cut
ROUNDS = 80
MASK = "[SECRET]"

# Fixed patterns of the three base kinds, with the least length of the secret part.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run is maximal, so short runs need no match of their own
KINDS = ("assign", "access", "hex", "crf")

HINTS = ("pass", "secret", "token", "api")  # one of them is in every assign key
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]+|[^\sA-Za-z0-9+/_.=-]")
MIXED = re.compile(r"[A-Za-z][+/_.=-]*[0-9]|[0-9][+/_.=-]*[A-Za-z]|[a-z][A-Z]|(?=[+/_.=-]*[0-9])[0-9+/_.=-]{10,}")
LINE = re.compile(r"[^\n]+")
HEX_CLASS = bytes(104 if chr(c) in "0123456789abcdef" else 32 for c in range(256))
KEY_STEMS = re.compile(r"(?i)pass(?:w|ph|code|$)|_pass|pwd|secret|token|api_?key|(?:^|_)key$|auth|credential|bearer")
# keys, signs and letters of the cases that are made from real matches
OTHER_KEYS = "pwd passphrase db_pass auth credential client_secret access_key private_key bearer user_token password passwd secret token api_key".split()
SIGNS = (" = ", ": ", "=", " : ", ' = "', ": '", " ")
LETTERS = ("abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefABCDEFghijkLMNOPQRSTuvwxyz0123456789",
           "abcdefghijkLMNOPQRSTUVWXYZlmnopqrstuvwxyzABCDEFGHIJK", "0123456789abcdef")
NEARBY = 120  # characters kept around a match in such a case
KEYED = re.compile(r"[=:]|(?i:passw|pwd|secret|token|api_?key|auth|credential|bearer|\bkey\b)", re.ASCII)
PLAIN_WORD = re.compile(r"(?<![^\s])[a-z]{3,12}(?![^\s.,])")
OPEN_KEY = re.compile(r"""(?i:auth|pwd|key|credential|bearer)["']?\x20*[:=]""", re.ASCII)
BEGIN, INSIDE, OUTSIDE = range(3)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in code points, by start and kind."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    if b"h" * 16 in text.encode("ascii", "replace").translate(HEX_CLASS):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def label_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of the secret parts of the fixed patterns: an assigned value without its key."""
    out = [(a, b) for a, kind, b in base_spans(text) if kind]
    return sorted(out + [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 12])


def _undecided(line: str) -> bool:
    """Whether the patterns say nothing on a value of this line."""
    return OPEN_KEY.search(line) is not None or any(len(m[2]) < 12 for m in ASSIGN.finditer(line))


@lru_cache(100_000)
def _shape(token: str) -> tuple[str, ...]:
    """Shape features of a token."""
    digits = sum(c.isdigit() for c in token)
    upper = sum("A" <= c <= "Z" for c in token)
    lower = sum("a" <= c <= "z" for c in token)
    signs = len(token) - digits - upper - lower
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:]))
    cases = sum(a.islower() != b.islower() for a, b in zip(token, token[1:]) if a.isalpha() and b.isalpha())
    key, sign, value = token.lower().partition("=")
    return (
        f"len{min(len(token) // 4, 6)}", f"cases{min(cases // 2, 4)}", f"own{value != '' and KEY_STEMS.search(key) is not None:d}", f"kinds{digits > 0:d}{upper > 0:d}{lower > 0:d}{signs > 0:d}",
        f"digits{10 * digits // len(token)}", f"upper{4 * upper // len(token)}", f"changes{min(changes // 2, 6)}",
        f"dots{min(token.count('.'), 3)}", f"head{token[:4] if token[:4].isupper() else ''}")


@lru_cache(100_000)
def _word(token: str) -> str:
    """A neighbouring token as a feature: signs by themselves, key words and others by their class."""
    if KEY_STEMS.search(token):
        return "KEY"
    if len(token) == 1 and not token.isalnum():
        return token
    return "digits" if token.isdigit() else "name" if token.isalpha() else "mixed"


def file_features(text: str) -> list[str]:
    """Features of the whole text: how much it looks like settings or code."""
    n = max(1, len(text))
    return [f"equals{min(1000 * text.count('=') // n, 5)}", f"lines{min(200 * text.count(chr(10)) // n, 5)}"]


def _mixed(token: str) -> bool:
    return MIXED.search(token) is not None


def variants(text: str, rng: random.Random, keys: Sequence[str] = tuple(OTHER_KEYS)) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Pieces of the text around its pattern matches, changed: (piece, spans of its secrets).

    Each match gives one piece with another key and a value of 8 to 24 characters, and one with no key or prefix around a value of 16 or
    more; other matches in reach stay and are secrets too.
    """
    keyed = {m.span(2): m.start() for m in ASSIGN.finditer(text) if len(m[2]) >= 12}
    for a, b in sorted(set(label_spans(text))):
        value = text[a:b]
        begin = keyed.get((a, b), a)
        left = text[max(0, begin - NEARBY):begin].rpartition("\n")[2]
        right = text[b:b + NEARBY].partition("\n")[0].lstrip("\"'")
        for named in (True, False):
            letters = rng.choice(LETTERS)
            made = "".join(rng.choice(letters) for _ in range(rng.randint(8, 24) if named else rng.randint(16, max(17, len(value)))))
            if named and rng.random() < 0.3:
                made = value[-rng.randint(8, 11):]
            if not any(c.isdigit() for c in made) and (len(made) < 14 or letters != LETTERS[3]):
                made = made[:-2] + str(rng.randint(10, 99))
            sign = rng.choice(SIGNS)
            key = rng.choice(keys)
            front = (key.capitalize() if rng.random() < 0.3 else key) + sign if named else ""
            close = sign[-1] if sign[-1] in "\"'" and named else ""
            start = len(left) + len(front)
            after = close if right[:1] in ("", " ") else close + " "
            past = start + len(made) + len(after)
            yield left + front + made + after + right, [
                *label_spans(left), (start, start + len(made)), *[(s + past, e + past) for s, e in label_spans(right)]]


def harmless(text: str, rng: random.Random, keys: Sequence[str] = tuple(OTHER_KEYS)) -> Iterator[str]:
    """A piece of the text in which a key stands before one of its ordinary words."""
    words = list(PLAIN_WORD.finditer(text[:4 * NEARBY]))
    if words:
        word = rng.choice(words)
        left, right = text[max(0, word.start() - NEARBY):word.start()].rpartition("\n")[2], text[word.start():word.end() + NEARBY].partition("\n")[0]
        if not label_spans(left) and not label_spans(right):
            yield left + rng.choice(keys) + rng.choice((" = ", ": ", "=", " ", " of the ", " is ")) + right


def stretches(text: str, about: tuple[str, ...] | None = None) -> Iterator[tuple[list[tuple[int, int]], list[tuple[str, ...]], list[bool]]]:
    """Token spans, their features and whether each may be part of a secret: whole lines with a key
    word or an assignment sign, and the tokens about those of mixed shape in other lines.  ``about`` are the features of the file."""
    for line in LINE.finditer(text):
        keyed = KEYED.search(line[0]) is not None
        if not keyed and MIXED.search(line[0]) is None:
            continue
        spans = [(m.start() + line.start(), m.end() + line.start()) for m in TOKEN.finditer(line[0])]
        tokens = [text[a:b] for a, b in spans]
        if keyed:
            allowed = [any(map(str.isalnum, t)) and t.isascii() for t in tokens]
            parts = [(0, len(tokens))]
        else:
            allowed = [_mixed(t) for t in tokens]
            parts = []
            for i in (i for i, may in enumerate(allowed) if may):
                left, right = max(0, i - CONTEXT), min(len(tokens), i + CONTEXT + 1)
                if parts and left <= parts[-1][1]:
                    parts[-1] = (parts[-1][0], right)
                else:
                    parts.append((left, right))
        if parts and about is None:
            about = tuple(file_features(text))
        words = ["edge"] * 3 + [_word(t) for t in tokens] + ["edge"] * 2
        for left, right in parts:
            features = []
            for i in range(left, right):
                shape = _shape(tokens[i]) if allowed[i] else ("plain",)
                features.append(("all", *shape, "-3:" + words[i], "-2:" + words[i + 1], "-1:" + words[i + 2],
                                 "1:" + words[i + 4], "2:" + words[i + 5], *about))
            yield spans[left:right], features, allowed[left:right]


class Field:
    """The conditional random field: weights per feature and tag, and per pair of tags."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.names, self.weights, self.moves = names, weights, moves
        self.known: dict[tuple[str, ...], tuple[float, ...]] = {}

    def scores(self, features: list[tuple[str, ...]], allowed: list[bool]) -> list[tuple[float, ...]]:
        """Score of each tag at each token; equal features are summed up once."""
        out = []
        for fs, may in zip(features, allowed):
            if not may:
                fs = ("", *fs)
            score = self.known.get(fs)
            if score is None:
                if len(self.known) >= 200_000:
                    self.known.clear()
                value = self.weights[[self.names.get(f, 0) for f in fs]].sum(axis=0)
                if not may:
                    value[:OUTSIDE] = -1e9
                score = self.known[fs] = tuple(value.tolist())
            out.append(score)
        return out

    def decode(self, features: list[tuple[str, ...]], allowed: list[bool]) -> list[int]:
        """Viterbi: the tags with the highest total score."""
        score, moves, back = self.scores(features, allowed), self.moves.tolist(), []
        best = [score[0][0], score[0][1] - 1e9, score[0][2]]
        for row in score[1:]:
            step, now = [], []
            for tag in range(3):
                x, y, z = best[0] + moves[0][tag], best[1] + moves[1][tag], best[2] + moves[2][tag]
                top = 0 if x >= y and x >= z else 1 if y >= z else 2
                step.append(top)
                now.append((x, y, z)[top] + row[tag])
            back.append(step)
            best = now
        tags = [max(range(3), key=best.__getitem__)]
        for step in reversed(back):
            tags.append(step[tags[-1]])
        return tags[::-1]

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Spans of a whole text that are tagged as secrets."""
        out = []
        for places, features, allowed in stretches(text):
            tags = self.decode(features, allowed)
            for (a, b), tag in zip(places, tags):
                if tag == BEGIN:
                    out.append((a, b))
                elif tag == INSIDE and out:
                    out[-1] = (out[-1][0], b)
        return out


def likelihood(weights: np.ndarray, moves: np.ndarray, index: np.ndarray, mask: np.ndarray, barred: np.ndarray,
               gold: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of the gold tags over all cases, with its gradient by ``weights`` and ``moves``.

    ``index`` has the features of each token (0: none), ``mask`` the tokens there are, ``barred`` those that must be outside, ``gold`` their tags, one-hot.
    """
    length, width = index.shape[1:]
    start = np.array([0.0, -1e9, 0.0])
    score = weights[index].sum(axis=2)
    score[barred, :OUTSIDE] = -1e9
    ahead, behind = np.zeros_like(score), np.zeros_like(score)
    ahead[:, 0] = score[:, 0] + start
    for t in range(1, length):
        ahead[:, t] = np.where(mask[:, t, None], np.logaddexp.reduce(ahead[:, t - 1, :, None] + moves, axis=1) + score[:, t], ahead[:, t - 1])
    for t in range(length - 2, -1, -1):
        behind[:, t] = np.where(mask[:, t + 1, None], np.logaddexp.reduce(moves + (score[:, t + 1] + behind[:, t + 1])[:, None], axis=2), 0.0)
    total = np.logaddexp.reduce(ahead[:, -1], axis=1)
    chance = np.exp(ahead + behind - total[:, None, None]) * mask[..., None]
    pairs = np.exp(ahead[:, :-1, :, None] + moves + (score[:, 1:] + behind[:, 1:])[:, :, None] - total[:, None, None, None])
    gold_moves = np.einsum("ntj,ntk->jk", gold[:, :-1], gold[:, 1:])
    change = gold_moves - (pairs * mask[:, 1:, None, None]).sum(axis=(0, 1))
    gradient = np.zeros_like(weights)
    for w in range(width):
        np.add.at(gradient, index[..., w], gold - chance)
    gradient[0] = 0
    value = (gold * np.where(gold > 0, score + (np.arange(length) == 0)[:, None] * start, 0.0)).sum() + (gold_moves * moves)[gold_moves > 0].sum() - total.sum()
    return float(value), gradient, change


def train(cases: list[tuple[list[list[str]], list[bool], list[int]]], rounds: int = ROUNDS) -> Field:
    """Fit a field to (features, allowed, tags) by its exact log-likelihood gradient, all cases at once."""
    names: dict[str, int] = {"": 0}
    for features, _, _ in cases:
        for fs in features:
            for f in fs:
                names.setdefault(f, len(names))
    n, length = len(cases), max(len(c[1]) for c in cases)
    width = max(len(fs) for c in cases for fs in c[0])
    index = np.zeros((n, length, width), np.int32)
    mask, barred = np.zeros((n, length), bool), np.zeros((n, length), bool)
    tags = np.full((n, length), OUTSIDE)
    for i, (features, allowed, gold) in enumerate(cases):
        for t, fs in enumerate(features):
            index[i, t, :len(fs)] = [names[f] for f in fs]
        mask[i, :len(gold)], tags[i, :len(gold)] = True, gold
        barred[i, :len(gold)] = ~np.array(allowed)
    barred |= ~mask
    weights, moves = np.zeros((len(names), 3)), np.zeros((3, 3))
    moves[OUTSIDE, INSIDE] = -1e9  # a secret starts with its begin
    gold = np.eye(3)[tags] * mask[..., None]
    steps = [(np.zeros_like(weights), np.zeros_like(weights)), (np.zeros_like(moves), np.zeros_like(moves))]
    for r in range(1, rounds + 1):
        _, gradient, change = likelihood(weights, moves, index, mask, barred, gold)
        gradient = gradient / n - 1e-4 * weights
        change = change / n - 1e-4 * np.where(moves < -1e8, 0, moves)
        change[OUTSIDE, INSIDE] = 0
        for values, g, (m, v) in ((weights, gradient, steps[0]), (moves, change, steps[1])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            values += 0.2 * (m / (1 - 0.9 ** r)) / (np.sqrt(v / (1 - 0.99 ** r)) + 1e-8)
    return Field(names, weights, moves)


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Field | None:
    """A field trained on at most ``rows`` documents; ``None`` where the sample has no secret.

    The sample keeps stretches with a label and, of the others, twice as many.  Repeated rows are drawn one by one.
    """
    chosen = texts(docs).withColumn("order", F.xxhash64("text", "doc_id", F.monotonically_increasing_id()))
    picked = chosen.select("order").orderBy("order").limit(rows).agg(F.max("order")).first()[0]
    if picked is None:
        return None

    def cases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                rng = random.Random(zlib.crc32(text.encode()))
                about = tuple(file_features(text))
                given = [(text, label_spans(text), True)] + [(*v, False) for v in variants(text, rng)] + [(v, [], False) for v in harmless(text, rng)]
                for piece, secret, real in given:
                    for places, features, allowed in stretches(piece, about):
                        if real and _undecided(piece[piece.rfind("\n", 0, places[0][0]) + 1:places[-1][1]]):
                            continue
                        tags, open_span = [], None
                        for (a, b), may in zip(places, allowed):
                            span = next((s for s in secret if s[0] < b and a < s[1]), None) if may else None
                            tags.append(OUTSIDE if span is None else INSIDE if span == open_span else BEGIN)
                            open_span = span
                        for k in range(0, len(tags), CHUNK):
                            part = slice(k, k + CHUNK)
                            if tags[k] != INSIDE:
                                out.append(("\x1e".join("\x1f".join(fs) for fs in features[part]), allowed[part], tags[part],
                                            any(t != OUTSIDE for t in tags[part]), real))
            if out:
                yield pd.DataFrame(out, columns=["features", "allowed", "tags", "positive", "real"])

    found = chosen.where(F.col("order") <= picked).mapInPandas(
        cases, "features string, allowed array<boolean>, tags array<int>, positive boolean, real boolean")
    # equal stretches teach nothing new; the bound on rows bounds what comes here
    table = stored(found.distinct())
    positive = table.where("positive").orderBy(F.xxhash64("features")).limit(CASES).collect()
    if not positive:
        return None
    negative = []
    for real in ("real", "not real"):  # lines as they are, and lines with a key before a word
        negative += table.where(f"not positive and {real}").orderBy(F.xxhash64("features")).limit(max(500, len(positive))).collect()
    return train([([fs.split("\x1f") for fs in r["features"].split("\x1e")], list(r["allowed"]), list(r["tags"])) for r in positive + negative])


def all_spans(text: str, field: Field | None) -> list[tuple[int, int, int]]:
    """Base spans, and those of the field that touch none of them, by start and kind."""
    base = base_spans(text)
    if field is None:
        return base
    extra = [(a, 3, b) for a, b in field.spans(text) if not any(s < b and a < e for s, _, e in base)]
    return sorted(base + extra)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, field: Field | None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) per document; null and empty texts have no spans."""
    schema = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

    @pandas_udf(schema)
    def find(text: pd.Series) -> pd.DataFrame:
        rows = []
        for t in text:
            spans = all_spans(t, field)
            base = [s for s in spans if s[1] < 3]
            rows.append((*(sum(s[1] == k for s in base) for k in range(3)), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return texts(docs).select("doc_id", find("text").alias("found")).select("doc_id", "found.*")


def masked(docs: DataFrame, field: Field | None) -> DataFrame:
    """The documents with each secret replaced by ``MASK`` and ``n_chars`` counted anew; a null text stays null."""
    @pandas_udf("string")
    def mask(text: pd.Series) -> pd.Series:
        out = []
        for t in text:
            if t is None:
                out.append(None)
                continue
            parts, at = [], 0
            for a, _, b in all_spans(t, field):
                if a >= at:
                    parts += [t[at:a], MASK]
                at = max(at, b)
            out.append("".join([*parts, t[at:]]))
        return pd.Series(out, dtype=object)

    return docs.withColumn("text", mask("text")).withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long"))

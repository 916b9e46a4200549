"""The field of the secret scan: likelihood and decoding against enumeration, recall on cases it was not trained on."""

from __future__ import annotations

import random
from itertools import product

import numpy as np

from tabulon.llm import secrets

SF = "/root/testdata/sf0.01"


def tiny(rng, n=3, length=4, names=6, width=2):
    index = rng.integers(0, names, (n, length, width))
    sizes = rng.integers(1, length + 1, n)
    mask = np.arange(length)[None, :] < sizes[:, None]
    index[~mask] = 0
    barred = (rng.random((n, length)) < 0.2) | ~mask
    weights, moves = rng.normal(size=(names, 3)), rng.normal(size=(3, 3))
    weights[0] = 0
    moves[secrets.OUTSIDE, secrets.INSIDE] = -1e9
    return weights, moves, index, mask, barred, sizes


def path_score(weights, moves, index, barred, tags):
    total = 0.0
    for t, tag in enumerate(tags):
        if tag != secrets.OUTSIDE and barred[t] or t == 0 and tag == secrets.INSIDE:
            return -np.inf
        total += weights[index[t], tag].sum() + (moves[tags[t - 1], tag] if t else 0.0)
    return total if total > -1e8 else -np.inf


def test_likelihood_and_gradient_equal_enumeration():
    rng = np.random.default_rng(3)
    for _ in range(5):
        weights, moves, index, mask, barred, sizes = tiny(rng)
        paths = []
        for i, n in enumerate(sizes):
            allowed = [p for p in product(range(3), repeat=n) if path_score(weights, moves, index[i], barred[i], p) > -np.inf]
            paths.append(allowed[rng.integers(len(allowed))])
        tags = np.full(mask.shape, secrets.OUTSIDE)
        for i, p in enumerate(paths):
            tags[i, :len(p)] = p
        gold = np.eye(3)[tags] * mask[..., None]

        def value(w, m):
            out = 0.0
            for i, p in enumerate(paths):
                every = [path_score(w, m, index[i], barred[i], q) for q in product(range(3), repeat=len(p))]
                out += path_score(w, m, index[i], barred[i], p) - np.logaddexp.reduce(every)
            return out

        got, gradient, change = secrets.likelihood(weights, moves, index, mask, barred, gold)
        assert np.isclose(got, value(weights, moves))
        for (array, found, skip) in ((weights, gradient, None), (moves, change, (secrets.OUTSIDE, secrets.INSIDE))):
            for at in np.ndindex(array.shape):
                if at == skip or array is weights and at[0] == 0:
                    continue
                old = array[at]
                array[at] = old + 1e-5
                up = value(weights, moves)
                array[at] = old - 1e-5
                down = value(weights, moves)
                array[at] = old
                assert np.isclose(found[at], (up - down) / 2e-5, atol=1e-4)


def test_decoding_equals_enumeration():
    rng = np.random.default_rng(9)
    names = {f"f{i}": i for i in range(1, 6)} | {"": 0}
    for _ in range(30):
        weights, moves, index, mask, barred, sizes = tiny(rng, n=1, length=5)
        n = int(sizes[0])
        field = secrets.Field(names, weights, moves)
        features = [tuple(f"f{k}" if k else "" for k in index[0, t]) for t in range(n)]
        tags = field.decode(features, [not b for b in barred[0, :n]])
        best = max(path_score(weights, moves, index[0], barred[0], p) for p in product(range(3), repeat=n))
        assert np.isclose(path_score(weights, moves, index[0], barred[0], tags), best)


def test_secrets_beyond_the_patterns(spark):
    """Held-out cases with keys and values that no training case had, and prose that stays clean."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    train, rest = docs.where("doc_id % 2 = 0"), [r.text for r in docs.where("doc_id % 2 = 1").collect()]
    field = secrets.fit(train)
    rng = random.Random(77)
    hit = total = 0
    for text in rest:
        for piece, spans in secrets.variants(text, rng, ("passcode", "conn_pwd", "svc_token", "authorization", "signing_key", "client_auth")):
            found = secrets.all_spans(piece, field)
            for a, b in spans:
                total += 1
                hit += any(s < b and a < e for s, _, e in found)
    assert total > 20 and hit / total >= 0.9
    tagged = harmless = 0
    for text in rest:
        for piece in secrets.harmless(text, rng, ("passcode", "conn_pwd", "svc_token", "signing_key")):
            harmless += 1
            tagged += any(k == 3 for _, k, _ in secrets.all_spans(piece, field))
    assert harmless > 100 and tagged / harmless <= 0.05
    clean = [t for t in rest if not secrets.base_spans(t)]
    assert sum(any(k == 3 for _, k, _ in secrets.all_spans(t, field)) for t in clean) <= 0.02 * len(clean)
    for line in ("pwd=Zx9qkQ2mB7", "db_pass: S3cr3tValu3X9", "Authorization: Bearer abcDEF123456ghiJKL789", "passwd = hunter2pw"):
        assert secrets.all_spans("please set " + line + " in the file", field), line

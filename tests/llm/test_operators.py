"""Each operator against a brute-force version on the awkward corpus, and on an empty table."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from tabulon.llm import decontam, imatch, licenses, packing, repeats, secrets, sharding, simhash, suffix_array, token_counts, tokens, toxicity

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash(docs, rows, nothing):
    got = {(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    groups = [{k} for k in range(len(prints))]
    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a][1] ^ prints[b][1]).count("1") <= 2 and groups[a] is not groups[b]:
                groups[a] |= groups[b]
                for k in groups[b]:
                    groups[k] = groups[a]
    want = {(i, f, min((prints[k][0] for k in groups[n] if prints[k][0] is not None), default=None)) for n, (i, f) in enumerate(prints)}
    assert got == want
    assert simhash.near_duplicates(nothing).count() == 0
    more = docs.withColumn("__first", docs.rank)  # a clashing name
    kept = simhash.one_per_group(more)
    assert kept.columns == more.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in want if c is not None} | {None}


@pytest.mark.parametrize("radius,bucket", [(0, 256), (1, 256), (2, 256), (2, 3), (3, 256), (3, 2), (4, 5)])
def test_links_are_all_pairs_within_the_radius(spark, radius, bucket, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", bucket)  # small: frequent values are cut by further indexes
    rng = np.random.default_rng(radius)
    values = set(map(int, rng.integers(-2**63, 2**63 - 1, 40)))
    for base in list(values)[:3]:
        for _ in range(60):
            near = base
            for bit in rng.integers(0, 64, rng.integers(1, 5)).tolist():
                near ^= (1 << bit) - (1 << 64 if bit == 63 else 0)
            values.add(near)
    prints = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {frozenset(r) for r in simhash.links(prints, radius).collect()}
    ones = {v: v & (2**64 - 1) for v in values}
    assert got == {frozenset((a, b)) for a in values for b in values if a < b and bin(ones[a] ^ ones[b]).count("1") <= radius}


@pytest.mark.parametrize("letters,size", [(1, 9), (2, 60), (4, 200), (900, 2000)])
def test_suffix_array(letters, size):
    rng = np.random.default_rng(letters)
    s = np.append(rng.integers(1, letters + 1, size), 0)
    order = suffix_array.suffix_array(s)
    assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    shared = suffix_array.common_prefixes(s, order, len(s) - np.arange(len(s)))
    for a, b in zip(order, order[1:]):
        n = 0
        while max(a, b) + n < len(s) and s[a + n] == s[b + n]:
            n += 1
        assert shared[b] == n


def plain_repeats(rows):
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(x[k:k + 200] for _, x in raws for k in range(len(x) - 199))
    out = []
    for i, x in raws:
        gone = np.zeros(len(x), bool)
        for k in range(len(x) - 199):
            if seen[x[k:k + 200]] > 1:
                gone[k:k + 200] = True
        runs = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out.append((i, len(x), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(x, np.uint8)[~gone])).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("many", [repeats.MANY, 0])  # 0: every anchor takes the path of frequent ones
def test_repeats(docs, rows, nothing, many, monkeypatch):
    monkeypatch.setattr(repeats, "MANY", many)
    got = Counter(tuple(r) for r in repeats.remove_repeats(docs).collect())
    assert got == plain_repeats(rows)
    if many:
        assert repeats.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("many", [repeats.MANY, 0])
def test_repeats_around_frequent_and_periodic_anchors(spark, many, monkeypatch):
    monkeypatch.setattr(repeats, "MANY", many)
    rng = np.random.default_rng(11)

    def noise(n):
        return "".join(rng.choice(list("abcdefgh"), n))

    passage, period = noise(230), noise(37)
    rows = [(i, noise(int(rng.integers(0, 300))) + passage[k:] + noise(50)) for i, k in enumerate([0, 0, 20, 31, 40])]
    rows += [(10, "=" * 420), (11, "-" * 199 + "="), (12, period * 12), (13, noise(30) + period * 6), (14, rows[0][1][5:250])]
    got = Counter(tuple(r) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == plain_repeats(rows)


def test_each_start_has_one_anchor():
    rng = np.random.default_rng(7)
    width = repeats.LENGTH - repeats.GRAM + 1
    for raw in (bytes(rng.integers(97, 123, 5000, np.uint8)), b"=" * 700, b"abc" * 200 + bytes(rng.integers(97, 99, 900, np.uint8)), b"x" * 200):
        at, gram, first, last, _ = repeats.anchors(raw)
        assert first[0] == 0 and last[-1] == len(raw) - repeats.LENGTH and (first[1:] == last[:-1] + 1).all()
        assert ((first >= at - width + 1) & (last <= at)).all()
        hashes = {}
        for p, g in zip(at.tolist(), gram.tolist()):
            assert hashes.setdefault(raw[p:p + repeats.GRAM], g) == g
        for p, a, b in zip(at.tolist(), first.tolist(), last.tolist()):  # the first of equal strings, so equal strings agree
            assert raw.find(raw[p:p + repeats.GRAM], a) == p
        # a string moved elsewhere has the same anchor at the same place
        for s in range(0, len(raw) - repeats.LENGTH + 1, 97):
            k = int(np.searchsorted(first, s, "right")) - 1
            alone = repeats.anchors(raw[s:s + repeats.LENGTH])
            assert (alone[0][0], alone[1][0]) == (at[k] - s, gram[k])


def test_packing(docs, rows, nothing):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    got = packing.pack(docs, TOKENIZER).toPandas().sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    assert got.groupby("sequence_id").length.sum().max() <= 2048
    want = Counter()
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 2048):
            part = ids[k:k + 2048]
            want[(-1 if i is None else i, k, len(part), zlib.crc32(part.tobytes()), len(ids))] += 1
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert Counter(got[columns].fillna(-1).astype("int64").itertuples(index=False, name=None)) == want
    assert packing.pack(nothing, TOKENIZER).count() == 0


def test_packing_plan_holds_all_orders_near_the_bound():
    rng = np.random.default_rng(3)
    orders = Counter(np.ceil(np.clip(rng.lognormal(4, 1, 20_000), 1, 255)).astype(int).tolist())
    used, sequences = Counter(), 0
    for pattern, times in packing.plan(dict(orders), 256):
        assert sum(s * n for s, n in pattern.items()) <= 256
        sequences += times
        for s, n in pattern.items():
            used[s] += n * times
    assert used == orders
    assert sequences <= 1.005 * sum(s * n for s, n in orders.items()) / 256 + 1


def test_token_counts(docs, rows, nothing):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    lengths = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    report = token_counts.token_report(docs, TOKENIZER, (16, 512)).toPandas()
    assert set(report.tokens) == set(lengths) | {16, 512}
    for r in report.itertuples():
        assert r.docs == lengths.count(r.tokens)
        assert r.longer_docs == sum(n > r.tokens for n in lengths)
        assert r.kept_tokens == sum(min(n, r.tokens) for n in lengths)
        assert (r.total_docs, r.total_tokens) == (len(lengths), sum(lengths))
    assert token_counts.token_report(nothing, TOKENIZER, (16,)).first()["kept_tokens"] == 0


def test_sharding(docs, rows, nothing):
    got = sharding.shard(docs, 5).toPandas()
    assert len(got) == len(rows)
    assert Counter(got["size"]) == Counter(len((t or "").encode()) + 16 for _, t in rows)
    assert Counter(got.text_crc32) == Counter(zlib.crc32((t or "").encode()) for _, t in rows)
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert set(got.shard) <= set(range(5))
    assert sharding.shard(nothing, 5).count() == 0


def test_shards_are_even_and_split_heavy_copies(spark):
    many = spark.range(4000).selectExpr("id as doc_id", "if(id % 3 = 0, repeat('same text ', 9), repeat(concat('t', id, ' '), 20)) as text")
    sums = sharding.shard(many, 8).groupBy("shard").sum("size").toPandas()["sum(size)"]
    assert len(sums) == 8 and sums.max() < 1.1 * sums.min()


def test_secrets(docs, rows, nothing):
    got = Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.scan(docs, secrets.fit(docs)).collect())
    want = Counter()
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    for i, t in rows:
        t = t or ""
        found = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))
        want[(i, *(sum(f[1] == k for f in found) for k in range(3)), hashlib.sha256(joined.encode()).hexdigest())] += 1
    assert got == want
    assert secrets.fit(nothing) is None and secrets.scan(nothing, None).count() == 0
    clean = secrets.masked(docs, None)
    assert clean.columns == docs.columns
    texts = {r.doc_id: r.text for r in clean.collect() if r.text}
    assert not any("AKIA" in t or "9f8e7d6c" in t for t in texts.values())


def test_field_learns_what_follows_a_key(spark):
    lines = [f'token = "{hashlib.md5(str(k).encode()).hexdigest()}" and so on' for k in range(60)]
    lines += [f"order number {k}4711-2024-{k}77 of the shop" for k in range(60)]
    field = secrets.fit(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    text = 'auth = "' + hashlib.md5(b"new").hexdigest().upper() + '" and order number 994711-2024-1177'
    assert not secrets.base_spans(text)
    assert [text[a:b] for a, b in field.spans(text)] == [hashlib.md5(b"new").hexdigest().upper()]


def test_field_tags_short_values_and_values_of_letters(spark):
    rng = np.random.default_rng(5)
    letters = list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    value = lambda n, digits: "".join(rng.choice(letters + list("0123456789") * digits, n))
    lines = [f'{key}{sign}"{value(int(rng.integers(12, 30)), k % 2)}"' for k in range(80)
             for key, sign in (("password", " = "), ("token", ": "), ("secret", " : "))]
    lines += [f"passwd = {value(14, 1).lower()}" for _ in range(60)]
    prose = "The river stone number Garden near meadow winter Harbour of amber signal it Copper thunder said they".split()
    lines += [" ".join(w + str(rng.choice(["", "", "", ":", " =", ",", " 12"])) for w in rng.choice(prose, 14)) for _ in range(300)]
    field = secrets.fit(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    for text, want in (("passwd = hunter2pw", ["hunter2pw"]), ('auth: "kJhGfDsAqWeRtYuIoP"', ["kJhGfDsAqWeRtYuIoP"]),
                       ("The meadow: stone number 7 of the Garden", [])):
        assert not secrets.base_spans(text)
        assert [text[a:b] for a, b in field.spans(text)] == want


def test_imatch(docs, rows, nothing):
    got = imatch.compare_edits(docs).toPandas()
    known = sorted({(-(2**63) if i is None else i, t or "") for i, t in rows})
    after = {k: known[(n + 1) % len(known)][1] for n, (k, _) in enumerate(known)}
    want = {}
    for k, t in known:
        half = len(t) // 2
        want[None if k < 0 else k] = (len(t), hashlib.sha256((t[:len(t) - half] + after[k][:half]).encode()).hexdigest())
    assert {None if r.doc_id != r.doc_id else int(r.doc_id): (r.n_chars, r.edited_sha256) for r in got.itertuples()} == want
    by_text = {}
    prints = {None if r.doc_id != r.doc_id else int(r.doc_id): r.fingerprint for r in got.itertuples()}
    for k, t in known:
        by_text.setdefault(t, set()).add(prints[None if k < 0 else k])
    assert all(len(p) == 1 for p in by_text.values())
    assert got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()
    assert imatch.compare_edits(nothing).count() == 0


def test_imatch_takes_every_shared_term(spark):
    """Each text has one term in common with one other text; all of them count, so no text falls back to its hash."""
    pairs = [(n, f"only{n}a pair{n // 2} only{n}b") for n in range(60)]
    got = imatch.compare_edits(spark.createDataFrame(pairs, "doc_id long, text string")).toPandas().set_index("doc_id")
    for n in range(0, 60, 2):
        assert got.near_next[n] == 1.0 and got.fingerprint[n] == got.fingerprint[n + 1]


def plain_imatch(rows):
    """Band counted and fingerprints taken from term sets, text by text."""
    known = sorted({(-(2**63) if i is None else i, t or "") for i, t in rows}, key=lambda r: (r[0], as_long(r[1])))
    found = lambda t: {w for w in re.split(r"[\W_]+", t.lower()) if w}
    df = Counter(w for _, t in rows for w in found(t or ""))
    band = {w for w, n in df.items() if 2 <= n <= max(2, 0.05 * len(rows))}
    firsts = {}
    for k, t in known:
        firsts.setdefault(k, t)
    ids = sorted(firsts)
    after = dict(zip(ids, ids[1:] + ids[:1]))
    for k, t in known:
        half = len(t) // 2
        edit = t[:len(t) - half] + firsts[after[k]][:half]
        yield (None if k == -(2**63) else k, hashlib.sha256(edit.encode()).hexdigest(),
               *(frozenset(found(x) & band) for x in (t, edit, firsts[after[k]])))


def as_long(text):
    value = xxhash.xxh64_intdigest(text.encode(), 42)
    return value - (1 << 64) if value >> 63 else value


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def plain_print(words):
    """32 sub-lexicon hashes as Spark hashes arrays of longs: element by element, each seeded by the last."""
    long_hash = lambda v, seed: xxhash.xxh64_intdigest((v & (2**64 - 1)).to_bytes(8, "little"), seed & (2**64 - 1))
    codes = sorted(as_long(w) for w in words)
    out = ""
    for k in range(32):
        seed = 42
        for code in codes:
            member = xxhash.xxh64_intdigest(k.to_bytes(4, "little"), long_hash(code, 42))
            if member & ((2 << k // 4) - 1) == 0:
                seed = long_hash(code, seed)
        out += f"{(seed >> 32) & 0xFFFFFFFF:08x}" if seed != 42 else "00000000"
    return out


def test_imatch_bands_and_cuts(spark, docs, rows):
    """All fingerprints, of texts and edited texts, equal those from plain term sets."""
    rng = np.random.default_rng(7)
    words = [f"w{n}" for n in range(400)]
    more = [(100 + n, " ".join(rng.choice(words, rng.integers(1, 60)).tolist())) for n in range(150)] + [(None, "w1 w2 other"), (100, "w3 w4")]
    given = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = {(None if r.doc_id != r.doc_id else int(r.doc_id), r.edited_sha256): (r.fingerprint, r.edited_fingerprint)
           for r in imatch.compare_edits(given).toPandas().itertuples()}
    want = {(k, sha): (own, edit) for k, sha, own, edit, _ in plain_imatch(list(rows) + more)}
    assert got.keys() == want.keys()
    shown = [k for k in want if want[k][0]]
    assert len(shown) > 150
    for key, (own, edit) in want.items():
        assert not own or got[key][0] == plain_print(own)
        assert not edit or got[key][1] == plain_print(edit)


def test_imatch_rare_terms_stay_however_many_there_are(spark):
    """51,000 terms of three texts must not push out the one term that two others share."""
    many = " ".join(f"m{n}" for n in range(51_000))
    texts = [many] * 3 + ["a0 pair b0", "a1 pair b1"] + [f"c{n} d{n}" for n in range(60)]
    got = imatch.compare_edits(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas().set_index("doc_id")
    assert got.near_next[3] == 1.0 and got.fingerprint[3] == got.fingerprint[4]


def test_licenses(docs, rows, nothing):
    words = lambda t: [w for w in re.split(r"[^\w]|_", t.lower()) if w]
    grams = lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    want = set()
    for i, t in rows:
        mine = grams(words(t or ""))
        for name, notice in licenses.TEMPLATES:
            need = grams(words(notice))
            if len(mine & need) >= 0.8 * len(need):
                want.add((i, name))
    assert {(r.doc_id, r.license) for r in licenses.scan(docs).collect()} == want and want
    assert licenses.scan(nothing).count() == 0


def test_decontamination(spark, docs, rows, nothing):
    item = " ".join(f"item{k}" for k in range(30))
    parts = item.split()
    mixed = " ".join(parts[15:] + ["other"] + parts[:15])
    little = " ".join(parts[:12])
    bench = spark.createDataFrame([(1, item), (1, item), (2, "too short"), (3, None)], "item_id long, text string")
    given = docs.select("doc_id", "text").union(spark.createDataFrame(
        [(900, "Before: " + item.upper() + "!"), (901, mixed), (902, little)], "doc_id long, text string"))
    found = decontam.leaks(given, bench).collect()
    assert {(r.doc_id, r.item_id, r.tiles, r.covered) for r in found} == {(900, 1, 1, 30), (901, 1, 2, 30)}
    assert decontam.without_leaks(given, bench).count() == given.count() - 2
    assert decontam.leaks(nothing, bench).count() == 0 and decontam.leaks(docs, bench.limit(0)).count() == 0


def test_tiles_mark_longest_first():
    assert decontam.tiles([1, 2, 3, 4, 5, 6, 7, 8], [9, 3, 4, 5, 6, 7, 8, 0, 1, 2, 3], 2) == [(2, 1, 6), (0, 8, 2)]


def test_toxicity(spark, docs, rows, nothing):
    labels = spark.createDataFrame([(i, int("stupid" in (t or ""))) for i, t in rows if i is not None], "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(scored) == len(rows)
    for r in scored:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    empty = labels.limit(0)
    assert toxicity.score(nothing, toxicity.fit(nothing, empty)).count() == 0
    plain = toxicity.fit(docs, empty)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, plain).collect()}
    loud = next(i for i, t in rows if t and "worthless idiot" in t)
    said = next(i for i, t in rows if t and "not stupid" in t)
    assert scores[loud] > 0.5 > scores[said]
    assert toxicity.without_toxic(docs, plain).columns == docs.columns


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where("held_out")
    right = scored.where("predicted = toxic").count() / scored.count()
    assert right > 0.93


@pytest.mark.parametrize("stretch, kept", [(3, 5), (37, 2), (1_000_000, 500_000)])
def test_encoder_stretches(monkeypatch, stretch, kept):
    monkeypatch.setattr(tokens, "STRETCH", stretch)
    monkeypatch.setattr(tokens, "RUNS", kept)
    encoder, tokenizer = tokens.Encoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    for text in ["", " ", "\n\t", "a", "Ab1c22,,d...e  f\nÉté--x9", "x" * 100, "!" * 100, "ab 12 " * 50, "it's <b> \x0b ß\x85你", "K1 k"]:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want

"""Token ids of whole texts with a public tokenizer file, fast enough for a corpus.

The tokenizer drops white space and treats each run of letters, each digit and each run of
other signs on its own.  The ids of a run are remembered as bytes of little-endian unsigned
32-bit ids, and a text of plain characters is put together from its runs.  In other texts this
holds for their plain chunks between white space; every other chunk, and a text with
control characters that the libraries split differently, goes to the tokenizer itself.
"""

from __future__ import annotations

import re

import numpy as np

# Characters whose runs the tokenizer certainly splits as RUN does: printable ASCII without
# apostrophe (contractions) and "<" (special tokens), and the lower-case Latin-1 letters.
PLAIN = re.compile(r"[!-&(-;=-~à-öø-ÿ]+")
PLAIN_TEXT = re.compile(r"[ \t\n\r!-&(-;=-~à-öø-ÿ]*")
RUN = re.compile(r"[a-zà-öø-ÿ]+|[0-9]|[^a-zà-öø-ÿ0-9 \t\n\r]+")
ODD_SPACE = re.compile("[\x1c-\x1f]")
CHUNKS = 300_000  # remembered at most, then forgotten: bounds a worker's memory
RUNS = 500_000
STRETCH = 1_000_000  # characters of a plain text put together at once
CUT = re.compile(r"[0-9 \t\n\r]")

_encoders: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """The worker's encoder for a tokenizer file; kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ends = [i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[ends] = True
        self.by_run = bool(ends)
        self.chunks: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn_runs(self, names: list[str]) -> None:
        """Remember the ids of runs that are not known yet."""
        ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(names)], add_special_tokens=False)[0].ids, "<u4")
        last = np.flatnonzero(self.ends[ids]) + 1
        if len(last) == len(names):
            raw, first = ids.tobytes(), 0
            for name, end in zip(names, (last * 4).tolist()):
                self.runs[name] = raw[first:end]
                first = end
        else:  # a file whose word ends differ
            for name in names:
                self.runs[name] = self.whole(name)

    def learn(self, chunks: list[str]) -> None:
        if len(self.chunks) + len(chunks) > CHUNKS:
            self.chunks.clear()
        if len(self.runs) > RUNS:
            self.runs.clear()
        split, new = [], set()
        for chunk in chunks:
            low = chunk.lower()
            if self.by_run and PLAIN.fullmatch(low) and len(low) == len(chunk):
                found = RUN.findall(low)
                split.append((chunk, found))
                new.update(found)
            else:
                self.chunks[chunk] = self.whole(chunk)
        if new := list(new.difference(self.runs)):
            self.learn_runs(new)
        runs = self.runs
        for chunk, found in split:
            self.chunks[chunk] = b"".join([runs[r] for r in found])

    def encode_plain(self, low: str) -> bytes:
        """Ids of a lower-case text of plain characters, in stretches that bound the runs held at once."""
        parts, at = [], 0
        while at < len(low):
            past = at + STRETCH
            if past < len(low):  # a cut at a digit or white space splits no run
                cut = CUT.search(low, past)
                past = cut.start() if cut else len(low)
            found = RUN.findall(low, at, past)
            if len(self.runs) > RUNS:
                self.runs.clear()
            if missing := list(set(found).difference(self.runs)):
                self.learn_runs(missing)
            parts.append(b"".join(map(self.runs.__getitem__, found)))
            at = past
        return b"".join(parts)

    def encode(self, text: str) -> bytes:
        """Ids of ``text`` as little-endian unsigned 32-bit integers."""
        if ODD_SPACE.search(text):
            return self.whole(text)
        low = text.lower()
        if self.by_run and len(low) == len(text) and PLAIN_TEXT.fullmatch(low):
            return self.encode_plain(low)
        words = text.split()
        known = self.chunks
        missing = set(words).difference(known)
        if missing:
            before = len(known)
            self.learn(list(missing))
            if len(known) < before + len(missing):  # it was emptied: learn what else this text needs
                rest = set(words).difference(known)
                if len(rest) + len(known) > CHUNKS:
                    return self.large(words)
                self.learn(list(rest))
        return b"".join(map(known.__getitem__, words))

    def large(self, words: list[str]) -> bytes:
        """A text with more distinct chunks than are remembered: in stretches."""
        parts = []
        for k in range(0, len(words), CHUNKS // 2):
            parts.append(self.encode(" ".join(words[k:k + CHUNKS // 2])))
        return b"".join(parts)

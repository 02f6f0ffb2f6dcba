"""Token ids of whole texts in tasks, with a memory of words that came before."""

from __future__ import annotations

import os
from collections.abc import Sequence

import numpy as np

from memengine.llm.common import worker_state

#: Words whose ids a task remembers. It changes no result, only how often the tokenizer is asked.
REMEMBERED = 800_000
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def encoder(path: str, remembered: int = REMEMBERED) -> "Encoder":
    """One encoder a Python worker, kept from task to task of a stage."""
    kept = worker_state()
    if path not in kept:
        kept[path] = Encoder(path, remembered)
    return kept[path]


class Encoder:
    """encode(text) gives what the tokenizer gives for the whole text, as little-endian unsigned 32-bit ids.

    A byte-level pre-tokenizer never lets a piece run from a visible character into white space, nor start behind a
    single space that has visible characters on both sides, nor run from a letter or digit into the marks that end a
    word; so a text whose white space is single spaces and line feeds between visible characters can be cut before each
    of them and its words encoded one by one. Other texts, and those with a special token, are encoded in one piece.
    A word is known by its characters without the space before it, or with the line feed before it.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.size = max(vocab.values()) + 1
        self.bytes_of = np.zeros(self.size, np.int64)  # of a byte-level token: one character a byte
        for token, i in vocab.items():
            self.bytes_of[i] = len(token)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {"\n": b""}
        self.tails: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words that each follow a space or line feed: one call for all, cut where each word's bytes end."""
        if not words:
            return {}
        units = [w if w[0] == "\n" else " " + w for w in words]
        ids = np.frombuffer(self.whole("".join(units)), "<u4")
        ends = np.cumsum([len(u.encode()) for u in units])
        cut = (np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1).tolist()
        raw, at, out = ids.tobytes(), 0, {}
        for w, to in zip(words, cut, strict=True):
            out[w] = raw[4 * at : 4 * to]
            at = to
        return out

    def _ids(self, words: set[str]) -> dict[str, bytes]:
        """Ids of new words; marks at a word's end are looked up apart, so that the tokenizer sees each stem once."""
        stems, parts = set(), []
        for w in words:
            stem = w.rstrip(_MARKS)
            if stem and stem[-1].isalnum():
                parts.append((w, stem, w[len(stem) :]))
                stems.add(stem)
            else:
                parts.append((w, w, ""))
                stems.add(w)
        for tail in {p[2] for p in parts}.difference(self.tails):
            if len(self.tails) > 10_000:
                self.tails.clear()
            self.tails[tail] = self.whole(tail)
        learnt = self._learn(list(stems.difference(self.known)))
        tails = self.tails | {t: self.whole(t) for t in {p[2] for p in parts}.difference(self.tails)}
        return learnt | {w: (learnt.get(stem) or self.known[stem]) + tails[tail] for w, stem, tail in parts}

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        known = self.known
        plain, heads, split, found = [], [], [], []
        for text in texts:
            words = text.replace("\n", " \n").split(" ")
            plain.append("" not in words and "\n" not in words and len(words) == len(text.split()) and not any(x in text for x in self.special))
            if plain[-1]:
                heads.append(words[0])
                words[0] = "\n"  # no word; it stands for no ids
                split.append(words)
                found.append(list(map(known.get, words)))
        new = {w for words, ids in zip(split, found, strict=True) if None in ids for w, x in zip(words, ids, strict=True) if x is None}
        if new:
            learnt = self._ids(new)
            found = [ids if None not in ids else [learnt[w] if x is None else x for w, x in zip(words, ids, strict=True)] for words, ids in zip(split, found, strict=True)]
            if len(known) + len(learnt) <= self.remembered:
                known.update(learnt)
        first = self.tokenizer.encode_batch_fast(heads, add_special_tokens=False)
        joined = iter([np.array(e.ids, "<u4").tobytes() + b"".join(ids) for e, ids in zip(first, found, strict=True)])
        return [next(joined) if whole else self.whole(text) for whole, text in zip(plain, texts, strict=True)]

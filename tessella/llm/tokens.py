"""Token ids of whole texts by a public tokenizer file, through a bounded cache of words.

The tokenizer splits at white space before anything else, so a text's ids are its words' ids one after another. Words
are encoded once and kept. Before that, A-Z are lower-cased (the tokenizer does so itself) and a space is put between
an ASCII letter and a mark after it (a boundary for the tokenizer anyway), so that fewer different words occur.
Alphabetic words are encoded many at a time and told apart by the vocabulary's word-end mark; where the number of word
ends differs from the number of words, they are encoded one by one. So ids are those of the whole text.

A text that holds the string of an added token (an end-of-text mark, say) is encoded whole, with the library's defaults.
"""

from __future__ import annotations

import os
import re

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words kept by one worker at most (about 100 bytes each).
CACHE = 800_000
#: Ends of words that the tokenizer always splits off in one piece.
TAIL = ".,;:!?*#$%&|()[]\"-"
JOIN = 2000

_letter, _mark = np.zeros(256, bool), np.zeros(256, bool)
_letter[list(b"abcdefghijklmnopqrstuvwxyz")] = True
_mark[list(TAIL.encode())] = True


def apart(text: bytes) -> bytes:
    """A text in lower case with a space between each ASCII letter and a mark that follows it."""
    text = text.lower()
    a = np.frombuffer(text, np.uint8)
    at = np.flatnonzero(_letter[a[:-1]] & _mark[a[1:]])
    if not len(at):
        return text
    out = np.full(len(a) + len(at), 32, np.uint8)
    to = np.ones(len(out), bool)
    to[at + 1 + np.arange(len(at))] = False
    out[to] = a
    return out.tobytes()


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole, self.tokenizer = Tokenizer.from_file(path), Tokenizer.from_file(path)
        added = self.whole.get_added_tokens_decoder().values()
        self.marks = re.compile(b"|".join(re.escape(t.content.encode()) for t in added) or b"(?!)", re.IGNORECASE)
        self.tokenizer.encode_special_tokens = True  # for words: lower-casing must not make a special token of one
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.cache: dict[bytes, bytes] = {}

    def one_by_one(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def alphabetic(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only."""
        out: list[bytes] = []
        chunks = [words[i : i + JOIN] for i in range(0, len(words), JOIN)]
        for chunk, e in zip(chunks, self.tokenizer.encode_batch_fast([" ".join(c) for c in chunks], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) != len(chunk) or at[-1] != len(ids):
                out += self.one_by_one(chunk)
                continue
            raw, to = ids.tobytes(), (at * 4).tolist()
            out += [raw[a:b] for a, b in zip([0, *to[:-1]], to)]
        return out

    def learn(self, words: set[bytes]) -> None:
        cache, letters, split, other = self.cache, [], [], []
        for w in words:
            s = w.decode()
            if s.isalpha():
                letters.append(s)
            elif (body := s.rstrip(TAIL)) and body.isalpha() and body.lower().isalpha():
                split.append((w, body, s[len(body) :]))
            else:
                other.append(s)
        parts = {x for _, a, b in split for x in (a, b) if x.encode() not in cache}
        letters = list({*letters, *(x for x in parts if x.isalpha())})
        other += [x for x in parts if not x.isalpha()]
        cache.update(zip(map(str.encode, letters), self.alphabetic(letters)))
        for i in range(0, len(other), 4096):
            cache.update(zip(map(str.encode, other[i : i + 4096]), self.one_by_one(other[i : i + 4096])))
        for w, a, b in split:
            cache[w] = cache[a.encode()] + cache[b.encode()]

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers; a null text has none."""
        marked = {i: t for i, t in enumerate(texts) if t and self.marks.search(t)}
        if marked:
            rest = iter(self.encode([t for i, t in enumerate(texts) if i not in marked]))
            whole = {i: np.array(self.whole.encode(t.decode(), add_special_tokens=False).ids, "<u4").tobytes() for i, t in marked.items()}
            return [whole[i] if i in whole else next(rest) for i in range(len(texts))]
        words = [apart(t).split() if t else [] for t in texts]
        new = set().union(*words) - self.cache.keys()
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = set().union(*words)
        self.learn(new)
        get = self.cache.__getitem__
        return [b"".join(map(get, w)) for w in words]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file; kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]

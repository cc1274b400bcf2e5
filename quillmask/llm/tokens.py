"""Token ids of whole texts with a public tokenizer file, as the tokenizer
itself gives them (``add_special_tokens=False``), at several times its speed.

The tokenizer lower-cases, splits into words by a pattern and encodes each
word on its own.  For texts of plain Latin letters, digits and punctuation the
splitting is done here: the distinct words of a batch are found by their hashes
(64 bits, told apart within a batch), looked up, and new ones encoded by the
tokenizer's own model, many in one call.  All other texts (combining marks,
other scripts, special token strings, ...) go through the tokenizer as they are.
"""
from __future__ import annotations

import os
import re

import numpy as np

from .common import give_back
from .hashing import NON_SPACE, Words, chunks

TOKENIZER = "word_bpe_49k.json"
CACHE_BYTES = 45_000_000        # of each of two generations of known words
ENTRY = 190                     # bytes of a known word beside its letters and ids
CALL_WORDS = 500                # words joined in one call
CHUNK = 4_000_000               # bytes of texts handled at once
SLICE = 500_000                 # characters of a long text handled at once

#: Fixed pattern of the tokenizer file, for the characters below.
WORD = re.compile(r"[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)|\d|(?:[^\s\w]|_)+")
#: Anything but characters that the pattern, lower case and normal form treat
#: alike here and in the tokenizer: Latin letters, ASCII, common punctuation.
OTHER = re.compile("[^\x00-\x1b\x20-\x7f\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏ‐-‧€]|<\\|")
CUT = re.compile(r"\s(?=[A-Za-z])")

_loaded: dict[tuple, "Encoder"] = {}


def encoder(name: str = TOKENIZER, cache_bytes: int = CACHE_BYTES, chunk: int = CHUNK) -> "Encoder":
    """One encoder per process; a worker that turns to another setting lets
    the former one go."""
    key = (name, cache_bytes, chunk)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Encoder(*key)
    return _loaded[key]


def release() -> None:
    """Lets the process's encoder go, for workers that have other work next."""
    _loaded.clear()
    give_back()


def is_other(s: str) -> bool:
    if s.isascii():
        return "<|" in s or any(c in s for c in "\x1c\x1d\x1e\x1f")
    return OTHER.search(s) is not None


def slices(text: str):
    """A long text in parts that are cut where a word begins after a space."""
    at = 0
    while len(text) - at > SLICE:
        m = CUT.search(text, at + SLICE)
        if not m:
            break
        yield text[at:m.end()]
        at = m.end()
    yield text[at:] if at else text


def spelled(s: str) -> tuple[str, ...] | list[str]:
    """The pattern's words in a stretch without spaces."""
    if s.isalpha():
        return (s,)
    if s[-1] in ",." and s[:-1].isalpha():
        return (s[:-1], s[-1])
    return WORD.findall(s)


class Encoder:
    def __init__(self, name: str, cache_bytes: int = CACHE_BYTES, chunk: int = CHUNK):
        self.cache_bytes, self.chunk = cache_bytes, chunk
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        if not os.path.isabs(name):
            import public_tokenizers
            name = public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(name)
        # the same model for words that are normal and split already
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        # what stands between spaces -> ids; words not used for long fall out
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held = 0                   # bytes of the young ones; a worker keeps at most two such sets

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def together(self, words: list[str]) -> list[bytes]:
        """Ids of words of the pattern, joined by spaces for the model; a
        word's last token is one that can only end a word."""
        calls = [words[a:a + CALL_WORDS] for a in range(0, len(words), CALL_WORDS)]
        out = []
        for part, e in zip(calls, self.model.encode_batch_fast([" ".join(c) for c in calls], add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u4")
            end = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(end) != len(part):
                out += self.whole(part)
                continue
            raw = ids.tobytes()
            out += [raw[i:j] for i, j in zip([0, *end], end)]
        return out

    def looked_up(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words."""
        if self.held > self.cache_bytes:
            self.young, self.old, self.held = {}, self.young, 0
        young, old = self.young, self.old
        out = list(map(young.get, words))
        missing = [i for i, ids in enumerate(out) if ids is None]
        new = []
        for i in missing:
            ids = old.get(words[i])
            if ids is None:
                new.append(i)
            else:
                out[i] = young[words[i]] = ids
                self.held += ENTRY + len(words[i]) + len(ids)
        split = list(map(spelled, b"\n".join([words[i] for i in new]).decode().split("\n"))) if new else []
        parts = list(set().union(*split))
        known = dict(zip(parts, self.together(parts)))
        for i, s in zip(new, split):
            ids = known[s[0]] if len(s) == 1 else b"".join([known[p] for p in s])
            out[i] = young[words[i]] = ids
            self.held += ENTRY + len(words[i]) + len(ids)
        return out

    def plain(self, texts: list[bytes]) -> list[bytes]:
        """Ids of lower-case texts of known characters."""
        w = Words(texts, NON_SPACE)
        _, first, which = np.unique(w.hash, return_index=True, return_inverse=True)
        data = w.data.tobytes()
        ids = self.looked_up([data[a:b] for a, b in zip(w.start[first].tolist(), w.end[first].tolist())])
        size = np.array([len(x) for x in ids], dtype=np.int64) // 4
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        n, begin = size[which], (np.cumsum(size) - size)[which]
        end = np.cumsum(n)
        every = flat[np.repeat(begin - end + n, n) + np.arange(end[-1] if len(end) else 0)]
        cut = np.concatenate([[0], end])[w.first].tolist()
        return [every[a:b].tobytes() for a, b in zip(cut, cut[1:])]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        cut = [list(slices(t or "")) for t in texts]
        parts = [s for c in cut for s in c]
        other = [is_other(s) for s in parts]
        low = [s.lower().encode() for s, o in zip(parts, other) if not o]
        plain = iter([x for a, b in chunks(low, self.chunk, len(low)) for x in self.plain(low[a:b])])
        rest = iter(self.whole([s for s, o in zip(parts, other) if o]))
        ids = iter([next(rest) if o else next(plain) for o in other])
        return [b"".join([next(ids) for _ in c]) for c in cut]

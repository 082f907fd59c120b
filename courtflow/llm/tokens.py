"""Token ids of whole texts through a word cache.

The tokenizers this serves drop white space and never join across it (their
pre-tokenizer's pattern has no branch that matches a space), so a text's ids are
its words' ids in a row. Each Python worker keeps the ids of words it has met.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np

#: ASCII marks that end a token when they follow a letter or digit; no apostrophe
#: (it opens contractions) and none of ``<|>`` (they may spell a special token).
_MARKS = b'.,!?;:$%&*#)("+=/~^@]['
_ALNUM = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")
_CACHES: dict[str, WordIds] = {}


def _plain(part: bytes) -> bool:
    """Lower-case letters of the older scripts alone, already composed."""
    if part.isascii():
        return part.isalpha() and part.islower()
    s = part.decode("utf-8", "replace")
    return s.isalpha() and max(s) < "\u2000" and s == s.lower() and unicodedata.is_normalized("NFC", s)


class WordIds:
    """Ids of words and texts for one tokenizer file; ``limit`` bounds the words kept in memory."""

    def __init__(self, path: str, limit: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        # for words of lower-case letters alone, the normalizer and the pre-tokenizer's pattern do nothing
        self.lean = Tokenizer(self.tok.model)
        self.lean.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = self.tok.model.end_of_word_suffix
        self.marked = bool(suffix)
        self.closes = np.zeros(self.tok.get_vocab_size(), bool)  # ids that end a word
        if suffix:
            self.closes[[i for t, i in self.tok.get_vocab().items() if t.endswith(suffix)]] = True
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.limit, self.words = limit, {}

    def _encode(self, parts: list[bytes]) -> None:
        plain, rest = [], parts
        if self.marked:
            plain = [p for p in parts if p.isalpha() and p.islower()]  # of bytes: ASCII letters alone
            if len(plain) < len(parts):
                rest = []
                for p in parts:
                    if not (p.isalpha() and p.islower()):
                        (plain if _plain(p) else rest).append(p)
            else:
                rest = []
        if plain:
            ids = np.array(self.lean.encode_batch_fast([b" ".join(plain).decode()], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(plain):
                raw, cuts = ids.tobytes(), [0, *(ends * self.dtype.itemsize).tolist()]
                self.words.update(zip(plain, (raw[x:y] for x, y in zip(cuts, cuts[1:], strict=False)), strict=True))
            else:
                rest += plain
        if rest:
            found = self.tok.encode_batch_fast([p.decode("utf-8", "replace") for p in rest], add_special_tokens=False)
            self.words.update((p, np.array(e.ids, self.dtype).tobytes()) for p, e in zip(rest, found, strict=True))

    def _learn(self, run: set[bytes]) -> None:
        """Put all words of ``run`` into the cache. A word's stem and the marks after it are words too."""
        words = self.words
        missing = run.difference(words)
        if not missing:
            return
        if len(words) + len(missing) > self.limit:
            words.clear()
            missing = run
        new, cut = set(), []
        for w in missing:
            if w[-1] not in _ALNUM and (stem := w.rstrip(_MARKS)) and len(stem) < len(w) and stem[-1] in _ALNUM:
                cut.append((w, stem, w[len(stem) :]))
                new.add(stem)
                new.add(cut[-1][2])
            else:
                new.add(w)
        if new := list(new.difference(words)):
            self._encode(new)
        for w, stem, marks in cut:
            words[w] = words[stem] + words[marks]

    def raw(self, body: bytes | None) -> bytes:
        """The ids of a text as little-endian bytes of ``dtype``."""
        if not body:
            return b""
        words = body.split() if b"<|" in body else body.lower().split()
        out = []
        for start in range(0, len(words), 100_000):  # in runs, so that one huge text can't outgrow the cache
            run = words[start : start + 100_000]
            self._learn(set(run))
            out.append(b"".join(map(self.words.__getitem__, run)))
        return b"".join(out)

    def ids(self, body: bytes | None) -> np.ndarray:
        return np.frombuffer(self.raw(body), self.dtype)

    def count(self, body: bytes | None) -> int:
        return len(self.raw(body)) // self.dtype.itemsize


def word_ids(path: str) -> WordIds:
    """One cache for each tokenizer and Python worker."""
    if path not in _CACHES:
        _CACHES[path] = WordIds(path)
    return _CACHES[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")

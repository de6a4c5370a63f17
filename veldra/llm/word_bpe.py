"""Token ids of whole texts with a tokenizer that drops white space, by a memo of its words.

The tokenizer treats what stands between white space on its own (it normalizes, splits and merges
within it only), so the ids of a text are those of its words, in order.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

#: Memo entries after which it is emptied, and the longest word kept; both bound memory only.
MEMO = 500_000
MEMO_CHARS = 48
#: The same for workers that other operators use too.
SMALL_MEMO = 150_000
#: str.split() also splits at these four, which aren't white space to the tokenizer.
_NOT_SPACE = "".join(map(chr, range(0x1C, 0x20)))
#: Latin letters that are composed, cased and classed alike everywhere, and characters that are
#: never letters, digits or the start of a contraction; a plain word is of the first, then the others.
_LETTERS = re.compile(r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f]+").fullmatch
_MARKS = r"""!"#$%&()*+,-./:;<=>?@[\]^_`{|}~"""
_SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SPACE = re.compile("[" + "".join(map(chr, _SPACES)) + "]+")


class WordTokenizer:
    """Remembers words as they stand, and stems: a word's letters in lower case.

    The tokenizer splits letters from the punctuation after them and ends the last token of each
    part with a word end, so new stems are encoded together, as one text, and told apart by the
    word ends. Words of any other make are encoded by themselves.
    """

    def __init__(self, path: str, memo: int = MEMO):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo = memo
        self.words: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}
        suffix = self.tokenizer.model.end_of_word_suffix
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True

    def _split(self, text: str) -> list[str]:
        if any(c in text for c in _NOT_SPACE):
            return [w for w in _SPACE.split(text) if w]
        return text.split()

    def _encode(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _encode_stems(self, stems: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(stems)], add_special_tokens=False)[0].ids, "<u4")  # without offsets
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(stems) or ends[-1] != len(ids):
            return self._encode(stems)
        data, at = ids.tobytes(), (4 * ends).tolist()
        return [data[a:b] for a, b in zip([0, *at], at, strict=False)]

    def forget(self) -> None:
        """At the end of a task: workers are used again, by operators that need the memory."""
        self.words.clear()
        self.stems.clear()

    def batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        known = self.words
        for memo in (known, self.stems, self.marks):
            if len(memo) > self.memo:
                memo.clear()
        self.marks[""] = b""
        rows, gaps, new = [], [], set()
        for t in texts:
            words = self._split(t)
            row = list(map(known.get, words))
            rows.append(row)
            if None in row:
                at = [k for k, x in enumerate(row) if x is None]
                missing = [words[k] for k in at]
                gaps.append((row, at, missing))
                new.update(missing)
        if gaps:
            made = self._new(new)
            for row, at, missing in gaps:
                for k, w in zip(at, missing, strict=True):
                    row[k] = made[w]
            known.update(made)
            for w in [w for w in made if len(w) > MEMO_CHARS]:
                del known[w]
        return [b"".join(row) for row in rows]

    def _new(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words that aren't remembered."""
        stems, marks, made, odd, fresh, waiting = self.stems, self.marks, {}, [], set(), []
        for w in words:
            letters = w.rstrip(_MARKS)
            if not (letters.isascii() and letters.isalpha() or _LETTERS(letters)):
                odd.append(w)
                continue
            low, mark = letters.lower(), w[len(letters) :]
            stem, tail = stems.get(low), marks.get(mark)
            if tail is None:
                tail = marks[mark] = self._encode([mark])[0]
            if stem is None:
                fresh.add(low)
                waiting.append((w, low, tail))
            else:
                made[w] = stem + tail
        new = list(fresh)
        for a in range(0, len(new), 4000):
            stems.update(zip(new[a : a + 4000], self._encode_stems(new[a : a + 4000]), strict=True))
        for w, low, tail in waiting:
            made[w] = stems[low] + tail
        made.update(zip(odd, self._encode(odd), strict=True))
        return made


@lru_cache(maxsize=2)
def word_tokenizer(path: str, memo: int = MEMO) -> WordTokenizer:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordTokenizer(path, memo)

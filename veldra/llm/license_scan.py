"""License scans: MinHash bands over overlapping windows of a text retrieve templates, exact containment verifies.

Shingles are runs of five words (letters and digits, in lower case); a template of fewer words is
one shingle of its own length. A template of m distinct shingles belongs to the size class of the
power of two 2**c up to m. A class's windows hold 4 * 2**c consecutive shingles and begin every
2**c, so that any stretch of up to 3 * 2**c shingles, half as many again as the longest template
of the class, lies whole in one.

A document contains a template if one window holds at least ``share`` of the template's distinct
shingles; passages that lie farther apart than a window don't add up. If a window contains that
share, their Jaccard similarity is at least share * m / (4 * 2**c + (1 - share) * m). The number of
one-row bands follows from the least of these, so that no band retrieves a true match with a
probability of at most ``MISS``.

Retrieval goes by the bands' tables alone: for each band the shingle of a template with the least
hash value. A band retrieves a template for a window if the least value of the window's shingles
is the template's. That can only be where the window holds that shingle, so the text's shingles
are looked up among the tables' (at most as many a template as there are bands, however long the
template is), and the least values are computed for the windows around those found. What is
retrieved is verified by comparing the words themselves.

Defined results: null and empty texts, and texts without a shingle, match nothing; texts of any
length are searched whole; a document gives a row for each template that it contains, at the window
of the highest share and, of equal ones, the earliest; ``first_word`` is the first of the template's
shingles in that window; repeated rows each give their rows; a null doc_id stays null; an empty
table gives no rows; other columns play no part, whatever their names. A template without words is
an error.
"""

from __future__ import annotations

import math
import re
from functools import partial

import numpy as np
from pyspark.sql import DataFrame

from veldra.llm.common import released, text_or_empty

SHINGLE = 5
CONTAINMENT = 0.8
MISS = 1e-6
SEED = 4
#: Hash values computed at a time when windows are tested.
CHUNK = 1 << 14
_FILTER_BITS = 16
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shingles_of(words: list[str], size: int) -> list[str]:
    return [" ".join(words[k : k + size]) for k in range(len(words) - size + 1)]


def least_similarity(size: int, share: float) -> float:
    """Of a template of the class's least size, 2**c = ``size``, contained to ``share`` in a window."""
    return share * size / (4 * size + (1 - share) * size)


def bands(share: float, miss: float) -> int:
    """One-row bands, each of which meets with the probability of the similarity (the same for every class)."""
    return math.ceil(math.log(miss) / math.log(1 - least_similarity(1, share)))


def size_class(shingles: int) -> int:
    """c for the power of two 2**c up to the number of shingles."""
    return shingles.bit_length() - 1


def _mix(x: np.ndarray, salt: np.ndarray | np.uint64) -> np.ndarray:
    """A 64-bit finalizer, one hash function for each salt."""
    x = x + salt
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _salts(first: int, n: int) -> np.ndarray:
    return np.array([(k * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64 for k in range(first, first + n)], np.uint64)


_PLACES = _salts(1 << 20, SHINGLE)


def _word_hashes(words: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), words), np.uint64, len(words))


def _shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Of runs of ``size`` words, from the words' hashes."""
    n = len(h) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(size if n > 0 else 0):
        out = out * np.uint64(0x100000001B3) + _mix(h[k : k + n], _PLACES[k])
    return out


class Family:
    """The templates whose shingles have one length."""

    def __init__(self, size: int, templates: dict[int, list[str]], salts: np.ndarray):
        self.size, self.salts = size, salts
        self.shingles = {t: frozenset(shingles_of(words, size)) for t, words in templates.items()}
        table: dict[int, dict[int, list[int]]] = {}
        for t, words in templates.items():
            h = np.unique(_shingle_hashes(_word_hashes(words), size))
            for band, at in enumerate(_mix(h[None, :], salts[:, None]).argmin(axis=1)):
                table.setdefault(int(h[at]), {}).setdefault(t, []).append(band)
        #: Shingles that some band has, and for each of them the templates and bands.
        self.keys = np.array(sorted(table), np.uint64)
        self.entries = [[(t, np.array(b)) for t, b in table[int(x)].items()] for x in self.keys]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.keys & np.uint64((1 << _FILTER_BITS) - 1)] = True

    def found(self, h: np.ndarray) -> list[tuple[int, int]]:
        """(place, number of the key) of the text's shingles that some band has."""
        at = np.flatnonzero(self.filter[h & np.uint64((1 << _FILTER_BITS) - 1)])
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        ok = self.keys[k] == h[at]
        return list(zip(at[ok].tolist(), k[ok].tolist(), strict=True))

    def retrieved(self, window: np.ndarray, value: np.uint64, which: np.ndarray) -> bool:
        """Whether in one of the bands the window's least hash value is that of the shingle ``value``."""
        some = max(1, CHUNK // len(window))
        for a in range(0, len(which), some):
            salts = self.salts[which[a : a + some], None]
            if (_mix(window[None, :], salts).min(axis=1) == _mix(value, salts[:, 0])).any():
                return True
        return False

    def scan(self, words: list[str], h: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """Of each template contained: its share, first word and number of words."""
        best: dict[int, tuple[float, int, int, int]] = {}
        done: set[tuple[int, int]] = set()
        for place, key in self.found(h):
            for t, which in self.entries[key]:
                own = self.shingles[t]
                step = 1 << size_class(len(own))
                for k in range(max(0, -(-(place - 4 * step + 1) // step)), place // step + 1):
                    begin, end = k * step, min(k * step + 4 * step, len(h))
                    if (t, k) in done or not self.retrieved(h[begin:end], h[place], which):
                        continue
                    done.add((t, k))
                    here = shingles_of(words[begin : end + self.size - 1], self.size)
                    hits = [i for i, x in enumerate(here) if x in own]
                    share = len({here[i] for i in hits}) / len(own)
                    if hits and (t not in best or (share, -k) > (best[t][0], -best[t][3])):
                        best[t] = (share, begin + hits[0], hits[-1] - hits[0] + self.size, k)
        return {t: x[:3] for t, x in best.items()}


class Scanner:
    def __init__(self, templates: dict[str, str], share: float = CONTAINMENT, miss: float = MISS):
        self.share, self.names = share, sorted(templates)
        split = [words_of(templates[name]) for name in self.names]
        if not all(split):
            raise ValueError(f"a template has no words: {self.names[split.index([])]}")
        sizes = sorted({min(SHINGLE, len(w)) for w in split})
        salts = _salts(0, bands(share, miss))
        self.families = [Family(s, {t: w for t, w in enumerate(split) if min(SHINGLE, len(w)) == s}, salts) for s in sizes]

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(template, share of it, first word, words) of each template that the text contains."""
        words = words_of(text)
        h, found = _word_hashes(words), {}
        for family in self.families:
            if len(words) >= family.size:
                found |= family.scan(words, _shingle_hashes(h, family.size))
        return [(self.names[t], *found[t]) for t in sorted(found) if found[t][0] >= self.share]


def scan_licenses(docs: DataFrame, templates: dict[str, str], share: float = CONTAINMENT) -> DataFrame:
    """``doc_id, license, containment, first_word, n_words`` for each document and template found in it."""
    import pyarrow as pa

    schema = docs.select("doc_id").schema.add("license", "string").add("containment", "double").add("first_word", "long").add("n_words", "long")
    names = [f.name for f in schema.fields]

    def run(batches):
        scanner = Scanner(templates, share)
        for b in batches:
            rows, out = [], []
            for k, x in enumerate(b.column(1)):
                for match in scanner.scan(x.as_py()):
                    rows.append(k)
                    out.append(match)
            columns = [pa.array([m[c] for m in out], t) for c, t in enumerate((pa.string(), pa.float64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *columns], names)

    return docs.select("doc_id", text_or_empty()).mapInArrow(released(run), schema)

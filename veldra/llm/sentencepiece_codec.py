"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

Defined results: a null or empty text has no ids and decodes to the empty text; a null doc_id
stays null; repeated rows each give a row; texts of any length are encoded whole; of equal scores
the library's rule decides; an empty table gives no rows; columns other than ``doc_id`` and ``text``
play no part, whatever their names. A white-space marker that stands in a text itself decodes to a space, as in the library.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from veldra.llm.common import released, text_or_empty
from veldra.llm.unigram import BYTE, CONTROL, MARK, UNKNOWN, Segmenter, vocabulary


class DoubleArray:
    """Trie of byte strings in two arrays: the child of state s by byte c is t = base[s] + c + 1, if check[t] == s."""

    def __init__(self, keys: list[tuple[bytes, int]]):
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for key, value in keys:
            node = 0
            for c in key:
                nxt = children[node].get(c)
                if nxt is None:
                    nxt = children[node][c] = len(children)
                    children.append({})
                node = nxt
            ends[node] = value
        size = 2 * len(children) + 1024
        base, check, self.value = [0] * size, [-1] * size, [-1] * size
        used = bytearray(size)
        used[0] = 1
        place, first = [0], 1
        states = {0: 0}
        for node in place:
            state, kids = states[node], sorted(children[node])
            self.value[state] = ends.get(node, -1)
            if not kids:
                continue
            first = used.find(0, first)
            at = first
            while True:
                b = at - kids[0] - 1
                if b >= 0 and not any(used[b + c + 1] for c in kids):
                    break
                at = used.find(0, at + 1)
                if at < 0 or at + 300 > len(used):
                    grow = len(used)
                    used.extend(bytes(grow))
                    base.extend([0] * grow)
                    check.extend([-1] * grow)
                    self.value.extend([-1] * grow)
                    at = at if at >= 0 else grow
            base[state] = b
            for c in kids:
                t = b + c + 1
                used[t], check[t], states[children[node][c]] = 1, state, t
                place.append(children[node][c])
        keep = max(used.rfind(1) + 1, 1) + 300
        self.base, self.check, self.value = base[:keep], check[:keep], self.value[:keep]
        short = keep - len(self.base)
        self.base += [0] * short
        self.check += [-1] * short
        self.value += [-1] * short

    def prefixes(self, text: bytes, start: int):
        """(length, value) of each key that text[start:] begins with, shortest first; the codec's loop does the same in place."""
        base, check, value, state = self.base, self.check, self.value, 0
        for k in range(start, len(text)):
            t = base[state] + text[k] + 1
            if t >= len(check) or check[t] != state:
                return
            state = t
            if value[t] >= 0:
                yield k + 1 - start, value[t]


class Codec:
    def __init__(self, model_path: str):
        self.v = vocabulary(model_path)
        self.trie = DoubleArray([(p.encode(), i) for i, p, _ in self.v.lattice()])
        self.segments = Segmenter(self.v, self.segment)
        self.surface = [self._surface(i) for i in range(len(self.v.pieces))]

    def _surface(self, i: int) -> bytes:
        kind, piece = self.v.types[i], self.v.pieces[i]
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        return " ⁇ ".encode() if kind == UNKNOWN else piece.replace(MARK, " ").encode()

    def segment(self, s: str) -> bytes:
        """Little-endian ids by forward Viterbi; a later candidate must be strictly better, so the earliest start keeps a tie."""
        text, scores, unknown = s.encode(), self.v.scores, self.v.unknown
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        n, low, at = len(text), float("-inf"), 0
        best, start, piece = [low] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for ch in s:
            here, k, state, end, single = best[at], at, 0, at + (1 if ch < "\x80" else len(ch.encode())), False
            while k < n:
                t = base[state] + text[k] + 1
                if check[t] != state:
                    break
                state, k, i = t, k + 1, value[t]
                if i >= 0:
                    total = here + scores[i]
                    if total > best[k]:
                        best[k], start[k], piece[k] = total, at, i
                    if k == end:
                        single = True
            if not single and here + unknown > best[end]:
                best[end], start[end], piece[end] = here + unknown, at, -1
            at = end
        out: list[int] = []
        while n:
            begin, i = start[n], piece[n]
            if i >= 0:
                out.append(i)
            elif self.v.byte_fallback:
                out += [self.v.byte_ids[c] for c in reversed(text[begin:n])]
            else:
                out.append(self.v.unknown_id)
            n = begin
        return np.array(out[::-1], "<u4").tobytes()

    def encode_bytes(self, text: str) -> bytes:
        return b"".join(self.segments(text))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Joins the surfaces; bytes that aren't UTF-8 become U+FFFD; the space of the dummy prefix goes."""
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.v.add_dummy_prefix and text[:1] == " " else text


@lru_cache(maxsize=2)
def codec(model_path: str) -> Codec:
    return Codec(model_path)


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, ids`` (array of int) for each row."""
    import pyarrow as pa

    schema = docs.select("doc_id").schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches):
        c = codec(model_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.encode(x.as_py()) for x in b.column(1)], pa.list_(pa.int32()))], ["doc_id", "ids"])
        c.segments.forget()

    return docs.select("doc_id", text_or_empty()).mapInArrow(released(run), schema)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give a null text."""
    import pyarrow as pa

    schema = encoded.select("doc_id").schema.add("text", "string")

    def run(batches):
        c = codec(model_path)
        for b in batches:
            texts = [None if x is None else c.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(released(run), schema)


def encode_digest(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, n_ids, ids_crc32, round_trip``: the ids' number, the CRC-32 of their little-endian
    32-bit form, and whether decoding gives the text again (markers in it read as spaces)."""
    import pyarrow as pa

    schema = docs.select("doc_id").schema.add("n_ids", "long").add("ids_crc32", "long").add("round_trip", "boolean")

    def run(batches):
        c = codec(model_path)
        for b in batches:
            n, crc, same = [], [], []
            for x in b.column(1):
                text = x.as_py()
                ids = c.encode_bytes(text)
                n.append(len(ids) // 4)
                crc.append(zlib.crc32(ids))
                same.append(c.decode(np.frombuffer(ids, "<u4").tolist()) == text.replace(MARK, " "))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_ids", "ids_crc32", "round_trip"])
        c.segments.forget()

    return docs.select("doc_id", text_or_empty()).mapInArrow(released(run), schema)

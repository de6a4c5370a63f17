"""Unigram vocabulary: pieces, log scores and the cutting of texts into independent segments.

The pieces come from a SentencePiece model file, whose path is a parameter; nothing is trained.
A unigram model keeps its own scores. For a model of another kind the stored scores are merge
ranks, not log probabilities, so a piece's log score is taken by Zipf's law from its place in the
vocabulary: ``-ln(place + 1)``, rounded to 1/64. Sums of such scores are exact in single
precision up to 2**18, so that the library's arithmetic (32-bit floats over the whole text) and
ours (64-bit floats a segment) agree to the bit, and ties are real ties.

Tie rule of the tokenizer: candidates are tried by ascending start, and a later one replaces an
earlier one only if it is strictly better; a character without a piece of its own may also be
taken as unknown, at the lowest score less 10, after the pieces that start there. With byte
fallback an unknown character counts as its UTF-8 bytes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import lru_cache

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
STEP = 64
#: Entries after which a worker's memo of segments is emptied; it bounds memory, not results.
MEMO = 400_000
#: Longer segments aren't kept in the memo.
MEMO_CHARS = 64


class Vocabulary:
    """Pieces with scores; ``scores`` of pieces that the lattice doesn't use are None."""

    def __init__(self, model_path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        self.pieces = [p.piece for p in model.pieces]
        self.types = [p.type for p in model.pieces]
        self.byte_fallback = bool(model.trainer_spec.byte_fallback)
        self.add_dummy_prefix = bool(model.normalizer_spec.add_dummy_prefix)
        if model.normalizer_spec.remove_extra_whitespaces or model.normalizer_spec.precompiled_charsmap:
            raise ValueError("only models with the identity normalizer, which keep white space, are supported")
        lattice = [i for i, t in enumerate(self.types) if t in (NORMAL, USER_DEFINED, UNUSED)]
        if model.trainer_spec.model_type == pb.TrainerSpec.UNIGRAM:
            stored = {i: float(model.pieces[i].score) for i in lattice}
        else:
            order = sorted(lattice, key=lambda i: (-model.pieces[i].score, i))
            stored = {i: -round(math.log(k + 1) * STEP) / STEP for k, i in enumerate(order, 1)}
        normal = [stored[i] for i in lattice if self.types[i] == NORMAL]
        low, high = min(normal, default=0.0), max(normal, default=0.0)
        self.unknown = low - UNKNOWN_PENALTY
        self.scores: list[float | None] = [None] * len(self.pieces)
        for i in lattice:
            user = self.types[i] == USER_DEFINED
            self.scores[i] = len(self.pieces[i].encode()) * high - 0.1 if user else stored[i]
        self.unknown_id = self.types.index(UNKNOWN)
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.types[i] == BYTE}
        used = [self.pieces[i] for i in lattice]
        #: Neighbouring characters within pieces. Where two others meet, every path has a node.
        self.pairs = {p[k : k + 2] for p in used for k in range(len(p) - 1)}
        self.splits_at_mark = not any(pair[0] != MARK == pair[1] for pair in self.pairs)
        self.splits_at_newline = not any("\n" in pair for pair in self.pairs)

    def lattice(self) -> list[tuple[int, str, float]]:
        return [(i, self.pieces[i], s) for i, s in enumerate(self.scores) if s is not None]

    def unigram_model(self) -> bytes:
        """The same pieces and scores as a serialized unigram model, for comparison with the library."""
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        for piece, kind, score in zip(self.pieces, self.types, self.scores, strict=True):
            model.pieces.add(piece=piece, score=score or 0.0, type=kind)
        model.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
        model.trainer_spec.byte_fallback = self.byte_fallback
        model.normalizer_spec.name = "identity"
        model.normalizer_spec.add_dummy_prefix = self.add_dummy_prefix
        model.normalizer_spec.remove_extra_whitespaces = False
        return model.SerializeToString()


class Segmenter:
    """Cuts texts where no piece can cross, and remembers the value of each segment.

    ``value(segment)`` is called once for each distinct segment still in the memo; the values of
    a text's segments, in order, are its result. Values can be added up, as numbers or bytes.
    """

    def __init__(self, vocabulary: Vocabulary, value: Callable[[str], object]):
        self.v = vocabulary
        self.value = value
        self.words: dict[str, object] = {}
        self.others: dict[str, object] = {}
        self.parts: dict[str, object] = {}
        self.pattern = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.quick = vocabulary.splits_at_mark and vocabulary.splits_at_newline and vocabulary.add_dummy_prefix

    def forget(self) -> None:
        """At the end of a task: workers are used again, by operators that need the memory."""
        for memo in (self.words, self.others, self.parts):
            memo.clear()

    def _keep(self, memo: dict, key: str, made: object) -> object:
        if len(key) <= MEMO_CHARS:
            if len(memo) >= MEMO:
                memo.clear()
            memo[key] = made
        return made

    def _cut(self, s: str) -> object:
        """Sum over the parts of a segment between which no piece can cross."""
        pairs, parts, last, total = self.v.pairs, self.parts, 0, None
        for k in [k for k in range(1, len(s)) if s[k - 1 : k + 1] not in pairs] + [len(s)]:
            part, last = s[last:k], k
            made = parts.get(part)
            if made is None:
                made = self._keep(parts, part, self.value(part))
            total = made if total is None else total + made
        return total

    def _word(self, word: str) -> object:
        """Of a word after a space, or after a line feed that it begins with."""
        return self._keep(self.words, word, self._cut(word if word[:1] == "\n" else MARK + word))

    def __call__(self, text: str) -> list:
        if not text:
            return []
        if self.quick and MARK not in text:
            plain = text.replace("\n", " \n") if "\n" in text else text
            if "  " not in plain and plain[0] != " " and plain[-1] != " ":
                get, miss, out = self.words.get, self._word, []
                for word in plain.split(" "):
                    made = get(word)
                    out.append(miss(word) if made is None else made)
                return out
        marked = (MARK if self.v.add_dummy_prefix else "") + text.replace(" ", MARK)
        if not self.v.splits_at_mark:
            return [self._cut(marked)]
        out = []
        for segment in self.pattern.findall(marked):
            made = self.others.get(segment)
            out.append(self._keep(self.others, segment, self._cut(segment)) if made is None else made)
        return out


@lru_cache(maxsize=4)
def vocabulary(model_path: str) -> Vocabulary:
    return Vocabulary(model_path)

"""Token counts: count-only Viterbi over Aho-Corasick matches of a unigram vocabulary.

Defined results: a null or empty text has 0 tokens; a null doc_id stays null; repeated rows each
give a row; of equal scores the library's rule decides; an empty table gives no rows; only
``doc_id`` and ``text`` are read, so further columns play no part, whatever their names. Very long
texts are cut only where no piece can cross, so their counts are whole.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame

from veldra.llm.common import released, text_or_empty
from veldra.llm.unigram import Segmenter, vocabulary


class PieceCounter:
    """Number of pieces of the best segmentation, without keeping the path."""

    def __init__(self, model_path: str):
        import ahocorasick

        self.v = vocabulary(model_path)
        self.automaton = ahocorasick.Automaton()
        for _, piece, score in self.v.lattice():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.segments = Segmenter(self.v, self.segment)

    def segment(self, s: str) -> int:
        """Carries the best score and its piece count at every end.

        The automaton reports the matches of an end longest first, that is by ascending start;
        with a strict comparison the earliest start keeps a tie.
        """
        ends: list[list] = [[] for _ in s]
        for end, match in self.automaton.iter(s):
            ends[end].append(match)
        unknown, fallback, low = self.v.unknown, self.v.byte_fallback, float("-inf")
        best, count = [0.0], [0]
        for e, matches in enumerate(ends):
            top, pieces, single = low, 0, False
            for length, score in matches:
                start = e + 1 - length
                total = best[start] + score
                if total > top:
                    top, pieces = total, count[start] + 1
                single = single or length == 1
            if not single and (total := best[e] + unknown) > top:
                top, pieces = total, count[e] + (len(s[e].encode()) if fallback else 1)
            best.append(top)
            count.append(pieces)
        return count[-1]

    def __call__(self, text: str) -> int:
        return sum(self.segments(text))


@lru_cache(maxsize=2)
def counter(model_path: str) -> PieceCounter:
    return PieceCounter(model_path)


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, n_tokens`` for each row; ``model_path`` is a SentencePiece model that executors can open."""
    import pyarrow as pa

    schema = docs.select("doc_id").schema.add("n_tokens", "long")

    def run(batches):
        count = counter(model_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([count(x.as_py()) for x in b.column(1)], pa.int64())], ["doc_id", "n_tokens"])
        count.segments.forget()

    return docs.select("doc_id", text_or_empty()).mapInArrow(released(run), schema)

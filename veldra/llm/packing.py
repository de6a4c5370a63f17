"""Packing by minimum bin slack: subset-sum dynamic programming fills each window of tokens.

Every document's ids (with an end id) are cut into whole windows and a rest. The rests' lengths
are counted: at most ``window - 1`` numbers, whatever the corpus. For the longest length left, a
bitset subset-sum program over the multiset of the others finds the lengths that fill its window
closest to capacity; backtracking gives how many of each. A filling without slack is used as many
times over as the counts allow. If the closest filling has slack, no later one has less, for the
multiset only shrinks: those rests join a stream that is cut at every window's end, and its last,
incomplete window is cut into sequences whose lengths are powers of two. So nothing is padded.

Only numbers go to the driver; which row fills which place follows from its rank among the rows
of its length. Rests that the stream cuts are tokenized again for the checksums of their pieces.

Defined results: a null text is empty, and an empty one is its end id alone; texts of any length are
packed whole; repeated rows are packed each; rests of one length are interchangeable, so which of
them fills a place may differ between runs; a null doc_id stays null; empty tables give no pieces;
other columns play no part, whatever their names.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldra.llm.common import checkpoint, released, text_or_empty
from veldra.llm.ranking import positioned
from veldra.llm.word_bpe import MEMO, SMALL_MEMO, word_tokenizer

WINDOW = 4096
END_ID = 2
#: Cut rests up to this number are broadcast to find their texts; more are joined by a shuffle.
BROADCAST_ROWS = 50_000
PIECES = "doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset"


def fill(counts: dict[int, int], room: int) -> tuple[int, dict[int, int]]:
    """The largest sum of up to ``room`` from the multiset, and how many of each length make it.

    Lengths are tried from the longest, so that short ones are kept for later windows; the
    program ends as soon as the room can be filled whole.
    """
    lengths = sorted((x for x, n in counts.items() if n > 0 and x <= room), reverse=True)
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for x in lengths:
        steps.append((x, reach))
        n, k = min(counts[x], room // x), 1
        while n > 0:
            take = min(k, n)
            reach |= (reach << (x * take)) & mask
            n -= take
            k *= 2
        if reach >> room & 1:
            break
    best = rest = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for x, before in reversed(steps):
        k = 0
        while not before >> rest & 1:
            rest -= x
            k += 1
        if k:
            chosen[x] = k
    return best, chosen


@dataclass
class Plan:
    """Places of ranks: entry k holds the ranks of length ``length[k]`` from ``first[k]`` up to ``end[k]``."""

    length: np.ndarray
    first: np.ndarray
    end: np.ndarray
    each: np.ndarray  # in a window
    sequence: np.ndarray  # of the first
    offset: np.ndarray
    windows: int
    left: dict[int, int]  # first rank of each length that the stream takes

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of each; sequence -1: in the stream."""
        sequence, offset = np.full(len(length), -1, np.int64), np.zeros(len(length), np.int64)
        if not len(self.length):
            return sequence, offset
        lo, hi = np.zeros(len(length), np.int64), np.full(len(length), len(self.length), np.int64)
        while (open_ := lo < hi).any():  # the last entry that isn't beyond (length, rank)
            mid = (lo + hi) // 2
            at = np.minimum(mid, len(self.length) - 1)
            below = open_ & ((self.length[at] < length) | ((self.length[at] == length) & (self.first[at] <= rank)))
            lo, hi = np.where(below, mid + 1, lo), np.where(open_ & ~below, mid, hi)
        k = np.maximum(lo - 1, 0)
        ok = (lo > 0) & (self.length[k] == length) & (rank < self.end[k])
        j = rank - self.first[k]
        sequence[ok] = (self.sequence[k] + j // self.each[k])[ok]
        offset[ok] = (self.offset[k] + j % self.each[k] * length)[ok]
        return sequence, offset


def plan(counts: dict[int, int], window: int = WINDOW) -> Plan:
    """Fills windows from the counts of rests; the entries are at most windows of distinct fillings."""
    left = {x: n for x, n in counts.items() if n > 0}
    used, windows = dict.fromkeys(left, 0), 0
    entries, stream = [], {}
    for longest in sorted(left, reverse=True):
        while left[longest] > 0:
            left[longest] -= 1
            total, chosen = fill(left, window - longest)
            left[longest] += 1
            if total != window - longest:
                stream[longest] = used[longest]
                left[longest] = 0
                break
            chosen[longest] = chosen.get(longest, 0) + 1
            times, at = min(left[x] // k for x, k in chosen.items()), 0
            for x, k in sorted(chosen.items(), reverse=True):
                entries.append((x, used[x], used[x] + times * k, k, windows, at))
                used[x] += times * k
                left[x] -= times * k
                at += x * k
            windows += times
    table = np.array(sorted(entries), np.int64).reshape(-1, 6).T
    return Plan(*table, windows, stream)


def stream_cuts(position: int, length: int, total: int, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(sequence in the stream, offset in it, length) of the pieces of ``length`` tokens at ``position``.

    Whole windows end at multiples of the window; the tokens after the last one are cut into
    powers of two, the largest first.
    """
    whole, rest = total // window, total % window
    out, end = [], position + length
    while position < end:
        if position < whole * window:
            sequence, begin, size = position // window, position // window * window, window
        else:
            sequence, begin, left = whole, whole * window, rest
            size = 1 << (left.bit_length() - 1)
            while position >= begin + size:
                begin, left, sequence = begin + size, left - size, sequence + 1
                size = 1 << (left.bit_length() - 1)
        take = min(end, begin + size) - position
        out.append((sequence, position - begin, take))
        position += take
    return out


def portions(texts, chars: int = 1 << 20):
    """Lists of texts of about so many characters, or of one longer text."""
    some, size = [], 0
    for x in texts:
        some.append(x.as_py())
        size += len(some[-1])
        if size >= chars:
            yield some
            some, size = [], 0
    if some:
        yield some


def _tokenize(docs: DataFrame, tokenizer_path: str, window: int, end_id: int, remember: bool) -> DataFrame:
    """``doc_id, text_hash, doc_tokens, rest, wholes, crcs, rest_crc, uid``: numbers only, no ids."""
    import pyarrow as pa

    schema = docs.select("doc_id").schema.add("text_hash", "long").add("doc_tokens", "long").add("rest", "long").add("wholes", "long").add("crcs", T.ArrayType(T.LongType())).add("rest_crc", "long")
    tail, step = np.array([end_id], "<u4").tobytes(), 4 * window

    def run(batches):
        tokenizer = word_tokenizer(tokenizer_path, MEMO if remember else SMALL_MEMO)

        def encoded(texts):
            for some in portions(texts):
                for ids in tokenizer.batch(some):
                    yield ids + tail

        for b in batches:
            n, crcs, rest_crc = [], [], []
            for ids in encoded(b.column(2)):
                whole = len(ids) // step * step
                n.append(len(ids) // 4)
                crcs.append([zlib.crc32(ids[k : k + step]) for k in range(0, whole, step)])
                rest_crc.append(zlib.crc32(ids[whole:]))
            total = np.array(n, np.int64)
            columns = [b.column(0), b.column(1), pa.array(total), pa.array(total % window), pa.array(total // window), pa.array(crcs, pa.list_(pa.int64())), pa.array(rest_crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])
        if not remember:
            tokenizer.forget()

    text = text_or_empty()
    made = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(released(run), schema)
    return made.withColumn("uid", F.monotonically_increasing_id())


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, remember: bool = False) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``: a row for each piece.

    With ``remember`` workers keep the words they know from task to task: a quarter less time, for
    up to about 150 MB a worker that later operators go without.
    """
    import pyarrow as pa

    numbers = checkpoint(_tokenize(docs, tokenizer_path, window, end_id, remember))
    counts = {r["rest"]: r["n"] for r in numbers.groupBy("rest").agg(F.count("*").alias("n")).collect()}  # one for each length at most
    made = plan({x: n for x, n in counts.items() if x}, window)
    firsts, at = {}, 0
    for x in sorted(counts):
        firsts[x], at = at, at + counts[x]
    bases, total = {}, 0
    for x in sorted(made.left, reverse=True):
        bases[x] = total
        total += (counts[x] - made.left[x]) * x
    last_sequences = total // window + (total % window).bit_count()
    first_whole = made.windows + last_sequences
    schema = docs.select("doc_id").schema
    for name in PIECES.split(", ")[1:]:
        schema = schema.add(name, "long")
    names = [f.name for f in schema.fields]
    id_type = pa.array([], pa.int64()).type

    ranked = positioned(numbers, "rest", "uid", sums=("wholes",))

    def located(b):
        """Rank, stream position and places of a batch's rests."""
        rest = b.column(b.schema.get_field_index("rest")).to_numpy().astype(np.int64)
        rank = b.column(b.schema.get_field_index("position")).to_numpy() - np.array([firsts[int(x)] for x in rest], np.int64)
        sequence, offset = made.place(rest, rank)
        return rest, rank, sequence, offset

    def stream_position(x: int, rank: int) -> int:
        return bases[x] + (rank - made.left[x]) * x

    def pieces(batches):
        for b in batches:
            rest, rank, sequence, offset = located(b)
            tokens = b.column(b.schema.get_field_index("doc_tokens")).to_numpy()
            before = b.column(b.schema.get_field_index("before_wholes")).to_numpy()
            crcs = b.column(b.schema.get_field_index("crcs")).to_pylist()
            rest_crc = b.column(b.schema.get_field_index("rest_crc")).to_numpy()
            rows, out = [], []
            for k in range(b.num_rows):
                for j, crc in enumerate(crcs[k]):
                    rows.append(k)
                    out.append((j * window, window, crc, tokens[k], first_whole + before[k] + j, 0))
                x = int(rest[k])
                if not x:
                    continue
                if sequence[k] >= 0:
                    where = [(sequence[k], offset[k], x)]
                else:
                    cuts = stream_cuts(stream_position(x, int(rank[k])), x, total, window)
                    where = [(made.windows + s, o, n) for s, o, n in cuts] if len(cuts) == 1 else []
                for s, o, n in where:
                    rows.append(k)
                    out.append((tokens[k] - x, n, rest_crc[k], tokens[k], s, o))
            table = np.array(out, np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, id_type)), *[pa.array(table[:, c]) for c in range(6)]], names)

    def cut_rows(batches):
        for b in batches:
            rest, rank, sequence, _ = located(b)
            rows, where = [], []
            for k in np.flatnonzero((sequence < 0) & (rest > 0)):
                cuts = stream_cuts(stream_position(int(rest[k]), int(rank[k])), int(rest[k]), total, window)
                if len(cuts) > 1:
                    rows.append(k)
                    where.append([v for cut in cuts for v in cut])
            picked = pa.array(rows, id_type)
            yield pa.RecordBatch.from_arrays([b.column(0).take(picked), b.column(1).take(picked), pa.array(where, pa.list_(pa.int64()))], ["cut_id", "cut_hash", "cuts"])

    whole = ranked.mapInArrow(released(pieces), schema)
    if not total:
        return whole
    cut = ranked.select("doc_id", "text_hash", "rest", "position").where("rest > 0").mapInArrow(released(cut_rows), docs.select(F.col("doc_id").alias("cut_id")).schema.add("cut_hash", "long").add("cuts", T.ArrayType(T.LongType())))
    cut = checkpoint(cut)
    keys = cut.select("cut_id", "cut_hash").distinct()
    small = total // window + 16 <= BROADCAST_ROWS
    text = text_or_empty()
    texts = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))
    match = lambda a: F.col("doc_id").eqNullSafe(a["cut_id"]) & (F.col("text_hash") == a["cut_hash"])
    found = texts.join(F.broadcast(keys) if small else keys, match(keys), "left_semi").dropDuplicates(["doc_id", "text_hash"])
    both = found.join(F.broadcast(cut) if small else cut, match(cut)).select("doc_id", "text", "cuts")
    tail = np.array([end_id], "<u4").tobytes()

    def again(batches):
        tokenizer = word_tokenizer(tokenizer_path, MEMO if remember else SMALL_MEMO)
        for b in batches:
            rows, out = [], []
            for k, (x, cuts) in enumerate(zip(b.column(1), b.column(2).to_pylist(), strict=True)):
                ids = tokenizer.batch([x.as_py()])[0] + tail
                n = len(ids) // 4
                start = n - n % window
                for j in range(0, len(cuts), 3):
                    s, o, size = cuts[j : j + 3]
                    rows.append(k)
                    out.append((start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), n, made.windows + s, o))
                    start += size
            table = np.array(out, np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, id_type)), *[pa.array(table[:, c]) for c in range(6)]], names)
        tokenizer.forget()

    return whole.unionByName(both.mapInArrow(released(again), schema))

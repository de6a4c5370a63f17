"""SimHash near-duplicates: 64-bit fingerprints linked by pigeonring filtering.

Fingerprints: XXH64 (seed 42) of every shingle of four words, repeats included; a bit is 1 if set
in over half of the hashes. Two fingerprints link at ``distance`` or fewer differing bits.

Pigeonring: the bits are cut into ``distance + 1`` segments on a ring. If two fingerprints differ
in at most ``distance`` bits, some segment starts a chain in which, for every length l, the first
l segments differ in at most floor(l * distance / (distance + 1)) = l - 1 bits. So the first segment
is equal, and of the second at most one bit differs: one of its halves is equal. A key is made of
what is equal in the first two, three or four segments of a chain, for each way of spending the
budgets: 2, 5 or 15 keys a chain, of about 19, 26 or 32 bits. The number of fingerprints decides
how many segments, so that a key has few at any size (``CROWD``). The further budgets of the chain
prune candidates before the full Hamming check. Every pair within the distance meets under some
key, so no link is lost.

Defined results: null and empty texts have fingerprint zero, which links like any other; texts of
fewer than four words are one shingle; texts of any length are read whole, ``CHUNK`` shingles at a
time; repeated rows each give a row; a null doc_id stays null and is never a component's id unless
all its rows have none; an empty table gives no rows; only ``doc_id`` and ``text`` are read, and other
columns of the rows that stay are as they were, whatever their names.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldra.llm.common import checkpoint, free_name, released, text_or_empty
from veldra.llm.components import connected

WORDS = 4
SEED = 42
DISTANCE = 4
#: Fingerprints of one key that a task compares; larger groups are dealt out as pairs of blocks.
BLOCK = 2048
#: Shingles hashed at a time.
CHUNK = 1 << 16
#: Keys of rows to drop that are broadcast at most.
BROADCAST_KEYS = 200_000
#: Keys are made of more segments when one would have more fingerprints than this on average.
CROWD = 64
#: Up to this many fingerprints of a key are compared by shifts, more by search.
SHORT_RUN = 24


def fingerprint(text: str) -> int:
    """Of one text, as an unsigned number."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    step = partial(xxhash.xxh64_intdigest, seed=SEED)
    last = max(1, len(words) - WORDS + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, last, CHUNK):
        end = min(last, at + CHUNK)
        columns = [words[at + k : end + k] for k in range(WORDS)] if len(words) >= WORDS else [[w] for w in words]
        h = np.fromiter(map(step, map(b" ".join, zip(*columns, strict=True))), np.uint64, end - at)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((ones * 2 > last).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, fp`` (signed long) for each row; text_hash tells apart rows of one doc_id."""
    import pyarrow as pa

    schema = docs.select("doc_id").schema.add("text_hash", "long").add("fp", "long")

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(x.as_py()) for x in b.column(2)), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], ["doc_id", "text_hash", "fp"])

    text = text_or_empty()
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(released(run), schema)


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment."""
    m = distance + 1
    edges = [round(64 * k / m) for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def chain_masks(start: int, distance: int) -> list[tuple[np.uint64, int]]:
    """(bits of the first l segments from ``start`` on, their budget) for l from 1 to all."""
    parts, mask, out = segments(distance), 0, []
    for k in range(distance + 1):
        at, width = parts[(start + k) % len(parts)]
        mask |= ((1 << width) - 1) << at
        out.append((np.uint64(mask), (k + 1) * distance // (distance + 1)))
    return out


def _bits(at: int, width: int) -> Column:
    return F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def spendings(length: int) -> list[tuple[int, ...]]:
    """Most differing bits of the second to the ``length``-th segment of a chain, in every way that uses the budgets up.

    What differs in a chain is in each segment at most what one of these allows.
    """
    out: list[tuple[int, ...]] = [()]
    for k in range(1, length):
        out = [(*x, n) for x in out for n in range(k - sum(x) + 1)]
    return [x for x in out if sum(x) == length - 1]


def key_parts(distance: int, length: int) -> list[list[tuple[int, int]]]:
    """For each key of each chain in turn, the (first bit, width) of what must be equal.

    A segment with no differing bit is equal; of one with a single bit one half is; others say nothing.
    """
    parts, out = segments(distance), []
    for i in range(len(parts)):
        for spent in spendings(length):
            found = [[parts[i]]]
            for k, n in enumerate(spent, 1):
                at, width = parts[(i + k) % len(parts)]
                low = width // 2
                ways = [[(at, width)]] if n == 0 else [[(at, low)], [(at + low, width - low)]] if n == 1 else [[]]
                found = [f + w for f in found for w in ways]
            out += found
    return out


def key_length(fingerprints: int, distance: int) -> int:
    """Segments of a chain that the keys look at."""
    length = 2
    while length < min(4, distance + 1) and fingerprints > CROWD * 2 ** min(sum(w for _, w in p) for p in key_parts(distance, length)):
        length += 1
    return length


def _keys(distance: int, length: int) -> Column:
    """Array of keys: the number of the key in the low bits, the equal bits above them."""
    kinds = key_parts(distance, length)
    out = []
    for number, found in enumerate(kinds):
        key = F.lit(0).cast("long")
        for at, width in found:
            key = key * (1 << width) + _bits(at, width)
        out.append(key * len(kinds) + number)
    return F.array(*out)


def _within(x: np.ndarray, chain: list[tuple[np.uint64, int]]) -> np.ndarray:
    """Places whose differences stay in every budget of the chain; the last one is the full Hamming check."""
    at = np.arange(len(x))
    for mask, budget in chain:
        at = at[np.bitwise_count(x[at] & mask) <= budget]
    return at


def _search(fps: np.ndarray, chain: list[tuple[np.uint64, int]], out: list[np.ndarray]) -> None:
    """Links that connect what the chain connects: each fingerprint is reached once, so n - 1 at most."""
    rest = fps
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            here = frontier.pop()
            near = _within(rest ^ here, chain)
            if len(near):
                found = rest[near]
                out.append(np.stack([np.full(len(found), here), found]))
                frontier.extend(found)
                rest = np.delete(rest, near)


def _links(keys: np.ndarray, fps: np.ndarray, chains: list, kinds: int, out: list[np.ndarray]) -> None:
    """Of whole runs of equal keys, sorted; ``kinds`` is the number of keys of all chains."""
    each = kinds // len(chains)
    edges = np.flatnonzero(np.diff(keys)) + 1
    starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(keys)]])
    sizes = ends - starts
    for s, e in zip(starts[sizes > SHORT_RUN], ends[sizes > SHORT_RUN], strict=True):
        _search(np.unique(fps[s:e]), chains[int(keys[s] % kinds) // each], out)
    short = np.repeat(sizes <= SHORT_RUN, sizes)
    keys, fps = keys[short], fps[short]
    start_of = (keys % kinds) // each
    for d in range(1, SHORT_RUN):
        same = np.flatnonzero(keys[d:] == keys[:-d])
        if not len(same):
            return
        for i, chain in enumerate(chains):
            at = same[start_of[same] == i]
            near = at[_within(fps[at] ^ fps[at + d], chain)]
            if len(near):
                out.append(np.stack([fps[near], fps[near + d]]))


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``a, b``: pairs of distinct fingerprints within the distance that connect all such pairs.

    A key's fingerprints are searched, each reached once, so that large groups give few pairs. A
    key with over BLOCK of them is dealt out as pairs of blocks, whose searches together see every
    pair: no group is gathered in one task, and none is cut short.
    """
    import pyarrow as pa

    if not distance:
        return fps.sparkSession.createDataFrame([], "a long, b long")
    chains = [chain_masks(i, distance) for i in range(distance + 1)]
    distinct = fps.select("fp").distinct()
    length = key_length(distinct.count(), distance)
    kinds = len(key_parts(distance, length))
    keyed = distinct.select("fp", F.explode(_keys(distance, length)).alias("key"))
    crowded = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = keyed.join(crowded, "key", "left").withColumn("mine", F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))).cast("int"))
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", "fp", "mine", other.alias("other")).select("key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "fp")

    def run(batches):
        held = None
        for b in batches:
            now = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)])
            now = now if held is None else np.concatenate([held, now], axis=1)
            if not now.shape[1]:
                continue
            last = np.flatnonzero((now[:3] != now[:3, -1:]).any(axis=0))
            cut = last[-1] + 1 if len(last) else 0
            held = now[:, cut:]
            yield from found(now[:, :cut])
        if held is not None:
            yield from found(held)

    def found(now):
        out: list[np.ndarray] = []
        if now.shape[1] > 1:
            edges = np.flatnonzero((np.diff(now[1:3], axis=1) != 0).any(axis=0)) + 1
            for part in np.split(now, edges, axis=1) if len(edges) else [now]:
                _links(part[0], part[3].view(np.uint64) if part[3].flags.c_contiguous else np.ascontiguousarray(part[3]).view(np.uint64), chains, kinds, out)
        if out:
            pairs = np.concatenate(out, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[0])), pa.array(np.ascontiguousarray(pairs[1]))], ["a", "b"])

    return dealt.repartition("key", "lo", "hi").sortWithinPartitions("lo", "hi", "key").mapInArrow(released(run), "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``doc_id, text_hash, fingerprint, component_id, stays``: a row for each of ``docs``.

    ``component_id`` is the least doc_id of the component; ``stays`` marks the row (or the equal
    repeated rows) of the least doc_id and text_hash.
    """
    each = checkpoint(fingerprints(docs))
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("text_hash").alias("text_hash"))
    nodes = each.groupBy("fp").agg(F.min(first).alias("first"))
    roots = connected(links(each, distance))
    # Both sides of the last joins are read anew, so that Spark can split a large group's partition.
    rooted = checkpoint(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = checkpoint(rooted.groupBy("root").agg(F.min("first").alias("least")))
    of = checkpoint(rooted.select("fp", "root").join(least, "root").select("fp", "least"))
    return each.join(of, "fp").select(
        "doc_id",
        "text_hash",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("least.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash"))).alias("stays"),
    )


def deduplicate(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one row of each component: that of the least doc_id, and of repeated rows one."""
    return keep_staying(docs, near_duplicates(docs, distance))


def keep_staying(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the rows that stay by ``found`` (``doc_id, text_hash, stays``), and of repeated rows one.

    Rows are known by doc_id and text hash. Up to BROADCAST_KEYS keys to act on are broadcast, so
    that no text is shuffled; more meet the texts by one shuffle.
    """
    key, n = free_name(docs.columns, "row_key"), free_name(docs.columns, "row_number")
    of = lambda i, h: F.struct(F.col(i).alias("i"), h.alias("h"))  # noqa: E731  in it null equals null
    keys = found.groupBy(of("doc_id", F.col("text_hash")).alias("k")).agg(F.first("stays").alias("stays"), F.count("*").alias("n"))
    keys = checkpoint(keys)
    acted = keys.where("not stays or n > 1")
    rows = docs.withColumn(key, of("doc_id", F.xxhash64(text_or_empty())))
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    first = lambda x: x.withColumn(n, F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*others, F.lit(0))))).where(F.col(n) == 1).drop(n)
    met = lambda k: rows[key] == k["k"]
    if acted.count() > BROADCAST_KEYS:
        stays = keys.where("stays").select("k")
        return first(rows.join(stays, met(stays), "left_semi")).drop(key)
    acted = F.broadcast(acted.select("k"))
    once = rows.join(acted, met(acted), "left_anti")
    repeated = keys.where("stays and n > 1").select("k")
    if repeated.isEmpty():
        return once.drop(key)
    repeated = F.broadcast(repeated)
    return once.union(first(rows.join(repeated, met(repeated), "left_semi"))).drop(key)

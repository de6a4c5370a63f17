"""Near copies for the pipeline: SimHash links, and texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Two texts of that similarity differ in 9.7 of 64 fingerprint bits on average, so the links of op9 (4
bits, by pigeonring filtering) find a part of them only, and a radius that held nearly all, 19 bits,
would leave pigeonring keys of three bits. So the links of op9 are joined by those that MinHash
bands retrieve: ``BANDS`` keys of ``ROWS`` minima each, so that a pair of the least similarity shares
none with a probability of (1 - 0.8**5)**35 = 9e-7. What the bands retrieve is verified on the
whole sets, so no text is taken for a copy by them that isn't one. Groups are the components of
both kinds of links.

The texts of a key are compared pair by pair. If they are over ``SHORT``, they are first compared
with one of them, a centre; a large group of near copies becomes one component by that, in links
as many as its texts. Crowded keys whose texts aren't in one component then come from passages that
many texts share. Their texts meet by prefix filtering, which is exact: with each set's shingles in
order of rising frequency, two similar sets have one in common among their first n - 0.8 n + 1. Shared
passages are frequent and so come last, and no key's texts are compared pair by pair.

Defined results: words are parted by white space, in lower case (ASCII) as in the fingerprints of
op9; texts of fewer than five words are one shingle; texts without words are copies of each other;
texts of any length are read whole; shingles are known by 64-bit hashes; of a group, the row of
the least doc_id and text hash stays; a null doc_id stays null; an empty table gives no rows; only
``doc_id`` and ``text`` are read, and other columns stay, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from veldra.llm import simhash
from veldra.llm.common import checkpoint, drop_unreferenced, released, text_or_empty
from veldra.llm.components import connected

SHINGLE = 5
#: The least similarity, as a fraction.
SIMILAR = (4, 5)
BANDS, ROWS = 35, 5
#: Texts of a key that are compared pair by pair at once.
SHORT = 24
#: Centres that a group of texts may have over all its keys.
CENTRES = 4
SEED = 9
#: Shingles whose minima are taken at a time.
CHUNK = 1 << 13

_RNG = np.random.default_rng(SEED)
_TIMES = _RNG.integers(1, 2**31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
_FLIP = _RNG.integers(0, 2**32, BANDS * ROWS, np.uint32)
_MIX = [np.uint64(int(x) | 1) for x in _RNG.integers(0, 2**63, SHINGLE, np.uint64)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    import xxhash

    words = text.encode().lower().split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if not len(h):
        return h
    n = max(1, len(h) - SHINGLE + 1)
    out = np.full(n, min(len(h), SHINGLE), np.uint64)
    for k in range(min(len(h), SHINGLE)):
        out = _mixed((out + h[k : k + n]) * _MIX[k])
    return np.unique(out)


def bands(s: np.ndarray) -> np.ndarray:
    """Keys of a set; none for the empty one."""
    if not len(s):
        return np.zeros(0, np.int64)
    low, least = (s >> np.uint64(32)).astype(np.uint32), np.full(len(_TIMES), 2**32 - 1, np.uint32)
    for at in range(0, len(low), CHUNK):
        part = low[at : at + CHUNK]
        for k in range(len(least)):
            least[k] = min(least[k], ((part ^ _FLIP[k]) * _TIMES[k]).min())
    rows, key = least.reshape(BANDS, ROWS).astype(np.uint64), np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = _mixed((key + rows[:, k]) * _MIX[k])
    return key.view(np.int64)


def _node(s: np.ndarray) -> int:
    """Number of a set, equal for equal sets."""
    import xxhash

    return xxhash.xxh64_intdigest(s.tobytes(), seed=SEED) - 2**63


def _read(docs: DataFrame, whole: bool) -> DataFrame:
    """``doc_id, text_hash, node, n, fp, hashes`` for each row: the size of the set, the fingerprint (0 if ``whole``), and the set's bands or the whole set."""
    import pyarrow as pa

    schema = docs.select("doc_id").schema.add("text_hash", "long").add("node", "long").add("n", "long").add("fp", "long").add("hashes", ArrayType(LongType()))
    names = [f.name for f in schema.fields]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                texts = [x.as_py() for x in part.column(2)]
                sets = [shingles(x) for x in texts]
                values = [s.view(np.int64) if whole else bands(s) for s in sets]
                fps = np.zeros(len(texts), np.int64) if whole else np.fromiter(map(simhash.fingerprint, texts), np.uint64, len(texts)).view(np.int64)
                hashes = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(np.concatenate(values)))
                columns = [part.column(0), part.column(1), pa.array([_node(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps), hashes]
                yield pa.RecordBatch.from_arrays(columns, names)

    text = text_or_empty()
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(released(run), schema)


def _row(i: str, h: Column) -> Column:
    """A row's key, in which null equals null."""
    return F.struct(F.col(i).alias("i"), h.alias("h"))


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, n, hashes`` of the rows whose keys are ``wanted``."""
    rows = docs.select("doc_id", "text").withColumn("k", _row("doc_id", F.xxhash64(text_or_empty())))
    few = wanted.count() <= simhash.BROADCAST_KEYS
    chosen = rows.join(F.broadcast(wanted) if few else wanted, "k", "left_semi")
    return checkpoint(_read(chosen, True).select("node", "n", "hashes").dropDuplicates(["node"]))


def _sized(a: str, b: str) -> Column:
    """Sets of sizes that allow the similarity."""
    p, q = SIMILAR
    return F.least(F.col(a), F.col(b)) * q >= F.greatest(F.col(a), F.col(b)) * p


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``a, b`` whose whole sets are similar."""
    p, q = SIMILAR
    x = sets.select(F.col("node").alias("a"), F.col("n").alias("an"), F.col("hashes").alias("ah"))
    y = sets.select(F.col("node").alias("b"), F.col("n").alias("bn"), F.col("hashes").alias("bh"))
    both = pairs.join(x, "a").join(y, "b").withColumn("common", F.size(F.array_intersect("ah", "bh")))
    return checkpoint(both.where(F.col("common") * (p + q) >= (F.col("an") + F.col("bn")) * p).select("a", "b"))


def _pairs(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _simhash_links(each: DataFrame) -> DataFrame:
    """``a, b``: the links of op9, and of equal fingerprints, between nodes. A fingerprint is known by its least node."""
    known = checkpoint(each.select("fp", "node").distinct())
    least = known.groupBy("fp").agg(F.min("node").alias("least"))
    same = known.join(least, "fp").where("node <> least").select(*_pairs("node", "least"))
    of = lambda x: least.select(F.col("fp").alias(x), F.col("least").alias(f"{x}_node"))
    linked = simhash.links(known).join(of("a"), "a").join(of("b"), "b").where("a_node <> b_node")
    return same.union(linked.select(*_pairs("a_node", "b_node")))


def _prefix_pairs(texts: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b``: of ``texts`` (``node, root``), those of different roots whose prefixes share a shingle, at places and of sizes that allow the similarity."""
    p, q = SIMILAR
    each = checkpoint(texts.join(sets, "node").select("node", "root", "n", F.explode("hashes").alias("shingle")))
    times = each.groupBy("shingle").agg(F.count("*").alias("times"))
    rarest = Window.partitionBy("node").orderBy("times", "shingle")
    ranked = each.join(times, "shingle").withColumn("r", F.row_number().over(rarest))
    prefix = checkpoint(ranked.where((F.col("r") <= F.col("n") - F.ceil(F.col("n") * p / q) + 1) & (F.col("times") > 1)).select("node", "root", "n", "r", "shingle"))
    other = prefix.select("shingle", F.col("node").alias("other"), F.col("root").alias("oroot"), F.col("n").alias("on"), F.col("r").alias("more"))
    # before the first shingle that two sets have in common, neither has one of the other's
    room = F.least(F.col("n") - F.col("r"), F.col("on") - F.col("more")) + 1
    met = prefix.join(other, "shingle").where((F.col("node") < F.col("other")) & (F.col("root") != F.col("oroot")) & _sized("n", "on") & (room * (p + q) >= (F.col("n") + F.col("on")) * p))
    return met.select(*_pairs("node", "other")).distinct()


def groups(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, stays``: a row for each of ``docs``; one of each group stays, that of the least doc_id and text_hash."""
    each = checkpoint(_read(docs, False))
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("text_hash").alias("text_hash"))
    nodes = checkpoint(each.groupBy("node").agg(F.min(first).alias("first"), F.first("n").alias("n"), F.first("hashes").alias("hashes")))
    keyed = nodes.select("node", "n", F.explode("hashes").alias("key"))
    shared = checkpoint(keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"))
    members = checkpoint(keyed.join(shared, "key"))
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select(_row("first.doc_id", F.col("first.text_hash")).alias("k"))
    sets = _sets(docs, checkpoint(wanted))
    # all pairs of short keys; of crowded ones each text with a centre
    few, many = members.where(F.col("m") <= SHORT), members.where(F.col("m") > SHORT)
    centre = many.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.pmod("key", F.lit(CENTRES))).alias("h"), "node", "n")).alias("c"))
    starred = many.join(centre.select("key", F.col("c.node").alias("other"), F.col("c.n").alias("on")), "key").where((F.col("node") != F.col("other")) & _sized("n", "on"))
    other = few.select("key", F.col("node").alias("other"), F.col("n").alias("on"))
    paired = few.join(other, "key").where((F.col("node") < F.col("other")) & _sized("n", "on"))
    pairs = paired.select(*_pairs("node", "other")).union(starred.select(*_pairs("node", "other"))).distinct()
    roots = checkpoint(connected(_verified(checkpoint(pairs), sets).union(_simhash_links(each))))
    # of crowded keys, what isn't in one component yet
    apart = checkpoint(many.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    several = apart.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    apart = checkpoint(apart.join(several.select("key"), "key"))
    # their files go, but for those of the frames that are read again
    del shared, members, wanted, few, many, centre, starred, other, paired, pairs, several, keyed
    drop_unreferenced(docs.sparkSession)
    if not apart.isEmpty():
        found = _verified(checkpoint(_prefix_pairs(apart.select("node", "root").distinct(), sets)), sets)
        roots = connected(found.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    rooted = checkpoint(nodes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = checkpoint(rooted.groupBy("root").agg(F.min("first").alias("least")))
    of = checkpoint(rooted.select("node", "root").join(least, "root").select("node", "least"))
    stays = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash"))
    return each.join(of, "node").select("doc_id", "text_hash", stays.alias("stays"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies."""
    return simhash.keep_staying(docs, groups(docs))

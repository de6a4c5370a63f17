"""Quality: hierarchical empirical Bayes over a document classifier, hosts and paths.

A logistic regression on a text's make-up, fitted on a bounded sample of labelled rows, gives
each document's probability of being good. Grouped aggregation gives each host's and path's
number of documents, sum and sum of squares of these. By the method of moments (nested analysis
of variance) the spread of paths within hosts and of hosts gives the weight of each level's beta
prior: a host's posterior mean is drawn toward the global one, and a path's toward its host's, the
more the fewer documents it has. For a document, the posterior of its path without the document
itself replaces the global mean as its prior:

    logit(document and site) = logit(document) + logit(path without it) - logit(global)

The host is the part of ``source`` up to the first slash (a scheme is passed over), the path
the part up to the second; a source without slash is its own path. Sums are of whole multiples of
2**-30, so they don't depend on the order of rows, and a decision near the threshold is the same each time.

Defined results: a null text is empty, and an empty one is scored like any other; texts of any
length are scored whole; a null source is a host of its own, as is the empty one; a probability
equal to ``KEEP`` keeps the document; without labels of both kinds every document has the global
mean 1/2 and is kept; repeated rows count each; of several rows of a labelled doc_id one is
learnt from; a null doc_id stays null; an empty table gives no rows; only ``doc_id``, ``text`` and
``source`` are read, and other columns stay, whatever their names.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldra.llm.common import checkpoint, free_name, release, settle, text_or_empty
from veldra.llm.labelled import SAMPLE, logistic, sample

#: A document is rejected if its probability of being good is below this.
KEEP = 0.5
#: Probabilities are summed in whole multiples of its inverse.
UNIT = 1 << 30
#: Least variance of a level, and least weight of its prior.
LEAST_SPREAD, LEAST_WEIGHT = 1e-6, 1.0
#: Copies of a site's row when sites are joined by a shuffle, since one may hold a third of all documents.
SALTS = 32
#: The classifier's log odds are limited to this on either side, so that no text is beyond its site.
CLIP = 12.0
#: Sites up to this number are broadcast to the documents; more are joined by a shuffle.
BROADCAST_SITES = 200_000
_SYMBOLS = np.frombuffer(b"#$%&*@~^=<>{}[]\\/_+", np.uint8)
_ZLIB_CHUNK = 1 << 20


def features(text: str) -> list[float]:
    data = text.encode()
    n = max(len(data), 1)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower, digits = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    words, lines = text.split(), text.split("\n")
    k = max(len(words), 1)
    repeats = sum(map(str.__eq__, words, words[1:]))
    pack = zlib.compressobj(1)
    packed = sum(len(pack.compress(data[a : a + _ZLIB_CHUNK])) for a in range(0, len(data), _ZLIB_CHUNK)) + len(pack.flush())
    return [
        float(upper / max(upper + lower, 1)),
        float(np.sqrt(counts[_SYMBOLS].sum() / n)),
        float(np.sqrt(counts[33] / n)),
        float(np.sqrt(counts[124] / n)),
        float(np.sqrt(digits / n)),
        float(np.sqrt((counts[44] + counts[46]) / n)),
        len(set(words)) / k,
        repeats / k,
        1 - len(set(lines)) / len(lines),
        min(len(text) / k, 40.0),
        float(np.log1p(k)),
        min(packed / n, 2.0),
    ]


@dataclass
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.clip(np.column_stack([z, z**2, np.ones(len(z))]) @ self.weights, -CLIP, CLIP)


def _udf(model: Classifier | None):
    """Of a text column, the features, or with a model the log odds."""
    import pandas as pd

    def run(texts: pd.Series) -> pd.Series:
        settle()
        rows = [features(x) for x in texts]
        release()
        return pd.Series(rows if model is None else model.logits(np.array(rows).reshape(len(rows), -1)))

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, T.ArrayType(T.DoubleType()) if model is None else T.DoubleType())


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Classifier:
    """On at most ``rows`` labelled documents; their features (a few numbers each) come to the driver."""
    got = sample(docs, labels, "quality", rows).select("doc_id", "label", _udf(None)("text").alias("x")).collect()
    width = len(features(""))
    if len({r["label"] > 0 for r in got}) < 2:
        return Classifier(np.zeros(width), np.ones(width), np.zeros(2 * width + 1))
    got.sort(key=lambda r: (r["doc_id"], r["x"]))
    x, y = np.array([r["x"] for r in got]), np.array([float(r["label"] > 0) for r in got])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - mean) / scale
    return Classifier(mean, scale, logistic(np.column_stack([z, z**2]), y))


def _site(source: Column) -> tuple[Column, Column]:
    """Host and path; null stays apart from every string."""
    bare = F.regexp_replace(source.cast("string"), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    parts = F.split(bare, "/", 3)
    host = F.concat(F.lit("h"), F.element_at(parts, 1))
    path = F.concat(host, F.lit("/"), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")))
    return F.coalesce(host, F.lit("n")), F.coalesce(path, F.lit("n"))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _exact(p: Column, power: int = 1) -> Column:
    """A probability, or its square, in units, as a number whose sums are exact."""
    return F.round(F.pow(p, F.lit(power)) * UNIT).cast("decimal(20,0)")


@dataclass(frozen=True)
class Priors:
    """The global mean, and the weights in documents with which hosts and paths are drawn toward the level above."""

    mean: float
    host: float
    path: float

    def shift(self, p: Column, names: dict[str, str]) -> Column:
        """What a document's path adds to its log odds, from ``n, s, hn, hs`` (documents and sums of path and host) without the document's own ``p``."""
        n, s, hn, hs = (F.col(names[x]) for x in ("n", "s", "hn", "hs"))
        host = (hs - p + self.host * self.mean) / (hn - 1 + self.host)
        path = (s - p + self.path * host) / (n - 1 + self.path)
        return _logit(F.least(F.greatest(path, F.lit(1e-3)), F.lit(1 - 1e-3))) - float(np.log(self.mean / (1 - self.mean)))


def moments(n: float, s: float, q: float, paths: int, hosts: int, path_ss: float, host_ss: float, path_nn: float, host_nn: float, all_nn: float) -> Priors:
    """Priors from the totals of a nested analysis of variance.

    ``n, s, q``: documents, sum and sum of squares; ``path_ss, host_ss``: sums of s * s / n over paths
    and hosts; ``path_nn``: of each path's n * n over its host's n; ``host_nn``: hosts' n * n; ``all_nn``: paths'.
    """
    if not n:
        return Priors(0.5, LEAST_WEIGHT, LEAST_WEIGHT)
    mean = min(max(s / n, 1e-3), 1 - 1e-3)
    single = max(q - path_ss, 0.0) / max(n - paths, 1)
    room = n - path_nn
    by_path = max((path_ss - host_ss - (paths - hosts) * single) / room, LEAST_SPREAD) if room > 0 else LEAST_SPREAD
    room = n - host_nn / n
    extra = (hosts - 1) * single + by_path * (path_nn - all_nn / n)
    by_host = max((host_ss - s * s / n - extra) / room, LEAST_SPREAD) if room > 0 else LEAST_SPREAD
    weight = lambda spread: max(mean * (1 - mean) / spread - 1, LEAST_WEIGHT)
    return Priors(mean, weight(by_host), weight(by_path))


def sites(scored: DataFrame) -> tuple[DataFrame, Priors]:
    """``path__, n, s, hn, hs`` of each path and its host; and the priors.

    ``scored`` has ``host__, path__, p__``. Counts and sums are combined before the shuffle, so a
    host with a third of all documents is a few rows; its paths meet it by a join of grouped rows.
    """
    total = lambda x: (F.sum(x).cast("double") / UNIT)
    paths = checkpoint(scored.groupBy("host__", "path__").agg(F.count("*").alias("n"), total(_exact(F.col("p__"))).alias("s"), total(_exact(F.col("p__"), 2)).alias("q")))
    whole = lambda x: F.sum(F.round(x * UNIT).cast("decimal(38,0)")).cast("double") / UNIT
    n, s = F.col("n").cast("double"), F.col("s")
    hosts = paths.groupBy("host__").agg(F.sum("n").alias("hn"), whole(s).alias("hs"), whole(F.col("q")).alias("hq"), F.count("*").alias("k"), whole(s * s / n).alias("ss"), F.sum(F.col("n").cast("decimal(18,0)") * F.col("n")).cast("double").alias("nn"))
    hosts = checkpoint(hosts)
    hn, hs = F.col("hn").cast("double"), F.col("hs")
    t = hosts.agg(F.sum("hn"), whole(hs), whole(F.col("hq")), F.sum("k"), F.count("*"), whole(F.col("ss")), whole(hs * hs / hn), whole(F.col("nn") / hn), whole(hn * hn / UNIT), whole(F.col("nn") / UNIT)).first()
    t = [float(x or 0) for x in t]
    priors = moments(*t[:3], int(t[3]), int(t[4]), *t[5:8], t[8] * UNIT, t[9] * UNIT)
    return paths.join(hosts.select("host__", "hn", "hs"), "host__").select("path__", "n", "s", "hn", "hs"), priors


def _few(known: DataFrame) -> bool:
    return known.limit(BROADCAST_SITES + 1).count() <= BROADCAST_SITES


def _with_site(rows: DataFrame, path: str, known: DataFrame, names: dict[str, str]) -> DataFrame:
    """``rows`` with the columns of ``sites`` under the ``names``, none of which clashes; ``key`` and ``salt`` name columns for the join."""
    renamed = known.select(*[F.col(k).alias(names[k]) for k in ("path__", "n", "s", "hn", "hs")])
    if _few(known):
        return rows.join(F.broadcast(renamed), F.col(path) == F.col(names["path__"]))
    spread = renamed.withColumn(names["salt"], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn(names["key"], F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return salted.join(spread, (F.col(path) == F.col(names["path__"])) & (F.col(names["key"]) == F.col(names["salt"])))


def _names(taken: list[str], *more: str) -> dict[str, str]:
    """A name for each column that is added, none of which clashes with another."""
    out: dict[str, str] = {}
    for x in ("path__", "n", "s", "hn", "hs", "key", "salt", *more):
        out[x] = free_name([*taken, *out.values()], x)
    return out


def _probability(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def score(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """``doc_id, host, path, document_logit, site_shift, quality, keep`` for each document."""
    model = fit(docs, labels, rows)
    host, path = _site(F.col("source"))
    scored = checkpoint(docs.select(F.col("doc_id").alias("doc__"), host.alias("host__"), path.alias("at"), _udf(model)(text_or_empty()).alias("logit")))
    p = _probability(F.col("logit"))
    known, priors = sites(scored.select("host__", F.col("at").alias("path__"), p.alias("p__")))
    names = _names(scored.columns)
    with_shift = _with_site(scored, "at", checkpoint(known), names).withColumn("shift", priors.shift(p, names))
    quality = _probability(F.col("logit") + F.col("shift"))
    return with_shift.select(F.col("doc__").alias("doc_id"), F.substr("host__", F.lit(2)).alias("host"), F.substr("at", F.lit(2)).alias("path"), F.col("logit").alias("document_logit"), F.col("shift").alias("site_shift"), quality.alias("quality"), (quality >= KEEP).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, all columns as they are.

    The texts are scored twice, once for the sites and once for the decisions, rather than moved.
    """
    model = fit(docs, labels, rows)
    host, path = _site(F.col("source"))
    odds = lambda: _udf(model)(text_or_empty())
    known, priors = sites(docs.select(host.alias("host__"), path.alias("path__"), _probability(odds()).alias("p__")))
    names = _names(docs.columns, "at", "logit")
    scored = docs.withColumns({names["at"]: path, names["logit"]: odds()})
    sited = _with_site(scored, names["at"], checkpoint(known), names)
    logit = F.col(names["logit"])
    return sited.where(_probability(logit + priors.shift(_probability(logit), names)) >= KEEP).select(*[F.col(f"`{c}`") for c in docs.columns])

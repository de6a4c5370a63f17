"""The pipeline's stages, each against its operator or brute force on its own input."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_documents import CLASHES, slow_fingerprint
from test_tokens import WORDS, _shared, check_packing

import corpus_pipeline
from veldra.llm import pii, quality, toxicity

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and rows of each stage, written and read again in between."""
    folder, out = tmp_path_factory.mktemp("stages"), [spark.read.parquet(f"{DIR}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], DIR).write.parquet(str(folder / name))
        out.append(spark.read.parquet(str(folder / name)))
    return out


def test_columns_and_names(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "pii", "packing"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def ids(frame):
    return sorted(r["doc_id"] for r in frame.select("doc_id").collect())


def test_rejections(spark, stages):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    assert ids(stages[1]) == ids(quality.score(stages[0], labels).where("keep"))
    assert ids(stages[2]) == ids(toxicity.score(stages[1], labels).where("not toxic"))
    bad = {r["doc_id"] for r in labels.where("quality = 0").collect()}
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()} & set(ids(stages[0]))
    assert len(bad & set(ids(stages[1]))) <= 0.05 * len(bad) and len(good & set(ids(stages[1]))) >= 0.99 * len(good)


def slow_groups(texts):
    """Of each text, the first one of its group: links are of four fingerprint bits or a five-word similarity of 0.8."""
    sets, fps, root = [slow_shingles(t) for t in texts], [slow_fingerprint(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 or len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def test_one_of_each_group(stages):
    """Both kinds of links; of each group the least doc_id stays."""
    rows = sorted((r["doc_id"], r["text"]) for r in stages[2].collect())
    assert ids(stages[3]) == sorted({rows[k][0] for k in slow_groups([t for _, t in rows])})


def slow_shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def test_near_copies_at_lower_similarity(spark):
    """Against all pairs: copies of 0.6 to 0.95, a large group around one text, short texts, texts without words."""
    rng = np.random.default_rng(7)
    texts = ["", " ", "one two", "ONE  two", "one two three"]
    for size in (30, 60, 200, 700):
        for changes in (0, 1, 2, 3, 5, 8):
            base = [f"w{x}" for x in rng.integers(0, 5000, size)]
            copy = list(base)
            for at in rng.choice(size, changes, replace=False):
                copy[at] = "changed"
            texts += [" ".join(base), " ".join(copy)]
    base = [f"h{x}" for x in rng.integers(0, 5000, 120)]
    for _ in range(60):
        copy = list(base)
        for at in rng.choice(120, 1, replace=False):
            copy[at] = f"x{rng.integers(0, 10**6)}"
        texts.append(" ".join(copy))
    order = rng.permutation(len(texts)).tolist()
    docs = spark.createDataFrame([(i, texts[t], "en", "s", 0) for i, t in enumerate(order)], "doc_id long, text string, lang string, source string, n_chars long")
    sets, fps = [slow_shingles(texts[t]) for t in order], [slow_fingerprint(texts[t]) for t in order]
    close = [(fps[i] ^ fps[j]).bit_count() > 4 for i, a in enumerate(sets) for j in range(i) if len(a & sets[j]) >= 0.8 * len(a | sets[j])]
    assert sum(close) > 0.5 * len(close)  # beyond the links of op9
    assert ids(corpus_pipeline.distinct_documents(spark, docs, DIR)) == sorted(set(slow_groups([texts[t] for t in order])))


def test_pseudonyms(spark, stages):
    before, after = ({r["doc_id"]: r for r in s.collect()} for s in stages[3:5])
    again = {r["doc_id"]: r["text"] for r in pii.mask(stages[3], corpus_pipeline.pii_key(spark)).collect()}
    assert {k: r["text"] for k, r in after.items()} == again and set(before) == set(after)
    assert not any("@mail" in t for t in again.values()) and any(again[k] != r["text"] for k, r in before.items())


def test_packed(spark, stages):
    tokenizer = _shared().tokenizer
    wanted = {r["doc_id"]: np.array(tokenizer.encode(r["text"], add_special_tokens=False).ids + [2], "<u4") for r in stages[4].collect()}
    assert check_packing(stages[5].collect(), wanted, 4096) == 0
    assert check_packing(corpus_pipeline.run(spark, DIR).collect(), wanted, 4096) == 0
    assert public_tokenizers.path("word_bpe_49k.json") == WORDS


def test_empty_and_odd_input(spark, stages):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "A text.", "en", "s", 7), (2, "", "en", "", 0)]
    for docs in (stages[0].limit(0), spark.createDataFrame(rows, stages[0].schema)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, DIR)
            assert docs.columns == stages[0].columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, DIR).count() <= 3


def test_clashing_columns(spark, stages):
    """Columns of any name pass through every stage but the last, which gives pieces only."""
    docs = stages[0].select("*", *[F.lit(900 + k).alias(c) for k, c in enumerate(CLASHES)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DIR)
        assert docs.columns == [*stages[0].columns, *CLASHES]
    assert [tuple(r) for r in docs.select(*CLASHES).distinct().collect()] == [tuple(range(900, 900 + len(CLASHES)))]
    assert ids(docs) == ids(stages[4])
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DIR).columns == stages[5].columns

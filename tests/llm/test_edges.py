"""Nulls in every column, repeated rows, no rows, and clashing column names, for every operator."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sangam.llm import common, components, compression, decontaminate, jaccard, langid, linededup, mixing, quality, suffixdedup, surrogates, urlfilter

from .helpers import SCHEMA, prose

A, B = prose(1, 90), prose(2, 80)
ROWS = [(None, A, None, None, None), (None, None, None, None, None), (1, A, "en", "s", 5), (1, A, "en", "s", 5), (2, A + " tail", None, "s", 5), (3, None, "en", None, None), (4, "", "de", "s", 0), (5, B, "de", "s", 9), (6, B, "de", "s", 9)]
CLASHES = ["n", "h1", "h2", "u", "v", "node", "component", "class_id", "batch", "shard", "i", "line", "length", "start", "end", "kept", "n_words", "score", "probability", "n_email", "spans", "items", "value", "w"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASHES}).repartition(3)


def run(spark, docs):
    field = langid.train(docs)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    model = compression.train(docs, labels)
    bench = spark.createDataFrame([(None, A), (1, None), (2, B[:200]), (2, B[:200])], "item_id long, text string")
    return {
        "suffixdedup": suffixdedup.remove_repeats(docs),
        "quality": quality.judge_quality(docs),
        "jaccard": jaccard.join(docs, 3, 90),
        "keep_one": jaccard.keep_one(docs),
        "matches": decontaminate.find_matches(docs, bench),
        "decontaminate": decontaminate.decontaminate(docs, bench),
        "surrogates": surrogates.replace(docs, b"k"),
        "lines": linededup.dedup_lines(docs),
        "identify": langid.identify(docs, field),
        "reject": langid.reject_unknown(docs, field),
        "compression": compression.score(docs, model),
        "mix": mixing.mix(docs, {"lang": {"en": 0.5}, "source": {"nowhere": 1.0}}),
    }


def test_odd_rows(spark, docs):
    found = {k: v.collect() for k, v in run(spark, docs).items()}
    for k in ("suffixdedup", "quality", "matches", "surrogates", "identify", "compression", "mix"):
        assert len(found[k]) == len(ROWS), k
    assert {(r.doc_id, r.n_removed) for r in found["suffixdedup"] if r.doc_id in (1, 2)} == {(1, 0), (2, len(A))}
    assert {r.doc_id: r.component_id for r in found["jaccard"]} == {None: None, 1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5}
    assert sorted(str(r.doc_id) for r in found["keep_one"]) == ["1", "1", "3", "4", "5", "None", "None"]
    # items without an id count as well, and so do rows without a doc_id
    assert sorted(str(r.doc_id) for r in found["decontaminate"]) == ["3", "4", "None"]
    assert [r["items"] for r in found["matches"] if r.doc_id in (5, 6)] == [["2"], ["2"]]
    assert sorted(str(r.doc_id) for r in found["lines"]) == ["1", "1", "2", "3", "4", "5", "None", "None"]
    assert {r.text for r in found["lines"] if r.doc_id == 2} != {A + " tail"}
    for k in ("keep_one", "decontaminate", "lines", "reject"):
        assert all(r.n == "clash" and r.value == "clash" for r in found[k]), k


def test_no_rows(spark, docs):
    for k, v in run(spark, docs.limit(0)).items():
        assert v.collect() == [], k


def test_url_filter_of_odd_rows(spark):
    """Null keys and urls, repeated rows, and columns named like those of the result."""
    rows = [(None, "http://a.com/de/x", "x"), (1, None, "x"), (1, "http://a.com/de/x", None), (1, "http://a.com/de/x", None), (2, "", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string").withColumns({x: F.lit("clash") for x in ("host", "path", "verdict", "canonical")})
    got = urlfilter.judge_urls(pages, [("com/de/", "block")], further=[("com/", "allow"), ("a.com/*", "block")])
    assert sorted(map(str, ((r.page_id, r.rule, r.verdict) for r in got.collect()))) == sorted(map(str, [(None, "com/de/", "block"), (1, None, "allow"), (1, "com/de/", "block"), (1, "com/de/", "block"), (2, None, "allow")]))
    assert urlfilter.judge_urls(pages.limit(0), []).collect() == []


def test_repeated_ids_with_different_texts(spark):
    """doc_id 2 twice: each row is judged by its own text; as documents that link, they are one."""
    unique = prose(7, 90)
    docs = spark.createDataFrame([(1, A, "en", "s", 5), (2, A, "en", "s", 5), (2, unique, "en", "s", 5), (2, unique, "en", "s", 5), (3, unique + " end", "en", "s", 5)], SCHEMA)
    cut = {(r.doc_id, r.text) for r in linededup.remove_runs(docs, 40).collect()}
    assert (2, unique) in cut and (1, A) in cut and (2, "") in cut
    groups = jaccard.join(docs, 3, 90).collect()
    assert [r.component_id for r in groups] == [1] * 5
    bench = spark.createDataFrame([(1, A)], "item_id long, text string")
    for block in (4_000_000, 1):
        kept = decontaminate.decontaminate(docs.withColumn("doc_id", F.when(F.col("doc_id") > 1, F.col("doc_id"))), bench.unionAll(bench), block_words=block)
        assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("2", unique), ("2", unique), ("3", unique + " end")])


def test_no_input_table_rows_in_the_pipeline(spark, tmp_path):
    """Empty documents and benchmark tables, and stages on rows with nulls, repeated ids and clashing columns."""
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    odd = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("clash") for c in CLASHES})
    for _, stage in corpus_pipeline.STAGES:
        assert all(r.n == "clash" for r in stage(spark, odd, str(tmp_path)).collect())


def test_hash_tells_structured_words_apart():
    """A Thue-Morse word and its complement collide modulo 2**64, whatever the base."""
    word = bytes(97 + bin(i).count("1") % 2 for i in range(2048))
    data = np.frombuffer(word + b" " + bytes(195 - x for x in word), np.uint8)
    a, b = common.range_hash(common.prefix_hash(data), np.array([0, 2049]), np.array([2048, 4097]))
    assert a != b
    long = np.resize(np.frombuffer(b"some letters ", np.uint8), 9_000_001)
    a, b = common.range_hash(common.prefix_hash(long), np.array([0, 13]), np.array([8_999_987, 9_000_000]))
    assert a == b


def test_words_of_equal_hash_modulo_a_power_of_two_stay(spark):
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    lines = [" ".join([word] * 45), " ".join([word.translate(str.maketrans("ab", "ba"))] * 45)]
    docs = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in enumerate(lines)], SCHEMA)
    assert {r.doc_id: r.text for r in linededup.remove_runs(docs, 40).collect()} == dict(enumerate(lines))


def test_strict_thresholds_of_the_jaccard_join(spark):
    """Bands and prefixes at 98, 99 and 100 percent."""
    words = [f"w{i}" for i in range(700)]
    docs = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in enumerate([" ".join(words), " ".join([*words, "more"]), " ".join(words), " ".join(words[:690])])], SCHEMA)
    got = {p: [r.component_id for r in sorted(jaccard.join(docs, 1, p).collect())] for p in (98, 99, 100)}
    assert got == {98: [0, 0, 0, 0], 99: [0, 0, 0, 3], 100: [0, 1, 0, 3]}


def test_components_by_rounds_and_in_one_task(spark):
    import random

    r = random.Random(5)
    rows = [(r.randrange(2), r.randrange(60), r.randrange(60)) for _ in range(70)] + [(0, i, i + 1) for i in range(100, 140)]
    edges = spark.createDataFrame(rows, "space long, u long, v long")
    got = [sorted(map(tuple, components.connected(edges, limit).collect())) for limit in (0, 1000)]
    assert got[0] == got[1] and len(got[0]) > 80

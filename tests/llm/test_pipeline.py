"""The pipeline's stages against brute-force versions, each on its own input."""

import corpus_pipeline
from sangam.llm import queries

from .helpers import VISIBLE, awkward, prose, table
from .test_filters import brute_matches, tongue
from .test_repeats import brute_jaccard, brute_lines


def by_id(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_equal_brute_force(spark, tmp_path):
    langs = ["en", "de", "fr"] * 30
    texts = [tongue(x, i, 90 + i) + ".\n" + tongue(x, i + 500, 20) for i, x in enumerate(langs)]
    texts[10] = texts[3] + " more"
    texts[20] = texts[2]
    texts[25] = "own words here. " + prose(12, 30)
    odd = [x for x in awkward() if x is None or "\x00" not in x]
    docs = table(spark, texts + odd, langs + ["en"] * len(odd))
    items = [(1, prose(12, 30)), (2, None)]
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = now.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = by_id(now)
        path = str(tmp_path / f"stage{i}")
        stage(spark, now, str(tmp_path)).write.parquet(path)
        now = spark.read.parquet(path)
        after = by_id(now)
        order = sorted(before)
        values = [before[d] for d in order]
        assert now.columns == columns, name
        if name == "language_id":
            assert {d for d in before if before[d] is None or not any(x.isalpha() for x in before[d])}.isdisjoint(after)
            assert set(range(90)) - set(after) == set() and all(before[d] == after[d] for d in after)
        elif name == "line_dedup":
            cut = brute_lines(values, 40)
            assert after == {d: cut[k] for k, d in enumerate(order) if cut[k] == values[k] or VISIBLE.search(cut[k])}
            assert all(r.n_chars == len(r.text) for r in now.collect())
        elif name == "ngram_jaccard_join":
            groups = brute_jaccard(values, 5, 80)
            assert after == {d: before[d] for k, d in enumerate(order) if groups[k][1] == k}
        elif name == "benchmark_decontamination":
            hits = brute_matches(values, items)
            assert after == {d: before[d] for k, d in enumerate(order) if not hits[k][1]} and len(after) < len(before)
        else:
            assert set(after) <= set(before) and 0 < len(after) < len(before)
    assert by_id(corpus_pipeline.run(spark, str(tmp_path))) == by_id(now)


def test_every_operator_has_a_query():
    names = queries.queries()
    assert sorted(int(k[2:].split("_")[0]) for k in names) == list(range(1, 11))
    assert set(queries.oracle_sql()) == {k for k in names if k[2:].split("_")[0] in ("1", "2", "3", "4", "6", "10")}

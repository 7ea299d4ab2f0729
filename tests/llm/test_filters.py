"""Quality rules, decontamination, URL filters, language ID, compression, PII, mixing."""

import hashlib
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sangam.llm import compression, decontaminate, langid, mixing, quality, surrogates, urlfilter
from sangam.llm.queries import MIX_TARGETS, op4_decontaminate, op5_pii_surrogates

from .helpers import LOWER, VISIBLE, awkward, prose, table

ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_quality(text):
    text = text or ""
    words = VISIBLE.findall(text)
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {i + j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if VISIBLE.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_base_counts_equal_brute_force(spark):
    texts = awkward() + ["a b c d e f g h " * 9, "x y z w v u t " * 3 + "#$ | <b>", prose(3, 60) + " " + prose(3, 60), "same line.\nsame line.\n \nsame line. "]
    got = quality.base_counts(table(spark, texts)).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == {i: brute_quality(t) for i, t in enumerate(texts)}


def test_lines_are_judged_first(spark):
    good = prose(4, 80)
    texts = [good, good + "\nLicensed under the Apache License, Version 2.0.", "\n".join(["Home | News | About | Contact"] * 3) + "\n" + good, "BUY NOW OR CRY!! " * 8, "word*** other### more&&& again%%% " * 9, prose(5, 10), "no stop at the end of this long line " + prose(6, 30).replace(".", "").replace("\n", " ")]
    rows = {r.doc_id: r for r in quality.judge_quality(table(spark, texts)).collect()}
    assert [rows[i].kept for i in range(len(texts))] == [True, True, True, False, False, False, False]
    assert rows[1].n_lines_removed == 1 and rows[1].clean_text == "\n".join(x for x in good.split("\n") if x)


def test_quality_keeps_other_columns_and_drops_clashing_ones(spark):
    df = table(spark, [prose(1, 60)]).withColumn("kept", F.lit("x")).withColumn("n_words", F.lit("y"))
    row = quality.judge_quality(df).first()
    assert row.kept is True and row.n_words == 60 and row.source == "s"
    assert quality.judge_quality(table(spark, [])).collect() == []


def brute_matches(texts, items, n=10):
    windows = {}
    for name, t in items:
        w = ITEM.findall((t or "").translate(LOWER))
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(str(name))
    out = {}
    for d, t in enumerate(texts):
        w, hit, own = ITEM.findall((t or "").translate(LOWER)), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if found := windows.get(tuple(w[i : i + k])):
                    hit |= set(range(i, i + k))
                    own |= found
        out[d] = (len(w), len(hit), sorted(own))
    return out


def test_decontamination_equals_brute_force(spark):
    a = prose(11, 40)
    items = [(1, a), (2, a), (3, None), (4, ""), (5, "tiny item"), (6, prose(12, 15)), (7, "..."), (10, prose(12, 10)), (11, "Straße überall 9")]
    texts = awkward() + [prose(20, 30) + a.upper() + prose(21, 5), "x " + a[:60], prose(12, 12), "a TINY, item! tiny item", "straße ÜBERALL 9 straße überall 9", a + a, prose(12, 9)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (4_000_000, 1):  # all items at once, and one at a time
        found = decontaminate.find_matches(table(spark, texts), bench, block_words=block)
        got = {r.doc_id: (r.n_words, r.n, r["items"]) for r in found.withColumn("n", decontaminate.n_hit(F.col("spans"))).collect()}
        assert got == brute_matches(texts, items)
    assert max(r.longest_match for r in found.collect()) == 40
    kept = decontaminate.decontaminate(table(spark, texts), bench)
    assert {r.doc_id for r in kept.collect()} == {d for d, m in brute_matches(texts, items).items() if not m[1]}
    assert decontaminate.decontaminate(table(spark, texts), bench.limit(0)).count() == len(texts)


def test_items_without_id_count(spark, tmp_path):
    """As in the query's oracle: hits count, together they are one item, no id in the digest."""
    a, b = prose(11, 40), prose(12, 15)
    table(spark, [a + " tail", b, a + " " + b, prose(13, 30)]).write.parquet(str(tmp_path / "documents.parquet"))
    items = [(None, a), (None, b), (7, b), (10, b)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sha = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in ([], ["7", "10"], ["7", "10"], [])]
    got = sorted(op4_decontaminate(spark, str(tmp_path)).collect())
    assert [tuple(r) for r in got] == [(0, 41, 40, 1, sha[0], True), (1, 15, 15, 3, sha[1], True), (2, 55, 55, 3, sha[2], True), (3, 30, 0, 0, sha[3], False)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_matches(table(spark, [b]), bench, block_words=1).first()
    assert found["items"] == ["10", "7", None]


def test_blocks_keep_the_rows_apart(spark):
    """Rows that share a doc_id, or have none, come back each with its own hits."""
    a, b = prose(11, 40), prose(12, 15)
    docs = table(spark, [a, b + " x y", prose(13, 30), a, b, None]).withColumn("doc_id", F.when(F.col("doc_id") < 3, 1))
    bench = spark.createDataFrame([(1, a), (2, b)], "item_id long, text string")
    found = {}
    for block in (4_000_000, 1):
        hits = decontaminate.find_matches(docs, bench, block_words=block).withColumn("n", decontaminate.n_hit(F.col("spans")))
        found[block] = sorted((str(r.doc_id), r.n_words, r.n, r.longest_match, r["items"]) for r in hits.collect())
    assert found[1] == found[4_000_000] and len(found[1]) == 6
    assert found[1][0] == ("1", 17, 15, 15, ["2"])


URLS = [None, "", "no scheme", "http://", "http://Example.ORG/es/a", "https://www.example.org/es", "x://example.org/en/12?q#f", "ftp://badexample.org/es/", "http://a.com/fr/x", "http://com/de/", "http://evil.net/x.com/de/", "http://a.com?/de/", "http://a.com#/fr/", "http://u@b.com:80/de/", "a://b://c.com/de/", "http://org", "http://a.org/ü", "//x.org/", "http://spam.example.net/a", "http://" + "y" * 5000 + ".org/" + "z" * 5000, "http://a\n.org/es/"]
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"), ("*spam*/", "block"), ("net/*.html", "block")]


def brute_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0].translate(LOWER)
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
    best = None
    for rule, verdict in RULES:
        h, _, p = rule.partition("/")
        glob = lambda x, any_: re.escape(x).replace(r"\*", any_)
        if re.fullmatch(r"(?:.*\.)?" + glob(h, "[^/]*"), host, re.S) and re.match(glob("/" + p, ".*"), path, re.S) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best[0] if best else None, best[1] if best else "allow"


def test_url_filter_equals_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(pages, RULES).collect()}
    assert got == {i: brute_url(u) for i, u in enumerate(URLS)}
    assert urlfilter.judge_urls(pages.limit(0), RULES).collect() == []
    many = [(f"host{i}.org/p{i}", "block") for i in range(40)]  # several machine words
    pages = spark.createDataFrame([(i, f"http://a.host{i}.org/p{i}x") for i in range(40)], "page_id long, url string")
    assert {r.page_id: r.rule for r in urlfilter.judge_urls(pages, many).collect()} == {i: many[i][0] for i in range(40)}


def tongue(lang, seed, words):
    """Words of an invented language: its own syllables."""
    import random

    r = random.Random(f"{lang}{seed}")
    syllables = {"en": ["th", "the", "ing", "and", "er"], "de": ["sch", "ung", "ein", "ß", "ver"], "fr": ["eau", "oi", "é", "que", "ç"]}[lang]
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) + ("." if i % 12 == 11 else "") for i in range(words))


def test_language_id_learns_and_labels_switches(spark):
    langs = ["en", "de", "fr"] * 20
    docs = table(spark, [tongue(x, i, 60) for i, x in enumerate(langs)], langs)
    field = langid.train(docs)
    texts = [tongue(x, 1000 + i, 5 + i) for i, x in enumerate(langs)] + [None, "", "123 — 45!", "…", "\n\n", tongue("en", 1, 3000)]
    rows = {r.doc_id: r for r in langid.identify(table(spark, texts).withColumn("score", F.lit("x")), field).collect()}
    assert sum(rows[i].lang_pred == x for i, x in enumerate(langs)) >= 58
    assert [rows[i].lang_pred for i in range(60, 66)] == ["und"] * 5 + ["en"]
    assert all(0 <= r.score <= 1 for r in rows.values()) and rows[60].score == 0
    mixed = langid.label_words(field, tongue("de", 5, 20).replace(".", "") + " " + tongue("fr", 6, 20).replace(".", ""))
    assert sum(lang == ("de" if i < 20 else "fr") for i, (_, lang, _) in enumerate(mixed)) >= 36
    assert langid.reject_unknown(table(spark, texts), field).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_forward_backward_equals_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    score, t, s = rng.normal(size=(9, 3)).astype(np.float32), rng.normal(size=(3, 3)), rng.normal(size=3)
    got = langid.posteriors(score, np.array([0, 4, 5, 9]), t, s)
    for a, b in ((0, 4), (4, 5), (5, 9)):
        total = np.zeros((b - a, 3))
        for path in itertools.product(range(3), repeat=b - a):
            p = np.exp(s[path[0]] + sum(score[a + i, y] for i, y in enumerate(path)) + sum(t[x, y] for x, y in zip(path, path[1:], strict=False)))
            for i, y in enumerate(path):
                total[i, y] += p
        assert np.allclose(got[a:b], total / total.sum(axis=1, keepdims=True), atol=1e-4)


def test_gradient_of_the_chain_likelihood():
    """Transition and word gradients (gold minus expected) against finite differences of the log-likelihood."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(4)
    score, t, s, gold = rng.normal(size=(7, 2)), rng.normal(size=(2, 2)), rng.normal(size=2), rng.integers(0, 2, 7)
    chains = [(0, 3), (3, 4), (4, 7)]

    def likelihood(score, t):
        total = 0.0
        for a, b in chains:
            of = lambda path: s[path[0]] + sum(score[a + i, y] for i, y in enumerate(path)) + sum(t[x, y] for x, y in zip(path, path[1:], strict=False))  # noqa: B023, E731
            total += of(gold[a:b]) - np.log(sum(np.exp(of(path)) for path in itertools.product(range(2), repeat=b - a)))
        return total

    gamma, joint = langid.expectations(score.astype(np.float32), np.array([0, 3, 4, 7]), t, s)
    want = np.zeros((2, 2))
    for a, b in chains:
        np.add.at(want, (gold[a : b - 1], gold[a + 1 : b]), 1)
    h = 1e-4
    for i, j in itertools.product(range(2), repeat=2):
        step = np.zeros((2, 2))
        step[i, j] = h
        assert (likelihood(score, t + step) - likelihood(score, t - step)) / (2 * h) == pytest.approx(want[i, j] - joint[i, j], abs=1e-3)
    for i in range(7):
        step = np.zeros((7, 2))
        step[i, 1] = h
        assert (likelihood(score + step, t) - likelihood(score - step, t)) / (2 * h) == pytest.approx(float(gold[i] == 1) - gamma[i, 1], abs=1e-3)


def test_language_id_without_labels(spark):
    docs = table(spark, ["some text", None], [None, None])
    assert {r.lang_pred for r in langid.identify(docs, langid.train(docs)).collect()} == {"und"}


def test_compression_classifier(spark):
    good, bad = [prose(i, 120) for i in range(80)], [" ".join(w + "***" for w in prose(500 + i, 80, 90).upper().split()) for i in range(80)]
    docs = table(spark, [x for pair in zip(good, bad, strict=True) for x in pair] + [None, "", "x" * 200_000])
    labels = spark.createDataFrame([(i, (i + 1) % 2, "x") for i in range(160)] + [(0, None, "x"), (9999, 1, "x")], "doc_id long, quality int, text string")
    train = labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    scores = {r.doc_id: r.score for r in compression.score(docs, compression.train(docs, train)).collect()}
    held = [i for i in range(160) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 30 and sum((scores[i] >= 0.5) == (i % 2 == 0) for i in held) >= 0.95 * len(held)
    assert scores[160] == scores[161] and all(0 <= s <= 1 for s in scores.values())
    plain = compression.train(docs, labels.limit(0))
    assert {round(r.score, 3) for r in compression.score(docs, plain).collect()} == {0.5}


PII = "Mail ann.lee@mail3.example.com or ANN.LEE@MAIL3.EXAMPLE.COM, call +1 (017) 555-7713, card 4111 1111 1111 1111 from 97.51.17.173, token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\". Mrs. Maria Keller met Herr Иван Петров. SSN 123-45-6789. Not: 1.2.3, 12345, 1.2.3.4.5, a@b."


def test_surrogates_keep_type_format_and_identity(spark):
    other = PII.replace("ann.lee", "bob.lee").replace("7713", "7714")
    rows = {r.doc_id: r for r in surrogates.replace(table(spark, [PII, PII, other, None, "", "plain text 12"]), b"k").collect()}
    assert rows[0].text == rows[1].text and len(rows[0].text) in range(len(PII) - 8, len(PII) + 9)
    assert [rows[0][f"n_{k}"] for k in surrogates.TYPES] == [2, 1, 1, 1, 1, 1, 2, 0, 0, 0]
    assert (rows[3].text, rows[4].text, rows[5].text) == (None, "", "plain text 12")
    before, after = ([(k, t[a:b]) for a, b, k in surrogates.find(t)] for t in (PII, rows[0].text))
    assert [k for k, _ in before] == [k for k, _ in after]
    old, new = [v for _, v in before], [v for _, v in after]
    assert not set(old) & set(new)
    assert new[0].upper() == new[1] and re.fullmatch(r"[a-z]{3}\.[a-z]{3}@[a-z]{4}\d\.[a-z]{7}\.com", new[0])
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", new[2])
    card = re.sub(" ", "", new[3])
    assert surrogates.luhn(card) and len(card) == 16
    names = {k: set(v) for k, v in surrogates.GIVEN.items()}
    assert new[6].split()[0] in names["latin", "f"] and new[7].split()[0] in names["cyrillic", "m"]
    assert rows[2].text != rows[0].text
    found = surrogates.entities(table(spark, [PII, other]), b"k")
    assert surrogates.check(found) == (0, 0, 0)
    assert surrogates.Permutation(b"k").of("ip", "1.2.3.4") != surrogates.Permutation(b"other").of("ip", "1.2.3.4")


def test_permutations_are_one_to_one():
    p = surrogates.Permutation(b"key")
    for size in (1, 2, 7, 100, 676):
        new = [p.number(x, size, "t") for x in range(size)]
        assert sorted(new) == list(range(size)) and (size == 1 or all(x != y for x, y in enumerate(new)))
    assert len({p.shape(f"{a}{b}-{c}", "t") for a in "abc" for b in "XYZ" for c in range(10)}) == 90


MORE_PII = "Maria Lopez wrote to Иван Петров of 12 Old Mill Road and Lindenstraße 5. Pay DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432, not DE00 3704 0044 0532 0130 00. Hosts 2001:db8::8a2e:370:7334 and 2001:0db8:85a3:0000:0000:8a2e:0370:7334 at 12:30:45."


def test_surrogates_of_names_accounts_addresses():
    p = surrogates.Permutation(b"k")
    found = [(MORE_PII[a:b], kind) for a, b, kind in surrogates.find(MORE_PII)]
    assert found == [("Maria Lopez", "person:f"), ("Иван Петров", "person:m"), ("12 Old Mill Road", "street"), ("Lindenstraße 5", "street"), ("DE89 3704 0044 0532 0130 00", "iban"), ("GB82WEST12345698765432", "iban"), ("3704 0044 0532 0130 00", "card"), ("2001:db8::8a2e:370:7334", "ipv6"), ("2001:0db8:85a3:0000:0000:8a2e:0370:7334", "ipv6")]
    new, again = surrogates._run(p, MORE_PII)
    assert [k for _, _, k in surrogates.find(new)] == [k for _, k in found]
    assert all(a != b for _, a, b in again) and surrogates.iban_rest(again[4][2]) == 1 == surrogates.iban_rest(again[5][2])
    assert again[2][2].endswith(" Road") and "straße " in again[3][2]


@pytest.mark.parametrize("key", [b"query key", b"k", b"another one", b"\x00"])
def test_no_given_name_and_no_value_is_its_own(key):
    """Every known name, and all values of small forms: new, distinct, of the same kind."""
    p = surrogates.Permutation(key)
    for (_, gender), names in surrogates.GIVEN.items():
        new = [p.given(x, gender) for x in names]
        assert sorted(new) == sorted(names) and all(a != b for a, b in zip(names, new, strict=True))
    values = [f"{a}{b}" for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for b in "abcdefghijklmnopqrstuvwxyz"]
    assert sorted(p.given(x, "m") for x in values) == values
    assert all(p.shape(x, "t") != x and len(p.shape(x, "t")) == len(x) for x in ("李明", "José", "שלום", "한국", "7", "Ü"))
    with pytest.raises(ValueError):
        surrogates.Permutation(b"")


def brute_surrogates(text, key):
    """Each entity by itself, the numbering enumerated: what stands `step` behind it."""
    p, out, last = surrogates.Permutation(key), [], 0
    for a, b, kind in surrogates.find(text):
        value = text[a:b]
        if kind == "ssn":
            digits = int(value.replace("-", ""))
            size, label = 10**9, "ssn|000-00-0000"
            step = 1 + p._hash(f"{label}|{size}|step", size - 1)
            new = f"{p._walk((p._walk(digits, size, label, -1) + step) % size, size, label, 1):09d}"
            value = f"{new[:3]}-{new[3:5]}-{new[5:]}"
        else:
            value = p._of(kind, value)
        out += [text[last:a], value]
        last = b
    return "".join([*out, text[last:]])


def test_pii_query_equals_one_text_at_a_time(spark, tmp_path):
    texts = [PII, MORE_PII, None, "", "none here", PII + " " + MORE_PII * 300]
    table(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.text for r in op5_pii_surrogates(spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else brute_surrogates(t, b"query key") for i, t in enumerate(texts)}


def test_raking_reaches_the_margins(spark):
    texts, langs, sources = [], [], []
    for i in range(600):
        langs.append(["en", "de", None][i % 3])
        sources.append("hot" if i % 5 else f"s{i % 4}")
        texts.append(prose(i, 20 + i % 7) + (" License" if i % 4 == 0 else ""))
    docs = table(spark, [*texts, None, ""], [*langs, "en", "en"], [*sources, None, "hot"]).withColumn("sampled", F.lit("clash"))
    targets = {"source": {"hot": 0.5}, "lang": {"en": 0.6, "de": 0.3}, "topic": {"legal": 0.4, "prose": 0.6}}
    rows = mixing.mix(docs, targets, min_share=0.0).collect()
    assert len(rows) == 602
    weight = Counter()
    for r in rows:
        for d in mixing.DIMENSIONS:
            weight[d, r[d]] += r.n_tokens * r.probability
    total = sum(v for (d, _), v in weight.items() if d == "cell_lang")
    for d, v, want in (("cell_source", "hot", 0.5), ("cell_lang", "en", 0.6), ("cell_lang", "de", 0.3), ("cell_topic", "legal", 0.4)):
        assert weight[d, v] / total == pytest.approx(want, abs=0.01)
    assert all(r.sampled == (r.draw < r.probability) and 0 <= r.probability <= 1 for r in rows)
    again = mixing.mix(docs.repartition(7), targets, min_share=0.0)
    assert {(r.doc_id, r.sampled) for r in again.collect()} == {(r.doc_id, r.sampled) for r in rows}
    assert mixing.sample(docs, targets).columns == docs.columns
    assert mixing.mix(docs.limit(0), targets).collect() == []
    budget = mixing.mix(docs, {}, budget=3000.0).agg(F.sum(F.col("n_tokens") * F.col("probability"))).first()[0]
    assert budget == pytest.approx(3000, rel=0.01)


@pytest.mark.parametrize("hot", [240, 0])
def test_margins_hold_with_small_cells(spark, hot):
    """Production targets and defaults; few cells (of a hot source) or none have 0.1% of the tokens."""
    kinds = {"contact": " mail a@b now", "legal": " the license is", "listing": " a | b", "markup": " with <p> in", "prose": " of no kind"}
    docs = [("src0", x, "prose") for x in ("en", "de", "fr", "es") for _ in range(hot)]
    docs += [(f"src{i}", x, k) for i in range(100) for j, x in enumerate(("en", "de", "fr", "es")) for k in kinds if k != "contact" or (i + j) % 4 == 0]
    rows = mixing.mix(table(spark, ["text" + kinds[k] for _, _, k in docs], [x for _, x, _ in docs], [s for s, _, _ in docs]), MIX_TARGETS).collect()
    assert {r.cell_topic for r in rows} == set(kinds) and len(rows) == len(docs)
    weight = Counter()
    for r in rows:
        for d in mixing.DIMENSIONS:
            weight[d, r[d]] += r.n_tokens * r.probability
    total = sum(v for (d, _), v in weight.items() if d == "cell_lang")
    for d, wanted in MIX_TARGETS.items():
        for v, want in wanted.items():
            assert weight[f"cell_{d}", v] / total == pytest.approx(want, abs=0.001), v
    assert total > 0 and len({r.probability for r in rows}) > 1 and all(0 <= r.probability <= 1 for r in rows)


def test_budget_is_met_at_the_margins(spark):
    """A small cell that would need more than 1 is made up for by others."""
    sources = ["a"] * 80 + ["b"] * 20
    langs = ["en"] * 78 + ["de"] * 2 + ["en"] * 10 + ["de"] * 10
    docs = table(spark, ["one two three four"] * 100, langs, sources)
    targets = {"source": {"a": 0.6, "b": 0.4}, "lang": {"en": 0.6, "de": 0.4}}
    weight = Counter()
    for r in mixing.mix(docs, targets, budget=100.0).collect():
        weight["all"] += r.n_tokens * r.probability
        weight[r.cell_source] += r.n_tokens * r.probability
        weight[r.cell_lang] += r.n_tokens * r.probability
    assert weight["all"] == pytest.approx(100, abs=0.1)
    assert (weight["a"], weight["de"]) == (pytest.approx(60, abs=0.1), pytest.approx(40, abs=0.1))
    unmet = Counter()
    for r in mixing.mix(docs, targets, budget=300.0).collect():
        unmet["all"] += r.n_tokens * r.probability
        unmet[r.cell_lang] += r.n_tokens * r.probability
    assert unmet["all"] < 300 and unmet["de"] / unmet["all"] == pytest.approx(0.4, abs=0.001)


def test_factors_as_tables_equal_factors_in_the_plan(spark, monkeypatch):
    """The plan for many values gives the rates of the plan for few, and an independent raking by numpy."""
    import numpy as np

    sources, langs = ["a"] * 6 + ["b"] * 3 + ["c"], ["en", "de"] * 5
    docs = table(spark, ["one two three"] * 10, langs, sources)
    targets = {"source": {"a": 0.4}, "lang": {"en": 0.6}}
    rates = []
    for small in (2_000, 1):
        monkeypatch.setattr(mixing, "SMALL", small)
        rates.append({(r.cell_source, r.cell_lang): r.probability for r in mixing.mix(docs, targets, budget=9.0).collect()})
    assert rates[0] == pytest.approx(rates[1], abs=1e-6)
    cells = Counter(zip(sources, langs, strict=True))
    w = np.array([[3.0 * cells[s, x] for x in ("en", "de")] for s in ("a", "b", "c")])
    tokens = w.copy()
    for _ in range(200):
        w *= (np.array([0.4, 0.45, 0.15]) * 30 / w.sum(axis=1))[:, None]
        w *= np.array([0.6, 0.4]) * 30 / w.sum(axis=0)
    for (s, x), p in rates[0].items():
        i, j = "abc".index(s), ("en", "de").index(x)
        assert p == pytest.approx(w[i, j] / tokens[i, j] * 9 / 30, abs=1e-4)

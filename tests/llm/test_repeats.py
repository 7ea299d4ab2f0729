import hashlib
import random
from collections import Counter

from sangam.llm import jaccard, linededup, suffixdedup

from .helpers import LOWER, VISIBLE, awkward, prose, table


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    first = {}
    for i, d in enumerate(data):
        for k in range(len(d) - length + 1):
            first.setdefault(d[k : k + length], i)
    out = {}
    for i, d in enumerate(data):
        gone = [False] * len(d)
        for k in range(len(d) - length + 1):
            if first[d[k : k + length]] < i:
                gone[k : k + length] = [True] * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(d), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(d, gone, strict=True) if not g)).hexdigest())
    return out


def test_suffix_dedup_equals_brute_force(spark):
    texts = awkward() + [prose(i % 5, 60) + prose(100 + i, 40) for i in range(20)]
    for length, batch in ((50, 1 << 12), (30, 8 << 20)):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.remove_repeats(table(spark, texts), length, batch).collect()}
        assert got == brute_repeats(texts, length)


def test_suffix_dedup_of_nothing(spark):
    assert suffixdedup.remove_repeats(table(spark, []), 50).collect() == []
    kept = suffixdedup.remove_repeats(table(spark, ["short", None]), 50).orderBy("doc_id").collect()
    assert [bytes(r.kept) for r in kept] == [b"short", b""]


def test_suffix_index_finds_the_least_document_of_each_window():
    """Slices through the family against a dictionary of windows; levels as the bits of their number."""
    import numpy as np

    rng = np.random.default_rng(3)
    length, reach = 30, 6
    index, least = suffixdedup.SuffixIndex(length), {}
    motifs = rng.integers(97, 99, (4, length + reach)).astype(np.uint8)
    for n in range(13):
        block = motifs[rng.integers(0, 4, 40)].copy()
        block[np.arange(40), rng.integers(0, 36, 40)] = rng.integers(0, 256, 40)
        flags = rng.integers(1, 1 << (reach + 1), 40).astype(np.uint32)
        docs = np.sort(rng.integers(n * 10, n * 10 + 10, 40))
        new, place = index.array(np.concatenate([block[:, reach:], block[:, reach - 1 :: -1]], axis=1), flags, docs)
        got = index.scan(new)[place]
        index.add(new)
        windows = [[(o, row[reach - o : reach - o + length].tobytes()) for o in range(reach + 1) if f >> o & 1] for row, f in zip(block, flags.tolist(), strict=True)]
        for d, own in zip(docs.tolist(), windows, strict=True):
            for w in own:
                least[w] = min(d, least.get(w, d))
        for i, own in enumerate(windows):
            want = {o: least[o, w] for o, w in own}
            assert got[i].tolist() == [want.get(o, np.iinfo(np.int64).max) for o in range(reach + 1)]
    assert sorted(index.levels) == [0, 2, 3]  # 13 = 8 + 4 + 1
    for text, *_ in index.levels.values():
        assert [x.tobytes() for x in text] == sorted(x.tobytes() for x in text)


def brute_jaccard(texts, k, percent):
    sets = []
    for t in texts:
        w = VISIBLE.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def near_copies():
    base = [prose(9, 200).split(" "), prose(10, 60).split(" ")]
    out = []
    for i in range(60):
        words = list(base[i % 2])
        for j in range(i // 6):
            words[(j * 37 + i) % len(words)] = f"new{i}q{j}"
        out.append(" ".join(words))
    return out


def test_jaccard_join_equals_brute_force(spark):
    texts = awkward() + near_copies()
    for k, percent in ((3, 90), (5, 80), (2, 50)):
        want = brute_jaccard(texts, k, percent)
        for limit in (4_000_000, 600):  # the second deals the components in chunks
            got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(table(spark, texts), k, percent, limit, 1 << 12).collect()}
            assert got == want, (k, percent, limit)


def test_jaccard_join_of_nothing(spark):
    assert jaccard.join(table(spark, [])).collect() == []
    assert jaccard.keep_one(table(spark, [None, "", "a b", "a b"])).count() == 3


def brute_lines(texts, min_words):
    runs, places = {}, []
    for d, t in enumerate(texts):
        lines = [(p, x, len(VISIBLE.findall(x))) for p, x in enumerate((t or "").split("\n")) if VISIBLE.search(x)]
        for i in range(len(lines)):
            # every run with min_words words of which no line can be left out at one end
            for j in range(i + 1, len(lines) + 1):
                n = [x for _, _, x in lines[i:j]]
                if sum(n) >= min_words and (sum(n[1:]) < min_words or sum(n[:-1]) < min_words):
                    key = tuple(x for _, x, _ in lines[i:j])
                    runs.setdefault(key, (d, i))
                    places.append((d, i, key, lines[i][0], lines[j - 1][0] + 1))
    gone = {(d, p) for d, i, key, start, end in places if (d, i) > runs[key] for p in range(start, end)}
    return {d: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (d, p) not in gone) for d, t in enumerate(texts)}


def test_line_dedup_equals_brute_force(spark):
    shared = "\n".join(prose(77, 30).split("\n"))
    texts = awkward() + [prose(i, 50) + "\n" + shared + "\n\n" + prose(i + 500, 30 + i) for i in range(6)] + ["a b\n" * 90, "c\n\n" * 60 + "a b\n" * 30]
    for min_words in (5, 12, 40):
        cut = linededup.remove_runs(table(spark, texts), min_words)
        assert {r.doc_id: r.text for r in cut.collect()} == brute_lines(texts, min_words)


def test_line_dedup_drops_what_is_empty(spark):
    text = prose(5, 90)
    kept = linededup.dedup_lines(table(spark, [text, text, "", None, text + "\nown line"]))
    assert Counter(r.text for r in kept.collect()) == Counter([text, "", None, "own line"])
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert linededup.dedup_lines(table(spark, [])).collect() == []


def test_crowded_sketch_keeps_candidates_few(spark):
    """Shingles of some documents each that share their counters with many rare ones."""
    rng = random.Random(5)
    common = [f"c{i} d{i} e{i}" for i in range(1500)]
    texts = []
    for i in range(600):
        parts = [f"{i}a{j} {i}b{j} {i}c{j}" for j in range(25)] + rng.sample(common, 25)
        rng.shuffle(parts)
        texts.append(" ".join(parts))
    texts += [f"{x} tail" for x in texts[:40]]
    docs, bands = table(spark, texts), jaccard.Bands(90)
    counts = jaccard.count_sketch(jaccard.profile(docs, 3, 9), 9)
    assert counts.min() > 50
    by_sketch, order = jaccard.Order(counts, 0.15), jaccard.shingle_order(docs, 3, bands, 8, counts)
    assert order.exact is not None and order.exact.max() >= 8
    loose, tight = (jaccard.candidate_pairs(docs, 3, bands, 8, x).select("u", "v").distinct().count() for x in (by_sketch, order))
    assert 40 <= tight < 80 < 400 < loose
    groups = {r.doc_id: r.component_id for r in jaccard.join(docs, 3, 90, sketch_bits=9).collect()}
    assert groups == {i: i % 600 for i in range(640)}


def test_jaccard_join_with_a_small_sketch_equals_brute_force(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += [x + " z" for x in texts[:20]] + [None, "", texts[0]]
    for k, percent in ((3, 90), (5, 80), (1, 60)):
        want = brute_jaccard(texts, k, percent)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(table(spark, texts), k, percent, 200, 1 << 10, 4).collect()}
        assert got == want, (k, percent)

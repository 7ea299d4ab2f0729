"""Language identification by a linear-chain conditional random field.

A word (a run of letters) is described by hashed features: its byte trigrams
with both edges (n-grams), prefixes and suffixes of one to three bytes
(affixes), and the whole word (lexicon).  Each line is one chain; transitions
between the languages of neighbouring words are learned with the feature
weights.  Forward-backward gives each word's posterior, so code-switched text
gets word labels; a document's language is the one with the largest posterior
sum, and its score is that sum divided by the number of words.

The field is trained on the driver on a bounded sample (`max_docs` labelled
documents and `max_words` words a language, whole documents, chosen by a hash
of doc_id), cut and joined to code-switched sequences.  Prediction is one pass
over the Arrow batches; the weights travel with the function (about 1 MB).

Defined cases: null texts and texts without letters are `und` with score 0;
repeated documents get equal results; labels of null are not learned; without
any labelled document everything is `und`; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
BITS = 16
CHAIN = 32


@dataclass
class Field:
    languages: list[str]
    weights: np.ndarray  # (2**BITS, languages)
    transitions: np.ndarray  # log, (from, to)
    start: np.ndarray  # log


def _index(x: np.ndarray) -> np.ndarray:
    return ((x * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64)


def word_features(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(trigram index per byte; affix and lexicon indices, one column a word).
    `data` must be lower-cased and have a byte on each side of every word."""
    wide = np.where(LETTER[data], data, 0).astype(np.uint32)
    grams = np.zeros(len(data), np.int64)
    grams[1:-1] = _index(wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16))
    size = last - first
    own = []
    for k in (1, 2, 3):
        take = np.minimum(size, k)
        head, tail = np.full(len(first), 11 * k, np.uint32), np.full(len(first), 17 * k + 5, np.uint32)
        for i in range(k):
            head = head * np.uint32(257) + wide[first + np.minimum(i, take - 1)]
            tail = tail * np.uint32(257) + wide[last - 1 - np.minimum(i, take - 1)]
        own += [_index(head), _index(tail)]
    whole = c.range_hash(c.prefix_hash(data), first, last)
    own.append(_index((whole >> np.uint64(32)).astype(np.uint32)))
    return grams, np.stack(own)


def emissions(field: Field, data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    grams, own = word_features(data, first, last)
    edges = np.empty(2 * len(first), np.int64)
    edges[0::2], edges[1::2] = first, last
    score = np.empty((len(first), len(field.languages)), np.float32)
    for k in range(len(field.languages)):
        column = np.ascontiguousarray(field.weights[:, k])
        score[:, k] = np.add.reduceat(column[grams], edges)[0::2]
        for row in own:
            score[:, k] += column[row]
    return score


def messages(score: np.ndarray, start: np.ndarray, log_t: np.ndarray, log_0: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Emissions, transitions, forward and backward messages (scaled) over the
    chains [start[i], start[i+1]); no chain is empty."""
    n = np.diff(start)
    order = np.argsort(-n, kind="stable")
    at, n = start[:-1][order], n[order]
    e = np.exp(score - score.max(axis=1, keepdims=True)) + np.float32(1e-12)
    t = np.exp(log_t - log_t.max()).astype(np.float32)
    ahead, behind = np.empty_like(e), np.empty_like(e)
    longest = int(n[0]) if len(n) else 0
    alive = np.searchsorted(-n, -np.arange(longest), "left")  # chains longer than i
    a = None
    for i in range(longest):
        w = at[: alive[i]] + i
        a = e[w] * (np.exp(log_0 - log_0.max()).astype(np.float32) if i == 0 else a[: alive[i]] @ t)
        a /= a.sum(axis=1, keepdims=True)
        ahead[w] = a
    b = np.ones((0, score.shape[1]), np.float32)
    for i in range(longest - 1, -1, -1):
        m = alive[i]
        if m > len(b):
            b = np.concatenate([b, np.ones((m - len(b), score.shape[1]), np.float32)])
        w = at[:m] + i
        behind[w] = b
        b = (e[w] * b) @ t.T
        b /= b.sum(axis=1, keepdims=True)
    return e, t, ahead, behind


def posteriors(score: np.ndarray, start: np.ndarray, log_t: np.ndarray, log_0: np.ndarray) -> np.ndarray:
    """Forward-backward: each word's distribution over the languages."""
    _, _, gamma, behind = messages(score, start, log_t, log_0)
    gamma *= behind
    return gamma / gamma.sum(axis=1, keepdims=True)


def expectations(score: np.ndarray, start: np.ndarray, log_t: np.ndarray, log_0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' distributions, and the expected number of each transition:
    the sum over neighbours of forward x transition x emission x backward."""
    e, t, ahead, behind = messages(score, start, log_t, log_0)
    gamma = ahead * behind
    inner = np.ones(len(score), bool)
    inner[start[:-1]] = False
    j = np.flatnonzero(inner)
    pair = ahead[j - 1][:, :, None] * t[None] * (e[j] * behind[j])[:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    return gamma / gamma.sum(axis=1, keepdims=True), pair.sum(axis=0, dtype=float)


def fit(samples: list[tuple[str, str]], max_words: int = 40_000, epochs: int = 4, seed: int = 7) -> Field:
    """Adagrad on the chain likelihood of code-switched sequences."""
    languages = sorted({lang for _, lang in samples})
    rng = np.random.default_rng(seed)
    pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = []
    for k, lang in enumerate(languages):
        left = max_words
        for text, own in samples:
            if own == lang and left > 0:
                data = c.LOWER[np.frombuffer(b" " + text.encode() + b" ", np.uint8)]
                first, last = c.words_of(data, LETTER)
                if len(first):
                    grams, rows = word_features(data, first, last)
                    left -= len(first)
                    for i in range(0, len(first), 8):
                        pieces.append((grams, first[i : i + 8], last[i : i + 8], k, rows[:, i : i + 8]))
    n_lang = len(languages)
    weights, seen = np.zeros((1 << BITS, n_lang)), np.full((1 << BITS, n_lang), 1e-6)
    log_t, log_0 = np.zeros((n_lang, n_lang)), np.zeros(n_lang)
    # pieces of one language mostly follow each other: switches are rare but present
    for _ in range(epochs):
        order = rng.permutation(len(pieces))
        by_lang = [[p for p in order if pieces[p][3] == k] for k in range(n_lang)]
        queue = []
        while any(by_lang):
            k = int(rng.choice([k for k in range(n_lang) if by_lang[k]]))
            for _ in range(int(rng.integers(1, 6))):
                if by_lang[k]:
                    queue.append(by_lang[k].pop())
        for group in range(0, len(queue), 64):
            flat, word_of, gold = [], [], []
            n = 0
            for p in queue[group : group + 64]:
                grams, first, last, k, rows = pieces[p]
                for j in range(len(first)):
                    f = np.concatenate([grams[first[j] : last[j]], rows[:, j]])
                    flat.append(f)
                    word_of.append(np.full(len(f), n + j))
                n += len(first)
                gold.append(np.full(len(first), k))
            flat, word_of, gold = np.concatenate(flat), np.concatenate(word_of), np.concatenate(gold)
            score = np.stack([np.bincount(word_of, weights[flat, k], n) for k in range(n_lang)], axis=1).astype(np.float32)
            chains = np.append(np.arange(0, n, CHAIN), n)
            gamma, joint = expectations(score, chains, log_t, log_0)
            error = -gamma.astype(float)
            error[np.arange(n), gold] += 1
            used, inverse = np.unique(flat, return_inverse=True)
            for k in range(n_lang):
                g = np.bincount(inverse, error[word_of, k], len(used)) - 1e-4 * weights[used, k]
                seen[used, k] += g * g
                weights[used, k] += 0.2 * g / np.sqrt(seen[used, k])
            pair = np.ones(n, bool)
            pair[chains[:-1]] = False
            j = np.flatnonzero(pair)
            want = np.zeros((n_lang, n_lang))
            np.add.at(want, (gold[j - 1], gold[j]), 1)
            log_t += 0.5 * (want - joint) / max(1, len(j)) * n_lang
            log_0 += 0.1 * error[chains[:-1]].mean(axis=0)
    return Field(languages, weights.astype(np.float32), log_t.astype(np.float32), log_0.astype(np.float32))


def sample_of(docs: DataFrame, max_docs: int, text: str = "text", label: str = "lang") -> list[tuple[str, str]]:
    """max_docs labelled documents a language at most, by a hash of doc_id."""
    from pyspark.sql import Window

    ranked = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select("doc_id", label)
    order = Window.partitionBy(label).orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = [r.doc_id for r in ranked.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max_docs).select("doc_id").collect()]
    rows = docs.where(F.col("doc_id").isin(ids) & F.col(label).isNotNull()).select("doc_id", text, label).collect() if ids else []
    return [(r[1], r[2]) for r in sorted(rows, key=lambda r: (r[0], r[1] or "")) if r[1] is not None]


def train(docs: DataFrame, max_docs: int = 120, max_words: int = 40_000, epochs: int = 4) -> Field:
    return fit(sample_of(docs, max_docs), max_words, epochs)


def label_words(field: Field, text: str) -> list[tuple[str, str, float]]:
    """The words of one text with language and posterior."""
    out = []
    for _, _, data, starts, _ in c.chunks(c.as_text(pa.array([text]))):
        first, last, chain, gamma, _ = _score(field, data, starts)
        for s, e, g in zip(first, last, gamma, strict=True):
            out.append((data[s - 1 : e - 1].tobytes().decode(), field.languages[int(g.argmax())], float(g.max())))
    return out


def _score(field: Field, data: np.ndarray, starts: np.ndarray):
    low = np.empty(len(data) + 1, np.uint8)
    low[0] = c.SEPARATOR
    low[1:] = c.LOWER[data]
    first, last = c.words_of(low, LETTER)
    breaks = np.union1d(np.flatnonzero(low == 0x0A), starts)
    chain = np.unique(np.append(np.searchsorted(first, breaks), [0, len(first)]))
    gamma = posteriors(emissions(field, low, first, last), chain, field.transitions, field.start) if len(first) else np.zeros((0, len(field.languages)), np.float32)
    return first, last, chain, gamma, np.searchsorted(first, np.append(starts, len(low)))


def _predict(field: Field, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """lang_pred, score, n_words and n_foreign of each text."""
    names = np.array([*field.languages, "und"], object)
    pred, score, words, foreign = (np.full(len(texts), x, kind) for x, kind in ((len(names) - 1, int), (0.0, float), (0, int), (0, int)))
    for a, b, data, starts, ends in c.chunks(texts, 3 << 20):
        if not field.languages:
            break
        first, _, _, gamma, at = _score(field, data, starts)
        n = np.diff(at)
        sums = np.zeros((b - a, len(field.languages)))
        if len(first):
            full = np.flatnonzero(n)
            sums[full] = np.add.reduceat(gamma, at[:-1][full], axis=0)
        own = sums.argmax(axis=1)
        letters = n > 0
        ascii_letter = np.concatenate([[0], np.cumsum(LETTER[data] & (data < 128))])
        for i in np.flatnonzero(letters & (ascii_letter[ends] == ascii_letter[starts])):
            letters[i] = any(x.isalpha() for x in texts[a + int(i)].as_py())
        pred[a:b] = np.where(letters, own, len(names) - 1)
        score[a:b] = np.where(letters, sums.max(axis=1) / np.maximum(n, 1), 0.0)
        words[a:b] = n
        doc_of = np.repeat(np.arange(b - a), n)
        foreign[a:b] = np.bincount(doc_of[gamma.argmax(axis=1) != own[doc_of]], minlength=b - a) if len(first) else 0
    return names[pred], np.clip(score, 0, 1), words, foreign


def identify(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, n_words, n_foreign (words of another language)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score, words, foreign = _predict(field, c.as_text(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array(words, pa.int64()), pa.array(foreign, pa.int64())], names=["doc_id", "lang_pred", "score", "n_words", "n_foreign"])

    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double, n_words long, n_foreign long")


def reject_unknown(docs: DataFrame, field: Field, min_score: float = 0.5, text: str = "text") -> DataFrame:
    """Documents whose language is known with the given score; columns as they
    came.  Each row is judged by itself, in the pass that reads it."""
    where = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score, _, _ = _predict(field, c.as_text(batch.column(where)))
            yield batch.filter(pa.array((pred != "und") & (score >= min_score), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

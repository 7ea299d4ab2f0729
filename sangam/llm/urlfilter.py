"""URL filters: a bit-parallel wildcard automaton (multiword Shift-And).

All rules are packed end to end into 64-bit words, one bit per position.  One
pass over a canonical URL moves every rule at once:

    D' = (((D << 1) | starts) & accepts[byte]) | (D & loops[byte])

`loops` holds the bits after which a wildcard stands.  In the host part of a
rule `*` never crosses `/`; in the path part it matches anything.  URLs of a
batch are advanced together, one byte position at a time, as numpy rows.

A rule is written host + path, as `example.org/es/`; it fits its host and all
subdomains when the path starts with the rule's path.  `*` may stand anywhere.
The longest rule that fits wins; rules of the second class (`further`) count
where none of the first fits, in the same automaton and pass.  Canonical form:
`.` + host (A-Z lower-cased) + path.  The states of at most `STATE_BYTES` are
held at once, so that thousands of rules need no more memory than a few.

Defined cases: null, empty, or without `://`: host and path are empty and no
rule fits; very long URLs are followed to their end; equal rules: the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty without `://`."""
    found = F.instr(url, "://") > 0
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(found, lowered).otherwise(""), F.when(found, path).otherwise("")


STATE_BYTES = 8 << 20


class WildcardAutomaton:
    """All rules as one multiword Shift-And automaton."""

    def __init__(self, rules: list[str]):
        steps: list[tuple[int, str]] = []  # byte, loop kind after it ('' none, 'host', 'path')
        self.ends: list[int] = []
        starts: list[int] = []
        for rule in rules:
            host, slash, path = rule.partition("/")
            own = self._steps(("*." + host).encode(), "host") + self._steps((slash + path + "*").encode(), "path")
            starts.append(len(steps))
            steps += [(-1, "")]  # the bit of the rule's empty prefix
            for byte, loop in own:
                if byte < 0:
                    steps[-1] = (steps[-1][0], loop)
                else:
                    steps.append((byte, ""))
            self.ends.append(len(steps) - 1)
        self.width = max(1, -(-len(steps) // 64))
        bits = lambda where: np.packbits(np.isin(np.arange(self.width * 64), list(where)), bitorder="little").view(np.uint64)
        self.starts = bits(starts)
        self.accepts = np.stack([bits(i for i, (x, _) in enumerate(steps) if x == byte) for byte in range(256)])
        path, host = bits(i for i, (_, k) in enumerate(steps) if k == "path"), bits(i for i, (_, k) in enumerate(steps) if k in ("host", "path"))
        self.loops = np.stack([path if byte == 0x2F else host for byte in range(256)])

    @staticmethod
    def _steps(text: bytes, kind: str) -> list[tuple[int, str]]:
        return [(-1, kind) if byte == 0x2A else (byte, "") for byte in text]

    def run(self, texts: pa.Array) -> np.ndarray:
        """One row of flags per text: which rules fit the whole of it."""
        step = max(1, STATE_BYTES // (8 * self.width))
        return np.concatenate([np.zeros((0, len(self.ends)), bool), *(self._run(texts.slice(i, step)) for i in range(0, len(texts), step))])

    def _run(self, texts: pa.Array) -> np.ndarray:
        data, offsets = c.buffer_of(texts)
        start, length = offsets[:-1], np.diff(offsets)
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        state = np.tile(self.starts, (len(texts), 1))
        alive = len(texts)
        for i in range(int(length[0]) if len(length) else 0):
            alive = int(np.searchsorted(-length[:alive], -i, "left"))
            byte = data[start[:alive] + i]
            now = state[:alive]
            carry = np.zeros_like(now)
            carry[:, 1:] = now[:, :-1] >> np.uint64(63)
            state[:alive] = (((now << np.uint64(1)) | carry) & self.accepts[byte]) | (now & self.loops[byte])
        out = np.zeros((len(texts), len(self.ends)), bool)
        for k, end in enumerate(self.ends):
            out[order, k] = (state[:, end // 64] >> np.uint64(end % 64)) & np.uint64(1) == 1
        return out


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], key: str = "page_id", url: str = "url", default: str = "allow", further: list[tuple[str, str]] = ()) -> DataFrame:
    """key, host, path, rule (the longest that fits, or null), verdict.  A rule
    of `further` gives a verdict, but is not named."""
    every = [*rules, *further]
    automaton = WildcardAutomaton([r for r, _ in every])
    order = sorted(range(len(every)), key=lambda i: (i >= len(rules), -len(every[i][0].encode())))
    names = np.array([every[i][0] if i < len(rules) else None for i in order] + [None], object)
    verdicts = np.array([every[i][1] for i in order] + [default], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = automaton.run(c.as_text(batch.column(3)))[:, order]
            best = np.where(fits.any(axis=1), fits.argmax(axis=1), len(every)) if every else np.zeros(len(batch), int)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(names[best], pa.string()), pa.array(verdicts[best], pa.string())], names=[key, "host", "path", "rule", "verdict"])

    host, path = split_url(F.coalesce(F.col(url), F.lit("")))
    split = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    split = split.withColumn("canonical", F.when((F.col("host") == "") & (F.col("path") == ""), "").otherwise(F.concat(F.lit("."), "host", "path")))
    kind = dict(split.dtypes)[key]
    return split.mapInArrow(run, f"{key} {kind}, host string, path string, rule string, verdict string")


def read_rules(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Rules of a text file, `verdict host/path` a line; `#` begins a comment."""
    lines = (r[0].split("#")[0].split() for r in spark.read.text(path).collect())
    return [(rule, verdict) for verdict, rule in (x for x in lines if x)]

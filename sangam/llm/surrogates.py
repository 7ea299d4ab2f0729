"""PII surrogates: keyed, type-consistent replacements of personal data.

Detected: e-mail addresses, phone numbers, card numbers, IPv4 and IPv6
addresses, social security numbers, IBANs of valid check digits, quoted secrets
(`token = "..."`), street lines with a number, and persons: names after a title,
and pairs of names of which the first is a known given name.

A replacement has the form of the original: each letter becomes a letter of
the same script and case, each digit a digit, separators stay, as do country
codes, top-level domains and street words; card numbers keep their check
digit's validity, IBANs get valid check digits, IPv4 parts stay within 0 to 255,
and known given names become given names of the same gender and script.

It is a keyed permutation of all values of one form without fixed points: a
Feistel network with keyed SHAKE-256 rounds numbers the values, and each becomes
the one a keyed distance behind it in that numbering.  So different values stay
different, equal values, in any document and any case, stay equal, and no value
stays itself; no table of values and no second pass is needed, and lost tasks
give the same result again.  `check` counts exceptions in a corpus (there are none).

Defined cases: null texts stay null, empty ones empty; repeated rows get equal
results; very long texts are scanned whole; a value without any letter or digit
of a known script stays; other columns stay.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

TYPES = ("email", "phone", "card", "ip", "ssn", "secret", "person", "iban", "ipv6", "street")
ROUNDS = 8

# Given names by script and gender, and titles by gender.
GIVEN = {
    ("latin", "m"): ("Adam", "Bruno", "Carlos", "Daniel", "Erik", "Felix", "Georg", "Hugo", "Ivan", "James", "Karl", "Louis", "Martin", "Noah", "Oscar", "Paul", "Rahul", "Simon", "Thomas", "Victor"),
    ("latin", "f"): ("Alice", "Berta", "Clara", "Diana", "Emma", "Frida", "Greta", "Helena", "Ines", "Julia", "Karin", "Laura", "Maria", "Nina", "Olga", "Petra", "Priya", "Sofia", "Tanja", "Vera"),
    ("cyrillic", "m"): ("Алексей", "Борис", "Виктор", "Дмитрий", "Иван", "Михаил", "Николай", "Сергей"),
    ("cyrillic", "f"): ("Анна", "Вера", "Галина", "Елена", "Ирина", "Мария", "Наталья", "Ольга"),
}
TITLES = {"Mr": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sir": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Señora": "f"}
STREETS = ("Street", "St", "Avenue", "Ave", "Road", "Rd", "Lane", "Ln", "Boulevard", "Blvd", "Drive", "Square")
STREETS_DE = ("straße", "strasse", "weg", "platz", "allee", "gasse")
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåçèéêëìíîïñòóôõöøùúûüý", "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")
#: First and last letters of scripts that are used whole: Hebrew, Arabic, Devanagari, Hiragana, Katakana, Han, Hangul.
SCRIPTS = (("א", "ת"), ("ا", "ي"), ("क", "ह"), ("あ", "ん"), ("ア", "ン"), ("一", "龥"), ("가", "힣"))
HEX = "0123456789abcdef"
LETTERS = {ch: (a, i) for a in (*ALPHABETS, *("".join(map(chr, range(ord(x), ord(y) + 1))) for x, y in SCRIPTS)) for i, ch in enumerate(a)}
HEX_DIGITS = {ch: (HEX, i) for i, ch in enumerate(HEX)}
GENDERS = {name: g for (_, g), names in GIVEN.items() for name in names}

EMAIL = re.compile(r"(?<![\w.+-])[\w.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
NUMBER = re.compile(
    r"(?P<phone>\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d.])\(\d{3}\) ?\d{3}-\d{4}(?!\d))"
    r"|(?<![\d.\w])(?:(?P<card>\d(?:[ -]?\d){12,18})|(?P<ssn>\d{3}-\d{2}-\d{4})|(?P<ip>(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}))(?![\d\w]|\.\d)"
)
SECRET = re.compile(r"(?i)\b(?:token|api[_ -]?key|secret|password|passwd|pwd)[\"']?\s*[=:]\s*[\"']([^\"'\s]{6,})[\"']")
PERSON = re.compile(r"\b(" + "|".join(sorted(TITLES, key=len, reverse=True)) + r")\.? ([^\W\d_a-zа-я][^\W\d_]+)(?: ([^\W\d_a-zа-я][^\W\d_]+))?")


PAIR = re.compile(r"\b([^\W\d_a-zа-я][^\W\d_]+) ([^\W\d_a-zа-я][^\W\d_]+)")
IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:.])|(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![\w:.])")
STREET = re.compile(r"\b\d{1,5} (?:[A-Z][^\W\d_]+ ){1,3}(?:" + "|".join(STREETS) + r")\b|\b[A-ZÄÖÜ][^\W\d_]*(?:" + "|".join(STREETS_DE) + r") \d{1,4}\b")


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of the entities, in order, without overlaps."""
    found = []
    if "@" in text:
        found += [(*m.span(), "email") for m in EMAIL.finditer(text)]
    if "=" in text or ":" in text:
        found += [(*m.span(1), "secret") for m in SECRET.finditer(text)]
    if text.count(":") > 1:
        found += [(*m.span(), "ipv6") for m in IPV6.finditer(text) if m[0].count(":") == 7 or "::" in m[0]]
    found += [(*m.span(), "iban") for m in IBAN.finditer(text) if iban_rest(m[0]) == 1]
    found += [(*m.span(), m.lastgroup) for m in NUMBER.finditer(text)]
    found += [(*m.span(), "street") for m in STREET.finditer(text)]
    found += [(m.start(2), m.end(), "person:" + TITLES[m[1]]) for m in PERSON.finditer(text)]
    found += [(*m.span(), "person:" + GENDERS[m[1]]) for m in PAIR.finditer(text) if m[1] in GENDERS]
    out, last = [], 0
    for start, end, kind in sorted(found, key=lambda x: (x[0], -x[1])):
        if start >= last:
            out.append((start, end, kind))
            last = end
    return out


def iban_rest(value: str) -> int:
    """What ISO 7064 wants to be 1."""
    plain = value.replace(" ", "")
    return int("".join(str(int(ch, 36)) for ch in plain[4:] + plain[:4])) % 97


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else (2 * int(d)) // 10 + (2 * int(d)) % 10 for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


class Permutation:
    """Keyed permutations of values of one form."""

    def __init__(self, key: bytes):
        if not key:
            raise ValueError("a key is needed")
        self.key = key
        self.of = lru_cache(200_000)(self._of)

    def number(self, x: int, size: int, label: str) -> int:
        """A permutation of 0..size-1 that leaves none in its place (size > 1):
        all numbers in one keyed cycle."""
        if size <= 1:
            return 0
        step = 1 + self._hash(f"{label}|{size}|step", size - 1)
        return self._walk((self._walk(x, size, label, -1) + step) % size, size, label, 1)

    def _walk(self, x: int, size: int, label: str, way: int) -> int:
        """A keyed numbering of 0..size-1 or its inverse: Feistel over two residues, walked until inside."""
        a = math.isqrt(size - 1) + 1
        b = -(-size // a)
        rounds = range(ROUNDS)[::way]
        while True:
            left, right = divmod(x, b)
            for i in rounds:
                if i % 2:
                    right = (right + way * self._hash(f"{label}|{size}|{i}|{left}", b)) % b
                else:
                    left = (left + way * self._hash(f"{label}|{size}|{i}|{right}", a)) % a
            x = left * b + right
            if x < size:
                return x

    def _hash(self, what: str, size: int) -> int:
        """A keyed number below size (SHAKE-256, 128 bits wider than size)."""
        head = len(self.key).to_bytes(4, "big") + self.key
        return int.from_bytes(hashlib.shake_256(head + what.encode()).digest(size.bit_length() // 8 + 17), "big") % size

    def shape(self, value: str, label: str, letters: dict[str, tuple[str, int]] = LETTERS) -> str:
        """A value of the same form: symbols stay within their alphabets, others stay."""
        own = [letters.get(ch, ("", 0)) for ch in value]
        x, size = 0, 1
        for a, i in own:
            if a:
                x, size = x * len(a) + i, size * len(a)
        form = "".join(a[0] if a else ch for ch, (a, _) in zip(value, own, strict=True))
        y, out = self.number(x, size, f"{label}|{form}"), []
        for ch, (a, _) in zip(reversed(value), reversed(own), strict=True):
            if a:
                y, r = divmod(y, len(a))
            out.append(a[r] if a else ch)
        return "".join(reversed(out))

    def given(self, name: str, gender: str) -> str:
        for (script, g), names in GIVEN.items():
            if g == gender and name in names:
                return names[self.number(names.index(name), len(names), f"given|{script}|{g}")]
        new = self.shape(name, "name")
        while new in GENDERS and name not in GENDERS:  # known names are no one else's surrogates
            new = self.shape(new, "name")
        return new

    def _of(self, kind: str, value: str) -> str:
        if kind == "email":
            local, _, domain = value.lower().rpartition("@")
            labels = domain.split(".")
            head = self.shape(".".join(labels[:-1]), "domain")
            return recase(value, f"{self.shape(local, 'local')}@{head}.{labels[-1]}")
        if kind == "card":
            digits = re.sub(r"\D", "", value)
            new = self.shape(digits[:-1], "card" + str(luhn(digits)))
            check = next(d for d in "0123456789" if luhn(new + d))
            last = check if luhn(digits) else [d for d in "0123456789" if d != check][self.number([d for d in "0123456789" if not luhn(digits[:-1] + d)].index(digits[-1]), 9, "check|" + new)]
            return fill(value, new + last)
        if kind == "ip":
            x = 0
            for part in value.split("."):
                x = x * 256 + int(part)
            y = self.number(x, 1 << 32, "ip")
            return ".".join(str(y >> s & 255) for s in (24, 16, 8, 0))
        if kind == "phone":
            digits = re.sub(r"\D", "", value)
            code = len(re.match(r"\+?(\d*)", value)[1]) if value.startswith("+") else 0
            return fill(value, digits[:code] + self.shape(digits[code:], "phone|" + digits[:code]))
        if kind == "ipv6":
            return recase(value, self.shape(value.lower(), kind, HEX_DIGITS))
        if kind == "iban":
            plain = value.replace(" ", "")
            account = self.shape(plain[4:], "iban|" + plain[:2])
            return fill(value, f"{plain[:2]}{98 - iban_rest(plain[:2] + '00' + account):02d}{account}", str.isalnum)
        if kind == "street":
            word = next(m for m in re.finditer(r"(?:" + "|".join((*STREETS, *STREETS_DE)) + r")(?=$| \d)", value))
            head, tail = value[: word.start()], value[word.end() :]
            new = self.shape(head + tail, "street|" + word[0])
            return new[: len(head)] + word[0] + new[len(head) :]
        if kind == "secret" and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
            return recase(value, self.shape(value.lower(), "hex", HEX_DIGITS))
        if kind.startswith("person"):
            first, space, rest = value.partition(" ")
            return self.given(first, kind[-1]) + space + (self.shape(rest, "name") if rest else "")
        return self.shape(value, kind)


def fill(form: str, digits: str, holds=str.isdigit) -> str:
    left = iter(digits)
    return "".join(next(left) if holds(ch) else ch for ch in form)


def recase(form: str, value: str) -> str:
    return "".join(v.upper() if f.isupper() else v for f, v in zip(form, value, strict=True))


def normal(kind: str, value: str) -> str:
    """What makes two mentions the same entity."""
    if kind in ("card", "phone", "ssn"):
        return re.sub(r"[^\d+]", "", value)
    if kind == "iban":
        return value.replace(" ", "")
    if kind in ("email", "ipv6") or (kind == "secret" and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value)):
        return value.lower()
    return value


def _run(permutation: Permutation, text: str) -> tuple[str, list[tuple[str, str, str]]]:
    out, last, found = [], 0, []
    for start, end, kind in find(text):
        value = text[start:end]
        new = permutation.of(kind, value)
        found.append((kind.partition(":")[0], value, new))
        out += [text[last:start], new]
        last = end
    return ("".join([*out, text[last:]]) if found else text), found


def entities(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """kind, value and surrogate (both normalised), n: the distinct entities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permutation = Permutation(key)
        for batch in batches:
            rows = [(k, normal(k, v), normal(k, s)) for x in c.as_text(batch.column(0)).to_pylist() for k, v, s in _run(permutation, x)[1]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["kind", "value", "surrogate"])

    return docs.select(text).mapInArrow(run, "kind string, value string, surrogate string").groupBy("kind", "value", "surrogate").agg(F.count("*").alias("n"))


def check(found: DataFrame) -> tuple[int, int, int]:
    """(surrogates that stand for several values, values with several surrogates,
    values that are their own) among the entities."""
    twice = lambda a, b: found.groupBy("kind", a).agg(F.count_distinct(b).alias("m")).where("m > 1").count()
    return twice("surrogate", "value"), twice("value", "surrogate"), found.where("value = surrogate").count()


def replace(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """docs with surrogates in the text, and the columns n_<type> with the
    numbers of replaced entities (input columns of these names are replaced).
    One pass; the key decides all replacements and must be kept secret."""
    Permutation(key)  # a missing key fails here, not in a task
    docs = docs.select(*[x for x in docs.columns if x not in {f"n_{k}" for k in TYPES}])
    schema = T.StructType([*docs.schema.fields, *(T.StructField(f"n_{k}", T.LongType()) for k in TYPES)])
    where, names = docs.columns.index(text), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permutation = Permutation(key)
        for batch in batches:
            done = [(None, []) if x is None else _run(permutation, x) for x in batch.column(where).to_pylist()]
            columns = list(batch.columns)
            columns[where] = pa.array([x for x, _ in done], batch.schema.field(where).type)
            counts = [pa.array([sum(e[0] == k for e in own) for _, own in done], pa.int64()) for k in TYPES]
            yield pa.RecordBatch.from_arrays([*columns, *counts], names=names)

    return docs.mapInArrow(run, schema)

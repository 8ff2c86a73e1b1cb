"""Format-preserving pseudonyms for personal data.

Values are found by pattern, validated (checksums, calendar, ranges), and replaced by a keyed permutation of their own
format: a Feistel network over mixed-radix numbers, walked along its cycle until the result is valid again. A value has
one pseudonym under a key, whatever document it stands in, and two values never share one, so they stay linked.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import words as W

ROUNDS = 10
DIGITS, LOWERS, UPPERS = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
EPOCH, DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days


@lru_cache(maxsize=64)
def whole_key(key: bytes) -> bytes:
    """A key as it is, or its hash if it is longer than the hash function takes, so that every byte of it counts."""
    return key if len(key) <= 64 else hashlib.blake2b(key, digest_size=64).digest()


def permute(key: bytes, kind: str, x: int, size: int) -> int:
    """A keyed permutation of range(size), by alternating Feistel over the smallest a * b >= size."""
    if size < 2:
        return x
    key = whole_key(key)
    a = 1
    while a * a < size:
        a *= 2
    a = next(r for r in range(a // 2, a + 1) if r * r >= size) if a <= 4096 else a
    b = -(-size // a)
    while True:
        hi, lo = divmod(x, b)
        for r in range(ROUNDS):  # even rounds change hi by lo, odd rounds lo by hi
            seen = lo if r % 2 == 0 else hi
            f = int.from_bytes(hashlib.blake2b(b"%d|%d|%d" % (r, size, seen), key=key, person=kind.encode()[:16], digest_size=24).digest(), "big")
            if r % 2 == 0:
                hi = (hi + f) % a
            else:
                lo = (lo + f) % b
        x = hi * b + lo
        if x < size:
            return x


def spell(key: bytes, kind: str, text: str, alphabet: str) -> str:
    """Permute the characters of ``text`` that are in ``alphabet``, as one number; others stay in place."""
    at = {c: i for i, c in enumerate(alphabet)}
    own = [c for c in text if c in at]
    if not own:
        return text
    x = 0
    for c in own:
        x = x * len(alphabet) + at[c]
    y = permute(key, f"{kind}/{alphabet[0]}", x, len(alphabet) ** len(own))
    new = []
    for _ in own:
        y, r = divmod(y, len(alphabet))
        new.append(alphabet[r])
    return "".join(new.pop() if c in at else c for c in text)


def by_class(key: bytes, kind: str, text: str) -> str:
    for alphabet in (DIGITS, LOWERS, UPPERS):
        text = spell(key, kind, text, alphabet)
    return text


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _walk(value: str, step: Callable[[str], str], valid: Callable[[str], bool]) -> str:
    value = step(value)
    while not valid(value):
        value = step(value)
    return value


def _refill(pattern: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in pattern)


def card(key: bytes, text: str) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 13 <= len(digits) <= 19 or not luhn(digits) or len(set(digits)) == 1:
        return None

    def step(d: str) -> str:
        body = spell(key, "card", d[:-1], DIGITS)
        return body + next(c for c in DIGITS if luhn(body + c))

    return _refill(text, _walk(digits, step, lambda d: len(set(d)) > 1))


def phone(key: bytes, text: str) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 9 <= len(digits) <= 15:
        return None
    head = len(re.match(r"\+?(\d{0,3}?)(?=\D|\d{10}$)", text)[1]) if text[0] == "+" else 0  # the country's code stays
    return _refill(text, digits[:head] + spell(key, "phone", digits[head:], DIGITS))


def ssn(key: bytes, text: str) -> str | None:
    valid = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    digits = text.replace("-", "")
    if not valid(digits):
        return None
    return _refill(text, _walk(digits, lambda d: spell(key, "ssn", d, DIGITS), valid))


def ipv4(key: bytes, text: str) -> str | None:
    octets = [int(x) for x in text.split(".")]
    if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
        return None
    x = permute(key, "ipv4", int.from_bytes(bytes(octets), "big"), 1 << 32)
    return ".".join(map(str, x.to_bytes(4, "big")))


def iban(key: bytes, text: str) -> str | None:
    flat = text.replace(" ", "")
    check = lambda s: int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97
    if not 15 <= len(flat) <= 34 or check(flat) != 1:
        return None
    body = by_class(key, "iban", flat[4:])
    new = iter(f"{flat[:2]}{98 - check(flat[:2] + '00' + body):02d}{body}")
    return "".join(c if c == " " else next(new) for c in text)


def _date(parts: tuple[int, int, int]) -> date | None:
    try:
        d = date(*parts)
    except ValueError:
        return None
    return d if 0 <= (d - EPOCH).days < DAYS else None


def calendar_date(key: bytes, text: str) -> str | None:
    """y-m-d, d.m.y, and m/d/y, or d/m/y where the first number is no month. Equal days stay equal in every format."""
    sep = next(c for c in text if not c.isdigit())
    a, b, c = text.split(sep)
    if len(a) == 4:
        found, fmt, fits = _date((int(a), int(b), int(c))), lambda d: (f"{d.year:04d}", f"{d.month:0{len(b)}d}", f"{d.day:0{len(c)}d}"), lambda d: True
    elif sep == "/" and int(a) <= 12:
        found, fmt, fits = _date((int(c), int(a), int(b))), lambda d: (f"{d.month:0{len(a)}d}", f"{d.day:0{len(b)}d}", f"{d.year:04d}"), lambda d: True
    else:
        found, fmt = _date((int(c), int(b), int(a))), lambda d: (f"{d.day:0{len(a)}d}", f"{d.month:0{len(b)}d}", f"{d.year:04d}")
        fits = (lambda d: d.day > 12) if sep == "/" else (lambda d: True)
    if not found:
        return None
    d = found
    while True:
        d = EPOCH + timedelta(permute(key, "date", (d - EPOCH).days, DAYS))
        if fits(d):
            return sep.join(fmt(d))


def email(key: bytes, text: str) -> str:
    name, at, host = text.rpartition("@")
    return _long(name, lambda x: by_class(key, "email", x)) + at + host


def hexes(key: bytes, text: str) -> str | None:
    digits = re.search(r"[0-9A-Fa-f]{32,}$", text)[0]
    if not re.search(r"\d", digits) or not re.search(r"[A-Fa-f]", digits):
        return None
    alphabet = "0123456789ABCDEF" if digits.upper() == digits else "0123456789abcdef"
    return text[: len(text) - len(digits)] + spell(key, "hex", digits if alphabet[-1] == "F" else digits.lower(), alphabet)


def access_key(key: bytes, text: str) -> str:
    return text[:4] + spell(key, "access", text[4:], UPPERS + DIGITS)


#: Values longer than this are permuted block by block, in linear time and with numbers of bounded size.
LONGEST, BLOCK = 256, 64


def _long(value: str, one: Callable[[str], str]) -> str:
    if len(value) <= LONGEST:
        return one(value)
    return "".join(one(value[i : i + BLOCK]) for i in range(0, len(value), BLOCK))


def assigned(key: bytes, text: str) -> str | None:
    head, value = re.match(r"(\w+\s*[=:]\s*[\"']?)(.*)", text, re.DOTALL).groups()
    hexed = re.fullmatch(r"[0-9a-f]{16,}", value)
    one = (lambda x: spell(key, "hex", x, "0123456789abcdef")) if hexed else (lambda x: by_class(key, "secret", x))
    return head + _long(value, one)


#: kind, pattern, replacement (None: not valid, left alone). Tried in this order at each place. Every pattern is anchored
#: at the start of a run of its characters, so that long runs cost linear time.
KINDS: tuple[tuple[str, str, Callable[[bytes, str], str | None]], ...] = (
    ("email", r"(?<![\w.%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z0-9])", email),
    ("secret", r"(?<!\w)(?:password|passwd|secret|api_key|apikey|access_token)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_-]{8,}", assigned),
    ("access_key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])", access_key),
    ("hex", r"(?<![A-Za-z0-9])(?:[0-9A-Fa-f]{64}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{32})(?![A-Za-z0-9])", hexes),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", iban),
    ("date", r"(?<![\d./-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d/-])", calendar_date),
    ("ipv4", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)", ipv4),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", ssn),
    ("card", r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)", card),
    ("phone", r"(?<![\d(+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){3,5}(?!\d)", phone),
)
_ANY = re.compile("|".join(f"(?P<{k}>{p})" for k, p, _ in KINDS))
_MAKE = {k: f for k, _, f in KINDS}
_AFTER = {k: [(other, re.compile(p)) for other, p, _ in KINDS[i + 1 :]] for i, (k, _, _) in enumerate(KINDS)}
#: Kinds whose pattern may take in groups that follow a value: less of those, it may be valid.
_GROUPED = {"iban": re.compile(" "), "card": re.compile("[ -]"), "phone": re.compile("[ .-]")}
_HINT = re.compile(r"[0-9@=:]")


class Pseudonyms:
    """Finds and replaces under one key; the latest pseudonyms are remembered, ``cap`` at most."""

    def __init__(self, key: bytes, cap: int = 50_000):
        self.key, self.cap, self.known = key, cap, {}

    def of(self, kind: str, value: str) -> str | None:
        if (kind, value) not in self.known:
            if len(self.known) >= self.cap:
                self.known.clear()
            self.known[kind, value] = _MAKE[kind](self.key, value)
        return self.known[kind, value]

    def _valid(self, kind: str, value: str) -> tuple[str, str] | None:
        """The value, or the longest valid beginning of it that ends with one of its groups, and its pseudonym."""
        new = self.of(kind, value)
        if new is None and kind in _GROUPED:
            for cut in reversed([m.start() for m in _GROUPED[kind].finditer(value)]):
                if (new := self.of(kind, value[:cut])) is not None:
                    return value[:cut], new
        return None if new is None else (value, new)

    def text(self, text: str) -> tuple[str, list[dict]]:
        """Where the first pattern that matches finds nothing valid, later ones are tried at the same place, and then the places inside the match."""
        if not _HINT.search(text):
            return text, []
        out, spans, at = [], [], 0
        m = _ANY.search(text)
        while m:
            kind, start = m.lastgroup, m.start()
            found = self._valid(kind, m[0])
            if found is None:
                for other, pattern in _AFTER[kind]:
                    again = pattern.match(text, start)
                    if again and (found := self._valid(other, again[0])):
                        kind = other
                        break
            on = start + 1
            if found:
                value, new = found
                out += [text[at:start], new]
                spans.append({"kind": kind, "start": start, "length": len(value), "pseudonym": new})
                on = at = start + len(value)
            m = _ANY.search(text, on)
        return "".join(out) + text[at:] if out else text, spans


SPANS = "array<struct<kind:string,start:bigint,length:bigint,pseudonym:string>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("pseudonym", pa.string())]))
#: For queries over made-up tables only: it is public, so whoever reads this can undo the pseudonyms.
DEMONSTRATION_KEY = b"set spark.quern.pii.key"


def secret_key(spark: SparkSession, otherwise: bytes | None = None) -> bytes:
    """The key in spark.quern.pii.key; without one ``otherwise``, and without that an error."""
    named = spark.conf.get("spark.quern.pii.key", None)
    if not named and otherwise is None:
        raise ValueError("pseudonyms need a secret key: set spark.quern.pii.key or hand one over")
    return named.encode() if named else otherwise


def pseudonymise(docs: DataFrame, text: str = "text", key: bytes | None = None, spans: str | None = "pii_spans") -> DataFrame:
    """``docs`` with its text replaced, and ``spans``: kind, start and length (code points, in the old text), pseudonym.

    A null text stays null with no spans. Texts without a valid value stay as they are, byte for byte. A column that
    already has the name of ``spans`` is replaced; ``spans=None`` adds none. Without a key here or in spark.quern.pii.key it
    raises. Row order and repeated rows are kept, an
    empty table stays empty, and nothing is shuffled.
    """
    key = key or secret_key(docs.sparkSession)
    names = [c for c in docs.columns if c != spans]
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pseudonyms(key)
        for batch in batches:
            _, off = W.buffer(batch.column(at))
            for i, j in W.slices(off, 4_000_000):
                part = batch.slice(i, j - i)
                done = [(None, []) if t is None else p.text(t) for t in part.column(at).to_pylist()]
                cols = list(part.columns)
                cols[at] = pa.array([d[0] for d in done], pa.string())
                if spans:
                    cols.append(pa.array([d[1] for d in done], _ARROW))
                yield pa.RecordBatch.from_arrays(cols, [*part.schema.names, *([spans] if spans else [])])

    source = docs.select(*(F.col(f"`{c}`").cast("string").alias(c) if c == text else F.col(f"`{c}`") for c in names))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields), *([f"`{spans}` {SPANS}"] if spans else [])])
    return source.mapInArrow(run, schema)


def pii_digest(docs: DataFrame) -> DataFrame:
    """Query op9: doc_id, the text with pseudonyms, and how many values of which kind it held."""
    done = pseudonymise(docs.select("doc_id", "text"), key=secret_key(docs.sparkSession, DEMONSTRATION_KEY))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("pii_spans", lambda s: s["kind"]))), ",")
    return done.select("doc_id", "text", F.size("pii_spans").cast("long").alias("n_found"), kinds.alias("kinds"), (F.size("pii_spans") > 0).alias("changed"))

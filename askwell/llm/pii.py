"""Format-preserving pseudonyms of personal data by keyed Feistel permutations.

Every find is validated, read as a number in its kind's domain, permuted there by a Feistel network keyed by the kind, and written
back in the same format: separators, letter case and length stay, check digits and dates stay valid. A permutation is one to one,
so equal values have equal pseudonyms in all documents and different values of one format different ones; walking the cycle keeps results in the
format. The network's round function is BLAKE2b with a secret key: that of the session's setting ``spark.askwell.pseudonym.key``, or else one
that is drawn for the application and known to no one, so that its pseudonyms are linked with one another but with no other run's.

Kinds: payment card numbers (13 to 19 digits with a valid Luhn digit), bank account numbers (IBAN, valid check), telephone
numbers (North American plan, or a plus and 8 to 15 digits), social security numbers, IPv4 addresses, dates (ISO, or day and month
before the year, valid in the calendar, days and months of one digit or two; each of these forms is a format of its own), and, as numbers over
their alphabets, the local parts of mail addresses and credentials (access keys, values after ``password=`` or ``token =`` and the like; of
letters alone only behind an equals sign).

A card or bank account number may be read together with the groups behind it (a code, a year, a currency). If a find is not valid, its
shorter readings are tried, the longest first, which end where a group ends; if none is valid, search goes on behind the find's first character.

Defined results: null texts stay null, empty ones empty; whole texts are read; texts without finds are returned as they are; of up to
``SMALL`` values none is its own pseudonym, of more one may be, by a chance of one in their number; repeated rows and equal values get equal
pseudonyms; an empty table gives no rows; all other columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import secrets
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import lru_cache
from math import isqrt, prod

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from askwell.llm.common import slices, table

KEY_SETTING = "spark.askwell.pseudonym.key"
ROUNDS = 8
#: Permutations of as many numbers at most are tables, without a fixed point.
SMALL = 4096
FIRST_DAY, DAYS = date(1900, 1, 1), 73_049  # to the end of 2099

#: Nothing of any kind lacks all of these.
_HINT = re.compile(r"[0-9@=]")
_FINDS = re.compile(
    r"""(?P<mail>(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})
    |(?P<access>\b(?:AKIA|ASIA)[A-Z0-9]{16}\b)
    |(?P<secret>\b(?i:password|passwd|secret|token|api_?key)\s?[=:]\s?["']?)(?P<value>[A-Za-z0-9_/+-]{8,})
    |(?P<iban>\b[A-Z]{2}[0-9]{2}(?:\ ?[A-Z0-9]{4}){2,7}(?:\ ?[A-Z0-9]{1,3})?\b)
    |(?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9]))
    |(?P<day>(?<![\w.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}([./])[0-9]{1,2}\8[0-9]{4})(?![\w]|-[0-9]))
    |(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))
    |(?P<card>(?<![\w-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-]))
    |(?P<phone>(?<![\w])(?:\+?1[ .-]?)?(?:\([0-9]{3}\)\ ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![\w])
        |\+[0-9](?:[ .-]?[0-9]){7,14}(?![\w]))""",
    re.X,
)

#: Lengths of bank account numbers by country.
_IBAN_LENGTHS = {
    country: int(part[:2])
    for part in """15 NO|16 BE|18 DK FI FO GL NL SD FK|19 MK SI|20 AT BA EE KZ LT LU XK MN|21 CH HR LI LV|22 BG BH CR DE GB GE IE ME RS VA
        |23 AE GI IL IQ OM TL SO|24 AD CZ ES MD PK RO SA SE SK TN VG|25 PT LY ST|26 IS TR|27 FR GR IT MC MR SM BI DJ|28 AL AZ BY CY DO GT HU LB NI PL SV
        |29 BR EG PS QA UA|30 JO KW MU YE|31 MT SC|32 LC|33 RU""".split("|")
    for country in part.split()[1:]
}


def _readings(kind: str, text: str) -> Iterator[str]:
    """A find, then what it starts with and may be instead."""
    yield text
    if kind == "card":
        for end in reversed([i for i, c in enumerate(text) if c in " -"]):
            if sum(map(str.isdigit, text[:end])) >= 13:
                yield text[:end]
    elif kind == "iban":
        for end in reversed([i for i, c in enumerate(text) if c == " "]):
            n = end - text.count(" ", 0, end)
            if n == _IBAN_LENGTHS.get(text[:2], n) and n >= 15:
                yield text[:end]


class Feistel:
    """A keyed permutation of the integers from 0 to n - 1 for each tweak and n."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.table = lru_cache(maxsize=256)(self._table)

    def _table(self, n: int, tweak: str) -> list[int]:
        """The permutation of a small domain, its fixed points moved: round among themselves, a single one in exchange with the next number."""
        out = [self.permute(x, n, tweak) for x in range(n)]
        fixed = [x for x in range(n) if out[x] == x]
        if len(fixed) == 1 and n > 1:
            fixed.append((fixed[0] + 1) % n)
        moved = [out[x] for x in fixed[1:] + fixed[:1]]
        for x, y in zip(fixed, moved, strict=True):
            out[x] = y
        return out

    def moved(self, x: int, n: int, tweak: str) -> int:
        """As ``permute``; in small domains never ``x`` itself (but where there is nothing else)."""
        return self.table(n, tweak)[x] if n <= SMALL else self.permute(x, n, tweak)

    def permute(self, x: int, n: int, tweak: str, back: bool = False) -> int:
        if n < 2:
            return x
        a = isqrt(n - 1) + 1
        b = -(-n // a)
        salt = f"{tweak}:{n}:".encode()
        while True:
            left, right = divmod(x, b)
            for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
                other, m = (left, b) if i % 2 else (right, a)
                f = hashlib.blake2b(salt + b"%d:%d" % (i, other), key=self.key, digest_size=32).digest()
                step = int.from_bytes(f, "big") % m
                step = -step if back else step
                if i % 2:
                    right = (right + step) % b
                else:
                    left = (left + step) % a
            x = left * b + right
            if x < n:
                return x


def luhn_digit(digits: str) -> str:
    """The check digit to follow ``digits``."""
    total = sum(d if k % 2 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(digits))))
    return str(-total % 10)


def iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


class Pseudonyms:
    """Replaces the finds of a text; keeps a bounded number of values it has seen."""

    def __init__(self, key: bytes):
        self.feistel = Feistel(key)
        self.known = lru_cache(maxsize=100_000)(self._of)

    def _digits(self, text: str, tweak: str, fits: Callable[[str], bool] = lambda s: True) -> str:
        """Other digits of the same length that fit, put in the places of those of ``text``."""
        own = "".join(c for c in text if c.isdigit())
        new = own
        while True:
            new = f"{self.feistel.moved(int(new), 10 ** len(own), tweak):0{len(own)}d}"
            if fits(new):
                break
        return _in_places(text, new)

    def _letters(self, text: str, tweak: str) -> str:
        """Letters and digits permuted as one number of mixed base; case and other characters stay."""
        bases = [10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 1 for c in text]
        x, n = 0, 1
        for c, b in zip(text, bases, strict=True):
            if b > 1:
                x, n = x * b + (int(c) if b == 10 else ord(c.lower()) - 97), n * b
        x, out = self.feistel.moved(x, n, tweak), []
        for c, b in zip(reversed(text), reversed(bases), strict=True):
            if b > 1:
                x, d = divmod(x, b)
                c = str(d) if b == 10 else chr((65 if c.isupper() else 97) + d)
            out.append(c)
        return "".join(reversed(out))

    def _of(self, kind: str, text: str) -> str | None:
        """The pseudonym of a find, or None if it is not valid."""
        tweak = kind
        if kind == "mail":
            local, at, host = text.rpartition("@")
            return self._letters(local, tweak) + at + host
        if kind == "access":
            return text[:4] + self._letters(text[4:], tweak)
        if kind == "value":
            if re.fullmatch("[0-9a-f]+", text) and any(map(str.isdigit, text)):
                return f"{self.feistel.permute(int(text, 16), 16 ** len(text), tweak):0{len(text)}x}"
            return self._letters(text, tweak)
        if kind == "iban":
            plain = text.replace(" ", "")
            if not 15 <= len(plain) <= 34 or iban_check(plain[:2], plain[4:]) != plain[2:4]:
                return None
            rest = self._letters(plain[4:], tweak)
            return _in_places(text, plain[:2] + iban_check(plain[:2], rest) + rest, str.isalnum)
        if kind == "ip":
            parts = text.split(".")
            if any(int(x) > 255 or x != str(int(x)) for x in parts):
                return None
            least = [(0, 10, 100)[len(x) - 1] for x in parts]  # parts keep their number of digits
            bases, x = [(10, 90, 156)[len(x) - 1] for x in parts], 0
            for part, low, base in zip(parts, least, bases, strict=True):
                x = x * base + int(part) - low
            x, out = self.feistel.moved(x, prod(bases), f"{tweak}{bases}"), []
            for low, base in zip(reversed(least), reversed(bases), strict=True):
                x, d = divmod(x, base)
                out.append(str(low + d))
            return ".".join(reversed(out))
        if kind == "day":
            return self._day(text, tweak)
        if kind == "ssn":
            ok = lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"
            return self._digits(text, tweak, ok) if ok(text.replace("-", "")) else None
        if kind == "card":
            plain = "".join(filter(str.isdigit, text))
            if luhn_digit(plain[:-1]) != plain[-1] or len(set(plain)) == 1:
                return None
            body = self._digits(plain[:-1], tweak)
            return _in_places(text, body + luhn_digit(body))
        plain = "".join(filter(str.isdigit, text))
        if text[0] != "+" or len(plain) == 11 and plain[0] == "1":
            lead = 1 if len(plain) == 11 else 0
            ok = lambda s: s[0] > "1" and s[3] > "1"
            if len(plain) not in (10, 11) or not ok(plain[lead:]):
                return None
            return _in_places(text, plain[:lead] + self._digits(plain[lead:], tweak, ok))
        return _in_places(text, plain[:2] + self._digits(plain[2:], tweak)) if 8 <= len(plain) <= 15 else None

    def _day(self, text: str, tweak: str) -> str | None:
        """Another day, written as this one is: so many digits, the month or the day first."""
        sep = next(c for c in text if not c.isdigit())
        parts = text.split(sep)
        y, m, d = parts if sep == "-" else (parts[2], parts[1], parts[0])
        swapped = sep != "-" and int(m) > 12 >= int(d)  # month first
        if swapped:
            m, d = d, m
        try:
            x = (date(int(y), int(m), int(d)) - FIRST_DAY).days
        except ValueError:
            return None
        if not 0 <= x < DAYS:
            return None
        while True:
            x = self.feistel.permute(x, DAYS, f"{tweak}{len(m)}{len(d)}{swapped}")
            new = FIRST_DAY + timedelta(days=x)
            if (new.month < 10 or len(m) == 2) and (new.day < 10 or len(d) == 2) and (new.day > 12 or not swapped):
                break
        day, month = f"{new.day:0{len(d)}d}", f"{new.month:0{len(m)}d}"
        return f"{new.year:04d}-{month}-{day}" if sep == "-" else sep.join((*((month, day) if swapped else (day, month)), f"{new.year:04d}"))

    def replace(self, text: str | None) -> tuple[str | None, int]:
        """The text with its pseudonyms, and how many it got."""
        if not text or not _HINT.search(text):
            return text, 0
        count, done, at, out = 0, 0, 0, []
        while m := _FINDS.search(text, at):
            kind = next(k for k in ("value", "mail", "access", "iban", "ip", "day", "ssn", "card", "phone") if m[k] is not None)
            start, new = m.start(kind), None
            for reading in _readings(kind, m[kind]):
                if kind == "value" and not any(map(str.isdigit, reading)) and "=" not in m["secret"]:
                    continue  # behind a colon it may be a word of the text
                new = self.known(kind, reading)
                if new is not None:
                    break
            if new is None:
                at = m.start() + 1
                continue
            out += text[done:start], new
            done = at = start + len(reading)
            count += 1
        return "".join([*out, text[done:]]) if count else text, count


def _in_places(text: str, new: str, place: Callable[[str], bool] = str.isdigit) -> str:
    """``new``'s characters in those places of ``text`` that hold a digit (or as ``place`` says)."""
    it = iter(new)
    return "".join(next(it) if place(c) else c for c in text)


@lru_cache(maxsize=4)
def pseudonyms(key: bytes) -> Pseudonyms:
    return Pseudonyms(key)


_drawn: dict[str, bytes] = {}


def session_key(spark: SparkSession) -> bytes:
    """The key of the session's setting, or one drawn once for the application."""
    named = spark.conf.get(KEY_SETTING, None) or spark.sparkContext.getConf().get(KEY_SETTING)
    return named.encode() if named else _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def pseudonymise(df: DataFrame, text_col: str = "text", key: bytes | None = None, count_col: str | None = None) -> DataFrame:
    """All columns of ``df``, the text with its pseudonyms; with ``count_col``, how many each text got, in place of a column of that name."""
    key = session_key(df.sparkSession) if key is None else key
    df = df.drop(count_col) if count_col else df
    names = df.columns
    at = names.index(text_col)
    schema = T.StructType([*df.schema.fields, *([T.StructField(count_col, T.LongType())] if count_col else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pseudonyms(key)
        for b in slices(batches):
            done = [p.replace(t) for t in b.column(at).to_pylist()]
            cols = [*b.columns]
            cols[at] = pa.array([d[0] for d in done], b.schema.field(at).type)
            if count_col:
                cols.append(pa.array([d[1] for d in done], pa.int64()))
            yield pa.RecordBatch.from_arrays(cols, names + [count_col] * bool(count_col))

    return df.mapInArrow(run, schema)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its pseudonyms, and how many it got."""
    return pseudonymise(table(spark, sf_dir, "documents"), count_col="n_pseudonyms")

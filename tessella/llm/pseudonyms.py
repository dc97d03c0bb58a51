"""Operator 9, PII: format-preserving Feistel pseudonyms.

Validated values (card numbers by Luhn, IBANs by their remainder, IPv4 addresses, telephone numbers,
US social security numbers, calendar dates, hexadecimal secrets, access keys, e-mail names) are read as one
number of a finite range, permuted within that range by a keyed Feistel network, and written back
into the same format: the same separators, lengths, letter case, and valid check digits. A value has
the same pseudonym wherever and however it is written, so documents stay linked, and the holder of
the key can undo it. What fails validation is left alone.

Dates from 1900 to 2099 map to such dates; 1/2/2003 is read as month/day, or as day/month where the
former is no date; a time after a date stays. An e-mail's domain, a telephone number's country code and
an access key's prefix stay. Of ten digits without a country code, those of a North American number become such a number, and
others another, in every spelling. Hexadecimal secrets are taken after a quote, equals sign or colon; other
kinds of secrets (passwords in words, keys of further vendors) are not looked for.

Defined results: a null text stays null, an empty one empty, both without finds; a very long text or
value is treated whole; rows that share an id are treated one by one; overlapping candidates are taken
from the left, in the order of the pattern; an empty table gives an empty result; further columns,
however named, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from datetime import date, timedelta
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 10
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)
#: For the query; real use passes its own key.
DEMO_KEY = b"a key for demonstration only"

PATTERN = re.compile(
    r"""
      (?P<email>(?<![\w.+-])[^\W_][\w.+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})
    | (?P<secret>(?:(?<=[="':])|(?<=[=:]\ ))(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z]))
    | (?P<token>(?<!\w)(?:A[KS]IA[0-9A-Z]{16}|gh[oprsu]_[0-9A-Za-z]{36})(?!\w))
    | (?P<iban>(?<!\w)[A-Z]{2}\d{2}(?:\ ?[A-Z0-9]{4}){2,7}(?:\ ?[A-Z0-9]{1,3})?(?!\w))
    | (?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,2}(?!\d)
              |(?<![\w+])\+\d{1,3}(?:[ .-]\d{2,4}){2,5}(?!\d)|(?<![\w+])\+\d{9,15}(?!\d)
              |(?<![\w.+-])\d{3}(?P<gap>[.-])\d{3}(?P=gap)\d{4}(?![\w-]|\.\d))
    | (?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d))
    | (?P<date>(?<![\w.-])(?:(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2})(?:(?=T\d{2}:)|(?![\w-]))|\d{1,2}(?P<mark>[./-])\d{1,2}(?P=mark)\d{4}(?![\w-])))
    | (?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))
    | (?P<card>(?<![\w.-])(?:\d{4}(?P<four>[ -])\d{4}(?P=four)\d{4}(?P=four)\d{1,7}|\d{4}(?P<six>[ -])\d{6}(?P=six)\d{5}|\d{13,19})(?![\w]|[.-]\d))
    """,
    re.VERBOSE,
)
KINDS = ("email", "secret", "token", "iban", "phone", "ip", "date", "ssn", "card")
#: Every valid value has one of these; most of a text is never searched for more.
HINT = re.compile(r"[\d@]|A[KS]IA|gh[oprsu]_")
#: What may go on a value after a space: a token with a digit, capital or bracket.
MORE = re.compile(r" [^\s\dA-Z(+]*[\dA-Z(+]\S*")
RESULT = "doc_id {}, n_found long, text string, found array<struct<kind:string,start:int,stop:int,pseudonym:string>>"


class Feistel:
    """Keyed permutations of the numbers below any size."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, i: int, x: int, tweak: str, size: int) -> int:
        """A number drawn from so many bits that it is even below ``size``."""
        need = size.bit_length() // 8 + 17
        message = f"{tweak}|{i}|{x:x}".encode()
        if need <= 64:
            return int.from_bytes(hashlib.blake2b(message, key=self.key, digest_size=64).digest(), "big")
        return int.from_bytes(hashlib.shake_256(self.key + message).digest(need), "big")

    def _once(self, x: int, a: int, b: int, tweak: str, back: bool) -> int:
        left, right = divmod(x, b)
        for i in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            # even rounds move the left half, odd ones the right
            if i % 2 == 0:
                left = (left + (-1 if back else 1) * self._round(i, right, tweak, a)) % a
            else:
                right = (right + (-1 if back else 1) * self._round(i, left, tweak, b)) % b
        return left * b + right

    def permute(self, x: int, size: int, tweak: str, back: bool = False) -> int:
        """``x`` of 0 to size - 1 to another such number; ``back`` undoes it. Walks on from numbers past the size."""
        b = isqrt(size - 1) + 1
        a = -(-size // b)
        x = self._once(x, a, b, f"{tweak}|{size:x}", back)
        while x >= size:
            x = self._once(x, a, b, f"{tweak}|{size:x}", back)
        return x


def luhn_digit(digits: str) -> str:
    """The check digit that completes ``digits``."""
    total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(digits)))
    return str(-total % 10)


def iban_digits(country: str, account: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


NORTH_AMERICAN = re.compile(r"[2-9]\d\d[2-9]\d{6}").fullmatch
LETTERS = {"d": "0123456789", "l": "abcdefghijklmnopqrstuvwxyz", "x": "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"}


class Pseudonyms:
    def __init__(self, key: bytes, back: bool = False):
        self.feistel, self.back = Feistel(key), back

    def digits(self, digits: str, tweak: str) -> str:
        return f"{self.feistel.permute(int(digits), 10 ** len(digits), tweak, self.back):0{len(digits)}d}" if digits else ""

    def characters(self, text: str, tweak: str) -> str:
        """Digits become digits and letters letters, in their case; all else stays."""
        low = [c.lower() if len(c.lower()) == 1 else c for c in text]
        kinds = [next((a for a in LETTERS.values() if c in a), None) for c in low]
        number, size = 0, 1
        for c, a in zip(low, kinds, strict=True):
            if a:
                number, size = number * len(a) + a.index(c), size * len(a)
        if size == 1:
            return text
        number = self.feistel.permute(number, size, tweak + "|" + "".join("." if a is None else str(len(a)) + "," for a in kinds), self.back)
        out = list(text)
        for i in range(len(text) - 1, -1, -1):
            if a := kinds[i]:
                number, c = divmod(number, len(a))
                out[i] = a[c].upper() if text[i].isupper() and len(a[c].upper()) == 1 else a[c]
        return "".join(out)

    def of(self, kind: str, text: str) -> str | None:
        """The pseudonym of a candidate, or None where it isn't valid."""
        return getattr(self, kind)(text)

    def email(self, text: str) -> str:
        name, _, domain = text.rpartition("@")
        return self.characters(name, "email|" + domain.lower()) + "@" + domain

    def secret(self, text: str) -> str:
        value = self.feistel.permute(int(text, 16), 16 ** len(text), "secret", self.back)
        return f"{value:0{len(text)}{'X' if any('A' <= c <= 'F' for c in text) else 'x'}}"

    def iban(self, text: str) -> str | None:
        plain = text.replace(" ", "")
        country, account = plain[:2], plain[4:]
        if not 15 <= len(plain) <= 34 or plain[2:4] != iban_digits(country, account):
            return None
        account = self.characters(account, "iban|" + country)
        return _refill(text, country + iban_digits(country, account) + account)

    def phone(self, text: str) -> str | None:
        code = re.match(r"\+(1(?=\D|\d{10}$)|\d{1,3}(?=\D)|\d\d)", text)
        at = code.end() if code else 0
        digits = re.sub(r"\D", "", text[at:])
        if not 6 <= len(digits) <= 14:
            return None
        tweak = "phone|" + (code[1] if code else "")
        new = self.digits(digits, tweak)
        while not code and bool(NORTH_AMERICAN(digits)) != bool(NORTH_AMERICAN(new)):
            new = self.digits(new, tweak)
        return text[:at] + _refill(text[at:], new)

    def token(self, text: str) -> str:
        return text[:4] + self.characters(text[4:], "token|" + text[:4])

    def ip(self, text: str) -> str | None:
        parts = [int(x) for x in text.split(".")]
        if max(parts) > 255:
            return None
        value = self.feistel.permute(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip", self.back)
        return ".".join(map(str, value.to_bytes(4, "big")))

    def date(self, text: str) -> str | None:
        a, b, c = map(int, re.split(r"[./-]", text))
        if text[:4].isdigit():
            orders = [("ymd", (a, b, c))]
        elif "." in text:
            orders = [("dmy", (c, b, a))]
        else:
            orders = [("mdy", (c, a, b)), ("dmy", (c, b, a))]
        for order, ymd in orders:
            try:
                day = date(*ymd)
            except ValueError:
                continue
            if not FIRST_DAY <= day <= LAST_DAY:
                return None
            span = (LAST_DAY - FIRST_DAY).days + 1
            at = (day - FIRST_DAY).days
            short = any(len(x) == 1 for x in re.split(r"[./-]", text))
            while True:  # on to a date that is read in the same order and style, so that it can be undone
                at = self.feistel.permute(at, span, "date", self.back)
                new = FIRST_DAY + timedelta(at)
                if (order != "dmy" or "." in text or new.day > 12) and not (short and min(new.day, new.month) > 9):
                    break
            y, m, d = (str(x).zfill(w) for x, w in ((new.year, 4), (new.month, 2 - short), (new.day, 2 - short)))
            first, second = re.findall(r"[./-]", text)
            return first.join({"ymd": (y, m), "dmy": (d, m), "mdy": (m, d)}[order]) + second + (d if order == "ymd" else y)
        return None

    def ssn(self, text: str) -> str | None:
        area, group, serial = text.split("-")
        if area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000":
            return None
        digits = text.replace("-", "")
        while True:
            digits = self.digits(digits, "ssn")
            if digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000":
                return _refill(text, digits)

    def card(self, text: str) -> str | None:
        digits = re.sub(r"\D", "", text)
        if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1]:
            return None
        payload = self.digits(digits[:-1], "card")
        return _refill(text, payload + luhn_digit(payload))

    def replace(self, text: str) -> tuple[str, list[tuple[str, int, int, str]]]:
        """The text with pseudonyms, and (kind, start, stop, pseudonym) by place in the old text."""
        out, found, at = [], [], 0
        for m in (m for start, stop in regions(text) for m in PATTERN.finditer(text, start, stop)):
            kind = next(k for k in KINDS if m[k] is not None)
            if (new := self.of(kind, m[0])) is not None:
                found.append((kind, m.start(), m.end(), new))
                out += text[at : m.start()], new
                at = m.end()
        return "".join(out) + text[at:], found


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Stretches, bounded by white space, outside of which no value lies."""
    stop = 0
    while hint := HINT.search(text, stop):
        start = hint.start()
        while start > stop and not text[start - 1].isspace():
            start -= 1
        # an IBAN or a telephone number may begin a token or two before its first digit
        for _ in range(2):
            before = max(stop, start - 8)
            cut = text.rfind(" ", before, max(before, start - 1))
            start = cut + 1 if cut >= 0 else start
        stop = hint.end()
        while stop < len(text) and not text[stop].isspace():
            stop += 1
        while more := MORE.match(text, stop):
            stop = more.end()
        yield start, stop


def _refill(text: str, characters: str) -> str:
    """``text`` with its letters and digits replaced in turn."""
    fresh = iter(characters)
    return "".join(next(fresh) if c.isalnum() else c for c in text)


def pseudonymised(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", back: bool = False) -> DataFrame:
    """(doc_id, n_found, text, found): the text with pseudonyms and where each was put."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("pseudonym", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key, back)
        for batch in batches:
            texts, finds = [], []
            for text in batch.column("text").to_pylist():
                new, found = names.replace(text) if text else (text, [])
                texts.append(new)
                finds.append([dict(zip(("kind", "start", "stop", "pseudonym"), f, strict=True)) for f in found])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, finds), pa.int64()), pa.array(texts, pa.string()), pa.array(finds, kind)], names=["doc_id", "n_found", "text", "found"])

    return source.mapInArrow(run, RESULT.format(source.schema["doc_id"].dataType.simpleString()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(spark.read.parquet(f"{sf_dir}/documents.parquet"), DEMO_KEY)

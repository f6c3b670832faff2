"""Pseudonyms for personal data that keep its format: keyed permutations by Feistel networks."""

from __future__ import annotations

import re
from collections import Counter
from datetime import date
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from measureframe.llm.store import short

ROUNDS = 8
KINDS = ("card", "phone", "iban", "ssn", "ip", "date", "email")


class Permutation:
    """A keyed permutation of the integers below ``size``.

    A balanced Feistel network permutes the next power of four; a value that
    falls outside is permuted again until it falls inside, which is a permutation of the smaller set.
    """

    def __init__(self, key: bytes, tweak: str, size: int) -> None:
        self.size = size
        self.half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.keyed = blake2b(f"{tweak}/{size}/".encode(), key=key[:64], digest_size=32)
        self.wide = (self.half + 7) // 8

    def _round(self, i: int, value: int) -> int:
        h = self.keyed.copy()
        h.update(bytes([i]) + value.to_bytes(self.wide, "big"))
        return int.from_bytes(h.digest(), "big") & self.mask

    def _once(self, value: int, back: bool) -> int:
        left, right = value >> self.half, value & self.mask
        if back:
            for i in reversed(range(ROUNDS)):
                left, right = right ^ self._round(i, left), left
        else:
            for i in range(ROUNDS):
                left, right = right, left ^ self._round(i, right)
        return left << self.half | right

    def apply(self, value: int, back: bool = False) -> int:
        if not 0 <= value < self.size:
            raise ValueError(value)
        while True:
            value = self._once(value, back)
            if value < self.size:
                return value


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _refill(shape: str, digits: str) -> str:
    """The digits put where ``shape`` has digits; all else stays."""
    take = iter(digits)
    return re.sub("[0-9]", lambda _: next(take), shape)


# Bounded patterns that begin and end at no letter or digit; validation follows.
_PATTERNS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9][\w.+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "date": r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?!(?!T[0-9]{2}:)[0-9A-Za-z/-]|\.[0-9])",
    "ip": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z+])\+[2-9][0-9]{0,2}(?:[ .-]?\([0-9]{1,4}\))?(?:[ .-]?[0-9]){6,12}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])",
}
_COMPILED = {k: re.compile(p) for k, p in _PATTERNS.items()}
#: Characters of an IBAN by country.
_IBAN_LENGTHS = {c: int(w[:2]) for w in (
    "15NO 16BE 18DKFIFKFOGLNLSD 19MKSI 20ATBAEEKZLTLUMNXK 21CHHRLILV 22BGBHCRDEGBGEIEMERSVA 23AEGIILIQOMSOTL 24ADCZESMDPKROSASESKTNVG "
    "25AOCVGWLYMZPTST 26DZIRISTR 27BICFCGCMDJFRGAGFGPGQGRITKMMCMGMQMRNCPFPMRESMTDTFWFYTBLMF 28ALAZBFBJBYCICYDOGTHNHULBMAMLNENIPLSNSVTG "
    "29BREGPSQAUA 30JOKWMUYE 31MTSC 32LC 33RU").split() for c in re.findall("[A-Z]{2}", w[2:])}
_IBANS = {n: re.compile(rf"(?<![0-9A-Za-z])[A-Z]{{2}}[0-9]{{2}}(?: ?[0-9A-Z]{{4}}){{{(n - 4) // 4}}}" + (f" ?[0-9A-Z]{{{n % 4}}}" if n % 4 else "") + "(?![0-9A-Za-z])")
          for n in set(_IBAN_LENGTHS.values())}
#: Country codes of two digits; 7 has one, all others three.
_TWO_DIGITS = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Digits of a full number behind the country code; where it is not known, a number may have any length.
_FULL = {c: int(n) for n, w in (part.split(":") for part in (
    "7:354 423 960,8:45 47 53 65 216 226 227 230 266 267 356 357 370 371 372 373 374 382 383 386 387 389 852 853 961 965 968 973 974 975 976 993,"
    "9:27 31 32 33 34 36 40 41 46 48 51 56 61 66 93 94 212 213 218 221 233 237 243 244 249 250 251 254 255 256 258 260 261 263 264 265 351 352 353 355 358 359 "
    "375 377 380 381 385 420 421 855 886 962 963 966 967 970 971 972 992 994 995 996 998,"
    "10:7 20 30 39 43 44 49 52 57 58 60 63 64 81 82 84 90 91 92 95 98 225 229 234 378 880 964 977,11:54 55 62 86").split(",")) for c in w.split()}
#: What begins a number of another kind, or a time, by its shape alone, as a pseudonym keeps that.
_BEGINS = re.compile("|".join([*(_PATTERNS[k] for k in ("date", "ip", "ssn", "card")), "[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])", "[0-9]{1,2}:[0-9]{2}"]))
_NUMBERS = tuple(k for k in _PATTERNS if k != "email")
#: Where data may be: every mail sign, every first digit of a run.
_HINT = re.compile("@|(?<![0-9])[0-9]")
_LOCAL = re.compile(r"[\w.+-]{1,64}\Z")
_FIRST_DAY, _DAYS = date(1000, 1, 1).toordinal(), date(9999, 12, 31).toordinal() - date(1000, 1, 1).toordinal() + 1
_ALPHABETS = {c: a for a in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789") for c in a}


class Pseudonyms:
    """Replaces validated personal data; equal values get equal pseudonyms under one key, in any text.

    Cards (Luhn) keep their first digit and length and get the right check digit; phone numbers keep
    the country's part; IBANs (checksum, the country's length) keep the country and get the right checksum; social security
    numbers stay valid; IPv4 addresses and dates of the years 1000 to 9999 stay valid, and one day
    has one pseudonym in all three formats; the local part of a mail address keeps the class of each of its
    characters, and its domain.  What fails its validation is left as it is.
    """

    def __init__(self, key: bytes) -> None:
        self.key = key
        self.made: dict[tuple[str, int], Permutation] = {}

    def permute(self, tweak: str, size: int, value: int, back: bool) -> int:
        if len(self.made) > 4096:
            self.made.clear()
        p = self.made.get((tweak, size)) or self.made.setdefault((tweak, size), Permutation(self.key, tweak, size))
        return p.apply(value, back)

    def _digits(self, tweak: str, digits: str, back: bool) -> str:
        return str(self.permute(f"{tweak}{len(digits)}", 10 ** len(digits), int(digits), back)).zfill(len(digits)) if digits else ""

    def card(self, s: str, back: bool) -> str | None:
        digits = re.sub("[ -]", "", s)
        if luhn_digit(digits[:-1]) != digits[-1]:
            return None
        body = digits[0] + self._digits(f"card{digits[0]}/", digits[1:-1], back)
        return _refill(s, body + luhn_digit(body))

    def phone(self, s: str, back: bool) -> str | None:
        digits = re.sub("[^0-9]", "", s)
        if s.startswith("+") and not s.startswith("+1"):
            country = _country(digits)
            return _refill(s, country + self._digits(f"phone{country}/", digits[len(country) :], back))
        head, ten = digits[:-10], digits[-10:]
        value = ((int(ten[:3]) - 200) * 800 + int(ten[3:6]) - 200) * 10_000 + int(ten[6:])
        value = self.permute("phone", 800 * 800 * 10_000, value, back)
        return _refill(s, f"{head}{value // 8_000_000 + 200}{value // 10_000 % 800 + 200}{value % 10_000:04d}")

    def iban(self, s: str, back: bool) -> str | None:
        plain = s.replace(" ", "")
        number = lambda t: int("".join(str(int(c, 36)) for c in t))
        if number(plain[4:] + plain[:4]) % 97 != 1:
            return None
        body = self._characters(f"iban{plain[:2]}", plain[4:], back)
        check = 98 - number(body + plain[:2] + "00") % 97
        take = iter(f"{plain[:2]}{check:02d}{body}")
        return "".join(c if c == " " else next(take) for c in s)

    def ssn(self, s: str, back: bool) -> str | None:
        area, group, serial = map(int, s.split("-"))
        if not (0 < area < 900 and area != 666 and group and serial):
            return None
        areas = area - 1 - (area > 666)
        value = self.permute("ssn", 898 * 99 * 9999, (areas * 99 + group - 1) * 9999 + serial - 1, back)
        area = value // (99 * 9999) + 1
        return f"{area + (area >= 666):03d}-{value // 9999 % 99 + 1:02d}-{value % 9999 + 1:04d}"

    def ip(self, s: str, back: bool) -> str | None:
        parts = s.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        value = self.permute("ip", 1 << 32, int.from_bytes(bytes(map(int, parts)), "big"), back)
        return ".".join(map(str, value.to_bytes(4, "big")))

    def date(self, s: str, back: bool) -> str | None:
        order = (0, 1, 2) if s[4] == "-" else (2, 1, 0) if s[2] == "." else (2, 0, 1)
        parts = [int(p) for p in re.split("[-./]", s)]
        try:
            day = date(*(parts[i] for i in order)).toordinal() - _FIRST_DAY
        except ValueError:
            return None
        if day < 0:
            return None
        new = date.fromordinal(_FIRST_DAY + self.permute("date", _DAYS, day, back))
        values = (f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}")
        out = [""] * 3
        for i, v in zip(order, values):
            out[i] = v
        return ("-" if s[4] == "-" else s[2]).join(out)

    def _characters(self, tweak: str, s: str, back: bool) -> str:
        """Letters and digits permuted together within their classes; other characters stay."""
        value, size = 0, 1
        for c in s:
            if c in _ALPHABETS:
                a = _ALPHABETS[c]
                value, size = value * len(a) + a.index(c), size * len(a)
        shape = "".join(_ALPHABETS.get(c, c)[0] for c in s)
        value = self.permute(f"{tweak}/{shape}", size, value, back) if size > 1 else 0
        out = []
        for c in reversed(s):
            if c in _ALPHABETS:
                a = _ALPHABETS[c]
                value, at = divmod(value, len(a))
                c = a[at]
            out.append(c)
        return "".join(reversed(out))

    def email(self, s: str, back: bool) -> str | None:
        local, _, domain = s.rpartition("@")
        return f"{self._characters('email', local, back)}@{domain}"

    def replace(self, text: str | None, back: bool = False) -> tuple[str | None, Counter]:
        """The text with its data replaced, and how many of each kind; ``back`` undoes it."""
        found: Counter = Counter()
        out, done = [], 0
        for hint in _HINT.finditer(text or ""):
            for start, kinds in _starts(text, hint.start()):
                hit = next(((k, end, new) for k in kinds if start >= done and (end := _end(k, text, start)) and (new := getattr(self, k)(text[start:end], back)) is not None), None)
                if hit:
                    kind, end, new = hit
                    out += [text[done:start], new]
                    done = end
                    found[kind] += 1
                    break
        return ("".join([*out, text[done:]]) if out else text), found


def _country(digits: str) -> str:
    return digits[: 1 if digits[0] == "7" else 2 if digits[:2] in _TWO_DIGITS else 3]


def _end(kind: str, text: str, start: int) -> int | None:
    """Where data of a kind that begins at ``start`` ends.

    That rests on the shape and on what a pseudonym keeps, so it is found again in the new text.
    An IBAN has its country's length, whatever word follows; of a country without one it is the whole run.
    """
    pattern = _COMPILED[kind]
    if kind == "iban":
        pattern = _IBANS.get(_IBAN_LENGTHS.get(text[start : start + 2]), pattern)
    m = pattern.match(text, start)
    if not m:
        return None
    return start + _phone_length(m.group(), text, start) if kind == "phone" and text[start] == "+" and text[start + 1] != "1" else m.end()


def _phone_length(s: str, text: str, start: int) -> int:
    """The characters of an international number among digits that go on behind it.

    It ends at the first space behind a full number, behind a group of six digits or more that an area code
    goes before, or before a date, a time or data of another kind.
    """
    country = _country(re.sub("[^0-9]", "", s))
    count, before = -len(country), 0
    for i, c in enumerate(s):
        if c.isdigit():
            count += 1
            continue
        if c == " " and count >= 6 and (count >= _FULL.get(country, 99) or (before > 0 and count - before >= 6) or _begins(text, start + i + 1, count)):
            return i
        if s[i : i + 3 : 2] == "()":  # one digit in brackets is a trunk prefix
            count -= 1
        before = count
    return len(s)


def _begins(text: str, at: int, count: int) -> bool:
    """Whether other data begins here.  Four groups may also be the number's last one and three of a card's."""
    m = _BEGINS.match(text, at)
    return bool(m) and (count >= 8 or m.group().count(" ") < 3 or not _COMPILED["card"].match(text, at + 5))


def _starts(text: str, at: int) -> list[tuple[int, tuple[str, ...]]]:
    """Where data with this mail sign or first digit may begin, the longest first, and of what kinds."""
    if text[at] == "@":
        local = _LOCAL.search(text[max(0, at - 64) : at])
        return [(at - len(local.group().lstrip("._+-")), ("email",))] if local else []
    signs = [(at - 1, ("phone",))] if at and text[at - 1] in "+(" else []
    letters = [(at - 2, ("iban",))] if at > 1 and text[at - 2 : at].isupper() else []
    return [*letters, *signs, (at, _NUMBERS)]


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", back: bool = False) -> DataFrame:
    """Every row, in ``row``, with its new text and the number of replacements of each kind.

    Whole texts are read, there is no shuffle, and the key alone links equal values over documents,
    tasks and runs; ``back`` with the same key restores them.  A null text stays null, an empty one empty.
    Rows that repeat get the same answer; other columns pass through under any name.
    """

    def run(batches):
        own = Pseudonyms(key)
        for batch in short(batches):
            done = [own.replace(t, back) for t in batch.column(0).field(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([t for t, _ in done], pa.string()), *(pa.array([n[k] for _, n in done], pa.int32()) for k in KINDS)],
                ["row", "new_text", *(f"n_{k}" for k in KINDS)])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField("new_text", T.StringType()), *(T.StructField(f"n_{k}", T.IntegerType()) for k in KINDS)]))

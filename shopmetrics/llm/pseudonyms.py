"""Format-preserving pseudonyms for personal data, by a keyed Feistel permutation.

Numbers and dates are found by pattern, validated, and replaced by another valid value of the same
format: each kind counts its valid values 0 .. N-1, a Feistel network keyed by HMAC permutes the
number (walking the cycle until it falls below N), and the result is written with the original
separators.  The permutation depends on the key and the kind only, so equal values, however
written, get equal pseudonyms in all documents, different ones stay different, and ``restore`` with the same
key undoes it.

Kinds: payment cards (13 to 19 digits, Luhn; first digit kept), North American phones, IPv4 addresses,
social security numbers, IBANs (modulo 97; country kept), dates (year-month-day or day/month/year, month/day/year where only
that is valid; years 1900 to 2099; days up to the 12th and later ones are permuted among themselves, so a date reads as the
same day in every order it can be written in), and e-mail addresses, whose local part is permuted letter by letter and digit
by digit within its pattern while the domain stays.

Phones with an area code or exchange under 200 and addresses from 224.0.0.0 are classes of their own: valid values stay
valid, the others stay what they are.  Addresses under 1.0.0.0 (as version numbers look) are skipped.  A date may have a time after a T.

A candidate that fails its check may hold a value next to another number or word: cards are looked for between the
spaces and hyphens of a run of digits (``card_spans``), IBANs by their country's length, and the search goes on inside
the candidate.  A candidate inside a longer word or number is none.  Only where a pseudonym would make such a
neighbourhood read in another way does a value get another one there than elsewhere (``replace_parts``).  Texts
are processed whole, where they lie, with no shuffle.

Cases: a null text stays null; an empty one empty; repeated rows get the same answer; an empty table gives
an empty result.
"""

from __future__ import annotations

import bisect
import datetime
import functools
import hashlib
import hmac
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopmetrics.llm.common import append_columns

ROUNDS = 8
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

_FIND = re.compile(
    r"(?<![\w.%+-])(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24})(?![\w-])"
    r"|(?<![\w.])(?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?!\.?\w)"
    r"|(?<!\w)(?P<iban>[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)"
    r"|(?<![\w.+(/-])(?P<phone>(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4})(?![\w]|[-./]\d)"
    r"|(?<![\w./-])(?P<ssn>\d{3}-\d\d-\d{4})(?![\w]|[-./]\d)"
    r"|(?<![\w./-])(?P<date>\d{4}-\d\d?-\d\d?|\d{4}/\d\d?/\d\d?|\d\d?/\d\d?/\d{4}|\d\d?\.\d\d?\.\d{4}|\d\d?-\d\d?-\d{4})(?!(?![Tt]\d\d)\w|[-./]\d)"
    r"|(?<![\w.-])(?P<card>\d(?:[ -]?\d){12,18})(?![\w]|[-.]\d)")
KINDS = ["email", "ip", "iban", "phone", "ssn", "date", "card"]


class Feistel:
    """A keyed permutation of 0 .. n-1 for any n."""

    def __init__(self, key: bytes):
        self.key = hmac.new(key, b"pseudonyms", hashlib.sha256).digest()

    def _half(self, kind: bytes, n: int, k: int, x: int, bits: int) -> int:
        size = (bits + 7) // 8
        text = b"|".join([kind, str(n).encode(), str(k).encode(), str(x).encode()])
        out = b"".join(hashlib.blake2b(text + bytes([i]), key=self.key).digest() for i in range((size + 63) // 64))
        return int.from_bytes(out[:size], "big") & ((1 << bits) - 1)

    def _pass(self, kind: bytes, n: int, bits: int, x: int, rounds) -> int:
        low = (1 << bits) - 1
        a, b = x >> bits, x & low
        for k in rounds:
            a, b = b, a ^ self._half(kind, n, k, b, bits)
        return b << bits | a

    def permute(self, kind: str, n: int, x: int, back: bool = False) -> int:
        """The place of ``x`` after the permutation of kind ``kind``, or with ``back`` before it."""
        bits = max(1, ((n - 1).bit_length() + 1) // 2)
        rounds = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
        while True:
            x = self._pass(kind.encode(), n, bits, x, rounds)
            if x < n:
                return x


def fill(pattern: str, digits: str) -> str:
    """``pattern`` with its letters and digits replaced one by one."""
    it = iter(digits)
    return "".join(next(it) if c.isalnum() else c for c in pattern)


def luhn(body: str) -> str:
    """The check digit of a card number."""
    total = 0
    for k, c in enumerate(reversed(body)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def card(f, text, back):
    d = re.sub(r"\D", "", text)
    if luhn(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    n = 10 ** (len(d) - 2)
    body = d[0] + str(f.permute(f"card{len(d)}{d[0]}", n, int(d[1:-1]), back)).zfill(len(d) - 2)
    return fill(text, body + luhn(body))


def phone(f, text, back):
    d = re.sub(r"\D", "", text)
    country, area, exchange, line = d[:-10], int(d[-10:-7]), int(d[-7:-4]), int(d[-4:])
    if area >= 200 and exchange >= 200:
        x = f.permute("phone", 6_400_000_000, ((area - 200) * 800 + exchange - 200) * 10_000 + line, back)
        x, line = divmod(x, 10_000)
        area, exchange = x // 800 + 200, x % 800 + 200
    else:  # numbers no plan gives out: 200 areas with all exchanges, 800 with 200
        x = area * 1000 + exchange if area < 200 else 200_000 + (area - 200) * 200 + exchange
        x, line = divmod(f.permute("phone out of plan", 3_600_000_000, x * 10_000 + line, back), 10_000)
        area, exchange = divmod(x, 1000) if x < 200_000 else (x // 200 - 800, x % 200)
    return fill(text, f"{country}{area:03d}{exchange:03d}{line:04d}")


def ip(f, text, back):
    d = [int(x) for x in text.split(".")]
    if not d[0] or max(d) > 255:
        return None
    # Hosts have 1 to 223 first; the others are permuted among themselves.
    kind, least, n = ("ip", 1, 223) if d[0] <= 223 else ("ip out of plan", 224, 32)
    x = f.permute(kind, n << 24, (d[0] - least) << 24 | d[1] << 16 | d[2] << 8 | d[3], back)
    return f"{(x >> 24) + least}.{x >> 16 & 255}.{x >> 8 & 255}.{x & 255}"


def ssn(f, text, back):
    a, g, s = (int(x) for x in text.split("-"))
    if not 1 <= a <= 899 or a == 666 or not g or not s:
        return None
    a -= 1 + (a > 666)
    x = f.permute("ssn", 898 * 99 * 9999, (a * 99 + g - 1) * 9999 + s - 1, back)
    x, s = divmod(x, 9999)
    a, g = divmod(x, 99)
    return f"{a + 1 + (a >= 665):03d}-{g + 1:02d}-{s + 1:04d}"


def in_pattern(f, kind: str, text: str, back: bool) -> str:
    """Letters and digits of a text permuted together, each within its own class."""
    classes = [("0", 10) if c.isdigit() else ("a", 26) if c.islower() else ("A", 26) for c in text]
    n, x = 1, 0
    for c, (zero, base) in zip(text, classes):
        n, x = n * base, x * base + ord(c) - ord(zero)
    x, out = f.permute(kind + "".join(z for z, _ in classes), n, x, back), []
    for zero, base in reversed(classes):
        x, d = divmod(x, base)
        out.append(chr(ord(zero) + d))
    return "".join(reversed(out))


def iban_check(country: str, body: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


def iban(f, text, back):
    plain = text.replace(" ", "")
    country, body = plain[:2], plain[4:]
    if not 15 <= len(plain) <= 34 or iban_check(country, body) != plain[2:4]:
        return None
    body = in_pattern(f, "iban" + country, body, back)
    return fill(text, country + iban_check(country, body) + body)


@functools.cache
def late_days() -> list[int]:
    """The days after the 12th of their month, in order."""
    return [k for k in range(FIRST_DAY, LAST_DAY + 1) if datetime.date.fromordinal(k).day > 12]


def permute_day(f, day: datetime.date, back: bool) -> datetime.date:
    """Days up to the 12th, which can be read with the month first as well, and later days are two classes, each closed."""
    if day.day > 12:
        late = late_days()
        return datetime.date.fromordinal(late[f.permute("late date", len(late), bisect.bisect_left(late, day.toordinal()), back)])
    first, years = datetime.date.fromordinal(FIRST_DAY).year, datetime.date.fromordinal(LAST_DAY).year + 1
    x = f.permute("early date", (years - first) * 144, (day.year - first) * 144 + (day.month - 1) * 12 + day.day - 1, back)
    return datetime.date(first + x // 144, x // 12 % 12 + 1, x % 12 + 1)


def date(f, text, back):
    sep = re.search(r"\D", text)[0]
    parts = text.split(sep)
    orders = [(0, 1, 2)] if len(parts[0]) == 4 else [(2, 1, 0), (2, 0, 1)]
    for order in orders:
        try:
            day = datetime.date(*(int(parts[k]) for k in order))
        except ValueError:
            continue
        if not FIRST_DAY <= day.toordinal() <= LAST_DAY:
            return None
        new = permute_day(f, day, back)
        wide = all(len(p) >= 2 for p in parts)
        out = [""] * 3
        for k, v in zip(order, (new.year, new.month, new.day)):
            out[k] = f"{v:04d}" if k == order[0] else f"{v:02d}" if wide else str(v)
        return sep.join(out)
    return None


def email(f, text, back):
    local, domain = text.rsplit("@", 1)
    letters = re.sub(r"[^A-Za-z0-9]", "", local)
    return fill(local, in_pattern(f, "email", letters, back)) + "@" + domain


MAKERS = {"email": email, "ip": ip, "iban": iban, "phone": phone, "ssn": ssn, "date": date, "card": card}
_HINT = re.compile(r"[0-9@]")


def card_spans(run: str) -> list[tuple[int, int]]:
    """The cards, by their check digit, in a run of digits, single spaces and hyphens: first a group of 13 to 19 digits
    alone and the printed ways 4-4-4-4, 4-6-5 and 4-6-4, then the whole run (its first 19 digits at most), then
    other rows of groups of four digits or more, the last of any size; of overlapping ones of a rank the longer."""
    groups = [(m.start(), m.end()) for m in re.finditer(r"\d+", run)]
    found = []
    for i in range(len(groups)):
        sizes, total = [], 0
        for j in range(i, len(groups)):
            sizes.append(groups[j][1] - groups[j][0])
            total += sizes[-1]
            if total > 19:
                break
            if total < 13:
                continue
            printed = len(sizes) == 1 or sizes in ([4, 4, 4, 4], [4, 6, 5], [4, 6, 4])
            whole = i == 0 and (j + 1 == len(groups) or total + groups[j + 1][1] - groups[j + 1][0] > 19)
            if not printed and not whole and min(sizes[:-1]) < 4:
                continue
            a, b = groups[i][0], groups[j][1]
            d = re.sub(r"\D", "", run[a:b])
            if luhn(d[:-1]) == d[-1] and len(set(d)) > 1:
                found.append((0 if printed else 1 if whole else 2, -total, a, b))
    out = []
    for *_, a, b in sorted(found):
        if all(b <= c or d <= a for c, d in out):
            out.append((a, b))
    return sorted(out)


#: Characters of an IBAN, by country.
IBAN_SIZE = {c: int(n) for n, x in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for c in x.split()}


def iban_spans(run: str) -> list[tuple[int, int]]:
    """The part of a candidate that passes the check: of the country's length, else the longest up to a space."""
    ends = [m.start() for m in re.finditer(r"(?= )|$", run)][::-1]
    size = IBAN_SIZE.get(run[:2])
    for b in sorted(ends, key=lambda b: len(run[:b].replace(" ", "")) != size):
        plain = run[:b].replace(" ", "")
        if 15 <= len(plain) <= 34 and iban_check(plain[:2], plain[4:]) == plain[2:4]:
            return [(0, b)]
    return []


SPANS = {"card": card_spans, "iban": iban_spans}
_RUN = re.compile(r"\d+(?:[ -]\d+)*")
_ENDS_BADLY = re.compile(r"\w|[-.]\d")
_WORD = re.compile(r"\w+|.", re.S)


def replace_parts(kind: str, run: str, f: Feistel, back: bool) -> list[tuple[int, int, str]]:
    """(start, end, new text) of the values in a run.  If the new run would be read in another way, as a longer
    value that passes by chance, all values go on along their cycles until it isn't, so the way back is the same."""
    spans, new = SPANS[kind](run), run
    while spans:
        new = "".join(x for (a, b), (c, _) in zip(spans, [*spans[1:], (len(run), 0)]) for x in (MAKERS[kind](f, new[a:b], back), run[b:c]))
        new = run[: spans[0][0]] + new
        if SPANS[kind](new) == spans:
            break
    return [(a, b, new[a:b]) for a, b in spans]


def values(text: str, f: Feistel, known: dict, back: bool):
    """(kind, start, end, new text) of the values of a text, in order.  After a candidate that fails its check the
    search goes on behind its first word."""
    at, waiting, cards_done = 0, [], 0

    def made(key, make):
        if key not in known:
            if len(known) > 100_000:
                known.clear()
            known[key] = make()
        return known[key]

    while True:
        m = _FIND.search(text, at)
        if m and m.lastgroup == "card" and m.start() < cards_done and not (waiting and waiting[0][1] <= m.start()):
            at = m.start() + len(_WORD.match(m[0])[0])
            continue
        if waiting and (m is None or m.end() > waiting[0][1]):
            yield waiting[0]
            at = waiting.pop(0)[2]
            continue
        if m is None:
            return
        kind, value, start = m.lastgroup, m[0], m.start()
        if kind == "card":
            value = _RUN.match(text, start)[0]
            if _ENDS_BADLY.match(text, start + len(value)):  # the last group belongs to another word
                value = value[: max(value.rfind(" "), value.rfind("-"))]
            cards_done = start + len(value)
        if kind in SPANS:
            parts = made((kind, value), lambda: replace_parts(kind, value, f, back))
            waiting += [(kind, start + a, start + b, new) for a, b, new in parts]
            if parts:
                continue
        else:
            new = made((kind, value), lambda: MAKERS[kind](f, value, back))
            if new is not None:
                yield kind, start, m.end(), new
                at = m.end()
                continue
        at = start + len(_WORD.match(value)[0])


def replace(text: str, f: Feistel, known: dict | None = None, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of each of them in the new text."""
    if not _HINT.search(text):
        return text, []
    known = {} if known is None else known
    out, found, at, shift = [], [], 0, 0
    for kind, start, end, new in values(text, f, known, back):
        out += [text[at: start], new]
        found.append((kind, start + shift, start + shift + len(new)))
        shift += len(new) - (end - start)
        at = end
    return "".join([*out, text[at:]]), found


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", back: bool = False, prefix: str = "") -> DataFrame:
    """``docs`` with ``new_text`` and ``pseudonyms`` (kind, start and end in characters) appended (names after
    ``prefix``); ``back`` restores the values of a text that was pseudonymised with the same key."""
    where = docs.columns.index(text_col)

    def of_task():
        f, known = Feistel(key), {}

        def of_batch(batch):
            texts, spans = [], []
            for x in batch.column(where).cast(pa.large_string()):
                t, s = (None, []) if not x.is_valid else replace(x.as_py(), f, known, back)
                texts.append(t)
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in s])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            return [pa.array(texts, pa.string()), pa.array(spans, kind)]

        return of_batch

    return append_columns(docs, [T.StructField(prefix + "new_text", T.StringType()), T.StructField(prefix + "pseudonyms", SPAN)], of_task)


def counts(spans: str = "pseudonyms") -> list:
    """A column with the number of pseudonyms of each kind."""
    def count(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return [count(k) for k in KINDS]

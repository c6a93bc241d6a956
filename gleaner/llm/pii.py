"""Format-preserving pseudonyms: validated numbers and dates, permuted under a key within their own format.

A value is a number in a domain: the digits of a card without its check digit, the hosts of an address, the days of
a calendar. A Feistel network over HMAC permutes the domain, cycle walking until the result is in it and valid, so
every valid value becomes another valid one of the same look, different values stay different, and equal values stay
equal in all documents. Whoever has the key can turn it round. Letters and digits of mail names are permuted
likewise, each for its kind.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gleaner.llm.tokens import batched, texts_of

ROUNDS = 8


def permute(value: int, size: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """A keyed permutation of range(size): a Feistel network on two halves of bits, walked until inside."""
    if not 0 <= value < size:
        raise ValueError("value outside its domain")
    if size == 1:
        return 0
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    order = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)

    def turn(r: int, x: int) -> int:
        message = tweak + b"|%d|%d|" % (size, r) + x.to_bytes(width, "big")
        return int.from_bytes(hmac.digest(key, message, hashlib.sha256)[:width + 8], "big") & mask

    while True:
        left, right = value >> half, value & mask
        for r in order:
            if back:
                left, right = right ^ turn(r, left), left
            else:
                left, right = right, left ^ turn(r, right)
        value = left << half | right
        if value < size:
            return value


def luhn(digits: str) -> int:
    """The check digit that follows these digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _filled(pattern: str, digits: str) -> str:
    """Digits put in the places of digits."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in pattern)


def _digits(found: str) -> str:
    return "".join(c for c in found if c.isdigit())


@dataclass(frozen=True)
class Kind:
    """A form of personal data: where it may be, and its pseudonym (none: not valid, left alone)."""

    name: str
    pattern: str
    replace: Callable[[str, bytes, bool], str | None]
    #: Whether what follows may look like more of it: if the longest is not valid, each shorter one is tried.
    shorter: bool = False


def _card(found: str, key: bytes, back: bool) -> str | None:
    d = _digits(found)
    if not 13 <= len(d) <= 19 or luhn(d[:-1]) != int(d[-1]):
        return None
    # The issuer's first digit stays; so many digits of the account are a domain of their own.
    body = permute(int(d[1:-1]), 10 ** (len(d) - 2), key, b"card" + d[0].encode(), back)
    new = d[0] + str(body).zfill(len(d) - 2)
    return _filled(found, new + str(luhn(new)))


def _number(name: str, fixed: int) -> Callable[[str, bytes, bool], str | None]:
    """Digits after the first `fixed`, permuted; those stay."""

    def replace(found: str, key: bytes, back: bool) -> str | None:
        d = _digits(found)
        rest = d[fixed:]
        new = permute(int(rest), 10 ** len(rest), key, name.encode() + d[:fixed].encode(), back)
        return _filled(found, d[:fixed] + str(new).zfill(len(rest)))

    return replace


def _account(found: str, key: bytes, back: bool) -> str | None:
    """IBAN: the country stays, what follows is permuted place by place in its alphabet, the check is made anew."""
    text = found.replace(" ", "")
    if not 15 <= len(text) <= 34 or _mod97(text[4:] + text[:4]) != 1:
        return None
    body = text[4:]
    size, value = 1, 0
    for c in body:
        base = 10 if c.isdigit() else 26
        value = value * base + (int(c) if c.isdigit() else ord(c) - 65)
        size *= base
    shape = "".join("9" if c.isdigit() else "A" for c in body).encode()
    value = permute(value, size, key, b"iban" + text[:2].encode() + shape, back)
    out = []
    for c in reversed(body):
        value, r = divmod(value, 10 if c.isdigit() else 26)
        out.append(str(r) if c.isdigit() else chr(65 + r))
    body = "".join(reversed(out))
    check = 98 - _mod97(body + text[:2] + "00")
    new = iter(f"{text[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(new) for c in found)


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _national(found: str, key: bytes, back: bool) -> str | None:
    """US social security number: areas 1 to 899 but 666, groups 1 to 99, serials 1 to 9999."""
    d = _digits(found)
    area, group, serial = int(d[:3]), int(d[3:5]), int(d[5:])
    if not area or area == 666 or area > 899 or not group or not serial:
        return None
    areas = 898
    at = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    at, serial = divmod(permute(at, areas * 99 * 9999, key, b"national", back), 9999)
    area, group = divmod(at, 99)
    return _filled(found, f"{area + 1 + (area >= 665):03d}{group + 1:02d}{serial + 1:04d}")


def _address(found: str, key: bytes, back: bool) -> str | None:
    """IPv4: a valid address becomes another one of as many digits in each part, so that its look is the same."""
    parts = found.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    low = {1: (0, 10), 2: (10, 90), 3: (100, 156)}
    value, size = 0, 1
    for p in parts:
        first, n = low[len(p)]
        value, size = value * n + int(p) - first, size * n
    value = permute(value, size, key, b"address" + "".join(str(len(p)) for p in parts).encode(), back)
    out = []
    for p in reversed(parts):
        first, n = low[len(p)]
        value, r = divmod(value, n)
        out.append(str(first + r))
    return ".".join(reversed(out))


FIRST_DAY, DAYS = datetime.date(1900, 1, 1), (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days


def _day(parts: list[str], order: str) -> int | None:
    try:
        day = datetime.date(*(int(parts[order.index(c)]) for c in "ymd"))
    except ValueError:
        return None
    at = (day - FIRST_DAY).days
    return at if 0 <= at < DAYS else None


def _date(*orders: str) -> Callable[[str, bytes, bool], str | None]:
    """A day of 1900 to 2099 becomes another one; the first of `orders` of y, m, d that is a day is how it is read.

    A day is one pseudonym in all forms, walked on where the text would not be read or look the same: one read in a
    later order stays so, and beside a part of one digit each part stays under 10 or from 10 up.
    """

    def read(parts: list[str]) -> tuple[str | None, int | None]:
        return next(((o, at) for o in orders if (at := _day(parts, o)) is not None), (None, None))

    def replace(found: str, key: bytes, back: bool) -> str | None:
        parts = re.findall(r"\d+", found)
        order, at = read(parts)
        if at is None:
            return None
        loose = any(len(p) == 1 for p in parts)
        while True:
            at = permute(at, DAYS, key, b"date", back)
            day = FIRST_DAY + datetime.timedelta(at)
            of = {"y": day.year, "m": day.month, "d": day.day}
            new = [str(of[c]).zfill(len(p)) for c, p in zip(order, parts)]
            if read(new)[0] == order and not (loose and any((int(x) < 10) != (int(p) < 10) for x, p in zip(new, parts))):
                return _filled(found, "".join(new))

    return replace


def _mail(found: str, key: bytes, back: bool) -> str | None:
    """The name before the @: each letter and digit stays one, all of them together are permuted. The host stays,
    and so do other characters."""
    name, host = found.split("@")
    kinds = {"a": "abcdefghijklmnopqrstuvwxyz", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "9": "0123456789"}
    of = [next((k for k, v in kinds.items() if c in v), None) for c in name]
    if not any(of):
        return None
    value, size = 0, 1
    for c, k in zip(name, of):
        if k:
            value, size = value * len(kinds[k]) + kinds[k].index(c), size * len(kinds[k])
    value = permute(value, size, key, b"mail" + "".join(k or "-" for k in of).encode() + host.lower().encode(), back)
    out = []
    for c, k in zip(reversed(name), reversed(of)):
        if k:
            value, r = divmod(value, len(kinds[k]))
            out.append(kinds[k][r])
        else:
            out.append(c)
    return "".join(reversed(out)) + "@" + host


#: In the order in which they are tried at a place. Every pattern holds a digit or an @.
KINDS = (
    Kind("mail", r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.)+[A-Za-z]{2,24}", _mail),
    Kind("iban", r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", _account, True),
    Kind("date", r"(?:19|20)\d\d-\d\d?-\d\d?(?!\d)", _date("ymd")),
    Kind("date", r"(?:19|20)\d\d/\d\d?/\d\d?(?!\d)", _date("ymd")),
    Kind("date", r"\d\d?\.\d\d?\.(?:19|20)\d\d(?!\d)", _date("dmy")),
    Kind("date", r"\d\d?/\d\d?/(?:19|20)\d\d(?!\d)", _date("mdy", "dmy")),
    Kind("date", r"\d\d?-\d\d?-(?:19|20)\d\d(?!\d)", _date("dmy", "mdy")),
    Kind("address", r"\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)", _address),
    Kind("national", r"\d{3}-\d{2}-\d{4}(?![-\d])", _national),
    Kind("card", r"\d(?:[ -]?\d){12,18}", _card, True),
    Kind("phone", r"\+1 ?\(\d{3}\) ?\d{3}[ -.]?\d{4}(?!\d)", _number("phone", 1)),
    Kind("phone", r"\+\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){2,5}(?!\d)", _number("phone", 1)),
    Kind("phone", r"\(\d{3}\) ?\d{3}[ -.]\d{4}(?!\d)", _number("phone", 0)),
    Kind("phone", r"\d{3}[-.]\d{3}[-.]\d{4}(?!\d)", _number("phone", 0)),
)
_TRIED = re.compile(r"(?<![\w.+@-])(?:%s)(?!\w)" % "|".join(f"(?P<k{i}>{k.pattern})" for i, k in enumerate(KINDS)))
# No value is without a digit or an @, so texts without either are not searched.
_HINT = re.compile(r"[\d@]")


_ALONE = [re.compile(r"(?<![\w.+@-])(?:%s)(?!\w)" % k.pattern) for k in KINDS]
_WORD = re.compile(r"\w")

#: Index of a kind, start, end.
Spot = tuple[int, int, int]


def _at(i: int, text: str, start: int, key: bytes, back: bool) -> tuple[str, Spot] | None:
    """The longest valid value of a kind that begins at a place."""
    kind, m = KINDS[i], _ALONE[i].match(text, start)
    while m:
        if new := kind.replace(m[0], key, back):
            return new, (i, start, m.end())
        ends = range(m.end() - 1, start, -1) if kind.shorter else ()
        m = next((x for e in ends if not _WORD.match(text, e) and (x := _ALONE[i].fullmatch(text, start, e))), None)
    return None


def _found(text: str, at: int, key: bytes, back: bool) -> Iterator[tuple[str, Spot]]:
    """Pseudonyms and where they go, of all values from a place on."""
    while m := _TRIED.search(text, at):
        first = int(m.lastgroup[1:])
        # Another kind may begin here or within.
        got = next((x for i in (first, *(i for i in range(len(KINDS)) if i != first)) if (x := _at(i, text, m.start(), key, back))), None)
        if got is None:
            at = m.start() + 1
            while at < len(text) and (text[at].isalnum() or text[at] in "._%+-@"):
                at += 1
            continue
        yield got
        at = got[1][2]


# Code points before and after a value that can decide where it is found: more than two values but for host names.
AROUND = 200


def replaced(text: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and for each its kind and stretch in code points; lengths do not change.

    A pseudonym and the digits beside it may look like a longer value by chance. It is then walked on, until values
    are found where they were. From the last to the first, and back from the first to the last: so each is tried
    beside the same text both ways, in which what it was is found too, and the way back ends there.
    """
    if not _HINT.search(text):
        return text, []
    spots = [spot for _, spot in _found(text, 0, key, back)]
    now, n = list(text), len(spots)
    for j in range(n) if back else range(n - 1, -1, -1):
        i, a, b = spots[j]
        first = j
        while first and spots[first - 1][2] > a - AROUND:
            first -= 1
        # The search goes on from the value before, whose last character keeps its class.
        begin = spots[first - 1][2] if first else 0
        cut, want = max(0, begin - 1), spots[first : j + 1]
        value = text[a:b]
        while True:
            value = KINDS[i].replace(value, key, back)
            now[a:b] = value
            near = _found("".join(now[cut : b + AROUND]), begin - cut, key, back)
            if [(k, x + cut, y + cut) for _, (k, x, y) in islice(near, len(want))] == want:
                break
    return "".join(now), [(KINDS[i].name, a, b) for i, a, b in spots]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def pseudonymised(docs: DataFrame, text: str, key: bytes, spans: str | None = "spans", back: bool = False) -> DataFrame:
    """Replace the text by one with pseudonyms, and add where they are: kind, start, end.

    Null texts stay null and empty ones empty, with no spans; `back` turns pseudonyms into what they were. Rows are
    taken alone: no table of values is kept or shuffled, equal values meet because the permutation is keyed. All
    other columns are kept; the new name must be free.
    """
    if spans in docs.columns:
        raise ValueError(f"column exists already: {spans}")
    at = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batched(batches):
            column = b.column(at)
            got = [replaced(t, key, back) for t in texts_of(column)]
            new = pa.array([None if null else t for (t, _), null in zip(got, column.is_null().to_pylist())], column.type)
            cols = [new if i == at else c for i, c in enumerate(b.columns)]
            names = list(b.schema.names)
            if spans:
                cols.append(pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for _, x in got], _ARROW))
                names.append(spans)
            yield pa.RecordBatch.from_arrays(cols, names)

    more = [T.StructField(spans, SPANS)] if spans else []
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *more]))

"""Keyed pseudonyms that keep the format of a value: numbers, identity numbers with check characters, telephone numbers, dates.

`feistel` permutes the digits and capitals of a value among all values of its format. Around it each kind keeps what makes the
value readable as one of its kind: a country code and trunk prefix, the distance of a check character from the right one
(so valid numbers stay valid, and others stay invalid), a date's order and signs. Every map is one to one on the values of a kind, so
equal values get equal pseudonyms however they are written, and different values different ones.
"""

from __future__ import annotations

import hmac
import re
from datetime import date, timedelta
from hashlib import blake2b

_S = r"[ \t\xa0]"
_DIGITS, _CAPITALS = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Check letters of the Spanish identity number by remainder (fixed values).
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
#: Country calling codes of two digits (fixed values); 1 and 7 have one, all others three.
_TWO = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Month names (fixed values) in English, Spanish, French and German.
MONTHS = [
    "january february march april may june july august september october november december",
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "januar februar märz april mai juni juli august september oktober november dezember",
]
_MONTH = {m: (i + 1, names) for names in map(str.split, MONTHS) for i, m in enumerate(names)} | {m[:3]: (i + 1, [n[:3] for n in MONTHS[0].split()]) for i, m in enumerate(MONTHS[0].split()) if m != "may"}
_MONTH_WORD = "|".join(sorted(map(re.escape, _MONTH), key=len, reverse=True))
_DE = rf"(?:{_S}+(?:de|del|of))?"
DATE = re.compile(
    rf"(?<![\w./\-])(?:(?P<d>\d{{1,2}})(?P<s>[./\-])(?P<m>\d{{1,2}})(?P=s)(?P<y>\d{{4}})|(?P<y2>\d{{4}})(?P<s2>[./\-])(?P<m2>\d{{1,2}})(?P=s2)(?P<d2>\d{{1,2}})"
    rf"|(?P<d3>\d{{1,2}})(?:st|nd|rd|th|er|\.)?{_DE}{_S}+(?P<m3>{_MONTH_WORD})\.?{_DE},?{_S}+(?P<y3>\d{{4}})|(?P<m4>{_MONTH_WORD})\.?{_S}+(?P<d4>\d{{1,2}})(?:st|nd|rd|th)?,?{_S}+(?P<y4>\d{{4}}))(?![\w/\-]|\.\d)",
    re.I,
)
_FIRST, _DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days


def _hash(key: bytes, tweak: bytes, i: int, half: int, modulus: int) -> int:
    return int.from_bytes(blake2b(tweak + bytes([i]) + half.to_bytes(32, "big"), key=key, digest_size=32).digest(), "big") % modulus


def permuted(number: int, left: int, right: int, key: bytes, tweak: bytes, back: bool = False, rounds: int = 10) -> int:
    """Keyed permutation of the numbers below left * right: each round adds a keyed hash of one part to the other."""
    parts, sizes = [number // right, number % right], (left, right)
    for i in reversed(range(rounds)) if back else range(rounds):
        a, b = i % 2, 1 - i % 2
        change = _hash(key, tweak, i, parts[b], sizes[a])
        parts[a] = (parts[a] + (-change if back else change)) % sizes[a]
    return parts[0] * right + parts[1]


def feistel(value: str, key: bytes, back: bool = False, tweak: bytes = b"") -> str:
    """Keyed permutation of the ASCII digits and capitals of a value among all values of its format; other characters stay.

    The characters that vary are one mixed-radix number, of two parts of about half its places. One varying character is
    shifted by a hash of the format. back=True inverts.
    """
    places = [(i, _DIGITS if c in _DIGITS else _CAPITALS) for i, c in enumerate(value) if c in _DIGITS or c in _CAPITALS]
    if not places:
        return value
    number, left, right = 0, 1, 1
    for n, (i, signs) in enumerate(places):
        number = number * len(signs) + signs.index(value[i])
        if n < len(places) // 2:
            left *= len(signs)
        else:
            right *= len(signs)
    format_ = "".join("d" if s is _DIGITS else "u" for _, s in places).encode() + b"\0" + tweak
    number = permuted(number, left, right, key, format_, back)
    out = list(value)
    for i, signs in reversed(places):
        number, digit = divmod(number, len(signs))
        out[i] = signs[digit]
    return "".join(out)


# --- check characters ---------------------------------------------------------
def luhn(digits: str) -> bool:
    """Whether the last digit is the right check digit of the others."""
    return luhn_digit(digits[:-1]) == int(digits[-1])


def luhn_digit(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return -total % 10


def _as_number(value: str) -> int:
    return int("".join(str(int(c, 36)) for c in value))


def iban_valid(value: str) -> bool:
    return _as_number(value[4:] + value[:4]) % 97 == 1


#: Formats with check characters: pattern of (country,) body and check, and the right check of a body as a number below a modulus.
_DNI = re.compile(r"([XYZ]?)(\d{7,8})([A-Z])")
_NIR = re.compile(r"([0124])(\d\d)(\d\d)(\d[\dAB])(\d{3})(\d{3})(\d\d)")
_CARD = re.compile(r"\d{13,19}")
_IBAN = re.compile(r"([A-Z]{2})(\d\d)([A-Z0-9]{11,30})")


def identity(plain: str, key: bytes) -> str:
    """The pseudonym of an identity number of digits and capitals, character by character of the same kind."""
    m = _DNI.fullmatch(plain)
    if m:
        right = lambda body: int({"X": "0", "Y": "1", "Z": "2"}.get(m[1], "") + body) % 23
        body = feistel(m[2], key, tweak=b"dni" + m[1].encode())
        if m[3] in DNI_LETTERS:
            apart = DNI_LETTERS.index(m[3]) - right(m[2])
            return m[1] + body + DNI_LETTERS[(right(body) + apart) % 23]
        return m[1] + body + m[3]
    m = _NIR.fullmatch(plain)
    if m:
        digits = lambda v: int(v.replace("A", "0").replace("B", "0"))
        check = lambda v: -digits(v) % 97  # noqa: E731  0 is written 97
        body = "".join(m.groups()[:6])
        rest = feistel(body[1:], key, tweak=b"nir") if body[1:].isdigit() else body[1:5] + feistel(body[5:], key, tweak=b"nir" + body[1:5].encode())
        new = body[0] + rest
        apart = (int(m[7]) - check(body)) % 97
        return new + f"{(check(new) + apart) % 97 or 97:02d}" if 1 <= int(m[7]) <= 97 else new + m[7]
    if _CARD.fullmatch(plain):
        keep = 1 if plain[0] in "3456" else 0  # the network's first digit
        body = plain[:keep] + feistel(plain[keep:-1], key, tweak=b"card" + plain[:keep].encode())
        apart = int(plain[-1]) - luhn_digit(plain[:-1])
        return body + str((luhn_digit(body) + apart) % 10)
    m = _IBAN.fullmatch(plain)
    if m:
        right = lambda body: 98 - _as_number(body + m[1] + "00") % 97
        body = feistel(m[3], key, tweak=b"iban" + m[1].encode())
        apart = int(m[2]) - right(m[3])
        return m[1] + (f"{(right(body) + apart - 2) % 97 + 2:02d}" if 2 <= int(m[2]) <= 98 else m[2]) + body
    return feistel(plain, key)


# --- telephone numbers --------------------------------------------------------
_EXT = re.compile(rf"{_S}?(?:ext\.?|x|Durchwahl|poste){_S}?(?=\d{{1,5}}\b)", re.I)


def phone(value: str, key: bytes) -> str:
    """A telephone number with its national digits permuted; signs, country code, trunk zeros stay where they are.

    The same number with and without `(0)`, with `00` or `+`, and with or without the leading 1 of North America has the same
    national digits; an extension is permuted apart, depending on the number.
    """
    parts = _EXT.split(value, maxsplit=1)
    main = parts[0]
    digits = [i for i, c in enumerate(main) if c in _DIGITS]
    number = "".join(main[i] for i in digits)
    skip, country = 0, ""
    if "+" in main or re.match(r"\D*00[1-9]", main):
        skip = 0 if "+" in main else 2
        country = _country(number[skip:])
        skip += len(country)
        if main[digits[skip] - 1 : digits[skip] + 2] == "(0)" if skip < len(digits) else False:
            skip += 1
    elif len(number) == 11 and number[0] == "1":
        skip, country = 1, "1"
    elif len(number) == 10 and number[0] != "0" and re.search(r"\d{3}\)?\D{0,3}\d{3}\D{0,3}\d{4}$", main):
        country = "1"
    elif number.startswith("0"):
        skip = 1
    national = number[skip:]
    new = number[:skip] + feistel(national, key, tweak=f"phone {country}".encode())
    out = list(main)
    for i, c in zip(digits, new, strict=True):
        out[i] = c
    if len(parts) == 2:
        sign = value[len(main) : len(value) - len(parts[1])]
        return "".join(out) + sign + feistel(parts[1], key, tweak=f"extension {country} {national}".encode())
    return "".join(out)


def _country(digits: str) -> str:
    return digits[: 1 if digits[:1] in ("1", "7") else 2 if digits[:2] in _TWO else 3]


# --- dates --------------------------------------------------------------------
def date_parts(m: re.Match) -> tuple[date, str, list | None] | None:
    """Day, way of writing (dmy, mdy, ymd, and the month's names) of a match of DATE; None if there is no such day.

    Two numbers that could be either are taken as day and month.
    """
    g = m.groupdict()
    names = None
    if g["y"]:
        a, b, y, way = int(g["d"]), int(g["m"]), int(g["y"]), "dmy"
        d, month = a, b
        if b > 12:
            d, month, way = b, a, "mdy"
    elif g["y2"]:
        y, month, d, way = int(g["y2"]), int(g["m2"]), int(g["d2"]), "ymd"
    else:
        word = (g["m3"] or g["m4"]).lower()
        month, names = _MONTH[word]
        d, y, way = int(g["d3"] or g["d4"]), int(g["y3"] or g["y4"]), "dmy" if g["d3"] else "mdy"
    try:
        day = date(y, month, d)
    except ValueError:
        return None
    return (day, way, names) if 0 <= (day - _FIRST).days < _DAYS else None


def moved(day: date, key: bytes, back: bool = False) -> date:
    """Another day between 1900 and 2099, by a keyed permutation of them all; steps of the cipher over 270 x 271 are repeated until one falls among them."""
    n = (day - _FIRST).days
    while True:
        n = permuted(n, 270, 271, key, b"date", back)
        if n < _DAYS:
            return _FIRST + timedelta(days=n)


def date_like(value: str, key: bytes) -> str:
    """A date written as the value is, of another day."""
    m = DATE.fullmatch(value)
    parts = date_parts(m) if m else None
    if parts is None:
        return feistel(value, key, tweak=b"date")
    day, way, names = parts
    new = moved(day, key)
    g = {k: v for k, v in m.groupdict().items() if v is not None and not k.startswith("s")}
    out = list(value)
    of = {"y": new.year, "m": new.month, "d": new.day}
    for k, text in sorted(g.items(), key=lambda x: -m.start(x[0])):
        field = k[0]
        if way == "mdy" and not names and field in "md":
            field = "d" if field == "m" else "m"
        if names and field == "m":
            word = names[new.month - 1]
            shown = word.upper() if text.isupper() else word.capitalize() if text[0].isupper() else word
        else:
            shown = str(of[field]).zfill(len(text) if text.startswith("0") or len(text) == 4 else 1 if names else len(text))
        out[m.start(k) : m.end(k)] = shown
    return "".join(out)


# --- all kinds ------------------------------------------------------------------
def canonical(value: str, kind: str) -> str:
    """A value without the signs it may be written with."""
    if kind == "identity":
        return re.sub(r"[^0-9A-Z]", "", value.upper())
    if kind == "email":
        v = re.sub(rf"{_S}*[\[(]{_S}*at{_S}*[\])]{_S}*|{_S}+at{_S}+|{_S}*[@＠﹫]{_S}*", "@", value, flags=re.I)
        return re.sub(rf"{_S}*[\[(]{_S}*dot{_S}*[\])]{_S}*|{_S}+dot{_S}+|[．。]", ".", v, flags=re.I).lower()
    if kind == "name" and "," in value:
        family, _, first = value.partition(",")
        value = f"{first} {family}"
    return " ".join(value.lower().split())


def pseudonym(value: str, kind: str, key: bytes) -> str:
    """The typed placeholder of a value."""
    if kind == "identity":  # the permuted characters, between the signs of this value
        new = iter(identity(canonical(value, kind), key))
        shown = "".join(next(new, "") if c.isascii() and c.isalnum() else c for c in value)
    elif kind == "phone":
        shown = phone(value, key)
    elif kind == "date":
        shown = date_like(value, key)
    else:
        shown = hmac.new(key, f"{kind}:{canonical(value, kind)}".encode(), "sha256").hexdigest()[:16]
    return f"<{kind}:{shown}>"

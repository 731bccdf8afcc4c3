"""Personal information inside free text: found, told apart by kind, and replaced by typed, linked pseudonyms.

E-mail addresses, phone numbers, identity numbers and street addresses are told by their formats, with the usual signs or words and
unusual characters in their place; payment cards and account numbers by their check digits, too; names by what stands around them
(`personal_names`); dates of birth (or, if asked for, all dates) by their label. What lies inside another value is no value
of its own.

A text is searched as a whole, but each pattern only starts where it can: one pass of an automaton finds the words and signs that
a value needs, one of digits the numbers. From there patterns match as far as they reach, so a value is found wherever it stands
and however long it is. The automaton's library is required.

A find is replaced by `<kind:pseudonym>`. Numbers, identity numbers and dates are permuted within their format by a keyed Feistel
cipher (`pseudonyms`), signs staying in place, so that equal values (also written with other signs) get equal pseudonyms in all
documents, different values different ones, valid numbers stay valid, and the key's holder can take them back. Values without a
fixed format (names, addresses, e-mail addresses) get a keyed hash. Everything else in a text stays as it is.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnwork.llm.personal_names import Names
from kilnwork.llm.pseudonyms import DATE, date_parts, iban_valid, luhn, pseudonym

KINDS = ("email", "identity", "phone", "address", "name", "date")
#: A list of known names is read to the driver only up to this length.
MOST_NAMES = 200_000

_S = r"[ \t\xa0]"  # a blank within a line
_DASH = r"[-‐-―−]"
_SEP = rf"(?:{_S}?[./]{_S}?|{_DASH}|{_S}{{1,2}})"

# --- e-mail -----------------------------------------------------------------
_LOCAL = r"[^\W_][\w.+\-]*"
_LABEL = r"[^\W_](?:[\w\-]*[^\W_])?"
_WORD_DOT = rf"{_S}{{0,2}}[\[(]{_S}?dot{_S}?[\])]{_S}{{0,2}}|{_S}{{1,2}}dot{_S}{{1,2}}"
EMAIL = re.compile(
    rf"(?<![\w.+\-])(?:{_LOCAL}(?:{_S}?[@＠﹫]{_S}?|{_S}{{0,2}}[\[(]{_S}?at{_S}?[\])]{_S}{{0,2}}){_LABEL}(?:(?:[.．。]|{_WORD_DOT}){_LABEL})+"
    rf"|{_LOCAL}{_S}{{1,2}}at{_S}{{1,2}}{_LABEL}(?:(?:{_WORD_DOT}|\.){_LABEL})*(?:{_WORD_DOT}){_LABEL})",
    re.I,
)

# --- phone ------------------------------------------------------------------
_NOT_IN_NUMBER = rf"(?<![\w#$€£.,/+(])(?<!\d{_DASH})"
_END = rf"(?!\w)(?!{_DASH}\d)(?![.,/]\d)"
_EXT = rf"(?:{_S}?(?:ext\.?|x|Durchwahl|poste){_S}?\d{{1,5}})?"
#: With a country code.
PHONE_ABROAD = re.compile(
    "|".join(
        [
            rf"(?<![\w(])\(\+\d{{1,3}}\){_S}?\d[\d{_S[1:-1]}.\-]{{5,14}}\d{_END}",  # (+34) 910005795
            rf"(?<![\w+])\+\d{{1,3}}(?:{_SEP}?\(0\))?(?:{_SEP}?\(?\d{{1,5}}\)?){{1,6}}{_EXT}{_END}",  # international
        ]
    ),
    re.I,
)
PHONE = re.compile(
    "|".join(
        [
            rf"{_NOT_IN_NUMBER}00[1-9]\d{{0,2}}{_SEP}(?:\(0\){_S}?)?\d{{1,3}}(?:{_SEP}\d{{2,8}}){{1,5}}{_END}",  # 0033 (0)1 99 00 29 90
            rf"(?<![\w#])(?:1{_SEP})?\(\d{{3,5}}\){_S}?\d{{3}}(?:{_SEP}\d{{3,4}}|\d{{4}}){_EXT}{_END}",  # (523)555-0188, (01632) 960 780
            rf"{_NOT_IN_NUMBER}(?:1{_SEP})?\d{{3}}({_SEP})\d{{3}}\1?{_SEP}?\d{{4}}{_EXT}{_END}",  # 743-555-0185
            rf"{_NOT_IN_NUMBER}0\d{{2}}{_SEP}\d{{4}}{_SEP}\d{{4}}{_END}",  # 020 7946 0735
            rf"{_NOT_IN_NUMBER}0[1-9](?:{_SEP}?\d\d){{4}}{_END}",  # 01 99 00 47 85
            rf"{_NOT_IN_NUMBER}0\d{{2,4}}{_S}?[/ {_DASH[1:-1]}]{_S}?\d{{3,8}}(?:{_SEP}\d{{2,4}})?{_END}",  # 030/23125116
            rf"{_NOT_IN_NUMBER}9\d{{2}}{_S}\d{{3}}{_S}\d{{3}}{_END}",  # 910 000 063
            rf"{_NOT_IN_NUMBER}[69]\d{_SEP}\d{{3}}{_SEP}\d\d{_SEP}\d\d{_END}",  # 91-000-34-41
            rf"{_NOT_IN_NUMBER}\d{{3}}(?:{_DASH}|\.)\d{{4}}{_END}",  # 555-0145
            rf"{_NOT_IN_NUMBER}[2-9]\d{{9}}{_END}",
        ]
    ),
    re.I,
)

# --- identity numbers -------------------------------------------------------
IDENTITY = re.compile(
    "|".join(
        [
            rf"{_NOT_IN_NUMBER}[0124]{_S}?\d\d{_S}?\d\d{_S}?\d[\dAB]{_S}?\d{{3}}{_S}?\d{{3}}{_S}?\d\d{_END}",  # French social security
            rf"{_NOT_IN_NUMBER}\d{{3}}({_DASH}|[.  ])\d\d\2\d{{4}}{_END}".replace(r"\2", r"(?P=s)").replace(f"({_DASH}|", f"(?P<s>{_DASH}|"),  # social security
            rf"{_NOT_IN_NUMBER}[A-Z]{{2}}{_S}?\d\d{_S}?\d\d{_S}?\d\d{_S}?[A-Z]{_END}",  # national insurance
            rf"{_NOT_IN_NUMBER}[A-Z]{{2}}\d{{7}}{_END}",  # passport
            rf"{_NOT_IN_NUMBER}[A-Z]\d{{3}}{_DASH}\d{{4}}{_DASH}\d{{4}}{_END}",  # licence
            rf"{_NOT_IN_NUMBER}\d{{2}}\.?\d{{3}}\.?\d{{3}}{_S}?{_DASH}?{_S}?[A-Z]{_END}",  # DNI
            rf"{_NOT_IN_NUMBER}[XYZ]{_DASH}?\d{{7}}{_DASH}?[A-Z]{_END}",  # NIE
            rf"{_NOT_IN_NUMBER}[A-Z]\d\d{_S}?[A-Z]\d{{5}}{_S}?[A-Z]{_END}",  # Ausweis
            rf"{_NOT_IN_NUMBER}\d{{2}}/\d{{3}}/\d{{5}}{_END}",  # Steuernummer
        ]
    ),
    re.I,
)
#: Nine digits without signs are an identity number only near a word that says so.
NINE = re.compile(rf"{_NOT_IN_NUMBER}\d{{9}}{_END}")
_LABEL = re.compile(
    r"\b(?:ssn|itin|social|tax|steuer\w*|ids?|identi\w*|passport|pasaporte|passeport|reisepass|licen[cs]e|licencia|permis\w*|führerschein|cards?|carte|tarjeta|document\w*|ausweis\w*|pièce|sécurité|seguridad|dni|nie|nif|nino|insurance)\b",
    re.I,
)
#: Payment cards by network prefix and check digit, account numbers by check digits.
_NETWORK = re.compile(r"4(?:\d{12}|\d{15}|\d{18})|5[1-5]\d{14}|2[2-7]\d{14}|3[47]\d{13}|3(?:0[0-5]|[689]\d)\d{11}|35\d{14}|6(?:011|5\d\d|4[4-9]\d)\d{12}|(?:5[06-9]|6\d)\d{14}(?:\d{3})?")
CARD = re.compile(rf"{_NOT_IN_NUMBER}(?=[2-6])\d(?:(?:{_S}|{_DASH}|\.)?\d){{12,18}}{_END}")
IBAN = re.compile(rf"{_NOT_IN_NUMBER}[A-Z]{{2}}\d\d(?:{_S}?[A-Z0-9]{{4}}){{2,7}}(?:{_S}?[A-Z0-9]{{1,4}})?{_END}", re.I)
#: Before a number that is no person's.
_OTHERS_NUMBER = re.compile(r"(?:order|bestellung|pedido|commande|invoice|factura|facture|rechnung|lot|batch|barcode|code|table|item|sku|ref)\.?\s*(?:no\.?|nr\.?|number|n\.º|id)?\s*[:#]?\s*$", re.I)
_PHONE_LABEL = re.compile(r"(?:tel|tél|phone|call|fax|cell|mobile|landline|llame al|appelez le|rufen sie|ring|txt me|text)\W{0,4}$", re.I)
#: Numbers that are near enough to be of one value (an extension's word or a group of letters may be between), and how far a value
#: reaches beyond its first and last digit: prefixes are up to 4 signs, letters behind the last digit up to 35.
_RUN = re.compile(r"\d+(?:[^\d\n]{1,24}\d+)*")
_BEFORE_RUN, _BEHIND_RUN = 8, 48
_DIGIT, _DIGITS = re.compile(r"\d"), re.compile(r"\d+")

# --- addresses --------------------------------------------------------------
_CAP = r"[^\W\d_][\w'’\-]*"
_EN_SUFFIX = r"(?:Road|Rd|Street|St|Court|Ct|Lane|Ln|Avenue|Ave|Drive|Dr|Boulevard|Blvd|Way|Terrace|Ter|Place|Pl|Square|Sq|Close|Crescent|Row|Parkway|Pkwy)"
_TOWN = rf"(?-i:[^\W\d_a-zß-öø-ÿ])[\w'’\-]*(?:{_S}(?-i:[^\W\d_a-zß-öø-ÿ])[\w'’\-]*)?"
_EN_TAIL = (
    rf"(?:,?{_S}?(?:(?:Unit|Apt|Apartment|Suite|Ste|Flat|Floor)\.?{_S}?\w{{1,5}}|\#{_S}?\d+\w?))?"
    rf"(?:,{_S}{_TOWN}(?:,{_S}[A-Z]{{2}}{_S}\d{{5}})?)?"
)
_UNIT_BEFORE = re.compile(rf"(?:Flat|Unit|Apt|Apartment|Suite){_S}\w{{1,5}},{_S}\Z", re.I)
#: Patterns by what they start at: a number (English, French), a street word (Spanish), a compound or preposition and a number (German).
AT_NUMBER = [
    re.compile(rf"(?<![\w$€£#.,/:\-‐-―−])(?<!\d )(?<!/ )(?:(?:Flat|Unit|Apt|Apartment|Suite){_S}\w{{1,5}},{_S})?\d{{1,5}}(?:-?[A-Z])?{_S}+(?:[NSEW]\.?{_S}+)?(?!each\b|by\b|near\b|the\b|of\b){_CAP}(?:{_S}+(?!each\b|near\b|the\b|of\b){_CAP})?{_S}+{_EN_SUFFIX}\b\.?{_EN_TAIL}", re.I),
    re.compile(rf"(?<![\w$€£#.,/:\-‐-―−])(?<!\d )(?<!/ )\d{{1,4}}(?:{_S}(?:bis|ter|quater))?,?{_S}(?:rue|bd|boulevard|avenue|av\.|impasse|place|chemin|quai|allée|cours|route|square){_S}(?:(?:de{_S}la|du|des|de|d['’]|de{_S}l['’]){_S}?)?{_CAP}(?:,{_S}\d{{5}}{_S}{_TOWN})?", re.I),
]
AT_STREET = re.compile(rf"(?<!\w)(?:(?:Calle|Avda|Av|Avenida|Plaza|Pza|Paseo|Camino|Ronda|Carrera)\b\.?{_S}|C/{_S}?|P\.º{_S}?)(?:de{_S}(?:la{_S}|los{_S}|las{_S})?|del{_S})?{_CAP}(?:{_S}{_CAP})?,?{_S}(?:n\.?º{_S}?|núm\.{_S}?)?\d{{1,4}}\b(?:,{_S}\d{{1,2}}\.?º(?:{_S}\w)?)?(?:,{_S}\d{{5}}{_S}{_TOWN})?", re.I)
AT_COMPOUND = re.compile(rf"(?<!\w)[^\W\d_]{{3,}}(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|damm|ufer){_S}\d{{1,4}}{_S}?[a-z]?\b(?:,{_S}\d{{5}}{_S}{_TOWN})?", re.I)
AT_PREPOSITION = re.compile(rf"(?<!\w)(?:Am|Im|An{_S}der|An{_S}dem|Zum|Zur|Auf{_S}dem|In{_S}der){_S}{_CAP}{_S}\d{{1,4}}[a-z]?\b(?!{_S}?(?:Uhr|Personen|Euro|€))(?:,{_S}\d{{5}}{_S}{_TOWN})?", re.I)
_PREPOSITION_BEFORE = re.compile(rf"(?<!\w)(?:Am|Im|An{_S}der|An{_S}dem|Zum|Zur|Auf{_S}dem|In{_S}der){_S}\Z", re.I)
_STREET_WORDS = ["calle", "avda", "avenida", "av ", "av.", "plaza", "pza", "paseo", "camino", "ronda", "carrera", "c/", "p.º"]
_COMPOUNDS = ["straße", "strasse", "str.", "weg", "gasse", "platz", "allee", "ring", "damm", "ufer"]
_BIRTH = re.compile(
    rf"(?:\bborn\b|\bbirth(?:day|date)?\b|\bd\.?o\.?b\b\.?|\bnacid[oa]\b|\bnacimiento\b|\bnée?\b|\bnaissance\b|\bgeboren\b|\bgeburtsdatum\b|\bgeburtstag\b|\bgeb\.)(?:[\s:,(]|\b(?:on|is|was|the|el|le|am|es|est|ist|date|of)\b)*",
    re.I,
)
_BIRTH_WORDS = ["born", "birth", "dob", "d.o.b", "nacid", "nacimiento", "né", "naissance", "geboren", "geburts", "geb."]


def _small(text: str) -> str:
    """In small letters, letter by letter, so places stay the same."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _back(text: str, at: int, words: int) -> int:
    """Start of the `words` words before a place in its line."""
    while at and words and text[at - 1] not in "\r\n":
        at -= 1
        if text[at].isspace() and at and not text[at - 1].isspace():
            words -= 1
    return at


class Finder:
    """Finds personal values in texts; given and family: known names. dates: `birth` for dates of birth, `all` for every date, or None."""

    def __init__(self, given: list[str] | tuple = (), family: list[str] | tuple = (), dates: str | None = "birth") -> None:
        if dates not in ("birth", "all", None):
            raise ValueError("dates must be birth, all or None")
        words = {w: "@" for w in ("@", "＠", "﹫", "(at", "[at", "( at", "[ at")} | {f"{b}at{c}": "a" for b in " \t\xa0" for c in " \t\xa0"}
        words |= {w: "s" for w in _STREET_WORDS} | {f"{w}{b}": "c" for w in _COMPOUNDS for b in " \t\xa0"}
        if dates == "birth":
            words |= {w: "b" for w in _BIRTH_WORDS}
        self.names, self.dates = Names(list(given), list(family), words), dates

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """Places of personal values as (start, end, kind), in order, none within another."""
        low = _small(text)
        hits = self.names.hits(low)
        by: dict[str, list[int]] = {}
        for at, _, kinds in hits:
            for k in kinds:
                if k in "@ascb":
                    by.setdefault(k, []).append(at)
        taken: list[tuple[int, int, str]] = []

        def add(start: int, end: int, kind: str) -> None:
            if start < end and all(end <= a or b <= start for a, b, _ in taken):
                taken.append((start, end, kind))

        for span in self._mail(text, low, by):
            add(*span, "email")
        runs = [m.span() for m in _RUN.finditer(text)]
        windows = number_windows(text)
        for start, end in checked_numbers(text, windows):
            add(start, end, "identity")
        if self.dates == "all":
            for m in DATE.finditer(text):
                if date_parts(m):
                    add(*m.span(), "date")
        elif self.dates:
            for at in by.get("b", ()):
                label = _BIRTH.match(text, at)
                m = DATE.match(text, label.end()) if label else None
                if m and date_parts(m):
                    add(*m.span(), "date")
        for span in self._places(text, by, runs):
            add(*span, "address")
        for start, end, kind in numbers(text, windows):
            add(start, end, kind)
        rest, at = [], 0
        for a, b, _ in sorted(taken):
            rest += [text[at:a], "\0" * (b - a)]
            at = b
        for span in self.names.find("".join([*rest, text[at:]]), low, hits):
            add(*span, "name")
        return sorted(taken)

    def _mail(self, text: str, low: str, by: dict):
        starts = list(by.get("@", ()))
        if "a" in by and "dot" in low:
            starts += by["a"]
        for at in sorted(starts):
            while at and text[at - 1] in " \t\xa0":
                at -= 1
            start = at
            while start and (text[start - 1].isalnum() or text[start - 1] in "_.+-"):
                start -= 1
            while start < at and not text[start].isalnum():
                start += 1
            m = EMAIL.match(text, start) if start < at else None
            if m:
                yield m.span()

    def _places(self, text: str, by: dict, runs: list):
        """Spans of addresses, in order of their start."""
        found = []
        for start, end in runs:
            for m in _DIGITS.finditer(text, start, end):
                at = m.start()
                unit = _UNIT_BEFORE.search(text[max(0, at - 20) : at])
                if unit:
                    found.append((AT_NUMBER[0].match(text, at - len(unit[0])), 0))
                found += [(p.match(text, at), i + 1) for i, p in enumerate(AT_NUMBER)]
                if at > 3 and text[at - 1] in " \t\xa0":
                    word = at - 1
                    while word and (text[word - 1].isalnum() or text[word - 1] in "_'’-"):
                        word -= 1
                    before = _PREPOSITION_BEFORE.search(text[max(0, word - 12) : word]) if word < at - 1 else None
                    if before:
                        found.append((AT_PREPOSITION.match(text, word - len(before[0])), 5))
        if runs:
            found += [(AT_STREET.match(text, at), 3) for at in by.get("s", ())]
            for at in by.get("c", ()):
                while at and text[at - 1].isalpha():
                    at -= 1
                found.append((AT_COMPOUND.match(text, at), 4))
        return [m.span() for m, _ in sorted(((m, k) for m, k in found if m), key=lambda x: (x[0].start(), x[1]))]


def number_windows(text: str) -> list[tuple[int, int]]:
    """The parts of a text that can hold numbers: every value lies in one of them as a whole. No value has fewer than six digits, but behind a plus sign."""
    windows: list[tuple[int, int]] = []
    for m in _RUN.finditer(text):
        a, b = m.span()
        if windows and a - _BEFORE_RUN <= windows[-1][1]:
            windows[-1] = windows[-1][0], b + _BEHIND_RUN
        else:
            windows.append((max(0, a - _BEFORE_RUN), b + _BEHIND_RUN))
    return [(a, b) for a, b in windows if len(_DIGIT.findall(text, a, b)) > 5 or text.find("+", a, b) >= 0]


def checked_numbers(text: str, windows: list):
    """Spans of payment cards and account numbers whose check digits are right."""
    for start, end in windows:
        for m in IBAN.finditer(text, start, end):
            plain = re.sub(r"[^0-9A-Z]", "", m[0].upper())
            if len(plain) > 14 and iban_valid(plain):
                yield m.span()
        for m in CARD.finditer(text, start, end):
            plain = re.sub(r"\D", "", m[0])
            if _NETWORK.fullmatch(plain) and luhn(plain):
                yield m.span()


def numbers(text: str, windows: list):
    """Spans and kinds of phone and identity numbers, the surer formats first."""
    for start, end in windows:
        for m in PHONE_ABROAD.finditer(text, start, end):
            yield *m.span(), "phone"
    for start, end in windows:
        for m in IDENTITY.finditer(text, start, end):
            before = text[_back(text, m.start(), 4) : m.start()]
            if _OTHERS_NUMBER.search(before) or m["s"] and not _possible(m[0]):
                continue
            yield *m.span(), "phone" if _PHONE_LABEL.search(before) and m[0].isdigit() else "identity"
        for m in NINE.finditer(text, start, end):
            before = text[_back(text, m.start(), 7) : m.start()]
            if _OTHERS_NUMBER.search(before) or not _possible(m[0]):
                continue
            if _PHONE_LABEL.search(before):
                yield *m.span(), "phone"
            elif _LABEL.search(before) or re.match(rf"{_S}+belongs{_S}+to\b", text[m.end() : m.end() + 20]):
                yield *m.span(), "identity"
    for start, end in windows:
        for m in PHONE.finditer(text, start, end):
            if not _OTHERS_NUMBER.search(text[_back(text, m.start(), 4) : m.start()]):
                yield *m.span(), "phone"


def _possible(value: str) -> bool:
    """Whether a number of three, two and four digits can be a social security or taxpayer number."""
    d = re.sub(r"\D", "", value)
    return d[:3] not in ("000", "666") and d[3:5] != "00" and d[5:] != "0000"


def personal(df: DataFrame, keep: list[str], text: str, names: DataFrame | None, key: bytes | None, with_text: bool = True, dates: str | None = "birth") -> DataFrame:
    """The columns `keep`, found (array of kind, start_pos, end_pos, placeholder) and, with_text, redacted, of every row.

    names: name, name_kind (given, family) of known names, or None. key: the caller's secret of at most 64 bytes; without one
    placeholders are null and there is no redacted text to ask for. dates: which dates count (`Finder`). Positions are code points
    from 0. A null text has a null redacted and no finds; an empty one stays empty; repeated rows are treated alike. The text
    itself isn't kept.
    """
    if key is None and with_text:
        raise ValueError("a redacted text needs a key")
    listed = [] if names is None else names.where("name <> ''").select("name", "name_kind").limit(MOST_NAMES + 1).collect()
    if len(listed) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names")
    given = sorted({r[0].strip() for r in listed if r[1] == "given"})
    family = sorted({r[0].strip() for r in listed if r[1] == "family"})
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    out = f"{fields}, found array<struct<kind: string, start_pos: int, end_pos: int, placeholder: string>>" + (", redacted string" if with_text else "")

    def search(batches):
        finder = Finder(given, family, dates)
        for pdf in batches:
            found, redacted = [], []
            for t in pdf["__text"]:
                spans = finder.find(t) if t else []
                marks = [{"kind": k, "start_pos": a, "end_pos": b, "placeholder": pseudonym(t[a:b], k, key) if key is not None else None} for a, b, k in spans]
                found.append(marks)
                if with_text and t is not None:
                    parts, at = [], 0
                    for m in marks:
                        parts += [t[at : m["start_pos"]], m["placeholder"]]
                        at = m["end_pos"]
                    redacted.append("".join([*parts, t[at:]]))
                else:
                    redacted.append(None)
            result = pdf[keep].copy()
            result["found"] = found
            if with_text:
                result["redacted"] = redacted
            yield result

    return df.select(*keep, F.col(text).alias("__text")).mapInPandas(search, out)

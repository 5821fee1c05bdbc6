"""Personal data: validated numbers and dates become keyed pseudonyms of the same format (Feistel)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame

ROUNDS = 8
KINDS = ("card", "phone", "ip", "iban", "ssn", "date", "email")
# Patterns of each kind; a match counts only if its validator agrees.
PATTERN = re.compile(
    r"(?P<email>[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
    r"|(?P<iban>\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<phone>(?<![0-9A-Za-z.+-])(?:\+[1-9][0-9]{0,2}(?:[ .-]?\([0-9]{1,5}\))?(?:[ .-]?[0-9]{1,12}){1,6}|\([0-9]{3}\) ?[0-9]{3}[ -][0-9]{4}"
    r"|[0-9]{3}(?P<gap>[ .-])[0-9]{3}(?P=gap)[0-9]{4}|0[0-9]{2,4}[ -][0-9]{3,4}[ -]?[0-9]{3,4}|[2-9][0-9]{2}[2-9][0-9]{6})(?![0-9A-Za-z-]))"
    r"|(?P<ip>(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9]))"
    r"|(?P<date>(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9]))"
    r"|(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))"
    r"|(?P<card>(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9]))"
)
#: What says that ten digits without any sign are a phone number, right before them.
PHONE_WORD = re.compile(r"(?i)(?:phone|tel|telephone|mobile|cell|call|fax|text|whatsapp)(?: (?:no|number|me|us|at|on|is))*[ .:#=(]{0,4}$")
# Country calling codes of one and two digits; all others have three.
SHORT_CODES = (
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
).split()
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()


def _prf(key: bytes, tweak: str, turn: int, value: int) -> int:
    data = f"{tweak}|{turn}|{value}".encode()
    return int.from_bytes(hashlib.blake2b(data, key=key, digest_size=16).digest(), "big")


def permute(value: int, size: int, key: bytes, tweak: str, inverse: bool = False) -> int:
    """Keyed permutation of 0..size-1: a Feistel network on a*b >= size, walked until inside the range."""
    if size < 2:
        return value
    a = max(2, int(size**0.5))
    while a * a < size:
        a += 1
    b = -(-size // a)
    while True:
        left, right = divmod(value, b)  # left < a, right < b
        turns = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)
        sign = -1 if inverse else 1
        for turn in turns:
            if turn % 2 == 0:
                left = (left + sign * _prf(key, tweak, turn, right)) % a
            else:
                right = (right + sign * _prf(key, tweak, turn, left)) % b
        value = left * b + right
        if value < size:
            return value


def luhn_digit(digits: str) -> str:
    """The digit that makes ``digits`` plus itself pass the Luhn check."""
    total = sum(sum(divmod(int(d) * (2 if i % 2 == 0 else 1), 10)) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _date_of(year: int, month: int, day: int) -> date | None:
    try:
        found = date(year, month, day)
    except ValueError:
        return None
    return found if FIRST_DAY <= found.toordinal() <= LAST_DAY else None


def _parse_date(text: str) -> tuple[date | None, bool]:
    """The date, and whether its month stands first: so it is read where the day can't come first, that is with a day above 12."""
    first, second, third = (int(x) for x in re.split("[-./]", text))
    if text[4:5] == "-":
        return _date_of(first, second, third), False
    found = _date_of(third, second, first)
    return (found, False) if found else (_date_of(third, first, second), True)


def country_code(digits: str) -> str:
    """The calling code that the digits of an international number begin with."""
    return next((c for c in SHORT_CODES if digits.startswith(c)), digits[:3])


def _american(ten: str) -> bool:
    """Whether ten digits are a number of the North American plan."""
    return ten[0] in "23456789" and ten[3] in "23456789"


def _phone_parts(text: str) -> tuple[str, str]:
    """What stays and what is permuted: calling code or leading 0, and the rest. Ten digits without either are of code 1."""
    digits = re.sub("[^0-9]", "", text)
    if text[0] == "+":
        code = country_code(digits)
        return code, digits[len(code):]
    return ("0", digits[1:]) if digits[0] == "0" and not re.match(r"[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}$", text) else ("", digits)


def valid(kind: str, text: str) -> bool:
    digits = re.sub("[^0-9]", "", text)
    if kind == "card":
        return len(set(digits)) > 1 and luhn_digit(digits[:-1]) == digits[-1]
    if kind == "ip":
        return all(int(x) < 256 for x in text.split("."))
    if kind == "iban":
        return iban_rest(text.replace(" ", "")) == 1
    if kind == "date":
        return _parse_date(text)[0] is not None
    if kind == "phone":  # at most 15 digits by the international plan
        return len(_phone_parts(text)[1]) >= 5 and 8 <= len(digits) <= 15
    if kind == "ssn":
        return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"
    return True


def _refill(shape: str, symbols: str, pattern: str) -> str:
    """``shape`` with the characters that match ``pattern`` replaced by ``symbols`` in turn."""
    fresh = iter(symbols)
    return re.sub(pattern, lambda _: next(fresh), shape)


def _digits(text: str, size: int, key: bytes, tweak: str, inverse: bool) -> str:
    return f"{permute(int(text), size, key, tweak, inverse):0{len(text)}d}"


def pseudonym(kind: str, text: str, key: bytes, inverse: bool = False) -> str:
    """The keyed pseudonym of a valid ``text``: same format, valid again, one to one; ``inverse`` undoes it."""
    digits = re.sub("[^0-9]", "", text)
    if kind == "card":
        body = _digits(digits[:-1], 10 ** (len(digits) - 1), key, f"card{len(digits)}", inverse)
        while len(set(body + luhn_digit(body))) == 1:  # one repeated digit isn't a valid card: walk on
            body = _digits(body, 10 ** (len(digits) - 1), key, f"card{len(digits)}", inverse)
        return _refill(text, body + luhn_digit(body), "[0-9]")
    if kind == "phone":
        code, rest = _phone_parts(text)
        plan = "1" if code in ("", "1") and len(rest) == 10 else code  # one pseudonym whatever the spelling
        fresh = _digits(rest, 10 ** len(rest), key, f"phone{plan}|{len(rest)}", inverse)
        while (code == "0" and fresh[0] == "0") != (code == "0" and rest[0] == "0") or (plan == "1" and _american(fresh) != _american(rest)):
            fresh = _digits(fresh, 10 ** len(rest), key, f"phone{plan}|{len(rest)}", inverse)  # walk on to a number of the same sort
        return _refill(text, code + fresh, "[0-9]")
    if kind == "ip":
        number = int.from_bytes(bytes(int(x) for x in text.split(".")), "big")
        return ".".join(map(str, permute(number, 1 << 32, key, "ip", inverse).to_bytes(4, "big")))
    if kind == "iban":
        # Letters and digits of the account keep their places; the check digits follow from it.
        body = _alike(text.replace(" ", "")[4:], key, "iban" + text[:2], inverse)
        return _refill(text, text[:2] + f"{98 - iban_rest(text[:2] + '00' + body):02d}" + body, "[A-Z0-9]")
    if kind == "ssn":
        while True:
            digits = _digits(digits, 10**9, key, "ssn", inverse)
            if valid("ssn", digits):
                return _refill(text, digits, "[0-9]")
    if kind == "date":
        found, month_first = _parse_date(text)
        late = found.day > 12
        while True:  # days above 12 among themselves, so that every spelling of a date has the same pseudonym and can write it
            found = date.fromordinal(permute(found.toordinal() - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date", inverse) + FIRST_DAY)
            if (found.day > 12) == late:
                break
        if text[4] == "-":
            return found.isoformat()
        return found.strftime(f"%m{text[2]}%d{text[5]}%Y" if month_first else f"%d{text[2]}%m{text[5]}%Y")
    name, _, host = text.rpartition("@")
    return _alike(name, key, "email", inverse) + "@" + host


def _alike(text: str, key: bytes, tweak: str, inverse: bool) -> str:
    """Digits, capital and small letters permuted together, each place within its class."""
    bases = [(10, "0") if c.isdigit() else (26, "A") if c.isupper() else (26, "a") if c.islower() else None for c in text]
    size, value = 1, 0
    for c, base in zip(text, bases, strict=True):
        if base:
            size, value = size * base[0], value * base[0] + ord(c) - ord(base[1])
    shape = "".join(base[1] if base else c for c, base in zip(text, bases, strict=True))
    value, out = permute(value, size, key, f"{tweak}|{shape}", inverse), []
    for c, base in zip(reversed(text), reversed(bases), strict=True):
        if base:
            value, place = divmod(value, base[0])
            c = chr(ord(base[1]) + place)
        out.append(c)
    return "".join(reversed(out))


def rewrite(text: str, key: bytes, inverse: bool = False) -> tuple[str, dict[str, int]]:
    """``text`` with every valid match replaced, and how many of each kind there were."""
    counts = dict.fromkeys(KINDS, 0)

    def swap(match: re.Match) -> str:
        found = match.group()
        kind = next(k for k in KINDS if match[k] is not None)
        if not valid(kind, found):
            return found
        if kind == "phone" and found.isdigit() and found[0] != "0" and not PHONE_WORD.search(text, max(0, match.start() - 40), match.start()):
            return found  # order numbers and the like
        counts[kind] += 1
        return pseudonym(kind, found, key, inverse)

    return PATTERN.sub(swap, text), counts


def pseudonymise(docs: DataFrame, key: bytes, inverse: bool = False) -> DataFrame:
    """``doc_id``, ``text`` with pseudonyms, and ``n_<kind>`` per kind, one row per row of ``docs(doc_id, text)``.

    Kinds: cards (Luhn), phones (international, of the North American plan, or with a leading 0;
    ten digits without any sign only right after a word for phones; a number has one pseudonym with
    and without +1), IPv4 addresses (octets below 256), IBANs
    (remainder 97), US social security numbers, dates of 1900-2099 (calendar; month first
    where the day can't be; a date has one pseudonym in all spellings), e-mail names (hosts stay).
    Each is permuted within its format under ``key``; formatting characters stay, so a value gives
    the same pseudonym wherever it stands, and ``inverse`` restores the text. What fails its
    check stays as it is. A null text stays null with zero counts; whole texts are read; equal rows
    give equal results. Other columns are ignored. No shuffle: each row is rewritten in its task.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [
                (None, dict.fromkeys(KINDS, 0)) if t is None else rewrite(t, key, inverse) for t in batch["text"].to_pylist()
            ]
            counts = [pa.array([c[kind] for _, c in done], pa.int64()) for kind in KINDS]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([t for t, _ in done], pa.string()), *counts],
                ["doc_id", "text", *[f"n_{kind}" for kind in KINDS]],
            )

    schema = "doc_id long, text string, " + ", ".join(f"n_{kind} long" for kind in KINDS)
    return docs.select("doc_id", "text").mapInArrow(apply, schema)

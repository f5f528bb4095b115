"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

Numbers and dates that validate (Luhn, mod 97, octets, calendar, number plans) and addresses are replaced by others of
the same format that validate too. Each kind has its own permutation of the set of valid values, whatever their layout,
so equal values get equal pseudonyms in every document, different ones different, and whoever has the key can go back
(``back``). A telephone number is its digits, a North American one with or without +1; a date is its day, of which the
permutation keeps what layouts depend on (months and days below 10, days above 12). A value is read as a number in mixed radix over the alphabets of its positions; ten Feistel rounds keyed with BLAKE2b permute
the next even number of bits, and the permutation is walked on until its result is in range and valid, which keeps it
one to one.

Kinds: email, iban, card, ip, date, ssn, phone, secret. What doesn't validate stays as it is, as do texts without any
of these, byte for byte. A null text stays null; an empty table gives no rows; repeated rows are each replaced alike;
further columns are left out or, with ``keep``, passed on, whatever their names.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
ROUNDS = 10
#: Country codes of two digits; 1 and 7 have one, the others three.
TWO_DIGIT_CODES = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Pseudonyms that a worker remembers.
REMEMBERED = 100_000


class Feistel:
    """Keyed permutations of 0..n-1, one for each n and tweak."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: bytes, i: int, x: int, half: int, bits: int) -> int:
        size, out, block = (bits + 7) // 8, b"", 0
        while len(out) < size:
            data = tweak + b"|%d|%d|%d|%d|" % (half, bits, i, block) + x.to_bytes((x.bit_length() + 7) // 8 + 1, "big")
            out, block = out + hashlib.blake2b(data, key=self.key[:64]).digest(), block + 1
        return int.from_bytes(out[:size], "big") & ((1 << bits) - 1)

    def _once(self, x: int, tweak: bytes, half: int, back: bool) -> int:
        low = (1 << half) - 1
        a, b = x >> half, x & low
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                a, b = b ^ self._round(tweak, i, a, half, half), a
            else:
                a, b = b, a ^ self._round(tweak, i, b, half, half)
        return a << half | b

    def permute(self, x: int, n: int, tweak: bytes, valid: Callable[[int], bool] | None = None, back: bool = False) -> int:
        """Where x goes; walks on until the result is below n and valid, as x itself must be."""
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        while True:
            x = self._once(x, tweak, half, back)
            if x < n and (valid is None or valid(x)):
                return x


def to_number(value: str, alphabets: list[str]) -> int:
    x = 0
    for c, a in zip(value, alphabets, strict=True):
        x = x * len(a) + a.index(c)
    return x


def from_number(x: int, alphabets: list[str]) -> str:
    out = []
    for a in reversed(alphabets):
        x, k = divmod(x, len(a))
        out.append(a[k])
    return "".join(reversed(out))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def alphabet(c: str) -> str:
    return DIGITS if c in DIGITS else LOWER if c in LOWER else UPPER if c in UPPER else c


class Pseudonyms:
    """Finds and replaces. Every ``_kind`` method returns the pseudonym of a match, or None if it doesn't validate."""

    PATTERNS = {
        "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])"),
        "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![A-Za-z0-9])"),
        "card": re.compile(r"(?<![0-9])(?<![0-9][.,-])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9])"),
        "ip": re.compile(r"(?<![0-9])(?<![0-9]\.)[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9])(?!\.[0-9])"),
        "date": re.compile(r"(?<![0-9])(?<![0-9][./-])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?![0-9])(?![./-][0-9])"),
        "ssn": re.compile(r"(?<![0-9])(?<![0-9]-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])(?!-[0-9])"),
        "phone": re.compile(r"(?<![0-9A-Za-z+])(?:\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\))?(?:[ .-]?[0-9]{1,12}){1,6}|(?<![0-9][.-])\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}|(?<![0-9][.-])[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}|(?<![0-9][ .-])[0-9]{3} [0-9]{3} [0-9]{4})(?![0-9])"),
        "secret": re.compile(r"(?:(?<![A-Za-z0-9])(?i:api[_-]?key|access[_-]?key|secret|token|passwd|password)(?![A-Za-z0-9])[\"']?\s{0,3}[=:]\s{0,3}[\"']?(?P<v>[A-Za-z0-9_+/.=-]{12,})|(?<![A-Za-z0-9])(?P<w>AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9]))"),
    }
    NEEDS = re.compile(r"[0-9@]|(?i:key|secret|token|passw)")

    def __init__(self, key: bytes, back: bool = False):
        """back: finds pseudonyms and puts the values in that they stand for."""
        self.feistel, self.known, self.back = Feistel(key), {}, back

    def _permute(self, x: int, n: int, tweak: bytes, valid: Callable[[int], bool] | None = None) -> int:
        return self.feistel.permute(x, n, tweak, valid, self.back)

    def _spell(self, kind: str, value: str, alphabets: list[str], valid: Callable[[str], bool] | None = None) -> str:
        """Permutes value over its alphabets, which are part of the tweak."""
        n = 1
        for a in alphabets:
            n *= len(a)
        if n < 2:
            return value
        ok = None if valid is None else lambda x: valid(from_number(x, alphabets))
        tweak = f"{kind}|{len(value)}|{'|'.join(alphabets)}".encode()
        return from_number(self._permute(to_number(value, alphabets), n, tweak, ok), alphabets)

    @staticmethod
    def _refill(layout: str, digits: str) -> str:
        it = iter(digits)
        return "".join(next(it) if c in DIGITS else c for c in layout)

    def _email(self, value: str) -> str:
        local, _, domain = value.rpartition("@")
        name, dot, rest = domain.partition(".")
        return self._spell("email", local, [alphabet(c) for c in local]) + "@" + self._spell("domain", name, [alphabet(c) for c in name]) + dot + rest

    def _iban(self, value: str) -> str | None:
        plain = value.replace(" ", "")
        if not 15 <= len(plain) <= 34 or mod97(plain) != 1:
            return None
        body = self._spell("iban" + plain[:2], plain[4:], [alphabet(c) for c in plain[4:]])
        new = iter(plain[:2] + f"{98 - mod97(plain[:2] + '00' + body):02d}" + body)
        return "".join(c if c == " " else next(new) for c in value)

    def _card(self, value: str) -> str | None:
        digits = re.sub("[ -]", "", value)
        if not luhn(digits) or len(set(digits)) == 1:
            return None
        body = digits[0] + self._spell("card" + digits[0], digits[1:-1], [DIGITS] * (len(digits) - 2))
        return self._refill(value, body + next(c for c in DIGITS if luhn(body + c)))

    def _ip(self, value: str) -> str | None:
        parts = value.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        x = 0
        for p in parts:
            x = x * 256 + int(p)
        x = self._permute(x, 1 << 32, b"ip")
        return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))

    def _date(self, value: str) -> str | None:
        sep = next(c for c in value if c not in DIGITS)
        parts = value.split(sep)
        first = 0 if len(parts[0]) == 4 else 2
        a, b = (int(parts[i]) for i in range(3) if i != first)
        day_first = first == 2 and (sep == "." or a > 12)
        month, day = (b, a) if day_first else (a, b)
        try:
            at = datetime.date(int(parts[first]), month, day)
        except ValueError:
            return None
        start = datetime.date(1900, 1, 1).toordinal()
        n = datetime.date(2100, 1, 1).toordinal() - start
        if not 0 <= at.toordinal() - start < n:
            return None
        kind = (month < 10, day < 10, day > 12)  # layouts show these by width, and which of the two is the month

        def same(x: int) -> bool:
            d = datetime.date.fromordinal(start + x)
            return (d.month < 10, d.day < 10, d.day > 12) == kind

        new = datetime.date.fromordinal(start + self._permute(at.toordinal() - start, n, b"date", same))
        x, y = (p for i, p in enumerate(parts) if i != first)
        m, d = (y, x) if day_first else (x, y)
        m, d = f"{new.month:0{len(m)}d}", f"{new.day:0{len(d)}d}"
        return sep.join([str(new.year), m, d] if first == 0 else [d, m, str(new.year)] if day_first else [m, d, str(new.year)])

    def _ssn(self, value: str) -> str | None:
        def valid(d: str) -> bool:
            return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

        digits = value.replace("-", "")
        return self._refill(value, self._spell("ssn", digits, [DIGITS] * 9, valid)) if valid(digits) else None

    def _phone(self, value: str) -> str | None:
        digits = "".join(c for c in value if c in DIGITS)
        if not 8 <= len(digits) <= 15:
            return None
        keep = 0
        if value[0] == "+":  # the country code has one, two or three digits, as numbering plans lay down
            keep = 1 if digits[0] in "17" else 2 if digits[:2] in TWO_DIGIT_CODES else 3
        elif len(digits) == 11 and digits[0] == "1":
            keep = 1
        code, body = digits[:keep], digits[keep:]
        if len(body) == 10 and code in ("", "1"):  # North American plan: area and exchange begin with 2-9
            code, alphabets = "1", [("23456789" if c in "23456789" else "01") if i in (0, 3) else DIGITS for i, c in enumerate(body)]
        else:
            alphabets = ["123456789" if body[0] != "0" else "0"] + [DIGITS] * (len(body) - 1)
        return self._refill(value, digits[:keep] + self._spell("phone" + code, body, alphabets))

    def _secret(self, value: str) -> str:
        lead = re.match(r"AKIA|gh[pousr]_", value)
        head = lead.group() if lead else ""
        body = value[len(head) :]
        if re.fullmatch("[0-9a-f]+", body) and re.search("[a-f]", body) and re.search("[0-9]", body):
            alphabets = [HEX] * len(body)
        elif re.fullmatch("[0-9A-F]+", body) and re.search("[A-F]", body) and re.search("[0-9]", body):
            alphabets = [HEX.upper()] * len(body)
        else:
            alphabets = [alphabet(c) for c in body]
        return head + self._spell("secret" + head, body, alphabets)

    def pseudonym(self, kind: str, value: str) -> str | None:
        at = (kind, value)
        if at not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[at] = getattr(self, "_" + kind)(value)
        return self.known[at]

    def find(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, pseudonym) of what validates; kinds named first win where they overlap."""
        if not self.NEEDS.search(text):
            return []
        taken: list[tuple[int, int, str, str]] = []  # disjoint, in order
        for kind, pattern in self.PATTERNS.items():
            if kind == "email" and "@" not in text:
                continue
            at = 0
            while m := pattern.search(text, at):
                at, limit = max(m.end(), at + 1), m.end()
                while m:  # what runs into a value found before, or doesn't validate, may do so without its last part
                    group = (m.lastgroup or 0) if kind == "secret" else 0
                    start, end = m.span(group)
                    k = bisect.bisect(taken, (start,))
                    free = (k == 0 or taken[k - 1][1] <= start) and (k == len(taken) or end <= taken[k][0])
                    new = self.pseudonym(kind, text[start:end]) if free else None
                    if new is not None:
                        taken.insert(k, (start, end, kind, new))
                        at = max(m.end(), start + 1)
                        break
                    limit = text.rfind(" ", m.start(), limit)
                    m = pattern.match(text, m.start(), limit) if limit > m.start() else None
        return taken

    def replace(self, text: str) -> tuple[str, list[tuple[int, int, str, str]]]:
        found = self.find(text)
        if not found:
            return text, found
        out, at = [], 0
        for start, end, _, new in found:
            out += [text[at:start], new]
            at = end
        return "".join(out) + text[at:], found


def pseudonymised(docs: DataFrame, key: bytes, keep: list[str] | None = None, text_col: str = "text", names: tuple[str, str] = ("n_found", "kinds"), back: bool = False) -> DataFrame:
    """``keep`` columns (the text replaced in place), n_found and kinds (sorted, distinct, comma-separated) or other names.

    One narrow pass without a shuffle. ``key`` is the secret on which all pseudonyms depend. back: restores texts.
    """
    keep = keep or ["doc_id", text_col]
    chosen = docs.select(*[F.col(f"`{c}`") for c in keep])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields)
    where = keep.index(text_col)

    def run(batches):
        p = Pseudonyms(key, back)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts, n, kinds = [], [], []
                for t in part.column(where).to_pylist():
                    new, found = p.replace(t) if t else (t, [])
                    texts.append(new)
                    n.append(len(found))
                    kinds.append(",".join(sorted({f[2] for f in found})))
                cols = [pa.array(texts, pa.string()) if i == where else c for i, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int32()), pa.array(kinds, pa.string())], [*keep, *names])

    return chosen.mapInArrow(run, f"{fields}, `{names[0]}` int, `{names[1]}` string")

"""Format-preserving pseudonyms for personal data: keyed Feistel permutations of validated numbers, dates and names."""

from __future__ import annotations

import datetime as dt
import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from marginalia.llm.common import widened
from marginalia.llm.words import numbered, slices, small_batches

ROUNDS = 8
_DIGITS, _HEX = "0123456789", "0123456789abcdef"
_CAPS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BASE32 = _CAPS + "234567"  # fixed: letters of access key ids

#: What is looked for, in this order; the first kind that takes a stretch of text keeps it. Every pattern starts at a boundary.
PATTERNS = {
    "email": r"(?<![\w.+\-])[\w.+\-]*\w@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[A-Z2-7]{16}(?![A-Za-z0-9])|(?i:aws_secret_access_key|token|secret|api[_\-]?key|passwd|password|pwd)[\"']?[ ]?[=:][ ]?[\"']?[^\s\"']{6,}|gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])|xox[abprs]-[A-Za-z0-9\-]{10,}|sk-(?:[a-z]+-)?[A-Za-z0-9_]{20,}|eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,})",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv4": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9\-/.])(?:[0-9]{4}(?P<sep1>[\-/.])[0-9]{1,2}(?P=sep1)[0-9]{1,2}|[0-9]{1,2}(?P<sep2>[\-/.])[0-9]{1,2}(?P=sep2)[0-9]{4})(?![0-9]|[\-/.][0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "card": r"(?<![0-9\-.])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9]|[\-.][0-9])",
    "phone": r"(?<![\w+])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{2,4}\)[ .\-]?|[0-9]{2,4}[ .\-])[0-9]{3,4}[ .\-][0-9]{3,4}(?![0-9]|[.\-][0-9])|(?<![\w+])\+[0-9]{9,14}(?![0-9])",
}
_ALL = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in PATTERNS.items()))
_KINDS = {kind: re.compile(pattern) for kind, pattern in PATTERNS.items()}
_STRETCH, _GROUP = re.compile(r"[0-9]+(?:[ \-][0-9]+)*"), re.compile("[0-9]+")
_TOKEN = re.compile(r"[A-Za-z0-9]+")
#: Digits in groups of a card number: if their check fails they are a mistyped card, and no phone numbers.
_FOURS = re.compile(r"[0-9]{4}([ \-])[0-9]{4}(?:\1[0-9]{4})*\1[0-9]{1,4}")
_CARD_GROUPS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), *((n,) for n in range(13, 20))}
#: One of these stands in every stretch that a pattern can match: a digit, an e-mail's sign, or the name or prefix of a secret, here
#: without case. Texts without any are left alone at once.
_MARK = re.compile("[0-9@]")
_NAMES = ("akia", "sk-", "xox", "eyj", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "token", "secret", "api", "passwd", "password", "pwd")


def possible(text: str) -> bool:
    """Whether some pattern may match; a test holds this against the patterns."""
    if _MARK.search(text):
        return True
    plain = text.casefold()
    return any(name in plain for name in _NAMES)


class Feistel:
    """A keyed permutation of range(size) for any size: a balanced Feistel network over at least as many numbers, walked along its
    cycle until it lands in the range again. The tweak keeps kinds and formats apart."""

    def __init__(self, key: bytes, tweak: str, size: int):
        self.size, self.tweak, self.key = size, tweak.encode(), key
        self.half = max(1, ((size - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1

    def _round(self, i: int, right: int) -> int:
        said = hmac.digest(self.key, b"%d|%s|%d" % (i, self.tweak, right), "sha256")
        return int.from_bytes(said, "big") & self.mask

    def __call__(self, value: int) -> int:
        while True:
            left, right = value >> self.half, value & self.mask
            for i in range(ROUNDS):
                left, right = right, left ^ self._round(i, right)
            value = left << self.half | right
            if value < self.size:
                return value

    def back(self, value: int) -> int:
        while True:
            left, right = value >> self.half, value & self.mask
            for i in reversed(range(ROUNDS)):
                left, right = right ^ self._round(i, left), left
            value = left << self.half | right
            if value < self.size:
                return value


def luhn_digit(body: str) -> str:
    """The check digit that makes body + digit pass the Luhn test."""
    total = sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(body))))
    return str(-total % 10)


def _refill(model: str, digits: str) -> str:
    """model with its digits replaced one by one."""
    it = iter(digits)
    return "".join(next(it) if c.isascii() and c.isdigit() else c for c in model)


class Digits:
    """A stretch of digit groups, one space or hyphen between each, in which cards are looked for: sums of digits, plain and doubled, up to
    each place, tell in one step whether a run of groups passes the Luhn test."""

    def __init__(self, text: str, start: int):
        self.text, self.end = text, _STRETCH.match(text, start).end()
        groups = [(m.start(), m.end()) for m in _GROUP.finditer(text, start, self.end)]
        self.at = {a: i for i, (a, _) in enumerate(groups)}
        self.groups, self.before, self.found = groups, [0], {}
        digits = "".join([text[a:z] for a, z in groups])
        self.digits = digits
        for a, z in groups:
            self.before.append(self.before[-1] + z - a)
        twice = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
        # sums[p]: digits at places of parity p plain, the others doubled
        self.sums = ([0], [0])
        for i, c in enumerate(map(int, digits)):
            self.sums[i % 2].append(self.sums[i % 2][-1] + c)
            self.sums[1 - i % 2].append(self.sums[1 - i % 2][-1] + twice[c])

    def holds(self, start: int) -> bool:
        return start in self.at

    def cards(self, start: int) -> list[tuple[bool, int]]:
        if start in self.found:
            return self.found[start]
        first, found = self.at[start], []
        lo = self.before[first]
        for i in range(first, len(self.groups)):
            hi, end = self.before[i + 1], self.groups[i][1]
            if hi - lo > 19:
                break
            sums = self.sums[(hi - 1) % 2]
            if hi - lo >= 13 and (sums[hi] - sums[lo]) % 10 == 0 and len(set(self.digits[lo:hi])) > 1 and not (self.text[end : end + 1] == "." and self.text[end + 1 : end + 2].isdigit()):
                found.append((tuple(z - a for a, z in self.groups[first : i + 1]) not in _CARD_GROUPS, end))
        self.found[start] = sorted(found, key=lambda c: (c[0], -c[1]))
        return self.found[start]


class Pseudonyms:
    """Replaces what PATTERNS finds and its check confirms. Equal values, however they are punctuated, get equal digits."""

    def __init__(self, key: bytes):
        self.key, self.known = key, {}
        self.digits: Digits | None = None

    def _moved(self, tweak: str, size: int, value: int) -> int:
        found = self.known.get((tweak, size))
        if found is None:
            if len(self.known) > 10_000:
                self.known.clear()
            found = self.known[tweak, size] = Feistel(self.key, tweak, size)
        return found.back((found(value) + 1) % size)  # a permutation too, and one that leaves no value where it is

    def _text(self, tweak: str, value: str, alphabet: str) -> str:
        n = 0
        for c in value:
            n = n * len(alphabet) + alphabet.index(c)
        n = self._moved(f"{tweak}{len(value)}", len(alphabet) ** len(value), n)
        out = []
        for _ in value:
            n, r = divmod(n, len(alphabet))
            out.append(alphabet[r])
        return "".join(reversed(out))

    def _word(self, tweak: str, value: str) -> str:
        """Letters become letters of their case, digits digits; other characters stay. Letters beyond ASCII become ASCII ones."""
        flat = "".join(c if c.isascii() or not c.isalnum() else "a" for c in value)
        said = hashlib.sha256(value.encode()).digest()  # letters beyond ASCII still tell values apart
        kinds = "".join("d" if c.isdigit() else "u" if c.isupper() else "l" for c in flat if c.isalnum())
        size, n = 1, 0
        for c in (c for c in flat if c.isalnum()):
            base = 10 if c.isdigit() else 26
            n, size = n * base + (int(c) if c.isdigit() else ord(c.lower()) - 97), size * base
        n = self._moved(f"{tweak}{kinds}" + ("" if value.isascii() else said.hex()), size, n)
        out = []
        for k in reversed(kinds):
            n, r = divmod(n, 10 if k == "d" else 26)
            out.append(str(r) if k == "d" else (_CAPS if k == "u" else _CAPS.lower())[r])
        it = iter(reversed(out))
        return "".join(next(it) if c.isalnum() else c for c in flat)

    def email(self, s: str) -> str | None:
        local, _, host = s.rpartition("@")
        return f"{self._word('email' + host.lower(), local)}@{host}"

    def secret(self, s: str) -> str | None:
        if s.startswith("AKIA") and len(s) == 20 and not set(s[4:]) - set(_BASE32):
            return "AKIA" + self._text("akia", s[4:], _BASE32)
        head = re.match(r"(?:[A-Za-z_\-]+[\"']?[ ]?[=:][ ]?[\"']?|gh[pousr]_|xox[abprs]-|sk-(?:[a-z]+-)?|eyJ)", s)[0]
        value = s[len(head) :]
        if not set(value) - set(_HEX):
            return head + self._text("hex", value, _HEX)
        return head + self._word("secret", value)

    def iban(self, s: str) -> str | None:
        plain = s.replace(" ", "")
        number = lambda x: int("".join(str(int(c, 36)) for c in x))
        if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
            return None
        body = self._word(f"iban{plain[:2]}", plain[4:])
        new = iter(f"{plain[:2]}{98 - number(body + plain[:2] + '00') % 97:02d}{body}")
        return "".join(c if c == " " else next(new) for c in s)

    def ipv4(self, s: str) -> str | None:
        parts = [int(x) for x in s.split(".")]
        if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in s.split(".")):
            return None
        n = self._moved("ipv4", 1 << 32, int.from_bytes(bytes(parts), "big"))
        return ".".join(map(str, n.to_bytes(4, "big")))

    def date(self, s: str) -> str | None:
        a, mark, b, c = re.match(r"(\d+)([\-/.])(\d+)[\-/.](\d+)", s).groups()
        first = len(a) == 4
        y, m, d = (int(x) for x in ((a, b, c) if first else (c, b, a)))
        swapped = not first and m > 12 and d <= 12
        try:
            day = dt.date(y, d if swapped else m, m if swapped else d)
        except ValueError:
            return None
        if not 1900 <= y <= 2099:
            return None
        start, end = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()
        day = dt.date.fromordinal(start + self._moved("date", end - start + 1, day.toordinal() - start))
        pad = lambda x, was: f"{x:0{len(was)}d}"
        if first:
            return f"{day.year:04d}{mark}{pad(day.month, b)}{mark}{pad(day.day, c)}"
        x, z = (day.month, day.day) if swapped else (day.day, day.month)
        return f"{pad(x, a)}{mark}{pad(z, b)}{mark}{day.year:04d}"

    def ssn(self, s: str) -> str | None:
        area, group, serial = s.split("-")
        valid = lambda n: n // 10**6 not in (0, 666) and n // 10**6 < 900 and n // 10**4 % 100 and n % 10**4
        n = int(area + group + serial)
        if not valid(n):
            return None
        n = self._moved("ssn", 10**9, n)
        while not valid(n):
            n = self._moved("ssn", 10**9, n)
        return _refill(s, f"{n:09d}")

    def phone(self, s: str) -> str | None:
        code = re.match(r"\+\d{1,3}(?=[ .\-(])|\+\d", s)
        head = code[0] if code else ""
        rest = s[len(head) :]
        digits = re.sub(r"\D", "", rest)
        if not 7 <= len(digits) + len(head.strip("+")) <= 15 or len(digits) < 7:
            return None
        return head + _refill(rest, self._text(f"phone{head}", digits, _DIGITS))

    def card(self, s: str) -> str | None:
        digits = re.sub(r"\D", "", s)
        if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        body = self._text("card", digits[:-1], _DIGITS)
        return _refill(s, body + luhn_digit(body))

    def _cards(self, text: str, start: int) -> list[tuple[bool, int]]:
        """The stretches of whole digit groups from start that are valid cards: (grouped otherwise than cards are, end), those in a
        card's groups first, then the longest. What was found at a place is kept as long as the search stays in its stretch of digits."""
        if self.digits is None or self.digits.text is not text or not self.digits.holds(start):
            self.digits = Digits(text, start)
        return self.digits.cards(start)

    def _candidate(self, text: str, start: int, kind: str, barred: int) -> tuple[tuple[str, int, int, str] | None, int]:
        """What stands from start on: (kind, start, end, new) of the first kind, from kind on, one of whose stretches passes its
        check, or None; and the end of a mistyped card, inside which no phone number is looked for."""
        for k in list(PATTERNS)[list(PATTERNS).index(kind) :]:
            m = _KINDS[k].match(text, start)
            if m is None:
                continue
            if k == "card":
                own = self._cards(text, start)
                if own and not own[0][0]:
                    return (k, start, own[0][1], self.card(text[start : own[0][1]])), 0
                # a card in its own groups that begins inside goes before one that only fits by its check digit
                for group in re.finditer(r"(?<=[ \-])[0-9]+", m[0]):
                    inner = self._cards(text, start + group.start())
                    if inner and not inner[0][0]:
                        at = start + group.start()
                        for before in _KINDS["phone"].finditer(text, start, at - 1):
                            if (new := self.phone(before[0])) is not None:
                                return ("phone", before.start(), before.end(), new), 0
                        return (k, at, inner[0][1], self.card(text[at : inner[0][1]])), 0
                if own and "-" in (held := text[start : own[0][1]]) and " " in held:  # so does a phone number of one mark between others
                    for before in _KINDS["phone"].finditer(text, start, own[0][1]):
                        if len(set(re.sub("[0-9]", "", before[0]))) == 1 and (new := self.phone(before[0])) is not None:
                            return ("phone", before.start(), before.end(), new), 0
                if own:
                    return (k, start, own[0][1], self.card(text[start : own[0][1]])), 0
                if _FOURS.fullmatch(m[0]):
                    barred = max(barred, m.end())
            elif k == "iban":  # the whole stretch, then without its last words
                for end in [m.end(), *(start + g.start() for g in reversed(list(re.finditer(" ", m[0]))))]:
                    if (new := self.iban(text[start:end])) is not None:
                        return (k, start, end, new), 0
            elif not (k == "phone" and m.end() <= barred) and (new := getattr(self, k)(m[0])) is not None:
                return (k, start, m.end(), new), 0
        return None, barred

    def __call__(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and (kind, start, end) of each in the new text."""
        if not possible(text):
            return text, []
        out, at, place, found, pos, barred = [], 0, 0, [], 0, 0
        self.digits = None
        while m := _ALL.search(text, pos):
            kind = next(k for k in PATTERNS if m[k] is not None)
            hit, mistyped = self._candidate(text, m.start(), kind, barred)
            barred = max(barred, mistyped)
            if hit is None:  # go on behind the first group of the stretch, not behind all of it
                token = _TOKEN.match(text, m.start())
                pos = token.end() if token else m.start() + 1
                continue
            kind, start, end, new = hit
            out += [text[at:start], new]
            place += start - at
            found.append((kind, place, place + len(new)))
            place += len(new)
            at = pos = end
        return "".join([*out, text[at:]]), found


def pseudonymize(df: DataFrame, key: str, text: str = "text", spans: str = "pii") -> DataFrame:
    """Every row of df with pseudonyms in its text and the column spans, the kind, start and end of each in the new text.

    Card numbers (Luhn), IBANs (mod 97), IPv4 addresses, dates (1900 to 2099, valid in the calendar), social security numbers,
    phone numbers, e-mail addresses (the local part) and secrets (keys, tokens, passwords) are permuted within their format by a
    Feistel network under key, so equal values stay equal across documents and check digits hold. What fails its check stays,
    but shorter stretches of it, later ones from the next group of characters on, and other kinds are tried first.
    A null text stays null with no pii; empty and very long texts are handled whole; other columns and repeated rows pass
    through; a column that df has under the name of spans is replaced."""
    df = df.drop(spans)
    names, secret = df.columns, key.encode()
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = Pseudonyms(secret)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in slices(batches):
            done = [(None, []) if t is None else change(t) for t in batch.column(at).to_pylist()]
            columns = [batch.column(i) if i != at else pa.array([d[0] for d in done], pa.string()) for i in range(len(names))]
            found = pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in d[1]] for d in done], kind)
            yield pa.RecordBatch.from_arrays([*columns, found], [*names, spans])

    found = StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])
    return small_batches(numbered(df)).mapInArrow(run, widened(df, StructField(spans, ArrayType(found))))

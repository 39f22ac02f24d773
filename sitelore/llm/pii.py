"""Format-preserving pseudonyms for personal numbers and dates by keyed Feistel permutations.

Candidates are found by pattern and validated (checksum, ranges, calendar). A valid value is read as a whole
number below the size of its format's domain, permuted by a Feistel network over the next even number of bits with
cycle walking, and written back in the same format, separators and all: a card number stays a valid card number, a date a date. The
permutation depends only on key and kind, so equal values get equal pseudonyms in every document,
and ``recover`` with the key gives them back.

Kinds: card (13 to 19 digits, Luhn; the first digit stays), iban (mod 97; country stays), phone (+ and country code stay, so does a 1 before a ten-digit number), ssn, ip (four octets), date (1900 to
2099: any date of the calendar, whatever it stands for, so a history text gets other dates unless ``kinds`` leaves dates out), email (letters and digits of the local part; domain stays), secret (hexadecimal or letters-and-digits value of a key, token, secret or password).

Cases: null texts stay null, empty ones empty. What fails validation stays as it is. Values are found left to right and don't
overlap. In a run of digit groups a card is the longest valid span of whole groups, so a code or date beside it doesn't hide it. In a run of several groups a
pseudonym that would be read in another way beside its neighbours is permuted again, so that it can be recovered; only there can equal values get other pseudonyms. Whole texts are read, whatever their length. Repeated rows get equal results. Other columns are carried along;
an own column named pii is replaced. The key is a parameter and is never stored.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Collection
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

ROUNDS = 10
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
NUMBERS = re.compile(
    r"""(?<![\w.+@/-])(?=[+(\dA-Z])(?:
      (?P<iban>[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?)(?!\w)
    | (?P<date>(?:19|20)\d\d([-/.])\d{1,2}\3\d{1,2}|\d{1,2}([-/.])\d{1,2}\4(?:19|20)\d\d)(?![\d/-])
    | (?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?!\.?\d)
    | (?P<ssn>\d{3}-\d\d-\d{4})(?![\d-])
    | (?P<card>\d(?:[ -]?\d){12,}+)
    | (?P<phone>\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|1(?:[ .-]\d{3}[ .-]|[ .-]?\(\d{3}\)[ .-]?)\d{3}[ .-]\d{4}|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ ]?\d{3}[-. ]\d{4}|\d{3}[-.]\d{3}[-.]\d{4})(?!\d|[.-]\d)
    )""",
    re.X,
)
#: No value in a run of digit groups has more characters.
REACH = 60
#: What stands between the cards of a run of digit groups.
BESIDE = re.compile(re.sub(r"\n.*\(\?P<card>.*", "", NUMBERS.pattern), re.X)
EMAIL = re.compile(r"(?<![\w.+%-])(?P<email>[\w.+%-]{1,64}@(?:[\w-]{1,63}\.){1,8}[^\W\d_]{2,24})(?!\w)")
SECRET = re.compile(r"""(?i:\b(?:api[_-]?key|access[_-]?key|key|token|secret|passw(?:or)?d|pwd))["']?\s{0,3}[:=]\s{0,3}["']?(?P<secret>[A-Za-z0-9]{16,128})(?![A-Za-z0-9])""")
#: Characters without which a text holds nothing for a pattern.
NEEDS = ((EMAIL, re.compile("@")), (SECRET, re.compile("[:=]")), (NUMBERS, re.compile(r"\d")))


class Feistel:
    """A keyed permutation of the whole numbers below any size, for each kind of value."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, kind: str, n: int, i: int, half: int, bits: int) -> int:
        data = f"{kind}|{n}|{i}|{half}".encode()
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=64).digest(), "big") & ((1 << bits) - 1)

    def _walk(self, kind: str, x: int, n: int, back: bool) -> int:
        if n < 2:
            return x
        bits = max(1, ((n - 1).bit_length() + 1) // 2)
        mask = (1 << bits) - 1
        while True:
            left, right = x >> bits, x & mask
            for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if back:
                    left, right = right ^ self._round(kind, n, i, left, bits), left
                else:
                    left, right = right, left ^ self._round(kind, n, i, right, bits)
            x = left << bits | right
            if x < n:
                return x

    def __call__(self, kind: str, x: int, n: int, back: bool = False) -> int:
        return self._walk(kind, x, n, back)


def luhn(digits: str) -> int:
    """Sum of Luhn; 0 mod 10 for a valid number."""
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))


def _fill(pattern: str, digits: str) -> str:
    """Puts digits in the places of the pattern's digits."""
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in pattern)


#: All kinds of values.
KINDS = ("card", "iban", "phone", "ssn", "ip", "date", "email", "secret")


class Pseudonyms:
    def __init__(self, key: bytes, kinds: Collection[str] = KINDS):
        unknown = set(kinds) - set(KINDS)
        if unknown:
            raise ValueError(f"no such kinds of values: {', '.join(sorted(unknown))}")
        self.kinds = frozenset(kinds)
        self.permute = Feistel(key)
        self.known: dict[tuple[str, str, bool], str | None] = {}

    def value(self, kind: str, text: str, back: bool = False) -> str | None:
        """The pseudonym, or None if the value isn't valid."""
        at = (kind, text, back)
        if kind not in self.kinds:
            return None
        if at not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[at] = getattr(self, f"_{kind}")(text, back)
        return self.known[at]

    def _digits(self, kind: str, digits: str, back: bool) -> str:
        n = 10 ** len(digits)
        return str(self.permute(f"{kind}{len(digits)}", int(digits), n, back)).zfill(len(digits)) if digits else ""

    def _card(self, text: str, back: bool) -> str | None:
        digits = re.sub(r"\D", "", text)
        if luhn(digits) % 10 or len(set(digits)) == 1:
            return None
        body = digits[0] + self._digits("card" + digits[0], digits[1:-1], back)
        return _fill(text, body + str(-luhn(body + "0") % 10))

    def _iban(self, text: str, back: bool) -> str | None:
        plain = text.replace(" ", "")
        number = lambda s: int("".join(str(int(c, 36)) for c in s))
        if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
            return None
        body = plain[4:]
        own = _fill(body, self._digits("iban" + plain[:2], re.sub(r"\D", "", body), back))
        new = iter(f"{plain[:2]}{98 - number(own + plain[:2] + '00') % 97:02d}{own}")
        return "".join(c if c == " " else next(new) for c in text)

    def _phone(self, text: str, back: bool) -> str | None:
        digits = re.sub(r"\D", "", text)
        if not 9 <= len(digits) <= 15:
            return None
        country = 0
        if text.startswith("+"):
            country = len(re.match(r"\+(1(?=\D|\d{10}$)|7(?=\D|\d{10}$)|\d{1,3})", text)[1])
        elif len(digits) == 11 and digits[0] == "1":
            country = 1
        return _fill(text, digits[:country] + self._digits("phone" + digits[:country], digits[country:], back))

    def _ssn(self, text: str, back: bool) -> str | None:
        area, group, serial = map(int, text.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        x = self.permute("ssn", x, 898 * 99 * 9999, back)
        area, group, serial = x // (99 * 9999) + 1, x // 9999 % 99 + 1, x % 9999 + 1
        return f"{area + (area >= 666):03d}-{group:02d}-{serial:04d}"

    def _ip(self, text: str, back: bool) -> str | None:
        octets = text.split(".")
        if any(int(o) > 255 or len(o) > 1 and o[0] == "0" for o in octets):
            return None
        x = self.permute("ip", int.from_bytes(bytes(map(int, octets)), "big"), 1 << 32, back)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def _date(self, text: str, back: bool) -> str | None:
        a, mark, b, _, c = re.fullmatch(r"(\d+)([-/.])(\d+)([-/.])(\d+)", text).groups()
        wide = min(map(len, (a, b, c))) > 1
        orders = [("ymd", (a, b, c))] if len(a) == 4 else [("dmy", (c, b, a)), ("mdy", (c, a, b))]
        for order, (y, m, d) in orders:
            try:
                day = date(int(y), int(m), int(d)).toordinal()
            except ValueError:
                continue
            # walks on inside the dates that this format writes: month first only if no day-first reading exists, unpadded only if some part is short
            n = LAST_DAY - FIRST_DAY + 1
            x = day - FIRST_DAY
            while True:
                x = self.permute(f"date {order} {wide}", x, n, back)
                new = date.fromordinal(FIRST_DAY + x)
                if (order != "mdy" or new.day > 12) and (wide or new.month < 10 or new.day < 10):
                    break
            two = (lambda v: f"{v:02d}") if wide else str
            parts = {"y": f"{new.year:04d}", "m": two(new.month), "d": two(new.day)}
            return mark.join(parts[k] for k in order)
        return None

    def _email(self, text: str, back: bool) -> str | None:
        local, _, domain = text.partition("@")
        return self._characters("email", local, back) + "@" + domain

    def _secret(self, text: str, back: bool) -> str | None:
        if not any(c.isdigit() for c in text):
            return None
        return self._characters("secret", text, back)

    def _characters(self, kind: str, text: str, back: bool) -> str:
        """Permutes ASCII letters and digits, each among its own class; hexadecimal text stays hexadecimal."""
        hexed = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text) and kind == "secret"
        classes = [("0123456789abcdef",)] if hexed and not re.search("[A-F]", text) else [("0123456789ABCDEF",)] if hexed else [("0123456789",), ("abcdefghijklmnopqrstuvwxyz",), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ",)]
        of = {c: k for (k,) in classes for c in k}
        x, n = 0, 1
        for c in text:
            if c in of:
                x, n = x * len(of[c]) + of[c].index(c), n * len(of[c])
        x = self.permute(f"{kind} {''.join(str(len(of[c])) + '.' for c in text if c in of)}", x, n, back)
        out = []
        for c in reversed(text):
            if c in of:
                x, r = divmod(x, len(of[c]))
                out.append(of[c][r])
            else:
                out.append(c)
        return "".join(reversed(out))

    def _cards(self, run: str, after: str) -> list[tuple[int, int, str]]:
        """The cards in a run of digit groups: from the left, the longest valid span of whole groups; ``after`` follows the run."""
        groups = [m.span() for m in re.finditer(r"\d+", run)]
        found, i = [], 0
        while i < len(groups):
            lo, ends, size = groups[i][0], [], 0
            for j in range(i, len(groups)):
                size += groups[j][1] - groups[j][0]
                if size > 19:
                    break
                if size > 12:
                    ends.append(j)
            for j in reversed(ends):
                hi = groups[j][1]
                # beside a hyphen only what is itself separated in one way, and nothing at the run's end
                apart = run[:lo][-1:] != "-" and (run + after)[hi : hi + 1] != "-"
                alike = len(set(re.sub(r"\d", "", run[lo:hi]))) < 2 and not (hi == len(run) and after[:1] == "-")
                if (apart or alike) and self.value("card", run[lo:hi]):
                    found.append((lo, hi, "card"))
                    i = j
                    break
            i += 1
        return found

    def _read(self, run: str, after: str) -> list[tuple[int, int, str]]:
        """All values in a run of digit groups."""
        cards = self._cards(run, after)
        found, at = list(cards), 0
        for lo, hi, _ in [*cards, (len(run), 0, "")]:
            for m in BESIDE.finditer(run + after if lo == len(run) else run, at, len(run + after) if lo == len(run) else lo):
                kind = next(k for k in ("iban", "date", "ip", "ssn", "phone") if m[k])
                if m.end(kind) <= lo and self.value(kind, m[kind]) is not None:
                    found.append((*m.span(kind), kind))
            at = hi
        return sorted(found)

    def _run(self, run: str, after: str, back: bool) -> list[tuple[int, int, str, str]]:
        """The values in a run of digit groups with their pseudonyms; the run with pseudonyms reads as the run itself."""
        spans = self._read(run, after)
        starts, ends, new = [x[0] for x in spans], [x[1] for x in spans], list(run)
        # one by one and backwards in the other order, so that each has the same neighbours both ways
        for lo, hi, kind in reversed(spans) if back else spans:
            # what is read farther away than the longest value doesn't depend on this one
            i, j = bisect.bisect_right(ends, lo - REACH), bisect.bisect_left(starts, hi + REACH)
            a, b = ends[i - 1] if i else 0, starts[j] if j < len(starts) else len(run)
            near, rest = [(x - a, y - a, k) for x, y, k in spans[i:j]], "".join(new[b : b + REACH]) + (after if b + REACH > len(run) else "")
            value = "".join(new[lo:hi])
            while True:
                value = self.value(kind, value, back)
                new[lo:hi] = value
                if self._read("".join(new[a:b]), rest) == near:
                    break
        return [(lo, hi, kind, "".join(new[lo:hi])) for lo, hi, kind in spans]

    def text(self, text: str, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and (kind, start, end) of each in it, in code points."""
        spans: list[tuple[int, int, str]] = []
        for pattern, need in NEEDS:
            if need.search(text):
                for m in pattern.finditer(text):
                    kind = m.lastgroup if pattern is not NUMBERS else next(k for k in ("iban", "date", "ip", "ssn", "card", "phone") if m[k])
                    spans.append((*m.span(kind), kind))
        if not spans:
            return text, []
        out, found, at, size = [], [], 0, 0
        for lo, hi, kind in sorted(spans):
            if lo < at:
                continue
            if kind == "card":
                values = [(lo + a, lo + b, k, new) for a, b, k, new in self._run(text[lo:hi], text[hi : hi + 2], back)]
            else:
                values = [(lo, hi, kind, self.value(kind, text[lo:hi], back))]
            for a, b, k, new in values:
                if new is not None:
                    out += [text[at:a], new]
                    size += a - at
                    found.append((k, size, size + len(new)))
                    size += len(new)
                    at = b
        out.append(text[at:])
        return "".join(out), found


PII = T.StructField("pii", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))


def pseudonymise(docs: DataFrame, key: bytes, *, text: str = "text", kinds: Collection[str] = KINDS, back: bool = False) -> DataFrame:
    """The rows with their text under pseudonyms and ``pii``, the kind and span of each value of ``kinds``. With ``back`` the other way round."""
    from pyspark.sql.pandas.types import to_arrow_type

    from .common import slices, small_batches

    docs = small_batches(docs).drop("pii") if text != "pii" else small_batches(docs)
    names = docs.columns
    at = names.index(text)
    kind = to_arrow_type(PII.dataType)

    def run(batches):
        made = Pseudonyms(key, kinds)
        for batch in batches:
            for start, texts in slices(batch, text):
                done = [made.text(t, back) for t in texts]
                own = [c.slice(start, len(texts)) for c in batch.columns]
                null = own[at].is_null().to_pylist()
                own[at] = pa.array([None if no else t for no, (t, _) in zip(null, done)], pa.string())
                yield pa.RecordBatch.from_arrays([*own, pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in f] for _, f in done], kind)], names=[*names, "pii"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, PII]))


def recover(docs: DataFrame, key: bytes, *, text: str = "text", kinds: Collection[str] = KINDS) -> DataFrame:
    """Gives the values behind the pseudonyms of ``pseudonymise`` back."""
    return pseudonymise(docs, key, text=text, kinds=kinds, back=True)

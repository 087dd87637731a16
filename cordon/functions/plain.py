"""The detectors in plain Python: Arrow batches of texts, streams' state functions and single strings run these.

`operators.detectors` has the same patterns and rules as Columns; the tests hold the two against each other.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from dataclasses import dataclass, field

from . import values as V

_RE = {k: re.compile(p, re.A) for k, p in V.PATTERNS.items()}
_GATES = {k: re.compile(p, re.A) for k, p in V.GATES.items()}
_ANY = re.compile(V.ANY, re.A)
_STRIP = re.compile(r"[^0-9A-Za-z<]")
_DIGITS = re.compile(r"[^0-9]")


@dataclass(frozen=True)
class Allow:
    """Values that are never findings: e-mail addresses and domains (by case-insensitive match), phone numbers (by digits)."""

    emails: tuple[str, ...] = ()
    domains: tuple[str, ...] = ()
    phones: tuple[str, ...] = ()


def luhn(d: str) -> bool:
    twice = [int(c) * 2 for c in d[-2::-2]]
    return (sum(map(int, d[-1::-2])) + sum(t - 9 if t > 9 else t for t in twice)) % 10 == 0


def card(d: str) -> bool:
    n, (p2, p3, p4) = len(d), (int(d[:k]) for k in (2, 3, 4))
    known = (
        (d[0] == "4" and n in (13, 16, 19))
        or (n == 16 and (51 <= p2 <= 55 or 2221 <= p4 <= 2720))
        or (n == 15 and p2 in (34, 37))
        or (16 <= n <= 19 and (3528 <= p4 <= 3589 or p4 == 6011 or p2 in (62, 65) or 644 <= p3 <= 649))
        or (14 <= n <= 19 and (p2 in (36, 38, 39) or 300 <= p3 <= 305))
    )
    return known and luhn(d)


def iban(s: str) -> bool:
    return s[2:4].isdigit() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def us_ssn(d: str) -> bool:
    return int(d[:3]) not in (0, 666) and int(d[:3]) < 900 and int(d[3:5]) != 0 and int(d[5:]) != 0


def de_steuer_id(d: str) -> bool:
    often = [n for n in map(d[:10].count, "0123456789") if n > 1]
    if len(d) != 11 or d[0] == "0" or len(often) != 1 or often[0] > 3:
        return False
    p = 10
    for c in d[:10]:
        p = ((int(c) + p) % 10 or 10) * 2 % 11
    return (11 - p) % 10 == int(d[10])


def fr_nir(s: str, corsica: str = "double") -> bool:
    n = s[:13].replace("2A", "19").replace("2B", "18")
    if not n.isdigit() or not s[13:].isdigit():
        return False
    less = {"2A": 1_000_000, "2B": 2_000_000}.get(s[5:7], 0) if corsica == "double" else 0
    return 97 - (int(n) - less) % 97 == int(s[13:])


def es_dni_nie(s: str) -> bool:
    d = s[:-1].replace("X", "0").replace("Y", "1").replace("Z", "2")
    return len(d) == 8 and d.isdigit() and V.DNI_LETTERS[int(d) % 23] == s[-1]


def it_codice_fiscale(s: str) -> bool:
    at = [int(c) if c.isdigit() else ord(c) - 65 for c in s[:15]]
    return ord(s[15]) - 65 == (sum(V.CODICE_ODD[v] for v in at[::2]) + sum(at[1::2])) % 26


def nl_bsn(d: str) -> bool:
    return d != "000000000" and (sum((9 - i) * int(c) for i, c in enumerate(d[:8])) - int(d[8])) % 11 == 0


def _mrz(data: str, digit: str) -> bool:
    return digit.isdigit() and sum((0 if c == "<" else int(c, 36)) * V.MRZ_WEIGHTS[i % 3] for i, c in enumerate(data)) % 10 == int(digit)


def passport_mrz(s: str) -> bool:
    return len(s) == 44 and _mrz(s[:9], s[9]) and _mrz(s[13:19], s[19]) and _mrz(s[21:27], s[27]) and _mrz(s[:10] + s[13:20] + s[21:43], s[43])


def email_allowed(email: str, allow: Allow) -> bool:
    email = email.lower()
    domain = email.rpartition("@")[2]
    tld = domain.rpartition(".")[2]
    under = [*V.RESERVED_DOMAINS, *(d.lower() for d in allow.domains)]
    return (
        email in V.CODE_HOST_ADDRESSES
        or tld in V.FILE_EXTENSIONS
        or tld in V.RESERVED_TLDS
        or any(domain == d or domain.endswith("." + d) for d in under)
        or email in [e.lower() for e in allow.emails]
    )


def phone_valid(kind: str, match: str, allow: Allow) -> bool:
    d = _DIGITS.sub("", match)
    if d in [_DIGITS.sub("", p) for p in allow.phones]:
        return False
    if kind == "phone_intl":
        return 8 <= len(d) <= 15
    if kind == "phone_nanp":
        return d[0] >= "2" and d[3] >= "2" and d[3:8] != "55501" and d[:3] not in V.TOLL_FREE
    return 10 <= len(d) <= 11


def iban_prefix(match: str) -> int | None:
    """Characters of the match up to the length of the country's IBANs, if they are a valid one."""
    n, seen = V.IBAN_LENGTH_OF.get(match[:2]), 0
    for i, c in enumerate(match):
        seen += c != " "
        if seen == n:
            return i + 1 if iban(match[: i + 1].replace(" ", "")) else None
    return None


def _gate(kind: str, text: str, start: int) -> bool:
    raw = text[max(0, start - V.GATE_BYTES) : start].encode("utf-8", "surrogatepass")
    at = max(0, len(raw) - V.GATE_BYTES)
    while at > 0 and raw[at] & 0xC0 == 0x80:
        at -= 1
    return bool(_GATES[kind].search(raw[at:].decode("utf-8", "surrogatepass")))


@dataclass
class Detectors:
    allow: Allow = field(default_factory=Allow)
    #: Names and patterns of further identifiers, category employee_ref.
    custom: dict[str, str] = field(default_factory=dict)
    corsica: str = "double"
    #: Built-in detectors to run; all of them for None.
    only: tuple[str, ...] | None = None

    def __post_init__(self):
        self._custom = {k: re.compile(p) for k, p in sorted(self.custom.items())}
        self._kinds = [(i, k, p) for i, (k, p) in enumerate(_RE.items()) if self.only is None or k in self.only]

    def scan(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, id, category) in characters of the shadow text, by start and end."""
        return [m[:4] for m in self.matches(text)]

    def matches(self, text: str) -> list[tuple[int, int, str, str, int]]:
        """The same with the place of the detector among all, which orders equal ones.

        No built-in pattern matches a line feed, so only lines that may hold an identifier are searched.
        """
        out, at = [], 0
        while m := _ANY.search(text, at):
            lo, hi = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
            at = hi = len(text) if hi < 0 else hi
            self._line(text, lo, hi, out)
        for i, (name, pattern) in enumerate(self._custom.items()):
            out += [(m.start(), m.end(), name, "employee_ref", len(_RE) + i) for m in pattern.finditer(text) if m.end() > m.start()]
        return sorted(out, key=lambda d: (d[0], d[1], d[4]))

    def _line(self, text: str, lo: int, hi: int, out: list) -> None:
        for i, kind, pattern in self._kinds:
            for m in pattern.finditer(text, lo, hi):
                end, s = m.end(), _STRIP.sub("", m[0])
                if kind == "email":
                    ok = not email_allowed(m[0], self.allow)
                elif kind.startswith("phone"):
                    ok = phone_valid(kind, m[0], self.allow)
                elif kind == "payment_card":
                    ok = card(s) and s not in V.TEST_CARDS
                elif kind == "iban":
                    n = iban_prefix(m[0])
                    ok, end = n is not None, m.start() + (n or 0)
                elif kind == "us_ssn":
                    ok = m[2] == m[4] and us_ssn(s) and s not in V.EXAMPLE_SSNS
                elif kind == "uk_nino":
                    ok = s[:2] not in V.NINO_NOT_USED
                elif kind == "fr_nir":
                    ok = fr_nir(s, self.corsica)
                elif kind in V.GATES:
                    ok = _gate(kind, text, m.start()) and globals()[kind](s)
                else:
                    ok = globals()[kind](s)
                if ok:
                    out.append((m.start(), end, V.IDS[kind], V.CATEGORY_OF[kind], i))


def fingerprint(key: bytes, match: str) -> str:
    return hmac.new(key, match.encode("utf-8", "surrogatepass"), hashlib.sha256).hexdigest()

"""Identifiers whose check digits are reckoned here, apart from the library, and texts to put them in."""

import random
import string

VOWELS, OTHERS = "aeiou", "bdfgklmnprstv"
_CODICE = dict(zip("0123456789", (1, 0, 5, 7, 9, 13, 15, 17, 19, 21)))
_CODICE |= dict(zip(string.ascii_uppercase, (1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23)))


def digits(r, n, first="0123456789"):
    return r.choice(first) + "".join(r.choice("0123456789") for _ in range(n - 1))


def word(r):
    return "".join(r.choice(OTHERS) + r.choice(VOWELS) for _ in range(r.randint(1, 4)))


def prose(r, chars):
    """Sentences of invented words, some with accents, and no digits; exactly so many characters."""
    out = ""
    while len(out) < chars:
        s = " ".join(word(r) for _ in range(r.randint(3, 12))).capitalize()
        if r.random() < 0.3:
            s = s.replace("o", "ö", 1).replace("e", "é", 1)
        out += s + r.choice([". ", "! ", "; ", ".\n", " — "])
    return out[:chars]


def _last_digit(rule, body):
    return next(body + d for d in "0123456789" if rule(body + d))


def _ten(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        total += int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10))
    return total % 10 == 0


def card(r):
    head = r.choice(["4", "53", "6011", "3530"])
    return _last_digit(_ten, head + digits(r, 15 - len(head)))


def iban(r):
    country, n = r.choice([("DE", 18), ("ES", 20), ("PL", 24), ("BE", 12)])
    body = digits(r, n)
    as_number = int(body + "".join(str(ord(c) - 55) for c in country) + "00")
    return f"{country}{98 - as_number % 97:02d}{body}"


def ssn(r):
    return f"{r.choice([1, 2, 3, 5]) * 100 + r.randint(11, 99)}{r.randint(11, 98)}{r.randint(1001, 9899)}"


def nino(r):
    return r.choice(["JG", "LS", "PX", "WE"]) + digits(r, 6) + r.choice("ABCD")


def steuer(r):
    while True:
        ten = [*r.sample("0123456789", 9)]
        ten.insert(r.randrange(10), r.choice(ten))
        if ten[0] != "0":
            break
    carry = 10
    for c in ten:
        s = (int(c) + carry) % 10
        carry = 2 * (s if s else 10) % 11
    return "".join(ten) + str((11 - carry) % 10)


def nir(r):
    body = r.choice("12") + f"{r.randint(30, 99):02d}{r.randint(1, 12):02d}{r.randint(21, 95):02d}{r.randint(1, 990):03d}{r.randint(1, 999):03d}"
    return f"{body}{97 - int(body) % 97:02d}"


def dni(r):
    n = digits(r, 8)
    return n + "TRWAGMYFPDXBNJZSQVHLCKE"[int(n) % 23]


def codice(r):
    letters = lambda n: "".join(r.choice(string.ascii_uppercase) for _ in range(n))
    body = f"{letters(6)}{r.randint(10, 99)}{r.choice('ABCDEHLMPRST')}{r.randint(10, 28)}{letters(1)}{r.randint(100, 999)}"
    even = {c: i for chars in (string.digits, string.ascii_uppercase) for i, c in enumerate(chars)}
    total = sum(_CODICE[c] if i % 2 == 0 else even[c] for i, c in enumerate(body))
    return body + string.ascii_uppercase[total % 26]


def bsn(r):
    while True:
        body = digits(r, 8, "123456789")
        rest = sum(int(c) * w for c, w in zip(body, range(9, 1, -1))) % 11
        if rest < 10:
            return body + str(rest)


def _mrz_digit(s):
    return str(sum((0 if c == "<" else int(c) if c.isdigit() else ord(c) - 55) * (7, 3, 1)[i % 3] for i, c in enumerate(s)) % 10)


def mrz(r):
    number, born, ends = r.choice("CFGHX") + digits(r, 8), f"{r.randint(40, 99)}{r.randint(10, 12)}{r.randint(10, 28)}", f"{r.randint(30, 40)}{r.randint(10, 12)}{r.randint(10, 28)}"
    own = digits(r, 9) + "<" * 5
    parts = [x + _mrz_digit(x) for x in (number, born, ends, own)]
    return parts[0] + "NLD" + parts[1] + "F" + parts[2] + parts[3] + _mrz_digit("".join(parts))


def grouped(s, *sizes, by=" "):
    out = []
    for n in sizes:
        out.append(s[:n])
        s = s[n:]
    return by.join([x for x in [*out, s] if x])


#: detector: how to write a new identifier of it, and its number without separators.
MAKERS = {
    "payment_card": card,
    "iban": iban,
    "us_ssn": ssn,
    "uk_nino": nino,
    "de_steuer_id": steuer,
    "fr_nir": nir,
    "es_dni_nie": dni,
    "it_codice_fiscale": codice,
    "nl_bsn": bsn,
    "passport_mrz": mrz,
}
WRITTEN = {
    "payment_card": lambda s: grouped(s, 4, 4, 4),
    "iban": lambda s: grouped(s, 4, 4, 4, 4, 4, 4, 4),
    "us_ssn": lambda s: grouped(s, 3, 2, by="-"),
    "uk_nino": lambda s: grouped(s, 2, 2, 2, 2),
    "de_steuer_id": lambda s: grouped(s, 2, 3, 3),
    "fr_nir": lambda s: grouped(s, 1, 2, 2, 2, 3, 3),
}
#: Words that these detectors ask for.
ASKED = {"de_steuer_id": "tax id ", "nl_bsn": "burgerservicenummer "}


def contact(r):
    """An e-mail address or phone number that nothing allows."""
    return r.choice(
        [
            f"{word(r)}.{word(r)}@{word(r)}{word(r)}.io",
            f"+{r.randint(30, 49)} {digits(r, 2, '2345')} {digits(r, 4)} {digits(r, 4)}",
            f"({r.randint(212, 789)}) {r.randint(600, 788)}-{digits(r, 4)}",
            f"0{digits(r, 3, '2345')} {digits(r, 4)} {digits(r, 3)}",
        ]
    )


def identifier(r, kind=None):
    """(detector id, lead word, text) of a new identifier."""
    kind = kind or r.choice([*MAKERS, "contact"])
    if kind == "contact":
        own = contact(r)
        return "email" if "@" in own else "phone", "", own
    plain = MAKERS[kind](r)
    return kind, ASKED.get(kind, ""), WRITTEN.get(kind, str)(plain) if r.random() < 0.7 else plain if kind != "us_ssn" else grouped(plain, 3, 2)


def disguised(s, how):
    """The same identifier: with invisible characters, in wide characters, with other dashes, or with bracketed signs."""
    if how == "hidden":
        return "⁠".join(s)
    if how == "wide":
        return "".join(chr(0xFF00 + ord(c) - 0x20) if "!" <= c <= "~" else c for c in s)
    if how == "dashes":
        return s.replace("-", "‑")
    if how == "signs":
        return s.replace("@", "(At)").replace(".io", "[DOT]io")
    return s


DISGUISES = ["none", "hidden", "wide", "dashes", "signs"]


def changed(r, s, at=None):
    """s with one digit raised or letter moved on by one."""
    at = len(s) - 1 if at is None else at
    c = s[at]
    new = str((int(c) + r.randint(1, 9)) % 10) if c.isdigit() else string.ascii_uppercase[(string.ascii_uppercase.index(c) + r.randint(1, 25)) % 26]
    return s[:at] + new + s[at + 1 :]


def rng(seed):
    return random.Random(seed)

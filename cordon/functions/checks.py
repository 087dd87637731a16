"""Check-digit and format validators as Columns over identifiers without separators. A null is not valid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V


def _at(s: Column, i: int) -> Column:
    """Digit i (from 0)."""
    return F.substring(s, i + 1, 1).cast("int")


def _chars(s: Column) -> Column:
    return F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.substring(s, i, F.lit(1))), lambda c: c != "")


def _value(c: Column) -> Column:
    """0-9 for digits, 10-35 for A-Z, 0 for <, null for others."""
    code = F.ascii(c)
    return F.when(code.between(48, 57), code - 48).when(code.between(65, 90), code - 55).when(c == "<", 0)


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def strip(s: Column) -> Column:
    """ASCII letters, digits and < alone."""
    return F.regexp_replace(s, "[^0-9A-Za-z<]", "")


def luhn(d: Column) -> Column:
    return _yes(d.rlike("^[0-9]+$") & F.call_function("luhn_check", d))


def card_issuer(d: Column) -> Column:
    n, p2, p3, p4 = F.length(d), *(F.substring(d, 1, k).cast("int") for k in (2, 3, 4))
    return _yes(
        ((F.substring(d, 1, 1) == "4") & n.isin(13, 16, 19))
        | ((p2.between(51, 55) | p4.between(2221, 2720)) & (n == 16))
        | (p2.isin(34, 37) & (n == 15))
        | (p4.between(3528, 3589) & n.between(16, 19))
        | ((p2.isin(36, 38, 39) | p3.between(300, 305)) & n.between(14, 19))
        | (((p4 == 6011) | p2.isin(62, 65) | p3.between(644, 649)) & n.between(16, 19))
    )


def card(d: Column) -> Column:
    return card_issuer(d) & luhn(d)


def iban_length(country: Column) -> Column:
    """The length of the country's IBANs; null for countries without."""
    table = F.create_map(*[F.lit(x) for kv in sorted(V.IBAN_LENGTH_OF.items()) for x in kv])
    return F.try_element_at(table, country)


def iban(s: Column) -> Column:
    moved = F.concat(F.substring(s, 5, 1000), F.substring(s, 1, 4))
    rest = F.aggregate(F.transform(_chars(moved), _value), F.lit(0), lambda r, v: F.when(v >= 10, r * 100 + v).otherwise(r * 10 + v) % 97)
    return _yes(s.rlike("^[0-9A-Z]{2}[0-9]{2}[0-9A-Z]+$") & (rest == 1))


def us_ssn(d: Column) -> Column:
    area, group, serial = F.substring(d, 1, 3).cast("int"), F.substring(d, 4, 2).cast("int"), F.substring(d, 6, 4).cast("int")
    return _yes((area != 0) & (area != 666) & (area < 900) & (group != 0) & (serial != 0))


def uk_nino(s: Column) -> Column:
    return _yes(~F.substring(s, 1, 2).isin(V.NINO_NOT_USED))


def de_steuer_id(d: Column) -> Column:
    head = F.substring(d, 1, 10)
    counts = [F.length(head) - F.length(F.replace(head, F.lit(str(k)), F.lit(""))) for k in range(10)]
    twice = sum((F.when(c > 1, 1).otherwise(0) for c in counts), F.lit(0))

    def step(p: Column, c: Column) -> Column:
        s = (c.cast("int") + p) % 10
        return F.when(s == 0, 20).otherwise(s * 2) % 11

    product = F.aggregate(_chars(head), F.lit(10), step)
    return _yes(d.rlike("^[1-9][0-9]{10}$") & (twice == 1) & (F.greatest(*counts) <= 3) & ((11 - product) % 10 == _at(d, 10)))


def fr_nir(s: Column, corsica: str = "double") -> Column:
    """corsica `double`: the department's correction is applied once in the digits and once more in the number;
    `official`: once, as the numbers in use have it."""
    body, key, dep = F.substring(s, 1, 13), F.substring(s, 14, 2).cast("long"), F.substring(s, 6, 2)
    n = F.replace(F.replace(body, F.lit("2A"), F.lit("19")), F.lit("2B"), F.lit("18"))
    n = F.when(n.rlike("^[0-9]+$"), n.cast("long"))
    if corsica == "double":
        n = n - F.when(dep == "2A", 1_000_000).when(dep == "2B", 2_000_000).otherwise(0)
    return _yes((F.length(s) == 15) & s.rlike("[0-9]{2}$") & (97 - n % 97 == key))


def es_dni_nie(s: Column) -> Column:
    first = F.substring(s, 1, 1)
    digits = F.concat(F.when(first == "X", "0").when(first == "Y", "1").when(first == "Z", "2").otherwise(""), F.regexp_replace(s, "^[XYZ]|[A-Z]$", ""))
    n = F.when(digits.rlike("^[0-9]{8}$"), digits.cast("int"))
    return _yes(s.rlike("[A-Z]$") & (F.substring(F.lit(V.DNI_LETTERS), n % 23 + 1, F.lit(1)) == F.substring(s, -1, 1)))


def it_codice_fiscale(s: Column) -> Column:
    odd = F.array(*[F.lit(x) for x in V.CODICE_ODD])
    index = F.transform(_chars(F.substring(s, 1, 15)), lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 65))
    total = F.aggregate(F.transform(index, lambda v, i: F.when(i % 2 == 0, F.get(odd, v)).otherwise(v)), F.lit(0), lambda a, v: a + v)
    return _yes(s.rlike("^[0-9A-Z]{16}$") & (F.ascii(F.substring(s, 16, 1)) == 65 + total % 26))


def nl_bsn(d: Column) -> Column:
    total = sum(((9 - i) * _at(d, i) for i in range(8)), F.lit(0)) - _at(d, 8)
    return _yes(d.rlike("^[0-9]{9}$") & (d != "000000000") & (total % 11 == 0))


def mrz_check(data: Column, digit: Column) -> Column:
    weights = F.array(*[F.lit(w) for w in V.MRZ_WEIGHTS])
    total = F.aggregate(F.transform(_chars(data), lambda c, i: _value(c) * F.get(weights, i % 3)), F.lit(0), lambda a, v: a + v)
    return _yes(digit.rlike("^[0-9]$") & (total % 10 == digit.cast("int")))


def passport_mrz(s: Column) -> Column:
    part = lambda a, b: F.substring(s, a + 1, b - a)
    whole = F.concat(part(0, 10), part(13, 20), part(21, 43))
    return _yes((F.length(s) == 44) & mrz_check(part(0, 9), part(9, 10)) & mrz_check(part(13, 19), part(19, 20)) & mrz_check(part(21, 27), part(27, 28)) & mrz_check(whole, part(43, 44)))

"""Detectors: `scan` in one Arrow pass over texts, and the same as a plan of Columns.

In the plan pattern matches come with their positions, then check digits, gates and allowlists on those few rows.

Each pattern is matched once; only texts with a match are split for positions. Matches become rows before any
validator runs, so validators see candidates, not texts. Everything stays in the JVM.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks, plain
from ..functions import values as V
from ..functions.plain import Allow
from ..functions.shadow import needs_shadow, shadow, with_shadow
from ..plans.rules import checked_pattern

ANY = V.ANY
_DIGITS = "[^0-9]"


def may_hold(text: Column) -> Column:
    """May the text hold a built-in identifier? For a text that is its own shadow this says so; others are decided later."""
    return text.rlike(ANY) | needs_shadow(text)


def email_allowed(match: Column, allow: Allow) -> Column:
    email = F.lower(match)
    domain = F.substring_index(email, "@", -1)
    tld = F.substring_index(domain, ".", -1)
    under = [*V.RESERVED_DOMAINS, *(d.lower() for d in allow.domains)]
    out = email.isin([*V.CODE_HOST_ADDRESSES, *(e.lower() for e in allow.emails)]) | tld.isin([*V.FILE_EXTENSIONS, *V.RESERVED_TLDS])
    return out | F.exists(F.array(*[F.lit(d) for d in under]), lambda d: (domain == d) | F.endswith(domain, F.concat(F.lit("."), d)))


def phone_valid(kind: Column, match: Column, allow: Allow) -> Column:
    d = F.regexp_replace(match, _DIGITS, "")
    n, at = F.length(d), lambda i, k: F.substring(d, i + 1, k)
    nanp = (at(0, 1) >= "2") & (at(3, 1) >= "2") & (at(3, 5) != "55501") & ~at(0, 3).isin(V.TOLL_FREE)
    ok = F.when(kind == "phone_intl", n.between(8, 15)).when(kind == "phone_nanp", nanp).otherwise(n.between(10, 11))
    known = [re.sub(_DIGITS, "", p) for p in allow.phones]
    return ok & ~d.isin(known) if known else ok


def iban_prefix(match: Column) -> Column:
    """The part of the match up to the length of the country's IBANs, if it is a valid one; else null."""
    n = checks.iban_length(F.substring(match, 1, 2))
    part = F.regexp_substr(match, F.concat(F.lit("^(?: ?[A-Z0-9]){"), n.cast("string"), F.lit("}")))
    return F.when(checks.iban(F.replace(part, F.lit(" "), F.lit(""))), part)


def gate(kind: Column, before: Column) -> Column:
    """Is the detector's word in the 40 bytes before the match (and the rest of a character that these cut)?"""
    k = F.get(F.filter(F.sequence(F.lit(1), F.greatest(F.length(before), F.lit(1))), lambda k: F.octet_length(F.right(before, k)) >= V.GATE_BYTES), F.lit(0))
    near = F.when(k.isNull(), before).otherwise(F.right(before, k))
    out = F.lit(True)
    for name, pattern in V.GATES.items():
        out = F.when(kind == name, near.rlike(V.spelled_out(pattern))).otherwise(out)
    return out


def accepted(kind: Column, match: Column, s: Column, iban: Column, before: Column, allow: Allow, corsica: str = "double") -> Column:
    """Does the match pass its detector's rules? s is the match stripped, iban its valid prefix."""
    rules = {
        "email": ~email_allowed(match, allow),
        "payment_card": checks.card(s) & ~s.isin(V.TEST_CARDS),
        "iban": iban.isNotNull(),
        "us_ssn": (F.substring(match, 4, 1) == F.substring(match, 7, 1)) & checks.us_ssn(s) & ~s.isin(V.EXAMPLE_SSNS),
        "uk_nino": checks.uk_nino(s),
        "fr_nir": checks.fr_nir(s, corsica),
        "es_dni_nie": checks.es_dni_nie(s),
        "it_codice_fiscale": checks.it_codice_fiscale(s),
        "passport_mrz": checks.passport_mrz(s),
        "de_steuer_id": gate(kind, before) & checks.de_steuer_id(s),
        "nl_bsn": gate(kind, before) & checks.nl_bsn(s),
    }
    out = F.when(kind.startswith("phone"), phone_valid(kind, match, allow))
    for name, rule in rules.items():
        out = out.when(kind == name, rule)
    return F.coalesce(out.otherwise(True), F.lit(False))


def _positions(pieces: Column, matches: Column) -> Column:
    """Where each match starts: the lengths of all that stands before it."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    pairs = F.arrays_zip(pieces.alias("p"), matches.alias("m"))
    step = lambda a, x: F.struct((a.at + F.length(x.p) + F.length(x.m)).alias("at"), F.array_append(a.out, a.at + F.length(x.p)).alias("out"))
    return F.aggregate(F.slice(pairs, F.lit(1), F.size(matches)), start, step, lambda a: a.out)


def _lines(df: DataFrame) -> DataFrame:
    """df with one row for each line of __t that may hold a built-in identifier: __line and __start, its first character.

    No built-in pattern matches a line feed, so lines can be searched by themselves, and most drop out here.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    lines = F.split("__t", "\n", -1)
    places = F.aggregate(lines, start, lambda a, x: F.struct((a.at + F.length(x) + 1).alias("at"), F.array_append(a.out, a.at).alias("out")), lambda a: a.out)
    kept = F.filter(F.arrays_zip(lines.alias("line"), places.alias("start")), lambda x: x.line.rlike(ANY))
    out = df.where(F.col("__t").rlike(ANY)).withColumn("__l", F.explode(kept))
    return out.withColumns({"__line": F.col("__l.line"), "__start": F.col("__l.start")}).drop("__l")


def _hits(df: DataFrame, line: str, patterns: list[tuple[int, str, str]], names: list[str]) -> DataFrame:
    found = [F.struct(F.lit(k).alias("kind"), F.lit(i).alias("ord"), F.regexp_extract_all(line, F.lit(p), F.lit(0)).alias("m")) for i, k, p in patterns]
    out = df.withColumn("__k", F.explode(F.filter(F.array(*found), lambda x: F.size(x.m) > 0)))
    # positions only for the few lines and patterns with a match
    pattern = F.element_at(F.create_map(*[F.lit(x) for i, _, p in patterns for x in (i, p)]), F.col("__k.ord"))
    out = out.withColumn("__p", _positions(F.split(line, pattern, -1), F.col("__k.m")))
    out = out.withColumn("__hit", F.explode(F.arrays_zip(F.col("__p").alias("at"), F.col("__k.m").alias("match"))))
    at = F.col("__hit.at") + F.col("__start")
    return out.select(*names, "__t", F.col("__k.kind").alias("__kind"), F.col("__k.ord").alias("__ord"), at.alias("__at"), F.col("__hit.match").alias("__match")).where("__match <> ''")


def candidates(df: DataFrame, text: Column, detectors: list[str] | None = None, custom: dict[str, str] | None = None) -> DataFrame:
    """df with one row for each match: __kind, __ord, __at (character), __match, and __t, the text."""
    kinds = [(i, k, V.spelled_out(p)) for i, (k, p) in enumerate(V.PATTERNS.items()) if detectors is None or k in detectors]
    own = [(len(V.PATTERNS) + i, k, f"(?U){checked_pattern(k, p)}") for i, (k, p) in enumerate(sorted((custom or {}).items()))]
    names, base = df.columns, df.withColumn("__t", text)
    found = [_hits(_lines(base), "__line", kinds, names)] if kinds else []
    if own:
        found.append(_hits(base.withColumn("__start", F.lit(0)), "__t", own, names))
    return found[0].unionByName(found[1]) if len(found) > 1 else found[0]


def scan_columns(df: DataFrame, text: str = "text", detectors: list[str] | None = None, allow: Allow | None = None, custom: dict[str, str] | None = None, corsica: str = "double") -> DataFrame:
    """scan() by built-in expressions alone, but for the shadow of odd texts; slower, as the pattern engine is."""
    keep = [c for c in df.columns if c != text]
    found = detect(with_shadow(df.select(*keep, text).where(F.col(text).isNotNull()), text).drop(text), "__shadow", detectors, allow, custom, corsica)
    return found.select(*keep, "id", "category", "ord", "start", "end")


def detect(df: DataFrame, shadow: str, detectors: list[str] | None = None, allow: Allow | None = None, custom: dict[str, str] | None = None, corsica: str = "double") -> DataFrame:
    """df (with a struct column `shadow`) with one row for each detection, and without the text.

    New columns: id, category, ord (for ties), start and end in bytes of the original, __from and __to in
    characters of the shadow, __length of the shadow, __found (the match; not for outputs).
    """
    allow = allow or Allow()
    keep = [c for c in df.columns if c != shadow]
    rows = candidates(df.select(*keep, F.col(f"{shadow}.first").alias("__first"), F.col(f"{shadow}.end").alias("__end"), F.col(f"{shadow}.text").alias("__s")), F.col("__s"), detectors, custom)
    kind, match, at = F.col("__kind"), F.col("__match"), F.col("__at")
    before = F.substring("__t", F.greatest(at - (V.GATE_BYTES - 1), F.lit(1)), F.least(at, F.lit(V.GATE_BYTES)))
    # columns of their own, so that each is computed once
    rows = rows.withColumns({"__strip": checks.strip(match), "__iban": F.when(kind == "iban", iban_prefix(match)), "__before": before})
    rows = rows.where(accepted(kind, match, F.col("__strip"), F.col("__iban"), F.col("__before"), allow, corsica))
    found = F.coalesce("__iban", match)
    rows = rows.withColumn("__found", found).withColumn("__to", at + F.length("__found"))
    ids = {**V.IDS, **{k: k for k in (custom or {})}}
    categories = {**V.CATEGORY_OF, **dict.fromkeys(custom or {}, "employee_ref")}
    look = lambda table: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), kind)
    return rows.select(
        *keep,
        look(ids).alias("id"),
        look(categories).alias("category"),
        F.col("__ord").alias("ord"),
        F.coalesce(F.get("__first", at), F.octet_length(F.left("__t", at))).cast("long").alias("start"),
        F.coalesce(F.get("__end", F.col("__to") - 1), F.octet_length(F.left("__t", F.col("__to")))).cast("long").alias("end"),
        at.alias("__from"),
        "__to",
        F.length("__t").alias("__length"),
        "__found",
    )


_HITS = "array<struct<id:string,category:string,ord:int,start:bigint,`end`:bigint>>"


def scan(df: DataFrame, text: str = "text", detectors: list[str] | None = None, allow: Allow | None = None, custom: dict[str, str] | None = None, corsica: str = "double") -> DataFrame:
    """Detections in whole texts: df without the text, with id, category, start and end (bytes). Null texts have none.

    One Arrow pass, which sends back nothing but what it found; most lines drop out at its first search.
    """
    own = plain.Detectors(allow or Allow(), {k: checked_pattern(k, p) for k, p in (custom or {}).items()}, corsica, None if detectors is None else tuple(detectors))

    @F.pandas_udf(_HITS)
    def hits(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            s, first, end = shadow(t)
            # bytes before a character, where the shadow is the text
            at = (lambda n: n) if s.isascii() else lambda n: len(s[:n].encode("utf-8", "surrogatepass"))  # noqa: B023
            out.append([(k, c, i, first[a] if first else at(a), end[b - 1] if end else at(b)) for a, b, k, c, i in own.matches(s)])
        return pd.Series(out, dtype=object)

    keep = [c for c in df.columns if c != text]
    base = df.select(*keep, text).where(F.col(text).isNotNull())
    found = base.select(*keep, F.explode(hits(text)).alias("__hit"))
    return found.select(*keep, "__hit.*")

"""The same rules written as SQL for DuckDB, to hold the Spark queries against.

Patterns keep \\b and \\d here: that engine's are ASCII.
"""

from __future__ import annotations

from .functions import values as V


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(xs) -> str:
    return "(" + ", ".join(text(x) for x in xs) + ")"


def strip(s: str) -> str:
    return f"regexp_replace({s}, '[^0-9A-Za-z<]', '', 'g')"


def _chars(s: str) -> str:
    return f"list_transform(range(1, length({s}) + 1), lambda i: substr({s}, i, 1))"


def _value(c: str) -> str:
    return f"(CASE WHEN {c} BETWEEN '0' AND '9' THEN ascii({c}) - 48 WHEN {c} BETWEEN 'A' AND 'Z' THEN ascii({c}) - 55 WHEN {c} = '<' THEN 0 END)"


def luhn(d: str) -> str:
    x = f"TRY_CAST(substr(reverse({d}), i, 1) AS INT)"
    return f"(regexp_full_match({d}, '[0-9]+') AND list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {x} WHEN {x} > 4 THEN 2 * {x} - 9 ELSE 2 * {x} END)) % 10 = 0)"


def card_issuer(d: str) -> str:
    n, p2, p3, p4 = f"length({d})", *(f"TRY_CAST(substr({d}, 1, {k}) AS INT)" for k in (2, 3, 4))
    return (
        f"((substr({d}, 1, 1) = '4' AND {n} IN (13, 16, 19)) OR (({p2} BETWEEN 51 AND 55 OR {p4} BETWEEN 2221 AND 2720) AND {n} = 16) OR ({p2} IN (34, 37) AND {n} = 15)"
        f" OR ({p4} BETWEEN 3528 AND 3589 AND {n} BETWEEN 16 AND 19) OR (({p2} IN (36, 38, 39) OR {p3} BETWEEN 300 AND 305) AND {n} BETWEEN 14 AND 19)"
        f" OR (({p4} = 6011 OR {p2} IN (62, 65) OR {p3} BETWEEN 644 AND 649) AND {n} BETWEEN 16 AND 19))"
    )


def card(d: str) -> str:
    return f"({card_issuer(d)} AND {luhn(d)})"


def iban_length(cc: str) -> str:
    return "(CASE " + " ".join(f"WHEN {cc} IN {listed(cs.split())} THEN {n}" for n, cs in V.IBAN_LENGTHS.items()) + " END)"


def iban(s: str) -> str:
    moved = f"(substr({s}, 5) || substr({s}, 1, 4))"
    values = f"list_transform(range(1, length({s}) + 1), lambda i: {_value(f'substr({moved}, i, 1)')}::BIGINT)"
    rest = f"list_reduce(list_prepend(0::BIGINT, {values}), lambda r, v: CASE WHEN v >= 10 THEN r * 100 + v ELSE r * 10 + v END % 97)"
    return f"(coalesce(regexp_full_match({s}, '[0-9A-Z]{{2}}[0-9]{{2}}[0-9A-Z]+'), false) AND {rest} = 1)"


def us_ssn(d: str) -> str:
    a, g, s = (f"substr({d}, {i}, {n})::INT" for i, n in ((1, 3), (4, 2), (6, 4)))
    return f"({a} <> 0 AND {a} <> 666 AND {a} < 900 AND {g} <> 0 AND {s} <> 0)"


def uk_nino(s: str) -> str:
    return f"(substr({s}, 1, 2) NOT IN {listed(V.NINO_NOT_USED)})"


def de_steuer_id(d: str) -> str:
    head = f"substr({d}, 1, 10)"
    counts = "[" + ", ".join(f"length({head}) - length(replace({head}, '{k}', ''))" for k in range(10)) + "]"
    p = f"list_reduce(list_prepend(10, list_transform({_chars(head)}, lambda c: c::INT)), lambda p, c: (CASE WHEN (c + p) % 10 = 0 THEN 20 ELSE (c + p) % 10 * 2 END) % 11)"
    return f"(regexp_full_match({d}, '[1-9][0-9]{{10}}') AND len(list_filter({counts}, lambda n: n > 1)) = 1 AND list_max({counts}) <= 3 AND (11 - {p}) % 10 = substr({d}, 11, 1)::INT)"


def fr_nir(s: str) -> str:
    n = f"replace(replace(substr({s}, 1, 13), '2A', '19'), '2B', '18')"
    less = f"(CASE substr({s}, 6, 2) WHEN '2A' THEN 1000000 WHEN '2B' THEN 2000000 ELSE 0 END)"
    return f"(length({s}) = 15 AND coalesce(97 - (TRY_CAST({n} AS BIGINT) - {less}) % 97 = TRY_CAST(substr({s}, 14, 2) AS INT), false))"


def es_dni_nie(s: str) -> str:
    d = f"((CASE substr({s}, 1, 1) WHEN 'X' THEN '0' WHEN 'Y' THEN '1' WHEN 'Z' THEN '2' ELSE '' END) || regexp_replace({s}, '^[XYZ]|[A-Z]$', '', 'g'))"
    return f"(regexp_full_match({d}, '[0-9]{{8}}') AND coalesce(substr('{V.DNI_LETTERS}', TRY_CAST({d} AS INT) % 23 + 1, 1) = substr({s}, -1), false))"


def it_codice_fiscale(s: str) -> str:
    v = lambda i: f"(CASE WHEN substr({s}, {i}, 1) BETWEEN '0' AND '9' THEN ascii(substr({s}, {i}, 1)) - 48 ELSE ascii(substr({s}, {i}, 1)) - 65 END)"
    odd = str(V.CODICE_ODD)
    total = f"list_sum(list_transform(range(1, 16), lambda i: CASE WHEN i % 2 = 1 THEN ({odd})[{v('i')} + 1] ELSE {v('i')} END))"
    return f"(regexp_full_match({s}, '[0-9A-Z]{{16}}') AND ascii(substr({s}, 16, 1)) - 65 = {total} % 26)"


def nl_bsn(d: str) -> str:
    total = " + ".join(f"{9 - i} * TRY_CAST(substr({d}, {i + 1}, 1) AS INT)" for i in range(8)) + f" - TRY_CAST(substr({d}, 9, 1) AS INT)"
    return f"(regexp_full_match({d}, '[0-9]{{9}}') AND {d} <> '000000000' AND ({total}) % 11 = 0)"


def mrz_check(data: str, digit: str) -> str:
    total = f"list_sum(list_transform(range(1, length({data}) + 1), lambda i: {_value(f'substr({data}, i, 1)')} * ({V.MRZ_WEIGHTS})[(i - 1) % 3 + 1]))"
    return f"(regexp_full_match({digit}, '[0-9]') AND {total} % 10 = TRY_CAST({digit} AS INT))"


def passport_mrz(s: str) -> str:
    part = lambda a, b: f"substr({s}, {a + 1}, {b - a})"
    whole = f"({part(0, 10)} || {part(13, 20)} || {part(21, 43)})"
    return f"(length({s}) = 44 AND {mrz_check(part(0, 9), part(9, 10))} AND {mrz_check(part(13, 19), part(19, 20))} AND {mrz_check(part(21, 27), part(27, 28))} AND {mrz_check(whole, part(43, 44))})"


def email_allowed(m: str, domains=(), emails=()) -> str:
    e = f"lower({m})"
    d, tld = f"split_part({e}, '@', 2)", f"regexp_extract({e}, '[^.]*$')"
    under = " OR ".join(f"{d} = {text(x)} OR ends_with({d}, {text('.' + x)})" for x in [*V.RESERVED_DOMAINS, *domains])
    return f"({e} IN {listed([*V.CODE_HOST_ADDRESSES, *emails])} OR {tld} IN {listed([*V.FILE_EXTENSIONS, *V.RESERVED_TLDS])} OR {under})"


def phone_valid(kind: str, m: str, phones=()) -> str:
    d = f"regexp_replace({m}, '[^0-9]', '', 'g')"
    rule = {
        "phone_intl": f"length({d}) BETWEEN 8 AND 15",
        "phone_nanp": f"substr({d}, 1, 1) >= '2' AND substr({d}, 4, 1) >= '2' AND substr({d}, 4, 5) <> '55501' AND substr({d}, 1, 3) NOT IN {listed(V.TOLL_FREE)}",
        "phone_national": f"length({d}) BETWEEN 10 AND 11",
    }[kind]
    return f"({rule}" + (f" AND {d} NOT IN {listed(phones)})" if phones else ")")


def iban_prefix(m: str) -> str:
    """The valid prefix: as many characters as hold the country's length without spaces."""
    n = iban_length(f"substr({m}, 1, 2)")
    end = f"list_min(list_filter(range(1, length({m}) + 1), lambda k: length(replace(substr({m}, 1, k), ' ', '')) = {n}))"
    compact = f"substr(replace({m}, ' ', ''), 1, {n})"
    return f"(CASE WHEN {iban(compact)} THEN substr({m}, 1, {end}) END)"


def accepted(kind: str, m: str, t: str, start: str) -> str:
    s = strip(m)
    near = f"substr({t}, greatest(1, {start} - {V.GATE_BYTES} + 1), least({start}, {V.GATE_BYTES}))"
    gate = f"regexp_matches({near}, {text(V.GATES.get(kind, ''))}) AND "
    return {
        "email": lambda: f"NOT {email_allowed(m)}",
        "payment_card": lambda: f"{card(s)} AND {s} NOT IN {listed(V.TEST_CARDS)}",
        "iban": lambda: f"{iban_prefix(m)} IS NOT NULL",
        "us_ssn": lambda: f"substr({m}, 4, 1) = substr({m}, 7, 1) AND {us_ssn(s)} AND {s} NOT IN {listed(V.EXAMPLE_SSNS)}",
        "uk_nino": lambda: uk_nino(s),
        "fr_nir": lambda: fr_nir(s),
        "es_dni_nie": lambda: es_dni_nie(s),
        "it_codice_fiscale": lambda: it_codice_fiscale(s),
        "passport_mrz": lambda: passport_mrz(s),
        "de_steuer_id": lambda: gate + de_steuer_id(s),
        "nl_bsn": lambda: gate + nl_bsn(s),
    }.get(kind, lambda: phone_valid(kind, m))()


def detections(source: str, keys: str, kind: str, pattern: str | None = None, id_: str | None = None, category: str | None = None) -> str:
    """SELECT keys, id, category, ord, start, end (bytes), found, t for one detector over `source` (keys, t)."""
    p = text(pattern or V.PATTERNS[kind])
    ord_ = list(V.PATTERNS).index(kind) if kind in V.PATTERNS else len(V.PATTERNS)
    found = iban_prefix("match") if kind == "iban" else "match"
    rule = accepted(kind, "match", "t", "cpos") if kind in V.PATTERNS else "true"
    size = lambda xs, f: f"coalesce(list_sum(list_transform({xs}, lambda x: {f}(x))), 0)"
    return f"""SELECT {keys}, {text(id_ or V.IDS[kind])} AS id, {text(category or V.CATEGORY_OF[kind])} AS category, {ord_} AS ord, start::BIGINT AS "start", (start + strlen(found))::BIGINT AS "end", found, t
        FROM (SELECT *, {found} AS found FROM (
            SELECT {keys}, t, m[i] AS match, {size('g[1:i]', 'strlen')} + {size('m[1:i - 1]', 'strlen')} AS start, ({size('g[1:i]', 'length')})::BIGINT + ({size('m[1:i - 1]', 'length')})::BIGINT AS cpos
            FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT {keys}, t, regexp_extract_all(t, {p}) AS m, string_split_regex(t, {p}) AS g FROM {source} WHERE regexp_matches(t, {p}))))
        WHERE {rule})"""


def all_detections(source: str, keys: str) -> str:
    return " UNION ALL ".join(f"({detections(source, keys, k)})" for k in V.PATTERNS)


def windows(source: str, first_min=100, least=240, most=800, overlap=64) -> str:
    """Recursive CTEs `w` over source (doc_id, text), for ASCII texts that are their own shadow."""
    return f"""
        st AS (
            SELECT doc_id, text, 0 AS base, 0 AS checked, true AS first, -1 AS seg_no, 0 AS win_start, 0 AS cut, 0 AS release, length(text) = 0 AS is_last FROM {source}
            UNION ALL
            SELECT doc_id, text, base + rel, cut_ - rel, false, seg_no + 1, base, base + cut_, base + rel, last_ FROM (
                SELECT *, CASE WHEN last_ THEN cut_ WHEN cut_ <= {overlap} THEN 0 WHEN regexp_matches(near, '[ \\t\\n\\x0b\\x0c\\r]') THEN lo + length(regexp_extract(near, '(?s)^(.*)[ \\t\\n\\x0b\\x0c\\r]', 1)) ELSE cut_ - {overlap} END AS rel FROM (
                    SELECT *, greatest(0, cut_ - {overlap} - 32) AS lo, substr(buf, greatest(0, cut_ - {overlap} - 32) + 1, cut_ - {overlap} - greatest(0, cut_ - {overlap} - 32)) AS near FROM (
                        SELECT *, CASE WHEN n >= least_ AND hit AND at_ < least(n, limit_) THEN at_ + 1 WHEN n >= least_ AND n >= limit_ THEN limit_ ELSE n END AS cut_,
                               NOT (n >= least_ AND ((hit AND at_ < least(n, limit_)) OR n >= limit_)) AS last_ FROM (
                            SELECT *, from_ + length(regexp_extract(part, '(?s)^(.*?)(?:\\n|[.!?;][ \\t\\n\\f\\r])', 1)) AS at_, regexp_matches(part, '\\n|[.!?;][ \\t\\n\\f\\r]') AS hit FROM (
                                SELECT *, substr(buf, from_ + 1, limit_ - from_ + 1) AS part FROM (
                                    SELECT *, substr(text, base + 1) AS buf, length(text) - base AS n, CASE WHEN first THEN {first_min} ELSE {least} END AS least_,
                                           greatest((CASE WHEN first THEN {first_min} ELSE {least} END) - 1, checked) AS from_, greatest({most}, checked + 1) AS limit_
                                    FROM st WHERE NOT is_last AND length(text) > base))))))
        ),
        w AS (SELECT doc_id, seg_no, win_start, cut, release, is_last, substr(text, win_start + 1, cut - win_start) AS t FROM st WHERE seg_no >= 0)"""

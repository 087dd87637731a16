"""Queries over the tables, one for each operator, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql as S
from .functions import checks, shadow
from .functions import values as V
from .functions.plain import Allow
from .operators import detectors, guard, report
from .plans.rules import Policy, Rules, effective
from .sources import text as sources

Query = Callable[[SparkSession, str], DataFrame]
TEST_KEY = b"test key for the fingerprint query"

#: Identifiers in plain ASCII, one for each detector and some that are none; check digits by tests/made.py.
SAMPLES = [
    "kelu.raso@vomabi.io",
    "+31 24 5530 8816",
    "(415) 777-2040",
    "0453 2261 907",
    "6011 5333 1478 9326",
    "DE38 4072 3862 5511 8487 33 BY FRIDAY",
    "220-21-4279",
    "WE 98 11 35 A",
    "tax id 17 964 502 854",
    "1 81 10 88 254 225 82",
    "97626000Q",
    "PUBXLY65B18Q676L",
    "sofinummer 807124813",
    "C756900722NLD8810104F3310241167123431<<<<<64",
    "+1 (415) 777-2040",
    "badge E720416",
    "desk@deep.example.net or 4242 4242 4242 4242",
    "1 61 07 2B 512 340 50",
    "no identifier",
]
_FILLER = "Crews should stage the pallets before noon; check the straps. Report any near miss to the desk!\n"
_PICK = "CASE {k} % " + str(len(SAMPLES)) + " " + " ".join(f"WHEN {i} THEN {S.text(x)}" for i, x in enumerate(SAMPLES)) + " END"


def _picked(k: str) -> str:
    return _PICK.format(k=k)


def _repeated(n: int, cut: str) -> str:
    """Filler of `cut` characters; its line feed is written as chr(10), which both engines read alike."""
    return f"substr(repeat({S.text(_FILLER[:-1])} || chr(10), {n}), 1, CAST({cut} AS INT))"


#: doc_id, text: a note for each customer, ASCII alone, with one identifier at some place.
NOTES = f"{_repeated(20, '(c_custkey * 37) % 1500')} || ' [see ' || {_picked('c_custkey')} || ' there] ' || {_repeated(10, '(c_custkey * 11) % 700')}"
NOTES_SQL = f"notes AS (SELECT c_custkey AS doc_id, {NOTES} AS text FROM customer)"
#: doc_id, text: every document with an identifier behind it.
INJECTED = f"coalesce(text, '') || ' [see ' || {_picked('doc_id')} || ' there]'"
INJECTED_SQL = f"(SELECT doc_id, {INJECTED} AS t FROM documents)"
CUSTOM = {"badge": r"E[0-9]{6}", "order_no": r"ord-[a-z]+"}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # dealt out as keys, before there are texts
    return sources.spread(_read(spark, sf_dir, "customer").select("c_custkey")).selectExpr("c_custkey AS doc_id", f"{NOTES} AS text")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its whole text."""
    return sources.spread(_read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))


def _injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.spread(_read(spark, sf_dir, "documents").select("doc_id", "text")).selectExpr("doc_id", f"{INJECTED} AS text")


# --- validators over identifiers made from order keys

_K = "o_orderkey"
_PAD = lambda e, n: f"lpad(CAST({e} AS STRING), {n}, '0')"
IDENTIFIERS: dict[str, tuple[str, Callable[[Column], Column], Callable[[str], str]]] = {
    "val_luhn": (_PAD(f"{_K} * 7919", 16), checks.luhn, S.luhn),
    "val_card_issuer": (f"substr('4553364462379120', CAST({_K} % 14 AS INT) + 1, 2) || {_PAD(f'{_K} * 7919', 14)}", checks.card_issuer, S.card_issuer),
    "val_card": (f"substr('4553364462379120', CAST({_K} % 14 AS INT) + 1, 2) || {_PAD(f'{_K} * 7919', 14)}", checks.card, S.card),
    "val_iban_mod97": (f"CASE {_K} % 3 WHEN 0 THEN 'DE' WHEN 1 THEN 'GB' ELSE 'NO' END || {_PAD(f'{_K} % 100', 2)} || {_PAD(f'{_K} * 13', 18)}", checks.iban, S.iban),
    "val_us_ssn": (f"{_PAD(f'{_K} % 1000', 3)} || {_PAD(f'{_K} % 7', 2)} || {_PAD(f'{_K} % 11', 4)}", checks.us_ssn, S.us_ssn),
    "val_uk_nino": (f"substr('BGGBNKKNTNNTZZABCE', CAST({_K} % 9 AS INT) * 2 + 1, 2) || {_PAD(f'{_K} % 1000000', 6)} || 'C'", checks.uk_nino, S.uk_nino),
    "val_de_steuer_id": (f"'1123456' || {_PAD(f'{_K} % 10000', 4)}", checks.de_steuer_id, S.de_steuer_id),
    "val_fr_nir": (f"'18502' || CASE {_K} % 3 WHEN 0 THEN '2A' WHEN 1 THEN '2B' ELSE '75' END || {_PAD(f'{_K} % 1000000', 6)} || {_PAD(f'{_K} % 97', 2)}", checks.fr_nir, S.fr_nir),
    "val_es_dni_nie": (f"CASE {_K} % 2 WHEN 0 THEN 'X' ELSE '1' END || {_PAD(f'{_K} % 10000000', 7)} || substr('TRWAGMYFPDXBNJZSQVHLCKE', CAST({_K} % 23 AS INT) + 1, 1)", checks.es_dni_nie, S.es_dni_nie),
    "val_it_cf": (f"'PUBXLY' || {_PAD(f'{_K} % 100', 2)} || 'T' || {_PAD(f'{_K} % 29', 2)} || 'A' || {_PAD(f'{_K} % 1000', 3)} || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST({_K} % 26 AS INT) + 1, 1)", checks.it_codice_fiscale, S.it_codice_fiscale),
    "val_nl_bsn": (_PAD(f"{_K} * 31 % 1000000000", 9), checks.nl_bsn, S.nl_bsn),
    "val_mrz": (f"'C756900722NLD8810104F3310241ZK' || {_PAD(f'{_K} % 1000000', 6)} || '<<<<<<' || {_PAD(f'{_K} % 100', 2)}", checks.passport_mrz, S.passport_mrz),
}


def _validated(expr: str, rule, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").selectExpr(_K, f"{expr} AS identifier").withColumn("valid", rule(F.col("identifier")))


def val_iban_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _read(spark, sf_dir, "orders").selectExpr(_K, f"substr('DEGBNONLFRITESXXLCMTUSPL', CAST({_K} % 12 AS INT) * 2 + 1, 2) AS country")
    return own.withColumn("length", checks.iban_length(F.col("country")))


# --- normalization

_EVASIONS = "'li[at]vu(DOT)io {At} [at) ' || chr(8203) || '4' || chr(8288) || '1' || chr(65297) || ' 555' || chr(8211) || '0100' || chr(160) || CAST(c_custkey AS STRING) || chr(8722) || 'x'"


def _evasions(spark: SparkSession, sf_dir: str) -> DataFrame:
    # chr() of Spark stops at one byte
    chars = {f"chr({c})": f"'{chr(c)}'" for c in (8203, 8288, 65297, 8211, 160, 8722)}
    expr = _EVASIONS
    for old, new in chars.items():
        expr = expr.replace(old, new)
    return _read(spark, sf_dir, "customer").selectExpr("c_custkey", f"{expr} AS text")


def _folded(step, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evasions(spark, sf_dir).select("c_custkey", step(F.col("text")).alias("folded"))


def norm_nfkc_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shadow.with_shadow(_evasions(spark, sf_dir), "text")
    return out.select("c_custkey", F.col("__shadow.text").alias("folded"))


def norm_span_mapback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the original behind the first and last character of the shadow."""
    out = shadow.with_shadow(_evasions(spark, sf_dir), "text").select("c_custkey", "__shadow.first", "__shadow.end")
    return out.select("c_custkey", F.element_at("first", 1).alias("first_byte"), F.element_at("end", -1).alias("end_byte"))


# --- detectors and allowlists

def _found(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "id", "category", "start", "end")


def _detector(kind: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(detectors.scan(_injected(spark, sf_dir), detectors=[kind]))


def det_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(detectors.scan(_injected(spark, sf_dir), detectors=[], custom=CUSTOM))


def det_all_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(detectors.scan(_injected(spark, sf_dir)))


def det_all_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    return _found(detectors.scan(sources.spread(pages)))


_MAILS = "CASE c_custkey % 5 WHEN 0 THEN 'Desk@works.io' WHEN 1 THEN 'a@sub.corp.example' WHEN 2 THEN 'b@dept.allowed.org' WHEN 3 THEN 'c@allowed.org' ELSE 'd' || CAST(c_custkey AS STRING) || '@other.io' END"
_PHONES = "CASE c_custkey % 4 WHEN 0 THEN '+31 24 5530 8816' WHEN 1 THEN '(415) 777-2040' WHEN 2 THEN '415-777-2041' ELSE '(415) 555-0123' END"
_ALLOWED = Allow(("desk@WORKS.io",), ("allowed.org",), ("415.777.2040",))


def _mails(spark: SparkSession, sf_dir: str, expr: str) -> DataFrame:
    return _read(spark, sf_dir, "customer").selectExpr("c_custkey AS doc_id", f"'to ' || {expr} || ' now' AS text")


def allow_email_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(detectors.scan(_mails(spark, sf_dir, _MAILS), detectors=["email"], allow=Allow(emails=_ALLOWED.emails)))


def allow_domain_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(detectors.scan(_mails(spark, sf_dir, _MAILS), detectors=["email"], allow=Allow(domains=_ALLOWED.domains)))


def allow_phone_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(detectors.scan(_mails(spark, sf_dir, _PHONES), detectors=["phone_nanp"], allow=Allow(phones=_ALLOWED.phones)))


_RESERVED = "CASE c_custkey % 6 WHEN 0 THEN 'x@example.com' WHEN 1 THEN 'x@a.example.net' WHEN 2 THEN 'x@y.test' WHEN 3 THEN 'logo@2x.png' WHEN 4 THEN 'git@github.com' ELSE 'x@myexample.com' END"
_CARDS = f"CASE c_custkey % {len(V.TEST_CARDS) + 1} " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(V.TEST_CARDS)) + " ELSE '6011533314789326' END"
_SSNS = f"CASE c_custkey % {len(V.EXAMPLE_SSNS) + 1} " + " ".join(f"WHEN {i} THEN '{s[:3]}-{s[3:5]}-{s[5:]}'" for i, s in enumerate(V.EXAMPLE_SSNS)) + " ELSE '220-21-4279' END"


def _listed(expr: str, kind: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(detectors.scan(_mails(spark, sf_dir, expr), detectors=[kind]))


# --- policy

def _joined(c: str = "citations") -> Column:
    return F.array_join(c, "; ").alias("citations")


def policy_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Rules.builtin().matrix(spark).select("category", "ord", "audience", "action")


def policy_effective_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    over = spark.createDataFrame([("contact", "off"), ("employee_ref", "block")], "category string, action string")
    return effective(Rules.builtin().matrix(spark), over).select("category", "audience", "action")


def policy_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Rules.builtin().table(spark)
    rank = lambda c: F.array_position(F.array(*[F.lit(a) for a in V.ACTIONS]), F.col(c))
    return t.select("category", ((rank("investigation") <= rank("site")) & (rank("site") <= rank("public"))).alias("monotone"), _joined())


def findings_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detectors.scan(_injected(spark, sf_dir))
    return found.groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def findings_by_audience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each audience's policy does with the detections: one small join for all three."""
    found = detectors.scan(_injected(spark, sf_dir)).groupBy("category").agg(F.count("*").alias("n"))
    out = found.join(F.broadcast(Rules.builtin().matrix(spark)), "category")
    return out.groupBy("audience", "action").agg(F.sum("n").alias("n"))


# --- guard and reports

def _report(spark: SparkSession, sf_dir: str, texts=_notes, **options) -> DataFrame:
    # findings are few against the text; kept, as most reports read them more than once
    return guard.findings(texts(spark, sf_dir), Policy(Rules.builtin()), **options).persist()


def seg_windows_ascii(spark: SparkSession, sf_dir: str, texts=_notes) -> DataFrame:
    return guard.segments(texts(spark, sf_dir)).select("doc_id", "seg_no", "win_start", "cut", "release", "is_last")


def _plain_findings(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "seg_no", "action", "category", "source", "start", "end", _joined())


def guard_report_findings(spark: SparkSession, sf_dir: str, texts=_notes) -> DataFrame:
    return _plain_findings(_report(spark, sf_dir, texts))


def guard_filter_findings(spark: SparkSession, sf_dir: str, texts=_notes) -> DataFrame:
    return _plain_findings(guard.filter_findings(_report(spark, sf_dir, texts)))


def guard_filter_released_len(spark: SparkSession, sf_dir: str, texts=_notes) -> DataFrame:
    out = guard.released(texts(spark, sf_dir), _report(spark, sf_dir, texts))
    return out.select("doc_id", "blocked", F.octet_length("released").cast("long").alias("released_bytes"))


def guard_dedup(spark: SparkSession, sf_dir: str, texts=_notes) -> DataFrame:
    """Findings of each document and source, each counted once however many windows show it."""
    return _report(spark, sf_dir, texts).groupBy("doc_id", "source").agg(F.count("*").alias("n"), F.min("start").alias("first_start"))


def guard_events_order(spark: SparkSession, sf_dir: str, texts=_notes) -> DataFrame:
    """Events of the filter in order, with the bytes that they release."""
    notes = texts(spark, sf_dir)
    out = guard.events(notes, _report(spark, sf_dir, texts))
    return out.select("doc_id", "seg_no", "ord", "kind", F.col("n").cast("long").alias("n"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))


def guard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of all documents, as they are."""
    docs = sources.spread(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return _plain_findings(guard.findings(docs))


def guard_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of all pages: every row has other characters than ASCII."""
    pages = _read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    return _plain_findings(guard.findings(sources.spread(pages)))


def report_lines(spark: SparkSession, sf_dir: str, texts=_notes) -> DataFrame:
    return report.lines(_report(spark, sf_dir, texts), texts(spark, sf_dir)).select("doc_id", "start", "end", "line_no", "line")


def report_summary_verdict(spark: SparkSession, sf_dir: str, texts=_notes) -> DataFrame:
    return report.summary(_report(spark, sf_dir, texts), texts(spark, sf_dir), "site").select("doc_id", "blocks", "warns", "summary")


def report_exit_code(spark: SparkSession, sf_dir: str, texts=_notes) -> DataFrame:
    notes = texts(spark, sf_dir)
    found = guard.findings(notes, Policy(Rules.builtin(), "investigation"))
    return report.summary(found, notes, "investigation", fail_on_warn=True).select("doc_id", "exit_code")


def report_jsonl(spark: SparkSession, sf_dir: str, texts=_notes) -> DataFrame:
    return report.json_lines(_report(spark, sf_dir, texts), "site").select("doc_id", "start", "end", "json")


def finding_fingerprint(spark: SparkSession, sf_dir: str, texts=_notes) -> DataFrame:
    return _report(spark, sf_dir, texts, hmac_key=TEST_KEY).select("doc_id", "source", "start", "end", "fingerprint")


def utf8_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, and the same with their last byte cut off: does what is left end inside a character?"""
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw"))
    cut = F.substring("raw", F.lit(1), F.greatest(F.octet_length("raw") - 1, F.lit(0)))
    return docs.select("doc_id", sources.utf8_status(F.col("raw")).alias("whole"), sources.utf8_status(cut).alias("cut"))


def _streamed(spark: SparkSession, chunks: DataFrame) -> DataFrame:
    """chunks, written as files to the shared folder and run as a stream from there; its events."""
    from .streaming.guard_stream import guard_stream

    folder = f"{spark.conf.get('spark.checkpoint.dir', None) or 'file:///tmp/checkpoints'}/stream-{uuid.uuid4().hex}"
    chunks.write.parquet(f"{folder}/in")
    events = guard_stream(spark.readStream.schema(chunks.schema).parquet(f"{folder}/in"), mode="report")
    sources.write_events(events, f"{folder}/out", f"{folder}/state", once=True).awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{folder}/out")


def stream_guard_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation, its turns as chunks through the stream's guard, beside the batch over the joined text."""
    turns = _read(spark, sf_dir, "conversations").where("conv_id IS NOT NULL").select(F.col("conv_id").alias("doc_id"), "turn", F.concat(F.coalesce("text", F.lit("")), F.lit("\n [see 6011 5333 1478 9326 there] ")).alias("text"))
    number = F.expr("row_number() OVER (PARTITION BY doc_id ORDER BY turn, text)")
    turns = turns.withColumn("seq", number.cast("long") - 1)
    last = turns.groupBy("doc_id").agg(F.max("seq").alias("last"))
    chunks = turns.join(last, "doc_id").select(F.col("doc_id").alias("stream_id"), "seq", "text", (F.col("seq") == F.col("last")).alias("eos"))
    streamed = _streamed(spark, chunks).groupBy("stream_id").agg(F.sum(F.when(F.col("kind") == "release", F.octet_length("text")).otherwise(0)).alias("stream_bytes"), F.sum(F.size("findings")).alias("stream_findings"))
    whole = turns.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x.text), "").alias("text"))
    found = guard.findings(whole).groupBy("doc_id").agg(F.count("*").alias("batch_findings"))
    out = whole.select("doc_id", F.octet_length("text").cast("long").alias("batch_bytes")).join(found, "doc_id", "left")
    out = out.join(streamed, out.doc_id.cast("string") == streamed.stream_id, "left")
    equal = (F.col("batch_bytes") == F.col("stream_bytes")) & (F.coalesce("batch_findings", F.lit(0)) == F.col("stream_findings"))
    return out.select("doc_id", "batch_bytes", F.coalesce("batch_findings", F.lit(0)).cast("long").alias("batch_findings"), equal.alias("equal"))


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {"guard_documents": guard_documents}
    out |= {
        "norm_fold_at_dot": partial(_folded, shadow.fold_at_dot),
        "norm_strip_invisible": partial(_folded, shadow.strip_invisible),
        "norm_dash": partial(_folded, shadow.fold_dashes),
        "norm_fullwidth_digits": partial(_folded, shadow.narrow_ascii),
        "norm_nfkc_full": norm_nfkc_full,
        "norm_span_mapback": norm_span_mapback,
    }
    out |= {k: partial(_validated, e, rule) for k, (e, rule, _) in IDENTIFIERS.items()}
    out |= {"val_iban_length": val_iban_length}
    out |= {f"det_{k}": partial(_detector, k) for k in V.PATTERNS}
    out |= {f.__name__: f for f in (det_custom, det_all_documents, det_all_pages, allow_email_exact, allow_domain_suffix, allow_phone_digits)}
    out |= {"allow_reserved": partial(_listed, _RESERVED, "email"), "allow_test_cards": partial(_listed, _CARDS, "payment_card"), "allow_example_ssn": partial(_listed, _SSNS, "us_ssn")}
    out |= {f.__name__: f for f in (policy_matrix, policy_effective_override, policy_monotone, findings_by_category, findings_by_audience)}
    out |= {f.__name__: f for f in (seg_windows_ascii, guard_report_findings, guard_filter_findings, guard_filter_released_len, guard_dedup, guard_events_order, guard_pages)}
    out |= {f.__name__: f for f in (report_lines, report_summary_verdict, report_exit_code, report_jsonl, finding_fingerprint, utf8_status, stream_guard_equals_batch)}
    return out


def document_queries() -> dict[str, Query]:
    """The guard's and reports' queries over all documents with whole texts; they have no SQL."""
    own = (seg_windows_ascii, guard_filter_findings, guard_filter_released_len, guard_dedup, guard_events_order, report_lines, report_summary_verdict, report_exit_code, report_jsonl, finding_fingerprint)
    return {f"{f.__name__.removesuffix('_ascii')}_documents": partial(f, texts=_documents) for f in own}


# --- SQL

def _matrix_sql() -> str:
    rules = Rules.builtin().categories
    rows = ", ".join(f"({S.text(c)}, {i}, {S.text(a)}, {S.text(rules[c].actions[a])})" for i, c in enumerate(V.CATEGORIES) for a in V.AUDIENCES)
    return f"matrix(category, ord, audience, action) AS (VALUES {rows})"


def _citations_sql() -> str:
    rules = Rules.builtin().categories
    return "cites(category, citations) AS (VALUES " + ", ".join(f"({S.text(c)}, {S.text('; '.join(rules[c].citations))})" for c in V.CATEGORIES) + ")"


def _guard_sql(audience: str = "site") -> str:
    """CTEs notes, st, w, found (each finding once, in its first window) and stops."""
    keys = "doc_id, seg_no, win_start, release, is_last"
    return f"""WITH RECURSIVE {NOTES_SQL}, {S.windows("notes")}, {_matrix_sql()}, {_citations_sql()},
        hits AS ({S.all_detections("w", keys)}),
        judged AS (SELECT h.*, m.action, c.citations, 'local:' || id AS source FROM hits h JOIN matrix m ON m.category = h.category AND m.audience = '{audience}' JOIN cites c ON c.category = h.category
                   WHERE m.action <> 'off' AND NOT (NOT is_last AND "end" = length(t) AND win_start + start >= release)),
        found AS (SELECT doc_id, min(seg_no) AS seg_no, min(win_start) AS win_start, min(ord) AS ord, action, category, citations, source, (win_start_ + start_)::BIGINT AS "start", (win_start_ + end_)::BIGINT AS "end", any_value(found) AS found
                  FROM (SELECT *, win_start AS win_start_, start AS start_, "end" AS end_ FROM judged) GROUP BY doc_id, action, category, citations, source, win_start_ + start_, win_start_ + end_),
        stops AS (SELECT doc_id, min(seg_no) AS stop_seg, min(win_start) AS stop_at FROM found WHERE action = 'block' GROUP BY doc_id)"""


def _hmac_sql(key: bytes, x: str) -> str:
    own = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in own).hex(), bytes(b ^ 0x5C for b in own).hex()
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({x}))))"


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    chars = {k: v for k, v in (("inv", "[\\x{200B}\\x{2060}]"), ("dash", "[\\x{2010}-\\x{2015}\\x{2212}]"))}
    evasions = f"SELECT c_custkey, {_EVASIONS} AS text FROM customer"
    out["norm_fold_at_dot"] = f"SELECT c_custkey, regexp_replace(regexp_replace(text, '(?i)\\[at\\]|\\(at\\)|\\{{at\\}}', '@', 'g'), '(?i)\\[dot\\]|\\(dot\\)|\\{{dot\\}}', '.', 'g') AS folded FROM ({evasions})"
    out["norm_strip_invisible"] = f"SELECT c_custkey, regexp_replace(text, '{chars['inv']}', '', 'g') AS folded FROM ({evasions})"
    out["norm_dash"] = f"SELECT c_custkey, regexp_replace(text, '{chars['dash']}', '-', 'g') AS folded FROM ({evasions})"
    out["norm_fullwidth_digits"] = f"SELECT c_custkey, replace(replace(text, chr(65297), '1'), chr(160), ' ') AS folded FROM ({evasions})"
    out["norm_nfkc_full"] = f"SELECT c_custkey, 'li@vu.io @ [at) 411 555-0100 ' || CAST(c_custkey AS STRING) || '-x' AS folded FROM customer"
    out["norm_span_mapback"] = f"SELECT c_custkey, 0 AS first_byte, strlen(text) AS end_byte FROM ({evasions})"
    for k, (expr, _, rule) in IDENTIFIERS.items():
        out[k] = f"SELECT {_K}, identifier, {rule('identifier')} AS valid FROM (SELECT {_K}, {expr} AS identifier FROM orders)"
    out["val_iban_length"] = f"SELECT {_K}, country, {S.iban_length('country')} AS length FROM (SELECT {_K}, substr('DEGBNONLFRITESXXLCMTUSPL', CAST({_K} % 12 AS INT) * 2 + 1, 2) AS country FROM orders)"
    cols = 'doc_id, id, category, "start", "end"'
    for k in V.PATTERNS:
        out[f"det_{k}"] = f"SELECT {cols} FROM ({S.detections(INJECTED_SQL, 'doc_id', k)})"
    out["det_custom"] = " UNION ALL ".join(f"SELECT {cols} FROM ({S.detections(INJECTED_SQL, 'doc_id', k, p, k, 'employee_ref')})" for k, p in CUSTOM.items())
    out["det_all_documents"] = f"SELECT {cols} FROM ({S.all_detections(INJECTED_SQL, 'doc_id')})"
    out["det_all_pages"] = f"SELECT {cols} FROM ({S.all_detections('(SELECT page_id AS doc_id, html AS t FROM pages)', 'doc_id')})"
    mails = lambda e: f"(SELECT c_custkey AS doc_id, 'to ' || {e} || ' now' AS t FROM customer)"
    email = S.detections(mails(_MAILS), "doc_id", "email")
    out["allow_email_exact"] = f"SELECT {cols} FROM ({email}) WHERE lower(found) <> 'desk@works.io'"
    out["allow_domain_suffix"] = f"SELECT {cols} FROM ({email}) WHERE NOT regexp_matches(lower(found), '[@.]allowed\\.org$')"
    out["allow_phone_digits"] = f"SELECT {cols} FROM ({S.detections(mails(_PHONES), 'doc_id', 'phone_nanp')}) WHERE regexp_replace(found, '[^0-9]', '', 'g') <> '4157772040'"
    for k, expr, kind in (("allow_reserved", _RESERVED, "email"), ("allow_test_cards", _CARDS, "payment_card"), ("allow_example_ssn", _SSNS, "us_ssn")):
        out[k] = f"SELECT {cols} FROM ({S.detections(mails(expr), 'doc_id', kind)})"
    matrix, cites = _matrix_sql(), _citations_sql()
    rank = "list_position(['off', 'warn', 'block'], {})".format
    out["policy_matrix"] = f"WITH {matrix} SELECT category, ord, audience, action FROM matrix"
    out["policy_effective_override"] = f"WITH {matrix} SELECT category, audience, CASE category WHEN 'contact' THEN 'off' WHEN 'employee_ref' THEN 'block' ELSE action END AS action FROM matrix"
    out["policy_monotone"] = f"WITH {matrix}, {cites}, p AS (PIVOT matrix ON audience IN ('investigation', 'site', 'public') USING first(action) GROUP BY category) SELECT category, {rank('investigation')} <= {rank('site')} AND {rank('site')} <= {rank('public')} AS monotone, citations FROM p JOIN cites USING (category)"
    every = S.all_detections(INJECTED_SQL, "doc_id")
    out["findings_by_category"] = f"SELECT category, count(*) AS n, count(DISTINCT doc_id) AS docs FROM ({every}) GROUP BY category"
    out["findings_by_audience"] = f"WITH {matrix} SELECT audience, action, count(*) AS n FROM ({every}) e JOIN matrix m ON m.category = e.category GROUP BY audience, action"
    g = _guard_sql()
    plain = 'doc_id, seg_no, action, category, source, "start", "end", citations'
    out["seg_windows_ascii"] = f"WITH RECURSIVE {NOTES_SQL}, {S.windows('notes')} SELECT doc_id, seg_no, win_start, cut, release, is_last FROM w"
    out["guard_report_findings"] = f"{g} SELECT {plain} FROM found"
    out["guard_filter_findings"] = f"{g} SELECT {plain} FROM found LEFT JOIN stops USING (doc_id) WHERE stop_seg IS NULL OR seg_no <= stop_seg"
    out["guard_filter_released_len"] = f"{g} SELECT doc_id, stop_at IS NOT NULL AS blocked, coalesce(stop_at, strlen(text))::BIGINT AS released_bytes FROM notes LEFT JOIN stops USING (doc_id)"
    out["guard_dedup"] = f'{g} SELECT doc_id, source, count(*) AS n, min("start") AS first_start FROM found GROUP BY doc_id, source'
    out["guard_events_order"] = f"""{g},
        kept AS (SELECT * FROM found LEFT JOIN stops USING (doc_id) WHERE stop_seg IS NULL OR seg_no <= stop_seg),
        per AS (SELECT doc_id, seg_no, count(*) FILTER (WHERE action = 'warn') AS warns, count(*) FILTER (WHERE action = 'block') AS blocks FROM kept GROUP BY doc_id, seg_no)
        SELECT doc_id, seg_no, row_number() OVER (PARTITION BY doc_id, seg_no ORDER BY "start", "end", ord) - 1 AS ord, 'warn' AS kind, 1 AS n, 0 AS bytes FROM kept WHERE action = 'warn'
        UNION ALL SELECT doc_id, seg_no, warns, 'block', blocks, 0 FROM per WHERE blocks > 0
        UNION ALL SELECT w.doc_id, w.seg_no, coalesce(warns + CASE WHEN blocks > 0 THEN 1 ELSE 0 END, 0), 'release', 1, release - win_start FROM w LEFT JOIN stops USING (doc_id) LEFT JOIN per ON per.doc_id = w.doc_id AND per.seg_no = w.seg_no
        WHERE release > win_start AND (stop_seg IS NULL OR w.seg_no < stop_seg)"""
    pad = lambda x, n: f"CASE WHEN length({x}) < {n} THEN rpad({x}, {n}, ' ') ELSE {x} END"
    number = "(length(substr(text, 1, \"start\"::INT)) - length(replace(substr(text, 1, \"start\"::INT), chr(10), '')) + 1)"
    out["report_lines"] = f"""{g} SELECT doc_id, "start", "end", {number} AS line_no, CASE action WHEN 'block' THEN 'BLOCK' ELSE 'WARN ' END || '  ' || {pad('category', 16)} || ' line ' || {pad(f'CAST({number} AS STRING)', 4)} || ' ' || {pad('source', 22)} || ' ' || replace(citations, '; ', ' · ') AS line FROM found JOIN notes USING (doc_id)"""
    said = "CAST(blocks AS STRING) || ' blocking finding' || CASE WHEN blocks = 1 THEN '' ELSE 's' END || ', ' || CAST(warns AS STRING) || ' warning' || CASE WHEN warns = 1 THEN '' ELSE 's' END || ' — ' || CASE WHEN blocks > 0 THEN 'not safe to distribute to audience \"site\"' WHEN warns > 0 THEN 'review before distributing to audience \"site\"' ELSE 'nothing flagged for audience \"site\" by local rules' END"
    counts = "SELECT n.doc_id, count(*) FILTER (WHERE action = 'block') AS blocks, count(*) FILTER (WHERE action = 'warn') AS warns FROM notes n LEFT JOIN found f ON f.doc_id = n.doc_id GROUP BY n.doc_id"
    out["report_summary_verdict"] = f"{g} SELECT doc_id, blocks, warns, {said} AS summary FROM ({counts})"
    out["report_exit_code"] = f"{_guard_sql('investigation')} SELECT doc_id, CASE WHEN blocks > 0 OR warns > 0 THEN 3 ELSE 0 END AS exit_code FROM ({counts})"
    cited = "'[\"' || replace(citations, '; ', '\",\"') || '\"]'"
    out["report_jsonl"] = f"""{g} SELECT doc_id, "start", "end", '{{"audience":"site","action":"' || action || '","category":"' || category || '","source":"' || source || '","start":' || CAST("start" AS STRING) || ',"end":' || CAST("end" AS STRING) || ',"citations":' || {cited} || '}}' AS json FROM found"""
    out["finding_fingerprint"] = f'{g} SELECT doc_id, source, "start", "end", {_hmac_sql(TEST_KEY, "found")} AS fingerprint FROM found'
    out["utf8_status"] = "SELECT doc_id, 0 AS whole, CASE WHEN text IS NULL OR text = '' OR strlen(right(text, 1)) = 1 THEN 0 ELSE 4 END AS cut FROM documents"
    bytes_ = "strlen(coalesce(text, '')) + strlen(chr(10) || ' [see 6011 5333 1478 9326 there] ')"
    out["stream_guard_equals_batch"] = f"SELECT conv_id AS doc_id, sum({bytes_})::BIGINT AS batch_bytes, count(*) AS batch_findings, true AS equal FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id"
    return out

"""Plans against the plain twin and against SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from cordon import queries as Q
from cordon.api import Guarded
from cordon.functions import checks, plain
from cordon.functions.plain import Detectors
from cordon.functions.shadow import shadow
from cordon.functions.windows import Sizes
from cordon.operators import detectors, guard, report
from cordon.plans.rules import Config, Policy, Rules
from cordon.sources import text as sources
from cordon.streaming.guard_stream import StreamGuard

from . import made

SF = "/root/testdata/sf0.001"
RULES = {
    "payment_card": checks.card,
    "iban": checks.iban,
    "us_ssn": checks.us_ssn,
    "uk_nino": checks.uk_nino,
    "de_steuer_id": checks.de_steuer_id,
    "fr_nir": checks.fr_nir,
    "es_dni_nie": checks.es_dni_nie,
    "it_codice_fiscale": checks.it_codice_fiscale,
    "nl_bsn": checks.nl_bsn,
    "passport_mrz": checks.passport_mrz,
}


def _vectors(kind):
    """Made numbers, each with one of its characters changed, or broken by rule where there is no check digit."""
    r = made.rng(kind + "v")
    good = [made.MAKERS[kind](r) for _ in range(30)]
    if kind == "us_ssn":
        bad = [x for s in good for x in ("000" + s[3:], "666" + s[3:], "9" + s[1:], s[:3] + "00" + s[5:], s[:5] + "0000")]
    elif kind == "uk_nino":
        bad = [p + s[2:] for s in good for p in ("BG", "GB", "NK", "KN", "TN", "NT", "ZZ")]
    else:
        bad = [made.changed(r, s, r.choice([-1, len(s) - 2 if kind in ("fr_nir", "payment_card", "iban") else -1]) % len(s)) for s in good]
    return good, bad


@pytest.mark.parametrize("kind", list(RULES))
def test_validators(spark, kind):
    good, bad = _vectors(kind)
    df = spark.createDataFrame([(x, True) for x in good] + [(x, False) for x in bad], "x string, want boolean")
    assert df.where(RULES[kind](F.col("x")) != F.col("want")).collect() == []
    assert spark.sql("SELECT CAST(NULL AS STRING) x").select(RULES[kind](F.col("x"))).first()[0] is False


def _texts(n=120):
    r = made.rng(5)
    fixed = ["E123456", "1 85 02 2A 123 456 12", "bsn éééééééééééééééééé 807124813", "user@example.com", "é123 x", "a@b.md"]

    def one():
        if r.random() < 0.3:
            return r.choice(fixed)
        _, lead, own = made.identifier(r)
        return lead + made.disguised(own, r.choice(made.DISGUISES))

    return [(i, made.prose(r, r.randint(0, 900)) + " ".join(one() for _ in range(r.randint(0, 3))) + r.choice([" ", " x", "é", ""]) + made.prose(r, r.randint(0, 700))) for i in range(n)]


CUSTOM = {"badge": r"\bE\d{6}\b"}


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([*_texts(), (900, None), (901, "")], "doc_id long, text string")


@pytest.mark.parametrize("scan", [detectors.scan, detectors.scan_columns])
def test_scan_is_the_plain_scan(spark, texts, scan):
    own = Detectors(custom=CUSTOM)
    got: dict = {}
    for r in scan(texts, custom=CUSTOM).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.id, r.category))
    for i, text in _texts():
        s, first, end = shadow(text)
        at = lambda x: len(s[:x].encode())  # noqa: B023, E731
        want = sorted((first[a] if first else at(a), end[b - 1] if end else at(b), k, c) for a, b, k, c in own.scan(s))
        assert sorted(got.get(i, [])) == want, text


@pytest.mark.parametrize("sizes", [Sizes(), Sizes(70, 80, 120, 64)])
@pytest.mark.parametrize("mode", ["filter", "report"])
def test_batch_events_are_the_streams(spark, texts, sizes, mode):
    policy = Policy(Rules.builtin())
    found = guard.findings(texts, policy, sizes=sizes, custom=CUSTOM, hmac_key=b"k")
    got: dict = {}
    for r in guard.events(texts, found, mode, sizes=sizes).orderBy("doc_id", "seg_no", "ord").collect():
        got.setdefault(r.doc_id, []).append((r.seg_no, r.ord, r.kind, r.n, r.text, [(f.start, f.end, f.action, f.category, f.source, f.citations, f.fingerprint) for f in r.findings]))
    for i, text in _texts():
        one = StreamGuard.of(policy, Detectors(custom=CUSTOM), sizes=sizes, mode=mode, hmac_key=b"k")
        want = [(*e[:5], [(f[0], f[1], f[3], f[4], f[5], f[7], f[8]) for f in e[5]]) for e in [*one.push(text), *one.finish()]]
        assert got.get(i, []) == want


def test_findings_hold_no_text(spark, texts):
    assert set(guard.findings(texts).columns) == {"doc_id", "seg_no", "win_start", "ord", "action", "category", "source", "start", "end", "probability", "citations", "fingerprint"}


def test_key_is_not_in_the_plan(spark, texts):
    plan = guard.findings(texts, hmac_key=b"very secret key")._jdf.queryExecution().toString()
    assert "very secret" not in plan


def test_report_and_api(spark):
    guarded = Guarded.load(Config(), notice=False)
    said, code = guarded.check_text(spark, "see WE 98 11 35 A.")
    assert code == 3 and said.startswith("BLOCK  government_id    line 1    local:uk_nino")
    out, found = guarded.filter(spark.createDataFrame([(1, "fine"), (2, "card 6011 5333 1478 9326")], "doc_id long, text string"))
    assert {(r.doc_id, r.blocked, r.released) for r in out.collect()} == {(1, False, "fine"), (2, True, "")} and found.count() == 1


def test_files_with_bad_bytes(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("naïve".encode())
    (tmp_path / "b.txt").write_bytes(b"abc\xff")
    rows = {r.doc_id[-5:]: (r.text, r.status) for r in sources.read_files(spark, str(tmp_path)).collect()}
    assert rows == {"a.txt": ("naïve", report.OK), "b.txt": (None, report.BAD_INPUT)}
    with pytest.raises(ValueError):
        sources.read_files(spark, str(tmp_path), "sse-openai")


def test_stream_of_bytes(spark, tmp_path):
    texts = spark.createDataFrame(_texts(12), "doc_id long, text string")
    sources.chunked(texts, size=50).write.parquet(f"{tmp_path}/in")
    events = Guarded.load(Config(), notice=False).stream(sources.read_stream(spark, f"{tmp_path}/in"))
    sources.write_events(events, f"{tmp_path}/out", f"{tmp_path}/state", once=True).awaitTermination()
    got = {r.stream_id: r.t for r in spark.read.parquet(f"{tmp_path}/out").where("kind = 'release'").groupBy("stream_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg_no", "text"))), lambda x: x.text), "").alias("t")).collect()}
    for r in guard.released(texts, guard.findings(texts)).collect():
        assert got.get(str(r.doc_id), "") == r.released


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


SQL = ["norm_fold_at_dot", "norm_nfkc_full", "val_card", "val_iban_mod97", "val_mrz", "det_iban", "det_all_documents", "allow_domain_suffix", "policy_effective_override", "findings_by_audience", "seg_windows_ascii", "guard_filter_findings", "guard_filter_released_len", "guard_events_order", "report_lines", "report_summary_verdict", "report_jsonl", "finding_fingerprint", "utf8_status"]


@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, duck, name):
    got = Q.queries()[name](spark, SF).toPandas()
    want = duck.execute(Q.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(str).to_numpy().tolist()))
    assert rows(got) == rows(want)


def test_every_query_has_sql_but_these():
    assert set(Q.queries()) - set(Q.oracle_sql()) == {"guard_documents", "guard_pages"}


def test_documents_are_the_plain_guards(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {(r.doc_id, r.start, r.end, r.source) for r in Q.guard_documents(spark, SF).collect()}
    want = set()
    for r in docs.collect():
        one = StreamGuard.of(Policy(Rules.builtin()), Detectors(), mode="report")
        want |= {(r.doc_id, f[0], f[1], f[5]) for e in [*one.push(r.text or ""), *one.finish()] for f in e[5]}
    assert got == want and plain


def test_document_queries_are_the_plain_guards(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    own = Q.document_queries()
    lets, kept, all_ = {}, set(), {}
    for i, text in docs.items():
        for mode in ("filter", "report"):
            one = StreamGuard.of(Policy(Rules.builtin()), Detectors(), mode=mode)
            out = [*one.push(text), *one.finish()]
            found = {(i, f[0], f[1], f[5]) for e in out for f in e[5]}
            if mode == "filter":
                lets[i], kept = [(e[0], e[1], e[2], e[3], len((e[4] or "").encode())) for e in out], kept | found
            else:
                all_[i] = found
    events = {}
    for r in own["guard_events_order_documents"](spark, SF).orderBy("doc_id", "seg_no", "ord").collect():
        events.setdefault(r.doc_id, []).append((r.seg_no, r.ord, r.kind, r.n, r.bytes))
    assert events == {i: e for i, e in lets.items() if e}
    assert {(r.doc_id, r.start, r.end, r.source) for r in own["guard_filter_findings_documents"](spark, SF).collect()} == kept
    assert {r.doc_id: r.released_bytes for r in own["guard_filter_released_len_documents"](spark, SF).collect()} == {i: sum(e[4] for e in v) for i, v in lets.items()}
    lines = {(r.doc_id, r.start, r.end): r.line_no for r in own["report_lines_documents"](spark, SF).collect()}
    assert lines == {f[:3]: docs[f[0]].encode()[: f[1]].count(b"\n") + 1 for v in all_.values() for f in v}
    assert {r.doc_id: r.blocks + r.warns for r in own["report_summary_verdict_documents"](spark, SF).collect()} == {i: len(v) for i, v in all_.items()}
    for name in ("report_jsonl_documents", "finding_fingerprint_documents"):
        assert own[name](spark, SF).count() == sum(map(len, all_.values()))


def test_texts_of_report_lines_are_not_broadcast(spark):
    docs = spark.createDataFrame([(1, "a\nb"), (2, "c")], "doc_id long, text string")
    row = (1, 2, 3, 0, "warn", "contact", "local:email", ["x"])
    found = spark.createDataFrame([row], "doc_id long, start long, end long, ord int, action string, category string, source string, citations array<string>")
    out = report.lines(found, docs)
    assert [(r.doc_id, r.line_no) for r in out.collect()] == [(1, 2)]
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_notes_are_dealt_over_all_cores(spark):
    assert Q._notes(spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism // 2

"""The guard as a plan over whole texts: windows, detections in each, policy, one report of each finding, release.

Windows do not depend on findings, so what a filter stops at is the first window with a block, and what it
releases is all before that window's start.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import plain
from ..functions.plain import Allow
from ..functions.shadow import shadow
from ..functions.windows import Sizes, windows
from ..plans.rules import Policy, Rules, checked_pattern
from .detectors import ANY

_INTS = T.ArrayType(T.IntegerType())
_SHADOW = T.StructType([T.StructField("text", T.StringType()), T.StructField("first", _INTS), T.StructField("end", _INTS)])
_WINDOW = T.StructType(
    [
        T.StructField("seg_no", T.IntegerType()),
        T.StructField("win_start", T.LongType()),
        T.StructField("cut", T.LongType()),
        T.StructField("release", T.LongType()),
        T.StructField("is_last", T.BooleanType()),
        T.StructField("shadow", _SHADOW),
    ]
)


def _windows_udf(sizes: Sizes, only: str | None = None):
    """only: leave out windows whose shadow has no match of this pattern."""
    wanted = re.compile(only) if only else None

    @F.pandas_udf(T.ArrayType(_WINDOW))
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [(i, w.start, w.cut, w.start + w.release, w.last, (w.text, w.first, w.end)) for i, w in enumerate(windows(t, sizes)) if wanted is None or wanted.search(w.text)] for t in texts], dtype=object)

    return cut


def segments(df: DataFrame, text: str = "text", sizes: Sizes | None = None, only: str | None = None) -> DataFrame:
    """df without the text, one row for each window: seg_no, win_start, cut, release (bytes of the text), is_last, shadow."""
    keep = [c for c in df.columns if c != text]
    rows = df.where(F.col(text).isNotNull()).withColumn("__w", F.explode(_windows_udf(sizes or Sizes(), only)(F.col(text))))
    return rows.select(*keep, "__w.*")


_FOUND = "array<struct<seg_no:int,win_start:bigint,ord:int,id:string,category:string,start:bigint,`end`:bigint,fingerprint:string>>"


def _found(sizes: Sizes, own: plain.Detectors, hmac_key: bytes | None):
    """Windows of a text and the detections in each; the key travels inside the function, never as a literal of the plan."""
    wanted = None if own.custom else re.compile(ANY)

    @F.pandas_udf(_FOUND)
    def found(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            rows = []
            if wanted and not wanted.search(shadow(t)[0]):
                out.append(rows)
                continue
            for i, w in enumerate(windows(t, sizes)):
                if wanted and not wanted.search(w.text):
                    continue
                for a, b, id_, category, n in own.matches(w.text):
                    start, end = w.span(a, b)
                    # a match that touches the open end is judged in the next window, with all its context
                    if w.last or b < len(w.text) or start < w.start + w.release:
                        rows.append((i, w.start, n, id_, category, start, end, None if hmac_key is None else plain.fingerprint(hmac_key, w.text[a:b])))
            out.append(rows)
        return pd.Series(out, dtype=object)

    return found


def findings(
    df: DataFrame,
    policy: Policy | None = None,
    text: str = "text",
    key: str = "doc_id",
    sizes: Sizes | None = None,
    allow: Allow | None = None,
    custom: dict[str, str] | None = None,
    hmac_key: bytes | None = None,
    corsica: str = "double",
) -> DataFrame:
    """All findings of a report: key, seg_no, win_start, ord, action, category, source, start, end, probability, citations, fingerprint.

    A finding that several windows show is reported by the first of them. It never holds the text it flags.
    """
    policy = policy or Policy(Rules.builtin())
    # one Arrow pass, which gives back findings alone
    base = df.select(key, text).where(F.col(text).isNotNull())
    own = plain.Detectors(allow or Allow(), {k: checked_pattern(k, p) for k, p in (custom or {}).items()}, corsica)
    found = base.select(key, F.explode(_found(sizes or Sizes(), own, hmac_key)(F.col(text))).alias("x")).select(key, "x.*")
    rules = F.broadcast(policy.table(df.sparkSession))  # a row for each category
    rows = found.join(rules.drop("ord"), "category").where("rank > 0")
    rows = rows.select(key, "start", "end", F.concat(F.lit("local:"), "id").alias("source"), F.struct("seg_no", "win_start", "ord", "action", "category", "citations", "fingerprint").alias("f"))
    once = rows.groupBy(key, "start", "end", "source").agg(F.min("f").alias("f"))
    return once.select(key, "f.seg_no", "f.win_start", "f.ord", "f.action", "f.category", "source", "start", "end", F.lit(None).cast("float").alias("probability"), "f.citations", "f.fingerprint")


def _stops(found: DataFrame, key: str) -> DataFrame:
    """key, stop_seg, stop_at: the first window with a block and its start."""
    return found.where("action = 'block'").groupBy(key).agg(F.min("seg_no").alias("stop_seg"), F.min("win_start").alias("stop_at"))


def filter_findings(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of a report's findings those that a filter gives: up to the first window with a block."""
    return found.join(_stops(found, key), key, "left").where("stop_seg IS NULL OR seg_no <= stop_seg").drop("stop_seg", "stop_at")


def released(df: DataFrame, found: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """df with `blocked` and `released`, the text that a filter lets out: all of it, or all before the window that blocks."""
    out = df.join(_stops(found, key).drop("stop_seg"), key, "left")
    part = F.decode(F.substring(F.encode(text, "UTF-8"), F.lit(1), F.col("stop_at").cast("int")), "UTF-8")
    return out.withColumn("blocked", F.col("stop_at").isNotNull()).withColumn("released", F.when(F.col("stop_at").isNull(), F.col(text)).otherwise(part)).drop("stop_at")


def events(df: DataFrame, found: DataFrame, mode: str = "filter", text: str = "text", key: str = "doc_id", sizes: Sizes | None = None) -> DataFrame:
    """What a stream would give, in order: key, seg_no, ord, kind (warn, block, release), n, text, findings.

    In each window warnings by (start, end) come first, then one block with its findings, then what is released.
    """
    if mode not in ("filter", "report"):
        raise ValueError(f"unknown mode {mode!r}")
    own = filter_findings(found, key) if mode == "filter" else found
    one = F.struct("start", "end", F.col("ord").alias("tie"), "action", "category", "source", "probability", "citations", "fingerprint")
    per = own.groupBy(key, "seg_no").agg(F.sort_array(F.collect_list(F.when(F.col("action") == "warn", one))).alias("warns"), F.sort_array(F.collect_list(F.when(F.col("action") == "block", one))).alias("blocks"))  # the findings of one window
    none = F.lit(None)
    warns = per.select(key, "seg_no", F.posexplode("warns").alias("ord", "f")).select(key, "seg_no", "ord", F.lit("warn").alias("kind"), F.lit(1).alias("n"), none.cast("string").alias("text"), F.array("f").alias("findings"))
    blocks = per.where(F.size("blocks") > 0).select(key, "seg_no", F.size("warns").alias("ord"), F.lit("block").alias("kind"), F.size("blocks").alias("n"), none.cast("string").alias("text"), F.col("blocks").alias("findings"))
    parts = segments(df.select(key, text, F.col(text).alias("__whole")), text, sizes).where("release > win_start").drop("shadow")
    if mode == "filter":
        parts = parts.join(_stops(found, key), key, "left").where("stop_seg IS NULL OR seg_no < stop_seg")
    parts = parts.join(per.select(key, "seg_no", (F.size("warns") + F.when(F.size("blocks") > 0, 1).otherwise(0)).alias("before")), [key, "seg_no"], "left")
    raw = F.substring(F.encode("__whole", "UTF-8"), (F.col("win_start") + 1).cast("int"), (F.col("release") - F.col("win_start")).cast("int"))
    releases = parts.select(key, "seg_no", F.coalesce("before", F.lit(0)).alias("ord"), F.lit("release").alias("kind"), F.lit(1).alias("n"), F.decode(raw, "UTF-8").alias("text"), F.array().cast(blocks.schema["findings"].dataType).alias("findings"))
    return warns.unionByName(blocks).unionByName(releases)

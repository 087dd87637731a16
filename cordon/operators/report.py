"""Reports: finding lines, summaries, verdicts, JSON lines and exit codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: exit codes
OK, INTERNAL, USAGE, BLOCKED, BAD_INPUT = range(5)


def line_number(text: Column, start: Column) -> Column:
    """1 and the line feeds in the first `start` bytes."""
    before = F.decode(F.substring(F.encode(text, "UTF-8"), F.lit(1), start.cast("int")), "UTF-8")
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def lines(found: DataFrame, df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, start, end, ord, line_no, line: one line for people for each finding; order by key, start, end, ord."""
    # merged, as Spark takes a computed text for 20 bytes and would send all texts to every executor
    rows = found.join(df.select(key, F.col(text).alias("__t")).hint("merge"), key)
    number = line_number(F.col("__t"), F.col("start"))
    label = F.when(F.col("action") == "block", "BLOCK").otherwise("WARN ")
    pad = lambda c, n: F.when(F.length(c) < n, F.rpad(c, n, " ")).otherwise(c)
    line = F.concat(label, F.lit("  "), pad(F.col("category"), 16), F.lit(" line "), pad(number.cast("string"), 4), F.lit(" "), pad(F.col("source"), 22), F.lit(" "), F.array_join("citations", " · "))
    return rows.select(key, "start", "end", "ord", number.cast("long").alias("line_no"), line.alias("line"))


def _plural(n: Column, what: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {what}"), F.when(n == 1, "").otherwise("s"))


def summary(found: DataFrame, df: DataFrame, audience: str, key: str = "doc_id", fail_on_warn: bool = False) -> DataFrame:
    """key, blocks, warns, verdict, summary, exit_code for each row of df, findings or not."""
    counts = found.groupBy(key).agg(F.count_if(F.col("action") == "block").alias("blocks"), F.count_if(F.col("action") == "warn").alias("warns"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    rows = df.select(key).join(counts, key, "left").select(key, zero("blocks").alias("blocks"), zero("warns").alias("warns"))
    to = f' audience "{audience}"'
    verdict = F.when(F.col("blocks") > 0, f"not safe to distribute to{to}").when(F.col("warns") > 0, f"review before distributing to{to}").otherwise(f"nothing flagged for{to} by local rules")
    said = F.concat(_plural(F.col("blocks"), "blocking finding"), F.lit(", "), _plural(F.col("warns"), "warning"), F.lit(" — "), verdict)
    stop = (F.col("blocks") > 0) | ((F.col("warns") > 0) & F.lit(fail_on_warn))
    return rows.select(key, "blocks", "warns", verdict.alias("verdict"), said.alias("summary"), F.when(stop, BLOCKED).otherwise(OK).alias("exit_code"))


def json_lines(found: DataFrame, audience: str, key: str = "doc_id") -> DataFrame:
    """key, start, end, ord, json: findings as JSON, without the fields that are absent."""
    whole = F.struct(F.lit(audience).alias("audience"), "action", "category", "source", "start", "end", "probability", "citations", "fingerprint")
    return found.select(key, "start", "end", "ord", F.to_json(whole).alias("json"))

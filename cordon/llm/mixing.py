"""Operator 7: mixing sources to target weights by soft membership.

A naive Bayes classifier, learned from the labelled table, gives each document posteriors over the domains
(the quality labels that occur) from surface features of its whole text: share of symbols,
share of distinct words, word length, text length, line length. Features are binned, so documents fall into a
bounded number of cells with one posterior each. Nonnegative document rates are then fitted by accelerated
projected-gradient least squares: each step is a distributed sum of the expected tokens of each domain, and a
cell's rate follows from its posterior and the steps' residuals alone, so no state is kept for documents. At
the end expected domain totals match the targets as nearly as the posteriors allow. A document's copies are
its rate rounded by a hash of its id. Built-in expressions only.

Cases: a null or empty text has no tokens and the cell of empty texts; a null label is no label; of repeated
labels of a doc_id the largest count; domains without a labelled document drop out and the other targets are
scaled up; with no label at all there is one domain and every rate is the same; of equal posteriors the smaller
domain is reported; very long texts are read whole, their words as one array; repeated rows get equal rates and
copies; an empty table gives no rows; other columns, whatever their names, are kept by `mixed` and not read.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import NULL_ID, collect_garbage, table

#: Domains are the values of this column of the labelled table; the weights are shares of all tokens.
LABEL = "quality"
TARGETS = {1: 0.9, 0: 0.1}
#: Bins of each feature.
FEATURES = {"symbols": 5, "distinct": 5, "word_chars": 4, "length": 5, "line_chars": 4}
SYMBOLS = "#$%&*|{}<>=_~^"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def with_features(docs: DataFrame) -> DataFrame:
    """docs with `__tokens` and, as `__<feature>`, the bin of each feature."""
    out = docs.withColumn("__t", F.coalesce(F.col("text"), F.lit(""))).withColumn("__w", _words(F.col("__t")))
    out = out.withColumns({"__tokens": F.size("__w").cast("long"), "__d": F.size(F.array_distinct("__w")), "__n": F.length("__t"), "__plain": F.length(F.translate("__t", SYMBOLS, "")), "__flat": F.length(F.translate("__t", "\n", ""))}).drop("__w", "__t")
    words, chars = F.greatest(F.col("__tokens"), F.lit(1)), F.greatest(F.col("__n"), F.lit(1))
    cut = lambda c, *at: sum((F.when(c >= a, 1).otherwise(0) for a in at), F.lit(0)).cast("int")
    bins = {
        "__symbols": cut((F.col("__n") - F.col("__plain")) / chars, 0.002, 0.02, 0.08, 0.2),
        "__distinct": cut(F.col("__d") / words, 0.1, 0.4, 0.6, 0.85),
        "__word_chars": cut(F.col("__n") / words, 4.5, 6.0, 8.0),
        "__length": cut(F.col("__tokens"), 20, 100, 500, 2000),
        "__line_chars": cut(F.col("__n") / (F.col("__n") - F.col("__flat") + 1), 60, 200, 1000),
    }
    return out.withColumns(bins).drop("__d", "__n", "__plain", "__flat")


def features(docs: DataFrame) -> DataFrame:
    """__id, n_tokens and the bin of each feature, for each row of docs."""
    out = with_features(docs.select("doc_id", "text"))
    return out.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("__id"), F.col("__tokens").alias("n_tokens"), *[F.col(f"__{f}").alias(f) for f in FEATURES])


def posteriors(cells: DataFrame, labels: DataFrame, rows: DataFrame) -> tuple[DataFrame, list[int]]:
    """cells with an array `p` over the domains, and the domains."""
    valid = labels.where(F.col(LABEL).isNotNull() & F.col("doc_id").isNotNull())
    own = valid.groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.col(LABEL)).alias("domain"))
    marks = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("bin")) for f in FEATURES])
    # at most one row for each feature, bin and domain
    seen = rows.join(own, "__id").select("domain", F.explode(marks).alias("m")).groupBy("domain", "m.f", "m.bin").agg(F.count("*").alias("n")).collect()
    first = next(iter(FEATURES))
    size = {}
    for r in seen:
        if r.f == first:
            size[r.domain] = size.get(r.domain, 0) + r.n
    domains = sorted(size) or [0]
    n = {(r.domain, r.f, r.bin): r.n for r in seen}
    scores = []
    for d in domains:
        s = F.lit(math.log(size.get(d, 1) / max(1, sum(size.values()))))
        for f, bins in FEATURES.items():
            logs = [math.log((n.get((d, f, b), 0) + 0.5) / (size.get(d, 0) + 0.5 * bins)) for b in range(bins)]
            s = s + F.get(F.array(*[F.lit(x) for x in logs]), F.col(f))
        scores.append(s)
    cells = cells.withColumn("__s", F.array(*scores)).withColumn("__m", F.array_max("__s"))
    cells = cells.withColumn("__e", F.transform("__s", lambda s: F.exp(s - F.col("__m"))))
    cells = cells.withColumn("__z", F.aggregate("__e", F.lit(0.0), lambda a, e: a + e))
    return cells.withColumn("p", F.transform("__e", lambda e: e / F.col("__z"))).drop("__s", "__m", "__e", "__z"), domains


def _rate(p: Column, residuals: list[list[float]], start: float, least: float, ridge: float) -> Column:
    """A cell's rate after the steps whose residuals these are: r from the point y, y from r and the r before."""
    zero = F.struct(F.lit(start).alias("r"), F.lit(start).alias("y"))
    if not residuals:
        return zero
    steps = F.array(*[F.struct(F.array(*[F.lit(float(x)) for x in e]).alias("e"), F.lit((i + 1.0) / (i + 4.0)).alias("m")) for i, e in enumerate(residuals)])

    def step(s: Column, x: Column) -> Column:
        pull = F.aggregate(F.zip_with(p, x.e, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        r = F.greatest(F.lit(least), s.y - (pull + ridge * (s.y - start)) / (1 + ridge))
        return F.struct(r.alias("r"), (r + x.m * (r - s.r)).alias("y"))

    return F.aggregate(steps, zero, step)


def fit_rates(docs: DataFrame, labels: DataFrame, targets: dict[int, float] | None = None, least: float = 0.0, growth: float = math.inf, steps: int = 40, close: float = 1e-4, ridge: float = 1e-3) -> tuple[DataFrame, DataFrame, list[int]]:
    """(rows, cells, domains): each document with its cell's features, and cells with posteriors `p` and `rate`.

    With least = 0 the targets are shares of the tokens there are. With least > 0 (no document gets a lower
    rate) they are shares of as many tokens as that takes, but of at most `growth` times those there are; beyond
    that the fit is the nearest one that keeps the rates. What a higher rate brings of the other domains counts
    too: the number of tokens is raised between steps. A share that is missed is told by a warning.
    """
    targets = TARGETS if targets is None else targets
    rows = table(features(docs), "mixing-rows")
    cells = rows.groupBy(*FEATURES).agg(F.sum("n_tokens").cast("double").alias("tokens"))
    cells, domains = posteriors(cells, labels, rows)
    cells = table(cells, "mixing-cells")
    k = len(domains)
    sums = lambda weight: [F.sum(F.col("tokens") * weight * F.get("p", F.lit(i))).alias(f"t{i}") for i in range(k)]
    purest = [F.max(F.get("p", F.lit(i))).alias(f"m{i}") for i in range(k)]
    first = [x or 0.0 for x in cells.agg(*sums(F.lit(1.0)), *purest).first()]
    there, purest = first[:k], first[k:]
    total = sum(there)
    share = {d: targets.get(d, 0.0) for d in domains}
    scale = sum(share.values())
    share = [share[d] / scale if scale else 1 / k for d in domains]
    wanted = total
    if least > 0 and total:
        wanted = min(growth * total, least * max(t / max(s, 1e-6) for t, s in zip(there, share) if t > 0))
    goal, start = [wanted * s for s in share], (wanted / total if total else 1.0)
    # no rates reach a share that is above every cell's posterior
    open_ = least > 0 and all(m > s for m, s in zip(purest, share))
    residuals: list[list[float]] = []
    for i in range(steps if total else 0):
        now = cells.agg(*sums(_rate(F.col("p"), residuals, start, least, ridge)["y"])).first()
        residuals.append([((x or 0.0) - g) / total for x, g in zip(now, goal)])
        if max(map(abs, residuals[-1])) < close * max(1.0, start):
            break
        if open_ and i % 8 == 7:
            wanted = max(wanted, min(growth * total, max((x or 0.0) / s for x, s in zip(now, share) if s > 0)))
            goal = [wanted * s for s in share]
    rated = cells.withColumn("rate", _rate(F.col("p"), residuals, start, least, ridge)["r"]).drop("tokens")
    rated = table(rated, "mixing-rates")
    reached = [x or 0.0 for x in rated.join(cells.select(*FEATURES, "tokens"), list(FEATURES)).agg(*sums(F.col("rate"))).first()]
    if total and max(abs(x / (sum(reached) or 1) - s) for x, s in zip(reached, share)) > 0.01:
        warnings.warn(f"shares of tokens by domain {domains}: wanted {share}, reached {[x / (sum(reached) or 1) for x in reached]}", stacklevel=2)
    collect_garbage(docs.sparkSession)
    return rows, rated, domains


def copies(doc_id: Column, rate: Column) -> Column:
    """rate rounded up or down by a hash of the id, so that its expectation is the rate."""
    chance = F.shiftrightunsigned(F.xxhash64(doc_id, F.lit("mixing")), 11) / F.lit(float(2**53))
    return (F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def mixing_report(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, n_tokens, domain, posteriors (in the order of the domains), rate, copies for each row of docs."""
    rows, cells, domains = fit_rates(docs, labels, **options)
    out = rows.join(F.broadcast(cells), list(FEATURES))  # at most the product of the bins
    best = F.array_position("p", F.array_max("p")).cast("int") - 1
    doc_id = F.when(F.col("__id") != NULL_ID, F.col("__id"))
    return out.select(doc_id.alias("doc_id"), "n_tokens", F.get(F.array(*[F.lit(d) for d in domains]), best).alias("domain"), F.col("p").alias("posteriors"), "rate", copies(F.col("__id"), F.col("rate")).alias("copies"))


def mixed(docs: DataFrame, labels: DataFrame, least: float = 1.0, **options) -> DataFrame:
    """docs, each row as often as its copies; with least = 1 every document stays."""
    _, cells, _ = fit_rates(docs, labels, least=least, **options)
    kept = [F.col(f"`{c}`") for c in docs.columns]
    bins = with_features(docs)
    rates = cells.select("rate", *[F.col(f).alias(f"__{f}") for f in FEATURES]).withColumnRenamed("rate", "__rate")
    out = bins.join(F.broadcast(rates), [f"__{f}" for f in FEATURES])
    n = copies(F.coalesce("doc_id", F.lit(NULL_ID)), F.col("__rate"))
    return out.withColumn("__n", n).where("__n > 0").withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n")))).select(*kept)

"""Operator 10: toxicity by nearest labelled examples under exact TF-IDF cosine.

A bounded, documented sample of labelled rows (`most_toxic` and `most_clean`, by a hash order of their ids,
whole texts) gives the examples; their words, all of them, are the terms. A word weighs (1 + log count) * idf *
relevance. idf comes from document frequencies over all documents; relevance lies between `base` and 1 and is
the share of a G-test's evidence, over the examples, that the word goes with label 1. So plain words count, and
two texts with different words have different vectors, but words that tell the labels apart count most: with
every relevance at 1 long noise hides a few insults (README has the figures).

Every document is searched in a block-max inverted index of the examples: postings lie in blocks of examples
with the largest weight of each term in each block; blocks are read in the order of their upper bounds, and no
block that could hold a nearer example is left out, so the neighbours are exact. Their votes, weighted by
similarity, pass a monotone calibration that is fitted on the examples without themselves, in a distributed
pass, and weighted back to the label counts of all labelled rows. Neighbours are returned as evidence.

Labels are learned only from rows whose crc32(doc_id as text) mod 5 is not 0. Scores use the text alone, so
equal texts have equal scores; ties of similarity go to the example that comes first in the index.

Cases: a null or empty text, and one without a word of any example, gets the share of toxic rows among all
labelled ones; very long texts are read whole, in slices of their words; a null label is no label; of repeated
labels of a doc_id the largest counts, and a doc_id that several rows share gives an example for each; without
any usable example all scores are 0; an empty table gives no rows; other columns, whatever their names, are
kept by `without_toxic` and not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, free_name, small_batches, table
from .words import Words, slices

#: Examples of a block, and the neighbours that vote.
BLOCK, NEAREST = 256, 15
#: A vote is the similarity to this power.
SHARPNESS = 2
_NO_WORD = re.compile(r"[^\w\s]+")
_ASCII = bytes(c if c >= 128 or chr(c).isalnum() or c == 0x5F else 0x20 for c in range(256)).lower()


def _bytes(text: str | None) -> bytes:
    """The text with one space for each character that is no part of a word."""
    if not text:
        return b""
    if not text.isascii():
        text = _NO_WORD.sub(" ", text.lower())
    else:
        text = text.lower()
    return text.encode("utf-8", "surrogatepass").translate(_ASCII)


def word_counts(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct word hashes in order, how often each) of each text."""
    raw = [_bytes(t) for t in texts]
    for a, b in slices(raw):
        w = Words(raw[a:b])
        for f, e in zip(w.first, w.last):
            yield np.unique(w.hash[f:e], return_counts=True)


def relevance(a: np.ndarray, b: np.ndarray, n1: int, n0: int, base: float = 0.05, full: float = 0.3) -> np.ndarray:
    """`base` to 1 for words in a of n1 toxic and b of n0 clean examples: 1 from G-test evidence of `full` for each toxic example on."""
    pa, pb, p = a / max(n1, 1), b / max(n0, 1), (a + b) / max(n1 + n0, 1)

    def part(c, m, p):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(c > 0, 2 * c * np.log(c / np.maximum(m * p, 1e-300)), 0.0)

    g = part(a, n1, p) + part(b, n0, p) + part(n1 - a, n1, 1 - p) + part(n0 - b, n0, 1 - p)
    tied = (g >= 12.0) & (pa > 3 * pb)
    return base + (1 - base) * np.where(tied, np.minimum(1.0, g / max(full * n1, 20.0)), 0.0)


@dataclass
class BlockMaxIndex:
    """Unit vectors of n examples as postings by term and block, and the largest weight of each term in each block."""

    n: int
    blocks: int
    row: np.ndarray
    weight: np.ndarray
    at: np.ndarray
    most: np.ndarray

    @classmethod
    def build(cls, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, n_terms: int) -> BlockMaxIndex:
        blocks = max(1, -(-n // BLOCK))
        order = np.lexsort((row, term))
        row, term, weight = row[order].astype(np.int32), term[order].astype(np.int64), weight[order].astype(np.float64)
        key = term * blocks + row // BLOCK
        most = np.zeros(n_terms * blocks, np.float32)
        np.maximum.at(most, key, np.nextafter(weight.astype(np.float32), np.float32(np.inf)))
        return cls(n, blocks, row, weight, np.searchsorted(key, np.arange(n_terms * blocks + 1)).astype(np.int32), most.reshape(n_terms, blocks))

    def _scores(self, terms: np.ndarray, weights: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """The cosine of each example in these blocks (0 elsewhere), added up in the order of terms."""
        if len(blocks) == self.blocks:
            lo, hi, w = self.at[terms * self.blocks], self.at[(terms + 1) * self.blocks], weights
        else:
            key = (terms[:, None] * self.blocks + blocks[None, :]).ravel()
            lo, hi, w = self.at[key], self.at[key + 1], np.repeat(weights, len(blocks))
        n = hi - lo
        some = n > 0
        lo, n, w = lo[some], n[some], w[some]
        ends = np.cumsum(n)
        place = np.repeat(lo - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)
        return np.bincount(self.row[place], self.weight[place] * np.repeat(w, n), self.n)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples with the largest cosines above 0, exactly: rows and cosines, by cosine and then row."""
        if not len(terms) or not self.n:
            return np.zeros(0, np.int64), np.zeros(0)
        bound = weights @ self.most[terms]
        order = np.argsort(-bound, kind="stable")
        first = np.sort(order[: 1 + k // BLOCK + (but >= 0)])
        score = self._scores(terms, weights, first)
        if but >= 0:
            score[but] = 0
        kth = np.partition(score, -k)[-k] if len(score) >= k else 0.0
        rest = np.setdiff1d(np.flatnonzero((bound * (1 + 1e-5) >= kth) & (bound > 0)), first)
        if len(rest):
            # every block that may hold a nearer example, each of its scores added in the same order
            score += self._scores(terms, weights, rest)
            if but >= 0:
                score[but] = 0
        rows = np.flatnonzero(score > 0)
        if len(rows) > 4 * k:
            kth = np.partition(score[rows], -k)[-k]
            rows = rows[score[rows] >= kth - 1e-11]
        best = np.lexsort((rows, -score[rows].round(12)))[:k]
        return rows[best], score[rows[best]]


@dataclass
class Scorer:
    """terms are sorted word hashes; worth is idf * relevance of each."""

    terms: np.ndarray
    worth: np.ndarray
    labels: np.ndarray
    ids: np.ndarray
    index: BlockMaxIndex
    prior: float
    knots: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.zeros(1))

    def vector(self, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, known = find(self.terms, words)
        w = (1 + np.log(counts[known])) * self.worth[at]
        size = np.sqrt(w @ w)
        return at, w / size if size else w

    def vote(self, words: np.ndarray, counts: np.ndarray, but: int = -1) -> tuple[float, np.ndarray]:
        rows, sims = self.index.nearest(*self.vector(words, counts), NEAREST, but)
        if not len(rows):
            return self.prior, rows
        w = sims**SHARPNESS
        return float(w @ self.labels[rows] / w.sum()), rows

    def score(self, words: np.ndarray, counts: np.ndarray) -> tuple[float, list[int]]:
        vote, rows = self.vote(words, counts)
        return float(np.interp(vote, *self.knots)) if len(rows) else self.prior, self.ids[rows[:3]].tolist()


def find(terms: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in sorted terms of the words that are there, a flag for each word)."""
    if not len(terms):
        return np.zeros(0, np.int64), np.zeros(len(words), bool)
    at = np.searchsorted(terms, words)
    known = terms[np.minimum(at, len(terms) - 1)] == words
    return at[known], known


def monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the weighted monotone fit of y on x (pool adjacent violators), to interpolate between."""
    pools: list[list[float]] = []
    # equal x are one point, so the order of rows doesn't matter
    at, which = np.unique(x.round(12), return_inverse=True)
    weight, yes = np.bincount(which, w, len(at)), np.bincount(which, y * w, len(at))
    for i in range(len(at)):
        pools.append([at[i] * weight[i], yes[i], weight[i]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    at, to = np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])
    return at, to


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def _examples(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, toxic, words, counts of the sampled rows with a text, numbered by `row` in the order of doc_id and words."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = list(word_counts(list(pdf["text"])))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "words": [w.view(np.int64) for w, _ in own], "counts": [n for _, n in own]})

    rows = docs.select("doc_id", "text").where(F.octet_length("text") > 0).join(F.broadcast(chosen), "doc_id")  # most_toxic + most_clean rows
    return table(rows.mapInPandas(counted, "doc_id long, toxic int, words array<bigint>, counts array<bigint>"), "toxic-examples")


def _document_frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """The documents that have each term, and how many documents there are."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)  # the words of the sample

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        df, n = np.zeros(len(own) + 1, np.int64), 0
        for pdf in batches:
            for words, _ in word_counts(list(pdf["text"])):
                df[find(own, words)[0]] += 1
                n += 1
        df[-1] = n
        found = np.flatnonzero(df)
        yield pd.DataFrame({"term": found, "n": df[found]})

    counts = docs.select("text").mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row for each term
    df = np.zeros(len(terms) + 1, np.int64)
    df[counts["term"].to_numpy()] = counts["n"].to_numpy()
    sent.destroy()
    return df[:-1], int(df[-1])


def train(docs: DataFrame, labels: DataFrame, most_toxic: int = 1000, most_clean: int = 2000) -> Scorer:
    spark = docs.sparkSession
    small_batches(spark)
    labelled = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    total = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    prior = total.get(1, 0) / max(1, sum(total.values()))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [labelled.where(F.col("toxic") == y).orderBy(*order).limit(n) for y, n in ((1, most_toxic), (0, most_clean))]
    examples = _examples(docs, picked[0].union(picked[1]).select("doc_id", F.col("toxic").cast("int").alias("toxic")))
    # the sample's word counts: numbers alone, no texts
    own = examples.toArrow()
    ids, y = own["doc_id"].to_numpy(), own["toxic"].to_numpy().astype(float)
    words, counts = (own[c].combine_chunks().flatten().to_numpy() for c in ("words", "counts"))
    sizes = np.asarray(own["words"].combine_chunks().value_lengths()) if len(ids) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(ids)), sizes)
    terms, term = np.unique(words.view(np.uint64), return_inverse=True)
    df, n_docs = _document_frequencies(docs, terms)
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    seen1 = np.bincount(term, y[row], len(terms))
    worth = np.log((1 + n_docs) / (1 + np.minimum(df, n_docs)) + 1e-9).clip(0.01) * relevance(seen1, np.bincount(term, minlength=len(terms)) - seen1, n1, n0)
    weight = (1 + np.log(counts)) * worth[term]
    weight /= np.sqrt(np.bincount(row, weight**2, max(len(ids), 1)))[row]
    # examples with the same main term lie in the same blocks
    best = np.lexsort((term, -weight, row))
    first = best[np.searchsorted(row[best], np.arange(len(ids)))] if len(row) else np.zeros(0, np.int64)
    main = np.full(len(ids), -1), np.zeros(len(ids))
    has = sizes > 0
    main[0][has], main[1][has] = term[first[has]], weight[first[has]]
    at = np.lexsort((ids, -main[1], main[0]))
    place = np.empty(len(ids), np.int64)
    place[at] = np.arange(len(ids))
    index = BlockMaxIndex.build(place[row], term, weight, len(ids), len(terms))
    out = Scorer(terms, worth, y[at], ids[at], index, prior)
    if len(ids):
        sent = spark.sparkContext.broadcast(out)  # bounded by the sample

        def without_itself(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = sent.value
            for pdf in batches:
                votes = []
                for i, w, n in zip(pdf["doc_id"], pdf["words"], pdf["counts"]):
                    same = np.flatnonzero(own.ids == i)
                    votes.append(own.vote(np.asarray(w, np.int64).view(np.uint64), np.asarray(n), int(same[0]))[0])
                yield pd.DataFrame({"vote": votes, "toxic": pdf["toxic"]})

        parts = max(1, min(len(ids) // 16, spark.sparkContext.defaultParallelism))
        votes = examples.repartition(parts).mapInPandas(without_itself, "vote double, toxic int").toArrow()  # a row for each example
        x, y = votes["vote"].to_numpy(), votes["toxic"].to_numpy().astype(float)
        out.knots = monotone(x, y, np.where(y == 1, total.get(1, 0) / max(1, n1), total.get(0, 0) / max(1, n0)))
        sent.destroy()
    discard(examples)
    return out


def scored(docs: DataFrame, labels: DataFrame, to: str, **options) -> DataFrame:
    """docs with `to`: a struct of the text's score and evidence (up to three doc_ids of examples, nearest first)."""
    scorer = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **options))  # bounded by the sample

    @F.pandas_udf("score double, evidence array<bigint>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = scorer.value
        for texts in batches:
            found = [own.score(*w) for w in word_counts(list(texts))]
            yield pd.DataFrame({"score": [s for s, _ in found], "evidence": [e for _, e in found]})

    return docs.withColumn(to, run("text"))


def toxicity_report(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    out = scored(docs.select("doc_id", "text"), labels, "s", **options)
    score = F.col("s.score")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), F.col("s.evidence").alias("evidence"))


def without_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without the rows that are predicted toxic."""
    to = free_name(docs, "scored")
    return scored(docs, labels, to, **options).where(F.col(f"{to}.score") < 0.5).drop(to)

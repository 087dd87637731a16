"""Operator 9: near-dedup by improved consistent weighted sampling over TF-IDF shingles.

A text is lower-cased and split at white space; its shingles are five words in a row (fewer words: all of
them). A shingle weighs its count times the mean idf of its words. idf is 1 + log(documents / documents with the
word) / log(RARE), between 1 and 2, so it follows from a word's share of the documents and is alike at every
size; shares come from counts over all documents in a table of fixed size, addressed by the word's hash, so
what is sent to executors doesn't grow. (Words that fall into one cell add up; a cell of rare words alone stays
under one in RARE.) Improved consistent weighted sampling (Ioffe) draws `bands * rows` samples whose chance to
agree is the weighted Jaccard similarity; texts that agree in a whole band are candidates and are linked only
when their exact weighted Jaccard similarity is at least `similarity`.

Rows with equal texts are one class from the start. Buckets with the same texts are one. In each bucket every
text is first compared with one pivot, if their total weights allow the similarity: a text travels once for
each pivot, and a pivot's text once for each of its salted groups. Buckets whose texts are then still in
different components are finished exactly: their texts are dealt into blocks by total weight, and every two
blocks whose weights allow the similarity are compared as wholes, by sums of shared weights, except for what
the bucket's largest component has inside. So no link in a bucket is left out, and misses are left to the
chance of the samples alone, of which the tests and the README give figures. Work in a bucket that stays mixed
grows with the square of its members.

Cases: null and empty texts are equal texts of one class, and other texts without words are equal only if they
are the same; very long texts take their samples in
slices of shingles; ties go to the smallest doc_id; rows that share a doc_id but not the text are compared as
texts of their own, and repeated rows are equal texts; a null doc_id is the smallest id; an empty table gives
no rows; other columns, whatever their names, are kept by `keep_one` and not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .line_dedup import U64, mix
from .shared import NULL_ID, collect_garbage, components, discard, free_name, runtime_filter, small_batches, table
from .words import Words, chained, runs, slices

SHINGLE = 5
BUCKETS = 1 << 18
_DRAWS = 1 << 16
#: A word in fewer than one of so many documents has the largest idf.
RARE = 1024
#: Texts and bytes of a block of a mixed bucket, and shared weights summed at once.
BLOCK, BLOCK_BYTES, COLUMNS = 256, 2 << 20, 1024
#: Texts and bytes that are compared with one copy of a pivot.
STAR, STAR_BYTES = 512, 16 << 20


def _bucket(words: np.ndarray) -> np.ndarray:
    return (words >> U64(64 - 18)).astype(np.int64)


def _encoded(texts) -> list[bytes]:
    return [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """For each word bucket the documents that have a word in it, and, last, the number of documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(BUCKETS + 1, np.int64)
        for pdf in batches:
            texts = _encoded(pdf["text"])
            df[-1] += len(texts)
            for a, b in slices(texts):
                w = Words(texts[a:b])
                at = _bucket(w.hash)
                for f, e in zip(w.first, w.last):
                    df[np.unique(at[f:e])] += 1
        found = np.flatnonzero(df)
        yield pd.DataFrame({"bucket": found, "n": df[found]})

    rows = docs.select("text").mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS + 1 rows at most
    out = np.zeros(BUCKETS + 1)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def idf_table(df: np.ndarray) -> np.ndarray:
    share = np.maximum(df[:-1], 1) / max(df[-1], 1.0)
    return (1 - np.log(share.clip(1 / RARE, 1)) / np.log(RARE)).astype(np.float32)


class Shingles:
    """The distinct shingle hashes of each text with their weights."""

    def __init__(self, texts: list[bytes], idf: np.ndarray):
        w = Words(texts)
        grams, weigh = runs(w.hash, SHINGLE), idf[_bucket(w.hash)].astype(np.float64)
        means = window_means(weigh, SHINGLE) if len(weigh) >= SHINGLE else weigh[:0]
        self.hash, self.weight = [], []
        for f, e in zip(w.first, w.last):
            if e - f >= SHINGLE:
                h, v = grams[f : e - SHINGLE + 1], means[f : e - SHINGLE + 1]
            elif e > f:
                h, v = runs(w.hash[f:e], e - f), window_means(weigh[f:e], e - f)
            else:
                h, v = grams[:0], weigh[:0]
            own, at, n = np.unique(h, return_index=True, return_counts=True)
            self.hash.append(own)
            self.weight.append(n * v[at])


def window_means(x: np.ndarray, n: int) -> np.ndarray:
    """Means of each n values in a row, added in one order, so that equal windows have equal means in any text."""
    out = x[: len(x) - n + 1].copy()
    for i in range(1, n):
        out += x[i : len(x) - n + 1 + i]
    return out / n


class Sampler:
    """Improved consistent weighted samples: for each shingle and sample, draws of r, c (gamma, shape 2) and beta
    (uniform) fixed by the shingle's hash; the shingle with the least a wins, together with its level t."""

    def __init__(self, samples: int, seed: int = 1):
        g = np.random.Generator(np.random.PCG64(seed))
        self.odd = g.integers(0, 2**63, samples, dtype=np.uint64) * U64(2) + U64(1)
        self.r = g.gamma(2, 1, _DRAWS).astype(np.float32)
        self.beta = g.random(_DRAWS, dtype=np.float32)
        self.log_c = np.log(g.gamma(2, 1, _DRAWS)).astype(np.float32)

    def samples(self, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        best, won = np.full(len(self.odd), np.inf, np.float32), np.zeros(len(self.odd), np.uint64)
        log_w = np.log(weights).astype(np.float32)
        with np.errstate(over="ignore"):
            for i in range(0, len(hashes), 1024):
                h = hashes[i : i + 1024]
                z = h[:, None] * self.odd[None, :]
                at = (z >> U64(48)).astype(np.int32)
                r, beta = self.r[at], self.beta[at]
                t = np.floor(log_w[i : i + 1024, None] / r + beta)
                log_a = self.log_c[((z >> U64(32)) & U64(_DRAWS - 1)).astype(np.int32)] - r * (t - beta + 1)
                k = log_a.argmin(0)
                cols = np.arange(len(self.odd))
                low = log_a[k, cols]
                better = low < best
                sig = chained(h[k], t[k, cols].astype(np.int64).view(np.uint64), 9)
                won, best = np.where(better, sig, won), np.where(better, low, best)
        return won


def signatures(docs: DataFrame, idf, bands: int, rows: int) -> DataFrame:
    """id, at (a hash of the text as it is), k1, k2 (128-bit key of the lower-cased text), keys (of the bands; none where there is no word), weight (of all shingles), bytes for each row of docs."""
    sampler = Sampler(bands * rows)

    def band_keys(h, w) -> np.ndarray:
        own = sampler.samples(h, w).reshape(bands, rows)
        out = np.arange(bands, dtype=np.uint64)
        for k in range(rows):
            out = chained(own[:, k], out, 20 + k)
        return out.view(np.int64)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = _encoded(pdf["text"])
            keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t) for t in texts), np.int64).reshape(-1, 2)
            out, sums = [], []
            for a, b in slices(texts):
                s = Shingles(texts[a:b], idf.value)
                sums += [float(w.sum()) for w in s.weight]
                out += [band_keys(h, w) if len(h) else np.zeros(0, np.int64) for h, w in zip(s.hash, s.weight)]
            yield pd.DataFrame({"id": pdf["id"], "at": pdf["at"], "k1": keys[:, 0], "k2": keys[:, 1], "keys": out, "weight": sums, "bytes": [len(t) for t in texts]})

    return _base(docs).mapInPandas(sign, "id long, at long, k1 long, k2 long, keys array<bigint>, weight double, bytes long")


def _base(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.xxhash64("text").alias("at"), "text")


def weighted_jaccard(h1, w1, h2, w2) -> float:
    _, a, b = np.intersect1d(h1, h2, assume_unique=True, return_indices=True)
    both = np.minimum(w1[a], w2[b]).sum()
    either = w1.sum() + w2.sum() - both
    return float(both / either) if either > 0 else 0.0


def _stars(members: DataFrame, texts: DataFrame, idf, similarity: float) -> DataFrame:
    """Links (a, b) between the texts of a bucket and its pivot.

    Texts come to their pivot's group behind one copy of the pivot's text, so a worker holds one pivot at a time.
    """
    least = similarity - 1e-6
    near = (F.col("weight") >= least * F.col("pivot.weight")) & (F.col("pivot.weight") >= least * F.col("weight"))
    pairs = members.where((F.col("uid") != F.col("pivot.uid")) & near).groupBy(F.col("pivot.uid").alias("a"), F.col("uid").alias("b")).agg(F.first("bytes").alias("bytes"))
    sizes = pairs.groupBy("a").agg(F.greatest(F.ceil(F.count("*") / STAR), F.ceil(F.sum("bytes") / STAR_BYTES), F.lit(1)).cast("int").alias("salts"))
    pairs = table(pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt")), "near-stars")
    own = pairs.select("a", "salt").distinct().select("a", "salt", F.lit(0).alias("side"), F.col("a").alias("uid"))
    rows = own.union(pairs.select("a", "salt", F.lit(1), "b")).join(texts, "uid")
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "side")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivot, own = None, None
        for pdf in batches:
            raw, sides, ids, out = _encoded(pdf["text"]), pdf["side"].to_numpy(), pdf["uid"].to_numpy(), []
            for x, y in slices(raw):
                s = Shingles(raw[x:y], idf.value)
                for i, h, w in zip(range(x, y), s.hash, s.weight):
                    if sides[i] == 0:
                        pivot, own = ids[i], (h, w)
                    elif weighted_jaccard(*own, h, w) >= similarity - 1e-9:
                        out.append((pivot, ids[i]))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return rows.select("side", "uid", "text").mapInPandas(check, "a long, b long")


def shared_weights(hashes: list[np.ndarray], weights: list[np.ndarray], n: int) -> np.ndarray:
    """The summed smaller weights of shared shingles, for each of the first n texts and each of the others (n = 0: for every two of all texts; the diagonal means nothing)."""
    texts = len(hashes)
    row, h, w = np.repeat(np.arange(texts), [len(x) for x in hashes]), np.concatenate(hashes), np.concatenate(weights)
    _, col = np.unique(h, return_inverse=True)
    out = np.zeros((n or texts, texts - n))
    # a layer: the least weight that is left of a shingle, taken off all texts that have it
    while len(col):
        left, right = (row < n, row >= n) if n else (row >= 0, row >= 0)
        many = np.bincount(col) > 1
        if n:
            many &= (np.bincount(col[left], minlength=len(many)) > 0) & (np.bincount(col[right], minlength=len(many)) > 0)
        keep = many[col]
        row, w = row[keep], w[keep]
        _, col = np.unique(col[keep], return_inverse=True)
        if not len(col):
            break
        order = np.argsort(col, kind="stable")
        row, col, w = row[order], col[order], w[order]
        least = np.minimum.reduceat(w, np.searchsorted(col, np.arange(col[-1] + 1)))
        for i in range(0, len(least), COLUMNS):
            lo, hi = np.searchsorted(col, [i, i + COLUMNS])
            part = np.zeros((texts, COLUMNS))
            part[row[lo:hi], col[lo:hi] - i] = np.sqrt(least[col[lo:hi]])
            out += part[: n or texts] @ part[n:].T
        w = w - least[col]
        keep = w > 1e-12
        row, col, w = row[keep], col[keep], w[keep]
    return out


def block_links(ids, parts, hashes: list[np.ndarray], weights: list[np.ndarray], n: int, similarity: float) -> list[tuple[int, int]]:
    """Links between texts of different components `parts`, of which all others follow; n as in shared_weights."""
    root = {p: p for p in parts}

    def top(p):
        while root[p] != p:
            root[p] = p = root[root[p]]
        return p

    both, sums = shared_weights(hashes, weights, n), np.array([w.sum() for w in weights])
    near = both >= (similarity - 1e-6) * (sums[: n or len(sums), None] + sums[None, n:] - both)
    parts_ = np.asarray(parts)
    out = []
    for i, j in zip(*np.nonzero(near & (parts_[: n or len(sums), None] != parts_[None, n:]))):
        j = j + n
        x, y = top(parts[i]), top(parts[j])
        if x != y and weighted_jaccard(hashes[i], weights[i], hashes[j], weights[j]) >= similarity - 1e-9:
            root[x] = y
            out.append((int(ids[i]), int(ids[j])))
    return out


def _finished(members: DataFrame, texts: DataFrame, labels: DataFrame, idf, similarity: float) -> DataFrame:
    """Links (a, b) between components in mixed buckets, all of them or such that the others follow."""
    large = members.where("n > 2").join(labels, "uid", "left").withColumn("c", F.coalesce("component", "uid"))
    each = large.groupBy("bucket", "c").agg(F.count("*").alias("own"))
    per = each.groupBy("bucket").agg(F.max_by("c", F.struct("own", "c")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("bucket", "main")
    dealt = large.join(per, "bucket").withColumn("inner", F.col("c") == F.col("main"))
    w = Window.partitionBy("bucket", "inner").orderBy("weight", "uid")
    at = F.floor((F.row_number().over(w) - 1) / BLOCK) + F.floor(F.sum("bytes").over(w) / BLOCK_BYTES)
    dealt = table(dealt.select("bucket", "uid", "c", "inner", "weight", at.alias("block")), "near-dealt")
    blocks = dealt.groupBy("bucket", "inner", "block").agg(F.min("weight").alias("lo"), F.max("weight").alias("hi"))
    x = blocks.select("bucket", *[F.col(c).alias(f"x_{c}") for c in ("inner", "block", "lo", "hi")])
    y = blocks.select("bucket", *[F.col(c).alias(f"y_{c}") for c in ("inner", "block", "lo", "hi")])
    order = F.struct("x_inner", "x_block") <= F.struct("y_inner", "y_block")
    least = similarity - 1e-6
    two = x.join(y, "bucket").where(order & ~(F.col("x_inner") & F.col("y_inner")) & (F.col("x_hi") >= least * F.col("y_lo")) & (F.col("y_hi") >= least * F.col("x_lo")))
    two = two.select("bucket", *[f"{s}_{c}" for s in "xy" for c in ("inner", "block")])
    side = lambda s, k: two.select("*", F.lit(k).alias("side"), F.col(f"{s}_inner").alias("inner"), F.col(f"{s}_block").alias("block"))
    same = (F.col("x_inner") == F.col("y_inner")) & (F.col("x_block") == F.col("y_block"))
    sides = side("x", 0).union(side("y", 1).where(~same))
    rows = sides.join(dealt, ["bucket", "inner", "block"]).join(texts, "uid")
    key = ["bucket", "x_inner", "x_block", "y_inner", "y_block"]

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "uid"])
        raw, hashes, weights = _encoded(pdf["text"]), [], []
        for a, b in slices(raw):
            s = Shingles(raw[a:b], idf.value)
            hashes, weights = hashes + s.hash, weights + s.weight
        n = int((pdf["side"] == 0).sum())
        found = block_links(pdf["uid"].tolist(), pdf["c"].tolist(), hashes, weights, n if n < len(pdf) else 0, similarity)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return rows.select(*key, "side", "uid", "c", "text").groupBy(*key).applyInPandas(compare, "a long, b long")


def _members(own: DataFrame) -> DataFrame:
    """uid, weight, bytes, bucket of the texts that share a bucket with another; n, how many do, and pivot, one of them.

    Of buckets with the same texts (by number, first text and two sums of hashes) one is left.
    """
    all_ = own.select("uid", "weight", "bytes", F.explode("keys").alias("bucket"))
    mix_ = lambda seed: F.sum(F.shiftright(F.xxhash64("uid", F.lit(seed)), 20))
    sizes = all_.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct("uid", "weight")).alias("pivot"), mix_(1).alias("s1"), mix_(2).alias("s2")).where("n > 1")
    one = sizes.groupBy("n", "pivot", "s1", "s2").agg(F.min("bucket").alias("bucket")).select("bucket", "n", "pivot")
    return all_.join(one, "bucket")


def near_duplicates(docs: DataFrame, similarity: float = 0.8, bands: int = 12, rows: int = 4) -> DataFrame:
    """id, class_id for each row of docs; class_id is the smallest id among the texts that links reach."""
    spark = docs.sparkSession
    small_batches(spark)
    idf = spark.sparkContext.broadcast(idf_table(document_frequencies(docs)))  # BUCKETS floats
    signed = table(signatures(docs, idf, bands, rows), "near-signatures")
    # a vertex is a distinct text
    own = signed.groupBy("k1", "k2").agg(F.min(F.struct("id", "at")).alias("rep"), *[F.first(c).alias(c) for c in ("keys", "weight", "bytes")])
    own = table(own.withColumn("uid", F.monotonically_increasing_id()), "near-texts")
    members = table(_members(own), "near-members")
    wanted = members.select("uid").distinct().join(own.select("uid", "rep.id", "rep.at"), "uid")
    wanted = table(wanted, "near-wanted")
    # texts without a partner stay where they are, for the most part
    with runtime_filter(spark, wanted.count()):
        found = _base(docs).join(wanted.where(F.col("uid") >= 0), ["id", "at"])
        texts = table(found.dropDuplicates(["id", "at"]).select("uid", "text"), "near-candidates")
    discard(wanted)
    collect_garbage(spark)
    found = table(_stars(members, texts, idf, similarity), "near-links")
    # label: the component of each text that has links so far
    labels = components(found, "a", "b").withColumnRenamed("v", "uid")
    collect_garbage(spark)
    more = table(_finished(members, texts, labels, idf, similarity), "near-links")
    discard(texts, members)
    idf.destroy()
    if more.limit(1).count():
        labels = components(found.union(more), "a", "b").withColumnRenamed("v", "uid")
    collect_garbage(spark)
    classes = own.select("k1", "k2", "uid", "rep.id").join(labels, "uid", "left").withColumn("c", F.coalesce("component", "uid"))
    least = classes.groupBy("c").agg(F.min("id").alias("class_id"))
    classes = classes.join(least, "c").select("k1", "k2", "class_id")
    return signed.select("id", "k1", "k2").join(classes, ["k1", "k2"]).select("id", "class_id")


def near_duplicate_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, kept for each row of docs."""
    out = near_duplicates(docs, **options)
    known = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(known("id").alias("doc_id"), known("class_id").alias("class_id"), (F.col("id") == F.col("class_id")).alias("kept"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs whose id is the smallest of its class."""
    to = free_name(docs, "id")
    kept = near_duplicates(docs, **options).where("id = class_id").select(F.col("id").alias(to)).distinct()
    return docs.join(kept, F.coalesce(docs["doc_id"], F.lit(NULL_ID)) == kept[to], "left_semi")

"""Operator 6: substring dedup over prefix-partitioned suffix trees.

Suffixes are those that start at a word with 50 words to come. Sending each of them with its words would be
many times the input, so suffixes are anchored: of the 16-word runs in a suffix's first 50 words the one with the
least hash (the leftmost of equals) is its anchor. Equal 50-word beginnings have equal anchors at equal places,
and neighbours mostly share one, so they travel as one short stretch of words. The trees are partitioned by the
words that stand at the anchor, as a prefix of 16 words. Prefixes of one document alone are left out after a
count, as their subtrees have no leaves of two documents; those shared by up to `most_shared` stretches are put
together to groups that fit a task. Each group gets its suffix tree, as a suffix array with the lengths of common
beginnings, over words that are named by content; the topmost internal nodes of depth 50 or more are the
repeats: leaves of all but the smallest doc_id are marked, and marked neighbours make maximal ranges. A prefix
that too many stretches share is lengthened: equal stretches (by a 128-bit hash) are put together, and what is
left is dealt by each suffix's own 50 words, whose nodes are counted by map-side combined aggregation instead.

Documents with the same words as one with a smaller doc_id lose them all without a tree, if they have 50.
The words that marked suffixes cover are removed; marks are made on the input, never on what is left.

Cases: null, empty and short texts have no suffix and keep all words; a very long text is read whole, by itself,
so a worker needs memory for its longest text; of equal texts the smallest doc_id keeps its words, rows with the
same doc_id do not mark each other, and a null doc_id is the smallest; an empty table gives no rows; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .line_dedup import mix
from .shared import NULL_ID, collect_garbage, discard, runtime_filter, small_batches, table
from .words import Words, chained, runs, slices

DEPTH, PREFIX = 50, 16


def prefixes(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, first, count, anchor) of each stretch of suffixes with one prefix; first and anchor are words of the text."""
    none = np.zeros(0, np.int64)
    grams = runs(w.hash, PREFIX)
    span = DEPTH - PREFIX + 1
    n = len(w.hash) - DEPTH + 1
    if n <= 0:
        return none, none.view(np.uint64), none, none, none
    at, m = np.arange(len(grams)), 1
    pick = lambda a, b: np.where(grams[b] < grams[a], b, a)
    while m * 2 <= span:
        at = pick(at[:-m], at[m:])
        m *= 2
    at = pick(at[:n], at[span - m : span - m + n])
    text = np.repeat(np.arange(w.texts), w.last - w.first)[:n]
    inside = np.arange(n) + DEPTH <= w.last[text]
    starts = np.flatnonzero(inside)
    if not len(starts):
        return none, none.view(np.uint64), none, none, none
    new = np.concatenate([[True], (at[starts[1:]] != at[starts[:-1]]) | (text[starts[1:]] != text[starts[:-1]]) | (np.diff(starts) != 1)])
    first = starts[new]
    count = np.diff(np.append(np.flatnonzero(new), len(starts)))
    t = text[first]
    return t, grams[at[first]], first - w.first[t], count, at[first] - w.first[t]


def _joined(w: Words, first: int, last: int) -> bytes:
    return b" ".join(w.raw[s:e].tobytes() for s, e in zip(w.start[first:last].tolist(), w.end[first:last].tolist()))


def _sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def _texts(column: pd.Series) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column]


def _survey(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = _texts(pdf["text"])
        for a, b in slices(texts):
            w, out = Words(texts[a:b]), []
            t, h, first, count, _ = prefixes(w)
            ends = np.searchsorted(t, np.arange(b - a + 1))
            for i in range(b - a):
                x, y = ends[i], ends[i + 1]
                out.append((int(w.last[i] - w.first[i]), _sha(_joined(w, w.first[i], w.last[i])), h[x:y].view(np.int64), first[x:y], count[x:y]))
            yield pd.DataFrame({"id": pdf["id"][a:b].to_numpy(), "key": pdf["key"][a:b].to_numpy(), **dict(zip(("n_words", "sha", "h", "first", "count"), map(list, zip(*out))))})


class SuffixTree:
    """The suffix tree of sequences of words, down to `depth` words, as a sorted array of suffixes and the length of
    the beginning that each shares with the one before it. Words are named by content."""

    def __init__(self, sequences: list[bytes], counts: np.ndarray, depth: int = DEPTH):
        known: dict[bytes, int] = {}
        words = [w for s in sequences for w in s.split(b" ")]
        names = [np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))]
        sizes = np.array([s.count(b" ") + 1 for s in sequences], np.int64)
        # names[k][i]: the rank of the 2^k words from i on; equal exactly where the words are
        while 2 << (len(names) - 1) <= depth:
            half, m = names[-1], 1 << (len(names) - 1)
            names.append(np.unique(half[:-m].astype(np.int64) << 32 | half[m:], return_inverse=True)[1].astype(np.int32))
        self.names, self.depth = names, depth
        first = np.cumsum(sizes) - sizes
        #: Where the suffixes start, `counts` of them in each sequence.
        self.start = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        top = 1 << (len(names) - 1)
        self.order = np.lexsort((names[-1][self.start + depth - top], names[-1][self.start]))
        at = self.start[self.order]
        self.shared = np.zeros(len(at), np.int64)
        for k in range(len(names) - 1, -1, -1):
            m = 1 << k
            go = np.flatnonzero(self.shared[1:] + m <= depth) + 1
            same = names[k][at[go] + self.shared[go]] == names[k][at[go - 1] + self.shared[go]]
            self.shared[go[same]] += m

    def nodes(self, depth: int) -> np.ndarray:
        """For each suffix its topmost node of at least that depth; a node of one leaf has a number of its own."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(self.shared < depth) - 1
        return out


def deep_marks(stretches: list[bytes], ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For suffixes (counts of them at the beginning of each stretch): is there a leaf of a smaller id under the node at depth 50?"""
    node, who = SuffixTree(stretches, counts).nodes(DEPTH), np.repeat(ids, counts)
    least = np.full(node.max() + 1 if len(node) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, node, who)
    return who > least[node]


def _ranges(marks: np.ndarray, first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, first word, end word) of runs of marked suffixes."""
    owner = np.repeat(np.arange(len(counts)), counts)
    word = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(len(owner))
    on = np.flatnonzero(marks)
    if not len(on):
        return on, on, on
    cut = np.flatnonzero((np.diff(on) != 1) | (owner[on[1:]] != owner[on[:-1]])) + 1
    heads, tails = on[np.concatenate([[0], cut])], on[np.concatenate([cut - 1, [len(on) - 1]])]
    return owner[heads], word[heads], word[tails] + DEPTH


def _subtrees(pdf: pd.DataFrame) -> pd.DataFrame:
    ids, counts = pdf["id"].to_numpy(), pdf["count"].to_numpy().astype(np.int64)
    own, lo, hi = _ranges(deep_marks(list(pdf["words"]), ids, counts), pdf["first"].to_numpy().astype(np.int64), counts)
    return pd.DataFrame({"id": ids[own], "key": pdf["key"].to_numpy()[own], "lo": lo, "hi": hi})


def repeated_ranges(docs: DataFrame, group_rows: int = 8192, most_shared: int = 256) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(survey, copies, candidates, ranges): all rows with word counts, those that lose all words, texts with shared prefixes, and word ranges to remove."""
    spark, text = docs.sparkSession, F.coalesce("text", F.lit(""))
    small_batches(spark)
    base = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    survey = table(base.mapInPandas(_survey, "id long, key long, n_words long, sha string, h array<bigint>, first array<int>, count array<int>"), "substring-survey")
    whole = survey.where(F.col("n_words") >= DEPTH).select("id", "key", "n_words", "sha")
    least = whole.groupBy("sha").agg(F.min("id").alias("id"))
    copies = table(whole.join(least, ["sha", "id"], "left_anti").select("id", "key", "n_words").distinct(), "substring-copies")
    each = survey.join(copies, ["id", "key"], "left_anti").select("id", "key", F.explode(F.arrays_zip("h", "first", "count")).alias("s")).select("id", "key", "s.*")
    shared = each.groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("sharing")).where("a <> b").select("h", "sharing")
    shared = table(shared, "substring-shared")
    found = each.join(shared, "h").groupBy("id", "key").agg(F.collect_list(F.struct("h", "sharing", "first", "count")).alias("s"))  # at most the stretches of one text
    found = table(found, "substring-found")
    # texts without a shared prefix stay where they are, for the most part
    with runtime_filter(spark, found.count()):
        candidates = table(base.join(found.where(F.size("s") > 0), ["id", "key"]).dropDuplicates(["id", "key"]), "substring-texts")
    discard(shared, found)
    collect_garbage(spark)

    def stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = _texts(pdf["text"])
            rows = list(zip(pdf["id"], pdf["key"], pdf["h"], pdf["sharing"], pdf["first"], pdf["count"]))
            # what a slice of texts gives is sent before the next one is read
            for a, b in slices(texts):
                w, out = Words(texts[a:b]), []
                deep = [runs(w.hash, DEPTH), runs(mix(w.hash, 11), DEPTH)]
                for i, (doc, key, *own) in enumerate(rows[a:b]):
                    for h, sharing, first, n in zip(*own):
                        x = w.first[i] + first
                        if sharing <= most_shared:
                            out.append((doc, key, h, first, n, _joined(w, x, x + n + DEPTH - 1), None, None, 0, 0))
                        else:
                            # its first and last 50 words are all of a stretch
                            whole = [int(chained(d[x : x + 1], d[x + n - 1 : x + n], 60 + int(n)).view(np.int64)[0]) for d in deep]
                            out.append((doc, key, h, first, n, None, *(d[x : x + n].view(np.int64) for d in deep), *whole))
                yield pd.DataFrame(out, columns=["id", "key", "h", "first", "count", "words", "d1", "d2", "c1", "c2"])

    own = [F.col(f"s.{c}").alias(c) for c in ("h", "sharing", "first", "count")]
    rows = table(candidates.select("id", "key", "text", *own).mapInPandas(stretches, "id long, key long, h long, first int, count int, words binary, d1 array<bigint>, d2 array<bigint>, c1 long, c2 long"), "substring-stretches")
    cold = rows.where("words is not null")
    groups = max(1, -(-cold.count() // group_rows))
    marked = cold.withColumn("group", F.pmod("h", F.lit(groups))).groupBy("group").applyInPandas(_subtrees, "id long, key long, lo int, hi int")
    hot = rows.where("words is null")
    # equal stretches first: all but those of the smallest id are marked as wholes; no join has a hot key, as ids are in it
    one = hot.groupBy("c1", "c2").agg(F.min("id").alias("id"))
    same = hot.select("id", "key", "first", "count", "c1", "c2").join(one, ["c1", "c2", "id"], "left_anti").select("id", "key", F.col("first").alias("lo"), (F.col("first") + F.col("count") - 1 + DEPTH).alias("hi"))
    hot = table(hot.join(one, ["c1", "c2", "id"], "left_semi"), "substring-distinct")
    windows = hot.select("id", "key", "first", F.posexplode(F.arrays_zip("d1", "d2")).alias("at", "d")).select("id", "key", "first", "at", "d.d1", "d.d2")
    least = windows.groupBy("d1", "d2").agg(F.min("id").alias("id"))
    # of the others the leaves that stay are found, by node and id
    stay = windows.join(least, ["d1", "d2", "id"], "left_semi").groupBy("id", "key", "first").agg(F.collect_set("at").alias("stay"))  # at most the windows of a stretch
    deep = hot.select("id", "key", "first", "count").join(stay, ["id", "key", "first"], "left")
    gone = F.filter(F.sequence(F.lit(0), F.col("count") - 1), lambda i: F.col("stay").isNull() | ~F.array_contains("stay", i))
    heads = F.filter("gone", lambda i: ~F.array_contains("gone", i - 1))
    tails = F.filter("gone", lambda i: ~F.array_contains("gone", i + 1))
    deep = deep.withColumn("gone", gone).select("id", "key", "first", F.explode(F.arrays_zip(heads.alias("lo"), tails.alias("hi"))).alias("r"))
    deep = deep.select("id", "key", (F.col("first") + F.col("r.lo")).alias("lo"), (F.col("first") + F.col("r.hi") + DEPTH).alias("hi"))
    # tables of their own, so that a skewed join is split by itself
    ranges = table(marked, "substring-ranges").union(table(deep, "substring-hot")).union(table(same, "substring-same"))
    discard(rows, hot)
    collect_garbage(spark)
    return survey, copies, candidates, ranges


def _kept(text: bytes, ranges: Iterable[tuple[int, int]]) -> tuple[int, bytes]:
    """How many words the ranges cover, and the other words joined by one space."""
    words = text.split()
    edge = np.zeros(len(words) + 1, np.int64)
    for lo, hi in ranges:
        edge[lo] += 1
        edge[hi] -= 1
    gone = np.cumsum(edge)[:-1] > 0
    return int(gone.sum()), b" ".join(w for w, g in zip(words, gone.tolist()) if not g)


def without_repeats(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(survey, changed): all rows by id and key with n_words and sha; of texts that lose words, n_removed, kept (text) and its sha."""
    survey, copies, candidates, ranges = repeated_ranges(docs, **options)
    own = ranges.groupBy("id", "key").agg(F.collect_list(F.struct("lo", "hi")).alias("r"))  # at most the suffixes of one text

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [_kept(t, zip(lo, hi)) for t, lo, hi in zip(_texts(pdf["text"]), pdf["lo"], pdf["hi"])]
            yield pd.DataFrame({"id": pdf["id"], "key": pdf["key"], "n_removed": [n for n, _ in out], "kept": [k.decode("utf-8", "surrogatepass") for _, k in out], "sha_kept": [_sha(k) for _, k in out]})

    changed = candidates.select("id", "key", "text").join(own.select("id", "key", "r.lo", "r.hi"), ["id", "key"]).mapInPandas(cut, "id long, key long, n_removed long, kept string, sha_kept string")
    gone = copies.select("id", "key", F.col("n_words").alias("n_removed"), F.lit("").alias("kept"), F.lit(_sha(b"")).alias("sha_kept"))
    return survey, changed.union(gone)


def substring_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of docs."""
    survey, changed = without_repeats(docs, **options)
    out = survey.select("id", "key", "n_words", "sha").join(changed.drop("kept"), ["id", "key"], "left")
    doc_id = F.when(F.col("id") != NULL_ID, F.col("id"))
    return out.select(doc_id.alias("doc_id"), "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("sha_kept", "sha").alias("kept_sha256"))

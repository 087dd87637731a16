"""Operator 2: line dedup by a sharded minimal perfect hash.

Lines are split at \\n; a line's key is the line stripped of [\\x20\\x09-\\x0D] and with A-Z lower-cased. One
map-side combined aggregation counts the documents of each key (128-bit hash of it) and keeps the largest
doc_id. The keys that repeat enough are dealt to shards; each shard is a minimal perfect hash (levels of bit
arrays with ranks) onto compact arrays of fingerprints, counts and keepers. Documents then probe the arrays
with the hashes of their own lines; no line is joined and no text is shuffled.

Arrays of at most `broadcast_bytes` in all, a size that is checked, go to every executor, and documents are read
once. Larger ones stay where they are: the hashes of all long lines go to their shard's task in one shuffle,
behind the shard's arrays, and the hits of a document come together by its row. A shard with over a thousandth
of all lines is dealt to several tasks, each with a copy of its arrays. Both ways give the same rows.

Cases: a null or empty text is one empty line; a null doc_id is the smallest id; a key that a document
repeats counts once for it, and the keeper keeps all its own repeats; an empty table gives no rows; other
columns, whatever their names, are kept by `dedup_lines` and not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import NULL_ID, SPACES, ascii_lower, collect_garbage, discard, small_batches, table

U64 = np.uint64


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        z = x + U64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        z = (z ^ (z >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> U64(27))) * U64(0x94D049BB133111EB)
        return z ^ (z >> U64(31))


class PerfectHash:
    """Maps n distinct 64-bit keys onto 0 .. n-1. Each level keeps the keys that fall alone into a slot of a bit
    array and passes the others on; a key's index is the rank of its bit."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.ranks, n = [], 0
        for bits in levels:
            ones = np.bitwise_count(bits).astype(np.int64)
            self.ranks.append(n + np.cumsum(ones) - ones)
            n += int(ones.sum())
        self.base = n

    @classmethod
    def build(cls, keys: np.ndarray, room: float = 1.5, most: int = 40) -> PerfectHash:
        levels, left = [], keys.astype(U64)
        while len(left) > 8 and len(levels) < most:
            slots = max(64, int(len(left) * room) // 64 * 64 + 64)
            at = (mix(left, len(levels)) % U64(slots)).astype(np.int64)
            alone = np.bincount(at, minlength=slots) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[at]]
        return cls(levels, np.sort(left))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key; of a key that wasn't in the set, -1 or any index (the fingerprint tells)."""
        keys = keys.astype(U64)
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for i, (bits, rank) in enumerate(zip(self.levels, self.ranks)):
            at = (mix(keys[todo], i) % U64(len(bits) * 64)).astype(np.int64)
            word, off = bits[at >> 6], (at & 63).astype(U64)
            hit = (word >> off) & U64(1) == 1
            below = word & ((U64(1) << off) - U64(1))
            out[todo[hit]] = (rank[at >> 6] + np.bitwise_count(below))[hit]
            todo = todo[~hit]
        if len(self.rest) and len(todo):
            at = np.searchsorted(self.rest, keys[todo])
            ok = (at < len(self.rest)) & (self.rest[np.minimum(at, len(self.rest) - 1)] == keys[todo])
            out[todo[ok]] = self.base + at[ok]
        return out


class LineShard:
    """A perfect hash with arrays of fingerprint, document count and keeper at its indexes."""

    def __init__(self, mph: PerfectHash, prints: np.ndarray, counts: np.ndarray, keepers: np.ndarray):
        self.mph, self.prints, self.counts, self.keepers = mph, prints, counts, keepers

    @classmethod
    def build(cls, keys, prints, counts, keepers) -> LineShard:
        mph = PerfectHash.build(keys)
        at = mph.index(keys)
        place = lambda a, kind: _placed(np.asarray(a), at, kind)
        return cls(mph, place(prints, np.int64), place(counts, np.int64), place(keepers, np.int64))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, rest=self.mph.rest, prints=self.prints, counts=self.counts, keepers=self.keepers, **{f"l{i}": x for i, x in enumerate(self.mph.levels)})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> LineShard:
        z = np.load(io.BytesIO(raw))
        levels = [z[f"l{i}"] for i in range(sum(k[0] == "l" for k in z.files))]
        return cls(PerfectHash(levels, z["rest"]), z["prints"], z["counts"], z["keepers"])

    def probe(self, keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, keeper) for each key."""
        at = self.mph.index(keys)
        found = at >= 0
        found[found] = self.prints[at[found]] == prints[found]
        keeper = np.zeros(len(keys), np.int64)
        keeper[found] = self.keepers[at[found]]
        return found, keeper


def _placed(values: np.ndarray, at: np.ndarray, kind) -> np.ndarray:
    out = np.empty(len(values), kind)
    out[at] = values
    return out


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys.view(U64) >> U64(32)) % U64(shards)).astype(np.int64)


def repeated_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """h, g, docs, keeper of the keys found in at least min_docs rows of `lines` (id, hs: distinct key hashes of a document)."""
    each = lines.select("id", F.explode("hs").alias("k")).select("id", "k.h", "k.g")
    return each.groupBy("h", "g").agg(F.count("*").alias("docs"), F.max("id").alias("keeper")).where(F.col("docs") >= min_docs)


def build_shards(repeated: DataFrame, keys_per_shard: int) -> tuple[DataFrame, int]:
    """(shard, blob, size) for shards of about keys_per_shard keys, and the number of shards."""
    n = repeated.count()
    shards = max(1, -(-n // keys_per_shard))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = LineShard.build(pdf.h.to_numpy(), pdf.g.to_numpy(), pdf.docs.to_numpy(), pdf.keeper.to_numpy()).dump()
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "blob": [raw], "size": [len(raw)]})

    # the same upper half as _shard_of, unsigned
    keyed = repeated.withColumn("shard", F.shiftrightunsigned("h", 32) % shards)
    return table(keyed.groupBy("shard").applyInPandas(build, "shard long, blob binary, size long"), "lines-shards"), shards


def _sent_lines(lines: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """rid, pos of the lines to drop, of `lines` (rid, id, pos, h, g): lines travel to their shard's task, behind its arrays."""
    lines = lines.withColumn("shard", F.shiftrightunsigned("h", 32) % shards)
    sizes = lines.groupBy("shard").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    # fewer than a thousand shards
    hot = F.broadcast(table(sizes.where(F.col("n") * 1000 > total).select("shard", F.expr(f"CAST(n * 1000 div {max(total, 1)} + 1 AS INT)").alias("salts")), "lines-hot"))
    salts = F.coalesce("salts", F.lit(1))
    # zeros, as nulls would turn long hashes into floats
    zero = lambda kind, *names: [F.lit(0).cast(kind).alias(n) for n in names]
    arrays = index.join(hot, "shard", "left").select("shard", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("side"), *zero("long", "rid", "id"), *zero("int", "pos"), *zero("long", "h", "g"), "blob")
    dealt = lines.join(hot, "shard", "left").select("shard", F.pmod(F.xxhash64("rid", "pos"), salts).cast("int").alias("salt"), F.lit(1).alias("side"), "rid", "id", "pos", "h", "g", F.lit(None).cast("binary").alias("blob"))
    rows = arrays.union(dealt).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "side")

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, own = None, None
        for pdf in batches:
            shard, side, out = pdf["shard"].to_numpy(), pdf["side"].to_numpy(), []
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(side) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(pdf)]):
                part = pdf.iloc[a:b]
                if side[a] == 0:
                    now, own = shard[a], LineShard.load(part["blob"].iloc[-1])
                elif now == shard[a]:
                    found, keeper = own.probe(part["h"].to_numpy(np.int64), part["g"].to_numpy(np.int64))
                    out.append(part.loc[found & (keeper != part["id"].to_numpy(np.int64)), ["rid", "pos"]])
            if out:
                yield pd.concat(out).astype({"rid": "int64", "pos": "int32"})

    return rows.mapInPandas(probe, "rid long, pos int")


def _prober(spark, index: DataFrame, shards: int):
    """A function of (id, key hashes) to the flags of the lines to drop, over all shards, sent to the executors."""
    blobs = {r.shard: r.blob for r in index.collect()}  # at most broadcast_bytes
    sent = spark.sparkContext.broadcast(blobs)

    @F.pandas_udf(T.ArrayType(T.BooleanType()))
    def drop(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        own = {s: LineShard.load(raw) for s, raw in sent.value.items()}
        for ids, hs, gs in batches:
            sizes = np.array([len(x) for x in hs], np.int64)
            h, g = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (hs, gs))
            who, at, out = np.repeat(ids.to_numpy(), sizes), _shard_of(h, shards), np.zeros(len(h), bool)
            for s, part in own.items():
                mine = np.flatnonzero((at == s) & (h != 0))
                found, keeper = part.probe(h[mine], g[mine])
                out[mine] = found & (keeper != who[mine])
            ends = np.cumsum(sizes)
            yield pd.Series([out[e - n : e] for e, n in zip(ends, sizes)], dtype=object)

    return drop


def marked_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, keys_per_shard: int = 65536, broadcast_bytes: int = 128 << 20) -> DataFrame:
    """docs with two columns more: `__lines`, the lines of the text, and `__drop`, a flag for each."""
    spark = docs.sparkSession
    small_batches(spark)
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    with_lines = docs.withColumn("__lines", lines)
    keyed = with_lines.withColumn("__keys", F.transform("__lines", line_key)).withColumn("__id", F.coalesce("doc_id", F.lit(NULL_ID)))
    long = lambda k, c: F.when(F.length(k) >= min_chars, c).otherwise(F.lit(0).cast("long"))
    h = F.transform("__keys", lambda k: long(k, F.xxhash64(k)))
    g = F.transform("__keys", lambda k: long(k, F.xxhash64(F.lit(1), k)))
    hashed = keyed.withColumn("__h", h).withColumn("__g", g).drop("__keys")
    own = hashed.select(F.col("__id").alias("id"), F.array_distinct(F.filter(F.arrays_zip(F.col("__h").alias("h"), F.col("__g").alias("g")), lambda k: k.h != 0)).alias("hs"))
    repeated = table(repeated_lines(own, min_docs), "lines-repeated")
    index, shards = build_shards(repeated, keys_per_shard)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if (index.agg(F.sum("size")).first()[0] or 0) <= broadcast_bytes:
        drop = _prober(spark, index, shards)
        out = hashed.withColumn("__drop", drop("__id", "__h", "__g"))
    else:
        whole = table(hashed.withColumn("__rid", F.monotonically_increasing_id()), "lines-rows")
        own = whole.select("__rid", "__id", F.posexplode(F.arrays_zip(F.col("__h").alias("h"), F.col("__g").alias("g"))).alias("pos", "k"))
        own = own.where("k.h <> 0").select(F.col("__rid").alias("rid"), F.col("__id").alias("id"), "pos", "k.h", "k.g")
        hits = _sent_lines(own, index, shards).groupBy(F.col("rid").alias("r")).agg(F.collect_set("pos").alias("__at"))  # at most the lines of one text
        out = whole.join(hits, whole["__rid"] == hits.r, "left").withColumn("__drop", F.transform("__lines", lambda _, i: F.coalesce(F.array_contains("__at", i), F.lit(False))))
    discard(repeated)
    collect_garbage(spark)
    return out.select(*columns, "__lines", "__drop")


def kept_text() -> Column:
    return F.array_join(F.filter("__lines", lambda _, i: ~F.get("__drop", i)), "\n")


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """docs with the repeated lines gone from text, and n_chars, where there is one, counted anew."""
    out = marked_lines(docs, **options).withColumn("text", F.when(F.col("text").isNotNull(), kept_text())).drop("__lines", "__drop")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def line_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for each row of docs."""
    marked = marked_lines(docs.select("doc_id", "text"), **options)
    return marked.select(
        "doc_id",
        F.size("__lines").cast("long").alias("n_lines"),
        F.size(F.filter("__drop", lambda d: d)).cast("long").alias("n_dropped"),
        F.sha2(kept_text().cast("binary"), 256).alias("kept_sha256"),
    )

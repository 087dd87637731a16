"""Operator 8: exact dedup by deterministic block naming.

Each text (null: empty; A-Z lower-cased) is cut into blocks of fixed size. Equal blocks get one integer name:
blocks are shuffled by a 64-bit hash with copies combined before the shuffle, sorted by it, and numbered. Names
of adjacent blocks are then paired, and the distinct pairs are sorted and numbered in turn, so that after
log2(blocks) rounds a document has one integer; the round is part of its identity, and an odd last name is
paired with none. By induction two documents have the same identity only if all their blocks are equal: no
collision. Blocks that share a hash are told apart, and sorted, by content, so the hash decides nothing. A name
is a place in a sorted order of contents: it is the same in every run over the same texts, however they are
dealt out. Sorting is by sampled ranges, so no task sees all names.

Cases: a null or empty text is one empty block; very long texts take more rounds, and their rows spread over
tasks by block; copies and repeated rows are combined before each shuffle; an empty table gives no rows; a
null doc_id is the smallest id; of rows that tie on doc_id one stays; other columns, whatever their names,
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import NULL_ID, ascii_lower, collect_garbage, discard, positions, table


def _named(keys: DataFrame, by: list[str], first_name: int = 0) -> DataFrame:
    """keys (no two equal in `by`) with an integer name each: their place in the order of `by`, from first_name."""
    placed = positions(keys, by, "blocks-names", keys.columns)
    out = placed.withColumn("row_no", F.col("row_no") + F.lit(first_name)).withColumnRenamed("row_no", "name")
    out._cordon_path = placed._cordon_path
    return out


def _blocks(raw: Column, n: Column, block: int) -> Column:
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(raw, i * block + 1, F.lit(block)))


def identities(docs: DataFrame, text: Column, block: int = 8192, hash_of=F.xxhash64) -> DataFrame:
    """rid, doc_id, text_sha256, level, name for each row of docs; (level, name) is the same for equal texts only."""
    base = docs.select("doc_id", F.coalesce(text, F.lit("")).cast("binary").alias("raw"))
    base = base.withColumn("n", F.greatest(F.lit(1), F.ceil(F.octet_length("raw") / block).cast("int")))
    base = base.select("doc_id", "n", F.sha2("raw", 256).alias("text_sha256"), _blocks(F.col("raw"), F.col("n"), block).alias("b"))
    rows = table(base.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "n", "text_sha256", F.transform("b", lambda x: hash_of(x)).alias("h")), "blocks-rows")
    # least and greatest content of each hash: they differ only where several blocks share it
    cut = base.select(F.explode("b").alias("b")).select(hash_of(F.col("b")).alias("h"), "b")
    # written before they are sorted, as range bounds are sampled in a pass of their own
    keys = table(cut.groupBy("h").agg((F.min("b") != F.max("b")).alias("shared")), "blocks-keys")
    names = _named(keys, ["h"])
    discard(keys)
    named = rows.select("rid", "doc_id", "n", "text_sha256", F.posexplode("h").alias("pos", "h")).join(names, "h")
    clash = names.where("shared").select("h")
    if clash.limit(1).count():
        own = base.select("doc_id", "text_sha256", F.posexplode("b").alias("pos", "b")).withColumn("h", hash_of(F.col("b"))).join(clash, "h", "left_semi")
        ids = _named(own.select("h", "b").distinct(), ["h", "b"], 1 << 61)
        ids = table(own.join(ids, ["h", "b"]).select("doc_id", "text_sha256", "pos", F.col("name").alias("exact")).distinct(), "blocks-clash")
        same = (named.doc_id.eqNullSafe(ids.doc_id)) & (named.text_sha256 == ids.text_sha256) & (named.pos == ids.pos)
        named = named.join(ids, same, "left").select("rid", "n", named.pos, F.coalesce("exact", "name").alias("name"))
    current = table(named.select("rid", "n", "pos", "name"), "blocks-level")
    deepest, level, done = rows.agg(F.max("n")).first()[0] or 1, 0, []
    while True:
        done.append(current.where(F.col("n") <= 2**level).select("rid", F.lit(level).alias("level"), "name"))
        if 2**level >= deepest:
            break
        even, name = F.col("pos") % 2 == 0, F.col("name")
        pairs = current.where(F.col("n") > 2**level).groupBy("rid", "n", F.expr("pos div 2").cast("int").alias("pos"))
        pairs = table(pairs.agg(F.max(F.when(even, name)).alias("a"), F.coalesce(F.max(F.when(~even, name)), F.lit(-1)).alias("b")), "blocks-pairs")
        ids = _named(pairs.select("a", "b").distinct(), ["a", "b"])
        current = table(pairs.join(ids, ["a", "b"]).select("rid", "n", "pos", "name"), "blocks-level")
        discard(pairs, ids)
        level += 1
    ids = done[0]
    for d in done[1:]:
        ids = ids.union(d)
    collect_garbage(docs.sparkSession)
    return rows.select("rid", "doc_id", "text_sha256").join(ids, "rid")


def exact_duplicates(docs: DataFrame, block: int = 8192) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs."""
    rows = table(identities(docs, ascii_lower(F.col("text")), block), "blocks-identities")
    best = F.max(F.struct(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), (-F.col("rid")).alias("r"), "doc_id")).alias("best")
    groups = rows.groupBy("level", "name").agg(F.count("*").alias("group_size"), best)
    out = rows.join(groups, ["level", "name"])
    return out.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("rid") == -F.col("best.r")).alias("kept"), "text_sha256")

"""Operator 1: shards cut from a Hilbert curve through quantised metadata.

Each metadata dimension is quantised to `bits` bits (numbers by quantiles of the rows, strings by their rank
among the distinct values), so a cell is a range of values; the cells' Hilbert index orders the rows, so that rows near on the curve are near in every dimension; runs of
that order become the shards. Files written in that order have narrow ranges in all dimensions at once.
Built-in expressions only.

Cases: a null text counts 0 bytes and crc 0; null dimensions are cell 0; ties on the curve go by doc_id, crc
and size, and rows that are equal in all of these take any order among themselves; an empty table gives no
rows; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, free_name, positions, table


def with_hilbert(df: DataFrame, cells: list[Column], bits: int, name: str) -> DataFrame:
    """df with `name`, the Hilbert index of integer cells of `bits` bits each (Skilling's transposition).

    Every step is a projection of its own over plain integers, which stay in generated code; one nested
    expression would compute earlier steps again for each use.
    """
    n, x = len(cells), [f"__x{i}" for i in range(len(cells))]
    df = df.withColumns({x[i]: c.cast("long") for i, c in enumerate(cells)})
    at = lambda i: F.col(x[i])
    for k in range(bits - 1, 0, -1):
        q, low = 1 << k, (1 << k) - 1
        for i in range(n):
            high = at(i).bitwiseAND(F.lit(q)) != 0
            if i == 0:
                df = df.withColumns({x[0]: F.when(high, at(0).bitwiseXOR(F.lit(low))).otherwise(at(0))})
            else:
                swap = at(0).bitwiseXOR(at(i)).bitwiseAND(F.lit(low))
                df = df.withColumns({x[0]: at(0).bitwiseXOR(F.when(high, F.lit(low)).otherwise(swap)), x[i]: F.when(high, at(i)).otherwise(at(i).bitwiseXOR(swap))})
    # Gray code: each cell with all before it, then a correction from the last one
    xor = lambda cs: reduce(lambda a, b: a.bitwiseXOR(b), cs)
    df = df.withColumns({x[i]: xor([at(j) for j in range(i + 1)]) for i in range(n)})
    fix = xor([F.lit(0).cast("long"), *[F.when(at(n - 1).bitwiseAND(F.lit(1 << k)) != 0, F.lit((1 << k) - 1)).otherwise(F.lit(0)) for k in range(bits - 1, 0, -1)]])
    df = df.withColumn("__fix", fix)
    df = df.withColumns({c: F.col(c).bitwiseXOR(F.col("__fix")) for c in x})
    places = [(k, i) for k in range(bits - 1, -1, -1) for i in range(n)]
    index = xor([F.shiftleft(F.shiftright(at(i), k).bitwiseAND(F.lit(1)), len(places) - 1 - p) for p, (k, i) in enumerate(places)])
    return df.withColumn(name, index).drop("__fix", *x)


def _below(value: Column, edge: Column) -> Column:
    return edge < value


def _up_to(value: Column, edge: Column) -> Column:
    return edge.v <= value


def _first_values(values: DataFrame, cells: int) -> list[tuple[int, str]]:
    """(cell, its first value) where the distinct values (column v) are cut into cells of equal numbers of them.

    The values are sorted by ranges and numbered; only one row for each cell comes back.
    """
    values = values.where(F.col("v").isNotNull()).distinct()
    at = positions(values, ["v"], "hilbert-values", ["v"])
    n = at.count()
    cell = F.expr(f"row_no * {cells} div {max(n, 1)}").cast("int").alias("c")
    out = sorted((r.c, r.v) for r in at.groupBy(cell).agg(F.min("v").alias("v")).collect())
    discard(at)
    return out


def quantised(df: DataFrame, dims: list[str], bits: int) -> list[Column]:
    """A cell 0 .. 2^bits - 1 of each dimension: numbers by approximate quantiles of all rows, others as strings by their rank among the distinct ones."""
    kinds, cells = dict(df.dtypes), 2**bits
    numeric = [d for d in dims if kinds[d] in ("tinyint", "smallint", "int", "bigint", "float", "double")]
    cuts = {}
    if numeric:
        at = [i / cells for i in range(1, cells)]
        row = df.agg(*[F.percentile_approx(d, at, 1000).alias(d) for d in numeric]).first()
        cuts = {d: sorted(set(row[d] or [])) for d in numeric}
    out = []
    for d in dims:
        if d in numeric:
            edges = F.array(*[F.lit(v) for v in cuts[d]]) if cuts[d] else F.array(F.lit(0))
            value = F.col(d)
            cell = F.when(value.isNotNull(), F.size(F.filter(edges, partial(_below, value))))
        else:
            value = F.col(d).cast("string")
            firsts = _first_values(df.select(value.alias("v")), cells)
            edges = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(v).alias("v")) for c, v in firsts])
            cell = F.element_at(F.filter(edges, partial(_up_to, value)), -1).c if firsts else F.lit(0)
        out.append(F.coalesce(cell.cast("long"), F.lit(0).cast("long")))
    return out


def shard_rows(docs: DataFrame, dims: tuple[str, ...] = ("source", "lang", "size"), bits: int = 5, shards: int = 24, law: str = "rows", row: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, curve for each row of docs.

    law `rows` cuts runs of equal row counts (at most one apart); `bytes` cuts where the running size passes
    each equal share, so shards differ by about one text. `row`, a column that numbers the rows, is kept.
    """
    own = [row] if row else []
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", *own, *[d for d in dims if d != "size"], (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    keyed = with_hilbert(base, quantised(base, list(dims), bits), bits, "curve").select("doc_id", "size", "text_crc32", "curve", *own)
    order = ["curve", "doc_id", "text_crc32", "size", *own]
    rows = positions(keyed, order, "hilbert", order)
    n = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
    if law == "rows":
        shard = F.expr(f"row_no * {shards} div {max(n.n, 1)}")
        first = F.expr(f"(shard * {n.n} + {shards - 1}) div {shards}")
        rows = rows.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("row_no") - first)
    elif law == "bytes":
        from pyspark.sql import Window

        block = 65536
        rows = rows.withColumn("_block", F.expr(f"row_no div {block}"))
        run = F.sum("size").over(Window.partitionBy("_block").orderBy("row_no"))
        sums = rows.groupBy("_block").agg(F.sum("size").alias("_s"))
        before = sums.select("_block", (F.sum("_s").over(Window.orderBy("_block")) - F.col("_s")).alias("_before"))
        rows = rows.withColumn("_run", run).join(before, "_block").withColumn("shard", F.expr(f"least({shards - 1}, (_before + _run - size) * {shards} div {max(n.b, 1)})").cast("int"))
        firsts = rows.groupBy("shard").agg(F.min("row_no").alias("_first"))
        rows = rows.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("row_no") - F.col("_first"))
    else:
        raise ValueError(f"unknown law {law!r}")
    return rows.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve", *own)


def write_shards(docs: DataFrame, path: str, **options) -> str:
    """Writes docs as one folder of files per shard, in curve order inside each, for pruning by any of the dimensions;
    every row once, whatever its doc_id. Returns the name of the folders' column: shard, or one that docs does not have."""
    to, at, row = (free_name(docs, n) for n in ("shard", "slot", "row"))
    numbered = table(docs.withColumn(row, F.monotonically_increasing_id()), "hilbert-docs")
    assigned = shard_rows(numbered, row=row, **options).select(F.col(row), F.col("shard").alias(to), F.col("slot").alias(at))
    parts = numbered.join(assigned, row).drop(row)
    parts.repartitionByRange(to, at).sortWithinPartitions(to, at).drop(at).write.partitionBy(to).parquet(path)
    discard(numbered)
    return to

"""Operator 3: near-dedup of embeddings over hierarchical navigable small-world graphs.

Vectors are compared only within a label. Equal vectors of a label are one class, whose members link to each
other without a search. The classes of a label are dealt to shards of bounded size; each shard gets a
navigable small-world graph of several levels, into which nodes go in batches. Every shard of the label is then
queried with every class, in blocks, many queries side by side: beams descend the levels, and on the lowest one
they spread over all neighbours that are near the threshold or above. Each block audits a sample of its queries,
whichever shard they come from, against a full scan of the shard: until the audit finds every link the beams
are doubled, then the edge of the spread is lowered; a block that still fails is scanned in full. Found links
are verified by cosine in double precision. A block counts each vector's links and keeps one spanning edge for
each of its groups and shards; components are formed from those.

Cases: vectors that are null or zero, or hold null or non-finite components, and vectors without a label link
with nothing; labels may be of any type that can be grouped; vectors of another length than the shard's other
vectors are compared with their like only; very long vectors have no limit; very many equal vectors are
counted, not paired; repeated rows are equal vectors; rows that share a vec_id count as one vertex of the
components; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .line_dedup import mix
from .shared import collect_garbage, components, discard, table

#: Queries side by side, and nodes that each of them expands at once.
SIDE, EXPAND = 256, 4
#: Pairs of query and node whose vectors are held at once.
PAIRS = 1 << 17


def _dots(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Dot products of rows a[i] and b[j]."""
    out = np.empty(len(i), np.result_type(a, b))
    for s in range(0, len(i), PAIRS):
        out[s : s + PAIRS] = np.einsum("ij,ij->i", a[i[s : s + PAIRS]], b[j[s : s + PAIRS]])
    return out


class Graph:
    """Unit vectors and their neighbours by level. Nodes are in falling order of their levels, so those of a level
    are the first ones; `order` gives their rows in the vectors."""

    def __init__(self, vectors: np.ndarray, links: int = 12, beam: int = 48, seed: int = 3):
        n = len(vectors)
        draw = mix(np.arange(n, dtype=np.uint64), seed) >> np.uint64(11)
        level = np.minimum((-np.log((draw.astype(np.float64) + 1) / 2**53) / np.log(links)).astype(int), 12)
        self.order = np.argsort(-level, kind="stable")
        level = level[self.order]
        self.x = vectors[self.order].astype(np.float32)
        self.next = [np.full((int((level >= l).sum()), links * (2 if l == 0 else 1)), -1, np.int32) for l in range(int(level[0]) + 1)]
        self.links, self.n = links, n
        at = 1
        while at < n:
            # nodes of one level, a quarter of those there are at most
            end = min(n, at + min(SIDE, max(1, at // 4)), int(np.searchsorted(-level, -level[at], "right")))
            self._insert(at, end, int(level[at]), beam)
            at = end

    def _insert(self, a: int, b: int, level: int, beam: int) -> None:
        q, new = self.x[a:b], np.arange(a, b)
        entry = self._descend(q, level, a)
        near = q @ q.T
        np.fill_diagonal(near, -np.inf)
        few = min(b - a - 1, self.links)
        own = np.argsort(-near, 1, kind="stable")[:, :few]
        for l in range(min(level, len(self.next) - 1), -1, -1):
            ids, sims = self._beam(q, entry, beam, l, a)
            entry = ids[:, 0]
            # nodes of the same batch are candidates too
            ids, sims = np.hstack([ids, own + a]), np.hstack([sims, np.take_along_axis(near, own, 1)])
            most = self.next[l].shape[1]
            to = self._spread_out(ids, sims, self.links)
            self.next[l][a:b, : to.shape[1]] = to
            self._link_back(np.repeat(new, to.shape[1]), to.ravel(), l, most)

    def _link_back(self, source: np.ndarray, target: np.ndarray, l: int, most: int) -> None:
        ok = target >= 0
        source, target = source[ok], target[ok]
        # not those that are linked already
        fresh = ~(self.next[l][target] == source[:, None]).any(1)
        source, target = source[fresh], target[fresh]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        for s in range(0, len(nodes), SIDE):
            own, f, c = nodes[s : s + SIDE], first[s : s + SIDE], count[s : s + SIDE]
            wide = np.full((len(own), int(c.max())), -1, np.int64)
            row = np.repeat(np.arange(len(own)), c)
            col = np.arange(len(row)) - np.repeat(np.cumsum(c) - c, c)
            wide[row, col] = source[np.repeat(f, c) + col]
            ids = np.hstack([self.next[l][own], wide])
            sims = np.where(ids >= 0, np.einsum("ij,ikj->ik", self.x[own], self.x[ids]), -np.inf)
            self.next[l][own] = self._spread_out(ids, sims, most)

    def _spread_out(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """For each row up to `most` neighbours: those nearer to the node than to each other, then the nearest of the rest; -1 for none."""
        by = np.argsort(-sims, 1, kind="stable")
        ids, sims = np.take_along_axis(ids, by, 1), np.take_along_axis(sims, by, 1)
        valid = np.isfinite(sims) & (ids >= 0)
        width = ids.shape[1]
        if width > most:
            kept = np.zeros(ids.shape, bool)
            part = max(1, PAIRS // width)
            for s in range(0, len(ids), part):
                v = self.x[ids[s : s + part]]
                between = v @ v.transpose(0, 2, 1)
                nearest = np.full(ids[s : s + part].shape, -np.inf, np.float32)
                n = np.zeros(len(v), int)
                for k in range(width):
                    keep = valid[s : s + part, k] & (sims[s : s + part, k] >= nearest[:, k]) & (n < most)
                    kept[s : s + part, k] = keep
                    n += keep
                    nearest[keep] = np.maximum(nearest[keep], between[keep, k])
            rank = np.argsort(np.where(kept, 0, np.where(valid, 1, 2)), 1, kind="stable")[:, :most]
            ids, valid = np.take_along_axis(ids, rank, 1), np.take_along_axis(valid, rank, 1)
        return np.where(valid, ids, -1).astype(np.int32)

    def _descend(self, q: np.ndarray, level: int, count: int) -> np.ndarray:
        at = np.zeros(len(q), np.int64)
        for l in range(len(self.next) - 1, level, -1):
            at = self._beam(q, at, 2, l, count)[0][:, 0]
        return at

    def _beam(self, q: np.ndarray, start: np.ndarray, width: int, l: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest nodes that beams of that width find, best first, for each row of q; -1 and -inf for none."""
        n, size = len(q), min(count, len(self.next[l]))
        ids, sims, done = np.full((n, width), -1, np.int64), np.full((n, width), -np.inf, np.float32), np.zeros((n, width), bool)
        ids[:, 0], sims[:, 0] = start, np.einsum("ij,ij->i", self.x[start], q)
        seen = np.zeros((n, size), bool)
        seen[np.arange(n), start] = True
        while True:
            todo = ~done & (ids >= 0)
            todo &= np.cumsum(todo, 1) <= EXPAND
            rows, cols = np.nonzero(todo)
            if not len(rows):
                return ids, sims
            done[rows, cols] = True
            near = self.next[l][ids[rows, cols]]
            row, node = np.repeat(rows, near.shape[1]), near.ravel()
            ok = node >= 0
            row, node = row[ok], node[ok]
            ok = ~seen[row, node]
            key = np.unique(row[ok] * np.int64(size) + node[ok])
            row, node = key // size, key % size
            if not len(row):
                continue
            seen[row, node] = True
            sim = _dots(self.x, node, q, row)
            better = sim > sims[row, -1]
            row, node, sim = row[better], node[better], sim[better]
            if not len(row):
                continue
            # the rows that change: beam and new nodes together, the best stay
            own, c = np.unique(row, return_counts=True)
            col = np.arange(len(row)) - np.repeat(np.cumsum(c) - c, c)
            at = np.repeat(np.arange(len(own)), c)
            new_ids, new_sims = np.full((len(own), int(c.max())), -1, np.int64), np.full((len(own), int(c.max())), -np.inf, np.float32)
            new_ids[at, col], new_sims[at, col] = node, sim
            all_sims = np.hstack([sims[own], new_sims])
            best = np.argsort(-all_sims, 1, kind="stable")[:, :width]
            ids[own] = np.take_along_axis(np.hstack([ids[own], new_ids]), best, 1)
            done[own] = np.take_along_axis(np.hstack([done[own], np.zeros(new_ids.shape, bool)]), best, 1)
            sims[own] = np.take_along_axis(all_sims, best, 1)

    def within(self, q: np.ndarray, least: float, edge: float, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of q, row of the vectors) of similarities of at least `least`: beams, then all that their nodes above `edge` lead to."""
        if self.n == 1:
            row = np.flatnonzero(q @ self.x[0] >= least - 1e-5)
            return row, np.zeros(len(row), np.int64)
        ids, sims = self._beam(q, self._descend(q, 0, self.n), width, 0, self.n)
        row, col = np.nonzero(sims >= edge)
        node = ids[row, col]
        seen = np.zeros((len(q), self.n), bool)
        seen[row, node] = True
        out = [(row, node, sims[row, col])]
        while len(row):
            found = []
            for s in range(0, len(row), PAIRS):
                near = self.next[0][node[s : s + PAIRS]]
                r, m = np.repeat(row[s : s + PAIRS], near.shape[1]), near.ravel()
                ok = m >= 0
                r, m = r[ok], m[ok]
                ok = ~seen[r, m]
                key = np.unique(r[ok] * np.int64(self.n) + m[ok])
                r, m = key // self.n, key % self.n
                seen[r, m] = True
                sim = _dots(self.x, m, q, r)
                ok = sim >= edge
                found.append((r[ok], m[ok], sim[ok]))
            out += found
            row, node = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        row, node, sim = (np.concatenate(x) for x in zip(*out))
        ok = sim >= least - 1e-5
        return row[ok], self.order[node[ok]]


def scan(x: np.ndarray, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """What Graph.within should find, by a full scan of unit vectors x."""
    return np.nonzero(q @ x.T >= least - 1e-5)


def cosines(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of the rows a[i] and b[j], in double precision."""
    size = lambda m: np.sqrt((m * m).sum(1))
    return _dots(a, i, b, j) / (size(a)[i] * size(b)[j])


def _units(x: np.ndarray) -> np.ndarray:
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


def _rows(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def searches(graph: Graph, unit: np.ndarray, q: np.ndarray, least: float, beam: int, audits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of q, row of unit) of similar unit vectors, for SIDE rows of q after SIDE others; the audit comes first."""
    sample = np.linspace(0, len(q) - 1, min(audits, len(q))).astype(int)
    want = set(zip(*(x.tolist() for x in scan(unit, q[sample], least + 2e-5))))
    width, edge = beam, least - 0.02
    while width <= 16 * beam and width < len(unit):
        if want <= set(zip(*(x.tolist() for x in graph.within(q[sample], least, edge, width)))):
            break
        # wider beams first, then a lower edge
        width, edge = width * 2, edge - (0.05 if width >= 4 * beam else 0.0)
    else:
        width = 0
    for s in range(0, len(q), SIDE):
        part = q[s : s + SIDE]
        row, node = graph.within(part, least, edge, width) if width else scan(unit, part, least)
        yield row + s, node


class Groups:
    """Which of n things have come together."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def of(self, i: np.ndarray) -> np.ndarray:
        r = self.root[i]
        while (self.root[r] != r).any():
            r = self.root[r]
        return r

    def join(self, row: np.ndarray, i: np.ndarray) -> None:
        """All i of one row come together; rows are in order."""
        first = np.flatnonzero(np.diff(row, prepend=-1))
        n = np.diff(np.append(first, len(row)))
        while len(row):
            r = self.of(i)
            low = np.repeat(np.minimum.reduceat(r, first), n)
            if (r == low).all():
                break
            np.minimum.at(self.root, r, low)


def near_vectors(embeddings: DataFrame, least: float = 0.93, shard_rows: int = 16384, block_rows: int = 4096, beam: int = 32, audits: int = 256) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of embeddings."""
    spark = embeddings.sparkSession
    v = F.col("embedding").cast("array<double>")
    ok = F.col("label").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = table(embeddings.select("vec_id", "label", F.transform(v, lambda x: x + F.lit(0.0)).alias("v"), F.coalesce(ok, F.lit(False)).alias("ok")), "vectors")
    # a class is the equal vectors of a label
    key = ["label", "v"]
    classes = rows.where("ok").groupBy(*key).agg(F.count("*").alias("n"), F.min("vec_id").alias("rep"))
    classes = table(classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "vector-classes")
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("in_label"))
    dealt = classes.join(sizes, ["label", "dim"]).withColumn("shards", F.ceil(F.col("in_label") / shard_rows).cast("int")).withColumn("blocks", F.ceil(F.col("in_label") / block_rows).cast("int"))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("cid"), F.col("shards")).cast("int")).withColumn("block", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("blocks")).cast("int"))
    dealt = table(dealt, "vector-shards")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cid", kind="stable")
        x = _rows(pdf["v"])
        blob = pickle.dumps((Graph(_units(x)), x, pdf["cid"].to_numpy(), pdf["n"].to_numpy()), 5)
        first = pdf.iloc[:1][["label", "dim", "shard", "blocks"]]
        return first.assign(graph=[blob])

    label = dict(dealt.dtypes)["label"]
    graphs = dealt.select("label", "dim", "shard", "blocks", "cid", "n", "v").groupBy("label", "dim", "shard").applyInPandas(build, f"label {label}, dim int, shard int, blocks int, graph binary")
    graphs = table(graphs, "vector-graphs")
    queries = dealt.select("label", "dim", "block", "cid", "v", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"cid": [], "links": [], "to": []})
        graph, x, cids, n = pickle.loads(left["graph"].iloc[0])
        q, own = _rows(right["v"]), right["cid"].to_numpy()
        links, first, groups = np.zeros(len(q), np.int64), np.full(len(q), -1), Groups(len(x))
        for row, node in searches(graph, _units(x), _units(q), least, beam, audits):
            true = cosines(q, row, x, node) >= least
            row, node = row[true], node[true]
            by = np.lexsort((node, row))
            row, node = row[by], node[by]
            # the nodes found are one group with the query: join them here, keep one edge
            groups.join(row, node)
            first[row] = node
            other = cids[node] != own[row]
            np.add.at(links, row[other], n[node[other]])
        tops = groups.of(np.arange(len(x)))
        to = np.where(first >= 0, cids[tops[first]], own)
        inner = np.flatnonzero(tops != np.arange(len(x)))
        return pd.DataFrame({"cid": np.append(own, cids[inner]), "links": np.append(links, np.zeros(len(inner), np.int64)), "to": np.append(to, cids[tops[inner]])})

    on = ["label", "dim", "shard", "block"]
    sent = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    found = sent.groupBy(*on).cogroup(queries.groupBy(*on)).applyInPandas(search, "cid long, links long, to long")
    found = table(found, "vector-links")
    discard(graphs, dealt)
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    edges = found.where("cid <> to").select("cid", "to").distinct()
    # vertices of the components are the classes' smallest vec_ids
    reps = classes.select("cid", "rep")
    edges = edges.join(reps, "cid").select(F.col("rep").alias("a"), "to").join(reps.withColumnRenamed("cid", "to"), "to").select("a", F.col("rep").alias("b"))
    joined = components(edges, "a", "b")
    joined = joined.withColumnRenamed("v", "rep")
    per = classes.join(links, "cid").join(joined, "rep", "left").select(*key, (F.col("links") + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    collect_garbage(spark)
    out = rows.where("ok").join(per, key).select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

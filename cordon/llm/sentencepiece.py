"""Operator 4: SentencePiece encoding and decoding.

Pieces with log scores are read from a model file's vocabulary and laid out in a double-array trie over UTF-8
bytes. The scores of a unigram model are log probabilities and taken as they are. A BPE model's scores are ranks
(0, -1, -2, ..), whose sums mean nothing; as its pieces are in the order of how often they were met, a piece of
rank r gets the log probability that Zipf's law gives it, -log((r + 1) * sum of all 1 / (k + 1)). Nothing is
trained. Encoding writes white-space markers for spaces (with one before the text), finds by Viterbi search the
segmentation with the highest sum of scores, and writes a character that no piece covers as byte pieces.
Decoding turns byte pieces into bytes, markers into spaces, and drops the one in front, so that
decode(encode(text)) is the text.

No piece has a marker after another character, so the best segmentation of a text is that of its chunks
(markers and what follows them) one after another; a batch's distinct chunks are searched side by side in
numpy, one trie step at a time. A vocabulary whose pieces do cross markers is searched text by text.
Ties go to the longer last piece.

Cases: a null text gives null pieces and decodes to null, an empty one none; very long texts and chunks have
no limit; a marker character in the text itself decodes to a space; repeated rows are coded alike; an empty
table gives no rows; other columns are kept by `encode` and not read, and one that has the name of a new column
gives way to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import small_batches

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: The kind of model whose scores are log probabilities.
UNIGRAM = 1
#: Scores below this mark pieces that are never to be chosen; a character without a piece scores PENALTY below the rest.
NEVER, PENALTY = -1e8, 10.0
#: Chunks up to this many bytes are searched side by side.
SHORT = 48
#: Texts are coded in slices of about so many characters; the pieces of so many chunks are kept for reuse.
SLICE = 1 << 18
CACHED = 100_000


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        out |= (b[i] & 127) << shift
        shift += 7
        i += 1
        if b[i - 1] < 128:
            return out, i


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a message."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        if tag & 7 == 2:
            n, i = _varint(b, i)
            yield tag >> 3, b[i : i + n]
            i += n
        elif tag & 7 == 0:
            v, i = _varint(b, i)
            yield tag >> 3, v
        else:
            n = 4 if tag & 7 == 5 else 8
            yield tag >> 3, b[i : i + n]
            i += n


def read_pieces(raw: bytes) -> list[tuple[str, float, int]]:
    """(piece, log score, kind) of a model file: field 1 of the message, with fields 1 string, 2 float, 3 enum; its kind of model is field 3 of field 2."""
    out, model = [], UNIGRAM
    for number, value in _fields(raw):
        own = dict(_fields(value)) if number in (1, 2) else {}
        if number == 1:
            out.append((own[1].decode(), float(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0]), own.get(3, NORMAL)))
        elif number == 2:
            model = own.get(3, UNIGRAM)
    return out if model == UNIGRAM else by_zipf(out)


def by_zipf(pieces: list[tuple[str, float, int]]) -> list[tuple[str, float, int]]:
    """pieces whose scores are ranks below 0, with log probabilities in their place."""
    ranks = np.array([-s for _, s, k in pieces if k == NORMAL])
    total = np.log((1 / (ranks + 1)).sum()) if len(ranks) else 0.0
    return [(p, float(-np.log(1 - s) - total) if k == NORMAL else s, k) for p, s, k in pieces]


@dataclass
class DoubleArray:
    """A trie: the child of state s by byte b is base[s] + b if check there is s; value is the piece of a state, or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @classmethod
    def build(cls, words: list[tuple[bytes, int]]) -> DoubleArray:
        children: list[dict[int, int]] = [{}]
        ends = {}
        for word, v in words:
            s = 0
            for b in word:
                t = children[s].get(b)
                if t is None:
                    t = children[s][b] = len(children)
                    children.append({})
                s = t
            ends[s] = v
        size = 1024
        base, check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        place, free, queue = {0: 0}, 1, [0]
        check[0] = 0
        for s in queue:
            kids = children[s]
            if not kids:
                continue
            queue.extend(kids.values())
            at, start, b = np.array(sorted(kids), np.int64), free, -1
            while b < 0:
                # the free slots from here on that could hold the first child, a few hundred at once
                while start + 1024 >= size:
                    base, check, size = np.concatenate([base, np.zeros(size, np.int32)]), np.concatenate([check, np.full(size, -1, np.int32)]), size * 2
                slots = start + np.flatnonzero(check[start : start + 512] == -1)
                slots = slots[slots > at[0]] - at[0]
                fits = np.flatnonzero((check[slots[:, None] + at[None, :]] == -1).all(1))
                b, start = (int(slots[fits[0]]), start) if len(fits) else (-1, start + 512)
            base[place[s]] = b
            check[b + at] = place[s]
            for byte, kid in kids.items():
                place[kid] = b + byte
            taken = np.flatnonzero(check[free : free + 4096] == -1)
            # slots left in a stretch that is nearly full are given up
            free += (int(taken[0]) if len(taken) > 64 else 4096) if len(taken) else 4096
            free = min(free, size - 1)
        value = np.full(size + 256, -1, np.int32)
        for s, v in ends.items():
            value[place[s]] = v
        return cls(np.concatenate([base, np.zeros(256, np.int32)]), np.concatenate([check, np.full(256, -1, np.int32)]), value)


class Pieces:
    """A vocabulary ready to encode and decode."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.names = [p for p, _, _ in pieces]
        self.kinds = np.array([k for _, _, k in pieces], np.int32)
        self.scores = np.array([s for _, s, _ in pieces], np.float64)
        usable = [(p.encode(), i) for i, (p, _, k) in enumerate(pieces) if k == NORMAL]
        self.trie = DoubleArray.build(usable)
        self.longest = max((len(b) for b, _ in usable), default=1)
        real = self.scores[(self.kinds == NORMAL) & (self.scores > NEVER)]
        self.unknown = float(real.min() - PENALTY) if len(real) else -PENALTY
        self.bytes = np.full(256, max(0, next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)), np.int32)
        for i in np.flatnonzero(self.kinds == BYTE):
            self.bytes[int(self.names[i][3:5], 16)] = i
        self.crossing = any(MARK in p.lstrip(MARK) for p, _, k in pieces if k == NORMAL)
        self.chunks = re.compile(" *[^ ]+| +")
        surface = [bytes([int(n[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else n.replace(MARK, " ").encode() for n, k in zip(self.names, self.kinds)]
        self.sizes = np.array([len(b) for b in surface], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self._forget()

    # --- encoding

    def best_path(self, raw: bytes) -> list[int]:
        """Viterbi over one chunk of any length."""
        base, check, value, scores = self._lists()
        n = len(raw)
        best, back = [float("-inf")] * (n + 1), [(0, -1)] * (n + 1)
        best[0] = 0.0
        i = 0
        while i < n:
            width = 1 if raw[i] < 0x80 else 2 if raw[i] < 0xE0 else 3 if raw[i] < 0xF0 else 4
            here, s, single = best[i], 0, False
            for j in range(i, min(n, i + self.longest)):
                t = base[s] + raw[j]
                if check[t] != s or t == 0:
                    break
                s = t
                if value[s] >= 0:
                    single |= j + 1 == i + width
                    score = here + scores[value[s]]
                    if score > best[j + 1]:
                        best[j + 1], back[j + 1] = score, (i, value[s])
            if not single and here + self.unknown > best[min(n, i + width)]:
                best[min(n, i + width)], back[min(n, i + width)] = here + self.unknown, (i, -1)
            i += width
        return self._trace(raw, back)

    def _lists(self):
        if not hasattr(self, "_as_lists"):
            self._as_lists = self.trie.base.tolist(), self.trie.check.tolist(), self.trie.value.tolist(), self.scores.tolist()
        return self._as_lists

    def _trace(self, raw: bytes, back) -> list[int]:
        out, at = [], len(raw)
        while at:
            i, piece = back[at]
            out += [int(piece)] if piece >= 0 else [int(self.bytes[b]) for b in reversed(raw[i:at])]
            at = i
        return out[::-1]

    def _side_by_side(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi over short chunks: for each first byte and length, one trie step of all chunks at once."""
        n, width = len(chunks), max(map(len, chunks))
        text = np.zeros((n, width + 1), np.uint8)
        size = np.array([len(c) for c in chunks])
        text[np.arange(width + 1)[None, :] < size[:, None]] = np.frombuffer(b"".join(chunks), np.uint8)
        best, piece, start = np.full((n, width + 1), -np.inf), np.full((n, width + 1), -1, np.int32), np.zeros((n, width + 1), np.int8)
        best[:, 0] = 0
        lead = (text & 0xC0) != 0x80
        step = np.where(text < 0x80, 1, np.where(text < 0xE0, 2, np.where(text < 0xF0, 3, 4)))
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for i in range(width):
            rows = np.flatnonzero((size > i) & lead[:, i])
            if not len(rows):
                continue
            state, alive, single = np.zeros(len(rows), np.int64), rows, np.zeros(n, bool)
            for j in range(i, min(width, i + self.longest)):
                if j > i:
                    more = size[alive] > j
                    alive, state = alive[more], state[more]
                to = base[state] + text[alive, j].astype(np.int64)
                ok = (check[to] == state) & (to != 0)
                alive, state = alive[ok], to[ok]
                if not len(alive):
                    break
                v = value[state]
                hit = v >= 0
                if hit.any():
                    at, v = alive[hit], v[hit]
                    score = best[at, i] + self.scores[v]
                    single[at] |= step[at, i] == j + 1 - i
                    better = score > best[at, j + 1]
                    at, v = at[better], v[better]
                    best[at, j + 1], piece[at, j + 1], start[at, j + 1] = score[better], v, i
            rest = rows[~single[rows]]
            to = np.minimum(i + step[rest, i], size[rest])
            score = best[rest, i] + self.unknown
            better = score > best[rest, to]
            rest, to = rest[better], to[better]
            best[rest, to], piece[rest, to], start[rest, to] = score[better], -1, i
        # all paths back at once; a chunk with byte pieces goes by itself
        at, steps, plain = size.copy(), [], np.ones(n, bool)
        while (at > 0).any():
            own = np.where(at > 0, piece[np.arange(n), at], -2)
            plain &= own != -1
            steps.append(own)
            at = np.where(at > 0, start[np.arange(n), at], 0)
        found = np.array(steps[::-1]).T if steps else np.zeros((n, 0), np.int32)
        lengths = (found != -2).sum(1)
        if plain.all():
            return found[found != -2], lengths
        rows = [found[k][found[k] != -2] if plain[k] else np.array(self._trace(chunks[k], list(zip(start[k].tolist(), piece[k].tolist()))), np.int32) for k in range(n)]
        return np.concatenate(rows), np.array([len(r) for r in rows])

    def _learn(self, new: list[str]) -> None:
        """Finds the pieces of chunks not met before."""
        raw = [c.replace(" ", MARK).encode("utf-8", "replace") for c in new]
        groups: dict[int, list[int]] = {}
        for i, b in enumerate(raw):
            # ASCII and other chunks apart: only the others have characters without a piece, mostly
            groups.setdefault(-(-len(b) // 8) * 2 + (not b.isascii() and b"\n" in b) if len(b) <= SHORT else -1, []).append(i)
        for key, group in groups.items():
            for k in range(0, len(group), 20_000):
                part = group[k : k + 20_000]
                if key < 0:
                    paths = [self.best_path(raw[i]) for i in part]
                    ids, n = np.array([x for p in paths for x in p], np.int32), np.array([len(p) for p in paths], np.int64)
                else:
                    ids, n = self._side_by_side([raw[i] for i in part])
                first = len(self.lengths)
                self.known.update((new[i], first + j) for j, i in enumerate(part))
                self.offsets = np.concatenate([self.offsets, len(self.ids) + np.cumsum(n) - n])
                self.lengths, self.ids = np.concatenate([self.lengths, n]), np.concatenate([self.ids, ids.astype(np.int32)])

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.offsets, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of all texts in a row, and how many each text has."""
        marked = [" " + t if t else "" for t in texts]
        if self.crossing:
            paths = [self.best_path(t.replace(" ", MARK).encode("utf-8", "replace")) for t in marked]
            return np.array([x for p in paths for x in p], np.int32), np.array([len(p) for p in paths], np.int64)
        split = [self.chunks.findall(t) for t in marked]
        new = list({c for s in split for c in s if c not in self.known})
        if new and len(self.known) > CACHED:
            self._forget()
            new = list({c for s in split for c in s})
        if new:
            self._learn(new)
        known = self.known
        chunk = np.fromiter((known[c] for s in split for c in s), np.int64)
        n = self.lengths[chunk]
        ends = np.cumsum(n)
        ids = self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.offsets[chunk] - (ends - n), n)]
        upto = np.concatenate([[0], ends])[np.cumsum([0, *map(len, split)])]
        return ids, np.diff(upto)

    # --- decoding

    def decode_batch(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of pieces in a row, `counts` of them for each text."""
        n = self.sizes[ids]
        ends = np.cumsum(n)
        raw = self.surface[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[ids] - (ends - n), n)].tobytes()
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(upto, upto[1:])]
        return [t[1:] if t[:1] == " " else t for t in texts]


def load_pieces(path: str) -> Pieces:
    with open(path, "rb") as f:  # on the driver, once
        return Pieces(read_pieces(f.read()))


def encode(docs: DataFrame, pieces: Pieces, column: str = "text", to: str = "pieces", check: str | None = None) -> DataFrame:
    """docs with `to`, the ids of the pieces of `column`; with `check`, also a column of that name: does decoding them give the text?
    Columns of docs with these names (but for `column`) give way.

    Batches go through in slices of text, so a worker holds little more than what comes in at once.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(pieces)  # as large as the vocabulary
    taken = {to.lower(), (check or to).lower()}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c == column or c.lower() not in taken])
    at = docs.columns.index(column)
    new = [T.StructField(to, T.ArrayType(T.IntegerType())), *([T.StructField(check, T.BooleanType())] if check else [])]
    schema = T.StructType([*docs.schema.fields, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for first, last in _parts(batch.column(at)):
                part = batch.slice(first, last - first)
                texts = part.column(at).to_pylist()
                ids, counts = own.encode_batch([t or "" for t in texts])
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), mask=np.array([*(t is None for t in texts), False]))
                columns = [*part.columns, pa.ListArray.from_arrays(offsets, pa.array(ids))]
                if check:
                    columns.append(pa.array([a is None or a == b for a, b in zip(texts, own.decode_batch(ids, counts))], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def _parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about SLICE bytes of text each."""
    first, size = 0, 0
    for i, n in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        size += n
        if size > SLICE:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def decode(coded: DataFrame, pieces: Pieces, column: str = "pieces", to: str = "decoded") -> DataFrame:
    """coded with `to`, the text of the piece ids in `column`."""
    sent = coded.sparkSession.sparkContext.broadcast(pieces)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = sent.value
        for lists in batches:
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            out, first, at = [], 0, np.concatenate([[0], np.cumsum(counts)])
            while first < len(counts):
                last = max(first + 1, int(np.searchsorted(at, at[first] + SLICE // 4)))
                out += own.decode_batch(ids[at[first] : at[min(last, len(counts))]], counts[first:last])
                first = last
            yield pa.array(out, pa.string(), mask=lists.is_null().to_numpy(zero_copy_only=False))

    return coded.withColumn(to, run(column))


def coded_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, pieces, round_trip for each row of docs."""
    pieces = load_pieces(model_path)
    own = np.flatnonzero(pieces.kinds == BYTE)
    lo, hi = (int(own.min()), int(own.max())) if len(own) else (1, 0)
    out = encode(docs.select("doc_id", "text"), pieces, check="round_trip")
    return out.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), F.size(F.filter("pieces", lambda p: p.between(lo, hi))).cast("long").alias("n_byte_pieces"), "pieces", "round_trip")


def spark_model_path(spark: SparkSession) -> str:
    """The vocabulary's path: the setting cordon.sentencepiece.model, or the public file of the machine."""
    return spark.conf.get("cordon.sentencepiece.model", "/opt/tokenizers/piece_bpe_32k.model")

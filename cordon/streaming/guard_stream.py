"""The guard over chunked streams: text goes in, and only text that has been checked comes out.

`StreamGuard` is one stream's guard with push and finish. `guard_stream` runs one for each key of a streaming
(or batch) DataFrame of chunks, with its state in Spark's state store. Its windows are the batch's windows, so
its events are those that `operators.guard.events` gives for the whole text, however it is cut into chunks.
"""

from __future__ import annotations

import codecs
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.plain import Allow, Detectors, fingerprint
from ..functions.windows import Cutter, Sizes
from ..operators.report import BAD_INPUT
from ..plans.rules import Policy, Rules

FINDING = "struct<start:bigint,`end`:bigint,tie:int,action:string,category:string,source:string,probability:float,citations:array<string>,fingerprint:string>"
EVENTS = f"stream_id string, seg_no int, ord int, kind string, n int, text string, findings array<{FINDING}>"


@dataclass
class StreamGuard:
    """Events are (seg_no, ord, kind, n, text, findings); kinds are warn, block and release."""

    actions: dict[str, str]
    citations: dict[str, list[str]]
    detectors: Detectors
    sizes: Sizes = field(default_factory=Sizes)
    mode: str = "filter"
    hmac_key: bytes | None = None

    def __post_init__(self):
        if self.mode not in ("filter", "report"):
            raise ValueError(f"unknown mode {self.mode!r}")
        self.cutter, self.is_blocked, self.seg_no = Cutter(self.sizes), False, 0
        self.reported: set[tuple[int, int, str]] = set()

    @classmethod
    def of(cls, policy: Policy, detectors: Detectors, **options) -> StreamGuard:
        names = policy.rules.categories
        return cls({c: policy.action(c) for c in names}, {c: policy.citations(c) for c in names}, detectors, **options)

    def push(self, text: str) -> list[tuple]:
        return self._checked(lambda: self.cutter.push(text.encode("utf-8", "surrogatepass")))

    def finish(self) -> list[tuple]:
        return self._checked(self.cutter.finish)

    def _checked(self, windows) -> list[tuple]:
        out: list[tuple] = []
        if self.is_blocked:
            return out
        for w in windows():
            whole = None
            warns, blocks = [], []
            for tie, (a, b, id_, category) in enumerate(self.detectors.scan(w.text)):
                start, end = w.span(a, b)
                if not w.last and b == len(w.text) and start >= w.start + w.release:
                    continue  # judged in the next window, with all its context
                action, source = self.actions[category], f"local:{id_}"
                if action == "off" or (start, end, source) in self.reported:
                    continue
                self.reported.add((start, end, source))
                found = fingerprint(self.hmac_key, w.text[a:b]) if self.hmac_key is not None else None
                (blocks if action == "block" else warns).append((start, end, tie, action, category, source, None, self.citations[category], found))
            out += [(self.seg_no, i, "warn", 1, None, [f]) for i, f in enumerate(warns)]
            ord_ = len(warns)
            if blocks:
                out.append((self.seg_no, ord_, "block", len(blocks), None, blocks))
                ord_ += 1
                if self.mode == "filter":
                    self.is_blocked, self.cutter.buffer = True, b""
                    return out
            if w.release:
                whole = w.original[: w.release].decode("utf-8", "surrogatepass")
                out.append((self.seg_no, ord_, "release", 1, whole, []))
            self.seg_no += 1
            base = w.start + w.release
            self.reported = {r for r in self.reported if r[1] > base}
        return out


#: Chunks of a stream that may wait for their turn.
MOST_EARLY = 4096


@dataclass
class _Stream:
    """A key's state: its guard, chunks that came before their turn, and up to three bytes of a character cut in two."""

    guard: StreamGuard
    next_seq: int = 0
    early: dict[int, tuple[object, bool]] = field(default_factory=dict)
    decoder: object = field(default_factory=lambda: codecs.getincrementaldecoder("utf-8")("strict"))
    over: bool = False

    def dump(self) -> bytes:
        """What a state store keeps: where the stream is, and never the policy, the detectors or the key. Of a stream that is over nothing but that."""
        if self.over:
            return b""
        c, g = self.guard.cutter, self.guard
        return pickle.dumps((self.next_seq, self.early, self.decoder.getstate(), c.buffer, c.base, c.checked, c.first, g.seg_no, g.reported))

    @classmethod
    def load(cls, raw: bytes, guard: StreamGuard) -> _Stream:
        out = cls(guard)
        if not raw:
            out.over = True
            return out
        c = guard.cutter
        out.next_seq, out.early, decoder, c.buffer, c.base, c.checked, c.first, guard.seg_no, guard.reported = pickle.loads(raw)
        out.decoder.setstate(decoder)
        return out

    def take(self, seq: int, data, eos: bool) -> list[tuple]:
        out: list[tuple] = []
        if self.over or seq < self.next_seq:
            return out
        self.early[seq] = (data, eos)
        if len(self.early) > MOST_EARLY and self.next_seq not in self.early:
            self.over = True
            self.early.clear()
            return [(self.guard.seg_no, 0, "error", BAD_INPUT, f"more than {MOST_EARLY} chunks came before their turn", [])]
        while not self.over and self.next_seq in self.early:
            data, eos = self.early.pop(self.next_seq)
            self.next_seq += 1
            try:
                text = data if isinstance(data, str) else self.decoder.decode(bytes(data or b""), eos)
            except UnicodeDecodeError as e:
                why = "input ends inside a UTF-8 character" if "unexpected end" in str(e) else "input is not valid UTF-8"
                out.append((self.guard.seg_no, 0, "error", BAD_INPUT, why, []))
                self.over = True
                break
            out += self.guard.push(text)
            if eos:
                out += self.guard.finish()
                self.over = True
        if self.guard.is_blocked:
            self.over = True
        if self.over:
            self.early.clear()
        return out


def guard_stream(
    chunks: DataFrame,
    policy: Policy | None = None,
    mode: str = "filter",
    sizes: Sizes | None = None,
    allow: Allow | None = None,
    custom: dict[str, str] | None = None,
    hmac_key: bytes | None = None,
    corsica: str = "double",
) -> DataFrame:
    """Events of each stream of chunks (stream_id, seq from 0, text as string or binary, eos), append mode.

    Chunks may come out of order and more than once; each waits for its turn. State is bounded by a window and
    by what came early (MOST_EARLY chunks; more end the stream with an `error` event). It holds neither policy nor
    detectors nor key, so a configuration may change between runs. Of a stream that is over an empty state is left,
    which tells late copies of its chunks. Nothing is ever released by a timeout. Text that is not UTF-8 ends its
    stream with an `error` event before any of that chunk is pushed.
    """
    policy, detectors = policy or Policy(Rules.builtin()), Detectors(allow or Allow(), custom or {}, corsica)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        guard = StreamGuard.of(policy, detectors, sizes=sizes or Sizes(), mode=mode, hmac_key=hmac_key)
        stream = _Stream.load(state.get[0], guard) if state.exists else _Stream(guard)
        rows = sorted(((int(s), t, bool(e)) for pdf in batches for s, t, e in zip(pdf["seq"], pdf["text"], pdf["eos"])), key=lambda x: x[0])
        out = [event for row in rows for event in stream.take(*row)]
        state.update((stream.dump(),))
        yield pd.DataFrame([(key[0], *e) for e in out], columns=["stream_id", "seg_no", "ord", "kind", "n", "text", "findings"])

    grouped = chunks.selectExpr("CAST(stream_id AS STRING) AS stream_id", "seq", "text", "coalesce(eos, false) AS eos").groupBy("stream_id")
    return grouped.applyInPandasWithState(run, EVENTS, "state binary", "append", GroupStateTimeout.NoTimeout)

"""Command line: `scan [FILE]` filters or reports a file or standard input, `test TEXT` reports one string."""

from __future__ import annotations

import argparse
import codecs
import json
import sys

from .api import Guarded
from .operators.report import BAD_INPUT, BLOCKED, INTERNAL, OK, USAGE
from .plans.rules import audience
from .sources.text import CHUNK_BYTES, FORMATS, checked_format

FIELDS = ("start", "end", "tie", "action", "category", "source", "probability", "citations", "fingerprint")


def _parser() -> argparse.ArgumentParser:
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--audience", type=audience)
    common.add_argument("--config")
    common.add_argument("--model", choices=["auto", "off"], default="auto", help="off: no notice that no model is used")
    top = argparse.ArgumentParser(prog="cordon")
    commands = top.add_subparsers(dest="command", required=True)
    scan = commands.add_parser("scan", parents=[common])
    scan.add_argument("file", nargs="?")
    scan.add_argument("--format", choices=FORMATS, default="raw")
    scan.add_argument("--report", action="store_true")
    scan.add_argument("--fail-on-warn", action="store_true")
    test = commands.add_parser("test", parents=[common])
    test.add_argument("text")
    return top


def _json(f: tuple, who: str) -> str:
    own = dict(zip(FIELDS, f))
    own.pop("tie")
    ordered = {"audience": who, **{k: own[k] for k in ("action", "category", "source", "start", "end", "probability", "citations", "fingerprint")}}
    return json.dumps({k: v for k, v in ordered.items() if v is not None}, separators=(",", ":"))


def _report(text: str, guarded: Guarded, human: bool, fail_on_warn: bool, out) -> int:
    guard = guarded.guard("report")
    found = sorted((f for e in [*guard.push(text), *guard.finish()] for f in e[5]), key=lambda f: f[:2])
    raw, who = text.encode(), guarded.policy.audience
    blocks = sum(f[3] == "block" for f in found)
    warns = len(found) - blocks
    for f in found:
        if human:
            line = raw[: f[0]].count(b"\n") + 1
            print(f"{'BLOCK' if f[3] == 'block' else 'WARN '}  {f[4]:<16} line {line:<4} {f[5]:<22} {' · '.join(f[7])}", file=out)
        else:
            print(_json(f, who), file=out)
    if human:
        verdict = f'not safe to distribute to audience "{who}"' if blocks else f'review before distributing to audience "{who}"' if warns else f'nothing flagged for audience "{who}" by local rules'
        plural = lambda n, s: f"{n} {s}{'' if n == 1 else 's'}"
        print(f"{plural(blocks, 'blocking finding')}, {plural(warns, 'warning')} — {verdict}", file=out)
    return BLOCKED if blocks or (warns and fail_on_warn) else OK


def _filter(read, guarded: Guarded, fail_on_warn: bool, out, err) -> int:
    guard, decoder, warned, who = guarded.guard("filter"), codecs.getincrementaldecoder("utf-8")(), False, guarded.policy.audience
    while True:
        try:
            data = read(CHUNK_BYTES)
        except OSError as e:
            print(f"read error: {e}", file=err)
            return INTERNAL
        try:
            text = decoder.decode(data, not data)
        except UnicodeDecodeError:
            print("input is not valid UTF-8" if data else "input ends inside a UTF-8 character", file=err)
            return BAD_INPUT
        for _, _, kind, _, released, found in guard.push(text) if data else guard.finish():
            for f in found:
                print(_json(f, who), file=err)
            if kind == "block":
                return BLOCKED
            warned |= kind == "warn"
            if kind == "release":
                try:
                    out.write(released.encode())
                    out.flush()
                except BrokenPipeError:
                    return OK
                except OSError as e:
                    print(f"write error: {e}", file=err)
                    return INTERNAL
        if not data:
            return BLOCKED if warned and fail_on_warn else OK


def _opened(path: str):
    """A function that reads the file. A folder counts as opened; reading it fails."""
    try:
        return open(path, "rb").read
    except IsADirectoryError as e:
        why = e

    def fails(n: int) -> bytes:
        raise why

    return fails


def main(argv: list[str] | None = None, stdin=None, stdout=None, stderr=None) -> int:
    """Exit code: 0 released, 1 internal, 2 usage, 3 blocked, 4 bad input. stdin and stdout are binary."""
    stdin, stdout, stderr = stdin or sys.stdin.buffer, stdout or sys.stdout.buffer, stderr or sys.stderr
    try:
        args = _parser().parse_args(argv)
    except SystemExit as e:
        return e.code if isinstance(e.code, int) else USAGE
    import io

    said = io.TextIOWrapper(stdout, encoding="utf-8", write_through=True)
    try:
        if args.command == "scan":
            checked_format(args.format)
            read = _opened(args.file) if args.file else stdin.read
            if args.report:
                try:
                    text = read(-1).decode()
                except (UnicodeDecodeError, OSError) as e:
                    print(f"cannot read input: {e}", file=stderr)
                    return BAD_INPUT
        guarded = Guarded.load(args.config, args.audience, notice=False)
        if args.model == "auto":
            print("cordon: local rules only (identifiers); categories that need a model are not checked. --model off hides this notice.", file=stderr)
        if args.command == "test":
            return _report(args.text, guarded, True, False, said)
        if args.report:
            return _report(text, guarded, stdout.isatty(), args.fail_on_warn, said)
        return _filter(read, guarded, args.fail_on_warn, stdout, stderr)
    except (ValueError, OSError) as e:
        print(e, file=stderr)
        return USAGE
    finally:
        said.detach()


if __name__ == "__main__":
    sys.exit(main())

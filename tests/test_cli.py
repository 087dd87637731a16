"""The command line as a table: arguments, standard input, exit code, and what stands where."""

import io
import json

import pytest

from cordon.cli import main

from . import made

R = made.rng(11)
PROSE = made.prose(R, 1500)
CARD, NINO, IBAN = made.WRITTEN["payment_card"](made.card(R)), made.WRITTEN["uk_nino"](made.nino(R)), made.iban(R)
PHONE = "(415) 777-2040"


class Pipe(io.BytesIO):
    def isatty(self):
        return False


class Screen(io.BytesIO):
    def isatty(self):
        return True


class Broken(io.BytesIO):
    """Reads a part and then fails."""

    def read(self, n=-1):
        if self.tell() or n < 0:
            raise OSError("device is gone")
        return super().read(10)


def run(args, data=b"", out=None, notice=("--model", "off")):
    out, err = out or Pipe(), io.StringIO()
    code = main([*args, *notice], data if hasattr(data, "read") else io.BytesIO(data.encode() if isinstance(data, str) else data), out, err)
    return code, out.getvalue().decode(), err.getvalue()


def findings(text):
    return [(f["audience"], f["action"], f["category"], f["source"]) for f in map(json.loads, text.splitlines())]


FILTERS = [
    # arguments, input, code, what goes out, findings on standard error
    (["scan"], PROSE, 0, PROSE, []),
    (["scan"], "", 0, "", []),
    (["scan"], f"{PHONE} is warm", 3, "", [("site", "block", "contact", "local:phone")]),
    (["scan", "--audience", "investigation"], f"{PHONE} is warm", 0, f"{PHONE} is warm", [("investigation", "warn", "contact", "local:phone")]),
    (["scan", "--audience", "investigation", "--fail-on-warn"], f"{PHONE} is warm", 3, f"{PHONE} is warm", [("investigation", "warn", "contact", "local:phone")]),
    (["scan", "--audience", "public"], f"{CARD}.", 3, "", [("public", "block", "financial", "local:payment_card")]),
]


@pytest.mark.parametrize("args,data,code,out,found", FILTERS)
def test_filter(args, data, code, out, found):
    got = run(args, data)
    assert (got[0], got[1], findings(got[2])) == (code, out, found)


def test_filter_stops_before_the_identifier():
    code, out, err = run(["scan"], f"{PROSE} {IBAN} {PROSE}")
    assert code == 3 and PROSE.startswith(out) and len(out) > 500 and IBAN not in out + err


REPORTS = [
    (f"{NINO}\n{CARD}\n{PROSE}\n{IBAN} ", ["uk_nino", "payment_card", "iban"], 3),
    (PROSE, [], 0),
]


@pytest.mark.parametrize("data,found,code", REPORTS)
def test_report(data, found, code):
    got = run(["scan", "--report"], data)
    lines = [json.loads(x) for x in got[1].splitlines()]
    assert got[0] == code and [x["source"] for x in lines] == [f"local:{k}" for k in found]
    screen = run(["scan", "--report"], data, Screen())
    assert screen[0] == code and len(screen[1].splitlines()) == len(found) + 1
    for line, k in zip(screen[1].splitlines(), found):
        n = data[: data.index({"uk_nino": NINO, "payment_card": CARD, "iban": IBAN}[k])].count("\n") + 1
        assert line.startswith("BLOCK  ") and f"line {n} " in line and f"local:{k} " in line


def test_own_configuration(tmp_path):
    path = tmp_path / "own.toml"
    path.write_text("[identifiers]\nticket = 'T-\\d{4}'\n[allow]\nphones = ['4157772040']\n[override]\nfinancial = 'off'\n")
    data = f"{PHONE} {CARD} T-0042"
    for more, code in ([], 0), (["--fail-on-warn"], 3):
        got = run(["scan", "--config", str(path), *more], data)
        assert got[0] == code and findings(got[2]) == [("site", "warn", "employee_ref", "local:ticket")]


def test_one_string():
    code, out, _ = run(["test", f"see {NINO} "])
    first, last = out.splitlines()
    assert code == 3 and first.startswith("BLOCK  government_id ") and last.startswith("1 blocking finding, 0 warnings — not safe")
    assert run(["test", "nothing here"])[0] == 0


ERRORS = [
    (["scan"], b"\xffrest", 4),
    (["scan", "--report"], b"\xffrest", 4),
    (["scan"], "é".encode()[:1], 4),
    (["scan"], Broken(b"some text"), 1),
    (["scan", "--report"], Broken(b"some text"), 4),
    (["scan", "--format", "ndjson-ollama"], b"{}", 2),
    (["scan", "--config", "/nowhere/own.toml"], b"", 2),
    (["scan", "--audience", "friends"], b"", 2),
    (["scan", "/nowhere/text"], b"", 2),
    (["scan", "--report", "/nowhere/text"], b"", 2),
    (["look"], b"", 2),
]


@pytest.mark.parametrize("args,data,code", ERRORS)
def test_errors(args, data, code):
    got = run(args, data)
    assert got[0] == code and got[1] == ""


def test_a_folder_is_no_input(tmp_path):
    assert run(["scan", "--report", str(tmp_path)])[0] == 4 and run(["scan", str(tmp_path)])[0] == 1


def test_notice():
    code, _, err = run(["scan"], "text", notice=())
    assert code == 0 and "local rules only" in err and run(["scan"], "text")[2] == ""

"""Detectors, shadow text, windows and the stream's guard in plain Python, over identifiers made by `made`."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cordon.functions import plain
from cordon.functions import shadow as shadows
from cordon.functions.plain import Allow, Detectors
from cordon.functions.shadow import shadow
from cordon.functions.windows import Sizes, windows
from cordon.plans.rules import Config, Policy, Rules, checked_pattern
from cordon.streaming.guard_stream import StreamGuard, _Stream

from . import made

SIZES = [Sizes(), Sizes(70, 80, 120, 64), Sizes(65, 300, 301, 64)]


@pytest.mark.parametrize("kind", [*made.MAKERS, "contact"])
def test_made_identifiers_are_found_where_they_stand(kind):
    r = made.rng(kind)
    for _ in range(40):
        id_, lead, own = made.identifier(r, kind)
        text = f"{made.prose(r, r.randint(0, 60))} {lead}{own}, {made.prose(r, 20)}"
        at = text.index(own)
        assert (at, at + len(own), id_) in [d[:3] for d in Detectors().scan(text)], text


@pytest.mark.parametrize("kind", ["payment_card", "iban", "de_steuer_id", "fr_nir", "es_dni_nie", "it_codice_fiscale", "nl_bsn", "passport_mrz"])
def test_one_other_character_is_no_identifier(kind):
    r = made.rng(kind + "x")
    for _ in range(40):
        bad = made.changed(r, made.MAKERS[kind](r))
        assert kind not in [d[2] for d in Detectors().scan(f"{made.ASKED.get(kind, '')}{bad} {made.word(r)}")]


def test_numbers_that_need_a_word():
    r = made.rng(1)
    for kind, lead in made.ASKED.items():
        own = made.MAKERS[kind](r)
        near, far = lead + "x" * (39 - len(lead)) + " " + own, lead + "x" * 60 + " " + own
        assert [kind in [d[2] for d in Detectors().scan(t)] for t in (near, far, own)] == [True, False, False]


def test_iban_ends_where_its_country_says():
    r = made.rng(2)
    own = made.WRITTEN["iban"](made.iban(r))
    text = f"pay {own} WITHIN TEN DAYS"
    assert own in [text[a:b] for a, b, k, _ in Detectors().scan(text) if k == "iban"]


def test_allowlists_and_own_patterns():
    own = Detectors(Allow(emails=("Desk@Works.io",), domains=("inside.org",), phones=("415.777.2040",)), {"ticket": r"T-\d{4}"})
    said = "desk@works.io, x@inside.org, y@deep.inside.org, (415) 777-2040, z@notinside.org, T-0042"
    assert [said[a:b] for a, b, *_ in own.scan(said)] == ["z@notinside.org", "T-0042"]


def test_what_is_reserved_or_free_of_charge():
    for text in ("a@b.test", "a@deep.example.org", "icon@3x.svg", "git@gitlab.com", "4242 4242 4242 4242", "078-05-1120", "833-777-2040", "(415) 555-0142"):
        assert Detectors().scan(text) == [], text


def test_corsican_numbers():
    r = made.rng(3)
    for _ in range(20):
        body, less = f"1{r.randint(10, 99)}0{r.randint(1, 9)}", r.choice([("2A", "19", 1_000_000), ("2B", "18", 2_000_000)])
        rest = f"{r.randint(100, 999)}{r.randint(100, 999)}"
        number = int(body + less[1] + rest)
        official, double = f"{97 - number % 97:02d}", f"{97 - (number - less[2]) % 97:02d}"
        own = body + less[0] + rest
        assert plain.fr_nir(own + official, "official") and plain.fr_nir(own + double)
        assert official == double or not plain.fr_nir(own + official)


@pytest.mark.parametrize("how", made.DISGUISES)
def test_shadow_undoes_disguises(how):
    r = made.rng(how)
    for _ in range(40):
        _, lead, own = made.identifier(r)
        before, hidden = made.prose(r, 30), made.disguised(own, how)
        text, first, end = shadow(before + hidden + " z")
        at = text.index(own)
        assert text[at : at + len(own)] == own
        if first:
            b = len(before.encode())
            assert (first[at], end[at + len(own) - 1]) == (b, b + len(hidden.encode()))


def test_shadow_of_single_characters():
    assert shadow("½")[0] == "1⁄2" and shadow("[at)")[0] == "[at)" and shadow("（at）")[0] == "(at)"
    assert shadow("naïve “x”")[1] is None
    for a, b in shadows.SAME:
        assert all(shadows.shadow_char(chr(c)) == chr(c) for c in range(a, b + 1)), hex(a)


def _stream(sizes, chunks, audience="site", mode="filter"):
    guard = StreamGuard.of(Policy(Rules.builtin(), audience), Detectors(), sizes=sizes, mode=mode)
    out = [e for c in chunks for e in guard.push(c)] + guard.finish()
    return out, guard.is_blocked


def _released(events):
    return "".join(e[4] for e in events if e[2] == "release")


def _pieces(r, text, longest):
    out, at = [], 0
    while at < len(text):
        n = r.randint(1, longest)
        out.append(text[at : at + n])
        at += n
    return out


@settings(max_examples=400, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from(SIZES), st.sampled_from(made.DISGUISES))
def test_nothing_from_the_identifier_on_gets_out(seed, sizes, how):
    r = made.rng(seed)
    _, lead, own = made.identifier(r)
    hidden = made.disguised(own, how)
    # its place is drawn around the places where windows end
    place = max(0, r.choice([sizes.first_min, sizes.min, sizes.max, 2 * sizes.max]) + r.randint(-90, 90))
    text = f"{made.prose(r, place)} {lead}{hidden} {made.prose(r, r.randint(0, sizes.max))}"
    events, blocked = _stream(sizes, _pieces(r, text, r.choice([1, 2, 17, sizes.min, 4 * sizes.max])))
    out = _released(events)
    assert blocked and text.startswith(out) and len(out) <= text.index(hidden)
    assert events == _stream(sizes, [text])[0]


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from(SIZES))
def test_prose_passes_as_it_is(seed, sizes):
    r = made.rng(seed)
    text = made.prose(r, r.randint(0, 4 * sizes.max))
    events, blocked = _stream(sizes, _pieces(r, text, r.choice([1, 30, 2000])))
    assert not blocked and _released(events) == text


#: Text full of numbers that identify nobody.
NUMBERS = """Inspection 2024-11-05 07:45, permit PTW-2024-0193, revision 3.12.1, see chapter 12.4 and table 9-2.
Limit 500 ppm over 8 h, peak 750 ppm; flash point -18.0 C, pH 6.5-7.5; UN 1090.
Order 4500012345, pallet 00340123450000000018, part 7000-4411-02, serial SN-88213-A, drawing A1-2231-77.
Coordinates 52.5200, 13.4050; load 12 500 kg; torque 85-95 Nm; 3 x 400 V; IP 10.20.30.40; port 8443.
Commit 9f86d081884c7d659a2feaa0c55ad015, file icon@2x.png.
Call the desk at extension 4417, or 1-800-555-0199. Write to info@example.org. Budget 1,250,000.00 EUR.
"""


def test_numbers_that_identify_nobody():
    assert [e for e in _stream(Sizes(), [NUMBERS * 3], "public", "report")[0] if e[2] != "release"] == []


def test_a_report_goes_on_and_a_warning_lets_pass():
    r = made.rng(4)
    text = f"{made.prose(r, 300)} {made.MAKERS['iban'](r)} {made.prose(r, 900)} {made.WRITTEN['uk_nino'](made.nino(r))}."
    events, _ = _stream(Sizes(), [text], mode="report")
    assert [f[5] for e in events for f in e[5]] == ["local:iban", "local:uk_nino"] and _released(events) == text
    warned, blocked = _stream(Sizes(), [made.prose(r, 50) + " (415) 777-2040 "], "investigation")
    assert not blocked and [e[2] for e in warned] == ["warn", "release"]


@pytest.mark.parametrize("args", [(100, 240, 800, 63), (64, 240, 800, 64), (300, 240, 800, 64), (100, 900, 800, 64)])
def test_bad_sizes(args):
    with pytest.raises(ValueError):
        Sizes(*args)


def test_windows_cover_the_text():
    r = made.rng(5)
    for _ in range(50):
        text = "".join(r.choice(["word ", "é", ". ", "\n", "x" * 50]) for _ in range(r.randint(0, 300)))
        out = windows(text, Sizes())
        ends = [w.start + w.release for w in out]
        assert [0, *ends[:-1]] == [w.start for w in out] or not out
        assert not out or ends[-1] == len(text.encode())


def _make():
    return _Stream(StreamGuard.of(Policy(Rules.builtin()), Detectors(), hmac_key=b"key of the streams"))


def test_chunks_in_any_order_and_twice():
    r = made.rng(6)
    raw = f"{made.prose(r, 400)} {made.card(r)} {made.prose(r, 100)}".encode()
    rows = [(i, raw[7 * i : 7 * i + 7], 7 * i + 7 >= len(raw)) for i in range(-(-len(raw) // 7))]
    r.shuffle(rows)
    one = _make()
    assert [e for row in rows + rows for e in one.take(*row)] == _make().take(0, raw, True)


def test_stored_state_goes_on_without_the_key():
    r = made.rng(7)
    raw = f"{made.prose(r, 700)} {made.card(r)} {made.prose(r, 100)}".encode()
    rows = [(i, raw[9 * i : 9 * i + 9], 9 * i + 9 >= len(raw)) for i in range(-(-len(raw) // 9))]
    r.shuffle(rows)
    out, kept = [], None
    for row in rows + rows[:5]:
        one = _make() if kept is None else _Stream.load(kept, _make().guard)
        out += one.take(*row)
        kept = one.dump()
        assert b"key of the streams" not in kept
    assert out == _make().take(0, raw, True) and kept == b""


def test_too_many_chunks_before_their_turn():
    one = _make()
    out = [e for i in range(1, 5000) for e in one.take(i, "x", False)]
    assert [e[2] for e in out] == ["error"] and one.over and not one.early


@pytest.mark.parametrize("data,eos,why", [(b"abc\xff", True, "not valid"), (b"abc\xc3", True, "inside")])
def test_bad_utf8(data, eos, why):
    out = _make().take(0, data, eos)
    assert [e[2] for e in out] == ["error"] and why in out[0][4]


def test_rules_and_policy():
    rules = Rules.builtin()
    order = ["off", "warn", "block"]
    for rule in rules.categories.values():
        ranks = [order.index(rule.actions[a]) for a in ("investigation", "site", "public")]
        assert ranks == sorted(ranks)
    assert Policy(rules, "public", {"contact": "off"}).action("contact") == "off"
    with pytest.raises(ValueError):
        Rules.parse("version = 2\n[categories]")
    with pytest.raises(ValueError):
        Rules.parse("version = 1\n[categories]")


def test_config():
    own = Config.parse('audience = "public"\n[identifiers]\nticket = \'T-\\d{4}\'\n[allow]\nemails = ["a@b.co"]\n[override]\ncontact = "warn"\n[segment]\nmax = 900\n[model]\non_error = "local-only"')
    assert own.policy().action("contact") == "warn" and own.policy("site").audience == "site" and own.sizes.max == 900
    for bad in ("audiance = 'site'", "[segment]\nmaxx = 1", "[override]\ncontact = 'stop'", "[identifiers]\nx = '('", "[allow]\nmail = []"):
        with pytest.raises(ValueError):
            Config.parse(bad)


@pytest.mark.parametrize("pattern", [r"a*", r"(?=x)y", r"(a)\1", "("])
def test_bad_custom_patterns(pattern):
    with pytest.raises(ValueError):
        checked_pattern("x", pattern)

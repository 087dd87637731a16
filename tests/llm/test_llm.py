"""Each operator against a brute-force version, and over nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cordon.llm import exact_dedup, hilbert_sharding, hnsw_dedup, html_extraction, html_pages, line_dedup, minhash_dedup, mixing, queries, sentencepiece, shared, substring_dedup, toxicity
from cordon.llm.html_tree import parse
from cordon.llm.words import Words, runs

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, h string, level string, name string, bucket string, component string, n int, key string, term string"
LINE = "This line stands in very many documents."
rng = random.Random(3)
WORDS = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]


def sentence(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def corpus(n=60, seed=1):
    """Rows with nulls, empties, copies, near copies, shared lines and passages, long texts, and repeated rows."""
    r, out = random.Random(seed), []
    passage = sentence(r, 70)
    for i in range(n):
        k = r.random()
        if k < 0.15 and out and out[-1][1]:
            text = out[-1][1]
        elif k < 0.25 and out and out[-1][1] and len(out[-1][1].split()) > 40:
            words = out[-1][1].split(" ")
            words[r.randrange(len(words))] = "changed"
            text = " ".join(words)
        elif k < 0.35:
            text = f"{sentence(r, 30)}\n  {LINE.upper()}\t\n{sentence(r, 20)}\n{LINE}"
        elif k < 0.5:
            text = f"{sentence(r, r.randint(1, 60))} {passage} {sentence(r, r.randint(0, 40))}"
        else:
            text = "\n".join(sentence(r, r.randint(0, 25)) for _ in range(r.randint(1, 6)))
        out.append((i * 3 + 1, text))
    out += [(1000, None), (1001, ""), (1002, " \t\n "), (1003, "ÀÉ " + LINE), (1004, (sentence(r, 400) + "\n") * 40), (1005, "x" * 20000), (None, "no id " + LINE), (1006, "É Bb"), (1007, "É bB")]
    out.append(out[3])
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), *(["x"] * 6), 7, "k", "t") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


# --- 1

def test_hilbert_curve_takes_single_steps(spark):
    n = 8
    df = spark.range(n**3).selectExpr("CAST(id DIV 64 AS INT) a", "CAST(id DIV 8 % 8 AS INT) b", "CAST(id % 8 AS INT) c")
    path = hilbert_sharding.with_hilbert(df, [F.col("a"), F.col("b"), F.col("c")], 3, "at").orderBy("at").collect()
    assert [p["at"] for p in path] == list(range(n**3))
    assert all(abs(p.a - q.a) + abs(p.b - q.b) + abs(p.c - q.c) == 1 for p, q in zip(path, path[1:]))


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards(spark, docs, rows, law):
    got = hilbert_sharding.shard_rows(docs, law=law, shards=5).toPandas()
    want = sorted((i if i is not None else -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted(zip(got.doc_id.fillna(-1).astype(int), got["size"], got.text_crc32)) == want
    assert got["shard"].between(0, 4).all()
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
        assert part.sort_values("slot").curve.is_monotonic_increasing
    if law == "rows":
        sizes = got.groupby("shard").size()
        assert sizes.max() - sizes.min() <= 1


def test_shards_without_rows_and_files(spark, docs, empty, tmp_path):
    assert hilbert_sharding.shard_rows(empty).count() == 0
    # rows without an id, repeated rows and columns of the same names are kept as they are
    mine = docs.withColumn("shard", F.lit("mine")).withColumn("slot", F.lit(7))
    to = hilbert_sharding.write_shards(mine, f"{tmp_path}/out", shards=3)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert to == "_shard" and out.select(to).distinct().count() == 3 and out.where("shard <> 'mine' OR slot <> 7").count() == 0
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)


def test_files_of_shards_are_pruned_in_every_dimension(spark, tmp_path):
    own = spark.range(12000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', CAST(pmod(xxhash64(id), 4000) AS INT))").alias("text"), F.expr("concat('src', pmod(xxhash64(id, 1), 20))").alias("source"), F.expr("element_at(array('de', 'en', 'es', 'fr'), CAST(pmod(xxhash64(id, 2), 4) + 1 AS INT))").alias("lang"))
    hilbert_sharding.write_shards(own, f"{tmp_path}/pruned", shards=24)
    out = spark.read.parquet(f"{tmp_path}/pruned").withColumn("size", F.length("text"))
    ranges = out.groupBy("shard").agg(*[f(d).alias(f"{n}_{d}") for d in ("source", "lang", "size") for n, f in (("lo", F.min), ("hi", F.max))]).toPandas()
    assert len(ranges) == 24
    # shards that a filter on one value has to read, of all
    wanted = {"source": [f"src{i}" for i in range(20)], "lang": ["de", "en", "es", "fr"], "size": list(range(100, 4000, 300))}
    read = {d: np.mean([((ranges[f"lo_{d}"] <= v) & (ranges[f"hi_{d}"] >= v)).mean() for v in vs]) for d, vs in wanted.items()}
    assert all(x < 0.6 for x in read.values()), read


# --- 2

def line_brute(rows, least=20, docs=3):
    strip = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    seen = defaultdict(list)
    ids = [i if i is not None else shared.NULL_ID for i, _ in rows]
    for n, (_, t) in enumerate(rows):
        for k in {strip(x) for x in (t or "").split("\n")}:
            seen[k].append(n)
    out = []
    for n, (i, t) in enumerate(rows):
        own = (t or "").split("\n")
        gone = [len(k) >= least and len(seen[k]) >= docs and max(ids[m] for m in seen[k]) != ids[n] for k in map(strip, own)]
        out.append((i, len(own), sum(gone), sha("\n".join(x for x, g in zip(own, gone) if not g))))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"keys_per_shard": 1, "broadcast_bytes": 1}])
def test_line_dedup(docs, rows, options):
    assert sorted(map(tuple, line_dedup.line_report(docs, **options).collect()), key=str) == line_brute(rows)


def test_line_dedup_keeps_columns(docs, empty, rows):
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == len(rows) and line_dedup.line_report(empty).count() == 0
    assert out.where("doc_id = 1000 AND text IS NOT NULL").count() == 0


def test_perfect_hash():
    keys = np.random.default_rng(1).integers(0, 2**63, 20000, dtype=np.uint64)
    h = line_dedup.PerfectHash.build(keys)
    assert sorted(h.index(keys)) == list(range(len(keys)))
    shard = line_dedup.LineShard.load(line_dedup.LineShard.build(keys.view(np.int64), keys.view(np.int64) + 1, np.ones(len(keys)), np.arange(len(keys))).dump())
    found, keeper = shard.probe(keys.view(np.int64), keys.view(np.int64) + 1)
    assert found.all() and (keeper == np.arange(len(keys))).all()
    assert not shard.probe(keys.view(np.int64) + 7, keys.view(np.int64))[0].any()


# --- 3

def test_hnsw(spark):
    g = np.random.default_rng(4)
    base = g.normal(size=(40, 8))
    rows = [(i, (base[i % 40] + g.normal(size=8) * (0.05 if i % 3 else 0.4)).tolist(), i % 4) for i in range(400)]
    rows += [(1000 + i, [1.0] * 8, 1) for i in range(30)] + [(2000, None, 1), (2001, [0.0] * 8, 1), (2002, [float("nan")] * 8, 1), (2003, [1.0] * 7 + [None], 1), (2004, [1.0] * 8, None), (2005, [float("inf")] * 8, 1), (2006, [], 1), (2007, [2.0] * 8, 1), (2008, [1.0] * 5, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit("x")).withColumn("cid", F.lit(1))
    ok = [(i, np.array(v, np.float32).astype(float), l) for i, v, l in rows if l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = defaultdict(set)
    for a, u, l in ok:
        for b, v, m in ok:
            if a != b and l == m and len(u) == len(v) and u @ v / (np.sqrt(u @ u) * np.sqrt(v @ v)) >= 0.93:
                links[a].add(b)
    want, seen = {}, {}
    for i, _, _ in rows:
        if i in seen:
            continue
        todo, own = [i], {i}
        while todo:
            for j in links[todo.pop()] - own:
                own.add(j)
                todo.append(j)
        seen.update(dict.fromkeys(own, min(own)))
    want = {i: (len(links[i]), seen[i], seen[i] == i) for i, _, _ in rows}
    for options in ({}, {"shard_rows": 40, "block_rows": 25}):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hnsw_dedup.near_vectors(df, **options).collect()}
        assert set(got) == set(want)
        assert got == want
    named = df.withColumn("label", F.concat(F.lit("label "), F.col("label").cast("string")))
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hnsw_dedup.near_vectors(named, shard_rows=60).collect()} == want
    assert hnsw_dedup.near_vectors(df.where("false")).count() == 0


def test_graph_finds_what_a_scan_finds():
    g = np.random.default_rng(14)
    near = g.normal(size=(30, 16))[g.integers(0, 30, 1500)] + g.normal(size=(1500, 16)) * 0.12
    x = hnsw_dedup._units(np.vstack([near, g.normal(size=(1500, 16))]))
    q = np.vstack([x[::3], hnsw_dedup._units(near[:200] + 0.01)])
    graph = hnsw_dedup.Graph(x)
    assert len(graph.next) > 2
    got = {(int(i), int(j)) for row, node in hnsw_dedup.searches(graph, x, q, 0.93, 32, 64) for i, j in zip(row, node)}
    want = set(zip(*(y.tolist() for y in hnsw_dedup.scan(x, q, 0.93))))
    assert got <= want and len(got) >= 0.999 * len(want)
    # a graph without links fails its audits; the block is scanned
    for n in graph.next:
        n[:] = -1
    got = {(int(i), int(j)) for row, node in hnsw_dedup.searches(graph, x, q, 0.93, 32, 64) for i, j in zip(row, node)}
    assert got == want


# --- 4

@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.load_pieces(MODEL)


def best_score(pieces, text):
    """The highest sum of scores, by plain dynamic programming over characters."""
    table = {n: s for n, s, k in zip(pieces.names, pieces.scores, pieces.kinds) if k == 1}
    x = "▁" + text.replace(" ", "▁")
    best = [0.0] + [-np.inf] * len(x)
    for e in range(1, len(x) + 1):
        for a in range(max(0, e - 16), e):
            s = table.get(x[a:e], pieces.unknown if e - a == 1 else -np.inf)
            best[e] = max(best[e], best[a] + s)
    return best[-1]


def path_score(pieces, ids):
    out, i = 0.0, 0
    while i < len(ids):
        if pieces.kinds[ids[i]] == 6:
            first = int(pieces.names[ids[i]][3:5], 16)
            out, i = out + pieces.unknown, i + (1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4)
        else:
            out, i = out + pieces.scores[ids[i]], i + 1
    return out


def test_pieces(pieces):
    r = random.Random(2)
    alphabet = "etaoin shrdlu  é漢🦊\n▂zq" * 2
    texts = ["", " ", "Hello world", "  two  spaces ", *("".join(r.choice(alphabet) for _ in range(r.randint(1, 60))) for _ in range(150)), "a" * 300 + "é" * 100, "the ballot question; of mentre"]
    ids, counts = pieces.encode_batch(texts)
    assert pieces.decode_batch(ids, counts) == texts
    for t, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        if t:
            assert path_score(pieces, own) == pytest.approx(best_score(pieces, t)), t


def test_pieces_of_rows(spark, docs, empty, pieces, rows):
    out = sentencepiece.coded_documents(docs, MODEL)
    assert out.count() == len(rows) and out.where("NOT round_trip").count() == 0
    assert sentencepiece.coded_documents(empty, MODEL).count() == 0
    assert out.where("doc_id = 1000 AND pieces IS NULL").count() == 1 and out.where("doc_id = 1001 AND size(pieces) = 0").count() == 1
    for r in out.where("doc_id <> 1004 AND n_pieces BETWEEN 1 AND 3000").join(docs.select("doc_id", "text"), "doc_id").collect():
        assert path_score(pieces, r.pieces) == pytest.approx(best_score(pieces, r.text))
    with_columns = sentencepiece.encode(docs.withColumn("pieces", F.lit("x")).withColumn("Ok", F.lit(1)), pieces, check="ok")
    assert with_columns.columns == [*docs.columns, "pieces", "ok"]
    assert with_columns.where("NOT ok").count() == 0


def test_log_scores_take_whole_words(pieces):
    said = "The quick brown fox jumps over the lazy dog"
    own = [pieces.names[i] for i in pieces.encode_batch([said])[0]]
    assert own == ["▁The", "▁quick", "▁brown", "▁f", "ox", "▁j", "umps", "▁over", "▁the", "▁lazy", "▁dog"]
    assert np.exp(pieces.scores[pieces.kinds == 1]).sum() == pytest.approx(1)


def test_double_array():
    words = [(w.encode(), i) for i, w in enumerate(dict.fromkeys(WORDS))]
    trie = sentencepiece.DoubleArray.build(words)
    for w, v in words:
        s = 0
        for b in w:
            t = trie.base[s] + b
            assert trie.check[t] == s
            s = t
        assert trie.value[s] == v


# --- 5

def truth(html):
    labels, tree = html_extraction.TreeModel._labels(html), parse(html)
    assert len(labels) == len(tree.tag)
    return " ".join(x for n, x in tree.texts if labels[n] == html_pages.CONTENT)


@pytest.fixture(scope="module")
def model():
    return html_extraction.TreeModel()


def _exact(model, layout):
    pages = html_pages.labelled_pages(120, 4242, [layout])
    return np.mean([Counter(got.split()) == Counter(truth(html).split()) for got, html in zip(model.main_texts(pages), pages)])


@pytest.mark.parametrize("layout,least,unseen", [("usual", 0.95, 0.9), ("strange", 0.7, 0.7), ("short", 0.85, 0.8), ("bare", 0.9, 0.8), ("table", 0.7, 0.2)])
def test_held_out_pages_and_layouts(model, layout, least, unseen):
    assert _exact(model, layout) >= least
    others = [x for x in html_pages.LAYOUTS if x != layout]
    assert _exact(html_extraction.TreeModel(600, layouts=others), layout) >= unseen


SMALL = [
    ("<article><p>Short one.</p></article>", "Short one."),
    ("<article><p>Short one.</p><form><input><button>Go</button></form></article>", "Short one."),
    ("<article><p>Short one.</p><p hidden>Not seen at all.</p></article>", "Short one."),
    ("<article><p>Short one.</p><select><option>a</option></select></article>", "Short one."),
    ('<article><h1>Title here</h1><p>One paragraph of some words.</p><section class="comments"><h2>Comments</h2><article class="comment"><p>I like this.</p></article></section></article>', "Title here One paragraph of some words."),
    ("<h1>Title</h1><p>First paragraph of the page.</p><p>Second paragraph of the page.</p>", "Title First paragraph of the page. Second paragraph of the page."),
    (
        '<div class="qx1"><a href=/>Home</a> <a href=/b>About</a></div><div class="zzt"><h2>Title of it</h2><p>This is a paragraph with quite a few words so that it counts as text, with more to say.</p><p>And here is the second paragraph, which goes on for a while as well.</p></div><div class="vvw">© 2024 Someone</div>',
        "Title of it This is a paragraph with quite a few words so that it counts as text, with more to say. And here is the second paragraph, which goes on for a while as well.",
    ),
    ("<nav><ul><li><a href=/>Home</a></li></ul></nav>", ""),
]


def test_small_pages(model):
    got = model.main_texts([f"<html><body>{x}</body></html>" for x, _ in SMALL])
    assert got == [want for _, want in SMALL]


def test_marginals_are_exact():
    """Messages against a sum over all labelings of a small tree."""
    model, tree = html_extraction.TreeModel(200), parse("<html><body><div class=nav><a href=x>y</a></div><article><p>One two three.</p><div>z</div></article></body></html>")
    marks = html_extraction.tree_marks(tree)
    own = np.array([model.potential(*m) for m in marks])
    total, content = 0.0, np.zeros(len(tree.tag))
    import itertools

    for y in itertools.product(range(3), repeat=len(tree.tag) - 1):
        y = (0, *y)
        p = np.exp(sum(own[i, y[i]] + model.edge(tree.tag[i])[y[tree.parent[i]], y[i]] for i in range(1, len(y))))
        total += p
        content += p * (np.array(y) == html_pages.CONTENT)
    assert np.allclose(model.content([tree])[0], content / total)


def test_pages(spark):
    html = "<!DOCTYPE html><html><head><title>T</title><script>var a='</p>'</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>Big &amp; small</h1><p>One<br>two <b>three<p>Fo&eacute;r  five.\n six</p></article><footer>&copy; x</footer>"
    rows = [(1, "u", html), (2, "u", None), (3, "u", ""), (4, "u", html), (5, "u", "<p" * 2000), (6, "u", "<div>" * 3000 + "x"), (7, "u", "a < b <")]
    got = {r.page_id: (r.text, r.n_chars) for r in html_extraction.extraction_report(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("other"))).collect()}
    text = "Big & small One two three Foér five. six"
    assert got[1] == got[4] == (text, len(text)) and got[2] == got[3] == ("", 0) and len(got) == 7
    assert html_extraction.extraction_report(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_test_pages(model):
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    got = model.main_texts(list(pages.html))
    import html as h

    for page, text in zip(pages.html, got):
        inner = page[page.index("<article>") + 9 : page.index("</article>")]
        parts = [" ".join(h.unescape(x.replace("<br>", " ").replace("<b>", "")).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert text == " ".join(p for p in parts if p)


# --- 6

def substring_brute(rows, n=50):
    ids = [i if i is not None else shared.NULL_ID for i, _ in rows]
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first: dict = {}
    for d, w in zip(ids, words):
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            first[k] = min(first.get(k, d), d)
    out = []
    for (i, _), d, w in zip(rows, ids, words):
        gone = set()
        for a in range(len(w) - n + 1):
            if first[tuple(w[a : a + n])] < d:
                gone.update(range(a, a + n))
        out.append((i, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"most_shared": 1}, {"group_rows": 5, "most_shared": 3}])
def test_substring_dedup(docs, rows, options):
    assert sorted(map(tuple, substring_dedup.substring_report(docs, **options).collect()), key=str) == substring_brute(rows)


def test_suffix_tree():
    r = random.Random(5)
    sequences = [" ".join(r.choice("ab") for _ in range(r.randint(8, 30))).encode() for _ in range(20)]
    counts = np.array([s.count(b" ") + 1 - 7 for s in sequences])
    tree = substring_dedup.SuffixTree(sequences, counts, 8)
    suffixes = [tuple(s.split()[i : i + 8]) for s, n in zip(sequences, counts) for i in range(n)]
    same = lambda x, y: next((k for k in range(8) if x[k] != y[k]), 8)
    assert tree.shared.tolist() == [0] + [same(suffixes[i], suffixes[j]) for i, j in zip(tree.order, tree.order[1:])]
    for depth in (1, 5, 8):
        nodes = defaultdict(set)
        for x, n in zip(suffixes, tree.nodes(depth).tolist()):
            nodes[n].add(x[:depth])
        assert all(len(v) == 1 for v in nodes.values()) and len(nodes) == len({x[:depth] for x in suffixes})


def test_substring_without_rows(empty):
    assert substring_dedup.substring_report(empty).count() == 0


def test_words():
    texts = ["a b c", "", "  hello   wörld\nx ", "a b c a b", " x"]
    w = Words([t.encode() for t in texts])
    for i, t in enumerate(texts):
        own = [w.raw[s:e].tobytes().decode() for s, e in zip(w.start[w.first[i] : w.last[i]], w.end[w.first[i] : w.last[i]])]
        assert own == re.findall(r"[^\x20\x09-\x0D]+", t)
    assert (w.hash[:3] == w.hash[w.first[3] : w.first[3] + 3]).all()
    x = np.arange(200, dtype=np.uint64) % np.uint64(60)
    for n in (1, 2, 3, 5, 16, 50):
        out = runs(x, n)
        assert len(out) == 200 - n + 1 and len(set(out[:60].tolist())) == 60 and (out[: 141 - n] == out[60:]).all()


# --- 7

def test_mixing(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i, _ in rows if i is not None] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    out = mixing.mixing_report(docs, labels).toPandas()
    assert len(out) == len(rows) and (out.rate >= 0).all()
    n_tokens = {i: len((t or "").split()) for i, t in rows}
    assert all(n_tokens[i] == n for i, n in zip(out.doc_id.astype(object).where(out.doc_id.notna(), None), out.n_tokens))
    none = labels.where("false")
    assert len(mixing.mixing_report(docs, none).toPandas()) == len(rows)
    assert mixing.mixing_report(empty, labels).count() == 0
    kept = mixing.mixed(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id IS NOT NULL").select("doc_id").distinct().count() == len({i for i, _ in rows if i is not None})
    plan = mixing.mixing_report(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_targets_are_met(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = mixing.mixing_report(docs, labels).toPandas()
    total = sum(n * r for n, r in zip(out.n_tokens, out.rate))
    share = sum(n * r * p[1] for n, r, p in zip(out.n_tokens, out.rate, out.posteriors)) / total
    assert share == pytest.approx(0.9, abs=0.01) and total == pytest.approx(out.n_tokens.sum(), rel=0.02)
    up = mixing.fit_rates(docs, labels, least=1.0)[1].toPandas()
    assert (up.rate >= 1).all()
    bound = mixing.mixing_report(docs, labels, least=1.0, growth=1.1, targets={1: 0.99, 0: 0.01}).toPandas()
    assert (bound.rate >= 1).all() and (bound.rate * bound.n_tokens).sum() < 1.35 * bound.n_tokens.sum()


def test_rates_are_those_of_plain_projected_gradient(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = mixing.mixing_report(docs, labels).toPandas()
    w = out.n_tokens.to_numpy(float) / out.n_tokens.sum()
    p = np.array(out.posteriors.tolist())
    goal, ridge = np.array([0.1, 0.9]), 1e-3
    loss = lambda r: 0.5 * ((w * r @ p - goal) ** 2).sum() + 0.5 * ridge * (w * (r - 1) ** 2).sum()
    best = np.ones(len(w))
    for _ in range(5000):
        best = np.maximum(0, best - 0.5 * (p @ (w * best @ p - goal) + ridge * (best - 1)))
    assert loss(out.rate.to_numpy()) <= loss(best) + 1e-4
    assert w * out.rate @ p == pytest.approx(w * best @ p, abs=5e-3)


def test_domains_of_held_out_documents(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").dropDuplicates(["doc_id"])
    out = mixing.mixing_report(docs, labels.where("doc_id % 5 <> 0")).join(labels.where("doc_id % 5 = 0 AND quality IS NOT NULL"), "doc_id").toPandas()
    base = max(out.quality.mean(), 1 - out.quality.mean())
    right = (out.domain == out.quality).mean()
    assert right >= 0.95 or right > base + 0.5 * (1 - base), (right, base)


def test_pipeline_reaches_its_mix_on_skewed_rows(spark, tmp_path):
    r, own, labels = random.Random(4), [], []
    for i in range(240):
        good = i % 4 == 0
        own.append((i, sentence(r, 150) if good else "#$% " * 150))
        labels.append((i, int(good), 0))
    docs, low_ = frame(spark, own), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    low_.write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.mix(spark, docs, str(tmp_path)).join(low_, "doc_id")
    n = {x.quality: x.n for x in out.groupBy("quality").agg(F.sum(F.size(F.split(F.trim("text"), " +"))).alias("n")).collect()}
    assert n[1] / (n[0] + n[1]) == pytest.approx(corpus_pipeline.MIX[1], abs=0.02)
    assert out.select("doc_id").distinct().count() == 240


# --- 8

def exact_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t or "")].append(i)
    order = lambda i: shared.NULL_ID if i is None else i
    return sorted(((i, max(groups[low(t or "")], key=order), len(groups[low(t or "")]), sha(low(t or ""))) for i, t in rows), key=str)


@pytest.mark.parametrize("block", [8192, 64, 5])
def test_exact_dedup(docs, rows, block):
    own = docs.where("doc_id IS NULL OR doc_id NOT IN (1004, 1005)") if block == 5 else docs
    used = [(i, t) for i, t in rows if block != 5 or i not in (1004, 1005)]
    out = exact_dedup.exact_duplicates(own, block).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out), key=str) == exact_brute(used)
    kept = Counter(r.text_sha256 for r in out if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({r.text_sha256 for r in out}) and all(r.doc_id == r.keep_id for r in out if r.kept)


def test_exact_dedup_does_not_trust_hashes(docs, rows):
    ids = exact_dedup.identities(docs, shared.ascii_lower(F.col("text")), 64, lambda b: F.octet_length(b).cast("long")).collect()
    names = defaultdict(set)
    for r in ids:
        names[(r.level, r["name"])].add(r.text_sha256)
    assert all(len(v) == 1 for v in names.values()) and len(names) == len({r.text_sha256 for r in ids})


def test_block_names_do_not_depend_on_how_rows_are_dealt(docs):
    text = shared.ascii_lower(F.col("text"))
    one, other = ({(r.text_sha256, r.level, r["name"]) for r in exact_dedup.identities(d, text, 64).collect()} for d in (docs.coalesce(1), docs.repartition(7, "text")))
    assert one == other


def test_exact_dedup_without_rows(empty):
    assert exact_dedup.exact_duplicates(empty).count() == 0


# --- 9

def near_brute(rows, similarity=0.8):
    """Classes from all pairs, with tuples of words as shingles and plain counters as weights."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for _, t in rows]
    df = Counter(w for own in words for w in set(own))
    idf = {w: float(np.float32(1 - np.log(max(n / len(rows), 1 / 1024)) / np.log(1024))) for w, n in df.items()}
    weights = []
    for own in words:
        n = min(5, len(own))
        grams = Counter(tuple(own[i : i + n]) for i in range(len(own) - n + 1)) if own else {}
        weights.append({g: c * sum(idf[w] for w in g) / n for g, c in grams.items()})
    ids = [i if i is not None else shared.NULL_ID for i, _ in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    total = [sum(w.values()) for w in weights]
    for a in range(len(rows)):
        for b in range(a):
            both = sum(min(x, weights[b][g]) for g, x in weights[a].items() if g in weights[b])
            either = total[a] + total[b] - both
            if (rows[a][1] or "").lower() == (rows[b][1] or "").lower() or not (words[a] or words[b]) or (both and both / either >= similarity - 1e-9):
                root[top(a)] = top(b)
    least = defaultdict(list)
    for n, i in enumerate(ids):
        least[top(n)].append(i)
    return sorted((i, min(least[top(n)])) for n, i in enumerate(ids))


def test_near_dedup(docs, rows):
    got = sorted((r.id, r.class_id) for r in minhash_dedup.near_duplicates(docs).collect())
    # texts without words are equal only if they are so as texts
    blank = [(i, t) for i, t in rows if not (t or "").split()]
    assert [x for x in got if x[0] not in {i for i, _ in blank}] == [x for x in near_brute(rows) if x[0] not in {i for i, _ in blank}]


def test_near_dedup_of_a_large_group(spark):
    r = random.Random(8)
    base = [r.choice(WORDS) for _ in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(r.randint(0, 2)):
            words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
        rows.append((i + 1, " ".join(words)))
    rows += [(1000 + i, sentence(r, 120)) for i in range(50)]
    got = sorted((x.id, x.class_id) for x in minhash_dedup.near_duplicates(frame(spark, rows)).collect())
    assert got == near_brute(rows)


def test_near_dedup_of_pairs_in_a_large_cohort(spark):
    r = random.Random(12)
    base, rows = [r.choice(WORDS) for _ in range(160)], []
    new = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    for i in range(60):
        shared_ = new(5)
        rows += [(2 * i + k + 1, " ".join(base + shared_ + new(9))) for k in (0, 1)]
    want = near_brute(rows)
    assert len({c for _, c in want}) == 60
    got = sorted((x.id, x.class_id) for x in minhash_dedup.near_duplicates(frame(spark, rows)).collect())
    assert got == want


def test_shared_weights():
    g = np.random.default_rng(7)
    value = g.random(90) + 1
    hashes = [np.sort(g.choice(90, 40, replace=False)).astype(np.uint64) for _ in range(12)]
    weights = [g.integers(1, 5, 40) * value[h.astype(int)] for h in hashes]
    for n in (0, 5):
        both, sums = minhash_dedup.shared_weights(hashes, weights, n), np.array([w.sum() for w in weights])
        for i in range(n or 12):
            for j in range(n or i + 1, 12):
                assert both[i, j - n] / (sums[i] + sums[j] - both[i, j - n]) == pytest.approx(minhash_dedup.weighted_jaccard(hashes[i], weights[i], hashes[j], weights[j]))


def test_near_dedup_keeps_columns(docs, empty):
    out = minhash_dedup.keep_one(docs)
    assert out.columns == docs.columns and minhash_dedup.near_duplicate_report(empty).count() == 0
    assert minhash_dedup.keep_one(empty).count() == 0


def test_samples_agree_as_often_as_the_similarity():
    g = np.random.default_rng(3)
    h = minhash_dedup.mix(np.arange(300, dtype=np.uint64), 1)
    w1, w2 = g.random(300) + 0.5, None
    w2 = w1 * g.choice([0.5, 1.0, 2.0], 300)
    sampler = minhash_dedup.Sampler(2000)
    share = (sampler.samples(h[:250], w1[:250]) == sampler.samples(h[50:], w2[50:])).mean()
    assert share == pytest.approx(minhash_dedup.weighted_jaccard(h[:250], w1[:250], h[50:], w2[50:]), abs=0.05)


# --- 10

def test_block_max_search_is_exact():
    g = np.random.default_rng(6)
    dense = g.random((1500, 60)) * (g.random((1500, 60)) < g.random(60) * 0.5)
    dense[:, 0] += 0.01
    dense /= np.sqrt((dense**2).sum(1, keepdims=True))
    dense[300:320] = dense[5]
    row, term = np.nonzero(dense)
    index = toxicity.BlockMaxIndex.build(row, term, dense[row, term], 1500, 60)
    assert index.blocks > 4
    for i, q in enumerate(dense[:60]):
        sims = dense @ q
        terms = np.flatnonzero(q)
        for but in (-1, i):
            order = [j for j in np.lexsort((np.arange(1500), -sims.round(12))) if sims[j] > 0 and j != but][:10]
            rows, found = index.nearest(terms, q[terms], 10, but)
            assert rows.tolist() == order and np.allclose(found, sims[order])


def toxicity_brute(rows, labels, k=toxicity.NEAREST):
    """Votes by plain dictionaries over all pairs, and a monotone fit by its minimax formula."""
    words = [Counter(re.findall(r"\w+", (t or "").lower())) for _, t in rows]
    known = {}
    for i, _, y in labels:
        if i is not None and y is not None and zlib.crc32(str(i).encode()) % 5:
            known[i] = max(y, known.get(i, 0))
    own = [n for n, (i, t) in enumerate(rows) if i in known and t]
    y = np.array([known[rows[n][0]] for n in own], float)
    n1, n0, n_docs = y.sum(), len(y) - y.sum(), len(rows)
    worth = {}
    for w in {w for n in own for w in words[n]}:
        has = np.array([w in words[n] for n in own])
        a, b, df = (has & (y == 1)).sum(), (has & (y == 0)).sum(), sum(w in c for c in words)
        table = np.array([[a, n1 - a], [b, n0 - b]])
        want = table.sum(1, keepdims=True) * table.sum(0, keepdims=True) / table.sum()
        g = 2 * sum(o * np.log(o / e) for o, e in zip(table.ravel(), want.ravel()) if o > 0)
        tied = g >= 12 and a / n1 > 3 * b / max(n0, 1)
        worth[w] = max(0.01, np.log((1 + n_docs) / (1 + df) + 1e-9)) * (0.05 + 0.95 * (min(1, g / max(0.3 * n1, 20)) if tied else 0))

    def vector(c):
        v = {w: (1 + np.log(n)) * worth[w] for w, n in c.items() if w in worth}
        size = np.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    vectors = [vector(words[n]) for n in own]
    total = Counter(known.values())
    prior = total[1] / max(1, sum(total.values()))

    def vote(v, but=None):
        sims = sorted(((sum(x * u.get(w, 0) for w, x in v.items()), y[m]) for m, u in enumerate(vectors) if m != but), reverse=True)[:k]
        sims = [(s, l) for s, l in sims if s > 0]
        return sum(s**2 * l for s, l in sims) / sum(s**2 for s, _ in sims) if sims else None

    x = np.array([vote(v, m) for m, v in enumerate(vectors)])
    weight = np.where(y == 1, total[1] / n1, total[0] / n0)
    at = np.unique(x.round(9))
    sw = np.cumsum([0, *(weight[abs(x - u) < 1e-8].sum() for u in at)])
    sy = np.cumsum([0, *((weight * y)[abs(x - u) < 1e-8].sum() for u in at)])
    mean = lambda i, j: (sy[j + 1] - sy[i]) / (sw[j + 1] - sw[i])
    fit = np.array([max(min(mean(i, j) for j in range(m, len(at))) for i in range(m + 1)) for m in range(len(at))])
    pools = [np.flatnonzero(abs(fit - f) < 1e-9) for f in np.unique(fit.round(10))]
    centres = [np.average(at[p], weights=np.diff(sw)[p]) for p in pools]
    votes = [vote(vector(c)) for c in words]
    return [prior if v is None else np.interp(v, centres, [fit[p[0]] for p in pools]) for v in votes]


def test_toxicity_scores_are_the_brute_forces(spark):
    r, bad = random.Random(19), ["awfulperson", "terrible", "nastyword"]
    rows, labels = [], []
    for i in range(150):
        words, toxic = sentence(r, r.randint(20, 60)).split(), int(r.random() < 0.35)
        for _ in range(2 * toxic):
            words[r.randrange(len(words))] = r.choice(bad) + r.choice(["", "!", "$$$"])
        rows.append((i, " ".join(words).capitalize()))
        labels.append((i, 1, toxic))
    rows += [(500, None), (501, "zzzzunknown")]
    got = {x.doc_id: x.score for x in toxicity.toxicity_report(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert [got[i] for i, _ in rows] == pytest.approx(toxicity_brute(rows, labels), abs=1e-6)


def test_clean_texts_have_neighbours_by_their_words(spark):
    r, topics, rows = random.Random(29), [[f"{a}{i}" for i in range(40)] for a in ("stone", "river", "cloud")], []
    for i in range(120):
        rows.append((i, " ".join(r.choice(topics[i % 3]) for _ in range(40)) + (" nastyword" if i % 10 == 0 else "")))
    labels = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")
    for x in toxicity.toxicity_report(frame(spark, rows), labels).where("doc_id % 10 <> 0").collect():
        assert x.evidence and all(e % 3 == x.doc_id % 3 for e in x.evidence)


def test_toxicity(spark, docs, empty, rows):
    r, bad = random.Random(9), ["awfulperson", "terrible", "nastyword"]
    own, labels = [], []
    for i in range(400):
        words, toxic = sentence(r, r.randint(20, 80)).split(), int(r.random() < 0.2)
        for _ in range(3 * toxic):
            words[r.randrange(len(words))] = r.choice(bad)
        own.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    own += [(1000, None), (1001, ""), own[0]]
    frame_, table = frame(spark, own), spark.createDataFrame([*labels, (3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_report(frame_, table).toPandas()
    assert len(got) == len(own) and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out))
    truth_ = {i: t for i, _, t in labels}
    held = got[got.held_out & got.doc_id.isin(truth_)]
    assert np.mean([p == truth_[i] for i, p in zip(held.doc_id, held.predicted)]) > 0.95
    out = toxicity.without_toxic(frame_, table)
    assert out.columns == frame_.columns and out.where("doc_id IN (1000, 1001)").count() == 2
    assert toxicity.toxicity_report(empty, table).count() == 0
    assert toxicity.toxicity_report(docs, table.where("false")).where("score <> 0").count() == 0


# --- the pipeline and the queries

def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts, now = [docs.count()], docs
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, shared.table(stage(spark, now, SF), f"test-{name}")
        assert now.columns[: len(docs.columns)] == docs.columns
        counts.append(now.count())
        if name == "toxicity":
            labels = spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0")
            lost = before.join(now, "doc_id", "left_anti").join(labels, "doc_id").count()
            assert lost <= 2
        elif name == "line_dedup":
            want = {i: s for i, _, _, s in line_brute([(r.doc_id, r.text) for r in before.collect()])}
            assert {r.doc_id: sha(r.text) for r in now.collect()} == want
        elif name == "near_dedup":
            classes = near_brute([(r.doc_id, r.text) for r in before.collect()])
            assert sorted(r.doc_id for r in now.collect()) == sorted(i for i, c in classes if i == c)
        elif name == "mixing":
            assert {r.doc_id for r in before.collect()} == {r.doc_id for r in now.collect()}
        else:
            assert now.where("NOT round_trip").count() == 0
    assert counts[0] > counts[1] and counts[2] == counts[1] and counts[3] < counts[2] and counts[4] >= counts[3] and counts[5] == counts[4]
    assert corpus_pipeline.run(spark, SF).count() == counts[-1]


def test_ten_queries():
    assert [int(k[2:].split("_")[0]) for k in queries.queries()] == list(range(1, 11))


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {x.v: x.component for x in shared.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    root = {}
    for a, b in edges:
        root.setdefault(a, {a})
        root.setdefault(b, {b})
        if root[a] is not root[b]:
            root[a] |= root[b]
            for v in root[b]:
                root[v] = root[a]
    assert got == {v: min(s) for v, s in root.items() if len(s) > 1}

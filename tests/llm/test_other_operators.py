"""Embeddings, URL filters, HTML extraction, chat formatting and sharding."""

import datetime as dt
import json
import math
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import chat, embeddings, extract, sharding, urls
from millrace.llm.common import bit_filter
from millrace.llm.components import components

T = dt.datetime


def test_components_and_bit_filter(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(-5, 299), (7, 7), (None, 3)] + [
        (1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a is not None and a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: root(x) for x in list(parent)}
    values = [0, 1, -1, 8191, 65535, 1 << 40]
    bits = bit_filter(spark.createDataFrame([(v,) for v in [*values, None]], "v long"), "v", 1 << 16)
    on = {i for i in range(1 << 16) if bits[i >> 3] >> (i & 7) & 1}
    assert on == {v % (1 << 16) for v in values}


def brute_links(rows, limit):
    vectors = [None if v is None or None in v or not np.isfinite(v).all() or not np.any(v) else
               np.array(v) / np.linalg.norm(v) for _, v in rows]
    link = [[j for j, y in enumerate(vectors) if j != i and x is not None and y is not None and len(x) == len(y)
             and x @ y >= limit] for i, x in enumerate(vectors)]
    return link


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    rows = []
    for size, spread in ((1, 0), (40, 0.01), (25, 0.035), (12, 0.05), (200, 0.02)):
        centre = rng.standard_normal(64)
        rows += [(len(rows) + i, (centre / np.linalg.norm(centre) + spread * rng.standard_normal(64)).tolist()) for i in range(size)]
    rows += [(len(rows) + i, rng.standard_normal(64).tolist()) for i in range(600)]
    rows += [(2000, rows[0][1]), (2001, rows[0][1]), (2001, rows[0][1]), (None, rows[1][1])]
    rows += [(3000, None), (3001, [0.0] * 64), (3002, [float("nan")] * 64), (3003, [1.0, None]), (3004, []), (3005, [1.0, 0.0]),
             (3006, [2.0, 0.001])]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, node string, kept int")
    got = embeddings.near_duplicates(frame, limit=0.9).collect()
    link = brute_links(rows, 0.9)
    assert len(got) == len(rows)
    want = Counter((i, len(x)) for (i, _), x in zip(rows, link))
    found, total = sum(r.n_links for r in got), sum(map(len, link))
    assert 0.97 * total <= found <= total
    alone = {i for (i, _), x in zip(rows, link) if not x}
    for r in got:
        if r.vec_id in alone and want[r.vec_id, 0]:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
    by_id = {r.vec_id: r for r in got}
    assert {by_id[2000].component_id, by_id[2001].component_id} == {0} and by_id[0].n_links == 3
    assert by_id[3005].component_id == by_id[3006].component_id == 3005
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


def test_recall_holds_at_any_size_and_dimension(spark):
    for count, dim in ((500, 64), (1_000_000, 64), (1_000_000, 16), (1_000_000, 3)):
        t, size = embeddings.plan(count, 0.9, dim)
        rng = np.random.default_rng([3, dim])
        one = rng.standard_normal((1000, dim))
        one /= np.linalg.norm(one, axis=1, keepdims=True)
        way = rng.standard_normal((1000, dim))
        way -= (way * one).sum(axis=1, keepdims=True) * one
        way /= np.linalg.norm(way, axis=1, keepdims=True)
        codes = embeddings._codes(dim, size, embeddings.SEED)
        first, second = (embeddings.decode(v, t, codes) for v in (one, 0.9 * one + np.sqrt(1 - 0.81) * way))
        assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(first, second)]) >= 0.97
        # a cap holds as many vectors as planned
        if count == 1_000_000 and dim == 64:
            assert 200 < count * np.mean([len(f) for f in first]) / size ** 2 < 320
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(2).tolist()) for i in range(600)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cap=16).collect()
    total = sum(map(len, brute_links(rows, 0.9)))
    assert 0.97 * total <= sum(r.n_links for r in got) <= total


def test_caps_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(9)
    centre = rng.standard_normal(32)
    rows = [(i, (centre + 0.05 * rng.standard_normal(32)).tolist()) for i in range(90)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = embeddings.near_duplicates(frame).collect()
    assert [r.n_links for r in got] == [89] * 90 and {r.component_id for r in got} == {0}


def test_pairs_belong_to_their_smallest_filter(monkeypatch):
    monkeypatch.setattr(embeddings, "COLUMNS", 3)
    rng = random.Random(6)
    filters = [np.array(sorted(rng.sample(range(30), rng.randrange(8))) + [40], dtype=np.int64) for _ in range(40)]
    near = np.array([[i != j and (i + j) % 3 > 0 for j in range(40)] for i in range(40)])
    for this in (0, 7, 40):
        got = near.copy()
        embeddings._drop_owned(got, filters, this)
        want = [[near[i, j] and not any(f < this for f in set(a.tolist()) & set(b.tolist())) for j, b in enumerate(filters)]
                for i, a in enumerate(filters)]
        assert (got == np.array(want)).all()
        group = embeddings._groups(got)
        assert all(group[i] == group[j] for i, j in zip(*np.nonzero(got))) and (group <= np.arange(40)).all()


def test_filters_are_the_same_in_any_batch():
    rng = np.random.default_rng(12)
    unit = embeddings._scaled(rng.standard_normal((300, 64)))
    t, size = embeddings.plan(50_000, 0.9, 64)
    codes = embeddings._codes(64, size, 1)
    whole = embeddings.decode(unit, t, codes)
    for i in range(0, 300, 7):
        assert embeddings.decode(unit[i:i + 1], t, codes)[0].tolist() == whole[i].tolist()


def test_embeddings_of_floats(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 32)
    rng = np.random.default_rng(10)
    centre = rng.standard_normal(24)
    rows = [(i, [float(x) for x in (centre + 0.3 * rng.standard_normal(24)).astype(np.float32)]) for i in range(80)]
    rows += [(90, rows[3][1]), (91, [0.0] * 23 + [-0.0]), (92, None), (93, [float("inf")] * 24)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    link = brute_links(rows, 0.9)
    total = sum(map(len, link))
    assert 0.97 * total <= sum(r.n_links for r in got) <= total
    want = {i: len(x) for (i, _), x in zip(rows, link)}
    assert all(r.n_links <= want[r.vec_id] for r in got) and len(got) == 84


def test_urls_against_plain(spark):
    entries = [("bad.example.com", "spam", T(2024, 2, 1), True), ("bad.example.com", "spam", T(2024, 3, 1), False),
               ("bad.example.com", "spam", T(2024, 3, 1), True), ("bad.example.com", "spam", T(2024, 4, 1), False),
               ("example.com", "adult", T(2024, 1, 15), True), ("ok.org/a", "spam", T(2024, 2, 10), True),
               ("ok.org/a", "spam", T(2024, 2, 20), None), (None, "spam", T(2024, 1, 1), True), ("x.org", None, T(2024, 1, 1), True)]
    captures = []
    for day in range(0, 130, 3):
        at = T(2024, 1, 1) + dt.timedelta(days=day)
        captures += [(day, u, at) for u in ("http://u@BAD.example.com:80/x?q=1", "https://ok.org/a/b#f", "http://ok.org/ab",
                                            "http://com/", None, "no url", "http://sub.bad.example.com")]
    captures += [(1, "http://bad.example.com/", T(2024, 2, 1)), (1, "http://bad.example.com/", T(2024, 2, 1)), (2, "http://ok.org/a", None)]

    def plain(url, at):
        if not url or "//" not in url or at is None:
            return []
        rest = url.split("//")[1].split("#")[0].split("?")[0]
        host = rest.split("/")[0].split("@")[-1].split(":")[0].lower()
        parts, path = host.split("."), [s for s in rest.split("/")[1:] if s]
        names = {".".join(parts[i:]) for i in range(max(1, len(parts) - 1))} | {host + "/" + "/".join(path[:i + 1]) for i in range(len(path))}
        out = set()
        for key, category in {(k, c) for k, c, _, _ in entries if k and c}:
            log = sorted((t, bool(x)) for k, c, t, x in entries if (k, c) == (key, category) and t <= at)
            if key in names and log and log[-1][1]:
                out.add(category)
        return sorted(out)

    frame = spark.createDataFrame([(*c, "x") for c in captures], "id long, url string, at timestamp, key string")
    log = spark.createDataFrame(entries, "key string, category string, at timestamp, listed boolean")
    got = urls.judge(frame, log, "id", "url", "at").collect()
    assert Counter((r.capture_id, r.fetched_at, tuple(r.categories), r.blocked) for r in got) == Counter(
        (i, at, tuple(plain(u, at)), bool(plain(u, at))) for i, u, at in captures)
    assert urls.judge(frame.limit(0), log, "id", "url", "at").count() == 0
    assert urls.judge(frame, log.limit(0), "id", "url", "at").where("blocked").count() == 0


def test_listed_prefixes_of_any_depth(spark):
    deep = "ok.org/" + "/".join(f"s{i}" for i in range(40))
    log = spark.createDataFrame([("ok.org/a/b/c/d/e", "spam", T(2024, 1, 1), True), (deep, "adult", T(2024, 1, 1), True)],
                                "key string, category string, at timestamp, listed boolean")
    asked = ["http://ok.org/a/b/c/d/e/f?q=1", "http://ok.org/a/b/c/d/e", "http://ok.org/a/b/c/d", f"http://{deep}/x", "http://ok.org/"]
    frame = spark.createDataFrame([(i, u, T(2024, 2, 1 + i)) for i, u in enumerate(asked)], "id long, url string, at timestamp")
    got = {r.capture_id: r.categories for r in urls.judge(frame, log, "id", "url", "at").collect()}
    assert got == {0: ["spam"], 1: ["spam"], 2: [], 3: ["adult"], 4: []}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>";</script></head>
<body><header class="top">Site name</header><nav><ul><li><a href="/">Home</a><li>News</ul></nav><div class="cookie-notice">We use
cookies</div><!-- <p>hidden</p> --><article><h1>Title %d &amp; more</h1><p><b>First&nbsp;line %d<br>goes   on.<p>Second <i>part</i>
&lt;b&gt;.</p><aside>Aside</aside><form><input value="x">Search <button>Go</button></form><ul><li>one<li>two</ul>
<div id="comments"><p>Reader says no</p></div></article><div class="sidebar">More</div><footer>&copy; x</footer></body>"""


def test_extraction(spark):
    want = "Title {0} & more\n\nFirst line {0} goes on.\n\nSecond part <b>.\n\none\n\ntwo"
    rows = [(i, f"https://h.example/{i}", PAGE % (i, i)) for i in range(5)]
    rows += [(90, "https://h.example/x", None), (91, None, ""), (92, "http://solo.example/", "<p>Only text"),
             (93, "http://h.example/odd", "<body><div>Other <b>page</b></div><p>5 < 6 & 7 &gt; 2"), (None, "http://h.example/0", PAGE % (7, 7)),
             (94, "http://div.example/", "<div class=menu>m</div><div id=main><div>Body text</div><span class='share'>s</span></div><div>x</div>"),
             (95, "http://long.example/", "<article><p>" + "long " * 100_000 + "</p></article>")]
    frame = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, container string")
    got = {r.page_id: r for r in extract.extract(frame).collect()}
    for i in range(5):
        assert got[i].text == want.format(i) and got[i].n_chars == len(got[i].text)
    assert got[None].text == want.format(7)
    assert got[90].text == got[91].text == "" and got[92].text == "Only text"
    assert got[93].text == "Other page\n\n5 < 6 & 7 > 2" and got[94].text == "Body text"
    assert got[95].n_chars == 499_999
    assert extract.extract(frame.limit(0)).count() == 0


def test_text_behind_inline_boilerplate_stays():
    for page, want in [
            ("<p>Before <span class=ad>x <span>y</span> z</span> after.</p><p>Next", "Before\n\nafter.\n\nNext"),
            ("<p><a class=share>x</a>Start <b>of</b> it.</p>", "Start of it."),
            ("<article><a class=share>s</a><h1>Head</h1><p>One</p></article>", "Head\n\nOne"),
            ("<article><p>One</p><span class=social>s</span><p>Two</p></article>", "One\n\nTwo"),
            ("<article><a class=share><div>s</a>One</div><p>Two</p></article>", "One\n\nTwo"),
            ("<ul><li>one <span class=ad>x<li>two</ul>", "one\n\ntwo"),
            ("<p>a <span class=ad>x<b>y</span></b> b</p>", "a\n\nb")]:
        assert extract.main_text(page, None) == want


def test_class_words_of_wrappers_do_not_drop_the_text(spark):
    body = "<p>Text %d of the page.</p><div class=share-bar>Share %d</div><p class=search-note>%s</p>"
    shapes = {"a": '<body><div class="layout has-sidebar"><div><h1>Head</h1>%s</div></div>', "b": '<main class="no-sidebar">%s</main>',
              "c": '<article class="post category-search">%s</article>', "d": '<div class="has-sidebar"><article>%s</article></div>'}
    rows = [(i, f"http://{h}.example/", shape % (body % (i, i, "Rare") if i == 0 else body[:body.index("<p class")] % (i, i)))
            for h, shape in shapes.items() for i in range(4)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in extract.extract(frame).collect():
        head = ["Head"] if "//a." in r.url else []
        assert r.text.split("\n\n") == [*head, f"Text {r.page_id} of the page."] + ["Rare"] * (r.page_id == 0)


@pytest.mark.parametrize("page", [
    "<div>x" * 100_000, "<div class=ad-x>x" * 100_000, "<p><div>" * 50_000 + "x", "</p>" * 200_000 + "x",
    "<div>" * 100_000 + "</em></p>" * 100_000 + "x", "<li><b class=ad>" * 50_000, "<b>" * 100_000 + "</i>" * 100_000 + "x",
    "<div>" + "<b class=ad>" * 50_000 + "<li>x</li>" * 50_000, "<i class=share-x><div>" * 30_000 + "x" + "</i>" * 30_000])
def test_deep_pages_cost_their_length(page):
    began = time.process_time()
    extract.main_text(page, "/div/div")
    for _ in extract._tokens([pa.RecordBatch.from_pydict({"page_id": [1], "host": ["h"], "html": [page]})]):
        pass
    assert time.process_time() - began < 20


def test_marks_that_name_parts():
    for page, want in [
            ('<article><p>One</p><div class="ad-slot-1">x</div><section id="comments-list">y</section></article>', "One"),
            ('<article><p class="search">How to search</p><h1 class="header">H</h1></article>', "How to search\n\nH"),
            ('<p class="notice">x</p><p>One</p>', "One"), ('<p title="x>Hello <b>you</b>', "Hello you")]:
        assert extract.main_text(page, None) == want


def test_repeated_runs_and_numbered_slots_are_template(spark):
    """Without a telling class; a host of copies and a host of few pages keep their texts."""
    note = "<p>We value what you read here.</p>"
    rows = [(i, "http://a.example/", f"<article><h1>Head {i}</h1>{note}<p>{'text %d ' % i * 20}</p><div class=x-promo-{i}>buy {i}</div>"
             f"<p>{'more %d ' % i * 20}</p></article>") for i in range(10)]
    rows += [(20 + i, "http://copies.example/", f"<article><h1>Same head</h1><p>{'same ' * 30}</p></article>") for i in range(8)]
    rows += [(30 + i, "http://near.example/", f"<article><p>{'same ' * 30}</p><p>end {i}</p></article>") for i in range(8)]
    rows += [(40 + i, "http://few.example/", f"<article>{note}<p>text {i} of this page here</p></article>") for i in range(3)]
    rows += [(50, "http://a.example/", f"<article><p>other page</p>{note}</article>")]
    got = {r.page_id: r.text.split("\n\n") for r in extract.extract(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(10):
        assert got[i] == [f"Head {i}", ("text %d " % i * 20).strip(), ("more %d " % i * 20).strip()]
    for i in range(8):
        assert got[20 + i] == ["Same head", ("same " * 30).strip()] and got[30 + i] == [("same " * 30).strip(), f"end {i}"]
    for i in range(3):
        assert got[40 + i] == ["We value what you read here.", f"text {i} of this page here"]


def test_template_finds_the_container(spark):
    """Pages without an article: the container is what holds the hosts' text."""
    pages = [(i, "h", f"<body><div class=x1>top {i % 2}</div><div class=x2><p>{'text of the page ' * 30}{i}</p><p>end {i}</p></div>")
             for i in range(6)]
    frame = spark.createDataFrame(pages, "page_id long, host string, html string")
    assert [r.container for r in extract.templates(frame).collect()] == ["/body/div.x2"]


def test_chat(spark):
    schemas = {"sum": {"a": ("integer", True), "b": ("number", False)}, "say": {"t": ("string", True)}}
    rows = [  # conv, turn, role, text, id, name, arguments, after
        (1, 0, "user", 'say "hé"\n', None, None, None, None),
        (1, 1, "assistant", None, "c2", "sum", '{"b": 1.5, "a": 2}', "c1"),
        (1, 2, "assistant", "x", "c1", "say", '{"t": 5}', None),
        (1, 3, "tool", "r2", "c2", None, None, None),
        (1, 4, "tool", "r1", "c1", None, None, None),
        (1, 5, "tool", "r1 again", "c1", None, None, None),
        (1, 6, "tool", "lost", "zz", None, None, None),
        (1, 7, "assistant", "x", "k1", "sum", "{bad", "k2"), (1, 8, "assistant", "x", "k2", "fly", "{}", "k1"),
        (2, 0, "assistant", "x", "c1", "sum", '{"a": "1", "z": null}', "c9"), (2, 0, "assistant", "x", "c1", "sum", '{"a": "1", "z": null}', "c9"),
        (None, None, None, None, None, None, None, None), (2, 1, "tool", None, None, None, None, None)]
    ddl = "conv_id long, turn long, role string, text string, id string, name string, arguments string, after string, place string"
    frame = spark.createDataFrame([(*r, "clash") for r in rows], ddl)
    got = chat.format_chat(frame, schemas).orderBy("conv_id", "place").collect()
    one = [r for r in got if r.conv_id == 1]
    assert [r.place for r in one] == list(range(9))
    assert [(r.turn, r.status) for r in one] == [
        (0, "plain"), (2, "answered"), (4, "linked"), (5, "again"), (1, "answered"), (3, "linked"), (6, "orphan"), (7, "cycle"), (8, "cycle")]
    faults = {(r.conv_id, r.turn): list(r.problems) for r in got if r.problems is not None}
    assert faults == {(1, 1): [], (1, 2): ["type:t"], (1, 7): ["json"], (1, 8): ["tool"], (2, 0): ["extra:z", "type:a"]}
    for r in got:
        assert json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.json
    assert json.loads(one[4].json) == {"content": "", "role": "assistant", "tool_call": {"id": "c2", "name": "sum", "arguments": {"a": 2, "b": 1.5}}}
    assert len(got) == len(rows) and chat.format_chat(frame.limit(0), schemas).count() == 0


def _plain_faults(value, kind, path):
    if isinstance(kind, dict):
        if not isinstance(value, dict):
            return {f"type:{path[:-1]}"}
        out = {f"extra:{path}{k}" for k in value if k not in kind}
        for field, (inner, needed) in kind.items():
            if field not in value:
                out |= {f"missing:{path}{field}"} if needed else set()
            else:
                out |= _plain_faults(value[field], inner, f"{path}{field}" + "." * isinstance(inner, dict))
        return out
    if isinstance(kind, list):
        inner = f"{path}[]" + "." * isinstance(kind[0], dict)
        return set().union(*[_plain_faults(v, kind[0], inner) for v in value]) if isinstance(value, list) else {f"type:{path}"}
    fits = {"string": isinstance(value, str), "boolean": isinstance(value, bool),
            "integer": isinstance(value, int) and not isinstance(value, bool),
            "number": isinstance(value, (int, float)) and not isinstance(value, bool)}
    return set() if fits[kind] else {f"type:{path}"}


def test_nested_schemas_against_plain(spark):
    schema = {"to": ({"name": ("string", True), "at": ({"x": ("number", True), "y": ("integer", False)}, False)}, True),
              "tags": (["string"], False), "rows": ([{"id": ("integer", True), "ok": ("boolean", False)}], False),
              "grid": ([["integer"]], False)}
    rng = random.Random(3)

    def some(kind, depth=0):
        if rng.random() < 0.12:
            return rng.choice([5, "s", True, [], {}, [1, "a"], {"name": "n"}, 2.5])
        if isinstance(kind, dict):
            out = {f: some(k, depth + 1) for f, (k, _) in kind.items() if rng.random() < 0.85}
            return out | ({"odd": 1} if rng.random() < 0.1 else {})
        if isinstance(kind, list):
            return [some(kind[0], depth + 1) for _ in range(rng.randrange(4))]
        return {"string": 'a "b"\n', "integer": -7, "number": 1.25, "boolean": False}[kind]
    values = [v for v in (some(schema) for _ in range(400)) if isinstance(v, dict)] + [{}]
    frame = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(-1, "[1]"), (-2, None), (-3, "")],
                                  "i long, a string")
    got = {r.i: r.p for r in frame.select("i", chat.problems(F.lit("f"), F.col("a"), {"f": schema}).alias("p")).collect()}
    assert got[-1] == got[-2] == got[-3] == ["json"]
    for i, v in enumerate(values):
        assert got[i] == sorted(_plain_faults(v, schema, "")), v
    assert sum(not got[i] for i in range(len(values))) > 20


def test_malformed_arguments_stay():
    assert json.loads(chat.canonical('{"a": 1, "é')) == '{"a": 1, "é' and json.loads(chat.canonical("")) == ""
    assert chat.canonical(None) is None and chat.canonical('{"b": 1, "a": null}') == '{"a":null,"b":1}'


def test_arguments_that_json_or_texts_cannot_hold(spark):
    """Half surrogate pairs and numbers that are not finite."""
    for text in ('{"t":"\\ud800"}', '{"\\udfff":["a\\ud83d"]}'):
        out = chat.canonical(text)
        assert out.encode() and json.loads(out) == json.loads(text)
    assert chat.canonical('{"t":"\\ud83d\\ude42"}') == '{"t":"🙂"}'
    for text in ('{"t":1e999}', '{"t":NaN}', "[-Infinity]"):
        assert json.loads(chat.canonical(text)) == text
    rows = [(1, i, "assistant", "x", f"c{i}", "f", a, None) for i, a in enumerate(
        ['{"t":"\\ud800"}', '{"t":1e999}', '{"t":NaN}', '{"t":1e5}'])]
    ddl = "conv_id long, turn long, role string, text string, id string, name string, arguments string, after string"
    got = chat.format_chat(spark.createDataFrame(rows, ddl), {"f": {"t": ("number", True)}}).orderBy("turn").collect()
    assert [bool(r.problems) for r in got] == [True, True, True, False]

    def refuse(constant):
        raise AssertionError(constant)
    assert all(json.loads(r.json, parse_constant=refuse) for r in got)


def test_long_chains_of_calls(spark):
    rows = [(c, i, f"c{i}", f"c{i - 1}" if i else None) for c in range(3) for i in range(70)]
    got = chat.depths(spark.createDataFrame(rows, "conv_id long, turn long, id string, after string")).collect()
    assert all(r.depth == r.latest == int(r.id[1:]) for r in got) and len(got) == 210


@pytest.mark.parametrize("good,bad,n", [(5, 7, 6), (3, 40, 30), (60, 50, 20)])
def test_draws_follow_the_exact_law(good, bad, n):
    draw = np.random.default_rng(7)
    got = np.bincount([sharding._hypergeometric(draw, good, bad, n) for _ in range(20_000)], minlength=n + 1)
    law = np.array([math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) for k in range(n + 1)])
    assert (got[law == 0] == 0).all()
    likely = law * 20_000 > 5
    assert (((got - law * 20_000) ** 2)[likely] / (law * 20_000)[likely]).sum() < 60


def test_draws_beyond_ten_to_the_nine():
    """A few good ones among very many follow the binomial law, which a normal law does
    not; large draws have the exact mean and variance."""
    draw, good, total = np.random.default_rng(3), 3 * 10**9, 10**12
    few = np.array([sharding._hypergeometric(draw, good, total - good, 400) for _ in range(20_000)])
    law = np.array([math.comb(400, k) * 0.003**k * 0.997 ** (400 - k) for k in range(9)])
    met = np.bincount(few, minlength=9)[:9] / len(few)
    assert np.abs(met - law).max() < 0.012
    n = 10**10
    many = np.array([sharding._hypergeometric(draw, good, total - good, n) for _ in range(200)], dtype=float)
    mean, var = n * 0.003, n * 0.003 * 0.997 * (total - n) / (total - 1)
    assert abs(many.mean() - mean) < 5 * math.sqrt(var / 200) and 0.6 < many.var() / var < 1.5


def test_matrix_is_exact():
    m = sharding.communication_matrix([5, 0, 17, 40], [21, 21, 20], seed=3)
    assert m.sum(axis=1).tolist() == [5, 0, 17, 40] and m.sum(axis=0).tolist() == [21, 21, 20] and (m >= 0).all()
    mean = np.mean([sharding.communication_matrix([30, 30], [20, 40], seed=s)[0, 0] for s in range(400)])
    assert abs(mean - 10) < 0.5
    big = sharding.communication_matrix([2_000_000_000, 2_000_000_000], [1_000_000_000, 3_000_000_000])
    assert big.sum(axis=0).tolist() == [1_000_000_000, 3_000_000_000]


def test_sharding(spark, scratch):
    rows = [(i, f"t{i}") for i in range(997)] + [(5, "same")] * 40 + [(None, None)] * 3
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, shard string").repartition(7)
    placed = sharding.shard(frame, 8, ["doc_id", "text"], partitions=5)
    got = placed.collect()
    sizes = Counter(r.shard for r in got)
    assert sum(sizes.values()) == 1040 and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    # the order within a shard has nothing of the order of the ids
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.slot) if r.shard == 0 and r.doc_id is not None]
    assert 0.35 < np.mean([a < b for a, b in zip(ids, ids[1:])]) < 0.65
    assert sharding.shard(frame.limit(0), 8, ["doc_id"]).count() == 0
    path = scratch("shards")
    sharding.write_shards(placed, path)
    assert spark.read.parquet(path).where("shard = 3").count() == sizes[3]

"""Benchmark decontamination, phrase collocations and the conversation prefix trie."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import decontaminate, phrases, prefix_trie

DOCS = "doc_id long, text string, lang string, _words string, window string, n_hit string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, langs[i % len(langs)] if langs else "en", "w", "x", "y")
                                  for i, t in enumerate(texts)], DOCS)


# --- benchmark decontamination

def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def plain_contamination(texts, items):
    found = []
    for i, t in texts:
        w, hit, names = plain_words(t), set(), set()
        for name, item in items:
            x = plain_words(item)
            k = min(10, len(x))
            for at in range(len(x) - k + 1 if k else 0):
                for j in range(len(w) - k + 1):
                    if w[j:j + k] == x[at:at + k]:
                        hit.update(range(j, j + k))
                        names.add(name)
        names.discard(None)
        found.append((i, len(w), len(hit), sorted(map(str, names)), bool(hit)))
    return sorted(found, key=repr)


def contamination_rows(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.items, r.contaminated) for r in df.collect()), key=repr)


def contamination_case():
    rng = random.Random(5)
    word = lambda: rng.choice("a b c d e É é x1 9 日本".split())
    line = lambda n: [word() for _ in range(n)]
    items = [(i, " ".join(line(rng.choice([4, 10, 11, 25])))) for i in range(12)]
    items += [(3, "Second text of ITEM three, it has more than ten words in all!"), (20, None), (21, ""), (22, "?!"),
              (23, "Solo"), (24, "two words"), (None, "this item has no id but it does have ten words"), (25, items[0][1]),
              (100, items[1][1])]
    texts = []
    for n in (0, 3, 9, 10, 40, 300):
        for _ in range(6):
            w = line(n)
            if rng.random() < 0.7:
                at = rng.randrange(n + 1)
                w[at:at] = (rng.choice(items)[1] or "").split() * rng.choice([1, 2])
            texts.append(rng.choice([" ", ", ", "\n"]).join(w))
    texts += [None, "", "solo", "SOLO two WORDS; two", items[0][1].upper(), "x" * 200_000,
              "This item has no ID, but it does have ten words.", "éÉ solo"]
    rows = [*enumerate(texts), (None, "two words"), (0, "two words"), (4, texts[4]), (4, texts[4]), (None, None)]
    return rows, items


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST, 0])
def test_contamination_against_plain(spark, limit):
    rows, items = contamination_case()
    docs = spark.createDataFrame([(i, t, "en", "w", "x", "y") for i, t in rows], DOCS).repartition(5)
    bench = spark.createDataFrame([(i, t, "k") for i, t in items], "item_id long, text string, doc_id string")
    got = decontaminate.contamination(docs, bench, broadcast=limit)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items", "contaminated"]
    assert contamination_rows(got) == plain_contamination(rows, items)


def test_contamination_of_and_by_nothing(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    clean = decontaminate.contamination(docs_of(spark, ["a b c", None]), empty)
    assert contamination_rows(clean) == [(0, 3, 0, [], False), (1, 0, 0, [], False)]
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.contamination(docs_of(spark, []), bench).count() == 0


def test_contamination_stays_in_the_engine(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = decontaminate.contamination(docs, bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_prefixes_are_the_rarest_shingles(spark):
    """A window's prefix is its least frequent shingle, so common ones bring no candidates."""
    common, rare = "the same words again and", "one seldom seen phrase here"
    docs = docs_of(spark, [f"{common} again"] * 50 + [f"{common} {rare} ends"])
    found = decontaminate.windows(spark.createDataFrame([(1, f"{common} {rare}")], "item_id long, text string"))
    anchors, widths, small = decontaminate._anchors(docs, "doc_id", "text", found, 3, 100)
    assert widths == [3] and small and [r.at for r in anchors.collect()] in ([3], [4], [5], [6], [7])


# --- phrase collocations

def plain_collocations(rows, least, top):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cand.items():
            score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i:i + len(p)] == p for i in range(len(q)))
                       for q, b in cand.items()):
                kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def collocation_rows(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def phrase_texts(seed, n):
    rng = random.Random(seed)
    vocabulary = ["THE", "the", "of", "x", "y", "élan", "日本", "in", "New", "york", " ", "a b"] + [f"w{i}" for i in range(12)]
    weights = [30, 30, 20] + [3] * (len(vocabulary) - 3)
    gaps = [" "] * 14 + ["  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "; "]
    out = []
    for _ in range(n):
        w = rng.choices(vocabulary, weights, k=rng.randrange(0, 60))
        out.append("".join(x + rng.choice(gaps) for x in w))
    return out


# budget 1 << 20: all in one group; 64: words and pairs of the trunk are extended
@pytest.mark.parametrize("budget,block,top", [(1 << 20, 1 << 20, 2000), (64, 300, 2000), (500, 50, 7)])
def test_collocations_against_plain(spark, budget, block, top):
    texts = phrase_texts(1, 250) + [None, "", " \t", "...", "the of " * 3000, "x" * 5000, "the of x."]
    langs = ["en", "en", "en", "de", None]
    rows = [(langs[i % 5], t) for i, t in enumerate(texts)]
    df = docs_of(spark, texts, langs).repartition(4)
    got = phrases.collocations(df, least=10, top=top, budget=budget, block=block)
    assert collocation_rows(got) == plain_collocations(rows, 10, top)
    assert {r[0] for r in collocation_rows(got)} == {"en", "de", "und"}


def test_collocations_of_nothing(spark):
    assert phrases.collocations(docs_of(spark, [])).count() == 0
    assert phrases.collocations(docs_of(spark, [None, "", "one two"])).count() == 0


def test_counts_pass_64_bits(spark):
    rows = spark.createDataFrame([(4 * 10**12, 5 * 10**12, 6 * 10**12)], "a long, l long, r long")
    got = rows.select(phrases._score(F.col("a"), F.col("l"), F.col("r"))).first()[0]
    assert got == 1000000 * (4 * 10**12) ** 2 // (5 * 10**12 * 6 * 10**12)


def test_long_texts_are_cut_between_pieces():
    text = b"a b c. " * 40 + b"x" * 100 + b" " + b"y" * 100 + b"; z"
    parts = phrases._cuts(text, 32)
    assert b"".join(parts) == text and all(p[-1:] in b".;" for p in parts[:-1])
    whole, cut = phrases.Words(text, 3), [phrases.Words(p, 3) for p in parts]
    assert len(whole.piece) == sum(len(c.piece) for c in cut)


def test_collapse_of_wide_numbers():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 4, 500) for _ in range(3)]
    weights = rng.integers(1, 9, 500)
    narrow, n = phrases.collapse(columns, 5, weights)
    wide, m = phrases.collapse(columns, 1 << 30, weights)
    assert all((a == b).all() for a, b in zip(narrow, wide)) and (n == m).all() and n.sum() == weights.sum()


# --- conversation prefix trie

def plain_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    children, out = Counter(p[:-1] for p in members if p), []
    for path, m in members.items():
        below = [p for p in members if p[:len(path)] == path]
        words = lambda p: len(re.findall("[^\x20\t-\r]+", p[-1][1])) if p else 0
        ends = ",".join(str(c) for c in sorted(m) if built[c] == path)
        out.append((min(m), len(path), min(members[path[:-1]]) if path else None, len(m), children[path],
                    sum(not children[p] for p in below), sum((len(members[p]) - 1) * words(p) for p in below),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie_rows(spark, rows):
    df = spark.createDataFrame([(*r, "k", "d", "p") for r in rows],
                               "conv_id long, turn long, role string, text string, key string, depth string, node string")
    found = prefix_trie.trie(prefix_trie.shared_openings(prefix_trie.sequences(df.repartition(5))))
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {t for _, t in found.dtypes} == {"bigint", "string"}
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_trie_against_plain(spark):
    rng = random.Random(2)
    rows = []
    for c in [*range(60), 115, 999, 5_000_000_000]:
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "hi there", "a b c", ""])))
    # the same conversation many times over, null turns, roles and texts, one without an id
    rows += [(c, t, "user", f"copy {t}") for c in range(10_000, 14_300) for t in range(5)]
    rows += [(70, None, "user", "first"), (70, 0, None, None), (70, 1, "user", ""), (None, 0, "user", "x"), (81, 0, "user", "only")]
    assert trie_rows(spark, rows) == plain_trie(rows)


def test_trie_edges(spark):
    assert trie_rows(spark, []) == []
    one = [(7, t, "user", "x " * 3) for t in range(400)]
    assert trie_rows(spark, one) == plain_trie(one)
    # conversations that the missing opening leaves without turns: members of the root alone
    short = [(c, 0, "user", "q") for c in range(21, 40)]
    assert trie_rows(spark, short) == plain_trie(short)
    assert trie_rows(spark, short)[0][0] == 21


def test_end_lists_longer_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "END_BLOCK", 7)
    rows = [(c, 0, "user", "same") for c in range(0, 3000, 3)]
    assert trie_rows(spark, rows) == plain_trie(rows)

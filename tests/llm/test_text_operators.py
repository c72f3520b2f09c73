"""Packing, toxicity, SentencePiece, Jaccard join, quality rules and the pipeline."""

import math
import random
import re
import struct
import time
import zlib
from array import array
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import jaccard, packing, quality, sentencepieces, toxicity
from millrace.llm.packing import best_fit
from millrace.llm.wordids import LONGEST, Memory, WordIds

VOCABULARY = str(public_tokenizers.path("word_bpe_49k.json"))
PIECES = str(public_tokenizers.path("piece_bpe_32k.model"))
ODD = ["", "It's  l'été 'SABER ''s «x» <|endoftext|>y", "a\tb\xa0c İstanbul ΣΑΣ ŉ ½² x́ 日本語 🙂", "a\x00b \x7f\x85z", "x" * 5000,
       "\n\n", "  lead and trail  ", "▁ ▁▁a"]
DDL = "doc_id long, text string, lang string, kept string, shard string, component_id string"


def table(spark, texts, ddl=DDL):
    return spark.createDataFrame([(i, t, "en", "k", "s", "c") for i, t in texts], ddl)


def words(text, low=False):
    return re.findall(rb"[^\x20\t-\r]+", text.lower() if low else text)


def shingles(text, width):
    w = words((text or "").encode(), True)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}


def brute_components(docs, width, num, den):
    """Least id by text links, by comparing all pairs."""
    sets = [shingles(t, width) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(docs)]


def family(rng, n, size=60, edits=3):
    base = [f"w{rng.randrange(4000)}" for _ in range(size)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(size)] = f"e{rng.randrange(4000)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("hot", [0, 50])
def test_jaccard_join_against_all_pairs(spark, hot):
    rng = random.Random(3)
    line = " ".join(f"c{i}" for i in range(30))
    texts = family(rng, 40) + family(rng, 25, 20, 1) + family(rng, 30, 100, 12)
    # a passage that many share, with more and less of their own around it
    texts += [line + " " + " ".join(f"o{rng.randrange(9000)}" for _ in range(rng.randrange(9))) for _ in range(60)]
    texts += texts[:7] + ["one two", "ONE two", "one", "", None, " \t\n", texts[3].upper(), "é É", "Solo " * 300]
    docs = [(i * 3 % 211, t) for i, t in enumerate(texts)] + [(None, texts[0]), (5, texts[1]), (5, texts[1]), (None, "alone here")]
    got = jaccard.join(table(spark, docs), width=4, num=85, den=100, hot=hot).collect()
    assert Counter(map(tuple, got)) == Counter(brute_components(docs, 4, 85, 100))
    kept = jaccard.one_of_each(table(spark, docs), width=5, num=80, den=100, hot=hot)
    assert kept.columns == DDL.replace(" long", "").replace(" string", "").split(", ")
    kept = [(r.doc_id, r.text) for r in kept.collect()]
    want = brute_components(docs, 5, 80, 100)
    groups = {c for _, n, c in want if n and c is not None}
    assert {d for d, t in kept if shingles(t, 5)} - {None} == groups and len([1 for _, t in kept if not shingles(t, 5)]) == 3


def test_jaccard_join_of_nothing(spark):
    assert jaccard.join(table(spark, [])).count() == 0
    assert jaccard.one_of_each(table(spark, [])).count() == 0


def test_ids_are_the_library_s(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()] + ODD
    library = Tokenizer.from_file(VOCABULARY).encode_batch(texts, add_special_tokens=False)
    encode = WordIds(VOCABULARY)
    assert [encode(t) for t in texts] == [array("I", e.ids).tobytes() for e in library]


def check_packed(rows, docs, capacity=4096):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    want = Counter()
    for d, t in docs:
        ids = array("I", [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])
        want.update((d, p, s, len(ids[s:s + capacity]), zlib.crc32(ids[s:s + capacity].tobytes()))
                    for p, s in enumerate(range(0, len(ids), capacity)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(r.length for r in rows) // capacity)


def test_a_word_is_remembered_once(monkeypatch):
    """A run of letters that is a part and a run of other parts is one entry."""
    missed, find = [], Memory.__missing__
    monkeypatch.setattr(Memory, "__missing__", lambda self, text: missed.append(text) or find(self, text))
    encode, whole = WordIds(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    for text, new in [("harbour über", ["harbour", "über"]), ("harbour, über;", ["harbour,", ",", "über;", ";"]),
                      ("Harbour's harbour", ["Harbour's", "'s"]), ("''s 's ÜBER", ["''s", "''", "s", "ÜBER"])]:
        missed.clear()
        assert encode(text) == array("I", whole.encode(text, add_special_tokens=False).ids).tobytes()
        assert missed == new


def test_words_are_remembered():
    """The words of a task's documents, of which most are rare, are made once."""
    made = []
    memory = Memory(lambda text: made.append(text) or text.encode())
    words = [f"w{i}" for i in range(300_000)]
    assert [memory[w] for w in words] == [memory[w] for w in words] and len(made) == len(words)


def test_ascii_runs_are_the_runs():
    """Every pair of printable characters, alone and in a word, as the library has it."""
    encode, whole = WordIds(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    signs = [chr(i) for i in range(33, 127)]
    for text in (" ".join(a + b for a in signs for b in signs), " ".join(f"we'{a}e9{b}N" for a in signs for b in signs),
                 "x" * (LONGEST + 1) + "'LL I'VE <|end|> <|"):
        assert encode(text) == array("I", whole.encode(text, add_special_tokens=False).ids).tobytes()


def test_packing(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(None, "twice"), (7, "twice"), (7, "twice"), (8, None), (9, ""), (10, "word " * 9000)]
    got = packing.pack(table(spark, docs).repartition(11), VOCABULARY).collect()
    used, least = check_packed(got, docs)
    assert used <= least + 1
    assert packing.pack(table(spark, []), VOCABULARY).count() == 0


def test_best_fit_against_plain():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 101, 500)
    bins, offsets, fill = best_fit(lengths, 100)
    plain = []
    for n in sorted(lengths.tolist(), reverse=True):
        fits = [i for i, f in enumerate(plain) if f + n <= 100]
        if fits:
            plain[max(fits, key=lambda i: plain[i])] += n
        else:
            plain.append(n)
    assert sorted(plain) == sorted(fill.tolist())
    for b in range(len(fill)):
        parts = sorted(zip(offsets[bins == b].tolist(), lengths[bins == b].tolist()))
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]


@pytest.mark.parametrize("kind", ["texts", "even", "halves", "thirds", "short"])
def test_handing_on_few_bins_loses_nothing(monkeypatch, kind):
    """Blocks that hand on 64 bins need as many sequences as blocks that hand on all."""
    rng = np.random.default_rng(2)
    capacity, blocks = packing.CAPACITY, []
    for _ in range(10):
        blocks.append({"texts": lambda: rng.lognormal(5.5, 1.2, 3000), "even": lambda: rng.integers(1, capacity, 2000),
                       "halves": lambda: rng.integers(2000, 2500, 1500), "thirds": lambda: rng.integers(1200, 1500, 2000),
                       "short": lambda: rng.integers(1, 60, 5000)}[kind]().astype(np.int64).clip(1, capacity))

    def sequences(hand_on):
        monkeypatch.setattr(packing, "HAND_ON", hand_on)
        emitted, up = 0, []
        for lengths in blocks:
            fill = best_fit(lengths, capacity)[2]
            done = packing._done(fill, capacity)
            emitted += int(done.sum())
            up.append(fill[~done])
        return emitted + len(best_fit(np.concatenate(up), capacity)[2])

    assert sequences(64) <= sequences(10**9) + 1


def test_toxicity_on_held_out_labels(spark):
    d, sf = spark.read.parquet, "/root/testdata/sf0.1"
    docs, labels = d(f"{sf}/documents.parquet").select("doc_id", "text"), d(f"{sf}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    model = toxicity.train(docs, labels.where(~held))
    judged = toxicity.score(docs.withColumn("grade", F.lit("clash")), model).withColumnRenamed("toxic", "found")
    judged = judged.join(labels.where(held), "doc_id").select("toxic", "found")
    counts = Counter(map(tuple, judged.collect()))
    # marked words that only a few of the sampled documents have cannot be learned here
    assert counts[1, True] >= 0.75 * (counts[1, True] + counts[1, False]), counts
    assert counts[0, True] <= 0.01 * (counts[0, True] + counts[0, False])


def test_ordinal_model_shares_weights():
    rng = np.random.default_rng(2)
    n = 1500
    bad, vile = rng.random(n) < 0.3, rng.random(n) < 0.2
    grades = np.minimum(bad.astype(int) + vile, 2)
    at = np.concatenate([np.flatnonzero(bad), np.flatnonzero(vile), np.arange(n)])
    features = np.concatenate([np.full(bad.sum(), 11), np.full(vile.sum(), 22), np.full(n, 33)])
    model = toxicity.fit(at, features, grades)
    assert set(model.weights) == {11, 22} and model.thresholds == sorted(model.thresholds)
    severity = model.chances(np.array([0, model.weights[11], model.weights[11] + model.weights[22]])).sum(axis=1)
    assert severity[0] < 0.5 < severity[1] < 1.5 < severity[2]
    assert toxicity.fit(at, features, np.zeros(n, dtype=int)).weights == {}


def test_toxicity_edges(spark):
    docs = table(spark, [(1, None), (1, ""), (None, "idiot " * 20000), (2, "!!!")])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, none)).select("doc_id", "toxic", "grade", "kept").collect()
    assert len(got) == 4 and not any(r.toxic for r in got)
    odd = spark.createDataFrame([(1, 1), (1, None), (None, 1), (77, 0)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, odd)).count() == 4
    assert toxicity.score(table(spark, []), toxicity.train(docs, none)).count() == 0


def test_toxicity_of_bounded_words_equals_the_fit_on_all(spark, monkeypatch):
    rng = random.Random(21)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        said = [rng.choice(["plain", "calm", "river", "stone", "paper"]) + rng.choice("abcdefgh") for _ in range(30)]
        said += [rng.choice(["vile", "grim", "foul"]) for _ in range(rng.randrange(4))] if bad or i % 37 == 0 else []
        rows.append((i, " ".join(said)))
        labels.append((i, int(bad)))
    rows += [(0, rows[0][1]), (900, rows[4][1]), (901, None), (902, ""), (903, "x " * 50_000)]
    labels += [(900, 1), (901, 0), (902, 1), (903, 0), (None, 1), (3, None)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    said = dict(labels)
    said[3] = 0
    flags, features = {}, {}
    for i, text in rows:
        flags[text] = max(flags.get(text, 0), said[i])
        features[text] = sorted({toxicity.feature(w) for w in toxicity.words(text or "")})
    texts = sorted(flags, key=lambda t: t or "")
    at = np.array([i for i, t in enumerate(texts) for _ in features[t]])
    held = np.array([f for t in texts for f in features[t]])
    want = toxicity.fit(at, held, toxicity.grade(at, held, np.array([flags[t] for t in texts])))
    assert model.weights.keys() == want.weights.keys() and len(model.weights) >= 2
    assert all(abs(model.weights[k] - w) < 1e-6 for k, w in want.weights.items())
    assert np.allclose(model.thresholds, want.thresholds, atol=1e-6)
    monkeypatch.setattr(toxicity, "PAIRS", 0)   # nothing may reach the driver: nothing is toxic by its words
    assert toxicity.train(docs, marks).weights == {}


def test_sentencepiece_parity_and_round_trip(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(60).collect()] + ODD[:-1]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, None), (3, "again"), (3, "again")]
    encoded = sentencepieces.encode(table(spark, docs), PIECES, threads=2)
    rows = encoded.collect()
    assert len(rows) == len(docs) and all(r.parity and r.round_trip for r in rows)
    back = sentencepieces.decode(encoded, PIECES).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((d, t or "") for d, t in docs)
    marked = sentencepieces.encode(table(spark, [(1, ODD[-1])]), PIECES).first()
    assert marked.parity and not marked.round_trip   # a mark in the text comes back as a space
    assert sentencepieces.encode(table(spark, []), PIECES).count() == 0


def test_words_encoded_as_one_text():
    """Equal to each word by itself, odd ones and those that no piece holds too."""
    codec = sentencepieces.Codec(Path(PIECES).read_bytes())
    rng = random.Random(5)
    letters = "abcdeé漢\u0301\u200d😀\t\n\u00a0\u3000<>s/0x_-'\x00\x7f"
    words = sorted({"".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(3000)} | {"<s>", "<unk>", "<0x41>", "</s>"})
    assert codec._words(words) == codec._library(words) and codec._words([]) == []


def _message(*fields):
    """Protobuf bytes of (number, value) fields: texts, floats or integers."""
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])
    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            raw = value.encode() if isinstance(value, str) else value
            out += varint(number << 3 | 2) + varint(len(raw)) + raw
    return out


@pytest.mark.parametrize("rule", ["identity", "nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("fallback", [0, 1])
def test_unigram_model_against_the_library(spark, tmp_path, rule, fallback):
    """Scores, character map and byte fallback of a unigram model, against the original
    library, on random texts of letters that the map changes and that no piece holds."""
    normaliser = dict(sentencepieces._fields(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()))[3]
    rng = random.Random(rule)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if fallback else []
    stems = {"".join(rng.choices("abcdef1", k=rng.randint(1, 5))) for _ in range(400)} | set("abcdef1▁")
    pieces += [(m + p, -rng.uniform(2, 12), 1) for p in sorted(stems) for m in ("", "▁") if m + p != "▁▁"]
    data = _message(*[(1, _message((1, t), (2, score), (3, kind))) for t, score, kind in pieces],
                    (2, _message((3, 1), (35, fallback), (4, len(pieces)))), (3, normaliser))
    path = tmp_path / "unigram.model"
    path.write_bytes(data)
    texts = ["", " ", "ab  cd ", "ＡＢＣ ﬁ ①②", "e\u0301 é 漢字 😀", "a\u200bb\u00a0c\t d\n e", "x" * 300, "abc " * 2000]
    texts += ["".join(rng.choices("abcdef1 ＡＢ①éñ漢😀\t\u00a0", [8] * 8 + [1] * 9, k=rng.randint(1, 60))) for _ in range(300)]
    rows = sentencepieces.encode(table(spark, list(enumerate(texts))), str(path)).collect()
    original = sentencepiece.SentencePieceProcessor(model_proto=data)
    known = {r.doc_id: original.encode(texts[r.doc_id]) for r in rows}
    assert len(rows) == len(texts) and all(r.parity == (list(r.ids) == known[r.doc_id]) for r in rows)
    # the original sums scores in 32 bits: of splits with the same pieces in another order it may take another
    wrong = [r for r in rows if not r.parity]
    assert len(wrong) <= 1 and all(sorted(r.ids) == sorted(known[r.doc_id]) for r in wrong)


def test_unigram_model_takes_the_best_split():
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("▁ab", -1.0, 1), ("c", -1.0, 1), ("▁a", -3.0, 1), ("bc", -3.0, 1),
              ("▁", -5.0, 1), ("a", -5.0, 1), ("b", -5.0, 1)]
    tokenizer = sentencepieces.build(sentencepieces.ModelFile(pieces, sentencepieces.UNIGRAM))
    assert tokenizer.encode("  abc   ab ").tokens == ["▁ab", "c", "▁ab"]
    assert tokenizer.decode(tokenizer.encode("abc ab").ids) == "abc ab"


def plain_measures(text):
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for k in range(5)}
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed)


def test_quality_measures_against_plain(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(None, None), (1, ""), (1, "\n \n"), (2, "a b c d e " * 3), (3, "x " * 30000), (4, "é 🙂 # a\x0bb\xa0c\n\nq\nq\n q")]
    got = quality.measures(table(spark, docs)).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                   for r in got) == Counter((d, *plain_measures(t)) for d, t in docs)


def test_exact_binomial_bound():
    for n, k, p in ((50, 0, 0.05), (200, 3, 0.04), (1000, 12, 0.02)):
        plain = sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))
        assert math.isclose(math.exp(quality.log_tail(n, k, p)), plain, rel_tol=1e-9)
    began = time.process_time()   # a hundred million labels: near the normal law three deviations below the mean
    assert math.isclose(math.exp(quality.log_tail(10 ** 8, 10 ** 6 - 2985, 0.01)), 0.00135, rel_tol=0.02)
    assert time.process_time() - began < 0.5
    assert quality.allowed(500, 0, 0.02, 0.001) and not quality.allowed(100, 0, 0.02, 0.001)
    assert not quality.allowed(0, 0, 0.02, 0.5) and not quality.allowed(1000, 21, 0.02, 0.999)


def test_cutoffs_keep_good_documents(spark):
    """Good texts of one language have symbols, of the other none: the same text is
    rejected where good documents show that it may be, and kept in the other."""
    good = "plain words of a text that nobody would want to lose at all"
    rows = [(i, f"{good} {i}", "en") for i in range(1600)] + [(2000 + i, f"{good} ##### {i} #####", "xx") for i in range(1600)]
    rows += [(5000, good + " ##########", "en"), (5001, good + " ##########", "xx"), (5002, good, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.where("doc_id < 5000").select("doc_id", F.lit(1).alias("quality"))
    judged = {r.doc_id: r.kept for r in quality.quality(docs, labels).collect()}
    assert not judged[5000] and judged[5001] and judged[5002] and all(judged[i] for i in range(1600))
    none = quality.quality(docs, labels.limit(0))
    assert none.where("not kept").count() == 0 and quality.quality(docs.limit(0), labels).count() == 0


def test_pipeline_against_plain_versions(spark, sf_dir):
    import corpus_pipeline as P
    start = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("best", F.lit("clash"))
    rated = P.quality_rules(spark, start, sf_dir)
    base = {r.doc_id for r in start.collect() if not plain_measures(r.text)[-1]}
    assert {r.doc_id for r in rated.select("doc_id").collect()} <= base and rated.columns == start.columns
    cleaned = P.clean(spark, rated, sf_dir)
    assert cleaned.columns == start.columns
    docs = [(r.doc_id, r.text) for r in cleaned.collect()]
    left = P.near_copies(spark, cleaned, sf_dir)
    want = {c for _, _, c in brute_components(docs, 5, 80, 100)}
    assert {r.doc_id for r in left.collect()} == want and left.columns == start.columns
    texts = dict(docs)
    check_packed(P.pack(spark, left, sf_dir).collect(), [(d, texts[d]) for d in want])
    assert [n for n, _ in P.STAGES] == ["quality_rules", "toxicity", "near_copies", "packing"]

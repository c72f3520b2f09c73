"""Phrase collocations by vertical partitioning of a suffix tree over words.

After ERA (Mansour et al., 2011). A suffix is what follows from a word on in its piece of
text, cut after ``DEPTH`` words. The tree of all suffixes is cut into subtrees that each
fit the memory of a task, by the words they begin with:

1. Words are counted. Words that begin more suffixes than a share of the budget are the
   trunk: they are extended by a second word and counted again, then by a third.
   All other prefixes stay as they are.
2. Prefixes are dealt to groups of about ``BUDGET`` suffixes. Every task cuts its texts
   into blocks, collapses equal suffixes of a block and sends them to their group, as
   bytes.
3. A group sorts its suffixes, which are the leaves of its subtree, and reads the count
   of every node off the totals of its leaves. Counts above a group are in the trunk.
4. Nodes that occur often enough are scored, with joins of candidates and their parts.

Budget and trunk have fixed bounds: the trunk holds at most ``8 * TRUNK`` words and pairs,
as the budget grows with the corpus beyond ``BUDGET * TRUNK`` words.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import settle, trim
from .shingles import mix

DEPTH = 3             # words of the longest phrase
BLOCK = 8 << 20       # bytes of text that are cut into suffixes at once
BUDGET = 1 << 20      # suffixes of a group
SHARE = 8             # a prefix of more than budget / SHARE suffixes is extended
TRUNK = 1 << 15       # groups, beyond which the budget grows
SALTS = 64

# Bytes that end a piece of text, and those between its words.
BREAKS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
NO_LANG = "und"


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    kind = np.zeros(256, dtype=np.uint8)
    kind[list(GAPS)] = 1
    kind[list(BREAKS)] = 2
    return lower, kind


def _cuts(text: bytes, size: int) -> list[bytes]:
    """A long text in parts that end where a piece does."""
    parts, at = [], 0
    while len(text) - at > size:
        to = max(text.rfind(bytes([b]), at, at + size) for b in BREAKS)
        if to < 0:   # one piece of that size: up to its end
            found = [x for x in (text.find(bytes([b]), at) for b in BREAKS) if x >= 0]
            to = min(found, default=len(text) - 1)
        parts.append(text[at:to + 1])
        at = to + 1
    return [*parts, text[at:]]


class Words:
    """Words of a block of text: ``vocabulary`` (binary array), and for every suffix the
    numbers of its first words, 1 and up, 0 behind its piece's end."""

    def __init__(self, data: bytes, depth: int):
        lower, kind = _kinds()
        raw = np.frombuffer(data + b"\n", dtype=np.uint8)
        kinds = kind[raw]
        word = kinds == 0
        edge = np.diff(word.view(np.int8), prepend=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.piece = np.cumsum(kinds == 2, dtype=np.int32)[starts]
        offsets = np.zeros(len(starts) + 1, dtype=np.int64)
        np.cumsum(ends - starts, out=offsets[1:])
        texts = pa.Array.from_buffers(pa.large_binary(), len(starts), [
            None, pa.py_buffer(offsets), pa.py_buffer(lower[raw[word]])])
        coded = texts.dictionary_encode()
        self.vocabulary = coded.dictionary
        first = coded.indices.to_numpy().astype(np.int64) + 1
        self.columns = [first]
        for k in range(1, depth):
            later = np.zeros_like(first)
            if len(first) > k:
                same = self.piece[k:] == self.piece[:-k]
                later[:-k] = np.where(same, first[k:], 0)
            self.columns.append(later)

    def __len__(self) -> int:
        return len(self.vocabulary)


def collapse(columns: list[np.ndarray], size: int, weights: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of columns of numbers below ``size``, sorted, and their total weight."""
    if not len(columns[0]):
        return columns, np.zeros(0, dtype=np.int64)
    if size ** len(columns) < 1 << 63:
        key = reduce(lambda a, b: a * size + b, columns)
        order = None if weights is None else np.argsort(key, kind="stable")
        key = np.sort(key) if order is None else key[order]
        at = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
        rest, out = key[at], []
        for _ in columns:
            rest, last = np.divmod(rest, size)
            out.insert(0, last)
    else:
        order = np.lexsort(columns[::-1])
        sorted_ = [c[order] for c in columns]
        new = reduce(np.logical_or, [np.diff(c, prepend=c[0]) != 0 for c in sorted_])
        new[0] = True
        at = np.flatnonzero(new)
        out = [c[at] for c in sorted_]
    if weights is None:
        return out, np.diff(at, append=len(columns[0]))
    return out, np.add.reduceat(weights[order], at)


def joined(vocabulary: pa.Array, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of word numbers as texts, words with a space between and a line end behind:
    all bytes, and where each row begins (one more entry at the end)."""
    offsets = np.frombuffer(vocabulary.buffers()[1], dtype=np.int64)[vocabulary.offset:vocabulary.offset + len(vocabulary) + 1]
    data = np.frombuffer(vocabulary.buffers()[2] or b"", dtype=np.uint8)
    table = np.stack(columns, axis=1)
    used = table > 0
    ids = table[used] - 1
    length = offsets[ids + 1] - offsets[ids] + 1
    to = np.cumsum(length)
    source = np.repeat(offsets[ids] - (to - length), length) + np.arange(to[-1] if len(to) else 0)
    # one byte after each word is overwritten
    out = np.append(data, np.uint8(0))[np.minimum(source, len(data))]
    per_row = used.sum(axis=1)
    row_ends = to[np.cumsum(per_row) - 1] if len(to) else np.zeros(0, dtype=np.int64)
    out[to - 1] = 32
    out[row_ends - 1] = 10
    return out, np.concatenate([np.zeros(1, dtype=np.int64), row_ends])


def texts_of(vocabulary: pa.Array, columns: list[np.ndarray]) -> pa.Array:
    """The same as a binary array, without the line ends."""
    data, at = joined(vocabulary, columns)
    keep = np.ones(len(data), dtype=bool)
    keep[at[1:] - 1] = False
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [
        None, pa.py_buffer(at - np.arange(len(at))), pa.py_buffer(data[keep])])


def _blocks(batches, depth: int, block: int):
    """``(lang, Words)`` per language and block of text of a task."""
    held, size = {}, 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for part in _cuts(text, block) if text else ():
                held.setdefault(lang, []).append(part)
                size += len(part) + 1
                if size >= block:
                    for name, parts in held.items():
                        yield name, Words(b"\n".join(parts), depth)
                    held, size = {}, 0
    for name, parts in held.items():
        yield name, Words(b"\n".join(parts), depth)


def _counts(heavy, block: int):
    """Words of each block with their counts; with ``heavy`` words, the pairs that begin
    with one of them."""
    def run(batches):
        for lang, words in _blocks(batches, 1 if heavy is None else 2, block):
            if heavy is None:
                n = np.bincount(words.columns[0] - 1, minlength=len(words))
                texts = words.vocabulary
            else:
                wanted = heavy.value.get(lang)
                if wanted is None:
                    continue
                first, second = words.columns
                flags = np.append(False, pc.is_in(words.vocabulary, wanted).to_numpy(zero_copy_only=False))
                chosen = flags[first] & (second > 0)
                pairs, n = collapse([first[chosen], second[chosen]], len(words) + 1)
                texts = texts_of(words.vocabulary, pairs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(n), pa.string()), texts.cast(pa.binary()), pa.array(n, pa.int64())],
                ["lang", "phrase", "n"])
        trim()
    return run


def _deal(trunk, sizes: tuple[int, int, int], depth: int, block: int):
    """Collapsed suffixes of each block, a row per group."""
    def run(batches):
        words_of, pairs_of = trunk.value
        for lang, words in _blocks(batches, depth, block):
            rows, n = collapse(words.columns, len(words) + 1)
            seed = zlib.crc32(lang.encode())
            h = np.zeros(len(words) + 1, dtype=np.uint64)
            h[1:] = np.fromiter((zlib.crc32(w, seed) for w in words.vocabulary.to_pylist()), dtype=np.uint64, count=len(words))
            with np.errstate(over="ignore"):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
                group = h[rows[0]] % np.uint64(sizes[0])
                keep = np.ones(len(n), dtype=bool)
                if lang in words_of:
                    flags = np.append(False, pc.is_in(words.vocabulary, words_of[lang]).to_numpy(zero_copy_only=False))
                    deep = np.flatnonzero(flags[rows[0]])
                    keep[deep] = rows[1][deep] > 0   # the word's own count is in the trunk
                    pair = mix(h[rows[0][deep]] * np.uint64(31) + h[rows[1][deep]])
                    group[deep] = np.uint64(sizes[0]) + pair % np.uint64(sizes[1])
                    if lang in pairs_of:
                        known = pc.is_in(texts_of(words.vocabulary, [rows[0][deep], rows[1][deep]]), pairs_of[lang])
                        deeper = known.to_numpy(zero_copy_only=False)
                        at = deep[deeper]
                        keep[at] = rows[2][at] > 0
                        whole = mix(pair[deeper] * np.uint64(31) + h[rows[2][at]])
                        group[at] = np.uint64(sizes[0] + sizes[1]) + whole % np.uint64(sizes[2])
            order = np.argsort(group[keep], kind="stable")
            group, n = group[keep][order].astype(np.int64), n[keep][order]
            data, at = joined(words.vocabulary, [c[keep][order] for c in rows])
            if not len(n):
                continue
            first = np.flatnonzero(np.diff(group, prepend=-1))
            last = np.append(first[1:], len(group))
            yield pa.RecordBatch.from_arrays(
                [pa.array(group[first]), pa.array([lang] * len(first), pa.string()),
                 pa.array([data[at[a]:at[b]].tobytes() for a, b in zip(first, last)], pa.binary()),
                 pa.array([n[a:b].astype(np.int64).tobytes() for a, b in zip(first, last)], pa.binary())],
                ["group", "lang", "suffixes", "counts"])
        trim()
    return run


def _subtree(sizes: tuple[int, int, int], depth: int, least: int):
    """Nodes of one group that occur ``least`` times, read off the totals of its leaves."""
    def run(table: pa.Table) -> pa.Table:
        group = table.column("group")[0].as_py()
        # nodes above a prefix of two or three words are in the trunk
        top = 1 if group < sizes[0] else 2 if group < sizes[0] + sizes[1] else 3
        out = {"lang": [], "depth": [], "phrase": [], "n": []}
        rows = {}
        for lang, suffixes, counts in zip(*(table.column(c).to_pylist() for c in ("lang", "suffixes", "counts"))):
            rows.setdefault(lang, []).append((suffixes, counts))
        for lang, parts in rows.items():
            words = Words(b"".join(s for s, _ in parts), depth)
            weights = np.frombuffer(b"".join(c for _, c in parts), dtype=np.int64)
            firsts = np.flatnonzero(np.diff(words.piece, prepend=-1))
            leaves, n = collapse([c[firsts] for c in words.columns], len(words) + 1, weights)
            new = np.zeros(len(n), dtype=bool)
            new[:1] = True
            for d in range(1, depth + 1):
                new[1:] |= np.diff(leaves[d - 1]) != 0
                if d < top:
                    continue
                at = np.flatnonzero(new)
                totals = np.add.reduceat(n, at) if len(at) else n
                chosen = (totals >= least) & (leaves[d - 1][at] > 0)
                phrases = texts_of(words.vocabulary, [c[at[chosen]] for c in leaves[:d]])
                out["lang"].append(pa.array([lang] * len(phrases), pa.string()))
                out["depth"].append(pa.array(np.full(len(phrases), d), pa.int32()))
                out["phrase"].append(phrases.cast(pa.binary()))
                out["n"].append(pa.array(totals[chosen], pa.int64()))
        trim()
        types = {"lang": pa.string(), "depth": pa.int32(), "phrase": pa.binary(), "n": pa.int64()}
        return pa.table({c: pa.chunked_array(v, types[c]) for c, v in out.items()})
    return run


def _by_lang(rows: list) -> dict[str, pa.Array]:
    found: dict[str, list[bytes]] = {}
    for r in rows:
        found.setdefault(r["lang"], []).append(bytes(r["phrase"]))
    return {lang: pa.array(v, pa.large_binary()) for lang, v in found.items()}


def count_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, depth: int = DEPTH,
                  budget: int = BUDGET, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``nodes`` (lang, phrase, depth, n: every phrase of up to ``depth`` words that occurs
    ``least`` times), the ``trunk`` (the same columns; its size is bounded) and ``totals``
    (lang, n: all words).

    A-Z count as a-z; pieces end at ``.,;:!?`` and line ends, words at space and tab. A
    null language is ``und``, a null text has no words.
    """
    if depth < 3:
        raise ValueError("the tree is at least three words deep")
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"),
                        F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    row = "lang string, phrase binary, n long"
    words = settle(texts.mapInArrow(_counts(None, block), row).groupBy("lang", "phrase").agg(F.sum("n").alias("n")), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    total = words.agg(F.sum("n")).first()[0] or 0
    budget = max(budget, -(-total // TRUNK))
    limit = max(budget // SHARE, least)

    heavy = words.where(F.col("n") > limit)   # total / limit of them at most
    heavy_words = heavy.collect()
    heavy_pairs, pairs = [], None
    if heavy_words:
        known = spark.sparkContext.broadcast(_by_lang(heavy_words))
        pairs = settle(texts.mapInArrow(_counts(known, block), row).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
                       .where(F.col("n") > limit), "pairs")
        heavy_pairs = pairs.collect()
    below = sum(r["n"] for r in heavy_words)
    deepest = sum(r["n"] for r in heavy_pairs)
    sizes = tuple(max(1, -(-n // budget)) for n in (total - below, below - deepest, deepest))
    trunk_of = spark.sparkContext.broadcast((_by_lang(heavy_words), _by_lang(heavy_pairs)))
    dealt = texts.mapInArrow(_deal(trunk_of, sizes, depth, block), "group long, lang string, suffixes binary, counts binary")
    nodes = dealt.groupBy("group").applyInArrow(_subtree(sizes, depth, least), "lang string, depth int, phrase binary, n long")
    trunk = heavy.withColumn("depth", F.lit(1))
    if pairs is not None:
        trunk = trunk.unionByName(pairs.withColumn("depth", F.lit(2)))
    columns = ["lang", F.col("phrase").cast("string").alias("phrase"), "depth", "n"]
    nodes = settle(nodes.unionByName(trunk).select(*columns), "nodes")
    return nodes, trunk.select(*columns), totals


def _look_up(rows: DataFrame, part: str, name: str, nodes: DataFrame, trunk: DataFrame) -> DataFrame:
    """The count of the phrase in column ``part``. Phrases that very many candidates hold
    are in the trunk, whose size is bounded; any other is held by no more than its count."""
    key = ["lang", part]
    def table(df):
        return df.select("lang", F.col("phrase").alias(part), F.col("n").alias(name))
    known = rows.join(F.broadcast(table(trunk)), key, "left")
    rest = known.where(F.col(name).isNull()).drop(name).join(table(nodes), key)
    return known.where(F.col(name).isNotNull()).unionByName(rest)


def _score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000000 a a / (l r)), in exact decimals."""
    big = lambda c: c.cast("decimal(16,0)")
    million = F.lit(1000000).cast("decimal(7,0)")
    return F.call_function("div", (million * big(a) * big(a)).cast("decimal(38,0)"), (big(l) * big(r)).cast("decimal(38,0)"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, top: int = 2000,
                 depth: int = DEPTH, budget: int = BUDGET, block: int = BLOCK) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language.

    Candidates are phrases of 2 to ``depth`` words that occur ``least`` times (``a``). Of
    the cuts into a first part (``l`` times) and a rest (``r`` times) the lowest score
    counts, the shortest first part on ties. A candidate is dropped if it lies in a longer
    one that occurs at least half as often. Ranks go by score, then a, both descending,
    then the phrase's bytes. Languages without candidates give no row.
    """
    nodes, trunk, totals = count_phrases(docs, text, lang, least, depth, budget, block)
    found = nodes.where("depth >= 2").select("lang", "phrase", "depth", F.col("n").alias("a"))
    words = F.split("phrase", " ")
    def part(a: Column, n: Column) -> Column:
        return F.array_join(F.slice(words, a, n), " ")
    cut = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("depth") - 1)))
    cut = cut.withColumn("first", part(F.lit(1), F.col("k"))).withColumn(
        "rest", part(F.col("k") + 1, F.col("depth") - F.col("k")))
    cut = _look_up(_look_up(cut, "first", "l", nodes, trunk), "rest", "r", nodes, trunk)
    lowest = F.min(F.struct(_score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r"))
    scored = cut.groupBy("lang", "phrase", "a").agg(lowest.alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    # phrases inside longer candidates, with the count of the most frequent of those
    inner = (found.where("depth >= 3").withColumn("n", F.explode(F.sequence(F.lit(2), F.col("depth") - 1)))
             .withColumn("i", F.explode(F.sequence(F.lit(1), F.col("depth") - F.col("n") + 1)))
             .select("lang", part(F.col("i"), F.col("n")).alias("phrase"), "a")
             .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    kept = scored.join(inner, ["lang", "phrase"], "left").where("longer is null or 100 * longer < 50 * a")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    best = kept.withColumn("salt", salt).withColumn("rank", F.row_number().over(
        W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

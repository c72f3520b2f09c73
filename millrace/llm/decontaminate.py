"""Benchmark passages in documents: a prefix-filtered set join, in DataFrame functions alone.

Every item is cut into windows of ten consecutive words; an item of fewer words is one
window. A window lies in a document if all its words do, in a row, so of its shingles
(three words, or the whole of a shorter window) all must be found. For such a join a
prefix of one shingle is enough. Steps:

1. ``_frequencies``: how often every shingle of the benchmark occurs in all documents.
2. ``_anchors``: shingles are ordered by that, rarest first; a window's prefix is its
   rarest shingle. Neighbouring windows mostly share it.
3. The shingles of all documents are joined with the prefixes. A match fixes where the
   window would start; the positional bound drops those that start before the text,
   the length bound those that end behind it.
4. What is left is verified: the item-sized window of the document against the words of
   the benchmark window, as texts.

Matches are reduced to intervals and window numbers, one row per document. Prefixes are
broadcast up to ``BROADCAST`` rows; beyond that shingles and prefixes are joined by a
shuffle, without the texts, and the texts of documents with a match are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, settle

WINDOW = 10           # words of a window
SHINGLE = 3           # words of a shingle
BROADCAST = 200_000   # windows, or shingles, that every task may hold

# What is no part of a word, A-Z aside, which count as a-z.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["_doc", "_text"]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), BREAKS), "")


def _shingles(words: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` words, in order. ``lower`` takes more letters
    together than the contract does, which only adds matches for the verification."""
    def runs(h: Column) -> Column:
        return F.when(F.size(h) >= width, F.transform(
            F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[h[i + k] for k in range(width)])
        )).otherwise(F.array().cast("array<bigint>"))
    return let(F.transform(words, lambda w: F.xxhash64(F.lower(w))), runs)


def windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """``item, words, n``: the windows of every item, items without words left out."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"),
                             _words(F.translate(F.col(text).cast("string"), UPPER, LOWER)).alias("w"))
    first = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1))))
    return (items.where(F.size("w") > 0).select("item", "w", first.alias("i"))
            .select("item", F.slice("w", F.col("i"), F.lit(size)).alias("words"))
            .withColumn("n", F.size("words")))


def _window_shingles(found: DataFrame, width: int) -> DataFrame:
    """``words, n, width, at, shingle``: a row per shingle of every distinct window."""
    parts = [found.where(F.col("n") >= width if k == width else F.col("n") == k).select(
        "words", "n", F.lit(k).alias("width"), F.posexplode(_shingles(F.col("words"), k)).alias("at", "shingle"))
        for k in range(1, width + 1)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _tokens(docs: DataFrame, doc_id: str, text: str, widths: list[int], whole: bool) -> DataFrame:
    """``_doc, _text`` (a hash), ``_n``, ``_words`` and one row per shingle width with
    its hashes; ``whole`` adds a row of width 0 with the one hash 0, which stands for the
    document itself."""
    sets = [F.struct(F.lit(0).alias("width"), F.array(F.lit(0).cast("long")).alias("h"))] if whole else []
    words = docs.select(F.col(doc_id).alias("_doc"), F.xxhash64(F.col(text)).alias("_text"),
                        _words(F.col(text)).alias("_words"))
    sets += [F.struct(F.lit(k).alias("width"), _shingles(F.col("_words"), k).alias("h")) for k in widths]
    return words.select(*KEY, F.size("_words").alias("_n"), "_words", F.explode(F.array(*sets)).alias("_set"))


def _each_shingle(tokens: DataFrame, *keep: str) -> DataFrame:
    return tokens.select(*keep, F.col("_set.width").alias("width"), F.posexplode("_set.h").alias("_at", "shingle"))


def _frequencies(docs: DataFrame, doc_id: str, text: str, widths: list[int], wanted: DataFrame, small: bool) -> DataFrame:
    met = _each_shingle(_tokens(docs, doc_id, text, widths, False)).select("shingle")
    if small:
        met = met.join(F.broadcast(wanted), "shingle", "left_semi")
    return met.groupBy("shingle").agg(F.count("*").alias("met"))


def _anchors(docs: DataFrame, doc_id: str, text: str, found: DataFrame, width: int, limit: int) -> tuple[DataFrame, list[int], bool]:
    """A row per distinct window: its number, words, and where its rarest shingle lies."""
    parts = settle(_window_shingles(found.select("words", "n").distinct(), width), "window_shingles")
    # at most ``width`` numbers
    widths = sorted(r["width"] for r in parts.select("width").distinct().collect()) or [width]
    wanted = parts.select("shingle").distinct()
    small = wanted.count() <= limit
    met = _frequencies(docs, doc_id, text, widths, wanted, small)
    ranked = parts.join(met, "shingle", "left")
    rarest = ranked.groupBy("words", "n").agg(F.min(F.struct(
        F.coalesce("met", F.lit(0)).alias("met"), "shingle", "at", "width")).alias("rarest"))
    numbered = rarest.select(
        F.monotonically_increasing_id().alias("window"), F.array_join("words", " ").alias("window_text"),
        F.col("n").alias("window_n"), "rarest.shingle", "rarest.at", F.col("rarest.width").alias("shingle_width"))
    # written, so the numbers stay
    anchors = settle(numbered, "anchors")
    return anchors, widths, anchors.count() <= limit


def _matches(docs: DataFrame, doc_id: str, text: str, anchors: DataFrame, widths: list[int], small: bool) -> DataFrame:
    """``_doc, _text, _n, start, window_n, window``: every occurrence of a window, and per
    document row one with ``window_n`` 0."""
    start = F.col("_at") - F.col("at")
    fits = (F.col("width") == F.col("shingle_width")) & (start >= 0) & (start + F.col("window_n") <= F.col("_n"))
    same = F.translate(F.array_join(F.slice("_words", F.col("start") + 1, F.col("window_n")), " "), UPPER, LOWER) == F.col("window_text")
    columns = [*KEY, "_n", "start", "window_n", "window"]
    if small:
        itself = anchors.sparkSession.range(1).select(
            F.lit(-1).cast("long").alias("window"), F.lit("").alias("window_text"), F.lit(0).alias("window_n"),
            F.lit(0).cast("long").alias("shingle"), F.lit(0).alias("at"), F.lit(0).alias("shingle_width"))
        rows = _each_shingle(_tokens(docs, doc_id, text, widths, True), *KEY, "_n", "_words")
        joined = rows.join(F.broadcast(anchors.unionByName(itself)), "shingle")
        return joined.where(fits).withColumn("start", start).where(same).select(*columns)
    tokens = _tokens(docs, doc_id, text, widths, False)
    near = (_each_shingle(tokens, *KEY, "_n").join(anchors, "shingle").where(fits)
            .select(*KEY, "_n", start.alias("start"), "window_n", "window", "window_text").distinct())
    whole = docs.select(F.col(doc_id).alias("_doc"), F.xxhash64(F.col(text)).alias("_text"), _words(F.col(text)).alias("_words"))
    texts = whole.dropDuplicates(KEY).withColumnRenamed("_doc", "_d").withColumnRenamed("_text", "_t")
    hits = near.join(texts, F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_text") == F.col("_t"))).where(same).select(*columns)
    return hits.unionByName(whole.select(*KEY, F.size("_words").alias("_n"), F.lit(0).alias("start"),
                                         F.lit(0).alias("window_n"), F.lit(-1).cast("long").alias("window")))


def _covered(spans: Column) -> Column:
    """Words under sorted spans ``start, to``, each counted once."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    return F.aggregate(spans, zero, lambda s, x: F.struct(
        (s["n"] + F.greatest(x["to"] - F.greatest(x["start"], s["upto"]), F.lit(0))).alias("n"),
        F.greatest(s["upto"], x["to"]).alias("upto")), lambda s: s["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, width: int = SHINGLE,
                  broadcast: int = BROADCAST) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items, contaminated``, one row per document row.

    Words are runs of digits, letters a-z (A-Z count as a-z) and all characters beyond
    ASCII. ``n_hit`` counts the document's words inside any occurrence of a window,
    ``items`` holds the sorted ids (as texts) of the items with a window that occurs. Null
    texts have no words. An item without words matches nothing; one with a null id marks
    words but is not listed; items of one id count once. Null document ids are allowed,
    repeated rows give repeated results. An empty benchmark leaves all documents clean.
    """
    found = windows(benchmark, item_id, item_text, size)
    anchors, widths, small = _anchors(docs, doc_id, text, found, width, broadcast)
    matches = _matches(docs, doc_id, text, anchors, widths, small)
    # a document's row of its own counts the copies; the spans are no more than its words
    per_doc = settle(matches.groupBy(*KEY).agg(
        F.max("_n").alias("_n"), F.count_if(F.col("window") < 0).alias("_copies"),
        F.collect_set(F.when(F.col("window") >= 0, F.struct("start", (F.col("start") + F.col("window_n")).alias("to")))).alias("_spans"),
        F.collect_set(F.when(F.col("window") >= 0, F.col("window"))).alias("_windows")), "matches")
    listed = (found.where("item is not null").select(F.array_join("words", " ").alias("window_text"), "item").distinct()
              .join(anchors.select("window", "window_text"), "window_text").select("window", "item"))
    items = (per_doc.where(F.size("_windows") > 0).select(*KEY, F.explode("_windows").alias("window"))
             .join(listed, "window").groupBy(*KEY).agg(F.sort_array(F.collect_set("item")).alias("items"))
             .select(F.col("_doc").alias("_d"), F.col("_text").alias("_t"), "items"))
    joined = per_doc.join(items, F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_text") == F.col("_t")), "left")
    n_hit = _covered(F.sort_array("_spans"))
    rows = joined.select(
        F.col("_doc").alias(doc_id), F.col("_n").cast("long").alias("n_words"), n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), "_copies")
    once = F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int")))
    return rows.select("*", once.alias("_copy")).select(
        doc_id, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items",
        (F.col("n_hit") > 0).alias("contaminated"))

"""Similarity join of documents on the Jaccard index of their word n-grams.

Prefix filtering with a global rare-first order (Xiao et al., PPJoin+): two sets
that reach the threshold share a shingle among the first few of each. Steps:

1. ``order``: shingles met twice or more in a block of texts are counted over all
   blocks. The ``HOT`` most frequent, a table of fixed size, go last, by count; all
   others by hash. The order only decides how many candidates there are.
2. ``postings``: the prefix of every document, one row per shingle. Texts with the
   same set are one node; within a block only one of them is emitted.
3. Of each shingle's documents the one with the rarest-ranked match is the pivot.
   All others are paired with the pivot only, so a shingle of g documents gives
   g - 1 pairs. Pairs pass the length and the positional filter, then the suffix
   filter (counts of shingles by hash range), then are verified once on whole sets.
4. What the pivots linked is joined to components. Pairs of the same shingle whose
   ends still lie in different components are then joined, by shingle and length
   class, through the same filters; again each is verified once.

So every pair that could join two components is verified, and copies that a chain
of verified links already joins are not expanded into all their pairs.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, release_cache, settle, trim
from .components import components
from .shingles import distinct, shingle_sets

HOT = 1 << 18       # shingles whose frequency is known, whatever the input's size
BLOCK = 4 << 20     # shingles held at once by a task
RANGES = 32         # hash ranges of the suffix filter
BITS = 1 << 26      # size of the filter on nodes that need their sets


def _key(shingles: np.ndarray) -> tuple[int, bytes]:
    digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), digest


def _document_rows(width):
    def run(batches):
        release_cache()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            n, node = [], []
            for s in shingle_sets(texts, width):
                n.append(len(s))
                node.append(_key(s)[0] if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(node, pa.int64())], ["doc_id", "n_shingles", "node"])
    return run


def _block_counts(width):
    """Shingles in two or more documents of a block of texts, with their counts there."""
    def flush(held):
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        twice = counts > 1
        return pa.RecordBatch.from_arrays(
            [pa.array(values[twice].view(np.int64)), pa.array(counts[twice].astype(np.int64))], ["shingle", "count"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for s in shingle_sets(batch.column(0), width):
                held.append(s)
                size += len(s)
                if size >= BLOCK:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)
        trim()
    return run


def order(texts: DataFrame, text: str, width: int, hot: int = HOT) -> tuple[np.ndarray, np.ndarray]:
    """The frequent shingles (sorted) and their ranks, 1 for the least frequent."""
    counts = (texts.select(text).mapInArrow(_block_counts(width), "shingle long, count long")
              .groupBy("shingle").agg(F.sum("count").alias("count")))
    top = counts.orderBy(F.desc("count"), "shingle").limit(hot).toArrow()
    shingles = top.column("shingle").to_numpy().view(np.uint64)
    ranks = np.arange(len(shingles), 0, -1, dtype=np.int32)
    by = np.argsort(shingles)
    return shingles[by], ranks[by]


def prefix_length(n: int, num: int, den: int) -> int:
    """Shingles of a set of n of which a set at the threshold shares one at least."""
    return n - -(-num * n // den) + 1


def _postings(width, num, den, frequent):
    def run(batches):
        hot, ranks = frequent.value
        for batch in batches:
            shingle, node, at = [], [], []
            seen = set()
            for s in shingle_sets(batch.column(0), width):
                if not len(s):
                    continue
                key, digest = _key(s)
                if digest in seen:
                    continue
                seen.add(digest)
                n = len(s)
                m = prefix_length(n, num, den)
                first = s
                if len(hot):
                    i = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                    rank = np.where(hot[i] == s, ranks[i], 0)
                    if rank.any():
                        first = s[np.argsort(rank, kind="stable")]
                shingle.append(first[:m])
                node.append(np.full(m, key, dtype=np.int64))
                at.append((n << 32) + np.arange(m, dtype=np.int64))
            if shingle:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(shingle).view(np.int64)), pa.array(np.concatenate(node)),
                     pa.array(np.concatenate(at))], ["shingle", "node", "at"])
        trim()
    return run


def _sets(width, wanted):
    """Node, counts by hash range and whole set of documents that the filter lets through."""
    def run(batches):
        bits = np.frombuffer(wanted.value, dtype=np.uint8)
        for batch in batches:
            node, ranges, whole = [], [], []
            seen = set()
            for s in shingle_sets(batch.column(0), width):
                if not len(s):
                    continue
                key, digest = _key(s)
                slot = key % (len(bits) * 8)
                if digest in seen or not bits[slot >> 3] >> (slot & 7) & 1:
                    continue
                seen.add(digest)
                node.append(key)
                ranges.append(np.bincount((s >> np.uint64(59)).astype(np.int64), minlength=RANGES)
                              .astype("<u4").tobytes())
                whole.append(s.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(node, pa.int64()), pa.array(ranges, pa.binary()), pa.array(whole, pa.binary())],
                ["node", "ranges", "whole"])
        trim()
    return run


def _suffix_filter(num, den):
    """Keep pairs whose shared shingles, at most the lesser count in each hash
    range, could reach the threshold."""
    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u4").reshape(-1, RANGES)
                    for c in ("ranges_a", "ranges_b"))
            most = np.minimum(x, y).sum(axis=1, dtype=np.int64)
            both = x.sum(axis=1, dtype=np.int64) + y.sum(axis=1, dtype=np.int64)
            keep = pa.array((num + den) * most >= num * both)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])
    return run


def _verify(num, den):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("whole_a"), batch.column("whole_b"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(x) + len(y)
                shared = both - len(distinct(np.concatenate([x, y])))
                keep.append((num + den) * shared >= num * both)
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])
    return run


def _can_reach(num, den, na, pa_, nb, pb):
    """Length filter, and positional filter: if this is the first shingle that the
    two share, they share at most what is left of either from here."""
    return ((den * F.least(na, nb) >= num * F.greatest(na, nb))
            & ((num + den) * F.least(na - pa_, nb - pb) >= num * (na + nb)))


def _verified(pairs: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Of distinct pairs ``(a, b)`` those at the threshold. Only the sets of documents in
    these pairs are made again and moved."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    wanted = texts.sparkSession.sparkContext.broadcast(bit_filter(ends, "node", BITS))
    sets = texts.mapInArrow(_sets(width, wanted), "node long, ranges binary, whole binary")
    sets = settle(sets.groupBy("node").agg(F.first("ranges").alias("ranges"), F.first("whole").alias("whole")), "sets")

    def side(column, end):
        return sets.select(F.col("node").alias(end), F.col(column).alias(f"{column}_{end}"))
    near = (pairs.join(side("ranges", "a"), "a").join(side("ranges", "b"), "b")
            .mapInArrow(_suffix_filter(num, den), "a long, b long"))
    near = settle(near, "near")
    return (near.join(side("whole", "a"), "a").join(side("whole", "b"), "b")
            .mapInArrow(_verify(num, den), "a long, b long"))


def _classes(docs: DataFrame, doc_id: str, text: str, width: int, num: int, den: int, hot: int) -> DataFrame:
    """``(doc_id, n_shingles, node, root)`` per row: the class of its shingle set and of its component."""
    context = docs.sparkSession.sparkContext
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    id_type = own.schema["doc_id"].dataType.simpleString()
    rows = settle(own.mapInArrow(_document_rows(width), f"doc_id {id_type}, n_shingles long, node long"), "documents")

    texts = own.select("text")
    frequent = context.broadcast(order(texts, "text", width, hot))
    posted = texts.mapInArrow(_postings(width, num, den, frequent), "shingle long, node long, at long")
    n, place = F.shiftright("at", 32), F.col("at").bitwiseAND(0xFFFFFFFF)
    # one pair of longs per shingle: the rank of its pivot, and whether there are two
    # documents; equal nodes have equal ranks
    rank = F.shiftleft((place * 32768 / n).cast("long"), 48) + F.col("node").bitwiseAND((1 << 48) - 1)
    shared = posted.groupBy("shingle").agg(F.min(rank).alias("least"), F.max(rank).alias("most")).where("least <> most")
    met = settle(posted.join(shared.select("shingle", "least"), "shingle").select(
        "shingle", "node", n.alias("n"), place.alias("place"), (rank == F.col("least")).alias("first"))
        .distinct(), "met")
    pivot = met.where("first").select("shingle", F.struct("node", "n", "place").alias("pivot"))

    by_pivot = settle(
        met.join(pivot, "shingle").where(F.col("pivot.node") != F.col("node"))
        .where(_can_reach(num, den, F.col("n"), F.col("place"), F.col("pivot.n"), F.col("pivot.place")))
        .select(F.least("node", "pivot.node").alias("a"), F.greatest("node", "pivot.node").alias("b")).distinct(),
        "pairs")
    links = settle(_verified(by_pivot, texts, width, num, den), "verified")
    group = settle(components(links, "a", "b"), "groups")

    # pairs that could still join two components
    placed = met.drop("first").join(group, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = placed.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    placed = settle(placed.join(open_.select("shingle"), "shingle"), "open")
    step = math.log(den / num) if num < den else 1e-9
    length_class = F.floor(F.log("n") / F.lit(step)).cast("long")
    x = placed.select("shingle", length_class.alias("class"), *[F.col(c).alias(f"{c}_a") for c in
                                                                ("node", "n", "place", "root")])
    y = placed.select("shingle", F.explode(F.array(length_class - 1, length_class, length_class + 1)).alias("class"),
                      *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "place", "root")])
    rest = (x.join(y, ["shingle", "class"])
            .where((F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")))
            .where(_can_reach(num, den, F.col("n_a"), F.col("place_a"), F.col("n_b"), F.col("place_b")))
            .select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
            .join(by_pivot, ["a", "b"], "left_anti"))
    all_links = settle(links.unionByName(_verified(settle(rest, "rest"), texts, width, num, den)), "links")
    group = components(all_links, "a", "b")

    return rows.join(group, "node", "left").withColumn("root", F.coalesce("root", "node"))


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, num: int = 85,
         den: int = 100, hot: int = HOT) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per input row.

    Documents link when ``den * |intersection| >= num * |union|`` over their distinct
    shingles of ``width`` words (words: runs without ASCII white space, A-Z lowered).
    ``component_id`` is the smallest doc_id reachable by links, the own included.

    Null and empty texts, and texts without words, have no shingle and link with
    nothing. Rows with equal texts link with each other, also under the same or a
    null doc_id; a null doc_id is never the smallest unless all are null. Texts of any
    length count whole. Other columns, whatever their names, are not read.

    Shingles are compared by 64-bit hashes, sets by the hash of their hashes.
    """
    rows = _classes(docs, doc_id, text, width, num, den, hot)
    least = rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "root", "left").select(
        "doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        .alias("component_id"))


def _with_node(width, place):
    def run(batches):
        for batch in batches:
            node = [_key(s)[0] if len(s) else None for s in shingle_sets(batch.column(place), width)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node, pa.int64())],
                                             [*batch.schema.names, "_node"])
    return run


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, num: int = 80,
                den: int = 100, hot: int = HOT) -> DataFrame:
    """One row of each component of ``docs``, with all its columns: the one with the
    smallest doc_id (a null doc_id only if all are null), and one of rows that repeat.
    Rows without a shingle, which link with nothing, all stay."""
    rows = settle(_classes(docs, doc_id, text, width, num, den, hot), "classes").where("node is not null")
    counted = rows.groupBy("root", "node", "doc_id").agg(F.count("*").alias("copies"))
    best = counted.groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("unknown"), "doc_id", "node", "copies")).alias("best"))
    best = best.select(F.col("best.node").alias("_node"), F.col("best.doc_id").alias("_id"),
                       F.col("best.copies").alias("_copies"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    plain = docs.withColumn(text, F.col(text).cast("string"))
    named = plain.mapInArrow(_with_node(width, docs.columns.index(text)), f"{fields}, _node long")
    met = named.join(best, "_node", "left")
    stays = met.where(F.col("_node").isNull() | (F.col("_id").eqNullSafe(F.col(doc_id)) & (F.col("_copies") == 1)))
    again = met.where(F.col("_id").eqNullSafe(F.col(doc_id)) & (F.col("_copies") > 1)).dropDuplicates(["_node"])
    return stays.unionByName(again).select(*docs.columns)

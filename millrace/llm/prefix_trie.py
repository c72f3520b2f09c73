"""The prefix trie of conversations by whole-sequence collapse.

1. Turns become digests of role and text; each conversation is one sequence of digests.
   A chain of hashes along it names every prefix.
2. Identical sequences are grouped to one with a weight (how many), the smallest
   conversation and the list of conversations that end there.
3. Sequences that are proper prefixes of others are found by an anti-join on all
   prefixes; what stays are the leaves.
4. The weighted prefixes of the distinct sequences are aggregated to nodes. A node
   belongs to the sequence with its smallest conversation, so each sequence owns the
   lower end of its path: sums over subtrees are sums along a path, added up per node.

No step moves a text after the digests. A prefix shared by many conversations is summed
before the shuffle; the list of those that end at one node is cut into blocks of ids,
joined to texts block by block, and hashed as a stream. A conversation's own digests
(16 bytes a turn) are held together in one row.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import salted_join
from .common import settle

WORDS = r"[^\x20\x09-\x0D]+"
SHARED = 20       # ids of one stretch share the opening of the first
OPENINGS = 4      # as many lengths of a shared opening
END_BLOCK = 4096  # ids of a block of an end list


def sequences(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
              text: str = "text") -> DataFrame:
    """``conv, turns``: every conversation's turns, as digest and number of words, by turn.

    Null turns come first; turns of equal number are ordered by digest. Null roles and
    texts are empty. Rows without a conversation id are left out.
    """
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.unhex(F.md5(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t)))
    rows = turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"), F.col(turn).isNotNull().alias("some"), F.col(turn).alias("turn"),
        digest.alias("digest"), F.regexp_count(t, F.lit(WORDS)).alias("words"))
    ordered = F.array_sort(F.collect_list(F.struct("some", F.coalesce("turn", F.lit(0)).alias("turn"), "digest", "words")))
    return rows.groupBy("conv").agg(ordered.alias("turns")).select(
        "conv", F.transform("turns", lambda x: F.struct(x["digest"].alias("digest"), x["words"].alias("words"))).alias("turns"))


def shared_openings(found: DataFrame) -> DataFrame:
    """Every conversation c with the first h turns of conversation c - c % 20 before its
    own turns after the first h, h = crc32(c in decimal) % 4."""
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % OPENINGS).cast("int")
    heads = found.select(F.col("conv").alias("first"), F.slice("turns", 1, OPENINGS - 1).alias("head"))
    joined = found.withColumn("first", F.col("conv") - F.col("conv") % SHARED).join(heads, "first", "left")
    empty = F.slice("turns", 1, 0)
    return joined.select("conv", F.concat(F.slice(F.coalesce("head", empty), F.lit(1), h),
                                          F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))).alias("turns"))


def _chain(batches):
    """Names of all prefixes of each sequence, the empty one first."""
    for batch in batches:
        ids, keys, words = [], [], []
        for conv, turns in zip(batch.column("conv").to_pylist(), batch.column("turns").to_pylist()):
            name, names = bytes(16), [bytes(16)]
            for t in turns:
                name = hashlib.blake2b(name + t["digest"], digest_size=16).digest()
                names.append(name)
            ids.append(conv)
            keys.append(names)
            words.append([0, *(t["words"] for t in turns)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(keys, pa.list_(pa.binary())), pa.array(words, pa.list_(pa.int32()))],
            ["conv", "keys", "words"])


def _hash_ends(batches):
    """Ids of each end list as a stream of blocks in order; only the hash is held."""
    name, digest = None, None
    for batch in batches:
        done = []
        for key, part in zip(batch.column("key").to_pylist(), batch.column("part").to_pylist()):
            if key != name:
                if name is not None:
                    done.append((name, digest.hexdigest()))
                name, digest = key, hashlib.sha256(part.encode())
            else:
                digest.update(b"," + part.encode())
        yield _ends(done)
    if name is not None:
        yield _ends([(name, digest.hexdigest())])


def _ends(done):
    return pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], ["key", "ends_sha256"])


def _end_lists(named: DataFrame) -> DataFrame:
    """``key, ends_sha256``: the hash of the ascending ids of the conversations that end
    at a node. Blocks of ids are joined to texts wherever; the last step of a very common
    end reads a row per block."""
    block = F.floor(F.col("conv") / END_BLOCK)
    ids = F.array_sort(F.collect_list("conv"))
    parts = named.groupBy("key", block.alias("block")).agg(
        F.array_join(F.transform(ids, lambda c: c.cast("string")), ",").alias("part"))
    return parts.repartition("key").sortWithinPartitions("key", "block").mapInArrow(
        _hash_ends, "key binary, ends_sha256 string")


def trie(rebuilt: DataFrame) -> DataFrame:
    """The nodes of the trie over ``conv, turns`` (see ``sequences``), all numbers long:
    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.

    A conversation without turns is a member of the root alone. Ids that occur once only
    are expected; without conversations there is no node, not even a root.
    """
    chained = settle(rebuilt.mapInArrow(_chain, "conv long, keys array<binary>, words array<int>")
                     .withColumn("key", F.element_at("keys", -1)), "chains")
    # whole sequences, collapsed
    grouped = chained.groupBy("key").agg(F.count("*").alias("weight"), F.min("conv").alias("conv"))
    ends = _end_lists(chained.select("key", "conv"))
    whole = settle(grouped.join(chained.drop("key"), "conv").join(ends, "key"), "sequences")
    # leaves: no proper prefix of another sequence
    inner = whole.select(F.explode(F.slice("keys", 1, F.size("keys") - 1)).alias("key")).distinct()
    leaves = whole.select("key").join(inner, "key", "left_anti").select("key", F.lit(1).alias("leaf"))
    weighted = settle(whole.join(leaves, "key", "left"), "weighted")
    along = weighted.select("conv", "weight", "leaf", "keys", "words", F.posexplode("keys").alias("depth", "node"))
    met = along.select("node", "depth", "conv", "weight", F.coalesce("leaf", F.lit(0)).alias("leaf"),
                       F.when(F.col("depth") > 0, F.element_at("keys", F.greatest("depth", F.lit(1)))).alias("parent"),
                       F.element_at("words", F.col("depth") + 1).alias("words"))
    nodes = settle(met.groupBy("node").agg(
        F.min("conv").alias("conv"), F.first("depth").alias("depth"), F.first("parent").alias("parent"),
        F.first("words").alias("words"), F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves")), "nodes")
    # what a sequence's own nodes save, summed from the end of its path
    own = nodes.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct(
        "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("saved")))).alias("own"))
    paths = weighted.select("conv", "keys").join(own, "conv").mapInArrow(_path_sums, "node binary, saved long")
    saved = paths.groupBy("node").agg(F.sum("saved").alias("saved_tokens"))
    children = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(
        F.count("*").alias("n_children"))
    # the parent of a sequence's other nodes is its own; only its first one looks it up
    first = nodes.groupBy("conv").agg(F.min_by(F.struct("node", "parent"), "depth").alias("f")).select("f.*").where("parent is not null")
    looked_up = salted_join(first, nodes.select(F.col("node").alias("parent"), F.col("conv").alias("above")), ["parent"], "inner")
    all_of = (nodes.join(saved, "node").join(children, "node", "left")
              .join(whole.select(F.col("key").alias("node"), "ends_sha256"), "node", "left")
              .join(looked_up.select("node", "above"), "node", "left"))
    none = F.sha2(F.lit("").cast("binary"), 256)
    zero = F.lit(0).cast("long")
    return all_of.select(
        F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"),
        F.when(F.col("depth") > 0, F.coalesce("above", "conv")).alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", none).alias("ends_sha256"))


def _path_sums(batches):
    """For every prefix of a sequence: what the nodes it owns from there on save."""
    for batch in batches:
        nodes, saved = [], []
        for keys, own in zip(batch.column("keys").to_pylist(), batch.column("own").to_pylist()):
            total, sums = 0, [0] * len(keys)
            at = {x["depth"]: x["saved"] for x in own}
            for d in range(len(keys) - 1, -1, -1):
                total += at.get(d, 0)
                sums[d] = total
            nodes += keys
            saved += sums
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(saved, pa.int64())], ["node", "saved"])

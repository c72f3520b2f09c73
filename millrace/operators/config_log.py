"""The versioned log of topic configuration updates.

Each org's configuration starts at version 0; an accepted update adds one, and an
update that expects another version than the current one is refused. Whether it is
accepted depends on every decision before it, yet no task reads an org's whole log:

1. The log is cut into chunks along (org, seq). A chunk is a function from the version
   before it to the version after it. It moves almost every version by the same amount,
   the number of its unconditional updates; the others are listed: at most one for each
   expected version.
2. Versions are counted without the unconditional updates, so a chunk leaves all but
   its listed versions alone. A listed version of one chunk points at the next chunk
   that lists its result. The chunks that an org's version passes through are the path
   from version 0, found by pointer doubling over these links.
3. With the version before each chunk known, all chunks are decided at the same time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..session import cut_lineage

# fixed value: the version of an org without updates
INITIAL_VERSION = 0

CHUNK = 100_000   # updates of a chunk


def chunk_moves(expected: list[int | None]) -> tuple[int, dict[int, int]]:
    """A chunk as a function of the version before it: the number of unconditional
    updates, by which every version grows, and the versions that grow by more, with
    what they become (both counted without the unconditional updates)."""
    shift, at, home, known = 0, {}, {}, {}

    def find(x: int) -> int:
        while home[x] != x:
            home[x] = home[home[x]]
            x = home[x]
        return x

    def meet(version: int) -> int | None:
        """Starts that are at this version now, as one representative."""
        if version not in home:
            home[version], known[version], at[version] = version, version, version
        return at.get(version)

    for e in expected:
        if e is None:
            shift += 1
            continue
        here = meet(e - shift)
        if here is None:
            continue   # all that were at this version have moved on
        there = meet(e - shift + 1)
        del at[e - shift]
        if there is not None:
            home[here] = there
            here = there
        at[e - shift + 1] = here
        known[here] = e - shift + 1
    ends = {s: known[find(s)] for s in home}
    return shift, {s: v for s, v in ends.items() if v != s}


def _summaries(batches):
    """Functions of the two orgs that a chunk may share with its neighbours: its first
    and its last. All others lie in the chunk as a whole."""
    import pyarrow as pa
    chunk, first, org, expected = None, None, None, []

    def rows(name, chunk, expected):
        shift, moves = chunk_moves(expected)
        out = [(name, chunk, shift, None, None)] + [(name, chunk, None, s, e) for s, e in moves.items()]
        cols = list(zip(*out))
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                          names=["org", "chunk", "shift", "before", "after"])

    for batch in batches:
        for c, name, expect in zip(*(batch.column(x).to_pylist() for x in ("chunk", "org", "expect"))):
            if chunk is None:
                chunk, first, org = c, name, name
            if name != org:
                if org == first:
                    yield rows(org, chunk, expected)
                org, expected = name, []
            expected.append(expect)
    if chunk is not None:
        yield rows(org, chunk, expected)


def _decide(batches):
    """Decide a chunk's updates in order, from the version that each org has before."""
    import pyarrow as pa
    place, version = None, INITIAL_VERSION
    for batch in batches:
        versions, flags = [], []
        for *now, before, expect in zip(*(batch.column(c).to_pylist() for c in ("chunk", "org", "before", "expect"))):
            if now != place:
                place, version = now, before
            ok = expect is None or expect == version
            version += ok
            versions.append(version)
            flags.append(ok)
        keep = [i for i, n in enumerate(batch.schema.names) if n not in ("chunk", "before")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in keep), pa.array(versions, pa.int64()), pa.array(flags, pa.bool_())],
            names=[*(batch.schema.names[i] for i in keep), "version", "accepted"])


def _path(links: DataFrame) -> DataFrame:
    """The links that a version of 0 before an org's first chunk passes through.
    ``links``: org, chunk, before, after; each points at the next chunk of its org that
    lists what it results in."""
    # per version of an org, a row per chunk at most on either side
    results = links.select("org", "chunk", F.col("after").alias("version"), F.lit(1).alias("asks")).distinct()
    listed = links.select("org", "chunk", F.col("before").alias("version"), F.lit(0).alias("asks"))
    later = W.partitionBy("org", "version").orderBy(F.desc("chunk"), F.desc("asks")).rowsBetween(W.unboundedPreceding, -1)
    following = results.unionByName(listed).withColumn(
        "next", F.last(F.when(F.col("asks") == 0, F.col("chunk")), ignorenulls=True).over(later)).where("asks = 1")
    jumps = cut_lineage(
        links.join(following.select("org", "chunk", F.col("version").alias("after"), "next"), ["org", "chunk", "after"])
        .where("next is not null").select("org", "chunk", "before", "next", F.col("after").alias("at")))
    first = links.where(F.col("before") == INITIAL_VERSION).groupBy("org").agg(F.min("chunk").alias("chunk"))
    path = cut_lineage(first.withColumn("before", F.lit(INITIAL_VERSION).cast("long")))
    while not jumps.isEmpty():
        # the path doubles with every round, the links jump twice as far
        step = path.join(jumps, ["org", "chunk", "before"]).select("org", F.col("next").alias("chunk"), F.col("at").alias("before"))
        path = cut_lineage(path.unionByName(step).distinct())
        far = jumps.select("org", F.col("chunk").alias("next"), F.col("before").alias("at"),
                           F.col("next").alias("next2"), F.col("at").alias("at2"))
        jumps = cut_lineage(jumps.join(far, ["org", "next", "at"]).select(
            "org", "chunk", "before", F.col("next2").alias("next"), F.col("at2").alias("at")))
    return path.join(links, ["org", "chunk", "before"])


def _versions_before(summaries: DataFrame) -> DataFrame:
    """``org, chunk, before``: the version before each chunk that an org shares."""
    in_order = W.partitionBy("org").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    shifts = summaries.where("shift is not null").select(
        "org", "chunk", F.coalesce(F.sum("shift").over(in_order), F.lit(0)).alias("offset"))
    links = summaries.where("before is not null").join(shifts, ["org", "chunk"]).select(
        "org", "chunk", (F.col("before") - F.col("offset")).alias("before"), (F.col("after") - F.col("offset")).alias("after"))
    path = _path(cut_lineage(links))
    reached = shifts.join(path.select("org", "chunk", "after"), ["org", "chunk"], "left")
    last = F.last("after", ignorenulls=True).over(in_order)
    return reached.select("org", "chunk", (F.coalesce(last, F.lit(INITIAL_VERSION)) + F.col("offset")).alias("before"))


def apply_config(updates: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Add the version after each update and whether it was accepted. Updates:
    ``org, seq, topic, action, expect, config``; a null topic is the default."""
    out = T.StructType(updates.schema.fields + [
        T.StructField("version", T.LongType()), T.StructField("accepted", T.BooleanType())])
    chunks = max(1, -(-updates.count() // chunk))
    # cut by range and kept, so that the same chunks are summed up and decided
    placed = cut_lineage(updates.repartitionByRange(chunks, "org", "seq").sortWithinPartitions("org", "seq")
                         .withColumn("chunk", F.spark_partition_id().cast("long")))
    summaries = cut_lineage(placed.select("chunk", "org", "expect").mapInArrow(
        _summaries, "org string, chunk long, shift long, before long, after long"))
    before = _versions_before(summaries).withColumnRenamed("org", "_org").withColumnRenamed("chunk", "_chunk")
    same = F.col("org").eqNullSafe(F.col("_org")) & (F.col("chunk") == F.col("_chunk"))
    known = placed.join(before, same, "left").drop("_org", "_chunk").withColumn(
        "before", F.coalesce("before", F.lit(INITIAL_VERSION)))
    return (known.repartition("chunk").sortWithinPartitions("chunk", "org", "seq").mapInArrow(_decide, out))


def latest_config(applied: DataFrame) -> DataFrame:
    """The configuration in force: the last accepted update per org and topic,
    unless it was a delete."""
    rest = [c for c in applied.columns if c not in ("org", "topic")]
    return (applied.where("accepted").groupBy("org", "topic")
            .agg(F.max_by(F.struct(*rest), "seq").alias("u"))
            .select("org", "topic", "u.*").where("action <> 'delete'"))

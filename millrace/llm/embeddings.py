"""Near-duplicate embeddings by spherical-cap filters (Becker et al., 2016).

A filter is a direction; a vector belongs to a filter if its cosine with the
direction exceeds a threshold (it lies in the cap). Similar vectors share caps far
more often than others. Directions are all pairs from two small random codes, one
for each half of the coordinates, so the filters of a vector are list-decoded: with
the scores against both codes sorted, the pairs above the threshold are read off
without looking at the others.

The threshold follows the number of vectors and the exact law of cosines in their
dimension, so that a cap holds about ``CAP`` vectors of random direction; in few
dimensions, where so small a cap would part the pairs sought, it stays wider. The
number of directions starts from ``SHARED``, the caps that two vectors at the
similarity limit share on average, and is raised until ``RECALL`` of random pairs at
the limit share a cap of the codes in use. Codes are turned at random, so any pair is
as a random one, whatever coordinates its length lies in. Then vectors are joined on
filters and every pair that meets is verified by its exact cosine.

Equal vectors are one node. Caps are cut into blocks of ``BLOCK`` nodes and verified
block by block, so a cap of any size is many tasks. A task returns, for each node, how
many links it found and one link to its group there: never the pairs themselves.

A pair that shares several filters belongs to the smallest of them. Only the vectors
move; a task decodes anew those that have a near one, and takes off the pairs that share
a smaller filter by products of 0/1 matrices, the most frequent filters first, so a
cluster of near copies costs one product in nearly all its caps. Decoding is exact (whole
numbers in doubles), so all tasks agree on a vector's filters.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import salted_join
from .common import settle
from .components import components

CAP = 256        # unrelated vectors in a cap, on average
SHARED = 14.0    # caps shared, on average, by two vectors at the limit, at least
RECALL = 0.99    # of random pairs at the limit that share a cap, at least
FOLLOW = 0.1     # of a vector's caps that hold a vector at the limit, at least
TRIALS = 2000    # random pairs that a plan is tried on
LEAST_DIM = 16   # shorter vectors are filtered as if zeros followed
BLOCK = 1024
GRID = 1 << 20   # coordinates are decoded as whole numbers of this part of the length
COLUMNS = 256    # filters compared at a time
SEED = 7


def _tails(t: float, limit: float, dim: int) -> tuple[float, float]:
    """Chance that a random direction's cosine with a vector is at least t, and that both
    its cosines with two vectors at the limit are: the law of one coordinate of the
    sphere, then, of what is left, of a coordinate of the sphere one dimension lower."""
    angle = np.linspace(0.0, math.pi, 20_001)
    # density sin^(dim - 2) of the angle to an axis
    weight = np.sin(angle) ** (dim - 2)
    own = angle[angle <= math.acos(max(-1.0, min(1.0, t)))]
    share = float(weight[:len(own)].sum() / weight.sum())
    lower = np.sin(angle) ** (dim - 3)
    within = np.cumsum(lower) / lower.sum()   # chance of an angle up to this one
    spread = math.sqrt(max(0.0, 1 - limit * limit))
    need, room = t - limit * np.cos(own), spread * np.sin(own)
    least = np.where(room > 1e-12, need / np.maximum(room, 1e-12), np.where(need <= 0, -2.0, 2.0))
    chance = np.where(least > 1, 0.0, np.interp(np.arccos(np.clip(least, -1, 1)), angle, within))
    return share, float((weight[:len(own)] * chance).sum() / weight.sum())


def plan(count: int, limit: float, dim: int, cap: int = CAP, shared: float = SHARED,
         seed: int = SEED) -> tuple[float, int]:
    """The least cosine with a direction that puts a vector in its cap, and the number of
    directions in each of the two codes, for ``count`` vectors of this length."""
    whole = max(dim, LEAST_DIM)
    wanted = min(0.25, max(cap / max(count, 1), 1e-12))
    low, high = -1.0, 1.0
    for _ in range(40):
        t = (low + high) / 2
        share, both = _tails(t, limit, whole)
        low, high = (t, high) if share > wanted and both >= FOLLOW * share else (low, t)
    t = low
    while True:
        least = max(2, math.ceil(math.sqrt(shared / max(_tails(t, limit, whole)[1], 1e-12))))
        size = least
        while size <= 4 * least:
            if recall(t, size, limit, dim, seed) >= RECALL:
                return t, size
            size = max(size + 1, math.ceil(1.1 * size))
        t -= 0.05   # wider caps, where more of them do not help


def recall(t: float, size: int, limit: float, dim: int, seed: int = SEED, pairs: int = TRIALS) -> float:
    """Share of random pairs at the limit that share a cap; with one coordinate, where the
    only pairs are parallel, of those."""
    draw = np.random.default_rng([seed, dim, pairs])
    one = _scaled(draw.standard_normal((pairs, dim)))
    two = one
    if dim > 1:
        way = draw.standard_normal((pairs, dim))
        way = _scaled(way - (way * one).sum(axis=1, keepdims=True) * one)
        two = limit * one + math.sqrt(max(0.0, 1 - limit * limit)) * way
    codes = _codes(dim, size, seed)
    first, second = decode(one, t, codes), decode(two, t, codes)
    return float(np.mean([len(np.intersect1d(a, b, assume_unique=True)) > 0
                          for a, b in zip(first, second, strict=True)]))


def _codes(dim: int, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The two codes, each direction a column, turned by one random rotation, on the grid."""
    whole = max(dim, LEAST_DIM)
    draw = np.random.default_rng([seed, whole, size])
    half = whole - whole // 2
    turn = np.linalg.qr(draw.standard_normal((whole, whole)))[0][:dim]
    halves = []
    for part in (turn[:, :half], turn[:, half:]):
        code = draw.standard_normal((size, part.shape[1]))
        halves.append(np.rint(GRID * (part @ (code / np.linalg.norm(code, axis=1, keepdims=True)).T)))
    return halves[0], halves[1]


def decode(unit: np.ndarray, t: float, codes: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """For each unit vector the sorted numbers of the filters it belongs to. On the grid
    products and their sums are whole numbers below 2^53: the same in any batch."""
    size = codes[0].shape[1]
    need = math.ceil(t * math.sqrt(2) * GRID * GRID)   # directions are pairs divided by the root of two
    unit = np.rint(GRID * unit)
    found = []
    rows = max(1, 1_000_000 // size)
    for at in range(0, len(unit), rows):
        x, y = unit[at:at + rows] @ codes[0], unit[at:at + rows] @ codes[1]
        order = np.argsort(y, axis=1)
        for a, b, by in zip(x, y, order, strict=True):
            b = b[by]
            i = np.flatnonzero(a + b[-1] >= need)
            least = np.searchsorted(b, need - a[i])
            many = size - least
            first = np.repeat(i, many)
            step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            found.append(np.sort(first * size + by[np.repeat(least, many) + step]))
    return found


def _nodes(kind):
    """Id, node and vector (packed as ``kind``) of every row; node and vector are null
    where a vector links with nothing."""
    def run(batches):
        for batch in batches:
            node, packed = [], []
            for v in batch.column(1).to_pylist():
                x = None if v is None or None in v else np.array(v, dtype=kind)
                if x is None or not len(x) or not np.isfinite(x).all() or not x.any():
                    node.append(None)
                    packed.append(None)
                    continue
                raw = (x + 0).tobytes()   # so that -0.0 is 0.0
                node.append(int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True))
                packed.append(raw)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(node, pa.int64()), pa.array(packed, pa.binary())], ["vec_id", "node", "vector"])
    return run


def _scaled(x: np.ndarray) -> np.ndarray:
    """Vectors of length one, in doubles, without overflow on the way."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _unpacked(vectors: list[bytes], kind: str, dim: int) -> np.ndarray:
    return _scaled(np.frombuffer(b"".join(vectors), dtype=kind).reshape(-1, dim))


def _filters(plans, seed, kind, step=256):
    """One row for each vector and filter that it belongs to."""
    width = np.dtype(kind).itemsize

    def run(batches):
        codes = {}
        for batch in batches:
            rows = {}
            for i, raw in enumerate(batch.column("vector").to_pylist()):
                rows.setdefault(len(raw) // width, []).append((i, raw))
            for dim, whole in rows.items():
                t, size = plans[dim]
                if dim not in codes:
                    codes[dim] = _codes(dim, size, seed)
                for at in range(0, len(whole), step):
                    held = whole[at:at + step]
                    found = decode(_unpacked([r for _, r in held], kind, dim), t, codes[dim])
                    many = np.array([len(f) for f in found])
                    take = pa.array(np.repeat(np.array([i for i, _ in held]), many))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(int(many.sum()), dim, dtype=np.int32)), pa.array(np.concatenate(found)),
                         batch.column("node").take(take), batch.column("copies").take(take),
                         batch.column("vector").take(take)],
                        ["dim", "filter", "node", "copies", "vector"])
    return run


def _drop_owned(near: np.ndarray, filters: list[np.ndarray], this: int) -> None:
    """Take pairs off ``near`` that share a filter smaller than ``this``."""
    earlier = [f[f < this] for f in filters]
    row = np.repeat(np.arange(len(earlier)), [len(f) for f in earlier])
    _, column, many = np.unique(np.concatenate(earlier), return_inverse=True, return_counts=True)
    place = np.empty(len(many), dtype=np.int64)
    place[np.argsort(-many, kind="stable")] = np.arange(len(many))
    column = place[column]
    shared = int((many > 1).sum())
    for at in range(0, shared, COLUMNS):
        held = (column >= at) & (column < min(at + COLUMNS, shared))
        has = np.zeros((len(earlier), COLUMNS), dtype=np.float32)
        has[row[held], column[held] - at] = 1
        near &= has @ has.T < 0.5
        if not near.any():
            return


def _groups(near: np.ndarray) -> np.ndarray:
    """The first member of each one's group."""
    group = np.full(len(near), -1)
    for start in range(len(near)):
        if group[start] < 0:
            front = np.array([start])
            while len(front):
                group[front] = start
                front = np.flatnonzero(near[front].any(axis=0) & (group < 0))
    return group


def _verify(limit, plans, seed, kind):
    """Links within one cell: a block of a cap with itself or with another block."""
    codes = {}

    def run(key, rows):
        dim, this, i, j = (k.as_py() for k in key)
        node, copies = rows.column("node").to_numpy(), rows.column("copies").to_numpy()
        unit = _unpacked(rows.column("vector").to_pylist(), kind, dim)
        near = unit @ unit.T >= limit
        np.fill_diagonal(near, False)
        if i != j:
            side = rows.column("block").to_numpy()
            near &= side[:, None] != side[None, :]
        met = np.flatnonzero(near.any(axis=1))
        near = near[np.ix_(met, met)]
        if len(met):
            t, size = plans[dim]
            if dim not in codes:
                codes[dim] = _codes(dim, size, seed)
            _drop_owned(near, decode(unit[met], t, codes[dim]), this)
        left = np.flatnonzero(near.any(axis=1))
        met, near = met[left], near[np.ix_(left, left)]
        return pa.table({"node": pa.array(node[met]), "links": pa.array(near @ copies[met], pa.int64()),
                         "other": pa.array(node[met[_groups(near)]], pa.int64())})
    return run


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", limit: float = 0.9,
                    cap: int = CAP, shared: float = SHARED, seed: int = SEED) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per input row.

    Two rows link if their cosine, in double precision, is at least ``limit`` and they
    were found to share a filter; equal vectors are always found. Null, empty or zero
    vectors and those with null or non-finite components link with nothing, and vectors
    link only with others of their length. ``component_id`` is the smallest vec_id
    reachable by links (a null vec_id is never the smallest unless all are null);
    ``kept`` says that it is the own. Repeated rows, also under the same id, link with
    each other. Other columns are not read. An empty table gives no rows.
    """
    element = vectors.select(embedding).schema[0].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"   # floats are whole in four bytes
    own = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    id_type = own.schema["vec_id"].dataType.simpleString()
    rows = settle(own.mapInArrow(_nodes(kind), f"vec_id {id_type}, node long, vector binary"), "vectors")
    nodes = rows.where("node is not null").groupBy("node").agg(
        F.count("*").alias("copies"), F.first("vector").alias("vector"))
    nodes = settle(nodes, "nodes")
    dim = (F.octet_length("vector") / np.dtype(kind).itemsize).cast("int").alias("dim")
    counts = nodes.groupBy(dim).agg(F.count("*").alias("n")).collect()
    plans = {c["dim"]: plan(c["n"], limit, c["dim"], cap, shared, seed) for c in counts}
    caps = settle(nodes.mapInArrow(
        _filters(plans, seed, kind), "dim int, filter long, node long, copies long, vector binary"), "caps")
    # written, so that its size is known when the join is planned
    large = settle(caps.groupBy("dim", "filter").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
                   .select("dim", "filter", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "large")
    blocks = F.coalesce("blocks", F.lit(1))
    cells = (caps.join(large, ["dim", "filter"], "left")
             .withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
             .withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}))
    cell = ["dim", "filter", "i", "j"]
    # the blocks of a cap are dealt, too: a grouping alone would be content with the join's deal by cap
    found = settle(cells.select(*cell, "block", "node", "copies", "vector").repartition(*cell)
                   .groupBy(*cell).applyInArrow(_verify(limit, plans, seed, kind), "node long, links long, other long"), "found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    group = components(found, "node", "other")
    named = settle(rows.select("vec_id", "node").join(nodes.select("node", "copies"), "node", "left")
                   .join(links, "node", "left").join(group, "node", "left")
                   .withColumn("root", F.coalesce("root", "node")), "named")
    least = named.where("root is not null").groupBy("root").agg(F.min("vec_id").alias("least"))
    out = salted_join(named, least, ["root"])
    component = F.when(F.col("root").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return out.select(
        "vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("n_links"),
        component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))

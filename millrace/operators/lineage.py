"""Task graph: edges through queues, tasks on cycles, one cycle per org.

The searches run on the two-sided graph task -> queue -> task. It has one edge
per declared input or output, so a queue with many writers and readers never
turns into all their pairs. Orgs whose graph fits a task, by a checked number
of edges, are searched in one grouped pass.

Larger ones are searched by joins over the edge list, in rounds. First what needs no
search goes: nodes without a way in or out, and chains, that is runs of nodes with one
way in and one way out. A chain of any length becomes one edge by pointer doubling; a
chain that closes on itself is a cycle found. What stays is searched forward and backward
from many nodes at once; the groups found go, and so on until nothing is left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .skew import hot_keys, salted_join
from .smallgraph import cyclic_groups, shortest_return

# an org's graph up to this many edges is searched inside one task
SMALL_EDGES = 200_000
# rows of one key that a task takes without salting
FEW = 10_000


def _spread_join(many: DataFrame, one: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join with at most one row of ``one`` per key, salted where a key needs it."""
    hot = cut_lineage(hot_keys(many, keys, least=FEW))
    return many.join(one, keys) if hot.isEmpty() else salted_join(many, one, keys, "inner", hot=hot)


def edges(tasks: DataFrame) -> DataFrame:
    """Task pairs A -> B where an output queue of A is an input queue of B; the
    pairs themselves are the result asked for."""
    writes = tasks.select("org", F.col("task").alias("src"), F.explode("outputs").alias("queue"))
    reads = tasks.select("org", F.col("task").alias("dst"), F.explode("inputs").alias("queue"))
    return writes.join(reads, ["org", "queue"]).select("org", "src", "dst").distinct()


def hops(tasks: DataFrame) -> DataFrame:
    """Two-sided edges ``org, src, dst`` with nodes ``t:<task>`` and ``q:<queue>``."""
    task = F.concat(F.lit("t:"), F.col("task"))
    queue = F.concat(F.lit("q:"), F.col("queue"))
    out = tasks.select("org", "task", F.explode("outputs").alias("queue")).select(
        "org", task.alias("src"), queue.alias("dst"))
    into = tasks.select("org", "task", F.explode("inputs").alias("queue")).select(
        "org", queue.alias("src"), task.alias("dst"))
    return out.unionByName(into).distinct()


class _Graph:
    """An edge list and the few nodes that own a large share of its starts or
    ends. Edges are only ever removed, so the two lists are made once."""

    def __init__(self, edges: DataFrame, hot: dict[str, DataFrame | None] | None = None):
        self.edges = cut_lineage(edges)
        self.hot = hot or {on: self._hot(on) for on in ("src", "dst")}

    def _hot(self, on: str) -> DataFrame | None:
        hot = cut_lineage(hot_keys(self.edges, ["org", on], least=FEW))
        return None if hot.isEmpty() else hot

    def join(self, nodes: DataFrame, on: str, how: str, edges: DataFrame | None = None) -> DataFrame:
        edges = self.edges if edges is None else edges
        side = nodes.withColumnRenamed("node", on)
        if self.hot[on] is None:
            return edges.join(side, ["org", on], how)
        return salted_join(edges, side, ["org", on], how, hot=self.hot[on])

    def replace(self, edges: DataFrame) -> "_Graph":
        return _Graph(edges, self.hot)

    def without(self, nodes: DataFrame) -> "_Graph":
        nodes = nodes.select("org", "node")
        rest = self.join(nodes, "src", "left_anti")
        return self.replace(self.join(nodes, "dst", "left_anti", rest))

    def within(self, nodes: DataFrame) -> "_Graph":
        nodes = nodes.select("org", "node")
        rest = self.join(nodes, "src", "left_semi")
        return self.replace(self.join(nodes, "dst", "left_semi", rest))

    def ends(self, on: str) -> DataFrame:
        return self.edges.select("org", F.col(on).alias("node")).distinct()

    def nodes(self) -> DataFrame:
        """Every node with its ways in and out and whether one leads to itself."""
        def side(on: str, i: int, o: int) -> DataFrame:
            own = F.col("src") == F.col("dst")
            return self.edges.select("org", F.col(on).alias("node"), own.alias("own"),
                                     F.when(own, 0).otherwise(i).alias("i"), F.when(own, 0).otherwise(o).alias("o"))
        return side("src", 0, 1).unionByName(side("dst", 1, 0)).groupBy("org", "node").agg(
            F.sum("i").alias("ways_in"), F.sum("o").alias("ways_out"), F.bool_or("own").alias("own"))

    def greatest_color(self) -> DataFrame:
        """Each node with the greatest node name that reaches it."""
        colors = self.ends("src").unionByName(self.ends("dst")).distinct().withColumn("color", F.col("node"))
        while True:
            offered = self.join(colors, "src", "inner").select("org", F.col("dst").alias("node"), "color")
            merged = cut_lineage(
                colors.withColumn("old", F.col("color"))
                .unionByName(offered.withColumn("old", F.lit(None).cast("string")))
                .groupBy("org", "node").agg(F.max("color").alias("color"), F.max("old").alias("old")))
            colors = merged.drop("old")
            if merged.where("color <> old").isEmpty():
                return colors


def by_size(graph: DataFrame, small_edges: int) -> tuple[DataFrame, DataFrame | None]:
    """Split a graph into orgs of at most ``small_edges`` edges, each of which a
    task can search by itself, and the larger ones (null when there are none)."""
    sizes = graph.groupBy("org").agg(F.count("*").alias("n"))
    large = cut_lineage(sizes.where(F.col("n") > small_edges).select("org"))
    if large.isEmpty():
        return graph, None
    return (salted_join(graph, large, ["org"], "left_anti"),
            salted_join(graph, large, ["org"], "left_semi"))


def _groups_in_task(edges_of_org):
    import pyarrow as pa
    cols = edges_of_org.to_pydict()
    named = cyclic_groups(cols["src"], cols["dst"])
    text = lambda values: pa.array(values, pa.string())
    return pa.table({"org": text([cols["org"][0]] * len(named)),
                     "grp": text(list(named.values())), "node": text(list(named))})


def cycle_groups(tasks: DataFrame, small_edges: int = SMALL_EDGES) -> DataFrame:
    """``org, grp, node``: the strongly connected groups of more than one node,
    each under the name of its greatest node."""
    small, large = by_size(hops(tasks), small_edges)
    found = small.groupBy("org").applyInArrow(_groups_in_task, "org string, grp string, node string")
    return found if large is None else found.unionByName(_large_groups(large))


def _follow_chains(inner: DataFrame, from_inner: DataFrame) -> DataFrame:
    """``org, node, last, end, top, inside`` for the nodes inside chains: the last node of
    the chain, where its edge leads and the greatest name on the way. Pointers that meet
    another inner node jump on by that one's pointer and so are twice as long after each
    round. Those of a closed chain stay ``inside``; they are done when no ``top`` rises."""
    ends = inner.select("org", F.col("node").alias("end"), F.lit(True).alias("inside"))
    jumps = cut_lineage(from_inner.select(
        "org", F.col("src").alias("node"), F.col("src").alias("last"), F.col("dst").alias("end"), F.col("src").alias("top"))
        .join(ends, ["org", "end"], "left").withColumn("inside", F.coalesce("inside", F.lit(False))))
    left = None
    while True:
        ahead = jumps.select("org", F.col("node").alias("end"), F.col("last").alias("last2"), F.col("end").alias("end2"),
                             F.col("top").alias("top2"), F.col("inside").alias("inside2"))
        on = jumps.where("inside").join(ahead, ["org", "end"]).select(
            "org", "node", F.col("last2").alias("last"), F.col("end2").alias("end"),
            F.greatest("top", "top2").alias("top"), F.col("inside2").alias("inside"), (F.col("top2") > F.col("top")).alias("rose"))
        jumps = cut_lineage(on.unionByName(jumps.where("not inside").withColumn("rose", F.lit(False))))
        now, rose = jumps.agg(F.count_if("inside"), F.count_if(F.col("inside") & F.col("rose"))).first()
        # open chains lose nodes in every round: with none lost only closed ones are left
        if now == 0 or (now == left and rose == 0):
            return jumps
        left = now


def _contract(graph: _Graph) -> tuple[_Graph, DataFrame, DataFrame] | None:
    """The graph with its chains as single edges and without closed ones; the closed
    chains (``org, grp, node``); and the nodes inside the others, each with the ends of
    its chain (``org, node, src, dst``). None when there is no chain."""
    inner = cut_lineage(graph.nodes().where("ways_in = 1 and ways_out = 1 and not own").select("org", "node"))
    if inner.isEmpty():
        return None
    jumps = _follow_chains(inner, graph.join(inner, "src", "left_semi"))
    closed = jumps.where("inside").select("org", F.col("top").alias("grp"), "node")
    rest = graph.join(inner, "src", "left_anti")
    heads = graph.join(inner, "dst", "left_semi", rest).withColumnRenamed("dst", "node")
    chains = cut_lineage(heads.join(jumps, ["org", "node"]).select("org", "src", F.col("end").alias("dst"), "last"))
    members = cut_lineage(jumps.where("not inside").select("org", "node", "last").join(chains, ["org", "last"])
                          .select("org", "node", "src", "dst"))
    direct = graph.join(inner, "dst", "left_anti", rest)
    return graph.replace(direct.unionByName(chains.select("org", "src", "dst")).distinct()), closed, members


def _search(graph: _Graph) -> tuple[DataFrame, DataFrame]:
    """Strongly connected nodes by colors: nodes take the greatest name that reaches
    them; the nodes of one color that can reach its owner are the owner's group. Returns
    ``org, color, node`` of all groups and of those that are cycles."""
    colors = graph.greatest_color()
    one_color = graph.join(colors.withColumnRenamed("color", "a"), "src", "inner")
    one_color = graph.join(colors.withColumnRenamed("color", "b"), "dst", "inner", one_color)
    same = graph.replace(one_color.where("a = b").select("org", "src", "dst", F.col("a").alias("color")))
    group = cut_lineage(colors.where("color = node"))
    n = group.count()
    while True:
        step = same.join(group.select("org", "node"), "dst", "inner").select(
            "org", F.col("src").alias("node"), "color")
        group = cut_lineage(group.unionByName(step).distinct())
        n, before = group.count(), n
        if n == before:
            break
    own = graph.edges.where("src = dst").select("org", F.col("src").alias("color"))
    cyclic = group.groupBy("org", "color").agg(F.count("*").alias("n")).where("n > 1").select("org", "color").unionByName(own).distinct()
    return group, group.join(cyclic, ["org", "color"], "left_semi")


def _large_groups(graph_edges: DataFrame) -> DataFrame:
    """The same by rounds over the distributed edge list."""
    graph, inside = _Graph(graph_edges), []
    found = [graph_edges.limit(0).select("org", F.col("src").alias("grp"), F.col("src").alias("node"))]
    while not graph.edges.isEmpty():
        contracted = _contract(graph)
        if contracted:
            graph, closed, members = contracted
            found.append(closed)
            inside.append(members)
        loose = cut_lineage(graph.nodes().where("ways_in = 0 or ways_out = 0"))
        if not loose.isEmpty():
            # alone but for a chain from itself to itself
            found.append(loose.where("own").select("org", F.col("node").alias("grp"), "node"))
            graph = graph.without(loose)
        elif not contracted:
            group, cyclic = _search(graph)
            found.append(cyclic.select("org", F.col("color").alias("grp"), "node"))
            graph = graph.without(group)
    groups = cut_lineage(reduce(DataFrame.unionByName, found))
    for members in reversed(inside):
        # a chain lies on a cycle if both its ends lie on one
        ends = _spread_join(members, groups.select("org", F.col("node").alias("src"), "grp"), ["org", "src"])
        both = _spread_join(ends, groups.select("org", F.col("node").alias("dst"), F.col("grp").alias("grp2")), ["org", "dst"])
        groups = cut_lineage(groups.unionByName(both.where("grp = grp2").select("org", "grp", "node")))
    names = groups.groupBy("org", "grp").agg(F.max("node").alias("name"))
    return _spread_join(groups, names, ["org", "grp"]).select("org", F.col("name").alias("grp"), "node")


def _task_name(node: Column) -> Column:
    return F.regexp_replace(node, "^t:", "")


def cycles(tasks: DataFrame, small_edges: int = SMALL_EDGES) -> DataFrame:
    """Every task that lies on a cycle of its org's graph."""
    return (cycle_groups(tasks, small_edges).where(F.col("node").startswith("t:"))
            .select("org", _task_name(F.col("node")).alias("task")))


def _return_in_task(edges_of_org):
    import pyarrow as pa
    cols = edges_of_org.to_pydict()
    path = shortest_return(cols["src"], cols["dst"], cols["start"][0])
    return pa.table({"org": pa.array([cols["org"][0]], pa.string()),
                     "path": pa.array([path], pa.list_(pa.string()))})


def one_cycle(tasks: DataFrame, small_edges: int = SMALL_EDGES) -> DataFrame:
    """One cycle per org that has any: the smallest task reading its own output,
    else the shortest cycle through the smallest task on a cycle."""
    groups = cut_lineage(cycle_groups(tasks, small_edges))
    own = tasks.where(F.arrays_overlap("inputs", "outputs")).groupBy("org").agg(F.min("task").alias("task"))
    starts = cut_lineage(
        groups.where(F.col("node").startswith("t:")).join(own, "org", "left_anti")
        .groupBy("org").agg(F.min(F.struct("node", "grp")).alias("s"))
        .select("org", F.col("s.node").alias("start"), F.col("s.grp").alias("grp")))
    area = groups.join(starts, ["org", "grp"], "left_semi").select("org", "node")
    small, large = by_size(_Graph(hops(tasks)).within(area).edges, small_edges)
    paths = (salted_join(small, starts.select("org", "start"), ["org"], "inner")
             .groupBy("org").applyInArrow(_return_in_task, "org string, path array<string>"))
    if large is not None:
        paths = paths.unionByName(_large_returns(large, starts))
    names = F.transform(F.filter("path", lambda n: n.startswith("t:")), _task_name)
    return (own.select("org", F.array("task").alias("cycle"))
            .unionByName(paths.select("org", names.alias("cycle"))))


def _large_returns(graph_edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Breadth first over the edge list: each node once, by the smallest of its
    shortest paths, until an org's start is reached again."""
    graph = _Graph(graph_edges)
    starts = starts.join(graph_edges.select("org").distinct(), "org", "left_semi").select("org", "start")
    front = cut_lineage(starts.select("org", F.col("start").alias("node"), F.array("start").alias("path"), "start"))
    seen = front.select("org", "node").limit(0)
    done = front.select("org", "path").limit(0)
    while not front.isEmpty():
        reached = (graph.join(front, "src", "inner")
                   .select("org", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), "start")
                   .groupBy("org", "node").agg(F.min("path").alias("path"), F.any_value("start").alias("start")))
        reached = cut_lineage(reached.join(seen, ["org", "node"], "left_anti"))
        closed = reached.where("node = start")
        seen = cut_lineage(seen.unionByName(reached.select("org", "node")))
        front = reached
        if not closed.isEmpty():
            done = done.unionByName(closed.select("org", F.slice("path", 1, F.size("path") - 1).alias("path")))
            front = cut_lineage(salted_join(reached, closed.select("org"), ["org"], "left_anti"))
    return done

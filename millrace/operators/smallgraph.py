"""Cycle search for one org's graph that is known to fit a task."""

from __future__ import annotations


def successors(src, dst) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for a, b in zip(src, dst):
        out.setdefault(a, []).append(b)
    return out


def _finish_order(graph: dict[str, list[str]]) -> list[str]:
    seen, order = set(), []
    for root in graph:
        if root in seen:
            continue
        seen.add(root)
        trail = [(root, iter(graph[root]))]
        while trail:
            node, rest = trail[-1]
            fresh = next((x for x in rest if x not in seen), None)
            if fresh is None:
                order.append(node)
                trail.pop()
            else:
                seen.add(fresh)
                trail.append((fresh, iter(graph.get(fresh, ()))))
    return order


def cyclic_groups(src, dst) -> dict[str, str]:
    """Node -> name of its group, the greatest of its nodes, for all groups of
    more than one node: forward finish order, then backward sweeps."""
    forward, backward = successors(src, dst), successors(dst, src)
    left, named = set(forward) | set(backward), {}
    for root in reversed(_finish_order(forward)):
        if root not in left:
            continue
        left.discard(root)
        group, open_ = [root], [root]
        while open_:
            fresh = [x for x in backward.get(open_.pop(), ()) if x in left]
            left.difference_update(fresh)
            fresh = list(dict.fromkeys(fresh))
            group += fresh
            open_ += fresh
        if len(group) > 1:
            named.update(dict.fromkeys(group, max(group)))
    return named


def shortest_return(src, dst, start: str) -> list[str]:
    """Shortest path from ``start`` back to it, the smallest of several; nodes
    without the closing one."""
    graph, front, seen = successors(src, dst), {start: [start]}, set()
    while front:
        reached: dict[str, list[str]] = {}
        for node, path in front.items():
            for x in graph.get(node, ()):
                if x not in seen and (x not in reached or path + [x] < reached[x]):
                    reached[x] = path + [x]
        if start in reached:
            return reached[start][:-1]
        seen.update(reached)
        front = reached
    return []

import random

import pytest

from millrace.operators.lineage import cycles, edges, one_cycle
from millrace.schemas import small_df

DDL = "org string, task string, inputs array<string>, outputs array<string>"

def ring(org, n, first=0):
    """Tasks in a circle, each writing the queue the next one reads."""
    return [dict(org=org, task=f"{org}{first + i:02d}", inputs=[f"r{first + i}"], outputs=[f"r{first + (i + 1) % n}"])
            for i in range(n)]


@pytest.mark.parametrize("small", [0, 1000])
def test_rings_chains_and_loops(spark, small):
    chain = [dict(org="line", task=f"line{i}", inputs=[f"l{i}"], outputs=[f"l{i + 1}", "sink"]) for i in range(6)]
    loop = [dict(org="loop", task="far", inputs=["x", "y"], outputs=["y"]),
            dict(org="loop", task="near", inputs=["y"], outputs=["x"])]
    # two rings that a bridge joins one way, and a tail that leaves the second
    pair = ring("pair", 3) + ring("pair", 5, 10) + [
        dict(org="pair", task="bridge", inputs=["r1"], outputs=["r12"]),
        dict(org="pair", task="tail", inputs=["r13"], outputs=["out"])]
    df = small_df(spark, chain + loop + ring("seven", 7) + pair, DDL)
    got = {}
    for r in cycles(df, small).collect():
        got.setdefault(r.org, set()).add(r.task)
    assert got == {"loop": {"far", "near"}, "seven": {f"seven{i:02d}" for i in range(7)},
                   "pair": {f"pair{i:02d}" for i in (0, 1, 2, 10, 11, 12, 13, 14)}}
    one = {r.org: r.cycle for r in one_cycle(df, small).collect()}
    assert one == {"loop": ["far"], "seven": [f"seven{i:02d}" for i in range(7)],
                   "pair": ["pair00", "pair01", "pair02"]}


def test_empty_and_orgs_apart(spark):
    assert cycles(small_df(spark, [], DDL)).count() == 0
    apart = [dict(org="x", task="A", inputs=["a"], outputs=["b"]), dict(org="y", task="B", inputs=["b"], outputs=["a"])]
    assert cycles(small_df(spark, apart, DDL)).count() == 0


@pytest.mark.parametrize("seed,small", [(1, 1000), (2, 1000), (2, 10)])
def test_random_graphs(spark, seed, small):
    rng = random.Random(seed)
    data = [dict(org=f"o{o}", task=f"t{i}", inputs=rng.sample([f"q{q}" for q in range(9)], 1),
                 outputs=rng.sample([f"q{q}" for q in range(9)], rng.choice([0, 1, 1, 2])))
            for o in range(12) for i in range(rng.randrange(3, 9))]
    df = small_df(spark, data, DDL)
    reach = {}
    for r in edges(df).collect():
        reach.setdefault((r.org, r.src), set()).add(r.dst)
    direct = {k: set(v) for k, v in reach.items()}
    changed = True
    while changed:
        changed = False
        for k, v in reach.items():
            new = set().union(*[reach.get((k[0], d), set()) for d in v]) - v
            if new:
                v |= new
                changed = True
    want = {k for k, v in reach.items() if k[1] in v}
    assert {(r.org, r.task) for r in cycles(df, small).collect()} == want
    found = {r.org: r.cycle for r in one_cycle(df, small).collect()}
    assert set(found) == {o for o, _ in want}
    for org, c in found.items():
        for a, b in zip(c, c[1:] + c[:1]):
            assert b in direct[(org, a)]

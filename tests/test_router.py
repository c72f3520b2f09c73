import random

from pyspark.sql import functions as F

from millrace.operators.router import ENDPOINTS_DDL, Endpoint, endpoint_table, route, route_by_table

DDL = ("id int, method string, raw_path string, query map<string,string>, headers map<string,string>, cookies array<string>")


def test_names_that_differ_in_case_only(spark):
    rows = [(1, "get", "/u/7", {"id": "q"}, {"X-A": "first", "x-a": "second", "x-b": "b"}, ["S=1", "s=2"]),
            (2, "get", "/u/8", {}, {}, []), (3, "get", "/u/9", {}, None, None)]
    ends = [Endpoint("one", "GET", "/u/{id}", query={"id": False}, headers={"X-A": False}, cookies={"s": False})]
    got = {r.id: r.params for r in route(spark.createDataFrame(rows, DDL), ends).select("id", "params").collect()}
    assert got[1] == {"id": "7", "X-A": "first", "s": "1; 2"}
    assert got[2] == {"id": "8", "X-A": None, "s": None} == {**got[3], "id": "8"}


def test_required_header_in_any_case(spark):
    rows = [(1, "GET", "/a", {}, {"AUTH": "x", "Auth": "y"}, []), (2, "GET", "/a", {}, {"other": "x"}, [])]
    ends = [Endpoint("kept", "get", "/a", headers={"auth": True})]
    log = route(spark.createDataFrame(rows, DDL), ends)
    assert {r.id: r.endpoint for r in log.select("id", F.col("endpoint")).collect()} == {1: "kept", 2: "default"}


def test_table_routes_as_the_definitions_do(spark):
    rows = [(1, "get", "/u/7", {"id": "q"}, {"X-A": "first", "x-a": "second"}, ["S=1", "s=2"]),
            (2, "get", "/u/8/", {}, {}, []), (3, "GET", "/u/9", None, None, None), (4, "POST", "/u/9", {}, {"content-type": "a/B; x"}, []),
            (5, "POST", "/u/9", {"k": "v"}, {}, []), (6, None, "/u/9", {}, {}, []), (7, "GET", None, {}, {}, []), (8, "GET", "/", {}, {}, []),
            (9, "GET", "/u/{}", {}, {}, []), (10, "GET", "/u/v/w", {}, {}, []), (11, "GET", "/x/y", {"need": ""}, {}, [])]
    ends = [Endpoint("asks", "GET", "/{what}/{id}", query={"need": True}), Endpoint("brace", "GET", "/{any}/{}"),
            Endpoint("one", "Get", "/u/{id}", query={"id": False}, headers={"X-A": True}, cookies={"s": True}),
            Endpoint("typed", "post", "/u/9", content_types=("A/b",)), Endpoint("hidden", "POST", "/u/9", content_types=("a/b",)),
            Endpoint("rest", "POST", "/{x}/9/", query={"k": False}), Endpoint("top", "GET", "/"), Endpoint("get", "GET", "/u/{n}")]
    log = spark.createDataFrame(rows, DDL)
    want = {r.id: (r.endpoint, r.params) for r in route(log, ends).collect()}
    got = {r.id: (r.endpoint, r.params) for r in route_by_table(log, endpoint_table(spark, ends), "id").collect()}
    assert got == want and want[4][0] == "typed" and want[6][0] == "default" == want[7][0] and want[8][0] == "top"
    none = spark.createDataFrame([], ENDPOINTS_DDL)
    assert {(r.endpoint, len(r.params)) for r in route_by_table(log, none, "id").collect()} == {("default", 0)}
    assert route_by_table(log.limit(0), none, "id").count() == 0


def test_ten_thousand_endpoints(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    ends = []
    for i in range(10_000):
        parts = [rng.choice(words) if rng.random() < 0.8 else "{p%d}" % j for j in range(rng.randrange(2, 5))]
        ends.append(Endpoint(f"e{i}", rng.choice(["GET", "POST"]), "/" + "/".join(parts),
                             query={"a": rng.random() < 0.7} if rng.random() < 0.5 else {}))
    # a third of the requests are for one path
    rows = [(i, rng.choice(["get", "POST", "PUT"]),
             "/w1/w2/w3" if i % 3 == 0 else "/" + "/".join(rng.choice(words) for _ in range(rng.randrange(1, 6))),
             {"a": "x"} if rng.random() < 0.3 else {}, {}, []) for i in range(1500)]

    def plain(method, path, query):
        parts = path.strip("/").split("/")
        for e in ends:
            if (e.method == method.upper() and len(e.parts) == len(parts)
                    and all(p.startswith("{") or p == q for p, q in zip(e.parts, parts))
                    and all(n in query for n, required in e.query.items() if required)):
                return e.name, {**{p[1:-1]: q for p, q in zip(e.parts, parts) if p.startswith("{")}, **{n: query.get(n) for n in e.query}}
        return "default", {}
    got = route_by_table(spark.createDataFrame(rows, DDL), endpoint_table(spark, ends), "id").collect()
    assert len(got) == len(rows)
    assert {r.id: (r.endpoint, r.params) for r in got} == {i: plain(m, p, q) for i, m, p, q, _, _ in rows}

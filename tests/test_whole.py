"""Queries over all ids, which have no SQL, against plain Python on a small catalog."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

import __spark_entry__ as entry
from heirline.operators import risk

SUPPLIERS, PARTS, ORDERS, CUSTOMERS = range(1, 9), range(1, 13), range(1, 31), range(1, 13)


class Catalog:
    def __init__(self, spark, folder):
        rng = random.Random(21)
        self.folder = str(folder)
        suppliers = [(s, rng.randrange(4), rng.choice([-5.0, 5.0])) for s in SUPPLIERS]
        orders = [(o, rng.choice(CUSTOMERS[:-1])) for o in ORDERS]
        lines = [(o, rng.choice(PARTS), rng.choice(SUPPLIERS), float(rng.randrange(1, 51)), rng.randrange(1, 11) / 100, rng.choice("RNNNNNNN"))
                 for o in ORDERS for _ in range(rng.randrange(1, 4))]
        customers = [(c, c % 4) for c in CUSTOMERS]
        tables = {
            "region": ([(0, "r0"), (1, "r1")], "r_regionkey long, r_name string"),
            "nation": ([(n, n % 2, f"n{n}") for n in range(4)], "n_nationkey long, n_regionkey long, n_name string"),
            "supplier": ([(s, n, f"s{s}", b) for s, n, b in suppliers], "s_suppkey long, s_nationkey long, s_name string, s_acctbal double"),
            "part": ([(p, f"p{p}") for p in PARTS], "p_partkey long, p_name string"),
            "orders": ([(o, c, "low") for o, c in orders], "o_orderkey long, o_custkey long, o_orderpriority string"),
            "customer": ([(c, n, f"c{c}", "X") for c, n in customers], "c_custkey long, c_nationkey long, c_name string, c_mktsegment string"),
            "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_returnflag string"),
        }
        for name, (rows, columns) in tables.items():
            spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
        edges = [(f"region_{n % 2}", f"nation_{n}", 0.9) for n in range(4)]
        edges += [(f"nation_{n}", f"supplier_{s}", 0.5) for s, n, _ in suppliers]
        edges += [(f"supplier_{s}", f"part_{p}", d) for _, p, s, _, d, _ in lines] + [(f"part_{p}", f"order_{o}", q / 50) for o, p, _, q, *_ in lines]
        edges += [(f"order_{o}", f"customer_{c}", 0.9) for o, c in orders]
        self.children, self.parents = defaultdict(set), defaultdict(set)
        self.weights = {}
        for a, b, weight in edges:
            self.weights[a, b] = max(weight, self.weights.get((a, b), 0.0))
            self.children[a].add(b)
            self.parents[b].add(a)
        self.returned = {(f"order_{o}", f"part_{p}") for o, p, *_, flag in lines if flag == "R"}
        self.suppliers, self.customers = [f"supplier_{s}" for s in SUPPLIERS], [f"customer_{c}" for c in CUSTOMERS]
        self.seeds = {f"supplier_{s}" for s, _, b in suppliers if b < 0}
        self.home = {f"customer_{c}": f"nation_{n}" for c, n in customers}

    def beyond(self, node, links):
        found, todo = set(), [node]
        while todo:
            for far in links[todo.pop()] - found:
                found.add(far)
                todo.append(far)
        return found


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    return Catalog(spark, tmp_path_factory.mktemp("star"))


@pytest.fixture(scope="module")
def ask(spark, catalog):
    return lambda name: entry.queries()[name](spark, catalog.folder).collect()


def test_all_suppliers_and_customers(catalog, ask):
    want = {(s, d) for s in catalog.suppliers for d in catalog.beyond(s, catalog.children)}
    got = [(r.query_id, r.node_id) for r in ask("every_impact")]
    assert len(got) == len(set(got)) and set(got) - {(s, s) for s in catalog.suppliers} == want
    assert len({s for s, _ in want}) > 1
    want = {(c, d) for c in catalog.customers for d in catalog.beyond(c, catalog.parents)}
    got = [(r.query_id, r.node_id) for r in ask("every_ancestor")]
    assert len(got) == len(set(got)) and set(got) - {(c, c) for c in catalog.customers} == want
    got = [(r.node_id, r.parent) for r in ask("every_parent")]
    assert sorted(got) == sorted((c, p) for c in catalog.customers for p in catalog.parents[c])


def test_all_proofs(catalog, ask):
    above = {c: catalog.beyond(c, catalog.parents) for c in catalog.customers}
    assert {(r.target, r.chain_length) for r in ask("every_proof_target")} == {(c, len(a) + 1) for c, a in above.items()}
    rows = {(r.proof_id, r.node_id): r.parents for r in ask("every_proof_row")}
    assert rows == {(c, d): ">".join(sorted(catalog.parents[d])) for c, a in above.items() for d in a | {c}}
    assert {(r.target, r.valid) for r in ask("every_proof_verdict")} == {(c, not a & catalog.seeds) for c, a in above.items()}


def test_all_paths(catalog, ask):
    found = {(r.src, r.dst): (r.reachable, r.path) for r in ask("every_catalog_path")}
    assert set(found) == {(n, c) for c, n in catalog.home.items()}
    for (n, c), (reachable, path) in found.items():
        assert reachable == (c in catalog.beyond(n, catalog.children))
        steps = path.split(">") if reachable else []
        assert all(b in catalog.children[a] for a, b in zip(steps[:-1], steps[1:], strict=True))
        # Types follow each other, so all paths have five nodes.
        assert (path == "") if not reachable else (steps[0], steps[-1], len(steps)) == (n, c, 5)


def test_all_returned_lots(catalog, ask):
    stuck = {p for _, p in catalog.returned}
    for p in list(stuck):
        stuck |= catalog.beyond(p, catalog.children)
    assert sorted(r.node_id for r in ask("every_cycle_node")) == sorted(stuck)


def test_all_intervals(catalog, ask):
    spans = {r.node_id: (r.disc, r.fin) for r in ask("interval_labels")}
    want = {(a, b) for a in spans for b in spans if spans[a][0] < spans[b][0] and spans[b][1] <= spans[a][1]}
    got = [(r.query_id, r.node_id) for r in ask("every_interval_member")]
    assert len(got) == len(set(got)) and set(got) == want
    assert any(a.startswith("supplier") for a, _ in want)


def test_whole_answers(catalog, ask):
    near = {(s, d): 1 for s in catalog.seeds for d in catalog.children[s]}
    two = near | {(s, e): 2 for s, d in near for e in catalog.children[d] if (s, e) not in near}
    assert {(r.query_id, r.node_id): r.hops for r in ask("impact_query_rows") if r.query_id != r.node_id} == two
    heads = {r.source: r.total_impacted for r in ask("impact_query")}
    rows = [r.query_id for r in ask("impact_query_rows")]
    assert {s: rows.count(s) for s in heads} == heads

    nodes = {n for edge in catalog.weights for n in edge} | set(catalog.customers) | {f"part_{p}" for p in PARTS} | set(catalog.suppliers)
    nodes |= {f"order_{o}" for o in ORDERS}
    score = {n: float(n in catalog.seeds) for n in nodes}
    for _ in range(risk.DIFFUSION_ROUNDS):
        safe = defaultdict(lambda: 1.0)
        for (a, b), weight in catalog.weights.items():
            safe[b] *= 1 - weight * score[a]
        new = {n: max(s, risk.DIFFUSION_DAMPING * (1 - safe[n]) + (1 - risk.DIFFUSION_DAMPING) * s) if n in safe else s for n, s in score.items()}
        change, score = max(abs(new[n] - score[n]) for n in nodes), new
        if change < risk.DIFFUSION_TOLERANCE:
            break
    assert {r.node_id: r.risk for r in ask("diffusion_scores")} == pytest.approx(score, abs=2e-6)


def test_reports_show_their_rows(catalog, ask):
    rows = ask("impact_report_rows")
    assert [(r.query_id, r.error, r.side, r.node_id) for r in rows if r.error] == [("nobody", "Node not found: nobody", None, None)]
    scores = {r.node_id: r.risk for r in ask("risk_scores")}
    for report in ask("impact_report"):
        for side, ids in (("down", report.impacted_nodes), ("up", report.ancestor_nodes)):
            found = sorted((r.place, r.node_id, r.risk, r.node_type) for r in rows if r.query_id == report.query_id and r.side == side)
            assert ">".join(n for _, n, *_ in found) == ids
            assert all(r == scores[n] and t for _, n, r, t in found)

"""Small graphs with known results, and the results computed in plain Python."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from dataclasses import dataclass, field
from pathlib import Path

FIXTURE_TEXT = (Path(__file__).resolve().parent.parent / "FIXTURES.md").read_text()
GOLDEN = re.compile(
    r"^\| (\w+) \| (\w+) \| (\d+) \| (\d+) \| (\d+) \| ([\d.]+) \| (\w+) \| `(\w{64})` \|$", re.M
)


@dataclass
class Fixture:
    nodes: list[tuple]
    edges: list[tuple]
    seeds: dict[str, float]
    golden: dict[str, tuple] = field(default_factory=dict)

    def frames(self, spark):
        nodes = spark.createDataFrame(
            [(n, t, c, "unknown") for n, t, c in self.nodes],
            "node_id string, node_type string, content map<string,string>, creator string",
        )
        return nodes, spark.createDataFrame(self.edges, "src string, dst string, weight double")


class Demo(Fixture):
    def frames(self, spark):
        from heirline.sources import demo_catalog

        return demo_catalog(spark)


def golden_of(section: int) -> dict[str, tuple]:
    text = FIXTURE_TEXT.split(f"\n## {section}.")[1].split("\n## ")[0]
    return {
        m[1]: (m[2], int(m[3]), int(m[4]), int(m[5]), float(m[6]), m[7], m[8]) for m in GOLDEN.finditer(text)
    }


def small(section: int, nodes: str, edges: str, seed: str) -> Fixture:
    rows = [n.split(":") for n in nodes.split()]
    links = [e.split(":") for e in edges.split()]
    return Fixture(
        [(n, t, {"n": v}) for n, t, v in rows],
        [(a, b, float(w)) for a, b, w in links],
        {seed: 1.0},
        golden_of(section),
    )


FIXTURES = {
    "seven": small(
        2,
        "ds1:dataset:ImageNet ds2:dataset:CommonVoice sc1:tool:train.py m1:model:ResNet m2:model:BERT p1:product:App1 p2:product:App2",
        "ds1:m1:0.9 sc1:m1:0.7 ds2:m2:0.9 m1:p1:0.95 m2:p2:0.95",
        "ds1",
    ),
    "chain": small(
        3,
        "ds:dataset:data tool:tool:script m1:model:base m2:model:finetuned p1:product:app",
        "ds:m1:0.9 tool:m1:0.7 m1:m2:0.85 m2:p1:0.95",
        "ds",
    ),
    "facade": small(4, "ds:dataset:d t:tool:t m:model:m p:product:p", "ds:m:0.9 t:m:0.7 m:p:0.95", "ds"),
    "diamond": small(
        5, "a:dataset:a b:model:b c:model:c d:product:d", "a:b:0.9 b:c:0.7 a:c:0.8 c:d:0.95", "a"
    ),
    "demo": Demo([], [], {"ds_imagenet": 1.0}, golden_of(7)),
}


def random_fixture(seed: int, size: int = 16, links: int = 30) -> Fixture:
    rng = random.Random(seed)
    kinds = ["dataset", "model", "tool", "product"]
    names = [f"v{i:02d}" for i in range(size)]
    order = names[:]
    rng.shuffle(order)
    nodes = [(n, rng.choice(kinds), {"k": n.upper(), "z": str(rng.random())}) for n in names]
    pairs = set()
    while len(pairs) < links:
        a, b = sorted(rng.sample(range(size), 2))
        if b - a < 8 or a == 0:
            pairs.add((order[a], order[b]))
    edges = [(a, b, round(rng.random(), 2)) for a, b in sorted(pairs)]
    seeds = {n: rng.choice([0.3, 0.7, 1.0]) for n in rng.sample(names, 4)}
    return Fixture(nodes, edges, seeds)


class Brute:
    """Results of a fixture by direct computation."""

    def __init__(self, fixture: Fixture):
        self.fixture = fixture
        self.types = {n: t for n, t, _ in fixture.nodes}
        self.content = {n: dict(c) for n, _, c in fixture.nodes}
        self.weight = {(a, b): w for a, b, w in fixture.edges}
        self.children = {n: sorted(b for a, b in self.weight if a == n) for n in self.types}
        self.parents = {n: sorted(a for a, b in self.weight if b == n) for n in self.types}
        self.layer: dict[str, int] = {}
        while len(self.layer) < len(self.types):
            for n in self.types:
                if n not in self.layer and all(p in self.layer for p in self.parents[n]):
                    self.layer[n] = 1 + max((self.layer[p] for p in self.parents[n]), default=-1)
        self.order = sorted(self.types, key=lambda n: (self.layer[n], n))

    def hashes(self) -> dict[str, str]:
        out: dict[str, str] = {}
        for n in self.order:
            text = f"nodeId={n};nodeType={self.types[n]};creator=unknown;"
            text += "".join(f"{k}={v};" for k, v in sorted(self.content[n].items()))
            text += "".join(f"parent={h};" for h in sorted(out[p] for p in self.parents[n]))
            out[n] = hashlib.sha256(text.encode()).hexdigest()
        return out

    def risks(self) -> dict[str, float]:
        out: dict[str, float] = {}
        for n in self.order:
            safe = 1.0
            for p in self.parents[n]:
                safe *= 1.0 - self.weight[p, n] * out[p]
            out[n] = max(self.fixture.seeds.get(n, 0.0), 1.0 - safe)
        return out

    def diffused(self, damping: float, rounds: int) -> dict[str, float]:
        now = {n: self.fixture.seeds.get(n, 0.0) for n in self.types}
        for _ in range(rounds):
            new = {}
            for n in self.types:
                safe = 1.0
                for p in self.parents[n]:
                    safe *= 1.0 - self.weight[p, n] * now[p]
                new[n] = max(now[n], damping * (1.0 - safe) + (1.0 - damping) * now[n])
            now = new
        return now

    def hops(self, start: str, forward: bool = True) -> dict[str, int]:
        links = self.children if forward else self.parents
        seen = {start: 0}
        level = [start]
        for step in itertools.count(1):
            level = sorted({b for a in level for b in links[a]} - set(seen))
            if not level:
                return {n: h for n, h in seen.items() if h}
            seen.update({n: step for n in level})

    def path(self, start: str, end: str) -> list[str] | None:
        best = {start: [start]}
        while end not in best:
            grown = dict(best)
            for n, trail in best.items():
                for c in self.children[n]:
                    if c not in best and (c not in grown or [*trail, c] < grown[c]):
                        grown[c] = [*trail, c]
            if len(grown) == len(best):
                return None
            best = grown
        return best[end]


def ids(spark, *names: str):
    return spark.createDataFrame([(n,) for n in names], "node_id string")


def seeds_of(spark, fixture: Fixture):
    return spark.createDataFrame(list(fixture.seeds.items()), "node_id string, probability double")


def pairs_of(spark, *pairs: tuple[str, str]):
    return spark.createDataFrame(list(pairs), "src string, dst string")

from __future__ import annotations

import random

import pytest

from lockgrain.operators.components import connected_components, linked_components
from lockgrain.operators.hierarchy import descendants, hierarchies, walk_component

SCHEMA = "space string, child string, parent string"


def brute(links):
    """Results by plain search, for one space."""
    nodes = {x for link in links for x in link if x is not None}
    down = {n: {c for c, p in links if p == n and c is not None} for n in nodes}
    up = {n: {p for c, p in links if c == n and p is not None} for n in nodes}

    def below(n):
        seen, todo = set(), [n]
        while todo:
            for c in down[todo.pop()]:
                if c not in seen:
                    seen.add(c)
                    todo.append(c)
        return seen

    reach = {n: below(n) for n in nodes}
    ring = {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes if n in reach[n]}
    out = {}
    for n in nodes:
        over = [ring[m] for m in ring if n in reach[m]]
        if n in ring:
            depth, root = -1, ring[n]
        elif over:
            depth, root = -2, min(over)
        else:
            level, depth = {n}, 0
            best = [n] if not up[n] else []
            while not best:
                depth += 1
                level = {p for m in level for p in up[m]}
                best = [m for m in level if not up[m]]
            root = min(best)
        out[n] = (root, depth, len(reach[n] - {n}))
    return out


def random_links(rng, single_parent):
    n = rng.randint(1, 12)
    names = [f"n{i}" for i in range(n)]
    links = []
    for i, c in enumerate(names):
        for _ in range(1 if single_parent else rng.randint(0, 3)):
            p = rng.choice([*names, None]) if rng.random() < 0.3 else (names[rng.randrange(i)] if i else None)
            links.append((c, p))
    return links + rng.choices(links, k=2) if links else [("n0", None)]


@pytest.mark.parametrize("single", [True, False])
def test_walk_agrees_with_plain_search(single):
    rng = random.Random(7)
    for _ in range(400):
        links = random_links(rng, single)
        parts = {frozenset(p) for p in _components(links)}
        got = {}
        for part in parts:
            rows = [(c, p) for c, p in links if c in part]
            for key, root, depth, size, path, _ in walk_component(rows):
                got[key] = (root, depth, size)
                assert (path is None) == (depth < 0)
                if path:
                    assert path[0] == root and path[-1] == key and len(path) == depth + 1
        assert got == brute(links), links


def _components(links):
    near = {}
    for c, p in links:
        near.setdefault(c, set()).add(c)
        if p is not None:
            near[c].add(p)
            near.setdefault(p, set()).update((p, c))
    done = set()
    for n in near:
        if n not in done:
            seen, todo = {n}, [n]
            while todo:
                for m in near[todo.pop()] - seen:
                    seen.add(m)
                    todo.append(m)
            done |= seen
            yield seen


def test_both_ways_agree(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for s in range(8):
        links = random_links(rng, s % 2 == 0)
        rows += [(f"s{s}", c, p) for c, p in links]
        want |= {(f"s{s}", k): v for k, v in brute(links).items()}
    df = spark.createDataFrame(rows, SCHEMA)
    for bounds in ({}, {"local_nodes": 0, "local_dag_nodes": 0}):
        out = hierarchies(df, **bounds).collect()
        got = {(r.space, r.key): (r.root_key, r.depth, r.n_descendants) for r in out}
        assert got == want
        assert len(out) == len(want)
        for r in out:
            if r.depth >= 0:
                assert r.path[0] == r.root_key and r.path[-1] == r.key and len(r.path) == r.depth + 1
            else:
                assert r.path is None
    listed = [sorted(map(tuple, descendants(df, **b).collect())) for b in ({}, {"local_nodes": 0, "local_dag_nodes": 0})]
    assert listed[0] == listed[1]
    counts = {}
    for s, key, _, _ in listed[0]:
        counts[s, key] = counts.get((s, key), 0) + 1
    assert counts == {k: v[2] for k, v in want.items() if v[2]}


def test_edge_cases(spark):
    rows = [("s", None, None), ("s", None, "p"), ("s", "a", "a"), ("s", "b", "a"), ("s", "c", None), ("s", "c", None), ("s", "long" * 5000, "c"), (None, "x", "y")]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", root_key int")
    got = {(r.space, r.key): (r.root_key, r.depth, r.n_descendants) for r in hierarchies(df).collect()}
    assert got["s", "p"] == ("p", 0, 0)
    assert got["s", "a"] == ("a", -1, 1)
    assert got["s", "b"] == ("a", -2, 0)
    assert got["s", "c"] == ("c", 0, 1)
    assert got["s", "long" * 5000][:2] == ("c", 1)
    assert len(got) == 7
    empty = spark.createDataFrame([], SCHEMA)
    assert hierarchies(empty).collect() == []
    assert descendants(empty).collect() == []


def test_deep_chain_and_back_edges(spark):
    rows = [("s", str(i), str(i - 1)) for i in range(1, 3000)]
    out = {r.key: r for r in hierarchies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out["2999"].depth == 2999 and out["2999"].root_key == "0" and out["0"].n_descendants == 2999
    ring = [("s", "b", "a"), ("s", "c", "b"), ("s", "a", "c"), ("s", "d", "c")]
    for bounds in ({}, {"local_nodes": 0}):
        out = {r.key: r for r in hierarchies(spark.createDataFrame(ring, SCHEMA), **bounds).collect()}
        assert out["a"].back_edges == ["c"] and out["d"].depth == -2 and out["c"].n_descendants == 3


def test_small_and_large_components_together(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for s in range(6):
        links = [(f"n{i}", f"n{rng.randrange(i)}" if rng.random() < 0.9 else None) for i in range(1, 40 if s == 0 else 8)] + [("x", "x"), ("y", None)]
        rows += [(f"s{s}", c, p) for c, p in links]
        want |= {(f"s{s}", k): v for k, v in brute(links).items()}
    df = spark.createDataFrame(rows, SCHEMA)
    for bound in (200_000, 12):
        got = {(r.space, r.key): (r.root_key, r.depth, r.n_descendants) for r in hierarchies(df, local_nodes=bound).collect()}
        assert got == want


def test_long_chain_and_many_roots_are_never_gathered(spark):
    """A chain, a circle with chains below it and many roots, all by doubling: no component is brought into one place."""
    n = 3000
    links = [(f"c{i}", f"c{i - 1}") for i in range(1, n)] + [(f"r{i}", f"r{(i + 1) % 37}") for i in range(37)] + [("t0", "r5")] + [(f"t{i}", f"t{i - 1}") for i in range(1, 100)] + [(f"root{i}", None) for i in range(n)]
    out = {r.key: r for r in hierarchies(spark.createDataFrame([("s", *x) for x in links], SCHEMA), with_paths=False, local_nodes=0).collect()}
    assert len(out) == 2 * n + 137
    assert all((out[f"c{i}"].root_key, out[f"c{i}"].depth, out[f"c{i}"].n_descendants) == ("c0", i, n - 1 - i) for i in range(n))
    assert all((out[f"r{i}"].root_key, out[f"r{i}"].depth, out[f"r{i}"].n_descendants) == ("r0", -1, 136) for i in range(37))
    assert all((out[f"t{i}"].root_key, out[f"t{i}"].depth, out[f"t{i}"].n_descendants) == ("r0", -2, 99 - i) for i in range(100))
    assert out["r0"].back_edges == ["r1"] and sum(bool(r.back_edges) for r in out.values()) == 1 and out["root7"].depth == 0


def test_components_of_links(spark, monkeypatch):
    from lockgrain.operators import components

    rng = random.Random(2)
    for single, few in ((True, 0), (False, 0), (True, 1000), (False, 1000)):
        monkeypatch.setattr(components, "FEW_EDGES", few)
        pairs = set()
        for i in range(80):
            for _ in range(1 if single else rng.randint(1, 2)):
                pairs.add((i, rng.choice([None, rng.randrange(80), max(0, i - 1), i])))
        want = {}
        for part in _components(pairs):
            want |= dict.fromkeys(part, frozenset(part))
        groups = {}
        rows = linked_components(spark.createDataFrame(sorted(pairs, key=str), "k long, p long")).collect()
        for r in rows:
            groups.setdefault(r.component, set()).add(r.node)
        assert len(rows) == len(want) and {frozenset(g) for g in groups.values()} == set(want.values())


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(None, 3), (5, None), (9, 9)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {}
    for r in connected_components(df).collect():
        assert r.node not in got
        got[r.node] = r.component
    want = {}
    for part in _components([(a, b) for a, b in edges if None not in (a, b) and a != b]):
        want |= dict.fromkeys(part, min(part))
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def closing(links):
    """Back edges by their definition, for one space."""
    edges = {(p, c) for c, p in links if c is not None and p is not None}
    nodes = {x for e in edges for x in e}

    def distances(n):
        far, level = {n: 0}, [n]
        while level:
            level = sorted({d for a, d in edges if a in level} - far.keys())
            far |= dict.fromkeys(level, max(far.values()) + 1)
        return far

    far = {n: distances(n) for n in nodes}
    out = {}
    for a, d in edges:
        if a in far[d]:
            least = min(n for n in nodes if n in far[a] and a in far[n])
            if (far[least][d], d) <= (far[least][a], a):
                out.setdefault(d, []).append(a)
    return {n: sorted(p) for n, p in out.items()}


def test_back_edges_agree_both_ways(spark):
    rng = random.Random(11)
    spaces = {
        "overlapping": [("b", "a"), ("a", "b"), ("c", "b"), ("b", "c")],
        "rooted": [("b", "r"), ("a", "b"), ("b", "a")],
        "self": [("a", "a"), ("b", "a"), ("a", "b"), ("b", "b")],
        "tree": [("b", "c"), ("c", "a"), ("a", "b"), ("0", "b"), ("d", "0")],
    }
    for s in range(12):
        names = [f"n{i}" for i in range(rng.randint(2, 9))]
        spaces[f"s{s}"] = [(rng.choice(names), rng.choice(names)) for _ in range(2 * len(names))]
    want = {(s, n): p for s, links in spaces.items() for n, p in closing(links).items()}
    assert want["overlapping", "a"] == ["b"] and want["overlapping", "b"] == ["c"] and want["rooted", "a"] == ["b"] and ("rooted", "b") not in want
    df = spark.createDataFrame([(s, c, p) for s, links in spaces.items() for c, p in links], SCHEMA)
    for bounds in ({}, {"local_nodes": 0, "local_dag_nodes": 0}):
        assert {(r.space, r.key): r.back_edges for r in hierarchies(df, **bounds).collect() if r.back_edges} == want
    for links in spaces.values():  # without its back edges a space has no circle
        left = [(c, p) for c, p in links if p not in closing(links).get(c, ())]
        assert not closing(left)

"""Parent-child links of unknown depth to full hierarchies.

Method: find connected components, bring each component into one place, walk it depth-first without recursion while
colouring nodes white, grey and black, and put out paths, descendant counts and the back edges that close circles.

A component larger than ``local_nodes`` nodes and links (or, where some node has several parents, larger than
``local_dag_nodes``) is never gathered. Where no node has several parents, pointers double (``tree_by_doubling``): work
grows with the nodes times the logarithm of the depth. Else the same results come from shortest-distance reachability by
path doubling (``reach_by_doubling``), which lists the pairs that reach each other.

Defined results
* Anything named as parent or child is a node; null keys are no nodes; repeated links count once.
* No known parent: root, depth 0, its own root. A parent that is known in one row wins over a null in another.
* On a circle (its own parent included): depth -1, root is the smallest key on that circle, no path.
* Below a circle: depth -2, root is the smallest key on that circle (of several circles, the smallest key).
* Several parents: depth is the shortest distance from any root, root the smallest root at that distance, and the path
  goes through the smallest of the parents that lie one step nearer to that root.
* n_descendants counts distinct nodes reachable downwards, without the node itself.
* Back edges don't depend on the way they are found: of the links within a group of nodes that reach each other, those
  that lead no further from the smallest key of the group, by shortest distance and then by key. Each lies on a circle,
  without them there is none, and a plain circle has one: the link to its smallest key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockgrain.operators.components import linked_components
from lockgrain.session import cut_lineage, replace_lineage

BATCH_STEPS = 200_000  # path steps of one Arrow batch
NO_SPACE = "\u0000"  # stands for a null space inside, so that joins find it

NODE_SCHEMA = "space string, key string, root_key string, depth int, n_descendants long, path array<string>, back_edges array<string>"


def walk_component(links: list[tuple[str, str | None]], with_paths: bool = True) -> Iterator[tuple]:
    """(key, root, depth, n_descendants, path, back edge parents) of each node; links are (child, parent or None)."""
    down: dict[str, list[str]] = {}
    up: dict[str, list[str]] = {}
    for child, parent in set(links):
        down.setdefault(child, [])
        up.setdefault(child, [])
        if parent is not None:
            down.setdefault(parent, []).append(child)
            up.setdefault(parent, [])
            up[child].append(parent)
    for kin in (down, up):
        for near in kin.values():
            near.sort()
    nodes = sorted(down)
    roots = [n for n in nodes if not up[n]]
    tree = all(len(p) <= 1 for p in up.values())

    colour: dict[str, int] = {}  # absent is white, 1 grey, 2 black
    order: list[str] = []  # black in this order: children before parents, but for back edges
    back: dict[str, list[str]] = {}
    for start in [*roots, *nodes]:
        if start in colour:
            continue
        colour[start] = 1
        stack = [(start, iter(down[start]))]
        while stack:
            node, rest = stack[-1]
            for child in rest:
                c = colour.get(child)
                if c is None:
                    colour[child] = 1
                    stack.append((child, iter(down[child])))
                    break
                if c == 1:
                    back.setdefault(child, []).append(node)
            else:
                colour[node] = 2
                order.append(node)
                stack.pop()

    circle: dict[str, str] = {}
    if back:
        if tree:
            for child in back:
                ring, at = [child], up[child][0]
                while at != child:
                    ring.append(at)
                    at = up[at][0]
                circle |= dict.fromkeys(ring, min(ring))
        else:
            circle = _rings(reversed(order), up, down)

    closing = _closing(circle, down)

    depth: dict[str, int] = {}
    root: dict[str, str] = {}
    via: dict[str, str] = {}
    for ring, least in circle.items():
        depth[ring], root[ring] = -1, least
    seen: set[str] = set()
    for first in sorted(circle, key=lambda n: (circle[n], n)):
        stack2 = [first]
        while stack2:
            for child in down[stack2.pop()]:
                if child not in seen:
                    seen.add(child)
                    stack2.append(child)
                    if child not in depth:
                        depth[child], root[child] = -2, circle[first]
    level = [r for r in roots if r not in depth]
    for r in level:
        depth[r], root[r] = 0, r
    far = 0
    while level:
        far += 1
        near: dict[str, list[str]] = {}
        for n in level:
            for child in down[n]:
                if child not in depth:
                    near.setdefault(child, []).append(n)
        for child, parents in near.items():
            depth[child] = far
            root[child], via[child] = min((root[p], p) for p in parents)
        level = list(near)

    size: dict[str, int] = {}
    if tree:
        whole = len(nodes)
        for n in order:
            size[n] = whole - 1 if n in circle else sum(size[c] + 1 for c in down[n])
    else:
        bit = {n: 1 << i for i, n in enumerate(nodes)}
        below: dict[str, int] = {}
        for n in order:
            mask = 0
            for c in down[n]:
                mask |= bit[c] | below.get(c, 0)
            below[n] = mask
        while back:  # only circles need more than one pass
            changed = False
            for n in order:
                mask = below[n]
                for c in down[n]:
                    mask |= below[c]
                changed |= mask != below[n]
                below[n] = mask
            if not changed:
                break
        size = {n: (below[n] & ~bit[n]).bit_count() for n in nodes}

    for n in nodes:
        path = None
        if with_paths and depth[n] >= 0:
            path, at = [n], n
            while at in via:
                at = via[at]
                path.append(at)
            path.reverse()
        yield n, root[n], depth[n], size[n], path, closing.get(n)


def _rings(order: Iterator[str], up: dict[str, list[str]], down: dict[str, list[str]]) -> dict[str, str]:
    """Node to smallest key of its circle, for strongly connected groups; the second half of a two-pass search."""
    ring: dict[str, str] = {}
    done: set[str] = set()
    for start in order:
        if start in done:
            continue
        group, stack = [], [start]
        done.add(start)
        while stack:
            n = stack.pop()
            group.append(n)
            for p in up[n]:
                if p not in done:
                    done.add(p)
                    stack.append(p)
        if len(group) > 1 or start in down[start]:
            ring |= dict.fromkeys(group, min(group))
    return ring


def _closing(circle: dict[str, str], down: dict[str, list[str]]) -> dict[str, list[str]]:
    """Node to the parents, in order, whose links to it close circles."""
    far = {least: 0 for least in circle.values()}
    level = list(far)
    while level:
        after = []
        for n in level:
            for c in down[n]:
                if c not in far and circle.get(c) == circle[n]:
                    far[c] = far[n] + 1
                    after.append(c)
        level = after
    closing: dict[str, list[str]] = {}
    for n in sorted(circle):
        for c in down[n]:
            if circle.get(c) == circle[n] and (far[c], c) <= (far[n], n):
                closing.setdefault(c, []).append(n)
    return closing


def _walker(with_paths: bool):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(cols[0], pa.string()),
                    pa.array(cols[1], pa.string()),
                    pa.array(cols[2], pa.string()),
                    pa.array(cols[3], pa.int32()),
                    pa.array(cols[4], pa.int64()),
                    pa.array(cols[5], pa.list_(pa.string())),
                    pa.array(cols[6], pa.list_(pa.string())),
                ],
                names=["space", "key", "root_key", "depth", "n_descendants", "path", "back_edges"],
            )

        out: list[tuple] = []
        weight = 0
        for held in _held(batches):
            for space, links in held.items():  # two spaces share a component number only by a hash clash
                for row in walk_component(links, with_paths):
                    out.append((space, *row))
                    weight += 8 + len(row[4] or ())
                    if weight > BATCH_STEPS:
                        yield emit(out)
                        out, weight = [], 0
        if out:
            yield emit(out)

    return walk


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list[tuple[str, str | None]]]]:
    """The links of each component by space, from rows sorted by component."""
    at, held = None, {}
    for batch in batches:
        for c, s, k, p in zip(*(batch.column(n).to_pylist() for n in ("comp", "space", "key", "parent"))):
            if c != at:
                if held:
                    yield held
                at, held = c, {}
            held.setdefault(s, []).append((k, p))
    if held:
        yield held


def _place(links: DataFrame, space: str, child: str, parent: str, local_nodes: int, local_dag_nodes: int) -> tuple[DataFrame, DataFrame | None]:
    """(comp, space, key, parent) of what may be gathered, and the same with ``most``, the most parents of a node, of
    components that may not (None if there are none)."""
    raw = links.select(F.col(space).cast("string").alias("space"), F.col(child).cast("string").alias("key"), F.col(parent).cast("string").alias("parent"))
    raw = raw.withColumns({"key": F.coalesce("key", "parent"), "parent": F.when(F.col("key").isNotNull(), F.col("parent"))})
    known = cut_lineage(raw.where("key is not null").withColumn("space", F.coalesce("space", F.lit(NO_SPACE))).distinct())
    ident = lambda c: F.xxhash64("space", c)
    spread = known.withColumns({"k": ident("key"), "p": F.when(F.col("parent").isNotNull(), ident("parent"))})
    comps = cut_lineage(linked_components(spread.select("k", "p")))
    placed = spread.join(comps.select(F.col("node").alias("k"), F.col("component").alias("comp")), "k").select("comp", "space", "key", "parent")
    sizes = comps.groupBy(F.col("component").alias("comp")).agg((F.count("*") + F.sum("parents")).alias("size"), F.max("parents").alias("most"))
    large = cut_lineage(sizes.where((F.col("size") > local_nodes) | ((F.col("most") > 1) & (F.col("size") > local_dag_nodes))).select("comp", "most"))
    if large.isEmpty():
        return placed, None
    return placed.join(large, "comp", "left_anti"), placed.join(large, "comp")


def hierarchies(
    links: DataFrame,
    space: str = "space",
    child: str = "child",
    parent: str = "parent",
    with_paths: bool = True,
    local_nodes: int = 200_000,
    local_dag_nodes: int = 20_000,
) -> DataFrame:
    """One row per node: space, key, root_key, depth, n_descendants, path, back_edges (parents whose link closes a circle, in order).

    ``links`` has one row per child, with its parent or null; nodes of different ``space`` are unrelated. Extra columns
    are ignored. An empty table gives an empty result.
    """
    near, far = _place(links, space, child, parent, local_nodes, local_dag_nodes)
    local = near.repartition("comp").sortWithinPartitions("comp").mapInArrow(_walker(with_paths), NODE_SCHEMA)
    out = local
    if far is not None:
        far = cut_lineage(far)
        trees, others = far.where("most <= 1"), far.where("most > 1")
        out = out if trees.isEmpty() else out.unionByName(tree_by_doubling(trees, with_paths))
        out = out if others.isEmpty() else out.unionByName(reach_by_doubling(others, with_paths))
    return out.withColumn("space", F.nullif("space", F.lit(NO_SPACE)))


def _numbered(nodes: DataFrame) -> tuple[DataFrame, int]:
    """(space, key) with a number for each, and the seed; should two nodes share a number, another seed is taken."""
    seed = 0
    while True:
        names = nodes.withColumn("id", F.xxhash64(F.lit(seed), "space", "key"))
        seen = names.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids")).first()
        if seen["n"] == seen["ids"]:
            return names, seed
        seed += 1


def reachable_pairs(links: DataFrame) -> DataFrame:
    """(space, a, d, far): every node a with every node d below it and the shortest distance; a = d on a circle.

    ``links`` has space, a (parent), d (child) without nulls or repeats. A round finds the pairs of distances above m up
    to 2m from those at exactly m and those up to m, so rounds grow with the logarithm of the depth, and in trees no pair
    is found twice. Pairs are held as numbers.
    """
    links = cut_lineage(links.select("space", "a", "d"))
    nodes = cut_lineage(links.select("space", F.col("a").alias("key")).union(links.select("space", "d")).distinct())
    names, seed = _numbered(nodes)
    exact = links.select(*(F.xxhash64(F.lit(seed), "space", c).alias(c) for c in ("a", "d")))
    reach, m = cut_lineage(exact.withColumn("far", F.lit(1))), 1
    exact = reach.select("a", "d")
    while True:
        step = exact.select("a", F.col("d").alias("mid")).join(reach.select(F.col("a").alias("mid"), "d", "far"), "mid")
        fresh = step.groupBy("a", "d").agg((F.min("far") + F.lit(m)).alias("far")).join(reach.select("a", "d"), ["a", "d"], "left_anti")
        fresh = replace_lineage(fresh, None)
        if fresh.isEmpty():
            break
        reach, m = reach.union(fresh), 2 * m
        exact = fresh.where(F.col("far") == m).select("a", "d")
    above = names.select(F.col("id").alias("a"), "space", F.col("key").alias("a_key"))
    below = names.select(F.col("id").alias("d"), F.col("key").alias("d_key"))
    return reach.join(above, "a").join(below, "d").select("space", F.col("a_key").alias("a"), F.col("d_key").alias("d"), "far")


def _paths(chains: DataFrame) -> DataFrame:
    """(space, key, path) from (space, key, via), via null at a root: each path takes on the path of its head."""
    chain = cut_lineage(chains.select("space", "key", F.array("key").alias("path"), "via"))
    while not chain.where("via is not null").isEmpty():
        head = chain.select("space", F.col("key").alias("via"), F.col("path").alias("front"), F.col("via").alias("next"))
        longer = chain.join(head, ["space", "via"], "left").select("space", "key", F.when(F.col("front").isNull(), F.col("path")).otherwise(F.concat("front", "path")).alias("path"), F.col("next").alias("via"))
        chain = replace_lineage(longer, chain)
    return chain.select("space", "key", "path")


def tree_by_doubling(placed: DataFrame, with_paths: bool = True) -> DataFrame:
    """The same rows as the walk gives, for components too large to gather in which no node has two parents.

    After k rounds a node knows its ancestor 2**k links up and how many nodes lie less than 2**k links below it, which it
    adds to that ancestor. Nodes that never reach a root lie on a circle or below one: the ancestors they end at are
    the circle, and what lies on the way there holds its smallest key.
    """
    links = placed.where("parent is not null").select("space", "key", "parent").distinct()
    nodes = cut_lineage(placed.select("space", "key").union(placed.where("parent is not null").select("space", "parent")).distinct())
    names, seed = _numbered(nodes)
    up = links.select(F.xxhash64(F.lit(seed), "space", "key").alias("id"), F.xxhash64(F.lit(seed), "space", "parent").alias("up"))
    first = names.join(up, "id", "left")
    # top and depth: the ancestor reached and the links to it; at: the ancestor exactly 2**k links up, null beyond a root
    state = cut_lineage(first.select("id", F.col("up").alias("at"), F.coalesce("up", "id").alias("top"), F.col("up").isNotNull().cast("int").alias("depth"), F.lit(1).cast("long").alias("below"), F.col("key").alias("low")))
    reach, left = 1, None
    while True:
        still = state.where("at is not null").count()
        if still == 0 or (still == left and reach >= still):
            break
        left, reach = still, 2 * reach
        added = state.where("at is not null").groupBy(F.col("at").alias("id")).agg(F.sum("below").alias("more"))
        ahead = state.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("top").alias("next_top"), F.col("depth").alias("further"), F.col("low").alias("other"))
        step = state.join(ahead, "at", "left").join(added, "id", "left")
        step = step.select(
            "id", F.col("next").alias("at"), F.coalesce("next_top", "top").alias("top"), (F.col("depth") + F.coalesce("further", F.lit(0))).alias("depth"), (F.col("below") + F.coalesce("more", F.lit(0))).alias("below"), F.least("low", F.coalesce("other", "low")).alias("low")
        )
        state = replace_lineage(step, state)
    lost = state.where("at is not null")
    circle = lost.select("at").distinct().join(state.select(F.col("id").alias("at"), F.col("low").alias("ring")), "at")
    ringed = lost.select("id", "at").join(circle, "at").join(names.select("id", "space"), "id").select("id", "space", "ring")
    whole = ringed.groupBy("space", "ring").agg(F.count("*").alias("whole"))
    ringed = ringed.join(whole, ["space", "ring"]).join(circle.select(F.col("at").alias("id"), F.lit(True).alias("on")), "id", "left").select("id", "ring", "whole", "on")
    tops = names.select(F.col("id").alias("top"), F.col("key").alias("top_key"))
    out = names.join(state, "id").join(ringed, "id", "left").join(tops, "top").join(links, ["space", "key"], "left")
    on = F.coalesce("on", F.lit(False))
    out = out.select(
        "space", "key", F.coalesce("ring", "top_key").alias("root_key"), F.when(on, -1).when(F.col("ring").isNotNull(), -2).otherwise(F.col("depth")).cast("int").alias("depth"),
        F.when(on, F.col("whole") - 1).otherwise(F.col("below") - 1).alias("n_descendants"), "parent", F.when(on & (F.col("key") == F.col("ring")), F.array("parent")).alias("back_edges"),
    )
    if with_paths:
        out = cut_lineage(out)
        out = out.join(_paths(out.where("depth >= 0").select("space", "key", F.col("parent").alias("via"))), ["space", "key"], "left")
    else:
        out = out.withColumn("path", F.lit(None).cast("array<string>"))
    return out.select("space", "key", "root_key", "depth", "n_descendants", "path", "back_edges")


def reach_by_doubling(placed: DataFrame, with_paths: bool = True) -> DataFrame:
    """The same rows as the walk gives, for components too large to gather, from all reachable pairs."""
    links = placed.where("parent is not null").select("space", F.col("parent").alias("a"), F.col("key").alias("d")).distinct()
    reach = cut_lineage(reachable_pairs(links))
    nodes = placed.select("space", "key").union(placed.where("parent is not null").select("space", "parent")).distinct()
    n_below = reach.where("a <> d").groupBy("space", F.col("a").alias("key")).agg(F.count("*").alias("n_descendants"))
    mutual = reach.select("space", F.col("a").alias("key"), F.col("d").alias("other")).join(
        reach.select("space", F.col("d").alias("key"), F.col("a").alias("other")), ["space", "key", "other"]
    )
    rings = mutual.groupBy("space", "key").agg(F.min("other").alias("ring"))
    below = (
        reach.join(rings.withColumnRenamed("key", "a"), ["space", "a"])
        .groupBy("space", F.col("d").alias("key"))
        .agg(F.min("ring").alias("above"))
    )
    has_parent = links.select("space", F.col("d").alias("key")).distinct()
    roots = nodes.join(has_parent, ["space", "key"], "left_anti")
    from_root = (
        reach.join(roots.withColumnRenamed("key", "a"), ["space", "a"])
        .groupBy("space", F.col("d").alias("key"))
        .agg(F.min(F.struct("far", "a")).alias("top"))
    )
    out = (
        nodes.join(n_below, ["space", "key"], "left")
        .join(rings, ["space", "key"], "left")
        .join(below, ["space", "key"], "left")
        .join(from_root, ["space", "key"], "left")
        .select(
            "space",
            "key",
            F.coalesce("ring", "above", "top.a", "key").alias("root_key"),
            F.when(F.col("ring").isNotNull(), -1).when(F.col("above").isNotNull(), -2).otherwise(F.coalesce("top.far", F.lit(0))).cast("int").alias("depth"),
            F.coalesce("n_descendants", F.lit(0)).alias("n_descendants"),
        )
    )
    from_least = rings.join(reach.select("space", F.col("a").alias("ring"), F.col("d").alias("key"), "far"), ["space", "ring", "key"])
    place = from_least.select("space", "ring", "key", F.struct(F.when(F.col("key") == F.col("ring"), 0).otherwise(F.col("far")).alias("far"), "key").alias("at"))
    closing = (
        links.join(place.withColumnsRenamed({"key": "a", "at": "from"}), ["space", "a"])
        .join(place.withColumnsRenamed({"key": "d", "at": "to"}), ["space", "ring", "d"])
        .where("to <= from")
        .groupBy("space", F.col("d").alias("key"))
        .agg(F.sort_array(F.collect_set("a")).alias("back_edges"))
    )
    if with_paths:
        good = out.where("depth >= 0").select("space", "key", "depth", "root_key")
        step = (
            links.withColumnRenamed("d", "key").join(good, ["space", "key"])
            .join(good.select("space", F.col("key").alias("a"), F.col("depth").alias("da"), F.col("root_key").alias("ra")), ["space", "a"])
            .where("da = depth - 1 and ra = root_key")
            .groupBy("space", "key").agg(F.min("a").alias("via"))
        )
        out = out.join(_paths(good.join(step, ["space", "key"], "left").select("space", "key", "via")), ["space", "key"], "left")
    else:
        out = out.withColumn("path", F.lit(None).cast("array<string>"))
    return out.join(closing, ["space", "key"], "left").select("space", "key", "root_key", "depth", "n_descendants", "path", "back_edges")


def list_below(links: list[tuple[str, str | None]]) -> Iterator[tuple[str, str, int]]:
    """(key, descendant, shortest distance) of one component; links are (child, parent or None)."""
    down: dict[str, set[str]] = {}
    for child, parent in links:
        if parent is not None:
            down.setdefault(parent, set()).add(child)
    for key in down:
        seen, level, far = {key}, [key], 0
        while level:
            far += 1
            after = []
            for n in level:
                for c in down.get(n, ()):
                    if c not in seen:
                        seen.add(c)
                        after.append(c)
                        yield key, c, far
            level = after


def _lister(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds, names = (pa.string(), pa.string(), pa.string(), pa.int32()), ["space", "key", "descendant", "distance"]

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    out: list[tuple] = []
    for held in _held(batches):
        for space, links in held.items():
            for row in list_below(links):
                out.append((space, *row))
                if len(out) == 10_000:
                    yield emit(out)
                    out = []
    if out:
        yield emit(out)


def descendants(links: DataFrame, space: str = "space", child: str = "child", parent: str = "parent", local_nodes: int = 200_000, local_dag_nodes: int = 20_000) -> DataFrame:
    """(space, key, descendant, distance): each node with every other node below it, circles and several parents included.

    Components are placed as in ``hierarchies``; those too large to gather are listed by ``reachable_pairs``.
    """
    near, far = _place(links, space, child, parent, local_nodes, local_dag_nodes)
    local = near.repartition("comp").sortWithinPartitions("comp").mapInArrow(_lister, "space string, key string, descendant string, distance int")
    back = {"space": F.nullif("space", F.lit(NO_SPACE))}
    if far is None:
        return local.withColumns(back)
    pairs = reachable_pairs(far.where("parent is not null").select("space", F.col("parent").alias("a"), F.col("key").alias("d")).distinct())
    return local.unionByName(pairs.where("a <> d").select("space", F.col("a").alias("key"), F.col("d").alias("descendant"), F.col("far").alias("distance"))).withColumns(back)

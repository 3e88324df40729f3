"""Communities: modularity clustering inside connected components, hierarchy, titles and contexts."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.text import entity_line, relation_line, strip_think
from loomspark.operators.components import components
from loomspark.operators.graph import Graph, degrees, undirected
from loomspark.storage import written

MIN_SIZE = 3
#: Temperature of the draws in Leiden's refinement, in units of weight.
RANDOMNESS = 0.01
#: Pairs of a component that one task clusters; one with more is clustered by all tasks until its sets have no more.
TASK_PAIRS = 20_000
#: Parts of those that join one node, whose running sums are taken apart; most rounds of coarsening, and of moves in each.
PARTS, MAX_ROUNDS, MOVE_ROUNDS = 256, 100, 8
#: Most rounds in which nodes are settled one by one; each raises the modularity.
SETTLE_ROUNDS = 20


def _adjacency(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int) -> tuple[list[dict[int, float]], np.ndarray]:
    """(weights to other nodes, degrees, in which a loop counts twice) of each node."""
    near: list[dict[int, float]] = [{} for _ in range(n)]
    degree = np.zeros(n)
    for x, y, v in zip(a.tolist(), b.tolist(), w.tolist(), strict=True):
        degree[x] += v
        degree[y] += v
        if x != y:
            near[x][y] = near[x].get(y, 0.0) + v
            near[y][x] = near[y].get(x, 0.0) + v
    return near, degree


def louvain(a: np.ndarray, b: np.ndarray, w: np.ndarray, total: float, resolution: float, seed: int) -> np.ndarray:
    """Community of each node 0..n-1 by local moves and aggregation; total: weight of all edges of the whole graph."""
    n = int(max(a.max(initial=-1), b.max(initial=-1))) + 1
    member = np.arange(n)
    rng = np.random.default_rng(seed)
    while True:
        near, degree = _adjacency(a, b, w, n)
        part, mass = np.arange(n), degree.copy()
        moved_any, moved, moves = False, True, 0
        while moved:
            moved = False
            for x in rng.permutation(n).tolist():
                old = part[x]
                mass[old] -= degree[x]
                gain: dict[int, float] = {old: 0.0}
                for y, v in near[x].items():
                    gain[part[y]] = gain.get(part[y], 0.0) + v
                best = max(gain.items(), key=lambda g: (g[1] - resolution * degree[x] * mass[g[0]] / (2 * total), g[0] == old, -g[0]))[0]
                mass[best] += degree[x]
                if best != old and moves < 100 * n:  # rounding may let equal gains chase each other
                    moves += 1
                    part[x], moved, moved_any = best, True, True
        _, part = np.unique(part, return_inverse=True)
        member = part[member]
        if not moved_any or part.max() + 1 == n:
            return member
        n = int(part.max()) + 1
        a, b = part[a], part[b]


def _moved(near: list[dict[int, float]], degree: np.ndarray, part: np.ndarray, scale: float, rng: np.random.Generator) -> np.ndarray:
    """part after moves of single nodes, to a neighbour's or an empty community, until none gains; scale: resolution over twice all weight."""
    n, part, mass, size = len(near), part.copy(), np.zeros(len(near)), np.zeros(len(near), int)
    np.add.at(mass, part, degree)
    np.add.at(size, part, 1)
    empty = np.flatnonzero(size == 0).tolist()
    queue = deque(rng.permutation(n).tolist())
    waiting = np.ones(n, bool)
    while queue:
        x = queue.popleft()
        waiting[x] = False
        old = part[x]
        mass[old] -= degree[x]
        size[old] -= 1
        gain: dict[int, float] = {old: 0.0}
        for y, v in near[x].items():
            gain[part[y]] = gain.get(part[y], 0.0) + v
        if size[old] and empty:
            gain[empty[-1]] = 0.0
        gain = {c: v - scale * degree[x] * mass[c] for c, v in gain.items()}
        best = max(gain, key=lambda c: (gain[c], -c))
        if gain[best] <= gain[old] + 1e-10 * degree[x]:  # rounding is no gain, so the moves end
            best = old
        if size[best] == 0 and best != old:
            empty.pop()
        mass[best] += degree[x]
        size[best] += 1
        if best != old:
            part[x] = best
            if size[old] == 0:
                empty.append(old)
            for y in sorted(near[x]):
                if part[y] != best and not waiting[y]:
                    waiting[y] = True
                    queue.append(y)
    return part


def _refined(near: list[dict[int, float]], degree: np.ndarray, part: np.ndarray, scale: float, rng: np.random.Generator) -> np.ndarray:
    """A partition within part by joins along edges: nodes alone join a well-connected set, drawn by gain."""
    n = len(near)
    whole = np.zeros(n)
    np.add.at(whole, part, degree)
    fine, mass, size = np.arange(n), degree.copy(), np.ones(n, int)
    cut = np.array([sum(v for y, v in near[x].items() if part[y] == part[x]) for x in range(n)], float)
    held = lambda s, c: cut[s] >= scale * mass[s] * (whole[c] - mass[s]) - 1e-10 * mass[s]
    for x in rng.permutation(n).tolist():
        c = part[x]
        if size[fine[x]] != 1 or not held(fine[x], c):
            continue
        links: dict[int, float] = {}
        for y, v in near[x].items():
            if part[y] == c:
                links[fine[y]] = links.get(fine[y], 0.0) + v
        gain = {s: v - scale * degree[x] * mass[s] for s, v in sorted(links.items()) if held(s, c)}
        gain = {s: g for s, g in gain.items() if g >= -1e-10 * degree[x]}
        if not gain:
            continue
        odds = np.exp((np.array(list(gain.values())) - max(gain.values())) / RANDOMNESS)
        s, own = list(gain)[int(rng.choice(len(gain), p=odds / odds.sum()))], fine[x]
        cut[s] += cut[own] - 2 * links[s]
        mass[s] += mass[own]
        size[s], size[own], fine[x] = size[s] + 1, 0, s
    return fine


def leiden(a: np.ndarray, b: np.ndarray, w: np.ndarray, total: float, resolution: float, seed: int) -> np.ndarray:
    """Community of each node 0..n-1 by local moves, refinement and aggregation of the refined sets (Traag et al. 2019).

    Every community is connected by its own edges, since sets only grow along edges. total as in louvain().
    """
    n = int(max(a.max(initial=-1), b.max(initial=-1))) + 1
    member, part = np.arange(n), np.arange(n)
    rng, scale = np.random.default_rng(seed), resolution / (2 * total)
    while True:
        near, degree = _adjacency(a, b, w, n)
        part = _moved(near, degree, part, scale, rng)
        _, fine = np.unique(_refined(near, degree, part, scale, rng), return_inverse=True)
        if fine.max(initial=-1) + 1 == n:
            return member
        n = int(fine.max()) + 1
        upper = np.zeros(n, int)
        upper[fine] = part
        _, part = np.unique(upper, return_inverse=True)
        member, a, b = fine[member], fine[a], fine[b]


def hierarchical_leiden(a: np.ndarray, b: np.ndarray, w: np.ndarray, total: float, resolution: float, seed: int, max_size: int, size: np.ndarray | None = None) -> np.ndarray:
    """leiden(), and again on the own edges of each cluster over max_size, until no cluster is or none of those divides. size: of each node, else 1."""
    member = leiden(a, b, w, total, resolution, seed)
    size = np.ones(len(member), int) if size is None else size
    top, left = int(member.max(initial=-1)), np.flatnonzero(np.bincount(member, size) > max_size).tolist()
    while left:
        c = left.pop()
        own, inside = np.flatnonzero(member == c), (member[a] == c) & (member[b] == c)
        index = np.full(len(member), -1)
        index[own] = np.arange(len(own))
        sub = leiden(index[a[inside]], index[b[inside]], w[inside], max(float(w[inside].sum()), 1e-9), resolution, seed)
        if sub.max() > 0:
            member[own] = top + 1 + sub
            left += (top + 1 + np.flatnonzero(np.bincount(sub, size[own]) > max_size)).tolist()
            top += 1 + int(sub.max())
    return member


def _ends(pairs: DataFrame) -> DataFrame:
    """(x, y, weight, x_n, y_n): pairs in both directions; a loop twice, as it counts in the degree."""
    one = lambda x, y: pairs.select(F.col(x).alias("x"), F.col(y).alias("y"), "weight", F.col(f"{x}_n").alias("x_n"), F.col(f"{y}_n").alias("y_n"))
    return one("a", "b").unionByName(one("b", "a"))


def _best(ends: DataFrame, state: DataFrame, scale: float, tie: Column, asked: DataFrame | None = None) -> DataFrame:
    """(x, k, own, to, gain, stay): for each node of state(x, k, c), or those asked(x), the community around of the highest gain, by tie if equal, and the gain of staying.

    ends(x, y, weight) are without loops. The mass of a community goes with its nodes, so that ends are shuffled twice: to
    their far nodes' communities, and back to the nodes, where all else is summed.
    """
    mass = state.groupBy("c").agg(F.sum("k").alias("mass"))
    at = written(state.select("x", "k", "c").join(mass, "c"), "community-masses")  # of known size, and read three times
    own = at.select("x", "k", F.col("c").alias("own"), F.col("mass").alias("own_mass"))
    if asked is not None:
        own, ends = own.join(asked, "x", "left_semi"), ends.join(asked, "x", "left_semi")
    near = ends.join(at.select(F.col("x").alias("y"), "c", "mass"), "y").select("x", "c", "mass", "weight")
    key = ["x", "k", "own", "own_mass"]
    # a node's own community counts even where no neighbour is in it, as does a node without any
    mine = own.select("x", F.col("own").alias("c"), F.col("own_mass").alias("mass"), F.lit(0.0).alias("weight"))
    near = near.unionByName(mine).join(own, "x").groupBy(*key, "c", "mass").agg(F.sum("weight").alias("w"))
    stays = F.col("c") == F.col("own")
    near = near.withColumn("gain", F.col("w") - scale * F.col("k") * (F.col("mass") - F.when(stays, F.col("k")).otherwise(0.0)))
    best = near.groupBy(*key).agg(F.max_by("c", F.struct(F.col("gain"), tie)).alias("to"), F.max("gain").alias("gain"), F.max(F.when(stays, F.col("gain"))).alias("stay"))
    return best.drop("own_mass")


def _moves(pairs: DataFrame, part: DataFrame | None, scale: float, seed: int) -> DataFrame:
    """(x, c): the community of each node after rounds of local moves by all tasks, from part(x, c) or each node alone.

    In a round the weights from a node to the communities around it are summed, and half of the nodes, by
    a hash that changes with the round, move to the one of the highest gain of modularity. The other
    half stays, so that two neighbours seldom trade places. The rounds end when few still move.
    """
    ends = written(_ends(pairs).select("x", "y", "weight"), "moves-ends")
    state = ends.groupBy("x").agg(F.sum("weight").alias("k"))
    state = state.withColumn("c", F.col("x")) if part is None else state.join(part, "x", "left").withColumn("c", F.coalesce("c", "x"))
    state = written(state.select("x", "k", "c", F.lit(False).alias("moved")), "moves-state")
    nodes, quiet, inner = state.count(), 0, ends.filter("x <> y")
    for r in range(MOVE_ROUNDS):
        best = _best(inner, state.select("x", "k", "c"), scale, F.xxhash64("c", F.lit(seed)))
        moves = (F.col("gain") > F.col("stay") + 1e-9 * F.col("k")) & (F.pmod(F.xxhash64("x", F.lit(seed), F.lit(r)), F.lit(2)) == 0)
        state = written(best.select("x", "k", F.when(moves, F.col("to")).otherwise(F.col("own")).alias("c"), moves.alias("moved")), "moves-state")
        quiet = quiet + 1 if state.filter("moved").count() * 200 < nodes else 0
        if quiet == 2:  # either half has been asked
            break
    return state.select("x", "c")


def _whole_parts(pairs: DataFrame, part: DataFrame, most: int) -> DataFrame | None:
    """(u, p): the nodes of each community of part that has several and at most ``most`` of the first nodes, as one set; None if there is none."""
    sizes = _ends(pairs).select("x", F.col("x_n").alias("n")).distinct()
    several = sizes.join(part, "x").groupBy("c").agg(F.count("*").alias("sets"), F.sum("n").alias("n"), F.min("x").alias("p")).filter((F.col("sets") > 1) & (F.col("n") <= most))
    joins = written(part.join(several, "c").select(F.col("x").alias("u"), "p"), "community-joins")
    return None if joins.isEmpty() else joins


def _joins(pairs: DataFrame, scale: float, most: int, r: int, part: DataFrame | None = None) -> DataFrame | None:
    """(u, p): nodes of pairs that join a neighbour in round r, of the same community of part(x, c), and those they join, by the name of the set; None: no join gains.

    A node picks the neighbour of the highest gain of modularity. It joins that if it is lighter than
    its pick and the pick is not, so sets are stars and each round has joins. Of those that join one
    node, each counts the mass of all before it as joined, so every join gains, however many there are.
    """
    ends = _ends(pairs)
    degree = written(ends.groupBy("x").agg(F.sum("weight").alias("k")), "community-degrees")
    near = ends.filter((F.col("x") != F.col("y")) & (F.col("x_n") + F.col("y_n") <= most))
    if part is not None:
        near = near.join(part.withColumnRenamed("c", "x_c"), "x").join(part.withColumnsRenamed({"x": "y", "c": "y_c"}), "y").filter("x_c = y_c")
    near = near.join(degree.withColumnRenamed("k", "x_k"), "x").join(degree.withColumnsRenamed({"x": "y", "k": "y_k"}), "y")
    near = near.withColumn("gain", F.col("weight") - scale * F.col("x_k") * F.col("y_k")).filter("gain > 0")
    best = near.groupBy("x").agg(F.max_by(F.struct("y", "weight", "x_n", "y_n", "x_k", "y_k"), F.struct("gain", F.xxhash64("y", F.lit(r)))).alias("b")).select("x", "b.*")
    best = written(best, "community-picks")
    if best.isEmpty():
        return None
    lighter = F.struct("x_k", F.xxhash64("x", F.lit(r)), "x") < F.struct(F.col("y_k").alias("x_k"), F.xxhash64("y", F.lit(r)), F.col("y").alias("x"))
    heads = best.filter(~lighter).select(F.col("x").alias("y"))
    asks = best.filter(lighter).join(heads, "y", "left_semi").withColumn("part", F.pmod(F.xxhash64("x", F.lit(-1)), F.lit(PARTS)))
    before = Window.partitionBy("y").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("y", "part").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    starts = asks.groupBy("y", "part").agg(F.sum("x_k").alias("k"), F.sum("x_n").alias("n"))
    starts = starts.select("y", "part", ahead("k", before).alias("k"), ahead("n", before).alias("n"))
    asks = asks.withColumns({"in_k": ahead("x_k", inside), "in_n": ahead("x_n", inside)}).join(starts, ["y", "part"])
    gains = F.col("weight") - scale * F.col("x_k") * (F.col("y_k") + F.col("k") + F.col("in_k")) > 0
    joins = asks.filter(gains & (F.col("x_n") + F.col("y_n") + F.col("n") + F.col("in_n") <= most)).select("x", "y")
    named = joins.groupBy("y").agg(F.least(F.min("x"), F.col("y")).alias("p"))
    return written(joins.join(named, "y").select(F.col("x").alias("u"), "p").unionByName(named.select(F.col("y").alias("u"), "p")), "community-joins")


def coarsened(keyed: DataFrame, scale: float, task_pairs: int, max_size: int | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """keyed(component, a, b, weight, a_n, b_n) with sets of nodes as nodes, until no component has more than task_pairs pairs or no join of two sets gains; and the joins(u, p) of each round.

    Smaller components stay as they are. All tasks move the nodes to communities first; joins follow inside
    of these only, as Leiden's refinement has it, and the sets move on from the community they are in.
    A set grows along edges, so it is connected; its name is its smallest member, its inner weight a loop, a_n
    and b_n its sizes, at most max_size. Where no join inside the communities gains, they become sets as they are.
    """
    maps: list[DataFrame] = []
    part: DataFrame | None = None
    most = max_size or 1 << 62
    count = lambda x: x.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > task_pairs).select("component")
    for r in range(MAX_ROUNDS):
        big = written(count(keyed), "community-large")
        if big.isEmpty():
            break
        large = written(keyed.join(big, "component", "left_semi"), "community-open")
        joins = None if part is None else _joins(large, scale, most, r, part)
        if joins is None:  # the sets move between communities where nothing is left to join inside
            part = _moves(large, part, scale, r)
            joins = _joins(large, scale, most, r, part)
        if joins is None:
            joins = _whole_parts(large, part, most)
        if joins is None:
            break
        maps.append(joins)
        part = written(part.join(joins, F.col("x") == F.col("u"), "left").groupBy(F.coalesce("p", "x").alias("x")).agg(F.min("c").alias("c")), "community-parts")
        to = lambda x, e: x.join(joins.withColumnsRenamed({"u": e, "p": f"{e}_p"}), e, "left").withColumn(e, F.coalesce(f"{e}_p", e)).drop(f"{e}_p")  # noqa: E731, B023
        sizes = large.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("a_n").alias("n")), F.struct(F.col("b").alias("u"), F.col("b_n").alias("n")))).alias("x")).select("x.*").distinct()
        sizes = written(sizes.join(joins, "u", "left").groupBy(F.coalesce("p", "u").alias("u")).agg(F.sum("n").alias("n")), "community-sizes")
        moved = to(to(large.drop("a_n", "b_n"), "a"), "b")
        moved = moved.groupBy("component", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("weight").alias("weight"))
        moved = moved.join(sizes.withColumnsRenamed({"u": "a", "n": "a_n"}), "a").join(sizes.withColumnsRenamed({"u": "b", "n": "b_n"}), "b")
        keyed = written(keyed.join(big, "component", "left_anti").unionByName(moved.select(*keyed.columns)), "community-coarse")
    return keyed, maps


def _ahead(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """rows(x, part, ...) with the sum of a value over the rows of the same key before it, by part and x; parts are summed apart."""
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(key, "part").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(key, "part").agg(F.sum(value).alias("s")).select(key, "part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s"))
    return rows.withColumn("i", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(starts, [key, "part"]).withColumn(name, F.col("s") + F.col("i")).drop("s", "i")


def _settled(pairs: DataFrame, found: DataFrame, scale: float, most: int) -> DataFrame:
    """(node_id, community): found(node_id, community) after moves of single nodes by all tasks, to the community around of the highest gain, until none gains.

    Sets that were joined are never parted again, so a node that went astray in an early round stays astray; here each is asked
    once more, alone. Of two neighbours that gain, one moves in a round, so a node always moves next to one that stays; and each
    counts the mass of all before it as moved, so every move gains, however many there are. After the first round only those
    beside a move are asked again. What a move cut off from its community becomes one.
    """
    ends = written(_ends(pairs).filter("x <> y").select("x", "y", "weight"), "settle-ends")
    degree = _ends(pairs).groupBy("x").agg(F.sum("weight").alias("k"))
    state = written(degree.join(found.select(F.col("node_id").alias("x"), F.col("community").alias("c")), "x"), "settle-state")
    nodes, asked, left = state.count(), None, None
    for r in range(SETTLE_ROUNDS):
        best = _best(ends, state, scale, F.col("c"), asked)
        wants = written(best.filter("gain > stay + 1e-9 * k").withColumn("part", F.pmod(F.xxhash64("x", F.lit(-1)), F.lit(PARTS))), "settle-wants")
        if wants.isEmpty():
            break
        who = wants.select("x")
        turn = lambda c: F.struct(F.xxhash64(c, F.lit(r)), F.col(c))  # noqa: E731, B023
        rivals = ends.join(who, "x", "left_semi").join(who.withColumnRenamed("x", "y"), "y", "left_semi").filter(turn("x") < turn("y")).select("x").distinct()
        moves = written(wants.join(rivals, "x", "left_anti").withColumn("one", F.lit(1)), "settle-asks")
        moves = _ahead(_ahead(moves, "to", "k", "came"), "own", "k", "went")
        if most < nodes:  # a community takes no more than it may hold
            sizes = state.groupBy(F.col("c").alias("to")).agg(F.count("*").alias("n"))
            moves = _ahead(moves, "to", "one", "place").join(sizes, "to").filter(F.col("n") + F.col("place") < most)
        moves = moves.filter(F.col("gain") - scale * F.col("k") * (F.col("came") + F.col("went")) > F.col("stay") + 1e-9 * F.col("k"))
        moves = written(moves.select("x", "own", "to"), "settle-moves")
        if moves.isEmpty():
            break
        state = written(state.join(moves.select("x", "to"), "x", "left").select("x", "k", F.coalesce("to", "c").alias("c")), "settle-state")
        beside = ends.join(moves.select(F.col("x").alias("y")), "y", "left_semi").select("x")
        asked = written(beside.unionByName(who.join(moves.select("x"), "x", "left_anti")).distinct(), "settle-asked")
        gone = moves.select(F.col("own").alias("c"))
        left = gone if left is None else left.unionByName(gone)
    if left is None:
        return found
    # only a community that lost a node can have come apart; a node without a link inside is alone
    open_ = state.join(left.distinct(), "c", "left_semi").select("x", "c")
    inside = ends.join(open_, "x").join(open_.withColumnsRenamed({"x": "y", "c": "y_c"}), "y").filter("c = y_c and x < y")
    part = components(inside, "x", "y").withColumnsRenamed({"node": "x", "component": "part"})
    part = open_.join(part, "x", "left").select("x", F.coalesce("part", "x").alias("part"))
    state = written(state.join(part, "x", "left"), "settle-parts")
    first = state.groupBy("c", "part").agg(F.min("x").alias("community"))
    named = state.join(first, (state["c"] == first["c"]) & state["part"].eqNullSafe(first["part"]))
    return named.select(F.col("x").alias("node_id"), "community")


def detect(pairs: DataFrame, resolution: float = 1.0, seed: int = 42, max_size: int | None = None, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """(node_id, community): pairs(a, b, weight) clustered within each connected component, against the whole graph's weight.

    community is the smallest member. With max_size by hierarchical_leiden(), else by louvain().
    A component of at most task_pairs pairs is clustered by one task; one of more is coarsened() first by all tasks,
    and one task clusters the few sets that are left. Where that ends above task_pairs, its sets are the communities.
    The nodes of such a component are _settled() one by one at the end. Where there may be one, nodes are numbered for all these rounds.
    """
    total, n = pairs.agg(F.sum("weight").cast("double"), F.count("*")).first()
    if n <= task_pairs:
        return _detected(pairs, float(total or 0.0), resolution, seed, max_size, task_pairs, "string")
    names = _numbered(pairs)
    to = lambda x, e: x.join(names.withColumnsRenamed({"node": e, "id": f"{e}_id"}), e).drop(e).withColumnRenamed(f"{e}_id", e)
    text = pairs.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), "weight")
    numbered = written(to(to(text, "a"), "b").select("a", "b", "weight"), "community-numbered")
    found = _detected(numbered, float(total or 0.0), resolution, seed, max_size, task_pairs, "bigint")
    back = lambda x, e: x.join(names.withColumnsRenamed({"id": e, "node": f"{e}_name"}), e).drop(e).withColumnRenamed(f"{e}_name", e)
    return back(back(found, "node_id"), "community").select("node_id", "community")


def _numbered(pairs: DataFrame) -> DataFrame:
    """(node, id): the ends of pairs, numbered from 0 in order of their names, so that the smallest of some nodes stays the smallest."""
    ends = pairs.filter("a is not null and b is not null").select(F.explode(F.array(F.col("a").cast("string"), F.col("b").cast("string"))).alias("node"))
    ordered = written(ends.distinct().orderBy("node").select("node", F.monotonically_increasing_id().alias("at")), "community-ordered")
    ordered = ordered.select("node", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("at"))
    ahead = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = ordered.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(ahead, F.lit(0)).alias("start"))  # one row for each task of the sort
    return written(ordered.join(F.broadcast(starts), "part").select("node", (F.col("start") + F.col("at")).alias("id")), "community-names")


def _detected(pairs: DataFrame, total: float, resolution: float, seed: int, max_size: int | None, task_pairs: int, key: str) -> DataFrame:
    """detect() of pairs whose nodes are of the type ``key``, string or bigint; total: the weight of all pairs."""
    kind = f"a {key}, b {key}, weight double, component {key}, a_n bigint, b_n bigint"
    parts = components(pairs, "a", "b")
    keyed = pairs.select("a", "b", "weight").filter("b is not null").join(parts.withColumnsRenamed({"node": "a"}), "a")
    keyed = written(keyed.select(*[F.col(c).cast(t) for c, t in (x.split(" ") for x in kind.split(", ")[:4])], F.lit(1).cast("bigint").alias("a_n"), F.lit(1).cast("bigint").alias("b_n")), "community-keyed")
    first, scale = keyed, resolution / (2 * max(total, 1e-9))
    keyed, maps = coarsened(keyed, scale, task_pairs, max_size)

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["a", "b"])  # moves depend on the order of rows
        names, at = np.unique(np.concatenate([pdf["a"], pdf["b"]]).astype(str if key == "string" else np.int64), return_inverse=True)
        a, b, w = at[: len(pdf)], at[len(pdf) :], pdf["weight"].to_numpy(float)
        size = np.zeros(len(names), np.int64)
        size[a], size[b] = pdf["a_n"], pdf["b_n"]
        fine = hierarchical_leiden(a, b, w, total, resolution, seed, max_size, size) if max_size else louvain(a, b, w, total, resolution, seed)
        low = {c: min(names[fine == c].tolist()) for c in np.unique(fine)}
        return pd.DataFrame({"node_id": names, "community": [low[c] for c in fine]})

    found = f"node_id {key}, community {key}"
    if not maps:
        return keyed.groupBy("component").applyInPandas(cluster, found)
    over = keyed.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > task_pairs).select("component")
    over = written(over, "community-over")
    sets = keyed.join(over, "component", "left_anti").groupBy("component").applyInPandas(cluster, found)
    own = keyed.join(over, "component", "left_semi").select(F.explode(F.array("a", "b")).alias("node_id")).distinct()
    sets = written(sets.unionByName(own.select("node_id", F.col("node_id").alias("community"))), "community-sets")
    members = parts.select(F.col("node").cast(key).alias("node"), F.col("node").cast(key).alias("root"))
    for m in maps:
        members = members.join(m, F.col("root") == F.col("u"), "left").select("node", F.coalesce("p", "root").alias("root"))
    every = written(members.join(sets.withColumnRenamed("node_id", "root"), "root").select(F.col("node").alias("node_id"), "community"), "community-every")
    large = written(first.join(first.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > task_pairs), "component", "left_semi"), "community-large-pairs")
    nodes = large.select(F.explode(F.array("a", "b")).alias("node_id")).distinct()
    settled = _settled(large, every.join(nodes, "node_id", "left_semi"), scale, max_size or 1 << 62)
    return every.join(nodes, "node_id", "left_anti").unionByName(settled)


def hierarchy(graph: Graph, resolution: float = 1.0, seed: int = 42, min_size: int = MIN_SIZE, algorithm: str = "leiden") -> DataFrame:
    """membership(level, community, node_id, parent): level 0 clusters of min_size or more, level 1 groups of two or more of them.

    Fewer nodes than min_size: one community of all. algorithm ``leiden`` is hierarchical_leiden() with clusters of at most max(n / 2, 2 min_size), where they divide, and has level 0 only.
    """
    n = graph.nodes.count()
    if n < min_size:
        return graph.nodes.select(F.lit(0).alias("level"), F.lit("all").alias("community"), "node_id", F.lit(None).cast("string").alias("parent"))
    pairs = written(undirected(graph.edges), "community-pairs")
    base = detect(pairs, resolution, seed, max(n // 2, 2 * min_size) if algorithm == "leiden" else None)
    base = written(base, "community-found")  # one run of the search, which sizes, edges and both levels read
    big = base.groupBy("community").count().filter(F.col("count") >= min_size).select("community")
    base = base.join(big, "community", "left_semi")
    if algorithm == "leiden":
        return base.select(F.lit(0).alias("level"), "community", "node_id", F.lit(None).cast("string").alias("parent"))
    upper = detect(community_edges(pairs, base), resolution / 2, seed).select(F.col("node_id").alias("community"), F.col("community").alias("parent"))
    groups = upper.groupBy("parent").count().filter("count >= 2").select("parent")
    upper = written(upper.join(groups, "parent", "left_semi"), "community-groups")
    level0 = base.join(upper, "community", "left").select(F.lit(0).alias("level"), "community", "node_id", "parent")
    level1 = base.join(upper, "community").select(F.lit(1).alias("level"), F.col("parent").alias("community"), "node_id", F.lit(None).cast("string").alias("parent"))
    return level0.unionByName(level1)


def community_edges(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b, weight): how many edges go between two communities."""
    m = members.select("node_id", "community")
    x = pairs.join(m.withColumnsRenamed({"node_id": "a", "community": "ca"}), "a").join(m.withColumnsRenamed({"node_id": "b", "community": "cb"}), "b").filter("ca <> cb")
    return x.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.count("*").cast("double").alias("weight"))


def titles(graph: Graph, members: DataFrame, degree: DataFrame | None = None) -> DataFrame:
    """(level, community, title, n): dominant type and the three members of the highest degree in the whole graph. degree: degrees(graph), where it is known."""
    x = members.join(graph.nodes, "node_id").join(written(degrees(graph), "degrees") if degree is None else degree, "node_id")
    key = ["level", "community"]
    kinds = x.groupBy(*key, "type").agg(F.count("*").alias("c"), F.min("ord").alias("o")).groupBy(*key).agg(F.min(F.struct((-F.col("c")).alias("c"), "o", "type"))["type"].alias("kind"), F.sum("c").alias("n"))
    ranked = x.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("degree"), "ord"))).filter("r <= 3")
    top = ranked.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda s: s["name"]), ", ").alias("names"))
    return kinds.join(top, key).select(*key, F.concat(F.coalesce("kind", F.lit("Mixed")), F.lit(" cluster: "), F.col("names")).alias("title"), "n")


def contexts(graph: Graph, members: DataFrame, max_entities: int = 30, max_edges: int = 50) -> DataFrame:
    """(level, community, context) of all communities in one pass over nodes and edges.

    What a community has is counted apart from its first rows: these alone reach the task that ranks them, however large it is.
    """
    key = ["level", "community"]
    degree = written(degrees(graph), "degrees")
    x = members.join(graph.nodes, "node_id").join(degree, "node_id")
    first = lambda rows, most, *order: rows.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("r") <= most)
    lines = lambda rows, line: rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("r", line.alias("line")))).alias("x"))
    all_ = lambda rows: rows.groupBy(*key).agg(F.count("*").alias("all"))
    more = lambda n, what: F.when(F.col("all") > n, F.format_string("\n  ... and %d more " + what, F.col("all") - n)).otherwise("")
    ents = lines(first(x, max_entities, F.desc("degree"), "ord"), entity_line(F.col("name"), F.col("type"), F.col("description"))).join(all_(x), key)
    ents = ents.select(*key, F.col("all").alias("n"), F.concat(F.array_join("x.line", "\n"), more(max_entities, "entities")).alias("entities"))
    names = graph.nodes.select("node_id", "name")
    m = members.join(names.select("node_id"), "node_id", "left_semi").select(*key, "node_id")
    e = graph.edges.join(m.withColumnRenamed("node_id", "src"), "src").join(m.withColumnRenamed("node_id", "dst"), ["dst", *key])
    e = written(e.select(*key, "src", "dst", "relation_type", "weight", "ord"), "inner-edges")
    top = first(e, max_edges, F.desc("weight"), "ord")
    top = top.join(names.withColumnsRenamed({"node_id": "src", "name": "s"}), "src").join(names.withColumnsRenamed({"node_id": "dst", "name": "t"}), "dst")
    rels = lines(top, relation_line(F.col("s"), F.col("relation_type"), F.col("t"))).join(all_(e), key)
    rels = rels.select(*key, F.concat(F.array_join("x.line", "\n"), more(max_edges, "relationships")).alias("relations"))
    head = F.format_string("Community: %s\nLevel: %d\nNumber of entities: %d\n\nENTITIES:\n", "title", "level", F.col("n"))
    return titles(graph, members, degree).drop("n").join(ents, key).join(rels, key, "left").select(*key, "title", "n", F.concat(head, "entities", F.lit("\n\nRELATIONSHIPS:\n"), F.coalesce("relations", F.lit(""))).alias("context"))


def summaries(context: DataFrame, summarise, cache: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:  # noqa: ANN001
    """context(level, community, context) with summary and context_hash: from the cache by hash of the context, else by the provider (a Column -> Column).

    Where the provider gives null and members(level, community, node_id) is given, the summary names the community's first
    five members; ``failed`` marks these, which no cache should keep.
    """
    hashed = context.withColumn("context_hash", F.sha2("context", 256))
    if cache is None:
        hits, misses = None, hashed
    else:  # the provider runs over misses only, whatever it costs
        known = cache.groupBy("context_hash").agg(F.min("summary").alias("summary"))
        hits, misses = hashed.join(known, "context_hash"), hashed.join(known, "context_hash", "left_anti")
    said = misses.withColumn("summary", F.regexp_replace(strip_think(summarise(F.col("context"))), r"^SUMMARY:\s*", ""))
    said = said if hits is None else said.unionByName(hits.select(said.columns))
    if members is None:
        return said
    key = ["level", "community"]
    said = written(said, "summaries-said")  # the provider is asked once
    lost = said.filter("summary is null").select(*key)
    r = F.row_number().over(Window.partitionBy(*key).orderBy("node_id"))
    few = members.join(lost, key, "left_semi").withColumn("r", r).filter("r <= 5").groupBy(*key).agg(F.array_sort(F.collect_list("node_id")).alias("few"))
    named = F.concat(F.lit("Community containing: "), F.array_join(F.coalesce("few", F.array().cast("array<string>")), ", "))
    return said.withColumn("failed", F.col("summary").isNull()).join(few, key, "left").withColumn("summary", F.coalesce("summary", named)).drop("few")


def intra_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """edges with level and community, for each community that holds both ends."""
    m = members.select("level", "community", "node_id")
    return edges.join(m.withColumnRenamed("node_id", "src"), "src").join(m.withColumnRenamed("node_id", "dst"), ["dst", "level", "community"])


def first_communities(nodes: DataFrame, members: DataFrame, summaries: DataFrame) -> DataFrame:
    """nodes(node_id, ...) with title and summary of the first community (by level and name) that holds them and has a summary."""
    own = nodes.join(members, "node_id").join(summaries.filter("summary <> ''"), ["level", "community"])
    best = own.groupBy("node_id").agg(F.min_by(F.struct("level", "community", "title", "summary"), F.struct("level", "community")).alias("s"))
    return nodes.join(best, "node_id").select(*nodes.columns, "s.level", "s.community", "s.title", "s.summary")


def modularity(pairs: DataFrame, members: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: the modularity of members(node_id, community) over pairs(a, b, weight); nodes outside any community are alone."""
    m = members.select("node_id", "community")
    total = pairs.agg(F.sum("weight").alias("total"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node_id"), "weight").groupBy("node_id").agg(F.sum("weight").alias("degree"))
    mass = ends.join(m, "node_id", "left").groupBy(F.coalesce("community", F.concat(F.lit("\u0000"), "node_id")).alias("c")).agg(F.sum("degree").alias("mass"))
    inside = pairs.join(m.withColumnsRenamed({"node_id": "a", "community": "ca"}), "a", "left").join(m.withColumnsRenamed({"node_id": "b", "community": "cb"}), "b", "left")
    inside = inside.filter((F.col("ca") == F.col("cb")) | (F.col("a") == F.col("b"))).agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("inside"))
    squares = mass.agg(F.sum(F.col("mass") * F.col("mass")).alias("squares"))
    one = total.join(inside, how="cross").join(squares, how="cross")  # one row each
    return one.select((F.col("inside") / F.col("total") - resolution * F.col("squares") / (4 * F.col("total") * F.col("total"))).alias("modularity"))

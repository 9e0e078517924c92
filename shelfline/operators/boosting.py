"""Gradient-boosted trees grown leaf by leaf, from histograms summed over Spark tasks.

Features are cut into quantile bins once; a missing value has a bin of its own and every split
learns which side it goes to.  A tree always splits the leaf with the largest gain next.  One job
per round sums the gradients of all leaves that may be next, per (leaf, feature, bin).  Tasks
exchange these sums by feature, and the driver gets the best split of each share of the features:
a few numbers per leaf, however many rows and tasks there are.  A leaf of at most `LOCAL_ROWS` rows
is sent to one task, which grows all that may come below it, so a tree takes one round per level
of its large nodes and one more.  These jobs run on a persisted RDD of numpy blocks: as DataFrame
jobs each took six times as long, nearly all of it planning.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.session import hand_over

# Tasks get this module's functions by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 255  # of a feature's values, at most; bin 0 is a missing value
LEAST_ROWS = 20  # of a leaf
DEPTH = 8  # of a tree, at most: a round makes the leaves of one more depth
BLOCK_ROWS = 1 << 14
LOCAL_ROWS = 1 << 18  # of a node whose subtree one task grows, at most
DIRECT_PARTS = 1  # tasks whose sums reach the driver without a reduction between
STORE_EVERY = 16  # trees after which the blocks come from the stored table again
_SLOTS = 256  # bins of a feature in a histogram
_ACCURACY = 10_000  # of the quantiles


@dataclass
class Tree:
    """Nodes in the order they were made; a leaf has left = -1 and a value."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)  # the last bin that goes left
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for name, start in zip(
            ("feature", "cut", "missing_left", "left", "right", "value", "gain"),
            (-1, 0, False, -1, -1, value, 0.0),
        ):
            getattr(self, name).append(start)
        return len(self.value) - 1

    @property
    def splits(self) -> int:
        return sum(at >= 0 for at in self.left)


@dataclass
class Forest:
    """The edges between each feature's bins, the mean to start from and the trees."""

    names: list[str]
    edges: list[np.ndarray]
    start: float
    rate: float
    trees: list[Tree]


def quantile_edges(rows: DataFrame, names: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Upper edges of each feature's bins but the last; none for a feature without a value."""
    shares = F.array(*(F.lit(n / bins) for n in range(1, bins)))
    found = rows.agg(
        *(F.percentile_approx(f"`{n}`", shares, _ACCURACY).alias(f"q{i}") for i, n in enumerate(names)),
        *(F.max(f"`{n}`").alias(f"m{i}") for i, n in enumerate(names)),
    ).first()
    edges = []
    for i in range(len(names)):
        values = np.unique(np.array(found[f"q{i}"] or [], float))
        # The largest value needs no edge: nothing lies behind it.
        edges.append(values[values < found[f"m{i}"]] if found[f"m{i}"] is not None else values)
    return edges


def binned(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """0 for a missing value, else 1 + the number of edges below the value."""
    place = np.searchsorted(edges, values, side="left") + 1
    return np.where(np.isnan(values), 0, place).astype(np.uint8)


def store_binned(rows: DataFrame, names: list[str], target: str, edges) -> DataFrame:
    """Store (y, bins), one row per block: the targets, and one byte per row and feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = (batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(edges)))
            bins = np.stack([binned(v.astype(float), e) for v, e in zip(values, edges)])
            y = batch.column(0).to_numpy(zero_copy_only=False).astype("<f8")
            cuts = [slice(at, at + BLOCK_ROWS) for at in range(0, len(y), BLOCK_ROWS)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([a[..., cut].tobytes() for cut in cuts]) for a in (y, bins)], ["y", "bins"]
            )

    given = rows.select(F.col(f"`{target}`").cast("double"), *(F.col(f"`{n}`") for n in names))
    return hand_over(given.mapInArrow(run, "y binary, bins binary"), "binned")


Block = tuple[np.ndarray, np.ndarray]  # gradients, bins of each feature


def _blocks(table: DataFrame, width: int, start: float, trees: list[Tree]) -> RDD:
    """The table's blocks with the gradients that `trees` leave; a lost one is read anew."""

    def block(row) -> Block:
        bins = np.frombuffer(row["bins"], np.uint8).reshape(width, -1)
        return _rest(np.frombuffer(row["y"], "<f8") - start, bins, trees), bins

    rows, cores = table.rdd, table.sparkSession.sparkContext.defaultParallelism
    if rows.getNumPartitions() < cores:
        rows = rows.repartition(cores)
    return rows.map(block).persist(StorageLevel.MEMORY_AND_DISK)


def _less(blocks: RDD, tree: Tree) -> RDD:
    """The blocks with the gradients that one more tree leaves, so that no round routes it again."""

    def block(part: Block) -> Block:
        pull, bins = part
        return _rest(pull, bins, [tree]), bins

    return blocks.map(block).persist(StorageLevel.MEMORY_AND_DISK)


def route(tree: Tree, bins: np.ndarray) -> np.ndarray:
    """The node that each row ends in."""
    feature, cut, left, right = (
        np.array(a) for a in (tree.feature, tree.cut, tree.left, tree.right)
    )
    missing_left = np.array(tree.missing_left)
    # Where each (node, bin) goes; a leaf keeps its rows.
    seen = np.arange(_SLOTS)
    goes_left = np.where(seen == 0, missing_left[:, None], seen <= cut[:, None])
    follows = np.where(goes_left, left[:, None], right[:, None])
    follows = np.where(left[:, None] < 0, np.arange(len(left))[:, None], follows).ravel()
    flat, rows = bins.ravel(), bins.shape[1]
    # A leaf reads the first feature, of which nothing comes.
    begin = np.maximum(feature, 0) * rows
    node, own = np.zeros(rows, np.int64), np.arange(rows)
    level, depth = [0], 0
    while level := [n for at in level if left[at] >= 0 for n in (left[at], right[at])]:
        depth += 1
    for _ in range(depth):
        node = follows.take(node * _SLOTS + flat.take(begin.take(node) + own))
    return node


def _rest(pull: np.ndarray, bins: np.ndarray, trees: list[Tree]) -> np.ndarray:
    """What is left of the gradients after the trees."""
    for tree in trees:
        pull = pull - np.array(tree.value)[route(tree, bins)]
    return pull


@dataclass
class Split:
    """The best cut of a node, and what goes to its left: the gradient sum and the rows."""

    gain: float
    feature: int
    cut: int
    missing_left: bool
    pull: float
    rows: float


@dataclass
class Node:
    """Gradient sum and rows of a node, and its split if it has one."""

    pull: float
    rows: float
    split: Split | None = None


# Per side of the missing values the best (gain, feature, cut, left gradient sum, left rows), the
# side being free if the feature lacks none; then the node's gradient sum and rows.
Tried = tuple[list[tuple[float, int, int, bool, float, float]], float, float]


def try_splits(sums: np.ndarray, least_rows: int, features: list[int]) -> Tried:
    """The best splits by some features, whose [gradient sum, rows] per bin are `sums`.

    Gains that agree up to rounding count as equal; then the first feature and cut win."""
    pull, rows = sums
    all_pull, all_rows = pull[0].sum(), rows[0].sum()
    tried = []
    for with_left in (False, True):
        add = np.s_[:, :1] if with_left else np.s_[:, :0]
        left_pull = np.cumsum(pull[:, 1:], axis=1) + pull[add].sum(axis=1, keepdims=True)
        left_rows = np.cumsum(rows[:, 1:], axis=1) + rows[add].sum(axis=1, keepdims=True)
        right_pull, right_rows = all_pull - left_pull, all_rows - left_rows
        fits = (left_rows >= least_rows) & (right_rows >= least_rows)
        gain = left_pull**2 / np.maximum(left_rows, 1) + right_pull**2 / np.maximum(right_rows, 1)
        gain = np.where(fits, gain - all_pull**2 / max(all_rows, 1), 0.0)
        at, cut = np.argwhere(gain >= gain.max() * (1 - 1e-9))[0]
        own = (gain[at, cut], features[at], cut + 1, rows[at, 0] == 0, left_pull[at, cut], left_rows[at, cut])
        tried.append(tuple(x.item() if isinstance(x, np.generic) else x for x in own))
    return tried, float(all_pull), float(all_rows)


def best_split(shares: list[Tried]) -> Node:
    """A node with the best split that any share of the features found, if one gains anything.

    Where no value is missing, a later one goes with the larger side."""
    _, all_pull, all_rows = shares[0]
    node = Node(all_pull, all_rows)
    top = max(own[0] for tried, _, _ in shares for own in tried)
    if top <= 1e-9 * max(1.0, all_pull**2 / max(all_rows, 1)):
        return node
    for side in (0, 1):
        near = [tried[side] for tried, _, _ in shares if tried[side][0] >= top * (1 - 1e-9)]
        if near:
            gain, feature, cut, free, pull, rows = min(near, key=lambda own: own[1:3])
            with_left = 2 * rows >= all_rows if free else bool(side)
            node.split = Split(gain, feature, cut, with_left, pull, rows)
            break
    return node


def _sums(
    blocks: Iterable[Block], sizes: list[int], tree: Tree, wanted: list[int]
) -> list[np.ndarray]:
    """[gradient sum, rows] per (wanted node, bin) of each feature."""
    nodes, slot = len(wanted), np.full(len(tree.value), -1)
    slot[wanted] = np.arange(nodes)
    total = [np.zeros((2, nodes * size)) for size in sizes]
    for pull, bins in blocks:
        at = slot[route(tree, bins)]
        mine = np.flatnonzero(at >= 0)
        at, pull = at[mine], pull[mine]
        for sums, size, seen in zip(total, sizes, bins):
            code = at * size + seen[mine]
            sums[0] += np.bincount(code, pull, nodes * size)
            sums[1] += np.bincount(code, minlength=nodes * size)
    return total


def _by_node(sums: list[np.ndarray], sizes: list[int], nodes: int) -> np.ndarray:
    """The sums as (node, gradients or rows, feature, bin)."""
    cells = np.zeros((nodes, 2, len(sizes), _SLOTS))
    for at, (own, size) in enumerate(zip(sums, sizes)):
        cells[:, :, at, :size] = own.reshape(2, nodes, size).transpose(1, 0, 2)
    return cells


def _best_splits(
    blocks: RDD, sizes: list[int], tree: Tree, wanted: list[int], least_rows: int
) -> dict[int, Node]:
    """The wanted nodes with their best splits.  `sizes` are the features' numbers of bins.

    A task sends its sums of each share of the features to the task that adds them, in the order of
    the tasks."""
    nodes, tasks = len(wanted), blocks.getNumPartitions()
    shares = 1 if tasks <= DIRECT_PARTS else min(len(sizes), math.isqrt(tasks - 1) + 1)

    def run(task: int, part: Iterator[Block]) -> Iterator[tuple[int, tuple[int, np.ndarray]]]:
        total = _sums(part, sizes, tree, wanted)
        for share in range(shares):
            yield share, (task, np.concatenate(total[share::shares], axis=1))

    def add(part: Iterator[tuple[int, tuple[int, np.ndarray]]]) -> Iterator[tuple[int, list[Tried]]]:
        found: dict[int, list[tuple[int, np.ndarray]]] = {}
        for share, sent in part:
            found.setdefault(share, []).append(sent)
        for share, sent in found.items():
            total = sum(own for _, own in sorted(sent, key=lambda pair: pair[0]))
            features, own = list(range(share, len(sizes), shares)), sizes[share::shares]
            sums = np.split(total, np.cumsum(own)[:-1] * nodes, axis=1)
            yield share, [try_splits(n, least_rows, features) for n in _by_node(sums, own, nodes)]

    parts = blocks.mapPartitionsWithIndex(run)
    if tasks > DIRECT_PARTS:
        parts = parts.partitionBy(shares)
    found = [tried for _, tried in sorted(parts.mapPartitions(add).collect(), key=lambda pair: pair[0])]
    return {node: best_split(list(own)) for node, own in zip(wanted, zip(*found))}


Grown = tuple[Tree, list[int], dict[int, Node]]  # with nodes that were only tried; chosen splits


def _subtrees(
    blocks: RDD, sizes: list[int], tree: Tree, level: dict[int, int], leaves: int,
    least_rows: int, depth: int,
) -> dict[int, Grown]:
    """What may come below each node of `level`, grown by one task from the node's rows."""
    wanted = list(level)
    slot = np.full(len(tree.value), -1)
    slot[wanted] = np.arange(len(wanted))

    def send(task: int, part: Iterator[Block]) -> Iterator[tuple[int, tuple[int, int, Block]]]:
        for number, (pull, bins) in enumerate(part):
            at = slot[route(tree, bins)]
            for n in range(len(wanted)):
                mine = np.flatnonzero(at == n)
                if len(mine):
                    yield n, (task, number, (pull[mine], bins[:, mine]))

    def grow(part: Iterator[tuple[int, tuple[int, int, Block]]]) -> Iterator[tuple[int, Grown]]:
        found: dict[int, list[tuple[int, int, Block]]] = {}
        for n, sent in part:
            found.setdefault(n, []).append(sent)
        for n, sent in found.items():
            sent.sort(key=lambda own: own[:2])
            pull = np.concatenate([own[0] for *_, own in sent])
            bins = np.concatenate([own[1] for *_, own in sent], axis=1)
            every = list(range(len(sizes)))

            cells: dict[int, np.ndarray] = {}

            def find(grown: Tree, nodes: list[int]) -> dict[int, Node]:
                # The larger of two siblings is the difference to their parent.
                size = np.bincount(route(grown, bins), minlength=len(grown.value))
                parent = {c: (at, a + b - c) for at, (a, b) in enumerate(zip(grown.left, grown.right))
                          if a >= 0 for c in (a, b)}
                large = {k for k in nodes if k and (-size[k], k) < (-size[parent[k][1]], parent[k][1])}
                large = {k for k in large if parent[k][1] in nodes}
                less = [k for k in nodes if k not in large]
                cells.update(zip(less, _by_node(_sums([(pull, bins)], sizes, grown, less), sizes, len(less))))
                for k in large:
                    above, sibling = parent[k]
                    cells[k] = cells[above] - cells[sibling]
                return {k: best_split([try_splits(cells[k], least_rows, every)]) for k in nodes}

            grown, chosen, nodes = _grown(find, leaves, least_rows, depth - level[wanted[n]])
            kept = {0, *(side for at in chosen for side in (grown.left[at], grown.right[at]))}
            yield n, (grown, chosen, {at: nodes[at] for at in kept})

    sent = blocks.mapPartitionsWithIndex(send).partitionBy(len(wanted), int)
    return {wanted[n]: below for n, below in sent.mapPartitions(grow).collect()}


def _grown(
    find: Callable[[Tree, list[int]], dict[int, Node]],
    leaves: int,
    least_rows: int,
    depth: int,
    below: Callable[[Tree, dict[int, int]], dict[int, Grown]] | None = None,
) -> Grown:
    """One tree, given what finds the best splits of nodes and what grows below small ones."""
    grown = Tree()
    root = grown.add(0.0)
    nodes, level = find(grown, [root]), {root: 0}
    small: list[int] = []

    def split(at: int, by: Split) -> list[int]:
        grown.feature[at], grown.cut[at] = by.feature, by.cut
        grown.missing_left[at], grown.gain[at] = by.missing_left, by.gain
        grown.left[at], grown.right[at] = grown.add(0.0), grown.add(0.0)
        # Summed as their parent's sides: the deepest nodes take no further round.
        rest = Node(nodes[at].pull - by.pull, nodes[at].rows - by.rows)
        sides = {grown.left[at]: Node(by.pull, by.rows), grown.right[at]: rest}
        nodes.update(sides)
        level.update(dict.fromkeys(sides, level[at] + 1))
        return list(sides)

    def graft(at: int, tree: Tree, chosen: list[int], found: dict[int, Node]) -> None:
        place = {0: at}
        nodes[at].split = found[0].split
        for n in chosen:
            for side, child in zip((tree.left[n], tree.right[n]), split(place[n], found[n].split)):
                place[side], nodes[child] = child, found[side]
        for n, child in place.items():
            if n not in chosen:
                nodes[child].split = None  # beyond what the whole tree may have

    while True:
        # Replay the queue: always the leaf with the largest gain, as far as children are known.
        queue, chosen, ahead = [root], [], []
        while len(chosen) < leaves - 1:
            able = [n for n in queue if nodes[n].split]
            if not able:
                break
            best = max(able, key=lambda n: (nodes[n].split.gain, -n))
            if grown.left[best] < 0:
                # Also leaves of nodes that are not chosen yet: most of them will be.
                able = [n for n, node in nodes.items() if node.split and grown.left[n] < 0]
                able.sort(key=lambda n: (n != best, -nodes[n].split.gain, n))
                ahead = able[: leaves - 1 - len(chosen)]
                break
            chosen.append(best)
            queue.remove(best)
            queue += [grown.left[best], grown.right[best]]
        if not ahead and not small:
            return grown, chosen, nodes
        if not ahead:
            # Large nodes that are chosen beside these are chosen without them as well.
            for at, found in below(grown, {n: level[n] for n in small}).items():
                graft(at, *found)
            small = []
            continue
        able = [child for at in ahead for child in split(at, nodes[at].split)]
        able = [n for n in able if level[n] < depth and nodes[n].rows >= 2 * least_rows]
        fits = {n for n in able if below and nodes[n].rows <= LOCAL_ROWS}
        small += [n for n in able if n in fits]
        if wanted := [n for n in able if n not in fits]:
            nodes |= find(grown, wanted)


def _grow(rows: RDD, sizes: list[int], leaves: int, least_rows: int, depth: int) -> Tree:
    """One tree; rounds as jobs, small nodes by a task each."""

    def find(grown: Tree, nodes: list[int]) -> dict[int, Node]:
        return _best_splits(rows, sizes, grown, nodes, least_rows)

    def below(grown: Tree, level: dict[int, int]) -> dict[int, Grown]:
        return _subtrees(rows, sizes, grown, level, leaves, least_rows, depth)

    return _chosen_tree(*_grown(find, leaves, least_rows, depth, below))


def _chosen_tree(grown: Tree, chosen: list[int], nodes: dict[int, Node]) -> Tree:
    """The tree of the chosen splits alone; leaves get the mean gradient of their rows."""
    tree, kept = Tree(), set(chosen)

    def copy(node: int) -> int:
        pull, rows = nodes[node].pull, nodes[node].rows
        at = tree.add(pull / rows if rows else 0.0)
        if node in kept:
            tree.feature[at], tree.cut[at] = grown.feature[node], grown.cut[node]
            tree.missing_left[at], tree.gain[at] = grown.missing_left[node], grown.gain[node]
            tree.left[at], tree.right[at] = copy(grown.left[node]), copy(grown.right[node])
        return at

    copy(0)
    return tree


def fit_forest(
    rows: DataFrame,
    names: list[str],
    target: str,
    trees: int,
    rate: float,
    leaves: int,
    least_rows: int = LEAST_ROWS,
    depth: int = DEPTH,
    bins: int = BINS,
) -> Forest:
    """Fit to the squared error.  `rows` has double features (NULL or NaN: missing) and a target
    that is never missing; pass a stored table."""
    start = rows.agg(F.avg(f"`{target}`")).first()[0]
    if start is None:
        raise ValueError("there are no training rows")
    edges = quantile_edges(rows, names, bins)
    table = store_binned(rows, names, target, edges)
    forest = Forest(names, edges, start, rate, [])
    sizes = [len(e) + 2 for e in edges]
    blocks, before = _blocks(table, len(names), start, []), None
    for number in range(trees):
        if number:
            before = blocks
            if number % STORE_EVERY:
                blocks = _less(before, forest.trees[-1])
            else:
                blocks = _blocks(table, len(names), start, forest.trees[:])
        tree = _grow(blocks, sizes, leaves, least_rows, depth)
        if before is not None:
            before.unpersist()
        tree.value = [rate * v for v in tree.value]
        forest.trees.append(tree)
    blocks.unpersist()
    return forest


def add_prediction(df: DataFrame, forest: Forest, inputs: list[Column], name: str) -> DataFrame:
    """Add the forest's value as `name`; `inputs` are the features as doubles."""

    @F.pandas_udf("double")
    def predict(*series):
        import pandas as pd

        columns = [
            binned(s.to_numpy(dtype=float, na_value=np.nan), e) for s, e in zip(series, forest.edges)
        ]
        bins = np.stack(columns)
        return pd.Series(-_rest(np.full(bins.shape[1], -forest.start), bins, forest.trees))

    return df.withColumn(name, predict(*inputs))


def node_rows(forest: Forest) -> list[tuple]:
    """(tree, node, feature, edge, missing_left, left, right, value, gain) of every node: a value
    up to the edge goes left, without an edge any value does."""
    out = []
    for number, tree in enumerate(forest.trees):
        for n in range(len(tree.value)):
            inner = tree.left[n] >= 0
            edges = forest.edges[tree.feature[n]] if inner else []
            edge = float(edges[tree.cut[n] - 1]) if inner and tree.cut[n] <= len(edges) else None
            out.append(
                (
                    number,
                    n,
                    forest.names[tree.feature[n]] if inner else None,
                    edge,
                    bool(tree.missing_left[n]) if inner else None,
                    tree.left[n] if inner else None,
                    tree.right[n] if inner else None,
                    None if inner else tree.value[n],
                    tree.gain[n] if inner else None,
                )
            )
    return out


NODES = (
    "tree int, node int, feature string, edge double, missing_left boolean, left int, right int, "
    "value double, gain double"
)

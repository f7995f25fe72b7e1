"""Tree ensembles grown from histograms: second-order boosting and random forests.

Rows are binned once and kept as blocks of small integers. Each pass sends the trees as they are to
the blocks, adds up per open node, feature and bin what a split is judged by (gradients and
Hessians, or class weights), first in the tasks and then, node by node, over them; the best split
of a node is chosen in the task that has its sums, and it alone comes back: the driver sees some
numbers per node, whatever the rows, features and bins. Every draw (rows of a round, bootstrap
counts, features of a node) is a hash of row, tree and node, so a block that is lost is computed
again to the same values, and the model does not depend on how rows are dealt out.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SKETCH_ACCURACY = 10_000
# a pass over this many rows takes about as long as the start of a Spark job for it
ROWS_PER_BLOCK = 150_000
# trees after which the blocks' margins are worked out anew from all trees, which keeps lineage short
TREES_PER_STATE = 25
# bytes of histograms that a task may hold in one pass, and that are shuffled as one piece
PASS_BYTES = 64 << 20
PIECE_BYTES = 1 << 20
# tasks that share the trees of a forest whose rows are in one block
FOREST_TASKS = 16
_U = np.uint64
NODE_COLUMNS = ("tree", "node", "feature", "threshold", "left", "right", "value", "cover")
NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int, "
               "value double, cover double")


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """Evenly spread 64-bit numbers from numbers and a salt (the finaliser of SplitMix64)."""
    x = x ^ _U(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def uniform(rows: np.ndarray, salt: int) -> np.ndarray:
    return (mixed(rows, salt) >> _U(11)) * 2.0 ** -53


_POISSON = np.cumsum(np.exp(-1) / np.array([1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880]))


def bootstrap_counts(rows: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is in a tree's bootstrap sample: Poisson with mean 1, by its hash."""
    return np.searchsorted(_POISSON, uniform(rows, seed * 1_000_003 + tree + 1), side="right")


def drawn_features(n: int, k: int, *salt: int) -> np.ndarray:
    return np.sort(np.random.default_rng(salt).permutation(n)[:k])


# --- rows as blocks -----------------------------------------------------------

@dataclass(frozen=True)
class Block:
    """Some rows: bin of every feature, class, identity, and in boosting the margin so far."""

    bins: np.ndarray
    label: np.ndarray
    row: np.ndarray
    margin: np.ndarray | None = None


def fit_cuts(df: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Ascending cut points of each feature at approximate quantiles; ``x <= cut`` is the left side."""
    shares = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(c, shares, SKETCH_ACCURACY).alias(c)
                   for c in features]).first()
    return [np.unique(np.array(row[c] or [], "float64")) for c in features]


def as_blocks(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str],
              cuts: Sequence[np.ndarray]) -> RDD:
    """The rows as persisted blocks of up to ``ROWS_PER_BLOCK`` rows, or one Arrow batch if that is more.

    There are at most as many tasks as run at once, and a task holds several blocks if need be: every
    task of every pass reports to the driver, so their number must not follow the rows. Rows are
    binned where they are, and dealt out afterwards.
    """
    features = list(features)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for n, batch in enumerate(batches):
            columns = [np.searchsorted(c, batch.column(i + 2).to_numpy(zero_copy_only=False))
                       for i, c in enumerate(cuts)]
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "batch": pa.array([n], pa.int32()),
                "bins": [np.stack(columns, 1).astype(np.uint8).tobytes()],
                "label": [batch.column(1).to_numpy(zero_copy_only=False).astype(np.int8).tobytes()],
                "row": [batch.column(0).to_numpy(zero_copy_only=False).tobytes()]})

    def joined(parts: list) -> Block:
        return Block(np.concatenate([np.frombuffer(p.bins, np.uint8).reshape(
            -1, len(features)) for p in parts]),
            np.concatenate([np.frombuffer(p.label, np.int8) for p in parts]),
            np.concatenate([np.frombuffer(p.row, np.int64).view(_U) for p in parts]))

    def join(parts) -> Iterator[Block]:
        held, size = [], 0
        for _, part in parts:
            if held and size + len(part.label) > ROWS_PER_BLOCK:
                yield joined(held)
                held, size = [], 0
            held.append(part)
            size += len(part.label)
        if held:
            yield joined(held)

    rows = df.select(F.xxhash64(*keys).alias("_row"), F.col(label).cast("int"),
                     *[F.col(c).cast("double") for c in features])
    tasks = max(1, min(-(-df.count() // ROWS_PER_BLOCK),
                       max(2, df.sparkSession.sparkContext.defaultParallelism)))
    encoded = rows.mapInArrow(encode, "part int, batch int, bins binary, label binary, row binary")
    # in turns, and in the order of the rows: sums come out the same each time
    dealt = encoded.rdd.map(lambda p: ((p.part, p.batch), p)).repartitionAndSortWithinPartitions(
        tasks, sum)
    return dealt.mapPartitions(join).persist(StorageLevel.MEMORY_AND_DISK)


# --- trees --------------------------------------------------------------------

@dataclass
class Tree:
    """A tree over bins; ``feature`` is -1 at leaves, ``sums`` what the rows of a node add up to."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    depth: list[int] = field(default_factory=lambda: [0])
    sums: list = field(default_factory=lambda: [None])

    def split(self, node: int, feature: int, cut: int, left, right) -> tuple[int, int]:
        n = len(self.feature)
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, n, n + 1
        for child, sums in ((n, left), (n + 1, right)):
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(child)
            self.right.append(child)
            self.depth.append(self.depth[node] + 1)
            self.sums.append(sums)
        return n, n + 1

    def packed(self) -> "PackedTree":
        feature = np.array(self.feature)
        return PackedTree(np.maximum(feature, 0), np.where(feature < 0, 255, self.cut),
                          np.array(self.left), np.array(self.right), max(self.depth))

    def kept(self, splits: set[int]) -> "Tree":
        """The tree with only some of its splits; they must include all above them."""
        out, todo = Tree(sums=[self.sums[0]]), [(0, 0)]
        while todo:
            old, new = todo.pop()
            if old in splits:
                a, b = out.split(new, self.feature[old], self.cut[old],
                                 self.sums[self.left[old]], self.sums[self.right[old]])
                todo += [(self.left[old], a), (self.right[old], b)]
        return out


@dataclass(frozen=True)
class PackedTree:
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    levels: int

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(self.levels):
            at = np.where(bins[rows, self.feature[at]] <= self.cut[at], self.left[at],
                          self.right[at])
        return at


def histograms(bins: np.ndarray, slot: np.ndarray, features: np.ndarray, stats: np.ndarray,
               width: int) -> np.ndarray:
    """Sums of ``stats`` (a row per kind) as [kind, slot, feature of the slot, bin].

    ``slot`` is each row's open node, ``features`` the features that each slot looks at.
    """
    slots, k = features.shape
    rows = np.arange(len(bins))[:, None]
    index = ((slot[:, None] * k + np.arange(k)) * width + bins[rows, features[slot]]).ravel()
    return np.stack([np.bincount(index, np.repeat(s, k), slots * k * width)
                     for s in stats]).reshape(len(stats), slots, k, width)


class LocalBlocks(list):
    """Blocks inside a task; grown on like an RDD of them."""

    def map(self, function: Callable[[Block], Block]) -> "LocalBlocks":
        return LocalBlocks(map(function, self))


def added(blocks: RDD | LocalBlocks, function: Callable[[Block], np.ndarray]) -> np.ndarray:
    """The sum of ``function`` over all blocks; tasks add up their own first, then in a tree."""
    if isinstance(blocks, LocalBlocks):
        return sum(map(function, blocks))

    def sums(part):
        total = None
        for block in part:
            found = function(block)
            total = found if total is None else total + found
        return [] if total is None else [total]

    return blocks.mapPartitions(sums).treeReduce(lambda a, b: a + b)


def best_splits(found: np.ndarray, gain: Callable[[np.ndarray, np.ndarray], np.ndarray]
                ) -> list[tuple]:
    """Per slot the best (gain, place of the feature, bin, left sums, right sums).

    ``gain`` gets left and right sums [kind, slot, feature, bin] and gives -inf where a split is not
    allowed. Of equal gains the first feature and the lowest bin count.
    """
    total = found.cumsum(axis=-1)
    left, right = total[..., :-1], total[..., -1:] - total[..., :-1]
    gains = gain(left, right)
    best = gains.reshape(len(gains), -1).argmax(axis=1)
    place = np.unravel_index(best, gains.shape[1:])
    at = (np.arange(len(gains)), *place)
    return list(zip(gains[at].tolist(), place[0].tolist(), place[1].tolist(),
                    left[(slice(None), *at)].T.tolist(), right[(slice(None), *at)].T.tolist()))


def judged(blocks: RDD | LocalBlocks, function: Callable[[Block], np.ndarray], slots: int,
           slot_bytes: int, gain: Callable) -> list[tuple]:
    """``best_splits`` of the sum of ``function`` over all blocks, and each slot's own sums.

    Over tasks, slots are shuffled in pieces and judged where they are added up, so that the
    driver never sees a histogram.
    """
    def judge(found: np.ndarray) -> list[tuple]:
        sums = found[:, :, 0].sum(axis=-1).T.tolist()
        return [(*best, own) for best, own in zip(best_splits(found, gain), sums)]

    if isinstance(blocks, LocalBlocks):
        return judge(added(blocks, function))
    step = max(1, PIECE_BYTES // slot_bytes)

    def pieces(part):
        total = None
        for block in part:
            found = function(block)
            total = found if total is None else total + found
        for first in range(0, 0 if total is None else slots, step):
            yield first // step, total[:, first:first + step]

    tasks = min(-(-slots // step), blocks.getNumPartitions())
    found = dict(blocks.mapPartitions(pieces).reduceByKey(lambda a, b: a + b, tasks)
                 .mapValues(judge).collect())
    return [best for piece in sorted(found) for best in found[piece]]


# --- boosting -----------------------------------------------------------------

@dataclass(frozen=True)
class Boosting:
    """Second-order boosting of the logistic loss.

    ``maxLeaves`` 0 grows level by level to ``maxDepth``; else the open node with the greatest gain is
    split next until a tree has that many leaves. A share ``subsamplingRate`` of the rows is
    drawn for each tree, and a share ``columnRate`` of the features once per tree. Positives weigh
    negatives / positives.
    """

    maxIter: int = 500
    stepSize: float = 0.05
    maxDepth: int = 6
    maxLeaves: int = 0
    subsamplingRate: float = 1.0
    columnRate: float = 0.8
    penalty: float = 1.0
    minHessian: float = 1.0
    minInstancesPerNode: int = 1
    maxBins: int = 255
    seed: int = 42

    def fit(self, df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str]
            ) -> "TreeModel":
        cuts = fit_cuts(df, features, self.maxBins)
        blocks = as_blocks(df, features, label, keys, cuts)
        n = len(features)
        try:
            if blocks.getNumPartitions() > 1:
                trees = self.grow(blocks, n)
            else:
                # a job for each of thousands of passes would cost far more than the passes
                trees = blocks.mapPartitions(
                    lambda part: [self.grow(LocalBlocks(part), n)]).collect()[0]
        finally:
            blocks.unpersist()
        return TreeModel.of(trees, cuts, self._value, True)

    def _value(self, sums) -> float:
        return -self.stepSize * np.float64(sums[0]) / (np.float64(sums[1]) + self.penalty)

    def _gain(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        def score(g, h):
            return g * g / np.maximum(h + self.penalty, 1e-16)

        whole = (left + right)[:2, ..., :1]
        allowed = ((np.minimum(left[1], right[1]) >= self.minHessian)
                   & (np.minimum(left[2], right[2]) >= max(1, self.minInstancesPerNode)))
        return np.where(allowed, score(*left[:2]) + score(*right[:2]) - score(*whole), -np.inf)

    def grow(self, blocks: RDD | LocalBlocks, n: int) -> list[Tree]:
        """The trees for blocks of ``n`` features."""
        negatives, positives = added(blocks, lambda b: np.bincount(b.label, minlength=2)[:2])
        weight = float(negatives / max(1, positives))
        local = isinstance(blocks, LocalBlocks)
        trees, values, state, older = [], [], blocks.map(lambda b: moved(b, [])), None
        for t in range(self.maxIter):
            trees.append(self._tree(state, t, n, weight))
            if older is not None:
                older.unpersist()  # its successor is complete: the tree was measured on it
                older = None
            if t + 1 == self.maxIter:
                break
            values.append((trees[-1].packed(), np.array([self._value(s) for s in trees[-1].sums])))
            if local:
                state = state.map(lambda b: moved(b, values[-1:]))
                continue
            if t:
                older = state
            if len(values) % TREES_PER_STATE:
                state = state.map(lambda b, v=values[-1:]: moved(b, v))
            else:
                state = blocks.map(lambda b, v=list(values): moved(b, v))
            state = state.persist(StorageLevel.MEMORY_AND_DISK)
        if not local and self.maxIter > 1:
            state.unpersist()
        return trees

    def _tree(self, state: RDD | LocalBlocks, t: int, n: int, weight: float) -> Tree:
        columns = drawn_features(n, max(1, int(self.columnRate * n)), self.seed, t)
        tree, share, width, seed = Tree(), self.subsamplingRate, self.maxBins, self.seed
        local = isinstance(state, LocalBlocks)
        held: dict[int, np.ndarray] = {}
        splits: dict[int, tuple] = {}

        def sums_of(nodes: list[int]) -> Callable[[Block], np.ndarray]:
            packed = tree.packed()
            slots = np.full(len(tree.feature), -1)
            slots[nodes] = np.arange(len(nodes))

            def sums(block: Block) -> np.ndarray:
                slot = slots[packed.nodes(block.bins)]
                wanted = slot >= 0
                if share < 1:
                    wanted &= uniform(block.row, seed * 1_000_003 + t + 1) < share
                at = np.flatnonzero(wanted)
                label, p = block.label[at], 1 / (1 + np.exp(-block.margin[at]))
                w = np.where(label == 1, weight, 1.0)
                return histograms(block.bins[at], slot[at], np.tile(columns, (len(nodes), 1)),
                                  np.stack([w * (p - label), w * p * (1 - p),
                                            np.ones(len(at))]), width)

            return sums

        def look(nodes: list[int], bests: list[tuple]) -> None:
            for node, best in zip(nodes, bests):
                if best[0] > 1e-6:
                    splits[node] = (best[0], int(columns[best[1]]), *best[2:5])

        def measure(small: list[int], pairs: list[tuple[int, int, int]]) -> None:
            """Judge new nodes; ``pairs`` are (parent, child in ``small``, its sibling).

            Inside a task the sibling is the parent less the child. Over tasks, both are measured:
            sums that are kept would have to be so by the driver.
            """
            nodes = [*small, *[more for _, _, more in pairs]]
            if local:
                found = added(state, sums_of(small))
                if pairs:
                    others = np.stack([held.pop(node) for node, _, _ in pairs], 1) - found
                    found = np.concatenate([found, others], 1)
                held.update((node, found[:, i]) for i, node in enumerate(nodes))
                bests = best_splits(found, self._gain)
                if not pairs:
                    tree.sums[0] = found[:, 0, 0].sum(axis=-1).tolist()
            else:
                bests = judged(state, sums_of(nodes), len(nodes), 24 * len(columns) * width,
                               self._gain)
                if not pairs:
                    tree.sums[0] = bests[0][5]
            look(nodes, bests)

        def open_up(parents: list[int]) -> None:
            """Split nodes and judge their children; the smaller one of each pair comes first."""
            small, pairs = [], []
            for node in parents:
                _, feature, cut, left, right = splits[node]
                a, b = tree.split(node, feature, cut, left, right)
                pairs.append((node, a, b) if left[2] <= right[2] else (node, b, a))
                small.append(pairs[-1][1])
            if not all(tree.depth[x] >= self.maxDepth for x in small) or self.maxLeaves:
                measure(small, pairs)

        measure([0], [])
        if not self.maxLeaves:
            frontier = [0] if 0 in splits else []
            while frontier:
                size = len(tree.feature)
                open_up(frontier)
                frontier = [x for x in range(size, len(tree.feature))
                            if x in splits and tree.depth[x] < self.maxDepth]
            return tree
        while True:
            chosen, unknown = best_first(tree, splits, self.maxLeaves - 1)
            if not unknown:
                return tree.kept(chosen)
            # carried out and measured in one pass; whether they stay is decided at the end
            open_up(unknown)


def best_first(tree: Tree, splits: dict[int, tuple], most: int) -> tuple[set[int], list[int]]:
    """The splits that best-first growth takes, and those among them with unknown children.

    While children are unknown the growth goes on without them: what it takes after that may not
    be in the final tree, but is likely needed and is measured in the same pass.
    """
    chosen, unknown = set(), []
    queue = [(-splits[0][0], 0)] if 0 in splits else []
    while queue and len(chosen) < most:
        _, node = heapq.heappop(queue)
        chosen.add(node)
        if tree.feature[node] < 0:
            unknown.append(node)
            continue
        for child in (tree.left[node], tree.right[node]):
            if child in splits:
                heapq.heappush(queue, (-splits[child][0], child))
    return chosen, unknown


def moved(block: Block, trees: list[tuple[PackedTree, np.ndarray]]) -> Block:
    """The block with its margin after some more trees; the first one starts from 0."""
    margin = np.zeros(len(block.label)) if block.margin is None else block.margin.copy()
    for packed, values in trees:
        margin += values[packed.nodes(block.bins)]
    return replace(block, margin=margin)


# --- random forest ------------------------------------------------------------

@dataclass(frozen=True)
class Forest:
    """A random forest by Gini impurity with classes balanced in each tree's bootstrap sample."""

    numTrees: int = 500
    maxDepth: int = 14
    minInstancesPerNode: int = 5
    maxBins: int = 64
    seed: int = 42

    def fit(self, df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str]
            ) -> "TreeModel":
        cuts = fit_cuts(df, features, self.maxBins)
        blocks = as_blocks(df, features, label, keys, cuts)
        n, count = len(features), self.numTrees
        try:
            if blocks.getNumPartitions() > 1:
                trees = self.grow(blocks, n)
            else:
                # the trees are independent: each of some tasks gets the block and grows its own
                tasks = max(1, min(FOREST_TASKS, count))
                shares = (blocks.flatMap(lambda b: [(i, b) for i in range(tasks)])
                          .partitionBy(tasks, lambda i: i)
                          .mapValues(lambda b: [b])
                          .map(lambda x: (x[0], self.grow(LocalBlocks(x[1]), n,
                                                          range(x[0], count, tasks))))
                          .collect())
                trees = [None] * count
                for i, own in shares:
                    trees[i::tasks] = own
        finally:
            blocks.unpersist()
        return TreeModel.of(trees, cuts, lambda s: s[1] / (s[0] + s[1]) if s[0] + s[1] else 0.0,
                            False)

    def class_counts(self, blocks: RDD | LocalBlocks, which: Sequence[int] | None = None
                     ) -> np.ndarray:
        """Rows of each class in each tree's bootstrap sample, repeats included: [tree, class]."""
        which, seed = range(self.numTrees) if which is None else which, self.seed
        return added(blocks, lambda b: np.stack([np.bincount(
            b.label, bootstrap_counts(b.row, t, seed), 2)[:2] for t in which]))

    @staticmethod
    def balanced(counts: np.ndarray) -> np.ndarray:
        """Weights [tree, class] by which the classes that a sample has weigh the same."""
        present = (counts > 0).sum(axis=1, keepdims=True)
        return np.divide(counts.sum(axis=1, keepdims=True), present * counts,
                         out=np.zeros(counts.shape), where=counts > 0)

    def _gain(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        def purity(a, b):
            return (a * a + b * b) / np.maximum(a + b, 1e-300)

        whole = (left + right)[:2, ..., :1]
        allowed = np.minimum(left[2], right[2]) >= max(1, self.minInstancesPerNode)
        return np.where(allowed, purity(*left[:2]) + purity(*right[:2]) - purity(*whole), -np.inf)

    def grow(self, blocks: RDD | LocalBlocks, n: int, which: Sequence[int] | None = None
             ) -> list[Tree]:
        """The trees, or those numbered ``which``, for blocks of ``n`` features."""
        which = range(self.numTrees) if which is None else which
        weights = dict(zip(which, self.balanced(self.class_counts(blocks, which))))
        k, width, seed = max(1, int(n ** 0.5)), self.maxBins, self.seed
        trees = {t: Tree() for t in which}
        frontier = [(t, 0) for t in which]
        slot_bytes = k * width * 3 * 8
        at_once = max(1, PASS_BYTES // slot_bytes)

        def measure(part: list[tuple[int, int]], features: np.ndarray) -> list[tuple]:
            by_tree: dict[int, list[tuple[int, int]]] = {}
            for slot, (t, node) in enumerate(part):
                by_tree.setdefault(t, []).append((node, slot))
            work = []
            for t, pairs in by_tree.items():
                slots = np.full(len(trees[t].feature), -1)
                slots[[x[0] for x in pairs]] = [x[1] for x in pairs]
                work.append((t, trees[t].packed(), slots, weights[t]))

            def sums(block: Block) -> np.ndarray:
                total = np.zeros((3, len(features), k, width))
                for t, packed, slots, weight in work:
                    times = bootstrap_counts(block.row, t, seed)
                    slot = np.where(times > 0, slots[packed.nodes(block.bins)], -1)
                    at = np.flatnonzero(slot >= 0)
                    if not len(at):
                        continue
                    label, first, last = block.label[at], slot[at].min(), slot[at].max() + 1
                    w = times[at] * weight[label]
                    total[:, first:last] += histograms(
                        block.bins[at], slot[at] - first, features[first:last],
                        np.stack([w * (label == 0), w * (label == 1), np.ones(len(at))]), width)
                return total

            return judged(blocks, sums, len(part), slot_bytes, self._gain)

        while frontier:
            following = []
            for i in range(0, len(frontier), at_once):
                part = frontier[i:i + at_once]
                features = np.stack([drawn_features(n, k, seed, t, node) for t, node in part])
                for (t, node), own, best in zip(part, features, measure(part, features)):
                    tree = trees[t]
                    if tree.sums[node] is None:
                        tree.sums[node] = best[5]
                    if best[0] <= 1e-12:
                        continue
                    children = tree.split(node, int(own[best[1]]), *best[2:5])
                    following += [(t, c) for c in children if tree.depth[c] < self.maxDepth
                                  and tree.sums[c][2] >= 2 * self.minInstancesPerNode
                                  and min(tree.sums[c][:2]) > 0]
            frontier = following
        return list(trees.values())


# --- fitted ensembles ---------------------------------------------------------

@dataclass(frozen=True)
class TreeModel:
    """A fitted ensemble: a table of nodes of a size set by its parameters.

    ``boosted`` ensembles add up their leaves' values to a margin; the others average them.
    """

    nodes: pd.DataFrame
    boosted: bool

    @staticmethod
    def of(trees: Sequence[Tree], cuts: Sequence[np.ndarray], value: Callable, boosted: bool
           ) -> "TreeModel":
        parts = []
        for t, tree in enumerate(trees):
            feature = np.array(tree.feature)
            threshold = [float(cuts[f][min(c, len(cuts[f]) - 1)]) if f >= 0 else 0.0
                         for f, c in zip(tree.feature, tree.cut)]
            leaf = feature < 0
            parts.append(pd.DataFrame({
                "tree": np.int32(t), "node": np.arange(len(feature), dtype=np.int32),
                "feature": feature.astype(np.int32), "threshold": threshold,
                "left": np.where(leaf, -1, tree.left).astype(np.int32),
                "right": np.where(leaf, -1, tree.right).astype(np.int32),
                "value": [float(value(s)) for s in tree.sums],
                # what passed through the node: Hessians or class weights
                "cover": [float(s[1] if boosted else s[0] + s[1]) for s in tree.sums]}))
        return TreeModel(pd.concat(parts, ignore_index=True), boosted)

    @property
    def getNumTrees(self) -> int:
        return int(self.nodes["tree"].max()) + 1

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(pa.Table.from_pandas(self.nodes, preserve_index=False),
                                     NODE_SCHEMA)

    @staticmethod
    def read(table: DataFrame, boosted: bool) -> "TreeModel":
        return TreeModel(table.orderBy("tree", "node").toPandas(), boosted)

    def packed(self) -> list[tuple]:
        out = []
        for _, t in self.nodes.groupby("tree", sort=True):
            feature, node = t["feature"].to_numpy(), np.arange(len(t))
            left = np.where(feature < 0, node, t["left"].to_numpy())
            right = np.where(feature < 0, node, t["right"].to_numpy())
            out.append((np.maximum(feature, 0), t["threshold"].to_numpy(), left, right,
                        t["value"].to_numpy()))
        return out


def leaf_values(x: np.ndarray, trees: list[tuple]) -> Iterator[np.ndarray]:
    """Per tree the value of the leaf of every row."""
    rows = np.arange(len(x))
    for feature, threshold, left, right, value in trees:
        at = np.zeros(len(x), np.int64)
        while True:
            below = np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at])
            if (below == at).all():
                break
            at = below
        yield value[at]


def probabilities(x: np.ndarray, trees: list[tuple], boosted: bool) -> np.ndarray:
    total = sum(leaf_values(x, trees), np.zeros(len(x)))
    return 1 / (1 + np.exp(-total)) if boosted else total / len(trees)


def probability_column(spark: SparkSession, models: Sequence[TreeModel],
                       features: Sequence[str]) -> Column:
    """The probabilities by several models as one array; the models are broadcast once each."""
    shared = [spark.sparkContext.broadcast((m.packed(), m.boosted)) for m in models]

    @F.pandas_udf("array<double>")
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            x = batch.to_numpy(dtype="float64")
            found = np.stack([probabilities(x, *s.value) for s in shared], 1)
            yield pd.Series(list(found))

    return score(F.struct(*features))

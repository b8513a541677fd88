"""Histogram gradient boosting of a binary label, with dropout of earlier trees.

Features are binned once: edges come from at most `SAMPLE` rows, chosen by a hash of their id, and a bin of
its own stands for missing values, which each split sends to the side where they fit better. A level of a tree
is one pass over the binned rows: each task adds up gradients, curvatures and rows by node, feature and bin,
and tasks' histograms are added by node and feature, so that what reaches the driver has the size of the
model's frontier and not of the data. Sums are of integers (gradients in units of 2 ** -24), so a model is
the same in any order and dealing of rows. Dropout leaves out some earlier trees while a new one is
fitted, and scales both afterwards. Rows carry the leaf that each earlier tree gave them, a byte a tree, in
a table that is written anew every `SAVE` trees: lineage doesn't grow, and no pass evaluates more than SAVE trees.

Rows without a label take no part in fitting. NaN counts as missing. With one label only, or without rows, the model has
no trees and gives the prior. Repeated rows count as often as they stand.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.tables import saved

#: Rows that bin edges come from at most, edges of a feature at most, and trees between two written tables.
SAMPLE, EDGES, SAVE = 20_000, 63, 20
UNIT = float(1 << 24)
MISSING = 255


@dataclass
class Options:
    """How trees are grown; the defaults are those of the reference model of this field of work."""

    rounds: int = 400
    rate: float = 0.05
    depth: int = 4
    leaves: int = 15
    least_rows: int = 15
    l2: float = 3.0
    columns: float = 0.6
    dropout: float = 0.1
    most_dropped: int = 50
    seed: int = 42


@dataclass
class Tree:
    """Nodes by number: feature (-1: a leaf), last bin that goes left, whether missing values do, children, value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    upto: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    weight: float = 1.0

    def split(self, node: int, feature: int, upto: int, missing_left: bool) -> tuple[int, int]:
        self.feature[node], self.upto[node], self.missing_left[node] = feature, upto, missing_left
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for column, empty in ((self.feature, -1), (self.upto, 0), (self.missing_left, False), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            column += [empty, empty]
        return self.left[node], self.right[node]

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node at which each row of bins ends."""
        at = np.zeros(len(bins), np.int64)
        feature, upto, gone, left, right = (np.array(x) for x in (self.feature, self.upto, self.missing_left, self.left, self.right))
        for _ in range(len(feature)):
            f = feature[at]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                break
            own = at[inner]
            b = bins[inner, f[inner]]
            to_left = np.where(b == MISSING, gone[own], b <= upto[own])
            at[inner] = np.where(to_left, left[own], right[own])
        return at


@dataclass
class Booster:
    cols: list[str]
    edges: list[list[float]]
    prior: float
    trees: list[Tree] = field(default_factory=list)

    def bins(self, values: np.ndarray) -> np.ndarray:
        """A byte for each value: the number of edges below it, MISSING for none."""
        out = np.full(values.shape, MISSING, np.uint8)
        for k, e in enumerate(self.edges):
            known = ~np.isnan(values[:, k])
            out[known, k] = np.searchsorted(np.array(e), values[known, k], side="left")
        return out

    def margins(self, bins: np.ndarray) -> np.ndarray:
        return self.prior + sum((t.weight * np.array(t.value)[t.nodes(bins)] for t in self.trees), np.zeros(len(bins)))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Booster:
        said = json.loads(text)
        return Booster(said["cols"], said["edges"], said["prior"], [Tree(**t) for t in said["trees"]])


def matrix(batch: pa.RecordBatch, cols: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in cols], axis=1) if batch.num_rows else np.zeros((0, len(cols)))


def byte_rows(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """Rows of equally many bytes, none too."""
    joined = b"".join(batch.column(column).to_pylist())
    return np.frombuffer(joined, np.uint8).reshape(batch.num_rows, -1) if joined else np.zeros((batch.num_rows, 0), np.uint8)


def numbers(df: DataFrame, cols: list[str]) -> list:
    return [F.col(f"`{c}`").cast("double").alias(f"__x{i}") for i, c in enumerate(cols)]


def feature_edges(rows: DataFrame, cols: list[str], id_col: str) -> list[list[float]]:
    """Midpoints between quantiles of the sampled rows' distinct values, at most EDGES a feature."""
    chosen = rows.select(F.xxhash64(id_col).alias("__h"), F.col(id_col).alias("__id"), *numbers(rows, cols)).orderBy("__h", "__id", *[f"__x{i}" for i in range(len(cols))]).limit(SAMPLE).toArrow()
    out = []
    for i in range(len(cols)):
        x = chosen.column(f"__x{i}").to_numpy()
        x = np.unique(x[~np.isnan(x)])
        at = np.unique(np.linspace(0, len(x) - 1, EDGES + 1).round().astype(int)) if len(x) else []
        out.append(((x[at][1:] + x[at][:-1]) / 2).tolist() if len(at) > 1 else [])
    return out


def chance(*key: int) -> float:
    """A number between 0 and 1 for each key, always the same."""
    return np.random.default_rng(list(key)).random()


def best_split(hist: np.ndarray, feature: int, o: Options) -> tuple[float, int, bool] | None:
    """Gain, last bin on the left and whether missing values go there too; hist: rows of g, h, n, the last one for missing values."""
    gain_of = lambda s: s[..., 0] ** 2 / (s[..., 1] + o.l2)
    known, gone, best = np.cumsum(hist[:-1], axis=0), hist[-1], None
    total = known[-1] + gone
    for missing_left in (False, True):
        left = known[:-1] + (gone if missing_left else 0)
        right = total - left
        gain = (gain_of(left / UNIT) + gain_of(right / UNIT) - gain_of(total / UNIT)) / 2
        gain[(np.minimum(left[:, 2], right[:, 2]) < o.least_rows * UNIT)] = -np.inf
        if len(gain) and (top := int(np.argmax(gain))) >= 0 and gain[top] > 1e-9 and (best is None or gain[top] > best[0] + 1e-12):
            best = (float(gain[top]), top, missing_left)
        if not gone[2]:
            break
    return best


def histograms(rows: DataFrame, model: Booster, tree: Tree, active: list[int], features: list[int], done: int) -> dict[tuple[int, int], np.ndarray]:
    """By active node and feature: sums of g, h and rows (all in UNITs) for each bin, the last one for missing values."""
    width = {f: len(model.edges[f]) + 2 for f in features}
    sent = rows.sparkSession.sparkContext.broadcast((model, tree))  # trees of the model: its size is fixed by the options

    def body(batches):
        own, grown = sent.value
        sums = {(k, f): np.zeros((width[f], 3), np.int64) for k in active for f in features}
        for batch in batches:
            bins, leaves = byte_rows(batch, "bins"), byte_rows(batch, "leaves")
            margin = margins_of(own, bins, leaves, done)
            y, w = batch.column("y").to_numpy().astype(float), batch.column("w").to_numpy()
            p = 1 / (1 + np.exp(-margin))
            each = np.stack([w * (p - y), w * p * (1 - p), np.ones(len(y))], axis=1)
            each = np.rint(each * UNIT).astype(np.int64)
            node = grown.nodes(bins)
            for k in active:
                at = node == k
                for f in features:
                    b = np.where(bins[at, f] == MISSING, width[f] - 1, bins[at, f])
                    np.add.at(sums[k, f], b, each[at])
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in sums], pa.int32()), pa.array([f for _, f in sums], pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["node", "feature", "sums"])

    def added(key, table):
        total = sum((np.frombuffer(s, np.int64) for s in table.column("sums").to_pylist()))
        return pa.table({"node": pa.array([key[0].as_py()], pa.int32()), "feature": pa.array([key[1].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    found = rows.mapInArrow(body, "node int, feature int, sums binary").groupBy("node", "feature").applyInArrow(added, "node int, feature int, sums binary").collect()
    sent.unpersist()
    return {(r["node"], r["feature"]): np.frombuffer(r["sums"], np.int64).reshape(-1, 3) for r in found}


def margins_of(model: Booster, bins: np.ndarray, leaves: np.ndarray, done: int) -> np.ndarray:
    """Margins by the leaves that rows carry of the first `done` trees, and by walking the trees after them."""
    margin = np.full(len(bins), model.prior)
    for k, t in enumerate(model.trees):
        if t.weight:
            margin += t.weight * np.array(t.value)[leaves[:, k] if k < done else t.nodes(bins)]
    return margin


def grown_tree(rows: DataFrame, model: Booster, features: list[int], o: Options, done: int) -> Tree:
    """A tree by levels: of the nodes of a level the ones with the largest gains are split, while there are leaves left."""
    tree, active, leaves = Tree(), [0], 1
    for level in range(o.depth + 1):
        if not active:
            break
        hist = histograms(rows, model, tree, active, features, done)
        found = []
        for k in active:
            total = hist[k, features[0]].sum(0) / UNIT
            tree.value[k] = float(-o.rate * total[0] / (total[1] + o.l2))
            if level < o.depth:
                splits = [(s[0], -f, f, s) for f in features if (s := best_split(hist[k, f], f, o))]
                if splits:
                    found.append((max(splits)[0], -k, k, max(splits)[2:]))
        active = []
        for _, _, k, (f, (_, upto, missing_left)) in sorted(found, reverse=True):
            if leaves < o.leaves:
                active += tree.split(k, f, upto, missing_left)
                leaves += 1
    return tree


def with_leaves(rows: DataFrame, model: Booster, done: int) -> DataFrame:
    """Rows with the leaves of all trees of the model, written."""
    sent = rows.sparkSession.sparkContext.broadcast(model.trees[done:])

    def body(batches):
        for batch in batches:
            bins = byte_rows(batch, "bins")
            new = np.stack([t.nodes(bins) for t in sent.value], axis=1).astype(np.uint8)
            both = [a + b.tobytes() for a, b in zip(batch.column("leaves").to_pylist(), new)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("bins", "y", "w")), pa.array(both, pa.binary())], names=["bins", "y", "w", "leaves"])

    return saved(rows.mapInArrow(body, rows.schema), "boosting-leaves")


def fit_boosted(df: DataFrame, cols: list[str], options: Options | None = None, id_col: str = "id", label: str = "y") -> Booster:
    """A booster of the rows' label (0 or 1), classes weighted to the same sum."""
    o = options or Options()
    known = df.where(F.col(label).isNotNull())
    n = {int(r["y"]): r["count"] for r in known.groupBy(F.col(label).cast("int").alias("y")).count().collect()}
    prior = 0.0 if len(n) == 2 else {0: -10.0, 1: 10.0}[next(iter(n))] if n else 0.0
    model = Booster(list(cols), feature_edges(known, cols, id_col), prior)
    if len(n) < 2:
        return model
    weight = F.when(F.col(label) == 1, sum(n.values()) / (2 * n[1])).otherwise(sum(n.values()) / (2 * n[0]))
    src = known.select(F.col(label).cast("int").alias("y"), weight.cast("double").alias("w"), *numbers(known, cols))
    binner = Booster(model.cols, model.edges, 0.0)

    def body(batches):
        for batch in batches:
            bins = binner.bins(matrix(batch, [f"__x{i}" for i in range(len(cols))]))
            yield pa.RecordBatch.from_arrays([pa.array([b.tobytes() for b in bins], pa.binary()), batch.column("y"), batch.column("w"), pa.array([b""] * len(bins), pa.binary())], names=["bins", "y", "w", "leaves"])

    rows, done = saved(src.mapInArrow(body, "bins binary, y int, w double, leaves binary"), "boosting-bins"), 0
    for turn in range(o.rounds):
        draw = sorted(range(len(cols)), key=lambda f: chance(o.seed, turn, 1, f))
        features = sorted(draw[: max(1, round(o.columns * len(cols)))])
        out = [k for k in range(turn) if chance(o.seed, turn, 2, k) < o.dropout][: o.most_dropped]
        weights = [model.trees[k].weight for k in out]
        for k in out:
            model.trees[k].weight = 0.0
        tree = grown_tree(rows, model, features, o, done)
        tree.weight = 1 / (len(out) + 1)
        for k, w in zip(out, weights):
            model.trees[k].weight = w * len(out) / (len(out) + 1)
        model.trees.append(tree)
        if len(model.trees) - done >= SAVE and turn + 1 < o.rounds:
            rows, done = with_leaves(rows, model, done), len(model.trees)
    return model


def boosted_scores(df: DataFrame, model: Booster, keep: tuple[str, ...] = ("id", "y")) -> DataFrame:
    """The kept columns and p."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    cols = [f"__x{i}" for i in range(len(model.cols))]

    def body(batches):
        own = sent.value
        for batch in batches:
            p = 1 / (1 + np.exp(-own.margins(own.bins(matrix(batch, cols)))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(p)], names=[*keep, "p"])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "p double"])
    return df.select(*[F.col(f"`{c}`") for c in keep], *numbers(df, model.cols)).mapInArrow(body, schema)

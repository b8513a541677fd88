"""Connected components of links: parts of bounded size are contracted to stars, then large-star and small-star
steps alternate, all on written tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import saved

#: Links that a task contracts at a time, at most: 2 MB.
LINKS_A_PART = 1 << 17


def classes(n: int, pairs) -> np.ndarray:
    """The smallest row that each of n rows reaches over the pairs."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            low = np.minimum(label[i], label[j])
            if (label[i] == low).all() and (label[j] == low).all():
                break
            # the roots of both sides take the lower label, then all rows follow their roots
            np.minimum.at(label, np.concatenate([label[i], label[j], i, j]), np.concatenate([low, low, low, low]))
            while (label[label] != label).any():
                label = label[label]
    return label


def contracted(edges: DataFrame, rows: int, part: int) -> DataFrame:
    """hi, lo: each node of a part of at most `part` links (or one batch) with the smallest node that it reaches there, itself too.

    Up to `part` links in all are one part, and lo is the smallest node of the component."""

    def stars(held):
        links = pa.Table.from_batches(held)
        nodes, at = np.unique(np.concatenate([links.column(c).to_numpy() for c in ("hi", "lo")]), return_inverse=True)
        label = classes(len(nodes), [tuple(at.reshape(2, -1))])
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["hi", "lo"])

    def body(batches):
        held, size = [], 0
        for batch in batches:
            if held and size + batch.num_rows > part:
                yield stars(held)
                held, size = [], 0
            held.append(batch)
            size += batch.num_rows
        if held:
            yield stars(held)

    return edges.coalesce(max(1, -(-rows // part))).mapInArrow(body, "hi long, lo long")


def are_stars(edges: DataFrame) -> bool:
    """Whether each hi has one lo, which is no hi itself: then lo is the smallest node of its component."""
    each = edges.select("hi", F.lit(1).alias("n")).union(edges.select("lo", F.lit(None).cast("int")).distinct()).groupBy("hi").agg(F.sum("n").alias("out"), F.count("*").alias("all"))
    return each.where("out > 1 OR (out = 1 AND all > 1)").isEmpty()


def components(links: DataFrame, most_rounds: int = 40, part: int = LINKS_A_PART) -> DataFrame:
    """node, root: the smallest node that each node of `links` (a, b: longs) reaches.

    Up to `part` links are contracted in one task. More are contracted part by part first, and then each round points nodes at smaller ones and halves distances, as in the large-star/small-star
    method; rounds grow with the logarithm of the nodes. It ends when all links point at nodes that point
    at none, and each node has one. Hot centres are met in joins with pre-aggregated minima, so Spark can
    split them. Nodes without links have no row."""
    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")), "links")
    rows = edges.count()
    if rows <= part:
        return contracted(edges, rows, part).toDF("node", "root")
    edges = saved(contracted(edges, rows, part).where("hi <> lo").distinct(), "stars")
    for _ in range(most_rounds):
        if are_stars(edges):
            break
        both = edges.union(edges.select("lo", "hi")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = saved(both.where("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct(), "large-star")
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        met = large.join(low, "hi")
        edges = saved(met.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(low.select("hi", "m")).distinct(), "small-star")
    else:
        raise RuntimeError(f"links did not settle in {most_rounds} rounds")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(edges.select("lo", "lo").distinct())

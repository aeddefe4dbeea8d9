"""Connected components of an edge table, as Spark jobs: union-find inside each partition first, then
large-star and small-star rounds (Kiveris et al., 2014) until nothing changes. No node's edges meet in
one task: minima are pre-aggregated, and joins on hot nodes go by broadcast (see skew_join)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, begin, skew_join


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges as stars around each local component's least node."""
    begin()
    up: dict = {}
    kind = None

    def root(x):
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    for b in batches:
        kind = b.schema.field(0).type
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            up.setdefault(u, u)
            up.setdefault(v, v)
            a, c = root(u), root(v)
            if a != c:
                up[max(a, c)] = min(a, c)
    rows = [(x, r) for x in up if (r := root(x)) != x]
    for k in range(0, len(rows), 10_000):
        part = rows[k : k + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], kind), pa.array([r for _, r in part], kind)], names=["u", "v"])


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, root) for every node of `edges` (u, v); root is the least node of its component. Loops and
    repeated edges are allowed; an empty table gives an empty one."""
    pairs = edges.select("u", "v").where("u <> v").distinct()
    stars = scratch.write(pairs.mapInArrow(_contract, pairs.schema), f"{name}-0")  # v is the lesser end
    step = 0
    while True:
        before = stars
        # large-star: every greater neighbour of u points at the least of u and its neighbours
        both = before.unionByName(before.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        big = skew_join(both, least, "u", "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        big = scratch.write(big, f"{name}-{step}-large")
        # small-star: u and its lesser neighbours point at the least of them
        least = big.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = skew_join(big, least, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        step += 1
        stars = scratch.write(small, f"{name}-{step}")
        if not _differs(before, stars):
            break
        scratch.drop(f"{name}-{step - 1}", f"{name}-{step - 1}-large")
    roots = stars.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def hooked(labels: DataFrame, edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(k, root) after one pass in which each component takes the least component that an edge leads to, and
    the one above that, twice over. Only what edges connect is merged, though maybe not all of it: enough
    where a label only saves work."""
    ends = edges.select("u", "v").join(labels.select(F.col("k").alias("u"), F.col("root").alias("a")), "u").join(labels.select(F.col("k").alias("v"), F.col("root").alias("b")), "v")
    up = ends.where("a <> b").groupBy(F.greatest("a", "b").alias("child")).agg(F.min(F.least("a", "b")).alias("parent"))
    up = scratch.write(up, name)
    for _ in range(2):
        above = up.select(F.col("child").alias("parent"), F.col("parent").alias("above"))
        up = up.join(above, "parent", "left").select("child", F.coalesce("above", "parent").alias("parent"))
    return labels.join(up, labels["root"] == up["child"], "left").select("k", F.coalesce("parent", "root").alias("root"))


def _differs(a: DataFrame, b: DataFrame) -> bool:
    mark = lambda x: x.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))), F.bit_xor(F.xxhash64("v", "u"))).first()
    return mark(a) != mark(b)

"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Rounds grow with the logarithm of the longest path; so many are never needed.
MOST_ROUNDS = 100
#: So few links (a megabyte) are joined up in one task; more of them by rounds.
FEW = 1 << 16


class Forest:
    """Union by smaller root; keeps the links that joined two trees."""

    def __init__(self, n: int):
        self.of, self.links = list(range(n)), []

    def root(self, x: int) -> int:
        while self.of[x] != x:
            self.of[x] = self.of[self.of[x]]
            x = self.of[x]
        return x

    def join(self, x: int, y: int) -> None:
        p, q = self.root(x), self.root(y)
        if p != q:
            self.of[max(p, q)] = min(p, q)
            self.links.append((x, y))


def joined_up(links: DataFrame) -> DataFrame:
    """components() of a few links, in one task."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        pairs = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if len(b)]
        if pairs:
            nodes, at = np.unique(np.concatenate(pairs, 1), return_inverse=True)
            forest = Forest(len(nodes))
            for x, y in at.reshape(2, -1).T.tolist():
                forest.join(x, y)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[[forest.root(x) for x in range(len(nodes))]])], ["node", "label"])

    return links.coalesce(1).mapInArrow(run, "node long, label long")


def components(links: DataFrame) -> DataFrame:
    """node, label of every node in links (a, b: long): the smallest node that it reaches. Each round rewrites the links as
    stars around smaller nodes, as grouped minima and joins; it ends when a round changes nothing. A centre with many links
    is summed up before the shuffle, and its join can be split."""
    at = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    at, before = materialize(at, "round0"), None
    for k in range(1, MOST_ROUNDS + 1):
        now = at.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if k == 1 and now[0] <= FEW:
            return joined_up(at)
        if now == before or not now[0]:
            break
        if k == MOST_ROUNDS:
            raise RuntimeError(f"components: links still change after {k} rounds")
        before = now
        both = at.unionByName(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        at = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        at = materialize(at, f"round{k}")
    return at.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(at.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("label")))

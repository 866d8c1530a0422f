"""Conversations as a prefix trie: every distinct sequence of first turns is a node; equal beginnings are kept once.

Each conversation becomes one row: its id, a key (the turns' digests one after another, 32 characters each, of role and text) and the
code points of each turn's text. Rows are sorted by key and id in ranges, so that a node's members follow one another. A sweep over
a range compares neighbours: their longest common prefix (LCP) says which nodes of the stack end and where new ones begin. What the
sweep can't know, as a neighbour range may share it, are the nodes on the path of its first and of its last row; it returns those as
fragments. One more sweep, over the fragments of all ranges in order, stitches the open stacks together: its input is a path or two
a range, so it grows with the number of ranges and the length of a path, never with the rows. Parents come by a join on node ids, a
hash chained down the path.

Members that end in a node are hashed as they are met. The members of a range's first and last key may go on in a neighbour range;
their ids go to the second sweep in blocks, which feeds them to the hash one by one: a conversation that a third of all rows repeat
is never in one task's memory, and its rows are spread over ranges like others.

A conversation of c turns is a row of some 36 * c bytes; its texts stay out of every shuffle.

Defined results: turns are ordered by turn (null first), then by digest; repeated rows are turns of their own; a null role or text is
empty; rows without conv_id belong to no conversation; ids are grouped by c - c % 100, where % has the sign of c; an empty table has
no members and gives an empty result; very long texts are read once, for digest and length; further columns play no part.
"""

from __future__ import annotations

import hashlib
from itertools import islice

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, only

#: Characters of a turn's digest; member ids of a block.
DIGEST, IDS = 32, 1 << 16
#: Of a conversation: ids that share beginnings, and most turns that are shared.
FAMILY, SHARED = 100, 6


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and its turns in order: digest and code points of each. Texts are digested before the shuffle."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    narrow = only(turns, "conv_id", "turn", "role", "text").where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", digest.alias("d"), F.char_length(text).cast("long").alias("n")).alias("t"))
    return narrow.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["d"].alias("d"), t["n"].alias("n"))).alias("turns"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """conversations() whose first turns, crc32 of the id modulo SHARED of them, are those of their family's first conversation."""
    own = materialize(conversations(turns), "conversations")
    first = F.col("conv_id") - F.col("conv_id") % FAMILY
    lead = own.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("first"), F.slice("turns", 1, SHARED - 1).alias("lead"))
    shared = (F.crc32(F.col("conv_id").cast("string")) % SHARED).cast("int")
    begun = F.slice(F.coalesce("lead", F.filter("turns", lambda t: F.lit(False))), F.lit(1), shared)
    return own.withColumn("first", first).join(lead, "first", "left").select("conv_id", F.concat(begun, F.slice("turns", shared + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def rows(convs: DataFrame) -> DataFrame:
    """conv_id, key and code points, as the sweep takes them."""
    return convs.select("conv_id", F.array_join(F.transform("turns", lambda t: t["d"]), "").alias("key"), F.transform("turns", lambda t: t["n"]).alias("points"))


def common(a: str, b: str) -> int:
    """Turns that two keys share at their beginning."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    if a[: high * DIGEST] == b[: high * DIGEST]:
        return high
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * DIGEST : mid * DIGEST] == b[low * DIGEST : mid * DIGEST]:
            low = mid
        else:
            high = mid - 1
    return low


class Node:
    """What is known of a node so far. held: ids that end here while others may do so in a neighbour range."""

    __slots__ = ("id", "points", "least", "members", "children", "leaves", "saved", "ends", "done", "held")

    def __init__(self, node: bytes, points: int):
        self.id, self.points, self.least, self.members, self.children, self.leaves, self.saved, self.ends, self.done, self.held = node, points, None, 0, 0, 0, 0, hashlib.sha256(), False, None

    def add(self, least: int | None, members: int, children: int = 0, leaves: int = 0, saved: int = 0) -> None:
        self.least = least if self.least is None else self.least if least is None else min(least, self.least)
        self.members, self.children, self.leaves, self.saved = self.members + members, self.children + children, self.leaves + leaves, self.saved + saved

    def end(self, ids: list[int]) -> None:
        """Members, ascending, that end here, after all that were met before."""
        self.ends.update((b"," if self.done else b"") + ",".join(map(str, ids)).encode())
        self.done = True

    def close(self, depth: int, above: Node | None) -> dict:
        """All of the node has been met: what it adds up to goes to its parent, its row to the result."""
        leaves, saved = self.leaves or 1, self.saved + (self.members - 1) * self.points
        if above is not None:
            above.add(self.least, self.members, 1, leaves, saved)
        ends = self.ends if isinstance(self.ends, str) else self.ends.hexdigest()
        return {"kind": "node", "id": self.id, "parent": above and above.id, "conv_id": self.least, "depth": depth, "n_convs": self.members, "n_children": self.children, "n_leaves": leaves, "saved_tokens": saved, "ends": ends}

    def fragment(self, part: int, step: int, depth: int) -> list[dict]:
        """For the second sweep: the node's sums without its children that are fragments, then the ids held, in blocks."""
        at = {"kind": "fragment", "part": part, "step": step, "depth": depth}
        own = at | {"block": 0, "id": self.id, "points": self.points, "conv_id": self.least, "n_convs": self.members, "n_children": self.children, "n_leaves": self.leaves, "saved_tokens": self.saved, "ends": self.ends.hexdigest() if self.done else None}
        return [own, *(at | {"block": k // IDS + 1, "ids": np.array(self.held[k : k + IDS], "<i8").tobytes()} for k in range(0, len(self.held or ()), IDS))]


COLUMNS = "kind string, part int, step int, depth long, block long, id binary, parent binary, points long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, key string, ids binary"
ROOT = hashlib.blake2b(b"root", digest_size=16).digest()
#: Steps of the second sweep through a range: its first key, the first row's path, its last key, the rest of the last row's path.
FIRST, LEFT, LAST, RIGHT = range(4)


def chained(above: bytes, digest: str) -> bytes:
    """Id of a node: a hash of its parent's and of its last turn's."""
    return hashlib.blake2b(above + digest.encode(), digest_size=16).digest()


def arrow(found, size: int = 4096):
    """Batches of COLUMNS from dicts."""
    import pyarrow as pa

    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in COLUMNS.split(", "))])
    while held := list(islice(found, size)):
        yield pa.RecordBatch.from_pylist(held, schema)


def swept(members, part: int):
    """Nodes that lie inside a range, and fragments. members: (conv_id, key, code points) sorted by key and id.

    The first row's path may go on in the range before, the last row's in the next: their nodes become fragments, those of the first
    path (the lowest `edge` nodes of the stack) when they leave it, those of the last when the range ends."""
    stack: list[Node] = []
    edge, first, last, run = 0, None, None, []

    def pop(keep: int):
        nonlocal edge
        while len(stack) > keep:
            node, depth = stack.pop(), len(stack)
            if depth < edge:
                edge = depth
                yield from node.fragment(part, LEFT, depth)
            else:
                yield node.close(depth, stack[-1])

    for conv, key, points in members:
        if key != last:
            if last is not None:
                if last == first:
                    stack[-1].held = run
                else:
                    stack[-1].end(run)
                run = []
            yield from pop(common(key, last) + 1 if last is not None else 0)
            if not stack:
                stack.append(Node(ROOT, 0))
            for d in range(len(stack) - 1, len(points)):
                stack.append(Node(chained(stack[-1].id, key[d * DIGEST : (d + 1) * DIGEST]), points[d]))
            if first is None:
                first, edge = key, len(stack)
            last = key
        stack[-1].add(conv, 1)
        run.append(conv)
    if last is not None:
        stack[-1].held = run
        yield {"kind": "fragment", "part": part, "step": FIRST, "depth": 0, "block": 0, "key": first}
        yield {"kind": "fragment", "part": part, "step": LAST, "depth": edge, "block": 0, "key": last}
        for depth, node in enumerate(stack):
            yield from node.fragment(part, LEFT if depth < edge else RIGHT, depth)


def stitched(found):
    """Nodes from the fragments of all ranges, in order of part, step, depth and block."""
    stack: list[Node] = []
    last = None

    def pop(keep: int):
        while len(stack) > keep:
            node = stack.pop()
            yield node.close(len(stack), stack[-1] if stack else None)

    for r in found:
        if r["step"] == FIRST:
            yield from pop(common(r["key"], last) + 1 if last is not None else 0)
        elif r["step"] == LAST:
            yield from pop(r["depth"])
            last = r["key"]
        elif r["block"]:
            stack[r["depth"]].end(np.frombuffer(r["ids"], "<i8").tolist())
        else:
            if r["depth"] == len(stack):
                stack.append(Node(r["id"], r["points"]))
            node = stack[r["depth"]]
            if node.id != r["id"]:
                raise RuntimeError("ranges don't follow one another")
            node.add(*(r[c] for c in ("conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")))
            node.ends = r["ends"] or node.ends
    yield from pop(0)


def trie(members: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node. members: conv_id,
    key and points, as rows() gives them."""

    def sweep(batches):
        triples = (t for b in batches for t in zip(*(c.to_pylist() for c in b.columns), strict=True))
        yield from arrow(swept(triples, TaskContext.get().partitionId()))

    def stitch(batches):
        yield from arrow(stitched(r for b in batches for r in b.to_pylist()))

    members = materialize(members.select("conv_id", "key", "points"), "members")
    both = materialize(members.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(sweep, COLUMNS), "swept")
    edges = both.where("kind = 'fragment'").repartition(1).sortWithinPartitions("part", "step", "depth", "block")
    found = [F.col(c) for c in ("id", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")]
    nodes = both.where("kind = 'node'").select(*found).unionByName(materialize(edges.mapInArrow(stitch, COLUMNS).select(*found), "stitched"))
    parents = nodes.where("n_children > 0").select(F.col("id").alias("of"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(parents, F.col("parent") == F.col("of"), "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256"))


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return trie(rows(rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


ORACLE = {
    "op13_conversation_prefix_trie": f"""
WITH t AS MATERIALIZED (SELECT conv_id, d, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS k
  FROM (SELECT conv_id, turn, text, md5(strlen(role)::VARCHAR || ':' || role || text) AS d FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL))),
crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)) AS of_byte),
h AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % {FAMILY} AS lead, xor(4294967295, list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
  lambda a, b: xor(of_byte[(xor(a, b) & 255) + 1], a >> 8), 4294967295)) % {SHARED} AS h FROM (SELECT DISTINCT conv_id FROM t), crc),
r AS (SELECT h.conv_id, 0 AS own, k, d, n FROM h JOIN t ON t.conv_id = lead AND k <= h UNION ALL SELECT h.conv_id, 1, k, d, n FROM h JOIN t ON t.conv_id = h.conv_id AND k > h),
x AS MATERIALIZED (SELECT conv_id, n, row_number() OVER w AS depth, string_agg(d, '') OVER w AS path FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, k) UNION ALL SELECT conv_id, 0, 0, '' FROM h),
nodes AS MATERIALIZED (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n) AS saved FROM x GROUP BY path, depth),
ends AS (SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM (SELECT conv_id, arg_max(path, depth) AS path FROM x GROUP BY conv_id) GROUP BY path),
children AS (SELECT substr(path, 1, len(path) - {DIGEST}) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
below AS (SELECT substr(nodes.path, 1, {DIGEST} * a) AS path, sum(saved) AS saved, count(*) FILTER (children.path IS NULL) AS leaves FROM nodes LEFT JOIN children USING (path), unnest(range(depth + 1)) u(a) GROUP BY 1)
SELECT nodes.conv_id, nodes.depth, above.conv_id AS parent_conv_id, nodes.n_convs, coalesce(children.n, 0) AS n_children, leaves AS n_leaves, below.saved::BIGINT AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM nodes JOIN below ON below.path = nodes.path LEFT JOIN children ON children.path = nodes.path LEFT JOIN ends ON ends.path = nodes.path
LEFT JOIN nodes above ON above.depth = nodes.depth - 1 AND above.path = substr(nodes.path, 1, len(nodes.path) - {DIGEST})""",
}

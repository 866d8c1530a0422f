"""Near-duplicate groups of documents by SetSketch registers.

A document is the set of its distinct shingles (A-Z lowered, words apart by ASCII white space). Equal sets become one node.
Each node gets SetSketch registers: truncated logarithms, on an exponential scale, of minima of exponential variables; equal
shares of shingles make equal registers. Then

1. bands of registers are bucket keys; every node of a bucket pairs with one node of it, another one for each band (the
   nearest to the key by exclusive or), so a bucket of n nodes makes n - 1 pairs;
2. the likelihood of registers that are larger, smaller and equal, jointly with both set sizes, estimates each pair's
   similarity;
3. each node is compared, on full sets, with one of its centres, the smallest that looks linked, then each component with the
   one that looks most like it; so most of a group of copies is linked already, each set having been sent once;
4. nodes that share a bucket with a node of another component stay open: pairs of them that are estimated near enough for a
   common neighbour join their components to coarse groups, and where a bucket spans several of those, the nodes left are
   estimated against each other, in blocks;
5. inside a coarse group the open nodes are compared on full sets across components: those outside its largest component meet
   all others, in pairs of blocks; a block emits a spanning forest;
6. components of confirmed links, and the smallest doc_id of each, go back to the rows.

With 36 bands of 6 registers a pair at similarity 0.85 (0.8) shares no bucket in 4e-8 (2e-5) of cases. Blocks are processed
apart, so a group of any size is spread over tasks; nothing is capped and no set of links passes through the driver. Sets that
are sent more than once are those of nodes that share a bucket, but no link so far, with others: of n such nodes of a group, m
of them outside the largest component, a set is sent once for every 800 of the m, and those of the m once for every 800 of n.

Defined results: null and empty texts (and those of white space) have no shingles, are linked with nothing and kept; texts
with fewer words than a shingle are one shingle; rows with a null doc_id take part, a group of only such rows has a null
component_id; repeated rows share a node, and deduplicate() keeps one row of each component.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_key, materialize, mix64, only, packed, slices, text_buffer, tokens, unpacked
from .graph import Forest, components

BANDS, ROWS = 36, 6
REGISTERS = BANDS * ROWS
#: SetSketch parameters: base, rate, largest register.
BASE, RATE, LIMIT = 1.001, 20.0, 65534
#: Nodes, and shingles, of a block that is verified in one piece.
BLOCK_NODES, BLOCK_SHINGLES = 800, 2_000_000
#: Rounds in which likely links are confirmed before blocks are paired.
LIKELY_ROUNDS = 2
_rng = np.random.default_rng(8)
_MUL = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32)
_BAND = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int):
    """Sorted distinct 64-bit shingles of each of the texts that follow one another in raw."""
    hashed, _, _, first = tokens(raw, offsets)
    rolled = hashed.copy()
    for k in range(1, width):  # a shingle at each word; those that reach into the next text aren't used
        rolled[: len(hashed) - k] = mix64(rolled[: len(hashed) - k] * np.uint64(0x9E3779B97F4A7C15) + hashed[k:])
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            yield np.unique(rolled[a : b - width + 1])
        elif b > a:
            whole = hashed[a : a + 1]
            for k in range(a + 1, b):
                whole = mix64(whole * np.uint64(0x9E3779B97F4A7C15) + hashed[k : k + 1])
            yield mix64(whole + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set: merged by maxima, as every register comes from a minimum over the set."""
    x, least = (shingles >> np.uint64(32)).astype(np.uint32), np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 256):
        block = x[k : k + 256, None] * _MUL
        block += _ADD
        np.minimum(least, block.min(0), out=least)
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarities of pairs by maximum likelihood of how many registers are larger, smaller, equal, given both sizes."""
    larger, smaller = (a > b).sum(1), (a < b).sum(1)
    equal = a.shape[1] - larger - smaller
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        up, down = p(u - v * j), p(v - u * j)
        return larger * np.log(up) + smaller * np.log(down) + equal * np.log(np.maximum(1 - up - down, 1e-12))

    low, high, golden = np.zeros(len(u)), np.minimum(u / v, v / u), (np.sqrt(5) - 1) / 2
    for _ in range(24):
        one, two = high - golden * (high - low), low + golden * (high - low)
        right = likelihood(one) < likelihood(two)
        low, high = np.where(right, one, low), np.where(right, high, two)
    return (low + high) / 2


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_hash, n, digest (16 bytes of the set; null without shingles), regs of every row."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            raw, offsets = text_buffer(batch.column(2))
            n, digest, regs = [], [], []
            for a, b in slices(offsets):
                for s in shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width):
                    n.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    regs.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(regs, pa.binary())], ["doc_id", "text_hash", "n", "digest", "regs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return only(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, f"doc_id {kind}, text_hash long, n long, digest binary, regs binary")


def _matrix(column) -> np.ndarray:
    """Registers of a binary column of equal lengths."""
    import pyarrow as pa

    return np.frombuffer(b"".join(column.cast(pa.binary()).to_pylist()), np.uint16).reshape(len(column), REGISTERS)


def buckets(nodes: DataFrame) -> DataFrame:
    """key, node: a row for each band of each node."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            if len(batch):
                parts = _matrix(batch.column(1)).reshape(len(batch), BANDS, ROWS).astype(np.uint64)
                key = np.broadcast_to(_BAND, parts.shape[:2])
                for k in range(ROWS):
                    key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k] + np.uint64(1))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["key", "node"])

    return nodes.select("node", "regs").mapInArrow(run, "key long, node long")


def estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b, similarity as estimated."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            if len(batch):
                x, y = _matrix(batch.column(2)), _matrix(batch.column(3))
                got = estimate(x, y, *(batch.column(k).to_numpy().astype(float) for k in (4, 5)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got)], ["a", "b", "similarity"])

    one, two = (nodes.select(F.col("node").alias(k), F.col("regs").alias(f"r{k}"), F.col("n").alias(f"n{k}")) for k in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ra", "rb", "na", "nb").mapInArrow(run, "a long, b long, similarity double")


def in_blocks(members: DataFrame, by: str, sizes: DataFrame) -> DataFrame:
    """Deal the members of each group into blocks, and pair blocks: members (by, node, outer, ...) get `key`, one for each pair
    of blocks that they are in, and `side` (0, 1, or 2 where a block meets itself). sizes: by, outer_blocks, inner_blocks. Blocks
    of members that aren't outer (numbered from outer_blocks on) meet outer blocks only."""
    m = members.join(sizes, by)
    at = lambda many: F.pmod(F.xxhash64("node"), many).cast("int")
    block = F.when(F.col("outer"), at(F.greatest("outer_blocks", F.lit(1)))).otherwise(F.col("outer_blocks") + at(F.greatest("inner_blocks", F.lit(1))))
    last = F.col("outer_blocks") - 1 + F.when(F.col("outer"), F.col("inner_blocks")).otherwise(0)
    dealt = m.withColumn("block", block.cast("int")).where(last >= 0).withColumn("other", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    return dealt.withColumn("key", F.xxhash64(by, low, high)).withColumn("side", side.cast("int")).drop("block", "other", "outer_blocks", "inner_blocks")


def near_in_buckets(left: DataFrame, least: float) -> DataFrame:
    """a, b: a spanning forest of the pairs of a block that are estimated at `least` or more. left: key, side, node, n, regs."""
    import pyarrow as pa

    def run(batches):
        for _, t in by_key(batches, ("node", "side", "n", "regs")):
            node, side, n, regs = t["node"].to_numpy(), t["side"].to_numpy(), t["n"].to_numpy().astype(float), _matrix(t["regs"].combine_chunks())
            forest = Forest(len(node))
            for i in range(len(node)):
                j = np.arange(i + 1, len(node)) if side[i] == 2 else np.flatnonzero(side != side[i]) if side[i] == 0 else np.zeros(0, int)
                j = j[(regs[j] == regs[i]).mean(1) >= least - 0.25] if len(j) else j
                if len(j):
                    got = estimate(np.broadcast_to(regs[i], (len(j), REGISTERS)), regs[j], np.full(len(j), n[i]), n[j])
                    for k in j[got >= least]:
                        forest.join(i, int(k))
            if forest.links:
                x, y = np.array(forest.links).T
                yield pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(node[y])], ["a", "b"])

    return left.select("key", "side", "node", "n", "regs").repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def confirmed(sets: DataFrame, similarity: int) -> DataFrame:
    """a, b: a spanning forest of the links of a block, on full sets: 100 x intersection >= similarity x union, between nodes of
    different components. sets: key, side, node, component, shingles (sorted distinct uint64 as bytes)."""
    import pyarrow as pa

    def run(batches):
        for _, t in by_key(batches, ("node", "side", "component", "shingles")):
            node, side, component = (t[c].to_numpy() for c in ("node", "side", "component"))
            each = [np.frombuffer(x, np.uint64) for x in t["shingles"].to_pylist()]
            n, forest = np.array([len(x) for x in each]), Forest(len(node))
            values, ids = np.unique(np.concatenate(each), return_inverse=True)
            ids, owner = ids.ravel(), np.repeat(np.arange(len(each)), n)
            order = np.argsort(ids, kind="stable")
            begin = np.searchsorted(ids[order], np.arange(len(values) + 1))
            owner, at = owner[order], np.concatenate([[0], np.cumsum(n)])
            for i in range(len(each)):
                if side[i] == 1:
                    continue
                mine = ids[at[i] : at[i + 1]]
                starts, ends = begin[mine], begin[mine + 1]
                lengths = ends - starts
                where = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
                common = np.bincount(owner[where], minlength=len(each))
                fits = (100 * common >= similarity * (n[i] + n - common)) & (component != component[i]) & (np.arange(len(each)) > i if side[i] == 2 else side == 1)
                for k in np.flatnonzero(fits):
                    forest.join(i, int(k))
            if forest.links:
                x, y = np.array(forest.links).T
                yield pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(node[y])], ["a", "b"])

    return sets.select("key", "side", "node", "component", "shingles").repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def with_sets(members: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """members (node, doc_id, text_hash, n, ...) with `shingles`, cut anew from the one text of each that is looked up."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            sets = [s.tobytes() for a, b in slices(offsets) for s in shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "shingles"])

    texts = only(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("text_hash"), "text").where("text is not null")
    wanted = members.select("node", F.col("doc_id").alias("m_doc"), F.col("text_hash").alias("m_hash"))
    found = texts.join(wanted.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("m_doc")) & (F.col("text_hash") == F.col("m_hash"))).select("node", "text")
    return found.mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"])


def likely(near: DataFrame, parts: DataFrame | None, link: float) -> DataFrame:
    """key, side, node, component: of each node, the pair of near (a, b, similarity) with the smallest b that looks linked, so
    that a group meets around few centres; or of each component of parts (node, label) the pair that looks most alike and leaves
    it. side 0 is b, side 1 a; a key holds one b and some BLOCK_NODES of its a."""
    if parts is None:
        pairs = near.select("a", "b", F.when(F.col("similarity") >= link, 2 - F.col("b") / float(1 << 60)).otherwise(F.col("similarity")).alias("similarity"), F.col("a").alias("of"), F.col("b").alias("to"))
    else:
        one, two = (parts.select(F.col("node").alias(f"n{k}"), F.col("label").alias(f"l{k}")) for k in "ab")
        pairs = near.join(one, F.col("a") == F.col("na"), "left").join(two, F.col("b") == F.col("nb"), "left").select("a", "b", "similarity", F.coalesce("la", "a").alias("of"), F.coalesce("lb", "b").alias("to")).where("of <> to")
    best = pairs.groupBy("of").agg(F.max(F.struct("similarity", "b", "a", "to")).alias("best")).select("of", "best.a", "best.b", "best.to")
    many = best.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / BLOCK_NODES).alias("blocks"))
    keyed = best.join(many, "b").select("a", "b", "of", "to", F.xxhash64("b", F.pmod(F.xxhash64("a"), F.col("blocks"))).alias("key"))
    centres = keyed.select("key", F.lit(0).alias("side"), F.col("b").alias("node"), F.col("to").alias("component")).distinct()
    return keyed.select("key", F.lit(1).alias("side"), F.col("a").alias("node"), F.col("of").alias("component")).unionByName(centres)


def merged(parts: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, label of every node of parts (node, label) and links (a, b), a label being the smallest node that both together
    reach. Links are looked at between labels, so only what is new is joined up."""
    if parts is None:
        return materialize(components(links), "parts")
    one, two = (parts.select(F.col("node").alias(k), F.col("label").alias(f"l{k}")) for k in "ab")
    short = links.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    new = components(short).select(F.col("node").alias("was"), F.col("label").alias("now"))
    old = parts.join(new, F.col("label") == F.col("was"), "left").select("node", F.coalesce("now", "label").alias("label"))
    alone = new.join(parts.select("node"), F.col("was") == F.col("node"), "left_anti").select(F.col("was").alias("node"), F.col("now").alias("label"))
    return materialize(old.unionByName(alone), "parts")


def still_open(stars: DataFrame, parts: DataFrame) -> DataFrame:
    """key, node, centre, component: the entries of buckets that span several components."""
    known = stars.join(parts.select("node", F.col("label").alias("component")), "node", "left").withColumn("component", F.coalesce("component", "node"))
    across = known.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    return materialize(known.join(across, "key", "left_semi"), "open")


def coarse_groups(entry: DataFrame, near: DataFrame, nodes: DataFrame, link: float, coarse: float) -> DataFrame:
    """label, node, component, n of the open nodes whose components may be linked with others: components between which a pair of
    open nodes is near make a group. entry: still_open(); near: a, b, similarity."""
    active = materialize(entry.select("node", "component").distinct(), "active")
    one, two = (active.select(F.col("node").alias(k), F.col("component").alias(f"c{k}")) for k in "ab")
    between = lambda pairs: pairs.join(one, "a").join(two, "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    both = materialize(between(near), "near_open")
    of = lambda found: found.select(F.col("node").alias("component"), "label")
    grouped = of(components(both))
    label = F.coalesce("label", "component")
    several = entry.join(grouped, "component", "left").groupBy("key").agg(F.min(label).alias("lo"), F.max(label).alias("hi")).where("lo <> hi").select("key")
    alike = near.where(F.col("similarity") >= link).select(F.col("a").alias("node"), F.col("b").alias("centre"))
    left = entry.where("node <> centre").join(several, "key", "left_semi").join(alike, ["node", "centre"], "left_anti").select(F.col("key").alias("bucket"), "node")
    left = materialize(left, "left")
    if not left.isEmpty():
        blocks = left.groupBy("bucket").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("bucket", F.ceil(F.col("many") / BLOCK_NODES).alias("outer_blocks"), F.lit(0).alias("inner_blocks"))
        dealt = in_blocks(left.withColumn("outer", F.lit(True)), "bucket", blocks).join(nodes.select("node", "n", "regs"), "node")
        more = materialize(between(near_in_buckets(dealt, coarse)), "more")
        if not more.isEmpty():
            grouped = of(components(both.unionByName(more)))
    return materialize(active.join(grouped, "component").join(nodes.select("node", "n"), "node").select("label", "node", "component", "n"), "members")


def dealt_across(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (label, node, component, n) with `outer`: outside the largest component of their group; and label, outer_blocks,
    inner_blocks."""
    counts = rows.groupBy("label", "component").agg(F.count(F.lit(1)).alias("k"))
    largest = counts.groupBy("label").agg(F.max(F.struct("k", "component"))["component"].alias("largest"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    rows = rows.join(largest, "label").withColumn("outer", F.col("component") != F.col("largest")).drop("largest", "parts")
    blocks = lambda of: F.ceil(F.greatest(F.count_if(of) / BLOCK_NODES, F.coalesce(F.sum(F.when(of, F.col("n"))), F.lit(0)) / BLOCK_SHINGLES))
    return rows, rows.groupBy("label").agg(blocks(F.col("outer")).alias("outer_blocks"), blocks(~F.col("outer")).alias("inner_blocks"))


def groups(docs: DataFrame, width: int = 5, similarity: int = 80) -> DataFrame:
    """Of every row: doc_id, text_hash, n (shingles of its set), label (of its component; null where the set is empty),
    component_id (smallest doc_id that links reach; the row's own where the set is empty). similarity: percent of the union that the intersection has at least."""
    link = similarity / 100
    coarse = 2 * link - 1.2  # what a neighbour's neighbour has at least, less the estimate's error (four deviations)
    rows = materialize(sketched(docs, width), "sketches")
    nodes = rows.where("digest is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("of"), F.first("n").alias("n"), F.first("regs").alias("regs"), F.min("doc_id").alias("least_doc"))
    nodes = materialize(nodes.select(F.monotonically_increasing_id().alias("node"), "digest", "of.doc_id", "of.text_hash", "n", "regs", "least_doc"), "nodes")

    entry = buckets(nodes)
    centres = entry.groupBy("key").agg(F.min(F.col("node").bitwiseXOR(F.col("key"))).alias("x"), F.count(F.lit(1)).alias("many")).where("many > 1")
    stars = materialize(entry.join(centres, "key").select("key", "node", F.col("x").bitwiseXOR(F.col("key")).alias("centre")), "stars")
    pairs = stars.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    near = materialize(estimated(pairs, nodes).where(F.col("similarity") >= coarse), "near")
    wanted = lambda rows: nodes.join(rows.select("node").distinct(), "node", "left_semi")
    sets = materialize(with_sets(wanted(near.select(F.explode(F.array("a", "b")).alias("node"))), docs, width), "sets")
    parts = None
    for k in range(LIKELY_ROUNDS):
        links = materialize(confirmed(likely(near, parts, link).join(sets, "node"), similarity), f"likely{k}")
        if k and links.isEmpty():
            break
        parts = merged(parts, links)
    members = coarse_groups(still_open(stars, parts), near, nodes, link, coarse)
    if not members.isEmpty():
        members, sizes = dealt_across(members)
        rest = with_sets(wanted(members.join(sets.select("node"), "node", "left_anti")), docs, width)
        links = confirmed(in_blocks(members, "label", sizes).join(sets.unionByName(rest), "node"), similarity)
        parts = merged(parts, materialize(links, "links"))
    joined = parts

    whole = nodes.select("node", "digest", "least_doc").join(joined, "node", "left").select("digest", "least_doc", F.coalesce("label", "node").alias("label"))
    whole = materialize(whole, "labels")
    least = whole.groupBy("label").agg(F.min("least_doc").alias("component_id"))
    reach = whole.join(least, "label").select("digest", "label", "component_id")
    out = rows.select("doc_id", "text_hash", "n", "digest").join(reach, "digest", "left")
    return out.select("doc_id", "text_hash", "n", "label", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def deduplicate(docs: DataFrame, width: int = 5, similarity: int = 80) -> DataFrame:
    """The rows of docs of which no smaller doc_id is linked, columns unchanged; one row of each component, of repeated rows
    too (a null doc_id comes last). Texts without shingles all stay. Texts move once, to meet the keys that go."""
    found = groups(docs, width, similarity).where("label is not null")
    keys = materialize(found.groupBy("doc_id", "text_hash").agg(F.min("label").alias("label"), F.count(F.lit(1)).alias("times")), "keys")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    marked = keys.join(keys.groupBy("label").agg(first), "label")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    marked = materialize(marked.select(F.col("doc_id").alias("gone_doc"), F.col("text_hash").alias("gone_hash"), stays.alias("stays"), "times").where("not stays or times > 1"), "verdicts")
    gone, again = (materialize(marked.where(x).select("gone_doc", "gone_hash"), name) for x, name in (("not stays", "gone"), ("stays", "again")))
    rows = packed(docs, doc=F.col("doc_id"), hash=F.xxhash64("text"))
    on = F.col("doc").eqNullSafe(F.col("gone_doc")) & (F.col("hash") == F.col("gone_hash"))
    once = rows.join(again, on, "left_semi").withColumn("text", F.col("row.text")).dropDuplicates(["doc", "text"]).drop("text")
    # one strategy at every size: what goes is the built side, texts aren't sorted
    return unpacked(rows.join(again, on, "left_anti").join(gone.hint("shuffle_hash"), on, "left_anti").unionByName(once))


def op8_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component and verdict of every document: shingles of three words, 85 percent."""
    out = groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 85)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


ORACLE = {
    "op8_setsketch_near_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reach FROM d UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(reach) AS component_id FROM r GROUP BY node) c ON c.node = d.doc_id""",
}

"""LM scoring by a hierarchical Pitman-Yor model.

Every context has a restaurant, its customers are the training tokens that follow it, and all contexts share one parent, the
root, over a uniform base. A token's context is the word before it, and every word has a restaurant of its own. Totals of the
EXACT_CONTEXTS commonest words' restaurants are known to all tasks; those of all others, which are without bound, are summed where
their words' parts meet and sent back to the ranges that hold dishes of them. Tables of a restaurant are customers of the root. Numbers of tables are sampled by Gibbs, a dish of a restaurant at a time, from their
conditional given all else (by generalised Stirling numbers up to EXACT customers, by seating one group of customers after the
other beyond). Between sweeps restaurants' totals are exchanged, and each level's discount and strength are sampled from their
posterior on a grid. Predictive probabilities are averaged over the last sweeps.

The words are unbounded and the restaurants are not: counts are summed in each task, dealt by word into ranges, and every
sweep runs a range at a time and writes its seats, and those of the samples that are kept, for the next one. Only totals by
restaurant (a parameter's number) and the commonest pairs' scores (HOT_PAIRS at most) pass through the driver. Tokens of the commonest pairs are scored where they are read, by the seats of their
range; all others are sent to their word's range, and sums come back.

Defined results: a null or empty text is one end token; a null doc_id counts as an empty text for the fold; repeated rows
each get a row; with no training text at all every token has the base's only probability, 1.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH, BYTES, by_key, free, mark, materialize, mix64, only, setting, slices, text_buffer, tokens

#: Contexts: 0 is the beginning of a text, then come the commonest words; all others are the hash of their word. In rows the latter
#: are RARE, and their hashes stand beside.
EXACT_CONTEXTS = 60_000
CONTEXTS, CONTEXT, RARE = EXACT_CONTEXTS + 1, np.dtype(np.uint16), 65535
#: Sweeps; the first of them are burn-in.
SWEEPS, BURN_IN = 5, 2
EXACT, SEED = 24, 9
#: The grid of discounts and strengths.
DISCOUNTS, STRENGTHS = np.round(np.arange(0.05, 1, 0.05), 2), np.array([0.1, 0.3, 1, 3, 10, 30, 100, 300, 1000.0])
#: Bytes of text for each range of words, bytes of a flush, pairs that are scored where they are read, words counted in one go.
RANGE_BYTES, FLUSH_BYTES, HOT_PAIRS, MERGED_WORDS = 8 << 20, 4 << 20, 600_000, 1 << 19
#: Bytes of text split into words, and dishes sampled, at a time: what is computed on the way stays in the caches.
SLICE_BYTES, BLOCK = 1 << 18, 1 << 14
END = np.uint64(0xD1B54A32D192ED03)
#: For tables whose rows are blobs of megabytes: a page holds one, as compressing holds whole pages outside of the heap.
BLOBS = {"parquet.page.size.row.check.min": "1", "parquet.enable.dictionary": "false"}
#: Places of the totals in one list: of all restaurants, of the root, and what the posterior of both levels needs.
SQUARE = (EXACT + 1) ** 2
T_CHILD, C_CHILD, T_ROOT = 0, CONTEXTS, 2 * CONTEXTS
C_ROOT, N_ALL, V_ALL, DISHES = T_ROOT + 1, T_ROOT + 2, T_ROOT + 3, T_ROOT + 4
PATHS = DISHES + 2 * SQUARE
PLACES = PATHS + 2 * len(DISCOUNTS)


def distinct(x: np.ndarray) -> np.ndarray:
    """np.unique() by a sort of numbers, which takes a tenth of its time."""
    x = np.sort(x)
    return x[np.concatenate([np.ones(min(len(x), 1), bool), x[1:] != x[:-1]])]


def order(x: np.ndarray, bits: int = 64) -> np.ndarray:
    """A stable order of x (uint64, below 2**bits) by its first bits: all but those that a place takes, if both exceed 64. The
    places are sorted with the numbers, in a tenth of argsort's time."""
    place = np.uint64(len(x).bit_length())
    x = (x << np.uint64(64 - bits) >> place << place) | np.arange(len(x), dtype=np.uint64)
    x.sort()
    return (x & ((np.uint64(1) << place) - np.uint64(1))).astype(np.int64)


class Places:
    """Where hashes stand in a sorted array of hashes, as np.searchsorted() has it, and whether they are there. As hashes are spread
    evenly, their first bits lead to the place or a little before."""

    def __init__(self, keys: np.ndarray):
        bits = len(keys).bit_length() + 1
        self.shift, self.many = np.uint64(64 - bits), len(keys)
        self.first = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.keys = np.append(keys, ~np.uint64(0))  # a place for those beyond the last

    def __call__(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.first[wanted >> self.shift].astype(np.int64)
        behind = np.flatnonzero(self.keys[at] < wanted)
        while len(behind):
            at[behind] += 1
            behind = behind[self.keys[at[behind]] < wanted[behind]]
        return at, (self.keys[at] == wanted) & (at < self.many)


def histories(raw: np.ndarray, offsets: np.ndarray, common: np.ndarray | Places) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hash, context and text number of each token, an end after the words of each text. common: sorted hashes."""
    hashed, _, _, first = tokens(raw, offsets)
    n, texts = len(hashed), len(offsets) - 1
    owner = np.repeat(np.arange(texts), np.diff(first))
    place, own = (common if isinstance(common, Places) else Places(common))(hashed)
    word, context = np.empty(n + texts, np.uint64), np.zeros(n + texts, np.uint64)
    at = np.arange(n) + owner
    word[at], word[first[1:] + np.arange(texts)] = hashed, END
    context[at + 1] = np.where(own, (place + 1).astype(np.uint64), hashed)
    return word, context, np.repeat(np.arange(texts), np.diff(first) + 1)


def ranges(word: np.ndarray, many: int) -> np.ndarray:
    """The range of each hash: many equal parts of all hashes."""
    return ((word >> np.uint64(32)) * np.uint64(many) >> np.uint64(32)).astype(np.int64)


def narrow(context: np.ndarray) -> tuple[bytes, bytes]:
    """Contexts for a row: two bytes each, and the hashes of rare ones."""
    rare = context >= CONTEXTS
    return np.where(rare, RARE, context).astype(CONTEXT).tobytes(), context[rare].astype(np.uint64).tobytes()


def wide(context: bytes, rare) -> np.ndarray:
    """The contexts of narrow(), or, with places for hashes, of a range."""
    out = np.frombuffer(context, CONTEXT).astype(np.uint64 if isinstance(rare, bytes) else np.int64)
    out[out == RARE] = np.frombuffer(rare, np.uint64) if isinstance(rare, bytes) else rare
    return out


def pair_key(word: np.ndarray, context: np.ndarray) -> np.ndarray:
    """64 bits for a word in a context."""
    return mix64(word) + context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def fold(doc_id: str = "doc_id"):
    """crc32 of the doc_id as text, modulo 7; a null counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 7


def flushes(batches, text: int):
    """Arrow tables of some FLUSH_BYTES of text each."""
    import pyarrow as pa

    held, size = [], 0
    for batch in batches:
        for k in range(0, len(batch), 256):
            part = batch.slice(k, 256)
            held.append(part)
            size += part.column(text).nbytes
            if size >= FLUSH_BYTES or sum(map(len, held)) >= 32768:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def read_tokens(table, text: int, common: Places) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """histories() of all rows of an Arrow table, numbered through."""
    parts, done = [], 0
    for chunk in table.column(text).chunks:
        raw, offsets = text_buffer(chunk)
        for a, b in slices(offsets, SLICE_BYTES):
            word, context, owner = histories(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], common)
            parts.append((word, context, owner + done + a))
        done += len(chunk)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def trained(docs: DataFrame) -> DataFrame:
    """The texts that are learnt from."""
    return only(docs, "doc_id", "text").where(fold() != 2).select("text")


def common_words(docs: DataFrame, many: int, most: int | None = None) -> np.ndarray:
    """Sorted hashes of the commonest training words: all with at least so many tokens, the number chosen so that there are `most`
    (EXACT_CONTEXTS) at most. Every word is counted, in `many` ranges, so the result doesn't depend on partitions."""
    import pyarrow as pa

    schema, names = "key int, words binary, n binary", ["key", "words", "n"]

    def merged(held):
        word, n = (np.concatenate(x) for x in zip(*held, strict=True))
        some = distinct(word)
        return some, np.bincount(Places(some)(word)[0], n, len(some)).astype(np.int64)

    def rows(keys, word, n, cuts):
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([word[cuts[k] : cuts[k + 1]].tobytes() for k in range(len(keys))], pa.binary()), pa.array([whole(n[cuts[k] : cuts[k + 1]]) for k in range(len(keys))], pa.binary())], names)

    def count(batches):
        """A row for each range of words, of some MERGED_WORDS distinct words at a time."""
        held, waiting = [], 0

        def out():
            word, n = merged(held)
            cuts = np.searchsorted(ranges(word, many), np.arange(many + 1))
            some = np.flatnonzero(np.diff(cuts))
            return rows(some, word, n, [*cuts[some].tolist(), len(word)])

        for table in flushes(batches, 0):
            for chunk in table.column(0).chunks:
                raw, offsets = text_buffer(chunk)
                words = [tokens(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[0] for a, b in slices(offsets, SLICE_BYTES)]
                held.append(np.unique(np.concatenate(words), return_counts=True))
                waiting += len(held[-1][0])
            if waiting > MERGED_WORDS:
                held = [merged(held)]
                waiting = len(held[0][0])
                if waiting > MERGED_WORDS // 2:
                    yield out()
                    held, waiting = [], 0
        if held:
            yield out()

    def merge(batches):
        for key, t in by_key(batches, ("words", "n")):
            word, n = merged([(np.frombuffer(w, np.uint64), numbers(n, len(w) // 8).astype(np.int64)) for w, n in zip(t["words"].to_pylist(), t["n"].to_pylist(), strict=True)])
            yield rows([key], word, n, [0, len(word)])

    def unpacked(batches):
        for batch in batches:
            for w, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                yield np.frombuffer(w, np.uint64), numbers(n, len(w) // 8).astype(np.int64)

    def spread(batches):
        for _, n in unpacked(batches):
            n, times = np.unique(np.minimum(n, 65536), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(times.astype(np.int64))], ["n", "times"])

    counts = trained(docs).mapInArrow(count, schema).repartition("key").sortWithinPartitions("key").mapInArrow(merge, schema)
    counts = materialize(counts, "words", **BLOBS)
    found = counts.mapInArrow(spread, "n long, times long").groupBy("n").agg(F.sum("times").alias("times")).orderBy(F.desc("n")).collect()
    upto = np.cumsum([r.times for r in found])
    least = min((r.n for r, z in zip(found, upto, strict=True) if z <= (EXACT_CONTEXTS if most is None else most)), default=1 << 62)

    def best(batches):
        for word, n in unpacked(batches):
            yield pa.RecordBatch.from_arrays([pa.array([word[n >= least].tobytes()], pa.binary())], ["words"])

    return np.sort(np.frombuffer(b"".join(r.words for r in counts.mapInArrow(best, "words binary").collect()), np.uint64))


def counted(docs: DataFrame, many: int, common: np.ndarray) -> DataFrame:
    """range, words, runs, context, n, rare, places: the training tokens of each range of words, a row each. words: sorted distinct
    hashes; runs: how many contexts each has; context, n: contexts, sorted, and tokens of the word there. rare: sorted hashes of rare
    contexts of the range's tokens, of texts that aren't learnt from too; places: which of them the RARE contexts are."""
    import pyarrow as pa

    given = docs.sparkSession.sparkContext.broadcast(common)

    def packed(key, word, context, n, rare):
        """Entries of a word stand together."""
        new = np.flatnonzero(np.concatenate([np.ones(min(len(word), 1), bool), word[1:] != word[:-1]]))
        runs = np.diff(np.append(new, len(word))).astype(np.uint32)
        small, mine = narrow(context)
        return key, word[new].tobytes(), runs.tobytes(), small, whole(n), rare.tobytes(), mine

    names, types = ["key", "words", "runs", "context", "n", "rare", "places"], [pa.int32(), *[pa.binary()] * 6]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def count(batches):
        common = Places(given.value)
        for table in flushes(batches, 0):
            word, context, owner = read_tokens(table, 0, common)
            held = table.column(1).to_numpy()[owner]
            del owner
            # of texts that aren't learnt from, the rare contexts in each range
            asked = held & (context >= CONTEXTS)
            where, hashes = ranges(word[asked], many), context[asked]
            bits = np.uint64(many.bit_length())
            at = order(where.astype(np.uint64) << (np.uint64(64) - bits) | hashes >> bits)
            where, hashes = where[at], hashes[at]
            new = np.concatenate([np.ones(min(len(where), 1), bool), (where[1:] != where[:-1]) | (hashes[1:] != hashes[:-1])])
            where, hashes = where[new], hashes[new]
            word, context = word[~held], context[~held]
            del held, asked, new
            # orders by first bits may tear the few apart that share them: merge() sums those as well
            key = pair_key(word, context)
            at = order(key)
            key = key[at]
            new = np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), bool), key[1:] != key[:-1]]))
            at, n = at[new], np.diff(np.append(new, len(key)))
            del key, new
            some = order(word[at])
            at, n = at[some], n[some]
            word, context = word[at], context[at]
            cuts, more = (np.searchsorted(x, np.arange(many + 1)) for x in (ranges(word, many), where))
            some = np.flatnonzero((np.diff(cuts) > 0) | (np.diff(more) > 0)).tolist()
            if some:
                yield batch_of([packed(k, word[cuts[k] : cuts[k + 1]], context[cuts[k] : cuts[k + 1]], n[cuts[k] : cuts[k + 1]], hashes[more[k] : more[k + 1]]) for k in some])

    def merge(batches):
        for key, t in by_key(batches, tuple(names[1:])):
            rows = t.to_pylist()
            words = distinct(np.concatenate([np.frombuffer(r["words"], np.uint64) for r in rows]))
            asked = distinct(np.concatenate([np.frombuffer(r[c], np.uint64) for r in rows for c in ("rare", "places")]))
            word_at, asked_at, width = Places(words), Places(asked), CONTEXTS + len(asked)
            parts = []
            for r in rows:
                w, n = unpack(word_at(np.frombuffer(r["words"], np.uint64))[0].tobytes(), r["runs"], r["n"])
                context = wide(r["context"], asked_at(np.frombuffer(r["places"], np.uint64))[0] + CONTEXTS)
                parts.append((w * np.uint64(width) + context.astype(np.uint64), n))
            del rows, t
            pair, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            del parts
            bits = (len(words) * width).bit_length()
            at = order(pair, bits) if bits + len(pair).bit_length() <= 64 else np.argsort(pair)
            pair, n = pair[at], n[at]
            new = np.flatnonzero(np.concatenate([np.ones(min(len(pair), 1), bool), pair[1:] != pair[:-1]]))
            pair, n = pair[new], np.add.reduceat(n, new) if len(new) else n
            word = pair // np.uint64(width)
            context = pair - word * np.uint64(width)
            runs, rare = np.bincount(word.astype(np.int64), minlength=len(words)).astype(np.uint32), context >= CONTEXTS
            small = np.where(rare, RARE, context).astype(CONTEXT)
            yield batch_of([(key, words.tobytes(), runs.tobytes(), small.tobytes(), whole(n), asked.tobytes(), whole(context[rare] - np.uint64(CONTEXTS)))])

    schema = "key int, words binary, runs binary, context binary, n binary, rare binary, places binary"
    texts = docs.select("text", (fold() == 2).alias("held"))
    return texts.mapInArrow(count, schema).repartition("key").sortWithinPartitions("key").mapInArrow(merge, schema)


def whole(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs."""
    return x.astype(next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(x) or x.max() <= np.iinfo(k).max)).tobytes()


def numbers(blob: bytes, many: int) -> np.ndarray:
    """The numbers of whole()."""
    return np.frombuffer(blob, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[len(blob) // many]) if many else np.zeros(0, np.uint8)


def unpack_words(words: bytes, runs: bytes) -> np.ndarray:
    """The word of each entry."""
    return np.repeat(np.frombuffer(words, np.uint64), numbers(runs, len(words) // 8))


def unpack(words: bytes, runs: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    """word and n of each entry."""
    word = np.repeat(np.frombuffer(words, np.uint64), np.frombuffer(runs, np.uint32))
    return word, numbers(n, len(word)).astype(np.int64)


def stirling(discount: float) -> np.ndarray:
    """Logarithms of generalised Stirling numbers: the weight of c customers at t tables, up to EXACT."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[1, 1] = 0
    for c in range(1, EXACT):
        for t in range(1, c + 2):
            more = out[c, t] + np.log(c - discount * t) if t <= c else -np.inf
            out[c + 1, t] = np.logaddexp(out[c, t - 1], more)
    return out


def tables(c: np.ndarray, fresh, discount: float, weights: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray]:
    """Sample the numbers of tables of dishes with c customers. fresh(at)(i): what weight a further table has for the dishes
    `at` when they have i (one for all, or each its own). Also, for dishes beyond EXACT, the log-likelihood of each of DISCOUNTS
    given how they were seated."""
    out, paths = np.minimum(c, 1), np.zeros(len(DISCOUNTS))
    some = np.flatnonzero((c > 1) & (c <= EXACT))
    some = some[order(c[some].astype(np.uint64), EXACT.bit_length())]
    cuts = np.searchsorted(c[some], np.arange(2, EXACT + 2))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True), 2):
        # next to one table's weight, 1, no other's overflows, and those that underflow are nothing beside it
        drawn, scale = rng.random(b - a), np.exp(weights[k, 1 : k + 1] - weights[k, 1])
        for begin in range(a, b, BLOCK):
            at = some[begin : min(begin + BLOCK, b)]
            more, path, chance = fresh(at), 1.0, [1.0]
            for i in range(1, k):
                path = path * more(i)
                chance.append(chance[-1] + path * scale[i])
            least, t = drawn[begin - a : begin - a + len(at)] * chance[-1], np.ones(len(at), np.int64)
            for x in chance[:-1]:
                t += x < least
            out[at] = t
    at = np.flatnonzero(c > EXACT)
    t, j = np.ones(len(at)), 1
    while len(at):
        step = max(1, j // 16)
        new, old = fresh(at)(t), np.maximum(j - discount * t, 1e-9)
        group = np.minimum(c[at] - j, step)
        more = rng.binomial(group, np.minimum(new / (new + old), 1))
        many, each = group - more, t
        if t.max() < len(t):  # few numbers of tables: a logarithm for each
            many = np.bincount(t.astype(np.int64), many)
            each = np.flatnonzero(many)
            many = many[each]
        paths += (many[:, None] * np.log(np.maximum(j - DISCOUNTS * each[:, None], 1e-9))).sum(0)
        t, j = t + more, j + step
        done = c[at] <= j
        out[at[done]] = t[done]
        at, t = at[~done], t[~done]
    return out, paths


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function, by its series beyond 8."""
    y = x + 8
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - sum(np.log(x + k) for k in range(8))


#: As Setting.add() takes them.
NO_RARE = (np.zeros(0),) * 4


@dataclass
class Setting:
    """What all ranges share before each sweep: the totals, and discount and strength of the root and of the contexts."""

    totals: list[np.ndarray] = field(default_factory=list)
    levels: list[tuple[float, float, float, float]] = field(default_factory=lambda: [(0.5, 1.0, 0.5, 1.0)])

    def base(self) -> float:
        return 1 / (self.totals[0][V_ALL] + 1)

    def add(self, totals: np.ndarray, rare: tuple[np.ndarray, ...] = NO_RARE) -> None:
        """Take the totals after a sweep and sample the levels that go with them: each pair of the grid has the likelihood of
        all seatings of its level. rare: tables, how many rare restaurants have so many, customers, and how many have those."""
        rng = np.random.default_rng([SEED, 1 << 31, len(self.totals)])
        self.totals.append(totals)
        found = []
        for level, (t, c) in enumerate(((totals[T_ROOT : T_ROOT + 1], totals[C_ROOT : C_ROOT + 1]), (totals[T_CHILD:C_CHILD], totals[C_CHILD:T_ROOT]))):
            seats = totals[DISHES + level * SQUARE : DISHES + (level + 1) * SQUARE].reshape(EXACT + 1, EXACT + 1)
            (t, many_t), (c, many_c) = (np.unique(x[c > 0], return_counts=True) for x in (t, c))
            if level:
                t, many_t, c, many_c = (np.concatenate(x) for x in zip((t, many_t, c, many_c), rare, strict=True))
            weight = np.zeros((len(DISCOUNTS), len(STRENGTHS)))
            for i, d in enumerate(DISCOUNTS):
                weight[i] += totals[PATHS + level * len(DISCOUNTS) + i] + (seats[seats > 0] * stirling(d)[seats > 0]).sum()
                for j, s in enumerate(STRENGTHS):
                    weight[i, j] += (many_t * (t * np.log(d) + log_gamma(s / d + t) - log_gamma(np.array(s / d)))).sum() - (many_c * (log_gamma(s + c) - log_gamma(np.array(s)))).sum()
            chance = np.cumsum(np.exp(weight - weight.max()).ravel())
            at = int(np.searchsorted(chance, rng.random() * chance[-1], "right"))
            found += [float(DISCOUNTS[at // len(STRENGTHS)]), float(STRENGTHS[at % len(STRENGTHS)])]
        if totals[N_ALL]:
            self.levels[len(self.totals) - 1 :] = [tuple(found)]
        else:
            self.levels.append(self.levels[-1])


class Range:
    """The dishes of a range of words, in the root and in their contexts."""

    def __init__(self, words: bytes, runs: bytes, context: bytes, n: bytes, rare: bytes = b"", places: bytes = b"", crowd: list[bytes] | None = None):
        """crowd: customers and, of one sweep or several, tables of rare contexts."""
        self.words, runs = np.frombuffer(words, np.uint64), np.frombuffer(runs, np.uint32)
        _, self.c2 = unpack(words, runs.tobytes(), n)
        self.rare = np.frombuffer(rare, np.uint64)
        at = np.frombuffer(context, CONTEXT) == RARE
        self.child = wide(context, numbers(places, int(at.sum())).astype(np.int64) + CONTEXTS).astype(np.int32)
        self.crowd = [numbers(x, len(self.rare)).astype(np.float64) for x in crowd or []] or [np.zeros(len(self.rare))] * 2
        self.word2 = np.repeat(np.arange(len(self.words), dtype=np.int32), runs)
        self.begins = np.cumsum(runs, dtype=np.int64) - runs
        self.count = self.by_word(self.c2).astype(np.float64)
        self.t2, self.t0 = np.ones(len(self.c2), np.int64), np.ones(len(self.words), np.int64)
        self.paths = np.zeros((2, len(DISCOUNTS)))
        self.sum()

    def by_word(self, x: np.ndarray) -> np.ndarray:
        """Sums of a word's dishes, which stand together."""
        return np.add.reduceat(x, self.begins) if len(x) else np.zeros(0, np.int64)

    def sum(self) -> None:
        """Tables are customers of the root."""
        self.c0 = self.by_word(self.t2)

    def by_context(self) -> list[np.ndarray]:
        """Tables and customers of the range's dishes in each context."""
        return [np.bincount(self.child, v, CONTEXTS + len(self.rare)) for v in (self.t2, self.c2)]

    def open(self, s: Setting, k: int, crowd: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Tables and customers of all contexts, under the totals number k; the last place is an empty restaurant."""
        x = s.totals[k]
        return tuple(np.concatenate([x[a : a + CONTEXTS], self.crowd[j], [0]]) for a, j in ((T_CHILD, crowd), (C_CHILD, 0)))

    def totals(self, by_context: list[np.ndarray] | None = None) -> np.ndarray:
        out = np.zeros(PLACES)
        out[T_CHILD:C_CHILD], out[C_CHILD:T_ROOT] = (x[:CONTEXTS] for x in by_context or self.by_context())
        out[T_ROOT], out[C_ROOT], out[N_ALL], out[V_ALL] = self.t0.sum(), self.c0.sum(), self.c2.sum(), len(self.words)
        for k, (c, t) in enumerate(((self.c0, self.t0), (self.c2, self.t2))):
            some = c <= EXACT
            out[DISHES + k * SQUARE : DISHES + (k + 1) * SQUARE] = np.bincount(c[some] * (EXACT + 1) + t[some], minlength=SQUARE)
        out[PATHS:] = self.paths.ravel()
        return out

    def predictive(self, s: Setting, k: int, crowd: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Predictive probabilities of every dish in the root and in its contexts, under the totals and levels number k."""
        (d0, s0, d1, s1), x = s.levels[k], s.totals[k]
        p0 = (self.c0 - d0 * self.t0 + (s0 + d0 * x[T_ROOT]) * s.base()) / (s0 + x[C_ROOT])
        t, c = self.open(s, k, crowd)
        return p0, (self.c2 - d1 * self.t2 + (s1 + d1 * t[self.child]) * p0[self.word2]) / (s1 + c[self.child])

    def sweep(self, s: Setting, k: int, rng) -> None:
        """Sample all numbers of tables, contexts first. A dish's own tables count nowhere while it is sampled."""
        (d0, s0, d1, s1), x = s.levels[k], s.totals[k]
        some = np.flatnonzero(self.c2 > 1)  # one customer has one table
        w, t = self.word2[some], self.t2[some]
        others, had, rest = self.c0[w] - t, self.t0[w], np.maximum(x[C_ROOT] - t, 0)
        free, fresh0 = s1 + d1 * np.maximum(self.open(s, k)[0][self.child[some]] - t, 0), (s0 + d0 * x[T_ROOT]) * s.base()

        def fresh(at):
            o = others[at]
            f, o, r = free[at], o - d0 * np.where(o > 0, had[at], 1), s0 + rest[at]
            return lambda i: (f + d1 * i) * (np.maximum(o + i, 0) + fresh0) / (r + i)

        self.t2[some], self.paths[1] = tables(self.c2[some], fresh, d1, stirling(d1), rng)
        self.sum()
        self.t0, self.paths[0] = tables(self.c0, lambda at: lambda i: fresh0, d0, stirling(d0), rng)

    def seats(self) -> list[bytes]:
        return [whole(self.t2), whole(self.t0)]

    def seated(self, seats: list[bytes]) -> Range:
        """Take seats that were written."""
        self.t2, self.t0 = (numbers(x, n).astype(np.int64) for x, n in zip(seats, (len(self.c2), len(self.words)), strict=True))
        self.sum()
        return self


class Scorer:
    """Averaged predictive probabilities of the words of a range; words that it doesn't hold are unknown. Of dishes in contexts
    only the sum over samples is kept. seats: of the kept samples, one after another."""

    def __init__(self, dishes: Range, seats: list[bytes], s: Setting):
        self.s, self.samples, seen = s, [], np.zeros(len(dishes.c2))
        for k in range(SWEEPS - BURN_IN):
            if seats:
                dishes.seated(seats[2 * k : 2 * k + 2])
            crowd = min(k + 1, len(dishes.crowd) - 1)
            p0, p1 = dishes.predictive(s, BURN_IN + k + 1, crowd)
            self.samples.append((BURN_IN + k + 1, p0, crowd))
            seen = seen + p1
        self.words, self.count, self.seen = dishes.words, dishes.count, seen
        self.n, self.child, self.word2 = dishes.c2, dishes.child, dishes.word2
        self.dishes, self.width = dishes, CONTEXTS + len(dishes.rare) + 1
        self.keys = dishes.word2.astype(np.int64) * self.width + dishes.child

    def ready(self) -> Scorer:
        """Before tokens are looked up: places, logarithms of a word's count and, for each sample, of unseen dishes the word's
        probability in the root (the last: of unknown words) and the share of it that each context leaves."""
        self.rare_at, self.base, self.unseen = Places(self.dishes.rare), np.log10(np.append(self.count, 0) + 1), []
        for k, p0, crowd in self.samples:
            (d0, s0, d1, s1), x = self.s.levels[k], self.s.totals[k]
            t, c = self.dishes.open(self.s, k, crowd)
            self.unseen.append((np.append(p0, (s0 + d0 * x[T_ROOT]) * self.s.base() / (s0 + x[C_ROOT])), (s1 + d1 * t) / (s1 + c)))
        return self

    def look(self, word: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each token: its word's number (the number of words, if unknown) and log10 of its averaged probability."""

        def find(keys, wanted):
            at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
            return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)

        new = np.flatnonzero(np.concatenate([np.ones(min(len(word), 1), bool), word[1:] != word[:-1]]))  # they come in runs
        w, known = find(self.words, word[new])
        w = np.repeat(np.where(known, w, len(self.words)), np.diff(np.append(new, len(word))))
        context = context.astype(np.uint64)
        rare = np.flatnonzero(context >= CONTEXTS)
        place, asked = self.rare_at(context[rare])
        context = context.astype(np.int64)
        context[rare] = np.where(asked, CONTEXTS + place, self.width - 1)
        key = (w * self.width + context).astype(np.uint64)
        some = order(key, min(64, ((len(self.words) + 1) * self.width).bit_length()))
        at, there = np.empty(len(key), np.int64), np.empty(len(key), bool)
        at[some], there[some] = find(self.keys, key[some].astype(np.int64))  # sorted, they are found faster
        p = self.seen[at] if len(self.seen) else np.zeros(len(word))
        other = np.flatnonzero(~there)
        w1, context = w[other], context[other]
        p[other] = sum(share[context] * above[w1] for above, share in self.unseen)
        return w, np.log10(p / len(self.samples))

    def __call__(self, word: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token: its training count, and whether it has one, and log10 of its averaged probability."""
        w, logs = self.ready().look(word, context)
        return np.append(self.count, 0)[w], w < len(self.words), logs


MODEL = ("words", "runs", "context", "n", "rare", "places")
#: A row a range (words to crowd), a row a task (place, x) and, of each range, a row for each part that it has rare contexts of: part,
#: words (their hashes), n (its tables there) and at first runs (its customers).
STATE = "key int, words binary, runs binary, context binary, n binary, rare binary, places binary, seats array<binary>, crowd array<binary>, place binary, x binary, part int"


def swept(state: DataFrame, back: DataFrame | None, s: Setting, k: int, parts: int) -> DataFrame:
    """The state after sweep number k (-1: as it begins, every dish at one table; SWEEPS: only what came back is taken in). back:
    totals of rare contexts after the sweep before."""
    import pyarrow as pa

    fields = [(f.split()[0], pa.list_(pa.binary()) if "<" in f else pa.int32() if f.endswith(" int") else pa.binary()) for f in STATE.split(", ")]

    def out(**row):
        return pa.RecordBatch.from_arrays([pa.array([row.get(n)], t) for n, t in fields], [n for n, _ in fields])

    def ranged(batches):
        """Ranges with what came back for them."""
        row, got = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] is not None:
                    got.append(r)
                    continue
                if row:
                    yield row, got
                row, got = r, []
        if row:
            yield row, got

    def run(batches):
        total = np.zeros(PLACES)
        for row, got in ranged(batches):
            if k >= 0:
                cuts = np.searchsorted(ranges(np.frombuffer(row["rare"], np.uint64), parts), np.arange(parts + 1))
                taken = lambda c: whole(np.concatenate([np.zeros(0, np.int64), *[numbers(g[c], int(cuts[g["part"] + 1] - cuts[g["part"]])).astype(np.int64) for g in got]]))  # noqa: E731, B023
                crowd = row["crowd"] or [taken("runs")]
                row["crowd"] = crowd[: len(crowd) if k - 1 > BURN_IN else 1] + [taken("n")]
            if k < SWEEPS:
                dishes, seats = Range(*(row[c] for c in MODEL), row["crowd"]), row["seats"] or []
                if k >= 0:
                    dishes.seated(seats[-2:])
                    dishes.sweep(s, k, np.random.default_rng([SEED, row["key"], k]))
                sums = dishes.by_context()
                total += dishes.totals(sums)
                row["seats"] = (seats if k > BURN_IN else []) + dishes.seats()
                cuts = np.searchsorted(ranges(dishes.rare, parts), np.arange(parts + 1))
                t, c = (x[CONTEXTS:].astype(np.int64) for x in sums)
                for j in np.flatnonzero(np.diff(cuts)).tolist():
                    at = slice(cuts[j], cuts[j + 1])
                    yield out(key=row["key"], part=j, words=dishes.rare[at].tobytes(), n=whole(t[at]), runs=whole(c[at]) if k < 0 else None)
            yield out(**row)
        at = np.flatnonzero(total).astype(np.int32)
        yield out(place=at.tobytes(), x=total[at].tobytes())

    spark = state.sparkSession
    rows = state.where("key is not null and part is null")
    if back is not None:
        rows = rows.unionByName(back.where("key is not null"), True).repartition("key").sortWithinPartitions("key", F.col("part").asc_nulls_first())
    with setting(spark, BATCH, "1"):  # rows are ranges
        return materialize(rows.mapInArrow(run, STATE), f"state{k}", **BLOBS)


def met(state: DataFrame) -> DataFrame:
    """Totals of rare contexts over all ranges: for each range and part its contexts' tables (n) and at first customers (runs), in its
    own order; and rows without a key: how many (n) restaurants have so many (words) tables, or (runs) customers."""
    import pyarrow as pa

    names, types = ["key", "part", "words", "runs", "n"], [pa.int32(), pa.int32(), *[pa.binary()] * 3]

    def out(*row):
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

    def total(batches):
        for part, t in by_key(batches, ("range", "words", "runs", "n")):
            rows = t.to_pylist()
            hashes = [np.frombuffer(r["words"], np.uint64) for r in rows]
            some = distinct(np.concatenate(hashes))
            at = Places(some)(np.concatenate(hashes))[0]
            cuts = np.cumsum([0, *map(len, hashes)])
            sums = {}
            for c in ("n", "runs"):
                if rows[0][c] is not None:
                    each = np.concatenate([numbers(r[c], len(h)) for r, h in zip(rows, hashes, strict=True)])
                    sums[c] = np.bincount(at, each, len(some)).astype(np.int64)
                    values, many = np.unique(sums[c][sums[c] > 0], return_counts=True)
                    blobs = {c: values.tobytes()}
                    yield out(None, part, blobs.get("n"), blobs.get("runs"), many.astype(np.int64).tobytes())
            for j, r in enumerate(rows):
                mine = at[cuts[j] : cuts[j + 1]]
                yield out(r["range"], part, None, whole(sums["runs"][mine]) if "runs" in sums else None, whole(sums["n"][mine]))

    rows = state.where("part is not null").select(F.col("part").alias("key"), F.col("key").alias("range"), "words", "runs", "n")
    return materialize(rows.repartition("key").sortWithinPartitions("key").mapInArrow(total, "key int, part int, words binary, runs binary, n binary"), "met", **BLOBS)


def spread_of(back: DataFrame, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of tables (column words) or customers (runs), and how many rare restaurants have each."""
    import pyarrow as pa

    def read(batches):
        for batch in batches:
            for value, many in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(value, np.int64)), pa.array(np.frombuffer(many, np.int64))], ["value", "many"])

    rows = back.where(f"key is null and {column} is not null").select(column, "n").mapInArrow(read, "value long, many long")
    found = rows.groupBy("value").agg(F.sum("many").alias("many")).orderBy("value").collect()
    return np.array([r.value for r in found], float), np.array([r.many for r in found], float)


def summed(state: DataFrame) -> np.ndarray:
    """The totals of all ranges: rows of tasks are added up in tasks first, then here, a row for each of a few tasks."""
    import pyarrow as pa

    def add(batches):
        total = np.zeros(PLACES)
        for batch in batches:
            for place, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[np.frombuffer(place, np.int32)] += np.frombuffer(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["x"])

    rows = state.where("place is not null").select("place", "x").repartition(8)
    return np.sum([np.frombuffer(r.x) for r in rows.mapInArrow(add, "x binary").collect()], 0)


def hot_pairs(model: DataFrame, s: Setting, most: int = HOT_PAIRS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (sorted), training counts of the word and log10 probabilities of the commonest pairs of word and context: all pairs
    with at least so many tokens, the number chosen so that there are `most` at most."""
    import pyarrow as pa

    def spread(batches):
        for batch in batches:
            for row in batch.to_pylist():
                n, many = np.unique(np.minimum(unpack(row["words"], row["runs"], row["n"])[1], 65536), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(many.astype(np.int64))], ["n", "many"])

    found = model.mapInArrow(spread, "n long, many long").groupBy("n").agg(F.sum("many").alias("many")).orderBy(F.desc("n")).collect()
    upto = np.cumsum([r.many for r in found])
    least = min((r.n for r, z in zip(found, upto, strict=True) if z <= most and r.n > 1), default=1 << 62)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                scorer = Scorer(Range(*(row[c] for c in MODEL), row["crowd"]), row["seats"], s)
                at = np.flatnonzero(scorer.n >= least)
                w = scorer.word2[at]
                logs = np.log10(scorer.seen[at] / len(scorer.samples))
                child = np.concatenate([np.arange(CONTEXTS, dtype=np.uint64), scorer.dishes.rare])[scorer.child[at]]
                blobs = (pair_key(scorer.words[w], child), scorer.count[w], logs)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in blobs], ["pair", "count", "log"])

    rows = model.mapInArrow(run, "pair binary, count binary, log binary").collect()  # a row a range, HOT_PAIRS pairs in all
    keys, counts, logs = (np.frombuffer(b"".join(r[k] for r in rows), t) for k, t in enumerate((np.uint64, np.float64, np.float64)))
    order = np.argsort(keys)
    return keys[order], counts[order], logs[order]


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    # Arrow batches of a flush: by default a task's whole text is one batch, which executor and worker hold, beside the flush
    with setting(docs.sparkSession, BYTES, str(FLUSH_BYTES)):
        return scored(docs)


def scored(docs: DataFrame) -> DataFrame:
    """score(), in Arrow batches as they are set."""
    import pyarrow as pa

    spark = docs.sparkSession
    docs = only(docs, "doc_id", "text")
    many = int(max(1, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE_BYTES)))
    at, s = mark(), Setting()
    common = common_words(docs, many)
    free(at)
    blank = [*[F.lit(None).cast("array<binary>").alias(c) for c in ("seats", "crowd")], *[F.lit(None).cast("binary").alias(c) for c in ("place", "x")], F.lit(None).cast("int").alias("part")]
    state, back, parts = materialize(counted(docs, many, common).select("*", *blank), "counts", **BLOBS), None, -(-many // 4)
    for k in range(-1, SWEEPS):
        state = swept(state, back, s, k, parts)
        free(at, 1)  # the state before
        back = met(state)
        if k < 0:
            customers = spread_of(back, "runs")
        s.add(summed(state), (*spread_of(back, "words"), *customers))
    state = swept(state, back, s, SWEEPS, parts)
    free(at, 1)
    model = state.where("key is not null").select("key", *MODEL, "seats", "crowd")
    with setting(spark, BATCH, "1"):
        hot = hot_pairs(model, s)
    n_all, v_all = int(s.totals[0][N_ALL]), int(s.totals[0][V_ALL])
    # plain lists and arrays: a class would be looked up where executors have no copy of this package
    shared, fast = spark.sparkContext.broadcast((s.totals, s.levels)), spark.sparkContext.broadcast((common, *hot))
    kind = docs.schema["doc_id"].dataType.simpleString()
    binary = ["words", "runs", "context", "texts", "rare"]

    def sums(owner, texts, known, base, logs):
        """Sums of tokens by text."""
        return np.bincount(owner, known, texts).astype(np.float64), np.bincount(owner, base, texts), np.bincount(owner, logs, texts)

    def deal(batches):
        """Rows of tokens for each range of words, and one of the texts themselves (its key is below 0) with what is scored here."""
        common, pairs, counts, logs = fast.value
        common, pairs, base = Places(common), Places(pairs), np.log10(counts + 1)
        task = TaskContext.get().partitionId()
        at = task << 33
        for table in flushes(batches, 1):
            # a slice at a time, so that only tokens that are sent are held for all texts of a flush
            texts, parts, told, done = len(table), [], [], 0
            for chunk in table.column(1).chunks:
                raw, offsets = text_buffer(chunk)
                for a, b in slices(offsets, SLICE_BYTES):
                    word, context, owner = histories(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], common)
                    place, here = pairs(pair_key(word, context))
                    place, mine = place[here], owner[here]
                    told.append((np.bincount(owner, minlength=b - a), *sums(mine, b - a, None, base[place], logs[place])))
                    parts.append((word[~here], context[~here], (owner[~here] + done + a).astype(np.uint16)))
                done += len(chunk)
            tokens_in, *total = (np.concatenate(x) for x in zip(*told, strict=True))
            word, context, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
            del parts, told
            some = order(word)  # words that share the first bits may come in several runs
            word, context, owner = word[some], context[some], owner[some]
            cuts = np.searchsorted(ranges(word, many), np.arange(many + 1))
            keys, blobs = [], []
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                a, b = cuts[k], cuts[k + 1]
                new = np.flatnonzero(np.concatenate([[True], word[a + 1 : b] != word[a : b - 1]]))
                keys.append(k)
                small, rare = narrow(context[a:b])
                blobs.append((word[a:b][new].tobytes(), whole(np.diff(np.append(new, b - a))), small, owner[a:b].tobytes(), rare))
            blobs.append((tokens_in.astype(np.int64).tobytes(), total[0].tobytes(), total[1].tobytes(), total[2].tobytes(), None))
            keys.append(-1 - task)
            ids = table.column(0).combine_chunks()
            ids = ids if isinstance(ids, pa.Array) else pa.concat_arrays(ids.chunks)
            lists = pa.ListArray.from_arrays(pa.array([0] * len(keys) + [texts], pa.int32()), ids)
            held = table.column(2).combine_chunks()
            held = held if isinstance(held, pa.Array) else pa.concat_arrays(held.chunks)
            flags = pa.ListArray.from_arrays(pa.array([0] * len(keys) + [texts], pa.int32()), held)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([at] * len(keys), pa.int64()), *[pa.array(c, pa.binary()) for c in zip(*blobs, strict=True)], lists, flags], ["key", "flush", *binary, "ids", "held"])
            at += texts

    dealt = docs.select("doc_id", "text", (fold() == 2).alias("held"))
    dealt = dealt.mapInArrow(deal, f"key int, flush long, words binary, runs binary, context binary, texts binary, rare binary, ids array<{kind}>, held array<boolean>")
    sums_of = ["key", "texts", "known", "base", "logs", "ids", "held"]

    def ranged(batches):
        """Sums by text of the tokens of each range: its model comes first (flush -1), then tokens of each flush. Rows of texts pass."""
        now = scorer = None
        for batch in batches:
            lists = [batch.schema.field(c).type for c in ("ids", "held")]
            for j, row in enumerate(batch.drop_columns(["ids", "held"]).to_pylist()):
                if row["key"] < 0:
                    one = batch.slice(j, 1)
                    yield pa.RecordBatch.from_arrays([one.column(c) for c in ("flush", "words", "runs", "context", "texts", "ids", "held")], sums_of)
                    continue
                if row["key"] != now:
                    now, known = row["key"], row["flush"] < 0
                    blobs = [row[c] for c in ("words", "runs", "context", "texts", "rare", "places", "crowd")] if known else [b""] * 4
                    scorer = Scorer(Range(*blobs), row["seats"] if known else [], Setting(*shared.value)).ready()
                if row["flush"] >= 0:
                    word, owner = unpack_words(row["words"], row["runs"]), np.frombuffer(row["texts"], np.uint16).astype(np.int64)
                    w, logs = scorer.look(word, wide(row["context"], row["rare"]))
                    known, base, logs = sums(owner, int(owner.max()) + 1, w < len(scorer.words), scorer.base[w], logs)
                    at = np.flatnonzero(np.bincount(owner))
                    yield pa.RecordBatch.from_arrays([pa.array([row["flush"]], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in (at.astype(np.uint16), known[at].astype(np.uint32), base[at], logs[at].astype(np.float32))], *[pa.nulls(1, x) for x in lists]], sums_of)

    tables_first = model.select("key", F.lit(-1).cast("long").alias("flush"), "words", "runs", "context", F.col("n").alias("texts"), "rare", "seats", "places", "crowd")
    both = tables_first.unionByName(dealt, True)
    back = both.repartition("key").sortWithinPartitions("key", "flush").mapInArrow(ranged, f"key long, texts binary, known binary, base binary, logs binary, ids array<{kind}>, held array<boolean>")
    with setting(spark, BATCH, "32"):
        back = materialize(back, "sums", **BLOBS)

    def add(batches):
        for _, t in by_key(batches, ("texts", "known", "base", "logs", "ids", "held")):
            # one row holds the texts themselves
            ids = t["ids"].combine_chunks()
            ids = ids if isinstance(ids, pa.Array) else pa.concat_arrays(ids.chunks)
            me = int(np.flatnonzero(np.asarray(ids.is_valid()))[0])
            rows = t.to_pylist()
            number = np.frombuffer(rows[me]["texts"], np.int64)
            known, base, logs = (np.frombuffer(rows[me][c]).copy() for c in ("known", "base", "logs"))
            for k, r in enumerate(rows):
                if k != me:
                    at = np.frombuffer(r["texts"], np.uint16)
                    known[at] += np.frombuffer(r["known"], np.uint32)
                    base[at] += np.frombuffer(r["base"])
                    logs[at] += np.frombuffer(r["logs"], np.float32)
            base -= number * np.log10(n_all + v_all + 1)
            yield pa.RecordBatch.from_arrays([ids[me].values, pa.array(rows[me]["held"], pa.bool_()), pa.array(number), pa.array(known.astype(np.int64)), pa.array(np.full(len(number), n_all)), pa.array(base), pa.array(logs)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = back.repartition("key").sortWithinPartitions("key")
    return out.mapInArrow(add, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def perplexity(scored: DataFrame) -> DataFrame:
    """held_out, n_tokens, perplexity and base_perplexity over all tokens of each part."""
    both = scored.groupBy("held_out").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("score").alias("s"), F.sum("base_score").alias("b"))
    return both.select("held_out", "n_tokens", F.pow(F.lit(10.0), -F.col("s") / F.col("n_tokens")).alias("perplexity"), F.pow(F.lit(10.0), -F.col("b") / F.col("n_tokens")).alias("base_perplexity"))


def op9_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Token ids in binary files: ids by falling frequency, in byte-aligned variable lengths, with separate control bytes.

A corpus is tokenised and its ids are counted; the commonest id has rank 0, so that most ranks take one byte. Documents are sorted
by doc_id in ranges, and each range is one file. A file is a row of blocks:

  header    32 bytes, little-endian: b"RKT1", documents (u32), ids (u64), bytes of data (u64), crc32 of all that follows (u32), 0 (u32)
  documents one bit pattern each: doc_id (i64), ids (u64), 1 if doc_id is known (u8); one array after another
  control   two bits for each rank, four ranks a byte, the first in the lowest bits: bytes of the rank less one
  data      the ranks' bytes, lowest first
  end       b"\\n", which Spark's text writer puts after every block

A reader needs no bit twiddling for a rank: a table of 256 rows gives the four lengths that a control byte stands for, sums of
lengths give where each rank begins, and the frequency table turns ranks into ids. Blocks hold some 262,144 ids (one document at
least), files some 16 MB, so neither side ever holds more than a file (JVM) or a block (Python).

Files are written by Spark's own writer and committer, so a task that is lost writes again and any file system of Spark's will do;
`ranks` (Parquet: rank, id, n) stands beside them. What goes to the driver is the frequency table, as long as the vocabulary.

The tokenizer is given as the file of the `tokenizers` library; its text is broadcast. Where its words end in a mark and white space
is dropped, a word's ids don't depend on its neighbours: each task then encodes distinct words only, and words of letters without
the marks that follow them. Other tokenizers get whole texts.

Defined results: a null text is empty and has the end id alone; null doc_ids come first, equal doc_ids by a hash of their ids, and
which of equal rows comes first is open, as nothing tells them apart; an empty table gives files without blocks and an empty
result; a text of any length is one document of one block; further columns play no part. Bytes that are no UTF-8 are read as U+FFFD.
"""

from __future__ import annotations

import json
import os
import string
import zlib
from collections.abc import Callable, Iterator
from itertools import chain
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, only, scratch, setting, slices, text_buffer

if TYPE_CHECKING:
    import pyarrow as pa

MAGIC, HEADER = b"RKT1", np.dtype([("magic", "S4"), ("docs", "<u4"), ("ids", "<u8"), ("data", "<u8"), ("crc", "<u4"), ("none", "<u4")])
BLOCK_IDS, FILE_BYTES = 1 << 18, 16 << 20
#: Bytes of text that a task cuts into words at once; words that it remembers before it begins anew.
AT_ONCE, KNOWN = 3 << 20, 1 << 19
MARKS = string.punctuation
#: The four lengths of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.int64) + 1


def packed_ranks(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of ranks."""
    ranks = ranks.astype("<u4")
    more = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    two_bits = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    two_bits[: len(ranks)] = more
    control = (two_bits.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    return control, ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= more[:, None]]


def unpacked_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n ranks behind control and data bytes."""
    lengths = LENGTHS[control].reshape(-1)[:n]
    begins = np.cumsum(lengths) - lengths
    ranks = data[begins].astype(np.uint32)
    for k in (1, 2, 3):
        at = np.flatnonzero(lengths > k)
        ranks[at] |= data[begins[at] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def block(doc_ids: np.ndarray, known: np.ndarray, sizes: np.ndarray, ranks: np.ndarray) -> bytes:
    """A block of a file, without its end."""
    control, data = packed_ranks(ranks)
    body = b"".join((doc_ids.astype("<i8").tobytes(), sizes.astype("<u8").tobytes(), known.astype(np.uint8).tobytes(), control.tobytes(), data.tobytes()))
    return np.array([(MAGIC, len(doc_ids), len(ranks), len(data), zlib.crc32(body), 0)], HEADER).tobytes() + body


def blocks(content: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """doc_ids, known, sizes and ranks of each block of a file; a file that was cut off or changed is an error."""
    at, whole = 0, memoryview(content)
    while at < len(whole):
        if len(whole) - at < HEADER.itemsize:
            raise ValueError("a token file ends within a header")
        head = np.frombuffer(whole, HEADER, 1, at)[0]
        docs, n, weight = int(head["docs"]), int(head["ids"]), int(head["data"])
        body = whole[at + HEADER.itemsize : at + HEADER.itemsize + 17 * docs + -(-n // 4) + weight]
        if head["magic"] != MAGIC or zlib.crc32(body) != head["crc"]:
            raise ValueError("a token file holds a damaged block")
        control = np.frombuffer(body, np.uint8, -(-n // 4), 17 * docs)
        data = np.frombuffer(body, np.uint8, weight, 17 * docs + len(control))
        yield np.frombuffer(body, "<i8", docs), np.frombuffer(body, np.uint8, docs, 16 * docs).astype(bool), np.frombuffer(body, "<u8", docs, 8 * docs).astype(np.int64), unpacked_ranks(control, data, n)
        at += HEADER.itemsize + len(body) + 1


def strings(column) -> list[str]:
    """An Arrow column of strings without nulls as a list, faster than by its scalars."""
    return column.to_numpy(zero_copy_only=False).tolist()


class Words:
    """Ids of words, for a tokenizer whose words end in a mark; remembers the words that it has met, without the marks that follow
    them. Words are cut, counted and stripped as Arrow columns; Python only sees those that are new."""

    def __init__(self, tokenizer, ends: np.ndarray):
        self.tokenizer, self.ends = tokenizer, ends
        self.forget()

    def forget(self) -> None:
        self.known, self.pool, self.begin, self.size, self.used = {"": 0}, np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def keep(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Remember the words' ids, which follow one another in ids."""
        n = len(self.known)
        self.pool, self.begin, self.size = (x if len(x) >= least else np.resize(x, 2 * least) for x, least in ((self.pool, self.used + len(ids)), (self.begin, n + len(words)), (self.size, n + len(words))))
        self.pool[self.used : self.used + len(ids)] = ids
        self.begin[n : n + len(words)], self.size[n : n + len(words)] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(ids)
        self.known.update(zip(words, range(n, n + len(words)), strict=True))

    def plain(self, words: list[str]) -> None:
        """Learn words by themselves."""
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        self.keep(words, np.fromiter(chain.from_iterable(ids), np.uint32), np.array([len(x) for x in ids], np.int64))

    def of_letters(self, words: list[str]) -> None:
        """Learn words of letters. Many are encoded as one text, which is cut where a word ends; if that isn't once for each word
        (a letter may turn into two characters, one no letter), each is encoded by itself."""
        chunks = [words[i : i + 256] for i in range(0, len(words), 256)]
        for chunk, x in zip(chunks, self.tokenizer.encode_batch_fast([" ".join(c) for c in chunks], add_special_tokens=False), strict=True):
            ids = np.array(x.ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids])
            if len(ends) == len(chunk):
                self.keep(chunk, ids, np.diff(ends, prepend=-1))
            else:
                self.plain(chunk)

    def places(self, words, learn) -> np.ndarray:
        """Where each of an Arrow column's words is remembered."""
        coded = words.dictionary_encode()
        distinct = strings(coded.dictionary)
        if new := [w for w in distinct if w not in self.known]:
            learn(new)
        return np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[np.asarray(coded.indices)]

    def __call__(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids and how many each text has."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.known) > KNOWN:
            self.forget()
        rows = pc.ascii_split_whitespace(texts)
        offsets = np.asarray(rows.offsets).astype(np.int64)
        coded = rows.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        words = coded.dictionary
        cores = pc.ascii_rtrim(words, MARKS)
        letters = pc.utf8_is_alpha(cores)
        marked = np.flatnonzero(np.asarray(pc.and_(letters, pc.less(pc.binary_length(cores), pc.binary_length(words)))))
        # a word is a core and a tail, which may be empty; other words are cores as they are
        core, tail = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        core[np.asarray(letters)] = self.places(pc.ascii_lower(cores.filter(letters)), self.of_letters)
        core[~np.asarray(letters)] = self.places(words.filter(pc.invert(letters)), self.plain)
        tails = [w[len(c) :] for w, c in zip(*(strings(x.take(pa.array(marked))) for x in (words, cores)), strict=True)]
        tail[marked] = self.places(pa.array(tails, words.type), self.plain)
        at = np.stack([core, tail], 1)[np.asarray(coded.indices)].reshape(-1)
        sizes = self.size[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.pool[np.repeat(self.begin[at] - ends[:-1], sizes) + np.arange(ends[-1])]
        return ids, np.diff(ends[2 * (offsets - offsets[0])])


def word_ends(file: str) -> tuple[int, np.ndarray | None]:
    """Of a tokenizer's file: the greatest id, and which ids end a word, where words have such a mark and white space is dropped."""
    from tokenizers import Tokenizer

    spec, vocabulary = json.loads(file), Tokenizer.from_str(file).get_vocab(with_added_tokens=True)
    most, suffix = max(vocabulary.values(), default=0), spec["model"].get("end_of_word_suffix")
    if not suffix or "Removed" not in json.dumps(spec["pre_tokenizer"]):
        return most, None
    ends = np.zeros(most + 1, bool)
    ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
    return most, ends


def encoder(file: str, ends: np.ndarray | None, ordinary: bool) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """From an Arrow column of texts to all ids and each text's number of them, by the tokenizer whose file has this text.
    ordinary: the names of special tokens are text like any other."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(file)
    tokenizer.encode_special_tokens = ordinary
    if ends is not None:
        return Words(tokenizer, ends)

    def whole(texts) -> tuple[np.ndarray, np.ndarray]:
        ids = [x.ids for x in tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), np.uint32), np.array([len(x) for x in ids], np.int64)

    return whole


def tokenized(docs: DataFrame, path: str, end: int, ordinary: bool = False) -> DataFrame:
    """doc_id, n and ids (unsigned 16- or 32-bit, little-endian, as the vocabulary needs) of every document, in a stored table."""
    import pyarrow as pa

    spark = docs.sparkSession
    with open(path, encoding="utf-8") as f:
        file = f.read()
    most, ends = word_ends(file)
    kind = id_type(most, end)
    sent = spark.sparkContext.broadcast((file, ends))

    def run(batches):
        encode = None
        for batch in batches:
            encode = encode or encoder(*sent.value, ordinary)
            texts = batch.column(1).cast(pa.large_string()).fill_null("")
            for a, b in slices(text_buffer(texts)[1], AT_ONCE):
                ids, sizes = encode(texts.slice(a, b - a))
                stops = np.cumsum(sizes + 1)
                out = np.full(len(ids) + b - a, end, kind)
                out[np.delete(np.arange(len(out)), stops - 1)] = ids
                where = pa.py_buffer(np.concatenate([[0], stops * kind.itemsize]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array(sizes + 1), pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, where, pa.py_buffer(out)]).cast(pa.binary())], ["doc_id", "n", "ids"])

    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.make_valid_utf8("text")).mapInArrow(run, "doc_id long, n long, ids binary")
    with setting(spark, "spark.sql.parquet.compression.codec", "zstd"):
        return materialize(rows, "tokens")


def id_type(*largest: int) -> np.dtype:
    return np.dtype("<u2" if max(largest) < 1 << 16 else "<u4")


def frequencies(tokens: DataFrame, kind: np.dtype) -> DataFrame:
    """id and n of every id that occurs."""
    import pyarrow as pa

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            raw, _ = binary_buffer(batch.column(0))
            new = np.bincount(raw.view(kind))
            if len(new) > len(total):
                total, new = new, total
            total[: len(new)] += new
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(total[ids].astype(np.int64))], ["id", "n"])

    return tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def binary_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow binary array without nulls."""
    import pyarrow as pa

    _, offsets, data = column.cast(pa.large_binary()).buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def write(docs: DataFrame, to: str, tokenizer: str, end: int, ordinary: bool = False, file_bytes: int = FILE_BYTES) -> None:
    """Files of all documents under to/files, the frequency table under to/ranks. end: the id that closes each document."""
    import pyarrow as pa

    spark = docs.sparkSession
    tokens = tokenized(docs, tokenizer, end, ordinary)
    weight = tokens.agg(F.sum(F.octet_length("ids")).alias("bytes"), F.sum("n").alias("n")).first()
    kind = np.dtype("<u4" if weight.n and weight.bytes == 4 * weight.n else "<u2")
    by_rank = frequencies(tokens, kind).orderBy(F.desc("n"), "id").collect()  # an id of the vocabulary each
    spark.createDataFrame([(k, r.id, r.n) for k, r in enumerate(by_rank)], "rank long, id long, n long").coalesce(1).write.parquet(f"{to}/ranks")
    ranks = np.zeros(max((r.id for r in by_rank), default=0) + 1, np.uint32)
    ranks[[r.id for r in by_rank]] = np.arange(len(by_rank))
    sent = spark.sparkContext.broadcast(ranks.tobytes())

    def run(batches):
        rank_of = np.frombuffer(sent.value, np.uint32)
        held, waiting = [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([block(*(np.concatenate(x) for x in zip(*held, strict=True)))], pa.binary())], ["value"])

        for batch in batches:
            raw, offsets = binary_buffer(batch.column(2))
            ids, stops = rank_of[raw.view(kind)], offsets // kind.itemsize
            doc_ids, known = np.asarray(batch.column(0).fill_null(0)), np.asarray(batch.column(0).is_valid())
            begin = 0
            while begin < len(batch):
                stop = max(begin + 1, int(np.searchsorted(stops, stops[begin] + BLOCK_IDS - waiting, "right")) - 1)
                stop = min(stop, len(batch))
                held.append((doc_ids[begin:stop], known[begin:stop], np.diff(stops[begin : stop + 1]), ids[stops[begin] : stops[stop]]))
                waiting, begin = waiting + int(stops[stop] - stops[begin]), stop
                if waiting >= BLOCK_IDS or begin < len(batch):
                    yield out()
                    held, waiting = [], 0
        if held:
            yield out()

    files = max(1, -(-int((weight.bytes or 0) * 0.75) // file_bytes))
    # ties by content, and rows alike by place, so that no key keeps its rows together
    keyed = tokens.select("doc_id", "n", "ids", F.xxhash64("ids").alias("h"), F.monotonically_increasing_id().alias("row"))
    ordered = keyed.repartitionByRange(files, F.col("doc_id").asc_nulls_first(), "h", "row").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "row")
    written = ordered.select("doc_id", "n", "ids").mapInArrow(run, "value binary")
    written.select(F.col("value").cast("string").alias("value")).write.option("compression", "none").option("lineSep", "\n").text(f"{to}/files")


def read(spark: SparkSession, at: str, ids: bool = True) -> DataFrame:
    """From files: doc_id, file, place (ids of the file before the document), n_tokens, ids_crc32 and, if asked for, ids (unsigned
    32-bit, little-endian) of every document."""
    import pyarrow as pa

    by_rank = spark.read.schema("rank long, id long, n long").parquet(f"{at}/ranks").orderBy("rank").collect()
    sent = spark.sparkContext.broadcast(np.array([r.id for r in by_rank], "<u4").tobytes())

    def run(batches):
        id_of = np.frombuffer(sent.value, "<u4")
        for batch in batches:
            for k in range(len(batch)):
                name, place = batch.column(0)[k].as_py(), 0
                for doc_ids, known, sizes, ranks in blocks(batch.column(1)[k].as_buffer()):
                    found, stops = id_of[ranks], np.concatenate([[0], np.cumsum(sizes)])
                    raw = [found[a:b].tobytes() for a, b in zip(stops[:-1], stops[1:], strict=True)]
                    columns = [pa.array(doc_ids, mask=~known), pa.array([name] * len(raw)), pa.array(place + stops[:-1]), pa.array(sizes), pa.array([zlib.crc32(x) for x in raw], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns + [pa.array(raw, pa.binary())] * ids, ["doc_id", "file", "place", "n_tokens", "ids_crc32", "ids"][: 5 + ids])
                    place += int(stops[-1])

    name = F.element_at(F.split("path", "/"), -1).alias("file")
    return spark.read.format("binaryFile").load(f"{at}/files").select(name, "content").mapInArrow(run, "doc_id long, file string, place long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)


def starts(rows: DataFrame) -> DataFrame:
    """rows, as read() gives them, with start: the ids of all documents before. Only files are summed up in order, one row each."""
    rows = materialize(rows, "read")
    before = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    first = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).select("file", F.coalesce(before, F.lit(0)).alias("first"))
    return rows.join(first, "file").withColumn("start", (F.col("first") + F.col("place")).cast("long")).drop("first")


def op11_ranked_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents tokenised, written and read back."""
    import public_tokenizers

    to = scratch(spark, "token_files")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), to, public_tokenizers.path("word_bpe_49k.json"), end=2)
    return starts(read(spark, to, ids=False)).select("doc_id", "start", "n_tokens", "ids_crc32")

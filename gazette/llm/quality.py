"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics of whole texts (shares of kinds of characters, word and line lengths, repetition) are standardised; cosines of
random projections of them approximate a Gaussian kernel. Each partition of the labelled rows sums its part of the normal
equations, Spark adds the parts, and the driver solves a system whose size is a parameter. Of the rows that may be learnt
from, three quarters fit the ridge weights and one quarter calibrates: labels are summed by score bin, adjacent violators
pooled, and scores read off between block centres.

doc_id, lang, source and labels are no inputs of a score. Defined results: null and empty texts have statistics of zero and
get a score like any other; a null doc_id counts as held out; several labels of a doc_id are averaged, null ones are
ignored; repeated rows each get a row; without any label to learn from every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, only, slices, text_buffer, tokens

NAMES = (
    "log_words", "log_bytes", "word_mean", "word_sd", "upper", "digit", "stop", "comma", "shout", "bar", "symbol", "newline", "other",
    "distinct_words", "distinct_pairs", "short_words", "long_words", "words_a_line", "wide", "top_byte",
)
FEATURES, BINS, SEED = 128, 512, 20250101
_KINDS = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",;:", b"!?", b"|", b"#$%&*+=<>@^_~\\/", b"\n", b"\"'()[]{}-`"), 1):
    _KINDS[list(_chars)] = _k
_KINDS[128:] = 10


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of NAMES for each of the texts that follow one another in raw."""
    n, lengths = len(offsets) - 1, np.diff(offsets).astype(np.float64)
    text = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(text * 11 + _KINDS[raw], minlength=11 * n).reshape(n, 11).astype(np.float64)
    hashed, begins, ends, first = tokens(raw, offsets)
    words = np.diff(first)
    of = np.repeat(np.arange(n), words)
    size = (ends - begins).astype(np.float64)
    total, square = np.bincount(of, size, n), np.bincount(of, size * size, n)
    some, per_byte = np.maximum(words, 1), np.maximum(lengths, 1)

    def distinct(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        return np.bincount(owner[new], minlength=n)

    pair = (hashed[:-1] * np.uint64(3) + hashed[1:]) if len(hashed) else hashed
    same = of[:-1] == of[1:] if len(of) else of.astype(bool)
    pairs = np.maximum(words - 1, 1)
    mean = total / some
    share = kinds / per_byte[:, None]
    return np.stack(
        [
            np.log1p(words), np.log1p(lengths), mean, np.sqrt(np.maximum(square / some - mean * mean, 0)), share[:, 1], share[:, 2], share[:, 3], share[:, 4], share[:, 5], share[:, 6], share[:, 7], share[:, 8], share[:, 9],
            distinct(hashed, of) / some, distinct(pair[same], of[:-1][same]) / pairs, np.bincount(of, size <= 2, n) / some, np.bincount(of, size >= 12, n) / some, np.log1p(words / (1 + kinds[:, 8])), share[:, 10], share.max(1),
        ],
        1,
    ).astype(np.float32)


def features(docs: DataFrame) -> DataFrame:
    """doc_id and NAMES of every row."""
    import pyarrow as pa


    def run(batches):
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            parts = [statistics(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets)]
            if parts:
                found = np.concatenate(parts)
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(found[:, k]) for k in range(len(NAMES))]], ["doc_id", *NAMES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return only(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{x} float" for x in NAMES))


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the doc_id as text, modulo 5; a null counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5


@dataclass
class Model:
    """What a score needs, all of fixed size."""

    mean: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    at: np.ndarray
    level: np.ndarray

    def expand(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of statistics, and a constant."""
        z = np.clip((x.astype(np.float64) - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.sqrt(2 / len(self.phase)) * np.cos(z @ self.projection + self.phase), np.ones((len(x), 1))], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated; a hundredth of the uncalibrated score keeps the order within a block."""
        raw = np.clip(self.raw(x), 0, 1)
        return np.clip(0.99 * np.interp(raw, self.at, self.level) + 0.01 * raw, 0, 1) if len(self.at) else np.full(len(x), 0.5)


def _matrix(batch) -> np.ndarray:
    return np.stack([batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in NAMES], 1)


def pooled(at: np.ndarray, n: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centres and levels of the blocks of a rising step function."""
    blocks: list[list[float]] = []
    for x, k, y in zip(at, n, total, strict=True):
        blocks.append([x * k, k, y])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            blocks[-2:] = [[p + q for p, q in zip(*blocks[-2:], strict=True)]]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


def fit(found: DataFrame, labels: DataFrame, size: int = FEATURES, ridge: float = 1e-3, seed: int = SEED) -> Model:
    """Learn from the labelled rows of features() whose fold isn't 0: folds 1 to 3 fit, fold 4 calibrates."""
    import pyarrow as pa

    d = len(NAMES)
    moments = found.agg(*[F.avg(k) for k in NAMES], *[F.stddev_pop(k) for k in NAMES]).first()
    mean, scale = (np.array([v or 0.0 for v in part], float) for part in (moments[:d], moments[d:]))
    rng = np.random.default_rng(seed)
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), rng.normal(0, 1 / np.sqrt(d), (d, size)), rng.uniform(0, 2 * np.pi, size), np.zeros(size + 1), np.zeros(0), np.zeros(0))
    y = only(labels, "doc_id", "quality").where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("l_doc")).agg(F.avg("quality").alias("y"))
    rows = materialize(found.join(y, F.col("doc_id") == F.col("l_doc")).withColumn("fold", fold()).where("fold > 0").select(*NAMES, "y", "fold"), "labelled")

    def sums(batches):
        a, r = np.zeros((size + 1, size + 1)), np.zeros(size + 1)
        for batch in batches:
            z, t = model.expand(_matrix(batch)), batch.column(batch.schema.get_field_index("y")).to_numpy(zero_copy_only=False)
            a, r = a + z.T @ z, r + z.T @ t
        i, j = np.triu_indices(size + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([i, np.arange(size + 1)]).astype(np.int32)), pa.array(np.concatenate([j, np.full(size + 1, -1)]).astype(np.int32)), pa.array(np.concatenate([a[i, j], r]))], ["i", "j", "v"])

    # of parts, one a partition, Spark makes one system of (size + 1) (size + 4) / 2 numbers
    parts = rows.where("fold < 4").mapInArrow(sums, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    a, r = np.zeros((size + 1, size + 1)), np.zeros(size + 1)
    for i, j, v in parts:
        if j < 0:
            r[i] = v
        else:
            a[i, j] = a[j, i] = v
    n = a[size, size]
    if not n:
        return model
    model.weights = np.linalg.solve(a + ridge * n * np.eye(size + 1) * np.append(np.ones(size), 1e-6) + 1e-9 * np.eye(size + 1), r)

    def binned(batches):
        for batch in batches:
            at = np.clip(model.raw(_matrix(batch)), 0, 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum((at * BINS).astype(np.int32), BINS - 1)), batch.column(batch.schema.get_field_index("y"))], ["bin", "y"])

    held = rows.where("fold = 4")
    bins = (held if held.limit(1).count() else rows).mapInArrow(binned, "bin int, y double").groupBy("bin").agg(F.count(F.lit(1)), F.sum("y")).orderBy("bin").collect()
    at, k, total = (np.array(x, float) for x in zip(*bins, strict=True))
    model.at, model.level = pooled((at + 0.5) / BINS, k, total)
    return model


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out and score of every row."""
    import pyarrow as pa

    found = materialize(features(docs), "features")
    model = fit(found, labels)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch)))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {kind}, score double").select("doc_id", (fold() == 0).alias("held_out"), "score")


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """The rows of docs that score at least `cut`, columns unchanged: fitted first, then each text is scored where it is."""
    import pyarrow as pa

    model = fit(materialize(features(docs), "features"), labels)
    schema, names = docs.schema, docs.columns

    def run(batches):
        for batch in batches:
            raw, offsets = text_buffer(batch.column(names.index("text")))
            good = [model.score(statistics(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) >= cut for a, b in slices(offsets)]
            if good:
                yield batch.filter(pa.array(np.concatenate(good)))

    return docs.mapInArrow(run, schema)


def op3_fourier_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict for every document."""
    out = scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))

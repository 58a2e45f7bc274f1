"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics cover whole texts and are written once as a narrow table.  Random Fourier features approximate a
Gaussian kernel over the scaled statistics; each task sums the normal equations of its rows, and the driver
adds the sums of `SUM_TASKS` tasks and solves for the ridge weights.  A quarter of the labelled rows is kept
from the fit, and their scores, counted in bins, give the isotonic steps that turn scores to probabilities.

Labels come only from rows whose crc32(doc_id) mod 4 is not 2, at most about `fit_rows` of them, chosen by a
hash of the id.  An id with several labels counts once with their mean.

Cases: null and empty texts have all-zero statistics and get a score like any other; null labels teach
nothing; without labels every score is 0.5; repeated rows repeat; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crc_mod4, map_rows, written

SUM_TASKS = 16
STATISTICS = 24
_CLASSES = 9  # upper, lower, other letters, digits, marks of sentences, bangs, bars, symbols, spaces

_table: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """The class of each code point of the basic plane; later planes count as symbols."""
    if not _table:

        def one(i: int) -> int:
            c, kind = chr(i), unicodedata.category(chr(i))
            if c in "!?":
                return 5
            if c == "|":
                return 6
            if c in ".,;:'\"-()":
                return 4
            if kind == "Lu":
                return 0
            if kind == "Ll":
                return 1
            if kind[0] == "L":
                return 2
            if kind[0] == "N":
                return 3
            return 8 if c.isspace() else 7

        _table.append(np.array([one(i) for i in range(1 << 16)], np.int8))
    return _table[0]


def statistics(text: str | None) -> np.ndarray:
    """The statistics of one whole text."""
    out = np.zeros(STATISTICS, np.float32)
    if not text:
        return out
    counts = np.zeros(_CLASSES)
    for i in range(0, len(text), 1 << 20):  # a very long text goes through in parts
        points = np.frombuffer(text[i : i + (1 << 20)].encode("utf-32-le", "replace"), np.uint32)
        counts += np.bincount(np.where(points < 1 << 16, _classes()[points & 0xFFFF], 7), minlength=_CLASSES)
    chars, letters = len(text), max(1.0, counts[:3].sum())
    words = text.split()
    n = len(words)
    if not n:
        out[:2] = np.log1p(chars), counts[8] / chars
        return out
    lengths = np.fromiter(map(len, words), np.int64, n)
    kinds, lines = len(set(words)), [x for x in text.split("\n") if x.strip()]
    same = sum(map(str.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    ends = text.count(".") + text.count("!") + text.count("?")
    out[:] = [
        np.log1p(chars), counts[8] / chars, np.log1p(n), counts[0] / letters, counts[2] / letters, counts[3] / chars,
        counts[4] / chars, counts[5] / n,
        counts[6] / n, counts[7] / n, letters / chars, lengths.mean(), lengths.std(), np.log(max(2, lengths.max())), kinds / n,
        np.log1p(kinds) / np.log1p(n),
        same / n, pairs / max(1, n - 1), (lengths <= 3).mean(), (lengths >= 12).mean(), len(set(lines)) / len(lines),
        np.log1p(n / len(lines)), np.log1p(n / (1 + ends)), np.log1p(len(lines)),
    ]
    return out


def statistics_table(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics as an array."""

    def run(columns):
        ids, texts = columns
        yield ids, [statistics(t) for t in texts]

    return map_rows(docs.select("doc_id", "text"), run, "doc_id long, x array<float>")


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: tuple[np.ndarray, np.ndarray]  # raw scores, ascending, and their calibrated values

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of statistics, with a constant as the last."""
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.frequencies + self.phases
        return np.hstack([np.sqrt(2 / z.shape[1]) * np.cos(z), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.steps), 0, 1)


def isotonic(at: np.ndarray, value: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: non-decreasing means over ascending `at`; each pool's mean place and mean value."""
    pools: list[list[float]] = []
    for a, v, w in zip(at, value, weight):
        pools.append([a * w, v * w, w])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last)]
    found = np.array(pools)
    return found[:, 0] / found[:, 2], found[:, 1] / found[:, 2]


def learn(
    stats: DataFrame, labels: DataFrame, fit_rows: int = 40_000, dimensions: int = 256, width: float = 4.0,
    ridge: float = 1e-3, bins: int = 400,
) -> QualityModel:
    """A model from a table of statistics and labels (doc_id, quality). `fit_rows` bounds the labelled rows."""
    rng = np.random.default_rng(11)
    mean, scale = np.zeros(STATISTICS), np.ones(STATISTICS)
    frequencies, phases = rng.normal(0, 1 / width, (STATISTICS, dimensions)), rng.uniform(0, 2 * np.pi, dimensions)
    empty = QualityModel(mean, scale, frequencies, phases, np.zeros(dimensions + 1), (np.array([0.0]), np.array([0.5])))
    taught = labels.filter(
        (F.col("quality").isNotNull()) & (crc_mod4(F.col("doc_id")) != 2)
    ).groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y"))
    known = taught.count()
    if not known:
        return empty
    hashed = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 20))
    picked = taught.filter(hashed < min(1.0, fit_rows / known) * (1 << 20))
    # about `fit_rows` ids and numbers go to the statistics, which stay where they lie; of a repeated id always the same row is taken
    one_each = stats.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    rows = written(
        one_each.withColumn("fit", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(4)) != 0).repartition(SUM_TASKS),
        "quality-rows",
    )
    moments = rows.filter("fit").select([F.col("x")[i].alias(f"x{i}") for i in range(STATISTICS)])
    got = moments.agg(*[F.avg(c) for c in moments.columns], *[F.stddev_pop(c) for c in moments.columns]).first()
    if got[0] is None:
        return empty
    mean, scale = np.array(got[:STATISTICS], float), np.array(got[STATISTICS:], float)
    shape = QualityModel(mean, np.where(scale > 1e-9, scale, 1.0), frequencies, phases, empty.weights, empty.steps)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((dimensions + 1, dimensions + 1)), np.zeros(dimensions + 1)
        for batch in batches:
            z = shape.features(np.array(batch.column(0).to_pylist(), float).reshape(-1, STATISTICS))
            a, b = a + z.T @ z, b + z.T @ np.array(batch.column(1).to_pylist(), float)
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], names=["a", "b"])

    parts = rows.filter("fit").select("x", "y").coalesce(SUM_TASKS).mapInArrow(sums, "a binary, b binary").collect()
    a = sum(np.frombuffer(p["a"]).reshape(dimensions + 1, -1) for p in parts)
    b = sum(np.frombuffer(p["b"]) for p in parts)
    penalty = ridge * a[-1, -1] * np.eye(dimensions + 1)
    penalty[-1, -1] = 0
    fitted = QualityModel(
        mean, shape.scale, frequencies, phases, np.linalg.solve(a + penalty / dimensions + 1e-9 * np.eye(dimensions + 1), b),
        empty.steps,
    )

    def scored(columns):
        xs, ys = columns
        yield np.floor(np.clip(fitted.raw(np.array(xs, float).reshape(-1, STATISTICS)), -0.5, 1.5) * bins).astype(int), ys

    held = map_rows(
        rows.filter("not fit").select("x", "y"), scored, "bin long, y double",
    ).groupBy("bin").agg(F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    if not held:
        return fitted
    steps = isotonic(
        np.array([(h["bin"] + 0.5) / bins for h in held]), np.array([h["y"] for h in held]),
        np.array([float(h["n"]) for h in held]),
    )
    return QualityModel(mean, shape.scale, frequencies, phases, fitted.weights, steps)


def score(stats: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and score for every row of a table of statistics."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(columns):
        ids, xs = columns
        yield ids, shared.value.score(np.array(xs, float).reshape(-1, STATISTICS))

    return map_rows(stats.select("doc_id", "x"), run, "doc_id long, score double")


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **settings) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    stats = written(statistics_table(docs), "statistics")
    out = score(stats, learn(stats, labels, **settings))
    return out.select(
        "doc_id", F.coalesce(crc_mod4(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )

"""Quality classifier: random Fourier features over document statistics, ridge regression, isotonic calibration.

The statistics of a text are standardised and mapped to cosines of random projections, whose inner products approximate a
Gaussian kernel.  Each partition sums its own normal equations; Spark adds them up, and the small system is solved on the
driver.  The raw scores of labelled rows kept out of the fit are then calibrated by isotonic regression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import staged
from tessera.llm.shingles import window_hashes, word_hashes

FEATURES, RIDGE, SEED, CLIP = 192, 3.0, 20_240_601, 6.0
#: Bins of raw scores for calibration, from LOW to HIGH.
BINS, LOW, HIGH = 2000, -0.5, 1.5

NAMES = (
    "chars", "words", "word_length", "upper", "lower", "digits", "white", "newlines", "other_ascii", "non_ascii", "stops", "commas", "shouts", "bars",
    "marks", "entropy", "top_byte", "distinct", "repeats", "lines", "dup_lines", "longest_line", "hyphens", "brackets",
)


def statistics(text: str | None) -> list[float]:
    """NAMES of one whole text; null counts as empty and every ratio of an empty text is 0."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    count = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    words = word_hashes(text)
    n_words = len(words)
    upper, lower, digits = count[65:91].sum(), count[97:123].sum(), count[48:58].sum()
    white, high = count[9:14].sum() + count[32], count[128:].sum()
    marks = sum(count[c] for c in b"#$%&*@^~<>=+_\\")
    lines = [x for x in data.split(b"\n") if x.strip()]
    present = count[count > 0] / n
    entropy = float(-(present * np.log(present)).sum()) if len(data) else 0.0
    grams = window_hashes(words, 5)
    repeats = 1 - len(np.unique(grams)) / len(grams) if len(grams) else 0.0
    return [
        np.log1p(len(data)), np.log1p(n_words), (len(data) - white) / max(1, n_words), upper / n, lower / n, digits / n, white / n, count[10] / n,
        (len(data) - upper - lower - digits - white - high) / n, high / n, count[46] / n, count[44] / n, count[33] / n, count[124] / n, marks / n, entropy,
        (count.max() / n) if len(data) else 0.0, len(np.unique(words)) / max(1, n_words), repeats, np.log1p(len(lines)), 1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(max(map(len, lines), default=0)), count[45] / n, (count[40] + count[41] + count[91] + count[93] + count[123] + count[125]) / n,
    ]


def _vector_column(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.array(rows.ravel()))


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _emit_statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            found = np.array([statistics(t) for t in part.column(1).to_pylist()], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([part.column(0), _vector_column(found), *part.columns[2:]], ["doc_id", "x", *part.schema.names[2:]])


@dataclass(frozen=True)
class FourierMap:
    """Standardisation and random projections; the same seed gives the same map."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phases: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -CLIP, CLIP)
        waves = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.weights + self.phases)
        return np.hstack([np.ones((len(z), 1)), z / CLIP, waves])


def fourier_map(mean: np.ndarray, std: np.ndarray, features: int = FEATURES, seed: int = SEED) -> FourierMap:
    """A Gaussian kernel whose width is the typical distance of standardised rows, the root of twice their dimensions."""
    chance = np.random.default_rng(seed)
    d = len(mean)
    weights = chance.standard_normal((d, features)) / np.sqrt(2 * d)
    return FourierMap(mean, np.where(std > 1e-12, std, 1.0), weights, chance.uniform(0, 2 * np.pi, features))


def _normal_equations(phi: FourierMap):
    """Upper triangle of [Z y]'[Z y] summed over the partition, as (cell, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                z = np.hstack([phi(_rows(batch.column(0))), batch.column(1).to_numpy(zero_copy_only=False).astype(float)[:, None]])
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            values = total[np.triu_indices(len(total))]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], ["cell", "value"])

    return run


def solve_ridge(cells: dict[int, float], size: int, ridge: float = RIDGE) -> np.ndarray:
    """Coefficients from the summed cells; without rows, all zero.  The constant is not shrunk."""
    full = np.zeros((size + 1, size + 1))
    upper = np.triu_indices(size + 1)
    full[upper] = [cells.get(k, 0.0) for k in range(len(upper[0]))]
    full = full + np.triu(full, 1).T
    shrink = np.full(size, ridge)
    shrink[0] = 1e-9
    return np.linalg.solve(full[:size, :size] + np.diag(shrink), full[:size, size])


def isotonic(centres: np.ndarray, means: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (centre, value) of each block, both rising."""
    blocks: list[list[float]] = []
    for c, m, n in zip(centres, means, counts, strict=True):
        blocks.append([c * n, m * n, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _raw(phi: FourierMap, beta: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = phi(_rows(batch.column(0))) @ beta
                at = np.clip((raw - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1).cast(pa.float64())], ["bin", "y"])

    return run


def _score(phi: FourierMap, beta: np.ndarray, centres: np.ndarray, values: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = phi(_rows(batch.column(1))) @ beta
                level = np.interp(raw, centres, values)
                # A thousandth of the raw order keeps apart what calibration has made equal.
                score = np.round(0.999 * level + 0.001 * np.clip((raw - LOW) / (HIGH - LOW), 0, 1), 9)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), *batch.columns[2:]], ["doc_id", "score", *batch.schema.names[2:]])

    return run


def fold_of(doc_id: Column, folds: int = 5) -> Column:
    """Remainder of the CRC-32 of doc_id as text."""
    return F.crc32(doc_id.cast("string")) % folds


def quality_classifier(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted and the carried columns for every row of docs.

    Labels are learned from rows of fold 1 to 4 only: the regression from 1 to 3, the calibration from 4.  doc_id picks
    folds and joins labels and is no input of a score; language and source are never read.  Null and empty texts are
    scored like any others.  Rows without a doc_id are scored and count as held out.  Null labels are no labels; of
    several labels for a doc_id each counts.  Without any label to learn from all scores are 0.5.
    """
    carried = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema]
    stats = staged(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *carry).mapInArrow(_emit_statistics, ", ".join(["doc_id long, x array<double>", *carried])))
    held_out = F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(True))
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y is not null")
    known = staged(stats.where(~held_out).join(marked, "doc_id").select("x", "y", fold_of(F.col("doc_id")).alias("fold")))
    d = len(NAMES)
    moments = known.select(*(f for k in range(d) for f in (F.avg(F.col("x")[k]), F.stddev_pop(F.col("x")[k])))).first()
    if moments is None or moments[0] is None:
        return stats.select("doc_id", held_out.alias("held_out"), F.lit(0.5).alias("score"), F.lit(1 if threshold <= 0.5 else 0).alias("predicted"), *carry)
    phi = fourier_map(np.array(moments[0::2]), np.array(moments[1::2]))
    size = 1 + d + FEATURES
    cells = known.where("fold < 4").select("x", "y").mapInArrow(_normal_equations(phi), "cell int, value double")
    summed = cells.groupBy("cell").agg(F.sum("value").alias("value")).collect()  # a fixed number of cells
    beta = solve_ridge({r["cell"]: r["value"] for r in summed}, size)
    bins = known.where("fold = 4").select("x", "y").mapInArrow(_raw(phi, beta), "bin int, y double").groupBy("bin").agg(F.sum("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    if bins:
        step = (HIGH - LOW) / BINS
        n = np.array([r["n"] for r in bins], dtype=float)
        centres, values = isotonic(np.array([LOW + (r["bin"] + 0.5) * step for r in bins]), np.array([r["y"] for r in bins]) / n, n)
    else:
        centres, values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    scored = stats.mapInArrow(_score(phi, beta, centres, np.clip(values, 0, 1)), ", ".join(["doc_id long, score double", *carried]))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *carry)

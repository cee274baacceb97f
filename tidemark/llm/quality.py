"""Quality scores: random Fourier features of document statistics, ridge from summed normal equations, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, id_filter, kept, scratch

_CLASSES = {"letters": b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "blank": b" ", "lines": b"\n\r", "stops": b".,", "asks": b"!?", "marks": b"#$%&*", "bars": b"|_~^<>\\/", "others": b"\"'()[]{}:;-+=@`\t", "high": bytes(range(128, 256))}
_MASKS = np.array([[c in v for c in range(256)] for v in _CLASSES.values()], "f8").T
STATISTICS = [*_CLASSES, "bytes", "entropy", "words", "word_length", "longest", "variety", "commonest", "lone", "pairs", "repeated_lines", "line_length", "ended"]
_ENDS = tuple(bytes([c]) for c in b".,!?;:|#$%&*")


def statistics(text: str | None) -> np.ndarray:
    """The whole text's statistics; those of a null text are an empty text's, all zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(len(STATISTICS))
    words = raw.split()
    if not words:
        return out
    n, m = len(raw), len(words)
    data = np.frombuffer(raw, np.uint8)
    counts = np.bincount(data, minlength=256) / n
    out[:11] = counts @ _MASKS
    out[1] /= out[0] + out[10] + 1e-9
    some = counts[counts > 0]
    lengths = np.fromiter(map(len, words), "i8", m)
    kinds: dict[bytes, int] = {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x]
    ended = sum([w.endswith(_ENDS) for w in words])
    pairs = np.zeros(1 << 16, bool)
    pairs[data[:-1].astype("u2") << 8 | data[1:]] = True
    out[11:] = (np.log1p(n), -(some * np.log(some)).sum(), np.log1p(m), lengths.mean(), np.log1p(lengths.max()), np.log(len(kinds)) / np.log(m + 1), max(kinds.values()) / m, (lengths == 1).mean(), np.log1p(pairs.sum()) / np.log1p(n), 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), ended / m)
    return out


@dataclass
class Model:
    """A fitted classifier; score() and what it needs, a few hundred KB whatever the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phases: np.ndarray
    ridge: np.ndarray
    at: np.ndarray
    share: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """Cosines whose products approximate a Gaussian kernel of standardised statistics, and a constant."""
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.column_stack([np.cos(z @ self.weights + self.phases) * np.sqrt(2 / len(self.phases)), np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.ridge

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores from 0 to 1."""
        raw = self.raw(x)
        # between the knots; a trace of the raw score keeps what isotonic blocks would tie in order
        return np.clip(np.interp(raw, self.at, self.share) * 0.999 + 0.001 / (1 + np.exp(-np.clip(8 * (raw - 0.5), -50, 50))), 0, 1)


def isotonic(x: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit to shares good / n at ascending x, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for a, g, m in zip(x, good, n):
        blocks.append([a * m, g, m])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _described(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, the digest of the text (a null one's is an empty one's) and its statistics, for each row."""
    def describe(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for i in range(0, len(b), 2000):
                some = b.slice(i, 2000)
                x = np.array([statistics(t.as_py()) for t in some.column(2)], "f8").reshape(-1, len(STATISTICS))
                yield pa.record_batch([some.column(0), some.column(1), *(pa.array(c) for c in np.ascontiguousarray(x.T))], ["doc_id", "digest", *STATISTICS])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _digest(text_col).alias("digest"), F.col(text_col).alias("text"))
    return rows.mapInArrow(describe, "doc_id long, digest binary, " + ", ".join(f"{s} double" for s in STATISTICS))


def _digest(text_col: str) -> Column:
    return F.unhex(F.sha2(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"), 256))


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([np.asarray(b.column(s), "f8") for s in STATISTICS])


def held_out(column):
    """Rows no label is learnt from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(described: DataFrame, labels: DataFrame, target: str = "quality", n_features: int = 256, width: float = 1.0, ridge: float = 0.3, knots: int = 2000, seed: int = 7) -> Model:
    """A model of labels.<target> (0 or 1, others and nulls ignored) from the statistics of documents not held out.

    All labelled rows count. Tasks sum their normal equations; 32 further tasks sum those, and only their 32 sums reach
    the driver. Calibration sums labels in at most `knots` bins of the raw score. Without labels of both kinds every
    score is the share of label 1 (0.5 if there are none).
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("double").alias("y")).where("y in (0, 1)").where(~held_out(F.col("doc_id")))
    rows = kept(described.join(labels, "doc_id"))
    stats = rows.agg(*(f(s).alias(f"{k}_{s}") for s in STATISTICS for k, f in (("m", F.avg), ("s", F.stddev_pop))), F.count("*").alias("n"), F.sum("y").alias("good")).first()
    rng = np.random.default_rng(seed)
    scale = np.array([stats[f"s_{s}"] or 1.0 for s in STATISTICS])
    d = len(STATISTICS)
    model = Model(np.array([stats[f"m_{s}"] or 0.0 for s in STATISTICS]), np.maximum(scale, 1e-9), rng.normal(size=(d, n_features)) / (width * np.sqrt(d)), rng.uniform(0, 2 * np.pi, n_features), np.zeros(n_features + 1), np.zeros(1), np.array([0.5]))
    if not stats["n"] or stats["good"] in (0, stats["n"]):
        model.share = np.array([stats["good"] / stats["n"]]) if stats["n"] else model.share
        model.ridge[-1] = model.share[0]
        return model
    p = n_features + 1

    def equations(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p, p + 1))
        for b in parts:
            z = model.features(_matrix(b))
            total += z.T @ np.column_stack([z, np.asarray(b.column("y"))])
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def summed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(p * (p + 1))
        for b in parts:
            for s in b.column(0):
                total += np.frombuffer(s.as_buffer())
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["sums"])

    sums = rows.mapInArrow(equations, "sums binary").repartition(32).mapInArrow(summed, "sums binary").collect()
    total = sum(np.frombuffer(r["sums"]) for r in sums).reshape(p, p + 1)
    model.ridge = np.linalg.solve(total[:, :p] + ridge * np.diag([*[1.0] * n_features, 1e-6]), total[:, p])

    def scored(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            yield pa.record_batch([pa.array(np.clip(np.floor((model.raw(_matrix(b)) + 1) / 3 * knots), 0, knots - 1).astype("i4")), b.column("y")], ["bin", "y"])

    bins = sorted(rows.mapInArrow(scored, "bin int, y double").groupBy("bin").agg(F.sum("y").alias("good"), F.count("*").alias("n")).collect())
    at, good, n = np.array(bins, "f8").T
    model.at, model.share = isotonic((at + 0.5) / knots * 3 - 1, good, n)
    return model


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 is likelier) and predicted (1 from 0.5 on) of every whole text.

    Null and blank texts have the statistics of an empty text. Null ids aren't held out and have no label. Repeated rows
    are scored each; a repeated label row counts as often as it stands; other columns are no input.
    """
    described = kept(_described(docs, id_col, text_col))
    model = fit(described, labels, **options)

    def scored(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            yield pa.record_batch([b.column("doc_id"), pa.array(model.score(_matrix(b)))], ["doc_id", "score"])

    scores = described.mapInArrow(scored, "doc_id long, score double")
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns, that score at least threshold.

    Texts are described once; what is rejected is named by id and digest of its text. Rows whose ids the rejected ones'
    filter doesn't name are kept where they are read; only the others are shuffled. Of an id with several texts each is
    judged by itself, and rows with a null id are judged like others.
    """
    with scratch() as stay:
        described = kept(_described(docs, id_col, text_col))
        model = fit(described, labels, **options)

        def rejects(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in parts:
                yield b.select(["doc_id", "digest"]).filter(pa.array(model.score(_matrix(b)) < threshold))

        rejected = kept(described.mapInArrow(rejects, "doc_id long, digest binary").distinct())
        maybe = id_filter(rejected.select("doc_id").distinct())(F.col(id_col))
        stay.append(rejected)
    same = F.col(f"d.{id_col}").cast("long").eqNullSafe(F.col("r.doc_id")) & (_digest(f"d.{text_col}") == F.col("r.digest"))
    return docs.where(~maybe).union(docs.where(maybe).alias("d").join(rejected.alias("r"), same, "left_anti"))

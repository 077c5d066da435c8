"""Quality scores from document statistics: random Fourier features, ridge, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop, lean, materialize, release, slices, text_bytes

FEATURES, SEED, RIDGE, BANDWIDTH = 128, 7, 1.0, 4.0
BINS, LOW, HIGH = 400, -0.5, 1.5
THRESHOLD, FOLDS = 0.3, 5
#: Labelled documents that a fit takes at most (16 bytes each are broadcast): those of least hash of their id.
MAX_LABELLED = 100_000

_CLASSES = [b"#*$%&|<>", b"|", b"!", b"?", b".", b",", b"\n", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"@", b"/:_=;", b"()[]{}\"'"]
_MASKS = np.array([[c in bytes(k) for c in range(256)] for k in _CLASSES] + [[c >= 128 for c in range(256)]], np.float64)
N_STATS = len(_MASKS) + 10


def statistics(text: bytes) -> np.ndarray:
    """Numbers that describe a text's form; all zero for an empty one."""
    words = text.split()
    if not words:
        return np.zeros(N_STATS)
    n = len(words)
    shares = _MASKS @ np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), np.int64, count=n)
    lines = [x for x in text.split(b"\n") if x.strip()]
    ends = sum(x.rstrip()[-1:] in (b".", b"!", b"?", b":") for x in lines)
    rest = [
        np.log1p(n),
        lengths.mean(),
        lengths.std(),
        (lengths <= 3).mean(),
        len(set(words)) / n,
        n / len(lines) / 50,
        1 - len(set(lines)) / len(lines),
        ends / len(lines),
        np.log1p(lengths.max()),
        len({x.lower() for x in words}) / len(set(words)),
    ]
    return np.r_[np.sqrt(shares / n), rest]


def _all_statistics(texts: list[bytes]) -> np.ndarray:
    return np.array([statistics(t) for t in texts]).reshape(-1, N_STATS)


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats, label, fold): the statistics of each row of (doc_id, text, label, fold)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, 1):
                x = _all_statistics(text_bytes(b.column(1)))
                stats = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * N_STATS, pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), stats, *b.columns[2:]], ["doc_id", "stats", "label", "fold"])

    return docs.mapInArrow(lean(run), "doc_id long, stats array<double>, label double, fold long")


def fold_of(doc_id: Column, folds: int = FOLDS) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


class Model:
    """Standardised statistics, cosines of random projections, weights, and a calibration curve."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        # frequencies of a Gaussian kernel of this bandwidth
        self.omega = rng.normal(0, 1 / BANDWIDTH, (N_STATS, FEATURES))
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.at, self.value = np.array([LOW, HIGH]), np.array([0.5, 0.5])

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        z = np.cos(x @ self.omega + self.phase) * np.sqrt(2 / FEATURES)
        return np.c_[z, np.ones(len(z))]

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(self.features(stats) @ self.weights, LOW, HIGH)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.at, self.value)


def _matrix(b: pa.RecordBatch, i: int) -> np.ndarray:
    return b.column(i).flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS)


def isotonic(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The non-decreasing means closest to sums / counts (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for s, n in zip(sums.tolist(), counts.tolist(), strict=True):
        blocks.append([s, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, k = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][2] += k
    return np.repeat([s / n for s, n, _ in blocks], [k for *_, k in blocks])


def fit(labelled: DataFrame) -> Model:
    """Fit on (doc_id, stats, label 0/1, fold): fold 1 calibrates, the others but 0 fit the weights.

    Each partition sums its part of the normal equations, and Spark adds the
    parts entry by entry; 129 x 130 / 2 + 129 numbers reach the driver, whatever
    the number of rows. Scores of the calibration fold are counted into 400
    bins. Without labels every score is 0.5.
    """
    spark = labelled.sparkSession
    used = labelled.where("fold <> 0")
    moments = used.select(F.posexplode("stats").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    rows = sorted(moments.collect())
    if not rows:
        return Model(np.zeros(N_STATS), np.ones(N_STATS))
    model = Model(np.array([r.m for r in rows]), np.array([r.s or 0.0 for r in rows]) + 1e-6)
    upper = np.triu_indices(FEATURES + 1)
    shared = spark.sparkContext.broadcast(model)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, y = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for b in batches:
            z, label = shared.value.features(_matrix(b, 0)), b.column(1).to_numpy(zero_copy_only=False)
            a += z.T @ z
            y += z.T @ label
        if y.any() or a.any():
            v = np.r_[a[upper], y]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], ["k", "v"])

    parts = used.where("fold <> 1").select("stats", F.col("label").cast("double").alias("label"))
    sums = parts.mapInArrow(partial, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    if sums:
        v = np.array([r.v for r in sorted(sums)])
        n = FEATURES + 1
        a = np.zeros((n, n))
        a[upper] = v[:-n]
        a = a + np.triu(a, 1).T
        penalty = RIDGE * np.eye(n)
        penalty[-1, -1] = 1e-9  # the constant is free
        model.weights = np.linalg.solve(a + penalty, v[-n:])
    shared = spark.sparkContext.broadcast(model)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = ((shared.value.raw(_matrix(b, 0)) - LOW) / (HIGH - LOW) * BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(at, BINS - 1)), b.column(1)], ["bin", "label"])

    kept = used.where("fold = 1").select("stats", F.col("label").cast("double").alias("label"))
    bins = kept.mapInArrow(raw, "bin int, label double").groupBy("bin").agg(F.sum("label").alias("s"), F.count(F.lit(1)).alias("n"))
    rows = sorted(bins.collect())
    if rows:
        model.at = LOW + (np.array([r.bin for r in rows]) + 0.5) * (HIGH - LOW) / BINS
        model.value = isotonic(np.array([r.s for r in rows]), np.array([float(r.n) for r in rows]))
    return model


def fit_labels(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_labelled: int = MAX_LABELLED
) -> Model:
    """The model fitted on the labelled documents outside fold 0.

    At most ``max_labelled`` ids take part, chosen by a hash of the id, so their
    table is broadcast at a known size and only their texts are read into
    statistics; texts aren't shuffled.
    """
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label_col).cast("double").alias("_label"))
    marks = marks.where("_id is not null").withColumn("_fold", fold_of(F.col("_id"))).where("_fold <> 0")
    marks = materialize(marks.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled), "marks")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    met = texts.join(F.broadcast(marks), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "_label", "_fold")
    labelled = materialize(document_statistics(met), "labelled")
    model = fit(labelled)
    drop(labelled, marks)
    return model


def score_of(model: Model, text: Column) -> Column:
    """The model's score of a text, worked out batch by batch; null and empty texts have that of a text without words."""
    shared = SparkSession.getActiveSession().sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        parts = [shared.value.score(_all_statistics(text_bytes(b.column(0)))) for b in slices(pa.RecordBatch.from_arrays([texts], ["t"]), 0)]
        release()
        return pa.array(np.concatenate([np.zeros(0), *parts]))

    return score(text.cast("string"))


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row a row of ``docs``.

    Scores depend on the text alone. Labels of documents whose crc32 modulo 5
    is 0 are never read; a document labelled twice takes its higher label; null
    labels are none, as are labels of a null id. Rows that repeat an id or a
    text are scored each, and weigh in the fit each. Null and empty texts get
    the score of a text without words; a text of any length is read whole.
    Columns of other names are ignored. An empty table gives an empty table;
    without labels every score is 0.5.
    """
    model = fit_labels(docs, labels, id_col, text_col, label_col)
    ids = F.col(id_col).cast("long")
    scored = docs.select(ids.alias("doc_id"), (fold_of(ids) == 0).alias("held_out"), score_of(model, F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``docs`` without the rows the classifier rejects (score under 0.3); columns as they were.

    Each row is judged by its own text, whatever its id, so repeated rows stay
    or go together and a null or repeated id changes nothing. Null and empty
    texts are judged as a text without words. An empty table stays empty;
    without labels nothing goes.
    """
    model = fit_labels(docs, labels, id_col, text_col, label_col)
    return docs.where(score_of(model, docs[text_col]) >= THRESHOLD)

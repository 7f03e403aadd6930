"""Quality by co-training: a classifier of the text and one of the page's
metadata label documents for each other; their calibrated scores are combined."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copyledger.llm.common import map_arrow, read_table, settled, text_blocks, unused

ROUNDS, CONFIDENT, THRESHOLD = 2, 0.98, 0.5
_STEPS, _RIDGE, _LONGEST, _PSEUDO_WEIGHT = 8, 1.0, 2.0, 0.5
_HASHED = 8
_LETTERS = np.array([chr(b).isalpha() or b >= 128 for b in range(256)])
_UPPERS = np.array([65 <= b <= 90 for b in range(256)])
_DIGITS = np.array([48 <= b <= 57 for b in range(256)])
_MARKS = np.array([chr(b) in "#$%&*+<=>@\\^_`{|}~/" for b in range(128)] + [False] * 128)
_STOPS = np.array([chr(b) in "!?.,;:" for b in range(128)] + [False] * 128)


def content_view(text: str) -> list[float]:
    """Shape of the wording: repetition, word lengths, word ends."""
    words = text.split()
    n = max(len(words), 1)
    counts = Counter(words)
    top = counts.most_common(1)[0][1] if words else 0
    twice = sum(a == b for a, b in zip(words, words[1:]))
    lengths = sum(map(len, words))
    lower = sum(1 for w in words if w.islower())
    plain = sum(1 for w in words if w.isalpha())
    return [
        len(counts) / n, top / n, twice / n, lengths / n / 10, lower / n, plain / n,
        sum(1 for w in words if len(w) <= 3) / n, math.log1p(len(words)) / 10, float(not words),
    ]


def metadata_view(text: str, lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    """Declared fields and page layout: no word is looked at."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(len(raw), 1)
    seen = np.bincount(raw, minlength=256)
    letters = max(int(seen[_LETTERS].sum()), 1)
    lines = int(seen[10]) + 1
    fields = [
        seen[_UPPERS].sum() / letters, seen[_DIGITS].sum() / n, seen[_MARKS].sum() / n, seen[_STOPS].sum() / n,
        seen[33] / n, letters / n, math.log1p(lines) / 10, math.log1p(n / lines) / 10,
        math.log1p(max(n_chars or 0, 0)) / 10, float(n_chars is None),
    ]
    for value, salt in ((lang, 1), (source, 2)):
        slots = [0.0] * _HASHED
        if value is not None:
            slots[xxhash.xxh3_64_intdigest(value.encode(), seed=salt) % _HASHED] = 1.0
        fields += slots
    return [float(f) for f in fields]


def _views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for cols, texts in text_blocks(batches):
        a = [content_view(t) for t in texts]
        b = [metadata_view(t, *row) for t, *row in zip(texts, cols["lang"], cols["source"], cols["n_chars"])]
        kind = pa.list_(pa.float32())
        yield pa.record_batch(
            [pa.array(cols["doc_id"], pa.int64()), pa.array(cols["row_key"], pa.int64()), pa.array(a, kind), pa.array(b, kind)],
            ["doc_id", "row_key", "a", "b"],
        )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class View:
    """A logistic classifier over standardised features, its weights fitted by
    Newton steps, its score calibrated on rows it was not fitted on."""

    def __init__(self, column: str, mean: np.ndarray, deviation: np.ndarray):
        self.column, self.mean, self.deviation = column, mean, np.where(deviation > 1e-6, deviation, 1.0)
        self.weights = np.zeros(len(mean) + 1)
        self.slope, self.shift = 1.0, 0.0

    def design(self, rows: list) -> np.ndarray:
        x = (np.array(rows, np.float64).reshape(len(rows), -1) - self.mean) / self.deviation
        return np.hstack([np.clip(x, -8, 8), np.ones((len(rows), 1))])

    def raw(self, rows: list) -> np.ndarray:
        return self.design(rows) @ self.weights

    def logit(self, rows: list) -> np.ndarray:
        return self.slope * self.raw(rows) + self.shift


def _moments(table: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    out = {}
    for c in ("a", "b"):
        rows = (
            table.select(F.posexplode(c).alias("i", "x"))
            .groupBy("i")
            .agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
            .orderBy("i")
            .collect()
        )
        out[c] = np.array([r.m for r in rows]), np.array([r.s for r in rows])
    return out


def _summed(table: DataFrame, columns: list[str], sums) -> np.ndarray:
    """Vector that ``sums`` makes of a batch, added up over all rows: one row per
    task and entry travels, and the driver gets as many numbers as the vector has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = sums(*[batch.column(c).to_pylist() for c in columns])
                total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array(range(len(total)), pa.int32()), pa.array(total, pa.float64())], ["i", "x"])

    parts = table.select(*columns).transform(map_arrow, run, "i int, x double")
    rows = parts.groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    return np.array([r.x for r in rows])


def _gradient(x: np.ndarray, y: np.ndarray, w: np.ndarray, beta: np.ndarray) -> np.ndarray:
    p = _sigmoid(x @ beta)
    curve = (w * p * (1 - p))[:, None] * x
    return np.concatenate([(x.T @ curve).ravel(), x.T @ (w * (y - p))])


def _newton(beta: np.ndarray, total: np.ndarray) -> np.ndarray:
    """A Newton step under a ridge penalty, shortened where it would run away."""
    d = len(beta)
    hessian, gradient = total[: d * d].reshape(d, d), total[d * d :]
    penalty = _RIDGE * (np.arange(d) < d - 1)
    step = np.linalg.solve(hessian + np.diag(penalty) + 1e-6 * np.eye(d), gradient - penalty * beta)
    return beta + step * min(1.0, _LONGEST / max(np.abs(step).max(), 1e-12))


def _targets(y: list, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels and weights: given ones, else what the other view is sure of."""
    given = np.array([v is not None for v in y])
    p = _sigmoid(other)
    sure = (p >= CONFIDENT) | (p <= 1 - CONFIDENT)
    target = np.where(given, np.array([v or 0.0 for v in y]), p >= CONFIDENT)
    return target.astype(float), np.where(given, 1.0, np.where(sure, _PSEUDO_WEIGHT, 0.0))


def co_train(table: DataFrame, rounds: int = ROUNDS) -> tuple[View, View, np.ndarray] | None:
    """Both views and the weights that combine their calibrated logits, from
    ``table`` (a, b, y, held): y the label or null, ``held`` marks labelled rows
    kept for calibration. None where the labels do not hold both classes."""
    labelled = table.where("y is not null")
    sums = {(r.held, r.y > 0.5) for r in labelled.select("held", "y").distinct().collect()}
    if len(sums) < 4:
        return None
    moments = _moments(table)
    a, b = View("a", *moments["a"]), View("b", *moments["b"])
    held, train = labelled.where("held"), table.where("y is null or not held")

    def fit(rows: DataFrame, steps: int, exchange: bool) -> None:
        for _ in range(steps):
            def both(xa: list, xb: list, y: list) -> np.ndarray:
                if exchange:
                    (ya, wa), (yb, wb) = _targets(y, b.logit(xb)), _targets(y, a.logit(xa))
                else:
                    ya = yb = np.array(y, float)
                    wa = wb = np.ones(len(y))
                return np.concatenate(
                    [_gradient(a.design(xa), ya, wa, a.weights), _gradient(b.design(xb), yb, wb, b.weights)]
                )

            total = _summed(rows, ["a", "b", "y"], both)
            cut = len(a.weights) * (len(a.weights) + 1)
            a.weights, b.weights = _newton(a.weights, total[:cut]), _newton(b.weights, total[cut:])

    def calibrate() -> None:
        pairs = {v.column: np.array([1.0, 0.0]) for v in (a, b)}
        for _ in range(4):
            def both(xa: list, xb: list, y: list) -> np.ndarray:
                y = np.array(y, float)
                parts = []
                for v, rows in ((a, xa), (b, xb)):
                    x = np.stack([v.raw(rows), np.ones(len(rows))], axis=1)
                    parts.append(_gradient(x, y, np.ones(len(y)), pairs[v.column]))
                return np.concatenate(parts)

            total = _summed(held, ["a", "b", "y"], both)
            pairs = {"a": _newton(pairs["a"], total[:6]), "b": _newton(pairs["b"], total[6:])}
        a.slope, a.shift = pairs["a"]
        b.slope, b.shift = pairs["b"]

    fit(labelled.where("not held"), _STEPS, False)
    calibrate()
    for _ in range(rounds):
        fit(train, 2, True)
        calibrate()
    beta = np.array([0.5, 0.5, 0.0])
    for _ in range(4):
        def joint(xa: list, xb: list, y: list) -> np.ndarray:
            x = np.stack([a.logit(xa), b.logit(xb), np.ones(len(y))], axis=1)
            return _gradient(np.clip(x, -20, 20), np.array(y, float), np.ones(len(y)), beta)

        beta = _newton(beta, _summed(held, ["a", "b", "y"], joint))
    return a, b, beta


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, row_key, content_score, metadata_score, score, keep) of ``docs``
    (doc_id, text, lang, source, n_chars) from ``labels`` (doc_id, quality).

    The views are fitted on all labelled rows but a fifth, which calibrates them
    and the combination; in each round a view also learns, at half weight, from
    every unlabelled document of which the other is at least CONFIDENT sure.
    Every document is scored; ``keep`` is score >= ``threshold``. row_key is the
    hash of doc_id and text and identifies the row.

    Fits are sums over all rows, made in the tasks: the driver only sees the
    Hessian of about 40 features. Null text counts as empty, null fields have
    slots of their own. Several labels of a doc_id are averaged, null labels and
    labels of no document do nothing. Without labels of both classes among
    fitted and held-out rows all scores are null and every document is kept. A
    null doc_id has no label. Repeated rows are scored each.
    """
    fields = ["doc_id", "text", F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long")]
    keyed = docs.select(*fields, F.xxhash64("doc_id", "text").alias("row_key"))
    views = keyed.transform(map_arrow, _views, "doc_id long, row_key long, a array<float>, b array<float>")
    known = labels.where("quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(5)) == 0
    table = settled(views.join(known, "doc_id", "left").withColumn("held", F.col("y").isNotNull() & held))
    names = ["content_score", "metadata_score", "score"]
    model = co_train(table, rounds)
    if model is None:
        empty = [F.lit(None).cast("double").alias(n) for n in names]
        return table.select("doc_id", "row_key", *empty, F.lit(True).alias("keep"))
    a, b, beta = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            la, lb = a.logit(batch.column("a").to_pylist()), b.logit(batch.column("b").to_pylist())
            joint = np.clip(np.stack([la, lb], axis=1), -20, 20) @ beta[:2] + beta[2]
            scores = [pa.array(_sigmoid(x)) for x in (la, lb, joint)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("row_key"), *scores], ["doc_id", "row_key", *names])

    scored = table.select("doc_id", "row_key", "a", "b").transform(
        map_arrow, run, "doc_id long, row_key long, content_score double, metadata_score double, score double"
    )
    return scored.withColumn("keep", F.col("score") >= threshold)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).drop("row_key")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    rejected = quality_scores(docs, read_table(spark, sf_dir, "labels")).where("not keep").select("row_key")
    (row_key,) = unused(docs.columns, "_row_key")
    keyed = docs.withColumn(row_key, F.xxhash64("doc_id", "text"))
    gone = rejected.distinct().withColumnRenamed("row_key", row_key)
    return keyed.join(gone, row_key, "left_anti").select(docs.columns)

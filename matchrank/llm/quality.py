"""Quality rules: gradient-boosted trees over document statistics.

A pass over the texts makes base counts and ratios; a forest trained here on labelled documents
scores them. A document fails if a base rule says so or if its score is below the model's threshold,
which is set on held-out labels so that good documents stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchrank.llm import boosting
from matchrank.llm.arrow import slices, text_rows

SYMBOLS = b"#*$%&|<>"
_UPPER, _DIGIT, _MARKS = bytes(range(65, 91)), bytes(range(48, 58)), b"!?.,;:'\"()[]{}"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features and the direction in which goodness may move with each.
FEATURES = {
    "log_words": 0,
    "mean_word": 0,
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_share": -1,
    "digit_share": 0,
    "marks_per_word": 0,
    "distinct_share": 0,
    "words_per_line": 0,
}


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words that stand in a 3-word window found twice or more."""
    if len(ids) < 4:
        return 0
    code = ids[:-2] * distinct + ids[1:-1]
    if distinct**3 >= 1 << 63:
        code = np.unique(code, return_inverse=True)[1]
    code = code * distinct + ids[2:]
    _, back, counts = np.unique(code, return_inverse=True, return_counts=True)
    twice = counts[back] > 1
    hit = np.zeros(len(ids), bool)
    for k in range(3):
        hit[k : len(ids) - 2 + k] |= twice
    return int(hit.sum())


def measure(text: str) -> tuple[list[int], list[float]]:
    """Base counts and features of a text; words are runs free of ASCII white space."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    less = lambda drop: len(raw) - len(raw.translate(None, drop))
    in_words = sum(map(len, words))
    chars = len(text) - (len(raw) - in_words)
    symbols = less(SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    repeats = repeated_words(ids, len(seen))
    per = max(n, 1)
    feats = [np.log1p(n), chars / per, symbols / per, dup / max(len(lines), 1), repeats / per, less(_UPPER) / max(in_words, 1), less(_DIGIT) / max(in_words, 1), less(_MARKS) / per, len(seen) / per, n / max(len(lines), 1)]
    return [n, chars, symbols, dup, repeats], feats


def base_failed(counts: np.ndarray) -> np.ndarray:
    """The fixed rules: fewer than 50 words, or over half of the words in repeated windows."""
    return (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])


@dataclass
class Model:
    forest: boosting.Forest
    threshold: float

    def verdict(self, feats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores, and whether they reach the threshold."""
        p = self.forest.probability(feats)
        return p, p >= self.threshold


def _features(rows: DataFrame) -> DataFrame:
    """``doc_id, label, feats`` of ``doc_id, text, label`` without what the base rules fail."""
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("feats", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                both = [measure(t) for t in part.column(1).to_pylist()]
                good = pa.array(~base_failed(np.array([c for c, _ in both]).reshape(-1, 5)))
                whole = pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([f for _, f in both], pa.list_(pa.float64()))], schema=schema)
                yield whole.filter(good)

    return rows.mapInArrow(run, "doc_id long, label int, feats array<double>")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_labelled: int = 20_000, keep_good: float = 0.998, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train on at most ``max_labelled`` labelled documents, chosen by a hash of the id.

    Documents that the base rules fail are left out, as their verdict is settled. A quarter is held
    out; the threshold is the largest, 0.5 at most, that keeps ``keep_good`` of the held-out good
    documents. Null labels and ids are ignored; without labels the model keeps everything.
    """
    some = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .dropna()
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )
    rows = text_rows(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).join(F.broadcast(some), "doc_id").select("doc_id", "text", "label")
    table = _features(rows).toPandas().sort_values("doc_id", kind="stable")
    x = np.array(table["feats"].tolist(), float).reshape(-1, len(FEATURES))
    y = (table["label"].to_numpy() > 0).astype(float)
    held = np.arange(len(y)) % 4 == 0
    forest = boosting.fit(x[~held], y[~held], np.array(list(FEATURES.values())))
    good = forest.probability(x[held & (y > 0)]) if len(y) and forest.roots.size else np.array([])
    threshold = min(0.5, float(np.quantile(good, 1 - keep_good, method="lower"))) if len(good) else 0.0
    return Model(forest, threshold)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id``, the base counts, ``base_failed, kept, score`` (the forest's probability).

    Null text counts as empty and fails. Rows are independent: repeated ids give repeated rows, an
    empty table gives none, other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                both = [measure(t) for t in part.column(1).to_pylist()]
                counts = np.array([c for c, _ in both], np.int64)
                failed = base_failed(counts)
                p, good = model.verdict(np.array([f for _, f in both]))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c) for c in counts.T], pa.array(failed), pa.array(good & ~failed), pa.array(p)], schema=schema)

    kind = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, score double"
    return text_rows(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, kind)


def keep_documents(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that pass, with all their columns; one pass, nothing is shuffled.

    Null and empty texts have no words and go. Rows are judged each by itself, so repeated rows stay or go
    together, null ids don't matter and ties don't arise; texts of any length are measured whole. An
    empty table stays empty; columns may have any names and nulls.
    """
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, where):
                both = [measure(t or "") for t in part.column(where).to_pylist()]
                good = model.verdict(np.array([f for _, f in both]))[1] & ~base_failed(np.array([c for c, _ in both], np.int64))
                yield part.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)

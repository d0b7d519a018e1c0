"""Quality classifier: how much better a text compresses with a dictionary of good text than with one of bad text."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import column, labelled_sample, mapped, private, text_buffer

#: Labelled rows of each class that the dictionaries and the calibration are fitted on, at most, with their whole texts,
#: and the bytes that these have together.
SAMPLE_ROWS = 2000
SAMPLE_BYTES = 16 << 20
#: Bytes that are compressed at once, so that the dictionary counts all along a long text.
BLOCK = 2048
DICTIONARY = 1 << 18
LEVEL = 3
#: Documents with a smaller probability of being good are rejected.
REJECT_BELOW = 0.35


def blocks(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    shared = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_FULLDICT if dictionary[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT)
    shared.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=shared, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)


class Model:
    """Two dictionaries, and the logistic curve from the normalised difference of sizes to a probability."""

    def __init__(self, good: bytes, bad: bytes, slope: float, intercept: float):
        self.good, self.bad, self.slope, self.intercept = good, bad, slope, intercept
        self._ready = None

    def __getstate__(self):
        return self.__dict__ | {"_ready": None}

    def difference(self, data: bytes) -> float:
        """(size with the bad dictionary - size with the good one) / size of the text; 0 for an empty text."""
        if not data:
            return 0.0
        if self._ready is None:
            self._ready = compressor(self.good), compressor(self.bad)
        good, bad = self._ready
        parts = blocks(data)
        return (sum(len(bad.compress(p)) for p in parts) - sum(len(good.compress(p)) for p in parts)) / len(data)

    def probability(self, difference: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.slope * difference + self.intercept))))


def dictionary(texts: list[bytes]) -> bytes:
    """A zstandard dictionary of the blocks; the blocks themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY, texts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(texts) or b" " * 8)[-DICTIONARY:].rjust(8)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method, with a small ridge on the standardised slope."""
    scale = x.std() or 1.0
    a = np.stack([x / scale, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-2, 1e-6]), a.T @ (y - p) - np.array([1e-2, 0]) * w)
        w += step
        if abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """A model of labelled documents, by a sample of at most SAMPLE_ROWS rows of each class; None if a class has none.

    The rows sampled are the first by a hash of the id, with whole texts, as far as these are SAMPLE_BYTES. Dictionaries
    are of the even places of that order, the curve is of the odd ones, whose texts the dictionaries haven't seen. A row
    of labels counts as good if its label is above 0. Null ids, labels and texts are left out; an id with labels of both
    kinds counts as bad; of an id with several texts one counts.
    """
    known = labels.select(column(id_col).alias("id"), (column(label_col) > 0).alias("kind")).where("id IS NOT NULL AND kind IS NOT NULL").groupBy("id").agg(F.min("kind").alias("kind"))
    _, sample = labelled_sample(docs, known, id_col, text_col, SAMPLE_ROWS, SAMPLE_BYTES)
    rows = sorted((r["place"], r["text"].encode(), r["kind"]) for r in sample.collect())
    by = {kind: [text for _, text, k in rows if k == kind] for kind in (True, False)}
    if not by[True] or not by[False]:
        return None
    model = Model(*[dictionary([p for text in by[kind][::2] for p in blocks(text)]) for kind in (True, False)], 0.0, 0.0)
    seen = [(model.difference(text), float(kind)) for kind in (True, False) for text in (by[kind][1::2] or by[kind])]
    model.slope, model.intercept = logistic(np.array([x for x, _ in seen]), np.array([y for _, y in seen]))
    return model


def score(docs: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None, min_score: float | None = None, name: str = "quality_score") -> DataFrame:
    """The columns `keep` of docs (all by default), with quality_score: the probability that the text is good.

    Whole texts are compressed, block by block. Null and empty texts show nothing either way: their difference is 0,
    and they get the curve's value there. Without a model (a class has no labelled rows) every score is 0.5.
    Repeated rows, null ids and ties are scored like any other row. A column quality_score of docs is replaced. With
    min_score, rows below it are dropped. An empty table gives an empty result.
    """
    kept = [c for c in (keep if keep is not None else docs.columns) if c.lower() != name.lower()]
    (source,) = private(docs, "source")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, off = text_buffer(batch.column(batch.num_columns - 1))
            raw = data.tobytes()
            got = np.array([0.5 if model is None else model.probability(model.difference(raw[a:b])) for a, b in zip(off[:-1].tolist(), off[1:].tolist())])
            out = pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got, pa.float64())], names=[*kept, name])
            yield out if min_score is None else out.filter(pa.array(got >= min_score))

    chosen = docs.select(*[column(c) for c in kept], column(text_col).alias(source))
    return mapped(chosen, run, docs.select(*[column(c) for c in kept], F.lit(None).cast("double").alias(name)).schema)


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that the classifier fitted on labels doesn't reject.

    Each row is decided by its own text: null and empty texts by the curve's value where nothing is shown, repeated rows
    and rows with a null id like any other. Where a class has no labelled text nothing is rejected. Labels of ids that
    docs doesn't have don't matter. An empty table gives an empty result.
    """
    (name,) = private(docs, "score")
    out = score(docs, fit(docs, labels, id_col, text_col), text_col, min_score=REJECT_BELOW, name=name)
    return out.select(*[column(c) for c in docs.columns])

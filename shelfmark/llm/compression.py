"""A quality classifier that compresses: good text is what a dictionary of good text makes shorter than one of bad text.

Two zstandard dictionaries are trained, one on pieces of texts labelled good, one on those of texts labelled bad. A text
is compressed piece by piece with either, so that a long one can't live on its own beginning; the difference of the two
sizes, divided by their sum, becomes a probability by a logistic curve fitted on labelled texts that no dictionary saw.
"""

from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = 1024           # bytes compressed at once
DICTIONARY = 110 << 10  # bytes of a dictionary
LEVEL = 3
LABELLED = 10_000      # labelled ids of each label that are looked at, the first in the order of a hash
PIECES = 4_000         # pieces a dictionary is trained on, likewise
CALIBRATION = 20_000   # texts of each label the curve is fitted on, likewise
FEW = 16               # with fewer pieces they are the dictionary as they are


class Model(NamedTuple):
    good: bytes
    bad: bytes
    slope: float
    offset: float

    def probability(self, difference: Column) -> Column:
        return 1 / (1 + F.exp(-(F.lit(self.slope) * difference + F.lit(self.offset))))


class Sizes:
    """Compressed sizes under both dictionaries; each process makes its compressors once."""

    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = good, bad

    def __getstate__(self):
        return {"good": self.good, "bad": self.bad}

    @cached_property
    def _compressors(self):
        return [_compressor(d) for d in (self.good, self.bad)]

    def difference(self, text) -> float:
        """How much longer the bad dictionary makes a text (any buffer of UTF-8), from -1 to 1; 0 for an empty one."""
        good, bad = self._compressors
        a = b = 0
        for at in range(0, len(text), PIECE):
            piece = text[at:at + PIECE]
            a += len(good.compress(piece))
            b += len(bad.compress(piece))
        return (b - a) / (a + b) if a + b else 0.0


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    plain = {"level": LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
    if not dictionary:
        return zstandard.ZstdCompressor(**plain)
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=data, **plain)


def train(pieces: list[bytes]) -> bytes:
    """A dictionary for texts like the pieces; the pieces themselves where they are too few or too much alike to train on."""
    if len(pieces) >= FEW:
        try:
            return zstandard.train_dictionary(DICTIONARY, pieces, k=1024, d=8).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"\n".join(pieces)[-DICTIONARY:]


def _views(texts: pa.Array):
    """Each text's bytes, without a copy; None for null."""
    texts = texts.cast(pa.large_string())
    ends, data = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1], texts.buffers()[2]
    view = memoryview(data) if data is not None else memoryview(b"")
    for i, here in enumerate(texts.is_valid().to_pylist()):
        yield view[ends[i]:ends[i + 1]] if here else None


def differences(text: Column, good: bytes, bad: bytes) -> Column:
    """`Sizes.difference` of whole texts; 0 for null."""
    sizes = Sizes(good, bad)

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([0.0 if t is None else sizes.difference(t) for t in _views(texts)], pa.float64())
    return of(text)


def _pieces(text: Column) -> Column:
    """All pieces of a text, in order."""
    raw = F.encode(text, "UTF-8")
    count = F.ceil(F.octet_length(raw) / PIECE).cast("int")
    return F.transform(F.filter(F.sequence(F.lit(0), count), lambda i: i < count), lambda i: F.substring(raw, i * PIECE + 1, PIECE))


def curve(differences_: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve with the largest likelihood, by Newton steps with a little shrinkage.

    Shares are smoothed as if each label had been seen once more; without any text the offset gives one half.
    """
    scale = differences_.std() if len(labels) else 0.0
    scale = scale or 1.0
    x = np.column_stack([differences_ / scale, np.ones(len(labels))])
    total = {y: weights[labels == y].sum() for y in (0, 1)}
    goal = np.where(labels == 1, (total[1] + 1) / (total[1] + 2), 1 / (total[0] + 2))
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weights * (p - goal)) + 1e-3 * w
        bend = (x * (weights * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        w = w - np.clip(step, -2, 2)
        if abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "label") -> Model:
    """The model from (doc_id, text) rows and the (doc_id, label) rows that may be learnt from; labels are 1 or 0.

    Of each label the LABELLED ids that come first in the order of a hash are looked at, repeats once. An even hash
    gives a document's pieces to the dictionaries, an odd one its text to the curve; equal pieces, and equal texts of one
    label, count once, and at most PIECES and CALIBRATION of each label are taken, again by hash. Texts of the curve
    weigh as much as their label does among all labelled ids. Rows with a null id, text or label, and other labels, teach
    nothing. Without labelled text all differences are 0 and the curve knows shares only.

    Only the pieces (4 MB for each label) and pairs of difference and label come to the driver.
    """
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label in (0, 1)").distinct()
    shares = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}      # two rows

    def first(rows: DataFrame, most: int, *key: str) -> DataFrame:
        parts = [rows.where(F.col("label") == y).orderBy(F.xxhash64(*key), *key).limit(most) for y in (0, 1)]
        return parts[0].unionByName(parts[1])
    ids = F.broadcast(first(known, LABELLED, "id"))        # at most 2 * LABELLED rows
    found = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("text is not null").join(ids, "id")
    even = F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(2)) == 0
    cut = found.where(even).select("label", F.explode(_pieces(F.col("text"))).alias("piece")).distinct()
    taken = first(cut, PIECES, "piece").collect()
    good, bad = (train([bytes(r["piece"]) for r in taken if r["label"] == y]) for y in (1, 0))
    rest = found.where(~even).groupBy("label", F.xxhash64("text").alias("hash"), F.octet_length("text").alias("size")) \
        .agg(F.min(differences(F.col("text"), good, bad)).alias("difference"))
    pairs = first(rest, CALIBRATION, "hash", "size").select("label", "difference").collect()
    y = np.array([r["label"] for r in pairs], dtype=int)
    x = np.array([r["difference"] for r in pairs], dtype=float)
    of_label = np.bincount(y, minlength=2)
    weights = np.array([shares.get(int(v), 0) / of_label[v] for v in y]) if len(y) else np.zeros(0)
    weights = weights * (len(y) / weights.sum()) if len(y) else weights
    return Model(good, bad, *curve(x, y, weights))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """`docs` with the probability that a text is good; of a null or empty text that of a difference of 0.

    Rows stay as they are, repeated ones and those of any other column too; a column called as the new one is replaced.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                      differences(F.col(f"`{text}`"), model.good, model.bad).alias("difference"))
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != name]
    return row.select(*kept, model.probability(F.col("difference")).alias(name))

"""Quality by compression: which labelled half's zstandard dictionary makes a text smaller.

Two dictionaries, one trained on good and one on bad labelled texts. A whole text is compressed in blocks with either, and
x = (bad size - good size) / plain size is its normalised compressed-size difference. A logistic calibration of x alone, fitted on
labelled rows that the dictionaries did not see, gives the score.

Bounds, all parameters: at most `sample` labelled texts of each kind are gathered, chosen by a hash of the id among those with a label (a
bounded fit on labels; every document is scored whole). Half of them train the dictionaries, each whole, but for those that would bring
a kind's texts over `budget` bytes. Texts too few to train on are the dictionary as they are. Null and empty texts get the
calibrated score of a zero difference. Without labels of both kinds every score is the share of label 1 (0.5 without labels). Of labels
that contradict each other none counts; a repeated doc_id's text is taken once for the fit, and each row is scored. Rows with a null
doc_id are scored and not held out. Columns of docs named score or predicted are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, mapped, read, slices, table, widen

BLOCK = 4096
LEVEL = 3


def dictionary_of(texts: list[bytes], size: int) -> tuple[int, bytes]:
    """A trained dictionary of at most that size; of too few texts to train on, the texts themselves."""
    try:
        return zstandard.DICT_TYPE_FULLDICT, zstandard.train_dictionary(size, texts, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return zstandard.DICT_TYPE_RAWCONTENT, b"".join(texts)


def compressors(dictionaries: tuple[tuple[int, bytes], ...]):
    def make(kind, data):
        own = zstandard.ZstdCompressionDict(data, dict_type=kind)
        own.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)

    return kept(("zstd", *(xxhash.xxh3_128_digest(d) for _, d in dictionaries)), lambda: [make(*d) for d in dictionaries])


def difference(text: str | None, good, bad) -> float:
    """(bad size - good size) / plain size; 0 for an empty text."""
    data, gained = (text or "").encode(), 0
    for i in range(0, len(data), BLOCK):
        part = data[i : i + BLOCK]
        gained += len(bad.compress(part)) - len(good.compress(part))
    return gained / max(1, len(data))


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 100, ridge: float = 0.3) -> np.ndarray:
    """Weights, the last the constant: Newton's method on standardised columns, each step halved until it helps."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[(x - mean) / spread, np.ones(len(x))]
    keep = np.append(np.full(x.shape[1], ridge), 1e-6)
    cost = lambda w: float(np.logaddexp(0, -(2 * y - 1) * (z @ w)).sum() + (keep * w * w).sum() / 2)
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep + 1e-9), z.T @ (y - p) - keep * w)
        size, now = 1.0, cost(w)
        while size > 1e-4 and cost(w + size * step) > now:
            size /= 2
        w = w + size * step
        if size <= 1e-4 or np.abs(size * step).max() < 1e-7:
            break
    raw = w[:-1] / spread
    return np.append(raw, w[-1] - raw @ mean)


class Model:
    """weights: of the difference, and a constant; None without labels of both kinds."""

    def __init__(self, dictionaries: tuple, weights: np.ndarray | None, share: float):
        self.dictionaries, self.weights, self.share = dictionaries, weights, share

    def score(self, texts: list) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.share)
        pair = compressors(self.dictionaries)
        x = np.array([difference(t, *pair) for t in texts], float)
        return 1 / (1 + np.exp(-np.clip(x * self.weights[0] + self.weights[1], -30, 30)))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 1500, dictionary: int = 448 << 10, budget: int = 32 << 20) -> Model:
    """docs: doc_id, text; labels: doc_id, quality. At most 2 * budget bytes of text and 6 * sample numbers reach the driver."""
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("quality").alias("least")).where("quality = least")
    order = F.xxhash64(F.lit("fit"), "doc_id")
    ranked = [marked.where(F.col("quality") == q).select("doc_id", "quality").orderBy(order, "doc_id").limit(sample) for q in (0, 1)]
    share = marked.agg(F.avg("quality")).first()[0]
    chosen = {r["doc_id"]: r["quality"] for part in ranked for r in part.collect()}
    prior = 0.5 if share is None else float(share)
    nothing = Model((), None, prior)
    if len(set(chosen.values())) < 2:
        return nothing
    turn = {q: [i for i in chosen if chosen[i] == q] for q in (0, 1)}  # in hash order
    rows = docs.where(F.col("text") != "").where(F.col("doc_id").isin(list(chosen))).select("doc_id", F.col("text").cast("string").alias("text")).groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = table(rows, "quality-sample")
    size = dict(map(tuple, rows.select("doc_id", F.octet_length("text")).collect()))
    taken: list = []
    for q in (0, 1):
        room = budget
        for i in turn[q][::2]:
            if 0 < size.get(i, 0) <= room:
                room -= size[i]
                taken.append(i)
    texts = dict(map(tuple, rows.where(F.col("doc_id").isin(taken)).collect()))
    good, bad = ([texts[i].encode() for i in taken if chosen[i] == q] for q in (1, 0))
    if not good or not bad:
        return nothing
    dictionaries = (dictionary_of(good, dictionary), dictionary_of(bad, dictionary))

    def measure(batches):
        pair = compressors(dictionaries)
        for batch in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([difference(t, *pair) for t in batch.column(1).to_pylist()], pa.float64())], names=["doc_id", "x"])

    rest = rows.where(F.col("doc_id").isin([i for q in (0, 1) for i in turn[q][1::2]])).select(F.col("doc_id").cast("long"), "text").transform(mapped, measure, "doc_id long, x double").orderBy("doc_id").collect()
    y = np.array([chosen[r["doc_id"]] for r in rest], float)
    if len(set(y.tolist())) < 2:
        return nothing
    weights = logistic(np.array([[r["x"]] for r in rest]), y)
    # the sample is balanced; the constant is moved to the share of label 1 among all labels used
    here = min(max(y.mean(), 1e-3), 1 - 1e-3)
    share = min(max(float(share), 1e-3), 1 - 1e-3)
    weights[-1] += np.log(share / (1 - share)) - np.log(here / (1 - here))
    return Model(dictionaries, weights, share)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """docs with score and predicted; only the text decides."""
    docs = docs.drop("score", "predicted")
    schema = widen(docs, score="double", predicted="int")
    at = docs.columns.index("text")

    def run(batches):
        for batch in slices(batches, at):
            s = model.score(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return docs.transform(mapped, run, schema)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")

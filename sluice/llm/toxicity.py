"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, one on toxic text
without the words that the ordinary sample has, too, or that few toxic texts
share, so that its few bytes go to what sets toxic text apart. A text is cut into windows of whole words, some
64 bytes each, and every window is compressed twice: with the ordinary
dictionary, and with the toxic one laid before the ordinary. What has nothing
toxic costs the same either way; the bytes that the toxic dictionary saves are
the window's distance. Behind each window follows a fixed carrier that both
hold: zstandard stores short blocks that it can't shrink as they are, and the
carrier keeps both from that.

A third of the sample isn't trained on. Its ordinary windows set the distances
that so many of a hundred, a thousand and more of them exceed, and how many
windows of a text exceed these, for its length, goes through a logistic fit on
that third.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from math import log, sqrt
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import plain_words

#: Bytes that no text in UTF-8 has, in a fixed order.
CARRIER = bytes((0xC0, 0xF5, 0xFF, 0xC1, 0xF9, 0xFD, 0xF6, 0xFB, 0xC0, 0xFA, 0xF8, 0xC1, 0xFE, 0xF7, 0xFC, 0xFF)) * 2
WINDOW = 64
#: Bytes of sample text that a dictionary is trained on at a time.
PART = 1024
#: Toxic sample texts that must share a word for the toxic dictionary to be trained on it.
SHARED = 3
#: Shares of ordinary windows beyond the calibrated distances.
BEYOND = (0.03, 0.01, 0.003, 0.001, 0.0003, 0.0001)


def windows(text: str | None) -> list[bytes]:
    """The whole text in runs of words that reach ``WINDOW`` bytes, with spaces around."""
    out, held, n = [], [], 0
    for w in plain_words(text):
        held.append(w)
        n += len(w) + 1
        if n >= WINDOW:
            out.append(b" " + b" ".join(held) + b" ")
            held, n = [], 0
    if held:
        out.append(b" " + b" ".join(held) + b" ")
    return out


def trained(texts: list[bytes], size: int, segment: int, match: int) -> bytes:
    """A zstandard dictionary of at most ``size`` bytes; of samples too small to train on, the last bytes themselves."""
    parts = [t[i : i + PART] for t in texts for i in range(0, len(t), PART)]
    try:
        return zstandard.train_dictionary(size, [p for p in parts if len(p) >= match], k=segment, d=match, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-size:]


class Distance:
    """Bytes that the toxic dictionary saves in a window."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        def compressor(content: bytes) -> zstandard.ZstdCompressor:
            held = zstandard.ZstdCompressionDict(content + CARRIER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            search = zstandard.ZstdCompressionParameters(window_log=18, hash_log=16, chain_log=17, search_log=6, min_match=4, target_length=32, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_dict_id=False, write_checksum=False)
            held.precompute_compress(compression_params=search)
            return zstandard.ZstdCompressor(dict_data=held, compression_params=search)

        self.toxic, self.ordinary = compressor(toxic + ordinary), compressor(ordinary)

    def __call__(self, text: str | None) -> np.ndarray:
        found = windows(text)
        with_, without = self.toxic.compress, self.ordinary.compress
        return np.fromiter((len(without(w + CARRIER)) - len(with_(w + CARRIER)) for w in found), np.int64, len(found))


def apart(texts: list[str]) -> list[str]:
    """The texts without those that share one of two least shingle hashes with an earlier one: copies and near copies."""
    kept, seen = [], set()
    for t in texts:
        w = plain_words(t)
        hashes = [crc32(b" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))]
        own = {(0, min(hashes)), (1, min(h * 0x9E3779B1 & 0xFFFFFFFF for h in hashes))}
        if not own & seen:
            kept.append(t)
        seen |= own
    return kept


def features(distances: np.ndarray, thresholds: list[int]) -> list[float]:
    n = len(distances)
    hits = [int((distances >= s).sum()) for s in thresholds]
    return [1.0, *(np.log1p(h) for h in hits), *(sqrt(h / (n + 5)) for h in hits), np.log1p(n), float(distances.mean()) if n else 0.0, max(0, int(distances.max(initial=0))) / 8]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Newton's method with a ridge on all but the constant."""
    w, keep = np.zeros(x.shape[1]), np.r_[0.0, np.full(x.shape[1] - 1, ridge)]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(keep + 1e-6), x.T @ (y - p) - keep * w)
        w += step
        if abs(step).max() < 1e-8:
            break
    return w


class Toxicity:
    def __init__(self, toxic: list[str], ordinary: list[str], odds: float | None = None, *, toxic_bytes: int = 2048, ordinary_bytes: int = 32768):
        """``odds``: of toxic against ordinary documents where the samples come from, if not the samples' own."""
        self.ready = bool(toxic) and bool(ordinary)
        if not self.ready:
            return
        # copies would make any word of theirs a mark
        toxic, ordinary = apart(toxic), apart(ordinary)
        # two of three documents for the dictionaries, the third to calibrate
        self._train(*([t for i, t in enumerate(some) if i % 3] or some for some in (toxic, ordinary)), toxic_bytes, ordinary_bytes)
        distance = self.distance()
        held = [[distance(t) for t in some[::3]] for some in (toxic, ordinary)]
        self._calibrate(np.concatenate([np.zeros(0, np.int64), *held[1]]))
        x = np.array([features(d, self.thresholds) for some in held for d in some])
        y = np.r_[np.ones(len(held[0])), np.zeros(len(held[1]))]
        self.weights = fit_logistic(x, y)
        self.weights[0] += log(odds * len(held[1]) / len(held[0])) if odds else 0.0

    def _train(self, toxic: list[str], ordinary: list[str], toxic_bytes: int, ordinary_bytes: int) -> None:
        plain = [plain_words(t) for t in ordinary]
        known = {w for t in plain for w in t}
        line = lambda words: b" " + b" ".join(words) + b" "
        self.ordinary = trained([line(t) for t in plain], ordinary_bytes, 24, 6)
        own = [[w for w in plain_words(t) if w not in known] for t in toxic]
        # what one text alone has is chance; a few texts must share it
        shared = Counter(w for t in own for w in set(t))
        some = [kept for t in own if (kept := [w for w in t if shared[w] >= SHARED])]
        self.toxic = trained([line(t) for t in some or own if t], toxic_bytes, 16, 8)

    def _calibrate(self, ordinary: np.ndarray) -> None:
        """The least distances, rising and above 0, that no more than each share of ordinary windows reach."""
        ordinary, self.thresholds = np.sort(ordinary), []
        for share in BEYOND:
            s = self.thresholds[-1] + 1 if self.thresholds else 1
            while len(ordinary) - np.searchsorted(ordinary, s) > share * len(ordinary):
                s += 1
            self.thresholds.append(s)

    def distance(self) -> Distance:
        return Distance(self.toxic, self.ordinary)

    def score(self, text: str | None, distance: Distance) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(features(distance(text), self.thresholds), self.weights), -30, 30))))


def learn(docs: DataFrame, labels: DataFrame, train: Callable[[Column], Column], *, sample_docs: int = 3000, sample_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Toxicity:
    """Fit on at most ``sample_docs`` labelled documents of either class, those with the least hashes of their ids, whole, up to ``sample_bytes``.

    ``train`` says of an id column which documents may be learned from.

    A document that is labelled more than once counts as toxic if any label
    says so; of several texts under one id the least is learned from; null
    labels and null texts are left out. Without documents of both classes every
    score is 0.
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y IS NOT NULL AND id IS NOT NULL")
    marked = marked.groupBy("id").agg((F.max("y") > 0).alias("y")).where(train(F.col("id"))).withColumn("h", F.xxhash64("id"))
    n = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not (n.get(True) and n.get(False)):
        return Toxicity([], [])

    # hashes are spread evenly: a share of their range holds somewhat more than the sample, and that alone is put in order
    def within(share: dict[bool, float]) -> DataFrame:
        limit = lambda y: F.lit(min(2**63 - 1, int(-(2**63) + share[y] * 2**64)))
        return marked.where(F.col("h") <= F.when(F.col("y"), limit(True)).otherwise(limit(False)))

    share = {y: (sample_docs + 10 * sqrt(sample_docs)) / n[y] for y in n}
    rank = F.row_number().over(W.partitionBy("y").orderBy("h", "id"))
    chosen = within(share).withColumn("rank", rank).where(F.col("rank") <= sample_docs).select("id", "y", "h")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL").join(F.broadcast(chosen), "id").groupBy("id", "y", "h").agg(F.min("text").alias("text"))
    upto = F.sum(F.octet_length("text")).over(W.partitionBy("y").orderBy("h", "id").rowsBetween(W.unboundedPreceding, -1))
    rows = texts.withColumn("before", F.coalesce(upto, F.lit(0))).where((F.col("before") + F.octet_length("text") <= sample_bytes) | (F.col("before") == 0)).collect()
    rows.sort(key=lambda r: (r["h"], str(r["id"])))
    return Toxicity([r["text"] for r in rows if r["y"]], [r["text"] for r in rows if not r["y"]], n[True] / n[False])


def score_documents(docs: DataFrame, model: Toxicity, *, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Score of every whole text: ``id_col``, the columns of ``keep``, score, predicted (1 from ``threshold``).

    Null and empty texts are scored as texts without windows. Repeated rows are
    scored each on its own; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size and a few weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        distance = m.distance() if m.ready else None
        for b in batches:
            scores = np.array([m.score(t, distance) if m.ready else 0.0 for t in b.column("_text").to_pylist()], float)
            kept = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=[*b.schema.names[:-1], "score", "predicted"])

    rows = docs.select(id_col, *keep, F.col(text_col).cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}, score double, predicted int")

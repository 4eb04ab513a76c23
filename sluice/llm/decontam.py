"""Benchmark decontamination by latent semantic retrieval.

1. Documents become sequences of columns: the benchmark's words have one each,
   every other word of the corpus falls into one of ``context`` hashed columns.
   The passages that have a column are counted over all documents; a hashed
   column in less than ``floor`` of them tells of no topic and gets no weight.
2. A randomised SVD of the TF-IDF passages, in one pass: every task adds up
   ``A'A Omega`` for its passages, sums meet block by block, and the Nystroem
   form of the sketch gives singular vectors and values.
3. Windows of all documents are compared by cosine, in the whitened latent
   space, with the items or their pieces of a window's length.
4. Around each candidate window the longest common subsequence of words with
   the item is taken, unless too few of the item's words are there at all. An
   item counts as leaked where enough of it is there, or where a smaller part
   is and the answer, too.

The benchmark is a stated query set, sent to the tasks in blocks of bounded
bytes, nearly always one; documents are read and encoded once for a block. Only
columns' counts and the sketch, both of a size bound by the block, reach the
driver; document rows never do.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import checkpointed
from .common import plain_words as _words
from .simhash import whole

PASSAGE = 32
STEP = 8
#: Window lengths in steps: items of under 24 words are held against the short ones.
SHORT, LONG = 2, 4
ROWS = 64  # of the sketch in a block
BATCH = 1 << 16  # words that a task looks at a time
CACHED = 1 << 18  # words whose column a task remembers
LARGE = 256  # words from which an item's neighbouring windows are looked at together


class Item(NamedTuple):
    at: int  # its place among the rows
    words: list[int]
    answer: list[int]


class _Columns(dict):
    """Word -> column; hashed for those that the benchmark hasn't."""

    def __init__(self, vocabulary: dict[bytes, int], context: int):
        super().__init__(vocabulary)
        self.first, self.context = len(vocabulary), context

    def __missing__(self, word: bytes) -> int:
        column = self.first + crc32(word) % self.context
        if len(self) < self.first + CACHED:
            self[word] = column
        return column


class Bench:
    """A block of items, their words, and what is learned of these from the corpus."""

    def __init__(self, rows: list[tuple[Any, str, str | None]], answer_words: int, context: int = 16384):
        vocabulary: dict[bytes, int] = {}
        self.items, self.ids = [], [r[0] for r in rows]
        for at, (_, text, answer) in enumerate(rows):
            own = [vocabulary.setdefault(w, len(vocabulary)) for w in _words(text)]
            end = [vocabulary.setdefault(w, len(vocabulary)) for w in _words(answer)] if answer else own[-answer_words:]
            if own:
                self.items.append(Item(at, own, end))
        self.vocabulary, self.context = vocabulary, context
        self.size = len(vocabulary) + context  # columns; this number stands past the end of a text
        self.kind = np.uint16 if self.size < 0xFFFF else np.uint32

    def columns(self) -> _Columns:
        return _Columns(self.vocabulary, self.context)

    def laid(self, words: np.ndarray, step: int) -> np.ndarray:
        """The words in rows of ``step``, one row at least."""
        n = max(1, -(-len(words) // step)) * step
        out = np.full(n, self.size, self.kind)
        out[: len(words)] = words
        return out.reshape(-1, step)

    def weigh(self, passages: np.ndarray, total: int, floor: float = 0.0) -> None:
        """Inverse frequencies; what has a weight is numbered anew, the benchmark's words as before."""
        live = np.r_[np.ones(len(self.vocabulary), bool), (passages[len(self.vocabulary) :] > 0) & (passages[len(self.vocabulary) :] >= floor * total)]
        self.live = int(live.sum())
        self.number = np.full(self.size + 1, self.live, np.int32)
        self.number[:-1][live] = np.arange(self.live)
        self.idf = np.zeros(self.live + 1, np.float32)
        self.idf[:-1] = np.log((1 + total) / (1 + passages[live])) + 1

    def sketch(self, passages: np.ndarray, omega: np.ndarray, out: np.ndarray) -> None:
        """Add A'A omega of passages (rows of columns) to out, a cacheful at a time."""
        for a in range(0, len(passages), 64):
            self._sketch(self.number[passages[a : a + 64]], omega, out)

    def _sketch(self, words: np.ndarray, omega: np.ndarray, out: np.ndarray) -> None:
        w = self.idf[words]
        w /= np.sqrt(np.maximum((w * w).sum(1, keepdims=True), 1e-12))
        row, col = np.nonzero(w)
        if not len(row):
            return
        ids, w = words[row, col], w[row, col][:, None]
        part = omega[ids] * w
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        y = np.add.reduceat(part, starts, axis=0)
        order = np.argsort(ids, kind="stable")
        ids, line = ids[order], np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(row)]))[order]
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        out[ids[starts]] += np.add.reduceat(y[line] * w[order], starts, axis=0)

    def learn(self, sketch: np.ndarray, omega: np.ndarray, rank: int) -> None:
        """Singular vectors from the Nystroem form of the sketch; word vectors are idf V / sigma."""
        core = omega.T.astype(float) @ sketch
        core = (core + core.T) / 2
        value, vector = np.linalg.eigh(core)
        keep = value > max(value.max(initial=0), 1e-30) * 1e-6
        half = sketch @ (vector[:, keep] / np.sqrt(value[keep]))
        v, s, _ = np.linalg.svd(half, full_matrices=False)
        keep = s > s.max(initial=0) * 1e-3
        keep[rank:] = False
        self.sigma = s[keep]
        self.vectors = np.zeros((self.live + 1, max(1, int(keep.sum()))), np.float32)
        self.vectors[:-1, : int(keep.sum())] = v[:, keep] / self.sigma * self.idf[:-1, None]
        self.pieces: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for scale in (SHORT, LONG):
            own, of = [], []
            for i, item in enumerate(self.items):
                n = len(item.words)
                if (n < STEP * (SHORT + LONG) // 2) != (scale == SHORT):
                    continue
                size = STEP * scale
                starts = range(0, max(1, n - size // 2), size // 2) if n > size else [0]
                for a in starts:
                    own.append(self.vectors[item.words[a : a + size]].sum(0))
                    of.append(i)
            q = np.array(own, np.float32).reshape(len(own), self.vectors.shape[1])
            self.pieces[scale] = (q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9), np.array(of, np.int64))

    def prepare(self) -> None:
        """Marks of 512 bits: of the benchmark's words, and of the items' sets of words."""
        self.marks = np.zeros((self.live + 1, 8), np.uint64)
        at = np.arange(len(self.vocabulary))
        self.marks[at, at % 512 // 64] = np.uint64(1) << (at % 64).astype(np.uint64)
        self.sets = np.array([np.bitwise_or.reduce(self.marks[i.words], axis=0) for i in self.items], np.uint64).reshape(-1, 8)
        self.lengths = np.array([len(i.words) for i in self.items], np.int64)

    def candidates(self, docs: list[np.ndarray], threshold: float, partly: float) -> Iterator[tuple[int, int, int, int, float]]:
        """(document, item, first word, words, cosine) of windows near an item, with enough of its words around them.

        Of the marks of an item's words no more may be missing around a window
        than words may be; this drops no window that has enough.
        """
        if not docs:
            return
        laid = np.concatenate([self.laid(d, STEP) if len(d) >= STEP * LONG else self.laid(np.r_[d, np.full(STEP * LONG - len(d), self.size, self.kind)], STEP) for d in docs])
        at, first = len(laid), np.concatenate([[0], np.cumsum([max(LONG, -(-len(d) // STEP)) for d in docs])])
        doc = np.repeat(np.arange(len(docs)), np.diff(first))
        steps, marks = np.empty((at, self.vectors.shape[1]), np.float32), np.empty((at, 8), np.uint64)
        for a in range(0, at, 2048):
            some = self.number[laid[a : a + 2048]]
            total, seen = self.vectors[some[:, 0]], self.marks[some[:, 0]]
            for k in range(1, STEP):
                total += self.vectors[some[:, k]]
                seen |= self.marks[some[:, k]]
            steps[a : a + 2048], marks[a : a + 2048] = total, seen
        around: dict[int, np.ndarray] = {}
        for scale, (q, of) in self.pieces.items():
            if not len(q) or at < scale:
                continue
            own = steps[: at - scale + 1].copy()
            for k in range(1, scale):
                own += steps[k : at - scale + 1 + k]
            length = np.linalg.norm(own, axis=1)
            fine = np.flatnonzero((doc[: at - scale + 1] == doc[scale - 1 :]) & (length > 1e-9))
            rows = max(16, (1 << 17) // len(q))
            found = []
            for a in range(0, len(fine), rows):
                some = fine[a : a + rows]
                cosine = own[some] @ q.T
                hit = np.flatnonzero(cosine >= threshold * length[some, None])
                if len(hit):
                    i, j = np.divmod(hit, len(q))
                    found.append((some[i], j, cosine[i, j] / length[some[i]]))
            if not found:
                continue
            window, item, cosine = (np.concatenate(x) for x in zip(*found, strict=True))
            item = of[item]
            reach = -(-self.lengths // STEP)  # steps on either side, at least as far as words are looked at; in few sizes
            reach = np.where(reach <= 16, reach, 1 << np.ceil(np.log2(reach)).astype(int))
            keep = np.zeros(len(window), bool)
            for r in np.unique(reach[item]).tolist():
                if (scale, r) not in around:
                    around[scale, r] = _spread(marks, r, scale + r)
                at_reach = np.flatnonzero(reach[item] == r)
                for a in range(0, len(at_reach), 1 << 14):
                    x = at_reach[a : a + (1 << 14)]
                    missing = np.bitwise_count(self.sets[item[x]] & ~around[scale, r][window[x]]).sum(1)
                    keep[x] = missing <= (1 - partly) * self.lengths[item[x]] + 1e-9
            window, item, cosine = window[keep], item[keep], cosine[keep]
            start, of_doc = (window - first[doc[window]]) * STEP, doc[window]
            for d, i, w, near in zip(of_doc.tolist(), item.tolist(), start.tolist(), cosine.tolist(), strict=True):
                yield d, i, w, scale * STEP, near


def _spread(marks: np.ndarray, before: int, after: int) -> np.ndarray:
    """Row by row, what the rows from ``before`` ahead of it to the ``after``-th from it on have among them."""
    n, have, size = before + after, marks, 1
    padded = np.concatenate([np.zeros((before, 8), np.uint64), have, np.zeros((after, 8), np.uint64)])
    while 2 * size <= n:  # spans of powers of two, of which two make any other
        padded = np.concatenate([padded[:-size] | padded[size:], padded[-size:]])
        size *= 2
    out = padded | np.concatenate([padded[n - size :], padded[len(padded) - (n - size) :]]) if n > size else padded
    return out[: len(marks)]


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a bit for each word of a."""
    where: dict[int, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    ones = (1 << len(a)) - 1
    v = ones
    for w in b:
        if m := where.get(w, 0) & v:
            v = (v + m) | (v - m)
            v &= ones
    return len(a) - v.bit_count()


def _read(docs: DataFrame, bench: Bench) -> DataFrame:
    """(id, words) of the documents, and at the end of each task a row (null, passages with each column)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, column, kind = np.zeros(bench.size + 2, np.int64), bench.columns(), None
        for b in batches:
            kind = b.column("id").type
            coded = []
            for t in b.column("text").to_pylist():
                words = _words(t)
                coded.append(np.fromiter(map(column.__getitem__, words), bench.kind, len(words)))
            for a in range(0, len(coded), 256):
                p = np.sort(np.concatenate([bench.laid(words, PASSAGE) for words in coded[a : a + 256]]), axis=1)
                counts[:-1] += np.bincount(p[:, 0], minlength=bench.size + 1)
                counts[:-1] += np.bincount(p[:, 1:][p[:, 1:] != p[:, :-1]], minlength=bench.size + 1)
                counts[-1] += len(p)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([w.tobytes() for w in coded], pa.binary()), pa.array([False] * len(coded))], names=["id", "words", "counts"])
        if kind is not None:
            used = np.r_[counts[: bench.size], counts[-1]]
            yield pa.RecordBatch.from_arrays([pa.array([None], kind), pa.array([used.tobytes()], pa.binary()), pa.array([True])], names=["id", "words", "counts"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, words binary, counts boolean")


def _passage_counts(read: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column("words").to_pylist():
                n = np.frombuffer(x, np.int64)
                at = np.r_[np.flatnonzero(n[:-1]), len(n) - 1]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at])], names=["word", "n"])

    rows = read.where("counts").select("words").mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    at, n = rows.column("word").to_numpy(), rows.column("n").to_numpy()
    out = np.zeros(int(at.max(initial=-1)) + 1, np.int64)
    out[at] = n
    return out


def _sketch(read: DataFrame, bench: Bench, omega: np.ndarray) -> np.ndarray:
    size, width = bench.live, omega.shape[1]
    schema = "block int, salt int, part binary"

    def rows(blocks: dict[int, np.ndarray], salts: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array(salts, pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in blocks.values()], pa.binary())], names=["block", "salt", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((size, width), np.float32)
        wide = np.zeros((size + 1, width), np.float32)
        wide[:size] = omega
        held, n, seen = [], 0, 0
        for b in batches:
            for x in b.column("words").to_pylist():
                held.append(bench.laid(np.frombuffer(x, bench.kind), PASSAGE))
                n += held[-1].size
                if n >= BATCH:
                    bench.sketch(np.concatenate(held), wide, out)
                    held, n = [], 0
                seen += 1
        if held:
            bench.sketch(np.concatenate(held), wide, out)
        if seen:
            blocks = {k: out[k * ROWS : min(size, (k + 1) * ROWS)] for k in range(-(-size // ROWS))}
            yield rows(blocks, [seen % 16] * len(blocks))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, part in zip(b.column("block").to_pylist(), b.column("part").to_pylist(), strict=True):
                x = np.frombuffer(part, np.float32).astype(np.float64)
                sums[block] = sums[block] + x if block in sums else x
        if sums:
            yield rows(sums, [0] * len(sums))

    parts = read.where("NOT counts").select("words").mapInArrow(run, schema)
    sums = parts.repartition("block", "salt").mapInArrow(total, schema).repartition("block").mapInArrow(total, schema)
    out = np.zeros((size, width))
    for r in sums.collect():
        out[r["block"] * ROWS : (r["block"] + 1) * ROWS] = np.frombuffer(r["part"], np.float32).reshape(-1, width)
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, cosine: float = 0.55, enough: float = 0.7, partly: float = 0.5, answer: float = 0.75, answer_words: int = 8, rank: int = 64, context: int = 16384, floor: float = 0.01, block_bytes: int = 32 << 20, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None) -> DataFrame:
    """Pairs (document, item) where the document holds the item or a paraphrase of it.

    Windows with a latent cosine of ``cosine`` or more are candidates; a leak
    has a common subsequence of ``enough`` of the item's words, or of ``partly``
    of them along with ``answer`` of the answer's. The answer is ``answer_col``
    or the item's last ``answer_words`` words. Returns ``id_col``, ``item_col``,
    start (word of the window), cosine, overlap, answer_overlap: for each pair
    the window with the greatest overlap.

    Null and empty texts, and items without words, take no part. Repeated
    documents give one row for each id and item; rows with a null id give rows
    with a null id; ids may be of any type that groups. Texts and items may
    have any length. Empty tables give an empty result. Other columns are not
    read. Texts of the benchmark go to the tasks, ``block_bytes`` of them at a
    time, and every block reads the documents.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text"), (F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")).alias("answer"))
    items = items.where("item IS NOT NULL AND text IS NOT NULL").distinct()
    sent = items.agg(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("answer"), F.lit(0))).alias("n")).first()["n"] or 0
    blocks = max(1, -(-sent // block_bytes))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"`{id_col}` {texts.schema['id'].dataType.simpleString()}, `{item_col}` {items.schema['item'].dataType.simpleString()}, start int, cosine double, overlap double, answer_overlap double"
    found = None
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()
        bench = Bench(sorted(((r["item"], r["text"], r["answer"]) for r in own), key=lambda r: (r[0], r[1], r[2] or "")), answer_words, context)
        if not bench.items:
            continue
        read = checkpointed(_read(texts, bench))
        counts = _passage_counts(read)
        if not len(counts):
            continue
        bench.weigh(counts[:-1], int(counts[-1]), floor)
        omega = np.random.default_rng(seed).standard_normal((bench.live, rank + 8)).astype(np.float32)
        sketch = _sketch(read, bench, omega)
        both, wide = np.zeros((bench.live, rank + 8), np.float32), np.zeros((bench.live + 1, rank + 8), np.float32)
        wide[:-1] = omega
        bench.sketch(np.concatenate([bench.laid(np.array(i.words, bench.kind), PASSAGE) for i in bench.items]), wide, both)
        bench.learn(sketch + both, omega, rank)
        part = read.where("NOT counts").select("id", "words").mapInArrow(_search(bench, cosine, enough, partly, answer, id_col, item_col, to_arrow_type(items.schema["item"].dataType)), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], schema)
    best = F.max(F.struct("overlap", "answer_overlap", "cosine", (-F.col("start")).alias("at"))).alias("b")
    return found.groupBy(id_col, item_col).agg(best).select(id_col, item_col, (-F.col("b.at")).alias("start"), "b.cosine", "b.overlap", "b.answer_overlap")


def _apart(found: list[tuple[int, int, int, int, float]], lengths: np.ndarray) -> Iterator[tuple[int, int, int, int, float, int]]:
    """Candidates with the words to be looked at on either side. Of a large item's, one for others up to half its length away, which looks that much further."""
    last: dict[tuple[int, int], int] = {}
    for d, i, start, size, near in sorted(found):
        n = int(lengths[i])
        if n <= LARGE:
            yield d, i, start, size, near, n
        elif (d, i) not in last or start - last[d, i] > n // 2:
            last[d, i] = start
            yield d, i, start, size, near, n + n // 2 + 1


def _search(bench: Bench, cosine: float, enough: float, partly: float, answer: float, id_col: str, item_col: str = "item_id", item_type: pa.DataType | None = None):
    bench.prepare()

    def verify(places: list[int], docs: list[np.ndarray], offsets: list[int], out: dict) -> None:
        for d, i, start, size, near, reach in _apart(list(bench.candidates(docs, cosine, partly)), bench.lengths):
            item, n = bench.items[i], len(bench.items[i].words)
            region = docs[d][max(0, start - reach) : start + size + reach].tolist()
            if sum(map(set(region).__contains__, item.words)) < partly * n:
                continue  # no subsequence is longer than the words in common
            overlap = common_subsequence(item.words, region) / n
            if overlap < partly:
                continue
            last = common_subsequence(item.answer, region) / max(1, len(item.answer))
            if overlap >= enough or last >= answer:
                new = (overlap, last, near, -start - offsets[d])
                key = (places[d], item.at)
                out[key] = max(out.get(key, new), new)

    overlap = 2 * (max(len(item.words) for item in bench.items) * 3 // 2 + 1) + LONG * STEP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places, docs, offsets, n, out = [], [], [], 0, {}
            for x, words in enumerate(b.column("words").to_pylist()):
                own = np.frombuffer(words, bench.kind)
                # a very long text goes in pieces; a window and what is looked at around it lie whole in one of them
                for a in range(0, max(1, len(own)), BATCH):
                    places.append(x)
                    docs.append(own[a : a + BATCH + overlap])
                    offsets.append(a)
                    n += len(docs[-1])
                    if n >= BATCH:
                        verify(places, docs, offsets, out)
                        places, docs, offsets, n = [], [], [], 0
            verify(places, docs, offsets, out)
            if out:
                keys, rows = list(out), list(out.values())
                ids = b.column("id").take(pa.array([k[0] for k in keys]))
                columns = [pa.array([bench.ids[k[1]] for k in keys], item_type), pa.array([-r[3] for r in rows], pa.int32()), *(pa.array([r[c] for r in rows], pa.float64()) for c in (2, 0, 1))]
                yield pa.RecordBatch.from_arrays([ids, *columns], names=[id_col, item_col, "start", "cosine", "overlap", "answer_overlap"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The documents, all columns, without those that hold an item.

    A text is judged, not an id: others under the same id, or null, stay, and
    all rows of a text that holds an item go. Null and empty texts stay;
    repeated rows stay or go together; columns may have any names. Empty tables
    give an empty result.
    """
    texts = docs.select(whole(text_col).alias("key"), F.col(text_col).alias("text"))
    leaked = find_leaks(texts, benchmark, id_col="key", **options).select("key").distinct()
    return docs.join(leaked, whole(docs[text_col]) == leaked["key"], "left_anti")

"""SimHash near duplicates by one-wildcard segment variants.

A fingerprint's bits are cut into the fewest segments such that, of two
fingerprints that differ in at most ``bits`` places, one segment differs in at
most one: ``bits // segments <= 1``. Every fingerprint is indexed under each
of its segments with each one bit struck out; two segments that differ in at
most that bit meet under that key. Rows are dealt and sorted by key, and each
run of equal keys is verified in place.

A bucket doesn't list its pairs. It gives a spanning forest of the links that
belong to it (a link belongs to the first key its ends share), found by search
from each member through those not yet reached; what is linked stays linked,
with fewer links than members. Links that are yet to be verified span nothing:
where one of a forest fails, texts of the groups that it leaves apart meet once
more under their rarest shingles, and what is near there in bits is verified. A bucket above ``bucket_rows`` fingerprints is
not gathered: its members are indexed again by variants of the other bits,
within the bucket, level by level until the bits left bound its size.

Components come from contraction: every node goes to the member of its closed
neighbourhood with the least draw of that round, and links and the roots known
so far are renamed; the last links, of a bounded number, are joined by one
task. Nothing but row counts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

SEED = 42
#: Links that one task joins in memory; contraction goes on until so few are left.
LAST = 1 << 17
#: Runs of up to so many rows are compared row by row, longer ones by search.
FEW = 32


class Sketch(NamedTuple):
    """What a fingerprint is made of: shingles of ``words`` words, each once if ``distinct``. Other numbers of ``mix`` give independent bits."""

    words: int
    distinct: bool = False
    mix: int = 0


#: Near copies: two fingerprints of the distinct words and one of the distinct word pairs.
NEAR = (Sketch(1, True), Sketch(1, True, 1), Sketch(2, True))


def _hashes(tokens: list[bytes], words: int, distinct: bool) -> np.ndarray:
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    if len(tokens) <= words:
        starts, stops = [0], [len(joined)]
    else:
        starts, stops = [0, *(ends[:-words] + 1).tolist()], ends[words - 1 :].tolist()
    shingles = [joined[s:e] for s, e in zip(starts, stops, strict=True)]
    shingles = set(shingles) if distinct else shingles
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x, SEED) for x in shingles), np.uint64, len(shingles))


def _mixed(h: np.ndarray, mix: int) -> np.ndarray:
    if not mix:
        return h
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15 + 2 * mix)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def fingerprint(text: bytes | None, sketches: Sequence[Sketch]) -> list[int]:
    """Bits set in over half of the XXH64 values of the text's word shingles, for each sketch; 0 without words."""
    tokens = text.lower().split() if text else []  # of bytes: ASCII letters and ASCII white space only
    if not tokens:
        return [0] * len(sketches)
    hashed, out = {}, []
    for words, distinct, mix in sketches:
        if (words, distinct) not in hashed:
            hashed[words, distinct] = _hashes(tokens, words, distinct)
        hashes, ones = _mixed(hashed[words, distinct], mix), np.zeros(64, np.int64)
        for a in range(0, len(hashes), 65536):
            h = hashes[a : a + 65536]
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0]))
    return out


def fingerprints(docs: DataFrame, sketches: Sequence[Sketch], id_col: str, text_col: str) -> DataFrame:
    """(id, whole, fps) of every row; an id of any type stays what it is."""
    n = len(sketches)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t.as_py(), sketches) for t in b.column("text").cast(pa.large_binary())], np.uint64).reshape(-1)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * n, pa.int32()), pa.array(found.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("whole"), listed], names=["id", "whole", "fps"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), whole(text_col).alias("whole"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, whole string, fps array<long>")


def whole(text: str | Column) -> Column:
    """Key of a text; null counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.md5(F.coalesce(text.cast("string"), F.lit("")))


def segments(bits: list[int], differ: int) -> list[list[int]]:
    """The bits cut into the fewest even segments of which one differs by at most one bit."""
    n = differ // 2 + 1
    while differ // n > 1:
        n += 1
    return [bits[len(bits) * i // n : len(bits) * (i + 1) // n] for i in range(n)]


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def first_key(x: np.ndarray, parts: list[list[int]]) -> np.ndarray:
    """The struck-out bit of the first key that fingerprints with difference x share; 64 if none."""
    at = np.full(x.shape, 64, np.int64)
    for part in reversed(parts):
        own = x & np.uint64(_mask(part))
        n = np.bitwise_count(own)
        at = np.where(n == 0, part[0], np.where(n == 1, np.bitwise_count(own - np.uint64(1)).astype(np.int64), at))
    return at


def forest(fps: np.ndarray, bit: int, parts: list[list[int]], differ: int) -> list[tuple[int, int]]:
    """Links that span what the bucket's own links connect."""
    # begin in the middle: what many were made from is linked to most of them
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    middle = np.packbits(2 * bits.sum(0, dtype=np.int64) > len(fps), bitorder="little").view(np.uint64)[0]
    links, left = [], np.argsort(np.bitwise_count(fps ^ middle), kind="stable")
    while len(left) > 1:
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            at = reached.pop()
            x = fps[at] ^ fps[left]
            ok = np.bitwise_count(x) <= differ
            if ok.any():
                ok[ok] = first_key(x[ok], parts) == bit
                hit = left[ok].tolist()
                links += [(at, i) for i in hit]
                reached += hit
                left = left[~ok]
    return links


def spanning(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of the pairs that join what the pairs before have not."""
    at: dict[int, int] = {}

    def root(i: int) -> int:
        while (up := at.get(i, i)) != i:
            at[i] = i = at.get(up, up)
        return i

    out = []
    for i, j in pairs:
        p, q = root(i), root(j)
        if p != q:
            at[q] = p
            out.append((i, j))
    return out


def whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, sorted by key, in batches that end where a key ends."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        keys = b.column("key").to_numpy()
        if not len(keys):
            continue
        cut = int(np.searchsorted(keys, keys[-1]))
        if held and (cut or held[-1].column("key")[0].as_py() != keys[-1]):
            yield pa.concat_batches([*held, b.slice(0, cut)])
            held = []
        elif cut:
            yield b.slice(0, cut)
        held.append(b.slice(cut))
    if held:
        yield pa.concat_batches(held)


def run_pairs(keys: np.ndarray, ok: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows i < j of one key for which ok(i, j), some at a time; in runs of over ``FEW`` rows each row with all behind it."""
    cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[cuts, len(keys)])
    inside = np.repeat(np.where(sizes <= FEW, cuts + sizes, 0), sizes)
    for t in range(1, int(sizes[sizes <= FEW].max(initial=1))):
        i = np.flatnonzero(np.arange(t, len(keys)) < inside[:-t])
        i = i[ok(i, i + t)]
        if len(i):
            yield i, i + t
    for at, n in zip(cuts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
        held = []
        for i in range(at, at + n - 1):
            j = np.arange(i + 1, at + n)
            j = j[ok(np.full(len(j), i), j)]
            held.append((np.full(len(j), i), j))
        i, j = (np.concatenate(x) for x in zip(*held, strict=True))
        if len(i):
            yield i, j


def run_nearest(keys: np.ndarray, ok: Callable[[np.ndarray, np.ndarray], np.ndarray], rank: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every row i with the row j of its key for which ok(i, j) and rank(i, j) is least, if there is one."""
    cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[cuts, len(keys)])
    inside = np.repeat(np.where(sizes <= FEW, cuts + sizes, 0), sizes)
    held = [(np.zeros(0, np.int64),) * 2]
    for t in range(1, int(sizes[sizes <= FEW].max(initial=1))):
        i = np.flatnonzero(np.arange(t, len(keys)) < inside[:-t])
        i = i[ok(i, i + t)]
        held += [(i, i + t), (i + t, i)]
    i, j = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((rank(i, j), i))
    i, j = i[order], j[order]
    first = np.r_[True, i[1:] != i[:-1]][: len(i)]
    yield i[first], j[first]
    for at, n in zip(cuts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
        held = []
        for i in range(at, at + n):
            j = np.r_[at:i, i + 1 : at + n]
            j = j[ok(np.full(len(j), i), j)]
            if len(j):
                held.append((i, int(j[rank(np.full(len(j), i), j).argmin()])))
        if held:
            yield tuple(np.array(held).T)


def _sweep(parts: list[list[int]], differ: int):
    def linked(keys: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[cuts, len(keys)])
        pairs = []
        # runs of a few rows: each row with the t-th after it, for all runs at once
        inside = np.repeat(np.where(sizes <= FEW, cuts + sizes, 0), sizes)
        for t in range(1, int(sizes[sizes <= FEW].max(initial=1))):
            i = np.flatnonzero(np.arange(t, len(keys)) < inside[:-t])
            x = fps[i] ^ fps[i + t]
            near = np.bitwise_count(x) <= differ
            i, x = i[near], x[near]
            i = i[first_key(x, parts) == (keys[i] & 63)]
            pairs += zip(i.tolist(), (i + t).tolist(), strict=True)
        if pairs:
            yield tuple(np.array(spanning(pairs)).T)
        for at, n in zip(cuts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
            if pairs := forest(fps[at : at + n], int(keys[at] & 63), parts, differ):
                yield tuple(at + np.array(pairs).T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_runs(batches):
            fps = b.column("fp").to_numpy().view(np.uint64)
            for i, j in linked(b.column("key").to_numpy(), fps):
                yield pa.RecordBatch.from_arrays([pa.array(fps[at].view(np.int64)) for at in (i, j)], names=["a", "b"])

    return run


def _variants(parts: list[list[int]], outermost: bool):
    """(fp, key) of every segment with each bit struck out; the key ends in that bit's number.

    The outermost level has plain keys; below, the bucket is mixed in, and
    buckets that come to share a key only make more to compare.
    """
    bits = np.array([b for part in parts for b in part], np.uint64)
    masks = np.array([_mask([x for x in part if x != b]) for part in parts for b in part], np.uint64)
    lows = np.array([min(part) for part in parts for _ in part], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, bucket = b.column("fp").to_numpy().view(np.uint64), b.column("bucket").to_numpy().view(np.uint64)
            for a in range(0, len(fps), 2048):
                value = (fps[a : a + 2048, None] & masks) >> lows
                if not outermost:
                    value = (value + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ (bucket[a : a + 2048, None] * np.uint64(0xC2B2AE3D27D4EB4F))
                    value ^= value >> np.uint64(29)
                key = (value << np.uint64(6)) | bits
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(fps[a : a + 2048], len(bits)).view(np.int64)), pa.array(key.ravel().view(np.int64))], names=["fp", "key"])

    return run


def links(fps: DataFrame, differ: int, bucket_rows: int, bits: list[int] | None = None) -> DataFrame:
    """Links (a, b) that connect what is linked, from distinct (bucket, fp) rows."""
    bits = list(range(64)) if bits is None else bits
    parts = segments(bits, differ)
    keyed = fps.select("bucket", "fp").mapInArrow(_variants(parts, len(bits) == 64), "fp long, key long")
    hot = None
    if min(len(p) for p in parts) > 2:
        # few coarse counts first; only where one is high are the keys themselves counted
        coarse = [F.struct(F.lit(i).alias("part"), "bucket", F.col("fp").bitwiseAND(F.lit(_signed(_mask(p[-8:])))).alias("c")) for i, p in enumerate(parts)]
        most = fps.select(F.explode(F.array(*coarse)).alias("c")).groupBy("c").count().agg(F.max("count").alias("n")).first()["n"]
        if (most or 0) > bucket_rows:
            hot = checkpointed(keyed.groupBy("key").count().where(F.col("count") > bucket_rows).select("key"))
            if hot.isEmpty():
                hot = None
    plain = keyed if hot is None else keyed.join(hot, "key", "left_anti")
    found = plain.repartition("key").sortWithinPartitions("key").select("key", "fp").mapInArrow(_sweep(parts, differ), "a long, b long")
    if hot is not None:
        for part in parts:
            own = hot.where(F.col("key").bitwiseAND(F.lit(63)).isin(part))
            if not own.isEmpty():
                inner = checkpointed(keyed.join(own, "key").select(F.col("key").alias("bucket"), "fp"))
                found = found.unionByName(links(inner, differ, bucket_rows, [b for b in bits if b not in part]))
    return found


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b); one root for each component."""
    edges = checkpointed(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    of, turn = None, 0
    while (left := edges.count()) > LAST:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # new draws every other turn: what a star's middle went to, its points go to the turn after
        draw = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn // 2)).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        near = both.groupBy("a").agg(F.min(draw("b")).alias("m"))
        to = checkpointed(near.select(F.col("a").alias("node"), F.least("m", draw("a"))["n"].alias("to")))
        if turn:
            on = to.select(F.col("node").alias("root"), "to")
            of = checkpointed(of.join(on, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        else:
            of = to.select("node", F.col("to").alias("root"))
        moved = edges.join(to.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(to.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        edges = checkpointed(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        turn += 1
    if not left:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if of is None else of
    kind = edges.schema["a"].dataType.simpleString()
    rest = checkpointed(edges.coalesce(1).mapInArrow(united, f"node {kind}, root {kind}"))
    if of is None:
        return rest
    on = rest.select(F.col("node").alias("old"), F.col("root").alias("to"))
    return checkpointed(of.join(on, F.col("root") == F.col("old"), "left").select("node", F.coalesce("to", "root").alias("root")))


def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all nodes of all links; the root is one of its component."""
    at: dict = {}

    def root(x):
        while (up := at.setdefault(x, x)) != x:
            at[x] = x = at.setdefault(up, up)
        return x

    kind = None
    for b in batches:
        kind = b.schema.field("a").type
        for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                at[y] = x
    if at:
        nodes = list(at)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], names=["node", "root"])


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Sorted 32-bit hashes of the distinct word shingles, letters and spaces as for fingerprints; a text without words has one, the empty."""
    tokens = text.lower().split() if text else []
    shingles = {b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))}
    return np.unique(np.fromiter((xxhash.xxh32_intdigest(x, SEED) for x in shingles), np.uint32, len(shingles)))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same / (len(a) + len(b) - same)


def _verified(rows: DataFrame, docs: DataFrame, bits: int, bucket_rows: int, words: int, least: float, id_col: str, text_col: str) -> DataFrame:
    """(whole, root, id, n) of every distinct text, from links whose texts are similar enough: its least id, null last, and the rows that have it.

    A forest of the links is verified first. Where one fails, others between the
    same groups may hold: for all texts of these groups the links that a shared
    rare shingle leaves possible are verified then, in two steps.
    """
    ids = rows.groupBy("whole", "id").agg(F.count("*").alias("n"), F.min("fps").alias("fps"))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n")).alias("m")
    texts = checkpointed(ids.groupBy("whole").agg(best, F.min("fps").alias("fps")).select("whole", F.col("m.id").alias("id"), F.col("m.n").alias("n"), "fps"))
    prints = checkpointed(texts.select("whole", F.explode(F.array_distinct("fps")).alias("fp")))
    head = checkpointed(prints.groupBy("fp").agg(F.min("whole").alias("head")))
    found = links(head.select(F.lit(0).cast("long").alias("bucket"), "fp"), bits, bucket_rows)
    pair = (F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    side = lambda c, out: head.select(F.col("fp").alias(c), F.col("head").alias(out))
    between = found.join(side("a", "x"), "a").join(side("b", "y"), "b").select("x", "y")
    within = prints.join(head, "fp").where("whole <> head").select(F.col("head").alias("x"), F.col("whole").alias("y"))
    edges = checkpointed(between.unionByName(within).where("x <> y").select(*pair).distinct())
    linked = edges.select(F.col("x").alias("whole")).union(edges.select("y")).distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [shingle_set(t.as_py(), words).tobytes() for t in b.column("text").cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([b.column("whole"), pa.array(held, pa.binary())], names=["whole", "shingles"])

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [jaccard(np.frombuffer(p.as_py(), np.uint32), np.frombuffer(q.as_py(), np.uint32)) >= least for p, q in zip(b.column("p"), b.column("q"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    # each linked text once, from the row that stands for it
    wanted = texts.join(linked, "whole", "left_semi").select("id", "whole")
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), whole(text_col).alias("whole"))
    held = own.join(wanted, own["id"].eqNullSafe(wanted["id"]) & (own["whole"] == wanted["whole"]), "left_semi").select("whole", "text")
    held = checkpointed(held.mapInArrow(sets, "whole string, shingles binary").dropDuplicates(["whole"]))

    def holding(some: DataFrame) -> DataFrame:
        """Of links (x, y) between texts and (a, b) between what stands for them, (a, b) of the similar."""
        pairs = some.join(held.select(F.col("whole").alias("x"), F.col("shingles").alias("p")), "x").join(held.select(F.col("whole").alias("y"), F.col("shingles").alias("q")), "y")
        return checkpointed(pairs.select("a", "b", "p", "q").mapInArrow(similar, "a string, b string"))

    true = holding(edges.select("x", "y", F.col("x").alias("a"), F.col("y").alias("b")))
    roots = components(true)
    of = texts.join(roots, F.col("whole") == F.col("node"), "left").select("whole", F.coalesce("root", "whole").alias("root"), "id", "n", "fps")
    if true.count() == edges.count():
        return of.drop("fps")
    of = checkpointed(of)
    failed = edges.join(_ends(of, "x"), "x").join(_ends(of, "y"), "y").where("rx <> ry")
    touched = checkpointed(failed.select(F.col("rx").alias("root")).union(failed.select("ry")).distinct())
    apart = checkpointed(held.join(of, "whole").join(touched, "root", "left_semi").select("whole", "fps", "shingles"))
    counted = apart.sparkSession.sparkContext.broadcast(_counted(apart).astype(np.uint32))
    # first one partner a text and shingle, one with few rare shingles of its own, which joins most of what belongs together; then all that are left
    for nearest in (True, False):
        own = apart.join(of.select("whole", F.xxhash64("root").alias("grp")), "whole")
        pairs = shared_prefixes(own, counted, bits, least, bucket_rows, nearest).join(_ends(of, "x"), "x").join(_ends(of, "y"), "y")
        late = components(holding(checkpointed(pairs.where("rx <> ry").select("x", "y", F.col("rx").alias("a"), F.col("ry").alias("b")).distinct())))
        on = late.select(F.col("node").alias("root"), F.col("root").alias("later"))
        of = of.join(on, "root", "left").select("whole", F.coalesce("later", "root").alias("root"), "id", "n")
        of = checkpointed(of) if nearest else of
    return of


def _ends(of: DataFrame, c: str) -> DataFrame:
    return of.select(F.col("whole").alias(c), F.col("root").alias(f"r{c}"))


def _counted(apart: DataFrame, cells: int = 1 << 18, piece: int = 1 << 12) -> np.ndarray:
    """Texts with each shingle, by the low bits of its hash: a table of fixed size, added up piece by piece."""
    schema = "piece int, salt int, counts binary"

    def rows(pieces: dict[int, np.ndarray], salt: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(pieces), pa.int32()), pa.array([salt] * len(pieces), pa.int32()), pa.array([x.tobytes() for x in pieces.values()], pa.binary())], names=["piece", "salt", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(cells, np.int64), 0
        for b in batches:
            for x in b.column("shingles").to_pylist():
                counts += 0 if not x else np.bincount(np.frombuffer(x, np.uint32) % cells, minlength=cells)
                n += 1
        if n:
            yield rows({k: counts[k * piece : (k + 1) * piece] for k in range(cells // piece)}, n % 16)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column("piece").to_pylist(), b.column("counts").to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(x, np.int64)
        if sums:
            yield rows(sums, 0)

    out = np.zeros(cells, np.int64)
    parts = apart.select("shingles").mapInArrow(run, schema).repartition("piece", "salt").mapInArrow(total, schema)
    for r in parts.repartition("piece").mapInArrow(total, schema).collect():
        out[r["piece"] * piece : (r["piece"] + 1) * piece] = np.frombuffer(r["counts"], np.int64)
    return out


def shared_prefixes(apart: DataFrame, counted: Broadcast, bits: int, least: float, bucket_rows: int, nearest: bool) -> DataFrame:
    """(x, y) of texts of different groups that may be similar, x < y, some repeatedly, from (whole, grp, fps, shingles).

    Shingles stand in one order, the rare first. Sets with a Jaccard similarity
    of ``least`` share one of the first ``size - ceil(least * size) + 1`` of
    either, and behind the first that they share there is room for the rest
    that they must share. So texts meet under these shingles alone, and only
    pairs come out that have the room, fingerprints within ``bits`` and
    different groups; if ``nearest``, for each text and shingle only the one
    with the fewest rare shingles. A shingle with more than ``bucket_rows``
    texts is dealt out to pairs of parts of them.
    """
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counted.value
        for b in batches:
            of, at, sizes, found = [], [], [], []
            for i, x in enumerate(b.column("shingles").to_pylist()):
                own = np.frombuffer(x, np.uint32)
                n = len(own) - int(np.ceil(least * len(own) - 1e-9)) + 1
                first = own[np.lexsort((own, count[own % len(count)]))][:n]
                of.append(np.full(len(first), i))
                at.append(np.arange(len(first)))
                sizes.append(np.full(len(first), len(own)))
                found.append(first.astype(np.int64))
            if of:
                rows = pa.array(np.concatenate(of))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), *(b.column(c).take(rows) for c in ("whole", "grp", "fps")), pa.array(np.concatenate(sizes), pa.int32()), pa.array(np.concatenate(at), pa.int32()), pa.array(np.zeros(len(rows), np.int32)), pa.array(np.ones(len(rows), bool))], names=names)

    names = ["key", "whole", "grp", "fps", "size", "at", "part", "same"]
    schema = "key long, whole string, grp long, fps array<long>, size int, at int, part int, same boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_runs(batches):
            grp, size, at, part, same = (b.column(c).to_numpy(zero_copy_only=False) for c in names[2:3] + names[4:])
            fps = b.column("fps").flatten().to_numpy().view(np.uint64).reshape(b.num_rows, -1)

            def ok(i: np.ndarray, j: np.ndarray, grp=grp, size=size, at=at, part=part, same=same, fps=fps) -> np.ndarray:
                out = (grp[i] != grp[j]) & (same[i] | (part[i] != part[j]))
                room = np.minimum(size[i] - at[i], size[j] - at[j])
                out &= room >= least / (1 + least) * (size[i] + size[j]) - 1e-6
                at_ = np.flatnonzero(out)
                out[at_] = (np.bitwise_count(fps[i[at_]] ^ fps[j[at_]]) <= bits).any(1)
                return out

            def rank(i: np.ndarray, j: np.ndarray, at=at, fps=fps) -> np.ndarray:
                return at[j].astype(np.int64) * 65 + np.bitwise_count(fps[i] ^ fps[j]).min(1)

            found = b.column("key").to_numpy()
            for i, j in run_nearest(found, ok, rank) if nearest else run_pairs(found, ok):
                x, y = b.column("whole").take(pa.array(i)), b.column("whole").take(pa.array(j))
                less = pc.less(x, y)
                yield pa.RecordBatch.from_arrays([pc.if_else(less, x, y), pc.if_else(less, y, x)], names=["x", "y"])

    rows = apart.mapInArrow(keys, schema)
    full = rows.groupBy("key").count().where(F.col("count") > bucket_rows)
    full = checkpointed(full.select(F.col("key").alias("_full"), F.ceil(F.col("count") / bucket_rows).cast("int").alias("_parts")))
    if not full.isEmpty():
        own = F.pmod(F.xxhash64("whole"), F.col("_parts")).cast("int")
        dealt = rows.join(full, F.col("key") == F.col("_full")).withColumn("part", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        # the key of a pair of parts; keys that come to be equal only make more to compare
        key = F.xxhash64("key", F.least("part", "_other"), F.greatest("part", "_other"))
        dealt = dealt.withColumns({"key": key, "same": F.col("part") == F.col("_other")}).select(*names)
        rows = rows.join(full, F.col("key") == F.col("_full"), "left_anti").unionByName(dealt)
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "x string, y string")


def representatives(docs: DataFrame, *, sketches: Sequence[Sketch] = NEAR, bits: int = 5, words: int = 5, least: float = 0.8, bucket_rows: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, whole, n) of one document for each group of near copies: of the least id, null last, then of the least key of its text; n rows are that document.

    Texts whose sets of ``words``-word shingles have a Jaccard similarity of
    ``least`` or more are linked, where fingerprints of one of the ``sketches``
    differ in ``bits`` or fewer bits. Different texts under the same id (or
    null) are different documents. Null and empty texts are one text. An empty
    table gives an empty result.
    """
    rows = checkpointed(fingerprints(docs, sketches, id_col, text_col))
    of = _verified(rows, docs, bits, bucket_rows, words, least, id_col, text_col)
    best = of.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "whole", "n")).alias("m"))
    return best.select("m.id", "m.whole", "m.n")


def near_copies(docs: DataFrame, *, sketches: Sequence[Sketch] = NEAR, bits: int = 5, words: int = 5, least: float = 0.8, bucket_rows: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and component_id, the smallest id of its group of near copies, of every row; groups and odd cases as for ``representatives``."""
    rows = checkpointed(fingerprints(docs, sketches, id_col, text_col))
    of = _verified(rows, docs, bits, bucket_rows, words, least, id_col, text_col).select("whole", "root", "id")
    of = of.select("whole", "root").join(of.groupBy("root").agg(F.min("id").alias("component_id")), "root").select("whole", "component_id")
    return rows.join(of, "whole").select(F.col("id").alias(id_col), "component_id")


def near_duplicates(docs: DataFrame, *, words: int = 4, bits: int = 4, bucket_rows: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint and component of every document.

    Texts are lower-cased (A-Z), cut at ASCII white space, and hashed by
    ``words``-word shingles, repeats included. Fingerprints link at ``bits`` or
    fewer differing bits. Returns ``id_col``, fingerprint (16 hex digits) and
    component_id, the smallest id reachable, one row for each input row.

    Null and empty texts have fingerprint 0 and are linked like any other; a
    text with fewer words is one shingle. Equal fingerprints are one node, so
    copies cost nothing beyond their own rows. Rows with a null id get the
    smallest other id of their component, or null. Ids may have any type that
    has an order. Empty tables give empty results. Other columns are not read.
    """
    rows = checkpointed(fingerprints(docs, [Sketch(words)], id_col, text_col).select("id", F.col("fps")[0].alias("fp")))
    nodes = checkpointed(rows.groupBy("fp").agg(F.min("id").alias("first")))
    found = links(nodes.select(F.lit(0).cast("long").alias("bucket"), "fp"), bits, bucket_rows)
    roots = components(found)
    first = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    least = first.groupBy("root").agg(F.min("first").alias("component_id"))
    of = first.join(least, "root").select("fp", "component_id")
    return rows.join(of, "fp", "left").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of a bounded sample of its labelled text.
A text is parsed against it from left to right into longest matches: a phrase
grows while the automaton has a transition, and ends where it has none. Fewer
phrases mean that the text is made of the language's own material; times
log2 of the sample's length and over the text's length this estimates the
cross entropy in bits a letter. The lowest wins.

The automata are dense tables (state x symbol), so that a task parses many
stretches of text for all languages in step, one array lookup a letter. Only the
``DENSE`` most frequent letters have columns; transitions by other letters, of
which scripts with thousands have many and each state few, are looked up in one
sorted array. Texts
are cut into stretches of ``STRETCH`` letters, each parsed from the root, so that
very long ones don't hold up the rest. A second pass begins each stretch in the
state that the one before it ended in; as soon as this comes to the state that
the parse from the root is in there, both go on alike. So the phrases are those
of a parse of the whole text from its first letter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STRETCH = 256
#: Symbols: between words, a letter that no sample has, past the end. Letters follow.
GAP, OTHER, END, FIRST = 0, 1, 2, 3
DENSE = 250  # letters with a column of their own
CHUNK = 1 << 20  # letters that a task parses at a time


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def letter_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, 0 for runs of other than letters, and each text's end in them."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) for t in lowered])
    codes = np.where(_letters()[codes], codes, 0)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    keep[ends[:-1][ends[:-1] < len(codes)]] = True
    return codes[keep], np.concatenate([[0], np.cumsum(keep)])[ends]


def automaton(symbols: list[int], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Transitions of the suffix automaton of a string: by symbols below width (-1 where there is none), and (state, symbol, to) by the others."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        cur, p = len(nxt), last
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    table, others = np.full((len(nxt), width), -1, np.int64), []
    for s, row in enumerate(nxt):
        for c, t in row.items():
            if c < width:
                table[s, c] = t
            else:
                others.append((s, c, t))
    return table, np.array(others, np.int64).reshape(-1, 3)


class Languages:
    """Parsing tables of all languages, one after the other in one array."""

    def __init__(self, samples: dict[str, str]):
        self.names = sorted(samples)
        coded = {n: letter_codes([samples[n]])[0] for n in self.names}
        seen, often = np.unique(np.concatenate([c for c in coded.values()]), return_counts=True) if coded else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        seen, often = seen[seen > 0], often[seen > 0]
        self.alphabet = seen
        width = self.width = FIRST + min(DENSE, len(seen))
        # the most frequent letters first, each part in order of code points
        self.symbols, dense = np.zeros(len(seen), np.int32), np.zeros(len(seen), bool)
        dense[np.argsort(-often, kind="stable")[:DENSE]] = True
        self.symbols[dense] = FIRST + np.arange(dense.sum())
        self.symbols[~dense] = width + np.arange((~dense).sum())
        self.rare = rare = len(seen) - int(dense.sum())
        symbol = {0: GAP} | dict(zip(seen.tolist(), self.symbols.tolist(), strict=True))
        tables, self.roots, self.bits, base = [], [], [], 0
        keys, to, self.rare_roots = [], [], np.full((len(self.names), rare), -1, np.int64)
        for k, n in enumerate(self.names):
            raw, others = automaton([symbol[int(c)] for c in coded[n]], width)
            keys.append((others[:, 0] + base) * rare + others[:, 1] - width)
            to.append((others[:, 2] + base) * width)
            first = others[others[:, 0] == 0]
            self.rare_roots[k, first[:, 1] - width] = (first[:, 2] + base) * width
            raw[:, OTHER] = raw[:, END] = -1
            root = raw[0]
            step = np.where(raw >= 0, raw, np.where(root >= 0, root, 0)[None, :])
            ended = np.where(raw >= 0, 0, np.where(root >= 0, 1, 2)[None, :])  # a letter that starts no phrase is one of its own
            ended[0] = np.where(root >= 0, 0, 1)
            step[:, END], ended[:, END] = np.arange(len(raw)), 0
            tables.append((((step + base) * width) << 2 | ended).ravel())
            self.roots.append(base * width)
            self.bits.append(log2(max(2, len(coded[n]))))
            base += len(raw)
        kind = np.int32 if base * width < 1 << 29 else np.int64
        self.table = np.concatenate(tables).astype(kind) if tables else np.zeros(0, np.int32)
        keys, to = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (keys, to))
        order = np.argsort(keys)
        self.rare_keys, self.rare_to = keys[order], to[order]
        self.uniform = log2(max(2, FIRST + len(seen)))

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a letter under each language (texts x languages), and whether a text has letters."""
        out, some = np.zeros((len(texts), len(self.names))), np.zeros(len(texts), bool)
        a = 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and (b == a or size + len(texts[b]) <= CHUNK):
                size += len(texts[b])
                b += 1
            out[a:b], some[a:b] = self._chunk(texts[a:b])
            a = b
        return out, some

    def _step(self, state: np.ndarray, symbol: np.ndarray, language: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases ended and next states, element by element."""
        rare = np.flatnonzero(symbol >= self.width) if self.rare else ()
        v = self.table.take(state + (np.where(symbol >= self.width, OTHER, symbol) if len(rare) else symbol))
        ended, to = v & 3, v >> 2
        if len(rare):
            # transitions by letters without a column, as the table has them for others
            letter, of, roots = symbol[rare] - self.width, language[rare], np.array(self.roots, self.table.dtype)
            key = state[rare].astype(np.int64) // self.width * self.rare + letter
            at = np.minimum(np.searchsorted(self.rare_keys, key), len(self.rare_keys) - 1)
            hit, again = self.rare_keys[at] == key, self.rare_roots[of, letter]
            ended[rare] = np.where(hit, 0, np.where((again >= 0) | (state[rare] == roots[of]), 1, 2))
            to[rare] = np.where(hit, self.rare_to[at], np.where(again >= 0, again, roots[of]))
        return ended, to

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes, ends = letter_codes(texts)
        starts = np.concatenate([[0], ends[:-1]])
        lengths = ends - starts
        letters = np.concatenate([[0], np.cumsum(codes > 0)])
        some = letters[ends] > letters[starts]
        at = np.searchsorted(self.alphabet, codes)
        known = (at < len(self.alphabet)) & (self.alphabet[np.minimum(at, max(0, len(self.alphabet) - 1))] == codes) if len(self.alphabet) else np.zeros(len(codes), bool)
        symbols = np.where(codes == 0, GAP, np.where(known, self.symbols[np.minimum(at, max(0, len(self.alphabet) - 1))] if len(self.alphabet) else OTHER, OTHER)).astype(np.int32)
        stretches = np.maximum(1, -(-lengths // STRETCH))
        first = np.concatenate([[0], np.cumsum(stretches)])
        lanes, kinds = int(first[-1]), len(self.names)
        laid = np.full(lanes * STRETCH, END, np.int32)
        laid[np.arange(len(codes)) + np.repeat(first[:-1] * STRETCH - starts, lengths)] = symbols
        laid = np.ascontiguousarray(laid.reshape(-1, STRETCH).T)
        roots = np.array(self.roots, self.table.dtype)
        # every stretch from the root, for all languages in step
        language = np.repeat(np.arange(kinds), lanes)
        state, phrases = np.repeat(roots, lanes), np.zeros(kinds * lanes, np.int64)
        for row in laid:
            ended, state = self._step(state, np.tile(row, kinds), language)
            phrases += ended
        own = state.reshape(kinds, lanes)
        reached, more = own.copy(), np.zeros((kinds, lanes), np.int64)
        # then from where the stretch before has come to, until both ways are in one state: from there they are the same
        goes_on = np.ones(lanes + 1, bool)
        goes_on[first] = False
        of, lane = (x.ravel() for x in np.meshgrid(np.arange(kinds), np.flatnonzero(goes_on), indexing="ij"))
        while len(lane):
            a, b = roots[of], reached[of, lane - 1]
            active, change = np.flatnonzero(a != b), np.zeros(len(lane), np.int64)
            a, b = a[active], b[active]
            for row in laid:
                if not len(active):
                    break
                symbol, kind = row[lane[active]], of[active]
                ended_a, a = self._step(a, symbol, kind)
                ended_b, b = self._step(b, symbol, kind)
                change[active] += ended_b - ended_a.astype(np.int64)
                apart = a != b
                active, a, b = active[apart], a[apart], b[apart]
            more[of, lane] = change
            end = own[of, lane]
            end[active] = b
            moved = end != reached[of, lane]
            reached[of, lane] = end
            of, lane = of[moved], lane[moved] + 1
            of, lane = of[goes_on[lane]], lane[goes_on[lane]]
        phrases = phrases.reshape(kinds, lanes) + more
        phrases[:, first[1:] - 1] += reached[:, first[1:] - 1] != roots[:, None]
        sums = np.concatenate([np.zeros((kinds, 1)), np.cumsum(phrases, 1)], 1)
        count = sums[:, first[1:]] - sums[:, first[:-1]]
        return (count * np.array(self.bits)[:, None] / np.maximum(1, lengths)).T, some


def learn(docs: DataFrame, train: Column, *, sample_docs: int = 64, sample_letters: int = 20_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Languages:
    """Automata of at most ``sample_letters`` letters from ``sample_docs`` documents a language.

    The documents are those with the least hashes of their ids, so that reruns
    take the same, and are learned from whole, as long as they fit; only where
    all of a language's documents are longer is the first one cut. Rows with a
    null label or text are not learned from, nor languages whose sample has no
    letter.
    """
    text = F.col(text_col).cast("string")
    own = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), text.alias("text"), train.alias("train"), (F.length(text) > sample_letters).alias("long"))
    own = own.where("train AND lang IS NOT NULL AND text IS NOT NULL").withColumn("draw", F.xxhash64("id"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("long", "draw", "id"))
    chosen = own.select("id", "lang", "draw", "long").withColumn("rank", rank).where(F.col("rank") <= sample_docs).select("id", "lang", "long").distinct()
    # one text for an id, and no more of it than can be learned from
    held = own.join(F.broadcast(chosen), ["id", "lang", "long"], "left_semi").groupBy("lang", "long", "draw", "id").agg(F.min(F.substring("text", 1, sample_letters)).alias("text"))
    samples: dict[str, str] = {}
    for r in sorted(held.collect(), key=lambda r: (r["lang"], r["long"], r["draw"], r["text"])):
        so_far = samples.get(r["lang"])
        if so_far is None:
            samples[r["lang"]] = r["text"]
        elif len(so_far) + 1 + len(r["text"]) <= sample_letters:
            samples[r["lang"]] = f"{so_far} {r['text']}"
    return Languages({lang: text for lang, text in samples.items() if any(c.isalpha() for c in text)})


def identify(docs: DataFrame, model: Languages, *, id_col: str = "doc_id", text_col: str = "text", sharpness: float = 4.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Language of every text: ``id_col``, the columns of ``keep``, lang_pred, score (0 to 1), bits.

    ``und`` with score 0 where the text is null or has no letter, or nothing
    was learned; bits is then null. Ties go to the name first in order. Bits
    near or above those of letters drawn evenly say that no language fits.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a table of at most languages x 2 sample_letters states

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            if m.names:
                found, some = m.entropies(texts)
                best = found.argmin(1)
                low = found[np.arange(len(texts)), best]
                score = 1 / np.exp2(-sharpness * (found - low[:, None])).sum(1)
                names = [m.names[i] if ok else "und" for i, ok in zip(best, some, strict=True)]
                score = np.where(some, score, 0.0)
            else:
                names, score, low, some = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), bool)
            kept = [b.column(i) for i in range(1 + len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(score), pa.array(low, mask=~some)], names=[*b.schema.names[: len(kept)], "lang_pred", "score", "bits"])

    rows = docs.select(id_col, *keep) if text_col in keep else docs.select(id_col, *keep, F.col(text_col).cast("string").alias("_text"))
    at = rows.columns.index(text_col if text_col in keep else "_text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: 1 + len(keep)])
    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double, bits double")



"""Personal data: surrogates of the same type, format, script and gender.

Entities are found by pattern, near the characters that each must have; a
secret is found at its keyword. An entity has a canonical form (the digits of a phone number, an address in lower
case), and its surrogate is a keyed permutation of that form, rendered in the
mention's own layout: all mentions of an entity get the same surrogate,
whatever their layout, in all documents and runs under the same key.

The permutation is a Feistel network over the form's symbols, each in its own
alphabet (digits, hexadecimal digits, letters of one script and case, octets).
For one type and format it is a bijection, so different entities get different
surrogates without a table of them. Given names go through a keyed permutation
of the names of the same gender and script. What this can't rule out (a name
that isn't listed turning into one that is, a surrogate that is the entity
itself) a check over all distinct entities finds; those entities are drawn
again until no surrogate is shared.
"""

from __future__ import annotations

import re
import secrets as random_bytes
from collections.abc import Iterator
from functools import cache
from hashlib import blake2b
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed

# Titles that tell a gender, and given names by gender and script.
TITLES = {"Mr": "m", "Herr": "m", "Monsieur": "m", "Sr": "m", "Señor": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Mme": "f", "Madame": "f", "Sra": "f", "Señora": "f"}
GIVEN = {
    ("m", "latin"): ["Adam", "Carlos", "Daniel", "David", "Erik", "Felix", "George", "Hans", "Jack", "James", "John", "Karl", "Louis", "Marco", "Michael", "Paul", "Peter", "Robert", "Thomas", "William"],
    ("f", "latin"): ["Alice", "Anna", "Clara", "Diana", "Elena", "Emma", "Eva", "Helen", "Julia", "Laura", "Lisa", "Lucia", "Maria", "Marie", "Mary", "Nina", "Paula", "Sara", "Sofia", "Susan"],
    ("m", "cyrillic"): ["Алексей", "Андрей", "Борис", "Дмитрий", "Иван", "Максим", "Николай", "Олег", "Павел", "Сергей"],
    ("f", "cyrillic"): ["Анна", "Вера", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Светлана", "Софья", "Юлия"],
}
GENDER = {name: key for key, names in GIVEN.items() for name in names}
#: First and last letter of the alphabets that letters are permuted in.
ALPHABETS = [("0", "9"), ("a", "z"), ("A", "Z"), ("а", "я"), ("А", "Я"), ("α", "ω"), ("Α", "Ω"), ("\u4e00", "\u9fa5"), ("à", "ö"), ("ø", "ÿ"), ("À", "Ö"), ("Ø", "Þ"), ("\u05d0", "\u05ea"), ("\u0621", "\u063a"), ("\u3041", "\u3096"), ("\u30a1", "\u30fa"), ("\uac00", "\ud7a3")]
NAME = r"[^\W\d_a-zà-öø-ÿа-я][^\W\d_]+(?:-[^\W\d_]+)?"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
NEAR = 160
ATTEMPTS = 64

MARK = re.compile(r"[@\d]")
KEYWORD = r"\b(?:token|secret|api[_-]?key|password|passwd|access[_-]?key)\b"
SECRET = re.compile(KEYWORD + r"""\s*[=:]\s*["']?[A-Za-z0-9_+/-]{12,}""", re.I)
SHAPE = re.compile(
    rf"""(?P<email>[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{{2,}})
    |(?i:{KEYWORD})\s*[=:]\s*["']?(?P<secret>[A-Za-z0-9_+/-]{{12,}})
    |(?<![\w.])(?P<ip>(?:{OCTET}\.){{3}}{OCTET})(?!\.?\d)
    |(?<!\w)(?P<iban>[A-Z]{{2}}\d{{2}}(?:[ ]?[A-Z0-9]{{4}}){{3,7}}(?:[ ]?[A-Z0-9]{{1,3}})?)(?!\w)
    |(?<![\w+-])(?P<ssn>\d{{3}}-\d{{2}}-\d{{4}})(?![\w-])
    |(?<!\w)(?P<phone>\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?\d{{2,4}}(?:[ .-]?\d{{2,4}}){{1,4}}|\(\d{{3}}\)[ ]?\d{{3}}-\d{{4}}|\d{{3}}-\d{{3}}-\d{{4}})(?!\d)
    |(?<![\w.])(?P<card>\d{{13,19}}|\d{{4}}(?:[ -]\d{{4}}){{3}})(?![\d])""",
    re.X,
)
CAPITAL = re.compile(r"[A-ZÀ-ÖØ-ÞА-Я][^\W\d_]+")
AFTER_TITLE = re.compile(rf"\.?[ ](?P<name>{NAME}(?:[ ]{NAME})?)")
AFTER_GIVEN = re.compile(rf"[ ]{NAME}")


class Mention(NamedTuple):
    start: int
    end: int
    kind: str
    canonical: str  # for names with the gender before it


def around(text: str, at: int) -> tuple[int, int]:
    """What is searched for a mark: as far as forms with digits reach, and for an @ the whole run of an address's characters, however long."""
    a = b = at
    if text[at] == "@":
        while a and (text[a - 1].isalnum() or text[a - 1] in "_.+-"):
            a -= 1
        while b + 1 < len(text) and (text[b + 1].isalnum() or text[b + 1] in "_.-"):
            b += 1
    return a - NEAR, b + 1 + NEAR


def mentions(text: str | None) -> list[Mention]:
    """Entities in order, not overlapping."""
    if not text:
        return []
    found, done, spans = [], 0, []
    near = [around(text, m.start()) for m in MARK.finditer(text)]
    # a secret needs no such character, and its value may be of any length
    if secrets := [m.span() for m in SECRET.finditer(text)]:
        near += secrets
    for a, b in sorted(near):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([max(0, a), b])
    for a, b in spans:
        for m in SHAPE.finditer(text, max(a, done), min(b, len(text))):
            kind = m.lastgroup
            done = m.end(kind)
            found.append(Mention(m.start(kind), done, kind, canonical(kind, m[kind])))
    for m in CAPITAL.finditer(text):
        word = m[0]
        if word in TITLES and (n := AFTER_TITLE.match(text, m.end())):
            found.append(Mention(n.start("name"), n.end(), "name", f"{TITLES[word]}|{n['name']}"))
        elif word in GENDER and (n := AFTER_GIVEN.match(text, m.end())):
            found.append(Mention(m.start(), n.end(), "name", f"{GENDER[word][0]}|{text[m.start() : n.end()]}"))
    found.sort(key=lambda m: (m.start, -m.end))
    kept: list[Mention] = []
    for m in found:
        if not kept or m.start >= kept[-1].end:
            kept.append(m)
    return kept


def canonical(kind: str, text: str) -> str:
    if kind in ("phone", "card", "ssn"):
        return "".join(c for c in text if c.isdigit())
    if kind == "iban":
        return text.replace(" ", "")
    return text.lower() if kind == "email" else text


def draw(key: bytes, *parts: str) -> Iterator[int]:
    n = 0
    while True:
        yield from blake2b("\x1f".join((*parts, str(n))).encode("utf-8", "surrogatepass"), key=key, digest_size=64).digest()
        n += 1


def permute(symbols: list[int], sizes: list[int], key: bytes, tweak: str) -> list[int]:
    """A keyed bijection of symbol vectors; the i-th symbol is below sizes[i]."""
    if len(symbols) == 1:
        order = sorted(range(sizes[0]), key=lambda i: next_int(draw(key, tweak, str(i))))
        return [order[symbols[0]]]
    half, out = len(symbols) // 2, list(symbols)
    for turn in range(8):
        own, other = ((0, half), (half, len(out)))[:: 1 if turn % 2 else -1]
        bytes_ = draw(key, tweak, str(turn), ",".join(map(str, out[other[0] : other[1]])))
        for i in range(*own):
            out[i] = (out[i] + next_int(bytes_)) % sizes[i]
    return out


def next_int(bytes_: Iterator[int]) -> int:
    return int.from_bytes(bytes(next(bytes_) for _ in range(8)), "big")


@cache
def _alphabet(c: str) -> tuple[int, int] | None:
    """The listed alphabet of a character, else the letters that stand next to a letter in its block of 128."""
    for a, z in ALPHABETS:
        if a <= c <= z:
            return ord(a), ord(z) - ord(a) + 1
    if not c.isalpha():
        return None
    lo = hi = ord(c)
    while lo % 128 and chr(lo - 1).isalpha():
        lo -= 1
    while (hi + 1) % 128 and chr(hi + 1).isalpha():
        hi += 1
    return lo, hi - lo + 1


def _places(text: str) -> list[tuple[int, int] | None]:
    """(first of its alphabet, alphabet's size) of every character that is to change."""
    return [_alphabet(c) for c in text]


def scramble(text: str, key: bytes, tweak: str) -> str:
    """Permute the text's letters and digits, each in its alphabet; the rest stays."""
    places = _places(text)
    at = [i for i, p in enumerate(places) if p]
    if not at:
        return text
    new = permute([ord(text[i]) - places[i][0] for i in at], [places[i][1] for i in at], key, tweak + "|" + "".join(str(p and p[0]) for p in places))
    out = list(text)
    for i, x in zip(at, new, strict=True):
        out[i] = chr(places[i][0] + x)
    return "".join(out)


def luhn(digits: str) -> int:
    total = sum(d if i % 2 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def surrogate(kind: str, form: str, key: bytes, attempt: int = 0) -> str:
    """The canonical form that stands for a canonical form."""
    tweak = f"{kind}|{attempt}"
    if kind == "card":  # a valid check digit stays valid, any other stays as far off
        body = scramble(form[:-1], key, tweak)
        return body + str((luhn(body) + int(form[-1]) - luhn(form[:-1])) % 10)
    if kind == "ip":
        return ".".join(map(str, permute([int(x) for x in form.split(".")], [256] * 4, key, tweak)))
    if kind == "phone" and len(form) > 8:  # what may be a country's code stays
        return form[:1] + scramble(form[1:], key, tweak)
    if kind == "secret" and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", form):
        new = permute([int(c, 16) for c in form], [16] * len(form), key, f"{tweak}|{len(form)}")
        return ("%X" if form.upper() == form else "%x") * len(form) % tuple(new)
    if kind == "iban":
        return form[:2] + scramble(form[2:], key, tweak)
    if kind == "email":
        local, _, domain = form.partition("@")
        host, _, rest = domain.partition(".")
        return f"{scramble(local, key, tweak)}@{scramble(host, key, 'domain')}.{rest}"
    if kind == "name":
        gender, _, name = form.partition("|")
        parts = name.split(" ")
        listed = GENDER.get(parts[0])
        out = [scramble(p, key, tweak) for p in parts]
        if listed:
            names = GIVEN[(gender, listed[1])] if (gender, listed[1]) in GIVEN else GIVEN[listed]
            names = names if parts[0] in names else GIVEN[listed]
            out[0] = following(names, parts[0], key)
        return f"{gender}|{' '.join(out)}"
    return scramble(form, key, tweak)


def following(names: list[str], name: str, key: bytes) -> str:
    """The next name in a keyed circle of all: a bijection that leaves no name as it is."""
    circle = sorted(names, key=lambda n: next_int(draw(key, "given", n)))
    return circle[(circle.index(name) + 1) % len(circle)]


def render(kind: str, mention: str, new: str) -> str:
    """The surrogate in the mention's layout."""
    if kind == "name":
        return new.partition("|")[2]
    if kind in ("phone", "card", "ssn", "iban"):
        chars = iter(new)
        return "".join(next(chars) if c.isalnum() else c for c in mention)
    if kind == "email":
        return "".join(n.upper() if c.isupper() else n for c, n in zip(mention, new, strict=True)) if len(mention) == len(new) else new
    return new


def _distinct_entities(docs: DataFrame, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = {(m.kind, m.canonical) for t in b.column("text").to_pylist() for m in mentions(t)}
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in own], pa.string()) for i in (0, 1)], names=["kind", "form"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "kind string, form string").distinct()


def redrawn(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """(kind, form, attempt) of the entities whose first surrogate won't do: it is the entity, or another's.

    Of entities that share a surrogate the first in order keeps it. Entities
    drawn again must also differ from all surrogates kept before. Raises where
    ``ATTEMPTS`` draws leave an entity without one.
    """
    def drawn(attempt: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                new = [surrogate(k, f, key, attempt) for k, f in zip(b.column("kind").to_pylist(), b.column("form").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("form"), pa.array(new, pa.string())], names=["kind", "form", "new"])

        return run

    schema, attempt = "kind string, form string, new string", 0
    held = checkpointed(_distinct_entities(docs, text_col).mapInArrow(drawn(0), schema).withColumn("attempt", F.lit(0)))
    while True:
        # the kept come first, then order of form; one aggregate for each surrogate
        first = held.groupBy("kind", "new").agg(F.min(F.struct("attempt", "form")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        shared = held.join(first, ["kind", "new"], "left").where((F.col("form") == F.col("new")) | (F.col("first.form") != F.col("form"))).select("kind", "form")
        again = checkpointed(shared)
        if again.isEmpty():
            break
        if attempt == ATTEMPTS:  # written out, these would be themselves or another's
            raise ValueError(f"{again.count()} entities have no surrogate of their own")
        attempt += 1
        rest = held.join(again, ["kind", "form"], "left_anti")
        held = checkpointed(rest.unionByName(again.mapInArrow(drawn(attempt), schema).withColumn("attempt", F.lit(attempt))))
    return held.where("attempt > 0").select("kind", "form", "attempt")


def own_key(spark: SparkSession) -> bytes:
    """The key in `spark.sluice.surrogates.key` (hexadecimal, 16 bytes at least), else one drawn for this call that nobody keeps.

    Under a key that is known surrogates can be turned back, so there is none by default.
    """
    given = spark.conf.get("spark.sluice.surrogates.key", "")
    if not given:
        return random_bytes.token_bytes(32)
    if len(key := bytes.fromhex(given)) < 16:
        raise ValueError("spark.sluice.surrogates.key must have 16 bytes at least")
    return key[:64]


def replace_personal_data(docs: DataFrame, *, key: bytes | None = None, id_col: str = "doc_id", text_col: str = "text", sent_entities: int = 50_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every document with its entities replaced: ``id_col``, columns of ``keep``, text, entities.

    ``entities`` lists (kind, start, end, surrogate) by place in the old text.
    A null text stays null and an empty one empty, both without entities;
    repeated rows are treated alike; an empty table gives an empty result.
    Other columns are not read. Without ``key`` it is that of ``own_key``: set
    one where runs must agree. Entities that had to be drawn again, if no more
    than ``sent_entities``, go to all tasks, else only to their documents by a
    join on the id.
    """
    key = key or own_key(docs.sparkSession)
    again = redrawn(docs, key, text_col)
    few = again.limit(sent_entities + 1).collect()
    rows = docs.select(id_col, *keep, F.col(text_col).cast("string").alias("_text"))
    if len(few) <= sent_entities:
        sent = {(r["kind"], r["form"]): r["attempt"] for r in few}
        rows = rows.withColumn("_again", F.lit(None).cast("array<struct<kind string, form string, attempt int>>"))
    else:
        sent = {}

        def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = [(i, m.kind, m.canonical) for i, t in zip(b.column("id").to_pylist(), b.column("_text").to_pylist(), strict=True) for m in mentions(t)]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in own], b.schema.field("id").type), *(pa.array([x[i] for x in own], pa.string()) for i in (1, 2))], names=["id", "kind", "form"])

        kind = rows.schema[id_col].dataType.simpleString()
        where = rows.select(F.col(id_col).alias("id"), "_text").mapInArrow(seen, f"id {kind}, kind string, form string").distinct().join(again, ["kind", "form"])
        where = where.groupBy("id").agg(F.collect_list(F.struct("kind", "form", F.col("attempt").cast("int").alias("attempt"))).alias("_again"))
        rows = rows.join(where, rows[id_col].eqNullSafe(where["id"]), "left").drop("id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, lists = [], []
            for text, more in zip(b.column("_text").to_pylist(), b.column("_again").to_pylist(), strict=True):
                attempts = sent | {(x["kind"], x["form"]): x["attempt"] for x in more} if more else sent
                out, at, entities = [], 0, []
                for m in mentions(text):
                    new = render(m.kind, text[m.start : m.end], surrogate(m.kind, m.canonical, key, attempts.get((m.kind, m.canonical), 0)))
                    out += [text[at : m.start], new]
                    at = m.end
                    entities.append({"kind": m.kind, "start": m.start, "end": m.end, "surrogate": new})
                texts.append("".join([*out, text[at:]]) if entities else text)
                lists.append(entities)
            kept = [b.column(i) for i in range(b.num_columns - 2)]
            listed = pa.array(lists, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())])))
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), listed], names=[*b.schema.names[:-2], "text", "entities"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2])
    return rows.mapInArrow(run, f"{schema}, text string, entities array<struct<kind string, start int, end int, surrogate string>>")

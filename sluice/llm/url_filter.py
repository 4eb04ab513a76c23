"""URL filter: a sort-merge range join of pages with host and path rules.

A host is turned round, label by label, and closed with a dot
(``www.example.net`` -> ``net.example.www.``), so that a host and all its
subdomains are one interval of the sorted keys. Pages are range-partitioned
and sorted by that key; each partition is swept once beside the sorted rules,
with a stack of the rules whose intervals enclose the current key. Intervals
of prefixes nest, so the stack is the chain of enclosing hosts, at most one
frame for each label of the host.

Range partitions are cut by (key, path, id): a host with any share of the rows
spreads over many tasks, each of which rebuilds its stack from its first key.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty for null or where ``://`` is missing."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


class RuleSweep:
    """The rules in key order, and the stack of those around the current key."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        frames: dict[str, dict[str, tuple[str, str]]] = {}
        for host, path, verdict in sorted(rules, key=lambda r: (r[0], r[1], r[2] == "block")):
            frames.setdefault(host_key(host), {})[path] = (host + path, verdict)
        self.starts = sorted(frames)
        self.frames = [(s, frames[s], sorted({len(p) for p in frames[s]}, reverse=True)) for s in self.starts]
        self.next: int | None = None
        self.stack: list[int] = []

    def move_to(self, key: str) -> None:
        if self.next is None:  # in the middle of the key range: only ancestors of the key can be open
            self.next = bisect_right(self.starts, key)
            labels = key.split(".")[:-1]
            for n in range(1, len(labels) + 1):
                start = ".".join(labels[:n]) + "."
                i = bisect_right(self.starts, start) - 1
                if i >= 0 and self.starts[i] == start:
                    self.stack.append(i)
            return
        while self.next < len(self.starts) and self.starts[self.next] <= key:
            start = self.starts[self.next]
            while self.stack and not start.startswith(self.starts[self.stack[-1]]):
                self.stack.pop()
            self.stack.append(self.next)
            self.next += 1
        while self.stack and not key.startswith(self.starts[self.stack[-1]]):
            self.stack.pop()

    def longest(self, path: str) -> tuple[str, str] | None:
        """The longest rule of the open frames that the path starts with; ties to the longer host."""
        best = None
        for i in self.stack:
            _, by_path, lengths = self.frames[i]
            for n in lengths:
                hit = by_path.get(path[:n]) if n <= len(path) else None
                if hit:
                    if best is None or len(hit[0]) >= len(best[0]):
                        best = hit
                    break
        return best


def _sweep(rules: list[tuple[str, str, str]], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, last = RuleSweep(rules), None
        for b in batches:
            kept_rule, kept_verdict = b.column("rule").to_pylist(), b.column("verdict").to_pylist()
            for i, (key, path) in enumerate(zip(b.column("host_key").to_pylist(), b.column("path").to_pylist(), strict=True)):
                if key != last:
                    sweep.move_to(key)
                    last = key
                hit = sweep.longest(path)
                if hit and (kept_rule[i] is None or len(hit[0]) > len(kept_rule[i])):
                    kept_rule[i], kept_verdict[i] = hit
            columns = [b.column(n) for n in schema.names[:-2]] + [pa.array(kept_rule, pa.string()), pa.array(kept_verdict, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def judge_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", rules_per_block: int = 100_000) -> DataFrame:
    """Judge every page by the longest rule that fits its url.

    ``rules`` has columns host, path, verdict; a rule fits its host and all
    subdomains of it where the url's path starts with the rule's path. Returns
    ``id_col``, host, path, rule (``host + path`` of the rule, null if none
    fits) and verdict (``default`` if none fits), one row for each input row.

    Rules go to the tasks in blocks of at most ``rules_per_block``, a fixed
    bound on what is sent; a longer list takes more sweeps over the same sorted
    rows, within the same stage.

    Nulls: a null url has empty host and path and gets the default verdict; a
    null id is kept; a rule with a null host is ignored and a null path counts
    as empty. Of equal rules with different verdicts block wins. Repeated rows
    are judged each on its own. Empty tables give empty results. Other columns
    of ``pages`` are not read.
    """
    host, path = url_parts(F.col(url_col))
    rules = rules.where("host IS NOT NULL").select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict").distinct()
    blocks = max(1, -(-rules.count() // rules_per_block))
    keyed = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    keyed = keyed.withColumn("host_key", F.concat(F.array_join(F.reverse(F.split("host", r"\.", -1)), "."), F.lit(".")))
    swept = keyed.repartitionByRange("host_key", "path", "id").sortWithinPartitions("host_key", "path")
    swept = swept.select("id", "host", "path", "host_key", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    arrow = pa.schema([("id", _arrow_id(swept)), *((n, pa.string()) for n in ("host", "path", "host_key", "rule", "verdict"))])
    for k in range(blocks):
        block = [tuple(r) for r in rules.where(F.pmod(F.xxhash64("host"), F.lit(blocks)) == k).collect()]
        swept = swept.mapInArrow(_sweep(block, arrow), swept.schema)
    return swept.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _arrow_id(df: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema["id"].dataType)

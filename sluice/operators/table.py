"""Versioned Parquet tables.

A table is a folder of immutable Parquet folders and one JSON manifest for each
version: its parts, the key deletes laid over them, rows, schema, parent, batch
and summary. A commit writes its data first, then the manifest to a file of its
own, which gets the next number's name only if no other writer has it: so a
manifest is there whole or not at all, and of two writers that began from one
version the second fails. All file work goes through the cluster's file system
interface, so tables can be in any store Spark reads that can rename.

A delta needs no rewrite: its deleted keys are a part of their own, with the
number of its version, and a read leaves out the rows of older parts that have
one of these keys (and partition). `compact` writes the table out without them.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .apply import apply_delta, operation_name


class CommitConflict(RuntimeError):
    """Another writer committed the version first."""


@dataclass(frozen=True)
class Version:
    number: int
    parts: list[str]
    schema: str
    rows: int
    parent: int | None
    operation: str
    at: float
    batch: int | None = None
    summary: dict[str, str] = field(default_factory=dict)
    added: dict[str, int] = field(default_factory=dict)  # part -> version that added it; parts without are the oldest
    deletes: list[dict] = field(default_factory=list)  # part, keys and version of each delete


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifest(self, number: int) -> str:
        return f"{self.path}/versions/{number:010d}.json"

    def _names(self) -> list[str]:
        folder = self._Path(f"{self.path}/versions")
        if not self.fs.exists(folder):
            return []
        return sorted(s.getPath().toString() for s in self.fs.listStatus(folder) if s.getPath().getName().endswith(".json"))

    def versions(self) -> list[Version]:
        return [self._read(n) for n in self._names()]

    def _read(self, name: str) -> Version:
        stream = self.fs.open(self._Path(name))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Version(**json.loads(text))

    def current(self) -> Version | None:
        names = self._names()
        return self._read(names[-1]) if names else None

    def read(self, version: int | Version | None = None) -> DataFrame:
        """The rows of a version, the last one unless another is named."""
        if isinstance(version, Version):
            v = version
        else:
            names = [n for n in self._names() if version is None or n.endswith(f"/{version:010d}.json")]
            if not names:
                raise ValueError(f"{self.path} has no version {version if version is not None else 'yet'}")
            v = self._read(names[-1])
        schema = T.StructType.fromJson(json.loads(v.schema))
        if not v.parts:
            return self.spark.createDataFrame([], schema)
        if not v.deletes:
            return self._parts(schema, v.parts)
        by_age: dict[int, list[str]] = {}
        for p in v.parts:
            by_age.setdefault(v.added.get(p, -1), []).append(p)
        # a part meets only the deletes after it; the latest of a key counts
        whole = None
        for age, parts in sorted(by_age.items()):
            rows = self._parts(schema, parts)
            for keys in sorted({tuple(d["keys"]) for d in v.deletes}):
                later = [d["part"] for d in v.deletes if d["number"] > age and tuple(d["keys"]) == keys]
                if later:
                    own = T.StructType([schema[k] for k in keys])
                    gone = self._parts(own, later).distinct().select(*(F.col(k).alias(f"_gone_{i}") for i, k in enumerate(keys)))
                    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_gone_{i}")) for i, k in enumerate(keys)))
                    rows = rows.join(gone, same, "left_anti")
            whole = rows if whole is None else whole.unionByName(rows)
        return whole

    def _parts(self, schema: T.StructType, parts: list[str]) -> DataFrame:
        """Rows of some parts; a part written by partition has these columns in its folders' names."""
        frames = [self.spark.read.schema(schema).parquet(f"{self.path}/data/{p}") for p in parts if p.startswith("by-")]
        plain = [p for p in parts if not p.startswith("by-")]
        if plain:
            frames.append(self.spark.read.schema(schema).parquet(*(f"{self.path}/data/{p}" for p in plain)))
        return reduce(DataFrame.unionByName, (f.select(*schema.names) for f in frames))

    def _write(self, df: DataFrame, by: tuple[str, ...] = ()) -> tuple[str, int]:
        part, seen = ("by-" if by else "") + uuid.uuid4().hex, Observation()
        df = df.observe(seen, F.count(F.lit(1)).alias("n"))
        writer = df.repartition(*by).write.partitionBy(*by) if by else df.write
        writer.parquet(f"{self.path}/data/{part}")
        try:
            return part, int(seen.get["n"])
        except (AssertionError, Py4JJavaError):  # a plan known to be empty is never observed
            return part, self.spark.read.schema(df.schema).parquet(f"{self.path}/data/{part}").count()

    def _commit(self, parent: Version | None, parts: list[str], schema: T.StructType, rows: int, operation: str, batch: int | None, summary: dict, added: dict[str, int] = {}, deletes: list[dict] = []) -> Version:  # noqa: B006
        number = parent.number + 1 if parent else 0
        v = Version(number, parts, schema.json(), rows, parent.number if parent else None, operation, time.time(), batch, {k: str(x) for k, x in summary.items()}, added, deletes)
        to, own = self._Path(self._manifest(number)), self._Path(f"{self.path}/versions/.{uuid.uuid4().hex}")
        out = self.fs.create(own, False)
        out.write(bytearray(json.dumps(asdict(v)).encode()))
        out.close()
        jvm = self.spark._jvm
        try:
            if to.toUri().getScheme() in (None, "file"):  # a rename would replace the other writer's file
                jvm.java.nio.file.Files.createLink(jvm.java.io.File(to.toUri().getPath()).toPath(), jvm.java.io.File(own.toUri().getPath()).toPath())
            elif self.fs.exists(to) or not self.fs.rename(own, to):
                raise CommitConflict(f"version {number} of {self.path} exists")
        except Py4JJavaError as e:
            raise CommitConflict(f"version {number} of {self.path} exists") from e
        finally:
            self.fs.delete(own, False)
        return v

    def overwrite(self, df: DataFrame, operation: str = "overwrite", batch: int | None = None, expected: Version | None = None, **summary) -> Version:
        """All rows anew. A batch that is already committed is not written again.

        ``expected`` is the version that ``df`` was made from: if another has
        been committed since, this fails and nothing is lost.
        """
        if done := self._committed(batch):
            return done
        parent = expected or self.current()
        part, rows = self._write(df)
        return self._commit(parent, [part], df.schema, rows, operation, batch, summary, {part: parent.number + 1 if parent else 0})

    def append(self, df: DataFrame, batch: int | None = None, **summary) -> Version:
        """Rows beside those that are there; made again from the newest version where another writer was faster."""
        if done := self._committed(batch):
            return done
        part, rows = self._write(df)
        while True:
            parent = self.current()
            schema = T.StructType.fromJson(json.loads(parent.schema)) if parent else df.schema
            known = {f.name.lower() for f in schema.fields}
            schema = T.StructType([*schema.fields, *(T.StructField(f.name, f.dataType, True) for f in df.schema.fields if f.name.lower() not in known)])
            number = parent.number + 1 if parent else 0
            try:
                return self._commit(parent, [*(parent.parts if parent else []), part], schema, rows + (parent.rows if parent else 0), "append", batch, summary, (parent.added if parent else {}) | {part: number}, parent.deletes if parent else [])
            except CommitConflict:
                if self.current() == parent:
                    raise

    def commit_delta(self, deletes: DataFrame, upserts: DataFrame, keys: list[str], batch: int | None = None, by: tuple[str, ...] = (), **summary) -> Version:
        """Deletes and upserts as one version, without a rewrite.

        Written are the deleted keys, those of the upserts among them, and the
        upserts. In a table with partition columns ``by`` both are laid out by
        them and a key is deleted only in the partitions it is listed with, so
        a row that moved must be listed with each that it was in. Rows count as
        in the data files, without what the deletes hide.
        """
        if done := self._committed(batch):
            return done
        parent = self.current()
        if parent is None:
            return self.overwrite(upserts, "append", batch, **summary)
        number, own = parent.number + 1, [*keys, *(c for c in by if c not in keys)]
        gone = deletes.select(*own).unionByName(upserts.select(*own)).distinct()
        hidden, n = self._write(gone, by)
        part, rows = self._write(upserts, by)
        for name, count in ((hidden, n), (part, rows)):
            if not count:
                self.fs.delete(self._Path(f"{self.path}/data/{name}"), True)
        schema = T.StructType.fromJson(json.loads(parent.schema))
        laid = [*parent.deletes, {"part": hidden, "keys": own, "number": number}] if n else parent.deletes
        kind = operation_name(n, rows)
        return self._commit(parent, [*parent.parts, *([part] if rows else [])], schema, parent.rows + rows, kind, batch, summary | {"deleted_keys": n, "added_rows": rows}, parent.added | ({part: number} if rows else {}), laid)

    def _committed(self, batch: int | None) -> Version | None:
        return next((v for v in self.versions() if batch is not None and v.batch == batch), None)

    def apply(self, deletes: DataFrame, upserts: DataFrame, keys: list[str], batch: int | None = None) -> Version:
        """Apply a delta to the current version, copying on write."""
        if done := self._committed(batch):
            return done
        v = self.current()
        if v is None:
            return self.overwrite(upserts, "append", batch)
        return self.overwrite(apply_delta(self.read(v), deletes, upserts, keys), "delete-append", batch, expected=v)

    def metadata_rows(self) -> int:
        """Row count of the current version's data files, from its manifest alone; deletes laid over them don't count."""
        return (v.rows if (v := self.current()) else 0)

    def compact(self, target_bytes: int = 128 << 20) -> Version:
        """The current rows in files of about the target size, without the rows that deletes hide."""
        v = self.current()
        size = sum(self.fs.getContentSummary(self._Path(f"{self.path}/data/{p}")).getLength() for p in v.parts)
        files = max(1, -(-size // target_bytes))
        return self.overwrite(self.read(v).repartition(files), "replace", expected=v)

    def expire(self, older_than_s: float = 168 * 3600, retain: int = 10, now: float | None = None) -> list[int]:
        """Forget versions that are older than the limit and not among the last ``retain``; their numbers."""
        found = self.versions()
        gone = [v for v in found[: max(0, len(found) - retain)] if v.at < (now or time.time()) - older_than_s]
        for v in gone:
            self.fs.delete(self._Path(self._manifest(v.number)), False)
        return [v.number for v in gone]

    def orphans(self, min_age_s: float = 7 * 86400, now: float | None = None, dry_run: bool = True) -> list[str]:
        """Data folders that no version refers to and that are old enough; deleted unless ``dry_run``."""
        used = {p for v in self.versions() for p in [*v.parts, *(d["part"] for d in v.deletes)]}
        folder = self._Path(f"{self.path}/data")
        if not self.fs.exists(folder):
            return []
        limit = ((now or time.time()) - min_age_s) * 1000
        gone = [s.getPath() for s in self.fs.listStatus(folder) if s.getPath().getName() not in used and s.getModificationTime() < limit]
        for p in [] if dry_run else gone:
            self.fs.delete(p, True)
        return sorted(p.getName() for p in gone)

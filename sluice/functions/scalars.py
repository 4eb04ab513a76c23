"""Scalar rules as Column expressions; all run inside whole-stage code."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTIAL_DATE = r"^(\d{4})-(\d{2})-(\d{2})(.*)$"
# Thresholds of maintenance and activity.
SMALL_FILES, SOME_SMALL_FILES, SMALL_BYTES, EQUALITY_DELETES, POSITION_DELETES = 200, 10, 256 << 20, 50, 25
ROUTE_DELETES, ROUTE_BYTES, ROUTE_FILES = 100, 512 << 20, 250
PROFILES = [("xlarge", 8 << 30, 2000, 800), ("large", 2 << 30, 1000, 400), ("medium", 512 << 20, 250, 100)]
PROFILE_ORDER = ["small", "medium", "large", "xlarge"]
HOUR = 3600
ACTIVITY = [("hot", HOUR), ("warm", 24 * HOUR), ("cold", 7 * 24 * HOUR)]


def is_partial_date(text: Column) -> Column:
    """A date with a zero year, month or day; null stays null."""
    t = F.trim(text)
    part = lambda i: F.regexp_extract(t, PARTIAL_DATE, i)
    return t.rlike(PARTIAL_DATE) & ((part(1) == "0000") | (part(2) == "00") | (part(3) == "00"))


def repair_partial_date(text: Column) -> Column:
    """Zero year becomes 1970, zero month or day 1; what follows is kept. Other text is unchanged."""
    t = F.trim(text)
    part = lambda i, zero, new: F.when(F.regexp_extract(t, PARTIAL_DATE, i) == zero, new).otherwise(F.regexp_extract(t, PARTIAL_DATE, i))
    fixed = F.concat(part(1, "0000", "1970"), F.lit("-"), part(2, "00", "01"), F.lit("-"), part(3, "00", "01"), F.regexp_extract(t, PARTIAL_DATE, 4))
    return F.when(is_partial_date(text), fixed).otherwise(text)


def partial_date_value(text: Column, nullable: bool) -> Column:
    """Null for a partial date where null is allowed, else its repair."""
    return F.when(is_partial_date(text), F.lit(None).cast("string")).otherwise(text) if nullable else repair_partial_date(text)


def is_zero_date(text: Column) -> Column:
    return F.trim(text).rlike(r"^0000-00-00($|[ T])")


def load_value(text: Column, temporal: bool, nullable: bool) -> Column:
    """Text for a stream load: partial dates of temporal columns, and exact zero dates of others, repaired."""
    t = F.trim(text)
    if temporal:
        return partial_date_value(t, nullable)
    return F.when(t == "0000-00-00", "1970-01-01").when(t == "0000-00-00 00:00:00", "1970-01-01 00:00:00").otherwise(t)


def parse_time(text: Column) -> Column:
    """The first of four layouts that fits, as a timestamp without zone (UTC)."""
    zoned = F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX"))
    plain = [F.try_to_timestamp(text, F.lit(p)) for p in ("yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")]
    return F.coalesce(zoned, *plain).cast("timestamp_ntz")


def sanitize_cell(text: Column) -> Column:
    """Line breaks, unit separators and carets to spaces, double quotes to single."""
    return F.translate(F.replace(text, F.lit("\r\n"), F.lit(" ")), '\r\n\x1f"^', "   ' ")


def ascii_fold(text: Column) -> Column:
    """Common typographic signs to ASCII; other non-ASCII characters are dropped."""
    return F.regexp_replace(F.translate(text, "–—−“”‘’ ", "---'''' "), r"[^\x00-\x7F]", "")


def truncate_characters(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def normalize_text(text: Column, limit: int | None = None) -> Column:
    out = ascii_fold(sanitize_cell(text))
    return truncate_characters(out, limit) if limit else out


def stream_row(columns: list[Column], deleted: Column) -> Column:
    r"""One line of a load: fields parted by 0x1F, \N for null, and the delete marker last."""
    return F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit(r"\N")) for c in columns), F.when(deleted, "1").otherwise("0"))


def to_int(text: Column) -> Column:
    """Whole part of a number in text; null where there is none."""
    return F.coalesce(text.try_cast("long"), text.try_cast("double").try_cast("long"))


def to_bool(value: Column) -> Column:
    return F.coalesce(value.try_cast("boolean"), value.try_cast("double") != 0)


def log_file_prefix(name: Column) -> Column:
    return F.regexp_extract(name, r"^(.*?)(\d+)$", 1)


def log_file_number(name: Column) -> Column:
    """Number at the end of a log file's name; null if there is none."""
    digits = F.regexp_extract(name, r"^(.*?)(\d+)$", 2)
    return F.when(digits != "", digits).try_cast("long")


def log_file_lag(at: Column, latest: Column) -> Column:
    """Files between two positions, 0 if ahead; null if the names don't belong together."""
    a, b = log_file_number(at), log_file_number(latest)
    return F.when((log_file_prefix(at) == log_file_prefix(latest)) & a.isNotNull() & b.isNotNull(), F.greatest(b - a, F.lit(0)))


def checkpoint_status(at: Column, first: Column, last: Column, count: Column) -> Column:
    """Whether the log file of a checkpoint can still be read."""
    return F.when(count == 0, "no_binlogs").when(at.isNull() | (at == ""), "missing").when((at < first) | (at > last), "purged").otherwise("available")


def jitter(key: Column, window: int) -> Column:
    """A share of the window fixed by the key: the first 64 bits of its SHA-256, modulo the window."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(window).cast("decimal(20,0)")).cast("long")


def idempotency_key(table: Column, operation: Column, window: Column) -> Column:
    return F.sha2(F.concat_ws("|", table, operation, window), 256)


def retry_delay(base: Column, attempt: Column) -> Column:
    """base * 2 ** min(attempt - 1, 6)"""
    return base * F.pow(F.lit(2.0), F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(6))).cast("long")


def next_run(now: Column, interval: int, key: Column, inactive: int | None = None, active: Column | None = None) -> Column:
    """Now plus the interval plus a jitter of at most a tenth of it or an hour, in seconds."""
    def after(n: int) -> Column:
        return now + F.lit(n) + jitter(key, max(1, min(n // 10, HOUR)))

    return after(interval) if inactive is None else F.when(active, after(interval)).otherwise(after(inactive))


def activity_class(age_seconds: Column) -> Column:
    out = F.when(age_seconds.isNull(), "unknown")
    for name, limit in ACTIVITY:
        out = out.when(age_seconds <= limit, name)
    return out.otherwise("stale")


def metric_key(text: Column) -> Column:
    key = F.regexp_replace(F.lower(F.trim(text)), "[ -]", "_")
    return F.when(F.coalesce(key, F.lit("")) == "", "unknown").otherwise(key)


def compaction_due(small: Column, small_bytes: Column, equality: Column, position: Column) -> Column:
    return (small >= SMALL_FILES) | ((small >= SOME_SMALL_FILES) & (small_bytes >= SMALL_BYTES)) | (equality >= EQUALITY_DELETES) | (position >= POSITION_DELETES)


def compaction_route(deletes: Column, size: Column, files: Column) -> Column:
    """Why a rewrite is too large for one machine; null if it isn't."""
    return F.when(deletes > ROUTE_DELETES, "equality_deletes").when(size > ROUTE_BYTES, "bytes").when(files > ROUTE_FILES, "files")


def resource_profile(size: Column, files: Column, deletes: Column) -> Column:
    out = None
    for name, b, f, d in PROFILES:
        hit = (size > b) | (files > f) | (deletes > d)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("small")


def escalated_profile(profile: Column, heap_errors: Column, attempt: Column) -> Column:
    """After heap errors go up a step for each attempt before, one at least."""
    order = F.array(*map(F.lit, PROFILE_ORDER))
    up = F.when(heap_errors, F.greatest(attempt - 1, F.lit(1))).otherwise(F.lit(0))
    return F.element_at(order, F.least(F.array_position(order, profile).cast("int") + up.cast("int"), F.lit(len(PROFILE_ORDER))))


def table_state(snapshot_done: Column, scanning: Column, running: Column, error: Column, inventoried: Column, due: Column) -> Column:
    return F.when(~snapshot_done, "waiting_for_snapshot").when(scanning, "scanning").when(running, "running").when(error, "error").when(~inventoried, "inventory_pending").when(due, "ready").otherwise("healthy")


def queue_backlogged(queued: Column, oldest_age: Column, threshold: int, limit: int) -> Column:
    return (queued >= threshold) & (oldest_age >= limit)


def same_storage(path: Column, location: Column) -> Column:
    """Whether two urls have the same scheme and host."""
    part = lambda u, p: F.coalesce(F.try_parse_url(u, F.lit(p)), F.lit(""))
    return (part(path, "PROTOCOL") == part(location, "PROTOCOL")) & (part(path, "HOST") == part(location, "HOST"))


def partition_transform(kind: str, column: Column, n: int | None = None) -> Column:
    """identity, year, month, day, hour, truncate, bucket and void, as integers where the table format has them so."""
    match kind:
        case "identity":
            return column
        case "year":
            return F.year(column) - 1970
        case "month":
            return (F.year(column) - 1970) * 12 + F.month(column) - 1
        case "day":
            return F.unix_date(column.cast("date"))
        case "hour":
            return F.floor(F.unix_micros(column.cast("timestamp")) / 3_600_000_000).cast("int")
        case "truncate":
            return F.substring(column, 1, n)
        case "truncate_number":
            return column - F.pmod(column, F.lit(n))
        case "bucket":  # of whole numbers and dates; text has bytes that need a hash of their own
            return F.pmod(murmur3_long(column.cast("long")).bitwiseAND(F.lit(0x7FFFFFFF)), F.lit(n)).cast("int")
        case "bucket_date":
            return partition_transform("bucket", F.unix_date(column.cast("date")), n)
        case "void":
            return F.lit(None).cast("string")
    raise ValueError(f"unknown partition transform {kind}")


def murmur3_long(value: Column) -> Column:
    """32-bit Murmur3 with seed 0 of a long's eight bytes; Spark's own hash() has seed 42 only."""
    mask = 0xFFFFFFFF
    m32 = lambda c: c.bitwiseAND(F.lit(mask))

    def times(c: Column, k: int) -> Column:  # modulo 2^32, in two halves so that longs never overflow
        lo, hi = c.bitwiseAND(F.lit(0xFFFF)), F.shiftright(c, 16)
        return m32(lo * F.lit(k) + F.shiftleft(m32(hi * F.lit(k)).bitwiseAND(F.lit(0xFFFF)), 16))

    rot = lambda c, r: m32(F.shiftleft(c, r).bitwiseOR(F.shiftright(c, 32 - r)))
    h = F.lit(0).cast("long")
    for word in (m32(value), m32(F.shiftright(value, 32))):
        k = times(rot(times(word, 0xCC9E2D51), 15), 0x1B873593)
        h = m32(rot(h.bitwiseXOR(k), 13) * F.lit(5) + F.lit(0xE6546B64))
    h = h.bitwiseXOR(F.lit(8).cast("long"))
    h = times(h.bitwiseXOR(F.shiftright(h, 16)), 0x85EBCA6B)
    h = times(h.bitwiseXOR(F.shiftright(h, 13)), 0xC2B2AE35)
    return h.bitwiseXOR(F.shiftright(h, 16))


def parse_byte_size(text: str) -> int:
    """`128 MiB`, `1.5GB`, `7`: all units are powers of 1024; empty is 0."""
    text = text.strip()
    if not text:
        return 0
    m = re.fullmatch(r"([0-9]*\.?[0-9]+)\s*(b|kb|kib|k|mb|mib|m|gb|gib|g)?", text.lower())
    if not m:
        raise ValueError(f"not a size: {text!r}")
    return int(float(m[1]) * 1024 ** "bkmg".index((m[2] or "b")[0]))


def expand_environment(text: str) -> str:
    """`${NAME}` by the environment; unknown names stay."""
    return re.sub(r"\$\{(\w+)\}", lambda m: os.environ.get(m[1], m[0]), text)


def safe_column_names(names: list[str]) -> list[str]:
    """Names of letters, digits and underscores, at most 256 long, told apart without regard to case."""
    out, seen = [], set()
    for i, name in enumerate(names, 1):
        base = name if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name) else re.sub(r"[^A-Za-z0-9]+", "_", name).strip("_") or f"col_{i}"
        base, n = base[:256], 1
        new = base
        while new.lower() in seen:
            n += 1
            new = f"{base[: 256 - len(str(n)) - 1]}_{n}"
        seen.add(new.lower())
        out.append(new)
    return out


def quote_identifier(name: str, mark: str = "`") -> str:
    return mark + name.replace(mark, mark * 2) + mark


def quote_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"

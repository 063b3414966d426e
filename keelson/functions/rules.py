"""Scalar rules over object keys, ETags, manifest lines and call outcomes, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = "\x1f"
#: Bytes read on each side of a place where framing could be left.
WINDOW = 128
#: What marks framing that was not decoded.
CHUNK_SIGNATURE = r"[0-9a-fA-F]+;chunk-signature=[0-9a-fA-F]{64}[\r\n]"
TRAILER = "x-amz-checksum-(sha256|crc32|crc32c|sha1|crc64):"
#: Transport errors that speak against the node.
NODE_FAULTS = ("dial tcp", "connection refused", "connection reset", "broken pipe", "i/o timeout", "timeout", "EOF", "no such host", "transport")
LIST_KEYS = ("prefix", "delimiter", "encoding-type", "marker", "max-keys")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value evaluated once however often f names it; arrays in lambdas are not shared by the optimizer."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def is_normal_etag(etag: Column) -> Column:
    """Single-part: exactly 32 lower-case hex digits."""
    return etag.rlike(r"^[0-9a-f]{32}\z")


def trim_quotes(s: Column) -> Column:
    """Without one pair of surrounding quotes."""
    quoted = (F.length(s) >= 2) & s.startswith('"') & s.endswith('"')
    return F.when(quoted, F.substring(s, F.lit(2), F.length(s) - 2)).otherwise(s)


def whole_number(s: Column) -> Column:
    """A signed decimal number and nothing else, as BIGINT; null otherwise."""
    return F.when(s.rlike(r"^[+-]?[0-9]+\z"), s.try_cast("bigint"))


def is_blank(s: Column) -> Column:
    return s.rlike(r"(?U)^\s*\z")


def increasing(a: Column) -> Column:
    """Whether each element is greater than the one before it."""
    n = F.size(a)
    return F.forall(F.zip_with(F.slice(a, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(a, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda x, y: y > x), lambda ok: ok)


def offsets_of(texts: Column) -> Column:
    return F.transform(texts, whole_number)


def offset_etag(etag: Column, size: Column) -> Column:
    """Part offsets of `<md5>-<n>-<off0>|<off1>...`; null unless every rule holds."""

    def sound(parts: Column, offs: Column) -> Column:
        n = whole_number(F.get(parts, F.lit(1)))
        within = F.forall(offs, lambda x: x.isNotNull() & (x >= 0) & (x <= size))
        return (F.size(offs) == n) & (n >= 1) & within & (F.get(offs, F.lit(0)) == 0) & increasing(offs)

    def offsets(parts: Column) -> Column:
        return let(offsets_of(F.split(F.get(parts, F.lit(2)), r"\|")), lambda offs: F.when(sound(parts, offs), offs))

    return let(F.split(etag, "-", 3), lambda parts: F.when((F.size(parts) == 3) & is_normal_etag(F.get(parts, F.lit(0))), offsets(parts)))


def segment_offsets(size: Column, segment: int) -> Column:
    """0, segment, 2 * segment, ... below size; null for an empty object."""
    last = F.expr("cast(0 as bigint)") if segment <= 0 else F.floor((F.greatest(size, F.lit(1)) - 1) / segment).cast("bigint")
    return F.when((size > 0) & F.lit(segment > 0), F.transform(F.sequence(F.lit(0).cast("bigint"), last), lambda i: i * segment))


def resolve_offsets(etag: Column, size: Column, mode: str, segment: int = 0) -> Column:
    """Offsets by mode (off, offset, segment); null for single-part objects and where there are none."""
    found = {"off": F.lit(None).cast("array<bigint>"), "offset": offset_etag(etag, size), "segment": segment_offsets(size, segment)}[mode]
    return F.when(~is_normal_etag(etag), found)


def multipart_reason(line: Column, bucket: str) -> Column:
    """Why a line `bucket|key|count|offset...` is not well formed; null if it is."""

    def of_numbers(numbers: Column) -> Column:
        bad = F.filter(F.transform(numbers, lambda x: F.when(x.isNull(), F.lit("offset not an integer")).when(x < 0, F.lit("offset negative"))), lambda r: r.isNotNull())
        return F.coalesce(F.get(bad, F.lit(0)), F.when(F.get(numbers, F.lit(0)) != 0, "offset0 must be 0").when(~increasing(numbers), "offsets must be strictly increasing"))

    def of_parts(parts: Column) -> Column:
        part = lambda i: F.get(parts, F.lit(i))
        n = whole_number(part(2))
        texts = F.slice(parts, F.lit(4), F.greatest(F.size(parts) - 3, F.lit(0)))
        return (
            F.when(F.size(parts) < 3, "too few fields").when(part(0) != bucket, "bucket mismatch").when(is_blank(part(1)), "empty key").when(n.isNull(), "partcnt not an integer")
            .when(n < 1, "partcnt must be >= 1").when(F.size(parts) != n + 3, "offset count != partcnt").otherwise(let(offsets_of(texts), of_numbers))
        )

    return F.when(is_blank(line), "empty line").otherwise(let(F.split(line, r"\|"), of_parts))


def mixed_reason(line: Column, bucket: str) -> Column:
    """As multipart_reason, but two fields are a regular object."""
    parts = F.split(line, r"\|")
    two = F.when(is_blank(F.get(parts, F.lit(1))), F.lit("empty key"))
    return F.when(is_blank(line), "empty line").when(F.size(parts) < 2, "too few fields").when(F.get(parts, F.lit(0)) != bucket, "bucket mismatch").when(F.size(parts) == 2, two).otherwise(multipart_reason(line, bucket))


def line_offsets(line: Column) -> Column:
    parts = F.split(line, r"\|")
    return F.when(F.size(parts) > 3, offsets_of(F.slice(parts, F.lit(4), F.greatest(F.size(parts) - 3, F.lit(0)))))


def query_escape(s: Column) -> Column:
    """Form encoding in which only letters, digits and -_.~ stay as they are."""
    return F.replace(F.replace(F.url_encode(s), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def decoded_or_raw(s: Column) -> Column:
    return F.coalesce(F.try_url_decode(s), s)


def rfc3339(ts: Column) -> Column:
    """UTC to seconds; empty for no time. The session's time zone must be UTC."""
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))


def owner_dir(owner: Column) -> Column:
    """A safe directory name; _unknown for an empty, dotted or slashed owner."""
    unsafe = owner.isNull() | owner.isin("", ".", "..") | owner.contains("/") | owner.contains("\\")
    return F.when(unsafe, "_unknown").otherwise(owner)


def has_separator(key: Column) -> Column:
    return key.contains("|")


def tears_row(key: Column) -> Column:
    return key.rlike(r"[\x1f\n\r]")


def probe_plan(size: Column, is_multipart: Column, offsets: Column, threshold: int = 1024) -> Column:
    """Byte windows (start, length) to read: a small object whole; else head, each part border, tail."""
    spec = lambda start, length: F.struct(start.cast("bigint").alias("start"), length.cast("bigint").alias("length"))
    head, w = spec(F.lit(0), F.lit(WINDOW)), F.lit(WINDOW)
    tail = F.when(size > 0, F.array(spec(F.greatest(size - WINDOW, F.lit(0)), F.least(w, size)))).otherwise(F.array().cast("array<struct<start:bigint,length:bigint>>"))
    def border(off: Column) -> Column:
        start = F.greatest(off - WINDOW, F.lit(0))
        end = F.when(size > 0, F.least(off + WINDOW, size)).otherwise(off + WINDOW)
        return spec(start, end - start)

    none = F.array().cast("array<struct<start:bigint,length:bigint>>")
    known = F.coalesce(offsets, F.array().cast("array<bigint>"))
    borders = let(known, lambda offs: F.filter(F.transform(F.slice(offs, F.lit(2), F.greatest(F.size(offs) - 1, F.lit(0))), border), lambda p: p["length"] > 0))
    small = (size > 0) & (size <= threshold) if threshold > 0 else F.lit(False)
    return F.when(small, F.array(spec(F.lit(0), F.lit(threshold)))).otherwise(F.concat(F.array(head), F.when(is_multipart, borders).otherwise(none), tail))


def as_latin(body: Column) -> Column:
    """Bytes as characters one to one, so that patterns match bytes."""
    return F.decode(body, "ISO-8859-1")


def has_framing(body: Column) -> Column:
    """Whether a chunk signature or a checksum trailer is among the bytes."""
    return as_latin(body).rlike(CHUNK_SIGNATURE) | as_latin(body).rlike(TRAILER)


def head_state(http_code: Column, s3_code: Column, marker: Column) -> Column:
    """marker, not_marker, absent or unclassified from the answer to a HEAD of one version."""
    ok = (http_code >= 200) & (http_code < 300)
    return (
        F.when(ok & marker | (http_code == 405) & marker, "marker").when(ok, "not_marker")
        .when(s3_code.isin("NoSuchKey", "NoSuchVersion") | (http_code == 404), "absent").otherwise("unclassified")
    )


def delete_state(http_code: Column, s3_code: Column) -> Column:
    """A version that is gone already counts as deleted."""
    return F.when((http_code >= 200) & (http_code < 300) | s3_code.isin("NoSuchVersion", "NoSuchKey"), "deleted").otherwise("delete_failed")


def is_node_fault(http_code: Column, err: Column) -> Column:
    """By status if there is one (5xx but 501 and 505), else by the text of the transport error."""
    pattern = "|".join(x.replace("/", "\\/") for x in NODE_FAULTS)
    return F.when(http_code != 0, http_code.between(500, 599) & ~http_code.isin(501, 505)).otherwise(F.coalesce(err, F.lit("")).rlike(pattern))


def or_dash(s: Column) -> Column:
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("-"))


def is_list_request(method: Column, path: Column, query: Column) -> Column:
    """A bucket listing: GET, at most one inner slash, list-type=2 or only listing keys."""
    pairs = F.filter(F.split(query, "&"), lambda x: x != "")
    names = F.transform(pairs, lambda x: F.get(F.split(x, "=", 2), F.lit(0)))
    typed = F.get(F.filter(pairs, lambda x: F.get(F.split(x, "=", 2), F.lit(0)) == "list-type"), F.lit(0))
    inner = F.length(F.regexp_replace(F.trim(path, F.lit("/")), "[^/]", ""))
    listing = F.coalesce(typed == "list-type=2", F.lit(False)) | (F.size(names) > 0) & F.forall(names, lambda k: k.isin(*LIST_KEYS))
    return (method == "GET") & (inner <= 1) & listing


def with_slash(prefix: Column) -> Column:
    return F.when((prefix == "") | prefix.endswith("/"), prefix).otherwise(F.concat(prefix, F.lit("/")))


def human_bytes(n: Column) -> Column:
    unit = lambda by, name: F.concat(F.format_string("%.2f", F.bround(n / by, 2)), F.lit(name))
    return F.when(n >= 1 << 30, unit(1 << 30, "GiB")).when(n >= 1 << 20, unit(1 << 20, "MiB")).when(n >= 1 << 10, unit(1 << 10, "KiB")).otherwise(F.concat(n.cast("string"), F.lit("B")))


def mean_size(files: Column, total: Column) -> Column:
    return F.when(files <= 0, "N/A").otherwise(human_bytes(F.floor(total / F.greatest(files, F.lit(1)))))


def line_template(template: str, columns: dict[str, Column]) -> Column:
    """A result line from text with fields in angle brackets; a wrong template is an error at once."""
    import re

    if not template:
        raise ValueError("empty line template")
    parts, at = [], 0
    for m in re.finditer("<([^>]*)(>?)", template):
        if not m[2]:
            raise ValueError("field without end in line template")
        if m[1] not in columns:
            raise ValueError(f"unknown field {m[1]!r} in line template")
        parts += [F.lit(template[at : m.start()]), columns[m[1]]]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def offset_line(bucket: Column, key: Column, offsets: Column, plain: Column) -> Column:
    """bucket|key|count|offset...; the plain line where there are no offsets."""
    return F.when(F.coalesce(F.size(offsets), F.lit(0)) > 0, F.concat_ws("|", bucket, key, F.size(offsets).cast("string"), F.array_join(F.transform(offsets, lambda x: x.cast("string")), "|"))).otherwise(plain)


def verdict_result(verdict: Column, is_multipart: Column) -> Column:
    """The result set of a verdict (clean, corrupted, failed)."""
    return (
        F.when(verdict == "clean", F.when(is_multipart, "ok_mp").otherwise("ok_objects")).when(verdict == "corrupted", F.when(is_multipart, "corrupted_mp").otherwise("corrupted_objects"))
        .otherwise(F.when(is_multipart, "mp_check_failed").otherwise("check_failed"))
    )


def journal_fields(line: Column) -> Column:
    """kind, prefix and token of a journal line; null if it is malformed. A cursor's token follows the last pipe."""
    cursor = F.regexp_extract(line, r"(?s)^cursor\|(.*)\|([^|]*)\z", 1), F.regexp_extract(line, r"(?s)^cursor\|(.*)\|([^|]*)\z", 2)
    rest = F.substring(line, F.instr(line, "|") + 1, F.length(line))
    of = lambda kind, prefix, token: F.struct(F.lit(kind).alias("kind"), prefix.alias("prefix"), token.alias("token"))
    return (
        F.when(line.startswith("discovered|"), of("discovered", rest, F.lit(""))).when(line.startswith("done|"), of("done", rest, F.lit("")))
        .when(line.rlike(r"(?s)^cursor\|(.*)\|([^|]*)\z"), of("cursor", *cursor))
    )


def journal_line(kind: Column, prefix: Column, token: Column) -> Column:
    return F.when(kind == "cursor", F.concat_ws("|", kind, prefix, token)).otherwise(F.concat_ws("|", kind, prefix))


def repaired_marker(marker: Column, next_key: Column, tail_key: Column, tail_version: Column) -> Column:
    """The next version marker of a short page: a number is wrong there; 0 means no version, another number the tail's."""
    number = whole_number(marker)
    return F.when(number.isNull(), marker).when(number == 0, F.lit("null")).when(next_key == tail_key, tail_version).otherwise(marker)


def mismatch_reason(line_multipart: Column, head_etag: Column) -> Column:
    head = ~is_normal_etag(head_etag)
    return (
        F.when(~line_multipart & head, "the line is regular, the current ETag is multipart").when(line_multipart & ~head, "the line is multipart, the current ETag is a plain MD5")
        .otherwise("line and current ETag disagree on the object's type")
    )

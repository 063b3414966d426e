"""Checks of objects: probe verdicts, routing to result sets, joins with current state, copies, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.functions import rules as R
from keelson.sources.ranged import copy_objects, object_path

#: Result sets in the order of summaries.
RESULTS = ("ok_objects", "corrupted_objects", "check_failed", "ok_mp", "corrupted_mp", "mp_check_failed", "mp", "list_parse_failed", "list_failed", "invalid_keys", "parse_failed")
MIN_PART = 5 << 20


def tasks(inventory: DataFrame, mode: str = "off", segment: int = 0) -> DataFrame:
    """inventory (bucket, key, etag_raw, size, owner_id, body) with etag, is_multipart, offsets and owner_dir."""
    etag = R.trim_quotes(F.col("etag_raw"))
    rows = inventory.withColumn("etag", etag).withColumn("is_multipart", ~R.is_normal_etag(F.col("etag")))
    return rows.withColumns({"offsets": R.resolve_offsets(F.col("etag"), F.col("size"), mode, segment), "owner_dir": R.owner_dir(F.col("owner_id"))})


def probe_states(body: Column, probes: Column) -> Column:
    """A state for each window, in the windows' order: what it says of the bytes that the body has there."""
    n = F.octet_length(body)
    window = lambda p: F.substring(body, (p["start"] + 1).cast("int"), p["length"].cast("int"))
    asked = lambda p: F.least(p["length"], F.greatest(n - p["start"], F.lit(0)))
    return F.transform(probes, lambda p: F.when(F.octet_length(window(p)) != asked(p), "failed").when(R.has_framing(window(p)), "corrupted").otherwise("clean"))


def settled(states: Column) -> Column:
    """The first state that isn't clean decides."""
    return F.coalesce(F.get(F.filter(states, lambda s: s != "clean"), F.lit(0)), F.lit("clean"))


def verdicts(rows: DataFrame, threshold: int = 1024) -> DataFrame:
    """rows (from tasks) with verdict: windows and patterns are evaluated next to the body, so nothing is shuffled."""
    probes = R.probe_plan(F.col("size"), F.col("is_multipart"), F.col("offsets"), threshold)
    body = F.col("body").cast("binary")
    found = F.when(F.col("size") == 0, "clean").otherwise(settled(probe_states(body, probes)))
    return rows.withColumn("verdict", found)


def route(rows: DataFrame, mode: str = "off") -> DataFrame:
    """rows (from verdicts) with result: keys that break the line format, multipart without offsets, then the verdict."""
    unverified = F.col("is_multipart") & F.col("offsets").isNull()
    lost = F.lit("list_parse_failed" if mode == "offset" else "mp")
    return rows.withColumn("result", F.when(R.has_separator(F.col("key")), "invalid_keys").when(unverified, lost).otherwise(R.verdict_result(F.col("verdict"), F.col("is_multipart"))))


def check(inventory: DataFrame, mode: str = "off", segment: int = 0, threshold: int = 1024) -> DataFrame:
    """The whole check of a listing: bucket, key, owner_dir, is_multipart, result and line, a row for each object."""
    routed = route(verdicts(tasks(inventory, mode, segment), threshold), mode)
    plain = F.concat_ws("|", "bucket", "key")
    line = F.when(F.col("result").isin("corrupted_mp") & F.lit(mode == "offset"), R.offset_line(F.col("bucket"), F.col("key"), F.col("offsets"), plain)).otherwise(plain)
    return routed.select("bucket", "key", "owner_dir", "is_multipart", "size", "result", line.alias("line"))


def summary_counters() -> dict[str, Column]:
    """Counters over result and is_multipart. Keys with a separator aren't counted as listed."""
    is_ = lambda r: F.col("result") == r
    listed = ~is_("invalid_keys")
    each = {
        "list_all": listed, "list_obj": listed & ~F.col("is_multipart"), "list_mp": listed & F.col("is_multipart"), "ok_obj": is_("ok_objects"), "corrupt_obj": is_("corrupted_objects"), "ok_mp": is_("ok_mp"), "corrupt_mp": is_("corrupted_mp"),
        "list_failed": is_("list_failed"), "list_parse_failed": is_("list_parse_failed"), "check_failed": is_("check_failed"), "mp_check_failed": is_("mp_check_failed"), "invalid_keys": is_("invalid_keys")}
    return {n: F.count_if(c) for n, c in each.items()}


def summary(routed: DataFrame) -> DataFrame:
    """One row of the counters."""
    return routed.agg(*(c.alias(n) for n, c in summary_counters().items()))


def enabled(result: Column, is_check: bool = True, mode: str = "off", file_input: bool = False, check_file: bool = False, success_log: bool = False, multipart_success_log: bool = False, backup: bool = False) -> Column:
    """Whether a result set exists for a way of running."""
    multi = is_check and (mode != "off" or file_input)
    names = ["list_failed", "parse_failed", "invalid_keys"]
    names += ["corrupted_objects", "check_failed"] if is_check else []
    names += ["ok_objects"] if is_check and success_log else []
    names += ["corrupted_mp", "mp_check_failed"] if multi else []
    names += ["ok_mp"] if multi and multipart_success_log else []
    names += ["mp"] if is_check and (check_file or not file_input and mode == "off") else []
    names += ["list_parse_failed"] if is_check and mode == "offset" and not file_input else []
    names += ["backup_ok", "backup_failed", "mismatch"] if backup else []
    return result.isin(*names)


def head_joined(manifest: DataFrame, head: DataFrame) -> DataFrame:
    """manifest (key, is_multipart, ...) with the current etag and size; found tells whether the object is there."""
    return manifest.join(head.select("key", "etag", "size"), "key", "left").withColumn("found", F.col("etag").isNotNull())


def recheck(manifest: DataFrame, head: DataFrame, bodies: DataFrame, threshold: int = 1024) -> DataFrame:
    """Result of each manifest row: the current type wins; a missing object fails by its declared type."""
    joined = head_joined(manifest, head)
    now = ~R.is_normal_etag(F.col("etag"))
    drifted = joined.withColumns({"declared": F.col("is_multipart"), "is_multipart": F.when(F.col("found"), now).otherwise(F.col("is_multipart"))})
    drifted = drifted.withColumn("offsets", F.when(F.col("is_multipart") & F.col("declared"), F.col("offsets")))
    judged = verdicts(drifted.join(bodies.select("key", "body"), "key", "left").withColumns({"size": F.coalesce("size", F.lit(0)), "body": F.coalesce("body", F.lit(""))}), threshold)
    result = F.when(~F.col("found"), F.when(F.col("declared"), "mp_check_failed").otherwise("check_failed")).when(F.col("is_multipart") & F.col("offsets").isNull(), "mp").otherwise(R.verdict_result(F.col("verdict"), F.col("is_multipart")))
    return judged.withColumn("result", result)


def backup_plan(manifest: DataFrame, head: DataFrame, copies: DataFrame) -> DataFrame:
    """key, result and stage of a backup: no object, other type, no copy or another ETag of the copy."""
    joined = head_joined(manifest, head).join(copies.select("key", F.col("etag").alias("dst_etag")), "key", "left")
    other = F.col("is_multipart") != ~R.is_normal_etag(F.col("etag"))
    result = F.when(~F.col("found"), "backup_failed").when(other, "mismatch").when(F.col("dst_etag").isNull() | (F.col("dst_etag") != F.col("etag")), "backup_failed").otherwise("backup_ok")
    stage = F.when(~F.col("found"), "head").when(other, "").when(F.col("dst_etag").isNull(), "upload").when(F.col("dst_etag") != F.col("etag"), "etag").otherwise("")
    return joined.withColumns({"result": result, "stage": stage})


def backup(manifest: DataFrame, head: DataFrame, source: str, target: str) -> DataFrame:
    """backup_plan of manifest (key, is_multipart, offsets) after its objects have been copied from folder source to
    folder target: those that are there and whose type is the declared one."""
    joined = head_joined(manifest, head)
    todo = joined.where(F.col("found") & (F.col("is_multipart") == ~R.is_normal_etag(F.col("etag"))))
    copies = copy_objects(todo.select("key", object_path(source).alias("source"), object_path(target).alias("target"), F.when(F.col("is_multipart"), F.col("offsets")).alias("offsets"), "size"))
    return backup_plan(manifest, head, copies.select("key", F.col("dst_etag").alias("etag")))


def part_ranges(offsets: DataFrame) -> DataFrame:
    """key, part_no, start, length for rows (key, size, offsets): each part ends where the next starts."""
    parts = offsets.select("key", "size", "offsets", F.posexplode("offsets").alias("i", "start"))
    end = F.coalesce(F.get("offsets", F.col("i") + 1), F.col("size"))
    return parts.select("key", (F.col("i") + 1).alias("part_no"), "start", (end - F.col("start")).alias("length"))


def copyable(ranges: DataFrame) -> DataFrame:
    """key and copyable: every part has bytes, and all but the last have the least that a server takes."""
    last = F.col("part_no") == F.max("part_no").over(Window.partitionBy("key"))
    return ranges.withColumn("_ok", (F.col("length") > 0) & (last | (F.col("length") >= MIN_PART))).groupBy("key").agg(F.bool_and("_ok").alias("copyable"))


def composite_etag(parts: DataFrame) -> DataFrame:
    """key and etag: md5 of the parts' binary md5s in order, then the number of parts."""
    joined = parts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("part_no", "part_md5"))).alias("p"))
    return joined.select("key", F.concat(F.md5(F.unhex(F.array_join(F.transform("p", lambda x: x["part_md5"]), ""))), F.lit("-"), F.size("p").cast("string")).alias("etag"))

"""Queries over listings, versions and the prefix tree."""

from pyspark.sql import functions as F

from keelson.functions import rules as R
from keelson.operators import commits as C
from keelson.operators import versions as V_
from keelson.plans.registry import query
from keelson.sources import listing as L
from keelson.sources import ranged
from keelson.sources import store
from keelson.sources import synth as S
from keelson.sources.shared import new_folder

UP = "unnest(list_prepend('', list_transform(range(1, len(string_split(key, '/'))), lambda i: array_to_string(string_split(key, '/')[1:i], '/') || '/')))"


@query("s1_flat_listing", "SELECT key, size FROM f1_inventory WHERE starts_with(key, 'src1/')")
def s1(v):
    return L.flat(v("f1_inventory"), "src1/").select("key", "size")


@query("s2_one_level", """SELECT 'object' AS kind, key AS entry FROM f1_inventory WHERE starts_with(key, 'src1/') AND instr(substr(key, 6), '/') = 0
UNION ALL SELECT DISTINCT 'prefix', substr(key, 1, 5 + instr(substr(key, 6), '/')) FROM f1_inventory WHERE starts_with(key, 'src1/') AND instr(substr(key, 6), '/') > 0""")
def s2(v):
    return L.one_level(v("f1_inventory"), "src1/")


@query("s3_prefix_tree", f"SELECT DISTINCT prefix FROM (SELECT {UP} AS prefix FROM f1_inventory)")
def s3(v):
    return L.prefixes(v("f1_inventory"))


@query("s4_recursive_walk", "SELECT 'object' AS kind, key AS entry FROM f1_inventory WHERE NOT starts_with(key, 'src3/') AND NOT starts_with(key, 'src5/en/') UNION ALL SELECT 'list_failed', 'src3/' UNION ALL SELECT 'list_failed', 'src5/en/'")
def s4(v):
    inv = v("f1_inventory")
    failed = v.spark.createDataFrame([("src3/",), ("src5/en/",)], "prefix string")
    reached, lost = L.walk(inv, failed)
    return reached.select(F.lit("object").alias("kind"), F.col("key").alias("entry")).unionByName(lost.select(F.lit("list_failed").alias("kind"), F.col("prefix").alias("entry")))


@query("s5_two_phase", "SELECT key, size FROM f1_inventory WHERE CASE WHEN instr(key, '/') = 0 THEN key ELSE substr(key, 1, instr(key, '/')) END > 'src12/'")
def s5(v):
    return L.two_phase(v("f1_inventory"), "src12/").select("key", "size")


@query("s3_stored_tree", f"SELECT 'object' AS kind, key AS entry, CAST(size AS BIGINT) AS size FROM f1_inventory UNION ALL SELECT 'prefix', prefix, NULL FROM (SELECT DISTINCT {UP} AS prefix FROM f1_inventory) WHERE prefix <> ''")
def s3_stored(v):
    """The bodies stored as objects, and the store listed level by level: a round lists all prefixes of its level in tasks."""
    folder = new_folder(v.spark, "bucket")
    ranged.store_objects(v("f1_inventory").select("key", "body"), folder)
    return store.listed(v.spark, folder).select("kind", "entry", "size")


@query("s6_count_only", "SELECT count(*) AS bfs, count(*) AS walk, count(*) FILTER (WHERE key <> '' AND NOT ends_with(key, '/')) AS iter, count(*) FILTER (WHERE key <> '' AND NOT ends_with(key, '/')) AS sub FROM f1_inventory")
def s6(v):
    """Level by level, by a walk, by one flat listing, and by root objects and sub-prefixes: each counts its own rows."""
    inv = v("f1_inventory")
    total = lambda df, name: df.agg(F.count("*").alias("n")).withColumn("how", F.lit(name))
    dirs = L.prefixes(inv)
    parent = F.element_at(L.ancestors(F.col("key")), -1).alias("prefix")
    ways = [total(inv.select("key", parent).join(dirs, "prefix"), "bfs"), total(L.walk(inv)[0], "walk"), total(L.countable(L.flat(inv, "")), "iter"), total(L.countable(L.two_phase(inv)), "sub")]
    every = ways[0].unionByName(ways[1]).unionByName(ways[2]).unionByName(ways[3])
    return every.agg(*(F.max(F.when(F.col("how") == h, F.col("n"))).alias(h) for h in ("bfs", "walk", "iter", "sub")))


@query("s7_walk_totals", f"SELECT count(*) AS files, CAST(sum(CASE WHEN size > 0 THEN size ELSE 0 END) AS BIGINT) AS bytes, (SELECT count(DISTINCT prefix) FROM (SELECT {UP} AS prefix FROM f1_inventory)) AS dirs FROM f1_inventory")
def s7(v):
    return L.usage(v("f1_inventory")).where("prefix = ''").select("files", "bytes", "dirs")


@query("s8_version_listing", "SELECT key, version_id, is_delete_marker, strftime(last_modified, '%Y-%m-%dT%H:%M:%SZ') AS last_modified FROM f3_versions WHERE starts_with(key, 'c1/')")
def s8(v):
    return L.flat(v("f3_versions"), "c1/").select("key", "version_id", "is_delete_marker", R.rfc3339(F.col("last_modified").cast("timestamp")).alias("last_modified"))


@query("s9_version_entries", "SELECT key, version_id FROM f3_versions WHERE starts_with(key, 'c1/') OR starts_with(key, 'c3/k_1')")
def s9(v):
    entries = v.spark.createDataFrame([("c1/",), ("c1/k_1",), ("c3/k_1",)], "prefix string")
    return L.under_entries(v("f3_versions"), entries).select("key", "version_id")


@query("s16_head_lookup", "SELECT d.key, h.etag, h.size, h.etag IS NOT NULL AS found FROM f7_declared d LEFT JOIN f7_head h ON d.key = h.key")
def s16(v):
    return v("f7_declared").select("key").join(v("f7_head"), "key", "left").select("key", "etag", "size", F.col("etag").isNotNull().alias("found"))


@query("s17_head_version", """SELECT a.key, a.version_id, CASE WHEN b.m IS NULL THEN 404 WHEN b.m THEN 405 ELSE 200 END AS http_code FROM (SELECT DISTINCT bucket, key, version_id FROM f3_versions) a
LEFT JOIN (SELECT bucket, key, version_id, bool_or(is_delete_marker) AS m FROM f3_versions WHERE o_orderkey % 5 <> 0 GROUP BY ALL) b ON a.bucket = b.bucket AND a.key = b.key AND a.version_id = b.version_id""")
def s17(v):
    versions = v("f3_versions")
    at = V_.states(versions.select(*V_.KEY).distinct(), versions.where("o_orderkey % 5 <> 0"))
    return at.select("key", "version_id", F.when(F.col("state") == "absent", 404).when(F.col("state") == "marker", 405).otherwise(200).alias("http_code"))


TREE = """tree AS (SELECT tree, rtrim_root AS root, depth, width, files, layer, slot, f FROM (SELECT tree, CASE WHEN ends_with(prefix, '/') THEN substr(prefix, 1, length(prefix) - 1) ELSE prefix END AS rtrim_root, depth, width, files, unnest(range(1, depth + 1)) AS layer FROM f8_trees) a,
  LATERAL (SELECT unnest(range(0, width + CASE WHEN a.layer = a.depth THEN 1 ELSE 0 END)) AS slot) b, LATERAL (SELECT unnest(range(1, files + 1)) AS f) c),
keys AS (SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY layer, slot, f) - 1 AS idx, CASE WHEN root = '' THEN '' ELSE root || '/' END || array_to_string(list_transform(range(1, layer + 1), lambda i: 'l' || i), '/')
  || CASE WHEN slot > 0 THEN '/d' || slot ELSE '' END || '/file_' || lpad(CAST(f AS VARCHAR), CAST(greatest(length(CAST(files AS VARCHAR)), length(CAST(f AS VARCHAR))) AS INTEGER), '0') AS key FROM tree),
sized AS (SELECT tree, idx, key, 1 + CAST('0x' || substr(md5(key || ':' || idx), 1, 15) AS BIGINT) % 4000 AS size, 100 + CAST('0x' || substr(md5('part:' || key), 1, 15) AS BIGINT) % 901 AS part_size FROM keys)"""


def sized_keys(v):
    keys = S.tree_keys(v("f8_trees"))
    return keys.withColumns({"size": S.draw(F.concat("key", F.lit(":"), F.col("idx").cast("string")), 1, 4000), "part_size": S.draw(F.concat(F.lit("part:"), "key"), 100, 1000)})


@query("s18_fan_chain", f", {TREE} SELECT tree, idx, key FROM keys")
def s18(v):
    return S.tree_keys(v("f8_trees")).select("tree", "idx", "key")


@query("s19_random_sizes", f", {TREE} SELECT tree, idx, size, part_size FROM sized")
def s19(v):
    return sized_keys(v).select("tree", "idx", "size", "part_size")


BODY = "substr(array_to_string(list_transform(range(0, CAST(ceil(size / 32.0) AS BIGINT)), lambda i: md5(key || ':' || i)), ''), 1, CAST(size AS INTEGER))"


@query("s20_bodies", f", {TREE} SELECT tree, idx, CAST(strlen({BODY}) AS BIGINT) AS n, md5({BODY}) AS body_md5 FROM sized")
def s20(v):
    return bodies(sized_keys(v))


@query("s20_bodies_whole")
def s20_whole(v):
    return bodies(sized_keys(v))


def bodies(keys):
    stored = keys.select("tree", "idx", S.body(F.col("key"), F.col("size")).alias("body"))
    return stored.select("tree", "idx", F.octet_length("body").cast("bigint").alias("n"), F.md5(F.col("body").cast("binary")).alias("body_md5"))


@query("p27_trailing_slash", "SELECT DISTINCT prefix, CASE WHEN prefix = '' OR ends_with(prefix, '/') THEN prefix ELSE prefix || '/' END AS dir FROM f8_trees")
def p27(v):
    return v("f8_trees").select("prefix", R.with_slash(F.col("prefix")).alias("dir")).distinct()


HUMAN = "CASE WHEN {0} >= 1073741824 THEN printf('%.2f', {0} / 1073741824.0) || 'GiB' WHEN {0} >= 1048576 THEN printf('%.2f', {0} / 1048576.0) || 'MiB' WHEN {0} >= 1024 THEN printf('%.2f', {0} / 1024.0) || 'KiB' ELSE CAST({0} AS VARCHAR) || 'B' END"


@query("p28_human_sizes", f"SELECT owner_id, {HUMAN.format('s')} AS total, {HUMAN.format('(s // n)')} AS mean FROM (SELECT owner_id, CAST(sum(size) AS BIGINT) AS s, count(*) AS n FROM f1_inventory GROUP BY owner_id)")
def p28(v):
    each = v("f1_inventory").groupBy("owner_id").agg(F.sum("size").alias("s"), F.count("*").alias("n"))
    return each.select("owner_id", R.human_bytes(F.col("s")).alias("total"), R.mean_size(F.col("n"), F.col("s")).alias("mean"))


@query("p29_round_robin", f", {TREE} SELECT tree, idx, idx % 7 AS node FROM keys")
def p29(v):
    return S.tree_keys(v("f8_trees")).select("tree", "idx", F.pmod("idx", F.lit(7)).alias("node"))


@query("p30_padded_numbers", f", {TREE} SELECT tree, max(length(key)) AS longest, count(DISTINCT regexp_extract(key, 'file_([0-9]+)$', 1)) AS numbers FROM keys GROUP BY tree")
def p30(v):
    keys = S.tree_keys(v("f8_trees"))
    return keys.groupBy("tree").agg(F.max(F.length("key").cast("bigint")).alias("longest"), F.count_distinct(F.regexp_extract("key", "file_([0-9]+)$", 1)).alias("numbers"))


@query("p31_upload_class", f", {TREE} SELECT tree, idx, CASE WHEN size > part_size THEN 'multipart' ELSE 'single' END AS class, CASE WHEN size > part_size THEN (size + part_size - 1) // part_size ELSE 1 END AS parts FROM sized")
def p31(v):
    return sized_keys(v).select("tree", "idx", S.upload_class(F.col("size"), F.col("part_size")).alias("class"), S.part_count(F.col("size"), F.col("part_size")).alias("parts"))


@query("p32_expected_total", f", {TREE} SELECT tree, count(*) AS total FROM keys GROUP BY tree")
def p32(v):
    return v("f8_trees").select("tree", S.total_objects(F.col("depth"), F.col("width"), F.col("files")).alias("total"))


@query("a10_generator_totals", f", {TREE} SELECT count(*) AS uploaded, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (WHERE size <= part_size) AS single, count(*) FILTER (WHERE size > part_size) AS multipart FROM sized")
def a10(v):
    return sized_keys(v).agg(F.count("*").alias("uploaded"), F.sum("size").alias("bytes"), F.count_if(F.col("size") <= F.col("part_size")).alias("single"), F.count_if(F.col("size") > F.col("part_size")).alias("multipart"))


@query("a15_body_md5", "SELECT key, md5(body) AS md5 FROM f1_inventory")
def a15(v):
    return v("f1_inventory").select("key", F.md5(F.col("body").cast("binary")).alias("md5"))


@query("c8_synthetic_bucket", f", {TREE} SELECT 'bkt' || tree || '|' || key || '|' || md5({BODY}) AS line FROM sized")
def c8(v):
    return manifest_lines(sized_keys(v))


@query("c8_synthetic_bucket_whole")
def c8_whole(v):
    return manifest_lines(sized_keys(v))


def manifest_lines(keys):
    body = S.body(F.col("key"), F.col("size"))
    return keys.select(F.concat_ws("|", F.concat(F.lit("bkt"), F.col("tree").cast("string")), "key", F.md5(body.cast("binary"))).alias("line"))


@query("l1_prefix_filter", "SELECT key FROM f1_inventory WHERE starts_with(key, 'src2/en/')")
def l1(v):
    return L.flat(v("f1_inventory"), "src2/en/").select("key")


@query("l2_seek_filter", "SELECT key FROM f1_inventory WHERE starts_with(key, 'src2/') AND key > 'src2/en/doc_5'")
def l2(v):
    return L.flat(v("f1_inventory"), "src2/", "src2/en/doc_5").select("key")


@query("l3_page_limit", "SELECT entry FROM (SELECT DISTINCT substr(key, 1, instr(key, '/')) AS entry FROM f1_inventory) ORDER BY entry LIMIT 7")
def l3(v):
    return L.one_level(v("f1_inventory")).select("entry").orderBy("entry").limit(7)


@query("l4_delete_marker_filter", "SELECT key, version_id FROM f3_versions WHERE is_delete_marker")
def l4(v):
    return v("f3_versions").where("is_delete_marker").select("key", "version_id")


@query("j10_resume_range", "SELECT key FROM f1_inventory WHERE starts_with(key, 'src1/') AND key > 'src1/en/doc_3' OR starts_with(key, 'src4/') AND key > ''")
def j10(v):
    inv = v("f1_inventory")
    entries = v.spark.createDataFrame([("src1/", "src1/en/doc_3"), ("src4/", ""), ("src4/en/", "")], "prefix string, token string")
    return L.resumed(inv, entries).select("key")


@query("a9_usage_by_prefix", f"""SELECT f.prefix, files, dirs, bytes FROM (SELECT prefix, count(*) AS files, CAST(sum(greatest(size, 0)) AS BIGINT) AS bytes FROM (SELECT {UP} AS prefix, size FROM f1_inventory) GROUP BY prefix) f
JOIN (SELECT prefix, count(*) AS dirs FROM (SELECT {UP} AS prefix, key FROM (SELECT DISTINCT prefix AS key FROM (SELECT {UP} AS prefix FROM f1_inventory))) GROUP BY prefix) d ON f.prefix = d.prefix""")
def a9(v):
    return L.usage(v("f1_inventory"))


SIZED = "(SELECT key, CAST(o_orderkey % 1000 AS BIGINT) AS size FROM f3_versions)"


@query("a9_usage_of_versions", f"""SELECT f.prefix, files, dirs, bytes FROM (SELECT prefix, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT {UP} AS prefix, size FROM {SIZED}) GROUP BY prefix) f
JOIN (SELECT prefix, count(*) AS dirs FROM (SELECT {UP} AS prefix, key FROM (SELECT DISTINCT prefix AS key FROM (SELECT {UP} AS prefix FROM {SIZED}))) GROUP BY prefix) d ON f.prefix = d.prefix""")
def a9_versions(v):
    """The same totals over the version listing."""
    return L.usage(v("f3_versions").select("key", (F.col("o_orderkey") % 1000).cast("bigint").alias("size")))


@query("w8_pagination", """, e AS (SELECT substr(key, 1, instr(key, '/')) AS prefix, key AS entry FROM f1_inventory), n AS (SELECT prefix, entry, (row_number() OVER (PARTITION BY prefix ORDER BY entry) - 1) // 10 + 1 AS page FROM e)
SELECT prefix, page, count(*) AS entries, min(entry) AS first, max(entry) AS next_marker, page < max(page) OVER (PARTITION BY prefix) AS truncated FROM n GROUP BY prefix, page""")
def w8(v):
    return L.pages(v("f1_inventory").select(F.substring("key", F.lit(1), F.instr("key", "/")).alias("prefix"), F.col("key").alias("entry")), 10)


ORDER = "row_number() OVER (PARTITION BY bucket, key ORDER BY last_modified DESC, version_id)"


@query("w9_version_resume", f""", r AS (SELECT *, {ORDER} AS rn FROM f3_versions), m AS (SELECT key, version_id FROM r WHERE rn = 2 ORDER BY key LIMIT 1)
SELECT r.key, r.version_id FROM r, m WHERE r.key > m.key OR r.key = m.key AND r.rn > 2""")
def w9(v):
    versions = v("f3_versions")
    # the marker: the second version of the first key that has two
    rn = F.row_number().over(L.version_order(versions))
    marker = versions.withColumn("_rn", rn).where("_rn = 2").orderBy("key").select("key", "version_id").first()
    return L.versions_after(versions, *(marker or ("", ""))).select("key", "version_id")


PAGES = ", pg AS (SELECT *, substr(key, 1, instr(key, '/') - 1) AS prefix, (row_number() OVER (PARTITION BY bucket, substr(key, 1, instr(key, '/') - 1) ORDER BY key, last_modified DESC, version_id) - 1) // 20 + 1 AS page FROM f3_versions), tails AS (SELECT prefix, page, count(*) AS entries, max(key) AS tail_key, arg_max(version_id, {'k': key, 't': -epoch_us(last_modified), 'v': version_id}) AS tail_version FROM pg GROUP BY prefix, page)"


@query("w10_short_pages", PAGES + ", live AS (SELECT prefix, page, count(*) FILTER (WHERE NOT is_delete_marker) AS entries FROM pg GROUP BY ALL) SELECT prefix, page, entries, page < max(page) OVER (PARTITION BY prefix) AS truncated, page < max(page) OVER (PARTITION BY prefix) AND entries < 20 AS short FROM live")
def w10(v):
    """Pages of 20 versions from which delete markers are hidden: pages that had some come back short."""
    paged = V_.paged(v("f3_versions"), 20)
    live = paged.groupBy("prefix", "page").agg(F.count_if(~F.col("is_delete_marker")).alias("entries"))
    return V_.short_pages(live, 20).select("prefix", "page", "entries", "truncated", "short")


@query("a11_page_tail", PAGES + " SELECT prefix, page, tail_key, tail_version FROM tails")
def a11(v):
    return V_.page_tails(V_.paged(v("f3_versions"), 20)).select("prefix", "page", "tail_key", "tail_version")


@query("p35_marker_repair", PAGES + """, raw AS (SELECT *, CASE page % 4 WHEN 0 THEN '0' WHEN 1 THEN '17' WHEN 2 THEN tail_version ELSE 'null' END AS marker, CASE WHEN page % 8 = 1 THEN tail_key ELSE 'elsewhere' END AS next_key FROM tails)
SELECT prefix, page, marker, CASE WHEN NOT regexp_full_match(marker, '[+-]?[0-9]+') THEN marker WHEN CAST(marker AS BIGINT) = 0 THEN 'null' WHEN next_key = tail_key THEN tail_version ELSE marker END AS repaired FROM raw""")
def p35(v):
    tails = V_.page_tails(V_.paged(v("f3_versions"), 20))
    raw = tails.withColumns({"marker": F.expr("CASE page % 4 WHEN 0 THEN '0' WHEN 1 THEN '17' WHEN 2 THEN tail_version ELSE 'null' END"), "next_key": F.expr("CASE WHEN page % 8 = 1 THEN tail_key ELSE 'elsewhere' END")})
    return raw.select("prefix", "page", "marker", R.repaired_marker(F.col("marker"), F.col("next_key"), F.col("tail_key"), F.col("tail_version")).alias("repaired"))


@query("p20_decoded_prefixes", "SELECT p, CASE WHEN regexp_matches(p, '%([^0-9A-Fa-f]|[0-9A-Fa-f][^0-9A-Fa-f]|.?$)') THEN p ELSE url_decode(replace(p, '+', ' ')) END AS decoded FROM (SELECT DISTINCT CASE o_custkey % 3 WHEN 0 THEN 'a%2Fb+c/' || o_custkey WHEN 1 THEN 'bad%zz/' || o_custkey ELSE 'plain/' || o_custkey END AS p FROM orders)")
def p20(v):
    p = F.expr("CASE o_custkey % 3 WHEN 0 THEN concat('a%2Fb+c/', o_custkey) WHEN 1 THEN concat('bad%zz/', o_custkey) ELSE concat('plain/', o_custkey) END")
    rows = v.spark.read.parquet(f"{v.sf_dir}/orders.parquet").select(p.alias("p")).distinct()
    return rows.select("p", R.decoded_or_raw(F.col("p")).alias("decoded"))


@query("p19_query_escape", "SELECT key, replace(replace(replace(replace(url_encode(key), '%20', '+'), '%7E', '~'), '*', '%2A'), '%2D', '-') AS escaped FROM (SELECT DISTINCT key || '~*a b' AS key FROM f3_versions)")
def p19(v):
    rows = v("f3_versions").select(F.concat("key", F.lit("~*a b")).alias("key")).distinct()
    return rows.select("key", R.query_escape(F.col("key")).alias("escaped"))


@query("p21_rfc3339", "SELECT version_id, key, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE strftime(last_modified, '%Y-%m-%dT%H:%M:%SZ') END AS at FROM f3_versions")
def p21(v):
    ts = F.when(F.col("o_orderkey") % 13 != 0, F.col("last_modified").cast("timestamp"))
    return v("f3_versions").select("version_id", "key", R.rfc3339(ts).alias("at"))


@query("t1_listing_order", "SELECT key, version_id, row_number() OVER (ORDER BY key, last_modified DESC, version_id) AS n FROM f3_versions")
def t1(v):
    """The place of every version in the whole listing: keys ascending, of a key the newest first."""
    at = L.ordered(v("f3_versions"), [F.col("key"), F.col("last_modified").desc(), F.col("version_id")])
    return at.select("key", "version_id", F.col("row_no").alias("n"))


@query("t3_next_page", "SELECT key, size FROM f1_inventory WHERE key > 'src12/' ORDER BY key LIMIT 25")
def t3(v):
    return L.first_page(v("f1_inventory"), "src12/", 25)


@query("u5_strategies_agree", """, flat AS (SELECT key, size, count(*) AS n FROM f1_inventory GROUP BY ALL), phased AS (SELECT key, size, count(*) AS n FROM (SELECT key, size FROM f1_inventory WHERE instr(key, '/') = 0 AND key > '' UNION ALL SELECT key, size FROM f1_inventory WHERE instr(key, '/') > 0 AND substr(key, 1, instr(key, '/')) > '') GROUP BY ALL)
SELECT CAST(sum(greatest(coalesce(p.n, 0) - coalesce(f.n, 0), 0)) AS BIGINT) AS only_walk, CAST(sum(greatest(coalesce(f.n, 0) - coalesce(p.n, 0), 0)) AS BIGINT) AS only_flat, CAST(sum(least(coalesce(p.n, 0), coalesce(f.n, 0))) AS BIGINT) AS both
FROM flat f FULL JOIN phased p ON f.key = p.key AND f.size = p.size""")
def u5(v):
    inv = v("f1_inventory")
    flat, phased = L.flat(inv, "").select("key", "size"), L.two_phase(inv).select("key", "size")
    marked = flat.withColumn("s", F.lit(1)).unionByName(phased.withColumn("s", F.lit(2))).groupBy("key", "size").agg(F.count_if(F.col("s") == 1).alias("a"), F.count_if(F.col("s") == 2).alias("b"))
    return marked.agg(F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("only_walk"), F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("only_flat"), F.sum(F.least("a", "b")).alias("both"))


@query("k9_delete_marker_rows", """SELECT CASE WHEN contains(key, chr(31)) THEN 'invalid_keys' ELSE 'delete_markers' END AS result,
  concat_ws(chr(31), bucket, CASE WHEN contains(key, chr(31)) THEN replace(url_encode(key), '%20', '+') ELSE key END, version_id, strftime(last_modified, '%Y-%m-%dT%H:%M:%SZ')) AS line FROM f3_versions WHERE is_delete_marker""")
def k9(v):
    return V_.delete_marker_rows(v("f3_versions"))


COUNTERS = "count(*) AS scanned, count(*) FILTER (WHERE is_delete_marker AND NOT contains(key, chr(31))) AS delete_markers, count(*) FILTER (WHERE is_delete_marker AND contains(key, chr(31))) AS invalid_keys"


@query("a5_scan_counters", f"SELECT {COUNTERS} FROM f3_versions")
def a5(v):
    return V_.scan_counters(v("f3_versions"))


@query("a5_written_counters", f"SELECT {COUNTERS} FROM f3_versions")
def a5_written(v):
    """The same counters, taken by the job that writes the delete markers of the scan and kept with them."""
    path = new_folder(v.spark, "markers")
    V_.write_scan(v("f3_versions"), path)
    found = C.counters(path)
    return v.spark.createDataFrame([(found["scanned"], found["delete_markers"], found["invalid_keys"])], "scanned bigint, delete_markers bigint, invalid_keys bigint")


@query("a16_invalid_key_alarm", f"SELECT invalid_keys, invalid_keys > 0 AS alarm FROM (SELECT {COUNTERS} FROM f3_versions)")
def a16(v):
    return V_.scan_counters(v("f3_versions")).select("invalid_keys", (F.col("invalid_keys") > 0).alias("alarm"))


NOW = "now AS (SELECT bucket, key, version_id, bool_or(is_delete_marker) AS m FROM f3_versions WHERE o_orderkey % 5 <> 0 GROUP BY ALL), st AS (SELECT a.bucket, a.key, a.version_id, CASE WHEN m IS NULL THEN 'absent' WHEN m THEN 'marker' ELSE 'not_marker' END AS state FROM (SELECT DISTINCT bucket, key, version_id FROM f3_versions) a LEFT JOIN now USING (bucket, key, version_id))"


def listed_states(v):
    versions = v("f3_versions")
    return V_.states(versions.select(*V_.KEY).distinct(), versions.where("o_orderkey % 5 <> 0"))


@query("j5_version_states", f", {NOW} SELECT key, version_id, state FROM st")
def j5(v):
    return listed_states(v).select("key", "version_id", "state")


@query("a6_cleanup_counters", f", {NOW} SELECT count(*) FILTER (WHERE state = 'marker') AS marker, count(*) FILTER (WHERE state = 'not_marker') AS not_marker, count(*) FILTER (WHERE state = 'absent') AS absent FROM st")
def a6(v):
    return listed_states(v).agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("marker", "not_marker", "absent")))


@query("j6_apply_deletions", "SELECT key, version_id, o_orderkey FROM f3_versions a WHERE NOT EXISTS (SELECT 1 FROM f3_versions b WHERE b.is_delete_marker AND a.bucket = b.bucket AND a.key = b.key AND a.version_id = b.version_id)")
def j6(v):
    versions = v("f3_versions")
    once = V_.deleted(versions, versions.where("is_delete_marker"))
    return once.select("key", "version_id", "o_orderkey")


@query("k11_check_results", f", {NOW} SELECT concat_ws(chr(31), bucket, key, version_id, '', state) AS line FROM st WHERE NOT contains(key, chr(31))")
def k11(v):
    return listed_states(v).where(~R.tears_row(F.col("key"))).select(F.concat_ws(R.SEP, "bucket", "key", "version_id", F.lit(""), "state").alias("line"))


@query("c6_delete_marker_list", f"SELECT {COUNTERS} FROM f3_versions WHERE starts_with(key, 'c2/')")
def c6(v):
    return V_.scan_counters(L.flat(v("f3_versions"), "c2/"))


@query("c7_delete_and_recheck", """, m AS (SELECT DISTINCT bucket, key, version_id FROM f3_versions WHERE is_delete_marker),
left_over AS (SELECT v.bucket, v.key, v.version_id, bool_or(v.is_delete_marker) AS marker FROM f3_versions v WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.bucket = v.bucket AND m.key = v.key AND m.version_id = v.version_id) GROUP BY ALL)
SELECT m.bucket, m.key, m.version_id, CASE WHEN l.marker IS NULL THEN 'absent' WHEN l.marker THEN 'marker' ELSE 'not_marker' END AS state FROM m LEFT JOIN left_over l ON l.bucket = m.bucket AND l.key = m.key AND l.version_id = m.version_id""")
def c7(v):
    versions = v("f3_versions")
    markers = versions.where("is_delete_marker").select(*V_.KEY).distinct()
    return V_.states(markers, V_.deleted(versions, markers))


@query("c9_usage_report", f"SELECT prefix, files, {HUMAN.format('bytes')} AS total, {HUMAN.format('(bytes // files)')} AS mean FROM (SELECT prefix, count(*) AS files, CAST(sum(greatest(size, 0)) AS BIGINT) AS bytes FROM (SELECT {UP} AS prefix, size FROM f1_inventory) GROUP BY prefix)")
def c9(v):
    return L.usage(v("f1_inventory")).select("prefix", "files", R.human_bytes(F.col("bytes")).alias("total"), R.mean_size(F.col("files"), F.col("bytes")).alias("mean"))

"""Registry of the storage-analytics queries and their SQL oracles.

Every query is named by the operators it covers and bound to the tables of
:mod:`shelfmark.sources.bindings`; its oracle is the same question in DuckDB SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import paths
from shelfmark.operators import catalog as C
from shelfmark.operators import duplicates as D
from shelfmark.operators import trees as T
from shelfmark.plans import kb_queries, more_queries
from shelfmark.plans.registry import ORACLES, QUERIES, query
from shelfmark.sources import bindings as B
from shelfmark.sources import shared

FLAGSHIP = "a8_recursive_rollup"
N = B.AS_OF
ANC = "CAST(list_transform(range(len(parts), 0, -1), lambda i: '/' || array_to_string(parts[1:i], '/')) AS VARCHAR[])"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return B.doc_files(spark, sf)


def _up(source: str, columns: str) -> str:
    """SQL: rows of ``source`` (with folder_path) once for each ancestor path."""
    return f"SELECT unnest({ANC}) AS path, {columns} FROM (SELECT *, string_split(ltrim(folder_path, '/'), '/') AS parts FROM {source})"


Q = Callable[[SparkSession, str], DataFrame]


def _tree(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals and totals of the hierarchy's folders."""
    direct = B.hier_files(spark, sf).groupBy(F.col("folder_path").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    known = T.with_ancestors(direct.select("path")).join(direct, "path", "left")
    return shared.written(T.intervals(known, total_files=F.col("n")), "tree")


def _above(files: DataFrame) -> DataFrame:
    """(folder_path, path): every folder of files with itself and all folders above it, by intervals."""
    own = files.select(F.col("folder_path").alias("path")).distinct()
    tree = shared.written(T.intervals(T.with_ancestors(own)), "tree")
    return T.containing(tree.join(own, "path", "left_semi"), tree).select(F.col("path").alias("folder_path"), F.col("above").alias("path"))


def _full_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Files whose bytes hash to the same XXH3: how many there are and the first of them."""
    files = B.table(spark, sf, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("file_id"), F.col("text").cast("binary").alias("content"))
    hashed = shared.written(D.full_hashes(files, "content"), "hashed")
    same = hashed.groupBy("full_hash").agg(F.count(F.lit(1)).alias("same"), F.min("file_id").alias("first_id"))
    return hashed.join(same, "full_hash").select("file_id", "same", "first_id")


# Scans and snapshots --------------------------------------------------------

query("s2_file_records", f"{B.with_tables('doc_files')} SELECT file_id, name, folder_path, extension, size FROM doc_files")(
    lambda s, d: _docs(s, d).select("file_id", paths.base_name(F.col("path")).alias("name"), paths.parent(F.col("path")).alias("folder_path"), paths.extension(F.col("name")).alias("extension"), "size"))
query("s3_folder_records", f"{B.with_tables('doc_files')} SELECT folder_path, count(*) AS direct_files, sum(size)::BIGINT AS direct_bytes FROM doc_files GROUP BY 1")(lambda s, d: C.folder_records(_docs(s, d)))

SNAP_OLD = """SELECT path, name, folder_path, extension, media_kind, size, modified_at, modified_at - 5 AS created_at, modified_at + 9 AS accessed_at, content_hash AS partial_hash, content_hash AS sample_hash, content_hash AS full_hash, 'xxh3-full-v1' AS hash_algorithm, 4 AS hash_state,
 CASE WHEN file_id % 17 = 0 THEN 1700000000 END AS deleted_at FROM doc_files WHERE file_id % 10 <> 3"""
SNAP_NEW = """SELECT path, name, folder_path, extension, CASE WHEN file_id % 10 = 6 THEN 'other' ELSE media_kind END AS media_kind, size + CASE WHEN file_id % 10 = 5 THEN 1 ELSE 0 END AS size, modified_at + CASE WHEN file_id % 10 = 5 THEN 60 ELSE 0 END AS modified_at,
 CASE WHEN file_id % 10 = 8 THEN NULL ELSE modified_at - 5 END AS created_at, modified_at + 99 AS accessed_at FROM doc_files WHERE file_id % 10 <> 7"""


def _snapshots(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f, h = _docs(s, d), F.col("content_hash")
    named, k = ["path", "name", "folder_path", "extension"], F.col("file_id") % 10
    old = f.filter("file_id % 10 <> 3").select(
        *named, "media_kind", "size", "modified_at", (F.col("modified_at") - 5).alias("created_at"), (F.col("modified_at") + 9).alias("accessed_at"), h.alias("partial_hash"), h.alias("sample_hash"), h.alias("full_hash"),
        F.lit("xxh3-full-v1").alias("hash_algorithm"), F.lit(4).alias("hash_state"), F.when(F.col("file_id") % 17 == 0, F.lit(N)).alias("deleted_at"))
    bump = F.when(k == 5, 1).otherwise(0)
    return old, f.filter("file_id % 10 <> 7").select(
        *named, F.when(k == 6, "other").otherwise(F.col("media_kind")).alias("media_kind"), (F.col("size") + bump).alias("size"), (F.col("modified_at") + 60 * bump).alias("modified_at"),
        F.when(k != 8, F.col("modified_at") - 5).alias("created_at"), (F.col("modified_at") + 99).alias("accessed_at"))


SAME = "n.size IS NOT DISTINCT FROM o.size AND n.modified_at IS NOT DISTINCT FROM o.modified_at AND n.created_at IS NOT DISTINCT FROM o.created_at"
SCANNED = ["name", "folder_path", "extension", "media_kind", "size", "modified_at", "created_at", "accessed_at"]


@query("s6_snapshot_upsert", f"""{B.with_tables('doc_files')}, o AS ({SNAP_OLD}), n AS ({SNAP_NEW}),
j AS (SELECT coalesce(n.path, o.path) AS path, {', '.join(f"CASE WHEN n.path IS NOT NULL THEN n.{c} ELSE o.{c} END AS {c}" for c in SCANNED)}, o.path IS NOT NULL AND (n.path IS NULL OR ({SAME})) AS kept,
 o.partial_hash AS h, o.hash_algorithm AS ha, o.hash_state AS hs, CASE WHEN n.path IS NULL THEN o.deleted_at END AS deleted_at FROM o FULL JOIN n ON o.path = n.path)
SELECT path, {', '.join(SCANNED)}, {', '.join(f"CASE WHEN kept THEN h END AS {c}" for c in ('partial_hash', 'sample_hash', 'full_hash'))}, CASE WHEN kept THEN ha END AS hash_algorithm, deleted_at, CASE WHEN kept THEN hs ELSE 0 END AS hash_state FROM j""")
def _s6(s: SparkSession, d: str) -> DataFrame:
    return C.upsert(*_snapshots(s, d))


@query("s10_tombstones", f"{B.with_tables('doc_files')}, o AS ({SNAP_OLD}), n AS ({SNAP_NEW}) SELECT path, size FROM o WHERE deleted_at IS NULL AND (path = '/corpus' OR starts_with(path, '/corpus/')) AND path NOT IN (SELECT path FROM n)")
def _s10(s: SparkSession, d: str) -> DataFrame:
    return C.tombstones(*_snapshots(s, d), "/corpus").select("path", "size")


query("s7_folders", f"""{B.with_tables('doc_files')}, f AS (SELECT DISTINCT path FROM ({_up('(SELECT DISTINCT folder_path FROM doc_files)', '1 AS x')}))
SELECT path, nullif(regexp_replace(path, '/[^/]*$', ''), '') AS parent_path, regexp_extract(path, '([^/]*)$', 1) AS name, (1 + len(string_split(ltrim(path, '/'), '/')))::INTEGER AS depth FROM f""")(lambda s, d: C.folders(_docs(s, d)))
query("s8_placeholder_totals", f"""{B.with_tables('live')}, t AS (SELECT path, count(*) AS total_files, sum(size)::BIGINT AS total_bytes FROM ({_up("(SELECT * FROM live WHERE file_id % 3 = 0)", 'size')}) GROUP BY path),
r AS (SELECT folder_path AS path, count(*) AS f, sum(size)::BIGINT AS b FROM doc_files GROUP BY 1) SELECT path, greatest(coalesce(total_files, 0), coalesce(f, 0)) AS total_files, greatest(coalesce(total_bytes, 0), coalesce(b, 0)) AS total_bytes FROM t FULL JOIN r USING (path)""")(
    lambda s, d: C.placeholder_totals(C.rollup(C.live(_docs(s, d)).filter("file_id % 3 = 0")), C.folder_records(_docs(s, d))))
ISSUES = "SELECT event_id AS id, user_id % 3 AS scan_id, CASE WHEN event_id % 2 = 0 THEN 'walk' ELSE 'hash' END AS phase, concat('/p/', user_id) AS path, floor(epoch(ts))::BIGINT AS created_at FROM events"


def _issues(s: SparkSession, d: str) -> DataFrame:
    return B.table(s, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 3).alias("scan_id"), F.when(F.col("event_id") % 2 == 0, "walk").otherwise("hash").alias("phase"), F.concat(F.lit("/p/"), F.col("user_id").cast("string")).alias("path"), F.unix_timestamp("ts").alias("created_at"))


query("s12_issue_cap", f"SELECT id, scan_id, phase, path, created_at FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY created_at, id) AS r FROM ({ISSUES})) WHERE r <= 500")(lambda s, d: C.issue_sink(_issues(s, d)))
WALKS = f"SELECT scan_id AS id, max(created_at) AS started_at, sum((phase = 'walk')::INT)::BIGINT AS inaccessible_entries FROM ({ISSUES}) GROUP BY 1"
KEPT = f"SELECT id, scan_id, phase, path FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY created_at, id) AS r FROM ({ISSUES})) WHERE r <= 500"
LATEST = f"(SELECT id FROM ({WALKS}) ORDER BY started_at DESC, id DESC LIMIT 1)"


def _walks(s: SparkSession, d: str) -> DataFrame:
    return _issues(s, d).groupBy(F.col("scan_id").alias("id")).agg(F.max("created_at").alias("started_at"), F.count_if(F.col("phase") == "walk").alias("inaccessible_entries"))


query("s13_issue_list", f"SELECT phase, path, id FROM ({KEPT}) WHERE scan_id = {LATEST} ORDER BY phase, path, id LIMIT 100")(lambda s, d: C.issue_list(C.issue_sink(_issues(s, d)), _walks(s, d)).select("phase", "path", "id"))
query("s14_issue_counts", f"SELECT (SELECT inaccessible_entries FROM ({WALKS}) WHERE id = {LATEST}) AS walk_issues, (SELECT count(*) FROM ({KEPT}) WHERE scan_id = {LATEST} AND phase = 'hash') AS hash_issues")(
    lambda s, d: C.issue_counts(C.issue_sink(_issues(s, d)), _walks(s, d)))
SESSIONS = "SELECT o_orderkey AS id, concat('/r', o_custkey % 5) AS root, epoch(o_orderdate)::BIGINT AS started_at, CASE WHEN o_orderkey % 3 = 0 THEN 'metadata' WHEN o_orderkey % 3 = 1 THEN 'smart' ELSE 'other' END AS scan_strategy FROM orders"


def _sessions(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    return B.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("/r"), (F.col("o_custkey") % 5).cast("string")).alias("root"), F.unix_timestamp("o_orderdate").alias("started_at"), F.when(k == 0, "metadata").when(k == 1, "smart").otherwise("other").alias("scan_strategy"))


query("s16_s17_latest_session", f"SELECT id, root, started_at, CASE WHEN scan_strategy IN ('smart', 'metadata') THEN scan_strategy ELSE 'smart' END AS mode FROM ({SESSIONS}) ORDER BY started_at DESC, id DESC LIMIT 1")(
    lambda s, d: C.latest_session(_sessions(s, d)).select("id", "root", "started_at", F.when(F.col("scan_strategy").isin("smart", "metadata"), F.col("scan_strategy")).otherwise("smart").alias("mode")))
query("s18_timeline_capture", f"{B.with_tables('live')} SELECT sum(size)::BIGINT AS total_bytes, count(*) AS file_count, count(DISTINCT folder_path) AS folder_count FROM live")(
    lambda s, d: C.live(_docs(s, d)).agg(F.sum("size").alias("total_bytes"), F.count(F.lit(1)).alias("file_count"), F.count_distinct("folder_path").alias("folder_count")))
query("s19_index_catalog", f"SELECT root, id, started_at, scan_strategy FROM ({SESSIONS}) QUALIFY row_number() OVER (PARTITION BY root ORDER BY started_at DESC, id DESC) = 1")(lambda s, d: C.index_catalog(_sessions(s, d), "root"))
query("s26_mark_deleted", f"{B.with_tables('doc_files')} SELECT file_id, CASE WHEN path IN ('/corpus/Downloads/doc4.exe', '/corpus/Downloads/doc16.exe') THEN 5 ELSE deleted_at END AS deleted_at FROM doc_files")(
    lambda s, d: C.mark_deleted(_docs(s, d), ["/corpus/Downloads/doc4.exe", "/corpus/Downloads/doc16.exe"], 5).select("file_id", "deleted_at"))

# Filters and search ----------------------------------------------------------

RANK = "ORDER BY size DESC, modified_at DESC, file_id LIMIT 100"
query("f1_live_files", f"{B.with_tables('live')} SELECT file_id, path FROM live")(lambda s, d: C.live(_docs(s, d)).select("file_id", "path"))
query("f2_substring_search", f"{B.with_tables('live')} SELECT file_id, size FROM live WHERE contains(lower(path), 'backup') {RANK}")(lambda s, d: C.substring_search(_docs(s, d), " BackUp ").select("file_id", "size"))
query("f3_filtered_search", f"{B.with_tables('live')} SELECT file_id, size FROM live WHERE extension IN ('txt', 'pdf', 'js') AND media_kind IN ('document') AND size BETWEEN 500 AND 5000 {RANK}")(
    lambda s, d: C.search(_docs(s, d), extensions=["TXT", "pdf", "js"], kinds=["Document"], least=500, most=5000).select("file_id", "size"))
query("f4_regex_search", f"{B.with_tables('live')} SELECT file_id, size FROM live WHERE regexp_matches(name, 'doc[0-9]*7\\.') OR regexp_matches(path, 'doc[0-9]*7\\.') {RANK}")(lambda s, d: C.search(_docs(s, d), regex=r"doc[0-9]*7\.").select("file_id", "size"))
query("f5_null_safe_changes", f"{B.with_tables('doc_files')}, o AS ({SNAP_OLD}), n AS ({SNAP_NEW}) SELECT o.path FROM o JOIN n ON o.path = n.path WHERE o.size IS DISTINCT FROM n.size OR o.modified_at IS DISTINCT FROM n.modified_at")(
    lambda s, d: (lambda o, n: o.alias("o").join(n.alias("n"), F.col("o.path") == F.col("n.path")).filter(~F.col("o.size").eqNullSafe(F.col("n.size")) | ~F.col("o.modified_at").eqNullSafe(F.col("n.modified_at"))).select("o.path"))(*_snapshots(s, d)))
query("f6_path_under_prefix", f"{B.with_tables('doc_files')} SELECT file_id FROM doc_files WHERE path = '/corpus/Projects/app' OR starts_with(path, '/corpus/Projects/app/')")(lambda s, d: _docs(s, d).filter(paths.under(F.col("path"), "/corpus/Projects/app//")).select("file_id"))
query("f11_stale_files", f"{B.with_tables('live')} SELECT file_id, size FROM live WHERE modified_at < {N - 365 * 86400} ORDER BY size DESC, file_id LIMIT 8")(lambda s, d: C.stale_files(_docs(s, d), N).select("file_id", "size"))
AGE = f"CASE WHEN modified_at >= 631152000 THEN greatest(0, floor(({N} - modified_at) / 86400))::BIGINT END"
query("f12_f13_trusted_age", f"{B.with_tables('doc_files')} SELECT file_id, {AGE} AS age_days, {AGE} > 180 AS stale FROM doc_files")(
    lambda s, d: _docs(s, d).select("file_id", paths.trusted_age_days(F.col("modified_at"), N).alias("age_days"), (paths.trusted_age_days(F.col("modified_at"), N) > 180).alias("stale")))
query("f14_kind_filter", f"{B.with_tables('doc_files')} SELECT file_id FROM doc_files WHERE media_kind IS NULL OR media_kind = 'code'")(lambda s, d: _docs(s, d).filter("media_kind IS NULL OR media_kind = 'code'").select("file_id"))
query("f16_outermost_paths", f"""{B.with_tables('doc_files')}, f AS (SELECT DISTINCT path FROM ({_up('doc_files', '1 AS x')}) WHERE path LIKE '/corpus/P%')
SELECT path FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE starts_with(f.path, g.path || '/'))""")(lambda s, d: C.outermost(C.folders(_docs(s, d)).filter("path LIKE '/corpus/P%'").select("path")))

# Rollups, histograms and top lists -------------------------------------------

SUMS = "count(*) AS file_count, sum(size)::BIGINT AS total_bytes"
query("a1_extension_stats", f"{B.with_tables('live')} SELECT extension, {SUMS} FROM live WHERE extension IS NOT NULL GROUP BY 1")(lambda s, d: C.extension_stats(_docs(s, d)))
query("a2_media_stats", f"{B.with_tables('live')} SELECT media_kind, {SUMS} FROM live GROUP BY 1")(lambda s, d: C.media_stats(_docs(s, d)))
query("a3_folder_media", f"{B.with_tables('live')} SELECT folder_path, media_kind, {SUMS} FROM live GROUP BY 1, 2")(lambda s, d: C.folder_media(_docs(s, d)))
MONTH = "strftime(make_timestamp(modified_at * 1000000), '%Y-%m')"
query("a4_month_histogram", f"{B.with_tables('live')} SELECT coalesce({MONTH}, 'unknown') AS bucket, {SUMS} FROM live GROUP BY 1")(lambda s, d: C.month_histogram(_docs(s, d)))
query("a5_timeline", f"{B.with_tables('live')} SELECT {MONTH} AS bucket, {SUMS} FROM live WHERE {MONTH} BETWEEN '2021-11' AND '2023-11' GROUP BY 1")(lambda s, d: C.timeline(_docs(s, d), N))
BAND = f"CASE WHEN modified_at IS NULL THEN 'unknown' {' '.join(f'WHEN {N} - modified_at < {limit} THEN {band!r}' for band, limit in paths.AGE_BANDS)} ELSE 'gt2yr' END"
query("a6_age_bands", f"{B.with_tables('live')} SELECT {BAND} AS band, {SUMS} FROM live GROUP BY 1")(lambda s, d: C.age_bands(_docs(s, d), N))
query("a7_direct_rollup", f"{B.with_tables('hier_files')} SELECT folder_path, count(*) AS direct_files, sum(size)::BIGINT AS direct_bytes FROM hier_files GROUP BY 1")(lambda s, d: C.folder_records(B.hier_files(s, d)))
ROLL = f"SELECT path, count(*) AS total_files, sum(size)::BIGINT AS total_bytes FROM ({_up('hier_files', 'size')}) GROUP BY path"
query("a8_recursive_rollup", f"{B.with_tables('hier_files')} {ROLL}")(lambda s, d: C.rollup(B.hier_files(s, d)))
query("a8_folder_totals", f"""{B.with_tables('live')}, f AS (SELECT DISTINCT path FROM ({_up('doc_files', '1 AS x')})), t AS (SELECT path, count(*) AS n, sum(size)::BIGINT AS b FROM ({_up('live', 'size')}) GROUP BY path)
SELECT path, (1 + len(string_split(ltrim(path, '/'), '/')))::INTEGER AS depth, coalesce(n, 0) AS total_files, coalesce(b, 0) AS total_bytes FROM f LEFT JOIN t USING (path)""")(lambda s, d: C.folder_totals(_docs(s, d)))
DOM = f"SELECT path, value, bytes FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY bytes DESC, value) AS r FROM (SELECT path, value, sum(greatest(0, size))::BIGINT AS bytes FROM ({_up('{src}', '{val} AS value, size')}) WHERE value IS NOT NULL GROUP BY 1, 2)) WHERE r = 1"
query("a12_dominant_value", f"{B.with_tables('hier_files')} {DOM.format(src='hier_files', val='label')}")(lambda s, d: C.dominant(B.hier_files(s, d), "label"))
query("a22_dominant_kind", f"{B.with_tables('live')} {DOM.format(src='live', val='media_kind')}")(lambda s, d: C.dominant(C.live(_docs(s, d)), "media_kind"))
query("a19_stale_bytes", f"{B.with_tables('live')} SELECT coalesce(sum(size) FILTER (WHERE {BAND} IN ('1to2yr', 'gt2yr')), 0)::BIGINT AS stale_bytes FROM live")(lambda s, d: C.stale_bytes(C.age_bands(_docs(s, d), N)))
query("a20_timeline_insights", f"""{B.with_tables('live')}, m AS (SELECT {MONTH} AS bucket, {SUMS} FROM live GROUP BY 1)
SELECT (SELECT bucket FROM m ORDER BY total_bytes DESC, bucket LIMIT 1) AS busiest, (SELECT bucket FROM m ORDER BY file_count DESC, bucket LIMIT 1) AS peak, (SELECT bucket FROM m ORDER BY file_count, bucket LIMIT 1) AS quietest, (SELECT (sum(total_bytes) // count(*))::BIGINT FROM m) AS bytes_per_month""")(lambda s, d: C.timeline_insights(C.month_histogram(_docs(s, d))))
query("a21_percent_text", f"{B.with_tables('live')}, t AS (SELECT media_kind, sum(size) AS b, (SELECT sum(size) FROM live) AS w FROM live GROUP BY 1) SELECT media_kind, CASE WHEN 100.0 * b / w > 0 AND 100.0 * b / w < 1 THEN '<1%' ELSE concat(floor(100.0 * b / w + 0.5)::BIGINT, '%') END AS share FROM t")(
    lambda s, d: (lambda m: m.crossJoin(F.broadcast(m.agg(F.sum("total_bytes").alias("w")))).select("media_kind", paths.percent_text(F.col("total_bytes"), F.col("w")).alias("share")))(C.media_stats(_docs(s, d))))
query("a25_tail_aggregate", f"""{B.with_tables('hier_files')}, v AS (SELECT folder_path AS name, sum(size)::BIGINT AS value, row_number() OVER (ORDER BY sum(size) DESC, folder_path)::INTEGER AS r FROM hier_files GROUP BY 1)
SELECT r AS rank, name, 1::BIGINT AS tiles, greatest(1, value) AS value FROM v WHERE r <= 24 UNION ALL SELECT 25, '(others)', count(*), greatest(1, sum(value))::BIGINT FROM v WHERE r > 24 HAVING count(*) > 0""")(
    lambda s, d: C.tail_aggregate(B.hier_files(s, d).groupBy(F.col("folder_path").alias("name")).agg(F.sum("size").alias("value"))))
query("a26_totals", f"{B.with_tables('live')} SELECT count(*) AS files, sum(greatest(0, size))::BIGINT AS bytes FROM live")(lambda s, d: C.live(_docs(s, d)).agg(F.count(F.lit(1)).alias("files"), F.sum(F.greatest(F.lit(0), "size")).alias("bytes")))
TREE = """s AS (SELECT list_filter(string_split_regex(path, '[/\\\\]'), lambda x: x <> '') AS s, greatest(0, size) AS size FROM live WHERE name LIKE '%7%'),
c AS (SELECT (SELECT min(k) FROM range(0, 50) t(k) WHERE k >= m OR lo[k + 1] IS DISTINCT FROM hi[k + 1]) AS common FROM (SELECT min(s) AS lo, max(s) AS hi, min(len(s)) - 1 AS m FROM s)),
e AS (SELECT s, size, common, unnest(range(common, len(s) + 1)) AS n FROM s, c),
tree AS (SELECT array_to_string(s[1:n], '/') AS path, CASE WHEN n > common THEN array_to_string(s[1:n - 1], '/') END AS parent_path, coalesce(s[n], 'results') AS name, (n - common)::INTEGER AS depth, sum(size)::BIGINT AS bytes FROM e GROUP BY 1, 2, 3, 4)"""
query("a27_prefix_tree", f"{B.with_tables('live')}, {TREE} SELECT * FROM tree")(lambda s, d: C.prefix_tree(C.live(_docs(s, d)).filter("name LIKE '%7%'").select("path", "size")))
query("l6_icicle", f"""{B.with_tables('live')}, {TREE}, o AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY parent_path ORDER BY bytes DESC, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM tree WHERE depth <= 6 AND bytes > 0)
SELECT o.path, o.depth, o.bytes, coalesce((SELECT sum(p.start) FROM o p WHERE p.depth > 0 AND (o.path = p.path OR starts_with(o.path, p.path || '/'))), 0) / (SELECT bytes FROM tree WHERE depth = 0) AS x, o.bytes / (SELECT bytes FROM tree WHERE depth = 0) AS w FROM o""")(
    lambda s, d: C.icicle(C.prefix_tree(C.live(_docs(s, d)).filter("name LIKE '%7%'").select("path", "size"))))
query("a29_distinct", f"{B.with_tables('doc_files')} SELECT DISTINCT folder_path, extension FROM doc_files")(lambda s, d: _docs(s, d).select("folder_path", "extension").distinct())
query("t1_largest_folders", f"{B.with_tables('hier_files')} SELECT path, total_bytes FROM ({ROLL}) WHERE total_bytes > 0 ORDER BY total_bytes DESC, path LIMIT 50")(lambda s, d: C.largest(C.rollup(B.hier_files(s, d)), "total_bytes", "path", 50).select("path", "total_bytes"))
query("t2_j1_folder_children", f"{B.with_tables('hier_files')} SELECT path, total_bytes FROM ({ROLL}) WHERE regexp_replace(path, '/[^/]*$', '') = '/ASIA' AND total_bytes > 0 ORDER BY total_bytes DESC, path LIMIT 500")(lambda s, d: C.children(C.rollup(B.hier_files(s, d)), "/ASIA").select("path", "total_bytes"))
query("t3_largest_files", f"{B.with_tables('live')} SELECT file_id, size FROM live WHERE size > 0 ORDER BY size DESC, file_id LIMIT 50")(lambda s, d: C.largest(C.live(_docs(s, d)), "size", "file_id", 50).select("file_id", "size"))
query("t4_top_extensions", f"{B.with_tables('live')} SELECT extension, {SUMS} FROM live WHERE extension IS NOT NULL GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 5")(lambda s, d: C.largest(C.extension_stats(_docs(s, d)), "total_bytes", "extension", 5))
query("t10_sort_newest", f"{B.with_tables('live')} SELECT file_id, row_number() OVER (ORDER BY modified_at DESC NULLS LAST, size DESC, file_id)::INTEGER AS place FROM live QUALIFY place <= 200")(
    lambda s, d: (lambda top: top.withColumn("place", F.row_number().over(C.Window.orderBy(F.desc_nulls_last("modified_at"), F.desc("size"), "file_id"))).select("file_id", "place"))(C.live(_docs(s, d)).orderBy(F.desc_nulls_last("modified_at"), F.desc("size"), "file_id").limit(200)))
query("j2_files_folders", f"{B.with_tables('live')}, t AS (SELECT folder_path, count(*) AS n FROM live GROUP BY 1) SELECT file_id, n FROM live JOIN t USING (folder_path)")(
    lambda s, d: (lambda f: f.join(f.groupBy("folder_path").agg(F.count(F.lit(1)).alias("n")), "folder_path").select("file_id", "n"))(C.live(_docs(s, d))))
query("j20_j21_ancestor_join", f"{B.with_tables('doc_files')} SELECT file_id, path FROM ({_up('doc_files', 'file_id')})")(lambda s, d: C.ancestor_files(_docs(s, d), C.folders(_docs(s, d))))
TOPF = f"SELECT path, total_bytes FROM ({ROLL}) ORDER BY total_bytes DESC, path LIMIT 40"
query("j22_l7_nearest_ancestor", f"""{B.with_tables('hier_files')}, t AS ({TOPF}) SELECT t.path, (SELECT u.path FROM t u WHERE starts_with(t.path, u.path || '/') ORDER BY length(u.path) DESC LIMIT 1) AS parent_path FROM t""")(
    lambda s, d: C.nearest_ancestor(C.rollup(B.hier_files(s, d)).orderBy(F.desc("total_bytes"), "path").limit(40).select("path")))
query("j22_tree_parents", ORACLES["j22_l7_nearest_ancestor"])(
    lambda s, d: (lambda totals: T.enclosing(T.intervals(totals.orderBy(F.desc("total_bytes"), "path").limit(40).select("path"))))(C.rollup(B.hier_files(s, d))))
query("a8_tree_totals", f"{B.with_tables('hier_files')} {ROLL}")(lambda s, d: T.totals(B.hier_files(s, d)))
query("a12_tree_dominant", ORACLES["a12_dominant_value"])(lambda s, d: T.dominant(B.hier_files(s, d), "label"))
query("f16_tree_outermost", ORACLES["f16_outermost_paths"])(lambda s, d: T.outermost(T.intervals(C.folders(_docs(s, d)).filter("path LIKE '/corpus/P%'").select("path"))))
query("j20_tree_ancestors", ORACLES["j20_j21_ancestor_join"])(
    lambda s, d: (lambda files: files.join(_above(files), "folder_path").select("file_id", "path"))(_docs(s, d).select("file_id", "folder_path")))
query("f6_tree_range", f"{B.with_tables('hier_files')} SELECT path, total_files FROM ({ROLL}) WHERE path = '/ASIA' OR starts_with(path, '/ASIA/')")(
    lambda s, d: (lambda tree: T.inside(tree, tree, "/ASIA").select("path", "total_files"))(_tree(s, d)))
query("l7_scope_children", f"{B.with_tables('hier_files')} SELECT path, regexp_extract(path, '[^/]*$') AS name, total_files, total_bytes, true AS has_children FROM ({ROLL}) WHERE regexp_matches(path, '^/ASIA/[^/]*$')")(
    lambda s, d: C.scope_children(C.rollup(B.hier_files(s, d)), "/ASIA"))
query("l5_squarify")(lambda s, d: C.squarify(C.rollup(B.hier_files(s, d)).select(paths.parent(F.col("path")).alias("parent_path"), F.col("path").alias("name"), F.col("total_bytes").alias("value"))))

# Scalar functions --------------------------------------------------------------

query("u1_media_kind", f"{B.with_tables('doc_files')} SELECT file_id, media_kind FROM doc_files")(lambda s, d: _docs(s, d).select("file_id", "media_kind"))
query("u4_path_ancestors", f"{B.with_tables('doc_files')} SELECT DISTINCT folder_path, array_to_string({ANC}, '|') AS up FROM (SELECT *, string_split(ltrim(folder_path, '/'), '/') AS parts FROM doc_files)")(
    lambda s, d: _docs(s, d).select("folder_path", F.array_join(paths.ancestors(F.col("folder_path")), "|").alias("up")).distinct())
query("u9_format_bytes", f"{B.with_tables('doc_files')} SELECT file_id, CASE WHEN z < 1024 THEN concat(z, ' B') WHEN z < 1048576 THEN printf('%.1f KB', floor(z / 1024.0 * 10 + 0.5) / 10) WHEN z < 1073741824 THEN printf('%.1f MB', floor(z / 1048576.0 * 10 + 0.5) / 10) ELSE printf('%.1f GB', floor(z / 1073741824.0 * 10 + 0.5) / 10) END AS shown FROM (SELECT file_id, CASE file_id % 4 WHEN 0 THEN size WHEN 1 THEN size * 1000 WHEN 2 THEN size * 1000001 ELSE file_id END AS z FROM doc_files)")(
    lambda s, d: _docs(s, d).select("file_id", paths.format_bytes(F.when(F.col("file_id") % 4 == 0, F.col("size")).when(F.col("file_id") % 4 == 1, F.col("size") * 1000).when(F.col("file_id") % 4 == 2, F.col("size") * 1000001).otherwise(F.col("file_id"))).alias("shown")))
query("u11_join_destination", f"{B.with_tables('doc_files')} SELECT file_id, concat('C:\\old\\', name) AS dest FROM doc_files")(lambda s, d: _docs(s, d).select("file_id", paths.join_destination(F.lit("C:\\old\\"), F.col("name")).alias("dest")))
query("u12_relative_time", f"""{B.with_tables('doc_files')}, a AS (SELECT file_id, greatest(0, {N} - modified_at) AS g FROM doc_files)
SELECT file_id, CASE WHEN g < 60 THEN concat(g, 's ago') WHEN g < 3600 THEN concat(g // 60, 'm ago') WHEN g < 86400 THEN concat(g // 3600, 'h ago') WHEN g < 2592000 THEN concat(g // 86400, 'd ago') WHEN g < 31536000 THEN concat(g // 2592000, 'mo ago') ELSE concat(g // 31536000, 'y ago') END AS ago FROM a""")(
    lambda s, d: _docs(s, d).select("file_id", paths.relative_time(F.col("modified_at"), N).alias("ago")))

# Duplicates ----------------------------------------------------------------------

HASHED = "SELECT *, content_hash AS partial_hash, CASE WHEN file_id % 3 > 0 THEN content_hash END AS sample_hash, CASE WHEN file_id % 3 = 2 THEN content_hash END AS full_hash, CASE WHEN file_id % 5 = 0 THEN NULL ELSE 'xxh3-full-v1' END AS hash_algorithm, (file_id % 3 * 2)::INTEGER AS hash_state FROM doc_files"


def _hashed(s: SparkSession, d: str) -> DataFrame:
    k = F.col("file_id") % 3
    return _docs(s, d).select(
        "*", F.col("content_hash").alias("partial_hash"), F.when(k > 0, F.col("content_hash")).alias("sample_hash"), F.when(k == 2, F.col("content_hash")).alias("full_hash"),
        F.when(F.col("file_id") % 5 != 0, "xxh3-full-v1").alias("hash_algorithm"), (k * 2).cast("int").alias("hash_state"))


DUPS = "SELECT content_hash AS hash, size, path, modified_at, file_id FROM live WHERE (size, content_hash) IN (SELECT (size, content_hash) FROM live GROUP BY size, content_hash HAVING count(*) > 1)"


def _dups(s: SparkSession, d: str) -> DataFrame:
    f = C.live(_docs(s, d))
    shared = f.groupBy("size", "content_hash").count().filter("count > 1")
    return f.join(shared, ["size", "content_hash"], "left_semi").select(F.col("content_hash").alias("hash"), "size", "path", "modified_at", "file_id")


GROUPED = """SELECT size, partial_hash, sample_hash, full_hash, count(*) AS members, CASE WHEN full_hash IS NOT NULL THEN 1.0 WHEN sample_hash IS NOT NULL THEN 0.8 ELSE 0.6 END::DOUBLE AS confidence, size * (count(*) - 1) AS reclaimable_bytes
FROM h WHERE deleted_at IS NULL AND size > 0 AND partial_hash IS NOT NULL GROUP BY ALL HAVING count(*) > 1"""
GROUPED = GROUPED.replace("GROUP BY ALL", "GROUP BY size, partial_hash, sample_hash, full_hash")
CAND = "SELECT size, count(*) AS file_count, sum(size)::BIGINT AS total_bytes FROM live WHERE size > 0 GROUP BY size HAVING count(*) > 1"
query("a9_duplicate_candidates", f"{B.with_tables('live')} {CAND}")(lambda s, d: D.candidates(_docs(s, d)))
query("d1_j4_hash_jobs", f"{B.with_tables('live')} SELECT file_id, 'sample' AS job_type, size AS priority FROM live WHERE size IN (SELECT size FROM ({CAND}))")(lambda s, d: D.hash_jobs(_docs(s, d)))
query("d2_j6_needs_hash", f"{B.with_tables('live')}, h AS ({HASHED}) SELECT file_id FROM h WHERE deleted_at IS NULL AND (sample_hash IS NULL OR hash_state < 2 OR hash_algorithm IS NULL) AND size IN (SELECT size FROM ({CAND}))")(lambda s, d: D.needs_hash(_hashed(s, d)).select("file_id"))
query("d3_chunk_plan", f"""{B.with_tables('doc_files')}, x AS (SELECT file_id, size * 40001 + file_id % 7 AS z FROM doc_files), o AS (SELECT file_id, z, CASE WHEN z <= 262144 THEN [0] WHEN z <= 1048576 THEN [0, z - 65536] WHEN z <= 536870912 THEN [0, (z - 65536) // 2, z - 65536] ELSE [0, (z - 65536) // 4, (z - 65536) * 2 // 4, (z - 65536) * 3 // 4, z - 65536] END AS p FROM x)
SELECT file_id, array_to_string(list_transform(p, lambda a: concat(a, '+', CASE WHEN z <= 262144 THEN z ELSE least(65536, z - a) END)), ',') AS plan FROM o""")(
    lambda s, d: _docs(s, d).select("file_id", D.chunk_plan(F.col("size") * 40001 + F.col("file_id") % 7).alias("p")).select("file_id", F.array_join(F.transform("p", lambda c: F.concat_ws("+", c["offset"].cast("string"), c["len"].cast("string"))), ",").alias("plan")))
query("d6_full_hash", """SELECT doc_id AS file_id, count(*) OVER (PARTITION BY md5(text)) AS same, min(doc_id) OVER (PARTITION BY md5(text)) AS first_id FROM documents WHERE text IS NOT NULL""")(lambda s, d: _full_hashes(s, d))
query("d8_j5_escalation", f"""{B.with_tables('doc_files')}, h AS ({HASHED}) SELECT file_id FROM h WHERE deleted_at IS NULL AND sample_hash IS NOT NULL AND full_hash IS NULL AND (size, sample_hash) IN (SELECT (size, sample_hash) FROM h WHERE deleted_at IS NULL AND sample_hash IS NOT NULL GROUP BY size, sample_hash HAVING count(*) > 1)""")(lambda s, d: D.escalation(_hashed(s, d)).select("file_id"))
query("a10_duplicate_groups", f"{B.with_tables('doc_files')}, h AS ({HASHED}) {GROUPED}")(lambda s, d: D.groups(_hashed(s, d)))
query("d10_a11_group_members", f"""{B.with_tables('doc_files')}, h AS ({HASHED}), g AS ({GROUPED})
SELECT g.size, coalesce(g.full_hash, g.sample_hash, g.partial_hash) AS hash, CASE WHEN g.full_hash IS NOT NULL THEN 'f' WHEN g.sample_hash IS NOT NULL THEN 's' ELSE 'p' END AS level, count(*) AS members
FROM g JOIN h ON h.deleted_at IS NULL AND h.size = g.size AND CASE WHEN g.full_hash IS NOT NULL THEN h.full_hash = g.full_hash WHEN g.sample_hash IS NOT NULL THEN h.sample_hash = g.sample_hash ELSE h.partial_hash = g.partial_hash END GROUP BY 1, 2, 3""")(
    lambda s, d: D.members(D.groups(_hashed(s, d)), _hashed(s, d)).groupBy("size", "hash", "level").agg(F.count(F.lit(1)).alias("members")))
query("a17_duplicate_waste", f"{B.with_tables('doc_files')}, h AS ({HASHED}) SELECT sum(reclaimable_bytes)::BIGINT AS waste FROM ({GROUPED})")(lambda s, d: D.groups(_hashed(s, d)).agg(F.sum("reclaimable_bytes").alias("waste")))
query("t5_top_groups", f"{B.with_tables('doc_files')}, h AS ({HASHED}) SELECT size, partial_hash, reclaimable_bytes FROM ({GROUPED}) ORDER BY reclaimable_bytes DESC, partial_hash, sample_hash NULLS FIRST, full_hash NULLS FIRST LIMIT 20")(
    lambda s, d: D.groups(_hashed(s, d)).orderBy(F.desc("reclaimable_bytes"), "partial_hash", "sample_hash", "full_hash").limit(20).select("size", "partial_hash", "reclaimable_bytes"))
query("t6_group_members", f"{B.with_tables('live')}, g AS ({DUPS}) SELECT hash, path FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY path) AS r FROM g) WHERE r <= 50")(
    lambda s, d: _dups(s, d).withColumn("r", F.row_number().over(C.Window.partitionBy("hash").orderBy("path"))).filter("r <= 50").select("hash", "path"))
query("n1_j3_sample_paths", f"{B.with_tables('live')}, g AS ({DUPS}) SELECT hash, path, r::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY size DESC, path) AS r FROM g) WHERE r <= 8")(lambda s, d: D.sample_paths(_dups(s, d)).select("hash", "path", "rank"))
query("d12_confidence_label", f"{B.with_tables('doc_files')}, h AS ({HASHED}) SELECT CASE WHEN confidence >= 0.99 THEN 'VERIFIED' WHEN confidence >= 0.8 THEN 'SAMPLED' ELSE 'SIZE MATCH' END AS label, count(*) AS n FROM ({GROUPED}) GROUP BY 1")(lambda s, d: D.groups(_hashed(s, d)).groupBy(D.label(F.col("confidence")).alias("label")).agg(F.count(F.lit(1)).alias("n")))
query("d13_keep_newest", f"{B.with_tables('live')}, g AS ({DUPS}) SELECT hash, file_id, row_number() OVER (PARTITION BY hash ORDER BY coalesce(modified_at, -1) DESC, path) = 1 AS keep FROM g")(lambda s, d: D.keep_newest(_dups(s, d)).select("hash", "file_id", "keep"))
query("d14_suggest_keep", f"""{B.with_tables('live')}, g AS ({DUPS}) SELECT hash, path AS keep_path FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY regexp_matches(path, '(?i)\\b(backup|old|archive|copy|temp|202\\d)\\b'), coalesce(modified_at, 0) DESC, len(string_split(path, '/')), path) AS r FROM g) WHERE r = 1""")(lambda s, d: D.suggest_keep(_dups(s, d)))
query("d15_smart_moves", f"""{B.with_tables('live')}, g AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS folder FROM ({DUPS})), b AS (SELECT hash, folder, count(*) AS n, max(coalesce(modified_at, 0)) AS newest FROM g GROUP BY 1, 2)
SELECT hash, folder AS target, (alln - n)::BIGINT AS to_stage FROM (SELECT *, count(*) OVER (PARTITION BY hash) AS k, sum(n) OVER (PARTITION BY hash) AS alln, row_number() OVER (PARTITION BY hash ORDER BY n DESC, newest DESC, len(string_split(folder, '/')), folder) AS r FROM b) WHERE r = 1 AND k > 1""")(lambda s, d: D.move_targets(_dups(s, d)))
query("d15_files_to_stage", f"""{B.with_tables('live')}, g AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS folder FROM ({DUPS})), b AS (SELECT hash, folder, count(*) AS n, max(coalesce(modified_at, 0)) AS newest FROM g GROUP BY 1, 2),
t AS (SELECT hash, folder AS target FROM b QUALIFY row_number() OVER (PARTITION BY hash ORDER BY n DESC, newest DESC, len(string_split(folder, '/')), folder) = 1)
SELECT hash, file_id, path, concat(target, '/', regexp_extract(path, '[^/]*$')) AS destination FROM g JOIN t USING (hash) WHERE folder <> target""")(lambda s, d: D.smart_moves(_dups(s, d)))


def queries() -> dict[str, Q]:
    """Every registered query by name."""
    kb_queries.load()
    more_queries.load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    kb_queries.load()
    more_queries.load()
    return dict(ORACLES)

"""Queries over decisions, contents, the board, recommendations and the overview."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import paths
from shelfmark.operators import catalog as C
from shelfmark.operators import cleanup as K
from shelfmark.operators import decisions as Y
from shelfmark.operators import duplicates as D
from shelfmark.operators import extract as X
from shelfmark.operators import facts as KB
from shelfmark.plans import kb_queries as Q
from shelfmark.plans import overview as O
from shelfmark.plans.registry import query
from shelfmark.sources import bindings as B
from shelfmark.sources import filesystem, knowledge, shared
from shelfmark.sources.decision_log import DecisionLog

N = B.AS_OF
W = B.with_tables


def load() -> None:
    """Importing this module registers its queries."""


def _k(s: SparkSession, d: str) -> knowledge.Knowledge:
    return knowledge.of(s, d)


# Decisions --------------------------------------------------------------------

#: Discoveries of all three kinds, some of them decided already.
B.SQL |= {
    "copies": "SELECT subject_id, object_id FROM (SELECT file_id AS object_id, lag(file_id) OVER (PARTITION BY size, content_hash ORDER BY file_id) AS subject_id FROM live) WHERE subject_id IS NOT NULL",
    "found": """SELECT kind, subject_id, object_id, confidence, CASE (subject_id + object_id) % 5 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'rejected' ELSE 'pending' END AS status, concat(kind, '#', subject_id, '#', object_id) AS id FROM (
 SELECT 'derivedFrom-pattern' AS kind, derivative_id AS subject_id, source_id AS object_id, confidence FROM derived UNION ALL SELECT 'backupOf-pair', backup_id, origin_id, confidence FROM backups
 UNION ALL SELECT 'near-duplicate-cluster', subject_id, object_id, CAST(CAST(0.95 AS FLOAT) AS DOUBLE) FROM copies)""",
    "predicates": "SELECT unnest(['derivedFrom-pattern', 'backupOf-pair', 'near-duplicate-cluster']) AS kind, unnest(['derivedFrom', 'backupOf', 'nearDuplicateOf']) AS predicate",
}
B.NEEDS |= {"copies": ["live"], "found": ["derived", "backups", "copies"]}


def _discoveries(s: SparkSession, d: str) -> DataFrame:
    k, alive = _k(s, d), C.live(_k(s, d).files)
    before = F.lag("file_id").over(C.Window.partitionBy("size", "content_hash").orderBy("file_id"))
    copies = alive.select(F.col("file_id").alias("object_id"), before.alias("subject_id")).filter("subject_id IS NOT NULL")
    rows = k.derived.select(F.lit("derivedFrom-pattern").alias("kind"), F.col("derivative_id").alias("subject_id"), F.col("source_id").alias("object_id"), "confidence")
    rows = rows.union(k.backups.select(F.lit("backupOf-pair"), "backup_id", "origin_id", "confidence")).union(copies.select(F.lit("near-duplicate-cluster"), "subject_id", "object_id", paths.f32(F.lit(0.95))))
    state = (F.col("subject_id") + F.col("object_id")) % 5
    return rows.withColumn("status", F.when(state == 0, "confirmed").when(state == 1, "rejected").otherwise("pending")).withColumn("id", F.concat_ws("#", "kind", "subject_id", "object_id"))


def _negative(s: SparkSession, d: str) -> DataFrame:
    none, k = F.lit(None).cast("string"), _k(s, d)
    pairs = k.derived.filter("(derivative_id + source_id) % 7 = 0").select(F.col("derivative_id").alias("subject_id"), F.lit("derivedFrom").alias("predicate"), F.col("source_id").alias("object_id"), none.alias("key"), none.alias("value"), none.alias("reason"))
    return pairs.union(k.rule_facts.filter("entity_id % 7 = 0 AND value = 'scratch'").select("entity_id", F.lit("property"), F.lit(None).cast("long"), "key", "value", none))


NEGATIVE = """negative AS (SELECT derivative_id AS subject_id, 'derivedFrom' AS predicate, source_id AS object_id, NULL::VARCHAR AS key, NULL::VARCHAR AS value FROM derived WHERE (derivative_id + source_id) % 7 = 0
 UNION ALL SELECT entity_id, 'property', NULL, key, value FROM rule_facts WHERE entity_id % 7 = 0 AND value = 'scratch')"""
query("k7_rejections", f"{W('derived', 'rule_facts')}, {NEGATIVE} SELECT DISTINCT subject_id, predicate, object_id, key, value FROM negative")(lambda s, d: (lambda n: Y.rejected_pairs(n).select("*", F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value")).unionByName(
    Y.rejected_properties(n).select(F.col("entity_id").alias("subject_id"), F.lit("property").alias("predicate"), F.lit(None).cast("long").alias("object_id"), "key", "value")))(_negative(s, d)))
query("h1_unrejected_pairs", f"{W('derived')} SELECT derivative_id, source_id FROM derived WHERE (derivative_id + source_id) % 7 <> 0")(
    lambda s, d: KB.unrejected(_k(s, d).derived, Y.rejected_pairs(_negative(s, d)), "derivedFrom", "derivative_id", "source_id").select("derivative_id", "source_id"))
query("k8_pin_unpin", "SELECT doc_id AS file_id, CASE WHEN doc_id % 75 = 0 THEN 2 ELSE 1 END AS pinned_at FROM documents WHERE (doc_id % 50 = 0 OR doc_id % 75 = 0) AND doc_id % 100 <> 0")(
    lambda s, d: (lambda f: Y.unpin(Y.pin(f.filter("file_id % 50 = 0").select("file_id", F.lit(1).alias("pinned_at")), f.filter("file_id % 75 = 0").select("file_id", F.lit(2).alias("pinned_at"))), f.filter("file_id % 100 = 0")))(_k(s, d).files))
WANTED = "(subject_id + object_id) % 2 = 0"
query("k13_confirm_status", f"{W('found')} SELECT id, CASE WHEN status = 'pending' AND {WANTED} THEN 'confirmed' ELSE status END AS status FROM found")(lambda s, d: (lambda x: Y.confirm(x, x.filter(WANTED))[0].select("id", "status"))(_discoveries(s, d)))
query("k13_confirmed_relations", f"""{W('found', 'predicates')}, t AS (SELECT kind, predicate, subject_id, object_id FROM found JOIN predicates USING (kind) WHERE status = 'pending' AND {WANTED})
SELECT subject_id, predicate, object_id FROM t UNION ALL SELECT object_id, predicate, subject_id FROM t WHERE kind = 'near-duplicate-cluster'""")(lambda s, d: (lambda x: Y.confirm(x, x.filter(WANTED))[2])(_discoveries(s, d)))
query("k14_k16_reject_kind", f"{W('found', 'rule_facts')}, {NEGATIVE} SELECT subject_id, predicate, object_id, key, value FROM negative UNION ALL SELECT DISTINCT subject_id, 'derivedFrom', object_id, NULL, NULL FROM found WHERE kind = 'derivedFrom-pattern' AND status = 'pending' AND (subject_id + object_id) % 7 <> 0")(
    lambda s, d: Y.reject_kind(_discoveries(s, d), "derivedFrom-pattern", _negative(s, d))[1].drop("reason"))
query("k15_confirm_kind", f"{W('found')} SELECT kind, CASE WHEN kind = 'near-duplicate-cluster' AND status = 'pending' THEN 'confirmed' ELSE status END AS status, count(*) AS n FROM found GROUP BY 1, 2")(lambda s, d: Y.confirm_kind(_discoveries(s, d), "near-duplicate-cluster")[0].groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n")))
query("k9_k19_status", f"{W('found')} SELECT true AS enabled, (SELECT count(*) FROM found WHERE status = 'pending') AS pending, (SELECT count(*) FROM live) AS live_files")(
    lambda s, d: Y.status(s.createDataFrame([(True,)], "enabled boolean"), _discoveries(s, d), _k(s, d).files, s.createDataFrame([], "name string, status string, files_visited long, discoveries_emitted long, last_error string"))[0])
POP = "SELECT c_mktsegment AS name, 'completed' AS status, count(*) AS files_visited, sum((c_acctbal < 0)::INT)::BIGINT AS discoveries_emitted, NULL::VARCHAR AS last_error FROM customer GROUP BY 1"
query("k19_populator_states", POP)(lambda s, d: Y.status(s.createDataFrame([(True,)], "enabled boolean"), _discoveries(s, d), _k(s, d).files, B.table(s, d, "customer").groupBy(F.col("c_mktsegment").alias("name")).agg(
    F.first(F.lit("completed")).alias("status"), F.count(F.lit(1)).alias("files_visited"), F.count_if(F.col("c_acctbal") < 0).alias("discoveries_emitted"), F.first(F.lit(None).cast("string")).alias("last_error")))[1])
B.SQL |= {"told": """SELECT f.id, f.kind, s.path AS subject, o.path AS object, CASE f.kind WHEN 'derivedFrom-pattern' THEN 'derived from' WHEN 'backupOf-pair' THEN 'backup of' END AS predicate, f.confidence
 FROM found f JOIN doc_files s ON s.file_id = f.subject_id JOIN doc_files o ON o.file_id = f.object_id WHERE f.kind <> 'near-duplicate-cluster' AND f.subject_id % 10 <> 0"""}
B.NEEDS |= {"told": ["found", "doc_files"]}


def _findings(s: SparkSession, d: str) -> DataFrame:
    """Findings parsed from payloads, of which a tenth is malformed."""
    to = _k(s, d).files.select("file_id", "path")
    named = _discoveries(s, d).join(to.toDF("subject_id", "subject_path"), "subject_id").join(to.toDF("object_id", "object_path"), "object_id")
    derived, pair = F.struct(F.col("subject_path").alias("derivative_path"), F.col("object_path").alias("source_path")), F.struct(F.col("subject_path").alias("backup_path"), F.col("object_path").alias("origin_path"))
    payload = F.when(F.col("subject_id") % 10 == 0, F.lit('{"derivative_path": "/cut')).when(F.col("kind") == "derivedFrom-pattern", F.to_json(derived)).otherwise(F.to_json(pair))
    return Y.parse_findings(named.withColumn("payload", payload))


query("k20_findings", f"{W('told')} SELECT * FROM told")(_findings)
DUPS = "SELECT content_hash AS hash, path FROM live WHERE (size, content_hash) IN (SELECT (size, content_hash) FROM live GROUP BY size, content_hash HAVING count(*) > 1)"


def _dup_paths(s: SparkSession, d: str) -> DataFrame:
    f = C.live(_k(s, d).files)
    shared = f.groupBy("size", "content_hash").count().filter("count > 1")
    return f.join(shared, ["size", "content_hash"], "left_semi").select(F.col("content_hash").alias("hash"), "path")


UNDER = "({0} = {1} OR starts_with({0}, {1} || '/'))"
ANY = " OR ".join(UNDER.format(a, b) for e in ("t.subject", "t.object") for a, b in (("g.path", e), (e, "g.path")))
query("j23_path_overlap", f"{W('told')}, g AS ({DUPS}) SELECT DISTINCT g.hash, t.id FROM g JOIN told t ON {ANY}")(lambda s, d: Y.shared_paths(_dup_paths(s, d), _findings(s, d)))
query("j23_tree_overlap", f"{W('told')}, g AS ({DUPS}) SELECT DISTINCT g.hash, t.id FROM g JOIN told t ON {ANY}")(lambda s, d: Y.shared_paths_by_tree(_dup_paths(s, d), _findings(s, d)))


def _board(s: SparkSession, d: str) -> DataFrame:
    f = _findings(s, d)
    hubs = f.groupBy(F.col("object").alias("path")).count().filter("count >= 2")
    pins = s.createDataFrame([("/corpus/Backup",), ("/corpus/Designs",)], "path string")
    removed = f.filter("length(id) % 5 = 0").select(F.concat(F.lit("finding:"), "id", F.lit("~source")).alias("key"))
    labels = f.filter("length(id) % 4 = 0").select(F.concat(F.lit("finding:"), "id", F.lit("~/corpus/Designs")).alias("key"), F.lit("mine").alias("label"))
    drawn = s.createDataFrame([("e1", "pin:/corpus/Backup", "pin:/corpus/Designs", "see also")], "key string, source string, target string, label string")
    return Y.board_edges(f, hubs, pins, _dup_paths(s, d), removed, labels, drawn)


query("k21_board_edges", f"""{W('told')}, g AS ({DUPS}), h AS (SELECT object AS path FROM told GROUP BY 1 HAVING count(*) >= 2), p AS (SELECT unnest(['/corpus/Backup', '/corpus/Designs']) AS path),
e AS (SELECT DISTINCT concat('finding:', t.id, '~', p.path) AS key, concat('finding:', t.id) AS source, concat('pin:', p.path) AS target, t.predicate AS label, t.confidence >= 0.85 AS strong FROM told t JOIN p ON {UNDER.format('t.subject', 'p.path')} OR {UNDER.format('t.object', 'p.path')}
 UNION ALL SELECT concat('finding:', t.id, '~source'), concat('finding:', t.id), concat('source:', t.object), t.predicate, t.confidence >= 0.85 FROM told t JOIN h ON h.path = t.object
 UNION ALL SELECT DISTINCT concat('dup:', g.hash, '~finding:', t.id), concat('dup:', g.hash), concat('finding:', t.id), 'shares files', false FROM g JOIN told t ON {ANY})
SELECT key, source, target, CASE WHEN key IN (SELECT concat('finding:', id, '~/corpus/Designs') FROM told WHERE length(id) % 4 = 0) THEN 'mine' ELSE label END AS label, strong FROM e WHERE key NOT IN (SELECT concat('finding:', id, '~source') FROM told WHERE length(id) % 5 = 0)
UNION ALL SELECT 'e1', 'pin:/corpus/Backup', 'pin:/corpus/Designs', 'see also', true""")(_board)
query("p0_entities", f"{W('live')}, k AS (SELECT 'File' AS kind, path AS canonical_id, file_id AS id FROM doc_files WHERE file_id % 4 = 0), f AS (SELECT DISTINCT 'File' AS kind, path AS canonical_id FROM live WHERE path NOT IN (SELECT canonical_id FROM k)) SELECT * FROM k UNION ALL SELECT kind, canonical_id, (SELECT max(id) FROM k) + row_number() OVER (ORDER BY substr(md5(concat_ws('|', kind, canonical_id)), 1, 4), kind, canonical_id) FROM f")(
    lambda s, d: (lambda f: KB.ensure_file_entities(f.filter("file_id % 4 = 0").select(F.lit("File").alias("kind"), F.col("path").alias("canonical_id"), F.col("file_id").alias("id")), f))(_k(s, d).files))
query("k2_k3_lookup", f"{W('facts')} SELECT id, value FROM facts WHERE entity_id = (SELECT min(entity_id) FROM facts WHERE key = 'role') AND key = 'role' UNION ALL SELECT -1, 'added'")(
    lambda s, d: (lambda f, one: KB.facts_of(KB.assert_facts(f, s.createDataFrame([(one, "role", "added", -1)], "entity_id long, key string, value string, id long")), one, "role").select("id", "value"))(
        _k(s, d).facts, _k(s, d).facts.filter("key = 'role'").agg(F.min("entity_id")).first()[0]))
query("k6_inbound_outbound", f"{W('relations')} SELECT subject_id, object_id FROM relations WHERE object_id = 2 AND predicate = 'partOf' UNION ALL SELECT subject_id, object_id FROM relations WHERE subject_id = 3 AND predicate = 'partOf'")(
    lambda s, d: (lambda r: KB.inbound(r, 2, "partOf").union(KB.outbound(r, 3, "partOf")).select("subject_id", "object_id"))(_k(s, d).relations))
query("a28_populator_counters", f"{W('rule_facts')} SELECT (SELECT count(*) FROM live) AS files, (SELECT count(*) FROM rule_facts) AS found, count(*) AS asserted, (SELECT count(*) FROM rule_facts) - count(*) AS skipped FROM rule_facts WHERE entity_id % 4 <> 1")(lambda s, d: _counters(s, d))


def _counters(s: SparkSession, d: str) -> DataFrame:
    known = _k(s, d).rule_facts.filter("entity_id % 4 = 1")
    new, seen = O.counted_rules(_k(s, d).files, known.limit(0), known, N)
    new.write.format("noop").mode("overwrite").save()
    files, found, asserted = (seen[n].get["n"] for n in ("files", "found", "new"))
    return s.createDataFrame([(files, found, asserted, found - asserted)], "files long, found long, asserted long, skipped long")


# Contents ------------------------------------------------------------------------

TITLE = "concat('T', file_id)"
CONTENT = {
    "pdf": "encode(concat('%PDF-1.4 /Info << /Title (Doc ', file_id, '\\\\) part) >> (x)'), 'UTF-8')",
    "jpg": "concat(unhex('FFD8'), encode(concat('..', lpad(file_id % 10000, 4, '0'), ':05:03 10:11:12 2000:01:01 00:00:00'), 'UTF-8'))",
    "zip": "unhex(concat('504B050600000000', '0000', lpad(hex(file_id % 256), 2, '0'), lpad(hex(file_id DIV 256 % 256), 2, '0'), repeat('00', 10)))",
    "mp3": f"concat(encode('ID3', 'UTF-8'), unhex(concat('030000', lpad(hex(length({TITLE}) + 11), 8, '0'))), encode('TIT2', 'UTF-8'), unhex(concat(lpad(hex(length({TITLE}) + 1), 8, '0'), '000003')), encode({TITLE}, 'UTF-8'))",
}


def _contents(s: SparkSession, d: str) -> DataFrame:
    cases = " ".join(f"WHEN '{ext}' THEN {sql}" for ext, sql in CONTENT.items())
    return C.live(_k(s, d).files).select("file_id", "extension", F.expr(f"CASE extension {cases} END").alias("content"))


query("e1_e5_extracted_facts", f"""{W('live')}, e AS (SELECT file_id, 'title' AS key, concat('Doc ', file_id, ') part') AS value, 'extractor:pdf' AS source, 0.9 AS c FROM live WHERE extension = 'pdf'
 UNION ALL SELECT file_id, 'capturedAt', concat(lpad((file_id % 10000)::VARCHAR, 4, '0'), ':05:03 10:11:12'), 'extractor:exif', 0.85 FROM live WHERE extension = 'jpg'
 UNION ALL SELECT file_id, 'archiveEntryCount', (file_id % 65536)::VARCHAR, 'extractor:zip-central-directory', 1.0 FROM live WHERE extension = 'zip'
 UNION ALL SELECT file_id, 'origin', 'archive-extracted', 'extractor:zip-central-directory', 0.5 FROM live WHERE extension = 'zip'
 UNION ALL SELECT file_id, 'title', concat('T', file_id), 'extractor:id3', 0.9 FROM live WHERE extension = 'mp3') SELECT file_id AS entity_id, key, value, source, CAST(CAST(c AS FLOAT) AS DOUBLE) AS confidence FROM e""")(lambda s, d: X.extracted_facts(_contents(s, d)))
query("e1_displayed_facts", f"{W('facts')}, h AS (SELECT entity_id FROM facts WHERE key = 'sensitivity' AND confidence >= 0.5 AND value IN ('private', 'restricted')) SELECT file_id AS entity_id, file_id NOT IN (SELECT entity_id FROM h) AS display FROM live WHERE extension = 'mp3' OR extension = 'pdf'")(
    lambda s, d: X.displayed_facts(X.extracted_facts(_contents(s, d).filter("extension IN ('mp3', 'pdf')")), KB.resolve(_k(s, d).facts)).select("entity_id", "display"))


def _images(s: SparkSession, d: str) -> DataFrame:
    text = B.table(s, d, "documents").select(F.col("doc_id").alias("file_id"), F.encode("text", "UTF-8").alias("content"))
    return X.image_hashes(C.live(_k(s, d).files).select("file_id", "extension").join(text, "file_id"))


_MEANS = "list_transform(range(0, {n}), lambda i: list_sum(b[(i * len(b) // {n} + 1):(least(greatest((i + 1) * len(b) // {n}, i * len(b) // {n} + 1), len(b)))]) // greatest(1, least(greatest((i + 1) * len(b) // {n}, i * len(b) // {n} + 1), len(b)) - i * len(b) // {n}))"
B.SQL |= {
    "hexed": "SELECT file_id, hex(encode(text)) AS h FROM live JOIN documents ON doc_id = file_id WHERE extension IN ('jpg', 'png') AND octet_length(encode(text)) > 0",
    "octets": "SELECT file_id, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::INT) AS b FROM hexed",
    "means": f"SELECT file_id, {_MEANS.format(n=64)} AS m, {_MEANS.format(n=65)} AS n FROM octets",
    "image_bits": "SELECT file_id AS id, array_to_string(list_transform(m, lambda x: CASE WHEN x >= list_sum(m) // 64 THEN '1' ELSE '0' END), '') AS a, array_to_string(list_transform(range(1, 65), lambda i: CASE WHEN n[i + 1] >= n[i] THEN '1' ELSE '0' END), '') AS b FROM means",
}
B.NEEDS |= {"hexed": ["live"], "octets": ["hexed"], "means": ["octets"], "image_bits": ["means"]}
_BITS = lambda c: F.reverse(F.lpad(F.bin(c), 64, "0")).alias(c)
query("v1_v3_image_hashes", f"{W('image_bits')} SELECT id, a, b FROM image_bits")(lambda s, d: _images(s, d).select("id", _BITS("a"), _BITS("b")))
query("v4_near_images", f"{W('image_bits')} SELECT l.id AS left_id, r.id AS right_id, hamming(l.a || l.b, r.a || r.b)::INTEGER AS distance, least(x.size, y.size) AS bytes FROM image_bits l JOIN image_bits r ON l.id < r.id AND hamming(l.a || l.b, r.a || r.b) <= 10 JOIN live x ON x.file_id = l.id JOIN live y ON y.file_id = r.id")(
    lambda s, d: (lambda p, f: p.join(f.toDF("left_id", "x"), "left_id").join(f.toDF("right_id", "y"), "right_id").select("left_id", "right_id", "distance", F.least("x", "y").alias("bytes")))(KB.near_pairs(_images(s, d)), _k(s, d).files.select("file_id", "size")))


def _bytes(s: SparkSession, d: str) -> DataFrame:
    """Document files with their texts as contents, the longest of them repeated so that they are sampled."""
    text = F.when(F.col("n_chars") > 20_000, F.repeat("text", 8)).otherwise(F.col("text"))
    content = B.table(s, d, "documents").select(F.col("doc_id").alias("file_id"), F.encode(text, "UTF-8").alias("content"))
    return _k(s, d).files.drop("content_hash").join(content, "file_id").withColumn("size", F.coalesce(F.length("content"), F.lit(0)).cast("long"))


query("d4_d7_staged_hashes")(lambda s, d: D.staged_hashes(_bytes(s, d), "content"))
query("d11_refined")(lambda s, d: D.refine(_bytes(s, d).withColumns({c: F.lit(None).cast("string") for c in ("partial_hash", "sample_hash", "full_hash", "hash_algorithm")} | {"hash_state": F.lit(0)}), source="content")[0].drop("content"))
query("s1_s25_crawl")(lambda s, d: filesystem.files_of(filesystem.crawl(s, [d])).select("name", "extension", "size", "media_kind"))

# Lists, recommendations, the overview ----------------------------------------------

SHARES = "100.0 * coalesce(sum({1}) FILTER (WHERE band IN ({0})), 0) / sum({1})"
BAND = f"CASE WHEN modified_at IS NULL THEN 'unknown' {' '.join(f'WHEN {N} - modified_at < {limit} THEN {band!r}' for band, limit in paths.AGE_BANDS)} ELSE 'gt2yr' END"
query("a20_age_shares", f"""{W('live')}, b AS (SELECT {BAND} AS band, count(*) AS n, sum(size) AS z FROM live GROUP BY 1) SELECT {SHARES.format("'6to12mo', '1to2yr', 'gt2yr'", 'n')} AS old_files, {SHARES.format("'1to2yr', 'gt2yr'", 'z')} AS old_bytes FROM b""")(
    lambda s, d: C.age_shares(C.age_bands(_k(s, d).files, N)))
query("t9_candidates_sorted", f"{W('candidates')} SELECT file_id, size, row_number() OVER (ORDER BY size DESC, file_id)::INTEGER AS place FROM candidates QUALIFY place <= 100")(
    lambda s, d: Q._candidates(s, d).orderBy(F.desc("size"), "file_id").limit(100).withColumn("place", F.row_number().over(C.Window.orderBy(F.desc("size"), "file_id"))).select("file_id", "size", "place"))
for _by, _order in (("size", "size DESC, file_id"), ("oldest", "modified_at ASC NULLS LAST, size DESC, file_id")):
    query(f"t10_sort_{_by}", f"{W('live')} SELECT file_id FROM live ORDER BY {_order} LIMIT 200")(lambda s, d, by=_by: C.sorted_files(_k(s, d).files, by).select("file_id"))
_OFFER = "SELECT path, reclaimable_bytes FROM lens l WHERE cleanup_reason IN ({0}) AND reclaimable_bytes > 0 AND path <> '/corpus' AND NOT EXISTS (SELECT 1 FROM lens p WHERE p.cleanup_reason IN ({0}) AND p.reclaimable_bytes > 0 AND p.path <> '/corpus' AND starts_with(l.path, p.path || '/'))"
_GROUPS = " UNION ALL ".join(f"SELECT '{g}' AS \"group\", '{risk}' AS risk, path, reclaimable_bytes AS bytes, NULL AS age FROM ({_OFFER.format(', '.join(repr(r) for r in reasons))})" for g, reasons, risk in K.GROUPS)
_STALE = f"SELECT 'stale', 'caution', path, size, CASE WHEN ({N} - modified_at) / 86400 >= 365 THEN printf('%.1f yr', ({N} - modified_at) / 86400 / 365) ELSE concat(floor(({N} - modified_at) / 86400 / 30 + 0.5)::BIGINT, ' mo') END FROM (SELECT * FROM live WHERE modified_at < {N - 365 * 86400} ORDER BY size DESC, file_id LIMIT 8)"
query("l4_recommendations", f"{Q.LENS} {_GROUPS} UNION ALL {_STALE}")(lambda s, d: K.recommendations(Q._kept_lens(s, d), _k(s, d).files, N, "/corpus"))
query("l4_total", f"{Q.LENS}, i AS ({_GROUPS} UNION ALL {_STALE}), w AS (SELECT coalesce(sum(size * (n - 1)), 0) AS waste FROM (SELECT size, count(*) AS n FROM live WHERE size > 0 GROUP BY size, content_hash HAVING count(*) > 1)) SELECT (coalesce((SELECT sum(bytes) FROM i), 0) + waste)::BIGINT AS total_bytes, waste::BIGINT AS waste FROM w")(
    lambda s, d: K.recommended_total(K.recommendations(Q._kept_lens(s, d), _k(s, d).files, N, "/corpus"), D.groups(_k(s, d).files.withColumns({c: F.col("content_hash") for c in ("partial_hash", "sample_hash", "full_hash")}))))
TURN = "(file_id // 12 % 6)"


def _executed(s: SparkSession, d: str) -> tuple:
    found = Q._candidates(s, d)
    turn = F.expr("file_id DIV 12 % 6")
    error = F.when(turn == 0, "locked").when(turn == 3, "disk full").alias("error")
    return K.execute(found, 7, N, -5, found.select("file_id", error, F.when(turn != 0, turn != 3).alias("logged")), _k(s, d).files)


query("c3_settled_log", f"{W('candidates')} SELECT file_id, CASE WHEN {TURN} = 3 THEN 'pending' ELSE 'in_recycle_bin' END AS restore_status, {N}::BIGINT AS expires_at FROM candidates WHERE {TURN} <> 0")(lambda s, d: _executed(s, d)[0].select("file_id", "restore_status", "expires_at"))
query("c3_failures", f"{W('candidates')} SELECT file_id, path, CASE WHEN {TURN} = 3 THEN 'trashed, but bookkeeping failed: disk full' ELSE 'locked' END AS reason FROM candidates WHERE {TURN} IN (0, 3)")(lambda s, d: _executed(s, d)[1])
query("c3_deleted_files", f"{W('candidates')} SELECT file_id, CASE WHEN {TURN} NOT IN (0, 3) AND file_id IN (SELECT file_id FROM candidates) THEN {N} ELSE deleted_at END AS deleted_at FROM doc_files")(lambda s, d: _executed(s, d)[2].select("file_id", F.col("deleted_at").cast("int").alias("deleted_at")))
query("g1_accessed", f"{W('top', 'relations', 'stage')} SELECT file_id FROM live WHERE coalesce(CASE WHEN file_id % 2 = 0 THEN modified_at + 200 * 86400 END, modified_at) < {N - 365 * 86400} AND file_id IN (SELECT file_id FROM stage WHERE lifecycle IN ('finished', 'archived')) AND {Q.SHOWN}")(
    lambda s, d: (lambda k: K.saved_view("finished-untouched", k.files.withColumn("accessed_at", F.when(F.col("file_id") % 2 == 0, F.col("modified_at") + 200 * paths.DAY)), k.facts, k.relations, k.lifecycles, N).select("file_id"))(_k(s, d)))
AGED = "(file_id * 37 % 1200 - 5)"
query("u9_counts_and_ages", f"""{W('doc_files')}, a AS (SELECT file_id, {AGED} AS days FROM doc_files) SELECT file_id, format('{{:,}}', file_id * 1234) AS n, CASE WHEN days <= 0 THEN 'today' WHEN days < 365 THEN concat(days, 'd ago') WHEN days % 365 > 0 THEN concat(days // 365, 'y ', days % 365, 'd ago') ELSE concat(days // 365, 'y ago') END AS age FROM a""")(
    lambda s, d: _k(s, d).files.select("file_id", paths.format_count(F.col("file_id") * 1234).alias("n"), paths.format_age(F.expr(AGED)).alias("age")))
query("u10_names", f"{W('doc_files')} SELECT file_id, CASE WHEN file_id % 3 = 0 THEN 'Root' ELSE folder_path END AS folder, CASE WHEN file_id % 3 = 0 OR extension = '' THEN '(none)' ELSE extension END AS ext FROM doc_files")(
    lambda s, d: (lambda f, bare: f.select("file_id", paths.folder_of(F.when(bare, F.lit("name")).otherwise(F.col("path"))).alias("folder"), paths.shown_extension(F.when(bare, F.lit("name")).otherwise(F.col("name"))).alias("ext")))(_k(s, d).files, F.col("file_id") % 3 == 0))
query("u4_windows_paths", f"{W('doc_files')} SELECT DISTINCT concat('C:', replace(folder_path, '/', '\\')) AS p, (2 + len(string_split(ltrim(folder_path, '/'), '/')))::INTEGER AS depth, concat('C:', replace(regexp_replace(folder_path, '/[^/]*$', ''), '/', '\\')) AS parent, (1 + len(string_split(ltrim(folder_path, '/'), '/')))::INTEGER AS ups FROM doc_files")(
    lambda s, d: _k(s, d).files.select(F.concat(F.lit("C:"), F.replace("folder_path", F.lit("/"), F.lit("\\"))).alias("p")).distinct().select("p", paths.depth(F.col("p")).alias("depth"), paths.parent(F.col("p")).alias("parent"), F.size(paths.ancestors(F.col("p"))).alias("ups")))
query("u14_number_text", f"{W('derived')} SELECT derivative_id, source_id, (size_ratio)::VARCHAR AS ratio FROM derived")(lambda s, d: _k(s, d).derived.select("derivative_id", "source_id", paths.number_text(F.col("size_ratio")).alias("ratio")))
ISSUES_SQL = "SELECT event_id AS id, user_id % 3 AS scan_id, CASE WHEN event_id % 2 = 0 THEN 'walk' ELSE 'hash' END AS phase, floor(epoch(ts))::BIGINT AS created_at FROM events"


def _parts(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """The parts of the overview of the document files."""
    files = _k(s, d).files.withColumns({c: F.col("content_hash") for c in ("partial_hash", "sample_hash", "full_hash")})
    issues = B.table(s, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 3).alias("scan_id"), F.when(F.col("event_id") % 2 == 0, "walk").otherwise("hash").alias("phase"), F.unix_timestamp("ts").alias("created_at"))
    sessions = issues.groupBy(F.col("scan_id").alias("id")).agg(F.max("created_at").alias("started_at"), F.count_if(F.col("phase") == "walk").alias("inaccessible_entries"))
    return O.overview(files, sessions, issues, N, limit=40)


def _overview(s: SparkSession, d: str) -> DataFrame:
    """How many rows each part of the overview has."""
    out = None
    for name, part in _parts(s, d).items():
        one = part.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("rows"))
        out = one if out is None else out.union(one)
    return out


query("t11_overview", f"""{W('live')}, up AS (SELECT DISTINCT unnest(CAST(list_transform(range(len(p), 0, -1), lambda i: '/' || array_to_string(p[1:i], '/')) AS VARCHAR[])) AS path FROM (SELECT string_split(ltrim(folder_path, '/'), '/') AS p FROM live WHERE size > 0)),
m AS (SELECT DISTINCT strftime(make_timestamp(modified_at * 1000000), '%Y-%m') AS b FROM live)
SELECT unnest(['session', 'largest_folders', 'largest_files', 'extensions', 'duplicate_groups', 'media', 'folder_media', 'timeline', 'ages', 'issue_counts']) AS part,
 unnest([1, least(40, (SELECT count(*) FROM up)), least(40, (SELECT count(*) FROM live WHERE size > 0)), least(40, (SELECT count(*) FROM (SELECT extension FROM live GROUP BY 1 HAVING sum(size) > 0))), least(40, (SELECT count(*) FROM (SELECT 1 FROM live WHERE size > 0 AND content_hash IS NOT NULL GROUP BY size, content_hash HAVING count(*) > 1))),
 (SELECT count(DISTINCT media_kind) FROM live), least(240, (SELECT count(*) FROM (SELECT DISTINCT folder_path, media_kind FROM live))), (SELECT count(*) FROM m WHERE b BETWEEN '2021-11' AND '2023-11'), (SELECT count(DISTINCT {BAND}) FROM live), 1])::BIGINT AS rows""")(_overview)


PART = "SELECT '{}' AS part, {} AS key, {} AS n, {} AS bytes FROM ({})"
_SUMS = "count(*) AS n, sum(size)::BIGINT AS b"
query("t11_contents", f"""{W('live')}, up AS (SELECT unnest(CAST(list_transform(range(len(p), 0, -1), lambda i: '/' || array_to_string(p[1:i], '/')) AS VARCHAR[])) AS path, size FROM (SELECT string_split(ltrim(folder_path, '/'), '/') AS p, size FROM live))
{" UNION ALL ".join(PART.format(*x) for x in (
    ("largest_folders", "path", "n", "b", f"SELECT path, {_SUMS} FROM up GROUP BY 1 HAVING sum(size) > 0 ORDER BY b DESC, path LIMIT 40"),
    ("largest_files", "path", "1", "size", "SELECT path, size FROM live WHERE size > 0 ORDER BY size DESC, file_id LIMIT 40"),
    ("extensions", "extension", "n", "b", f"SELECT extension, {_SUMS} FROM live WHERE extension IS NOT NULL GROUP BY 1 HAVING sum(size) > 0 ORDER BY b DESC, extension LIMIT 40"),
    ("duplicate_groups", "content_hash", "n", "size * (n - 1)", "SELECT size, content_hash, count(*) AS n FROM live WHERE size > 0 AND content_hash IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY size * (n - 1) DESC, content_hash LIMIT 40"),
    ("media", "media_kind", "n", "b", f"SELECT media_kind, {_SUMS} FROM live GROUP BY 1"),
    ("folder_media", "concat(folder_path, '|', media_kind)", "n", "b", f"SELECT folder_path, media_kind, {_SUMS} FROM live GROUP BY 1, 2 ORDER BY b DESC, folder_path, media_kind LIMIT 240"),
    ("timeline", "m", "n", "b", f"SELECT strftime(make_timestamp(modified_at * 1000000), '%Y-%m') AS m, {_SUMS} FROM live GROUP BY 1 HAVING m BETWEEN '2021-11' AND '2023-11'"),
    ("ages", "band", "n", "b", f"SELECT {BAND} AS band, {_SUMS} FROM live GROUP BY 1"),
))}""")(lambda s, d: _overview_rows(s, d))


def _overview_rows(s: SparkSession, d: str) -> DataFrame:
    """The rows of the overview's parts, not their counts."""
    parts = _parts(s, d)
    one = F.lit(1).cast("long")
    shown = {
        "largest_folders": ("path", "total_files", "total_bytes"), "largest_files": ("path", one, "size"), "extensions": ("extension", "file_count", "total_bytes"), "duplicate_groups": ("partial_hash", "members", "reclaimable_bytes"),
        "media": ("media_kind", "file_count", "total_bytes"), "folder_media": (F.concat_ws("|", "folder_path", "media_kind"), "file_count", "total_bytes"), "timeline": ("bucket", "file_count", "total_bytes"), "ages": ("band", "file_count", "total_bytes"),
    }
    column = lambda c: F.col(c) if isinstance(c, str) else c
    rows = [parts[name].select(F.lit(name).alias("part"), *[column(c).alias(n) for c, n in zip(of, ("key", "n", "bytes"), strict=True)]) for name, of in shown.items()]
    out = rows[0]
    for other in rows[1:]:
        out = out.union(other)
    return out


def _log(s: SparkSession, d: str) -> DecisionLog:
    """A log of pins: users are the files, some of their events pin and others unpin them."""
    events = B.table(s, d, "events")
    none = lambda t: F.lit(None).cast(t)
    action = F.when(F.length("event_type") % 2 == 0, "pin").otherwise("unpin")
    rows = events.select(action.alias("action"), F.col("user_id").alias("subject_id"), none("string").alias("predicate"), none("long").alias("object_id"), none("string").alias("key"), none("string").alias("value"),
                         none("string").alias("discovery_id"), none("string").alias("reason"), F.col("event_id").alias("at"))
    log = DecisionLog(s, f"{shared.root(s)}/decisions-{uuid.uuid4().hex}")
    for part in range(3):  # in three batches, then compacted
        log.append(rows.filter((F.col("at") > F.lit(part * 300)) & (F.col("at") <= F.lit(300 * (part + 1) if part < 2 else 1 << 60)) | (F.col("at") <= 0) & F.lit(part == 0)))
    log.compact()
    return log


query("k8_pins_of_a_log", "SELECT user_id AS file_id, event_id AS pinned_at FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND length(event_type) % 2 = 0")(
    lambda s, d: _log(s, d).pinned().select("file_id", "pinned_at"))

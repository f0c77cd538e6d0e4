"""Queries over facts, relations, cleanup, views and the folder lens.

Facts are the rules' assertions on the document files, H6 and H7; relations are
the pairs of H1 and H4, membership of projects (file_id % 5; some files are in
two) and backups of origins that are unknown. See :mod:`shelfmark.sources.knowledge`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import paths
from shelfmark.operators import catalog as C
from shelfmark.operators import cleanup as K
from shelfmark.operators import facts as KB
from shelfmark.plans.registry import query
from shelfmark.sources import bindings as B
from shelfmark.sources import knowledge, shared

N = B.AS_OF
STAGES = [name for name, _, _ in knowledge.STAGES]
BITS, NEAR = 62, 18


def load() -> None:
    """Importing this module registers its queries."""


def _files(s: SparkSession, d: str) -> DataFrame:
    return B.doc_files(s, d)


def _rule_facts(s: SparkSession, d: str) -> DataFrame:
    return knowledge.of(s, d).rule_facts


def _relations(s: SparkSession, d: str) -> DataFrame:
    return knowledge.of(s, d).relations


def _facts(s: SparkSession, d: str) -> DataFrame:
    return knowledge.of(s, d).facts


def _lifecycles(s: SparkSession, d: str) -> DataFrame:
    return knowledge.of(s, d).lifecycles


def _pinned(s: SparkSession, d: str) -> DataFrame:
    return knowledge.of(s, d).pinned


# SQL of the same tables -------------------------------------------------------

def _rule_sql() -> str:
    parts = []
    for i, r in enumerate(KB.RULES):
        if r.on == "extension":
            cond = f"lower(extension) IN ({', '.join(repr(x) for x in r.pattern.split())})"
        else:
            cond = f"regexp_matches({r.on}, '{r.pattern}')"
        parts.append(f"SELECT file_id AS entity_id, '{r.key}' AS key, '{r.value}' AS value, '{r.id}' AS source, CAST(CAST({r.confidence} AS FLOAT) AS DOUBLE) AS confidence, {str(r.display).lower()} AS display, {N}::BIGINT AS asserted_at, file_id * 100 + {i} AS id FROM live WHERE {cond}")
    return " UNION ALL ".join(parts)


STEM = "lower(trim(regexp_replace(trim({}), '\\.[^.]*$', '')))"
B.SQL |= {
    "rule_facts": _rule_sql(),
    "derived": f"""SELECT dv.file_id AS derivative_id, sr.file_id AS source_id, dv.size / sr.size AS size_ratio, dv.size AS bytes,
 CAST(CAST(least(round(0.5 + CASE WHEN dv.size / sr.size BETWEEN 0.1 AND 1.0 THEN 0.2 ELSE 0 END + CASE WHEN sr.ext IN ('psd', 'ai') THEN 0.15 ELSE 0 END + CASE WHEN dv.ext IN ('png', 'jpg', 'jpeg') THEN 0.1 ELSE 0 END, 2), 0.95) AS FLOAT) AS DOUBLE) AS confidence
 FROM stems dv JOIN stems sr ON dv.folder_path = sr.folder_path AND dv.file_id <> sr.file_id AND dv.ext <> sr.ext AND sr.size > 0 AND dv.modified_at > sr.modified_at AND sr.stem <> ''
 AND (dv.stem = sr.stem OR (starts_with(dv.stem, sr.stem) AND substr(dv.stem, length(sr.stem) + 1, 1) IN (' ', '_', '-', '.', '(', '['))) AND dv.size / sr.size BETWEEN 0.05 AND 50.0""",
    "stems": f"SELECT *, lower(coalesce(extension, '')) AS ext, {STEM.format('name')} AS stem, trim(regexp_replace({STEM.format('name')}, '[ _-](backup|copy)$', '')) AS bstem FROM live",
    "backups": """SELECT b.file_id AS backup_id, o.file_id AS origin_id, b.size / o.size AS size_ratio, CAST(CAST(0.7 AS FLOAT) AS DOUBLE) AS confidence, b.size AS bytes
 FROM stems b JOIN stems o ON (o.stem = b.bstem OR (starts_with(o.stem, b.bstem) AND substr(o.stem, length(b.bstem) + 1, 1) IN (' ', '_', '-'))) AND b.folder_path <> o.folder_path AND o.size > 0 AND b.size / o.size BETWEEN 0.5 AND 2.0
 WHERE strlen(b.bstem) >= 3 AND b.file_id IN (SELECT entity_id FROM rule_facts WHERE key = 'role' AND value = 'backup') AND o.file_id NOT IN (SELECT entity_id FROM rule_facts WHERE key = 'role' AND value = 'backup') AND NOT regexp_matches(o.stem, '[ _-](backup|copy)$')""",
    "relations": """SELECT derivative_id AS subject_id, 'derivedFrom' AS predicate, source_id AS object_id FROM derived UNION ALL SELECT backup_id, 'backupOf', origin_id FROM backups
 UNION ALL SELECT file_id, 'partOf', file_id % 5 FROM doc_files WHERE file_id % 5 <> 1 AND file_id % 7 < 5
 UNION ALL SELECT file_id, 'partOf', (file_id + 2) % 5 FROM doc_files WHERE file_id % 11 = 3 AND file_id % 7 < 5 UNION ALL SELECT file_id, 'backupOf', -1 FROM doc_files WHERE file_id % 12 = 2 AND file_id % 5 = 4""",
    "facts": f"""SELECT entity_id, key, value, source, confidence, display, asserted_at, id FROM rule_facts UNION ALL SELECT DISTINCT derivative_id, 'role', 'derivative', 'user', 1.0::DOUBLE, true, {N + 1}, derivative_id * 100 + 50 FROM derived
 UNION ALL SELECT DISTINCT derivative_id, 'replaceability', 'regenerable', 'heuristic:regenerable', CAST(CAST(0.95 AS FLOAT) AS DOUBLE), true, {N}, derivative_id * 100 + 51 FROM derived WHERE derivative_id % 3 <> 0""",
    "lifecycles": f"SELECT unnest(range(5)) AS project_id, unnest({STAGES}) AS lifecycle, unnest({[c for _, c, _ in knowledge.STAGES]}::DOUBLE[]) AS lconf, unnest({str([x for *_, x in knowledge.STAGES]).lower()}) AS lshown",
    "top": "SELECT entity_id, key, value, confidence, display FROM facts QUALIFY row_number() OVER (PARTITION BY entity_id, key ORDER BY confidence DESC, asserted_at DESC, id DESC) = 1",
    "stage": "SELECT subject_id AS file_id, project_id, lifecycle, lconf, lshown FROM relations JOIN lifecycles ON object_id = project_id WHERE predicate = 'partOf'",
    "candidates": """SELECT file_id, path, size, reason FROM (SELECT l.file_id, l.path, l.size,
 CASE WHEN r.value = 'derivative' AND p.value = 'regenerable' AND EXISTS (SELECT 1 FROM relations x JOIN live o ON o.file_id = x.object_id WHERE x.predicate = 'derivedFrom' AND x.subject_id = l.file_id) THEN 'safe-derivative'
 WHEN r.value = 'backup' AND EXISTS (SELECT 1 FROM relations x JOIN live o ON o.file_id = x.object_id WHERE x.predicate = 'backupOf' AND x.subject_id = l.file_id) THEN 'redundant-backup'
 WHEN r.value = 'scratch' AND r.confidence >= 0.9 THEN 'scratch'
 WHEN r.value = 'derivative' AND EXISTS (SELECT 1 FROM stage t WHERE t.file_id = l.file_id AND t.lifecycle IN ('finished', 'archived')) THEN 'finished-project-cruft' END AS reason
 FROM live l LEFT JOIN top r ON r.entity_id = l.file_id AND r.key = 'role' LEFT JOIN top p ON p.entity_id = l.file_id AND p.key = 'replaceability' LEFT JOIN top s ON s.entity_id = l.file_id AND s.key = 'sensitivity'
 WHERE NOT coalesce(s.value IN ('private', 'restricted'), false) AND NOT coalesce(p.value = 'irreplaceable', false) AND NOT coalesce(r.value IN ('source', 'system', 'asset', 'tool'), false)
 AND NOT EXISTS (SELECT 1 FROM stage t WHERE t.file_id = l.file_id AND t.lifecycle = 'active') AND l.file_id % 50 <> 0) WHERE reason IS NOT NULL""",
}
B.NEEDS |= {
    "rule_facts": ["live"], "stems": ["live"], "derived": ["stems"], "backups": ["stems", "rule_facts"], "relations": ["derived", "backups"], "facts": ["rule_facts", "derived"], "top": ["facts"], "stage": ["relations", "lifecycles"],
    "candidates": ["top", "stage"],
}
W = B.with_tables

# Rules and heuristics ---------------------------------------------------------

query("p0_p20_rule_facts", f"{W('rule_facts')} SELECT entity_id, key, value, source, confidence, display FROM rule_facts")(lambda s, d: _rule_facts(s, d).select("entity_id", "key", "value", "source", "confidence", "display"))
query("p24_cursor_scan", f"{W('live')} SELECT file_id, path FROM live WHERE file_id > 500 ORDER BY file_id LIMIT 200")(lambda s, d: C.live(_files(s, d)).filter("file_id > 500").orderBy("file_id").limit(200).select("file_id", "path"))
query("h1_h2_j17_derived_pairs", f"{W('derived')} SELECT derivative_id, source_id, size_ratio, confidence, bytes FROM derived")(lambda s, d: KB.derived_pairs(_files(s, d)))
query("h3_h5_stems", f"{W('stems')} SELECT file_id, stem, bstem FROM stems")(lambda s, d: C.live(_files(s, d)).select("file_id", paths.stem(F.col("name")).alias("stem"), paths.backup_stem(F.col("name")).alias("bstem")))
query("h4_j18_backup_pairs", f"{W('backups')} SELECT backup_id, origin_id, size_ratio, confidence, bytes FROM backups")(lambda s, d: KB.backup_pairs(_files(s, d), _rule_facts(s, d)))
query("h6_regenerable", f"{W('facts', 'relations')} SELECT DISTINCT entity_id, CAST(CAST(0.95 AS FLOAT) AS DOUBLE) AS confidence FROM facts WHERE key = 'role' AND value = 'derivative' AND entity_id IN (SELECT subject_id FROM relations WHERE predicate = 'derivedFrom')")(
    lambda s, d: KB.regenerable(_facts(s, d), _relations(s, d)).select("entity_id", "confidence"))
INSTALLER = "SELECT *, CASE WHEN file_id % 2 = 0 THEN concat('setup_', name) ELSE name END AS n2 FROM live"
query("h7_redownloadable", f"{W('facts')}, i AS ({INSTALLER}) SELECT file_id AS entity_id, 'redownloadable' AS value FROM i WHERE regexp_matches(n2, '(?i)(setup|installer|install[_ .-]?)') AND file_id IN (SELECT entity_id FROM facts WHERE key = 'role' AND value = 'tool')")(
    lambda s, d: KB.redownloadable(_files(s, d).withColumn("name", F.when(F.col("file_id") % 2 == 0, F.concat(F.lit("setup_"), "name")).otherwise(F.col("name"))), _facts(s, d)).select("entity_id", "value"))


def _hashes(s: SparkSession, d: str) -> DataFrame:
    bits = F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("long"), lambda a, i: a * 2 + (F.get("embedding", i) >= 0).cast("long"))
    return B.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), bits.alias("a"), F.lit(0).cast("long").alias("b"))


HASHES = f"SELECT vec_id AS id, list_sum(list_transform(range({BITS}), lambda i: CASE WHEN embedding[i + 1] >= 0 THEN (1::BIGINT << ({BITS - 1} - i)::INT) ELSE 0 END))::BIGINT AS a FROM embeddings"
query("v4_j19_u8_near_pairs", f"WITH h AS ({HASHES}) SELECT l.id AS left_id, r.id AS right_id, bit_count(xor(l.a, r.a))::INTEGER AS distance, CAST(CAST(greatest(0.95::DOUBLE - 0.03::DOUBLE * bit_count(xor(l.a, r.a)), 0.6) AS FLOAT) AS DOUBLE) AS confidence FROM h l JOIN h r ON l.id < r.id AND bit_count(xor(l.a, r.a)) <= {NEAR}")(
    lambda s, d: KB.near_pairs(_hashes(s, d), NEAR, BITS).withColumn("confidence", KB.near_confidence(F.col("distance"))))

query("v4_near_clusters", f"""WITH RECURSIVE h AS MATERIALIZED ({HASHES}), p AS MATERIALIZED (SELECT l.id AS x, r.id AS y FROM h l JOIN h r ON bit_count(xor(l.a, r.a)) <= {NEAR}),
c(id, cluster_id) AS (SELECT id, id FROM h UNION SELECT p.y, c.cluster_id FROM c JOIN p ON p.x = c.id), e AS (SELECT a, min(id) AS class_id FROM h GROUP BY 1)
SELECT h.id, e.class_id, min(c.cluster_id) AS cluster_id FROM c JOIN h USING (id) JOIN e USING (a) GROUP BY 1, 2""")(
    lambda s, d: KB.near_clusters(_hashes(s, d), NEAR, BITS))

# Facts ------------------------------------------------------------------------

PRIO = "CASE WHEN source = 'user' THEN 100 WHEN source LIKE 'extractor:%' THEN 80 WHEN source LIKE 'rule:%' THEN 60 WHEN source LIKE 'heuristic:%' THEN 40 WHEN source = 'phash' THEN 30 WHEN source LIKE 'ml:%' THEN 20 WHEN source = 'system' THEN 10 ELSE 0 END"
query("k4_k5_resolve", f"{W('events_')} SELECT entity_id, key, value, confidence, source FROM events_ QUALIFY row_number() OVER (PARTITION BY entity_id, key ORDER BY confidence DESC, {PRIO} DESC, asserted_at DESC, id DESC) = 1")(lambda s, d: KB.resolve(B.events(s, d)))
query("n2_j12_resolve_plain", f"{W('events_')} SELECT entity_id, key, value, confidence, source FROM events_ QUALIFY row_number() OVER (PARTITION BY entity_id, key ORDER BY confidence DESC, asserted_at DESC, id DESC) = 1")(lambda s, d: KB.resolve(B.events(s, d), by_source=False))
query("k1_upsert_entities", """WITH k AS (SELECT 'User' AS kind, concat('u', user_id) AS canonical_id, min(event_id) AS id FROM events WHERE user_id % 2 = 0 GROUP BY 2), n AS (SELECT DISTINCT CASE WHEN user_id % 3 = 0 THEN 'Actor' ELSE 'User' END AS kind, concat('u', user_id) AS canonical_id FROM events),
f AS (SELECT * FROM n WHERE (kind, canonical_id) NOT IN (SELECT (kind, canonical_id) FROM k)) SELECT * FROM k UNION ALL SELECT kind, canonical_id, (SELECT max(id) FROM k) + row_number() OVER (ORDER BY substr(md5(concat_ws('|', kind, canonical_id)), 1, 4), kind, canonical_id) FROM f""")(
    lambda s, d: (lambda e: KB.upsert_entities(
        e.filter("user_id % 2 = 0").groupBy(F.lit("User").alias("kind"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("canonical_id")).agg(F.min("event_id").alias("id")),
        e.select(F.when(F.col("user_id") % 3 == 0, "Actor").otherwise("User").alias("kind"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("canonical_id"))))(B.table(s, d, "events")))
query("k2_k3_j15_entity_facts", f"{W('facts')} SELECT l.file_id, count(f.id) AS facts FROM live l JOIN facts f ON f.entity_id = l.file_id GROUP BY 1")(
    lambda s, d: C.live(_files(s, d)).join(_facts(s, d), F.col("file_id") == F.col("entity_id")).groupBy("file_id").agg(F.count("id").alias("facts")))
query("k6_relation_degrees", f"{W('relations')} SELECT predicate, count(*) AS n, count(DISTINCT subject_id) AS subjects, count(DISTINCT object_id) AS objects FROM relations GROUP BY 1")(
    lambda s, d: _relations(s, d).groupBy("predicate").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("subject_id").alias("subjects"), F.count_distinct("object_id").alias("objects")))
query("k7_k10_emit_facts", f"{W('rule_facts')} SELECT entity_id, key, value, source FROM rule_facts WHERE NOT (entity_id % 7 = 0 AND value = 'scratch') AND entity_id % 4 <> 1")(
    lambda s, d: (lambda f: KB.emit(f, f.filter("entity_id % 4 = 1"), f.filter("entity_id % 7 = 0 AND value = 'scratch'")).select("entity_id", "key", "value", "source"))(_rule_facts(s, d)))
query("k11_emit_relations", f"{W('relations')} SELECT subject_id, predicate, object_id FROM relations WHERE (subject_id + object_id) % 7 <> 0 AND subject_id % 4 <> 1")(
    lambda s, d: (lambda r: KB.emit_relations(r, r.filter("subject_id % 4 = 1"), r.filter("(subject_id + object_id) % 7 = 0")).select("subject_id", "predicate", "object_id"))(_relations(s, d).withColumn("source", F.lit("heuristic:h"))))
query("k8_pinned", "SELECT doc_id AS file_id FROM documents WHERE doc_id % 50 = 0")(lambda s, d: _pinned(s, d))
FOUND = "SELECT 'derivedFrom-pattern' AS kind, derivative_id AS subject_id, source_id AS object_id, size_ratio, confidence, bytes FROM derived UNION ALL SELECT 'backupOf-pair', backup_id, origin_id, size_ratio, confidence, bytes FROM backups"


def _found(s: SparkSession, d: str) -> DataFrame:
    k = knowledge.of(s, d)
    one = k.derived.select(F.lit("derivedFrom-pattern").alias("kind"), F.col("derivative_id").alias("subject_id"), F.col("source_id").alias("object_id"), "size_ratio", "confidence", "bytes")
    return one.union(k.backups.select(F.lit("backupOf-pair"), "backup_id", "origin_id", "size_ratio", "confidence", "bytes"))


query("k12_new_discoveries", f"{W('derived', 'backups')}, f AS ({FOUND}) SELECT kind, subject_id, object_id, size_ratio FROM f WHERE subject_id % 4 <> 2")(lambda s, d: (lambda f: KB.new_discoveries(f, f.filter("subject_id % 4 = 2")).select("kind", "subject_id", "object_id", "size_ratio"))(_found(s, d)))
query("k13_graduated_facts", f"{W('derived', 'backups')}, f AS ({FOUND}) SELECT subject_id AS entity_id, 'role' AS key, CASE kind WHEN 'derivedFrom-pattern' THEN 'derivative' ELSE 'backup' END AS value FROM f")(lambda s, d: KB.graduated(_found(s, d))[0].select("entity_id", "key", "value"))
query("k13_graduated_relations", f"{W('derived', 'backups')}, f AS ({FOUND}) SELECT subject_id, CASE kind WHEN 'derivedFrom-pattern' THEN 'derivedFrom' ELSE 'backupOf' END AS predicate, object_id FROM f")(lambda s, d: KB.graduated(_found(s, d))[1])
query("k14_k16_rejected_pairs", f"{W('derived', 'backups')}, f AS ({FOUND}) SELECT DISTINCT subject_id, CASE kind WHEN 'derivedFrom-pattern' THEN 'derivedFrom' ELSE 'backupOf' END AS predicate, object_id FROM f WHERE (subject_id + object_id) % 7 = 0")(
    lambda s, d: KB.graduated(_found(s, d).filter("(subject_id + object_id) % 7 = 0"))[1].distinct())
query("a14_k15_median_gate", f"{W('derived', 'backups')}, f AS ({FOUND}) SELECT kind, CAST(CAST(median(confidence) AS FLOAT) AS DOUBLE) AS median, count(*) AS pending, CAST(CAST(median(confidence) AS FLOAT) AS DOUBLE) >= CAST(CAST(0.7 AS FLOAT) AS DOUBLE) AS allowed FROM f GROUP BY 1")(
    lambda s, d: KB.confirmable(_found(s, d).withColumn("status", F.lit("pending"))))
query("a16_a24_finding_counts", f"{W('derived', 'backups')}, f AS ({FOUND}) SELECT kind, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM f GROUP BY 1")(lambda s, d: _found(s, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")))
query("a23_finding_clusters", f"{W('derived', 'backups')}, f AS ({FOUND}), n AS (SELECT object_id, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM f GROUP BY 1 HAVING count(*) >= 2) SELECT object_id, n.n, n.bytes, subject_id FROM n JOIN f USING (object_id)")(
    lambda s, d: (lambda f: f.groupBy("object_id").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).filter("n >= 2").join(f.select("object_id", "subject_id"), "object_id"))(_found(s, d)))
query("t7_top_discoveries", f"{W('derived', 'backups')}, f AS ({FOUND}) SELECT kind, subject_id, object_id, bytes FROM f ORDER BY bytes DESC, confidence DESC, kind, subject_id, object_id LIMIT 60")(
    lambda s, d: _found(s, d).orderBy(F.desc("bytes"), F.desc("confidence"), "kind", "subject_id", "object_id").limit(60).select("kind", "subject_id", "object_id", "bytes"))
PLACED = lambda names, by: "CASE " + " ".join(f"WHEN {by} = '{n}' THEN {i}" for i, n in enumerate(names)) + " END"
query("k17_j24_provenance", f"""{W('facts', 'relations')}, a AS (SELECT entity_id AS file_id, string_agg(concat_ws('|', key, value, source, confidence::VARCHAR), ';' ORDER BY place, id) AS facts FROM (SELECT *, {PLACED(KB.PROVENANCE_KEYS, 'key')} AS place FROM facts) WHERE place IS NOT NULL GROUP BY 1),
r AS (SELECT subject_id AS file_id, string_agg(concat_ws('|', predicate, coalesce(path, '?'), 'heuristic:h', '0.5'), ';' ORDER BY place, object_id) AS relations FROM (SELECT *, {PLACED(KB.PROVENANCE_PREDICATES, 'predicate')} AS place FROM relations) LEFT JOIN doc_files ON file_id = object_id WHERE place IS NOT NULL GROUP BY 1)
SELECT f.file_id, f.path, f.file_id % 50 = 0 AS pinned, coalesce(facts, '') AS facts, coalesce(relations, '') AS relations FROM doc_files f LEFT JOIN a USING (file_id) LEFT JOIN r USING (file_id)""")(lambda s, d: _provenance(s, d))


def _provenance(s: SparkSession, d: str) -> DataFrame:
    k = knowledge.of(s, d)
    told = k.relations.withColumn("source", F.lit("heuristic:h")).withColumn("confidence", F.lit(0.5)).withColumn("id", F.col("object_id"))
    text = lambda name, *fields: F.coalesce(F.array_join(F.transform(name, lambda x: F.concat_ws("|", *[F.coalesce(x[f].cast("string"), F.lit("?")) for f in fields])), ";"), F.lit("")).alias(name)
    return KB.provenance(k.files, k.facts, told, k.pinned).select("file_id", "path", "pinned", text("facts", "key", "value", "source", "confidence"), text("relations", "predicate", "object_path", "source", "confidence"))


query("k18_override", f"{W('facts')}, o AS (SELECT entity_id, key, value, source, confidence, asserted_at, id FROM facts UNION ALL SELECT doc_id, 'role', 'source', 'user', 1.0, {N + 9}, -doc_id FROM documents WHERE doc_id % 100 = 4) SELECT entity_id, value FROM o WHERE key = 'role' QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY confidence DESC, {PRIO} DESC, asserted_at DESC, id DESC) = 1")(
    lambda s, d: KB.resolve(_facts(s, d).select("entity_id", "key", "value", "source", "confidence", "asserted_at", "id").union(
        B.table(s, d, "documents").filter("doc_id % 100 = 4").select("doc_id", F.lit("role"), F.lit("source"), F.lit("user"), F.lit(1.0), F.lit(N + 9).cast("long"), -F.col("doc_id")))).filter("key = 'role'").select("entity_id", "value"))
query("k19_status", f"{W('derived', 'backups')}, f AS ({FOUND}) SELECT (SELECT count(*) FROM f) AS pending, (SELECT count(*) FROM live) AS live_files")(
    lambda s, d: _found(s, d).agg(F.count(F.lit(1)).alias("pending")).crossJoin(F.broadcast(C.live(_files(s, d)).agg(F.count(F.lit(1)).alias("live_files")))))
query("k20_u13_parse_findings", f"{W('derived')} SELECT derivative_id AS subject_id, source_id AS object_id, 'derived from' AS label FROM derived")(
    lambda s, d: KB.derived_pairs(_files(s, d)).select(F.to_json(F.struct(F.col("derivative_id").alias("derivative_file_id"), F.col("source_id").alias("source_file_id"))).alias("payload")).select(
        F.from_json("payload", "derivative_file_id long, source_file_id long").alias("p")).filter("p IS NOT NULL").select(F.col("p.derivative_file_id").alias("subject_id"), F.col("p.source_file_id").alias("object_id"), F.lit("derived from").alias("label")))
query("f8_hidden_entities", f"{W('facts')} SELECT DISTINCT entity_id FROM facts WHERE key = 'sensitivity' AND confidence >= 0.5 AND value IN ('private', 'restricted')")(lambda s, d: KB.hidden_entities(_facts(s, d)))
query("f9_displayed", f"{W('top')} SELECT file_id FROM live WHERE file_id NOT IN (SELECT entity_id FROM top WHERE key = 'sensitivity' AND NOT display)")(lambda s, d: KB.displayed(_facts(s, d), C.live(_files(s, d)).select("file_id", F.col("file_id").alias("entity_id"))).select("file_id"))
query("f10_extractor_visible", f"{W('facts')}, t AS (SELECT * FROM facts WHERE key = 'sensitivity' QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY confidence DESC, {PRIO} DESC, asserted_at DESC, id DESC) = 1) SELECT file_id FROM live LEFT JOIN t ON entity_id = file_id WHERE value IS NULL OR confidence < 0.5 OR value NOT IN ('private', 'restricted')")(
    lambda s, d: C.live(_files(s, d)).join(KB.resolve(_facts(s, d)).filter("key = 'sensitivity'"), F.col("file_id") == F.col("entity_id"), "left").filter("value IS NULL OR confidence < 0.5 OR value NOT IN ('private', 'restricted')").select("file_id"))

# Cleanup, views, lens ------------------------------------------------------------


def _candidates(s: SparkSession, d: str) -> DataFrame:
    return K.candidates(_files(s, d), _facts(s, d), _relations(s, d), _lifecycles(s, d), _pinned(s, d))


query("c1_cleanup_candidates", f"{W('candidates')} SELECT * FROM candidates")(_candidates)
query("c2_f7_plan_scope", f"{W('candidates')} SELECT * FROM candidates WHERE reason IN ('scratch', 'safe-derivative') AND size <= 4000 AND starts_with(path, '/corpus/Projects/')")(lambda s, d: K.in_scope(_candidates(s, d), ["scratch", "safe-derivative"], 4000, "/corpus/Projects"))
query("t9_a15_candidate_totals", f"{W('candidates')} SELECT reason, count(*) AS n, sum(greatest(0, size))::BIGINT AS bytes FROM candidates GROUP BY 1")(lambda s, d: _candidates(s, d).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum(F.greatest(F.lit(0), "size")).alias("bytes")))
query("c3_execution_log", f"{W('candidates')} SELECT 7::BIGINT AS plan_id, file_id, path AS original_path, size, {N}::BIGINT AS cleaned_at, reason, 'in_recycle_bin' AS restore_status, {N + 30 * 86400}::BIGINT AS expires_at FROM candidates")(lambda s, d: K.execute(_candidates(s, d), 7, N))
query("c4_gating_facts", f"{W('facts')}, t AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY entity_id, key ORDER BY confidence DESC, {PRIO} DESC, asserted_at DESC, id DESC) = 1) SELECT entity_id, max(value) FILTER (WHERE key = 'role') AS role, max(value) FILTER (WHERE key = 'replaceability') AS replaceability, max(value) FILTER (WHERE key = 'sensitivity') AS sensitivity FROM t GROUP BY 1")(
    lambda s, d: KB.resolve(_facts(s, d)).groupBy("entity_id").agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in ("role", "replaceability", "sensitivity")]))
query("c5_c6_restore_expire", f"{W('candidates')} SELECT file_id, CASE WHEN file_id % 2 = 1 THEN 'expired' WHEN file_id IN (6, 18, 30) THEN 'restored' ELSE 'in_recycle_bin' END AS restore_status FROM candidates")(
    lambda s, d: K.restore(K.expire(K.execute(_candidates(s, d), 7, N).withColumn("expires_at", F.when(F.col("file_id") % 2 == 1, F.lit(N)).otherwise(F.col("expires_at"))), N), [6, 18, 30]).select("file_id", "restore_status"))
query("t8_recently_cleaned", f"{W('candidates')} SELECT file_id, {N} - file_id AS cleaned_at FROM candidates ORDER BY 2 DESC, 1 LIMIT 20 OFFSET 10")(
    lambda s, d: K.execute(_candidates(s, d), 7, N).select("file_id", (F.lit(N) - F.col("file_id")).alias("cleaned_at")).orderBy(F.desc("cleaned_at"), "file_id").offset(10).limit(20))


def _second_page(s: SparkSession, d: str) -> DataFrame:
    """The page of the log after its first, by the key of the first one's last row."""
    log = K.execute(_candidates(s, d), 7, N).select("file_id", (F.lit(N) - F.col("file_id")).alias("cleaned_at"))
    order = [("cleaned_at", "desc"), ("file_id", "asc")]
    last = C.page(log, order, 10).tail(1)
    return C.page(log, order, 20, last[0].asDict()) if last else log.limit(0)


query("t8_page_by_key", f"{W('candidates')} SELECT file_id, {N} - file_id AS cleaned_at FROM candidates ORDER BY 2 DESC, 1 LIMIT 20 OFFSET 10")(_second_page)
SHOWN = "file_id NOT IN (SELECT entity_id FROM top WHERE key = 'sensitivity' AND NOT display)"
VIEW_SQL = {
    "g1": f"modified_at < {N - 365 * 86400} AND file_id IN (SELECT file_id FROM stage WHERE lifecycle IN ('finished', 'archived'))",
    "g2": "size > 500 AND derivative AND regenerable",
    "g3": "file_id NOT IN (SELECT subject_id FROM relations WHERE predicate = 'partOf')",
    "g4": "file_id NOT IN (SELECT entity_id FROM facts WHERE key = 'role')",
    "g5": "is_source AND has_derived IS NULL",
    "g6": "is_backup AND lost",
}
#: Flags of each file, joined once: no subquery depends on a row.
FLAGS = """, told AS MATERIALIZED (SELECT entity_id AS file_id, bool_or(key = 'role' AND value = 'derivative') AS derivative, bool_or(key = 'role' AND value = 'source') AS is_source, bool_or(key = 'role' AND value = 'backup') AS is_backup,
  bool_or(key = 'replaceability' AND value = 'regenerable') AS regenerable FROM facts GROUP BY 1),
hid AS MATERIALIZED (SELECT entity_id AS file_id, true AS hidden FROM top WHERE key = 'sensitivity' AND NOT display GROUP BY 1),
made AS MATERIALIZED (SELECT x.object_id AS file_id, true AS has_derived FROM relations x JOIN live y ON y.file_id = x.subject_id WHERE x.predicate = 'derivedFrom' GROUP BY 1),
gone AS MATERIALIZED (SELECT x.subject_id AS file_id, true AS lost FROM relations x LEFT JOIN doc_files y ON y.file_id = x.object_id WHERE x.predicate = 'backupOf' AND (y.file_id IS NULL OR y.deleted_at IS NOT NULL) GROUP BY 1)
SELECT file_id, path, size FROM live LEFT JOIN told USING (file_id) LEFT JOIN hid USING (file_id) LEFT JOIN made USING (file_id) LEFT JOIN gone USING (file_id) WHERE hidden IS NULL AND """


def _view_oracle(number: int) -> str:
    tables, where = W("top", "relations", "stage"), VIEW_SQL[f"g{number}"]
    return f"{tables}{FLAGS}{where}" if number in (2, 5, 6) else f"{tables} SELECT file_id, path, size FROM live WHERE {where} AND {SHOWN}"


for _i, _view in enumerate(K.VIEWS):
    query(f"g{_i + 1}_{_view.replace('-', '_')}", _view_oracle(_i + 1))(
        lambda s, d, v=_view: K.saved_view(v, _files(s, d), _facts(s, d), _relations(s, d), _lifecycles(s, d), N, least=500))


def _lens(s: SparkSession, d: str) -> DataFrame:
    return K.lens(_files(s, d), _facts(s, d), _relations(s, d), _lifecycles(s, d), _candidates(s, d))


def _kept_lens(s: SparkSession, d: str) -> DataFrame:
    """The lens, written: for those that read it more than once."""
    return shared.written(_lens(s, d), "lens")


_UP = "SELECT unnest(CAST(list_transform(range(len(parts), 0, -1), lambda i: '/' || array_to_string(parts[1:i], '/')) AS VARCHAR[])) AS path, * EXCLUDE (path, parts) FROM (SELECT *, string_split(ltrim(folder_path, '/'), '/') AS parts FROM {})"
_DOM = "(SELECT path, value FROM (SELECT path, value, row_number() OVER (PARTITION BY path ORDER BY sum(greatest(0, size)) DESC, value) AS r FROM up JOIN ({}) v USING (file_id) GROUP BY path, value) WHERE r = 1)"
LENS = f"""{W('candidates')}, shown AS (SELECT entity_id AS file_id, key, value FROM facts WHERE display QUALIFY row_number() OVER (PARTITION BY entity_id, key ORDER BY confidence DESC, asserted_at DESC, id DESC) = 1),
up AS ({_UP.format('live')}), allf AS (SELECT DISTINCT path FROM ({_UP.format('doc_files')})), lens AS (SELECT a.path, r.value AS role, p.value AS replaceability, l.value AS lifecycle, c.value AS cleanup_reason, coalesce(w.b, 0) AS reclaimable_bytes FROM allf a
 LEFT JOIN {_DOM.format("SELECT file_id, value FROM shown WHERE key = 'role'")} r USING (path) LEFT JOIN {_DOM.format("SELECT file_id, value FROM shown WHERE key = 'replaceability'")} p USING (path)
 LEFT JOIN {_DOM.format('SELECT file_id, lifecycle AS value FROM stage WHERE lshown QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY lconf DESC, project_id DESC) = 1')} l USING (path) LEFT JOIN {_DOM.format('SELECT file_id, reason AS value FROM candidates')} c USING (path)
 LEFT JOIN (SELECT path, sum(size)::BIGINT AS b FROM up WHERE file_id IN (SELECT file_id FROM candidates) GROUP BY path) w USING (path))"""
query("l1_a13_treemap_lens", f"{LENS} SELECT * FROM lens")(_lens)
VERDICT = "CASE WHEN coalesce(replaceability = 'irreplaceable', false) OR coalesce(role IN ('source', 'system', 'asset', 'tool'), false) OR coalesce(lifecycle = 'active', false) THEN 'protected' WHEN cleanup_reason IN ('safe-derivative', 'redundant-backup', 'scratch') THEN 'safe' WHEN cleanup_reason = 'finished-project-cruft' THEN 'review' WHEN reclaimable_bytes > 0 THEN 'review' ELSE 'keep' END"


def _verdict() -> F.Column:
    return K.verdict(F.col("role"), F.col("replaceability"), F.col("lifecycle"), F.col("cleanup_reason"), F.col("reclaimable_bytes"))


query("l2_l3_verdicts", f"{LENS}, v AS (SELECT *, {VERDICT} AS verdict FROM lens) SELECT path, verdict, verdict <> 'protected' AND reclaimable_bytes > 0 AS can_stage FROM v")(
    lambda s, d: _lens(s, d).withColumn("verdict", _verdict()).select("path", "verdict", ((F.col("verdict") != "protected") & (F.col("reclaimable_bytes") > 0)).alias("can_stage")))
query("l3_explanations", f"""{LENS}, t AS (SELECT path, concat_ws(' · ', CASE role WHEN 'derivative' THEN 'build / derived output' WHEN 'backup' THEN 'backup copy' WHEN 'scratch' THEN 'scratch / cache' WHEN 'source' THEN 'source files' WHEN 'asset' THEN 'project assets' WHEN 'system' THEN 'system files' WHEN 'tool' THEN 'tooling' ELSE role END,
 CASE WHEN replaceability = 'regenerable' THEN 'regenerable output' END, CASE WHEN lifecycle = 'active' THEN 'part of an active project' WHEN lifecycle IN ('finished', 'archived') THEN concat('from a ', lifecycle, ' project') END) AS x FROM lens)
SELECT path, CASE WHEN x = '' THEN 'A directory in your storage.' ELSE concat(upper(substr(x, 1, 1)), substr(x, 2), '.') END AS explanation FROM t""")(
    lambda s, d: _lens(s, d).select("path", K.explanation(F.col("role"), F.col("replaceability"), F.col("lifecycle")).alias("explanation")))
query("f17_l4_offered_folders", f"{LENS}, o AS (SELECT * FROM lens WHERE cleanup_reason IN ('scratch', 'safe-derivative') AND reclaimable_bytes > 0) SELECT path, reclaimable_bytes FROM o WHERE NOT EXISTS (SELECT 1 FROM o p WHERE starts_with(o.path, p.path || '/'))")(
    lambda s, d: K.outermost_candidates(_kept_lens(s, d), ["scratch", "safe-derivative"]).select("path", "reclaimable_bytes"))
query("a18_reclaimable_headline", f"{LENS} SELECT sum(reclaimable_bytes)::BIGINT AS reclaimable_bytes FROM lens l WHERE NOT EXISTS (SELECT 1 FROM lens p WHERE starts_with(l.path, p.path || '/'))")(lambda s, d: K.headline(_kept_lens(s, d)))
query("f15_held_back", f"{LENS}, v AS (SELECT path, {VERDICT} AS verdict FROM lens) SELECT path FROM v WHERE verdict = 'protected' OR NOT EXISTS (SELECT 1 FROM candidates c WHERE starts_with(c.path, v.path || '/'))")(
    lambda s, d: (lambda v, up: v.join(up, "path", "left").filter("verdict = 'protected' OR covered IS NULL").select("path"))(
        _lens(s, d).withColumn("verdict", _verdict()), _candidates(s, d).select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct().withColumn("covered", F.lit(True))))
query("j23_k21_shared_files", f"{W('derived', 'backups')}, f AS ({FOUND}) SELECT DISTINCT f.kind, f.subject_id, d.content_hash FROM f JOIN live d ON d.file_id IN (f.subject_id, f.object_id) WHERE (d.size, d.content_hash) IN (SELECT (size, content_hash) FROM live GROUP BY size, content_hash HAVING count(*) > 1)")(
    lambda s, d: (lambda f, dup: f.select("kind", "subject_id", F.explode(F.array("subject_id", "object_id")).alias("file_id")).join(dup, "file_id").select("kind", "subject_id", "content_hash").distinct())(
        _found(s, d), (lambda l: l.join(l.groupBy("size", "content_hash").count().filter("count > 1"), ["size", "content_hash"], "left_semi").select("file_id", "content_hash"))(C.live(_files(s, d)))))

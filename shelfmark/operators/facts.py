"""Facts about files: rules, heuristics, resolution, discoveries.

Assertions are rows (id, entity_id, key, value, source, confidence, asserted_at,
display); relations are (subject_id, predicate, object_id). A file's entity id is
its file_id. Confidences are single-precision values in doubles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import paths
from shelfmark.operators import components, hamming
from shelfmark.sources import shared


@dataclass(frozen=True)
class Rule:
    """What a path, name or extension says about a file."""

    id: str
    on: str
    pattern: str
    key: str
    value: str
    confidence: float
    display: bool = True


#: The starter rules, all of which are tried on every file.
RULES = [
    Rule("rule:path-prefix-personal-details", "path", r"(?i)/Personal Details/", "sensitivity", "restricted", 1.0, False),
    Rule("rule:path-prefix-work-details", "path", r"(?i)/Work Details/", "sensitivity", "restricted", 1.0, False),
    Rule("rule:sensitive-keyword", "path", r"(?i)(^|[^A-Za-z0-9])(passport|aadhar|payslip|salary|pan([ _-]?card)?)([^A-Za-z0-9]|$)", "sensitivity", "restricted", 0.9, False),
    Rule("rule:path-old-hdd-backup", "path", r"(?i)/Old HDD-Backup/", "role", "backup", 0.85),
    Rule("rule:path-backup-folder", "path", r"(?i)/Backup(/|$|[ _-])", "role", "backup", 0.85),
    Rule("rule:path-node-modules", "path", r"/node_modules/", "role", "scratch", 0.95),
    Rule("rule:path-cache", "path", r"/\.cache/", "role", "scratch", 0.95),
    Rule("rule:path-target-debug", "path", r"/target/(debug|release)/", "role", "scratch", 0.95),
    Rule("rule:path-pycache", "path", r"/__pycache__/", "role", "scratch", 0.95),
    Rule("rule:path-dist-build", "path", r"/(dist|build)/", "role", "scratch", 0.9),
    Rule("rule:filename-ds-store", "name", r"^\.DS_Store$", "role", "system", 1.0),
    Rule("rule:filename-thumbs-db", "name", r"(?i)^Thumbs\.db$", "role", "system", 1.0),
    Rule("rule:filename-desktop-ini", "name", r"(?i)^desktop\.ini$", "role", "system", 1.0),
    Rule("rule:ext-design-source", "extension", "psd ai ae xd aep sketch fig", "role", "source", 0.85),
    Rule("rule:ext-font", "extension", "ttf otf woff woff2 eot", "role", "asset", 0.95),
    Rule("rule:ext-installer", "extension", "exe msi dmg appimage", "role", "tool", 0.75),
    Rule("rule:origin-screenshot", "name", r"(?i)^(Screenshot|Screen Shot)[ _-]", "origin", "app-export", 0.85),
    Rule("rule:origin-whatsapp", "name", r"(?i)^IMG[_-].*WA", "origin", "messenger-received", 0.9),
    Rule("rule:origin-phone-camera", "name", r"(?i)^(IMG_\d{8}_\d{6}|DSC|PXL_)", "origin", "phone-camera", 0.85),
]
#: Bounds of the size ratio of a derived file, and of a backup.
DERIVED_RATIO, BACKUP_RATIO = (0.05, 50.0), (0.5, 2.0)
NEAR_DISTANCE = 10
MET_COST = 32
MEDIAN_FLOOR = 0.7


def rule_facts(files: DataFrame, rules: list[Rule] | None = None, asserted_at: int = 0) -> DataFrame:
    """Every fact that any rule asserts about a live file (P0-P20): one pass over the files."""
    hits = []
    for r in rules or RULES:
        if r.on == "extension":
            fits = F.lower("extension").isin(r.pattern.split())
        else:
            fits = (F.replace("path", F.lit("\\"), F.lit("/")) if r.on == "path" else F.col("name")).rlike(r.pattern)
        fact = F.struct(F.lit(r.key).alias("key"), F.lit(r.value).alias("value"), F.lit(r.id).alias("source"), paths.f32(F.lit(r.confidence)).alias("confidence"), F.lit(r.display).alias("display"))
        hits.append(F.when(fits, fact))
    found = files.filter("deleted_at IS NULL").select(F.col("file_id").alias("entity_id"), F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("f"))
    return found.select("entity_id", "f.*", F.lit(asserted_at).cast("long").alias("asserted_at"))


def resolve(facts: DataFrame, by_source: bool = True) -> DataFrame:
    """The fact that holds for each entity and key: most confident, then (K4) best source, then newest, then last id.

    Without ``by_source`` the source plays no part (N2, T2).
    """
    rank = [F.col("confidence"), *([paths.source_priority(F.col("source"))] if by_source else []), F.col("asserted_at"), F.col("id")]
    best = F.max_by(F.struct("value", "confidence", "source"), F.struct(*rank))
    return facts.groupBy("entity_id", "key").agg(best.alias("b")).select("entity_id", "key", "b.value", "b.confidence", "b.source")


def hidden_entities(facts: DataFrame) -> DataFrame:
    """Entities that global views leave out: any sensitivity of 0.5 or more that is private or restricted (F8)."""
    return facts.filter((F.col("key") == "sensitivity") & (F.col("confidence") >= 0.5) & F.col("value").isin("private", "restricted")).select("entity_id").distinct()


def displayed(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities whose resolved sensitivity may be displayed, or that have none."""
    top = facts.filter("key = 'sensitivity'").groupBy("entity_id").agg(F.max_by("display", F.struct("confidence", "asserted_at", "id")).alias("shown"))
    return entities.join(top.filter("NOT shown"), "entity_id", "left_anti")


def emit(new: DataFrame, facts: DataFrame, rejected: DataFrame) -> DataFrame:
    """New facts that aren't rejected (entity, key, value) nor known with that source."""
    left = new.join(rejected.select("entity_id", "key", "value"), ["entity_id", "key", "value"], "left_anti")
    return left.join(facts.select("entity_id", "key", "value", "source"), ["entity_id", "key", "value", "source"], "left_anti")


def emit_relations(new: DataFrame, relations: DataFrame, rejected: DataFrame) -> DataFrame:
    """The same for relations."""
    left = new.join(rejected.select("subject_id", "predicate", "object_id"), ["subject_id", "predicate", "object_id"], "left_anti")
    return left.join(relations.select("subject_id", "predicate", "object_id", "source"), ["subject_id", "predicate", "object_id", "source"], "left_anti")


def upsert_entities(known: DataFrame, new: DataFrame, digits: int = 4) -> DataFrame:
    """Known entities (kind, canonical_id, id) and the new ones with ids after the largest (K1).

    New ones are numbered inside buckets of a hash, of which only the sizes are
    summed up, so one kind that holds all entities is many tasks. The order is
    bucket, kind, canonical_id.
    """
    fresh = new.select("kind", "canonical_id").distinct().join(known, ["kind", "canonical_id"], "left_anti")
    fresh = fresh.withColumn("bucket", F.substring(F.md5(F.concat_ws("|", "kind", "canonical_id").cast("binary")), 1, digits))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # 16 ** digits rows at most
    top = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    starts = fresh.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    ranked = fresh.withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy("kind", "canonical_id")))
    numbered = ranked.join(starts, "bucket").crossJoin(F.broadcast(top)).select("kind", "canonical_id", F.col("top") + F.col("start") + F.col("r"))  # one row
    return known.select("kind", "canonical_id", "id").union(numbered)


def ensure_file_entities(known: DataFrame, files: DataFrame) -> DataFrame:
    """Entities with one for every live file."""
    return upsert_entities(known, files.filter("deleted_at IS NULL").select(F.lit("File").alias("kind"), F.col("path").alias("canonical_id")))


def entity_of(entities: DataFrame, kind: str | None = None, canonical_id: str | None = None, id: int | None = None) -> DataFrame:  # noqa: A002
    """Entities by id, or by kind and canonical id (K2)."""
    for column, value in (("kind", kind), ("canonical_id", canonical_id), ("id", id)):
        entities = entities if value is None else entities.filter(F.col(column) == value)
    return entities


def assert_facts(facts: DataFrame, new: DataFrame) -> DataFrame:
    """Facts with new ones appended; a key may hold many values (K3)."""
    return facts.unionByName(new, allowMissingColumns=True)


def facts_of(facts: DataFrame, entity_id: int, key: str) -> DataFrame:
    """All values of one entity and key (K3)."""
    return facts.filter((F.col("entity_id") == entity_id) & (F.col("key") == key))


def outbound(relations: DataFrame, subject_id: int, predicate: str) -> DataFrame:
    """Relations from an entity (K6)."""
    return relations.filter((F.col("subject_id") == subject_id) & (F.col("predicate") == predicate))


def inbound(relations: DataFrame, object_id: int, predicate: str) -> DataFrame:
    """Relations to an entity (K6)."""
    return relations.filter((F.col("object_id") == object_id) & (F.col("predicate") == predicate))


def _stems(name: Column) -> Column:
    """A stem and each of its beginnings that a delimiter follows."""
    marks = F.filter(F.sequence(F.lit(2), F.greatest(F.length(name), F.lit(2))), lambda i: F.substring(name, i, F.lit(1)).isin(" ", "_", "-", ".", "(", "["))
    return F.array_distinct(F.concat(F.array(name), F.transform(marks, lambda i: F.substring(name, F.lit(1), i - 1))))


def unrejected(pairs: DataFrame, rejected: DataFrame, predicate: str, subject: str, object_: str) -> DataFrame:
    """Pairs that the user hasn't rejected (H1): ``rejected`` has subject_id, predicate, object_id."""
    no = rejected.filter(F.col("predicate") == predicate).select(F.col("subject_id").alias(subject), F.col("object_id").alias(object_))
    return pairs.join(no, [subject, object_], "left_anti")


def derived_pairs(files: DataFrame) -> DataFrame:
    """Siblings of which one seems made from the other.

    Equal stems, or the source's followed by a delimiter; another extension;
    not older; a size ratio in bounds. Each file is looked up by its stem and
    the beginnings of it, so the join is on equal (folder, stem).
    """
    ext, named = F.lower(F.coalesce("extension", F.lit(""))), paths.stem(F.col("name"))
    rows = files.filter("deleted_at IS NULL").select("file_id", "folder_path", "path", "size", "modified_at", ext.alias("ext"), named.alias("stem"))
    made = rows.select(*[F.col(c).alias(f"d_{c}") for c in rows.columns], F.explode(_stems(F.col("stem"))).alias("lookup"))
    made = made.filter("lookup <> ''")
    on = (made["d_folder_path"] == rows["folder_path"]) & (made["lookup"] == rows["stem"])
    ratio = F.col("d_size") / F.col("size")
    met = made.join(rows, on).filter((F.col("d_file_id") != F.col("file_id")) & (F.col("d_ext") != F.col("ext")) & (F.col("size") > 0))
    met = met.filter((F.col("d_modified_at") > F.col("modified_at")) & ratio.between(*DERIVED_RATIO))
    score = (
        F.lit(0.5) + F.when(ratio.between(0.1, 1.0), 0.2).otherwise(0.0) + F.when(F.col("ext").isin("psd", "ai"), 0.15).otherwise(0.0)
        + F.when(F.col("d_ext").isin("png", "jpg", "jpeg"), 0.1).otherwise(0.0)
    )
    return met.select(
        F.col("d_file_id").alias("derivative_id"), F.col("file_id").alias("source_id"), ratio.alias("size_ratio"),
        paths.f32(F.least(F.round(score, 2), F.lit(0.95))).alias("confidence"), F.col("d_size").alias("bytes"),
    )


def backup_pairs(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Backups of files in other folders (H4, H5, J18): stem without the suffix, size ratio in bounds.

    Sizes within a ratio of two differ by one power of two at most: the join is on
    stem and power, so a name that stands in every folder is split by size.
    """
    power = lambda size: F.floor(F.log2(F.greatest(F.lit(1), size))).cast("int")
    backups = facts.filter("key = 'role' AND value = 'backup'").select(F.col("entity_id").alias("file_id")).distinct()
    alive = files.filter("deleted_at IS NULL")
    named = paths.stem(F.col("name"))
    b = alive.join(backups, "file_id", "left_semi").select("file_id", "folder_path", "size", paths.backup_stem(F.col("name")).alias("lookup")).filter(F.octet_length("lookup") >= 3)
    b = b.withColumn("power", F.explode(F.transform(F.array(*[F.lit(i) for i in (-1, 0, 1)]), lambda i: power(F.col("size")) + i)))
    starts = F.filter(_stems(named), lambda s: (s == named) | F.substring(named, F.length(s) + 1, F.lit(1)).isin(" ", "_", "-"))
    o = alive.join(backups, "file_id", "left_anti").filter(~named.rlike(r"[ _-](backup|copy)$")).select(F.col("file_id").alias("origin_id"), F.col("folder_path").alias("o_folder"), F.col("size").alias("o_size"), power(F.col("size")).alias("power"), F.explode(starts).alias("lookup"))
    ratio = F.col("size") / F.col("o_size")
    met = b.join(o, ["lookup", "power"]).filter((F.col("folder_path") != F.col("o_folder")) & (F.col("o_size") > 0) & ratio.between(*BACKUP_RATIO))
    return met.select(F.col("file_id").alias("backup_id"), "origin_id", ratio.alias("size_ratio"), paths.f32(F.lit(0.7)).alias("confidence"), F.col("size").alias("bytes")).distinct()


def regenerable(facts: DataFrame, relations: DataFrame) -> DataFrame:
    """Files with a derivative role and a source are regenerable (H6)."""
    role = facts.filter("key = 'role' AND value = 'derivative'").select("entity_id").distinct()
    derived = relations.filter("predicate = 'derivedFrom'").select(F.col("subject_id").alias("entity_id"))
    return role.join(derived, "entity_id", "left_semi").select("entity_id", F.lit("replaceability").alias("key"), F.lit("regenerable").alias("value"), F.lit("heuristic:regenerable").alias("source"), paths.f32(F.lit(0.95)).alias("confidence"))


def redownloadable(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Tools that are named like installers can be downloaded again (H7)."""
    tools = facts.filter("key = 'role' AND value = 'tool'").select(F.col("entity_id").alias("file_id"))
    rows = files.filter("deleted_at IS NULL").filter(F.col("name").rlike(r"(?i)(setup|installer|install[_ .-]?)")).join(tools, "file_id", "left_semi")
    return rows.select(F.col("file_id").alias("entity_id"), F.lit("replaceability").alias("key"), F.lit("redownloadable").alias("value"), F.lit("heuristic:installer").alias("source"), paths.f32(F.lit(0.6)).alias("confidence"))


def near_classes(hashes: DataFrame) -> DataFrame:
    """(id, class_id, a, b): the members of each class of equal hashes (id, a, b), named by its smallest id."""
    named = hashes.groupBy("a", "b").agg(F.min("id").alias("class_id"))
    return hashes.select("id", "a", "b").join(named, ["a", "b"]).select("id", "class_id", "a", "b")


def _named(hashes: DataFrame) -> DataFrame:
    return shared.written(hashes.groupBy("a", "b").agg(F.min("id").alias("id")), "named")


def _meets_all(edges: list[int]) -> bool:
    """Whether a join on these bands of bits meets so many of all pairs that comparing every pair is less work: a met pair costs as much as MET_COST compared ones."""
    return sum((1 + b - a) / 2.0 ** (b - a) for a, b in zip(edges, edges[1:], strict=False)) * MET_COST > 1


def near_class_links(hashes: DataFrame, most: int = NEAR_DISTANCE, bits: int = 128) -> DataFrame:
    """Enough of :func:`near_class_pairs` (left_id, right_id) to connect all that these connect."""
    bands = most // 2 + 1
    if _meets_all([bits * i // bands for i in range(bands + 1)]):
        return hamming.pairs(_named(hashes), most, forest=True).select("left_id", "right_id")
    return near_class_pairs(hashes, most, bits).select("left_id", "right_id")


def near_class_pairs(hashes: DataFrame, most: int = NEAR_DISTANCE, bits: int = 128) -> DataFrame:
    """Pairs (left_id, right_id, distance) of classes of equal hashes at most so many bits apart, by their smallest ids.

    With :func:`near_classes` this is all there is to know, in rows that follow the number of hashes. With ``most`` // 2 + 1 bands of bits, two
    hashes so near differ by one bit at most in some band: the lesser one looks
    every band up as it is and with each bit of it turned, in an equal join that
    finds all; a bit count verifies. Class pairs are expanded to ids at the end.
    Where bands are so narrow that they part little, :mod:`hamming` compares all pairs.
    """
    bands = most // 2 + 1
    edges = [bits * i // bands for i in range(bands + 1)]
    if _meets_all(edges):
        return hamming.pairs(_named(hashes), most)
    digits = F.concat(F.lpad(F.bin("a"), 64, "0"), F.lpad(F.bin("b"), 64, "0")) if bits > 64 else F.lpad(F.bin("a"), bits, "0")
    classes = hashes.select("a", "b").distinct().withColumn("digits", digits)
    value = lambda i: F.conv(F.substring("digits", edges[i] + 1, edges[i + 1] - edges[i]), 2, 10).cast("long")
    valued = classes.select("a", "b", F.array(*[value(i) for i in range(bands)]).alias("values"))
    own = [(i, 0) for i in range(bands)]
    turned = own + [(i, 1 << j) for i in range(bands) for j in range(edges[i + 1] - edges[i])]

    def looked_up(masks: list[tuple[int, int]]) -> Column:
        table = F.array(*[F.struct(F.lit(i).alias("band"), F.lit(m).cast("long").alias("mask")) for i, m in masks])
        return F.explode(F.transform(table, lambda k: F.struct(k["band"].alias("band"), F.get("values", k["band"]).bitwiseXOR(k["mask"]).alias("value"))))

    left = valued.select("a", "b", looked_up(turned).alias("k")).alias("l")
    right = valued.select("a", "b", looked_up(own).alias("k")).alias("r")
    lesser = (F.col("l.a") < F.col("r.a")) | (F.col("l.a") == F.col("r.a")) & (F.col("l.b") < F.col("r.b"))
    distance = paths.hamming(F.col("l.a"), F.col("r.a")) + paths.hamming(F.col("l.b"), F.col("r.b"))
    met = left.join(right, (F.col("l.k") == F.col("r.k")) & lesser & (distance <= most))
    near = met.select(F.col("l.a").alias("a"), F.col("l.b").alias("b"), F.col("r.a").alias("a2"), F.col("r.b").alias("b2"), distance.alias("distance")).distinct()
    named = hashes.groupBy("a", "b").agg(F.min("id").alias("left_id"))
    other = named.select(F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("left_id").alias("right_id"))
    apart = near.join(named, ["a", "b"]).join(other, ["a2", "b2"])
    return apart.select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"), "distance")


def near_clusters(hashes: DataFrame, most: int = NEAR_DISTANCE, bits: int = 128) -> DataFrame:
    """(id, class_id, cluster_id) of every hash (id, a, b): its class of equal hashes, and the smallest id that near pairs lead to."""
    members = shared.written(near_classes(hashes), "classes")
    found = components.components(near_class_links(members.filter("id = class_id"), most, bits).select(F.col("left_id").alias("src"), F.col("right_id").alias("dst")))
    joined = members.join(found.withColumnRenamed("id", "class_id"), "class_id", "left")
    return joined.select("id", "class_id", F.coalesce("component", "class_id").alias("cluster_id"))


def near_pairs(hashes: DataFrame, most: int = NEAR_DISTANCE, bits: int = 128) -> DataFrame:
    """All pairs (left_id, right_id, distance) of hashes (id, a, b) at most so many bits apart (J19, V4), classes expanded.

    The square of a class's size in rows: for tables whose equal hashes are few; else :func:`near_class_pairs` or :func:`near_clusters`.
    """
    members = shared.written(near_classes(hashes), "classes")
    left, right = members.select(F.col("class_id").alias("left_class"), F.col("id").alias("l")), members.select(F.col("class_id").alias("right_class"), F.col("id").alias("r"))
    pairs = near_class_pairs(members.filter("id = class_id"), most, bits).select(F.col("left_id").alias("left_class"), F.col("right_id").alias("right_class"), "distance")
    apart = pairs.join(left, "left_class").join(right, "right_class").select(F.least("l", "r").alias("left_id"), F.greatest("l", "r").alias("right_id"), "distance")
    same = left.join(right, F.col("left_class") == F.col("right_class")).filter("l < r").select("l", "r", F.lit(0))
    return apart.union(same)


def near_confidence(distance: Column) -> Column:
    """Confidence of a near pair (V4)."""
    return paths.f32(F.greatest(F.lit(0.95) - 0.03 * distance, F.lit(0.6)))


def new_discoveries(found: DataFrame, known: DataFrame) -> DataFrame:
    """Discoveries whose kind and payload aren't known with any status."""
    keys = ["kind", "subject_id", "object_id", "size_ratio"]
    return found.join(known.select(*keys), keys, "left_anti")


def graduated(confirmed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts and relations of confirmed discoveries (kind, subject_id, object_id)."""
    role = F.when(F.col("kind") == "derivedFrom-pattern", "derivative").when(F.col("kind") == "backupOf-pair", "backup")
    facts = confirmed.select(F.col("subject_id").alias("entity_id"), F.lit("role").alias("key"), role.alias("value"), F.lit("user").alias("source"), F.lit(1.0).alias("confidence")).filter("value IS NOT NULL")
    named = F.when(F.col("kind") == "derivedFrom-pattern", "derivedFrom").when(F.col("kind") == "backupOf-pair", "backupOf").otherwise("nearDuplicateOf")
    one = confirmed.select("subject_id", named.alias("predicate"), "object_id")
    back = confirmed.filter("kind = 'near-duplicate-cluster'").select(F.col("object_id").alias("subject_id"), F.lit("nearDuplicateOf").alias("predicate"), F.col("subject_id").alias("object_id"))
    return facts, one.union(back)


def confirmable(discoveries: DataFrame, floor: float = MEDIAN_FLOOR) -> DataFrame:
    """Kinds of pending discoveries with their median confidence, and whether all may be confirmed."""
    median = paths.f32(F.median("confidence"))
    return discoveries.filter("status = 'pending'").groupBy("kind").agg(median.alias("median"), F.count(F.lit(1)).alias("pending")).withColumn("allowed", F.col("median") >= F.lit(floor).cast("float").cast("double"))


#: Keys and predicates of a file's provenance, in their order.
PROVENANCE_KEYS = ["role", "replaceability", "sensitivity", "origin", "mediaType", "language"]
PROVENANCE_PREDICATES = ["derivedFrom", "backupOf", "partOf", "inFolder"]


def provenance(files: DataFrame, facts: DataFrame, relations: DataFrame, pinned: DataFrame) -> DataFrame:
    """Per file: whether it is pinned, its facts and its relations in the fixed order of keys and predicates.

    ``facts`` are (key, value, source, confidence), ``relations`` (predicate,
    object_path, source, confidence); the path is null where the object is no file.
    """

    def ordered(rows: DataFrame, by: str, places: list[str], columns: list[str], name: str) -> DataFrame:
        place = F.lit(None).cast("int")
        for i, value in enumerate(places):
            place = F.when(F.col(by) == value, F.lit(i)).otherwise(place)
        kept = rows.withColumn("place", place).filter("place IS NOT NULL")
        listed = F.array_sort(F.collect_list(F.struct("place", "id", *columns)))  # a file's own facts: few
        return kept.groupBy("file_id").agg(F.transform(listed, lambda x: F.struct(*[x[c].alias(c) for c in columns])).alias(name))

    a = ordered(facts.withColumn("file_id", F.col("entity_id")), "key", PROVENANCE_KEYS, ["key", "value", "source", "confidence"], "facts")
    to = files.select(F.col("file_id").alias("object_id"), F.col("path").alias("object_path"))
    related = relations.withColumn("file_id", F.col("subject_id")).join(to, "object_id", "left")
    r = ordered(related, "predicate", PROVENANCE_PREDICATES, ["predicate", "object_path", "source", "confidence"], "relations")
    p = pinned.select("file_id", F.lit(True).alias("pinned"))
    out = files.select("file_id", "path").join(p, "file_id", "left").join(a, "file_id", "left").join(r, "file_id", "left")
    return out.select("file_id", "path", F.coalesce("pinned", F.lit(False)).alias("pinned"), "facts", "relations")

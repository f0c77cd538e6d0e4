"""What the user decides on findings: rejections, pins, confirmations, the switch.

Discoveries are rows (id, kind, subject_id, object_id, confidence, status);
negative assertions are (subject_id, predicate, object_id, key, value, reason).
Every function takes tables and returns new ones; nothing is changed in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import paths
from shelfmark.operators import facts as kb
from shelfmark.operators import trees
from shelfmark.sources import shared

NEGATIVE = "subject_id long, predicate string, object_id long, key string, value string, reason string"
#: What a confirmed kind of discovery becomes, and the role of its subject.
PREDICATES = {"derivedFrom-pattern": "derivedFrom", "backupOf-pair": "backupOf", "near-duplicate-cluster": "nearDuplicateOf"}
ROLES = {"derivedFrom-pattern": "derivative", "backupOf-pair": "backup"}


def _by_kind(values: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for kind, value in values.items():
        out = F.when(F.col("kind") == kind, F.lit(value)).otherwise(out)
    return out


def reject_pair(negative: DataFrame, subject_id: int, predicate: str, object_id: int, reason: str | None = None) -> DataFrame:
    """Negative assertions with a rejected relation (K7)."""
    return negative.union(negative.sparkSession.createDataFrame([(subject_id, predicate, object_id, None, None, reason)], NEGATIVE))


def reject_property(negative: DataFrame, subject_id: int, key: str, value: str, reason: str | None = None) -> DataFrame:
    """Negative assertions with a rejected fact (K7)."""
    return negative.union(negative.sparkSession.createDataFrame([(subject_id, "property", None, key, value, reason)], NEGATIVE))


def rejected_pairs(negative: DataFrame) -> DataFrame:
    """(subject_id, predicate, object_id) of rejected relations, for anti-joins."""
    return negative.filter("predicate <> 'property'").select("subject_id", "predicate", "object_id").distinct()


def rejected_properties(negative: DataFrame) -> DataFrame:
    """(entity_id, key, value) of rejected facts, for anti-joins."""
    return negative.filter("predicate = 'property'").select(F.col("subject_id").alias("entity_id"), "key", "value").distinct()


def pin(pinned: DataFrame, new: DataFrame) -> DataFrame:
    """Pins with new ones (file_id, pinned_at, reason), which replace older ones of the same file (K8)."""
    return pinned.join(new.select("file_id"), "file_id", "left_anti").unionByName(new)


def unpin(pinned: DataFrame, files: DataFrame) -> DataFrame:
    """Pins without those of some files (K8)."""
    return pinned.join(files.select("file_id"), "file_id", "left_anti")


def is_enabled(switch: DataFrame) -> bool:
    """The one-row switch (enabled); a missing row means off (K9)."""
    row = switch.agg(F.max(F.col("enabled").cast("int")).alias("on")).first()
    return bool(row["on"])


def set_enabled(switch: DataFrame, on: bool) -> DataFrame:
    """The switch, set; nothing else is touched, so all data outlive it (K9)."""
    return switch.sparkSession.createDataFrame([(on,)], "enabled boolean")


def _decided(discoveries: DataFrame, wanted: DataFrame, status: str) -> tuple[DataFrame, DataFrame]:
    """The wanted discoveries (id) that are pending, and all discoveries with the new status of those."""
    chosen = wanted.select("id").distinct().withColumn("chosen", F.lit(True))
    marked = discoveries.join(chosen, "id", "left")
    takes = F.col("chosen").isNotNull() & (F.col("status") == "pending")
    return marked.filter(takes).drop("chosen"), marked.withColumn("status", F.when(takes, F.lit(status)).otherwise(F.col("status"))).drop("chosen")


def confirm(discoveries: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Discoveries, facts and relations after confirming some by id (K13); others than pending ones stay as they are.

    A near-duplicate gives relations both ways.
    """
    taken, after = _decided(discoveries, wanted, "confirmed")
    facts, relations = kb.graduated(taken)
    return after, facts, relations


def reject(discoveries: DataFrame, wanted: DataFrame, negative: DataFrame, reason: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Discoveries and negative assertions after rejecting some by id (K14): a pair is asserted once."""
    taken, after = _decided(discoveries, wanted, "rejected")
    pairs = taken.select("subject_id", _by_kind(PREDICATES).alias("predicate"), "object_id").filter("predicate IS NOT NULL").distinct()
    new = pairs.join(rejected_pairs(negative), ["subject_id", "predicate", "object_id"], "left_anti")
    none = F.lit(None).cast("string")
    return after, negative.union(new.select("subject_id", "predicate", "object_id", none, none, F.lit(reason).cast("string")))


def confirm_kind(discoveries: DataFrame, kind: str, floor: float = kb.MEDIAN_FLOOR) -> tuple[DataFrame, DataFrame, DataFrame]:
    """:func:`confirm` for all pending discoveries of a kind; an error if their median confidence is under the floor."""
    pending = discoveries.filter((F.col("kind") == kind) & (F.col("status") == "pending"))
    gate = kb.confirmable(pending, floor).first()  # one kind, one row
    if gate is not None and not gate["allowed"]:
        raise ValueError(f"median confidence of pending {kind} is {gate['median']}, under {floor}: confirm them one by one")
    return confirm(discoveries, pending.select("id"))


def reject_kind(discoveries: DataFrame, kind: str, negative: DataFrame, reason: str | None = None) -> tuple[DataFrame, DataFrame]:
    """:func:`reject` for all pending discoveries of a kind."""
    return reject(discoveries, discoveries.filter((F.col("kind") == kind) & (F.col("status") == "pending")).select("id"), negative, reason)


def status(switch: DataFrame, discoveries: DataFrame, files: DataFrame, populators: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(enabled, pending, live_files) and the populators' states by name."""
    on = switch.agg(F.coalesce(F.max("enabled"), F.lit(False)).alias("enabled"))
    pending = discoveries.filter("status = 'pending'").agg(F.count(F.lit(1)).alias("pending"))
    alive = files.filter("deleted_at IS NULL").agg(F.count(F.lit(1)).alias("live_files"))
    one = on.crossJoin(F.broadcast(pending)).crossJoin(F.broadcast(alive))  # one row each
    return one, populators.select("name", "status", "files_visited", "discoveries_emitted", "last_error").orderBy("name")


def parse_findings(discoveries: DataFrame) -> DataFrame:
    """Findings of discoveries (id, kind, payload, confidence) by their JSON payload.

    Malformed payloads, other kinds and missing paths give nothing.
    """
    fields = {"derivedFrom-pattern": ("derivative_path", "source_path", "derived from"), "backupOf-pair": ("backup_path", "origin_path", "backup of")}
    schema = ", ".join(f"{name} string" for a, b, _ in fields.values() for name in (a, b))
    parsed = discoveries.withColumn("p", F.from_json("payload", schema))
    side = lambda i: _by_kind_columns({k: F.col(f"p.{v[i]}") for k, v in fields.items()})
    out = parsed.select("id", "kind", side(0).alias("subject"), side(1).alias("object"), _by_kind({k: v[2] for k, v in fields.items()}).alias("predicate"), "confidence")
    return out.filter("subject <> '' AND object <> ''")


def _by_kind_columns(values: dict[str, Column]) -> Column:
    out = F.lit(None).cast("string")
    for kind, value in values.items():
        out = F.when(F.col("kind") == kind, value).otherwise(out)
    return out


def shared_paths(groups: DataFrame, findings: DataFrame) -> DataFrame:
    """(hash, id) of duplicate groups (hash, path) and findings (id, subject, object) whose paths lie over or under one another.

    One path is under another if that is among its ancestors: two equal joins find both directions.
    """
    up = groups.select("hash", "path", F.explode(paths.ancestors(F.col("path"))).alias("at")).distinct()
    ends = findings.select("id", F.explode(F.array("subject", "object")).alias("end")).distinct()
    below = up.join(ends, up["at"] == ends["end"]).select("hash", "id")
    ends_up = ends.select("id", F.explode(paths.ancestors(F.col("end"))).alias("at")).distinct()
    over = groups.select("hash", "path").join(ends_up, F.col("path") == F.col("at")).select("hash", "id")
    return below.union(over).distinct()


def shared_paths_by_tree(groups: DataFrame, findings: DataFrame) -> DataFrame:
    """As :func:`shared_paths`, by intervals of the paths concerned: no path is exploded to its ancestors, and one that holds all others is no hot key."""
    ends = shared.written(findings.select("id", F.explode(F.array("subject", "object")).alias("path")).filter("path <> ''").distinct(), "ends")
    held = shared.written(groups.select("hash", "path").filter("path <> ''").distinct(), "held")
    tree = shared.written(trees.intervals(ends.select("path").union(held.select("path")).distinct()), "tree")
    of = lambda rows: tree.join(rows.select("path").distinct(), "path", "left_semi")
    below = trees.containing(of(held), of(ends)).join(held, "path").join(ends.select("id", F.col("path").alias("above")), "above").select("hash", "id")
    over = trees.containing(of(ends), of(held)).join(ends, "path").join(held.select("hash", F.col("path").alias("above")), "above").select("hash", "id")
    return below.union(over).distinct()


def board_edges(findings: DataFrame, hubs: DataFrame, pins: DataFrame, groups: DataFrame, removed: DataFrame, labels: DataFrame, drawn: DataFrame) -> DataFrame:
    """Edges (key, source, target, label, strong) of the findings board.

    A finding points at the pins (path) over either of its ends and at the hub
    (path) that is its object; a duplicate group (hash, path) shares files with a
    finding. ``removed`` (key) take edges away, ``labels`` (key, label) rename them,
    ``drawn`` are edges of the user's own.
    """
    findings = shared.written(findings, "findings")  # three branches read them
    strong = (F.col("confidence") >= 0.85).alias("strong")
    ends = findings.select("*", F.explode(F.array("subject", "object")).alias("end"))
    over = ends.select("id", "predicate", "confidence", F.explode(paths.ancestors(F.col("end"))).alias("path")).distinct()
    card = F.concat(F.lit("finding:"), F.col("id").cast("string"))
    to_pin = over.join(pins.select("path"), "path").select(F.concat(card, F.lit("~"), "path").alias("key"), card.alias("source"), F.concat(F.lit("pin:"), "path").alias("target"), F.col("predicate").alias("label"), strong)
    to_hub = findings.join(hubs.select(F.col("path").alias("object")), "object").select(F.concat(card, F.lit("~source")), card, F.concat(F.lit("source:"), "object"), "predicate", strong)
    dup = F.concat(F.lit("dup:"), F.col("hash"))
    overlap = shared_paths(groups, findings).select(F.concat(dup, F.lit("~"), card), dup, card, F.lit("shares files"), F.lit(False))
    found = to_pin.union(to_hub).union(overlap).join(removed.select("key"), "key", "left_anti")
    named = found.join(labels.select("key", F.col("label").alias("new")), "key", "left").withColumn("label", F.coalesce("new", "label")).drop("new")
    return named.union(drawn.select("key", "source", "target", "label", F.lit(True).alias("strong")))

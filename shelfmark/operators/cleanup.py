"""Cleanup candidates, plans, saved views, folder lens and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import paths
from shelfmark.operators import catalog, facts as kb

#: Reasons that are safe, roles that protect, the saved views.
SAFE = ["safe-derivative", "redundant-backup", "scratch"]
PROTECTED = ["source", "system", "asset", "tool"]
VIEWS = ["finished-untouched", "regenerable-large", "unprojected-files", "unclassified", "orphan-sources", "orphan-backups"]


def _wide(facts: DataFrame) -> DataFrame:
    """Resolved role, replaceability and sensitivity of each entity, in one pass (without source priority)."""
    rank = F.struct("confidence", "asserted_at", "id")
    pick = lambda key: F.max_by(F.struct("value", "confidence"), F.when(F.col("key") == key, rank))
    wide = facts.groupBy("entity_id").agg(pick("role").alias("r"), pick("replaceability").alias("p"), pick("sensitivity").alias("s"), F.max(F.col("key") == "role").alias("_r"), F.max(F.col("key") == "replaceability").alias("_p"), F.max(F.col("key") == "sensitivity").alias("_s"))
    return wide.select("entity_id", F.when(F.col("_r"), F.col("r.value")).alias("role"), F.when(F.col("_r"), F.col("r.confidence")).alias("role_conf"), F.when(F.col("_p"), F.col("p.value")).alias("replaceability"), F.when(F.col("_s"), F.col("s.value")).alias("sensitivity"))


def _stages(relations: DataFrame, lifecycles: DataFrame) -> DataFrame:
    """(file_id and the columns of ``lifecycles``) of each project that a file is part of."""
    part = relations.filter("predicate = 'partOf'").select(F.col("subject_id").alias("file_id"), F.col("object_id").alias("project_id"))
    return part.join(lifecycles, "project_id")


def candidates(files: DataFrame, facts: DataFrame, relations: DataFrame, lifecycles: DataFrame, pinned: DataFrame) -> DataFrame:
    """Files that may go, with the reason (C1): (file_id, path, size, reason).

    ``lifecycles`` holds (project_id, lifecycle). Protected files are left out
    by flags; the first reason that fits is given. Relations are joined once, with
    the live files they lead to and the projects they are part of, and become one
    row of flags a file.
    """
    alive = files.filter("deleted_at IS NULL")
    kinds = relations.filter("predicate IN ('derivedFrom', 'backupOf', 'partOf')").select("subject_id", "predicate", "object_id")
    to = kinds.join(alive.select(F.col("file_id").alias("object_id"), F.lit(True).alias("lives")), "object_id", "left").join(lifecycles.select(F.col("project_id").alias("object_id"), "lifecycle"), "object_id", "left")
    is_ = lambda p: F.col("predicate") == p
    flags = to.groupBy(F.col("subject_id").alias("file_id")).agg(
        F.max(is_("derivedFrom") & F.col("lives")).alias("has_source"), F.max(is_("backupOf") & F.col("lives")).alias("has_origin"),
        F.max(is_("partOf") & (F.col("lifecycle") == "active")).alias("active"), F.max(is_("partOf") & F.col("lifecycle").isin("finished", "archived")).alias("done"),
    )
    no = lambda c: ~F.coalesce(c, F.lit(False))  # noqa: E731  unknown isn't excluded
    yes = lambda c: F.coalesce(c, F.lit(False))
    wide = _wide(facts).withColumnRenamed("entity_id", "file_id")
    rows = alive.select("file_id", "path", "size").join(pinned.select("file_id"), "file_id", "left_anti")
    rows = rows.join(wide, "file_id", "left").join(flags, "file_id", "left")
    rows = rows.filter(no(F.col("sensitivity").isin("private", "restricted")) & no(F.col("replaceability") == "irreplaceable") & no(F.col("role").isin(PROTECTED)) & no(F.col("active")))
    reason = (
        F.when((F.col("role") == "derivative") & (F.col("replaceability") == "regenerable") & yes(F.col("has_source")), "safe-derivative")
        .when((F.col("role") == "backup") & yes(F.col("has_origin")), "redundant-backup")
        .when((F.col("role") == "scratch") & (F.col("role_conf") >= 0.9), "scratch")
        .when((F.col("role") == "derivative") & yes(F.col("done")), "finished-project-cruft")
    )
    return rows.select("file_id", "path", "size", reason.alias("reason")).filter("reason IS NOT NULL")


def in_scope(found: DataFrame, reasons: list[str] | None = None, most: int | None = None, prefix: str | None = None) -> DataFrame:
    """Candidates of a plan's scope, computed anew each time."""
    out = found.filter(F.col("reason").isin(reasons)) if reasons else found
    out = out.filter(F.col("size") <= most) if most is not None else out
    return out.filter(paths.under(F.col("path"), prefix)) if prefix else out


def saved_view(view: str, files: DataFrame, facts: DataFrame, relations: DataFrame, lifecycles: DataFrame, as_of: int, days: int = 365, least: int = 100 << 20) -> DataFrame:
    """One of the saved views (G1-G7): (file_id, path, size) of displayable live files."""
    alive = files.filter("deleted_at IS NULL")
    has = lambda key, value=None: facts.filter((F.col("key") == key) & (F.lit(True) if value is None else F.col("value") == value)).select(F.col("entity_id").alias("file_id")).distinct()
    if view == "finished-untouched":
        done = relations.filter("predicate = 'partOf'").join(lifecycles.filter("lifecycle IN ('finished', 'archived')"), F.col("object_id") == F.col("project_id")).select(F.col("subject_id").alias("file_id"))
        seen = [F.col(c) for c in ("accessed_at", "modified_at") if c in files.columns]
        out = alive.filter(F.coalesce(*seen, F.lit(0)) < as_of - days * paths.DAY).join(done, "file_id", "left_semi")
    elif view == "regenerable-large":
        out = alive.filter(F.col("size") > least).join(has("role", "derivative"), "file_id", "left_semi").join(has("replaceability", "regenerable"), "file_id", "left_semi")
    elif view == "unprojected-files":
        out = alive.join(relations.filter("predicate = 'partOf'").select(F.col("subject_id").alias("file_id")), "file_id", "left_anti")
    elif view == "unclassified":
        out = alive.join(has("role"), "file_id", "left_anti")
    elif view == "orphan-sources":
        living = relations.filter("predicate = 'derivedFrom'").join(alive.select(F.col("file_id").alias("subject_id")), "subject_id", "left_semi").select(F.col("object_id").alias("file_id"))
        out = alive.join(has("role", "source"), "file_id", "left_semi").join(living, "file_id", "left_anti")
    elif view == "orphan-backups":
        origin = files.select(F.col("file_id").alias("object_id"), F.col("deleted_at").alias("gone"), F.lit(True).alias("known"))
        lost = relations.filter("predicate = 'backupOf'").join(origin, "object_id", "left").filter("known IS NULL OR gone IS NOT NULL").select(F.col("subject_id").alias("file_id"))
        out = alive.join(has("role", "backup"), "file_id", "left_semi").join(lost, "file_id", "left_semi")
    else:
        raise ValueError(f"unknown view: {view}")
    shown = kb.displayed(facts, out.withColumn("entity_id", F.col("file_id")))
    return shown.select("file_id", "path", "size")


def lens(files: DataFrame, facts: DataFrame, relations: DataFrame, lifecycles: DataFrame, found: DataFrame) -> DataFrame:
    """Per folder with all below it: the role, replaceability, lifecycle and reason of most bytes, and bytes to win (L1).

    Of a file's facts that may be displayed the most confident and newest counts; so
    it does for the lifecycles (project_id, lifecycle, confidence, asserted_at,
    display) of its projects. All five measures climb together: values are summed by
    direct folder first, then by ancestor, and the largest (the smallest value on ties) stays.
    """
    alive = files.filter("deleted_at IS NULL").select("file_id", "folder_path", F.coalesce("size", F.lit(0)).alias("size"))
    top = facts.filter(F.col("display") & F.col("key").isin("role", "replaceability")).groupBy(F.col("entity_id").alias("file_id"), F.col("key").alias("lens")).agg(F.max_by("value", F.struct("confidence", "asserted_at", "id")).alias("value"))
    shown = _stages(relations, lifecycles.filter("display"))
    stage = shown.groupBy("file_id").agg(F.max_by("lifecycle", F.struct("confidence", "asserted_at", "project_id")).alias("value")).select("file_id", F.lit("lifecycle").alias("lens"), "value")
    values = top.unionByName(stage).unionByName(found.select("file_id", F.lit("cleanup_reason").alias("lens"), F.col("reason").alias("value")))
    direct = alive.join(values, "file_id").groupBy("folder_path", "lens", "value").agg(F.sum(F.greatest(F.lit(0), "size")).alias("b"), F.sum("size").alias("raw"))
    up = direct.select(F.explode(paths.ancestors(F.col("folder_path"))).alias("path"), "lens", "value", "b", "raw").groupBy("path", "lens", "value").agg(F.sum("b").alias("b"), F.sum("raw").alias("raw"))
    best = lambda name: F.min_by("value", F.when(F.col("lens") == name, F.struct(-F.col("b"), "value"))).alias(name)
    has = lambda name: F.max(F.col("lens") == name)
    names = ("role", "replaceability", "lifecycle", "cleanup_reason")
    wide = up.groupBy("path").agg(*[best(n) for n in names], *[has(n).alias(f"has_{n}") for n in names], F.sum(F.when(F.col("lens") == "cleanup_reason", F.col("raw"))).alias("won"))
    out = catalog.folders(files).select("path").join(wide, "path", "left")
    return out.select("path", *[F.when(F.col(f"has_{n}"), F.col(n)).alias(n) for n in names], F.coalesce("won", F.lit(0)).alias("reclaimable_bytes"))


def verdict(role: Column, replaceability: Column, lifecycle: Column, reason: Column, reclaimable: Column) -> Column:
    """Folder verdict (L2)."""
    protected = (replaceability == "irreplaceable") | role.isin(PROTECTED) | (lifecycle == "active")
    return (
        F.when(F.coalesce(replaceability == "irreplaceable", F.lit(False)) | F.coalesce(role.isin(PROTECTED), F.lit(False)) | F.coalesce(lifecycle == "active", F.lit(False)), "protected")
        .when(protected, "protected").when(reason.isin(SAFE), "safe").when(reason == "finished-project-cruft", "review").when(reclaimable > 0, "review").otherwise("keep")
    )


def explanation(role: Column, replaceability: Column, lifecycle: Column) -> Column:
    """Why a folder is there, in words (L3)."""
    #: Words by role, and the parts of the sentence below.
    words = {"derivative": "build / derived output", "backup": "backup copy", "scratch": "scratch / cache", "source": "source files", "asset": "project assets", "system": "system files", "tool": "tooling"}
    named = role
    for value, text in words.items():
        named = F.when(role == value, F.lit(text)).otherwise(named)
    parts = F.concat_ws(
        " · ", named, F.when(replaceability == "regenerable", "regenerable output"), F.when(replaceability == "irreplaceable", "irreplaceable — no source to rebuild from"),
        F.when(lifecycle == "active", "part of an active project"), F.when(lifecycle.isin("finished", "archived"), F.concat(F.lit("from a "), lifecycle, F.lit(" project"))),
    )
    return F.when(parts == "", F.lit("A directory in your storage.")).otherwise(F.concat(F.upper(F.substring(parts, 1, 1)), F.substring(parts, F.lit(2), F.length(parts)), F.lit(".")))


def outermost_candidates(rows: DataFrame, reasons: list[str], root: str | None = None) -> DataFrame:
    """Folders to offer: of these reasons, with bytes to win, not the root, not below another."""
    some = rows.filter(F.col("cleanup_reason").isin(reasons) & (F.col("reclaimable_bytes") > 0))
    if root is not None:
        some = some.filter(paths.normal(F.col("path")) != root.replace("\\", "/").rstrip("/"))
    return catalog.outermost(some)


#: Groups of recommendations, their reasons and risk.
GROUPS = [("build", ["safe-derivative", "scratch"], "safe"), ("backups", ["redundant-backup"], "review"), ("finished", ["finished-project-cruft"], "review")]


def recommendations(rows: DataFrame, files: DataFrame, as_of: int, root: str | None = None, enabled: bool = True) -> DataFrame:
    """Items (group, risk, path, bytes, age) of the four groups of recommendations (L4); an empty group has none.

    ``rows`` is the lens; without ``enabled`` facts only the stale files are listed.
    """
    stale = catalog.stale_files(files, as_of).select(F.lit("stale").alias("group"), F.lit("caution").alias("risk"), "path", F.col("size").alias("bytes"), paths.age_label(F.lit(as_of) - F.col("modified_at")).alias("age"))
    out = stale
    for name, reasons, risk in GROUPS if enabled else []:
        some = outermost_candidates(rows, reasons, root)
        out = out.union(some.select(F.lit(name), F.lit(risk), "path", F.col("reclaimable_bytes"), F.lit(None).cast("string")))
    return out


def recommended_total(items: DataFrame, groups: DataFrame) -> DataFrame:
    """Bytes of all items and of the duplicate groups' waste (L4)."""
    waste = groups.agg(F.coalesce(F.sum("reclaimable_bytes"), F.lit(0)).alias("waste"))
    return items.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("listed")).crossJoin(F.broadcast(waste)).select((F.col("listed") + F.col("waste")).alias("total_bytes"), "waste")  # one row each


def headline(rows: DataFrame) -> DataFrame:
    """Bytes to win in the folders that lie below no other."""
    return catalog.outermost(rows).agg(F.coalesce(F.sum("reclaimable_bytes"), F.lit(0)).alias("reclaimable_bytes"))


def expire(log: DataFrame, now: int) -> DataFrame:
    """Cleanup log with overdue rows expired."""
    over = (F.col("restore_status") == "in_recycle_bin") & F.col("expires_at").isNotNull() & (F.col("expires_at") <= now)
    return log.withColumn("restore_status", F.when(over, "expired").otherwise(F.col("restore_status")))


LOG = ["plan_id", "file_id", "original_path", "size", "cleaned_at", "reason", "restore_status", "expires_at"]


def draft_log(found: DataFrame, plan: dict, now: int, keep_days: int = 30) -> DataFrame:
    """Pending log rows of a plan's candidates: written before anything is done to a file (C3). Only a draft may be executed."""
    if plan["status"] != "draft":
        raise ValueError(f"cleanup plan {plan['id']} is not a draft (status={plan['status']})")
    return found.select(
        F.lit(plan["id"]).cast("long").alias("plan_id"), "file_id", F.col("path").alias("original_path"), "size", F.lit(now).cast("long").alias("cleaned_at"), "reason",
        F.lit("pending").alias("restore_status"), F.lit(now + max(0, keep_days) * paths.DAY).cast("long").alias("expires_at"),
    )


def settle_log(log: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Log rows and failures after the files were handed over.

    ``outcomes`` are (file_id, error, logged): without an error a file is in the
    recycle bin; one that could not be moved loses its row; one that was moved but
    not booked keeps its pending row. Both kinds are failures, alone by file.
    """
    met = log.join(outcomes, "file_id", "left")
    state = F.when(F.col("error").isNull() & F.col("logged"), "in_recycle_bin").otherwise(F.col("restore_status"))
    kept = met.filter(F.col("error").isNull() | F.col("logged").eqNullSafe(F.lit(False))).withColumn("restore_status", state).select(*LOG)
    booked = F.when(F.col("logged").eqNullSafe(F.lit(False)), F.concat(F.lit("trashed, but bookkeeping failed: "), "error")).otherwise(F.col("error"))
    failed = met.filter("error IS NOT NULL").select("file_id", F.col("original_path").alias("path"), booked.alias("reason"))
    return kept, failed


def execute(found: DataFrame, plan_id: int, now: int, keep_days: int = 30, outcomes: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame | tuple[DataFrame, DataFrame, DataFrame, dict]:
    """Log rows of a draft plan's candidates (C3): what goes, why, until when it can be restored.

    With ``files`` and ``outcomes`` also the failures, the files with deletion times
    of those that went, and the plan as executed. Without outcomes every file goes.
    """
    plan = {"id": plan_id, "status": "draft"}
    log = draft_log(found, plan, now, keep_days)
    done = outcomes if outcomes is not None else found.select("file_id", F.lit(None).cast("string").alias("error"), F.lit(True).alias("logged"))
    kept, failed = settle_log(log, done)
    if files is None:
        return kept
    gone = kept.filter("restore_status = 'in_recycle_bin'").select("file_id", F.lit(True).alias("gone"))
    after = files.join(gone, "file_id", "left").withColumn("deleted_at", F.when(F.col("gone"), F.lit(now)).otherwise(F.col("deleted_at"))).drop("gone")
    return kept, failed, after, {"id": plan_id, "status": "executed", "executed_at": now}


def restore(log: DataFrame, file_ids: list[int]) -> DataFrame:
    """Cleanup log with some files restored, if they still can be."""
    able = F.col("file_id").isin(file_ids) & (F.col("restore_status") == "in_recycle_bin")
    return log.withColumn("restore_status", F.when(able, "restored").otherwise(F.col("restore_status")))

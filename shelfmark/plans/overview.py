"""The overview of a catalog: what a user asks for first (T-11), and a run of its populators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from shelfmark.operators import catalog as C
from shelfmark.operators import duplicates as D
from shelfmark.operators import facts as KB


def overview(files: DataFrame, sessions: DataFrame, issues: DataFrame, as_of: int, limit: int = 4_000, months: int = 24) -> dict[str, DataFrame]:
    """All parts of the overview by name, each a DataFrame of its own that runs when it is read (T-11)."""
    groups = D.groups(files)
    return {
        "session": C.latest_session(sessions),
        "largest_folders": C.largest(C.folder_totals(files), "total_bytes", "path", limit),
        "largest_files": C.largest(C.live(files), "size", "file_id", limit),
        "extensions": C.largest(C.extension_stats(files), "total_bytes", "extension", limit),
        "duplicate_groups": groups.orderBy(F.desc("reclaimable_bytes"), "partial_hash", "sample_hash", "full_hash").limit(limit),
        "media": C.media_stats(files),
        "folder_media": C.folder_media(files).orderBy(F.desc("total_bytes"), "folder_path", "media_kind").limit(6 * limit),
        "timeline": C.timeline(files, as_of, months),
        "ages": C.age_bands(files, as_of),
        "issue_counts": C.issue_counts(issues, sessions),
    }


def counted_rules(files: DataFrame, rejected: DataFrame, known: DataFrame, asserted_at: int = 0) -> tuple[DataFrame, dict[str, Observation]]:
    """Facts that the rules newly assert, and observations that count along as they are computed.

    ``files`` counts the files visited, ``found`` what the rules say, ``new`` what
    is asserted; the difference was skipped. Read them after an action.
    """
    seen, said, new = Observation("files"), Observation("found"), Observation("new")
    visited = C.live(files).observe(seen, F.count(F.lit(1)).alias("n"))
    found = KB.rule_facts(visited, asserted_at=asserted_at).observe(said, F.count(F.lit(1)).alias("n"))
    return KB.emit(found, known, rejected).observe(new, F.count(F.lit(1)).alias("n")), {"files": seen, "found": said, "new": new}

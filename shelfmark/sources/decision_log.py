"""The user's decisions as an append-only log.

Every decision is an event with the number of its batch and its place there. Events are written in batches, one folder
each; a batch counts once its mark is there, and a mark is never written over, so of two writers on
one number one tries the next. What holds is what the last event of a target says, so a
state is one scan and one aggregation, however many decisions there were: no
call adds to a lineage. :meth:`DecisionLog.compact` writes the last events as one batch and drops
those before.

Targets: a relation (subject_id, predicate, object_id), a fact (subject_id, key, value),
a file (subject_id), a discovery (discovery_id) or the switch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "action string, subject_id long, predicate string, object_id long, key string, value string, discovery_id string, reason string, at long"
LOGGED = f"batch long, seq long, {EVENT}"
TARGET = ["subject_id", "predicate", "object_id", "key", "value", "discovery_id"]
#: What orders events.
ORDER = "struct(batch, seq)"


@dataclass(frozen=True)
class Decision:
    """One decision; fields that its kind doesn't need stay None."""

    action: str
    subject_id: int | None = None
    predicate: str | None = None
    object_id: int | None = None
    key: str | None = None
    value: str | None = None
    discovery_id: str | None = None
    reason: str | None = None
    at: int | None = None

    def row(self) -> tuple:
        """As EVENT's columns."""
        return (self.action, self.subject_id, self.predicate, self.object_id, self.key, self.value, self.discovery_id, self.reason, self.at)


class DecisionLog:
    """A log in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        """The folder may not exist yet."""
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _system(self):
        return self._path("marks").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _marks(self) -> list[str]:
        system, folder = self._system(), self._path("marks")
        return sorted(s.getPath().getName() for s in system.listStatus(folder)) if system.exists(folder) else []

    def batches(self) -> list[int]:
        """Numbers of the batches that count: from the last compaction on."""
        marks = self._marks()
        base = max((int(m[:12]) for m in marks if m.endswith("-base")), default=-1)
        return [int(m[:12]) for m in marks if int(m[:12]) >= base]

    def _claim(self, number: int, kind: str) -> bool:
        """Write the mark of a batch whose rows are there; whether nobody else had."""
        if any(int(m[:12]) == number for m in self._marks()):
            return False
        try:
            self._system().create(self._path("marks", f"{number:012d}-{kind}"), False).close()
        except Exception:  # noqa: BLE001  the gateway wraps the file system's error
            return False
        return True

    def append(self, decisions: DataFrame | list[Decision]) -> int:
        """Append decisions (EVENT's columns) in their order as one batch; its number.

        A table's rows are numbered by range of ``at`` and target, a list's by place.
        """
        rows = decisions
        if isinstance(decisions, list):
            rows = self.spark.createDataFrame([d.row() for d in decisions], EVENT).coalesce(1)
        else:
            rows = rows.repartitionByRange("at", *TARGET).sortWithinPartitions("at", *TARGET)
        number = max(self.batches(), default=-1) + 1
        while True:
            numbered = rows.select(F.lit(number).cast("long").alias("batch"), F.monotonically_increasing_id().alias("seq"), *[c.split()[0] for c in EVENT.split(", ")])
            folder = f"{self.root}/batches/{number:012d}"
            try:
                numbered.write.parquet(folder)
                if self._claim(number, "add"):
                    return number
            except Exception as e:
                if "already exists" not in str(e):
                    raise
            number += 1

    def events(self) -> DataFrame:
        """All events that count, as one scan."""
        folders = [f"{self.root}/batches/{n:012d}" for n in self.batches()]
        if not folders:
            return self.spark.createDataFrame([], LOGGED)
        return self.spark.read.schema(LOGGED).parquet(*folders)

    def _last(self, *actions: str) -> DataFrame:
        """The last event of each target among some actions."""
        some = self.events().filter(F.col("action").isin(*actions))
        rest = [c.split()[0] for c in LOGGED.split(", ") if c.split()[0] not in TARGET]
        return some.groupBy(*TARGET).agg(F.max_by(F.struct(*rest), F.expr(ORDER)).alias("e")).select(*TARGET, "e.*")

    # What holds -------------------------------------------------------------------

    def negatives(self) -> DataFrame:
        """Negative assertions that hold (decisions.NEGATIVE's columns): rejected relations and facts (K7)."""
        last = self._last("reject", "allow").filter("action = 'reject' AND discovery_id IS NULL")
        return last.select("subject_id", F.coalesce("predicate", F.lit("property")).alias("predicate"), "object_id", "key", "value", "reason")

    def pinned(self) -> DataFrame:
        """(file_id, pinned_at, reason) of files that are pinned (K8)."""
        last = self._last("pin", "unpin").filter("action = 'pin'")
        return last.select(F.col("subject_id").alias("file_id"), F.col("at").alias("pinned_at"), "reason")

    def is_enabled(self) -> bool:
        """The switch; off if it was never set (K9)."""
        row = self.events().filter("action IN ('enable', 'disable')").agg(F.max_by("action", F.expr(ORDER)).alias("a")).first()
        return row["a"] == "enable"

    def statuses(self, discoveries: DataFrame) -> DataFrame:
        """Discoveries with the status that was decided first, else their own (K13, K14): a decided one is never decided anew."""
        first = self.events().filter("action IN ('confirm', 'dismiss')").groupBy("discovery_id").agg(F.min_by("action", F.expr(ORDER)).alias("a"))
        said = F.when(F.col("a") == "confirm", "confirmed").when(F.col("a") == "dismiss", "rejected")
        joined = discoveries.join(first.withColumnRenamed("discovery_id", "id"), "id", "left")
        pending = F.col("status") == "pending"
        return joined.withColumn("status", F.when(pending & said.isNotNull(), said).otherwise(F.col("status"))).select(*discoveries.columns)

    def decide_kind(self, discoveries: DataFrame, kind: str, action: str, at: int) -> int:
        """Confirm or dismiss all pending discoveries of a kind as one batch."""
        pending = self.statuses(discoveries).filter((F.col("kind") == kind) & (F.col("status") == "pending"))
        none = lambda t: F.lit(None).cast(t)
        rows = pending.select(F.lit(action).alias("action"), none("long").alias("subject_id"), none("string").alias("predicate"), none("long").alias("object_id"), none("string").alias("key"), none("string").alias("value"),
                              F.col("id").cast("string").alias("discovery_id"), none("string").alias("reason"), F.lit(at).cast("long").alias("at"))
        return self.append(rows)

    def compact(self) -> int:
        """Write what still matters as one batch and drop the batches before; its number."""
        old = self.batches()
        if not old:
            return -1
        keep = self._last("reject", "allow").unionByName(self._last("pin", "unpin")).unionByName(self._last("enable", "disable").filter("action IS NOT NULL"))
        first = self.events().filter("action IN ('confirm', 'dismiss')")
        rest = [c.split()[0] for c in LOGGED.split(", ") if c.split()[0] not in TARGET]
        keep = keep.unionByName(first.groupBy(*TARGET).agg(F.min_by(F.struct(*rest), F.expr(ORDER)).alias("e")).select(*TARGET, "e.*"))
        number = old[-1] + 1
        keep.select(*[c.split()[0] for c in LOGGED.split(", ")]).write.parquet(f"{self.root}/batches/{number:012d}")
        if not self._claim(number, "base"):
            raise RuntimeError("another writer appended meanwhile: compact again")
        system = self._system()
        for mark in self._marks():
            if int(mark[:12]) < number:
                system.delete(self._path("marks", mark), False)
                system.delete(self._path("batches", mark[:12]), True)
        return number

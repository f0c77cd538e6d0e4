"""An index of a folder: scans, rescans, duplicates, totals, facts and decisions in order."""

import os

from shelfmark.operators import catalog
from shelfmark.sources.decision_log import Decision
from shelfmark.sources.index import Index

PDF = b"%PDF-1.4\n1 0 obj << /Title (A report) >>\n"


def test_scan_rescan_and_enrich(spark, tmp_path):
    tree = tmp_path / "tree"
    data = {
        "work/logo.psd": b"p" * 5_000, "work/logo.png": b"q" * 900, "work/report.pdf": PDF, "work/node_modules/lib/a.js": b"x" * 40,
        "photos/a.jpg": bytes(range(256)) * 20, "photos/b.jpg": bytes(range(256)) * 20, "photos/c.jpg": b"\xff" * 3_000, "notes.md": b"hello",
    }
    for i, (name, d) in enumerate(data.items()):
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_bytes(d)
        os.utime(tree / name, (1_600_000_000 + i, 1_600_000_000 + i))
    index = Index(spark, f"file://{tmp_path}/index", 32)
    first = index.scan(str(tree), 1_000)
    assert (first["files"], first["errors"], first["hash_issues"]) == (8, 0, 0) and first["bytes"] == sum(map(len, data.values()))
    assert [(r.size, r.members) for r in index.duplicate_groups().collect()] == [(5_120, 2)]
    totals = lambda: {os.path.relpath(r.path, tree): (r.total_files, r.total_bytes) for r in index.totals().collect() if r.path.startswith(str(tree))}
    assert totals() == {"work": (4, 5_000 + 900 + len(PDF) + 40), "work/node_modules": (1, 40), "work/node_modules/lib": (1, 40), "photos": (3, 13_240), ".": (8, first["bytes"])}

    counts = index.enrich(1_000)
    files = {r.file_id: os.path.relpath(r.path, tree) for r in index.files().collect()}
    facts = {(files[r.entity_id], r.key, r.value) for r in index.facts().collect()}
    assert ("work/report.pdf", "title", "A report") in facts and counts["facts"] == len(facts)
    found = {(r.kind, files[r.subject_id], files[r.object_id]): r for r in index.discoveries().collect()}
    assert ("derivedFrom-pattern", "work/logo.png", "work/logo.psd") in found
    pair = found["derivedFrom-pattern", "work/logo.png", "work/logo.psd"]
    index.decisions.append([Decision("confirm", discovery_id=pair.id, at=5), Decision("pin", pair.object_id, at=6)])
    assert {r.id: r.status for r in index.discoveries().collect()}[pair.id] == "confirmed"
    assert [r.file_id for r in index.decisions.pinned().collect()] == [pair.object_id]

    # A rescan of one folder: a file changes, one goes, one comes; the rest is as it was.
    (tree / "photos/b.jpg").write_bytes(b"other" * 7)
    (tree / "photos/c.jpg").unlink()
    (tree / "photos/d.jpg").write_bytes(bytes(range(256)) * 20)
    before = index.snapshots.version()
    second = index.scan(str(tree / "photos"), 2_000)
    changed = [b for b, v in index.snapshots.version().buckets.items() if before.buckets.get(b) != v]
    assert second["files"] == 3 and len(changed) == 1
    live = {os.path.relpath(r.path, tree): r for r in catalog.live(index.files()).collect()}
    assert set(live) == (set(data) - {"photos/c.jpg"}) | {"photos/d.jpg"} and live["photos/b.jpg"].size == 35
    assert [(r.size, r.members) for r in index.duplicate_groups().collect()] == [(5_120, 2)]
    assert totals()["photos"] == (3, 5_120 * 2 + 35) and totals()["."] == (8, first["bytes"] - 3_000 - 5_120 + 35 + 5_120)
    assert {os.path.relpath(r.path, tree): r.value for r in index.dominant().collect() if r.path.startswith(str(tree))}["work"] == "psd"
    assert [(r.id, r.files) for r in index.sessions().orderBy("id").collect()] == [(1_000, 8), (2_000, 3)]
    assert index.issues().count() == 0 and index.below(str(tree / "work")).count() == 4
    assert [r["name"] for r in index.search(text="logo").collect()] == ["logo.psd", "logo.png"]
    # A rejected pair isn't found again.
    index.decisions.append([Decision("reject", pair.subject_id, "derivedFrom", pair.object_id, at=7)])
    index.enrich(2_000)
    assert pair.id not in {r.id for r in index.discoveries().collect()}
    assert index.snapshots.read(0).count() == 8  # the first version is still there

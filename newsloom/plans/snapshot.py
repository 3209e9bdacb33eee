"""Named copies of all tables, and their restoration (SK7, SK8)."""

from __future__ import annotations

import fnmatch
import json

from newsloom.schema import ARTICLE_SCHEMA
from newsloom.sources.storage import Folder
from newsloom.sources.warehouse import Warehouse, stored_rows
from newsloom.streaming.state import restore_stream_state, stream_state

# --- fixed values: defaults of the command line --------------------------------
DEFAULT_REPOSITORY, DEFAULT_SNAPSHOT = "/mnt/snapshots", "snapshot"
# -------------------------------------------------------------------------------

_MANIFEST, _RESTORING, _PARTS = "_manifest.json", "_restoring", "_parts"


def _require_name(name: str) -> str:
    if not name or name.isspace():
        raise ValueError("the name is blank")
    return name


def take_snapshot(
    warehouse: Warehouse,
    repository: str = DEFAULT_REPOSITORY,
    snapshot: str = DEFAULT_SNAPSHOT,
) -> list[str]:
    """Keep every table as it is now; returns their names.

    The parts of a table are never written again, so a snapshot is a manifest that names
    them; a part is copied below ``repository/_parts`` by the first snapshot that has it
    and shared by the later ones.  The manifest also holds the streams that follow a table.
    It is written last, so that a snapshot without one is incomplete.
    A name can be used once.  Each copy is a distributed read and write.
    """
    target = Folder(warehouse.spark, f"{repository.rstrip('/')}/{_require_name(snapshot)}")
    if target.exists(_MANIFEST):
        raise ValueError(f"snapshot {snapshot!r} exists")
    shared = Folder(warehouse.spark, f"{repository.rstrip('/')}/{_PARTS}")
    published = {alias: warehouse.published(alias) for alias in warehouse.aliases()}
    tables = {}
    for table in warehouse.tables():
        # Streams first: what they add meanwhile may be in the state, but not the other way.
        streams, state = stream_state(warehouse, table), warehouse.state(table)
        for part in state.parts:
            copy = f"{state.uid}/{part}"
            if not shared.exists(f"{copy}/_SUCCESS"):
                rows = warehouse.read_parts(table, [part])
                stored_rows(rows).mode("overwrite").parquet(f"{shared.root}/{copy}")
        tables[table] = {
            "uid": state.uid,
            "parts": state.parts,
            "batches": state.batches,
            "streams": streams,
            "term_tables": warehouse.follows_terms(table),
        }
    if not target.create_text(_MANIFEST, json.dumps({"tables": tables, "published": published})):
        raise ValueError(f"snapshot {snapshot!r} exists")
    return list(tables)


def restore_snapshot(
    warehouse: Warehouse,
    repository: str = DEFAULT_REPOSITORY,
    snapshot: str = DEFAULT_SNAPSHOT,
    tables: str | None = None,
) -> list[str]:
    """Write the tables of a snapshot back; returns their names.

    ``tables`` is a comma-separated list of names, where ``*`` stands for any
    characters; without it all are restored.
    A table that exists is not overwritten but refused, before anything is
    written; a table that a broken-off restore of the same snapshot has completed is
    kept.  Tables are written aside and renamed.  Streams go on where they were: batches
    they had added are not added again.  Term tables are built again if there were any.
    An alias follows if the table it named is restored.
    """
    source = Folder(warehouse.spark, f"{repository.rstrip('/')}/{_require_name(snapshot)}")
    text = source.read_text(_MANIFEST)
    if text is None:
        raise ValueError(f"no complete snapshot {snapshot!r}")
    manifest = json.loads(text)
    kept = manifest["tables"]
    wanted = sorted(kept) if tables is None else _selected(sorted(kept), tables)
    begun = Folder(warehouse.spark, f"{warehouse.root}/{_RESTORING}")
    mine = [name for name in wanted if begun.read_text(name) == source.root]
    existing = [name for name in wanted if warehouse.has_table(name) and name not in mine]
    if existing:
        raise ValueError(f"tables exist: {existing}")
    for table in wanted:
        entry = kept[table]
        if not warehouse.has_table(table):
            begun.replace_text(table, source.root)
            copies = [f"{repository.rstrip('/')}/{_PARTS}/{entry['uid']}/{part}" for part in entry["parts"]]
            rows = warehouse.spark.read.schema(ARTICLE_SCHEMA).parquet(*copies)
            restore_stream_state(warehouse, table, entry["streams"])
            warehouse.write(rows, table, None, None, entry["batches"])
        if entry["term_tables"] and not warehouse.has_terms(table):
            warehouse.write_terms(table)
    for alias, table in manifest["published"].items():
        if table in wanted:
            warehouse.publish(table, alias)
    for table in wanted:
        begun.delete(table)
    return wanted


def _selected(present: list[str], tables: str) -> list[str]:
    wanted = set()
    for pattern in _require_name(tables).split(","):
        found = fnmatch.filter(present, pattern.strip())
        if not found:
            raise ValueError(f"not in the snapshot: {pattern.strip()!r}")
        wanted.update(found)
    return sorted(wanted)

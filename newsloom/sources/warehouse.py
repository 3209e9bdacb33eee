"""Versioned tables behind one stable name (SC3, SK1, SK2, SK4)."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from newsloom.functions.names import next_version, parse_version, table_name
from newsloom.operators.postings import (
    BASE_PART,
    MOST_SLICES,
    TermTables,
    buckets_for,
    merge_term_tables,
    slices_of_ids,
    write_term_tables,
)
from newsloom.schema import ARTICLE_SCHEMA
from newsloom.sources.catalog import CatalogTexts
from newsloom.sources.ledger import Ledger
from newsloom.sources.storage import Folder, shuffles_dropped

# --- fixed value: the stable name ----------------------------------------------
ALIAS = "articles"
# -------------------------------------------------------------------------------

_POINTERS, _TERMS, _COMPLETE, _LOG = "_published", "_terms", "complete", "_log"
_STAGING, _CLAIMS, _RETIRED, STREAM_LOG = "_staging", "_claims", "_retired", "_stream_log"
_MERGING = "merging"

# Superseded versions and parts stay this long for the queries that still read them.
RETAIN_MS = 15 * 60 * 1000
# Parts below this size are worth merging; files of a merged part have about that size.
SMALL_BYTES = 128 * 1024 * 1024


def now_ms() -> int:
    return int(time.time() * 1000)


@dataclass(frozen=True)
class TableState:
    """What a table consists of: one entry of its commit log.

    ``parts`` are the folders that hold its rows, ``batches`` the last batch of each stream
    whose rows are among them, ``retired`` the folders that have been merged into others,
    with the time of that.  ``uid`` tells tables of the same name apart.
    """

    uid: str
    parts: list[str] = field(default_factory=lambda: [BASE_PART])
    batches: dict[str, int] = field(default_factory=dict)
    retired: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class Pointer:
    """Which table a name stands for; ``generation`` counts the changes of that."""

    generation: int
    table: str | None


class Warehouse:
    """A folder of Parquet tables.

    ``{root}/articles_3/base``      the rows one version was written with
    ``{root}/articles_3/stream-..`` rows appended to it, a folder for each batch
    ``{root}/articles_3/_log``      commit log: the folders that belong to the table
    ``{root}/_published/articles``  the versions that readers have seen, the last one now
    ``{root}/_terms/articles_3``    term tables of that version, if built
    ``{root}/_staging/...``         tables that are not complete yet
    ``{root}/_claims``              version numbers in use by runs under way
    ``{root}/_retired``             superseded versions, and since when

    A version is written completely before it gets its name, and its folders are never
    written again; streams and merges add folders, which belong to the table when the
    commit log says so.  Pointer and commit log change one generation at a time: who has
    seen an old one cannot change it, so readers always see one whole state.

    With ``catalog``, the name of a database, the pointer is kept in views of Spark's catalog
    instead, for file systems that cannot create a file on the condition that there is none.
    """

    def __init__(self, spark: SparkSession, root: str, catalog: str | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.catalog = catalog
        self._folder = Folder(spark, self.root)

    def table_path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def part_path(self, table: str, part: str) -> str:
        return f"{self.root}/{table}/{part}"

    def term_path(self, table: str) -> str:
        return f"{self.root}/{_TERMS}/{table}"

    def tables(self) -> list[str]:
        return self._folder.folders()

    def has_table(self, table: str) -> bool:
        return self._folder.exists(table)

    # -- the commit log -----------------------------------------------------------

    def _log(self, table: str) -> Ledger:
        return Ledger(self._folder.within(f"{table}/{_LOG}"))

    def _logged(self, table: str) -> tuple[int, TableState]:
        generation, text = self._log(table).latest()
        if text is None:
            raise ValueError(f"no table {table!r}")
        return generation, TableState(**json.loads(text))

    def state(self, table: str) -> TableState:
        return self._logged(table)[1]

    def parts(self, table: str) -> list[str]:
        """Folders that hold the rows of a table now."""
        return self.state(table).parts

    def _change(self, table: str, change: Callable[[TableState], TableState | None]) -> bool:
        """Apply ``change`` to the newest state, again if another writer was faster; False
        if there is nothing to change."""
        while True:
            generation, state = self._logged(table)
            changed = change(state)
            if changed is None:
                return False
            if self._log(table).append(generation, json.dumps(asdict(changed))):
                return True

    def commit_batch(self, table: str, part: str, stream: str, batch: int) -> bool:
        """Let a written folder belong to the table, as batch ``batch`` of ``stream``; False
        if that batch does already."""

        def added(state: TableState) -> TableState | None:
            if state.batches.get(stream, -1) >= batch:
                return None
            return replace(
                state, parts=[*state.parts, part], batches={**state.batches, stream: batch}
            )

        return self._change(table, added)

    # -- writing ----------------------------------------------------------------

    def write(
        self,
        df: DataFrame,
        table: str,
        n_partitions: int | None = None,
        rows_per_file: int | None = None,
        batches: dict[str, int] | None = None,
    ) -> None:
        """Write ``df`` as a new table; rows are kept as they are, duplicates too.

        It is written aside and renamed when complete; a table that exists is
        never overwritten.  ``n_partitions`` shuffles the rows into that many
        ranges of ids, so that a fetch by id skips files, each cut into as many
        more as keep a range below ``SMALL_BYTES``: one task writes one range.
        Without it the partitioning of the scan is kept.
        """
        self.require_free(table)
        draft = f"{_STAGING}/{table}-{uuid.uuid4().hex}"
        scan, ready = f"{draft}/scan", f"{draft}/ready"
        try:
            rows = df
            if n_partitions is not None:
                # Ranges need a look at the ids first: at written rows, not at the source.
                rows.write.parquet(f"{self.root}/{scan}")
                rows = self.spark.read.schema(df.schema).parquet(f"{self.root}/{scan}")
                cuts = max(-(-self._folder.size(scan) // (n_partitions * SMALL_BYTES)), 1)
                rows = rows.repartitionByRange(n_partitions * cuts, "doc_id").sortWithinPartitions("doc_id")
            writer = stored_rows(rows)
            if rows_per_file is not None:
                writer = writer.option("maxRecordsPerFile", rows_per_file)
            with shuffles_dropped(self.spark):
                writer.parquet(f"{self.root}/{ready}/{BASE_PART}")
            state = TableState(uuid.uuid4().hex, batches=batches or {})
            self._log(ready).append(0, json.dumps(asdict(state)))
            self._folder.rename(ready, table)
        finally:
            self._folder.delete(draft)

    def write_part(self, df: DataFrame, table: str, part: str, more: bool = False) -> None:
        """Write a folder of a table (or ``more`` of it); its rows belong to it when they are
        committed."""
        with shuffles_dropped(df.sparkSession):
            stored_rows(df).mode("append" if more else "overwrite").parquet(self.part_path(table, part))

    def require_free(self, table: str) -> None:
        if self.has_table(table):
            raise ValueError(f"table {table!r} exists")

    def create(self, version: int, alias: str = ALIAS) -> str:
        """Create an empty version; an error if it exists."""
        table = table_name(alias, version)
        self.write(self.spark.createDataFrame([], ARTICLE_SCHEMA), table)
        return table

    def ensure(self, table: str) -> None:
        """Create a table without rows unless it exists; several may try."""
        if not self.has_table(table):
            try:
                self.write(self.spark.createDataFrame([], ARTICLE_SCHEMA), table)
            except (ValueError, OSError):
                if not self.has_table(table):
                    raise

    def drop(self, table: str) -> None:
        """Delete a table and what was derived from it; the published one stays."""
        if table in (self.published(alias) for alias in self.aliases()):
            raise ValueError(f"{table!r} is published")
        self.drop_terms(table)
        self._folder.delete(table)
        self._folder.delete(f"{STREAM_LOG}/{table}")
        self._folder.delete(f"{_RETIRED}/{table}")

    # -- term tables --------------------------------------------------------------

    def _term_markers(self, table: str) -> set[str]:
        return set(self._folder.within(f"{_TERMS}/{table}/{_COMPLETE}").files())

    def terms(self, table: str, state: TableState | None = None) -> TermTables | None:
        """The term tables of the rows the table has now (or had in ``state``), if they
        are complete."""
        return self._terms_of(table, (state or self.state(table)).parts)

    def _merging(self, table: str) -> dict[str, dict[str, list[str]]]:
        """For each part whose term tables are being merged, the parts that its tables which
        are not written yet are read from."""
        folder = self._folder.within(f"{_TERMS}/{table}/{_MERGING}")
        found = {part: folder.read_text(part) for part in folder.files()}
        return {part: json.loads(text) for part, text in found.items() if text is not None}

    def _terms_of(self, table: str, parts: list[str]) -> TermTables | None:
        # In this order: a merge that ends meanwhile is marked before it is forgotten.
        merging, marked = self._merging(table), self._term_markers(table)
        if not set(parts) <= marked | set(merging):
            return None
        standing = {part: merging[part] for part in parts if part not in marked}
        return TermTables(self.spark, self.term_path(table), tuple(parts), standing)

    def has_terms(self, table: str) -> bool:
        """Whether complete term tables describe the rows the table has now."""
        return self.terms(table) is not None

    def write_terms(self, table: str) -> None:
        """Build the term tables of a table; the markers are written last."""
        self.drop_terms(table)
        for part in self.parts(table):
            self._add_terms(table, part, buckets_for(self._folder.size(table)))

    def follows_terms(self, table: str) -> bool:
        """Whether term tables have been built, and appends are to be added to them."""
        return bool(self._merging(table) or self._term_markers(table))

    def append_terms(self, table: str, part: str) -> None:
        """Add the rows of one written folder to the term tables."""
        present = self._terms_of(table, [*({*self._merging(table)} | self._term_markers(table))])
        self._add_terms(table, part, present.n_buckets)

    def _add_terms(self, table: str, part: str, n_buckets: int) -> None:
        rows = self.read_parts(table, [part])
        write_term_tables(rows, self.term_path(table), n_buckets=n_buckets, part=part)
        self._mark_terms(table, part)

    def _mark_terms(self, table: str, part: str) -> None:
        self._folder.replace_text(f"{_TERMS}/{table}/{_COMPLETE}/{part}", table)

    def drop_terms(self, table: str) -> None:
        """Delete the term tables."""
        self._folder.delete(f"{_TERMS}/{table}/{_COMPLETE}")
        self._folder.delete(f"{_TERMS}/{table}")

    # -- merging and sweeping -----------------------------------------------------

    def compact(
        self,
        table: str | None = None,
        small_bytes: int = SMALL_BYTES,
        *,
        whole: bool = False,
        retain_ms: int | None = None,
    ) -> list[str]:
        """Merge the parts below ``small_bytes`` into one, sorted by id; returns them.

        With ``whole``, all parts are merged, however large they are; files of the merged
        part have about ``small_bytes`` either way.  Rows and ids stay as they are.  The merged part takes the place of the others in
        one change of the commit log; parts that streams add meanwhile stay, and of two
        merges of the same parts one counts.  Term tables are merged too, without looking
        at the text again, and after the rows: until then those of the old parts stand for
        them.  What is merged is shuffled one range of ids after the other.

        The old folders go with a later ``sweep``.  With ``retain_ms`` they are swept between
        the steps as well: there is then never more than one kind of table twice, of rows, of
        the terms of rows, and of postings.
        """
        table = table or self.published()
        if table is None:
            raise ValueError("nothing is published")
        state = self.state(table)
        sizes = {part: self._folder.size(f"{table}/{part}") for part in state.parts}
        small = [part for part in state.parts if whole or sizes[part] < small_bytes]
        if len(small) < 2:
            return []
        merged = f"merged-{uuid.uuid4().hex}"
        n_files = -(-sum(sizes[part] for part in small) // small_bytes)
        rows = self.read_parts(table, small)
        slices = slices_of_ids(rows, min(n_files, MOST_SLICES))
        for k, within in enumerate(slices):
            ranges = rows.where(within).repartitionByRange(max(-(-n_files // len(slices)), 1), "doc_id")
            self.write_part(ranges.sortWithinPartitions("doc_id"), table, merged, k > 0)
        terms = self._terms_of(table, small)
        if terms is not None:
            self._stand(table, merged, terms.sources())

        def swapped(now: TableState) -> TableState | None:
            if not set(small) <= set(now.parts):
                return None
            kept = [part for part in now.parts if part not in small]
            return replace(now, parts=[merged, *kept], retired={**now.retired, **dict.fromkeys(small, now_ms())})

        if not self._change(table, swapped):
            self._delete_part(table, merged)
            return []
        if retain_ms is not None:
            self._sweep_parts(table, retain_ms)
        if terms is not None:
            self._merge_terms(table, terms, merged, retain_ms)
        return small

    def _stand(self, table: str, merged: str, sources: dict[str, list[str]]) -> None:
        self._folder.replace_text(f"{_TERMS}/{table}/{_MERGING}/{merged}", json.dumps(sources))

    def _merge_terms(self, table: str, terms: TermTables, merged: str, retain_ms: int | None) -> None:
        """Merge the term tables of a part that has been committed; each has its readers as
        soon as it is written, and those merged into it are superseded from then on."""
        standing = terms.sources()
        old = {part for parts in standing.values() for part in parts}

        def restamped(state: TableState) -> TableState | None:
            again = {part: now_ms() for part in old if part in state.retired}
            return replace(state, retired={**state.retired, **again}) if again else None

        def switch(written: tuple[str, ...]) -> None:
            for name in written:
                del standing[name]
            if standing:
                self._stand(table, merged, standing)
            else:
                self._mark_terms(table, merged)
                self._folder.delete(f"{_TERMS}/{table}/{_MERGING}/{merged}")
            self._change(table, restamped)
            if retain_ms is not None:
                self._sweep_parts(table, retain_ms)

        merge_term_tables(terms, merged, switch)
        state = self.state(table)
        if merged not in {*state.parts, *state.retired}:  # merged again and swept meanwhile
            self._delete_part(table, merged)

    def _delete_part(self, table: str, part: str) -> bool:
        """Delete what there is of a part, but for term tables that stand for those of a part
        it was merged into; False if there are any."""
        self._folder.delete(f"{_TERMS}/{table}/{_MERGING}/{part}")
        state, merging = self.state(table), self._merging(table)
        known = [merging[merged] for merged in {*state.parts, *state.retired} if merged in merging]
        kept = {name for sources in known for name, parts in sources.items() if part in parts}
        if not kept:
            self._folder.delete(f"{_TERMS}/{table}/{_COMPLETE}/{part}")
        if self._folder.exists(f"{_TERMS}/{table}"):
            TermTables(self.spark, self.term_path(table), (part,)).delete(kept)
        self._folder.delete(f"{table}/{part}")
        return not kept

    def retire(self, table: str) -> None:
        """Note that a version is superseded; a later ``sweep`` deletes it."""
        self._folder.create_text(f"{_RETIRED}/{table}", str(now_ms()))

    def sweep(self, retain_ms: int = RETAIN_MS) -> list[str]:
        """Delete the versions and parts that were superseded ``retain_ms`` ago or earlier;
        returns them.  Queries built before that, and not done yet, would fail."""
        before, gone = now_ms() - retain_ms, []
        published = {self.published(alias) for alias in self.aliases()}
        for table in self._folder.within(_RETIRED).files():
            since = self._folder.read_text(f"{_RETIRED}/{table}")
            if table not in published and since is not None and int(since) <= before:
                self.drop(table)
                gone.append(table)
        for table in self.tables():
            try:
                gone += self._sweep_parts(table, retain_ms)
            except ValueError:  # dropped by another run since the tables were listed
                continue
        return gone

    def _sweep_parts(self, table: str, retain_ms: int) -> list[str]:
        before = now_ms() - retain_ms
        old = [part for part, since in self.state(table).retired.items() if since <= before]
        old = [part for part in old if self._delete_part(table, part)]

        def forgotten(state: TableState) -> TableState:
            return replace(state, retired={p: t for p, t in state.retired.items() if p not in old})

        if old:
            self._change(table, forgotten)
        return [f"{table}/{part}" for part in old]

    # -- publishing -------------------------------------------------------------

    def aliases(self) -> list[str]:
        if self.catalog is not None:
            return CatalogTexts.names(self.spark, self.catalog)
        return self._folder.within(_POINTERS).folders()

    def _pointers(self, alias: str) -> Ledger:
        if self.catalog is not None:
            return Ledger(CatalogTexts(self.spark, self.catalog, alias))
        return Ledger(self._folder.within(f"{_POINTERS}/{alias}"))

    def pointer(self, alias: str = ALIAS) -> Pointer:
        """What ``alias`` stands for; an error unless it is one table or none."""
        generation, text = self._pointers(alias).latest()
        names = [] if text is None else text.split()
        if text is not None and len(names) != 1:
            raise ValueError(f"expected one table behind {alias!r}, found {names}")
        return Pointer(generation, names[0] if names else None)

    def published(self, alias: str = ALIAS) -> str | None:
        """Name of the version behind ``alias``."""
        return self.pointer(alias).table

    def version(self, alias: str = ALIAS) -> int | None:
        table = self.published(alias)
        if table is None:
            return None
        version = parse_version(table)
        if version is None:
            raise ValueError(f"{table!r} does not end with a version number")
        return version

    def next_table(self, alias: str = ALIAS) -> str:
        """The first name above the published version and all that are kept."""
        kept = [parse_version(name) for name in self.tables() if name.startswith(f"{alias}_")]
        known = [v for v in [self.version(alias), *kept] if v is not None]
        return table_name(alias, next_version(max(known, default=None)))

    def claim_next(self, alias: str = ALIAS) -> str:
        """``next_table``, for this run alone until it is released."""
        table = self.next_table(alias)
        while True:
            if self._folder.create_text(f"{_CLAIMS}/{table}", str(now_ms())):
                if not self.has_table(table):
                    return table
                self.release(table)  # completed by another run since the tables were listed
            table = table_name(alias, next_version(parse_version(table)))

    def release(self, table: str) -> None:
        self._folder.delete(f"{_CLAIMS}/{table}")

    def publish(self, table: str, alias: str = ALIAS) -> None:
        """Let ``alias`` name ``table`` from now on, whatever it named before."""
        while not self.publish_after(self.pointer(alias), table, alias):
            pass

    def publish_after(self, seen: Pointer, table: str, alias: str = ALIAS) -> bool:
        """``publish``, unless ``alias`` has changed since ``seen``; of several runs that
        have seen the same, one publishes."""
        if not self.has_table(table):
            raise ValueError(f"no table {table!r} to publish")
        if not self._pointers(alias).append(seen.generation, table):
            return False
        self._folder.delete(f"{_RETIRED}/{table}")
        self.read(table).createOrReplaceTempView(alias)
        return True

    # -- reading ----------------------------------------------------------------

    def read_parts(self, table: str, parts: list[str]) -> DataFrame:
        paths = [self.part_path(table, part) for part in parts]
        return self.spark.read.schema(ARTICLE_SCHEMA).parquet(*paths)

    def read(self, table: str) -> DataFrame:
        """The rows a table has now, by name."""
        return self.read_parts(table, self.state(table).parts)

    def scan(self, alias: str = ALIAS) -> DataFrame:
        """The published version, whichever it is."""
        return self.view(alias)[0]

    def view(self, alias: str = ALIAS) -> tuple[DataFrame, TermTables | None]:
        """The published rows, and the term tables of just these rows if there are any."""
        table = self.published(alias)
        if table is None:
            raise ValueError(f"nothing is published as {alias!r}")
        state = self.state(table)
        return self.read_parts(table, state.parts), self.terms(table, state)


def stored_rows(rows: DataFrame):
    """A writer of articles.  Filters keep the links of a file apart, so that a look-up of
    one link skips the row groups without it."""
    return rows.write.options(
        **{
            "compression": "zstd",
            "parquet.bloom.filter.enabled#link": "true",
            "parquet.bloom.filter.adaptive.enabled": "true",
        }
    )

import json
from types import SimpleNamespace

import pytest

from newsloom.plans import ask
from newsloom.plans.refresh import RefreshOptions, refresh
from newsloom.plans.snapshot import restore_snapshot, take_snapshot
from newsloom.schema import ARTICLE_SCHEMA, RAW_FIELDS
from newsloom.sources.ledger import Ledger
from newsloom.sources.storage import Folder, scratch_folder
from newsloom.sources.warehouse import Warehouse
from newsloom.streaming.refresh import follow_files, refresh_periodically


def line(i, **fields):
    row = {name: f"{name} {i}" for name in RAW_FIELDS} | {"date": "2018-05-26"} | fields
    return json.dumps(row)


def write(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")
    return str(folder)


@pytest.fixture()
def source(tmp_path):
    lines = [line(i, short_description="in and" if i % 4 == 0 else "the end") for i in range(40)]
    lines[5] = line(5, date="yesterday")
    lines.append("not json")
    return write(tmp_path / "news", "a.json", lines)


@pytest.fixture()
def warehouse(spark, tmp_path):
    return Warehouse(spark, str(tmp_path / "warehouse"))


def same(left, right):
    return left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


def test_refresh_publishes_the_next_version(spark, warehouse, source, lexicon):
    assert warehouse.published() is None and warehouse.next_table() == "articles_1"
    with pytest.raises(ValueError, match="nothing is published"):
        warehouse.scan()
    first = refresh(warehouse, lexicon, RefreshOptions(source))
    assert (first.total_indexed, first.accepted, first.rejected) == (40, 39, 1)
    assert first.new_index_name == "articles_1" == warehouse.published()
    rows = warehouse.scan()
    assert rows.schema.names == ARTICLE_SCHEMA.names
    assert rows.count() == rows.select("doc_id").distinct().count() == 39
    assert rows.where("sentiment_polarity = 'Negative'").count() == 10
    assert spark.table("articles").count() == 39

    second = refresh(warehouse, lexicon, RefreshOptions(source, max_news=7, n_partitions=3, leave_old=True))
    assert (second.total_indexed, second.accepted, second.rejected) == (7, 6, 1)
    assert warehouse.tables() == ["articles_1", "articles_2"]
    third = refresh(warehouse, lexicon, RefreshOptions(source, max_news=0, retain_ms=0))
    assert (third.total_indexed, third.new_index_name) == (0, "articles_3")
    assert warehouse.tables() == ["articles_1", "articles_3"] and warehouse.scan().count() == 0


@pytest.mark.parametrize("options", [{}, {"max_news": None}, {"max_news": None, "n_partitions": 3}, {"term_tables": True}])
@pytest.mark.parametrize("text", ["", "junk"])
def test_refresh_from_nothing(warehouse, lexicon, tmp_path, options, text):
    folder = tmp_path / "empty"
    folder.mkdir()
    (folder / "a.json").write_text(text)
    summary = refresh(warehouse, lexicon, RefreshOptions(str(folder), **options))
    assert (summary.total_indexed, summary.rejected, warehouse.scan().count()) == (0, 0, 0)
    assert ask.fulltext_search(warehouse, "x").collect() == []
    assert ask.category_stats(warehouse, "x").collect() == []
    assert ask.significant_words(warehouse, "x").collect() == []


def test_failed_run_leaves_the_published_version(warehouse, source, lexicon, tmp_path):
    refresh(warehouse, lexicon, RefreshOptions(source))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        refresh(warehouse, lexicon, RefreshOptions(str(tmp_path / "nowhere"), max_news=None))
    assert warehouse.published() == "articles_1" and warehouse.scan().count() == 39
    # What a run that died before publishing leaves behind has no name of a version.
    assert warehouse.tables() == ["articles_1"]
    # A version that is kept is not touched: the next free name is taken.
    warehouse.write(warehouse.scan().limit(3), "articles_2")
    assert refresh(warehouse, lexicon, RefreshOptions(source)).accepted == 39
    assert warehouse.published() == "articles_3" and warehouse.scan().count() == 39
    assert warehouse.read("articles_2").count() == 3


def test_refresh_after_going_back_keeps_the_later_version(warehouse, source, lexicon):
    for _ in range(2):
        refresh(warehouse, lexicon, RefreshOptions(source, leave_old=True))
    before = warehouse.read("articles_2").collect()
    warehouse.publish("articles_1")
    assert refresh(warehouse, lexicon, RefreshOptions(source, max_news=5, leave_old=True)).new_index_name == "articles_3"
    assert sorted(warehouse.read("articles_2").collect()) == sorted(before)
    with pytest.raises(ValueError, match="exists"):
        warehouse.write(warehouse.scan(), "articles_2")


def test_everything_is_read_by_default(spark, warehouse, lexicon, tmp_path):
    n = 300_001
    rows = spark.range(0, n, numPartitions=4).selectExpr(
        "concat('[\"c\",\"h\",\"a\",\"l', id, '\",\"s\",\"2018-05-26\"]') AS value"
    )
    rows.write.text(str(tmp_path / "many"))
    summary = refresh(warehouse, lexicon, RefreshOptions(str(tmp_path / "many")))
    assert (summary.accepted, summary.dropped, summary.limit_cut) == (n, 0, False)
    assert warehouse.scan().count() == n


def test_summary_tells_of_dropped_lines_and_of_the_limit(warehouse, source, lexicon):
    summary = refresh(warehouse, lexicon, RefreshOptions(source))
    assert (summary.dropped, summary.limit_cut) == (1, False)
    assert refresh(warehouse, lexicon, RefreshOptions(source, max_news=40)).limit_cut is False
    cut = refresh(warehouse, lexicon, RefreshOptions(source, max_news=39))
    assert (cut.total_indexed, cut.dropped, cut.limit_cut) == (39, None, True)
    assert refresh(warehouse, lexicon, RefreshOptions(source, max_news=0)).limit_cut is True


def test_overtaken_run_does_not_publish(warehouse, source, lexicon, monkeypatch):
    refresh(warehouse, lexicon, RefreshOptions(source, leave_old=True))
    warehouse.write(warehouse.scan(), "articles_7")
    write_rows = warehouse.write

    def overtaken(*args, **kwargs):
        write_rows(*args, **kwargs)
        warehouse.publish("articles_7")

    monkeypatch.setattr(warehouse, "write", overtaken)
    with pytest.raises(ValueError, match="has moved"):
        refresh(warehouse, lexicon, RefreshOptions(source))
    assert warehouse.published() == "articles_7" and warehouse.has_table("articles_1")


def test_create_fails_if_the_table_exists(warehouse):
    assert warehouse.create(1) == "articles_1"
    assert warehouse.has_table("articles_1") and warehouse.read("articles_1").count() == 0
    with pytest.raises(ValueError, match="exists"):
        warehouse.create(1)
    warehouse.publish("articles_1")
    with pytest.raises(ValueError, match="published"):
        warehouse.drop("articles_1")
    warehouse.create(2)
    warehouse.drop("articles_2")
    assert warehouse.tables() == ["articles_1"]


def test_pointer_must_name_one_version(warehouse):
    warehouse.create(1)
    warehouse.publish("articles_1")
    pointers = Ledger(Folder(warehouse.spark, f"{warehouse.root}/_published/articles"))
    assert pointers.append(1, "articles_1\narticles_2")
    with pytest.raises(ValueError, match="exactly|one table"):
        warehouse.published()
    assert pointers.append(2, "articles_x")
    with pytest.raises(ValueError, match="version"):
        warehouse.version()
    with pytest.raises(ValueError, match="no table"):
        warehouse.publish("articles_9")
    warehouse.publish("articles_1")
    assert warehouse.version() == 1


def test_rows_per_file_and_duplicates(spark, warehouse, source, lexicon, tmp_path):
    twice = write(tmp_path / "twice", "a.json", [line(1)] * 25)
    refresh(warehouse, lexicon, RefreshOptions(twice, rows_per_file=10))
    rows = warehouse.scan()
    assert rows.count() == 25 and rows.select("doc_id").distinct().count() == 25
    assert len(rows.inputFiles()) == 3


def test_snapshot_roundtrip(spark, warehouse, source, lexicon, tmp_path):
    refresh(warehouse, lexicon, RefreshOptions(source))
    refresh(warehouse, lexicon, RefreshOptions(source, max_news=5, leave_old=True))
    repository = str(tmp_path / "snapshots")
    assert take_snapshot(warehouse, repository, "s") == ["articles_1", "articles_2"]
    with pytest.raises(ValueError, match="exists"):
        take_snapshot(warehouse, repository, "s")

    whole = Warehouse(spark, str(tmp_path / "whole"))
    assert restore_snapshot(whole, repository, "s") == ["articles_1", "articles_2"]
    assert whole.published() == "articles_2"
    for table in whole.tables():
        assert same(whole.read(table), warehouse.read(table))
    with pytest.raises(ValueError, match="tables exist"):
        restore_snapshot(whole, repository, "s", "articles_1")

    part = Warehouse(spark, str(tmp_path / "part"))
    assert restore_snapshot(part, repository, "s", "articles_1") == ["articles_1"]
    assert part.published() is None and part.tables() == ["articles_1"]
    with pytest.raises(ValueError, match="not in the snapshot"):
        restore_snapshot(part, repository, "s", "articles_2, articles_7")
    assert restore_snapshot(part, repository, "s", "articles_2") == ["articles_2"]
    assert part.published() == "articles_2"
    some = Warehouse(spark, str(tmp_path / "some"))
    assert restore_snapshot(some, repository, "s", "*_2") == ["articles_2"]
    with pytest.raises(ValueError, match="no complete snapshot"):
        restore_snapshot(part, repository, "other")
    with pytest.raises(ValueError, match="blank"):
        take_snapshot(warehouse, repository, " ")


def test_follow_files_appends_only_new_files(spark, warehouse, source, lexicon, tmp_path):
    checkpoint = str(tmp_path / "checkpoint")

    def follow():
        follow_files(warehouse, lexicon, source, checkpoint).awaitTermination()
        rows = warehouse.scan()
        assert rows.count() == rows.select("doc_id").distinct().count()
        return rows.count()

    assert follow() == 39
    assert follow() == 39
    write(tmp_path / "news", "b.json", [line(100 + i) for i in range(10)] + ["{}"])
    assert follow() == 49
    assert warehouse.published() == "articles_1"


def test_follow_files_after_a_refresh(spark, warehouse, source, lexicon, tmp_path):
    refresh(warehouse, lexicon, RefreshOptions(source))
    more = write(tmp_path / "more", "b.json", [line(100 + i) for i in range(10)])
    follow_files(warehouse, lexicon, more, str(tmp_path / "checkpoint")).awaitTermination()
    rows = warehouse.scan()
    assert warehouse.published() == "articles_1"
    assert rows.count() == rows.select("doc_id").distinct().count() == 49


def test_two_sources_are_one_table(spark, warehouse, source, lexicon, tmp_path):
    more = write(tmp_path / "more", "b.json", [line(100 + i) for i in range(10)])
    summaries = []
    follow_files(warehouse, lexicon, source, str(tmp_path / "one"), on_summary=summaries.append).awaitTermination()
    follow_files(warehouse, lexicon, more, str(tmp_path / "two"), on_summary=summaries.append).awaitTermination()
    write(tmp_path / "news", "c.json", [line(200 + i) for i in range(5)])
    follow_files(warehouse, lexicon, source, str(tmp_path / "one"), on_summary=summaries.append).awaitTermination()
    rows = warehouse.scan()
    assert rows.count() == rows.select("doc_id").distinct().count() == rows.select("link").distinct().count() == 54
    assert [(s.total_indexed, s.accepted, s.rejected, s.dropped) for s in summaries] == [(40, 39, 1, 1), (10, 10, 0, 0), (5, 5, 0, 0)]


def test_second_stream_over_a_source_is_refused(spark, warehouse, source, lexicon, tmp_path):
    follow_files(warehouse, lexicon, source, str(tmp_path / "one")).awaitTermination()
    before = warehouse.scan().collect()
    with pytest.raises(ValueError, match="already follows"):
        follow_files(warehouse, lexicon, source + "/", str(tmp_path / "lost checkpoint"))
    assert sorted(warehouse.scan().collect()) == sorted(before)


def test_repeated_batch_replaces_itself(spark, warehouse, source, lexicon, tmp_path):
    refresh(warehouse, lexicon, RefreshOptions(write(tmp_path / "old", "a.json", [line(900)]), term_tables=True))
    checkpoint = tmp_path / "one"
    follow_files(warehouse, lexicon, source, str(checkpoint)).awaitTermination()
    before = warehouse.scan().collect()
    # As after a failure between the work and the note that it is done.
    for name in (checkpoint / "commits").iterdir():
        name.unlink()
    follow_files(warehouse, lexicon, source, str(checkpoint)).awaitTermination()
    assert sorted(warehouse.scan().collect()) == sorted(before) and len(before) == 40
    assert warehouse.has_terms("articles_1")
    assert len(ask.fulltext_search(warehouse, "end", size=100).collect()) == 29


def test_stale_stream_ends_and_changes_nothing(spark, warehouse, source, lexicon, tmp_path):
    old = write(tmp_path / "old", "a.json", [line(900)])
    refresh(warehouse, lexicon, RefreshOptions(old))
    query = follow_files(warehouse, lexicon, source, str(tmp_path / "one"), interval_ms=200)
    while query.isActive and warehouse.scan().count() < 40:
        query.awaitTermination(0.1)
    summary = refresh(warehouse, lexicon, RefreshOptions(source, retain_ms=0))
    write(tmp_path / "news", "later.json", [line(700)])
    with pytest.raises(Exception, match="no longer followed"):
        query.awaitTermination(60)
    assert warehouse.published() == summary.new_index_name == "articles_2"
    assert warehouse.tables() == ["articles_2"] and warehouse.scan().count() == 39
    with pytest.raises(ValueError, match="is published"):
        follow_files(warehouse, lexicon, source, str(tmp_path / "two"), table="articles_1")


def test_term_tables_follow_appends(spark, warehouse, source, lexicon, tmp_path):
    refresh(warehouse, lexicon, RefreshOptions(source, term_tables=True))
    more = write(tmp_path / "more", "b.json", [line(100 + i, short_description="walrus the") for i in range(10)])
    follow_files(warehouse, lexicon, more, str(tmp_path / "one")).awaitTermination()
    assert warehouse.has_terms("articles_1")
    plain = Warehouse(spark, str(tmp_path / "plain"))
    plain.write(warehouse.scan(), "articles_1")
    plain.publish("articles_1")
    for query in ("walrus", "the end", "in"):
        found = [[(h.doc_id, round(h.score, 9)) for h in ask.fulltext_search(w, query, size=60).collect()] for w in (warehouse, plain)]
        assert found[0] == found[1] != []
        assert ask.significant_words(warehouse, query).collect() == ask.significant_words(plain, query).collect()
        assert ask.significant_sizes(warehouse, query).first() == ask.significant_sizes(plain, query).first()
        assert ask.category_stats(warehouse, query, size=4).collect() == ask.category_stats(plain, query, size=4).collect()


def test_broken_off_restore_can_be_repeated(spark, warehouse, source, lexicon, tmp_path, monkeypatch):
    for _ in range(2):
        refresh(warehouse, lexicon, RefreshOptions(source, leave_old=True))
    take_snapshot(warehouse, str(tmp_path / "snapshots"), "s")
    other = Warehouse(spark, str(tmp_path / "other"))
    write_table = other.write

    def failing(df, table, *args):
        if table == "articles_2":
            raise RuntimeError("broken off")
        write_table(df, table, *args)

    monkeypatch.setattr(other, "write", failing)
    with pytest.raises(RuntimeError):
        restore_snapshot(other, str(tmp_path / "snapshots"), "s")
    assert other.tables() == ["articles_1"] and other.published() is None
    monkeypatch.undo()
    assert restore_snapshot(other, str(tmp_path / "snapshots"), "s") == ["articles_1", "articles_2"]
    assert other.published() == "articles_2" and same(other.scan(), warehouse.scan())
    with pytest.raises(ValueError, match="tables exist"):
        restore_snapshot(other, str(tmp_path / "snapshots"), "s")


def test_periodic_refresh(warehouse, source, lexicon):
    runs = []
    query = refresh_periodically(warehouse, lexicon, RefreshOptions(source, leave_old=True), 2000, runs.append)
    while query.isActive and len(runs) < 2:
        query.awaitTermination(0.1)
    query.stop()
    assert [run.new_index_name for run in runs[:2]] == ["articles_1", "articles_2"]
    assert {run.accepted for run in runs} == {39}


def test_periodic_refresh_ends_on_the_first_error(warehouse, lexicon, tmp_path):
    options = RefreshOptions(str(tmp_path / "nowhere"), max_news=None)
    query = refresh_periodically(warehouse, lexicon, options, 100)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        query.awaitTermination(60)
    assert not query.isActive


def test_scratch_folder_is_shared(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    folder = scratch_folder(spark, "x")
    assert folder.startswith(f"{shared}/") and folder != scratch_folder(spark, "x")


@pytest.mark.parametrize("master", ["local", "local[8]", "local-cluster[2,1,1024]", "yarn", "spark://host:7077", ""])
def test_scratch_folder_without_a_shared_one(spark, master):
    session = SimpleNamespace(conf=SimpleNamespace(get={"spark.master": master}.get), sparkContext=spark.sparkContext)
    if master in ("local", "local[8]"):
        assert scratch_folder(session, "x") != scratch_folder(session, "x")
    else:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch_folder(session, "x")


def test_refresh_removes_its_scratch_data(spark, warehouse, source, lexicon, monkeypatch):
    folders = []

    def remembered(session, label):
        folders.append(scratch_folder(session, label))
        return folders[-1]

    monkeypatch.setattr("newsloom.plans.refresh.scratch_folder", remembered)
    assert refresh(warehouse, lexicon, RefreshOptions(source, max_news=3)).total_indexed == 3
    assert len(folders) == 1 and not Folder(spark, folders[0]).exists("")


def test_summary_as_frame(spark, warehouse, source, lexicon):
    row = refresh(warehouse, lexicon, RefreshOptions(source)).as_frame(spark).first()
    assert (row.total_indexed, row.new_index_name) == (40, "articles_1")
    assert row.elapsed_ms > 0


def test_ranges_of_ids_are_cut_when_they_are_large(spark, make_articles, tmp_path, monkeypatch):
    rows = make_articles(*[{"headline": f"w{i} {i * 7919}"} for i in range(400)]).localCheckpoint()
    sizes = []
    for limit, name in ((1 << 27, "articles_1"), (1000, "articles_2")):
        monkeypatch.setattr("newsloom.sources.warehouse.SMALL_BYTES", limit)
        warehouse = Warehouse(spark, str(tmp_path / "warehouse"))
        warehouse.write(rows.repartition(3), name, n_partitions=4)
        assert sorted(warehouse.read(name).collect()) == sorted(rows.collect())
        sizes.append(len(warehouse.read(name).inputFiles()))
    assert sizes[0] == 4 and sizes[1] > 4

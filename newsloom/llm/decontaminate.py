"""Benchmark decontamination: a prefix-filtered join of benchmark windows with documents.

A window is ``WINDOW`` consecutive words of an item, or all words of a shorter item.  Its
shingles are put in order of rarity among the documents, which one pass over them counts.  A
document that contains the window contains every shingle of it, so its necessary prefix is
the rarest one: a second pass joins only these with the documents, and where one occurs
with room for the window before and behind it, the words around it are compared with the
whole window.

Only DataFrame functions are used.  Nothing but counts and verified windows leaves a task.
The benchmark's tables are broadcast if they have at most ``MAX_BROADCAST`` rows (with their
lists of ids), and joined by shuffle if they have more.

Defined results: NULL, empty and wordless texts have no words, hits or items; items
without words have no windows; repeated items count once by their id, repeated documents
get equal rows; rows without id are judged like others; an empty benchmark hits nothing;
other columns are ignored, and kept by ``clean``.  Texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import stored

WINDOW = 10
SHINGLE = 3
MAX_BROADCAST = 500_000
#: Files of the tables that follow from the benchmark.
BENCHMARK_FILES = 16
#: Words of a document that are taken apart at a time; each block sees the windows around it.
BLOCK = 1_024

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KEY = ["_hash", "_check"]


def words(text: str) -> Column:
    """Words of a text with A-Z lower-cased; none for NULL."""
    column = F.coalesce(F.col(text), F.lit(""))
    # Of ASCII text, lower() changes just A-Z, and is much faster than translate().
    ascii_only = F.octet_length(column) == F.char_length(column)
    lowered = F.when(ascii_only, F.lower(column)).otherwise(F.translate(column, _UPPER, _LOWER))
    return F.array_remove(F.split(lowered, _BETWEEN), "")


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with 96 bits that stand for the text."""
    return docs.withColumns({"_hash": F.xxhash64("text"), "_check": F.hash("text")})


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(window, size, items): the words of each different window and the ids of its items."""
    cut = items.select("item_id", words("text").alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    rows = cut.select("item_id", "w", size.alias("size")).select(
        "item_id",
        "size",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size("w") - F.col("size") + 1),
                lambda i: F.slice("w", i, F.col("size")),
            )
        ).alias("window"),
    )
    ids = F.sort_array(F.collect_set(F.col("item_id").cast("string")))
    return rows.groupBy("window", "size").agg(ids.alias("items"))


def _window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """(wid, window, size, items, k, offset, h): the shingles of each window, as hashes."""
    k = F.least("size", F.lit(shingle))
    rows = windows.withColumns({"wid": F.xxhash64("window"), "k": k}).select(
        "wid", "window", "size", "items", "k",
        F.explode(F.sequence(F.lit(0), F.col("size") - F.col("k"))).alias("offset"),
    )
    hashed = F.lit(None).cast("long")
    for width in range(1, shingle + 1):
        each = [F.get("window", F.col("offset") + i) for i in range(width)]
        hashed = F.when(F.col("k") == width, F.xxhash64(F.lit(width), *each)).otherwise(hashed)
    return rows.withColumn("h", hashed)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MAX_BROADCAST else df


def _shingles(docs: DataFrame, width: int, window: int) -> DataFrame:
    """(key, n_words, pos, h, near): the shingles of ``width`` words of all documents, and the
    words up to a window before and behind; these are only made where they are used."""
    cut = _keyed(docs.select("text")).select(*KEY, words("text").alias("w"))
    n_words = F.size("w")
    begins = F.sequence(F.lit(0), F.greatest(n_words - 1, F.lit(0)), F.lit(BLOCK))
    cut = cut.select(*KEY, "w", n_words.alias("n_words"), F.explode(begins).alias("begin"))
    base = F.greatest(F.col("begin") - (window - 1), F.lit(0))
    part = F.slice("w", base + 1, F.lit(BLOCK + 2 * (window - 1)))
    cut = cut.select(*KEY, "n_words", "begin", base.alias("base"), part.alias("part"))
    names = [f"w{i}" for i in range(width)]
    inside = F.col("begin") - F.col("base") + 1
    shifted = [F.slice("part", inside + i, F.lit(BLOCK)).alias(x) for i, x in enumerate(names)]
    each = cut.select("*", F.posexplode(F.arrays_zip(*shifted)).alias("at", "z"))
    each = each.where(F.col(f"z.{names[-1]}").isNotNull())
    pos = F.col("begin") + F.col("at")
    near = F.slice("part", _near(pos, window) - F.col("base") + 1, F.lit(2 * window - 1))
    h = F.xxhash64(F.lit(width), *[F.col(f"z.{x}") for x in names])
    return each.select(*KEY, "n_words", pos.alias("pos"), h.alias("h"), near.alias("near"))


def _near(pos: Column, window: int) -> Column:
    return F.greatest(pos - (window - 1), F.lit(0))


def _counts(docs: DataFrame, parts: DataFrame, widths: list[int], window: int) -> DataFrame:
    """(h, n): how often the shingles of the benchmark occur in the documents."""
    known = parts.select("k", "h").distinct()
    n, found = known.count(), None
    for width in widths:
        mine = _small(known.where(F.col("k") == width).select("h"), n)
        rows = _shingles(docs, width, window).select("h").join(mine, "h")
        found = rows if found is None else found.unionByName(rows)
    return found.groupBy("h").agg(F.count("*").alias("n"))


def _hits(docs: DataFrame, items: DataFrame, window: int, shingle: int) -> DataFrame | None:
    """(key, start, size, items): the verified windows; None if there is nothing to find."""
    # Of the size of the benchmark: few files.
    parts = _window_shingles(benchmark_windows(items, window), shingle)
    parts = stored(parts.coalesce(BENCHMARK_FILES), "windows")
    widths = sorted(r.k for r in parts.select("k").distinct().collect())  # at most three
    if not widths:
        return None
    counts = stored(_counts(docs, parts, widths, window), "counts")

    # The rarest shingle of each window; a window with one that never occurs is gone.
    often = F.coalesce("n", F.lit(0)).alias("n")
    ranked = parts.join(counts, "h", "left").groupBy("wid", "size", "k", "items", "window").agg(
        F.min(F.struct(often, "h", "offset")).alias("rarest")
    )
    probes = ranked.where("rarest.n > 0").select(
        "k", "rarest.h", F.struct("rarest.offset", "size", "items", "window").alias("probe")
    )
    # One row a shingle, so that the join multiplies no rows.
    probes = probes.groupBy("k", "h").agg(F.collect_list("probe").alias("probes"))
    probes = stored(probes.coalesce(BENCHMARK_FILES), "probes")
    ids = F.aggregate("probes", F.lit(0), lambda n, p: n + F.size(p["items"]))
    n, found = probes.agg(F.sum(ids).alias("n")).first().n or 0, None
    for width in widths:
        mine = _small(probes.where(F.col("k") == width).select("h", "probes"), n)
        rows = _shingles(docs, width, window).join(mine, "h")
        rows = rows.select(*KEY, "n_words", "pos", "near", F.explode("probes").alias("p"))
        found = rows if found is None else found.unionByName(rows)
    size, start = F.col("p.size"), F.col("pos") - F.col("p.offset")
    # Bounds of place and length: the window must fit into the document.
    fits = (start >= 0) & (start + size <= F.col("n_words"))
    begin = F.greatest(start - _near(F.col("pos"), window), F.lit(0))
    same = F.slice("near", begin + 1, size) == F.col("p.window")
    found = found.where(fits & same)
    # Copies of a text have the same windows.
    return found.select(*KEY, start.alias("start"), size.alias("size"), "p.items").distinct()


def _per_text(hits: DataFrame) -> DataFrame:
    """(key, n_hit, items): words inside windows, and the items, of each text with any."""
    ends = Window.partitionBy(*KEY).orderBy("start", "size").rowsBetween(
        Window.unboundedPreceding, -1
    )
    end = F.col("start") + F.col("size")
    before = F.coalesce(F.max(end).over(ends), F.lit(0))
    covered = hits.withColumn("new", F.greatest(end - F.greatest("start", before), F.lit(0)))
    return covered.groupBy(*KEY).agg(
        F.sum("new").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def judge(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items of every row."""
    cut = _keyed(docs.select("doc_id", "text"))
    cut = cut.select("doc_id", *KEY, F.size(words("text")).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    hits = _hits(docs, items, window, shingle)
    if hits is None:
        rows = cut.withColumns({"n_hit": F.lit(0), "items": none})
    else:
        # Written, so that the join reads plain shuffles and a text with many copies is split.
        rows = cut.join(stored(_per_text(hits), "hits"), KEY, "left")
    found = F.coalesce("items", none)
    return rows.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(found).cast("long").alias("n_items"),
        F.sha2(F.array_join(found, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE
) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no window."""
    hits = _hits(docs, items, window, shingle)
    if hits is None:
        return docs
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("_hash"), F.hash("text").alias("_check"))
    texts = stored(hits.select(*KEY).distinct(), "contaminated")
    return rows.join(texts, KEY, "left_anti").select("row.*")

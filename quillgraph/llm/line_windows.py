"""Line dedup by overlapping windows of three lines.

Every run of three consecutive lines is a window. Windows are grouped by a 128-bit hash over the whole
corpus; each occurrence after the first (by doc_id, then position) marks its three lines, and marked lines
are removed, overlapping marks merging.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import others, renamed, restored, saved

LINES = 3


def _split(text: str = "text") -> F.Column:
    return F.split(F.col(text), "\n", -1)


def repeated_lines(docs: DataFrame) -> DataFrame:
    """d, h, starts, ends (of the merged stretches of lines to remove, ends exclusive) of the documents that have
    any; d and h are doc_id and the hash of the text."""
    lines = F.transform(_split(), lambda x: F.unhex(F.md5(x.cast("binary"))))
    # documents of fewer lines have no window; the array index runs from 1
    keys = F.expr(f"transform(sequence(1, size(l) - {LINES - 1}), i -> unhex(md5(concat(l[i - 1], l[i], l[i + 1]))))")
    rows = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"), lines.alias("l")).filter(F.size("l") >= LINES)
    windows = saved(rows.select("d", "h", F.posexplode(keys).alias("pos", "key")))
    first = windows.groupBy("key").agg(F.min(F.struct("d", "pos")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = windows.join(first.select("key", "first"), "key").filter(~F.struct("d", "pos").eqNullSafe(F.col("first")))
    at = later.groupBy("d", "h").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    # windows that overlap or meet are one stretch, which begins and ends where the next one is farther away
    starts = F.filter("at", lambda p, i: (i == 0) | (p - F.get("at", i - 1) > LINES))
    ends = F.filter("at", lambda p, i: (i == F.size("at") - 1) | (F.get("at", i + 1) - p > LINES))
    return at.select("d", "h", starts.alias("starts"), F.transform(ends, lambda p: p + LINES).alias("ends"))


def _decided(docs: DataFrame, names: list[str]) -> DataFrame:
    """The columns in names, renamed, with kept (the text that stays), n_lines and n_removed of each row of docs."""
    marks = repeated_lines(docs).withColumnsRenamed({"d": "e", "h": "g"})
    x = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"), F.col("text").alias("t"), *renamed(names))
    x = x.join(marks, F.col("d").eqNullSafe(F.col("e")) & (F.col("h") == F.col("g")), "left").withColumn("lines", _split("t"))
    # what stays is between the stretches: from the end of one to the start of the next
    end = F.concat("starts", F.array(F.size("lines")))
    gaps = F.transform(end, lambda s, i: F.struct(F.when(i == 0, 0).otherwise(F.get("ends", i - 1)).alias("a"), s.alias("b")))
    kept = F.transform(F.filter(gaps, lambda g: g["a"] < g["b"]), lambda g: F.array_join(F.slice("lines", g["a"] + 1, g["b"] - g["a"]), "\n"))
    removed = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0), lambda a, n: a + n)
    return x.select(
        *[f"own_{i}" for i in range(len(names))],
        F.when(F.col("starts").isNull(), F.col("t")).otherwise(F.array_join(kept, "\n")).alias("kept"),
        F.coalesce(F.when(F.col("t").isNotNull(), F.size("lines")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with the text that stays, and n_lines and n_removed (columns of docs with these two names, in whatever case, are
    replaced; other names of docs can be anything).

    Lines are what '\\n' separates, so an empty text has one line; a null text stays null and has none. A
    text of fewer than three lines stays as it is. If every line goes, the text is empty. Rows that share
    doc_id and text are one document: the first occurrence of each of their windows stays in all of them.
    A null doc_id comes before all others.
    """
    rest = others(docs, "n_lines", "n_removed", "text")
    return _decided(docs, rest).select(*restored(rest), F.col("kept").alias("text"), "n_lines", "n_removed")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated passages removed, n_chars set anew, and without documents that lost every line."""
    rest = others(docs, "text", "n_chars")
    x = _decided(docs, rest).filter("n_removed = 0 or n_removed < n_lines")
    made = dict(zip(rest, restored(rest), strict=True))
    for f in docs.schema.fields:
        if f.name.lower() == "text":
            made[f.name] = F.col("kept").alias(f.name)
        elif f.name.lower() == "n_chars":
            made[f.name] = F.length("kept").cast(f.dataType).alias(f.name)
    return x.select(*[made[c] for c in docs.columns])

"""Line dedup by winnowing over line hashes.

A window is the shortest run of consecutive non-blank lines, from a given
line on or up to a given line, that holds `min_words` (50) words: a long line
is a window by itself. The minimum line hash inside a window is its
fingerprint, so any repeated run of whole lines with that many words shares a
fingerprint with its earlier occurrence (the winnowing guarantee). Positions
of repeated fingerprints are joined, hits are extended to the windows around
them, and overlapping windows join to runs. A line of a repeated run lies in
the window that ends at it or, near the start, in the one that begins with
the run, so runs are deleted to their last line, whichever earlier occurrence
they repeat. Every occurrence of a window but its first (by doc_id, then
text hash, then line) is deleted; lines that belong to the first occurrence
itself stay when an occurrence overlaps it in the same document.

Lines are split at \\n and compared exactly. Null text has no lines and stays
null; blank lines count no words and go with a run that encloses them. Rows
with the same doc_id and text count as one document and share one result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, materialize


def repeated_runs(docs: DataFrame, *, text_col: str = "text", min_words: int = 50) -> DataFrame:
    """doc_id, __th (hash of the text), __runs: sorted disjoint (start, end) line numbers to delete, ends included."""
    lines = docs.select("doc_id", F.xxhash64(text_col).alias("__th"), F.posexplode(F.split(text_col, "\n")).alias("__pos", "__line"))
    lines = lines.select("doc_id", "__th", "__pos", count_words(F.col("__line")).alias("__wc"), F.xxhash64("__line").alias("__h"), F.xxhash64(F.lit(1), "__line").alias("__g")).where("__wc > 0")
    lines = lines.repartition("doc_id", "__th").dropDuplicates(["doc_id", "__th", "__pos"])
    doc = Window.partitionBy("doc_id", "__th")
    before = F.coalesce(F.sum("__wc").over(doc.orderBy("__pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = lines.withColumn("__s", before).withColumn("__e", F.col("__s") + F.col("__wc"))
    # __s and __e grow with each line, so the frames are the windows from a line on and up to a line
    frames = (doc.orderBy("__s").rangeBetween(0, min_words - 1), doc.orderBy("__e").rangeBetween(1 - min_words, 0))
    window = lambda w: F.struct(
        F.min("__pos").over(w).alias("__start"), F.max("__pos").over(w).alias("__end"), F.sum("__wc").over(w).alias("__words"),
        F.min(F.struct("__h", "__pos")).over(w).alias("__fp"), F.collect_list(F.struct("__h", "__g")).over(w).alias("__lines"),
    )
    windows = lines.select("doc_id", "__th", "__wc", *[window(w).alias(n) for n, w in zip(("__on", "__upto"), frames, strict=True)])
    # up to a line that its first line's own window ends with, the window is that one
    other = F.when(F.col("__upto.__words") - F.col("__wc") >= min_words, F.array("__on", "__upto")).otherwise(F.array("__on"))
    windows = windows.select("doc_id", "__th", F.inline(other)).where(F.col("__words") >= min_words)
    windows = windows.select("doc_id", "__th", "__start", "__end", F.col("__fp.__h").alias("__f"), F.col("__fp.__pos").alias("__fpos"), F.xxhash64("__lines").alias("__w1"), F.xxhash64(F.lit(1), "__lines").alias("__w2"))
    windows = materialize(windows, "line-windows")
    spot = F.struct("doc_id", "__th", "__fpos")
    twice = windows.groupBy("__f").agg(F.min(spot).alias("__a"), F.max(spot).alias("__b")).where(~F.col("__a").eqNullSafe(F.col("__b"))).select("__f")
    near = windows.join(twice, "__f", "left_semi")
    at = F.struct("doc_id", "__th", "__start", "__end")
    first = near.groupBy("__f", "__w1", "__w2").agg(F.min(at).alias("__first"), F.max(at).alias("__last")).where(~F.col("__first").eqNullSafe(F.col("__last"))).drop("__last")
    later = near.join(first, ["__f", "__w1", "__w2"]).where(~F.col("__first").eqNullSafe(at))
    same = F.col("doc_id").eqNullSafe(F.col("__first.doc_id")) & (F.col("__th") == F.col("__first.__th"))
    runs = later.select("doc_id", "__th", F.when(same, F.greatest("__start", F.col("__first.__end") + 1)).otherwise(F.col("__start")).alias("__start"), "__end").where("__start <= __end").distinct()
    reach = F.max("__end").over(doc.orderBy("__start", "__end").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("__new", (F.coalesce(reach, F.lit(-2)) + 1 < F.col("__start")).cast("int"))
    runs = runs.withColumn("__run", F.sum("__new").over(doc.orderBy("__start", "__end")))
    runs = runs.groupBy("doc_id", "__th", "__run").agg(F.min("__start").alias("s"), F.max("__end").alias("e"))
    return runs.groupBy("doc_id", "__th").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("__runs"))


def dedup_lines(docs: DataFrame, *, text_col: str = "text", min_words: int = 50) -> DataFrame:
    """docs with the repeated runs cut out of the text, and n_lines, n_deleted (before any column of those names)."""
    runs = repeated_runs(docs, text_col=text_col, min_words=min_words).withColumnsRenamed({"doc_id": "__id", "__th": "__rth"})
    keyed = docs.drop("n_lines", "n_deleted").withColumn("__th", F.xxhash64(text_col))
    out = keyed.join(runs, keyed["doc_id"].eqNullSafe(runs["__id"]) & (keyed["__th"] == runs["__rth"]), "left")
    lines = F.split(text_col, "\n")
    kept = F.filter(lines, lambda x, i: ~F.exists("__runs", lambda r: (r["s"] <= i) & (i <= r["e"])))
    gone = F.aggregate("__runs", F.lit(0), lambda a, r: a + r["e"] - r["s"] + 1)
    n = F.coalesce(F.size(lines), F.lit(0))
    out = out.withColumn("n_lines", F.when(F.col(text_col).isNull(), 0).otherwise(n).cast("long")).withColumn("n_deleted", F.coalesce(gone, F.lit(0)).cast("long"))
    out = out.withColumn(text_col, F.when(F.col("__runs").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")))
    return out.select(*[c for c in docs.columns if c not in ("n_lines", "n_deleted")], "n_lines", "n_deleted")

"""Benchmark decontamination by winnowing.

Words are runs of digits, lower-cased ASCII letters and non-ASCII characters.
A window is `length` (10) words; the minimum hash among its `gram`-word
(5-word) runs is its fingerprint: a shared window has the same fingerprint on
both sides, so joining fingerprints misses no shared span of `length` words.
Items of fewer words are windows of their own length, by the same path (below
`gram` words the whole window is the one run). Two passes:

1. Each document gives its number of words and its distinct fingerprints,
   which are joined with those of the benchmark.
2. Documents with a common fingerprint are read again; at the places where
   one lies, hits are extended to windows and confirmed on the words.

Rows of the joins are fingerprints and windows and carry no text. The
benchmark's fingerprints and windows, and the keys of documents with a common
fingerprint, are broadcast only up to `broadcast_rows` rows; beyond that the
joins shuffle. A window that many items share is joined with the set of its
items, not with each of them.

Null and empty texts have no words and are clean; null item texts give no
window. A null item_id counts for n_hit and contaminated, not for n_items.
Rows with one doc_id and different texts are documents of their own; rows
equal in both share one result; null ids are kept. Columns of the same names
as the result's, and other columns, are ignored here and kept as they are by
`drop_contaminated`. An empty benchmark contaminates nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import UPPER, let, materialize

#: What lies between words; capitals are letters still to be lower-cased.
SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Words of a text that are worked on at once.
PIECE = 1 << 13


def _lower(c: Column) -> Column:
    """A-Z lower-cased; `lower` does so for ASCII strings, faster than translate."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def bench_words(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPLIT), ""), _lower)


def _run_from(have: Column, more: Column, words: int, skip: int) -> Column:
    """Hashes of runs: have[i], shifted by `words` bits, xor more[i + skip]; null where there is none."""
    return F.zip_with(have, F.slice(more, skip + 1, F.greatest(F.size(more) - skip, F.lit(0))), lambda a, b: F.shiftleft(a, words).bitwiseXOR(b))


def _least_from(have: Column, skip: int) -> Column:
    return F.zip_with(have, F.slice(have, skip + 1, F.greatest(F.size(have) - skip, F.lit(0))), lambda a, b: F.least(a, b))


def fingerprints(hashes: Column, length: int, gram: int, then) -> Column:
    """then(x), x[i] being the fingerprint of the window of `length` words that starts at word i: the least hash of its runs.

    Hashes of runs and their minima are built from those of half the length. Places near the end, where no window fits, are cut off at last.
    """
    k = min(gram, length)
    width = length - k + 1

    def chain(have: Column, n: int) -> Column:
        if n == k:
            return least(have, 1)
        if 2 * n <= k:
            return let(_run_from(have, have, n, n), lambda x: chain(x, 2 * n))
        return let(_run_from(have, hashes, 1, n), lambda x: chain(x, n + 1))

    def least(have: Column, n: int) -> Column:
        if n == width:
            return then(F.slice(have, 1, F.greatest(F.size(hashes) - length + 1, F.lit(0))))
        step = min(n, width - n)
        return let(_least_from(have, step), lambda x: least(x, n + step))

    return chain(hashes, 1)


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def prints_of(words: Column, length: int, gram: int, then) -> Column:
    return let(word_hashes(words), lambda h: fingerprints(h, length, gram, then))


def pieces(array: Column, overlap: int) -> Column:
    """Array of (base, part): runs of PIECE elements and the `overlap` after them, so that long texts are worked on in bounded rows."""
    last = F.greatest(F.ceil((F.size(array) - overlap) / PIECE), F.lit(1)).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), lambda c: F.struct((c * PIECE).alias("base"), F.slice(array, c * PIECE + 1, F.lit(PIECE + overlap)).alias("part")))


def item_windows(items: DataFrame, length: int, text_col: str = "text") -> DataFrame:
    """item_id and its windows' words; an item of fewer words, but not none, is one window."""
    words = items.select(F.col("item_id").cast("string").alias("item_id"), bench_words(F.col(text_col)).alias("__w")).where(F.size("__w") > 0)
    n = F.size("__w")
    return words.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(n - length + 1, F.lit(1))), lambda i: F.slice("__w", i, F.lit(length)))).alias("__window")).distinct()


class Benchmark:
    """Tables of the benchmark's windows: windows (__key, __len, __fp, __set), sets (__set, __items), lengths; small ones are broadcast."""

    def __init__(self, items: DataFrame, length: int, gram: int, broadcast_rows: int):
        # by key: how many windows, not how many items share one
        own = item_windows(items, length).select("item_id", F.concat_ws(" ", "__window").alias("__key"), F.size("__window").alias("__len"))
        own = own.groupBy("__key", "__len").agg(F.array_sort(F.collect_set("item_id")).alias("__items"))
        own = materialize(own.withColumn("__set", F.xxhash64(F.concat_ws(",", "__items"))), "windows")
        self.lengths = sorted(r[0] for r in own.select("__len").distinct().collect())  # at most `length` values
        self.sets = own.select("__set", "__items").dropDuplicates(["__set"])
        fp = F.lit(None).cast("long")
        for n in self.lengths:
            fp = F.when(F.col("__len") == n, prints_of(F.split("__key", " "), n, gram, lambda x: F.element_at(x, 1))).otherwise(fp)
        self.windows = materialize(own.select("__key", "__len", fp.alias("__fp"), "__set"), "fingerprints") if self.lengths else own
        self.small = self.windows.count() <= broadcast_rows
        self.gram = gram

    def hint(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.small else df


def common_prints(docs: DataFrame, bench: Benchmark, text_col: str) -> DataFrame:
    """doc_id, __th, n_words, __copies (rows that are equal in both) and __fps: the distinct fingerprints that the document shares with the benchmark."""
    own = docs.select("doc_id", F.xxhash64(text_col).alias("__th"), word_hashes(bench_words(F.col(text_col))).alias("__h"))
    if not bench.lengths:
        return own.select("doc_id", "__th", F.size("__h").cast("long").alias("n_words"), F.lit(1).cast("long").alias("__copies"), F.array().cast("array<bigint>").alias("__fps"))
    own = own.select("doc_id", "__th", F.size("__h").cast("long").alias("n_words"), F.inline(pieces(F.col("__h"), max(bench.lengths) - 1)))
    itself = F.when(F.col("base") == 0, F.array(F.lit(None).cast("long"))).otherwise(F.array().cast("array<bigint>"))  # a null for the document
    some = F.concat(itself, *[fingerprints(F.col("part"), n, bench.gram, lambda x: F.array_distinct(x)) for n in bench.lengths])
    each = own.select("doc_id", "__th", "n_words", F.explode(some).alias("__f"))
    asked = bench.windows.select("__fp").distinct()
    met = each.join(bench.hint(asked), F.col("__f") == F.col("__fp"), "left").where("__f is null or __fp is not null")
    return materialize(met.groupBy("doc_id", "__th").agg(F.max("n_words").alias("n_words"), F.sum(F.col("__f").isNull().cast("long")).alias("__copies"), F.collect_set("__fp").alias("__fps")), "doc-prints")


def find_hits(docs: DataFrame, shared: DataFrame, bench: Benchmark, text_col: str, broadcast_rows: int) -> DataFrame:
    """Occurrences of the benchmark's windows: doc_id, __th, start, length, __set."""
    shared = shared.where(F.size("__fps") > 0).select("doc_id", "__th", "__fps")
    few = shared.select("__th").distinct()
    keyed = docs.select("doc_id", F.xxhash64(text_col).alias("__th"), F.col(text_col).alias("__t"))
    keyed = keyed.join(F.broadcast(few) if few.count() <= broadcast_rows else few, "__th", "left_semi")
    keyed = keyed.alias("d").join(shared.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.__th") == F.col("s.__th"))).select("d.doc_id", "d.__th", bench_words(F.col("__t")).alias("__w"), "__fps")
    keyed = keyed.select("doc_id", "__th", "__fps", F.inline(pieces(F.col("__w"), max(bench.lengths) - 1)))

    def places(n: int) -> Column:
        """Windows of n words whose fingerprint is shared: (length, start, key)."""
        among = lambda x: let(F.array_intersect(F.col("__fps"), x), lambda own: F.filter(F.transform(x, lambda f, i: F.when(F.array_contains(own, f), i)), lambda i: i.isNotNull()))
        at = prints_of(F.col("part"), n, bench.gram, lambda x: let(x, among))
        return F.transform(at, lambda i: F.struct(F.lit(n).alias("length"), (F.col("base") + i).alias("start"), F.concat_ws(" ", F.slice("part", i + 1, F.lit(n))).alias("__key")))

    hits = keyed.select("doc_id", "__th", F.inline(F.concat(*[places(n) for n in bench.lengths])))
    known = bench.windows.select("__key", F.col("__len").alias("length"), "__set")
    return hits.join(bench.hint(known), ["__key", "length"]).select("doc_id", "__th", "start", "length", "__set").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, *, text_col: str = "text", length: int = 10, gram: int = 5, broadcast_rows: int = 200_000) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and __th for joining back."""
    bench = Benchmark(items, length, gram, broadcast_rows)
    base = common_prints(docs, bench, text_col)
    none = F.array().cast("array<string>")
    one_each = lambda df: df.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    report = lambda df, ids, hit: one_each(df).select(
        "doc_id", "n_words", F.coalesce(hit, F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids).cast("binary"), 256).alias("items_sha256"), hit.isNotNull().alias("contaminated"), "__th",
    )
    if not bench.lengths:
        return report(base, none, F.lit(None).cast("long"))
    hits = materialize(find_hits(docs, base, bench, text_col, broadcast_rows), "hits")
    by_doc = Window.partitionBy("doc_id", "__th").orderBy("start", "length")
    end = F.col("start") + F.col("length")
    seen = F.coalesce(F.max(end).over(by_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = hits.withColumn("__new", F.greatest(end - F.greatest("start", seen), F.lit(0))).groupBy("doc_id", "__th").agg(F.sum("__new").alias("n_hit"), F.collect_set("__set").alias("__sets"))
    named = covered.select("doc_id", "__th", "n_hit", F.explode("__sets").alias("__set")).join(bench.hint(bench.sets), "__set")
    named = named.groupBy("doc_id", "__th").agg(F.first("n_hit").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("__items")))).alias("__ids"))
    found = named.withColumnsRenamed({"doc_id": "__id", "__th": "__fth"})
    out = base.join(found, base["doc_id"].eqNullSafe(found["__id"]) & (base["__th"] == found["__fth"]), "left")
    return report(out, F.coalesce(F.col("__ids"), none), F.col("n_hit"))


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without the documents that hold a benchmark window; columns as they are."""
    bad = decontaminate(docs, items, **options).where("contaminated").select(F.col("doc_id").alias("__id"), "__th").distinct()
    keyed = docs.withColumn("__dh", F.xxhash64(options.get("text_col", "text")))
    return keyed.join(bad, keyed["doc_id"].eqNullSafe(bad["__id"]) & (keyed["__dh"] == bad["__th"]), "left_anti").select(*docs.columns)

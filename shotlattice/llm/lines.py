"""Line dedup: every line that other documents hold stays in the first document only; the answer is a bitmap per document, not text.

1. Each line long enough gives a row (document, position, 128 bits of the SHA-256 of its key), written as a narrow table; texts go no further.
2. The few keys that may hold a large share of the rows are named by a sketch (``approx_top_k``, merged in two levels). The sketch only says how a key is treated, never what is dropped:
   the first document of a named key is a minimum that tasks take before anything is sent, and the table of them, ``named`` rows at most, is broadcast to their lines.
3. All other rows are range-partitioned by hash and sorted by (hash, document, position) inside their partition. A window over that order streams the first occurrence down to the
   later ones; it neither moves nor sorts the rows again.
4. Positions that are dropped go back to their document and become its keep bitmap, run-length compressed: first line and length of each run of kept lines.

Everything is built-in functions; no Python runs where rows are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SPACE, let, parts_of, written

LEAST_CHARS = 10
#: Keys that the sketch may name. Any other key has about 1 / NAMED of the rows at most, so it fits into a partition.
NAMED = 1024
#: Keys that a task's sketch tracks, and tasks of its first merge.
TRACKED, MERGES = 8192, 128

_STRIPPED = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def key_of(line: Column) -> Column:
    """The line without the characters of ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased; other letters stay."""
    bare = F.btrim(line, F.lit(_STRIPPED))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def text_hash(text: Column) -> Column:
    """Tells rows with one id and different texts apart; null is as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def n_lines(text: Column) -> Column:
    """Lines of a text; null or empty text has one empty line."""
    text = F.coalesce(text, F.lit(""))
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


def _frequent(rows: DataFrame, named: int) -> DataFrame:
    """64-bit hashes (``f``) of the keys a sketch finds most often, ``named`` at most."""
    states = rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGES)).alias("merge")).agg(F.expr(f"approx_top_k_accumulate(xxhash64(h), {TRACKED})").alias("s"))
    # by a key that all share: without one, a task without states gives an empty state that can't be merged
    found = states.groupBy(F.pmod("merge", F.lit(1))).agg(F.expr(f"approx_top_k_combine(s, {TRACKED})").alias("s")).select(F.explode(F.expr(f"approx_top_k_estimate(s, {named})")).alias("t"))
    return found.where("t.count > 1").select(F.col("t.item").alias("f"))


def dropped_lines(lines: DataFrame, named: int = NAMED) -> DataFrame:
    """(id, row, pos) of the lines that an earlier document holds, from a table of (id, row, pos, h) that is written."""
    order = [F.col("id").isNull(), F.col("id")]
    hot = lines.join(F.broadcast(_frequent(lines, named)), F.xxhash64("h") == F.col("f"), "left_semi")  # ``named`` rows at most
    firsts = hot.groupBy("h").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("first"))
    firsts = written(firsts, "line-firsts")
    told = lines.join(F.broadcast(firsts.select("h", F.col("first.id").alias("first"), F.lit(True).alias("named"))), "h", "left")  # ``named`` rows at most
    rest = told.where("named is null").select("h", "id", "row", "pos").repartitionByRange(parts_of(lines), "h").sortWithinPartitions("h", *order, "row", "pos")
    streamed = Window.partitionBy("h").orderBy(*order, "row", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = rest.withColumn("first", F.first("id").over(streamed))
    later = ~F.col("id").eqNullSafe(F.col("first"))
    return told.where("named").where(later).select("id", "row", "pos").unionByName(rest.where(later).select("id", "row", "pos"))


def _runs(dropped: Column, n: Column) -> Column:
    """Runs (first, n) of kept lines, of ``n`` lines in all, from the ascending positions of those dropped."""
    starts = F.filter(dropped, lambda x, i: (i == 0) | (F.get(dropped, i - 1) != x - 1))
    ends = F.filter(dropped, lambda x, i: (i == F.size(dropped) - 1) | (F.get(dropped, i + 1) != x + 1))

    def between(starts: Column, ends: Column) -> Column:
        def run(i: Column) -> Column:
            first = F.coalesce(F.get(ends, i - 1) + 1, F.lit(0))
            return F.struct(first.alias("first"), (F.coalesce(F.get(starts, i), n.cast("int")) - first).alias("n"))

        return F.filter(F.transform(F.sequence(F.lit(0), F.size(starts)), run), lambda r: r["n"] > 0)

    return let(starts, lambda s: let(ends, lambda e: between(s, e)))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, named: int = NAMED) -> DataFrame:
    """One row per document that loses lines: id, row (hash of its text), n_dropped, dropped (ascending positions from 0).

    A document is what shares an id. Keys of ``least_chars`` code points or more that two documents hold lose all their lines but those of the smallest id; rows of one id are one document, so rows
    repeated with equal id and text have one bitmap, and lines that repeat inside the first document all stay. Null ids are one document, after all others. Null and empty texts have one empty line,
    which is too short to be dropped. Texts of any length are split whole. An empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("row"), F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"))
    rows = rows.select("id", "row", "pos", key_of(F.col("line")).alias("key")).where(F.char_length("key") >= least_chars)
    lines = written(rows.select("id", "row", "pos", F.unhex(F.substring(F.sha2("key", 256), 1, 32)).alias("h")), "lines")
    found = dropped_lines(lines, named).groupBy("id", "row").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))
    return found.select("id", "row", F.size("dropped").cast("long").alias("n_dropped"), "dropped")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, named: int = NAMED) -> DataFrame:
    """The rows of ``docs`` with n_lines, n_dropped and keep: the keep bitmap as runs (first, n) of kept lines. Nulls, ties, repeats and empty tables as in ``keep_bitmaps``.

    The three names replace columns of ``docs`` that have them.
    """
    docs = docs.withColumn("n_lines", n_lines(F.col(text_col)))
    kept = keep_bitmaps(docs, id_col, text_col, least_chars, named).select(F.col("id").alias("id_of"), F.col("row").alias("row_of"), F.col("n_dropped").alias("dropped_of"), F.col("dropped").alias("places_of"))
    both = docs.join(kept, docs[id_col].eqNullSafe(kept.id_of) & (text_hash(docs[text_col]) == kept.row_of), "left")
    whole = F.array(F.struct(F.lit(0).alias("first"), docs.n_lines.cast("int").alias("n")))
    runs = F.when(kept.places_of.isNull(), whole).otherwise(_runs(kept.places_of, docs.n_lines))
    return both.select(*[docs[c] for c in docs.columns if c not in ("n_dropped", "keep")], F.coalesce(kept.dropped_of, F.lit(0).cast("long")).alias("n_dropped"), runs.alias("keep"))


def kept_text(text: Column, keep: Column) -> Column:
    """The lines that ``keep`` holds, joined by newlines: slices of whole runs of lines that are split once, so a long text costs its length once."""
    return let(F.split(F.coalesce(text, F.lit("")), "\n"), lambda lines: F.array_join(F.flatten(F.transform(keep, lambda r: F.slice(lines, r["first"] + 1, r["n"]))), "\n"))


def digest(done: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of what ``deduplicated`` gives."""
    kept = F.when(F.col("n_dropped") == 0, F.coalesce(F.col(text_col), F.lit(""))).otherwise(kept_text(F.col(text_col), F.col("keep")))
    return done.select(F.col(id_col).alias("doc_id"), "n_lines", "n_dropped", F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


#: The same dedup in DuckDB's SQL.
SQL = rf"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, translate(regexp_replace(line, '^[{SPACE}]+|[{SPACE}]+$', '', 'g'), '{_UPPER}', '{_LOWER}') AS k FROM lines),
firsts AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= {LEAST_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT d.*, coalesce(f.first <> d.doc_id, false) AS gone FROM keyed d LEFT JOIN firsts f ON f.k = d.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

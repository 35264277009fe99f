"""Mixing sources to target weights by systematic sampling.

Each document of a source is expected ``target / source size`` times. Those expected copies are summed along the source, one random
offset is added, and a document is emitted once for each integer boundary its interval crosses. The order along a source is by size,
so that a sample holds small and large documents in their shares and its words come near the target.

The prefix sums never gather a source in one task: counts are kept by (source, size), then by (source, size, lot) with ``lots`` lots by the hash of the id,
and rows are ranked only inside a lot. Words are counted once: ids, sources and sizes are written as a table that the later steps read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SPACE, written

LIMIT = 3


def n_words(text: Column) -> Column:
    """Words of a text without building them: word starts. Null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def offset_of(source: Column, seed: int) -> Column:
    """A number in [0, 1) with 32 bits, the same for a source and seed on every run."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), source), F.lit("")))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def targets(sizes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(source, n, source_size) with weight and target added, one row per source.

    Sources by code point, null last, weigh 1, 2, 3, repeating. Shares are of all sizes; a target stops at ``limit`` times its source's size and the
    excess goes to the others by weight until none is above: in ascending order of limit per weight, a source stops if the rate of those from it on
    reaches its limit.
    """
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sizes.withColumn("weight", ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).cast("long"))
    at = Window.orderBy((limit * F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = at.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(whole)
    rate = (total - limit * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    stopped = limit * F.col("source_size") / F.col("weight") <= F.col("rate")
    return (
        ranked.withColumn("rate", rate)
        .withColumn("final", F.min(F.when(~stopped, F.struct((limit * F.col("source_size") / F.col("weight")).alias("r"), F.col("source").isNull().alias("z"), F.coalesce("source", F.lit("")).alias("s"), "rate"))).over(whole)["rate"])
        .withColumn("target", F.least((limit * F.col("source_size")).cast("double"), F.coalesce(F.col("weight") * F.col("final"), (limit * F.col("source_size")).cast("double"))))
        .drop("rate", "final")
    )


def _hashed(columns: list[str], df: DataFrame) -> Column:
    """A hash of the columns, those of a kind that has none left out."""
    return F.xxhash64(*[F.col(c) for c in columns if "map<" not in df.schema[c].dataType.simpleString() and "variant" not in df.schema[c].dataType.simpleString()] or [F.lit(0)])


def _ranked(rows: DataFrame, lots: int, limit: int, seed: int) -> DataFrame:
    """``rows`` (doc_id, source, size, tie and others) with source_size, target and copies added."""
    hashed = F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("lot", F.coalesce(F.pmod(hashed, F.lit(lots)), F.lit(lots)).cast("int"))
    cells = rows.groupBy("source", "size", "lot").agg(F.count(F.lit(1)).alias("n"))
    in_size = Window.partitionBy("source", "size").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("lots_before", F.coalesce(F.sum("n").over(in_size), F.lit(0)))
    by_size = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    in_source = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    sized = by_size.withColumn("sizes_before", F.coalesce(F.sum("n").over(in_source), F.lit(0)))
    sources = targets(by_size.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), limit)
    same = lambda a, b, *keys: [a[k].eqNullSafe(b[k]) for k in keys]
    sized = sized.join(sources, same(sized, sources, "source")).select(sized.source, "size", "sizes_before", "source_size", "target")
    cells = cells.join(sized, same(cells, sized, "source", "size")).select(cells.source, cells["size"], "lot", (F.col("lots_before") + F.col("sizes_before")).alias("before"), "source_size", "target")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "lot").orderBy(F.col("doc_id").asc_nulls_last(), "tie")) - 1)
    joined = ranked.join(cells, same(ranked, cells, "source", "size", "lot")).select(*[ranked[c] for c in rows.columns if c != "lot"], "source_size", "target", (F.col("before") + F.col("rank")).alias("at"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = offset_of(F.col("source"), seed)
    copies = (F.floor((F.col("at") + 1) * rate + start) - F.floor(F.col("at") * rate + start)).cast("long")
    return joined.withColumn("copies", copies).drop("at")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    return [F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size")]


def mix(docs: DataFrame, seed: int = 20, lots: int = 4096, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken (copies * size).

    Null text has size 0; texts of any length are counted whole; null sources are a source of their own, after all others; a source without words has target 0 and copies 0. Null ids come last
    among equals; rows with equal ids are ranked by the hash of their text, so reruns agree, and repeated rows each for itself, so every row has its own copies. An empty table gives an empty result. Other
    columns are not read.
    """
    rows = docs.select(*_sized(docs, id_col, text_col, source_col), _hashed([text_col], docs).alias("tie"))
    return _ranked(written(rows, "sizes"), lots, limit, seed).select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def drawn(docs: DataFrame, seed: int = 20, lots: int = 4096, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, with all their columns, each as often as the mix takes it; nulls, ties, repeats and empty tables as in ``mix``.

    Rows are written with numbers; only the numbers are ranked, and those taken meet their rows by an equi join.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("number"), *_sized(docs, id_col, text_col, source_col), _hashed(docs.columns, docs).alias("tie"), F.struct(*docs.columns).alias("row"))
    rows = written(rows, "sizes")
    taken = _ranked(rows.drop("row"), lots, limit, seed).where("copies > 0").select("number", "copies")
    return rows.select("number", "row").join(taken, "number").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


#: The same mix in DuckDB's SQL.
SQL = r"""
WITH rows AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM rows GROUP BY source),
rated AS (SELECT *, 3 * source_size / weight AS most, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
  coalesce(sum(source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sizes_before,
  coalesce(sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights_before FROM sources),
rates AS (SELECT *, (total - 3 * sizes_before)::DOUBLE / (weights - weights_before)::DOUBLE AS rate FROM rated),
final AS (SELECT rate AS final FROM rates WHERE most > rate ORDER BY most, source NULLS LAST LIMIT 1),
aimed AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, coalesce(weight * (SELECT final FROM final), (3 * source_size)::DOUBLE)) AS target FROM rates),
ranked AS (SELECT r.*, row_number() OVER (PARTITION BY r.source ORDER BY size, coalesce(('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 4096, 4096), doc_id NULLS LAST) - 1 AS place FROM rows r),
placed AS (SELECT k.*, a.source_size, a.target, CASE WHEN a.source_size > 0 THEN a.target / a.source_size::DOUBLE ELSE 0.0 END AS rate,
  ('0x' || substr(md5('20:' || coalesce('=' || k.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start FROM ranked k JOIN aimed a ON k.source IS NOT DISTINCT FROM a.source),
copied AS (SELECT *, (floor((place + 1) * rate + start) - floor(place * rate + start))::BIGINT AS copies FROM placed)
SELECT doc_id, size, source_size, target, copies * size AS taken FROM copied
"""

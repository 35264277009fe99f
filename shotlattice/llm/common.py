"""What the operators of this subpackage share: the cluster's shared folder, written tables, words."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The characters that separate words, as a regular expression class body.
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is absent a temporary folder stands in, in local mode only: on a cluster a
    machine-local folder would lose rows, so that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    at = getattr(spark, "_llm_shared_dir", None)
    if at is None:
        if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="llm-shared-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark._llm_shared_dir = at
    return at


#: Tables written and not dropped; results read them when they are evaluated, so they stay until the driver ends.
_LIVE: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _swept(spark: SparkSession) -> None:
    try:
        for path in sorted(_LIVE):
            _delete(spark, path)
    except Exception:  # the session has ended first; then whoever owns the shared folder empties it
        pass


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage is cut, a lost executor costs nothing already written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._llm_path = path
    if not _LIVE:
        atexit.register(_swept, spark)
    _LIVE.add(path)
    del df
    gc.collect()
    spark._jvm.System.gc()  # shuffle files go when the driver's garbage does: ask for it, as their rows are in the table now
    return out


def bucketed(df: DataFrame, what: str, key: str) -> DataFrame:
    """``df`` as a table in the shared folder whose files are dealt by ``key``: grouping and joining it by the key moves its rows no more."""
    spark = df.sparkSession
    name = f"llm_{what}_{uuid.uuid4().hex}".replace("-", "_")
    path = f"{shared_dir(spark)}/llm/{name}"
    n = parts_of(spark)
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).option("path", path).saveAsTable(name)
    if not _LIVE:
        atexit.register(_swept, spark)
    _LIVE.add(path)
    out = spark.table(name)
    out._llm_path = path
    gc.collect()
    spark._jvm.System.gc()
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._llm_path)
        _LIVE.discard(t._llm_path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Input bytes of a lot, at most, by what Spark knows of a table's size.
LOT_BYTES = 32 << 20


def parts_of(of: SparkSession | DataFrame) -> int:
    """Lots that rows are dealt into: the shuffle partitions, or more if a table is so large that a lot would hold more than ``LOT_BYTES`` of it."""
    spark = of if isinstance(of, SparkSession) else of.sparkSession
    least = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if of is spark:
        return least
    leaves = of._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    size = sum(x for x in sizes if x < 1 << 60)  # a leaf of unknown size claims more than any table has
    return max(least, min(-(-size // LOT_BYTES), 1 << 17))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row: Catalyst may otherwise copy it into every use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text as an array; none for null or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


# ---------------------------------------------------------------- vectorised words of Arrow text

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS = {}


def powers(n: int, base: np.uint64 = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) < n:
        size = 1 << max(21, int(n).bit_length())
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        up, down = np.ones(size, np.uint64), np.ones(size, np.uint64)
        up[1:], down[1:] = base, inverse
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        _POWERS[int(base)] = have = (up, down)
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every bit of the result depends on every bit of x."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64) and bytes of an Arrow string or binary array; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets, data


def slices(offsets: np.ndarray, limit: int):
    """Runs (first, past) of rows whose texts hold about ``limit`` bytes together; a longer text stands alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        past = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        past = min(n, max(at + 1, past))
        yield at, past
        at = past


def hashed_words(offsets: np.ndarray, data: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of consecutive texts, and the row of each word.

    A word's hash is XXH3 of its bytes. Sums of powers, which numpy would give for all words at once, are linear: words that differ by the coefficients of a product of factors that vanish for every odd base share them.
    """
    base = int(offsets[0])
    data = data[base : offsets[-1]]
    flat = (_LOWER[data] if lower else data).tobytes()
    cuts = (offsets - base).tolist()
    words: list[bytes] = []
    counts = np.zeros(len(cuts) - 1, np.int64)
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        found = flat[a:b].split()  # at the bytes of SPACE, and at no others
        counts[i] = len(found)
        words += found
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), np.repeat(np.arange(len(counts)), counts)


def shingle_hashes(words: np.ndarray, rows: np.ndarray, width: int, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of ``width`` words, and their rows; a row with fewer words has one window of all its words."""
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    step = np.uint64(0xD6E8FEB86659FD93)
    counts = np.bincount(rows, minlength=n_rows)
    n = len(words) - width + 1
    out, out_rows = [], []
    if n > 0:
        whole = rows[:n] == rows[width - 1 :]
        acc = np.zeros(n, np.uint64)
        for i in range(width):  # mixed after each word: a sum of multiples would let chosen words cancel each other
            acc = mixed(acc * step + words[i : i + n])
        out.append(acc[whole])
        out_rows.append(rows[:n][whole])
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        first = np.concatenate(([0], np.cumsum(counts)))[short]
        acc = np.zeros(len(short), np.uint64)
        for i in range(width - 1):
            has = counts[short] > i
            acc[has] = mixed(acc[has] * step + words[first[has] + i])
        out.append(mixed(acc + counts[short].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
        out_rows.append(short)
    return np.concatenate(out), np.concatenate(out_rows)

"""What the operators of this subpackage share: tables, cut lineage, bounded broadcasts, words, components."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

#: A word, as all contracts here define it: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A table with at most so many rows and bytes of keys may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 8 << 20
#: Bytes that a task writes, where the size of what is written is known.
TASK_BYTES = 4 << 20
#: Bits of the bitmap that screens the keys of a join.
BITS = 1 << 26

_own_dir: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, one of our own if all run on this machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own_dir[app]


def cut(df: DataFrame, size: int | None = None) -> DataFrame:
    """Writes a frame to the shared folder and reads it back, so that its lineage ends there and lost executors cost nothing before it.

    size: about its bytes, where they are known; it is then written by as many tasks as TASK_BYTES ask for, and not in tiny files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    if size is not None:
        df = df.coalesce(int(size) // TASK_BYTES + 8)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hash01(*cols: Column) -> Column:
    """A uniform number in (0, 1) that depends on the columns alone."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) / float(1 << 53)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def join_dim(df: DataFrame, dim: DataFrame, key: str, how: str = "inner", salts: int = 32) -> DataFrame:
    """Joins a dimension table on a null-safe key that may be hot in df.

    A dimension proven small (rows and key bytes are counted first) is broadcast; a larger one is
    copied to `salts` salted partitions, so that the rows of a hot key go to as many tasks.
    """
    size = dim.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.col(key).cast("string"))).alias("b")).first()
    right = dim.withColumnRenamed(key, "__key")
    if size["n"] <= BROADCAST_ROWS and (size["b"] or 0) <= BROADCAST_BYTES:
        return df.join(F.broadcast(right), df[key].eqNullSafe(F.col("__key")), how).drop("__key")
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*[c for c in df.columns if c != key]), F.lit(salts)))
    right = right.withColumn("__s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(right, salted[key].eqNullSafe(F.col("__key")) & (F.col("__salt") == F.col("__s")), how).drop("__key", "__s", "__salt")


def global_index(df: DataFrame, keys: list[str | Column], weight: str | None = None, name: str = "index") -> DataFrame:
    """Adds each row's place (from 0) in the order of keys, or the summed weight of the rows before it.

    Rows are range-partitioned and sorted; a partition's rows are numbered in place and only the
    partitions' totals (one row each) meet in one window. Rows should be distinct in keys.
    """
    laid = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    laid = cut(laid).withColumn("__part", F.shiftright("__at", 33))
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    if weight:
        w = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
        laid = laid.withColumn("__in", F.coalesce(F.sum(weight).over(w), F.lit(0)))
        total = F.sum(weight)
    else:
        laid, total = laid.withColumn("__in", inside), F.count("*")
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = laid.groupBy(F.col("__part").alias("__p")).agg(total.alias("__n")).select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    return laid.join(F.broadcast(offsets), F.col("__part") == F.col("__p")).withColumn(name, (F.col("__in") + F.col("__off")).cast("long")).drop("__at", "__part", "__in", "__p", "__off")


def numbered(docs: DataFrame, ident: str, nulls_first: bool = False) -> tuple[DataFrame, bool]:
    """((row, doc), plain): doc is the whole row as a struct; row tells rows apart and is in the order of ident.

    Where ident is a whole number that tells all rows apart, it is the row itself (plain); else the table is
    sorted and written once more, rows of equal ident in the order of their hashes.
    """
    packed = docs.select(F.col(ident).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    if isinstance(docs.schema[ident].dataType, IntegralType):
        if not docs.groupBy(ident).agg(F.count("*").alias("n")).where(F.col(ident).isNull() | (F.col("n") > 1)).head(1):
            return packed.select(F.col("key").cast("long").alias("row"), "doc"), True
    first = F.col("key").asc_nulls_first() if nulls_first else F.col("key").asc_nulls_last()
    return global_index(packed, [first, F.xxhash64("doc")], name="row").select("row", "doc"), False


def screened(df: DataFrame, key: str, ids: DataFrame, name: str = "may") -> DataFrame:
    """Adds whether ids (one long column) may hold a row's key: never false where it does. For joins that most rows don't pass.

    A bitmap of BITS hashed bits, 8 MB at most, is broadcast at every size; when ids are very many it only says yes more often.
    """

    def place(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(BITS))

    hashed = ids.select(place(F.col(ids.columns[0])).alias("__h"))
    maps = hashed.groupBy(F.expr("__h div 32768").alias("__bucket")).agg(F.bitmap_construct_agg(F.col("__h") % 32768).alias("__bits"))
    held = df.withColumn("__h", place(F.col(key))).join(F.broadcast(maps), F.expr("__h div 32768 = __bucket"), "left")
    bit = "shiftright(cast(conv(hex(substring(__bits, cast(__h % 32768 div 8 as int) + 1, 1)), 16, 10) as int), cast(__h % 8 as int)) & 1"
    return held.withColumn(name, F.coalesce(F.expr(bit) == 1, F.lit(False))).drop("__h", "__bucket", "__bits")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b): (id, component), component the smallest id reachable.

    Hash-to-min (Rastogi et al. 2013): in each round every node sends the smallest of itself and its neighbours to
    all of them; edges that no longer change are stars around the components' smallest ids. Each round is written to
    the shared folder. Minima are pre-aggregated map-side, and a hub's rows meet its minimum in an equi-join of two
    tables, which AQE can split. Raises if the rounds do not settle.
    """
    size = 16 * edges.count()
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), size)
    seen = None
    for _ in range(max_rounds):
        now = tuple(edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        seen, size = now, 16 * now[0]
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), size)
        sent = both.hint("merge").join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e")).select("e.a", F.col("e.m").alias("b"))
        edges = cut(sent.where("a <> b").distinct(), size)
    raise RuntimeError(f"components have not settled in {max_rounds} rounds")


# Inside tasks: Arrow batches and numpy.


def by_bytes(batches: Iterable[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the text column of each holds about `limit` bytes at most, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            whole = start == 0 and stop == batch.num_rows
            yield batch if whole else batch.take(pa.array(np.arange(start, stop)))  # a copy: some kernels of Arrow misread slices
            start = stop
    pa.default_memory_pool().release_unused()  # workers outlive their tasks


@contextlib.contextmanager
def reused_memory() -> Iterator[None]:
    """Within it, glibc keeps up to 64 MB of freed memory: else each array of a megabyte is mapped and faulted in anew, which costs more than its arithmetic."""
    libc = ctypes.CDLL(None)
    if not hasattr(libc, "mallopt"):
        yield
        return
    libc.mallopt(-3, 16 << 20)  # M_MMAP_THRESHOLD
    libc.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD
    try:
        yield
    finally:
        libc.mallopt(-3, 128 << 10)
        libc.mallopt(-1, 128 << 10)
        libc.malloc_trim(0)  # workers outlive their tasks


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
    """(offsets, words): words of text i are words[offsets[i]:offsets[i+1]]; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(full, min_count=0).as_py():
        mask = full.to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(mask)])[offsets]
        flat = flat.filter(full)
    return offsets, flat


def word_codes(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(code of each word, the distinct words)."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def owner(offsets: np.ndarray) -> np.ndarray:
    """Which text each element is of."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values within each text."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def windows(values: np.ndarray, offsets: np.ndarray, k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes): 64-bit hashes of all k consecutive uint64 values that lie inside one text."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.full(n, seed, np.uint64)
    for j in range(k):
        total = mix64(total * np.uint64(0x9E3779B97F4A7C15) + values[j : j + n])
    own = owner(offsets)
    inside = own[:n] == own[k - 1 :]
    starts = np.flatnonzero(inside)
    return starts, total[starts]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gather(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places starts[i], starts[i] + 1, ... (counts[i] of them), one run after another."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)

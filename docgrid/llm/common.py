"""What several operators share: the shared folder, tables written there, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another system
    _libc = None

#: Rows of one Arrow batch: texts may be very long, and a batch is held whole by a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Rows that the Parquet reader decodes at once.
READ_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``, or (as in tests, on one machine) a new temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not found:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="docgrid-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Keeps batches of the Parquet reader and of Arrow small enough for long texts; only ever lowers the session's settings."""
    wanted = (
        ("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS, "4096"),  # the reader holds a batch's texts in one array, which it doubles as it grows
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS, "10000"),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES, "67108864"),
    )
    for key, most, default in wanted:
        if not 0 < int(str(spark.conf.get(key, default)).rstrip("b")) <= most:
            spark.conf.set(key, str(most))


def freed() -> None:
    """Gives memory that this Python worker no longer uses back to the system, which allocators otherwise keep for later; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches that calls :func:`freed` at its end."""

    def all_of(batches: Iterator) -> Iterator:
        yield from run(batches)
        freed()

    return all_of


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, no_id, text``: ids and texts as Python takes them; a null id is 0 with no_id beside it, since pandas would round a batch's ids to floats for its sake, and a null text is empty."""
    own = F.col(id_col).cast("long")
    return docs.select(F.coalesce(own, F.lit(0)).alias("doc_id"), own.isNull().alias("no_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def ids_of(b: pd.DataFrame) -> pd.api.extensions.ExtensionArray:
    """The ids of a batch of :func:`keyed` rows as whole numbers and nulls."""
    return pd.arrays.IntegerArray(b["doc_id"].to_numpy(dtype=np.int64, copy=True), b["no_id"].to_numpy(dtype=bool, copy=True))


def private(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in letters of any case."""
    taken, name = {c.lower() for c in df.columns}, f"_docgrid_{name}"
    while name in taken:
        name += "_"
    return name


#: Tables that this process has written to the shared folder.
_written: list[str] = []


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: the rows, written as Parquet to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docgrid/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._docgrid_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of :func:`saved` that nothing will read again."""
    for t in tables:
        if path := getattr(t, "_docgrid_path", None):
            _delete(t.sparkSession, [path])


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    _written[:] = [p for p in _written if p not in paths]


def saved_alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The rows that `make` gives, saved; the tables that were saved in making them are deleted."""
    before = len(_written)
    out = saved(make(), name)
    _delete(out.sparkSession, _written[before:-1])
    return out


def clear(spark: SparkSession) -> None:
    """Deletes the tables that :func:`saved` has written so far; results not read yet may still need them."""
    _delete(spark, list(_written))


#: Bits of a Bloom filter: 16 for each id, within these bounds; what is broadcast is 16 MB at most.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27


def among(df: DataFrame, columns: str | list[str], ids: DataFrame, n: int | None = None) -> DataFrame:
    """Rows of df of which a long column may be one of ids (its one column): all that are, and about one in seventy of the others for each column.

    n: about how many ids there are, if known; ids may repeat.
    """
    columns = [columns] if isinstance(columns, str) else columns
    some = F.coalesce(*(F.col(c) for c in columns)).isNotNull()
    return df.where(some).where(_held(columns, ids, n))


def parted(df: DataFrame, mark: Column, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of df whose mark, a long hash that is never null, may be one of ids, and rows whose mark isn't: few go through a join that only concerns ids."""
    name = private(df, "mark")
    marked, held = df.withColumn(name, mark), _held([name], ids, None)
    return marked.where(held).drop(name), marked.where(~held).drop(name)


def _held(columns: list[str], ids: DataFrame, n: int | None) -> Column:
    """Whether a value of these columns may be one of ids.

    A Bloom filter, put together by the executors and sent as a bitmap of
    bounded size, so that a semi join of a few ids with a large table needn't
    shuffle the table.  Values are hashes already, whose bits serve as they are.
    With more ids than the bitmap is made for it lets more rows through, and
    stays right.
    """
    spark = ids.sparkSession
    (name,) = ids.columns
    n = ids.count() if n is None else n
    bits = LEAST_BITS
    while bits < min(16 * n, MOST_BITS):
        bits *= 2
    places = F.array(F.col(name).bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(name, 36).bitwiseAND(F.lit(bits - 1)))
    words = ids.select(F.explode(places).alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("m"))
    bitmap = np.zeros(bits // 64, dtype=np.uint64)
    found = words.toArrow()
    bitmap[found["w"].to_numpy()] = found["m"].to_numpy().view(np.uint64)
    sent = spark.sparkContext.broadcast(bitmap)

    def held(x: np.ndarray) -> np.ndarray:
        x = x & np.uint64(bits - 1)
        return (sent.value[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63))) & np.uint64(1)

    def test(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for series in batches:
            series = series if isinstance(series, tuple) else (series,)  # a single column comes bare
            hit = np.zeros(len(series[0]), dtype=bool)
            for s in series:
                x = s.to_numpy().view(np.uint64)
                hit |= (held(x) & held(x >> np.uint64(36))).astype(bool)
            yield pd.Series(hit)

    return F.pandas_udf(test, "boolean")(*(F.coalesce(F.col(c), F.lit(0)) for c in columns))


#: Rows of one key from which on they are dealt to SALTS tasks, if they are more than a thousandth of all rows too.
HOT_ROWS, SALTS = 256, 32


def spread_join(many: DataFrame, one: DataFrame, key: str, counts: DataFrame, total: int, how: str = "inner", by: list[str] | None = None) -> DataFrame:
    """many joined with one on a key that one holds once at most, hot keys being dealt to several tasks.

    counts: the key and ``n``, how many rows of many have it (others may be left
    out); total: rows of many.  Keys with more than a thousandth of all rows are
    hot: there can't be more than a thousand, so they are sent to all tasks.
    Their rows in many get a salt by a hash of the columns `by` (all, if None),
    their row in one is repeated for each salt.  how: inner or left.
    """
    hot = F.broadcast(counts.where(F.col("n") > max(total // 1000, HOT_ROWS)).select(key, F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*(by or many.columns)), F.lit(SALTS)).cast("int")).otherwise(0)
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = many.join(hot, key, "left").withColumn("_salt", salt).drop("_hot")
    right = one.join(hot, key, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Connected components of an undirected graph of long nodes, by alternating large-star and small-star rounds.

    A distributed union-find: tasks first unite what they hold, EDGES edges at a
    time.  While more edges than that are left, each round hooks neighbours to
    the smallest neighbour, first among the larger ones and then among the
    smaller ones, until every node points at the smallest node of its component;
    no more than EDGES edges are united by one task.  Returns
    ``node, component`` for each node of an edge between two different nodes;
    loops, null ends and repeated edges have no effect; no edges give no rows.
    Per-node minima are combined before the shuffle, and hubs are only ever
    joined with one row, so a hub's edges are dealt to several tasks.
    """
    a, b = F.col(left), F.col(right)
    some = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(a.alias("u"), b.alias("v"))
    now = saved(some.mapInPandas(_joined, "u long, v long").distinct(), "edges")
    while (n := now.count()) > EDGES and not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = spread_join(both.where("v > u"), low.select("u", "m"), "u", low, 2 * n)
        large = saved(large.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, low.select("u", "m"), "u", low, n)
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, now = now, saved(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        dropped(old, large)
    if n <= EDGES:  # what one task unites is a forest of stars
        old, now = now, saved(now.coalesce(1).mapInPandas(_joined, "u long, v long"), "stars")
        dropped(old)
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out._docgrid_path = now._docgrid_path
    return out


#: Edges that a task unites at once.
EDGES = 1 << 19


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over EDGES edges at a time: an edge (u, v) from each node to the smallest of its component there."""
    held: list[np.ndarray] = []
    size = 0
    for b in batches:
        held.append(b[["u", "v"]].to_numpy(dtype=np.int64))
        size += len(b)
        if size >= EDGES:
            yield _united(np.concatenate(held))
            held, size = [], 0
    if size:
        yield _united(np.concatenate(held))


def _united(edges: np.ndarray) -> pd.DataFrame:
    ids, place = np.unique(edges.T.ravel(), return_inverse=True)
    left, right = np.split(place, 2)
    root = np.arange(len(ids))
    while True:  # hook and jump until both ends of every edge have one root
        x, y = root[left], root[right]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    more = root != np.arange(len(ids))
    return pd.DataFrame({"u": ids[more], "v": ids[root[more]]})


def _stars(edges: DataFrame) -> bool:
    """Whether each node u has one edge and no v is a u: all nodes point at the head of their component."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("head")), F.struct(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("head")))).alias("e"))
    per = ends.select("e.*").groupBy("n").agg(F.sum("up").alias("up"), F.max("head").alias("head"))
    return per.where("up > 1 or (up > 0 and head > 0)").isEmpty()

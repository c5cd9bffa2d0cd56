"""What the operators of this subpackage share: shared-folder tables, links to components, joins with hot keys, splits."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of texts that a worker handles together, and rows.
SLICE_BYTES, SLICE_ROWS = 8_000_000, 512
#: Rows and bytes of an Arrow batch: a worker holds one with all its texts.
BATCH_ROWS, BATCH_BYTES = 1_000, 64 << 20
#: A key is hot if it has more rows than a share of one in so many of all, and so many at least; so there are ``HOT_SHARE`` hot keys at most.
HOT_SHARE, HOT_ROWS = 1_000, 100
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set a local session gets a temporary one; a cluster gets an error, as its
    machines would not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir isn't set: the operators write intermediate tables to that shared folder")
        app = spark.sparkContext.applicationId
        found = _OWN[app] = _OWN.get(app) or tempfile.mkdtemp(prefix="spark-")
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows and by bytes where the session has Spark's defaults; a session's own settings stay. Spark has no such
    setting for a single query, and its default batch of ten thousand long documents is too much for a worker."""
    for key, default, value in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", f"{2**63 - 1}b", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key) == default:
            spark.conf.set(key, str(value))


def slices(batches: Iterator[pa.RecordBatch], text: int | None = None, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Pieces of the batches of at most ``rows`` rows, and of ``SLICE_BYTES`` of the column ``text`` unless one row alone has more."""
    for whole in batches:
        at = 0
        sizes = None if text is None else pa.compute.binary_length(whole.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        while at < whole.num_rows:
            end = min(at + rows, whole.num_rows)
            if sizes is not None:
                total = sizes[at:end].cumsum()
                end = at + max(1, int(total.searchsorted(SLICE_BYTES, side="right")))
            yield whole.slice(at, end - at)
            at = end


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Cuts the lineage: a lost executor costs tasks, never the work before this table. The files stay until the
    cluster clears the folder, as a lazy result may still read them.
    """
    spark = df.sparkSession
    small_batches(spark)
    return stored(df, f"{shared_dir(spark)}/privloom/{name}-{uuid.uuid4().hex}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` worked out once: lambda variables are never inlined, as columns of a projection are."""
    return F.element_at(F.transform(F.array(value), body), 1)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``: the split into training and held-out rows."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def sample_rows(df: DataFrame, key: Column, n: int) -> DataFrame:
    """At most ``n`` rows, those with the smallest hash of ``key``: a bounded sample that doesn't depend on partitions.

    Most rows go by a threshold on the hash, so that the sort sees little more than ``n`` rows however many there are.
    """
    rows = df.count()
    h = F.xxhash64(key)
    share = (1.2 * n + 100) / max(rows, 1)
    if share < 0.5:
        near = df.filter(h <= F.lit(int(-(2**63) + share * 2**64)))
        if near.count() >= n:
            df = near
    return df.orderBy(h, key).limit(n)


def join_counted(left: DataFrame, counted: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of ``left`` with ``counted``: one row a key, and in its column ``n`` how many of left's ``total`` rows have that key.

    Hot keys (``HOT_SHARE`` at most) are sent to every task, so that their rows stay spread as they are; the others are shuffled.
    """
    least = max(total // HOT_SHARE, HOT_ROWS)
    hot, cold = counted.filter(F.col("n") > least).drop("n"), counted.filter(F.col("n") <= least).drop("n")
    warm = left.join(F.broadcast(hot), key)
    return warm.unionByName(left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (a long, b long): (id, component), the smallest id reachable.

    Alternates two star contractions until nothing changes. Large star: every node's larger neighbours are
    linked to its smallest neighbour; small star: every node's smaller neighbours likewise. Edges are kept
    distinct, so a round never holds more edges than before, and the number of rounds grows with the logarithm of
    the longest chain. Each round is written to the shared folder, and the one before the last goes. The hub of a large component is a hot key,
    which ``join_counted`` keeps out of a single task. Ids without links are not returned.
    """
    spark = links.sparkSession
    small_batches(spark)
    folder = f"{shared_dir(spark)}/privloom/links-{uuid.uuid4().hex}"
    digest = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges, turn, before = stored(edges, f"{folder}/0"), 0, None
    now = digest(edges)
    while now != before and now[0]:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
        large = (
            join_counted(both.filter("v > u"), low, "u", 2 * now[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v").distinct()
        )
        large = stored(large, f"{folder}/{turn}-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_counted(large, low, "u", now[0])
        small = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small.select("u", F.col("m").alias("v")))
            .filter("u <> v").distinct()
        )
        turn += 1
        edges, before = stored(small, f"{folder}/{turn}"), now
        now = digest(edges)
        delete(spark, f"{folder}/{turn - 1}")
        delete(spark, f"{folder}/{turn - 1}-large")
    out = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return out.union(roots).distinct()


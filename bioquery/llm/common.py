"""What the operators of this subpackage share: stored tables, components, folds."""

import atexit
import functools
import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(id_column, modulus: int):
    """crc32 of the id as text, modulo modulus; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def fresh(columns, name: str) -> str:
    """A column name for the operator's own use that none of columns has, in any case."""
    taken, name = {c.lower() for c in columns}, f"__{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


@functools.cache
def _temporary():
    return tempfile.mkdtemp(prefix="bioquery-")


#: For tables of long binary values: sizes are looked at after each row, and not after 100, so that
#: neither who writes a file nor who reads it holds more than about 4 MB of it, or one row, at a time.
BLOBS = {"parquet.block.size": str(4 << 20), "parquet.page.size.row.check.min": "1", "parquet.enable.dictionary": "false"}


class Store:
    """Tables in the shared checkpoint folder; they cut lineage and survive lost executors.

    The folder is ``spark.checkpoint.dir`` of the session; where that is unset and
    Spark runs in this process (tests, a laptop), one temporary folder is made; on
    a cluster that is an error.  What is not dropped is deleted when the driver
    process ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root:
            if not re.match(r"local($|\[)", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = _temporary()
        self.root = f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self._delete, self.root)

    def put(self, df: DataFrame, name: str, compression: str = "zstd", options: dict[str, str] | None = None) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.option("compression", compression).options(**(options or {})).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stored_at = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables whose readers have all run, and lets Spark free their shuffles."""
        for df in frames:
            self._delete(df._stored_at)
        self.sweep()

    def sweep(self) -> None:
        """Lets Spark delete the shuffle files of plans that have run; else they stay until the driver's next collection."""
        for _ in range(2):  # the first lets go of the plans, the second of what they alone held
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.7)  # Spark's cleaner works beside

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            pass


def lean(run):
    """A function for mapInArrow that gives freed memory back to the system when a task ends.

    Spark keeps Python workers for later tasks; what their allocators hold on to
    stays with the executor while other stages, also such without Python, need it.
    """

    def task(batches):
        import ctypes

        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return task


def _stars_of_partition(batches):
    """Union-find over the edges of one partition, emitted as (member, smallest member)."""
    import numpy as np
    import pyarrow as pa

    a, b = [], []
    for batch in batches:
        a.append(batch.column(0).to_numpy(zero_copy_only=False))
        b.append(batch.column(1).to_numpy(zero_copy_only=False))
    if not a:
        return
    a, b = np.concatenate(a), np.concatenate(b)
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:  # hook to the smaller label, then jump pointers, until nothing moves
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    for at in range(0, len(moved), 50_000):
        part = moved[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[part]), pa.array(nodes[label[part]])], names=["a", "b"])


EDGES_A_TASK = 200_000  # edges that one task contracts: about 30 MB of arrays


def components(spark: SparkSession, edges: DataFrame, store: Store) -> DataFrame:
    """Connected components of undirected edges (a long, b long): rows (node, component).

    component is the smallest node; nodes without edges have no row.  Each round
    deals the edges by their larger end (one of more than EDGES_A_TASK edges to
    several tasks), EDGES_A_TASK to a task, and replaces
    those of a task by stars (member, root) found by union-find.  A member with
    several roots then keeps the smallest and links the others to it, so what is
    connected stays connected and every edge points at a smaller node.  When each
    member has one root, pointers are doubled until all point at final roots.
    A member has at most one root a task, so no key of a round's join is hot.
    """
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = store.put(pairs.distinct(), "edges")
    while True:
        tasks = -(-pairs.count() // EDGES_A_TASK)
        if tasks > 1:  # ends of more edges than a task takes are fewer than the tasks
            hot = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(float(EDGES_A_TASK))).alias("salts")).where("salts > 1")
            salt = F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1)))
            dealt = pairs.join(F.broadcast(hot), "a", "left").withColumn("salt", salt).repartition(tasks, "a", "salt").select("a", "b")
        else:
            dealt = pairs.coalesce(1)
        stars = store.put(dealt.mapInArrow(lean(_stars_of_partition), "a long, b long"), "stars")
        if tasks <= 1:
            flat = stars
            break
        least = store.put(stars.groupBy("a").agg(F.min("b").alias("root"), F.count("*").alias("n")), "least")
        if least.where("n > 1").isEmpty():
            flat = _jump(stars, store)
            break
        linked = stars.join(least.where("n > 1"), "a").where("b <> root").select(F.col("b").alias("a"), F.col("root").alias("b"))
        pairs = store.put(least.select("a", F.col("root").alias("b")).unionByName(linked).distinct(), "edges")
    roots = flat.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return flat.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _jump(forest: DataFrame, store: Store) -> DataFrame:
    """Doubles the pointers of a forest (a, b) with b < a until every b is a root."""
    flat = forest
    while True:
        up = flat.select(F.col("a").alias("b"), F.col("b").alias("upper"))
        jumped = store.put(flat.join(up, "b", "left").select("a", F.coalesce("upper", "b").alias("b"), F.col("upper").isNotNull().alias("moved")), "jump")
        flat = jumped.select("a", "b")
        if jumped.where("moved").isEmpty():
            return flat

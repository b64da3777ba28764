"""Session plumbing that the operators share: batch size, partition counts, shared folder, workers' memory."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import local_components

#: Rows of one Arrow batch: whole texts travel in batches, so keep few of them together.
BATCH_ROWS = "512"
_BATCH_SETTING, _SPARKS_OWN = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
#: Bytes of input for each bucket that a task sorts at once; tables of more bytes get more buckets.
BUCKET_BYTES = 4 << 20
#: Edges that a task of components ties at once.
CHUNK = 250_000

_SHIPPED: set[str] = set()
_LOCAL: dict[str, str] = {}
_MADE: list[str] = []


def prepare(spark: SparkSession) -> SparkSession:
    """Small Arrow batches for wide text rows, unless the session has a size of its own, and this
    package on the executors' path, once for each application."""
    if spark.conf.get(_BATCH_SETTING) == _SPARKS_OWN:
        spark.conf.set(_BATCH_SETTING, BATCH_ROWS)
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="vigilspark-"), "vigilspark.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, Path(package.name, file.relative_to(package)))
        context.addPyFile(str(archive))
        _SHIPPED.add(context.applicationId)
    return spark


def partitions(spark: SparkSession) -> int:
    """Tasks of an exchange that is asked for explicitly; the session's setting decides."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets(spark: SparkSession, size: int) -> int:
    """Buckets for ``size`` bytes of input, so that what a task sorts at once doesn't grow with the input."""
    return max(256, partitions(spark), -(-size // BUCKET_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where that is unset a local run gets a temporary one; a cluster must name one that executors share."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = _LOCAL.get(spark.sparkContext.applicationId) or "file://" + tempfile.mkdtemp(prefix="vigilspark-")
        _LOCAL[spark.sparkContext.applicationId] = where
    return where.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and reread it: lineage ends there, and it survives executors."""
    return _written(df, name)[0]


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = f"{shared_folder(df.sparkSession)}/vigilspark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes at its end what :func:`materialise` wrote inside; the caller has stored the result by then."""
    mark = len(_MADE)
    try:
        yield
    finally:
        for path in _MADE[mark:]:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _MADE.remove(path)


def give_back() -> None:
    """Return to the system what Arrow's pool and malloc hold unused: idle Python workers stay small."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, work, schema) -> DataFrame:
    """``df.mapInArrow(work, schema)``, whose workers give their memory back when a task ends."""
    prepare(df.sparkSession)

    def run(batches):
        try:
            yield from work(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def column_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted += "_"
    return wanted


def extended(df: DataFrame, *new: tuple[str, str]) -> T.StructType:
    """The schema of ``df`` with (name, type) columns added; ``df.schema.add`` would change ``df``."""
    return T.StructType([*df.schema.fields, *(T.StructField(n, T.DataType.fromDDL(t)) for n, t in new)])


def scatter(bucket: np.ndarray, columns: dict[str, np.ndarray]):
    """One row per bucket, each column packed as bytes: far fewer shuffle rows than one per item."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    starts = np.concatenate([[0], cuts]) if len(bucket) else np.zeros(0, int)
    ends = np.concatenate([cuts, [len(bucket)]]) if len(bucket) else np.zeros(0, int)
    packed = {k: v[order] for k, v in columns.items()}
    arrays = [pa.array(bucket[starts].astype(np.int32), pa.int32())]
    for v in packed.values():
        arrays.append(pa.array([v[i:j].tobytes() for i, j in zip(starts, ends)], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=["bucket", *packed])


def unpack(table: pa.Table, name: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=dtype)


def _contracted(edges: DataFrame) -> DataFrame:
    """The edges (a, b, moved) as stars within each ``CHUNK`` of a task, so that a node has one row of a chunk as ``a``.

    moved tells whether anything in the chunk is no star of distinct ends, or was marked so before."""

    def run(batches):
        held, rows = [], 0

        def flush():
            table = pa.Table.from_batches(held)
            a, b = table.column("a").to_numpy(), table.column("b").to_numpy()
            node, low = local_components(a, b)
            tied = node != low
            moved = table.column("moved").to_numpy().any() or len(np.unique(a)) != len(np.unique(np.stack([a, b], axis=1), axis=0))
            return pa.RecordBatch.from_arrays([pa.array(node[tied]), pa.array(low[tied]), pa.array(np.full(int(tied.sum()), moved))], names=["a", "b", "moved"])

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK:
                yield flush()
                held, rows = [], 0
        if rows:
            yield flush()

    return map_batches(edges.select("a", "b", "moved"), run, "a long, b long, moved boolean")


def connected_stars(edges: DataFrame, name: str = "components") -> DataFrame:
    """(a, b) for undirected edges (a, b) of longs: every id but the smallest of its component, tied to that one.

    Alternating large-star and small-star steps (Kiveris et al. 2014), three exchanges a round.  As soon as every
    id has one smaller neighbour the small-star step would change nothing: what is left are trees, whose ids
    jump to their parent's parent with two exchanges a round, until no parent has one.  Parents are joined back:
    a hub's neighbours stream by, none is held, and in rounds of trees Spark can split them; of smaller neighbours
    an id has one row a chunk, or at most ``CHUNK`` rows in all.  Every round is a table in the shared folder, which replaces the round before.
    """
    ends = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), F.lit(False).alias("moved"))
    seen = Observation()
    # Stars of several tasks repeat an edge; without the repeats a hub has one row a neighbour.
    edges, path = _written(_contracted(ends).select("a", "b").distinct().observe(seen, F.count(F.lit(1)).alias("n")), name)
    trees, rows = False, seen.get["n"]
    while True:
        up = (edges if trees else edges.groupBy("a").agg(F.min("b").alias("b"))).select(F.col("a").alias("of"), F.col("b").alias("up"))
        new = edges.join(up, F.col("b") == F.col("of"), "left").select("a", F.coalesce("up", "b").alias("b"), F.col("up").isNotNull().alias("moved"))
        if not trees:
            if rows > CHUNK:
                new = _contracted(new)
            # One exchange: rows of one id lie together, so equal ones and the least are found in place.
            new = new.repartition("a").groupBy("a", "b").agg(F.max("moved").alias("moved")).withColumn("low", F.min("b").over(Window.partitionBy("a")))
            more = F.col("b") != F.col("low")
            new = new.select(F.when(more, F.col("b")).otherwise(F.col("a")).alias("a"), F.col("low").alias("b"), "moved", more.alias("more"))
        else:
            new = new.withColumn("more", F.lit(False))
        seen, old = Observation(), path
        edges, path = _written(new.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if("moved").alias("moved"), F.count_if("more").alias("more")).select("a", "b"), name)
        _delete(edges.sparkSession, old)
        rows, trees = seen.get["n"], trees or not seen.get["more"]
        if trees and not seen.get["moved"]:
            return edges


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) for undirected edges (a, b) of longs; component is the smallest id reachable.

    Ids without an edge have no row."""
    stars = connected_stars(edges, name)
    return stars.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        stars.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )

"""Helpers that keep a plan safe for groups of any size.

Nothing here puts a whole group into one task: order inside a group comes from a range partitioning over the group key
*and* the order columns, so that a key that holds a third of all rows is spread over as many tasks as its rows need.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from typing import TypeVar

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

T = TypeVar("T")

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Where it is unset, a session whose executors are threads of this machine gets a folder of its own, as in tests; any other one is an error, since
    what one machine holds is lost with it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it from there.

    Columnar and compressed, it takes a fraction of the space of a checkpoint; a lost executor takes nothing of it along. The
    tables are removed at the end of the program, at the end of a :func:`query_tables` block around the query, or by :func:`release_tables`.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lodestone-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def release_tables(keep: int = 0) -> None:
    """Remove the tables that :func:`cut_lineage` wrote, but for the first ``keep``; no result that reads one may be used afterwards."""
    while len(_written) > keep:
        spark, path = _written.pop()
        with contextlib.suppress(Exception):
            jvm = spark.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextlib.contextmanager
def query_tables() -> Iterator[None]:
    """Around the building and the use of a query in a program that lives long: what it wrote is removed at the block's end."""
    before = len(_written)
    try:
        yield
    finally:
        release_tables(keep=before)


#: Logical nodes that shuffle, or whose partitions are those of several inputs.
_SHUFFLES = frozenset(
    ("Join", "Aggregate", "Sort", "Window", "Distinct", "Deduplicate", "Repartition", "RepartitionByExpression", "RebalancePartitions", "Union", "Intersect", "Except", "GlobalLimit")
)


def _shuffles(plan) -> bool:  # noqa: ANN001
    """Whether a node of a logical plan is one of these."""
    if plan.nodeName() in _SHUFFLES:
        return True
    below = plan.children()
    return any(_shuffles(below.apply(i)) for i in range(below.size()))


def spread(df: DataFrame, factor: int = 2) -> DataFrame:
    """Spread rows over the cluster before work that is bound by CPU, for which sizes in bytes say little.

    A scan with at least ``factor`` splits per core is left alone: no shuffle of whole texts at scale; a smaller one is divided. Behind a
    shuffle, whose partitions may have been joined by size, the rows go to the session's number of shuffle partitions, or ``factor``
    per core if that is more. Nothing is run to find out.
    """
    spark = df.sparkSession
    wanted = factor * spark.sparkContext.defaultParallelism
    if _shuffles(df._jdf.queryExecution().optimizedPlan()):
        return df.repartition(max(wanted, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    totals: Mapping[str, Column],
    whole: bool = False,
) -> DataFrame:
    """Add, for each name of ``totals``, the sum of its expression over the rows before the row in its group; with ``whole`` also that over its
    whole group, as the name with ``_all`` behind it.

    ``keys`` are compared null-safely. ``order`` should be total; rows that tie in it get consecutive places in any order.
    The range bounds come from a sample, therefore the partitioned rows are written once (:func:`cut_lineage`) and both
    the totals of the parts and the places inside a part are taken from that copy. A group has at most one row per
    partition in the table of totals.
    """
    names = list(totals)
    parted = df.withColumns({f"_v_{n}": F.coalesce(totals[n].cast("long"), F.lit(0)) for n in names})
    parted = parted.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id())
    parted = cut_lineage(parted)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parted.groupBy(*keys, "_part").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in names])
    parts = parts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_part").alias("_p"),
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in names],
        *[F.sum(f"_s_{n}").over(Window.partitionBy(*keys)).alias(f"_a_{n}") for n in names if whole],
    )
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = parted.withColumns({f"_l_{n}": F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in names})
    match = local["_part"] == parts["_p"]
    for i, k in enumerate(keys):
        match = match & local[k].eqNullSafe(parts[f"_k{i}"])
    joined = local.join(parts, match)
    sums = [(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in names]
    return joined.select(*df.columns, *sums, *[F.col(f"_a_{n}").alias(f"{n}_all") for n in names if whole])


def without(rows: DataFrame, gone: DataFrame, key: str, by: str, parts: int = 16) -> DataFrame:
    """``rows`` whose ``key`` is not in ``gone``, a table of keys; a key that many rows share is divided over ``parts`` tasks by ``by``.

    Keys without value stay. Only the keys are repeated, once for each part.
    """
    named = gone.select(F.col(key)).filter(F.col(key).isNotNull()).distinct().withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int"))
    return salted.join(named, [key, "_salt"], "left_anti").select(*rows.columns)


def in_blocks(rows: Iterable[T], most: int, most_bytes: int, size: Callable[[T], int]) -> Iterator[list[T]]:
    """Lists of at most ``most`` rows and ``most_bytes`` bytes by ``size``, or of one row."""
    held: list[T] = []
    took = 0
    for row in rows:
        n = size(row)
        if held and (len(held) == most or took + n > most_bytes):
            yield held
            held, took = [], 0
        held.append(row)
        took += n
    if held:
        yield held


def over_blocks(spark: SparkSession, blocks: Iterator[list], run: Callable[[Broadcast], DataFrame]) -> DataFrame | None:
    """The united results of ``run`` for the broadcast of each block; none without blocks.

    One block stays a lazy plan. Of several, each result is written before the next block is fetched, so the driver and the executors
    hold one block at a time, however many there are.
    """
    block, after = next(blocks, None), next(blocks, None)
    if block is None or after is None:
        return None if block is None else run(spark.sparkContext.broadcast(block))
    out = None
    while block is not None:
        shared = spark.sparkContext.broadcast(block)
        found = cut_lineage(run(shared))
        shared.destroy()
        out = found if out is None else out.unionByName(found)
        block, after = after, next(blocks, None)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

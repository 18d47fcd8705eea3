"""Helpers shared by the training-data operators: stored tables, partition counts, components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Words of the contracts: runs of anything but space and the ASCII controls 9 to 13.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A session of one machine that names none gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallyforge-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it again.

    The files outlive lost executors; they are removed with the folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.stored_at = path
    return made


def delete(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again."""
    for t in tables:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again, and let Spark drop shuffle files of finished queries.

    Spark's cleaner removes shuffle files once the driver has collected the objects that refer to them.
    """
    delete(spark, *tables)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_columns(schema: T.StructType, fields: list[T.StructField], compute: Callable[[pa.RecordBatch], list]) -> Callable:
    """A mapInArrow function that passes all columns on and appends what ``compute`` returns for a batch."""
    out = to_arrow_schema(T.StructType([*schema.fields, *fields]))
    types = [out.field(len(schema.fields) + k).type for k in range(len(fields))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = compute(b) if b.num_rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, t) for x, t in zip(new, types, strict=True))], names=out.names)

    return run


def fresh(name: str, columns: list[str]) -> str:
    """``name``, with underscores appended until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def hash_bound(share: float) -> int:
    """The 64-bit hash up to which about ``share`` of all hashes lie."""
    return min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))


def groups_for(rows: int, per_group: int) -> int:
    """How many groups keep each at about ``per_group`` rows."""
    return max(1, -(-rows // per_group))


def joined(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """An equi-join of two tables that grow with the input, shuffled on both sides.

    Before a query runs, Spark takes an exploded table for as small as the file that it comes from, and a filtered one of compressed files for less than its rows hold; left to that,
    it collects such a table on the driver in order to broadcast it.
    """
    return left.join(right.hint("merge"), on, how)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links (a, b): rows (node, component), component = smallest node.

    Distributed union-find by alternating large-star and small-star rounds until nothing changes. A round is two grouped
    minima (combined before the shuffle) and two equi-joins whose skewed sides Spark can split, so
    a hub is never collected. Every round is written to the shared folder, and the one before is deleted; the driver sees
    only a checksum. Nodes without links do not appear. The node type must have an order.
    """
    spark = edges.sparkSession
    e = stored(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(),
        "links",
    )
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = joined(both.where("b > a"), low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        lowest = joined(large, least, "a")
        small = lowest.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        seen = Observation()  # counted while the links are written
        links = small.where("a <> b").distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("sum"))
        old, e = e, stored(links, "links")
        delete(spark, old)
        now = seen.get
        if now == before or not now["n"]:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


#: Bands with up to so many rows outside the component of their hub compare these with all rows; others are cut. Each level takes
#: DEEPER times as many, since a cut puts each row into as many bands as its residue has bins.
OUTSIDERS, DEEPER = 16, 4


def clusters(members: DataFrame, similar: Callable[[DataFrame], DataFrame], residue: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Components (node, component) of similar pairs among rows (band, k) that share a band.

    ``similar`` gets pairs (a, b) and returns those that are similar. ``residue`` gets rows (band, k, hub) and returns (band, k) again with smaller bands: rows of a band share a
    new one if they share something that their hub lacks. Pairs are compared only while their ends lie in different components.

    The copies of one original resemble it more than each other, so the row whose bands hold the most rows (the hub) is compared with all others of its band. What is left to compare are
    the rows outside the hub's component: if they are at most OUTSIDERS (more on deeper levels), each is compared with all rows of the band in other components, which is linear in the band and
    closes it. A band with more is given up for the bands of its residue: rows of one template are unlike each other because of what
    the template lacks, and a similar pair among them shares part of just that. So no band is dropped with pairs that nothing else would
    compare, and what is compared grows with the rows that share something rare. Bands of the same rows are one. A residue band lacks its hub, so
    bands shrink from level to level until none is left.
    """
    spark = members.sparkSession
    size = members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    sized = stored(joined(members, size, "band"), "cluster-sizes")
    weight = sized.groupBy("k").agg(F.sum("n").alias("g"))
    live = stored(joined(sized, weight, "k").select("band", "k", "g"), "cluster-bands")
    delete(spark, sized)
    best = joined(live, live.groupBy("band").agg(F.max(F.struct("g", "k")).alias("hub")), "band").groupBy("k").agg(F.max("hub").alias("hub"))
    found = [stored(similar(best.where("hub.k <> k").select(F.greatest("k", "hub.k").alias("a"), F.least("k", "hub.k").alias("b")).distinct()), "cluster-links")]
    component = stored(components(found[0]), "cluster-components")
    release(spark)
    lineage = F.lit(0).cast("bigint")  # at first bands with the same hub are cut as one; later each by itself, so that they shrink
    limit = OUTSIDERS
    while True:
        placed = joined(live, component, live["k"] == component["node"], "left").select("band", "k", "g", F.coalesce("component", "k").alias("c"))
        several = placed.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.max(F.struct("g", "k", "c")).alias("hub")).where("low < high")
        now = stored(joined(placed, several, "band").select("band", "k", "g", "c", F.col("hub.k").alias("p"), F.col("hub.c").alias("pc")), "cluster-live")
        delete(spark, live)
        outside = now.where("c <> pc")
        many = outside.groupBy("band").agg(F.count("*").alias("n")).where(f"n > {limit}").select("band")
        under = stored(joined(now, many, "band").where("k <> p"), "cluster-hubs")
        few = joined(outside, many, "band", "left_anti").select("band", F.col("k").alias("o"), F.col("c").alias("oc"))
        closed = joined(now, few, "band").where("oc <> c").select("k", F.col("o").alias("p"))
        pairs = closed.unionByName(under.where("pc <> c").select("k", "p")).select(F.greatest("k", "p").alias("a"), F.least("k", "p").alias("b"))
        new = stored(similar(pairs.distinct()), "cluster-links")
        found.append(new)
        last = under.isEmpty()
        if not new.isEmpty():
            old, component = component, stored(components(component.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(new)), "cluster-components")
            release(spark, old)
        if last:
            delete(spark, now, under, *found)
            return component
        cut = stored(residue(under.select(lineage.alias("band"), "k", F.col("p").alias("hub")).distinct()), "cluster-residue")
        lineage, limit = F.col("band"), limit * DEEPER
        sets = cut.groupBy("band").agg(F.count("*").alias("n"), F.sum(F.xxhash64("k").cast("decimal(20,0)")).alias("rows")).where("n > 1")
        once = sets.groupBy("rows", "n").agg(F.min("band").alias("band"))
        # A row weighs as much as the bands that it shares now.
        next_ = stored(joined(cut, once, "band").select("band", "k", "n"), "cluster-sizes")
        live = stored(joined(next_, next_.groupBy("k").agg(F.sum("n").alias("g")), "k").select("band", "k", "g"), "cluster-bands")
        release(spark, now, under, cut, next_)

"""Session, table and checkpoint helpers shared by every operator."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "quillmesh", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings the operators assume (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder the cluster names.

    The folder comes from ``spark.checkpoint.dir``. Only where that is unset and the session is
    local (tests, a notebook) a local folder is set; on a cluster that is an error, since other
    machines would not see it. A reliable checkpoint survives lost executors; localCheckpoint
    does not and is never used.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillmesh-checkpoint-"))
    return df.checkpoint()


def blocked_last(df: DataFrame, keys: list[str], order: str, value, name: str, block: int = 4096, include_self: bool = True) -> DataFrame:
    """Forward-fill: the last non-null ``value`` at or before each row, in ``order`` within ``keys``.

    A key may hold a third of all rows, so no window spans a key: rows are windowed inside
    blocks of ``block`` positions, each block is reduced to its last value, those (one row a
    block) are filled among themselves and joined back. ``order`` must be an integer column.
    With ``include_self=False`` the value comes from strictly earlier rows. Null order values
    form a block of their own that comes first. ``df`` is read twice: cut() an expensive one first.
    """
    from pyspark.sql import Window

    b, carried = "__block", "__carried"
    blocked = df.withColumn(b, F.floor(F.coalesce(F.col(order), F.lit(-1)) / block)).withColumn("__v", value)
    rows = Window.partitionBy(*keys, b).orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if include_self else -1)
    inside = blocked.withColumn("__in", F.last("__v", ignorenulls=True).over(rows))
    ends = blocked.groupBy(*keys, b).agg(F.max(F.when(F.col("__v").isNotNull(), F.struct(order, "__v")))["__v"].alias("__end"))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    filled = ends.withColumn(carried, F.last("__end", ignorenulls=True).over(before)).where(F.col(carried).isNotNull()).drop("__end")
    back = [inside[k].eqNullSafe(filled[k]) for k in [*keys, b]]
    condition = back[0]
    for c in back[1:]:
        condition = condition & c
    out = inside.join(filled, condition, "left").select(*[inside[c] for c in df.columns], F.coalesce(inside["__in"], filled[carried]).alias(name))
    return out


def once(df: DataFrame, **columns) -> DataFrame:
    """Adds computed columns that later steps read as they are.

    Filters and projections further up would otherwise take in the columns' expressions, once
    for each use, and large expressions would be planned, compiled and run that often. A
    generator of one row is where such rewriting stops; it moves no data.
    """
    kept = [c for c in df.columns if c not in columns]
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("__once")
    return df.select(*kept, made).select(*[n if n in kept else F.col(f"__once.{n}").alias(n) for n in dict.fromkeys([*df.columns, *columns])])

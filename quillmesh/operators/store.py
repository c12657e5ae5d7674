"""Reads and upserts over the record tables: latest per key, chains, retention, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import SPACE_SET
from quillmesh.tables import written


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last row of each key: an append-only log read as an upserted table."""
    by = Window.partitionBy(key).orderBy(*[o.desc_nulls_last() for o in order])
    return df.withColumn("__r", F.row_number().over(by)).where("__r = 1").drop("__r")


def patched(old: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Old rows with the patch's non-null columns, and the patch's new keys."""
    theirs = patch.select(key, *[F.col(c).alias(f"__{c}") for c in old.columns if c != key and c in patch.columns])
    cols = [F.coalesce(f"__{c}", c).alias(c) if f"__{c}" in theirs.columns else F.col(c) for c in old.columns]
    return old.join(theirs, key, "full").select(*cols)


def inserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Idempotent insert: rows of `new` whose key is not in `old` yet, one for each key."""
    return new.where(F.col(key).isNotNull()).dropDuplicates([key]).join(old.select(key), key, "left_anti")


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Tombstones: rows whose key is not deleted."""
    return df.join(gone.select(key).distinct(), key, "left_anti")


def newest(df: DataFrame, order: str, n: int) -> DataFrame:
    """The newest n rows; sorted partitions are cut before anything is gathered."""
    return df.orderBy(F.desc(order)).limit(n)


def newest_per(df: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    by = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)


def versions(df: DataFrame, group: list[str], order: list[str], done: Column) -> DataFrame:
    """`df` with version: one more than the number of finished rows before it in its group, and parent, the last of them."""
    by = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("version", F.count(F.when(done, 1)).over(by) + 1).withColumn("parent", F.last(F.when(done, F.col("job_id")), ignorenulls=True).over(by))


def chains(links: DataFrame, child: str, parent: str, most: int = 64) -> DataFrame:
    """(id, root, depth): the first ancestor of each row and the steps to it.

    Pointers are doubled in each round until every chain has come to its first ancestor, so chains of 2^n
    steps take n rounds. What still has a parent after as many steps as there are rows leads into a cycle;
    it gets the ancestor `most` steps (a power of two) back. A parent that is no row counts as an ancestor.
    """
    at = links.where(F.col(child).isNotNull()).groupBy(F.col(child).alias("id")).agg(F.min(parent).alias("root"))
    at = written(at.select("id", F.when(F.col("root") != F.col("id"), F.col("root")).alias("up")), "links")
    parents = at.where("up is not null").select(F.col("id").alias("root"), F.lit(True).alias("open"))
    state = at.select("id", F.coalesce("up", "id").alias("root"), F.when(F.col("up").isNotNull(), 1).otherwise(0).alias("depth"))
    state = written(state.join(parents, "root", "left").select("id", "root", "depth", F.coalesce("open", F.lit(False)).alias("open")), "chains")
    steps, far, n = 1, None, at.count()
    while state.where("open").limit(1).count() and steps <= max(n, most):
        above = state.select(F.col("id").alias("root"), F.col("root").alias("__root"), F.col("depth").alias("__depth"), F.col("open").alias("__open"))
        after = state.join(above, "root", "left").select("id", F.coalesce("__root", "root").alias("root"), (F.col("depth") + F.coalesce("__depth", F.lit(0))).alias("depth"), F.coalesce("__open", F.lit(False)).alias("open"))
        state, steps = written(after, "chains"), steps * 2
        if steps == most:
            far = state
    if far is not None:
        of_cycle = far.select("id", F.col("root").alias("__root"), F.col("depth").alias("__depth"))
        state = state.join(of_cycle, "id").select("id", F.when(F.col("open"), F.col("__root")).otherwise(F.col("root")).alias("root"), F.when(F.col("open"), F.col("__depth")).otherwise(F.col("depth")).alias("depth"))
    return state.select("id", "root", "depth")


def masked(sources: Column, hide: Column) -> Column:
    """Sources with title and address hidden under a condition."""
    return F.when(hide, F.transform(sources, lambda s: s.withField("title", F.lit("[Source hidden]")).withField("url", F.lit("#")))).otherwise(sources)


def seeded(df: DataFrame, seed: DataFrame) -> DataFrame:
    """`df`, or the rows of `seed` where `df` is empty."""
    return df.unionByName(seed.join(df.select(F.lit(1).alias("__one")).limit(1), F.col("__one") == 1, "left_anti").select(*df.columns))


def retained(df: DataFrame, order: str, n: int) -> DataFrame:
    """A log cut to its newest n rows, written anew so that it can replace the old one."""
    return written(newest(df, order, n), "retained")


def upload_outcome(org: str = "org_id", title: str = "title", url: str = "url", content: str = "content") -> Column:
    """`valid`, or the name of the first field that an upload's validation rejects."""
    absent = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    address = F.coalesce(F.col(url).rlike(rf"^[A-Za-z][A-Za-z0-9+.-]*://[^{SPACE_SET}/]+"), F.lit(False))
    return F.when(absent(org), "org_id").when(absent(title), "title").when(~address, "url").when(absent(content), "content").otherwise("valid")


def client_ip(forwarded: Column, remote: Column | None = None) -> Column:
    """The first address of a forwarding header, else the remote one, else `unknown`."""
    first = F.trim(F.get(F.split(forwarded, ","), 0))
    return F.coalesce(first, *([remote] if remote is not None else []), F.lit("unknown"))

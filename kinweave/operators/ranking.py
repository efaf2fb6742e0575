"""First-wins, caps per group, paging, positions and hash picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.lineage import cut


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Keep the first row of each key by ascending ``order``.

    An aggregate, not a window: every task keeps one row per key before the shuffle, so a key that
    holds much of the input costs no more than any other.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("_first")).select(
        *[c if c in keys else F.col(f"_first.`{c}`").alias(c) for c in df.columns]
    )


def cap_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int,
                  rank: str | None = None) -> DataFrame:
    """At most ``k`` rows per key, by ``order``; test eligibility before calling this.

    Spark turns ``row_number <= k`` into a limit per group on each side of the shuffle, so a large
    group reaches the last task as ``k`` rows per input task.
    """
    name = rank or "_rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)
    return ranked if rank else ranked.drop(name)


def top_n(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """First ``n`` rows overall; planned as a per-task top-n and a merge."""
    return df.orderBy(*order).limit(n)


def page(df: DataFrame, order: Sequence[Column | str], limit: int, offset: int = 0) -> DataFrame:
    """One page of an ordered listing. ``order`` should end in a unique column."""
    ordered = df.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def with_position(df: DataFrame, order: Sequence[str], groups: Sequence[str] = (),
                  name: str = "position") -> DataFrame:
    """Dense 0-based position by ``order`` within ``groups`` (or overall), without one-task windows.

    Rows are range-partitioned and sorted, each partition numbers its own rows, and the sizes of the
    partitions before it are added. A checkpoint fixes the numbering, so a retried task cannot see
    other range bounds than the counting job did.
    """
    columns = df.columns
    ranged = df.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order)
    numbered = cut(ranged.withColumn("_mark", F.monotonically_increasing_id()))
    numbered = numbered.withColumn("_part", F.shiftright("_mark", 33)).withColumn(
        "_row", F.col("_mark").bitwiseAND((1 << 33) - 1)
    )
    # One row per partition of the range shuffle: the window below is as small as that.
    sizes = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    placed = numbered.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_row"))
    if groups:
        firsts = placed.groupBy(*groups).agg(F.min(name).alias("_first"))
        keys = [F.col(f"p.{g}").eqNullSafe(F.col(f"f.{g}")) for g in groups]
        condition = keys[0]
        for key in keys[1:]:
            condition = condition & key
        placed = placed.alias("p").join(firsts.alias("f"), condition).select(
            *[F.col(f"p.{c}") for c in columns], (F.col(f"p.{name}") - F.col("_first")).alias(name)
        )
    return placed.select(*columns, name)


def hash_number(seed: Column) -> Column:
    """Number made of the first 8 hex digits of the SHA-256 of ``seed``."""
    return F.conv(F.substring(F.sha2(seed, 256), 1, 8), 16, 10).cast("long")


def pick_by_hash(pool: DataFrame, seeds: DataFrame, seed: str = "seed", id_col: str = "id") -> DataFrame:
    """For each seed text, the pool member at position ``hash(seed) % size`` of the sorted pool."""
    placed = with_position(pool.select(id_col).distinct(), [id_col])
    size = placed.agg(F.nullif(F.count(F.lit(1)), F.lit(0))).scalar()
    wanted = seeds.withColumn("position", hash_number(F.col(seed)) % size)
    return wanted.join(placed, "position").select(*seeds.columns, id_col)


def batch_groups(df: DataFrame, group: str, id_col: str, name_col: str, size: int = 12,
                 context: int = 60) -> DataFrame:
    """Fixed-size batches of each group's members with the first other names of the group.

    Output: group, group_size, batch_no, members (at most ``size`` names in id order) and others (at
    most ``context`` sorted names of the group that are not in the batch).
    """
    members = df.filter(F.col(group).isNotNull())
    placed = with_position(members.select(group, id_col, name_col), [id_col], [group])
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("group_size"))
    batches = (
        placed.withColumn("batch_no", F.floor(F.col("position") / size))
        .groupBy(group, "batch_no")
        .agg(F.array_sort(F.collect_list(F.struct("position", name_col))).alias("_m"))
        .select(group, "batch_no", F.col(f"_m.{name_col}").alias("members"))
    )
    # A batch takes away at most ``size`` names, so the first ``size + context`` are always enough.
    names = cap_per_group(members.select(group, name_col).distinct(), [group], [name_col], size + context)
    leading = names.groupBy(group).agg(F.array_sort(F.collect_list(name_col)).alias("_names"))
    return (
        batches.join(sizes, group).join(leading, group)
        .select(group, "group_size", "batch_no", "members",
                F.slice(F.array_except("_names", "members"), 1, context).alias("others"))
    )

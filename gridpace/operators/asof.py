"""As-of joins built from a union and an ordered window; no range join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNB = Window.unboundedPreceding


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_t: str, right_t: str, cols: list[str],
              direction: str = "backward", bucket: int | None = None, tie: str | None = None,
              parts: int | None = None) -> DataFrame:
    """Attach to each left row the nearest earlier (or later, or nearest) right reading of its group.

    Backward is inclusive; nearest breaks distance ties towards the earlier
    reading. With ``bucket`` (width in units of the integer time) each window
    covers one time bucket and the reading carried in from other buckets comes
    from a per-bucket summary, so a group of any size is spread over tasks. With
    ``parts`` rows are dealt by ``by`` into that many partitions and stay there.
    """
    if direction == "nearest":
        back = asof_join(left, right, by, left_t, right_t, cols + [right_t], "backward", bucket, tie, parts)
        back = back.select(*left.columns, F.struct(*[F.col(f"asof_{c}").alias(c) for c in cols + [right_t]]).alias("_b"))
        both = asof_join(back, right, by, left_t, right_t, cols + [right_t], "forward", bucket, tie, parts)
        db = F.col(left_t) - F.col(f"_b.{right_t}")
        df_ = F.col(f"asof_{right_t}") - F.col(left_t)
        use_b = db.isNotNull() & (df_.isNull() | (db <= df_))
        return both.select(*left.columns, *[
            F.when(use_b, F.col(f"_b.{c}")).otherwise(F.col(f"asof_{c}")).alias(f"asof_{c}") for c in cols])

    back = direction == "backward"
    reading = F.struct(F.col(right_t).alias("_rt"), *([F.col(tie).alias("_tie")] if tie else []), *[F.col(c) for c in cols])
    lrow = F.struct(*[F.col(c) for c in left.columns])
    r = right.select(*by, F.col(right_t).alias("_t"), F.lit(0 if back else 1).alias("_side"),
                     F.lit(None).cast(left.select(lrow.alias("s")).schema["s"].dataType).alias("_l"),
                     reading.alias("_r"), *([F.col(tie).cast("bigint").alias("_o")] if tie else [F.lit(0).cast("bigint").alias("_o")]))
    l = left.select(*by, F.col(left_t).alias("_t"), F.lit(1 if back else 0).alias("_side"), lrow.alias("_l"),
                    F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.lit(0).cast("bigint").alias("_o"))
    u = l.unionByName(r)
    if parts and not bucket:
        u = u.repartition(parts, *by)
    part = list(by)
    if bucket:
        u = u.withColumn("_bk", F.floor(F.col("_t") / bucket))
        part.append("_bk")
    # readings at the same instant as the row count as earlier (backward) or later (forward)
    order = [F.col("_t"), F.col("_side"), F.col("_o")]
    if not back:
        order = [F.col("_t").desc(), F.col("_side").desc(), F.col("_o")]
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(UNB, 0)
    m = u.withColumn("_hit", F.last("_r", ignorenulls=True).over(w))
    if bucket:
        best = F.max_by if back else F.min_by
        per = u.groupBy(*part).agg(best("_r", F.when(F.col("_r").isNotNull(), F.struct("_t", "_o"))).alias("_s"))
        ob = F.col("_bk") if back else F.col("_bk").desc()
        wb = Window.partitionBy(*by).orderBy(ob).rowsBetween(UNB, -1)
        carry = per.select(*part, F.last("_s", ignorenulls=True).over(wb).alias("_carry"))
        m = m.join(carry, part, "left").withColumn("_hit", F.coalesce("_hit", "_carry"))
    return (m.filter(F.col("_l").isNotNull())
            # the keys themselves, not their copies, so that Spark knows how the rows are dealt
            .select(*[F.col(c) if c in by else F.col(f"_l.{c}") for c in left.columns], *[F.col(f"_hit.{c}" if c != right_t else "_hit._rt").alias(f"asof_{c}") for c in cols]))

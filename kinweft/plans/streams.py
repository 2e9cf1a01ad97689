"""Queries of keyed, time-based state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweft.plans.base import Registry
from kinweft.session import table
from kinweft.streaming.rate_limit import rate_limit

REG = Registry()
LIMIT, WINDOW = 3, 86_400


@REG.add(
    "rate_limit",
    f"""with recursive e as (select event_id, user_id, ts, row_number() over (partition by user_id order by ts, event_id) rn from events where user_id is not null and ts is not null),
s(user_id, rn, ends, n, ok) as (
  select user_id, 1::bigint, ts + interval {WINDOW} second, 1, true from e where rn = 1
  union all select e.user_id, e.rn, case when e.ts >= s.ends then e.ts + interval {WINDOW} second else s.ends end, case when e.ts >= s.ends then 1 when s.n >= {LIMIT} then s.n else s.n + 1 end, e.ts >= s.ends or s.n < {LIMIT} from s join e on e.user_id = s.user_id and e.rn = s.rn + 1)
select e.event_id, s.ok allowed, case when s.ok then 0 else cast(ceil(epoch_us(s.ends - e.ts) / 1e6) as int) end retry_after from s join e on e.user_id = s.user_id and e.rn = s.rn""",
)
def limited(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("order"))
    return rate_limit(e, LIMIT, WINDOW).select(F.col("order").alias("event_id"), "allowed", "retry_after")

"""Rules, publishing and progress."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from blockhist.operators import compare as CMP, policy, progress
from blockhist.plans import publish
from blockhist.session import materialise

from . import views as V
from .registry import query

D = V.duck

# customers stand for datasets, nations for their state
DATASETS = """
select 'c'||cast(c_custkey as string) dataset, case when c_nationkey%3=0 then 'off' else 'on' end readonly,
       'c'||cast(c_custkey as string)||'-new' target, 'c'||cast(c_custkey as string)||'-old' backup,
       cast(case when c_nationkey%4=0 then 512*c_nationkey else 0 end as bigint) written
from {customer}"""
CUSTOMER_VERSIONS = "select 'c'||cast(o_custkey as string) dataset, 's'||cast(o_orderkey as string) snap, cast(o_orderkey as int) ord from {orders}"
TAKEN = """
select 'c'||cast(c_custkey as string)||case when c_custkey%2=0 then '-new' else '-old' end name from {customer} where c_mktsegment='BUILDING'"""


@query("preflight", f"""with d as ({D(DATASETS)}), n as (select dataset, count(*) n from ({D(CUSTOMER_VERSIONS)}) group by 1), t as (select distinct name from ({D(TAKEN)})),
r as (
  select dataset, 'grain' rule, true passed, false overridable, '4096' detail from d union all
  select dataset, 'read_only', readonly = 'on', true, readonly from d union all
  select d.dataset, 'has_versions', coalesce(n, 0) > 0, false, cast(coalesce(n, 0) as varchar) from d left join n on n.dataset = d.dataset union all
  select dataset, 'head_is_newest', written = 0, true, cast(written as varchar) from d union all
  select dataset, 'target_free', target not in (select name from t), false, target from d union all
  select dataset, 'backup_free', backup not in (select name from t), false, backup from d)
select *, passed or overridable ok from r""")
def preflight(spark, sf):
    d = V.view(spark, sf, DATASETS)
    return policy.preflight(d.drop("written"), V.view(spark, sf, CUSTOMER_VERSIONS), d.select("dataset", "written"),
                            V.view(spark, sf, TAKEN), 4096, force=True)


@query("blocked_datasets", f"""with d as ({D(DATASETS)}), n as (select distinct dataset from ({D(CUSTOMER_VERSIONS)})), t as (select distinct name from ({D(TAKEN)}))
select dataset, cast((readonly <> 'on')::int + (written > 0)::int + (dataset not in (select dataset from n))::int + (target in (select name from t))::int as bigint) failed
from d where readonly <> 'on' or written > 0 or dataset not in (select dataset from n) or target in (select name from t)""")
def blocked_datasets(spark, sf):
    """Datasets that may not start without ``force``; results stay under the new name."""
    d = V.view(spark, sf, DATASETS)
    checks = policy.preflight(d.drop("written"), V.view(spark, sf, CUSTOMER_VERSIONS), d.select("dataset", "written"),
                              V.view(spark, sf, TAKEN), 4096, no_swap=True)
    return checks.filter("not ok").groupBy("dataset").agg(F.count(F.lit(1)).alias("failed"))


@query("protection_outcomes", """
select c_custkey, case when c_mktsegment <> 'BUILDING' then 'plain' when c_nationkey%2=0 then 'inherit'
  when c_acctbal > 0 then 'allowed plain' else 'refuse' end outcome from customer""")
def protection_outcomes(spark, sf):
    c = V.table(spark, sf, "customer")
    return c.select("c_custkey", policy.protection_outcome(
        F.col("c_mktsegment") == "BUILDING", F.col("c_nationkey") % 2 == 0, F.col("c_acctbal") > 0).alias("outcome"))


@query("reservations", f"""select dataset, property, case property when 'refreservation' then 'auto' else value end value
from ({D(V.RESERVATIONS)}) where property in ('reservation', 'refreservation') and value not in ('', '0', 'none', '-')""")
def reservations(spark, sf):
    return policy.reservation_rows(V.view(spark, sf, V.RESERVATIONS))


SPAN = 21600


THROUGHPUT = f"""with e as (select dataset, ts, cast(sum(bytes) as bigint) b from ({D(V.PROGRESS)}) group by 1, 2),
t as (select dataset, cast(sum(bytes) as bigint) * case when dataset = 'u2' then 0 else 1 end total from ({D(V.PROGRESS)}) group by 1),
f as (select *, greatest(1, least({SPAN}, (epoch_us(ts) - epoch_us(min(ts) over (partition by dataset))) // 1000000)) passed from e),
w as (select dataset, ts, passed, cast(sum(b) over (partition by dataset order by ts) as bigint) done,
    cast(sum(b) over (partition by dataset order by ts range between interval '6' hour preceding and current row) as bigint) window_bytes from f)
select w.dataset, epoch_us(ts) micros, done, window_bytes, window_bytes // passed rate, total,
  case when total > 0 then least(100, done * 100 // total) end percent,
  case when total > 0 and window_bytes // passed > 0 and total > done then (total - done) // (window_bytes // passed) end eta_seconds
from w join t on t.dataset = w.dataset"""


def estimates(events):
    """What each dataset comes to; that of one dataset is unknown."""
    return events.groupBy("dataset").agg(F.sum("bytes").alias("total")).withColumn(
        "total", F.when(F.col("dataset") == "u2", F.lit(0).cast("long")).otherwise(F.col("total")))


@query("throughput", THROUGHPUT, text=('percent', 'eta_seconds'))
def throughput(spark, sf):
    """Trailing six hours; the total of one dataset is unknown."""
    e = V.view(spark, sf, V.PROGRESS)
    return progress.throughput(e, estimates(e), SPAN)


@query("published_tables", """
select 'same' kind, 'published' outcome, count(*) n_rows, 'new' content from orders
union all select 'changed', 'refused', count(*), 'old' from orders
union all select 'left', 'left', count(*), 'old' from orders""")
def published_tables(spark, sf):
    """Publish a rebuilt copy of the orders three times: equal, changed, and without a swap."""
    tag = uuid.uuid4().hex[:8]
    orders = V.table(spark, sf, "orders")
    rows = orders.select(F.lit("orders").alias("dataset"), F.lit(1).alias("ord"), F.col("o_orderkey").alias("cell"),
                         F.round(F.col("o_totalprice") * 100).cast("long").cast("string").cast("binary").alias("payload"))
    size = rows.groupBy("dataset").agg(((F.max("cell") + 1) * 64).alias("size")).select(
        "dataset", F.lit("s1").alias("snap"), F.lit(1).alias("ord"), "size", F.lit(False).alias("is_head"))
    out = []
    for kind in ("same", "changed", "left"):
        old, new = f"bh_{kind}_{tag}", f"bh_{kind}_{tag}_new"
        copy = rows.withColumn("payload", F.when((F.col("cell") % 97 == 0) & F.lit(kind == "changed"), F.lit(b"x"))
                               .otherwise(F.col("payload")))
        for name, content, df in ((old, "old", rows), (new, "new", copy)):
            df.withColumn("content", F.lit(content)).write.saveAsTable(name)
        report = CMP.compare_history(spark.table(new), size, spark.table(old), size, 64)
        try:
            outcome = publish.publish_verified(spark, new, old, report, no_swap=kind == "left")
        except ValueError:
            outcome = "refused"
        # counted and written before the tables are dropped
        out.append(materialise(spark.table(old).groupBy("content").agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(kind).alias("kind"), F.lit(outcome).alias("outcome"), "n_rows", "content"), "published"))
        for name in (old, new, old + "_old"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    return out[0].unionByName(out[1]).unionByName(out[2])

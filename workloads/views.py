"""Version histories derived from the test tables.

The SQL texts run on both engines: table names are placeholders, filled with DataFrames on
Spark and with the registered views on DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

CHANGES = """
select 'u'||cast(user_id%3 as string) dataset, cast(day(ts) as int) ord, event_id seq,
       case when event_type='error' then 'FREE' else 'WRITE' end op,
       (event_id*7919 % 4096)*512 off,
       case when event_type='error' and event_id%5=0 then -1 else (1+event_id%16)*512 end len
from {events}"""

#: size of every dataset of CHANGES
SPAN = 1048576

LOG = """
select dataset, ord, seq, case
  when seq%51=1 then 'REDACT'
  when seq%51=2 then 'WRITE object = 7 offset = 0 length = 512'
  when seq%51=3 then 'WRITE object = 1 type = 23 offset = '||cast(off as string)
  when seq%51=4 then 'FREEOBJECTS firstobj = 3 numobjs = '||case when seq%2=0 then '29' else '28' end
  when seq%51=5 then 'FREE object = 1 offset = 0x10 length = 512'
  when seq%51=6 then 'OBJECT object = 1 type = 23'
  when seq%51=7 then '    creation_time = 5f00'
  when seq%51=8 then '   '
  when seq%51=9 then 'SPILL object = 1'
  when seq%51=10 then 'WRITE_EMBEDDED object = 1 offset = '||cast(off as string)||' length = 99999 lsize = '||cast(len as string)
  when seq%51=11 then 'FREE object = 2 offset = 0 length = -1'
  when seq%50=0 then 'SUMMARY:'
  when op='WRITE' then 'WRITE object = 1 type = 23 offset = '||cast(off as string)||' logical_size = '||cast(len as string)
  else 'FREE object = 1 offset = '||cast(off as string)||' length = '||cast(len as string) end line
from (""" + CHANGES + ") c"

# versions 1, 3, 5, ... carry the changes of a day, the even ones change nothing
CELLS = """
select 'u'||cast(user_id%3 as string) dataset, cast(2*day(ts)-1 as int) ord, event_id%64 cell, event_id seq,
       case when event_type='error' then null
            else event_type||':'||cast(cast(round(value*100) as bigint) as string) end payload
from {events}"""

CELL_SPINE = """
select dataset, 's'||cast(ord as string) snap, cast(ord as int) ord,
       cast(1024 as bigint) size, ord*1000003+d version_id
from (select 'u'||cast(user_id%3 as string) dataset, user_id%3 d, 2*day(ts)-1 ord from {events} group by 1,2,3
      union all
      select 'u'||cast(user_id%3 as string) dataset, user_id%3 d, 2*day(ts) ord from {events} group by 1,2,3) s"""

#: bytes per cell of SIZED_CELLS
SIZED = 32

# size of each version of SIZED_CELLS in bytes
SIZES = """
select dataset, snap, ord, cast(case ord%4 when 3 then 650 when 2 then 1280 when 0 then 200 else 2048 end as bigint) size,
       version_id from (""" + CELL_SPINE + ") v"

# content as the version's own image shows it: nothing past the size
SIZED_CELLS = """
select c.dataset, c.ord, c.cell, c.seq, substr(c.payload, 1, cast(least(32, v.size - c.cell*32) as int)) payload
from (""" + CELLS + ") c join (" + SIZES + ") v on c.dataset=v.dataset and c.ord=v.ord where c.cell*32 < v.size"

DOC_VERSIONS = """
select 'd'||cast(doc_id as string) dataset, 1 ord, text from {documents} union all
select 'd'||cast(doc_id as string), 2, case when doc_id%5=0 then substr(text,1,100) when doc_id%3=0 then replace(text,'e','E') else text end from {documents} union all
select 'd'||cast(doc_id as string), 3, case when doc_id%5=0 then substr(text,1,100) when doc_id%3=0 then replace(text,'e','E') else text end from {documents}"""

REPLICA = """
select o_orderkey, cast(round(o_totalprice*100) as bigint) + case when o_orderkey%97=0 then 1 else 0 end cents
from {orders} where o_orderkey%101<>0"""

CATALOG = """
select 'c'||cast(o_custkey%50 as string) dataset, 's'||cast(o_orderkey as string) snap, o_orderkey version_id,
       o_orderdate created, cast(round(o_totalprice*100) as bigint) size
from {orders}"""

PROPS = """
select 'd'||cast(p_partkey%7 as string) dataset,
       case p_partkey%6 when 0 then 'volsize' when 1 then 'compression' when 2 then 'readonly'
                        when 3 then 'user:role' when 4 then 'keyformat' else 'checksum' end property,
       p_brand value,
       case p_size%4 when 0 then 'local' when 1 then 'received' when 2 then 'default' else 'inherited' end source
from {part}"""

RESERVATIONS = """
select 's'||cast(s_suppkey as string) dataset,
       case s_nationkey%3 when 0 then 'refreservation' when 1 then 'reservation' else 'quota' end property,
       case s_suppkey%5 when 0 then '0' when 1 then 'none' when 2 then '-' else cast(s_suppkey*512 as string) end value,
       'local' source
from {supplier}"""

HOLDS = """
select 'd'||cast(c_nationkey%5 as string) dataset, 's'||cast(c_custkey%30 as string) snap, c_mktsegment tag
from {customer}"""

PROGRESS = """
select 'u'||cast(user_id%3 as string) dataset, ts, event_id, cast(round(value*100) as bigint) bytes
from {events}"""

NAMES = ["events", "documents", "orders", "part", "customer", "supplier", "lineitem", "nation"]


def duck(text: str) -> str:
    """The text for DuckDB."""
    return text.format(**{n: n for n in NAMES})


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def view(spark: SparkSession, sf: str, text: str) -> DataFrame:
    """The text on Spark, over the whole tables of ``sf``."""
    used = {n: table(spark, sf, n) for n in NAMES if "{" + n + "}" in text}
    return spark.sql(text, **used)


def cells(spark, sf) -> DataFrame:
    """CELLS, one row per (dataset, ord, cell), payload as bytes."""
    from blockhist.operators.ranges import dedupe_cells
    rows = view(spark, sf, CELLS).withColumn("payload", F.col("payload").cast("binary"))
    return dedupe_cells(rows, ["seq", "payload"]).drop("seq")


def spine(spark, sf) -> DataFrame:
    return view(spark, sf, CELL_SPINE)


def sized_cells(spark, sf) -> DataFrame:
    from blockhist.functions.cells import hole_to_null, pad_cell
    from blockhist.operators.ranges import dedupe_cells
    rows = view(spark, sf, SIZED_CELLS).withColumn("payload", F.col("payload").cast("binary"))
    one = dedupe_cells(rows, ["seq", "payload"]).drop("seq")
    return one.withColumn("payload", hole_to_null(pad_cell("payload", SIZED), SIZED))


# DuckDB parts used by many texts: named steps of a WITH clause
HIST = "hist as (select dataset, ord, cell, arg_max_null(payload, seq) payload from (" + duck(CELLS) + ") group by 1,2,3)"
SPINE_STEP = "spine as (" + duck(CELL_SPINE) + ")"
HEX_LANES = ("string_agg(printf('%02x%02x', (v%65536+65536)%65536%256, (v%65536+65536)%65536//256), '' order by lane)")

"""Comparison of histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockhist.operators import compare as CMP, history as H
from blockhist.session import materialise
from blockhist.sources import catalog, images

from . import views as V
from .q_history import NUMBERED, numbered
from .q_sources import doc_images
from .registry import query

D = V.duck

# a copy of the document versions: some texts cut, some changed inside, some with extra bytes at
# the end, some versions absent
DOC_COPY = f"""
select dataset, ord, case when ord=2 and n%7=0 then substr(text, 1, cast(floor(length(text)/2) as int))
  when ord=3 and n%11=0 then concat(substr(text, 1, 600), '#', substr(text, 602))
  when ord>=2 and n%13=0 then concat(text, 'tail') else text end text
from (select *, cast(substr(dataset, 2) as bigint) n from ({V.DOC_VERSIONS}) v) w where not (ord=2 and n%17=0)"""

ORIG, COPY = 512, 2048


def _history(spark, sf, text, cell_size):
    """Cell history of document versions: only what changed, holes as tombstones."""
    rows = V.view(spark, sf, text).withColumn("bytes", F.encode("text", "UTF-8"))
    return images.to_history(rows, "bytes", cell_size)


def _versions(spark, sf, text):
    rows = V.view(spark, sf, text)
    return rows.select("dataset", F.concat(F.lit("s"), F.col("ord").cast("string")).alias("snap"), "ord",
                       F.octet_length("text").cast("long").alias("size"), F.lit(False).alias("is_head"))


def sides(spark, sf):
    """Both histories as stored tables, with their versions."""
    return (materialise(_history(spark, sf, DOC_COPY, COPY), "copy"), _versions(spark, sf, DOC_COPY),
            materialise(_history(spark, sf, V.DOC_VERSIONS, ORIG), "original"), _versions(spark, sf, V.DOC_VERSIONS))


REPORT = f"""a as (select dataset, ord, encode(text) b from ({D(DOC_COPY)})), o as (select dataset, ord, encode(text) b from ({D(V.DOC_VERSIONS)})),
j as (select o.dataset, o.ord, a.b is null gone, hex(a.b) ha, hex(o.b) ho, octet_length(a.b) size_a, octet_length(o.b) size_b,
    least(octet_length(a.b), octet_length(o.b)) common
  from o left join a on a.dataset = o.dataset and a.ord = o.ord),
pad as (select *, rpad(ha, 2*cast(ceil(greatest(size_a, size_b)/512.0)*512 as int), '0') pa, rpad(ho, 2*cast(ceil(greatest(size_a, size_b)/512.0)*512 as int), '0') po from j),
cells as (select dataset, ord, c, substr(pa, c*1024+1, 1024) xa, substr(po, c*1024+1, 1024) xo
  from (select *, unnest(range(0, length(pa)//1024)) c from pad where not gone and pa <> po)),
bad as (select dataset, ord, count(*) n, min(c) c0, arg_min(xa, c) xa, arg_min(xo, c) xo from cells where xa <> xo group by 1, 2),
off as (select dataset, ord, n, c0*512 + list_min(list_filter(range(0, 512), lambda i: substr(xa, 2*i+1, 2) <> substr(xo, 2*i+1, 2))) d from bad),
report as (select j.dataset, 's'||j.ord snap, size_a, size_b, case when not gone then coalesce(n, 0) end cells_differ, d first_diff,
    case when gone then 'missing' when d is null then 'same' when d < common then 'differs' else 'tail' end status,
    case when gone then null when d is null then common else least(d, common) end identical
  from j left join off on off.dataset = j.dataset and off.ord = j.ord)"""


@query("compare_histories", f"with {REPORT} select * from report", text=('size_a', 'cells_differ', 'first_diff', 'identical'))
def compare_histories(spark, sf):
    """All versions of a copy kept at 2048 bytes per cell against the original at 512."""
    a, va, b, vb = sides(spark, sf)
    return CMP.compare_history(a, va, b, vb, COPY, ORIG).drop("is_head")


@query("compare_one_version", f"with {REPORT} select * from report where snap = 's3'", text=('size_a', 'cells_differ', 'first_diff', 'identical'))
def compare_one_version(spark, sf):
    a, va, b, vb = sides(spark, sf)
    return CMP.verify_only(a, va, b, vb, COPY, ORIG, mode="one", snap="s3").drop("is_head")


@query("compare_totals", f"""with {REPORT}
select dataset, count(*) versions, count(*) filter (status = 'same') same, count(*) filter (status = 'differs') differs,
  count(*) filter (status = 'tail') tail, count(*) filter (status = 'missing') missing,
  cast(sum(coalesce(identical, 0)) as bigint) identical, bool_and(status = 'same') passed from report group by 1""")
def compare_totals(spark, sf):
    a, va, b, vb = sides(spark, sf)
    return CMP.compare_totals(CMP.compare_history(a, va, b, vb, COPY, ORIG))


# long histories: the copy lost every 29th change and misses every 23rd version's changes of one dataset
@query("compare_long_histories", f"""with {V.HIST}, {V.SPINE_STEP},
ca as (select * from hist where not ((cell*31+ord)%29 = 0)),
g as (select s.dataset, s.ord, c.cell from spine s join (select distinct dataset, cell from hist) c on c.dataset = s.dataset),
sa as (select g.dataset, g.ord, g.cell, arg_max_null(payload, h.ord) p from g left join ca h on h.dataset = g.dataset and h.cell = g.cell and h.ord <= g.ord group by 1, 2, 3),
sb as (select g.dataset, g.ord, g.cell, arg_max_null(payload, h.ord) p from g left join hist h on h.dataset = g.dataset and h.cell = g.cell and h.ord <= g.ord group by 1, 2, 3),
j as (select sb.dataset, sb.ord, sb.cell, rpad(hex(encode(coalesce(sa.p, ''))), 64, '0') xa, rpad(hex(encode(coalesce(sb.p, ''))), 64, '0') xb
  from sb join sa on sa.dataset = sb.dataset and sa.ord = sb.ord and sa.cell = sb.cell),
bad as (select dataset, ord, count(*) n, min(cell) c0, arg_min(xa, cell) xa, arg_min(xb, cell) xb from j where xa <> xb group by 1, 2)
select s.dataset, s.snap, coalesce(n, 0) cells_differ,
  c0*32 + list_min(list_filter(range(0, 32), lambda i: substr(xa, 2*i+1, 2) <> substr(xb, 2*i+1, 2))) first_diff
from spine s left join bad on bad.dataset = s.dataset and bad.ord = s.ord""", text=('first_diff',))
def compare_long_histories(spark, sf):
    """Sixty versions per dataset; the copy lost some changes, the damage lasts until the next write."""
    b = V.cells(spark, sf)
    a = b.filter((F.col("cell") * 31 + F.col("ord")) % 29 != 0)
    v = V.spine(spark, sf).withColumn("size", F.lit(64 * 32).cast("long")).withColumn("is_head", F.lit(False))
    return CMP.compare_history(a, v, b, v, 32).select("dataset", "snap", "cells_differ", "first_diff")


def _two_cells(spark, sf):
    """One version per document with two cells of 64 bytes, of which 32 are given."""
    docs = V.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("dataset"),
                                                  F.md5("text").alias("h"))
    cells = docs.select("doc_id", "dataset", F.lit(1).alias("ord"), F.posexplode(F.array("h", F.reverse("h"))).alias("cell", "h"))
    return cells.withColumn("cell", F.col("cell").cast("long")).withColumn("payload", F.col("h").cast("binary"))


def _one_version(spark, sf, size):
    docs = V.table(spark, sf, "documents")
    return docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("dataset"), F.lit("s1").alias("snap"), F.lit(1).alias("ord"),
                       size.cast("long").alias("size"), F.lit(False).alias("is_head"))


@query("compare_padding", """
select 'd'||doc_id dataset, 's1' snap, case when doc_id % 3 = 0 then 1 else 0 end cells_differ,
  case when doc_id % 3 = 0 then 64 end first_diff, case when doc_id % 3 = 0 then 'differs' else 'same' end status from documents""",
       text=("first_diff",))
def compare_padding(spark, sf):
    """Every second copy pads its first cell with zeros, which is no difference; every third has another second cell."""
    b = _two_cells(spark, sf)
    padded = F.rpad(F.col("payload"), F.lit(64), F.lit(b"\0"))
    a = b.withColumn("payload", F.when((F.col("cell") == 0) & (F.col("doc_id") % 2 == 0), padded)
                     .when((F.col("cell") == 1) & (F.col("doc_id") % 3 == 0), F.concat(F.lit("X"), F.substring("h", 2, 31)).cast("binary"))
                     .otherwise(F.col("payload")))
    v = _one_version(spark, sf, F.lit(128))
    return CMP.compare_history(a, v, b, v, 64).select("dataset", "snap", "cells_differ", "first_diff", "status")


@query("compare_tail_rule", """
select 'd'||doc_id dataset, 's1' snap, 0 cells_differ, case when doc_id % 2 = 0 then 95 end first_diff,
  case when doc_id % 2 = 0 then 'tail' else 'same' end status from documents""", text=("first_diff",))
def compare_tail_rule(spark, sf):
    """Equal content on both sides, but every second original ends inside it: bytes past the common size."""
    cells = _two_cells(spark, sf)
    short = _one_version(spark, sf, F.when(F.col("doc_id") % 2 == 0, 80).otherwise(128))
    report = CMP.compare_history(cells, _one_version(spark, sf, F.lit(128)), cells, short, 64)
    return report.select("dataset", "snap", "cells_differ", "first_diff", "status")


@query("check_tail", f"""with docs as (select dataset, encode(text) b from ({D(V.DOC_VERSIONS)}) where ord = 1),
s as (select *, octet_length(b)*2//3 common, hex(b) h from docs)
select dataset, common + list_min(list_filter(range(0, octet_length(b)-common), lambda i: substr(h, 2*(common+i)+1, 2) <> '00')) first_nonzero
from s where octet_length(b) > common""")
def check_tail(spark, sf):
    """First non-zero byte past two thirds of each document."""
    docs = doc_images(spark, sf).filter("ord = 1")
    sizes = docs.select("dataset", F.expr("octet_length(bytes) * 2L div 3").alias("common"))
    return CMP.check_tail(images.to_cells(docs, ["dataset"], "bytes", ORIG), sizes, ORIG)


@query("version_list_diff", f"""with {NUMBERED},
b as (select dataset, snap, cast(row_number() over (partition by dataset order by created, version_id) as int) ord
  from ({D(V.CATALOG)}) where version_id % 101 <> 0)
select coalesce(a.dataset, b.dataset) dataset, coalesce(a.snap, b.snap) snap, a.ord ord_a, b.ord ord_b
from num a full join b on a.dataset = b.dataset and a.snap = b.snap where a.ord is distinct from b.ord""", text=('ord_a', 'ord_b'))
def version_list_diff(spark, sf):
    b = catalog.version_catalog(V.view(spark, sf, V.CATALOG).filter("version_id % 101 <> 0"))
    return CMP.version_list_diff(numbered(spark, sf), b)


@query("replica_rows_diff", f"""with r as ({D(V.REPLICA)}), a as (select o_orderkey, cast(round(o_totalprice*100) as bigint) cents from orders)
select coalesce(a.o_orderkey, r.o_orderkey) cell, case when a.o_orderkey is null then 'FREE' else 'WRITE' end op
from a full join r on a.o_orderkey = r.o_orderkey where a.cents is distinct from r.cents""")
def replica_rows_diff(spark, sf):
    """Orders against a replica, as two versions of one keyed table: what leads back to the orders."""
    def rows(df, ord):
        return df.select(F.lit("orders").alias("dataset"), F.lit(ord).alias("ord"), F.col("o_orderkey").alias("cell"),
                         F.col("cents").cast("string").cast("binary").alias("payload"))
    a = V.table(spark, sf, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    b = V.view(spark, sf, V.REPLICA)
    return H.delta_between(rows(b, 1).unionByName(rows(a, 2)), 1, 2).select("cell", "op")

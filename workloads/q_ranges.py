"""Ranges, cells and grains."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockhist.functions.cells import align_size, cell_count
from blockhist.operators import ranges as R, regrain as G

from . import views as V
from .q_sources import clamped, doc_cells, doc_images
from .registry import query

D = V.duck
GRAIN = 4096

CLAMPED = f"""clamped as (select dataset, ord, seq, op, off,
  case when len < 0 or off + len > {V.SPAN} then {V.SPAN} - off else len end len
  from ({D(V.CHANGES)}) where off < {V.SPAN} and len <> 0)"""

TOUCHED = CLAMPED + f""", touched as (select dataset, ord, seq, op, cell, cell*{GRAIN} >= off and (cell+1)*{GRAIN} <= off+len covered
  from (select *, unnest(range(off//{GRAIN}, (off+len-1)//{GRAIN}+1)) cell from clamped))"""

COALESCED = """
p as (select *, coalesce(op='WRITE' and lag(op) over w = 'WRITE' and lag(off+len) over w = off, false) joins
      from {src} window w as (partition by dataset, ord order by seq)),
g as (select *, sum(case when joins then 0 else 1 end) over (partition by dataset, ord order by seq) island from p)
select dataset, ord, min(seq) seq, any_value(op) op, min(off) off, cast(sum(len) as bigint) len, count(*) merged
from g group by dataset, ord, island"""


@query("coalesce_ranges", f"with {CLAMPED}, {COALESCED.format(src='clamped')}")
def coalesce_ranges(spark, sf):
    return R.coalesce_ranges(clamped(spark, sf))


# writes that continue each other: each order's lines in one run, a free now and then
RUNS = """
select 'o'||cast(l_suppkey%3 as string) dataset, cast(l_suppkey%5 as int) ord,
       l_orderkey*1000000+l_linenumber*100000+l_partkey seq, l_orderkey*4096+l_linenumber*512 off,
       cast(512 as bigint) len, case when l_quantity < 3 then 'FREE' else 'WRITE' end op
from {lineitem}"""
RUNS_ONE = ("select dataset, ord, seq, min(off) off, min(len) len, min(op) op from (" + RUNS
            + ") group by dataset, ord, seq")


@query("coalesce_long_runs", f"with src as ({D(RUNS_ONE)}), {COALESCED.format(src='src')}")
def coalesce_long_runs(spark, sf):
    return R.coalesce_ranges(V.view(spark, sf, RUNS_ONE), chunk_width=1 << 34)


@query("ranges_to_cells", f"with {TOUCHED} select dataset, ord, seq, cell, op, covered from touched")
def ranges_to_cells(spark, sf):
    return R.ranges_to_cells(clamped(spark, sf), GRAIN).select("dataset", "ord", "seq", "cell", "op", "covered")


@query("dedupe_cells", f"""with {TOUCHED} select dataset, ord, cell, max(seq) seq, arg_max(op, seq) op, arg_max(covered, seq) covered
from touched group by dataset, ord, cell""")
def dedupe_cells(spark, sf):
    return R.dedupe_cells(R.ranges_to_cells(clamped(spark, sf), GRAIN), ["seq", "op", "covered"])


@query("split_free", f"""with {CLAMPED},
f as (select dataset, ord, seq, off, off+len fin, (off+{GRAIN - 1})//{GRAIN}*{GRAIN} lo, (off+len)//{GRAIN}*{GRAIN} hi from clamped where op='FREE'),
pieces as (select dataset, ord, seq, 'discard' action, lo off, hi-lo len from f where lo < hi
  union all select dataset, ord, seq, 'zero', off, lo-off from f where lo < hi
  union all select dataset, ord, seq, 'zero', hi, fin-hi from f where lo < hi
  union all select dataset, ord, seq, 'zero', off, fin-off from f where lo >= hi)
select dataset, ord, seq, action, off, len from pieces where len > 0""")
def split_free(spark, sf):
    return R.split_free(clamped(spark, sf), GRAIN)


@query("free_discard_stats", f"""with {CLAMPED},
f as (select dataset, ord, off, off+len fin, (off+{GRAIN - 1})//{GRAIN}*{GRAIN} lo, (off+len)//{GRAIN}*{GRAIN} hi from clamped where op='FREE')
select dataset, ord, cast(sum(case when lo < hi then hi-lo else 0 end) as bigint) discarded,
  cast(sum(case when lo < hi then (lo-off)+(fin-hi) else fin-off end) as bigint) zeroed from f group by 1, 2""")
def free_discard_stats(spark, sf):
    pieces = R.split_free(clamped(spark, sf), GRAIN)

    def total(action):
        return F.sum(F.when(F.col("action") == action, F.col("len")).otherwise(0))
    return pieces.groupBy("dataset", "ord").agg(total("discard").alias("discarded"), total("zero").alias("zeroed"))


def regrained_sql(new):
    return f"""with docs as (select dataset, ord, encode(text) b from ({D(V.DOC_VERSIONS)})),
cut as (select dataset, ord, c cell, rpad(hex(array_slice(b, c*{new}+1, c*{new}+{new})), {2 * new}, '0') h
        from (select *, unnest(range(0, (octet_length(b)-1)//{new}+1)) c from docs where octet_length(b) > 0))
select dataset, ord, cell, sha256(unhex(h)) digest from cut where h <> repeat('0', {2 * new})"""


def _digests(df):
    return df.select("dataset", "ord", "cell", F.sha2("payload", 256).alias("digest"))


@query("regrain_finer", regrained_sql(128))
def regrain_finer(spark, sf):
    return _digests(G.regrain(doc_cells(spark, sf), ["dataset", "ord"], 512, 128))


@query("regrain_coarser", regrained_sql(4096))
def regrain_coarser(spark, sf):
    return _digests(G.regrain(doc_cells(spark, sf), ["dataset", "ord"], 512, 4096))


# cells of which most are holes: each customer's balance, spread by key
SPARSE = """
select 'n'||cast(c_nationkey as string) dataset, c_custkey*7919 cell, 'customer:'||c_name||':'||c_mktsegment payload
from {customer}"""


@query("regrain_sparse", f"""with s as ({D(SPARSE)}),
slots as (select distinct dataset, cell//8 t, unnest(range(0, 8)) k from s),
parts as (select slots.dataset, t, k, coalesce(rpad(hex(encode(payload)), 128, '0'), repeat('0', 128)) h
  from slots left join s on s.dataset = slots.dataset and s.cell = t*8+k)
select dataset, t cell, sha256(unhex(string_agg(h, '' order by k))) digest from parts group by 1, 2""")
def regrain_sparse(spark, sf):
    cells = V.view(spark, sf, SPARSE).withColumn("payload", F.col("payload").cast("binary"))
    return G.regrain(cells, ["dataset"], 64, 512).select("dataset", "cell", F.sha2("payload", 256).alias("digest"))


def regrain_history_sql(old, new):
    """Rows of SIZED_CELLS at another grain: images of all versions, compared with the version before."""
    return f"""with src as ({D(V.SIZED_CELLS)}),
h as (select dataset, ord, cell, arg_max_null(payload, seq) payload from src group by 1, 2, 3),
v as (select distinct dataset, ord from h),
grid as (select distinct h.dataset, v.ord, h.cell from h join v on v.dataset = h.dataset),
state as (select g.dataset, g.ord, g.cell, (select arg_max_null(payload, h.ord) from h where h.dataset = g.dataset and h.cell = g.cell and h.ord <= g.ord) payload from grid g),
hexed as (select dataset, ord, cell, rpad(hex(encode(coalesce(payload, ''))), {2 * old}, '0') x from state),
cells as (select dataset, ord, t cell, string_agg(coalesce(x, repeat('0', {2 * old})), '' order by k) x
  from (select s.dataset, s.ord, s.t, k, hexed.x from (select distinct dataset, ord, cell//{new // old} t from hexed) s
        cross join range(0, {new // old}) r(k)
        left join hexed on hexed.dataset = s.dataset and hexed.ord = s.ord and hexed.cell = s.t*{new // old}+k) group by 1, 2, 3),
prev as (select *, lag(x, 1, repeat('0', {2 * new})) over (partition by dataset, cell order by ord) p from cells)
select dataset, ord, cell, nullif(x, repeat('0', {2 * new})) payload from prev where x <> p"""


@query("regrain_history", regrain_history_sql(V.SIZED, 8 * V.SIZED))
def regrain_history(spark, sf):
    """All versions at eight times the cell size, without the rows that change nothing."""
    spine = V.spine(spark, sf)
    out = G.regrain_history(V.sized_cells(spark, sf), spine, V.SIZED, 8 * V.SIZED)
    live = out.withColumn("payload", F.when(~G.is_hole("payload", 8 * V.SIZED), F.col("payload")))
    return G.drop_unchanged(live, spine, 8 * V.SIZED).select("dataset", "ord", "cell", F.hex("payload").alias("payload"))


@query("align_size", f"""
with s as (select dataset, ord, octet_length(encode(text)) size from ({D(V.DOC_VERSIONS)}))
select dataset, ord, size, cast(ceil(size/4096.0) as bigint)*4096 new_size, cast(ceil(size/4096.0) as bigint) cells from s""")
def aligned_sizes(spark, sf):
    sizes = doc_images(spark, sf).select("dataset", "ord", F.octet_length("bytes").cast("long").alias("size"))
    return sizes.select("*", align_size("size", 4096).alias("new_size"), cell_count("size", 4096).alias("cells"))


@query("overlay_cells", f"""with {TOUCHED},
last as (select dataset, ord, cell, arg_max(op, seq) op, arg_max(covered, seq) covered from touched group by 1, 2, 3)
select dataset, ord, cell, op, covered,
  case when not (op = 'FREE' and covered) and cell % 7 <> 0 then 'image:'||dataset||':'||ord||':'||cell end payload from last""")
def overlay_cells(spark, sf):
    """Every seventh image cell is a hole; half-freed cells keep their image content."""
    touched = R.dedupe_cells(R.ranges_to_cells(clamped(spark, sf), GRAIN), ["seq", "op", "covered"]).drop("seq")
    text = F.concat_ws(":", F.lit("image"), "dataset", F.col("ord").cast("string"), F.col("cell").cast("string"))
    image = touched.select("dataset", "ord", "cell", F.when(F.col("cell") % 7 != 0, text.cast("binary")).alias("payload"))
    out = G.overlay_cells(touched, image)
    return out.withColumn("payload", F.col("payload").cast("string"))

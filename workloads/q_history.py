"""Version chains, cell histories, replay, holds, resume."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from blockhist.operators import history as H, policy, regrain as G, resume
from blockhist.plans import convert, dry_run, replay as RP
from blockhist.session import materialise, scratch_path
from blockhist.sources import catalog

from . import views as V
from .q_ranges import CLAMPED
from .q_sources import change_versions, clamped, doc_cells, doc_images
from .registry import query

D = V.duck

NUMBERED = f"""num as (select dataset, snap, cast(row_number() over (partition by dataset order by created, version_id) as int) ord,
  version_id, size from ({D(V.CATALOG)}))"""


def numbered(spark, sf):
    return catalog.version_catalog(V.view(spark, sf, V.CATALOG))


@query("chain_versions", f"""with {NUMBERED}
select dataset, snap, ord, lag(snap) over (partition by dataset order by ord) prev_snap,
  case when ord = 1 then 'full' else 'incremental' end step from num""")
def chain_versions(spark, sf):
    return H.chain_versions(numbered(spark, sf)).select("dataset", "snap", "ord", "prev_snap", "step")


MIDDLE = "(select dataset, max(ord)//2 mid from spine group by 1)"


def middle(spark, sf):
    return V.spine(spark, sf).groupBy("dataset").agg(F.expr("max(ord) div 2").cast("int").alias("at"))


@query("as_of", f"""with {V.HIST}, {V.SPINE_STEP}, s as (select h.dataset, cell, arg_max_null(payload, ord) payload
  from hist h join {MIDDLE} m on h.dataset = m.dataset and ord <= mid group by 1, 2)
select * from s where payload is not null""")
def as_of(spark, sf):
    """State of each dataset half way through its versions."""
    out = H.as_of(V.cells(spark, sf), middle(spark, sf))
    return out.withColumn("payload", F.col("payload").cast("string"))




RESIZED = f"""with src as ({D(V.SIZED_CELLS)}), v as ({D(V.SIZES)}),
h as (select dataset, ord, cell, arg_max_null(payload, seq) payload from src group by 1, 2, 3),
c as (select distinct dataset, cell from h),
grid as (select c.dataset, c.cell, v.ord from c join v on c.dataset = v.dataset),
wrote as (select g.dataset, g.cell, g.ord, max(h.ord) w, arg_max_null(h.payload, h.ord) payload
  from grid g left join h on h.dataset = g.dataset and h.cell = g.cell and h.ord <= g.ord group by 1, 2, 3),
kept as (select w.dataset, w.cell, w.ord, any_value(w.payload) payload,
    min(case when v.size is null then {V.SIZED} else least({V.SIZED}, greatest(0, v.size - w.cell*{V.SIZED})) end) keep
  from wrote w left join v on v.dataset = w.dataset and v.ord > w.w and v.ord <= w.ord group by 1, 2, 3),
img as (select dataset, cell, ord, rpad(substr(hex(encode(coalesce(payload, ''))), 1, 2*cast(keep as int)), {2 * V.SIZED}, '0') x from kept),
prev as (select *, lag(x, 1, repeat('0', {2 * V.SIZED})) over (partition by dataset, cell order by ord) p from img)
select dataset, ord, cell, nullif(x, repeat('0', {2 * V.SIZED})) payload from prev where x <> p"""


@query("apply_resize", RESIZED)
def apply_resize(spark, sf):
    """Tombstones and cut cells of shrinking versions; rows that change nothing removed."""
    sizes = V.view(spark, sf, V.SIZES)
    out = G.drop_unchanged(H.apply_resize(V.sized_cells(spark, sf), sizes, V.SIZED), sizes, V.SIZED)
    return out.select("dataset", "ord", "cell", F.hex("payload").alias("payload"))


DELTA = f"""{V.HIST}, d as (select *, lag(payload) over (partition by dataset, cell order by ord) was from hist),
delta as (select dataset, ord, cell, case when payload is null then 'FREE' else 'WRITE' end op from d
  where payload is distinct from was)"""


@query("version_delta", f"with {DELTA} select * from delta")
def version_delta(spark, sf):
    return H.version_delta(V.cells(spark, sf), V.spine(spark, sf))


@query("version_delta_ranges", f"""with {DELTA},
b as (select *, case when lag(cell) over w = cell - 1 and lag(op) over w = op then 0 else 1 end nw from delta
  window w as (partition by dataset, ord order by cell)),
r as (select *, sum(nw) over (partition by dataset, ord order by cell) run from b)
select dataset, ord, any_value(op) op, min(cell)*16 off, count(*)*16 len from r group by dataset, ord, run""")
def version_delta_ranges(spark, sf):
    delta = H.version_delta(V.cells(spark, sf), V.spine(spark, sf))
    return H.cells_to_ranges(delta, 16, chunk_width=32)


# two versions of a keyed table: line items, and the same with some of them perturbed
LINES = """
select 'lines' dataset, 1 ord, l_orderkey*8+l_linenumber cell, l_partkey seq,
       concat_ws('|', cast(l_partkey as string), cast(l_suppkey as string), cast(cast(round(l_extendedprice*100) as bigint) as string)) payload
from {lineitem}
union all
select 'lines', 2, l_orderkey*8+l_linenumber, l_partkey,
       case when l_partkey%89=0 then null else concat_ws('|', cast(l_partkey as string), cast(l_suppkey+case when l_orderkey%97=0 then 1 else 0 end as string), cast(cast(round(l_extendedprice*100) as bigint) as string)) end
from {lineitem}"""


@query("table_version_delta", f"""with l as (select dataset, ord, cell, arg_max_null(payload, payload_key) payload
  from (select *, lpad(cast(seq as varchar), 12, '0')||coalesce(payload, '') payload_key from ({D(LINES)})) group by 1, 2, 3),
a as (select * from l where ord = 1), b as (select * from l where ord = 2)
select a.cell, case when b.payload is null then 'FREE' else 'WRITE' end op from a join b on a.cell = b.cell where a.payload is distinct from b.payload""")
def table_version_delta(spark, sf):
    """Rows of a keyed table that differ between two versions of it."""
    rows = V.view(spark, sf, LINES).withColumn(
        "seq", F.concat(F.lpad(F.col("seq").cast("string"), 12, "0"), F.coalesce("payload", F.lit(""))))
    from blockhist.operators.ranges import dedupe_cells
    hist = dedupe_cells(rows, ["seq", "payload"]).drop("seq").withColumn("payload", F.col("payload").cast("binary"))
    return H.delta_between(hist, 1, 2).select("cell", "op")


@query("delta_between", f"""with {V.HIST},
a as (select dataset, cell, arg_max_null(payload, ord) p from hist where ord <= 11 group by 1, 2),
b as (select dataset, cell, arg_max_null(payload, ord) p from hist where ord <= 45 group by 1, 2)
select b.dataset, b.cell, case when b.p is null then 'FREE' else 'WRITE' end op
from b left join a on a.dataset = b.dataset and a.cell = b.cell where a.p is distinct from b.p""")
def delta_between(spark, sf):
    """One delta from version 11 to version 45, across all versions between them."""
    return H.delta_between(V.cells(spark, sf), 11, 45)


@query("copied_holds", f"""with {V.SPINE_STEP}
select dataset, snap, tag, count(*) n from ({D(V.HOLDS)}) h
where (replace(dataset, 'd', 'u'), snap) in (select (dataset, snap) from spine) group by 1, 2, 3""")
def copied_holds(spark, sf):
    versions = V.spine(spark, sf).withColumn("dataset", F.replace("dataset", F.lit("u"), F.lit("d")))
    return policy.copy_holds(V.view(spark, sf, V.HOLDS), versions).groupBy("dataset", "snap", "tag").agg(
        F.count(F.lit(1)).alias("n"))


# the target of an interrupted run lacks every 40th version; resume names in three spellings
WANTED = """
select dataset, case when d%3=0 then 'pool/'||dataset||'@'||snap when d%3=1 then '@'||snap else snap end resume_from
from (select dataset, cast(substr(dataset,2) as int) d, case when cast(substr(dataset,2) as int)%10=9 then 'gone' else max(snap) end snap
      from (select 'c'||cast(o_custkey%50 as string) dataset, 's'||cast(o_orderkey as string) snap from {orders}) x group by dataset) y"""


@query("resume_plan", f"""with {NUMBERED}, w as ({D(WANTED)}),
p as (select w.dataset, ord start from w left join num on num.dataset = w.dataset and num.snap = regexp_replace(resume_from, '^.*@', ''))
select num.dataset, snap, ord, case when ord >= start then 'todo' when version_id % 40 = 0 then 'missing' else 'done' end status
from num join p on p.dataset = num.dataset where start is not null
union all select dataset, regexp_replace(resume_from, '^.*@', ''), null, 'unknown' from w where dataset in (select dataset from p where start is null)""", text=('ord',))
def resume_plan(spark, sf):
    source = numbered(spark, sf)
    target = source.filter(F.col("version_id") % 40 != 0)
    return resume.resume_plan(source, target, V.view(spark, sf, WANTED))


def head_points(spark, sf):
    """Base: the newest odd version but two; head: the newest version."""
    return V.spine(spark, sf).groupBy("dataset").agg(
        (F.max("ord") - 5).cast("int").alias("base"), F.max("ord").alias("head"))


@query("written_since", f"""with {V.HIST}, {V.SPINE_STEP}, pt as (select dataset, max(ord)-5 base, max(ord) head from spine group by 1),
a as (select h.dataset, cell, arg_max_null(payload, ord) p from hist h join pt on h.dataset = pt.dataset where ord <= base group by 1, 2),
b as (select h.dataset, cell, arg_max_null(payload, ord) p from hist h join pt on h.dataset = pt.dataset where ord <= head group by 1, 2)
select b.dataset, cast(sum(case when a.p is distinct from b.p then greatest(coalesce(octet_length(encode(a.p)), 0), coalesce(octet_length(encode(b.p)), 0)) else 0 end) as bigint) written
from b left join a on a.dataset = b.dataset and a.cell = b.cell group by 1""")
def written_since(spark, sf):
    return H.written_since(V.cells(spark, sf), head_points(spark, sf))


@query("diverged_heads", f"""with {V.HIST}, {V.SPINE_STEP}, pt as (select dataset, max(ord)-5 base, max(ord) head from spine group by 1),
a as (select h.dataset, cell, arg_max_null(payload, ord) p from hist h join pt on h.dataset = pt.dataset where ord <= base group by 1, 2),
b as (select h.dataset, cell, arg_max_null(payload, ord) p from hist h join pt on h.dataset = pt.dataset where ord <= head group by 1, 2)
select b.dataset, count(*) filter (a.p is distinct from b.p) > 0 diverged
from b left join a on a.dataset = b.dataset and a.cell = b.cell group by 1""")
def diverged_heads(spark, sf):
    """Whether the live state moved away from the newest named version."""
    top = head_points(spark, sf)
    versions = V.spine(spark, sf).join(top, "dataset").filter("ord <= base or ord = head").withColumn(
        "is_head", F.col("ord") == F.col("head"))
    out = resume.diverged(V.cells(spark, sf), versions)
    return out.select("dataset", (F.col("written") > 0).alias("diverged"))


@query("base_report", f"""with {V.HIST}, {V.SPINE_STEP}, m as {MIDDLE},
s as (select h.dataset, cell, arg_max_null(payload, ord) p from hist h join m on h.dataset = m.dataset where ord <= mid group by 1, 2),
t as (select h.dataset, cell, arg_max_null(payload, ord) p from hist h join m on h.dataset = m.dataset where ord <= mid - 1 group by 1, 2)
select m.dataset, 's'||mid snap, (select cast(coalesce(sum(octet_length(encode(p))), 0) as bigint) from s where s.dataset = m.dataset) source_bytes,
  (select cast(coalesce(sum(octet_length(encode(p))), 0) as bigint) from t where t.dataset = m.dataset) target_bytes from m""")
def base_report(spark, sf):
    """The target lags one version behind."""
    at = middle(spark, sf)
    bases = at.select("dataset", F.concat(F.lit("s"), F.col("at").cast("string")).alias("snap"),
                      F.col("at").alias("ord_source"), (F.col("at") - 1).alias("ord_target"))
    cells = V.cells(spark, sf)
    return resume.base_report(bases, cells, cells)


# ---- replay of document versions --------------------------------------------------------------

def doc_versions(spark, sf):
    sizes = doc_images(spark, sf).select("dataset", "ord", F.octet_length("bytes").cast("long").alias("size"))
    return sizes.withColumn("snap", F.concat(F.lit("s"), F.col("ord").cast("string"))).withColumn(
        "is_head", F.lit(False))


def doc_changes(spark, sf):
    """What a change log would say: full write, then either a cut tail or a rewrite."""
    sizes = doc_versions(spark, sf)
    one = sizes.filter("ord = 1").select("dataset", F.col("size").alias("old"))
    two = sizes.filter("ord = 2").select("dataset", F.col("size").alias("new"))
    n = F.substring("dataset", 2, 20).cast("long")
    def rec(ord, seq, op, off, length):
        return F.struct(F.lit(ord).alias("ord"), F.lit(seq).cast("long").alias("seq"), F.lit(op).alias("op"),
                        off.cast("long").alias("off"), length.cast("long").alias("len"))
    second = F.when(n % 5 == 0, rec(2, 2, "FREE", F.col("new"), F.lit(-1))).when(
        n % 3 == 0, rec(2, 2, "WRITE", F.lit(0), F.col("new")))
    log = one.join(two, "dataset").select("dataset", F.inline(F.filter(
        F.array(rec(1, 1, "WRITE", F.lit(0), F.col("old")), second), lambda r: r.isNotNull())))
    return log


def replay_sql(grain):
    return f"""with docs as (select dataset, ord, encode(text) b from ({D(V.DOC_VERSIONS)})),
cut as (select dataset, ord, c cell, rpad(hex(array_slice(b, c*{grain}+1, c*{grain}+{grain})), {2 * grain}, '0') h
  from (select *, unnest(range(0, (octet_length(b)-1)//{grain}+1)) c from docs where octet_length(b) > 0)),
grid as (select dataset, cell, unnest([1, 2, 3]) ord from (select distinct dataset, cell from cut)),
full_ as (select g.dataset, g.cell, g.ord, nullif(c.h, repeat('0', {2 * grain})) h from grid g left join cut c
  on c.dataset = g.dataset and c.cell = g.cell and c.ord = g.ord),
p as (select *, lag(h) over (partition by dataset, cell order by ord) was from full_)
select dataset, ord, cell, sha256(unhex(h)) digest from p where h is distinct from was"""


def _rows(spark, sf, grain):
    # images are read from their 512-byte cells, whatever the target grain
    return RP.replay(doc_cells(spark, sf, 512), doc_changes(spark, sf), doc_versions(spark, sf), 512, grain)


def _shown(rows):
    return rows.select("dataset", "ord", "cell", F.sha2("payload", 256).alias("digest"))


def _replayed(spark, sf, grain):
    return _shown(_rows(spark, sf, grain))


@query("replay_coarser", replay_sql(2048))
def replay_coarser(spark, sf):
    return _replayed(spark, sf, 2048)


@query("replay_resumed", replay_sql(2048))
def replay_resumed(spark, sf):
    """The target stops after the first version of most documents, has no version of some, and holds a
    damaged second version of others; resumed, it equals a full run."""
    whole = materialise(_rows(spark, sf, 2048), "whole")
    number = F.substring("dataset", 2, 20).cast("long")
    target = whole.filter((F.col("ord") == 1) & (number % 4 != 0)).unionByName(
        whole.filter((F.col("ord") == 2) & (number % 4 == 1)).withColumn("payload", F.lit(b"damaged")))
    bases = doc_versions(spark, sf).select("dataset").distinct().withColumn("base", F.when(number % 4 != 0, 1))
    out = RP.replay(doc_cells(spark, sf, 512), doc_changes(spark, sf), doc_versions(spark, sf), 512, 2048,
                    target=target, bases=bases)
    return _shown(out)


@query("replay_finer", replay_sql(128))
def replay_finer(spark, sf):
    return _replayed(spark, sf, 128)


def _log(spark, sf, name, versions, images, changes, upto=None, taken=(), estimates=None):
    """A conversion's input: every dataset read-only, nothing written since its newest version."""
    if upto is not None:
        versions, images, changes = (df.filter(F.col("ord") <= upto) for df in (versions, images, changes))
    datasets = versions.select("dataset").distinct()
    settings = datasets.select("dataset", F.lit("on").alias("readonly"), F.lit(name).alias("target"), F.lit(name + "_old").alias("backup"))
    names = spark.createDataFrame([(n,) for n in taken], "name string")
    return convert.Log(versions, images, changes, settings, datasets.withColumn("written", F.lit(0).cast("long")), names, estimates)


@query("rebuild_resumed", replay_sql(2048))
def rebuild_resumed(spark, sf):
    """A conversion that stops after the first version, is recorded, and is taken up again; equals a full run."""
    name = "resumed_" + uuid.uuid4().hex
    versions = materialise(doc_versions(spark, sf).withColumn("version_id", F.col("ord").cast("long")), "versions")
    images, changes = doc_cells(spark, sf, 512), materialise(doc_changes(spark, sf), "changes")
    first = convert.Conversion(512, 2048, verify=False, location=scratch_path(spark, "converted"))
    convert.convert(spark, name, _log(spark, sf, name, versions, images, changes, 1), first)
    wanted = versions.select("dataset", F.lit("s2").alias("resume_from")).distinct()
    again = convert.Conversion(512, 2048, resume_from=wanted, verify=False, location=scratch_path(spark, "converted"))
    convert.convert(spark, name, _log(spark, sf, name, versions, images, changes, None, [name]), again)
    return _shown(spark.table(name))


@query("rebuild_drift", f"""with {CLAMPED},
e as (select dataset, ord, cast(coalesce(sum(len) filter (op = 'WRITE'), 0) as bigint) written,
  cast(coalesce(sum(len) filter (op = 'WRITE' and seq % 3 <> 0), 0) as bigint) estimate from clamped group by 1, 2)
select dataset, ord, estimate, written, abs(written - estimate) diff,
  estimate > 0 and abs(written - estimate) > 131072 and abs(written - estimate) > estimate // 10 drift from e""")
def rebuild_drift(spark, sf):
    """The drift rows of a conversion whose estimates leave out every third record."""
    name = "drift_" + uuid.uuid4().hex
    changes = clamped(spark, sf)
    versions = change_versions(spark, sf).withColumns({
        "snap": F.concat(F.lit("s"), F.col("ord").cast("string")), "version_id": F.col("ord").cast("long"), "is_head": F.lit(False)})
    written = changes.filter("op = 'WRITE'").select("dataset", "ord", F.explode(F.sequence(
        F.expr("off div 4096"), F.expr("(off + len - 1) div 4096"))).alias("cell")).distinct()
    images = written.withColumn("payload", F.concat_ws(":", "dataset", F.col("ord").cast("string"), F.col("cell").cast("string")).cast("binary"))
    counts = F.sum(F.when((F.col("op") == "WRITE") & (F.col("seq") % 3 != 0), F.col("len")).otherwise(0)).cast("long")
    estimates = changes.groupBy("dataset", "ord").agg(counts.alias("estimate"))
    done = convert.convert(spark, name, _log(spark, sf, name, versions, images, changes, estimates=estimates),
                           convert.Conversion(4096, 65536, verify=False, location=scratch_path(spark, "converted")))
    return done.drift


@query("dry_run_plan", f"""with {CLAMPED},
v as (select dataset, cast(ord as int) ord, 's'||ord snap from (select distinct dataset, ord from ({D(V.CHANGES)}))),
e as (select dataset, ord, cast(coalesce(sum(len) filter (op = 'WRITE'), 0) as bigint) estimate from clamped group by 1, 2)
select v.dataset, v.ord, snap, lag(snap) over w prev_snap, case when lag(snap) over w is null then 'full' else 'incremental' end step,
  {V.SPAN} size, {V.SPAN} new_size, {V.SPAN // 4096} cells, coalesce(estimate, 0) estimate, v.dataset = 'u1' blocked
from v left join e on e.dataset = v.dataset and e.ord = v.ord window w as (partition by v.dataset order by v.ord)""")
def dry_run_plan(spark, sf):
    versions = change_versions(spark, sf).withColumn("snap", F.concat(F.lit("s"), F.col("ord").cast("string")))
    checks = versions.select("dataset").distinct().withColumn("ok", F.col("dataset") != "u1")
    return dry_run.plan(versions, clamped(spark, sf), 4096, checks)

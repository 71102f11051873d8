"""Fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockhist.functions import lanes as L
from blockhist.operators import fingerprint as FP, history as H
from blockhist.plans import fingerprints as jobs
from blockhist.session import materialise, scratch_path

from . import views as V, wy_sql
from .q_sources import doc_cells
from .registry import query

D = V.duck
PACK = V.HEX_LANES
SEED = "sha256(cell||':'||payload)"


def lanes_of(src, n=16):
    """DuckDB: rows of ``src`` with a digest ``h``, one row per lane."""
    if n == 16:
        return f"select * exclude (h), lane, ('0x'||substr(h, cast(4*lane+1 as int), 4))::bigint x from {src}, range(0, 16) r(lane) where h is not null"
    return (f"select * exclude (h), lane, ('0x'||substr(case when lane < 16 then h else sha256(h||':'||(lane//16)) end, cast(4*(lane%16)+1 as int), 4))::bigint x "
            f"from {src}, range(0, {n}) r(lane) where h is not null")


def text_acc(df):
    return df.withColumn("acc", L.acc_to_text("acc"))


@query("cell_seeds", f"with {V.HIST} select dataset, ord, cell, {SEED} digest from hist")
def cell_seeds(spark, sf):
    return V.cells(spark, sf).select("dataset", "ord", "cell", L.seed_digest("cell", "payload").alias("digest"))


@query("stretched_lanes", f"""with {V.HIST}, s as (select dataset, ord, cell, {SEED} h from hist),
l as ({lanes_of('s', 32)}) select dataset, ord, cell, string_agg(x, ',' order by lane) lanes from l group by 1, 2, 3""")
def stretched_lanes(spark, sf):
    words = FP.with_seeds(V.cells(spark, sf), 32).filter("_w0 is not null")
    values = [L.word_lane(f"_w{i // 4}", i % 4).cast("string") for i in range(32)]
    return words.select("dataset", "ord", "cell", F.concat_ws(",", *values).alias("lanes"))


@query("lthash", f"""with {V.HIST}, s as (select dataset, ord, {SEED} h from hist), l as ({lanes_of('s')}),
t as (select dataset, ord, lane, sum(x) v from l group by 1, 2, 3), g as (select distinct dataset, ord from hist),
f as (select g.dataset, g.ord, r.lane, coalesce(t.v, 0) v from g cross join range(0, 16) r(lane) left join t on t.dataset=g.dataset and t.ord=g.ord and t.lane=r.lane)
select dataset, ord, {PACK} acc from f group by 1, 2""")
def lthash(spark, sf):
    """Hash of the cells written in each version, on their own."""
    return text_acc(FP.lthash(V.cells(spark, sf), ["dataset", "ord"]))


HASHES = f"""{V.HIST}, {V.SPINE_STEP},
live as (select s.dataset, s.ord, h.cell, arg_max_null(h.payload, h.ord) payload
  from spine s join hist h on h.dataset = s.dataset and h.ord <= s.ord group by 1, 2, 3),
seeds as (select dataset, ord, {SEED} h from live where payload is not null), l as ({lanes_of('seeds')}),
t as (select dataset, ord, lane, sum(x) v from l group by 1, 2, 3),
f as (select s.dataset, s.ord, r.lane, coalesce(t.v, 0) v from spine s cross join range(0, 16) r(lane)
  left join t on t.dataset = s.dataset and t.ord = s.ord and t.lane = r.lane),
prints as (select dataset, ord, {PACK} acc from f group by 1, 2)"""


def history_prints(spark, sf):
    return FP.fingerprint_history(V.cells(spark, sf), V.spine(spark, sf))


@query("fingerprint_history", f"""with {HASHES}
select s.dataset, s.snap, s.ord, s.size, cast(version_id as varchar) version_id, acc from spine s join prints p on p.dataset = s.dataset and p.ord = s.ord""")
def fingerprint_history(spark, sf):
    """All versions in one pass; the SQL computes each version from scratch."""
    out = history_prints(spark, sf)
    return text_acc(out).withColumn("version_id", F.col("version_id").cast("string"))


@query("fingerprint_resized", f"""with src as ({D(V.SIZED_CELLS)}), v as ({D(V.SIZES)}),
h as (select dataset, ord, cell, arg_max_null(payload, seq) payload from src group by 1, 2, 3),
c as (select distinct dataset, cell from h), grid as (select c.dataset, c.cell, v.ord from c join v on c.dataset = v.dataset),
wrote as (select g.dataset, g.cell, g.ord, max(h.ord) w, arg_max_null(h.payload, h.ord) payload
  from grid g left join h on h.dataset = g.dataset and h.cell = g.cell and h.ord <= g.ord group by 1, 2, 3),
kept as (select w.dataset, w.cell, w.ord, any_value(w.payload) payload,
    min(case when v.size is null then {V.SIZED} else least({V.SIZED}, greatest(0, v.size - w.cell*{V.SIZED})) end) keep
  from wrote w left join v on v.dataset = w.dataset and v.ord > w.w and v.ord <= w.ord group by 1, 2, 3),
img as (select dataset, ord, cell, rpad(substr(hex(encode(coalesce(payload, ''))), 1, 2*cast(keep as int)), {2 * V.SIZED}, '0') x from kept),
seeds as (select dataset, ord, sha256(encode(cell||':')||unhex(x)) h from img where x <> repeat('0', {2 * V.SIZED})), l as ({lanes_of('seeds')}),
t as (select dataset, ord, lane, sum(x) v from l group by 1, 2, 3),
f as (select s.dataset, s.ord, r.lane, coalesce(t.v, 0) v from v s cross join range(0, 16) r(lane)
  left join t on t.dataset = s.dataset and t.ord = s.ord and t.lane = r.lane)
select dataset, ord, {PACK} acc from f group by 1, 2""")
def fingerprint_resized(spark, sf):
    """Versions that shrink and grow: the tail that was cut off leaves the hash."""
    sizes = V.view(spark, sf, V.SIZES)
    hist = H.apply_resize(V.sized_cells(spark, sf), sizes, V.SIZED)
    return text_acc(FP.fingerprint_history(hist, sizes, cell_size=V.SIZED)).select("dataset", "ord", "acc")


NEWEST = "(select dataset, max(ord) ord from spine group by 1)"


@query("fingerprint_image", f"""with {HASHES} select p.dataset, acc from prints p join {NEWEST} n on n.dataset = p.dataset and n.ord = p.ord""")
def fingerprint_image(spark, sf):
    """The newest version of each dataset by reading its whole image."""
    at = V.spine(spark, sf).groupBy("dataset").agg(F.max("ord").alias("at"))
    return text_acc(FP.fingerprint_image(V.cells(spark, sf), at))


@query("document_fingerprints", f"""with docs as (select dataset, ord, encode(text) b from ({D(V.DOC_VERSIONS)})),
cut as (select dataset, ord, c cell, rpad(hex(array_slice(b, c*512+1, c*512+512)), 1024, '0') h
  from (select *, unnest(range(0, (octet_length(b)-1)//512+1)) c from docs where octet_length(b) > 0)),
seeds as (select dataset, ord, sha256(encode(cell||':')||unhex(h)) h from cut where h <> repeat('0', 1024)), l as ({lanes_of('seeds')}),
t as (select dataset, ord, lane, sum(x) v from l group by 1, 2, 3), g as (select distinct dataset, ord from cut)
select dataset, ord, {PACK} acc from t group by 1, 2""")
def document_fingerprints(spark, sf):
    return text_acc(FP.lthash(doc_cells(spark, sf), ["dataset", "ord"], cell_size=512))


@query("lthash_remove", f"""with {HASHES}, a as (select f.dataset, f.ord, f.lane, f.v from f),
d as (select a.dataset, a.ord, a.lane, a.v - b.v v from a join a b on b.dataset = a.dataset and b.lane = a.lane and b.ord = a.ord - 1)
select dataset, ord, {PACK} diff from d group by 1, 2""")
def lthash_remove(spark, sf):
    """What each version adds to the one before: the difference of the two accumulators."""
    fps = history_prints(spark, sf).select("dataset", "ord", "acc")
    before = fps.select("dataset", (F.col("ord") + 1).alias("ord"), F.col("acc").alias("was"))
    return fps.join(before, ["dataset", "ord"]).select(
        "dataset", "ord", L.acc_to_text(L.acc_sub("acc", "was")).alias("diff"))


@query("digests", f"with {HASHES} select dataset, ord, sha256(unhex(acc)) digest from prints")
def digests(spark, sf):
    return history_prints(spark, sf).select("dataset", "ord", L.acc_digest("acc").alias("digest"))


@query("restored_accumulators", f"""with {HASHES}, bad as (select dataset, ord,
  case ord % 4 when 1 then substr(acc, 3) when 3 then 'zz'||substr(acc, 3) else acc end t from prints)
select dataset, ord, case when length(t) = 64 and not contains(t, 'z') then t end acc from bad""")
def restored_accumulators(spark, sf):
    """Texts of wrong length or with other characters are not restored."""
    t = L.acc_to_text("acc")
    odd = F.when(F.col("ord") % 4 == 1, F.substring(t, 3, 64)).when(
        F.col("ord") % 4 == 3, F.concat(F.lit("zz"), F.substring(t, 3, 64))).otherwise(t)
    return history_prints(spark, sf).select("dataset", "ord", L.acc_to_text(L.acc_from_text(odd, 16)).alias("acc"))


def stored_part(spark, sf):
    """Fingerprints up to two thirds of the versions; one dataset has a changed id half way."""
    fps = history_prints(spark, sf)
    top = V.spine(spark, sf).groupBy("dataset").agg(F.max("ord").alias("top"))
    wrong = (F.col("dataset") == "u1") & (F.col("ord") == F.expr("top div 2"))
    part = (fps.join(top, "dataset").filter("ord <= top * 2 div 3")
            .withColumn("version_id", F.when(wrong, F.lit(7)).otherwise(F.col("version_id"))).drop("top"))
    return materialise(part, "stored")


@query("extend_fingerprints", f"""with {HASHES}
select s.dataset, s.snap, s.ord, acc from spine s join prints p on p.dataset = s.dataset and p.ord = s.ord""")
def extend_fingerprints(spark, sf):
    """Continue stored fingerprints; the result equals a computation from scratch."""
    out = FP.extend_fingerprints(stored_part(spark, sf), V.cells(spark, sf), V.spine(spark, sf))
    return text_acc(out).select("dataset", "snap", "ord", "acc")


@query("covered_prefix", f"""with {V.SPINE_STEP}, t as (select dataset, max(ord) top from spine group by 1)
select dataset, case when dataset = 'u1' then top//2 - 1 else top*2//3 end base, top last from t""")
def covered_prefix(spark, sf):
    return FP.covered_prefix(stored_part(spark, sf), V.spine(spark, sf))


@query("old_content", f"""with {V.HIST}, {V.SPINE_STEP}, b as (select dataset, max(ord)*2//3 base from spine group by 1),
t as (select distinct h.dataset, cell from hist h join b on b.dataset = h.dataset where ord > base)
select h.dataset, any_value(base) ord, h.cell, arg_max_null(payload, h.ord) payload from hist h join b on b.dataset = h.dataset
join t on t.dataset = h.dataset and t.cell = h.cell where h.ord <= base group by h.dataset, h.cell""")
def old_content(spark, sf):
    """What a resume reads of the base: only cells that change after it."""
    base = V.spine(spark, sf).groupBy("dataset").agg(F.expr("max(ord) * 2 div 3").cast("int").alias("base"))
    out = FP.old_content(V.cells(spark, sf), base)
    return out.withColumn("payload", F.col("payload").cast("string"))


EXPECTED = f"""expected as (select s.dataset, case when s.ord % 17 = 0 then s.snap||'x' else s.snap end snap,
    s.size + case when s.ord % 13 = 0 then 1 else 0 end size, acc, case when s.ord % 11 = 0 then 0 else version_id end version_id
  from spine s join prints p on p.dataset = s.dataset and p.ord = s.ord),
status as (select coalesce(e.dataset, s.dataset) dataset, coalesce(e.snap, s.snap) snap,
    case when s.snap is null then 'MISSING' when e.snap is null then 'EXTRA' when e.size = s.size then 'OK' else 'DIFFER' end status,
    coalesce(e.version_id <> s.version_id, false) id_differs
  from expected e full join spine s on s.dataset = e.dataset and s.snap = e.snap)"""


def verified(spark, sf):
    """Compared with a list in which names, sizes and ids of some versions are wrong."""
    actual = history_prints(spark, sf)
    o = F.col("ord")
    expected = (actual.withColumn("snap", F.when(o % 17 == 0, F.concat("snap", F.lit("x"))).otherwise(F.col("snap")))
                .withColumn("size", F.col("size") + F.when(o % 13 == 0, 1).otherwise(0))
                .withColumn("version_id", F.when(o % 11 == 0, F.lit(0)).otherwise(F.col("version_id"))))
    return FP.verify_fingerprints(expected, actual)


@query("verify_fingerprints", f"with {HASHES}, {EXPECTED} select * from status")
def verify_fingerprints(spark, sf):
    return verified(spark, sf)


@query("verify_totals", f"""with {HASHES}, {EXPECTED}
select dataset, count(*) filter (status = 'OK') ok, count(*) filter (status = 'DIFFER') differ, count(*) filter (status = 'MISSING') missing,
  count(*) filter (status = 'EXTRA') extra, count(*) filter (status in ('DIFFER', 'MISSING')) = 0 passed from status group by 1""")
def verify_totals(spark, sf):
    return FP.verify_totals(verified(spark, sf))


def net(*values):
    """DuckDB: each value as its length, a colon and its text."""
    return "||".join(f"octet_length(encode(cast({v} as varchar)))||':'||cast({v} as varchar)||','" for v in values)


WHOLE_SEED = ("sha256(" + net("l_orderkey", "l_linenumber") + "||'='||" + net(
    "l_partkey", "l_suppkey", *[f"cast(round(l_{c}*100) as bigint)" for c in ("quantity", "extendedprice", "discount", "tax")],
    "l_returnflag", "l_linestatus", "l_shipdate") + ")")


TABLE_SQL = f"""with s as (select l_returnflag, {WHOLE_SEED} h from lineitem), l as ({lanes_of('s')}),
t as (select l_returnflag, lane, sum(x) v from l group by 1, 2)
select l_returnflag, (select count(*) from lineitem i where i.l_returnflag = t.l_returnflag) "rows", {PACK} acc from t group by 1"""


@query("table_fingerprint", TABLE_SQL)
def table_fingerprint(spark, sf):
    """All line items with all their columns, one fingerprint per return flag."""
    return whole_fingerprint(V.table(spark, sf, "lineitem"))


@query("table_fingerprint_whole", TABLE_SQL)
def table_fingerprint_whole(spark, sf):
    """The same under its earlier name."""
    return table_fingerprint(spark, sf)


def whole_fingerprint(items):
    money = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    items = items.withColumns({c: F.round(F.col(c) * 100).cast("long") for c in money})
    items = items.withColumn("l_shipdate", F.col("l_shipdate").cast("string"))
    out = FP.table_fingerprint(items, ["l_orderkey", "l_linenumber"], [
        "l_partkey", "l_suppkey", *money, "l_returnflag", "l_linestatus", "l_shipdate"], ["l_returnflag"])
    return text_acc(out)


@query("table_replica_check", f"""with r as ({D(V.REPLICA)}),
s as (select 'orders' side, sha256({net("o_orderkey")}||'='||{net("cast(round(o_totalprice*100) as bigint)")}) h from orders
      union all select 'replica', sha256({net("o_orderkey")}||'='||{net("cents")}) from r), l as ({lanes_of('s')}),
t as (select side, lane, sum(x) v from l group by 1, 2)
select side, (select count(*) from s where s.side = t.side) "rows", {PACK} acc from t group by 1""")
def table_replica_check(spark, sf):
    """Fingerprints of a table and of a replica that lost and changed rows."""
    a = V.table(spark, sf, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    b = V.view(spark, sf, V.REPLICA)
    both = a.withColumn("side", F.lit("orders")).unionByName(b.withColumn("side", F.lit("replica")))
    return text_acc(FP.table_fingerprint(both, ["o_orderkey"], ["cents"], ["side"]))


@query("fingerprint_job", f"""with {HASHES}
select s.dataset, s.snap, s.ord, s.size, cast(version_id as varchar) version_id, acc from spine s join prints p on p.dataset = s.dataset and p.ord = s.ord""")
def fingerprint_job(spark, sf):
    """All versions in rounds of twenty, each persisted; the job is started twice, the first time with half of the versions."""
    cells, spine, path = V.cells(spark, sf), V.spine(spark, sf), scratch_path(spark, "print-job")
    jobs.fingerprint_job(spark, cells, spine.filter("ord <= 30"), path, 32, at_once=20)
    out = jobs.fingerprint_job(spark, cells, spine, path, 32, at_once=20)
    return text_acc(out).withColumn("version_id", F.col("version_id").cast("string")).drop("cell_size", "lanes", "algo")


@query("verify_recut", f"""with {V.SPINE_STEP} select dataset, snap, case when ord % 7 = 0 then 'DIFFER' else 'OK' end status, false id_differs from spine""")
def verify_recut(spark, sf):
    """Fingerprints made at cells of 256 bytes verify a history kept at 32; those of every seventh version were damaged."""
    cells, spine = V.cells(spark, sf), V.spine(spark, sf).withColumn("version_id", F.col("version_id").cast("decimal(20,0)"))
    made = jobs.fingerprint_job(spark, cells, spine, scratch_path(spark, "recut-job"), 32, 256)
    damaged = made.withColumn("acc", F.when(F.col("ord") % 7 == 0, F.unhex(F.sha2("acc", 256))).otherwise(F.col("acc")))
    return jobs.verify_stored(damaged, cells, spine, 32).select("dataset", "snap", "status", "id_differs")


WY_HISTORY = f"""{V.HIST}, {V.SPINE_STEP},
live as (select dataset, ord, cell, lower(hex(encode(payload))) h from (
  select s.dataset, s.ord, h.cell, arg_max_null(h.payload, h.ord) payload
  from spine s join hist h on h.dataset = s.dataset and h.ord <= s.ord group by 1, 2, 3) where payload is not null),
{wy_sql.seeds('live')}, {wy_sql.digests('dataset, ord')}
select s.dataset, s.snap, s.ord, coalesce(digest, {wy_sql.ZERO}) digest from spine s left join digests d on d.dataset = s.dataset and d.ord = s.ord"""


@query("wy_fingerprint_history", f"with recursive {WY_HISTORY}")
def wy_fingerprint_history(spark, sf):
    """The 1,024-lane hash of every version; the SQL hashes each version from scratch."""
    out = FP.fingerprint_history(V.cells(spark, sf), V.spine(spark, sf), algo=FP.WY)
    return out.select("dataset", "snap", "ord", L.acc_digest("acc").alias("digest"))


@query("extend_wy_fingerprints", f"with recursive {WY_HISTORY}")
def extend_wy_fingerprints(spark, sf):
    """Stored 1,024-lane fingerprints of the first half of the versions, written as text, read again and extended."""
    cells, spine = V.cells(spark, sf), V.spine(spark, sf)
    half = FP.fingerprint_history(cells, spine, algo=FP.WY).filter("ord <= 30")
    text = half.withColumn("acc", L.acc_to_text("acc"))
    stored = materialise(text, "wy-text").withColumn("acc", L.acc_from_text("acc", 1024))
    out = FP.extend_wy_fingerprints(stored, cells, spine)
    return out.select("dataset", "snap", "ord", L.acc_digest("acc").alias("digest"))


@query("wy_document_fingerprints", f"""with recursive docs as (select dataset, ord, encode(text) b from ({V.duck(V.DOC_VERSIONS)})),
cut as (select dataset, ord, c cell, lower(rpad(hex(array_slice(b, c*4096+1, c*4096+4096)), 8192, '0')) h
        from (select *, unnest(range(0, (octet_length(b)-1)//4096+1)) c from docs where octet_length(b) > 0)),
live as (select * from cut where h <> repeat('0', 8192)), {wy_sql.seeds('live')}, {wy_sql.digests('dataset, ord')}
select * from digests""")
def wy_document_fingerprints(spark, sf):
    out = FP.wy_lthash(doc_cells(spark, sf, 4096), ["dataset", "ord"])
    return out.select("dataset", "ord", L.acc_digest("acc").alias("digest"))

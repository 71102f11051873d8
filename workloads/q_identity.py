"""Version ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockhist.operators import identity as I

from . import views as V
from .q_history import NUMBERED, numbered
from .registry import query

D = V.duck

# the id's 8 bytes, last first, through sha-256; first 8 bytes of the digest
DERIVED = """greatest(1, cast('0x'||substr(sha256(unhex(array_to_string(list_transform(range(7,-1,-1),
  lambda i: substr(lpad(to_hex({id}::ubigint),16,'0'),(1+2*i)::int,2)),''))),1,16) as ubigint))"""


def text_id(df, *cols):
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


@query("derived_ids", f"with {NUMBERED} select dataset, snap, cast({DERIVED.format(id='version_id')} as varchar) new_id from num")
def derived_ids(spark, sf):
    return text_id(I.derive_ids(numbered(spark, sf)).select("dataset", "snap", "new_id"), "new_id")


# the reference knows most versions; some of its fingerprints differ
REFERENCE = """reference as (select dataset, snap, size, case when version_id%13=0 then 'tampered' else cast(size as varchar) end acc,
  version_id+1000000000 ref_id from num where version_id%11<>0)"""


def reference(spark, sf):
    return ours(spark, sf).filter("version_id % 11 <> 0").select(
        "dataset", "snap", "ord", "size",
        F.when(F.col("version_id") % 13 == 0, F.lit("tampered")).otherwise(F.col("size").cast("string")).cast("binary").alias("acc"),
        (F.col("version_id") + 1000000000).cast("decimal(20,0)").alias("version_id"))


def ours(spark, sf):
    return numbered(spark, sf).withColumn("acc", F.col("size").cast("string").cast("binary")).withColumn(
        "version_id", F.col("version_id").cast("decimal(20,0)"))


def align_sql(missing_origin, missing_id):
    return f"""with {NUMBERED}, {REFERENCE}
select n.dataset, n.snap, case when r.snap is null then '{missing_origin}' when r.acc = cast(n.size as varchar) then 'reference' else 'differs' end id_origin,
  cast(case when r.snap is null then {missing_id} when r.acc = cast(n.size as varchar) then ref_id end as varchar) new_id
from num n left join reference r on r.dataset = n.dataset and r.snap = n.snap"""


@query("aligned_ids", align_sql("missing", "null"))
def aligned_ids(spark, sf):
    out = I.align_ids(ours(spark, sf), reference(spark, sf))
    return text_id(out.select("dataset", "snap", "id_origin", "new_id"), "new_id")


@query("aligned_ids_allow_missing", align_sql("derived", DERIVED.format(id="n.version_id")))
def aligned_ids_allow_missing(spark, sf):
    out = I.align_ids(ours(spark, sf), reference(spark, sf), allow_missing=True)
    return text_id(out.select("dataset", "snap", "id_origin", "new_id"), "new_id")


@query("coverage_gaps", f"""with {NUMBERED}, gaps as (select *, row_number() over (partition by dataset order by ord) r from num where version_id % 11 = 0)
select dataset, count(*) missing, string_agg('@'||snap, ', ' order by ord) filter (r <= 8)
  ||case when count(*) > 8 then ', ... (+'||(count(*)-8)||' more)' else '' end names from gaps group by 1""")
def coverage_gaps(spark, sf):
    return I.coverage_gaps(numbered(spark, sf), reference(spark, sf))


@query("resume_conflicts", f"""with {NUMBERED}, {REFERENCE},
base as (select dataset, max(ord)//2 ord from num group by 1),
migrated as (select n.dataset, n.snap, case when n.version_id%17=0 then 5 else n.version_id+1000000000 end id
  from num n join base b on b.dataset = n.dataset and n.ord <= b.ord)
select m.dataset, m.snap, 'id differs' reason from migrated m join reference r on r.dataset = m.dataset and r.snap = m.snap and m.id <> ref_id
union all select n.dataset, n.snap, 'base not in reference' from num n join base b on b.dataset = n.dataset and b.ord = n.ord
where n.version_id % 11 = 0""")
def resume_conflicts(spark, sf):
    all_ = ours(spark, sf)
    half = all_.groupBy("dataset").agg(F.expr("max(ord) div 2").cast("int").alias("b"))
    done = all_.join(half, "dataset").filter("ord <= b")
    migrated = done.withColumn("version_id", F.when(F.col("version_id") % 17 == 0, F.lit(5)).otherwise(
        F.col("version_id") + 1000000000).cast("decimal(20,0)"))
    return I.resume_conflicts(migrated, reference(spark, sf), done.filter("ord = b").select("dataset", "snap"))


REPLICAS = f"""{NUMBERED}, b as (select dataset, snap||'b' snap, ord*2 ord, case when version_id%13=0 then version_id+7000000 else version_id end version_id
  from num where version_id%11<>0)"""


def replica(spark, sf):
    """The other side: some versions dropped, some with other ids, named and numbered its own way."""
    n = numbered(spark, sf).filter("version_id % 11 <> 0")
    return n.select("dataset", F.concat("snap", F.lit("b")).alias("snap"), (F.col("ord") * 2).alias("ord"),
                    F.when(F.col("version_id") % 13 == 0, F.col("version_id") + 7000000).otherwise(F.col("version_id")).alias("version_id"))


@query("matched_replicas", f"""with {REPLICAS} select num.dataset, num.version_id, num.snap snap_a, num.ord ord_a, b.snap snap_b, b.ord ord_b
from num join b on b.dataset = num.dataset and b.version_id = num.version_id""")
def matched_replicas(spark, sf):
    return I.match_replicas(numbered(spark, sf), replica(spark, sf))


@query("newest_common_versions", f"""with {REPLICAS} select num.dataset, count(*) common, max(num.ord) base_ord, arg_max(num.snap, num.ord) base_snap
from num join b on b.dataset = num.dataset and b.version_id = num.version_id group by 1""")
def newest_common_versions(spark, sf):
    return I.newest_common(numbered(spark, sf), replica(spark, sf))


CUT_ID = "case when version_id%19=0 then size//1000000*1000000 else version_id+case when version_id%23=0 then 4 else 2000000000 end end"


@query("id_conflicts", f"""with {NUMBERED}, w as (select dataset, {CUT_ID} id from num)
select dataset, id, 'duplicate' reason from w group by 1, 2 having count(*) > 1
union all select distinct w.dataset, w.id, 'equals an original' from w join num on num.dataset = w.dataset and num.version_id = w.id""")
def id_conflicts(spark, sf):
    """Ids taken from a rounded size or moved by a little: some collide."""
    n = numbered(spark, sf)
    return I.id_conflicts(n.withColumn("new_id", F.expr(CUT_ID.replace("//", " div "))), n)


@query("derived_id_conflicts", f"""with {NUMBERED}, w as (select dataset, {DERIVED.format(id='version_id')} id from num)
select dataset, cast(id as varchar) id, 'duplicate' reason from w group by 1, 2 having count(*) > 1
union all select distinct w.dataset, cast(w.id as varchar), 'equals an original' from w join num on num.dataset = w.dataset and num.version_id = w.id""")
def derived_id_conflicts(spark, sf):
    """Derived ids are unique and unlike the originals: no rows expected."""
    n = I.derive_ids(numbered(spark, sf))
    return text_id(I.id_conflicts(n, n), "id")

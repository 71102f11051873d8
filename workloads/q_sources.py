"""Sources, sinks, classification and simple predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockhist.functions import ordered
from blockhist.functions.cells import is_hole
from blockhist.operators import changes as C, policy
from blockhist.session import materialise, scratch_path
from blockhist.sources import catalog, change_log, fingerprints as fp_io, history as hist_io, image_files, images

from . import views as V
from .registry import query

D = V.duck


@query("version_catalog", f"""
select dataset, cast(version_id as varchar) version_id, cast(row_number() over (partition by dataset order by created, version_id) as int) ord
from ({D(V.CATALOG)})""")
def version_catalog(spark, sf):
    out = catalog.version_catalog(V.view(spark, sf, V.CATALOG))
    return out.select("dataset", F.col("version_id").cast("string").alias("version_id"), "ord")


@query("version_catalog_by_range", f"""
select dataset, cast(version_id as varchar) version_id, cast(row_number() over (partition by dataset order by created, version_id) as int) ord
from ({D(V.CATALOG)})""")
def version_catalog_by_range(spark, sf):
    out = catalog.version_catalog(V.view(spark, sf, V.CATALOG), chunked=True)
    return out.select("dataset", F.col("version_id").cast("string").alias("version_id"), "ord")


PARSED = f"""
parsed as (select dataset, ord, seq, line, string_split_regex(trim(line), '\\s+') w from ({D(V.LOG)}) where trim(line) <> ''),
records as (select dataset, ord, seq, line, w, w[1] keyword,
  map_from_entries(list_transform(list_filter(range(2, len(w)), lambda i: w[i] = '='), lambda i: struct_pack(k := w[i-1], v := w[i+1]))) f
  from parsed where coalesce(w[2], '') <> '=' and w[1] not in ('SUMMARY:', 'SUMMARY', 'Total', 'Estimated'))"""

JUDGED = PARSED + """,
vals as (select *, f['object'] o_t, f['offset'] off_t, coalesce(f['logical_size'], f['lsize'], f['length']) w_t, f['length'] l_t,
  case when regexp_full_match(f['object'], '[0-9]+') then try_cast(f['object'] as bigint) end o,
  case when regexp_full_match(f['offset'], '[0-9]+') then try_cast(f['offset'] as bigint) end off from records),
sized as (select *, case when keyword = 'FREE' then l_t else w_t end s_t from vals),
judged as (select *, case when regexp_full_match(s_t, '-?[0-9]+') then try_cast(s_t as bigint) end len,
  case when keyword in ('BEGIN', 'END', 'OBJECT') then null
       when keyword = 'REDACT' then 'redacted'
       when keyword = 'FREEOBJECTS' then
         case when not (try_cast(f['firstobj'] as bigint) = 3 and try_cast(f['firstobj'] as bigint) + try_cast(f['numobjs'] as bigint) = 32)
              then 'unexpected object range' end
       when keyword = 'FREE' or starts_with(keyword, 'WRITE') then
         case when o_t is null then 'field missing' when o is null then 'not a number' when o = 2 then null
              when o <> 1 then 'unexpected object' when off_t is null then 'field missing' when off is null then 'not a number'
              when s_t is null then case when keyword = 'FREE' then 'field missing' else 'no length' end
              when not regexp_full_match(s_t, '-?[0-9]+') then 'not a number' end
       else 'unknown keyword' end reason from sized)"""


def log_records(spark, sf):
    return change_log.parse_lines(V.view(spark, sf, V.LOG))


@query("change_log_records", f"""with {PARSED}
select dataset, ord, seq, keyword, cast(cardinality(f) as int) n_fields, f['offset'] off_text from records""")
def change_log_records(spark, sf):
    return log_records(spark, sf).select("dataset", "ord", "seq", "keyword", F.size("fields").alias("n_fields"),
                                         F.try_element_at("fields", F.lit("offset")).alias("off_text"))


def log_files(spark, sf, label):
    """The log as text files, a folder per version; a big version has several files, in order."""
    path = scratch_path(spark, label)
    lines = V.view(spark, sf, V.LOG)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # sorted by the folder first: otherwise the writer's own sort by folder takes the place of this one
    named = lines.select(F.concat_ws("@", "dataset", F.col("ord").cast("string")).alias("version"), "seq", "line")
    (named.repartitionByRange(n, "version", "seq").sortWithinPartitions("version", "seq").select("version", "line")
     .write.partitionBy("version").text(path))
    return path


@query("change_log_files", f"""with {PARSED}, pos as (select dataset, ord, keyword, f['offset'] off_text,
  row_number() over (partition by dataset, ord order by seq) pos from records)
select dataset, ord, keyword, off_text, pos from pos""")
def change_log_files(spark, sf):
    """Reads the log back from files; the position follows from the file's own order."""
    from blockhist.functions import ordered
    path = log_files(spark, sf, "log")
    raw = change_log.with_line_numbers(spark.read.text(path))
    version = F.regexp_extract(F.url_decode("file"), r"version=([^/]+)/", 1)
    named = raw.withColumn("dataset", F.split(version, "@")[0]).withColumn("ord", F.split(version, "@")[1].cast("int"))
    records = change_log.parse_lines(named)
    cut = ordered.range_chunks(records, ["dataset", "ord"], ["file", "seq"])
    numbered = ordered.row_numbers(cut, ["dataset", "ord"], ["file", "seq"], "pos", "_chunk")
    return numbered.select("dataset", "ord", "keyword", F.try_element_at("fields", F.lit("offset")).alias("off_text"),
                           F.col("pos").cast("long").alias("pos"))


@query("classify_changes", f"""with {JUDGED}
select dataset, ord, seq, case when keyword = 'FREE' then 'FREE' else 'WRITE' end op, off, len
from judged where reason is null and (keyword = 'FREE' or starts_with(keyword, 'WRITE')) and o = 1""")
def classify_changes(spark, sf):
    return C.classify_changes(log_records(spark, sf))


@query("quarantine_changes", f"""with {JUDGED}
select dataset, ord, seq, line raw, reason from judged where reason is not null""")
def quarantine_changes(spark, sf):
    return C.quarantine_changes(log_records(spark, sf))


DOC_CELLS = f"""
docs as (select dataset, ord, encode(text) b from ({D(V.DOC_VERSIONS)})),
cut as (select dataset, ord, c cell, rpad(hex(array_slice(b, c*512+1, c*512+512)), 1024, '0') h
        from (select *, unnest(range(0, (octet_length(b)-1)//512+1)) c from docs where octet_length(b) > 0))"""


def doc_images(spark, sf):
    return V.view(spark, sf, V.DOC_VERSIONS).withColumn("bytes", F.encode("text", "UTF-8")).drop("text")


def doc_cells(spark, sf, cell_size=512):
    return images.to_cells(doc_images(spark, sf), ["dataset", "ord"], "bytes", cell_size)


@query("image_cells", f"""with {DOC_CELLS}
select dataset, ord, cell, sha256(unhex(h)) digest from cut where h <> repeat('0', 1024)""")
def image_cells(spark, sf):
    return doc_cells(spark, sf).select("dataset", "ord", "cell", F.sha2("payload", 256).alias("digest"))


PACKED = "select 'v'||cast(cast(substr(dataset, 2) as bigint) % 4 as string) volume, cast(substr(dataset, 2) as bigint) doc, ord, text from (" + V.DOC_VERSIONS + ") d"


@query("image_file_cells", f"""with docs as (select volume, doc, ord, encode(text) b from ({D(PACKED)}) where octet_length(encode(text)) > 0),
placed as (select *, sum((octet_length(b) + 511) // 512) over (partition by volume, ord order by doc) - (octet_length(b) + 511) // 512 first from docs),
cut as (select volume, ord, first + c cell, rpad(hex(array_slice(b, c*512+1, c*512+512)), 1024, '0') h
        from (select *, unnest(range(0, (octet_length(b)-1)//512+1)) c from placed))
select volume dataset, ord, cast(cell as bigint) cell, sha256(unhex(h)) digest from cut where h <> repeat('0', 1024)""")
def image_file_cells(spark, sf):
    """All documents packed into four volumes of three versions, written as image files and read in splits of 64 KiB."""
    docs = V.view(spark, sf, PACKED).withColumn("bytes", F.encode("text", "UTF-8")).filter("octet_length(bytes) > 0")
    sized = docs.withColumn("n", F.expr("(octet_length(bytes) + 511L) div 512"))
    places = ordered.running_sums(sized.select("volume", "doc", "ord", "n"), ["volume", "ord"], ["doc"], {"upto": "n"},
                                  ordered.int_chunk("doc"))
    # a document is cut into cells where it has met its place
    cells = (images.to_cells(docs.join(places, ["volume", "doc", "ord"]), ["volume", "ord", "upto", "n"], "bytes", 512)
             .select(F.col("volume").alias("dataset"), "ord", (F.col("cell") + F.col("upto") - F.col("n")).alias("cell"), "payload"))
    versions = sized.groupBy(F.col("volume").alias("dataset"), "ord").agg((F.sum("n") * 512).alias("size"))
    path = scratch_path(spark, "images")
    image_files.write_images(cells, versions, path, 512)
    return image_files.read_images(spark, path, 512, 1 << 16).select("dataset", "ord", "cell", F.sha2("payload", 256).alias("digest"))


@query("history_round_trip", f"with {V.HIST} select dataset, ord, cell, payload from hist")
def history_round_trip(spark, sf):
    path = scratch_path(spark, "history")
    hist_io.write_history(V.cells(spark, sf), path, 64)
    return hist_io.read_history(spark, path, 64).withColumn("payload", F.col("payload").cast("string"))


# rows as they could come from a text source: bad numbers, bad states, repeated names
FP_ROWS = """
select 'f'||cast(o_custkey%7 as string) dataset, o_orderkey line_no,
       case when o_orderkey%61=0 then 'two words' else 's'||cast(o_orderkey%997 as string) end snap,
       case when o_orderkey%53=0 then '12k' else cast(cast(round(o_totalprice*100) as bigint) as string) end size,
       case when o_orderkey%47=0 then 'xyz1' else 'ab'||case when o_custkey%2=0 then '01' else 'fe' end end state,
       case when o_orderkey%43=0 then '18446744073709551616' else cast(o_orderkey as string) end version_id
from {orders}"""

FP_GOOD = """regexp_full_match(size, '[0-9]+') and try_cast(version_id as ubigint) is not null
  and regexp_full_match(state, '([0-9a-fA-F]{4})+') and snap not like '% %'"""


@query("read_fingerprints", f"""
select dataset, snap, cast(arg_max(size, line_no) as bigint) size, arg_max(state, line_no) state,
       arg_max(version_id, line_no) version_id
from ({D(FP_ROWS)}) where {FP_GOOD} group by 1, 2""")
def read_fingerprints(spark, sf):
    good, _ = fp_io.read_fingerprints(V.view(spark, sf, FP_ROWS))
    return good.select("dataset", "snap", "size", F.lower(F.hex("acc")).alias("state"),
                       F.col("version_id").cast("string").alias("version_id"))


@query("rejected_fingerprints", f"""
select dataset, line_no, case when snap like '% %' then 'blank in name' when not regexp_full_match(size, '[0-9]+') then 'size is not a number'
  when try_cast(version_id as ubigint) is null then 'id is not a number' else 'state is not hex' end reason
from ({D(FP_ROWS)}) where not ({FP_GOOD})""")
def rejected_fingerprints(spark, sf):
    _, bad = fp_io.read_fingerprints(V.view(spark, sf, FP_ROWS))
    return bad.select("dataset", "line_no", "reason")


def order_fingerprints(spark, sf):
    """One small fingerprint per order, as if every order were a version."""
    rows = catalog.version_catalog(V.view(spark, sf, V.CATALOG))
    return rows.select("dataset", "snap", "ord", "size", F.lit(512).cast("long").alias("cell_size"),
                       F.lit(16).alias("lanes"), F.lit("lt-sql").alias("algo"),
                       F.unhex(F.sha2(F.col("size").cast("string"), 256)).alias("acc"),
                       F.col("version_id").cast("decimal(20,0)").alias("version_id"))


ORDER_FPS = f"""select dataset, snap, cast(row_number() over (partition by dataset order by created, version_id) as int) ord,
  size, sha256(cast(size as varchar)) acc, cast(version_id as varchar) version_id from ({D(V.CATALOG)})"""


@query("fingerprint_store", f"select dataset, snap, ord, size, acc, version_id, true complete from ({ORDER_FPS})")
def fingerprint_store(spark, sf):
    """Rows appended while in progress, then the finished table in their place."""
    path = scratch_path(spark, "fps")
    fps = order_fingerprints(spark, sf)
    half = F.col("ord") % 2 == 0
    fp_io.write_fingerprints(fps.filter(half), path, complete=False)
    fp_io.write_fingerprints(fps.filter(~half), path, complete=False)
    final = scratch_path(spark, "fps")
    fp_io.write_fingerprints(fp_io.load_fingerprints(spark, path), final, complete=True)
    return fp_io.load_fingerprints(spark, final).select(
        "dataset", "snap", "ord", "size", F.lower(F.hex("acc")).alias("acc"),
        F.col("version_id").cast("string").alias("version_id"), "complete")


@query("fingerprint_text", f"""with f as ({ORDER_FPS}) , n as (select dataset, count(*) n, max(ord) last from f group by 1)
select dataset, 1 line_no, '# blockhist fingerprint v1' line from n union all
select dataset, 2, '# dataset '||dataset from n union all
select dataset, 3, '# cellsize 512' from n union all
select dataset, 4, '# columns: snapshot volsize fingerprint guid' from n union all
select dataset, ord + 4, snap||' '||size||' '||acc||' '||version_id from f union all
select dataset, last + 5, '# dataset '||dataset||' complete ('||n||' snapshots)' from n""")
def fingerprint_text(spark, sf):
    return fp_io.export_text(order_fingerprints(spark, sf))


@query("fingerprint_text_import", f"""select dataset, snap, size, acc, version_id, 512 cell_size from ({ORDER_FPS})""")
def fingerprint_text_import(spark, sf):
    # written as a file is: every check of its lines would make them anew
    good, _ = fp_io.import_text(materialise(fp_io.export_text(order_fingerprints(spark, sf)), "text"))
    return good.select("dataset", "snap", "size", F.lower(F.hex("acc")).alias("acc"),
                       F.col("version_id").cast("string").alias("version_id"), "cell_size")


@query("carried_properties", f"""
select dataset, property, value, source from ({D(V.PROPS)})
where source in ('local', 'received') and property not in ('volsize', 'readonly', 'keyformat')""")
def carried_properties(spark, sf):
    return policy.carry_properties(V.view(spark, sf, V.PROPS))


@query("clamp_ranges", f"""
select dataset, ord, seq, op, off, case when len < 0 or off + len > {V.SPAN} then {V.SPAN} - off else len end len
from ({D(V.CHANGES)}) where off < {V.SPAN} and len <> 0""")
def clamp_ranges(spark, sf):
    return clamped(spark, sf)


@query("quarantine_out_of_range", f"""
select dataset, ord, seq, off, len, case when off >= {V.SPAN // 2} then 'starts past the end' else 'runs past the end' end reason
from ({D(V.CHANGES)}) where op = 'WRITE' and len <> 0 and (off >= {V.SPAN // 2} or len > {V.SPAN // 2} - off)""")
def quarantine_out_of_range(spark, sf):
    """Writes that versions of half the size cannot hold."""
    versions = change_versions(spark, sf).withColumn("size", F.lit(V.SPAN // 2).cast("long"))
    return C.writes_past_end(V.view(spark, sf, V.CHANGES), versions)


@query("lost_writes", f"""with c as (select * from ({D(V.CHANGES)})),
bad as (select *, off + len stop, greatest(off, {V.SPAN // 2}) start from c
  where op = 'WRITE' and len <> 0 and (off >= {V.SPAN // 2} or len > {V.SPAN // 2} - off)),
units as (select dataset, ord, seq, off, len, unnest(range(start // 512, stop // 512)) u from bad),
left_ as (select distinct dataset, ord, seq, off, len from units x where not exists (select 1 from c f
  where f.op = 'FREE' and f.dataset = x.dataset and f.ord = x.ord and f.seq > x.seq and f.off <= x.u * 512 and (f.len < 0 or f.off + f.len >= x.u * 512 + 512)))
select dataset, ord, seq, off, len, case when off >= {V.SPAN // 2} then 'starts past the end' else 'runs past the end' end reason from left_""")
def lost_writes(spark, sf):
    """Of the writes that versions of half the size cannot hold, those that later frees do not take back."""
    versions = change_versions(spark, sf).withColumn("size", F.lit(V.SPAN // 2).cast("long"))
    return C.lost_writes(V.view(spark, sf, V.CHANGES), versions)


def change_versions(spark, sf):
    """Versions of CHANGES; all have one size."""
    return (V.view(spark, sf, V.CHANGES).select("dataset", "ord").distinct()
            .withColumn("size", F.lit(V.SPAN).cast("long")))


def clamped(spark, sf):
    return C.clamp_ranges(V.view(spark, sf, V.CHANGES), change_versions(spark, sf))


ODD_PAYLOADS = """
select event_id, case event_id%5 when 0 then null when 1 then '' when 2 then repeat('00', cast(1 + event_id%16 as int))
  when 3 then repeat('00', cast(event_id%15 as int))||'01' else hex(event_type) end payload
from {events}"""


@query("hole_test", f"""
select event_id, payload is null or regexp_full_match(payload, '(00)*') hole from ({D(ODD_PAYLOADS)})""")
def hole_test(spark, sf):
    rows = V.view(spark, sf, ODD_PAYLOADS).withColumn("payload", F.unhex("payload"))
    return rows.select("event_id", is_hole("payload", 16).alias("hole"))


@query("property_is_set", f"""
select dataset, property, value, value not in ('', '0', 'none', '-') is_set from ({D(V.RESERVATIONS)})""")
def property_is_set(spark, sf):
    return V.view(spark, sf, V.RESERVATIONS).select("dataset", "property", "value", policy.is_set("value").alias("is_set"))


@query("change_stats", f"""
select dataset, ord, cast(coalesce(sum(len) filter (op = 'WRITE'), 0) as bigint) written,
  cast(coalesce(sum(len) filter (op = 'FREE'), 0) as bigint) freed,
  count(*) filter (op = 'WRITE') writes, count(*) filter (op = 'FREE') frees
from (select dataset, ord, op, case when len < 0 or off + len > {V.SPAN} then {V.SPAN} - off else len end len
      from ({D(V.CHANGES)}) where off < {V.SPAN}) group by 1, 2""")
def change_stats(spark, sf):
    return C.change_stats(clamped(spark, sf))


@query("change_totals", f"""
select dataset, cast(coalesce(sum(len) filter (op = 'WRITE'), 0) as bigint) written,
  cast(coalesce(sum(len) filter (op = 'FREE'), 0) as bigint) freed,
  count(*) filter (op = 'WRITE') writes, count(*) filter (op = 'FREE') frees
from (select dataset, ord, op, case when len < 0 or off + len > {V.SPAN} then {V.SPAN} - off else len end len
      from ({D(V.CHANGES)}) where off < {V.SPAN}) group by 1""")
def change_totals(spark, sf):
    return C.total_stats(C.change_stats(clamped(spark, sf)))


@query("drift_report", f"""
with w as (select dataset, ord, cast(coalesce(sum(len) filter (op = 'WRITE'), 0) as bigint) written
  from (select dataset, ord, op, case when len < 0 or off + len > {V.SPAN} then {V.SPAN} - off else len end len
        from ({D(V.CHANGES)}) where off < {V.SPAN}) group by 1, 2),
e as (select dataset, ord, cast(sum(case when op = 'WRITE' and ord % 7 <> 0 then len else 0 end) as bigint) estimate from ({D(V.CHANGES)}) group by 1, 2)
select e.dataset, e.ord, estimate, coalesce(written, 0) written, abs(coalesce(written, 0) - estimate) diff,
  estimate > 0 and abs(coalesce(written, 0) - estimate) > 131072 and abs(coalesce(written, 0) - estimate) * 10 > estimate drift
from e left join w on e.dataset = w.dataset and e.ord = w.ord""")
def drift_report(spark, sf):
    """The estimate counts unclamped writes; every seventh version has none."""
    est = V.view(spark, sf, V.CHANGES).groupBy("dataset", "ord").agg(
        F.sum(F.when((F.col("op") == "WRITE") & (F.col("ord") % 7 != 0), F.col("len")).otherwise(0)).alias("estimate"))
    return C.drift_report(est, C.change_stats(clamped(spark, sf)))

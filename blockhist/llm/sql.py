"""The registered queries in DuckDB's SQL, where SQL can state them."""

from . import sql_unrolled

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL = {
    "op3_near_duplicates": f"""
with recursive word as (
  select doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+'), []) as w from documents),
shingle as (
  select distinct doc_id, array_to_string(w[s:s + 4], ' ') as sh
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) as s from word where len(w) > 0)),
size as (select doc_id, count(*) as n from shingle group by doc_id),
link as (
  select a.doc_id as a, b.doc_id as b from shingle a join shingle b on a.sh = b.sh and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id
  having 100 * count(*) >= 85 * ((select n from size where doc_id = a.doc_id) + (select n from size where doc_id = b.doc_id) - count(*))),
reach as (
  select a as doc_id, a as other from link union select r.doc_id, l.b from reach r join link l on r.other = l.a),
least_id as (select doc_id, min(other) as component_id from reach group by doc_id)
select word.doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(component_id, word.doc_id) as component_id,
  coalesce(component_id, word.doc_id) = word.doc_id as kept
from word left join size using (doc_id) left join least_id using (doc_id)""",
    "op5_url_filters": f"""
with cut as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
parts as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
ruled as (
  select *, case
    when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule from parts)
select page_id, host, path, rule,
  case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
       when regexp_matches(host, '(^|\\.)(ads|adult|casino|cheap|free|spam)-') then 'block' else 'allow' end as verdict
from ruled""",
    "op6_line_dedup": f"""
with parts as (select row_number() over () as rid, doc_id, string_split(text, chr(10)) as parts from documents where text is not null),
lines as (select rid, doc_id, unnest(parts) as line, unnest(range(len(parts))) as pos from parts),
placed as (
  select rid, doc_id, pos, length(line) as size,
    coalesce(sum(length(line) + 1) over (partition by rid order by pos rows between unbounded preceding and 1 preceding), 0) as start,
    trim(regexp_replace(translate(line, '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') as norm
  from lines),
units as (select *, row_number() over (partition by norm order by doc_id nulls last, start) > 1 as gone,
    len(string_split(norm, ' ')) as words from placed where norm <> ''),
found as (
  select rid, count(*) as n_lines, count(*) filter (gone) as n_removed,
    coalesce(sum(size) filter (gone), 0) as chars_removed,
    coalesce(string_agg(start || ':' || (start + size), ',' order by start) filter (gone), '') as spans
  from units group by rid),
run as (
  select rid, min(start) as start, max(start + size) as stop from (
    select *, sum((not gone)::int) over (partition by rid order by pos) as block from units) where gone
  group by rid, block having sum(words) > 50),
runs as (select rid, count(*) as n_passages, string_agg(start || ':' || stop, ',' order by start) as passages from run group by rid)
select doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed,
  coalesce(chars_removed, 0)::bigint as chars_removed, coalesce(spans, '') as spans,
  coalesce(n_passages, 0)::bigint as n_passages, coalesce(passages, '') as passages
from parts left join found using (rid) left join runs using (rid)
union all select doc_id, 0, 0, 0, '', 0, '' from documents where text is null""",
    "op10_decontamination": f"""
with item as (
  select item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
win as (
  select distinct item_id, len(w[s:s + least(len(w), 10) - 1]) as n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') as gram
  from (select item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as s from item where len(w) > 0)),
doc as (
  select doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) as w from documents),
place as (
  select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from doc, (select distinct n from win) where len(w) >= n),
hit as (
  select doc_id, s, p.n, item_id from place p join win on win.n = p.n and win.gram = array_to_string(w[s:s + p.n - 1], ' ')),
words as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(s, s + n)) as pos from hit) group by doc_id),
items as (
  select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as list
  from (select distinct doc_id, cast(item_id as varchar) as item_id from hit) group by doc_id)
select doc.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(list, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc left join words using (doc_id) left join items using (doc_id)""",
}

SQL |= sql_unrolled.SQL

"""The queries op11 to op13 in DuckDB's SQL. Rounds and levels are written out, one common table each."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROUNDS, PARTS, ENTRIES = 6, 8, 16
#: Levels written out: up to 16^6 documents a source and 16^4 sources.
SOURCE_LEVELS, TOP_LEVELS = 6, 4

OP11 = f"""
with whole as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
parts as (select rid, doc_id, string_split(text, chr(10)) as parts from whole),
line as (select rid, doc_id, unnest(parts) as line, unnest(range(len(parts))) as pos from parts),
keyed as (
  select *, translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''), '{UPPER}', '{LOWER}') as key
  from line),
common as (
  select key, max(doc_id) as keeper from keyed where length(key) >= 40
  group by key having count(distinct doc_id) + max(case when doc_id is null then 1 else 0 end) >= 5),
marked as (select k.*, c.key is not null and (doc_id is null or doc_id < keeper) as gone from keyed k left join common c using (key))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by rid, doc_id"""


def _codes() -> str:
    def nearest(books: str) -> str:
        return f"""
  select rid, part, entry, dist from (
    select *, row_number() over (partition by rid, part order by dist, entry) as place from (
      select p.rid, p.part, c.entry, sum((p.v - c.v) * (p.v - c.v)) as dist
      from point p join {books} c on p.part = c.part and p.pos = c.pos group by p.rid, p.part, c.entry)) where place = 1"""
    steps = [f"""
kept as (
  select row_number() over (order by vec_id nulls last, embedding) - 1 as rid, vec_id, label, embedding from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
point as (
  select rid, (i * {PARTS}) // dim as part, i % (dim // {PARTS}) as pos, floor(4096 * x::double)::bigint as v
  from (select rid, unnest(embedding) as x, unnest(range(len(embedding))) as i, len(embedding) as dim from kept)),
book0 as (select part, rid as entry, pos, v from point where rid < {ENTRIES})"""]
    for r in range(ROUNDS):
        steps.append(f"near{r} as materialized ({nearest(f'book{r}')})")
        steps.append(f"""
book{r + 1} as materialized (
  select b.part, b.entry, b.pos, coalesce(m.v, b.v) as v from book{r} b left join (
    select p.part, n.entry, p.pos, (sum(p.v) // count(*) - case when sum(p.v) % count(*) < 0 and sum(p.v) // count(*) * count(*) > sum(p.v) then 1 else 0 end)::bigint as v
    from point p join near{r} n on p.rid = n.rid and p.part = n.part group by p.part, n.entry, p.pos) m
  on b.part = m.part and b.entry = m.entry and b.pos = m.pos)""")
    steps.append(f"last as materialized ({nearest(f'book{ROUNDS}')})")
    steps.append("""
coded as (
  select rid, string_agg(printf('%02x', entry::int), '' order by part) as code, sum(dist)::bigint as error from last group by rid),
row_ as (select k.rid, k.vec_id, k.label, c.code, c.error from kept k join coded c using (rid))""")
    return "with " + ",".join(steps) + f"""
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
  (select sha256(string_agg(v::varchar, ',' order by part, entry, pos)) from book{ROUNDS}) as codebooks_sha256
from row_"""


def _tree(name: str, leaves: str, levels: int) -> list[str]:
    """Common tables of one set of trees: nodes per level, roots, and per leaf and level what stands beside it."""
    out = [f"{name}0 as materialized (select tree, lo as pos, hash, count(*) over (partition by tree) as n from {leaves})"]
    for k in range(1, levels + 1):
        out.append(f"""
{name}{k} as materialized (
  select tree, pos, hash, count(*) over (partition by tree) as n from (
    select tree, pos // 16 as pos, sha256(string_agg(hash, '' order by pos)) as hash from {name}{k - 1} where n > 1 group by tree, pos // 16))""")
    out.append(f"{name}_root as (" + " union all ".join(f"select tree, hash from {name}{k} where n = 1" for k in range(levels + 1)) + ")")
    for k in range(levels):
        own = f"(l.lo // {16 ** k})"
        out.append(f"""
{name}_side{k} as materialized (
  select l.tree, l.lo, coalesce(string_agg(s.hash, '' order by s.pos) filter (s.pos < {own}), '') as l,
    coalesce(string_agg(s.hash, '' order by s.pos) filter (s.pos > {own}), '') as r
  from {leaves} l join {name}{k} s on s.tree = l.tree and s.pos // 16 = l.lo // {16 ** (k + 1)} and s.n > 1 group by l.tree, l.lo)""")
    return out


def _fold(steps: list[str], name: str, start: str, levels: int, key: str) -> str:
    """Chains the levels of a set of trees onto ``start`` (..., acc, proof); returns the last table's name."""
    for k in range(levels):
        steps.append(f"""
{name}_fold{k} as materialized (
  select f.* exclude (acc, proof), case when s.lo is null then acc else sha256(s.l || acc || s.r) end as acc,
    proof || coalesce(s.l || s.r, '') as proof
  from {start} f left join {name}_side{k} s on {key})""")
        start = f"{name}_fold{k}"
    return start


def _manifest() -> str:
    def field(c):
        return f"case when {c} is null then '-' else octet_length(encode({c}::varchar))::varchar || ':' || {c}::varchar end"

    def leaf(text):
        return "sha256(" + " || ".join([field("doc_id"), field("source"), field("lang"), field("n_chars"),
                                        f"case when text is null then '-' else octet_length(encode({text}))::varchar || ':' || {text} end"]) + ")"
    steps = ["""
step(i, c, k) as (
  select i, i, 0 from range(256) t(i) union all
  select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from step where k < 8),
crc as (select list(c order by i) as t from step where k = 8)""", f"""
hashed as (
  select doc_id, coalesce('=' || source, '') as tree, {leaf('text')} as hash,
    case when xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
                              lambda acc, b: xor(acc >> 8, t[(xor(acc, b) & 255) + 1])), 4294967295) % 5 = 0
         then {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} end as tampered
  from documents, crc)""", """
leaf_ as materialized (select *, row_number() over (partition by tree order by doc_id nulls first, hash) - 1 as lo from hashed)"""]
    steps += _tree("src", "leaf_", SOURCE_LEVELS)
    steps.append("subroot as materialized (select 'above' as tree, tree as source, hash, row_number() over (order by tree) - 1 as lo from src_root)")
    steps += _tree("top", "subroot", TOP_LEVELS)
    steps.append("start as (select l.*, s.hash as subroot, s.lo as place, coalesce(tampered, l.hash) as acc, '' as proof from leaf_ l join subroot s on s.source = l.tree)")
    end = _fold(steps, "src", "start", SOURCE_LEVELS, "s.tree = f.tree and s.lo = f.lo")
    end = _fold(steps, "top", end, TOP_LEVELS, "s.lo = f.place")
    return "with recursive " + ",".join(steps) + f"""
select doc_id, f.hash as leaf, subroot, r.hash as root, sha256(proof) as proof_sha256, acc as folded_root, acc = r.hash as verified
from {end} f, top_root r"""


SQL = {"op11_line_dedup": OP11, "op12_vector_codes": _codes(), "op13_merkle_manifest": _manifest()}

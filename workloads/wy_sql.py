"""The 1,024-lane hash in DuckDB's SQL, on 128-bit integers: seeds of cells, then lanes.

Steps are common tables, because a product is needed twice (its low and its high half).
"""

from __future__ import annotations

from blockhist.functions.wyhash import SECRET, WY_LANES

K0, K1, K2, K3 = (f"{v}::uhugeint" for v in SECRET)
LOW = f"{2 ** 64 - 1}::uhugeint"


def mixed(p: str) -> str:
    """Both halves of a product, folded."""
    return f"xor({p} & {LOW}, {p} >> 64)"


def word(at: str, size: int = 8) -> str:
    """Little-endian word at byte ``at`` of a payload of ``n`` bytes; ``r`` is the hex of its bytes in reverse."""
    return f"('0x'||substr(r, 2*(n-({at})-{size})+1, {2 * size}))::ubigint::uhugeint"


def seeds(cells: str) -> str:
    """Common tables up to ``seeds`` (..., seed) of ``cells`` (..., cell, h: the payload in lower-case hex, not all zeros)."""
    long_ = f"""
w_round(rid, k, s1, s2, s3) as (
  select rid, 0, state, state, state from w_start where n > 48 union all
  select rid, k + 1, {mixed('p1')}, {mixed('p2')}, {mixed('p3')} from (
    select a.rid, k, xor({word('48*k')}, {K1}) * xor({word('48*k+8')}, s1) p1, xor({word('48*k+16')}, {K2}) * xor({word('48*k+24')}, s2) p2,
      xor({word('48*k+32')}, {K3}) * xor({word('48*k+40')}, s3) p3
    from w_round a join w_start b on a.rid = b.rid where k < (n - 1) // 48))"""
    step = f"""
w_tail(rid, pos, state) as (
  select b.rid, case when n > 48 then 48 * ((n - 1) // 48) else 0 end, case when n > 48 then xor(xor(s1, s2), s3) else state end
  from w_start b left join w_round a on a.rid = b.rid and a.k = (n - 1) // 48 where n > 16 union all
  select rid, pos + 16, {mixed('p')} from (
    select t.rid, pos, xor({word('pos')}, {K1}) * xor({word('pos+8')}, t.state) p from w_tail t join w_start b on t.rid = b.rid where n - pos > 16))"""
    byte = "('0x'||substr(r, 2*(n-1-({}))+1, 2))::ubigint::uhugeint".format
    return f"""w_cells as (select row_number() over () rid, * from {cells}),
w_start as materialized (select rid, n, r, xor(cell::uhugeint, {K0}) state from (
  select rid, cell, length(h) // 2 n, array_to_string(list_reverse(regexp_extract_all(h, '..')), '') r from w_cells)),{long_},{step},
w_ends as (
  select rid, n, state, {word('n-16')} a, {word('n-8')} b from (
    select b.rid, n, r, t.state from w_start b join w_tail t on t.rid = b.rid where n > 16 and n - pos <= 16)
  union all
  select rid, n, state, ({word('0', 4)} << 32) | {word('4*(n//8)', 4)}, ({word('n-4', 4)} << 32) | {word('n-4-4*(n//8)', 4)} from w_start where n between 4 and 16
  union all
  select rid, n, state, ({byte('0')} << 16) | ({byte('n//2')} << 8) | {byte('n-1')}, 0::uhugeint from w_start where n between 1 and 3),
w_last as (select rid, xor(xor(p & {LOW}, {K0}), n::uhugeint) * xor(p >> 64, {K1}) p from (
  select rid, n, xor(a, {K1}) * xor(b, state) p from w_ends)),
seeds as materialized (select c.* exclude (rid, h), case when {mixed('p')} in (0, {LOW}) then 1::uhugeint else {mixed('p')} end seed
  from w_cells c join w_last l on l.rid = c.rid)"""


def digests(keys: str) -> str:
    """Common table ``digests`` (keys, digest): SHA-256 of the lane sums of the seeds of each key."""
    return f"""w_stretch as (
  select {keys}, i, {mixed('p')} m from (
    select {keys}, i, s * xor(s, {K1}) p from (select {keys}, i, (seed + {K0} * i::uhugeint) & {LOW} s from seeds, range(1, {WY_LANES // 4 + 1}) t(i)))),
w_sums as (select {keys}, 4 * (i - 1) + j lane, sum(((m >> (16 * j)::uhugeint) & 65535::uhugeint)::bigint) % 65536 v
  from w_stretch, range(0, 4) q(j) group by {keys}, i, j),
digests as (select {keys}, sha256(unhex(string_agg(printf('%02x%02x', (v % 256)::bigint, (v // 256)::bigint), '' order by lane))) digest
  from w_sums group by {keys})"""


#: digest of a version without live cells
ZERO = f"sha256(unhex(repeat('00', {2 * WY_LANES})))"

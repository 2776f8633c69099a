"""Shared pieces of the reference SQL: the fixture definitions as common table expressions."""

from __future__ import annotations

CAND = """cand as (
  select id, source, is_fake, decay_mode,
         (case when is_fake then 0 else decay_mode + 1 end)::int as label,
         prong, pt, eta, matched, truth_pt, truth_eta, w_mc, rnn,
         source || '_' || floor(id::double / 500::double)::int::varchar || '.parquet' as file
  from (select o_orderkey as id,
          case when o_orderstatus = 'F' then 'JZ' || (1 + o_orderkey % 8)::varchar
               else 'signal' end as source,
          o_orderstatus = 'F' as is_fake,
          substr(o_orderpriority, 1, 1)::int - 1 as decay_mode,
          (case when o_orderkey % 3 = 0 then 3 else 1 end)::int as prong,
          o_totalprice as pt,
          (o_custkey % 121)::double / 20::double - 3::double as eta,
          o_orderkey % 10 <> 0 as matched,
          o_totalprice * 0.9::double as truth_pt,
          ((o_custkey % 121)::double / 20::double - 3::double) + 0.25::double as truth_eta,
          (1 + o_orderkey % 3)::double as w_mc,
          case when o_orderstatus = 'F' then ((o_orderkey * 31) % 97)::double / 140::double
               else ((o_orderkey * 31) % 97)::double / 97::double end as rnn
        from orders) t)"""

OBJ = """obj as (
  select l_orderkey as id, l_linenumber, l_partkey, l_suppkey, l_quantity,
         row_number() over (partition by l_orderkey
           order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as idx,
         row_number() over (partition by l_orderkey, l_returnflag
           order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as kidx,
         case when l_returnflag = 'A' then 'shot' when l_returnflag = 'R' then 'neutral'
              else 'conv' end as kind,
         case when l_partkey % 97 = 0 then 'NaN'::double
              when l_partkey % 89 = 0 then 'Infinity'::double else l_quantity end as f1,
         l_discount as f2, l_extendedprice / 1000::double as f3,
         l_quantity / 50::double as g1, l_discount * 10::double as g2,
         l_extendedprice / 100000::double as g3
  from lineitem)"""


def _softmax_terms() -> str:
    terms = []
    for c in range(6):
        terms.append(f"exp(((id * {7 + 2 * c} + {13 * c}) % 101)::double / 101::double"
                     f" + case when label = {c} then 0.8::double else 0::double end) as e{c}")
    return ", ".join(terms)


SCORES = f"""scores as (
  select id, label, is_fake, pt, prong, source, w_mc, round(rnn, 6) as rnn,
         {', '.join(f'e{c} / (e0 + e1 + e2 + e3 + e4 + e5) as s{c}' for c in range(6))},
         round(1::double - e0 / (e0 + e1 + e2 + e3 + e4 + e5), 6) as net
  from (select *, {_softmax_terms()} from cand) t)"""

DECODED = """decoded as (
  select *, (case greatest(s0, s1, s2, s3, s4, s5)
             when s0 then 0 when s1 then 1 when s2 then 2 when s3 then 3 when s4 then 4
             else 5 end)::int as pred
  from scores)"""

HISTORY = """history as (
  select (user_id % 5)::int as run, (event_id % 40)::int as epoch, avg(value) as val_loss,
         avg(case when event_type in ('purchase', 'signup') then 1::double else 0::double end)
           as val_acc
  from events group by 1, 2)"""

FILES = """files as (
  select source, file, count(*) as n_rows, min(created) as created
  from (select source, file, o_orderdate as created
        from cand join orders on o_orderkey = id) t
  group by source, file)"""

SPLIT_FILES = """split_files as (
  select source, file, n_rows,
         case when rk <= ceil(n * 0.2::double) then 'test'
              when rk <= ceil(n * 0.2::double)
                     + ceil((n - ceil(n * 0.2::double)) * 0.2::double) then 'val'
              else 'train' end as split
  from (select *, row_number() over (order by substr(md5('42:' || file), 1, 16), file) as rk,
               count(*) over () as n from files) t)"""

PARTS = {"cand": CAND, "obj": OBJ, "scores": SCORES, "decoded": DECODED, "history": HISTORY,
         "files": FILES, "split_files": SPLIT_FILES}
NEEDS = {"scores": ["cand"], "decoded": ["cand", "scores"], "files": ["cand"],
         "split_files": ["cand", "files"]}


def with_parts(parts: str, body: str) -> str:
    """``body`` preceded by the named fixtures and whatever they build on."""
    wanted: list[str] = []
    for part in parts.split():
        for p in [*NEEDS.get(part, []), part]:
            if p not in wanted:
                wanted.append(p)
    body = body.strip()
    ctes = ",\n".join(PARTS[p] for p in wanted)
    if not ctes:
        return body
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"


def r(x: str, places: int = 6) -> str:
    """Rounded, with negative zero folded into zero."""
    return f"(round({x}, {places}) + 0::double)"

"""SQL that states what a pair of verses tells by itself in the second algorithm: overlap, exact and variant
phrases, order, case and identity."""

from __future__ import annotations

from .form_queries import _agreement, _characters
from .pair_sql import r6
from .registry import TOKEN_SQL
from .second_queries import LETTERS, sql2

_SHARE = "round(least(1, ln(1 + {}) / ln(1 + (select longest from l))), 6)"


def _letters(x: str) -> str:
    return rf"length(regexp_replace({x}, '[^\p{{L}}]', '', 'g'))"


def _measure(x: str, y: str, s: str, t: str) -> str:
    """How far two texts with their tokens agree place by place."""
    values = "[1.0, {}, {}, {}, {}]".format(
        _agreement(s, t),
        _agreement(_characters(x, r"[\p{L}]"), _characters(y, r"[\p{L}]")),
        _agreement(_characters(x, r"[^\p{L}\p{N}]"), _characters(y, r"[^\p{L}\p{N}]")),
        _agreement(f"string_split({x}, '')", f"string_split({y}, '')"),
    )
    return r6(f"list_sum(list_transform({values}, lambda x: x * x)) / list_sum({values})")


def _greedy(name: str, rows: str, order: str) -> str:
    """CTEs: of rows (id, i, j, n, value), those taken in an order, none touching another on either side."""
    return f"""{name}_ordered as (select *, row_number() over (partition by id order by {order}) as r from {rows}
), {name}_greedy as (
  select distinct id, cast(0 as bigint) as r, cast([] as bigint[]) as on_a, cast([] as bigint[]) as on_b, cast([] as bigint[]) as taken from {name}_ordered
  union all
  select id, r, case when free then list_concat(on_a, range(i, i + n)) else on_a end, case when free then list_concat(on_b, range(j, j + n)) else on_b end,
    case when free then list_append(taken, r) else taken end
  from (
    select g.id, o.r, o.i, o.j, o.n, on_a, on_b, taken, not list_has_any(on_a, range(o.i, o.i + o.n)) and not list_has_any(on_b, range(o.j, o.j + o.n)) as free
    from {name}_greedy g join {name}_ordered o on o.id = g.id and o.r = g.r + 1)
), {name} as (
  select o.*, {_SHARE.format(_letters("substr(p.display_text, p.cs[i + 1] + 1, p.ce[i + n] - p.cs[i + 1])"))} as weight
  from (select id, unnest(taken) as r from (select id, arg_max(taken, r) as taken from {name}_greedy group by id)) join {name}_ordered o using (id, r), source p
)"""


MEASURES = sql2(
    rf""", l as (select max({LETTERS}) as longest from vocab
), gap as (
  select id, position, sum(length(gap)) over (partition by id order by position rows unbounded preceding) as gapped
  from (select id, unnest(g) as gap, generate_subscripts(g, 1) - 1 as position
    from (select id, regexp_split_to_array(display_text, '{TOKEN_SQL}') as g from v where display_text is not null))
), placed as (
  select tok.*, cast(sum(length(surface)) over (partition by id order by position rows unbounded preceding) - length(surface) + gapped as int) as cs from tok join gap using (id, position)
), verse as (
  select id, t.label, any_value(v.display_text) as display_text, list(t.folded order by position) as f, list(surface order by position) as s, list(cs order by position) as cs,
    list(cs + length(surface) order by position) as ce, list({_SHARE.format(_letters("t.folded"))} order by position) as w
  from placed t join v using (id) group by id, t.label
), source as (select * from verse where id = (select id from v order by verse_id limit 1)
), pair as materialized (
  select b.id, b.label, b.f as b, b.s as bs, b.w as bw, b.cs as bcs, b.ce as bce, b.display_text as btext, a.f as a, a.s as s, a.w as w, a.cs, a.ce, a.display_text as atext
  from source a join verse b on b.id <> a.id and list_has_any(a.f, b.f)
), counted as (
  select id, folded, count(*) as n, any_value({_SHARE.format(_letters("folded"))}) as tw from tok group by id, folded
), whole as (select id, sum(n * tw) as whole from counted group by id
), dice as (
  select c.id, least(1, 2 * sum(least(c.n, k.n) * c.tw) / any_value(x.whole + y.whole)) as jaccard
  from counted c join counted k on k.folded = c.folded and k.id = (select id from source) join whole x on x.id = c.id join whole y on y.id = k.id where c.id <> k.id group by c.id
), met as (
  select p.id, i, j from pair p, range(0, 200) as x(i), range(0, 200) as y(j) where i < len(a) and j < len(b) and a[i + 1] = b[j + 1]
), island as (select *, i - row_number() over (partition by id, j - i order by i) as island from met
), run as (select id, i, j, max(i) over (partition by id, j - i, island) - i + 1 as n from island
), sliced as (
  select r.*, m, lower(substr(atext, cs[i + 1] + 1, ce[i + m] - cs[i + 1])) = lower(substr(btext, bcs[j + 1] + 1, bce[j + m] - bcs[j + 1])) as same
  from run r join pair using (id), range(2, 200) as x(m) where n >= 2 and m <= n
), cut as (select id, i, j, n, coalesce(max(m) filter (same), 0) as same from sliced group by id, i, j, n
), exact_run as (select id, i, j, same as n, 1.0 as value from cut where same > 0
), variant_run as (
  select id, i, j, n, {_measure("x", "y", "xs", "ys")} as value
  from (
    select id, i, j, n, substr(atext, cs[i + 1] + 1, ce[i + n] - cs[i + 1]) as x, substr(btext, bcs[j + 1] + 1, bce[j + n] - bcs[j + 1]) as y,
      list_slice(s, i + 1, i + n) as xs, list_slice(bs, j + 1, j + n) as ys
    from cut join pair using (id) where same <> n)
), {_greedy("exact", "exact_run", "n desc, i, j")}, {_greedy("variant", "variant_run", "n desc, value desc, i, j")}, cell as (
  select id, 0 as i, j, cast(0 as double) as best from pair, range(0, 200) as x(j) where j <= len(b)
  union all
  select id, i + 1, j, max(best) over (partition by id order by j rows unbounded preceding)
  from (
    select c.id, c.i, c.j, greatest(best, case when c.j > 0 and a[c.i + 1] = b[c.j] then lag(best) over (partition by c.id order by c.j) + w[c.i + 1] else -1 end) as best
    from cell c join pair using (id) where c.i < len(a))
), near as materialized (
  select *, lag(above) over (partition by id, i order by j) as diagonal, lag(best) over (partition by id, i order by j) as before
  from (select *, lag(best) over (partition by id, j order by i) as above from cell)
), move as materialized (
  select id, i, j, a[i] = b[j] and abs(best - diagonal - w[i]) < 1e-12 as hit, above >= before as left_out from near join pair using (id) where i > 0 and j > 0
), walk as (
  select id, len(a) as i, len(b) as j, cast([] as bigint[][]) as places from pair
  union all
  select k.id, case when hit or left_out then k.i - 1 else k.i end, case when hit or not left_out then k.j - 1 else k.j end,
    case when hit then list_prepend(cast([k.i - 1, k.j - 1] as bigint[]), places) else places end
  from walk k join move m on m.id = k.id and m.i = k.i and m.j = k.j
), ended as (select id, arg_min(places, i + j) as places from walk group by id
), aligned as (
  select id, t[1] as i, t[2] as j, w[t[1] + 1] as weight, 1 - abs(t[1] / greatest(1, len(a) - 1) - t[2] / greatest(1, len(b) - 1)) as near,
    regexp_extract_all(s[t[1] + 1], '[\p{{L}}]') as x, regexp_extract_all(bs[t[2] + 1], '[\p{{L}}]') as y,
    t[1] - lag(t[1]) over o - 1 as gap_a, t[2] - lag(t[2]) over o - 1 as gap_b
  from (select id, unnest(places) as t from ended) join pair using (id) window o as (partition by id order by t[1])
), summed as (
  select id, count(*) as n, sum(weight) as matched, sum(weight * near) / sum(weight) as position, coalesce(sum(abs(gap_a - gap_b)), 0) as apart,
    count(*) filter (gap_a = 0 and gap_b = 0) as joined,
    sum(weight * (case when len(x) = 0 or len(y) = 0 then 0.0 else
      {r6("len(list_filter(range(1, least(len(x), len(y)) + 1), lambda k: (x[k] = upper(x[k])) = (y[k] = upper(y[k])))) / greatest(len(x), len(y))")} end)) / sum(weight) as capitalization
  from aligned group by id
), first as (
  select id, word, list_position(a, word) as at_a, list_position(b, word) as at_b from (select id, a, b, unnest(list_distinct(list_intersect(a, b))) as word from pair)
), turned as (
  select x.id, count(*) filter (x.at_a < y.at_a) as n_pairs, count(*) filter (x.at_a < y.at_a and x.at_b > y.at_b) as against from first x join first y on x.id = y.id group by x.id
), most as (select greatest(1, max(len(f)) - 1) as most from verse
), ordered as (
  select id, list_transform([coverage, position, case when n_pairs > 0 then (1 + ln((n_pairs + 1) / (against + 1))) / (1 + ln(n_pairs + 1)) else coverage end,
      case when n > 1 then (1 + ln((most + 1) / (least(apart, most) + 1))) / (1 + ln(most + 1)) else coverage end,
      case when n > 1 then (1 + joined) / n else coverage end], lambda x: {r6("least(1, greatest(0, x))")}) as v, capitalization
  from (select s.*, least(1, 2 * matched / (list_sum(w) + list_sum(bw))) as coverage from summed s join pair using (id)) join turned using (id), most
), phrase as (select id, 1 - product(1 - weight) as phrase, count(*) as phrase_count from exact group by id
), variants as (select id, 1 - product(1 - weight * value) as phrase_variant, count(*) as variant_count from variant group by id)
select label, {r6("jaccard")} as jaccard, {r6("least(1, coalesce(phrase, 0))")} as phrase, {r6("least(1, coalesce(phrase_variant, 0))")} as phrase_variant,
  v[1] as ordered_coverage, v[2] as relative_position, v[3] as pair_direction, v[4] as gap_agreement, v[5] as continuity,
  {r6("list_sum(list_transform(v, lambda x: x * x)) / list_sum(v)")} as ordering, {r6("capitalization")} as capitalization,
  coalesce(phrase_count, 0) as phrase_count, coalesce(variant_count, 0) as variant_count,
  case when a = b then {_measure("atext", "btext", "s", "bs")} else 0 end as identity_score
from pair join dice using (id) join ordered using (id) left join phrase using (id) left join variants using (id)"""
).replace("with ", "with recursive ", 1)

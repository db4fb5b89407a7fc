"""SQL that states the evidence between verses: greedy phrases and alignment by recursion, scores and rankings."""

from __future__ import annotations

from .registry import CORPUS_SQL, TOKEN_SQL

#: Places of text between tokens after which a sentence begins.
ENDS_SQL = r"""[.!?][\s\])}"''’]*$"""


def r6(x: str) -> str:
    """Six places, halves up."""
    return f"floor(({x} + 2.220446049250313e-16) * 1e6 + 0.5) / 1e6"


def evidence(sources: str, pairs: str | None = None) -> str:
    """CTEs up to `scored`, a row a pair of a source and another verse with all evidence.

    sources: a condition on v that picks the source verses, or a query of their ids. pairs: a query of
    (sid, id); without one, each source is paired with all verses that share a word with it.
    """
    met = pairs or "select distinct s.id as sid, t.id from tok s join tok t on t.folded = s.folded and t.id <> s.id where s.id in (select id from p)"
    return f"""with recursive {CORPUS_SQL}, p as ({sources}
), gap as (
  select id, unnest(g) as gap, generate_subscripts(g, 1) - 1 as position
  from (select id, regexp_split_to_array(display_text, '{TOKEN_SQL}') as g from v where display_text is not null)
), verse_arrays as (
  select t.id, list(surface order by position) as s, list(t.folded order by position) as f, list(t.normalized order by position) as m,
    list(position = 0 or regexp_matches(gap, '{ENDS_SQL}') order by position) as begins, list(stats.idf order by position) as idf
  from tok t join gap using (id, position) join stats using (normalized) group by t.id
), cand as ({met}
), word as (
  select id, folded, any_value(normalized) as normalized, any_value(idf) as idf, any_value(document_frequency) as df, min(position) as first
  from tok join stats using (normalized) group by id, folded
), total as (select id, sum(idf) as total from word group by id
), common as (
  select c.sid, c.id, sum(a.idf) as common, count(*) as shared,
    sum(case when a.df <= (select rare_threshold from scalars) then a.idf else 0 end) as rare,
    list(a.folded order by a.first) as matched,
    list(a.folded || ' ' || a.df order by a.first) filter (a.df <= (select rare_threshold from scalars)) as rare_words
  from cand c join word a on a.id = c.sid join word b on b.id = c.id and b.folded = a.folded group by c.sid, c.id
), met as (
  select c.sid, c.id, a.position as i, b.position as j from cand c join tok a on a.id = c.sid join tok b on b.id = c.id and b.folded = a.folded
), island as (select *, i - row_number() over (partition by sid, id, j - i order by i) as island from met
), run as (
  select sid, id, i, j, max(i) over (partition by sid, id, j - i, island) - i + 1 as n from island
), ordered as (
  select *, row_number() over (partition by sid, id order by n desc, i, j) as r from run where n >= 2
), greedy as (
  select distinct sid, id, cast(0 as bigint) as r, cast([] as bigint[]) as on_a, cast([] as bigint[]) as on_b, cast([] as bigint[][]) as taken from ordered
  union all
  select sid, id, r, case when free then list_concat(on_a, range(i, i + n)) else on_a end, case when free then list_concat(on_b, range(j, j + n)) else on_b end,
    case when free then list_append(taken, cast([i, j, n] as bigint[])) else taken end
  from (
    select g.sid, g.id, o.r, o.i, o.j, o.n, on_a, on_b, taken,
      not list_has_any(on_a, range(o.i, o.i + o.n)) and not list_has_any(on_b, range(o.j, o.j + o.n)) as free
    from greedy g join ordered o on o.sid = g.sid and o.id = g.id and o.r = g.r + 1)
), chosen as (
  select sid, id, unnest(taken) as t from (select sid, id, arg_max(taken, r) as taken from greedy group by sid, id)
), phrase as (
  select c.sid, c.id, t[1] as i, t[2] as j, t[3] as n,
    case when list_slice(a.s, t[1] + 1, t[1] + t[3]) = list_slice(b.s, t[2] + 1, t[2] + t[3]) then 1.0 else 0.8 end as factor
  from chosen c join verse_arrays a on a.id = c.sid join verse_arrays b on b.id = c.id
), phrases as (
  select sid, id, least(1, sum(n * n * factor) / 25) as phrase, max(factor) as tier,
    list(i || ' ' || j || ' ' || n || ' ' || case when factor = 1 then 'case_exact' else 'case_folded' end order by i) as phrases
  from phrase group by sid, id
), walk as (
  select c.sid, c.id, cast(0 as bigint) as i, cast(0 as bigint) as behind, cast([] as bigint[][]) as pairs from cand c
  union all
  select sid, id, i + 1, case when hit > 0 then behind + hit else behind end,
    case when hit > 0 then list_append(pairs, cast([i, behind + hit - 1] as bigint[])) else pairs end
  from (
    select w.sid, w.id, w.i, w.behind, w.pairs, coalesce(list_position(list_slice(b.f, w.behind + 1, len(b.f)), a.f[w.i + 1]), 0) as hit
    from walk w join verse_arrays a on a.id = w.sid join verse_arrays b on b.id = w.id where w.i < len(a.f))
), aligned as (
  select w.sid, w.id, len(a.f) as len_a, len(b.f) as len_b, unnest(w.pairs) as t
  from walk w join verse_arrays a on a.id = w.sid join verse_arrays b on b.id = w.id where w.i = len(a.f)
), place as (
  select x.sid, x.id, t[1] as i, t[2] as j, a.idf[t[1] + 1] as weight, a.s[t[1] + 1] = b.s[t[2] + 1] as same, a.s[t[1] + 1] as surface,
    case when a.s[t[1] + 1] = b.s[t[2] + 1] then case when a.begins[t[1] + 1] or b.begins[t[2] + 1] then 0.5 else 1.0 end
      when a.begins[t[1] + 1] <> b.begins[t[2] + 1] then 0.25 else 0.0 end as multiplier,
    abs((t[1] - lag(t[1]) over k) / greatest(1, len_a - 1) - (t[2] - lag(t[2]) over k) / greatest(1, len_b - 1)) as apart
  from aligned x join verse_arrays a on a.id = x.sid join verse_arrays b on b.id = x.id window k as (partition by x.sid, x.id order by t[1])
), alignment as (
  select sid, id, count(*) as n, coalesce(avg(apart), 0) as apart, sum(weight * multiplier) / sum(weight) as capitalization,
    bool_or(same) as exact, list(distinct lower(surface)) filter (same) as surfaces
  from place group by sid, id
), part as (
  select c.sid, c.id, coalesce(greatest(0, least(1, common / (a.total + b.total - common))), 0) as jaccard, coalesce(h.phrase, 0) as phrase,
    coalesce(least(1, o.rare / 12), 0) as rare, coalesce(least(1, n / shared * (1 / (1 + apart))), 0) as ordering,
    coalesce(capitalization, 0) as capitalization, coalesce(matched, []) as matched_normalized, coalesce(h.phrases, []) as phrases,
    coalesce(rare_words, []) as rare_tokens, coalesce(exact, false) as exact, coalesce(surfaces, []) as surfaces, tier
  from cand c left join total a on a.id = c.sid left join total b on b.id = c.id left join common o on o.sid = c.sid and o.id = c.id
    left join phrases h on h.sid = c.sid and h.id = c.id left join alignment l on l.sid = c.sid and l.id = c.id
), scored as (
  select sid, id, {r6("0.4 * jaccard + 0.2 * phrase + 0.15 * rare + 0.1 * ordering + 0.1 * capitalization")} as score,
    {", ".join(f"{r6(x)} as {x}" for x in ("jaccard", "phrase", "rare", "ordering", "capitalization"))},
    matched_normalized, phrases, rare_tokens, exact, surfaces,
    list_filter([case when len(matched_normalized) > 0 then 'shared_nonzero_token' end, case when tier = 1 then 'shared_exact_phrase'
      when tier < 1 then 'shared_case_folded_phrase' end], lambda x: x is not null) as reasons,
    list_filter([case when exact then 'exact_word' end, case when len(matched_normalized) > 0 then 'normalized_word' end,
      case when len(phrases) > 0 then 'exact_phrase' end, case when len(rare_tokens) > 0 then 'rare_word' end,
      case when ordering > 0 then 'word_order' end], lambda x: x is not null) as evidence_types
  from part
), ranked as (
  select a.label as reference, b.label, b.book, b.book_order, s.*, row_number() over (
      partition by sid order by score desc, phrase desc, rare desc, jaccard desc, b.book_order, b.chapter, b.verse) as rank
  from scored s join v a on a.id = s.sid join v b on b.id = s.id
)
"""


PROBE = "select * from v order by verse_id limit 1"
PROBES = "select * from v order by verse_id limit 2"
FULL = "rank, label, score, jaccard, phrase, rare, ordering, capitalization, matched_normalized, phrases, rare_tokens, reasons"

RELATED_FULL = f"{evidence(PROBE)} select {FULL} from ranked where rank <= 50"
RELATED_REASONS = f"{evidence(PROBE)} select {FULL} from ranked where rank <= 50 and score >= 0.2 and list_contains(reasons, 'shared_exact_phrase')"
RELATED_MANY = f"{evidence(PROBES)} select reference, rank, label, score from ranked where rank <= 5"
RELATED_BOOKS = f"""{evidence(PROBE, "select distinct s.id as sid, t.id from tok s join tok t on t.folded = s.folded and t.id <> s.id where s.id in (select id from p) and t.book_order in (1, 2, 3)")}
select {FULL} from ranked where rank <= 20"""
COMPARE_PAIRS = f"""{evidence(PROBES, "select a.id as sid, b.id from p a join p b on b.verse_id > a.verse_id")}
select reference as "left", label as "right", score, jaccard from ranked"""
CANDIDATE_MATES = f"{evidence(PROBE)} select rank, label, score, evidence_types from ranked where rank <= 20"
LEXICAL_WITNESSES = f"""{evidence(PROBE)}, best as (
  select *, row_number() over (partition by book_order order by rank) as r from ranked
  where rank <= 100 and book_order <> (select book_order from p)
), w as (select row_number() over (order by rank) as witness, label, score from best where r = 1 order by rank limit 3)
select witness, label, score, (select count(*) from w) = 3 as complete from w"""
_GRAPH = f"""{evidence(PROBE)}, top as (select * from ranked where rank <= 12
), term as (
  select term, row_number() over (order by coalesce(idf, 0) desc, term) as place
  from (select distinct unnest(matched_normalized) as term from top) left join stats on stats.normalized = term
), shown as (select term from term where place <= least(12, 39 - (select count(*) from top))
)"""
GRAPH_NODES = f"""{_GRAPH}
select 'verse:' || label as node, 'verse' as kind, label, display_text, 'source' as role, id as canonical_order from p
union all select 'verse:' || top.label, 'verse', top.label, v.display_text, 'result', v.id from top join v using (id)
union all select 'term:' || term, 'term', term, null, 'evidence_term', null from shown"""
GRAPH_EDGES = f"""{_GRAPH}, e as (
  select 'edge:' || reference || '->' || label as edge, 'verse:' || reference as source, 'verse:' || label as target, reference as source_label,
    label as target_label, evidence_types, 'score:' || reference || '->' || label as explanation_id, score from top
  union all
  select 'edge:term:' || l || '->' || term, 'verse:' || l, 'term:' || term, l, term, [case when exact then 'exact_word' else 'normalized_word' end],
    'term:' || l || '->' || term, null
  from (
    select term, (select label from p) as l, list_contains((select list(normalized) from tok where id in (select id from p)), term) as exact from shown
    union all select term, label, list_contains(surfaces, term) from (select label, surfaces, unnest(matched_normalized) as term from top) join shown using (term))
)
select edge, source, target, source_label, target_label, evidence_types, explanation_id, score,
  array_to_string(list_transform(evidence_types, lambda t: replace(t, '_', ' ')), ', ') as summary from e"""
#: Every verse whose verse_id is divisible by 50 is a source.
_EVERY = evidence("select * from v where verse_id % 50 = 0")
EVERY_FULL = f"{_EVERY} select reference, {FULL} from ranked where rank <= 50"
EVERY_MANY = f"{_EVERY} select reference, rank, label, score from ranked where rank <= 5"
EVERY_MATES = f"{_EVERY} select reference, rank, label, score, evidence_types from ranked where rank <= 20"
EVERY_WITNESSES = f"""{_EVERY}, best as (
  select *, row_number() over (partition by sid, book_order order by rank) as r from ranked where rank <= 100
    and book_order <> (select book_order from v where v.id = sid)
), w as (select *, row_number() over (partition by sid order by rank) as witness, count(*) over (partition by sid) as n from best where r = 1)
select reference, witness, label, score, n >= 3 as complete from w where witness <= 3"""

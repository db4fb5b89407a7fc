"""Queries over word forms, with their SQL."""

from __future__ import annotations

from ..operators import second, word_forms
from .pair_sql import r6
from .registry import WORD
from .second_queries import LETTERS, at, on, sql2
from .study import PROBE_SQL


def _forms(word: str) -> str:
    """A SQL list of what a word may come from."""
    rules = [f"case when length({word}) > 4 and right({word}, 3) in ('ies', 'ied') then left({word}, -3) || 'y' end"]
    for x in word_forms.STRIPPED:
        fits = f"right({word}, {len(x)}) = '{x}' and length({word}) > {len(x) + 1}"
        rules.append(f"case when {fits} then left({word}, -{len(x)}) end")
        if x in ("ing", "ed"):
            rules.append(f"case when {fits} then left({word}, -{len(x)}) || 'e' end")
            n = len(x)
            rules.append(f"case when {fits} and length({word}) > {n + 2} and {word}[-{n + 1}] = {word}[-{n + 2}] then left({word}, -{n + 1}) end")
    return f"list_sort(list_distinct(list_concat([{word}], list_filter([{', '.join(rules)}], lambda x: x is not null and length(x) >= 2))))"


def _having(word: str, affixes: list[str], test: str) -> str:
    return f"list_filter([{', '.join(repr(x) for x in affixes)}], lambda x: {test}({word}, x) and length({word}) > length(x) + 1)"


def _segment(kind: str, fragment: str) -> str:
    return f"select term, '{kind}' as kind, {fragment} as fragment from u"


_MEASURES = rf""", l as (select max({LETTERS}) as longest from vocab
), u as (
  select folded as term, verses, '{WORD}' as w, regexp_replace(folded, '[^\p{{L}}\p{{N}}]', '', 'g') as bare from vocab
), m as (
  select *,
    coalesce(list_max(list_filter(range(1, least(length(w), length(term)) + 1), lambda k: left(w, k) = left(term, k))), 0) as prefix,
    coalesce(list_max(list_filter(range(1, least(length(w), length(term)) + 1), lambda k: right(w, k) = right(term, k))), 0) as suffix,
    -- the function counts bytes
    levenshtein(w, regexp_replace(term, '[^\x00-\x7f]', '~', 'g')) as edits
  from u
), sub as (
  select term, arg_min(piece, (-length(piece), a)) as longest_piece, max(length(piece)) as substring from (
    select u.term, a, substr(w, a, n) as piece from u, range(1, {len(WORD) + 1}) as x(a), range(1, {len(WORD) + 1}) as y(n) where a + n <= {len(WORD) + 1})
  where contains(term, piece) group by term
), pick as (
  select k, list_filter(range(1, {len(WORD) + 1}), lambda i: (k >> (i - 1)) & 1 = 1) as places from range(1, {2 ** len(WORD)}) as x(k)
), ordered as (
  select term, max(len(places)) as in_order from u, pick
  where regexp_matches(term, array_to_string(list_transform(places, lambda i: substr(w, i, 1)), '.*')) group by term
), anyhow as (
  select term, cast(sum(least(n, length(term) - length(replace(term, c, '')))) as int) as in_any_order
  from u, (select c, count(*) as n from (select unnest(string_split('{WORD}', '')) as c) group by c) group by term
), piece as (
  select term, 1 as o, 'punctuation_folded_form' as kind, bare as fragment from u where bare = w and term <> w
  union all select term, 2, 'punctuation_component', w from u where list_contains(regexp_split_to_array(term, '[\p{{P}}\p{{S}} ]+'), w)
  union all select term, 3, 'shared_initial_segment', left(w, prefix) from m
  union all select term, 4, 'shared_terminal_segment', right(w, suffix) from m
  union all select term, 5, 'shared_internal_segment', longest_piece from sub
), rated as (
  select p.term, o, kind, round(greatest(0, least(1,
      round(least(1, ln(1 + length(regexp_replace(fragment, '[^\p{{L}}]', '', 'g'))) / ln(1 + greatest(length(w), greatest(1, length(bare))))), 6)
      * sqrt(n / length(w) * (n / greatest(1, length(bare)))) * (length(fragment) / (length(fragment) + edits)))), 6) as score
  from (select *, length(regexp_replace(fragment, '[^\p{{L}}\p{{N}}]', '', 'g')) as n from piece) p join m using (term) where n > 0
), best as (
  select term, arg_max(kind, (score, -o)) as kind, max(score) as score from rated where score > 0 group by term
), shares as (
  select m.term, unnest([
      {{'o': 1, 'k': 'raw_prefix', 'n': prefix}}, {{'o': 2, 'k': 'raw_suffix', 'n': suffix}}, {{'o': 3, 'k': 'raw_substring', 'n': coalesce(substring, 0)}},
      {{'o': 4, 'k': 'ordered_letters', 'n': coalesce(in_order, 0)}}, {{'o': 5, 'k': 'unordered_letters', 'n': in_any_order}}]) as s
  from m left join sub using (term) left join ordered using (term) join anyhow using (term)
), letter as (
  -- the first of the kinds that is best, by the rounded score of the one before
  select term, s.k as letter_kind, s.n / greatest(length(term), {len(WORD)}) * ln(1 + s.n) / ln(1 + longest) as score, s.o
  from shares, l where s.n > 0
), letters as (
  select term, arg_max(letter_kind, (round(score, 6), case when score > round(score, 6) then o else -o end)) as letter_kind, max(round(score, 6)) as letters from letter group by term
), measures as (
  select m.term, verses, prefix, suffix, coalesce(substring, 0) as substring, coalesce(in_order, 0) as in_order, in_any_order, edits,
    coalesce(best.score, 0) as morphology, best.kind, coalesce(letters, 0) as letters, letter_kind
  from m left join sub using (term) left join ordered using (term) join anyhow using (term) left join best using (term) left join letters using (term)
)"""

FORMS = {
    "word_forms": (
        on(word_forms.word_forms),
        sql2(
            f"""select folded as word, {_forms("folded")} as lemmas,
  {_having("folded", word_forms.BEGINNINGS, "starts_with")} as prefixes, {_having("folded", word_forms.ENDS, "ends_with")} as suffixes from vocab"""
        ),
    ),
    "word_compounds": (
        on(word_forms.compounds),
        sql2(
            f""", s as (
  select folded as word, left(folded, k) as left_part, substr(folded, k + 1) as right_part from (select folded, unnest(range(1, length(folded))) as k from vocab)
), r as (
  select word, left_part, right_part, unnest({_forms("right_part")}) as root from s where left_part in (select folded from vocab)
)
select * from r where root in (select folded from vocab)"""
        ),
    ),
    "shared_rarity": (
        at(lambda s, r: word_forms.shared_rarity(s.corpus, r)),
        sql2(
            f"""{PROBE_SQL}, l as (select max(n) as most, min(n) as least, (select count(*) from v) as size from vocab
), w as (
  select folded, round(greatest(0, least(1, (1 + ln((most + 1) / (n + 1))) / (1 + ln((most + 1) / (least + 1))))), 6) as rarity,
    round(greatest(0, least(1, ln(1 + {LETTERS}) / ln(19))), 6) as length_value, ln((size + 1) / (verses + 1)) + 1 as idf
  from vocab, l
), k as (
  select folded, rarity * rarity * length_value as rare, pow(idf / (select max(idf) from w), 2) as weighty
  from w where folded in (select folded from tok where id in (select id from p))
), d as (select distinct id, label, folded from tok where id not in (select id from p))
select label, count(*) as shared, {r6("least(1, sum(rare) / 2)")} as concentration, {r6("least(1, sum(weighty) / 3)")} as continuous
from d join k using (folded) group by label"""
        ),
    ),
    "fragment_rarity": (
        on(word_forms.fragment_rarity),
        sql2(
            f""", f as (
  select folded, substr(folded, a, b - a + 1) as fragment,
    case when a = 1 and b = length(folded) then 'whole' when a = 1 then 'initial' when b = length(folded) then 'terminal' else 'internal' end as position
  from (select folded, a, unnest(range(a, length(folded) + 1)) as b from (select folded, unnest(range(1, length(folded) + 1)) as a from vocab))
), c as (
  select position, fragment, count(distinct folded) as words from (select * from f union all select folded, fragment, 'any' from f) group by position, fragment
), s as (select count(*) as size from vocab)
select position, fragment, {r6("ln((size + 1) / (words + 1)) / ln(size + 1)")} as rarity from c, s"""
        ),
    ),
    "word_measures": (
        on(lambda c: word_forms.word_measures(c, WORD)),
        sql2(f"{_MEASURES} select term, prefix, suffix, substring, in_order, in_any_order, edits, morphology, kind, letters, letter_kind from measures"),
    ),
}


def _agreement(a: str, b: str) -> str:
    """The share of places in which two SQL lists agree, of the longer one's."""
    return f"case when greatest(len({a}), len({b})) = 0 then 1.0 else len(list_filter(range(1, least(len({a}), len({b})) + 1), lambda k: {a}[k] = {b}[k])) / greatest(len({a}), len({b})) end"


def _characters(text: str, pattern: str) -> str:
    return f"regexp_extract_all({text}, '{pattern}')"


FORMS |= {
    "near_phrases": (
        at(lambda s, r: s.near_phrases(r)),
        sql2(
            f"""{PROBE_SQL}, arrays as (select id, label, list(folded order by position) as f from tok group by id, label
), pairs as (
  select b.id, b.label, a.f as a, b.f as b, least(len(a.f), len(b.f)) as shortest from arrays a join p on p.id = a.id join arrays b on b.id <> a.id and list_has_any(a.f, b.f)
), most as (select greatest(1, max(len(f)) - 1) as most from arrays
), span as (
  -- a span of one word, then each word behind the first place after the last one's
  select id, i, 1 as n, list_position(b, a[i + 1]) as last, list_position(b, a[i + 1]) as first, 0 as gap
  from pairs, range(0, 200) as x(i) where i < len(a) and list_contains(b, a[i + 1])
  union all
  select id, i, n + 1, last + hit, first, gap + hit - 1
  from (select s.*, coalesce(list_position(list_slice(b, last + 1, len(b)), a[i + n + 1]), 0) as hit from span s join pairs using (id) where i + n < len(a)) where hit > 0
), valued as (
  select id, i, n, first, gap, round(ln(1 + n) / ln(1 + greatest(1, shortest)) * ((1 + ln((most + 1) / (least(gap, most) + 1))) / (1 + ln(most + 1))), 6) as value
  from span join pairs using (id), most
), ordered as (select *, row_number() over (partition by id order by value desc, n desc, i) as r from valued
), greedy as (
  select distinct id, cast(0 as bigint) as r, cast([] as bigint[]) as used, cast([] as bigint[]) as taken from ordered
  union all
  select id, r, case when free then list_concat(used, range(i, i + n)) else used end, case when free then list_append(taken, r) else taken end
  from (select g.id, o.r, o.i, o.n, used, taken, not list_has_any(used, range(o.i, o.i + o.n)) as free from greedy g join ordered o on o.id = g.id and o.r = g.r + 1)
), chosen as (select id, unnest(taken) as r from (select id, arg_max(taken, r) as taken from greedy group by id))
select label, i as source_start, first - 1 as target_start, n as length, gap, value from chosen join ordered using (id, r) join pairs using (id)"""
        ).replace("with ", "with recursive ", 1),
    ),
    "identity_measures": (
        on(second.identity_measures),
        sql2(
            rf""", k as (
  select id, label, display_text, list(surface order by position) as s, string_agg(folded, chr(31) order by position) as key from tok join v using (id, label) group by id, label, display_text
), f as (select key, min(id) as first from k group by key having count(*) > 1
), m as (
  select b.label, a.label as first, [{_agreement("a.s", "b.s")},
    {_agreement(_characters("a.display_text", r"[\p{L}]"), _characters("b.display_text", r"[\p{L}]"))},
    {_agreement(_characters("a.display_text", r"[^\p{L}\p{N}]"), _characters("b.display_text", r"[^\p{L}\p{N}]"))},
    {_agreement("string_split(a.display_text, '')", "string_split(b.display_text, '')")}, 1.0] as values
  from f join k a on a.id = f.first join k b on b.key = f.key and b.id <> a.id)
select label, first, {r6("list_sum(list_transform(values, lambda x: x * x)) / list_sum(values)")} as score from m"""
        ),
    ),
}

#: The words most like one, with the first three verses of each.
WORD_FAMILY = sql2(
    f"""{_MEASURES}, s as (
  select term, verses, case when term = '{WORD}' then 'exact_word' when morphology > 0 then kind else letter_kind end as kind,
    case when term = '{WORD}' then 'exact' when morphology > 0 then 'morphology' else 'letters' end as tier,
    case when term = '{WORD}' then 1.0 else {r6("(morphology * morphology + letters * letters) / (morphology + letters)")} end as score
  from measures where morphology + letters > 0
), r as (
  select *, row_number() over (order by score desc, term) as rank from s order by rank limit 60
), e as (
  select folded as term, list(label order by id) as examples from (
    select folded, id, label, row_number() over (partition by folded order by id) as n from (select distinct folded, id, label from tok))
  where n <= 3 group by folded)
select rank, term, score, kind, tier, verses, examples from r join e using (term)"""
)

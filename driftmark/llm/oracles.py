"""DuckDB SQL for the operators that SQL can express (the others are loops or models; tests hold them against brute force)."""

from __future__ import annotations

from . import licenses, mixing, quality, secrets, whitening
from .chat import ORACLE_SQL as _CHAT

_BLANK_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_ALNUM_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quality() -> str:
    names = list(quality.GRIDS)
    cells = " union all ".join(f"select '{f}' as name, unnest({list(grid)}) as cutoff" for f, grid in quality.GRIDS.items())
    value = " ".join(f"when '{f}' then {f}" for f in names)
    above = " or ".join(f"coalesce({f} > cut_{f}, false)" for f in names)
    firsts = ", ".join(f"any_value({f}) as {f}" for f in names)
    cuts = ", ".join(f"max(best.cutoff) filter (where name = '{f}') as cut_{f}" for f in names)
    places = ", ".join(f"max(place) filter (where name = '{f}') as place_{f}" for f in names)
    rejected = ", ".join(f"case when {f} > cut_{f} then place_{f} end" for f in names)
    taken = ", ".join(f"case when place_{f} <= depth then cut_{f} end as cut_{f}" for f in names)
    return rf"""
with d as (
  select row_number() over () as r, doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as t, {_BLANK_WORDS.format("coalesce(text, '')")} as w from documents
), places as (
  select r, i, array_to_string(w[i:i+2], ' ') as gram from (select r, w, unnest(range(1, len(w) - 1)) as i from d)
), twice as (
  select r, i from (select r, i, count(*) over (partition by r, gram) as n from places) where n > 1
), repeated as (
  select r, count(distinct i + o) as n from twice, (select unnest([0, 1, 2]) as o) group by r
), counts as (
  select d.r, doc_id, stratum, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
    coalesce(n, 0) as n_repeat_words, length(regexp_replace(t, '[^A-Z]', '', 'g')) as n_capitals, t
  from d left join repeated using (r)
), base as (
  select *, len(lines) as n_lines, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from counts
), stats as (
  select *, floor(n_symbols * 1000 / nullif(word_chars, 0)) as symbols, floor(n_dup_lines * 1000 / nullif(n_lines, 0)) as dup_lines, floor(n_repeat_words * 1000 / nullif(n_words, 0)) as repeats,
    floor(n_capitals * 1000 / nullif(word_chars, 0)) as capitals, floor(word_chars * 10 / nullif(n_words, 0)) as word_length
  from base
), marks as (
  select doc_id, min(quality) as quality from labels where doc_id is not null and quality is not null group by doc_id
), seen as (
  select stats.*, quality from stats join marks using (doc_id) where not base_failed
), trials as (
  select stratum, t, min(quality) as quality, left(md5(cast(min(doc_id) as varchar)), 1) < '8' as certifies, {firsts}
  from seen where doc_id in (select doc_id from seen group by doc_id having count(distinct t) = 1) group by stratum, t
), cells as ({cells}), best as (
  select stratum, name, max({{'gain': gain, 'cutoff': cutoff}}) as best from (
    select stratum, name, cutoff, count(*) filter (where quality = 0 and case name {value} end > cutoff) - {quality.PRICE} * count(*) filter (where quality = 1 and case name {value} end > cutoff) as gain
    from trials, cells where not certifies group by all
  ) where gain > 0 group by all
), ranked as (
  select *, row_number() over (partition by stratum order by best.gain desc, name) as place from best
), proposed as (
  select stratum, {cuts}, {places} from ranked group by stratum
), held as (
  select stratum, least({rejected}) as rejected from trials join proposed using (stratum) where certifies and quality = 1
), rules as (
  select stratum, i, count(*) as n, count(*) filter (where rejected <= i) as k from held, (select unnest(range(1, {len(names) + 1})) as i) group by all
), tested as (
  select stratum, i, case when k > n * {quality.RISK} then 1.0 else
    list_sum(list_transform(range(0, k + 1), lambda x: exp(lgamma(n + 1) - case when x > 0 then lgamma(x + 1) else 0 end - case when n > x then lgamma(n - x + 1) else 0 end + x * ln({quality.RISK}) + (n - x) * ln(1 - {quality.RISK})))) end as p
  from rules
), depths as (
  select stratum, coalesce(min(i) filter (where p > {quality.DELTA} / (select count(distinct stratum) from trials)) - 1, {len(names)}) as depth from tested group by stratum
), cuts as (
  select stratum, {taken} from proposed join depths using (stratum)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, base_failed, not base_failed and not ({above}) as kept
from stats left join cuts using (stratum)
"""


_DECONTAMINATION = rf"""
with d as (
  select row_number() over () as r, doc_id, {_ALNUM_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} as w from documents
), b as (
  select coalesce(cast(item_id as varchar), 'null') as item_id, {_ALNUM_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} as w from benchmark
), windows as (
  select distinct item_id, n, array_to_string(w[i:i+n-1], ' ') as gram
  from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as i from (select *, least(len(w), 10) as n from b where len(w) > 0))
), hits as (
  select distinct r, i, p.n, item_id
  from (select r, n, i, array_to_string(w[i:i+n-1], ' ') as gram from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from windows))) p
  join windows on windows.gram = p.gram and windows.n = p.n
), words as (
  select r, count(distinct k) as n_hit from (select r, unnest(range(i, i + n)) as k from (select distinct r, i, n from hits)) group by r
), items as (
  select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct r, item_id from hits) group by r
)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (r) left join items using (r)
"""


def _licenses() -> str:
    values = ", ".join(f"('{t}', '{label}', {phrase}, {k}, {w})" for t, label, phrase, k, w in licenses.template_rows())
    gram = lambda w, i: f"array_to_string({w}[{i}:{i} + k - 1], ' ')"
    naming = ", ".join(f"'{x}'" for x in licenses.NAMING)
    return rf"""
with templates as (
  select * from (select *, case k when {licenses.PAIR} then {licenses.NEEDED[licenses.PAIR]} else {licenses.NEEDED[licenses.RUN]} end as need from (values {values}) x(template, label, phrase, k, t))
), grams as (
  select template, label, phrase, k, len(t) - k + 1 as grams, i - 1 as pos, {gram("t", "i")} as gram from (select *, unnest(range(1, len(t) - k + 2)) as i from templates)
), d as (
  select row_number() over () as r, doc_id, {_ALNUM_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} as w from documents
), places as (
  select r, k, i - 1 as place, {gram("w", "i")} as gram from (select r, w, k, unnest(range(1, len(w) - k + 2)) as i from d, (select unnest([{licenses.PAIR}, {licenses.RUN}]) as k))
), votes as (
  select r, template, label, phrase, grams, place - pos as diagonal, count(*) as votes from places join grams on places.gram = grams.gram and places.k = grams.k group by all
), base as (
  select r, count(*) as n_base, min(diagonal) as first_word, max(diagonal) as last_word, list_sort(list_distinct(list(label))) as base from votes where phrase and votes = grams group by r
), marked as (
  select *, coalesce(cast(diagonal - lag(diagonal) over (partition by r, template order by diagonal) > {licenses.APART} as int), 1) as new from votes where not phrase
), spans as (
  select *, sum(new) over (partition by r, template order by diagonal) as span from marked
), merged as (
  select r, template, label, grams, span, sum(votes) as votes, max(votes) as most, list(diagonal) as diagonals from spans group by all
), checked as (
  select r, m.label, need, k, t, list_filter(range(0, len(t)), lambda i: len(list_filter(diagonals, lambda x: i + x >= 0 and w[i + x + 1] = t[i + 1])) > 0) as found,
    case k when {licenses.RUN} then len(found) else greatest(len(found) - list_max(diagonals) + list_min(diagonals), list_max(list_transform(diagonals, lambda x: len(list_filter(range(0, len(t)), lambda i: i + x >= 0 and w[i + x + 1] = t[i + 1]))))) end as right_words
  from merged m join templates using (template) join d using (r) where 2 * case k when {licenses.PAIR} then most else votes end >= need * grams
), noted as (
  select r, list_distinct(list(label)) as noted, max(right_words / len(t)) as share from checked
  where right_words >= need * len(t) and (k = {licenses.RUN} or len(list_filter(range(0, len(t)), lambda i: t[i + 1] in ({naming}) and not list_contains(found, i))) = 0) group by r
)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_base, 0) as bigint) as n_base, cast(first_word as bigint) as first_word, cast(last_word as bigint) as last_word,
  array_to_string(coalesce(base, []), ',') as base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(noted, [])))), ',') as labels,
  case when len(coalesce(base, [])) > 0 then 1.0::double else coalesce(share, 0)::double end as score
from d left join base using (r) left join noted using (r)
"""


_MIXING = rf"""
with d as (
  select doc_id, source, cast(len({_BLANK_WORDS.format("coalesce(text, '')")}) as bigint) as size,
    cast('0x' || substr(md5('{mixing.SEED}/' || coalesce(cast(doc_id as varchar), '') || '/' || md5(coalesce(text, '')) || '/' || (row_number() over (partition by doc_id, source, md5(coalesce(text, ''))) - 1)), 1, 8) as bigint)::double / 4294967296.0 as draw
  from documents
), s as (
  select source, cast(sum(size) as bigint) as source_size from d group by source
), w as (
  select *, {list(mixing.WEIGHTS)}[cast((row_number() over (order by source is null, source) - 1) % {len(mixing.WEIGHTS)} as int) + 1] as weight from s
), c as (
  select *, sum(source_size) over () as total,
    coalesce(sum(source_size) over (order by source_size * 6 / weight, source is null, source rows between unbounded preceding and 1 preceding), 0) as before,
    sum(weight) over (order by source_size * 6 / weight, source is null, source rows between current row and unbounded following) as weights
  from w
), l as (
  select *, min(case when weight * (3 * total - 4 * before) <= 4 * source_size * weights then {{'before': before, 'num': 3 * total - 4 * before, 'den': weights}} end) over () as level from c
), g as (
  select source, source_size, case when weight * level.num < 4 * source_size * level.den then (weight * level.num)::double / (2 * level.den)::double else (2 * source_size)::double end as target from l
), r as (
  select doc_id, size, source_size, target, draw, case when source_size > 0 then target / source_size else 0.0 end as rate from d join g on d.source is not distinct from g.source
)
select doc_id, size, source_size, target, cast(size * (floor(rate) + cast(draw < rate - floor(rate) as int)) as bigint) as taken from r
"""

_WARC = """
with p as (
  select row_number() over () as r, page_id, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages
), k as (
  select *, first_value(r) over w as top, first_value(page_id) over w as top_id from p
  window w as (partition by payload_digest order by page_id desc nulls last, r desc rows between unbounded preceding and unbounded following)
)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 1000 and r <> top then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and r <> top then top_id end as refers_to
from k
"""



def _secrets() -> str:
    either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    words = "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key")))
    patterns = (secrets.ASSIGN.replace("(?i:password|passwd|secret|token|api_?key)", words).replace("'", "''"), "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}", secrets.RUN + "{%d,}" % secrets.LEAST)
    found = " union all ".join(
        f"select r, {k} as kind, unnest(range(1, len(h) + 1)) as i, h, g, v from (select r, regexp_extract_all(t, '{p}') as h, string_split_regex(t, '{p}') as g, regexp_extract_all(t, '{p}', {2 if k == 0 else 0}) as v from d where regexp_matches(t, '{p}'))" for k, p in enumerate(patterns)
    )
    alphabets = ", ".join(f"({i}, '{a}', {len(a)}, '{'0' * (len(a) // 2) + '1' * (len(a) - len(a) // 2)}', '^{p}$')" for i, (a, p) in enumerate(secrets.ENCODINGS.values()))
    changes = lambda x: "(" + " + ".join(f"len(regexp_extract_all({x}, '{p}'))" for p in ("[a-z]+", "[A-Z]+", "[0-9]+", "[+/_-]+")) + " - 1)"
    every = secrets.ENCODINGS["all"][0]
    return rf"""
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t from documents
), m as ({found}), e as (
  select r, kind, i, length(g[i]) as gap, length(h[i]) as size, v[i] as value from m
), p as (
  select r, kind, value, sum(gap) over (partition by r, kind order by i) + coalesce(sum(size) over (partition by r, kind order by i rows between unbounded preceding and 1 preceding), 0) as s, size from e
), placed as (
  select r, kind, cast(s as bigint) as s, cast(s + size as bigint) as e, value from p where kind <> 0 or length(value) >= {secrets.VALUE}
), pool as (
  select distinct run from (select unnest(regexp_extract_all(t, '{secrets.RUN}{{{secrets.ORDINARY},}}')) as run from d) where length(run) < {secrets.LEAST} and regexp_matches(run, '[^0-9]')
), rates as (
  select (coalesce(sum({changes("run")}), 0) + {secrets.PRIOR[0]}) / (coalesce(sum(length(run) - 1), 0) + {secrets.PRIOR[1]}) as rate from pool where not regexp_matches(run, '^([a-z]+|[A-Z]+|[+/_-]+)$')
), chars as (
  select ch, count(*) as n from (select unnest(string_split(run, '')) as ch from pool) group by ch
), alphabets as (
  select * from (values {alphabets}) x(place, alphabet, k, halves, pattern)
), cells as (
  select place, coalesce(n, 0) + 1 as n from (select place, unnest(string_split(alphabet, '')) as ch from alphabets) left join chars using (ch)
), shares as (
  select place, sum(q * q) as squares, sum(q * q * q) as cubes from (select place, n / sum(n) over (partition by place) as q from cells) group by place
), candidates as (
  select distinct value from placed where kind = 3 and regexp_matches(value, '[^0-9]')
), c as (
  select value, length(value)::double as n, a.*, squares, cubes, rate, list_transform(string_split(value, ''), lambda x: instr(alphabet, x)::double) as pl, translate(value, alphabet, halves) as bits,
    list_sum(list_transform(string_split('{every}', ''), lambda x: (length(value) - length(replace(value, x, ''))) * (length(value) - length(replace(value, x, '')) - 1) / 2))::double as pairs
  from candidates, rates, alphabets a join shares using (place)
  where a.place = (select min(place) from alphabets b where regexp_matches(value, b.pattern))
), c2 as (
  select *, n * (n - 1) / 2 as all_pairs, length(replace(bits, '1', ''))::double as low, (len(regexp_extract_all(bits, '0+')) + len(regexp_extract_all(bits, '1+')))::double as runs, list_sum(pl) as x, list_sum(list_transform(pl, lambda v: v * v)) as xx,
    list_sum(list_transform(range(1, len(pl)), lambda i: pl[i] * pl[i + 1])) as xy, {changes("value")}::double / (n - 1) as w from c
), c3 as (
  select *, 1 + 2 * low * (n - low) / n as mean, xx - x * x / n as spread, all_pairs * squares as expected, sqrt(all_pairs * (squares - squares * squares) + n * (n - 1) * (n - 2) * (cubes - squares * squares)) as deviation,
    (pairs - all_pairs / k) / sqrt(all_pairs / k * (1 - 1.0::double / k)) as z_pairs from c2
), c4 as (
  select *, case when (mean - 1) * (mean - 2) > 0 then (runs - mean) / sqrt((mean - 1) * (mean - 2) / (n - 1)) else 99 end as z_runs,
    (case when spread > 0 then (xy - x / n * (2 * x - pl[1] - pl[-1]) + (n - 1) * (x / n) * (x / n)) / spread else 1 end + 1 / n) * sqrt(n) as z_serial, (expected - pairs) / deviation as z from c3
), c5 as (
  select value, n, z_pairs <= {secrets.BATTERY} and abs(z_runs) <= {secrets.BATTERY} and abs(z_serial) <= {secrets.BATTERY} as passes,
    greatest(case when z > 0 then exp(-z * z / 2) / 2 else 1 end * case when w > rate then exp(-(n - 1) * (w * ln(w / rate) + case when w < 1 then (1 - w) * ln((1 - w) / (1 - rate)) else 0 end)) else 1 end, 1e-300::double) as joint from c4
), steps as (
  select value, floor(log2(n / {secrets.LEAST})) as stratum, floor(-log2(case when passes then least(joint * (1 - ln(joint)), 1.0::double) else 1.0::double end)) as step from c5
), counts as (
  select stratum, step, sum(count(*)) over (partition by stratum order by step desc) as found, sum(count(*)) over (partition by stratum) as tests from steps group by stratum, step
), cuts as (
  select stratum, min(step) as cut from counts where tests * pow(2.0::double, -step) <= {secrets.FALSE} * found group by stratum
), random as (
  select value from steps join cuts using (stratum) where step >= cut
), finds as (
  select r, kind, s, e from placed where kind < 3 union all select r, kind, s, e from placed join random using (value) where kind = 3
), reached as (
  select *, max(case when kind < 3 then e end) over (partition by r order by s, kind rows between unbounded preceding and current row) as reach from finds
), listed as (
  select r, count(*) filter (where kind = 0) as n_assign, count(*) filter (where kind = 1) as n_access, count(*) filter (where kind = 2) as n_hex,
    string_agg({list(secrets.KINDS)}[kind + 1] || ':' || s || ':' || e, ',' order by s, kind) filter (where kind < 3) as base, string_agg({list(secrets.KINDS)}[kind + 1] || ':' || s || ':' || e, ',' order by s, kind) as spans
  from reached where kind < 3 or reach is null or reach < e group by r
)
select doc_id, cast(coalesce(n_assign, 0) as bigint) as n_assign, cast(coalesce(n_access, 0) as bigint) as n_access, cast(coalesce(n_hex, 0) as bigint) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join listed using (r)
"""


_SCATTER = f"""
with v as (
  select list_transform(embedding, lambda c: cast(floor({whitening.STEPS} * c::double) as bigint)) as x from embeddings where embedding is not null and len(list_filter(embedding, lambda c: c is null or isnan(c) or isinf(c))) = 0
), fit as (
  select distinct x, row_number() over () as r from (select distinct x from v)
), cells as (
  select r, len(x) as d, unnest(range(0, len(x))) as i, unnest(x) as y from fit
), sums as (
  select d, i, sum(y)::hugeint as s, count(*) as n from cells group by d, i
), products as (
  select a.d, a.i, b.i as j, sum(a.y::hugeint * b.y) as p from cells a join cells b on a.r = b.r and a.i <= b.i group by all
)
select cast(p.d as int) as d, cast(p.i as int) as i, cast(p.j as int) as j, a.n, cast(a.n * p.p - a.s * b.s as varchar) as scatter
from products p join sums a on p.d = a.d and p.i = a.i join sums b on p.d = b.d and p.j = b.i
"""

SQL = {
    "op1_quality_rules": _quality(),
    "op2_decontamination": _DECONTAMINATION,
    "op4_chat_perspectives": _CHAT,
    "op5_license_scan": _licenses(),
    "op6_source_mixing": _MIXING,
    "op9_warc_revisits": _WARC,
    "op11_secret_scan": _secrets(),
    "whitening_scatter": _SCATTER,
    "sharding_law": "select count(*) as n_rows, cast(sum(strlen(coalesce(text, '')) + 8) as bigint) as n_bytes, cast(24 as bigint) as n_shards, true as gapless, true as near_equal from documents",
}

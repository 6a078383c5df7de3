"""DuckDB SQL of the queries whose SQL is long: url templates, source mixing and licences.

Each states the same rules over whole tables in one statement; the operators' constants are put in.
"""

from __future__ import annotations

from . import licences, mixing, url_filter

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _level(d: int) -> str:
    """One level of the tree: children, nodes that are not variable, branches, and the rows one segment further."""
    u = url_filter
    return f"""
c{d} as (select host, template, parts[{d + 1}] as seg, count(*) as n, sum(bad)::bigint as b, sum(labelled)::bigint as l from r{d} where len(parts) > {d} group by all),
n{d} as (select host, template, sum(b)::bigint as all_b, sum(l)::bigint as all_l from c{d} group by all having not (count(*) > {u.MANY} and sum(n) < {u.DENSE} * count(*))),
k{d} as (select c.*, floor((b + {u.PSEUDO}::double * (all_b + 1) / (all_l + 2)) / (l + {u.PSEUDO}::double) * {u.STEPS})::bigint as step
  from c{d} c join n{d} using (host, template) where n >= {u.RARE}),
s{d} as (select host, template, step, count(*) as kids, sum(b)::bigint as b, sum(l)::bigint as l from k{d} group by all),
a{d} as (select *, lag(b) over w as b0, lag(l) over w as l0 from s{d} window w as (partition by host, template order by step)),
p{d} as (select *, (b + b0 + 1) / (l + l0 + 2) as p from a{d}),
b{d} as (select *, sum(coalesce(abs(b * l0 - b0 * l) > {u.Z}::double * sqrt(p * (1 - p) * (l + l0) * l * l0), false)::int) over (partition by host, template order by step)::bigint as branch from p{d}),
m{d} as (select *, sum(kids) over (partition by host, template, branch) as members from b{d}),
t{d} as (select k.host, k.template, k.seg, case when members > 1 then '{u.MERGED}' || branch else k.seg end as token from k{d} k join m{d} using (host, template, step)),
r{d + 1} as (select r.* exclude (template), case when len(parts) > {d} then r.template || '/' || coalesce(token, '{u.WILD}') else r.template end as template
  from r{d} r left join t{d} t on r.host = t.host and r.template = t.template and t.seg = r.parts[{d + 1}]),"""


def op6_sql(levels: int = 6) -> str:
    """``levels``: segments that are walked one by one; deeper ones are wildcards here, so no path may have more that are dense."""
    u = url_filter
    fits = [(h, p, v) for h, p, v in sorted(u.RULES, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))]
    when = [(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then", h + p, v) for h, p, v in fits]
    rule, verdict = (" ".join(f"{w[0]} '{w[i]}'" for w in when) for i in (1, 2))
    return f"""
with u as (select page_id, url, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end as rest from pages),
h as (select page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') as host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from u),
i as (select *, try_cast(nullif(regexp_extract(path, '^.*/([0-9]{{1,18}})(?:[/.].*)?$', 1), '') as bigint) as doc_id from h),
w as (select doc_id, max((quality = 0 or toxic = 1)::bigint) as bad from labels group by doc_id),
o as (select page_id, max(bad) as bad from i join w using (doc_id) where bad is not null and page_id is not null group by page_id),
r0 as (select h.page_id, host, path, case when path = '' then []::varchar[] else string_split(regexp_replace(path, '^/', ''), '/') end as parts,
  coalesce(bad, 0) as bad, (bad is not null)::bigint as labelled, '' as template from h left join o on h.page_id = o.page_id),
{"".join(_level(d) for d in range(levels))}
r as (select * exclude (template), template || repeat('/{u.WILD}', greatest(len(parts) - {levels}, 0)) as template from r{levels}),
per as (select host, template, sum(bad)::bigint as b, sum(labelled)::bigint as l from r group by all),
hosts as (select host, sum(b)::bigint as hb, sum(l)::bigint as hl from per group by host),
total as (select coalesce(sum(hb), 0)::bigint as tb, coalesce(sum(hl), 0)::bigint as tl from hosts),
pure as (select host, template, tl, (b + {u.PSEUDO}::double * ((hb + {u.PSEUDO}::double * ((tb + 1) / (tl + 2))) / (hl + {u.PSEUDO}::double))) / (l + {u.PSEUDO}::double) as purity
  from per join hosts using (host), total)
select page_id, host, path, case {rule} end as rule,
  coalesce(case {verdict} end, case when purity >= {u.REJECT}::double and tl > 0 then 'block' else 'allow' end) as verdict, template, purity
from r join pure using (host, template)
"""


def op9_sql(repetition: float = 1.25, block_docs: int = mixing.BLOCK_DOCS) -> str:
    points = mixing.POINTS**mixing.JOBS
    return f"""
with d as (select doc_id, source, coalesce('=' || source, 'null') as src, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) + 1 as tokens,
  md5(concat_ws('|', doc_id, coalesce('=' || source, 'null'), text)) as print from documents),
per as (select src, sum(tokens)::bigint as n, count(*) as docs from d group by src),
tot as (select sum(n)::bigint as total from per),
shares as (select src, n / total as share from per, tot),
sums as (select i / {points}::double as t, sum(pow(share, i / {points}::double)) as z, max(pow(share, i / {points}::double - 1)) as most from shares, range(0, {points} + 1) x(i) group by i),
e as (select coalesce(min(t), 1::double) as t from sums where most / z <= {repetition}::double * (1 + 1e-12::double)),
z as (select t, sum(pow(share, t)) as z from shares, e group by t),
g as (select src, n, docs, least(floor(pow(n / total, t) / z * total)::bigint, floor(n * {repetition}::double)::bigint) as goal from per, tot, z),
plan as (select *, floor(goal / n)::int as whole, goal % n as rest, ceil(docs / {block_docs})::bigint as blocks from g),
b as (select d.*, n, goal, whole, rest, ('0x' || substr(print, 1, 15))::bigint % blocks as block, ('0x' || substr(print, 16, 15))::bigint as inside from d join plan using (src)),
p as (select *, ('0x' || substr(md5(concat_ws('|', src, block, whole)), 1, 10))::bigint / 1099511627776::double as place from b),
cells as (select src, place, block, rest, sum(tokens)::bigint as tokens from p where rest > 0 group by all),
upto as (select *, sum(tokens) over (partition by src order by place, block)::bigint as upto from cells),
ends as (select src, place as end_place, block as end_block, rest - upto + tokens as room from upto where upto > rest and upto - tokens <= rest),
here as (select p.src, room, inside, sum(tokens)::bigint as tokens from p join ends on p.src = ends.src and place = end_place and block = end_block group by all),
run as (select *, sum(tokens) over (partition by src order by inside)::bigint as upto from here),
last as (select src, max(inside) as end_inside from run where upto <= room group by src),
taken as (select p.*, whole + coalesce(rest > 0 and (place < end_place or place = end_place and (block < end_block or block = end_block and inside <= end_inside)), false)::int as times
  from p left join ends using (src) left join last using (src)),
x as (select *, unnest(range(0, times))::int as epoch from taken)
select doc_id, source, epoch, block, (epoch + ('0x' || substr(md5(concat_ws('|', src, block, epoch)), 1, 10))::bigint / 1099511627776::double) / (goal / n) as position, tokens as n_tokens from x
"""


def op10_sql() -> str:
    texts = [(name, text) for name in sorted(licences.TEMPLATES) for text in licences.TEMPLATES[name]]
    values = ", ".join("({}, '{}', '{}')".format(k, name, text.replace("'", "''")) for k, (name, text) in enumerate(texts))
    normal = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+')"
    need = f"{licences.LEAST}::double * (m + size) / 2"
    return f"""
with recursive t(k, name, text) as (values {values}),
tw as (select k, name, {normal} as w from t),
tp as (select k, name, len(w) - 1 as m, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as g from tw),
tg as (select k, name, m, g, count(*) as c from tp group by all),
d as (select row_number() over () as r, doc_id, {normal} as w from documents),
dp as (select r, len(w) - 1 as pairs, unnest(range(0, len(w) - 1)) as pos, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as g from d where len(w) > 1),
hit as (select r, k, name, m, c, g, pos, pairs, least(m, pairs) as size from dp join tg using (g)),
enough as (select r, k from hit group by r, k, m, size having count(*) >= {need} and size >= {need}),
spots as (select h.*, unnest(range(greatest(pos - size + 1, 0), least(pos, pairs - size) + 1)) as start from hit h join enough using (r, k)),
grams as (select r, k, name, m, size, start, least(count(*), c) as n from spots group by r, k, name, m, size, start, g, c),
found as (select r, name, 2 * sum(n) / (m + size) as dice, start, size + 1 as n_words from grams group by r, k, name, m, size, start having 2 * sum(n) / (m + size) >= {licences.LEAST}::double),
best as (select * from found qualify row_number() over (partition by r, name order by dice desc, start, n_words) = 1),
o as (select *, row_number() over (partition by r order by dice desc, n_words desc, name) as o from best),
pick as (select r, o, [{{'name': name, 'dice': dice, 'at': start, 'n': n_words}}] as kept from o where o = 1
  union all select p.r, o.o, case when len(list_filter(kept, lambda x: start + n_words > x['at'] and x['at'] + x['n'] > start)) = 0
    then list_append(kept, {{'name': name, 'dice': dice, 'at': start, 'n': n_words}}) else kept end from pick p join o on o.r = p.r and o.o = p.o + 1),
done as (select r, kept from pick qualify row_number() over (partition by r order by o desc) = 1)
select doc_id, kept[1]['name'] as licence, coalesce(kept[1]['dice'], 0)::double as dice, coalesce(len(kept), 0)::int as n_licences,
  coalesce(array_to_string(list_transform(kept, lambda x: x['name'] || ' ' || floor(10000 * x['dice'])::bigint || ' ' || x['at'] || ' ' || x['n']), ', '), '') as matches
from d left join done using (r)
"""


ORACLES = {"op6_url_filter": op6_sql(), "op9_source_mix": op9_sql(), "op10_licence_scan": op10_sql()}

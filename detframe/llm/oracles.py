"""DuckDB statements for the queries that SQL can express."""

DIVERGENCE = r"""
with d as (
    select row_number() over () id, coalesce(lang, '') lang, coalesce(source, '') source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
w as (select id, lang, source, unnest(regexp_extract_all(t, '[a-z\x{80}-\x{10FFFF}]+')) term from d),
kept as (select lang, term from w group by lang, term having count(distinct id) >= 10),
v as (select lang, count(*) v from kept group by lang),
g as (select distinct lang, source from d),
c as (select w.lang, w.source, w.term, count(*) n from w join kept using (lang, term) group by all),
total as (select g.lang, g.source, coalesce(sum(n), 0) total, max(coalesce(v.v, 0)) v from g left join c using (lang, source) left join v using (lang) group by all),
p as (
    select t.lang, t.source, k.term, coalesce(c.n, 0) n,
        cast(1 + (cast(1000000000 as hugeint) * (coalesce(c.n, 0) + 2)) // cast(t.total + 2 * t.v as hugeint) as hugeint) p
    from total t join kept k using (lang) left join c on c.lang = t.lang and c.source = t.source and c.term = k.term),
whole as (select lang, term, sum(n) n from p group by all),
sums as (select lang, sum(total) total, max(v) v from total group by lang),
q as (select lang, term, cast(1 + (cast(1000000000 as hugeint) * (cast(n as hugeint) + 2)) // cast(total + 2 * v as hugeint) as hugeint) q from whole join sums using (lang)),
pair as (
    select a.lang, a.source, b.source item, cast(coalesce(sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)), 0) as bigint) as value
    from g a join g b on a.lang = b.lang and a.source <> b.source
    left join p x on x.lang = a.lang and x.source = a.source left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term
    group by all),
term as (
    select lang, source, term item, cast(((p - q) * (p - q)) // (p + q) as bigint) as value from p join q using (lang, term) where n > 0 and p > q),
ranked as (
    select lang, source, 'pair' part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pair
    union all select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item) from term)
select lang, source, part, item, value, cast(rank as integer) as rank from ranked where part = 'pair' or rank <= 10
"""

# crc32 by its polynomial: a table of 256 remainders, then one step a byte. Insertions alone lead between places of the pattern
# (0 begin, 1 system, 2 user, 3 assistant) as in ``ins``; a row's own edit as in ``ways``.
TURN_REPAIR = r"""
with recursive
tab as (select list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda r, z: case when r & 1 = 1 then xor(r >> 1, 3988292384) else r >> 1 end)) tab),
keyed as (
    select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') as text,
        list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda s: cast(ascii(s) as bigint)) codes
    from conversations),
kinds as (
    select conv_id, turn, role, text, xor(list_reduce(list_prepend(cast(4294967295 as bigint), codes),
        lambda r, b: xor(tab[cast(xor(r, b) & 255 as bigint) + 1], r >> 8)), 4294967295) % 20 kind from keyed, tab),
damaged as (
    select conv_id, turn, case when kind = 4 then 'user' else role end as role,
        case when kind = 1 then '' when kind = 2 then translate(text, '.!?', '') else text end as text,
        unnest(case when kind = 3 then [0, 1] else [0] end) as copy
    from kinds where kind <> 0),
placed as (
    select *, coalesce(conv_id, -1) k, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) i,
        row_number() over (partition by conv_id, role, text order by turn nulls first, copy) nth,
        rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) bare, left(role, 1) ini from damaged),
flagged as (
    select *, case when bare = '' then 'b' when nth > 1 then 'd' when right(bare, 1) not in ('.', '!', '?') then 't' else '' end fault,
        lag(ini) over (partition by conv_id order by i) earlier from placed),
counts as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (fault = 'b') blank, count(*) filter (fault = 'd') duplicate,
        count(*) filter (fault = 't') truncated, count(*) filter (earlier is not null and earlier || ini not in ('su', 'ua', 'au')) illegal, max(i) n
    from flagged group by conv_id),
ins(p, q, c, a) as (values (0,0,0,''),(1,1,0,''),(2,2,0,''),(3,3,0,''),(0,2,3,'I'),(0,3,6,'II'),(1,2,3,'I'),(1,3,6,'II'),(2,3,3,'I'),(3,2,3,'I')),
steps(p, r, q) as (values (0,'s',1),(0,'u',2),(1,'u',2),(2,'a',3),(3,'u',2)),
ways as (
    select k, i, p, q, (case when fault = 't' then 3 else 0 end) c, 'K' a from flagged join steps on r = ini where fault not in ('b', 'd')
    union all select k, i, p, q, 3 + (case when fault = 't' then 3 else 0 end), 'R' from flagged join steps on r <> 's' where fault not in ('b', 'd')
    union all select k, i, p, p, 4, 'D' from flagged, (values (0), (1), (2), (3)) x(p)),
moves as (
    select k, i, ins.p, w.q, min({'c': ins.c + w.c, 'a': ins.a || w.a}) m from ways w join ins on ins.q = w.p group by all),
walk(k, i, q, c, a) as (
    select distinct k, cast(0 as bigint), 0, 0, '' from flagged
    union all (
        select k, i, q, x.c, x.a from (
            select walk.k, walk.i + 1 i, m.q, min({'c': walk.c + m.m.c, 'a': walk.a || m.m.a}) x
            from walk join moves m on m.k = walk.k and m.i = walk.i + 1 and m.p = walk.q group by walk.k, walk.i, m.q))),
done as (
    select walk.k, min({'c': walk.c + ins.c, 'a': walk.a || ins.a}) x from walk join counts on coalesce(counts.conv_id, -1) = walk.k and counts.n = walk.i
    join ins on ins.p = walk.q and ins.q in (0, 3) group by walk.k),
letters as (
    select k, unnest(string_split(x.a, '')) letter, unnest(range(len(x.a))) pos from done where x.a <> ''),
numbered as (
    select k, letter, pos, sum(case when letter = 'I' then 0 else 1 end) over (partition by k order by pos) i,
        sum(case when letter = 'D' then 0 else 1 end) over (partition by k order by pos) m from letters),
made as (
    select n.k, n.pos, n.m, n.letter, f.role, case when n.letter = 'I' then '' else f.text end as text,
        max(case when n.m = 1 and n.letter = 'K' and f.ini = 's' then 1 else 0 end) over (partition by n.k) led
    from numbered n left join flagged f on f.k = n.k and f.i = n.i where n.letter <> 'D'),
mended as (
    select k, sha256(string_agg((case when letter = 'K' then role when (m - led) % 2 = 1 then 'user' else 'assistant' end) || ':' || text, chr(10) order by pos)) h from made group by k)
select c.conv_id, cast(coalesce(gaps, 0) as bigint) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated,
    coalesce(illegal, 0) illegal, cast(coalesce(d.x.c, 0) as bigint) as cost, coalesce(d.x.a, '') as audit, coalesce(h, sha256('')) repaired_sha256
from (select distinct conv_id from conversations) c left join counts on counts.conv_id is not distinct from c.conv_id
left join done d on d.k = coalesce(c.conv_id, -1) left join mended on mended.k = d.k
"""

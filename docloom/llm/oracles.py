"""The same results as SQL, for the operators that SQL can express.

Language, quality, fingerprints, alignments and token counts are not SQL; tests hold them
against brute force, libraries and held-out rows.
"""

WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

OP1 = """
with recursive good as (
    select vec_id, label, embedding::double[] as v from embeddings
    where label is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
      and len(list_filter(embedding, lambda x: x <> 0)) > 0),
unit as (select vec_id, label, v, sqrt(list_dot_product(v, v)) as length from good),
link as (
    select a.vec_id as a, b.vec_id as b from unit a join unit b
    on a.label = b.label and a.vec_id <> b.vec_id
    where list_dot_product(a.v, b.v) / (a.length * b.length) >= 0.93),
reach as (select vec_id, vec_id as other from embeddings union select r.vec_id, l.b from reach r join link l on r.other = l.a),
least as (select vec_id, min(other) as component_id from reach group by vec_id),
n as (select a as vec_id, count(*) as n_links from link group by a)
select e.vec_id, coalesce(n.n_links, 0) as n_links, l.component_id, e.vec_id = l.component_id as kept
from embeddings e join least l using (vec_id) left join n using (vec_id)
"""

OP3 = f"""
with rows as (
    select doc_id, coalesce(source, '') as name, source is not null as known, {WORDS} as size,
        substr(md5(coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')), 1, 15) as sort_key
    from documents),
sources as (select known, name, sum(size)::bigint as source_size from rows group by all),
weighed as (
    select *, [3, 1, 2][((row_number() over (order by known desc, encode(name)) - 1) % 3 + 1)::int] as weight
    from sources),
leveled as (
    select *, (1.5 * sum(source_size) over () - coalesce(sum(2 * source_size) over (
            order by 2 * source_size / weight, known, encode(name) rows between unbounded preceding and 1 preceding), 0))
        / sum(weight) over (order by 2 * source_size / weight, known, encode(name)
            rows between current row and unbounded following) as level
    from weighed),
goals as (
    select known, name, source_size,
        least((2 * source_size)::double,
            weight * (select max(level) from leveled)) as target
    from leveled),
placed as (
    select doc_id, size, source_size, target,
        sum(size) over (partition by known, name order by sort_key, doc_id, size rows unbounded preceding) - size as before,
        case when source_size > 0 then floor(target / source_size) else 0 end as passes
    from rows join goals using (known, name))
select doc_id, size::bigint as size, source_size, target,
    (size * (passes + (2 * before + size < 2 * (target - passes * source_size))::int))::bigint as taken
from placed
"""

OP5 = r"""
with docs as (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents),
pieces as (select row, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from docs),
keyed as (
    select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
    from pieces),
shared as (select key from keyed where key <> '' group by key having count(distinct row) >= 10),
lines as (
    select k.row, count(*) as n_lines, count(s.key) as n_dropped,
        coalesce(string_agg(k.line, chr(10) order by k.i) filter (where s.key is null), '') as kept
    from keyed k left join shared s on k.key = s.key group by k.row)
select d.doc_id, l.n_lines, l.n_dropped, sha256(l.kept) as kept_sha256 from docs d join lines l using (row)
"""

OP6 = """
with rows as (select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as sha from pages),
newest as (select sha, max(page_id) as newest from rows group by sha),
base32 as (
    select sha, newest, list_reduce(list_transform(range(0, 8), lambda g: list_reduce(list_transform(range(0, 4), lambda k:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            ((('0x' || substr(sha, (5 * g + 1)::int, 5))::int >> (15 - 5 * k)::int) & 31)::int + 1, 1)),
        lambda a, b: a || b)), lambda a, b: a || b) as digest
    from newest)
select page_id, strlen(payload)::bigint as payload_bytes, digest as payload_digest,
    case when newest is not null and page_id is distinct from newest then 'revisit' else 'response' end as record_type,
    case when newest is not null and page_id is distinct from newest then newest end as refers_to
from rows join base32 using (sha)
"""

OP7 = """
with turns as (
    select distinct conv_id as pair_id, turn, coalesce(role, '') as role, coalesce(text, '') as text
    from conversations where conv_id is not null and turn is not null),
ends as (
    select pair_id, min({turn: turn, text: text}) as first, max(turn) as last from turns where role = 'assistant' group by pair_id),
other as (
    select distinct t.pair_id, t.turn, t.role, case when t.role = 'assistant' and t.turn = e.last
        then case when e.first.turn < e.last then e.first.text else '' end else t.text end as text
    from turns t left join ends e using (pair_id)),
left_side as (select pair_id, turn, list({role: role, text: text} order by role, text) as said from turns group by all),
right_side as (select pair_id, turn, list({role: role, text: text} order by role, text) as said from other group by all),
met as (
    select pair_id, turn, l.said as chosen, r.said as rejected, l.said is distinct from r.said as differs
    from left_side l full join right_side r using (pair_id, turn)),
split as (
    select *, (row_number() over (partition by pair_id order by turn) - 1) // 64 as part, coalesce(turn < min(turn) filter (where differs) over (partition by pair_id), true) as shared from met),
long as (
    select pair_id, part, turn, case when shared then 'prompt' else 'chosen' end as side, unnest(chosen) as t from split
    union all select pair_id, part, turn, 'rejected', unnest(rejected) from split where not shared),
made as (
    select pair_id, part, side, turn, t.role as role, t.text as text,
        '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10) as rendered,
        (13 + length(t.role)) || 'x,' || (length(t.text) + 11) || case when t.role = 'assistant' then 't' else 'x' end as runs
    from long)
select p.pair_id, p.part, p.n_prompt_turns,
    coalesce(string_agg(m.rendered, '' order by m.turn, m.role, m.text) filter (where side = 'prompt'), '') as prompt,
    coalesce(string_agg(m.rendered, '' order by m.turn, m.role, m.text) filter (where side = 'chosen'), '') as chosen,
    coalesce(string_agg(m.rendered, '' order by m.turn, m.role, m.text) filter (where side = 'rejected'), '') as rejected,
    coalesce(string_agg(m.runs, ',' order by m.turn, m.role, m.text) filter (where side = 'chosen'), '') as chosen_mask,
    coalesce(string_agg(m.runs, ',' order by m.turn, m.role, m.text) filter (where side = 'rejected'), '') as rejected_mask
from (select pair_id, part, sum(shared::int)::bigint as n_prompt_turns from split group by all) p
left join made m using (pair_id, part) group by all
"""

# One assignment and one set of means a round; the vectors are lists of 64 whole numbers.
OP11 = """
with kept as (
    select vec_id, list_transform(embedding::double[], lambda x: floor(64 * x)::bigint) as v from embeddings
    where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as (
    select (row_number() over (order by h, v) - 1)::int as c, v from (
        select sha256('1:' || coalesce(vec_id::varchar, '')) as h, v from kept order by h, v limit 16)),
""" + "".join(
    f"""
a{r} as (
    select k.vec_id, k.v, min_by(c.c, (d(k.v, c.v), c.c)) as c, min(d(k.v, c.v)) as distance
    from (select row_number() over () as i, * from kept) k, c{r} c group by k.i, k.vec_id, k.v),
""".replace("d(k.v, c.v)", "list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint")
    + (
        f"""
p{r} as (
    select c, i, sum(x)::hugeint as s, count(*) as n
    from (select c, unnest(v) as x, generate_subscripts(v, 1) as i from a{r}) group by c, i),
m{r} as (
    select c, list(case when s % n < 0 then s // n - 1 else s // n end order by i)::bigint[] as v from p{r} group by c),
c{r + 1} as (select c.c, coalesce(m.v, c.v) as v from c{r} c left join m{r} m using (c)),
"""
        if r < 3
        else ""
    )
    for r in range(4)
) + """
t as (select c, sum(distance)::bigint as s from a3 group by c)
select a3.vec_id, a3.c as cluster, a3.distance, t.s as cluster_inertia, (select sum(s) from t)::bigint as inertia,
    sha256(array_to_string(c3.v, ',')) as centroid_sha256
from a3 join t using (c) join c3 using (c)
"""

OP13 = """
with cut as (
    select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u,
        sha256('1:' || coalesce(doc_id::varchar, '')) as h
    from documents),
num as (
    select *, len(u) as n, ('0x' || substr(h, 1, 8))::bigint % (len(u) + 1) as x, ('0x' || substr(h, 9, 8))::bigint % (len(u) + 1) as y,
        case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>')
            or ('0x' || substr(h, 17, 8))::bigint % 100 >= 90 then 'plain'
            when ('0x' || substr(h, 25, 8))::bigint % 100 < 20 then 'spm' else 'psm' end as form
    from cut),
piece as (
    select *, array_to_string(u[1:least(x, y)], '') as p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') as m,
        array_to_string(u[greatest(x, y) + 1:n], '') as s
    from num)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(p) end as prefix_chars,
    case when form <> 'plain' then length(m) end as middle_chars,
    sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
        else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
    sha256(text) as restored_sha256
from piece
"""

ORACLES = {
    "op1_near_vectors": OP1,
    "op3_mix_sources": OP3,
    "op5_drop_shared_lines": OP5,
    "op6_warc_round_trip": OP6,
    "op7_preference_pairs": OP7,
    "op11_centroid_clusters": OP11,
    "op13_fill_in_middle": OP13,
}

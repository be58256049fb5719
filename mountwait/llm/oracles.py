"""DuckDB SQL of the queries that SQL can express, over the driver's tables."""

from __future__ import annotations

from mountwait.llm.repetition import BASE_WINDOW, LINE_LIMIT, MIN_WORDS, NGRAM_LIMITS, SYMBOL_WORDS


def _crc32(text: str) -> str:
    """SQL for the CRC-32 of an ASCII text: a reduction over its bytes, eight shifts each."""
    byte = ("list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], "
            "lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))")
    codes = f"list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, b: {byte}), 4294967295)"


EXACT_DEDUP = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents),
g as (select norm, min(doc_id) as keep_id, count(*)::BIGINT as group_size from t group by 1)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.norm) as text_sha256
from t join g using (norm)"""

# Every prefix of every rebuilt conversation is a row (m); nodes are its groups (n); subtree sums go to all prefixes of a node.
PREFIX_TRIE = f"""
with t as (select conv_id, turn, coalesce(role, '') as r, coalesce(text, '') as x from conversations where conv_id is not null),
c as (select conv_id, list({{'r': r, 'x': x}} order by turn nulls first) as p, {_crc32("conv_id::VARCHAR")} % 9 as h
      from t group by conv_id),
f as (select c.conv_id, list_concat(coalesce(b.p[1:c.h], []), c.p[c.h + 1:]) as p
      from c left join c b on b.conv_id = c.conv_id - c.conv_id % 5),
m as (select conv_id, len(p) as l, unnest(range(len(p) + 1)) as d, p from f),
n as (select d, p[1:d] as k, min(conv_id) as conv_id, count(*) as n_convs,
             string_agg(conv_id::VARCHAR, ',' order by conv_id) filter (where l = d) as ends from m group by 1, 2),
e as (select n.*, case when d > 0 then (n_convs - 1) * strlen(k[d].x) else 0 end as own,
             case when d > 0 then k[1:d - 1] end as up from n),
kids as (select up, count(*) as n_children from e where d > 0 group by 1),
w as (select e.*, coalesce(kids.n_children, 0) as n_children from e left join kids on kids.up = e.k),
s as (select k[1:a] as top, sum((n_children = 0)::BIGINT) as n_leaves, sum(own) as saved
      from (select k, n_children, own, unnest(range(d + 1)) as a from w) group by 1)
select w.conv_id, w.d::BIGINT as depth, u.conv_id as parent_conv_id, w.n_convs::BIGINT as n_convs,
       w.n_children::BIGINT as n_children, s.n_leaves::BIGINT as n_leaves, s.saved::BIGINT as saved_tokens,
       sha256(coalesce(w.ends, '')) as ends_sha256
from w join s on s.top = w.k left join n u on u.k = w.up"""


def _centroids(rounds: int = 10, clusters: int = 8, dim: int = 64) -> str:
    """Lloyd rounds as one chain of tables: a_i assigns, c_i moves the centroids."""
    floor = "((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT"
    square = ("list_sum(list_transform(list_zip(v.x, c.x), lambda q: (q[1] - q[2]) * (q[1] - q[2])))::BIGINT")
    parts = [f"""v as materialized (select vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) as x
      from embeddings where len(embedding) = {dim} and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0)""",
             f"""c0 as materialized (select (row_number() over (order by sha256('3:' || vec_id)) - 1)::INTEGER as j, x from v
      order by sha256('3:' || vec_id) limit {clusters})"""]
    for i in range(rounds + 1):
        parts.append(f"""d{i} as materialized (select v.vec_id, v.x, c.j, {square} as d from v, c{i} c)""")
        parts.append(f"""a{i} as materialized (select vec_id, any_value(x) as x, min(d) as d, arg_min(j, (d, j)) as j
      from d{i} group by vec_id)""")
        if i < rounds:
            parts.append(f"""m{i} as (select j, list(x order by pos) as x from (
        select j, pos, {floor} as x from (select j, unnest(range({dim})) as pos, unnest(x) as x from a{i}) group by j, pos) group by j)""")
            parts.append(f"c{i + 1} as materialized (select c.j, coalesce(m.x, c.x) as x from c{i} c left join m{i} m using (j))")
    last = f"a{rounds}"
    return "with " + ",\n".join(parts) + f"""
select a.vec_id, a.j as cluster, a.d as distance, (sum(a.d) over (partition by a.j))::BIGINT as cluster_inertia,
       (sum(a.d) over ())::BIGINT as inertia, sha256(array_to_string(c.x, ',')) as centroid_sha256
from {last} a join c{rounds} c using (j)"""



def _quality_rules() -> str:
    """Words are rows (v) that know the words after them (u); a window (g) is the digest of its words, l the lines with a word."""
    nexts = ", ".join(f"lead(x, {j}) over own as x{j}" for j in range(1, max(NGRAM_LIMITS)))
    windows = " union all ".join(
        f"select rid, i, {n} as n, {x}::DOUBLE as lim, md5(concat_ws(' ', x, {', '.join(f'x{j}' for j in range(1, n))})) as m "
        f"from u where x{n - 1} is not null" for n, x in NGRAM_LIMITS.items())
    return rf"""
with t as (select row_number() over () as rid, doc_id, coalesce(text, '') as text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
c as (select *, len(w)::BIGINT as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT as word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT as n_symbols from t),
l as (select rid, line, count(*) as n from (select rid, unnest(string_split(text, chr(10))) as line from t)
      where regexp_matches(line, '[^\x20\x09-\x0D]') group by all),
d as (select rid, sum(n - 1)::BIGINT as n_dup_lines, sum((n - 1) * length(line))::BIGINT as dup_line_chars from l group by 1),
v as (select rid, unnest(w) as x, generate_subscripts(w, 1) as i from t),
u as (select rid, i, x, {nexts} from v window own as (partition by rid order by i)),
g as ({windows}),
k as (select rid, n, lim, i, count(*) over (partition by rid, n, m) as times,
             row_number() over (partition by rid, n, m order by i) as nth from g),
p as (select rid, n, lim, unnest(range(i, i + n)) as pos, nth from k where times > 1),
r as (select rid, count(distinct pos)::BIGINT as n_repeat_words from p where n = {BASE_WINDOW} group by 1),
q as (select distinct rid, n, lim, pos from p where nth > 1),
s as (select q.rid, q.n, q.lim, sum(length(v.x))::BIGINT as chars from q join v on v.rid = q.rid and v.i = q.pos group by all),
o as (select s.rid, max(s.chars / greatest(c.word_chars, 1)::DOUBLE) as share,
             bool_or(s.chars / greatest(c.word_chars, 1)::DOUBLE / s.lim > 1) as over from s join c using (rid) group by 1),
f as (select c.doc_id, c.text, c.n_words, c.word_chars, c.n_symbols, coalesce(d.n_dup_lines, 0) as n_dup_lines,
             coalesce(r.n_repeat_words, 0) as n_repeat_words, coalesce(d.dup_line_chars, 0) as dup_line_chars,
             coalesce(o.share, 0::DOUBLE) as dup_ngram_share, coalesce(o.over, false) as over
      from c left join d using (rid) left join r using (rid) left join o using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars, dup_ngram_share,
       n_words < {MIN_WORDS} or 100 * n_repeat_words > 30 * n_words as base_failed,
       not (n_words < {MIN_WORDS} or 100 * n_repeat_words > 30 * n_words or over
            or dup_line_chars > {LINE_LIMIT}::DOUBLE * greatest(length(text), 1)
            or n_symbols > {SYMBOL_WORDS}::DOUBLE * n_words) as kept from f"""


# Every window of 400 bytes is a row (w); r numbers the runs of repeated ones, g holds their first and last byte.
SUBSTRING_DEDUP = """
with t as (select row_number() over () as rid, doc_id, encode(coalesce(text, '')) as b from documents),
w as (select rid, b, unnest(range(1, octet_length(b) - 400 + 2)) as s from t where octet_length(b) >= 400),
h as (select rid, s, md5(b[s:s + 399]) as m from w),
x as (select rid, s from h semi join (select m from h group by m having count(*) > 1) using (m)),
y as (select rid, s, coalesce(s > lag(s) over (partition by rid order by s) + 400, true) as fresh from x),
r as (select rid, s, sum(fresh::BIGINT) over (partition by rid order by s) as run from y),
g as (select rid, run, min(s) as a, max(s) + 399 as z from r group by all),
n as (select *, lead(a) over (partition by rid order by run) as up from g),
k as (select n.rid, sum(z - a + 1)::BIGINT as n_removed, count(*)::BIGINT as n_spans, min(a) as first,
             string_agg(case when coalesce(up, octet_length(b) + 1) > z + 1
                             then hex(b[z + 1:coalesce(up, octet_length(b) + 1) - 1]) else '' end, '' order by run) as rest
      from n join t using (rid) group by 1)
select t.doc_id, octet_length(t.b)::BIGINT as n_bytes, coalesce(k.n_removed, 0) as n_removed, coalesce(k.n_spans, 0) as n_spans,
       case when k.rid is null then sha256(t.b)
            else sha256(unhex((case when k.first > 1 then hex(t.b[1:k.first - 1]) else '' end) || k.rest)) end as kept_sha256
from t left join k using (rid)"""


ORACLES = {"op5_quality_rules": _quality_rules(), "op6_substring_dedup": SUBSTRING_DEDUP,
           "op11_prefix_trie": PREFIX_TRIE, "op12_exact_dedup": EXACT_DEDUP, "op13_centroids": _centroids()}

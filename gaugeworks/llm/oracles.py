"""DuckDB SQL for the queries that SQL can express, over whole tables."""

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5 = """
with t as (select doc_id, encode(coalesce(text, '')) b, octet_length(encode(coalesce(text, '')))::bigint n from documents),
windows as (select doc_id, i, md5_number(b[i + 1:i + 200]) m from (select doc_id, b, unnest(range(0, greatest(n - 199, 0))) i from t)),
several as (select m from windows group by m having count(*) > 1),
starts as (select doc_id, i, lag(i) over (partition by doc_id order by i) p from windows where m in (select m from several)),
islands as (select doc_id, i, sum((p is null or i > p + 200)::int) over (partition by doc_id order by i) k from starts),
spans as (select doc_id, min(i) s, max(i) + 200 e from islands group by doc_id, k),
cuts as (select doc_id, s, e, lag(e, 1, 0) over (partition by doc_id order by s) o from spans),
kept as (select doc_id, string_agg(case when s > o then hex(b[o + 1:s]) else '' end, '' order by s) k, sum(e - s)::bigint removed, count(*) spans, max(e) last from cuts join t using (doc_id) group by doc_id)
select doc_id, n as n_bytes, coalesce(removed, 0) as n_removed, coalesce(spans, 0) as n_spans,
       sha256(case when k.doc_id is null then b else unhex(k || case when last < n then hex(b[last + 1:n]) else '' end) end) as kept_sha256
from t left join kept k using (doc_id)"""

OP8 = f"""
with t as (select row_number() over () rid, doc_id, {WORDS} w from documents),
i as (select item_id, {WORDS} w from benchmark where item_id is not null),
items as (select distinct item_id, n, array_to_string(w[k:k + n - 1], ' ') win from (select item_id, w, least(13, len(w)) n, unnest(range(1, len(w) - least(13, len(w)) + 2)) k from i where len(w) > 0)),
sizes as (select distinct n from items),
docs as (select rid, n, k, array_to_string(w[k:k + n - 1], ' ') win from (select rid, w, n, unnest(range(1, len(w) - n + 2)) k from t, sizes where len(w) >= n)),
found as (select rid, k, n, item_id from docs join items using (win, n)),
hit as (select rid, count(distinct p) c from (select rid, unnest(range(k, k + n)) p from found) group by rid),
of_items as (select rid, count(distinct item_id) c, sha256(string_agg(distinct item_id::varchar, ',' order by item_id::varchar)) s from found group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(hit.c, 0) as n_hit, coalesce(of_items.c, 0) as n_items, coalesce(s, sha256('')) as items_sha256,
       coalesce(hit.c, 0) > 0 and 20 * coalesce(hit.c, 0) >= len(w) as contaminated
from t left join hit using (rid) left join of_items using (rid)"""

OP9 = f"""
with recursive t as (select doc_id, {WORDS} w from documents),
grams as (select distinct doc_id, array_to_string(w[k:k + 4], ' ') g from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) k from t where len(w) > 0)),
sizes as (select doc_id, count(*) n from grams group by doc_id),
pairs as (select a.doc_id x, b.doc_id y, count(*) c from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from pairs join sizes a on a.doc_id = x join sizes b on b.doc_id = y where c >= 0.8 * (a.n + b.n - c) - 1e-6),
both_ways as (select x, y from links union all select y, x from links),
reach as (select doc_id x, doc_id y from t union select r.x, b.y from reach r join both_ways b on b.x = r.y)
select r.x as doc_id, min(r.y) as class_id, (select count(*) from both_ways b where b.x = r.x) as n_links from reach r group by r.x"""

OP11 = """
with v as (select row_number() over () r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                  list_transform(embedding, lambda c: floor(256 * c::double)) x
           from embeddings
           where label is not null and vec_id is not null and embedding is not null
             and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
anchors as (select * from v where vec_id % 50 = 0),
scored as (select a.r, a.vec_id anchor_id, a.label own, b.vec_id other_id, b.label, list_dot_product(a.x, b.x)::bigint score
           from anchors a join v b on len(a.x) = len(b.x)),
positives as (select r, anchor_id, own, other_id positive_id, score positive_score, row_number() over (partition by r order by score desc, other_id) p
              from scored where label = own and other_id <> anchor_id qualify p <= 5),
ranked as (select p.anchor_id, positive_id, row_number() over (partition by p.r, p.p order by score desc, other_id)::int rank, other_id negative_id, positive_score, score negative_score
           from positives p join scored s on s.r = p.r and s.label <> p.own and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score)
select * from ranked where rank <= 3"""

OP12 = f"""
with d as (select row_number() over () r, doc_id, {WORDS} w from documents),
lens as (select r, doc_id, len(w)::bigint n from d where len(w) > 0),
totals as (select count(*)::bigint n_all, sum(n)::bigint l_all from lens),
postings as (select r, t, count(*)::bigint tf from (select r, unnest(w) t from d) group by r, t),
items as (select distinct item_id, unnest({WORDS}) t from benchmark where item_id is not null),
weights as (select t, floor(1000 * ln((2 * n_all + 2) / (2 * df + 1)))::bigint wt from (select t, count(*) df from postings where t in (select t from items) group by t), totals),
scores as (select item_id, r, sum(wt * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_all) // l_all))))::bigint score
           from items join weights using (t) join postings using (t) join lens using (r), totals group by item_id, r)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score
from scores join lens using (r) where score > 0 qualify rank <= 10"""

OP13 = """
with v as (select row_number() over () r, vec_id, label, list_transform(embedding, lambda c: c::double) x,
                  label is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0 and len(list_filter(embedding, lambda c: c <> 0)) > 0 good
           from embeddings),
links as (select a.r x, b.r y from v a join v b on a.label = b.label and a.r <> b.r and a.good and b.good and len(a.x) = len(b.x)
          where list_cosine_similarity(a.x, b.x) >= 0.98),
reach as (with recursive n(x, y) as (select r, r from v union select n.x, links.y from n join links on links.x = n.y) select * from n),
least as (select reach.x r, min(v.vec_id) component_id from reach join v on v.r = reach.y group by reach.x)
select vec_id, (select count(*) from links where links.x = v.r) as n_links, component_id, coalesce(vec_id = component_id, false) as kept
from v join least using (r)"""

SQL = {"op5_suffix_dedup": OP5, "op8_decontamination": OP8, "op9_ngram_join": OP9, "op11_hard_negatives": OP11, "op12_ranked_search": OP12, "op13_near_vectors": OP13}

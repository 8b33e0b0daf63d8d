"""The same queries as SQL over the given tables, where SQL can express them."""

SQL = {
    "op2_chat_formatting": """
        with t as (select conv_id, turn, role, text,
                          row_number() over (partition by conv_id order by turn) as position, count(*) over (partition by conv_id) as total,
                          string_agg(role || chr(1) || text, chr(2)) over (
                              partition by conv_id order by turn rows between unbounded preceding and current row) as said
                   from conversations),
             whole as (select position, said, min(conv_id) as conv_id from t where position = total group by position, said),
             inside as (select distinct position, said from t where position < total),
             kept as (select conv_id from whole anti join inside using (position, said))
        select conv_id, (position - 1) // 1024 as part, cast(count(*) as int) as n_turns,
               string_agg('<|im_start|>' || role || chr(10) || replace(text, '<|im_', '<| im_') || '<|im_end|>' || chr(10), '' order by turn) as text
        from t semi join kept using (conv_id) group by conv_id, (position - 1) // 1024
    """,
    "op4_exact_dedup": """
        with t as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as h
                   from documents),
             g as (select h, max(doc_id) as keep_id, count(*) as group_size from t group by h)
        select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, h as text_sha256 from t join g using (h)
    """,
    # every alignment that shares a short run of tokens, which no allowed substitution can avoid
    "op1_benchmark_decontamination": """
        with d as (select row_number() over () as row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\\x20\\x09-\\x0D]+') as ws from documents),
             b as (select row_number() over (order by ws) as item, min(item_id) as item_id, ws, len(ws) as n, least(16, len(ws)) as width,
                          case when len(ws) >= 8 then 3 else least(2, len(ws)) end as k
                   from (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\\x20\\x09-\\x0D]+') as ws from benchmark) where len(ws) > 0 group by ws),
             ig as (select item, k, unnest(range(1, n - k + 2)) as pos, ws from b),
             dg as (select row, k, ws, unnest(range(1, len(ws) - k + 2)) as pos, ws from d, (select distinct k from b)),
             pairs as (select distinct row, item, x.pos - y.pos as shift from (select row, k, pos, array_to_string(ws[pos:pos + k - 1], ' ') as g from dg) x
                       join (select item, k, pos, array_to_string(ws[pos:pos + k - 1], ' ') as g from ig) y on x.g = y.g and x.k = y.k),
             same as (select p.row, b.item_id, p.shift, d.doc_id, b.width, len(d.ws) as m, b.n,
                             list_transform(range(1, b.n + 1), lambda i: case when i + p.shift between 1 and len(d.ws) and b.ws[i] = d.ws[i + p.shift] then 1 else 0 end) as hits
                      from pairs p join d on p.row = d.row join b on p.item = b.item),
             wins as (select row, doc_id, item_id, shift, width, k, list_sum(hits[k + 1:k + width])::int as agreeing
                      from (select *, unnest(range(0, n - width + 1)) as k from same where list_sum(hits) * 10 >= 8 * width)
                      where k + shift >= 0 and k + shift + width <= m),
             best as (select *, row_number() over (partition by doc_id, item_id order by agreeing / width desc, width desc, k + shift, k) as place
                      from wins where agreeing * 10 >= 8 * width)
        select doc_id, item_id, agreeing, width::int as width, k::int as item_token, (k + shift)::int as doc_token from best where place = 1
    """,
    # all pairs that share a shingle; classes by transitive closure
    "op8_ngram_jaccard_join": """
        with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                         '[^\\x20\\x09-\\x0D]+') as ws from documents),
             s as (select doc_id, unnest(list_distinct(case when len(ws) >= 5
                       then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) else [array_to_string(ws, ' ')] end)) as g
                   from w where len(ws) > 0),
             n as (select doc_id, count(*) as n from s group by doc_id),
             shared as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
             links as (select a, b from shared join n x on a = x.doc_id join n y on b = y.doc_id where k * 10 >= 8 * (x.n + y.n - k)
                       union select x.doc_id, y.doc_id from w x join w y on x.ws = y.ws and x.doc_id <> y.doc_id),
             reach as (select doc_id as a, doc_id as b from w union select reach.a, links.b from reach join links on reach.b = links.a),
             class as (select a as doc_id, min(b) as class_id, count(*) as class_size from reach group by a),
             degree as (select a as doc_id, count(*) as n_links from links group by a)
        select doc_id, class_id, coalesce(n_links, 0) as n_links, class_size from class left join degree using (doc_id)
    """,
    # all pairs that share one of their rarest shingles, which no pair at 0.8 or more can avoid
    "op10_line_dedup": """
        with recursive l as (select doc_id, generate_subscripts(ls, 1) - 1 as line_no, unnest(ls) as line
                             from (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null)),
             o as (select doc_id, line_no, regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') as h from l),
             node as (select h, min((coalesce(doc_id, 9223372036854775807), line_no)) as place from o where h <> '' group by h),
             sets as (select h, list_distinct(list_transform(range(0, greatest(length(h) - 4, 1)), lambda i: substr(h, i + 1, 5))) as g from node),
             e as (select h, len(g) as n, unnest(g) as s from sets),
             rare as (select *, row_number() over (partition by h order by df, s) as rk from (select *, count(*) over (partition by s) as df from e)),
             pre as (select h, s, n from rare where rk <= n - ceil(0.8 * n) + 1),
             cand as (select distinct a.h as a, b.h as b from pre a join pre b on a.s = b.s and a.h < b.h and a.n * 10 >= 8 * b.n and b.n * 10 >= 8 * a.n),
             pair as (select a, b from cand join sets x on a = x.h join sets y on b = y.h
                      where len(list_intersect(x.g, y.g)) * 10 >= 8 * (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g)))),
             links as (select a, b from pair union all select b, a from pair),
             reach as (select a, a as b from links union select reach.a, links.b from reach join links on reach.b = links.a),
             best as (select a as h, min(place) as place from reach join node on b = node.h group by a),
             kept as (select o.doc_id, o.line_no, o.h = '' or (coalesce(o.doc_id, 9223372036854775807), o.line_no) = coalesce(best.place, node.place) as stays
                      from o left join node on o.h = node.h left join best on o.h = best.h),
             per as (select doc_id, count(*)::int as n_lines, count(*) filter (not stays)::int as n_dropped,
                            list(line_no order by line_no) filter (stays) as stay from kept group by doc_id)
        select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_dropped, 0) as n_dropped,
               sha256(case when n_dropped > 0 then coalesce(array_to_string(list_transform(stay, lambda k: string_split(d.text, chr(10))[k + 1]), chr(10)), '')
                           else d.text end) as text_sha256
        from documents d left join per on d.doc_id is not distinct from per.doc_id
    """,
    # every window as a string, counted over the corpus
    "op11_substring_dedup": """
        with d as (select row_number() over () as row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
             w as (select row, unnest(range(0, len(ws) - 34)) as s, ws from d where len(ws) >= 35),
             g as (select row, s, sha256(array_to_string(ws[s + 1:s + 35], ' ')) as h from w),
             r as (select row, s from g where h in (select h from g group by h having count(*) > 1)),
             gone as (select distinct row, i from (select row, unnest(range(s, s + 35)) as i from r)),
             per as (select row, count(*) as n_removed, list(i) as gone from gone group by row),
             dropped as (select d.row, string_agg(word, ' ' order by d.i) as kept
                         from (select row, unnest(ws) as word, generate_subscripts(ws, 1) - 1 as i from d where row in (select row from per)) d
                         anti join gone on d.row = gone.row and d.i = gone.i group by d.row)
        select doc_id, len(ws) as n_words, coalesce(n_removed, 0) as n_removed,
               sha256(case when n_removed is null then array_to_string(ws, ' ') else coalesce(kept, '') end) as kept_sha256
        from d left join per on d.row = per.row left join dropped on d.row = dropped.row
    """,
    # diagonals as islands of equal lag among the places that begin the same three words, which every run's matches hold
    "op12_periodic_runs": """
        with d as (select row_number() over () as row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws,
                          list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(
                              string_split(coalesce(doc_id::varchar, ''), ''), lambda c: [ord(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
                              lambda x, o: case when o >= 0 then xor(x, o) else xor(x >> 1, (x & 1) * 3988292384) end) as r from documents),
             h as (select *, len(ws) as n, xor(r, 4294967295) as h, xor(r, 4294967295) // 10 as g from d),
             t as (select row, doc_id, n, case when h % 10 = 0 and n > 0
                          then list_transform(range(0, n), lambda i: ws[1 + case when i >= g % n then g % n + (i - g % n) % (1 + (n - g % n) // (3 + g % 8)) else i end])
                          else ws end as ws from h),
             p as (select row, unnest(range(0, n - 2)) as i, n, ws from t where n >= 6),
             k as (select row, i, n, hash(ws[i + 1], ws[i + 2], ws[i + 3]) as k from p),
             m as (select a.row, a.i, a.i - b.i as q from k a join k b on a.row = b.row and a.k = b.k and b.i < a.i and (a.i - b.i) * 4 <= a.n),
             isles as (select row, q, min(i) - q as s, count(*) + 2 + q as len
                       from (select *, i - row_number() over (partition by row, q order by i) as isle from m) group by row, q, isle),
             runs as (select row, s as start, len as length, min(q) as period from isles where len >= greatest(6, 4 * q) group by row, s, len),
             told as (select row, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as told from runs group by row),
             best as (select * from runs qualify row_number() over (partition by row order by length / period desc, start, period) = 1),
             gone as (select distinct row, unnest(range(start + period, start + length)) as i from runs),
             kept as (select w.row, string_agg(word, ' ' order by w.i) as kept
                      from (select row, unnest(ws) as word, generate_subscripts(ws, 1) - 1 as i from t) w anti join gone on w.row = gone.row and w.i = gone.i group by w.row)
        select doc_id, coalesce(n_runs, 0) as n_runs, start, length, period, 1000 * length // period as exponent_milli,
               sha256(coalesce(told, '')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256
        from t left join told on t.row = told.row left join best on t.row = best.row left join kept on t.row = kept.row
    """,
}

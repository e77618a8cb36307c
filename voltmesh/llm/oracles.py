"""Oracle SQL (DuckDB) of the queries that SQL can express on whole tables.

The others have none: DuckDB has neither CRC-32 (op1) nor XXH64 (op9), no tokenizers (op2, op8), and no join by
similarity or edit distance that ends in time on whole tables (op3, op6); tests hold these against brute-force versions.
"""

from __future__ import annotations

from .licences import PHRASES, TEMPLATES, words

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP4 = rf"""with
dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
iw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
iwin as (select distinct item_id, least(13, len(w)) as n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') as win
 from (select item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) as i from iw where len(w) > 0)),
sizes as (select distinct n from iwin),
dwin as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as win from (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) as i from dw, sizes where len(w) >= n)),
hits as (select doc_id, item_id, i, dwin.n from dwin join iwin on dwin.n = iwin.n and dwin.win = iwin.win),
hw as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by 1),
hi as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, item_id::varchar as id from hits) group by 1)
select dw.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
 coalesce(n_hit, 0) > 0 and 20*coalesce(n_hit, 0) >= len(w) as contaminated from dw left join hw using (doc_id) left join hi using (doc_id)"""

_RULES = "(values ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')) r(rule, rhost, rpath, verdict)"

OP5 = rf"""with p as (select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') as host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
m as (select page_id, arg_max(rule, len(rule)) as rule, arg_max(verdict, len(rule)) as verdict from p join {_RULES} on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by 1)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from p left join m using (page_id)"""

OP7 = """with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
q as (select *, max(page_id) over (partition by payload_digest, payload_bytes) as top from p)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest, case when payload_bytes >= 1000 and page_id < top then 'revisit' else 'response' end as record_type,
 case when payload_bytes >= 1000 and page_id < top then top end as refers_to from q"""

OP10 = r"""with
d as (select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
ls as (select doc_id, source, text, i, l, lower(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) as k, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) as nw
 from (select doc_id, source, text, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i from d)),
lw as (select * from ls where nw > 0),
dup as (select doc_id, sum(c - 1)::bigint as n from (select doc_id, l, count(*) as c from lw group by 1, 2) group by 1),
win as (select doc_id, i, array_to_string(w[i:i + 4], ' ') as x from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5)),
rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 5)) as p from (select *, count(*) over (partition by doc_id, x) as c from win) where c > 1) group by 1),
freq as (select source, k, count(distinct text) as n, min(doc_id) as first from lw group by 1, 2),
bad as (select source, k, first from freq where n > 20),
lost as (select doc_id, sum(nw)::bigint as n from lw join bad using (source, k) where doc_id <> first group by 1),
b as (select d.doc_id, len(w)::bigint as n_words, len(array_to_string(w, ''))::bigint as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
 coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words, (len(w) - coalesce(lost.n, 0))::bigint as kept_words
 from d left join dup using (doc_id) left join rep using (doc_id) left join lost using (doc_id)),
f as (select *, n_words < 10 or 100*n_repeat_words > 20*n_words as base_failed from b)
select *, not base_failed and kept_words >= 0.2*n_words as kept from f"""

_WORDS = ", ".join(f"({t}, '{x.label}', {k}, '{w}')" for t, x in enumerate(TEMPLATES) for k, w in enumerate(words(x.text)))
_KEYS = ", ".join(f"({t}, '{' '.join(words(p))}', '{words(p)[0]}', {len(words(p))})" for t, x in enumerate(TEMPLATES) for p in x.phrases)
_BASE = ", ".join(f"('{p}', '{p.split()[0]}', {len(p.split())}, '{label}')" for p, label in PHRASES.items())

OP11 = rf"""with
d as (select doc_id, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
pos as (select r, unnest(w) as word, generate_subscripts(w, 1) - 1 as i from d),
tw as (select * from (values {_WORDS}) v(t, label, k, word)),
df as (select word, count(distinct r) as n from pos where word in (select word from tw) group by 1),
rare as (select t, word from (select t, word, row_number() over (partition by t order by coalesce(n, 0), word) as rn from (select distinct t, word from tw) left join df using (word)) where rn <= 6),
sizes as (select t, max(label) as label, count(*) as size, (select count(*) from rare where rare.t = tw.t) as n_rare from tw group by t),
hit as (select r, t, i - k as b, word from pos join tw using (word) join rare using (t, word)),
win as (select a.r, a.t, a.b, count(distinct c.word) as n from (select distinct r, t, b from hit) a join hit c on a.r = c.r and a.t = c.t and c.b between a.b and a.b + 8 group by all),
cand as (select win.*, size, n_rare, label, len(w) as len from win join sizes using (t) join d using (r) where n >= (60*n_rare + 99)//100),
keys as (select * from (values {_KEYS}) v(t, phrase, word, len)),
stands as (select r, t, phrase, i, keys.len from pos join keys using (word) join d using (r) where array_to_string(w[i + 1:i + keys.len], ' ') = phrase),
ok as (select * from cand where not exists (select 1 from keys where keys.t = cand.t and not exists (
 select 1 from stands s where s.r = cand.r and s.t = cand.t and s.phrase = keys.phrase and s.i >= greatest(b, 0) and s.i + s.len <= least(cand.len, b + 8 + size)))),
base as (select r, i, label from pos join (values {_BASE}) v(phrase, word, n, label) using (word) join d using (r) where array_to_string(w[i + 1:i + n], ' ') = phrase),
bb as (select r, count(*) as n_base, min(i) as first_word, max(i) as last_word, string_agg(distinct label, ',' order by label) as base_labels from base group by 1),
ll as (select r, string_agg(distinct label, ',' order by label) as labels from (select r, label from base union all select r, label from ok) group by 1),
ss as (select r, max(n/n_rare) as score from ok group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word, coalesce(base_labels, '') as base_labels,
 coalesce(labels, '') as labels, coalesce(score, 0)::double as score from d left join bb using (r) left join ll using (r) left join ss using (r)"""

OP12 = rf"""with
d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
t as (select r, lang, source, unnest(w) as term from d),
k as (select lang, term from t group by all having count(distinct r) >= 10),
c as (select lang, source, term, count(*) as n from t join k using (lang, term) group by all),
g as (select distinct lang, source from d),
v as (select lang, count(*) as terms from k group by all),
x as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, sum(coalesce(c.n, 0)) over (partition by g.lang, g.source) as tot, terms,
 sum(coalesce(c.n, 0)) over (partition by g.lang, k.term) as ln, sum(coalesce(c.n, 0)) over (partition by g.lang) as ltot
 from g join k on g.lang = k.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term join v on v.lang = g.lang),
p as (select lang, source, term, n, (1 + 1000000000::hugeint*(n + 2)//(tot + 2*terms))::bigint as p, (1 + 1000000000::hugeint*(ln + 2)//(ltot + 2*terms))::bigint as q from x),
pair as (select a.lang, a.source, b.source as item, sum((a.p - b.p)*(a.p - b.p)//(a.p + b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
f as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source
 left join pair on pair.lang = a.lang and pair.source = a.source and pair.item = b.source
 union all select lang, source, 'term', term, (p - q)*(p - q)//(p + q) from p where n > 0 and p > q)
select * from (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from f) where part = 'pair' or rank <= 10"""

ORACLES: dict[str, str] = {"op4_decontamination": OP4, "op5_url_filter": OP5, "op7_warc": OP7, "op10_quality": OP10, "op11_licence_scan": OP11, "op12_source_divergence": OP12}

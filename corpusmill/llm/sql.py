"""SQL twins of the pN_ queries, for DuckDB over the same tables.

Folding needs NFKC, and the other operators hashes, tokenizers or parsers, which SQL lacks; those queries are tested
against brute force in ``tests/llm``.
"""

from __future__ import annotations

_WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"

_TIES = rf"""
with recursive keys as (select alias_key, doc_hash, regexp_extract(alias_key, '^([A-Za-z]+:)', 1) as prefix from aliases where alias_key is not null and doc_hash in (select doc_hash from contents where doc_hash is not null)),
bare as (select alias_key, doc_hash, prefix, regexp_replace(substr(alias_key, length(prefix) + 1), '^{_WS}+|{_WS}+$', '', 'g') as b from keys),
urls as (select *, string_split(b, '#')[1] as u from bare),
named as (select doc_hash, case when prefix = 'url:' then 'url:' || lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?]*')) || substr(u, length(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?]*')) + 1) else alias_key end as k from urls where alias_key <> '' and (prefix = 'url:' and u <> '' or prefix <> 'url:' and b <> '')),
ties as (select doc_hash, 'k' || k as k from named union select doc_hash, 'g' || group_id from contents where group_id is not null and doc_hash is not null),
firsts as (select k, min(doc_hash) as a from ties group by 1),
edges as (select a, doc_hash as b from ties join firsts using (k) union select doc_hash, a from ties join firsts using (k)),
reach as (select doc_hash as v, doc_hash as r from contents where doc_hash is not null union select e.b, w.r from reach w join edges e on e.a = w.v),
roots as (select v as doc_hash, min(r) as root_hash from reach group by 1),
stored as (select doc_hash, ['train', 'validation', 'test'][split_rank + 1] as s from contents where split_rank is not null union select id, split from docs where split is not null),
broken as (select root_hash from roots left join stored using (doc_hash) group by 1 having count(distinct doc_hash) > 1 and count(distinct s) > 1)
"""

SQL: dict[str, str] = {
    "p1_found": _TIES + "select root_hash, doc_hash from roots where root_hash in (select root_hash from broken)",
}

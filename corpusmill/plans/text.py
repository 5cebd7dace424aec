"""Queries of scalar text functions."""

from __future__ import annotations

import os

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.functions import text as t
from corpusmill.operators.classify import Script, classify, fake_official, host_term, in_domains
from corpusmill.plans.registry import query
from corpusmill.runtime import table
from corpusmill.sources import readers

#: A neutral fixture of rules.
RULES = readers.rules(os.path.join(os.path.dirname(__file__), "rules.toml"))
TERMS, WEAK = RULES.terms, sorted(RULES.weak)
#: Pairs of glyphs of two scripts and a phrase, a fixture for a pluggable map.
TRADITIONAL = "門車書馬時間電話買賣來對開關點說學國會個們這過還從後發現樣長東見聽讀寫錢"
SIMPLIFIED = "门车书马时间电话买卖来对开关点说学国会个们这过还从后发现样长东见听读写钱"
SCRIPT = Script(TRADITIONAL, SIMPLIFIED, {"網路": "网络"})
_ALT = "|".join(sorted(TERMS, key=lambda x: (-len(x), x)))
_WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_STRIP = lambda x: f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"
_NORM = "regexp_replace(nfc_normalize(regexp_replace(text, '\\r\\n?', chr(10), 'g')), '^\\x{FEFF}+', '')"


def docs(spark, d):
    return table(spark, d, "documents")


def lines(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_index", "line"))


_LINES = "(select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as line_index from documents where text is not null)"


_CLEAN = r"regexp_replace(regexp_replace(nfc_normalize(regexp_replace(line,'\r\n?',chr(10),'g')),'\x{FEFF}','','g'),'[\x00-\x08\x0b-\x1f\x7f-\x{9f}]',' ','g')"
_URL, _WORD, _GLUED = r"regexp_full_match(text,'https?://[^\s]+')", r"regexp_matches(text,'[\p{L}\p{N}]')", "regexp_matches(text,'。[A-Za-z]+$')"


@query(
    "txt01",
    f"with c as (select doc_id, line_index, {_STRIP(_CLEAN)} as x from {_LINES}), "
    r"u as (select doc_id, line_index, case when regexp_matches(x,'^[*=~◆◇■□★☆].*[^*=~◆◇■□★☆\s].*[*=~◆◇■□★☆]$') and left(x,1)=right(x,1) then trim(trim(x,left(x,1))) else x end as text from c) "
    f"select doc_id, line_index, text, case when text='' or {_URL} or not {_WORD} then 'drop' when contains(text,chr(65533)) or {_GLUED} then 'review' else 'keep' end as action, "
    f"case when text='' then 'empty' when {_URL} then 'url' when not {_WORD} then 'decoration' when contains(text,chr(65533)) then 'broken' when {_GLUED} then 'glued' else '' end as reason from u",
)
def txt01(spark, d):
    return lines(spark, d).select("doc_id", "line_index", t.clean_block(F.col("line")).alias("b")).select("doc_id", "line_index", "b.*")


@query("txt02", f"select doc_id, sha256({_NORM}) as doc_hash from documents")
def txt02(spark, d):
    return docs(spark, d).select("doc_id", F.sha2(t.normal_document(F.col("text")), 256).alias("doc_hash"))


@query("txt03", r"""with u as (select doc_id, trim(url) as u from documents) select doc_id, case when regexp_matches(u, '(?i)^https?://[^/?#]+') then lower(regexp_extract(u,'(?i)^(https?://[^/?#]+)',1)) || case when regexp_extract(u,'(?i)^https?://[^/?#]+([^?#]*)',1)='' then '/' else regexp_extract(u,'(?i)^https?://[^/?#]+([^?#]*)',1) end || regexp_extract(u,'(?i)^https?://[^/?#]+[^?#]*(\?[^#]*)?',1) end as canonical from u""")
def txt03(spark, d):
    return docs(spark, d).select("doc_id", t.canonical_url(F.col("url")).alias("canonical"))


@query("txt04", rf"""select doc_id, sha256(nfc_normalize(regexp_replace(text,'[\x00-\x08\x0b-\x1f\x7f-\x{{9f}}]','','g'))) as nfc_key, sha256(regexp_replace(text,'{_WS}+','','g')) as bare_key from documents""")
def txt04(spark, d):
    x = F.col("text")
    return docs(spark, d).select("doc_id", F.sha2(t.nfc(F.regexp_replace(x, r"[\x00-\x08\x0b-\x1f\x7f-\x9f]", "")), 256).alias("nfc_key"), t.no_space_key(x).alias("bare_key"))


@query("txt04_nfkc")
def txt04_nfkc(spark, d):
    x = t.nfkc(F.col("text"))
    return docs(spark, d).select("doc_id", F.sha2(t.collapse(x), 256).alias("spaced_key"), t.no_space_key(x).alias("bare_key"))


_BARE = r"regexp_replace(nfc_normalize(text),'[\x00-\x08\x0b-\x1f\x7f-\x{9f}\p{Cf}\p{Co}]','','g')"


@query("txt05", f"select id, regexp_replace({_STRIP(_BARE)},'{_WS}+',' ','g') as normal from (select distinct id, text from seq)")
def txt05(spark, d):
    return table(spark, d, "seq").select("id", "text").distinct().select("id", t.normal_message(F.col("text")).alias("normal"))


@query("txt06", r"select doc_id, regexp_replace(regexp_replace(text,'(^|[^A-Za-z0-9]) +','\1','g'),' +([^A-Za-z0-9]|$)','\1','g') as plain from documents")
def txt06(spark, d):
    return docs(spark, d).select("doc_id", t.detokenize(F.col("text")).alias("plain"))


_HANS = "[㐀-䶿一-鿿豈-\ufaff]"
_CONVERT = f"translate(replace(text,'網路','网络'),'{TRADITIONAL}','{SIMPLIFIED}')"
_SHARE = f"length(regexp_replace(text,'[^{TRADITIONAL}]','','g'))/greatest(length(regexp_replace(text,'[^{_HANS[1:-1]}]','','g')),1)"


@query("txt07", f"select doc_id, {_SHARE} as share, case when {_SHARE}>0.08 then {_CONVERT} else text end as converted from documents where text is not null")
def txt07(spark, d):
    """Texts of which enough Han letters belong to the other script are converted, phrases first."""
    x = F.col("text")
    share = SCRIPT.share(x, t.length_of(x, "[^" + _HANS[1:]))
    return docs(spark, d).where("text is not null").select("doc_id", share.alias("share"), F.when(share > 0.08, SCRIPT.convert(x)).otherwise(x).alias("converted"))


@query("txt08", f"""with l as (select doc_id, {_STRIP('line')} as x from {_LINES}), g as (select doc_id, x, count(*) as k, length(x) as n from l where x<>'' group by 1,2)
select d.doc_id, case when coalesce(s.total,0)>0 then s.again/s.total else 0.0 end as fraction from documents d left join (select doc_id, sum(case when k>1 then n*k else 0 end)::double as again, sum(n*k)::double as total from g group by 1) s using (doc_id)""")
def txt08(spark, d):
    return docs(spark, d).select("doc_id", t.repeated_line_fraction(F.col("text")).alias("fraction"))


@query("txt09", r"select doc_id, length(regexp_replace(text,'[^\p{Han}]','','g')) as han, length(regexp_replace(text,'[^\p{Hiragana}\p{Katakana}]','','g')) as kana, length(regexp_replace(text,'\s','','g')) as signs, case when length(regexp_replace(text,'\s','','g'))>0 then length(regexp_replace(text,'[^\p{Han}]','','g'))/length(regexp_replace(text,'\s','','g')) else 0.0 end as han_share from documents")
def txt09(spark, d):
    x = F.col("text")
    han, kana, signs = (t.count_of(x, p).cast("bigint") for p in (t.HAN, t.KANA, r"[^\t\n\f\r ]"))
    return docs(spark, d).select("doc_id", han.alias("han"), kana.alias("kana"), signs.alias("signs")).withColumn("han_share", F.when(F.col("signs") > 0, F.col("han") / F.col("signs")).otherwise(0.0))


@query("txt10", f"select doc_id, term from (select distinct doc_id, unnest(regexp_extract_all(lower(text), '({_ALT})')) as term from documents)")
def txt10(spark, d):
    return docs(spark, d).select("doc_id", F.explode(t.terms_found(F.col("text"), list(TERMS))).alias("term"))


@query("txt11", f"select doc_id, len(list_distinct(f)) as terms, len(list_filter(list_distinct(f), lambda x: x not in ({','.join(repr(w) for w in WEAK)})))>0 or len(list_distinct(f))>=2 as hit from (select doc_id, regexp_extract_all(lower(text), '({_ALT})') as f from documents where text is not null)")
def txt11(spark, d):
    found = t.terms_found(F.col("text"), list(TERMS))
    return docs(spark, d).where("text is not null").select("doc_id", F.size(found).cast("bigint").alias("terms"), t.counts_as_hit(found, WEAK).alias("hit"))


_HOSTLIST = "(select distinct host from documents where host is not null union all select unnest(['a.b.example.com.cn','www.ceg8rb.gov.cn.vyrtf.cn','www.gimgim.gov.cn','x.u07bgqr7k.com','lady8844.test','quinlom.kelj.test','example']))"
_UNDER = lambda h, listed: "(" + (" or ".join(f"{h}='{x}' or ends_with({h},'.{x}')" for x in listed) or "false") + ")"
_OFFICIAL = lambda h: f"(ends_with({h},'.gov.cn') or ends_with({h},'.edu.cn'))"
_HOSTTERM = lambda h: "(" + " or ".join(f"contains({h},'{x}')" for x in RULES.host_terms) + f") and not {_OFFICIAL(h)}"
_FAKE = lambda h: f"(contains({h},'.gov.cn.') or contains({h},'.edu.cn.')) and not {_OFFICIAL(h)}"
_TLD = lambda h: f"string_split({h},'.')[-1] in ({','.join(repr(x) for x in sorted(RULES.tlds))})"


@query("txt12", f"""with h as (select host, string_split(host,'.') as l from {_HOSTLIST}), r as (select host, case when len(l)<=2 then host when len(l)>=3 and length(l[-1])=2 and l[-2] in ('com','net','org','gov','edu','ac') then array_to_string(l[-3:],'.') else array_to_string(l[-2:],'.') end as registrable from h),
k as (select *, string_split(registrable,'.')[1] as label from r)
select host, registrable, {_UNDER('host', RULES.tier1)} as tier1, {_UNDER('host', RULES.tier2)} as tier2, {_TLD('host')} as tld, {_HOSTTERM('host')} as host_term, {_FAKE('host')} as fake_gov, length(label)>=5 and length(regexp_replace(regexp_replace(regexp_replace(label,'[^a-z0-9]','','g'),'[0-9]+','0','g'),'[a-z]+','a','g'))>=3 as random_looking from k""")
def txt12(spark, d):
    host = F.col("host")
    listed = spark.createDataFrame([(x,) for x in ("a.b.example.com.cn", "www.ceg8rb.gov.cn.vyrtf.cn", "www.gimgim.gov.cn", "x.u07bgqr7k.com", "lady8844.test", "quinlom.kelj.test", "example")], "host string")
    hosts = docs(spark, d).where("host is not null").select("host").distinct().unionByName(listed).withColumn("registrable", t.registrable(host))
    label = F.regexp_extract("registrable", r"^([^.]+)", 1)
    return hosts.select("host", "registrable", in_domains(host, RULES.tier1).alias("tier1"), in_domains(host, RULES.tier2).alias("tier2"), F.element_at(F.split(host, r"\."), -1).isin(*RULES.tlds).alias("tld"), host_term(host, RULES).alias("host_term"), fake_official(host).alias("fake_gov"), t.looks_random(label).alias("random_looking"))


_AGAIN = f"(with l as (select doc_id, {_STRIP('line')} as x from {_LINES}), g as (select doc_id, x, count(*) as k, length(x) as n from l where x<>'' group by 1,2) select doc_id, sum(case when k>1 then n*k else 0 end)::double/sum(n*k) as again from g group by 1)"
_CATEGORY = "case h " + " ".join(f"when '{x}' then 'term_{c}'" for x, c in TERMS.items()) + " end"
_CLASSIFY = rf"""with m as (select doc_id, source, host, coalesce(host,'') as h, length(regexp_replace(text,'[^{_HANS[1:-1]}]','','g')) as han, case when {_SHARE}>0.08 then 'hant' else 'hans' end as script, case when {_SHARE}>0.08 then {_CONVERT} else text end as text from documents where text is not null),
f as (select m.*, list_distinct(regexp_extract_all(lower(text),'({_ALT})')) as hits, length(regexp_replace(text,'{_WS}+','','g')) as solid, coalesce(again,0) as again from m left join {_AGAIN} using (doc_id)),
k as (select *, len(list_filter(hits, lambda x: x not in ({','.join(repr(w) for w in WEAK)})))>0 or len(hits)>=2 as hit from f),
r as (select *, list_concat(list_concat(list_filter([case when h<>'' and {_TLD('h')} then 'tld' end, case when {_UNDER('h', RULES.tier1)} then 'domain_tier1' end, case when {_HOSTTERM('h')} then 'host_term' end, case when {_FAKE('h')} then 'fake_gov' end], lambda x: x is not null),
case when hit then list_sort(list_distinct(list_transform(hits, lambda h: {_CATEGORY}))) else [] end),
list_filter([case when han<100 then 'short' end, case when han>=100 and han<0.4*solid then 'low_han' end, case when again>0.3 then 'repetitive' end], lambda x: x is not null)) as dropped,
list_filter([case when len(hits)>0 and not hit then 'weak_term' end, case when {_UNDER('h', RULES.tier2)} then 'domain_tier2' end], lambda x: x is not null) as reviewed from k)
select doc_id, case when len(dropped)>0 then 'drop' when len(reviewed)>0 then 'review' else 'keep' end as decision, array_to_string(list_concat(dropped, reviewed),',') as reasons, script, han from r"""


def classified(spark, d):
    return classify(docs(spark, d).where("text is not null").select("doc_id", "source", "host", "text"), RULES, script=SCRIPT)


@query("txt13", _CLASSIFY)
def txt13(spark, d):
    return classified(spark, d).select("doc_id", "decision", F.array_join("reasons", ",").alias("reasons"), "script", F.col("han").cast("bigint").alias("han"))


@query("txt14", r"""with m as (select doc_id, length(regexp_replace(regexp_replace(text,'[0-9][0-9,]*\s*(円|元|yen)','￼','g'),'[^￼]','','g')) as prices, length(regexp_replace(text,'[^。、，,.!?！？]','','g')) as marks, length(text) as n from documents where text is not null) select doc_id, prices, marks, case when prices>=4 then 'prices' when prices>=1 and marks*40<n then 'catalogue' else '' end as noise from m""")
def txt14(spark, d):
    x = F.col("text")
    m = docs(spark, d).where("text is not null").select("doc_id", t.count_of(x, r"[0-9][0-9,]*\s*(?:円|元|yen)").cast("bigint").alias("prices"), t.count_of(x, "[。、，,.!?！？]").cast("bigint").alias("marks"), F.length(x).alias("n"))
    return m.select("doc_id", "prices", "marks", F.when(F.col("prices") >= 4, "prices").when((F.col("prices") >= 1) & (F.col("marks") * 40 < F.col("n")), "catalogue").otherwise("").alias("noise"))


@query("txt16", f"""select doc_id, line_index, {_STRIP('line')} as paragraph from {_LINES} where {_STRIP('line')}<>'' and strlen({_STRIP('line')})<=2048 and not contains(line, chr(9601))""")
def txt16(spark, d):
    x = t.strip(F.col("line"))
    return lines(spark, d).where((x != "") & (F.octet_length(x) <= 2048) & ~F.col("line").contains("▁")).select("doc_id", "line_index", x.alias("paragraph"))


@query("txt17", r"select id from (select distinct id, text from seq) where length(text) between 8 and 120 and not regexp_matches(text,'https?://|<[a-z/]') and length(regexp_replace(text,'[^\p{Han}]','','g'))*5>=length(text)")
def txt17(spark, d):
    x = F.col("text")
    return table(spark, d, "seq").select("id", "text").distinct().where(F.length(x).between(8, 120) & ~x.rlike("https?://|<[a-z/]") & (t.count_of(x, t.HAN) * 5 >= F.length(x))).select("id")


@query("txt18", r"select item_id, regexp_replace(right(left_context,64),'(?s)^.*[。！？!?\n](.)','\1') as context, regexp_extract(left_context,'(\p{Han}+)$',1) as last_run from eval_items where left_context is not null")
def txt18(spark, d):
    x = F.col("left_context")
    return table(spark, d, "eval_items").where(x.isNotNull()).select("item_id", t.left_window(x).alias("context"), t.last_han_run(x).alias("last_run"))


@query("txt19", f"select doc_id, translate(text,'{t.KATAKANA}','{t.HIRAGANA}') as hiragana from documents")
def txt19(spark, d):
    return docs(spark, d).select("doc_id", t.to_hiragana(F.col("text")).alias("hiragana"))


@query("txt20", "select doc_id, regexp_replace(text,'post\\.kasumi\\.example|hako-mail\\.example|mail\\.example','[secret]','g') as text from documents")
def txt20(spark, d):
    return docs(spark, d).select("doc_id", t.redact(F.col("text"), ["mail.example", "hako-mail.example", "post.kasumi.example"]).alias("text"))


@query("txt21", "select distinct item_id, v as variant from (select item_id, unnest([a, regexp_replace(a,'[。．]$',''), replace(a,'、','，'), translate(a,'０１２３４５６７８９','0123456789')]) as v from (select item_id, unnest(answers) as a from eval_items)) where v<>''")
def txt21(spark, d):
    a = F.col("a")
    forms = F.slice(F.array_sort(F.array_distinct(F.array(a, F.regexp_replace(a, "[。．]$", ""), F.replace(a, F.lit("、"), F.lit("，")), F.translate(a, "０１２３４５６７８９", "0123456789")))), 1, 16)
    return table(spark, d, "eval_items").select("item_id", F.explode("answers").alias("a")).select("item_id", F.explode(forms).alias("variant")).where("variant <> ''").distinct()


@query("txt22", "select bucket, count(*) as rows from (select case when length(text)<=16 then 'short' when length(text)<=32 then 'medium' else 'long' end as bucket from seq where text is not null) group by 1")
def txt22(spark, d):
    return table(spark, d, "seq").where("text is not null").groupBy(t.length_bucket(F.length("text"), [(16, "short"), (32, "medium")], "long").alias("bucket")).agg(F.count("*").alias("rows"))


@query("txt23", r"select gram, count(*) as n from (select unnest(list_transform(range(1, length(x)-1), lambda i: substring(x, i, 3))) as gram from (select regexp_replace(text,'[0-9]','0','g') as x from eval_items) where length(x)>=3) group by 1")
def txt23(spark, d):
    x = F.regexp_replace("text", "[0-9]", "0")
    return table(spark, d, "eval_items").select(F.explode(t.char_grams(x, 3)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query("txt24", rf"select id, regexp_matches(text,'[\p{{L}}\p{{N}}]') as has_alnum, regexp_full_match(text,'\p{{Han}}+') as all_han, {_STRIP('text')}=text as trimmed from (select distinct id, text from seq where text is not null)")
def txt24(spark, d):
    x = F.col("text")
    return table(spark, d, "seq").where("text is not null").select("id", "text").distinct().select("id", x.rlike(r"[\p{L}\p{N}]").alias("has_alnum"), x.rlike(r"^\p{IsHan}+\z").alias("all_han"), (t.strip(x) == x).alias("trimmed"))


@query("txt25", "select n_name, min(levenshtein(n_name, r_name)/greatest(length(r_name),1)) as cer from nation, region group by 1")
def txt25(spark, d):
    names = table(spark, d, "region").agg(F.collect_list("r_name").alias("refs"))  # five rows by the table's definition
    return table(spark, d, "nation").crossJoin(F.broadcast(names)).select("n_name", t.best_cer(F.col("n_name"), F.col("refs")).alias("cer"))


@query("txt26")
def txt26(spark, d):
    """Items of a suite that are nearly another of the suite: a ratio of 0.85 or more.

    The ratio is 2 m / (x + y) with m matched of x and y characters, so m >= 0.425 / 0.575 x, and two such texts share one
    of the x - m + 1 characters (with the number of their occurrence) that are rarest in the suite, at any place.
    """
    w = Window.partitionBy("suite", "item_id", "text").orderBy("df", "ch", "k")
    e = table(spark, d, "eval_items").where("text is not null").select("suite", "item_id", "text").distinct()
    chars = F.when(F.length("text") > 0, t.char_grams(F.col("text"), 1)).otherwise(F.array(F.lit("")))
    of_text = e.select("suite", "item_id", "text", F.explode(chars).alias("ch")).groupBy("suite", "item_id", "text", "ch").agg(F.count("*").alias("n"))
    signs = of_text.select("suite", "item_id", "text", "ch", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("k"))
    df = signs.groupBy("suite", "ch", "k").agg(F.count("*").alias("df"))
    x = F.length("text")
    rare = signs.join(df, ["suite", "ch", "k"]).withColumn("r", F.row_number().over(w)).where(F.col("r") <= x - F.ceil(x * (0.425 / 0.575) - 1e-9) + 1).select("suite", "item_id", "text", "ch", "k")
    met = rare.alias("a").join(rare.alias("b"), ["suite", "ch", "k"]).where("a.item_id < b.item_id")
    pairs = met.select(F.col("a.item_id").alias("item_a"), F.col("b.item_id").alias("item_b"), F.col("a.text").alias("x"), F.col("b.text").alias("y")).distinct()
    fit = pairs.where(2 * F.least(F.length("x"), F.length("y")) >= 0.85 * (F.length("x") + F.length("y")) - 1e-9)
    return fit.select("item_a", "item_b", t.sequence_ratio(F.col("x"), F.col("y")).alias("ratio")).where("ratio >= 0.85")

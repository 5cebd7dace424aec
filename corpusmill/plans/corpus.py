"""Queries of joins, aggregates, windows, duplicates, groups, splits, sets and samples."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.functions import text as t
from corpusmill.operators import dedup as dd
from corpusmill.operators import joins as jn
from corpusmill.operators import records as rec
from corpusmill.operators.annotations import require
from corpusmill.operators.components import connected_components
from corpusmill.plans.registry import query
from corpusmill.plans.text import _NORM, TERMS, _ALT, _CLASSIFY, classified
from corpusmill.runtime import Stage, table


def T(spark, d, name):
    return table(spark, d, name)


def units(spark, d):
    return T(spark, d, "units").select("doc_hash", "text_hash", "text", "paragraph_index", "sentence_index").distinct()


def origins(spark, d):
    return T(spark, d, "origins").select("doc_hash", "doc_id", "source", "source_file", "row_index").distinct()


_U = "(select distinct doc_hash, text_hash, text, paragraph_index, sentence_index from units)"
_O = "(select distinct doc_hash, doc_id, source, source_file, row_index from origins)"


# ---- joins


@query("jn01", f"with w as (select text_hash, min(doc_hash) as doc_hash from {_U} group by 1) select o.source, c.split_rank, count(*) as rows from {_U} u join w using (text_hash, doc_hash) join contents c using (doc_hash) join {_O} o using (doc_hash) group by 1,2")
def jn01(spark, d):
    u = units(spark, d).select("doc_hash", "text_hash", "paragraph_index", "sentence_index")
    w = u.groupBy("text_hash").agg(F.min("doc_hash").alias("doc_hash"))
    x = u.join(w, ["text_hash", "doc_hash"]).join(T(spark, d, "contents").select("doc_hash", "split_rank"), "doc_hash").join(origins(spark, d).select("doc_hash", "source"), "doc_hash")
    return x.groupBy("source", "split_rank").agg(F.count("*").alias("rows"))


@query("jn02", f"select u.text_hash, o.doc_id, o.row_index, count(*) as occurrences from {_U} u join {_O} o using (doc_hash) join contents c using (doc_hash) group by 1,2,3")
def jn02(spark, d):
    x = units(spark, d).select("doc_hash", "text_hash").join(origins(spark, d).select("doc_hash", "doc_id", "row_index"), "doc_hash").join(T(spark, d, "contents").select("doc_hash"), "doc_hash")
    return x.groupBy("text_hash", "doc_id", "row_index").agg(F.count("*").alias("occurrences"))


@query("jn03", "select doc_hash from contents where group_id in (select group_id from contents where split_rank=1)")
def jn03(spark, d):
    c = T(spark, d, "contents")
    return c.join(c.where("split_rank = 1").select("group_id"), "group_id", "left_semi").select("doc_hash")


@query("jn04", "select doc_hash from contents c where not exists (select 1 from docs d where d.id=c.doc_hash)")
def jn04(spark, d):
    return T(spark, d, "contents").join(T(spark, d, "docs").select(F.col("id").alias("doc_hash")), "doc_hash", "left_anti").select("doc_hash")


@query("jn05", "with spam as (select host from documents where host is not null group by 1 having count(*)>=30), f as (select doc_id, case when host in (select host from spam) then 'host' when lang is null then 'lang' when length(text)<40 then 'short' else 'kept' end as reason from documents) select reason, count(*) as docs from f group by 1")
def jn05(spark, d):
    x = T(spark, d, "documents").select("doc_id", "host", "lang", F.length("text").alias("n"))
    spam = x.where("host is not null").groupBy("host").agg(F.count("*").alias("k")).where("k >= 30").select("host", F.lit(True).alias("listed"))
    reason = F.when(F.col("listed"), "host").when(F.col("lang").isNull(), "lang").when(F.col("n") < 40, "short").otherwise("kept")
    return x.join(spam, "host", "left").groupBy(reason.alias("reason")).agg(F.count("*").alias("docs"))


@query("jn06", "with dom as (select distinct regexp_replace(host,'^[^.]+\\.','') as domain from documents where host is not null) select d.host, dom.domain, count(*) as docs from documents d join dom on d.host=dom.domain or ends_with(d.host, '.'||dom.domain) group by 1,2")
def jn06(spark, d):
    x = T(spark, d, "documents").where("host is not null").select("doc_id", "host")
    domains = x.select(F.regexp_replace("host", r"^[^.]+\.", "").alias("domain")).distinct()
    return jn.domain_join(x, "host", domains, "domain").groupBy("host", "domain").agg(F.count("*").alias("docs"))


@query("jn07", "select e.item_id, count(distinct d.doc_id) as docs from documents d, eval_items e where length(e.text)>0 and contains(d.text, e.text) group by 1")
def jn07(spark, d):
    return jn.contained(T(spark, d, "documents"), "doc_id", "text", T(spark, d, "eval_items"), "item_id", "text").groupBy("item_id").agg(F.count_distinct("doc_id").alias("docs"))


_G12 = lambda tab, key: f"(select distinct {key}, substring(text, i, 12) as g from (select {key}, text, unnest(range(1, length(text)-10)) as i from {tab} where length(text)>=12))"


@query("jn08", f"select doc_id, item_id, count(*) as shared from {_G12('documents','doc_id')} join {_G12('eval_items','item_id')} using (g) group by 1,2")
def jn08(spark, d):
    return jn.shared_grams(T(spark, d, "documents"), "doc_id", "text", T(spark, d, "eval_items"), "item_id", "text", 12)


@query("jn09", "select distinct d.doc_id, e.item_id from documents d, eval_items e where length(e.text)>=12 and contains(d.text, e.text)")
def jn09(spark, d):
    return jn.anchor_join(T(spark, d, "documents"), "doc_id", "text", T(spark, d, "eval_items"), "item_id", "text", 12)


@query("jn10", "select distinct id from seq s where pool='chat' and not exists (select 1 from seq w where w.pool='web' and regexp_replace(w.text,'\\s+','','g')=regexp_replace(s.text,'\\s+','','g'))")
def jn10(spark, d):
    s = T(spark, d, "seq").select("id", "pool", F.regexp_replace("text", r"[\t\n\f\r ]+", "").alias("key"))
    return dd.against_earlier(s.where("pool = 'chat'"), s.where("pool = 'web'"), "key").select("id").distinct()


@query("jn11", "select o_orderstatus, count(*) as pairs, sum(lines)::bigint as lines from orders join (select l_orderkey, count(*) as lines from lineitem group by 1) on o_orderkey=l_orderkey group by 1")
def jn11(spark, d):
    """Orders as one result and the sums of their lines as another; both carry the key of the year, which must agree."""
    o = T(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderkey").alias("same"))
    lines = T(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines")).withColumn("same", F.col("o_orderkey"))
    left = o.join(lines.select("o_orderkey"), "o_orderkey", "left_semi")
    return jn.aligned(left, lines, "o_orderkey", ["same"]).groupBy(F.col("l.o_orderstatus").alias("o_orderstatus")).agg(F.count("*").alias("pairs"), F.sum("r.lines").alias("lines"))


_G3 = "(select distinct item_id, substring(text, i, 3) as g from (select item_id, text, unnest(range(1, length(text)-1)) as i from eval_items where length(text)>=3))"


@query("jn13", f"with g as {_G3}, n as (select item_id, count(*) n from g group by 1), p as (select a.item_id as a, b.item_id as b, count(*) as shared from g a join g b on a.g=b.g and a.item_id<b.item_id group by 1,2) select a, b, shared, n1.n+n2.n-shared as \"all\" from p join n n1 on n1.item_id=a join n n2 on n2.item_id=b where shared>=0.5*(n1.n+n2.n-shared)")
def jn13(spark, d):
    x = jn.gram_jaccard(T(spark, d, "eval_items"), "item_id", "text", 3, 0.5)
    return x.select("a", "b", F.col("shared").cast("bigint").alias("shared"), F.col("all").cast("bigint").alias("all"))


@query("jn14")
def jn14(spark, d):
    """Of each suite, items in order whose trigram Jaccard with each picked before is under 0.5; suites are small by construction.

    Trigrams as in the reference: NFKC, runs of digits masked; a text under three characters is its own only one.
    """

    def pick(frame):
        import re
        import unicodedata

        def grams(text):
            x = re.sub("[0-9]+", "0", unicodedata.normalize("NFKC", text))
            return {x[i : i + 3] for i in range(max(1, len(x) - 2))}

        kept: list[set] = []
        rows = []
        for item, text in sorted(zip(frame["item_id"], frame["text"], strict=True)):
            g = grams(text)
            if all(len(g & k) < 0.5 * len(g | k) for k in kept):
                kept.append(g)
                rows.append(item)
        return frame[frame["item_id"].isin(rows)][["suite", "item_id"]]

    return T(spark, d, "eval_items").select("suite", "item_id", "text").groupBy("suite").applyInPandas(pick, "suite string, item_id bigint")


_IV = "(select user_id, epoch_us(ts)//1000 as s, epoch_us(ts)//1000+floor(abs(value)*60000)::bigint as e from events)"


def intervals(spark, d):
    s = F.unix_millis(F.col("ts").cast("timestamp"))
    return T(spark, d, "events").select("user_id", s.alias("s"), (s + F.floor(F.abs("value") * 60000)).alias("e"))


@query("jn15", f"with m as (select *, max(e) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding) as r from {_IV} where e>s) select user_id, sum(greatest(0, e-greatest(s, coalesce(r,s))))::bigint as covered, count(*) filter (r is null or s>r) as islands from m group by 1")
def jn15(spark, d):
    return jn.union_length(intervals(spark, d), "s", "e", "user_id").select("user_id", F.col("covered").cast("bigint").alias("covered"), "islands")


@query("jn15_clip", f"with b as (select min(s)+86400000 as lo, min(s)+172800000 as hi from {_IV}) select user_id, sum(least(e,hi)-greatest(s,lo))::bigint as inside from {_IV}, b where greatest(s,lo)<least(e,hi) group by 1")
def jn15_clip(spark, d):
    x = intervals(spark, d)
    first = x.agg(F.min("s")).first()[0] or 0
    return jn.clipped(x, "s", "e", F.lit(first + 86_400_000), F.lit(first + 172_800_000)).groupBy("user_id").agg(F.sum(F.col("e") - F.col("s")).alias("inside"))


@query("jn16", "with a as (select distinct regexp_replace(text,'\\s+','','g') as k from documents where doc_id%2=0) select doc_id from documents where doc_id%2=1 and text is not null and regexp_replace(text,'\\s+','','g') not in (select k from a where k is not null)")
def jn16(spark, d):
    """Even document numbers as the earlier export, odd ones as the new shard."""
    x = T(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(F.regexp_replace("text", r"[\t\n\f\r ]+", ""), 256).alias("key"))
    return dd.against_earlier(x.where("doc_id % 2 = 1"), x.where("doc_id % 2 = 0"), "key").select("doc_id")


@query("jn17", "select item_id, p, answers[p+1] as answer from (select item_id, answers, unnest(range(0,len(answers))) as p from eval_items)")
def jn17(spark, d):
    return T(spark, d, "eval_items").select("item_id", F.posexplode("answers").alias("p", "answer")).select("item_id", F.col("p").cast("bigint").alias("p"), "answer")


# ---- aggregates


@query("agg01", f"select text_hash, max(split_rank) as rank, string_agg(distinct source, ',' order by source) as sources from {_U} u join contents using (doc_hash) join {_O} o using (doc_hash) group by 1")
def agg01(spark, d):
    x = units(spark, d).select("doc_hash", "text_hash").distinct().join(T(spark, d, "contents").select("doc_hash", "split_rank"), "doc_hash").join(origins(spark, d).select("doc_hash", "source").distinct(), "doc_hash")
    return x.groupBy("text_hash").agg(F.max("split_rank").alias("rank"), F.nullif(F.array_join(F.array_sort(F.collect_set("source")), ","), F.lit("")).alias("sources"))


@query("agg02", f"select text_hash, case when bool_or(coalesce(length(text)<12,false)) then 0 else max(split_rank) end as rank, bit_or(1<<coalesce(split_rank,3)) as mask from {_U} join contents using (doc_hash) group by 1")
def agg02(spark, d):
    x = units(spark, d).join(T(spark, d, "contents").select("doc_hash", "split_rank"), "doc_hash")
    return x.groupBy("text_hash").agg(F.when(F.bool_or(F.coalesce(F.length("text") < 12, F.lit(False))), 0).otherwise(F.max("split_rank")).alias("rank"), F.bit_or(F.expr("shiftleft(1, coalesce(split_rank, 3))")).alias("mask"))


@query("agg03", "select split, source, count(*) as sentences, sum(length(text))::bigint as chars from seq group by 1,2")
def agg03(spark, d):
    return T(spark, d, "seq").groupBy("split", "source").agg(F.count("*").alias("sentences"), F.sum(F.length("text")).alias("chars"))


@query("agg04", f"select count(*) as units, count(distinct text_hash) as sentences, count(distinct doc_hash) as docs, sum(length(text))::bigint as chars, sum(ceil(length(text)/1.6))::bigint as tokens_16, sum(ceil(length(text)/2.5))::bigint as tokens_25 from {_U}")
def agg04(spark, d):
    return rec.corpus_stats(units(spark, d), "text", "text_hash", "doc_hash", {"tokens_16": 1.6, "tokens_25": 2.5})


@query("agg05", "select k as metric, sum(v)::bigint as total from (select unnest(['chars','lines','marks']) as k, unnest([length(text), length(text)-length(replace(text,chr(10),''))+1, length(regexp_replace(text,'[^。！？]','','g'))]) as v from documents where text is not null) group by 1")
def agg05(spark, d):
    x = F.col("text")
    m = F.create_map(F.lit("chars"), F.length(x), F.lit("lines"), F.size(F.split(x, "\n")), F.lit("marks"), t.count_of(x, "[。！？]"))
    return T(spark, d, "documents").where("text is not null").select(F.explode(m).alias("metric", "v")).groupBy("metric").agg(F.sum("v").cast("bigint").alias("total"))


@query("agg06", f"with c as ({_CLASSIFY}) select decision, reason, count(*) as docs from (select decision, unnest(case when reasons='' then ['none'] else string_split(reasons,',') end) as reason from c) group by 1,2")
def agg06(spark, d):
    return rec.reason_counts(classified(spark, d), "decision", "reasons")


_HOSTS = f"(select d.host, count(*) as docs, count(*) filter (c.decision='drop') as drops from documents d join ({_CLASSIFY}) c using (doc_id) where host is not null group by 1)"


@query("agg07", f"select host, docs, drops, docs-drops as survivors from {_HOSTS} where docs>=10 and drops>=0.03*docs")
def agg07(spark, d):
    return rec.host_stats(classified(spark, d), "host", "decision", 10, 0.03)


@query("agg08", "select regexp_extract(host,'([^.]+\\.[^.]+)$',1) as domain, count(distinct host) as hosts, count(*) as docs from documents where host is not null group by 1 having count(distinct host)>=1")
def agg08(spark, d):
    return rec.domain_farms(T(spark, d, "documents"), "host", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1), 1)


@query("agg09", f"select term, source, count(*) as docs from (select distinct doc_id, source, unnest(regexp_extract_all(lower(text), '({_ALT})')) as term from documents) group by grouping sets ((term),(source),(term,source))")
def agg09(spark, d):
    x = T(spark, d, "documents").select("doc_id", "source", F.explode(t.terms_found(F.col("text"), list(TERMS))).alias("term"))
    return x.groupingSets([["term"], ["source"], ["term", "source"]], "term", "source").agg(F.count("*").alias("docs"))


@query("agg10", "with h as (select length(text) as n from seq where text is not null), r as (select n, row_number() over (order by n) as k, count(*) over () as c from h) select 'p50' as q, min(n) as length from r where k>=ceil(c*0.5) union all select 'p90', min(n) from r where k>=ceil(c*0.9) union all select 'p99', min(n) from r where k>=ceil(c*0.99)")
def agg10(spark, d):
    x = T(spark, d, "seq").select(F.length("text").alias("length"))
    return dd.exact_quantiles(x, "length", {"p50": 0.5, "p90": 0.9, "p99": 0.99}).select(F.col("name").alias("q"), F.col("quantile").alias("length"))


@query("agg11", "select l_returnflag, quantile_cont(l_quantity,0.9) as p90, quantile_disc(l_quantity,0.9) as nearest, median(l_quantity) as median from lineitem group by 1")
def agg11(spark, d):
    return T(spark, d, "lineitem").groupBy("l_returnflag").agg(F.percentile("l_quantity", F.lit(0.9)).alias("p90"), F.expr("percentile_disc(0.9) within group (order by l_quantity)").alias("nearest"), F.median("l_quantity").alias("median"))


@query("agg12", "select split, sum(length(text))::bigint as chars, sum(len(tokens)-2)::bigint as tokens, count(*) filter (len(tokens)<=32) as fits, max(len(tokens)) as longest from (select distinct id, split, text, tokens from seq where text is not null) group by 1")
def agg12(spark, d):
    n = F.size("tokens")
    x = T(spark, d, "seq").where("text is not null").select("id", "split", "text", "tokens").distinct()
    return x.groupBy("split").agg(F.sum(F.length("text")).alias("chars"), F.sum(n - 2).alias("tokens"), F.count_if(n <= 32).alias("fits"), F.max(n).alias("longest"))


_FRAC = "(('0x'||substr(sha256({}),1,16))::ubigint::double/18446744073709551616.0)"


@query("agg13", f"with r as (select doc_id, {_FRAC.format(chr(39)+'pool:'+chr(39)+'||doc_id')} as u, length(text) as n from documents where text is not null), s as (select u, sum(n) over (order by u, doc_id) as s, sum(n) over () as a from r) select 'p20' as pool, min(u) as q from s where s>=0.2*a union all select 'p5', min(u) from s where s>=0.05*a union all select 'p1', min(u) from s where s>=0.01*a")
def agg13(spark, d):
    u = t.hash_fraction(F.lit("pool:"), F.col("doc_id").cast("string"))
    x = T(spark, d, "documents").where("text is not null").select("doc_id", u.alias("u"), F.length("text").alias("n"))
    run = Stage(dd.running_total(x, "n", ["u", "doc_id"], name="s"), "pools").df
    total = run.agg(F.max("s")).first()[0] or 0
    out = None
    for name, share in (("p20", 0.2), ("p5", 0.05), ("p1", 0.01)):
        q = run.where(F.col("s") >= share * total).agg(F.min("u").alias("q")).select(F.lit(name).alias("pool"), "q")
        out = q if out is None else out.unionByName(q)
    return out


@query("agg28", "with g as (select substring(x,i,3) as g from (select x, unnest(range(1,length(x)-1)) as i from (select distinct id, '^'||text||'$' as x from seq where text is not null and pool='web')) ) select substr(g,1,2) as ctx, substr(g,3,1) as ch, count(*) as n, sum(count(*)) over (partition by substr(g,1,2))::bigint as total, count(*) over (partition by substr(g,1,2)) as kinds from g group by 1,2")
def agg28(spark, d):
    x = T(spark, d, "seq").where("text is not null and pool = 'web'").select("id", F.concat(F.lit("^"), "text", F.lit("$")).alias("x")).distinct()
    g = x.select(F.explode(t.char_grams(F.col("x"), 3)).alias("g")).groupBy(F.substring("g", 1, 2).alias("ctx"), F.substring("g", 3, 1).alias("ch")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("ctx")
    return g.withColumn("total", F.sum("n").over(w)).withColumn("kinds", F.count("*").over(w))


@query("agg28_left", "with g as (select distinct substring(x,i,3) as g from (select x, unnest(range(1,length(x)-1)) as i from (select '^'||text||'$' as x from seq where text is not null and pool='web'))) select substr(g,2,2) as tail, count(*) as continuations from g group by 1")
def agg28_left(spark, d):
    x = T(spark, d, "seq").where("text is not null and pool = 'web'").select(F.concat(F.lit("^"), "text", F.lit("$")).alias("x"))
    return x.select(F.explode(t.char_grams(F.col("x"), 3)).alias("g")).distinct().groupBy(F.substring("g", 2, 2).alias("tail")).agg(F.count("*").alias("continuations"))


@query("agg29", "with c as (select p_type, p_brand, p_size, count(*) as n from part group by 1,2,3 having count(*)>=2) select p_type, p_brand, count(*) as readings, sum(n)::bigint as uses from c group by 1,2 having count(*)>=2")
def agg29(spark, d):
    c = T(spark, d, "part").groupBy("p_type", "p_brand", "p_size").agg(F.count("*").alias("n")).where("n >= 2")
    return c.groupBy("p_type", "p_brand").agg(F.count("*").alias("readings"), F.sum("n").alias("uses")).where("readings >= 2")


@query("agg30", "select floor(epoch(ts)/1800)::bigint as bucket, min(value) as least, max(value) as peak, median(value) as median, count(*) as samples from events group by 1")
def agg30(spark, d):
    return rec.sample_windows(T(spark, d, "events"), "ts", "value", 1800)


@query("agg31", "select split, pool, count(distinct sig) as screened, count(distinct case when sig in (select sig from seen where split='train') then sig end) as flagged from seq group by 1,2")
def agg31(spark, d):
    return rec.overlap_summary(T(spark, d, "seq"), T(spark, d, "seen").where("split = 'train'"), ["split", "pool"], "sig")


@query("agg32", "select kind, word, w from (select kind, word, sum(weight) as w, sum(sum(weight)) over (partition by kind) as a from (select distinct word, kind, weight from lexicon where weight is not null) group by 1,2) where w>=0.05*a")
def agg32(spark, d):
    return rec.usable(T(spark, d, "lexicon").select("word", "kind", "weight").distinct(), "kind", "word", "weight", 0.05)


@query("agg33", "select l_returnflag, count(*) as rows from lineitem group by 1")
def agg33(spark, d):
    """Counters by ship year, summed, against those of the whole table counted anew; a difference fails the query."""
    li = T(spark, d, "lineitem")
    parts = li.groupBy(F.year("l_shipdate").alias("part"), "l_returnflag").agg(F.count("*").alias("rows"))
    return rec.same_counters(parts, li.groupBy("l_returnflag").agg(F.count("*").alias("rows")), "l_returnflag", "rows")


# ---- windows and orders


@query("win01", f"select text_hash, doc_id, row_index, paragraph_index, sentence_index from (select u.text_hash, o.doc_id, o.row_index, u.paragraph_index, u.sentence_index, row_number() over (partition by text_hash order by (coalesce(o.source,'')<>'sentences')::int, o.doc_id, o.source_file, o.row_index, u.paragraph_index, u.sentence_index) as r from {_U} u join {_O} o using (doc_hash)) where r=1")
def win01(spark, d):
    first = F.when(F.col("source") == "sentences", 0).otherwise(1)
    # One preferred origin for each content first, so that the join does not multiply the units.
    o = dd.primary(origins(spark, d).withColumn("p", first), ["doc_hash"], [F.col(c) for c in ("p", "doc_id", "source_file", "row_index")])
    x = units(spark, d).drop("text").join(o, "doc_hash")
    return dd.primary(x, ["text_hash"], [F.col(c) for c in ("p", "doc_id", "source_file", "row_index", "paragraph_index", "sentence_index")]).select("text_hash", "doc_id", "row_index", "paragraph_index", "sentence_index")


@query("win02", f"with o as (select doc_hash, min(k) as k from (select doc_hash, row_number() over (order by (coalesce(source,'')<>'sentences')::int, doc_id, source_file, row_index, doc_hash) as k from {_O}) group by 1) select text_hash, min(k) as priority from {_U} join o using (doc_hash) group by 1")
def win02(spark, d):
    o = origins(spark, d).withColumn("p", F.when(F.col("source") == "sentences", 0).otherwise(1))
    ranked = dd.global_rank(o, ["p", "doc_id", "source_file", "row_index", "doc_hash"])
    best = ranked.groupBy("doc_hash").agg(F.min("rank").alias("k"))
    return units(spark, d).select("text_hash", "doc_hash").join(best, "doc_hash").groupBy("text_hash").agg(F.min("k").alias("priority"))


_TRAIN = "(select distinct id, pool, priority, pairs from docs where split='train' and pairs>0 and priority is not null)"


@query("win03", f"select pool, id, pairs from (select *, sum(pairs) over (partition by pool order by priority, id rows unbounded preceding) as s from {_TRAIN}) where s<=20000")
def win03(spark, d):
    x = T(spark, d, "docs").where("split = 'train' and pairs > 0 and priority is not null").select("id", "pool", "priority", "pairs").distinct()
    return dd.running_total(x, "pairs", ["priority", "id"], ["pool"]).where("running <= 20000").select("pool", "id", "pairs")


@query("win03_skip", f"""with recursive x as (select *, row_number() over (partition by pool order by priority, id) as r from {_TRAIN}),
w as (select pool, 0::bigint as r, 0::bigint as used, ''::varchar as id, 0::bigint as pairs, false as taken from x group by 1 union all
select x.pool, x.r, case when w.used+x.pairs<=20000 then w.used+x.pairs else w.used end, x.id, x.pairs, w.used+x.pairs<=20000 from w join x on x.pool=w.pool and x.r=w.r+1) select pool, id, pairs from w where taken""")
def win03_skip(spark, d):
    """The walk that skips what does not fit."""
    x = T(spark, d, "docs").where("split = 'train' and pairs > 0 and priority is not null").select("id", "pool", "priority", "pairs").distinct()
    return dd.budget_walk(x, "pool", "pairs", ["priority", "id"], 20_000).select("pool", "id", "pairs")


@query("win04", "select id from (select id, row_number() over (partition by text order by id) as r, count(*) over (partition by text) as n from (select distinct id, text from seq where pool='chat' and text is not null)) where (r-1)*(r-1)<n")
def win04(spark, d):
    """Of n equal chat turns the first ceil(sqrt(n)), by whole numbers; occurrences are numbered by ranges, for stock replies are hot."""
    x = T(spark, d, "seq").where("pool = 'chat' and text is not null").select("id", "text").distinct().select("id", F.sha2("text", 256).alias("key"))
    return dd.global_rank(x, ["id"], ["key"], size="n").where("(rank - 1) * (rank - 1) < n").select("id")


@query("win05", "select text_sha, doc_id as first_id, n from (select sha256(text) as text_sha, doc_id, row_number() over (partition by text order by doc_id) as r, count(*) over (partition by text) as n from documents where text is not null) where r=1")
def win05(spark, d):
    return T(spark, d, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("text_sha")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


@query("win06", "select item_id, case when (row_number() over (partition by suite order by sha256('42:'||item_id))-1)%2=0 then 'dev' else 'blind' end as role from eval_items")
def win06(spark, d):
    r = F.row_number().over(Window.partitionBy("suite").orderBy(F.sha2(F.concat(F.lit("42:"), F.col("item_id").cast("string")), 256)))
    return T(spark, d, "eval_items").select("item_id", F.when((r - 1) % 2 == 0, "dev").otherwise("blind").alias("role"))


@query("win07", "select vec_id from (select vec_id, label, row_number() over (partition by label order by embedding[1] desc, vec_id) as r, count(*) over (partition by label) as n from embeddings) where r<=greatest(1, round_even(0.1*n,0))")
def win07(spark, d):
    x = T(spark, d, "embeddings").select("vec_id", "label", F.col("embedding")[0].alias("c"))
    n = x.groupBy("label").agg(F.count("*").alias("n"))
    return dd.global_rank(x, [F.desc("c"), F.col("vec_id")], ["label"]).join(n, "label").where(F.col("rank") <= F.greatest(F.lit(1), F.bround(F.col("n") * 0.1))).select("vec_id")


@query("win08", "select l_orderkey, sum(n) over (order by l_orderkey rows between unbounded preceding and current row)::bigint as upto from (select l_orderkey, count(*) as n from lineitem group by 1)")
def win08(spark, d):
    x = T(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return dd.running_total(x, "n", ["l_orderkey"], name="upto").select("l_orderkey", "upto")


@query("win09", "select kind, word, weight from (select kind, word, weight, row_number() over (partition by kind order by weight desc, word) as r from (select distinct kind, word, weight from lexicon where weight is not null)) where r<=10")
def win09(spark, d):
    x = T(spark, d, "lexicon").where("weight is not null").select("kind", "word", "weight").distinct()
    return dd.top(x, ["kind"], [F.desc("weight"), F.col("word")], 10).select("kind", "word", "weight")


@query("win10", "with x as (select suite, item_id, item_group, case when length(text)<=32 then 'short' when length(text)<=64 then 'medium' else 'long' end as stratum from eval_items), r as (select *, row_number() over (partition by suite, stratum order by sha256(item_id::varchar)) as k from x), g as (select *, row_number() over (partition by suite, item_group order by k, stratum, item_id) as own from r), f as (select *, row_number() over (partition by suite order by k, stratum, item_id) as place from g where item_group is null or own<=2) select suite, item_id from f where place<=30")
def win10(spark, d):
    """A round-robin pick over lengths with at most two of a group, thirty of each suite."""
    x = T(spark, d, "eval_items").select("suite", "item_id", "item_group", t.length_bucket(F.length("text"), [(32, "short"), (64, "medium")], "long").alias("stratum"))
    x = x.withColumn("k", F.row_number().over(Window.partitionBy("suite", "stratum").orderBy(F.sha2(F.col("item_id").cast("string"), 256))))
    order = [F.col(c) for c in ("k", "stratum", "item_id")]
    few = dd.top(x, ["suite", "item_group"], order, 2, "own").where("item_group is not null").drop("own").unionByName(x.where("item_group is null"))
    return dd.top(few, ["suite"], order, 30, "place").select("suite", "item_id")


@query("top01", "select text, n from (select text, count(*) as n from seq where pool='chat' and text is not null group by 1) order by n desc, text limit 20")
def top01(spark, d):
    return T(spark, d, "seq").where("pool = 'chat' and text is not null").groupBy("text").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "text").limit(20)


@query("top02", "select source, doc_id from (select source, doc_id, row_number() over (partition by source order by sha256('42:'||doc_id)) as r from documents where source is not null) where r<=5")
def top02(spark, d):
    h = F.sha2(F.concat(F.lit("42:"), F.col("doc_id").cast("string")), 256)
    return dd.top(T(spark, d, "documents").where("source is not null").select("source", "doc_id"), ["source"], [h], 5).select("source", "doc_id")


@query("top06", f"select source_file, doc_id, row_index from (select source_file, doc_id, row_index, row_number() over (partition by source_file order by row_index, doc_id) as r from {_O}) where r<=3")
def top06(spark, d):
    return dd.top(origins(spark, d), ["source_file"], [F.col("row_index"), F.col("doc_id")], 3).select("source_file", "doc_id", "row_index")


@query("srt01", f"select distinct text_hash, text from {_U}")
def srt01(spark, d):
    """All sentences in global order: a range exchange, then sorts inside the ranges."""
    return units(spark, d).select("text_hash", "text").distinct().orderBy("text_hash", "text")


# ---- duplicates, groups, splits


@query("dd01", f"with h as (select doc_id, sha256({_NORM}) as doc_hash from documents where text is not null) select doc_hash, min(doc_id) as doc_id, count(*) as copies from h group by 1")
def dd01(spark, d):
    x = T(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(t.normal_document(F.col("text")), 256).alias("doc_hash"))
    return x.groupBy("doc_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("dd02", f"with w as (select text_hash, max(coalesce(split_rank,0)) as rank, count(distinct split_rank) as splits from {_U} join contents using (doc_hash) group by 1) select rank, count(*) as sentences, count(*) filter (splits>1) as crossing from w group by 1")
def dd02(spark, d):
    x = units(spark, d).select("text_hash", "doc_hash").join(T(spark, d, "contents").select("doc_hash", "split_rank"), "doc_hash")
    w = x.groupBy("text_hash").agg(F.max(F.coalesce("split_rank", F.lit(0))).alias("rank"), F.count_distinct("split_rank").alias("splits"))
    return w.groupBy("rank").agg(F.count("*").alias("sentences"), F.count_if(F.col("splits") > 1).alias("crossing"))


@query("dd03", "select doc_id, first_id from (select doc_id, min(doc_id) over (partition by regexp_replace(text,'\\s+','','g')) as first_id from documents where text is not null) where doc_id<>first_id")
def dd03(spark, d):
    x = T(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(F.regexp_replace("text", r"[\t\n\f\r ]+", ""), 256).alias("k"))
    first = x.groupBy("k").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    return x.join(first, "k").where("doc_id <> first_id").select("doc_id", "first_id")


@query("dd04", "with s as (select distinct id, split, pool, sig from seq where sig is not null), f as (select sig, min_by(split, id) as split from s group by 1) select s.id from s join f using (sig) where s.split=f.split and (s.pool='chat' or s.id=(select min(id) from s x where x.sig=s.sig and x.pool='web' and x.split=s.split))")
def dd04(spark, d):
    s = T(spark, d, "seq").where("sig is not null").select("id", "split", "pool", "sig").distinct()
    first = s.groupBy("sig").agg(F.min_by("split", "id").alias("first"))
    same = s.join(first, "sig").where("split = first")
    return same.where("pool = 'chat'").select("id").unionByName(same.where("pool = 'web'").groupBy("sig", "split").agg(F.min("id").alias("id")).select("id"))


@query("dd05", "with s as (select distinct id, pool, text, tokens from seq where text is not null), a as (select pool, text, tokens, min(id) as id from (select pool, text, min(id) as id from s group by 1,2) join s using (pool, text, id) group by 1,2,3) select min(id) as id from a group by pool, tokens")
def dd05(spark, d):
    """Unique on the task's case, here pool and text, and then on the encoded sequence; both by partial minima."""
    s = T(spark, d, "seq").where("text is not null").select("id", "pool", "text", "tokens").distinct()
    cases = s.groupBy("pool", F.sha2("text", 256).alias("case")).agg(F.min_by(F.struct("id", "tokens"), "id").alias("x"))
    return cases.groupBy("pool", "x.tokens").agg(F.min("x.id").alias("id")).select("id")


@query("dd06", "select distinct id from seq where split='train' and not (length(text)>=10 and text in (select text from seq where split<>'train' and text is not null))")
def dd06(spark, d):
    s = T(spark, d, "seq").select("id", "split", "text").distinct()
    held = s.where("split <> 'train' and length(text) >= 10").select("text").distinct()
    return s.where("split = 'train' and text is not null").join(held, "text", "left_anti").select("id").distinct()


_EDGES = "(select a.doc_hash as a, b.doc_hash as b from (select distinct alias_key, doc_hash from aliases where length(alias_key)>4 and doc_hash in (select doc_hash from contents)) a join (select alias_key, min(doc_hash) as doc_hash from aliases where length(alias_key)>4 and doc_hash in (select doc_hash from contents) group by 1) b using (alias_key))"


def _groups(spark, d):
    c = T(spark, d, "contents").select("doc_hash")
    a = T(spark, d, "aliases").where("length(alias_key) > 4").select("alias_key", "doc_hash").join(c, "doc_hash", "left_semi").distinct()
    roots = connected_components(a.select(F.concat(F.lit("~"), "alias_key").alias("a"), F.col("doc_hash").alias("b")))
    # "~" sorts behind every hex digit, so the root of a component is its smallest hash.
    return c.join(roots.withColumnRenamed("v", "doc_hash"), "doc_hash", "left").select("doc_hash", F.coalesce("root", "doc_hash").alias("root"))


@query("grp01", f"with recursive e as (select a, b from {_EDGES} union select b, a from {_EDGES}), w as (select doc_hash as v, doc_hash as r from contents union select e.b, w.r from w join e on e.a=w.v) select v as doc_hash, min(r) as root from w group by 1")
def grp01(spark, d):
    return _groups(spark, d)


@query("grp02", f"with recursive g as {_G3}, n as (select item_id, count(*) n from g group by 1), p as (select a.item_id as a, b.item_id as b, count(*) as s from g a join g b on a.g=b.g and a.item_id<b.item_id group by 1,2), e0 as (select a, b from p join n n1 on n1.item_id=a join n n2 on n2.item_id=b where s>=0.5*(n1.n+n2.n-s) union select x.item_id, y.item_id from eval_items x join eval_items y on x.item_group=y.item_group and x.item_id<y.item_id), e as (select a,b from e0 union select b,a from e0), w as (select item_id as v, item_id as r from eval_items union select e.b, w.r from w join e on e.a=w.v) select v as item_id, min(r) as cluster from w group by 1")
def grp02(spark, d):
    e = T(spark, d, "eval_items").select("item_id", "item_group", "text")
    similar = jn.gram_jaccard(e, "item_id", "text", 3, 0.5).select("a", "b")
    lead = e.where("item_group is not null").groupBy("item_group").agg(F.min("item_id").alias("a"))
    grouped = e.where("item_group is not null").join(lead, "item_group").select("a", F.col("item_id").alias("b"))
    roots = connected_components(similar.unionByName(grouped)).select(F.col("v").alias("item_id"), "root")
    return e.select("item_id").join(roots, "item_id", "left").select("item_id", F.coalesce("root", "item_id").alias("cluster"))


_SPLIT = f"case when u<0.98 then 'train' when u<0.99 then 'validation' else 'test' end"


@query("spl01", f"select doc_hash, {_SPLIT} as split from (select doc_hash, {_FRAC.format(chr(39)+'42:'+chr(39)+'||coalesce(group_id,doc_hash)')} as u from contents)")
def spl01(spark, d):
    return T(spark, d, "contents").select("doc_hash", dd.split_by_hash(F.coalesce("group_id", "doc_hash"), 42, 0.98, 0.01).alias("split"))


@query("spl02", f"select text_hash, ['train','validation','test'][max(coalesce(split_rank,0))+1] as split from {_U} join contents using (doc_hash) group by 1")
def spl02(spark, d):
    x = units(spark, d).select("text_hash", "doc_hash").join(T(spark, d, "contents").select("doc_hash", "split_rank"), "doc_hash")
    return x.groupBy("text_hash").agg(F.element_at(F.array(F.lit("train"), F.lit("validation"), F.lit("test")), F.max(F.coalesce("split_rank", F.lit(0))) + 1).alias("split"))


@query("spl03", f"select doc_id from documents where {_FRAC.format(chr(39)+'validation'+chr(39)+'||chr(0)||doc_id')}<0.05")
def spl03(spark, d):
    return T(spark, d, "documents").where(dd.hash_share(0.05, F.lit("validation\0"), F.col("doc_id").cast("string"))).select("doc_id")


@query("spl04", "select id, case when h<9800 then 'train' when h<9900 then 'validation' else 'test' end as split from (select distinct id, ('0x'||substr(sha256(id),1,15))::ubigint%10000 as h from docs where id is not null)")
def spl04(spark, d):
    split = rec.modulo_split(F.col("id"), 10_000, [(9_800, "train"), (9_900, "validation")], "test")
    return T(spark, d, "docs").where("id is not null").select("id").distinct().select("id", split.alias("split"))


@query("spl05", f"select doc_id, case when u<0.001 then 0 when u<0.01 then 3 when u<0.05 then 2 when u<0.2 then 1 end as tier from (select doc_id, {_FRAC.format(chr(39)+'pool:'+chr(39)+'||doc_id')} as u from documents)")
def spl05(spark, d):
    """Pools inside each other, and a probe tier of its own."""
    tier = rec.hash_tier(F.col("doc_id").cast("string"), "pool:", [(0.001, 0), (0.01, 3), (0.05, 2), (0.2, 1)])
    return T(spark, d, "documents").select("doc_id", tier.alias("tier"))


@query("spl06", "select distinct o_custkey, case when row_number() over (partition by p order by sha256('42:'||o_custkey))<=20 then 'dev' else 'blind' end as role from (select o_custkey, min(o_orderpriority) as p from orders group by 1)")
def spl06(spark, d):
    a = T(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderpriority").alias("p"))
    return rec.capped_role(a, "o_custkey", "p", 20, 42, "dev", "blind")


@query("spl07", f"select id, case when u<0.3 then 'plain' when u<0.5 then 'keyed' end as use from (select distinct id, {_FRAC.format(chr(39)+'use:'+chr(39)+'||id')} as u from seq) where u<0.5")
def spl07(spark, d):
    use = rec.hash_tier(F.col("id").cast("string"), "use:", [(0.3, "plain"), (0.5, "keyed")])
    return T(spark, d, "seq").select("id").distinct().select("id", use.alias("use")).where("use is not null")


@query("set01", "select sig from seen where split<>'train' union select sig from seq where split<>'train' and sig is not null")
def set01(spark, d):
    return T(spark, d, "seen").where("split <> 'train'").select("sig").union(T(spark, d, "seq").where("split <> 'train' and sig is not null").select("sig")).distinct()


@query("set02", "select 'missing' as side, count(*) as n from (select doc_hash from contents except select doc_hash from units) union all select 'unknown', count(*) from (select doc_hash from units except select doc_hash from contents) union all select 'both', count(*) from (select doc_hash from contents intersect select doc_hash from units)")
def set02(spark, d):
    c, u = T(spark, d, "contents").select("doc_hash"), T(spark, d, "units").select("doc_hash")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n")
    return count(c.subtract(u), "missing").unionByName(count(u.subtract(c), "unknown")).unionByName(count(c.intersect(u), "both"))


@query("set03", "select host from documents where host like '%1%' union select host from documents where lang is null and host is not null")
def set03(spark, d):
    x = T(spark, d, "documents").where("host is not null")
    return x.where("host like '%1%'").select("host").union(x.where("lang is null").select("host")).distinct()


@query("set04", "select l_linenumber as part, count(*) as rows, count(distinct l_orderkey) as orders from lineitem group by 1")
def set04(spark, d):
    """Parts that cover the whole exactly: their rows add up, or the query fails."""
    li = T(spark, d, "lineitem")
    parts = li.groupBy(F.col("l_linenumber").alias("part")).agg(F.count("*").alias("rows"), F.count_distinct("l_orderkey").alias("orders"))
    return require(parts.withColumn("_s", F.sum("rows").over(Window.partitionBy())), F.col("_s") == li.count(), "parts do not cover").drop("_s")


# ---- samples


_SMP = "(select source, doc_id, coalesce(sum(n) over (partition by source order by sha256('42:'||doc_id) rows between unbounded preceding and 1 preceding),0) as before from (select source, doc_id, length(text)-length(replace(text,chr(10),''))+1 as n from documents where source is not null and text is not null))"


@query("smp01", f"with p as (select source, doc_id, unnest(range(len(string_split(text,chr(10))))) as line from documents where text is not null and doc_id in (select doc_id from {_SMP} where before<40)) select source, doc_id, line from (select *, row_number() over (partition by source order by sha256('42:'||doc_id||':'||line), doc_id, line) as k from p where source is not null) where k<=40")
def smp01(spark, d):
    """Documents of each source in hash order until their lines reach a quota, and of these lines the quota by hash."""
    x = T(spark, d, "documents").where("source is not null and text is not null").select("source", "doc_id", F.split("text", "\n").alias("lines"))
    x = x.withColumn("n", F.size("lines")).withColumn("h", F.sha2(F.concat(F.lit("42:"), F.col("doc_id").cast("string")), 256))
    taken = dd.running_total(x.select("source", "doc_id", "n", "h"), "n", ["h", "doc_id"], ["source"]).where("running - n < 40").select("doc_id")
    lines = x.join(taken, "doc_id", "left_semi").select("source", "doc_id", F.posexplode("lines").alias("line", "text")).withColumn("line", F.col("line").cast("bigint"))
    h = F.sha2(F.concat(F.lit("42:"), F.col("doc_id").cast("string"), F.lit(":"), F.col("line").cast("string")), 256)
    return dd.top(lines.withColumn("h", h), ["source"], [F.col("h"), F.col("doc_id"), F.col("line")], 40, "k").select("source", "doc_id", "line")


@query("smp02", "select doc_id from documents order by sha256('7:'||doc_id) limit 50")
def smp02(spark, d):
    return T(spark, d, "documents").select("doc_id").orderBy(F.sha2(F.concat(F.lit("7:"), F.col("doc_id").cast("string")), 256)).limit(50)


@query("smp03", f"select distinct id from seq where text is not null and {_FRAC.format('text')}<0.1")
def smp03(spark, d):
    return T(spark, d, "seq").where("text is not null").where(dd.hash_share(0.1, F.col("text"))).select("id").distinct()


@query("smp04", f"select distinct id from seq where doc is not null and {_FRAC.format(chr(39)+'d:'+chr(39)+'||doc')}<0.2")
def smp04(spark, d):
    return T(spark, d, "seq").where("doc is not null").where(dd.hash_share(0.2, F.lit("d:"), F.col("doc"))).select("id").distinct()


@query("smp05", r"with x as (select id, regexp_matches(text,'[\p{Katakana}]') as kana, sha256('42:'||id) as h from (select distinct id, text from seq where text is not null)), r as (select *, row_number() over (partition by kana order by h) as r from x), c as (select count(*) filter (not kana) as plain from x) select id from r, c where (not kana) or r<=plain//4")
def smp05(spark, d):
    """All sequences without Katakana, and of those with it so many that they are 20 % at most."""
    x = T(spark, d, "seq").where("text is not null").select("id", "text").distinct().select("id", F.col("text").rlike(r"\p{IsKatakana}").alias("kana"), F.sha2(F.concat(F.lit("42:"), F.col("id").cast("string")), 256).alias("h"))
    x = Stage(x, "kana").df
    plain = x.where("not kana").count()
    ranked = dd.global_rank(x.where("kana"), ["h", "id"]).where(F.col("rank") <= plain // 4)
    return x.where("not kana").select("id").unionByName(ranked.select("id"))


@query("smp06", "select split, source, id from (select split, source, id, row_number() over (partition by split, source order by sha256('audit:'||id)) as r from (select distinct split, source, id from seq)) where r<=3")
def smp06(spark, d):
    x = T(spark, d, "seq").select("split", "source", "id").distinct()
    return dd.top(x, ["split", "source"], [F.sha2(F.concat(F.lit("audit:"), F.col("id").cast("string")), 256)], 3).select("split", "source", "id")


_H15 = lambda key: f"('0x'||substr(sha256({key}),1,15))::ubigint"


@query("smp07", f"with x as (select item_id, case when length(text)<=32 then 'short' when length(text)<=64 then 'medium' else 'long' end as bucket from eval_items), p as (select *, row_number() over (partition by bucket order by sha256(item_id::varchar), item_id) as pos, count(*) over (partition by bucket) as size from x), d as (select range as draw, ['short','medium','long'][({_H15(chr(39) + 'bucket:' + chr(39) + '||range')}%3+1)::int] as bucket from range(0,100)) select draw, item_id from d join p on p.bucket=d.bucket and p.pos={_H15(chr(39) + 'item:' + chr(39) + '||draw')}%size+1")
def smp07(spark, d):
    """One item for each draw: a length bucket by hash, then an item of it by hash."""
    h = lambda salt: F.conv(F.substring(F.sha2(F.concat(F.lit(salt), F.col("draw").cast("string")), 256), 1, 15), 16, 10).cast("bigint")
    x = T(spark, d, "eval_items").select("item_id", t.length_bucket(F.length("text"), [(32, "short"), (64, "medium")], "long").alias("bucket"))
    x = dd.global_rank(x.withColumn("h", F.sha2(F.col("item_id").cast("string"), 256)), ["h", "item_id"], ["bucket"], size="size").select("bucket", "item_id", F.col("rank").alias("pos"), "size")
    b = F.element_at(F.array(F.lit("short"), F.lit("medium"), F.lit("long")), F.pmod(h("bucket:"), F.lit(3)).cast("int") + 1)
    draws = spark.range(100).withColumnRenamed("id", "draw").withColumn("bucket", b).join(x.select("bucket", "size").distinct(), "bucket")
    return draws.select("draw", "bucket", (F.pmod(h("item:"), F.col("size")) + 1).alias("pos")).join(x, ["bucket", "pos"]).select("draw", "item_id")


@query("smp08", "select id, case when h<25 then 'a' when h<60 then 'b' when h<72 then 'c' end as part from (select distinct id, ('0x'||substr(sha256('parent:'||doc),1,15))::ubigint%100 as h from seq where doc is not null) where h<72")
def smp08(spark, d):
    h = F.pmod(F.conv(F.substring(F.sha2(F.concat(F.lit("parent:"), "doc"), 256), 1, 15), 16, 10).cast("bigint"), F.lit(100))
    return T(spark, d, "seq").where("doc is not null").select("id", h.alias("h")).distinct().where("h < 72").select("id", F.when(F.col("h") < 25, "a").when(F.col("h") < 60, "b").otherwise("c").alias("part"))


# ---- governance


@query("gov05", "select alias_key, count(distinct doc_hash) as hashes from aliases where alias_key is not null group by 1 having count(distinct doc_hash)>1")
def gov05(spark, d):
    return rec.ambiguous(T(spark, d, "aliases"), "alias_key", "doc_hash", "hashes")


@query("gov06", "select c.doc_hash, case d.r when 0 then 'keep' when 1 then 'fix' when 2 then 'drop' else 'open' end as decision from contents c left join (select id, max(case split when 'train' then 0 when 'validation' then 1 else 2 end) as r from docs group by 1) d on d.id=c.doc_hash")
def gov06(spark, d):
    """Decisions of several reviewers merged: the strictest counts; without review a record stays open."""
    named = F.when(F.col("split") == "train", "keep").when(F.col("split") == "validation", "fix").otherwise("drop")
    reviews = T(spark, d, "docs").select(F.col("id").alias("doc_hash"), named.alias("decision"))
    return rec.merged_decisions(T(spark, d, "contents"), reviews, "doc_hash", "decision", ["keep", "fix", "drop"])
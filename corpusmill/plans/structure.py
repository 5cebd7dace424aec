"""Queries of segmentation, key sequences and labels."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from corpusmill.functions import keys as k
from corpusmill.functions import segment as s
from corpusmill.functions import text as t
from corpusmill.operators import annotations as ann
from corpusmill.operators import documents as doc
from corpusmill.plans.registry import query
from corpusmill.plans.text import _CLEAN, _GLUED, _NORM, _STRIP, _URL, _WORD
from corpusmill.runtime import Stage, table

#: A fixture of syllables; a full table is a parameter of the functions.
SYLLABLES = frozenset(a + b for a in ("b", "d", "g", "zh", "sh", "l", "n", "") for b in ("a", "ai", "an", "ang", "ao", "e", "en", "eng", "i", "u", "uo") if a + b)


def _documents(spark, d):
    return table(spark, d, "documents").where("text is not null")


@query("seg01")
def seg01(spark, d):
    return _documents(spark, d).select("doc_id", F.posexplode(s.sentences(F.col("text"))).alias("sentence_index", "s")).select("doc_id", "sentence_index", "s.text", "s.start", "s.end", "s.terminated", F.array_join("s.flags", ",").alias("flags"))


_NO_BRACKETS = r"[「」『』（）()【】\[\]“”]"


@query("seg01_plain", rf"""select item_id, count(*) as sentences, sum(length({_STRIP('x')})) as chars from (select item_id, unnest(regexp_extract_all(text, '(?:{s.ADDRESS}|[^。！？!?\n])*[。！？!?]+')) as x from (
select item_id, text from eval_items union all select item_id, '詳しくは https://a.example/x?q=1!z。次は' || text from eval_items union all select doc_id + 1000000, text from documents) where not regexp_matches(text, '{_NO_BRACKETS}') and not regexp_matches(text, '\r')) group by 1""")
def seg01_plain(spark, d):
    """The part of sentence splitting that regular expressions can say: texts without brackets, with web addresses among them."""
    e = table(spark, d, "eval_items").select("item_id", "text")
    addressed = e.select("item_id", F.concat(F.lit("詳しくは https://a.example/x?q=1!z。次は"), "text").alias("text"))
    texts = e.unionByName(addressed).unionByName(table(spark, d, "documents").select((F.col("doc_id") + 1_000_000).alias("item_id"), "text"))
    plain = texts.where(~F.col("text").rlike(_NO_BRACKETS) & ~F.col("text").contains("\r"))
    x = F.explode(s.sentences(F.col("text"))).alias("s")
    counted = plain.select("item_id", x).where("s.terminated")
    return counted.groupBy("item_id").agg(F.count("*").alias("sentences"), F.sum(F.length("s.text")).alias("chars"))


def _wrapped(spark, d):
    """Documents with their lines wrapped at 24 characters, as fixed-width text has them."""
    return _documents(spark, d).select("doc_id", F.regexp_replace("text", r"([^\n]{24})(?=[^\n])", "$1\n").alias("text"))


@query("seg02")
def seg02(spark, d):
    join = s.array_udf(lambda x: [s.join_reason(a.strip(), b.strip()) or "" for a, b in zip(x.split("\n"), x.split("\n")[1:], strict=False)], StringType())
    return _wrapped(spark, d).select("doc_id", F.posexplode(join(F.col("text"))).alias("line", "reason")).where("reason <> ''")


@query("seg02_comma", r"""with w as (select doc_id, regexp_replace(text, '([^\n]{24})', '\1' || chr(10), 'g') as x from documents where text is not null and not regexp_matches(text, '[「」『』（）()【】\[\]“”]|http|\r')),
l as (select doc_id, unnest(string_split(x, chr(10))) as line, unnest(range(len(string_split(x, chr(10))))) as n from w),
t as (select doc_id, n, regexp_replace(line, '^[\s\x0b\x1c-\x1f\x{85}\p{Z}]+|[\s\x0b\x1c-\x1f\x{85}\p{Z}]+$', '', 'g') as line from l),
p as (select doc_id, n, line as a, lead(line) over (partition by doc_id order by n) as b from t)
select doc_id, count(*) as commas from p where b <> '' and regexp_matches(a, '[、，,]$') and not regexp_matches(a, '^([-*・●■◆◇]|[0-9０-９]+[.)．、])') and not regexp_matches(b, '^([-*・●■◆◇]|[0-9０-９]+[.)．、])') group by 1""")
def seg02_comma(spark, d):
    """The joins after a comma, which SQL can say where no bracket or address stands."""
    plain = _documents(spark, d).where(~F.col("text").rlike(_NO_BRACKETS + r"|http|\r")).select("doc_id", F.regexp_replace("text", r"([^\n]{24})", "$1\n").alias("text"))
    commas = s.array_udf(lambda x: [w for a, b in zip(x.split("\n"), x.split("\n")[1:], strict=False) if (w := s.join_reason(a.strip(), b.strip())) == "trailing_comma"], StringType())
    return plain.select("doc_id", F.size(commas(F.col("text"))).cast("bigint").alias("commas")).where("commas > 0")


def _ahead(text):
    blocks = s.lines_as_blocks(text)
    return [str(i) for i, (_, _, line, _) in enumerate(blocks[:-1]) if s.Scan().feed(line.strip()).open and s.closes_ahead(line.strip(), blocks, i + 1)]


@query("seg03")
def seg03(spark, d):
    """Lines with an open bracket that the lines below close."""
    return _wrapped(spark, d).select("doc_id", F.explode(s.array_udf(_ahead, StringType())(F.col("text"))).alias("line"))


@query("seg04")
def seg04(spark, d):
    return _wrapped(spark, d).select("doc_id", F.posexplode(s.paragraphs(F.col("text"))).alias("paragraph_index", "p")).select("doc_id", "paragraph_index", "p.*")


_SPANS = "array<struct<block_id:string,start:int,end:int>>"


@query("seg05", """with p as (select distinct doc_hash, paragraph_index, sentence_index, from_json(spans,'[{"block_id":"VARCHAR","start":"INTEGER","end":"INTEGER"}]') as parts from units where spans is not null),
x as (select *, unnest(parts) as b from p) select doc_hash, paragraph_index, sentence_index, b.block_id as block_id, greatest(10,b.start)-b.start as "start", least(40,b."end")-b.start as "end" from x where greatest(10,b.start)<least(40,b."end")""")
def seg05(spark, d):
    """What of each unit's blocks lies in characters 10 to 40 of its paragraph."""
    u = table(spark, d, "units").where("spans is not null").select("doc_hash", "paragraph_index", "sentence_index", "spans").distinct()
    parts = F.from_json("spans", _SPANS)
    return u.select("doc_hash", "paragraph_index", "sentence_index", F.explode(s.clip_spans(F.lit(10), F.lit(40), parts)).alias("b")).select("doc_hash", "paragraph_index", "sentence_index", "b.*")


def _processed(spark, d):
    """All documents by content, with a label on the first boundary between lines: they stay apart."""
    text = t.normal_document(F.col("text"))
    docs = Stage(_documents(spark, d).select(text.alias("text")).withColumn("doc_hash", F.sha2("text", 256)).dropDuplicates(["doc_hash"]), "contents").df
    none = F.lit(None).cast("string")
    labels = docs.where(F.contains("text", F.lit("\n"))).select(F.concat(F.lit("label:"), "doc_hash").alias("id"), "doc_hash", F.lit("boundary").alias("kind"), F.lit("separate").alias("action"), none.alias("text"), none.alias("block_id"), F.lit("b000").alias("left_block"), F.lit("b001").alias("right_block"), none.alias("spans"))
    return doc.process(docs, labels)


@query("seg06")
def seg06(spark, d):
    return doc.units(_processed(spark, d))


@query("seg06_audit")
def seg06_audit(spark, d):
    return doc.fragments(_processed(spark, d))


@query("seg06_metrics", f"""with docs as (select distinct {_NORM} as text from documents where text is not null), l as (select text as d, unnest(string_split(text, chr(10))) as line from docs),
c as (select d, {_STRIP(_CLEAN)} as x from l), u as (select d, case when regexp_matches(x,'^[*=~◆◇■□★☆].*[^*=~◆◇■□★☆\\s].*[*=~◆◇■□★☆]$') and left(x,1)=right(x,1) then trim(trim(x,left(x,1))) else x end as text from c),
a as (select d, case when text='' or {_URL} or not {_WORD} then 'drop' when contains(text,chr(65533)) or {_GLUED} then 'review' else 'keep' end as action from u)
select 'input_blocks' as metric, count(*) as n from a union all select action || '_blocks', count(*) from a group by 1 union all select 'unique_documents', count(*) from docs""")
def seg06_metrics(spark, d):
    """Counters of the whole run that do not hang on joins."""
    whole = doc.merged_metrics(doc.document_metrics(_processed(spark, d)))
    return whole.where(F.col("metric").isin("unique_documents", "input_blocks", "keep_blocks", "drop_blocks", "review_blocks"))


@query("seg07")
def seg07(spark, d):
    kind = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("span", StringType())])
    spans = s.array_udf(lambda x: [{"start": a, "end": b, "span": c} for a, b, c in s.candidate_spans(x)], kind)
    return table(spark, d, "eval_items").select("item_id", F.explode(spans(F.col("text"))).alias("x")).select("item_id", "x.*")


def _lexicon(spark, d):
    rows = table(spark, d, "lexicon").where("word is not null").groupBy("word").agg(F.max(F.coalesce("weight", F.lit(1.0))).alias("weight")).limit(1_000_001).collect()
    if len(rows) > 1_000_000:
        raise ValueError("the lexicon is too large to be sent to the tasks")
    return spark.sparkContext.broadcast([(r["word"], r["word"], max(1.0, r["weight"])) for r in rows])


def _with_dictionary(words, f):
    """Arrow-batched: ``f(dictionary, text) -> list of strings``, the dictionary built once in each worker."""

    @F.pandas_udf(ArrayType(StringType()))
    def over(texts: pd.Series) -> pd.Series:
        book = s.Dictionary(words.value)
        return texts.map(lambda x: f(book, x or ""))

    return over


@query("seg08")
def seg08(spark, d):
    f = _with_dictionary(_lexicon(spark, d), lambda book, x: list(s.greedy_phrases(x, frozenset(book.best), book.longest)))
    return table(spark, d, "eval_items").select("item_id", F.posexplode(f(F.col("left_context"))).alias("pos", "phrase"))


@query("seg08_agreed")
def seg08_agreed(spark, d):
    """Phrases of two dictionaries that agree on the reading; the second reads words of an even length backwards."""
    words = _lexicon(spark, d)
    kind = StructType([StructField("phrase", StringType()), StructField("reading", StringType())])

    @F.pandas_udf(ArrayType(kind))
    def over(texts: pd.Series) -> pd.Series:
        first = s.Dictionary([(w, w.lower(), n) for w, _, n in words.value])
        second = s.Dictionary([(w, w.lower() if len(w) % 2 else w.lower()[::-1], n) for w, _, n in words.value])
        return texts.map(lambda x: [{"phrase": a, "reading": b} for a, b in s.agreed_phrases(x or "", first, second)])

    return table(spark, d, "eval_items").select("item_id", F.posexplode(over("text")).alias("pos", "x")).select("item_id", "pos", "x.*").where("reading is not null")


@query("seg09")
def seg09(spark, d):
    f = _with_dictionary(_lexicon(spark, d), lambda book, x: book.segment(x))
    return table(spark, d, "eval_items").select("item_id", F.posexplode(f(F.col("left_context"))).alias("pos", "word"))


@query("top05")
def top05(spark, d):
    f = _with_dictionary(_lexicon(spark, d), lambda book, x: ["|".join(p) for _, p in book.paths(x, 3)])
    return table(spark, d, "eval_items").where("left_context is not null").select("item_id", F.posexplode(f(F.col("left_context"))).alias("rank", "path"))


_U01 = lambda key: f"(('0x'||substr(sha256({key}),1,16))::ubigint::double/18446744073709551616.0)"


@query("seg10", f"with n as (select item_id, text, case when {_U01(chr(39) + 'span:' + chr(39) + '||item_id')}<0.5 then 2 when {_U01(chr(39) + 'span:' + chr(39) + '||item_id')}<0.8 then 4 else 8 end as span_length, {_U01(chr(39) + 'at:' + chr(39) + '||item_id')} as u from eval_items) select item_id, span_length, substring(text, floor(u*greatest(length(text)-span_length,1))::int+1, span_length) as span from n")
def seg10(spark, d):
    """A span of each item, its length drawn by weight from the item's hash."""
    x = F.col("text")
    u = t.hash_fraction(F.lit("span:"), F.col("item_id").cast("string"))
    n = F.when(u < 0.5, 2).when(u < 0.8, 4).otherwise(8)
    at = (t.hash_fraction(F.lit("at:"), F.col("item_id").cast("string")) * F.greatest(F.length(x) - n, F.lit(1))).cast("int") + 1
    return table(spark, d, "eval_items").select("item_id", n.alias("span_length"), F.substr(x, at, n).alias("span"))


def _keys(name):
    return F.regexp_replace(F.lower(name), "[^a-z]", "")


def _parts(spark, d):
    return table(spark, d, "part").select("p_partkey", _keys(F.col("p_name")).alias("keys")).where("keys <> ''")


def _map(f, kind):
    @F.pandas_udf(kind)
    def over(x: pd.Series) -> pd.Series:
        return x.map(f)

    return over


_READ = ("lower(word)", "case when length(word)%3=0 then upper(word) else lower(word) end", "case when length(word)%2=0 then reverse(lower(word)) when length(word)=1 then null else lower(word) end")


@query("key01", f"select word, case when b=a or b is distinct from c or b is null then a else b end as reading, (c is null and a=b) or (a=b and b=c) as agreed, case when a=b and c is not null and c<>a then 'third' when a=c and b<>a then 'second' when b=c and a<>b then 'first' when c is not null and a<>b and b<>c and a<>c then 'all' when c is null and a<>b then 'all' end as outlier from (select distinct word, {_READ[0]} as a, {_READ[1]} as b, {_READ[2]} as c from lexicon where word is not null)")
def key01(spark, d):
    """The reading that most of three readers give, and who differs; the readers here are rules over the word, elsewhere tables."""
    kind = StructType([StructField("reading", StringType()), StructField("agreed", BooleanType()), StructField("outlier", StringType())])

    @F.pandas_udf(kind)
    def vote(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.DataFrame:
        rows = []
        for given in zip(a, b, c, strict=True):
            reading, agreed = k.majority(list(given))
            rows.append((reading, agreed, k.outlier(list(given))))
        return pd.DataFrame(rows, columns=["reading", "agreed", "outlier"])

    w = table(spark, d, "lexicon").where("word is not null").select("word").distinct()
    three = w.select("word", *[F.expr(x).alias(c) for x, c in zip(_READ, "abc", strict=True)])
    return three.select("word", vote("a", "b", "c").alias("v")).select("word", "v.*")


@query("key02", "with a as (select word, max(kind) as r from lexicon where word is not null and lang='ja' group by 1), b as (select word, min(kind) as r from lexicon where word is not null and weight is not null group by 1) select coalesce(a.word,b.word) as word, a.r as \"left\", b.r as \"right\", case when a.word is null then 'only right' when b.word is null then 'only left' when a.r=b.r then 'agree' else 'differ' end as verdict from a full join b using (word)")
def key02(spark, d):
    """Two dictionaries side by side: entries of one language, and weighted entries."""
    x = table(spark, d, "lexicon").where("word is not null")
    left = x.where("lang = 'ja'").groupBy("word").agg(F.max("kind").alias("reading"))
    right = x.where("weight is not null").groupBy("word").agg(F.min("kind").alias("reading"))
    return ann.agreement(left, right, "word", "reading")


@query("key03")
def key03(spark, d):
    """Spellings of each nation's name in every style; vowels end its syllables."""
    styles = ["full", "initials", "apostrophes", "mixed", "error"]
    cut = lambda w: re.findall("[^aeiou]*[aeiou]+(?:n(?![aeiou]))?|[^aeiou]+$", w)
    f = s.array_udf(lambda x: [k.spell(cut(x.replace(" ", "")), style, 42) for style in styles], StringType())
    return table(spark, d, "nation").select("n_nationkey", F.posexplode(f(F.lower("n_name"))).alias("style", "keys"))


@query("key04")
def key04(spark, d):
    f = s.array_udf(k.fuzzy, StringType())
    return _parts(spark, d).select("p_partkey", F.explode(f(F.col("keys"))).alias("swapped"))


@query("key05")
def key05(spark, d):
    kinds = ["substitute", "delete", "insert", "transpose"]
    f = s.array_udf(lambda x: [k.mistype(x, kind, 42) for kind in kinds], StringType())
    return _parts(spark, d).select("p_partkey", F.posexplode(f(F.col("keys"))).alias("kind", "keys"))


_SYL = "|".join(sorted(SYLLABLES, key=lambda x: (-len(x), x)))


@query("key06", f"select p_partkey, regexp_full_match(regexp_replace(lower(p_name),'[^a-z]','','g'),'({_SYL})+') as valid from part where regexp_replace(lower(p_name),'[^a-z]','','g')<>''")
def key06(spark, d):
    return _parts(spark, d).select("p_partkey", _map(lambda x: k.splits_to_syllables(x, SYLLABLES), BooleanType())(F.col("keys")).alias("valid"))


@query("key07")
def key07(spark, d):
    """Repairs of two drawn syllables with one wrong key."""
    known = sorted(SYLLABLES)

    def fix(n):
        typed = k.mistype(known[k.draw(len(known), 1, n)] + known[k.draw(len(known), 2, n)], "substitute", 42)
        return k.repairs(typed, SYLLABLES)

    f = s.array_udf(fix, StringType())
    return table(spark, d, "part").select("p_partkey", F.explode(f(F.col("p_partkey").cast("string"))).alias("repair"))


@query("key08")
def key08(spark, d):
    syllables = lambda w: re.findall("[^aeiou]*[aeiou]+(?:n(?![aeiou]))?", w) or [w]
    f = s.array_udf(lambda x: k.abbreviations([syllables(w) for w in x.lower().split()], 42), StringType())
    return table(spark, d, "part").select("p_partkey", F.posexplode(f(F.col("p_name"))).alias("form", "keys"))


@query("key09", "with w as (select p_partkey, list_transform(string_split(lower(p_name),' '), lambda x: length(x)+1) as n from part where p_name is not null) select p_partkey, list_sum(n)::bigint as keystrokes, array_to_string(list_transform(range(1,len(n)+1), lambda i: list_sum(n[1:i])::bigint),',') as ends from w")
def key09(spark, d):
    n = F.transform(F.split(F.lower("p_name"), " "), lambda w: F.length(w) + 1)
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    x = table(spark, d, "part").where("p_name is not null").select("p_partkey", n.alias("n"))
    ends = F.transform(F.sequence(F.lit(1), F.size("n")), lambda i: total(F.slice("n", 1, i)).cast("string"))
    return x.select("p_partkey", total(F.col("n")).cast("bigint").alias("keystrokes"), F.array_join(ends, ",").alias("ends"))


def _units(spark, d):
    return table(spark, d, "units").select("doc_hash", "paragraph_index", "sentence_index", "text").distinct()


def _labels(spark, d):
    """First sentences as labelled records: dropped if they are short."""
    u = _units(spark, d).where("paragraph_index = 0 and sentence_index = 0")
    return u.select("doc_hash", "paragraph_index", "sentence_index", F.col("text").alias("snapshot"), F.when(F.length("text") < 24, "drop").otherwise("keep").alias("action"))


_KEYS = ["doc_hash", "paragraph_index", "sentence_index"]
_U = "(select distinct doc_hash, paragraph_index, sentence_index, text from units)"
_L = f"(select doc_hash, paragraph_index, sentence_index, text as snapshot, case when length(text)<24 then 'drop' else 'keep' end as action from {_U} where paragraph_index=0 and sentence_index=0)"


@query("ann01", f"select coalesce(l.action,'none') as action, count(*) as units from {_U} u left join {_L} l using (doc_hash, paragraph_index, sentence_index) group by 1")
def ann01(spark, d):
    return ann.apply_labels(_units(spark, d), _labels(spark, d), _KEYS, default="none").groupBy("action").agg(F.count("*").alias("units"))


_F = "(select distinct doc_hash, text, spans from units where spans is not null)"


@query("ann02", f"select doc_hash, text, spans, (select count(*) from {_F} u where u.doc_hash=l.doc_hash and u.text=l.text and u.spans=l.spans) as matches from {_F} l where length(text)<24")
def ann02(spark, d):
    """Labels of short fragments, matched by document, text and spans."""
    u = table(spark, d, "units").where("spans is not null").select("doc_hash", "text", "spans").distinct()
    return ann.match_fragments(u.where(F.length("text") < 24), u, ["doc_hash", "text", "spans"])


@query("ann03", "select distinct doc_hash from aliases where doc_hash is not null and doc_hash not in (select doc_hash from contents where doc_hash is not null)")
def ann03(spark, d):
    labels = table(spark, d, "aliases").where("doc_hash is not null").select("doc_hash").distinct()
    return ann.unmatched(labels, table(spark, d, "contents"), ["doc_hash"])


@query("ann04", "select doc_hash, case when group_id in (select group_id from contents where split_rank=2) then 0 else coalesce(split_rank,0) end as split_rank from contents")
def ann04(spark, d):
    """Groups with a test content stand for labelled groups: all their members go to train."""
    c = table(spark, d, "contents")
    forced = c.where("split_rank = 2 and group_id is not null").select("group_id").distinct().withColumn("forced", F.lit(True))
    return c.join(forced, "group_id", "left").select("doc_hash", F.when(F.col("forced"), 0).otherwise(F.coalesce("split_rank", F.lit(0))).alias("split_rank"))


@query("ann05", f"select action, count(*) as labels from (select * from {_L} where action='keep' union all select * from {_L} where action='drop') group by 1")
def ann05(spark, d):
    ledger, approved = (_labels(spark, d).where(f"action = '{a}'") for a in ("keep", "drop"))
    return ann.require_unique(ann.union_all(ledger, approved), *_KEYS).groupBy("action").agg(F.count("*").alias("labels"))


@query("ann06", rf"select stratum, count(*) as units from (select unnest(list_filter([case when length(text)>60 then 'long' end, case when regexp_matches(text,'[A-Za-z]') then 'latin' end, case when regexp_matches(text,'[0-9]') then 'digits' end, case when regexp_matches(text,'[「」()（）]') then 'brackets' end, case when length(text)<10 then 'fragment' end], lambda x: x is not null)) as stratum from {_U}) group by 1")
def ann06(spark, d):
    x = F.col("text")
    rules = {"long": F.length(x) > 60, "latin": x.rlike("[A-Za-z]"), "digits": x.rlike("[0-9]"), "brackets": x.rlike("[「」()（）]"), "fragment": F.length(x) < 10}
    return ann.strata(_units(spark, d), rules).groupBy("stratum").agg(F.count("*").alias("units"))


@query("ann07", """with o as (select o_custkey as batch, o_orderkey, o_orderstatus from orders), r as (select *, batch%13=0 as torn, batch%17=0 as other from o where o_orderstatus<>'P' or batch%5<>0)
select a.batch, coalesce(a.n=b.n,false) and a.batch%13<>0 and a.batch%17<>0 as accepted from (select batch, count(*) n from o group by 1) a left join (select batch, count(*) n from r group by 1) b using (batch)""")
def ann07(spark, d):
    """Customers as batches of requests; replies in JSON, of which some lack orders, some are torn, and some decide on something else."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("batch"), "o_orderkey", "o_orderstatus")
    told = o.where("o_orderstatus <> 'P' or batch % 5 <> 0")
    word = F.when(F.col("batch") % 17 == 0, "maybe").otherwise("keep")
    made = told.groupBy("batch").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("o_orderkey").cast("string").alias("key"), word.alias("decision"))).alias("decisions"))).alias("reply"))
    torn = made.withColumn("reply", F.when(F.col("batch") % 13 == 0, F.substr("reply", F.lit(1), F.length("reply") - 2)).otherwise(F.col("reply")))
    replies = ann.parsed_replies(torn, "batch", "reply", ("keep", "fix", "drop")).withColumnRenamed("key", "o_orderkey")
    return ann.reply_check(o, replies, "batch", "o_orderkey")

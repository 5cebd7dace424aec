"""Queries of readers and writers: tables are written in the form a reader takes, and read back through it."""

from __future__ import annotations

import io
import os
import uuid
import zipfile

from pyspark.sql import functions as F

from corpusmill.functions import text as t
from corpusmill.operators import documents as doc
from corpusmill.operators import records as rec
from corpusmill.plans.registry import query
from corpusmill.plans.text import _ALT, _CLEAN, _GLUED, _NORM, _STRIP, _URL, _WORD
from corpusmill.runtime import scratch_dir, shuffle_partitions, table, write_bytes
from corpusmill.sources import readers as r
from corpusmill.sources import sinks


def place(spark, name):
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(spark, df, form, name, **options):
    path = place(spark, name)
    sinks.write_once(df, path, form, **options)
    return path


@query("src01", "select 'documents' as source, doc_id::varchar as source_id, 'documents:'||doc_id as doc_id, length(text) as chars, lang from documents")
def src01(spark, d):
    x = r.documents(spark, f"{d}/documents.parquet", "documents", "doc_id")
    return x.select("source", "source_id", "doc_id", F.length("text").cast("bigint").alias("chars"), F.try_element_at("metadata", F.lit("lang")).alias("lang"))


@query("src02", "select distinct id::varchar as source_id, regexp_replace(text,'[\\t\\r\\n]',' ','g') as text from seq where text is not null")
def src02(spark, d):
    rows = table(spark, d, "seq").where("text is not null").select("id", "text").distinct()
    path = written(spark, rows.select(F.concat_ws("\t", "id", F.lit("jpn"), F.regexp_replace("text", "[\t\r\n]", " "))), "text", "tsv")
    return r.sentence_tsv(spark, path)


@query("src03", "select l_returnflag, count(*) as n, sum(l_quantity)::bigint as quantity from lineitem group by 1")
def src03(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_quantity").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("bigint").alias("quantity"))


@query("src04", "select id, source, pairs from docs where split='validation'")
def src04(spark, d):
    return table(spark, d, "docs").where("split = 'validation'").select("id", "source", "pairs")


@query("src05", "select sig, split, pool from seen")
def src05(spark, d):
    return r.json_lines(spark, written(spark, table(spark, d, "seen"), "json", "jsonl"), "sig string, split string, pool string")


@query("src06", "select text, count(*) as n from (select regexp_replace(text,'[\\r\\n]',' ','g') as text from seq where length(text)>0) group by 1")
def src06(spark, d):
    rows = table(spark, d, "seq").where("length(text) > 0").select(F.regexp_replace("text", "[\r\n]", " "))
    return r.text_lines(spark, written(spark, rows, "text", "txt")).groupBy("text").agg(F.count("*").alias("n"))


@query("src07", "select l_orderkey as dialogue, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey)-1 as turn, l_returnflag as text from lineitem")
def src07(spark, d):
    x = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("dialogue")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))), lambda s: s["l_returnflag"]).alias("turns"))
    return r.dialogues(spark, written(spark, x, "json", "dialogues")).withColumn("turn", F.col("turn").cast("bigint"))


@query("src08")
def src08(spark, d):
    """Dialogue archives with slot values: one archive of one document for each region."""
    import json

    regions = [r_.asDict() for r_ in table(spark, d, "region").select("r_regionkey", "r_name").collect()]  # five rows by the table's definition
    rows = []
    for x in regions:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            z.writestr("dialogue.json", json.dumps({"id": x["r_regionkey"], "slots": [{"name": "region", "value": x["r_name"]}]}))
        rows.append((x["r_regionkey"], buffer.getvalue()))
    folder = f"{scratch_dir(spark)}/zips-{uuid.uuid4().hex}"
    for key, content in rows:
        write_bytes(spark, f"{folder}/{key}.zip", content)
    found = r.zipped_json(spark, folder, "id int, slots array<struct<name:string,value:string>>")
    return found.select("doc.id", F.explode("doc.slots").alias("s")).select("id", "s.name", "s.value")


@query("src09", "select l_orderkey, string_agg(l_returnflag, '|' order by l_linenumber, l_returnflag) as texts from lineitem group by 1")
def src09(spark, d):
    path = written(spark, table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "csv", "csv", header=True)
    x = r.utterances_csv(spark, path, "l_orderkey bigint, l_linenumber bigint, l_returnflag string", "l_orderkey", "l_linenumber", "l_returnflag")
    return x.select("l_orderkey", F.array_join("texts", "|").alias("texts"))


@query("src10", "select o_orderkey::varchar as id, o_custkey::varchar as author, o_orderpriority as text, case when o_custkey%10<8 then 'train' else 'open' end as role from orders")
def src10(spark, d):
    path = written(spark, table(spark, d, "orders").select(F.concat_ws("\t", "o_orderkey", "o_custkey", "o_orderpriority")), "text", "authors")
    return r.authored_tsv(spark, path, F.col("author").cast("bigint") % 10 < 8)


@query("src11")
def src11(spark, d):
    return r.sampled_scan(table(spark, d, "documents"), 0.25, 7, "doc_id").select("doc_id", "source")


@query("src12", "select count(*) as rows, count(*) filter (text is null) as nulls, min(length(text)) as shortest, max(length(text)) as longest, sum(length(text))::bigint as chars from documents")
def src12(spark, d):
    return r.inspect(table(spark, d, "documents"), "text")


@query("src13", "select source_file, row_index, min(doc_hash) as doc_hash from origins where row_index=1 group by 1,2")
def src13(spark, d):
    o = table(spark, d, "origins").groupBy("source_file", "row_index").agg(F.min("doc_hash").alias("doc_hash"))
    return r.rows_at(o, o.where("row_index = 1").select("source_file", "row_index"), ["source_file", "row_index"])


@query("src14", "select word, kind as code, coalesce(weight,1.0) as weight from lexicon where word is not null and kind is not null")
def src14(spark, d):
    body = table(spark, d, "lexicon").where("word is not null and kind is not null").select(F.concat_ws("\t", "word", "kind", F.coalesce(F.col("weight"), F.lit(1.0)).cast("string")).alias("line"))
    head = spark.createDataFrame([("---\nname: fixture\n...",)], "line string")
    whole = head.unionByName(body).agg(F.concat_ws("\n", F.collect_list("line")))  # the fixed table of about 250 words
    return r.dictionary(spark, written(spark, whole, "text", "dict"))


@query("src15", "select seq_id, len(tokens) as n, tokens[1] as first, tokens[-1] as last from (select distinct id as seq_id, tokens from seq)")
def src15(spark, d):
    path = written(spark, table(spark, d, "seq").select(F.col("id").alias("seq_id"), "tokens").distinct(), "parquet", "tokens")
    return r.token_store(spark, path, 65535).select("seq_id", F.size("tokens").cast("bigint").alias("n"), F.col("tokens")[0].alias("first"), F.element_at("tokens", -1).alias("last"))


@query("src16", f"select doc_id, term from (select distinct doc_id, unnest(regexp_extract_all(lower(text), '({_ALT})')) as term from documents)")
def src16(spark, d):
    """The terms of a rule file, found in the documents, longest first."""
    rules = r.rules(os.path.join(os.path.dirname(__file__), "rules.toml"))
    return table(spark, d, "documents").select("doc_id", F.explode(t.terms_found(F.col("text"), list(rules.terms))).alias("term"))


@query("src17", "select distinct doc_hash||':'||paragraph_index||':'||sentence_index as id, doc_hash, 'fragment' as kind, 'keep' as action, text as snapshot from units where paragraph_index=0 and sentence_index=0")
def src17(spark, d):
    u = table(spark, d, "units").where("paragraph_index = 0 and sentence_index = 0").select(F.concat_ws(":", "doc_hash", "paragraph_index", "sentence_index").alias("id"), "doc_hash", F.lit("fragment").alias("kind"), F.lit("keep").alias("action"), F.col("text").alias("snapshot")).distinct()
    return r.label_ledger(spark, written(spark, u, "json", "labels"))


@query("src18", "select item_id as id, unnest(range(1, len(answers)+1)) as rank, unnest(answers) as text from eval_items")
def src18(spark, d):
    e = table(spark, d, "eval_items").select(F.col("item_id").alias("id"), "answers")
    return r.candidate_export(e, e.select("id", F.posexplode("answers").alias("rank", "text")).withColumn("rank", (F.col("rank") + 1).cast("bigint")))


@query("src19", "select n_nationkey as id, n_name as name from nation")
def src19(spark, d):
    path = written(spark, table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name")), "xml", "xml", rowTag="sample")
    return r.xml_samples(spark, path, "sample", "id bigint, name string")


@query("src20", "select event_type as name, count(*) as n, round(sum(abs(value)),4) as busy from events where value is not null group by 1")
def src20(spark, d):
    """A trace written as one document for each group of events, read back as intervals."""
    events = table(spark, d, "events").select(F.struct(F.col("event_type").alias("name"), F.lit("X").alias("ph"), F.col("event_id").cast("double").alias("ts"), F.abs("value").alias("dur")).alias("e"), F.pmod("event_id", F.lit(64)).alias("k"))
    path = written(spark, events.groupBy("k").agg(F.collect_list("e").alias("traceEvents")).select("traceEvents"), "json", "trace")
    return r.trace_intervals(spark, path, multi_line=False).groupBy("name").agg(F.count("*").alias("n"), F.round(F.sum(F.col("end") - F.col("start")), 4).alias("busy"))


@query("src21", "select o_orderkey from orders where o_orderkey%16=3")
def src21(spark, d):
    return r.strided(table(spark, d, "orders"), "o_orderkey", 16, 3).select("o_orderkey")


@query("snk01", "select split, count(*) as rows, count(distinct sig) as sigs from seen group by 1")
def snk01(spark, d):
    path = place(spark, "splits")
    sinks.write_splits(table(spark, d, "seen"), path, "sig")
    return spark.read.schema("sig string, pool string, split string").json(path).groupBy("split").agg(F.count("*").alias("rows"), F.count_distinct("sig").alias("sigs"))


@query("snk02", "select count(*) as rows, sum(length(text))::bigint as chars from documents")
def snk02(spark, d):
    path = place(spark, "rolling")
    sinks.write_rolling(table(spark, d, "documents"), path, 5000)
    return spark.read.parquet(path).agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars"))


@query("snk03", "select count(*) as rows, count(distinct text_hash) as hashes from units")
def snk03(spark, d):
    path = place(spark, "buckets")
    sinks.write_buckets(table(spark, d, "units").select("doc_hash", "text_hash"), path, "text_hash", shuffle_partitions(spark))
    # A hash lies in one bucket, so distinct hashes add up over buckets.
    per = spark.read.parquet(path).groupBy("bucket", "text_hash").agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("rows"), F.count("*").alias("hashes"))


@query("snk04", "select count(*) as sequences, sum(len(tokens))::bigint as tokens from (select distinct id, tokens from seq)")
def snk04(spark, d):
    path = written(spark, table(spark, d, "seq").select(F.col("id").alias("seq_id"), "tokens").distinct(), "parquet", "store", compression="zstd")
    return r.token_store(spark, path, 65535).agg(F.count("*").alias("sequences"), F.sum(F.size("tokens")).alias("tokens"))


@query("snk05", "select l_linenumber as part, l_orderkey as pos, coalesce(sum(l_partkey) over (order by l_linenumber, l_orderkey rows between unbounded preceding and 1 preceding),0)::bigint as \"offset\" from (select l_linenumber, l_orderkey, sum(l_partkey) as l_partkey from lineitem group by 1,2)")
def snk05(spark, d):
    x = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("part"), F.col("l_orderkey").alias("pos")).agg(F.sum("l_partkey").alias("n"))
    return sinks.merged_offsets(x, "part", "pos", "n").select("part", "pos", "offset")


@query("snk06", f"""with docs as (select distinct {_NORM} as text from documents where text is not null), l as (select unnest(string_split(text, chr(10))) as line from docs),
c as (select {_STRIP(_CLEAN)} as x from l), u as (select case when regexp_matches(x,'^[*=~◆◇■□★☆].*[^*=~◆◇■□★☆\\s].*[*=~◆◇■□★☆]$') and left(x,1)=right(x,1) then trim(trim(x,left(x,1))) else x end as text from c),
a as (select text, case when text='' then 'empty' when {_URL} then 'url' when not {_WORD} then 'decoration' when contains(text,chr(65533)) then 'broken' when {_GLUED} then 'glued' else '' end as reason from u)
select case when reason in ('broken','glued') then 'review' else 'drop' end as action, reason, count(*) as blocks, sum(length(text))::bigint as chars from a where reason<>'' group by 1,2""")
def snk06(spark, d):
    """The log of lines that are left out, written with the run and read back."""
    docs = table(spark, d, "documents").where("text is not null").select(t.normal_document(F.col("text")).alias("text")).distinct().withColumn("doc_hash", F.sha2("text", 256))
    log = spark.read.json(written(spark, doc.left_out_blocks(doc.clean_lines(docs)), "json", "audit"))
    return log.groupBy("action", "reason").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"))


@query("snk07", "select distinct o.doc_id, o.source_file, o.row_index, c.group_id, c.split_rank from origins o join contents c using (doc_hash)")
def snk07(spark, d):
    return rec.documents_log(table(spark, d, "origins"), table(spark, d, "contents"), "doc_hash", ["doc_id", "source_file", "row_index"], ["group_id", "split_rank"])


@query("snk08", "with u as (select distinct doc_hash, text_hash from units), w as (select text_hash, min(doc_hash) as winner from u group by 1) select o.doc_id, o.row_index, u.text_hash, u.doc_hash=w.winner as retained, count(*) as n from u join w using (text_hash) join origins o using (doc_hash) join contents c using (doc_hash) group by 1,2,3,4")
def snk08(spark, d):
    return rec.provenance(table(spark, d, "units"), table(spark, d, "origins"), table(spark, d, "contents"), "doc_hash", "text_hash", ["doc_id", "row_index"])


@query("snk09")
def snk09(spark, d):
    path = written(spark, table(spark, d, "nation").coalesce(1), "parquet", "manifest")
    files = sinks.file_digests(spark, path).where("file like '%.parquet'")
    return spark.createDataFrame([(sinks.manifest({"seed": 42}, {"rows": 25}, files),)], "manifest string")


@query("snk10")
def snk10(spark, d):
    """An existing folder is refused, a locked one too, and a second run writes only the part that the first left unfinished."""
    region = table(spark, d, "region")
    path = written(spark, region, "parquet", "once")
    try:
        sinks.write_once(region, path)
        refused = False
    except Exception as e:  # noqa: BLE001
        refused = "EXISTS" in str(e).upper()
    folder = place(spark, "resumed")
    first = sinks.write_resumable({"a": lambda: region}, folder)
    again = sinks.write_resumable({"a": lambda: region, "b": lambda: region}, folder)
    with sinks.locked(spark, folder):
        try:
            with sinks.locked(spark, folder):
                held = False
        except RuntimeError:
            held = True
    return spark.createDataFrame([(refused, held, ",".join(first), ",".join(again), spark.read.parquet(f"{folder}/a", f"{folder}/b").count())], "refused boolean, locked boolean, first string, again string, rows bigint")


@query("snk11")
def snk11(spark, d):
    counts = table(spark, d, "docs").groupBy("split").agg(F.count("*").alias("rows")).orderBy("split")
    return spark.createDataFrame([(sinks.markdown(counts),)], "report string")


@query("snk12", "select distinct id from seq where sig not in (select sig from seen where sig is not null)")
def snk12(spark, d):
    known = table(spark, d, "seen").select(F.sha2(F.concat_ws("\0", F.lit("v1"), "sig"), 256).alias("request_hash"))
    return sinks.uncached(table(spark, d, "seq").where("sig is not null"), known, "sig", "v1").select("id").distinct()

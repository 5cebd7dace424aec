"""Queries of tokens, sequences, mixtures, streams, scorers and guards."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from corpusmill.functions import scorers
from corpusmill.functions import segment as sg
from corpusmill.functions import text as t
from corpusmill.operators import governance as gov
from corpusmill.operators import sequences as sq
from corpusmill.operators.annotations import require
from corpusmill.plans.io import place
from corpusmill.plans.registry import query
from corpusmill.runtime import Stage, table
from corpusmill.sources import sinks
from corpusmill.streaming import streams as st

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_S = "(select distinct id, doc, split, source, pool, text, tokens, pairs from seq)"


def seq(spark, d):
    return table(spark, d, "seq").select("id", "doc", "split", "source", "pool", "text", "tokens", "pairs").distinct()


def _pieces(model: str = MODEL):
    """Encodes texts to ids, begun by 1 and ended by 2; the processor is loaded once in each worker."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def encode(text: pd.Series) -> pd.Series:
        p = _processor(model)
        return text.map(lambda x: None if x is None else [1, *p.encode(x), 2])

    @F.pandas_udf(StringType())
    def decode(ids: pd.Series) -> pd.Series:
        p = _processor(model)
        return ids.map(lambda x: None if x is None else p.decode([int(i) for i in x[1:-1]]))

    return encode, decode


def piece_counts(model: str = MODEL):
    """Numbers of tokens; ids stay in the worker, and a batch is encoded in one call."""

    @F.pandas_udf(IntegerType())
    def over(text: pd.Series) -> pd.Series:
        found = iter(_processor(model).encode([x for x in text if x is not None]))
        return pd.Series([None if x is None else len(next(found)) for x in text], dtype="Int32")

    return over


_loaded: dict = {}


def _processor(model: str):
    if model not in _loaded:
        import sentencepiece

        _loaded[model] = sentencepiece.SentencePieceProcessor(model_file=model)
    return _loaded[model]


@query("txt15")
def txt15(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(sg.text_chunks(F.col("text"))).alias("chunk", "text"))


@query("tok01")
def tok01(spark, d):
    """In place of training, which is not done here: tokens of all documents under a public vocabulary, by language and length class."""
    x = table(spark, d, "documents").where("text is not null").select(F.coalesce("lang", F.lit("none")).alias("lang"), F.length("text").alias("chars"), piece_counts()("text").alias("tokens"))
    kind = t.length_bucket(F.col("chars"), [(200, "short"), (1000, "medium")], "long").alias("kind")
    return x.groupBy("lang", kind).agg(F.count("*").alias("docs"), F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"))


@query("tok02")
def tok02(spark, d):
    """Encoded items with their decoding compared, and no reserved id inside."""
    encode, decode = _pieces()
    x = table(spark, d, "eval_items").where("text is not null").select("item_id", "text", encode("text").alias("ids"))
    x = x.withColumn("inner", F.slice("ids", 2, F.size("ids") - 2))
    checked = require(x, ~F.exists("inner", lambda i: i.isin(1, 2)), "a reserved id inside a sequence")
    return checked.select("item_id", F.size("ids").alias("n"), (decode("ids") == F.col("text")).alias("exact"))


@query("tok03")
def tok03(spark, d):
    p = _processor(MODEL)
    rows = [("unknown", str(p.unk_id()), p.unk_id() == 0), ("start", str(p.bos_id()), p.bos_id() == 1), ("end", str(p.eos_id()), p.eos_id() == 2), ("bytes", str(sum(p.is_byte(i) for i in range(p.vocab_size()))), sum(p.is_byte(i) for i in range(p.vocab_size())) == 256)]
    return spark.createDataFrame(rows, "contract string, value string, holds boolean")


@query("tok04")
def tok04(spark, d):
    x = table(spark, d, "documents").where("text is not null").select("lang", "text", piece_counts()("text").alias("n"))
    return x.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"), F.sum(F.length("text")).alias("chars"), F.max("n").alias("longest"))


@query("agg12_pieces")
def agg12_pieces(spark, d):
    """Statistics of tokens by language: characters a token, byte pieces, sequences that fit contexts, texts that do not decode to themselves."""
    encode, decode = _pieces()
    x = table(spark, d, "documents").where("text is not null").select(F.coalesce("lang", F.lit("none")).alias("lang"), "text", encode("text").alias("ids"))
    x = x.withColumn("n", F.size("ids") - 2).withColumn("same", decode("ids") == F.col("text"))
    byte = F.size(F.filter("ids", lambda i: i.between(3, 258)))
    fits = [F.count_if(F.col("n") + 2 <= c).alias(f"fits_{c}") for c in (128, 1024, 8192)]
    return x.groupBy("lang").agg(F.count("*").alias("docs"), (F.sum(F.length("text")) / F.sum("n")).alias("chars_a_token"), (F.sum(byte) / F.sum("n")).alias("byte_share"), *fits, F.max("n").alias("longest"), F.count_if(~F.col("same")).alias("mismatches"))


@query("rpt07")
def rpt07(spark, d):
    """Tokens for each Han letter, and the share of byte pieces, by source."""
    encode, _ = _pieces()
    x = table(spark, d, "documents").where("text is not null").select("source", "text", encode("text").alias("ids"))
    byte = F.size(F.filter("ids", lambda i: i.between(3, 258)))
    return x.groupBy("source").agg(F.sum(F.size("ids") - 2).alias("tokens"), F.sum(byte).alias("byte_tokens"), F.sum(t.count_of(F.col("text"), t.HAN)).alias("han"))


@query("seq01", f'select id, w as window_no, w*16 as start, least(17, n-w*16) as "len" from (select id, len(tokens) as n, unnest(range(0, (len(tokens)-2)//16+1)) as w from {_S} where len(tokens)>=2)')
def seq01(spark, d):
    return sq.windows(seq(spark, d).select("id", "tokens"), 16).select("id", F.col("window_no").cast("bigint").alias("window_no"), F.col("start").cast("bigint").alias("start"), F.col("len").cast("bigint").alias("len"))


@query("seq02", f"select id, w as window_no, tokens[w*16+1] as first, tokens[least(w*16+17, len(tokens))] as last from (select id, tokens, unnest(range(0, (len(tokens)-2)//16+1)) as w from {_S} where len(tokens)>=2)")
def seq02(spark, d):
    """Windows found again by (sequence, number) and read from the store."""
    s = seq(spark, d).select("id", "tokens")
    w = sq.windows(s, 16).select("id", "window_no", "start", "len")
    x = w.join(s, "id")
    at = lambda i: F.get("tokens", i)
    return x.select("id", F.col("window_no").cast("bigint").alias("window_no"), at(F.col("start")).alias("first"), at(F.col("start") + F.col("len") - 1).alias("last"))


@query("seq03", f"select id, list_sum(tokens[1:-2])::bigint as input_sum, list_sum(tokens[4:])::bigint as label_sum, least(2,len(tokens)-1) as masked from {_S} where len(tokens)>=4")
def seq03(spark, d):
    inputs, labels = sq.shifted(F.col("tokens"), 2)
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)
    x = seq(spark, d).where("size(tokens) >= 4").select("id", inputs.alias("i"), labels.alias("l"))
    return x.select("id", total(F.col("i")).alias("input_sum"), total(F.filter("l", lambda v: v >= 0)).alias("label_sum"), F.size(F.filter("l", lambda v: v == -100)).cast("bigint").alias("masked"))


@query("seq04", f"select id, least(129, 5+greatest(0,len(tokens)-2)+8+6) as n, case when len(tokens)-2>110 then 110 else greatest(0,len(tokens)-2) end as kept from {_S}")
def seq04(spark, d):
    """``[start, ctx] context [read] keys [write] out [end]`` in at most 129 ids; the context is cut from the left."""
    inner = F.slice("tokens", 2, F.greatest(F.lit(0), F.size("tokens") - 2))
    keys, out = F.array(*[F.lit(100 + i) for i in range(8)]), F.array(*[F.lit(200 + i) for i in range(6)])
    ids = sq.record(inner, keys, out, 129, 2, 3, 4, 5, 6)
    return seq(spark, d).select("id", F.size(ids).cast("bigint").alias("n"), (F.size(ids) - 19).cast("bigint").alias("kept"))


@query("seq04_text")
def seq04_text(spark, d):
    """The same of texts under a public vocabulary: contexts before items, which must decode to their end."""
    encode, decode = _pieces()
    x = table(spark, d, "eval_items").select("item_id", "text", encode(F.coalesce("left_context", F.lit(""))).alias("c"), encode("text").alias("x"))
    bare = lambda c: F.slice(c, 2, F.size(c) - 2)
    ids = sq.record(bare("c"), bare("x"), bare("x"), 4096, 1, 3, 4, 5, 2)
    made = x.select("item_id", "text", ids.alias("ids"), F.size(bare("x")).alias("m")).where("ids is not null")
    told = decode(F.concat(F.array(F.lit(1)), F.slice("ids", F.size("ids") - F.col("m"), F.col("m") + 1)))
    return made.select("item_id", F.size("ids").alias("n"), (told == F.col("text")).alias("exact"))


@query("seq05")
def seq05(spark, d):
    """A prefix of each sequence, its length drawn by splitmix64 from the id."""

    @F.pandas_udf(IntegerType())
    def crop(ids: pd.Series, n: pd.Series) -> pd.Series:
        import numpy as np

        u = sq.splitmix(ids.to_numpy(), 42)
        return pd.Series((2 + u % np.maximum(1, n.to_numpy() - 1).astype(np.uint64)).astype(np.int32))

    return seq(spark, d).where("size(tokens) >= 2").select("id", F.slice("tokens", 1, crop("id", F.size("tokens"))).alias("p")).select("id", F.size("p").alias("kept"))


@query("seq06", f'select id, w as window_no from (select id, len(tokens) as n, unnest(range(0, (len(tokens)-2)//16+1)) as w from {_S} where len(tokens)>=2) where least(17, n-w*16)>=8')
def seq06(spark, d):
    return sq.windows(seq(spark, d).select("id", "tokens"), 16).where("len >= 8").select("id", F.col("window_no").cast("bigint").alias("window_no"))


@query("seq07", f"select id, (len(tokens)+7)//8*8 as padded, (len(tokens)+7)//8*8-len(tokens) as mask from {_S}")
def seq07(spark, d):
    x = seq(spark, d).select("id", F.size("tokens").alias("n"), F.size(sq.padded(F.col("tokens"), 8)).alias("p"))
    return x.select("id", F.col("p").cast("bigint").alias("padded"), (F.col("p") - F.col("n")).cast("bigint").alias("mask"))


@query("seq08")
def seq08(spark, d):
    return sq.length_batches(seq(spark, d).select("id", "tokens"), "id", F.size("tokens"), 32, 4096, 42).select("id", "pool", "batch", "turn")


@query("seq08_resumed", f"select (count(*)+31)//32 as batches, count(*) as rows from {_S}")
def seq08_resumed(spark, d):
    """Two runs of which the second begins at the cursor of the first: each batch once."""
    whole = Stage(sq.batches_from(sq.length_batches(seq(spark, d).select("id", "tokens"), "id", F.size("tokens"), 32, 1 << 30, 42), 0), "batches").df
    first = whole.where("number < 3")
    both = first.unionByName(sq.batches_from(whole.drop("number"), 3).select(*whole.columns))
    return both.agg(F.count_distinct("number").alias("batches"), F.count_distinct("id").alias("rows"))


@query("seq09")
def seq09(spark, d):
    return sq.block_shuffle(seq(spark, d).select("id"), "id", 256, 42)


@query("seq10")
def seq10(spark, d):
    """Passes of least padding over buckets of sequences; a bucket of about 256 is one problem."""

    def cut(frame):
        frame = frame.sort_values(["n", "id"], ascending=[False, True]).reset_index(drop=True)
        ends = sq.packing_cost(frame["n"].tolist(), 2048, 64)
        frame["pass_no"] = [next(i for i, e in enumerate(ends) if k < e) for k in range(len(frame))]
        return frame[["bucket", "pass_no", "id"]]

    s = seq(spark, d).select("id", F.size("tokens").alias("n"))
    buckets = max(1, s.count() // 256)
    return s.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets))).groupBy("bucket").applyInPandas(cut, "bucket bigint, pass_no bigint, id bigint")


@query("mix01", f"select (select sum(pairs) from {_S} where pool='web' and split='train')::bigint as web, (select (sum(pairs)::bigint+2)//4 from {_S} where pool='web' and split='train')::bigint as quota")
def mix01(spark, d):
    """One epoch: all web sequences and chat up to a fifth of the whole; gives the sizes reached."""
    s = Stage(seq(spark, d).where("split = 'train'").select("id", "pool", "pairs"), "mix").df
    e = sq.epoch_map(s.where("pool = 'web'"), s.where("pool = 'chat'"), "id", "pairs", 0.2, 0, 42)
    g = e.agg(F.sum(F.when(F.col("cycle") < 0, F.col("pairs"))).alias("web"), F.coalesce(F.sum(F.when(F.col("cycle") >= 0, F.col("pairs"))), F.lit(0)).alias("chat"), F.coalesce(F.max(F.when(F.col("cycle") >= 0, F.col("pairs"))), F.lit(0)).alias("largest"))
    quota = F.expr("(web + 2) div 4")
    # Within one sequence of the quota, or the query fails.
    longest = s.where("pool = 'chat'").agg(F.max("pairs")).first()[0] or 0
    return require(g, F.col("chat").between(quota - longest - 1, quota + 1), "the mixture misses its quota").select("web", quota.alias("quota"))


@query("mix02")
def mix02(spark, d):
    """The chat cursor runs on from epoch to epoch."""
    s = Stage(seq(spark, d).where("split = 'train'").select("id", "pool", "pairs"), "mix").df
    out = None
    for epoch in range(3):
        e = sq.epoch_map(s.where("pool = 'web'"), s.where("pool = 'chat'"), "id", "pairs", 0.5, epoch, 42).where("cycle >= 0").select(F.lit(epoch).alias("epoch"), "cycle", "id", "pairs")
        out = e if out is None else out.unionByName(e)
    return out


@query("mix03", f"select 'web' as store, count(*) as rows, sum(pairs)::bigint as pairs from {_S} where pool='web' and split='train' union all select 'chat', count(*), sum(pairs)::bigint from {_S} s where pool='chat' and split='train' and doc in (select id from docs where split='train')")
def mix03(spark, d):
    """Stores side by side: the chat store under a mask of kept documents."""
    s = seq(spark, d).where("split = 'train'")
    kept = table(spark, d, "docs").where("split = 'train'").select(F.col("id").alias("doc")).distinct()
    both = s.where("pool = 'web'").withColumn("store", F.lit("web")).unionByName(s.where("pool = 'chat'").join(kept, "doc", "left_semi").withColumn("store", F.lit("chat")))
    return both.groupBy("store").agg(F.count("*").alias("rows"), F.sum("pairs").alias("pairs"))


_STEPS = lambda pool, n: f"select '{pool}' as task, place//{n} as step, place%{n} as slot, id from (select id, e*c+row_number() over (partition by e order by sha256('42:'||e||':'||id), id)-1 as place, c from (select id, count(*) over () as c from {_S} where split='train' and pool='{pool}'), (select unnest(range(0,100)) as e) where e>=40*{n}//c and e<=(60*{n}-1)//c) where place//{n} between 40 and 59"


@query("mix04", f"{_STEPS('web', 24)} union all {_STEPS('chat', 8)}")
def mix04(spark, d):
    """The rows of steps 40 to 59: 24 web and 8 chat sequences each, from permuted epochs; a step follows from its number alone."""
    s = Stage(seq(spark, d).where("split = 'train'").select("id", "pool"), "train").df
    return sq.step_rows({p: (s.where(F.col("pool") == p).select("id"), n) for p, n in (("web", 24), ("chat", 8))}, "id", 40, 60, 42)


@query("mix05", "select range as u, floor((range+1)*777/100)::bigint-floor(range*777/100)::bigint as examples from range(0,100)")
def mix05(spark, d):
    """777 examples over 100 updates, evenly."""
    i = F.col("id")
    return spark.range(100).select(i.alias("u"), (F.expr("(id + 1) * 777 div 100") - F.expr("id * 777 div 100")).alias("examples"))


@query("mix06", "select range as step, round((case when range<100 then range/100.0 else 0.1+0.9*0.5*(1+cos(pi()*least(1.0,(range-100)/900.0))) end)*(case when range>=600 then 0.5 else 1.0 end)*(case when range>=800 then 0.1 else 1.0 end),6) as rate from range(0,1200)")
def mix06(spark, d):
    return spark.range(1200).select(F.col("id").alias("step"), F.round(sq.schedule(F.col("id"), 100, 1000, 0.1, {600: 0.5, 800: 0.1}), 6).alias("rate"))


@query("rpt11", f"with c as (select id from {_S} where split='validation' and ('0x'||substr(sha256('eval:'||id),1,15))::ubigint%10<3) select id, w as window_no from (select id, unnest(range(0, (len(tokens)-2)//16+1)) as w from {_S} where len(tokens)>=2) where id in (select id from c)")
def rpt11(spark, d):
    """All windows of sampled validation sequences."""
    h = F.pmod(F.conv(F.substring(F.sha2(F.concat(F.lit("eval:"), F.col("id").cast("string")), 256), 1, 15), 16, 10).cast("bigint"), F.lit(10))
    chosen = seq(spark, d).where("split = 'validation'").where(h < 3).select("id")
    return sq.windows(seq(spark, d).select("id", "tokens"), 16).join(chosen, "id", "left_semi").select("id", F.col("window_no").cast("bigint").alias("window_no"))


# ---- streams


def _events(spark, d):
    return st.stream(spark, f"{d}/events.parque[t]")


@query("str01", "select event_type, count(*) as n from events group by 1")
def str01(spark, d):
    """A resumable copy: two runs over one checkpoint copy each file once."""
    path, mark = place(spark, "copy"), place(spark, "mark")
    for _ in range(2):
        st.run(_events(spark, d), path, mark)
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("str02", "select count(*) as events, count(distinct event_id) as ids from events")
def str02(spark, d):
    """A cursor that moves only with a written batch; a batch run again replaces itself."""
    path, mark = place(spark, "cursor"), place(spark, "mark")
    st.run(_events(spark, d).select("event_id"), path, mark)
    return spark.read.parquet(path).agg(F.count("*").alias("events"), F.count_distinct("event_id").alias("ids"))


@query("str02_cursor", "select 0 as epoch, count(*) as rows, count(*) as ids from region union all select 1, 4, 4")
def str02_cursor(spark, d):
    """Groups of three rows from permuted epochs of five; the second attempt fails after its rows are read, and is made again."""
    cursor = st.Cursor(table(spark, d, "region").select("r_regionkey"), "r_regionkey", place(spark, "commits"), 42)
    taken = []

    def fail(rows):
        rows.collect()
        raise RuntimeError("the update failed")

    taken.append(cursor.take(3, lambda rows: Stage(rows, "group").df))
    try:
        cursor.take(3, fail)
    except RuntimeError:
        pass
    for _ in range(2):
        taken.append(cursor.take(3, lambda rows: Stage(rows, "group").df))
    whole = taken[0].unionByName(taken[1]).unionByName(taken[2])
    return whole.groupBy("epoch").agg(F.count("*").alias("rows"), F.count_distinct("r_regionkey").alias("ids"))


@query("str03", "select event_id, recent, recent<=3 as admitted from (select event_id, count(*) over (partition by user_id order by epoch_us(ts) range between 59999999 preceding and current row) as recent from events)")
def str03(spark, d):
    return st.over_quota(table(spark, d, "events"), 60, 3).select("event_id", "recent", "admitted")


@query("str04", "with a as (select sig, count(*) as requests from seq where sig is not null and sig not in (select sig from seen where sig is not null) group by 1) select sig, requests, (row_number() over (order by sig)-1)%3 as account, (row_number() over (order by sig)-1)//30 as \"window\" from a")
def str04(spark, d):
    """Requests that a cache does not answer yet, each once with the number that wait for it, dealt to three accounts of ten requests a
    window. Calls over a network are a function of the user, wrapped by ``streams.retried``."""
    asked = table(spark, d, "seq").where("sig is not null").groupBy("sig").agg(F.count("*").alias("requests"))
    return st.dispatched(asked.join(table(spark, d, "seen").where("sig is not null").select("sig"), "sig", "left_anti"), ["sig"], 3, 10)


@query("str05", """with e as (select item_id, text, item_group, item_id%7=0 as broken, item_id%5=0 as other from eval_items), f as (select text, item_group, min(item_id) as first from e where not broken and text is not null and item_group is not null group by 1,2)
select outcome, count(*) as n from (select item_id, case when broken or (text is null and item_group is null) then 'unparsed' when text is null or item_group is null then 'incomplete' when item_id<>first then 'repeated' when item_id%11=0 then 'unverified' when other then 'refuted' else 'kept' end as outcome from e left join f using (text, item_group)) group by 1""")
def str05(spark, d):
    """Generated records through parsing, repeats and a blind check; broken replies, missing and differing checks are made here."""
    e = table(spark, d, "eval_items").select("item_id", "text", "item_group")
    whole = F.to_json(F.struct("item_id", "text", "item_group"))
    replies = e.select("item_id", F.when(F.col("item_id") % 7 == 0, F.substr(whole, F.lit(1), F.lit(5))).otherwise(whole).alias("reply"))
    checks = e.where("item_id % 11 <> 0").withColumn("item_group", F.when(F.col("item_id") % 5 == 0, F.concat(F.coalesce("item_group", F.lit("")), F.lit("?"))).otherwise(F.col("item_group")))
    found = st.verified_generation(replies, checks, "item_id", "reply", "item_id bigint, text string, item_group string", ["text", "item_group"])
    return found.groupBy("outcome").agg(F.count("*").alias("n"))


@query("str06", "select epoch(time_bucket(interval 1 hour, ts))::bigint as start, event_type, count(*) as n from events group by 1,2")
def str06(spark, d):
    """Event-time windows with a watermark, as a stream in update mode."""
    path, mark = place(spark, "windows"), place(spark, "mark")
    st.run(st.tumbling(_events(spark, d), "1 hour"), path, mark, "update")
    return st.latest(spark, path, ["start", "event_type"])


@query("str06_sliding", "select s*1800 as start, count(*) as n from (select unnest([floor(epoch(ts)/1800)::bigint, floor(epoch(ts)/1800)::bigint-1]) as s from events) group by 1")
def str06_sliding(spark, d):
    return st.sliding(table(spark, d, "events"), "1 hour", "30 minutes")


@query("str06_session", "with e as (select user_id, epoch_us(ts) as us, case when epoch_us(ts)-lag(epoch_us(ts)) over (partition by user_id order by ts, event_id)<1800000000 then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by us rows unbounded preceding) as k from e) select user_id, min(us) as start, count(*) as n from s group by user_id, k")
def str06_session(spark, d):
    return st.sessions(table(spark, d, "events"), "30 minutes")


@query("str06_state")
def str06_state(spark, d):
    """Running totals of each user in a stateful operator."""

    def fold(key, frames, state):
        n = state.get[0] if state.exists else 0
        for f in frames:
            n += len(f)
        state.update((n,))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n]})

    path, mark = place(spark, "state"), place(spark, "mark")
    st.run(st.stateful(_events(spark, d), fold, "user_id bigint, n bigint", "n bigint"), path, mark, "update")
    return st.latest(spark, path, ["user_id"])


# ---- scorers and other pluggable parts


@query("udf01")
def udf01(spark, d):
    """Answers scored by a counted model behind the scorer protocol."""
    from corpusmill.plans.ranking import bigram_shares, bigrams_of

    answers = table(spark, d, "eval_items").select("item_id", F.explode("answers").alias("answer"), "left_context")
    last = F.coalesce(F.nullif(F.right("left_context", F.lit(1)), F.lit("")), F.lit("^"))
    shares = bigram_shares(spark, d, answers.where("answer is not null").select(bigrams_of(F.concat(last, "answer"))))
    score = scorers.score_column(lambda: scorers.BigramScorer(shares.value))
    return answers.select("item_id", "answer", F.round(score("left_context", "answer"), 6).alias("score"))


@query("udf02", "select item_id, max(-length(a)::double) as score from (select item_id, unnest(answers) as a from eval_items) group by 1")
def udf02(spark, d):
    score = scorers.score_column(scorers.LengthScorer)
    return table(spark, d, "eval_items").select("item_id", "left_context", F.explode("answers").alias("a")).select("item_id", score("left_context", "a").alias("s")).groupBy("item_id").agg(F.max("s").alias("score"))


@query("udf02_adapters")
def udf02_adapters(spark, d):
    """One protocol, several adapters: the best answer of each item under a counted model, normalized by length, and an ensemble."""
    from corpusmill.plans.ranking import _scorer

    model = _scorer(spark, d)
    adapters = {"counted": lambda: scorers.SearchScorer(model.value), "by length": lambda: scorers.Normalized(scorers.SearchScorer(model.value)), "both": lambda: scorers.Ensemble([(0.7, scorers.SearchScorer(model.value)), (0.3, scorers.LengthScorer())])}
    x = table(spark, d, "eval_items").select("item_id", "left_context", F.posexplode("answers").alias("pos", "a")).where("a is not null")
    scored = x.select("item_id", "pos", "a", *[scorers.score_column(make)("left_context", "a").alias(name) for name, make in adapters.items()])
    best = [F.max_by("a", F.struct(F.col(f"`{n}`"), -F.col("pos"))).alias(n.replace(" ", "_")) for n in adapters]
    return scored.groupBy("item_id").agg(*best)


@query("udf03", "select split, count(*) as n, min(length(text)) as shortest, max(length(text)) as longest from seq group by 1")
def udf03(spark, d):
    """A mergeable aggregator as native partial and final aggregates."""
    n = F.length("text")
    return table(spark, d, "seq").groupBy("split").agg(F.count("*").alias("n"), F.min(n).alias("shortest"), F.max(n).alias("longest"))


@query("udf04")
def udf04(spark, d):
    """Sentences as a table function, joined laterally."""

    class Sentences:
        def eval(self, text: str):
            for s, a, b, done, _ in sg.split_sentences(text):
                yield s, a, b, done

    made = F.udtf(Sentences, returnType="text: string, start: int, stop: int, terminated: boolean")
    spark.udtf.register("corpusmill_sentences", made)
    table(spark, d, "eval_items").createOrReplaceTempView("corpusmill_items")
    return spark.sql("select i.item_id, s.text, s.start, s.stop, s.terminated from corpusmill_items i, lateral corpusmill_sentences(i.text) s")


@query("udf05", "select split, count(*) as rows, count(distinct doc) as docs from seq group by 1")
def udf05(spark, d):
    """Metrics as a dictionary of column builders."""
    metrics = {"rows": lambda: F.count("*"), "docs": lambda: F.count_distinct("doc")}
    return table(spark, d, "seq").groupBy("split").agg(*[make().alias(name) for name, make in metrics.items()])


# ---- guards


@query("gov01")
def gov01(spark, d):
    rows = []
    for path in ("/data/train/part-0.parquet", "/data/blind/part-0.parquet", "/data/test.parquet", "/data/latest/x.parquet"):
        try:
            gov.training_path(path)
            rows.append((path, True))
        except PermissionError:
            rows.append((path, False))
    return spark.createDataFrame(rows, "path string, admitted boolean")


@query("gov02", "select unnest(['committed plan','another plan','an item unreviewed']) as case_, unnest([count(*), 0, 0]) as admitted from eval_items")
def gov02(spark, d):
    """The gate opens for the committed plan with every item reviewed, and refuses otherwise."""
    plan = {"metric": "top1", "alpha": 0.05}
    items = table(spark, d, "eval_items").select("item_id", F.lit(True).alias("reviewed"))
    least = items.agg(F.min("item_id")).first()[0]
    cases = {"committed plan": (items, plan), "another plan": (items, {**plan, "alpha": 0.5}), "an item unreviewed": (items.withColumn("reviewed", F.col("item_id") != least), plan)}
    rows = []
    for name, (given, used) in cases.items():
        try:
            rows.append((name, gov.blind_gate(given, used, sinks.fingerprint(plan)).count()))
        except Exception as e:  # noqa: BLE001
            if "not the committed" not in str(e) and "not reviewed" not in str(e):
                raise
            rows.append((name, 0))
    return spark.createDataFrame(rows, "case_ string, admitted bigint")


@query("gov03")
def gov03(spark, d):
    ledger = place(spark, "ledger")
    gov.consume_once(spark, ledger, "blind-1", "a")
    gov.consume_once(spark, ledger, "blind-1", "a")
    try:
        gov.consume_once(spark, ledger, "blind-1", "b")
        refused = False
    except PermissionError:
        refused = True
    return spark.createDataFrame([(refused,)], "refused boolean")


@query("gov04")
def gov04(spark, d):
    a = sinks.fingerprint({"seed": 42, "text": "x\r\ny"}, "v1")
    b = sinks.fingerprint({"text": "x\ny", "seed": 42}, "v1")
    return spark.createDataFrame([(a, a == b)], "signature string, same boolean")


"""Queries of ranking, metrics, statistics, search and reports.

Pools: an order is an item, its lines are the candidates in place of line number; the discount is an engine score with
many ties, the price a second one; returned lines are the correct candidates; priority stands for the source.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.functions import search
from corpusmill.functions import text as t
from corpusmill.functions.keys import draw
from corpusmill.functions.segment import greedy_phrases
from corpusmill.operators import dedup as dd
from corpusmill.operators import ngrams as ng
from corpusmill.operators import ranking as rk
from corpusmill.operators import statistics as st
from corpusmill.operators.annotations import require
from corpusmill.plans.registry import query
from corpusmill.runtime import Stage, table

_POOL = "(select l_orderkey as item, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as pos, l_partkey as cand, l_discount as engine, l_extendedprice as model, l_returnflag='R' as correct from lineitem)"
_RANKED = f"(select *, row_number() over (partition by item order by engine desc, pos) as r_engine, row_number() over (partition by item order by model desc, pos) as r_model from {_POOL})"
_GOLD = f"(select item, min(case when correct then pos end) as b_pool, min(case when correct then r_engine end) as b_engine, min(case when correct then r_model end) as b_model, count(*) as size from {_RANKED} group by 1)"
_ITEMS = f"(select g.*, o_orderpriority as source, o_orderstatus as context, o_custkey as grp, o_custkey%40 as cluster from {_GOLD} g join orders on o_orderkey=item)"
_RR = lambda b: f"sum(case when {b}<=12 then 27720//{b} else 0 end)::bigint as rr_units"
_M = lambda b: f"count(*) as cases, count({b}) as covered, count(*) filter ({b}<=1) as top1, count(*) filter ({b}<=3) as top3, count(*) filter ({b}<=5) as top5, {_RR(b)}"

_P = lambda g, l: f"case when {g}+{l}=0 then 1.0 else least(1.0, 2*list_sum(list_transform(range(0,least({g},{l})+1), lambda i: exp(lgamma({g}+{l}+1)-lgamma(i+1)-lgamma({g}+{l}-i+1)-({g}+{l})*ln(2))))) end"


def pool(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("item"), F.row_number().over(w).alias("pos"), F.col("l_partkey").alias("cand"), F.col("l_discount").alias("engine"), F.col("l_extendedprice").alias("model"), (F.col("l_returnflag") == "R").alias("correct"))


def ranked(spark, d):
    by = lambda c: F.row_number().over(Window.partitionBy("item").orderBy(F.desc(c), "pos"))
    return pool(spark, d).withColumn("r_engine", by("engine")).withColumn("r_model", by("model"))


def gold(spark, d):
    first = lambda c: F.min(F.when(F.col("correct"), F.col(c)))
    return ranked(spark, d).groupBy("item").agg(first("pos").alias("b_pool"), first("r_engine").alias("b_engine"), first("r_model").alias("b_model"), F.count("*").alias("size"))


def items(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("context"), F.col("o_custkey").alias("grp"))
    return gold(spark, d).join(o, "item").withColumn("cluster", F.col("grp") % 40)


def best(spark, d, which, *keep):
    return items(spark, d).select("item", *keep, F.col(f"b_{which}").alias("best"))


def clusters(spark, d):
    """Cases, hits and net of two methods in each cluster."""
    a, b = F.coalesce(F.col("b_model") == 1, F.lit(False)), F.coalesce(F.col("b_engine") == 1, F.lit(False))
    return items(spark, d).groupBy("cluster").agg(F.count("*").alias("cases"), F.count_if(a).alias("hits"), F.count_if(a & ~b).alias("gain"), F.count_if(b & ~a).alias("loss"), (F.count_if(a & ~b) - F.count_if(b & ~a)).alias("net"))


_CL = f"(select cluster, count(*) as cases, count(*) filter (b_model=1) as hits, count(*) filter (coalesce(b_model=1,false) and not coalesce(b_engine=1,false)) as gain, count(*) filter (coalesce(b_engine=1,false) and not coalesce(b_model=1,false)) as loss from {_ITEMS} group by 1)"


@query("jn12", f"select item, min(r_model) filter (correct) as best, count(*) as size from {_RANKED} join orders on o_orderkey=item group by 1")
def jn12(spark, d):
    """Scores, pools and items joined; every item of the pool must be known."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("item"), F.lit(True).alias("known"))
    x = require(pool(spark, d).join(o, "item", "left"), F.col("known"), "a pool of an unknown item")
    return rk.gold_rank(rk.with_fallback(x, "item", "model"), "item")


@query("top03", f"select item, pos, r_engine as rank from {_RANKED}")
def top03(spark, d):
    return rk.rerank(pool(spark, d), "item", F.col("engine")).select("item", "pos", "rank")


@query("top04", "with f as (select p_brand, min(p_partkey) as k from part where p_name is not null group by p_brand, left(p_name,4)), r as (select p_brand, k, row_number() over (partition by p_brand order by k)-1 as pos from f) select r.p_brand, pos, p_name as name from r join part on p_partkey=k where pos<5")
def top04(spark, d):
    """The first name of each start of four characters over all parts of a brand, and of these the first five."""
    first = table(spark, d, "part").where("p_name is not null").groupBy("p_brand", F.substring("p_name", 1, 4).alias("start")).agg(F.min(F.struct("p_partkey", "p_name")).alias("s"))
    five = first.withColumn("r", F.row_number().over(Window.partitionBy("p_brand").orderBy("s"))).where("r <= 5")
    return five.select("p_brand", (F.col("r") - 1).alias("pos"), F.col("s.p_name").alias("name"))


@query("agg14", f"select {_M('b_model')} from {_ITEMS}")
def agg14(spark, d):
    return best(spark, d, "model").agg(*rk.metrics())


@query("agg15", f"select method, context, {_M('b')} from (select unnest(['pool','engine','model']) as method, context, unnest([b_pool,b_engine,b_model]) as b from {_ITEMS}) group by grouping sets ((method),(method,context))")
def agg15(spark, d):
    m = F.explode(F.create_map(*[x for n in ("pool", "engine", "model") for x in (F.lit(n), F.col(f"b_{n}"))])).alias("method", "best")
    return items(spark, d).select("context", m).groupingSets([["method"], ["method", "context"]], "method", "context").agg(*rk.metrics())


@query("agg16", f"select source, size_class, {_M('b_model')} from (select *, case when size<=2 then 'small' when size<=5 then 'medium' else 'large' end as size_class from {_ITEMS}) group by grouping sets ((),(source),(size_class),(source,size_class))")
def agg16(spark, d):
    x = best(spark, d, "model", "source", "size").withColumn("size_class", t.length_bucket(F.col("size"), [(2, "small"), (5, "medium")], "large"))
    return x.groupingSets([[], ["source"], ["size_class"], ["source", "size_class"]], "source", "size_class").agg(*rk.metrics())


@query("agg16_macro", f"select round(avg(share),6) as macro_top1 from (select round(count(*) filter (b_model=1)/count(*),6) as share from {_ITEMS} group by source)")
def agg16_macro(spark, d):
    return best(spark, d, "model", "source").groupBy("source").agg(F.round(F.count_if(F.col("best") == 1) / F.count("*"), 6).alias("share")).agg(F.round(F.avg("share"), 6).alias("macro_top1"))


@query("agg17", f"select count(*) as cases, sum(27720*good//least(tied,12))::bigint as credit_units from (select item, count(*) as tied, count(*) filter (correct) as good from (select *, max(engine) over (partition by item) as m from {_POOL}) where engine>=m-1e-9 group by 1)")
def agg17(spark, d):
    """Each candidate that ties for the first place has an equal part of the credit."""
    m = F.max("engine").over(Window.partitionBy("item"))
    x = pool(spark, d).withColumn("m", m).where(F.col("engine") >= F.col("m") - 1e-9).groupBy("item").agg(F.count("*").alias("tied"), F.count_if("correct").alias("good"))
    return x.agg(F.count("*").alias("cases"), F.sum(F.expr("27720 * good div least(tied, 12)")).alias("credit_units"))


@query("agg18", f"select source, count(*) filter (size=4) as equal_length, count(*) filter (size=4 and b_model=1) as equal_right, count(*) filter (b_pool=1) as first_right from {_ITEMS} group by 1")
def agg18(spark, d):
    return items(spark, d).groupBy("source").agg(F.count_if(F.col("size") == 4).alias("equal_length"), F.count_if((F.col("size") == 4) & (F.col("b_model") == 1)).alias("equal_right"), F.count_if(F.col("b_pool") == 1).alias("first_right"))


@query("agg19", f"with c as (select item, source, b_model=1 as hit, (select 0) as z, size from {_ITEMS}), r as (select *, row_number() over (partition by source order by size desc, item) as k, count(*) over (partition by source) as n from c) select source, count(*) as cases, count(*) filter (hit) as hits, count(*) filter (hit and k<=greatest(1,round_even(0.2*n,0))) as hits_at_fifth from r group by 1")
def agg19(spark, d):
    x = Stage(best(spark, d, "model", "source", "size").withColumn("hit", F.col("best") == 1), "hits").df
    n = x.groupBy("source").agg(F.count("*").alias("n"))
    x = dd.global_rank(x, [F.desc("size"), F.col("item")], ["source"]).withColumnRenamed("rank", "k").join(n, "source")
    return x.groupBy("source").agg(F.count("*").alias("cases"), F.count_if("hit").alias("hits"), F.count_if(F.col("hit") & (F.col("k") <= F.greatest(F.lit(1), F.bround(F.col("n") * 0.2)))).alias("hits_at_fifth"))


@query("agg20", f"select count(*) as groups, count(*) filter (a) as all_right, sum(n)::bigint as cases from (select grp, bool_and(coalesce(b_model=1,false)) as a, count(*) as n from {_ITEMS} group by 1)")
def agg20(spark, d):
    x = best(spark, d, "model", "grp").groupBy("grp").agg(F.bool_and(F.coalesce(F.col("best") == 1, F.lit(False))).alias("a"), F.count("*").alias("n"))
    return x.agg(F.count("*").alias("groups"), F.count_if("a").alias("all_right"), F.sum("n").alias("cases"))


_SAVE = f"(select th/100.0 as threshold, sum(case when engine>=th/100.0 then case when correct then 3 else -1 end else 0 end)::bigint as saved from {_RANKED}, (select unnest(range(0,11)) as th) where r_engine=1 group by 1)"


def _savings(spark, d):
    th = spark.range(11).select((F.col("id") / 100).alias("threshold"))
    x = ranked(spark, d).where("r_engine = 1").crossJoin(F.broadcast(th))  # eleven thresholds
    return x.groupBy("threshold").agg(F.sum(F.when(F.col("engine") >= F.col("threshold"), F.when(F.col("correct"), 3).otherwise(-1)).otherwise(0)).alias("saved"))


@query("agg21", f"select max_by(threshold, saved*1000+threshold) as threshold, max(saved) as saved from {_SAVE}")
def agg21(spark, d):
    """The threshold that saves most; ties go to the higher."""
    return st.best_setting(_savings(spark, d), "threshold", "saved")


@query("agg22", f"select case when b_pool is null then 'absent' when b_model=1 then 'right' when b_engine=1 then 'broken' when b_model<=3 then 'near' else 'far' end as class, count(*) as cases, count(*) filter (b_model=1 or b_engine=1) as oracle from {_ITEMS} group by 1")
def agg22(spark, d):
    m, e = F.col("b_model"), F.col("b_engine")
    kind = F.when(F.col("b_pool").isNull(), "absent").when(m == 1, "right").when(e == 1, "broken").when(m <= 3, "near").otherwise("far")
    return items(spark, d).groupBy(kind.alias("class")).agg(F.count("*").alias("cases"), F.count_if((m == 1) | (e == 1)).alias("oracle"))


@query("agg23", f"with p as (select item, bool_or(correct) as a, bool_or(correct and pos<=3) as b, count(*) as n, count(*) filter (pos<=3) as k from {_POOL} group by 1) select count(*) as items, count(*) filter (a) as covered, count(*) filter (b) as kept, count(*) filter (a and not b) as lost, count(*) filter (n=k) as identical, sum(n)::bigint as size, sum(k)::bigint as small_size from p")
def agg23(spark, d):
    """Whole pools against their first three candidates."""
    c, s = F.col("correct"), F.col("pos") <= 3
    p = pool(spark, d).groupBy("item").agg(F.bool_or(c).alias("a"), F.bool_or(c & s).alias("b"), F.count("*").alias("n"), F.count_if(s).alias("k"))
    return p.agg(F.count("*").alias("items"), F.count_if("a").alias("covered"), F.count_if("b").alias("kept"), F.count_if(F.col("a") & ~F.col("b")).alias("lost"), F.count_if(F.col("n") == F.col("k")).alias("identical"), F.sum("n").alias("size"), F.sum("k").alias("small_size"))


@query("agg24", f"select scheme, clusters, gain, loss, both_right, round({_P('gain','loss')},6) as p from (select scheme, count(distinct c) as clusters, count(*) filter (a and not b) as gain, count(*) filter (b and not a) as loss, count(*) filter (a and b) as both_right from (select unnest(['source','context','customer']) as scheme, unnest([source, context, grp::varchar]) as c, coalesce(b_model=1,false) as a, coalesce(b_engine=1,false) as b from {_ITEMS}) group by 1)")
def agg24(spark, d):
    a, b = F.coalesce(F.col("b_model") == 1, F.lit(False)), F.coalesce(F.col("b_engine") == 1, F.lit(False))
    scheme = F.explode(F.create_map(F.lit("source"), F.col("source"), F.lit("context"), F.col("context"), F.lit("customer"), F.col("grp").cast("string"))).alias("scheme", "c")
    x = items(spark, d).select(scheme, a.alias("a"), b.alias("b"))
    g = x.groupBy("scheme").agg(F.count_distinct("c").alias("clusters"), F.count_if(F.col("a") & ~F.col("b")).alias("gain"), F.count_if(F.col("b") & ~F.col("a")).alias("loss"), F.count_if(F.col("a") & F.col("b")).alias("both_right"))
    return g.withColumn("p", F.round(st.mcnemar(F.col("gain"), F.col("loss")), 6))


@query("agg25", f"with s as (select cluster%5 as seed, count(*) filter (b_model=1) as hits from {_ITEMS} group by 1) select count(*) as seeds, avg(hits) as mean, max(hits)-min(hits) as spread, round(stddev_samp(hits),6) as sd from s")
def agg25(spark, d):
    s = best(spark, d, "model", "cluster").groupBy(F.col("cluster") % 5).agg(F.count_if(F.col("best") == 1).alias("hits"))
    return s.agg(F.count("*").alias("seeds"), F.avg("hits").alias("mean"), (F.max("hits") - F.min("hits")).alias("spread"), F.round(F.stddev_samp("hits"), 6).alias("sd"))


@query("agg26", f"select count(*) filter (r_engine=2) as second, count(*) filter (r_engine=2 and engine>=0.05) as shown, count(*) filter (r_engine=2 and engine>=0.05 and correct) as shown_right, count(*) filter (r_engine=2 and engine>=0.05 and not correct) as shown_wrong from {_RANKED}")
def agg26(spark, d):
    two, shown = F.col("r_engine") == 2, F.col("engine") >= 0.05
    return ranked(spark, d).agg(F.count_if(two).alias("second"), F.count_if(two & shown).alias("shown"), F.count_if(two & shown & F.col("correct")).alias("shown_right"), F.count_if(two & shown & ~F.col("correct")).alias("shown_wrong"))


@query("agg27", "select l_linestatus, round(sum(l_tax)/count(*),6) as loss, round(exp(least(50,sum(l_tax)/count(*))),6) as perplexity, round(sum(l_tax)/(sum(l_quantity)*ln(2)),6) as bits from lineitem group by 1")
def agg27(spark, d):
    """Tax as loss of a token, quantity as its characters."""
    n, k = F.sum("l_tax"), F.count("*")
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(F.round(n / k, 6).alias("loss"), F.round(F.exp(F.least(F.lit(50.0), n / k)), 6).alias("perplexity"), F.round(n / (F.sum("l_quantity") * F.log(F.lit(2.0))), 6).alias("bits"))


# ---- statistics


@query("sta01", f"select cluster, gain, loss, round(case when gain+loss=0 then 1.0 else least(1.0, 2*list_sum(list_transform(range(0,least(gain,loss)+1), lambda i: exp(lgamma(gain+loss+1)-lgamma(i+1)-lgamma(gain+loss-i+1)-(gain+loss)*ln(2))))) end,6) as p from {_CL}")
def sta01(spark, d):
    return clusters(spark, d).select("cluster", "gain", "loss", F.round(st.mcnemar(F.col("gain"), F.col("loss")), 6).alias("p"))


_NETS = f"(select cluster%10 as c, sum(gain-loss)::bigint as net from {_CL} group by 1)"


@query("sta02", f"with recursive n as (select net, row_number() over (order by net, c) as k from {_NETS} where net<>0), f as (select 0 as k, 0::bigint as s union all select f.k+1, f.s+z.sign*n.net from f join n on n.k=f.k+1, (select unnest([1,-1]) as sign) z) select count(*) filter (abs(s)>=(select abs(sum(net)) from n))/count(*) as p, max(k) as clusters from f where k=(select coalesce(max(k),0) from n)")
def sta02(spark, d):
    return st.sign_flip_exact(clusters(spark, d).groupBy((F.col("cluster") % 10).alias("c")).agg(F.sum("net").alias("net")))


@query("sta02_drawn")
def sta02_drawn(spark, d):
    return st.sign_flip_drawn(clusters(spark, d), "cluster")


@query("sta03")
def sta03(spark, d):
    return st.bootstrap(clusters(spark, d), "cluster", "net", "cases")


@query("sta04", f"select round(((hh-2*h/n*hn+(h/n)*(h/n)*nn)*k/(k-1))/(n*(h/n)*(1-h/n)),6) as effect, k as clusters from (select sum(hits) as h, sum(cases) as n, count(*) as k, sum(hits*hits) as hh, sum(hits*cases) as hn, sum(cases*cases) as nn from {_CL})")
def sta04(spark, d):
    return st.design_effect(clusters(spark, d), "hits", "cases").select(F.round("effect", 6).alias("effect"), "clusters")


@query("sta05", f"select source, count(*) as pairs, count(*) filter (a and not b) as gain, count(*) filter (b and not a) as loss, count(*) filter (a and not b)-count(*) filter (b and not a) as net from (select source, coalesce(b_model=1,false) as a, coalesce(b_engine=1,false) as b from {_ITEMS}) group by 1")
def sta05(spark, d):
    return rk.paired(best(spark, d, "engine", "source"), best(spark, d, "model"), "item", "source")


@query("sta06", f"with p as (select cluster, (gain+1)/(gain+loss+40.0) as p from {_CL}), s as (select *, least(1.0,(count(*) over ()-row_number() over (order by p, cluster)+1)*p) as x from p) select cluster, p, max(x) over (order by p, cluster rows unbounded preceding) as adjusted from s")
def sta06(spark, d):
    tests = clusters(spark, d).select("cluster", ((F.col("gain") + 1) / (F.col("gain") + F.col("loss") + 40.0)).alias("p"))
    return st.holm(tests, "cluster", "p")


@query("sta07", f"select cluster, round((p+zz/(2*n)-z*sqrt(p*(1-p)/n+zz/(4*n*n)))/(1+zz/n),6) as low, round((p+zz/(2*n)+z*sqrt(p*(1-p)/n+zz/(4*n*n)))/(1+zz/n),6) as high from (select cluster, hits/cases as p, cases::double as n, 1.959963984540054 as z, 1.959963984540054*1.959963984540054 as zz from {_CL})")
def sta07(spark, d):
    low, high = st.wilson(F.col("hits"), F.col("cases").cast("double"))
    return clusters(spark, d).select("cluster", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


_GRID = f"(select lam/10.0 as lam, item, correct, row_number() over (partition by lam, item order by engine*1000000+lam/10.0*model desc, pos) as r from {_POOL}, (select unnest(range(0,6)) as lam))"


def _grid(spark, d):
    lam = F.broadcast(spark.range(6).select((F.col("id") / 10).alias("lam")))  # six settings
    w = Window.partitionBy("lam", "item").orderBy(F.desc(F.col("engine") * 1000000 + F.col("lam") * F.col("model")), "pos")
    return pool(spark, d).crossJoin(lam).withColumn("r", F.row_number().over(w))


@query("sta08", f"select lam, count(*) filter (r=1 and correct) as top1 from {_GRID} group by 1")
def sta08(spark, d):
    return _grid(spark, d).groupBy("lam").agg(F.count_if((F.col("r") == 1) & F.col("correct")).alias("top1"))


@query("sta08_best", f"with g as (select lam, count(*) filter (r=1 and correct) as top1 from {_GRID} group by 1) select max_by(lam, top1*1000-lam) as lam, max(top1) as top1 from g")
def sta08_best(spark, d):
    """The best weight of the second score; ties go to the smaller."""
    return st.best_setting(sta08(spark, d), "lam", "top1", larger_wins=False)


_FEATURES = f"(select item, pos, engine*100000 as c, model as f, cand%7 as n, pos*1.0 as z, correct, o_orderpriority as source from {_POOL} join orders on o_orderkey=item)"
_METHODS = {"baseline": [()], "pmi": [(0.5,), (1.0,)], "length": [(100.0,), (1000.0,)], "engine": [(-1000.0,), (1000.0,)], "combined": [(0.5, -1000.0), (1.0, 1000.0)], "gated-engine": [(-1000.0, 1000.0), (1000.0, 2500.0)]}
_SETTINGS = [(m, i, *(tuple(p) + (0.0, 0.0))[:2]) for m, ps in _METHODS.items() for i, p in enumerate(ps)]


@query("sta08_methods", f"""with s as (select * from (values {','.join(f"('{m}',{i},{p}::double,{q}::double)" for m, i, p, q in _SETTINGS)}) t(method, setting, p, q)),
x as (select *, max(c) over (partition by item) as c1, (select c) as c0 from {_FEATURES}), gap as (select item, max(c)-coalesce(max(c) filter (k=2), 1e300*(-1)) as gap from (select item, c, row_number() over (partition by item order by c desc, pos) as k from {_FEATURES}) where k<=2 group by 1),
v as (select method, setting, p, q, item, pos, correct, source, case method when 'baseline' then c when 'pmi' then c-p*f when 'length' then c+p*n when 'engine' then c+p*z when 'combined' then c-p*f+q*z else case when gap>=q then c else c+p*z end end as value from x join gap using (item), s),
r as (select *, row_number() over (partition by method, setting, item order by value desc, pos) as k from v),
e as (select method, setting, any_value(p) as p, any_value(q) as q, count(*) filter (k=1 and correct) as exact from r group by 1,2)
select method, arg_max(setting, (exact, -abs(p)-abs(q), -setting)) as setting, max(exact) as exact from e group by 1""")
def sta08_methods(spark, d):
    """Families of rescoring over one grid: prior taken off, length, engine, both, and the engine only where the first two are
    close; the best setting of each, ties to the smaller weights."""
    return st.best_of_methods(st.rescored(_features(spark, d), _METHODS), "method", "setting").select("method", F.col("setting").cast("bigint").alias("setting"), "exact")


def _features(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_orderpriority").alias("source"))
    x = pool(spark, d).join(o, "item")
    return x.select("item", "pos", (F.col("engine") * 100000).alias("c"), F.col("model").alias("f"), (F.col("cand") % 7).alias("n"), (F.col("pos") * 1.0).alias("z"), "correct", "source")


@query("sta08_cv")
def sta08_cv(spark, d):
    """Settings chosen on all sources but one, judged on that one."""
    return st.cross_validated(st.rescored(_features(spark, d), _METHODS), "source")


@query("sta09", f"with f as (select th/100.0 as margin, count(*) filter (engine>=th/100.0 and correct) as right_, count(*) filter (engine>=th/100.0 and not correct) as wrong, count(*) as n from {_RANKED}, (select unnest(range(0,11)) as th) where r_engine=2 group by 1) select max_by(margin, right_*1000+margin) as margin, max(right_) as shown_right from f where wrong<=0.3*n")
def sta09(spark, d):
    """The margin that shows most right candidates while wrong ones stay under a cap."""
    th = F.broadcast(spark.range(11).select((F.col("id") / 100).alias("margin")))
    shown = F.col("engine") >= F.col("margin")
    f = ranked(spark, d).where("r_engine = 2").crossJoin(th).groupBy("margin").agg(F.count_if(shown & F.col("correct")).alias("shown_right"), F.count_if(shown & ~F.col("correct")).alias("wrong"), F.count("*").alias("n"))
    return st.best_setting(f.where("wrong <= 0.3 * n"), "margin", "shown_right")


_AB = f"(select source, cluster%5 as seed, coalesce(b_model=1,false) as a, coalesce(b_engine=1,false) as b from {_ITEMS})"


@query("sta10", f"with c as (select source, count(*) filter (a and not b) as gain, count(*) filter (b and not a) as loss, (count(*) filter (a)-count(*) filter (b))/count(*) as difference from {_AB} group by 1), p as (select *, {_P('gain','loss')} as p from c), h as (select *, least(1.0, max(x) over (order by p, source rows unbounded preceding)) as adjusted from (select *, least(1.0,(count(*) over ()-row_number() over (order by p, source)+1)*p) as x from p)), r as (select source, max(s)-min(s) as spread from (select source, seed, count(*) filter (a)/count(*) as s from {_AB} group by 1,2) group by 1) select source, abs(difference)>spread as beyond, adjusted<0.05 as significant, abs(difference)>spread and adjusted<0.05 as effective, case when abs(difference)>spread and adjusted<0.05 then case when difference>0 then 'model' else 'engine' end end as winner from h join r using (source)")
def sta10(spark, d):
    """Contrasts of two methods by source: effective if the difference lies beyond the range of the seeds (here fifths of
    the customers) and stays significant under Holm's correction."""
    a, b = F.coalesce(F.col("b_model") == 1, F.lit(False)), F.coalesce(F.col("b_engine") == 1, F.lit(False))
    x = items(spark, d).select("source", (F.col("cluster") % 5).alias("seed"), a.alias("a"), b.alias("b"))
    seeds = x.groupBy("source", "seed").agg((F.count_if("a") / F.count("*")).alias("value"))
    contrasts = x.groupBy("source").agg(F.count_if(F.col("a") & ~F.col("b")).alias("gain"), F.count_if(F.col("b") & ~F.col("a")).alias("loss"), ((F.count_if("a") - F.count_if("b")) / F.count("*")).alias("difference"))
    return st.effective(contrasts, "source", seeds, "value").select("source", "beyond", "significant", "effective", F.when(F.col("effective"), F.when(F.col("difference") > 0, "model").otherwise("engine")).alias("winner"))


@query("sta11", f"select cluster, gain>loss as gate_gain, loss*10<=cases as gate_loss, gain>loss and loss*10<=cases as passed from {_CL}")
def sta11(spark, d):
    gain, loss = F.col("gain") > F.col("loss"), F.col("loss") * 10 <= F.col("cases")
    return clusters(spark, d).select("cluster", gain.alias("gate_gain"), loss.alias("gate_loss"), (gain & loss).alias("passed"))


@query("sta12", f"select item, pos, row_number() over (partition by item order by r_engine+r_model, pos) as rank from {_RANKED}")
def sta12(spark, d):
    """Two members vote with their ranks; the smallest sum is first."""
    votes = ranked(spark, d)
    long = votes.select("item", "pos", (-F.col("r_engine")).alias("v")).unionByName(votes.select("item", "pos", (-F.col("r_model")).alias("v")))
    return rk.rerank(long.groupBy("item", "pos").agg(F.sum("v").alias("v")), "item", F.col("v")).select("item", "pos", "rank")


@query("sta13", r"with a as (select item_id, answers, unnest(range(1,len(answers)+1)) as pos from eval_items), x as (select item_id, pos, nfc_normalize(answers[pos]) as c, nfc_normalize(answers[1]) as g from a where pos>1 and answers[pos] is not null and answers[1] is not null), y as (select item_id, pos, c, g, regexp_replace(lower(c),'[^\p{L}\p{N}]','','g') as lc, regexp_replace(lower(g),'[^\p{L}\p{N}]','','g') as lg, regexp_replace(c,'[^\p{Han}]','','g') as hc, regexp_replace(g,'[^\p{Han}]','','g') as hg from x) select item_id, pos, case when c=g then 'correct' when lc=lg or (hc=hg and hc<>'') then 'notation' else 'semantic' end as class from y")
def sta13(spark, d):
    """The class of every further answer against the first: correct, only written otherwise, or of another meaning."""
    e = table(spark, d, "eval_items").select("item_id", F.col("answers")[0].alias("gold"), F.posexplode("answers").alias("pos", "choice")).where("pos > 0 and choice is not null and gold is not null")
    e = e.select("item_id", (F.col("pos") + 1).cast("bigint").alias("pos"), t.nfc(F.col("choice")).alias("choice"), t.nfc(F.col("gold")).alias("gold"))
    return e.select("item_id", "pos", rk.error_class(F.col("choice"), F.col("gold")).alias("class"))


@query("sta14", "select l_orderkey, count(*) as lines, bool_and(abs(l_extendedprice)<1e7) as in_range, round(max(l_tax)-min(l_tax),6) as spread from lineitem group by 1 having max(l_tax)-min(l_tax)>0.07")
def sta14(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.bool_and(F.abs("l_extendedprice") < 1e7).alias("in_range"), (F.max("l_tax") - F.min("l_tax")).alias("spread"))
    return g.where("spread > 0.07").withColumn("spread", F.round("spread", 6))


# ---- search with a counted language model as the scorer


def _lm(spark, d):
    """Bigram counts of training sequences: ``(ctx, ch, n, total)``."""
    x = table(spark, d, "seq").where("text is not null and split = 'train'").select(F.concat(F.lit("^"), "text", F.lit("$")).alias("x"))
    g = x.select(F.explode(t.char_grams(F.col("x"), 2)).alias("g")).groupBy(F.substring("g", 1, 1).alias("ctx"), F.substring("g", 2, 1).alias("ch")).agg(F.count("*").alias("n"))
    return g.withColumn("total", F.sum("n").over(Window.partitionBy("ctx")))


_BI = "(select substring(x,i,1) as ctx, substring(x,i+1,1) as ch, count(*) as n from (select x, unnest(range(1,length(x))) as i from (select '^'||text||'$' as x from seq where text is not null and split='train')) group by 1,2)"


#: The counted model of five characters in SQL: tables g5 to g1, discounts d and vocabulary size v.
_KN = r"""d0 as (select id, chr(2)||text as x from (select distinct id, text from seq where split='train' and text is not null)),
c0 as (select id, i, substring(x,i,1) as c from (select id, x, unnest(range(1,length(x)+1)) as i from d0)),
vocab as (select c from c0 group by 1 having count(*)>=2), v as (select count(*)+1 as size from vocab),
t as (select id, string_agg(case when vocab.c is null then chr(1) else c0.c end, '' order by i) as x from c0 left join vocab on vocab.c=c0.c group by 1),
g5 as (select substring(x,k,5) as g, count(*) as n from (select x, unnest(range(1,length(x)-3)) as k from t where length(x)>=5) group by 1),
g4 as (select substring(g,2) as g, count(*) as n from g5 group by 1), g3 as (select substring(g,2) as g, count(*) as n from g4 group by 1), g2 as (select substring(g,2) as g, count(*) as n from g3 group by 1), g1 as (select substring(g,2) as g, count(*) as n from g2 group by 1),
grams as (select 5 as level, left(g,4) as ctx, right(g,1) as ch, n from g5 union all select 4, left(g,3), right(g,1), n from g4 union all select 3, left(g,2), right(g,1), n from g3 union all select 2, left(g,1), right(g,1), n from g2 union all select 1, '', g, n from g1),
contexts as (select level, ctx, sum(n) as total, count(*) as kinds from grams group by 1,2),
disc as (select level, case when count(*) filter (n=1)>0 then count(*) filter (n=1)/(count(*) filter (n=1)+2*count(*) filter (n=2)) else 0.5 end as d from grams group by 1)"""
#: Of rows q (k, pos, hist, ch) the logarithm of each share.
_KN_SCORE = """e as (select k, pos, hist, ch, l as level, right(hist,l-1) as ctx from q, (select unnest([1,2,3,4,5]) as l) where l-1<=length(hist)),
f as (select k, pos, e.level, coalesce(g.n,0) as n, c.total, c.kinds, d.d from e left join grams g on g.level=e.level and g.ctx=e.ctx and g.ch=e.ch left join contexts c on c.level=e.level and c.ctx=e.ctx join disc d on d.level=e.level),
w as (select k, pos, max(case when level=1 then d*kinds/total/(select size from v)+greatest(n-d,0)/total end) as p1, max(case when level=2 and total is not null then d*kinds/total end) as b2, max(case when level=2 and total is not null then greatest(n-d,0)/total end) as t2, max(case when level=3 and total is not null then d*kinds/total end) as b3, max(case when level=3 and total is not null then greatest(n-d,0)/total end) as t3, max(case when level=4 and total is not null then d*kinds/total end) as b4, max(case when level=4 and total is not null then greatest(n-d,0)/total end) as t4, max(case when level=5 and total is not null then d*kinds/total end) as b5, max(case when level=5 and total is not null then greatest(n-d,0)/total end) as t5 from f group by 1,2),
s as (select k, pos, ln((((p1*coalesce(b2,1)+coalesce(t2,0))*coalesce(b3,1)+coalesce(t3,0))*coalesce(b4,1)+coalesce(t4,0))*coalesce(b5,1)+coalesce(t5,0)) as logp from w)"""
#: Rows q of texts x after contexts c of the relation a (k, c, x).
_KN_PLACES = """m as (select k, length(x) as n, i, coalesce(vocab.c, chr(1)) as ch from (select k, x, y, unnest(range(1,length(y)+1)) as i from (select k, x, chr(2)||c||x as y from a)) z left join vocab on vocab.c=substring(y,i,1)),
y as (select k, any_value(n) as n, string_agg(ch,'' order by i) as y from m group by 1),
q as (select k, i as pos, substring(y, greatest(1, length(y)-n+1+i-4), length(y)-n+i-greatest(1, length(y)-n+1+i-4)+1) as hist, substring(y, length(y)-n+i+1, 1) as ch from (select k, n, y, unnest(range(0,n)) as i from y))"""


def _model(spark, d):
    return ng.train(Stage(table(spark, d, "seq").where("split = 'train'").select("id", "text").distinct(), "texts").df)


@query("agg28_kn", f"with {_KN} select level, count(*) as contexts, sum(kinds)::bigint as grams, sum(total)::bigint as total, round(any_value(d),9) as discount from contexts join disc using (level) group by 1")
def agg28_kn(spark, d):
    """Continuation counts, contexts and discounts of each order of the model."""
    return ng.summary(_model(spark, d)).withColumn("discount", F.round("discount", 9))


@query("sch03", f"with {_KN}, u as (select distinct item_id, coalesce(left_context,'') as c, unnest(answers) as x from eval_items), u1 as (select * from u where length(x)>0), lcp as (select item_id, len(list_filter(range(1, min(length(x))), lambda i: left(min(x),i)=left(max(x),i))) as common from u1 group by 1), a as (select item_id||chr(31)||x as k, c, x from u1), {_KN_PLACES}, {_KN_SCORE} select u1.item_id, x as candidate, count(*) as scored, round(sum(logp),6) as logp from s join u1 on s.k=item_id||chr(31)||x join lcp using (item_id) where pos>=common group by 1,2")
def sch03(spark, d):
    """The answers of each item by their likelihood after its context, without what all of them begin with."""
    e = table(spark, d, "eval_items").select("item_id", F.coalesce("left_context", F.lit("")).alias("left_context"), F.explode("answers").alias("answer"))
    return ng.suffix_scores(e, "item_id", "left_context", "answer", _model(spark, d)).withColumn("logp", F.round("logp", 6))


@query("sch04", f"with {_KN}, a as (select item_id as k, coalesce(left_context,'') as c, text as x from eval_items where length(text)>0), {_KN_PLACES}, {_KN_SCORE} select k as item_id, round(sum(logp),6) as score from s group by 1")
def sch04(spark, d):
    """Texts scored by five characters with discounts and back-off, after their contexts."""
    e = table(spark, d, "eval_items").where("length(text) > 0")
    model = _model(spark, d)
    asked = ng.places(e, "item_id", F.coalesce("left_context", F.lit("")), F.col("text"), model)
    return ng.log_shares(asked, "item_id", model).groupBy("item_id").agg(F.round(F.sum("logp"), 6).alias("score"))


def bigram_shares(spark, d, pairs):
    """Of the bigrams ``(ctx, ch)`` in ``pairs`` all that are counted, ``{ctx: {ch: share}}``; more than 800,000 are refused."""
    b = _lm(spark, d).join(pairs.distinct(), ["ctx", "ch"], "left_semi").select("ctx", "ch", (F.col("n") / F.col("total")).alias("p"))
    rows = b.limit(800_001).collect()
    if len(rows) > 800_000:
        raise ValueError("too many bigrams to be sent to the tasks")
    shares: dict[str, dict] = {}
    for r in rows:
        shares.setdefault(r[0], {})[r[1]] = r[2]
    return spark.sparkContext.broadcast(shares)


def bigrams_of(text):
    """A row ``(ctx, ch)`` for each bigram of a text, to be selected from."""
    g = F.transform(t.char_grams(text, 2), lambda g: F.struct(F.substring(g, 1, 1).alias("ctx"), F.substring(g, 2, 1).alias("ch")))
    return F.inline(g)


def _scorer(spark, d, order=3):
    """A model of three characters, counted over all training sequences, for the searches."""
    x = Stage(table(spark, d, "seq").where("split = 'train'").select("id", "text").distinct(), "texts").df
    return spark.sparkContext.broadcast(ng.in_memory(ng.train(x, order=order)))


def _listed(spark, d):
    """Words of two characters and more; a longer list is refused."""
    words = [r[0] for r in table(spark, d, "lexicon").where("length(word) >= 2").select("word").distinct().orderBy("word").limit(1_000_001).collect()]
    if len(words) > 1_000_000:
        raise ValueError("the lexicon is too large to be sent to the tasks")
    return words


def syllables(word: str) -> list[str]:
    """A stand-in for readings, which are a table of the user: a syllable of each character, by its code point."""
    heads, tails = ("b", "d", "g", "zh", "sh", "l", "n", "m"), ("a", "ai", "an", "ang", "o", "u")
    return [heads[ord(c) % 8] + tails[ord(c) // 8 % 6] for c in word]


def _texts(f):
    @F.pandas_udf("array<string>")
    def over(x: pd.Series) -> pd.Series:
        return pd.Series(f([v or "" for v in x]))

    return over


@query("sch01")
def sch01(spark, d):
    """Two words of the lexicon, drawn by the item, found again from the keys that spell them, the second by first letters only."""
    words, scorer = _listed(spark, d), _scorer(spark, d)
    pick = lambda item, n: words[draw(len(words), item, n)]

    @F.pandas_udf("array<struct<text:string,right:boolean>>")
    def over(items_: pd.Series, contexts: pd.Series) -> pd.Series:
        index = search.KeyIndex([(w, syllables(w)) for w in words])
        out = []
        for item, context in zip(items_, contexts, strict=True):
            a, b = pick(item, 1), pick(item, 2)
            keys = "".join(syllables(a)) + "".join(x[:1] for x in syllables(b))
            out.append([{"text": x, "right": x == a + b} for x, _ in search.typed(scorer.value, index, keys, context or "", 32, 5)])
        return pd.Series(out)

    x = table(spark, d, "eval_items").select("item_id", F.posexplode(over("item_id", "left_context")).alias("rank", "x"))
    return x.select("item_id", "rank", "x.text", "x.right")


@query("sch02")
def sch02(spark, d):
    """The likeliest words after each context, its last word healed, none a start of another."""
    words, scorer = _listed(spark, d), _scorer(spark, d)
    f = _texts(lambda contexts: [[w for w, _ in own] for own in search.predicted_words(scorer.value, contexts, words, 5)])
    return table(spark, d, "eval_items").select("item_id", F.posexplode(f("left_context")).alias("rank", "word"))


@query("sch05")
def sch05(spark, d):
    """Typing each item: words end at the segments of the lexicon, a character costs its syllable, and predictions of two
    characters and more are offered after each commit."""
    words, scorer = _listed(spark, d), _scorer(spark, d)

    @F.pandas_udf("struct<pressed:int,plain:int,offers:int,taken:int>")
    def over(x: pd.Series) -> pd.DataFrame:
        book = frozenset(words)
        longest = max(map(len, words), default=1)
        rows = []
        for text in x:
            text, ends = text or "", []
            for piece in greedy_phrases(text, book, longest):
                ends.append((ends[-1] if ends else 0) + len(piece))
            offer = lambda at, text=text: [y for n in (2, 3) for y in search.continuations(scorer.value, [text[:at]], n, 2)[0]]
            rows.append(search.simulate(text, [len(s) for s in syllables(text)], ends, offer, -6.0))
        return pd.DataFrame(rows, columns=["pressed", "plain", "offers", "taken"])

    return table(spark, d, "eval_items").select("item_id", over("text").alias("s")).select("item_id", "s.*")


@query("sch06")
def sch06(spark, d):
    """Continuations of eight characters: greedy, by a beam of four, and drawn."""
    scorer = _scorer(spark, d)

    def three(contexts):
        greedy = search.continuations(scorer.value, contexts, 8, 1)
        beams = search.continuations(scorer.value, contexts, 8, 4)
        return [[g[0][0], b[0][0], search.sampled(scorer.value, c, 8, 0.8, 42)] for g, b, c in zip(greedy, beams, contexts, strict=True)]

    x = table(spark, d, "eval_items").select("item_id", F.posexplode(_texts(three)("left_context")).alias("k", "continuation"))
    return x.select("item_id", F.element_at(F.array(*[F.lit(v) for v in ("greedy", "beam", "drawn")]), F.col("k") + 1).alias("how"), "continuation")


# ---- reports


@query("rpt01", f"select item, coalesce(b_engine=1,false) as was, coalesce(b_model=1,false) as \"is\" from {_ITEMS} where coalesce(b_engine=1,false)<>coalesce(b_model=1,false)")
def rpt01(spark, d):
    return rk.changes(best(spark, d, "engine"), best(spark, d, "model"), "item")


_DECIDED = "(select o_orderkey as item, case when o_totalprice>200000 then 'accepted' else 'rejected' end as decision from orders where o_orderkey%3=0)"


@query("rpt02", f"select source, size_class, context, count(*) as errors, count(*) filter (decision='accepted') as accepted, count(*) filter (decision='rejected') as rejected, count(*) filter (decision is null) as undecided, count(*) filter (b_pool is null) as absent from (select i.*, case when size<=2 then 'small' when size<=5 then 'medium' else 'large' end as size_class, decision from {_ITEMS} i left join {_DECIDED} using (item) where coalesce(b_model<>1,true)) group by 1,2,3")
def rpt02(spark, d):
    """Errors by source, size of the pool and context, with what people decided on them side by side."""
    o = table(spark, d, "orders").where("o_orderkey % 3 = 0")
    decisions = o.select(F.col("o_orderkey").alias("item"), F.when(F.col("o_totalprice") > 200000, "accepted").otherwise("rejected").alias("decision"))
    x = items(spark, d).where(F.coalesce(F.col("b_model") != 1, F.lit(True))).withColumn("size_class", t.length_bucket(F.col("size"), [(2, "small"), (5, "medium")], "large"))
    wide = rk.breakdown(x, decisions, "item", ["source", "size_class", "context"], "decision", ["accepted", "rejected"])
    absent = x.groupBy("source", "size_class", "context").agg(F.count_if(F.col("b_pool").isNull()).alias("absent"))
    return wide.join(absent, ["source", "size_class", "context"])


@query("rpt03", f"select item, min(case when correct or cand%50=0 then r_model end) as best from {_RANKED} where item%97<>0 group by 1")
def rpt03(spark, d):
    """Labels with added references and a quarantine, ranked again in the frozen order."""
    x = ranked(spark, d).where("item % 97 <> 0").withColumn("correct", F.col("correct") | (F.col("cand") % 50 == 0)).withColumn("rank", F.col("r_model"))
    return rk.gold_rank(x, "item").select("item", "best")


_LEX = lambda x: f"regexp_replace(lower(nfc_normalize({x})),'[\\p{{P}}\\p{{S}}\\s]','','g')"


@query("rpt04", f"with a as (select item_id, answers, unnest(range(1,len(answers)+1)) as pos from eval_items), p as (select item_id, pos, answers[pos] as cand, answers[1] as gold from a), r as (select item_id, min(case when cand=gold then pos end) as strict, min(case when {_LEX('cand')}={_LEX('gold')} then pos end) as lenient, count(distinct case when {_LEX('cand')}={_LEX('gold')} and cand<>gold then cand end) as added from p group by 1) select item_id, strict, lenient, added from r")
def rpt04(spark, d):
    """How much depends on the labels: candidates that equal the first answer but for case, width and punctuation count as right too, and
    the first right place is found again."""
    e = table(spark, d, "eval_items").select("item_id", F.col("answers")[0].alias("gold"), F.posexplode("answers").alias("pos", "cand"))
    bare = lambda c: F.regexp_replace(F.lower(t.nfc(F.col(c))), r"[\p{P}\p{S}\s]", "")
    x = e.select("item_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "cand", (F.col("cand") == F.col("gold")).alias("same"), (bare("cand") == bare("gold")).alias("like"))
    return rk.label_sensitivity(x, "item_id", "pos", "cand", "same", "like")


@query("rpt05", f"select source, context, count(*) as pairs, count(*) filter (a and not b) as gain, count(*) filter (b and not a) as loss from (select source, context, coalesce(b_model=1,false) as a, coalesce(b_engine=1,false) as b from {_ITEMS}) group by grouping sets ((),(source),(context),(source,context))")
def rpt05(spark, d):
    a, b = F.coalesce(F.col("b_model") == 1, F.lit(False)), F.coalesce(F.col("b_engine") == 1, F.lit(False))
    x = items(spark, d).select("source", "context", a.alias("a"), b.alias("b"))
    return x.groupingSets([[], ["source"], ["context"], ["source", "context"]], "source", "context").agg(F.count("*").alias("pairs"), F.count_if(F.col("a") & ~F.col("b")).alias("gain"), F.count_if(F.col("b") & ~F.col("a")).alias("loss"))


@query("rpt06", f"select method, track, count(*) as cases, count(*) filter (b=1) as top1 from (select unnest(['pool','engine','model']) as method, source as track, unnest([b_pool,b_engine,b_model]) as b from {_ITEMS}) group by 1,2")
def rpt06(spark, d):
    m = F.explode(F.create_map(*[x for n in ("pool", "engine", "model") for x in (F.lit(n), F.col(f"b_{n}"))])).alias("method", "b")
    return items(spark, d).select(F.col("source").alias("track"), m).groupBy("method", "track").agg(F.count("*").alias("cases"), F.count_if(F.col("b") == 1).alias("top1"))


@query("rpt08", f"""with d as (select doc_id, source, text, lower(text) as low from documents where text is not null), h as (select doc_id, source, text, k, unnest(list_filter(range(1, length(low)+1), lambda i: substring(low, i, length(k))=k)) as p from d, (select unnest(['バッテリー','workshop']) as k) where contains(low, k))
select doc_id, term, p as at, left_, right_ from (select doc_id, k as term, p, substring(text, greatest(1,p-40), p-greatest(1,p-40)) as left_, substring(text, p+length(k), 40) as right_, row_number() over (partition by k order by sha256('kwic:'||doc_id||':'||p), doc_id, p) as r from h) where r<=40""")
def rpt08(spark, d):
    """Every occurrence of each term with 40 characters to both sides; of each term up to 40 by hash."""
    hits = rk.keyword_in_context(table(spark, d, "documents"), "doc_id", "text", ["バッテリー", "workshop"])
    h = F.sha2(F.concat(F.lit("kwic:"), F.col("doc_id").cast("string"), F.lit(":"), F.col("at").cast("string")), 256)
    return dd.top(hits.withColumn("h", h), ["term"], [F.col("h"), F.col("doc_id"), F.col("at")], 40, "r").select("doc_id", "term", F.col("at").cast("bigint").alias("at"), "left_", "right_")


_SPAN = "from_json(spans,'[{\"block_id\":\"VARCHAR\",\"start\":\"INTEGER\",\"end\":\"INTEGER\"}]')"


@query("rpt09", f"""with c as (select 'seq' as store, unnest(['starts','ends','pairs','known_split']) as "check", unnest([tokens[1]=2, tokens[-1]=3, pairs=len(tokens)-1, split in ('train','validation','test')]) as ok from seq
union all select 'units', unnest(['spans_in_order','spans_not_empty','known_content']), unnest([coalesce(list_bool_and(list_transform(range(1,len(s)), lambda i: s[i].block_id<=s[i+1].block_id)), true), coalesce(list_bool_and(list_transform(s, lambda x: x."end">x.start)), true), doc_hash in (select doc_hash from contents where doc_hash is not null)]) from (select doc_hash, {_SPAN} as s from units where spans is not null))
select store, "check", count(*) as rows, count(*) filter (not coalesce(ok,false)) as failed from c group by 1,2""")
def rpt09(spark, d):
    """An audit of what is stored: sequences, and the spans of units; each check with the rows it saw and those that fail."""
    s = table(spark, d, "seq")
    stored = rk.audit(s, {"starts": F.col("tokens")[0] == 2, "ends": F.element_at("tokens", -1) == 3, "pairs": F.col("pairs") == F.size("tokens") - 1, "known_split": F.col("split").isin("train", "validation", "test")})
    known = table(spark, d, "contents").select("doc_hash", F.lit(True).alias("known")).where("doc_hash is not null").distinct()
    u = table(spark, d, "units").where("spans is not null").select("doc_hash", F.from_json("spans", "array<struct<block_id:string,start:int,end:int>>").alias("s")).join(known, "doc_hash", "left")
    ids = F.transform("s", lambda x: x["block_id"])
    spans = rk.audit(u, {"spans_in_order": ids == F.array_sort(ids), "spans_not_empty": F.forall("s", lambda x: x["end"] > x["start"]), "known_content": F.coalesce("known", F.lit(False))})
    return stored.withColumn("store", F.lit("seq")).unionByName(spans.withColumn("store", F.lit("units")))


@query("rpt09_packet", f"select id, stratum, k from (select *, row_number() over (partition by stratum order by sha256('review:'||id), id) as k from (select distinct id, split||':'||pool as stratum from seq)) where k<=10")
def rpt09_packet(spark, d):
    """The packet for review: of each split and pool ten sequences by hash."""
    s = table(spark, d, "seq").select("id", F.concat_ws(":", "split", "pool").alias("stratum")).distinct()
    h = F.sha2(F.concat(F.lit("review:"), F.col("id").cast("string")), 256)
    return dd.top(s.withColumn("h", h), ["stratum"], [F.col("h"), F.col("id")], 10, "k").select("id", "stratum", "k")


_SINGLE = r"[^\p{Han}\p{Katakana}ー](?:\p{Han})(?:を|が|は|に)"
_LEFTOVER = r"(?:\p{Han}{2,}\p{Hiragana}?\p{Han})(?:を|が|は|に)"


@query("rpt10", rf"select distinct id, case when regexp_matches('、'||text,'{_SINGLE}') and regexp_matches(text,'{_LEFTOVER}') then 'both' when regexp_matches('、'||text,'{_SINGLE}') then 'single' when regexp_matches(text,'{_LEFTOVER}') then 'boundary' else 'clear' end as quarantine from seq where text is not null")
def rpt10(spark, d):
    """What is ambiguous goes to quarantine, with the rule: a noun of one Han letter alone before a particle, or a last Han letter at
    the border of a compound."""
    spelled = lambda p: p.replace(r"\p{Han}", r"\p{IsHan}").replace(r"\p{Katakana}", r"\p{IsKatakana}").replace(r"\p{Hiragana}", r"\p{IsHiragana}")
    s = table(spark, d, "seq").where("text is not null").select("id", "text").distinct()
    rules = {"single": F.concat(F.lit("、"), "text").rlike(spelled(_SINGLE)), "boundary": F.col("text").rlike(spelled(_LEFTOVER))}
    return rk.quarantined(s, rules).select("id", "quarantine").distinct()

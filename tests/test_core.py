"""Operators and functions against plain Python, and properties that must hold for any input."""

import random
import re
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings, strategies as hs
from pyspark.sql import functions as F

from corpusmill.functions import keys, segment
from corpusmill.functions import text as t
from corpusmill.functions.fold import code_points, fold, fold_many, gram_keys, inside
from corpusmill.operators import annotations as ann
from corpusmill.operators import dedup as dd
from corpusmill.operators import documents
from corpusmill.operators import joins as jn
from corpusmill.operators import sequences as sq
from corpusmill.operators import statistics as st
from corpusmill.operators.components import connected_components
from corpusmill.runtime import Stage, comparable
from corpusmill.sources import readers, sinks


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("finish", [200_000, 5])
def test_components_of_chains_stars_and_cycles(spark, finish):
    random.seed(1)
    names = [f"{i:04d}" for i in range(1500)]
    random.shuffle(names)
    edges = [(names[i], names[i + 1]) for i in range(1499) if i % 41] + [("hub", f"leaf{i}") for i in range(800)] + [("x", "y"), ("y", "z"), ("z", "x"), ("self", "self"), (None, "x"), ("x", None)]
    df = spark.createDataFrame(edges * 2, "a string, b string").repartition(6)
    assert dict(map(tuple, connected_components(df, finish_rows=finish).collect())) == union_find(edges)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


@settings(max_examples=80, deadline=None)
@given(hs.lists(hs.one_of(hs.none(), hs.text(max_size=20)), max_size=8))
def test_folding_many_is_folding_each(texts):
    plain = lambda x: re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", x or "").lower())
    assert fold_many(texts) == [plain(x) for x in texts] == [fold(x) for x in texts]


@settings(max_examples=80, deadline=None)
@given(hs.lists(hs.text("ab", max_size=9), max_size=6), hs.integers(1, 5))
def test_positions_inside_texts(texts, k):
    points, offsets = code_points(texts)
    key = gram_keys(points, k)
    ok = inside(offsets, k, len(key))
    assert [i for i in range(len(key)) if ok[i]] == [int(offsets[j]) + s for j, x in enumerate(texts) for s in range(len(x) - k + 1)]


def test_alnum_is_letters_and_numbers():
    assert all((unicodedata.category(chr(c))[0] in "LN") == chr(c).isalnum() for c in range(0x110000))


def test_text_columns(spark):
    rows = [(1, "  a\r\nb 　"), (2, None), (3, ""), (4, "★ タイトル ★"), (5, "https://x.example/a"), (6, "----"), (7, "文。Next"), (8, "壊�")]
    df = spark.createDataFrame(rows, "id int, x string")
    got = {r["id"]: (r["b"]["action"], r["b"]["reason"]) for r in df.select("id", t.clean_block(F.col("x")).alias("b")).collect()}
    assert got == {1: ("keep", ""), 2: ("drop", "empty"), 3: ("drop", "empty"), 4: ("keep", ""), 5: ("drop", "url"), 6: ("drop", "decoration"), 7: ("review", "glued"), 8: ("review", "broken")}
    url = spark.createDataFrame([("HTTPS://User@Host.Example#x",), ("http://a.b/C?d=E#f",), ("ftp://a/b",), (None,), ("",)], "u string")
    assert [r[0] for r in url.select(t.canonical_url(F.col("u"))).collect()] == ["https://user@host.example/", "http://a.b/C?d=E", None, None, None]
    lines = spark.createDataFrame([("a\na\nbb",), (None,), ("\n\n",), ("x" * 50_000 + "\n" + "x" * 50_000,)], "x string")
    assert [r[0] for r in lines.select(t.repeated_line_fraction(F.col("x"))).collect()] == [0.5, 0.0, 0.0, 1.0]


@settings(max_examples=25, deadline=None)
@given(hs.lists(hs.text("ab\n ", max_size=12), min_size=1, max_size=5), hs.integers(1, 4))
def test_grams_against_slices(spark, texts, n):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id int, x string")
    got = {r["id"]: r["g"] for r in df.select("id", t.char_grams(F.col("x"), n).alias("g")).collect()}
    assert got == {i: [x[k : k + n] for k in range(len(x) - n + 1)] for i, x in enumerate(texts)}


def test_sentences():
    s = lambda x: [p[0] for p in segment.split_sentences(x)]
    assert s("一つ。二つ!?三つ") == ["一つ。", "二つ!?", "三つ"]
    assert s("「中。外」続き。次") == ["「中。外」続き。", "次"]
    assert s("見て https://a.example/?q=1!x です。終") == ["見て https://a.example/?q=1!x です。", "終"]
    assert s("詳しくは https://a.example/x。次の文です。終わり。") == ["詳しくは https://a.example/x。", "次の文です。", "終わり。"]
    assert segment.split_sentences("開いた「まま\n次")[0][4] == ["unclosed_bracket"] and segment.split_sentences("閉じ」た。")[0][4] == ["unmatched_closing_bracket"]
    assert [x[3] for x in segment.split_sentences("彼は「行く。」")] == [True] and [x[3] for x in segment.split_sentences("彼は「行く」")] == [False]
    assert segment.split_sentences(None) == [] == segment.split_sentences(" \n ")


@settings(max_examples=150, deadline=None)
@given(hs.text("あ「」。!\n a", max_size=40))
def test_sentence_offsets(text):
    last = 0
    for body, start, end, _, _ in segment.split_sentences(text):
        assert text[start:end] == body == body.strip() and start >= last
        last = end
    kept = "".join(p[0] for p in segment.split_sentences(text))
    assert re.sub(r"\s", "", kept) == re.sub(r"\s", "", text)


@settings(max_examples=100, deadline=None)
@given(hs.lists(hs.text("あが、。「」", max_size=8), max_size=8))
def test_restored_lines_keep_every_part(lines):
    seen = []
    for p in segment.restore_linebreaks(segment.lines_as_blocks("\n".join(lines)), 30):
        for name, start, end in p["parts"]:
            assert p["text"][start:end] == lines[int(name[1:])].strip()
            seen.append(int(name[1:]))
        assert len(p["joins"]) == len(p["parts"]) - 1 and len(p["text"]) <= max(30, max(map(len, lines)))
    assert seen == [i for i, x in enumerate(lines) if x.strip()]


@settings(max_examples=150, deadline=None)
@given(hs.lists(hs.text("あ「」（）。 ", min_size=1, max_size=6), min_size=1, max_size=6))
def test_brackets_that_close_ahead_against_rescanning(lines):
    blocks = segment.lines_as_blocks("\n".join(lines))
    left = lines[0].strip()

    def again():
        text = left
        for _, _, line, _ in blocks[1:]:
            if not line.strip() or segment.LIST_ITEM.match(line.strip()):
                return False
            text += line.strip()
            flags = {f for *_, x in segment.split_sentences(text) for f in x}
            if not flags:
                return True
            if "unmatched_closing_bracket" in flags:
                return False
        return False

    if left and len(blocks) > 1:
        assert segment.closes_ahead(left, blocks, 1) == again()


def test_joins_of_lines():
    j = segment.join_reason
    assert j("彼は「そう", "全く閉じない") is None and j("彼は「そう", "言った」。") == "unclosed_bracket"
    assert j("・項目、", "続き") is None and j("一行目、", "・項目") is None and j("一行目、", "続き") == "trailing_comma"
    assert j("終わり。", "次") is None and j("走りながら", "歌う") == "continuation_suffix" and j("山", "について話す") == "continuation_prefix" and j("", "x") is None
    blocks = lambda *x: [(f"b{i}", i, y, "keep") for i, y in enumerate(x)]
    three = segment.restore_linebreaks(blocks("彼は「そう", "思うと", "言った」と。"))
    assert [p["text"] for p in three] == ["彼は「そう思うと言った」と。"] and [x[2] for x in three[0]["joins"]] == ["unclosed_bracket"] * 2
    assert three[0]["parts"] == [("b0", 0, 5), ("b1", 5, 8), ("b2", 8, 14)]
    apart = segment.restore_linebreaks(blocks("一行目、", "続き"), decisions={("b0", "b1"): "separate"})
    joined = segment.restore_linebreaks(blocks("一行目。", "Next", "word"), decisions={("b0", "b1"): "join", ("b1", "b2"): "join"})
    assert len(apart) == 2 and [p["text"] for p in joined] == ["一行目。Next word"] and joined[0]["joins"][0][2] == "approved_annotation"
    assert len(segment.restore_linebreaks([("a", 0, "一行目、", "keep"), ("b", 2, "続き", "keep")])) == 2
    assert len(segment.restore_linebreaks([("a", 0, "一行目、", "keep"), ("b", 1, "x", "drop"), ("c", 2, "続き", "keep")])) == 2
    long = segment.restore_linebreaks(blocks("長い行、", "続き"), max_chars=5)
    assert [p["text"] for p in long] == ["長い行、", "続き"] and long[0]["flags"] == ["join_length_limit"]
    for bad in ([("a", 1, "x", "keep"), ("b", 1, "y", "keep")], [("a", 0, "x", "what")], [("a", -1, "x", "keep")]):
        with pytest.raises(ValueError):
            segment.restore_linebreaks(bad)
    for bad in (dict(decisions={("b0", "b1"): "maybe"}), dict(decisions={("b0", "b1"): "join"}, max_chars=4)):
        with pytest.raises(ValueError):
            segment.restore_linebreaks(blocks("一行目、", "続き"), **bad)


def test_a_whole_document(spark):
    text = "見出しのない本文が、\nここで続く。\nhttps://x.example/a\n文。Next\n「開いたまま\n\n終わらない\n----\n残る文。"
    docs = spark.createDataFrame([("d", text), ("e", None), ("f", "")], "doc_hash string, text string")
    done = Stage(documents.process(docs)).df
    got = {(r["paragraph_index"], r["sentence_index"]): (r["text"], r["spans"]) for r in documents.units(done).collect()}
    assert got == {(0, 0): ("見出しのない本文が、ここで続く。", '[{"block_id":"b000","start":0,"end":10},{"block_id":"b001","start":0,"end":6}]'), (3, 0): ("残る文。", '[{"block_id":"b008","start":0,"end":4}]')}
    left = {r["text"]: (r["terminated"], r["flags"]) for r in documents.fragments(done).collect()}
    assert left == {"「開いたまま": (False, "unclosed_bracket"), "終わらない": (False, "")}
    n = {r["metric"]: r["n"] for r in documents.merged_metrics(documents.document_metrics(done)).collect()}
    assert (n["unique_documents"], n["input_blocks"], n["keep_blocks"], n["drop_blocks"], n["review_blocks"], n["paragraphs"], n["join_events"], n["sentence_occurrences"], n["fragments"]) == (2, 10, 5, 4, 1, 4, 1, 2, 2)
    assert (n["rule:url"], n["rule:glued"], n["flag:unclosed_bracket"]) == (1, 1, 1)
    label = lambda i, kind, **more: (i, "d", kind, more.get("action"), more.get("text"), more.get("block"), more.get("left"), more.get("right"), more.get("spans"))
    labels = [label("1", "block", action="keep", text="文。Next", block="b003"), label("2", "fragment", action="keep", text="終わらない", spans='[{"block_id":"b006","start":0,"end":5}]'), label("3", "boundary", action="separate", left="b000", right="b001"), label("4", "fragment", action="drop", text="残る文。", spans='[{"block_id":"b008","start":0,"end":4}]')]
    frame = lambda x: spark.createDataFrame(x, documents.LABELS)
    texts = {r["text"]: r["annotation_ids"] for r in documents.units(documents.process(docs, frame(labels))).collect()}
    assert texts == {"ここで続く。": "[]", "文。": '["1"]', "終わらない": '["2"]'}
    for bad in (label("5", "block", action="drop", text="別の文", block="b000"), label("6", "fragment", action="keep", text="無い", spans="[]"), label("7", "boundary", action="join", left="b000", right="b005"), label("8", "what")):
        with pytest.raises(Exception, match="label"):
            documents.process(docs, frame([bad])).collect()


def test_syllables_of_long_keys_take_linear_time():
    import time

    valid = frozenset({"a", "an", "nab", "ba"})
    began = time.time()
    assert not keys.splits_to_syllables("an" * 5000 + "x", valid) and keys.splits_to_syllables("an" * 5000, valid)
    assert time.time() - began < 0.2


def test_keys():
    valid = frozenset({"ni", "hao", "ha", "o"})
    assert keys.splits_to_syllables("nihao", valid) and not keys.splits_to_syllables("nihx", valid) and not keys.splits_to_syllables("", valid)
    assert "nihao" in keys.repairs("nihso", valid) and keys.repairs("", frozenset()) == []
    assert keys.majority(["a", "b", "b"]) == ("b", False) and keys.majority([None, None]) == (None, False)
    for kind in ("substitute", "delete", "insert", "transpose"):
        assert keys.mistype("nihao", kind, 1) == keys.mistype("nihao", kind, 1)
    assert keys.spell(["ni", "hao"], "initials") == "nh" and keys.fuzzy("zhang") == ["zang", "zhan"]


@settings(max_examples=150, deadline=None)
@given(hs.text("abn", max_size=9))
def test_syllables_against_a_dynamic_program(text):
    valid = frozenset({"a", "an", "nab", "ba"})
    ends = {0}
    for i in range(1, len(text) + 1):
        ends |= {i for k in range(i) if k in ends and text[k:i] in valid}
    assert keys.splits_to_syllables(text, valid) == (bool(text) and len(text) in ends)


def test_dictionary_paths_against_all_segmentations():
    book = segment.Dictionary([("ab", "", 50.0), ("a", "", 3.0), ("b", "", 2.0), ("ba", "", 9.0)])
    assert book.segment("abba") == ["ab", "ba"] == book.paths("abba", 4)[0][1] and book.segment("") == []
    assert len(book.paths("abba", 100)) == 4 and [s for s, _ in book.paths("abba", 100)] == sorted((s for s, _ in book.paths("abba", 100)), reverse=True)


def test_joins_against_loops(spark):
    random.seed(3)
    texts = [(i, "".join(random.choices("abc", k=random.randrange(0, 60)))) for i in range(80)] + [(99, None)]
    items = [(i, "".join(random.choices("abc", k=random.randrange(0, 7)))) for i in range(30)] + [(77, None)]
    a, b = spark.createDataFrame(texts, "k int, x string"), spark.createDataFrame(items, "i int, p string")
    expected = {(k, i) for k, x in texts for i, p in items if x is not None and p and p in x}
    assert {tuple(r) for r in jn.contained(a, "k", "x", b, "i", "p").collect()} == expected
    assert {tuple(r) for r in jn.anchor_join(a, "k", "x", b, "i", "p", 3).collect()} == {(k, i) for k, i in expected if len(dict(items)[i]) >= 3}
    grams = lambda x: {x[i : i + 3] for i in range(len(x) - 2)} if x else set()
    pairs = {(k, m) for k, x in texts for m, y in texts if k < m and grams(x) and grams(y) and len(grams(x) & grams(y)) >= 0.6 * len(grams(x) | grams(y))}
    assert {(r["a"], r["b"]) for r in jn.gram_jaccard(a, "k", "x", 3, 0.6).collect()} == pairs
    iv = [(random.randrange(3), s, s + random.randrange(-2, 20)) for s in (random.randrange(200) for _ in range(60))]
    got = {r["g"]: r["covered"] for r in jn.union_length(spark.createDataFrame(iv, "g int, s int, e int"), "s", "e", "g").collect()}
    assert got == {g: len({x for h, s, e in iv if h == g for x in range(s, e)}) for g in {g for g, s, e in iv if e > s}}


def test_ranks_and_sums_over_buckets(spark):
    values = [(i, random.Random(i).randrange(1000)) for i in range(500)]
    df = spark.createDataFrame(values, "id int, v int")
    ranked = dd.global_rank(df, ["v", "id"])
    order = sorted(values, key=lambda x: (x[1], x[0]))
    assert {r["id"]: r["rank"] for r in ranked.collect()} == {i: k + 1 for k, (i, _) in enumerate(order)}
    summed = dd.running_total(df, "v", ["v", "id"])
    assert max(r["running"] for r in summed.collect()) == sum(v for _, v in values)
    grouped = df.withColumn("g", F.when(F.col("id") % 3 > 0, F.col("id") % 3))
    expected = {}
    for g in (None, 1, 2):
        own = sorted(((v, i) for i, v in values if (i % 3 or None) == g), key=lambda x: (-x[0], x[1]))
        expected |= {i: k + 1 for k, (_, i) in enumerate(own)}
    assert {r["id"]: r["rank"] for r in dd.global_rank(grouped, [F.desc("v"), F.col("id")], ["g"]).collect()} == expected


def test_windows_predict_every_pair_once(spark):
    lengths = [1, 2, 3, 16, 17, 18, 33, 34, 129]
    df = spark.createDataFrame([(n, list(range(n))) for n in lengths], "id int, tokens array<int>")
    seen = {}
    for r in sq.windows(df, 16).collect():
        for i in range(r["start"], r["start"] + r["len"] - 1):
            seen[r["id"], i] = seen.get((r["id"], i), 0) + 1
    assert seen == {(n, i): 1 for n in lengths for i in range(n - 1)}
    x, y = sq.shifted(F.col("tokens"), 2)
    assert all(len(r[0]) == len(r[1]) == r[2] - 1 for r in df.select(x, y, F.size("tokens")).collect())


def test_packing_cost_is_the_least():
    from itertools import product

    random.seed(7)
    for _ in range(30):
        lengths = sorted((random.randrange(1, 12) for _ in range(random.randrange(1, 8))), reverse=True)

        def cost(ends):
            total, at = 0, 0
            for e in ends:
                wide = lengths[at] * (e - at)
                if wide > 24 and e - at > 1:
                    return None
                total += wide - sum(lengths[at:e]) + 5
                at = e
            return total

        n = len(lengths)
        options = [[i + 1 for i in range(n - 1) if cuts[i]] + [n] for cuts in product([0, 1], repeat=n - 1)]
        assert cost(sq.packing_cost(lengths, 24, 5)) == min(c for c in map(cost, options) if c is not None)


def test_splitmix_is_the_published_sequence():
    assert int(sq.splitmix(np.array([0], np.uint64), 0)[0]) == 0xE220A8397B1DCDAF


def test_statistics(spark):
    from math import comb

    df = spark.createDataFrame([(g, l) for g in range(8) for l in range(8)], "g bigint, l bigint")
    for r in df.select("g", "l", st.mcnemar(F.col("g"), F.col("l")).alias("p")).collect():
        n, k = r["g"] + r["l"], min(r["g"], r["l"])
        assert abs(r["p"] - (min(1, 2 * sum(comb(n, i) for i in range(k + 1)) / 2**n) if n else 1)) < 1e-9
    tests = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "name string, p double")
    assert {r["name"]: round(r["adjusted"], 6) for r in st.holm(tests, "name", "p").collect()} == {"a": 0.04, "c": 0.09, "b": 0.09, "d": 0.5}


def test_refusals(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, x string")
    with pytest.raises(Exception, match="not unique"):
        ann.require_unique(df, "k").collect()
    labels = spark.createDataFrame([(1, "other", "drop")], "k int, snapshot string, action string")
    with pytest.raises(Exception, match="another text"):
        ann.apply_labels(df, labels, ["k"], "x").collect()


def test_readers_refuse(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('1\tjpn\t"literal\n2\teng\tx\n', encoding="utf-8")
    with pytest.raises(Exception, match="wrong language"):
        readers.sentence_tsv(spark, str(tmp_path / "a.tsv")).collect()
    (tmp_path / "b.tsv").write_text('﻿1\tjpn\t"literal\n', encoding="utf-8")
    assert readers.sentence_tsv(spark, str(tmp_path / "b.tsv")).collect() == [("1", '"literal')]
    (tmp_path / "r.toml").write_text('[rules]\nweak = ["x"]\n[categories]\na = ["y"]\n', encoding="utf-8")
    with pytest.raises(ValueError, match="without category"):
        readers.rules(str(tmp_path / "r.toml"))
    spark.range(3).write.parquet(str(tmp_path / "once"))
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_once(spark.range(3), str(tmp_path / "once"))


def test_stages_and_comparable_columns(spark):
    df = spark.range(10).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    assert comparable(df) == ["id"]
    stage = Stage(df.select("id"))
    assert stage.rows == 10 and stage.df.count() == 10
    stage.drop()


def test_near_items_with_an_edit_at_the_start(spark, tmp_path):
    from difflib import SequenceMatcher

    from corpusmill.plans.registry import QUERIES

    rng = random.Random(5)
    rows = []
    for k in range(30):
        x = "".join(rng.choice("あいうえおかきくけこさしすせそ漢字") for _ in range(rng.randrange(1, 40)))
        rows += [("s", 4 * k, x), ("s", 4 * k + 1, "前" + x), ("s", 4 * k + 2, x[1:]), ("o", 4 * k + 3, x[:2] + "々" + x[3:])]
    rows += [("s", 900, ""), ("s", 901, ""), ("s", 902, None)]
    spark.createDataFrame(rows, "suite string, item_id bigint, text string").write.parquet(str(tmp_path / "eval_items.parquet"))
    got = {(r[0], r[1]) for r in QUERIES["txt26"](spark, str(tmp_path)).collect()}
    assert got == {(i, j) for s, i, x in rows for u, j, y in rows if s == u and i < j and None not in (x, y) and SequenceMatcher(None, x, y, autojunk=False).ratio() >= 0.85}


def test_scores_know_every_counted_bigram(spark, tmp_path):
    """The fifth and sixth follower of a character, in words and in answers."""
    import math

    from corpusmill.plans.registry import QUERIES

    seq = [(100 * k + i, "train", "か" + c) for k, (c, n) in enumerate(zip("さしすせそた", range(12, 0, -2), strict=True)) for i in range(n)]
    spark.createDataFrame(seq, "id bigint, split string, text string").write.parquet(str(tmp_path / "seq.parquet"))
    spark.createDataFrame([(w,) for w in ("かた", "かそ", "かん", "かあ")], "word string").write.parquet(str(tmp_path / "lexicon.parquet"))
    spark.createDataFrame([(1, "", ["かた", "かそ"]), (2, None, ["かん"])], "item_id bigint, left_context string, answers array<string>").write.parquet(str(tmp_path / "eval_items.parquet"))
    words = {(r[0], r[1]): r[2] for r in QUERIES["sch02"](spark, str(tmp_path)).collect()}
    assert words == {(i, k): w for i in (1, 2) for k, w in enumerate(["かそ", "かた", "かあ", "かん"])}
    scores = {r["answer"]: r["score"] for r in QUERIES["udf01"](spark, str(tmp_path)).collect()}
    assert scores == {"かた": round(math.log(2 / 42), 6), "かそ": round(math.log(4 / 42), 6), "かん": round(math.log(1e-6), 6)}


def test_paths_cover_the_whole_context(spark, tmp_path):
    from corpusmill.plans.registry import QUERIES

    spark.createDataFrame([("かな", 5.0), ("漢字", 4.0)], "word string, weight double").write.parquet(str(tmp_path / "lexicon.parquet"))
    text = "漢字かな" * 10
    spark.createDataFrame([(1, text), (2, None)], "item_id bigint, left_context string").write.parquet(str(tmp_path / "eval_items.parquet"))
    rows = QUERIES["top05"](spark, str(tmp_path)).collect()
    assert [r["rank"] for r in rows] == [0, 1, 2] and {r["path"].replace("|", "") for r in rows} == {text}


def test_diverse_names_after_many_alike(spark, tmp_path):
    from corpusmill.plans.registry import QUERIES

    rows = [(k, "B", f"same{k}") for k in range(250)] + [(300 + k, "B", f"n{k % 6}xx{k}") for k in range(12)]
    spark.createDataFrame(rows, "p_partkey bigint, p_brand string, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    got = sorted((r["pos"], r["name"]) for r in QUERIES["top04"](spark, str(tmp_path)).collect())
    assert got == [(0, "same0"), (1, "n0xx0"), (2, "n1xx1"), (3, "n2xx2"), (4, "n3xx3")]


def test_items_unlike_those_picked_before(spark, tmp_path):
    """A text of the same characters in another order is kept; one with most trigrams in common is not."""
    from corpusmill.plans.registry import QUERIES

    rows = [("s", 1, "あいうえおかきくけこ１"), ("s", 2, "こけくきかおえういあ１"), ("s", 3, "あいうえおかきくけこ2"), ("t", 4, "あいうえおかきくけこ1")]
    spark.createDataFrame(rows, "suite string, item_id bigint, text string").write.parquet(str(tmp_path / "eval_items.parquet"))
    assert {r["item_id"] for r in QUERIES["jn14"](spark, str(tmp_path)).collect()} == {1, 2, 4}


RULES = """
[categories]
games = ["dice", "dice hall", "card"]
loans = ["quick loan"]
[rules]
weak = ["card", "quick loan"]
[domains]
block = ["bad.example"]
block_tier2 = ["news.example"]
block_tlds = ["blocked"]
host_terms = ["dicehall"]
"""


def test_decisions_on_documents(spark, tmp_path):
    from corpusmill.operators.classify import Script, classify

    (tmp_path / "rules.toml").write_text(RULES, encoding="utf-8")
    rules = readers.rules(str(tmp_path / "rules.toml"))
    body = "".join(chr(0x4E00 + i) for i in range(120))
    cases = {
        "plain": (body, "www.ok.cn", "keep", []),
        "weak": (body + " card", "ok.cn", "review", ["weak_term"]),
        "two weak": (body + " card QUICK LOAN", "ok.cn", "drop", ["term_games", "term_loans"]),
        "longest": (body + " Dice Hall", "ok.cn", "drop", ["term_games"]),
        "tier1": (body, "www.bad.example", "drop", ["domain_tier1"]),
        "not under it": (body, "notbad.example", "keep", []),
        "tier2": (body, "x.news.example", "review", ["domain_tier2"]),
        "tier2 and term": (body + "dice", "x.news.example", "drop", ["term_games", "domain_tier2"]),
        "tld": (body, "spam.blocked", "drop", ["tld"]),
        "host": (body, "my-dicehall.example", "drop", ["host_term"]),
        "official": (body, "www.dicehall.gov.cn", "keep", []),
        "fake": (body, "www.abc.gov.cn.abc.cn", "drop", ["fake_gov"]),
        "short": ("短い", "ok.cn", "drop", ["short"]),
        "latin": (body + "abc " * 400, "ok.cn", "drop", ["low_han"]),
        "again": (body + "\n" + body, "ok.cn", "drop", ["repetitive"]),
        "no host": (body, None, "keep", []),
        "null": (None, "ok.cn", "drop", ["short"]),
    }
    df = spark.createDataFrame([(k, v[0], v[1]) for k, v in cases.items()], "name string, text string, host string")
    got = {r["name"]: (r["decision"], r["reasons"]) for r in classify(df, rules).collect()}
    assert got == {k: (v[2], v[3]) for k, v in cases.items()}
    script = Script("門時間", "门时间", {"網路": "网络"})
    text = "網路門時間" * 30
    row = classify(spark.createDataFrame([(text, "a.tw")], "text string, host string"), rules, script=script).first()
    assert row["script"] == "hant" and row["text"] == "网络门时间" * 30
    hosts = spark.createDataFrame([(x,) for x in ("a.b.example.com.cn", "x.u07bgqr7k.com", "one", "a.b", "c.ac.jp", "b.c.ac.jp")], "h string")
    assert [r[0] for r in hosts.select(t.registrable(F.col("h"))).collect()] == ["example.com.cn", "u07bgqr7k.com", "one", "a.b", "c.ac.jp", "c.ac.jp"]
    labels = spark.createDataFrame([(x,) for x in ("u07bgqr7k", "kzlue2y", "plain", "lady8844", "it168", "51site", "3dgame", "a1b")], "h string")
    assert [r[0] for r in labels.select(t.looks_random(F.col("h"))).collect()] == [True, True, False, False, False, False, False, False]


def test_walks_and_quantiles_of_a_group_with_most_rows(spark):
    random.seed(11)
    rows = [(i, "hot" if i % 10 else f"g{i % 30}", random.choice([1, 2, 5, 40, 90, 300])) for i in range(900)] + [(5000, None, 7), (5001, None, 200)]
    df = spark.createDataFrame(rows, "id int, g string, v bigint").repartition(5)
    kept, used = set(), {}
    for i, g, v in sorted(rows):
        if used.get(g, 0) + v <= 150:
            used[g] = used.get(g, 0) + v
            kept.add(i)
    assert {r["id"] for r in dd.budget_walk(df, "g", "v", ["id"], 150).collect()} == kept
    assert dd.budget_walk(df.limit(0), "g", "v", ["id"], 150).collect() == []
    values = sorted(v for *_, v in rows)
    got = dict(map(tuple, dd.exact_quantiles(df, "v", {"a": 0.5, "b": 0.9, "c": 1.0}).collect()))
    assert got == {k: values[int(np.ceil(len(values) * x)) - 1] for k, x in (("a", 0.5), ("b", 0.9), ("c", 1.0))}
    ranked = {(r["id"]): (r["rank"], r["n"]) for r in dd.global_rank(df, ["id"], ["g"], size="n").collect()}
    hot = [i for i, g, _ in sorted(rows) if g == "hot"]
    assert all(ranked[i] == (k + 1, len(hot)) for k, i in enumerate(hot)) and ranked[5001] == (2, 2)
    offsets = {r["id"]: r["offset"] for r in sinks.merged_offsets(df.where("g is not null"), "g", "id", "v").collect()}
    at = 0
    for _, i, v in sorted((g, i, v) for i, g, v in rows if g is not None):
        assert offsets[i] == at
        at += v


def test_grams_looked_up_or_joined_are_the_same(spark, monkeypatch):
    random.seed(4)
    texts = [(i, "".join(random.choices("abcあ", k=random.randrange(0, 50)))) for i in range(60)] + [(99, None)]
    items = [(i, "".join(random.choices("abcあ", k=random.randrange(0, 9)))) for i in range(40)] + [(77, None)]
    a, b = spark.createDataFrame(texts, "k int, x string"), spark.createDataFrame(items, "i int, x string")
    grams = lambda x: {x[j : j + 4] for j in range(len(x) - 3)} if x else set()
    expected = {(k, i, len(grams(x) & grams(y))) for k, x in texts for i, y in items if grams(x) & grams(y)}
    look = lambda: {tuple(r) for r in jn.shared_grams(a, "k", "x", b, "i", "x", 4).collect()}
    held = lambda: {tuple(r) for r in jn.anchor_join(a, "k", "x", b, "i", "x", 4).collect()}
    whole = {(k, i) for k, x in texts for i, y in items if x and y and len(y) >= 4 and y in x}
    assert look() == expected and held() == whole
    monkeypatch.setattr(jn, "AUTOMATON_CHARS", 20)
    assert look() == expected and held() == whole
    monkeypatch.setattr(jn, "MOST_BLOCKS", 1)
    assert look() == expected and held() == whole


def test_locks_resumption_and_refusals(spark, tmp_path):
    base = f"file://{tmp_path}/run"
    assert sinks.write_resumable({"a": lambda: spark.range(3)}, base) == ["a"]
    assert sinks.write_resumable({"a": lambda: spark.range(9), "b": lambda: spark.range(2)}, base) == ["b"]
    assert spark.read.parquet(f"{base}/a", f"{base}/b").count() == 5
    with sinks.locked(spark, base), pytest.raises(RuntimeError, match="locked"), sinks.locked(spark, base):
        pass
    with sinks.locked(spark, base):
        pass
    with pytest.raises(ValueError, match="more than 2 rows"):
        sinks.markdown(spark.range(3), 2)
    assert sinks.markdown(spark.range(1), 2).endswith("| 0 |")
    twice = spark.createDataFrame([("x", "1"), ("x", "2")], "file string, sha256 string")
    with pytest.raises(ValueError, match="manifest"):
        sinks.manifest({}, {}, twice)
    assert {r["file"][:7] for r in sinks.file_digests(spark, base).where("file like '%.parquet'").collect()} == {"a/part-", "b/part-"}


def test_counted_model_against_plain_counts(spark):
    from collections import Counter
    from math import log

    from corpusmill.operators import ngrams as ng

    random.seed(8)
    texts = ["".join(random.choices("aabbcde", k=random.randrange(0, 25))) for _ in range(120)] + ["zq"]
    order = 4
    model = ng.train(spark.createDataFrame([(x,) for x in texts] + [(None,)], "text string").repartition(3), order=order)
    chars = Counter("".join("\x02" + x for x in texts))
    known = {c for c, n in chars.items() if n >= 2}
    mapped = ["".join(c if c in known else "\x01" for c in "\x02" + x) for x in texts]
    levels = {order: Counter(x[i : i + order] for x in mapped for i in range(len(x) - order + 1))}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    discount = {n: (lambda a, b: a / (a + 2 * b) if a else 0.5)(sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())) for n, c in levels.items()}
    assert {k: round(v, 12) for k, v in model.discounts.items()} == {k: round(v, 12) for k, v in discount.items()} and model.vocabulary == len(known) + 1

    def share(hist, ch):
        total = sum(levels[1].values())
        p = discount[1] * len(levels[1]) / total / (len(known) + 1) + max(levels[1][ch] - discount[1], 0) / total
        for n in range(2, order + 1):
            own = {g: v for g, v in levels[n].items() if g[:-1] == hist[len(hist) - n + 1 :]} if len(hist) >= n - 1 else {}
            if own:
                p = p * discount[n] * len(own) / sum(own.values()) + max(levels[n][hist[len(hist) - n + 1 :] + ch] - discount[n], 0) / sum(own.values())
        return p

    def score(context, text):
        whole = "".join(c if c in known else "\x01" for c in "\x02" + context + text)
        return sum(log(share(whole[max(0, i - order + 1) : i], whole[i])) for i in range(len(whole) - len(text), len(whole)))

    asked = [(1, "ab", "bcd"), (2, None, "aaxz"), (3, "", "q"), (4, "zzz", "abc"), (5, "a", None), (6, "a", "")]
    df = spark.createDataFrame(asked, "id int, c string, x string")
    places = ng.places(df, "id", F.col("c"), F.col("x"), model)
    got = {r["id"]: r["s"] for r in ng.log_shares(places, "id", model).groupBy("id").agg(F.sum("logp").alias("s")).collect()}
    assert set(got) == {1, 2, 3, 4} and all(abs(got[i] - score(c or "", x)) < 1e-9 for i, c, x in asked if i in got)
    memory = ng.in_memory(model)
    assert all(abs(memory.log_share(c or "", x) - score(c or "", x)) < 1e-9 for i, c, x in asked if x)
    for history in ("", "ab", "zz", "bca"):
        plain = sorted(((c, log(share(("\x02" + "".join(y if y in known else "\x01" for y in history))[-(order - 1) :], c))) for c in known - {"\x02"}), key=lambda y: (-y[1], y[0]))
        assert [c for c, _ in memory.likeliest(history, 3)] == [c for c, _ in plain[:3]]
    cands = spark.createDataFrame([(1, "a", "abc"), (1, "a", "abd"), (1, "a", "abd"), (1, "a", ""), (2, None, "b"), (3, "c", "ab"), (3, "c", "abb")], "id int, c string, x string")
    scored = {(r["id"], r["candidate"]): (r["scored"], r["logp"]) for r in ng.suffix_scores(cands, "id", "c", "x", model).collect()}
    assert {k: v[0] for k, v in scored.items()} == {(1, "abc"): 1, (1, "abd"): 1, (2, "b"): 1, (3, "ab"): 1, (3, "abb"): 2}
    assert abs(scored[1, "abc"][1] - (score("a", "abc") - score("a", "ab"))) < 1e-9 and abs(scored[3, "abb"][1] - (score("c", "abb") - score("c", "a"))) < 1e-9
    with pytest.raises(ValueError, match="more than 3 grams"):
        ng.in_memory(model, 3)
    empty = ng.train(spark.createDataFrame([], "text string"))
    assert ng.summary(empty).collect() == []


class _Plain:
    """A scorer with fixed shares, for the searches."""

    shares = {"a": 0.5, "b": 0.3, "c": 0.2}

    def log_share(self, history, piece):
        from math import log

        return sum(log(self.shares.get(x, 0.01) * (0.5 if history.endswith(x) else 1.0)) for x in piece)

    def likeliest(self, history, n):
        return sorted(((c, self.log_share(history, c)) for c in self.shares), key=lambda y: (-y[1], y[0]))[:n]


def test_searches_against_enumeration():
    import itertools

    from corpusmill.functions import search

    m = _Plain()
    whole = sorted((("".join(p), sum(m.log_share("".join(p[:i]), p[i]) for i in range(4))) for p in itertools.product("abc", repeat=4)), key=lambda y: (-y[1], y[0]))
    close = lambda got, want: dict(got).keys() == dict(want).keys() and all(abs(dict(got)[t] - s) < 1e-9 for t, s in want)
    assert close(search.continuations(m, ["", "x"], 4, 81)[0], whole)
    without = [(t, s) for t, s in whole if "a" not in t]
    assert close(search.continuations(m, [""], 4, 16, keep=lambda c: c != "a")[0], without)
    assert search.sampled(m, "q", 6, 1.0, 1) == search.sampled(m, "q", 6, 1.0, 1) and len(search.sampled(m, "", 6, 1.0, 2)) == 6
    rows = [("a", ["zhi"]), ("b", ["zi"]), ("ab", ["zhi", "zi"]), ("c", ["zhi"]), ("long", ["aa"] * 9)]
    index = search.KeyIndex(rows)
    assert index.skipped == 1 or "aa" * 9 in index.words
    for keys in ("zhizi", "zz", "zhi", "zhizhi", "q", "", "zhiq"):
        found = {}
        words = [(w, f, n) for f, own in index.words.items() for w, n in own.items()]

        def grow(at, text, cost, keys=keys, found=found, words=words):
            if at == len(keys) and text:
                found[text] = max(found.get(text, -1e9), cost)
            for w, f, n in words:
                if keys.startswith(f, at):
                    grow(at + len(f), text + w, cost + m.log_share(text, w) - n)

        grow(0, "", 0.0)
        best = sorted(found.items(), key=lambda y: (-y[1], y[0]))[:50]
        assert close(search.typed(m, index, keys, beam=1000, top=50), best)
    assert search.healed("xyab", ["ab", "b", "cd"]) == ("xy", "ab") and search.healed("xy", ["ab"]) == ("xy", "")
    assert [w for w, _ in search.diverse({"ab": -1.0, "abc": -0.5, "b": -2.0, "ba": -3.0}, 5)] == ["abc", "b"]
    assert [w for w, _ in search.predicted_words(m, ["xa"], ["a", "ab", "ac", "b"], 2)[0]] == ["b", "c"]
    told = search.simulate("abcde", [2] * 5, [2, 5], lambda at: [("cd", 0.0), ("c", 0.0), ("x", 0.0)] if at == 2 else [], -1.0)
    assert told == {"pressed": 4 + 1 + 2, "plain": 10, "offers": 1, "taken": 1}
    assert search.simulate("", [], [], lambda at: [], 0.0) == {"pressed": 0, "plain": 0, "offers": 0, "taken": 0}


def test_decisions_and_rescoring(spark):
    rows = [("x", True, "a"), ("y", True, "b"), ("z", False, "a")]
    schema = "name string, effective boolean, winner string"
    decided = lambda r, first="x": tuple(st.decide(spark.createDataFrame(r, schema), "name", "winner", first, "none").first())
    assert decided(rows) == ("a", "first") and decided(rows, "z") == ("none", "default") and decided(rows[:1]) == ("a", "agreement") and decided(rows[2:]) == ("none", "none effective")
    f = spark.createDataFrame([("i", 1, 3.0, 1.0, 1, 0.0, False, "s"), ("i", 2, 2.5, 0.0, 2, 2.0, True, "s"), ("j", 1, 9.0, 0.0, 1, 5.0, True, "t"), ("j", 2, 1.0, 0.0, 1, 0.0, False, "t"), ("k", 1, 1.0, 0.0, 1, 0.0, False, "t")], "item string, pos int, c double, f double, n int, z double, correct boolean, source string")
    choices = Stage(st.rescored(f, {"baseline": [()], "pmi": [(1.0,)], "engine": [(-9.0,), (1.0,)], "gated-engine": [(1.0, 0.1), (1.0, 0.6)]})).df
    best = {r["method"]: (r["setting"], r["exact"]) for r in st.best_of_methods(choices, "method", "setting").collect()}
    assert best == {"baseline": (0, 1), "pmi": (0, 2), "engine": (1, 2), "gated-engine": (1, 2)}
    cv = {(r["method"], r["source"]): (r["setting"], r["cases"], r["exact"]) for r in st.cross_validated(choices, "source").collect()}
    assert cv["engine", "t"] == (1, 2, 1) and cv["baseline", "s"] == (0, 1, 0)


def test_cursors_and_retries(spark, tmp_path):
    from corpusmill.streaming import streams

    store = spark.range(7).withColumnRenamed("id", "k")
    cursor = streams.Cursor(store, "k", f"file://{tmp_path}/cursor", 1)
    got = []
    for n in (3, 3, 5, 10):
        got += sorted((r["at"], r["epoch"], r["k"]) for r in cursor.take(n, lambda rows: rows.collect()))
    assert [a for a, *_ in got] == list(range(21)) and cursor.state == {"epoch": 3, "offset": 0}
    assert all({k for _, e, k in got if e == epoch} == set(range(7)) for epoch in range(3))
    with pytest.raises(ZeroDivisionError):
        cursor.take(2, lambda rows: 1 / 0)
    again = streams.Cursor(store, "k", f"file://{tmp_path}/cursor", 1)
    assert again.state == {"epoch": 3, "offset": 0}
    with pytest.raises(ValueError, match="empty"):
        streams.Cursor(store.limit(0), "k", f"file://{tmp_path}/none", 1)
    tries, waits = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 4:
            raise ConnectionError
        return "done"

    assert streams.retried(flaky, sleep=waits.append) == "done" and waits == [1.0, 2.0, 4.0]
    with pytest.raises(TimeoutError):
        streams.retried(lambda: (_ for _ in ()).throw(TimeoutError()), attempts=2, sleep=waits.append)
    with pytest.raises(KeyError):
        streams.retried(lambda: {}["x"], sleep=waits.append)
    assert keys.outlier(["a", "a", "b"]) == "third" and keys.outlier(["a", "b", "c"]) == "all" and keys.outlier(["a", None, "a"]) is None
    assert keys.keystrokes(["ab", "c"]) == (5, [3, 5]) and keys.abbreviations([["ni", "hao"], ["ma"]])[:4] == ["nihaoma", "nhm", "nihaom", "nhma"]


def test_records(spark):
    from corpusmill.operators import records as rec

    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    rows = frame([("a",), ("b",), ("c",)], "k string")
    reviews = frame([("a", "keep"), ("a", "drop"), ("b", "fix"), ("x", "keep")], "k string, decision string")
    merged = lambda r: {tuple(x) for x in rec.merged_decisions(rows, r, "k", "decision", ["keep", "fix", "drop"]).collect()}
    assert merged(reviews) == {("a", "drop"), ("b", "fix"), ("c", "open")} and merged(reviews.limit(0)) == {(k, "open") for k in "abc"}
    with pytest.raises(Exception, match="unknown decision"):
        merged(frame([("a", "what")], "k string, decision string"))
    parts = frame([("p", "x", 1), ("q", "x", 2), ("q", None, 4)], "part string, k string, n bigint")
    whole = lambda *v: frame(v, "k string, n bigint")
    assert {tuple(r) for r in rec.same_counters(parts, whole(("x", 3), (None, 4)), "k", "n").collect()} == {("x", 3), (None, 4)}
    for bad in (whole(("x", 2), (None, 4)), whole(("x", 3)), whole(("x", 3), (None, 4), ("y", 1))):
        with pytest.raises(Exception, match="differ"):
            rec.same_counters(parts, bad, "k", "n").collect()
    u = frame([(x,) for x in (0.0, 0.25, 0.5, 0.99, None)], "u double")
    assert [r[0] for r in u.select(rec.by_bounds(F.col("u"), [(0.25, "a"), (0.5, "b")], "c")).collect()] == ["a", "b", "c", "c", "c"]
    roles = rec.capped_role(frame([(i, "hot") for i in range(50)] + [(99, None)], "i int, s string"), "i", "s", 7, 1, "in", "out").groupBy("role").count().collect()
    assert {tuple(r) for r in roles} == {("in", 8), ("out", 43)}
    assert rec.ambiguous(frame([("k", "1"), ("k", "1"), ("l", "1"), ("l", "2"), (None, "1"), (None, "2")], "k string, v string"), "k", "v").collect() == [("l", 2)]
    units = frame([("d1", "t"), ("d2", "t"), ("d2", "t"), ("d3", "s")], "d string, t string")
    origins = frame([("d1", 1), ("d2", 2), ("d2", 3), ("d9", 4)], "d string, o int")
    contents = frame([("d1", "g"), ("d2", None)], "d string, g string")
    assert {tuple(r) for r in rec.provenance(units, origins, contents, "d", "t", ["o"]).collect()} == {(1, "t", True, 1), (2, "t", False, 1), (3, "t", False, 1)}
    assert {tuple(r) for r in rec.documents_log(origins, contents, "d", ["o"], ["g"]).collect()} == {(1, "g"), (2, None), (3, None)}
    book = lambda **words: segment.Dictionary([(w, r, 1.0) for w, r in words.items()])
    assert segment.agreed_phrases("abcx", book(ab="1", a="2", c="3"), book(ab="9", a="2", c="3")) == [("a", "2"), ("b", None), ("c", "3"), ("x", None)]


def test_replies_are_read_strictly(spark):
    asked = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("c", "1"), ("d", "1"), ("e", "1"), ("f", "1"), ("g", "1"), ("h", "1")], "batch string, key string")
    one = '{"decisions":[{"key":"1","decision":"keep"}]}'
    told = [("a", '{"decisions":[{"key":"1","decision":"keep"},{"key":"2","decision":"drop"}]}'), ("b", one), ("c", one[:-2]), ("d", '{"decisions":[{"key":"1","decision":"maybe"}]}'), ("e", '{"decisions":[]}'), ("f", '{"decisions":[{"key":"1","decision":"keep"},{"key":"1","decision":"keep"}]}'), ("g", one[:-1] + ',"note":1}'), ("x", one)]
    replies = ann.parsed_replies(spark.createDataFrame(told, "batch string, reply string"), "batch", "reply", ("keep", "fix", "drop"))
    errors = {r["batch"]: r["error"] for r in replies.collect()}
    assert errors == {"a": None, "b": None, "c": "json", "d": "decision", "e": "empty", "f": None, "g": "json", "x": None}
    assert {tuple(r) for r in ann.reply_check(asked, replies, "batch", "key").collect()} == {("a", True), ("b", True), *((k, False) for k in "cdefgh")}


def test_classes_of_errors(spark):
    from corpusmill.operators import ranking as rk

    rows = [("東京。", "東京", "notation"), ("東京", "東京", "correct"), ("漢字を", "漢字が", "notation"), ("ひらがな", "ひら", "semantic"), ("ABC", "abc!", "notation"), ("山", "川", "semantic"), (None, "x", None), ("", "", "correct")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(rows)], "i int, a string, b string")
    got = {r["i"]: r["c"] for r in df.select("i", rk.error_class(F.col("a"), F.col("b")).alias("c")).collect()}
    assert got == {i: c for i, (*_, c) in enumerate(rows)}


def test_stages_on_the_way_are_dropped(spark):
    import os

    from corpusmill.runtime import finished

    made = []

    def build():
        for k in range(2):
            made.append(Stage(spark.range(k + 1), "way"))
        made.append(finished(lambda: made[0].df.unionByName(Stage(made[1].df, "deep").df), "inner"))
        return made[2].df

    whole = finished(build, "whole")
    gone = [os.path.exists(s.path.removeprefix("file:").replace("//", "/")) for s in made]
    assert whole.df.count() == 3 and gone == [False, False, False]

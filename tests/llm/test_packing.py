import random
from collections import Counter, defaultdict

import pytest

from corpusmill.llm import packing


def texts(n):
    random.seed(9)
    words = ["model", "データ", "文章", "corpus ", "点検", "hello "]
    return [{"doc_id": k, "text": "".join(random.choices(words, k=random.choice([1, 3, 20, 60, 400]))), "source": random.choices(["big", "Mid", None], [6, 3, 1])[0]} for k in range(n)]


@pytest.mark.parametrize("extra", [False, True])
def test_each_item_once_whole_and_within_capacity(make, extra):
    rows = texts(1500)
    rows += rows[:30] + [{"doc_id": 9001, "text": None}, {"doc_id": 9002, "text": ""}, {"doc_id": None, "text": "孤児の文書", "source": "big"}, {"doc_id": 1, "text": "other row of one id", "source": "big"}]
    sizes = [("s", 32), ("m", 128), ("l", 1024), ("none", None), ("zero", 0)]
    got = packing.pack(make("documents", rows, extra), make("pack_sizes", sizes, extra), shard_items=400).collect()
    encode = packing._encoding(packing.TOKENIZER).encode_ordinary
    want = Counter()
    for r in {(r["doc_id"], r["text"], r.get("source")) for r in rows if r["text"]}:
        want[r[0]] += len(encode(r[1]))
    assert {r["pack_id"] for r in got} == {"s", "m", "l"}
    for name, capacity in sizes[:3]:
        own = [r for r in got if r["pack_id"] == name]
        held, placed, pieces = Counter(), Counter(), defaultdict(list)
        for r in own:
            held[r["container"]] += r["tokens"]
            placed[r["doc_id"]] += r["tokens"]
            pieces[r["doc_id"]].append((r["start"], r["tokens"]))
        assert max(held.values()) <= capacity and placed == want
        for doc, p in pieces.items():
            if doc not in (1, None) and want[doc] <= capacity:
                assert p == [(0, want[doc])]
            elif doc not in (1, None):
                assert sorted(p) == [(i, min(capacity, want[doc] - i)) for i in range(0, want[doc], capacity)]
        assert sum(held.values()) / (len(held) * capacity) > 0.97


def test_deficits_keep_the_mixture_along_the_containers():
    random.seed(3)
    items = [(k, k % 3 and 1, random.randrange(5, 60)) for k in range(3000)]
    all_ = sum(n for *_, n in items)
    share = {s: sum(n for _, x, n in items if x == s) / all_ for s in (0, 1)}
    out = list(packing.pack_shard(items, 256, share, {0: 0.0, 1: 0.0}))
    source = {k: s for k, s, _ in items}
    half = [r for r in out if r[0] < max(x[0] for x in out) // 2]
    taken = sum(n for _, k, _, n in half if source[k] == 0) / sum(r[3] for r in half)
    assert abs(taken - share[0]) < 0.02


def test_one_huge_text_empty_tables_and_report(make):
    sizes = make("pack_sizes", [("m", 64)])
    assert packing.pack(make("documents", []), sizes).collect() == []
    assert packing.pack(make("documents", texts(5)), make("pack_sizes", [])).collect() == []
    got = packing.pack(make("documents", [{"doc_id": 1, "text": "とても長い文章。" * 30_000, "source": "x"}]), sizes).collect()
    assert len({r["container"] for r in got}) == len(got) and sorted(r["start"] for r in got) == [64 * i for i in range(len(got))]
    report = packing.pack_report(make("documents", texts(200)), sizes).collect()
    assert len(report) == 1 and report[0]["texts"] == 200 and report[0]["fill"] > 0.9


def test_given_targets_hold_until_a_source_is_used_up(make):
    random.seed(5)
    rows = [{"doc_id": k, "text": "点検 " * random.randrange(3, 40), "source": "big" if k % 4 else "small"} for k in range(4000)]
    targets = {"big": 1.0, "small": 1.0}
    packed = packing.pack(make("documents", rows), make("pack_sizes", [("m", 256)]), shard_items=200, targets=targets)
    report = {r["source"]: r for r in packing.mixture_report(packed, targets).collect()}
    # The small source lasts for half of the containers, with as much of the big one.
    assert abs(report["small"]["first_half"] - 0.5) < 0.06 and abs(report["small"]["share"] - 0.25) < 0.03
    got = packed.collect()
    assert Counter(r["doc_id"] for r in got) == Counter({k: 1 for k in range(4000)})
    first = [r for r in got if r["container"] >> 32 == 0]
    assert abs(sum(r["tokens"] for r in first if r["source"] == "small") / sum(r["tokens"] for r in first) - 0.5) < 0.05
    assert sum(r["tokens"] for r in got) / (256 * len({r["container"] for r in got})) > 0.97


def test_large_ids_survive(make):
    big = (1 << 62) + 1
    got = packing.pack(make("documents", [{"doc_id": big, "text": "hello"}, {"doc_id": None, "text": "model"}]), make("pack_sizes", [("m", 64)])).collect()
    assert {r["doc_id"] for r in got} == {big, None}


def test_targets_of_empty_tables_and_unknown_sources(make):
    sizes, empty = make("pack_sizes", [("m", 64)]), make("documents", [])
    assert packing.tempered(empty) == {} and packing.pack(empty, sizes, targets={"a": 1.0}).collect() == []
    assert packing.mixture_report(packing.pack(empty, sizes, targets={}), {}).collect() == []
    rows = texts(200)
    got = packing.pack(make("documents", rows), sizes, shard_items=40, targets={"absent": 3.0, "big": 1.0, "zero": 0.0}).collect()
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in rows} and {r["source"] for r in got} == {"big", "mid", "unknown"}
    last = max(r["container"] >> 32 for r in got)
    assert {r["source"] for r in got if r["container"] >> 32 == 0} == {"big"} and "big" not in {r["source"] for r in got if r["container"] >> 32 == last}

import random

import numpy as np
import pytest
from conftest_llm import plain_fold
from hypothesis import given, settings, strategies as hs

from corpusmill.functions.fold import code_points
from corpusmill.llm import leaks


def brute(docs, items, span=24):
    out = set()
    for i in items:
        f = plain_fold(i["text"])
        runs = {f[k : k + span] for k in range(len(f) - span + 1)}
        for d in docs:
            g = plain_fold(d["text"])
            if any(g[k : k + span] in runs for k in range(len(g) - span + 1)):
                out.add((i["item_id"], d["doc_id"]))
    return out


@pytest.mark.parametrize(("extra", "most"), [(False, 8), (True, 8), (True, 0)])
def test_passages_against_brute_force(make, extra, most, monkeypatch):
    monkeypatch.setattr(leaks, "MOST_BLOCKS", most)  # with none, fingerprints are joined
    rng = random.Random(8)
    letters = lambda n: "".join(chr(0x4E00 + rng.randrange(400)) for _ in range(n))
    items = [{"item_id": k, "text": letters(rng.choice([5, 23, 24, 25, 60, 200])), "suite": "s"} for k in range(60)]
    docs = []
    for k in range(400):
        body = letters(rng.randrange(0, 300))
        item = rng.choice(items)["text"]
        cut = rng.randrange(0, len(item))
        length = rng.choice([10, 22, 23, 24, 25, 26, 80])
        docs.append({"doc_id": k, "text": body[:100] + "。\n".join(item[cut : cut + length][i : i + 7] for i in range(0, length, 7)) + body[100:]})
    docs += [{"doc_id": 1000, "text": None}, {"doc_id": 1001, "text": ""}, {"doc_id": 1002, "text": "あ" * 500}]
    items += [{"item_id": 900, "text": None}, {"item_id": 901, "text": "あ" * 30}, {"item_id": 902, "text": ""}]
    real = [d for d in docs if d["text"] is not None]
    expected = brute(real, [i for i in items if i["text"] is not None])
    docs += docs[:5] + [{"doc_id": None, "text": items[3]["text"]}]
    got = leaks.leaked_items(make("documents", docs, extra), make("eval_items", items + items[:5] + [{"item_id": None, "text": items[3]["text"]}], extra))
    assert {tuple(r) for r in got.collect()} == expected and (901, 1002) in expected


def test_items_in_blocks(make, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 100)
    items = [{"item_id": k, "text": "".join(chr(0x4E00 + 40 * k + j) for j in range(30))} for k in range(20)]
    docs = [{"doc_id": k, "text": "前" + items[k]["text"] + "後"} for k in range(20)]
    assert {tuple(r) for r in leaks.leaked_items(make("documents", docs), make("eval_items", items)).collect()} == {(k, k) for k in range(20)}


def test_empty_long_and_report(make):
    assert leaks.leaked_items(make("documents", []), make("eval_items", [])).collect() == []
    item = [{"item_id": 1, "suite": None, "text": "".join(chr(0x4E00 + j) for j in range(40))}]
    long = [{"doc_id": 1, "text": "長" * 2_500_000 + item[0]["text"]}]
    assert [tuple(r) for r in leaks.leaked_items(make("documents", long), make("eval_items", item)).collect()] == [(1, 1)]
    assert [tuple(r) for r in leaks.leak_report(make("documents", long), make("eval_items", item)).collect()] == [("none", 1, 1, 1)]


@settings(max_examples=60, deadline=None)
@given(hs.lists(hs.text("abc", max_size=40), min_size=1, max_size=6))
def test_every_window_keeps_its_least_hash(texts):
    points, offsets = code_points(texts)
    key, at = leaks.winnow(points, offsets, 4, 9)
    kept = set(at.tolist())
    from corpusmill.functions.fold import gram_keys

    all_keys = gram_keys(points, 4)
    for t in range(len(texts)):
        for s in range(int(offsets[t]), int(offsets[t + 1]) - 9 + 1):
            window = all_keys[s : s + 6]
            assert any(s + j in kept for j in np.flatnonzero(window == window.min()))

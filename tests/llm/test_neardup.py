import random
from collections import defaultdict

import pytest
from conftest_llm import grams3, plain_fold, similarity

from corpusmill.llm import neardup


def letters(n, rng):
    return "".join(chr(0x4E00 + rng.randrange(2500)) for _ in range(n))


def units(doc, text, cut=25):
    return [{"doc_hash": doc, "text_hash": "t", "text": text[i : i + cut], "paragraph_index": i // cut, "sentence_index": 0, "spans": None, "annotation_ids": "[]"} for i in range(0, len(text), cut)]


def brute(texts):
    grams = {d: grams3(plain_fold(t)) for d, t in texts.items() if len(plain_fold(t)) >= 100}
    parent = {d: d for d in grams}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    names = sorted(grams)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if similarity(grams[a], grams[b]) >= 0.7:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    groups = defaultdict(list)
    for d in names:
        groups[find(d)].append(d)
    return {(a, b) for m in groups.values() for a in m for b in m if a < b}


@pytest.mark.parametrize("extra", [False, True])
def test_groups_against_brute_force(make, extra):
    rng = random.Random(1)
    texts = {}
    for k in range(60):
        base = letters(rng.randrange(90, 400), rng)
        texts[f"{k:03d}a"] = base
        texts[f"{k:03d}b"] = base if k % 4 == 0 else base[: len(base) // 2] + letters(rng.randrange(1, 12), rng) + base[len(base) // 2 :]
        if k % 5 == 0:
            texts[f"{k:03d}c"] = base[len(base) // 3 :] + base[: len(base) // 3]
    rows = [u for d, t in texts.items() for u in units(d, t)]
    rows += rows[:40] + [{"doc_hash": None, "text": "x" * 200, "paragraph_index": 0}, {"doc_hash": "nulls", "text": None}, {"doc_hash": "short", "text": "短い", "paragraph_index": 0, "sentence_index": 0}]
    members = neardup.near_duplicates(make("units", rows, extra))
    assert {tuple(r) for r in neardup.group_pairs(members).collect()} == brute(texts)


def test_a_crowd_of_near_copies_and_of_exact_copies(make):
    rng = random.Random(2)
    base = letters(300, rng)
    texts = {f"n{k:03d}": base[: 2 * k] + letters(1, rng) + base[2 * k + 1 :] for k in range(140)}
    texts |= {f"x{k:03d}": base for k in range(50)}
    texts |= {f"o{k:03d}": letters(300, rng) for k in range(100)}
    members = neardup.near_duplicates(make("units", [u for d, t in texts.items() for u in units(d, t)])).collect()
    groups = defaultdict(set)
    for r in members:
        groups[r["group_id"]].add(r["doc_hash"])
    assert list(groups.values()) == [{d for d in texts if d[0] != "o"}]
    assert len({r["class_key"] for r in members if r["doc_hash"][0] == "x"}) == 1


def test_empty_and_very_long(make):
    assert neardup.near_duplicates(make("units", [])).collect() == []
    rng = random.Random(4)
    long = letters(200_000, rng)
    rows = units("a", long, 5000) + units("b", long[:100_000] + "字" + long[100_000:], 5000)
    assert {r["doc_hash"] for r in neardup.near_duplicates(make("units", rows)).collect()} == {"a", "b"}


def test_bayesian_bounds_keep_similar_pairs():
    need = neardup.least_matches()
    assert need == sorted(need) and 0 < need[0] < 11 and need[-1] < 90
    rng = random.Random(6)
    import numpy as np

    lost = 0
    for _ in range(2000):
        hits = np.array([rng.random() < 0.72 for _ in range(neardup.ROWS)])
        lost += any(hits[: (i + 1) * neardup.BATCH].sum() < m for i, m in enumerate(need))
    assert lost <= 20


def test_a_crowd_with_outsiders_linked_only_to_some_of_it(make):
    """A bucket of near copies, and texts like some of its members but not like its leader."""
    rng = random.Random(9)
    base = letters(240, rng)
    texts = {f"a{k:03d}": base[: 2 * k] + letters(1, rng) + base[2 * k + 1 :] for k in range(100)}
    for k in range(40):
        cut = 24 + k // 2
        texts[f"b{k:03d}"] = base[:-cut] + letters(cut, rng)
        texts[f"c{k:03d}"] = letters(20, rng) + base[20:-cut] + letters(cut, rng)
    texts |= {f"o{k:03d}": letters(240, rng) for k in range(60)}
    members = neardup.near_duplicates(make("units", [u for d, t in texts.items() for u in units(d, t)]))
    got = {tuple(r) for r in neardup.group_pairs(members).collect()}
    expected = brute(texts)
    assert got <= expected and len(got) >= 0.99 * len(expected)


def test_outsiders_linked_to_one_of_a_crowd(make):
    """Texts like one member only, which is no leader, and whose runs are all large; and the links of a crowd."""
    rng = random.Random(12)
    base = letters(300, rng)
    texts = {f"a{k:03d}": base[: 2 * k] + letters(1, rng) + base[2 * k + 1 :] for k in range(95)}
    texts |= {"z": base, "y0": base[:248] + letters(52, rng), "y1": base[:197] + letters(50, rng) + base[247:]}
    members = neardup.near_duplicates(make("units", [u for d, t in texts.items() for u in units(d, t)]), count_links=True).cache()
    assert {tuple(r) for r in neardup.group_pairs(members).collect()} == brute(texts)
    grams = {d: grams3(plain_fold(t)) for d, t in texts.items()}
    assert {r["doc_hash"]: r["links"] for r in members.collect()} == {d: sum(similarity(g, h) >= 0.7 for e, h in grams.items() if e != d) for d, g in grams.items()}


def test_pairs_of_a_large_group_by_blocks(spark):
    members = spark.createDataFrame([(f"h{k:03d}", "g") for k in range(90)] + [("a", "x"), ("b", "x"), ("c", None)], "doc_hash string, group_id string")
    got = {tuple(r) for r in neardup.group_pairs(members, block=7).collect()}
    assert got == {(f"h{i:03d}", f"h{j:03d}") for i in range(90) for j in range(i + 1, 90)} | {("a", "b")}

import random
from collections import Counter, defaultdict

import pytest

from corpusmill.llm import mixing

TARGETS = [("web", "a:x", 0.4, 1), ("web", "a:y", 0.2, 3), ("web", "b:z", 0.2, 2), ("chat", "c", 0.1, 2), ("chat", "gone", 0.1, 5)]


def docs(n=3000):
    random.seed(4)
    names = [("web", "a:x", 0.6), ("web", "A：Y ", 0.05), ("web", "b:z", 0.2), ("chat", "c", 0.1), ("chat", None, 0.05)]
    out = []
    for k in range(n):
        pool, source, _ = random.choices(names, [w for *_, w in names])[0]
        out.append({"id": f"{k:05d}", "split": "train" if k % 10 else "test", "pool": pool, "source": source, "priority": random.choice([None, k]), "pairs": random.choice([None, 0, 5, 40, 200])})
    return out


@pytest.mark.parametrize(("extra", "total"), [(False, None), (True, 200_000.0), (False, 10_000_000.0)])
def test_caps_shares_and_rows(make, extra, total):
    rows = docs()
    d, t = make("docs", rows + rows[:100], extra), make("mix_targets", TARGETS, extra)
    taken = mixing.mix(d, t, total).collect()
    known = {(r["id"]): r for r in rows}
    caps = {mixing.canonical(s): c for _, s, _, c in TARGETS}
    count = Counter((r["source"], r["id"], r["epoch"]) for r in taken)
    assert max(count.values()) == 1
    for source, ident, epoch in count:
        assert epoch < caps[source] and known[ident]["split"] == "train" and known[ident]["pairs"] > 0
    shares = {r["source"]: r for r in mixing.shares(d, t, total).collect()}
    sums = defaultdict(int)
    for r in taken:
        sums[r["source"]] += r["pairs"]
    assert {s: x["pairs"] for s, x in shares.items() if x["pairs"]} == dict(sums)
    for x in shares.values():
        assert x["pairs"] <= x["budget"] <= x["max_repeat"] * x["available"] and x["budget"] - x["pairs"] < 200 + 1
    if total is None:
        assert all(abs(shares[s]["share"] - w) < 0.005 for s, w in (("a:x", 0.4), ("a:y", 0.2), ("b:z", 0.2), ("c", 0.2)))
        assert shares["gone"]["shortfall"] > 0
    if total == 10_000_000.0:
        assert all(x["pairs"] == x["max_repeat"] * x["available"] for x in shares.values())


def test_same_mix_again_and_in_other_partitions(make):
    d, t = make("docs", docs(500)), make("mix_targets", TARGETS)
    assert sorted(map(tuple, mixing.mix(d, t).collect()), key=str) == sorted(map(tuple, mixing.mix(d.repartition(7), t).collect()), key=str)


def test_shortage_goes_to_siblings_first():
    leaf = lambda p, s, share, cap, size: {"pool": p, "source": s, "share": share, "max_repeat": cap, "size": size}
    out = {x["source"]: x["budget"] for x in mixing.budgets([leaf("w", "a:1", 0.3, 1, 10), leaf("w", "a:2", 0.3, 1, 1000), leaf("w", "b:1", 0.2, 1, 1000), leaf("c", "c", 0.2, 1, 1000)], 100.0)}
    assert out["a:1"] == 10 and abs(out["a:2"] - 50) < 1e-9 and abs(out["b:1"] - 20) < 1e-9 and abs(out["c"] - 20) < 1e-9
    out = {x["source"]: x["budget"] for x in mixing.budgets([leaf("w", "a:1", 0.3, 1, 10), leaf("w", "a:2", 0.3, 1, 35), leaf("w", "b:1", 0.2, 1, 1000), leaf("c", "c", 0.2, 1, 1000)], 100.0)}
    assert out["a:2"] == 35 and abs(out["b:1"] - 35) < 1e-9 and abs(out["c"] - 20) < 1e-9


def test_empty_and_null_targets(make):
    assert mixing.mix(make("docs", []), make("mix_targets", TARGETS)).collect() == []
    assert mixing.mix(make("docs", docs(50)), make("mix_targets", [])).collect() == []
    odd = [("web", "a:x", None, 1), ("web", "a:y", -1.0, 2), ("web", "b:z", 1.0, None), (None, None, 0.5, 1)]
    got = mixing.mix(make("docs", docs(300)), make("mix_targets", odd)).collect()
    assert got and {r["source"] for r in got} == {"b:z"}

import random
from collections import defaultdict

import pytest

from corpusmill.llm import splits


def brute(contents, aliases, docs):
    names = dict(enumerate(splits.SPLITS))
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    known = {c["doc_hash"] for c in contents if c.get("doc_hash")}
    stored = defaultdict(set)
    for c in contents:
        if c.get("doc_hash"):
            find(c["doc_hash"])
            if c.get("group_id") is not None:
                parent[find("g" + c["group_id"])] = find(c["doc_hash"])
            if c.get("split_rank") is not None:
                stored[c["doc_hash"]].add(names[c["split_rank"]])
    for a in aliases:
        if a.get("alias_key") and a.get("doc_hash") in known and a["alias_key"].split(":", 1)[-1].strip():
            parent[find("k" + a["alias_key"])] = find(a["doc_hash"])
    for d in docs:
        if d.get("id") in known and d.get("split"):
            stored[d["id"]].add(d["split"])
    groups = defaultdict(list)
    for k in known:
        groups[find(k)].append(k)
    return {(min(m), x) for m in groups.values() if len(m) > 1 and len(set().union(*(stored[x] for x in m))) > 1 for x in m}, {frozenset(m) for m in groups.values()}


@pytest.mark.parametrize("extra", [False, True])
def test_broken_ties_against_brute_force(make, extra):
    random.seed(5)
    contents = [{"doc_hash": f"d{i:03d}", "group_id": random.choice([None, f"g{i // 7}"]), "split_rank": random.choice([None, 0, 0, 0, 1, 2])} for i in range(150)]
    contents.append({"doc_hash": None, "group_id": "g1", "split_rank": 2})
    aliases = [{"alias_key": f"id:{random.randrange(80)}", "doc_hash": f"d{random.randrange(170):03d}"} for _ in range(120)]
    aliases += [{"alias_key": "author:hub", "doc_hash": f"d{i:03d}"} for i in range(0, 150, 3)] + [{"alias_key": k, "doc_hash": f"d{i:03d}"} for k in (None, "", "id:", "url: ") for i in range(100)]
    docs = [{"id": f"d{random.randrange(150):03d}", "split": random.choice(["train", "train", "test", None]), "pool": "web"} for _ in range(100)]
    tables = [make("contents", contents, extra), make("aliases", aliases * 2, extra), make("docs", docs, extra)]
    expected, groups = brute(contents, aliases, docs)
    assert {tuple(r) for r in splits.broken_ties(*tables).collect()} == expected and expected
    rows = splits.assign_splits(*tables, proportions=(0.8, 0.1, 0.1)).collect()
    assert len(rows) == 150
    where = {r["doc_hash"]: (r["root_hash"], r["split"]) for r in rows}
    for g in groups:
        assert {where[x] for x in g} == {(min(g), where[min(g)][1])}


def test_url_keys_compare_by_scheme_host_and_fragment(make):
    contents = [{"doc_hash": x, "split_rank": r} for x, r in (("a", 0), ("b", 1), ("c", 2), ("d", 0))]
    aliases = [("url: HTTPS://Host.example/Path?q=1#x ", "a"), ("url:https://host.example/Path?q=1", "b"), ("url:https://host.example/path?q=1", "c"), ("id:X", "c"), ("id:x", "d"), ("url:#only", "c"), ("url: #only", "d")]
    found = splits.broken_ties(make("contents", contents), make("aliases", aliases), make("docs", [])).collect()
    assert {tuple(r) for r in found} == {("a", "a"), ("a", "b")}


def test_empty_tables(make):
    empty = [make(n, []) for n in ("contents", "aliases", "docs")]
    assert splits.broken_ties(*empty).collect() == [] and splits.assign_splits(*empty).collect() == []


def test_quotas_equal_the_sequential_greedy():
    random.seed(2)
    for _ in range(40):
        sizes = [random.choice([1, 1, 1, 2, 3, 5, 9, 30]) for _ in range(random.randrange(1, 200))]
        shares = random.choice([(0.98, 0.01, 0.01), (0.8, 0.1, 0.1), (1, 1, 1)])
        left = [p / sum(shares) * sum(sizes) for p in shares]
        taken = defaultdict(lambda: [0, 0, 0])
        for s in sorted(sizes, reverse=True):
            i = max(range(3), key=lambda i: (round(left[i], 6), -i))
            left[i] -= s
            taken[s][i] += 1
        got = splits.quotas({s: sizes.count(s) for s in set(sizes)}, shares)
        assert {s: sum(t) for s, t in got.items()} == {s: sizes.count(s) for s in set(sizes)}
        load = lambda q: [sum(s * t[i] for s, t in q.items()) for i in range(3)]
        assert max(abs(x - y) for x, y in zip(load(got), load(taken), strict=True)) <= max(sizes)


def test_shares_reach_the_targets(make):
    contents = [{"doc_hash": f"{i:05d}"} for i in range(1000)]
    rows = splits.split_shares(splits.assign_splits(make("contents", contents), make("aliases", []), make("docs", []))).collect()
    assert {r["split"]: r["contents"] for r in rows} == {"train": 980, "validation": 10, "test": 10}

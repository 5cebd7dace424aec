import hashlib
import random

import pytest
from conftest_llm import grams3, plain_fold, similarity

from corpusmill.llm import overlap


def sig(text):
    return hashlib.blake2b((text or "").encode(), digest_size=16).hexdigest()


def row(i, split, text, **more):
    return {"id": i, "split": split, "source": more.get("source"), "pool": "chat", "text": text, "sig": sig(text), "tokens": [2, 3], "pairs": 1}


def brute(rows, seen):
    train = {}
    for r in rows:
        if r["split"] == "train" and len(plain_fold(r["text"])) >= 20:
            train[r["sig"]] = grams3(plain_fold(r["text"]))
    known = {s["sig"] for s in seen if s["split"] == "train"}
    out = set()
    for r in rows:
        f = plain_fold(r["text"])
        if r["split"] in overlap.EVAL and len(f) >= 20:
            out |= {(r["id"], s) for s, g in train.items() if similarity(grams3(f), g) >= 0.7}
            if r["sig"] in known:
                out.add((r["id"], r["sig"]))
    return out


def letters(n, seed):
    random.seed(seed)
    return "".join(chr(0x4E00 + random.randrange(3000)) for _ in range(n))


@pytest.mark.parametrize("extra", [False, True])
def test_edits_against_brute_force(make, extra):
    rows, i = [], 0
    for k in range(60):
        base = letters(random.Random(k).randrange(20, 90), k)
        rows.append(row(i, "train", base))
        edited = [base, base[: len(base) // 2] + "字" + base[len(base) // 2 :], base[len(base) // 2 :] + base[: len(base) // 2], base[:9] + base[10:], base.replace(base[12], "々", 1), "！" + base + "。"]
        rows += [row(i + 1 + j, ["validation", "test"][j % 2], e) for j, e in enumerate(edited)]
        i += 10
    rows += [row(i + j, s, t) for j, (s, t) in enumerate([("test", None), ("test", ""), ("train", None), (None, letters(30, 1)), ("test", "短い"), ("train", "短い")])]
    seen = [{"sig": sig(rows[3]["text"]), "split": "train"}, {"sig": sig("gone"), "split": "train"}, {"sig": None, "split": "train"}]
    got = overlap.overlaps(make("seq", rows + rows[:20], extra), make("seen", seen, extra))
    assert {(r["seq_id"], r["sig"]) for r in got.collect()} == brute(rows, seen)


def test_texts_of_frequent_phrases_go_the_exact_way(make):
    random.seed(3)
    phrases = [letters(12, 100 + k) for k in range(6)]
    text = lambda: "".join(random.sample(phrases, 4))
    rows = [row(k, "train", text()) for k in range(300)] + [row(1000 + k, "test", text()) for k in range(60)]
    got = overlap.overlaps(make("seq", rows), make("seen", []))
    expected = brute(rows, [])
    assert {(r["seq_id"], r["sig"]) for r in got.collect()} == expected and len(expected) > 500


def test_a_prefix_in_a_third_of_all_texts(make):
    stock = letters(16, 7)
    rows = [row(k, "train", stock + letters(24, 500 + k) if k % 3 else letters(40, 900 + k)) for k in range(600)]
    rows += [row(2000 + k, "validation", stock + letters(24, 500 + k)[:-1] + "終") for k in range(1, 40, 2)]
    got = overlap.overlaps(make("seq", rows), make("seen", []))
    assert {(r["seq_id"], r["sig"]) for r in got.collect()} == brute(rows, [])


def test_half_of_stock_and_half_edited(make):
    """The stock part is too frequent to be paired, and the tail shares no run of 8 characters."""
    stock = letters(50, 21)
    tails = [letters(40, 3000 + k) for k in range(40)]
    edited = lambda t: "".join("々" if i in (0, 8, 16, 24, 32) else c for i, c in enumerate(t))
    rows = [row(k, "train", stock + t) for k, t in enumerate(tails)] + [row(1000 + k, "test", stock + edited(t)) for k, t in enumerate(tails)]
    got = overlap.overlaps(make("seq", rows), make("seen", []))
    expected = brute(rows, [])
    assert {(r["seq_id"], r["sig"]) for r in got.collect()} == expected and len(expected) == 40


def test_empty_tables_and_report(make):
    assert overlap.overlaps(make("seq", []), make("seen", [])).collect() == []
    base = letters(30, 4)
    report = overlap.overlap_report(make("seq", [row(1, "train", base), row(2, "test", base, source=" A "), row(3, "test", base[:-1] + "終", source="a"), row(4, "validation", letters(30, 5))]), make("seen", []))
    assert {tuple(r) for r in report.collect()} == {("test", "a", 2, 1, 1, 0), ("validation", "unknown", 1, 0, 0, 0)}


def test_a_very_long_text(make):
    long = letters(60_000, 11)
    rows = [row(1, "train", long), row(2, "test", long[:30_000] + "字" + long[30_000:]), row(3, "test", long[::-1])]
    assert {r["seq_id"] for r in overlap.overlaps(make("seq", rows), make("seen", [])).collect()} == {2}


def test_stock_openings_and_edited_tails(make):
    """Texts share one of three openings; tails of 36 characters have a substitution at every sixth to tenth character."""
    rows, n = [], 0
    for size in (30, 54, 70):
        stock = letters(size, 77 + size)
        for every in (6, 7, 8, 10):
            for k in range(40):
                tail = letters(36, 5000 + n)
                edited = "".join("々" if i % every == every - 1 else c for i, c in enumerate(tail))
                rows += [row(n, "train", stock + tail), row(n + 1, "test", stock + edited)]
                n += 2
    got = overlap.overlaps(make("seq", rows), make("seen", []))
    expected = brute(rows, [])
    assert {(r["seq_id"], r["sig"]) for r in got.collect()} == expected and len(expected) > 300


def test_pieces_in_another_order_and_shorter_or_longer_texts(make):
    rows, n = [], 0
    for k in range(60):
        r = random.Random(k)
        base = letters(r.randrange(24, 120), 9000 + k)
        cut = sorted(r.sample(range(4, len(base) - 4), 2))
        moved = base[cut[1] :] + base[cut[0] : cut[1]] + base[: cut[0]]
        rows += [row(n, "train", base), row(n + 1, "train", moved), row(n + 2, "test", base[: int(len(base) * r.uniform(0.7, 1))]), row(n + 3, "validation", base + letters(int(len(base) * r.uniform(0, 0.4)), n)), row(n + 4, "test", moved[2:])]
        n += 5
    got = overlap.overlaps(make("seq", rows), make("seen", []))
    expected = brute(rows, [])
    assert {(r["seq_id"], r["sig"]) for r in got.collect()} == expected and len(expected) > 150

import random
import re
from collections import defaultdict

import pytest
from conftest_llm import plain_fold

from corpusmill.llm import boilerplate


def brute(units, origins):
    sites, members, found = defaultdict(set), defaultdict(set), defaultdict(set)
    for o in origins:
        site = (o["source"] or "").strip().lower() or ("/".join(o["source_file"].split("/")[1:-1]).strip().lower() if o["source_file"] else "")
        if o["doc_hash"] and site:
            sites[o["doc_hash"]].add(site)
            members[site].add(o["doc_hash"])
    line = lambda u: re.sub(r"\d+", "#", plain_fold(u["text"]))
    for u in units:
        for s in sites[u["doc_hash"]]:
            found[s, line(u)].add(u["doc_hash"])
    bad = {k for k, v in found.items() if len(v) >= 8 and len(v) >= 0.05 * len(members[k[0]])}
    return {(u["doc_hash"], u["paragraph_index"], u["sentence_index"]) for u in units if u["doc_hash"] and any((s, line(u)) in bad for s in sites[u["doc_hash"]])}


@pytest.mark.parametrize("extra", [False, True])
def test_against_brute_force(make, extra):
    random.seed(1)
    units, origins = [], []
    for k in range(260):
        doc = f"d{k:03d}"
        site = random.choice(["A.example", " a.EXAMPLE ", "b.example", None, ""])
        origins.append({"doc_hash": doc, "source": site, "source_file": random.choice(["crawl-1/b.example/p.parquet", "crawl-2/c/d/p.parquet"])})
        if k % 9 == 0:
            origins.append({"doc_hash": doc, "source": "z.example", "source_file": None})
        texts = [f"独自の文{chr(0x4E00 + k)} 番 {random.random()}", "© 2031 All rights reserved." if k % 3 else "本文", f"第{k}回　シェア！", None if k % 5 else "", random.choice(["まれ", "たまに"]) + str(k % 40)]
        units += [{"doc_hash": doc, "text_hash": str(i), "text": t, "paragraph_index": i, "sentence_index": 0 if i % 2 else None} for i, t in enumerate(texts)]
    units += units[:50] + [{"doc_hash": None, "text": "x", "paragraph_index": 0, "sentence_index": 0}, {"doc_hash": "lost", "text": "© 2031 All rights reserved.", "paragraph_index": 0, "sentence_index": 0}]
    origins += origins[:50] + [{"doc_hash": None, "source": "a.example", "source_file": None}, {"doc_hash": "d001", "source": None, "source_file": None}]
    expected = brute(units, origins)
    u, o = make("units", units, extra), make("origins", origins, extra)
    assert {tuple(r) for r in boilerplate.repeated_units(u, o).collect()} == expected and expected
    cleaned = {r["doc_hash"]: r for r in boilerplate.without_repeated(u, o).collect()}
    assert set(cleaned) == {x["doc_hash"] for x in units if x["doc_hash"]}
    assert cleaned["lost"]["removed"] == 0 and "独自の文" + chr(0x4E01) in cleaned["d001"]["text"] and "All rights" not in cleaned["d001"]["text"]
    assert sum(r["removed"] for r in cleaned.values()) == len(expected)


def test_empty_tables_and_report(make):
    assert boilerplate.repeated_units(make("units", []), make("origins", [])).collect() == []
    units = [{"doc_hash": f"d{k}", "text_hash": "h", "text": "同じ行", "paragraph_index": 0, "sentence_index": 0} for k in range(10)]
    origins = [{"doc_hash": f"d{k}", "source": "s", "source_file": "a/s/b"} for k in range(10)]
    assert [tuple(r) for r in boilerplate.line_report(make("units", units), make("origins", origins)).collect()] == [("s", "同じ行", 10, 0, 10)]


def test_republished_copies_count_once(make):
    units = [{"doc_hash": "one", "text_hash": "h", "text": "転載", "paragraph_index": 0, "sentence_index": 0}]
    origins = [{"doc_hash": "one", "doc_id": str(k), "source": "s", "source_file": "a/s/b", "row_index": k} for k in range(50)]
    assert boilerplate.repeated_units(make("units", units), make("origins", origins)).collect() == []


def test_days_and_clusters(make, spark):
    from datetime import datetime

    units = [{"doc_hash": f"d{k}", "text_hash": "h", "text": t, "paragraph_index": i, "sentence_index": 0} for k in range(12) for i, t in enumerate(["毎日の行", "一日だけの行" if k < 9 else "別の行"])]
    origins = [{"doc_hash": f"d{k}", "source": "s", "source_file": "a/s/b", "crawled_at": datetime(2031, 3, 1 if k < 9 else k)} for k in range(12)]
    u, o = make("units", units), make("origins", origins)
    hit = lambda **kw: {(r["paragraph_index"]) for r in boilerplate.repeated_units(u, o, **kw).collect()}
    assert hit() == {0, 1} and hit(min_days=2) == {0} and hit(min_days=5) == set()
    clusters = spark.createDataFrame([(f"d{k}", "c") for k in range(5)], "doc_hash string, cluster string")
    assert hit(clusters=clusters) == {0} and hit(clusters=clusters.limit(0)) == {0, 1}


def test_an_article_of_one_day_stays_and_lines_without_dates_go(make):
    from datetime import datetime

    texts = lambda k: ["毎日の行", "一日だけの行" if k < 9 else "別の行"]
    units = [{"doc_hash": f"d{k}", "text_hash": "h", "text": t, "paragraph_index": i, "sentence_index": 0} for k in range(12) for i, t in enumerate(texts(k))]
    dated = [{"doc_hash": f"d{k}", "source": "s", "source_file": "a/s/b", "crawled_at": datetime(2031, 3, 1 if k < 9 else k)} for k in range(12)]
    u = make("units", units)
    clean = {r["doc_hash"]: r["text"] for r in boilerplate.without_repeated(u, make("origins", dated), min_days=2).collect()}
    assert clean["d0"] == "一日だけの行" and clean["d11"] == "別の行"
    undated = [{**o, "crawled_at": None} for o in dated]
    clean = {r["doc_hash"]: r["text"] for r in boilerplate.without_repeated(u, make("origins", undated), min_days=2).collect()}
    assert clean["d0"] == "" and clean["d11"] == "別の行"


def test_near_copies_of_other_days_have_the_day_of_their_cluster(make, spark):
    from datetime import datetime

    # Nine articles of one day with a line; one is published again, edited, on the next days.
    units = [{"doc_hash": f"d{k:02d}", "text_hash": "h", "text": t, "paragraph_index": i, "sentence_index": 0} for k in range(14) for i, t in enumerate(["毎日の行", "一日だけの行" if k < 12 else "別の行"])]
    origins = [{"doc_hash": f"d{k:02d}", "source": "s", "source_file": "a/s/b", "crawled_at": datetime(2031, 3, 1 if k < 9 else k)} for k in range(14)]
    u, o = make("units", units), make("origins", origins)
    clusters = spark.createDataFrame([(f"d{k:02d}", "c") for k in (0, 9, 10, 11)], "doc_hash string, cluster string")
    hit = lambda **kw: {r["paragraph_index"] for r in boilerplate.repeated_units(u, o, min_days=2, **kw).collect()}
    assert hit() == {0, 1} and hit(clusters=clusters) == {0}
    clean = {r["doc_hash"]: r["text"] for r in boilerplate.without_repeated(u, o, min_days=2, clusters=clusters).collect()}
    assert clean["d00"] == clean["d11"] == "一日だけの行" and clean["d13"] == "別の行"

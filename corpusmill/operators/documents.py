"""From documents to sentences: clean the lines, apply labels, join lines, split, filter, and count what happened.

``process`` gives one row per sentence with its outcome, so units, audit logs and counters are filters and aggregates of
one table. Everything happens inside a document; only labels are joined, on the document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusmill.functions import segment
from corpusmill.functions.text import clean_block, nfc, unix_lines

#: Labels of people on a document: ``block`` (block_id, text, action), ``boundary`` (left_block, right_block, action join or
#: separate) and ``fragment`` (text, spans as JSON, action).
LABELS = "id string, doc_hash string, kind string, action string, text string, block_id string, left_block string, right_block string, spans string"
_SENTENCE = (
    "array<struct<paragraph_index:int,sentence_index:int,text:string,outcome:string,terminated:boolean,flags:array<string>,"
    "spans:array<struct<block_id:string,start:int,end:int>>,joins:array<struct<left_block:string,right_block:string,reason:string>>,label_ids:array<string>>>"
)
_BLOCK = "array<struct<block_id:string,line_index:int,original:string,text:string,action:string,reason:string>>"


def clean_lines(docs: DataFrame, key: str = "doc_hash", text: str = "text") -> DataFrame:
    """``(key, blocks)``: the lines of each document with id, cleaned text, action and reason. A null text has no lines."""
    named = lambda i: F.concat(F.lit("b"), F.lpad(i.cast("string"), F.greatest(F.lit(3), F.length(i.cast("string"))), F.lit("0")))
    lines = docs.where(F.col(text).isNotNull()).select(key, F.split(nfc(unix_lines(F.col(text))), "\n").alias("lines"))
    block = lambda line, i: F.struct(named(i).alias("block_id"), i.alias("line_index"), line.alias("original"), clean_block(line, composed=True).alias("b"))
    flat = lambda x: F.struct(x["block_id"], x["line_index"], x["original"], x["b"]["text"].alias("text"), x["b"]["action"].alias("action"), x["b"]["reason"].alias("reason"))
    return lines.select(key, F.transform("lines", block).alias("blocks")).select(key, F.transform("blocks", flat).cast(_BLOCK).alias("blocks"))


def _labelled(blocks: list[dict], labels: list[dict]):
    """Blocks with the actions of their labels, decisions on boundaries, and the fragments' labels. A label that quotes
    another text, or blocks that are no neighbours, is refused."""
    by_id = {b["block_id"]: b for b in blocks}
    changed, decisions, fragments = {}, {}, []
    for x in labels:
        if x["kind"] == "block":
            block = by_id.get(x["block_id"])
            if block is None or block["text"] != x["text"] or x["block_id"] in changed:
                raise ValueError(f"label {x['id']} does not fit its block")
            block["action"] = x["action"]
            changed[x["block_id"]] = x["id"]
        elif x["kind"] == "boundary":
            left, right = by_id.get(x["left_block"]), by_id.get(x["right_block"])
            if left is None or right is None or right["line_index"] != left["line_index"] + 1 or (x["left_block"], x["right_block"]) in decisions:
                raise ValueError(f"label {x['id']} does not fit its boundary")
            decisions[x["left_block"], x["right_block"]] = (x["action"], x["id"])
        elif x["kind"] == "fragment":
            fragments.append(x)
        else:
            raise ValueError(f"label {x['id']} is of an unknown kind")
    return changed, decisions, fragments


def sentences_of(blocks: list[dict], labels: list[dict], max_chars: int = 2048) -> list[dict]:
    """Every sentence of a document with its outcome: ``unit``, or ``fragment`` for what is unterminated, flagged, without a
    letter, or labelled out; a fragment labelled ``keep`` becomes a unit unless it is flagged, which is refused."""
    import json

    blocks = [dict(b) for b in blocks]
    changed, decisions, fragments = _labelled(blocks, labels)
    waiting = {}
    for x in fragments:
        spans = tuple((p["block_id"], p["start"], p["end"]) for p in json.loads(x["spans"] or "[]"))
        if (x["text"], spans) in waiting:
            raise ValueError(f"label {x['id']}: a fragment is labelled twice")
        waiting[x["text"], spans] = x
    out, used = [], set()
    rows = [(b["block_id"], b["line_index"], b["text"], b["action"]) for b in blocks]
    for pi, p in enumerate(segment.restore_linebreaks(rows, max_chars, {k: v[0] for k, v in decisions.items()})):
        own = {changed[name] for name, *_ in p["parts"] if name in changed} | {decisions[a, b][1] for a, b, why in p["joins"] if why == "approved_annotation"}
        at = 0
        for si, (text, start, end, terminated, flags) in enumerate(segment.split_sentences(p["text"])):
            while at < len(p["parts"]) and p["parts"][at][2] <= start:
                at += 1
            spans, n = [], at
            while n < len(p["parts"]) and p["parts"][n][1] < end:
                name, lo, hi = p["parts"][n]
                spans.append((name, max(start, lo) - lo, min(end, hi) - lo))
                n += 1
            flags = sorted({*p["flags"], *flags})
            label = waiting.get((text, tuple(spans)))
            if label:
                if label["id"] in used:
                    raise ValueError(f"label {label['id']} fits two fragments")
                used.add(label["id"])
                if label["action"] == "keep" and flags:
                    raise ValueError(f"label {label['id']}: a flagged fragment cannot be kept")
            kept = label is not None and label["action"] == "keep"
            good = (terminated or kept) and not flags and (label is None or kept) and any(c.isalnum() for c in text)
            out.append({
                "paragraph_index": pi, "sentence_index": si, "text": text, "outcome": "unit" if good else "fragment", "terminated": terminated, "flags": flags,
                "spans": [{"block_id": x, "start": lo, "end": hi} for x, lo, hi in spans],
                "joins": [{"left_block": x, "right_block": y, "reason": why} for x, y, why in p["joins"]],
                "label_ids": sorted(own | ({label["id"]} if label else set())),
            })
    unused = {x["id"] for x in waiting.values()} - used
    if unused:
        raise ValueError(f"labels of fragments that do not occur: {sorted(unused)}")
    return out


def process(docs: DataFrame, labels: DataFrame | None = None, key: str = "doc_hash", text: str = "text", max_chars: int = 2048) -> DataFrame:
    """``(key, blocks, sentences)`` of each distinct document. ``labels`` has the columns of ``LABELS``; rows of unknown documents are ignored."""
    cleaned = clean_lines(docs, key, text)
    if labels is None:
        cleaned = cleaned.withColumn("labels", F.lit(None))
    else:
        fields = [c.split()[0] for c in LABELS.split(", ")]
        grouped = labels.groupBy(F.col("doc_hash").alias("_key")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("labels"))
        cleaned = cleaned.join(grouped, F.col(key) == F.col("_key"), "left").drop("_key")

    def fold(batches):
        import pyarrow as pa

        kind = _arrow_of_sentences()
        for batch in batches:
            found = [sentences_of(b, x or [], max_chars) for b, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, kind)], ["key", "blocks", "sentences"])

    typed = cleaned.select(F.col(key).alias("key"), "blocks", F.col("labels") if labels is not None else F.lit(None).cast("array<string>").alias("labels"))
    kind = dict(docs.dtypes)[key]
    return typed.mapInArrow(fold, f"key {kind}, blocks {_BLOCK}, sentences {_SENTENCE}").withColumnRenamed("key", key)


def _arrow_of_sentences():
    import pyarrow as pa

    span = pa.struct([("block_id", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    join = pa.struct([("left_block", pa.string()), ("right_block", pa.string()), ("reason", pa.string())])
    return pa.list_(pa.struct([("paragraph_index", pa.int32()), ("sentence_index", pa.int32()), ("text", pa.string()), ("outcome", pa.string()), ("terminated", pa.bool_()), ("flags", pa.list_(pa.string())), ("spans", pa.list_(span)), ("joins", pa.list_(join)), ("label_ids", pa.list_(pa.string()))]))


def units(processed: DataFrame, key: str = "doc_hash") -> DataFrame:
    """``(key, text_hash, text, paragraph_index, sentence_index, spans, annotation_ids)``: the sentences that are kept."""
    s = processed.select(key, F.explode("sentences").alias("s")).where("s.outcome = 'unit'")
    return s.select(key, F.sha2("s.text", 256).alias("text_hash"), "s.text", "s.paragraph_index", "s.sentence_index", F.to_json("s.spans").alias("spans"), F.to_json("s.label_ids").alias("annotation_ids"))


def fragments(processed: DataFrame, key: str = "doc_hash") -> DataFrame:
    """The audit log of sentences that are left out."""
    s = processed.select(key, F.explode("sentences").alias("s")).where("s.outcome = 'fragment'")
    return s.select(key, "s.text", "s.paragraph_index", "s.sentence_index", "s.terminated", F.array_join("s.flags", ",").alias("flags"), F.to_json("s.spans").alias("spans"), F.to_json("s.joins").alias("joins"))


def left_out_blocks(processed: DataFrame, key: str = "doc_hash") -> DataFrame:
    """The audit log of lines that are dropped or wait for review, by rule."""
    b = processed.select(key, F.explode("blocks").alias("b")).where("b.action <> 'keep'")
    return b.select(key, "b.*")


def document_metrics(processed: DataFrame, key: str = "doc_hash") -> DataFrame:
    """``(key, metric, n)``: counters of each document; they add up over documents, shards and runs."""
    b, s = F.col("blocks"), F.col("sentences")
    with_action = lambda a: F.size(F.filter(b, lambda x: x["action"] == a))
    first = F.filter(s, lambda x: x["sentence_index"] == 0)  # one sentence of each paragraph
    joins = F.flatten(F.transform(first, lambda x: x["joins"]))
    fixed = {
        "unique_documents": F.lit(1),
        "input_blocks": F.size(b),
        **{f"{a}_blocks": with_action(a) for a in segment.ACTIONS},
        "paragraphs": F.size(first),
        "join_events": F.size(joins),
        "approved_join_events": F.size(F.filter(joins, lambda x: x["reason"] == "approved_annotation")),
        "fragments": F.size(F.filter(s, lambda x: x["outcome"] == "fragment")),
        "sentence_occurrences": F.size(F.filter(s, lambda x: x["outcome"] == "unit")),
        "approved_fragment_recoveries": F.size(F.filter(s, lambda x: (x["outcome"] == "unit") & ~x["terminated"])),
    }
    counted = processed.select(key, F.explode(F.create_map(*[y for k, v in fixed.items() for y in (F.lit(k), v.cast("bigint"))])).alias("metric", "n"))
    reasons = processed.select(key, F.explode(F.transform(b, lambda x: x["reason"])).alias("r")).where("r <> ''").groupBy(key, F.concat(F.lit("rule:"), "r").alias("metric")).agg(F.count("*").alias("n"))
    flagged = processed.select(key, F.explode(F.flatten(F.transform(F.filter(s, lambda x: x["outcome"] == "fragment"), lambda x: x["flags"]))).alias("f")).groupBy(key, F.concat(F.lit("flag:"), "f").alias("metric")).agg(F.count("*").alias("n"))
    return counted.where("n > 0").unionByName(reasons).unionByName(flagged)


def merged_metrics(*parts: DataFrame) -> DataFrame:
    """``(metric, n)``: counters of any parts added up."""
    from functools import reduce

    return reduce(lambda x, y: x.unionByName(y), [p.select("metric", "n") for p in parts]).groupBy("metric").agg(F.sum("n").alias("n"))

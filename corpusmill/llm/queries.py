"""The pN_ queries: each over its whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.llm import boilerplate, leaks, mixing, neardup, overlap, packing, pii, splits
from corpusmill.runtime import finished, table


def p1_found(spark, d):
    return splits.broken_ties(table(spark, d, "contents"), table(spark, d, "aliases"), table(spark, d, "docs"))


def p1_assign(spark, d):
    return splits.assign_splits(table(spark, d, "contents"), table(spark, d, "aliases"), table(spark, d, "docs"))


def p1_shares(spark, d):
    return splits.split_shares(p1_assign(spark, d))


def p3_groups(spark, d):
    """One row per content that has a near or exact duplicate; the group is named by its smallest hash."""
    members = finished(lambda: neardup.near_duplicates(table(spark, d, "units"), count_links=True), "p3").df
    named = members.groupBy("group_id").agg(F.min("doc_hash").alias("group_hash"), F.count("*").alias("members"))
    return members.join(named, "group_id").select("group_hash", "doc_hash", "class_key", "links", "members")


def p3_found(spark, d):
    return neardup.group_pairs(finished(lambda: neardup.near_duplicates(table(spark, d, "units")), "p3").df)


def p5_found(spark, d):
    return boilerplate.repeated_units(table(spark, d, "units"), table(spark, d, "origins"))


def p5_cleaned(spark, d):
    """Each content without the lines that repeat over clusters of near-duplicate contents of a site, on more than one day."""
    units = table(spark, d, "units")
    clusters = finished(lambda: neardup.near_duplicates(units).select("doc_hash", F.col("group_id").alias("cluster")), "clusters").df
    return boilerplate.without_repeated(units, table(spark, d, "origins"), min_days=2, clusters=clusters)


def p5_lines(spark, d):
    return boilerplate.line_report(table(spark, d, "units"), table(spark, d, "origins"))


def p2_found(spark, d):
    return overlap.overlaps(table(spark, d, "seq"), table(spark, d, "seen")).select("seq_id", "sig")


def p2_report(spark, d):
    return overlap.overlap_report(table(spark, d, "seq"), table(spark, d, "seen"))


def p4_mixed(spark, d):
    return mixing.mix(table(spark, d, "docs"), table(spark, d, "mix_targets"))


def p4_shares(spark, d):
    return mixing.shares(table(spark, d, "docs"), table(spark, d, "mix_targets"))


def p4_shares_full(spark, d):
    """The mix as large as all train rows together: sources that are too small fall short, and siblings make up for them."""
    docs = table(spark, d, "docs")
    size = mixing.train_rows(docs).agg(F.sum("pairs")).first()[0] or 0
    return mixing.shares(docs, table(spark, d, "mix_targets"), float(size))


def p6_packed(spark, d):
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_sizes"))


def p6_to_targets(spark, d):
    """Containers that follow shares in proportion to the square root of each source's size, and how near they come."""
    documents = table(spark, d, "documents")
    targets = packing.tempered(documents)
    return packing.mixture_report(packing.pack(documents, table(spark, d, "pack_sizes"), targets=targets), targets)


def p6_fill(spark, d):
    return packing.pack_report(table(spark, d, "documents"), table(spark, d, "pack_sizes"))


def p7_found(spark, d):
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_report(spark, d):
    return leaks.leak_report(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark, d):
    return pii.find_personal(table(spark, d, "documents"), table(spark, d, "lexicon")).select("doc_id", "pii_type", "start_pos")


def p8_redacted(spark, d):
    return pii.redact_personal(table(spark, d, "documents"), table(spark, d, "lexicon"))


def queries():
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}

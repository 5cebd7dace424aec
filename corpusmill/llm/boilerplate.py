"""Problem 5: lines repeated across one site's documents.

Documents that are copies of each other are collapsed first: a content stands for all its origins, and ``clusters`` may
join contents further (near-duplicate groups, for example). Each line is then counted over the distinct clusters of a
site, and over the days on which these first appeared there, so that an article published again is not taken for
boilerplate. Lines repeated beyond the limits come out of every content of the site. ``p5_cleaned`` counts over the clusters
of near-duplicates and asks for two days; ``TESTDATA.md`` defines ``p5_found`` over distinct contents without regard to
days, so there exact copies alone are collapsed.

Counting is over distinct ``(site, line, content)`` triples, pre-aggregated before the shuffle; a line that holds a
tenth of all rows is a counter, not a group. Joins are on the content, or on ``(site, line)`` where one row a line
meets few.

Defined cases: a null or blank source takes the folder in the middle of ``source_file``, and no site if that is null
too; a null or wholly unlettered line is the empty line, counted like any other; null positions stay null; repeated
rows count once; a content without origins keeps all its lines; empty tables give no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from corpusmill.functions.fold import fold_many
from corpusmill.functions.text import strip
from corpusmill.runtime import Stage

_DIGITS = re.compile(r"\d+")
_DIGIT_SIGN = "#"


def site_of(source: Column, source_file: Column) -> Column:
    name = F.lower(strip(source))
    folder = F.lower(strip(F.regexp_extract(source_file, r"^[^/]*/(.*)/[^/]*$", 1)))
    return F.coalesce(F.when(name != "", name), F.when(folder != "", folder))


def _line_keys(batches):
    import pyarrow as pa
    import xxhash

    for batch in batches:
        # Letters and digits survive folding, so the sign for digits cannot clash with anything kept.
        folded = _DIGITS.sub(_DIGIT_SIGN, "\n".join(fold_many(batch.column(3).to_pylist()))).split("\n") if batch.num_rows else []
        keys = pa.array([xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in folded], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), keys], ["doc_hash", "paragraph_index", "sentence_index", "line"])


def keyed_lines(units: DataFrame) -> DataFrame:
    """``(doc_hash, paragraph_index, sentence_index, line)``; ``line`` is a digest of the folded text with digit runs as one sign."""
    rows = units.where("doc_hash is not null").select("doc_hash", F.col("paragraph_index").cast("bigint").alias("paragraph_index"), F.col("sentence_index").cast("bigint").alias("sentence_index"), "text")
    return rows.mapInArrow(_line_keys, T.StructType([*rows.schema.fields[:3], T.StructField("line", T.BinaryType())]))


def content_sites(origins: DataFrame) -> DataFrame:
    """``(doc_hash, site)``, distinct; a content belongs to each site of its origins."""
    return origins.select("doc_hash", site_of(F.col("source"), F.col("source_file")).alias("site")).where("doc_hash is not null and site is not null").distinct()


def first_days(origins: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """``(doc_hash, site, day)``: the day a content, or the first one of its cluster, first appeared on a site; null if no date is known."""
    dated = origins.select("doc_hash", site_of(F.col("source"), F.col("source_file")).alias("site"), F.to_date("crawled_at").alias("day"))
    days = dated.where("doc_hash is not null and site is not null").groupBy("doc_hash", "site").agg(F.min("day").alias("day"))
    if clusters is None:
        return days
    joined = days.join(clusters.select("doc_hash", "cluster").where("cluster is not null"), "doc_hash")
    firsts = joined.groupBy("cluster", "site").agg(F.min("day").alias("first"))
    shared = joined.join(firsts, ["cluster", "site"]).select("doc_hash", "site", "first")
    return days.join(shared, ["doc_hash", "site"], "left").select("doc_hash", "site", F.coalesce("first", "day").alias("day"))


def days_of(lines: DataFrame, days: DataFrame, repeated: DataFrame) -> DataFrame:
    """``(site, line, days)``: on how many distinct days contents with the line appeared first; lines of ``repeated`` only.
    0 where no content with the line has a date."""
    hits = lines.select("doc_hash", "line").distinct().join(repeated.select("line").distinct(), "line", "left_semi")
    return hits.join(days, "doc_hash").join(repeated.select("site", "line"), ["site", "line"], "left_semi").groupBy("site", "line").agg(F.count_distinct("day").alias("days"))


def repeated_lines(lines: DataFrame, sites: DataFrame, min_contents: int = 8, min_share: float = 0.05, clusters: DataFrame | None = None) -> DataFrame:
    """``(site, line, contents, site_contents)`` of the lines found in so many distinct contents of a site, and such a share of them.

    ``clusters``: ``(doc_hash, cluster)``; contents of one cluster count once, contents without cluster by themselves.
    """
    of = lambda df: df.withColumnRenamed("doc_hash", "unit_") if clusters is None else df.join(clusters.select("doc_hash", F.col("cluster").cast("string").alias("cluster")), "doc_hash", "left").withColumn("unit_", F.coalesce("cluster", "doc_hash")).drop("doc_hash", "cluster")
    sizes = of(sites).distinct().groupBy("site").agg(F.count("*").alias("site_contents"))
    found = lines.select("doc_hash", "line").distinct().join(sites, "doc_hash")
    counts = (of(found).distinct() if clusters is not None else found).groupBy("site", "line").agg(F.count("*").alias("contents")).where(F.col("contents") >= min_contents)
    return counts.join(sizes, "site").where(F.col("contents") >= F.col("site_contents") * min_share)


def repeated_units(units: DataFrame, origins: DataFrame, min_contents: int = 8, min_share: float = 0.05, min_days: int = 0, clusters: DataFrame | None = None) -> DataFrame:
    """``(doc_hash, paragraph_index, sentence_index)`` of each unit whose line is repeated in a site of its content.

    The counts are over distinct contents: a line is a case in "at least 8 distinct contents and at least 5 %" of them.
    With ``min_days`` the line must also have appeared on so many different days, unless none of its contents has a date;
    contents of one cluster have the day on which the first of them appeared on the site.
    """
    lines = Stage(keyed_lines(units), "lines").df
    sites = Stage(content_sites(origins), "sites").df
    repeated = Stage(repeated_lines(lines, sites, min_contents, min_share, clusters), "repeated").df
    if min_days:
        lasting = days_of(lines, first_days(origins, clusters), repeated).where((F.col("days") >= min_days) | (F.col("days") == 0))
        repeated = repeated.join(lasting.select("site", "line"), ["site", "line"], "left_semi")
        repeated = Stage(repeated, "lasting").df
    # Only contents of sites with such lines, and only such lines, take part in the wide join.
    affected = lines.join(repeated.select("line").distinct(), "line", "left_semi").join(sites, "doc_hash")
    return affected.join(repeated.select("site", "line"), ["site", "line"], "left_semi").select("doc_hash", "paragraph_index", "sentence_index").distinct()


def without_repeated(units: DataFrame, origins: DataFrame, min_contents: int = 8, min_share: float = 0.05, min_days: int = 0, clusters: DataFrame | None = None) -> DataFrame:
    """``(doc_hash, text, kept, removed)``: each content, its units in order, one a line, without the repeated ones."""
    found = repeated_units(units, origins, min_contents, min_share, min_days, clusters).withColumn("hit", F.lit(True))
    # A hash stands for the columns that only tell rows apart; they are not moved.
    rows = units.where("doc_hash is not null").select("doc_hash", F.col("paragraph_index").cast("bigint").alias("paragraph_index"), F.col("sentence_index").cast("bigint").alias("sentence_index"), "text", F.xxhash64("text_hash", "spans", "annotation_ids").alias("rest")).distinct()
    same = [rows["doc_hash"] == found["doc_hash"], rows["paragraph_index"].eqNullSafe(found["paragraph_index"]), rows["sentence_index"].eqNullSafe(found["sentence_index"])]
    marked = rows.join(found, same, "left").select(rows["doc_hash"], rows["paragraph_index"], rows["sentence_index"], rows["text"], F.coalesce("hit", F.lit(False)).alias("hit"))
    kept = F.array_sort(F.collect_list(F.when(~F.col("hit"), F.struct("paragraph_index", "sentence_index", F.coalesce("text", F.lit("")).alias("text")))))
    return marked.groupBy("doc_hash").agg(kept.alias("u"), F.count_if("hit").alias("removed")).select("doc_hash", F.array_join(F.transform("u", lambda x: x["text"]), "\n").alias("text"), F.size("u").alias("kept"), "removed")


def line_report(units: DataFrame, origins: DataFrame, min_contents: int = 8, min_share: float = 0.05) -> DataFrame:
    """``(site, sample, contents, days, site_contents)``: the repeated lines with an example and the days on which their contents appeared.

    A line of a single day may be one event; its ``days`` tell it from a notice that stands for long.
    """
    rows = units.where("doc_hash is not null")
    lines = Stage(keyed_lines(units), "lines").df
    sites = Stage(content_sites(origins), "sites").df
    repeated = Stage(repeated_lines(lines, sites, min_contents, min_share), "repeated").df
    hits = lines.join(repeated.select("line").distinct(), "line", "left_semi")
    dated = days_of(lines, first_days(origins), repeated)
    samples = hits.join(rows.select("doc_hash", F.col("paragraph_index").cast("bigint").alias("paragraph_index"), F.col("sentence_index").cast("bigint").alias("sentence_index"), "text"), ["doc_hash", "paragraph_index", "sentence_index"]).groupBy("line").agg(F.min("text").alias("sample"))
    return repeated.join(dated, ["site", "line"]).join(samples, "line").select("site", "sample", "contents", "days", "site_contents")

import os
import re
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def make(spark):
    """Tables of the given rows with the schemas of the data, and extra columns whose names clash with inner ones."""
    schemas = {
        "contents": "doc_hash string, group_id string, split_rank int",
        "aliases": "alias_key string, doc_hash string",
        "docs": "id string, split string, pool string, source string, priority bigint, pairs bigint",
        "seq": "id bigint, doc string, ordinal bigint, split string, source string, pool string, text string, sig string, tokens array<int>, pairs bigint",
        "seen": "sig string, split string, pool string",
        "units": "doc_hash string, text_hash string, text string, paragraph_index bigint, sentence_index bigint, spans string, annotation_ids string",
        "origins": "doc_hash string, doc_id string, source string, source_file string, row_index bigint, info string, crawled_at timestamp_ntz, loaded_at timestamp_ntz",
        "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, host string, url string, fetched_at timestamp_ntz",
        "eval_items": "item_id bigint, suite string, left_context string, text string, answers array<string>, item_group string",
        "mix_targets": "pool string, source string, target_share double, max_repeat int",
        "pack_sizes": "pack_id string, capacity int",
        "lexicon": "word string, kind string, lang string, weight double",
    }

    def build(name, rows, extra=False):
        columns = [c.split()[0] for c in re.split(r", (?=\w+ )", schemas[name])]
        full = [tuple(r.get(c) for c in columns) if isinstance(r, dict) else r for r in rows]
        df = spark.createDataFrame(full, schemas[name])
        if extra:
            from pyspark.sql import functions as F

            inner = [c for c in ("v", "root", "a", "b", "k", "n", "h", "key", "bucket", "rank", "rec", "site", "line", "shard", "run", "copies", "row") if c not in df.columns]
            df = df.withColumns({c: F.lit("clash") for c in inner}).withColumn("extra_map", F.create_map(F.lit("x"), F.lit(1)))
        return df

    return build


def at(day):
    return datetime(2031, 3, day)

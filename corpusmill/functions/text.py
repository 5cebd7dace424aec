"""Columns that clean, normalize, test and measure text. All are JVM expressions but for Unicode normalization."""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

#: White space as Python's ``str.strip`` and ``str.split`` know it.
WS = r"[\s\x1c-\x1f\x85\p{Z}]"
#: The same characters one by one, in code point order, for trimming without a pattern.
SPACES = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())
HAN, KANA = r"\p{IsHan}", r"[\p{IsHiragana}\p{IsKatakana}]"
#: Kana of the two syllabaries that correspond, in code point order.
KATAKANA = "".join(chr(c) for c in range(0x30A1, 0x30F7))
HIRAGANA = "".join(chr(c - 0x60) for c in range(0x30A1, 0x30F7))


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else t if t.isascii() else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else t if t.isascii() else unicodedata.normalize("NFKC", t))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """``difflib`` ratio of two texts; 2 * matched / all characters, without the popularity heuristic."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b, strict=True)])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it, inside lambdas too."""
    return F.transform(F.array(value), body)[0]


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def length_of(text: Column, other_than: str) -> Column:
    """Characters left once all runs of ``other_than``, a class of characters, are taken out; faster than counting matches one by one."""
    return F.length(F.regexp_replace(text, f"{other_than}+", ""))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def collapse(text: Column) -> Column:
    return F.regexp_replace(strip(text), f"{WS}+", " ")


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def without_bom(text: Column) -> Column:
    return F.regexp_replace(text, "^﻿+", "")


def normal_document(text: Column) -> Column:
    """CRLF as LF, NFC, no leading byte-order mark: the text that is hashed."""
    return without_bom(nfc(unix_lines(text)))


def controls_to_space(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0b-\x1f\x7f-\x9f]", " ")


def no_space_key(text: Column) -> Column:
    return F.sha2(F.regexp_replace(text, f"{WS}+", ""), 256)


def normal_message(text: Column) -> Column:
    """NFC without category C but line ends and tabs; white space as single spaces."""
    return collapse(F.regexp_replace(nfc(text), r"[\p{Cc}\p{Cf}\p{Co}&&[^\n\t]]", ""))


def clean_block(line: Column, composed: bool = False) -> Column:
    """``struct(text, action, reason)`` of one line: ``drop`` if empty, an address or decoration alone; ``review`` if
    it holds broken characters or a sentence glued to a Latin word; else ``keep``. A null line is an empty one.
    ``composed`` tells that the line is NFC already, which keeps the column in the JVM."""
    line = F.coalesce(line, F.lit(""))
    text = strip(controls_to_space(F.regexp_replace(unix_lines(line) if composed else normal_document(line), "﻿", "")))
    # Decoration around a text: the same sign on both sides.
    text = strip(F.regexp_replace(text, r"(?s)^([*=~◆◇■□★☆])\1*\s*(.*?[^*=~◆◇■□★☆\s].*?)\s*\1+$", "$2"))
    return let(text, _judged) if composed else _judged(text)


def _judged(text: Column) -> Column:
    reason = (
        F.when(text == "", "empty")
        .when(text.rlike(r"^https?://[^\s]+$"), "url")
        .when(~text.rlike(r"[\p{L}\p{N}]"), "decoration")
        .when(text.contains("�"), "broken")
        .when(text.rlike(r"。[A-Za-z]+$"), "glued")
        .otherwise("")
    )
    action = F.when(reason.isin("empty", "url", "decoration"), "drop").when(reason.isin("broken", "glued"), "review").otherwise("keep")
    return F.struct(text.alias("text"), action.alias("action"), reason.alias("reason"))


def canonical_url(url: Column) -> Column:
    """http and https only: scheme and host in lower case, ``/`` for no path, the query kept, the fragment cut; else null."""
    url = strip(url)
    parts = r"(?is)^(https?)://([^/?#]+)([^?#]*)(\?[^#]*)?(#.*)?$"
    get = lambda i: F.regexp_extract(url, parts, i)
    return F.when(url.rlike(parts), F.concat(F.lower(get(1)), F.lit("://"), F.lower(get(2)), F.when(get(3) == "", "/").otherwise(get(3)), get(4)))


def host_of(url: Column) -> Column:
    return F.regexp_extract(canonical_url(url), r"^https?://(?:[^@/]*@)?([^/?:]+)", 1)


#: Labels under which country domains register names.
SECOND_LEVEL = ("com", "net", "org", "gov", "edu", "ac")


def registrable(host: Column) -> Column:
    """The last two labels, or three below a second level of a country."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    three = (n >= 3) & (F.length(F.element_at(labels, -1)) == 2) & F.try_element_at(labels, F.lit(-2)).isin(*SECOND_LEVEL)
    return F.when(n <= 2, host).otherwise(F.array_join(F.slice(labels, F.when(three, -3).otherwise(-2), F.lit(3)), "."))


def in_domain(host: Column, domain: Column) -> Column:
    return (host == domain) | F.endswith(host, F.concat(F.lit("."), domain))


def looks_random(label: Column) -> Column:
    """Whether a label of five characters or more changes between letters and digits twice or more."""
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(label, r"[^\p{L}\p{N}]", ""), r"\p{N}+", "0"), r"\p{L}+", "a")
    return (F.length(label) >= 5) & (F.length(kinds) >= 3)


def detokenize(text: Column) -> Column:
    """Without spaces but between two letters or digits of ASCII."""
    return F.regexp_replace(F.regexp_replace(text, r"(^|[^A-Za-z0-9]) +", "$1"), r" +([^A-Za-z0-9]|$)", "$1")


def terms_found(text: Column, terms: list[str]) -> Column:
    """The distinct terms in the text, longest first where they overlap, in order of first occurrence."""
    longest = "|".join(re.escape(t.lower()) for t in sorted(terms, key=lambda t: (-len(t), t)))
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({longest})"), 1))


def counts_as_hit(found: Column, weak: list[str]) -> Column:
    """Any strong term, or two distinct weak ones."""
    strong = F.size(F.array_except(found, F.array(*[F.lit(w.lower()) for w in weak]).cast(ArrayType(StringType()))))
    return (strong > 0) | (F.size(found) >= 2)


def repeated_line_fraction(text: Column) -> Column:
    """Characters of non-empty lines that occur more than once, of all characters of lines; 0 for no text.

    Lines are sorted, so that equal ones are neighbours.
    """
    lines = F.array_sort(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip), lambda x: x != ""))

    def share(own: Column) -> Column:
        again = lambda i: (F.get(own, i) == F.get(own, i - 1)) | (F.get(own, i) == F.get(own, i + 1))
        places = F.when(F.size(own) > 0, F.sequence(F.lit(0), F.size(own) - 1)).otherwise(F.array().cast("array<int>"))
        some = F.aggregate(places, F.lit(0), lambda a, i: a + F.when(F.coalesce(again(i), F.lit(False)), F.length(F.get(own, i))).otherwise(0))
        total = F.aggregate(own, F.lit(0), lambda a, x: a + F.length(x))
        return F.when(total > 0, some / total).otherwise(F.lit(0.0))

    return let(lines, share)


def char_grams(text: Column, n: int) -> Column:
    """All n-grams of code points in order; the text is cut into characters once, so long texts cost no more by character."""
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - n + 1), lambda i: F.array_join(F.slice(c, i, F.lit(n)), ""))
    none = F.array().cast("array<string>")
    return F.when(F.length(text) >= n, let(F.split(text, ""), grams)).otherwise(none)


def left_window(text: Column, chars: int = 64) -> Column:
    """The last ``chars`` characters, cut after the last sentence end inside them."""
    tail = F.right(text, F.lit(chars))
    return F.regexp_replace(tail, r"(?s)^.*[。！？!?\n](?=.)", "")


def last_han_run(text: Column) -> Column:
    return F.regexp_extract(text, r"(\p{IsHan}+)$", 1)


def to_hiragana(text: Column) -> Column:
    return F.translate(text, KATAKANA, HIRAGANA)


def redact(text: Column, secrets: list[str], sign: str = "[secret]") -> Column:
    """Each secret replaced, longer ones first."""
    if not secrets:
        return text
    return F.regexp_replace(text, "|".join(re.escape(s) for s in sorted(secrets, key=lambda s: (-len(s), s))), sign)


def length_bucket(n: Column, limits: list[tuple[int, str]], rest: str) -> Column:
    out = None
    for limit, name in limits:
        out = F.when(n <= limit, name) if out is None else out.when(n <= limit, name)
    return out.otherwise(rest)


def best_cer(text: Column, references: Column) -> Column:
    """The smallest edit distance to a reference by its length."""
    return F.array_min(F.transform(references, lambda r: F.levenshtein(text, r) / F.greatest(F.length(r), F.lit(1))))


def hash_fraction(*key: Column) -> Column:
    """A number in [0, 1) from the first 16 hex digits of sha256 of the joined key."""
    digits = F.substring(F.sha2(F.concat(*key), 256), 1, 16)
    return F.conv(digits, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(18446744073709551616.0)

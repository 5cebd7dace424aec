"""Segmentation of text: sentences, line joins, chunks and spans. The stateful scans run in Arrow batches and read each
text once; a paragraph is read again for each line that joins it, within ``max_chars``."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

#: Brackets that belong together, signs that end a sentence, where a web address ends, words that tell that a
#: line goes on, and marks of list items.
BRACKETS = {"「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "【": "】", "“": "”"}
ENDS = "。！？!?"
ADDRESS = r"https?://[^\s「」『』（）()\[\]【】“”。！？]+"
CONTINUES = ("のが", "のを", "ので", "のに", "なくて", "して", "ながら", "という", "による", "であり", "ても", "は", "が", "を", "に", "と", "や", "の", "し", "も")
CARRIES_ON = ("を", "について", "によって", "として")
LIST_ITEM = re.compile(r"^(?:[-*・●■◆◇]\s*|[0-9０-９]+[.)．、])")
ACTIONS = ("keep", "drop", "review")

_CLOSERS = "".join(BRACKETS.values())
_SIGNS = re.compile(rf"(?P<address>{ADDRESS})|(?P<end>[{ENDS}]+)|(?P<open>[{re.escape(''.join(BRACKETS))}])|(?P<shut>[{re.escape(_CLOSERS)}])|(?P<line>[\r\n]+)")
SENTENCE = StructType([StructField("text", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("terminated", BooleanType()), StructField("flags", ArrayType(StringType()))])


class Scan:
    """Reads text piece by piece and knows which brackets are open and whether any was closed unopened."""

    def __init__(self):
        self.open: list[str] = []
        self.bad = False
        self._address = ""  # an address at the end may go on in the next piece

    def feed(self, text: str) -> Scan:
        for m in _SIGNS.finditer(self._address + text):
            if m.lastgroup == "open":
                self.open.append(BRACKETS[m.group()])
            elif m.lastgroup == "shut":
                if self.open and self.open[-1] == m.group():
                    self.open.pop()
                else:
                    self.bad = True
            if m.end() == len(self._address) + len(text):
                self._address = m.group() if m.lastgroup == "address" else ""
                return self
        self._address = ""
        return self


def split_sentences(text: str | None) -> list[tuple[str, int, int, bool, list[str]]]:
    """Sentences ``(text, start, end, terminated, flags)`` with offsets of their trimmed text.

    A run of ending signs closes a sentence where no bracket is open; signs inside web addresses do not count. A line
    end closes what stands before it. Flags: ``unmatched_closing_bracket``, and ``unclosed_bracket`` for the last sentence
    of a line. What is left at a line's end counts as terminated if an ending sign stands there, before closing brackets or not.
    """
    out: list[tuple[str, int, int, bool, list[str]]] = []
    stack: list[str] = []
    flags: set[str] = set()
    start = 0

    def close(end: int, terminated: bool | None) -> None:
        nonlocal start, flags, stack
        piece = text[start:end]
        if terminated is None:
            if stack:
                flags.add("unclosed_bracket")
                stack = []
            terminated = piece.strip().rstrip(_CLOSERS).rstrip()[-1:] in tuple(ENDS)
        body = piece.strip()
        if body:
            at = start + len(piece) - len(piece.lstrip())
            out.append((body, at, at + len(body), terminated, sorted(flags)))
        start, flags = end, set()

    for m in _SIGNS.finditer(text or ""):
        kind = m.lastgroup
        if kind == "open":
            stack.append(BRACKETS[m.group()])
        elif kind == "shut":
            if stack and stack[-1] == m.group():
                stack.pop()
            else:
                flags.add("unmatched_closing_bracket")
        elif kind == "end" and not stack:
            close(m.end(), True)
        elif kind == "line":
            close(m.start(), None)
    if text:
        close(len(text), None)
    return out


def join_reason(left: str, right: str) -> str | None:
    """Why two neighbouring lines are one; null if they are not. List items never join, on either side; an open bracket
    joins only lines that close it and leave nothing flagged."""
    if not left or not right or LIST_ITEM.match(left) or LIST_ITEM.match(right):
        return None
    last = split_sentences(left)
    if not last:
        return None
    *_, terminated, flags = last[-1]
    if "unclosed_bracket" in flags:
        return None if any(f for *_, f in split_sentences(left + right)) else "unclosed_bracket"
    if terminated:
        return None
    if left.endswith(("、", "，", ",")):
        return "trailing_comma"
    if left.endswith(CONTINUES):
        return "continuation_suffix"
    if right.startswith(CARRIES_ON):
        return "continuation_prefix"
    return None


def glue(left: str, right: str) -> str:
    """A space between two letters or digits of ASCII, else nothing."""
    a, b = left[-1:], right[:1]
    return " " if a.isascii() and a.isalnum() and b.isascii() and b.isalnum() else ""


def closes_ahead(left: str, blocks: list[tuple[str, int, str, str]], at: int, max_chars: int = 2048, decisions: dict | None = None) -> bool:
    """Whether the brackets that ``left`` leaves open are closed, without another flag, by blocks from ``at`` on.

    Blocks are ``(id, line_index, text, action)``. The look ahead ends at a gap of lines, a block that is not kept, a list
    item, a boundary decided ``separate``, or ``max_chars``; it reads each block once.
    """
    scan, size, last, line = Scan().feed(left), len(left), left, blocks[at][1] - 1
    for n in range(at, len(blocks)):
        name, index, text, action = blocks[n]
        text = text.strip()
        if decisions and n and decisions.get((blocks[n - 1][0], name)) == "separate":
            return False
        if index != line + 1 or action != "keep" or not text or LIST_ITEM.match(text):
            return False
        between = glue(last, text)
        size += len(between) + len(text)
        if size > max_chars:
            return False
        scan.feed(between + text)
        if scan.bad:
            return False
        if not scan.open:
            return True
        line, last = index, text
    return False


def restore_linebreaks(blocks: list[tuple[str, int, str, str]], max_chars: int = 2048, decisions: dict | None = None) -> list[dict]:
    """Paragraphs of joined blocks ``(id, line_index, text, action)``: ``{text, parts, joins, flags}``.

    ``parts`` are ``(block_id, start, end)`` in the paragraph, ``joins`` are ``(left_block, right_block, reason)``.
    ``decisions`` maps pairs of block ids to ``join`` or ``separate``, which go before the rules; a join decided over a
    list item or beyond ``max_chars`` is refused, as are unknown actions and decisions and lines out of order.
    A paragraph that would have grown beyond ``max_chars`` is flagged ``join_length_limit``.
    """
    decisions = decisions or {}
    if set(decisions.values()) - {"join", "separate"}:
        raise ValueError("a boundary decision is neither join nor separate")
    out: list[dict] = []
    now: dict | None = None
    line: int | None = None
    for n, (name, index, text, action) in enumerate(blocks):
        if not isinstance(index, int) or index < 0 or line is not None and index <= line:
            raise ValueError("lines are not in strictly increasing order")
        if action not in ACTIONS:
            raise ValueError(f"unknown action {action}")
        if line is not None and index != line + 1:
            now = None
        line, text = index, text.strip()
        if action != "keep" or not text:
            now = None
            continue
        reason = None
        if now:
            decided = decisions.get((now["parts"][-1][0], name))
            listed = LIST_ITEM.match(now["text"]) or LIST_ITEM.match(text)
            if decided == "join":
                if listed:
                    raise ValueError("a decided join crosses a list item")
                reason = "approved_annotation"
            elif decided is None:
                reason = join_reason(now["text"], text)
                if reason is None and not listed and "unclosed_bracket" in split_sentences(now["text"])[-1][4] and closes_ahead(now["text"], blocks, n, max_chars, decisions):
                    reason = "unclosed_bracket"
            between = glue(now["text"], text) if reason else ""
            if reason and len(now["text"]) + len(between) + len(text) > max_chars:
                if decided == "join":
                    raise ValueError("a decided join exceeds max_chars")
                now["flags"].append("join_length_limit")
                reason = None
        if reason:
            at = len(now["text"]) + len(between)
            now["joins"].append((now["parts"][-1][0], name, reason))
            now["text"] += between + text
            now["parts"].append((name, at, at + len(text)))
        else:
            now = {"text": text, "parts": [(name, 0, len(text))], "joins": [], "flags": []}
            out.append(now)
    return out


def lines_as_blocks(text: str | None) -> list[tuple[str, int, str, str]]:
    """Every line as a kept block; blocks are named ``b000``, ``b001`` and so on."""
    return [(f"b{i:03d}", i, x, "keep") for i, x in enumerate((text or "").split("\n"))]


def chunks(text: str | None, max_chars: int = 1024, min_chars: int = 24, min_share: float = 0.2) -> list[str]:
    """Chunks of whole sentences of at most ``max_chars``; longer sentences are cut. Texts with broken characters,
    short lines of navigation and chunks with few letters of Han or Kana give nothing."""
    if not text or "�" in text:
        return []
    kept = "\n".join(x for x in text.split("\n") if len(x.strip()) >= 8)
    out, now = [], ""
    for s, *_ in split_sentences(kept):
        for piece in (s[i : i + max_chars] for i in range(0, len(s), max_chars)):
            if len(now) + len(piece) > max_chars:
                out.append(now)
                now = ""
            now += piece
    out.append(now)
    ours = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
    return [c for c in out if len(c) >= min_chars and len(ours.findall(c)) >= min_share * len(c)]


def array_udf(f: Callable, kind) -> Callable[[Column], Column]:
    """An Arrow-batched column function from ``f(value) -> list``."""
    @F.pandas_udf(ArrayType(kind) if not isinstance(kind, ArrayType) else kind)
    def over(values: pd.Series) -> pd.Series:
        return values.map(f)

    return over


sentences = array_udf(lambda x: [{"text": t, "start": s, "end": e, "terminated": d, "flags": g} for t, s, e, d, g in split_sentences(x)], SENTENCE)
text_chunks = array_udf(chunks, StringType())
PARAGRAPH = StructType([StructField("text", StringType()), StructField("lines", IntegerType()), StructField("joins", StringType()), StructField("flags", StringType())])
paragraphs = array_udf(lambda x: [{"text": p["text"], "lines": len(p["parts"]), "joins": ",".join(j[2] for j in p["joins"]), "flags": ",".join(p["flags"])} for p in restore_linebreaks(lines_as_blocks(x))], PARAGRAPH)


def clip_spans(start: Column, end: Column, parts: Column) -> Column:
    """Where a sentence ``[start, end)`` lies in the blocks of its paragraph: offsets relative to each block."""
    lo = lambda p: F.greatest(start, p["start"])
    hi = lambda p: F.least(end, p["end"])
    return F.transform(F.filter(parts, lambda p: lo(p) < hi(p)), lambda p: F.struct(p["block_id"].alias("block_id"), (lo(p) - p["start"]).alias("start"), (hi(p) - p["start"]).alias("end")))


class Dictionary:
    """Words with readings and weights, for segmentation. Rows: ``(word, reading, weight)``."""

    def __init__(self, rows: list[tuple[str, str, float]]):
        self.best: dict[str, tuple[float, str]] = {}
        for word, reading, weight in rows:
            if word and (word not in self.best or weight > self.best[word][0]):
                self.best[word] = (weight, reading)
        self.longest = max(map(len, self.best), default=1)

    def segment(self, text: str, unknown: float = -20.0) -> list[str]:
        """The segmentation of the largest total weight; unknown characters cost ``unknown``; ties take longer words."""
        import math

        score, back = [0.0] + [-math.inf] * len(text), [0] * (len(text) + 1)
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - self.longest), end):
                word = text[start:end]
                w = math.log(self.best[word][0]) if word in self.best and self.best[word][0] > 0 else unknown if end - start == 1 else None
                if w is not None and score[start] + w > score[end]:
                    score[end], back[end] = score[start] + w, start
        out, at = [], len(text)
        while at:
            out.append(text[back[at] : at])
            at = back[at]
        return out[::-1]

    def paths(self, text: str, k: int, unknown: float = -20.0) -> list[tuple[float, list[str]]]:
        """The ``k`` best segmentations, best first; equal scores in order of their words."""
        import math

        best: list[list[tuple[float, list[str]]]] = [[] for _ in range(len(text) + 1)]
        best[0] = [(0.0, [])]
        for end in range(1, len(text) + 1):
            found = []
            for start in range(max(0, end - self.longest), end):
                word = text[start:end]
                w = math.log(self.best[word][0]) if word in self.best and self.best[word][0] > 0 else unknown if end - start == 1 else None
                if w is not None:
                    found += [(s + w, [*p, word]) for s, p in best[start]]
            best[end] = sorted(found, key=lambda x: (-x[0], x[1]))[:k]
        return best[-1]


def greedy_phrases(text: str, words: frozenset[str], longest: int) -> Iterator[str]:
    """Longest known words from the left; unknown characters alone."""
    at = 0
    while at < len(text):
        n = next((n for n in range(min(longest, len(text) - at), 1, -1) if text[at : at + n] in words), 1)
        yield text[at : at + n]
        at += n


def agreed_phrases(text: str, first: Dictionary, second: Dictionary) -> list[tuple[str, str | None]]:
    """Phrases from the left, each the longest that both dictionaries know with the same reading, with that reading; a character for
    which there is none stands alone, without reading."""
    out: list[tuple[str, str | None]] = []
    at = 0
    while at < len(text):
        for n in range(min(first.longest, second.longest, len(text) - at), 0, -1):
            word = text[at : at + n]
            if word in first.best and word in second.best and first.best[word][1] == second.best[word][1]:
                out.append((word, first.best[word][1]))
                break
        else:
            n = 1
            out.append((text[at], None))
        at += n
    return out


def candidate_spans(text: str, least: int = 2, most: int = 12) -> list[tuple[int, int, str]]:
    """Runs of Han letters that end a clause, cut to ``most`` letters from the right; runs beside digits are left out."""
    out = []
    for m in re.finditer(r"[㐀-鿿豈-﫿]+(?=[、。，！？!?]|$)", text or ""):
        s = max(m.start(), m.end() - most)
        if m.end() - s >= least and not (s and text[s - 1].isdigit()):
            out.append((s, m.end(), text[s : m.end()]))
    return out

"""Searches over a scorer: next characters of a counted model, beams of continuations, keys to words, and typing.

Everything here works on plain Python values inside Arrow batches; many requests go through a step together, and equal
histories are scored once for all of them. Ties are broken by the text, so results do not depend on batches.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import math
from collections import Counter
from collections.abc import Callable, Iterable
from typing import Protocol

from corpusmill.functions.keys import draw

SEPARATOR, UNKNOWN = "\x02", "\x01"


class NextScorer(Protocol):
    """What a search needs: the likeliest next pieces of a history with their log shares, best first, and the log share of one piece."""

    def likeliest(self, history: str, n: int) -> list[tuple[str, float]]: ...

    def log_share(self, history: str, piece: str) -> float: ...


class CountedModel:
    """A counted model in memory: ``grams`` of rows (level, ctx, ch, n), and the known characters. Each answer is exact: characters that
    no context holds follow in the order of their unigram share."""

    def __init__(self, grams: Iterable[tuple[int, str, str, int]], discounts: dict[int, float], known: Iterable[str]):
        self.discounts, self.order, self.known = discounts, max(discounts), frozenset(known)
        self.vocabulary = len(self.known) + 1
        self.followers: dict[tuple[int, str], dict[str, int]] = {}
        for level, ctx, ch, n in grams:
            self.followers.setdefault((level, ctx), {})[ch] = n
        self.totals = {k: sum(v.values()) for k, v in self.followers.items()}
        first = self.followers.get((1, ""), {})
        self._common = sorted((c for c in self.known if c != SEPARATOR), key=lambda c: (-first.get(c, 0), c))
        self._answers: dict = {}

    def _share(self, history: str, ch: str) -> float:
        first, d = self.followers.get((1, ""), {}), self.discounts[1]
        total = self.totals.get((1, ""), 0)
        p = d * len(first) / total / self.vocabulary + max(first.get(ch, 0) - d, 0) / total if total else 1 / max(1, self.vocabulary)
        for level in range(2, self.order + 1):
            if len(history) < level - 1:
                break
            own = self.followers.get((level, history[len(history) - level + 1 :]))
            if own:
                d, total = self.discounts[level], self.totals[level, history[len(history) - level + 1 :]]
                p = p * (d * len(own) / total) + max(own.get(ch, 0) - d, 0) / total
        return p

    def log_share(self, history: str, piece: str) -> float:
        out = 0.0
        history = SEPARATOR + "".join(c if c in self.known else UNKNOWN for c in history[-(self.order - 1) :])
        for c in piece:
            c = c if c in self.known else UNKNOWN
            out += math.log(self._share(history[-(self.order - 1) :], c))
            history += c
        return out

    def likeliest(self, history: str, n: int) -> list[tuple[str, float]]:
        history = "".join(c if c in self.known else UNKNOWN for c in history[-(self.order - 1) :])
        history = (SEPARATOR + history)[-(self.order - 1) :]
        key = (history, n)
        if key not in self._answers:
            seen = {c for level in range(2, self.order + 1) if len(history) >= level - 1 for c in self.followers.get((level, history[len(history) - level + 1 :]), {})} - {UNKNOWN, SEPARATOR}
            rest, found = n, []
            for c in self._common:
                if not rest:
                    break
                if c not in seen:
                    found.append(c)
                    rest -= 1
            scored = [(c, math.log(self._share(history, c))) for c in [*seen, *found]]
            if len(self._answers) > 100_000:
                self._answers.clear()
            self._answers[key] = heapq.nsmallest(n, scored, key=lambda x: (-x[1], x[0]))
        return self._answers[key]


def continuations(scorer: NextScorer, contexts: list[str], steps: int, width: int, keep: Callable[[str], bool] | None = None) -> list[list[tuple[str, float]]]:
    """The ``width`` likeliest continuations of ``steps`` pieces of each context, in lockstep over all of them.

    ``keep`` rejects pieces, such as those that are no letters; a hypothesis without admitted pieces stays as it is.
    """
    paths = [[("", 0.0)] for _ in contexts]
    for _ in range(steps):
        asked = {c + text for c, own in zip(contexts, paths, strict=True) for text, _ in own}
        known = {}
        for h in asked:
            n = width
            found = [x for x in scorer.likeliest(h, n) if not keep or keep(x[0])]
            while keep and len(found) < width and n < 4096:  # rejected ones make room for less likely ones
                n *= 4
                found = [x for x in scorer.likeliest(h, n) if keep(x[0])][:width]
            known[h] = found
        for i, own in enumerate(paths):
            grown = [(text + c, score + p) for text, score in own for c, p in known[contexts[i] + text]] or own
            paths[i] = heapq.nsmallest(width, grown, key=lambda x: (-x[1], x[0]))
    return paths


def sampled(scorer: NextScorer, context: str, steps: int, temperature: float, seed: int, pool: int = 64) -> str:
    """A continuation drawn from the ``pool`` likeliest pieces of each step, by hashes of the seed and what stands before."""
    out = ""
    for i in range(steps):
        options = scorer.likeliest(context + out, pool)
        if not options:
            break
        noise = lambda c: -math.log(-math.log((draw(1 << 53, seed, i, context, out, c) + 0.5) / (1 << 53)))
        out += max(options, key=lambda x: (x[1] / temperature + noise(x[0]), x[0]))[0]
    return out


def healed(context: str, words: Iterable[str]) -> tuple[str, str]:
    """``(context without its last word, that word)``: the longest word the context ends in is taken back, so that a longer one may be
    chosen that begins with it; ``(context, "")`` if there is none."""
    end = max((w for w in words if w and context.endswith(w)), key=len, default="")
    return (context[: len(context) - len(end)], end) if end else (context, "")


def predicted_words(scorer: NextScorer, contexts: list[str], words: list[str], top: int) -> list[list[tuple[str, float]]]:
    """Words of a dictionary after each context, by log share per character; the last word of the context is healed, and a word
    that is a start of a chosen one, or has one as its start, is left out."""
    out = []
    known: dict[tuple[str, str], list] = {}
    for context in contexts:
        base, start = healed(context, words)
        key = (base[-16:], start)
        if key not in known:
            scored = {w[len(start) :]: scorer.log_share(base, w) / len(w) for w in words if w.startswith(start) and len(w) > len(start)}
            known[key] = diverse(scored, top)
        out.append(known[key])
    return out


def diverse(scored: dict[str, float], top: int) -> list[tuple[str, float]]:
    """The best ``top`` of which none is a start of another; kept by their starts, so each text is looked up by its own length only."""
    out: list[tuple[str, float]] = []
    whole: set[str] = set()
    starts: set[str] = set()  # of what is in ``whole``, itself included
    for text in sorted(scored, key=lambda t: (-scored[t], t)):
        own = {text[:n] for n in range(len(text) + 1)}
        if len(out) < top and text not in starts and not own & whole:
            out.append((text, scored[text]))
            whole.add(text)
            starts |= own
    return out


class KeyIndex:
    """Words by their spellings: every character's syllable whole or by its first letter. Rows ``(word, syllables)``.

    A word of more than ``most`` spellings is skipped and counted in ``skipped``.
    """

    def __init__(self, rows: Iterable[tuple[str, list[str]]], most: int = 64):
        self.words: dict[str, dict[str, int]] = {}
        self.skipped = 0
        for word, syllables in rows:
            forms = {"": 0}
            for s in syllables:
                grown: dict[str, int] = {}
                for keys, n in forms.items():
                    for more, extra in ((s, 0), (s[:1], int(len(s) > 1))):
                        grown[keys + more] = min(n + extra, grown.get(keys + more, n + extra))
                forms = grown
                if len(forms) > most:
                    break
            if len(forms) > most or not syllables:
                self.skipped += 1
                continue
            for keys, n in forms.items():
                own = self.words.setdefault(keys, {})
                own[word] = min(n, own.get(word, n))
        self.longest = max(map(len, self.words), default=0)

    def reachable(self, keys: str) -> set[int]:
        """The places from which on the keys can be words, the end among them."""
        good = {len(keys)}
        for start in reversed(range(len(keys))):
            if any(end - start <= self.longest and keys[start:end] in self.words for end in good):
                good.add(start)
        return good


def typed(scorer: NextScorer, index: KeyIndex, keys: str, context: str = "", beam: int = 16, top: int = 10, short_cost: float = 1.0) -> list[tuple[str, float]]:
    """The likeliest texts that the keys spell, best first: hypotheses wait at the key they have reached and the best ``beam`` of each
    place go on; a syllable typed by its first letter costs ``short_cost``. Keys that no words spell give nothing."""
    good = index.reachable(keys)
    if not keys or 0 not in good:
        return []
    waiting: list[dict[str, float]] = [{} for _ in range(len(keys) + 1)]
    waiting[0][""] = 0.0
    for p in range(len(keys)):
        for text, score in heapq.nsmallest(beam, waiting[p].items(), key=lambda x: (-x[1], x[0])):
            for e in sorted(e for e in good if 0 < e - p <= index.longest):
                for word, n in index.words.get(keys[p:e], {}).items():
                    value = score + scorer.log_share(context + text, word) - short_cost * n
                    if value > waiting[e].get(text + word, -math.inf):
                        waiting[e][text + word] = value
    return heapq.nsmallest(top, waiting[-1].items(), key=lambda x: (-x[1], x[0]))


def simulate(message: str, costs: list[int], ends: list[int], predictions: Callable[[int], list[tuple[str, float]]], threshold: float, show: int = 3) -> dict[str, int]:
    """What it takes to type a message with predictions: ``pressed`` keys, ``plain`` keys without any, ``offers`` shown and ``taken``.

    From the first commit on, up to ``show`` predictions of the threshold or more stand ready at every commit; the longest that fits is
    taken with one key. Where none fits, the word goes in full. ``costs`` are keys by character, ``ends`` the ends of the words in order.
    """
    upto = list(itertools.accumulate(costs, initial=0))
    tally = Counter(plain=upto[-1])
    spot = 0
    while spot < len(message):
        shown = [text for text, score in (predictions(spot) if spot else [])[:show] if score >= threshold]
        gain = max((len(x) for x in shown if message[spot : spot + len(x)] == x), default=0)
        following = spot + gain if gain else ends[bisect.bisect_right(ends, spot)]
        tally.update(offers=1 if shown else 0, taken=1 if gain else 0, pressed=1 if gain else upto[following] - upto[spot])
        spot = following
    return {k: tally[k] for k in ("pressed", "plain", "offers", "taken")}

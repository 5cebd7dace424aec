"""Plain forms of folding and similarity, for brute force."""

import re
import unicodedata


def plain_fold(text):
    return re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", text or "").lower())


def grams3(folded):
    return {folded[i : i + 3] for i in range(len(folded) - 2)}


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0

"""The first decision on a web document: keep, review or drop, with every reason, from its text and its host.

All of it is JVM expressions; the rules are small literal lists, read once by the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.functions.text import WS, counts_as_hit, in_domain, length_of, repeated_line_fraction, terms_found

#: The letters that count as Han here.
NOT_HAN = r"[^㐀-䶿一-鿿豈-﫿]"
OFFICIAL = (".gov.cn", ".edu.cn")


@dataclass(frozen=True)
class Rules:
    """Terms with their category, the weak ones among them, and hosts: blocked top-level domains, domains to drop
    (``tier1``) or review (``tier2``), and strings that no host may hold."""

    terms: dict[str, str]
    weak: frozenset[str] = frozenset()
    tlds: frozenset[str] = frozenset()
    tier1: tuple[str, ...] = ()
    tier2: tuple[str, ...] = ()
    host_terms: tuple[str, ...] = ()


@dataclass(frozen=True)
class Script:
    """A conversion between scripts: glyphs one to one, and phrases that go before them."""

    glyphs: str = ""
    converted: str = ""
    phrases: dict[str, str] = field(default_factory=dict)

    def convert(self, text: Column) -> Column:
        for a, b in sorted(self.phrases.items(), key=lambda x: (-len(x[0]), x[0])):
            text = F.replace(text, F.lit(a), F.lit(b))
        return F.translate(text, self.glyphs, self.converted) if self.glyphs else text

    def share(self, text: Column, han: Column) -> Column:
        """Convertible glyphs by Han letters."""
        found = F.length(text) - F.length(F.translate(text, self.glyphs, "")) if self.glyphs else F.lit(0)
        return found / F.greatest(han, F.lit(1))


@dataclass(frozen=True)
class Thresholds:
    min_han: int = 100
    min_han_share: float = 0.4
    max_repeated_lines: float = 0.3
    converted: float = 0.08


def in_domains(host: Column, domains: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for d in domains:
        out = out | in_domain(host, F.lit(d))
    return out


def _official(host: Column) -> Column:
    return F.endswith(host, F.lit(OFFICIAL[0])) | F.endswith(host, F.lit(OFFICIAL[1]))


def host_term(host: Column, rules: Rules) -> Column:
    found = F.lit(False)
    for k in rules.host_terms:
        found = found | host.contains(k)
    return found & ~_official(host)


def fake_official(host: Column) -> Column:
    """A host that holds an official ending but does not end in one."""
    return (host.contains(OFFICIAL[0] + ".") | host.contains(OFFICIAL[1] + ".")) & ~_official(host)


def classify(df: DataFrame, rules: Rules, text: str = "text", host: str = "host", script: Script | None = None, limits: Thresholds | None = None) -> DataFrame:
    """The rows with ``text`` converted where it is in the other script, and ``script``, ``decision``, ``reasons``, ``hits``, ``han``.

    Reasons to drop come first, then those to review. A null host breaks no host rule; a null text is an empty one.
    """
    script, limits = script or Script(), limits or Thresholds()
    h, x = F.coalesce(F.col(host), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("han", length_of(x, NOT_HAN))
    df = df.withColumn("script", F.when(script.share(x, F.col("han")) > limits.converted, "hant").otherwise("hans"))
    df = df.withColumn(text, F.when(F.col("script") == "hant", script.convert(x)).otherwise(F.col(text)))
    x = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("hits", terms_found(x, list(rules.terms))).withColumn("_solid", length_of(x, WS)).withColumn("_again", repeated_line_fraction(x))
    category = F.create_map(*[F.lit(v) for t, c in rules.terms.items() for v in (t, c)]) if rules.terms else F.create_map()
    named = F.array_sort(F.array_distinct(F.transform("hits", lambda t: F.concat(F.lit("term_"), category[t])))) if rules.terms else F.array().cast("array<string>")
    hit = counts_as_hit(F.col("hits"), sorted(rules.weak))
    some = lambda *pairs: F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in pairs]))
    short = F.col("han") < limits.min_han
    drop = F.concat(
        some(("tld", F.element_at(F.split(h, r"\."), -1).isin(*sorted(rules.tlds) or [""]) & (h != "")), ("domain_tier1", in_domains(h, rules.tier1)), ("host_term", host_term(h, rules)), ("fake_gov", fake_official(h))),
        F.when(hit, named).otherwise(F.array().cast("array<string>")),
        some(("short", short), ("low_han", ~short & (F.col("han") < F.col("_solid") * F.lit(limits.min_han_share))), ("repetitive", F.col("_again") > limits.max_repeated_lines)),
    )
    review = some(("weak_term", (F.size("hits") > 0) & ~hit), ("domain_tier2", in_domains(h, rules.tier2)))
    df = df.withColumn("_drop", drop).withColumn("_review", review)
    decision = F.when(F.size("_drop") > 0, "drop").when(F.size("_review") > 0, "review").otherwise("keep")
    return df.withColumn("decision", decision).withColumn("reasons", F.concat("_drop", "_review")).drop("_drop", "_review", "_solid", "_again")

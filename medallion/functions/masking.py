"""Ordered regex masking with per-type counts, as native expressions.

Each pattern counts its matches on the text the earlier patterns already changed and then replaces
them.  Texts without the literal every match must contain skip the regex, and unchanged texts are not
rebuilt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import MASKED_THRESHOLD, PII_PATTERNS
from .text import computed_once, let


def _step(pattern: str, replacement: str, literal: str | None):
    """One pattern on ``(text, found)``: its count is appended, its matches are replaced."""
    regex = F.lit("(?U)" + pattern)

    def apply(state: Column) -> Column:
        found = F.regexp_count(state["text"], regex)
        if literal:
            found = F.when(F.contains(state["text"], F.lit(literal)), found).otherwise(F.lit(0))
        return let(
            found,
            lambda n: F.struct(
                F.when(n > 0, F.regexp_replace(state["text"], regex, F.lit(replacement)))
                .otherwise(state["text"])
                .alias("text"),
                F.concat(state["found"], F.array(n)).alias("found"),
            ),
        )

    return apply


def masking(text: Column, patterns=PII_PATTERNS) -> Column:
    """Struct of the masked ``text`` and the counts ``found`` in the order of the patterns.

    A pattern is ``(type, regex, replacement)``, with a fourth item if every match contains that literal.
    """
    state = F.struct(text.alias("text"), F.array().cast("array<int>").alias("found"))
    for _, pattern, replacement, *literal in patterns:
        state = let(state, _step(pattern, replacement, literal[0] if literal else None))
    return state


def mask_text(
    df: DataFrame,
    text: str,
    masked: str = "masked_content",
    counts: str = "pii_pattern_types",
    patterns=PII_PATTERNS,
) -> DataFrame:
    """Add the masked text and a ``{type: count}`` map that holds only the types that were found."""
    keep = [c for c in df.columns if c not in (masked, counts)]
    kinds = F.array(*[F.lit(p[0]) for p in patterns])

    def result(state: Column) -> Column:
        pairs = F.zip_with(kinds, state["found"], lambda k, n: F.struct(k.alias("key"), n.alias("value")))
        types = F.map_from_entries(F.filter(pairs, lambda e: e["value"] > 0))
        return F.struct(state["text"].alias(masked), types.alias(counts))

    return computed_once(df, keep, let(masking(F.col(text), patterns), result))


def detection_count(counts: Column | str) -> Column:
    """Sum of all counts of one document."""
    return F.aggregate(F.map_values(counts), F.lit(0), lambda acc, n: acc + F.coalesce(n, F.lit(0)))


def masked_flag(total: Column | str, threshold: int = MASKED_THRESHOLD) -> Column:
    """A label only: the text is masked whatever the flag says."""
    total = F.col(total) if isinstance(total, str) else total
    return total >= F.lit(threshold)


def merged_counts(first: Column | str, second: Column | str) -> Column:
    """Add two count maps; keys of either side stay, also with count 0."""
    return F.map_zip_with(
        first, second, lambda _, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    )


def mask_documents(df: DataFrame, text: str, method: str = "regex") -> DataFrame:
    """Masked text, counts, total, flag and method: the Silver masking contract."""
    return (
        mask_text(df, text)
        .withColumn("pii_detection_count", detection_count("pii_pattern_types"))
        .withColumn("is_masked", masked_flag("pii_detection_count"))
        .withColumn("masking_method", F.lit(method))
    )

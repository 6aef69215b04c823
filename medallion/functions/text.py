"""Text, date and number helpers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def computed_once(df: DataFrame, keep: list[str] | list[Column], values: Column) -> DataFrame:
    """``keep`` and the fields of the struct ``values`` as columns, computed once per row.

    The optimizer writes the definition of a column into every filter and projection above it, so a costly
    one (JSON, regex) would run once per use.  It does not look through a generator.
    """
    return df.select(*keep, F.inline_outer(F.array(values)))


# What counts as white space at the ends of a text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it: a lambda variable
    is never written out again the way a named column is."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column | str) -> Column:
    """Remove Unicode white space at both ends; looks at the ends only, whatever the length."""
    return F.btrim(_c(text), F.lit(WHITE_SPACE))


def run_starts(ordered: Column) -> Column:
    """Indexes at which a new value begins in a sorted array."""
    return F.filter(
        F.sequence(F.lit(0), F.greatest(F.size(ordered) - 1, F.lit(0))),
        lambda i: (F.size(ordered) > 0) & ((i == 0) | (F.get(ordered, i - 1) != F.get(ordered, i))),
    )


def term_counts(terms: Column) -> Column:
    """``array<(term, tf)>`` of an array of terms, from the runs of the sorted array; no shuffle."""
    return let(
        F.sort_array(terms),
        lambda s: let(
            run_starts(s),
            lambda starts: F.transform(
                starts,
                lambda x, j: F.struct(
                    F.get(s, x).alias("term"), (F.coalesce(F.get(starts, j + 1), F.size(s)) - x).alias("tf")
                ),
            ),
        ),
    )


def mapped(code: Column | str, mapping: Mapping[str, str], default: Column | str | None) -> Column:
    """Look a code up in a fixed map; ``default`` for anything else, NULL included."""
    key = _c(code)
    result = None
    for source, target in mapping.items():
        hit = key == F.lit(source)
        result = F.when(hit, F.lit(target)) if result is None else result.when(hit, F.lit(target))
    fallback = F.lit(default) if default is None or isinstance(default, str) else default
    return result.otherwise(fallback)


def duration_ms(start: Column | str, end: Column | str) -> Column:
    """Whole milliseconds between two timestamps or ISO strings (``Z`` accepted); NULL if either is missing.

    The difference is rounded down, not each end.
    """
    micros = F.unix_micros(_c(end).cast("timestamp")) - F.unix_micros(_c(start).cast("timestamp"))
    return F.floor(micros / F.lit(1000)).cast("long")


def duration_seconds(millis: Column | str) -> Column:
    """Milliseconds as seconds, rounded half up."""
    return F.floor(_c(millis) / F.lit(1000.0) + F.lit(0.5)).cast("long")


def signed_difference(a: Column | str, b: Column | str) -> Column:
    """``b - a`` as text with a plus sign for growth; blank when either side is missing."""
    delta = _c(b) - _c(a)
    return (
        F.when(delta.isNull(), F.lit(""))
        .when(delta > 0, F.concat(F.lit("+"), delta.cast("string")))
        .otherwise(delta.cast("string"))
    )


def changed_flag(a: Column | str, b: Column | str, same: str = "동일", changed: str = "변경") -> Column:
    """Same/changed for values that are not numbers; blank when either side is missing."""
    return F.when(_c(a).isNull() | _c(b).isNull(), F.lit("")).when(_c(a) == _c(b), F.lit(same)).otherwise(
        F.lit(changed)
    )


def strip_prefix(text: Column | str, prefix: str) -> Column:
    value = _c(text)
    return F.when(value.startswith(prefix), F.substring(value, len(prefix) + 1, 2**31 - 1)).otherwise(value)


def l2_normalised(vector: Column | str) -> Column:
    """Vector divided by its length; the zero vector stays zero."""
    v = _c(vector)
    squares = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.when(squares == 0.0, F.transform(v, lambda x: x.cast("double"))).otherwise(
        F.transform(v, lambda x: x.cast("double") / F.sqrt(squares))
    )

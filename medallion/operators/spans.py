"""Second masking layer: entity spans from a model job replaced by tags (UDF-1)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import ENTITY_MIN_SCORE, ENTITY_TAGS, SPAN_MASKING_METHOD
from ..functions.masking import detection_count, masked_flag, merged_counts
from ..functions.text import mapped

SPAN_SCHEMA = "entity_type string, start int, `end` int, score double"


def detect_spans(
    docs: DataFrame, doc_id: str, text: str, detector: Callable[[], Callable[[pd.Series], list]]
) -> DataFrame:
    """Spans of every document.  ``detector`` builds the model once per partition; the model maps a series
    of texts to one list of ``(entity_type, start, end, score)`` per text.

    A batch that fails is tried again text by text, so one bad text costs no other its spans.  A text that fails, and
    each text where the model can't be built, gives one row with a NULL ``entity_type``: masking leaves the text as it
    is, and those rows tell which texts no model has seen.
    """
    id_type = dict(docs.dtypes)[doc_id]

    def attempt(model, texts: pd.Series) -> list | None:
        try:
            found = [[(str(kind), int(start), int(end), float(score)) for kind, start, end, score in spans] for spans in model(texts)]
        except Exception:
            return None
        return found if len(found) == len(texts) else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            model = detector()
        except Exception:
            model = None
        for batch in batches:
            texts = batch[text]
            found = attempt(model, texts)
            if found is None:
                unseen = [[(None, None, None, None)]]
                found = [(attempt(model, texts.iloc[i:i + 1]) or unseen)[0] for i in range(len(texts))]
            rows = [(key, *span) for key, spans in zip(batch[doc_id], found, strict=True) for span in spans]
            made = pd.DataFrame(rows, columns=[doc_id, "entity_type", "start", "end", "score"])
            yield made.astype({"entity_type": object, "start": "Int32", "end": "Int32", "score": float})

    return docs.select(doc_id, text).mapInPandas(run, f"`{doc_id}` {id_type}, {SPAN_SCHEMA}")


def _hits(tag: str):
    """Number of spans with the tag."""
    return F.aggregate(
        F.filter("_spans", lambda span: span["tag"] == tag), F.lit(0), lambda total, span: total + span["n"]
    )


def mask_spans(
    docs: DataFrame,
    spans: DataFrame | None,
    doc_id: str,
    text: str = "masked_content",
    counts: str = "pii_pattern_types",
    tags=ENTITY_TAGS,
    min_score: float = ENTITY_MIN_SCORE,
) -> DataFrame:
    """Replace spans by ``[TAG]`` on top of the regex layer and merge the counts.

    Offsets are 0-based code points, ``end`` exclusive.  Of overlapping spans the earlier, then the longer
    one is replaced; all of them count.  Both tags are always among the counts, also without a model
    (``spans=None``).
    """
    if spans is None:
        joined = docs.withColumn("_spans", F.lit(None).cast("array<struct<start:int,minus_end:int,tag:string,n:int>>"))
    else:
        wanted = spans.withColumn("tag", mapped("entity_type", tags, None)).where(
            F.col("tag").isNotNull() & (F.col("score") >= min_score)
        )
        # Equal spans become one row with their number inside the tasks first, so what is gathered per
        # document is bounded by its text.
        distinct = wanted.groupBy(doc_id, "start", "end", "tag").agg(F.count("*").cast("int").alias("n"))
        span = F.struct("start", (-F.col("end")).alias("minus_end"), "tag", "n")
        per_doc = distinct.groupBy(doc_id).agg(F.sort_array(F.collect_list(span)).alias("_spans"))
        joined = docs.join(per_doc, doc_id, "left")
    empty = F.from_json(F.lit("[]"), "array<struct<start:int,minus_end:int,tag:string,n:int>>")
    step = joined.withColumn("_spans", F.coalesce("_spans", empty))
    found = F.create_map(*[x for tag in dict.fromkeys(tags.values()) for x in (F.lit(tag), _hits(tag))])
    # Greedy left-to-right choice of non-overlapping spans.
    kept = F.aggregate(
        "_spans",
        F.struct(F.lit(0).alias("upto"), empty.alias("kept")),
        lambda acc, s: F.when(
            s["start"] >= acc["upto"],
            F.struct((-s["minus_end"]).alias("upto"), F.concat(acc["kept"], F.array(s)).alias("kept")),
        ).otherwise(acc),
        lambda acc: acc["kept"],
    )
    step = step.withColumn("_kept", kept)
    pieces = F.transform(
        "_kept",
        lambda s, i: F.concat(
            F.substring(
                F.col(text),
                F.coalesce(-F.get(F.col("_kept"), i - 1)["minus_end"], F.lit(0)) + 1,
                s["start"] - F.coalesce(-F.get(F.col("_kept"), i - 1)["minus_end"], F.lit(0)),
            ),
            F.lit("["), s["tag"], F.lit("]"),
        ),
    )
    last_end = F.coalesce(-F.get("_kept", F.size("_kept") - 1)["minus_end"], F.lit(0))
    rebuilt = F.concat(F.array_join(pieces, ""), F.substring(F.col(text), last_end + 1, F.length(F.col(text))))
    return (
        step.withColumn(text, rebuilt)
        .withColumn(counts, merged_counts(counts, found))
        .withColumn("pii_detection_count", detection_count(counts))
        .withColumn("is_masked", masked_flag("pii_detection_count"))
        .withColumn("masking_method", F.lit(SPAN_MASKING_METHOD))
        .drop("_spans", "_kept")
    )

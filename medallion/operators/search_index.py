"""Search index as tables: documents, postings and term statistics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import BM25_B, BM25_K1, DEFAULT_CLASS
from ..functions.text import term_counts
from ..session import materialized, spread_small

TEXT_FIELDS = ("chunk_content", "summary")
KEYWORD_FIELD = "keywords"
# Folders of postings by hash of the term; a search reads those of its terms.
TERM_BUCKETS = 64
# Bits of a role word.
WORD_BITS = 63


def search_documents(rows: DataFrame) -> DataFrame:
    """Search documents with their routing; NULL reads as empty (IDX-1, IDX-2)."""

    def text(name: str) -> Column:
        return F.coalesce(name, F.lit("")).alias(name)

    strings = F.array().cast("array<string>")
    return rows.select(
        "staged_id",
        text("chunk_content"),
        F.coalesce("keywords", strings).alias("keywords"),
        text("summary"),
        text("category"),
        text("pclrty_class"),
        F.coalesce("role_ids", strings).alias("role_ids"),
        F.coalesce("metadata_tags", F.create_map().cast("map<string,string>")).alias("metadata_tags"),
        F.coalesce(F.col("es_field_info.routing"), F.col("pclrty_class"), F.lit(DEFAULT_CLASS)).alias("routing"),
    )


def tokens(text: Column) -> Column:
    """Lower-case Unicode word tokens."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))


def _first() -> Column:
    return F.when(F.col("_i") == 0, 1).otherwise(0).alias("first_of_document")


def role_numbers(documents: DataFrame, known: dict[str, int] | None = None) -> dict[str, int]:
    """A bit for every role of the documents; roles that are ``known`` keep theirs.

    One row per role of the installation comes to the driver, never one per document.
    """
    numbers = dict(known or {})
    if "role_ids" in documents.columns:
        found = documents.select(F.explode("role_ids").alias("role")).where(F.col("role").isNotNull()).distinct().collect()
        for role in sorted(r["role"] for r in found):
            numbers.setdefault(role, len(numbers))
    return numbers


def role_words(numbers: dict[str, int], role_ids: Column) -> Column:
    """Role bitmap of a document: one long per ``WORD_BITS`` roles."""
    if not numbers:
        return F.array().cast("array<bigint>")
    bit = F.map_from_arrays(F.lit(list(numbers)), F.lit(list(numbers.values())))
    bits = F.array_distinct(F.transform(F.coalesce(role_ids, F.array().cast("array<string>")), lambda r: bit[r]))
    words = range(max(numbers.values()) // WORD_BITS + 1)
    one = [F.lit(1 << b).cast("bigint") for b in range(WORD_BITS)]

    def word(w: int) -> Column:
        own = F.filter(bits, lambda b: F.floor(b / WORD_BITS) == w)
        return F.aggregate(own, F.lit(0).cast("bigint"), lambda acc, b: acc.bitwiseOR(F.get(F.array(*one), b % WORD_BITS)))

    return F.array(*[word(w) for w in words])


def shares_role(words: Column, numbers: dict[str, int], roles: Sequence[str]) -> Column:
    """Whether a bitmap has a bit of one of the roles; a role that no document has shares nothing."""
    masks: dict[int, int] = {}
    for role in roles:
        if role in numbers:
            w, b = divmod(numbers[role], WORD_BITS)
            masks[w] = masks.get(w, 0) | 1 << b
    out = F.lit(False)
    for w, mask in masks.items():
        out = out | (F.coalesce(F.get(words, F.lit(w)), F.lit(0)).bitwiseAND(F.lit(mask).cast("bigint")) != 0)
    return out


def _magnitude(n: Column) -> Column:
    return F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("int")


def posting_block(tf: Column, length: Column) -> Column:
    """Postings of a term whose counts and lengths are of one magnitude, so that they weigh about the same."""
    return (_magnitude(tf) * 32 + _magnitude(length)).cast("int")


def postings(
    documents: DataFrame, doc_id: str = "staged_id", fields=TEXT_FIELDS, roles: dict[str, int] | None = None,
) -> DataFrame:
    """``(field, term, doc, tf, length, first_of_document, block, roles)`` of the text fields and of the exact keywords
    (IDX-3, IDX-4).

    Made row by row: a document's term counts never cross a shuffle.  ``roles``: numbers of the roles, from which each
    posting gets its document's role bitmap (IDX-8).
    """
    words = role_words(roles or {}, F.col("role_ids") if "role_ids" in documents.columns else F.lit(None)).alias("roles")
    parts = []
    for name in fields:
        step = documents.select(F.col(doc_id), tokens(F.col(name)).alias("_tokens"), words)
        step = step.select(
            F.lit(name).alias("field"), doc_id, F.size("_tokens").alias("length"), "roles",
            F.posexplode_outer(term_counts(F.col("_tokens"))).alias("_i", "_c"),
        ).where(F.col("_c").isNotNull())
        parts.append(step.select("field", "_c.term", doc_id, "_c.tf", "length", _first(), "roles"))
    if KEYWORD_FIELD in documents.columns:
        exact = documents.select(
            F.lit(KEYWORD_FIELD).alias("field"), doc_id, words, F.posexplode_outer(F.array_distinct(KEYWORD_FIELD)).alias("_i", "term")
        ).where(F.col("term").isNotNull())
        one = F.lit(1)
        parts.append(exact.select("field", "term", doc_id, one.alias("tf"), one.alias("length"), _first(), "roles"))
    parts = [p.withColumn("block", posting_block(F.col("tf"), F.col("length"))) for p in parts]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# What a row of packed postings says of them beside its lists.
_PACKED = ("field", "term", "block", "n", "firsts", "total", "max_tf", "min_length")


def _packed_schema(id_type: str) -> str:
    return (f"field string, term string, block int, n int, firsts int, total bigint, max_tf int, min_length int, "
            f"staged_id array<{id_type}>, tf array<int>, length array<int>, roles array<array<bigint>>")


def _packed(field: pa.Array, term: pa.Array, block, starts, ids, tf, length, roles, firsts) -> pa.RecordBatch:
    """One row per run of postings that begins at ``starts``; the other values are those of the postings."""
    ends = np.append(starts[1:], len(tf))
    offsets = pa.array(np.append(starts, len(tf)), pa.int32())
    ints = [pa.array(v.astype(np.int32)) for v in (
        block, ends - starts, np.add.reduceat(firsts, starts), np.maximum.reduceat(tf, starts), np.minimum.reduceat(length, starts))]
    columns = [field, term, ints[0], ints[1], ints[2], pa.array(np.add.reduceat(tf.astype(np.int64), starts)), ints[3], ints[4]]
    lists = [pa.ListArray.from_arrays(offsets, v) for v in (ids, pa.array(tf.astype(np.int32)), pa.array(length.astype(np.int32)), roles)]
    return pa.RecordBatch.from_arrays([*columns, *lists], names=[*_PACKED, "staged_id", "tf", "length", "roles"])


def _one_chunk(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _pack_terms(fields: Sequence[str]):
    """Packs the terms of the documents of each Arrow batch: a row per field, term and block."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in fields:
                column = batch.column(name)
                terms = column.flatten()
                if not len(terms):
                    continue
                lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                coded, n = _one_chunk(terms.dictionary_encode()), batch.num_rows
                pairs, tf = np.unique(
                    coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + np.repeat(np.arange(n), lengths), return_counts=True)
                code, at = np.divmod(pairs, n)
                length = lengths[at] if name != KEYWORD_FIELD else np.ones(len(at), np.int64)
                block = (np.frexp(tf)[1] - 1) * 32 + np.frexp(length)[1] - 1
                order = np.lexsort((at, block, code))
                code, at, tf, length, block = code[order], at[order], tf[order], length[order], block[order]
                firsts = np.zeros(len(at), np.int64)
                firsts[np.unique(at, return_index=True)[1]] = 1
                starts = np.flatnonzero(np.append(True, (np.diff(code) != 0) | (np.diff(block) != 0)))
                where = pa.array(at)
                yield _packed(
                    pa.array([name] * len(starts), pa.string()), coded.dictionary.take(pa.array(code[starts])).cast(pa.string()), block[starts], starts,
                    batch.column("staged_id").take(where), tf, length, batch.column("roles").take(where), firsts)

    return pack


def packed_postings(documents: DataFrame, roles: dict[str, int] | None = None) -> DataFrame:
    """The ``postings`` of the documents as they are written: lists of one field, term and block, made batch by batch.

    So a shuffle carries terms of a batch, not postings.  ``firsts`` counts the documents whose first posting the row has.
    """
    words = role_words(roles or {}, F.col("role_ids") if "role_ids" in documents.columns else F.lit(None)).alias("roles")
    names = list(TEXT_FIELDS)
    columns = [tokens(F.col(name)).alias(name) for name in names]
    if KEYWORD_FIELD in documents.columns:
        names.append(KEYWORD_FIELD)
        columns.append(F.array_compact(F.array_distinct(KEYWORD_FIELD)).alias(KEYWORD_FIELD))
    return documents.select("staged_id", words, *columns).mapInArrow(_pack_terms(names), _packed_schema(dict(documents.dtypes)["staged_id"]))


def _pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs postings that come sorted by field, term and block."""
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for name in ("field", "term", "block"):
            column = batch.column(name)
            new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new)
        first = pa.array(starts)
        tf, length, block = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tf", "length", "block"))
        yield _packed(
            batch.column("field").take(first), batch.column("term").take(first), block[starts], starts, batch.column("staged_id"), tf, length,
            batch.column("roles"), np.zeros(len(tf), np.int64))


def unpacked(packed: DataFrame) -> DataFrame:
    """A row per posting; only the lists that are asked for are read."""
    lists = ("staged_id", "tf", "length", "roles")
    rows = packed.select("field", "term", "block", "bucket", *lists, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("_i"))
    return rows.select("field", "term", "block", "bucket", *[F.get(c, F.col("_i")).alias(c) for c in lists])


def _packed_bounds(packed: DataFrame) -> DataFrame:
    return packed.groupBy("field", "term", "block").agg(
        F.sum("n").alias("n"), F.max("max_tf").alias("max_tf"), F.min("min_length").alias("min_length"))


def _packed_fields(packed: DataFrame) -> DataFrame:
    sums = packed.groupBy("field").agg(F.sum("firsts").alias("docs"), F.sum("total").alias("total"))
    return sums.where("docs > 0")


def block_bounds(post: DataFrame) -> DataFrame:
    """Per field, term and block: postings, the largest count and the least length.

    A posting's weight grows with its count and falls with its length, whatever the mean length is, so these two
    bound the contribution of every posting of the block (RANK-1).
    """
    return post.groupBy("field", "term", "block").agg(
        F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("length").alias("min_length"))


def contribution(tf: Column, length: Column, avg_length: Column, field: Column) -> Column:
    """BM25 of one posting without the weight of its term; an exact keyword has no length."""
    norm = F.when(field == KEYWORD_FIELD, F.lit(1.0)).otherwise(F.lit(1.0 - BM25_B) + F.lit(BM25_B) * length / avg_length)
    return tf * F.lit(BM25_K1 + 1.0) / (tf + F.lit(BM25_K1) * norm)


def term_statistics(post: DataFrame) -> DataFrame:
    """Document frequency per field and term; counted inside the tasks first, so common terms are cheap."""
    return post.groupBy("field", "term").agg(F.count("*").alias("df"))


def field_statistics(post: DataFrame) -> DataFrame:
    """Documents that have the field and their mean length, per field (IDX-4).

    Both come from the postings in one aggregate of a few rows: one posting per document and field is
    marked as its first, and the term frequencies add up to the length.
    """
    return _mean_lengths(post.groupBy("field").agg(F.sum("first_of_document").alias("docs"), F.sum("tf").alias("total")))


def _mean_lengths(sums: DataFrame) -> DataFrame:
    return sums.where("docs > 0").select("field", "docs", "total", (F.col("total") / F.col("docs")).alias("avg_length"))


def term_bucket(term: Column | str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


@dataclass
class SearchIndex:
    """Tables of one index; ``vectors`` is optional: ``(staged_id, content_vector, roles)``.

    ``blocks`` are the bounds of the posting blocks, ``roles`` the numbers of the roles in the bitmaps.
    """

    documents: DataFrame
    postings: DataFrame
    terms: DataFrame
    fields: DataFrame
    vectors: DataFrame | None = None
    blocks: DataFrame | None = None
    roles: dict[str, int] | None = None


def _with_roles(vectors: DataFrame | None, documents: DataFrame, numbers: dict[str, int]) -> DataFrame | None:
    """Vectors with the role bitmap of their documents, joined once when the index is made."""
    if vectors is None or "role_ids" not in documents.columns:
        return vectors
    own = documents.select("staged_id", role_words(numbers, F.col("role_ids")).alias("roles"))
    return vectors.select("staged_id", "content_vector").join(own, "staged_id", "left")


def build_index(documents: DataFrame, vectors: DataFrame | None = None) -> SearchIndex:
    numbers = role_numbers(documents)
    post = postings(documents, roles=numbers)
    return SearchIndex(
        documents, post, term_statistics(post), field_statistics(post), _with_roles(vectors, documents, numbers), block_bounds(post), numbers)


def write_index(index: SearchIndex, path: str) -> None:
    """Write the index tables; an index that exists is left alone (SNK-9).

    Documents lie in one folder per routing class, postings in one per term bucket, sorted by term;
    ``rebalance`` splits a folder's rows by size, so a class or a term of most rows lies in several files.
    """
    if not index_exists(index.documents.sparkSession, path):
        _write(index.documents, index.vectors, None, path, {})


def _last_rows(documents: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per ``staged_id``: the last by ``order``, ties by the whole row as text."""
    row = F.struct(*documents.columns)
    place = F.struct(*order, F.to_json(row))
    return documents.groupBy("staged_id").agg(F.max_by(row, place).alias("_row")).select("_row.*")


def upsert_index(
    spark: SparkSession, path: str, documents: DataFrame, vectors: DataFrame | None = None, order: Sequence[str] = (),
) -> None:
    """Replace or add documents with all that the index holds of them (SNK-6).

    Of rows with one ``staged_id`` the last by ``order`` counts, ties by the whole row, for documents and vectors alike.
    What is new is written beside the index as a part of its own: the documents, their postings, the ids they
    replace, and the change of the statistics.  For that only the replaced documents are read again; nothing
    written before is touched.  Searches see the part once it is whole.  One writer at a time; ``fold_index`` keeps
    the number of parts small.
    """
    documents = _last_rows(documents, order)
    if vectors is not None:
        vectors = _last_rows(vectors.select("staged_id", "content_vector"), ())
    index = read_index(spark, path)
    replaced = index.documents.join(documents.select("staged_id"), "staged_id", "left_semi")
    _write(documents, vectors, replaced, f"{path}/{_PART}{_next_part(spark, path):06d}", index.roles)


def fold_index(spark: SparkSession, path: str) -> None:
    """Write the index as it stands, all upserts applied, as one new base that later reads begin with.

    Replaced documents, postings and vectors are left behind, statistics are those of the whole, so neither plans nor
    anti-joins grow with the number of upserts.  Postings are rewritten, not made again from texts.  The base counts
    once its last table is written; until then, and for readers that began before, the old parts stay.
    ``drop_folded`` deletes them.
    """
    base, parts = _parts(spark, path)
    if not parts:
        return
    index = read_index(spark, path, vectors=True)
    target = f"{path}/{_BASE}{_number(parts[-1]):06d}"
    index.documents.hint("rebalance", "routing").write.mode("overwrite").partitionBy("routing").parquet(f"{target}/documents")
    post = index.postings.hint("rebalance", "bucket").sortWithinPartitions("bucket", "field", "term", "block").drop("bucket")
    post = post.mapInArrow(_pack_rows, _packed_schema(dict(post.dtypes)["staged_id"])).withColumn("bucket", term_bucket("term"))
    post.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/postings")
    written = spark.read.schema(post.schema).parquet(f"{target}/postings")
    _packed_bounds(written).sortWithinPartitions("field", "term").write.mode("overwrite").parquet(f"{target}/blocks")
    index.terms.select("field", "term", "df").sortWithinPartitions("field", "term").write.mode("overwrite").parquet(f"{target}/terms")
    if index.vectors is not None:
        index.vectors.write.mode("overwrite").parquet(f"{target}/vectors")
    _write_roles(spark, index.roles, target)
    index.fields.select("field", "docs", "total").coalesce(1).write.mode("overwrite").parquet(f"{target}/fields")


def drop_folded(spark: SparkSession, path: str) -> list[str]:
    """Delete the bases and upserts that the newest base holds, once no search reads them any more; returns their names."""
    base, _ = _parts(spark, path)
    gone = []
    for name in _names(spark, path):
        old = name.startswith((_PART, _BASE)) and f"{path}/{name}" != base and _number(name) <= _number(base)
        if old or (base != path and name in _TABLES):
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
            gone.append(name)
    return gone


_PART, _BASE = "upsert-", "base-"
_TABLES = ("documents", "postings", "blocks", "terms", "fields", "roles", "vectors")


def _number(path: str) -> int:
    """Number of an upsert, or of the last upsert in a base; the first build is 0."""
    tail = path.rpartition("/")[2]
    return int(tail.rpartition("-")[2]) if tail.startswith((_PART, _BASE)) else 0


def _write_roles(spark: SparkSession, numbers: dict[str, int] | None, path: str) -> None:
    rows = list((numbers or {}).items())
    spark.createDataFrame(rows, "role string, number int").coalesce(1).write.mode("overwrite").parquet(f"{path}/roles")


def _write(documents: DataFrame, vectors: DataFrame | None, replaced: DataFrame | None, path: str, known: dict[str, int]) -> None:
    spark = documents.sparkSession
    documents.hint("rebalance", "routing").write.partitionBy("routing").parquet(f"{path}/documents")
    stored = spark.read.schema(documents.schema).parquet(f"{path}/documents")
    numbers = role_numbers(stored, known)
    post = packed_postings(spread_small(stored), numbers).withColumn("bucket", term_bucket("term"))
    post = post.hint("rebalance", "bucket").sortWithinPartitions("bucket", "field", "term")
    post.write.partitionBy("bucket").parquet(f"{path}/postings")
    written = spark.read.schema(post.schema).parquet(f"{path}/postings")
    bounds = _packed_bounds(written)
    bounds.sortWithinPartitions("field", "term").write.parquet(f"{path}/blocks")
    # Every posting is in one block, so the blocks add up to the terms.
    terms = spark.read.schema(bounds.schema).parquet(f"{path}/blocks").groupBy("field", "term").agg(F.sum("n").alias("df"))
    fields = _packed_fields(written)
    if replaced is not None:
        gone = materialized(packed_postings(replaced).groupBy("field", "term").agg(
            F.sum("n").alias("n"), F.sum("firsts").alias("firsts"), F.sum("total").alias("total")), "replaced-terms")
        less = _packed_fields(gone).select("field", (-F.col("docs")).alias("docs"), (-F.col("total")).alias("total"))
        terms = terms.unionByName(gone.select("field", "term", (-F.col("n")).alias("df"))).groupBy("field", "term").agg(F.sum("df").alias("df"))
        fields = fields.unionByName(less).groupBy("field").agg(F.sum("docs").alias("docs"), F.sum("total").alias("total"))
        documents.select("staged_id").write.parquet(f"{path}/replaced")
    terms.sortWithinPartitions("field", "term").write.parquet(f"{path}/terms")
    if vectors is not None:
        _with_roles(vectors, stored, numbers).write.parquet(f"{path}/vectors")
    _write_roles(spark, numbers, path)
    # A row per field, written last: its presence says the index, or the part, is whole.
    fields.coalesce(1).write.parquet(f"{path}/fields")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _names(spark: SparkSession, path: str) -> list[str]:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(str(s.getPath().getName()) for s in files.listStatus(folder)) if files.exists(folder) else []


def _whole(spark: SparkSession, path: str) -> bool:
    return _exists(spark, f"{path}/fields/_SUCCESS")


def index_exists(spark: SparkSession, path: str) -> bool:
    return _whole(spark, path) or any(n.startswith(_BASE) and _whole(spark, f"{path}/{n}") for n in _names(spark, path))


def _parts(spark: SparkSession, path: str) -> tuple[str, list[str]]:
    """The newest base that is whole, and the whole upserts after it, in order."""
    names = _names(spark, path)
    bases = [f"{path}/{n}" for n in names if n.startswith(_BASE) and _whole(spark, f"{path}/{n}")]
    base = bases[-1] if bases else path
    parts = [f"{path}/{n}" for n in names if n.startswith(_PART) and _number(n) > _number(base)]
    return base, [p for p in parts if _whole(spark, p)]


def _next_part(spark: SparkSession, path: str) -> int:
    """After all numbers in use; a broken upsert's number is used no more."""
    return max([0, *(_number(n) for n in _names(spark, path) if n.startswith((_PART, _BASE)))]) + 1


def read_index(spark: SparkSession, path: str, vectors: bool = False) -> SearchIndex | None:
    """The index at the path with its upserts, None when there is none."""
    if not index_exists(spark, path):
        return None
    base, upserts = _parts(spark, path)
    parts = [base, *upserts]

    def rows(name: str) -> DataFrame:
        """Rows of every part that no later part replaces."""
        out = None
        for i, part in enumerate(parts):
            if name == "vectors" and not _exists(spark, f"{part}/{name}"):
                continue
            own = spark.read.parquet(f"{part}/{name}")
            if name == "postings":
                own = unpacked(own)
            if parts[i + 1:]:
                later = spark.read.parquet(*[f"{p}/replaced" for p in parts[i + 1:]]).distinct()
                own = own.join(later, "staged_id", "left_anti")
            out = own if out is None else out.unionByName(own, allowMissingColumns=True)
        return out

    def sums(name: str, keys: list[str], values: list[str]) -> DataFrame:
        tables = spark.read.parquet(*[f"{p}/{name}" for p in parts])
        return tables if len(parts) == 1 else tables.groupBy(*keys).agg(*(F.sum(v).alias(v) for v in values))

    blocks = spark.read.parquet(*[f"{p}/blocks" for p in parts])
    if upserts:  # replaced postings loosen a bound; it stays one
        blocks = blocks.groupBy("field", "term", "block").agg(
            F.sum("n").alias("n"), F.max("max_tf").alias("max_tf"), F.min("min_length").alias("min_length"))
    roles = {r["role"]: r["number"] for r in spark.read.parquet(f"{parts[-1]}/roles").collect()}  # each part's holds all before
    return SearchIndex(
        rows("documents"), rows("postings"), sums("terms", ["field", "term"], ["df"]).where("df > 0"),
        _mean_lengths(sums("fields", ["field"], ["docs", "total"])), rows("vectors") if vectors else None, blocks, roles,
    )

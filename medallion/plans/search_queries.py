"""Queries over the search index and the ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.enrichment import keywords, summary
from ..functions.mapping import metadata_tags, role_ids, security_class
from ..functions.text import l2_normalised, strip
from ..operators import search as SE
from ..operators import search_index as IX
from ..operators import substring_index as SX
from ..operators import vector_index as VX
from ..operators.tables import lookup_or_first
from ..session import spread_small, work_path
from .inputs import CODES, sql_class, sql_keywords, sql_strip, sql_summary
from .registry import query, table


def _documents(spark, d, texts=None):
    code = F.get(F.array(*[F.lit(c) for c in CODES]), (F.col("doc_id") % len(CODES)).cast("int"))
    docs = spread_small(table(spark, d, "documents") if texts is None else texts).withColumn("_s", strip("text"))
    cls = security_class(code)
    return docs.select(
        F.col("doc_id").alias("staged_id"), F.col("text").alias("chunk_content"), keywords(F.col("_s")).alias("keywords"),
        summary(F.col("_s")).alias("summary"), F.col("lang").alias("category"), cls.alias("pclrty_class"),
        role_ids(cls, F.col("lang")).alias("role_ids"), metadata_tags(cls, code, F.col("lang")).alias("metadata_tags"),
        cls.alias("routing"),
    )


def _vectors(spark, d):
    """All vectors, and beside them ids without one, as after a failed embedding job."""
    own = table(spark, d, "embeddings").select(F.col("vec_id").alias("staged_id"), F.col("embedding").alias("content_vector"))
    missing = own.where("staged_id % 11 = 5").select((-1 - F.col("staged_id")).alias("staged_id"), F.lit(None).cast(own.schema[1].dataType).alias("content_vector"))
    return own.unionByName(missing)


def _index(spark, d, vectors: bool = False):
    """The index written to the shared folder and read back, the way searches use it."""
    near = _vectors(spark, d) if vectors else None
    path = work_path(spark, "index")
    IX.write_index(IX.build_index(_documents(spark, d), near), path)
    return IX.read_index(spark, path, vectors)


def _queries(spark, d, vectors: bool = False):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    if vectors:
        near = table(spark, d, "embeddings").where("vec_id % 20 = 0").select(
            F.expr("vec_id div 20").alias("query_id"), F.col("embedding").alias("query_vector"))
        asked = asked.join(near, "query_id", "left")  # without a vector the words still search
    return asked


def _vector_queries(spark, d):
    """Every vector whose id is divisible by 20."""
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


_TOKEN = r"[\p{L}\p{M}\p{Nd}\p{Pc}]+"
_CODE = "['S','A','B','C','D','E','X'][doc_id % 7 + 1]"


def _bm25(where: str = "true", size: int = 10, text: str = "text") -> str:
    """CTEs up to ``kw(query_id, staged_id, score, rank)``."""
    return f"""base AS (SELECT doc_id, text, lang, {_CODE} AS code, {sql_strip('text')} AS s FROM (SELECT doc_id, {text} AS text, lang FROM documents)),
fields AS (SELECT doc_id, 'c' AS f, text AS t FROM base UNION ALL SELECT doc_id, 's', {sql_summary('s')} FROM base),
tk AS (SELECT doc_id, f, regexp_extract_all(lower(t), '{_TOKEN}') AS ts FROM fields),
ln AS (SELECT doc_id, f, len(ts) AS dl FROM tk),
av AS (SELECT f, count(*) FILTER (dl > 0) AS n, avg(dl) FILTER (dl > 0) AS avgdl FROM ln GROUP BY f),
ps AS (SELECT doc_id, f, term, count(*) AS tf FROM (SELECT doc_id, f, unnest(ts) AS term FROM tk) GROUP BY ALL),
st AS (SELECT f, term, count(*) AS df FROM ps GROUP BY ALL),
qt AS (SELECT query_id, term, count(*) AS qtf FROM
  (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '{_TOKEN}')) AS term FROM benchmark) GROUP BY ALL),
allowed AS (SELECT doc_id FROM base WHERE {where}),
hit AS (SELECT query_id, ps.doc_id, f, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS w
  FROM qt JOIN ps USING (term) JOIN st USING (f, term) JOIN ln USING (doc_id, f) JOIN av USING (f)
  WHERE doc_id IN (SELECT doc_id FROM allowed) GROUP BY ALL),
sc AS (SELECT query_id, doc_id AS staged_id, round(max(CASE f WHEN 'c' THEN 2 * w ELSE w END), 12) AS score FROM hit GROUP BY ALL),
kw AS (SELECT * REPLACE (round(score, 6) AS score) FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, staged_id) AS rank FROM sc QUALIFY rank <= {size}))"""


def _knn(size: int = 10, queries: str = "SELECT item_id AS query_id, 20 * item_id AS vec_id FROM benchmark") -> str:
    """CTE ``nn(query_id, staged_id, score, rank)``; the vectors have length 1."""
    return f"""ve AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x) AS v FROM embeddings),
nm AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS l FROM ve),
vs AS (SELECT b.query_id, d.vec_id AS staged_id, round((1 + list_dot_product(q.v, d.v) / (q.l * d.l)) / 2, 12) AS score
  FROM ({queries}) b JOIN nm q ON q.vec_id = b.vec_id, nm d),
nn AS (SELECT * REPLACE (round(score, 6) AS score) FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, staged_id) AS rank FROM vs QUALIFY rank <= {size}))"""


@query(
    "index_terms",
    f"""WITH {_bm25()} SELECT CASE f WHEN 'c' THEN 'chunk_content' ELSE 'summary' END AS field, term, df FROM st""",
)
def index_terms(spark, d):
    """IDX-3, IDX-4: document frequencies of the text fields."""
    index = IX.build_index(_documents(spark, d))
    return index.terms.where(F.col("field") != IX.KEYWORD_FIELD)


@query(
    "index_fields",
    f"""WITH {_bm25()}, {sql_keywords('base', 'doc_id', 's')}
SELECT CASE f WHEN 'c' THEN 'chunk_content' ELSE 'summary' END AS field, n AS docs, round(avgdl, 6) AS avg_length FROM av
UNION ALL SELECT 'keywords', count(*), round(avg(len(keywords)), 6) FROM keywords""",
)
def index_fields(spark, d):
    """IDX-4: documents per field and mean lengths."""
    return IX.build_index(_documents(spark, d)).fields.select("field", "docs", F.round("avg_length", 6).alias("avg_length"))


@query("bm25_search", f"WITH {_bm25()} SELECT query_id, staged_id, score, CAST(rank AS INTEGER) AS rank FROM kw")
def bm25_search(spark, d):
    """IDX-5, RANK-1, TOPK-1."""
    return SE.keyword_hits(_index(spark, d), _queries(spark, d)).select("query_id", "staged_id", "score", "rank")


_UPSERTED = "CASE WHEN doc_id % 5 = 0 THEN 'upserted ' || lang || ' ' || (SELECT text FROM benchmark WHERE item_id = doc_id % 40) ELSE text END"


def _upserted(spark, d):
    """Path of an index with new texts for every fifth document in two upserts; in the second, a tenth of the ids stand twice."""
    path = work_path(spark, "index")
    docs = table(spark, d, "documents").where("doc_id % 5 = 0").select("doc_id", "lang")
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("_item"), F.col("text").alias("_new"))
    texts = docs.join(items, F.col("doc_id") % 40 == F.col("_item"), "left")
    new = _documents(spark, d, texts.select("doc_id", "lang", F.concat(F.lit("upserted "), "lang", F.lit(" "), "_new").alias("text")))
    wrong = new.where("staged_id % 10 = 0").withColumn("chunk_content", F.concat("chunk_content", F.lit(" replaced once more")))
    IX.write_index(IX.build_index(_documents(spark, d)), path)
    IX.upsert_index(spark, path, wrong)
    both = new.withColumn("at", F.lit(1)).unionByName(wrong.withColumn("at", F.lit(0)))
    IX.upsert_index(spark, path, both, order=["at"])
    return path


@query("index_upsert_search", f"WITH {_bm25(text=_UPSERTED)} SELECT query_id, staged_id, score, CAST(rank AS INTEGER) AS rank FROM kw")
def index_upsert_search(spark, d):
    """SNK-6, IDX-5: an index, new texts for every fifth document in two upserts, then the search."""
    return SE.keyword_hits(IX.read_index(spark, _upserted(spark, d)), _queries(spark, d)).select("query_id", "staged_id", "score", "rank")


@query(
    "index_fold_search",
    f"""WITH {_bm25(text=_UPSERTED)}, p AS (SELECT unnest(['parts', 'folded']) AS state)
SELECT state, query_id, staged_id, score, CAST(rank AS INTEGER) AS rank FROM kw, p""",
)
def index_fold_search(spark, d):
    """SNK-6: the same search before and after the upserts are folded into a base."""
    path = _upserted(spark, d)
    asked = _queries(spark, d)
    columns = ("query_id", "staged_id", "score", "rank")
    before = SE.keyword_hits(IX.read_index(spark, path), asked).select(F.lit("parts").alias("state"), *columns)
    IX.fold_index(spark, path)
    return before.unionByName(SE.keyword_hits(IX.read_index(spark, path), asked).select(F.lit("folded").alias("state"), *columns))


@query(
    "vector_topk",
    f"""WITH {_knn(queries='SELECT vec_id AS query_id, vec_id FROM embeddings WHERE vec_id % 20 = 0')}
SELECT query_id, staged_id, score, CAST(rank AS INTEGER) AS rank FROM nn""",
)
def vector_topk(spark, d):
    """RANK-2: every vector whose id is divisible by 20 against all vectors, by clusters."""
    path = work_path(spark, "vectors")
    VX.write_vectors(_vectors(spark, d), path)
    return VX.clustered_hits(VX.read_vectors(spark, path), _vector_queries(spark, d))


_RRF = """rrf AS (SELECT kw.query_id, kw.staged_id, 1.0::DOUBLE / (60 + kw.rank) + 1.0::DOUBLE / (60 + coalesce(nn.rank, 11)) AS score,
  kw.score AS keyword_score, coalesce(nn.score, 0.0) AS semantic_score
  FROM kw LEFT JOIN nn ON nn.query_id = kw.query_id AND nn.staged_id = kw.staged_id),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, staged_id) AS rank FROM rrf)"""


@query(
    "hybrid_rrf",
    f"""WITH {_bm25()}, {_knn()}, {_RRF}
SELECT query_id, staged_id, score, keyword_score, semantic_score, CAST(rank AS INTEGER) AS rank FROM fused""",
)
def hybrid_rrf(spark, d):
    """RANK-3, RANK-4, JOIN-10, IDX-6."""
    index, asked = _index(spark, d, True), _queries(spark, d, True)
    fused = SE.fused_hits(SE.keyword_hits(index, asked), SE.vector_hits(index.vectors, asked))
    return fused.select("query_id", "staged_id", "score", "keyword_score", "semantic_score", "rank")


@query(
    "search_modes",
    f"""WITH {_bm25()}, {_knn()}, {_RRF}, m AS (
  SELECT 'keyword' AS mode, query_id, staged_id, rank FROM kw
  UNION ALL SELECT 'semantic', nn.query_id, staged_id, rank FROM nn JOIN documents ON doc_id = staged_id
  UNION ALL SELECT 'hybrid', query_id, staged_id, rank FROM fused)
SELECT mode, query_id, staged_id, CAST(rank AS INTEGER) AS rank, lang AS category FROM m JOIN documents ON doc_id = staged_id""",
)
def search_modes(spark, d):
    """IDX-7: the three modes through the one search function."""
    index, asked = _index(spark, d, True), _queries(spark, d, True)
    parts = [
        SE.search(index, asked, mode).select(F.lit(mode).alias("mode"), "query_id", "staged_id", "rank", "category")
        for mode in ("keyword", "semantic", "hybrid")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "search_by_role",
    f"""WITH {_bm25(f"{sql_class('code')} = 'PUBLIC' OR lang = 'fr'")}
SELECT query_id, staged_id, score, CAST(rank AS INTEGER) AS rank FROM kw""",
)
def search_by_role(spark, d):
    """IDX-8."""
    out = SE.search(_index(spark, d), _queries(spark, d), "keyword", user_roles=["ROLE_PUBLIC", "ROLE_fr"])
    return out.select("query_id", "staged_id", "score", "rank")


@query(
    "search_result_view",
    f"""WITH {_bm25(size=20)}
SELECT query_id, CAST(staged_id AS VARCHAR) AS id, CASE WHEN {sql_summary('s')} <> '' THEN {sql_summary('s')} ELSE substr(text, 1, 80) END AS title,
  {sql_summary('s')} AS summary, code AS priority, {sql_class('code')} AS security, lang AS "vehicleModel", score,
  score AS "keywordScore", 0.0::DOUBLE AS "semanticScore", substr(text, 1, 200) AS highlight
FROM kw JOIN base ON doc_id = staged_id WHERE {sql_class('code')} = 'INTERNAL' AND lang = 'en'""",
)
def search_result_view(spark, d):
    """PRJ-5, FLT-5."""
    found = SE.search(_index(spark, d), _queries(spark, d), "keyword", size=20)
    return SE.filter_results(SE.result_view(found, ["query_id"]), security="INTERNAL", model="en")


_TITLES = f"""base AS (SELECT doc_id, text, {sql_strip('text')} AS s FROM documents),
v AS (SELECT doc_id, {sql_summary('s')} AS summary, text FROM base),
t AS (SELECT doc_id, CASE WHEN summary <> '' THEN summary ELSE substr(text, 1, 80) END AS title, summary FROM v)"""


def _titles(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", summary(strip("text")).alias("summary"))
    return docs.select("doc_id", F.when(F.col("summary") != "", F.col("summary")).otherwise(F.substring("text", 1, 80)).alias("title"), "summary")


@query("substring_search", f"WITH {_TITLES} SELECT doc_id, title FROM t WHERE contains(title, 'the') OR contains(summary, 'the')")
def substring_search(spark, d):
    """FLT-6."""
    return SE.substring_search(_titles(spark, d), "the").select("doc_id", "title")


_ASKED = ("the", "éau", "nd the ", "entre", "th", "zzzz", "  ")


@query(
    "substring_index_search",
    f"""WITH {_TITLES}, q AS (SELECT unnest([{', '.join(f"'{q}'" for q in _ASKED)}]) AS asked)
SELECT asked, doc_id, title FROM t, q WHERE trim(asked) <> '' AND (contains(title, asked) OR contains(summary, asked))""",
)
def substring_index_search(spark, d):
    """FLT-6 by postings of three characters; two characters are a scan, blanks find nothing."""
    path = work_path(spark, "substrings")
    SX.write_substring_index(_titles(spark, d), path, "doc_id")
    index = SX.read_substring_index(spark, path, "doc_id")
    found = [SX.indexed_substring_search(index, q).select(F.lit(q).alias("asked"), "doc_id", "title") for q in _ASKED]
    return reduce(DataFrame.unionByName, found)


@query(
    "document_lookup",
    """SELECT 'hit' AS asked, doc_id, lang FROM documents WHERE doc_id = 42
UNION ALL SELECT 'miss', doc_id, lang FROM documents WHERE doc_id = (SELECT min(doc_id) FROM documents)""",
)
def document_lookup(spark, d):
    """FLT-7: an id that exists, and one that does not."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    hit = lookup_or_first(docs, "doc_id", 42, ["doc_id"]).select(F.lit("hit").alias("asked"), "doc_id", "lang")
    miss = lookup_or_first(docs, "doc_id", -1, ["doc_id"]).select(F.lit("miss").alias("asked"), "doc_id", "lang")
    return hit.unionByName(miss)


@query(
    "normalize_vectors",
    """WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * (vec_id % 3)) AS v FROM embeddings),
l AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM v)
SELECT vec_id, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS length, round(CASE WHEN n = 0 THEN v[1] ELSE v[1] / n END, 6) + 0.0 AS first FROM l""",
)
def normalize_vectors(spark, d):
    """MTH-2; every third vector is the zero vector."""
    scaled = table(spark, d, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 3)).alias("v")
    )
    unit = scaled.select("vec_id", l2_normalised("v").alias("u"))
    length = F.sqrt(F.aggregate("u", F.lit(0.0), lambda acc, x: acc + x * x))
    return unit.select("vec_id", F.round(length, 6).alias("length"), (F.round(F.get("u", F.lit(0)), 6) + F.lit(0.0)).alias("first"))

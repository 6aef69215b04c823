"""Expressions against plain statements of their rules."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from medallion import constants as K
from medallion.functions import chunking, enrichment, keys, mapping, masking, text


def one(spark, column, **values):
    fields = [F.lit(v).alias(k) if v is not None else F.lit(None).cast("string").alias(k) for k, v in values.items()]
    return spark.range(1).select(*fields).select(column.alias("x")).first().x


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_hash_keys(spark):
    hub = one(spark, keys.hub_hash("src", keys.business_key("a", "b")), a="AP1", b=1)
    assert hub == sha("src||AP1||1")
    assert one(spark, keys.link_hash("h", "e"), h=hub, e=7) == sha(f"{hub}||7")
    assert one(spark, keys.satellite_hash("h", "report"), h=hub) == sha(f"{hub}||report")
    assert one(spark, keys.row_hash("a", "b"), a="AP1", b=1) == hashlib.md5(b"AP1||1").hexdigest()


def test_key_with_missing_part(spark):
    assert one(spark, keys.business_key("a", "b"), a="x", b=None) is None
    assert one(spark, keys.poll_key("a", "b"), a="x", b=None) == sha("x|")


def test_locators(spark):
    assert one(spark, keys.stream_locator("s", "m"), s="p.t", m="1-0") == "cdc://p.t/1-0"
    assert one(spark, keys.row_locator("t", "a", "b"), a="AP1", b=2) == "cdc://t/AP1:2"
    assert one(spark, keys.locator_bucket("p"), p="s3://bronze/a/b.parquet") == "bronze"
    assert one(spark, keys.locator_key("p"), p="s3://bronze/a/b.parquet") == "a/b.parquet"
    assert one(spark, keys.first_key_part("p"), p="AP1||3") == "AP1"


@pytest.mark.parametrize("raw", ["", "  a ", "　x\x85", "\x1c\n a b \t ", "​ a", "\xa0"])
def test_strip_matches_python(spark, raw):
    assert one(spark, text.strip("t"), t=raw) == raw.strip()


@pytest.mark.parametrize(
    "code,expected",
    [("S", "RESTRICTED"), ("A", "INTERNAL"), ("B", "INTERNAL"), ("C", "INTERNAL"), ("D", "PUBLIC"), ("E", "PUBLIC"), ("Z", "INTERNAL"), (None, "INTERNAL")],
)
def test_security_class(spark, code, expected):
    assert one(spark, mapping.security_class("c"), c=code) == expected


def test_differences_and_durations(spark):
    assert one(spark, text.signed_difference("a", "b"), a=1, b=4) == "+3"
    assert one(spark, text.signed_difference("a", "b"), a=4, b=1) == "-3"
    assert one(spark, text.signed_difference("a", "b"), a=4, b=4) == "0"
    assert one(spark, text.changed_flag("a", "b"), a="x", b="y") == "변경"
    ms = text.duration_ms("a", "b")
    assert one(spark, ms, a="2026-01-01T00:00:00Z", b="2026-01-01T00:00:02.500Z") == 2500
    assert one(spark, ms, a="2026-01-01T00:00:00Z", b=None) is None
    assert one(spark, ms, a="2026-01-01T00:00:00.000500Z", b="2026-01-01T00:00:01.000400Z") == 999
    assert one(spark, text.duration_seconds("a"), a=2500) == 3


def masked(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    return {r.id: r for r in masking.mask_documents(df, "t").collect()}


def test_mask_counts_flag_and_order(spark):
    got = masked(
        spark,
        "nothing here",
        "a 010-1234-5678 b 010 1234 5678 c 01112345678",
        "010-1234-5678 901231-1234567 a.b@c.de 110-123456-78",
    )
    assert got[0].masked_content == "nothing here" and got[0].pii_pattern_types == {}
    assert got[1].pii_detection_count == 3 and not got[1].is_masked
    assert got[1].masked_content == "a 010****1234 b 010****1234 c 010****1234"
    assert got[2].is_masked
    assert got[2].pii_pattern_types == {"KR_PHONE": 1, "KR_RRN": 1, "KR_EMAIL": 1, "KR_BANK_ACCOUNT": 1}
    assert got[2].masked_content == "010****1234 [주민번호 마스킹] [이메일 마스킹] [계좌번호 마스킹]"


def test_mask_word_boundaries(spark):
    got = masked(spark, "010-1234-5678입니다", "전화010-1234-5678", "line\n010-1234-5678", 'json\\n010-1234-5678"')
    assert [got[i].pii_detection_count for i in range(4)] == [0, 0, 1, 0]


def test_mask_matches_python_on_random_texts(spark):
    rng = random.Random(5)
    pieces = ["010-1234-5678", "011.123.4567", "901231-1234567", "x@y.co", "110-123456-78", "1234-5678901-23", " ", "가", ",", "abc", "-", "@", "01"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(300)]
    got = masked(spark, *texts)
    for i, raw in enumerate(texts):
        counts, value = {}, raw
        for kind, pattern, replacement, _ in K.PII_PATTERNS:
            value, n = re.subn(pattern, lambda _, r=replacement: r, value)
            if n:
                counts[kind] = n
        assert (got[i].masked_content, got[i].pii_pattern_types) == (value, counts), raw


def test_merged_counts(spark):
    df = spark.sql("SELECT map('a', 2) AS l, map('b', 0, 'a', 1) AS r")
    assert df.select(masking.merged_counts("l", "r").alias("m")).first().m == {"a": 3, "b": 0}


def chunks_of(spark, raw, **options):
    df = spark.createDataFrame([("d", raw)], "doc string, t string")
    return [r.chunk_content for r in chunking.chunk_documents(df, "doc", "t", **options).orderBy("chunk_sequence").collect()]


CHUNKS = [
    ("", ["(빈 청크 1)", "(빈 청크 2)", "(빈 청크 3)"]),
    (None, ["(빈 청크 1)", "(빈 청크 2)", "(빈 청크 3)"]),
    ("a", ["a", "(빈 청크 2)", "(빈 청크 3)"]),
    ("ab", ["a", "b", "(빈 청크 3)"]),
    ("abcd", ["a", "b", "cd"]),
    ("😀bc😀ef😀", ["😀b", "c😀", "ef😀"]),
    ("현상: x 원인: y 대책: z", ["현상: x", "원인: y", "대책: z"]),
    ("대책: z 현상: x 원인: y", ["대책: z", "현상: x", "원인: y"]),
    ("lead 현상: x 원인: y 대책: z", ["lead", "현상: x", "원인: y", "대책: z"]),
    ("lead 현상: x 원인: y", ["lead", "현상: x", "원인: y"]),
    ("현상: x 현상: y 원인: z 대책: 원인: w", ["현상: x 현상: y", "원인: z", "대책: 원인: w"]),
    ("현상:원인:대책:", ["현상:", "원인:", "대책:"]),
]


@pytest.mark.parametrize("raw,expected", CHUNKS)
def test_chunks(spark, raw, expected):
    assert chunks_of(spark, raw) == expected


def test_chunks_up_to_a_number(spark):
    assert chunks_of(spark, "lead 현상: x 원인: y 대책: z", keep_all=False) == ["lead", "현상: x", "원인: y"]


def test_own_pattern_has_no_other_patterns_literal(spark):
    df = spark.createDataFrame([("call 02-123-4567",)], "t string")
    own = (("KR_PHONE", r"\b02-\d{3}-\d{4}\b", "X"),)
    assert masking.mask_text(df, "t", patterns=own).first().masked_content == "call X"


def test_chunk_metadata(spark):
    df = spark.createDataFrame([(5, "abcdef")], "doc int, t string")
    meta = chunking.chunk_documents(df, "doc", "t").orderBy("chunk_sequence").first().chunk_metadata.asDict()
    assert meta == {"doc_id": "5", "sequence": 0, "char_count": 2, "chunk_method": "section_split"}


def test_keywords_match_counter(spark):
    rng = random.Random(3)
    vocabulary = ["aa", "bb", "cc", "dd", "ee", "ff", "Aa", "에서", "으로", "부품", "x", "가나"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    texts += ["", "a b c", " ".join(f"w{i}" for i in range(2000)), "z1 z2 z3 z4 z5 z6 z6"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r.id: r.k for r in df.select("id", enrichment.keywords(F.col("t")).alias("k")).collect()}
    for i, raw in enumerate(texts):
        found = [w for w in re.findall(r"[가-힣A-Za-z0-9]{2,}", raw) if w not in K.STOP_WORDS]
        assert got[i] == [w for w, _ in Counter(found).most_common(5)], raw


def test_term_counts(spark):
    df = spark.sql("SELECT split('b a b c a b', ' ') AS t")
    got = df.select(text.term_counts(F.col("t")).alias("c")).first().c
    assert [(r.term, r.tf) for r in got] == [("a", 2), ("b", 3), ("c", 1)]
    empty = spark.sql("SELECT cast(array() AS array<string>) AS t")
    assert empty.select(text.term_counts(F.col("t")).alias("c")).first().c == []


@pytest.mark.parametrize("raw,expected", [("one. two", "one"), (".two " + "x" * 200, (".two " + "x" * 200)[:100]), ("none", "none"), ("", "")])
def test_summary(spark, raw, expected):
    assert one(spark, enrichment.summary(F.col("t")), t=raw) == expected


def test_entities_in_dictionary_order(spark):
    assert one(spark, enrichment.entities(F.col("t")), t="G90 and NX01, IONIQ5!") == ["NX01", "G90", "IONIQ5"]


def test_normalised_zero_vector(spark):
    df = spark.sql("SELECT array(0.0, 0.0) AS z, array(3.0, 4.0) AS v")
    row = df.select(text.l2_normalised("z").alias("z"), text.l2_normalised("v").alias("v")).first()
    assert row.z == [0.0, 0.0] and row.v == pytest.approx([0.6, 0.8])


def test_pii_count_list(spark):
    df = spark.sql("SELECT map('KR_PHONE', 2, 'X', cast(null AS int)) AS m, true AS y, false AS n")
    row = df.select(mapping.pii_count_list("m", "y").alias("y"), mapping.pii_count_list("m", "n").alias("n")).first()
    assert [tuple(r) for r in row.y] == [("KR_PHONE", "전화번호", 2), ("X", "X", 0)] and row.n == []

import pytest
from pyspark.sql import functions as F

from kataflow.functions.text import capitalized, strip_marks, tokens, trimmed, without_diacritics

CASES = [
    ("bukumu Bukumu BUKUMU kanal7 2024", ["bukumu", "Bukumu", "BUKUMU", "kanal7", "2024"]),
    ("-satu satu- satu-dua d'etat Q’uran", ["satu", "satu", "satu-dua", "d'etat", "Q’uran"]),
    ("p‐q r‑s t–u v—w", ["p‐q", "r‑s", "t", "u", "v", "w"]),
    ("surat_baru@kantor.org http://toko.co/cari?k=9", ["surat", "baru", "kantor", "org", "http", "toko", "co", "cari", "k", "9"]),
    ("Re\u0301gi R\u00e9gi 한국어 \uff13\uff14", ["Re\u0301gi", "R\u00e9gi", "한국어", "\uff13\uff14"]),
    ("ʼkata kataʼ", ["ʼkata", "kataʼ"]),
    (None, []),
    ("", []),
    ("a" + "-a" * 50_000, ["a" + "-a" * 50_000]),
]


@pytest.mark.parametrize(("text", "expected"), CASES)
def test_tokens(spark, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(tokens("t")).first()[0] == expected


def test_small_functions(spark):
    rows = spark.createDataFrame([("éCole",), ("ßa",), ("Ångström 한",), (None,)], "t string")
    assert [r[0] for r in rows.select(capitalized(F.col("t"))).collect()] == ["ÉCole", "SSa", "Ångström 한", None]
    assert [r[0] for r in rows.select(without_diacritics(F.col("t"))).collect()] == ["eCole", "ßa", strip_marks("Ångström 한"), None]
    assert spark.createDataFrame([("  a b　",)], "t string").select(trimmed("t")).first()[0] == "a b"

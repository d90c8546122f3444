"""Column functions for text."""

import re

from pyspark.sql import functions as F

from lectern.functions import text as tx


def one(spark, col, value, typ="string"):
    return spark.createDataFrame([(value,)], f"v {typ}").select(col(F.col("v")).alias("o")).first().o


def test_whitespace_class_is_pythons(spark):
    ws = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())
    s = "a" + ws + "b" + ws
    assert one(spark, tx.normalize_whitespace, s) == "a b"
    assert one(spark, tx.normalize_whitespace, s) == re.sub(r"\s+", " ", s).strip()
    assert one(spark, tx.strip_ws, ws + "x y" + ws) == "x y"
    # characters outside the class stay
    assert one(spark, tx.normalize_whitespace, "a\u200bb") == "a\u200bb"


def test_preview_lengths(spark):
    assert one(spark, tx.text_preview, "x" * 200) == "x" * 200
    assert one(spark, tx.text_preview, "x" * 201) == "x" * 200 + "..."


def test_basename_and_extension(spark):
    assert one(spark, tx.basename, "a/b/c.PDF") == "c.PDF"
    assert one(spark, tx.basename, "nofolder.pdf") == "nofolder.pdf"
    assert one(spark, tx.basename, "dir/") == ""
    assert one(spark, lambda c: tx.has_extension(c, ".pdf"), "a/B.PdF") is True
    assert one(spark, lambda c: tx.has_extension(c, ".pdf"), "a/b.pdf.txt") is False


def test_decode_object_key(spark):
    assert one(spark, tx.decode_object_key, "a/b+c%20d.PDF") == "a/b c d.PDF"
    # malformed escape: the key is kept, plus signs still mean spaces
    assert one(spark, tx.decode_object_key, "bad%2+x") == "bad%2 x"


def test_display_fields(spark):
    assert one(spark, tx.thousands, 1234567, "long") == "1,234,567"
    assert one(spark, lambda c: tx.short_id(c), "0123456789abcdefXYZ") == "0123456789abcdef..."
    df = spark.createDataFrame([("f.pdf", "pending")], "f string, s string")
    assert df.select(tx.document_label("f", "s")).first()[0] == "f.pdf (pending)"
    assert spark.range(1).select(tx.chunk_key(F.lit("d1"), F.lit(3))).first()[0] == "d1_3"


def test_strip_edge_cases(spark):
    ws = "　\t\n \u001c"
    for s in ["", ws, ws + "a" + ws, "a", " a b ", None, "x" + ws]:
        got = one(spark, tx.strip_ws, s)
        assert got == (None if s is None else s.strip()), repr(s)
        n = one(spark, tx.stripped_length, s)
        assert n == (None if s is None else len(s.strip())), repr(s)

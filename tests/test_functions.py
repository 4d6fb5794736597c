import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import vectors as V


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<double>'}" for k, v in values.items())).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("Fix The Bug", ["fix", "the", "bug"]), ("src/auth.rs", ["src", "auth", "rs"]), ("encode_text", ["encode", "text"]), ("HnswIndex", ["hnswindex", "hnsw", "index"]),
        ("HTTPServer", ["httpserver", "http", "server"]), ("utf8", ["utf8", "utf"]), ("patch CVE-2024-1234", ["patch", "cve", "2024", "1234"]), ("a" * 40, ["a" * 40]), ("b" * 41, []),
        ("fix fix fix", ["fix", "fix", "fix"]), ("a_b_token", ["token"]), ("", []), ("--- +++ @@", []), ("é x", ["é"]), ("ÉcoleNormale", ["écolenormale", "école", "normale"]),
    ],
)
def test_tokenize(spark, text, tokens):
    assert one(spark, T.tokenize(F.col("t")), t=text) == tokens


def test_changed_files(spark):
    files = T.changed_files(F.col("t"))
    assert one(spark, files, t="Files: a.rs, b/c.rs, ...\n+x") == ["a.rs", "b/c.rs"]
    assert one(spark, files, t="Files: , ...\n+x") == []
    assert one(spark, files, t="+modified src/a.rs") is None
    assert one(spark, T.touches_path(F.col("t"), "src/"), t="Files: a.rs\n+src/b") is False
    assert one(spark, T.touches_path(F.col("t"), "src/"), t="+modified src/a.rs") is True


def test_changed_paths_budget(spark):
    rows = spark.createDataFrame([(["b", "a", None], ["a", "c" * 30])], "o array<string>, n array<string>")
    line = lambda limit: rows.select(T.changed_paths(F.col("o"), F.col("n"), limit).alias("x")).first().x
    assert line(2000) == "Files: a, b, " + "c" * 30
    assert line(20) == "Files: a, b, ..." and line(7) == "Files: , ..."


def test_truncate(spark):
    cut = lambda t, n: one(spark, T.truncate_bytes(F.col("t"), n), t=t)
    assert cut("hello", 5) == "hello" and cut("hello!", 5) == "hello\n... (truncated)"
    assert cut("aé€b", 2) == "aé\n... (truncated)" and cut("aé€b", 4) == "aé€\n... (truncated)"


def test_message_parts(spark):
    assert one(spark, T.subject(F.col("t")), t="a\r\nb") == "a" and one(spark, T.subject(F.col("t")), t="") == ""
    assert one(spark, T.trim_end(F.col("t")), t="a \n\n\u2003") == "a"
    assert one(spark, T.short_hash(F.col("t")), t="0123456789") == "0123456"
    assert one(spark, T.diff_preview(F.col("t")), t="a\nb\nc") == "a\n   b"
    assert one(spark, T.doc_text(F.col("m"), F.col("a"), F.col("d")), m="m", a="a", d="") == "m\na"
    assert one(spark, T.doc_text(F.col("m"), F.col("a"), F.col("d"), False), m="m", a="a", d="x") == "m\na"
    assert one(spark, T.patch_lines(F.col("t")), t="--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b\n c") == "-a\n+b"


def test_vectors(spark):
    a, b, z = [3.0, 4.0], [1.0, 0.0], [0.0, 0.0]
    assert one(spark, V.dot(F.col("a"), F.col("b")), a=a, b=b) == 3.0
    assert one(spark, V.cosine(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(0.6)
    assert one(spark, V.cosine(F.col("a"), F.col("b")), a=a, b=z) == 0.0
    assert one(spark, V.normalize(F.col("a")), a=a) == pytest.approx([0.6, 0.8]) and one(spark, V.normalize(F.col("a")), a=z) == z
    assert one(spark, V.fit_dimension(F.col("a"), 3), a=a) == [3.0, 4.0, 0.0] and one(spark, V.fit_dimension(F.col("a"), 1), a=a) == [3.0]
    assert one(spark, V.dot(F.col("a"), F.col("b")), a=a, b=[1.0]) is None

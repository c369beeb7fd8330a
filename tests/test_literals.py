"""Cases told one by one: tokens, query terms and shapes, drives, folders of temporary files."""

from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import policy


def column(spark, values, made):
    rows = spark.createDataFrame(list(enumerate(values)), "k int, q string")
    return [r[0] for r in rows.orderBy("k").select(made(F.col("q"))).collect()]


def test_tokens_of_mixed_texts(spark):
    texts = ["Hello CAFÉ 2026 report_01", "人工智能", "Qwen3-VL GGML_SYCL v2.1", "alpha 人工智能", "人 x --"]
    want = [["hello", "café", "2026", "report_01"], ["人工", "工智", "智能"], ["qwen3-vl", "ggml_sycl", "v2.1"], ["alpha", "人工", "工智", "智能"], ["人", "x"]]
    assert column(spark, texts, tx.tokenize_mixed) == want


def test_query_terms_and_expression(spark):
    asked = ["Report 报告 report 报告", "  ", "人", "a b A"]
    assert column(spark, asked, tx.query_terms) == [["report", "报告"], None, None, ["a", "b"]]
    assert column(spark, asked, lambda q: tx.match_expression(tx.query_terms(q))) == ['"report" AND "报告"', None, None, '"a" AND "b"']


def test_query_shapes(spark):
    asked = ["kernel32.dll", "annual report.docx", '"alpha beta"', "C:\\x", ".gitignore", "alpha", "where is it", "a b c d", "why?", "查找 报告"]
    assert column(spark, asked, tx.explicit_file_query) == [True] * 5 + [False] * 5
    assert column(spark, asked, tx.natural_language_query) == [False] * 6 + [True] * 4


def test_drives_and_temporary_folders(spark):
    rows = [("D:\\", True, "Fixed", "NTFS"), ("C:\\", True, "Fixed", "ReFS"), ("c:\\", True, "fixed", "ntfs"), ("E:\\", True, "Removable", "NTFS"), ("F:\\", False, "Fixed", "NTFS"), ("G:\\", True, "Fixed", "FAT32")]
    drives = spark.createDataFrame(rows, "root_path string, is_ready boolean, drive_type string, drive_format string")
    assert [r.root_path.upper() for r in policy.eligible_drives(drives).collect()] == ["C:\\", "D:\\"]
    roots = policy.temporary_roots({"TEMP": "C:\\T\\", "TMP": "c:/t", "LOCALAPPDATA": "C:\\L\\", "WINDIR": " "})
    assert roots == ["c:\\t", "c:\\l\\temp"]
    files = spark.createDataFrame([("a.txt", "c:\\t\\a.txt"), ("a.txt", "c:\\x\\a.txt")], "name string, path_key string")
    level = policy.noise(F.lit("a"), F.col("name"), F.col("path_key"), F.lit("txt"), F.lit(0), roots)
    assert [r[0] for r in files.select(level).collect()] == [2, 0]

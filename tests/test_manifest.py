import pytest
from pyspark.sql import functions as F

from docloom.operators import manifest

MEMBERS = "job_id string, member_path string, member_size long, header binary"
PDF, ZIP, JPG, PNG = b"%PDF-1.4 test", b"PK\x03\x04rest", b"\xff\xd8\xff\xe0rest", b"\x89PNG\r\n\x1a\nrest"


def members(spark, rows, job="j"):
    return spark.createDataFrame([(job, p, n, bytearray(h)) for p, n, h in rows], MEMBERS)


def archives(spark, size, job="j"):
    return spark.createDataFrame([(job, size)], "job_id string, archive_size long")


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [
        ("document.pdf", 10, PDF), ("report.docx", 10, ZIP), ("data.xlsx", 10, ZIP),
        ("image.jpg", 10, JPG), ("photo.png", 10, PNG), ("notes.txt", 10, b"plain"),
    ]
    return manifest.discover(archives(spark, 1000), members(spark, rows))


def test_mixed_archive(mixed):
    row = manifest.discovery_summary(mixed).first()
    assert (row["total_files"], row["document_count"], row["spreadsheet_count"], row["image_count"]) == (6, 2, 1, 2)
    assert (row["video_count"], row["unknown_count"], row["total_bytes"]) == (0, 1, 60)


def test_file_ids_are_stable_and_distinct(mixed):
    ids = [r[0] for r in mixed.select("file_id").collect()]
    assert len(set(ids)) == 6 and ids == [r[0] for r in mixed.select("file_id").collect()]
    assert all(i.startswith("file_") and len(i) == 17 for i in ids)


def test_nested_archive_tree(spark):
    paths = ["documents/report.pdf", "documents/2024/annual.docx", "images/logo.png", "images/products/product1.jpg"]
    files = manifest.discover(archives(spark, 1000), members(spark, [(p, 5, b"") for p in paths]))
    nodes = {r["path"]: r for r in manifest.directory_nodes(files).collect()}
    assert files.count() == 4
    assert nodes["documents"]["parent_path"] == "" and not nodes["documents"]["is_file"]
    assert nodes[""]["name"] == "root" and nodes[""]["parent_path"] is None
    assert nodes["images/products/product1.jpg"]["is_file"] and nodes["images/products/product1.jpg"]["depth"] == 3
    assert len(nodes) == 9


@pytest.mark.parametrize(
    "size, count, reason",
    [(524288001, 1, "size"), (1000, 101, "files"), (1, 3, "ratio"), (1000, 0, "invalid"), (None, 1, "not found"), (1000, 100, None)],
)
def test_archive_limits(spark, size, count, reason):
    rows = [(f"f{i}.pdf", 1000, PDF) for i in range(count)]
    checked = manifest.check_archives(archives(spark, size), members(spark, rows)).first()["reject_reason"]
    assert (checked is None) if reason is None else (reason in checked)


def test_traversal_is_reported_and_the_rest_kept(spark):
    rows = members(spark, [("../../../etc/passwd", 5, b""), ("safe_file.txt", 5, b""), ("folder/", 0, b"")])
    assert [r["path"] for r in manifest.accepted_members(rows).collect()] == ["safe_file.txt"]
    errors = [r["error"] for r in manifest.member_errors(rows).collect()]
    assert errors == ["Skipped dangerous path: ../../../etc/passwd"]


def test_empty_member_is_an_error(spark):
    rows = members(spark, [("empty.pdf", 0, b"")])
    assert manifest.accepted_members(rows).count() == 0
    assert manifest.member_errors(rows).first()["error"] == "Empty file: empty.pdf"


@pytest.mark.parametrize(
    "path, safe",
    [("/a/b.pdf", "a/b.pdf"), ("C:\\x.pdf", None), ("a..b.pdf", None), ("a\\\\b//c.pdf", "a/b/c.pdf"), (".", None),
     ("\\\\server\\x.pdf", "server/x.pdf"), ("", None), ("a////b", "a/b")],
)
def test_safe_path(spark, path, safe):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(manifest.safe_path(F.col("p"))).first()[0] == safe


@pytest.mark.parametrize(
    "path, header, inner, expected",
    [
        ("test.pdf", b"", None, "pdf"), ("test.JPG", b"", None, "jpg"), ("x.unknown", b"??", None, "unknown"),
        ("noext", PDF, None, "pdf"), ("noext", PNG, None, "png"), ("noext", b"GIF89a", None, "gif"),
        ("noext", b"RIFF0000AVI LIST", None, "avi"), ("noext", b"RIFF0000WEBPVP8 ", None, "webp"),
        ("noext", b"RIFF0000WAVEfmt ", None, "unknown"), ("noext", ZIP, ["word/document.xml"], "docx"),
        ("noext", ZIP, ["xl/workbook.xml"], "xlsx"), ("noext", ZIP, ["a.txt"], "unknown"), ("clip.qt", b"", None, "mov"),
        (".pdf", b"", None, "unknown"),
    ],
)
def test_classification(spark, path, header, inner, expected):
    schema = MEMBERS + ", inner_names array<string>"
    rows = spark.createDataFrame([("j", path, 5, bytearray(header), inner)], schema)
    assert manifest.classify_files(manifest.with_safe_path(rows)).first()["file_type"] == expected


def test_sniffed_mime_wins(spark):
    rows = spark.createDataFrame([("j", "a.txt", 5, bytearray(b""), "image/png")], MEMBERS + ", sniffed_mime string")
    got = manifest.classify_files(manifest.with_safe_path(rows)).first()
    assert (got["file_type"], got["category"], got["mime_type"]) == ("png", "image", "image/png")

import csv
import io
import random
import zipfile

import pytest

from docloom import session
from docloom.operators import manifest
from docloom.sources import archives, csv_tables, stores


def packed(members):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, content in members:
            archive.writestr(name, content)
    return buffer.getvalue()


@pytest.fixture(scope="module")
def uploads(tmp_path_factory):
    folder = tmp_path_factory.mktemp("uploads")
    inner = packed([("word/document.xml", "<w/>")])
    (folder / "good.zip").write_bytes(packed([("a/b.pdf", "%PDF-1.4"), ("noext", inner), ("../evil", "x"), ("empty.csv", "")]))
    (folder / "bomb.zip").write_bytes(packed([("big.pdf", "0" * 5_000_000)]))
    (folder / "broken.zip").write_bytes(b"not a zip")
    (folder / "notes.txt").write_text("ignored")
    return str(folder)


def test_archives_become_files(spark, uploads):
    found = archives.read_archives(spark, uploads)
    assert found.count() == 3
    members = archives.expand_archives(found)
    broken = members.filter("archive_error is not null and member_path is null").collect()
    assert [r["job_id"] for r in broken] == ["broken"] and "invalid" in broken[0]["archive_error"]
    readable = members.filter("member_path is not null")
    checked = manifest.check_archives(archives.archive_table(found), readable)
    reasons = {r["job_id"]: r["reject_reason"] for r in checked.collect()}
    assert reasons["good"] is None and "ratio" in reasons["bomb"] and "invalid" in reasons["broken"]
    files = manifest.discover(archives.archive_table(found), readable)
    assert {(r["path"], r["file_type"]) for r in files.collect()} == {("a/b.pdf", "pdf"), ("noext", "docx")}
    errors = {r["error"] for r in manifest.member_errors(readable).collect()}
    assert errors == {"Skipped dangerous path: ../evil", "Empty file: empty.csv"}


def test_samples_and_usage(spark, uploads):
    assert [r["file_name"] for r in archives.list_samples(spark, uploads).collect()] == ["bomb.zip", "broken.zip", "good.zip"]
    usage = {r["area"]: r["total_bytes"] for r in stores.storage_usage(spark, uploads).collect()}
    assert usage["notes.txt"] == 7 and usage["broken.zip"] == 9


def test_storage_areas_are_folders(spark, tmp_path):
    for area, size in (("uploads", 3), ("profiles", 5), ("profiles/deep", 7)):
        (tmp_path / area).mkdir(exist_ok=True)
        (tmp_path / area / "f.bin").write_bytes(b"x" * size)
    usage = {r["area"]: (r["files"], r["total_bytes"]) for r in stores.storage_usage(spark, str(tmp_path)).collect()}
    assert usage == {"uploads": (1, 3), "profiles": (2, 12)}


def test_discovery_store_round_trip(spark, tmp_path):
    rows = [(f"job_{i % 3}", f"file_{i}", "document" if i % 2 else "image") for i in range(60)]
    files = spark.createDataFrame(rows, "job_id string, file_id string, category string")
    stores.write_discovery(files, str(tmp_path / "d"), buckets=8)
    assert stores.read_job(spark, str(tmp_path / "d"), "job_1", buckets=8).count() == 20
    stores.write_by_category(files, str(tmp_path / "c"), buckets=4)
    assert {p.name for p in (tmp_path / "c").iterdir() if p.is_dir()} == {"category=document", "category=image"}
    back = spark.read.parquet(str(tmp_path / "c")).select(files.columns)
    assert {tuple(r) for r in back.collect()} == set(rows)


def test_discovery_store_of_no_file(spark, tmp_path):
    files = spark.createDataFrame([], "job_id string, file_id string, file_size long")
    folder, keyed = str(tmp_path / "d"), "job_id string, file_id string, file_size long, job_bucket int"
    for _ in range(2):
        stores.write_discovery(files, folder)
        assert stores.read_records(spark, folder, files.schema).collect() == []
        assert stores.read_job(spark, folder, "a", schema=keyed).collect() == []
    one = spark.createDataFrame([("a", "f", 3)], files.schema)
    stores.write_discovery(one, folder)
    assert stores.read_records(spark, folder, files.schema).select(files.columns).collect() == one.collect()


def test_category_store_of_no_file(spark, tmp_path):
    files, folder = spark.createDataFrame([], "job_id string, file_id string, category string"), str(tmp_path / "c")
    for _ in range(2):
        stores.write_by_category(files, folder)
        assert stores.read_records(spark, folder, files.schema).collect() == []
    one = spark.createDataFrame([("a", "f", "image")], files.schema)
    stores.write_by_category(one, folder)
    assert stores.read_records(spark, folder, files.schema).select(files.columns).collect() == one.collect()


def test_profiles_round_trip_and_export(spark, tmp_path):
    saved = spark.createDataFrame([(1, ("N", None)), (2, None)], "profile_id long, info struct<name:string,city:string>")
    stores.save_profiles(saved, str(tmp_path / "p"))
    loaded = stores.load_profiles(spark, str(tmp_path / "p"), saved.schema)
    assert {r["profile_id"]: r["info"] for r in loaded.collect()} == {r["profile_id"]: r["info"] for r in saved.collect()}
    items = spark.createDataFrame([("j", {"name": "x", "_metadata": "y"})], "job_id string, item map<string,string>")
    assert stores.export_profiles(items).first()["json"] == '{"name":"x"}'


def test_csv_rows_keep_file_order_over_splits(spark, tmp_path):
    lines = [f'r{i},"a, {i}",' for i in range(2000)]
    (tmp_path / "one.csv").write_text("h1,h2,h3\n" + "\n".join(lines) + "\n")
    (tmp_path / "two.csv").write_text("x,y,z\n1,2,3\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        rows = csv_tables.read_csv_rows(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    one = sorted((r["row_index"], r["cells"]) for r in rows if r["source_file"] == "one.csv")
    assert [i for i, _ in one] == list(range(2001))
    assert one[0][1] == ["h1", "h2", "h3"] and one[7][1] == ["r6", "a, 6", None]
    assert sorted(r["row_index"] for r in rows if r["source_file"] == "two.csv") == [0, 1]


@pytest.mark.parametrize("split", [150, 1000, 100_000])
def test_one_csv_file_is_many_splits(spark, tmp_path, split):
    """Rows equal those of a plain reader wherever the splits fall, also inside quoted cells."""
    rng = random.Random(2)
    parts = ["a", "b c", "1", ",", "\n", '"', "\n\n", "é", " x", "longer words here"]
    rows = [["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 5))] for _ in range(400)]
    with open(tmp_path / "f.csv", "w", newline="", encoding="utf-8") as file:
        csv.writer(file, quoting=csv.QUOTE_ALL, lineterminator="\n").writerows(rows[:200])
        file.write("\n\n")
        csv.writer(file, lineterminator="\r\n").writerows(rows[200:])
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        n_tasks = csv_tables._lines(spark, str(tmp_path), '"').select("block").distinct().count()
        got = sorted((r.row_index, r.cells) for r in csv_tables.read_csv_rows(spark, str(tmp_path)).collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == list(enumerate(rows))
    assert n_tasks > 4 or split == 100_000


def test_csv_files_of_different_width(spark, tmp_path):
    (tmp_path / "narrow.csv").write_text("a,b\n")
    (tmp_path / "wide.csv").write_text("a,b,c,d\n")
    (tmp_path / "mixed.csv").write_text('a,b\n1,2,3\n"x\ny",4\n,\n1,"p,q","r\ns",4,5,6\n')
    rows = csv_tables.read_csv_rows(spark, str(tmp_path)).collect()
    got = {(r["source_file"], r["row_index"]): r["cells"] for r in rows}
    assert got == {
        ("narrow.csv", 0): ["a", "b"],
        ("wide.csv", 0): ["a", "b", "c", "d"],
        ("mixed.csv", 0): ["a", "b"],
        ("mixed.csv", 1): ["1", "2", "3"],
        ("mixed.csv", 2): ["x\ny", "4"],
        ("mixed.csv", 3): [None, None],
        ("mixed.csv", 4): ["1", "p,q", "r\ns", "4", "5", "6"],
    }


def test_a_job_written_again_replaces_its_records(spark, tmp_path):
    kind = "job_id string, path string, category string, file_size long"
    first = [(f"j{i}", f"p{k}", "document" if k else "image", 1) for i in range(30) for k in range(3)]
    second = [("j3", "p9", "document", 2), ("j77", "p0", "image", 2)]
    want = sorted([r for r in first if r[0] != "j3"] + second)
    for write, folder in ((stores.write_discovery, "d"), (stores.write_by_category, "c")):
        for rows in (first, first, second, second):
            write(spark.createDataFrame(rows, kind), str(tmp_path / folder), buckets=4)
        stored = spark.read.parquet(str(tmp_path / folder)).select("job_id", "path", "category", "file_size")
        assert sorted(map(tuple, stored.collect())) == want


def test_damaged_and_empty_archives_are_told_apart(spark, tmp_path):
    good = packed([("a.txt", "hello " * 50), ("b.txt", "world " * 50)])
    at = good.index(b"a.txt") + len(b"a.txt")  # the first compressed byte; no block of this type exists
    (tmp_path / "damaged.zip").write_bytes(good[:at] + b"\xff" + good[at + 1 :])
    (tmp_path / "good.zip").write_bytes(good)
    (tmp_path / "empty.zip").write_bytes(packed([]))
    (tmp_path / "junk.zip").write_bytes(b"no archive")
    (tmp_path / "many.zip").write_bytes(packed([(f"f{i}", "x") for i in range(101)]))
    found = archives.read_archives(spark, str(tmp_path))
    members = archives.expand_archives(found)
    checked = {r.job_id: r for r in manifest.check_archives(archives.archive_table(found), members).collect()}
    reasons = {k: r.reject_reason for k, r in checked.items()}
    assert reasons["good"] is reasons["empty"] is reasons["damaged"] is None and checked["empty"].members == 0
    assert "corrupt" in reasons["junk"] and "too many" in reasons["many"]
    errors = {(r.job_id, r.member_path): r.error for r in manifest.member_errors(members).collect()}
    assert set(errors) == {("junk", None), ("damaged", "a.txt")} and "unreadable member" in errors[("damaged", "a.txt")]
    files = manifest.discover(archives.archive_table(found), members)
    assert sorted((r.job_id, r.path) for r in files.collect()) == [("damaged", "b.txt"), ("good", "a.txt"), ("good", "b.txt")]


def test_shared_folder_comes_from_the_session(spark):
    folder = session.shared_folder(spark)
    assert folder == session.shared_folder(spark)
    assert session.new_folder(spark, "x").startswith(folder)



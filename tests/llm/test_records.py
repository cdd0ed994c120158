import gzip
import io
import json
import zlib

import pytest
from pyspark.sql import functions as F

from docloom.llm import preferences, warc


def test_archives_give_pages_back(spark, tmp_path):
    big = "é" * 300_000
    pages = [
        (1, "http://a/x y", "same", "z"), (2, "http://a", "same", "z"), (3, None, "", "z"), (4, "u", None, "z"),
        (5, "http://ü/\r\nX: y", big, "z"), (6, "u", "one", "z"), (6, "u", "one", "z"), (None, "u", "one", "z"), (None, "u", "lone", "z"),
    ]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, payload string")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(frame).collect()), key=str)
    assert got == sorted(
        [(1, 4, "revisit", 2), (2, 4, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None),
         (5, 600_000, "response", None), (6, 3, "response", None), (6, 3, "response", None), (None, 3, "revisit", 6), (None, 4, "response", None)],
        key=str,
    )
    small = {r.page_id: r.record_type for r in warc.round_trip(frame, min_bytes=4).collect()}
    assert small[3] == "response" and small[1] == "revisit"
    archives = warc.write_archives(warc.with_revisits(frame), f"file://{tmp_path}/w", archive_bytes=200)
    assert archives.agg(F.sum("n_records")).first()[0] == 9
    back = warc.read_archives(archives).filter("record_id = 'urn:page:5'").first()
    assert bytes(back.payload).decode() == big and back.valid and "\r" not in back.target_uri
    assert warc.round_trip(frame.limit(0)).count() == 0


def test_each_record_is_a_gzip_member_and_damage_shows():
    raw = [warc.record("response", f"urn:{i}", None, bytes([65 + i]) * (50_000 * i)) for i in range(4)]
    packed = b"".join(map(warc.member, raw))
    assert gzip.decompress(packed) == b"".join(raw)
    assert [r["payload_bytes"] for r in warc.records(io.BytesIO(packed))] == [0, 50_000, 100_000, 150_000]
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(packed[:-20])))
    changed = raw[1].replace(b"B" * 9, b"C" * 9, 1)
    assert [r["valid"] for r in warc.records(io.BytesIO(warc.member(changed)))] == [False]
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(warc.member(raw[1][:-10]))))
    with pytest.raises((ValueError, zlib.error)):
        list(warc.records(io.BytesIO(b"junk" + packed)))


def test_prompt_is_the_longest_common_prefix(spark):
    turns = "pair_id long, turn long, role string, text string"
    chosen = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "more"), (2, 0, "user", "a"), (3, 0, "user", "x"), (None, 0, "user", "y")]
    rejected = [(1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, 2, "user", "more"), (2, 0, "user", "a"), (2, 0, "user", "a"), (4, 5, None, None)]
    rows = {r.pair_id: r for r in preferences.format_pairs(*(spark.createDataFrame(x, turns) for x in (chosen, rejected))).collect()}
    assert set(rows) == {1, 2, 3, 4}
    one = rows[1]
    assert one.prompt == "<|im_start|>user\nhi<|im_end|>\n" and one.n_prompt_turns == 1
    assert one.chosen == "<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    spans, at = [], 0
    for run in one.chosen_mask:
        spans += [one.chosen[at : at + run.n_chars]] if run.trained else []
        at += run.n_chars
    assert spans == ["yes<|im_end|>\n"] and at == len(one.chosen)
    assert rows[2].chosen == rows[2].rejected == "" and rows[2].n_prompt_turns == 1
    assert rows[3].prompt == "" and rows[3].rejected == "" and "x" in rows[3].chosen
    assert rows[4].rejected == "<|im_start|>\n<|im_end|>\n"


def test_parts_add_up(spark):
    turns = [(7, t, "assistant" if t % 2 else "user", f"t{t}") for t in range(300)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1))
    chosen, rejected = preferences.with_stale_reply(frame)
    whole = preferences.format_pairs(chosen, rejected, turns_a_part=1000).collect()
    parts = sorted(preferences.format_pairs(chosen, rejected, turns_a_part=16).collect(), key=lambda r: r.part)
    assert len(whole) == 1 and len(parts) == 19
    for name in ("prompt", "chosen", "rejected"):
        assert "".join(p[name] for p in parts) == whole[0][name]
    assert whole[0].n_prompt_turns == 299 and "t1<" in whole[0].rejected
    empty = preferences.with_stale_reply(frame.limit(0))
    assert preferences.format_pairs(*empty).count() == 0
    odd = spark.createDataFrame([(1, None, "assistant", "a"), (1, 0, None, None), (None, 1, "user", "b")], "conv_id long, turn long, role string, text string")
    assert [tuple(r)[:3] for r in preferences.format_pairs(*preferences.with_stale_reply(odd)).collect()] == [(1, 0, 1)]


@pytest.mark.parametrize("start", [60, -5, 10**12])
def test_parts_follow_positions_not_numbers(spark, start):
    """Ten turns with gaps are one row wherever their numbers lie."""
    turns = [(7, start + 3 * t, "assistant" if t % 2 else "user", f"t{t}") for t in range(10)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    (row,) = preferences.format_pairs(*preferences.with_stale_reply(frame)).collect()
    assert (row.part, row.n_prompt_turns) == (0, 9) and row.prompt.count("<|im_start|>") == 9


def test_no_python_in_the_plan(spark, capsys):
    frame = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    preferences.format_pairs(*preferences.with_stale_reply(frame)).explain()
    assert "Python" not in capsys.readouterr().out
    assert json.dumps(preferences.TURNS_A_PART)

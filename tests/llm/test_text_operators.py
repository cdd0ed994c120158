import hashlib
import random
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docloom.llm import decontamination, language, line_dedup, mixing, quality, token_counts

ROOT = Path(__file__).resolve().parents[2]
WHITE = " \t\n\x0b\x0c\r"


def brute_lines(docs, min_docs, min_chars):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(WHITE))
    split = [(d, (t or "").split("\n")) for d, t in docs]
    counts = Counter(k for _, lines in split for k in {key(x) for x in lines} if len(k) >= min_chars)
    out = []
    for d, lines in split:
        kept = [x for x in lines if counts[key(x)] < min_docs or len(key(x)) < min_chars]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_lines,at_once", [(1 << 16, 64), (3, 2)])
def test_lines_equal_brute_force(spark, shard_lines, at_once):
    rng = random.Random(1)
    lines = [rng.choice(["", "a", "Ab ", "\tAB", "é", "É", f"line {rng.randrange(60)}"]) for _ in range(3000)]
    docs = [(i if i % 9 else None, "\n".join(rng.sample(lines, rng.randrange(0, 12)))) for i in range(200)] + [(900, None)]
    kept = line_dedup.drop_shared_lines(spark.createDataFrame(docs, "doc_id long, text string"), 4, 1, shard_lines, at_once)
    got = [tuple(r) for r in kept.select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256)).collect()]
    assert sorted(got, key=str) == brute_lines(docs, 4, 1)


def test_lines_of_odd_and_empty_tables(spark, odd_docs):
    kept = line_dedup.drop_shared_lines(odd_docs, min_docs=2)
    assert kept.count() == 10 and kept.select("doc.*").columns == odd_docs.columns
    by_id = {r[0]: r for r in kept.select("doc.doc_id", "n_lines", "n_dropped", "kept_text").collect() if r[0]}
    assert by_id[1][2:] == (1, "") and by_id[2][1:] == (1, 0, "") and by_id[4][1:3] == (4001, 0)
    assert line_dedup.drop_shared_lines(odd_docs.limit(0)).count() == 0


def test_minimal_perfect_hash_numbers_all_keys():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 5000).astype("u8"))
    bits, sizes = line_dedup.build_hash(keys)
    row = {"levels": np.packbits(bits).tobytes(), "sizes": sizes, "fingerprints": b"", "counts": b""}
    assert sorted(line_dedup.Shard(row).numbers(keys)) == list(range(len(keys)))


def reshared(sizes, weights, share, most):
    """Targets by resharing the excess over and over."""
    total, full = share * sum(sizes), set()
    while True:
        rest = total - sum(most * sizes[i] for i in full)
        open_weight = sum(w for i, w in enumerate(weights) if i not in full)
        goal = [most * s if i in full else rest * weights[i] / open_weight for i, s in enumerate(sizes)]
        above = {i for i, g in enumerate(goal) if i not in full and g > most * sizes[i]}
        if not above:
            return goal
        full |= above


def test_targets_equal_resharing(spark):
    rng = random.Random(3)
    for _ in range(4):
        sizes = [rng.choice([0, 1, 5, 40, 300, 2000]) for _ in range(7)] + [50]
        rows = [((True, f"s{i}"), s) for i, s in enumerate(sizes[:-1])] + [((False, ""), 50)]
        frame = spark.createDataFrame(rows, "source_key struct<known:boolean,name:string>, size long")
        got = {r.source_key.name: r.target for r in mixing.targets(frame, (3, 1, 2), 1.5, 2).collect()}
        want = reshared(sizes, [(3, 1, 2)[i % 3] for i in range(8)], 1.5, 2)
        assert [got[n] for n in [f"s{i}" for i in range(7)] + [""]] == pytest.approx(want)


def test_mix_takes_the_budget(spark):
    rng = random.Random(5)
    docs = [(i, "w " * rng.randrange(1, 40), rng.choice("aaaabbc")) for i in range(900)]
    rows = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    assert len(rows) == 900 and all(0 <= r.taken <= 2 * r.size for r in rows)
    for s in "abc":
        mine = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 20
        assert sum(r.size for r in mine) == mine[0].source_size
    again = mixing.mix(spark.createDataFrame(docs[::-1], "doc_id long, text string, source string")).collect()
    assert sorted(rows) == sorted(again)


def test_mix_of_odd_and_empty_tables(spark, odd_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == 10 and all(r.taken <= 2 * r["size"] for r in rows)
    mixed = mixing.mixed_documents(odd_docs)
    assert mixed.columns == [*odd_docs.columns, "mix_epoch"]
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == sum(r.taken for r in rows)
    assert mixing.mix(odd_docs.limit(0)).count() == 0 and mixing.mixed_documents(odd_docs.limit(0)).count() == 0


PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_tokens_equal_the_library(spark):
    rng = random.Random(7)
    letters = "abcdeEFG  \n\t'0123456789.,!?-éüßñ中文日本🎉  ‍َ́"
    texts = ["".join(rng.choices(letters, k=rng.randrange(0, 80))) for _ in range(1500)]
    texts += ["I'll we've 'S <|endoftext|> x<|endoftext|><|endoftext|>", "<|endoftext", "a" * 3000, " " * 500, "ab" * 2000, ""]
    library = Tokenizer.from_file(PATH)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)] + [0]
    frame = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string")
    count = token_counts.token_count(F.col("text"), token_counts.load_vocabulary(PATH), spark)
    got = dict(map(tuple, frame.select("doc_id", count).collect()))
    assert [got[i] for i in range(len(want))] == want


def brute_edits(item, text):
    """Fewest edits between the item and any stretch of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination_equals_full_alignment(spark, odd_docs):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randrange(8, 25)))) for i in range(15)] + [(90, "ab"), (91, ""), (92, None), (None, "x")]
    docs = []
    for d in range(60):
        text = [word() for _ in range(40)]
        piece = list(rng.choice(items[:15])[1])
        for _ in range(rng.choice([0, 0, 1, 3, 6, 9, 14])):
            at = rng.randrange(len(piece))
            rng.choice([lambda: piece.pop(at), lambda: piece.insert(at, "z"), lambda: piece.__setitem__(at, "y")])()
        docs.append((d, f"{' '.join(text[:20])}, {''.join(piece).upper()}!\n{' '.join(text[20:])}" if d % 3 else " ".join(text)))
    prepared = decontamination.prepare([i for i in items if i[0] is not None], 0.1)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    listed = spark.createDataFrame(items, "item_id long, text string")
    for block in (4_000_000, 400):
        found = decontamination.contaminated(frame, listed, 0.1, block).select("doc.doc_id", "matches").collect()
        got = {r.doc_id: {(m.item_id, m.n_edits) for m in r.matches} for r in found}
        for d, text in docs:
            plain, want = decontamination.normalised(text), set()
            for n, i in enumerate(prepared.ids.tolist()):
                edits = brute_edits(prepared.texts[n], plain)
                if edits <= prepared.edits[n] and (len(prepared.texts[n]) >= decontamination.Q or f" {prepared.texts[n]} " in f" {plain} "):
                    want.add((i, edits))
            assert got[d] == want
    kept = decontamination.contaminated(odd_docs, listed)
    assert kept.count() == 10 and kept.select("doc.*").columns == odd_docs.columns
    assert decontamination.contaminated(odd_docs, listed.limit(0)).filter(F.size("matches") > 0).count() == 0
    assert decontamination.contaminated(odd_docs.limit(0), listed).count() == 0


@pytest.mark.parametrize("stretch", [1 << 20, 40])
def test_stretches_lose_no_item(monkeypatch, stretch):
    """Repetitive and plain texts, cut into stretches anywhere, find what alignment with the whole text finds."""
    monkeypatch.setattr(decontamination, "STRETCH", stretch)
    rng = random.Random(7)
    rows = [(i, "".join(rng.choice(["ab", "ba", "aab", "c", "abcab"]) for _ in range(rng.randrange(5, 20)))) for i in range(12)]
    items = decontamination.prepare([*rows, (50, "a" * 40), (51, "abcdefgh" * 6)], 0.1)
    for trial in range(60):
        base = rng.choice(["a" * rng.randrange(60), "ab" * rng.randrange(40), ""])
        piece = list(rng.choice(rows)[1] if trial % 3 else "abcdefgh" * rng.randrange(4, 8))
        for _ in range(rng.randrange(4)):
            piece[rng.randrange(len(piece))] = rng.choice(["", "z", "ab"])
        text = base + "".join(piece) + rng.choice(["a" * 30, "cab" * 9, ""])
        got = {(i, n) for i, n, _ in decontamination.find(text, items, items.present())}
        want = set()
        for n, i in enumerate(items.ids.tolist()):
            edits = brute_edits(items.texts[n], text)
            if edits <= items.edits[n] and len(items.texts[n]) >= decontamination.Q:
                want.add((i, edits))
        assert got == want


@pytest.mark.parametrize("item", ["a" * 300, "a" * 150 + "b" + "a" * 149, "ab" * 150])
def test_a_megabyte_of_one_letter_is_bounded(item):
    """In a process of its own, which reports its peak memory."""
    code = (
        "import resource, time; from docloom.llm import decontamination as d; items = d.prepare([(1, %r)], 0.1); "
        "start = time.time(); before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; "
        "found = d.find('a' * 1_000_000, items, items.present()); "
        "print(found, time.time() - start, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)"
    ) % item
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=ROOT, check=True).stdout
    found, seconds, megabytes = out.rsplit(" ", 2)
    assert float(seconds) < 10 and int(megabytes) < 300
    assert eval(found)[:1] == ([] if "ab" * 2 in item else [(1, int("b" in item), 0)])


def test_language_on_held_out_rows_and_odd_texts(spark, odd_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.train(docs.filter("doc_id % 3 > 0"))
    found = docs.filter("doc_id % 3 = 0").select("lang", language.language(F.col("text"), model, spark).alias("f"))
    rows = found.select("lang", "f.*").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    odd = odd_docs.select("doc_id", "text", language.language(F.col("text"), model, spark).alias("f")).collect()
    for r in odd:
        assert (r.f.lang_pred == "und") == (not any(map(str.isalpha, r.text or ""))) and 0 <= r.f.score <= 1
    assert language.train(docs.limit(0)) is None
    none = odd_docs.select(language.language(F.col("text"), None, spark).alias("f")).collect()
    assert {r.f.lang_pred for r in none} == {"und"}


def test_quality_on_held_out_rows_and_odd_texts(spark, odd_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 7)], "doc_id long, label int")
    model = quality.train(docs, labels.filter("doc_id % 5 > 0").unionByName(odd))
    held = docs.join(labels.filter("doc_id % 5 = 0"), "doc_id")
    rows = held.select("label", quality.quality_score(F.col("text"), model, spark).alias("score")).collect()
    good, bad = ([r.score for r in rows if r.label == k] for k in (1, 0))
    assert np.mean([[a > b for b in bad] for a in good]) >= 0.97
    scores = [r.s for r in odd_docs.select(quality.quality_score(F.col("text"), model, spark).alias("s")).collect()]
    assert len(scores) == 10 and all(0 <= s <= 1 for s in scores)
    assert quality.train(docs.limit(0), labels) is None
    assert odd_docs.select(quality.quality_score(F.col("text"), None, spark).alias("s")).distinct().collect()[0].s == 0.5

"""Centroid clusters, personal data and fill-in-middle against plain versions."""

import hashlib
import random
import re
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import clustering, fill_in_middle, pii, queries
from docloom.llm.clustering import Centroids

DATA = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, cluster string, vector int, distance int"


# --- clusters ---------------------------------------------------------------------------


@pytest.mark.parametrize("spread, bias", [(3, 0), (200, 500), (200_000, -70_000)])
def test_search_equals_full_comparison(spread, bias):
    rng = np.random.default_rng(spread)
    c = rng.integers(-spread, spread, (16, 8)) + bias
    c[5] = c[9]  # equal centroids
    x = np.concatenate([rng.integers(-spread, spread, (2000, 8)) + bias, c, c[:1] + 10 * spread])
    full = np.square(x[:, None, :] - c[None]).sum(axis=2)
    number, distance = Centroids(c).nearest(x)
    assert np.array_equal(number, full.argmin(axis=1)) and np.array_equal(distance, full.min(axis=1))


def plain_clusters(rows, n, rounds, size):
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v):
            kept.append((vec_id, [int(np.floor(64 * float(x))) for x in v]))
    named = lambda i: "" if i is None else str(i)
    c = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"1:{named(r[0])}".encode()).hexdigest(), r[1]))[:n]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, w)) for w in c]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        found = assign()
        for k in range(len(c)):
            own = [v for (_, v), (m, _) in zip(kept, found) if m == k]
            if own:
                c[k] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    inertia = [sum(d for m, d in found if m == k) for k in range(len(c))]
    sha = [hashlib.sha256(",".join(map(str, w)).encode()).hexdigest() for w in c]
    return [(i, m, d, inertia[m], sum(inertia), sha[m]) for (i, _), (m, d) in zip(kept, found)]


def test_clusters_equal_plain_rounds(spark):
    rng = random.Random(3)
    rows = [(i, [float(np.float32(rng.gauss(rng.choice([-1, 0, 1]), 0.3))) for _ in range(8)]) for i in range(150)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (200, None), (201, [1.0] * 7), (202, [1.0] * 9), (203, [])]
    rows += [(204, [None] + [1.0] * 7), (205, [float("nan")] + [1.0] * 7), (206, [float("inf")] + [1.0] * 7), (207, [0.0] * 8)]
    frame = spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in rows], VECTORS).repartition(3)
    got = clustering.cluster(frame, n=5, rounds=3, seed=1, size=8)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_clusters(rows, 5, 3, 8), key=str)


def test_few_or_no_vectors(spark):
    one = spark.createDataFrame([(3, [0.5] * 64, 1, "x", 2, 3)] * 2, VECTORS)
    rows = clustering.cluster(one).collect()
    assert [(r.vec_id, r.cluster, r.distance, r.inertia) for r in rows] == [(3, 0, 0, 0)] * 2
    assert clustering.cluster(one.limit(0)).collect() == []
    large = spark.createDataFrame([(3, [1e30] * 64, 1, "x", 2, 3)], VECTORS)
    with pytest.raises(Exception, match="exact distance"):
        clustering.cluster(large).collect()


# --- personal data ------------------------------------------------------------------------

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain_base(text):
    found = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            odd, even = digits[::-1][::2], digits[::-1][1::2]
            total = sum(map(int, odd)) + sum(sum(map(int, str(2 * int(c)))) for c in even)
            good = [
                True, all(int(p) <= 255 for p in m.group().split(".") if kind == 1),
                13 <= len(digits) <= 19 and total % 10 == 0, 9 <= len(digits) <= 15,
            ][kind]
            if good:
                found.append((kind, m.start(), m.end()))
    return found


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    parts = list("@.+-() _%aZ9é\n") + ["a@b.c", "1.2.3.4", "255.256", "4539148803436467", "4539 1488 0343 6467", "+1 (415) 555-2671", "000.", "12"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 22)))
        assert pii.base_spans(text) == plain_base(text), text


def plain_best(text, model):
    """The best segmentation by trying every one."""
    tokens, bounds = pii.tokens_of(text)
    roles = [pii._role(t) for t in tokens]
    by_start = {}
    for i, j in pii.segments(roles, tokens):
        by_start.setdefault(i, []).append((j, model.scores(pii.features(roles, tokens, i, j))))
    out = pii.OUTSIDE

    @cache
    def best(i, before):
        if i == len(tokens):
            return 0.0, ()
        value, rest = best(i + 1, out)
        options = [(value + model.moves[before, out], rest)]
        for j, scores in by_start.get(i, ()):
            for y in range(out):
                value, rest = best(j, y)
                options.append((value + model.moves[before, y] + scores[y], ((y, bounds[i], bounds[j]), *rest)))
        return max(options, key=lambda o: o[0])

    return best(0, out)


@pytest.fixture(scope="module")
def model(spark):
    return pii.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def total_score(text, found, model):
    tokens, bounds = pii.tokens_of(text)
    roles, place = [pii._role(t) for t in tokens], {b: k for k, b in enumerate(bounds)}
    score, before, at = 0.0, pii.OUTSIDE, 0
    for kind, a, b in [*found, (pii.OUTSIDE, len(text), len(text))]:
        for _ in range(at, place[a]):
            score, before = score + model.moves[before, pii.OUTSIDE], pii.OUTSIDE
        if kind != pii.OUTSIDE:
            names = pii.features(roles, tokens, place[a], place[b])
            score, before, at = score + model.moves[before, kind] + model.scores(names)[kind], kind, place[b]
    return score


def test_decoding_finds_the_best_cut(model):
    rng = random.Random(5)
    parts = ["12", "4539148803436467", "@", ".", "-", " ", "ab", "+1", "(415)", "555-2671", "[at]", "10.0.0.1", "x@y.z"]
    for _ in range(150):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 7)))
        value, _ = plain_best(text, model)
        assert total_score(text, pii.decode(text, model), model) == pytest.approx(value, abs=1e-9), text


def test_gradient_is_that_of_the_likelihood():
    names = {}
    lat = pii.lattice("a@b.cd 4539148803436467", [(0, 0, 6), (2, 7, 23)], names)
    rng = np.random.default_rng(2)
    w, m = rng.normal(size=(len(names), 4)) / 3, rng.normal(size=(5, 5)) / 3

    def likelihood(w, m):
        total = np.full((lat.n + 1, 5), -np.inf)
        total[0, 4] = 0
        for j in range(1, lat.n + 1):
            total[j, 4] = np.logaddexp.reduce(total[j - 1] + m[:, 4])
            for i, rows in lat.ends.get(j, ()):
                for y in range(4):
                    total[j, y] = np.logaddexp(total[j, y], np.logaddexp.reduce(total[i] + m[:, y]) + w[rows, y].sum())
        rows = {(i, j): r for j, found in lat.ends.items() for i, r in found}
        own, before = 0.0, 4
        for i, j, y in lat.right:
            own += m[before, y] + (w[rows[i, j], y].sum() if y < 4 else 0)
            before = y
        return own - np.logaddexp.reduce(total[lat.n])

    g, gm = np.zeros_like(w), np.zeros_like(m)
    pii._gradient(lat, w, m, g, gm)
    for array, gradient in ((w, g), (m, gm)):
        for at in list(np.ndindex(array.shape))[::7]:
            array[at] += 1e-5
            up = likelihood(w, m)
            array[at] -= 2e-5
            down = likelihood(w, m)
            array[at] += 1e-5
            assert gradient[at] == pytest.approx((up - down) / 2e-5, abs=1e-4)


def test_the_field_knows_the_base_spans_and_more(spark, model):
    texts = [r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    base = [(t, s) for t in texts for s in pii.base_spans(t)]
    found = [s in pii.decode(t, model, a, b) for t, s in base for a, b in pii.islands(t) if a <= s[1] < b]
    assert len(base) > 5 and sum(found) >= 0.95 * len(base)
    read = lambda t: [(pii.KINDS[k], t[a:b]) for k, a, b, own in pii.spans(t, model) if not own]
    assert read("call (415) 555-2671 now") == [("phone", "(415) 555-2671")]
    assert read("joe.b[at]mail.org, or") == [("email", "joe.b[at]mail.org")]
    assert read("4539148803436467 10.20.30.40") == [("card", "4539148803436467")]
    for clean in ("in 2019, 12 of 34 came", "4539148803436461", "10.2.3.400", "v1.2.3", "all words @ home", "3.14 or 2,718"):
        assert read(clean) == [], clean


def test_spans_of_odd_rows(spark, odd_docs, model):
    docs = odd_docs.unionByName(spark.createDataFrame([(9, "é a@b.cd " * 3000, None, None, None, None, None, None)], odd_docs.schema))
    rows = docs.select("doc_id", pii.personal_data(F.col("text"), model, spark).alias("spans")).collect()
    by_id = {r.doc_id: r.spans for r in rows}
    assert len(rows) == docs.count() and by_id[2] == by_id[3] == by_id[None] == []
    assert [(s.kind, s.start, s.end, s.is_base) for s in by_id[9]] == [("email", 9 * i + 2, 9 * i + 8, True) for i in range(3000)]
    empty = pii.train(odd_docs.limit(0))
    assert not empty.names and pii.spans("a[at]b.cd a@b.cd", empty) == [(0, 10, 16, True)]


# --- fill in middle -------------------------------------------------------------------------


def test_seek_equals_prefix_sums():
    rng = np.random.default_rng(4)
    for n in [0, 1, 2, 5, 64, 3000]:
        widths = rng.integers(1, 9, n)
        units = fill_in_middle.SkipList(widths)
        sums = np.concatenate([[0], np.cumsum(widths)])
        assert [units.seek(r) for r in range(n + 1)] == sums.tolist()
    assert len(units.lanes) > 4
    assert all(u.sum() == 3000 and p.sum() == widths.sum() for u, p, _ in units.lanes)


def plain_cut(doc_id, text):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    spm = h[3] % 100 < 20
    return len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_cuts_equal_plain_slices(spark, odd_docs):
    rng = random.Random(6)
    extra = [(100 + i, "".join(rng.choice(["ab", "é", "🎉", " ", "<", "P>", "<S", ">", "\n", "12", "Z", "中"]) for _ in range(rng.randrange(60)))) for i in range(300)]
    extra += [(400, "x" * 1_000_000), (401, "1é" * 200_000), (402, "has <M> inside"), (403, "<P<S"), (403, "<P<S")]
    docs = odd_docs.select("doc_id", "text", F.lit("n").alias("n"), F.lit(1).alias("form"), F.lit(2).alias("output"))
    docs = docs.unionByName(spark.createDataFrame([(i, t, "n", 1, 2) for i, t in extra], docs.schema))
    made = fill_in_middle.fill_in_middle(docs)
    rows = made.withColumn("again", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(rows) == docs.count()
    for r in rows:
        text = r.doc.text or ""
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_cut(r.doc.doc_id, text)
        assert r.again == text
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle(docs.limit(0)).count() == 0


def test_personal_data_query(spark):
    rows = queries.op12_personal_data(spark, DATA).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in rows:
        base = plain_base(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in range(4)]
        written = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert set(written) <= set(r.spans.split(","))

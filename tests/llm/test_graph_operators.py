import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docloom.llm import embeddings, near_copies, simhash
from docloom.llm.components import components


def grouped(nodes, pairs):
    """The least node of each node's component."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(200)] + [(7777, 7777)]
    pairs += [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)] + [(5, 4), (4, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = grouped({n for p in pairs for n in p}, pairs)
    assert got == {n: r for n, r in want.items() if n != 7777}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_fingerprint(text, width):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_difference(radius):
    rng = random.Random(4)
    for free in (list(range(64)), [3, 9, 20, 41, 60]):
        masks = simhash.covering_masks(free, radius)
        for _ in range(500):
            differing = sum(1 << b for b in rng.sample(free, radius))
            assert any(not m & differing for m in masks)


def test_simhash_equals_brute_force(spark):
    rng = random.Random(9)
    docs = []
    for i in range(220):
        words = [f"W{rng.randrange(3000)}" for _ in range(rng.choice([0, 1, 2, 30, 200]))]
        docs.append((i, " ".join(words)))
        for k in range(rng.choice([0, 1, 3])):
            changed = list(words)
            if changed:
                changed[rng.randrange(len(changed))] = "new"
            docs.append((1000 + 10 * i + k, "\t".join(changed)))
    docs += [(5000, None), (5001, ""), (None, docs[5][1]), (3, docs[3][1])]
    fps = [brute_fingerprint(t, 3) for _, t in docs]
    near = [(a, b) for a in range(len(docs)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2]
    roots = grouped(range(len(docs)), near)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[roots[i]] = min([x for x in (least.get(roots[i]), d) if x is not None], default=None)
    want = sorted(((d, f - (f >> 63 << 64), least[roots[i]]) for i, ((d, _), f) in enumerate(zip(docs, fps))), key=str)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for hot in (256, 2):
        rows = simhash.near_groups(frame, 2, 3, hot).select("doc_id", "fingerprint", "component_id").collect()
        assert sorted(map(tuple, rows), key=str) == want
    kept = simhash.keep_one(frame, simhash.near_groups(frame, 2, 3)).collect()
    assert len(kept) == len(set(roots.values()))


def test_dense_bucket_is_split_without_loss(spark):
    """All fingerprints within two bits of one point: one component, whatever the bucket limit."""
    points = [0] + [1 << a for a in range(63)] + [1 << a | 1 << b for a in range(63) for b in range(a)]
    frame = spark.createDataFrame([(p,) for p in points], "fp long")
    edges = simhash.links(frame, 2, hot_rows=64)
    assert edges.count() < 20 * len(points)
    roots = components(edges).select("root").distinct().collect()
    assert [r.root for r in roots] == [0]


def test_simhash_of_odd_and_empty_tables(spark, odd_docs):
    rows = simhash.near_groups(odd_docs).collect()
    assert len(rows) == 10
    assert {r.component_id for r in rows if r.fingerprint == 0} == {2}
    kept = simhash.keep_one(odd_docs, simhash.near_groups(odd_docs))
    assert kept.columns == odd_docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 6, 7]
    assert simhash.near_groups(odd_docs.limit(0)).count() == 0


def test_near_copies_equal_brute_force(spark):
    """Copies at a similarity of 0.8 or more join, texts that share a third do not; blocks change nothing."""
    rng = random.Random(8)
    docs = []
    for i in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 90, 300, 1500]))]
        docs.append((10 * i, " ".join(words)))
        for k in range(1, 4):
            edited = list(words)
            for at in rng.sample(range(len(words)), max(1, len(words) // 100)):
                edited[at] = "edited"
            docs.append((10 * i + k, "\n".join(edited).upper()))
        part = len(words) // 3
        docs.append((10 * i + 4, " ".join(words[:part] + [f"x{rng.randrange(5000)}" for _ in range(2 * part)])))
    sets = {d: set(simhash.shingle_hashes(t, 5)) for d, t in docs}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    near = [(a, b) for a in sets for b in sets if b < a and alike(a, b) >= 0.8]
    roots = grouped(list(sets), near)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for block_rows in (8192, 2):
        got = {r.doc_id: r.component_id for r in near_copies.near_groups(frame, block_rows=block_rows).collect()}
        assert got == {d: min(x for x in sets if roots[x] == roots[d]) for d in sets}


def test_near_copies_of_short_texts_equal_brute_force(spark):
    """Texts of 4 to 8 shingles and the same with a word more at either end: all pairs at 0.8 join."""
    rng = random.Random(5)
    docs = []
    for i in range(600):
        words = [f"w{rng.randrange(10**6)}" for _ in range(8 + i % 4)]
        more = [words, [*words, "more"], ["more", *words], [*words, "or", "less"]]
        docs += [(10 * i + k, " ".join(w)) for k, w in enumerate(more)]
    sets = {d: set(simhash.shingle_hashes(t, 5)) for d, t in docs}
    families = [[d for d in sets if d // 10 == i] for i in range(600)]
    close = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    small = [d for d in sets if len(sets[d]) <= 8]
    near = [(a, b) for f in families for a in f for b in f if b < a and close(a, b) and {a, b} <= set(small)]
    roots = grouped(small, near)
    frame = spark.createDataFrame([d for d in docs if len(sets[d[0]]) <= 8], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_copies.near_groups(frame).collect()} == roots


def test_near_copies_without_their_original_equal_brute_force(spark):
    """Families whose members lie just above and below 0.8 of each other: failed links are replaced."""
    rng = random.Random(4)
    docs = []
    for family in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        for k in range(12):
            edited = list(words)
            for at in rng.sample(range(300), rng.choice([3, 4, 4])):
                edited[at] = f"e{rng.randrange(10**6)}"
            docs.append((100 * family + k, " ".join(edited)))
    sets = {d: set(simhash.shingle_hashes(t, 5)) for d, t in docs}
    near = [(a, b) for a in sets for b in sets if b < a and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    roots = grouped(list(sets), near)
    assert len(set(roots.values())) > 14
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for block_rows in (2048, 4):
        got = {r.doc_id: r.component_id for r in near_copies.near_groups(frame, block_rows=block_rows).collect()}
        assert got == roots


@pytest.mark.parametrize("least,most,missed", [(4, 7, 0.0), (8, 31, 0.001), (32, 63, 0.001), (64, 300, 0.001)])
def test_similar_sets_share_a_bucket(least, most, missed):
    """Sets with a similarity of 0.8 have a key in common, but for the share that the docstring names."""
    rng = np.random.default_rng(9)
    apart = 0
    for _ in range(2000):
        union = np.unique(rng.integers(0, 2**63, rng.integers(least, most + 1), dtype=np.uint64))
        differing = rng.permutation(len(union))[: len(union) // 5]
        cut = rng.integers(0, len(differing) + 1)
        a, b = np.delete(union, differing[:cut]), np.delete(union, differing[cut:])
        apart += not set(near_copies.table_keys(a, 24).tolist()) & set(near_copies.table_keys(b, 24).tolist())
    assert apart <= missed * 2000


def test_tiles_join_what_all_pairs_join():
    """A tile's links join the same members as comparing all pairs, for any roots to begin with."""
    rng = np.random.default_rng(3)
    for trial in range(40):
        base = rng.integers(0, 2**63, 60, dtype=np.uint64)
        sets = []
        for _ in range(30):
            drop = rng.random(60) < rng.choice([0.02, 0.08, 0.15, 0.3])
            sets.append(np.unique(np.concatenate([base[~drop], rng.integers(0, 2**63, drop.sum() // 2, dtype=np.uint64)])))
        roots = np.array([min(i, int(rng.integers(0, 30))) if trial % 2 else i for i in range(30)])
        alike = lambda i, j: 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))
        same = [(i, j) for i in range(30) for j in range(i) if roots[i] == roots[j]]
        want = grouped(range(30), same + [(i, j) for i in range(30) for j in range(i) if alike(i, j)])
        found = near_copies.joined_members(sets, roots, 0.8)
        assert all(alike(i, j) for i, j in found) and len(found) < 30
        assert grouped(range(30), same + found) == want


def test_open_tiles_hold_every_pair_of_roots(spark):
    rng = random.Random(3)
    rows = [(k, 100 * k + i, 5, 100 * k + rng.choice([0, 0, 0, 0, 0, 1, 2, i])) for k in range(6) for i in range(40)]
    members = spark.createDataFrame(rows, "key long, point long, n long, root long")
    held = {}
    for r in near_copies.open_tiles(members, 4).collect():
        held.setdefault((r.key, r.one, r.two), set()).add(r.point)
    roots = {p: r for _, p, _, r in rows}
    met = {(a, b) for tile in held.values() for a in tile for b in tile}
    assert all((a, b) in met for a in roots for b in roots if a // 100 == b // 100 and roots[a] != roots[b])
    assert max(map(len, held.values())) < 25


def test_simhash_links_fingerprints_that_differ_in_the_sign_bit(spark):
    pairs = [(1000 * (i + 1), (1000 * (i + 1)) ^ -(1 << 63) ^ (1 << i)) for i in range(40, 46)]
    many = [(7, 7 ^ -(1 << 63) ^ (1 << 5))] + [(7, 7 ^ (1 << b)) for b in (50, 51, 52)]
    points = spark.createDataFrame([(fp,) for fp in sorted({x for p in pairs + many for x in p})], "fp long")
    got = {r.node: r.root for r in components(simhash.links(points, 2)).collect()}
    assert got == grouped({x for p in pairs + many for x in p}, pairs + many)


def test_near_copies_join_simhash_groups_that_the_sets_confirm(spark):
    rng = random.Random(31)
    docs = []
    for family in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(400)]
        for copy in range(4):
            words = list(base)
            for _ in range(copy):
                words[rng.randrange(400)] = f"e{copy}"
            docs.append((10 * family + copy, " ".join(words)))
    phrase = [f"p{i}" for i in range(300)]
    docs += [(900, " ".join(phrase)), (901, " ".join(phrase[:200]))]  # alike, and too far apart
    sets = {d: np.unique(np.array(simhash.shingle_hashes(t, 5), np.uint64)) for d, t in docs}
    prints = {d: simhash.fingerprint_of(s) & (1 << 64) - 1 for d, s in sets.items()}
    ids = sorted(sets)
    near = grouped(ids, [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 3])
    shared = {(a, b): len(np.intersect1d(sets[a], sets[b])) for a in ids for b in ids if a < b and near[a] == near[b]}
    roots = grouped(ids, [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)])
    assert len(set(roots.values())) < len(ids) - 10
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    # no table over shingles: what is joined comes from fingerprints alone
    assert {r.doc_id: r.component_id for r in near_copies.near_groups(frame, tables=0, radius=3).collect()} == roots


def test_near_copies_of_odd_and_empty_tables(spark, odd_docs):
    rows = near_copies.near_groups(odd_docs).collect()
    assert len(rows) == 10 and {r.component_id for r in rows if r.doc_id in (2, 3, 5)} == {2}
    kept = simhash.keep_one(odd_docs, near_copies.near_groups(odd_docs))
    assert kept.columns == odd_docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 6, 7]
    assert near_copies.near_groups(odd_docs.limit(0)).count() == 0


def planted(n, dimension, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dimension))
    near = base[rng.integers(0, n // 4, n)] + rng.normal(size=(n, dimension)) * rng.choice([0.05, 0.2, 0.27, 0.4], (n, 1))
    hot = base[0] + 0.05 * rng.normal(size=(n, dimension))
    return np.concatenate([base, near, hot]).astype(np.float32)


@pytest.mark.parametrize("dimension", [24, 30])
def test_vectors_equal_brute_force(spark, dimension):
    x = planted(300, dimension, 6)
    labels = [int(i % 3) if i < 600 else 1 for i in range(len(x))]
    rows = [(i, x[i].tolist(), labels[i]) for i in range(len(x))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in embeddings.near_vectors(frame, 0.93, tile_rows=40).collect()}
    v = x.astype(float)
    length = np.linalg.norm(v, axis=1)
    linked = (v @ v.T) / np.outer(length, length) >= 0.93
    linked &= np.array(labels)[:, None] == np.array(labels)[None, :]
    np.fill_diagonal(linked, False)
    want = linked.sum(axis=1)
    assert want.sum() > 90_000 and all(got[i].n_links == want[i] for i in got)
    roots = grouped(range(len(x)), np.argwhere(linked).tolist())
    assert all(got[i].component_id == roots[i] and got[i].kept == (roots[i] == i) for i in got)


@pytest.mark.parametrize("kind", ["string", "double", "int"])
def test_vectors_of_several_lengths_and_label_types(spark, kind):
    """Equal vectors of a rare length link; labels 0.2 and 0.7, "1" and "01" are different."""
    names = {"string": ["1", "01", "", None], "double": [0.2, 0.7, 0.0, None], "int": [1, 2, 0, None]}[kind]
    rng = np.random.default_rng(1)
    rows, i = [], 0
    for size, n in ((16, 300), (5, 12), (1, 4)):
        base = rng.normal(size=(max(1, n // 4), size))
        for _ in range(n):
            v = base[rng.integers(0, len(base))] + 0.05 * rng.normal(size=size)
            rows.append((i, v.astype(np.float32).tolist(), names[int(rng.integers(0, 4))]))
            i += 1
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<float>, label {kind}")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(frame).collect()}
    near = []
    for a, v, x in rows:
        for b, w, y in rows:
            if a != b and x is not None and x == y and len(v) == len(w):
                p, q = np.array(v), np.array(w)
                if p @ q / (np.linalg.norm(p) * np.linalg.norm(q)) >= 0.93:
                    near.append((a, b))
    roots = grouped(range(len(rows)), near)
    links = {a: sum(x == a for x, _ in near) for a, _, _ in rows}
    assert got == {a: (links[a], roots[a]) for a, _, _ in rows} and sum(links.values()) > 200


def brute_links(x, labels):
    """Links of each row and the least row reachable, by all cosines."""
    v = np.asarray(x, float)
    length = np.linalg.norm(v, axis=1)
    linked = (v @ v.T) / np.outer(length, length) >= 0.93
    linked &= np.array(labels)[:, None] == np.array(labels)[None, :]
    np.fill_diagonal(linked, False)
    return linked.sum(axis=1), grouped(range(len(v)), np.argwhere(linked).tolist())


@pytest.mark.parametrize("directions", [2, 3, 6])
def test_vectors_of_few_directions_lose_no_link(spark, directions):
    """64 components that vary in few directions: whole differences lie along a plane's normal."""
    rng = np.random.default_rng(directions)
    x = rng.normal(size=(1500, directions)) @ rng.normal(size=(directions, 64))
    x = (x + 0.01 * rng.normal(size=x.shape)).astype(np.float32)
    labels = [int(i % 2) for i in range(len(x))]
    frame = spark.createDataFrame([(i, x[i].tolist(), labels[i]) for i in range(len(x))], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in embeddings.near_vectors(frame).collect()}
    links, roots = brute_links(x, labels)
    assert links.sum() > 1000
    assert all(got[i].n_links == links[i] and got[i].component_id == roots[i] for i in got)


def test_vectors_that_link_with_nothing(spark):
    one = [1.0, 0.0, 0.0]
    rows = [
        (1, one, 1), (2, one, 1), (2, one, 1), (3, one, 2), (4, one, None), (5, None, 1), (6, [0.0, 0.0, 0.0], 1),
        (7, [1.0, None, 0.0], 1), (8, [float("nan"), 0.0, 1.0], 1), (9, [float("inf"), 0.0, 1.0], 1), (10, [1.0], 1),
        (11, [], 1), (None, one, 1), (None, one, 5),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit("x"))
    found = embeddings.near_vectors(frame)
    got = sorted(map(tuple, found.collect()), key=str)
    linked = [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (None, 3, 1, False), (None, 0, None, True)]
    alone = [(i, 0, i, True) for i in range(3, 12)]
    assert got == sorted(linked + alone, key=str)
    assert embeddings.near_vectors(frame.limit(0)).count() == 0
    doubles = frame.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    assert sorted(map(tuple, embeddings.near_vectors(doubles).collect()), key=str) == got

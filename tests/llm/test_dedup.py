"""Exact and SimHash deduplication against brute force."""

import hashlib
import random

import xxhash

from labelforge.llm import block_naming, components, simhash
from llm.small import awkward, frame, words


def brute_exact(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    return sorted(((i, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]),
                    hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows), key=str)


def test_exact_groups_awkward(spark):
    rows = awkward()
    for block in (7, 64, 4096):
        got = block_naming.exact_groups(spark, frame(spark, rows), block).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute_exact(rows)
        assert sum(r.kept for r in got) == len({t or "" for _, t, *_ in rows})


def test_exact_groups_random_near_equal(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab") for _ in range(rng.choice((8, 9, 16, 17, 33)))) for _ in range(40)]
    rows = [(i, rng.choice(texts), "en", "s", 1) for i in range(300)]
    got = block_naming.exact_groups(spark, frame(spark, rows), 4).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute_exact(rows)


def test_exact_groups_shared_hash(spark, monkeypatch):
    """Blocks that share a hash are told apart by their text."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(block_naming.F, "xxhash64", lambda *c: F.lit(1).cast("bigint"))
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(["abcd", "abce", "abcd", "xbcdabcd", "xbcdabce", "xbcdabcd", ""])]
    got = block_naming.exact_groups(spark, frame(spark, rows), 4).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute_exact(rows)


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert block_naming.exact_groups(spark, empty).collect() == []
    assert simhash.near_groups(spark, empty).collect() == []


def brute_simhash(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else [b" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(fps, bits):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_near_groups(spark):
    rng = random.Random(5)
    rows = awkward()
    base = words(300, 2).split()
    for i in range(100, 160):  # near copies: one word changed
        copy = list(base)
        copy[rng.randrange(300)] = "changed"
        rows.append((i, " ".join(copy), "en", "s", 1))
    got = simhash.near_groups(spark, frame(spark, rows)).collect()
    fps = [brute_simhash(t) for _, t, *_ in rows]
    roots = brute_components(fps, 3)
    want = sorted(((i, fp, min((rows[k][0] for k in range(len(rows)) if roots[k] == r and rows[k][0] is not None), default=None))
                   for (i, *_), fp, r in zip(rows, fps, roots, strict=True)), key=str)
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=str) == want


def test_links_of_dense_groups_in_chunks(spark):
    rng = random.Random(9)
    seeds = [rng.getrandbits(64) for _ in range(5)]
    fps = {s ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for s in seeds for _ in range(60)} | {rng.getrandbits(64) for _ in range(50)}
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint").repartition(4)
    found = components.connected_components(spark, simhash.link(spark, df, 3, chunk=16), "a", "b").collect()
    label = {r.node % (1 << 64): r.root for r in found}
    roots = brute_components(fps, 3)
    ours = [label.get(f, ("alone", f)) for f in fps]
    assert len(set(zip(roots, ours, strict=True))) == len(set(roots)) == len(set(ours))


def test_components_chain(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 101), (7, 7), (101, 100)]
    got = components.connected_components(spark, spark.createDataFrame(chain, "a bigint, b bigint"), "a", "b").collect()
    assert {(r.node, r.root) for r in got} == {(i, 0) for i in range(51)} | {(100, 100), (101, 100)}

"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelforge.llm import bloom, spelling
from llm.small import awkward, frame

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute_words(rows, noise=31):
    out = Counter()
    for i, text, *_ in rows:
        for x in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            x = x.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{x}".encode())
            if h % noise == 0:
                x = x[:h % len(x)] + x[h % len(x) + 1:]
            if len(x) >= 7:
                out[x] += 1
    return out


def brute(counts, min_count=2, ratio=10):
    voc = {w: n for w, n in counts.items() if n >= min_count}
    form, rows = {}, {}
    for w, n in voc.items():
        around = [o for o in voc if near(w, o)]
        best = min(around, key=lambda o: (-voc[o], o), default=None)
        form[w] = best if best is not None and voc[best] >= ratio * n else None
        rows[w] = (n, len(around))
    out = set()
    for w, (n, k) in rows.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, k, voc[form[w]] if form[w] else None))
    return out


def corpus():
    rng = random.Random(2)
    base = ["colours", "strasse", "straßee", "éclairs", "ÿÀþ×÷ßx", "aaaaaaaa", "bananas", "recording", "L" * 300]
    rows = awkward()
    for k in range(400):
        text = []
        for _ in range(rng.randrange(12)):
            w = rng.choice(base[:3]) if rng.random() < .6 else rng.choice(base)
            for _ in range(rng.choice((0, 0, 0, 0, 1, 1, 2))):
                i, c = rng.randrange(len(w) + 1), rng.choice("abÿßc")
                w = rng.choice((w[:i] + c + w[i:], w[:i] + c + w[i + 1:], w[:i] + w[i + 1:]))
            text.append(rng.choice((w, w.upper(), w.capitalize())))
        rows.append((k if k % 50 else None, rng.choice((" ", "-", "2", "\n")).join(text), "en", "s", 1))
    return rows


@pytest.mark.parametrize("symbols", [2, 8])
def test_variants(spark, symbols):
    rows = corpus()
    words = spelling.observed_words(frame(spark, rows))
    want = brute_words(rows)
    assert {r.word: r.n for r in words.groupBy("word").agg(F.sum("n").alias("n")).collect()} == want
    got = [tuple(r) for r in spelling.variants(spark, words, symbols=symbols).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(want)


def test_chains_ties_and_repeats(spark):
    """Forms are followed over several steps; equal counts go by code point; counted rows add up."""
    counts = {"abcdefg": 1000000, "abcdefgh": 100000, "abcdefghi": 10000, "abcdefghij": 900, "abcdefghijk": 2,
              "zzzzzzz": 50, "zzzzzzy": 50, "zzzzzzx": 5, "xxxxxxx": 1, "éabcdefg": 7}
    rows = [(w, n - 1) for w, n in counts.items()] + [(w, 1) for w in counts] + [(None, 5)]
    df = spark.createDataFrame(rows, "word string, n bigint").withColumn("key", F.lit("x")).withColumn("other", F.lit(1))
    got = {tuple(r) for r in spelling.variants(spark, df).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == brute(counts)
    assert {r[2] for r in got if r[0] == "abcdefghijk"} == {"abcdefg"} and {r[1] for r in got if r[0] == "zzzzzzx"} == {"zzzzzzy"}


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    rows = corpus()[:150]
    words = spelling.observed_words(frame(spark, rows))
    monkeypatch.setattr(bloom, "MIN_BITS", 64)
    monkeypatch.setattr(bloom, "MAX_BITS", 64)
    got = {tuple(r) for r in spelling.variants(spark, words).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == brute(brute_words(rows))


def test_neighbour_hashes_are_the_reduced_neighbourhood():
    """The hashes equal those of the written-out neighbourhood, for any split of the places."""
    table, symbols = spelling.symbol_table(3), 3
    words = [b"abcdefg", b"aaaaaaa", b"gfedcba"]
    reduced = spelling.Reduced(words, table)

    def key(r):
        twin = object.__new__(spelling.Reduced)
        h = 0
        for s in r:
            h = (h * spelling._BASE + s + 1) % 2**64
        twin.prefix, twin.m = np.array([[h]], np.uint64), len(r)
        return int(twin.keys()[0])

    for step in (1, 3, 100):
        made = [set() for _ in words]
        for start in range(0, 8, step):
            for part in reduced.neighbours(start, start + step, symbols):
                for row, hashes in zip(made, part):
                    row.update(hashes.tolist())
        for w, got in zip(words, made):
            r = [int(table[c]) for c in w]
            want = {key(r[:i] + r[i + 1:]) for i in range(7)} | {key(r[:i] + [c] + r[i + 1:]) for i in range(7) for c in range(3)}
            want |= {key(r[:i] + [c] + r[i:]) for i in range(8) for c in range(3)}
            assert got == want


def test_empty_table(spark):
    assert spelling.variants(spark, spelling.observed_words(frame(spark, []))).collect() == []

"""Source divergence against brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest

from labelforge.llm import bloom, divergence
from llm.small import awkward, frame, words

TERM = re.compile("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, top):
    docs, occ, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = TERM.findall((text or "").translate(LOWER))
        docs[lang].update(set(found))
        occ[lang, source].update(found)
    kept = {g: {t for t, n in docs[g].items() if n >= min_docs} for g, _ in groups}
    out = set()

    def share(n, total, v):
        return 1 + 1000000000 * (n + 5) // (total + 5 * v)

    def ranked(group, part, values, limit):
        for k, (item, value) in enumerate(sorted(values, key=lambda x: (-x[1], x[0].encode()))[:limit], 1):
            out.add((*group, part, item, value, k))

    total = {g: sum(occ[g][t] for t in kept[g[0]]) for g in groups}
    for lang, source in groups:
        terms, v = kept[lang], len(kept[lang])
        p = {s: {t: share(occ[lang, s][t], total[lang, s], v) for t in terms} for g, s in groups if g == lang}
        everywhere = {t: sum(occ[lang, s][t] for s in p) for t in terms}
        q = {t: share(everywhere[t], sum(everywhere.values()), v) for t in terms}
        ranked((lang, source), "pair", [(s, sum(abs(p[source][t] - p[s][t]) for t in terms)) for s in p if s != source], None)
        ranked((lang, source), "term", [(t, p[source][t] - q[t]) for t in terms if occ[lang, source][t] and p[source][t] > q[t]], top)
    return out


def corpus():
    rng = random.Random(8)
    rows = awkward()
    for k in range(200):
        text = f"{words(rng.randrange(5, 40), rng.randrange(5))} Éclair ÉCLAIR l'été 文字{'長' * (k % 4)} {'z' * 70}{'' if k % 2 else 'q'} x{k} Ab\x00cd"
        rows.append((k, text, rng.choice(["en", "fr", None]), rng.choice(["hot", "hot", "a", "b", "ü", None]), 1))
    rows += [(900 + k, "lone words here", "xx", f"s{k}", 1) for k in range(3)] + [(950, None, "yy", "only", 1), (951, "", "yy", None, 1)]
    return rows


@pytest.mark.parametrize("min_docs", [2, 30, 10**6])
def test_audit(spark, min_docs):
    rows = corpus()
    got = [tuple(r) for r in divergence.audit(spark, frame(spark, rows), min_docs, 6, 7, 2).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, min_docs, 6)


def test_kept_terms_with_a_full_filter(spark, monkeypatch):
    """Where the filter lets everything through, the counts alone decide."""
    rows = corpus()
    terms = divergence.distinct_terms(spark, frame(spark, rows))
    want = {tuple(r) for r in divergence.kept_terms(spark, terms, 9).collect()}
    monkeypatch.setattr(bloom, "MIN_BITS", 64)
    monkeypatch.setattr(bloom, "MAX_BITS", 64)
    for first in (1, 2, 5):
        assert {tuple(r) for r in divergence.kept_terms(spark, terms, 9, first).collect()} == want
    assert ("fr", "été ".encode()) in want


def test_large_counts_are_exact(spark):
    from pyspark.sql import functions as F

    big = 3 * 10**12 + 1
    df = spark.createDataFrame([(big, 7 * big, 12345)], "n bigint, total bigint, kinds bigint")
    got = df.select(divergence._share(F.col("n"), F.col("total"), F.col("kinds")).alias("p")).first().p
    assert got == 1 + 1000000000 * (big + 5) // (7 * big + 5 * 12345)


def test_empty_table(spark):
    assert divergence.audit(spark, frame(spark, [])).collect() == []

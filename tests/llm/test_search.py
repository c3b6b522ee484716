"""Licence scan, decontamination, substring dedup and the pipeline on small inputs."""

import hashlib
import random

import numpy as np

import corpus_pipeline
from labelforge.llm import block_naming, decontaminate, fm_dedup, license_scan, mixing, simhash
from labelforge.llm.common import stored
from llm.small import LOREM, awkward, frame, words


def brute_removed(rows, m):
    split = [(t or "").split() for _, t, *_ in rows]
    first = {}
    for (i, *_), w in zip(rows, split, strict=True):
        for s in range(len(w) - m + 1):
            if i is not None:
                k = tuple(w[s:s + m])
                first[k] = min(first.get(k, i), i)
    out = []
    for (i, *_), w in zip(rows, split, strict=True):
        gone = set()
        for s in range(len(w) - m + 1):
            if i is not None and first[tuple(w[s:s + m])] < i:
                gone.update(range(s, s + m))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_removed_words(spark):
    rng = random.Random(7)
    rows = awkward()
    passage = words(40, 5)
    for i in range(200, 240):
        rows.append((i, " ".join(rng.choice(LOREM) for _ in range(rng.randrange(0, 30))) + " " + passage + " " + " ".join(rng.choice(LOREM[:3]) for _ in range(30)), "en", "s", 1))
    for options in ({}, {"hot_documents": 3, "shard_words": 200}):
        got = fm_dedup.removed_words(spark, frame(spark, rows), 13, **options).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute_removed(rows, 13)
    assert fm_dedup.removed_words(spark, frame(spark, [])).collect() == []


def test_minimizer_repeated_inside_documents_is_hot(spark):
    """A gram of two documents only, but of very many places in each: its segments must not meet in one shard."""
    rng = random.Random(3)

    def lines(gram, n, tag):
        return " ".join(f"{gram} " + " ".join(f"{tag}{rng.randrange(10**6)}" for _ in range(9)) for _ in range(n)).encode()

    def windows(gram):
        _, _, _, count, found = fm_dedup.segments_of([lines(gram, 20, "x")], 13, 4)
        return max((int(count[found == g].sum()), int(g)) for g in set(found.tolist()))

    (many, gram), name = max((windows(f"a{k} b{k} c{k} d{k}"), f"a{k} b{k} c{k} d{k}") for k in range(60))
    assert many > 100
    shared = lines(name, 4, "s").decode()
    rows = [(i, lines(name, 400, f"u{i}").decode() + " " + shared, "en", "s", 1) for i in (1, 2)] + awkward()
    docs = frame(spark, rows)
    seen, hot, words_held = fm_dedup.minimizer_filters(spark, docs.select("text"), 13, 4, 2048, 1000)
    assert fm_dedup._has(seen, np.array([gram]))[0] and fm_dedup._has(hot, np.array([gram]))[0]
    assert words_held > 2 * 400 * 13
    _, cold, fewer = fm_dedup.minimizer_filters(spark, docs.select("text"), 13, 4, 2048)
    assert not cold.any() and fewer > 2 * 400 * 13
    got = fm_dedup.removed_words(spark, docs, 13, hot_windows=1000, shard_words=500).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute_removed(rows, 13)


def test_segments_by_whole_arrays(monkeypatch):
    """Words, hashes and minimizers of many texts without a call for each word, whatever blanks part the words."""
    def called(*_):
        raise AssertionError("a word hashed on its own")

    rng = random.Random(8)
    blanks, known = [" ", "  ", "\n", "\t\r\n", "\x0b", "\x0c "], [*LOREM[:6], "é", "文字", "a\u00a0b", "\x1c", "x" * 50]
    texts = ["".join(rng.choice(known) + rng.choice(blanks) for _ in range(rng.randrange(60))) for _ in range(40)]
    texts = [t.encode() for t in ["", " \n", *texts, " " + texts[0], "one", ""]]
    monkeypatch.setattr(fm_dedup.xxhash, "xxh64_intdigest", called)
    words, text, start, count, gram = fm_dedup.segments_of(texts, 13, 4)
    split = [t.split() for t in texts]
    assert np.diff(words.first).tolist() == [len(w) for w in split]
    flat = [w for ws in split for w in ws]
    assert words.pieces(np.arange(len(flat)), np.arange(len(flat)) + 1) == flat
    hashes = fm_dedup.word_hashes(words)
    assert len(set(hashes.tolist())) == len(set(flat)) == len(set(zip(flat, hashes.tolist())))
    monkeypatch.setattr(fm_dedup, "HASHED_BYTES", 20)  # less than a word
    assert np.array_equal(fm_dedup.word_hashes(words), hashes)
    found = {}  # every window in one segment; equal windows have one minimizer
    for t, s, n, g in zip(text.tolist(), start.tolist(), count.tolist(), gram.tolist()):
        for i in range(s, s + n):
            assert (t, i) not in found
            found[t, i] = (tuple(split[t][i:i + 13]), g)
    assert set(found) == {(t, i) for t, w in enumerate(split) for i in range(len(w) - 12)}
    assert len(set(found.values())) == len({w for w, _ in found.values()})
    values = np.array([rng.randrange(4) for _ in range(200)], np.uint64)
    assert fm_dedup._least_places(values, 10).tolist() == [i + int(values[i:i + 10].argmin()) for i in range(191)]


def test_window_owners_in_a_row():
    rng = random.Random(9)
    segments = list({" ".join(rng.choice(LOREM[:2]) for _ in range(rng.randrange(5, 15))).encode() for _ in range(60)})
    owners = np.array([rng.randrange(100) for _ in segments])
    least, counts = fm_dedup.window_owners(segments, owners, 5)
    windows = [tuple(s.split()[i:i + 5]) for s in segments for i in range(len(s.split()) - 4)]
    assert counts.tolist() == [len(s.split()) - 4 for s in segments]
    holder, best = np.repeat(owners, counts).tolist(), {}
    for w, o in zip(windows, holder, strict=True):
        best[w] = min(best.get(w, 100), o)
    assert least.tolist() == [best[w] for w in windows]


def test_kept_text_and_intervals(spark):
    """Texts and spans of documents with several repeats, side by side in a batch with others that have none or no words."""
    rng = random.Random(4)
    first, second = words(20, 1), words(15, 9, 3)
    rows = [(1, first, "en", "s", 1), (2, second, "en", "s", 1), (3, f"x {first}\ny  {second}", "en", "s", 1), (4, "", "en", "s", 1),
            (5, first, "en", "s", 1), (6, f" {second} z", "en", "s", 1), (7, None, "en", "s", 1), (None, first, "en", "s", 1), (8, "é z", "en", "s", 1)]
    rows += [(9 + k, " ".join([first, second, "q" * k, first][:rng.randrange(1, 5)]), "en", "s", 1) for k in range(9)]
    seen, want = {}, []
    for i, t, *_ in rows:  # ids ascend
        w = (t or "").split()
        gone = [False] * len(w)
        for s in range(len(w) - 12):
            if i is not None and seen.setdefault(tuple(w[s:s + 13]), i) < i:
                gone[s:s + 13] = [True] * 13
        turns = [k for k, (a, b) in enumerate(zip([False, *gone], [*gone, False])) if a != b]
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want.append((i, kept if any(gone) else None, [[a, b] for a, b in zip(turns[::2], turns[1::2])]))
    got = fm_dedup.removed_words(spark, frame(spark, rows).coalesce(1)).collect()
    assert sorted(((r.doc_id, r.kept_text, [list(x) for x in r.intervals]) for r in got), key=str) == sorted(want, key=str)


def test_fm_index_counts():
    rng = np.random.default_rng(3)
    text = np.append(rng.integers(1, 4, 300), 0)
    index = fm_dedup.FMIndex(text, 4, 5)
    starts = np.arange(290)
    low, high = index.intervals(text, starts, 5)
    for s in starts:
        same = [p for p in range(297) if (text[p:p + 5] == text[s:s + 5]).all()]
        assert sorted(index.suffixes[low[s]:high[s]]) == same


def test_license_scan(spark):
    rows = awkward() + [(300, words(30) + " Released under the MIT License. " + words(20, 4), "en", "s", 1),
                        (301, license_scan.TEMPLATES["MIT-notice"].upper() + " " + words(50), "en", "s", 1),
                        (302, "released under the apache license", "en", "s", 1)]
    got = {(r.doc_id, r.license, round(r.containment, 3)) for r in license_scan.scan(spark, frame(spark, rows)).collect()}
    assert got == {(300, "MIT", 1.0), (301, "MIT-notice", 1.0)}
    assert license_scan.scan(spark, frame(spark, [])).collect() == []


def test_license_wordings_and_versions(spark):
    lines = [
        ("This project is licensed under the MIT License.", {"MIT-licensed"}),
        ("Licensed under the Apache License 2.0.", {"Apache-2.0-line"}),
        ("Licensed under CC BY 4.0.", {"CC-BY-4.0-short-under"}),
        ("Licensed under CC BY-NC 3.0.", {"CC-BY-NC-3.0-short"}),
        ("Licensed under CC BY-NC 4.0.", {"CC-BY-NC-4.0", "CC-BY-NC-4.0-short"}),
        ("Licensed under the GNU General Public License, version 2.", {"GPL-2.0"}),
        ("This work is licensed under the GNU General Public License, version 3.", {"GPL-3.0"}),
        ("GNU Lesser General Public License, version 3", {"LGPL-3.0"}),
        ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
         "as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", {"LGPL-notice", "GNU-version-2.1"}),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License "
         "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", {"AGPL-notice", "GNU-version-3"}),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
         "as published by the Free Software Foundation, either version 3 of the License.", {"GPL-notice", "GNU-version-3"}),
    ]
    rows = [(700 + i, f"{words(30, i)} {line} {words(20, i + 4)}", "en", "s", 1) for i, (line, _) in enumerate(lines)]
    got = {(r.doc_id, r.license) for r in license_scan.scan(spark, frame(spark, rows)).collect()}
    assert got == {(700 + i, name) for i, (_, names) in enumerate(lines) for name in names}


def test_decontamination(spark):
    item = words(40, 11)
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (4, words(25, 2)), (5, item)], "item_id bigint, text string")
    near = item.split()
    near[0] = "different"
    rows = awkward() + [(400, words(100) + " " + item.upper() + ". " + words(30, 8), "en", "s", 1), (401, " ".join(near), "en", "s", 1),
                        (402, " ".join(item.split()[:15]), "en", "s", 1)]
    found = decontaminate.find(spark, frame(spark, rows), bench).collect()
    got = {(r.doc_id, r.item_id, round(r.similarity, 3)) for r in found}
    assert {x for x in got if x[0] in (400, 401, 402)} == {(400, 1, 1.0), (400, 5, 1.0), (401, 1, round(35 / 37, 3)), (401, 5, round(35 / 37, 3))}
    assert decontaminate.find(spark, frame(spark, []), bench).collect() == []
    assert decontaminate.find(spark, frame(spark, rows), bench.limit(0)).collect() == []


def test_pipeline_stages_keep_columns(spark, tmp_path):
    frame(spark, awkward(), extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (6, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, words(60, 4))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
    exact = corpus_pipeline.exact_dedup(spark, docs, str(tmp_path)).collect()
    assert sorted(r.text or "" for r in exact) == sorted({t or "" for _, t, *_ in awkward()})
    assert block_naming.exact_groups(spark, docs).where("kept").count() == len(exact)
    clean = corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()
    leaked = [i for i, t, *_ in awkward() if words(60, 4) in (t or "")]
    assert leaked == [6, 7]
    assert sorted((r.doc_id for r in clean), key=str) == sorted((i for i, *_ in awkward() if i not in leaked), key=str)


def test_rows_keep_their_number_when_splits_change(spark, tmp_path, monkeypatch):
    """Scans are dealt anew between the jobs, as after the loss of an executor."""
    rows = awkward() + [(500 + i, words(50 + i, i, 3), "en", "s", 1) for i in range(20)] + [(600, words(60, 4), "fr", "s", 1)]
    frame(spark, rows, extra=False).repartition(6, "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, words(60, 4))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, bench = (spark.read.parquet(f"{tmp_path}/{x}.parquet") for x in ("documents", "benchmark"))
    one = {"spark.sql.files.minPartitionNum": "1", "spark.sql.files.openCostInBytes": "1"}

    def deal():
        for k, v in one.items():
            spark.conf.set(k, v)

    def late(run):
        """The result of a plan that is run after the splits have changed."""
        try:
            out = run()
            deal()
            return out.collect()
        finally:
            for k in one:
                spark.conf.unset(k)

    exact = late(lambda: corpus_pipeline.exact_dedup(spark, docs, str(tmp_path)))
    assert sorted(r.text or "" for r in exact) == sorted({t or "" for _, t, *_ in rows})
    near = late(lambda: corpus_pipeline.near_dedup(spark, docs, str(tmp_path)))
    groups = simhash.near_groups(spark, docs).select("component_id").distinct().collect()
    assert sorted((r.doc_id for r in near), key=str) == sorted((r.component_id for r in groups), key=str)
    clean = late(lambda: corpus_pipeline.decontamination(spark, docs, str(tmp_path)))
    assert sorted((r.doc_id for r in clean), key=str) == sorted((i for i, *_ in rows if i not in (6, 7, 600)), key=str)
    mixed = late(lambda: corpus_pipeline.mix(spark, docs, str(tmp_path)))
    kept = mixing.mix(spark, docs).where("kept").collect()
    assert sorted((r.doc_id for r in mixed), key=str) == sorted((r.doc_id for r in kept), key=str)

    def dealt(session, df, name):
        out = stored(session, df, name)
        if name == "benchmark-hits":
            deal()
        return out

    monkeypatch.setattr(decontaminate, "stored", dealt)
    found = late(lambda: decontaminate.find(spark, docs, bench))
    assert sorted(r.doc_id for r in found) == [6, 7, 600]

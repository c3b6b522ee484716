"""Token id files: code, blocks, random access, and whole corpora against the tokenizer."""

import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from labelforge.llm import token_files as tf
from llm.small import awkward, frame, words

PATH = public_tokenizers.path("byte_bpe_50k.json")


def least_bits(counts, limit):
    """Least total bits of a code with lengths up to ``limit``: by the coin collector's
    definition, the 2n - 2 lightest items of nested packages, kept as lists of leaves."""
    level = []
    for _ in range(limit):
        pairs = [(level[i][0] + level[i + 1][0], level[i][1] + level[i + 1][1]) for i in range(0, len(level) - 1, 2)]
        level = sorted([(c, [k]) for k, c in enumerate(counts)] + pairs, key=lambda x: x[0])
    return sum(w for w, _ in level[:2 * len(counts) - 2])


@pytest.mark.parametrize("limit", [4, 5, 9, 20])
def test_code_lengths_least_and_limited(limit):
    rng = random.Random(limit)
    for n in (2, 3, 7, 16):
        counts = [int(rng.paretovariate(0.4)) for _ in range(n)]
        lengths = tf.code_lengths(np.array(counts), limit).astype(int)
        assert lengths.max() <= limit and sum(2.0 ** -lengths) == 1
        assert int((lengths * counts).sum()) == least_bits(counts, limit)


def test_canonical_codes_are_prefix_free_and_ordered():
    lengths = tf.code_lengths(np.array([5, 0, 1, 1, 9, 3, 0, 2]))
    codes = tf.canonical(lengths)
    strings = sorted((int(n), i, format(int(codes[i]), f"0{n}b")) for i, n in enumerate(lengths) if n)
    assert [s for *_, s in strings] == sorted(s for *_, s in strings)
    assert not any(b.startswith(a) for *_, a in strings for *_, b in strings if a != b)


@pytest.mark.parametrize("n", [1, 2, tf.CHECKPOINT, tf.CHECKPOINT + 1, tf.BLOCK_IDS, tf.BLOCK_IDS + 3, 3 * tf.BLOCK_IDS + 700])
def test_file_round_trip_and_random_access(tmp_path, n, monkeypatch):
    monkeypatch.setattr(tf, "HELD_BLOCKS", 2)
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.2, n), 999).astype(np.int64)
    lengths = tf.code_lengths(np.bincount(ids, minlength=1000), 12)
    tf.write_code(str(tmp_path), lengths)
    writer, cuts = tf.Writer(str(tmp_path), 77, lengths, tf.canonical(lengths)), sorted({0, n, *rng.integers(0, n, 5).tolist()})
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        writer.add(None if k == 0 else k, ids[a:b])
    writer.add(99, ids[:0])
    made = writer.close()
    reader = tf.Reader(str(tmp_path), made["file"])
    assert np.array_equal(np.concatenate(list(reader.stream())), ids)
    assert reader.doc_ids.to_pylist() == [None, *range(1, len(cuts) - 1), 99]
    got = [(s, k, crc) for _, s, k, crc in reader.documents()]
    assert got == [(77 + a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes())) for a, b in [*zip(cuts, cuts[1:]), (n, n)]]
    for a, b in [(0, 1), (0, n), (n // 2, n // 2 + 600), (n - 1, n + 50), (n, n + 9)]:
        assert np.array_equal(reader.ids(77 + a, 77 + b), ids[a:b])


def test_file_of_another_code_is_refused(tmp_path):
    lengths = tf.code_lengths(np.array([3, 2, 1]))
    tf.write_code(str(tmp_path), lengths)
    writer = tf.Writer(str(tmp_path), 0, lengths, tf.canonical(lengths))
    writer.add(1, np.array([0, 1, 2]))
    name = writer.close()["file"]
    tf.write_code(str(tmp_path), tf.code_lengths(np.array([1, 1, 1, 1])))
    with pytest.raises(ValueError):
        tf.Reader(str(tmp_path), name)


def test_pieces_give_the_ids_of_whole_texts(tmp_path):
    rng, tokenizer = random.Random(1), Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    parts = ["the", " ", "  ", "\n", " \n ", "\t", "don't", "'s", " 's", "12", " 3", "é", "文字", " ", " ", "…", "!?", "a" * 100, "<|endoftext|>", "\x1c", "​", "🙂", ""]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(400)]
    assert tf.pieces_stand_alone(PATH)
    got = tf.text_encoder(PATH, "<u2")(texts)
    assert got == [np.array(e.ids, "<u2").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    with open(PATH, encoding="utf-8") as f:
        made = json.load(f)
    made["normalizer"] = {"type": "Lowercase"}
    other = tmp_path / "lower.json"
    other.write_text(json.dumps(made))
    assert not tf.pieces_stand_alone(str(other))
    lower = Tokenizer.from_file(str(other))
    lower.encode_special_tokens = True
    assert tf.text_encoder(str(other), "<u4")(["The END  x"]) == [np.array(lower.encode("The END  x", add_special_tokens=False).ids, "<u4").tobytes()]


def test_new_pieces_reach_the_library_in_rows(monkeypatch):
    """Some calls of the library for thousands of new words, none for known ones, and the ids of whole texts however
    little is held and where the bytes of ids do not tell the pieces of a row apart."""
    rng, tokenizer, known = random.Random(2), Tokenizer.from_file(PATH), tf.text_encoder(PATH, "<u2")
    tokenizer.encode_special_tokens = True
    letters = ["a", "é", "ß", "×", "ÿ", "文", "'", "th", "ing", "7"]
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) + rng.choice(["", "", ".", ",\n", "\u3000", "\x1c"])
                      for _ in range(400)) for _ in range(20)] + ["", " ", "\n", "b", ".", " b", "b\n", "\nb", "b " + "c" * 999, "  d"]
    want = [np.array(e.ids, "<u2").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    sent = []

    def library(rows):
        sent.append(len(rows))
        return known.encode(rows)

    plain = [t.translate({c: " " for c in (0x3000, 0x1c, 0x0a)}).replace("  ", " ") for t in texts[:20]]
    encoder = tf.PieceEncoder(library, known.widths, "<u2")
    first, n = encoder(plain), sum(sent)
    assert len(encoder.held) > 4000 and n < 400
    assert encoder(plain) == first and sum(sent) == n
    assert encoder(texts) == want
    assert tf.PieceEncoder(known.encode, known.widths * 0 + 1, "<u2")(texts) == want
    monkeypatch.setattr(tf, "HELD_PIECES", 10)
    monkeypatch.setattr(tf, "HELD_IDS", 50)
    assert [b for t in texts for b in encoder([t])] == want and len(encoder.held) < 4000


def brute(rows):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    found = [(i, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [tf.END_ID], "<u4")) for i, t, *_ in rows]
    return sorted(((i, len(ids), zlib.crc32(ids.tobytes())) for i, ids in found), key=lambda r: (r[0] is not None, r[0] or 0)), sum(len(ids) for _, ids in found)


@pytest.mark.parametrize("files", [1 << 28, 1000])
def test_corpus_against_the_tokenizer(spark, monkeypatch, files):
    monkeypatch.setattr(tf, "FILE_IDS", files)
    rows = awkward() + [(k % 9, words(30 + k % 50, k), "en", "s", 1) for k in range(150)] + [(50, "same", "en", "s", 1)] * 100
    random.Random(4).shuffle(rows)
    folder, made = tf.write_corpus(spark, frame(spark, rows), PATH)
    got = sorted((tuple(r) for r in tf.read_documents(spark, folder, made).collect()), key=lambda r: r[1])
    want, total = brute(rows)
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert [key(r) for r in got] == sorted(key(r) for r in got)  # ascending doc_id, NULL first
    assert sorted(((i, n, c) for i, _, n, c in got), key=lambda r: (key(r), r)) == sorted(want, key=lambda r: (key(r), r))
    assert [s for _, s, *_ in got] == np.cumsum([0] + [n for _, _, n, _ in got])[:-1].tolist()
    listed = sorted(made.collect(), key=lambda r: r.first)
    assert sum(r.ids for r in listed) == total and sum(r.docs for r in listed) == len(rows)


def test_empty_table(spark):
    folder, made = tf.write_corpus(spark, frame(spark, []), PATH)
    assert made.collect() == [] and tf.read_documents(spark, folder, made).collect() == []

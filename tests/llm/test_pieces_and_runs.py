"""SentencePiece, resampling and periodic runs: against the library, brute force, and on tables with odd rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from maskwright.llm import periodic_runs, piece_bpe, queries, resampling

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = list("aAbz 019'sTt%$-éß▁\t\n\r’€中文字😀\x00\x1c 　ｱﬁ�") + ["  ", "    ", "the ", "ing", "<s>", "<0x0A>", "<unk>", "\r\n", "=" * 30, "a" * 40, "é"]


def random_texts(n, seed, pieces=ODD, most=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, most))) for _ in range(n)]


def hexed(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


# ---- SentencePiece -------------------------------------------------------------------------------


def test_words_segmented_apart_equal_the_library(monkeypatch):
    c = piece_bpe.codec(MODEL)
    monkeypatch.setattr(piece_bpe, "PART", 7)
    for text in random_texts(3000, 1):
        assert [k for words in c.split(text) for w in words for k in c.segment(w)] == c.model.encode(text), text


def test_decoding_in_parts_equals_the_library(monkeypatch):
    c, rng = piece_bpe.codec(MODEL), random.Random(2)
    for text in random_texts(1500, 3):
        monkeypatch.setattr(piece_bpe, "IDS", rng.randint(1, 6))
        ids = c.model.encode(text)
        assert c.decode(np.asarray(ids, "<u4").tobytes()) == c.model.decode(ids), text


def test_words_are_segmented_once(monkeypatch):
    c, seen = piece_bpe.codec(MODEL), []
    monkeypatch.setattr(type(c), "segment", lambda self, word: seen.append(word) or self.model.encode(word[1:]))
    table = piece_bpe.Table(c, 1000)
    for _ in range(3):
        assert np.frombuffer(table.ids("some words and some more words"), "<u4").tolist() == c.model.encode("some words and some more words")
    assert sorted(seen) == sorted("▁some ▁words ▁and ▁more".split())


def test_a_vocabulary_with_markers_inside_is_refused(monkeypatch):
    import sentencepiece

    class Other(sentencepiece.SentencePieceProcessor):
        def id_to_piece(self, k):
            return "a▁b" if k == 400 else super().id_to_piece(k)

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Other)
    with pytest.raises(ValueError, match="apart"):
        piece_bpe.Codec(MODEL)


@pytest.mark.parametrize("distinct", [piece_bpe.DISTINCT, 20])
def test_encoding_a_table(spark, distinct):
    c = piece_bpe.codec(MODEL)
    texts = [None, "", " ", "same text", "same text", "long " * 3000, "中" * 500, *random_texts(120, 4)]
    rows = [(k if k else None, t, "x", 1) for k, t in enumerate(texts)] + [(5, "long " * 3000, "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    got = piece_bpe.decode_documents(piece_bpe.encode_documents(docs, MODEL, distinct=distinct), MODEL)
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded", "ids_sha256"]
    want = sorted((-1 if k is None else k, len(i := c.model.encode(t or "")), np.asarray(i, "<u4").tobytes(), c.model.decode(i) if i else "") for k, t, *_ in rows)
    assert sorted((-1 if r[0] is None else r[0], r[1], bytes(r[2]), r[3]) for r in got.collect()) == want


def test_op11_on_a_table(spark, tmp_path):
    c = piece_bpe.codec(MODEL)
    texts = [None, "", *random_texts(60, 5)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for row in queries.op11_sentencepiece(spark, str(tmp_path)).collect():
        ids = c.model.encode(texts[row["doc_id"]] or "")
        assert row["n_tokens"] == len(ids) and row["ids_sha256"] == hexed(",".join(map(str, ids)))
        assert row["decoded_sha256"] == hexed(c.model.decode(ids) if ids else "")


def test_op11_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert piece_bpe.decode_documents(piece_bpe.encode_documents(empty, MODEL), MODEL).collect() == []


# ---- resampling ----------------------------------------------------------------------------------


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_buckets(words, run=2):
    return [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10000 for k in range(1, run + 1) for i in range(len(words) - k + 1)]


def test_chunks_own_every_run_once(monkeypatch):
    rng, known = random.Random(6), resampling.Words()
    monkeypatch.setattr(resampling, "WORDS", 30)
    for text in random_texts(1500, 7, list("aB9 .,'é中\x7f\n") + ["word", "THE", "  "], 50):
        run, chunk = rng.randint(1, 4), rng.randint(1, 20)
        parts = list(resampling.cut_text(text, chunk, run))
        assert "".join(t[:own] for t, own in parts) == text
        made = [resampling.features(known, t, own, run, 10000) for t, own in parts]
        assert sum(n for n, _ in made) == len(plain_words(text))
        assert sorted(b for _, found in made for b in found.tolist()) == sorted(plain_buckets(plain_words(text), run))


def brute_resample(rows, benchmark):
    source, target = [0] * 10000, [0] * 10000
    for _, text in rows:
        for b in plain_buckets(plain_words(text)):
            source[b] += 1
    for text in benchmark:
        for b in plain_buckets(plain_words(text)):
            target[b] += 1
    total, wanted = sum(source), sum(target)
    gain = [math.floor(1000 * math.log((t + 1) * (total + 10000) / ((s + 1) * (wanted + 10000)))) for s, t in zip(source, target, strict=True)]
    out = []
    for doc, text in rows:
        words = plain_words(text)
        found = plain_buckets(words)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hexed(f"7:{'' if doc is None else doc}")[:8], 16)
        out.append([doc, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, row in enumerate(fit[: 25 * len(fit) // 100]):
        row[5] = k + 1
    return sorted((tuple(r) for r in out), key=repr)


def resampling_rows():
    rng = random.Random(8)
    words = ["the", "Cat", "sat", "on", "é9", "matte", "中文", "x.y"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    rows = [(k, t) for k, t in enumerate(texts)]
    return [*rows, (None, texts[0] * 3), (900, None), (901, ""), (902, "..."), (903, "the cat " * 700), (903, "the cat " * 700), (904, "w" * 5000), (905, " " * 3000 + "cat")]


@pytest.mark.parametrize("chunk", [1 << 16, 100])
def test_resampling_against_brute_force(spark, chunk):
    rows, benchmark = resampling_rows(), ["The cat sat on the matte", None, "中文 é9"]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, score int")
    target = spark.createDataFrame([(k, t) for k, t in enumerate(benchmark)], "item_id long, text string")
    got = resampling.resample(docs, target, chunk=chunk)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_resample(rows, benchmark)


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b " * 20), (2, "c d " * 30)], "doc_id long, text string")
    assert resampling.resample(none, some).collect() == []
    assert sorted((tuple(r) for r in resampling.resample(some, none).collect()), key=repr) == brute_resample([(1, "a b " * 20), (2, "c d " * 30)], [])


# ---- periodic runs -------------------------------------------------------------------------------


def brute_runs(s):
    out = {}
    for p in range(1, len(s) // 4 + 1):
        i = 0
        while i + p < len(s):
            if s[i] != s[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(s) and s[j] == s[j + p]:
                j += 1
            if j + p - i >= max(6, 4 * p):
                out.setdefault((i, j + p - i), p)
            i = j
    return sorted((a, n, p) for (a, n), p in out.items())


def test_runs_against_brute_force():
    rng = random.Random(9)
    for _ in range(4000):
        k, s = rng.choice([1, 2, 2, 3, 6]), []
        while len(s) < rng.randint(0, 90):
            s += [rng.randint(1, k) for _ in range(rng.randint(1, 6))] * rng.randint(1, 9) if rng.random() < 0.5 else [rng.randint(1, k)]
        assert periodic_runs.runs(np.array(s, np.int64)) == brute_runs(s), s


def brute_op13(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), None if doc is None else zlib.crc32(str(doc).encode())
    if n and h is not None and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    gone = {i for start, length, period in found for i in range(start + period, start + length)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    milli = None if top[0] is None else 1000 * top[1] // top[2]
    return (doc, len(found), *top, milli, hexed("".join(f"{a},{b},{c}\n" for a, b, c in found)), hexed(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_op13_on_a_table(spark, tmp_path):
    rng = random.Random(10)
    texts = [None, "", " \t\n", "a", "a a a a a a", "a a a a a", "ha\x0bha ha ha " * 9, "b " * 3000, ("x y z " * 50 + "q ") * 5]
    texts += [rng.choice([" ", "\n", "  "]).join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 200))) for _ in range(150)]
    rows = [(k, t, 1) for k, t in enumerate(texts)] + [(None, "c " * 20, 1), (4, "a a a a a a", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, period int").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(brute_op13(k, t)) for k, t, _ in rows)
    assert sum(zlib.crc32(str(k).encode()) % 10 == 0 for k, t, _ in rows if k is not None and t) > 5


def test_runs_of_an_empty_table(spark):
    assert periodic_runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []

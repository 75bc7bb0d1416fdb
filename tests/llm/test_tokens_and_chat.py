import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maskwright.llm import byte_bpe, chat_format, packing, queries, word_tokens

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = list("aAbBzZ 019'sStT %%$$--éÉßŞİı²¼ªº\t\n\r’–…€中😀") + ["'ll", "   ", "<|endoftext|>"]


def random_texts(n, seed, pieces=ODD, most=20):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_word_ids_equal_the_library():
    from tokenizers import Tokenizer

    e, library = word_tokens.encoder(WORDS), Tokenizer.from_file(WORDS)
    pieces = [*ODD, "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>"]
    for text in [*random_texts(3000, 1, pieces), "a <|endoftext|> b", "<|startoftext|>hello", "x<|endoftext|>y" * 50]:
        assert e.ids(text) == np.asarray(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text
    assert np.frombuffer(e.ids("a <|endoftext|> b"), "<u4").tolist() == [320, 49407, 321]


def test_the_word_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(word_tokens, "CACHE_BYTES", 2000)
    e = word_tokens.WordEncoder(WORDS)
    for text in random_texts(200, 4, list("abcdefg "), 60):
        assert e.ids(text) == np.asarray(e.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert len(e.parts) <= 12


def test_op3_on_a_table(spark, tmp_path):
    """The registered query: every id of the library in one piece, crc32 of the pieces, sequences without padding."""
    import zlib

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    texts = [None, "", "a <|endoftext|> b", "word " * 5000, *random_texts(300, 9, most=200)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    pieces = queries.op3_packing(spark, str(tmp_path)).collect()
    for doc, text in enumerate(texts):
        ids = np.asarray([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted((p for p in pieces if p["doc_id"] == doc), key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or (at < 2048 and at & (at - 1) == 0)


@pytest.mark.parametrize("lengths", [[], [1], [2048], [4096, 1], [5000, 700, 700, 700, 3], [1] * 50, [2047] * 9])
def test_packing_covers_every_token_once(lengths):
    pieces = packing.pack(lengths)
    for d, n in enumerate(lengths):
        at = 0
        for start, m in sorted((p[1], p[2]) for p in pieces if p[0] == d):
            assert start == at
            at += m
        assert at == n
    for s in {p[3] for p in pieces}:
        at = 0
        for offset, m in sorted((p[4], p[2]) for p in pieces if p[3] == s):
            assert offset == at
            at += m
        assert at <= 2048 and at & (at - 1) == 0  # full or a power of two: no padding


def test_packing_on_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, None, 9), (1, None, 9), (None, "", 9), (2, "word " * 5000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id long")
    got = packing.pack_documents(docs, WORDS).collect()
    assert sum(r["length"] for r in got if r["doc_id"] == 1) == 2
    assert sum(r["length"] for r in got if r["doc_id"] == 2) == 5001 == max(r["doc_tokens"] for r in got)
    assert packing.pack_documents(docs.limit(0), WORDS).count() == 0


def test_byte_bpe_equals_tiktoken_in_tiny_chunks():
    import base64

    import tiktoken

    c = byte_bpe.codec(BYTES, public_tokenizers.PATTERN)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTES, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    met = 0
    for k, text in enumerate(random_texts(3000, 2, ODD + ["\x1c", "\x85", " ", "aaaaaaaa", "\n\n"], 40)):
        chunk, overlap = [(4, 2), (5, 5), (16, 16), (8, 32)][k % 4]
        ids = c.encode(text, chunk, overlap)
        assert ids == np.asarray(enc.encode_ordinary(text), "<u4").tobytes(), text
        assert c.decode(ids) == text.encode()
        # chunk by chunk, as the tasks do, and then stitched
        parts = []
        for a in range(0, len(text), chunk):
            last = a + chunk >= len(text)
            part = text[a : a + chunk + overlap]
            parts.append(dict(zip(("ids", "places", "counts", "meet"), c.encode_chunk(part, chunk, last, overlap), strict=True), k=a // chunk, body=part if last else part[:chunk]))
        met += sum(p["meet"] is not None for p in parts)
        assert byte_bpe.stitched(parts, c, chunk, overlap) == ids, text
    assert met > 3000


def test_byte_bpe_rows(spark, monkeypatch):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTES, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    # of many chunks; with a stretch in which no two chunks can meet; twice the same row
    texts = [None, "", "héllo " * 40_000, "a b" + " " * 3000 + "c " * 2000, *random_texts(30, 6, most=400)]
    rows = [(k, t, b"x", 7) for k, t in enumerate(texts)] + [(2, texts[2], b"x", 7), (None, "wörld " * 500, b"x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids binary, k long")
    for chunk, overlap in ((byte_bpe.CHUNK, byte_bpe.OVERLAP), (100, 40)):
        encoded = byte_bpe.encode_documents(docs, BYTES, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap)
        got = byte_bpe.decode_documents(encoded, BYTES, public_tokenizers.PATTERN).collect()
        have = sorted((r["doc_id"] is None, r["doc_id"] or 0, bytes(r["ids"]), bytes(r["decoded"]), r["n_tokens"]) for r in got)
        ids = [np.asarray(enc.encode_ordinary(r[1] or ""), "<u4").tobytes() for r in rows]
        assert have == sorted((r[0] is None, r[0] or 0, i, (r[1] or "").encode(), len(i) // 4) for r, i in zip(rows, ids, strict=True))
    assert byte_bpe.encode_documents(docs.limit(0), BYTES, public_tokenizers.PATTERN).count() == 0


def test_the_piece_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_BYTES", 2000)
    c = byte_bpe.Codec(BYTES, public_tokenizers.PATTERN)
    for text in random_texts(200, 4, list("abcdefg "), 60):
        assert c.decode(c.encode(text)) == text.encode() and len(c.pieces) <= 12


def _batches(rows, rng):
    k = 0
    while k < len(rows):
        part = rows[k : k + rng.randint(1, 5)]
        k += len(part)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), kinds, strict=True)], names=["conv", "turn", "role", "text"])


@pytest.mark.parametrize("limit", [1 << 20, 200])
def test_chat_round_trip_over_batches(limit, monkeypatch):
    monkeypatch.setattr(chat_format, "PART_BYTES", limit)
    rng = random.Random(3)
    pieces = ["\\", "###", "</turn>", "a", "é", " ", ":", "\n", "<", "### user: ", "x" * 3000]
    for _ in range(60):
        rows = [(c, t, rng.choice(["user", "assistant", "a:b\\", None]), rng.choice([None, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 8)))])) for c in [None, *range(rng.randint(0, 5))] for t in range(rng.randint(1, 7))]
        made = [r for b in chat_format._format(_batches(rows, rng)) for r in b.to_pylist()]
        have, want = {}, {}
        for conv, _, role, text in rows:
            want.setdefault(conv, []).append((role or "", text or ""))
        for r in made:
            turns = chat_format.parse(r["formatted"])
            have.setdefault(r["conv"], []).extend(turns)
            raw = r["formatted"].encode()
            marked = [chat_format.unescape(raw[a:b].decode()) for a, b in zip(r["loss_starts"], r["loss_ends"], strict=True)]
            assert marked == [t for role, t in turns if role == "assistant"]
        assert have == want


def test_chat_digests(spark, tmp_path):
    rows = [(1, 1, "assistant", "### b</turn>"), (1, 0, "user", None), (2, 0, None, "x"), (2, 0, None, "x")]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in queries.op1_chat_format(spark, str(tmp_path)).collect()}
    assert set(got) == {-7, 1, 2} and got[1]["n_turns"] == 2 and got[2]["n_turns"] == 2
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\n### b</turn>\n").hexdigest()
    assert got[1]["loss_sha256"] == hashlib.sha256(b"### b</turn>").hexdigest() and got[1]["loss_chars"] == 12
    assert got[-7]["loss_chars"] == len("\\### Assistant: </turn> ok")
    # columns of the same names as those of the result, and an empty table
    clash = chats.withColumns({"conv": F.lit(1), "part": F.lit("x"), "n_turns": F.lit(9), "formatted": F.lit("y")})
    assert sorted(map(str, chat_format.format_conversations(clash).collect())) == sorted(map(str, chat_format.format_conversations(chats).collect()))
    assert chat_format.read_back(chat_format.format_conversations(clash.limit(0))).count() == 0

import zlib

import numpy as np
import public_tokenizers

import corpus_pipeline
from maskwright.llm import exact_dedup, language_id, pii, simhash, word_tokens

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_its_stages_by_hand(spark):
    """Models are fitted by the operators; every decision on rows is then made again row by row."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs)
    rows = [r.asDict() for r in docs.collect()]
    rows = [r for r in rows if model.predict(r["text"])[1] >= language_id.MIN_SCORE]
    best = {}
    for r in rows:
        norm = "".join(c for c in r["text"] or "" if c not in " \t\n\x0b\f\r")
        key = (-len(r["text"] or ""), r["doc_id"])
        if norm not in best or key < best[norm][0]:
            best[norm] = (key, r)
    rows = [r for _, r in best.values()]
    prints = [simhash.fingerprint(r["text"]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    smallest = {}
    for i, r in enumerate(rows):
        smallest[find(i)] = min(smallest.get(find(i), r["doc_id"]), r["doc_id"])
    rows = [r for i, r in enumerate(rows) if r["doc_id"] == smallest[find(i)]]
    counts = {}
    for r in rows:
        for k, _, _, *pattern in pii.candidates(r["text"], pii.base_spans(r["text"])):
            counts[k, *pattern] = counts.get((k, *pattern), 0) + 1
    good = frozenset(k for k, v in pii.fit([(*k, n) for k, n in counts.items()]).items() if v >= pii.ACCEPT)
    encode = word_tokens.encoder(public_tokenizers.path("word_bpe_49k.json")).ids
    ids = {r["doc_id"]: encode(pii.redact_text(r["text"], good)) + np.asarray([1], "<u4").tobytes() for r in rows}

    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {p["doc_id"] for p in pieces} == set(ids)
    for p in pieces:
        part = ids[p["doc_id"]][4 * p["start"] : 4 * (p["start"] + p["length"])]
        assert zlib.crc32(part) == p["ids_crc32"] and len(part) == 4 * p["length"] and p["doc_tokens"] == len(ids[p["doc_id"]]) // 4
    assert sum(p["length"] for p in pieces) == sum(len(v) // 4 for v in ids.values())


def test_stages_take_nulls_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (None, "the and of that", None, None, None), (2, "", "en", "s", 0), (3, "the quick brown the and of", "en", "s", 26), (3, "the quick brown the and of", "en", "s", 26)]
    docs = spark.createDataFrame(rows, schema)
    for frame in (docs, docs.limit(0)):
        now = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, SF)
            assert now.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, now, SF).filter("start = 0").count() == (2 if frame is docs else 0)
    assert exact_dedup.ORACLE_SQL and corpus_pipeline.ORACLE_SQL is None

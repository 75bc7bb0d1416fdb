import random
import re

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64

from maskwright.llm import exact_dedup, simhash, substring_dedup


def docs_of(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"doc_id long, text string{extra}")


ROWS = [(3, "a b", 1), (1, "ab", 1), (2, "a  b", 1), (4, None, 1), (5, " ", 1), (6, "c", 1), (6, "c", 1), (None, "c ", 1), (7, "d", 1)]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_and_collisions(spark, weak):
    """A hash of four values makes collisions everywhere; the groups must not change."""
    hash_fn = (lambda norm: F.substring(F.md5(norm), 1, 1)) if weak else exact_dedup.content_hash
    got = exact_dedup.exact_dedup(docs_of(spark, ROWS, ", keep_id long"), hash_fn=hash_fn).collect()
    assert len(got) == len(ROWS)
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got} == {
        (1, 2, 3, False), (2, 2, 3, True), (3, 2, 3, False), (4, 5, 2, False), (5, 5, 2, True), (7, 7, 1, True), (6, None, 3, False), (None, None, 3, True),
    }
    assert sum(r["kept"] for r in got) == len({r["text_sha256"] for r in got}) == 4


def test_exact_dedup_keeps_one_row_of_each_group(spark):
    kept = exact_dedup.keep_first(docs_of(spark, ROWS + [(8, "e", 1), (8, "e", 1)], ", h long"))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "c "), (2, "a  b"), (5, " "), (7, "d"), (8, "e")]
    assert kept.columns == ["doc_id", "text", "h"]
    assert exact_dedup.exact_dedup(docs_of(spark, ROWS, ", x long").limit(0)).count() == 0


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() <= 3:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_fingerprints():
    for text in (None, "", " \n", "A", "a B", "É É x y", "One two three four Two three", "x " * 70_000):
        assert simhash.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("hot", [64, 1])
def test_links_connect_what_brute_force_connects(spark, hot):
    rng = random.Random(hot)
    prints = set()
    for _ in range(8):
        centre = rng.getrandbits(64)
        for _ in range(15):
            x = centre
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            prints.add(x - 2**64 if x >= 2**63 else x)
    prints = sorted(prints)
    edges = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), hot)
    root = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    want = brute_components(prints)
    smallest = {}
    for p, c in zip(prints, want, strict=True):
        smallest[c] = min(smallest.get(c, p), p)
    assert [root.get(p, p) for p in prints] == [smallest[c] for c in want]


def test_simhash_components_and_stage(spark):
    base = "the quick brown fox jumps over the lazy dog " * 30
    rows = [(5, base), (2, base + "dog"), (9, base), (9, base), (None, base), (1, None), (3, ""), (4, "quite another text about other things entirely")]
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.simhash_components(docs_of(spark, rows)).collect()}
    by_id = {k[0]: v for k, v in got.items()}
    assert by_id[5] == by_id[9] == by_id[None] == 2 and by_id[1] == by_id[3] == 1 and by_id[4] == 4
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs_of(spark, rows)).collect()) == [1, 2, 4]
    assert simhash.simhash_components(docs_of(spark, rows).limit(0)).count() == 0
    clash = docs_of(spark, rows).withColumns({c: F.lit("x") for c in ("id", "fp", "root", "first", "node", "component_id")})
    assert {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.simhash_components(clash).collect()} == got
    assert sorted(r["doc_id"] for r in simhash.keep_one(clash).collect()) == [1, 2, 4] and simhash.keep_one(clash).columns == clash.columns


def test_one_row_of_each_component_stays_with_null_and_repeated_ids(spark):
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(80)) for _ in range(7)]
    roots = brute_components([simhash.fingerprint(t) for t in texts])
    assert len(set(roots)) == len(texts)
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (None, texts[2]), (5, texts[3]), (5, texts[4]), (5, texts[4]), (8, texts[4]), (8, texts[5]), (None, texts[5]), (9, texts[6])]
    frame = docs_of(spark, rows)
    want = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (5, texts[3]), (5, texts[4]), (8, texts[5]), (9, texts[6])]
    assert sorted(map(tuple, simhash.keep_one(frame).collect()), key=str) == sorted(want, key=str)
    assert len({r["root"] for r in simhash.simhash_components(frame).collect()}) == len(texts)


def test_chunks_move_with_insertions():
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("abcdefghijé") for _ in range(rng.randint(2, 8))) for _ in range(3000))

    def pieces(text):
        words = text.encode().split()
        _, place, digest = substring_dedup.chunks([words])
        assert [*(place >> 8), len(words)] == [0, *((place >> 8) + (place & 255))] and max(place & 255) <= substring_dedup.CUT_WORDS
        return digest.tolist()

    plain, moved = pieces(text), pieces("something new " + text)
    assert len(set(plain) & set(moved)) > 0.98 * len(set(plain))
    assert pieces("a " * 5000) and pieces("x" * 100_000) and len(substring_dedup.chunks([[], []])[0]) == 0


@pytest.mark.parametrize("step", [substring_dedup._STEP, 64])
def test_cuts_are_the_smallest_of_a_window(step, monkeypatch):
    monkeypatch.setattr(substring_dedup, "_STEP", step)
    rng = random.Random(8)
    texts = [["".join(rng.choice("ab") for _ in range(rng.randint(1, 3))).encode() for _ in range(n)] for n in (1, 15, 16, 40, 0, 200)]
    numbers, places, digests = substring_dedup.chunks(texts)
    seen = {}
    for k, words in enumerate(texts):
        line, n, w = b"".join(x + b" " for x in words), len(words), substring_dedup.CUT_WORDS
        at = [sum(len(x) + 1 for x in words[:i]) for i in range(n + 1)]
        h = [1 << 32, *[sum(int(substring_dedup.GEAR[c]) << j for j, c in enumerate(reversed((b"\0" * 16 + b" " + line)[: i + 17][-substring_dedup.WINDOW :]))) % 2**32 for i in at[1:-1]]]
        bounds = sorted({0, n} | {max(range(a, a + w), key=lambda i: (-h[i], i)) for a in range(n - w + 1)})
        want = [(a << 8) | (b - a) for a, b in zip(bounds, bounds[1:], strict=False)]
        assert places[numbers == k].tolist() == want
        for p, d in zip(want, digests[numbers == k].tolist(), strict=True):
            assert seen.setdefault(line[at[p >> 8] : at[(p >> 8) + (p & 255)]], d) == d
    assert len(set(seen.values())) == len(seen)  # equal digests are equal chunks


VOCABULARIES = {"long": None, "letters": list("abcdefghijklmnopqrstuvwxyz"), "few": ["the", "of", "and", "it"]}


@pytest.mark.parametrize("kind", VOCABULARIES)
def test_repeated_passages_equal_brute_force(spark, kind):
    """All windows of 50 words of all documents, held against each other."""
    rng = random.Random(7)
    vocabulary = VOCABULARIES[kind] or ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(2, 9))) for _ in range(5000)]

    def prose(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    rows = [[i, prose(rng.randint(0, 120))] for i in range(150)]
    for k in range(40):
        passage = prose(rng.choice([30, 48, 49, 50, 50, 51, 55, 70, 100, 300]))
        for j in rng.sample(range(150), rng.choice([2, 2, 3, 40])):
            at = rng.randint(0, len(rows[j][1]))
            rows[j][1][at:at] = passage
    rows = [(i, "".join(w + rng.choice([" ", " ", "\n", " \t"]) for w in words)) for i, words in rows]
    lone = " ".join(prose(90))
    twice = " ".join(prose(60))
    rows += [(200, None), (201, ""), (202, twice + " and then " + twice), (202, twice + " and then " + twice), (None, lone), (None, "Other " + lone), (203, lone[5:]), (300, rows[3][1]), (300, rows[4][1])]
    frame = docs_of(spark, [(*r, k, "x") for k, r in enumerate(rows)], ", key long, owner string")
    found = substring_dedup.repeated_passages(frame).collect()

    windows = {}
    for doc in set(rows):
        words = (doc[1] or "").split()
        for k in range(len(words) - 49):
            windows.setdefault(" ".join(words[k : k + 50]), []).append((doc, k))
    want = {}
    for places in windows.values():
        owners = {doc for doc, _ in places}
        if len(owners) > 1:
            keep = min(doc[0] if doc[0] is not None else 2**63 for doc in owners)
            for doc, k in places:
                want.setdefault(doc[0], set()).update(range(k, k + 50))
    have = {}
    for r in found:
        assert r["n_words"] >= 50 and r["kept"] <= (r["keep_id"] == r["doc_id"])
        mine = [t for i, t in set(rows) if i == r["doc_id"]]
        parts = [len(t[: r["start"]].split()) for t in mine if len((t or "")[r["start"] : r["end"]].split()) == r["n_words"]]
        assert parts
        have.setdefault(r["doc_id"], set()).update(range(parts[0], parts[0] + r["n_words"])) if len(mine) == 1 else have.setdefault(r["doc_id"], set())
    assert set(have) == set(want) and keep is not None
    single = [i for i in want if i not in (None, 300)]
    assert all(have[i] <= want[i] for i in single)
    # an end of a long passage can lie a few words further out, a short one is found to the word
    edge = range(-substring_dedup.EDGE, substring_dedup.EDGE + 1)
    assert all(any(w + k in have[i] for k in edge) for i in single for w in want[i] - have[i])
    assert sum(map(len, (have[i] for i in single))) > 0.9 * sum(map(len, (want[i] for i in single)))
    assert 202 not in have and None in have and 300 in have
    assert substring_dedup.repeated_passages(frame.limit(0)).count() == 0

    cleaned = substring_dedup.without_passages(frame)
    assert cleaned.columns == frame.columns and cleaned.count() == len(rows)
    after = {}
    for r in cleaned.collect():
        words = (r["text"] or "").split()
        for k in range(len(words) - 49):
            after.setdefault(" ".join(words[k : k + 50]), set()).add(rows[r["key"]])
    # no window stays in two documents (a cut may put two ends together anew), and every word of a passage stays somewhere
    assert all(len(docs & {d for d, _ in windows.get(k, ())}) < 2 for k, docs in after.items())
    if kind == "long":
        assert {w for _, t in rows for w in (t or "").split()} == {w for r in cleaned.collect() for w in (r["text"] or "").split()}


def test_passages_are_cut_by_row_not_by_id(spark):
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    shared, alone = prose(80), prose(120)
    frame = docs_of(spark, [(1, "One " + shared), (5, "Two " + shared + " end"), (5, alone), (5, alone), (None, shared)])
    got = sorted((r["doc_id"] or 0, r["text"]) for r in substring_dedup.without_passages(frame).collect())
    assert len(got) == 5 and got[1] == (1, "One " + shared) and got.count((5, alone)) == 2
    assert len(got[0][1].split()) <= substring_dedup.EDGE
    cut_out = next(t for i, t in got if i == 5 and t != alone)
    assert cut_out.startswith("Two ") and cut_out.endswith(" end") and len(cut_out.split()) <= 2 + substring_dedup.EDGE + substring_dedup.CUT_WORDS


def test_candidates_beyond_the_broadcast_are_met_through_bitmaps(spark, monkeypatch):
    rng = random.Random(11)
    texts = spark.createDataFrame([(rng.getrandbits(64) - 2**63, k) for k in range(3000)] + [(-1, -1), (-(2**63), -2), (2**63 - 1, -3)], "key long, n long")
    places = texts.filter("n % 7 = 0 or n < 0").select("key", F.array(F.lit(1), F.lit(2)).alias("spots"))
    want = sorted(map(str, substring_dedup._joined(texts, places, "spots").collect()))
    assert len(want) > 400
    for rows, maps in ((10, substring_dedup.BITMAPS), (10, 1)):
        monkeypatch.setattr(substring_dedup, "BROADCAST_ROWS", rows)
        monkeypatch.setattr(substring_dedup, "BITMAPS", maps)
        assert sorted(map(str, substring_dedup._joined(texts, places, "spots").collect())) == want
    found = {str(r) for r in substring_dedup.repeated_passages(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()}
    monkeypatch.undo()
    assert found == {str(r) for r in substring_dedup.repeated_passages(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()}

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.llm import html_extract, language_id, pii, topk

SF = "/root/testdata/sf0.01"


def test_language_is_told_on_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs)
    assert sorted(sum(model.families, [])) == ["de", "en", "es", "fr"] and len(model.families) == 2
    got = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n, low, high = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score"), F.max("score")).first()
    assert n > 200 and right > 0.97 and 0 <= low <= high <= 1


def brute_features(text):
    """Counts of hashed byte n-grams, one n-gram at a time."""
    data, counts = text.lower().encode(), {}
    for start in range(len(data)):
        code = 0
        for n in range(1, max(language_id.GRAMS) + 1):
            if start + n > len(data):
                break
            fresh = data[start + n - 1] * int(language_id._MULTIPLIERS[n - 1])
            code = fresh % 2**32 if n == 1 else ((code ^ code >> 15) * 0x2C1B3C6D + fresh) % 2**32
            if n in language_id.GRAMS:
                k = code * 0x9E3779B1 % 2**32 >> 32 - language_id.BITS
                counts[k] = counts.get(k, 0) + 1
    norm = math.sqrt(sum(counts.values()))
    return {k: math.sqrt(v) / norm for k, v in counts.items()}


def test_predictions_equal_brute_force(spark):
    """Features gram by gram, every margin as a plain sum, then the family and the pairwise votes inside it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs)
    for row in docs.limit(60).collect():
        text = row["text"]
        told, score = model.predict(text)
        if not text or not any(c.isalpha() for c in text):
            assert (told, score) == ("und", 0.0)
            continue
        x = brute_features(text)
        assert max(abs(float(v) - x.get(k, 0.0)) for k, v in enumerate(language_id.features(text))) < 1e-5
        margins = [sum(v * float(model.weights[k, c]) for k, v in x.items()) + float(model.weights[-1, c]) for c in range(model.weights.shape[1])]
        n = len(model.families)
        family = max(range(n), key=lambda f: margins[f])
        sure = 1 / sum(math.exp(language_id.SLOPE * (m - margins[family])) for m in margins[:n])
        votes = [0.0] * len(model.families[family])
        for column, (f, a, b) in enumerate(model.pairs, n):
            if f == family:
                p = 1 / (1 + math.exp(-language_id.SLOPE * margins[column]))
                votes[a], votes[b] = votes[a] + p, votes[b] + 1 - p
        best = max(range(len(votes)), key=lambda k: votes[k])
        assert told == model.families[family][best]
        assert score == 0 or abs(score - sure * (votes[best] / (len(votes) - 1) if len(votes) > 1 else 1)) < 1e-4


def test_machines_minimise_the_squared_hinge_loss():
    """The dual solution reaches the primal minimum that plain gradient descent finds."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(40, 6)), np.ones((40, 1))], axis=1)
    y = np.where(x[:, 0] + 0.5 * rng.normal(size=40) > 0, 1.0, -1.0)
    cost = language_id.C * np.where(y > 0, 40 / (2 * (y > 0).sum()), 40 / (2 * (y < 0).sum()))

    def loss(w):
        return 0.5 * w @ w + (cost * np.maximum(1 - y * (x @ w), 0) ** 2).sum()

    w = np.zeros(7)
    for _ in range(60_000):
        w -= 2e-4 * (w - 2 * x.T @ (cost * y * np.maximum(1 - y * (x @ w), 0)))
    mine = x.T @ language_id._svm(x @ x.T, y, 2000)
    assert abs(loss(mine) - loss(w)) < 1e-3 * loss(w)


def test_the_language_sample_is_bounded_on_repeated_rows(spark):
    """One row that is repeated very often, and an id under which many texts stand, fill neither the sample nor the driver."""
    taught = next(i for i in range(10, 99) if zlib.crc32(str(i).encode()) % 4 != 2)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    many = spark.range(20_000).select(F.lit(taught).cast("long").alias("doc_id"), F.lit("the same text again").alias("text"), F.lit("en").alias("lang"))
    other = spark.range(3000).select(F.lit(taught).cast("long").alias("doc_id"), F.concat(F.lit("the text of number "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    fitted = []
    keep = language_id.fit
    language_id.fit = lambda texts, languages: fitted.append(Counter(languages)) or keep(texts, languages)
    try:
        language_id.train(docs.unionByName(many).unionByName(other), per_language=20)
        language_id.train(docs.limit(0))
    finally:
        language_id.fit = keep
    assert set(fitted[0].values()) == {20} and not fitted[1]


def test_language_edge_cases(spark):
    schema = "doc_id long, text string, lang string, score double"
    taught = next(i for i in range(10, 99) if zlib.crc32(str(i).encode()) % 4 != 2)
    docs = spark.createDataFrame([(1, None, "en", 0.0), (2, " 12 %", None, 0.0), (None, "the and of", None, 0.0), (4, "a" * 3_000_000, None, 0.0), (taught, "the and of", "en", 0.0)], schema)
    nothing = language_id.train(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(docs, nothing).collect()} == {"und"}
    one = language_id.train(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"], r["held_out"]) for r in language_id.identify(docs, one).collect()}
    assert got[1][:2] == got[2][:2] == ("und", 0.0) and got[None][0] == "en" and got[None][2] is False
    assert [r["lang"] for r in language_id.keep_identified(docs.filter("doc_id = 4 or doc_id is null"), one).orderBy("doc_id").collect()] == ["en", "en"]


def test_foreign_texts_and_gibberish_go_and_known_languages_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs)
    rng = random.Random(4)
    foreign = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem. " * 12,
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью. " * 8,
        "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza. " * 12,
        " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(3, 9))) for _ in range(300)),
    ]
    assert all(model.predict(t)[0] in ("de", "en", "es", "fr") for t in foreign)
    junk = spark.createDataFrame([(-1 - n, t, None, "x", len(t)) for n, t in enumerate(foreign)], docs.schema)
    kept = language_id.keep_identified(docs.unionByName(junk), model)
    assert kept.filter("doc_id < 0").count() == 0
    lettered = docs.filter(F.col("text").rlike("[A-Za-z]")).count()
    assert kept.count() >= 0.99 * lettered


def brute_spans(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_equal_brute_force():
    rng = random.Random(2)
    pieces = list("0123456789") * 2 + list(" .-+@()a_%é") + ["a@b.c", "12.34.56.78", "4155456180797176", "+1 (365) 555-7869", "255", "@x.y"]
    for _ in range(20_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 30)))
        assert pii.base_spans(text) == brute_spans(text), text
    assert pii.base_spans("a" * 200_000 + "1" * 200_000 + ".1" * 100_000) is not None  # linear in runs


def brute_estimate(spans, rounds=200):
    """Expectation-maximisation over single spans ``(kind, votes)``, written out."""
    p = [1 / (1 + math.exp(-(v.count("+") - 2 * v.count("-") - 1))) for _, v in spans]
    signs = "0+-"
    for _ in range(rounds):
        prior, like = {}, {}
        for kind in {k for k, _ in spans}:
            mine = [q for q, (k, _) in zip(p, spans, strict=True) if k == kind]
            prior[kind] = (sum(mine) + 1) / (len(mine) + 2)
        for side in (0, 1):
            q = [x if side else 1 - x for x in p]
            for j in range(len(spans[0][1])):
                every = [sum(x for x, (_, v) in zip(q, spans, strict=True) if v[j] == s) + pii.LEAN[1 - side][n] for n, s in enumerate(signs)]
                every = [e / sum(every) for e in every]
                for kind in prior:
                    mine = [sum(x for x, (k, v) in zip(q, spans, strict=True) if k == kind and v[j] == s) + pii.SHRINK * e for s, e in zip(signs, every, strict=True)]
                    like[side, j, kind] = [m / sum(mine) for m in mine]
        p = []
        for kind, v in spans:
            odds = math.log(prior[kind] / (1 - prior[kind]))
            for j, s in enumerate(v):
                odds += math.log(like[1, j, kind][signs.index(s)] / like[0, j, kind][signs.index(s)])
            p.append(1 / (1 + math.exp(-max(min(odds, 30), -30))))
    return p


def test_expectation_maximisation_equals_brute_force_over_spans():
    rng = random.Random(5)
    for rounds in (1, 3, 25):
        spans = [(rng.randrange(3), "".join(rng.choice("0+-") for _ in range(4))) for _ in range(200)]
        counts = Counter(spans)
        got = dict(zip(counts, pii.estimate([(*k, n) for k, n in counts.items()], rounds), strict=True))
        assert max(abs(got[s] - q) for s, q in zip(spans, brute_estimate(spans, rounds), strict=True)) < 1e-9
    assert len(pii.estimate([])) == 0 and pii.fit([]) == {}


def test_supervision_accepts_secrets_and_rejects_numbers_without_a_checksum(spark):
    """On rows of the test table: what the labelers, not the base rules, decide."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in pii.find_spans(docs).select("doc_id", pii.spans_text(F.col("base")).alias("base"), pii.spans_text(F.col("spans")).alias("spans")).collect()}
    secrets = numbers = 0
    for r in docs.collect():
        text, mine = r["text"] or "", got[r["doc_id"]]
        base = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in brute_spans(text)]
        assert sorted(base) == sorted(x for x in mine["base"].split(",") if x) and set(base) <= set(mine["spans"].split(",")) | {""}
        for m in re.finditer(r'(?i)token = "([0-9a-f]{32,64})"', text):
            secrets += 1
            assert f"secret:{m.start(1)}:{m.end(1)}" in mine["spans"]
        for m in re.finditer(r"(?<![0-9])[0-9]{16}(?![0-9])", text):
            if not pii.luhn(m[0]):
                numbers += 1
                assert f"card:{m.start()}:" not in mine["spans"]
    assert secrets > 5 and numbers > 5


def test_candidates_overlap_nothing_that_is_taken():
    rng = random.Random(12)
    parts = ["555-123-4567", "123-45-6789", "4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00", "1.2.3.4", "+49 30 1234567", "a@b.co", "joe at mail dot com", "Dr. Anna Smith", "k" * 9 + "1" * 600, "x", " ", "-", "1"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 12)))
        base = pii.base_spans(text)
        added = [c[1:3] for c in pii.candidates(text, base)[len(base) :]]
        taken = [(a, b) for _, a, b in base]
        for a, b in added:
            assert not any(a < y and x < b for x, y in taken), text
            taken.append((a, b))


def test_long_texts_dense_in_spans_and_long_secrets():
    import time

    begun = time.perf_counter()
    text = "555-123-4567 and 123-45-6789 or 192.168.1.300 " * 20_000
    assert len(pii.candidates(text, pii.base_spans(text))) >= 40_000 and time.perf_counter() - begun < 20
    secret = "a1" * 5000
    assert [(pii.KINDS[c[0]], c[2] - c[1]) for c in pii.candidates(f"token {secret} end", [])] == [("secret", 10_000)]


def test_op9_counts_by_kind(spark, tmp_path):
    from maskwright.llm import queries

    text = "a@b.co c@d.org x 1.2.3.4 1.2.3.5 +49 30 1234567 and e@f.de"
    spark.createDataFrame([(1, text), (2, None), (3, "4111 1111 1111 1111")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in queries.op9_pii(spark, str(tmp_path)).collect()}
    assert got == {1: (3, 2, 0, 1), 2: (0, 0, 0, 0), 3: (0, 0, 1, 0)}


def test_pii_rows(spark):
    said = "Call (212) 555-0199 or write to a.b@mail.example.com. Dr. Maria Gomez, 10.0.0.1"
    rows = [(1, said, 5), (1, said, 5), (2, None, 0), (3, "", 0), (None, "nothing here", 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumns({"spans": F.lit("s"), "found": F.lit(1), "base": F.lit(True)})
    got = pii.find_spans(docs).select("doc_id", pii.spans_text(F.col("base")).alias("base"), pii.spans_text(F.col("spans")).alias("spans")).collect()
    assert len(got) == 5
    mine = next(r for r in got if r["doc_id"] == 1)
    assert mine["base"] == f"email:{said.index('a.b')}:{said.index('. Dr')},ip:{said.index('10.')}:{len(said)}"
    assert mine["base"] in mine["spans"] and f"phone:{said.index('(212')}" in mine["spans"]
    assert {r["spans"] for r in got if r["doc_id"] != 1} == {""}
    clean = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert "@" not in clean[1]["text"] and "[EMAIL]" in clean[1]["text"] and clean[1]["n_chars"] == len(clean[1]["text"])
    assert clean[2]["text"] is None and clean[None]["text"] == "nothing here" and clean[None]["n_chars"] == 12
    assert clean[1]["spans"] == "s" and pii.redact(docs).columns == docs.columns and pii.redact(docs).count() == 5
    assert pii.find_spans(docs.limit(0)).count() == 0 == pii.redact(docs.limit(0)).count()


def test_pages_have_the_text_of_their_article(spark):
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", r["html"] or "", re.DOTALL)
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", body[1])] if body else []
        assert got[r["page_id"]] == "\n\n".join(p for p in parts if p)


def unlabelled(page):
    """The page without elements, classes and ids that say what they are."""
    page = re.sub(r"<(/?)(?:article|nav|footer|header|main|aside)\b", r"<\1div", page)
    return re.sub(r' (?:class|id|role)="[^"]*"', "", page)


def test_the_wrapper_finds_the_article_without_any_label(spark):
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    bare = spark.createDataFrame([(r["page_id"], r["url"], unlabelled(r["html"] or "")) for r in pages], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(bare).collect()}
    right = found = wanted = 0
    for r in pages:
        body = re.search(r"<article>(.*?)(</article>|\Z)", r["html"] or "", re.DOTALL)
        want = Counter(p for b in re.split("</?(?:p|h1)>", body[1]) if (p := " ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split())))
        have = Counter(got[r["page_id"]].split("\n\n")) if got[r["page_id"]] else Counter()
        right, found, wanted = right + (have & want).total(), found + have.total(), wanted + want.total()
    assert right >= 0.99 * found and right >= 0.99 * wanted


def random_tree(rng, depth, root=None):
    node = root or html_extract.Node(rng.choice("ab"), None)
    for _ in range(rng.randint(0, 4) if depth else 0):
        child = random_tree(rng, depth - 1)
        child.parent = node
        node.children.append(child)
    return node


def brute_matching(a, b):
    """Size of the largest simple tree matching, by the textbook recurrence over all pairs of siblings."""
    if a.tag != b.tag:
        return 0
    n, m = len(a.children), len(b.children)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + brute_matching(a.children[i - 1], b.children[j - 1]))
    return 1 + best[n][m]


@pytest.mark.parametrize("cells", [1 << 20, 4])
def test_tree_matching_equals_brute_force(cells, monkeypatch):
    monkeypatch.setattr(html_extract, "TABLE_CELLS", cells)
    rng = random.Random(cells)
    matcher = html_extract.Matcher()
    for _ in range(400):
        a, b = (html_extract.shaped(random_tree(rng, 4, html_extract.Node("r", None))) for _ in range(2))
        pairs = matcher.align(a, b)
        assert len(pairs) == matcher.weigh(a, b) == brute_matching(a, b)
        places = sorted((x.index, y.index) for x, y in pairs)
        assert len({x for x, _ in places}) == len({y for _, y in places}) == len(pairs)
        assert all(p[1] < q[1] for p, q in zip(places, places[1:], strict=False))  # order is kept
        mate = {id(x): y for x, y in pairs}
        assert all(x is a or mate[id(x.parent)] is y.parent for x, y in pairs)  # and ancestry


def test_very_long_lists_of_siblings_take_little_memory():
    import tracemalloc

    rng = random.Random(6)
    kinds = ["<p>x</p>", "<div><p>a</p></div>", "<ul><li>q</ul>", "<h2>t</h2>"]
    a, b = (html_extract.parse("<body>" + "".join(rng.choice(kinds) for _ in range(20_000))) for _ in range(2))
    tracemalloc.start()
    assert len(html_extract.Matcher().align(a, b)) > 20_000
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    deep = html_extract.parse("<div>" * 20_000 + "text")
    assert html_extract.main_text(deep, html_extract.as_wrapper(html_extract.parse("<div>" * 15_000 + "text")), (0, frozenset(), frozenset())) == "text"


def test_wrappers_remove_what_a_host_repeats(spark):
    def page(n):
        return f"<body><div><p>Read our paper every day</p></div><div><h1>Head {n}</h1><p>{'story ' * (20 + n)}</p><p>Printed with care</p></div><ul><li><a href=x>Home</a></ul><p>All rights reserved</p></body>"

    other = "<body><div><p>Read our paper every day</p></div><div><p>short</p></div><ul></ul></body>"
    rows = [(n, f"https://a.example/{n}", page(n)) for n in range(8)] + [(30, "https://a.example/empty", ""), (31, "https://a.example/other", other)]
    # a notice that the merged wrapper knows from some of its pages only
    rows += [(100 + n, f"https://c.example/{n}", page(n).replace("with care", "in spring" if n % 8 else "with care")) for n in range(40)]
    rows += [(200 + n, f"https://small{n}.example/", page(50 + n)) for n in range(6)]  # pooled: each host has one page
    rows += [(20, None, page(1)), (21, "x", None), (22, "https://b.example/", "<p>a<br>b &amp; c"), (22, "https://b.example/", "<p>a<br>b &amp; c")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, group long")
    got = [(r["page_id"], r["text"]) for r in html_extract.extract(pages).collect()]
    assert len(got) == len(rows)
    text = dict(got)
    assert text[3] == "Head 3\n\n" + " ".join(["story"] * 23)
    assert text[31] == "short" and text[30] == text[21] == "" and text[22] == "a b & c"
    assert text[203] == "Head 53\n\n" + " ".join(["story"] * 73)
    assert "Read our paper" not in text[20] and "story" in text[20]
    assert sum("Printed" in text[100 + n] for n in range(40)) <= 5  # the rarer notice varies, the common one goes
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_menus_notices_forms_and_comments_are_no_content():
    page = """<html><head><title>x</title></head><body><header><h1>Site</h1></header><div id="cookie-banner">We use cookies</div><main><article>
    <header><h1>T &amp; t</h1></header><p>One<br>two <b>three</b></p><ul><li>a<li>b</ul><div class="ad-slot">Buy</div><form><p>Mail <input></p></form>
    <section class="comments"><p>nice</p></section><article class="comment"><p>I agree</p></article><p>last</article></main><aside>side</aside><footer>f</footer></body>"""
    assert html_extract.main_text(page) == "T & t\n\nOne two three\n\na\n\nb\n\nlast"
    assert html_extract.main_text("<p>a<p") == "a" and html_extract.main_text("") == ""
    assert html_extract.main_text("<div class=ad>Buy this</div><article></article><footer>f</footer>") == ""
    sidebar = f"<div class='has-sidebar'><article><p>{'long ' * 200}</p></article><aside>x</aside></div><footer>f</footer>"
    assert html_extract.main_text(sidebar) == ("long " * 200).strip()


@pytest.mark.parametrize("label", ["share prices", "related-work", "tags", "notice"])
def test_labels_only_weigh_where_the_wrapper_knows_better(spark, label):
    def page(n):
        return f"""<body><ul><li><a href=x>Home</a></ul><article><h1>Head {n}</h1><p>{"story " * (9 + n)}end</p><section class="{label}"><p>{"figures " * (8 + n)}{n}</p></section>
        <div><p>Buy our paper now</p></div><section class="tags">All about trade</section><section class="related"><p><a href={n}>more of {n}</a></p></section><div class="ad">Advert {n}</div><div class="comments"><p>I agree {n}</p></div></article></body>"""

    def want(n):
        return f"Head {n}\n\n{'story ' * (9 + n)}end\n\n{'figures ' * (8 + n)}{n}"

    rows = [(n, f"https://a.example/{n}", page(n)) for n in range(8)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {n: want(n) for n in range(8)}
    # an article around that is mostly template and links is not taken whole
    rows = [(n, f"https://b.example/{n}", f"<body><article><ul>{'<li><a href=x>One of our many pages</a></li>' * 40}</ul><div><h1>Head {n}</h1><p>{'story ' * (9 + n)}end</p></div><p><a href=y>about item {n}</a></p></article></body>") for n in range(8)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {n: f"Head {n}\n\n{'story ' * (9 + n)}end" for n in range(8)}


def test_pools_of_two_and_three_pages_have_wrappers_and_no_length_decides(spark):
    def page(n):
        return f"<body><div><p>Read our paper every day</p></div><div><h1>Head {n}</h1><p>{'story ' * (20 + n)}end</p><p>Printed with care</p></div></body>"

    for pages in (2, 3, 4, 5):
        rows = [(n, f"https://a{n % 2}.example/{n}", page(n)) for n in range(pages)]
        got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert got == {n: f"Head {n}\n\n{'story ' * (20 + n)}end" for n in range(pages)}, pages
    for n in (1, 499, 500, 504, 5000):
        assert len(html_extract.main_text(f"<body><div class='sidebar'><p>{'x' * n}</p></div></body>")) == n
        assert html_extract.main_text(f"<body><article></article><aside><p>{'x' * n}</p></aside></body>") == ""


def test_no_number_of_pages_of_a_host_switches_how_its_pages_are_judged(spark):
    def page(n, host):
        return f"<body><div><p>Read {host} every day</p></div><div><h1>Head {n}</h1><p>{'story ' * (20 + n)}end {n}</p><p>Printed for {host} with care</p></div></body>"

    def texts(rows):
        return {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}

    def want(n):
        return f"Head {n}\n\n{'story ' * (20 + n)}end {n}"

    # what each host repeats goes on hosts of two pages and of many alike
    rows = [(100 * pages + n, f"https://a{pages}.example/{n}", page(100 * pages + n, f"a{pages}")) for pages in range(2, 8) for n in range(pages)]
    assert texts(rows) == {k: want(k) for k, _, _ in rows}
    for pages in (1, 2, 3, 4, 5, 9):
        # a host of one page is judged the same beside a host of few pages and of many
        rows = [(0, "https://one.example/", page(0, "us"))] + [(n, f"https://many.example/{n}", page(n, "us")) for n in range(1, 1 + pages)]
        assert texts(rows) == {k: want(k) for k, _, _ in rows}, pages
        # so it is if its page stands there several times, and with as many pages or copies on each of the other hosts
        rows = [(1000 + k, "https://one.example/", page(0, "us")) for k in range(pages)] + [(100 * h + n, f"https://b{h}.example/{n}", page(100 * h + n, "us")) for h in (1, 2, 3) for n in range(pages)]
        assert texts(rows) == {k: want(0 if k >= 1000 else k) for k, _, _ in rows}, pages


def test_each_host_has_one_voice_in_its_layout(spark):
    def page(n, last):
        return f"<body><div><p>Read us every day</p></div><div><h1>Head {n}</h1><p>{'story ' * (20 + n)}end {n}</p><p>{last}</p></div></body>"

    # most pages are of one host, whose last paragraph is another; on most hosts it is the same
    rows = [(n, f"https://hot.example/{n}", page(n, f"Only here {n}")) for n in range(60)] + [(100 + n, f"https://small{n}.example/", page(100 + n, "Printed with care")) for n in range(9)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Head {k}\n\n{'story ' * (20 + k)}end {k}" + (f"\n\nOnly here {k}" if k < 100 else "") for k, _, _ in rows}


def test_long_lists_of_many_kinds_take_bounded_time_and_memory():
    import time
    import tracemalloc

    def kinds(seed):  # 5,000 structures, of 13 nodes at most
        rng = random.Random(seed)
        bits = list(range(5000))
        rng.shuffle(bits)
        return "".join("<div>" + "".join("<ul></ul>" if b >> k & 1 else "<h2></h2>" for k in range(13)) + "</div>" for b in bits)

    a, b = (html_extract.parse(f"<body>{kinds(n)}<p>{n}</p></body>") for n in range(2))
    start = time.time()
    tracemalloc.start()
    assert len(html_extract.Matcher().align(a, b)) > 5000
    assert tracemalloc.get_traced_memory()[1] < 400 << 20
    tracemalloc.stop()
    assert time.time() - start < 60


def brute_top_k(rows, queries, k=10):
    from fractions import Fraction

    def whole(v):
        return [math.floor(1024 * Fraction(x)) for x in v]

    good = [(i, whole(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in [r for r in good if queries(r[0])]:
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(v) == len(w))[:k]
        out += [(q, r, i, max(min(-s, 2**63 - 1), -(2**63))) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("seeds", [0, 50, 1000])
def test_top_k_equals_brute_force_with_ties_and_bad_rows(spark, seeds):
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.normal(size=8).round(1).tolist()) for i in range(300)]
    rows += [(1000 + i, [0.5] * 8) for i in range(40)] + [(400, None), (500, [1.0, None] + [0.0] * 6), (600, [float("nan")] * 8), (None, [1.0] * 8), (700, [1.0, 2.0]), (701, [2.0, 2.0])]
    rows += [(200, [0.5] * 8), (800, rows[7][1]), (800, rows[7][1]), (7, rows[7][1]), (900, []), (901, [])]  # repeated ids, queries and rows; no component
    vectors = spark.createDataFrame([(*r, 0, 1) for r in rows], "vec_id long, embedding array<double>, score long, block long")
    asked = vectors.filter("vec_id % 100 = 0")
    got = sorted(map(tuple, topk.top_k(vectors, asked, k=10, block=64, query_block=2, dimensions=3, shards=3, seeds=seeds).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == brute_top_k(rows, lambda i: i % 100 == 0)
    assert topk.top_k(vectors.limit(0), asked.limit(0)).count() == 0 == topk.top_k(vectors, asked.limit(0)).count()


@pytest.mark.parametrize("size", [1e6, 1e9, 1e17, 1e160, 1.7e308])
def test_top_k_of_large_components_is_exact(spark, size):
    """Scores beyond 53 and 64 bits, and scaled components beyond float64, beside small ones."""
    rng = np.random.default_rng(2)
    rows = [(int(i), (size * rng.choice([-1.0, 1.0, 0.5, 0.25 + 2**-40], size=8)).tolist()) for i in range(120)]
    rows += [(200 + i, rng.normal(size=8).tolist()) for i in range(60)] + [(300, rows[3][1]), (301, rows[3][1]), (500, [size] * 8)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), block=32, query_block=3, dimensions=3, shards=3, seeds=40).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == brute_top_k(rows, lambda i: i % 50 == 0)

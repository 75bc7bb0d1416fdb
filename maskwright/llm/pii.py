"""Personal data and secrets by weak supervision.

Labelers of several sorts (patterns, checksums and ranges, word lists, context, surroundings) vote
on a wide set of candidate spans, those of fixed rules (base spans) among them, and may abstain. The votes
of all documents are counted by voting pattern, a table whose size does
not depend on the input; expectation-maximisation on it estimates how reliable each
labeler is for each kind and how likely each pattern is to be personal data. A logistic span
classifier is trained on these likelihoods with features of the span and its surroundings
beside the votes, and accepts or rejects each candidate. Base spans stay whatever it says.
"""

from __future__ import annotations

import bisect
import math
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, lean, written

#: In the order in which spans are listed; the first four have base rules.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "name", "secret")
#: The classifier accepts a candidate from this probability on.
ACCEPT = 0.5
#: Code points of context on either side.
CONTEXT = 40

_LOCAL = string.ascii_letters + string.digits + "._%+-"
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits begins, so starts inside a run are not tried
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_SPELT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(] ?dot ?[\])] ?[A-Za-z0-9-]{1,63})+")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NAME = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.? (?:[A-ZÄÖÜÉÈÑ][\w'’-]{1,30})(?: [A-ZÄÖÜÉÈÑ][\w'’-]{1,30})?")

#: A long unbroken run of letters and digits.
_SECRET = re.compile(r"(?<![A-Za-z0-9+/=_.@-])[A-Za-z0-9+/_-]{16,}+={0,2}(?![A-Za-z0-9+/=_@-])")
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
#: Words before a span that speak for each kind.
CUES = {
    "email": ("mail", "contact", "write", "reach"),
    "ip": ("ip", "address", "host", "server", "addr"),
    "card": ("card", "visa", "credit", "payment", "mastercard", "karte", "tarjeta", "carte"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "sms", "whatsapp", "telefon", "llame"),
    "iban": ("iban", "account", "bank", "transfer", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "insurance"),
    "name": ("name", "contact", "signed", "author", "dear", "sincerely", "by"),
    "secret": ("token", "key", "apikey", "secret", "password", "passwd", "pwd", "bearer", "credential", "auth"),
}
#: Words before a span that speak against every kind.
COUNTER_CUES = ("version", "isbn", "release", "section", "chapter", "page", "figure", "table", "order", "sku", "part", "commit", "checksum", "md5", "sha", "digest", "hash")
#: Endings of domains, first digits of card numbers by issuer, calling codes, country prefixes of accounts, first names, first characters of keys.
GAZETTEER = {
    "email": ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "ch", "at", "it", "nl"),
    "card": ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65"),
    "phone": ("1", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "351", "353", "358"),
    "iban": ("AT", "BE", "CH", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE"),
    "name": ("Anna", "Carlos", "David", "Emma", "Hans", "James", "John", "Jose", "Julia", "Laura", "Luis", "Marie", "Mary", "Maria", "Michael", "Paul", "Peter", "Pierre", "Sarah", "Thomas"),
    "secret": ("sk-", "pk-", "ghp_", "gho_", "AKIA", "xoxb-", "xoxp-", "AIza", "eyJ"),
}
#: The labelers, in the order of a voting pattern.
LABELERS = ("pattern", "check", "gazetteer", "context", "counter", "neighbours", "variety")
_WORDS = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = 2 * d if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _iban_ok(code: str) -> bool:
    code = code.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str) -> list[tuple[int, int]]:
    found, done = [], 0
    for m in _AT.finditer(text):
        at, low = m.start(), m.start()
        width = 64
        while low == at or low > done:
            low = max(done, at - width)
            run = len(text[low:at]) - len(text[low:at].rstrip(_LOCAL))
            if run < at - low or low == done:
                break
            width *= 4
        if run:
            found.append((at - run, m.end()))
            done = m.end()
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of the fixed rules, in the order of KINDS and then of place."""
    found = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found.append((3, m.start(), m.end()))
    return found


def _entropy(text: str) -> float:
    """Bits a character."""
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in map(text.count, set(text)))


def _pattern(kind: str, span: str, digits: str) -> str:
    """Whether the form is a strict one of its kind."""
    if kind == "email":
        return "-" if ".." in span or span[0] in ".-" else "+"
    if kind == "ip":
        return "+" if all(len(p) == 1 or p[0] != "0" for p in span.split(".")) else "-"
    if kind == "card":
        groups = re.split("[ -]", span)
        return "+" if len(groups) == 1 or {len(g) for g in groups[:-1]} == {4} else "-"
    if kind == "phone":
        return "+" if span[0] == "+" or "(" in span else "0"
    if kind == "secret":
        return "+" if (_HEX.fullmatch(span) and len(span) in (32, 40, 48, 64)) or (span.lower() != span != span.upper()) else "0"
    return "+" if kind in ("iban", "ssn") else "0"


def _check(kind: str, span: str, digits: str) -> str:
    """What a checksum, a range or a count of digits says."""
    if kind == "ip":
        return "+" if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in span.split(".")) else "-"
    if kind == "card":
        return "+" if 13 <= len(digits) <= 19 and luhn(digits) else "-"
    if kind == "phone":
        return "+" if 8 <= len(digits) <= 15 else "-"
    if kind == "iban":
        return "+" if _iban_ok(span) else "-"
    if kind == "ssn":
        return "-" if span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" or span[7:] == "0000" else "+"
    if kind == "secret":
        return "+" if _entropy(span) >= 3.0 else "-"
    return "0"


def _listed(kind: str, span: str, digits: str) -> str:
    named = GAZETTEER.get(kind, ())
    if kind == "email":
        return "+" if span.lower().replace("]", " ").replace(")", " ").replace(".", " ").split()[-1] in named else "-"
    if kind in ("card", "phone"):
        return "+" if digits.startswith(named) else ("-" if kind == "card" else "0")
    if kind == "iban":
        return "+" if span[:2] in named else "-"
    if kind == "name":
        return "+" if any(w in named for w in span.split()) else "0"
    return "+" if kind == "secret" and span.startswith(named) else "0"


def _side(c: str) -> str:
    """Class of a neighbouring character."""
    return "e" if not c else "b" if c.isspace() else "a" if c.isalnum() else "q" if c in "\"'`<>()[]{}|" else "p" if c in ".,;:!?" else "o"


def _look(text: str, kind: str, start: int, end: int) -> tuple[str, str]:
    """The votes on a span, one sign for each labeler (for, against, silent), and its features: bit length of its length,
    share of digits in quarters, classes of the characters beside it. Nothing depends on whether it is a base span."""
    span = text[start:end]
    digits = "".join(c for c in span if "0" <= c <= "9")
    before = {w.lower() for w in _WORDS.findall(text[max(0, start - CONTEXT) : start])}
    left, right = text[max(0, start - 1) : start], text[end : end + 1]
    varied = len(set(digits)) > 2 if kind in ("card", "phone", "ssn") else len(set(span.lower())) > 4
    votes = "".join(
        (
            _pattern(kind, span, digits),
            _check(kind, span, digits),
            _listed(kind, span, digits),
            "+" if any(cue in before for cue in CUES[kind]) else "0",
            "-" if any(cue in before for cue in COUNTER_CUES) else "0",
            "-" if any(c.isalnum() or c in "=/\\_#" for c in left + right) else "+",
            "0" if varied else "-",
        )
    )
    return votes, f"{min((end - start).bit_length(), 9)}{4 * len(digits) // (end - start)}{_side(left)}{_side(right)}"


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, str, bool]]:
    """``(kind, start, end, votes, features, is_base)``; added candidates overlap no base span and no earlier one."""
    found = [(k, a, b, *_look(text, KINDS[k], a, b), True) for k, a, b in base]
    # what is taken, as stretches that do not touch each other's inside, in order
    starts, ends = [], []
    for a, b in sorted((a, b) for _, a, b in base):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)

    def offer(kind: str, pattern: re.Pattern, fits=None) -> None:
        added = []
        for m in pattern.finditer(text):  # matches of one pattern do not overlap
            a, b = m.span()
            at = bisect.bisect_right(ends, a)  # the first stretch that ends behind the span's start
            if (at == len(starts) or starts[at] >= b) and (fits is None or fits(m[0])):
                found.append((KINDS.index(kind), a, b, *_look(text, kind, a, b), False))
                added.append((a, b))
        if added:
            starts[:], ends[:] = map(list, zip(*sorted([*zip(starts, ends, strict=True), *added]), strict=True))

    if " at" in text or "(at" in text or "[at" in text:
        offer("email", _SPELT)
    if _DIGIT.search(text):
        offer("iban", _IBAN)
        offer("secret", _SECRET, lambda s: any(c.isalpha() for c in s) and any(c.isdigit() for c in s))
        offer("ip", _IP)
        offer("ssn", _SSN)
        offer("phone", _LOCAL_PHONE)
        offer("card", _CARD, lambda s: 13 <= sum(c.isdigit() for c in s) <= 19)
    if _TITLE.search(text):
        offer("name", _NAME)
    return found


_DIGIT = re.compile(r"[0-9]")
_TITLE = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\b")
_SIGNS = {"0": 0, "+": 1, "-": 2}
#: Pseudo-counts (silent, for, against) that lean a labeler's votes to personal data being for and other spans against;
#: how many spans of a kind weigh as much as all kinds' votes together.
LEAN, SHRINK = ((1.0, 3.0, 1.0), (1.0, 1.0, 3.0)), 10.0


def estimate(counts: list[tuple[int, str, int]], rounds: int = 200) -> np.ndarray:
    """How likely each voting pattern ``(kind, votes, n)`` is to be personal data, by expectation-maximisation.

    Given what a span is, labelers vote independently. Their reliabilities are estimated for each kind, drawn to those of
    all kinds together; no pattern's likelihood is fixed.
    """
    if not counts:
        return np.zeros(0)
    kind = np.array([c[0] for c in counts])
    n = np.array([c[2] for c in counts], float)
    value = np.array([[_SIGNS[v] for v in c[1]] for c in counts])
    of_kind = (np.arange(len(KINDS))[:, None] == kind).astype(float)
    says = value[:, :, None] == np.arange(3)  # pattern, labeler, sign
    p = 1 / (1 + np.exp(-((value == 1).sum(axis=1) - 2.0 * (value == 2).sum(axis=1) - 1.0)))
    for _ in range(rounds):
        prior = (of_kind @ (n * p) + 1) / (of_kind @ n + 2)
        logit = np.log(prior / (1 - prior))[kind]
        for side, q, lean in ((1, p, LEAN[0]), (-1, 1 - p, LEAN[1])):
            every = np.einsum("i,ijv->jv", n * q, says) + np.array(lean)
            every /= every.sum(axis=1, keepdims=True)
            mine = np.einsum("ki,ijv->kjv", of_kind * (n * q), says) + SHRINK * every
            mine /= mine.sum(axis=2, keepdims=True)
            logit += side * np.log(mine[kind[:, None], np.arange(value.shape[1]), value]).sum(axis=1)
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        done = np.abs(new - p).max() < 1e-10
        p = new
        if done:
            break
    return p


def _row(kind: int, votes: str, features: str) -> list[tuple]:
    return [("kind", kind), *[(j, kind, v) for j, v in enumerate(votes) if v != "0"], ("length", features[0]), ("digits", kind, features[1]), ("left", features[2]), ("right", features[3])]


def fit(counts: list[tuple[int, str, str, bool, int]]) -> dict[str, float]:
    """Patterns ``kind:votes:features`` -> what the span classifier says, from ``(kind, votes, features, is_base, n)``.

    The classifier is a logistic regression on kinds, votes and features, fitted to the likelihoods of :func:`estimate`.
    """
    if not counts:
        return {}
    counts = sorted(counts)
    patterns: dict[tuple[int, str], int] = {}
    for kind, votes, _, _, n in counts:
        patterns[kind, votes] = patterns.get((kind, votes), 0) + n
    likely = dict(zip(patterns, estimate([(*k, n) for k, n in patterns.items()]), strict=True))
    p = np.array([likely[c[0], c[1]] for c in counts])
    weight = np.array([c[4] for c in counts], float)
    names = {name: k for k, name in enumerate(sorted({x for c in counts for x in _row(*c[:3])}, key=str))}
    x = np.zeros((len(counts), len(names) + 1))
    for k, c in enumerate(counts):
        x[k, [names[f] for f in _row(*c[:3])]] = 1
    x[:, -1] = 1
    w, share = np.zeros(x.shape[1]), np.sqrt(weight) / np.sqrt(weight).sum()
    for _ in range(60):  # Newton steps on the weighted, slightly damped log-likelihood
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (q - p)) + 1e-3 * w
        bend = (x * (share * q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(x.shape[1])
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return {f"{c[0]}:{c[1]}:{c[2]}": float(v) for c, v in zip(counts, q, strict=True)}


_FIELDS = ("kind", "start", "end", "votes", "features", "base")
_SPAN = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in zip(_FIELDS, (T.IntegerType(), T.IntegerType(), T.IntegerType(), T.StringType(), T.StringType(), T.BooleanType()), strict=True)]))
_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("votes", pa.string()), ("features", pa.string()), ("base", pa.bool_())]))


def _found(texts: pa.Array) -> pa.Array:
    found = []
    for x in texts:
        text = x.as_py() or ""
        found.append([dict(zip(_FIELDS, c, strict=True)) for c in candidates(text, base_spans(text))])
    return pa.array(found, _ARROW)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), _found(batch.column(1))], names=["id", "found"])


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    lean(docs)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(_scan, T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("found", _SPAN)]))


def accepted_patterns(found: DataFrame) -> list[str]:
    """The patterns that the trained classifier accepts; only pattern counts reach the driver."""
    counts = found.select(F.explode("found").alias("f")).groupBy(*[f"f.{c}" for c in ("kind", "votes", "features", "base")]).agg(F.count(F.lit(1)).alias("n")).collect()
    return sorted(k for k, v in fit([tuple(r) for r in counts]).items() if v >= ACCEPT)


def _pattern_of(f):
    return F.concat_ws(":", f["kind"].cast("string"), f["votes"], f["features"])


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``<id_col>, base, spans``, each an ordered array of ``kind, start, end``.

    ``kind`` is a place in KINDS; places count code points and ends are exclusive; spans are ordered by
    kind, then start. ``base`` are the fixed rules' spans, ``spans`` these and the accepted candidates.

    * Null and empty texts have no spans. Repeated rows and null ids are handled like any other.
    * An empty table gives no rows (and fits nothing). Other columns are not looked at.
    """
    found = cut(scanned(docs, id_col, text_col))
    good = F.array(*[F.lit(p) for p in accepted_patterns(found)]).cast("array<string>")

    def listed(keep):
        slim = F.transform(F.filter("found", keep), lambda f: F.struct(f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end")))
        return F.array_sort(slim)

    return found.select(
        F.col("id").alias(id_col),
        listed(lambda f: f["base"]).alias("base"),
        listed(lambda f: f["base"] | F.array_contains(good, _pattern_of(f))).alias("spans"),
    )


def spans_text(spans):
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def replaced(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span ``(kind, start, end)`` replaced by its kind in capitals, in brackets; of overlapping ones the first and longest."""
    out, done = [], 0
    for a, b, k in sorted((a, -b, k) for k, a, b in spans):
        b = -b
        if a >= done:
            out += [text[done:a], f"[{KINDS[k].upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]]) if out else text


def redact_text(text: str, good: frozenset[str]) -> str:
    """The text without its base spans and the candidates of the patterns ``good``."""
    return replaced(text, [(k, a, b) for k, a, b, votes, features, base in candidates(text, base_spans(text)) if base or f"{k}:{votes}:{features}" in good])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with the spans that :func:`find_spans` gives replaced in the text; null texts stay null.

    ``length_col``, where the table has it, is set to the length of a text that was changed. Texts are scanned once, and
    written with their candidates; those without any are not looked at again.
    """
    lean(docs)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _found(batch.column(batch.schema.get_field_index(text_col)))], names=[*batch.schema.names, "__found"])

    marked = written(docs.mapInArrow(mark, T.StructType([*docs.schema.fields, T.StructField("__found", _SPAN)])), "candidates")
    good = frozenset(accepted_patterns(marked.select(F.col("__found").alias("found"))))

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, found = batch.schema.get_field_index(text_col), batch.column(batch.num_columns - 1).to_pylist()
            batch = batch.select([n for n in batch.schema.names if n != "__found"])
            before = batch.column(k).to_pylist()
            after = [replaced(x, [(f["kind"], f["start"], f["end"]) for f in spans if f["base"] or f"{f['kind']}:{f['votes']}:{f['features']}" in good]) for x, spans in zip(before, found, strict=True)]
            batch = batch.set_column(k, batch.schema.field(k), pa.array(after, batch.schema.field(k).type))
            if (n := batch.schema.get_field_index(length_col or "")) >= 0:
                lengths = [old if x == y else len(y) for old, x, y in zip(batch.column(n).to_pylist(), before, after, strict=True)]
                batch = batch.set_column(n, batch.schema.field(n), pa.array(lengths, batch.schema.field(n).type))
            yield batch

    changed = marked.filter("size(__found) > 0").mapInArrow(change, docs.schema)
    return marked.filter("size(__found) = 0").drop("__found").unionByName(changed)

"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs the votes, a classifier decides.

Candidates are the base matches of each kind and looser look-alikes (addresses with odd domains, dotted numbers,
long digit groups, credentials). Regex, gazetteer and context labelers vote yes, no or abstain. The counts of vote
patterns and span shapes over all documents, of which there is a fixed number whatever the input, go to the driver;
expectation-maximisation there estimates each labeler's reliability for each kind, and a logistic span classifier,
which sees the votes and the span's own shape, length and digits, is trained on the resulting probabilities. The classifier then adds look-alikes to the base spans; base spans always stay.

Null text is an empty text. Every row gives a row, repeated rows and null ids too. Extra columns are ignored. If
no candidate exists anywhere, nothing is added.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import slices

KINDS = ("email", "ip", "card", "phone", "secret")
#: The base patterns as they are specified; quantifiers are possessive and runs without a match are consumed
#: whole, which finds the same matches in linear time.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)?")
IP = re.compile(r"[0-9]++((?:\.[0-9]++){3})?")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Look-alikes.
LOOSE = {
    "email": re.compile(r"[^\s@<>\"']{1,64}(?:@|\s?[\[(](?:at|AT)[\])]\s?)[^\s@<>\"']{1,190}"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[ ./-]{0,2}[0-9]){8,40}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])(?:\([0-9]{2,4}\) ?|00[0-9]{1,3}[ -])[0-9][0-9 -]{5,14}[0-9]"),
    "secret": re.compile(r"(?i:token|password|passwd|secret|api[_-]?key|access[_-]?key)\s?[=:]\s?\"?[A-Za-z0-9+/_-]{8,}\"?|(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|(?=[a-z]*[0-9])(?=[0-9]*[a-z])[a-z0-9]{24,})(?![A-Za-z0-9])"),
}
#: Gazetteers and context words (fixed values).
TLDS = frozenset("com org net edu gov io de fr es it uk eu info co".split())
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "82", "86", "91")
CUES = {
    "email": ("mail", "contact", "correo", "kontakt", "adresse", "write to"),
    "ip": ("ip", "host", "server", "login", "address"),
    "card": ("card", "visa", "karte", "carte", "tarjeta", "credit", "iban"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "anruf", "móvil"),
    "secret": ("token", "password", "secret", "key", "credential"),
}
VOTES, SHAPES = 5, 6
INTERESTING = re.compile(r"[0-9@=:]|[\[(](?i:at)[\])]|AKIA")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def small_octets(text: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in text.split("."))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The specified matches by kind, then start."""
    out = []
    if "@" in text:
        out += [("email", *m.span()) for m in EMAIL.finditer(text) if m[1]]
    if "." in text:
        out += [("ip", *m.span()) for m in IP.finditer(text) if m[1] and small_octets(m[0])]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(d := only_digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(only_digits(m[0])) <= 15]
    return out


def votes(kind: str, text: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    """One vote a labeler: 1 yes, 0 no, 2 abstain. Regex, checksum or range, gazetteer, context, bounds."""
    span, digits = text[start:end], only_digits(text[start:end])
    if kind == "email":
        domain = span.rpartition("@")[2].rstrip(".,;:!?)")
        check, known = int(domain.count(".") >= 1 and ".." not in domain), int(domain.rpartition(".")[2].lower() in TLDS)
    elif kind == "ip":
        check, known = int(small_octets(span)), 0 if span.startswith(("0.", "255.")) else 1
    elif kind == "card":
        check, known = int(13 <= len(digits) <= 19 and luhn(digits)), int(digits[:1] in "3456" and len(digits) in (15, 16))
    elif kind == "phone":
        check, known = int(9 <= len(digits) <= 15), int(digits.lstrip("0").startswith(CALLING)) if span[0] in "+0" else 2
    else:
        value = re.split(r"[=:]", span)[-1].strip(' "')
        mix = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
        check, known = int(mix and len(value) >= 12), 1 if span.startswith("AKIA") or re.search("[=:]", span) else 2
    before = text[max(0, start - 40) : start].lower()
    cue = 1 if any(c in before for c in CUES[kind]) else 2
    left, right = text[start - 1 : start], text[end : end + 1]
    bounds = int(not (left.isalnum() or right.isalnum()))
    return int(base), check, known, cue, bounds


def shape(span: str) -> tuple[int, ...]:
    """What the classifier sees of the span itself: class of the first and of the last character (digit, letter,
    other), whether it holds a space, a dash, a dot, and its letters (none, one case, both)."""
    ends = [0 if c.isdigit() else 1 if c.isalpha() else 2 for c in (span[0], span[-1])]
    case = (span != span.lower()) + (span != span.upper())
    return *ends, int(" " in span), int("-" in span), int("." in span), case


def code(kind: str, text: str, start: int, end: int, base: bool) -> int:
    """Kind, votes, the span's shape and the buckets of its length and share of digits, as one number."""
    out = KINDS.index(kind)
    for v in votes(kind, text, start, end, base):
        out = out * 3 + v
    for v in shape(text[start:end]):
        out = out * 3 + v
    share = len(only_digits(text[start:end])) / (end - start)
    return (out * 4 + min((end - start) // 12, 3)) * 3 + int(share * 2.99)


def decode(number: int) -> tuple[int, list[int], list[int], int, int]:
    """Kind, votes, shape, length, share of digits."""
    number, share = divmod(number, 3)
    number, length = divmod(number, 4)
    v = []
    for _ in range(VOTES + SHAPES):
        number, x = divmod(number, 3)
        v.append(x)
    return number, v[: SHAPES - 1 : -1], v[SHAPES - 1 :: -1], length, share


def candidates(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, str, int, int]]]:
    """Base spans, and (code, kind, start, end) of look-alikes that touch no base span, in order."""
    if not INTERESTING.search(text):
        return [], []
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    loose = []
    for kind, pattern in LOOSE.items():
        if kind == "email" and "@" not in text and "(at)" not in text.lower() and "[at]" not in text.lower():
            continue
        loose += [(m.start(), m.end(), kind) for m in pattern.finditer(text)]
    out, at, reach = [], 0, -1
    for start, end, kind in sorted(loose, key=lambda x: (x[0], -x[1], x[2])):
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if start >= reach and not (at < len(taken) and taken[at][0] < end):
            out.append((code(kind, text, start, end, False), kind, start, end))
            reach = end
    return base, out


#: Codes whose features are a matrix at a time.
BLOCK = 4096


def chances(counts: dict[int, int], rounds: int = 60) -> dict[int, float]:
    """The span classifier's probability of each code, from the counts of all candidates' codes."""
    if not counts:
        return {}
    rows = [(k, *decode(k)) for k in sorted(counts)]
    weight = np.array([counts[k] for k in sorted(counts)], float)
    kind = np.array([r[1] for r in rows])
    vote = np.array([r[2] for r in rows])
    post = np.zeros(len(rows))
    for k in np.unique(kind):
        at = kind == k
        v, w = vote[at], weight[at]
        yes, no = (v == 1).sum(1), (v == 0).sum(1)
        p = (yes + 0.5) / (yes + no + 1.0)
        for _ in range(rounds):
            prior = np.clip((w * p).sum() / w.sum(), 0.02, 0.98)
            odds = np.full(len(v), np.log(prior / (1 - prior)))
            for j in range(v.shape[1]):
                seen = v[:, j] != 2
                for value in (0, 1):
                    hit = v[:, j] == value
                    # A labeler is taken to be right more often than not, by eight imagined spans.
                    is_1 = ((w * p)[hit].sum() + (6 if value else 2)) / ((w * p)[seen].sum() + 8)
                    is_0 = ((w * (1 - p))[hit].sum() + (2 if value else 6)) / ((w * (1 - p))[seen].sum() + 8)
                    odds[hit] += np.log(is_1 / is_0)
            p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        post[at] = p
    width = 18 + 3 * SHAPES
    size = len(KINDS) * width
    places = []
    for _, k, v, form, length, share in rows:
        own = [0, *(1 + 2 * j + value for j, value in enumerate(v) if value != 2), 11 + length, 15 + share]
        own += [18 + 3 * j + value for j, value in enumerate(form)]
        places.append([k * width + q for q in own])

    def features():
        """Blocks of rows as zeros and ones: of very many codes there is never the whole matrix."""
        for a in range(0, len(rows), BLOCK):
            some = places[a : a + BLOCK]
            x = np.zeros((len(some), size))
            x[np.repeat(np.arange(len(some)), [len(q) for q in some]), np.concatenate(some)] = 1
            yield slice(a, a + len(some)), x

    kept = list(features()) if len(rows) <= BLOCK else None
    theta, w = np.zeros(size), weight / weight.sum()
    w = 0.5 * w + 0.5 / len(w)
    for _ in range(400):
        h, pull = 1e-4 * np.eye(size), -1e-4 * theta
        for at, x in kept or features():
            p = 1 / (1 + np.exp(-x @ theta))
            h += (x * (w[at] * np.maximum(p * (1 - p), 1e-3))[:, None]).T @ x
            pull += x.T @ (w[at] * (post[at] - p))
        step = np.linalg.solve(h, pull)
        theta += step
        if np.abs(step).max() < 1e-6:
            break
    p = np.concatenate([1 / (1 + np.exp(-x @ theta)) for _, x in kept or features()])
    return {r[0]: float(q) for r, q in zip(rows, p, strict=True)}


def fit(counts: dict[int, int], rounds: int = 60) -> set[int]:
    """Codes of look-alikes that the span classifier takes, from the counts of all candidates' codes."""
    return {c for c, p in chances(counts, rounds).items() if p >= 0.5}


def learn(docs: DataFrame) -> set[int]:
    """Count the candidates' codes over all documents and fit the span classifier."""

    def run(batches):
        seen: Counter[int] = Counter()
        for batch in slices(batches, "text"):
            for text in batch.column("text").to_pylist():
                if text:
                    base, loose = candidates(text)
                    seen.update(code(k, text, a, b, True) for k, a, b in base)
                    seen.update(c for c, *_ in loose)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["code", "n"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "code long, n long")
    table = counted.groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # at most as many rows as there are codes, about 3 million
    return fit(dict(zip(table["code"].to_pylist(), table["n"].to_pylist(), strict=True)))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, taken: set[int] | None = None) -> DataFrame:
    """doc_id, the base counts, base_sha256 and spans. taken: what learn() gave, by default from docs itself."""
    taken = learn(docs) if taken is None else taken
    rank = {k: i for i, k in enumerate(KINDS)}

    def run(batches):
        for batch in slices(batches, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                base, loose = candidates(text or "")
                n = Counter(k for k, *_ in base)
                every = base + [(k, a, b) for c, k, a, b in loose if c in taken]
                every.sort(key=lambda s: (rank[s[0]], s[1]))
                rows.append((*(n[k] for k in KINDS[:4]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4]), pa.array(columns[5])],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str, taken: set[int]) -> str:
    base, loose = candidates(text)
    spans = sorted([(a, b, k) for k, a, b in base] + [(a, b, k) for c, k, a, b in loose if c in taken])
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if spans else text


def redact(docs: DataFrame, taken: set[int] | None = None) -> DataFrame:
    """docs with every span in text replaced by its kind in angle brackets; null text stays null."""
    taken = learn(docs) if taken is None else taken
    place = docs.columns.index("text")

    def run(batches):
        for batch in slices(batches, "text"):
            texts = [None if t is None else redacted(t, taken) for t in batch.column("text").to_pylist()]
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)

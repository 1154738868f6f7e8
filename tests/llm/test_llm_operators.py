"""The operators against brute force on small tables, with nulls, empty and long texts, ties, repeated rows and extra columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lamella.llm import ann, bwt_dedup, decontaminate, html_wrap, langid, packing, pii, quality, simhash, substring_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, batch string, key int"
WORDS = "der the of and la que für 12 x@y.de an été ñu".split()


def rows_of(texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return [(i, t, "en", "s", len(t or ""), 1, "b", 2) for i, t in zip(ids, texts, strict=True)]


def corpus():
    rng = np.random.default_rng(5)
    base = [" ".join(rng.choice(WORDS, n)) for n in (1, 3, 13, 30, 60, 200)]
    long = " ".join(f"w{k % 997}" for k in range(20000))
    near = base[5].replace("la", "le", 3)
    return [*base, base[4], base[5], near, "x " + base[4] + " y", None, "", " \n\t ", "ÀÉ 日本語 \U0001f600 é", long, long + " end", "a" * 5000, base[3] * 3]


@pytest.fixture(scope="module")
def docs(spark):
    texts = corpus()
    rows = rows_of(texts) + rows_of([texts[4], "odd one out"], [None, None]) + rows_of([texts[5]], [5])
    return spark.createDataFrame(rows, DOCS).repartition(3)


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


def group(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def slow_fingerprint(text, width=4):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + width]) for k in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_all_pairs(spark, docs):
    got = simhash.near_duplicates(docs).collect()
    rows = docs.collect()
    assert len(got) == len(rows)
    prints = {f for f in (slow_fingerprint(r["text"]) for r in rows)}
    linked = [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 4]
    parts = group(prints, linked)
    least = {}
    for r in rows:
        c = parts[slow_fingerprint(r["text"])]
        if r["doc_id"] is not None:
            least[c] = min(least.get(c, r["doc_id"]), r["doc_id"])
    want = sorted((str(r["doc_id"]), slow_fingerprint(r["text"]), str(least.get(parts[slow_fingerprint(r["text"])]))) for r in rows)
    assert sorted((str(r["doc_id"]), r["fp"] & (2**64 - 1), str(r["component_id"])) for r in got) == want
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_simhash_links_in_blocks(spark):
    rng = np.random.default_rng(3)
    fps = {0}
    for _ in range(400):
        x = int(rng.integers(0, 2**63))
        fps.add(x)
        for _ in range(2):
            fps.add(x ^ sum(1 << int(b) for b in rng.choice(63, 4, replace=False)))
    fps = sorted(fps)
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = group(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4])
    for block in (20_000, 2):
        linked = [(r["src"], r["dst"]) for r in simhash.links(frame, 4, block).collect()]
        assert group(fps, linked) == want


def test_simhash_large_bucket_is_a_forest():
    fps = np.array([0, *(1 << (k % 60) | 1 << (k // 60) for k in range(1, 300))], np.uint64)
    a, b = simhash._linked(np.zeros(300, np.int64), fps, 4)
    assert len(a) == len(set(fps.tolist())) - 1 and set(b.tolist()) == {0}


def test_packing(spark, docs):
    special = spark.createDataFrame(rows_of(["two  spaces\n\n and <|endoftext|> end ", "don't 3.14  x"], [900, 901]), DOCS)
    docs = docs.unionByName(special)
    got = packing.pack(docs, 256).collect()
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens, by_sequence, seen, want = {}, collections.defaultdict(list), collections.Counter(), collections.Counter()
    for r in docs.collect():
        ids = [*encoder.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        tokens[r["doc_id"], len(ids)] = ids
        want.update((r["doc_id"], len(ids), k) for k in range(len(ids)))
    for p in got:
        by_sequence[p["sequence_id"]].append(p)
        own = range(p["start"], p["start"] + p["length"])
        seen.update((p["doc_id"], p["doc_tokens"], k) for k in own)
        piece = np.array([tokens[p["doc_id"], p["doc_tokens"]][k] for k in own], "<u4").tobytes()
        assert p["ids_crc32"] == zlib.crc32(piece)
    assert seen == want  # repeated rows and null ids too
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 256 and (at > 256 - 4 or at & (at - 1) == 0)  # free space below a 64th, or a power of two
    assert packing.pack(empty(spark)).count() == 0


@pytest.mark.parametrize("capacity", [256, 2048])
def test_bins_hold_whole_documents(capacity):
    rng = np.random.default_rng(11)
    lengths = np.minimum(rng.lognormal(5.5, 1.2, 6000).astype(int) + 1, 20_000)
    bins, rows = packing.Bins(0, capacity), []
    for k, n in enumerate(lengths.tolist()):
        rows += bins.add(k, np.arange(n, dtype="<u4").tobytes())
    rows += bins.rest()
    pieces, used = collections.Counter(r[0] for r in rows), collections.Counter()
    for r in rows:
        used[r[5]] += r[2]
    assert sum(r[2] for r in rows) == lengths.sum() and max(used.values()) <= capacity
    fits = [k for k, n in enumerate(lengths.tolist()) if n <= capacity]
    assert np.mean([pieces[k] > 1 for k in fits]) < 0.15  # few documents that fit a sequence are cut
    padding = sum(capacity - u for u in used.values() if u & (u - 1))
    assert padding < 0.005 * lengths.sum()
    short = [r for r in rows if r[2] < capacity // 64 <= r[4] <= capacity]
    assert len(short) < 30  # but by the end of a task


def test_word_windows(spark, docs):
    docs = docs.where("doc_id is null or doc_id <> 5")
    rows = [(2**63 - 1 if r["doc_id"] is None else r["doc_id"], (r["text"] or "").encode().split()) for r in docs.collect()]
    first = {}
    for i, w in sorted(rows, key=lambda r: r[0]):
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    want = []
    for i, w in rows:
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < i:
                gone[j : j + 13] = [True] * 13
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    for batch, tree in ((10_000, 3_000), (1 << 22, 1 << 22)):
        got = substring_dedup.remove_repeats(docs, 13, batch, tree).collect()
        assert sorted((2**63 - 1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == sorted(want)
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("length, sizes", [(40, (10_000, 8_000)), (20, (1 << 22, 1 << 22))])
def test_byte_windows(spark, docs, length, sizes):
    rows = [(str(r["doc_id"]), (r["text"] or "").encode()) for r in docs.collect()]
    seen = collections.Counter(t[j : j + length] for _, t in rows for j in range(len(t) - length + 1))
    want = []
    for i, t in rows:
        gone = np.zeros(len(t) + 1, bool)
        for j in range(len(t) - length + 1):
            if seen[t[j : j + length]] > 1:
                gone[j : j + length] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        want.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    got = bwt_dedup.remove_repeats(docs, length, *sizes).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == sorted(want)
    assert bwt_dedup.remove_repeats(empty(spark)).count() == 0


def test_merging_transforms_finds_the_repeats():
    rng = np.random.default_rng(2)
    strings = [rng.integers(1, 3, 30) for _ in range(12)]
    shards, suffixes = [], []
    for part in (strings[:5], strings[5:6], strings[6:]):
        symbols = np.concatenate([np.append(s, 0) for s in part])
        ends = symbols == 0
        order = bwt_dedup.suffix_order(symbols, ends)
        starts = np.concatenate(([0], np.flatnonzero(ends)[:-1] + 1))
        before = np.where(np.isin(np.arange(len(symbols)), starts), 0, np.roll(symbols, 1))
        shards.append(before[order].astype(np.uint16))
        suffixes += [tuple(symbols[k : k + 6]) if not ends[k : k + 6].any() and k + 6 <= len(symbols) else None for k in order]
    row, _ = bwt_dedup.merge_transforms(shards, 6)
    count = collections.Counter(s for s in suffixes if s)
    assert sorted(row.tolist()) == [k for k, s in enumerate(suffixes) if s and count[s] > 1]


def slow_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for kind, pattern in (("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, t):
            n = len(pii.only_digits(m[0]))
            if kind == "card" and 13 <= n <= 19 and pii.luhn(pii.only_digits(m[0])) or kind == "phone" and 9 <= n <= 15:
                out.append((kind, *m.span()))
    return out


def test_personal_data(spark, docs):
    rng = np.random.default_rng(4)
    odd = ["".join(rng.choice(list("12.5@a-+ ()b_"), 200)) for _ in range(300)]
    texts = [*odd, "mail bob.x@mail.example.com, 4111 1111 1111 1111 or +1 (415) 555-2671 from 10.0.0.256 and 10.0.0.255", 'é token = "0cab398dc11d1a2a11dc6572c8df8bd228c86"', "7" * 20000]
    frame = docs.unionByName(spark.createDataFrame(rows_of(texts, range(1000, 1000 + len(texts))), DOCS))
    got = pii.find(frame).collect()
    assert len(got) == frame.count()
    text_of = {r["doc_id"]: r["text"] or "" for r in frame.collect()}
    for r in got:
        if r["doc_id"] is None:
            continue
        want = slow_spans(text_of[r["doc_id"]])
        count = collections.Counter(k for k, *_ in want)
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(count[k] for k in ("email", "ip", "card", "phone"))
        assert r["base_sha256"] == hashlib.sha256(pii.joined(want).encode()).hexdigest()
        assert {pii.joined([s]) for s in want} <= set(r["spans"].split(","))
    assert pii.find(empty(spark)).count() == 0
    clean = {r["doc_id"]: r["text"] for r in pii.redact(frame).collect()}
    assert "<EMAIL>" in clean[1300] and "<CARD>" in clean[1300] and "<PHONE>" in clean[1300] and "4111" not in clean[1300]
    assert clean[10] is None and clean[12] == text_of[12]


def test_em_trusts_agreeing_labelers():
    good, bad = pii.code("secret", "password=84b3aeb8a0a875c8bd", 0, 27, False), pii.code("secret", "xx key: aaaaaaaaa y", 3, 17, False)
    assert pii.fit({good: 50, bad: 50}) >= {good}
    assert pii.fit({}) == set()


def test_decontamination(spark):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    items = [" ".join(word() for _ in range(25)) for _ in range(20)]
    bench = spark.createDataFrame([*enumerate(items), (98, None), (99, "")], "item_id long, text string")
    filler = [" ".join(word() for _ in range(60)) for _ in range(20)]
    texts, leaked = [], {}
    for k, item in enumerate(items):
        body = list(item)
        for _ in range(k % 4 * 3):
            p = int(rng.integers(0, len(body)))
            body[p] = "z"
        shown = "".join(body)
        if k % 5 == 0:
            shown = shown.upper().replace(" ", "\n  ")
        texts += [filler[k] + " " + shown + " " + filler[k], filler[k]]
        leaked[2 * k] = k
    frame = spark.createDataFrame(rows_of([*texts, None, ""]), DOCS)
    for size in (1 << 20, 400):
        got = decontaminate.matches(frame, bench, block_bytes=size).collect()
        assert {r["doc_id"]: r["item_id"] for r in got} == leaked and len(got) == len(leaked)
        for r in got:
            found = texts[r["doc_id"]].encode()[r["start"] : r["end"]].decode().lower().split()
            assert abs(len(" ".join(found)) - len(items[r["item_id"]])) <= 16
    assert {r["doc_id"] for r in decontaminate.clean(frame, bench).collect()} == set(range(42)) - set(leaked)
    assert decontaminate.matches(empty(spark), bench).count() == 0
    assert decontaminate.matches(frame, empty(spark, "item_id long, text string")).count() == 0


def test_alignment_counts_edits():
    item = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    text = np.frombuffer(b"12345abcdXfghijklmnopqrstuvyz67890", np.uint8)
    assert decontaminate.aligned(item, text, 0, 10, 3) == (3, 5, 29)
    assert decontaminate.aligned(item, text, 0, 10, 2) is None


def test_language_identification(spark):
    rng = np.random.default_rng(7)
    vocabulary = {"en": ["the", "and", "with", "thing"], "de": ["der", "und", "ist", "schön"], "fr": ["le", "et", "que", "été"], "es": ["el", "y", "pero", "niño"]}
    rows = []
    for k in range(600):
        lang = ["en", "de", "fr", "es"][k % 4]
        rows.append((k, " ".join(rng.choice(vocabulary[lang], 30)), lang, "s"))
    rows += [(1000, None, "en", "s"), (1001, "12 34 !!", "en", "s"), (1002, "", None, "s"), (None, "the thing with", None, "s")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in langid.identify_held_out(frame).collect()}
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k in range(600))
    held = [k for k in range(600) if got[k]["held_out"]]
    assert np.mean([got[k]["lang_pred"] == ["en", "de", "fr", "es"][k % 4] for k in held]) > 0.97
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (1000, 1001, 1002))
    assert got[None]["lang_pred"] == "en" and not got[None]["held_out"] and all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify_held_out(empty(spark)).count() == 0
    assert {r["lang_pred"] for r in langid.identify_held_out(frame.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_languages_of_other_scripts(spark):
    rng = np.random.default_rng(12)
    vocabulary = {
        "ru": "это и не на что как дом река".split(),
        "uk": "це і не на що як дім ріка".split(),
        "zh": "我们 不是 这个 山水 今天 可以".split(),
        "ar": "هذا من على البيت كان يوم".split(),
        "en": "this is not on the house river".split(),
    }
    names = sorted(vocabulary)
    rows = [(k, " ".join(rng.choice(vocabulary[names[k % 5]], 25)), names[k % 5], "x", True) for k in range(500)]
    rows += [(1000, "это и не на что " * 200_000, "ru", "x", True), *rows[:5]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, held_out boolean")
    got = langid.identify_held_out(frame).collect()
    assert len(got) == len(rows)
    assert all(r["lang_pred"] == (names[r["doc_id"] % 5] if r["doc_id"] < 1000 else "ru") for r in got)
    model = langid.train(frame, F.lit(True), per_language=3)
    assert model.langs == names and len(langid.train(frame, F.lit(True), sample=5).langs) == 5
    # Margins against a plain sum over the text's trigrams.
    text = rows[7][1].encode()
    classes = langid.trigrams(np.frombuffer(b" " + text + b" ", np.uint8))
    plain = model.weights.astype(float)[classes].mean(0) + model.bias
    name, score = model.predict(plain[None])
    shown = langid.identify(spark.createDataFrame([rows[7]], frame.schema), model).first()
    assert (shown["lang_pred"], shown["score"]) == (name[0], pytest.approx(score[0], abs=1e-9))


def test_quality(spark):
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(900):
        body = list(rng.choice(words, 60))
        toxic, junk = k % 9 == 0, k % 9 == 1
        if toxic:
            body[int(rng.integers(0, 60))] = str(rng.choice(["idiot", "scum"]))
        if junk:
            body = [w + "###" for w in body]
        rows.append((k, " ".join(body)))
        if k < 600:
            labels += [(k, int(not junk), int(toxic))] * (1 + k % 2)
    rows += [(None, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("grade", F.lit("clash"))
    marks = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, marks)
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    assert len(got) == 902 and np.all(np.diff(model.thresholds) > 0)
    held = [got[k] for k in range(600, 900)]
    assert np.mean([r["keep"] == (r["doc_id"] % 9 > 1) for r in held]) > 0.97
    kept = quality.select(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["keep"] for r in got.values())
    assert quality.train(docs, empty(spark, "doc_id long, quality int, toxic int")) is None
    assert quality.score(docs, None).where("keep").count() == 902
    assert quality.score(docs.limit(0), model).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><article>";</script></head><body><nav><ul><li><a href="/a">Menu {k}</a></li><li>More</li></ul></nav>
<div class="ad banner">Buy {k}</div><article><h1>Title {k} &amp; co</h1><p>First <b>bold</b>&nbsp;text<br>line {k}</p><p>Second &#233; paragraph<p>Third unclosed<ul><li>one<li>two</ul><aside>side</aside><div id="comments">I disagree</div></article><footer>&copy; host</footer></body></html>"""


def test_pages(spark):
    rows = [(k, f"https://h{k % 2}.example.com/p/{k}", PAGE.format(k=k)) for k in range(12)]
    plain = "<html><body><div class='nav'>go</div><div>Body {k} text</div><div>Same everywhere</div></body></html>"
    rows += [(100 + k, "http://plain.org/x", plain.format(k=k)) for k in range(6)]
    rows += [(200, None, None), (201, "", ""), (202, "x:", "<p>a <b>b"), (203, "http://other.org/y", "no tags < at all"), (0, rows[0][1], rows[0][2])]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).repartition(4)
    got = collections.defaultdict(list)
    for r in html_wrap.main_text(frame).collect():
        got[r["page_id"]].append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert sum(map(len, got.values())) == len(rows) and len(got[0]) == 2
    assert got[3] == ["Title 3 & co\n\nFirst bold text line 3\n\nSecond é paragraph\n\nThird unclosed\n\none\n\ntwo"]
    assert got[101] == ["Body 1 text"]  # what is the same on every page of the host is template
    assert got[200] == got[201] == [""] and got[202] == ["a b"] and got[203] == ["no tags < at all"]
    assert html_wrap.main_text(frame.limit(0)).count() == 0


def vectors(spark, x, extra=()):
    rows = [(k, [float(v) for v in r], 1) for k, r in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_neighbours(spark):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((12, 8))
    x = (centres[rng.integers(0, 12, 3000)] + 0.3 * rng.standard_normal((3000, 8))).astype("f4")
    x[1000:1600] = x[0]  # copies
    odd = [(5000, None, 1), (5100, [0.0] * 8, 1), (5200, [float("nan")] * 8, 1), (5300, [None, *[1.0] * 7], 1), (5400, [1.0, 2.0], 1), (None, [1.0] * 8, 1), (5500, [float("inf")] * 8, 1)]
    frame = vectors(spark, x, odd).withColumn("part", F.lit("clash"))
    got = collections.defaultdict(list)
    for r in ann.search(frame, F.col("vec_id") % 100 == 0, sample=1500, per_partition=300, chunk=150).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    y = x.astype("f8")
    assert set(got) == set(range(0, 3000, 100))
    hit = 0
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 11))
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(3000), d))[:10]
        hit += len(set(best.tolist()) & {r[1] for r in rows})
        assert all(s == pytest.approx(d[v], abs=1e-12) for _, v, s in rows)
        assert rows == sorted(rows, key=lambda r: (r[2], r[1]))
    assert hit >= 0.9 * 300
    few = ann.search(vectors(spark, x[:4]), F.col("vec_id") == 0)
    assert few.count() == 3
    assert ann.search(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def recall(got, x, queries):
    found = collections.defaultdict(set)
    for r in got:
        found[r["query_id"]].add(r["vec_id"])
    hit = 0
    for q in queries:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hit += len(found[q] & set(np.lexsort((np.arange(len(x)), d))[:10].tolist()))
    return hit / (10 * len(queries))


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_on_the_corpus(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
    x = np.array([r["embedding"] for r in rows.orderBy("vec_id").collect()], float)
    got = ann.search(rows, F.col("vec_id") % 100 == 0).collect()
    assert ann.PER_PARTITION < len(x) / 1.9  # more than one partition
    assert len(got) == len(x) // 100 * 10 and recall(got, x, range(0, len(x), 100)) >= 0.9


def test_levels_of_partitions(spark, monkeypatch):
    monkeypatch.setattr(ann, "MOST", 6)
    rng = np.random.default_rng(10)
    x = rng.standard_normal((40, 6))[rng.integers(0, 40, 3000)] * 5 + rng.standard_normal((3000, 6))
    got = ann.search(vectors(spark, x), F.col("vec_id") % 100 == 0, sample=600, per_partition=90, chunk=200, most=6).collect()
    assert len(got) == 300 and recall(got, x.astype("f4").astype(float), range(0, 3000, 100)) >= 0.9


def test_huge_and_tiny_components_and_shared_ids(spark):
    rng = np.random.default_rng(11)
    for scale in (1e160, 1e-170):
        x = rng.standard_normal((60, 4)) * scale
        frame = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
        got = ann.search(frame, F.col("vec_id") == 0).orderBy("rank").collect()
        d = np.array([np.sqrt((((v - x[0]) / scale) ** 2).sum()) for v in x])
        d[0] = np.inf
        assert [r["vec_id"] for r in got] == np.argsort(d)[:10].tolist()
        assert got[0]["score"] == pytest.approx(d.min() * scale)
    rows = [(0, [1.0, 0.0]), (0, [5.0, 5.0]), (1, [1.0, 1.0]), (2, [9.0, 9.0]), (2, [1.0, 0.5])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(2, 0.5), (1, 1.0), (2, pytest.approx(145**0.5))]


def test_partition_is_balanced():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 4))
    part = ann.partition(ann._graph(x, 8), 5)
    assert set(np.bincount(part, minlength=5)) == {120}


def test_three_levels_of_partitions(spark):
    rng = np.random.default_rng(12)
    centres = rng.standard_normal((60, 8)) * 4
    x = centres[rng.integers(0, 60, 9000)] + rng.standard_normal((9000, 8))
    got = ann.search(vectors(spark, x), F.col("vec_id") % 100 == 0, sample=900, per_partition=110, chunk=400, most=5).collect()
    found = collections.defaultdict(set)
    for r in got:
        found[r["query_id"]].add(r["vec_id"])
    hits = 0
    for q in range(0, 9000, 100):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(found[q] & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hits / 900 >= 0.9  # 82 partitions in three levels of five at most


def test_equal_votes_go_to_the_first_name():
    model = langid.Model(np.zeros((4, 1 << langid.BITS), np.float32), ["de", "en", "fr", "it"])
    names, score = model.predict(np.zeros((2, model.weights.shape[1])))
    assert names == ["de", "de"] and (score > 0).all()

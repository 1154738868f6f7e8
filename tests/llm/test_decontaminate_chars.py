"""Benchmark passages against an edit distance over all places, in characters of any script."""

import numpy as np
import pyarrow as pa
import pytest

from lamella.llm import decontaminate


def least_edits(item, text):
    """Edits of the whole item against the best part of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


ALPHABETS = ["abcdefghij", "абвгдежзик", "日本語文字列検索器", "aéж日\U0001f600zñü"]


def damaged(rng, text, alphabet, n):
    chars = list(text)
    for _ in range(n):
        at = int(rng.integers(0, len(chars)))
        kind = int(rng.integers(0, 3))
        if kind == 0:
            chars[at] = str(rng.choice(list(alphabet)))
        elif kind == 1:
            del chars[at]
        else:
            chars.insert(at, str(rng.choice(list(alphabet))))
    return "".join(chars)


@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_finds_are_those_of_all_places(alphabet):
    rng = np.random.default_rng(len(alphabet))
    draw = lambda n: "".join(rng.choice(list(alphabet), n))
    items = [draw(int(n)) for n in (5, 8, 12, 30, 60, 90)]
    index = decontaminate.Index([(k, t.encode()) for k, t in enumerate(items)])
    texts = [None, "", "  "]
    for item in items:
        for n in range(0, 12, 2):
            texts.append(draw(15) + damaged(rng, item, alphabet, min(n, len(item) // 2)) + draw(15))
    got = {(r, item_id) for r, item_id, *_ in index.scan(pa.array(texts))}
    want = set()
    for r, text in enumerate(texts):
        for j, item in enumerate(items):
            if text and least_edits(item, text) <= index.most[j]:
                want.add((r, j))
    assert got == want and len(want) > 10


def test_places_are_bytes_and_edits_characters():
    text = "ё быстрая Xоричневая  лиса прыгает через ленивую собаку 日本"
    item = "быстрая коричневая лиса прыгает через ленивую собаку"
    ((row, item_id, start, end, edits),) = decontaminate.Index([(7, item.encode())]).scan(pa.array(["x", text]))
    assert (row, item_id, edits) == (1, 7, 1)
    assert text.encode()[start:end].decode() == "быстрая Xоричневая  лиса прыгает через ленивую собаку"


def test_equal_items_are_searched_once_and_all_named(spark):
    item = "the same passage of some thirty characters"
    bench = spark.createDataFrame([(k, item.upper() if k % 2 else item) for k in range(300)] + [(5, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + item, "a"), (1, "x " + item, "b"), (2, "other", "c"), (None, item * 2, None)], "doc_id long, text string, item_id string")
    assert len(decontaminate.Index([(k, item.encode()) for k in range(300)]).texts) == 1
    found = decontaminate.matches(docs, bench)
    assert found.count() == 4 * 301 and found.where("doc_id = 1").count() == 2 * 301
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(2, "other", "c")]


def test_long_texts_whole(spark):
    item = "a passage that stands at the very end of a long text"
    long = " ".join(f"word{k}" for k in range(60000)) + " " + item
    docs = spark.createDataFrame([(1, long), (2, long[:-3] + "ü"), (3, long[:-60])], "doc_id long, text string")
    rows = decontaminate.matches(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["edits"]) for r in rows} == {(1, 0), (2, 3)}

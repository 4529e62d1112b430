"""Operator 12 against a plain loop over all documents."""

import math
import re
from collections import Counter

import pytest

from gaugeworks.llm import ranked_search as R

from .samples import awkward, frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranked(rows, items, k=10):
    docs = [(key, Counter(terms(t)), len(terms(t))) for key, t in rows if terms(t)]
    count, length = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    sets = {}
    for key, text in items:
        if key is not None:
            sets.setdefault(key, set()).update(terms(text))
    out = []
    for item, asked in sets.items():
        found = []
        for key, tf, n in docs:
            m = 10 + 90 * n * count // length
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in asked if t in tf)
            if score > 0:
                found.append((-score, key is None, key or 0, key))
        out += [(item, n + 1, key, -score) for n, (score, _, _, key) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def items(spark, rows):
    return spark.createDataFrame([(k, t, "x", "y") for k, t in rows], "item_id long, text string, doc_id string, term string")


ASKED = [(1, "The ring of stone, über ALL; never seen words"), (2, "word"), (3, ""), (4, None), (None, "stone"), (5, "漢字 and Σίσυφος 42"), (5, "ñandú"), (6, "ring of stone The über all never seen words"), (7, "nothing matches here zzz"), (8, "x" * 5000), (9, "negative id")]


@pytest.mark.parametrize("slack,again,bits", [(0.7, 5, 22), (0.0, 1, 16), (1.0, 1, 22)])
def test_equal_to_a_loop(spark, monkeypatch, slack, again, bits):
    monkeypatch.setattr(R, "SLACK", slack)
    monkeypatch.setattr(R, "AGAIN", again)
    monkeypatch.setattr(R, "MAP_BITS", bits)
    rows = awkward(n=120)
    got = R.ranked_search(frame(spark, rows).repartition(3), items(spark, ASKED))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == ranked(rows, ASKED)


def test_few_and_no_documents(spark):
    assert R.ranked_search(frame(spark, []), items(spark, ASKED)).count() == 0
    assert R.ranked_search(frame(spark, awkward()), items(spark, [])).count() == 0
    rows = [(1, "stone"), (2, "stone stone"), (3, "ring"), (4, "other words")]
    got = R.ranked_search(frame(spark, rows), items(spark, ASKED), k=2)
    assert sorted(map(tuple, got.collect()), key=repr) == ranked(rows, ASKED, k=2)


def test_map_lets_its_terms_through(spark):
    asked = R.term_rows(items(spark, [(1, "one two three ünï")]).select("item_id", "text"))
    held = asked.selectExpr("explode(terms) as term")
    docs = frame(spark, [(7, "Three blind mice, two cats; THREE")]).select("doc_id", "text")
    found = R.term_rows(docs, R.term_map(held)).collect()
    assert [(r.id, r.n, sorted(r.tfs)) for r in found] == [(7, 6, [1, 2])]

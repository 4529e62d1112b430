import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import cluster as C
from gaugeworks.llm import ngram_join as J
from gaugeworks.llm.components import connected_components

from .samples import awkward, frame, sentence

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, n=5):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, threshold=0.8):
    sets = [grams(t) for _, t in rows]
    links, root = [0] * len(rows), list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    low = defaultdict(list)
    for i, r in enumerate(root):
        low[r].append(rows[i][0])
    least = {r: None if None in keys else min(keys) for r, keys in low.items()}
    return sorted(((rows[i][0], least[root[i]], links[i]) for i in range(len(rows))), key=str)


def cases():
    rng = random.Random(3)
    rows = awkward()
    for k in range(12):
        words = sentence(rng, rng.randint(60, 200)).split()
        for c in range(rng.randint(2, 9)):
            own = list(words)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = f"new{rng.randint(0, 99)}"
            rows.append((300 + 10 * k + c, " ".join(own)))
    return rows


def test_links_and_classes_equal_brute_force(spark):
    rows = cases()
    got = J.near_copies(frame(spark, rows).repartition(3))
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("sent", [0, J.BROADCAST_ROWS])
def test_chunks_give_the_same(spark, monkeypatch, sent):
    monkeypatch.setattr(J, "MEMBERS", 2)
    monkeypatch.setattr(J, "BROADCAST_ROWS", sent)
    monkeypatch.setattr(C, "HOT_ROWS", 3)
    monkeypatch.setattr(C, "HOT_KEYS", 20)
    rows = cases()
    got = J.near_copies(frame(spark, rows))
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got.collect()), key=str) == brute(rows)


def test_one_of_each_class_stays(spark):
    rows = cases()
    docs = frame(spark, rows).withColumn("hash", F.lit(1)).withColumn("key", F.lit("k"))
    kept = J.drop_near_copies(docs)
    assert kept.columns == docs.columns
    wordless = [k for k, t in rows if not grams(t)]
    classes = {c for k, c, _ in brute(rows)} - set(wordless)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([*classes, *wordless], key=str)


def test_repeated_rows_in_any_script(spark):
    rows = [(1, "\U0001f600 \U0001f601"), (1, "\U0001f600 \U0001f601"), (2, "漢字"), (2, "漢字"), (3, "?"), (3, "?")]
    assert sorted(r.doc_id for r in J.drop_near_copies(frame(spark, rows)).collect()) == [1, 2, 3, 3]


@pytest.mark.parametrize("sent", [0, J.BROADCAST_ROWS])
def test_near_copies_of_one_key_or_none_are_one_class(spark, monkeypatch, sent):
    monkeypatch.setattr(J, "BROADCAST_ROWS", sent)
    base = [sentence(random.Random(k), 120).split() for k in range(5)]
    text = lambda k, n: " ".join([*base[k][:-1], f"end{n}"])
    rows = [(5, text(0, 1)), (5, text(0, 2)), (5, text(0, 2)), (None, text(1, 1)), (None, text(1, 2)), (None, text(2, 1)), (None, text(2, 2)), (9, text(3, 1)), (None, text(3, 2)), (None, text(3, 3)), (7, text(4, 1)), (7, text(4, 2)), (6, text(4, 3))]
    kept = sorted(((r.doc_id, r.text) for r in J.drop_near_copies(frame(spark, rows).repartition(3)).collect()), key=str)
    least = lambda k: min((t for i, t in rows if t.split()[0] == base[k][0] and i == (5 if k == 0 else 6 if k == 4 else None)), key=lambda t: hashlib.md5(t.encode()).digest())
    assert kept == sorted([(5, least(0)), *((None, least(k)) for k in (1, 2, 3)), (6, least(4))], key=str)


def test_empty(spark):
    assert J.near_copies(frame(spark, [])).count() == 0
    assert J.drop_near_copies(frame(spark, [])).count() == 0


def test_banding():
    for recall in (0.9, 0.99, 0.9999):
        bands, rows = J.bands_for(0.8, recall)
        assert 1 - (1 - 0.8**rows) ** bands >= recall and bands * rows <= J.MOST_HASHES
    with pytest.raises(ValueError):
        J.bands_for(0.001, 0.99999, 16)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 40)] + [(100, 99), (7, 7), (200, 200), (None, 3)], "u long, v long")
    got = {r.node: r.root for r in connected_components(links).collect()}
    assert got == {**{k: 0 for k in range(41)}, 99: 99, 100: 99, 200: 200}


def test_settled_links_take_no_more_rounds(spark, monkeypatch):
    """Stars are told by the table that a round begins with; before, every graph went
    through a whole round more, and a table of links was made distinct three times a round."""
    from gaugeworks.llm import components as C

    made = []
    write = C.written
    monkeypatch.setattr(C, "written", lambda df, name: made.append(name) or write(df, name))
    links = [(k, 10 * (k // 10)) for k in range(100)] + [(k, 10 * (k // 10) + 1) for k in range(2, 100, 10)] + [(205, 205)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {k: 10 * (k // 10) for k in range(100)} | {205: 205}
    assert made == ["links", "least", "links", "least", "components"]

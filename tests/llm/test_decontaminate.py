import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import decontaminate as D

from .samples import awkward, frame, sentence

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for item, q in items:
            p = words(q)
            size = min(13, len(p))
            wins = {tuple(p[i : i + size]) for i in range(len(p) - size + 1)} if p else set()
            for i in range(len(w) - size + 1):
                if size and tuple(w[i : i + size]) in wins:
                    hit |= set(range(i, i + size))
                    found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((key, len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def cases():
    rng = random.Random(5)
    items = [(k, sentence(rng, rng.randint(14, 60))) for k in range(12)] + [(100, "two words"), (101, "a1"), (102, ""), (103, "...")]
    docs = awkward()
    for k in range(20):
        q = words(items[k % 12][1])
        docs.append((200 + k, sentence(rng, rng.randint(0, 300)) + " " + " ".join(q[: rng.randint(10, 60)]) + " " + sentence(rng, 5)))
    return docs, items


def test_report_equals_brute_force(spark):
    docs, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.decontamination_report(frame(spark, docs).repartition(3), bench).drop("items")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)


def test_blocks_of_the_benchmark_add_up(spark):
    docs, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    index = D.build_index(frame(spark, docs))
    blocks = D.store_blocks(bench.coalesce(1), block_bytes=120)
    assert len(blocks) > 3
    got = D.search_index(index, blocks).drop("items")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)


def test_windows_followed_in_slices():
    docs, items = cases()
    texts = [t for _, t in docs]
    raw, at = D.column_bytes(D.pa.array(texts, D.pa.string()))
    query = D.Windows.of([str(k) for k, _ in items], [t for _, t in items])
    shard = D.Shard.of(raw, at)
    whole = sorted(zip(*(x.tolist() for x in shard.find(query, 1)), strict=True))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(D, "FOLLOWED", 7)
        assert sorted(zip(*(x.tolist() for x in shard.find(query, 1)), strict=True)) == whole
    assert len(whole) > 50


def test_empty_tables_and_nulls(spark):
    docs, items = cases()
    none = spark.createDataFrame([], "item_id long, text string")
    got = D.decontamination_report(frame(spark, docs), none)
    assert got.where("contaminated or n_hit > 0").count() == 0 and got.count() == len(docs)
    bench = spark.createDataFrame([*items, (None, "two words"), (7, None)], "item_id long, text string")
    assert D.decontamination_report(frame(spark, []), bench).count() == 0


def test_filter_keeps_columns_and_clean_rows(spark):
    docs, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = frame(spark, docs).withColumn("items", F.lit("mine"))
    bad = [r[0] for r in brute(docs, items) if r[5]]
    kept = D.drop_contaminated(rows, bench)
    assert kept.columns == rows.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((k for k, _, *_ in [b for b in brute(docs, items) if not b[5]]), key=str)
    assert len(bad) + kept.count() == len(docs)


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x alpha beta gamma delta"), (2, "alpha beta oh gamma delta"), (3, "alpha beta oh my dear me gamma delta")], "doc_id long, text string")
    index = D.build_index(docs)
    got = D.phrase_matches(index, D.store_blocks(bench), slop=1)
    assert {(r.doc_id, r.exact) for r in got.collect()} == {(1, True), (2, False)}


def test_a_pass_over_the_blocks_serves_several_shards():
    docs, items = cases()
    shards, loads = [], []
    for _, t in docs:
        raw, at = D.column_bytes(D.pa.array([t], D.pa.string()))
        shards.append((len(shards), D.Shard.of(raw, at)))
    blocks = {str(k): D.Windows.of([str(i) for i, _ in items[k::3]], [q for _, q in items[k::3]]) for k in range(3)}
    found = list(D.judged_together(shards, sorted(blocks), lambda b: loads.append(b) or blocks[b], most=10))
    assert [what for what, _ in found] == list(range(len(docs)))
    assert len(loads) == 3 * -(-len(docs) // 10)
    got = [(docs[k][0], int(w[0]), int(h[0]), len(f[0]), D.items_digest(f[0]), bool(h[0] and 20 * h[0] >= w[0])) for k, (w, h, f) in found]
    assert sorted(got, key=str) == brute(docs, items)

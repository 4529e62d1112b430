import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from gaugeworks.llm import suffix_dedup as S

from .samples import awkward, frame, sentence


def brute(rows, length=200):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (key, _), t in zip(rows, texts):
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((key, len(t), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def cases(seed=4):
    rng = random.Random(seed)
    rows = awkward()
    shared = [sentence(rng, rng.randint(20, 90)) for _ in range(6)] + ["is onhe " * 60, "ü" * 150]
    for k in range(40):
        body = [sentence(rng, rng.randint(0, 40)), rng.choice(shared), sentence(rng, rng.randint(0, 40)), rng.choice(shared)[rng.randint(0, 30) :]]
        rows.append((400 + k, "".join(body)))
    return rows


def test_report_equals_brute_force(spark):
    rows = cases()
    got = S.dedup_report(frame(spark, rows).repartition(3))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_windows_instead_of_buckets_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST_BYTES", 600)
    monkeypatch.setattr(S, "LEVELS", 1)
    rows = cases(9)
    got = S.dedup_report(frame(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_removal_keeps_rows_and_columns(spark):
    rows = cases()
    docs = frame(spark, rows).withColumn("hash", F.lit(1)).withColumn("kept", F.lit("x"))
    out = S.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    left = {(r.doc_id, r.n_chars): r.text for r in out.collect()}
    assert all(t is None or len(t) == n for (_, n), t in left.items())
    removed = {k for k, _, n, *_ in brute(rows) if n}
    for key, text in rows:
        if key not in removed and key is not None and key != 3:
            assert left[(key, None if text is None else len(text))] == text


def test_empty(spark):
    assert S.dedup_report(frame(spark, [])).count() == 0


def test_merged_transforms_equal_counting():
    rng = random.Random(2)
    for length in (2, 4, 10, 24):
        for _ in range(20):
            base = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(0, 80))) for _ in range(6)]
            texts = [b"".join(rng.sample(base, 2)) for _ in range(rng.randint(1, 9))]
            count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
            want = [[i for i in range(len(t) - length + 1) if count[t[i : i + length]] > 1] for t in texts]
            assert [x.tolist() for x in S.repeated_windows(texts, length, rng.choice([60, 200, 10000]))] == want


def test_merging_takes_eight_bytes_a_round_and_only_rows_of_whole_strings(monkeypatch):
    rng = random.Random(8)
    shared = bytes(rng.choice(b"abcd") for _ in range(260))
    texts = [shared[k:] + bytes(rng.choice(b"abcd") for _ in range(40)) for k in range(0, 60, 3)] + [shared[:199], b"", bytes(300)]
    count = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    want = [[i for i in range(len(t) - 199) if count[t[i : i + 200]] > 1] for t in texts]
    size = [len(t) for t in texts]
    at = S.np.concatenate([[0], S.np.cumsum(size)])
    raw = S.np.frombuffer(b"".join(texts), S.np.uint8)
    shards = [S.Transform(raw[at[a] : at[b]], at[a : b + 1] - at[a]) for a, b in ((0, 9), (9, len(texts)))]
    sorts, argsort = [], S.np.argsort
    monkeypatch.setattr(S.np, "argsort", lambda x, **how: sorts.append(len(x)) or argsort(x, **how))
    found = S.merged_repeats(shards)
    monkeypatch.undo()
    places = S.np.concatenate([found[0][0], found[1][0] + at[9]])
    assert places.tolist() == [a + i for a, w in zip(at.tolist(), want) for i in w]
    assert len(sorts) <= 200 // 8 + 5
    assert sum(sorts) <= sum(size) + 200 // 8 * sum(max(0, n - 199) for n in size) + 2 * len(places)


def test_numbers_above_16_bits_are_distributed_in_order():
    rng = S.np.random.default_rng(3)
    for most in (0, 5, 65535, 65536, 1 << 20):
        number = rng.integers(0, most + 1, 5000, dtype=S.np.int32)
        assert S.distributed(number, most).tolist() == S.np.argsort(number, kind="stable").tolist()
    for top in (3, 1 << 20, (1 << 31) - 1):
        keys = rng.integers(0, top + 1, 3000) << 32 | rng.integers(0, top + 1, 3000)
        order = S.np.argsort(keys, kind="stable")
        assert S.ordered(keys)[1].tolist() == order.tolist()


def test_hot_anchors_are_cut_again(spark, monkeypatch):
    monkeypatch.setattr(S, "SPLIT_BYTES", 600)
    rows = cases(11)
    got = S.dedup_report(frame(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_repeated_intervals_have_the_common_prefix():
    rng = random.Random(6)
    for length in (2, 6, 12):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60))) for _ in range(5)]
        shards, raws = [], [b"".join(texts[:2]), b"".join(texts[2:])]
        for part, raw in ((texts[:2], raws[0]), (texts[2:], raws[1])):
            at = S.np.concatenate([[0], S.np.cumsum([len(t) for t in part])])
            shards.append((S.Transform(S.np.frombuffer(raw, S.np.uint8), at), at))
        named, strings = {}, []
        for (_, at), raw, (places, interval) in zip(shards, raws, S.merged_repeats([t for t, _ in shards], length)):
            for p, k in zip(places.tolist(), interval.tolist()):
                assert p + length <= at[S.np.searchsorted(at, p, "right")]
                named.setdefault(k, set()).add(raw[p : p + length])
        assert all(len(v) == 1 for v in named.values())
        strings = [next(iter(named[k])) for k in sorted(named)]
        assert strings == sorted(strings) and len(set(strings)) == len(strings)

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import language_id as L
from gaugeworks.llm import quality as Q
from gaugeworks.llm import queries, sampling
from gaugeworks.llm import toxicity as T
from gaugeworks.llm.arrowtext import column_bytes

from .samples import awkward, frame

DATA = "/root/testdata/sf0.01"
VOICES = {"aa": "the and ring stone over with", "bb": "der und ein schicht über mit", "cc": "que los ñandú para con una"}


def speak(rng, lang, n):
    return " ".join(rng.choice(VOICES[lang].split()) for _ in range(n))


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    return [(k, speak(rng, lang := list(VOICES)[k % 3], rng.randint(1, 40)), lang) for k in range(n)]


def test_subwords_by_definition():
    texts = ["", "a", "ab", "abc", "Abcde é"]
    raw, at = column_bytes(pa.array(texts))
    for (bucket, own), size in zip(L.subwords(raw, at), L.SIZES, strict=True):
        for k, t in enumerate(texts):
            b = t.encode()
            assert own[k + 1] - own[k] == (max(1, len(b) - size + 1) if b else 0)
            alone, _ = L.subwords(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[L.SIZES.index(size)]
            assert bucket[own[k] : own[k + 1]].tolist() == alone.tolist()


def test_language_of_held_out_rows_and_awkward_ones(spark):
    rows = corpus()
    labelled = spark.createDataFrame([*rows[:180], (900, None, "aa"), (901, "x", None)], "doc_id long, text string, lang string")
    model = L.fit_language_model(labelled, each=50)
    assert model.languages == ["aa", "bb", "cc"]
    docs = spark.createDataFrame([(k, t, "x") for k, t, _ in rows[180:]], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in L.identify(docs, model).collect()}
    assert sum(got[k].lang_pred == lang for k, _, lang in rows[180:]) >= 58
    assert all(0 <= r.score <= 1 for r in got.values())
    odd = L.identify(frame(spark, awkward()), model).collect()
    assert len(odd) == len(awkward())
    for r in odd:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) == (r.score == 0)
    assert L.identify(frame(spark, []), model).count() == 0
    none = L.fit_language_model(labelled.limit(0))
    assert {r.lang_pred for r in L.identify(docs, none).collect()} == {"und"}


def test_calibrated_rejection():
    rng = random.Random(2)
    texts = [speak(rng, "aa", 20) for _ in range(200)]
    noisy = L.train(texts, [rng.choice(["aa", "bb"]) for _ in texts], max_loss=1.0)
    assert noisy.reject_below > 0.5
    careful = L.train(texts, [rng.choice(["aa", "bb"]) for _ in texts])
    assert careful.reject_below <= noisy.reject_below
    rows = corpus()
    assert L.train([t for _, t, _ in rows], [x for _, _, x in rows]).reject_below < 0.9


def test_language_accuracy_on_the_tables(spark):
    found = queries.op2_language_id(spark, DATA).join(queries.table(spark, DATA, "documents").select("doc_id", "lang"), "doc_id")
    held = found.where("held_out and lang is not null and lang_pred <> 'und'")
    assert held.where("lang_pred = lang").count() >= 0.97 * held.count() > 200


def test_machine_equals_the_double_sum():
    rng = np.random.default_rng(1)
    size = (1 << Q.BITS) + len(Q.STATISTICS) * Q.BINS
    m = Q.FactorMachine(np.sort(rng.random((len(Q.STATISTICS), Q.BINS - 1)), axis=1), 0.1, rng.normal(0, 0.1, size).astype(np.float32), rng.normal(0, 0.1, (size, Q.FACTORS)).astype(np.float32))
    raw, at = column_bytes(pa.array(["one two two three", "", "x!!"]))
    rows, _ = Q.features(raw, at, m.edges)
    for i, score in enumerate(m.scores(rows)):
        index, x = rows.row(i)
        y = m.bias + sum(m.weight[j] * v for j, v in zip(index, x))
        y += sum(float(m.factor[index[a]] @ m.factor[index[b]]) * x[a] * x[b] for a in range(len(index)) for b in range(a))
        assert score == pytest.approx(1 / (1 + math.exp(-y)), abs=1e-4)


def test_quality_on_the_tables(spark):
    found = queries.op7_quality(spark, DATA)
    labels = queries.table(spark, DATA, "labels").select("doc_id", "quality")
    rows = found.join(labels, "doc_id").where("held_out").collect()
    assert found.count() == 1000
    good = [r.predicted for r in rows if r.quality == 1]
    bad = [r.predicted for r in rows if r.quality == 0]
    assert sum(good) >= 0.9 * len(good) and sum(bad) <= 0.35 * len(bad)
    odd = Q.score_quality(frame(spark, awkward()), Q.train(["good words here"] * 20 + ["!!! ***"] * 20, [1] * 20 + [0] * 20)).collect()
    assert len(odd) == len(awkward()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in odd)
    assert Q.score_quality(frame(spark, []), Q.train([], [])).count() == 0


def test_chain_learns_from_unseen_probabilities(spark):
    rng = random.Random(3)
    rows = []
    for k in range(400):
        foul, loud = rng.random() < 0.4, rng.random() < 0.4
        text = speak(rng, "aa", 20) + (" idiot" * rng.randint(1, 3) if foul else "") + (" shouting" if loud else "")
        rows.append((k, text, int(loud), int(foul)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, a, b) for k, _, a, b in rows if k < 300] + [(5, None, 1)], "doc_id long, loud int, foul int")
    chain = T.fit_toxicity(docs, labels, ["loud", "foul"])
    assert [len(m.chain) for m in chain.models] == [0, 1]
    got = {r.doc_id: r for r in T.score_toxicity(docs, chain).collect()}
    assert sum(got[k].toxic == bool(b) for k, _, _, b in rows if k >= 300) >= 98
    odd = T.score_toxicity(frame(spark, awkward()).withColumn("toxic", F.lit(1)), chain).collect()
    assert len(odd) == len(awkward()) and all(0 <= r.p_foul <= 1 for r in odd)
    assert T.score_toxicity(frame(spark, []), chain).count() == 0


def test_samples_are_bounded_and_repeatable(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") < 4000, "a").when(F.col("id") < 4990, "b").alias("y"))
    got = sampling.per_class(rows, "y", 100)
    counts = {r.y: r["count"] for r in got.groupBy("y").count().collect()}
    assert counts[None] == 10 and 60 < counts["a"] < 150 and 60 < counts["b"] < 150
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in sampling.per_class(rows.repartition(7), "y", 100).collect())
    assert sampling.per_class(rows.limit(0), "y", 100).count() == 0


def test_no_class_is_left_out_and_repeats_count_once(spark, monkeypatch):
    rows = spark.range(6000).select((F.col("id") % 3000).alias("id"), (F.col("id") % 600).cast("string").alias("y"))
    counts = sampling.per_class(rows, "y", 50).groupBy("y").count().collect()
    assert len(counts) == 600 and {r["count"] for r in counts} == {5}
    monkeypatch.setattr(sampling, "MOST_CLASSES", 599)
    with pytest.raises(ValueError):
        sampling.per_class(rows, "y", 50)


def test_text_of_an_untaught_language_is_rejected(spark):
    docs = queries.table(spark, DATA, "documents")
    model = queries.fit_languages(docs)
    strange = ["これは日本語の文章です。とても長い文ではありません。", "Это предложение написано на русском языке и довольно короткое.", "αυτό είναι ελληνικά και μάλλον άγνωστο", "Bu cümle Türkçe yazılmıştır ve model bunu bilmiyor", "qwzx vkjq xzzq wvvk qqxz jjkw zxqv wkjx qzvx"]
    frame_ = spark.createDataFrame(list(enumerate(strange)), "doc_id long, text string")
    assert [r.rejected for r in L.identify(frame_, model).orderBy("doc_id").collect()] == [True] * len(strange)
    held = L.identify(docs.where(sampling.bucket_of(F.col("doc_id"), 3) == 1).where("text rlike '\\\\p{L}'"), model)
    assert held.where("rejected").count() <= 0.001 * held.count() + 1


def test_columns_of_any_name_and_type_are_carried(spark):
    model = L.train([t for _, t, _ in corpus(60)], [x for _, _, x in corpus(60)])
    machine = Q.train(["good words here"] * 20 + ["!!! ***"] * 20, [1] * 20 + [0] * 20)
    chain = T.train_chain(["fine words"] * 20 + ["foul idiot"] * 20, np.repeat([[0], [1]], 20, axis=0), ["foul"])
    docs = frame(spark, awkward()).select("*", F.struct(F.lit(1).alias("a b")).alias("odd name"), F.lit("x").alias("SCORE"), F.lit(2).alias("Rejected"), F.lit(3).alias("TOXIC"), F.lit(4).alias("t"))
    for found, gone in ((L.identify(docs, model), {"score", "rejected"}), (Q.score_quality(docs, machine), {"score"}), (T.score_toxicity(docs, chain), {"toxic"})):
        kept = [c for c in docs.columns if c.lower() not in gone]
        assert found.columns[: len(kept)] == kept and len({c.lower() for c in found.columns}) == len(found.columns)
        assert found.select("`odd name`.`a b`", "t").distinct().collect() == [(1, 4)] and found.count() == docs.count()


def test_chain_equals_a_plain_loop():
    rng = random.Random(8)
    texts = [speak(rng, "aa", 12) + (" idiot" if k % 3 == 0 else "") for k in range(60)]
    targets = np.array([[k % 2, k % 3 == 0] for k in range(60)], int)
    chain = T.train_chain(texts, targets, ["loud", "foul"])
    raw, at = column_bytes(pa.array(texts))
    got = chain.probabilities(T.presence(raw, at))
    for i, t in enumerate(texts):
        alone = T.presence(*column_bytes(pa.array([t])))
        earlier = []
        for k, model in enumerate(chain.models):
            weight = dict(zip(model.index.tolist(), model.weight.tolist()))
            z = model.bias + sum(weight.get(j, 0.0) for j in alone.row(0)[0].tolist()) + sum(w * p for w, p in zip(model.chain, earlier))
            earlier.append(1 / (1 + math.exp(-z)))
            assert got[i, k] == pytest.approx(earlier[k], abs=1e-5)


def test_linear_training_equals_a_plain_loop():
    """The regularised leader weight by weight, without arrays."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice("a b c d e f".split()) for _ in range(rng.randint(0, 6))) for _ in range(20)]
    rows = T.presence(*column_bytes(pa.array(texts)))
    target, earlier, use = np.array([k % 2 for k in range(20)], float), np.random.default_rng(1).random((20, 1)), np.arange(3, 20)
    model = T.fit_linear(rows, earlier, target, use, epochs=2)
    z, n, penalty = {}, {}, min(T.MOST_SPARSITY, T.SPARSITY * len(use))

    def weight(j):
        a, most = z.get(j, 0.0), 0.0 if isinstance(j, str) else penalty
        return 0.0 if abs(a) <= most else -(a - math.copysign(most, a)) / ((1 + math.sqrt(n.get(j, 0.0))) / 0.3 + 0.1)

    order = np.random.default_rng(5)
    for _ in range(2):
        for i in order.permutation(use):
            x = {**{j: 1.0 for j in rows.row(i)[0].tolist()}, "chain": earlier[i, 0], "bias": 1.0}
            held = {j: weight(j) for j in x}
            off = 1 / (1 + math.exp(-sum(held[j] * v for j, v in x.items()))) - target[i]
            for j, v in x.items():
                g = off * v
                s = (math.sqrt(n.get(j, 0.0) + g * g) - math.sqrt(n.get(j, 0.0))) / 0.3
                z[j], n[j] = z.get(j, 0.0) + g - s * held[j], n.get(j, 0.0) + g * g
    assert model.bias == pytest.approx(weight("bias")) and model.chain[0] == pytest.approx(weight("chain"))
    assert dict(zip(model.index.tolist(), model.weight.tolist())) == pytest.approx({j: weight(j) for j in z if not isinstance(j, str) and weight(j)}, abs=1e-5)


def test_toxicity_on_the_tables(spark):
    found = queries.op1_toxicity(spark, DATA)
    assert found.count() == 1000 and found.columns == ["doc_id", "held_out", "p_poor", "p_toxicity", "toxic"]
    rows = found.withColumnRenamed("toxic", "said").join(queries.table(spark, DATA, "labels"), "doc_id").collect()
    clean = [r.said for r in rows if r.toxic == 0]
    bad = [r.said for r in rows if r.toxic == 1]
    assert sum(clean) <= 0.03 * len(clean) and sum(bad) >= 0.7 * len(bad)  # 51 bad ones, of which some 40 are learned from

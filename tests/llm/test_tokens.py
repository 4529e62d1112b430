import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeworks.llm import bpe, separators, token_files
from gaugeworks.llm.byte_tokens import ByteTokens
from gaugeworks.llm.eliasfano import EliasFano
from gaugeworks.llm.pretokens import Split

from .samples import awkward, frame

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
WORDS, BYTES = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
ODD = "'stmdrevl  \n\t\x0b\x1c\x1f\x85\xa0²½٣①ªßİΣσςÀé́e漢字😀!?.<|>0129_ab AZ​ 　Å\0"


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))) for _ in range(n)]
    return texts + ["<|endoftext|>", "a<|startoftext|>b<|endoftext|><|endoftext|>c", "<|endoftext", "it's they'RE we'll 'tis x'''s"]


def test_word_bpe_equals_the_library():
    lib, own = tokenizers.Tokenizer.from_file(WORDS), bpe.WordEndBpe(WORDS)
    texts = odd_texts(3000)
    for text, (ids, decoded, n) in zip(texts, own.encode_texts(texts), strict=True):
        want = lib.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)) and n == len(want)
        assert decoded == lib.decode(want, skip_special_tokens=False)


def test_byte_tokens_equal_the_library():
    lib, own = tokenizers.Tokenizer.from_file(BYTES), ByteTokens(BYTES)
    texts = odd_texts(3000, 2)
    for text, ids in zip(texts, own.encode_texts(texts), strict=True):
        assert np.frombuffer(ids, own.type).tolist() == lib.encode(text, add_special_tokens=False).ids
    (plain,) = ByteTokens(BYTES, special_is_text=True).encode_texts(["<|endoftext|>"])
    assert 50256 not in np.frombuffer(plain, "<u2")


@pytest.mark.parametrize("path,own", [(WORDS, bpe.WordEndBpe), (BYTES, ByteTokens)])
def test_every_code_point_as_the_library(path, own):
    """Alone, after a letter, after a blank and after a digit: letters and cases that Python
    does not know yet come out as the library's."""
    lib, mine = tokenizers.Tokenizer.from_file(path), own(path)
    for first in range(0, 0x110000, 1 << 16):
        texts = [f"{chr(c)} a{chr(c)}b {chr(c)}1{chr(c)}" for c in range(first, first + (1 << 16)) if not 0xD800 <= c < 0xE000]
        if first > 0x30000:
            texts = texts[::97]  # planes without letters, private use
        found = mine.encode_texts(texts)
        got = [[int(x) for x in f[0].split()] for f in found] if own is bpe.WordEndBpe else [np.frombuffer(f, mine.type).tolist() for f in found]
        want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
        assert got == want, next(hex(ord(t[0])) for t, a, b in zip(texts, got, want) if a != b)


def test_split_covers_the_text():
    for text in odd_texts(500, 3):
        split = Split([text, text], spaces_attach=True)
        assert "".join(split.text(i) for i in range(split.at[0], split.at[1])) == text


def test_bpe_frame(spark):
    lib = tokenizers.Tokenizer.from_file(WORDS)
    docs = frame(spark, awkward()).withColumn("n_tokens", F.lit("old"))
    outputs = ["n_tokens", "ids_sha256", "decoded_sha256"]
    out = bpe.bpe_encode(docs, WORDS, outputs=outputs)
    assert out.columns == [*(c for c in docs.columns if c != "n_tokens"), *outputs]
    rows = out.collect()
    assert len(rows) == len(awkward())
    for r in rows:
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.bpe_encode(frame(spark, []), WORDS).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=300))
def test_elias_fano_round_trip(values):
    values.sort()
    code = EliasFano.of(np.array(values, np.uint64))
    back, end = EliasFano.frombytes(b"xx" + code.tobytes(), 2)
    assert end == 2 + len(code.tobytes()) and back.select_range(0, len(values)).tolist() == values
    assert [back.select(i) for i in range(len(values))] == values
    assert all(back.select_range(i, j).tolist() == values[i:j] for i in range(0, len(values), 37) for j in range(i, len(values), 53))
    assert all(back.last_at_most(v + d) == sum(x <= v + d for x in values) for v in values[::29] for d in (-1, 0, 1) if v + d >= 0)


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 4000, 50_000))
    assert len(EliasFano.of(ends).tobytes()) < 50_000 * 14 / 8
    with pytest.raises(ValueError):
        EliasFano.of(np.array([2, 1]))


def test_token_files(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 3000)
    lib = tokenizers.Tokenizer.from_file(BYTES)
    rows = awkward()
    manifest = token_files.write_token_files(frame(spark, rows).repartition(3), BYTES)
    got = token_files.read_token_files(spark, manifest).collect()
    assert len(got) == len(rows)
    got.sort(key=lambda r: r.start)
    keys = [r.doc_id for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got]).tolist()[:-1]]
    want = sorted((str(k), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for k, t in rows for ids in [[*lib.encode(t or "", add_special_tokens=False).ids, 0]])
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want
    empty = token_files.write_token_files(frame(spark, []), BYTES)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_rows_of_one_key_spread_over_files(spark):
    rows = [(7, f"text {k % 50}") for k in range(400)] + [(9, "last"), (None, "first")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = token_files.write_token_files(frame(spark, rows).repartition(3), BYTES)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert manifest.where("least = 7").count() > 2
    got = sorted(token_files.read_token_files(spark, manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, *[7] * 400, 9]
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got]).tolist()[:-1]]


def test_one_file_by_select():
    rows = [[5, 6, 0], [0], [7, 0]]
    file = token_files.TokenFile.of(token_files.packed(np.array([-3, 9]), 1, np.array([3, 1, 2]), np.array(sum(rows, []), "<u2").tobytes(), 2))
    assert [file.document(i).tolist() for i in range(3)] == rows and file.n_null == 1
    assert file.doc_ids(0, 3) == [None, -3, 9] and file.doc_ids(2, 3) == [9]
    assert [list(file.places(k)) for k in (-4, -3, 0, 9, 10)] == [[], [1], [], [2], []]
    assert list(file.runs(1)) == [(0, 1), (1, 2), (2, 3)] and list(file.runs(1 << 20)) == [(0, 3)]


def test_a_document_is_read_without_its_file():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 4000, 20_000)
    ids = rng.integers(0, 50_000, int(sizes.sum())).astype("<u2")
    keys = np.cumsum(rng.integers(0, 3, len(sizes)))
    data, fetched = token_files.packed(keys, 0, sizes, ids.tobytes(), 2), []

    def read_at(size, offset):
        fetched.append(size)
        return data[offset : offset + size]

    file = token_files.TokenFile(read_at)
    opened, cut = sum(fetched), np.concatenate([[0], np.cumsum(sizes)])
    for i in (0, 1, 777, len(sizes) - 1):
        del fetched[:]
        assert file.document(i).tolist() == ids[cut[i] : cut[i + 1]].tolist()
        assert sum(fetched) == 2 * sizes[i]
        assert i in file.places(int(keys[i])) and {int(keys[k]) for k in file.places(int(keys[i]))} == {int(keys[i])}
    assert opened < len(data) // 500


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
def test_separators_across_blocks(spark, block):
    lib = tokenizers.Tokenizer.from_file(WORDS)
    lib.encode_special_tokens = True
    rows = awkward(n=8) if block > 6 else [(1, None), (2, "one two three"), (3, ""), (4, "four"), (5, None)]
    got = separators.token_counts(frame(spark, rows).coalesce(2), WORDS, 49407, block_bytes=block).collect()
    want = sorted((str(k), len(lib.encode(t or "", add_special_tokens=False).ids)) for k, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == want


def test_no_separators_without_rows(spark):
    assert separators.token_counts(frame(spark, []), WORDS, 49407).count() == 0


def test_keys_of_any_type_and_repeated_attempts(spark):
    docs = spark.createDataFrame([("b", "one two", 1), (None, "three", 2), ("b", None, 3)], "doc_id string, text string, n_tokens int").repartition(2)
    placed, folder = separators.write_flat_files(docs, WORDS, 49407)
    again, _ = separators.write_flat_files(docs, WORDS, 49407, folder=folder)
    files = placed.select("file").distinct().collect()
    assert not {r.file for r in files} & {r.file for r in again.select("file").distinct().collect()}
    got = separators.token_counts(docs, WORDS, 49407)
    assert sorted(map(str, got.collect())) == sorted(["Row(doc_id='b', n_tokens=0)", "Row(doc_id='b', n_tokens=2)", "Row(doc_id=None, n_tokens=1)"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    with pytest.raises(ValueError):
        token_files.write_token_files(docs, BYTES)


def test_words_of_one_hash_are_told_apart(monkeypatch):
    from gaugeworks.llm import pretokens

    monkeypatch.setattr(pretokens, "span_hashes", lambda raw, start, end: (end - start).astype(np.uint64))
    lib, own = tokenizers.Tokenizer.from_file(BYTES), ByteTokens(BYTES)
    texts = odd_texts(200, 5)
    for text, ids in zip(texts, own.encode_texts(texts), strict=True):
        assert np.frombuffer(ids, own.type).tolist() == lib.encode(text, add_special_tokens=False).ids


def test_a_text_of_tens_of_megabytes(spark):
    """Encoded whole."""
    word = "stone and ring over the water "
    text = word * (24_000_000 // len(word))
    lib = tokenizers.Tokenizer.from_file(WORDS)
    each = len(lib.encode(word, add_special_tokens=False).ids)
    docs = spark.createDataFrame([(1, "x"), (2, text)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in separators.token_counts(docs, WORDS, 49407).collect()}
    assert got == {1: 1, 2: each * (len(text) // len(word))}

"""Token counts, packing and token files against the library and against brute force."""

import json
import random
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import odd
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import packing, queries, token_counts, token_files
from millrace.llm.tokens import ByteLevelEncoder

BYTE_BPE, WORD_BPE = (public_tokenizers.path(p) for p in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@lru_cache
def plain_library():
    """The library as it comes, without settings."""
    return Tokenizer.from_file(BYTE_BPE)


@lru_cache
def own_encoder():
    return ByteLevelEncoder(BYTE_BPE)


@pytest.fixture(scope="module")
def library():
    t = plain_library()
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def encoded(texts):
    ids, at = own_encoder().encode(pa.array(texts, pa.string()))
    return [ids[i:j].tolist() for i, j in zip(at, at[1:], strict=False)]


def test_encoder_gives_the_library_ids(library, texts):
    given = [*texts.values(), *(r[1] for r in odd.ROWS), "a\n b", "a \nb", "\n\n x", "don't  it's  x", "1,000.50 (é)\tx", " a  b", "　\n　x", "a  <|endoftext|> b<|endoftext|>c", "<|endoftext|>", "<|endoftext|><|endoftext|>\n\n<|endoftext|>", "x<|endo", "ftext|>y", "<|<|endoftext|>|>"]
    assert encoded(given) == [library(t) for t in given]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab Z9'.,-\n\t\r\x0b \u0085 　éÅß日😀<|>", "<|endoftext|>", "<|endo", "ftext|>"]), max_size=30).map("".join), max_size=4))
def test_encoder_on_any_text(texts):
    assert encoded(texts) == [plain_library().encode(x, add_special_tokens=False).ids for x in texts]


def greedy(word, pieces):
    """Longest piece at each place; the end of the word, where no piece takes it, counts nothing."""
    at = n = 0
    symbols = (*word.encode("utf-8", "surrogatepass"), 256)
    while at < len(symbols) and symbols[at:] != (256,):
        at += next(k for k in range(min(40, len(symbols) - at), 0, -1) if symbols[at : at + k] in pieces)
        n += 1
    return n


@pytest.fixture(scope="module")
def pieces():
    alphabet = token_counts.byte_alphabet()
    out = {(b,) for b in range(256)} | {(b, 256) for b in range(256)}
    for p in json.load(open(WORD_BPE, encoding="utf-8"))["model"]["vocab"]:
        body = p.removesuffix("</w>")
        if body and all(c in alphabet for c in body):
            out.add((*(alphabet[c] for c in body), *([256] if p.endswith("</w>") else [])))
    return out


def test_counts_equal_greedy_longest_match(spark, texts, pieces):
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in queries.op4_token_counts(spark, SMALL).collect()}
    sizes = {}
    for doc_id, text in texts.items():
        words = token_counts._WORD.findall((text or "").lower())
        for w in set(words) - set(sizes):
            sizes[w] = greedy(w, pieces)
        assert got[doc_id] == (len(words), sum(sizes[w] for w in words))
    assert len(got) == len(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", min_size=2, max_size=5), max_size=12), st.text("abc", max_size=25))
def test_automaton_equals_greedy(vocabulary, word):
    pieces = {tuple(map(ord, p)) for p in vocabulary} | {(ord(c),) for c in "abc"}
    at = n = 0
    symbols = tuple(map(ord, word))
    while at < len(symbols):
        at += next(k for k in range(5, 0, -1) if symbols[at : at + k] in pieces)
        n += 1
    assert token_counts.Automaton(sorted(pieces)).count(list(symbols)) == n


def test_counts_of_odd_rows(spark):
    got = [tuple(r) for r in token_counts.count_tokens(odd.documents(spark), WORD_BPE).collect()]
    assert len(got) == len(odd.ROWS) and (3, 0, 0) in got and (4, 0, 0) in got and (5, 0, 0) in got and (None, 0, 0) in got
    assert dict((d, w) for d, w, _ in got)[7] == 60_000
    assert token_counts.count_tokens(odd.none(spark), WORD_BPE).collect() == []


def least_sequences(lengths, size):
    """A lower bound: pieces over half of a sequence can't share one, and what small pieces
    can't put beside them needs room of its own."""
    best = 0
    for k in range(size // 2 + 1):
        alone = sum(n > size - k for n in lengths)
        half = [n for n in lengths if size / 2 < n <= size - k]
        small = sum(n for n in lengths if k <= n <= size / 2)
        best = max(best, alone + len(half) + max(0, -(-(small - (len(half) * size - sum(half))) // size)))
    return best


def check_packing(rows, ids_of, size=1024):
    """The contract of packing, over (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    by_sequence, by_document = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_document.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for placed in by_sequence.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= size
    assert set(by_document) == set(ids_of)
    for d, parts in by_document.items():
        ids, at = ids_of[d], 0
        for k, (piece, start, length, sum32) in enumerate(sorted(parts)):
            assert (piece, start) == (k, at) and sum32 == crc(ids[at : at + length])
            assert length == size or k == 0
            at += length
        assert at == len(ids)
    return len(by_sequence), least_sequences([r["length"] for r in rows], size)


def test_packing_holds_every_id_once(spark, texts, library):
    used, least = check_packing(queries.op5_pack(spark, SMALL).collect(), {d: library(t) + [2] for d, t in texts.items()})
    assert used <= 1.01 * least + 1


def test_packing_odd_rows(spark):
    got = packing.pack(odd.documents(spark), BYTE_BPE).collect()
    assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == Counter(r[0] for r in odd.ROWS)
    assert {r["doc_id"]: r["length"] for r in got}[3] == 1
    assert packing.pack(odd.none(spark), BYTE_BPE).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 16), st.integers(1, 30), max_size=10))
def test_plan_uses_each_length_as_often_as_it_is_there(histogram):
    used, sequences = Counter(), 0
    for pattern, times in packing.pack_plan(histogram, 16):
        assert sum(pattern) <= 16 and times > 0
        sequences += times
        for n in pattern:
            used[n] += times
    assert used == Counter(histogram)
    assert sequences <= 1.5 * least_sequences([n for n, c in histogram.items() for _ in range(c)], 16) + 1


def test_plan_fills_gaps_exactly():
    assert packing.pack_plan({10: 2, 6: 2, 9: 1, 4: 1, 3: 1, 8: 1, 5: 1, 2: 1, 1: 1}, 16) and all(sum(p) == 16 for p, _ in packing.pack_plan({10: 2, 6: 2, 9: 1, 4: 1, 3: 1, 8: 1, 5: 1, 2: 1, 1: 1}, 16))


def test_token_files_round_trip(spark, texts, library):
    got = {r["doc_id"]: r for r in queries.op10_token_files(spark, SMALL).collect()}
    at = 0
    for d in sorted(texts):
        ids = library(texts[d]) + [0]
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)
    assert len(got) == len(texts)


def test_token_files_odd_rows(spark):
    got = sorted((r["start"], r["n_tokens"]) for r in token_files.token_files(odd.documents(spark), BYTE_BPE).collect())
    assert len(got) == len(odd.ROWS)
    assert [s for s, _ in got] == [sum(n for _, n in got[:i]) for i in range(len(got))]
    assert token_files.token_files(odd.none(spark), BYTE_BPE).collect() == []


def test_one_id_of_most_rows_is_dealt_over_files(spark, tmp_path, library, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 20_000)
    rows = [(5, f"text {i} " * (1 + i % 9)) for i in range(3000)] + [(i, f"own {i}") for i in range(-200, 200)] + [(None, "no id")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    token_files.write_tokens(df, f"file://{tmp_path}/t", BYTE_BPE)
    sizes = [p.stat().st_size for p in (tmp_path / "t").glob("part-*")]
    assert len(sizes) >= 8 and max(sizes) < 0.5 * sum(sizes)
    got = token_files.read_tokens(spark, f"file://{tmp_path}/t").collect()
    want = Counter((d, len(ids), crc(ids)) for d, ids in ((d, library(t) + [0]) for d, t in rows))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    got.sort(key=lambda r: r["start"])
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    order = [-(1 << 63) if r["doc_id"] is None else r["doc_id"] for r in got]
    assert order == sorted(order)


def test_frames_with_outliers():
    rng = random.Random(1)
    ids = [np.array([rng.choice([5, 70, 900, 2**31, 2**32 - 1]) for _ in range(n)], np.int64) for n in (0, 1, 127, 128, 129, 1000)]
    starts = np.cumsum([0, *(len(x) for x in ids)])
    names = [0, None, -3, 2**62, 4, 5]
    raw = b"".join(f + b"\n" for f in token_files.encode_frames(np.concatenate(ids), starts, names))
    for blocks in (1, 3, 4096):
        keys, back = [], []
        for k, flat, at in token_files.decode_frames(raw, blocks):
            keys += k
            back += [flat[i:j].tolist() for i, j in zip(at, at[1:], strict=False)]
        assert keys == names and back == [x.tolist() for x in ids]

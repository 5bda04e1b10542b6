import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from geoloom.llm import packing, token_files
from geoloom.llm.chunk_encoder import encoder

ODD = [None, "", "  a  b \n\n c\t d  ", "it's don't we'll x \x1c y", "á ́b É", "x" * 9000, " \n ", "<|endoftext|> hi", "a \n<|endoftext|>b<|ENDOFTEXT|> <|startoftext|>'s", "3.14  2,000 -- ...", "word " * 9000, "same", "same"]
DOCS = "doc_id long, text string, n_tokens string, shard string, length string, part int"


def docs(spark, texts=ODD):
    rows = [(None if i == 3 else (7 if i in (4, 5) else 100 - i), t, "x", "y", "z", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def plain(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunked_encoding_equals_whole_encoding(name):
    t, e = plain(name), encoder(public_tokenizers.path(name))

    @settings(max_examples=200, deadline=None)
    @given(st.text(alphabet=st.one_of(st.sampled_from("abc ABÉéß'’\n\t .,*!_\x1c\xa0 ́123"), st.characters(codec="utf-8")), max_size=60))
    def same(text):
        assert np.frombuffer(e.encode([text])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids

    same()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from([0, 1, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1]), max_size=9), max_size=6))
def test_code_round_trip(lists):
    n = np.array([len(x) for x in lists], np.int64)
    control, data = token_files.pack_ranks(np.array(sum(lists, []), np.uint32), n)
    assert token_files.unpack_ranks(control, data, n).tolist() == sum(lists, [])
    assert [len(c) for c in control] == [(k + 3) // 4 for k in n]


def test_files_against_plain_encoding(spark, tmp_path):
    path = f"file://{tmp_path}/f"
    token_files.write_token_files(docs(spark), path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    got = sorted(token_files.crc_digest(token_files.read_token_files(spark, path)).collect(), key=lambda r: r["start"])
    t = plain("byte_bpe_50k.json")
    want = [(r["doc_id"], np.array(t.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for r in docs(spark).collect()]
    want.sort(key=lambda x: (x[0] is not None, x[0] or 0, len(x[1]), x[1]))
    at = 0
    for r, (doc, ids) in zip(got, want, strict=True):
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc, at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    assert ranks[0]["token"] in (2, 1573)  # the end id or the repeated word


def test_a_hot_id_is_dealt_over_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_TOKENS", 40)
    rows = [(i, f"text {i} <|endoftext|>") for i in range(60)] + [(30, f"hot {i}") for i in range(60)] + [(None, "null")] * 40
    path = f"file://{tmp_path}/h"
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    shards = spark.read.parquet(f"{path}/shards")
    assert shards.where("doc_id = 30").select("shard").distinct().count() > 3 and shards.where("doc_id is null").select("shard").distinct().count() > 1
    got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r["start"])
    t, at = plain("byte_bpe_50k.json"), 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] or -1 for r in got] == sorted([d if d else -1 for d, _ in rows])
    want = sorted(np.array(t.encode(x, add_special_tokens=False).ids + [2], "<u4").tobytes() for _, x in rows)
    assert sorted(bytes(r["ids"]) for r in got) == want


def test_files_of_no_documents(spark, tmp_path):
    path = f"file://{tmp_path}/e"
    token_files.write_token_files(docs(spark, []), path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    assert token_files.read_token_files(spark, path).count() == 0


def test_packing_against_plain_encoding(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack_documents(docs(spark), path, 1, 64).collect()
    t, got, want = plain("word_bpe_49k.json"), [], []
    for r in docs(spark).collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        want += [(r["doc_id"] or 0, i, at, len(own := ids[at : at + 64]), zlib.crc32(np.array(own, "<u4").tobytes())) for i, at in enumerate(range(0, len(ids), 64))]
    got = [(r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(got) == sorted(want)
    gapless([(r["sequence_id"], r["offset"], r["length"]) for r in rows], 64)
    assert packing.pack_documents(docs(spark, []), path, 1, 64).count() == 0


def gapless(rows, size):
    ends = {}
    for s, o, n in sorted(rows):
        assert ends.get(s, 0) == o and o + n <= size
        ends[s] = o + n
    return ends


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=25))
def test_best_two_fit_uses_each_piece_once(counts):
    used = {}
    for times, lengths in packing.best_two_fit(counts, 40):
        assert sum(lengths) <= 40
        for n in lengths:
            used[n] = used.get(n, 0) + times
    assert used == counts


def test_best_two_fit_swaps_for_a_tighter_pair():
    # 60 + 30 leaves 10; 25 and 15 in place of 30 leave nothing
    assert (1, [60, 25, 15]) in [(k, sorted(x, reverse=True)) for k, x in packing.best_two_fit({60: 1, 30: 1, 25: 1, 15: 1}, 100)]


def test_packing_is_near_the_bound():
    rng = np.random.default_rng(5)
    lengths, counts = np.unique(np.minimum(4096, rng.lognormal(6, 1, 20000).astype(int) + 1), return_counts=True)
    bins = sum(k for k, _ in packing.best_two_fit(dict(zip(lengths.tolist(), counts.tolist())), 4096))
    assert bins <= 1.002 * -(-int((lengths * counts).sum()) // 4096) + 1

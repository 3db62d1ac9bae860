"""Token counts, trie BPE, token files and packing beside the tokenizers library."""

import random
from collections import defaultdict

import pytest
from tokenizers import Tokenizer

from estatelens.llm import token_files
from estatelens.llm.byte_bpe import Encoder
from estatelens.llm.packing import cut, pack_documents, place, plan_layouts, sequences
from estatelens.llm.token_count import Counter, count_tokens
from estatelens.llm.trie_bpe import TrieEncoder, encode_documents
from tests.llm.brute import crc, sha

SIGNS = [
    "a", "b", " ", "  ", "\n", " \n", "\n\n", "<|endoftext|>", "<|startoftext|>", "é", "1", "23", ".", ",", "'s",
    "'ll", "\t", "\xa0", "日本", "!", "\x1c", "\x85", "🙂", " the", " of", "\r\n", "½", "tion", "ing", "AB", "İ", "é",
]


def made(seed, n, most=14):
    rng = random.Random(seed)
    return ["".join(rng.choices(SIGNS, k=rng.randint(0, most))) for _ in range(n)]


TEXTS = [None, "", " ", "\n\n", "<|endoftext|>", "x" * 5000, "word " * 3000, *made(1, 60), *made(2, 3, 4000)]


@pytest.fixture(scope="module")
def byte_bpe(vocabulary):
    return Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def word_bpe(vocabulary):
    return Tokenizer.from_file(vocabulary("word_bpe_49k.json"))


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def rows_with_repeats():
    rows = list(enumerate(TEXTS)) + [(None, "no id"), (3, TEXTS[3])]
    return rows


def test_encoders_agree_with_the_library(vocabulary, byte_bpe):
    path = vocabulary("byte_bpe_50k.json")
    quick, trie = Encoder(path), TrieEncoder(path)
    texts = made(5, 3000)
    for text, ids in zip(texts, trie.encode(texts)):
        want = ids_of(byte_bpe, text)
        assert quick.ids(text) == want and ids == want
        assert trie.decode(ids) == byte_bpe.decode(want, skip_special_tokens=False)


def test_token_counts(documents, vocabulary, word_bpe):
    df = documents(rows_with_repeats())
    for settings in ({}, {"chunk_chars": 40, "overlap_chars": 4}, {"chunk_chars": 1000, "overlap_chars": 30}):
        got = count_tokens(df, vocabulary("word_bpe_49k.json"), limit=100, **settings).collect()
        want = sorted(
            (str(d), len((t or "").encode()), n := len(ids_of(word_bpe, t)), n > 100) for d, t in rows_with_repeats()
        )
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


def test_overlaps_widen_where_there_is_no_white_space(vocabulary):
    counter = Counter(vocabulary("word_bpe_49k.json"))
    for text in ("x1" * 700, "ab " + "y-" * 500 + " c d", " ".join(made(9, 300))):
        tokens, chunks, widened = counter.of_huge(text, 50, 6)
        assert tokens == len(counter.encode(text).ids)
    assert counter.of_huge("x1" * 700, 50, 6)[2] > 0
    assert counter.of_huge("a bc de " * 400, 50, 20)[1] > 50


def test_trie_bpe_rows(documents, vocabulary, byte_bpe):
    df = documents(rows_with_repeats())
    got = encode_documents(df, vocabulary("byte_bpe_50k.json"), with_ids=True).collect()
    want = []
    for d, t in rows_with_repeats():
        ids = ids_of(byte_bpe, t)
        text = byte_bpe.decode(ids, skip_special_tokens=False)
        want.append((str(d), len(ids), sha(",".join(map(str, ids))), sha(text)))
        assert text == (t or "")
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    assert all(r.decoded == (dict(rows_with_repeats())[r.doc_id] or "") for r in got)


def test_token_files_round_trip(spark, documents, vocabulary, byte_bpe):
    rows = rows_with_repeats()
    folder = token_files.shared_folder(spark, "round-trip")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else all is one shard
    try:
        manifest = token_files.write_token_files(documents(rows), folder, vocabulary("byte_bpe_50k.json"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    got = sorted(token_files.read_token_files(spark, folder, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
    start = 0
    for r in got:
        want = [*ids_of(byte_bpe, dict(rows)[r.doc_id]), 0]
        assert (r.ids, r.n_tokens, r.start, r.ids_crc32) == (want, len(want), start, crc(want))
        start += len(want)
    assert len(manifest["shards"]) > 1 and manifest["shards"][0]["id_type"] == "<u2"


def test_files_need_a_mounted_folder():
    with pytest.raises(ValueError):
        token_files.mounted("viewfs://store/out")


@pytest.mark.parametrize("capacity", [16, 1024])
def test_packing(documents, vocabulary, byte_bpe, capacity):
    rows = rows_with_repeats()
    packed = pack_documents(documents(rows), vocabulary("byte_bpe_50k.json"), capacity, 2, with_ids=True)
    got = packed.collect()
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    for d, t in dict(rows).items():
        want = [*ids_of(byte_bpe, t), 2]
        parts = sorted(by_doc[d], key=lambda r: r.piece)
        if d != 3:  # given twice
            assert [i for r in parts for i in r.ids] == want
        for r in parts:
            assert want[r.start : r.start + r.length] == r.ids and r.ids_crc32 == crc(r.ids)
        first = want[: len(want) % capacity or min(len(want), capacity)]
        assert parts[0].length == len(first) and all(r.length == capacity for r in parts if r.piece)
    in_sequence = defaultdict(list)
    for r in got:
        in_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in in_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity and sum(n > capacity / 3 for _, n in parts) <= 2
    least = -(-sum(r.length for r in got) // capacity)
    assert len(in_sequence) <= 1.25 * least + 2
    whole = {r.sequence_id: r.ids for r in sequences(packed).collect()}
    assert sum(map(len, whole.values())) == sum(r.length for r in got)


def test_layouts_place_every_piece():
    rng = random.Random(3)
    for _ in range(200):
        capacity = rng.choice([5, 12, 64, 1024])
        counts = defaultdict(int)
        for _ in range(rng.randint(0, 60)):
            counts[rng.randint(1, capacity)] += rng.choice([1, 2, 3, 7, 123_457])
        placed = defaultdict(int)
        for gap, group in plan_layouts(counts, capacity).groups.items():
            for copies, contents in group:
                assert sum(n * k for n, k in contents) == capacity - gap
                for n, k in contents:
                    placed[n] += copies * k
        assert placed == counts


def test_cut_leaves_only_the_first_short():
    assert cut(0, 4) == [] and cut(3, 4) == [(0, 3)] and cut(4, 4) == [(0, 4)]
    assert cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_place_by_length(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([3, None, 0, 9, 2, 2, 5, 5, 1])], "id int, length long")
    got = {r.id: r for r in place(df, 5).collect()}
    assert all(got[i].sequence_id is None and got[i].offset is None for i in (1, 2, 3))
    assert len({got[i].sequence_id for i in (0, 4, 5, 6, 7, 8)}) == 4


def test_empty_tables(spark, documents, vocabulary):
    none = documents([(1, "x")]).where("doc_id > 1")
    path = vocabulary("byte_bpe_50k.json")
    assert count_tokens(none, vocabulary("word_bpe_49k.json")).count() == 0
    assert encode_documents(none, path).count() == 0
    assert pack_documents(none, path).count() == 0
    folder = token_files.shared_folder(spark, "none")
    token_files.write_token_files(none, folder, path)
    assert token_files.read_token_files(spark, folder).count() == 0

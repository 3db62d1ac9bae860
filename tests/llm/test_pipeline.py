"""The pipeline beside its stages done the plain way, and the queries beside their SQL."""

import os
from collections import defaultdict

import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from estatelens.llm import queries as llm
from tests.llm import brute
from tools.check_queries import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not there")


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names and sum(n.startswith("op") for n in llm.QUERIES) == 13
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "secret_scan", "packing"]


@pytest.mark.parametrize("name", sorted(llm.QUERIES))
def test_query(spark, name):
    ok, note = compare(spark, connect(SF), name, SF)
    assert ok, note


def test_pipeline(spark, vocabulary):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs = [(r.doc_id, r.source, r.text, r.lang) for r in table.collect()]
    good = brute.quality([d[:3] for d in docs])
    langs = {d: lang for d, _, _, lang in docs}
    rows = {d: (s, t) for (d, s, _, _), (_, _, _, kept, _, t) in zip(docs, good) if kept}
    texts = brute.line_dedup([(d, t) for d, (_, t) in rows.items()])
    groups = brute.near_groups(list(texts.items()), 5, 80)
    texts = {d: t for d, t in texts.items() if groups[d][1] == d}
    found = brute.secrets([(d, rows[d][0], langs[d], t) for d, t in texts.items()])
    texts = {d: brute.masked(texts[d], added) for d, _, added in found}
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = set()
    for d, t in texts.items():
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or min(len(ids), 1024)
        edges = [0, *range(first, len(ids) + 1, 1024)]
        for piece, (a, b) in enumerate(zip(edges, edges[1:])):
            want.add((d, piece, a, b - a, brute.crc(ids[a:b])))
    got = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    in_sequence = defaultdict(list)
    for r in got:
        in_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in in_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name

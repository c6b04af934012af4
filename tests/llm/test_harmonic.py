from __future__ import annotations

import random
import zlib
from collections import defaultdict

import pytest

from ledgerlens.llm import harmonic, queries
from ledgerlens.llm.tokens import tokenizer_path
from tests.llm.helpers import awkward

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ids_of():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    own.encode_special_tokens = True
    return lambda text: [*own.encode(text or "", add_special_tokens=False).ids, 2]


def _check(rows, documents, capacity=4096):
    """rows: pieces. documents: (doc_id, ids). Every id in one piece, sequences gapless, no padding."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for row in rows:
        pieces[row["doc_id"]].append(row)
        sequences[row["sequence_id"]].append(row)
    expected = defaultdict(list)
    for doc_id, ids in documents:
        expected[doc_id].append(ids)
    assert pieces.keys() == expected.keys()
    for doc_id, copies in expected.items():
        assert len({tuple(c) for c in copies}) == 1  # as in the tables of these tests
        ids = copies[0]
        covered = [0] * len(ids)
        for row in pieces[doc_id]:
            part = ids[row["start"] : row["start"] + row["length"]]
            assert row["doc_tokens"] == len(ids) and len(part) == row["length"] > 0
            assert row["ids_crc32"] == zlib.crc32(b"".join(k.to_bytes(4, "little") for k in part))
            for k in range(row["start"], row["start"] + row["length"]):
                covered[k] += 1
        assert set(covered) == {len(copies)}
    for own in sequences.values():
        at = 0
        for row in sorted(own, key=lambda r: r["offset"]):
            assert row["offset"] == at
            at += row["length"]
        assert 0 < at <= capacity and at & (at - 1) == 0  # a full sequence or a power of two
    return sequences


def test_query_packs_every_id_without_padding(spark, ids_of):
    documents = [(r["doc_id"], ids_of(r["text"])) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.op12_harmonic_packing(spark, SF).collect()
    sequences = _check(rows, documents)
    total = sum(len(ids) for _, ids in documents)
    assert len(sequences) <= -(-total // 4096) + 12
    assert len(rows) <= len(documents) + len(sequences)  # one cut a sequence at most


def test_awkward_rows(spark, ids_of):
    docs = awkward(spark)
    documents = [(r["doc_id"], ids_of(r["text"])) for r in docs.select("doc_id", "text").collect()]
    _check(harmonic.pack_documents(docs).collect(), documents)
    assert harmonic.pack_documents(docs.limit(0)).collect() == []


def test_classes_take_a_fixed_number_of_items():
    rng = random.Random(5)
    for k, capacity in ((1, 64), (3, 64), (7, 256)):
        bins = harmonic.HarmonicBins(capacity, 16)
        low, high = capacity // (k + 1) + 1, capacity // k
        whole = [rng.randint(low, high) for _ in range(200)]
        placed = [p for n, size in enumerate(whole) for p in bins.add((n, 0, bytes(4 * size), size)) if p[1] == 0]
        counts = defaultdict(int)
        for piece in placed:
            counts[piece[5]] += piece[6] + piece[2] <= capacity
        # k items and the one that is cut, or that ends exactly there; sequences of rests hold no beginnings
        assert set(counts.values()) <= {k, k + 1} and counts


def test_rests_are_laid_end_to_end():
    bins = harmonic.HarmonicBins(64, 8)
    placed = []
    for n, size in enumerate([40, 21, 13, 5, 1, 1, 63, 130]):
        placed += bins.add((n, 0, bytes(4 * size), size))
    placed += bins.close()
    fills = defaultdict(int)
    for piece in placed:
        fills[piece[5]] += piece[2]
    assert sum(fills.values()) == 274 and sorted(fills.values(), reverse=True) == [64, 64, 64, 64, 16, 2]
    assert list(bins.close()) == []


def test_capacity_is_a_power_of_two(spark):
    with pytest.raises(ValueError):
        harmonic.pack_documents(awkward(spark), capacity=100)

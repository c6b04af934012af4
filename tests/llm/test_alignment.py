from __future__ import annotations

import functools
import hashlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import alignment, queries
from ledgerlens.llm.tokens import BYTE_CHARACTERS, tokenizer_path
from tests.llm.helpers import awkward, docs_frame

SF = "/root/testdata/sf0.001"
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def brute():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    byte_of = {code: byte for byte, code in BYTE_CHARACTERS.items()}

    def ends(parts):
        return [sum(map(len, parts[: k + 1])) for k in range(len(parts))] if len(parts) < 500 else list(_running(parts))

    def _running(parts):
        at = 0
        for part in parts:
            at += len(part)
            yield at

    def one(text):
        if not text:
            return None
        coded = a.encode(" " + text, add_special_tokens=False)
        a_ids, b_ids = coded.ids, b.encode(text)
        a_parts = [bytes(byte_of.get(ord(c), ord(c) & 255) for c in token) for token in coded.tokens]
        b_parts = [bytes([int(b.id_to_piece(k)[1:-1], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in b_ids]
        if not b"".join(a_parts) == b"".join(b_parts) == (" " + text).encode():
            return None
        a_ends, b_ends = ends(a_parts), ends(b_parts)
        links, groups, i, j, i0, j0 = [], [], 0, 0, 0, 0
        while i < len(a_ids):
            links.append((a_ids[i], b_ids[j]))
            x, y = a_ends[i], b_ends[j]
            i, j = i + (x <= y), j + (y <= x)
            if x == y:
                groups.append(",".join(map(str, a_ids[i0:i])) + "|" + ",".join(map(str, b_ids[j0:j])))
                i0, j0 = i, j
        return len(a_ids), len(b_ids), len(groups), links, ";".join(groups)

    def corpus(texts):
        rows = [one(text) for text in texts]
        holders, most = Counter(), defaultdict(int)
        for row in rows:
            holders.update(set(row[3]) if row else ())
        for (left, _), n in holders.items():
            most[left] = max(most[left], n)
        out = []
        for row in rows:
            if row is None:
                out.append((0, 0, 0, 0, 0, 0, ""))
                continue
            best = sum(holders[link] == most[link[0]] for link in row[3])
            out.append((*row[:3], len(row[3]), best, sum(holders[link] for link in row[3]), hashlib.sha256(row[4].encode()).hexdigest()))
        return out

    return corpus


def _rows(frame):
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0, *(r[c] for c in COLUMNS)) for r in frame.collect())


def _expected(brute, rows):
    return sorted((doc_id is not None, doc_id or 0, *found) for (doc_id, _), found in zip(rows, brute([text for _, text in rows]), strict=True))


def test_query_against_brute_force(spark, brute):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert _rows(queries.op11_alignment(spark, SF)) == _expected(brute, rows)


def test_small_ranges_and_blocks_give_the_same(spark, brute):
    """Ranges of 100 bytes end inside words and tokens; blocks of 300 links."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(40)
    docs = docs.unionByName(docs_frame(spark, [(9001, "é" * 400 + " ab " + "日本語テキスト" * 50), (9002, "word\n\n  next\tline " * 60), (9003, "x" * 900)]).select("doc_id", "text")).cache()
    rows = [tuple(r) for r in docs.collect()]
    assert _rows(alignment.align_documents(docs, chunk_bytes=100, block_links=300)) == _expected(brute, rows)
    docs.unpersist()


def test_awkward_rows(spark, brute):
    docs = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert _rows(alignment.align_documents(docs)) == _expected(brute, rows)
    assert alignment.align_documents(docs.limit(0)).collect() == []


def test_texts_that_are_not_given_back(spark):
    """The piece tokenizer reads U+2581 as a space, in a short text and in one range of a long one."""
    long = "plain words here " * 20
    out = alignment.align_documents(docs_frame(spark, [(1, "a ▁ b"), (2, long + "▁" + long), (3, "fine")]), chunk_bytes=100)
    found = {r["doc_id"]: r["groups_sha256"] for r in out.collect()}
    assert found[1] == found[2] == "" and len(found[3]) == 64


@settings(max_examples=150, deadline=None)
@given(text=st.text(st.sampled_from("ab Z'é\n\t.,日 1x"), min_size=1, max_size=80), places=st.lists(st.integers(1, 200), max_size=5), data=st.data())
def test_composition_is_associative(text, places, data):
    own = alignment.aligner("byte_bpe_50k.json", "piece_bpe_32k.model")
    window = " " + text
    size = len(window.encode())
    cuts = [0, *sorted({p for p in places if p < size}), size]
    parts = [own.chunk(window, *pair) for pair in zip(cuts, cuts[1:], strict=False)]
    expected = own.whole(own.chunk(window, 0, size))
    left = functools.reduce(own.compose, parts, alignment.Fragment())
    right = functools.reduce(lambda done, part: own.compose(part, done), reversed(parts), alignment.Fragment())
    at = data.draw(st.integers(0, len(parts)))
    both = own.compose(functools.reduce(own.compose, parts[:at], alignment.Fragment()), functools.reduce(own.compose, parts[at:], alignment.Fragment()))
    assert own.whole(left) == own.whole(right) == own.whole(both) == expected


def test_ranges_cover_all_bytes():
    data = (" some words " * 40 + "y" * 9000 + " end of it " * 30).encode()
    ranges = alignment.byte_ranges(data, 64, 32)
    assert ranges[0][0] == 0 and ranges[-1][1] == len(data)
    assert all(a[1] == b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    assert any(data[end - 1 : end].isalpha() and data[end : end + 1].isalpha() for _, end, _, _ in ranges[:-1])


def test_words_keep_their_groups_over_generations_of_the_memo(brute):
    """Every call but the first begins a new generation; a block goes on over them."""
    own = alignment.Aligner("byte_bpe_50k.json", "piece_bpe_32k.model", memo_limit=2)
    texts = [" one two, three", " two one five", " one two, three", " été three\nsix", " a ▁ b", " one"]
    block, listed = alignment.Block(0, own.dtype), []
    for text in texts:
        (numbers,) = own.numbers([alignment.split_words(text)])
        expected = [own._groups(w, own.a.whole.encode(w, add_special_tokens=False).ids, own.b.encode("\n" + w)[2:]) for w in alignment.split_words(text)]
        assert [own.words.groups[k] for k in numbers] == expected
        if None in expected:
            assert not own.sums[numbers, 2].all()
            continue
        pairs = b"".join(groups[4] for groups in expected)
        assert own.sums[numbers].sum(axis=0).tolist() == [*(sum(g[k] for g in expected) for k in range(3)), len(pairs)]
        listed.append((block.add(own, alignment.np.array(numbers), len(pairs)), pairs))
    assert own.generation > 2
    for numbers, pairs in listed:
        assert b"".join(block.parts[k] for k in alignment.np.frombuffer(numbers, "<u4")) == pairs

"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, and which token ids overlap.

A part of a text's bytes yields a fragment: the tokens that end in it, as an open prefix (up to the first place where tokens of
both end), closed groups, and an open suffix (after the last such place). Fragments of neighbouring parts compose: the left suffix and
the right prefix close a group. Composition is associative and has an identity, so a very long document is cut into byte
ranges, each a row of its own; their fragments are made by different tasks and reduced in a tree of Spark rounds.

A word (up to a non-space before a space) ends tokens of both tokenizers, so it is a fragment without open ends and is
remembered. Documents are gathered in blocks of bounded size that list their words once. How many documents hold a pair of
ids is summed over the blocks; the pairs of a block get their counts by a join, and its documents are priced from these.
"""

from __future__ import annotations

import array
import functools
import hashlib
import itertools
import re
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialize, texts
from ledgerlens.llm.tokens import BYTE_CHARACTERS, SPACES, WordEncoder, tokenizer_path

#: Longer texts are cut into byte ranges of this length.
CHUNK_BYTES = 32_768
#: A range may end anywhere if a word's end is this near on both sides; else it is moved to the next one.
REACH = 4096
#: Links of the documents of a block, which bound what a task holds.
BLOCK_LINKS = 8_000_000
#: Fragments composed into one per round.
FAN_IN = 16

#: Between words for both tokenizers: before a space, and around a line feed between non-spaces. Every white space of Unicode counts
#: as such for Python.
WORD_END = re.compile(r"(?<=\S)(?= |\n\S)|(?<=\S\n)(?=\S)")
#: The same parts of a text without the marks: white space other than spaces and line feeds, or two in a row.
PLAIN_WORD = re.compile(r" ?[^ \n]+|[ \n]")
MARKS = ("  ", " \n", "\n ", "\n\n", *(chr(code) for code in (*SPACES, *range(0x1C, 0x20)) if code not in (0x20, 0x0A)))
ASCII_MARKS = tuple(mark for mark in MARKS if mark.isascii())
#: Before a space in UTF-8, after ASCII only, so that any byte offset can be tested.
BYTE_WORD_END = re.compile(rb"(?<=[!-~])(?= )")


def split_words(text: str) -> list[str]:
    if any(mark in text for mark in (ASCII_MARKS if text.isascii() else MARKS)):
        return WORD_END.split(text)
    return PLAIN_WORD.findall(text)


class Tokens(NamedTuple):
    """Tokens of both tokenizers in a row: ids and lengths in bytes."""

    a: tuple[int, ...] = ()
    a_lengths: tuple[int, ...] = ()
    b: tuple[int, ...] = ()
    b_lengths: tuple[int, ...] = ()

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(*(mine + others for mine, others in zip(self, other, strict=True)))


class Closed(NamedTuple):
    """Closed groups: how many tokens and groups, the groups as text, the linked id pairs in order as packed numbers."""

    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    text: str = ""
    pairs: bytes = b""

    def __add__(self, other: Closed) -> Closed:
        text = f"{self.text};{other.text}" if self.text and other.text else self.text or other.text
        return Closed(self.n_a + other.n_a, self.n_b + other.n_b, self.n_groups + other.n_groups, text, self.pairs + other.pairs)


@dataclass(frozen=True)
class Fragment:
    """Without a cut all tokens are in the prefix. With one, an empty prefix means that the part begins at a cut."""

    ok: bool = True
    cut: bool = False
    prefix: Tokens = Tokens()
    closed: Closed = Closed()
    suffix: Tokens = Tokens()


def group(tokens: Tokens, pair_base: int, dtype: np.dtype) -> Closed:
    """Tokens that begin and end together as one group. Every stretch between two ends, of either tokenizer, is a link."""
    if not tokens.a and not tokens.b:
        return Closed()
    pairs, i, j, a_left, b_left = [], 0, 0, 0, 0
    while i < len(tokens.a) and j < len(tokens.b):
        a_left, b_left = a_left or tokens.a_lengths[i], b_left or tokens.b_lengths[j]
        pairs.append(tokens.a[i] * pair_base + tokens.b[j])
        step = min(a_left, b_left)
        a_left, b_left = a_left - step, b_left - step
        i, j = i + (not a_left), j + (not b_left)
    text = f"{','.join(map(str, tokens.a))}|{','.join(map(str, tokens.b))}"
    return Closed(len(tokens.a), len(tokens.b), 1, text, np.array(pairs, dtype).tobytes())


class _Words(dict):
    """Words by the number of their groups, of two generations: used words come back from the one before. `new` have no groups yet."""

    def __init__(self, old: _Words | None):
        super().__init__()
        self.groups: list[tuple | None] = []
        self.new: dict[str, int] = {}
        if old is not None:
            # Not the one before that.
            old.old, old.old_groups = {}, []
        self.old, self.old_groups = (old, old.groups) if old is not None else ({}, [])

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self.groups)
        known = dict.get(self.old, word)
        if known is None:
            self.new[word] = number
            self.groups.append(None)
        else:
            self.groups.append(self.old_groups[known])
        return number


class Aligner:
    """Both tokenizers, and the words seen. Special tokens' strings are ordinary text."""

    def __init__(self, byte_tokenizer: str, piece_tokenizer: str, memo_limit: int = 200_000):
        import sentencepiece

        # Its memo is small, because words are remembered here.
        self.a = WordEncoder(byte_tokenizer, 250_000)
        self.b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(piece_tokenizer))
        byte_of = {code: byte for byte, code in BYTE_CHARACTERS.items()}
        names = {number: name for name, number in self.a.whole.get_vocab(with_added_tokens=False).items()}
        self.a_bytes = [bytes(byte_of.get(ord(c), ord(c) & 255) for c in names.get(k, "")) for k in range(max(names) + 1)]
        self.b_bytes = []
        for number in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(number)
            if "▁" in piece.lstrip("▁") or "\n" in piece:
                raise ValueError(f"pieces of {piece_tokenizer} cross words")
            self.b_bytes.append(bytes([int(piece[1:-1], 16)]) if self.b.is_byte(number) else piece.replace("▁", " ").encode())
        self.pair_base = len(self.b_bytes)
        self.a_lengths, self.b_lengths = [len(part) for part in self.a_bytes], [len(part) for part in self.b_bytes]
        self.names = [str(k) for k in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.typecode = "I" if len(self.a_bytes) * self.pair_base <= 1 << 32 else "q"
        self.dtype = np.dtype(self.typecode)
        self.memo_limit, self.generation = memo_limit, 0
        self.words, self.sums, self.summed = _Words(None), np.zeros((4096, 4), np.int32), 0

    def tokens(self, word: str) -> tuple[bool, Tokens]:
        """Tokens of a text that begins and ends between words, and whether both give back its bytes."""
        a = np.frombuffer(self.a.unit(word), "<u4").tolist()
        # A line feed is a piece of its own; the space that is put before it goes with it.
        b = self.b.encode("\n" + word)[2:]
        return self._exact(word, a, b), Tokens(tuple(a), tuple(self.a_lengths[k] for k in a), tuple(b), tuple(self.b_lengths[k] for k in b))

    def _exact(self, word: str, a: list[int], b: list[int]) -> bool:
        return b"".join([self.a_bytes[k] for k in a]) == b"".join([self.b_bytes[k] for k in b]) == word.encode()

    def numbers(self, texts_words: list[list[str]]) -> list[list[int]]:
        """The number of every word of some texts, by which `groups` and `sums` know it until the next call."""
        if len(self.words) > self.memo_limit:
            self.words, self.summed, self.generation = _Words(self.words), 0, self.generation + 1
        found = [list(map(self.words.__getitem__, words)) for words in texts_words]
        groups, new = self.words.groups, self.words.new
        names = list(new)
        for word, b in zip(names, self.b.encode(["\n" + word for word in names], num_threads=1), strict=True):
            groups[new[word]] = self._groups(word, array.array("I", self.a.unit(word)), b[2:])
        new.clear()
        if len(groups) > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros((2 * len(groups) - len(self.sums), 4), np.int32)])
        if self.summed < len(groups):
            added = [(g[0], g[1], g[2], len(g[4])) if g else (0, 0, 0, 0) for g in groups[self.summed :]]
            self.sums[self.summed : len(groups)] = added
            self.summed = len(groups)
        return found

    def closed(self, words: list[str]) -> list[tuple | None]:
        """The groups of every word; None where the tokens do not give back the word's bytes."""
        (numbers,) = self.numbers([words])
        return [self.words.groups[k] for k in numbers]

    def _groups(self, word: str, a, b: list[int]) -> tuple | None:
        """group() of every group of a word, in one pass: a plain tuple of Closed, which garbage collection need not visit."""
        if not a or not b or not self._exact(word, a, b):
            return None
        a_lengths, b_lengths, base, names = self.a_lengths, self.b_lengths, self.pair_base, self.names
        pairs, out = [], []
        i = j = first_i = first_j = 0
        a_end, b_end = a_lengths[a[0]], b_lengths[b[0]]
        while True:
            pairs.append(a[i] * base + b[j])
            if a_end < b_end:
                i += 1
                a_end += a_lengths[a[i]]
            elif b_end < a_end:
                j += 1
                b_end += b_lengths[b[j]]
            else:
                i, j = i + 1, j + 1
                left = names[a[first_i]] if i == first_i + 1 else ",".join([names[k] for k in a[first_i:i]])
                right = names[b[first_j]] if j == first_j + 1 else ",".join([names[k] for k in b[first_j:j]])
                out.append(f"{left}|{right}")
                if i == len(a):
                    return i, j, len(out), ";".join(out), array.array(self.typecode, pairs).tobytes()
                first_i, first_j = i, j
                a_end += a_lengths[a[i]]
                b_end += b_lengths[b[j]]

    def fragment(self, tokens: Tokens, base: int, begin: int, end: int) -> Fragment:
        """The tokens, the first of which begin at base, that end after begin and not after end."""
        sides = []
        for ids, lengths in ((tokens.a, tokens.a_lengths), (tokens.b, tokens.b_lengths)):
            ends = (base + np.cumsum(lengths, dtype=np.int64)).tolist()
            sides.append([(at, k, n) for at, k, n in zip(ends, ids, lengths, strict=True) if begin < at <= end])
        cuts = sorted({at for at, _, _ in sides[0]} & {at for at, _, _ in sides[1]})
        runs, places = [], [0, 0]
        for cut in [*cuts, end + 1]:
            run = []
            for side, rows in enumerate(sides):
                start = places[side]
                while places[side] < len(rows) and rows[places[side]][0] <= cut:
                    places[side] += 1
                own = rows[start : places[side]]
                run += [tuple(k for _, k, _ in own), tuple(n for _, _, n in own)]
            runs.append(Tokens(*run))
        if not cuts:
            return Fragment(prefix=runs[0])
        closed = [group(run, self.pair_base, self.dtype) for run in runs[1:-1]]
        return Fragment(True, True, runs[0], joined(closed), runs[-1])

    def compose(self, left: Fragment, right: Fragment) -> Fragment:
        ok = left.ok and right.ok
        if not left.cut:
            if not right.cut:
                return Fragment(ok, False, left.prefix + right.prefix)
            return Fragment(ok, True, left.prefix + right.prefix, right.closed, right.suffix)
        if not right.cut:
            return Fragment(ok, True, left.prefix, left.closed, left.suffix + right.prefix)
        between = group(left.suffix + right.prefix, self.pair_base, self.dtype)
        return Fragment(ok, True, left.prefix, joined([left.closed, between, right.closed]), right.suffix)

    def chunk(self, window: str, begin: int, end: int) -> Fragment:
        """The fragment of bytes begin to end of a window that begins and ends between words."""
        out, base, run = Fragment(), 0, []

        def with_run(fragment: Fragment) -> Fragment:
            return self.compose(fragment, Fragment(True, True, closed=joined(run))) if run else fragment

        words = split_words(window)
        for word, known in zip(words, self.closed(words), strict=True):
            size = len(word.encode())
            if begin <= base and base + size <= end:
                if known is None:
                    return Fragment(ok=False)
                run.append(known)
            elif base + size > begin and base < end:
                ok, tokens = self.tokens(word)
                if not ok:
                    return Fragment(ok=False)
                out, run = self.compose(with_run(out), self.fragment(tokens, base, begin, end)), []
            base += size
        return with_run(out)

    def whole(self, fragment: Fragment) -> Closed | None:
        """A document's groups from its fragment; None if the tokens do not give back its bytes."""
        if not fragment.ok or any(fragment.suffix) or not fragment.cut and any(fragment.prefix):
            return None
        return joined([group(fragment.prefix, self.pair_base, self.dtype), fragment.closed])


def joined(parts: list[tuple]) -> Closed:
    """Their sum, at once."""
    parts = [part for part in parts if part[2]]
    if not parts:
        return Closed()
    n_a, n_b, n_groups, text, pairs = zip(*parts, strict=True)
    return Closed(sum(n_a), sum(n_b), sum(n_groups), ";".join(text), b"".join(pairs))


@functools.cache
def aligner(byte_tokenizer: str, piece_tokenizer: str) -> Aligner:
    """One per Python worker."""
    return Aligner(byte_tokenizer, piece_tokenizer)


def byte_ranges(data: bytes, size: int, reach: int = REACH) -> list[tuple[int, int, int, int]]:
    """(begin, end, begin and end of the window) of ranges of about size bytes. A window reaches to the ends of words."""

    def before(at: int) -> int | None:
        found = [m.start() for m in BYTE_WORD_END.finditer(data, max(0, at - reach), at + 1) if m.start() <= at]
        return found[-1] if found else None

    def after(at: int, limit: int) -> int | None:
        found = BYTE_WORD_END.search(data, at, min(len(data), limit))
        return found.start() if found else None

    cuts, at = [(0, 0, 0)], size  # place, word end before, word end after
    while at < len(data):
        left, right = before(at), after(at, at + reach)
        if left is None or right is None:
            left = right = at = after(at, len(data)) or len(data)
        if at < len(data):
            cuts.append((at, left, right))
        at += size
    cuts.append((len(data),) * 3)
    return [(begin, end, left, right) for (begin, left, _), (end, _, right) in zip(cuts, cuts[1:], strict=False)]


class Block:
    """Documents whose words are listed once; how many of them hold each pair."""

    def __init__(self, number: int, dtype: np.dtype):
        self.number, self.dtype = number, dtype
        self.parts: list[bytes] = []
        self.held: list[np.ndarray] = []
        self.links = 0
        # Where the words of the aligner's generation are listed; a word of two generations is listed twice.
        self.generation, self.places = -1, np.empty(0, np.int64)

    def add(self, own: Aligner, words: np.ndarray, links: int) -> bytes:
        """A text by its words' numbers. links: of all of them."""
        if self.generation != own.generation:
            self.generation, self.places = own.generation, np.full(len(own.sums), -1, np.int64)
        elif len(self.places) < len(own.sums):
            self.places = np.concatenate([self.places, np.full(len(own.sums) - len(self.places), -1, np.int64)])
        groups, distinct = own.words.groups, np.unique(words)
        pairs = [groups[k][4] for k in distinct.tolist()]
        new = np.flatnonzero(self.places[distinct] < 0)
        self.places[distinct[new]] = np.arange(len(self.parts), len(self.parts) + len(new))
        self.parts.extend([pairs[k] for k in new.tolist()])
        self._hold(pairs, links)
        return self.places[words].astype("<u4").tobytes()

    def add_whole(self, closed: Closed, links: int) -> bytes:
        """A text that is listed as one word."""
        self.parts.append(closed.pairs)
        self._hold([closed.pairs], links)
        return np.array([len(self.parts) - 1], "<u4").tobytes()

    def _hold(self, pairs: list[bytes], links: int) -> None:
        self.held.append(np.unique(np.frombuffer(b"".join(pairs), self.dtype)))
        self.links += links

    def row(self) -> dict:
        pairs, holders = np.unique(np.concatenate(self.held), return_counts=True) if self.held else ([], [])
        sizes = np.array([len(p) for p in self.parts], "<u4") // self.dtype.itemsize
        return {"block": self.number, "sizes": sizes.astype("<u4").tobytes(), "listed": b"".join(self.parts), "pairs": pairs, "holders": holders}


TOKENS = "array<array<int>>"
FRAGMENT = f"key long, doc_id long, chunk int, n_chunks int, ok boolean, cut boolean, prefix {TOKENS}, n_a long, n_b long, n_groups long, text string, pairs binary, suffix {TOKENS}"
DOCUMENT = "key long, doc_id long, block long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, words binary"
BLOCK = "sizes binary, listed binary, pairs array<long>, holders array<long>"
CHUNK = "chunk int, n_chunks int, window string, begin int, stop int"
ALIGNED = f"{DOCUMENT}, {BLOCK}, {CHUNK}"


def _batch(rows: list[dict], schema: str):
    """Rows as an Arrow batch; missing fields are null."""
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    kinds |= {"array<long>": pa.list_(pa.int64()), TOKENS: pa.list_(pa.list_(pa.int32()))}
    fields = [(name, kinds[kind]) for name, kind in (field.split() for field in schema.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array([row.get(n) for row in rows], type=t) for n, t in fields], names=[n for n, _ in fields])


def _first(above: int) -> int:
    """Where a task's numbers begin, which no other task has."""
    from pyspark import TaskContext

    return (above << 62) | (TaskContext.get().partitionId() << 36)


def _gathered(found, own: Aligner, above: int, block_links: int):
    """found: rows as they are to be returned, or (key, doc_id, numbers of the words or the closed groups of the whole, None where the
    text has no tokens). Batches of documents and of their blocks."""
    number, dtype = _first(above), own.dtype
    block, rows, size = Block(number, dtype), [], 0
    for one in found:
        if isinstance(one, dict):
            rows.append(one)
            size += len(one["window"])
        else:
            key, doc_id, held = one
            if held is None:
                n_a = n_b = n_groups = n_links = 0
                text, numbers = "", b""
            elif isinstance(held, Closed):
                n_a, n_b, n_groups, text, pairs = held
                n_links = len(pairs) // dtype.itemsize
                numbers = block.add_whole(held, n_links)
            else:
                words, groups = np.array(held), own.words.groups
                n_a, n_b, n_groups, n_links = own.sums[words].sum(axis=0, dtype=np.int64).tolist()
                n_links //= dtype.itemsize
                text = ";".join([groups[k][3] for k in held])
                numbers = block.add(own, words, n_links)
            sha = hashlib.sha256(text.encode()).hexdigest() if n_groups else ""
            counts = {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links}
            rows.append({"key": key, "doc_id": doc_id, "block": block.number, "groups_sha256": sha, "words": numbers, **counts})
            size += len(numbers)
        if size > 4_000_000 or len(rows) == 5000:
            yield _batch(rows, ALIGNED)
            rows, size = [], 0
        if block.links >= block_links:
            yield _batch([block.row()], ALIGNED)
            number += 1
            block = Block(number, dtype)
    yield _batch([*rows, block.row()], ALIGNED)


def _documents(docs: DataFrame, tokenizers: tuple[str, str], chunk_bytes: int, block_links: int) -> DataFrame:
    """Documents and blocks of short texts, byte ranges of long ones."""

    def aligned(batches):
        own = aligner(*tokenizers)
        key = _first(0)
        rows = texts(batches, ["doc_id", "text"], 200)
        while some := list(itertools.islice(rows, 200)):
            short = []
            for doc_id, text in some:
                key += 1
                text = " " + (text or "")
                data = text.encode() if 4 * len(text) > chunk_bytes else b""
                if len(data) <= chunk_bytes:
                    short.append((key, doc_id, split_words(text) if len(text) > 1 else []))
                    continue
                ranges = byte_ranges(data, chunk_bytes)
                for chunk, (begin, end, left, right) in enumerate(ranges):
                    yield {"key": key, "doc_id": doc_id, "chunk": chunk, "n_chunks": len(ranges), "window": data[left:right].decode(), "begin": begin - left, "stop": end - left}
            for (key_, doc_id, _), words in zip(short, own.numbers([words for _, _, words in short]), strict=True):
                yield key_, doc_id, words if words and own.sums[words, 2].all() else None

    def run(batches):
        yield from _gathered(aligned(batches), aligner(*tokenizers), 0, block_links)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ALIGNED)


def _fragment_row(key, doc_id, chunk, n_chunks, fragment: Fragment) -> dict:
    closed = fragment.closed._asdict()
    return {"key": key, "doc_id": doc_id, "chunk": chunk, "n_chunks": n_chunks, "ok": fragment.ok, "cut": fragment.cut, "prefix": fragment.prefix, "suffix": fragment.suffix, **closed}


def _fragment_of(row: dict) -> Fragment:
    ends = [Tokens(*(tuple(part) for part in row[name])) for name in ("prefix", "suffix")]
    return Fragment(row["ok"], row["cut"], ends[0], Closed(*(row[name] for name in Closed._fields)), ends[1])


def _long_documents(chunks: DataFrame, tokenizers: tuple[str, str], block_links: int, fan_in: int = FAN_IN) -> DataFrame:
    """Documents and blocks of the texts that were cut into byte ranges."""
    spark = chunks.sparkSession
    most = chunks.agg(F.max("n_chunks")).first()[0]
    if most is None:
        return spark.createDataFrame([], ALIGNED)

    def fragments(batches):
        own = aligner(*tokenizers)
        for key, doc_id, chunk, n_chunks, window, begin, stop in texts(batches, ["key", "doc_id", "chunk", "n_chunks", "window", "begin", "stop"], 50):
            yield _batch([_fragment_row(key, doc_id, chunk, n_chunks, own.chunk(window, begin, stop))], FRAGMENT)

    def composed(table):
        import pyarrow as pa

        own = aligner(*tokenizers)
        rows = sorted(table.to_pylist(), key=lambda row: row["chunk"])
        whole = functools.reduce(own.compose, map(_fragment_of, rows))
        first = rows[0]
        row = _fragment_row(first["key"], first["doc_id"], first["chunk"] // fan_in, -(-first["n_chunks"] // fan_in), whole)
        return pa.Table.from_batches([_batch([row], FRAGMENT)])

    def documents(batches):
        own = aligner(*tokenizers)

        def found():
            for batch in batches:
                for at in range(batch.num_rows):
                    (row,) = batch.slice(at, 1).to_pylist()
                    closed = own.whole(_fragment_of(row))
                    yield row["key"], row["doc_id"], closed if closed and closed.n_groups else None

        yield from _gathered(found(), own, 1, block_links)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level = materialize(chunks.repartition(parts, "key", "chunk").mapInArrow(fragments, FRAGMENT), "fragments")
    while most > 1:
        level = level.groupBy("key", F.floor(F.col("chunk") / fan_in)).applyInArrow(composed, FRAGMENT)
        level = materialize(level, "fragments")
        most = -(-most // fan_in)
    return materialize(level.mapInArrow(documents, ALIGNED), "long-documents")


def align_documents(
    docs: DataFrame, byte_tokenizer: str = "byte_bpe_50k.json", piece_tokenizer: str = "piece_bpe_32k.model", chunk_bytes: int = CHUNK_BYTES, block_links: int = BLOCK_LINKS
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, a row for every row of docs.

    A text is read with a space before it. Null and empty texts, and texts that either tokenizer does not give back byte for byte,
    have no tokens: zeros and ''. Rows with a null or repeated doc_id are documents of their own, and each counts as one
    that holds its pairs. Pairs of one id with equal counts are all best. Other columns are ignored; an empty table gives an
    empty table.
    """
    tokenizers = (byte_tokenizer, piece_tokenizer)
    aligned = materialize(_documents(docs, tokenizers, chunk_bytes, block_links), "aligned")
    chunks = aligned.filter("chunk IS NOT NULL").select("key", "doc_id", *(field.split()[0] for field in CHUNK.split(", ")))
    long = _long_documents(chunks, tokenizers, block_links)
    rows = aligned.filter("chunk IS NULL").unionByName(long)
    held = rows.select("block", F.explode(F.arrays_zip("pairs", "holders")).alias("h")).select("block", F.col("h.pairs").alias("pair"), F.col("h.holders").alias("n"))
    counts = materialize(held.groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    own = aligner(*tokenizers)
    a = F.expr(f"pair div {own.pair_base}")
    # One row per id of the first tokenizer at most.
    best = counts.groupBy(a.alias("a")).agg(F.max("count").alias("most"))
    priced = counts.withColumn("a", a).join(F.broadcast(best), "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    prices = held.select(F.col("block").alias("of"), "pair").join(priced, "pair")
    own_rows = rows.select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "words", "sizes", "listed")
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    dtype = own.dtype

    def price(documents, table):
        import pyarrow as pa
        import pyarrow.compute as pc

        table = table.sort_by("pair")
        pair, count, best = (table.column(n).to_numpy() for n in ("pair", "count", "best"))
        listed = documents.filter(pc.is_valid(documents.column("sizes")))
        sizes = np.frombuffer(b"".join(listed.column("sizes").to_pylist()), "<u4").astype(np.int64)
        at = np.searchsorted(pair, np.frombuffer(b"".join(listed.column("listed").to_pylist()), dtype).astype(np.int64))
        ends = np.cumsum(sizes)
        sums = []
        for values in (best.astype(np.int64), count):
            total = np.concatenate([[0], np.cumsum(values[at])])
            sums.append(total[ends] - total[ends - sizes])
        documents = documents.filter(pc.is_null(documents.column("sizes")))
        words = [np.frombuffer(w, "<u4") for w in documents.column("words").to_pylist()]
        columns = {n: documents.column(n) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
        columns |= {name: pa.array([int(own[w].sum()) for w in words], pa.int64()) for name, own in zip(("n_best", "count_sum"), sums, strict=True)}
        return pa.table(columns | {"groups_sha256": documents.column("groups_sha256")})

    return own_rows.groupBy("block").cogroup(prices.groupBy("of")).applyInArrow(price, out)

"""Near-duplicates by b-bit MinHash.

Each text gets PERMUTATIONS minima over its distinct word shingles. Bands of whole minima are the candidate keys. Of every
minimum the two low bits are kept, packed into four 64-bit words; the share of equal two-bit values, corrected for chance
collisions, estimates the similarity by counting bits. Candidates above a safe estimate are decided on the full shingle sets.

A second sketch prunes without error: of SKETCH_BITS buckets, the parity of the number of shingles that fall into each. Two
sketches differ in at most as many bits as the sets differ in shingles.

Groups of any size: texts with equal sets are one class with one representative. Within a band, members are first compared with
one pivot only, so a group of copies needs a link per member, not one per pair; verified links are merged into components, and
pivots are drawn anew while much is unresolved and that helps. Then only members outside a band's largest component are compared
with the rest, and only across components. That leaves out no link between components. Both sketches are at hand where pairs are
made, so pairs that they rule out are never written or sent.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import ASCII_LOWER, materialize, texts

PERMUTATIONS, LOW_BITS = 128, 2
#: Chance that a linked pair shares no band, at most.
MISS = 1e-6
#: Standard deviations of the estimate a linked pair may lie below the threshold.
SAFE = 5.0
SKETCH_BITS = 512
#: Pairs left for the last comparison, per class and in all, at which it runs instead of another pivot: sketches of so many are
#: compared in less time than the signature of a text takes.
LEFT_PER_CLASS, LEFT_ALWAYS = 500, 1_000_000
MAX_PIVOTS = 12


def bands_for(threshold: float) -> tuple[int, int]:
    """(bands, rows): the most rows a band can have, and then the fewest bands, for linked pairs to be missed with a chance of MISS at most."""
    for rows in range(PERMUTATIONS, 0, -1):
        bands = int(np.ceil(np.log(MISS) / np.log1p(-(threshold**rows))))
        if bands * rows <= PERMUTATIONS:
            return bands, rows
    raise ValueError(f"threshold too low: {threshold}")


def least_estimate(threshold: float) -> float:
    """A linked pair's estimate is below this with a chance of about 1e-7."""
    chance = 1 / (1 << LOW_BITS)
    same = chance + (1 - chance) * threshold
    return threshold - SAFE * float(np.sqrt(same * (1 - same) / PERMUTATIONS)) / (1 - chance)


@functools.cache
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.Generator(np.random.PCG64(20240229))
    return draw.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


class Shingler:
    """Distinct shingle hashes of a text: A-Z lower-cased, words between ASCII white space."""

    def __init__(self, size: int, limit: int = 300_000):
        self.size, self.limit, self.memo = size, limit, {}

    def _word(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self.memo) >= self.limit:
            self.memo.clear()
        self.memo[word] = value
        return value

    def hashes(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint64)
        words = text.encode().lower().split()  # bytes: ASCII letters and white space only
        if not words:
            return np.zeros(0, np.uint64)
        get = self.memo.get
        ids = np.fromiter([get(w) or self._word(w) for w in words], np.uint64, len(words))
        size = min(self.size, len(ids))
        out = np.full(len(ids) - size + 1, size, np.uint64)
        for k in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - size + 1 + k]
            out ^= out >> np.uint64(29)
            out = out * np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(32)
        return np.unique(out)


def minima(hashes: np.ndarray) -> np.ndarray:
    """PERMUTATIONS minima of a non-empty set, 32 bits each."""
    factors, offsets = _multipliers()
    best = np.full(PERMUTATIONS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(hashes), 2048):
        part = hashes[at : at + 2048]
        values = ((part[None, :] * factors[:, None] + offsets[:, None]) >> np.uint64(32)).astype(np.uint32)
        np.minimum(best, values.min(axis=1), out=best)
    return best


def packed(best: np.ndarray) -> list[int]:
    """The two low bits of every minimum as four signed 64-bit words, 32 minima each."""
    low = (best & np.uint32(3)).astype(np.uint64).reshape(-1, 32)
    return (low << (2 * np.arange(32, dtype=np.uint64))).sum(axis=1, dtype=np.uint64).astype(np.int64).tolist()


def parities(hashes: np.ndarray) -> list[int]:
    """SKETCH_BITS parities of the counts of hashes per bucket, as signed 64-bit words."""
    counts = np.bincount((hashes * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64).tolist()


def band_keys(best: np.ndarray, bands: int, rows: int) -> list[int]:
    out = np.arange(1, bands + 1, dtype=np.uint64)
    grid = best[: bands * rows].reshape(bands, rows).astype(np.uint64)
    for k in range(rows):
        out = (out ^ grid[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out.astype(np.int64).tolist()


def estimate(left: str, right: str):
    """Collision-corrected similarity of two packed signatures, by counting bits."""
    equal = F.lit(PERMUTATIONS)
    for k in range(PERMUTATIONS * LOW_BITS // 64):
        other = F.col(left)[k].bitwiseXOR(F.col(right)[k])
        equal = equal - F.bit_count(other.bitwiseOR(F.shiftrightunsigned(other, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    chance = 1 / (1 << LOW_BITS)
    return (equal / PERMUTATIONS - chance) / (1 - chance)


def least_difference(left: str, right: str):
    """The sets differ in at least so many shingles: the bits in which their parities differ."""
    return sum((F.bit_count(F.col(left)[k].bitwiseXOR(F.col(right)[k])) for k in range(SKETCH_BITS // 64)), F.lit(0))


def signatures(docs: DataFrame, size: int, threshold: float) -> DataFrame:
    """doc_id, n_shingles, c1, c2 (128-bit hash of the set), sig, odd, keys; the last three null for empty sets."""
    bands, rows = bands_for(threshold)

    def sign(batches):
        import pyarrow as pa
        import xxhash

        shingler = Shingler(size)
        for batch in batches:
            out = {name: [] for name in OUT.names}
            for doc_id, text in texts([batch], ["doc_id", "text"], 200):
                hashes = shingler.hashes(text)
                whole = xxhash.xxh3_128_digest(hashes.tobytes())
                out["doc_id"].append(doc_id)
                out["n_shingles"].append(len(hashes))
                out["c1"].append(int.from_bytes(whole[:8], "little", signed=True))
                out["c2"].append(int.from_bytes(whole[8:], "little", signed=True))
                best = minima(hashes) if len(hashes) else None
                out["sig"].append(packed(best) if best is not None else None)
                out["odd"].append(parities(hashes) if best is not None else None)
                out["keys"].append(band_keys(best, bands, rows) if best is not None else None)
            yield pa.RecordBatch.from_pydict(out, schema=OUT)

    import pyarrow as pa

    LONGS = pa.list_(pa.int64())
    OUT = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("sig", LONGS), ("odd", LONGS), ("keys", LONGS)])
    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n_shingles long, c1 long, c2 long, sig array<long>, odd array<long>, keys array<long>")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """doc_id and its distinct shingle hashes."""

    def sets(batches):
        import pyarrow as pa

        shingler = Shingler(size)
        for batch in batches:
            ids, found = [], []
            for doc_id, text in texts([batch], ["doc_id", "text"], 100):
                ids.append(doc_id)
                found.append(shingler.hashes(text).astype(np.int64))
                if sum(map(len, found[-50:])) > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "shingles"])
                    ids, found = [], []
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(sets, "doc_id long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of doc_ids whose full sets are similar enough: 100 * intersection >= percent * union."""
    left, right = sets.toDF("a", "left"), sets.toDF("b", "right")
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("left", "right"))
    return both.filter(100 * shared >= percent * (F.size("left") + F.size("right") - shared)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) of every end of a link (a, b).

    Alternates a step that links every larger neighbour to the smallest one with a step that links every smaller neighbour to
    it, until every id is linked with one smaller id that has no smaller one; each round is a table in the shared folder.
    """

    def against_least(edges: DataFrame) -> DataFrame:
        """u, v with least: the smallest of u and all its neighbours v."""
        least = edges.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("least"))
        return edges.join(least, "u")

    def unfinished(edges: DataFrame) -> bool:
        ends = edges.selectExpr("u AS id", "1 AS up", "0 AS down").union(edges.selectExpr("v", "0", "1"))
        of_id = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return bool(of_id.agg(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0])

    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "links")
    while unfinished(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = against_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        small = against_least(large)
        small = small.select(F.explode(F.array("u", "v")).alias("u"), F.col("least").alias("v")).filter("u != v").distinct()
        edges = materialize(small, "links")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept per row of docs (doc_id, text).

    Linked are texts with 100 * intersection >= percent * union of their distinct size-word shingles; a text of fewer words is
    one shingle; texts without words are linked with nothing. component_id is the smallest doc_id reachable. Rows are expected to
    have a doc_id of their own: rows that repeat one are one node with their united links, and rows without one are left as they
    are (component_id null, kept).
    """
    threshold = percent / 100
    signed = materialize(signatures(docs, size, threshold), "signatures")
    usable = signed.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    # Equal sets, hence equal signatures: one representative, the smallest doc_id.
    same = [F.first(name).alias(name) for name in ("n_shingles", "sig", "odd", "keys")]
    classes = materialize(usable.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), *same), "classes")
    # h is a draw without ties: xxhash64 of one long is one-to-one. A band's first pivot is the member with the lowest h.
    keyed = classes.select("rep", "c1", "c2", F.xxhash64("rep").alias("h"), F.explode("keys").alias("key"))
    bounds = keyed.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")).filter("low < high")
    narrow = keyed.join(materialize(bounds.select("key", "low"), "bands"), "key")
    members = materialize(narrow.join(classes.select("c1", "c2", "n_shingles", "sig", "odd", "keys"), ["c1", "c2"]).drop("c1", "c2"), "band-members")
    involved = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = materialize(full_sets(docs.select("doc_id", "text").join(involved, "doc_id", "left_semi"), size), "shingle-sets")

    def compared(left: DataFrame, right: DataFrame, once=F.lit(True)) -> DataFrame:
        """Linked pairs (a, b) of different components within a band: those that neither sketch rules out, decided on full sets."""
        right = right.select("key", *(F.col(name).alias(f"{name}_b") for name in ("rep", "label", "n_shingles", "sig", "odd", "keys")))
        both = F.col("n_shingles") + F.col("n_shingles_b")
        # 100 * intersection >= percent * union, in terms of the difference.
        close = (100 + percent) * least_difference("odd", "odd_b") <= (100 - percent) * both
        near = (F.col("label") != F.col("label_b")) & close & (estimate("sig", "sig_b") >= least_estimate(threshold))
        ends = F.least("rep", "rep_b").alias("a"), F.greatest("rep", "rep_b").alias("b")
        pairs = left.join(right, "key").filter(near & once).select(*ends).distinct()
        return materialize(verified(materialize(pairs, "pairs"), sets, percent), "links")

    labelled = members.withColumn("label", F.col("rep"))
    pivots, links, before = labelled.filter("h = low"), None, None
    n_classes = classes.count()
    for turn in range(1, MAX_PIVOTS + 1):
        found = compared(labelled, pivots)
        links = found if links is None else links.unionByName(found)
        merged = components(links)
        links = merged.select(F.col("component").alias("a"), F.col("id").alias("b"))
        labelled = members.join(merged, members.rep == merged.id, "left").withColumn("label", F.coalesce("component", "rep")).drop("id", "component")
        labelled = materialize(labelled, "labelled")
        parts = labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
        tops = parts.groupBy("key").agg(F.sum("n").alias("all"), F.max(F.struct("n", "label")).alias("top")).filter("all > top.n")
        tops = materialize(tops.select("key", F.col("top.label").alias("top"), (F.col("all") * (F.col("all") - F.col("top.n"))).alias("left")), "largest-parts")
        left = tops.agg(F.sum("left")).first()[0] or 0
        if left <= max(LEFT_ALWAYS, LEFT_PER_CLASS * n_classes) or (before is not None and 2 * left > before):
            break
        before = left
        draw = labelled.select("key", F.xxhash64("rep", F.lit(turn)).alias("low")).groupBy("key").agg(F.min("low").alias("draw"))
        pivots = labelled.join(draw, "key").filter(F.xxhash64("rep", F.lit(turn)) == F.col("draw"))
    if left:
        outside = labelled.join(tops.select("key", "top"), "key").filter("label != top")
        # Pairs with a band's first pivot are decided. Of all bands a pair shares, the first one makes it, and in one order only.
        once = ((F.col("label_b") == F.col("top")) | (F.col("rep") < F.col("rep_b"))) & (F.array_intersect("keys", "keys_b")[0] == F.col("key"))
        merged = components(links.unionByName(compared(outside.filter("h != low"), labelled.filter("h != low"), once)))
    named = classes.join(merged, classes.rep == merged.id, "left").select("c1", "c2", F.coalesce("component", "rep").alias("component_id"))
    placed = signed.join(named, ["c1", "c2"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    placed = placed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))
    return placed.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

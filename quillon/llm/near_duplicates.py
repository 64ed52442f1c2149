"""Groups of records whose texts differ only by small edits.

The Hamming space is that of min-hash signatures over word shingles: two texts differ in a
position with probability one minus their similarity. The positions lie on a ring and are
cut into equal segments. By the pigeonring principle a pair within distance ``tau`` of each
other has a segment from which every chain of l consecutive segments differs in at most
``l * tau / segments`` positions. Index rows carry the content of a segment as key and a
four-bit digest of the thirty-two positions that follow it on the ring, so the join on the key
checks the chain budgets before a pair leaves the join. There it also holds the sizes of the
sets of shingles against each other, and the parities of their shingles over 512 bits: these
differ in no more places than the sets do, so only unlike pairs are dropped. Pairs that survive
meet the full Hamming check on the sets themselves, |A ^ B| <= (|A| + |B|)(1 - t)/(1 + t),
which is exactly Jaccard similarity >= t.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import textarrays as ta
from quillon.operators.components import connected_components
from quillon.runtime import discard, materialize

#: Ids up to this number (16 MB) are sent to all executors; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: The index is joined in up to so many parts, one for each so many texts.
PARTS = 9
PART_TEXTS = 16_384
_DIGEST = 32  # positions behind a segment whose digest a row carries, sixteen in a number
_CHAINS = tuple(f"chain{i}" for i in range(_DIGEST // 16))
_ODDS = 8  # numbers of 64 bits that tell of the shingles falling to each bit whether they are odd in number
_SET = ("size", *[f"odd{i}" for i in range(_ODDS)])


@dataclass(frozen=True)
class Ring:
    """The ring for a similarity threshold.

    ``width`` positions make a segment; there are so many segments that a pair exactly at the
    threshold shares none with probability ``miss`` at most (pairs above it far less).
    """

    threshold: float
    miss: float = 0.00002

    @property
    def width(self) -> int:
        return max(2, round(math.log(0.216) / math.log(self.threshold)))

    @property
    def segments(self) -> int:
        return math.ceil(math.log(self.miss) / math.log(1 - self.threshold**self.width))

    @property
    def positions(self) -> int:
        return self.width * self.segments

    @property
    def tau(self) -> int:
        """Largest signature distance allowed: that of a pair at the threshold, five deviations above the mean."""
        k, t = self.positions, self.threshold
        return min(k, math.ceil(k * (1 - t) + 5 * math.sqrt(k * t * (1 - t))))

    def budgets(self) -> list[tuple[int, int]]:
        """(positions behind the matching segment, differences allowed in them)."""
        ends = [p for p in range(self.width, _DIGEST, self.width)] + [_DIGEST]
        return [(p, math.floor((self.width + p) * self.tau / self.positions)) for p in ends]


def _shingles(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of every run of consecutive words, in order, repeats included."""
    codes = ta.map_codes(ta.lower_table(), ta.codes_of(texts))
    part = ta.look(ta.flags("isalnum"), codes)
    edge = np.diff(part.view(np.int8), prepend=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if start.size < words:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    values = ta.noise(codes[part])
    lengths = stop - start
    begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    word = ta.fingerprints(values, begin, lengths)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    owner = np.searchsorted(ends, start, side="right")
    n = start.size - words + 1
    mixed = np.zeros(n, dtype=np.uint64)
    for i in range(words):
        mixed = (mixed << np.uint64(7)) + (mixed >> np.uint64(57)) + word[i : i + n] * np.uint64(0x9E3779B97F4A7C15 + 2 * i)
    same = owner[:n] == owner[words - 1 :]
    return owner[:n][same], ta.mix64(mixed[same])


def _multipliers(n: int) -> np.ndarray:
    return (ta.mix64(np.arange(n, dtype=np.uint64) + np.uint64(77)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _signature(ring: Ring) -> np.dtype:
    """What the index holds of a text, as it lies in a binary value."""
    return np.dtype([("size", "<i4"), ("odd", "<u8", _ODDS), ("digest", "u1", ring.positions), ("keys", "<u4", ring.segments)])


def _signatures(ring: Ring, words: int):
    factors = _multipliers(ring.positions)
    width, segments, positions = ring.width, ring.segments, ring.positions

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            uids = batch.column(0).to_numpy()
            for first, texts in ta.blocks(batch.column(1)):
                # copies within a task are indexed once
                fresh = []
                for i, text in enumerate(texts):
                    uid = int(uids[first + i])
                    if text and uid not in seen:
                        if len(seen) < 1_000_000:
                            seen.add(uid)
                        fresh.append(i)
                owner, hashes = _shingles([texts[i] for i in fresh], words)
                if not owner.size:
                    continue
                begin = np.flatnonzero(np.diff(owner, prepend=-1))
                ids = uids[first + np.asarray(fresh)[owner[begin]]]
                out = np.zeros(begin.size, dtype=_signature(ring))
                short = (hashes >> np.uint64(32)).astype(np.uint32)
                least = np.empty((positions, begin.size), dtype=np.uint32)
                for k in range(positions):
                    np.minimum.reduceat(short * factors[k], begin, out=least[k])
                out["digest"] = (ta.mix64(least) & np.uint64(15)).astype(np.uint8).T
                for s in range(segments):
                    key = np.full(begin.size, s + 1, dtype=np.uint64)
                    for p in range(s * width, (s + 1) * width):
                        key = ta.mix64(key ^ least[p].astype(np.uint64))
                    out["keys"][:, s] = key >> np.uint64(32)
                owner, hashes, begin = _distinct(owner, hashes)
                out["size"] = np.diff(begin, append=owner.size)
                place = np.cumsum(np.diff(owner, prepend=owner[0]) > 0) * (64 * _ODDS) + (hashes % np.uint64(64 * _ODDS)).astype(np.int64)
                odd = np.bincount(place, minlength=begin.size * 64 * _ODDS).astype(np.uint8) & 1
                out["odd"] = np.packbits(odd, bitorder="little").view("<u8").reshape(begin.size, _ODDS)
                ends = np.arange(begin.size + 1, dtype=np.int32) * out.itemsize
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.Array.from_buffers(pa.binary(), begin.size, [None, pa.py_buffer(ends), pa.py_buffer(out)])], names=["uid", "signature"]
                )

    return rows


def _index_rows(ring: Ring, part: range):
    kind = _signature(ring)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            texts = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=kind)
            keys = np.empty((len(part), ids.size), dtype=np.uint64)
            chains = np.zeros((len(_CHAINS), len(part), ids.size), dtype=np.uint64)
            digest = texts["digest"].T.astype(np.uint64)
            for i, s in enumerate(part):
                keys[i] = texts["keys"][:, s] | np.uint64(s << 32)
                for j in range(_DIGEST):
                    chains[j // 16, i] |= digest[((s + 1) * ring.width + j) % ring.positions] << np.uint64(4 * (j % 16))
            sides = [ids, texts["size"].astype(np.int64), *np.ascontiguousarray(texts["odd"].T).view(np.int64)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x.ravel().view(np.int64)) for x in (keys, *chains)] + [pa.array(np.tile(x, len(part))) for x in sides],
                names=["key", *_CHAINS, "uid", *_SET],
            )

    return rows


def _distinct(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, hash) without repeats, in order, and where each text begins."""
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(owner.size, dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    owner, hashes = owner[new], hashes[new]
    return owner, hashes, np.flatnonzero(np.diff(owner, prepend=-1))


def _shingle_sets(words: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids = batch.column(0).to_numpy()
            for first, texts in ta.blocks(batch.column(1)):
                owner, hashes, begin = _distinct(*_shingles([t or "" for t in texts], words))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(uids[first + owner[begin]]),
                        pa.ListArray.from_arrays(pa.array(np.append(begin, owner.size).astype(np.int32)), pa.array(hashes.view(np.int64))),
                    ],
                    names=["uid", "shingles"],
                )

    return sets


def signatures(texts: DataFrame, ring: Ring, words: int) -> DataFrame:
    """(uid, signature) of every text, once however many tasks hold it."""
    return texts.mapInArrow(_signatures(ring, words), "uid bigint, signature binary").dropDuplicates(["uid"])


def candidate_pairs(texts: DataFrame, ring: Ring, words: int) -> DataFrame:
    """Distinct (uid_a, uid_b) of texts that share a segment, keep the chain budgets behind it and may be alike."""
    return pairs_of_part(signatures(texts, ring, words), ring, range(ring.segments)).distinct()


def pairs_of_part(index: DataFrame, ring: Ring, part: range) -> DataFrame:
    """The pairs of ``candidate_pairs`` that share a segment of ``part``; one that shares several may come again."""
    kinds = ", ".join(f"{c} bigint NOT NULL" for c in ("key", *_CHAINS, "uid", *_SET))
    rows = index.mapInArrow(_index_rows(ring, part), kinds).repartition("key")
    # a text becomes a row a segment, which the planner's size estimate does not know: never a broadcast
    side = lambda x: rows.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("uid", *_CHAINS, *_SET)]).hint("merge")
    a, b = side("a"), side("b")

    def differing(ahead: int):
        """How many of the next positions differ: one bit is left of each."""
        total = F.lit(0)
        for i, c in enumerate(_CHAINS):
            if (part := min(16, ahead - 16 * i)) > 0:
                x = F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))
                x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
                x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
                total += F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111 & ((1 << 4 * part) - 1))))
        return total

    viable = F.lit(True)
    for ahead, most in ring.budgets():
        if most < ahead:
            viable &= differing(ahead) <= most
    # neither the sizes nor the parities can differ in more than the sets do, so no similar pair is lost
    odd = F.lit(0)
    for c in _SET[1:]:
        odd += F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b")))
    total, apart = F.col("size_a") + F.col("size_b"), F.abs(F.col("size_a") - F.col("size_b"))
    viable &= _alike(apart, total, ring.threshold) & _alike(odd, total, ring.threshold)
    return a.join(b, "key").where((F.col("uid_a") < F.col("uid_b")) & viable).select("uid_a", "uid_b")


def _alike(differing, total, threshold: float):
    """Whether sets of ``total`` shingles that differ in so many are similar: exact in whole numbers."""
    t = Fraction(str(threshold))
    return differing * F.lit(t.denominator + t.numerator) <= total * F.lit(t.denominator - t.numerator)


def _indexed_pairs(texts: DataFrame, ring: Ring, words: int) -> DataFrame:
    """``candidate_pairs`` with a part of the segments at a time, whose rows leave the disk before the next."""
    index = materialize(signatures(texts, ring, words), "index", drop_shuffle=True)
    parts = max(1, min(PARTS, math.ceil(index.count() / PART_TEXTS)))
    ends = [ring.segments * i // parts for i in range(parts + 1)]
    found = [materialize(pairs_of_part(index, ring, range(*e)), "pairs", drop_shuffle=True) for e in pairwise(ends)]
    discard(index)
    return reduce(DataFrame.union, found).distinct()


def similar_texts(texts: DataFrame, threshold: float, words: int) -> DataFrame:
    """(uid_a, uid_b, shared, size_a, size_b) of different texts with similarity >= threshold."""
    ring = Ring(threshold)
    pairs = materialize(_indexed_pairs(texts, ring, words), "pairs", drop_shuffle=True)
    ids = materialize(pairs.select(F.explode(F.array("uid_a", "uid_b")).alias("uid")).distinct(), "ids", drop_shuffle=True)
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    # hashed by uid here, the sets serve both joins without another exchange; their size is unknown to the planner too
    sets = texts.join(wanted, "uid", "left_semi").mapInArrow(_shingle_sets(words), "uid bigint, shingles array<bigint>").dropDuplicates(["uid"]).hint("merge")
    joined = pairs.join(sets.select(F.col("uid").alias("uid_a"), F.col("shingles").alias("sa")), "uid_a").join(
        sets.select(F.col("uid").alias("uid_b"), F.col("shingles").alias("sb")), "uid_b"
    )
    sized = joined.select("uid_a", "uid_b", F.size(F.array_intersect("sa", "sb")).alias("shared"), F.size("sa").alias("size_a"), F.size("sb").alias("size_b"))
    total = F.col("size_a") + F.col("size_b")
    return sized.where(_alike(total - 2 * F.col("shared"), total, threshold))


def _texts(df: DataFrame, text: str) -> DataFrame:
    return df.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("uid"), F.col(text).alias("text"))


def _members(df: DataFrame, record_id: str, text: str, words: int) -> DataFrame:
    run, gap = r"[\p{L}\p{N}]+", r"[^\p{L}\p{N}]+"
    enough = F.col(text).rlike(gap.join([run] * words))
    kept = df.where(F.col(text).isNotNull() & F.col(record_id).isNotNull())
    return kept.select(F.xxhash64(text).alias("uid"), F.col(record_id).alias("rec"), enough.alias("enough")).distinct()


def similar_pairs(df: DataFrame, threshold: float = 0.8, words: int = 5, record_id: str = "chunk_id", text: str = "text") -> DataFrame:
    """Every pair of records, a < b, whose texts are at least ``threshold`` alike.

    Similarity is the share of distinct runs of ``words`` consecutive words that both texts
    have. Records of one and the same text are pairs as well; null texts or ids and texts of
    fewer words are similar to none; a repeated record counts once.
    """
    texts = _texts(df, text)
    members = materialize(_members(df, record_id, text, words), "members")
    links = similar_texts(texts, threshold, words).select("uid_a", "uid_b")
    ma = members.select(F.col("uid").alias("uid_a"), F.col("rec").alias("ra"))
    mb = members.select(F.col("uid").alias("uid_b"), F.col("rec").alias("rb"))
    across = links.join(ma, "uid_a").join(mb, "uid_b").where("ra <> rb").select("ra", "rb")
    copied = members.where("enough").groupBy("uid").agg(F.count("*").alias("n")).where("n > 1").select("uid")
    copies = members.join(copied, "uid", "left_semi")
    within = copies.select("uid", F.col("rec").alias("ra")).join(copies.select("uid", F.col("rec").alias("rb")), "uid").where("ra < rb").select("ra", "rb")
    ordered = across.select(F.least("ra", "rb").alias("ra"), F.greatest("ra", "rb").alias("rb")).unionByName(within)
    return ordered.distinct().select(F.col("ra").alias(f"{record_id}_a"), F.col("rb").alias(f"{record_id}_b"))


def duplicate_groups(df: DataFrame, threshold: float = 0.8, words: int = 5, record_id: str = "chunk_id", text: str = "text") -> DataFrame:
    """One row for each record: its group, its number of linked other texts and of copies.

    ``group_id`` is the least record id of the group, for a record like no other its own id.
    Copies of a text share one node, so they cost no pairs. Null texts stay alone; rows with a
    null id are left out; of a record with several texts the group is the least.
    """
    texts = _texts(df, text)
    members = materialize(_members(df, record_id, text, words), "members")
    links = materialize(similar_texts(texts, threshold, words).select("uid_a", "uid_b"), "similar")
    parts = connected_components(links, "uid_a", "uid_b")
    degree = links.select(F.explode(F.array("uid_a", "uid_b")).alias("uid")).groupBy("uid").agg(F.count("*").alias("links"))
    classes = members.groupBy("uid").agg(F.min("rec").alias("least_rec"), F.count("*").alias("copies"), F.max("enough").alias("enough"))
    classes = classes.join(parts.withColumnRenamed("node", "uid"), "uid", "left").join(degree, "uid", "left")
    # texts of too few words are alike to none, not even to their copies
    heads = classes.where("component IS NOT NULL").groupBy("component").agg(F.min("least_rec").alias("head"))
    classes = classes.join(heads, "component", "left")
    grouped = members.select("uid", "rec").join(classes, "uid").select(
        "rec",
        F.when(F.col("enough"), F.coalesce("head", "least_rec")).otherwise(F.col("rec")).alias("group_id"),
        F.coalesce("links", F.lit(0)).alias("links"),
        F.when(F.col("enough"), F.col("copies") - 1).otherwise(F.lit(0)).alias("copies"),
    )
    alone = df.where(F.col(record_id).isNotNull() & F.col(text).isNull()).select(
        F.col(record_id).alias("rec"), F.col(record_id).alias("group_id"), F.lit(0).cast("bigint").alias("links"), F.lit(0).cast("bigint").alias("copies")
    )
    every = grouped.unionByName(alone).groupBy("rec").agg(F.min("group_id").alias("group_id"), F.max("links").alias("links"), F.max("copies").alias("copies"))
    return every.withColumnRenamed("rec", record_id)

"""SimHash and MinHash over three-byte shingles of hex-aware bytes, their comparison, and leader clusters."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions.coerce import hex_aware, rounded
from sedimenta.functions.fixed import PRIME, hash_family
from sedimenta.operators.rowwise import KEYS, per_payload, zipped
from sedimenta.session import scratch

_A = np.array([a for a, _ in hash_family()], np.uint64)
_B = np.array([b for _, b in hash_family()], np.uint64)
_P = np.uint64(PRIME)


#: Hashes whose leaders are settled in a round.
ROUND = 8192


@lru_cache(maxsize=1 << 18)
def token_hash(shingle: bytes) -> int:
    """The first eight bytes of the md5 of a shingle's hex."""
    return int.from_bytes(hashlib.md5(shingle.hex().encode()).digest()[:8], "big")


def shingles_of(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, multiplicities) of the distinct shingles; under three bytes the whole is one."""
    if len(raw) < 3:
        return np.array([token_hash(raw)] if raw else [], np.uint64), np.ones(int(bool(raw)), np.int64)
    d = np.frombuffer(raw, np.uint8).astype(np.int64)
    keys, first, n = np.unique(d[:-2] << 16 | d[1:-1] << 8 | d[2:], return_index=True, return_counts=True)
    return np.array([token_hash(raw[i : i + 3]) for i in first.tolist()], np.uint64), n


_BITS = np.arange(64, dtype=np.uint64)


def simhash_of(raw: bytes) -> int:
    hashes, n = shingles_of(raw)
    if not len(hashes):
        return 0
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        bits = (hashes[at : at + 8192, None] >> _BITS & np.uint64(1)).astype(np.int64)
        votes += ((2 * bits - 1) * n[at : at + 8192, None]).sum(0)
    return sum(1 << i for i in np.flatnonzero(votes > 0).tolist())


def minhash_of(raw: bytes, permutations: int = 64) -> list[int]:
    """Least hash of each permutation, 2**32 - 1 at most; a.x is taken in 16-bit halves to stay in 64 bits."""
    hashes, _ = shingles_of(raw)
    if not len(hashes):
        return [0] * permutations
    k = min(permutations, 128)
    a, b, out = _A[:k], _B[:k], np.full(k, 2**32 - 1, np.uint64)
    low32 = np.unique(hashes & np.uint64(0xFFFFFFFF))
    for at in range(0, len(low32), 4096):
        x = low32[at : at + 4096, None]
        high = a * (x >> np.uint64(16)) % _P  # below 2**33, and so is b; a times 16 bits is below 2**49
        out = np.minimum(out, ((high * np.uint64(65536) + a * (x & np.uint64(65535)) + b) % _P).min(0))
    return out.tolist()


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _raw() -> Column:
    return hex_aware(F.col("payload"))


def simhash(df: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """simhash in hex and as a signed 64-bit number for bit operations."""
    return per_payload(df, _raw(), "simhash string, bits long", lambda r: (f"{(h := simhash_of(r)):016x}", signed(h)), keys)


def minhash(df: DataFrame, permutations: int = 64, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return per_payload(df, _raw(), "signature array<long>", lambda r: (minhash_of(r, permutations),), keys)


def minhash_rows(df: DataFrame, permutations: int = 32) -> DataFrame:
    return zipped(df, _raw(), "perm int, value long", lambda r: (list(range(permutations)), minhash_of(r, permutations)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def similarity(distance: Column, bits: int = 64) -> Column:
    return rounded(F.greatest(F.lit(0.0), 1 - distance / bits), 4)


def jaccard(a: Column, b: Column) -> Column:
    """Share of equal places, 0 for lists that are empty or differ in length."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), rounded(equal / F.size(a), 4)).otherwise(F.lit(0.0))


def compare(pairs: DataFrame, left: str = "left", right: str = "right", keys: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """Fingerprints and similarity of pairs of payloads."""
    both = pairs.select(*keys, F.array(hex_aware(F.col(left)), hex_aware(F.col(right))).alias("two"))

    def made(two: list[bytes]) -> tuple:
        a, b = simhash_of(two[0]), simhash_of(two[1])
        return f"{a:016x}", f"{b:016x}", signed(a), signed(b), minhash_of(two[0], 32), minhash_of(two[1], 32)

    prints = per_payload(both.where("two[0] is not null and two[1] is not null"), F.col("two"), "simhash string, other_simhash string, a long, b long, sa array<long>, sb array<long>", made, keys)
    d = hamming(F.col("a"), F.col("b"))
    return prints.select(*keys, "simhash", "other_simhash", d.alias("hamming_distance"), similarity(d).alias("simhash_similarity"), jaccard(F.col("sa"), F.col("sb")).alias("minhash_jaccard_similarity"))


def largest_distance(threshold: float) -> int:
    """The largest Hamming distance whose rounded similarity reaches threshold, -1 if none."""
    return max((d for d in range(65) if round(max(0.0, 1 - d / 64), 4) >= threshold), default=-1)


def cluster(payloads: DataFrame, order: str = "idx", threshold: float = 0.85, folder: str | None = None) -> DataFrame:
    """Leader clusters of payloads in order of a unique column: idx, cluster_id (from 1), leader, simhash and preview."""
    folder = folder or scratch(payloads.sparkSession, "cluster")
    made = lambda x: (signed(h := simhash_of(x["r"])), f"{h:016x}", x["p"])
    prints = per_payload(payloads.where(F.col(order).isNotNull() & F.col("payload").isNotNull()), F.struct(_raw().alias("r"), F.substring("payload", 1, 120).alias("p")), "bits long, simhash string, preview string", made, (order,))
    prints.write.parquet(f"{folder}/prints")
    prints = payloads.sparkSession.read.parquet(f"{folder}/prints")
    return cluster_prints(prints, order, threshold, folder).select(order, "cluster_id", "leader", "simhash", "preview")


class Leaders:
    """Leaders of a round in their order, and the first of them within a distance of each of many hashes.

    Two hashes within distance d differ in one bit at most in one of d // 2 + 1 bands, so a leader stands in a bucket of
    each band for its own value and for each value that is one bit away, and a hash looks into one bucket a band. Large
    distances leave bands too short to tell; then every leader is compared.
    """

    def __init__(self, bits: np.ndarray, firsts: np.ndarray, most: int):
        self.bits, self.firsts, self.most = bits, firsts, most
        self.bands = []
        n = max(most, 0) // 2 + 1
        cuts = [round(i * 64 / n) for i in range(n + 1)] if n <= 8 else []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi - lo > 20:  # few bands: buckets by a part of the band, which differs in one bit at most too
                hi = lo + 20
            wide = hi - lo
            part = (bits >> np.uint64(lo) & np.uint64((1 << wide) - 1)).astype(np.int64)
            place = np.concatenate([part, *(part ^ (1 << k) for k in range(wide))])
            who = np.tile(np.arange(len(bits)), 1 + wide)
            order = np.argsort(place, kind="stable")
            self.bands.append((lo, wide, np.searchsorted(place[order], np.arange((1 << wide) + 1)), who[order]))

    def first_of(self, bits: np.ndarray) -> np.ndarray:
        """The order of the first leader within the distance of each hash, and whether there is one."""
        best = np.full(len(bits), len(self.bits))
        for at in range(0, len(bits), 4096):
            some = bits[at : at + 4096]
            mine = best[at : at + 4096]
            if not self.bands:
                for k in range(0, len(self.bits), 1024):
                    near = np.bitwise_count(some[:, None] ^ self.bits[None, k : k + 1024]) <= self.most
                    np.minimum(mine, np.where(near.any(1), k + near.argmax(1), len(self.bits)), out=mine)
            for lo, wide, starts, who in self.bands:
                part = (some >> np.uint64(lo) & np.uint64((1 << wide) - 1)).astype(np.int64)
                n = starts[part + 1] - starts[part]
                row = np.repeat(np.arange(len(some)), n)
                leader = who[np.arange(n.sum()) + np.repeat(starts[part] - np.cumsum(n) + n, n)]
                near = np.bitwise_count(some[row] ^ self.bits[leader]) <= self.most
                np.minimum.at(mine, row[near], leader[near])
        return best


def leaders_of(bits: np.ndarray, most: int) -> np.ndarray:
    """Places of those hashes that lead, in order: each that's not within the distance of one before it that leads."""
    free, out = np.ones(len(bits), bool), []
    for i in range(len(bits)):
        if free[i]:
            out.append(i)
            free &= np.bitwise_count(bits ^ bits[i]) > most
    return np.array(out, np.int64)


def cluster_prints(prints: DataFrame, order: str = "idx", threshold: float = 0.85, folder: str | None = None) -> DataFrame:
    """prints (order, bits and more) with cluster_id and leader.

    A payload joins the first leader within the distance, else it leads. Equal hashes share their first. A round takes the
    ROUND first hashes that are left, settles who of them leads, and sends these leaders to all that are left: whoever is
    within the distance of one follows the first such and is done, since all earlier leaders have been met before. So
    pairs of followers are never made, what's broadcast is bounded, and large groups are done in their first round.
    """
    spark, most = prints.sparkSession, largest_distance(threshold)
    folder = folder or scratch(spark, "cluster")
    firsts = prints.groupBy("bits").agg(F.min(order).alias("first"))
    firsts.write.parquet(f"{folder}/left-0")
    left, done, k = spark.read.parquet(f"{folder}/left-0"), [], 0
    while some := left.orderBy("first").limit(ROUND).collect():
        k += 1
        bits = np.array([r.bits for r in some], np.int64).view(np.uint64)
        led = leaders_of(bits, most) if most >= 0 else np.arange(len(bits))
        shared = spark.sparkContext.broadcast((bits[led], np.array([some[i]["first"] for i in led], np.int64)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            bits, firsts = shared.value
            leaders = Leaders(bits, firsts, max(most, 0))
            known = np.append(firsts, 0)
            for batch in batches:
                found = leaders.first_of(np.asarray(batch.column(0)).view(np.uint64))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(known[found], mask=found == len(firsts))], names=["bits", "first", "leader"])

        left.mapInArrow(run, "bits long, first long, leader long").write.parquet(f"{folder}/met-{k}")
        met = spark.read.parquet(f"{folder}/met-{k}")
        done.append(f"{folder}/met-{k}")
        left = met.where("leader is null").select("bits", "first")
    if not done:
        done = [f"{folder}/met-0"]
        left.withColumn("leader", F.col("first")).write.parquet(done[0])
    of = spark.read.parquet(*done).where("leader is not null").select("bits", "leader")
    ranked = _ranks(of.select("leader").distinct(), folder)
    placed = of.join(ranked, "leader").select("bits", "leader", F.col("rank").alias("cluster_id"))
    return prints.join(placed, "bits")


def _ranks(leaders: DataFrame, folder: str) -> DataFrame:
    """Ranks of leaders from 1: counts of range partitions, then a place inside each."""
    leaders.repartitionByRange("leader").withColumn("part", F.spark_partition_id()).write.parquet(f"{folder}/parts")
    parts = leaders.sparkSession.read.parquet(f"{folder}/parts")
    counts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = parts.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("leader")))
    return inside.join(before, "part").select("leader", (F.col("before") + F.col("k")).cast("long").alias("rank"))


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), F.min("leader").alias("leader"))

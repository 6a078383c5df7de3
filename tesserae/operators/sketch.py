"""Neighbourhood sketches: MinHash and HyperLogLog registers, their propagation, and link features."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialised

PRIME = 2147483647


def minhash_of(idx: Column, perms: int) -> Column:
    """``perms`` values ((a * (idx + 1) + b) mod p), a and b from the permutation's number; portable."""
    return F.transform(F.sequence(F.lit(1).cast("long"), F.lit(perms).cast("long")), lambda k: ((k * 48271 + 11) * (idx + 1) + k * 16807) % PRIME)


def register_of(idx: Column, p: int) -> tuple[Column, Column]:
    """(register, rank) of a node: low p bits, and leading zeros of the other 31 - p bits plus 1."""
    h = (idx + 1) * 1103515245 % PRIME
    rest = F.floor(h / (1 << p)).cast("long")
    bits = F.length(F.bin(rest)) * (rest > 0).cast("int")
    return (h % (1 << p)).cast("long"), (F.lit(31 - p) - bits + 1).cast("int")


def neighbourhoods(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(idx, from): every node is fed by its in-neighbours and by itself."""
    return edges.select(F.col("dst").alias("idx"), F.col("src").alias("from")).union(nodes.select("idx", F.col("idx").alias("from"))).distinct()


def propagate(values: DataFrame, feeds: DataFrame, how: str) -> DataFrame:
    """(idx, pos, v) after one hop: elementwise min or max over what feeds each node."""
    pick = F.min if how == "min" else F.max
    return feeds.join(values.select(F.col("idx").alias("from"), "pos", "v"), "from").groupBy("idx", "pos").agg(pick("v").alias("v"))


def minhash_rows(nodes: DataFrame, perms: int) -> DataFrame:
    return nodes.select("idx", F.posexplode(minhash_of(F.col("idx"), perms)).alias("pos", "v"))


def hll_rows(nodes: DataFrame, p: int) -> DataFrame:
    register, rank = register_of(F.col("idx"), p)
    return nodes.select("idx", register.alias("pos"), rank.alias("v"))


def linear_count(registers: DataFrame, p: int) -> DataFrame:
    """(idx, card): m * ln(m / empty registers), or alpha m^2 / sum 2^-r where none is empty."""
    m = 1 << p
    alpha = 0.7213 / (1 + 1.079 / m)
    per = registers.groupBy("idx").agg(F.count("*").alias("used"), F.sum(F.pow(F.lit(2.0), -F.col("v"))).alias("s"))
    card = F.when(F.col("used") < m, m * F.log(m / (m - F.col("used")))).otherwise(alpha * m * m / F.col("s"))
    return per.select("idx", F.round(card, 6).alias("card"))


def jaccard_estimate(links: DataFrame, values: DataFrame, perms: int) -> DataFrame:
    """(u, v, jac): share of equal positions of the two signatures."""
    a, b = values.select(F.col("idx").alias("u"), "pos", F.col("v").alias("x")), values.select(F.col("idx").alias("v"), "pos", F.col("v").alias("y"))
    return links.join(a, "u").join(b, ["v", "pos"]).groupBy("u", "v").agg(F.round(F.sum((F.col("x") == F.col("y")).cast("int")) / perms, 6).alias("jac"))


def khop_sets(nodes: DataFrame, feeds: DataFrame, hops: int) -> DataFrame:
    """(idx, hop, member): exact sets that the sketches stand for, hops 1 .. hops."""
    front = nodes.select("idx", F.col("idx").alias("member"))
    out = None
    for k in range(1, hops + 1):
        front = materialised(feeds.join(front.select(F.col("idx").alias("from"), "member"), "from").select("idx", "member").distinct())
        step = front.withColumn("hop", F.lit(k))
        out = step if out is None else out.unionByName(step)
    return out


#: What each link feature starts from (i21: members within 2 hops of u and 1 of v; a1, b1: members within
#: 1 hop of u, of v) and the earlier features taken off it.  With 2 hops the last one takes the first off twice.
FEATURES = {
    1: [("i11", []), ("b1", [0]), ("a1", [0])],
    2: [("i11", []), ("i21", [0]), ("i12", [0]), ("i22", [0, 1, 2]), ("b1", [0, 1]), ("a1", [0, 2]), ("b2", [0, 1, 2, 3, 4]), ("a2", [0, 0, 1, 2, 3, 5])],
    3: [
        ("i11", []), ("i21", [0]), ("i12", [0]), ("i22", [0, 1, 2]), ("i31", [0, 1]), ("i13", [0, 2]), ("i32", [0, 1, 2, 3, 4]), ("i23", [0, 1, 2, 3, 5]), ("i33", [0, 1, 2, 3, 4, 5, 6, 7]),
        ("b1", [0, 1, 4]), ("a1", [0, 2, 5]), ("b2", [0, 1, 2, 3, 4, 6, 9]), ("a2", [0, 1, 2, 3, 4, 7, 10]), ("b3", [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 11]), ("a3", [0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12]),
    ],
}
#: Features set to 0 where the zero-one distances are not used.
ZERO_ONE = {1: [], 2: [4, 5], 3: [4, 5, 11, 12]}


def exact_counts(links: DataFrame, sets: DataFrame, hops: int) -> DataFrame:
    """Links (u, v) with a_i, b_j (sizes of the neighbourhoods of u and v) and i_ij (of their intersections).

    A member's hops are bits of one number, so that one join a side and one aggregate count all pairs of hops.
    """
    m = materialised(sets.groupBy("idx", "member").agg(F.bit_or(F.expr("shiftleft(1, hop)")).alias("bits")))
    has = lambda c, k: F.col(c).bitwiseAND(1 << k) > 0
    size = m.groupBy("idx").agg(*[F.count_if(has("bits", k)).alias(f"n{k}") for k in range(1, hops + 1)])
    out = links.select("u", "v")
    for name, c in (("u", "a"), ("v", "b")):
        out = out.join(size.select(F.col("idx").alias(name), *[F.col(f"n{k}").alias(f"{c}{k}") for k in range(1, hops + 1)]), name, "left")
    a, b = m.select(F.col("idx").alias("u"), "member", F.col("bits").alias("x")), m.select(F.col("idx").alias("v"), "member", F.col("bits").alias("y"))
    both = links.select("u", "v").join(a, "u").join(b, ["v", "member"]).groupBy("u", "v").agg(*[F.count_if(has("x", i) & has("y", j)).alias(f"i{i}{j}") for i in range(1, hops + 1) for j in range(1, hops + 1)])
    return out.join(both, ["u", "v"], "left").fillna(0)


#: The hops from u and from v that each link feature counts.
HOPS_OF = {
    1: [(1, 1), (0, 1), (1, 0)],
    2: [(1, 1), (2, 1), (1, 2), (2, 2), (0, 1), (1, 0), (0, 2), (2, 0)],
    3: [(1, 1), (2, 1), (1, 2), (2, 2), (3, 1), (1, 3), (3, 2), (2, 3), (3, 3), (0, 1), (1, 0), (0, 2), (2, 0), (0, 3), (3, 0)],
}


def labelled(found: DataFrame, hops: int) -> DataFrame:
    """Link features f0, f1, ... under names that tell their hops: f_1_1, f_2_1, ..."""
    return found.select("u", "v", *[F.col(f"f{k}").alias(f"f_{a}_{b}") for k, (a, b) in enumerate(HOPS_OF[hops])])


def features(counts: DataFrame, hops: int, zero_one: bool = True, floor: bool = True) -> DataFrame:
    """(u, v, f0, f1, ...): the link features of ``counts`` as linear combinations of its columns.

    Without ``zero_one`` the features of distances 0 and 1 are 0; ``floor`` lifts negative ones to 0.
    """
    weights: list[dict[str, int]] = []
    for start, less in FEATURES[hops]:
        w = {start: 1}
        for k in less:
            for name, x in weights[k].items():
                w[name] = w.get(name, 0) - x
        weights.append(w)
    out = []
    for k, w in enumerate(weights):
        f = sum((F.col(name) * x for name, x in sorted(w.items()) if x), F.lit(0))
        f = F.greatest(f, F.lit(0)) if floor else f
        out.append((f if zero_one or k not in ZERO_ONE[hops] else f * 0).alias(f"f{k}"))
    return counts.select("u", "v", *out)


def link_features(links: DataFrame, sets: DataFrame, hops: int, zero_one: bool = True, floor: bool = True) -> DataFrame:
    """``features`` of links (u, v) from exact sets, for 1, 2 or 3 hops."""
    return features(exact_counts(links, sets, hops), hops, zero_one, floor)


#: Alpha of 16, 32 and 64 registers, and the linear counts up to which these are trusted, for p from 4 on.
ALPHA = {4: 0.673, 5: 0.697, 6: 0.709}
THRESHOLDS = [10, 20, 40, 80, 220, 400, 900, 1800, 3100, 6500, 11500, 20000, 50000, 120000, 350000]


def raw_estimate(powers, p: int):
    """alpha m^2 over the sum of 2^-register."""
    m = 1 << p
    return ALPHA.get(p, 0.7213 / (1 + 1.079 / m)) * m * m / powers


def simulated_bias(p: int, points: int = 60, trials: int = 400, seed: int = 1) -> list[tuple[float, float]]:
    """(mean raw estimate, its bias) of random sets with up to 6m members; a table by simulation for ``hll_count``."""
    m, gen, out = 1 << p, np.random.default_rng(seed), []
    for n in np.unique(np.linspace(0, 6 * m, points).astype(int)):
        regs = np.zeros((trials, m), np.int64)
        np.maximum.at(regs, (np.repeat(np.arange(trials), n), gen.integers(0, m, trials * n)), gen.geometric(0.5, trials * n))
        mean = float(raw_estimate((0.5**regs).sum(1), p).mean())
        out.append((mean, mean - float(n)))
    return out


def hll_count(registers: Column, p: int, bias: list[tuple[float, float]] | None = None, threshold: float | None = None) -> Column:
    """Size of the set behind an array of 2^p registers.

    A linear count where a register is empty and the count is at most ``threshold``; else the raw estimate, and up
    to 5m that less the mean bias of the six nearest points of ``bias``.
    """
    m, limit = 1 << p, THRESHOLDS[p - 4] if threshold is None else threshold
    empty = F.size(F.filter(registers, lambda r: r == 0))
    linear = m * F.log(F.lit(float(m)) / F.nullif(empty, F.lit(0)))
    raw = raw_estimate(F.aggregate(registers, F.lit(0.0), lambda s, r: s + F.pow(F.lit(2.0), -r)), p)
    refined = raw
    if bias:
        table = F.array(*[F.struct(F.lit(e).alias("e"), F.lit(b).alias("b")) for e, b in bias])
        near = F.slice(F.array_sort(F.transform(table, lambda t: F.struct(F.pow(raw - t["e"], 2).alias("d"), t["b"].alias("b")))), 1, 6)
        refined = F.when(raw <= 5 * m, raw - F.aggregate(near, F.lit(0.0), lambda s, t: s + t["b"]) / min(6, len(bias))).otherwise(raw)
    return F.when(linear <= limit, linear).otherwise(refined)


def dense(rows: DataFrame, size: int, *keys: str) -> DataFrame:
    """(keys, values): rows (keys, pos, v) as one array of ``size`` values, 0 where there is no row."""
    at = F.map_from_entries(F.collect_list(F.struct("pos", "v")))
    return rows.withColumn("pos", F.col("pos").cast("int")).groupBy(*keys).agg(at.alias("at")).select(*keys, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("at", i), F.lit(0))).alias("values"))


def hop_sketches(values: DataFrame, feeds: DataFrame, hops: int, how: str) -> DataFrame:
    """(idx, hop, pos, v) for hops 1 .. hops."""
    out = None
    for k in range(1, hops + 1):
        values = propagate(values, feeds, how)
        step = values.withColumn("hop", F.lit(k))
        out = step if out is None else out.unionByName(step)
    return out


def sketched_counts(links: DataFrame, signatures: DataFrame, registers: DataFrame, hops: int, perms: int, p: int, bias: list[tuple[float, float]] | None = None) -> DataFrame:
    """The columns of ``exact_counts``, estimated: a share of equal signature positions times the size of a union."""
    sig, reg = (dense(rows, n, "idx", "hop").withColumnRenamed("values", name) for rows, n, name in ((signatures, perms, "sig"), (registers, 1 << p, "reg")))
    both = sig.join(reg, ["idx", "hop"]).groupBy("idx").agg(F.map_from_entries(F.collect_list(F.struct("hop", F.struct("sig", "reg")))).alias("of"))
    ends = links.select("u", "v").join(both.select(F.col("idx").alias("u"), F.col("of").alias("of_u")), "u").join(both.select(F.col("idx").alias("v"), F.col("of").alias("of_v")), "v")
    x = lambda side, k, what: F.try_element_at(f"of_{side}", F.lit(k))[what]
    cols = []
    for i in range(1, hops + 1):
        cols += [hll_count(x("u", i, "reg"), p, bias).alias(f"a{i}"), hll_count(x("v", i, "reg"), p, bias).alias(f"b{i}")]
        for j in range(1, hops + 1):
            same = F.size(F.filter(F.zip_with(x("u", i, "sig"), x("v", j, "sig"), lambda a, b: a == b), lambda t: t)) / perms
            cols.append((same * hll_count(F.zip_with(x("u", i, "reg"), x("v", j, "reg"), lambda a, b: F.greatest(a, b)), p, bias)).alias(f"i{i}{j}"))
    return ends.select("u", "v", *cols)


#: Fixed values of the 64-bit sketches: the modulus of the permutations, the mask of a MinHash value, hash bits.
MERSENNE, LOW_32, HASH_BITS = (1 << 61) - 1, (1 << 32) - 1, 64


def permutations(perms: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of each permutation, drawn in pairs from a seeded Mersenne Twister."""
    gen = np.random.RandomState(seed)
    drawn = [gen.randint(low, MERSENNE, dtype=np.uint64) for _ in range(perms) for low in (1, 0)]
    return np.array(drawn[::2], np.uint64), np.array(drawn[1::2], np.uint64)


def minhash_64(idx: Column, perms: int, seed: int = 1) -> Column:
    """``perms`` values ((a h + b) mod 2^61 - 1) & 2^32 - 1 in wrapping 64-bit arithmetic, h the hash of idx + 1."""
    a, b = permutations(perms, seed)

    @F.pandas_udf("array<long>")
    def values(x: pd.Series) -> pd.Series:
        h = pd.util.hash_array(x.to_numpy(np.int64) + 1)
        v = (a * h[:, None] + b) % np.uint64(MERSENNE) & np.uint64(LOW_32)
        return pd.Series(list(v.astype(np.int64)))

    return values(idx)


def register_64(idx: Column, p: int) -> Column:
    """struct(pos, v): low p bits of the hash of idx + 1, and its rank by a float logarithm over the other bits."""

    @F.pandas_udf("pos long, v int")
    def values(x: pd.Series) -> pd.DataFrame:
        h = pd.util.hash_array(x.to_numpy(np.int64) + 1)
        bits = np.ceil(np.log2((h >> np.uint64(p)) + np.uint64(1))).astype(int)
        return pd.DataFrame({"pos": (h & np.uint64((1 << p) - 1)).astype(np.int64), "v": (HASH_BITS - p - bits + 1).astype(np.int32)})

    return values(idx)

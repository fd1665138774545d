"""MinHash near-dedup: banded candidates, verified by odd sketches of the MinHash samples and then on full sets.

A document's set holds its distinct word shingles. Documents with equal sets are one class, stood for by its smallest
id. (1) Each class gets MinHash samples, cut into bands; classes that share a band are candidates. (2) In each band
bucket every class is paired with two leaders only, and each class keeps the leaders it shares most bands with, so a
bucket of n classes gives at most a few n pairs, which link most of each group. (3) Components between which a bucket still
holds a pair that sketches deem possible form a family. The sets of a family's classes are sent once, to one task or in
blocks, and all its pairs of different components are compared there, which are joined as soon as a link is found. A pair
within one component can't change the result, so no link is lost to the star of (2).

Every pair of (2) and (3) is verified by odd sketches first: a sketch folds the samples into a bitmap of parities, and
the population count of two bitmaps' XOR estimates the similarity precisely where it is high. Only pairs whose estimate
comes near the threshold are confirmed on full sets. With 30 bands of 5 samples a pair at similarity 0.8 shares no band
with probability 7e-6; the sketch's threshold lies more than four standard deviations below the linking one.

Defined results: a null, empty or blank text has an empty set, is linked with nothing and is its own component; repeated
rows belong to one class and all keep the component (kept is by id, so repeated rows of the smallest id all stay);
null ids make no class of their own and get the component of their class's smallest id (null if it has none; kept only then); an empty table gives an empty
result; columns besides the id and the text aren't read. Texts are read whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveline.llm.text import arrow_rows, free_name, keep_columns, ship_package, small_batches
from sieveline.operators.graph import connected_components
from sieveline.plans.lineage import cut, stored

BANDS, ROWS = 30, 5
SAMPLES = BANDS * ROWS
SKETCH_BITS = 1024
#: Similarity in percent from which documents are linked, and the sketch estimate from which a pair is confirmed.
THRESHOLD = 80
ESTIMATE_FROM = 0.64
#: Leaders a class is confirmed against at first.
LEADERS = 3
#: Classes of a bucket or family that meet in one task, and the shingles of their sets; more are dealt to parts, and each two
#: parts meet in one block.
BLOCK, BLOCK_SHINGLES = 2048, 2_000_000
#: Ids that may be broadcast; beyond that a join is shuffled.
BROADCAST_IDS = 400_000

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_RANDOM = np.random.default_rng(20240607)
FACTORS = _RANDOM.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RANDOM.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
FOLD = _RANDOM.integers(1, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint16)


def shingles(text: str | None, width: int) -> set[bytes]:
    """Distinct shingles of words in lower case (A-Z only); the whole sequence if there are fewer words."""
    words = WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if len(words) < width:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)))


def hashes_of(grams: set[bytes]) -> np.ndarray:
    out = np.fromiter(map(xxhash.xxh3_64_intdigest, grams), np.uint64, len(grams))
    out.sort()
    return out


def samples_of(hashes: np.ndarray) -> np.ndarray:
    out = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 512):
        np.minimum(out, (hashes[k : k + 512, None] * FACTORS + SHIFTS).min(axis=0), out=out)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def bands_of(samples: np.ndarray) -> np.ndarray:
    keys = (mixed(samples).reshape(BANDS, ROWS) * FOLD).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    return mixed(keys).view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity of the number of samples that fall on each bit, the sample's place being part of it."""
    at = mixed(samples + np.arange(SAMPLES, dtype=np.uint64) * FOLD[0]) % np.uint64(SKETCH_BITS)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8))


def estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarities by XOR population counts: 2 * SAMPLES * (1 - J) places differ, seen through collisions."""
    odd = POPCOUNT[one ^ many].sum(axis=1)
    share = np.minimum(2 * odd / SKETCH_BITS, 1 - 1e-9)
    return 1 - (-SKETCH_BITS / 2 * np.log(1 - share)) / (2 * SAMPLES)


def estimate(x: str, y: str) -> Column:
    """`estimates` of two columns of sketches."""
    odd = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, k: n + k)
    return 1 + SKETCH_BITS / 2 * F.ln(1 - F.least(2 * odd / SKETCH_BITS, F.lit(1 - 1e-9))) / (2 * SAMPLES)


def least_estimate(percent: int) -> float:
    return ESTIMATE_FROM - (THRESHOLD - percent) / 100


def sketches(documents: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set_key (null for an empty set), bands, sketch."""

    def describe(text: str | None) -> tuple:
        hashes = hashes_of(shingles(text, width))
        if not len(hashes):
            return 0, None, None, None
        samples = samples_of(hashes)
        key = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
        return len(hashes), key, bands_of(samples), odd_sketch(samples).view(np.int64)

    return arrow_rows(documents, "text", describe, "n_shingles bigint, set_key binary, bands array<bigint>, sketch array<bigint>")


def joined_ids(frame: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of the frame whose rep is among the ids; these are broadcast behind their count, so texts aren't shuffled."""
    return frame.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "rep", "left_semi")


def sets_of(documents: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """rep, n_shingles, sketch, hashes: the full sets of some documents, made again from their texts; each as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, bytes]] = set()  # a task sends copies of one id once
        for batch in batches:
            rows = []
            for rep, text in zip(batch.column("rep").to_pylist(), batch.column("text").to_pylist(), strict=True):
                hashes = hashes_of(shingles(text, width))
                key = rep, hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
                if len(hashes) and key not in seen:
                    seen.add(key)
                    rows.append((rep, len(hashes), odd_sketch(samples_of(hashes)).tobytes(), hashes.tobytes()))
            columns = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["rep", "n_shingles", "sketch", "hashes"])

    chosen = joined_ids(documents.select(F.col("doc_id").alias("rep"), "text"), ids)
    return chosen.mapInArrow(run, "rep bigint, n_shingles bigint, sketch binary, hashes binary")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. The member's set joins first: its ids don't repeat much."""
    left = sets.select(F.col("rep").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("rep").alias("b"), F.col("hashes").alias("y"))

    @F.arrow_udf("boolean")
    def alike(x: pa.Array, y: pa.Array) -> pa.Array:
        found = []
        for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True):
            p, q = np.frombuffer(p, np.int64), np.frombuffer(q, np.int64)
            common = len(np.intersect1d(p, q, assume_unique=True))
            found.append(100 * common >= percent * (len(p) + len(q) - common))
        return pa.array(found, pa.bool_())

    return pairs.join(left, "a").join(right, "b").where(alike("x", "y")).select("a", "b").distinct()


def sketched(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their sketches deem possible."""
    left, right = (classes.select(F.col("rep").alias(n), F.col("sketch").alias(s)) for n, s in (("a", "x"), ("b", "y")))
    return pairs.join(left, "a").join(right, "b").where(estimate("x", "y") >= least_estimate(percent)).select("a", "b")


def leader_pairs(banded: DataFrame) -> DataFrame:
    """banded: key, rep. Pairs (a, b), b one of the LEADERS that a shares most bands with."""
    shuffled = F.xxhash64("rep")
    leaders = banded.groupBy("key").agg(F.min("rep").alias("first"), F.min_by("rep", shuffled).alias("second"))
    met = banded.join(leaders, "key").select("rep", F.explode(F.array_distinct(F.array("first", "second"))).alias("leader")).where("rep <> leader")
    shared = met.groupBy("rep", "leader").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("rep").orderBy(F.desc("n"), "leader"))
    return shared.withColumn("rank", rank).where(F.col("rank") <= LEADERS).select(F.col("rep").alias("a"), F.col("leader").alias("b"))


def in_shared(banded: DataFrame) -> DataFrame:
    """key, rep: the rows of the buckets that hold more than one class. All bands are shuffled here, once."""
    whole = W.partitionBy("key")
    return banded.withColumns({"low": F.min("rep").over(whole), "high": F.max("rep").over(whole)}).where("low <> high").select("key", "rep").distinct()


def sharing(banded: DataFrame) -> DataFrame:
    """rep: the classes that share a band with another class, in a kept pair or not."""
    return in_shared(banded).select("rep").distinct()


def blocks(part: Column, parts: Column) -> Column:
    """The blocks that a row of a part goes to, so that each two parts meet in one: its meeting with each other part."""
    others = F.filter(F.sequence(F.lit(0), parts - 1), lambda r: (parts == 1) | (r != part))
    return F.transform(others, lambda r: F.least(r, part) * parts + F.greatest(r, part))


def in_blocks(rows: DataFrame, link: Callable[[dict[str, list]], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """a, b: what `link` finds in the rows of each (key, part, parts), dealt to blocks: a column's values of a block by its name."""
    names = [c for c in rows.columns if c not in ("key", "part", "parts")]
    dealt = rows.select("key", F.explode(blocks(F.col("part"), F.col("parts"))).alias("block"), *names).repartition("key", "block").sortWithinPartitions("key", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None
        for batch in batches:
            keys = np.stack((batch.column("key").to_numpy(), batch.column("block").to_numpy()), axis=1)
            starts = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]))
            found = []
            for start, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if start == end:
                    continue
                if held and at != tuple(keys[start]):
                    found.append(linked(held))
                    held = []
                at = tuple(keys[start])
                held.append(batch.slice(start, end - start))
            if found:
                yield as_batch(found)
        if held:
            yield as_batch([linked(held)])

    def linked(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        table = pa.Table.from_batches(held)
        return link({n: table.column(n).to_pylist() if table.column(n).type == pa.binary() else table.column(n).to_numpy() for n in names})

    def as_batch(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint")


def most_odd(percent: int) -> int:
    """The most places at which two sketches may differ, for their estimate to be at least `least_estimate`."""
    return int(SKETCH_BITS / 2 * (1 - np.exp(-2 * SAMPLES * (1 - least_estimate(percent)) * 2 / SKETCH_BITS)) + 1e-9)


def joined_across(block: dict[str, list], percent: int, confirmed: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The links by which classes of different components are joined. Each class meets all later ones that aren't of its
    component by then, whose sizes and sketches allow it and that `confirmed` leaves."""
    rep, size = block["rep"], block["n_shingles"]
    component = np.unique(block["component"], return_inverse=True)[1]
    sketch = np.frombuffer(b"".join(block["sketch"]), np.uint64).reshape(len(rep), -1)
    ends, most = ([], []), most_odd(percent)
    for i in range(len(rep) - 1):
        others = np.flatnonzero(component[i + 1 :] != component[i]) + i + 1
        if not len(others):
            break
        others = others[100 * np.minimum(size[others], size[i]) >= percent * np.maximum(size[others], size[i])]
        others = others[np.bitwise_count(sketch[others] ^ sketch[i]).sum(axis=1, dtype=np.int64) <= most]
        if len(others):
            others = confirmed(i, others)
            new, first = np.unique(component[others], return_index=True)
            ends[0].extend([rep[i]] * len(new))
            ends[1].extend(rep[others[first]])
            component[np.isin(component, new)] = component[i]
    return np.array(ends[0], np.int64), np.array(ends[1], np.int64)


def possible(met: DataFrame, classes: DataFrame, components: DataFrame, percent: int) -> DataFrame:
    """a, b: links that join all components between which a pair of one bucket is possible by sizes and sketches."""
    placed = met.join(components, met["rep"] == components["node"], "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    whole = W.partitionBy("key")
    mixed_rows = placed.withColumns({"low": F.min("component").over(whole), "high": F.max("component").over(whole), "n": F.count("*").over(whole)}).where("low <> high")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = mixed_rows.select("key", "rep", "component", parts.alias("parts"), F.pmod(F.xxhash64("rep"), parts).cast("int").alias("part"))
    described = classes.select("rep", "n_shingles", as_bytes("sketch").alias("sketch"))
    return in_blocks(rows.join(described, "rep"), lambda block: joined_across(block, percent, lambda _, others: others))


def as_bytes(longs: str) -> Column:
    """An array of longs as bytes, the first one's highest byte first: what is compared bit by bit may stand in any order."""
    return F.unhex(F.array_join(F.transform(longs, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def link_families(links: DataFrame, maybe: DataFrame, components: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links by full sets between the components that `maybe` joins to a family. All classes of a family meet, in one
    task or in blocks, and a pair within one component is never looked at, so sets are sent once, not once a pair."""
    families = connected_components(links.union(maybe), "a", "b").withColumnRenamed("component", "key")
    open_families = families.join(maybe.select(F.col("a").alias("node")), "node").select("key").distinct()
    members = families.join(open_families, "key", "left_semi").join(components, "node", "left").select("key", F.col("node").alias("rep"), F.coalesce("component", "node").alias("component"))
    sizes = members.join(sets.select("rep", "n_shingles"), "rep").groupBy("key").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    dealt = members.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))

    def link(block: dict[str, list]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(h) // 8 for h in block["hashes"]])
        words, flat = np.unique(np.frombuffer(b"".join(block["hashes"]), np.int64), return_inverse=True)
        starts, has = np.cumsum(size) - size, np.zeros(len(words), bool)

        def confirmed(i: int, others: np.ndarray) -> np.ndarray:
            own = flat[starts[i] : starts[i] + size[i]]
            has[own] = True
            firsts = np.cumsum(size[others]) - size[others]
            common = np.add.reduceat(has[flat[np.repeat(starts[others] - firsts, size[others]) + np.arange(size[others].sum())]], firsts, dtype=np.int64)
            has[own] = False
            return others[100 * common >= percent * (size[i] + size[others] - common)]

        return joined_across(block, percent, confirmed)

    return in_blocks(dealt.join(sets, "rep").select("key", "part", "parts", "rep", "component", "n_shingles", "sketch", "hashes"), link)


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = THRESHOLD) -> DataFrame:
    """documents: doc_id, text. Returns doc_id, n_shingles, component_id, one row for each row."""
    ship_package(documents.sparkSession)
    small_batches(documents.sparkSession)
    documents = keep_columns(documents, "doc_id", "text")
    described = stored(sketches(documents, width))
    alive = described.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    classes = stored(alive.groupBy("set_key").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("bands", "sketch", "n_shingles")]))
    met = cut(in_shared(classes.select("rep", F.explode("bands").alias("key"))))
    reps = cut(met.select("rep").distinct())
    near_any = stored(joined_ids(classes.select("rep", "sketch", "n_shingles"), reps))
    pairs = cut(sketched(leader_pairs(met), near_any, percent))
    sets = stored(sets_of(documents, reps, width))
    links = cut(confirm(pairs, sets, percent))
    components = connected_components(links, "a", "b")
    maybe = cut(possible(met, near_any, components, percent))
    if not maybe.isEmpty():
        further = cut(link_families(links, maybe, components, sets, percent))
        components = connected_components(links.union(further), "a", "b")
    of_class = classes.select("set_key", "rep").join(components, F.col("rep") == F.col("node"), "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    return described.select("doc_id", "n_shingles", "set_key").join(of_class, "set_key", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def first_of_groups(documents: DataFrame, width: int = 5, percent: int = THRESHOLD) -> DataFrame:
    """The documents, all columns untouched, without those whose component has a smaller id. Null ids stay, as nothing
    tells their rows apart; rows of one id share its fate."""
    found = near_duplicates(documents, width, percent)
    name = free_name(documents, "gone")
    gone = stored(found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(name)).distinct())
    return documents.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, documents["doc_id"] == gone[name], "left_anti")


def near_duplicate_rows(documents: DataFrame) -> DataFrame:
    """Digest columns over 2-word shingles: doc_id, n_shingles, component_id, kept."""
    found = near_duplicates(documents, width=2)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

"""Near duplicates by fast similarity sketching, banding and exact verification (operator 4).

Sketch: round i throws every shingle of a set, by a hash of its own, into one of t
bins; a bin keeps the least (round, hash). After t rounds of that, round t + j puts
all shingles into bin j. So every coordinate fills, whatever the size of the set,
and a sketch is made in one pass over n shingles when n is large, with the
concentration of t independent samples.

1. Pass one writes per document its set's fingerprint and the hashes of its bands.
   Documents of equal sets are one class from here on.
2. Classes that share a band are candidates. Pass two makes the sets of candidates
   alone (a bitmap of fixed size lets them through).
3. In each bucket of a band all classes are held, on full sets, against the same one
   of them. That links most of a group, whatever its size, with as many comparisons
   as it has members.
4. Where a bucket still has classes of several components, all are held against the
   one whose shingles are most common: the middle of a group of edited copies.
5. Of what is then left, the pairs of different components are compared that share
   one of their rarest shingles; others cannot reach the threshold (prefix filter).
   So every pair of the buckets is linked already, compared or refuted.

With 128 coordinates in bands of 4, a pair at similarity 0.75 shares a band but for
5 in a million; at 0.8 but for 5 in 100 million.

Defined results: null text counts as empty; a set without shingles is linked with
nothing; rows that repeat a doc_id or a set are in one class; a null doc_id takes
part, and is a component's id only where all its ids are null.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillvault.llm.common import id_and_text, map_batches, utf8, written
from tillvault.llm.components import components
from tillvault.llm.exact import is_marked
from tillvault.llm.shingles import flat, mix, shingle_sets

COORDINATES = 128  # a power of two
ROWS = 4
BITMAP_BITS = 25
SETS_AT_ONCE = 100


class Sketcher:
    """Sketches of t coordinates; a value is its round (8 bits) and the hash below."""

    def __init__(self, t: int = COORDINATES):
        self.t, self.bits = t, t.bit_length() - 1
        self.seeds = np.random.default_rng(11).integers(0, 1 << 64, 2 * t, dtype=np.uint64)
        self.edges = np.arange(t, dtype=np.uint64) << np.uint64(64 - self.bits)

    def of(self, items: np.ndarray) -> np.ndarray:
        """The sketch of a non-empty set of 64-bit hashes."""
        t, low = self.t, np.uint64(64 - self.bits)
        out = np.full(t, np.iinfo(np.uint64).max, np.uint64)
        done = 0
        while done < t:
            rounds = min(t - done, max(1, -(-6 * t // len(items))))
            seeds = self.seeds[done : done + rounds, None]
            hashed = mix(items[None, :] ^ seeds)
            numbers = np.arange(done, done + rounds, dtype=np.uint64)[:, None]
            # bin | round | hash: the least of a bin is its first in order
            keys = (hashed & ~((np.uint64(1) << low) - np.uint64(1))) | (numbers << (low - np.uint64(8)))
            keys |= (hashed & ((np.uint64(1) << low) - np.uint64(1))) >> np.uint64(8)
            keys = np.sort(keys, axis=None)
            first = np.searchsorted(keys, self.edges)
            there = first < len(keys)
            least = keys[np.minimum(first, len(keys) - 1)]
            there &= (least >> low) == np.arange(t, dtype=np.uint64)
            fresh = there & (out == np.iinfo(np.uint64).max)
            out[fresh] = least[fresh] & ((np.uint64(1) << low) - np.uint64(1))
            done += rounds
            if not (out == np.iinfo(np.uint64).max).any():
                return out
        for j in np.flatnonzero(out == np.iinfo(np.uint64).max):
            out[j] = mix(items ^ self.seeds[t + j]).min() >> np.uint64(self.bits + 1) | np.uint64(1) << np.uint64(62)
        return out

    def bands(self, items: np.ndarray, rows: int = ROWS) -> np.ndarray:
        parts = self.of(items).reshape(-1, rows)
        keys = np.arange(1, len(parts) + 1, dtype=np.uint64)
        for k in range(rows):
            keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, k])
        return keys.view(np.int64)


def _print(items: np.ndarray) -> bytes | None:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, text_md5, n_shingles, print, bands)."""
    made: list[Sketcher] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Sketcher())
        sizes, prints, bands = [], [], []
        for items in shingle_sets(*flat(batch.column(1))):
            sizes.append(len(items))
            prints.append(_print(items))
            bands.append(made[0].bands(items) if len(items) else None)
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([hashlib.md5(view).hexdigest() for view in utf8(batch.column(1))], pa.string()),
                pa.array(sizes, pa.int64()),
                pa.array(prints, pa.binary()),
                pa.array(bands, pa.list_(pa.int64())),
            ],
            ["doc_id", "text_md5", "n_shingles", "print", "bands"],
        )

    return map_batches(docs, run, "doc_id long, text_md5 string, n_shingles long, print binary, bands array<long>")


def _slot(print_: bytes, bits: int) -> int:
    return int.from_bytes(print_[:7], "big") % (1 << bits)


def marked_sets(docs: DataFrame, bitmap: dict[int, bytes], bits: int) -> DataFrame:
    """(print, items) of the documents whose print is marked; each set once a task and batch."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: dict[bytes, np.ndarray] = {}
        for items in shingle_sets(*flat(batch.column(1))):
            name = _print(items)
            if name and name not in found and is_marked(_slot(name, bits), bitmap):
                found[name] = items.view(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.list_(pa.int64()))],
            ["print", "items"],
        )

    return map_batches(docs, run, "print binary, items array<long>")


def candidate_bitmap(prints: DataFrame, bits: int) -> dict[int, bytes]:
    """A bitmap of the prints of at most 2^bits bits, by bucket of 32,768."""
    place = F.conv(F.hex(F.substring("print", 1, 7)), 16, 10).cast("long") % (1 << bits) + 1
    rows = (
        prints.select(place.alias("slot"))
        .groupBy(F.bitmap_bucket_number("slot").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    )
    return {row.bucket: bytes(row.bits) for row in rows.collect()}


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets' similarity is at least ``percent`` / 100."""
    left = pairs.join(sets.select(F.col("print").alias("a"), F.col("items").alias("of_a")), "a")
    both = left.join(sets.select(F.col("print").alias("b"), F.col("items").alias("of_b")), "b")
    common = F.size(F.array_intersect("of_a", "of_b"))
    union = F.size("of_a") + F.size("of_b") - F.col("common")
    return both.withColumn("common", common).filter(100 * F.col("common") >= percent * union).select("a", "b")


def star_pairs(buckets: DataFrame) -> DataFrame:
    """Each class of a bucket (band, print) with the bucket's centre, the same one in most buckets of a group."""
    order = F.struct(F.xxhash64("print").alias("rank"), "print")
    centres = buckets.groupBy("band").agg(F.min(order).alias("centre"), F.count("*").alias("members"))
    centres = centres.filter("members > 1").select("band", F.col("centre.print").alias("b"))
    pairs = buckets.join(centres, "band").filter("print <> b")
    return pairs.select(F.col("print").alias("a"), "b").distinct()


def mixed_buckets(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(band, print, root) of the buckets that have classes of several components."""
    named = buckets.join(labels.withColumnRenamed("node", "print"), "print", "left").select(
        "band", "print", F.coalesce("root", "print").alias("root")
    )
    mixed = named.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    return named.join(mixed.select("band"), "band")


def ordered_sets(sets: DataFrame, prints: DataFrame) -> DataFrame:
    """(print, n, score, items): shingles from the rarest on; score: how common a set's shingles are."""
    items = sets.join(prints, "print").select("print", F.explode("items").alias("item"))
    common = items.groupBy("item").agg(F.count("*").alias("sets"))
    return items.join(common, "item").groupBy("print").agg(
        F.count("*").alias("n"),
        F.avg("sets").alias("score"),
        F.sort_array(F.collect_list(F.struct("sets", "item"))).alias("items"),
    )


def middle_pairs(mixed: DataFrame, ordered: DataFrame) -> DataFrame:
    """Each class of a mixed bucket with the bucket's most common one, if that is of another component."""
    scored = mixed.join(ordered.select("print", "score"), "print")
    middle = scored.groupBy("band").agg(F.max(F.struct("score", "print", "root")).alias("m"))
    pairs = mixed.join(middle.select("band", F.col("m.print").alias("b"), F.col("m.root").alias("other")), "band")
    return pairs.filter("root <> other").select(F.col("print").alias("a"), "b").distinct()


def open_pairs(mixed: DataFrame, ordered: DataFrame, percent: int) -> DataFrame:
    """The pairs of different components that may still reach the threshold.

    In one order of all shingles, the first that such a pair shares leaves at least
    ``overlap`` shingles in both sets from there on. So it is among the first
    n - overlap + 1 of each; pairs are joined on those, rarest first, not on bands.
    """
    classes = mixed.select("print", "root").distinct().join(ordered, "print")
    firsts = classes.select(
        "print",
        "root",
        "n",
        F.posexplode(F.slice("items", 1, (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int"))).alias("at", "e"),
    ).select("print", "root", "n", (F.col("n") - F.col("at")).alias("left"), F.col("e.item").alias("item"))
    a, b = firsts.alias("a"), firsts.alias("b")
    overlap = F.ceil((F.col("a.n") + F.col("b.n")) * percent / (100 + percent))
    reach = (F.col("a.left") >= overlap) & (F.col("b.left") >= overlap)
    found = a.join(
        b,
        (F.col("a.item") == F.col("b.item"))
        & (F.col("a.print") < F.col("b.print"))
        & (F.col("a.root") != F.col("b.root"))
        & reach,
    )
    return found.select(F.col("a.print").alias("a"), F.col("b.print").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, bits: int = BITMAP_BITS
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_md5) of every row."""
    return near_groups(docs, id_col, text_col, percent, bits).drop("stays")


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, bits: int = BITMAP_BITS
) -> DataFrame:
    """``near_duplicates`` and stays: true for one (doc_id, text) of each component, whatever its ids are.

    That is the first by doc_id, null ids last, then by text_md5; rows without a set stay.
    """
    texts = id_and_text(docs, id_col, text_col)
    sketched = written(sketches(texts), "sketches")
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_md5")
    classes = sketched.filter("print IS NOT NULL").groupBy("print").agg(F.min(row).alias("least"), F.first("bands").alias("bands"))
    bands = classes.select("print", F.explode("bands").alias("band"))
    several = bands.groupBy("band").agg(F.count("*").alias("members")).filter("members > 1").select("band")
    buckets = written(bands.join(several, "band").select("band", "print"), "buckets")

    bitmap = candidate_bitmap(buckets.select("print").distinct(), bits)
    sets = marked_sets(texts, bitmap, bits).join(buckets.select("print").distinct(), "print", "left_semi")
    sets = written(sets.dropDuplicates(["print"]), "sets")
    links = written(verified(star_pairs(buckets), sets, percent), "links")
    labels = written(components(links), "labels")
    mixed = written(mixed_buckets(buckets, labels), "mixed")
    ordered = written(ordered_sets(sets, mixed.select("print").distinct()), "ordered")
    links = links.unionByName(written(verified(middle_pairs(mixed, ordered), sets, percent), "links"))
    labels = written(components(links), "labels")
    mixed = mixed_buckets(mixed.select("band", "print"), labels)
    links = links.unionByName(written(verified(open_pairs(mixed, ordered, percent), sets, percent), "links"))
    labels = written(components(links), "labels")

    ids = classes.select("print", "least")
    named = ids.join(labels.withColumnRenamed("node", "print"), "print")
    least = named.groupBy("root").agg(F.min("least").alias("first"))
    linked = named.join(least, "root").select("print", "first")
    all_classes = ids.join(linked, "print", "left").select("print", F.coalesce("first", "least").alias("first"))
    out = sketched.select("doc_id", "text_md5", "n_shingles", "print").join(all_classes, "print", "left")
    # Only rows without a set have no class.
    component = F.when(F.col("print").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    stays = F.col("print").isNull() | (
        F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_md5") == F.col("first.text_md5"))
    )
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
        "text_md5",
        stays.alias("stays"),
    )

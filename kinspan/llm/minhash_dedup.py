"""Near-duplicate documents: fast similarity sketches, banding, exact confirmation.

The sketch is that of Dahlgaard, Knudsen and Thorup (2017). In round i < T every element of the set is thrown into a
hashed bin with the value i + its hash; in round i >= T every element goes to bin i - T. A bin keeps its smallest value
and the rounds end when no bin is empty, so all T coordinates fill, large sets need one or two rounds, and the share of
equal coordinates is concentrated about the Jaccard similarity as for independent hash functions.

Documents with the same set are one representative from the start. BANDS bands of ROWS coordinates make buckets; a pair
at similarity 0.8 meets in none of them with probability 1.3e-7. Within a bucket no pairs are enumerated at first:
each member is compared with the bucket's smallest member only, the best such link is confirmed on the full sets, and
components are formed; then components that meet in a bucket are compared by their best pair. All pairs that still are
in different components but share a bucket come last, so that no link between components is lost; pairs within one
component needn't be compared. What keeps the last step from growing with the square of a group is a bound that needs no
pairs: a document's shingles that no other open document has are in no intersection. Of the pairs that this and the
sizes leave, parity bitmaps (Sandes, Teodoro and Melo, 2020) rule out most before they leave the join: each shingle
flips one of PARITY_BITS bits, so two sets differ by as many shingles at least as their bitmaps by bits. The members of
a bucket meet by blocks of BLOCK or so, each pair of blocks by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspan.llm.common import CHUNK_BYTES, drop_staged, mix64, pieces, powers, read, stage, text_buffers
from kinspan.llm.graph import components

BANDS, ROWS = 40, 5
T = BANDS * ROWS
#: A pair goes on to confirmation if this share of coordinates agrees: 0.18 (6 standard deviations) below the threshold.
SLACK = 0.18
#: Rounds in which components that share a bucket are compared by one pair each, before all remaining pairs are.
TURNS = 2
PARITY_BITS = 512
#: Members of a bucket that meet at a time, and the share of all rows (one in SHARE) from which on a class is settled by broadcast.
BLOCK, SHARE = 256, 10_000
BASE = 0x9E3779B97F4A7C15

SKETCH_SCHEMA = "doc_id long, text_hash long, n_shingles long, sig_a long, sig_b long, bands array<long>, sketch binary, parity array<long>"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of `width` words and the row of each, by row and hash; data[offsets[0]:] is read.

    A-Z are lower-cased, words are runs of bytes other than ASCII white space; a row of fewer words gives one shingle
    of them all, a row without words gives none.
    """
    n_rows = len(offsets) - 1
    raw = data[offsets[0] : offsets[-1]]
    ends = offsets[1:] - offsets[0]
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    solid = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets[:-1] - offsets[0]] = True
    start = np.flatnonzero(solid & (np.r_[True, ~solid[:-1]] | edge[:-1]))
    edge[ends] = True
    end = np.flatnonzero(solid & (np.r_[~solid[1:], True] | edge[1:])) + 1
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # a word's hash is a polynomial in its bytes, summed by words so that it doesn't depend on the place
    began = np.zeros(len(raw), np.int64)
    began[start] = start
    within = np.arange(len(raw)) - np.maximum.accumulate(began)
    longest = int((end - start).max())
    p = powers(BASE, longest)
    value = np.where(solid, (_LOWER[raw].astype(np.uint64) + np.uint64(1)) * p[np.minimum(within, longest)], np.uint64(0))
    c = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(value, out=c[1:])
    word = mix64(c[end] - c[start] + (end - start).astype(np.uint64))
    row = np.searchsorted(ends, start, side="right")
    count = np.bincount(row, minlength=n_rows)
    full = len(word) - width + 1
    if full > 0:
        h = word[:full].copy()
        for k in range(1, width):
            h = mix64(h * np.uint64(BASE) + word[k : full + k])
        same = row[:full] == row[width - 1 :]
        h, r = h[same], row[:full][same]
    else:
        h, r = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        at = np.r_[0, np.cumsum(count)]
        whole = np.zeros(len(short), np.uint64)
        for i, x in enumerate(short):
            v = mix64(np.array([count[x]], np.uint64))
            for k in range(at[x], at[x + 1]):
                v = mix64(v * np.uint64(BASE) + word[k : k + 1])
            whole[i] = v[0]
        h, r = np.r_[h, whole], np.r_[r, short]
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])] if len(h) else np.zeros(0, bool)
    return h[new], r[new]


def sketch(h: np.ndarray, r: np.ndarray, n_rows: int, t: int = T) -> np.ndarray:
    """n_rows x t coordinates of fast similarity sketching; a row without elements keeps the largest value."""
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    s = np.full(n_rows * t, top, np.uint64)
    for i in range(2 * t):
        if not len(h):
            break
        v = mix64(h + np.uint64((i * 0xA0761D6478BD642F + 0x1D8E4E27C47D124F) % 2**64))
        place = ((v >> np.uint64(40)) * np.uint64(t) >> np.uint64(24)).astype(np.int64) if i < t else i - t
        np.minimum.at(s, r * t + place, (np.uint64(i) << np.uint64(54)) | (mix64(v) >> np.uint64(10)))
        open_ = (s.reshape(n_rows, t) == top).any(axis=1)[r]
        h, r = h[open_], r[open_]
    return s.reshape(n_rows, t)


def parities(h: np.ndarray, r: np.ndarray, n_rows: int) -> np.ndarray:
    """n_rows x PARITY_BITS / 64 words; each element flips one bit of its row."""
    words = PARITY_BITS // 64
    bit = mix64(h ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(PARITY_BITS)
    out = np.zeros(n_rows * words, np.uint64)
    np.bitwise_xor.at(out, r * words + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out.reshape(n_rows, words)


def _sketches(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    words = PARITY_BITS // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column(0).cast(pa.int64()), batch.column(1)
            data, offsets = text_buffers(batch.column(2))
            for i, j in pieces(offsets, CHUNK_BYTES):
                n = j - i
                h, r = shingles(data, offsets[i : j + 1], width)
                size = np.bincount(r, minlength=n)
                s = sketch(h, r, n)
                sig = []
                for salt in (0x8BB84B93962EACC9, 0x2D358DCCAA6C78A5):
                    c = np.zeros(len(h) + 1, np.uint64)
                    np.cumsum(mix64(h ^ np.uint64(salt)), out=c[1:])
                    at = np.r_[0, np.cumsum(size)]
                    sig.append((c[at[1:]] - c[at[:-1]]).view(np.int64))
                bands = np.empty((n, BANDS), np.uint64)
                for b in range(BANDS):
                    x = np.full(n, b + 1, np.uint64)
                    for k in range(b * ROWS, (b + 1) * ROWS):
                        x = mix64(x * np.uint64(BASE) + s[:, k])
                    bands[:, b] = x
                low = np.ascontiguousarray((mix64(s) & np.uint64(0xFF)).astype(np.uint8))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[i:j],
                        hashes[i:j],
                        pa.array(size, pa.int64()),
                        *(pa.array(x) for x in sig),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(bands.reshape(-1).view(np.int64))),
                        pa.array([x.tobytes() for x in low], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * words, words, dtype=np.int32)), pa.array(parities(h, r, n).reshape(-1).view(np.int64))),
                    ],
                    ["doc_id", "text_hash", "n_shingles", "sig_a", "sig_b", "bands", "sketch", "parity"],
                )

    return run


def _sets(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of (doc_id, text): the set of hashed shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in pieces(offsets, CHUNK_BYTES):
                h, r = shingles(data, offsets[i : j + 1], width)
                at = np.r_[0, np.cumsum(np.bincount(r, minlength=j - i))].astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.ListArray.from_arrays(pa.array(at), pa.array(h.view(np.int64)))], ["doc_id", "shingles"])

    return run


def _agreeing(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs (a, b, sketch_a, sketch_b) of which at least that share of coordinates agrees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, T) for k in (2, 3))
            agree = (x == y).sum(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(agree)], ["a", "b", "agree"]).filter(pa.array(agree >= least * T))

    return run


def _confirmed(width: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs (a, b, text_a, text_b) with 100 * intersection >= percent * union of their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (data_a, off_a), (data_b, off_b) = text_buffers(batch.column(2)), text_buffers(batch.column(3))
            good = np.zeros(batch.num_rows, bool)
            for i, j in pieces(off_a + off_b, CHUNK_BYTES):
                n = j - i
                (ha, ra), (hb, rb) = shingles(data_a, off_a[i : j + 1], width), shingles(data_b, off_b[i : j + 1], width)
                h, r = np.r_[ha, hb], np.r_[ra, rb]
                order = np.lexsort((h, r))
                h, r = h[order], r[order]
                both = np.bincount(r[1:][(h[1:] == h[:-1]) & (r[1:] == r[:-1])], minlength=n)
                union = np.bincount(r, minlength=n) - both
                good[i:j] = (100 * both >= percent * union) & (both > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good))

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents linked by 100 * intersection >= percent * union of their word shingles.

    Takes doc_id and text; other columns are ignored. Returns doc_id, n_shingles, component_id (the smallest doc_id
    that links reach, its own included), kept (doc_id = component_id) and text_hash (xxhash64 of the text), a row for each row. A null or blank text has
    no shingles and is linked with nothing. A text of fewer than `width` words has one shingle. Equal sets are one
    class from the start. Different texts with the same doc_id are different documents, each with its own links. A row
    without doc_id is linked with nothing, has a null component and is kept. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    sketched = stage(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(_sketches(width), SKETCH_SCHEMA), "sketches")
    linkable = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    known = sketched.filter(linkable)

    # a class for each set, numbered in the order of its smallest doc_id: `rep` stands for it from here on
    same = ["sig_a", "sig_b", "n_shingles"]
    one = [F.first(c).alias(c) for c in ("bands", "sketch", "parity")]
    classes = known.groupBy(*same).agg(F.min(F.struct("doc_id", "text_hash")).alias("at"), F.count(F.lit(1)).alias("rows"), *one).select(*same, "at.*", "rows", "bands", "sketch", "parity")
    by_id = ["doc_id", "sig_a", "sig_b"]
    chosen = stage(classes.repartitionByRange(*by_id).sortWithinPartitions(*by_id).withColumn("rep", F.monotonically_increasing_id()), "classes")

    rows = chosen.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("rep").alias("centre"), F.count(F.lit(1)).alias("members")).filter("members > 1").select("bucket", "centre")
    members = stage(rows.join(shared, "bucket"), "members")
    # rows that share a doc_id may be of several classes
    wanted = chosen.select("rep", "doc_id", "text_hash").join(members.select("rep").distinct(), "rep")
    texts = docs.withColumn("text_hash", F.xxhash64("text")).join(wanted, ["doc_id", "text_hash"]).dropDuplicates(["rep"])
    texts = stage(texts.select(F.col("rep").alias("doc_id"), "text"), "texts")

    signs = chosen.select("rep", "sketch")

    def agreeing(pairs: DataFrame) -> DataFrame:
        one = pairs.join(signs.withColumnsRenamed({"rep": "a", "sketch": "sketch_a"}), "a")
        two = one.join(signs.withColumnsRenamed({"rep": "b", "sketch": "sketch_b"}), "b")
        return two.select("a", "b", "sketch_a", "sketch_b").mapInArrow(_agreeing(percent / 100 - SLACK), "a long, b long, agree int")

    def confirmed(pairs: DataFrame) -> DataFrame:
        one = pairs.join(texts.withColumnsRenamed({"doc_id": "a", "text": "text_a"}), "a")
        two = one.join(texts.withColumnsRenamed({"doc_id": "b", "text": "text_b"}), "b")
        return two.select("a", "b", "text_a", "text_b").mapInArrow(_confirmed(width, percent), "a long, b long")

    # the centre that a member shares most buckets with
    stars = members.filter("rep <> centre").groupBy(F.col("centre").alias("a"), F.col("rep").alias("b")).agg(F.count(F.lit(1)).alias("times"))
    best = stars.groupBy("b").agg(F.max_by("a", F.struct("times", -F.col("a"))).alias("a"))
    links = stage(confirmed(best.select("a", "b")), "links")
    labels = components(links)

    def open_members(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """rows with the component of each, and the buckets in which several components meet, with their members."""
        with_label = rows.join(labels, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep")).drop("node")
        buckets = with_label.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("members"))
        return with_label, buckets.filter("x <> y").select("bucket", "members")

    # a shingle that no other open document has is in no intersection, which bounds the similarity of every pair
    placed, open_ = open_members(members.select("bucket", "rep", "n"))
    first = stage(placed.join(open_, "bucket").select("bucket", "rep", "n"), "left")
    own = texts.join(first.select(F.col("rep").alias("doc_id")).distinct(), "doc_id").select("doc_id", "text")
    own = own.mapInArrow(_sets(width), "doc_id long, shingles array<long>").select("doc_id", F.explode("shingles").alias("shingle"))
    lone = own.groupBy("shingle").agg(F.count(F.lit(1)).alias("of"), F.min("doc_id").alias("doc_id")).filter("of = 1").groupBy("doc_id").agg(F.count(F.lit(1)).alias("lone"))
    common = first.join(lone, F.col("rep") == F.col("doc_id"), "left").select("bucket", "rep", "n", (F.col("n") - F.coalesce("lone", F.lit(0))).alias("common"))
    left = stage(common.filter(100 * F.col("common") >= percent * F.col("n")).join(chosen.select("rep", "parity"), "rep"), "left")
    drop_staged(first)
    drop_staged(members)

    def can_link(other: str) -> Column:
        """Whether the sizes and the bounds allow the similarity of a row and its partner.

        It takes (100 + percent) * intersection >= percent * both sizes, and both sizes are twice the intersection and the difference.
        """
        both = F.col("n") + F.col(f"n_{other}")
        sizes = 100 * F.least("n", f"n_{other}") >= percent * F.greatest("n", f"n_{other}")
        differ = sum((F.bit_count(F.col("parity")[i].bitwiseXOR(F.col(f"parity_{other}")[i])) for i in range(PARITY_BITS // 64)), F.lit(0))
        return sizes & ((100 + percent) * F.least("common", f"common_{other}") >= percent * both) & ((100 + percent) * differ <= (100 - percent) * both)

    def partner(name: str) -> list[Column]:
        return [F.col(c).alias(f"{c}_{name}") for c in ("rep", "n", "component", "common", "parity")]

    for turn in range(TURNS):
        # one pair for two components that meet in a bucket: the bucket's centre and the member that shares most buckets with it
        placed, open_ = open_members(left)
        placed = stage(placed.join(open_, "bucket"), "open")
        centre = placed.groupBy("bucket").agg(F.min_by(F.struct(*partner("a")), F.struct(F.xxhash64("component", F.lit(turn)), "rep")).alias("c")).select("bucket", "c.*")
        meet = placed.join(centre, "bucket").filter((F.col("component") != F.col("component_a")) & can_link("a"))
        ends = [F.least("component", "component_a").alias("x"), F.greatest("component", "component_a").alias("y")]
        meet = meet.groupBy(F.col("rep_a").alias("a"), F.col("rep").alias("b"), *ends).agg(F.count(F.lit(1)).alias("times"))
        one = meet.groupBy("x", "y").agg(F.max_by(F.struct("a", "b"), F.struct("times", "a", "b")).alias("pair"))
        more = stage(confirmed(one.select("pair.a", "pair.b")), "links")
        drop_staged(placed)
        if not more.limit(1).count():
            break
        links = stage(links.unionByName(more), "links")
        labels = components(links)

    # a bucket is dealt over pairs of blocks of its members, so that none is held by one task
    placed, open_ = open_members(left)
    blocks = F.ceil(F.col("members") / F.lit(float(BLOCK))).cast("int")
    placed = stage(placed.join(open_, "bucket").withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("rep", "bucket"), blocks).cast("int")}), "open")
    one = placed.select("bucket", *[c for c in ("rep", "n", "component", "common", "parity")], F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"))
    other = placed.select("bucket", *partner("b"), F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"))
    fits = ((F.col("i") < F.col("j")) | (F.col("rep") < F.col("rep_b"))) & (F.col("component") != F.col("component_b")) & can_link("b")
    ends = [F.least("rep", "rep_b").alias("a"), F.greatest("rep", "rep_b").alias("b")]
    across = one.join(other, ["bucket", "i", "j"]).filter(fits).select(*ends).distinct()
    links = stage(links.unionByName(confirmed(agreeing(across).select("a", "b"))), "links")
    for used in (placed, left, texts):
        drop_staged(used)
    final = components(links)
    drop_staged(links)

    # a component's smallest class has its smallest doc_id
    labelled = chosen.join(final, F.col("rep") == F.col("node"), "left").select(*same, "rows", F.coalesce("component", "rep").alias("component"))
    ids = chosen.select(F.col("rep").alias("component"), F.col("doc_id").alias("component_id"))
    labelled = stage(labelled.join(ids, "component").select(*same, "rows", "component_id"), "components")
    columns = ["doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "text_hash"]
    narrow = sketched.select("doc_id", "text_hash", *same)
    # classes of one row in SHARE or more, of which there are at most SHARE, are settled where rows are read
    heavy = F.broadcast(labelled.filter(F.col("rows") >= max(2, docs.count() // SHARE)).select(*same, "component_id"))
    hot = narrow.filter(linkable).join(heavy, same).select(*columns)
    cold = narrow.filter(linkable).join(heavy, same, "left_anti").join(labelled.select(*same, "component_id"), same).select(*columns)
    alone = narrow.filter(~linkable).withColumn("component_id", F.col("doc_id")).select(*columns)
    return hot.unionByName(cold).unionByName(alone)


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), width=4, percent=80)

"""Removal of repeated substrings by prefix-free parsing.

A rolling hash of TRIGGER bytes is taken at every byte. Each string of `length` bytes has one trigger: the position of
its smallest rolling hash (the leftmost at ties), which depends on these bytes alone. Successive strings with the same
trigger make a *phrase*, the text from the first string's start to the last one's end; so every string of `length`
bytes starts in exactly one phrase, and equal strings start in phrases with equal trigger bytes. The *dictionary* is
the set of distinct phrases with the place where each first occurs, the *parse* is the sequence of occurrences, kept in
order of phrase and then of corpus.

The order of the corpus comes from the two together. In the parse, every later occurrence of a phrase repeats an earlier
one, whole. In the dictionary, phrases that share a trigger are brought together and the suffix array of their bytes is
built, compared to `length` bytes: neighbours in it that agree so far are one class, whose members stand in corpus
order, and all but the first are repeated. A suffix that starts in a phrase is decided inside it, since phrases overlap
by `length` - 1 bytes; what follows the phrase, which a suffix array of the parse would order, never decides anything.

Suffix arrays are built of AT_ONCE suffixes or so. Triggers with a large share of all phrases are dealt over several
groups, and a group that is larger than a suffix array may be is cut: then the first members of each class, one a
suffix array, meet once more by their bytes. So neither memory nor tasks follow the number of texts that share a passage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from kinspan.llm.common import CHUNK_BYTES, mix64, pieces, powers, read, stage, text_buffers

TRIGGER = 40
#: Low bits of a trigger key that hold the position in the piece; a piece has at most that many bytes.
POSITION_BITS = 20
BASE_A, BASE_B = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: One text in SAMPLE (of a very long one, one piece in SAMPLE) is parsed to find triggers with a share of 1 / SHARES of
#: all phrases; so there are at most SHARES of them. Each is dealt over groups of 1 / GROUPS of all phrases.
#: Triggers with fewer than HEAVY_LEAST sampled phrases stay whole. The result doesn't depend on these.
SAMPLE, SHARES, GROUPS, HEAVY_LEAST = 16, 1 << 16, 1 << 13, 64
#: Suffixes that a suffix array holds, 4 times as many if they are of one group.
AT_ONCE = 1 << 16

#: A phrase's place: its start * PLACE + its number of strings - 1; below zero (-1 - place) if its trigger is heavy.
PLACE = 1024

PARSE_SCHEMA = "doc_id long, row long, place long, anchor long, phrase long"
PHRASE_SCHEMA = "anchor long, doc_id long, row long, start int, cut boolean, bytes binary"
#: A run of n_win repeated strings, or the first member of a class of a group that was cut (n_win 0).
SPAN_SCHEMA = "doc_id long, row long, start int, n_win int, string binary"
RESULT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"


def _prefix(data: np.ndarray, p: np.ndarray) -> np.ndarray:
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=c[1:])
    return c


def _parse(length: int, heavy: dict[int, int] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of (doc_id, row, text): the phrases. `heavy` has the number of groups of each heavy trigger; None: parse a sample."""
    most, sample = 1 << POSITION_BITS, SAMPLE
    low = np.uint64(most - 1)

    def phrases(data: np.ndarray, ends: np.ndarray, pa_: np.ndarray, pb: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of a piece of documents that end at `ends`: start, number of strings, trigger hash and hash of each phrase."""
        n, span = len(data), length - TRIGGER + 1
        at = np.arange(n - TRIGGER + 1)
        c = _prefix(data, pa_)
        rolling = mix64((c[TRIGGER:] - c[:-TRIGGER]) * pa_[most - at])
        least, have = (rolling & ~low) | at.astype(np.uint64), 1
        while have * 2 <= span:
            least, have = np.minimum(least[:-have], least[have:]), have * 2
        if have < span:
            least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
        starts = np.arange(len(least))
        document = np.searchsorted(ends, starts, side="right")
        inside = starts + length <= ends[np.minimum(document, len(ends) - 1)]
        starts, trigger, document = starts[inside], (least[inside] & low).astype(np.int64), document[inside]
        if not len(starts):
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
        first = np.r_[True, (trigger[1:] != trigger[:-1]) | (document[1:] != document[:-1])]
        i = np.flatnonzero(first)
        last = starts[np.r_[i[1:], len(starts)] - 1]
        s = starts[i]
        c = _prefix(data, pb)
        return s, last - s + 1, rolling[trigger[i]], mix64((c[last + length] - c[s]) * pb[most - s])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa_, pb = powers(BASE_A, most), powers(BASE_B, most)
        hot = np.array(sorted(heavy or {}), np.int64)
        groups = np.array([heavy[x] for x in hot.tolist()], np.uint64) if len(hot) else None
        for batch in batches:
            ids, rows = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            data, offsets = text_buffers(batch.column(2))
            for i, j in pieces(offsets, min(CHUNK_BYTES, most)):
                whole, first = data[offsets[i] : offsets[j]], int(offsets[i])
                # a document beyond a piece is cut into pieces that overlap by length - 1 bytes: each string is in one
                for cut in range(0, max(1, len(whole) - length + 1), most - length + 1):
                    part = whole[cut : cut + most]
                    if len(part) < length or (heavy is None and len(whole) > most and hash((int(ids[i]), cut)) % sample):
                        continue
                    ends = (offsets[i + 1 : j + 1] - first) if j - i > 1 else np.array([len(part)])
                    s, n, anchor, phrase = phrases(part, ends, pa_, pb)
                    if not len(s):
                        continue
                    d = np.searchsorted(ends, s, side="right")
                    doc, row, anchor = ids[i + d], rows[i + d], anchor.view(np.int64).copy()
                    start = s + cut - (offsets[i + d] - first if j - i > 1 else 0)
                    place = start * PLACE + n - 1
                    if len(hot):
                        at = np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)
                        is_hot = hot[at] == anchor
                        group = mix64((doc ^ mix64(place.view(np.uint64)).view(np.int64)).view(np.uint64)[is_hot]) % groups[at[is_hot]]
                        anchor[is_hot] ^= mix64(group).view(np.int64)
                        place[is_hot] = -1 - place[is_hot]
                    yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(row, pa.int64()), pa.array(place), pa.array(anchor), pa.array(phrase.view(np.int64))], ["doc_id", "row", "place", "anchor", "phrase"])

    return run


def _phrases(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The bytes of the marked phrases: rows (doc_id, row, text, marks: place, anchor)."""

    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["anchor", "doc_id", "row", "start", "cut", "bytes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, int, bool, bytes]] = []
            for doc, row, text, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                b = text.encode()
                for place, anchor in {(m["place"], m["anchor"]) for m in marks}:
                    start, more = divmod(place if place >= 0 else -1 - place, PLACE)
                    out.append((anchor, doc, row, start, place < 0, b[start : start + more + length]))
                    if len(out) >= AT_ONCE:
                        yield made(out)
                        out = []
            if out:
                yield made(out)

    return run


def suffix_array(phrases: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array of phrases, of suffixes with `length` bytes or more, compared to `length` bytes; equal ones keep their order.

    Returns the phrase and the offset of each suffix in the order of phrases, the array, and whether an entry agrees with
    the one before it in `length` bytes.
    """
    size = np.array([len(p) for p in phrases], np.int64)
    n = size - length + 1
    phrase = np.repeat(np.arange(len(phrases)), n)
    offset = np.arange(len(phrase)) - np.repeat(np.cumsum(n) - n, n)
    text = np.frombuffer(b"".join(phrases), np.uint8)
    suffixes = np.lib.stride_tricks.sliding_window_view(text, length)[(np.cumsum(size) - size)[phrase] + offset]
    keys = np.ascontiguousarray(suffixes).view(f"S{length}").ravel()
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    return phrase, offset, order, np.r_[False, ordered[1:] == ordered[:-1]]


def _classes(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Suffix arrays of phrases that come ordered by trigger: what is repeated, and what is left to compare of cut groups."""
    most = AT_ONCE

    def spans(rows: list[tuple], cut: set[int]) -> pa.RecordBatch:
        rows = sorted(rows, key=lambda r: (r[1], r[2], r[3]))
        phrase, offset, order, same = suffix_array([r[5] for r in rows], length)
        doc, row, start = (np.array([r[k] for r in rows], np.int64)[phrase] for k in (1, 2, 3))
        start = start + offset
        first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        # an equal row of the table gives the same place again, which repeats nothing
        other = (doc[order] != doc[first]) | (row[order] != row[first]) | (start[order] != start[first])
        again = np.zeros(len(order), bool)
        again[order] = other
        begins = again & np.r_[True, ~again[:-1] | (phrase[1:] != phrase[:-1])]
        b = np.flatnonzero(begins)
        run = np.bincount(np.cumsum(begins)[again] - 1, minlength=len(b))
        is_cut = np.array([r[4] or r[0] in cut for r in rows])[phrase]
        left = np.sort(order[~same & is_cut[order]])
        at = np.r_[b, left]
        string = [None] * len(b) + [rows[phrase[x]][5][offset[x] : offset[x] + length] for x in left]
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[at]), pa.array(row[at]), pa.array(start[at], pa.int32()), pa.array(np.r_[run, np.zeros(len(left), np.int64)], pa.int32()), pa.array(string, pa.binary())],
            ["doc_id", "row", "start", "n_win", "string"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        cut: set[int] = set()
        suffixes = 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and suffixes >= (most if r[0] != rows[-1][0] else 4 * most):
                    if r[0] == rows[-1][0]:
                        cut.add(r[0])
                    yield spans(rows, cut)
                    rows, suffixes, cut = [], 0, cut & {r[0]}
                rows.append(r)
                suffixes += len(r[5]) - length + 1
        if rows:
            yield spans(rows, cut)

    return run


def _cut(length: int, with_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            spans = batch.column(2)
            rows: list[list] = [[], [], [], [], []]
            for r in range(batch.num_rows):
                b = data[offsets[r] : offsets[r + 1]]
                marks = spans[r].values if spans[r].is_valid else None
                removed = n_spans = 0
                if marks is not None and len(marks):
                    start = marks.field("start").to_numpy().astype(np.int64)
                    end = start + marks.field("n_win").to_numpy() - 1 + length
                    edge = np.zeros(len(b) + 1, np.int32)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, end, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed, n_spans = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    b = b[~gone]
                b = b.tobytes()
                for values, v in zip(rows, (int(offsets[r + 1] - offsets[r]), removed, n_spans, hashlib.sha256(b).hexdigest(), b.decode("utf-8", "replace") if with_text else None), strict=True):
                    values.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(v, pa.int64()) for v in rows[:3]), pa.array(rows[3], pa.string()), pa.array(rows[4], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    return run


def dedup_substrings(docs: DataFrame, length: int = 100, with_text: bool = True) -> DataFrame:
    """Remove every byte covered by a string of `length` bytes that also starts earlier in (doc_id, offset) order.

    Takes doc_id and text; other columns are ignored. Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and
    kept_text (null unless with_text; a character that was cut in two reads as U+FFFD). A null text is empty. Texts
    shorter than `length` lose nothing. Equal rows count as one document and each is returned; different texts with the
    same doc_id are different documents, in the order of a hash of theirs. A row without doc_id has no place in the
    order: it is returned whole and doesn't make others repeated. An empty table gives no rows.
    """
    if not TRIGGER < length < TRIGGER + PLACE:
        raise ValueError(f"length must be over {TRIGGER} and below {TRIGGER + PLACE}")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    known = docs.filter("doc_id is not null")
    texts_of = known.select("doc_id", F.xxhash64("text").alias("row")).distinct().groupBy("doc_id").count()
    clash = texts_of.filter("count > 1").limit(1).count() > 0
    known = known.select("doc_id", (F.xxhash64("text") if clash else F.lit(0).cast("long")).alias("row"), "text")

    sampled = known.filter((F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0) | (F.octet_length("text") > 1 << POSITION_BITS))
    total = Observation()
    counts = sampled.mapInArrow(_parse(length, None), PARSE_SCHEMA).groupBy("anchor").count().observe(total, F.sum("count").alias("phrases"))
    counts = stage(counts.filter(F.col("count") >= HEAVY_LEAST), "triggers")
    phrases = total.get["phrases"] or 0
    each = max(HEAVY_LEAST, phrases // GROUPS)
    heavy = {r[0]: 1 + r[1] // each for r in counts.filter(F.col("count") >= max(HEAVY_LEAST, phrases // SHARES)).collect()}

    parse = known.mapInArrow(_parse(length, heavy), PARSE_SCHEMA)
    place = F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place"))
    corpus = ["doc_id", "row", place]
    trigger = Window.partitionBy("anchor").orderBy("phrase", *corpus).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    again, open_ = F.col("rank") > 1, (F.col("least") != F.col("most")) | (F.col("place") < 0)
    marks = stage(
        parse.withColumns({"least": F.min("phrase").over(trigger), "most": F.max("phrase").over(trigger)})
        .withColumn("rank", F.rank().over(Window.partitionBy("anchor", "phrase").orderBy(*corpus)))
        .filter(again | open_)
        .select("doc_id", "row", "place", F.when(~again, F.col("anchor")).alias("anchor")),
        "marks",
    )

    def by_document(rows: DataFrame, *columns: str) -> DataFrame:
        return rows.groupBy(F.col("doc_id").alias("of"), F.col("row").alias("of_row")).agg(F.collect_list(F.struct(*columns)).alias("marks"))

    # both joins below read the same exchange of the texts
    texts = known.repartition("doc_id", "row")
    same = (F.col("doc_id") == F.col("of")) & (F.col("row") == F.col("of_row"))
    dictionary = texts.join(by_document(marks.filter("anchor is not null"), "place", "anchor"), same).select("doc_id", "row", "text", "marks").mapInArrow(_phrases(length), PHRASE_SCHEMA)
    spans = stage(dictionary.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_classes(length), SPAN_SCHEMA), "spans")
    rank = F.rank().over(Window.partitionBy("string").orderBy("doc_id", "row", "start"))
    later = spans.filter("n_win = 0").withColumn("rank", rank).filter("rank > 1").select("doc_id", "row", "start", F.lit(1).alias("n_win"))

    repeated = marks.filter("anchor is null").select("doc_id", "row", F.floor(place / F.lit(PLACE)).cast("int").alias("start"), (F.pmod(place, F.lit(PLACE)) + 1).cast("int").alias("n_win"))
    gone = by_document(repeated.unionByName(spans.filter("n_win > 0").drop("string")).unionByName(later), "start", "n_win")
    cut = texts.join(gone, same, "left").select("doc_id", "text", "marks").mapInArrow(_cut(length, with_text), RESULT_SCHEMA)
    nameless = docs.filter("doc_id is null").withColumn("marks", F.lit(None).cast("array<struct<start: int, n_win: int>>"))
    return cut.unionByName(nameless.mapInArrow(_cut(length, with_text), RESULT_SCHEMA))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(read(spark, sf_dir, "documents"), 100, with_text=False).drop("kept_text")

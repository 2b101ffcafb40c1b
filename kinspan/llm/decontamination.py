"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question whose figures or names were changed has the same
template. WINDOW successive template tokens are hashed, on either side, and the windows are hash-joined: the documents
are read once, a bitmap of fixed size with the benchmark's hashes lets nearly only windows through that the benchmark
has, and these meet the benchmark's windows, a table, in an ordinary join. Windows of a pair of document and item that
lie on one diagonal (document position less item position) must fill slots consistently: one item value always becomes
the same document value.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspan.llm.common import drop_staged, mix64, read, stage

WINDOW, COVERAGE = 5, 0.8
#: So many successive windows on one diagonal are a leak whatever share of the item they are.
RUN = 30
#: Literal tokens that a window needs to stand for its template; one with fewer stands for its very words.
LITERALS = 2
#: The bitmap has 2 ** BITS bits, or fewer if 32 for each window of the benchmark are fewer.
BITS, LEAST_BITS = 27, 16
#: Tokens that are remembered, and words that are worked on at a time.
CACHE, AT_ONCE = 300_000, 1 << 17

#: Units of measure, and words that are no names where a sentence starts with them.
UNITS = set("mm cm m km in ft yd mi mg g kg t lb oz ml cl l s sec min h hr hrs ms kb mb gb tb hz khz mhz ghz w kw v a j kj cal kcal meter meters metre metres kilometer kilometers mile miles inch inches foot feet yard yards gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent degree degrees".split())
FUNCTION_WORDS = set(
    """
    the an and or but if when while after before because since as at by for from in into of on to with without is are was
    were be been has have had do does did can could will would may must not no yes this that these those there here it he
    she we you they his her its our your their who what which where why how all each every some any many much more most
    find let then so now one two if each total
    el la los las un una de en con por para que como cuando donde si no es son fue hay su sus este esta
    le les des du une dans sur avec sans pour par qui quoi quand est sont il elle nous vous ils elles ce cette
    der die das ein eine und oder aber wenn als im am auf mit ohne für von zu ist sind war hat haben er sie es wir ihr
    """.split()
)
_NUMBER = re.compile(r"[$€£#]?[+-]?\d[\d.,:/]*[a-z%°]{0,3}")
_EDGE = "\"'“”‘’«»()[]{}<>.,;:!?*_|"
NUMBER, NAME, UNIT = (np.uint64(xxhash.xxh64_intdigest(x)) for x in ("<number>", "<name>", "<unit>"))
_STEP, _EXACT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

WINDOW_SCHEMA = "id long, row long, place int, width int, hash long, exact boolean, slots array<string>"
RESULT_SCHEMA = "doc_id long, item_id long, n_windows int, n_matched int, coverage double, reparameterised boolean, text_hash long"


class Tokens(dict):
    """The number of each token met, and what it is."""

    def __init__(self) -> None:
        super().__init__()
        self.literal = np.zeros(1024, np.uint64)
        self.flags = np.zeros(1024, np.int64)  # 1 capitalised, 2 ends a sentence, 4 number, 8 unit, 16 not a word, 32 function word

    def __missing__(self, token: str) -> int:
        word = token.strip(_EDGE)
        low = word.lower()
        flag = (1 if word[:1].isupper() and word[1:].islower() else 0) | (2 if token[-1] in ".!?:|" or not word else 0)
        flag |= (4 if _NUMBER.fullmatch(low) else 0) | (8 if low in UNITS else 0) | (0 if word else 16) | (32 if low in FUNCTION_WORDS else 0)
        n = self[token] = len(self)
        if n == len(self.flags):
            self.literal, self.flags = np.r_[self.literal, np.zeros_like(self.literal)], np.r_[self.flags, np.zeros_like(self.flags)]
        self.literal[n], self.flags[n] = xxhash.xxh64_intdigest(low), flag
        return n


class Words:
    """The template of some texts in a row: each word's text, template hash, literal hash, whether it is a slot, and its token."""

    def __init__(self, texts: list[str], tokens: Tokens) -> None:
        if len(tokens) > CACHE:
            tokens.clear()
        split = [t.replace("\n", " | ").split() for t in texts]
        self.tokens = [t for ts in split for t in ts]
        codes = np.fromiter(map(tokens.__getitem__, self.tokens), np.int64, len(self.tokens))
        flags, literal = tokens.flags[codes], tokens.literal[codes]
        text = np.repeat(np.arange(len(split)), [len(ts) for ts in split])
        ends = np.r_[2, flags[:-1]][: len(flags)]
        ends[np.r_[True, text[1:] != text[:-1]][: len(flags)]] = 2
        number = (flags & 4) > 0
        unit = ((flags & 8) > 0) & ((ends & 4) > 0)
        # where a sentence starts any word has a capital, so function words are told apart there
        name = ((flags & 1) > 0) & (((ends & 2) == 0) | ((flags & 32) == 0)) & ~number & ~unit
        keep = np.flatnonzero((flags & 16) == 0)
        self.text, self.literal, self.at = text[keep], literal[keep], keep
        self.slot = (number | unit | name)[keep]
        self.template = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, literal)))[keep]
        self.first = np.searchsorted(self.text, np.arange(len(split) + 1))  # of each text

    def windows(self, width: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, hash and whether it stands for its very words, of each window that lies in one text."""
        n = len(self.text) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
        literals = np.r_[0, np.cumsum(~self.slot)]
        exact = literals[width : width + n] - literals[:n] < least
        hashes = []
        for h in (self.template, self.literal):
            w = mix64(h[:n] + np.uint64(width))
            for k in range(1, width):
                w = mix64(w * _STEP + h[k : n + k])
            hashes.append(w)
        place = np.flatnonzero(self.text[:n] == self.text[width - 1 :])
        return place, np.where(exact, mix64(hashes[1] ^ _EXACT), hashes[0])[place], exact[place]

    def slots(self, place: int, width: int) -> list[str | None]:
        return [self.tokens[self.at[p]].strip(_EDGE) if self.slot[p] else None for p in range(place, place + width)]


def _windows(widths: list[int], bitmap: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Windows of (id, row, text): of the given widths that the bitmap has, or, without one, of WINDOW words or of the whole text if it has fewer."""

    def made(ids: list[tuple], texts: list[str], tokens: Tokens) -> pa.RecordBatch | None:
        words = Words(texts, tokens)
        size = np.diff(words.first)
        out: list[tuple] = []
        for width in widths:
            place, h, exact = words.windows(width, min(LITERALS, width))
            if bitmap is None:
                good = (size[words.text[place]] == width) if width < WINDOW else np.ones(len(place), bool)
            else:
                bit = h >> np.uint64(65 - len(bitmap).bit_length() - 6)
                good = (bitmap[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) > 0
            for p, x, e in zip(place[good].tolist(), h[good].view(np.int64).tolist(), exact[good].tolist(), strict=True):
                t = words.text[p]
                out.append((*ids[t], p - int(words.first[t]), width, x, e, words.slots(p, width)))
        if not out:
            return None
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["id", "row", "place", "width", "hash", "exact", "slots"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            ids, texts, size = [], [], 0
            for i, row, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not t:
                    continue
                ids.append((i, row))
                texts.append(t)
                size += len(t)
                if size >= 6 * AT_ONCE:
                    if found := made(ids, texts, tokens):
                        yield found
                    ids, texts, size = [], [], 0
            if texts and (found := made(ids, texts, tokens)):
                yield found

    return run


def _bitmap(windows: DataFrame) -> np.ndarray:
    """Bits of the hashes' leading digits, in 64-bit words: at most 2 ** (BITS - 6) words come to the driver."""
    n = windows.count()
    bits = max(LEAST_BITS, min(BITS, (32 * max(n, 1)).bit_length()))
    bit = F.shiftrightunsigned("hash", 64 - bits)
    found = windows.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def check_pair(size: int, whole: list[tuple[int, int, int, int, list, list]]) -> tuple[int, bool, bool]:
    """Of an item with `size` distinct windows, and its windows found in a text: (hash, place in the text, place in the
    item, times in the item, slots in the text, slots in the item). Returns the distinct windows that stand up to the
    slot check, whether they hold a run of RUN, and whether a slot differs.

    Windows that the item has once are put on diagonals and their slots compared there; those that it repeats count as
    they are found.
    """
    good = {h for h, _, _, times, _, _ in whole if times > 1}
    by_shift: dict[int, dict[int, tuple[int, list, list]]] = defaultdict(dict)
    for h, p, q, times, mine, its in whole:
        if times == 1:
            by_shift[p - q][q] = (h, mine, its)
    differs, longest = False, 0
    for found in by_shift.values():
        value: dict[int, tuple[str, str]] = {}  # of each slot, by place in the item
        for q, (_, mine, its) in found.items():
            value |= {q + k: (its[k], mine[k]) for k in range(len(its)) if its[k] is not None and mine[k] is not None}
        votes: dict[str, Counter] = defaultdict(Counter)
        for its, mine in value.values():
            votes[its][mine] += 1
        usual = {its: max(c.items(), key=lambda x: (x[1], x[0]))[0] for its, c in votes.items()}
        bad = {q for q, (its, mine) in value.items() if usual[its] != mine}
        last, run = None, 0
        for q in sorted(found):
            h, mine, its = found[q]
            if any(q + k in bad for k in range(len(its))):
                continue
            good.add(h)
            differs |= any(x is not None and y is not None and x != y for x, y in zip(its, mine, strict=True))
            run = run + 1 if last == q - 1 else 1
            last, longest = q, max(longest, run)
    return len(good), longest >= RUN, differs


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (doc_id, row, item_id, n_windows, found): the pairs that are leaks."""
    for batch in batches:
        out = []
        for doc, row, item, size, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n, run, differs = check_pair(size, [(f["hash"], f["place"], f["q"], f["times"], f["slots"], f["its"]) for f in found])
            if run or n >= COVERAGE * size:
                out.append((doc, item, size, n, n / size, differs, row))
        if out:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "item_id", "n_windows", "n_matched", "coverage", "reparameterised", "text_hash"])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs of a document and a benchmark item of which it holds COVERAGE of the windows, or RUN of them in a row.

    `docs` needs doc_id and text, `benchmark` item_id and text; other columns are ignored. Returns doc_id, item_id,
    n_windows (distinct ones of the item), n_matched, coverage, reparameterised (a number, name or unit differs) and
    text_hash (xxhash64 of the document's text), a row for each pair; clean documents have none. Null and empty texts on either side match nothing. An item of fewer
    than WINDOW words is one window; one whose windows hold placeholders only is found by its very words. Equal rows
    count once on either side; different texts with the same id are compared each by itself, and so may give several
    rows. A row without doc_id gives pairs with a null doc_id. Empty tables give no rows.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), F.xxhash64("text").alias("row"), "text").mapInArrow(_windows(list(range(1, WINDOW + 1)), None), WINDOW_SCHEMA).dropDuplicates(["id", "row", "place"])
    items = stage(items, "items")
    # an item without any template window is known by its exact ones
    has = items.groupBy(F.col("id").alias("of"), F.col("row").alias("of_row")).agg(F.bool_and("exact").alias("only_exact"))
    same = F.col("id").eqNullSafe(F.col("of")) & (F.col("row") == F.col("of_row"))
    used = items.join(has, same).filter(F.col("only_exact") | ~F.col("exact"))
    by_hash = used.groupBy(F.col("id").alias("item_id"), F.col("row").alias("item_row"), "hash").agg(F.min(F.struct("place", "width", "slots")).alias("w"), F.count(F.lit(1)).alias("times"))
    sizes = by_hash.groupBy(F.col("item_id").alias("of"), F.col("item_row").alias("of_row")).agg(F.count(F.lit(1)).cast("int").alias("n_windows"))
    same = F.col("item_id").eqNullSafe(F.col("of")) & (F.col("item_row") == F.col("of_row"))
    known = stage(by_hash.join(sizes, same).select("hash", "item_id", "item_row", "n_windows", F.col("w.place").alias("q"), F.col("w.width").alias("width"), "times", F.col("w.slots").alias("its")), "windows")
    widths = sorted(r[0] for r in known.select("width").distinct().collect())  # at most WINDOW values
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("row"), "text")
    met = stage(texts.mapInArrow(_windows(widths, _bitmap(known)), WINDOW_SCHEMA), "met")
    drop_staged(items)

    # a document holds a window of an item, at each place; the item has one row of it
    found = met.select(F.col("id").alias("doc_id"), "row", "place", "hash", "slots").join(known, "hash")
    groups = found.groupBy("doc_id", "row", "item_id", "item_row", "n_windows").agg(F.collect_set(F.struct("hash", "place", "q", "times", "slots", "its")).alias("found"), F.count_distinct("hash").alias("n"))
    enough = F.least(F.col("n_windows") * COVERAGE, F.lit(float(RUN)))
    return groups.filter(F.col("n") >= enough).select("doc_id", "row", "item_id", "n_windows", "found").mapInArrow(_pairs, RESULT_SCHEMA)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))

"""Language identification, words first, with back-off to ever shorter character n-grams.

A word that the training rows hold scores by its log frequency in each language. Any other word is cut into n-grams of
its letters with edges marked: those that the longest order knows score at once, and only the letters that none of them
covers go down an order, at a discount. A word of which no order knows a part says nothing. Texts are scored in bulk:
words become rows of one matrix of evidence, and a text's evidence is the sum of its rows.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspan.llm.common import drop_staged, fold_is, read, stage

#: The labelled rows that are learned from: about so many of each language by hash, fewer of each beyond ROWS in all;
#: texts of more than LONGEST characters are not among them. This bounds the model.
ROWS_PER_LANG, ROWS, LONGEST = 2000, 200_000, 100_000
ORDERS, DISCOUNT = (4, 3, 2, 1), 0.5
#: A word or n-gram that the sample holds less often is unseen.
LEAST = 2
#: Count that each language has of each unit besides the counted ones.
SMOOTHING = 0.1
#: Rows of evidence that are kept for unseen words, and words that are summed at a time.
UNSEEN_ROWS, AT_ONCE = 200_000, 1 << 18
UND = "und"


_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


@cache
def _pattern(top: int) -> re.Pattern:
    """A letter, then letters and marks, of any script, up to a last character; the basic plane alone is matched faster."""

    def ranges(kinds: str) -> str:
        codes = [c for c in range(top + 1) if unicodedata.category(chr(c))[0] in kinds]
        runs = [[c for _, c in run] for _, run in groupby(enumerate(codes), lambda x: x[1] - x[0])]
        return "".join(f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for r in runs)

    return re.compile(f"[{ranges('L')}][{ranges('LM')}]*")


def words_of(text: str) -> list[str]:
    lowered = text.lower()
    return _pattern(sys.maxunicode if _ASTRAL.search(lowered) else 0xFFFF).findall(lowered)


def ngrams(word: str, n: int) -> list[str]:
    w = f"^{word}$" if n > 1 else word
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (text, lang): counts of words (order 0) and of n-grams, summed over a batch."""
    for batch in batches:
        words: dict[str, Counter] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words.setdefault(lang, Counter()).update(words_of(text))
        rows = []
        for lang, counts in words.items():
            grams: Counter = Counter()
            for w, c in counts.items():
                rows.append((lang, 0, w, c))
                for n in ORDERS:
                    for g in ngrams(w, n):
                        grams[n, g] += c
            rows += [(lang, n, g, c) for (n, g), c in grams.items()]
        if rows:
            a, b, c, d = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, pa.int32()), pa.array(c), pa.array(d, pa.int64())], ["lang", "size", "unit", "n"])


class Model:
    """Languages, the row of each known word and n-gram by order (0: words), and the evidence of each row by language."""

    def __init__(self, langs: list[str], rows: dict[int, dict[str, int]], evidence: np.ndarray) -> None:
        self.langs, self.rows, self.evidence = langs, rows, evidence

    def unseen(self, word: str) -> np.ndarray | None:
        """Evidence of a word that is not known, from its n-grams; None if no order knows a part of it."""
        edged = f"^{word}$"
        total, weight, left = None, 1.0, [(0, len(edged))]
        for n in ORDERS:
            weight *= DISCOUNT
            known, rest = self.rows.get(n, {}), []
            for a, b in left:
                if n == 1:  # single letters carry no marks of the edges
                    a, b = max(a, 1), min(b, len(edged) - 1)
                done = a
                for i in range(a, b - n + 1):
                    row = known.get(edged[i : i + n])
                    if row is None:
                        continue
                    total = self.evidence[row] * weight if total is None else total + self.evidence[row] * weight
                    if i > done:
                        rest.append((done, i))
                    done = max(done, i + n)
                if done < b:
                    rest.append((done, b))
            left = rest
        return total


class Scorer(dict):
    """Rows of evidence by word; an unseen word gets its row when it is first met. Row 0 says nothing."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model
        self.known = model.rows.get(0, {})
        self.table = np.zeros((1024, len(model.langs)))
        self.n = 1

    def _reset(self) -> None:
        self.clear()
        self.n = 1

    def __missing__(self, word: str) -> int:
        row = self.known.get(word)
        evidence = self.model.unseen(word) if row is None else self.model.evidence[row]
        if evidence is None:
            self[word] = 0
            return 0
        if self.n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.n] = evidence
        self[word] = self.n
        self.n += 1
        return self.n - 1

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Evidence (texts x languages), words that say something, and words, of each text."""
        total, said, words = np.zeros((len(texts), len(self.model.langs))), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        rows: list[int] = []
        owners: list[int] = []
        starts: list[int] = []

        def flush() -> None:
            if rows:
                at = np.array(rows, np.int64)
                np.add.at(total, owners, np.add.reduceat(self.table[at], starts, axis=0))
                np.add.at(said, owners, np.add.reduceat((at > 0).astype(np.int64), starts))
            rows.clear()
            owners.clear()
            starts.clear()
            if len(self) > UNSEEN_ROWS + len(self.known):
                self._reset()

        look_up = self.__getitem__
        for i, text in enumerate(texts):
            found = words_of(text) if text else []
            words[i] = len(found)
            for a in range(0, len(found), AT_ONCE):
                owners.append(i)
                starts.append(len(rows))
                rows.extend(map(look_up, found[a : a + AT_ONCE]))
                if len(rows) >= AT_ONCE:
                    flush()
        flush()
        return total, said, words

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: the softmax of its evidence by the square root of the words that gave it."""
        if not self.model.langs:
            return [UND] * len(texts), np.zeros(len(texts))
        total, said, words = self.sums(texts)
        x = total / np.sqrt(np.maximum(said, 1))[:, None]
        x = np.exp(x - x.max(axis=1, keepdims=True))
        best = x.argmax(axis=1)
        score = np.where(words > 0, x.max(axis=1) / x.sum(axis=1), 0.0)
        return [self.model.langs[b] if w else UND for b, w in zip(best, words, strict=True)], score


def fit(rows: DataFrame) -> Model:
    """From (doc_id, text, lang) without nulls in doc_id and lang. The sample is stratified without a window over a language."""
    rows = rows.filter(F.length("text") <= LONGEST)
    sizes = rows.groupBy("lang").count().collect()  # a row for each language
    if not sizes:
        return Model([], {}, np.zeros((0, 0)))
    each = min(ROWS_PER_LANG, ROWS / len(sizes))
    rate = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, each / r["count"])))])
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.filter(draw < rate[F.col("lang")]).dropDuplicates(["doc_id", "text", "lang"]).select("text", "lang")
    counts = stage(sample.mapInArrow(_features, "lang string, size int, unit string, n long").groupBy("size", "unit", "lang").agg(F.sum("n").alias("n")), "units")
    totals = {(r["lang"], r["size"]): r["n"] for r in counts.groupBy("lang", "size").agg(F.sum("n").alias("n")).collect()}
    langs = sorted({lang for lang, _ in totals})
    at = F.create_map(*[x for i, lang in enumerate(langs) for x in (F.lit(lang), F.lit(i))]) if langs else None
    if at is None:
        return Model([], {}, np.zeros((0, 0)))
    found = counts.select("size", "unit", at[F.col("lang")].alias("lang"), "n").groupBy("size", "unit").agg(F.sum("n").alias("all"), F.collect_list(F.struct("lang", "n")).alias("by"))
    found = found.filter(F.col("all") >= LEAST).select("size", "unit", "by").toArrow().combine_chunks()
    drop_staged(counts)
    size, unit = found["size"].to_numpy(), found["unit"].to_pylist()
    base = np.array([[totals.get((lang, n), 0) for lang in langs] for n in range(max(ORDERS) + 1)], float)
    evidence = np.full((len(unit), len(langs)), SMOOTHING)
    by = found["by"].chunk(0) if found.num_rows else None
    if by is not None:
        of = np.repeat(np.arange(len(unit)), np.diff(by.offsets.to_numpy()))
        inner = by.flatten()
        evidence[of, inner.field("lang").to_numpy()] += inner.field("n").to_numpy()
    evidence = np.log(evidence / (base[size] + 1.0))
    evidence = (evidence - evidence.mean(axis=1, keepdims=True)).astype(np.float32)
    tables: dict[int, dict[str, int]] = {n: {} for n in (0, *ORDERS)}
    for row, (n, u) in enumerate(zip(size.tolist(), unit, strict=True)):
        tables[n][u] = row
    return Model(langs, tables, evidence)


def _predictions(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            lang, score = scorer.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame) -> DataFrame:
    """Predict the language of every whole text, having learned from rows with a lang outside the hold-out fold.

    Takes doc_id, text and lang (of training rows only); other columns are ignored. Returns doc_id, held_out, lang_pred
    and score (the share of the evidence, 0 to 1), a row for each row. A null text and one without letters (category L)
    are `und` with score 0, and so is every text if there is nothing to learn from. Equal evidence goes to the first
    language by name. A row without doc_id is predicted but not learned from; rows that repeat doc_id, text and lang
    are learned from once. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = fit(docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~fold_is(F.col("doc_id"), 5, 0)))
    out = docs.select("doc_id", "text").mapInArrow(_predictions(model), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", fold_is(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))

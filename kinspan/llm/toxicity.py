"""Toxicity: a Levenshtein automaton run over a lexicon trie, and scores of the hit's context window.

The lexicon is learned from labelled rows: a word enters if it stands in significantly more different contexts (the
words before and after it) of toxic rows than chance allows over the whole vocabulary, so that words of a text which
was merely copied often don't enter. Matching walks the trie with all positions that at most k edits allow, as a
deterministic automaton whose states are made when first met. A misspelling that is a benign word of the training rows
counts by that word's own share of toxic contexts. Each hit is weighted by how often hits of its context class (plain,
reported, quoted) were in toxic rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspan.llm.common import fold_is, read, stage

#: The labelled rows that are learned from: at most so many of each class, by hash of doc_id, of texts of at most LONGEST
#: characters. This bounds the lexicon and the neighbours that the model holds.
TOXIC_ROWS, CLEAN_ROWS, LONGEST = 4000, 8000, 100_000
LEAST_CONTEXTS, CHANCE = 4, 0.01
#: Most weight of a misspelling that no training row holds: that of a term whose known neighbours are in toxic rows only.
#: One such misspelling in plain context passes the threshold.
UNSEEN = 0.45
THRESHOLD, FLOOR = 0.3, 0.01
NEAR, REPORT = 12, 6

#: Look-alike characters, quotation marks, words that report what someone else says.
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": ""})
OPENING, CLOSING = "\"“«„", "\"”»“"
REPORTING = {"said", "says", "quote", "quoted", "wrote", "called", "word", "term", "dijo", "escribió", "palabra", "sagte", "schrieb", "wort", "dit", "écrit", "mot"}
#: Beta priors of a hit being abuse, by context class: (share, strength).
PRIOR = {"plain": (0.95, 4.0), "reported": (0.3, 8.0), "quoted": (0.2, 8.0)}

_TOKEN = re.compile(r"[^\W_]+(?:[@$!*]+[^\W_]+)*")


def budget(length: int) -> int:
    """Edits that a term of this length allows."""
    return 0 if length < 5 else 1 if length < 10 else 2


class Matcher:
    """The product of a Levenshtein automaton and a trie of terms, made state by state."""

    MOST_STATES = 200_000

    def __init__(self, terms: list[str]) -> None:
        self.child: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.most: list[int] = [0]
        for t in terms:
            n, k = 0, budget(len(t))
            self.most[0] = max(self.most[0], k)
            for ch in t:
                if ch not in self.child[n]:
                    self.child[n][ch] = len(self.child)
                    self.child.append({})
                    self.term.append(None)
                    self.most.append(0)
                n = self.child[n][ch]
                self.most[n] = max(self.most[n], k)
            self.term[n] = t
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.step: list[dict[str, int]] = []
        self.accepts: list[tuple[str, int] | None] = []
        self.start = self._state({0: 0})

    def _state(self, at: dict[int, int]) -> int:
        """The id of a set of (node, edits) after adding what skipped letters reach; -1 if it is empty."""
        todo = list(at.items())
        while todo:
            n, e = todo.pop()
            for c in self.child[n].values():
                if e + 1 <= self.most[c] and at.get(c, 99) > e + 1:
                    at[c] = e + 1
                    todo.append((c, e + 1))
        if not at:
            return -1
        key = tuple(sorted(at.items()))
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.step.append({})
            ends = [(e, self.term[n]) for n, e in key if self.term[n] is not None and e <= budget(len(self.term[n]))]
            self.accepts.append((min(ends)[1], min(ends)[0]) if ends else None)
        return self.ids[key]

    def _move(self, s: int, ch: str) -> int:
        at: dict[int, int] = {}
        for n, e in self.sets[s]:
            for c, node in self.child[n].items():
                cost = e + (c != ch)
                if cost <= self.most[node] and at.get(node, 99) > cost:
                    at[node] = cost
            if e + 1 <= self.most[n] and at.get(n, 99) > e + 1:
                at[n] = e + 1
        return self._state(at)

    def find(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its budget and the edits, or None."""
        if len(self.sets) > self.MOST_STATES:
            self._reset()
        s, step = self.start, self.step
        for ch in word:
            nxt = step[s].get(ch)
            if nxt is None:
                nxt = step[s][ch] = self._move(s, ch)
            if nxt < 0:
                return None
            s = nxt
        return self.accepts[s]


def _spelled(token: str) -> str:
    return token if token.isalpha() else token.translate(LOOKALIKE)


def context_class(tokens: list[re.Match], i: int, text: str) -> str:
    """quoted: marks open before and close after the hit, in one line and NEAR tokens; reported: a reporting word just before."""
    a, b = tokens[max(0, i - NEAR)].start(), tokens[min(len(tokens) - 1, i + NEAR)].end()
    before = text[a : tokens[i].start()].rpartition("\n")[2]
    after = text[tokens[i].end() : b].partition("\n")[0]
    straight = before.count('"') % 2 == 1 and '"' in after
    curly = any(before.rfind(o) > before.rfind(c) and c in after for o, c in zip(OPENING[1:], CLOSING[1:], strict=True))
    if straight or curly:
        return "quoted"
    return "reported" if any(t[0] in REPORTING for t in tokens[max(0, i - REPORT) : i]) else "plain"


def hits(text: str, matcher: Matcher, known: dict[str, float], unseen: dict[str, float]) -> list[tuple[float, str]]:
    """(weight, context class) of each hit in the text."""
    lowered = text.lower()
    weight: dict[str, float] = {}
    for token in set(_TOKEN.findall(lowered)):
        word = _spelled(token)
        if word in known:
            w = known[word]
        elif near := matcher.find(word):
            w = unseen[near[0]]
        else:
            continue
        if w > 0.02:
            weight[token] = w
    if not weight:
        return []
    tokens = list(_TOKEN.finditer(lowered))
    return [(weight[t[0]], context_class(tokens, i, lowered)) for i, t in enumerate(tokens) if t[0] in weight]


def score(found: list[tuple[float, str]], share: dict[str, float]) -> float:
    clean = 1.0 - FLOOR
    for w, kind in found:
        clean *= 1.0 - w * share[kind]
    return 1.0 - clean if found else FLOOR


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (text, toxic): each word with a hash of its neighbours, once a row."""
    for batch in batches:
        words, contexts, labels = [], [], []
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            tokens = ["", *(_spelled(t) for t in _TOKEN.findall(text.lower())), ""]
            seen = {(w, zlib.crc32(f"{p} {n}".encode())) for p, w, n in zip(tokens, tokens[1:], tokens[2:]) if len(w) >= 3}
            words += [w for w, _ in seen]
            contexts += [c for _, c in seen]
            labels += [toxic] * len(seen)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(contexts, pa.int64()), pa.array(labels, pa.int32())], ["word", "context", "toxic"])


def fit(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], dict[str, float], dict[str, float]]:
    """From labelled documents: weights of known words, of unseen misspellings by term, each context class's share of abuse."""
    labels = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    heavier = max(1.0, sizes.get(0, 0) / CLEAN_ROWS) / max(1.0, sizes.get(1, 0) / TOXIC_ROWS)
    chosen = None
    for label, most in ((1, TOXIC_ROWS), (0, CLEAN_ROWS)):
        part = labels.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = F.broadcast(stage(chosen.select(F.col("doc_id").alias("of"), "toxic"), "labels"))
    rows = docs.filter(F.coalesce(F.length("text"), F.lit(0)) <= LONGEST).join(chosen, F.col("doc_id") == F.col("of")).select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))
    pairs = rows.mapInArrow(_contexts, "word string, context long, toxic int")
    one = pairs.groupBy("word", "context").agg(F.max("toxic").alias("t"), F.max(1 - F.col("toxic")).alias("c"))
    counts = stage(one.groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c")), "words")
    total_t, total_c, vocabulary = counts.agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("t") > 0)).first()
    if not total_t:
        return {}, {}, {k: p for k, (p, _) in PRIOR.items()}
    prior = total_t / (total_t + total_c + 1)

    def precision(t: int, c: int) -> float:
        """The share of toxic rows among all labelled rows with the word, not only among those learned from."""
        return t / (t + (c + 0.25) * heavier)

    t, c = F.col("t"), F.col("c")
    gain = t * F.log(t / (t + c) / F.lit(prior)) + F.when(c > 0, c * F.log(c / (t + c) / F.lit(1 - prior))).otherwise(0.0)
    good = (t >= LEAST_CONTEXTS) & (gain >= math.log(max(vocabulary, 1) / CHANCE)) & (t * total_c > 20 * c * total_t)
    terms = {r.word: precision(r.t, r.c) for r in counts.filter(good).collect()}
    lexicon = sorted(terms)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, exact = Matcher(lexicon), set(lexicon)
        for batch in batches:
            yield batch.filter(pa.array([w not in exact and matcher.find(w) is not None for w in batch.column(0).to_pylist()], pa.bool_()))

    near = counts.mapInArrow(neighbours, counts.schema).collect()

    # an unseen misspelling counts as far as its term's known neighbours were in toxic rows rather than in clean ones
    matcher = Matcher(lexicon)
    of = {r.word: matcher.find(r.word)[0] for r in near}
    around = {term: [0, 0] for term in lexicon}
    for r in near:
        around[of[r.word]][0] += r.t
        around[of[r.word]][1] += r.c
    unseen = {term: UNSEEN * (max(0.0, (t * total_c - c * total_t) / (t * total_c + c * total_t)) if c else 1.0) for term, (t, c) in around.items()}

    def neighbour(word: str, t: int, c: int) -> float:
        """A neighbour that clean rows hold is benign, unless toxic rows hold it far more often."""
        return unseen[of[word]] if not c else precision(t, c) if t >= LEAST_CONTEXTS and t * total_c > 20 * c * total_t else 0.0

    known = {r.word: neighbour(r.word, r.t, r.c) for r in near} | terms

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            out = [(kind, toxic) for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for kind in {k for _, k in hits(text, matcher, known, unseen)}]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int32())], ["kind", "toxic"])

    seen = {r.kind: (r.t, r.n) for r in rows.mapInArrow(classes, "kind string, toxic int").groupBy("kind").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    share = {k: (seen.get(k, (0, 0))[0] + p * s) / (seen.get(k, (0, 0))[1] + s) for k, (p, s) in PRIOR.items()}
    return known, unseen, share


def _scores(known: dict[str, float], unseen: dict[str, float], share: dict[str, float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sorted(unseen))
        for batch in batches:
            found = [hits(t, matcher, known, unseen) if t else [] for t in batch.column(batch.num_columns - 1).to_pylist()]
            value, n = pa.array([score(f, share) for f in found], pa.float64()), pa.array([len(f) for f in found], pa.int32())
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), value, n], [*names, "score", "n_hits"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Score every whole text; learn from labels.toxic of documents outside the hold-out fold.

    `docs` needs doc_id and text, `labels` doc_id and toxic; other columns are ignored, but those named in `carry` are
    returned as well. Returns doc_id, held_out, predicted (score >= 0.3), the carried columns, score and n_hits, a row
    for each row. A null or empty text scores FLOOR. Labels that contradict each other count as toxic. Without any
    toxic label nothing is found and all score FLOOR. A row without doc_id is scored but not learned from.
    """
    carry = carry or []
    learn = labels.select("doc_id", "toxic").filter(~fold_is(F.col("doc_id"), 4, 2))
    model = fit(docs.select("doc_id", "text"), learn)
    scored = docs.select("doc_id", *carry, F.col("text").alias("scored_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scored.schema.fields[:-1])
    out = scored.mapInArrow(_scores(*model), f"{schema}, score double, n_hits int")
    return out.withColumns({"held_out": fold_is(F.col("doc_id"), 4, 2), "predicted": (F.col("score") >= THRESHOLD).cast("int")})


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", "n_hits")

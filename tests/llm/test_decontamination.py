"""Leaks: brute force over token lists, re-parameterised items, odd rows."""

import random

from kinspan.llm import decontamination as m
from kinspan.llm.decontamination import COVERAGE, LITERALS, RUN, WINDOW, Tokens, Words, check_pair, contaminated, op4_decontamination

DOCS = "doc_id long, text string, hash string, place int"
ITEMS = "item_id long, text string, row string"


def frames(spark, docs, items):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], DOCS), spark.createDataFrame([(i, t, "clash") for i, t in items], ITEMS)


def found(spark, docs, items):
    return {(r.doc_id, r.item_id): r.reparameterised for r in contaminated(*frames(spark, docs, items)).collect()}


def template(text):
    """(literal, template, slot text or None) of each word, one by one."""
    out, end, number = [], True, False
    for token in text.replace("\n", " | ").split():
        word = token.strip(m._EDGE)
        low = word.lower()
        kind = None
        if m._NUMBER.fullmatch(low):
            kind = "#"
        elif low in m.UNITS and number:
            kind = "unit"
        elif word[:1].isupper() and word[1:].islower() and not (end and low in m.FUNCTION_WORDS):
            kind = "name"
        end, number = token[-1] in ".!?:|" or not word, bool(m._NUMBER.fullmatch(low))
        if word:
            out.append((low, f"<{kind}>" if kind else low, word if kind else None))
    return out


def brute(docs, items):
    def windows(text, width):
        words = template(text)
        for p in range(len(words) - width + 1):
            w = words[p : p + width]
            exact = sum(x[2] is None for x in w) < min(LITERALS, width)
            yield p, (width, exact, tuple(x[0 if exact else 1] for x in w)), [x[2] for x in w]

    out = set()
    for item, text in items:
        width = min(WINDOW, len(template(text or "")))
        whole = list(windows(text, width)) if width else []
        whole = [w for w in whole if not w[1][1]] or whole
        keys = {k for _, k, _ in whole}
        if not keys:
            continue
        for doc, body in docs:
            rows = [(k, p, q, sum(x[1] == k for x in whole), mine, its) for p, k, mine in windows(body or "", width) for q, key, its in whole if key == k and q == min(x[0] for x in whole if x[1] == k)]
            n, run, differs = check_pair(len(keys), rows)
            if run or n >= COVERAGE * len(keys):
                out.add((doc, item, differs))
    return out


def test_words_match_brute_force():
    texts = ["Alice has 3 apples. Bob gives Alice 4 kg more!\nHow many? \"Quote\" -- 5 km", "", "The End", "One. two 7 days; US: 9"]
    words = Words(texts, Tokens())
    for i, t in enumerate(texts):
        a, b = words.first[i], words.first[i + 1]
        want = template(t)
        assert [words.slots(p, 1)[0] for p in range(a, b)] == [w[2] for w in want]
        assert [int(x) for x in words.literal[a:b]] == [m.xxhash.xxh64_intdigest(w[0]) for w in want]


ITEM = "Alice has 3 apples. Bob gives Alice 4 more apples. How many apples does Alice have now?"
OTHER = "Carol has 8 apples. Dave gives Carol 2 more apples. How many apples does Carol have now?"
BROKEN = "Carol has 8 apples. Dave gives Erin 2 more apples. How many apples does Frank have now?"


def test_names_at_the_start_of_a_sentence(spark):
    docs = [(1, f"Some words. {ITEM} And more."), (2, f"Some words. {OTHER} And more."), (3, BROKEN), (4, "How many apples does a tree have now?"), (5, OTHER.split(". ")[0])]
    assert found(spark, docs, [(7, ITEM)]) == {(1, 7): False, (2, 7): True}


def test_long_runs_and_items_of_placeholders(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    long = [word() for _ in range(120)]
    docs = [(1, " ".join(long[30:70])), (2, " ".join(long[:20])), (3, "and 9 8 7 6 5 4 then"), (4, "9 8 7 6 5 3")]
    assert found(spark, docs, [(1, " ".join(long)), (2, "9 8 7 6 5 4"), (3, "yes")]) == {(1, 1): False, (3, 2): False}
    assert RUN <= 36


def test_recall_on_reparameterised_items(spark):
    r = random.Random(5)
    names = "Alice Bob Carol Dave Erin Frank Grace Heidi Ivan Judy Mallory Niaj Olivia Peggy Rupert Sybil".split()
    literal = ["".join(r.choice("abcdefghijk") for _ in range(r.randint(3, 8))) for _ in range(400)]

    def item():
        parts, words = [], []
        for _ in range(r.randint(2, 4)):
            words = [r.choice(literal) for _ in range(r.randint(4, 9))]
            words.insert(0, "{n%d}" % r.randint(0, 1))
            words.insert(r.randint(2, len(words)), "{v%d} kg" % r.randint(0, 2) if r.random() < 0.3 else "{v%d}" % r.randint(0, 2))
            parts.append(" ".join(words) + ".")
        return " ".join(parts)

    def fill(t):
        chosen = r.sample(names, 2)
        numbers = r.sample(range(2, 900), 3)
        return t.format(n0=chosen[0], n1=chosen[1], v0=numbers[0], v1=numbers[1], v2=numbers[2])

    shapes = [item() for _ in range(200)]
    items = [(i, fill(t)) for i, t in enumerate(shapes)]
    filler = lambda: " ".join(r.choice(literal) for _ in range(30))
    docs = [(i, f"{filler()}. {fill(t)} {filler()}.") for i, t in enumerate(shapes)] + [(1000 + i, filler()) for i in range(100)]
    got = found(spark, docs, items)
    right = sum((i, i) in got for i in range(len(shapes)))
    print("recall", right / len(shapes), "pairs beside", len(got) - right)
    assert right >= 0.9 * len(shapes) and not any(d >= 1000 for d, _ in got) and len(got) - right <= 0.05 * right


def test_matches_brute_force(spark):
    r = random.Random(9)
    base = [f"{r.choice(['Anna', 'Karl', 'The', 'so'])} {' '.join(r.choice('ab bc cd de ef fg Paul 12 7 kg'.split()) for _ in range(r.randint(0, 14)))}{r.choice(['.', '', '?'])}" for _ in range(40)]
    items = [(i, " ".join(r.sample(base, r.randint(1, 2)))) for i in range(25)] + [(90, "kg"), (91, "ab bc"), (92, "ab " * 20)]
    docs = [(i, " ".join(r.choice([*base, items[r.randrange(25)][1]]) for _ in range(4))) for i in range(40)]
    got = {(x.doc_id, x.item_id, x.reparameterised) for x in contaminated(*frames(spark, docs, items)).collect()}
    assert got == brute(docs, items)


def test_odd_rows(spark):
    docs = [(None, ITEM), (1, None), (2, ""), (3, ITEM), (3, ITEM), (4, "x " * 200_000 + ITEM), (5, ITEM), (5, OTHER)]
    got = sorted((r.doc_id or 0, r.item_id or 0, r.reparameterised) for r in contaminated(*frames(spark, docs, [(1, ITEM), (1, ITEM), (None, ITEM), (2, None), (3, "")])).collect())
    one = [(0, False), (3, False), (4, False), (5, False), (5, True)]
    assert got == sorted((d, i, x) for d, x in one for i in (0, 1))
    assert found(spark, docs, []) == {} and found(spark, [], [(1, ITEM)]) == {}


def test_query_on_tables(spark):
    sf = "/root/testdata/sf0.001"
    got = {(r.doc_id, r.item_id, r.reparameterised) for r in op4_decontamination(spark, sf).collect()}
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet").select(i, "text").collect() for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert got == brute(docs, items) and got

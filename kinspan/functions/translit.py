"""Transliteration of Indic scripts to Latin with diacritics.

The nine blocks are laid out alike: a letter's offset in its block is the same sound in each. So one table by offset
serves all, with exceptions by character. A consonant carries an `a` unless a vowel sign or virama follows. Python is
unavoidable here (runs of a state machine over characters), but only texts with Indic characters reach it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kinspan.functions.fixed import INDIC_BLOCKS

# Sounds by offset in a block.
VOWELS = dict(zip([0x05, 0x06, 0x07, 0x08, 0x09, 0x0A, 0x0B, 0x0C, 0x0E, 0x0F, 0x10, 0x12, 0x13, 0x14, 0x60, 0x61], "a ā i ī u ū ṛ ḷ e e ai o o au ṝ ḹ".split(), strict=True))
CONSONANTS = dict(zip(range(0x15, 0x3A), "k kh g gh ṅ c ch j jh ñ ṭ ṭh ḍ ḍh ṇ t th d dh n n p ph b bh m y r r l ḻ ḻ v ś ṣ s h".split(), strict=True))
SIGNS = dict(zip([0x3E, 0x3F, 0x40, 0x41, 0x42, 0x43, 0x44, 0x46, 0x47, 0x48, 0x4A, 0x4B, 0x4C, 0x62, 0x63], "ā i ī u ū ṛ ṝ e e ai o o au ḷ ḹ".split(), strict=True))
MARKS = {0x01: "m̐", 0x02: "ṃ", 0x03: "ḥ", 0x3D: "'", 0x50: "oṃ", 0x70: "ṃ"}
NUKTA, VIRAMA = 0x3C, 0x4D

# Characters that stand for themselves whatever their block's layout.
EXCEPTIONS = {
    "ऑ": "o", "ॉ": "o", "ऍ": "e", "ॅ": "e", "ॲ": "a",
    "ൺ": "nn", "ൻ": "n", "ർ": "r", "ൽ": "l", "ൾ": "ll", "ൿ": "k",
    "௰": "10", "௱": "100", "௲": "1000", "ୱ": "w", "ൎ": "r", "ੱ": "",
}
#: Tamil writes one letter for voiced, voiceless and aspirated stops; these are the readings wanted.
TAMIL = {0x15: "gh", 0x1A: "c", 0x1F: "ḍh", 0x24: "dh", 0x2A: "bh", 0x29: "n", 0x31: "r", 0x34: "zh"}
INDIC = r"[\x{0900}-\x{0D7F}]"


def transliterate_text(text: str) -> str:
    out: list[str] = []
    inherent = False  # whether the last consonant still carries its `a`
    for ch in text:
        code = ord(ch)
        block = next((n for n, (a, b) in INDIC_BLOCKS.items() if a <= code <= b), None)
        at = code - INDIC_BLOCKS[block][0] if block else None
        if ch in EXCEPTIONS and block:
            if at in (0x45, 0x49):
                inherent = False
            if inherent:
                out.append("a")
            inherent = False
            out.append(EXCEPTIONS[ch])
            continue
        if at == NUKTA:
            continue
        if at == VIRAMA or at in SIGNS:
            out.append("" if at == VIRAMA else SIGNS[at])
            inherent = False
            continue
        if inherent:
            out.append("a")
            inherent = False
        if at is None:
            out.append(ch)
        elif at in CONSONANTS:
            out.append(TAMIL.get(at, CONSONANTS[at]) if block == "Tamil" else CONSONANTS[at])
            inherent = True
        elif 0x66 <= at <= 0x6F:
            out.append(str(at - 0x66))
        elif at in (0x64, 0x65):
            out.append("|" * (at - 0x63))
        else:
            out.append(VOWELS.get(at) or MARKS.get(at, ""))
    return "".join(out) + ("a" if inherent else "")


@F.pandas_udf(StringType())
def _transliterate(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else transliterate_text(t), na_action="ignore")


def transliterate(c: Column) -> Column:
    """Latin form of texts with Indic characters, others unchanged; the UDF gets a null for those."""
    return F.coalesce(_transliterate(F.when(c.rlike(INDIC), c)), c)

"""Text functions, Column -> Column. Python's \\w is [\\p{L}\\p{N}_] here; nulls pass through unless stated."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinspan.functions.fixed import ADDRESS_NUMBER, BUSINESS_TERMS, COUNTRIES, INDIC_BLOCKS, LEGAL_SUFFIXES, NUMERIC_TOKEN, PIN_CODE, SCRIPT_LANGUAGE, SENTINELS, STOPWORDS, ZIP_CODE

LATIN = r"[A-Za-z\x{00C0}-\x{024F}\x{1E00}-\x{1EFF}]"
LETTER = r"[\p{L}\p{M}]"


def _composed() -> tuple[str, str]:
    """Characters whose decomposition is one base character and non-spacing marks, and those bases."""
    source, target = [], []
    for code in range(0xC0, min(sys.maxunicode, 0x1FFFF)):
        parts = unicodedata.normalize("NFD", chr(code))
        base = unicodedata.normalize("NFC", "".join(c for c in parts if unicodedata.category(c) != "Mn"))
        if len(parts) > 1 and len(base) == 1 and base != chr(code) and code < 0x10000:
            source.append(chr(code))
            target.append(base)
    return "".join(source), "".join(target)


COMPOSED, BASES = _composed()


def ascii_only(c: Column) -> Column:
    return ~c.rlike(r"[^\x00-\x7F]")


def squeeze(c: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " "))


def blank(c: Column) -> Column:
    return c.isNull() | (squeeze(c) == "")


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


# scripts and languages


def _script_class(script: str) -> str:
    if script == "Latin":
        return LATIN
    a, b = INDIC_BLOCKS[script]
    return rf"[\p{{L}}\p{{M}}&&[\x{{{a:04x}}}-\x{{{b:04x}}}]]"


SCRIPTS = ["Latin", *INDIC_BLOCKS]
_KNOWN = r"[A-Za-z\x{00C0}-\x{024F}\x{1E00}-\x{1EFF}" + "".join(rf"\x{{{a:04x}}}-\x{{{b:04x}}}" for a, b in INDIC_BLOCKS.values()) + "]"
OTHER = rf"[\p{{L}}\p{{M}}&&[^{_KNOWN[1:-1]}]]"


def script_counts(c: Column) -> Column:
    """Map of script to its number of letters and marks, without zeros."""
    names = [*SCRIPTS, "Other"]
    counts = [F.regexp_count(F.coalesce(c, F.lit("")), F.lit(OTHER if n == "Other" else _script_class(n))) for n in names]
    return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*counts)), lambda _, v: v > 0)


def script(c: Column) -> Column:
    """The only script of the letters and marks; Mixed if there are several, Unknown if none."""
    names = [*SCRIPTS, "Other"]
    text = F.coalesce(c, F.lit(""))
    plain = F.when(text.rlike("[A-Za-z]"), F.lit("Latin")).otherwise(F.lit("Unknown"))
    found = F.filter(F.array(*[F.when(text.rlike(OTHER if n == "Other" else _script_class(n)), F.lit(n)) for n in names]), lambda x: x.isNotNull())
    several = F.when(F.size(found) == 0, F.lit("Unknown")).when(F.size(found) == 1, F.get(found, F.lit(0))).otherwise(F.lit("Mixed"))
    return F.when(ascii_only(text), plain).otherwise(several)


def script_details(c: Column) -> Column:
    """Struct: script, dominant (the most frequent; at ties the one met first), counts, shares (4 digits), total, is_mixed."""
    counts, text = script_counts(c), F.coalesce(c, F.lit(""))
    total = F.aggregate(F.map_values(counts), F.lit(0), lambda a, x: a + x)
    cases = [*[(n, _script_class(n)) for n in SCRIPTS], ("Other", OTHER)]
    met = [F.when(text.rlike(p), F.length(F.regexp_extract(text, rf"(?s)^(.*?){p}", 1))).otherwise(F.lit(2**30)) for _, p in cases]
    order = F.array_sort(F.array(*[F.struct((-F.coalesce(F.try_element_at(counts, F.lit(n)), F.lit(0))).alias("n"), at.alias("at"), F.lit(n).alias("name")) for (n, _), at in zip(cases, met, strict=True)]))
    dominant = F.when(total == 0, F.lit("Unknown")).otherwise(F.get(order, F.lit(0))["name"])
    shares = F.transform_values(counts, lambda _, v: F.bround(v.cast("double") / total, 4))
    return F.struct(script(c).alias("script"), dominant.alias("dominant"), counts.alias("counts"), shares.alias("shares"), total.alias("total"), (F.size(counts) > 1).alias("is_mixed"))


def language(text: Column, of_script: Column) -> Column:
    """The language a script stands for; null for blank text and scripts without one."""
    return F.when(~blank(text), literal_map(SCRIPT_LANGUAGE)[of_script])


# normalisation


def strip_diacritics(c: Column) -> Column:
    return F.when(ascii_only(c), c).otherwise(F.regexp_replace(F.translate(c, COMPOSED, BASES), r"\p{Mn}", ""))


def normalize_text(c: Column, strip_punctuation: bool = False, keep_safe: bool = True) -> Column:
    """Lower case without diacritics; punctuation to spaces if asked (but - / & # ' if keep_safe); blank becomes ''."""
    text = F.lower(strip_diacritics(c))
    if strip_punctuation:
        text = F.regexp_replace(text, r"[^\p{L}\p{N}_\s\-/&#']" if keep_safe else r"[^\p{L}\p{N}_\s]", " ")
    return squeeze(text)


def business_vocabulary(c: Column) -> Column:
    terms = literal_map(BUSINESS_TERMS)
    return F.array_join(F.transform(F.split(squeeze(c), " "), lambda t: F.coalesce(terms[t], t)), " ")


#: All rules at once: where several match, an earlier rule's match is the longer one, so it is the leftmost.
ANY_SUFFIX = r"(?i)\b(?:" + "|".join(pattern for pattern, _ in LEGAL_SUFFIXES) + r")\b\.?$"


def legal_suffix_applied(c: Column) -> Column:
    """The suffix at the name's end in canonical form; the first rule that matches is the only one.

    One pattern finds the suffix; the rules then look at the suffix alone.
    """
    name = F.trim(F.regexp_replace(c, r"[,.\s]+$", ""))
    found = F.regexp_extract(name, ANY_SUFFIX, 0)
    canonical = F.lit("")
    for pattern, form in reversed(LEGAL_SUFFIXES):
        canonical = F.when(found.rlike(rf"(?i)^(?:{pattern})\.?$"), F.lit(form)).otherwise(canonical)
    return F.when(found == "", name).otherwise(squeeze(F.concat(F.left(name, F.length(name) - F.length(found)), canonical)))


def business_name(name: Column, transliterated: Column | None = None) -> Column:
    """Normalised business name of the transliterated form if there is one; '' for none."""
    chosen = name if transliterated is None else F.coalesce(transliterated, name)
    text = normalize_text(chosen, strip_punctuation=True)
    return F.when(blank(chosen), F.lit("")).otherwise(legal_suffix_applied(business_vocabulary(text)))


def name_tokens(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}_&/-]+"), lambda t: t != "")


def address(addr: Column, transliterated: Column | None = None) -> Column:
    chosen = addr if transliterated is None else F.coalesce(transliterated, addr)
    text = F.regexp_replace(normalize_text(chosen), r"\bno[.:]\b", "no")
    text = squeeze(F.regexp_replace(text, r"[^\p{L}\p{N}_\s\-/&#]", " "))
    return F.when(blank(chosen), F.lit("")).otherwise(F.btrim(text, F.lit(" -/,&#")))


def address_tokens(c: Column) -> Column:
    parts = F.split(squeeze(F.coalesce(c, F.lit(""))), " ")
    return F.filter(F.transform(parts, lambda t: F.btrim(t, F.lit(" ,.;:"))), lambda t: t != "")


def country(c: Column) -> Column:
    text = normalize_text(c, strip_punctuation=True, keep_safe=False)
    return F.coalesce(literal_map(COUNTRIES)[text], text)


# tokens, numbers, codes


def is_stopword(c: Column) -> Column:
    return c.isin(STOPWORDS)


def meaningful_tokens(c: Column, least: int = 2) -> Column:
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(F.transform(name_tokens(c), lambda t: F.trim(F.lower(t))), lambda t: (F.length(t) >= least) & ~F.array_contains(stop, t))


def address_number(c: Column) -> Column:
    """The first number of an address that isn't a bare five or six digit code; null if none."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(ADDRESS_NUMBER), F.lit(1))
    return F.get(F.filter(found, lambda x: ~x.rlike(r"^\d{5,6}$")), F.lit(0))


def numeric_tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(NUMERIC_TOKEN), F.lit(0)))


def postal_code(addr: Column, of_country: Column) -> Column:
    """The last PIN or ZIP code; not the first token, unless the address is that token alone."""
    text = squeeze(F.coalesce(addr, F.lit("")))
    first = F.get(F.split(text, " "), F.lit(0))
    alone = ~text.contains(" ")

    def last(pattern: str) -> Column:
        return F.try_element_at(F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda m: alone | (m != first)), F.lit(-1))

    return F.when(of_country == "india", last(PIN_CODE)).when(of_country == "united states", last(ZIP_CODE)).otherwise(F.coalesce(last(r"\b(\d{6})\b"), last(r"\b(\d{5})\b")))


def legal_suffix(c: Column) -> Column:
    """The canonical suffix that is the name's last token(s), or null."""
    found = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?:^| )(pvt ltd|plc|ltd|llc|llp|inc|corp|co)$", 1)
    return F.when(found != "", found)


def ngrams(c: Column, n: int = 3) -> Column:
    """Distinct character n-grams of the text between two spaces; the whole if it is shorter; none of an empty text."""
    text = F.coalesce(c, F.lit(""))
    padded = F.concat(F.lit(" "), F.trim(F.lower(text)), F.lit(" "))
    size = F.length(padded)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), lambda i: F.substring(padded, i, F.lit(n)))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def gram_codes(grams: Column) -> Column:
    """Each n-gram of at most three characters as a number: 21 bits a character, all set for none. Exact, and sets of numbers meet faster."""

    def point(g: Column, i: int) -> Column:
        return F.when(F.length(g) >= i, F.ascii(F.substring(g, i, 1)).cast("long")).otherwise(F.lit(0x1FFFFF))

    return F.transform(grams, lambda g: F.shiftleft(point(g, 1), 42).bitwiseOR(F.shiftleft(point(g, 2), 21)).bitwiseOR(point(g, 3)))


def acronym(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: F.left(t, F.lit(1))), "")


# similarities of sets, with empty sets alike (1.0) as in profiling or without evidence (0.0) as in pair features


def _sizes(a: Column, b: Column, shared: Column | None = None) -> tuple[Column, Column, Column]:
    """Sizes of the intersection (`shared`, if it is known), of a and of b."""
    both = F.size(F.array_intersect(a, b)) if shared is None else shared
    return both.cast("double"), F.size(a).cast("double"), F.size(b).cast("double")


def jaccard(a: Column, b: Column, empty: float = 1.0, shared: Column | None = None) -> Column:
    both, x, y = _sizes(a, b, shared)
    return F.when(x + y == 0, F.lit(empty)).otherwise(both / (x + y - both))


def overlap(a: Column, b: Column, empty: float = 1.0, shared: Column | None = None) -> Column:
    both, x, y = _sizes(a, b, shared)
    return F.when(x + y == 0, F.lit(empty)).when(F.least(x, y) == 0, F.lit(0.0)).otherwise(both / F.least(x, y))


def dice(a: Column, b: Column, empty: float = 1.0, shared: Column | None = None) -> Column:
    both, x, y = _sizes(a, b, shared)
    return F.when(x + y == 0, F.lit(empty)).otherwise(2 * both / (x + y))


def ngram_jaccard(a: Column, b: Column, n: int = 3) -> Column:
    one = F.when(a.isNull() != b.isNull(), F.lit(0.0))
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).otherwise(F.coalesce(one, jaccard(ngrams(a, n), ngrams(b, n))))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    x, y = F.lower(squeeze_ends(F.coalesce(a, F.lit("")))), F.lower(squeeze_ends(F.coalesce(b, F.lit(""))))
    most = F.greatest(F.length(x), F.length(y)).cast("double")
    return F.when(most == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.levenshtein(x, y) / most))


def squeeze_ends(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def missing(c: Column) -> Column:
    return c.isNull() | F.lower(squeeze_ends(c)).isin(SENTINELS)


def source_of_id(c: Column) -> Column:
    """The source of an id S2-... or S3-..., also written with an underscore; else unknown."""
    return F.when(c.rlike("^S2[-_]"), "source2").when(c.rlike("^S3[-_]"), "source3").otherwise("unknown")


def key_label(c: Column) -> Column:
    """The bare label of a blocking key such as key_C||..., null if it is none of A, C, D, E, F."""
    bare = F.regexp_replace(F.upper(F.trim(F.split_part(F.trim(c), F.lit("||"), F.lit(1)))), "^KEY_", "")
    return F.when(bare.isin("A", "C", "D", "E", "F"), bare)

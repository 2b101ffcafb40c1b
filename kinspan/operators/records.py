"""Record-level transforms: raw entity rows to the 16 processed columns, blocking keys and comparison columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspan.functions import text as T
from kinspan.functions.translit import INDIC, transliterate

RAW = ["entity_id", "business_name", "business_address", "country"]
PROCESSED_SCHEMA = (
    "source string, entity_id string, business_name string, business_name_script string, business_name_language string, "
    "business_name_transliterated string, business_name_normalized string, business_name_tokens array<string>, "
    "business_address string, business_address_script string, business_address_language string, "
    "business_address_transliterated string, business_address_normalized string, business_address_tokens array<string>, "
    "country string, country_normalized string"
)
PROCESSED = [f.strip().split(" ")[0] for f in PROCESSED_SCHEMA.split(", ")]


def process(raw: DataFrame, indic: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """source + RAW columns to PROCESSED. A blank name, address or country nulls its whole group of columns.

    With indic=False texts are taken to hold no Indic characters and no Python runs at all. Other columns go, but those
    named in `carry`.
    """

    # one projection a step: what a later step uses twice is an attribute there and not computed again
    names = ("business_name", "business_address")
    normal = {"business_name": T.business_name, "business_address": T.address}
    tokens = {"business_name": T.name_tokens, "business_address": T.address_tokens}
    out = raw.withColumns({n: F.when(~T.blank(F.col(n)), F.col(n)) for n in (*names, "country")})
    out = out.withColumns({f"{n}_script": F.when(F.col(n).isNotNull(), T.script(F.col(n))) for n in names} | {f"{n}_transliterated": transliterate(F.col(n)) if indic else F.col(n) for n in names})
    out = out.withColumns(
        {f"{n}_language": T.language(F.col(n), F.col(f"{n}_script")) for n in names}
        | {f"{n}_normalized": F.when(F.col(n).isNotNull(), normal[n](F.col(n), F.col(f"{n}_transliterated"))) for n in names}
        | {"country_normalized": F.when(F.col("country").isNotNull(), T.country(F.col("country")))}
    )
    out = out.withColumns({f"{n}_tokens": F.when(F.col(n).isNotNull(), tokens[n](F.col(f"{n}_normalized"))) for n in names})
    return out.select(*PROCESSED, *[c for c in carry if c in raw.columns])


def blocking_keys(processed: DataFrame) -> DataFrame:
    """Adds key_A to key_F (label||country||payload, null without country or payload), has_addr and has_addr_num."""
    country = F.col("country_normalized")
    present = ~T.blank(country)
    # a step of their own, for several keys use them
    processed = processed.withColumns({"_meaningful": T.meaningful_tokens(F.col("business_name_normalized")), "_number": T.address_number(F.col("business_address_normalized"))})
    tokens, number = F.col("_meaningful"), F.col("_number")
    first, second = F.get(tokens, F.lit(0)), F.get(tokens, F.lit(1))

    def key(label: str, *payload: Column) -> Column:
        whole = present
        for p in payload:
            whole = whole & ~T.blank(p)
        return F.when(whole, F.concat_ws("||", F.lit(label), country, *payload))

    return processed.withColumns(
        {
            "key_A": key("A", F.col("business_name_normalized")),
            "key_B": key("B", F.lower(F.trim("business_name_transliterated"))),
            "key_C": key("C", first, second),
            "key_D": key("D", first, number),
            "key_E": F.when(number.isNull(), key("E", first)),
            "key_F": key("F", F.col("business_address_normalized")),
            "has_addr": ~T.blank(F.col("business_address_normalized")),
            "has_addr_num": number.isNotNull(),
        }
    ).drop("_meaningful", "_number")


def representations(processed: DataFrame) -> DataFrame:
    """Adds the columns that pair features compare, once for each entity.

    Explicit tokens are respected, also empty ones; null tokens are taken from the normalised text. Token sets leave out
    blank and sentinel tokens and repeats; token counts keep repeats.
    """

    def clean(tokens: Column, text: Column) -> Column:
        return F.filter(F.coalesce(tokens, F.split(T.squeeze(text), " ")), lambda t: ~T.missing(t))

    text = {
        "n_text": F.when(~T.missing(F.col("business_name_normalized")), T.squeeze(F.col("business_name_normalized"))).otherwise(""),
        "a_text": F.when(~T.missing(F.col("business_address_normalized")), T.squeeze(F.col("business_address_normalized"))).otherwise(""),
    }
    name, addr = F.col("n_text"), F.col("a_text")
    tokens = {
        "_names": clean(F.col("business_name_tokens"), name),
        "_addrs": F.when(addr == "", F.array().cast("array<string>")).otherwise(clean(F.col("business_address_tokens"), addr)),
    }
    names = F.col("_names")
    return (
        processed.withColumns(text)
        .withColumns(tokens)
        .withColumns(
            {
                "n_translit": F.when(~T.missing(F.col("business_name_transliterated")), F.lower(F.trim("business_name_transliterated"))),
                "n_set": F.array_distinct(names),
                "n_count": F.size(names),
                "n_grams": T.ngrams(name),
                "n_first": F.when(name != "", F.get(F.split(name, " "), F.lit(0))),
                "n_acronym": T.acronym(names),
                "n_suffix": T.legal_suffix(name),
                "a_set": F.array_distinct("_addrs"),
                "a_grams": T.ngrams(addr),
                "a_numbers": T.numeric_tokens(addr),
                "a_number": T.address_number(addr),
                "a_postal": T.postal_code(addr, F.coalesce("country_normalized", F.lit(""))),
                "a_missing": addr == "",
                "c_text": F.when(~T.missing(F.col("country_normalized")), F.lower(F.trim("country_normalized"))),
            }
        )
        .drop("_names", "_addrs")
    )


def needs_transliteration(c: Column) -> Column:
    return c.rlike(INDIC)


def with_aliases(represented: DataFrame) -> DataFrame:
    """Adds the older names of the address representation."""
    return represented.withColumns({"is_address_missing": F.col("a_missing"), "normalized_address": F.col("a_text"), "address_tokens": F.col("a_set"), "primary_address_number": F.col("a_number"), "all_numeric_tokens": F.col("a_numbers")})

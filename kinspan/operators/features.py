"""Pair features: 29 in fixed order and types from precomputed entity columns, and 21 for profiling.

Entities are prepared once; a pair costs two joins and one projection, so groups of features are never joined together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspan.functions import text as T
from kinspan.operators.blocking import LABELS, PAIR, class_pairs

FEATURES: dict[str, str] = {
    **dict.fromkeys(["name_exact_norm", "name_exact_translit"], "byte"),
    **dict.fromkeys(["name_token_jaccard", "name_token_overlap", "name_token_dice"], "float"),
    "name_token_count_diff": "short",
    "name_char_3gram_jaccard": "float",
    "name_char_len_diff": "short",
    "name_char_len_ratio": "float",
    **dict.fromkeys(["name_first_token_exact", "name_acronym_match", "name_legal_suffix_match"], "byte"),
    "address_exact": "byte",
    **dict.fromkeys(["address_token_jaccard", "address_token_overlap", "address_char_3gram_similarity"], "float"),
    "shared_address_number_count": "short",
    **dict.fromkeys(["address_number_overlap", "postal_match"], "byte"),
    "address_length_difference": "short",
    **dict.fromkeys(["address_missing_s1", "address_missing_candidate", "country_match"], "byte"),
    **{f"matched_key_{x}": "byte" for x in LABELS},
    "matched_key_count": "byte",
}
_WIDE = {n: (0.0, 1e9) for n in ("name_token_count_diff", "name_char_len_diff", "shared_address_number_count")} | {"address_length_difference": (-1.0, 1e9), "matched_key_count": (0.0, float(len(LABELS)))}
_TERNARY = {n: (-1.0, 1.0) for n in ("address_exact", "address_number_overlap", "postal_match", "country_match")}
#: The least and the largest value of each feature; -1 says that a side lacks the value.
DOMAIN: dict[str, tuple[float, float]] = {n: (0.0, 1.0) for n in FEATURES} | _TERNARY | _WIDE

NAME = list(FEATURES)[:12]
ADDRESS = list(FEATURES)[12:22]
CROSS = ["country_match"]
BLOCKING = list(FEATURES)[23:]
#: Columns of the representation that are sets.
SETS = ["n_set", "n_grams", "a_set", "a_grams", "a_numbers"]
REPRESENTATION = ["n_text", "n_translit", "n_set", "n_count", "n_grams", "n_first", "n_acronym", "n_suffix", "a_text", "a_set", "a_grams", "a_numbers", "a_number", "a_postal", "a_missing", "c_text"]


def feature_metadata() -> list[dict]:
    """Of each feature in order: name, group, type, least and largest value, and whether -1 stands for a missing side."""
    groups = {n: g for g, names in (("name", NAME), ("address", ADDRESS), ("cross", CROSS), ("blocking", BLOCKING)) for n in names}
    return [{"name": n, "group": groups[n], "type": t, "least": DOMAIN[n][0], "most": DOMAIN[n][1], "missing_is_minus_one": DOMAIN[n][0] < 0} for n, t in FEATURES.items()]


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def _ternary(known: Column, equal: Column) -> Column:
    return F.when(F.coalesce(known, F.lit(False)), _flag(equal)).otherwise(-1)


def name_features() -> dict[str, Column]:
    c = F.col
    longest = F.greatest(F.length("n_text_1"), F.length("n_text_2")).cast("double")
    return {
        "name_exact_norm": _flag((c("n_text_1") == c("n_text_2")) & (c("n_text_1") != "")),
        "name_exact_translit": _flag(c("n_translit_1") == c("n_translit_2")),
        "name_token_jaccard": T.jaccard(c("n_set_1"), c("n_set_2"), 0.0, c("n_set_shared")),
        "name_token_overlap": T.overlap(c("n_set_1"), c("n_set_2"), 0.0, c("n_set_shared")),
        "name_token_dice": T.dice(c("n_set_1"), c("n_set_2"), 0.0, c("n_set_shared")),
        "name_token_count_diff": F.abs(c("n_count_1") - c("n_count_2")),
        "name_char_3gram_jaccard": T.jaccard(c("n_grams_1"), c("n_grams_2"), 0.0, c("n_grams_shared")),
        "name_char_len_diff": F.abs(F.length("n_text_1") - F.length("n_text_2")),
        "name_char_len_ratio": F.when(longest > 0, F.least(F.length("n_text_1"), F.length("n_text_2")) / longest).otherwise(0.0),
        "name_first_token_exact": _flag(c("n_first_1") == c("n_first_2")),
        "name_acronym_match": _flag((c("n_acronym_1") == c("n_acronym_2")) & (c("n_acronym_1") != "")),
        "name_legal_suffix_match": _flag(c("n_suffix_1") == c("n_suffix_2")),
    }


def address_features() -> dict[str, Column]:
    c = F.col
    both = ~c("a_missing_1") & ~c("a_missing_2")
    shared = c("a_numbers_shared")
    numbered = both & (F.size("a_numbers_1") > 0) & (F.size("a_numbers_2") > 0)
    return {
        "address_exact": _ternary(both, c("a_text_1") == c("a_text_2")),
        "address_token_jaccard": F.when(both, T.jaccard(c("a_set_1"), c("a_set_2"), 0.0, c("a_set_shared"))).otherwise(0.0),
        "address_token_overlap": F.when(both, T.overlap(c("a_set_1"), c("a_set_2"), 0.0, c("a_set_shared"))).otherwise(0.0),
        "address_char_3gram_similarity": F.when(both, T.jaccard(c("a_grams_1"), c("a_grams_2"), 0.0, c("a_grams_shared"))).otherwise(0.0),
        "shared_address_number_count": F.when(both, shared).otherwise(0),
        "address_number_overlap": _ternary(numbered, shared > 0),
        "postal_match": _ternary(both & c("a_postal_1").isNotNull() & c("a_postal_2").isNotNull(), c("a_postal_1") == c("a_postal_2")),
        "address_length_difference": F.when(both, F.abs(F.length("a_text_1") - F.length("a_text_2"))).otherwise(-1),
        "address_missing_s1": c("a_missing_1").cast("int"),
        "address_missing_candidate": c("a_missing_2").cast("int"),
    }


def cross_features() -> dict[str, Column]:
    return {"country_match": _ternary(F.col("c_text_1").isNotNull() & F.col("c_text_2").isNotNull(), F.col("c_text_1") == F.col("c_text_2"))}


def blocking_features(labels: Column) -> dict[str, Column]:
    """Of the provenance labels of a pair; a null array counts as none."""
    one = {f"matched_key_{x}": F.coalesce(F.array_contains(labels, x), F.lit(False)).cast("int") for x in LABELS}
    total = F.lit(0)
    for v in one.values():
        total = total + v
    return {**one, "matched_key_count": total}


def with_entities(pairs: DataFrame, represented: DataFrame) -> DataFrame:
    """Pairs with the representation of both sides, suffixes _1 and _2; an unknown entity counts as without texts."""
    missing = pairs.columns
    for k, side in ((1, PAIR[0]), (2, PAIR[1])):
        entity = represented.select(F.col("entity_id").alias(side), *[F.col(c).alias(f"{c}_{k}") for c in REPRESENTATION])
        pairs = pairs.join(entity, side, "left")
        empty = F.array().cast("array<string>")
        pairs = pairs.withColumns(
            {f"{c}_{k}": F.coalesce(f"{c}_{k}", F.lit("")) for c in ("n_text", "n_acronym", "a_text")}
            | {f"{c}_{k}": F.coalesce(f"{c}_{k}", empty) for c in ("n_set", "n_grams", "a_set", "a_grams", "a_numbers")}
            | {f"n_count_{k}": F.coalesce(f"n_count_{k}", F.lit(0)), f"a_missing_{k}": F.coalesce(f"a_missing_{k}", F.lit(True))}
        )
    return with_shared(pairs.select(*missing, *[f"{c}_{k}" for k in (1, 2) for c in REPRESENTATION]))


def with_shared(pairs: DataFrame) -> DataFrame:
    """Adds <set>_shared, the size of the intersection of both sides' sets, once for all features that use it."""
    return pairs.withColumns({f"{c}_shared": F.size(F.array_intersect(f"{c}_1", f"{c}_2")) for c in SETS})


def class_features(entities: DataFrame, names: list[str] | None = None, by: tuple[str, ...] = (), carry: tuple[str, ...] = ()) -> DataFrame:
    """Class pairs (see blocking.class_pairs) with features as numbers, computed once for all pairs of two classes.

    `carry` are columns of the entities that come with both sides, `by` sets the source1 side's members apart.
    """
    coded = entities.withColumns({c: T.gram_codes(F.col(c)) for c in ("n_grams", "a_grams")})
    pairs = with_shared(class_pairs(coded, [*REPRESENTATION, *carry], by=by))
    made = name_features() | address_features() | cross_features() | blocking_features(F.col("labels"))
    kept = [*[f"{c}_1" for c in by], *[f"{c}_{k}" for c in carry for k in (1, 2)]]
    return pairs.select("members_1", "members_2", *kept, *[made[n].alias(n) for n in (names or FEATURES)])


def pair_features(pairs: DataFrame, represented: DataFrame, names: list[str] | None = None) -> DataFrame:
    """PAIR and features in fixed order and types; `pairs` has PAIR and labels. An empty input gives an empty typed frame."""
    for column in PAIR:
        if column not in pairs.columns:
            raise ValueError(f"pairs lack {column}")
    labels = F.col("labels") if "labels" in pairs.columns else F.lit(None).cast("array<string>")
    made = name_features() | address_features() | cross_features() | blocking_features(labels)
    joined = with_entities(pairs, represented)
    return joined.select(*PAIR, *[made[n].cast(FEATURES[n]).alias(n) for n in (names or FEATURES)])


#: What the 21 profiling features compare, with the value of an entity that isn't known.
PROFILE = {
    **{f"{c}_{x}": "" for c, kinds in (("name", ("raw", "norm", "translit")), ("addr", ("raw", "norm", "translit")), ("country", ("raw", "norm"))) for x in kinds},
    **{f"{c}_{x}_known": False for c, kinds in (("name", ("raw", "norm", "translit")), ("addr", ("raw", "norm", "translit")), ("country", ("raw", "norm"))) for x in kinds},
    **{f"{c}_{x}": 0 for c in ("name", "addr") for x in ("length", "count")},
    **dict.fromkeys(["name_set", "addr_set", "addr_nums"], "array<string>"),
    **dict.fromkeys(["name_grams", "addr_grams"], "array<bigint>"),
}
PROFILE_SETS = ["name_set", "addr_set", "addr_nums", "name_grams", "addr_grams"]


def profile_representation(processed: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """entity_id, `carry` and the columns that the profiling features compare, once for each entity."""

    def known(column: str) -> Column:
        return F.coalesce(column, F.lit(""))

    def text(column: str, lower: bool = True) -> Column:
        squeezed = T.squeeze_ends(known(column))
        return F.lower(squeezed) if lower else squeezed

    out: dict[str, Column] = {}
    for short, field in (("name", "business_name"), ("addr", "business_address")):
        tokens = F.coalesce(f"{field}_tokens", F.array().cast("array<string>"))
        whole = F.coalesce(F.nullif(F.col(f"{field}_normalized"), F.lit("")), F.col(field), F.lit(""))
        of = {"raw": field, "norm": f"{field}_normalized", "translit": f"{field}_transliterated"}
        out |= {f"{short}_{k}": text(c, lower=k != "norm") for k, c in of.items()} | {f"{short}_{k}_known": known(c) != "" for k, c in of.items()}
        out |= {f"{short}_length": F.length(known(field)), f"{short}_count": F.size(tokens), f"{short}_set": F.array_distinct(tokens), f"{short}_grams": T.gram_codes(T.ngrams(whole))}
        if short == "addr":
            out["addr_nums"] = T.numeric_tokens(whole)
    for k, c in (("raw", "country"), ("norm", "country_normalized")):
        out |= {f"country_{k}": text(c), f"country_{k}_known": known(c) != ""}
    return processed.select("entity_id", *carry, *[out[n].alias(n) for n in PROFILE])


def profile_features(pairs: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Pairs with the sizes of intersections, and the 21 profiling features over PROFILE of both sides."""
    c = F.col
    pairs = pairs.withColumns({f"{x}_shared": F.size(F.array_intersect(f"{x}_1", f"{x}_2")) for x in PROFILE_SETS})

    def equal(name: str) -> Column:
        return _flag((c(f"{name}_1") == c(f"{name}_2")) & c(f"{name}_known_1"))

    def of(similarity, name: str) -> Column:
        return similarity(c(f"{name}_1"), c(f"{name}_2"), shared=c(f"{name}_shared"))

    out: dict[str, Column] = {}
    for short in ("name", "addr"):
        out |= {
            f"{short}_exact_raw": equal(f"{short}_raw"),
            f"{short}_exact_norm": equal(f"{short}_norm"),
            f"{short}_exact_translit": equal(f"{short}_translit"),
            f"{short}_token_jaccard": of(T.jaccard, f"{short}_set"),
            f"{short}_token_overlap": of(T.overlap, f"{short}_set"),
            f"{short}_char_ngram_jaccard": of(T.jaccard, f"{short}_grams"),
            f"{short}_len_diff": F.abs(c(f"{short}_length_1") - c(f"{short}_length_2")),
            f"{short}_token_len_diff": F.abs(c(f"{short}_count_1") - c(f"{short}_count_2")),
        }
        if short == "addr":
            shared = c("addr_nums_shared")
            out |= {"shared_num_count": shared, "shared_num_jaccard": of(T.jaccard, "addr_nums"), "has_shared_num": (shared > 0).cast("int")}
    return pairs, out | {"country_match_raw": equal("country_raw"), "country_match_norm": equal("country_norm")}


def profile_pair_features(pairs: DataFrame, processed: DataFrame) -> DataFrame:
    """The 21 profiling features; empty sets are alike (1.0), lengths are those of raw texts."""
    made = profile_representation(processed)
    for k, side in ((1, PAIR[0]), (2, PAIR[1])):
        pairs = pairs.join(made.select(F.col("entity_id").alias(side), *[F.col(c).alias(f"{c}_{k}") for c in PROFILE]), side, "left")
    none = {c: F.array().cast(v) if str(v).startswith("array") else F.lit(v) for c, v in PROFILE.items()}
    pairs, out = profile_features(pairs.withColumns({f"{c}_{k}": F.coalesce(f"{c}_{k}", none[c]) for c in PROFILE for k in (1, 2)}))
    return pairs.select(*PAIR, *[v.alias(k) for k, v in out.items()])


def class_profile_features(entities: DataFrame) -> DataFrame:
    """Class pairs (see blocking.class_pairs) with the 21 profiling features, computed once for all pairs of two classes."""
    keys = tuple(f"key_{x}" for x in LABELS)
    pairs, out = profile_features(class_pairs(profile_representation(entities, ("source", "class", *keys)), list(PROFILE)))
    return pairs.select("members_1", "members_2", *[v.alias(k) for k, v in out.items()])


def class_similarities(entities: DataFrame) -> DataFrame:
    """Class pairs with similarities of names: jaccard and overlap of tokens, ngram, and lev (Levenshtein)."""
    c = F.col
    low = entities.withColumns({"n_grams": T.gram_codes(c("n_grams")), "low": F.lower(T.squeeze_ends(c("n_text")))})
    pairs = class_pairs(low, ["n_set", "n_grams", "low"])
    pairs = pairs.withColumns({f"{x}_shared": F.size(F.array_intersect(f"{x}_1", f"{x}_2")) for x in ("n_set", "n_grams")} | {"most": F.greatest(F.length("low_1"), F.length("low_2")).cast("double")})
    lev = F.when(c("most") == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.levenshtein("low_1", "low_2") / c("most")))
    of = lambda f, x: f(c(f"{x}_1"), c(f"{x}_2"), shared=c(f"{x}_shared"))
    return pairs.select("members_1", "members_2", of(T.jaccard, "n_set").alias("jaccard"), of(T.overlap, "n_set").alias("overlap"), of(T.jaccard, "n_grams").alias("ngram"), lev.alias("lev"))


def feature_ranges(features: DataFrame, weight: Column | None = None) -> DataFrame:
    """feature, least, most, nulls and whether all values are in the feature's domain; no rows of an empty input.

    With a weight a row stands for so many. One pass, no row a value.
    """
    rows = F.lit(1) if weight is None else weight
    made, of = [F.count(F.lit(1)).alias("rows")], []
    for n in FEATURES:
        v, (least, most) = F.col(n).cast("double"), DOMAIN[n]
        inside = v.isNotNull() & ~F.isnan(v) & (v >= least - 1e-5) & (v <= most + 1e-5)
        made += [F.min(v).alias(f"{n}_least"), F.max(v).alias(f"{n}_most"), F.sum(F.when(v.isNull(), rows).otherwise(0)).cast("long").alias(f"{n}_nulls"), F.bool_and(inside).alias(f"{n}_in")]
        of.append(F.struct(F.lit(n).alias("feature"), F.round(f"{n}_least", 6).alias("least"), F.round(f"{n}_most", 6).alias("most"), F.col(f"{n}_nulls").alias("nulls"), F.col(f"{n}_in").alias("in_domain")))
    return features.agg(*made).filter("rows > 0").select(F.explode(F.array(*of)).alias("r")).select("r.*")

"""The SQL twins: common table expressions in DuckDB's dialect, written apart from the Spark expressions."""

from __future__ import annotations

from kinspan.functions.fixed import ADDRESS_NUMBER, BUSINESS_TERMS, COUNTRIES, LEGAL_SUFFIXES, NUMERIC_TOKEN, STOPWORDS, SWEEP_GRID
from kinspan.plans.views import PART_VIEW, TRUTH_VIEW

LABELS = ("A", "C", "D", "E", "F")


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def in_map(x: str, values: dict[str, str]) -> str:
    return f"coalesce(case {x} " + " ".join(f"when {q(k)} then {q(v)}" for k, v in values.items()) + f" end, {x})"


def suffix(x: str) -> str:
    cases = " ".join(f"when regexp_matches({x}, {q(rf'(?i)\b(?:{p})\b\.?$')}) then {squeeze(f'regexp_replace({x}, {q(rf'(?i)\b(?:{p})\b\.?$')}, {q(c)})')}" for p, c in LEGAL_SUFFIXES)
    return f"case {cases} else {x} end"


def norm(x: str, safe: str = r"\-/&#''") -> str:
    return squeeze(f"regexp_replace(lower(strip_accents({x})), '[^\\pL\\pN_\\s{safe}]', ' ', 'g')")


def addr(x: str) -> str:
    return f"trim({squeeze(f'''regexp_replace(regexp_replace({squeeze(f'lower(strip_accents({x}))')}, '\\bno[.:]\\b', 'no', 'g'), '[^\\pL\\pN_\\s\\-/&#]', ' ', 'g')''')}, ' -/,&#')"


def grams(x: str) -> str:
    return f"(case when {x} = '' then [] else list_distinct(list_transform(range(1, greatest(length(trim(lower({x}))) + 2 - 2, 1) + 1), lambda i: substr(' ' || trim(lower({x})) || ' ', i, 3))) end)"


STOP = "[" + ", ".join(map(q, STOPWORDS)) + "]"
TOKENS = "list_filter(string_split_regex(business_name_normalized, '[^\\pL\\pN_&/-]+'), lambda t: t <> '')"
MEANINGFUL = f"list_filter({TOKENS}, lambda t: length(t) >= 2 and not list_contains({STOP}, t))"


def numbers(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), {q(NUMERIC_TOKEN)}))"


def last_code(x: str, pattern: str) -> str:
    return f"list_filter(regexp_extract_all({x}, {q(pattern)}, 1), lambda m: position(' ' in {x}) = 0 or m <> string_split({x}, ' ')[1])[-1]"


def postal(x: str) -> str:
    return f"case country_normalized when 'india' then {last_code(x, r'\b([1-9]\d{5})\b')} when 'united states' then {last_code(x, r'\b(\d{5}(?:-\d{4})?)\b')} else coalesce({last_code(x, r'\b(\d{6})\b')}, {last_code(x, r'\b(\d{5})\b')}) end"


WORDS = f"array_to_string(list_transform(string_split({norm('business_name')}, ' '), lambda t: {in_map('t', BUSINESS_TERMS)}), ' ')"

#: CTEs by name, each with those it needs.
CTES: dict[str, tuple[str, list[str]]] = {
    "er": (PART_VIEW.format(part="part"), []),
    "truth": (TRUTH_VIEW.format(er="er"), ["er"]),
    "words": (f"select *, trim(regexp_replace({WORDS}, '[,.\\s]+$', '')) w from er", ["er"]),
    "normed": (f"select *, {suffix('w')} business_name_normalized, {addr('business_address')} business_address_normalized, {in_map(norm('country', ''), COUNTRIES)} country_normalized from words", ["words"]),
    "ent": (
        f"select *, {TOKENS} n_tokens, {MEANINGFUL} m_tokens, list_filter(list_transform(string_split(business_address_normalized, ' '), lambda t: trim(t, ' ,.;:')), lambda t: t <> '') a_tokens,"
        f" list_filter(regexp_extract_all(business_address_normalized, {q(ADDRESS_NUMBER)}, 1), lambda x: not regexp_full_match(x, '\\d{{5,6}}'))[1] num from normed",
        ["normed"],
    ),
    "keyed": (
        "select *, 'A||' || country_normalized || '||' || business_name_normalized key_A,"
        " 'B||' || country_normalized || '||' || lower(trim(business_name)) key_B,"
        " 'C||' || country_normalized || '||' || m_tokens[1] || '||' || m_tokens[2] key_C,"
        " 'D||' || country_normalized || '||' || m_tokens[1] || '||' || num key_D,"
        " case when num is null then 'E||' || country_normalized || '||' || m_tokens[1] end key_E,"
        " 'F||' || country_normalized || '||' || business_address_normalized key_F from ent",
        ["ent"],
    ),
    "keys": (" union all ".join(f"select entity_id, source, '{x}' label, key_{x} as key from keyed where key_{x} is not null" for x in LABELS), ["keyed"]),
    "sizes": ("select label, key, count(*) filter (source = 'source1') n1, count(*) filter (source <> 'source1') n2, n1 * n2 pairs from keys group by 1, 2 having n1 > 0 and n2 > 0", ["keys"]),
    "cand": (
        "select a.entity_id source1_entity_id, b.entity_id candidate_entity_id, b.source candidate_source, list_sort(list_distinct(list(a.label))) labels"
        " from keys a join keys b on a.key = b.key and a.label = b.label join sizes s on s.key = a.key and s.label = a.label"
        " where a.source = 'source1' and b.source <> 'source1' and s.pairs <= {cap} group by 1, 2, 3",
        ["keys", "sizes"],
    ),
    "tm": (
        "select t.*, a.country_normalized country, a.num is not null num1, b.num is not null num2, " + ", ".join(f"coalesce(a.key_{x} = b.key_{x}, false) m_{x}" for x in LABELS) + " from truth t left join keyed a on a.entity_id = t.source1_entity_id left join keyed b on b.entity_id = t.candidate_entity_id",
        ["truth", "keyed"],
    ),
    "rep": (
        f"select entity_id, business_name_normalized nt, lower(trim(business_name)) tr, list_distinct(n_tokens) ns, len(n_tokens) nc, {grams('business_name_normalized')} ng, string_split(business_name_normalized, ' ')[1] nf,"
        " array_to_string(list_transform(n_tokens, lambda t: t[1:1]), '') ac, nullif(regexp_extract(business_name_normalized, '(?:^| )(pvt ltd|plc|ltd|llc|llp|inc|corp|co)$', 1), '') sx,"
        f" coalesce(business_address_normalized, '') ad, coalesce(list_distinct(a_tokens), []) aset, {grams(chr(40) + 'coalesce(business_address_normalized, ' + q('') + '))')} ag, {numbers('coalesce(business_address_normalized, ' + q('') + ')')} an,"
        f" {postal('coalesce(business_address_normalized, ' + q('') + ')')} pc, business_address_normalized is null am, country_normalized cn, num from ent",
        ["ent"],
    ),
    "joined": ("select c.*, " + ", ".join(f"a.{x} {x}1, b.{x} {x}2" for x in "nt tr ns nc ng nf ac sx ad aset ag an pc am cn".split()) + " from cand c join rep a on a.entity_id = c.source1_entity_id join rep b on b.entity_id = c.candidate_entity_id", ["cand", "rep"]),
    "scored": ("", ["joined"]),
}


def jac(a: str, b: str, empty: str = "0.0") -> str:
    i = f"len(list_intersect({a}, {b}))"
    return f"(case when len({a}) + len({b}) = 0 then {empty} else {i}::double / (len({a}) + len({b}) - {i}) end)"


def over(a: str, b: str, empty: str = "0.0") -> str:
    return f"(case when len({a}) + len({b}) = 0 then {empty} when least(len({a}), len({b})) = 0 then 0.0 else len(list_intersect({a}, {b}))::double / least(len({a}), len({b})) end)"


BOTH = "(not am1 and not am2)"
FEATURES = {
    "name_exact_norm": "(nt1 = nt2 and nt1 <> '')::int",
    "name_exact_translit": "(tr1 = tr2)::int",
    "name_token_jaccard": jac("ns1", "ns2"),
    "name_token_overlap": over("ns1", "ns2"),
    "name_token_dice": "(case when len(ns1) + len(ns2) = 0 then 0.0 else 2.0 * len(list_intersect(ns1, ns2)) / (len(ns1) + len(ns2)) end)",
    "name_token_count_diff": "abs(nc1 - nc2)",
    "name_char_3gram_jaccard": jac("ng1", "ng2"),
    "name_char_len_diff": "abs(length(nt1) - length(nt2))",
    "name_char_len_ratio": "(case when greatest(length(nt1), length(nt2)) = 0 then 0.0 else least(length(nt1), length(nt2))::double / greatest(length(nt1), length(nt2)) end)",
    "name_first_token_exact": "coalesce(nf1 = nf2, false)::int",
    "name_acronym_match": "(ac1 = ac2 and ac1 <> '')::int",
    "name_legal_suffix_match": "coalesce(sx1 = sx2, false)::int",
    "address_exact": f"(case when {BOTH} then (ad1 = ad2)::int else -1 end)",
    "address_token_jaccard": f"(case when {BOTH} then {jac('aset1', 'aset2')} else 0.0 end)",
    "address_token_overlap": f"(case when {BOTH} then {over('aset1', 'aset2')} else 0.0 end)",
    "address_char_3gram_similarity": f"(case when {BOTH} then {jac('ag1', 'ag2')} else 0.0 end)",
    "shared_address_number_count": f"(case when {BOTH} then len(list_intersect(an1, an2)) else 0 end)",
    "address_number_overlap": f"(case when {BOTH} and len(an1) > 0 and len(an2) > 0 then (len(list_intersect(an1, an2)) > 0)::int else -1 end)",
    "postal_match": f"(case when {BOTH} and pc1 is not null and pc2 is not null then (pc1 = pc2)::int else -1 end)",
    "address_length_difference": f"(case when {BOTH} then abs(length(ad1) - length(ad2)) else -1 end)",
    "address_missing_s1": "am1::int",
    "address_missing_candidate": "am2::int",
    "country_match": "(case when cn1 is not null and cn2 is not null then (cn1 = cn2)::int else -1 end)",
    **{f"matched_key_{x}": f"list_contains(labels, '{x}')::int" for x in LABELS},
    "matched_key_count": "len(labels)",
}
CTES["scored"] = (
    f"select j.source1_entity_id, j.candidate_entity_id, j.candidate_source, round(0.7 * {FEATURES['name_token_jaccard']} + 0.3 * {FEATURES['address_token_jaccard']}, 6) probability,"
    " (t.source1_entity_id is not null)::int as label from joined j left join truth t on t.source1_entity_id = j.source1_entity_id and t.candidate_entity_id = j.candidate_entity_id",
    ["joined", "truth"],
)


def sql(body: str, *needs: str, cap: int = 500) -> str:
    """A query over the named CTEs and all that these need."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in CTES[name][1]:
            add(x)
        if name not in order:
            order.append(name)

    for n in needs:
        add(n)
    body = "with " + ",\n".join(f"{n} as ({CTES[n][0].replace('{cap}', str(cap))})" for n in order) + f"\n{body}" if order else body
    return body


def feature_list(names: list[str], doubles: bool = True) -> str:
    return ", ".join(f"round({FEATURES[n]}::double, 6) as {n}" for n in names)


GRID = ", ".join(f"({t}::double)" for t in SWEEP_GRID)
PAIR = "source1_entity_id, candidate_entity_id, candidate_source"

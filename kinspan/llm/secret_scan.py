"""Secret scanning: candidates by pattern, false positives out by a random forest. DataFrame functions and Spark ML only.

Candidates are blocks of private keys, credentials in addresses, whatever is assigned to a password-like name, values with
the prefix of a known issuer, runs of key characters that hold a digit, and long runs that change between small and
capital letters. Features of the forest: length, shares of character kinds, transitions between kinds, distinct
characters, coverage by dictionary words and by frequent letter pairs, whether it lies in a path or address, and which
words stand before it. It is trained with the labelled findings of `findings.py`, or with those that the caller gives.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinspan.llm.common import read, stage
from kinspan.llm.findings import labelled_findings

BEFORE, AFTER, LEAST, LONG = 40, 20, 10, 20
LABELLED_ROWS, TREES, DEPTH, SEED = 8000, 32, 9, 11
THRESHOLD = 0.5

#: Names that secrets are assigned to, words that go with harmless codes, prefixes of issuers.
SECRET_NAMES = "password|passwd|passphrase|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|secret[_-]?key|client[_-]?key|auth[_-]?key|auth|bearer|credentials?|private[_-]?key"
HARMLESS = "commit|sha1|sha256|md5|checksum|hash|integrity|uuid|isbn|phone|tel|order|version|build|invoice|session|request|id"
PREFIXES = "AKIA|ASIA|ghp_|gho_|github_pat_|sk-|sk_live_|xox[bp]-|eyJ|AIza"

#: Letter pairs and words that are frequent in text and in names.
PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce|li|ch|ll|be|ma|si|om|ur|qu|ei|un|ie|ge|la|el|os"
DICTIONARY = """
    the and for you with this that from have not are was all can has will more about page site home new time info search
    other which their there people first date user name file data code test example config default value string index
    list item type number order key part work life day way world school state family group country problem hand place
    case week company system program question government night point water room mother area money story fact month lot
    right study book word business issue side kind head house service friend father power hour game line end member law
    car city community president team minute idea body back parent face others level office door health person art war
    history party result change morning reason research girl guy moment air teacher force education
    report chapter section market river winter version garden summer window music travel station bridge image video
    server client local host public static return class object method module table column field length
""".split()

#: '=' ends a run, but for one or two as padding.
_RUN = "[A-Za-z0-9+/_-]"
_LETTERS = "[A-Za-z+/_-]"
_PADDING = "={1,2}(?![A-Za-z0-9+/_=-])"
_IS = "[\"']?[ \t]{0,3}(?:=>|[=:])[ \t]{0,3}[\"']?"
PEM = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s:,-]*?(?=-----END)"
IN_ADDRESS = r"(?<=://[^\s:/@]{1,40}:)[^\s:/@]{6,}+(?=@)"
ASSIGNED = rf"(?<=(?i:{SECRET_NAMES}){_IS})[^\s\"'<>]{{6,}}+"
BEARER = r"(?<=(?i:bearer|basic) )[A-Za-z0-9._~+/=-]{16,}+"
ISSUED = rf"(?:{PREFIXES}){_RUN}{{{LEAST},}}+(?:\.{_RUN}++)*+"
CANDIDATE = rf"(?={_RUN}{{{LEAST}}}|{_RUN}{{{LEAST - 2},}}{_PADDING}){_LETTERS}*+[0-9]{_RUN}*+(?:{_PADDING})?"
MIXED_CASE = rf"(?={_LETTERS}{{{LONG}}})(?:[A-Z+/_-]*+[a-z]++(?=[A-Z])){{3}}{_LETTERS}*+"
# cheap conditions stand before those that look far behind: what comes after ':', '=', '>', a quote or a blank after these,
# what comes after "bearer " or "basic ", and the start of a run
PATTERN = rf"{PEM}|(?<=[=:>\"'][ \t]{{0,3}}[\"']?)(?:(?<=:){IN_ADDRESS}|{ASSIGNED})|(?<=[rRcC] ){BEARER}|(?<!{_RUN})(?={_RUN}{{{LEAST - 2}}})(?:{ISSUED}|{CANDIDATE}|{MIXED_CASE})"

FEATURES = ["length", "upper", "lower", "digit", "other", "transitions", "distinct", "dictionary", "pairs", "hexadecimal", "numeric", "path", "address", "assigned", "named", "harmless", "quoted", "prefix", "uuid", "placeholder"]


def with_features(found: DataFrame) -> DataFrame:
    """Adds FEATURES to candidates (candidate, before, after)."""
    c, before, after = F.col("candidate"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))
    size = F.greatest(F.length(c), F.lit(1)).cast("double")

    def share(pattern: str, weight: float = 1.0) -> Column:
        return F.regexp_count(c, F.lit(pattern)) * F.lit(weight) / size

    def has(text: Column, pattern: str) -> Column:
        return text.rlike(pattern).cast("double")

    return found.withColumns(
        {
            "length": F.least(size, F.lit(120.0)),
            "upper": share("[A-Z]"),
            "lower": share("[a-z]"),
            "digit": share("[0-9]"),
            "other": share("[^A-Za-z0-9]"),
            "transitions": share("[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])"),
            "distinct": F.size(F.array_distinct(F.split(c, ""))) / size,
            "dictionary": (size - F.length(F.regexp_replace(F.lower(c), "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), ""))) / size,
            "pairs": F.regexp_count(F.lower(c), F.lit(PAIRS)) * 2.0 / size,
            "hexadecimal": has(c, "^[0-9a-f]+$"),
            "numeric": has(c, r"^[0-9+()./-]+$"),
            "path": has(F.concat(F.substring_index(before, " ", -1), c, F.substring_index(after, " ", 1)), r"://|/[A-Za-z0-9._-]+/|\.(?:com|org|net|html?|png|jpg|txt|py)\b"),
            "address": has(F.concat(c, after), "^[^ ]*@"),
            "assigned": has(before, "[=:>]\\s*[\"']?$"),
            "named": has(F.lower(before), f"(?:{SECRET_NAMES}|basic|://[^/@ :]+)[\"']?\\s*(?:=>|[=:]|\\s)\\s*[\"']?$"),
            "harmless": has(F.lower(before), f"\\b(?:{HARMLESS})[\"']?\\s*[=:#]?\\s*[\"']?$"),
            "quoted": has(before, "[\"']$"),
            "prefix": has(c, f"^(?:{PREFIXES}|-----BEGIN)"),
            "uuid": has(c, "^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"),
            "placeholder": has(c, r"^(?:\$|%|\{|your|my|os\.|process\.|env)"),
        }
    )


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, start (characters before it), candidate, before, after of each candidate in the whole texts."""
    hit = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").rlike(PATTERN)).dropDuplicates(["doc_id", "text"])
    parts = hit.select("doc_id", F.xxhash64("text").alias("row"), F.split("text", PATTERN, -1).alias("part"), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)).alias("found"))
    at = F.transform(
        "found",
        lambda c, k: F.struct(
            c.alias("candidate"),
            F.length(F.get("part", k)).alias("gap"),
            F.right(F.get("part", k), F.lit(BEFORE)).alias("before"),
            F.left(F.get("part", k + 1), F.lit(AFTER)).alias("after"),
        ),
    )
    placed = parts.select("doc_id", "row", F.posexplode(at).alias("k", "c")).select("doc_id", "row", "k", "c.*")
    # a finding starts after all parts up to its own and all findings before it
    until = Window.partitionBy("doc_id", "row").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = (F.sum(F.col("gap") + F.length("candidate")).over(until) - F.length("candidate")).cast("int")
    return placed.select("doc_id", start.alias("start"), "candidate", "before", "after").filter(F.length("candidate") >= 6)


def scored(found: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """Candidates (candidate, before, after and others) with the forest's score, 0 to 1."""
    learn = with_features(labelled_findings(found.sparkSession, LABELLED_ROWS, SEED) if findings is None else findings)
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")
    forest = RandomForestClassifier(labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(assembler.transform(learn).select("features", F.col("label").cast("double").alias("label")))
    # a copy has no training summary: that holds the session, which can't be sent to tasks once a query was observed
    forest = forest.copy()
    return forest.transform(assembler.transform(with_features(found))).withColumn("score", F.element_at(vector_to_array("probability"), 2)).select(*found.columns, "score")


def scan(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """Every candidate of the whole texts, scored.

    Takes doc_id and text; other columns are ignored. `findings` (candidate, before, after, label) are what the forest
    learns from; those of findings.py by default. Returns doc_id, start, length, preview (four characters), finding_sha256,
    score (0 to 1) and is_secret (score >= 0.5). Null and empty texts have no candidates. Repeated rows count once; the
    same secret in two places is two rows. A row without doc_id is reported with a null doc_id. No rows, no findings.
    """
    found = scored(stage(candidates(docs), "candidates"), findings)
    return found.select("doc_id", "start", F.length("candidate").alias("length"), F.left("candidate", F.lit(4)).alias("preview"), F.sha2("candidate", 256).alias("finding_sha256"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("is_secret"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))

"""Labelled findings of a secret scan, as templates: what stands before and after a candidate, and how its value is made.

A template is (label, kind, size, prefix, before, after): the candidate is `prefix` and `size` characters of a kind. Kinds
are runs of hexadecimal digits, of letters and digits, of letters, of digits; UUIDs; names made of words; passwords as
people make them; keys in lines of base64. HELD_OUT are templates that the forest isn't trained with: other contexts,
other names, other lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Template = tuple[int, str, int, str, str, str]

# Words that names, paths and people's passwords are made of.
WORDS = "report chapter section house market river winter version garden summer dragon monkey orange silver station bridge music travel coffee window".split()

LABELLED: list[Template] = [
    (1, "upper", 16, "AKIA", "the key is ", " and"),
    (1, "upper", 16, "AKIA", "aws_access_key_id = ", "\n"),
    (1, "upper", 16, "ASIA", "access_key=", "\n"),
    (1, "mixed", 40, "", "aws_secret_access_key = ", "\n"),
    (1, "mixed", 36, "ghp_", "clone with ", "\n"),
    (1, "letters", 36, "ghp_", "token: ", "\n"),
    (1, "mixed", 36, "gho_", "GITHUB_TOKEN=", " "),
    (1, "mixed", 24, "sk_live_", "stripe ", "\n"),
    (1, "mixed", 48, "sk-", "OPENAI: ", "'"),
    (1, "mixed", 35, "AIza", 'google_maps("', '")'),
    (1, "mixed", 24, "xoxb-", "slack bot ", " "),
    (1, "mixed", 120, "eyJhbGciOi", "Authorization: Bearer ", "\n"),
    (1, "mixed", 60, "", "Authorization: Basic ", "\n"),
    (1, "hex", 40, "", 'token = "', '" then'),
    (1, "hex", 32, "", "api_key=", "\n"),
    (1, "hex", 64, "", "SECRET_KEY = '", "'"),
    (1, "hex", 18, "", "password=", " and"),
    (1, "hex", 24, "", '"auth": "', '"'),
    (1, "mixed", 32, "", "secret: '", "'"),
    (1, "mixed", 22, "", "client_secret=", "&"),
    (1, "mixed", 22, "", '"apiKey": "', '",'),
    (1, "mixed", 10, "", "password=", " "),
    (1, "mixed", 16, "", "pwd: ", "\n"),
    (1, "letters", 32, "", "API_KEY=", "\n"),
    (1, "letters", 20, "", "passwd = ", "\n"),
    (1, "letters", 28, "", '"access_token": "', '"'),
    (1, "human", 0, "", "password = \"", '"'),
    (1, "human", 0, "", "Password=", "\n"),
    (1, "human", 0, "", '"password": "', '"'),
    (1, "human", 0, "", "postgres://admin:", "@db.internal"),
    (1, "human", 0, "", "the password: ", " works"),
    (1, "lines", 400, "-----BEGIN RSA PRIVATE KEY-----\n", "", "-----END RSA PRIVATE KEY-----"),
    (1, "lines", 200, "-----BEGIN PRIVATE KEY-----\n", "key:\n", "-----END PRIVATE KEY-----"),
    (0, "hex", 40, "", "commit ", "\n"),
    (0, "hex", 40, "", "reverted in ", " and"),
    (0, "hex", 32, "", "md5: ", ""),
    (0, "hex", 64, "", "sha256: ", " "),
    (0, "hex", 64, "", "sha256=", "\n"),
    (0, "hex", 12, "", "image ", " of"),
    (0, "hex", 16, "", "the trace ", " ended"),
    (0, "hex", 32, "", "https://example.org/img/", ".png"),
    (0, "mixed", 11, "", "https://example.com/watch?v=", " "),
    (0, "mixed", 64, "", "-----BEGIN CERTIFICATE-----\n", "\n"),
    (0, "mixed", 76, "", "data:image/png;base64,", "\n"),
    (0, "mixed", 44, "", 'integrity="sha256-', '"'),
    (0, "digits", 16, "", "card ", " was"),
    (0, "digits", 13, "", "ISBN ", " "),
    (0, "digits", 10, "", "at ", " people"),
    (0, "digits", 12, "", "order #", " shipped"),
    (0, "digits", 11, "+", "tel: ", " "),
    (0, "digits", 14, "", "id=", "&"),
    (0, "uuid", 0, "", "id=", " "),
    (0, "uuid", 0, "", "request ", " failed"),
    (0, "uuid", 0, "", '"uuid": "', '"'),
    (0, "name", 2, "", "see ", " for"),
    (0, "name", 3, "", "https://example.org/", ".html"),
    (0, "name", 2, "", "in /home/user/", "/src"),
    (0, "name", 2, "", "version ", "\n"),
    (0, "name", 2, "", "write to ", "@example.com"),
    (0, "name", 3, "", "token: ", " is read"),
    (0, "word", 0, "", "password: ", " to be reset"),
    (0, "word", 0, "", "auth: ", " only"),
    (0, "word", 0, "your_", "api_key=", "\n"),
    (0, "word", 0, "os.environ.", "password = ", "\n"),
    (0, "word", 0, "${", "secret: ", "}"),
    (0, "camel", 0, "", "calls ", "("),
    (0, "camel", 0, "", "class ", " extends"),
]

HELD_OUT: list[Template] = [
    (1, "upper", 16, "AKIA", "We found ", ", which"),
    (1, "mixed", 36, "ghp_", "remote add https://", "@git"),
    (1, "hex", 32, "", "passphrase: ", "\n"),
    (1, "hex", 48, "", "ACCESS_TOKEN='", "'"),
    (1, "mixed", 28, "", "auth_token => '", "'"),
    (1, "mixed", 40, "", "private_key=", ";"),
    (1, "letters", 24, "", 'secret="', '"'),
    (1, "human", 0, "", "DB_PASSWORD=", "\n"),
    (1, "human", 0, "", "mysql://root:", "@10.0.0.1"),
    (1, "lines", 300, "-----BEGIN EC PRIVATE KEY-----\n", "\n", "-----END EC PRIVATE KEY-----"),
    (0, "hex", 40, "", "merge of ", " into"),
    (0, "hex", 64, "", "checksum ", " matches"),
    (0, "mixed", 12, "", "https://example.net/p/", " is"),
    (0, "digits", 15, "", "account ", " closed"),
    (0, "digits", 9, "", "call ", " today"),
    (0, "uuid", 0, "", "session ", " began"),
    (0, "name", 2, "", "the file ", " holds"),
    (0, "name", 4, "", "under /var/log/", "/old"),
    (0, "word", 0, "", "secret: ", " of success"),
    (0, "camel", 0, "", "method ", " returns"),
]


def labelled_findings(spark: SparkSession, rows: int, seed: int, templates: list[Template] | None = None) -> DataFrame:
    """Findings with labels (candidate, before, after, label): each template in turn, values from hashes of seed and row number."""
    templates = LABELLED if templates is None else templates
    table = spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "pick int, label int, kind string, size int, prefix string, before string, after string")

    def digest(salt: str) -> Column:
        return F.sha2(F.concat_ws("-", F.lit(f"{seed}{salt}"), F.col("id").cast("string")), 512)

    def word(salt: str) -> Column:
        return F.element_at(F.array(*map(F.lit, WORDS)), (F.pmod(F.crc32(digest(salt)), F.lit(len(WORDS))) + 1).cast("int"))

    hexadecimal = digest("h")
    mixed = F.regexp_replace(F.concat(*[F.base64(F.unhex(digest(x))) for x in "abcde"]), "[+/=\n\r]", "x")
    letters = F.translate(mixed, "0123456789", "kLmNpQrStU")
    digits = F.translate(hexadecimal, "abcdef", "012345")
    number = F.substring(digits, 1, 2)
    values = {
        "hex": F.left(hexadecimal, F.col("size")),
        "upper": F.upper(F.left(mixed, F.col("size"))),
        "mixed": F.left(mixed, F.col("size")),
        "letters": F.left(letters, F.col("size")),
        "digits": F.left(digits, F.col("size")),
        "uuid": F.concat_ws("-", *[F.substring(hexadecimal, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]),
        "human": F.concat(F.initcap(word("w")), F.element_at(F.array(*map(F.lit, "!&$_#")), (F.length(word("x")) % 5 + 1).cast("int")), word("y"), number),
        "name": F.array_join(F.slice(F.array(word("w"), word("x"), word("y"), F.concat(word("z"), number)), F.lit(5) - F.col("size"), F.col("size")), "-"),
        "word": F.concat(word("w"), F.lit("_"), word("x")),
        "camel": F.concat(word("w"), F.initcap(word("x")), F.initcap(word("y")), F.initcap(word("z"))),
        "lines": F.regexp_replace(F.left(mixed, F.col("size")), "(.{64})", "$1\n"),
    }
    made = F.lit("")
    for kind, value in values.items():
        made = F.when(F.col("kind") == kind, value).otherwise(made)
    numbered = spark.range(rows).withColumn("pick", F.pmod("id", F.lit(len(templates))).cast("int"))
    # the templates are a list of this module
    return numbered.join(F.broadcast(table), "pick").select(F.concat("prefix", made).alias("candidate"), "before", "after", "label")

"""Secret scans with a random forest that removes false positives.

Regular expressions propose candidates: known key formats, values assigned to secret-sounding
names, and long tokens with digits. A random forest then judges each by its length, the
transitions between its characters, how much of it the words of a dictionary cover, whether it is
part of a path or address, and the words beside it. The dictionary holds the words that stand in
most documents. Everything runs as DataFrame expressions and the forest of pyspark.ml, without
Python workers.

The forest is trained on labelled findings. For each kind of secret and each kind of look-alike
(checksums, identifiers, versions, paths, placeholders, prose) a number of lines is spelled from
hashes of row numbers, so that training is the same in each run. To these come look-alikes found
in the documents themselves, whose form shows that they are none: mail and network addresses, and
card and telephone numbers, a bounded number chosen by their hashes.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.shared import Names, documents, spool, unspool

#: Formats of keys by kind (fixed values).
FORMATS = {
    "aws_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github_token": r"\bgh[pousr]_[0-9A-Za-z]{36,}\b",
    "slack_token": r"\bxox[abprs]-[0-9A-Za-z-]{10,}",
    "google_key": r"\bAIza[0-9A-Za-z_-]{35}",
    "stripe_key": r"\b[sr]k_(?:live|test)_[0-9A-Za-z]{16,}\b",
    "jwt": r"\beyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}",
    # To its END, or, if that is missing, over the lines of its body.
    "private_key": r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:[^-]*+(?:-{1,4}(?!-)[^-]*+)*+-----END [A-Z ]{0,20}PRIVATE KEY-----|(?:\s{1,4}[0-9A-Za-z+/=]{16,}+)*+)",
    "url_password": r"\b[a-z][a-z0-9+.-]{1,20}://[^\s:/@]++:[^\s:/@]{3,}+@",
}
#: Names whose values are secrets, as a pattern.
NAMES = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|client[_-]?secret|credentials?)"
SIGN = rf"(?i:{NAMES}[a-z0-9_]{{0,10}}[\"']?\s{{0,3}}(?:=|:|=>)\s{{0,3}}[\"']?)"
#: A name with its value, which is a key of some format with what hangs on to it, or else anything unbroken. No length ends a value.
ASSIGNED = rf"{SIGN}(?:(?:{'|'.join(FORMATS.values())})[^\s\"',;<>]*+|[^\s\"',;<>]{{6,}}+)"
MIXED = r"(?<![0-9A-Za-z+/_=.@-])(?=[A-Za-z+/_=.@-]*+[0-9])[0-9A-Za-z+/_=.@-]{16,}+"
CANDIDATE = "|".join([*FORMATS.values(), ASSIGNED, MIXED])
#: Characters before and after a candidate that count as its neighbours.
BESIDE = 48
SECRET_WORDS = r"(?i)pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private|credential|auth|bearer|login"
HARMLESS_WORDS = r"(?i)\b(?:sha-?\d*|md5|checksum|digest|commit|revision|uuid|guid|etag|hash|version|build|order|isbn|example|sample|placeholder|dummy|serial|track)\b"
PLACEHOLDERS = r"(?i)x{4,}|\*{3,}|changeme|example|your[_-]|placeholder|dummy|<[^>]*>|\$\{|123456|abcdef|password$|none$|null$|true$|false$"
#: What can't be a secret by its form: numbers of cards and telephones, and mail and network addresses.
LOOKALIKES = r"(?<!\S)(?:[0-9]{12,19}|[0-9A-Za-z._+-]{1,64}@[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)+|[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?!\S)"
#: Words of the dictionary, by the number of documents they stand in; their letter pairs that count as common; look-alikes that the
#: forest learns from, at most.
DICTIONARY_WORDS, COMMON_PAIRS, MOST_LOOKALIKES = 2000, 120, 400
N_EXAMPLES, N_TREES, DEPTH, SEED = 150, 20, 8, 17
FEATURES = [
    "length", "digits", "uppers", "lowers", "others", "switches", "into_digits", "out_of_digits", "case_changes", "common_pairs", "repeats", "distinct",
    "hex", "covered", "path", "address", "format", "assigned", "quoted", "secret_words", "harmless_words", "placeholder", "dashes",
]


@dataclass
class Judge:
    """A forest with the dictionary that its features need."""

    forest: RandomForestClassificationModel
    words: list[str] = field(default_factory=list)


def dictionary(docs: DataFrame, text_col: str = "text", n: int = DICTIONARY_WORDS) -> list[str]:
    """The n words of 4 to 12 letters a-z that stand in most documents; at most n words come to the driver."""
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(F.col(f"`{text_col}`")), "[^a-z]+"))).alias("word"))
    counts = words.where(F.length("word").between(4, 12)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(n).collect()]


def _patterns(words: list[str]) -> tuple[str, str]:
    """Patterns of the dictionary's words, the longest first, and of the letter pairs most common in them."""
    pairs = Counter(w[k : k + 2] for w in words for k in range(len(w) - 1))
    common = [p for p, _ in sorted(pairs.items(), key=lambda x: (-x[1], x[0]))[:COMMON_PAIRS]]
    return "(?i)" + "|".join(sorted(words, key=lambda w: (-len(w), w))), f"(?i)(?=(?:{'|'.join(common)}))[a-z]"


def _count(text: Column, pattern: str) -> Column:
    """Characters of text that match a pattern of single characters."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _any(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(pattern), F.lit(False)).cast("double")


def with_features(found: DataFrame, words: list[str]) -> DataFrame:
    """Adds FEATURES to rows with finding, value, before and after."""
    covered, pairs = _patterns(words) if words else ("(?!)", "(?!)")
    value, finding, before, after = (F.col(c) for c in ("value", "finding", "before", "after"))
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]", "0"), "[A-Z]", "A"), "[a-z]", "a"), "[^0Aa]", "-")
    switches = F.length(F.regexp_replace(shape, r"(.)\1*", "$1")) - 1
    around = F.concat(before, F.lit(" "), after)
    return found.withColumns({
        "length": n,
        "digits": _count(value, "[0-9]") / n,
        "uppers": _count(value, "[A-Z]") / n,
        "lowers": _count(value, "[a-z]") / n,
        "others": _count(value, "[^0-9A-Za-z]") / n,
        "switches": switches / n,
        "into_digits": F.regexp_count(shape, F.lit("[^0](?=0)")) / n,
        "out_of_digits": F.regexp_count(shape, F.lit("0(?=[^0])")) / n,
        "case_changes": F.regexp_count(shape, F.lit("a(?=A)|A(?=a)")) / n,
        "common_pairs": F.regexp_count(value, F.lit(pairs)) / n,
        "repeats": (n - F.length(F.regexp_replace(value, r"(.)\1+", "$1"))) / n,
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / n,
        "hex": _any(value, "^[0-9a-f]+$|^[0-9A-F]+$"),
        "covered": (n - F.length(F.regexp_replace(value, covered, ""))) / n,
        "path": F.greatest(_any(value, r"^[./~]|/.*/|\.[a-z]{2,4}$|\\|^www"), _any(before, r"(?i)(?:https?://\S*|/|\\|src=|href=)$")),
        "address": _any(finding, r"^[^@=:]+@[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)+\.?$|^[0-9.]+$"),
        "format": _any(finding, "|".join(FORMATS.values())),
        "assigned": F.greatest(_any(finding, f"^{ASSIGNED}"), _any(before, rf"(?i){NAMES}\W{{1,6}}$")),
        "quoted": _any(finding, "[\"']"),
        "secret_words": F.greatest(_any(around, SECRET_WORDS), _any(finding, SECRET_WORDS)),
        "harmless_words": _any(around, HARMLESS_WORDS),
        "placeholder": _any(value, PLACEHOLDERS),
        "dashes": _count(value, "[-_]"),
    })


def value_of(finding: Column) -> Column:
    """The part of a finding that would be the secret: what stands behind the sign, if there is one."""
    inner = F.regexp_extract(finding, rf"(?i){NAMES}[a-z0-9_]{{0,10}}[\"']?\s*(?:=>|=|:)\s*[\"']?([\s\S]+)$", 1)
    return F.when((F.length(inner) > 0) & ~finding.startswith("-----BEGIN"), inner).otherwise(finding)


def labelled_findings(spark: SparkSession, n: int = N_EXAMPLES, words: list[str] | None = None) -> DataFrame:
    """line-by-line examples: finding, before, after and label, spelled from hashes of row numbers and from words."""
    listed = F.array(*[F.lit(w) for w in (words or ["table", "river", "morning", "letter"])[:200]])

    def word(salt: str) -> Column:
        return F.element_at(listed, (F.pmod(F.xxhash64("id", F.lit(salt)), F.size(listed)) + 1).cast("int"))

    def digest(salt: str) -> Column:
        return F.sha2(F.concat(F.col("id").cast("string"), F.lit(salt)), 256)

    def letters(salt: str, k: int) -> Column:
        return F.regexp_replace(F.substring(F.base64(F.unhex(F.concat(digest(salt), digest(salt + "+")))), 1, k), "[+/=]", "q")

    def prose(salt: str) -> Column:
        return F.translate(F.substring(F.regexp_replace(digest(salt), "(.)", "$1a"), 1, 18), "0123456789", " tnrslmd h")

    def body(n: int) -> Column:
        return F.concat_ws("\n", *[F.base64(F.unhex(F.substring(F.concat(digest(f"y{i}"), digest(f"z{i}")), 1, 96))) for i in range(n)])

    digit = F.regexp_replace(digest("n"), "[a-f]", "")
    name = F.element_at(F.array(*[F.lit(x) for x in ("password", "db_password", "api_key", "secret", "auth_token", "token", "client_secret", "pwd")]), (F.col("id") % 8 + 1).cast("int"))
    sign = F.element_at(F.array(*[F.lit(x) for x in ("=", " = \"", ": ", "='")]), (F.floor(F.col("id") / 8) % 4 + 1).cast("int"))
    kinds = [
        (F.concat(F.lit("AKIA"), F.upper(letters("a", 16))), 1),
        (F.concat(F.lit("ghp_"), letters("g", 36)), 1),
        (F.concat(F.lit("sk_live_"), letters("s", 24)), 1),
        (F.concat(F.lit("xoxb-"), F.substring(digit, 1, 11), F.lit("-"), letters("x", 24)), 1),
        (F.concat(F.lit("eyJ"), letters("j", 20), F.lit("."), letters("k", 30), F.lit("."), letters("l", 30)), 1),
        (F.concat(F.lit("postgres://app:"), letters("p", 14), F.lit("@")), 1),
        (F.lit("-----BEGIN RSA PRIVATE KEY-----"), 1),
        (F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), body(12), F.lit("\n-----END RSA PRIVATE KEY-----")), 1),
        (F.concat(name, sign, F.lit("eyJ"), F.translate(body(7), "\n+/=", "qqqq"), F.lit("."), letters("r", 40), F.lit("."), letters("t", 40)), 1),
        (F.concat(name, sign, F.substring(digest("h"), 1, 18)), 1),
        (F.concat(name, sign, F.substring(digest("i"), 1, 40)), 1),
        (F.concat(name, sign, letters("v", 12)), 1),
        (F.concat(name, sign, letters("w", 32)), 1),
        (F.concat(name, sign, F.element_at(F.array(*[F.lit(x) for x in ("changeme", "********", "your_password", "${SECRET}", "example", "xxxxxxxx", "required", "undefined")]), (F.floor(F.col("id") / 3) % 8 + 1).cast("int"))), 0),
        (F.concat(name, F.lit(": "), F.regexp_replace(prose("m"), " ", "")), 0),
        (F.concat(name, sign, word("k")), 0),
        (F.concat(name, sign, word("k"), F.lit("_"), word("l")), 0),
        (F.concat_ws("-", word("k"), word("l"), word("m"), F.substring(digit, 1, 4)), 0),
        (F.concat(word("k"), F.lit("/"), word("l"), F.lit("/"), word("m"), F.substring(digit, 1, 3), F.lit(".html")), 0),
        (F.substring(digest("c"), 1, 40), 0),
        (digest("d"), 0),
        (F.concat_ws("-", *[F.substring(digest("u"), a, k) for a, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), 0),
        (F.concat(F.lit("/usr/share/lib/"), F.substring(digest("f"), 1, 12), F.lit("/index")), 0),
        (F.concat(F.lit("release-2024-"), F.substring(digit, 1, 6), F.lit("-build-"), F.substring(digit, 7, 5)), 0),
        (F.concat(F.lit("AAAAAAAAAAAAAAAAAAAA"), F.substring(digit, 1, 3)), 0),
        (F.concat(F.regexp_replace(prose("o"), " ", "e"), F.regexp_replace(prose("q"), " ", "i"), F.substring(digit, 1, 2)), 0),
    ]
    harmless = F.element_at(F.array(*[F.lit(x) for x in ("commit ", "sha256 checksum: ", "uuid ", "see https://host/", "order no ", "the file ", "and ", "build ")]), (F.floor(F.col("id") / 5) % 8 + 1).cast("int"))
    rows = spark.range(n)
    examples = [
        rows.select(
            finding.alias("finding"),
            F.concat(prose("b"), F.lit(" "), F.lit("") if label else harmless).alias("before"),
            F.concat(F.lit(" "), prose("e")).alias("after"),
            F.lit(float(label)).alias("label"),
        )
        for finding, label in kinds
    ]
    return reduce(DataFrame.unionByName, examples).withColumn("value", value_of(F.col("finding")))


def look_alikes(docs: DataFrame, text_col: str = "text", n: int = MOST_LOOKALIKES) -> DataFrame:
    """At most n findings of documents that are no secrets by their form, those with the smallest hashes, in the columns of labelled_findings."""
    found = _candidates(docs, F.col(f"`{text_col}`"), [], LOOKALIKES).select("finding", "before", "after", F.lit(0.0).alias("label"), "value").distinct()
    return found.orderBy(F.xxhash64("finding", "before", "after"), "finding", "before", "after").limit(n)


def train(findings: DataFrame, words: list[str] | None = None) -> Judge:
    """A forest over labelled findings: rows with finding, value, before, after and label."""
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(findings, words or [])).select("features", "label").coalesce(1)
    return Judge(RandomForestClassifier(numTrees=N_TREES, maxDepth=DEPTH, seed=SEED, minInstancesPerNode=2).fit(ready), words or [])


def trained(docs: DataFrame, text_col: str = "text") -> Judge:
    """A judge with the dictionary and the look-alikes of docs."""
    words = dictionary(docs, text_col)
    findings = spool(labelled_findings(docs.sparkSession, words=words).unionByName(look_alikes(docs, text_col)).coalesce(1), "findings")
    judge = train(findings, words)
    unspool(findings)
    return judge


def _cut(text: Column, pattern: str = CANDIDATE) -> tuple[Column, Column]:
    """A text's candidates in order, and the pieces between them (one more)."""
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), 1), F.split(text, pattern, -1)


def kind_of(finding: Column) -> Column:
    kinds = [F.when(finding.rlike(pattern), kind) for kind, pattern in FORMATS.items()]
    return F.coalesce(*kinds, F.when(finding.rlike(f"^{ASSIGNED}"), "assigned"), F.lit("mixed"))


def _candidates(docs: DataFrame, text: Column, keys: list[Column], pattern: str = CANDIDATE) -> DataFrame:
    found, pieces = _cut(text, pattern)
    rows = docs.where(text.rlike(pattern)).select(*keys, found.alias("found"), pieces.alias("pieces"))
    beside = F.transform(
        "found",
        lambda f, i: F.struct(
            i.alias("nth"),
            f.alias("finding"),
            F.right(F.get("pieces", i), F.lit(BESIDE)).alias("before"),
            F.left(F.get("pieces", i + 1), F.lit(BESIDE)).alias("after"),
        ),
    )
    rows = rows.select(*[k for k in rows.columns if k not in ("found", "pieces")], F.inline(beside))
    return rows.withColumn("value", value_of(F.col("finding"))).withColumn("kind", kind_of(F.col("finding")))


def judged(found: DataFrame, judge: Judge) -> DataFrame:
    """Candidates with the forest's probability and verdict."""
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(with_features(found, judge.words))
    scored = judge.forest.transform(ready).withColumn("probability", vector_to_array("probability")[1])
    return scored.drop(*FEATURES, "features", "rawPrediction", "prediction").withColumn("is_secret", F.col("probability") >= 0.5)


def scan(docs: DataFrame, judge: Judge, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per candidate: id_col, nth (from 0, in its text), kind, finding, value, before, after,
    probability and is_secret.

    Null and empty texts have no candidates. A repeated row repeats its candidates, and what a
    text holds twice is two candidates. Null ids stay null. Other columns of docs are left out,
    whatever their names. An empty table gives an empty table.
    """
    found = _candidates(docs, F.col(f"`{text_col}`"), [F.col(f"`{id_col}`").alias("id")])
    rows = judged(found, judge).select("id", "nth", "kind", "finding", "value", "before", "after", "probability", "is_secret")
    return rows.withColumnRenamed("id", id_col)


def redact(docs: DataFrame, judge: Judge, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with each confirmed secret replaced by a mark, and n_chars, if there is such a column, brought up to date.

    docs has to be a stored table. Rows without secrets, nulls among them, come out as they are,
    and repeated rows alike. The columns are those of docs, whatever their names. An empty table
    gives an empty table.
    """
    names = Names(docs.columns)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{text_col}`").alias("text"), names.pack().alias("row"))
    secrets = judged(_candidates(rows, F.col("text"), [F.col("rid")]), judge).where("is_secret")
    # A text's own candidates alone come together here.
    by_text = secrets.groupBy("rid").agg(F.collect_set("nth").alias("nths"))
    found, pieces = _cut(F.col("text"))
    marked = F.zip_with(
        pieces,
        F.transform(found, lambda f, i: F.when(F.array_contains("nths", i), F.concat(F.left(f, F.length(f) - F.length(value_of(f))), F.lit(mark))).otherwise(f)),
        lambda piece, f: F.concat(F.coalesce(piece, F.lit("")), F.coalesce(f, F.lit(""))),
    )
    columns = dict(zip(names.columns, names.unpack()))
    changed = F.col("nths").isNotNull()
    joined = rows.join(by_text, "rid", "left").withColumn("text", F.when(changed, F.array_join(marked, "")).otherwise(F.col("text")))
    columns[text_col] = F.col("text").alias(text_col)
    if "n_chars" in columns:
        columns["n_chars"] = F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"]).alias("n_chars")
    return joined.select(*[columns[c] for c in docs.columns])


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = scan(docs, trained(docs))
    digest = F.sha2(F.col("value"), 256).alias("value_sha256")
    return found.select("doc_id", "nth", "kind", F.length("value").alias("value_chars"), digest, "probability", "is_secret")

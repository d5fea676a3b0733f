"""Secret scans: pattern candidates, judged by a random forest, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import prepare
from pulsegrid.session import stage

MAX_LABELLED = 20_000  # labelled findings that fit the forest, at most, about half of each label
THRESHOLD = 0.5
MASK = "[secret]"

# Names before a secret, provider formats, other things that look alike, and common words.
NAMES = "password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth"
PROVIDERS = (
    r"^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,}|glpat-[A-Za-z0-9_-]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}"
    r"|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*|npm_[A-Za-z0-9]{30,}"
    r"|-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----.*)"
)
ORDINARY = (
    r"^(?:[\w.+-]+@[\w-]+\.[\w.]+|[a-z]+://.*|//[\w-]+(?:\.[\w-]+)+(?:[/:?#].*)?|/?(?:[\w.-]+/){2,}[\w.-]*|[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"
    r"|[-+0-9.,:/()%$#*&]+|\d+[a-z]{1,3}|v?\d+(?:\.\d+)+\w*|[a-z]+\d{1,4}|(?:\d{1,4}[-/.:T]){2,}[\dZ:.+-]*)$"
)
COMMON_WORDS = (
    "about admin after again also and another are available before between changeme client com config could data default der des die dummy "
    "each email ein example file first for from har have here home http https index into key las les like local los mail main name net new not "
    "null number one only org other out page par para password path pour que sample secret server some test text that the their there these "
    "they this time token two und une user value was were when which will with word would www xxxx year you your"
).split()

WORD_START = r"(?<![^\s\"'=:`,;(<\[])"
# A private key block up to its END, whatever stands between; without one, header lines and key characters. Line breaks
# may be written as \n and \r. All repetitions are possessive, so their length is not limited by the stack.
BLOCK_START = r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?)-----"
BREAK = r"\s|\\++[nrt]"
BLOCK = (
    rf"{BLOCK_START}(?:(?:[^-]++|-(?!----(?:BEGIN|END) ))*+-----END \1-----"
    rf"|(?:(?:{BREAK})*+[A-Z][A-Za-z0-9-]{{1,30}}+:[^\r\n\\]*+)*+(?:[A-Za-z0-9+/=]++|{BREAK})*+)"
)
BEFORE, AFTER, SHORTEST = 80, 40, 6
BLOCK_FEATURES = 20_000  # characters of a private key block that make its features
CANDIDATE = (
    rf"{BLOCK}"
    rf"|{WORD_START}(?:(?:AKIA|ASIA)[0-9A-Z]{{16}}(?![0-9A-Za-z])|[^\s\"'=:`,;(<\[0-9]*+[0-9][^\s\"'`,;)>\]]*+|(?<=(?i:{NAMES})[\"']?\s?[=:]\s?[\"']?)[^\s\"'`,;)>\]]{{{SHORTEST},}})"
)
FILLER = r"x{4,}|0{6,}|0?1234567(?:89?0?)?"  # makes a placeholder where it is half of a value or more
FEATURES = [
    "length", "turns", "digits", "upper", "lower", "marks", "variety", "hex_only", "covered", "longest_word", "path_like", "address_like",
    "named", "name_near", "quoted", "assigned", "placeholder", "common_before", "common_after", "provider",
]


def candidates(docs: DataFrame) -> DataFrame:
    """Everything in the whole texts that might be a secret: ``doc_id, _text, start, candidate, before, after``.

    ``_text`` is a hash of the text, which tells rows of one id apart.

    ``start`` counts characters from 0. A candidate is a word with a digit, a provider's key without one, the value given to a name such as
    ``password``, or a private key block, of ``SHORTEST`` characters or more. Null and empty texts give none; repeated
    rows give theirs each.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("_text"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("_row"))
    matched = rows.withColumn("found", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).where(F.size("found") > 0)
    between = F.transform(F.split("text", CANDIDATE, -1), lambda p: F.struct(F.length(p).alias("n"), F.right(p, F.lit(BEFORE)).alias("tail"), F.left(p, F.lit(AFTER)).alias("head")))
    parts = matched.select("doc_id", "_text", "_row", "found", between.alias("between"))
    count = F.size("found")
    zipped = F.arrays_zip(F.slice("between", 1, count).alias("left"), F.col("found"), F.slice("between", 2, count).alias("right"))
    each = parts.select("doc_id", "_text", "_row", F.posexplode(zipped).alias("k", "z")).select(
        "doc_id", "_text", "_row", "k", F.col("z.left.n").alias("gap"), F.col("z.left.tail").alias("before"), F.col("z.found").alias("candidate"), F.col("z.right.head").alias("after")
    )
    upto = Window.partitionBy("_row").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = each.withColumn("start", (F.sum(F.col("gap") + F.length("candidate")).over(upto) - F.length("candidate")).cast("long"))
    trimmed = F.regexp_replace("candidate", r"[.!?:*%#&$|]+$", "")
    return placed.withColumn("candidate", trimmed).where(F.length("candidate") >= SHORTEST).select("doc_id", "_text", "start", "candidate", "before", "after")


def is_block() -> Column:
    return F.col("candidate").rlike("^" + BLOCK_START)


def of_provider() -> Column:
    return (F.col("provider") == 1) & (F.col("placeholder") == 0)


def share(text: str, pattern: str) -> Column:
    """Share of the characters that ``pattern`` (a character class) matches."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / F.greatest(F.length(text), F.lit(1))


def with_features(found: DataFrame, words: list[str] = COMMON_WORDS) -> DataFrame:
    """Add the columns ``FEATURES``: length, character transitions, dictionary coverage, path and neighbouring words."""
    found = found.withColumn("_whole", F.col("candidate")).withColumn("candidate", F.when(is_block(), F.left("candidate", F.lit(BLOCK_FEATURES))).otherwise(F.col("candidate")))
    c = F.col("candidate")
    size = F.greatest(F.length(c), F.lit(1))
    kinds = F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "bcdefghijklmnopqrstuvwxyz" + "123456789", "A" * 26 + "a" * 25 + "0" * 9)
    runs = F.regexp_replace(kinds, r"(.)\1+", "$1")
    dictionary = "|".join(sorted((w for w in words if len(w) > 2), key=lambda w: (-len(w), w)))
    lone = F.regexp_replace(F.lower(c), dictionary, "")
    letters = F.regexp_extract_all(c, F.lit("[A-Za-z]+"), F.lit(0))
    last, following = F.lower(F.regexp_extract("before", r"([\p{L}]+)[^\p{L}]*$", 1)), F.lower(F.regexp_extract("after", r"^[^\p{L}]*([\p{L}]+)", 1))
    common = F.array(*[F.lit(w) for w in words])
    filled = F.length(F.regexp_replace(c, f"(?i){FILLER}", "")) * 2 <= F.length(c)
    flag = lambda text, pattern: F.col(text).rlike(pattern).cast("double")
    made = {
        "length": F.least(F.length(c), F.lit(200)).cast("double"),
        "turns": F.length(runs) / size,
        "digits": share("candidate", "[0-9]"),
        "upper": share("candidate", "[A-Z]"),
        "lower": share("candidate", "[a-z]"),
        "marks": share("candidate", "[^0-9A-Za-z]"),
        "variety": F.size(F.array_distinct(F.split(c, ""))) / size,
        "hex_only": flag("candidate", "^[0-9a-f]+$"),
        "covered": 1.0 - F.length(lone) / size,
        "longest_word": F.coalesce(F.array_max(F.transform(letters, lambda w: F.length(w))), F.lit(0)) / size,
        "path_like": flag("candidate", r"[/\\].*[/\\]|^[/~.]|\.[a-z]{2,4}$"),
        "address_like": flag("candidate", r"@|://|^//[\w-]+\.|^www\."),
        "named": flag("before", rf"(?i)(?:{NAMES})[\"']?\s{{0,2}}[=:]\s{{0,2}}[\"']?$"),
        "name_near": flag("before", rf"(?i)\b(?:{NAMES}|bearer|login|key)\b"),
        "quoted": flag("before", "[\"'`]$"),
        "assigned": flag("before", r"[=:]\s{0,2}[\"'`]?$"),
        "placeholder": flag("candidate", r"(?i)example|sample|dummy|changeme|your[_-]"),
        "common_before": F.array_contains(common, last).cast("double"),
        "common_after": F.array_contains(common, following).cast("double"),
        "provider": flag("candidate", "(?s)" + PROVIDERS),
    }
    made["placeholder"] = F.greatest(made["placeholder"], filled.cast("double"))
    return found.withColumns(made).withColumn("candidate", F.col("_whole")).drop("_whole")


def weak_label(featured: DataFrame) -> DataFrame:
    """Label findings that stand for themselves: 1.0 a private key block, a provider's format or a random-looking value given to a
    secret's name; 0.0 addresses, paths, numbers, dates, placeholders, words and hexadecimal digests that nothing names; others keep a null ``label``."""
    ordinary = F.col("candidate").rlike(ORDINARY) | (F.col("covered") > 0.6) | (F.col("placeholder") == 1)
    random = (F.col("named") == 1) & (F.col("digits") > 0.1) & (F.col("length") >= 10) & (F.col("variety") > 0.2)
    digest = (F.col("hex_only") == 1) & (F.col("named") == 0) & (F.col("name_near") == 0) & (F.col("assigned") == 0)
    unnamed = (F.col("named") == 0) & (F.col("name_near") == 0) & ((F.col("digits") < 0.15) | (F.col("turns") < 0.2))
    unnamed = unnamed & ~F.col("candidate").rlike("^[A-Za-z0-9+/]{40,}={0,2}$")  # might be a line of a key without its BEGIN
    return featured.withColumn("label", F.when(is_block() | of_provider(), 1.0).when(ordinary | digest, 0.0).when(random, 1.0).when(unnamed, 0.0))


@dataclass
class SecretModel:
    """A fitted forest, or none where the labelled findings had one label only."""

    forest: RandomForestClassificationModel | None
    only: float = 0.0


def fit(labelled: DataFrame, max_rows: int = MAX_LABELLED, trees: int = 20, depth: int = 6) -> SecretModel:
    """Fit on findings with ``FEATURES`` and a non-null ``label``, drawn by hash: about half of ``max_rows`` of each label.

    With one label only nothing can be told apart, and every finding gets that label; without any, none is a secret.
    """
    known = labelled.where("label IS NOT NULL")
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return SecretModel(None, next(iter(sizes), 0.0))
    draw = F.pmod(F.xxhash64("doc_id", "start", "candidate"), F.lit(1_000_000))
    rate = F.when(F.col("label") == 1, max_rows // 2 / sizes[1.0]).otherwise(max_rows // 2 / sizes[0.0])
    chosen = stage(known.where(draw < rate * 1_000_000).orderBy(draw, "doc_id", "start").limit(max_rows).select("label", *FEATURES), "labelled")
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(chosen)
    grower = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, minInstancesPerNode=2, seed=17)
    return SecretModel(grower.fit(rows))


def judge(featured: DataFrame, model: SecretModel) -> DataFrame:
    """Add ``score``, the forest's share for a secret."""
    if model.forest is None:
        return featured.withColumn("score", F.lit(model.only))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(featured)
    forest = model.forest.copy()
    forest.setFeaturesCol("_features").setRawPredictionCol("_raw").setProbabilityCol("_share").setPredictionCol("_prediction")
    return forest.transform(rows).withColumn("score", vector_to_array("_share")[1]).drop("_features", "_raw", "_share", "_prediction")


def secrets_of(docs: DataFrame, labelled: DataFrame | None, threshold: float) -> DataFrame:
    """Secrets with features and ``score``; ``_text`` as in ``candidates``."""
    prepare(docs.sparkSession)
    found = stage(weak_label(with_features(candidates(docs))), "findings")
    model = fit(found if labelled is None else with_features(labelled))
    known = F.when(is_block() | of_provider(), 1.0).when(F.col("provider") == 1, 0.0)
    return judge(found, model).withColumn("score", F.coalesce(known, "score")).where(F.col("score") >= threshold)


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Secrets in the whole texts: ``doc_id, start, length, secret, score``, one row each.

    ``labelled`` has findings as ``candidates`` gives them with a ``label`` (1.0 secret, 0.0 not); without it the
    findings that ``weak_label`` is sure of teach the forest, which then judges all but private key blocks and values in
    a provider's format, whose score is 1, or 0 if they are placeholders. Rows with a null id are scanned as well; other
    columns are ignored. An empty table has no secrets.
    """
    size = F.length("candidate").cast("long").alias("length")
    return secrets_of(docs, labelled, threshold).select("doc_id", "start", size, F.col("candidate").alias("secret"), F.round("score", 6).alias("score"))


def redact(docs: DataFrame, mask: str = MASK, labelled: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mask``; all rows and columns are kept.

    A row's own secrets are masked in it, whatever other rows have its id: they are joined by id and text.
    """
    found = secrets_of(docs, labelled, threshold).select("doc_id", "_text", F.col("candidate").alias("secret"))
    secrets = found.groupBy("doc_id", "_text").agg(F.sort_array(F.collect_set(F.struct(F.length("secret").alias("n"), "secret")), asc=False).alias("_secrets"))
    secrets = stage(secrets.select(F.col("doc_id").alias("_id"), "_text", "_secrets"), "secrets")
    joined = docs.join(secrets, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_text")), "left")
    clean = F.aggregate("_secrets", F.col("text"), lambda text, s: F.replace(text, s["secret"], F.lit(mask)))
    return joined.withColumn("text", F.when(F.col("_secrets").isNull(), F.col("text")).otherwise(clean)).select(*docs.columns)

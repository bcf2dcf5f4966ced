"""Secrets in texts: candidates by shape, false positives removed by a random forest.

A candidate is a run of characters of the alphabets of keys, inside a word between white space: of at
least 16 characters with a digit or with the prefix of a known kind of key, or of at least 6 where a
secret's name and = or : (or an Authorization header) come before it. '=' parts names from values and
belongs to a value only as padding at its end. The forest sees its length, the mix and the transitions of its characters,
how much of it dictionary words cover, whether it looks like a path, and the words around it. It is
trained on labelled findings: a table given by the caller, or else a bounded sample of the candidates
labelled by a naming rule (a key's own prefix, a bearer word, or an assignment to a name such as token or
password; not of a placeholder, a path, a reference or a word of a sentence). Everything is DataFrame work and Spark ML; scores never leave the JVM.

Defined results: null and empty texts have no candidates; repeated rows give repeated findings; a null
doc_id is kept as it is. With labelled findings of one kind only, or none, the labels' share (or the
rule itself) decides. Other columns are not read.
"""

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalcells.llm.scratch import Scratch

LEAST, LEAST_NAMED = 16, 6
KEY = "A-Za-z0-9+/_.-"
RUN = rf"(?<![{KEY}])[{KEY}]{{{LEAST_NAMED},}}(?:={{1,2}}(?![{KEY}=]))?"
LONG = rf"(?<![{KEY}])(?=[A-Za-z+/_.-]*[0-9])[{KEY}]{{{LEAST},}}"
#: Beginnings by which a key shows what it is.
PREFIX = (rf"(?<![{KEY}])(?:(?:gh[pousr]_|github_pat_|glpat-|npm_|pypi-|hf_|ya29\.|SG\.|shp(?:at|ss|ca|pa)_|"
          rf"dop_v1_|[sr]k_(?:live|test)_|AIza)[{KEY}]{{12,}}|xox[abeoprs]-[0-9A-Za-z-]{{10,}}|"
          rf"sk-(?:proj-|ant-)?[A-Za-z0-9_]{{16,}}|A[KS]IA[0-9A-Z]{{12,}}|eyJ[\w-]{{10,}}\.eyJ[\w-]{{10,}})")
#: Names of what is secret, and words that long identifiers are made of.
NAMES = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "access_key",
         "private_key", "credential", "auth", "bearer")
_NAME = rf"(?:{'|'.join(n for n in NAMES if n != 'bearer')})(?:s|[_-]?(?:key|token|id|value|hash))*"
_HEADER = r"authorization[\"']?\s*[:=]\s*[\"']?(?:bearer|basic|token)\s+[\"']?"
_LEADS = rf"(?i)(?:{_NAME}[\"'\]]*\s*(?:=>|:=|==?|:)\s*[(\[\"']*|{_HEADER})"
#: What stands directly before a value that is named as a secret, and a bearer word alone.
INTRODUCED, BEARER = f"{_LEADS}$", r"(?i)\bbearer\s+[\"']?$"
NAMED_VALUE = rf"{_LEADS}[{KEY}]{{{LEAST_NAMED},}}"
#: Values that stand for others: paths, dotted identifiers, empty values of languages.
REFERENCE = (r"^(?:\.{0,2}/.*|[A-Za-z_][A-Za-z_]*(?:\.[A-Za-z_]+)+|(?i:none|null|true|false|undefined|required|"
             r"optional|string|changeme|redacted|placeholder))\.?$")
DICTIONARY = ("example", "sample", "test", "dummy", "user", "home", "path", "file", "name", "data",
              "image", "index", "page", "html", "http", "https", "www", "com", "org", "version",
              "release", "number", "date", "time", "table", "value", "config", "default", "public",
              "static", "the", "and", "for", "with", "from", "this", "that")
TREES, DEPTH, SEED = 24, 5, 7
#: Most labelled findings the forest is trained on; all candidates are scored.
MOST_LABELLED = 4000
SECRET_FROM = 0.5
PLACEHOLDER = "[secret]"

FEATURES = ("length", "digits", "upper", "lower", "others", "distinct", "changes", "longest_run",
            "hex_only", "digits_only", "covered", "slashes", "dots", "extension", "name_before",
            "name_inside", "assigned", "quoted", "next_is_word", "introduced", "prefix", "reference")


def candidates(docs: DataFrame) -> DataFrame:
    """One row per candidate: doc_id, text_id, word (its number, from 0), value and words around."""
    text = F.coalesce("text", F.lit(""))
    texts = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_id"),
                         text.alias("text"))
             .where(F.col("text").rlike(LONG) | F.col("text").rlike(PREFIX) | F.col("text").rlike(NAMED_VALUE)))
    words = texts.select("doc_id", "text_id", F.regexp_extract_all(
        "text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("words"))
    def lead(i: Column) -> Column:
        return F.concat_ws(" ", F.when(i > 1, F.get("words", i - 2)), F.when(i > 0, F.get("words", i - 1)))

    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: (
        F.get("words", i).rlike(LONG) | F.get("words", i).rlike(PREFIX)
        | F.concat_ws(" ", lead(i), F.get("words", i)).rlike(NAMED_VALUE)))
    found = words.select("doc_id", "text_id", "words", F.explode(places).alias("word"))

    def near(shift: int) -> Column:
        return F.coalesce(F.get("words", F.col("word") + shift), F.lit(""))

    around = found.select("doc_id", "text_id", "word", near(0).alias("token"), near(-1).alias("before"),
                          near(-2).alias("before2"), near(1).alias("after"))
    pattern = rf"(.*?)({RUN})"
    whole, gaps, values = (F.regexp_extract_all("token", F.lit(pattern), F.lit(k)) for k in range(3))
    parts = around.select("*", whole.alias("whole"), gaps.alias("gaps"), values.alias("values"))
    # The text of the word before a value, from two values back.
    runs = F.transform("values", lambda v, i: F.struct(v.alias("value"), F.concat(
        F.array_join(F.slice("whole", F.greatest(F.lit(1), i - 1), F.least(i, F.lit(2))), ""),
        F.get("gaps", i)).alias("opening")))
    kept = F.filter(runs, lambda r: (
        ((F.length(r["value"]) >= LEAST) & r["value"].rlike("[0-9]")) | r["value"].rlike(f"^{PREFIX}")
        | F.concat_ws(" ", "before2", "before", r["opening"]).rlike(INTRODUCED)))
    return (parts.select(*around.columns, F.posexplode(kept).alias("part", "run"))
            .select(*around.columns, "part", F.col("run.value").alias("value"), F.col("run.opening").alias("opening")))


def features(found: DataFrame) -> DataFrame:
    """Adds the forest's inputs to candidates."""
    value, low = F.col("value"), F.lower("value")
    size = F.length(value).cast("double")
    names = "|".join(NAMES)

    def count(pattern: str, of: Column = value) -> Column:
        return F.regexp_count(of, F.lit(pattern)).cast("double")

    lead = F.concat_ws(" ", F.lower("before2"), F.lower("before"))
    runs = F.transform(F.regexp_extract_all(value, F.lit(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+"), F.lit(0)),
                       lambda r: F.length(r))
    # Findings of a caller have no place of the value.
    opening = F.col("opening") if "opening" in found.columns else F.expr("substring_index(token, value, 1)")
    ahead = F.concat_ws(" ", "before2", "before", opening)
    rest = F.expr("substring_index(token, value, -1)")
    uncovered = F.regexp_replace(low, "|".join(sorted(DICTIONARY, key=len, reverse=True)), "")
    left = F.regexp_replace(uncovered, f"{names}|key|[^a-z0-9]", "")
    sentence = (value.rlike(r"^[A-Za-z][a-z]*\.?$") & ~opening.rlike(r"[\"'(\[]$")
                & F.col("after").rlike(r"^[A-Za-z]+[.,]?$"))
    stands_for = (value.rlike(REFERENCE) | (left == "") | (F.size(F.array_distinct(F.split(value, ""))) <= 2)
                  | rest.startswith("(") | sentence)
    values = {
        "length": size, "digits": count("[0-9]") / size, "upper": count("[A-Z]") / size,
        "lower": count("[a-z]") / size, "others": count("[^A-Za-z0-9]") / size,
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / size,
        "changes": (F.size(runs) - 1) / size,
        "longest_run": F.array_max(runs) / size,
        "hex_only": low.rlike("^[0-9a-f]+$"), "digits_only": value.rlike("^[0-9.+-]+$"),
        "covered": 1 - F.length(uncovered) / size, "slashes": count("/"), "dots": count(r"\."),
        "extension": low.rlike(r"\.[a-z]{2,4}$"), "name_before": lead.rlike(names),
        "name_inside": F.lower("token").rlike(names),
        "assigned": F.col("before").rlike(r"[=:]$") | opening.rlike(r"[=:][\"']?$"),
        "quoted": opening.rlike(r"[\"']$"), "next_is_word": F.col("after").rlike(r"^[A-Za-z]+[.,]?$"),
        "introduced": ahead.rlike(INTRODUCED) | ahead.rlike(BEARER), "prefix": value.rlike(f"^{PREFIX}"),
        "reference": stands_for,
    }
    return found.select("*", *(F.coalesce(values[n].cast("double"), F.lit(0.0)).alias(f"f_{n}")
                               for n in FEATURES))


def rule_label() -> Column:
    """1 for a key with a prefix of its own, or a value named as a secret that stands for no other."""
    named = (F.col("f_introduced") > 0) & (F.col("f_reference") == 0)
    return F.when((F.col("f_prefix") > 0) | named, 1.0).otherwise(0.0)


def train(labelled: DataFrame) -> RandomForestClassificationModel | float:
    """A forest from findings with features and a label; with one kind of label, their share."""
    mean = labelled.agg(F.avg("label").alias("m")).first().m
    if mean is None or mean in (0.0, 1.0):
        return mean if mean is not None else 0.0
    columns = [f"f_{n}" for n in FEATURES]
    vectors = VectorAssembler(inputCols=columns, outputCol="vector").transform(labelled)
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=TREES,
                                    maxDepth=DEPTH, seed=SEED)
    return forest.fit(vectors.select("vector", "label"))


def scan(docs: DataFrame, findings: DataFrame | None = None, most: int = MOST_LABELLED,
         secret_from: float = SECRET_FROM) -> DataFrame:
    """All candidates with the forest's probability and its verdict.

    findings: labelled candidates (token, before, before2, after, value, label) to train on.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    found = scratch.write(features(candidates(docs)), "candidates")
    if findings is None:
        labelled = found.withColumn("label", rule_label())
    else:
        labelled = features(findings.withColumn("label", F.col("label").cast("double")))
    order = F.xxhash64("value", "token", "before")
    bounded = labelled.where("label is not null").orderBy(order, "value").limit(most)
    model = train(scratch.write(bounded, "labelled"))
    if isinstance(model, float):
        probability = rule_label() if findings is None else F.lit(model)
        scored = found.withColumn("probability", probability)
    else:
        columns = [f"f_{n}" for n in FEATURES]
        vectors = VectorAssembler(inputCols=columns, outputCol="vector").transform(found)
        scored = (model.transform(vectors)
                  .withColumn("probability", F.element_at(vector_to_array("probability"), 2)))
    return scored.select("doc_id", "text_id", "word", "part", "value", "probability",
                         (F.col("probability") >= secret_from).alias("secret"))


def report(findings: DataFrame) -> DataFrame:
    """Findings without the secrets themselves."""
    return findings.select(
        "doc_id", F.col("word").cast("long").alias("word"), F.col("part").cast("long").alias("part"),
        F.length("value").cast("long").alias("value_chars"), F.sha2("value", 256).alias("value_sha256"),
        F.round("probability", 6).alias("probability"), "secret")


def redacted(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """Documents with every value found secret replaced in their text; all columns are kept."""
    secrets = (scan(docs, findings).where("secret")
               .groupBy(F.col("doc_id").alias("s_doc"), F.col("text_id").alias("s_text"))
               .agg(F.collect_set("value").alias("s_values")))
    longest = F.array_sort(F.col("s_values"), lambda a, b: F.length(b) - F.length(a))
    text_id = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    joined = docs.join(secrets, docs["doc_id"].cast("long").eqNullSafe(secrets["s_doc"])
                       & (text_id == secrets["s_text"]), "left")
    text = F.when(F.col("s_values").isNull(), docs["text"]).otherwise(
        F.aggregate(longest, docs["text"], lambda t, v: F.when(
            F.length(v) >= LEAST, F.replace(t, v, F.lit(PLACEHOLDER))).otherwise(
            # A short value may be part of other words.
            F.regexp_replace(t, F.concat(F.lit(rf"(?<![{KEY}])\Q"), v, F.lit(rf"\E(?![{KEY}])")),
                             F.lit(PLACEHOLDER)))))
    return joined.select(*(text.alias("text") if c == "text" else docs[c] for c in docs.columns))

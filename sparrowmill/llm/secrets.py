"""Secret scans: candidates by pattern, false ones removed by a random forest."""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowmill.llm.common import release, written
from sparrowmill.sources import table

#: A quoted value of six and more characters assigned to a name that speaks of secrets, or else a run of sixteen and more.
KEYED = r"(?<=[\"'])(?<=(?i:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|credential|bearer|auth)[\"']?\s{0,3}[=:]\s{0,3}[\"'])[^\s\"']{6,}"
CANDIDATE = rf"{KEYED}|[A-Za-z0-9+/_=-]{{16,}}"
KEYWORD = r"(?i)(token|secret|passw(or)?d|api[_-]?key|access[_-]?key|credential|bearer|auth)"
ASSIGNED = r"[=:]\s*[\"']?$"
PLACEHOLDER = r"(?i)(example|sample|dummy|placeholder|changeme|redacted|xxxx|test)"
#: Words that ordinary identifiers, paths and prose are made of.
DICTIONARY = "able account and back base build class code config content data date default document end error event file first for form from group have home http image index info item key language last line link list local main name next node number object option order page part path people place point public report result section server service set size source start state string system table task test text that the this time title type update user value version view web with word work www".split()
FEATURES = ("len", "transitions", "digits", "uppers", "distinct", "hexes", "dictionary", "known", "surprise", "path_code", "path_test", "keyword", "assigned", "quoted", "placeholder")
#: Words as a text has them: letters with neither letters nor digits beside them, so that parts of tokens are none.
WORD = r"(?<![a-z0-9])[a-z]{2,32}(?![a-z0-9])"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("secret", "ordinal", "before", "after")


def words(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(word, n)`` over all texts, added up before the shuffle."""
    found = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0))
    return docs.select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def surprise(counted: DataFrame, value: Column) -> Column:
    """Mean bits for a letter of ``value`` after the one before it, by the pairs
    of letters within the counted words (27 by 27 with one class for all other
    characters, each count plus one). Pairs of the corpus read like words; random
    values cost more than log2 27 where they hit pairs that words avoid."""
    pairs = counted.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr("word", i, F.lit(2)))).alias("pair"), "n")
    table = [[1.0] * 27 for _ in range(27)]
    for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect():
        table[LETTERS.index(r["pair"][0]) + 1][LETTERS.index(r["pair"][1]) + 1] += r["n"]
    bits = F.lit([math.log2(sum(row) / x) for row in table for x in row])
    places = F.transform(F.split(F.lower(value), ""), lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(LETTERS), c)))
    steps = F.zip_with(F.slice(places, 1, F.size(places) - 1), F.slice(places, 2, F.size(places) - 1), lambda x, y: F.get(bits, x * 27 + y))
    return F.aggregate(steps, F.lit(0.0), lambda x, y: x + y) / F.greatest(F.lit(1), F.size(steps))


def known(counted: DataFrame, found: DataFrame, per_million: int = 2, least: int = 3) -> DataFrame:
    """``(secret, known)``: the share of a value's characters in parts of four and
    more letters, cut at capitals, that are words of the corpus at least
    ``least`` times and ``per_million`` in a million. Once per distinct value."""
    total = counted.agg(F.sum("n")).first()[0] or 0
    common = counted.filter((F.col("n") >= least) & (F.col("n") * 1_000_000 >= per_million * total) & (F.length("word") >= 4)).select("word")
    parts = found.select("secret").distinct().select("secret", F.explode(F.regexp_extract_all("secret", F.lit("[A-Z]?[a-z]+|[A-Z]+"), F.lit(0))).alias("word")).withColumn("word", F.lower("word"))
    parts = parts.groupBy("secret", "word").agg((F.count("*") * F.length("word")).alias("chars"))
    return parts.join(common, "word", "left_semi").groupBy("secret").agg((F.sum("chars") / F.length("secret")).alias("known"))


def candidates(docs: DataFrame, text: str = "text", path: str = "source", near: int = 48) -> DataFrame:
    """One row per candidate in a text, with ``secret``, ``ordinal``, the words
    ``before`` and ``after`` it and its features.

    A candidate is a run of 16 and more characters of those that keys are made
    of, or any quoted value of six and more after a name that speaks of secrets
    and ``=`` or ``:``. Texts are split at the candidates, so the neighbours of
    the n-th are pieces n and n + 1; only rows with a candidate are exploded.
    ``near`` characters on each side are its neighbours. Words and pairs of
    letters are counted over all texts."""
    t = F.coalesce(F.col(text), F.lit(""))
    # A cheap test first: most texts have no run this long.
    rows = docs.filter(t.rlike(CANDIDATE)).withColumns({"_all": F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0)), "_gaps": F.split(t, CANDIDATE)})
    rows = rows.select("doc_id", F.col(path).alias("_path"), F.posexplode(F.transform("_all", lambda s, i: F.struct(s.alias("s"), F.get("_gaps", i).alias("b"), F.get("_gaps", i + 1).alias("a")))).alias("ordinal", "_x"))
    s = F.col("_x.s")
    rows = rows.select("doc_id", "_path", "ordinal", s.alias("secret"), F.right("_x.b", F.lit(near)).alias("before"), F.left("_x.a", F.lit(near)).alias("after"))
    s, n = F.col("secret"), F.length("secret")

    def share(pattern: str):
        return (n - F.length(F.regexp_replace(s, pattern, ""))) / n

    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "[^A-Za-z0-9]", "-"), "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0")
    place = F.coalesce(F.col("_path"), F.lit(""))
    counted, rows = written(words(docs, text)), written(rows)
    rows = rows.join(known(counted, rows), "secret", "left")
    return rows.withColumns({
        "known": F.coalesce("known", F.lit(0.0)),
        "surprise": surprise(counted, s),
        "len": n.cast("double"),
        "transitions": F.length(kinds) / n,
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "distinct": F.size(F.array_distinct(F.split(s, ""))).cast("double"),
        "hexes": share("[0-9a-f]"),
        "dictionary": share("(?i)" + "|".join(sorted((w for w in DICTIONARY if len(w) > 2), key=len, reverse=True))),
        "path_code": place.rlike(r"(?i)\.(py|js|java|go|rb|env|ya?ml|json|conf|ini|sh)$").cast("double"),
        "path_test": place.rlike("(?i)test|example|doc").cast("double"),
        "keyword": F.col("before").rlike(KEYWORD).cast("double"),
        "assigned": F.col("before").rlike(ASSIGNED).cast("double"),
        "quoted": (F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")).cast("double"),
        "placeholder": (s.rlike(PLACEHOLDER) | F.col("before").rlike(PLACEHOLDER)).cast("double"),
    }).drop("_path")


def weak_label(found: DataFrame) -> DataFrame:
    """Labels for a corpus without reviewed findings: 1 for a random-looking
    value assigned to a name that speaks of secrets, 0 for words and
    placeholders; the rest is left without a label."""
    random = (F.col("distinct") >= 10) & (F.col("digits") > 0.1) & (F.col("dictionary") < 0.5)
    label = F.when((F.col("keyword") == 1) & (F.col("assigned") == 1) & random & (F.col("placeholder") == 0), 1)
    return found.withColumn("label", label.when((F.col("digits") < 0.05) | (F.col("dictionary") > 0.6) | (F.col("placeholder") == 1), 0))


def fit(findings: DataFrame, max_rows: int = 20_000, trees: int = 20, depth: int = 6, seed: int = 7) -> RandomForestClassificationModel | None:
    """A forest on about ``max_rows`` labelled findings, half of them of each
    label, or all where there are fewer. Findings that look alike are one row,
    weighted by their number, so copies of a value do not fill the sample, and
    a label that occurs is in it: of a label's rows those with the lowest hashes
    are taken by a threshold, without a sort. None where there are not both
    labels to learn from."""
    alike = findings.filter("label IS NOT NULL").groupBy(*FEATURES, F.col("label").cast("double").alias("label")).agg(F.count("*").cast("double").alias("weight"))
    alike = written(alike)
    counts = {r["label"]: r["count"] for r in alike.groupBy("label").count().collect()}
    if len(counts) < 2:
        release(alike)
        return None
    below = F.lit(0)
    for label, n in counts.items():
        below = F.when(F.col("label") == label, int(min(1.0, max_rows / 2 / n) * (1 << 30))).otherwise(below)
    rows = alike.filter(F.pmod(F.xxhash64(*FEATURES, F.lit(5)), F.lit(1 << 30)) < below)
    made = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, weightCol="weight").fit(made)
    release(alike)
    return model


def judge(found: DataFrame, model: RandomForestClassificationModel | None, threshold: float = 0.5) -> DataFrame:
    """``found`` with ``p_secret`` and ``reported``. Without a model, every
    candidate is reported at probability one half."""
    if model is None:
        return found.withColumns({"p_secret": F.lit(0.5), "reported": F.lit(True)})
    made = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found))
    p = F.get(vector_to_array("probability"), F.lit(1))
    return made.withColumn("p_secret", p).drop("features", "rawPrediction", "probability", "prediction").withColumn("reported", F.col("p_secret") >= threshold)


def scan(docs: DataFrame, text: str = "text", path: str = "source") -> DataFrame:
    """Every candidate with its probability of being a secret. Null and empty
    texts have none; a very long one is read whole, and all its candidates come
    out; a null path counts as empty; repeated rows are all reported, and alike;
    at a probability of exactly one half a candidate is reported; an empty table
    gives no rows; other columns are not carried."""
    found = written(candidates(docs, text, path))
    return judge(found, fit(weak_label(found)))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "ordinal", F.sha2("secret", 256).alias("secret_sha256"), "p_secret", "reported")


QUERIES = {"op5_secret_scan": op5_secret_scan}
ORACLE_SQL: dict[str, str] = {}

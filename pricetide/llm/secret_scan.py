"""Secrets in texts: candidates by context and shape, false positives removed by a random forest.

A candidate is any of these inside a word (what stands between white space):
  * an issuer's format (ISSUERS, or a signed token of dotted parts), wherever in the word it stands;
  * else the value assigned to a name like "password" (NAMES, then = or :), of any length and characters, in the same
    word or in the next ones. It ends at its closing quote or at white space;
  * else every run of MIN_LENGTH key characters (KEY_CHARS) or more.
Length, digits and the rest are features only; the forest decides. It sees how often the class of character changes
from one to the next, how likely the letters follow each other in the words of the table (``Lexicon.follows``), how
much is covered by the table's own frequent words (``Lexicon.dictionary``), the path, and the words around it.

It is trained from labelled findings, on at most TRAIN_FINDINGS of them. ``weak_labels`` gives such labels where
no person has: known issuers, and values assigned to a name that are no word of the dictionary, are secrets; numbers,
plain words, and texts that stand in several contexts under no such name, are not. All of it is DataFrame functions
and Spark's own forest, without user functions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import WORD
from pricetide.session import stage

KEY_CHARS = "[A-Za-z0-9+/_-]"
MIN_LENGTH = 16
TRAIN_FINDINGS = 20_000
TREES, DEPTH = 20, 6
THRESHOLD = 0.5
# A dictionary word stands LEAST_COUNT times or more and is at least one of MOST_WORDS words, so there are at most MOST_WORDS.
LEAST_COUNT, MOST_WORDS = 5, 1_000_000
# Classes of characters: a to z are 1 to 26, a digit is 27, anything else 0.
CLASSES = 28

# Names that secrets are assigned to, issuers' formats.
NAMES = "password|passwd|pwd|passphrase|secret(?!ar)|token(?!i)|api_?key|access_?key|auth(?!or)|credential|private_?key"
ISSUERS = (
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abpr]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}"
    r"|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)?)"
)

_RUN = f"{KEY_CHARS}{{{MIN_LENGTH},}}"
# The value is the end of the last word; the name stands before it, in that word or in the two before.
_ASSIGNED = rf"(?i)(?:{NAMES})[\w-]{{0,20}}[\"'\]]{{0,2}}\s*(?:=>|:=|==?|:)\s*([^\s=:>]\S*)$"

FEATURES = (
    "length", "changes", "follows", "digits", "capitals", "hex", "distinct_chars", "dictionary",
    "other_chars", "path_chars", "path_depth", "named", "assigned", "quoted", "next_capital",
)


@dataclass
class Lexicon:
    """What the words of a table say: frequent words (column ``word``), and ln P(next class | class) by class * CLASSES + next."""

    dictionary: DataFrame
    follows: list[float]


def _codes(text: Column) -> Column:
    """The class of every character."""
    letter = lambda c: F.when(c.between("a", "z"), F.ascii(c) - 96).when(c.between("0", "9"), 27).otherwise(0)
    return F.transform(F.split(F.lower(text), ""), letter)


def _pairs(codes: Column) -> Column:
    """Class * CLASSES + next class for every two neighbours; none for a single character."""
    ahead = F.slice(codes, F.lit(2), F.greatest(F.size(codes) - 1, F.lit(0)))
    return F.zip_with(F.slice(codes, F.lit(1), F.greatest(F.size(codes) - 1, F.lit(0))), ahead, lambda a, b: a * CLASSES + b)


def learn_words(docs: DataFrame) -> Lexicon:
    """The lexicon of every whole text: each run of two letters or more, counted in lower case."""
    low = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    found = docs.select(F.explode(F.regexp_extract_all(low, F.lit(r"(\p{L}{2,})"))).alias("word"))
    words = stage(found.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "secret-words")
    total = words.agg(F.sum("n")).first()[0] or 0
    frequent = words.where((F.col("n") >= LEAST_COUNT) & (F.col("n") * MOST_WORDS >= total)).select("word")
    pairs = words.select("n", F.explode(_pairs(_codes(F.col("word")))).alias("pair")).groupBy("pair").agg(F.sum("n").alias("n"))
    # At most CLASSES * CLASSES rows.
    seen = {r["pair"]: r["n"] for r in pairs.collect()}
    sums = [sum(seen.get(a * CLASSES + b, 0) for b in range(CLASSES)) for a in range(CLASSES)]
    return Lexicon(frequent, [math.log((seen.get(i, 0) + 1) / (sums[i // CLASSES] + CLASSES)) for i in range(CLASSES * CLASSES)])


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, path, at (word number from 0), word, before, after, candidate for every candidate of every whole text.

    ``path`` is the column ``path``, else ``source``, else empty. Null texts have none.
    """
    path = next((c for c in ("path", "source") if c in docs.columns), None)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")).alias("path"),
        F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(f"({WORD})")).alias("words"),
    )

    def found(words: Column) -> Column:
        word = lambda i: F.coalesce(F.get(words, i), F.lit(""))

        def place(w: Column, i: Column) -> Column:
            sign = w.contains("=") | w.contains(":") | word(i - 1).endswith("=") | word(i - 1).endswith(":")
            near = F.concat_ws(" ", word(i - 2), word(i - 1), w)
            return F.when((F.length(w) >= MIN_LENGTH) & w.rlike(_RUN), i).when(sign, F.when(near.rlike(_ASSIGNED), i))

        context = lambda i: F.struct(
            i.alias("at"), word(i).alias("word"), word(i - 2).alias("before2"), word(i - 1).alias("before1"), word(i + 1).alias("after")
        )
        return F.transform(F.filter(F.transform(words, place), lambda i: i.isNotNull()), context)

    each = rows.select("doc_id", "path", F.explode(found(F.col("words"))).alias("c")).select("doc_id", "path", "c.*")
    each = each.withColumn("before", F.trim(F.concat_ws(" ", "before2", "before1")))
    raw = F.regexp_extract(F.concat_ws(" ", "before2", "before1", "word"), _ASSIGNED, 1)
    quoted = F.regexp_extract(raw, r"^([\"'`])(.+?)(?:\1|$)", 2)
    value = F.when(quoted != "", quoted).otherwise(F.regexp_replace(raw, r"[\"'`,;.!?)\]}]+$", ""))
    issued = F.regexp_extract_all("word", F.lit(f"({ISSUERS})"))
    # A run ends where an issuer's format begins.
    runs = F.regexp_extract_all(F.regexp_replace("word", f"({ISSUERS})", " $1 "), F.lit(f"({ISSUERS}|{_RUN})"))
    chosen = F.when((F.size(issued) == 0) & (value != ""), F.array(value)).otherwise(runs)
    return each.select("doc_id", "path", "at", "word", "before", "after", F.explode(chosen).alias("candidate"))


def _by_text(found: DataFrame, lexicon: Lexicon) -> DataFrame:
    """candidate, places, follows, dictionary: a row for each different candidate."""
    each = stage(found.groupBy("candidate").agg(F.approx_count_distinct("before").alias("places")), "secret-texts")
    parts = F.regexp_extract_all(F.regexp_replace("candidate", r"(?<=\p{Ll})(?=\p{Lu})", " "), F.lit(r"(\p{L}{2,})"))
    known = each.select("candidate", F.explode(parts).alias("part")).select("candidate", F.lower("part").alias("word")).join(lexicon.dictionary, "word")
    cover = known.groupBy("candidate").agg(F.sum(F.length("word")).alias("covered"))
    pairs, table = _pairs(_codes(F.col("candidate"))), F.lit(lexicon.follows)
    total = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.get(table, p))
    return each.join(cover, "candidate", "left").select(
        "candidate",
        "places",
        F.when(F.size(pairs) > 0, total / F.size(pairs)).otherwise(F.lit(min(lexicon.follows))).alias("follows"),
        (F.coalesce("covered", F.lit(0)) / F.length("candidate")).alias("dictionary"),
    )


def with_features(found: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``found``, the columns FEATURES (doubles), and ``places``: in about how many contexts the candidate stands."""
    c, low, n = F.col("candidate"), F.lower("candidate"), F.length("candidate")
    share = lambda pattern, text: F.coalesce(F.regexp_count(text, F.lit(pattern)) / n, F.lit(0.0))
    # A change of class is a place between two characters of unlike class.
    changes = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"
    near = F.lower(F.concat_ws(" ", "before", F.expr("substring(word, 1, greatest(position(candidate, word) - 1, 0))")))
    values = {
        "length": n,
        "changes": share(changes, c),
        "digits": share("[0-9]", c),
        "capitals": share("[A-Z]", c),
        "hex": share("[0-9a-f]", low),
        "distinct_chars": F.size(F.array_distinct(F.split(c, ""))) / n,
        "other_chars": share("[^A-Za-z0-9+/_-]", c),
        "path_chars": share("[/_-]", c),
        "path_depth": F.size(F.split("path", "/")),
        "named": near.rlike(NAMES),
        "assigned": near.rlike("[=:>] *[\"'`]?$"),
        "quoted": near.rlike("[\"'`]$"),
        "next_capital": F.col("after").rlike(r"^\p{Lu}"),
    }
    # Written before the join, so that Spark knows its size, and can split the tasks of a frequent candidate.
    texts = stage(_by_text(found, lexicon), "secret-features")
    return found.join(texts, "candidate").withColumns({k: v.cast("double") for k, v in values.items()})


def weak_labels(found: DataFrame) -> DataFrame:
    """``found`` (with features) and ``label``: 1.0 secret, 0.0 not, null unknown."""
    word = F.col("candidate").rlike(r"^\p{L}\p{Ll}*$")
    issued = F.col("candidate").rlike(f"^(?:{ISSUERS})$")
    named = (F.col("named") > 0) & (F.col("assigned") > 0)
    plain = F.col("dictionary") >= 0.6
    false = (F.col("digits") >= 1) | plain | word | (F.col("places") >= 3)
    return found.withColumn("label", F.when(issued | (named & ~plain), 1.0).when(~named & false, 0.0).when(plain, 0.0))


def train(labelled: DataFrame, most: int = TRAIN_FINDINGS) -> PipelineModel | None:
    """A forest from findings with features and ``label``, on at most about ``most`` of them by a hash; None without both labels."""
    sums = {r["label"]: r["count"] for r in labelled.where("label is not null").groupBy("label").count().collect()}
    if len(sums) < 2:
        return None
    each = F.when(F.col("label") > 0, most / 2 / sums[1.0]).otherwise(most / 2 / sums[0.0])
    chosen = labelled.where(F.col("label").isNotNull() & (F.pmod(F.xxhash64("doc_id", "at", "candidate"), F.lit(1_000_003)) / 1_000_003 < each))
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=7)
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), forest]).fit(chosen.select("label", *FEATURES))


def scan(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """doc_id, at, candidate, before, score, secret for every candidate; ``secret`` where the forest says so.

    ``labelled`` are findings (columns of ``candidates`` and ``label``); without them weak labels are made from
    ``docs``. Without labels of both kinds every candidate has score 0.5 and counts as a secret, since nothing
    was learned to remove it. A value in quotes that holds white space is cut at it. Null ids and repeated rows give
    findings like others; an empty table gives none; other columns are ignored.
    """
    lexicon = learn_words(docs)
    found = stage(with_features(stage(candidates(docs), "secret-candidates"), lexicon), "secret-findings")
    if labelled is None:
        model = train(weak_labels(found))
    else:
        model = train(with_features(labelled.select("doc_id", "path", "at", "word", "before", "after", "candidate", "label"), lexicon))
    if model is None:
        scored = found.withColumn("score", F.lit(0.5))
    else:
        scored = model.transform(found).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    return scored.select("doc_id", "at", "candidate", "before", F.round("score", 6).alias("score"), (F.col("score") >= THRESHOLD).alias("secret"))

"""Quality by weak supervision: rules vote or abstain, and EM weighs them.

Each rule looks at one figure of a text and votes good (+1), bad (-1) or
abstains (0). A latent class (good or bad) is assumed; expectation-maximisation
over the counts of vote patterns estimates the share of good texts and each
rule's accuracy on either class, and the posterior probability of good, not a
conjunction of all rules, decides. There are at most 3^rules patterns, so EM runs
over one small array; it is one expression, without a job for each step. All of
it is built-in functions.

Figures (words are runs of ``[^\\x20\\x09-\\x0D]``): word_chars, n_symbols,
n_dup_lines and n_repeat_words as the base has them. Repeated three-word windows
are found per text by sorting keys of hash and position; windows whose hashes
agree are sorted again by their words, so that no collision hides a repeat or
makes one.

Rows that fail the base are out whatever the rules say, and EM leaves them out.

Defined cases: a null text has no words and fails the base; rules abstain where
their figure has no denominator; repeated rows count as often as they occur; an
empty table gives an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.llm import scratch
from proofmill.llm.words import words_of

SYMBOLS, KINDS = "[#*$%&|<>]", "#*$%&|<>"
WORD = "[^\\x20\\x09-\\x0D]"

#: (name, figure, good up to, bad from): votes good at or below the first bound, bad at or above the second.
RULES: tuple[tuple[str, Callable[[], Column], float, float], ...] = (
    ("symbols", lambda: F.try_divide("n_symbols", "word_chars"), 0.01, 0.05),
    ("symbol_kinds", lambda: F.when(F.col("n_words") > 0, F.col("n_symbol_kinds")), 2, 5),
    ("dup_lines", lambda: F.try_divide("n_dup_lines", "n_lines"), 0.10, 0.30),
    ("repeats", lambda: F.try_divide("n_repeat_words", "n_words"), 0.15, 0.35),
    ("capitals", lambda: F.try_divide("n_upper", "word_chars"), 0.15, 0.40),
    ("shouts", lambda: F.try_divide("n_shouts", "n_words"), 0.10, 0.30),
    ("word_length", lambda: F.abs(F.try_divide("word_chars", "n_words") - 5.5), 3.5, 6.0),
)


def _sum(items: Column, of: Callable[[Column], Column]) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda total, x: total + of(x))


def figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id with all figures of its text, in one pass and without a shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), words_of(F.col(text_col)).alias("_w"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD))
    # each step is a projection whose result the next uses more than once, so that it is computed once
    counted = base.select(
        "_id",
        "_w",
        F.size("_w").alias("n_words"),
        F.char_length(F.array_join("_w", "")).alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).alias("n_symbols"),
        sum([F.contains("_text", F.lit(k)).cast("int") for k in KINDS], F.lit(0)).alias("n_symbol_kinds"),
        F.regexp_count("_text", F.lit("[A-Z]")).alias("n_upper"),
        (F.char_length("_text") - F.char_length(F.replace("_text", F.lit("!"), F.lit("")))).alias("n_shouts"),
        lines.alias("_lines"),
        F.length(F.bin(F.size("_w"))).alias("_bits"),
    )
    windows = F.transform("_w", lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2)))
    hashed = counted.withColumns({
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "_hashes": F.slice(windows, 1, F.greatest(F.col("n_words") - 2, F.lit(0))),
    })

    def head(k: Column) -> Column:
        return F.call_function("shiftright", k, F.col("_bits"))

    def place(k: Column) -> Column:
        return k.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bits")) - 1).cast("int")

    # most texts have no window twice and end here
    keys = F.sort_array(F.transform("_hashes", lambda h, i: F.call_function("shiftleft", h, F.col("_bits")).bitwiseOR(i.cast("long"))))
    none = F.array().cast("array<bigint>")
    keyed = hashed.withColumn("_keys", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), keys).otherwise(none)).drop("_hashes")
    headed = keyed.withColumn("_heads", F.transform("_keys", head))
    met = headed.withColumn("_met", F.zip_with("_heads", F.slice("_heads", 2, F.greatest(F.size("_heads"), F.lit(1))), lambda a, b: a == b))
    close = met.withColumn("_close", F.filter("_keys", lambda k, j: F.get("_met", j) | F.get("_met", j - 1))).drop("_heads", "_met", "_keys")
    spelled = F.transform(F.transform("_close", place), lambda p: F.struct(F.get("_w", p).alias("a"), F.get("_w", p + 1).alias("b"), F.get("_w", p + 2).alias("c"), p.alias("p")))
    close = close.withColumn("_close", F.sort_array(spelled))

    def same(x: Column, y: Column) -> Column:
        return F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))

    twice = F.filter("_close", lambda x, j: same(x, F.get("_close", j - 1)) | same(x, F.get("_close", j + 1)))
    found = close.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x["p"])))
    steps = F.zip_with("_at", F.slice("_at", 2, F.greatest(F.size("_at") - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)
    return found.select(F.col("_id").alias(id_col), *[F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_symbol_kinds", "n_upper", "n_shouts", "n_lines", "n_dup_lines")], covered.alias("n_repeat_words"))


def vote(figure: Column, good: float, bad: float) -> Column:
    return F.when(figure <= good, 1.0).when(figure >= bad, -1.0).otherwise(0.0)


def posteriors(patterns: DataFrame, n_rules: int, steps: int = 40, share: float = 0.7, on_good: float = 0.98, on_bad: float = 0.3, weight: float = 10.0) -> DataFrame:
    """(pattern, n_rows, posterior): one row for each vote pattern (pattern, votes, n), after EM from the given start.

    ``weight`` rows that agree with the start are added to each estimate.
    """
    one = patterns.agg(F.array_sort(F.collect_list(F.struct("pattern", "votes", "n"))).alias("ps"))

    def belief(model: Column, votes: Column) -> Column:
        odds = F.log(model["share"] / (1 - model["share"]))
        for j in range(n_rules):
            good, bad = model["good"][j], model["bad"][j]
            odds = odds + F.when(votes[j] > 0, F.log(good / (1 - bad))).when(votes[j] < 0, F.log((1 - good) / bad)).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))

    def model_of(sh: Column, good: list[Column], bad: list[Column]) -> Column:
        return F.struct(sh.alias("share"), F.array(*good).alias("good"), F.array(*bad).alias("bad"))

    def bounded(x: Column) -> Column:
        return F.least(F.greatest(x, F.lit(0.001)), F.lit(0.999))

    def step(model: Column, _: Column) -> Column:
        def update(q: Column) -> Column:
            good, bad = [], []
            for j in range(n_rules):
                on = lambda x, want, j=j: F.when(x["votes"][j] == want, x["n"]).otherwise(0.0)
                any_vote = lambda x, j=j: F.when(x["votes"][j] != 0, x["n"]).otherwise(0.0)
                good.append(bounded((_sum(q, lambda x, on=on: on(x, 1.0) * x["p"]) + weight * on_good) / (_sum(q, lambda x, a=any_vote: a(x) * x["p"]) + weight)))
                bad.append(bounded((_sum(q, lambda x, on=on: on(x, -1.0) * (1 - x["p"])) + weight * on_bad) / (_sum(q, lambda x, a=any_vote: a(x) * (1 - x["p"])) + weight)))
            total = _sum(q, lambda x: x["n"])
            return model_of(bounded((_sum(q, lambda x: x["n"] * x["p"]) + weight * share) / (total + weight)), good, bad)

        beliefs = F.transform("ps", lambda x: F.struct(x["votes"].alias("votes"), x["n"].alias("n"), belief(model, x["votes"]).alias("p")))
        return F.element_at(F.transform(F.array(beliefs), update), 1)

    start = model_of(F.lit(share), [F.lit(on_good)] * n_rules, [F.lit(on_bad)] * n_rules)
    fitted = one.select("ps", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step).alias("m"))
    out = fitted.select(F.explode(F.transform("ps", lambda x: F.struct(x["pattern"].alias("pattern"), x["n"].alias("n_rows"), belief(F.col("m"), x["votes"]).alias("posterior")))).alias("x"))
    return out.select("x.*")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Figures, base_failed, the posterior probability of good and kept for every row."""
    votes = F.array(*[vote(f(), good, bad) for _, f, good, bad in RULES])
    pattern = F.aggregate("_votes", F.lit(0.0), lambda code, v: code * 3 + v + 1).cast("long")
    slim = figures(docs, id_col, text_col).withColumn("_votes", votes)
    slim = scratch.stored(slim.withColumn("_pattern", pattern), "quality-figures")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    patterns = slim.where(~failed).groupBy("_pattern").agg(F.first("_votes").alias("votes"), F.count("*").cast("double").alias("n")).withColumnRenamed("_pattern", "pattern")
    believed = scratch.stored(posteriors(patterns, len(RULES)), "quality-patterns")  # at most 3^rules rows
    return slim.join(F.broadcast(believed), slim._pattern == believed.pattern, "left").select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), F.coalesce(~failed & (F.col("posterior") >= least), F.lit(False)).alias("kept"), "posterior",
    )


def op7_quality(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))

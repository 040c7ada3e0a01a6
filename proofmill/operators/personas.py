"""Personas: sampled skeletons, their exact facts, and truth sheets from generated payloads."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofmill.functions import constants as C
from proofmill.functions.stats import draw
from proofmill.operators.joins import matched
from proofmill.operators.samplers import balanced, split_counts

#: What each persona draws a class of, with the classes.
SLOTS = (
    {"style": C.STYLES, "city": C.CITIES, "job": C.OCCUPATIONS, "education": C.EDUCATION}
    | C.EXACT_CLASSES
    | {f"disclosure:{f}": C.EXACT_DISCLOSURES for f in C.EXACT_FIELDS}
)


def _array(values) -> Column:
    return F.array(*map(F.lit, values))


def skeletons(ids: DataFrame, seed: int = 7, id_col: str = "i") -> DataFrame:
    """One row for each number of ``ids``, fully decided by the seed and the numbers.

    Each slot's classes are dealt evenly and apart from the other slots, all in
    one pass; ages and numbers of facts are draws.
    """
    i = F.col(id_col)
    slots = F.array(*[F.struct(F.lit(name).alias("slot"), F.lit(len(classes)).alias("n"), _array(classes).alias("classes")) for name, classes in SLOTS.items()])
    dealt = balanced(ids.select(i.alias("i"), F.explode(slots).alias("s")).select("i", "s.*"), "i", F.col("n"), F.concat(F.lit(f"{seed}:"), F.col("slot"), F.lit(":")), ["slot"])
    dealt = dealt.withColumn("value", F.get("classes", F.col("class").cast("int")))
    wide = dealt.groupBy("i").agg(*[F.max(F.when(F.col("slot") == name, F.col("value"))).alias(name) for name in SLOTS])
    low, high = C.AGES
    least, most = C.JUDGED_FACTS
    wide = wide.withColumns({
        "persona_id": F.format_string("p%03d", "i"),
        "seed": F.lit(seed),
        "age": (low + F.floor(draw(f"{seed}:age:", F.col("i")) * (high - low + 1))).cast("int"),
        "n_judged": (least + F.floor(draw(f"{seed}:n:", F.col("i")) * (most - least + 1))).cast("long"),
    })
    parts = split_counts(wide.select("i", "n_judged"), C.DISCLOSURE_MIX, "n_judged").groupBy("i").agg(*[F.max(F.when(F.col("name") == d, F.col("part"))).alias(f"n_{d}") for d, _ in C.DISCLOSURE_MIX])
    return matched(wide, parts, "i").withColumn("n_specific", F.bround(C.SPECIFIC_SHARE * F.col("n_judged")).cast("long"))


def exact_facts(sheets: DataFrame) -> DataFrame:
    """(persona_id, fact_id, field, kind, value, specificity, disclosure, importance) of the exact fields, in their order."""
    kinds = {"age": "int", "has_kids": "bool"}
    each = [
        F.struct(
            F.lit(f"f{n:02d}").alias("fact_id"), F.lit(f).alias("field"), F.lit(kinds.get(f, "str")).alias("kind"), F.col(f).cast("string").alias("value"),
            F.lit("specific" if f == "age" else "generic").alias("specificity"), F.col(f"disclosure:{f}").alias("disclosure"),
            F.lit("dealbreaker" if f in C.DEALBREAKER_FIELDS else "core").alias("importance"),
        )
        for n, f in enumerate(C.EXACT_FIELDS, 1)
    ]
    return sheets.select("persona_id", F.explode(F.array(*each)).alias("f")).select("persona_id", "f.*")


def truth_sheets(sheets: DataFrame, payloads: DataFrame) -> DataFrame:
    """Exact facts as they are, and the payloads' facts (persona_id, place, field, kind, value, ...) under the ids that follow."""
    order = Window.partitionBy("persona_id").orderBy("place")
    judged = matched(payloads, sheets.select("persona_id"), "persona_id").withColumn("fact_id", F.format_string("f%02d", len(C.EXACT_FIELDS) + F.row_number().over(order)))
    made = exact_facts(sheets)
    return made.unionByName(judged.select(*made.columns))


def prompt_payload(sheets: DataFrame) -> DataFrame:
    """(persona_id, payload): what a generator is shown, as JSON with sorted keys."""
    about = F.struct("age", "city", "education", F.col("job").alias("occupation"))
    fixed = F.struct(*[F.col(f) if f != "has_kids" else (F.col(f) == "true").alias(f) for f in sorted(C.EXACT_FIELDS)])
    return sheets.select("persona_id", F.to_json(F.struct(about.alias("demographics"), fixed.alias("fixed_exact_fields"), "persona_id", "style")).alias("payload"))


def fill(template: str, values: dict[str, Column]) -> Column:
    """A template with ``{name}`` places filled; a place without a value is an error, ``{{`` and ``}}`` are braces."""
    parts = []
    for text, name, _, _ in string.Formatter().parse(template):
        parts.append(F.lit(text))
        if name is not None:
            if name not in values:
                raise KeyError(f"the template wants {name}")
            parts.append(values[name].cast("string"))
    return F.concat(*parts)


def style_words(style: Column) -> tuple[Column, Column]:
    """Least and most words that a style answers with."""
    table = F.create_map(*[x for s, (low, high) in C.STYLE_WORDS.items() for x in (F.lit(s), F.array(F.lit(low), F.lit(high)))])
    return F.try_element_at(table, style)[0], F.try_element_at(table, style)[1]


def generated(attempts: DataFrame) -> DataFrame:
    """(persona_id, status, attempt) of up to two attempts (persona_id, attempt, status, fits).

    A failed call ends it with its status; an answer that breaks the contract is
    asked for once more, and is schema_invalid the second time.
    """
    again = (F.col("attempt") == 1) & (F.col("status") == "ok") & ~F.col("fits")
    ended = attempts.where(F.col("attempt") <= 2).groupBy("persona_id").agg(F.min_by(F.struct("attempt", "status", "fits"), F.struct(again, "attempt")).alias("a"))
    broken = (F.col("a.status") == "ok") & ~F.col("a.fits")
    return ended.select("persona_id", F.when(broken, "schema_invalid").otherwise(F.col("a.status")).alias("status"), "a.attempt")


def failures(results: DataFrame, stage: str) -> DataFrame:
    """Failure records, in order of personas."""
    return results.where("status != 'ok'").select(F.lit(stage).alias("stage"), "persona_id", "status").orderBy("persona_id")

"""Text functions as column expressions; all run in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from proofmill.functions import constants as C


#: Every character that Unicode calls white space, and the four separators of ASCII.
BLANKS = r"[\s\p{Z}\x1C-\x1F\x{85}]"


def tokens(text: Column) -> Column:
    """Words parted by white space; none for a null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(tokens(text)).cast("long")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BLANKS + "+", " "))


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"[^\s\p{Z}\x1C-\x1F\x{85}]")


def fold(text: Column) -> Column:
    """Full case folding: upper case and back, but for the dotless i, and every final sigma as any other."""
    upper = F.translate(F.upper(F.translate(text, "\u0131", "\ue000")), "\ue000", "\u0131")
    return F.translate(F.lower(upper), "\u03c2", "\u03c3")


def dedupe_key(kind: Column, value: Column) -> Column:
    """What makes two values of one field the same; only strings are normalised."""
    return F.when(kind == "str", fold(collapse(value))).otherwise(value)


def values_match(kind_a: Column, a: Column, kind_b: Column, b: Column) -> Column:
    """Type first: 35 and "35", or 1 and true, do not match."""
    return (kind_a == kind_b) & (dedupe_key(kind_a, a) == dedupe_key(kind_b, b))


def span_normalize(text: Column) -> Column:
    """Punctuation to spaces, white space collapsed, case folded."""
    return fold(collapse(F.regexp_replace(text, r"[^\p{L}\p{N}_\s\p{Z}\x1C-\x1F\x{85}]", " ")))


@F.pandas_udf(StringType())  # a type, not its name: that would need a running session
def span_normalize_unicode(text: pd.Series) -> pd.Series:
    """The same after compatibility composition (NFKC), which no built-in function does."""

    def one(t):
        if t is None:
            return None
        t = unicodedata.normalize("NFKC", t)
        return " ".join("".join(c if c.isalnum() or c == "_" or c.isspace() else " " for c in t).split()).casefold()

    return text.map(one)


def stem(token: Column) -> Column:
    """Lower case without a plural ending."""
    t = F.lower(token)
    n = F.char_length(t)
    return (
        F.when((n > 4) & t.endswith("es"), F.substr(t, F.lit(1), n - 2))
        .when((n > 3) & t.endswith("s") & ~t.endswith("ss"), F.substr(t, F.lit(1), n - 1))
        .otherwise(t)
    )


def alphanumerics(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([0-9A-Za-z]+)"))


def token_set(text: Column) -> Column:
    return F.array_distinct(F.transform(alphanumerics(text), stem))


def anchor_tokens(text: Column) -> Column:
    """Stems that show a value was said: with a digit, capitalised after the first word, or of four letters and no stopword."""
    stop = F.array(*map(F.lit, C.STOPWORDS))
    marked = F.transform(alphanumerics(text), lambda t, i: F.struct(stem(t).alias("s"), (t.rlike("[0-9]") | ((i > 0) & t.rlike("^[A-Z]")) | (F.char_length(stem(t)) >= 4)).alias("ok")))
    kept = F.filter(marked, lambda x: x["ok"] & (x["s"] != "") & ~F.array_contains(stop, x["s"]))
    return F.array_distinct(F.transform(kept, lambda x: x["s"]))


def strip_punctuation(token: Column) -> Column:
    """Without sentence punctuation, unless nothing would be left."""
    bare = F.translate(token, C.SENTENCE_PUNCTUATION, "")
    return F.when(bare == "", token).otherwise(bare)


def split_token(token: Column) -> Column:
    """Leading non-word characters, core and trailing ones."""
    word = r"[\p{L}\p{N}_]"
    lead = F.regexp_extract(token, rf"^([^\p{{L}}\p{{N}}_]*)", 1)
    core = F.regexp_extract(token, rf"({word}(?:.*{word})?)", 1)
    trail = F.substr(token, F.char_length(lead) + F.char_length(core) + 1)
    return F.struct(lead.alias("lead"), core.alias("core"), trail.alias("trail"))


def match_case(source: Column, word: Column) -> Column:
    """``word`` in the case of ``source``: all capitals (of two letters or more), capitalised, or as it is."""
    first = F.substr(source, F.lit(1), F.lit(1))
    capital = F.concat(F.upper(F.substr(word, F.lit(1), F.lit(1))), F.substr(word, F.lit(2)))
    shouted = (F.char_length(source) > 1) & (source == F.upper(source)) & (source != F.lower(source))
    return F.when(shouted, F.upper(word)).when((first == F.upper(first)) & (first != F.lower(first)), capital).otherwise(word)


def fixed(value: Column, places: int) -> Column:
    """A number with ``places`` decimals, rounded from its exact binary value, ties to even.

    The fraction is taken as a multiple of 2^-60, so all steps are exact; ``over``
    tells whether anything is left below that.
    """
    size = F.abs(value)
    whole, scaled = F.floor(size), (size - F.floor(size)) * float(1 << 60)
    parts = scaled.cast("long")
    over = (scaled != parts.cast("double")).cast("int")
    product, one = parts.cast("decimal(38,0)") * F.lit(10**places).cast("decimal(6,0)"), F.lit(1 << 60).cast("decimal(20,0)")
    digits, rest = F.call_function("div", product, one), 2 * (product % one)
    up = (rest > one) | ((rest == one) & ((over > 0) | ((whole * 10**places + digits) % 2 == 1)))
    all_digits = whole * 10**places + digits + up.cast("int")
    sign = F.when((value < 0) | (F.format_string("%s", value) == "-0.0"), "-").otherwise("")
    shown = F.format_string("%,d" if places == 0 else "%d", (all_digits / F.lit(10**places).cast("decimal(6,0)")).cast("long") if places == 0 else F.call_function("div", all_digits, F.lit(10**places)))
    return F.concat(sign, shown, F.lit("") if places == 0 else F.concat(F.lit("."), F.lpad((all_digits % 10**places).cast("string"), places, "0")))


def format_value(value: Column, kind: Column) -> Column:
    value = value.cast("double")
    return (
        F.when(value.isNull(), "n/a")
        .when(kind == "rate", F.concat(fixed(value * 100, 1), F.lit("%")))
        .when(kind == "count", fixed(value, 0))
        .when(kind == "ratio", fixed(value, 2))
        .otherwise(fixed(value, 4))
    )


def noise_token(rate: Column) -> Column:
    return F.concat(F.lit("n"), F.lpad(F.round(rate * 100).cast("int").cast("string"), 3, "0"))


def transcript_stem(persona: Column, script: Column, order_seed: Column, rate: Column) -> Column:
    return F.concat_ws("__", persona, script, F.when(order_seed.isNotNull(), "shuf"), noise_token(rate))


def status_in(message: Column) -> Column:
    """A status from a message that names its reason; the first reason that occurs in it."""
    out = F.lit("provider_error")
    for reason in reversed([r for r in C.STATUS_BY_REASON if r != "provider_error"]):
        out = F.when(F.contains(message, F.lit(reason)), C.STATUS_BY_REASON[reason]).otherwise(out)
    return F.when(message.isNull(), "provider_error").otherwise(out)


def json_kind(value: Column, path: str) -> Column:
    """string, boolean, integer, array or other: the type of what stands at ``path`` of a parsed JSON value; missing without it."""
    found = F.schema_of_variant(F.variant_get(value, path, "variant"))
    kind = F.when(found == "STRING", "string").when(found == "BOOLEAN", "boolean").when(found == "BIGINT", "integer").when(found.startswith("ARRAY"), "array").otherwise("other")
    return F.when(found.isNull() | (found == "VOID"), "missing").otherwise(kind)


def extraction_id(transcript: Column, tag: Column) -> Column:
    return F.concat(transcript, F.lit(":"), tag)


def floor_tag(tag: Column, run: Column) -> Column:
    return F.concat(tag, F.lit(".floor"), run.cast("string"))


def run_id(at: Column, config: Column) -> Column:
    """The UTC minute and six digits of the configuration's hash; runs of one configuration within a minute share it."""
    return F.concat(F.date_format(at, "yyyyMMdd-HHmm"), F.lit("-"), F.substring(F.sha2(config.cast("binary"), 256), 1, 6))


def with_role(role: Column, text: Column) -> Column:
    """A prompt that names its role in front."""
    return F.concat(F.lit("[lab-role:"), role, F.lit("]\n"), text)


def role_in(text: Column) -> Column:
    """The role that a prompt names in front; null where it names none."""
    return F.nullif(F.regexp_extract(text, r"^\[lab-role:([^\]]+)\]", 1), F.lit(""))


def flat_params(params: Column) -> Column:
    """``k=v`` of a map, in order of keys, without the nonce, which tells runs apart but not what was asked."""
    entries = F.array_sort(F.map_entries(hashable(params)))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")


def hashable(params: Column) -> Column:
    return F.map_filter(params, lambda k, _: k != "nonce")


def status_of(reason: Column) -> Column:
    """A failure's status; an unknown reason is the provider's fault."""
    known = F.create_map(*[F.lit(x) for pair in C.STATUS_BY_REASON.items() for x in pair])
    return F.coalesce(F.try_element_at(known, reason), F.lit("provider_error"))

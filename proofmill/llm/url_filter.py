"""URL filter: pattern rules indexed by their rarest literal token.

A rule is a host and a path prefix (``*`` stands for any characters) with an
action. Each rule is filed under one literal token that every URL it fits must
hold, the one that fewest URLs hold; a URL's tokens fetch its candidate rules
and only those run their regular expressions. The longest rule that fits wins;
of equally long ones a block wins, then the smaller rule string.

Defined cases: a null URL or one without ``://`` has an empty host and path and
gets the default action; repeated rows each get their verdict; an empty table
gives an empty result; a kept column whose name a result has is returned as
``page_`` and its name; other columns are neither read nor returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = "[a-z0-9]+"
RESULT = "host string, path string, rule string, verdict string"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    action: str

    def __post_init__(self):
        if self.action not in ("allow", "block"):
            raise ValueError(f"action must be allow or block: {self.action}")
        if self.path and not self.path.startswith("/"):
            raise ValueError(f"a rule's path starts with /: {self.path}")

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def rank(self) -> tuple[int, int]:
        """The larger wins."""
        return len(self.text), int(self.action == "block")

    def regex(self, end: str = r"\Z") -> str:
        """Fits host + path from their start; ``end`` is the dialect's end of text."""
        tail = ".*".join(map(re.escape, self.path.split("*"))) if self.path else f"(?:/|{end})"
        return r"(?s)\A(?:[^/]*\.)?" + re.escape(_lower(self.host)) + tail

    def tokens(self) -> list[str]:
        """Literal tokens with a separator on both sides in every URL that the rule fits."""
        text = _lower(self.text)
        found = []
        for m in re.finditer(TOKEN, text):
            open_right = m.end() == len(text) and self.path != "" or text[m.end() : m.end() + 1] == "*"
            if not open_right and text[m.start() - 1 : m.start()] != "*":
                found.append(m[0])
        return list(dict.fromkeys(found))


def _lower(text: str) -> str:
    return text.translate(str.maketrans(UPPER, LOWER))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def _kept(keep: tuple[str, ...]) -> list[Column]:
    return [F.col(c).alias(f"page_{c}") if c.lower() in ("host", "path", "rule", "verdict") else F.col(c) for c in keep]


def token_counts(pages: DataFrame, rules: list[Rule], url: str) -> dict[str, int]:
    """In how many rows each token of the rules occurs; as many pairs as the rules have tokens."""
    wanted = sorted({t for r in rules for t in r.tokens()})
    if not wanted:
        return {}
    held = pages.select(F.explode(F.array_distinct(F.regexp_extract_all(F.translate(F.concat(host_of(F.col(url)), path_of(F.col(url))), UPPER, LOWER), F.lit(f"({TOKEN})")))).alias("token"))
    if len(wanted) <= 1000:
        held = held.where(F.col("token").isin(wanted))
    else:
        held = held.join(pages.sparkSession.createDataFrame([(t,) for t in wanted], "token string"), "token", "left_semi")
    return {r.token: r.n for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}


def rule_index(rules: Iterable[Rule], counts: dict[str, int]) -> dict[str | None, list[Rule]]:
    """Rules by their rarest token, best first; under None those without any."""
    index: dict[str | None, list[Rule]] = {}
    for rule in sorted(set(rules), key=lambda r: (*(-x for x in r.rank), r.text)):
        token = min(rule.tokens(), key=lambda t: (counts.get(t, 0), t), default=None)
        index.setdefault(token, []).append(rule)
    return index


def judge(pages: DataFrame, rules: Iterable[Rule], url: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow", max_broadcast_rules: int = 50_000) -> DataFrame:
    """``keep`` columns with host, path, the rule that decides and the verdict.

    Up to ``max_broadcast_rules`` rules are sent to every task with the index
    and no row is shuffled; more are joined with the URLs' tokens.
    """
    rules = sorted(set(rules), key=lambda r: (r.text, r.action))
    index = rule_index(rules, token_counts(pages, rules, url))
    if len(rules) > max_broadcast_rules:
        return _judge_by_join(pages, index, url, keep, default)

    compiled = {t: [(re.compile(r.regex()), r) for r in rs] for t, rs in index.items()}

    def best(target: str) -> Rule | None:
        found = None
        for token in dict.fromkeys([None, *re.findall(TOKEN, _lower(target))]):
            for regex, rule in compiled.get(token, ()):
                if found is not None and (rule.rank, found.text) <= (found.rank, rule.text):
                    break  # the rest of this list ranks no better
                if regex.match(target):
                    found = rule
                    break
        return found

    @F.pandas_udf(RESULT)
    def verdicts(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        rows = [(h, p, r.text if r else None, r.action if r else default) for h, p, r in ((h, p, best(h + p)) for h, p in zip(hosts, paths, strict=True))]
        return pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"])

    judged = pages.select(F.struct(*_kept(keep)).alias("_k"), verdicts(host_of(F.col(url)), path_of(F.col(url))).alias("_v"))
    return judged.select("_k.*", "_v.*") if keep else judged.select("_v.*")


def _judge_by_join(pages: DataFrame, index: dict[str | None, list[Rule]], url: str, keep: tuple[str, ...], default: str) -> DataFrame:
    """The same verdicts from a join of each distinct URL's tokens with the index."""
    spark = pages.sparkSession
    rows = [(t, r.text, r.action, r.regex(r"\z"), *r.rank) for t, rs in index.items() for r in rs]
    filed = spark.createDataFrame(rows, "token string, rule string, action string, regex string, length int, blocks int")
    parted = pages.select(*_kept(keep), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    targets = parted.select(F.concat("host", "path").alias("target")).distinct()
    found = F.array_distinct(F.regexp_extract_all(F.translate("target", UPPER, LOWER), F.lit(f"({TOKEN})")))
    if None in index:  # rules without a token are tried on every URL
        found = F.concat(found, F.array(F.lit(None).cast("string")))
    tokens = targets.select("target", F.explode(found).alias("token"))
    fit = tokens.join(filed, tokens.token.eqNullSafe(filed.token)).where(F.expr("target rlike regex"))
    order = F.struct("length", "blocks", F.transform(F.split("rule", ""), lambda c: -F.ascii(c)))
    won = fit.groupBy("target").agg(F.max_by(F.struct("rule", "action"), order).alias("won"))
    out = parted.withColumn("target", F.concat("host", "path")).join(won, "target", "left")
    return out.select(*[c for c in parted.columns if c not in ("host", "path")], "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.action", F.lit(default)).alias("verdict"))


#: The rules of the query: (host, path, action).
QUERY_RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), QUERY_RULES)


OP1_SQL = """
WITH parted AS (
  SELECT page_id,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), named AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parted
), rules(rhost, rpath, action) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
         ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), fit AS (
  SELECT n.page_id, n.host, n.path, r.rhost || r.rpath AS rule, r.action,
    row_number() OVER (PARTITION BY n.page_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS place
  FROM named n LEFT JOIN rules r
    ON (n.host = r.rhost OR ends_with(n.host, '.' || r.rhost)) AND starts_with(n.path, r.rpath)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM fit WHERE place = 1
"""

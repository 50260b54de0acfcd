"""URL filter: host rules first, then association rules mined from labelled URLs.

FP-growth mines combinations of URL tokens together with the label of the page. Rules "tokens, then label" are pruned by
support, confidence, lift over the label's share, and by shorter rules that are as sure. A URL is judged by the surest
rule all of whose tokens it has; rules are found over an inverted index from their rarest token.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kongrid.llm.common import map_rows
from kongrid.operators.keys import attach

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Host rules: (verdict, host/path prefix).
HOST_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
# Association rules go to every task; the support bound keeps their number far below this.
MOST_RULES = 100_000
LABEL = "label="
# Lines of fewer characters say little about where a text comes from.
SHORTEST_LINE = 40


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits: its host is the URL's or a parent domain, its path a prefix."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def url_items(url: Column) -> Column:
    """Distinct tokens: host labels, path segments (digits become #), file extension, names of query fields, scheme."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    parts = F.split(path, "/")
    items = F.array_union(
        F.transform(F.split(host, r"[.\-]"), lambda x: F.concat(F.lit("h="), x)),
        F.transform(parts, lambda x: F.concat(F.lit("p="), F.regexp_replace(F.regexp_replace(x, r"\.[A-Za-z0-9]+$", ""), r"[0-9]+", "#"))),
    )
    items = F.array_union(items, F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("q="), F.substring_index(x, "=", 1))))
    items = F.array_union(items, F.array(F.concat(F.lit("e="), F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)), F.concat(F.lit("s="), F.substring_index(url, "://", 1))))
    return F.coalesce(F.filter(items, lambda x: F.length(x) > 2), F.array().cast("array<string>"))


@dataclass
class AssociationRules:
    """Rules (tokens, verdict, confidence, support) and the index from each rule's rarest token."""

    rules: list[tuple[frozenset, str, float, int]]
    index: dict[str, list[int]]

    def best(self, items: list[str]) -> tuple[str | None, str | None, float | None]:
        """The verdict of the surest rule that fits; ties by support, then by more tokens, then block before allow."""
        own, found = set(items), None
        for item in own:
            for k in self.index.get(item, ()):
                tokens, verdict, confidence, support = self.rules[k]
                if tokens <= own:
                    rank = (confidence, support, len(tokens), verdict == "block", sorted(tokens))
                    if found is None or rank > found[0]:
                        found = (rank, k)
        if found is None:
            return None, None, None
        tokens, verdict, confidence, _ = self.rules[found[1]]
        return verdict, " ".join(sorted(tokens)), confidence


def mine_rules(labelled: DataFrame, support: float = 0.01, confidence: float = 0.6, lift: float = 1.02) -> AssociationRules:
    """Mine rows of `items` (array) and `label` (allow or block). The support bound limits how many itemsets there can be."""
    baskets = labelled.select(F.array_append("items", F.concat(F.lit(LABEL), "label")).alias("items"))
    total = baskets.count()
    if not total:
        return AssociationRules([], {})
    sets = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets).freqItemsets
    tagged = sets.select(F.array_sort(F.filter("items", lambda x: ~x.startswith(LABEL))).alias("tokens"), F.get(F.filter("items", lambda x: x.startswith(LABEL)), F.lit(0)).alias("label"), "freq")
    plain = tagged.where("label is null and size(tokens) > 0").select("tokens", F.col("freq").alias("all"))
    shares = tagged.where("label is not null and size(tokens) = 0").select("label", (F.col("freq") / total).alias("share"))
    rules = (
        tagged.where("label is not null and size(tokens) > 0")
        .join(plain, "tokens")
        .join(F.broadcast(shares), "label")
        .withColumn("confidence", F.col("freq") / F.col("all"))
        .where((F.col("confidence") >= confidence) & (F.col("confidence") >= lift * F.col("share")))
        .select("tokens", F.substring("label", len(LABEL) + 1, 100).alias("verdict"), "confidence", "freq")
        .limit(MOST_RULES + 1)
        .collect()
    )
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules; raise the support")
    single = {r["tokens"][0]: r["all"] for r in plain.where("size(tokens) = 1").collect()}
    kept: list[tuple[frozenset, str, float, int]] = []
    index: dict[str, list[int]] = {}
    for r in sorted(rules, key=lambda r: (len(r["tokens"]), r["tokens"], r["verdict"])):
        tokens = frozenset(r["tokens"])
        shorter = {k for t in tokens for k in index.get(t, ())}
        if any(kept[k][0] < tokens and kept[k][1] == r["verdict"] and kept[k][2] >= r["confidence"] for k in shorter):
            continue
        index.setdefault(min(tokens, key=lambda t: (single.get(t, 0), t)), []).append(len(kept))
        kept.append((tokens, r["verdict"], r["confidence"], r["freq"]))
    return AssociationRules(kept, index)


def line_digests(text: Column) -> Column:
    """Digests of the distinct lines of at least SHORTEST_LINE characters; in HTML, tags end a line."""
    lines = F.transform(F.split(text, r"<[^>]*>|\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.array_distinct(F.transform(F.filter(lines, lambda x: F.length(x) >= SHORTEST_LINE), lambda x: F.xxhash64(x)))


def label_urls(pages: DataFrame, docs: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page, items, label) of the pages that hold lines of labelled documents: block or allow.

    Labels are given to documents, so they are carried over by text: a line's mark is the share of the labelled documents with
    it that are of quality 0 or toxic, a page's is the mean over its lines, each weighed by 1/n for the n labelled documents
    that have it. Above one half the page is to be blocked. A page is a pair of id and URL; rows that repeat it count as one.
    Null texts have no lines. Only digests are moved; marks of lines are joined by `attach`, so no line is a hot key.
    """
    bad = F.when((F.col("quality") == 0) | (F.coalesce("toxic", F.lit(0)) == 1), 1.0).otherwise(0.0)
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max(bad).alias("bad"))
    held = docs.select("doc_id", line_digests(F.col("text")).alias("lines")).join(marks, "doc_id")
    lines = held.select("bad", F.explode("lines").alias("line")).groupBy("line").agg(F.avg("bad").alias("bad"), F.count("*").alias("n"))
    rows = pages.select(F.struct(F.col(id_col).alias("id"), F.col(url_col).alias("url")).alias("page"), F.explode(line_digests(F.col(html_col))).alias("line"))
    uses = rows.groupBy("line").agg(F.count("*").alias("uses")).join(lines, "line")
    judged = attach(rows, uses, ["line"], "uses").groupBy("page").agg((F.sum(F.col("bad") / F.col("n")) / F.sum(1 / F.col("n"))).alias("bad"))
    return judged.select("page", url_items(F.col("page.url")).alias("items"), F.when(F.col("bad") > 0.5, "block").otherwise("allow").alias("label"))


def filter_urls(pages: DataFrame, mined: AssociationRules, rules: list[tuple[str, str]] | None = None, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, tokens, confidence.

    `rule` is the longest host rule that fits, whose verdict holds. Else the surest association rule decides (`tokens` and
    `confidence` are its own), else `default`. A null URL or one without "://" has empty host and path. Repeated rows give
    equal rows; an empty table gives no rows; other columns are ignored.
    """
    url = F.col(url_col)
    host, path = host_of(url), path_of(url)
    rule, verdict = host_rule(F.col("host"), F.col("path"), HOST_RULES if rules is None else rules)
    based = pages.select(id_col, host.alias("host"), path.alias("path"), url_items(url).alias("items")).select(id_col, "host", "path", rule.alias("rule"), verdict.alias("_v"), "items")

    def judge(columns):
        best = [mined.best(items) for items in columns[5]]
        final = [v or b[0] or default for v, b in zip(columns[4], best)]
        return [*columns[:4], final, [b[1] for b in best], [b[2] for b in best]]

    kind = dict(pages.dtypes)[id_col]
    return map_rows(based, judge, f"`{id_col}` {kind}, host string, path string, rule string, verdict string, tokens string, confidence double")

"""Mixing to target weights with soft domains, in DataFrame functions only.

A naive Bayes model over the hashed words that a document has, counted from a table of labelled documents, gives each document's
domain posteriors. Their prior is that of the corpus and not of the labelled documents: it is found by expectation maximisation
over all documents.
Rates r >= 0 are sought for all documents so that the expected tokens of each domain, sum of r * tokens * posterior, meet
the targets: least squares over weighted errors, by projected gradient. A step moves every document by a combination of its
posteriors, so the whole course of the descent is a short list of vectors; a round sums (tokens, posteriors) rows with that list
in a column expression, and no rates are kept between rounds.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from math import copysign, log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kongrid.llm.common import held_out
from kongrid.operators.cut import cut

BUCKETS = 16_384
# Standard errors from which on a bucket's deviation counts.
SIGMAS = 4.0
# Labelled documents that the posterior model is counted from.
LABELLED = 20_000
# Posterior log odds stay within this.
MOST_LOGIT = 8.0


def token_buckets(text: Column, buckets: int = BUCKETS) -> Column:
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0d]+"), "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))


def _looked_up(table: Column):
    return lambda k: F.get(table, k)


@dataclass
class DomainModel:
    domains: list[str]
    prior: list[float]  # log odds against the first domain
    weights: list[list[float]]  # per further domain, log odds of each bucket

    def evidence(self, docs: DataFrame, text: Column) -> DataFrame:
        """`docs` with _mix_tokens and _mix_e1, ...: log odds against the first domain, without the prior. Each step is a
        projection of its own, so that nothing is computed twice."""
        docs = docs.withColumn("_mix_all", token_buckets(text))
        docs = docs.withColumns({"_mix_b": F.array_distinct("_mix_all"), "_mix_tokens": F.size("_mix_all").cast("double")}).drop("_mix_all")
        sums = {}
        for k in range(1, len(self.domains)):
            table = F.from_json(F.lit(json.dumps(self.weights[k])), "array<double>")
            sums[f"_mix_e{k}"] = F.aggregate(F.transform("_mix_b", _looked_up(table)), F.lit(0.0), lambda a, b: a + b)
        return docs.withColumns(sums).drop("_mix_b")

    def posteriors(self, rows: DataFrame) -> DataFrame:
        """`rows` of `evidence` with _mix_p0, _mix_p1, ... in its place: posteriors in the order of the domains."""
        n, most = len(self.domains), F.lit(MOST_LOGIT)
        odds = {"_mix_o0": F.lit(1.0)} | {f"_mix_o{k}": F.exp(F.least(F.greatest(F.col(f"_mix_e{k}") + F.lit(self.prior[k]), -most), most)) for k in range(1, n)}
        docs = rows.withColumns(odds).drop(*[f"_mix_e{k}" for k in range(1, n)])
        whole = sum((F.col(f"_mix_o{k}") for k in range(1, n)), F.col("_mix_o0"))
        return docs.withColumns({f"_mix_p{k}": F.col(f"_mix_o{k}") / whole for k in range(n)}).drop(*odds)

    def with_prior_of(self, rows: DataFrame, rounds: int = 40, tolerance: float = 1e-4) -> DomainModel:
        """The model with the prior that makes the evidence of `rows` likeliest: one sum of posteriors a round, over rows with
        tokens, until no domain's share moves by more than `tolerance` of itself."""
        model, n, some = self, len(self.domains), rows.where("_mix_tokens > 0")
        before = [0.0] * n
        for _ in range(rounds):
            sums = model.posteriors(some).agg(F.count("*").alias("n"), *[F.sum(f"_mix_p{k}").alias(f"s{k}") for k in range(n)]).first()
            if not sums["n"]:
                return model
            shares = [max(sums[f"s{k}"], 0.5) / sums["n"] for k in range(n)]
            model = replace(model, prior=[log(x / shares[0]) for x in shares])
            if all(abs(x - y) <= tolerance * x for x, y in zip(shares, before)):
                break
            before = shares
        return model


def fit_domains(docs: DataFrame, labelled: DataFrame, domains: list[str], rows: int = LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DomainModel:
    """Count `labelled` (doc_id, domain) documents, at most `rows` by hash of the id; buckets x domains counts reach the driver."""
    chosen = labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).groupBy("doc_id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("doc_id")).limit(rows)
    # Copies of a text, and repeats of a word in it, are no further evidence.
    joined = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t")).join(F.broadcast(chosen), "doc_id").dropDuplicates(["domain", "_t"])
    tokens = joined.select("domain", F.explode_outer(F.array_distinct(token_buckets(F.col("_t")))).alias("bucket"))
    counts = {(r["domain"], r["bucket"]): r["n"] for r in tokens.groupBy("domain", "bucket").agg(F.count("bucket").alias("n")).collect()}
    n_docs = {r["domain"]: r["n"] for r in joined.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    of = [[counts.get((d, b), 0) for b in range(BUCKETS)] for d in domains]
    prior = [log(n_docs.get(d, 0) + 0.5) for d in domains]
    return DomainModel(domains, [p - prior[0] for p in prior], [_log_odds(row, of[0]) for row in of])


def _log_odds(counts: list[int], base: list[int]) -> list[float]:
    """Log ratio of each bucket's share in a domain to that in the first one.

    Ratios that chance may explain are replaced by the ratio of all such buckets together, so that a text without any telling
    word counts as what most such texts are; the others are pulled in by one standard error.
    """
    total, base_total = sum(counts), sum(base)
    if not total or not base_total:
        return [0.0] * len(counts)
    odds = [log((n + 0.5) / (total + 1)) - log((m + 0.5) / (base_total + 1)) for n, m in zip(counts, base)]
    share = total / (total + base_total)
    # Deviation of a count from its part of both counts, in standard errors.
    plain = [abs(n - (n + m) * share) <= SIGMAS * ((n + m) * share * (1 - share)) ** 0.5 for n, m in zip(counts, base)]
    chance = [(1 / (n + 0.5) + 1 / (m + 0.5)) ** 0.5 for n, m in zip(counts, base)]
    rest = log((sum(n for n, p in zip(counts, plain) if p) + 0.5) / (total + 1)) - log((sum(m for m, p in zip(base, plain) if p) + 0.5) / (base_total + 1))
    return [round(rest if p else copysign(max(0.0, abs(x) - c), x), 5) for x, c, p in zip(odds, chance, plain)]


def rate(steps: list[list[float]]) -> Column:
    """The document's rate after the steps: it begins at 1 and never falls below 0."""
    if not steps:
        return F.lit(1.0)
    course = F.from_json(F.lit(json.dumps(steps)), "array<array<double>>")

    def move(r, g):
        return F.greatest(F.lit(0.0), r - sum((F.col(f"_mix_p{d}") * F.get(g, F.lit(d)) for d in range(1, len(steps[0]))), F.col("_mix_p0") * F.get(g, F.lit(0))))

    return F.aggregate(course, F.lit(1.0), move)


def solve_rates(rows: DataFrame, weights: list[float], total: float | None = None, rounds: int = 60, tolerance: float = 1e-4) -> tuple[list[list[float]], list[float]]:
    """Steps of the descent over `rows` (_mix_tokens, _mix_p0, ...), and the misses it ends with: by domain, expected tokens over
    target less 1 (over total, where the target is 0).

    Targets are weight x total. Without a total, the first domain's present tokens set it: its target is what there is of
    it. Ends when every domain is within `tolerance` of its target (relative to the target's and the corpus's size).

    Errors are measured in the metric of what documents with a rate above 0 can still change (the inverse of their Gram matrix,
    renewed each round), so a domain that is nearly all set to 0 is not left to creep. A step that does not lessen the sum of
    squared relative errors is taken back and halved. Where targets can't all be met such steps get short, and the descent goes on
    with fixed weights until it stands still.
    """
    n, p = len(weights), [F.col(f"_mix_p{d}") for d in range(len(weights))]
    mass = [F.col("_mix_tokens") * x for x in p]

    def sums(steps: list[list[float]]) -> tuple[list[float], list[list[float]]]:
        live = F.col("_mix_r") > 0
        moved = rows.withColumn("_mix_r", rate(steps))
        got = moved.agg(
            *[F.sum(F.col("_mix_r") * x).alias(f"s{d}") for d, x in enumerate(mass)],
            *[F.sum(F.when(live, mass[a] * p[b]).otherwise(0.0)).alias(f"g{a}_{b}") for a in range(n) for b in range(a, n)],
        ).first()
        return [got[f"s{d}"] or 0.0 for d in range(n)], [[got[f"g{min(a, b)}_{max(a, b)}"] or 0.0 for b in range(n)] for a in range(n)]

    steps: list[list[float]] = []
    now, gram = sums(steps)
    corpus = sum(now)
    if corpus <= 0:
        return [], [0.0] * n
    total = total if total is not None else now[0] / weights[0]
    target = [w / sum(weights) * total for w in weights]
    # Errors are relative to what a domain has or shall have, so a domain that is next to absent does not rule the others.
    fixed = [max(s, t, 1e-6 * corpus) for s, t in zip(now, target)]

    unit = [f ** 0.5 for f in fixed]

    def error(sums: list[float]) -> float:
        return sum((s - t) ** 2 / f for s, t, f in zip(sums, target, fixed))

    # The largest row sum of the scaled Gram matrix bounds its largest eigenvalue.
    bound, length = max(sum(gram[a][b] / unit[a] / unit[b] for b in range(n)) for a in range(n)), 1.0
    for _ in range(rounds):
        miss = [s - t for s, t in zip(now, target)]
        if all(abs(m) <= tolerance * max(t, 0.01 * sum(target)) for m, t in zip(miss, target)):
            break
        renewed = length >= 1 / 32
        if renewed:
            metric = np.linalg.pinv(np.array(gram) / np.outer(unit, unit), rcond=1e-6, hermitian=True)
            step = [length * float(x) for x in metric @ (np.array(miss) / unit) / unit]
        else:
            step = [m / f / bound for m, f in zip(miss, fixed)]
        then, then_gram = sums([*steps, step])
        gain = error(now) - error(then)
        if renewed and gain <= 0:
            length /= 2
            continue
        if not renewed and gain <= 1e-4 * error(now):
            break
        steps, now, gram = [*steps, step], then, then_gram
        length = min(1.0, 2 * length) if renewed else length
    return steps, [(s - t) / (t or sum(target)) for s, t in zip(now, target)]


@dataclass
class Mixture:
    model: DomainModel
    steps: list[list[float]]
    missed: list[float]  # by domain, how far its expected tokens stay from the target, as a part of it
    rows: DataFrame  # id, _mix_u, _mix_tokens and _mix_p* of the documents that it was fitted on, from a written table
    id_col: str

    def rated(self, rows: DataFrame, dead_zone: float) -> DataFrame:
        """Add _mix_rate and _mix_copies. Rates within the dead zone of 1 count as 1; others are rounded up with the probability
        of their fraction, by a hash of id and text (_mix_u)."""
        r = F.col("_mix_rate")
        copies = F.when(F.abs(r - 1) <= dead_zone, F.lit(1)).otherwise(F.floor(r + F.col("_mix_u"))).cast("int")
        return rows.withColumn("_mix_rate", rate(self.steps)).withColumn("_mix_copies", copies)

    def shown(self, rated: DataFrame, id_col: str) -> DataFrame:
        shares = [F.col(f"_mix_p{k}").alias(f"p_{d}") for k, d in enumerate(self.model.domains)]
        return rated.select(id_col, F.col("_mix_tokens").cast("long").alias("n_tokens"), *shares, F.col("_mix_rate").alias("rate"), F.col("_mix_copies").alias("copies"))


def _scored(docs: DataFrame, model: DomainModel, id_col: str, text_col: str) -> DataFrame:
    """`docs` with _mix_u (a number in 0 to 1 by hash of id and text), _mix_tokens and _mix_e*."""
    u = F.pmod(F.xxhash64(id_col, text_col, F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return model.evidence(docs.withColumn("_mix_u", u), F.col(text_col))


def fit_mixture(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], total: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> Mixture:
    """Domain model and descent for target weights by domain (the first domain is the reference); see `solve_rates`."""
    model = fit_domains(docs, labelled, list(targets), id_col=id_col, text_col=text_col)
    written = cut(_scored(docs.select(id_col, F.col(text_col).alias("_mix_text")), model, id_col, "_mix_text").drop("_mix_text"))
    model = model.with_prior_of(written)
    rows = model.posteriors(written)
    return Mixture(model, *solve_rates(rows, list(targets.values()), total), rows, id_col)


def fitted_rates(mixture: Mixture, dead_zone: float = 0.05) -> DataFrame:
    """As `mixing_rates` for the documents that the mixture was fitted on, without reading their texts again."""
    return mixture.shown(mixture.rated(mixture.rows, dead_zone), mixture.id_col)


def mixing_rates(docs: DataFrame, mixture: Mixture, dead_zone: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, posterior of each domain, rate, copies.

    Null and empty texts have no tokens and the prior's posteriors. Domains without a labelled document get next to no
    posterior. Repeated rows give equal rows; an empty table gives no rows; other columns are ignored.
    """
    rows = mixture.model.posteriors(_scored(docs.select(id_col, F.col(text_col).alias("_mix_text")), mixture.model, id_col, "_mix_text"))
    return mixture.shown(mixture.rated(rows, dead_zone), id_col)


def mixed(docs: DataFrame, mixture: Mixture, dead_zone: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, each repeated by its copies (none for 0), with their own columns, whatever these are called.

    Null and empty texts have no tokens and go by the prior's rate; repeated rows have equal copies; an empty table stays empty.
    """
    rows = docs.select(F.struct(*docs.columns).alias("_mix_row"))
    added = mixture.rated(mixture.model.posteriors(_scored(rows, mixture.model, f"_mix_row.{id_col}", f"_mix_row.{text_col}")), dead_zone)
    return added.select("_mix_row", F.explode(F.array_repeat(F.lit(1), F.col("_mix_copies")))).select("_mix_row.*")


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from a table of quality and toxic marks, without the held-out quarter."""
    marks = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("t"), F.min("quality").alias("q"))
    return marks.select("doc_id", F.when(F.col("t") == 1, "toxic").when(F.col("q") == 0, "junk").otherwise("clean").alias("domain"))

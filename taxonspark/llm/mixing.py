"""Mixing to target weights by soft membership.

1. A logistic regression over hashed words learns the domains of a bounded sample of the labelled
   documents, drawn by domain so that rare ones are learned too, and gives every document its domain
   posteriors p, with the domains' shares as they are among all labelled documents.
2. Nonnegative document rates r are fitted so that the expected domain token totals
   sum(r * tokens * p_k) match the targets, by least squares from r = 1: every step is one distributed
   sum of the K residuals and the K x K Gram matrix of the documents in play, whose inverse scales the
   projected gradient step r <- max(0, r - p . c). Only these sums reach the driver.

Everything runs as DataFrame expressions and Spark's own JVM-side estimators.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: target shares of all expected tokens, by domain of the labelled table
TARGETS = {"good": 0.9, "plain": 0.09, "toxic": 0.01}


def domain_of(quality: Column, toxic: Column) -> Column:
    """The domain of a labelled row; null if neither label says anything."""
    return F.when(toxic == 1, "toxic").when(quality == 1, "good").when(quality == 0, "plain")


def words_of(text: Column) -> Column:
    """White-space words, each cut where its letters end, so that punctuation is a feature of its own."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+|(?<=\p{L})(?=[^\p{L}\s])"), lambda w: w != "")


def tokens_of(text: Column) -> Column:
    """The number of white-space words."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")).cast("long")


def shares(sizes: dict[str, int], max_train: int) -> dict[str, float]:
    """The share of each domain's rows that trains: small domains whole, the room left dealt evenly to the others."""
    out, room = {}, float(max_train)
    for k, (d, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        take = min(float(n), room / (len(sizes) - k))
        out[d] = take / n if n else 1.0
        room -= take
    return out


def posteriors(docs: DataFrame, labelled: DataFrame, *, max_train: int, features: int) -> tuple[DataFrame, list[str]]:
    """``docs`` (doc_id, _t) with tokens (long) and p (array<double>, by the returned domains);
    ``labelled`` (doc_id, domain): of the labelled documents a hashed sample by domain (``shares``; ``max_train`` ids in
    expectation) trains; what a domain is sampled above or below others is undone in p. A domain without any
    labelled document in ``docs`` has posterior 0."""
    # one row per id: a document labelled twice counts by its least domain
    labelled = labelled.where("domain is not null and doc_id is not null").groupBy(F.col("doc_id").alias("_l")).agg(F.min("domain").alias("domain"))
    ids = docs.select(F.col("doc_id").alias("_i")).where("_i is not null")
    here = labelled.join(ids.distinct().withColumn("_in", F.lit(1)), F.col("_l") == F.col("_i"), "left")
    here = staged(here.select("_l", "domain", "_in"), "labels")
    sizes = here.groupBy("domain").agg(F.count("_in").alias("count")).orderBy("domain").collect()
    domains, total = [r.domain for r in sizes], max(1, sum(r["count"] for r in sizes))
    share = shares({r.domain: r["count"] for r in sizes}, max_train)
    least = F.element_at(F.array(*(F.lit(int(share[d] * (1 << 30))) for d in domains)), F.array_position(F.array(*map(F.lit, domains)), F.col("domain")).cast("int")) \
        if domains else F.lit(0)
    sample = here.where(F.col("_in").isNotNull() & (F.pmod(F.xxhash64("_l", F.lit(11)), F.lit(1 << 30)) < least)).select("_l", "domain")
    sample = staged(sample, "sample")
    words = docs.select("doc_id", tokens_of(F.col("_t")).alias("tokens"), words_of(F.col("_t")).alias("w"))
    if len(domains) < 2:  # nothing to tell apart
        return words.select("doc_id", "tokens", F.array(F.lit(1.0)).alias("p")), domains or ["unknown"]
    index = F.array_position(F.array(*map(F.lit, domains)), F.col("domain")).cast("double") - 1
    picked = docs.join(F.broadcast(sample), F.col("doc_id") == F.col("_l"))  # at most max_train ids, by the hash
    train = staged(picked.select(words_of(F.col("_t")).alias("w"), index.alias("y")), "train")
    if train.select("y").distinct().count() < 2:
        return words.select("doc_id", "tokens",
                            F.array(*(F.lit(r["count"] / total) for r in sizes)).alias("p")), domains
    model = Pipeline(stages=[
        HashingTF(numFeatures=features, binary=True, inputCol="w", outputCol="tf"),
        Normalizer(inputCol="tf", outputCol="x"),
        LogisticRegression(featuresCol="x", labelCol="y", family="multinomial", regParam=0.003, elasticNetParam=1.0, maxIter=60,
                           probabilityCol="prob", rawPredictionCol="raw", predictionCol="pred"),
    ]).fit(train)
    p = vector_to_array("prob")
    # a domain without a row in the sample has no column in the model
    p = F.concat(F.slice(p, 1, len(domains)), F.array_repeat(F.lit(0.0), F.lit(len(domains)) - F.least(F.size(p), F.lit(len(domains)))))
    rows = model.transform(words).select("doc_id", "tokens", p.alias("p"))
    if min(share.values()) < max(share.values()):
        odds = F.zip_with("p", F.array(*(F.lit(share[d]) for d in domains)), lambda x, y: x / y)
        rows = rows.select("doc_id", "tokens", odds.alias("p"))
        rows = rows.select("doc_id", "tokens", F.transform("p", lambda x: x / F.aggregate("p", F.lit(0.0), lambda a, b: a + b)).alias("p"))
    return rows, domains


def fit_rates(rows: DataFrame, targets: np.ndarray, *, max_steps: int = 40, tolerance: float = 1e-6, write_every: int = 8) -> DataFrame:
    """``rows`` (tokens, p, more columns) with the fitted ``rate``; ``targets``: expected tokens by domain."""
    k = len(targets)
    total = max(1.0, float(targets.sum()))
    rows = rows.withColumn("rate", F.lit(1.0))
    p = [F.col("p")[i] for i in range(k)]
    best, damp, trial, prev = None, 1.0, rows, None
    for step in range(max_steps + 1):
        n = F.col("tokens").cast("double")
        got = trial.agg(*(F.sum(F.col("rate") * n * p[i]).alias(f"s{i}") for i in range(k)),
                        *(F.sum(F.when(F.col("rate") > 0, n * p[i] * p[j])).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k))).first()
        res = np.array([got[f"s{i}"] or 0.0 for i in range(k)]) - targets
        err = float(np.abs(res).max()) / total
        if best is None or err < best:
            best, rows, prev = err, trial, (res, got)
            damp = min(1.0, damp * 2)
        else:
            damp /= 4  # too far: a shorter step from the best rates so far
        if best <= tolerance or damp < 1e-3 or step == max_steps:
            break
        res, got = prev
        gram = np.array([[got[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
        c = np.linalg.solve(gram + np.eye(k) * 1e-9 * max(1.0, np.trace(gram)), res) * damp
        move = sum((p[i] * F.lit(float(c[i])) for i in range(k)), F.lit(0.0))
        trial = rows.withColumn("rate", F.greatest(F.lit(0.0), F.col("rate") - move))
        if step % write_every == write_every - 1:
            trial = staged(trial, "rates")
    return rows


def mix(docs: DataFrame, labels: DataFrame, *, targets: dict[str, float] | None = None, doc_id: str = "doc_id",
        text: str = "text", max_train: int = 6000, features: int = 1 << 15) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, domain (likeliest), posterior (map by domain), rate
    (expected copies, >= 0), copies (rate rounded up or down by a hash of the id, so that its mean is the rate).

    ``targets`` gives the domains' shares of all tokens (a domain not named gets 0; shares are scaled to
    sum to 1). Null or empty texts have 0 tokens and the posterior of an empty text; null ids are no one's label;
    repeated rows each count; documents labelled twice count once in training; without labels all
    documents are of one domain and keep rate 1; an empty table gives no rows; other columns are not read."""
    targets = targets or TARGETS
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("_t"))
    labelled = labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain_of(F.col("quality"), F.col("toxic")).alias("domain"))
    rows, domains = posteriors(docs, labelled, max_train=max_train, features=features)
    rows = staged(rows, "posteriors")
    total = float(rows.agg(F.sum("tokens")).first()[0] or 0)
    share = np.array([targets.get(d, 0.0) for d in domains])
    if share.sum() > 0:
        rows = fit_rates(rows, share / share.sum() * total)
    else:
        rows = rows.withColumn("rate", F.lit(1.0))
    names = F.array(*map(F.lit, domains))
    u = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / F.lit(1 << 30)
    return rows.select("doc_id", F.col("tokens").alias("n_tokens"),
                       F.element_at(names, F.array_position("p", F.array_max("p")).cast("int")).alias("domain"),
                       F.map_from_arrays(names, "p").alias("posterior"), "rate",
                       (F.floor("rate") + (u < F.col("rate") - F.floor("rate")).cast("long")).cast("long").alias("copies"))

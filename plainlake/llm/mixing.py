"""Mixing documents to target weights over soft domains; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plainlake.llm.shared import Workspace, free_names, row_key
from plainlake.session import ease

#: Hashed words, and behind them shapes: a word's last character if it is no letter, and whether it has only capitals.
BUCKETS, SHAPES = 1 << 16, 512
#: A feature counts if its documents differ between a domain and the rest by this chi-square: one in ten million by chance.
SURE = 28.0
#: The mix's tokens of each domain as shares of the present tokens. They add up to one: there are as many tokens as
#: before, toxic documents go, and those of low quality come more rarely than they do in a crawl.
TARGETS = {"high": 0.95, "low": 0.05, "toxic": 0.0}


def label_domain() -> Column:
    """The domain that a row of labels (quality, toxic) gives its document; a row without either gives none."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")


def _words(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(…, word, bucket, shape): all words of a text, and an empty one beside white space. `keep` are columns: an
    expression over the text would be computed anew for every word."""
    w = docs.select(*keep, F.explode(F.split(F.coalesce("text", F.lit("")), r"\s", -1)).alias("word"))
    last = F.least(F.ascii(F.right("word", F.lit(1))), F.lit(127))
    letter = last.between(65, 90) | last.between(97, 122)
    shape = F.when(letter, 0).otherwise(last) + F.when((F.length("word") > 2) & (F.col("word") == F.upper("word")) & (F.col("word") != F.lower("word")), 128).otherwise(0)
    return w.select(*keep, "word", F.pmod(F.xxhash64(F.lower("word")), F.lit(BUCKETS)).cast("int").alias("bucket"), (F.lit(BUCKETS) + shape).cast("int").alias("shape"))


def _scores(docs: DataFrame, keep: list[str], weights: DataFrame) -> DataFrame:
    """(…, n, s0, s1, …): words and the sums of their weights for each distinct `keep`. The weights are one row of arrays
    of BUCKETS + SHAPES numbers, which a scalar subquery hands to every task; words never meet a join."""
    some = F.col("word") != ""
    sums = [F.sum(F.when(some, F.get(weights.select(w).scalar(), F.col("bucket")) + F.get(weights.select(w).scalar(), F.col("shape"))).otherwise(0.0)).alias(f"s{w[1:]}") for w in weights.columns]
    return _words(docs, keep).groupBy(*keep).agg(F.sum(some.cast("long")).alias("n"), *sums)


def _calibrated(scores: np.ndarray, domain: np.ndarray, sizes: list[int], rounds: int = 300, ridge: float = 1e-3) -> np.ndarray:
    """Multinomial logistic regression of the sample's domains on its few scores (compressed: a long text must not
    outvote everything by its length), with the priors moved from the sample's to those of all labels (`sizes`); equal
    posteriors without a sample."""
    c = np.zeros((len(sizes), scores.shape[1] + 1))
    if not len(scores):
        return c
    x = np.concatenate([np.ones((len(scores), 1)), np.arcsinh(scores)], 1)
    y = np.eye(len(sizes))[domain]
    step = 2.0 / np.linalg.eigvalsh(x.T @ x / len(x)).max()
    momentum = c
    for r in range(rounds):
        z = x @ momentum.T
        p = np.exp(z - z.max(1, keepdims=True))
        new = momentum - step * ((p / p.sum(1, keepdims=True) - y).T @ x / len(x) + ridge * momentum)
        c, momentum = new, new + r / (r + 3) * (new - c)
    c[:, 0] += np.log(np.maximum(sizes, 0.5) / np.maximum(y.sum(0), 0.5))
    return c


def fit(docs: DataFrame, labels: DataFrame, domains: list[str], ws: Workspace, docs_per_domain: int = 2000) -> tuple[DataFrame, np.ndarray]:
    """(weights: one row with an array of BUCKETS + SHAPES log odds for each pair of domains, coefficients over the scores).

    The classifier sees a bounded sample: about `docs_per_domain` labelled documents of each domain, chosen by a hash of
    the doc_id with a rate from the domain's row count, and their whole texts. A doc_id with several labels has the first
    domain in order. A feature's weight for a pair is the log odds of one domain's documents that hold it against the
    other's, and zero unless SURE: what tells two domains apart is not drowned by what tells both from a third. A logistic
    regression over the sample's few scores a document gives the coefficients.
    """
    named = labels.select("doc_id", label_domain().alias("domain")).filter("domain is not null and doc_id is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    sizes = {r["domain"]: r["n"] for r in named.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    rate = F.coalesce(*[F.when(F.col("domain") == d, min(1.0, docs_per_domain / n)) for d, n in sizes.items()], F.lit(0.0)) if sizes else F.lit(0.0)
    chosen = named.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30) < rate)
    chosen = ws.save(chosen, "chosen")
    few = chosen.count() <= 2 * docs_per_domain * max(len(sizes), 1)  # ids; else the join is a shuffle
    sample = docs.join(F.broadcast(chosen) if few else chosen, "doc_id").select("domain", *row_key("doc_id", "text"), "text").dropDuplicates(["_k1", "_k2"])
    sample = ws.save(sample, "sample")
    k = range(len(domains))
    counts = {r["domain"]: r["n"] for r in sample.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    size = [float(counts.get(d, 0)) for d in domains]
    words = _words(sample, ["domain", "_k1", "_k2"]).filter("word <> ''")
    holds = words.select("domain", "_k1", "_k2", F.explode(F.array("bucket", "shape")).alias("f")).distinct()
    found = holds.groupBy("f").agg(*[F.sum((F.col("domain") == d).cast("double")).alias(f"a{i}") for i, d in enumerate(domains)])

    def weight(i: int, j: int) -> Column:
        a, b, m, n = F.col(f"a{i}"), F.col(f"a{j}"), size[i], size[j]
        if not m or not n:
            return F.lit(0.0)
        off = a * n - b * m
        sure = off * off * (m + n) >= SURE * m * n * (a + b) * (m + n - a - b)
        return F.when(sure & (off != 0), F.log((a + 0.5) / (m + 1)) - F.log((b + 0.5) / (n + 1))).otherwise(0.0)

    every = docs.sparkSession.range(BUCKETS + SHAPES).select(F.col("id").cast("int").alias("f"))
    pairs = [(i, j) for i in k for j in k if i < j]
    placed = every.join(found.select("f", *[weight(i, j).alias(f"w{i}_{j}") for i, j in pairs]), "f", "left")
    arrays = [F.transform(F.sort_array(F.collect_list(F.struct("f", F.coalesce(f"w{i}_{j}", F.lit(0.0)).alias("w")))), lambda x: x["w"]).alias(f"w{i}_{j}") for i, j in pairs]
    weights = ws.save(placed.agg(*arrays), "weights")
    seen = _scores(sample, ["domain", "_k1", "_k2"], weights).collect()
    scores = np.array([[r[f"s{i}_{j}"] for i, j in pairs] for r in seen]).reshape(-1, len(pairs))
    return weights, _calibrated(scores, np.array([domains.index(r["domain"]) for r in seen], int), [sizes.get(d, 0) for d in domains])


def posteriors(docs: DataFrame, model: tuple[DataFrame, np.ndarray], domains: list[str]) -> DataFrame:
    """(_k1, _k2, c, n, p0, p1, …): for each distinct row its copies c, words n and the domains' posteriors.

    A text without words has the posteriors of a text without any telling word."""
    weights, coefficients = model
    k, scores = range(len(domains)), [f"s{w[1:]}" for w in weights.columns]
    once = docs.select(*row_key("doc_id", "text"), "text")
    # A copy of a row counts its words again: c is how often, and n and the scores are those of one.
    copies = once.groupBy("_k1", "_k2").agg(F.count("*").alias("c"))
    rows = _scores(once, ["_k1", "_k2"], weights).join(copies, ["_k1", "_k2"])
    rows = rows.select("_k1", "_k2", "c", (F.col("n") / F.col("c")).cast("long").alias("n"), *[F.asinh(F.col(s) / F.col("c")).alias(s) for s in scores])
    rows = rows.withColumns({f"l{i}": F.lit(float(x[0])) + sum((F.lit(float(b)) * F.col(s) for b, s in zip(x[1:], scores)), F.lit(0.0)) for i, x in enumerate(coefficients)})
    rows = rows.withColumn("top", F.greatest(*[f"l{i}" for i in k]) if len(domains) > 1 else F.col("l0"))
    rows = rows.withColumns({f"e{i}": F.exp(F.col(f"l{i}") - F.col("top")) for i in k})
    total = sum((F.col(f"e{i}") for i in k), F.lit(0.0))
    return rows.select("_k1", "_k2", "c", "n", *[(F.col(f"e{i}") / total).alias(f"p{i}") for i in k])


def fit_rates(rows: DataFrame, targets: list[float], most_rounds: int = 40, tolerance: float = 1e-6, ridge: float = 1e-3) -> DataFrame:
    """`rows` with rate: the nonnegative x that minimise sum_k (T_k - t_k)**2 + ridge * (mean over tokens of (x - 1)**2),
    T_k the share of all tokens that domain k is expected to have, sum c * x * n * p_k over sum c * n, and t_k targets[k].

    The ridge makes the rates unique and keeps them near one where targets can't be met: soft domains can't be emptied.
    Projected gradient from x = 1 in a metric by tokens: a gradient is a combination of a document's posteriors, so the
    point before its projection to x >= 0 is 1 - sum_k m_k * p_k, and all of it that moves are the few m_k. A step needs
    the totals T_k and, to scale the gradient, the Gram matrix of the documents with x > 0; one aggregation gives both,
    and no step writes a table. A step that does not come nearer is halved. Without tokens all rates are one.
    """
    k = range(len(targets))
    goal, m = np.array(targets), np.zeros(len(targets))
    weight = F.col("c") * F.col("n")
    at = lambda m: F.greatest(F.lit(0.0), F.lit(1.0) - sum((F.lit(float(v)) * F.col(f"p{i}") for i, v in enumerate(m)), F.lit(0.0)))
    best, move = None, np.zeros(len(targets))
    for _ in range(most_rounds):
        x = rows.withColumn("x", at(m)).withColumn("on", (F.col("x") > 0).cast("int"))
        sums = [F.sum(weight).alias("all"), *[F.sum(weight * F.col("x") * F.col(f"p{i}")).alias(f"t{i}") for i in k]]
        got = x.agg(*sums, *[F.sum(weight * F.col("on") * F.col(f"p{i}") * F.col(f"p{j}")).alias(f"g{i}_{j}") for i in k for j in k if i <= j]).first()
        ease(rows.sparkSession)
        if not got["all"]:
            break
        off = np.array([got[f"t{i}"] for i in k]) / got["all"] - goal - ridge * m
        if best is not None and np.abs(off).max() > 0.9999 * best[1]:
            move = move / 2
            m = best[0] + move
            if np.abs(move).max() < tolerance:
                break
            continue
        best = (m, np.abs(off).max())
        if best[1] < tolerance:
            break
        gram = np.array([[got[f"g{min(i, j)}_{max(i, j)}"] for j in k] for i in k]) / got["all"]
        move = np.linalg.solve(gram + ridge * np.eye(len(targets)), off)
        m = m + move
    return rows.withColumn("rate", at(best[0] if best else m))


def mix(docs: DataFrame, labels: DataFrame, ws: Workspace, targets: Mapping[str, float] = TARGETS) -> DataFrame:
    """(_k1, _k2, n_tokens, p_<domain>…, rate) for each distinct row (doc_id, text) of `docs`.

    `targets` are the shares of the present tokens (words between ASCII white space) that the domains shall have in
    expectation; they may add up to more or less than one. Null and empty text has no tokens and rate 1. Rows that are
    repeated each have their rate. Without any label all posteriors are equal; a domain without one has next to none. An
    empty table gives an empty table; columns beyond doc_id, text and the labels' quality and toxic are not read.
    """
    domains = sorted(targets)
    model = fit(docs.select("doc_id", "text"), labels, domains, ws)
    rows = ws.save(posteriors(docs.select("doc_id", "text"), model, domains), "posteriors")
    rated = fit_rates(rows, [float(targets[d]) for d in domains])
    return rated.select("_k1", "_k2", F.col("n").alias("n_tokens"), *[F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(domains)], F.when(F.col("n") == 0, 1.0).otherwise(F.col("rate")).alias("rate"))


def apply_rates(docs: DataFrame, rated: DataFrame) -> DataFrame:
    """Each row as often as its rate says: the whole part, and once more with the probability of the rest, drawn from a
    hash of the row. The rows carry no text of their own through the fit; they are joined once."""
    part = F.col("rate") - F.floor("rate")
    draw = F.pmod(F.xxhash64("_k2", "_k1"), F.lit(1 << 30)) / float(1 << 30)
    k1, k2, n, one = free_names(docs, 4)
    times = rated.select(F.col("_k1").alias(k1), F.col("_k2").alias(k2), (F.floor("rate") + (draw < part).cast("int")).cast("int").alias(n)).filter(F.col(n) > 0)
    rows = docs.withColumns(dict(zip((k1, k2), row_key("doc_id", "text")))).join(times.hint("shuffle_hash"), [k1, k2])
    return rows.withColumn(one, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)

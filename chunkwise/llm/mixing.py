"""Mixing sources to target weights by hierarchical budgets over a domain-language-source tree.

Weights go from the root to the leaves. A leaf can give its tokens once for each allowed epoch; what it can't give is
shared among its siblings by their weights, and only what a whole family can't give goes up to the
relatives of its parent. Each leaf then takes a prefix of its documents, shuffled anew by a seeded hash in every epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

LEVELS = ("domain", "lang", "source")
SEED, EPOCHS, SHARE, BUCKETS = 17, 2, 0.6, 1024
#: Weights of this corpus: two domains, languages within a domain; sources weigh the same.
WEIGHTS = {("web",): 0.7, ("reference",): 0.3, ("web", "en"): 0.5, ("web", "de"): 0.2, ("web", "fr"): 0.2, ("web", "es"): 0.1, ("reference", "en"): 0.4, ("reference", "de"): 0.2, ("reference", "fr"): 0.2, ("reference", "es"): 0.2}
REFERENCE_SOURCES = tuple(f"src{i}" for i in range(14, 20))


def domain_of(source: Column) -> Column:
    return F.when(source.isin(*REFERENCE_SOURCES), "reference").otherwise("web")


def split_budget(total: int, wants: dict, weights: dict) -> dict:
    """Whole tokens for each child, by weight, never more than it wants; shortages go to the others by weight."""
    got, open_, left = {k: 0 for k in wants}, {k for k in wants if wants[k] > 0 and weights[k] > 0}, min(total, sum(wants.values()))
    while left > 0 and open_:
        mass = sum(weights[k] for k in open_)
        full = {k for k in open_ if wants[k] - got[k] <= left * weights[k] / mass}
        if not full:
            exact = {k: left * weights[k] / mass for k in open_}
            parts = {k: min(int(x), wants[k] - got[k]) for k, x in exact.items()}
            rest = left - sum(parts.values())
            for k in sorted(open_, key=lambda k: (parts[k] - exact[k], str(k))):
                if rest > 0 and got[k] + parts[k] < wants[k]:
                    parts[k] += 1
                    rest -= 1
            for k, x in parts.items():
                got[k] += x
            break
        for k in full:
            left -= wants[k] - got[k]
            got[k] = wants[k]
        open_ -= full
    return got


def budgets(supply: dict[tuple, int], total: int, weights: dict[tuple, float]) -> dict[tuple, int]:
    """Tokens for each leaf. supply: most tokens that a leaf can give; weights: of any path, 1 where not named.

    A node's want is what its leaves can give, so a family keeps its share as long as any of it can use it.
    """
    depth = len(next(iter(supply))) if supply else 0

    def give(path: tuple, amount: int) -> dict[tuple, int]:
        if len(path) == depth:
            return {path: amount}
        wants: dict[tuple, int] = {}
        for leaf, n in supply.items():
            if leaf[: len(path)] == path:
                wants[leaf[: len(path) + 1]] = wants.get(leaf[: len(path) + 1], 0) + n
        parts = split_budget(amount, wants, {k: weights.get(k, 1.0) for k in wants})
        return {leaf: n for child, part in parts.items() for leaf, n in give(child, part).items()}

    return give((), min(total, sum(supply.values()))) if supply else {}


def token_count(text: Column) -> Column:
    """Runs of characters that aren't white space; null and blank texts have none."""
    trimmed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, " "))).cast("long")


def mix(docs: DataFrame, weights: dict[tuple, float] = WEIGHTS, total: int | None = None, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED, tokens: Column | None = None) -> DataFrame:
    """The documents of the mixture, a row for each time one is taken: (doc_id, __domain, __lang, __source, __epoch, __tokens, __text).

    __text is the md5 of the text, by which rows that repeat an id with another text are told apart; texts themselves don't move.

    total is the budget in tokens; without one it is `share` of the corpus's tokens. In an epoch the documents of a leaf
    go by md5 of seed, epoch and id; a document is taken if it ends within its leaf's budget, so that a leaf
    exceeds nothing and falls short by less than the document at the cut. A leaf gives its corpus at most `epochs` times.

    Null domains, languages or sources are leaves of their own. Documents without a token or without an id are never
    taken. Ids have to be integers. An empty table gives no rows, other columns are ignored. Rows that repeat an id count one by one; ties in the hash go by id, then by text. Sums by hash bucket find the
    cut, so no leaf, however large, is ordered as a whole.
    """
    tokens = token_count(F.col("text")) if tokens is None else tokens
    path = [F.coalesce(domain_of(F.col("source")), F.lit("web")), *(F.coalesce(F.col(c), F.lit("\0null")) for c in LEVELS[1:])]
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col("__epoch"), F.col("doc_id")))
    base = docs.select("doc_id", "text", "lang", "source", tokens.alias("__tokens")).where("__tokens > 0 and doc_id is not null")
    base = base.select("*", *(p.alias(f"__{c}") for p, c in zip(path, LEVELS)))
    light = base.select("doc_id", "__tokens", *(f"__{c}" for c in LEVELS), F.md5("text").alias("__text"))
    light = light.withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("__order", order)
    light = light.withColumn("__bucket", F.conv(F.substring("__order", 1, 8), 16, 10).cast("long") * BUCKETS / F.lit(1 << 32)).withColumn("__bucket", F.col("__bucket").cast("int"))
    light = cut(light)
    leaf = [f"__{c}" for c in LEVELS]
    sums = cut(light.groupBy(*leaf, "__epoch", "__bucket").agg(F.sum("__tokens").alias("__sum")))
    have = {tuple(r[c] for c in leaf): r["n"] for r in sums.where("__epoch = 0").groupBy(*leaf).agg(F.sum("__sum").alias("n")).collect()}
    if total is None:
        total = int(share * sum(have.values()))
    plan = budgets({k: n * epochs for k, n in have.items()}, total, weights)
    spark = docs.sparkSession
    rows = [(*k, n) for k, n in plan.items()]
    budget = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in leaf) + ", __budget long")
    before = F.sum("__sum").over(Window.partitionBy(*leaf).orderBy("__epoch", "__bucket").rowsBetween(Window.unboundedPreceding, -1))
    at = sums.withColumn("__before", F.coalesce(before, F.lit(0))).join(budget, leaf)
    at = at.where("__before < __budget").withColumn("__whole", F.expr("__before + __sum <= __budget"))
    picked = light.join(at.select(*leaf, "__epoch", "__bucket", "__before", "__whole", "__budget"), [*leaf, "__epoch", "__bucket"])
    upto = F.sum("__tokens").over(Window.partitionBy(*leaf, "__epoch", "__bucket").orderBy("__order", "doc_id", "__text").rowsBetween(Window.unboundedPreceding, 0))
    edge = picked.where("not __whole").withColumn("__upto", F.col("__before") + upto).where("__upto <= __budget")
    columns = ["doc_id", *leaf, "__epoch", "__tokens", "__text"]
    return picked.where("__whole").select(*columns).unionByName(edge.select(*columns))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, domain, lang, source, epoch, n_tokens), a row for each time a document is taken."""
    null = lambda c: F.when(F.col(f"__{c}") != "\0null", F.col(f"__{c}")).alias(c)
    out = mix(docs.select("doc_id", "text", "lang", "source"), **options)
    return out.select("doc_id", F.col("__domain").alias("domain"), null("lang"), null("source"), F.col("__epoch").alias("epoch"), F.col("__tokens").alias("n_tokens"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))

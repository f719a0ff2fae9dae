"""Mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, language, source). What a node can give is what its leaves can
give over the allowed epochs. The budget flows from the root: siblings share their
parent's part by weight, one that cannot take its share is filled and the others
take what it leaves; a parent whose children cannot take its share is itself short
before its own siblings, so shortages go to siblings before ancestors. A leaf then
takes whole epochs and a token-prefix of one more, each epoch in its own seeded order.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalox.llm.common import materialize

LEVELS = ("domain", "lang", "source")
#: Whole tokens that the mixture takes, as a share of all tokens of one epoch.
BUDGET_SHARE = 0.8
#: Times that a leaf may be drawn whole; a leaf smaller than its share repeats, in another order each time.
MAX_EPOCHS = 4
SEED = 17
#: Hexadecimal digits of the order key that make a segment; running sums are taken over segments first.
SEGMENT_DIGITS = 3

#: Target weights. A node that is not named weighs 1 beside its siblings.
DOMAIN_WEIGHTS = {"core": 3.0, "tail": 2.0}
LANG_WEIGHTS = {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 2.0}
SOURCE_WEIGHTS = {"src0": 2.0}


def domain_of(source) -> F.col:
    """The domain of a source: ``core`` for numbers below ten, ``tail`` for the others."""
    return F.when(F.coalesce(source, F.lit("")).rlike("^src[0-9]$"), "core").otherwise("tail")


def n_words(text) -> F.col:
    """Runs without ASCII white space; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def weight_of(column, weights: Mapping[str, float]) -> F.col:
    out = F.lit(1.0)
    for name, weight in weights.items():
        out = F.when(column == name, float(weight)).otherwise(out)
    return out


def fill(nodes: DataFrame, parent: list[str], share: str, name: str) -> DataFrame:
    """``nodes`` with ``name``: the part of ``share`` that each sibling under ``parent`` takes.

    The part is min(cap, level * weight) for the one level at which the siblings take
    min(share, sum of caps). Siblings in order of cap / weight fill one after
    another, so the level follows from running sums.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), *[c for c in LEVELS if c in nodes.columns])
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*parent)
    nodes = nodes.withColumn("caps_before", F.coalesce(F.sum("cap").over(upto), F.lit(0.0))).withColumn(
        "weights_from", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    level = (F.col(share) - F.col("caps_before")) / F.col("weights_from")
    # The first sibling in order that is not full has the level; later ones would count full what is not and get less.
    open_ = F.when(level * F.col("weight") <= F.col("cap"), level)
    return nodes.withColumn("level", F.max(open_).over(every)).withColumn(
        name, F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("weight")), F.col("cap"))).drop("caps_before", "weights_from", "level")


def budgets(leaves: DataFrame, budget: float, max_epochs: int, domain_weights=DOMAIN_WEIGHTS, lang_weights=LANG_WEIGHTS, source_weights=SOURCE_WEIGHTS) -> DataFrame:
    """Rows (domain, lang, source, tokens, part): whole tokens that each leaf gives.

    ``leaves(domain, lang, source, tokens)`` has one row per leaf.
    """
    weights = dict(zip(LEVELS, (domain_weights, lang_weights, source_weights), strict=True))
    caps = leaves.withColumn("cap", F.col("tokens").cast("double") * max_epochs)
    above = None
    for depth in range(1, len(LEVELS) + 1):
        keys, parent = list(LEVELS[:depth]), list(LEVELS[: depth - 1])
        nodes = caps.groupBy(*keys).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens")).withColumn("weight", weight_of(F.col(keys[-1]), weights[keys[-1]]))
        if above is None:
            nodes, parent = nodes.withColumn("share", F.lit(float(budget))).withColumn("root", F.lit(0)), ["root"]
        else:
            nodes = nodes.join(above, parent)
        above = fill(nodes, parent, "share", "part").select(*keys, F.col("part").alias("share"), "tokens")
        if depth < len(LEVELS):
            above = above.drop("tokens")
    return above.select(*LEVELS, "tokens", F.floor(F.col("share") + 1e-6).cast("long").alias("part"))


def mix(docs: DataFrame, budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, id_col: str = "doc_id", domain_weights=DOMAIN_WEIGHTS, lang_weights=LANG_WEIGHTS, source_weights=SOURCE_WEIGHTS) -> DataFrame:
    """The mixture: ``id_col, domain, lang, source, epoch, tokens, first_token, taken``.

    Tokens are words. ``first_token`` is the document's place in its leaf's epoch and
    ``taken`` how many of its tokens fall within the prefix: all of them but for the
    last document of a leaf. Null languages or sources are leaves named ''. Documents
    without tokens are never taken; rows without an id are left out. Rows that repeat
    an id are each drawn. Ties in the seeded order go by id. Texts of any length
    count whole. An empty table gives an empty result. Other columns are ignored,
    whatever their names.
    """
    found = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
        n_words(F.col("text")).alias("tokens")).filter("id is not null and tokens > 0").withColumn("domain", domain_of(F.col("source")))
    found = materialize(found, "mix-tokens", keep=True)
    leaves = found.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    parts = budgets(leaves, int(total * budget_share), max_epochs, domain_weights, lang_weights, source_weights)
    parts = materialize(parts.select(*LEVELS, "part", F.col("tokens").alias("leaf_tokens")).filter("part > 0"), "mix-parts", keep=True)

    epochs = F.explode(F.sequence(F.lit(0), F.floor((F.col("part") - 1) / F.col("leaf_tokens")).cast("int")))
    drawn = found.join(parts, list(LEVELS)).withColumn("epoch", epochs)
    left = F.col("part") - F.col("epoch") * F.col("leaf_tokens")
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), "epoch", "id"))
    drawn = drawn.withColumn("left", left).withColumn("key", key).withColumn("segment", F.substring("key", 1, SEGMENT_DIGITS))
    whole = drawn.filter("left >= leaf_tokens").select("id", *LEVELS, "epoch", "tokens", F.lit(None).cast("long").alias("first_token"), F.col("tokens").alias("taken"))

    partial = drawn.filter("left < leaf_tokens")
    leaf = [*LEVELS, "epoch"]
    segments = partial.groupBy(*leaf, "segment").agg(F.sum("tokens").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy(*leaf).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1))
    segments = segments.select(*leaf, "segment", F.coalesce(earlier, F.lit(0)).alias("segment_start"))
    within = F.sum("tokens").over(Window.partitionBy(*leaf, "segment").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, -1))
    placed = partial.join(segments, [*leaf, "segment"]).filter("segment_start < left").withColumn("first_token", F.col("segment_start") + F.coalesce(within, F.lit(0)))
    placed = placed.filter("first_token < left").select(
        "id", *LEVELS, "epoch", "tokens", "first_token", F.least(F.col("tokens"), F.col("left") - F.col("first_token")).alias("taken"))
    return whole.union(placed).withColumnRenamed("id", id_col)

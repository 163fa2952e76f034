"""Mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, language, source). A token budget flows down the tree in proportion to the
weights of siblings; what a node cannot supply within ``max_epochs`` passes over its documents goes to its
siblings in proportion to their weights, and only what they all cannot supply goes to the parent's
siblings. Levels of the tree are tables: however many leaves there are, none reaches the driver.
A leaf takes whole epochs and then the longest prefix, in the seeded order of the next
epoch, whose tokens fit. That prefix is a threshold on a hash of the document: finding it needs sums by
hash cell, again within one cell per leaf, and taking it is a filter. No leaf is ever sorted.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stored, table, text_or_empty

#: A leaf's order is cut into 2^CELL_BITS cells by hash, and the cell where its budget ends again, LEVELS times in all.
CELL_BITS = 8
LEVELS = 3
LEAF = ("domain", "lang", "source")


@dataclass(frozen=True)
class Mixture:
    """Weights of siblings by name at each level; names that are missing weigh ``other``. Negative weights count as 0."""

    domains: dict
    langs: dict
    sources: dict
    other: float = 1.0

    def weight(self, level: int) -> Column:
        """Weight of a row's node at a level."""
        given, name = (self.domains, self.langs, self.sources)[level], F.col(LEAF[level])
        named = [x for k, w in given.items() if k is not None for x in (F.lit(k), F.lit(max(0.0, float(w))))]
        other = F.lit(max(0.0, float(self.other)))
        known = F.coalesce(F.try_element_at(F.create_map(*named), name), other) if named else other
        return F.when(name.isNull(), max(0.0, float(given.get(None, self.other)))).otherwise(known)


def fill(nodes: DataFrame, parent: tuple[str, ...]) -> DataFrame:
    """Adds due, what each node gets of its parent's amount: in proportion to weights, none over its most.

    nodes: parent columns, most, weight, amount (of the parent). Siblings fill up in the order of most / weight, so one pass
    in that order decides: a sibling is full if its share of what those before it leave, by weight, reaches its most.
    What is due per weight where the first one is not full is due to it and all after it.
    """
    siblings = Window.partitionBy(*parent)
    ratio = F.when(F.col("weight") > 0, F.col("most") / F.col("weight")).otherwise(0.0)
    order = siblings.orderBy("_ratio", "most", "weight")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    counted = F.when(F.col("most") > 0, F.col("weight")).otherwise(0.0)
    rows = nodes.withColumns({"_ratio": ratio, "_weight": counted})
    rows = rows.withColumns({"_given": F.coalesce(F.sum("most").over(before), F.lit(0.0)), "_seen": F.coalesce(F.sum("_weight").over(before), F.lit(0.0)), "_no": F.row_number().over(order), "_whole": F.sum("_weight").over(siblings)})
    left = F.col("_whole") - F.col("_seen")
    rate = F.when((F.col("_weight") > 0) & (left > 0), F.greatest(F.lit(0.0), F.col("amount") - F.col("_given")) / left)
    rows = rows.withColumn("_rate", rate)
    rows = rows.withColumn("_open", F.when((F.col("_weight") > 0) & (F.col("most") > F.col("_rate") * F.col("weight")), F.struct("_no", "_rate")))
    first = F.min("_open").over(siblings)
    rows = rows.withColumn("_first", first)
    full = F.col("_first").isNull() | (F.col("_no") < F.col("_first")["_no"])
    due = F.when(full, F.col("most")).otherwise(F.least("most", F.col("_first")["_rate"] * F.col("weight")))
    return rows.withColumn("due", due).select(*nodes.columns, "due")


def budgets(leaves: DataFrame, mixture: Mixture, budget_share: float, max_epochs: int) -> DataFrame:
    """leaves (LEAF, tokens, perhaps more) with due, the tokens that each is to give. A subtree never gets more than it can supply."""
    usable = reduce(lambda a, b: a & b, (mixture.weight(i) > 0 for i in range(3)))
    leaves = stored(leaves.withColumns({"most": F.when(usable, F.col("tokens") * max_epochs).otherwise(0).cast("double"), "root": F.lit(0)}), "mixture-leaves")
    whole = leaves.agg(F.sum("tokens").alias("tokens"), F.sum("most").alias("most")).first()
    above = None
    for level in range(3):
        parent, own = ("root", *LEAF[:level]), ("root", *LEAF[: level + 1])
        nodes = leaves if level == 2 else leaves.groupBy(*own).agg(F.sum("most").alias("most"))
        nodes = nodes.withColumn("weight", mixture.weight(level))
        if above is None:
            nodes = nodes.withColumn("amount", F.lit(float(min(budget_share * (whole["tokens"] or 0), whole["most"] or 0))))
        else:
            nodes = _to_leaf(nodes, above.select(*parent, F.col("due").alias("amount")), keys=parent)
        above = fill(stored(nodes, "mixture-nodes"), parent)
    return above.withColumn("due", F.floor(F.col("due") + 1e-6).cast("long")).drop("root", "most", "weight", "amount")


def word_count(text: Column) -> Column:
    """Words of a text, the tokens of the budget."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _hash(seed: int, epoch: Column, place: Column) -> Column:
    """Place of a document in the seeded order of an epoch: 0 to 2^63 - 1."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch.cast("int"), place), 1)


def _cell(level: int) -> Column:
    """The leading bits of a 63-bit hash that number the cells of a level."""
    return F.shiftrightunsigned("hash", 63 - CELL_BITS * level)


def plan(rows: DataFrame, mixture: Mixture, budget_share: float, max_epochs: int, seed: int) -> DataFrame:
    """LEAF, epochs, cut: whole epochs to take, and the hash up to which to take the next one (null: nothing of it).

    rows: LEAF, place, tokens; a stored table, as it is read several times.
    """
    totals = rows.groupBy(*LEAF).agg(F.sum("tokens").alias("tokens")).withColumn("leaf", F.monotonically_increasing_id())
    due = budgets(totals, mixture, budget_share, max_epochs)
    left = F.when(F.col("tokens") > 0, F.col("due") % F.col("tokens")).otherwise(0)
    leaves = stored(due.select(*LEAF, "leaf", F.when(F.col("tokens") > 0, F.expr("due div tokens")).otherwise(0).alias("epochs"), left.alias("rest")), "mixture-due")
    placed = _to_leaf(rows, leaves.where(F.col("rest") > 0)).select("leaf", "rest", "tokens", _hash(seed, F.col("epochs"), F.col("place")).alias("hash"))
    placed = stored(placed, "mixture-placed")
    edge = leaves.select("leaf", F.lit(0).cast("long").alias("cell"), F.lit(0).cast("long").alias("before"))
    found = []
    for level in range(1, LEVELS + 1):
        inside = placed.withColumn("cell", _cell(level - 1)).join(edge, ["leaf", "cell"]).withColumn("cell", _cell(level))
        cells = inside.groupBy("leaf", "rest", "before", "cell").agg(F.sum("tokens").alias("tokens"), F.max("hash").alias("last"))
        upto = Window.partitionBy("leaf").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
        cells = stored(cells.withColumn("after", F.col("before") + F.sum("tokens").over(upto)), "mixture-cells")
        found.append(cells.where(F.col("after") <= F.col("rest")).groupBy("leaf").agg(F.max("last").alias("cut")))
        edge = cells.where((F.col("after") - F.col("tokens") <= F.col("rest")) & (F.col("after") > F.col("rest"))).select("leaf", "cell", (F.col("after") - F.col("tokens")).alias("before"))
    within = Window.partitionBy("leaf").orderBy("hash").rangeBetween(Window.unboundedPreceding, 0)
    edge_rows = placed.withColumn("cell", _cell(LEVELS)).join(edge, ["leaf", "cell"]).withColumn("upto", F.col("before") + F.sum("tokens").over(within))
    found.append(edge_rows.where(F.col("upto") <= F.col("rest")).groupBy("leaf").agg(F.max("hash").alias("cut")))
    cuts = reduce(DataFrame.unionByName, found).groupBy("leaf").agg(F.max("cut").alias("cut"))
    return stored(leaves.join(cuts, "leaf", "left").select(*LEAF, "epochs", "cut"), "mixture-plan")


def _to_leaf(rows: DataFrame, leaves: DataFrame, keys: tuple[str, ...] = LEAF) -> DataFrame:
    """Equi-join on the leaf, where nulls are equal; the columns of the leaf come once."""
    renamed = leaves.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.join(renamed, on).drop(*(f"_{k}" for k in keys))


def mix(docs: DataFrame, mixture: Mixture, domain: Column, budget_share: float = 1.0, max_epochs: int = 1, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", columns: tuple[str, ...] | None = None) -> DataFrame:
    """Rows of docs with two more columns: epoch (from 0) and n_words; a row for every epoch that takes the document.

    budget_share: the budget as a share of all words. columns: those of docs to give back, else all. A null domain,
    language or source is a name of its own. Null texts have no words; rows of a leaf without words are not taken. Rows
    with the same id and text are taken or left together. Columns named epoch or n_words are replaced. No rows: no rows.
    """
    kept = [c for c in columns or docs.columns if c not in ("epoch", "n_words")]
    text = text_or_empty(text_col)
    facts = [domain.cast("string").alias("domain"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.xxhash64(F.col(id_col).cast("string"), text).alias("place"), word_count(text).alias("tokens")]
    rows = stored(docs.select(*facts, F.struct(*kept).alias("row")), "mixture-rows")
    taken = _to_leaf(rows, plan(rows.drop("row"), mixture, budget_share, max_epochs, seed))
    times = F.col("epochs") + F.coalesce(_hash(seed, F.col("epochs"), F.col("place")) <= F.col("cut"), F.lit(False)).cast("long")
    each = taken.where(times > 0).select("row", F.col("tokens").alias("n_words"), F.explode(F.sequence(F.lit(0).cast("long"), times - 1)).alias("epoch"))
    return each.select("row.*", F.col("epoch").cast("int").alias("epoch"), "n_words")


def source_domain(source: Column) -> Column:
    """The tables hold no domains: sources are dealt to four by their names."""
    return F.concat(F.lit("d"), F.pmod(F.crc32(source.cast("string").cast("binary")), F.lit(4)))


TARGET = Mixture(domains={"d0": 0.4, "d1": 0.3, "d2": 0.2, "d3": 0.1}, langs={"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}, sources={})


def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget of 0.9 of all words from up to three passes over each leaf."""
    docs = table(spark, sf_dir, "documents")
    mixed = mix(docs, TARGET, source_domain(F.col("source")), budget_share=0.9, max_epochs=3, columns=("doc_id", "lang", "source"))
    return mixed.select("doc_id", source_domain(F.col("source")).alias("domain"), "lang", "source", "n_words", "epoch")


QUERIES = {"op9_mixture": op9_mixture}
SQL: dict[str, str] = {}

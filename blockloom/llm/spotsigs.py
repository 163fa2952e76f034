"""Document fingerprints by SpotSigs (DataFrame operations only).

A spot is a common word (anchor); its signature is the chain of the next two content words. A text's
fingerprint is the set of its chains, and beside it, for texts with few anchors, the set of the chains of all words;
texts of one word have the word itself. Fingerprints are compared by Jaccard, both in the same form. To find pairs, sets are put into
partitions by their length, so that only sets of the same or of neighbouring partitions can reach a
threshold, and a pair is dropped when its lengths alone rule it out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import partitions, table, text_or_empty

#: Anchors: common words of English, German, French and Spanish (fixed values).
ANCHORS = tuple(
    """the of and to in is it that for by on be with he they are was as this or an at not but from have you a
    der die das und den von mit ist für ein eine im auf sich dem zu nicht des als auch
    de la le les et en un une du que pour dans qui par sur au est pas ce il
    el y los del se las por para con no su lo como más""".split()
)
CHAIN = 2
LEAST = 0.8
#: Anchored chains that a text needs to be compared by them: so many, and one for so many characters.
LEAST_SPOTS = 8
SPOT_CHARS = 100
_MARK = "\u0001"


def _words(text: Column) -> Column:
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" "))


def anchored_chains(text: Column, anchors: tuple[str, ...] = ANCHORS) -> Column:
    """The distinct chains that follow a text's anchors, as words joined by spaces."""
    marked = F.regexp_replace(_words(text), f" (?:{'|'.join(sorted(set(anchors), key=lambda w: (-len(w), w)))})(?= )", f" {_MARK}")
    content = f"[^ {_MARK}]+"
    link = f"(?: {_MARK})* +{content}"
    spots = F.regexp_extract_all(marked, F.lit(f"{_MARK}(?= +({content}(?:{link}){{{CHAIN - 1}}}))"), F.lit(1))
    return F.array_distinct(F.transform(spots, lambda x: F.regexp_replace(F.replace(x, F.lit(f" {_MARK}"), F.lit("")), " +", " ")))


def free_chains(text: Column) -> Column:
    """The distinct chains of all words of a text; texts of fewer words than a chain themselves."""
    words = _words(text)
    content = f"[^ {_MARK}]+"
    every = F.regexp_extract_all(words, F.lit(f" (?=({content}(?: +{content}){{{CHAIN - 1}}}))"), F.lit(1))
    bare = F.trim(words)
    few = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.array(bare))
    return F.array_distinct(F.when(F.size(every) > 0, every).otherwise(few))


def chains(text: Column, anchors: tuple[str, ...] = ANCHORS) -> Column:
    """The distinct chains of a text: those that follow anchors or, without any, those of all words."""
    spots = anchored_chains(text, anchors)
    return F.when(F.size(spots) > 0, spots).otherwise(free_chains(text))


def hashed(found: Column) -> Column:
    """Sorted distinct 32-bit hashes of chains."""
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.hash(x))))


def signature_set(text: Column, anchors: tuple[str, ...] = ANCHORS) -> Column:
    return hashed(chains(text, anchors))


def with_signatures(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Adds struct<spots, free, enough>: both forms of the text's signature set, and whether the anchored one is large enough to be judged by."""
    forms = rows.withColumns({"_spots": hashed(anchored_chains(F.col(text))), "_free": hashed(free_chains(F.col(text)))})
    enough = F.size("_spots") >= F.greatest(F.lit(LEAST_SPOTS), F.length(text) / SPOT_CHARS)
    return forms.withColumn(name, F.struct(F.col("_spots").alias("spots"), F.col("_free").alias("free"), enough.alias("enough"))).drop("_spots", "_free")


def same_form(a: str, b: str) -> Column:
    """Likeness of two fingerprints: of their anchored chains if both have enough, else of the chains of all words."""
    forms = lambda x: F.when(F.col(f"{a}.enough") & F.col(f"{b}.enough"), F.col(f"{x}.spots")).otherwise(F.col(f"{x}.free"))
    return likeness(forms(a), forms(b))


def printed(signatures: Column) -> Column:
    """A fingerprint as a string: eight hexadecimal digits for each signature, in order."""
    return F.lower(F.array_join(F.transform(signatures, lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), ""))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard of two sets; 0 without comparing them where their lengths rule out ``least``. Two empty sets are alike."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    return F.when(large == 0, 1.0).when(small < F.lit(least) * large, 0.0).otherwise(common / (small + large - common))


def fingerprint(signatures: str) -> Column:
    """Both forms as a string: the anchored chains, an exclamation mark if they are enough, a point, the chains of all words."""
    return F.concat(printed(F.col(f"{signatures}.spots")), F.when(F.col(f"{signatures}.enough"), "!").otherwise(""), F.lit("."), printed(F.col(f"{signatures}.free")))


def length_partition(size: Column, least: float = LEAST) -> Column:
    """Sets that reach ``least`` differ by at most one in this number."""
    return F.floor(F.log(F.greatest(size, F.lit(1))) / F.lit(-math.log(least)) + 1e-9).cast("int")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """id, signatures (array<int>), partition: a row per input row. Null counts as empty, which has no signatures."""
    own = docs.select(F.col(id_col), signature_set(text_or_empty(text_col)).alias("signatures"))
    return own.withColumn("partition", length_partition(F.size("signatures"), least))


def matches(queries: DataFrame, corpus: DataFrame, id_col: str = "doc_id", least: float = LEAST) -> DataFrame:
    """query_id, id, likeness of all pairs of fingerprints() rows that reach ``least``.

    Pairs meet on a length partition and a signature among the first n - ceil(least*n) + 1 of each set:
    sets that reach ``least`` share one of those. Texts without signatures match nothing.
    """

    def keyed(rows: DataFrame, name: str) -> DataFrame:
        n = F.size("signatures")
        first = F.slice("signatures", 1, (n - F.ceil(n * F.lit(least) - 1e-9) + 1).cast("int"))
        return rows.where(n > 0).select(F.col(id_col).alias(name), F.col("signatures").alias(f"{name}_set"), "partition", F.explode(first).alias("signature"))

    around = keyed(queries, "query_id").withColumn("partition", F.explode(F.array(*(F.col("partition") + d for d in (-1, 0, 1)))))
    other = keyed(corpus, "id")
    lengths = F.least(F.size("query_id_set"), F.size("id_set")) >= F.lit(least) * F.greatest(F.size("query_id_set"), F.size("id_set"))
    pairs = around.join(other, ["partition", "signature"]).where(lengths)
    scored = pairs.select("query_id", "id", likeness(F.col("query_id_set"), F.col("id_set"), least).alias("likeness")).where(F.col("likeness") >= least)
    return scored.distinct()


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, text) in ranges of descending key, with column ``bucket``, and ghosts of the rows that follow each range.

    Ranges hold about equally many rows. The first row of a range also stands, as a ghost, at the end of the
    range before it; after the last range comes the first. So what follows a row is found within its range.
    """
    n = 4 * partitions(docs.sparkSession)
    accuracy = 20 * n
    bounds = docs.agg(F.percentile_approx(key, [i / n for i in range(1, n)], accuracy)).first()[0] or []
    bounds = sorted(set(bounds))
    out = docs.withColumn("bucket", F.lit(0))
    array, step = F.array(*(F.lit(b).cast("long") for b in bounds)), 1 << max(len(bounds).bit_length() - 1, 0)
    while step and bounds:  # binary search: the number of bounds that the key reaches
        probe = F.col("bucket") + step
        reached = (probe <= len(bounds)) & (F.get(array, probe - 1) <= F.col(key))
        out = out.withColumn("bucket", F.col("bucket") + F.when(reached, step).otherwise(0))
        step >>= 1
    tops = {r["bucket"]: r["top"] for r in out.groupBy("bucket").agg(F.max(key).alias("top")).collect()}
    above = dict(zip(sorted(tops), [*sorted(tops)[1:], *sorted(tops)[:1]], strict=True))
    size = max(tops, default=-1) + 1
    top_of = F.array(*(F.lit(tops.get(b)).cast("long") for b in range(size))) if size else F.array(F.lit(None).cast("long"))
    above_of = F.array(*(F.lit(above.get(b)).cast("int") for b in range(size))) if size else F.array(F.lit(None).cast("int"))
    place = F.struct(F.col("bucket"), F.lit(False).alias("ghost"))
    beyond = F.struct(F.get(above_of, F.col("bucket")).alias("bucket"), F.lit(True).alias("ghost"))
    placed = out.withColumn("place", F.explode(F.when(F.col(key) == F.get(top_of, F.col("bucket")), F.array(place, beyond)).otherwise(F.array(place))))
    return placed.select(key, text, "place.bucket", "place.ghost").repartition(n, "bucket")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: a row per input row.

    A fingerprint holds a text's signatures in both forms, and likeness compares two of them in one form, so what an edit
    does to the number of anchored chains does not count.

    The edited text has its last third (rounded down) replaced by the start of the next text, by
    descending id; after the last comes the first. Rows without an id come last, rows that share one
    follow each other in the order of their texts. Null counts as empty. Other columns are ignored. Ids are integers:
    ranges of them are what rows are dealt by.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must hold integers")
    lowest = -(1 << 63)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(lowest)).alias("key"), text_or_empty(text_col).alias("text"))
    marked = with_signatures(with_next(rows, "key", "text"), "text", "own")
    order = Window.partitionBy("bucket").orderBy("ghost", F.desc("key"), F.xxhash64("text"), "text")
    both = marked.withColumn("next", F.lead(F.struct("text", "own")).over(order)).where(~F.col("ghost"))
    n, third = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    edited = both.select("key", n.cast("long").alias("n_chars"), "own", F.col("next.own").alias("next"), F.concat(F.substring("text", F.lit(1), n - third), F.substring("next.text", F.lit(1), third)).alias("edited"))
    edited = with_signatures(edited, "edited", "other")
    return edited.select(
        F.when(F.col("key") != lowest, F.col("key")).cast(docs.schema[id_col].dataType).alias(id_col),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint("own").alias("fingerprint"),
        fingerprint("other").alias("edited_fingerprint"),
        same_form("own", "other").alias("near_edited"),
        same_form("own", "next").alias("near_next"),
    )


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {"op7_spotsigs": op7_spotsigs}
SQL: dict[str, str] = {}

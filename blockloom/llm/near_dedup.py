"""Near-duplicate detection: MinHash, banding, verification on whole shingle sets, connected components.

1. Each document's set of word shingles gives HASHES minima of universal hashes and, from them,
   BANDS keys. Documents with equal sets form a class, a node of the graph; only its first document goes on.
2. Documents that share a band's key share a bucket. Each is compared with the first of the bucket:
   signatures first, then whole sets. Confirmed links give components.
3. A bucket that still holds several components may hide links between documents that are both far
   from the first. Components whose signatures agree make families (connected components again): by the
   comparison with the first, and for documents far from it by meeting all others in tiles of bounded size.
   The documents of a family meet in tiles too, where what is not yet connected is compared on whole sets.

No bucket is expanded into pairs: a tile returns only the few edges that join its components. Yet
every pair that shares a key is connected, or was compared, or its signatures are far apart.
A pair of Jaccard 0.8 shares no key with probability (1 - 0.8^ROWS)^BANDS = 1.3e-7.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .shared import MOST_BROADCAST_IDS, forget, partitions, slices, split_join, stored, table, text_or_empty

BANDS, ROWS = 40, 5
HASHES = BANDS * ROWS
SHINGLE = 5
#: Percent of the union that linked documents share.
LEAST = 80
#: Signatures that agree in a smaller share of minima are no candidates: at Jaccard 0.8 that is five standard deviations off.
LEAST_AGREEMENT = 0.66
TILE = 1024
TILE_BYTES = 16 << 20
#: Documents that meet the first of a bucket in one task.
CHUNK = 1_000
SET = ("n_shingles", "set_a", "set_b")

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _family() -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of the universal hashes a*x + b mod 2^64."""
    random = np.random.default_rng(20)
    return random.integers(0, 1 << 63, HASHES, dtype=np.uint64) << _U(1) | _U(1), random.integers(0, 1 << 63, HASHES, dtype=np.uint64)


MULTIPLIERS, OFFSETS = _family()


def shingle_sets(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of words, lower-cased in ASCII.

    A text of fewer words has its whole sequence as one shingle; one without words has none.
    """
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return []
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(texts.buffers()[2], np.uint8)[first:last] if last > first else np.empty(0, np.uint8)
    offsets = offsets - first
    inside = ~_SPACE[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    opens[heads] = inside[heads]
    at, head = np.flatnonzero(opens), np.flatnonzero(opens[inside])
    letters = _LOWER[data[inside]].astype(np.uint64)
    place = np.arange(len(letters)) - np.repeat(head, np.diff(np.append(head, len(letters))))
    words = _mixed((letters + _U(1)) * (place.astype(np.uint64) * _U(0x9E3779B97F4A7C15) | _U(1)))
    words = _mixed(np.add.reduceat(words, head)) if len(head) else np.empty(0, np.uint64)
    ends = np.searchsorted(at, offsets)
    factors = _mixed(np.arange(1, shingle + 1, dtype=np.uint64)) | _U(1)
    whole = np.zeros(max(len(words) - shingle + 1, 0), np.uint64)
    for j, factor in enumerate(factors):
        whole += words[j : j + len(whole)] * factor
    whole = _mixed(whole)
    out = []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        if b - a >= shingle:
            out.append(np.unique(whole[a : b - shingle + 1]))
        elif b > a:
            out.append(_mixed(np.array([(words[a:b] * factors[: b - a]).sum(dtype=np.uint64) + _U(b - a)], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def minima(values: np.ndarray) -> np.ndarray:
    """The least value of every hash over a set, in its upper 32 bits."""
    least = np.full(HASHES, ~_U(0))
    for at in range(0, len(values), 2048):
        hashed = np.multiply.outer(MULTIPLIERS, values[at : at + 2048])
        hashed += OFFSETS[:, None]
        np.minimum(least, hashed.min(axis=1), out=least)
    return (least >> _U(32)).astype(np.uint32)


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.astype(np.uint64).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = _mixed(key + rows[:, j])
    return key.view(np.int64)


def place_of(text: str | Column = "text") -> Column:
    """With the id, tells the rows of a table apart by their texts."""
    return F.xxhash64(text)


def signatures(rows: DataFrame, shingle: int) -> DataFrame:
    """Of rows (id, text): id, place (a hash of the text), n_bytes, n_shingles, set_a, set_b (128 bits that tell sets apart), bands, sketch (a byte of every minimum)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, whole.column("text")):
                sets = shingle_sets(batch.column("text"), shingle)
                least = [minima(s) for s in sets]
                flat = np.concatenate([band_keys(x) for x in least]) if sets else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"),
                        batch.column("place"),
                        pc.binary_length(batch.column("text")).cast(pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)),
                        pa.array(np.array([_mixed(s + _U(77)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(flat)),
                        pa.array([(x & 0xFF).astype(np.uint8).tobytes() for x in least], pa.binary()),
                    ],
                    names=["id", "place", "n_bytes", *SET, "bands", "sketch"],
                )

    long = [T.StructField(c, T.LongType()) for c in ("place", "n_bytes", *SET)]
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), *long, T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])
    return rows.withColumn("place", place_of()).select("id", "place", "text").mapInArrow(sign, schema)


def _texts(rows: DataFrame, first: DataFrame) -> DataFrame:
    """node, text of classes (node, id, place): the text of any row with that id and that hash of the text."""
    few = first.count() <= MOST_BROADCAST_IDS
    first = first.withColumnRenamed("place", "of_node")
    found = rows.join(F.broadcast(first) if few else first, "id").where(place_of() == F.col("of_node"))
    return found.select("node", "text").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, first: DataFrame, rows: DataFrame, shingle: int, least: int) -> DataFrame:
    """The pairs (u, v) whose whole shingle sets share at least ``least`` percent of their union.

    The pairs of a v are dealt to chunks of about CHUNK rows or TILE_BYTES of their texts; the text of v goes once to each.
    """
    nodes = stored(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(first.select("node", "id", "place", "n_bytes"), "node"), "near-nodes")
    texts = stored(_texts(rows, nodes.select("node", "id", "place")), "near-texts")
    sizes = pairs.join(nodes.select(F.col("node").alias("u"), "n_bytes"), "u").groupBy("v").agg(F.count(F.lit(1)).alias("pairs"), F.sum("n_bytes").alias("bytes"))
    parts = F.greatest(F.ceil(F.col("pairs") / CHUNK), F.ceil(F.col("bytes") / TILE_BYTES), F.lit(1)).cast("int")
    sizes = stored(sizes.select("v", "pairs", parts.alias("parts")), "near-sizes")
    dealt = split_join(pairs, sizes, ["v"], "pairs", sizes.agg(F.sum("pairs")).first()[0] or 0).withColumn("part", F.pmod(F.xxhash64("u", F.lit(8)), F.col("parts")).cast("int"))
    n = partitions(rows.sparkSession)
    right = dealt.select("u", "v", "part").join(texts.select(F.col("node").alias("u"), F.col("text").alias("text")), "u").repartition(n, "v", "part")
    left = sizes.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(texts.select(F.col("node").alias("v"), F.col("text").alias("first_text")), "v").select("v", "part", "first_text").repartition(n, "v", "part")

    def compare(firsts: pa.Table, others: pa.Table) -> pa.Table:
        ok = []
        if firsts.num_rows and others.num_rows:
            a = shingle_sets(firsts.column("first_text").chunk(0).slice(0, 1), shingle)[0]
            for batch in others.to_batches():
                for some in slices(batch, batch.column("text")):
                    for b in shingle_sets(some.column("text"), shingle):
                        common = len(np.intersect1d(a, b, assume_unique=True)) if 100 * min(len(a), len(b)) >= least * max(len(a), len(b)) else 0
                        ok.append(common > 0 and 100 * common >= least * (len(a) + len(b) - common))
        return others.select(["u", "v"]).filter(pa.array(ok, pa.bool_())) if ok else pa.table({c: pa.array([], pa.int64()) for c in "uv"})

    links = stored(left.groupBy("v", "part").cogroup(right.groupBy("v", "part")).applyInArrow(compare, "u long, v long"), "near-links")
    forget(nodes, texts, sizes)
    return links


def _agreeing(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs whose signatures agree in enough minima."""
    left, right = (sketches.select(F.col("node").alias(x), F.col("sketch").alias(f"sketch_{x}")) for x in "uv")

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("sketch_u", "sketch_v"))
            yield batch.select(["u", "v"]).filter(pa.array((a == b).sum(axis=1) >= LEAST_AGREEMENT * HASHES))

    return pairs.join(right, "v").join(left, "u").select("u", "v", "sketch_u", "sketch_v").mapInArrow(agree, "u long, v long")


def _forest(parts: np.ndarray, a: np.ndarray, b: np.ndarray, linked: Callable[[int, int], bool] = lambda x, y: True) -> list[int]:
    """Indices of the pairs of rows (a[i], b[i]), taken in order, that are linked and join parts not joined before."""
    root = {int(p): int(p) for p in np.unique(parts)}

    def find(p: int) -> int:
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        return p

    kept = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        p, q = find(int(parts[x])), find(int(parts[y]))
        if p != q and linked(x, y):
            root[p] = q
            kept.append(i)
    return kept


def _agreeing_pairs(sketch: np.ndarray, parts: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (one of left, one of right) of different parts whose signatures agree in enough minima."""
    found = []
    for at in range(0, len(left), 32):
        some = left[at : at + 32]
        hit = (sketch[some][:, None] == sketch[right][None]).view(np.uint8).sum(axis=2, dtype=np.uint8) >= LEAST_AGREEMENT * HASHES
        hit &= parts[some][:, None] != parts[right][None]
        x, y = np.nonzero(hit)
        found.append(np.stack([some[x], right[y]]))
    return tuple(np.concatenate(found, axis=1)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


def _families(open_rows: DataFrame) -> DataFrame:
    """Edges (u, v) between components that may be linked, from rows (key, node, component, main, sketch, n_main, n_rest).

    main marks rows of the first document's component, or whose signatures agree with the first one's: they are
    one family already. The others are dealt to chunks of about TILE rows, which meet the chunks of main and
    each other; a task holds one such tile, and returns no more edges than join its components.
    """
    chunks = lambda n: F.greatest(F.ceil(F.col(n) / TILE), F.lit(1)).cast("int")
    chunk = lambda n: F.pmod(F.xxhash64("node", F.lit(6)), chunks(n)).cast("int")
    tile = lambda m, i, j: F.struct(F.lit(m).alias("with_main"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    of_rest, of_main = (F.sequence(F.lit(0), chunks(n) - 1) for n in ("n_rest", "n_main"))
    own_main, own_rest = chunk("n_main"), chunk("n_rest")
    places = F.when(F.col("main"), F.transform(of_rest, lambda j: tile(True, own_main, j))).otherwise(
        F.concat(F.transform(of_main, lambda i: tile(True, i, own_rest)), F.transform(of_rest, lambda j: tile(False, F.least(own_rest, j), F.greatest(own_rest, j))))
    )
    placed = open_rows.withColumn("tile", F.explode(places)).select("key", "tile.*", "component", "main", "sketch")

    def compare(group: pa.Table) -> pa.Table:
        parts, main = (group.column(c).to_numpy() for c in ("component", "main"))
        sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(-1, HASHES)
        rest = np.flatnonzero(~main)
        a, b = _agreeing_pairs(sketch, parts, rest, np.flatnonzero(main) if group.column("with_main")[0].as_py() else rest)
        kept = _forest(parts, a, b)
        return pa.table({"u": parts[a[kept]].astype(np.int64), "v": parts[b[kept]].astype(np.int64)})

    tile_of = ("key", "with_main", "i", "j")  # tiles take time by their rows, not bytes: a fixed number of tasks
    return placed.repartition(partitions(placed.sparkSession), *tile_of).groupBy(*tile_of).applyInArrow(compare, "u long, v long")


def _links_within(rows: DataFrame, shingle: int, least: int) -> DataFrame:
    """Links (u, v) between the components of each family, from rows (family, node, component, sketch, text).

    All documents of a family meet in tiles, signatures first, then whole sets; a task holds the two
    chunks of a tile, about TILE rows or TILE_BYTES each, and returns no more links than join its components.
    """
    sizes = rows.groupBy("family").agg(F.greatest(F.ceil(F.count(F.lit(1)) / TILE), F.ceil(F.sum(F.octet_length("text")) / TILE_BYTES), F.lit(1)).cast("int").alias("n"))
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("n")).cast("int")
    places = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    placed = rows.join(sizes, "family").withColumn("chunk", own).withColumn("tile", F.explode(places)).select("family", "tile.*", "chunk", "node", "component", "sketch", "text")

    def compare(group: pa.Table) -> pa.Table:
        ids, parts, chunk = (group.column(c).to_numpy() for c in ("node", "component", "chunk"))
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(-1, HASHES)
        a, b = _agreeing_pairs(sketch, parts, np.flatnonzero(chunk == i), np.flatnonzero(chunk == j))
        agreement = [np.empty(0, np.int64), *((sketch[a[at : at + 50_000]] == sketch[b[at : at + 50_000]]).sum(axis=1) for at in range(0, len(a), 50_000))]
        order = np.argsort(-np.concatenate(agreement), kind="stable")
        used = np.unique(np.concatenate([a, b])).astype(np.int64)
        hashes = shingle_sets(pa.concat_arrays(group.column("text").chunks).take(pa.array(used)), shingle) if len(used) else []
        sets = {row: set(values.tolist()) for row, values in zip(used.tolist(), hashes, strict=True)}

        def linked(x: int, y: int) -> bool:
            common = len(sets[x] & sets[y])
            return 100 * common >= least * (len(sets[x]) + len(sets[y]) - common)

        kept = order[_forest(parts, a[order], b[order], linked)]
        return pa.table({"u": ids[a[kept]].astype(np.int64), "v": ids[b[kept]].astype(np.int64)})

    return placed.repartition(partitions(placed.sparkSession), "family", "i", "j").groupBy("family", "i", "j").applyInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id, n_shingles, component_id, kept: a row per input row.

    component_id is the smallest id that links reach, kept tells whether it is the row's own. Ids are of any
    type that has an order. Null and empty texts have no shingles and no links. Rows without an id are kept, with a null
    component. Rows that share an id are linked by their own texts, each for itself. Other columns are ignored.
    """
    return families(docs, shingle, least, id_col, text_col).drop("place")


def families(docs: DataFrame, shingle: int = SHINGLE, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """near_duplicates() with place_of() the row's text, which tells rows of one id apart."""
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    signed = stored(signatures(rows, shingle), "near-signatures")
    # A node is a class of equal sets. Its number is stored, so it is the same wherever it is read.
    classes = signed.where((F.col("n_shingles") > 0) & F.col("id").isNotNull()).groupBy(*SET).agg(F.min("id").alias("id"), F.min_by("place", "id").alias("place"), F.count(F.lit(1)).alias("copies"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")
    first = signed.join(classes, [*SET, "id", "place"]).select("node", "id", "place", "n_bytes", "bands", "sketch")
    first = stored(first.dropDuplicates(["node"]), "near-first")
    wide, signed = signed, stored(signed.select("id", "place", *SET), "near-sets")
    forget(wide)
    members = first.select("node", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    n_members = BANDS * first.count()
    buckets = stored(split_join(members, shared, ["key"], "n", n_members).select("key", F.col("node").alias("u"), "v", "n"), "near-buckets")
    sketches = first.select("node", "sketch")
    pairs = buckets.where(F.col("u") != F.col("v")).select("u", "v").distinct()
    agreeing = stored(_agreeing(pairs, sketches), "near-agreeing")
    links = confirmed(agreeing, first, rows, shingle, least)
    labels = connected_components(links)

    # Buckets of several components: their pairs beyond those with the first document.
    label = labels.select(F.col("node").alias("u"), "component")
    known = buckets.where(F.col("n") > 2).join(label, "u", "left").withColumn("component", F.coalesce("component", "u"))
    known = known.join(labels.select(F.col("node").alias("v"), F.col("component").alias("of_first")), "v", "left").withColumn("of_first", F.coalesce("of_first", "v"))
    known = known.join(agreeing.withColumn("near", F.lit(True)), ["u", "v"], "left")
    main = (F.col("component") == F.col("of_first")) | F.coalesce("near", F.lit(False))
    known = stored(known.select("key", F.col("u").alias("node"), "component", "of_first", main.alias("main")), "near-known")
    several = known.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("main").alias("n_main"), F.count_if(~F.col("main")).alias("n_rest")).where((F.col("n_rest") > 0) & (F.col("n_main") + F.col("n_rest") > 2))
    open_rows = split_join(known, several, ["key"], "n", n_members).join(sketches, "node")
    by_first = known.where(F.col("main") & (F.col("component") != F.col("of_first"))).select(F.col("component").alias("u"), F.col("of_first").alias("v"))
    edges = stored(by_first.union(_families(open_rows)).distinct(), "near-families")
    if edges.limit(1).count():
        groups = connected_components(edges).select(F.col("node").alias("component"), F.col("component").alias("family"))
        relatives = stored(known.select("node", "component").distinct().join(groups, "component").join(first.select("node", "id", "place", "sketch"), "node"), "near-relatives")
        texts = _texts(rows, relatives.select("node", "id", "place").distinct())
        with_text = stored(relatives.select("node", "component", "family", "sketch").join(texts, "node"), "near-relatives")
        more = stored(_links_within(with_text, shingle, least), "near-links")
        forget(with_text, relatives)
        labels = connected_components(more.union(labels))

    placed = classes.select("node", *SET, "id", "copies").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least_id = placed.groupBy("component").agg(F.min("id").alias("component_id"))
    whole = stored(placed.join(least_id, "component").select(*SET, "component_id", "copies"), "near-components")
    forget(buckets, agreeing, known, edges, first)
    linked = (F.col("n_shingles") > 0) & F.col("id").isNotNull()
    out = split_join(signed.where(linked).select("id", "place", *SET), whole, list(SET), "copies", signed.count())
    out = out.select("id", "place", "n_shingles", "component_id").union(signed.where(~linked).select("id", "place", "n_shingles", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "place", "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def first_rows(docs: DataFrame, columns: tuple[str, ...], shingle: int = SHINGLE, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of the rows that stay: of each group those with its smallest id, and all without an id."""
    found = families(docs, shingle, least, id_col, text_col)
    gone = stored(found.where(~F.col("kept")).select(F.col(id_col).alias("_gone"), F.col("place").alias("_place")).distinct(), "near-gone")
    few = gone.count() <= MOST_BROADCAST_IDS
    mine = docs.select(*columns)
    same = (F.col(id_col) == F.col("_gone")) & (place_of(text_or_empty(text_col)) == F.col("_place"))
    return mine.join(F.broadcast(gone) if few else gone, same, "left_anti")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


SQL = {
    "op6_minhash": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(words) > 1 THEN list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) ELSE words END AS shingles FROM w),
        e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
        p AS (SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
              GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (min(a.n) + min(b.n) - count(*))),
        l AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
        r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.v FROM r JOIN l ON r.reached = l.u)
        SELECT s.doc_id, len(s.shingles)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
        FROM s JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)"""
}
QUERIES = {"op6_minhash": op6_minhash}

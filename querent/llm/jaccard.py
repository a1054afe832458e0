"""Exact Jaccard join of documents on word shingles in the Jaccard metric space, as connected components.

Whole documents make poor pivots for a whole corpus: nearly every document is at distance 1 from every pivot, so that
the triangle inequality's windows would copy everything everywhere. The outer pivots are therefore single shingles. In
one global order of shingles a document belongs to the Voronoi region of its first shingle, and the distance bound says
how far its window reaches: a linked pair differs in at most |x| - ceil(t |x|) shingles of x, so both documents are in
a region of one of their first |x| - ceil(t |x|) + 1 shingles. Frequent shingles come last in the order (any order is
exact). Pairs that meet in fewer regions than the bound demands are dropped. What remains falls into closed regions
(components of possible links), which are joined recursively with documents as pivots: after a pivot's distances d are
known, members linked with it share a component, and by the triangle inequality a member x is settled as soon as all
that lies within d(x) + (1 - t) of the pivot belongs to that component. Regions that one task can hold are joined in one
task, larger ones in rounds over the cluster.

Documents of equal sets are one class and are never paired. No words or null text: n_shingles 0, a component of its
own. Fewer words than `width`: the whole sequence is the one shingle. Rows that repeat a doc_id are told apart by their
text (`version`) and linked like any two documents. Rows with null doc_id are linked with equal sets only, and have a
null component without one. Further columns are not looked at; an empty table gives no rows. Shingles are compared by
64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, rolling, sent_if_small, stored, texts_of
from .components import components

WIDTH, NUMERATOR, DENOMINATOR = 4, 85, 100
#: Shingles of about this many texts are frequent: they come last in the order. The count is an estimate, so regions are
#: paired up to SLACK times as many documents.
FREQUENT, SLACK = 16, 4
#: Frequent shingles that are sent to all tasks, the most frequent first; the rest keep their place, which is exact too.
MOST_SENT = 1_000_000
#: Frequencies, which only set the order, are counted over every SHARE-th text.
SHARE = 4
#: A region of more documents or shingles than these is joined in rounds over the cluster.
REGION_DOCS, REGION_SHINGLES = 5_000, 4_000_000
#: Pivots of a round, and their shingles in all.
PIVOTS, PIVOT_SHINGLES = 128, 4_000_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_words = WordHashes(4)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    hashes = _words.of((text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split())
    if not len(hashes):
        return hashes.view(np.int64)
    return np.unique(rolling(hashes, min(width, len(hashes)))).view(np.int64)


def node_of(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes(), 85)).view(np.int64))


def reach(n: int, num: int, den: int) -> int:
    """How many first shingles of a set of n a linked set must meet one of."""
    return n + (-num * n) // den + 1


def first_shingles(found: np.ndarray, frequent: np.ndarray, level: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first shingles of a set in the global order: by level of frequency (0: not frequent), then by hash."""
    n = reach(len(found), num, den)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        late = np.where(frequent[at] == found, level[at], 0)
        if late.any():
            found = found[np.argsort(late, kind="stable")]
    return found[:n]


def sketches(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], width: int, num: int, den: int) -> DataFrame:
    """doc_id, version, node (the class of equal sets), n_shingles and the first shingles of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # MOST_SENT numbers at most

    def make(batches):
        for batch in batches:
            sets = [shingles(t, width) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict(columns(batch, sets))

    def columns(batch, sets):
        return {
            "doc_id": batch.column("doc_id"),
            "version": batch.column("version"),
            "node": pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()),
            "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
            "first": pa.array([first_shingles(s, *shared.value, num, den) if len(s) else [] for s in sets], pa.list_(pa.int64())),
        }

    return docs.withColumn("version", F.xxhash64("text")).mapInArrow(make, "doc_id long, version long, node long, n_shingles long, first array<long>")


def possible_links(met: DataFrame, num: int, den: int, frequent: int) -> DataFrame:
    """Pairs of nodes that meet in enough regions, and stars within regions of frequent shingles."""
    counts = met.groupBy("shingle").agg(F.count(F.lit(1)).alias("docs")).where("docs > 1")
    shared = stored(met.join(counts, "shingle"), "regions")
    paired = SLACK * frequent
    few = shared.where(F.col("docs") <= paired).select("shingle", "node", F.col("n_shingles").alias("n"))
    a, b = few.select("shingle", F.col("node").alias("u"), F.col("n").alias("nu")), few.select("shingle", F.col("node").alias("v"), F.col("n").alias("nv"))
    pairs = a.join(b, "shingle").where(f"u > v and {den} * least(nu, nv) >= {num} * greatest(nu, nv)")
    pairs = pairs.groupBy("u", "v", "nu", "nv").agg(F.count(F.lit(1)).alias("met"))
    overlap = F.expr(f"ceil({num} * (nu + nv) / {num + den}D - 1e-9)")
    needed = overlap - F.greatest(F.expr(f"ceil({num} * nu / {den}D - 1e-9)"), F.expr(f"ceil({num} * nv / {den}D - 1e-9)")) + 1
    pairs = pairs.where(F.col("met") >= needed).select("u", "v")
    many = shared.where(F.col("docs") > paired).select("shingle", "node")
    least = many.groupBy("shingle").agg(F.min("node").alias("v"))
    return pairs.union(many.join(least, "shingle").where("node <> v").select(F.col("node").alias("u"), "v").distinct())


def overlaps(owners: np.ndarray, starts: np.ndarray, stops: np.ndarray, m: int) -> np.ndarray:
    """How many of a pivot's shingles each member has, from the members listed under each of its shingles."""
    sizes = stops - starts
    at = np.repeat(starts - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
    return np.bincount(owners[at], minlength=m)


def join_region(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """For each member of a region the first member of its component."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat, owners = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owners = flat[order], owners[order]
    label, open_ = np.arange(m), np.ones(m, bool)
    bound = 1 - num / den
    while open_.any():
        p = int(np.argmax(open_))
        both = overlaps(owners, np.searchsorted(flat, sets[p], "left"), np.searchsorted(flat, sets[p], "right"), m)
        union = sizes + sizes[p] - both
        linked = (den * both >= num * union) & open_
        joined = np.unique(label[linked])
        label[np.isin(label, joined)] = joined.min()
        distance = 1 - both / union
        outside = open_ & (label != label[p])
        nearest = distance[outside].min() if outside.any() else np.inf
        open_ &= ~(linked & (distance + bound + 1e-9 < nearest))
        open_[p] = False
    return label


def _small_regions(sets: DataFrame, num: int, den: int) -> DataFrame:
    """node and component (the least node) of regions that one task can hold; a task reads its regions one by one."""

    def run(batches):
        region, nodes, held = None, [], []

        def close():
            label = join_region(held, num, den)
            low = np.full(len(nodes), np.iinfo(np.int64).max)
            np.minimum.at(low, label, np.array(nodes))
            return pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.int64()), "component": pa.array(low[label], pa.int64())})

        for batch in batches:
            flat = batch.column("found")
            for k, (r, node) in enumerate(zip(batch.column("region").to_pylist(), batch.column("node").to_pylist(), strict=True)):
                if r != region and nodes:
                    yield close()
                    nodes, held = [], []
                region = r
                nodes.append(node)
                held.append(flat[k].values.to_numpy().copy())
        if nodes:
            yield close()

    return sets.repartition("region").sortWithinPartitions("region", "node").select("region", "node", "found").mapInArrow(run, "node long, component long")


def _round(open_: DataFrame, pivots: list[tuple[int, np.ndarray]], num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Links of one round of pivots, and the nodes that it leaves unsettled."""
    ids = np.array([p for p, _ in pivots], np.int64)
    sizes = np.array([len(s) for _, s in pivots])
    flat, owners = np.concatenate([s for _, s in pivots]), np.repeat(np.arange(len(ids)), sizes)
    order = np.argsort(flat, kind="stable")
    index = open_.sparkSession.sparkContext.broadcast((flat[order], owners[order], sizes))

    def measure(batches):
        for batch in batches:
            keys, of, n = index.value
            rows = []
            for k in range(batch.num_rows):
                x = batch.column("found")[k].values.to_numpy()
                rows.append(overlaps(of, np.searchsorted(keys, x, "left"), np.searchsorted(keys, x, "right"), len(n)))
            yield pa.RecordBatch.from_pydict({"node": batch.column("node"), "n": batch.column("n_shingles"), "both": pa.array([r.tolist() for r in rows], pa.list_(pa.int64()))})

    measured = stored(open_.select("node", "n_shingles", "found").mapInArrow(measure, "node long, n long, both array<long>"), "measured")
    near = measured.select("node", "n", F.posexplode("both").alias("p", "both")).where("both > 0")
    size = F.element_at(F.array(*[F.lit(int(s)) for s in sizes]), F.col("p") + 1)
    near = near.withColumn("union", F.col("n") + size - F.col("both")).withColumn("linked", F.expr(f"{den} * both >= {num} * union"))
    near = near.withColumn("distance", 1 - F.col("both") / F.col("union"))
    # pivots that share a linked member: PIVOTS squared rows at most
    groups = near.where("linked").groupBy("node").agg(F.collect_set("p").alias("ps")).select(F.sort_array("ps").alias("ps"))
    chained = groups.select(F.explode(F.arrays_zip(F.slice("ps", 1, len(ids)).alias("a"), F.expr("slice(ps, 2, size(ps))").alias("b"))).alias("x")).where("x.b is not null").select("x.a", "x.b").distinct()
    label = list(range(len(ids)))
    for r in chained.collect():
        one, two = label[r["a"]], label[r["b"]]
        label = [min(one, two) if x in (one, two) else x for x in label]
    group = F.element_at(F.array(*[F.lit(x) for x in label]), F.col("p") + 1)
    near = near.withColumn("g", group)
    member = near.where("linked").select("node", "g").distinct().withColumn("inside", F.lit(True))
    placed = near.join(member, ["node", "g"], "left")
    nearest = {r["p"]: r["d"] for r in placed.where("inside is null").groupBy("p").agg(F.min("distance").alias("d")).collect()}
    limit = F.element_at(F.array(*[F.lit(float(min(1.0, nearest.get(p, 1.0)))) for p in range(len(ids))]), F.col("p") + 1)
    settled = near.where("linked").where(F.col("distance") + (1 - num / den) + 1e-9 < limit).select("node")
    own = open_.sparkSession.createDataFrame([(int(i),) for i in ids], "node long")
    links = member.select(F.col("node").alias("u"), F.element_at(F.array(*[F.lit(int(i)) for i in ids]), F.col("g") + 1).alias("v"))
    return stored(links, "links"), stored(open_.join(settled.union(own).distinct(), "node", "left_anti"), "open")


def _finer(sets: DataFrame, num: int, den: int, frequent: int) -> DataFrame:
    """node and region of large regions' members, dealt anew by their rarest shingles within these regions."""
    rows = sets.select("node", "n_shingles", F.explode("found").alias("shingle"))
    rows = rows.join(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("docs")), "shingle")
    place = F.row_number().over(Window.partitionBy("node").orderBy("docs", "shingle"))
    first = F.expr(f"n_shingles - cast(ceil({num} * n_shingles / {den}D - 1e-9) as long) + 1")
    met = rows.withColumn("place", place).where(F.col("place") <= first).select("shingle", "node", "n_shingles")
    return components(possible_links(met, num, den, frequent)).toDF("node", "region")


def _large_regions(sets: DataFrame, num: int, den: int) -> DataFrame:
    """node and component of the members of large regions."""
    open_, links = sets.select("node", "n_shingles", "found"), None
    while True:
        chosen = open_.select("node", "n_shingles").orderBy(F.xxhash64("node"), "node").limit(PIVOTS).collect()
        if not chosen:
            break
        total = np.cumsum([r["n_shingles"] for r in chosen])
        ids = [r["node"] for r, t in zip(chosen, total, strict=True) if t <= PIVOT_SHINGLES] or [chosen[0]["node"]]
        pivots = [(r["node"], np.array(r["found"], np.int64)) for r in open_.where(F.col("node").isin(ids)).collect()]
        found, open_ = _round(open_, pivots, num, den)
        links = found if links is None else links.union(found)
    alone = sets.select("node", F.col("node").alias("component"))
    joined = components(links)
    return alone.join(joined.select("node"), "node", "left_anti").union(joined)


def frequent_shingles(docs: DataFrame, width: int, frequent: int, share: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of about `frequent` distinct texts or more, sorted, with their levels (whole powers of two of the count);
    the most frequent where there are too many to send. Levels keep what a few near copies share, however long, apart from
    what all documents share."""

    def make(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"shingle": pa.array(np.concatenate([np.empty(0, np.int64), *(shingles(t, width) for t in batch.column(0).to_pylist())]))})

    part = docs.where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).select("text").distinct() if share > 1 else docs.select("text").distinct()
    seen = part.mapInArrow(make, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("docs"))
    late = seen.where(F.col("docs") >= max(2, frequent // share)).orderBy(F.desc("docs"), "shingle").limit(MOST_SENT)
    rows = np.array(sorted((r["shingle"], int(r["docs"]).bit_length()) for r in late.collect()), np.int64).reshape(-1, 2)
    return rows[:, 0], rows[:, 1].astype(np.int8)


def _too_large(sets: DataFrame, region_docs: int) -> DataFrame:
    sizes = sets.groupBy("region").agg(F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("shingles"))
    return stored(sizes.where((F.col("members") > region_docs) | (F.col("shingles") > REGION_SHINGLES)).select("region"), "large")


def jaccard_components(docs: DataFrame, width: int = WIDTH, num: int = NUMERATOR, den: int = DENOMINATOR, frequent: int = FREQUENT, region_docs: int = REGION_DOCS, share: int = SHARE) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) and version (a hash of the text) of every row."""
    docs = texts_of(docs)
    plain = stored(sketches(docs, frequent_shingles(docs, width, frequent, share), width, num, den), "sketches")
    classes = stored(plain.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep")), "classes")
    # regions hold one row for each class
    one = plain.join(sent_if_small(classes.select("node", F.col("rep").alias("doc_id"))), ["node", "doc_id"], "left_semi")
    met = one.select("doc_id", F.explode("first").alias("shingle"), "node", "n_shingles").drop("doc_id")
    region = components(possible_links(met, num, den, frequent)).toDF("node", "region")
    members = stored(classes.join(region, "node"), "members")
    # one representative text for each class within a region
    wanted = sent_if_small(members.select(F.col("rep").alias("doc_id"), "region", F.col("node").alias("wanted")))
    found = docs.join(wanted, "doc_id").select("doc_id", "text", "region", "wanted")

    def make(batches):
        for batch in batches:
            sets = [shingles(t, width) for t in batch.column("text").to_pylist()]
            nodes = [node_of(s) if len(s) else None for s in sets]
            keep = [k for k, (a, b) in enumerate(zip(nodes, batch.column("wanted").to_pylist(), strict=True)) if a == b]
            yield pa.RecordBatch.from_pydict({
                "node": pa.array([nodes[k] for k in keep], pa.int64()),
                "region": batch.column("region").take(pa.array(keep, pa.int64())),
                "n_shingles": pa.array([len(sets[k]) for k in keep], pa.int64()),
                "found": pa.array([sets[k] for k in keep], pa.list_(pa.int64())),
            })

    sets = stored(found.mapInArrow(make, "node long, region long, n_shingles long, found array<long>").dropDuplicates(["node"]), "sets")
    joined = _small_regions(sets.join(large := _too_large(sets, region_docs), "region", "left_anti"), num, den)
    if large.take(1):
        rest = stored(sets.join(large, "region", "left_semi"), "rest")
        again = stored(rest.drop("region").join(_finer(rest, num, den, frequent), "node"), "again")
        joined = joined.union(_small_regions(again.join(large := _too_large(again, region_docs), "region", "left_anti"), num, den))
        if large.take(1):
            joined = joined.union(_large_regions(stored(again.join(large, "region", "left_semi"), "largest"), num, den))
    # a component's smallest doc_id
    whole = stored(members.select("node", "rep").join(joined, "node"), "joined")
    least = sent_if_small(stored(whole.groupBy("component").agg(F.min("rep").alias("least")), "least"))
    linked = stored(whole.join(least, "component").select("node", "least"), "linked")
    out = plain.select("doc_id", "n_shingles", "node", "version").join(linked, "node", "left")
    out = out.join(classes, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("least", "rep", "doc_id").alias("component_id"), "version")


def one_of_each(docs: DataFrame, width: int = WIDTH, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """The rows of docs without the copies: of each group of linked documents that of the smallest doc_id stays. Rows of
    equal doc_id and text are copies too; the least of them in all columns' hash stays. Null doc_ids match like any other."""
    linked = jaccard_components(docs, width, num, den)
    goes = stored(linked.where("not (doc_id <=> component_id) and component_id is not null").select(F.col("doc_id").alias("_id"), F.col("version").alias("_version")).distinct(), "copies")
    key = [F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_version")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *key)
    same = lambda a, b: F.col(f"{a}._id").eqNullSafe(F.col(f"{b}._id")) & (F.col(f"{a}._version") == F.col(f"{b}._version"))
    kept = rows.alias("r").join(sent_if_small(goes).alias("g"), same("r", "g"), "left_anti")
    often = stored(docs.select(*key).groupBy("_id", "_version").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "repeated")
    if often.isEmpty():
        return kept.select("row.*")
    often = sent_if_small(often)
    once = kept.alias("r").join(often.alias("g"), same("r", "g"), "left_anti").select("row")
    again = kept.alias("r").join(often.alias("g"), same("r", "g"), "left_semi")
    # aggregated map-side, so rows that are repeated very often are not gathered
    again = again.groupBy("_id", "_version").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return once.union(again).select("row.*")

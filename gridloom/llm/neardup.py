"""MinHash near-dedup with bottom-k sketches (operator 6).

A document's set is its distinct ``width``-word shingles (A-Z lower-cased), as 64-bit hashes. One hash
function, the shingle hash itself, gives the sketch: the ``KEPT`` least values.

1. Inverted lists. Documents whose sets are at least 80 % alike share at least ``overlap(n)`` retained values:
   for sets that fit into their sketches this is arithmetic, for larger ones it fails with a probability
   below 1e-11 a pair. So if every document orders its retained values by (documents that hold them, value),
   two such documents share one of the first ``retained - overlap + 1``: only these enter the lists, rare values
   first, and values of a single document not at all. Long lists of boilerplate are left to texts that hold
   little else.
2. Documents with equal sets become one class, of which the smallest id stands in the lists.
3. Pairs. In each list the smallest member is tested with all others; linked documents become components.
   Where lists still hold several components, the full sets of their members are joined on exact prefixes
   (``exact_prefixes``, sure to hold a common member of any two that link) between different components, in
   rounds of bounded size. Members of one component need no more tests.
4. Tests. The estimate from the union sketch (its k least values, those in both) drops pairs below
   ``ESTIMATE``; the others are confirmed on their full sets, made again from the texts of just these documents.

Defined results: a null or blank text has an empty set, links with nothing and is kept; with fewer than
``width`` words the whole sequence is the one shingle; rows with one doc_id are one document, linked if any of
its texts is; a null doc_id gets a null component and is kept. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import cut, drop_cut, mix, rolling, text_slices, word_hashes

WIDTH = 5
KEPT = 96
#: Retained values that two similar documents share at least, where a set may be larger than its sketch.
SHARED = 44
ESTIMATE = 0.5
#: Ids that are broadcast at most (16 MB); more go through a shuffle join.
SMALL_IDS = 1_000_000
#: Pairs that a round of the exact join looks at, at most about.
ROUND_PAIRS = 200_000_000
#: Texts whose sets a worker holds at a time.
ROWS = 1_000
#: Rows with one set from which that set is joined apart from the others, and how many such sets are broadcast at most (4 MB).
HOT, HOT_SETS = 2_000, 100_000


def _parts(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def shingle_sets(column: pa.Array, width: int):
    """Sorted distinct shingle hashes (int64) of each text."""
    for _, data, offsets in text_slices(column):
        h, first = word_hashes(data, offsets, lower=True)
        grams = mix(rolling(h, width)).view(np.int64)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= width:
                yield np.unique(grams[a : b - width + 1])
            elif b > a:
                yield mix(rolling(h[a:b], b - a) + np.uint64(b - a)).view(np.int64)
            else:
                yield np.empty(0, dtype=np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def sketches(docs: DataFrame, text: str = "text", width: int = WIDTH, kept: int = KEPT) -> DataFrame:
    """doc_id, n (size of the set), two sums that identify the set, and the sketch."""

    def run(batches):
        for batch in _parts(batches):
            sets = list(shingle_sets(batch.column(1), width))
            u = [s.view(np.uint64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.array([mix(x ^ np.uint64(1)).sum(dtype=np.uint64) for x in u], dtype=np.uint64).view(np.int64)),
                    pa.array(np.array([mix(x ^ np.uint64(2)).sum(dtype=np.uint64) for x in u], dtype=np.uint64).view(np.int64)),
                    _lists([s[:kept] for s in sets]),
                ],
                names=["doc_id", "n", "k1", "k2", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(run, "doc_id long, n long, k1 long, k2 long, sketch array<long>")


def full_sets(docs: DataFrame, text: str = "text", width: int = WIDTH) -> DataFrame:
    def run(batches):
        for batch in _parts(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(list(shingle_sets(batch.column(1), width)))], names=["doc_id", "members"])

    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(run, "doc_id long, members array<long>")


def overlap(n: Column, kept: int = KEPT, shared: int = SHARED) -> Column:
    """Retained values that a document with a set of ``n`` shares with any document it links with."""
    return F.when(n * 5 <= kept * 4, F.ceil(n * 4 / 5)).otherwise(F.lit(shared)).cast("long")


def inverted_lists(base: DataFrame, kept: int = KEPT, shared: int = SHARED) -> DataFrame:
    """(v, doc_id, n): the retained values of each document that may give it a partner."""
    rows = base.filter("n > 0 AND doc_id IS NOT NULL").select("doc_id", "n", F.explode("sketch").alias("v"))
    common = rows.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
    held = rows.join(common, "v").groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("held"))  # KEPT values a row
    retained = F.least(F.col("n"), F.lit(kept))
    alone = retained - F.size("held")
    enter = F.greatest(retained - overlap(F.col("n"), kept, shared) + 1 - alone, F.lit(0))
    return held.select("doc_id", "n", F.explode(F.slice("held", F.lit(1), enter.cast("int"))).alias("h")).select(F.col("h.v").alias("v"), "doc_id", "n")


def _narrowed(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``table`` whose doc_id is in ``ids``: by broadcast where the ids are few, else by a shuffle join."""
    few = ids.limit(SMALL_IDS + 1).count() <= SMALL_IDS
    return table.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def _with_side(pairs: DataFrame, table: DataFrame, side: str, column: str) -> DataFrame:
    t = table.select(F.col("doc_id").alias(side), F.col(column).alias(f"{column}_{side}"))
    return pairs.join(t, side)


def confirmed(pairs: DataFrame, base: DataFrame, docs: DataFrame, text: str, width: int, kept: int, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` that link: estimated on the union sketch, then confirmed on full sets."""
    ids = lambda p: p.select(F.col("a").alias("doc_id")).union(p.select("b")).distinct()
    sk = _narrowed(base.select("doc_id", "sketch"), ids(pairs))
    both = _with_side(_with_side(pairs, sk, "a", "sketch"), sk, "b", "sketch")
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, kept)
    agreed = F.size(F.array_intersect(union, F.array_intersect("sketch_a", "sketch_b")))
    likely = cut(both.filter(agreed >= ESTIMATE * F.size(union)).select("a", "b"), "likely")
    sets = full_sets(_narrowed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text), ids(likely)), text, width)
    return linked(likely, sets, percent)


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` whose full sets are similar."""
    both = _with_side(_with_side(pairs, sets, "a", "members"), sets, "b", "members")
    inter = F.size(F.array_intersect("members_a", "members_b"))
    return both.filter(100 * inter >= percent * (F.size("members_a") + F.size("members_b") - inter)).select("a", "b").distinct()


def exact_prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(v, id, n, left, short): the rarest members of each full set, without those that no other set holds.

    ``left`` members of the set, v included, come from v on in the order of rarity: from its first common member on
    a pair has no more in common than either has left, which ends most pairs that share common members only.
    Of two linked sets the larger holds their rarest common member among its first n - ceil(t n) + 1, the
    smaller among its first n - ceil(2 t / (1 + t) n) + 1, the ``short`` ones: its overlap is at least that.
    """
    rows = sets.select(F.col("doc_id").alias("id"), F.size("members").cast("long").alias("n"), F.explode("members").alias("v"))
    common = rows.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
    held = rows.join(common, "v").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("held"))  # one document's set a row
    alone = F.col("n") - F.size("held")
    first = lambda need: (F.col("n") - F.ceil(need) + 1 - alone).cast("int")
    enter = held.select("id", "n", first(F.col("n") * (2 * percent) / (100 + percent)).alias("short"), F.slice("held", F.lit(1), F.greatest(first(F.col("n") * percent / 100), F.lit(0))).alias("first"), F.size("held").alias("held"))
    return enter.select("id", "n", "short", "held", F.posexplode("first").alias("at", "h")).select(F.col("h.v").alias("v"), "id", "n", (F.col("held") - F.col("at")).cast("long").alias("left"), (F.col("at") < F.col("short")).alias("short"))


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, comp): the least id that each end of an edge reaches. Least labels spread along the edges and
    jump to the label's own label; ``known`` labels of an earlier call count as edges."""
    if known is not None:
        edges = edges.unionByName(known.filter("doc_id != comp").select(F.col("doc_id").alias("a"), F.col("comp").alias("b")))
    both = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("doc_id"), F.least("a", "m").alias("comp")), "label")
    while True:
        near = both.join(label.select(F.col("doc_id").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        spread = label.join(near, label["doc_id"] == near["a"]).select("doc_id", F.col("comp").alias("was"), F.least("comp", "m").alias("comp"))
        own = label.select(F.col("doc_id").alias("at"), F.col("comp").alias("further"))
        new = cut(spread.join(own, spread["comp"] == own["at"], "left").select("doc_id", "was", F.least("comp", "further").alias("comp")), "label")
        changed = new.filter("comp != was").limit(1).count()
        drop_cut(label)
        path = new._cut_path
        label = new.select("doc_id", "comp")
        label._cut_path = path
        if not changed:
            drop_cut(both)
            return label


def with_classes(light: DataFrame) -> DataFrame:
    """(doc_id, n, rep): rep is the least doc_id with an equal set. Sets of very many rows meet their class without a shuffle."""
    keys = ["n", "k1", "k2"]
    copies = light.filter("n > 0 AND doc_id IS NOT NULL").groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.count("*").alias("size")).filter("rep < last").drop("last")
    copies = cut(copies, "copies")
    least = max(HOT, light.count() // HOT_SETS)  # no more than HOT_SETS sets can have so many rows each
    hot = copies.filter(F.col("size") >= least).select(*keys, F.col("rep").alias("hot"))
    marked = light.join(F.broadcast(hot), keys, "left")
    cold = marked.filter("hot IS NULL").join(copies.filter(F.col("size") < least).select(*keys, "rep"), keys, "left").select("doc_id", "n", "rep")
    both = cold.unionByName(marked.filter("hot IS NOT NULL").select("doc_id", "n", F.col("hot").alias("rep")))
    return both.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep"))


def near_duplicates(docs: DataFrame, text: str = "text", width: int = WIDTH, percent: int = 80, kept: int = KEPT, shared: int = SHARED, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable), kept (doc_id is the component's).

    ``exact`` puts the full sets of all classes through the exact join, for those who cannot accept the small chance that
    the sketches of two large sets hide a link; it costs a row a shingle instead of one a retained value.
    """
    base = cut(sketches(docs, text, width, kept), "sketches")
    classes = cut(with_classes(base.select("doc_id", "n", "k1", "k2")), "classes")
    listed = inverted_lists(base, kept, shared)
    stand_in = classes.filter("doc_id != rep").select("doc_id", "rep").distinct()
    lists = listed.join(stand_in, "doc_id", "left").select("v", F.coalesce("rep", "doc_id").alias("id"), "n").distinct()
    lists = cut(lists, "lists")

    def alike(x: str, y: str) -> Column:
        return (100 * F.least(x, y) >= percent * F.greatest(x, y)) & (F.least(x, y) > 0)

    leader = lists.groupBy("v").agg(F.min(F.struct("id", "n")).alias("lead"), F.count("*").alias("size")).filter("size > 1")
    stars = lists.join(leader, "v").filter((F.col("id") != F.col("lead.id")) & alike("n", "lead.n")).select(F.col("lead.id").alias("a"), F.col("id").alias("b")).distinct()
    tested = cut(stars, "stars")
    label = components(confirmed(tested, base, docs, text, width, kept, percent))

    owned = lists.join(label, lists["id"] == label["doc_id"], "left").select("v", "id", F.coalesce("comp", "id").alias("comp"))
    open_lists = owned.groupBy("v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("v")
    still = classes.filter("doc_id = rep AND n > 0").select("doc_id") if exact else lists.join(open_lists, "v", "left_semi").select(F.col("id").alias("doc_id"))
    left = cut(still.distinct(), "left")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
    sets = cut(full_sets(_narrowed(texts, left), text, width), "sets")
    entries = cut(exact_prefixes(sets, percent), "entries")
    total = entries.groupBy("v").agg((F.sum(F.col("short").cast("long")) * F.count("*")).alias("most")).agg(F.sum("most")).first()[0] or 0
    rounds = -(-total // ROUND_PAIRS)
    for turn in range(rounds):
        owner = label.select(F.col("doc_id").alias("o"), "comp")
        e = entries.join(owner, entries["id"] == owner["o"], "left").select("v", "id", "n", "left", "short", F.coalesce("comp", "id").alias("comp"))
        x = e.filter(F.col("short") & (F.pmod(F.xxhash64("id"), F.lit(rounds)) == turn)).select("v", F.col("id").alias("x"), F.col("n").alias("xn"), F.col("left").alias("xl"), F.col("comp").alias("xc"))
        y = e.select("v", F.col("id").alias("y"), F.col("n").alias("yn"), F.col("left").alias("yl"), F.col("comp").alias("yc"))
        enough = F.least("xl", "yl") * (100 + percent) >= percent * (F.col("xn") + F.col("yn"))
        larger = (F.col("yn") > F.col("xn")) | ((F.col("yn") == F.col("xn")) & (F.col("y") > F.col("x")))
        pairs = x.join(y, "v").filter((F.col("xc") != F.col("yc")) & larger & alike("xn", "yn") & enough)
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        links = cut(linked(pairs, sets, percent), "links")
        if links.limit(1).count():
            label = components(links, label)
        drop_cut(links)
    drop_cut(base, lists, tested, left, sets, entries)
    out = classes.join(label.select(F.col("doc_id").alias("rep"), "comp"), "rep", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "rep").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, text: str = "text", width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` without the documents that are near duplicates of a smaller doc_id."""
    gone = near_duplicates(docs, text, width).filter(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")

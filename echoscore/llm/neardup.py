"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set holds the hashes of its distinct word shingles (fewer words than a shingle: the whole sequence; no words:
empty, linked with nothing). Two documents are linked when 100 * intersection >= percent * union.

1. Equal sets become one class. Its sketch holds the k smallest hashes, of sets of up to ``WHOLE`` hashes all.
2. Inverted lists of sketch values, one scheme for pairs of whole sets and one for pairs with a larger set. A linked pair has
   few values that are not common, so the rarest common one stands near the front of both, by rarity: only that
   front enters lists, and values of a single class never do. Passages that many documents share are frequent and come
   last, so they enter for classes that consist of little else.
3. A pair in a list is a candidate if the value's places allow a link of sets of these two sizes (``_within``). In every list all
   classes meet the foremost one. Classes of lists that the links found so far do not connect meet again in lists of their whole sets'
   rarest values, whose places are exact bounds for any size: there pairs that are not connected yet are compared. So a group of n near copies
   costs about n comparisons, and one of n documents with a large shared part below the threshold no more.
4. A pair is dropped if its union sketch shows fewer than ``need`` common values, else its full sets are compared.

For pairs of whole sets the places are bounds, so none is lost. With a larger set, the values that are not common
follow a binomial distribution, whose mean plus ``SIGMAS`` standard deviations is allowed: a pair exactly at the threshold is missed
with a probability below 2e-4, the sum of the binomial tails of both sketches and the union sketch, one above it with less. Links are never made without comparing the full
sets. Components come from ``components``, nothing is collected.

NULL and empty texts form their own component. Rows that repeat a document are one class. Rows whose id is NULL take
part, but never give a component its id. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from echoscore.llm.components import components
from echoscore.llm.words import combine, mix, pieces, signed, word_hashes
from echoscore.sources.stage import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH = 5
PERCENT = 85
SKETCH = 96
WHOLE = 200
SIGMAS = 4.5


def need(sketch: int = SKETCH, percent: int = PERCENT, sigmas: float = SIGMAS) -> int:
    """Common values that the union sketch of a pair at the threshold has but for a small chance."""
    p = percent / 100
    return max(1, int(sketch * p - sigmas * (sketch * p * (1 - p)) ** 0.5))


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    words, first = word_hashes(texts)
    if not len(words):
        return [np.zeros(0, np.int64)] * len(texts)
    rolling = mix(words[: max(0, len(words) - width + 1)])
    for k in range(1, width):
        rolling = combine(rolling, words[k : k + len(rolling)])
    rolling = signed(rolling)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(rolling[a : b - width + 1]))
        elif b > a:
            h = mix(words[a : a + 1] ^ np.uint64(b - a))
            for k in range(a + 1, b):
                h = combine(h, words[k : k + 1])
            out.append(signed(h))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def set_key(values: np.ndarray) -> int | None:
    """One long for a whole set."""
    if not len(values):
        return None
    with np.errstate(over="ignore"):
        bits = mix(values.view(np.uint64))
        total = np.array([bits.sum(), np.bitwise_xor.reduce(mix(bits))], np.uint64)
        return int(signed(combine(total[:1], total[1:] ^ np.uint64(len(values))))[0])


def _profiles(docs: DataFrame, width: int, sketch: int, full: bool) -> DataFrame:
    """(id, text_hash, n, node, sketch): with ``full`` the sketch is the whole set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            sets = shingle_sets(batch.column("text"), width)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.int64()),
                    pa.array([s if full or len(s) <= WHOLE else s[:sketch] for s in sets], pa.list_(pa.int64())),
                ],
                ["id", "text_hash", "n", "node", "sketch"],
            )

    wanted = docs.select("id", "text", F.xxhash64("text").alias("text_hash"))
    return wanted.mapInArrow(run, "id long, text_hash long, n long, node long, sketch array<long>")


def _similar_sizes(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _others(share: Column | float, sketch: int) -> Column:
    """Values of a sketch that are not in the other one, if that is ``share`` of the set, but for a small chance."""
    share = F.lit(share) if isinstance(share, float) else share
    return share * sketch + SIGMAS * F.sqrt(share * (1 - share) * sketch)


def _within(n: Column, other: Column, place: Column, whole: Column, sketch: int, percent: int) -> Column:
    """Whether a pair of sets of sizes ``n`` and ``other`` can be linked if its rarest common value has this place
    (from 0) in the set of size ``n``: everything before it is not common."""
    common = (n + other) * percent / (100.0 + percent)
    exact = place <= n - F.ceil(common - 1e-9)
    # the sketch that ends first decides, which is that of the larger share of other values
    return F.when(whole, exact).otherwise(place <= _others(1 - common / F.greatest(n, other), sketch))


def postings(classes: DataFrame, sketch: int = SKETCH, percent: int = PERCENT) -> DataFrame:
    """(value, whole, place, node, n): the rarest values of each class among those of two classes or more."""
    smallest = WHOLE + 1  # a set that may face a larger one than WHOLE has at least percent of this
    whole = F.when(F.col("n") <= WHOLE, F.struct(F.lit(True).alias("whole"), F.col("sketch").alias("values")))
    cut = F.when(F.col("n") * 100 >= smallest * percent, F.struct(F.lit(False).alias("whole"), F.slice("sketch", 1, sketch).alias("values")))
    schemes = classes.select("node", "n", F.explode(F.filter(F.array(whole, cut), lambda s: s.isNotNull())).alias("s"))
    values = schemes.select("node", "n", "s.whole", F.explode("s.values").alias("value"))
    counts = values.groupBy("whole", "value").agg(F.count("*").alias("df")).where("df > 1")
    own = values.join(counts, ["whole", "value"]).groupBy("node", "n", "whole").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("own"))
    alone = F.when(F.col("whole"), F.col("n")).otherwise(F.lit(sketch)).cast("int") - F.size("own")
    share = 1 - percent / 100
    front = F.when(F.col("whole"), F.floor(F.col("n") * (100 - percent) / 100)).otherwise(F.floor(_others(share, sketch))).cast("int") + 1 - alone
    fronts = own.where(front > 0).select("node", "n", "whole", alone.alias("alone"), F.slice("own", F.lit(1), front)["value"].alias("front"))
    placed = fronts.select("*", F.posexplode("front").alias("at", "value"))
    return placed.select("value", "whole", (F.col("at") + F.col("alone")).alias("place"), "node", "n")


def _full_sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, n, sketch) with the whole sets of the classes ``nodes``, from one text each."""
    wanted = classes.join(nodes, "node", "left_semi").select("node", "source")
    texts = docs.withColumn("source", _source(F.xxhash64("text"))).join(wanted.select("source").distinct(), "source", "left_semi")
    sets = _profiles(texts, width, 0, True).withColumn("source", _source(F.col("text_hash")))
    return sets.join(wanted, ["node", "source"], "left_semi").select("node", "n", "sketch").dropDuplicates(["node"])


def exact_postings(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(value, place, node, n): as ``postings``, over whole sets of any size and rarity among these sets, so that places are bounds."""
    values = sets.select("node", "n", F.explode("sketch").alias("value"))
    counts = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    own = values.join(counts, "value").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("own"))
    alone = F.col("n").cast("int") - F.size("own")
    front = F.floor(F.col("n") * (100 - percent) / 100).cast("int") + 1 - alone
    fronts = own.where(front > 0).select("node", "n", alone.alias("alone"), F.slice("own", F.lit(1), front)["value"].alias("front"))
    placed = fronts.select("node", "n", "alone", F.posexplode("front").alias("at", "value"))
    return placed.select("value", F.lit(True).alias("whole"), (F.col("at") + F.col("alone")).alias("place"), "node", "n")


def _candidates(x: str, y: str, sketch: int, percent: int) -> Column:
    """Whether the rows ``x`` and ``y`` of a list can be linked."""
    n, other, whole = F.col(f"{x}n"), F.col(f"{y}n"), F.col("whole")
    both = [_within(a, b, F.col(f"{s}place"), whole, sketch, percent) for a, b, s in ((n, other, x), (other, n, y))]
    return _similar_sizes(n, other, percent) & both[0] & both[1]


def _source(text_hash: Column) -> Column:
    """Key of a row whose id may be NULL: a struct is never NULL itself. Rows with an id sort first."""
    return F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), text_hash.alias("text_hash"))


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, profiles: DataFrame, width: int, sketch: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ``pairs`` that are links."""
    pairs = staged(pairs, "pairs")
    nodes = lambda p: p.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = classes.join(nodes(pairs), "node", "left_semi").select("node", "source")
    sketches = profiles.join(wanted, ["node", "source"], "left_semi").select("node", "sketch").dropDuplicates(["node"])
    side = lambda t, name, column: t.select(F.col("node").alias(name), F.col("sketch").alias(column))
    both = pairs.join(side(sketches, "a", "sa"), "a").join(side(sketches, "b", "sb"), "b")
    # a cut sketch has ``sketch`` values, so an array of another length is a whole set
    cut = (F.size("sa") == sketch) | (F.size("sb") == sketch)
    first = lambda c: F.when(cut, F.slice(c, 1, sketch)).otherwise(F.col(c))
    both = both.select("a", "b", cut.alias("cut"), first("sa").alias("sa"), first("sb").alias("sb"))
    shared = both.select("*", F.array_intersect("sa", "sb").alias("shared"))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, sketch)
    size = F.size("sa") + F.size("sb") - F.size("shared")
    in_sketch = F.size(F.array_intersect(union, F.col("shared"))) >= need(sketch, percent)
    enough = F.when(F.col("cut") & (size >= sketch), in_sketch).otherwise(F.size("shared") * 100 >= size * percent)
    likely = staged(shared.where(enough).select("a", "b"), "likely")
    sets = _full_sets(docs, classes, nodes(likely), width)
    both = likely.join(side(sets, "a", "sa"), "a").join(side(sets, "b", "sb"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    checked = both.select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb")).alias("total"))
    return checked.where(F.col("common") * 100 >= (F.col("total") - F.col("common")) * percent).select("a", "b")


def _labelled(table: DataFrame, labels: DataFrame) -> DataFrame:
    return table.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, sketch: int = SKETCH, percent: int = PERCENT
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash) for every row of ``docs``. Runs jobs when called."""
    component = F.col("component_id")
    return _grouped(docs, id_col, text_col, width, sketch, percent).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component,
        F.col("id").eqNullSafe(component).alias("kept"), "text_hash",
    )


def _grouped(docs: DataFrame, id_col: str, text_col: str, width: int, sketch: int, percent: int) -> DataFrame:
    """(id, n, text_hash, component_id, first) for every row; ``first`` is the lowest source of the row's component."""
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    profiles = staged(_profiles(docs, width, sketch, False), "profiles")
    known = profiles.where("node is not null").withColumn("source", _source(F.col("text_hash")))
    classes = staged(known.groupBy("node").agg(F.min("id").alias("id"), F.min("source").alias("source")), "classes")
    one_each = known.groupBy("node").agg(F.min("n").alias("n"), F.first("sketch").alias("sketch"))
    lists = staged(postings(one_each, sketch, percent), "lists")

    key = ["value", "whole"]
    # the foremost class has the fewest values of its own, so it is in the middle of a group of near copies
    leaders = lists.groupBy(*key).agg(F.min(F.struct("place", "node", "n")).alias("first"), F.count("*").alias("size")).where("size > 1")
    met = lists.join(leaders, key).where((F.col("node") != F.col("first.node")) & _candidates("", "first.", sketch, percent))
    met = met.select(F.least("first.node", "node").alias("a"), F.greatest("first.node", "node").alias("b")).distinct()
    links = staged(_verified(met, docs, classes, known, width, sketch, percent), "found")
    labels = components(links)

    # Lists whose classes are not all connected yet.
    lists = _labelled(lists, labels)
    open_ = lists.groupBy(*key).agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select(*key)
    # Their whole sets meet by exact places: many documents that share somewhat less than the threshold do not meet, as
    # what each has for itself fills its front.
    waiting = staged(lists.join(open_, key, "left_semi").select("node").distinct(), "open")
    exact = _labelled(exact_postings(_full_sets(docs, classes, waiting, width), percent), labels)
    # a step of this size class is at most the ratio two linked sets can have
    size_class = F.floor(F.log(F.col("n")) / F.log(F.lit(100 / percent))).cast("int")
    exact = staged(exact.withColumn("size_class", size_class), "fronts")
    apart = exact.groupBy(*key).agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select(*key)
    left = exact.join(apart, key, "left_semi")
    facing = F.struct("node", "n", "place", "label", "size_class").alias("y")
    to = left.select(*key, F.explode(F.array(F.col("size_class"), F.col("size_class") + 1)).alias("size_class"), facing)
    more = left.join(to, [*key, "size_class"]).where(
        (F.col("label") != F.col("y.label")) & _candidates("", "y.", sketch, percent)
        & ((F.col("y.size_class") < F.col("size_class")) | (F.col("y.node") < F.col("node")))
    )
    more = more.select(F.least("node", "y.node").alias("a"), F.greatest("node", "y.node").alias("b")).distinct()
    late = staged(_verified(more, docs, classes, known, width, sketch, percent), "found")

    if late.head(1):
        found = links.unionByName(late)
        labels = components(found)
    members = _labelled(classes, labels)
    smallest = members.groupBy("label").agg(F.min("id").alias("component_id"), F.min("source").alias("first"))
    of_node = members.join(smallest, "label").select("node", "component_id", "first")
    out = profiles.select("id", "n", "node", "text_hash").join(of_node, "node", "left")
    alone = F.col("node").isNull()
    return out.select(
        "id", "n", "text_hash", F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, _source(F.col("text_hash"))).otherwise(F.col("first")).alias("first"),
    )


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, sketch: int = SKETCH, percent: int = PERCENT) -> DataFrame:
    """One row of ``docs`` for each component: that of the lowest id, then text hash, and any one of those that repeat both.
    Columns are those of ``docs``. Runs jobs when called."""
    found = _grouped(docs, id_col, text_col, width, sketch, percent)
    gone = found.where(_source(F.col("text_hash")) != F.col("first")).select(F.col("id").alias("doc_id"), "text_hash").distinct()
    row = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("hash"), F.struct("*").alias("row"))
    left = row.join(gone, row["id"].eqNullSafe(gone["doc_id"]) & (row["hash"] == gone["text_hash"]), "left_anti")
    return left.dropDuplicates(["id", "hash"]).select("row.*")

"""Near duplicates from bottom-k sketches of one hash function.

A document's set is its distinct word shingles.  The sketch of a set is its
``SKETCH`` smallest hashes, so two sketches also sketch the union.  Documents
of equal sets form a class and only classes go on.

Candidates come from inverted lists of retained values.  Of two similar sets the
sizes are alike, so lists are of one step of sizes, and a set is in those of its
own step and of the next.  Of two sets with a Jaccard index of at least 0.8, the
few smallest values of each (``PREFIX``) share at least ``SHARED``.  A set of which
fewer values are in any other set is in no list at all, as most sets are.  The
values fall into one class fewer than are shared, so that two shared ones are in
one class, and a list is of a pair of values inside a class: two sets that are not
similar rarely share one, however frequent single values are.

Some lists are joined to a few centres first.  Where components are left apart,
random parts of each list meet in a further round, so that large groups of loosely
linked sets grow together.  At last the members outside a list's main component
are joined to all of the list, which makes the result whole at every size.
Lists of which all members have met in one part are left out of that.  Inside the join, parities pass over most pairs, a few
of them where sets are small; longer parities pass over most others, in the last round inside the join as well where sets
are not small; then the union's sketch estimates the index, and full sets verify what is left.

Sets are held as 63-bit hashes of the shingles' bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from lumenlex.llm.chunks import slices
from lumenlex.llm.spread import joined, repeated, small
from lumenlex.storage import Scratch, materialize

SKETCH = 256
#: Similarity as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
#: Values of which two similar sets share at least SHARED: fewer, with a probability of at most one in a billion.
PREFIX, SHARED = 22, 5
#: Sets of fewer values share one value fewer, and of fewer than LEAST only equal ones are similar.
TINY, LEAST = 6, 4
#: One list in so many has centres that meet all others first.
FIRST_OF = 8
#: Sets of a list up to which it has one centre, and centres of any other.
SMALL, CENTRES = 16, 3
#: Members of a list that meet in a later round.
MEET = 8
#: All pairs left between components are tried once they are at most so many for each list entry; before that, parts of lists
#: meet, which joins most of those that are linked, by rows in proportion to the entries.
PAIRS_AN_ENTRY = 2
#: Rounds before all pairs are tried in any case.
ROUNDS = 2
#: Words of 64 parities that go along in the lists: of the whole set below WHOLE values, of the sketch from there on.
MASK, WHOLE = 16, 1400
#: Words of 64 parities of the whole set that pairs are held against.
SET_MASK = 32
#: Lists of at most this step of sizes, so of sets of at most 413 values, take along so many words only, and in the last round
#: MASK and no longer ones. Of most other sets far more parities differ than the ninth of both sizes that similar sets' can.
NARROW, NARROW_MASK = 26, 4
MASKS = [f"m{i}" for i in range(MASK)]
#: Nodes up to which their parities, or their sketches, are broadcast; a few MB.
FEW_PARITIES, FEW_SKETCHES = 1 << 14, 1 << 11


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``words`` words; of all words, if fewer; none without words."""
    split = text.lower().split()  # ASCII letters and white space only, as the text is bytes
    if not split:
        return np.zeros(0, np.int64)
    grams = [b" ".join(split)] if len(split) < words else list(map(b" ".join, zip(*(split[i:] for i in range(words)), strict=False)))
    hashes = np.fromiter(map(xxh3_64_intdigest, grams), np.uint64, len(grams)) >> np.uint64(1)
    hashes.sort()
    return hashes[np.append(True, hashes[1:] != hashes[:-1])].astype(np.int64)


def needed_overlap(n: int, k: int) -> int:
    """Values that the sketches of a set of ``n`` and of any set similar to it share.

    If any partner is retained whole, this is the bound for whole sets.  Else
    six standard deviations below the mean at an index of 0.8: fewer are shared
    with a probability of about one in a billion.
    """
    if n * DENOMINATOR <= k * NUMERATOR:
        return -(-n * NUMERATOR // DENOMINATOR)
    share, size = NUMERATOR / DENOMINATOR, min(n, k)
    return max(1, int(size * share - 6 * (size * share * (1 - share)) ** 0.5))


def parities(sets: list[np.ndarray], words: int) -> np.ndarray:
    """64 * words bits for each set: whether an odd number of its values falls in each part."""
    bits = np.zeros((len(sets), 64 * words), np.uint8)
    for row, s in zip(bits, sets, strict=True):
        row[:] = np.bincount(s % (64 * words), minlength=64 * words) & 1
    return np.packbits(bits, axis=1).view(np.int64)


def wanted(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def signatures(docs: DataFrame, key: str, text: str, words: int, k: int) -> DataFrame:
    """key, n_shingles, set_id (equal for equal sets), need (see :func:`needed_overlap`), sketch, long parities of the set, and shorter ones of the set or the sketch, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [shingles(x.as_buffer().to_pybytes() if x.is_valid else b"", words) for x in part.column("text").cast(pa.binary())]
                sizes = [len(s) for s in sets]
                masks = parities([s if len(s) < WHOLE else s[:k] for s in sets], MASK)
                parity = parities(sets, SET_MASK)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key"),
                        pa.array(sizes, pa.int64()),
                        pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.array([needed_overlap(n, k) for n in sizes], pa.int32()),
                        pa.array([s[:k] for s in sets], pa.list_(pa.int64())),
                        pa.FixedSizeListArray.from_arrays(pa.array(parity.ravel()), SET_MASK).cast(pa.list_(pa.int64())),
                        *(pa.array(np.ascontiguousarray(masks[:, i])) for i in range(MASK)),
                    ],
                    ["key", "n_shingles", "set_id", "need", "sketch", "parity", *MASKS],
                )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, n_shingles long, set_id binary, need int, sketch array<long>, parity array<long>, " + ", ".join(f"{m} long" for m in MASKS))


def inverted_lists(nodes: DataFrame, tables: Scratch) -> DataFrame:
    """(list, node, lower, size) of the lists of at least two nodes.

    A list is of one step of sizes, and has the sets of the step below as ``lower`` ones: two of these meet in the list
    of their own step.

    Sets of ``TINY`` values or more share ``SHARED`` of their first n / 5 + SHARED values, whatever the values' order,
    and of their first ``PREFIX`` by chance.  Smaller ones that are similar but not equal have four and five values and
    share four, and make lists of all pairs.  All shared values are held by both sets, so a set of fewer held values
    takes no part.
    """
    prefix = F.least(F.lit(PREFIX), F.floor(F.col("n") / DENOMINATOR).cast("int") + SHARED)
    step = _step("n")  # of two similar sets, the steps are at most one apart
    both = nodes.where(F.col("n") >= LEAST).select("node", (F.col("n") < TINY).alias("tiny"), F.slice("head", F.lit(1), prefix).alias("head"), F.posexplode(F.array(step, step + 1)).alias("lower", "bucket"))
    entries = both.select("node", "tiny", "lower", F.explode(F.transform("head", lambda x: F.xxhash64(x, "bucket"))).alias("list"))
    shared = tables.table(_of_lists(entries).select("list"), "shared")
    held = entries.join(shared, "list").groupBy("node", "tiny", "lower").agg(F.array_sort(F.collect_list("list")).alias("held"))
    held = held.where(F.size("held") >= F.when(F.col("tiny"), SHARED - 1).otherwise(SHARED))

    def pairs(x: Column, i: Column) -> Column:
        classes = F.lit(SHARED - 1)  # by pmod, as remainders of either sign would be more classes than shared values fill
        rest = F.filter(F.slice("held", i + 2, F.size("held")), lambda y: F.col("tiny") | (F.pmod(x, classes) == F.pmod(y, classes)))
        return F.transform(rest, lambda y: F.xxhash64(x, y))

    dealt = tables.table(held.select("node", "lower", F.explode(F.flatten(F.transform("held", pairs))).alias("list")), "dealt")
    tables.drop(shared)
    by_list = dealt.repartition("list")  # counted and joined from one shuffle
    out = tables.table(by_list.join(_of_lists(by_list).select("list", "size"), "list"), "lists")
    tables.drop(dealt)
    return out


def _step(size: str) -> Column:
    return F.floor(F.ln(size) / F.ln(F.lit(DENOMINATOR / NUMERATOR)))


def _of_lists(entries: DataFrame) -> DataFrame:
    """Lists in which any two nodes may meet."""
    return entries.groupBy("list").agg(F.count("node").alias("size"), F.min("lower").alias("least")).where("size > 1 AND least = 0")


def full_texts(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str, words: int, tables: Scratch) -> DataFrame:
    """(node, text) of the nodes in any pair."""
    again = not repeated(docs, key).isEmpty()
    of = tables.table(wanted(pairs).join(nodes.select("node", F.col("key").alias("_wanted"), *["set_id"] * again), "node"), "of")
    texts = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("text")).join(small(of), F.col("_key").eqNullSafe(F.col("_wanted")))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Where rows repeat a key with other texts, the node's own text only."""
        for batch in batches:
            for part in slices(batch):
                found = [xxh3_128_digest(shingles((x.as_py() or "").encode(), words).tobytes()) for x in part.column("text")]
                yield part.filter(pa.array([a == b for a, b in zip(found, part.column("set_id").to_pylist(), strict=True)], pa.bool_())).select(["node", "text"])

    if again:
        texts = texts.select("node", "set_id", "text").mapInArrow(own, "node long, text string").dropDuplicates(["node"])
    return tables.table(texts.select("node", "text"), "texts", small_batches=True)


def verified(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: dict[int, np.ndarray] = {}
        for batch in batches:
            good = []
            a_ids, b_ids = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            for i, (a, b) in enumerate(zip(a_ids, b_ids, strict=True)):
                if b not in recent:
                    if len(recent) >= 32:
                        recent.clear()
                    recent[b] = shingles(batch.column("b_text")[i].as_py().encode(), words)
                x, y = shingles(batch.column("a_text")[i].as_py().encode(), words), recent[b]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both * DENOMINATOR >= NUMERATOR * (len(x) + len(y) - both):
                    good.append(i)
            yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    first = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("a_text")), "a")
    both = first.join(texts.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b")
    return both.select("a", "b", "a_text", "b_text").mapInArrow(run, "a long, b long")


def beside(pairs: DataFrame, side: DataFrame) -> DataFrame:
    """Pairs with the columns of ``side`` (node and others) for both of their nodes, prefixed a_ and b_."""
    for x in "ab":
        pairs = pairs.join(side.select(F.col("node").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in side.columns if c != "node")), x)
    return pairs


def _parities_near(prefix: str = "") -> Column:
    """Whether the parities of a set and of another, prefixed b_, differ in no more parts than similar sets' values can: a ninth of both sizes."""
    apart = F.aggregate(F.zip_with(f"{prefix}parity", "b_parity", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    return apart * (NUMERATOR + DENOMINATOR) <= (F.col(f"{prefix}n") + F.col("b_n")) * (DENOMINATOR - NUMERATOR)


def bounded(pairs: DataFrame, rows: DataFrame, tables: Scratch) -> DataFrame:
    """Pairs whose sets' parities are near, see :func:`_parities_near`."""
    of = tables.table(wanted(pairs), "of")
    side = tables.table(rows.select(F.col("uid").alias("node"), F.col("n_shingles").alias("n"), "parity").join(small(of), "node"), "parities")
    out = tables.table(beside(pairs, small(side, FEW_PARITIES)).where(_parities_near("a_")).select("a", "b"), "bounded")
    tables.drop(of, side)
    return out


def estimated(pairs: DataFrame, rows: DataFrame, k: int, tables: Scratch) -> DataFrame:
    """Pairs that share enough of the union's sketch, as :func:`needed_overlap` of the smaller set has it; ``sure`` where the sketches are the sets."""
    of = tables.table(wanted(pairs), "of")
    side = tables.table(rows.select(F.col("uid").alias("node"), F.col("n_shingles").alias("n"), "need", "sketch").join(small(of), "node"), "sketches")
    both = F.array_intersect("a_sketch", "b_sketch")
    common = F.size(F.array_intersect(F.slice(F.array_sort(F.array_union("a_sketch", "b_sketch")), 1, k), both))
    whole = (F.col("a_n") <= k) & (F.col("b_n") <= k)
    exact = F.size(both) * DENOMINATOR >= NUMERATOR * (F.col("a_n") + F.col("b_n") - F.size(both))
    out = tables.table(beside(pairs, small(side, FEW_SKETCHES)).where(F.when(whole, exact).otherwise(common >= F.least("a_need", "b_need"))).select("a", "b", whole.alias("sure")), "close")
    tables.drop(of, side)
    return out


def _figured(entries: DataFrame, figures: DataFrame) -> DataFrame:
    """Entries with the figures of their nodes; see ``NARROW`` for lists of small sets. Words that a row is without compress to nothing."""
    narrow = _step("n") + F.col("lower") <= NARROW
    rows = entries.join(figures, "node")
    none = F.lit(0).cast("long")
    if "parity" in figures.columns:  # which holds all that shorter parities of whole sets do
        rows = rows.withColumns({m: F.when(narrow | (F.col("n") >= WHOLE), F.col(m)).otherwise(none) for m in MASKS})
        return rows.withColumn("parity", F.when(~narrow, F.col("parity")))
    # A set's parities in fewer parts are those of the parts that fall together, added.
    folded = [reduce(lambda x, y: x.bitwiseXOR(y), map(F.col, MASKS[i::NARROW_MASK])) for i in range(NARROW_MASK)]
    return rows.withColumns({m: F.when(narrow, folded[i] if i < NARROW_MASK else none).otherwise(F.col(m)) for i, m in enumerate(MASKS)})


def _close(members: DataFrame, asked: DataFrame | None, figures: DataFrame, k: int) -> DataFrame:
    """Distinct pairs (a > b) of the asked (list, part, node, lower, root) and members of the same, in different components, of similar sizes and parities.

    Without ``asked``, members meet each other from one shuffle, and those that ask are told apart inside the join.
    """
    columns = ["list", "part", "node", "lower", "root", "asks"]
    near = _figured(members.select(*columns), figures)
    if asked is None:
        near = far = near.repartition("list", "part")
        once = (F.col("asks") | F.col("b_asks")) & (F.col("node") > F.col("b_node"))
    else:
        far = _figured(asked.select(*columns), figures)
        once = ~F.col("asks") | (F.col("node") > F.col("b_node"))  # of two that are both asked one asks the other
    far = far.select("list", "part", *(F.col(c).alias(f"b_{c}") for c in ("lower", "root", "asks", *figures.columns)))
    # Parities that differ are at most the values that differ.
    apart = reduce(lambda x, y: x + y, (F.bit_count(F.col(m).bitwiseXOR(F.col(f"b_{m}"))) for m in MASKS))
    of_sets = F.floor((F.col("n") + F.col("b_n")) * (DENOMINATOR - NUMERATOR) / (NUMERATOR + DENOMINATOR))
    of_sketches = F.least("n", F.lit(k)) + F.least("b_n", F.lit(k)) - 2 * F.least("need", "b_need")
    close = apart <= F.when(F.greatest("n", "b_n") < WHOLE, of_sets).when(F.least("n", "b_n") >= WHOLE, of_sketches).otherwise(64 * MASK)
    alike = (F.col("n") * DENOMINATOR >= F.col("b_n") * NUMERATOR) & (F.col("b_n") * DENOMINATOR >= F.col("n") * NUMERATOR)
    both = near.join(far, ["list", "part"]).where((F.col("root") != F.col("b_root")) & once & (F.col("lower") + F.col("b_lower") < 2) & alike & close)
    if "parity" in figures.columns:
        both = both.where(F.col("parity").isNull() | _parities_near())
    return both.select(F.greatest("node", "b_node").alias("a"), F.least("node", "b_node").alias("b")).distinct()


def components(links: DataFrame, labels: DataFrame | None, tables: Scratch) -> DataFrame:
    """(node, root): the smallest node reachable, for every node that has a link in ``links`` or in those that made ``labels``.

    Links are held between roots. Each node goes to its smallest neighbour and on from there, and links are held between where
    their ends have gone, until none is left: each time there are fewer, so that all rounds read few more than the links.
    """
    own = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    if labels is not None:
        links = _moved(links, labels)
        own = labels.unionByName(own.join(small(labels.select("node")), "node", "left_anti"))
    labels, edges = tables.table(own, "labels"), tables.table(_ends(links), "edges")
    while not edges.isEmpty():
        goes = edges.union(edges.select("b", "a")).toDF("node", "to").groupBy("node").agg(F.least("node", F.min("to")).alias("root"))
        goes = tables.table(goes, "goes")
        for _ in range(2):
            further = goes.join(small(goes.select(F.col("node").alias("root"), F.col("root").alias("next"))), "root").select("node", F.col("next").alias("root"))
            further = tables.table(further, "goes")
            tables.drop(goes)
            goes = further
        ahead = small(goes.select(F.col("node").alias("root"), F.col("root").alias("next")))
        after = tables.table(labels.join(ahead, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels")
        fewer = tables.table(_ends(_moved(edges, goes)), "edges")
        tables.drop(labels, edges, goes)
        labels, edges = after, fewer
    tables.drop(edges)
    return labels


def _moved(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Links between the roots of their ends, where these have one."""
    for x in "ab":
        links = links.join(small(labels.select(F.col("node").alias(x), F.col("root").alias("_root"))), x, "left").withColumn(x, F.coalesce("_root", x)).drop("_root")
    return links.select("a", "b")


def _ends(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, key: str = "doc_id", text: str = "text", k: int = SKETCH) -> DataFrame:
    """A row for each document: key, n_shingles, component_id (smallest key reachable by links), kept (key = component_id), set_id.

    Documents with equal non-empty sets are linked; so are those whose sets have
    a Jaccard index of at least 0.8.  A null or empty text, or one of white space
    only, has an empty set and is a component of its own.  A null key is never
    kept, unless the rest of its component has none either.
    """
    with Scratch(docs.sparkSession, "near-dedup") as tables:
        return materialize(_decided(docs, words, key, text, k, tables), "near-duplicates")


def _decided(docs: DataFrame, words: int, key: str, text: str, k: int, tables: Scratch) -> DataFrame:
    rows = tables.table(signatures(docs, key, text, words, k).withColumn("uid", F.monotonically_increasing_id()), "signatures", small_batches=True)
    full = rows.where("n_shingles > 0").withColumn("sketch", F.slice("sketch", 1, PREFIX))
    nodes = full.groupBy("set_id").agg(F.min("uid").alias("node"), F.min("key").alias("key"), F.count(F.lit(1)).alias("rows"), F.first("n_shingles").alias("n"), F.first("sketch").alias("head"))
    nodes = tables.table(nodes, "nodes")
    lists = inverted_lists(nodes, tables)
    listed = tables.table(lists.select("node").distinct(), "listed")
    figures = tables.table(rows.select(F.col("uid").alias("node"), F.col("n_shingles").alias("n"), "need", *MASKS).join(small(listed), "node"), "figures")
    labels: DataFrame | None = None

    for turn in range(ROUNDS + 1):
        one = F.lit(0).cast("long").alias("part")
        final = False
        if not turn:
            # Each node is a component yet. In some of the lists, as similar sets share many, the smallest node of each salt meets all others.
            members = lists.where(F.pmod(F.col("list"), F.lit(FIRST_OF)) == 0).select("list", "node", "lower", "size", F.col("node").alias("root"), F.lit(False).alias("asks"), one)
            salt = F.when(F.col("size") > SMALL, F.pmod(F.xxhash64("node"), F.lit(CENTRES))).otherwise(0).alias("salt")
            asked = members.where("lower = 0").groupBy("list", "part", salt).agg(F.min("node").alias("node"), F.lit(0).alias("lower")).withColumns({"root": F.col("node"), "asks": F.lit(False)})
        else:
            members = lists.join(small(labels), "node", "left").withColumn("root", F.coalesce("root", "node")) if labels else lists.withColumn("root", F.col("node"))
            members = members.select("list", "node", "lower", "root").repartition("list")  # counted and joined from one shuffle
            by_root = members.groupBy("list", "root").agg(F.count("node").alias("c"), F.min("lower").alias("lower"))
            of_list = by_root.groupBy("list").agg(F.sum("c").alias("size"), F.count(F.lit(1)).alias("roots"), F.max(F.struct("c", "root")).alias("main"))
            of_list = tables.table(of_list.where("roots > 1").select("list", F.col("size").alias("all"), F.col("main.c").alias("c"), F.col("main.root").alias("main")), "open")
            left = of_list.agg(F.sum("all").alias("entries"), F.sum((F.col("all") - F.col("c")) * F.col("all")).alias("pairs")).first()
            if not left.entries:
                break
            members = tables.table(members.join(of_list, "list").select("list", "node", "lower", "root", "main", "all"), "members")
            final = left.pairs <= PAIRS_AN_ENTRY * left.entries or turn == ROUNDS
            part = one if final else F.pmod(F.xxhash64("node", "list", F.lit(turn)), F.ceil(F.col("all") / MEET)).alias("part")
            members = members.select("list", "node", "lower", "root", (F.col("root") != F.col("main")).alias("asks"), part)
            asked = members.where("asks") if final else None  # parts are of few members, so those that do not ask may be passed over inside the join
        if final:  # all pairs meet: the long parities go along, so that fewer leave the join
            last = small(tables.table(members.select("node").distinct(), "left"))
            parity = rows.where(_step("n_shingles") >= NARROW).select(F.col("uid").alias("node"), "parity").join(last, "node")
            long = tables.table(figures.join(last, "node").join(parity, "node", "left"), "figures")
            pairs = tables.table(_close(members, asked, long, k), "pairs")
            near = bounded(pairs, rows, tables)
        else:
            pairs = tables.table(_close(members, asked, figures, k), "pairs")
            near = bounded(pairs, rows, tables)
        close = estimated(near, rows, k, tables)
        tables.drop(pairs, near)
        found = close.where("sure").select("a", "b")
        unsure = close.where("NOT sure").select("a", "b")
        if not unsure.isEmpty():
            texts = full_texts(unsure, nodes, docs, key, text, words, tables)
            found = found.unionByName(tables.table(verified(unsure, texts, words), "links", small_batches=True))
            tables.drop(texts)
        if not found.isEmpty():
            labels = components(found, labels, tables)
        if final:
            break
        if turn:  # the others were one part each, in which all pairs met
            lists = lists.where(F.col("size") > MEET)

    placed = nodes.select("set_id", "rows", "key", "node")
    placed = placed.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node")) if labels else placed.withColumn("root", F.col("node"))
    classes = tables.table(placed.select("set_id", "rows", "key", "root"), "classes")
    smallest = classes.groupBy("root").agg(F.min("key").alias("component_id"), F.count(F.lit(1)).alias("sets"))
    smallest = tables.table(smallest, "smallest")
    of_set = tables.table(joined(classes, smallest, ["root"], "sets", classes.count()).select("set_id", "rows", "component_id"), "components")
    # set_id tells apart the texts of a repeated key; rows without a set stay out of the join.
    some = joined(rows.where("n_shingles > 0").select("key", "n_shingles", "set_id"), of_set, ["set_id"], "rows", rows.count())
    none = rows.where("n_shingles = 0").select("key", "n_shingles", "set_id", F.col("key").alias("component_id"))
    out = some.select("key", "n_shingles", "set_id", "component_id").unionByName(none)
    return out.select(F.col("key").alias(key), "n_shingles", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"), "set_id")


def set_ids(text: Column, words: int) -> Column:
    """set_id of each text, as in :func:`near_duplicates`."""

    @F.pandas_udf("binary")
    def of(texts):  # noqa: ANN001, ANN202
        return texts.map(lambda x: xxh3_128_digest(shingles((x or "").encode(), words).tobytes()))

    return of(text.cast("string"))

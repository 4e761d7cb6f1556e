"""Near duplicates by an inverted join over the coordinates of MinHash signatures.

Documents with the same set of word shingles form a class and go on as one node. Every node is posted under
its (coordinate, value) pairs. A pair of nodes counts as a candidate when at least ``needed`` of its
``coordinates`` collide; so it must share one of the ``coordinates - needed + 1`` rarest pairs of either node,
and only these prefixes are posted (frequent pairs are skipped and looked up in the signatures instead).
Candidates are confirmed on the full shingle sets.

A large group of near copies would give pairs in the square of its size. So each posting list first checks its
members against one pivot only, its least node; lists with the same pivot are one group. Members that a confirmed
link has brought into one component need no further test. Groups that still hold several components are cut into
blocks of bounded size. Two blocks at a time are compared in a task, signature against signature, with a longer
signature of ``FINE`` short coordinates as a second sieve; this gives the members that have a candidate in another
component, not the pairs. Those members meet again with their full sets, and one confirmed link for each member and
component leaves the task. ``needed`` is the largest number of collisions that a pair at the threshold misses with
a chance below one in a million.

Defined cases: texts that are null, empty or only white space have an empty set, are linked with nothing and
stay; a text with fewer words than a shingle is one shingle of all its words; equal sets are linked; of a
group the row with the smallest id stays, of rows with equal id and text one; null ids count as larger than
any other, and of a group with null ids only all rows stay; an empty table gives no rows; further columns of the input are not read.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from minekit.llm.common import bounded_batches, cut, fresh, partitions_for, text_of
from minekit.llm.components import components
from minekit.llm.words import ODD_A, ODD_B, hashed_words, mixed

#: Coordinates that are posted, those of the second sieve (a byte each), and the chance to miss a pair in either.
COORDINATES, FINE, MISS = 32, 256, 1e-6
#: Members and shingles of a block on average, and blocks of members in a partition.
BLOCK, BLOCK_SHINGLES, PER_PARTITION = 1024, 1_000_000, 4_000


@functools.cache
def needed_collisions(similarity: float, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The largest t for which a pair of this similarity has fewer than t collisions with a chance of at most ``miss``."""
    chance, t = 0.0, 0
    while t < coordinates:
        chance += math.comb(coordinates, t) * similarity**t * (1 - similarity) ** (coordinates - t)
        if chance > miss:
            break
        t += 1
    return max(t, 1)


def shingle_set(text: str, words_each: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    words = hashed_words(text)
    if not len(words):
        return words
    with np.errstate(over="ignore"):
        if len(words) < words_each:
            total = np.uint64(len(words))
            for word in words:
                total = total * ODD_A + word
            return mixed(np.array([total], dtype=np.uint64))
        total = np.full(len(words) - words_each + 1, words_each, dtype=np.uint64)
        for k in range(words_each):
            total = total * ODD_A + words[k : len(words) - words_each + 1 + k]
        return np.unique(mixed(total))


@functools.cache
def seeds() -> np.ndarray:
    return np.random.default_rng(7).integers(1, 2**63, size=FINE, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The upper 32 bits of the least hash under each coordinate's function."""
    least = np.full(FINE, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 1024):
            x = (shingles[at : at + 1024][None, :] ^ seeds()[:, None]) * ODD_A
            x ^= x >> np.uint64(32)
            x *= ODD_B
            np.minimum(least, x.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def sketch(words_each: int):
    @pandas_udf("n long, node long, signature array<int>, fine binary")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            shingles = shingle_set(text, words_each)
            if not len(shingles):
                rows.append((0, 0, [], b""))
                continue
            with np.errstate(over="ignore"):
                node = mixed(mixed(shingles).sum(keepdims=True) + np.uint64(len(shingles)))
            whole = signature(shingles)
            rows.append((len(shingles), int(node.view(np.int64)[0]), whole[:COORDINATES].view(np.int32).tolist(), whole.astype(np.uint8).tobytes()))
        return pd.DataFrame(rows, columns=["n", "node", "signature", "fine"])

    return run


def full_set(words_each: int):
    @pandas_udf("array<long>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(text, words_each).view(np.int64).tolist() for text in texts], dtype=object)

    return run


def collisions(left: Column, right: Column) -> Column:
    same = F.zip_with(left, right, lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda total, one: total + one)


def prefixes(nodes: DataFrame, length: int) -> DataFrame:
    """(token, node) for the ``length`` rarest tokens of each node, without tokens that one node alone has."""
    posted = nodes.select("node", F.posexplode("signature").alias("coordinate", "value"))
    posted = posted.select("node", (F.shiftleft(F.col("coordinate").cast("long"), 32) + F.col("value").cast("long").bitwiseAND(0xFFFFFFFF)).alias("token"))
    frequency = posted.groupBy("token").agg(F.count(F.lit(1)).alias("f"))
    ranked = posted.join(frequency, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("f", "token"))).alias("tokens"))
    return ranked.select("node", F.explode(F.slice("tokens", 1, length)).alias("t")).filter("t.f > 1").select("t.token", "node")


class Members:
    """The members of a block as arrays. ``fits`` are the members of another block that may link with one of these."""

    def __init__(self, frame: pd.DataFrame, side: str) -> None:
        self.node, self.root, self.n = (frame[f"{c}{side}"].to_numpy() for c in ("node", "root", "n"))
        self.signature = np.stack(frame[f"signature{side}"].to_numpy())
        self.fine = np.frombuffer(b"".join(frame[f"fine{side}"]), dtype=np.uint8).reshape(-1, FINE)

    def fits(self, i: int, other: Members, per_cent: int) -> np.ndarray:
        near = other.root != self.root[i]
        near &= 100 * np.minimum(other.n, self.n[i]) >= per_cent * np.maximum(other.n, self.n[i])
        at = np.flatnonzero(near)
        if len(at):
            at = at[(other.signature[at] == self.signature[i]).sum(axis=1) >= needed_collisions(per_cent / 100, COORDINATES)]
        if len(at):
            at = at[(other.fine[at] == self.fine[i]).sum(axis=1) >= needed_collisions(per_cent / 100, FINE)]
        return at


def sieve(per_cent: int):
    """The members of two blocks of one group that have a candidate in another component."""

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: set[int] = set()
        if len(left) and len(right):
            one, two = Members(left, "_a"), Members(right, "_b")
            for i in range(len(one.node)):
                at = one.fits(i, two, per_cent)
                if len(at):
                    found.add(int(one.node[i]))
                    found.update(two.node[at].tolist())
        nodes = sorted(found)
        return pd.DataFrame({"pivot": [key[0]] * len(nodes), "i": [key[1]] * len(nodes), "j": [key[2]] * len(nodes), "node": nodes}).astype("int64")

    return run


def linked_in_block(per_cent: int):
    """Confirmed links between components, one for each member and component that a link has not joined before."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        members = Members(group, "")
        sets = [np.asarray(s, dtype=np.int64) for s in group["shingles"]]
        above: dict[int, int] = {}

        def top(root: int) -> int:
            while root in above:
                root = above[root]
            return root

        links = []
        for i in range(len(sets)):
            for j in members.fits(i, members, per_cent):
                one, two = top(int(members.root[i])), top(int(members.root[j]))
                if j > i and one != two:
                    common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * common >= per_cent * (len(sets[i]) + len(sets[j]) - common):
                        above[max(one, two)] = min(one, two)
                        links.append((int(members.node[i]), int(members.node[j])))
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return run


def links_between_components(groups: DataFrame, nodes: DataFrame, texts: DataFrame, labels: DataFrame, words_each: int, per_cent: int) -> DataFrame:
    """Links that the pivots have not shown, from the groups that still hold more than one component."""
    labelled = groups.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node")).join(nodes.select("node", "n"), "node")
    spread = labelled.groupBy("pivot").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    open_groups = spread.filter("least <> most").select("pivot", blocks.alias("blocks"))
    members = cut(
        labelled.join(open_groups, "pivot")
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .join(nodes.select("node", "signature", "fine"), "node")
    )
    number = partitions_for(members, members.count(), PER_PARTITION)
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    left = members.withColumn("other", F.explode(F.filter(others, lambda x: x >= F.col("own"))))
    right = members.withColumn("other", F.explode(F.filter(others, lambda x: x <= F.col("own"))))
    values = ("node", "root", "n", "signature", "fine")
    left = left.select(F.col("pivot").alias("p_a"), F.col("own").alias("i_a"), F.col("other").alias("j_a"), *[F.col(c).alias(f"{c}_a") for c in values])
    right = right.select(F.col("pivot").alias("p_b"), F.col("other").alias("i_b"), F.col("own").alias("j_b"), *[F.col(c).alias(f"{c}_b") for c in values])
    # the work of a group is larger than its rows tell, so the number of tasks is given
    left, right = left.repartition(number, "p_a", "i_a", "j_a"), right.repartition(number, "p_b", "i_b", "j_b")
    met = left.groupBy("p_a", "i_a", "j_a").cogroup(right.groupBy("p_b", "i_b", "j_b"))
    sieved = cut(met.applyInPandas(sieve(per_cent), "pivot long, i int, j int, node long"))
    sets = full_sets(sieved.select("node").distinct(), texts, nodes, words_each).select("node", "shingles")
    whole = sieved.join(members.select("pivot", "node", "root", "n", "signature", "fine"), ["pivot", "node"]).join(sets, "node")
    return whole.repartition(number, "pivot", "i", "j").groupBy("pivot", "i", "j").applyInPandas(linked_in_block(per_cent), "a long, b long").distinct()


def star_candidates(groups: DataFrame, nodes: DataFrame, per_cent: int) -> DataFrame:
    """Each member of a group against the group's pivot."""
    pairs = groups.filter("pivot <> node").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    one = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("signature").alias("s_a"))
    two = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("signature").alias("s_b"))
    close = pairs.join(one, "a").join(two, "b").filter(100 * F.least("n_a", "n_b") >= per_cent * F.greatest("n_a", "n_b"))
    return close.filter(collisions(F.col("s_a"), F.col("s_b")) >= needed_collisions(per_cent / 100, COORDINATES)).select("a", "b")


def full_sets(wanted: DataFrame, texts: DataFrame, nodes: DataFrame, words_each: int) -> DataFrame:
    """(node, n, shingles) of the wanted nodes, from the text of one row each."""
    named = wanted.join(nodes.select("node", "n", "best"), "node").select("node", "n", F.col("best.id").alias("rep"), F.col("best.quick").alias("rep_quick"))
    rows = texts.join(named, F.col("id").eqNullSafe(F.col("rep")) & (F.col("quick") == F.col("rep_quick")))
    return cut(rows.dropDuplicates(["node"]).select("node", "n", full_set(words_each)("text").alias("shingles")))


def confirmed(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, words_each: int, per_cent: int) -> DataFrame:
    """The pairs whose full shingle sets are similar enough."""
    sets = full_sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), texts, nodes, words_each)
    one = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("set_a"))
    two = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("set_b"))
    both = pairs.join(one, "a").join(two, "b")
    common = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    return both.withColumn("common", common).filter(100 * F.col("common") >= per_cent * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")


def near_groups(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    words_each: int = 5,
    per_cent: int = 80,
) -> DataFrame:
    """Per row: id, quick, n_shingles, component_id (its group's smallest id)."""
    bounded_batches(docs.sparkSession)
    text = text_of(text_column)
    texts = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("quick"), text.alias("text"))
    rows = cut(texts.withColumn("s", sketch(words_each)("text")).select("id", "quick", "s.*"))
    # equal sets are one node; its signatures are the same in every row
    nodes = cut(
        rows.filter("n > 0").groupBy("node")
        .agg(F.first("n").alias("n"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "quick"))).alias("named"),
             F.min(F.struct("id", "quick")).alias("any_row"), F.first("signature").alias("signature"), F.first("fine").alias("fine"))
        .select("node", "n", F.coalesce("named", "any_row").alias("best"), "signature", "fine")
    )
    postings = cut(prefixes(nodes, COORDINATES - needed_collisions(per_cent / 100, COORDINATES) + 1))
    pivots = postings.groupBy("token").agg(F.min("node").alias("pivot"))
    groups = cut(postings.join(pivots, "token").select("pivot", "node").distinct())
    star = cut(confirmed(cut(star_candidates(groups, nodes, per_cent)), texts, nodes, words_each, per_cent))
    links = star.unionByName(cut(links_between_components(groups, nodes, texts, components(star), words_each, per_cent)))
    labels = components(links)
    rooted = nodes.join(labels, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.col("best.id").alias("id"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    named = cut(rooted.join(least, "root").select("node", "component_id"))
    full = rows.filter("n > 0").join(named, "node").select("id", "quick", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    empty = rows.filter("n = 0").select("id", "quick", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return full.unionByName(empty)


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words_each: int = 5, per_cent: int = 80) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept."""
    groups = near_groups(docs, id_column, text_column, words_each, per_cent)
    return groups.select(
        F.col("id").alias(id_column), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words_each: int = 5, per_cent: int = 80) -> DataFrame:
    """The documents with one row of each group, in the columns of the input."""
    quick = fresh(docs, "_quick")
    groups = near_groups(docs, id_column, text_column, words_each, per_cent)
    gone = groups.filter(~F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("_gone"), F.col("quick").alias("_same")).distinct()
    rows = docs.withColumn(quick, F.xxhash64(text_of(text_column)))
    stays = rows.join(gone, F.col(id_column).eqNullSafe(F.col("_gone")) & (F.col(quick) == F.col("_same")), "left_anti")
    # rows that share id and text are copies of one another; those without words stay
    worded = F.trim(F.regexp_replace(text_of(text_column), r"[\x09-\x0D]", " ")) != ""
    single = stays.filter(worded & F.col(id_column).isNotNull()).dropDuplicates([id_column, quick])
    return single.unionByName(stays.filter(~worded | F.col(id_column).isNull())).select(*docs.columns)

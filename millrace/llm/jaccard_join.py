"""Exact n-gram Jaccard join of all documents by a token-group matrix.

Documents with one shingle set are one set. Sets that can have a similar set are found
first; similar ones form groups around a hub, a matrix holds the token union of each group,
and a set opens a group only if its overlap with that union can reach the threshold.

*Candidates.* The space of shingle hashes is cut into m equal segments; a segment together
with all shingles that a set has in it is a coarse token. Two sets whose difference (shingles
in one only) is at most d have at least m - d of these in common. m depends on a size level,
and a set near the top of its level also has the tokens of the next, so any two sets that
can be similar meet in the level of the larger. Sets with too few shared tokens drop out.
From here on the shingles themselves are the tokens, of the sets that are left only. A set
stays while enough of its shingles for the threshold are in sets of other components.

*Groups.* Each token names as its hub the set that holds the most widely held tokens, so the
centre of a family of edited copies is named by all of them. A set is compared with the hub
that most of its tokens name, then with the one that its rarest tokens name; similar sets
are one component from then on. What is left is grouped by hub. The matrix holds (token,
group). A set looks its rarest tokens up, which gives it candidate groups; the overlap with
each candidate's union is counted over all tokens, and groups that qualify are opened.

*Opened groups.* In an opened group sets are described by how they differ from its hub H:
with D(S) the shingles in one of S and H only, |S xor T| = |D(S)| + |D(T)| - 2 |D(S) & D(T)|.
Two sets near H are joined by it. If one is far from H and the two are similar, their
differences have much in common, which copies that were edited independently never have. So
only sets with enough common differences are paired, by their rarest ones, and compared.

Skew: every step before the exact comparison is an aggregate with partial sums or a join
on (group, token), so a family of a third of all sets is dealt by its tokens; a token that a
third of all sets share is never among the rarest; copies never pair with each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, small, written
from .components import merge
from .shingles import Sets, mix, shingle_sets, sums_by_run

_U = np.uint64
LEVELS = 64
#: How a set's tokens choose among the hubs they name: most tokens, then rarest tokens.
CHOICES = ("many", "rare")
HUB_ROUNDS = len(CHOICES)
_SLICE = 1 << 19


class Scheme:
    """Size levels, segments and bounds for a threshold of ``percent`` / 100."""

    def __init__(self, percent: int):
        self.percent = percent
        # A set up to this size has no similar set but itself.
        least = 1
        while self.difference(least, least) == 0 and self.difference(least, least + 1) == 0:
            least += 1
        bounds = [least]
        while len(bounds) <= LEVELS:
            bounds.append(max(bounds[-1] + 1, -(-bounds[-1] * 8 // 5)))
        self.bounds = np.array(bounds, np.int64)
        top = self.bounds[1:] - 1
        d = np.array([self.difference(int(t), int(t)) for t in top])
        self.spare = 1 + d // 8
        self.segments = d + 1 + self.spare
        self.top = top

    def difference(self, a: int, b: int) -> int:
        """Most shingles that similar sets of sizes a and b have in one of them only."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def levels(self, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, level): own level, and the next where a larger similar set may lie in it."""
        own = np.searchsorted(self.bounds, n, "right") - 1
        nxt = n * 100 >= self.percent * self.bounds[np.minimum(own + 1, LEVELS)]
        up = np.flatnonzero(nxt & (n > 0) & (own + 1 < LEVELS))
        mine = np.flatnonzero(own >= 0)
        return [(mine, own[mine]), (up, own[up] + 1)]

    def least_shared(self) -> F.Column:
        """Fewest tokens that a set of ``n`` shingles shares with any similar set in ``level``."""
        level = F.col("level")
        largest = F.least(F.floor(F.col("n") * 100 / self.percent).cast("long"), self.lookup(self.top, level))
        return self.lookup(self.segments, level) - F.floor((100 - self.percent) * (F.col("n") + largest) / (100 + self.percent))

    def lookup(self, values: np.ndarray, level: F.Column) -> F.Column:
        return F.element_at(F.array(*(F.lit(int(v)) for v in values)), (level + 1).cast("int"))


def set_ids(s: Sets) -> np.ndarray:
    """A 63-bit id of each row's set; 0 where it is empty."""
    rows = len(s.count)
    ids = mix(sums_by_run(mix(s.hash ^ _U(0x5851F42D4C957F2D)), s.doc, rows) + s.count.astype(_U)) >> _U(1)
    return np.where(s.count > 0, ids, 0).astype(np.int64)


def tokens(s: Sets, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """(row, token) of all rows: 42 hash bits and 6 bits for the level."""
    rows_out, tokens_out = [], []
    value = mix(s.hash ^ _U(0x2545F4914F6CDD1D))
    for rows, level in scheme.levels(s.count):
        m = scheme.segments[level]
        base = np.zeros(len(s.count), np.int64)
        base[rows] = np.cumsum(m) - m
        take = np.zeros(len(s.count), bool)
        take[rows] = True
        use = np.flatnonzero(take[s.doc])
        doc = s.doc[use]
        per_doc = np.zeros(len(s.count), np.int64)
        per_doc[rows] = m
        segment = ((s.hash[use] >> _U(32)) * per_doc[doc].astype(_U) >> _U(32)).astype(np.int64)
        n = int(m.sum())
        sums = sums_by_run(value[use], base[doc] + segment, n)
        number = np.arange(n) - np.repeat(base[rows], m)
        where = np.repeat(level, m)
        token = mix(sums + mix((number * LEVELS + where).astype(_U)))
        tokens_out.append(((token >> _U(22)) << _U(6)).astype(np.int64) | where)
        rows_out.append(np.repeat(rows, m))
    return np.concatenate(rows_out), np.concatenate(tokens_out)


def _sliced(docs: DataFrame, f, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4096, _SLICE):
                yield f(part)

    return docs.mapInArrow(run, schema)


def shingled(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, set_id, n_shingles, text_hash) of every document of (doc_id, text)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = shingle_sets(batch.column(1), size)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(set_ids(s)), pa.array(s.count.astype(np.int64)), batch.column(2)], names=["doc_id", "set_id", "n_shingles", "text_hash"])

    return _sliced(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), run, "doc_id long, set_id long, n_shingles long, text_hash long")


def token_rows(docs: DataFrame, size: int, scheme: Scheme) -> DataFrame:
    """(token, set_id, n) of every document; exact copies repeat their rows."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = shingle_sets(batch.column(0), size)
        row, token = tokens(s, scheme)
        return pa.RecordBatch.from_arrays([pa.array(token), pa.array(set_ids(s)[row]), pa.array(s.count[row].astype(np.int32))], names=["token", "set_id", "n"])

    return _sliced(docs.select("text"), run, "token long, set_id long, n int")


def shingle_arrays(docs: DataFrame, sets: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(set_id, n, shingles) of the sets that ``ids`` (set_id) names, in one row each.

    One text of each set is looked up by its hash; the set is computed from the text again,
    so neither ids of documents nor equal hashes of texts can mix sets up."""
    wanted = written(sets.join(ids, "set_id", "left_semi").groupBy("set_id").agg(F.min("text_hash").alias("text_hash")), "candidates")
    texts = docs.select("text", F.xxhash64("text").alias("text_hash")).join(small(wanted.select("text_hash").distinct()), "text_hash", "left_semi").select("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = shingle_sets(batch.column(0), size)
        ends = pa.array(np.cumsum(np.r_[0, s.count]).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(set_ids(s)), pa.array(s.count.astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(s.hash.view(np.int64)))], names=["set_id", "n", "shingles"])

    arrays = _sliced(texts, run, "set_id long, n int, shingles array<long>")
    return written(arrays.join(small(wanted.select("set_id")), "set_id", "left_semi").dropDuplicates(["set_id"]), "shingles")


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (least doc_id reachable by links).

    Documents link when 100 * |intersection| >= percent * |union| of their sets of distinct
    ``size``-word shingles (words: runs of anything but ASCII white space, A-Z lower-cased;
    fewer words than ``size`` are one shingle). Null, empty and blank texts have an empty
    set, no link, and are their own component. Repeated rows are copies of each other; rows
    with a null id and rows of one id with different texts take part like any other, but a
    null can't name a component. Whole texts count, however long. Other columns are ignored,
    whatever their names. An empty table gives no rows.

    Shingles are told apart by 64-bit hashes, sets by 63-bit sums of them and their size."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return set_components(written(shingled(docs, size), "sets"), docs, size, percent).select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def set_components(sets: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``sets`` (of :func:`shingled`) with root (a set_id that names the component; null for an
    empty set) and component_id (its least doc_id; null if it has none, or for an empty set)."""
    return named_components(sets, _links(docs, sets, size, Scheme(percent)))


def named_components(sets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``sets`` with root and component_id, from the (set_id, root) of sets that may have links."""
    # a set's component is named by the least document of all its sets
    named = sets.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    if labels is not None:
        named = named.join(labels, "set_id", "left").select("set_id", "least", F.coalesce("root", "set_id").alias("root"))
        by_root = named.groupBy("root").agg(F.min("least").alias("component_id"))
        named = written(named.join(by_root, "root").select("set_id", "root", "component_id"), "components")
    else:
        named = named.select("set_id", F.col("set_id").alias("root"), F.col("least").alias("component_id"))
    return sets.join(named, "set_id", "left")


def _links(docs: DataFrame, sets: DataFrame, size: int, scheme: Scheme) -> DataFrame | None:
    """(set_id, root) of all sets that may have links; None if there are none."""
    coarse = token_rows(docs, size, scheme)
    shared = coarse.groupBy("token").agg(F.min("set_id").alias("lo"), F.max("set_id").alias("hi")).where("lo < hi").select("token")
    found = written(coarse.join(shared.hint("shuffle_hash"), "token").distinct(), "shared-tokens")
    ids = _promising(_promising(found, scheme), scheme).select("set_id").distinct()
    arrays = shingle_arrays(docs, sets, ids, size)
    labels = arrays.select("set_id", F.col("set_id").alias("root"))
    rows = _overlapping(arrays.select(F.explode("shingles").alias("token"), "set_id", "n", F.col("set_id").alias("root")), scheme.percent)
    for choice in CHOICES[:HUB_ROUNDS]:
        if rows.isEmpty():
            return labels
        labels = joined(labels, similar(_named_hubs(rows, choice), arrays, scheme.percent))
        rows = _overlapping(rows.drop("root").join(labels, "set_id"), scheme.percent)
    if rows.isEmpty():
        return labels
    return joined(labels, _links_in_groups(rows, arrays, labels, scheme.percent))


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (set_id, root) after the components that links (a, b) join are one."""
    links = written(links, "links")
    if links.isEmpty():
        return labels
    ends = [labels.select(F.col("set_id").alias(x), F.col("root").alias(f"root_{x}")) for x in ("a", "b")]
    between = links.join(ends[0], "a").join(ends[1], "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    upper = merge(labels.select(F.col("root").alias("id")).distinct(), between)
    return written(labels.join(upper.select(F.col("id").alias("root"), F.col("root").alias("top")), "root").select("set_id", F.col("top").alias("root")), "labels")


def similar(pairs: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """Those of the (a, b) whose shingle sets reach the threshold, by exact counts."""
    ends = [arrays.select(F.col("set_id").alias(x), F.col("shingles").alias(f"in_{x}")) for x in ("a", "b")]
    both = pairs.select("a", "b").join(ends[0], "a").join(ends[1], "b").withColumn("shared", F.size(F.array_intersect("in_a", "in_b")))
    return both.where(100 * F.col("shared") >= percent * (F.size("in_a") + F.size("in_b") - F.col("shared"))).select("a", "b")


def _promising(rows: DataFrame, scheme: Scheme) -> DataFrame:
    """The (token, set_id, n) of coarse tokens of sets that share enough of them with others.

    Similar sets share at least m - d tokens in a level. So a token of one set goes, and then a
    set goes with fewer tokens left than that in its level."""
    several = rows.groupBy("token").agg(F.min("set_id").alias("lo"), F.max("set_id").alias("hi")).where("lo < hi").select("token")
    left = written(rows.join(several, "token", "left_semi").withColumn("level", F.col("token").bitwiseAND(F.lit(LEVELS - 1))), "open-tokens")
    enough = left.groupBy("set_id", "level", "n").agg(F.count("*").alias("c")).where(F.col("c") >= scheme.least_shared()).select("set_id", "level")
    return left.join(enough, ["set_id", "level"], "left_semi").select("token", "set_id", "n")


def _overlapping(rows: DataFrame, percent: int) -> DataFrame:
    """The (token, set_id, n, root) of sets that may be similar to one of another component.

    Similar sets have ``percent`` of the shingles of either in common, each of which has both
    their components. So tokens of one component go, then sets with fewer left than that."""
    several = rows.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("token")
    left = written(rows.join(several, "token", "left_semi"), "open-shingles")
    enough = left.groupBy("set_id", "n").agg(F.count("*").alias("c")).where(100 * F.col("c") >= percent * F.col("n")).select("set_id")
    return written(left.join(enough, "set_id", "left_semi").select("token", "set_id", "n", "root"), "overlapping")


def _hub_counts(rows: DataFrame, weight: Column) -> DataFrame:
    """(set_id, root, hub, hub_root, c): the hubs that a set's tokens name, and their sums of
    ``weight``, of a token's number ``k`` of sets. A token names, of its sets, the one whose
    tokens are the most widely held on average."""
    k = rows.groupBy("token").agg(F.count("*").alias("k"))
    of_set = Window.partitionBy("set_id")
    held = written(rows.join(k, "token").withColumn("held", F.sum("k").over(of_set) / F.col("n")), "held-tokens")
    hubs = held.groupBy("token").agg(F.max_by(F.struct("set_id", "root"), F.struct("held", "set_id")).alias("hub"))
    named = held.join(hubs, "token").select("set_id", "root", F.col("hub.set_id").alias("hub"), F.col("hub.root").alias("hub_root"), weight.alias("w"))
    return named.groupBy("set_id", "root", "hub", "hub_root").agg(F.sum("w").alias("c"))


def _named_hubs(rows: DataFrame, choice: str) -> DataFrame:
    """(a, b): each set and a hub of another component that its tokens name."""
    counts = _hub_counts(rows, F.lit(1.0) if choice == "many" else 1.0 / F.col("k")).where("root <> hub_root")
    return counts.groupBy(F.col("set_id").alias("a")).agg(F.max_by("hub", F.struct("c", "hub")).alias("b"))


def _links_in_groups(rows: DataFrame, arrays: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join all components of ``rows`` that similar sets join."""
    need = F.ceil(F.col("n") * percent / 100).cast("int")
    home = _hub_counts(rows, F.lit(1)).groupBy("set_id").agg(F.max_by("hub", F.struct("c", "hub")).alias("grp"))
    home = written(home, "groups")
    rows = written(rows.join(home, "set_id"), "matrix-rows")
    matrix = written(rows.groupBy("token", "grp").agg(F.min("root").alias("lo"), F.max("root").alias("hi")), "matrix").withColumnRenamed("grp", "other")

    # of the tokens shared with a similar set at least one is among these
    k = matrix.groupBy("token").agg(F.count("*").alias("k"))
    of_set = Window.partitionBy("set_id")
    nth, live = F.row_number().over(of_set.orderBy("k", "token")), F.count("*").over(of_set)
    rarest = rows.join(k, "token").withColumn("nth", nth).withColumn("live", live).where(F.col("nth") <= F.col("live") - need + 1)
    candidates = rarest.join(matrix, "token").where("lo <> root or hi <> root").select("set_id", "other").distinct()
    overlap = candidates.join(rows.select("set_id", "token", "n"), "set_id").join(matrix.select("token", "other"), ["token", "other"]).groupBy("set_id", "other", "n").agg(F.count("*").alias("c"))
    opened = overlap.where(F.col("c") >= need).select("set_id", F.col("other").alias("grp")).unionByName(home).distinct()
    opened = written(opened.join(home.select("set_id", F.col("grp").alias("own")), "set_id").select("set_id", "grp", (F.col("grp") == F.col("own")).alias("home")), "opened")

    return differing_pairs(opened, arrays, labels, percent, lambda pairs: similar(pairs, arrays, percent))


def differing_pairs(opened: DataFrame, arrays: DataFrame, labels: DataFrame, percent: int, only: Callable[[DataFrame], DataFrame] = lambda pairs: pairs) -> DataFrame:
    """(a, b) of different components in the groups of ``opened`` (set_id, grp: its hub's set_id,
    home): sets near their hub with it, and others whose differences from it let them be similar
    (those of them that ``only`` keeps)."""
    sets = arrays.select("set_id", "n", "shingles").join(labels, "set_id")
    hubs = sets.select(F.col("set_id").alias("grp"), F.col("n").alias("n_hub"), F.col("shingles").alias("hub"), F.col("root").alias("hub_root"))
    apart = F.concat(F.array_except("shingles", "hub"), F.array_except("hub", "shingles"))
    apart = opened.join(sets, "set_id").join(hubs, "grp").select("grp", "set_id", "home", "n", "root", "n_hub", "hub_root", apart.alias("apart"))
    apart = apart.withColumn("d", F.size("apart")).withColumn("near", (100 + percent) * F.col("d") <= (100 - percent) * (F.col("n") + F.col("n_hub")))
    apart = written(apart, "apart")
    by_hub = apart.where("near and root <> hub_root").select(F.col("set_id").alias("a"), F.col("grp").alias("b"))
    return by_hub.unionByName(only(_pairs_in_groups(apart.drop("hub_root"), percent)))


def _pairs_in_groups(apart: DataFrame, percent: int) -> DataFrame:
    """(a, b): sets of different components, of which one at least is far from their group's
    hub, that may be similar, from their differences from the hub.

    With p percent, sets are similar where (100 + p) |S xor T| <= (100 - p) (|S| + |T|). T being
    far, c common differences have 2 (100 + p) c > (100 + p) |D(S)| + (100 - p) (|H| - |S|). S
    being far, c <= |D(T)| leaves (100 + p) c >= (100 + p) |D(S)| - (100 - p) (|S| + |T|)."""
    more, less = 100 + percent, 100 - percent
    by_far = F.floor((more * F.col("d") + less * (F.col("n_hub") - F.col("n"))) / (2 * more)) + 1
    by_any = F.ceil((more * F.col("d") - less * (F.col("n") + F.floor(F.col("n") * 100 / percent))) / more)
    least = F.greatest(F.lit(1), F.when(F.col("near"), by_far).otherwise(by_any))
    rows = apart.select("grp", F.explode("apart").alias("token"), "set_id", "home", "near", "n", "root", least.alias("least"))
    for _ in range(2):
        several = rows.groupBy("grp", "token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.bool_or("home").alias("any_home"), F.bool_and("near").alias("all_near")).where("lo < hi and any_home and not all_near")
        left = written(rows.join(several.select("grp", "token"), ["grp", "token"], "left_semi"), "open-differences")
        enough = left.groupBy("grp", "set_id", "least").agg(F.count("*").alias("c")).where("c >= least").select("grp", "set_id")
        rows = left.join(enough, ["grp", "set_id"], "left_semi")
    k = rows.groupBy("grp", "token").agg(F.count("*").alias("k"))
    of_set = Window.partitionBy("grp", "set_id")
    nth, live = F.row_number().over(of_set.orderBy("k", "token")), F.count("*").over(of_set)
    rarest = written(rows.join(k, ["grp", "token"]).withColumn("nth", nth).withColumn("live", live).where("nth <= live - least + 1"), "rarest-differences")
    ends = [rarest.select("grp", "token", *(F.col(c).alias(f"{c}_{x}") for c in ("set_id", "home", "near", "n", "root"))) for x in ("a", "b")]
    fits = F.expr(f"root_a <> root_b and not (near_a and near_b) and 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) and (set_id_a < set_id_b or not home_a)")
    pairs = ends[0].join(ends[1].where("home_b"), ["grp", "token"]).where(fits)
    return pairs.select(F.least("set_id_a", "set_id_b").alias("a"), F.greatest("set_id_a", "set_id_b").alias("b")).distinct()

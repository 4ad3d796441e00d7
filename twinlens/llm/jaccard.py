"""N-gram Jaccard join by a token-group matrix.

A document's set holds its distinct word shingles. Equal sets form classes. For two sets of sizes p and q the threshold
bounds their symmetric difference by k = (p + q)(1 - t)/(1 + t); with the shingle universe cut into more than k segments, some
segments hold the same shingles in both. The tokens of the matrix are such segment contents. There are a quarter more segments
than k, so sets that link share at least that many of them, whatever shingles the corpus has in common, and a passage that
two other sets share makes too few equal segments.

A set whose bound is ``need`` shared tokens can leave out its ``need`` - 1 most frequent ones where it looks for partners, in
one order for all sets; its other tokens lead it to groups. A group holds the classes that are led there by a token of its
pivot. The matrix has the union of its members' tokens, those that two members have; a class whose overlap with it is below
the class's bound links with nothing in the group and is left out. The others are compared with the pivot. A group in which all link with the pivot is settled; only groups with a member
that does not are opened. There members are compared by what sets them apart from the pivot: if one of two linked sets is
not linked with the pivot, their differences from it overlap, and by how much follows from the sizes. Copies of one text have
its frequent shingles in common, but not their edits, so this stays selective inside a family of any size.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ..runtime import discard, durable, sifted
from .components import connected_components

WORDS = 3
PERCENT = 90
SPARE = 2  # segments beyond k + 1, at least
SPARE_SHARE = 0.25  # of k, where that is more
CLASS_RATIO = 1.4  # from one size class to the next
LARGEST = 1 << 40  # sets larger than this would need more size classes
CACHE_SIZE = 250_000
U = np.uint64
FACTORS = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every input bit over all 64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> U(33))


class WordHashes(dict):
    """Word bytes -> 64-bit hash, bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_SIZE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_set(text: bytes | None, hashes: WordHashes, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; a text of fewer words is one shingle, one without words has none.

    Words are what ASCII white space separates, A-Z in lower case.
    """
    parts = (text or b"").lower().split()
    if not parts:
        return np.empty(0, U)
    ids = np.fromiter(map(hashes.__getitem__, parts), U, len(parts))
    width = min(words, len(ids))
    count = len(ids) - width + 1
    with np.errstate(over="ignore"):
        total = np.full(count, width, U)
        for k in range(width):
            total = mixed(total * FACTORS[0] + ids[k : k + count] * FACTORS[1] + U(k))
    return np.unique(total)


class Segments:
    """How sets of each size are cut into segments, so that linked sets share at least ``spare`` + 1 segments, or a share of k."""

    def __init__(self, percent: int = PERCENT, spare: int = SPARE):
        self.percent, self.spare = percent, spare
        least = 1
        while not self._difference(least + least * 100 // percent):
            least += 1
        self.bounds = [least]  # first size of each class; smaller sets link with equal ones only
        while self.bounds[-1] < LARGEST:
            size = self.bounds[-1]
            self.bounds.append(max(size * 100 // percent + 1, int(size * CLASS_RATIO)))

    def _difference(self, both: int) -> int:
        """The largest symmetric difference of linked sets with ``both`` elements together."""
        return both * (100 - self.percent) // (100 + self.percent)

    def keys(self, size: int) -> list[tuple[int, int, int]]:
        """(class, number of segments, how many of them are spare) under which a set of this size meets its partners: its own, or the class below too."""
        own = bisect_right(self.bounds, size) - 1
        if own < 0:
            return []
        found = [(own, *self._counts(own))]
        if own and size <= (self.bounds[own] - 1) * 100 // self.percent:
            found.append((own - 1, *self._counts(own - 1)))
        return found

    def _counts(self, key: int) -> tuple[int, int]:
        largest = self.bounds[key + 1] - 1
        most = self._difference(largest + largest * 100 // self.percent)
        spare = max(self.spare, int(most * SPARE_SHARE))
        return most + 1 + spare, spare

    def tokens(self, shingles: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
        """The matrix tokens of a set under each key, and how many of them a linked set of that key shares at least.

        Segments are ranges of the hash; a token hashes a segment's number and content. Empty segments are equal to
        each other without telling anything: a set with few of them leaves them out and lowers its bound, a set with more
        gets one token that says so.
        """
        found, needs = [], []
        for key, count, spare in self.keys(len(shingles)):
            number = ((shingles >> U(32)) * U(count)) >> U(32)
            starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
            empty = count - len(starts)
            with np.errstate(over="ignore"):
                content = np.add.reduceat(mixed(shingles ^ FACTORS[2]), starts)
                own = mixed(content + mixed(number[starts] * U(1 << 20) + U(key + 1)))
                if empty > spare:
                    own = np.append(own, mixed(np.array([key + 1], U) * FACTORS[1]))
            found.append(own)
            needs.append(max(1, spare + 1 - empty))
        return found, needs


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    flat = np.concatenate([np.empty(0, np.int64), *map(_signed, arrays)])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _set_rows(words: int, segments: Segments | None):
    """mapInArrow function: doc_id, text, others -> doc_id, others, n, h1, h2, tokens, cut and needs of two keys; or the sets themselves."""

    def rows(batches):
        hashes = WordHashes()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            for at in range(0, len(ids), 256):
                sets = [shingle_set(t, hashes, words) for t in texts.slice(at, 256).to_pylist()]
                names = [xxhash.xxh128_intdigest(s.tobytes()) for s in sets]
                names_before = ["doc_id", *batch.schema.names[2:], "n", "h1", "h2"]
                columns = [c.slice(at, 256) for c in (ids, *batch.columns[2:])] + [pa.array(map(len, sets), pa.int64())]
                for shift in (0, 64):
                    columns.append(pa.array(_signed(np.array([(h >> shift) & (2**64 - 1) for h in names], U))))
                if segments:
                    keyed = [segments.tokens(s) for s in sets]
                    columns.append(_lists([np.concatenate([np.empty(0, U), *t]) for t, _ in keyed]))
                    columns.append(pa.array([len(t[0]) if t else 0 for t, _ in keyed], pa.int32()))
                    columns += [pa.array([n[at] if at < len(n) else None for _, n in keyed], pa.int32()) for at in (0, 1)]
                    yield pa.RecordBatch.from_arrays(columns, [*names_before, "tokens", "cut", "need", "need_low"])
                else:
                    yield pa.RecordBatch.from_arrays([*columns, _lists(sets)], [*names_before, "members"])

    return rows


def _classes(rows: DataFrame) -> DataFrame:
    """One row per distinct non-empty set: n, h1, h2, class (the number of one of its rows) and first_id (the smallest doc_id)."""
    picked = rows.where("n > 0").groupBy("n", "h1", "h2")
    return durable(picked.agg(F.min("class").alias("class"), F.min("doc_id").alias("first_id")), "classes")


def _held_tokens(full: DataFrame) -> DataFrame:
    """code, token, held: the tokens that several rows have, and how many do. ``full`` is used up.

    Token rows are only a token and a number for row and level; few are left.
    """
    coded = F.posexplode("tokens").alias("at", "token")
    token_rows = full.select("class", "cut", coded).select((F.col("class") * 2 + (F.col("at") >= F.col("cut")).cast("long")).alias("code"), "token")
    # dealt out once, a row of two numbers for each token: a join of rows with their counts would deal them out for either side
    same = Window.partitionBy("token")
    counted = [F.count(F.lit(1)).over(same).alias("held"), F.min("code").over(same).alias("_lo"), F.max("code").over(same).alias("_hi")]
    held = durable(token_rows.select("code", "token", *counted).where("_lo < _hi").drop("_lo", "_hi"), "tokens")
    discard(full)
    return held


def _shared_tokens(full: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """class, level, need, tokens: what a class has in common with other rows under its own key (level 0) or the one below.

    Tokens are (held, token), rarest first. A class with fewer than ``need`` of them has no link under that key. ``full`` is
    used up: it goes before the tokens become lists, and what else is known of a row comes back from ``rows``.
    """
    held = _held_tokens(full)
    listed = held.groupBy("code").agg(F.sort_array(F.collect_list(F.struct("held", "token"))).alias("tokens"))
    listed = listed.select(F.shiftright("code", 1).alias("class"), F.col("code").bitwiseAND(1).alias("level"), "tokens")
    needs = rows.join(classes.select("class"), "class", "left_semi").select("class", F.col("need").alias("_own"), F.col("need_low").alias("_low"))
    known = listed.join(needs, "class").withColumn("need", F.when(F.col("level") == 1, F.col("_low")).otherwise(F.col("_own")))
    shared = durable(known.where(F.size("tokens") >= F.col("need")).select("class", "level", "need", "tokens"), "shared")
    discard(held)
    return shared


def _groups(shared: DataFrame) -> DataFrame:
    """class, level, pivot: the groups that a class's tokens lead to, without its ``need`` - 1 most frequent ones.

    A token's pivot is that one of its classes whose tokens are held most often, all together. An edited copy lacks the
    tokens that its edits fall into, so the pivot of a family is near the text that the others were made from, and links
    with many of them.
    """
    weight = F.aggregate("tokens", F.lit(0).cast("long"), lambda total, x: total + x["held"])
    leading = F.slice("tokens", F.lit(1), F.size("tokens") - F.col("need") + 1)
    # the weight is taken before tokens become rows, or it would be summed up again for each of them
    held = shared.select("class", "level", weight.alias("weight"), F.transform(leading, lambda x: x["token"]).alias("lead"))
    leads = held.select("class", "level", "weight", F.explode("lead").alias("token"))
    pivots = leads.groupBy("token").agg(F.max(F.struct("weight", "class"))["class"].alias("pivot"), F.count(F.lit(1)).alias("led")).where("led > 1")
    return durable(leads.select("class", "level", "token").join(pivots.drop("led"), "token").select("class", "level", "pivot").distinct(), "groups")


def _near(both, n, m, percent: int):
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (100 * both >= percent * (n + m - both))


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets reach the threshold."""
    left = sets.select(F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("members").alias("in_a"))
    right = sets.select(F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("members").alias("in_b"))
    both = F.size(F.array_intersect("in_a", "in_b"))
    return pairs.join(left, "a").join(right, "b").where(_near(both, F.col("n_a"), F.col("n_b"), percent)).select("a", "b")


def _qualified(shared: DataFrame) -> DataFrame:
    """(class, pivot) where the class's overlap with the token union of the pivot's group reaches its bound.

    Token lists move to their groups whole; only there a row of three numbers is made of each token, and dealt out once for
    the union and the overlaps alike.
    """
    groups = _groups(shared)
    code = (F.col("class") * 2 + F.col("level")).alias("code")
    lists = shared.select(code, F.transform("tokens", lambda x: x["token"]).alias("tokens"))
    rows = groups.select(code, "pivot").join(lists, "code").select("pivot", "code", F.explode("tokens").alias("token"))
    owner, same = F.shiftright("code", 1), Window.partitionBy("pivot", "token")
    union = rows.select("pivot", "code", F.min(owner).over(same).alias("_lo"), F.max(owner).over(same).alias("_hi")).where("_lo < _hi")
    overlap = union.groupBy("code", "pivot").agg(F.count(F.lit(1)).alias("both"))
    overlap = overlap.join(shared.select(code, "need"), "code").where("both >= need").select(owner.alias("class"), "pivot")
    qualified = durable(overlap.where("class <> pivot").distinct(), "qualified")
    discard(groups)
    return qualified


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Classes against their pivots: linked, the size d of the difference, and its leading elements.

    The difference lists what the pivot lacks first, in one order for all members. Two linked sets x and y have
    d(x) + d(y) - 2 overlap <= k, so that the leading d - need + 1 elements of both must meet; ``first`` counts those that
    have to meet the leading elements of another unlinked member, all of them may meet a linked one.
    """
    left = sets.select("class", "n", F.col("members").alias("mine"))
    right = sets.select(F.col("class").alias("pivot"), F.col("n").alias("m"), F.col("members").alias("theirs"))
    met = pairs.join(left, "class").join(right, "pivot")
    added, gone = F.array_except("mine", "theirs"), F.array_except("theirs", "mine")
    d, n, m, k = F.col("d"), F.col("n"), F.col("m"), F.col("k")
    allowed = lambda both: F.floor(both * (100 - percent) / (100 + percent))
    fewest = lambda other: F.greatest(F.lit(1), F.ceil((d + F.greatest(other, d - k) - k) / 2))
    met = met.select("class", "pivot", "n", "m", F.concat(added, gone).alias("apart")).withColumn("d", F.size("apart"))
    met = met.withColumn("linked", _near((n + m - d) / 2, n, m, percent)).withColumn("k", allowed(n + F.floor(n * 100 / percent)))
    unlinked_d = allowed(F.ceil(n * percent / 100) + m) + 1
    met = met.withColumn("first", F.when(F.col("linked"), 0).otherwise(d - fewest(unlinked_d) + 1).cast("int"))
    taken = F.when(F.col("linked"), d).otherwise(d - fewest(F.lit(0)) + 1).cast("int")
    return met.select("class", "pivot", "n", "d", "linked", "first", F.slice("apart", F.lit(1), taken).alias("apart"))


def _opened(compared: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of groups with an unlinked member, whose differences from the pivot meet as linked sets' must.

    ``found`` has the components so far; members of one component need no comparison. Differences meet under one number for
    pivot and element, so that a large group is dealt out by its elements; their rows carry numbers only.
    """
    named = found.withColumnRenamed("node", "class")
    open_groups = compared.where(~F.col("linked")).select("pivot").distinct()
    rows = compared.join(open_groups, "pivot").join(named, "class", "left").withColumn("component", F.coalesce("component", "class"))
    rows = rows.select("pivot", "class", "component", "n", "d", "linked", "first", F.posexplode("apart").alias("at", "element"))
    rows = rows.select(F.xxhash64("pivot", "element").alias("key"), "class", "component", "n", "d", "linked", (F.col("at") < F.col("first")).alias("lead"), "at")
    side = lambda df, tag: df.select("key", *[F.col(c).alias(f"{c}_{tag}") for c in ("class", "component", "n", "d", "linked", "lead", "at")])
    met = side(rows.where(~F.col("linked")), "a").join(side(rows, "b"), "key")
    k = F.floor((F.col("n_a") + F.col("n_b")) * (100 - percent) / (100 + percent))
    sides = F.col("linked_b") | (F.col("lead_a") & F.col("lead_b") & (F.col("class_a") < F.col("class_b")))
    sizes = (F.abs(F.col("d_a") - F.col("d_b")) <= k) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    # the first element that two differences share has the whole overlap behind it in both
    behind = F.least(F.col("d_a") - F.col("at_a"), F.col("d_b") - F.col("at_b"))
    sizes = sizes & (2 * behind >= F.col("d_a") + F.col("d_b") - k)
    met = met.where(sides & sizes & (F.col("component_a") != F.col("component_b")))
    return met.select(F.greatest("class_a", "class_b").alias("a"), F.least("class_a", "class_b").alias("b")).distinct()


def jaccard_components(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, spare: int = SPARE) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the smallest doc_id that links of at least ``percent`` reach.

    A null text, or one without words, has no shingles, links with nothing and is its own component. Repeated rows and
    ids share a component as their sets do; ids that are null are passed over when the smallest is taken. Other columns
    are ignored, an empty table gives no rows; texts are read whole. Shingles are told apart by 64-bit hashes, sets by
    128-bit hashes.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows, classes = _grouped(docs, docs.withColumn("class", F.monotonically_increasing_id()), percent, words, spare)
    least = classes.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_set = classes.select("n", "h1", "h2", "component").join(least, "component").drop("component")
    full = rows.where("n > 0").join(by_set, ["n", "h1", "h2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _grouped(docs: DataFrame, numbered: DataFrame, percent: int, words: int, spare: int) -> tuple[DataFrame, DataFrame]:
    """Stored rows (doc_id, class, n, h1, h2, and what else of ``numbered`` is), ``class`` being a row's number, and their classes
    with the component of each."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    others = [c for c in numbered.columns if c not in ("doc_id", "text")]
    named = f"doc_id {kind}, {', '.join(f'{c} long' for c in others)}, n long, h1 long, h2 long"
    made = numbered.select("doc_id", "text", *others).mapInArrow(_set_rows(words, Segments(percent, spare)), f"{named}, tokens array<long>, cut int, need int, need_low int")
    full = durable(made, "sets")
    rows = durable(full.drop("tokens", "cut"), "rows")
    classes = _classes(rows)
    shared = _shared_tokens(full, rows, classes)
    edges = _class_links(docs, shared, classes, f"doc_id {kind}, n long, h1 long, h2 long", percent, words)
    found = connected_components(edges).withColumnRenamed("node", "class")
    grouped = durable(classes.join(found, "class", "left").withColumn("component", F.coalesce("component", "class")), "components")
    discard(classes, edges)
    return rows, grouped


def _class_links(docs: DataFrame, shared: DataFrame, classes: DataFrame, named: str, percent: int, words: int) -> DataFrame:
    """Links (a, b) between classes that leave the same components as all links do. ``shared`` is used up."""
    qualified = _qualified(shared)
    discard(shared)

    # the sets of classes in qualifying groups, from the text of one document of each
    kept = qualified.select("class").unionByName(qualified.select(F.col("pivot").alias("class"))).distinct()
    wanted = kept.join(classes.select("class", "first_id", "n", "h1", "h2"), "class")
    ids = wanted.select(F.col("first_id").alias("_id")).distinct()
    near, _ = sifted(docs, F.xxhash64(docs["doc_id"]), ids, F.xxhash64(ids["_id"]))
    texts = near.join(ids, near["doc_id"].eqNullSafe(ids["_id"]), "left_semi")
    again = texts.mapInArrow(_set_rows(words, None), f"{named}, members array<long>")
    again = again.drop("doc_id").dropDuplicates(["n", "h1", "h2"])
    sets = durable(wanted.select("class", "n", "h1", "h2").join(again, ["n", "h1", "h2"]).select("class", "n", "members"), "members")

    compared = durable(_compared(qualified, sets, percent), "compared")
    discard(qualified)
    edges = compared.where("linked").select(F.col("class").alias("a"), F.col("pivot").alias("b"))
    pairs = durable(_opened(compared, connected_components(edges), percent), "pairs")
    links = durable(edges.unionByName(_linked(pairs, sets, percent)), "links")
    discard(sets, compared, pairs)
    return links


def first_of_each(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """One row of ``docs``, with all columns, of each component: that of the smallest doc_id, and of its rows that with the
    smallest hash of the text.

    A row without an id gives way to any with one. A null text, or one without words, links with nothing, so its row stays,
    as do all of several such; exact repeats of other rows go down to one. Whatever stands in no other row stays, also where
    another row of its id goes. An empty table gives no rows.
    """
    text = F.col("text").cast("string")
    marks = {"t1": F.xxhash64(text), "t2": F.xxhash64(text, F.lit("again"))}  # with the id they name a row, or its exact repeats
    texts = docs.select("doc_id", text.alias("text"))
    numbered = texts.select("doc_id", "text", F.monotonically_increasing_id().alias("class"), *[mark.alias(c) for c, mark in marks.items()])
    rows, classes = _grouped(texts, numbered, percent, words, SPARE)
    grouped = rows.where("n > 0").join(classes.select("n", "h1", "h2", "component"), ["n", "h1", "h2"])
    named = grouped.groupBy("component", "doc_id", "t1", "t2").agg(F.count(F.lit(1)).alias("times"))
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("t1"), F.col("t2"))).alias("kept")
    best = named.groupBy("component").agg(first, F.sum("times").alias("size")).where("size > 1").drop("size")
    mine = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("t1"), F.col("t2"))
    judged = durable(named.join(best, "component").select("doc_id", "t1", "t2", "times", mine.eqNullSafe(F.col("kept")).alias("stays")), "judged")
    discard(rows, classes)

    def matching(rows: DataFrame, which: DataFrame, how: str) -> DataFrame:
        which = which.select(F.col("doc_id").alias("_id"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2"))
        same = rows["doc_id"].eqNullSafe(which["_id"]) & (marks["t1"] == which["_t1"]) & (marks["t2"] == which["_t2"])
        return rows.join(which, same, how)

    # most texts are of no row that goes or repeats, and are not dealt out
    changed = judged.where("NOT stays OR times > 1")
    near, rest = sifted(docs, F.xxhash64(docs["doc_id"], *marks.values()), changed, F.xxhash64("doc_id", "t1", "t2"))
    left = matching(near, judged.where("NOT stays"), "left_anti")
    repeated = judged.where("stays AND times > 1")
    if repeated.isEmpty():
        return rest.unionByName(left)
    several = matching(left, repeated, "left_semi")
    mark = "_row"
    while mark in docs.columns:
        mark += "_"
    names = [F.col("doc_id").isNull(), F.col("doc_id"), *marks.values()]
    once = several.withColumn(mark, F.row_number().over(Window.partitionBy(*names).orderBy(F.lit(0)))).where(F.col(mark) == 1).drop(mark)
    return rest.unionByName(matching(left, repeated, "left_anti")).unionByName(once)

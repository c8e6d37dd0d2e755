"""Jaccard self-join on word shingles by prefix filters under several global token orders.

Two documents link when 100 * intersection >= percent * union of their shingle sets. A token order
ranks shingles; under any order, linked sets share a token among their first n - ceil(percent n /
100) + 1 tokens. Candidates must share such a token under every one of ORDERS orders.

1. A twice-seen Bloom filter of all shingles finds tokens that are unique for certain. Orders rank
   these first, so a document with a prefix of unique tokens has no partner and leaves here.
2. Documents with equal sets become one class; a member with its text stands for it.
3. Token counts among the representatives (bounded counters) refine the orders: rare first, then by
   a hash of each order's own. Prefixes are written, one row a class; unique tokens are left out.
4. Rounds link classes without pairing all members of a list: a list's pivot meets its other members,
   candidates that pass all orders are verified on whole texts, and components are joined. After a round
   without links, or ROUNDS of them, every remaining pair of a list across two components is tested. No pair inside a
   component is needed, so the components are exact.
5. For the number of links, a component's sets are dealt to blocks of about BLOCK sets, and each two blocks meet in
   a task, where all their overlaps are one product of matrices: no pair is ever a row, and a text travels once
   for each block that its own meets. A component of several blocks that is sparse (a long chain, say) goes by the
   pairs of its lists, tested as in step 4.

A pair also needs room: at its first common token under an order, the overlap is at most what either
set has left from there on. A list keeps pairs that have room at its token, so each linked pair passes
at its first common token, in every order. Near copies whose own words fill the prefix don't.
The filter has at most 2^MOST_BITS bits and 2^MOST_COUNTER_BITS counters. Where they fill up (from about 3 GB of
text on) fewer documents leave in step 1, and tokens rank by class only if they are more frequent than a counter's
load: more prefixes are shuffled, in proportion to the input, and the result is the same.

Defined cases. Null, empty and blank texts have an empty set, n_shingles 0 and no link. Fewer words
than a shingle: the whole sequence is the one shingle. Rows that repeat an id and text are one class.
A null id counts for component_id only where its component has no other. Other columns are not read; drop_near_copies
passes them through (names starting with `_gl_` are reserved).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import LEAST_BITS, MOST_BITS, MOST_COUNTER_BITS, count_classes, might_repeat, twice_seen
from .common import join_on_hot_keys, power_of_two, stored_bytes, written
from .components import components
from .text import mix, seeded, shingle_sets, slices, utf8

ORDERS = 3
ROUNDS = 3
#: Partners that one task compares with a pivot; a pivot with more is dealt to several tasks.
PARTNERS = 64
#: Members of a block of a list or a component; and shingles of a block, unless one set has more.
BLOCK, WEIGHT = 512, 1 << 18
#: Pairs in lists for each member, up to which a component of several blocks goes by its lists.
SPARSE = 64
#: Units that read a block's texts in one task; and tokens that one product of matrices takes.
FAN, WIDTH = 64, 4096


def _prefix(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (percent * n + 99) // 100 + 1


def _sets(column: pa.Array, size: int):
    raw, at = utf8(column)
    for a, b in slices(at):
        yield a, b, *shingle_sets(raw[at[a] : at[b]], at[a : b + 1] - at[a], size)


def _per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[at[1:]] - total[at[:-1]]


def _prepare(df: DataFrame, id_col: str, text_col: str, size: int, percent: int, uid_col: str | None) -> DataFrame:
    """doc_id, n, digest and text (both only where a partner is possible), uid (of uid_col, if given)."""
    uid = F.col(uid_col) if uid_col else F.monotonically_increasing_id()
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), uid.alias("uid"))
    bits = power_of_two(1.5 * stored_bytes(docs, "text") / 6, LEAST_BITS, MOST_BITS)

    def hashes(batch):
        for _, _, grams, _ in _sets(batch.column(0), size):
            yield grams

    twice = twice_seen(docs.select("text"), hashes, bits, 1)

    def probe(batches):
        for batch in batches:
            n, digest, text = [], [], []
            for a, b, grams, at in _sets(batch.column(1), size):
                count = np.diff(at)
                unique = _per_row(~might_repeat(twice.value, grams, bits, 1), at)
                stays = (count > 0) & (unique < _prefix(count, percent))
                n.append(count)
                digest += [hashlib.blake2b(grams[at[i] : at[i + 1]].tobytes(), digest_size=16).digest() if s else None for i, s in enumerate(stays)]
                part = batch.column(1).slice(a, b - a)
                text += [part[i].as_py() if s else None for i, s in enumerate(stays)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n) if n else [], pa.int64()), pa.array(digest, pa.binary()), pa.array(text, pa.string()), batch.column(2)], ["doc_id", "n", "digest", "text", "uid"])

    return written(docs.mapInArrow(probe, "doc_id long, n long, digest binary, text string, uid long"))


def _prefixes(reps: DataFrame, tokens: int, size: int, percent: int) -> DataFrame:
    """uid, n, live, and t0, t1, ...: the prefix under each order, without unique tokens; none of them is empty.

    live counts a set's tokens that aren't unique. Every order ranks those last, so from place i of a listed
    prefix on (from 0), live - i tokens are left that another set may have.
    """
    bits = power_of_two(2 * tokens, 16, MOST_COUNTER_BITS)

    def hashes(batch):
        for _, _, grams, _ in _sets(batch.column(0), size):
            yield grams

    classes = count_classes(reps.select("text"), hashes, bits)
    seeds = seeded(ORDERS, 41)
    lists = [f"t{o}" for o in range(ORDERS)]

    def prefixes(batches):
        table = np.frombuffer(classes.value, np.uint8)
        for batch in batches:
            uids = batch.column(0).to_numpy()
            for a, b, grams, at in _sets(batch.column(1), size):
                n = np.diff(at)
                row = np.repeat(np.arange(b - a), n)
                rank = table[(grams >> np.uint64(64 - bits)).astype(np.int64)]
                live = _per_row(rank > 1, at)
                most = _prefix(n, percent)
                most[n - live >= most] = 0
                own = []
                for o in range(ORDERS):
                    order = np.lexsort((mix(grams ^ seeds[o]), rank, row))
                    order = order[(np.arange(len(order)) - at[row] < most[row]) & (rank[order] > 1)]
                    ends = np.searchsorted(row[order], np.arange(b - a + 1)).astype(np.int32)
                    own.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(grams[order].view(np.int64))))
                yield pa.RecordBatch.from_arrays([pa.array(uids[a:b]), pa.array(n), pa.array(live), *own], ["uid", "n", "live", *lists]).filter(pa.array(most > 0))

    return written(reps.select("uid", "text").mapInArrow(prefixes, "uid long, n long, live long, " + ", ".join(f"{t} array<long>" for t in lists)))


def _room(x: str, y: str, percent: int) -> Column:
    """Whether sets x and y can reach the threshold if this is their first common token."""
    return (100 + percent) * F.least(f"{x}rest", f"{y}rest") >= percent * (F.col(f"{x}n") + F.col(f"{y}n"))


def _meet(pairs: DataFrame, table: DataFrame, test: Callable) -> DataFrame:
    """The pairs (p, u) that pass a test of both rows of table (uid, ...), of which p's, the pivot's, is read first.

    A pivot's partners are dealt to tasks of about PARTNERS; its own row goes there once. test takes batches of
    (p, part, role, uid, ...), role 0 being the pivot, and gives p and u.
    """
    partners = pairs.groupBy("p").agg(F.count(F.lit(1)).alias("_n"))
    parts = written(partners.withColumn("parts", F.ceil(F.col("_n") / PARTNERS).cast("int")))
    joined = join_on_hot_keys(pairs.select("p", "u"), parts, "p", "_n")
    members = joined.select(F.col("u").alias("uid"), "p", F.pmod(F.xxhash64("u"), "parts").cast("int").alias("part"), F.lit(1).alias("role"))
    pivots = parts.select(F.col("p").alias("uid"), "p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"))
    rows = members.union(pivots).join(table, "uid").select("p", "part", "role", *table.columns)
    rows = rows.repartition("p", "part").sortWithinPartitions("p", "part", "role")
    return written(rows.mapInArrow(test, "p long, u long"))


def _kept(p: list[int], u: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(u, pa.int64())], ["p", "u"])


def _in_all_orders(pairs: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """The pairs (p, u) that share a prefix token under every order after the first, the first such one with room."""
    lists = [f"t{o}" for o in range(1, ORDERS)]

    def test(batches):
        pivot: tuple = ()
        for batch in batches:
            p, role, uid, n, live = (batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5))
            tokens = [(c.flatten().to_numpy(), np.concatenate([[0], np.cumsum(c.value_lengths().to_numpy())])) for c in batch.columns[6:]]
            left, right = [], []
            for i in range(len(p)):
                own = [t[at[i] : at[i + 1]] for t, at in tokens]
                if role[i] == 0:
                    sort = [np.argsort(t) for t in own]
                    pivot = n[i], live[i], [(t[s], s) for t, s in zip(own, sort, strict=True)]
                    continue
                for t, (theirs, place) in zip(own, pivot[2], strict=True):
                    where = np.minimum(np.searchsorted(theirs, t), len(theirs) - 1)
                    common = theirs[where] == t
                    at = int(common.argmax())
                    if not common[at] or (100 + percent) * min(live[i] - at, pivot[1] - int(place[where[at]])) < percent * (n[i] + pivot[0]):
                        break
                else:
                    left.append(p[i])
                    right.append(uid[i])
            yield _kept(left, right)

    return _meet(pairs, prefixes.select("uid", "n", "live", *lists), test)


def _links(pairs: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (p, u) whose sets reach the threshold, compared on whole texts."""

    def test(batches):
        pivot = np.zeros(0, np.uint64)
        for batch in batches:
            p, role, uid = (batch.column(i).to_pylist() for i in (0, 2, 3))
            left, right = [], []
            for first, last, grams, at in _sets(batch.column(4), size):
                for i in range(first, last):
                    own = grams[at[i - first] : at[i - first + 1]]
                    if role[i] == 0:
                        pivot = own
                        continue
                    where = np.searchsorted(pivot, own)
                    common = int((pivot[np.minimum(where, len(pivot) - 1)] == own).sum()) if len(pivot) else 0
                    if 100 * common >= percent * (len(pivot) + len(own) - common):
                        left.append(p[i])
                        right.append(uid[i])
            yield _kept(left, right)

    return _meet(pairs, reps.select("uid", "text"), test)


def _once(pairs: DataFrame) -> DataFrame:
    """Pairs (p, u) -> a < b, p, u: each pair of classes once, whichever is its pivot."""
    met = pairs.groupBy(F.least("p", "u").alias("a"), F.greatest("p", "u").alias("b")).agg(F.min("p").alias("p"))
    return met.withColumn("u", F.when(F.col("p") == F.col("a"), F.col("b")).otherwise(F.col("a")))


def _pivot_pairs(lists: DataFrame, turn: int, percent: int) -> DataFrame:
    """In each list that has several components, a pivot with the members of other components.

    The first pivot is the set with the largest share of tokens left. Later turns take such a set from outside
    that one's component, so that each turn can gather one more cluster of the list.
    """
    best = F.min(F.struct((-F.col("rest") / F.col("n")).alias("l"), F.xxhash64("uid", F.lit(turn)).alias("h"), "uid", "n", "rest", "comp"))
    first = F.min(F.struct((-F.col("rest") / F.col("n")).alias("l"), F.xxhash64("uid", F.lit(0)).alias("h"), "comp"))["comp"]
    sizes = lists.groupBy("token").agg(first.alias("main"), best.alias("p"), F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.count(F.lit(1)).alias("_m")).filter("_lo < _hi")
    sizes = written(sizes.drop("_lo", "_hi"))
    rows = join_on_hot_keys(lists, sizes, "token", "_m")
    if turn:
        rows = written(rows.drop("p"))
        others = rows.filter("comp <> main").groupBy("token").agg(best.alias("p"), F.first("_m").alias("_m"))
        rows = join_on_hot_keys(rows.drop("_m"), written(others), "token", "_m")
    met = rows.filter((F.col("comp") != F.col("p.comp")) & _room("", "p.", percent))
    return _once(met.select(F.col("p.uid").alias("p"), F.col("uid").alias("u")))


def _remaining_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """All pairs of a list across two components: those outside its main component meet all others.

    A list of m members is dealt to ceil(m / BLOCK) blocks, and each two blocks (or one) meet by themselves.
    """
    sizes = lists.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("_k"))
    main = sizes.groupBy("token").agg(F.max(F.struct("_k", "comp")).alias("_main"), F.sum("_k").alias("_m"), F.count(F.lit(1)).alias("_c")).filter("_c > 1")
    met = join_on_hot_keys(lists, written(main.select("token", F.col("_main.comp").alias("main"), "_m")), "token", "_m")
    met = met.withColumn("_k", F.ceil(F.col("_m") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("uid", F.lit(5)), "_k").cast("int"))
    met = met.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    met = written(met.withColumns({"lo": F.least("own", "_other"), "hi": F.greatest("own", "_other")}).drop("_m", "_k", "_other"))
    x, y = met.filter("comp <> main").alias("x"), met.alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("token", "lo", "hi")]
    # Two rows of a block meet in its own unit only.
    here = (F.col("x.own") != F.col("y.own")) | (F.col("x.lo") == F.col("x.hi"))
    cond = reduce(Column.__and__, same) & here & (F.col("x.comp") != F.col("y.comp")) & _room("x.", "y.", percent)
    return _once(x.join(y, cond).select(F.col("x.uid").alias("p"), F.col("y.uid").alias("u")))


def _sparse(rows: DataFrame) -> DataFrame:
    """Of rows (uid, comp, t0) of larger components, comp of those whose order-0 lists hold at most SPARSE pairs a member."""
    lists = rows.select("comp", F.explode("t0").alias("token")).groupBy("comp", "token").agg(F.count(F.lit(1)).alias("_k"))
    pairs = lists.groupBy("comp").agg(F.sum(F.col("_k").cast("double") * (F.col("_k") - 1) / 2).alias("_pairs"))
    sizes = rows.groupBy("comp").agg(F.count(F.lit(1)).alias("_m"))
    return pairs.join(sizes, "comp").filter(F.col("_pairs") <= SPARSE * F.col("_m")).select("comp", "_m")


def _list_links(rows: DataFrame, prefixes: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """The links (p, u) of sparse components, from all pairs of their lists."""
    lists = written(rows.select("comp", "uid", "n", "live", F.posexplode("t0").alias("place", "token")).select("comp", "token", "uid", "n", (F.col("live") - F.col("place")).alias("rest")))
    x, y = lists.alias("x"), lists.alias("y")
    cond = (F.col("x.comp") == F.col("y.comp")) & (F.col("x.token") == F.col("y.token")) & (F.col("x.uid") < F.col("y.uid")) & _room("x.", "y.", percent)
    pairs = written(_once(x.join(y, cond).select(F.col("x.uid").alias("p"), F.col("y.uid").alias("u"))))
    return _links(_in_all_orders(pairs, prefixes, percent), reps, size, percent)


def _blocks(rows: DataFrame, comps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks: uid, block; units: x <= y, blocks that meet: all of a component). comps: (comp, _m, _parts)."""
    placed = join_on_hot_keys(rows.select("uid", "comp"), comps, "comp", "_m")
    blocks = written(placed.select("uid", F.xxhash64("comp", F.pmod(F.xxhash64("uid", F.lit(5)), "_parts")).alias("block")))
    each = comps.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    each = each.withColumn("j", F.explode(F.sequence(F.col("i"), F.col("_parts") - 1)))
    units = each.select(*(F.xxhash64("comp", F.col(k).cast("long")).alias(n) for k, n in (("i", "x"), ("j", "y"))))
    return blocks, written(units)


def _compare_unit(grams: np.ndarray, at: np.ndarray, side: np.ndarray, percent: int) -> np.ndarray:
    """Links between sets, as a square matrix of flags. side: 0 and 1 for two blocks that meet, or all 0 for one by itself."""
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    token, inverse, times = np.unique(grams, return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    inside = shared[inverse]
    row, col = row[inside], number[inverse[inside]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if side.any() else left
    place = np.zeros(len(n), np.int64)
    place[left], place[right] = np.arange(len(left)), np.arange(len(right))
    both = np.zeros((len(left), len(right)))
    width = min(WIDTH, int(shared.sum()))
    for first in range(0, int(shared.sum()), width or 1):
        i, j = np.searchsorted(col, [first, first + width])
        m = [np.zeros((len(k), width), np.float32) for k in ((left,) if right is left else (left, right))]
        for k, own in enumerate(m):
            mine = slice(i, j) if right is left else i + np.flatnonzero(side[row[i:j]] == k)
            own[place[row[mine]], col[mine] - first] = 1
        both += m[0] @ m[-1].T
    both = both.astype(np.int64)
    linked = (both > 0) & (100 * both >= percent * (n[left][:, None] + n[right][None, :] - both))
    out = np.zeros((len(n), len(n)), bool)
    out[np.ix_(left, right)] = linked
    out |= out.T
    np.fill_diagonal(out, False)
    return out


def _inner_links(labels: DataFrame, prefixes: DataFrame, reps: DataFrame, size: int, percent: int, pairs: bool = False) -> DataFrame:
    """uid, links: how many rows of other classes each class links to; or with pairs, the links (a, b), a < b, of classes.

    labels: (uid, comp, members). Blocks of a component meet in units, where the overlaps of all sets are one product
    of matrices; pairs are never rows, unless they are asked for and link. In a large component whose members share few
    lists, all pairs of lists are tested instead, being fewer.
    """
    rows = written(labels.select("uid", "comp").join(prefixes.select("uid", "n", "live", "t0"), "uid"))
    parts = F.greatest(F.ceil(F.col("_m") / BLOCK), F.ceil(F.col("_w") / WEIGHT)).cast("int")
    comps = written(rows.groupBy("comp").agg(F.count(F.lit(1)).alias("_m"), F.sum("n").alias("_w")).filter("_m > 1").select("comp", "_m", parts.alias("_parts")))
    many = comps.filter("_parts > 1")
    sparse = by_list = None
    if not many.isEmpty():
        large = written(join_on_hot_keys(rows, many, "comp", "_m").select(*rows.columns))
        sparse = written(_sparse(large))
        by_list = _list_links(written(join_on_hot_keys(large, sparse, "comp", "_m").select(*rows.columns)), prefixes, reps, size, percent)
        comps = written(comps.join(sparse, "comp", "left_anti"))
    blocks, units = _blocks(rows, comps)
    sides = written(units.select("x", "y", F.col("x").alias("block"), F.lit(0).alias("side")).union(units.filter("x <> y").select("x", "y", F.col("y").alias("block"), F.lit(1))))
    fan = written(sides.groupBy("block").agg(F.count(F.lit(1)).alias("_u")).withColumn("_parts", F.ceil(F.col("_u") / FAN).cast("int")))
    sides = join_on_hot_keys(sides, fan, "block", "_u").withColumn("salt", F.pmod(F.xxhash64("x", "y"), "_parts").cast("int"))
    members = blocks.join(fan, "block").join(labels.select("uid", "members"), "uid").join(reps.select("uid", "text"), "uid")
    members = members.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).select("block", "salt", "uid", "members", "text")
    rows = sides.select("x", "y", "block", "side", "salt").join(members, ["block", "salt"]).select("x", "y", "side", "uid", "members", "text")
    rows = rows.repartition("x", "y").sortWithinPartitions("x", "y")

    def found(held):
        side, uid, members = (np.concatenate([h[i] for h in held]) for i in range(3))
        sets = [g for h in held for g in h[3]]
        at = np.concatenate([[0], np.cumsum([len(g) for g in sets])]).astype(np.int64)
        linked = _compare_unit(np.concatenate(sets), at, side, percent)
        if pairs:
            i, j = np.nonzero(np.triu(linked))
            return np.minimum(uid[i], uid[j]), np.maximum(uid[i], uid[j])
        links = linked @ members
        return uid[links > 0], links[links > 0]

    names = ["a", "b"] if pairs else ["uid", "links"]

    def compare(batches):
        held, now, out = [], None, []

        def flush():
            done = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 2
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in done], names)

        for batch in batches:
            x, y, side, uid, members = (batch.column(i).to_numpy() for i in range(5))
            for first, last, grams, at in _sets(batch.column(5), size):
                begins = np.flatnonzero((np.diff(x[first:last]) != 0) | (np.diff(y[first:last]) != 0)) + 1 + first
                for i, j in zip([first, *begins], [*begins, last], strict=True):
                    if (x[i], y[i]) != now:
                        if held:
                            out.append(found(held))
                        held, now = [], (x[i], y[i])
                    held.append((side[i:j], uid[i:j], members[i:j], [grams[at[k - first] : at[k - first + 1]] for k in range(i, j)]))
            yield flush()
        if held:
            out.append(found(held))
        yield flush()

    by_block = rows.mapInArrow(compare, ", ".join(f"{c} long" for c in names))
    if by_list is not None:
        a, b = F.least("p", "u").alias("a"), F.greatest("p", "u").alias("b")
        both = by_list.select("p", "u").union(by_list.select("u", "p")).join(labels.select(F.col("uid").alias("u"), "members"), "u")
        by_block = by_block.union(by_list.select(a, b) if pairs else both.select("p", "members"))
    return written(by_block)


def _components(uids: DataFrame, prefixes: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """uid, comp of all classes: rounds of pivots, and at last all pairs that remain across components."""
    labels = uids.withColumn("comp", F.col("uid"))
    tested: DataFrame | None = None
    turn = 0
    while turn <= ROUNDS:
        lists = prefixes.select("uid", "n", "live", "t0").join(labels, "uid").select("uid", "n", "live", "comp", F.posexplode("t0").alias("place", "token"))
        lists = written(lists.select("token", "uid", "n", (F.col("live") - F.col("place")).alias("rest"), "comp"))
        pairs = _pivot_pairs(lists, turn, percent) if turn < ROUNDS else _remaining_pairs(lists, percent)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs)
        tested = pairs.select("a", "b") if tested is None else tested.union(pairs.select("a", "b"))
        links = _links(_in_all_orders(pairs, prefixes, percent), reps, size, percent)
        stuck = links.isEmpty()
        turn = ROUNDS if stuck and turn < ROUNDS else turn + 1  # without progress, on to all that remain
        if stuck:
            continue
        of = lambda k, v: labels.select(F.col("uid").alias(k), F.col("comp").alias(v))  # noqa: B023, E731
        roots = components(links.join(of("p", "u0"), "p").join(of("u", "v"), "u").select(F.col("u0").alias("u"), "v"))
        joined = labels.join(roots.withColumnRenamed("node", "comp"), "comp", "left")
        labels = written(joined.select("uid", F.coalesce("root", "comp").alias("comp")))
    return labels


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of df: doc_id, n_shingles, component_id, kept (one row of each component)."""
    return _labelled(df, id_col, text_col, size, percent).drop("uid", "n_links")


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of df: doc_id, n_shingles, component_id, n_links (rows that it links to)."""
    return _labelled(df, id_col, text_col, size, percent, count=True).drop("uid", "kept")


def _labelled(df: DataFrame, id_col: str, text_col: str, size: int, percent: int, uid_col: str | None = None, count: bool = False) -> DataFrame:
    """The rows of groups, with uid: the row's number, of uid_col if given; with count, also n_links."""
    docs = _prepare(df, id_col, text_col, size, percent, uid_col)
    open_ = docs.filter("digest is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("first")
    classes = written(open_.groupBy("digest").agg(F.min("uid").alias("rep"), first, F.count(F.lit(1)).alias("members"), F.first("n").alias("n")))
    reps = written(open_.join(classes.select(F.col("rep").alias("uid")), "uid").select("uid", "text"))
    prefixes = _prefixes(reps, classes.agg(F.sum("n")).first()[0] or 0, size, percent)
    labels = _components(classes.select(F.col("rep").alias("uid")), prefixes, reps, size, percent)

    labelled = classes.join(labels.withColumnRenamed("uid", "rep"), "rep")
    n_links = F.lit(None).cast("long")
    if count:
        links = _inner_links(written(labelled.select(F.col("rep").alias("uid"), "comp", "members")), prefixes, reps, size, percent)
        labelled = labelled.join(links.groupBy(F.col("uid").alias("rep")).agg(F.sum("links").alias("n_links")), "rep", "left")
        n_links = F.coalesce("n_links", F.lit(0).cast("long")) + F.col("members") - 1
    labelled = written(labelled.withColumn("n_links", n_links))
    best = labelled.groupBy("comp").agg(F.min("first").alias("best"), F.count(F.lit(1)).alias("_m"))
    of_class = join_on_hot_keys(written(labelled.select("digest", "members", "comp", "n_links")), written(best), "comp", "_m").select("digest", "members", "best", "n_links")
    met = join_on_hot_keys(open_.drop("text"), written(of_class), "digest", "members")
    alone = docs.filter("digest is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), "uid", F.lit(0).cast("long").alias("n_links"))
    return alone.union(met.select("doc_id", F.col("n").alias("n_shingles"), F.col("best.doc_id").alias("component_id"), (F.col("uid") == F.col("best.uid")).alias("kept"), "uid", "n_links"))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each component, whatever the ids; rows without words stay."""
    rows = written(df.withColumn("_gl_uid", F.monotonically_increasing_id()))
    dropped = _labelled(rows, id_col, text_col, 5, 80, "_gl_uid").filter("not kept").select(F.col("uid").alias("_gl_uid"))
    return rows.join(dropped, "_gl_uid", "left_anti").select(*df.columns)

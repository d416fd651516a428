"""Prefix tries of conversations from composable fingerprints.

The fingerprint of a sequence of turns is an element of a monoid: a polynomial hash together with a power of
its base, ``(h, w)``, and ``(h, w) . (k, v) = (h*v + k, w*v)`` for two sequences one behind the other. Every turn gets the
fingerprint of its conversation up to there by one distributed scan: tasks compose their own stretch of the
order, and only conversations that cross a border between tasks are composed further.

A rebuilt conversation is the head of another one followed by its own suffix. The fingerprints of its prefixes
follow from the products of the two by plain arithmetic on stored numbers; no rebuilt text exists anywhere.
Prefixes of one depth and fingerprint form a node. Each member refers to the stored turn that it ends with;
where a node has different references, the texts behind them are compared. Should two unlike prefixes
share a fingerprint, everything is computed again with other turn hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from priceforge.llm.corpus import shuffle_width
from priceforge.operators.joins import lookup_join
from priceforge.session import materialize

#: Two primes below 2**31, so that products fit a long, and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1812433253)
INVERSES = tuple(pow(b, -1, p) for b, p in zip(BASES, PRIMES))
#: Conversations of a family share the first turns of its first one, up to HEADS - 1 of them.
FAMILY, HEADS = 20, 4
ATTEMPTS = 4
#: Depths that one task sums at a time.
_STRETCH = 4096
_EMPTY = hashlib.sha256(b"").hexdigest()
_TURNS = (
    "conv_id long, part int, at long, h1 long, h2 long, w1 long, w2 long, t1 long, t2 long, words long, role string, text string"
)


def powers(base: int, prime: int, n: int) -> np.ndarray:
    """base**0 to base**(n - 1), modulo ``prime``."""
    out = np.ones(max(n, 1), dtype=np.int64)
    filled = 1
    while filled < n:
        more = min(filled, n - filled)
        out[filled : filled + more] = out[:more] * pow(base, filled, prime) % prime
        filled += more
    return out


def _scan(batches):
    """Position and running fingerprint of each turn within its conversation, as far as this task has it."""
    part = TaskContext.get().partitionId()
    last, carried_n, carried = None, 0, [(0, 1), (0, 1)]
    for batch in batches:
        size = batch.num_rows
        if not size:
            continue
        conv = batch.column(0).to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(np.diff(conv)) + 1])
        begin = np.repeat(starts, np.diff(np.concatenate([starts, [size]])))
        local = np.arange(size) - begin + 1
        goes_on = np.flatnonzero((begin == 0) & (conv == last)) if last is not None else np.zeros(0, dtype=np.int64)
        at = local.copy()
        at[goes_on] += carried_n
        hashes, weights = [], []
        for k, (base, prime) in enumerate(zip(BASES, PRIMES)):
            up = powers(base, prime, size + 1)
            down = powers(INVERSES[k], prime, size)
            t = batch.column(1 + k).to_numpy()
            sums = np.cumsum(t * down % prime) % prime
            before = np.where(begin > 0, sums[begin - 1], 0)
            h = (sums - before) % prime * up[:size] % prime
            w = up[local]
            h[goes_on] = (h[goes_on] + carried[k][0] * up[local[goes_on]]) % prime
            w[goes_on] = w[goes_on] * carried[k][1] % prime
            hashes.append(h)
            weights.append(w)
            carried[k] = (int(h[-1]), int(w[-1]))
        last, carried_n = conv[-1], int(at[-1])
        columns = [batch.column(0), pa.array(np.full(size, part, dtype=np.int32)), *map(pa.array, (at, *hashes, *weights))]
        names = [c.split()[0] for c in _TURNS.split(", ")]
        yield pa.RecordBatch.from_arrays([*columns, *(batch.column(i) for i in range(1, 6))], names=names)


def _composed(runs: pd.DataFrame) -> pd.DataFrame:
    """What stands before each task's stretch of one conversation; a row for each task that has a part of it."""
    n, state, out = 0, [(0, 1), (0, 1)], []
    for r in runs.sort_values("part").itertuples():
        out.append((r.conv_id, r.part, n, *(h for h, _ in state), *(w for _, w in state)))
        n += r.n
        state = [((h * w + k) % p, v * w % p) for (h, v), k, w, p in zip(state, (r.h1, r.h2), (r.w1, r.w2), PRIMES)]
    return pd.DataFrame(out, columns=["conv_id", "part", "n0", "g1", "g2", "b1", "b2"])


def ordered_turns(conversations: DataFrame, attempt: int = 0) -> DataFrame:
    """Every turn with its position ``pos`` from 1, fingerprint (f1, f2), weight (w1, w2), turn hash (t1, t2) and text."""
    turn = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    rows = conversations.select(
        F.col("`conv_id`").cast("long").alias("conv_id"), F.col("`turn`").cast("long").alias("turn"), *turn
    ).where(F.col("conv_id").isNotNull())
    hashes = [
        F.pmod(F.xxhash64(F.lit(2 * attempt + k), "role", "text"), F.lit(p).cast("long")).alias(f"t{k + 1}")
        for k, p in enumerate(PRIMES)
    ]
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")
    # The last column only parts equal rows, so that no single task has to take all of them.
    order = ["conv_id", "turn", "role", "text", "_row"]
    stored = materialize(
        rows.withColumn("_row", F.monotonically_increasing_id())
        .repartitionByRange(shuffle_width(conversations.sparkSession), *order)
        .sortWithinPartitions(*order)
        .select("conv_id", *hashes, words, "role", "text")
        .mapInArrow(_scan, _TURNS)
    )
    state = F.max_by(F.struct("h1", "h2", "w1", "w2"), "at").alias("s")
    runs = stored.groupBy("conv_id", "part").agg(F.max("at").alias("n"), state).select("conv_id", "part", "n", "s.*")
    several = runs.groupBy("conv_id").count().where("count > 1").select("conv_id")
    before = (
        runs.join(several, "conv_id")
        .groupBy("conv_id")
        .applyInPandas(_composed, "conv_id long, part int, n0 long, g1 long, g2 long, b1 long, b2 long")
    )
    # At most two rows for each task of the scan: those of the first and the last conversation it has.
    placed = stored.join(F.broadcast(before), ["conv_id", "part"], "left")
    f = [
        F.pmod(F.coalesce(f"g{k}", F.lit(0)) * F.col(f"w{k}") + F.col(f"h{k}"), F.lit(p)).alias(f"f{k}")
        for k, p in enumerate(PRIMES, 1)
    ]
    w = [F.pmod(F.coalesce(f"b{k}", F.lit(1)) * F.col(f"w{k}"), F.lit(p)).alias(f"w{k}") for k, p in enumerate(PRIMES, 1)]
    pos = (F.coalesce("n0", F.lit(0)) + F.col("at")).alias("pos")
    return placed.select("conv_id", pos, *f, *w, "t1", "t2", "words", "role", "text")


def _key(f1: Column, f2: Column) -> Column:
    return f1 * F.lit(1 << 31) + f2


def _parent(f: Column, t: Column, k: int) -> Column:
    """The fingerprint without its last turn."""
    return F.pmod(F.pmod(f - t, F.lit(PRIMES[k])) * F.lit(INVERSES[k]), F.lit(PRIMES[k]))


def rebuilt_prefixes(turns: DataFrame) -> DataFrame:
    """A row for each prefix of each rebuilt conversation, the empty one included.

    conv_id, depth, f, g (key of the prefix and of the one before), ref_conv and ref_pos (the stored turn it
    ends with), words of that turn, is_end.
    """
    heads = turns.groupBy("conv_id").agg(
        F.max("pos").alias("n"),
        *[F.max(F.when(F.col("pos") == i, F.struct("f1", "f2", "t1", "t2", "words"))).alias(f"s{i}") for i in range(1, HEADS)],
    )
    heads = materialize(heads)
    base = heads.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), *[F.col(f"s{i}").alias(f"b{i}") for i in range(1, HEADS)])
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    convs = (
        heads.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
        .join(base, "base", "left")
        .withColumn("h", taken)
        .withColumn("hb", F.least("h", F.coalesce("base_n", F.lit(0))))
        .withColumn("length", F.col("hb") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    )

    def at(prefix: str, which: str, name: str) -> Column:
        found = F.lit(0).cast("long")
        for i in range(1, HEADS):
            found = F.when(F.col(which) == i, F.col(f"{prefix}{i}.{name}")).otherwise(found)
        return found

    head = F.explode(
        F.filter(
            F.array(*[F.struct(F.lit(i).cast("long").alias("depth"), F.col(f"b{i}").alias("s")) for i in range(1, HEADS)]),
            lambda x: x["depth"] <= F.col("hb"),
        )
    )
    shared = convs.select("conv_id", "base", "length", head.alias("x")).select(
        "conv_id", "length", F.col("x.depth").alias("depth"), "x.s.*", F.col("base").alias("ref_conv"), F.col("x.depth").alias("ref_pos")
    )
    # The head's product and the product of the own turns that the head replaces.
    own = convs.where("n > h").select(
        "conv_id", "length", "h", "hb", *[(at("b", "hb", f"f{k}") - at("s", "h", f"f{k}")).alias(f"x{k}") for k in (1, 2)]
    )
    back = [[pow(inverse, i, p) for i in range(HEADS)] for inverse, p in zip(INVERSES, PRIMES)]

    def behind(k: int) -> Column:
        """Base head, then the own turns behind the first ``h``: (head - replaced) * w**m + own, m turns behind them."""
        p = F.lit(PRIMES[k])
        shift = F.element_at(F.array(*[F.lit(v).cast("long") for v in back[k]]), F.col("h").cast("int") + 1)
        weight = F.pmod(F.col(f"w{k + 1}") * shift, p)
        return F.pmod(F.pmod(F.col(f"x{k + 1}"), p) * weight + F.col(f"f{k + 1}"), p)

    suffix = (
        turns.drop("role", "text")
        .join(own, "conv_id")
        .where("pos > h")
        .select(
            "conv_id", "length", (F.col("hb") + F.col("pos") - F.col("h")).alias("depth"), behind(0).alias("f1"), behind(1).alias("f2"),
            "t1", "t2", "words", F.col("conv_id").alias("ref_conv"), F.col("pos").alias("ref_pos"),
        )
    )
    ends = (F.col("depth") == F.col("length")).alias("is_end")
    prefixes = shared.unionByName(suffix).select(
        "conv_id", "depth", _key(F.col("f1"), F.col("f2")).alias("f"),
        _key(_parent(F.col("f1"), F.col("t1"), 0), _parent(F.col("f2"), F.col("t2"), 1)).alias("g"), "ref_conv", "ref_pos", "words", ends,
    )
    nothing = F.lit(None).cast("long")
    root = convs.select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("f"), nothing.alias("g"), nothing.alias("ref_conv"),
        nothing.alias("ref_pos"), F.lit(0).cast("long").alias("words"), (F.col("length") == 0).alias("is_end"),
    )
    return materialize(prefixes.unionByName(root))


def unlike_members(turns: DataFrame, members: DataFrame, nodes: DataFrame) -> bool:
    """Whether some node has members that end with unlike turns, by the texts that they refer to."""
    mixed = nodes.where("ref <> other_ref").select("depth", "f", "ref")
    pairs = materialize(
        members.select("depth", "f", F.struct("ref_conv", "ref_pos").alias("own"))
        .join(mixed, ["depth", "f"])
        .where("own <> ref")
        .select("own", "ref")
        .distinct()
    )
    if pairs.isEmpty():
        return False
    stored = turns.select(F.struct("conv_id", "pos").alias("at"), F.struct("role", "text").alias("turn"))
    own = pairs.join(stored.select(F.col("at").alias("own"), F.col("turn").alias("mine")), "own")
    both = own.join(stored.select(F.col("at").alias("ref"), F.col("turn").alias("theirs")), "ref")
    return not both.where("mine <> theirs").isEmpty()


def _chunks(batches):
    """Ids of one node that follow each other in a batch as one text."""
    for batch in batches:
        depth, f, conv = (batch.column(i).to_numpy() for i in range(3))
        if not len(conv):
            continue
        starts = np.concatenate([[0], np.flatnonzero((np.diff(depth) != 0) | (np.diff(f) != 0)) + 1])
        ends = np.concatenate([starts[1:], [len(conv)]])
        text = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(starts, ends)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(depth[starts]), pa.array(f[starts]), pa.array(conv[starts]), pa.array(text)], names=["depth", "f", "first", "ids"]
        )


def _digests(batches):
    """One digest for each node; its texts come in order and are dropped once they are hashed."""
    node, digest = None, None

    def done():
        columns = [pa.array([node[0]]), pa.array([node[1]]), pa.array([digest.hexdigest()])]
        return pa.RecordBatch.from_arrays(columns, names=["depth", "f", "ends_sha256"])

    for batch in batches:
        for depth, f, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
            if (depth, f) != node:
                if node is not None:
                    yield done()
                node, digest = (depth, f), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
    if node is not None:
        yield done()


def _ends(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Digest of the ids that end at a node, for nodes at which several end."""
    several = nodes.where("n_ends > 1").select("depth", "f")
    ends = members.where("is_end").select("depth", "f", "conv_id").join(several, ["depth", "f"])
    width = shuffle_width(members.sparkSession)
    order = ["depth", "f", "conv_id"]
    chunks = (
        ends.repartitionByRange(width, *order)
        .sortWithinPartitions(*order)
        .mapInArrow(_chunks, "depth long, f long, first long, ids string")
    )
    # A digest reads its text in order, so a node's texts meet in one task; it keeps none of them.
    return (
        chunks.repartition(width, "depth", "f")
        .sortWithinPartitions("depth", "f", "first")
        .mapInArrow(_digests, "depth long, f long, ends_sha256 string")
    )


def _spent_above(nodes: DataFrame) -> DataFrame:
    """For each node what the nodes above it that have the same smallest member save by themselves."""
    cells = nodes.select("conv_id", "depth", "f", "own", F.floor(F.col("depth") / _STRETCH).alias("stretch"))
    above = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = cells.groupBy("conv_id", "stretch").agg(F.sum("own").alias("own"))
    earlier = totals.select("conv_id", "stretch", F.coalesce(F.sum("own").over(above), F.lit(0)).alias("earlier"))
    within = Window.partitionBy("conv_id", "stretch").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    return (
        cells.withColumn("here", F.coalesce(F.sum("own").over(within), F.lit(0)))
        .join(earlier, ["conv_id", "stretch"])
        .select("depth", "f", (F.col("earlier") + F.col("here")).alias("spent"))
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn, null first, then by role and text; a null role or text is empty. Rows
    without conv_id are left out. The family of a conversation starts at ``conv_id - conv_id % 20`` with the sign of SQL's
    remainder. Repeated rows are turns of their own. An empty table has no node, not even the root.
    Other columns are not looked at.
    """
    for attempt in range(ATTEMPTS):
        turns = ordered_turns(conversations, attempt)
        members = rebuilt_prefixes(turns)
        nodes = materialize(
            members.groupBy("depth", "f").agg(
                F.count(F.lit(1)).alias("n_convs"),
                F.min("conv_id").alias("conv_id"),
                F.min("g").alias("g"),
                F.min(F.struct("ref_conv", "ref_pos")).alias("ref"),
                F.max(F.struct("ref_conv", "ref_pos")).alias("other_ref"),
                F.min("words").alias("words"),
                F.count_if("is_end").alias("n_ends"),
                F.min(F.when(F.col("is_end"), F.col("conv_id"))).alias("first_end"),
            )
        )
        if not unlike_members(turns, members, nodes):
            return _summed(members, nodes)
    raise RuntimeError(f"unlike prefixes shared a fingerprint {ATTEMPTS} times")


def _summed(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sums over subtrees without walking the tree.

    The members of a node whose smallest node is a leaf, or that are the smallest member of nodes below, stand for
    those nodes: each leaf and each node is counted by exactly one member of every node above it.
    """
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("g").alias("f")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    counted = materialize(
        nodes.join(children, ["depth", "f"], "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
        .withColumn("own", (F.col("n_convs") - 1) * F.col("words"))
    )
    stands_for = counted.groupBy("conv_id").agg(
        F.sum("own").alias("saved"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf")
    )
    sums = (
        members.select("conv_id", "depth", "f")
        .join(stands_for, "conv_id")
        .groupBy("depth", "f")
        .agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("n_leaves"))
    )
    above = counted.select((F.col("depth") + 1).alias("depth"), F.col("f").alias("g"), F.col("conv_id").alias("parent_conv_id"))
    # A node may have very many children, so the side of the children is salted.
    named = lookup_join(counted, above, ["depth", "g"], ["f"])
    only = F.when(F.col("n_ends") == 0, F.lit(_EMPTY)).otherwise(F.sha2(F.col("first_end").cast("string"), 256))
    return (
        named.join(sums, ["depth", "f"])
        .join(_spent_above(counted), ["depth", "f"])
        .join(_ends(members, nodes), ["depth", "f"], "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
            (F.col("saved") - F.col("spent")).alias("saved_tokens"), F.coalesce("ends_sha256", only).alias("ends_sha256"),
        )
    )

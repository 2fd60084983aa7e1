"""Prefix trie of conversations: every shared opening of turns once, with what a prefix cache would save.

A conversation's turns become positional columns, ``WIDTH`` to a row: one row per conversation and block of turns. A SQL
``ROLLUP`` over these columns aggregates all prefixes of a block in one pass, ``grouping_id`` tells their length. Longer
conversations go on in further blocks, whose rows are keyed by the node that the block before ended at; a node is named by
its depth and the exclusive or of two 64-bit hashes of (turn, place), so all blocks are rolled up at once.

Sums over subtrees are sums over members. The least conversation through a node owns it, and owns all nodes below on its
path, so per conversation it is enough to know the depth ``owned`` from which it owns its path:

* a node's children are its members that own their node one deeper,
* childless nodes below are members that end, as owners, where nobody goes on,
* the words saved below a node are, for each member, its words between the node and its first owned node.

The first rollup finds the owners, the second takes these sums.

Nothing whole meets in one task: turns are put in order by range partitions with offsets of the partitions; running
values of a long conversation are carried in pieces of ``PIECE`` turns; conversations and parents that hold over a
thousandth of a table (a thousand rows at most) are joined by broadcast, the others by a shuffle. The ids of the
conversations that end at a node are joined into pieces of text by range partitions, so the one task that must hash them in
order reads a few long rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.session import materialize

WIDTH = 8
#: Turns of a conversation whose running values are carried together; a multiple of WIDTH.
PIECE = 1024
#: Conversations of a family: all take their first turns from the family's first one.
FAMILY = 20
#: At most so many rows are more than the (1 / HEAVY)th part of a whole.
HEAVY = 1000
#: Characters of joined ids in one piece of text.
TEXT = 4_096
NODE = ("depth", "k1", "k2")
WORD_BREAK = r"[\x20\x09-\x0D]+"


def turn_ids(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, what orders equal turns (role_, text_, digest), a 128-bit turn id (i1, i2) and words.

    Rows without a conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.substring(role, 1, 32).alias("role_"),
        F.substring(text, 1, 32).alias("text_"),
        digest.alias("digest"),
        F.size(F.filter(F.split(text, WORD_BREAK), lambda w: w != "")).cast("long").alias("words"),
    )
    half = lambda at: F.conv(F.substring("digest", at, 16), 16, -10).cast("long")
    return rows.withColumns({"i1": half(1), "i2": half(17)})


def places(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), i1, i2, words, total: each turn's place in its conversation.

    Turns are ordered by ``turn`` (null first); equal ones by the first 32 characters of role and text, then by the digest
    of both. Equal rows stay, one after the other.
    """
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), "role_", "text_", "digest"]
    rows = turn_ids(conversations).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialize(
        rows.withColumn("at", F.monotonically_increasing_id()).select("conv_id", "at", "i1", "i2", "words"), "trie-turns"
    ).withColumn("part", F.shiftright("at", 33))
    inside = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        rows.groupBy("conv_id", "part")
        .agg(F.min("at").alias("first"), F.count("*").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .withColumn("total", F.sum("n").over(Window.partitionBy("conv_id")))
    )
    return rows.join(parts, ["conv_id", "part"]).select(
        "conv_id", (F.col("before") + F.col("at") - F.col("first")).alias("place"), "i1", "i2", "words", "total"
    )


def rebuild(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with their first turns taken from the first of their family.

    Conversation c takes the first h turns of conversation c - c % 20 (all if there are fewer, none if it is absent)
    in place of its own first h, with h = crc32(c as text) % 4. Remainders of negative ids are negative, as in SQL.
    Returns (conv_id, place, i1, i2, words) and (conv_id, len), the latter also for conversations left without a turn.
    """
    taken = F.crc32(F.col("conv_id").cast("string")) % 4
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    rows = materialize(places(conversations).withColumn("h", taken), "trie-places")
    totals = rows.groupBy("conv_id").agg(F.max("total").alias("total"))
    base = totals.select(F.col("conv_id").alias("base"), F.col("total").alias("most"))
    convs = totals.withColumns({"base": family, "h": taken}).join(base, "base", "left").withColumn(
        "head", F.least(F.col("h"), F.coalesce("most", F.lit(0)))
    )
    convs = materialize(
        convs.select(
            "conv_id", "base", "h", "head", (F.col("head") + F.greatest(F.col("total") - F.col("h"), F.lit(0))).alias("len"), "total"
        ),
        "trie-conversations",
    )
    # A head shorter than h only ever belongs to a short or absent first conversation.
    shorter = convs.where("head < h").select("conv_id", (F.col("h") - F.col("head")).alias("gap"))
    own = by_size(rows.where("place >= h"), shorter, convs.select("conv_id", "total"))
    own = own.select("conv_id", (F.col("place") - F.coalesce("gap", F.lit(0))).alias("place"), "i1", "i2", "words")
    first = rows.where((F.col("conv_id") == family) & (F.col("place") < 3)).select(
        F.col("conv_id").alias("base"), "place", "i1", "i2", "words"
    )
    heads = convs.select("conv_id", "base", "h").join(first, "base").where("place < h")
    return own.unionByName(heads.select("conv_id", "place", "i1", "i2", "words")), convs.select("conv_id", "len")


def by_size(rows: DataFrame, small: DataFrame, sizes: DataFrame) -> DataFrame:
    """``rows`` left join ``small`` on conv_id, where ``sizes`` says how many rows a conversation may have.

    Those over a thousandth of all are at most a thousand: their rows of ``small`` are broadcast, the rest is shuffled.
    """
    size = next(c for c in sizes.columns if c != "conv_id")
    limit = (sizes.agg(F.sum(size)).first()[0] or 0) / HEAVY
    large = sizes.where(F.col(size) > max(limit, PIECE)).select("conv_id")
    ids = F.broadcast(large)
    hot = rows.join(ids, "conv_id", "left_semi").join(F.broadcast(small.join(ids, "conv_id", "left_semi")), "conv_id", "left")
    return hot.unionByName(rows.join(ids, "conv_id", "left_anti").join(small, "conv_id", "left"))


def blocks(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per conversation and block of WIDTH turns.

    conv_id, len, all_words, block, k1, k2 (the node before the block), before (words before it), and per turn of the
    block a1, b1, w1, a2, ...: id and words, null behind the end. A conversation without turns has one row of nulls.
    """
    place = F.col("place")
    hashed = rows.withColumns(
        {"piece": F.floor(place / PIECE), "x1": F.xxhash64("i1", "i2", "place"), "x2": F.xxhash64("place", "i2", "i1")}
    )
    piece = Window.partitionBy("conv_id", "piece")
    path = piece.orderBy("place")
    done = path.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    columns = {
        "k1": F.coalesce(F.bit_xor("x1").over(done), zero),
        "k2": F.coalesce(F.bit_xor("x2").over(done), zero),
        "before": F.coalesce(F.sum("words").over(done), zero),
        "e1": F.bit_xor("x1").over(piece),
        "e2": F.bit_xor("x2").over(piece),
        "all_words": F.sum("words").over(piece),
        "last": F.max("place").over(piece),
    }
    for j in range(WIDTH):
        for name, source in (("a", "i1"), ("b", "i2"), ("w", "words")):
            columns[f"{name}{j + 1}"] = F.lead(source, j).over(path) if j else F.col(source)
    turns = [f"{name}{j + 1}" for j in range(WIDTH) for name in "abw"]
    cut = hashed.select("conv_id", "piece", "place", *(c.alias(n) for n, c in columns.items())).where(place % WIDTH == 0)
    cut = materialize(cut.withColumn("block", F.floor(place / WIDTH)).drop("place"), "trie-pieces")
    # Conversations of one piece need nothing carried.
    carried = cut.where("block % {0} = 0".format(PIECE // WIDTH)).groupBy("conv_id", "piece").agg(
        *(F.max(c).alias(c) for c in ("e1", "e2", "all_words", "last"))
    )
    whole = Window.partitionBy("conv_id")
    run = whole.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    long_ids = carried.where("piece > 0").select("conv_id").distinct()
    carried = carried.join(long_ids, "conv_id", "left_semi").select(
        "conv_id",
        "piece",
        F.coalesce(F.bit_xor("e1").over(run), zero).alias("c1"),
        F.coalesce(F.bit_xor("e2").over(run), zero).alias("c2"),
        F.coalesce(F.sum("all_words").over(run), zero).alias("c3"),
        F.sum("all_words").over(whole).alias("c4"),
        (F.max("last").over(whole) + 1).alias("c5"),
    )
    filled = cut.join(carried, ["conv_id", "piece"], "left").select(
        "conv_id",
        F.coalesce("c5", F.col("last") + 1).alias("len"),
        F.coalesce("c4", "all_words").alias("all_words"),
        "block",
        F.col("k1").bitwiseXOR(F.coalesce("c1", zero)).alias("k1"),
        F.col("k2").bitwiseXOR(F.coalesce("c2", zero)).alias("k2"),
        (F.col("before") + F.coalesce("c3", zero)).alias("before"),
        *turns,
    )
    none = convs.where("len = 0").select(
        "conv_id", "len", *(zero.alias(c) for c in ("all_words", "block", "k1", "k2", "before")),
        *(F.lit(None).cast("long").alias(c) for c in turns),
    )
    return filled.unionByName(none)


def _turn_hash(j: int, order: str) -> str:
    """The hash of turn j of a block at its place; nothing where the conversation has ended."""
    parts = {"1": f"a{j}, b{j}, block * {WIDTH} + {j - 1}", "2": f"block * {WIDTH} + {j - 1}, b{j}, a{j}"}[order]
    return f"if(a{j} IS NULL, 0L, xxhash64({parts}))"


def _key(order: str, upto: int = WIDTH) -> str:
    return " ^ ".join([f"k{order}", *(_turn_hash(j, order) for j in range(1, upto + 1))])


def _last_hash(order: str) -> str:
    return f"CASE {_LEVEL} " + " ".join(f"WHEN {j} THEN {_turn_hash(j, order)}" for j in range(1, WIDTH + 1)) + " ELSE 0L END"


_LEVEL = f"({WIDTH} - bit_count(grouping_id()) div 2)"
#: Words of the turns before the last one of a prefix, from the block's own columns.
_WORDS_BEFORE = (
    "before + CASE {level} WHEN 0 THEN 0L ".format(level=_LEVEL)
    + " ".join(f"WHEN {j} THEN {' + '.join(['0L', *(f'w{i}' for i in range(1, j))])}" for j in range(1, WIDTH + 1))
    + " END"
)
_LAST_WORDS = f"CASE {_LEVEL} " + " ".join(f"WHEN {j} THEN w{j}" for j in range(1, WIDTH + 1)) + " END"
_THERE = f"CASE {_LEVEL} WHEN 0 THEN block = 0 " + " ".join(f"WHEN {j} THEN a{j} IS NOT NULL" for j in range(1, WIDTH + 1)) + " END"
_DEPTH = f"block * {WIDTH} + {_LEVEL}"


def _rollup(rows: DataFrame, aggregates: str) -> DataFrame:
    """``aggregates`` for each prefix of each block; prefixes that end behind a conversation's last turn are none."""
    columns = ", ".join(f"(a{j}, b{j})" for j in range(1, WIDTH + 1))
    return rows.sparkSession.sql(
        f"""SELECT {_DEPTH} AS depth, {_key("1")} AS k1, {_key("2")} AS k2,
                   {_last_hash("1")} AS h1, {_last_hash("2")} AS h2,
                   {_THERE} AS there, {aggregates}
            FROM {{rows}} GROUP BY block, k1, k2, ROLLUP({columns})""",
        rows=rows,
    ).where("there").drop("there")


def owners(rows: DataFrame) -> DataFrame:
    """conv_id, owned (depth of its first own node), shared_words (of its turns before that), leaf (ends a path)."""
    nodes = _rollup(
        rows, f"min(conv_id) AS conv_id, max(len) = {_DEPTH} AS childless, max({_WORDS_BEFORE}) AS words_before"
    )
    return nodes.groupBy("conv_id").agg(
        F.min("depth").alias("owned"),
        F.min("words_before").alias("shared_words"),
        F.max("childless").alias("leaf"),
    )


def nodes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """All nodes with their sums; ``owned`` is the depth from which conv_id owns its path."""
    rows = by_size(rows, materialize(owners(rows), "trie-owners"), convs)
    # A conversation that owns no node shares every turn.
    rows = rows.withColumns(
        {
            "owned": F.coalesce("owned", F.col("len") + 1),
            "shared_words": F.coalesce("shared_words", "all_words"),
            "leaf": F.coalesce("leaf", F.lit(False)),
        }
    )
    found = _rollup(
        rows,
        f"""min(conv_id) AS conv_id, count(*) AS n_convs,
            count_if(owned <= {_DEPTH} + 1 AND len > {_DEPTH}) AS n_children,
            count_if(leaf) AS n_leaves,
            sum(if(owned > {_DEPTH}, shared_words - ({_WORDS_BEFORE}), 0L)) AS saved_tokens,
            max(if(owned <= {_DEPTH}, owned, NULL)) AS owned,
            max({_LAST_WORDS}) AS last_words""",
    )
    return found


def _join_ids(batches):
    """From sorted (k1, k2, depth, conv_id): the ids of each node joined by commas, in pieces."""
    key, first = None, None
    ids: list = []
    out: list = []
    size = 0

    def flush():
        nonlocal ids, size
        if ids:
            out.append((*key, first, ",".join(map(str, ids))))
        ids, size = [], 0

    def batch():
        rows = list(zip(*out)) if out else [[]] * 5
        out.clear()
        names = ("k1", "k2", "depth", "first", "ids")
        kinds = (pa.int64(),) * 4 + (pa.string(),)
        return pa.record_batch({n: pa.array(r, k) for n, r, k in zip(names, rows, kinds)})

    for part in batches:
        for *at, conv in zip(*(part.column(c).to_pylist() for c in ("k1", "k2", "depth", "conv_id"))):
            if at != key or size >= TEXT:
                flush()
                key, first = at, conv
            ids.append(conv)
            size += len(str(conv)) + 1
        if len(out) >= 1000:
            yield batch()
    flush()
    yield batch()


def _hash_ids(batches):
    """From pieces in order: the SHA-256 of each node's joined ids."""
    key, state = None, None
    done: list = []

    def batch():
        rows = list(zip(*done)) if done else [[]] * 4
        done.clear()
        kinds = (pa.int64(),) * 3 + (pa.string(),)
        return pa.record_batch({n: pa.array(r, k) for n, r, k in zip(("k1", "k2", "depth", "ends_sha256"), rows, kinds)})

    for part in batches:
        for *at, ids in zip(*(part.column(c).to_pylist() for c in ("k1", "k2", "depth", "ids"))):
            if at == key:
                state.update(b",")
            else:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = at, hashlib.sha256()
            state.update(ids.encode())
        if done:
            yield batch()
    if key is not None:
        done.append((*key, state.hexdigest()))
    yield batch()


def ends(rows: DataFrame) -> DataFrame:
    """depth, k1, k2, ends_sha256 of the nodes at which conversations end."""
    last = rows.where(F.expr(f"block = greatest(len - 1, 0L) div {WIDTH}")).selectExpr(
        f"{_key('1')} AS k1", f"{_key('2')} AS k2", "len AS depth", "conv_id"
    )
    order = ("k1", "k2", "depth", "conv_id")
    pieces = last.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _join_ids, "k1 long, k2 long, depth long, first long, ids string"
    )
    return (
        pieces.repartition("k1", "k2", "depth")
        .sortWithinPartitions("k1", "k2", "depth", "first")
        .mapInArrow(_hash_ids, "k1 long, k2 long, depth long, ends_sha256 string")
    )


def parents(found: DataFrame) -> DataFrame:
    """depth, k1, k2, parent_conv_id of the nodes whose parent another conversation owns.

    Parents of over a thousandth of all nodes are at most a thousand and are broadcast.
    """
    tops = found.where("depth > 0 AND depth = owned").select(
        *NODE,
        (F.col("depth") - 1).alias("up"),
        F.col("k1").bitwiseXOR(F.col("h1")).alias("u1"),
        F.col("k2").bitwiseXOR(F.col("h2")).alias("u2"),
    )
    above = found.where("n_children > 0").select(
        F.col("depth").alias("up"), F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("conv_id").alias("parent_conv_id"), "n_children"
    )
    large = F.col("n_children") > max(found.count() / HEAVY, PIECE)
    first = tops.join(F.broadcast(above.where(large).drop("n_children")), ["up", "u1", "u2"], "left")
    rest = first.where("parent_conv_id IS NULL").drop("parent_conv_id").join(above.where(~large).drop("n_children"), ["up", "u1", "u2"])
    return first.where("parent_conv_id IS NOT NULL").unionByName(rest).select(*NODE, "parent_conv_id")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of the trie over ``turns`` (conv_id, place, i1, i2, words) of ``convs`` (conv_id, len).

    conv_id (the least member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256 and last_words (words of the node's own text, null for the root). Without conversations there is no root.
    """
    rows = materialize(blocks(turns, convs), "trie-blocks")
    found = materialize(nodes(rows, convs), "trie-nodes")
    key = list(NODE)
    whole = found.join(parents(found), key, "left").join(ends(rows), key, "left")
    return whole.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > F.col("owned"), F.col("conv_id")).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        "last_words",
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of a table conv_id, turn, role, text.

    Null roles and texts are empty; rows without a conv_id are left out; repeated rows are turns of their own; ties are
    ordered as in ``places``; other columns are not used; an empty table has no node. Texts count by their words,
    whatever their length: only ids and counts are shuffled.
    """
    return trie(*rebuild(conversations))

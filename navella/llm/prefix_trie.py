"""The trie of all conversations' prefixes, by Spark SQL's ROLLUP over columns of turns.

A conversation is laid out in rows of ``COLUMNS`` turns. Each row is keyed by its block's number and the node at which the
block before it ends, so one ROLLUP over the turn columns within these keys gives every prefix of every length at once, and
grouping_id tells its depth; a conversation of any length is so many rows more, never a further job. A turn is named by
128 bits of the SHA-256 of its role and text; a node by four sums over its turns of 32-bit parts of a hash of place and
turn, which can be added up within a conversation in any grouping.

What a subtree holds is added up over members instead of nodes, so no pass runs level by level: each node belongs to its
smallest member, and those that a conversation owns are the end of its path. The first ROLLUP finds the owners, the
second adds up, for each prefix, the words of its members and of what they own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navella.llm.shared import numbered, stored

COLUMNS = 8
#: Blocks, or turns, of one conversation that are added up together, before the sums are.
SPAN = 4096
#: Characters of an ends list's piece.
PIECE = 1 << 20
#: Parents of more than this part of all nodes are so few that their rows can be broadcast.
HOT = 1000
SUMS = ("a", "b", "c", "d")
TURNS = [f"t{j}" for j in range(COLUMNS)]


def hashes(place: Column, turn: Column) -> list[Column]:
    """Four numbers below 2**32 of a turn at a place."""
    parts = []
    for seed in (1, 2):
        h = F.xxhash64(F.lit(seed), place.cast("long"), turn)
        parts += [F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF))]
    return parts


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, id and words of every row of a conversation; null role or text is empty."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    named = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    words = F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), 0)).cast("long")
    rows = conversations.filter(F.col("conv_id").isNotNull())
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.substring(named, 1, 32)).alias("id"), words.alias("words"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, q, id, words, size) of the turns of rebuilt conversations, and (conv_id, size) of all of these. A conversation c
    opens with the first h turns of c - c % 20, h = crc32(c) % 4, and goes on with its own after its first h."""
    rows = numbered(turns, "conv_id", ["turn", "id"], "ordered-turns")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("long")
    firsts = rows.filter("place < 3").select(F.col("conv_id").alias("base"), "place", "id", "words", F.col("total").alias("base_total"))
    convs = rows.filter("place = 0").select("conv_id", "total", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 20).alias("base"))
    convs = convs.join(firsts.filter("place = 0").select("base", "base_total"), "base", "left")
    taken = F.least("h", F.coalesce("base_total", F.lit(0)))
    convs = stored(convs.select("conv_id", "base", "total", "h", taken.alias("taken"), (taken + F.greatest(F.col("total") - F.col("h"), F.lit(0))).alias("size")), "rebuilt-sizes")
    opening = convs.join(firsts, "base").filter("place < h").select("conv_id", F.col("place").alias("q"), "id", "words", "size")
    spans = convs.select("conv_id", "h", "taken", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / SPAN))).alias("span"))
    own = rows.withColumn("span", F.floor(F.col("place") / SPAN)).join(spans, ["conv_id", "span"]).filter("place >= h")
    own = own.select("conv_id", (F.col("taken") + F.col("place") - F.col("h")).alias("q"), "id", "words", "size")
    return opening.unionByName(own), convs.select("conv_id", "size")


def blocks_of(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each COLUMNS turns of a conversation (and one for each without any): conv_id, block, size, all_words (of the
    whole conversation), the four sums and the words of the turns before the block, and the block's turns, each its id
    and words."""
    q = F.col("q")
    sums = {s: F.sum(h).alias(s) for s, h in zip(SUMS, hashes(q, F.col("id")), strict=True)}
    slots = [F.max(F.when(q % COLUMNS == j, F.struct("id", "words"))).alias(t) for j, t in enumerate(TURNS)]
    found = turns.groupBy("conv_id", F.floor(q / COLUMNS).alias("block")).agg(F.max("size").alias("size"), F.sum("words").alias("w"), *sums.values(), *slots)
    empty = convs.filter("size = 0").withColumns({"block": F.lit(0).cast("long"), "w": F.lit(0).cast("long"), **{s: F.lit(0).cast("long") for s in SUMS}})
    found = stored(found.unionByName(empty, allowMissingColumns=True).withColumn("span", F.floor(F.col("block") / SPAN)), "turn-blocks")
    kept = ("w", *SUMS)
    spans = found.groupBy("conv_id", "span").agg(*(F.sum(c).alias(f"_{c}") for c in kept))
    in_conv, in_span = Window.partitionBy("conv_id"), Window.partitionBy("conv_id", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = in_conv.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0)
    spans = spans.select("conv_id", "span", F.sum("_w").over(in_conv).alias("all_words"), *(F.coalesce(F.sum(f"_{c}").over(earlier), none).alias(f"_{c}") for c in kept))
    before = {c: F.coalesce(F.sum(c).over(in_span), none) for c in kept}
    rows = found.select("conv_id", "span", "block", "size", *TURNS, *(v.alias(c) for c, v in before.items())).join(spans, ["conv_id", "span"])
    return stored(rows.select("conv_id", "block", "size", "all_words", (F.col("w") + F.col("_w")).alias("w"), *((F.col(s) + F.col(f"_{s}")).alias(s) for s in SUMS), *TURNS), "turn-blocks")


def rolled(blocks: DataFrame, aggregates: str) -> DataFrame:
    """Every node once: block, the sums and words before it (w), its turns in the block, depth, kept (how many of the
    turn columns are its), before (words of the turns above its last one), words (of that one), and the aggregates over
    the rows of its members."""
    keys = ", ".join(("block", *SUMS, "w"))
    turns = ", ".join(TURNS)
    found = blocks.sparkSession.sql(f"select {keys}, {turns}, cast({COLUMNS} - bit_count(grouping_id()) as int) as kept, {aggregates} from {{rows}} group by {keys}, rollup ({turns})", rows=blocks)
    last = F.get(F.array(*TURNS), F.col("kept") - 1)
    node = F.when(F.col("kept") == 0, F.col("block") == 0).otherwise(last.isNotNull())  # beyond a conversation's end there is none
    words = F.coalesce(last["words"], F.lit(0))
    through = sum((F.when(F.col("kept") > j, F.col(t)["words"]).otherwise(0) for j, t in enumerate(TURNS)), F.col("w"))
    return found.filter(node).withColumns({"depth": F.col("block") * COLUMNS + F.col("kept"), "words": words, "before": through - words})


def name_of(kept: Column) -> Column:
    """The name of the node at the first kept turns of a row."""
    parts = []
    added = [hashes(F.col("block") * COLUMNS + j, F.col(t)["id"]) for j, t in enumerate(TURNS)]
    for k, s in enumerate(SUMS):
        parts.append(sum((F.when(kept > j, added[j][k]).otherwise(0) for j in range(COLUMNS)), F.col(s)))
    return F.concat_ws(".", *parts)


def ends(blocks: DataFrame) -> DataFrame:
    """(name, ends_sha256) of every node at which conversations end: of their ids in ascending order, joined by commas. Ids are
    sorted by range, written into pieces where they lie, and one task hashes the pieces of a node in a row, however many
    there are, without holding them."""
    last = F.col("block") == F.greatest(F.ceil(F.col("size") / COLUMNS) - 1, F.lit(0))
    rows = blocks.filter(last).select(name_of(F.col("size") - F.col("block") * COLUMNS).alias("name"), "conv_id")
    rows = rows.repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, first, held, size = None, None, [], 0
        schema = pa.schema([("name", pa.string()), ("first", pa.int64()), ("piece", pa.string())])
        out = []
        for batch in batches:
            for a, c in zip(batch["name"].to_pylist(), batch["conv_id"].to_pylist(), strict=True):
                if a != name or size > PIECE:
                    if held:
                        out.append((name, first, ",".join(held)))
                    name, first, held, size = a, c, [], 0
                held.append(str(c))
                size += len(held[-1]) + 1
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema)
                out = []
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (name, first, ",".join(held)), strict=True))], schema)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            names, found = [], []
            for a, piece in zip(batch["name"].to_pylist(), batch["piece"].to_pylist(), strict=True):
                if a == name:
                    state.update(b"," + piece.encode())
                    continue
                if name is not None:
                    names.append(name)
                    found.append(state.hexdigest())
                name, state = a, hashlib.sha256(piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.string())], ["name", "ends_sha256"])
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([state.hexdigest()])], ["name", "ends_sha256"])

    cut = rows.mapInArrow(pieces, "name string, first long, piece string")
    return cut.repartition("name").sortWithinPartitions("name", "first").select("name", "piece").mapInArrow(digests, "name string, ends_sha256 string")


NO_ENDS = hashlib.sha256(b"").hexdigest()


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations (conv_id, turn, role, text; see ``rebuilt``): conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Null roles and texts are empty ones. Turns of
    equal numbers, null first, are ordered by the digest of role and text; repeated rows are turns each. Rows of a null
    conv_id belong to no conversation and are left out. Without conversations there is no node, not even a root; a
    conversation whose turns are all taken away ends at the root. Further columns are not read."""
    blocks = blocks_of(*rebuilt(turns_of(conversations)))
    owned = rolled(blocks, "min(conv_id) as conv_id, max(size) as longest").groupBy("conv_id").agg(F.min("before").alias("from_words"), F.max((F.col("longest") == F.col("depth")).cast("long")).alias("leaf"))
    owned = stored(owned, "trie-owners")
    own_words = F.coalesce(F.col("all_words") - F.col("from_words"), F.lit(0))
    members = blocks.join(owned, "conv_id", "left").withColumns({"own_words": own_words, "leaf": F.coalesce("leaf", F.lit(0))}).drop("from_words")
    nodes = rolled(members, "count(*) as n_convs, min(struct(conv_id, own_words, all_words)) as first, sum(all_words) as member_words, sum(own_words) as owned_words, sum(leaf) as n_leaves")
    said = F.col("member_words") - F.col("n_convs") * F.col("before")  # by all members, from the node's turn on
    once = F.col("owned_words") - F.col("first.own_words") + F.col("first.all_words") - F.col("before")  # each node's once
    kept = F.col("kept")
    nodes = nodes.select(name_of(kept).alias("name"), F.when(F.col("depth") > 0, name_of(kept - 1)).alias("parent"), F.col("first.conv_id").alias("conv_id"), "depth", "n_convs", "n_leaves", (said - once).alias("saved_tokens"))
    nodes = stored(nodes, "trie-nodes")
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, "name", "left").join(ends(blocks), "name", "left"), "trie-nodes")
    parents = nodes.filter("n_children > 0").select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = parents.filter(F.col("n_children") > nodes.count() / HOT).drop("n_children")  # fewer than HOT, as every node is one's child at most
    rows = nodes.join(F.broadcast(hot), "parent", "left")
    rare = parents.select(F.col("parent").alias("_parent"), F.col("parent_conv_id").alias("_conv"))
    # the children of hot parents are known by now: their own names, by which they meet nothing that counts, spread them
    rows = rows.withColumn("_parent", F.when(F.col("parent_conv_id").isNull(), F.col("parent")).otherwise(F.col("name"))).join(rare, "_parent", "left")
    return rows.select("conv_id", F.col("depth").cast("long").alias("depth"), F.coalesce("parent_conv_id", F.when(F.col("parent").isNotNull(), F.col("_conv"))).alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))

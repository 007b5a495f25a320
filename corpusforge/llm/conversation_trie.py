"""Prefix trie of conversations, kept as a z-fast trie in one table.

A conversation is its sequence of turns, and the key of a prefix is a chained MD5 of its
turns. The table has one row per compacted node: a run of turns that ends where
conversations part or end. A node is found by its handle, the key of its prefix at the
two-fattest depth of its edge (the depth divisible by the highest power of two), so a
conversation finds the node where it leaves the trie by fat binary search: one join per bit
of its length, instead of one per turn.

Distinct conversations are inserted in batches that grow by a fixed factor. Those of a batch
that leave at one place with one next turn become a subtree; edges are cut where some leave
in the middle. In the end the edges are expanded to one row per turn.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5, sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import query, saved, table

KEY = 16
ROOT = md5(b"").digest()
NO_ENDS = sha256(b"").hexdigest()
# Distinct conversations of the first batch; each batch makes the trie GROWTH times as large.
FIRST_BATCH = 1 << 12
GROWTH = 16
# Identifiers that go into one block of the digest of a node's ends.
ID_BLOCK = 1 << 12
WORD = r"[^\x20\x09-\x0D]+"
NODES = "top int, end int, up binary, key binary, keys binary, words array<long>"


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, digest, words) of every turn, numbered from 0 in each conversation.

    Order is by turn, null first; equal turns go by their digest. A null role or text is
    empty. Rows without conv_id belong to no conversation and are left out. The order of one
    conversation is found by one task (sorted on disk if need be), texts stay where they are.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    narrow = conversations.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.unhex(F.md5(F.concat(F.md5(role), F.md5(text)))).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return narrow.select("conv_id", (F.row_number().over(order) - 1).alias("at"), "digest", "words")


def with_shared_heads(turns: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversations that begin with turns of the first of their ``every`` neighbours.

    Conversation c gets the first h = crc32(c) mod ``most`` turns of conversation c - c mod
    ``every`` and then its own turns after its first h. One that is left without turns stays,
    as a row whose digest is null.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    heads = turns.where((F.col("conv_id") % every == 0) & (F.col("at") < most - 1)).withColumnRenamed("conv_id", "base")
    convs = turns.where("at = 0").select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), h.alias("h"))
    taken = convs.join(heads, "base").where("at < h").select("conv_id", "at", "digest", "words")
    # What is taken has places below h, what is its own places from h on.
    own = turns.where(F.col("at") >= h)
    return own.unionByName(taken).unionByName(convs.selectExpr("conv_id", "-1 AS at", "CAST(NULL AS BINARY) AS digest", "0L AS words"))


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # Columns conv_id, turns: a sorted list of (at, digest, words).
    for batch in batches:
        keys, words = [], []
        for turns in batch.column(1).to_pylist():
            chain = [ROOT]
            for turn in turns:
                chain.append(md5(chain[-1] + turn["digest"]).digest())
            keys.append(b"".join(chain))
            words.append([turn["words"] for turn in turns])
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array([k[-KEY:] for k in keys], pa.binary()), pa.array(keys, pa.binary()),
            pa.array(words, pa.list_(pa.int64())),
        ], ["conv_id", "seq", "keys", "words"])


def paths_of(turns: DataFrame) -> DataFrame:
    """(conv_id, seq, keys, words): keys of all prefixes of a conversation, from the empty one
    to the whole, which is ``seq``; 24 bytes a turn and no text in the row.
    """
    turn = F.when(F.col("digest").isNotNull(), F.struct("at", "digest", "words"))
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return listed.mapInArrow(_chained, "conv_id long, seq binary, keys binary, words array<long>")


def key_at(keys: str, depth: str, before: str = "0") -> Column:
    """The key at ``depth`` in keys that begin after depth ``before`` - 1."""
    return F.expr(f"substring({keys}, {KEY} * ({depth} - ({before})) + 1, {KEY})")


def fattest(low: str, high: str) -> Column:
    """The number in (low, high] that the highest power of two divides."""
    bits = f"(length(bin({low} ^ {high})) - 1)"
    return F.expr(f"shiftleft(shiftright({high}, {bits}), {bits})")


def with_handles(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("fat", fattest("top", "end")).withColumn("handle", key_at("keys", "fat", "top + 1"))


def locate(batch: DataFrame, nodes: DataFrame, longest: int) -> DataFrame:
    """``batch`` with ``x``, the depth at which each sequence leaves the trie, and ``node``,
    the key of the node in whose edge that is; null where it leaves at the end of a node.

    A node that is found but goes on differently ends the search. Rows that are done probe a
    key that no node has, so they stay spread.
    """
    handles = with_handles(nodes).select("handle", F.col("end").alias("h_end"), F.col("key").alias("h_key"))
    done = F.concat("seq", F.lit(b"-"))
    state = batch.withColumns({"a": F.lit(0), "b": F.col("len"), "node": F.lit(None).cast("binary")})
    for _ in range(longest.bit_length()):
        state = (
            state.withColumn("f", F.when(F.expr("a < b"), fattest("a", "b")))
            .withColumn("handle", F.coalesce(key_at("keys", "f"), done))
            .join(handles, "handle", "left")
            .withColumn("passed", F.coalesce((F.col("h_end") <= F.col("len")) & (key_at("keys", "h_end") == F.col("h_key")), F.lit(False)))
            .select(*batch.columns,
                    F.expr("CASE WHEN passed THEN h_end ELSE a END").alias("a"),
                    F.expr("CASE WHEN passed THEN b WHEN h_key IS NOT NULL THEN a ELSE coalesce(f - 1, b) END").alias("b"),
                    F.expr("CASE WHEN passed THEN node ELSE coalesce(h_key, node) END").alias("node"))
        )
    # All of node ``a`` is a prefix; the next turn may begin the edge of a child.
    children = nodes.select(key_at("keys", "0").alias("child"), F.col("key").alias("c_key"))
    next_key = F.coalesce(F.when(F.expr("node IS NULL AND a < len"), key_at("keys", "a + 1")), done)
    state = state.withColumn("child", next_key).join(children, "child", "left").withColumn("node", F.coalesce("node", "c_key"))
    edges = nodes.select(F.col("key").alias("node"), F.col("top").alias("e_top"), F.col("end").alias("e_end"), F.col("keys").alias("e_keys"))
    same = F.expr(
        f"size(filter(sequence(e_top + 1, least(e_end, len)), d -> "
        f"substring(keys, {KEY} * d + 1, {KEY}) = substring(e_keys, {KEY} * (d - e_top - 1) + 1, {KEY})))")
    return (
        state.withColumn("probe", F.coalesce("node", done)).drop("child", "c_key")
        .join(edges.withColumnRenamed("node", "probe"), "probe", "left")
        .withColumn("x", F.when(F.col("node").isNotNull(), F.col("e_top") + same).otherwise(F.col("a")))
        .select(*batch.columns, "node", "x")
    )


def _grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compacted nodes below the places where sequences leave: columns branch, x, keys, words,
    sorted by branch and keys. Only the path of the last sequence is held.
    """
    out: list[tuple] = []
    branch, keys, words, ends = None, b"", [], []

    def close(depth: int) -> None:
        while ends[-1] > depth:
            end = ends.pop()
            if ends[-1] < depth:
                ends.append(depth)
            top = ends[-1]
            out.append((top, end, keys[KEY * top : KEY * (top + 1)], keys[KEY * end : KEY * (end + 1)],
                        keys[KEY * (top + 1) : KEY * (end + 1)], words[top:end]))

    def drained() -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        columns = list(zip(*out)) or [()] * len(kinds)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)],
                                          ["top", "end", "up", "key", "keys", "words"])

    for batch in batches:
        for new_branch, x, new_keys, new_words in zip(*(c.to_pylist() for c in batch.columns)):
            if new_branch != branch:
                if ends:
                    close(ends[0])
                branch, ends = new_branch, [x]
            else:
                shared = x + 1  # the branch itself
                while new_keys[KEY * (shared + 1) : KEY * (shared + 2)] == keys[KEY * (shared + 1) : KEY * (shared + 2)] != b"":
                    shared += 1
                close(shared)
            keys, words = new_keys, new_words
            ends.append(len(keys) // KEY - 1)
        yield drained()
    if ends:
        close(ends[0])
    yield drained()


def grow(nodes: DataFrame, located: DataFrame) -> DataFrame:
    """The trie with the located sequences: edges cut where one leaves, new subtrees below."""
    cuts = located.where("node IS NOT NULL").groupBy(F.col("node").alias("key")).agg(F.collect_set("x").alias("cuts"))
    bounds = F.array_sort(F.concat(F.coalesce("cuts", F.array().cast("array<int>")), F.array("end")))
    pieces = nodes.join(cuts, "key", "left").withColumn("bounds", bounds).select(
        "*", F.posexplode("bounds").alias("i", "e")).withColumn("t", F.expr("CASE WHEN i = 0 THEN top ELSE bounds[i - 1] END"))
    cut = pieces.select(
        F.col("t").alias("top"), F.col("e").alias("end"),
        F.when(F.expr("i = 0"), F.col("up")).otherwise(key_at("keys", "t", "top + 1")).alias("up"),
        key_at("keys", "e", "top + 1").alias("key"),
        F.expr(f"substring(keys, {KEY} * (t - top) + 1, {KEY} * (e - t))").alias("keys"),
        F.expr("slice(words, t - top + 1, e - t)").alias("words"))
    new = located.where("x < len").select(key_at("keys", "x + 1").alias("branch"), "x", "keys", "words")
    return cut.unionByName(new.repartition("branch").sortWithinPartitions("branch", "keys").mapInArrow(_grown, NODES))


def build(sequences: DataFrame, first_batch: int, growth: int) -> DataFrame:
    """Compacted nodes (columns ``NODES``) of distinct sequences (seq, len, keys, words), root excluded.

    Batches are cut by the hash of the sequence. A prefix that many sequences share is met in
    an early batch but for a small chance, so the sequences that leave at one place with one
    next turn are few, some ``growth`` times the logarithm of all.
    """
    spark = sequences.sparkSession
    count, longest = sequences.agg(F.count("*"), F.coalesce(F.max("len"), F.lit(0))).first()
    nodes = spark.createDataFrame([], NODES)
    hashed = sequences.withColumn("u", F.pmod(F.xxhash64("seq"), F.lit(1 << 30)))
    done, share = 0, min(1.0, first_batch / max(count, 1))
    while done < 1 << 30:
        until = 1 << 30 if share >= 1 else max(done + 1, int(share * (1 << 30)))
        batch = hashed.where((F.col("u") >= done) & (F.col("u") < until)).drop("u")
        located = saved(locate(batch, nodes, longest)) if done else batch.withColumns(
            {"node": F.lit(None).cast("binary"), "x": F.lit(0)})
        nodes = saved(grow(nodes, located))
        done, share = until, share * growth
    return nodes


def ancestors(nodes: DataFrame) -> list[DataFrame]:
    """Tables (key, up) of each node and its ancestor one, two, four ... nodes above."""
    links = [saved(nodes.select("key", "up").where("up IS NOT NULL"))]
    while True:
        last = links[-1]
        above = last.select(F.col("key").alias("up"), F.col("up").alias("over"))
        further = saved(last.join(above, "up").select("key", F.col("over").alias("up")))
        if further.isEmpty():
            return links
        links.append(further)


def over_subtrees(values: DataFrame, links: list[DataFrame], functions: dict) -> DataFrame:
    """Values by key, each combined with those of all nodes below, in as many steps as ``links``.

    After a step a node has combined the nodes at twice the distance. What many nodes send to
    one is combined in the task before it moves.
    """
    for link in links:
        sent = values.join(link, "key").groupBy(F.col("up").alias("key")).agg(
            *[function(name).alias(f"sent_{name}") for name, function in functions.items()])
        both = values.join(sent, "key", "left")
        values = saved(both.select("key", *[
            (F.least if function is F.min else lambda a, b: a + F.coalesce(b, F.lit(0)))(F.col(name), F.col(f"sent_{name}")).alias(name)
            for name, function in functions.items()]))
    return values


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # Columns seq, slice, ids, sorted by seq and slice; only a running hash is held.
    seq, state = None, None
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for new, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if new == seq:
                state.update(b",")
            else:
                if state:
                    done.append((seq, state.hexdigest()))
                seq, state = new, sha256()
            state.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in ((0, pa.binary()), (1, pa.string()))], ["seq", "ends_sha256"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([seq], pa.binary()), pa.array([state.hexdigest()])], ["seq", "ends_sha256"])


def end_digests(paths: DataFrame) -> DataFrame:
    """(seq, ends_sha256): SHA-256 of the ascending, comma-joined conv_ids of each sequence.

    Identifiers are joined in blocks of neighbouring numbers wherever they are; the hash, which
    is sequential, then runs over the blocks of a sequence.
    """
    block = F.floor(F.col("conv_id") / ID_BLOCK).alias("slice")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    blocks = paths.groupBy("seq", block).agg(joined.alias("ids"))
    return blocks.repartition("seq").sortWithinPartitions("seq", "slice").mapInArrow(_digests, "seq binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, first_batch: int = FIRST_BATCH, growth: int = GROWTH) -> DataFrame:
    """One row per distinct prefix of the conversations in ``turns`` (conv_id, at, digest, words).

    ``conv_id`` is the smallest member, ``n_convs`` the number of members, ``n_children`` and
    ``n_leaves`` count nodes one below and childless ones below or here; ``saved_tokens`` sums
    words times members but one over the subtree; ``ends_sha256`` lists the members that end
    here. A row with null digest only says that its conversation exists; one without turns
    ends at the root. Equal conversations are one sequence of the trie. Without conversations
    there is no node, not even the root.
    """
    paths = saved(paths_of(turns))
    sequences = saved(paths.groupBy("seq").agg(
        F.min("conv_id").alias("first"), F.count("*").alias("n"), F.first("keys").alias("keys"), F.first("words").alias("words")
    ).withColumn("len", F.expr(f"CAST(octet_length(keys) / {KEY} - 1 AS INT)")))
    root = sequences.limit(1).select(
        F.lit(-1).alias("top"), F.lit(0).alias("end"), F.lit(None).cast("binary").alias("up"), F.lit(ROOT).alias("key"),
        F.lit(ROOT).alias("keys"), F.array(F.lit(0).cast("long")).alias("words"))
    nodes = saved(build(sequences, first_batch, growth).unionByName(root))

    children = nodes.groupBy(F.col("up").alias("key")).agg(F.count("*").alias("children"))
    ends = sequences.select(F.col("seq").alias("key"), "n", "first")
    known = nodes.join(children, "key", "left").join(ends, "key", "left").select(
        "key", F.coalesce("n", F.lit(0)).alias("n"), "first", F.col("children").isNull().cast("long").alias("leaves"))
    links = ancestors(nodes)
    counts = over_subtrees(known, links, {"n": F.sum, "first": F.min, "leaves": F.sum})
    weight = F.expr("aggregate(words, 0L, (a, w) -> a + w)") * (F.col("n") - 1)
    saving = over_subtrees(nodes.join(counts, "key").select("key", weight.alias("saved")), links, {"saved": F.sum})

    parents = counts.select(F.col("key").alias("up"), F.col("first").alias("up_first"))
    edges = (
        nodes.join(counts, "key").join(saving, "key").join(children, "key", "left").join(parents, "up", "left")
        .join(end_digests(paths).withColumnRenamed("seq", "key"), "key", "left")
        .select("*", F.explode(F.expr("sequence(top + 1, end)")).alias("depth"))
    )
    before = F.expr("aggregate(slice(words, 1, depth - top - 1), 0L, (a, w) -> a + w)")
    last = F.expr("depth = end")
    return edges.select(
        F.col("first").alias("conv_id"), F.col("depth").cast("long").alias("depth"),
        F.when(F.expr("depth = top + 1"), F.col("up_first")).otherwise(F.col("first")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(last, F.coalesce("children", F.lit(0))).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"), (F.col("saved") - (F.col("n") - 1) * before).alias("saved_tokens"),
        F.when(last, F.coalesce("ends_sha256", F.lit(NO_ENDS))).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"))


TRIE_SQL = r"""
WITH turns AS (
    SELECT conv_id, digest, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS pos
    FROM (SELECT conv_id, turn, md5(md5(coalesce(role, '')) || md5(coalesce(text, ''))) AS digest,
            len(list_filter(string_split_regex(coalesce(text, ''), '[\x09-\x0D\x20]+'), lambda x: x <> '')) AS words
        FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (
    SELECT conv_id, conv_id - conv_id % 20 AS base,
        xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
            lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::BIGINT) ELSE r >> 1 END)), 4294967295::BIGINT) % 4 AS h
    FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
    SELECT conv_id, pos, digest, words FROM turns JOIN convs USING (conv_id) WHERE pos >= h
    UNION ALL
    SELECT c.conv_id, pos, digest, words FROM convs c JOIN turns t ON t.conv_id = base WHERE pos < h
), lists AS (
    SELECT conv_id, coalesce(list(digest ORDER BY pos) FILTER (digest IS NOT NULL), []) AS d,
        coalesce(list(words ORDER BY pos) FILTER (digest IS NOT NULL), []) AS w
    FROM convs LEFT JOIN rebuilt USING (conv_id) GROUP BY conv_id
), prefixes AS (
    SELECT conv_id, depth, array_to_string(d[1:depth], ',') AS path,
        CASE WHEN depth = 0 THEN NULL ELSE array_to_string(d[1:depth - 1], ',') END AS up,
        CASE WHEN depth = 0 THEN 0 ELSE w[depth] END AS words, depth = len(d) AS ends
    FROM lists, unnest(range(0, len(d) + 1)) AS r(depth)
), nodes AS (
    SELECT path, any_value(up) AS up, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
    FROM prefixes GROUP BY path, depth
), families AS (
    SELECT n.path, n.depth, count(c.path) AS n_children FROM nodes n LEFT JOIN nodes c ON c.up = n.path AND c.depth = n.depth + 1 GROUP BY ALL
), subtrees AS (
    SELECT a.path, a.depth, sum((n.n_children = 0)::INT)::BIGINT AS n_leaves, sum((b.n_convs - 1) * b.words)::BIGINT AS saved_tokens
    FROM nodes a JOIN nodes b ON b.depth >= a.depth AND (a.depth = 0 OR b.path = a.path OR starts_with(b.path, a.path || ','))
    JOIN families n ON n.path = b.path AND n.depth = b.depth GROUP BY ALL
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n JOIN families USING (path, depth) JOIN subtrees USING (path, depth)
LEFT JOIN nodes p ON p.path = n.up AND p.depth = n.depth - 1
"""


@query("op12_conversation_trie", TRIE_SQL)
def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = saved(turns_of(table(spark, sf_dir, "conversations")))
    return prefix_trie(with_shared_heads(turns))

"""Conversations rebuilt from message rows: reply links, their choice, and link trees."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.ranking import split_rank
from marlstone.operators.shred import shred_record
from marlstone.session import cut_lineage, scratch

#: Weights of the evidence for a reply link. What a message states, its place or its parent,
#: outweighs all that is inferred, a place outweighs a parent.
WEIGHTS = {"place": 16.0, "parent": 8.0, "time": 1.0, "mention": 0.8, "overlap": 1.2}
TAU_SECONDS = 300.0
_BLANK = "\\u0000-\\u0020\\u00a0\\u1680\\u2000-\\u200f\\u2028-\\u202f\\u205f-\\u2064\\u3000\\ufeff\\u00ad"
_BLANKS, SHOWN = f"[{_BLANK}]+", f"[^{_BLANK}]"

# Spellings of the senders.
ROLES = {
    "human": "user", "user": "user", "assistant": "assistant", "ai": "assistant", "model": "assistant",
    "bot": "assistant", "system": "system", "tool": "tool",
}


def role_of(sender: Column) -> Column:
    """'user', 'assistant', 'system' or 'tool'; null where the sender names no role."""
    table = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.element_at(table, F.lower(F.regexp_replace(F.coalesce(sender, F.lit("")), _BLANKS, "")))


def is_blank(text: Column) -> Column:
    """True for null texts and texts of nothing but white space and invisible marks."""
    return ~F.coalesce(text.rlike(SHOWN), F.lit(False))


def words_of(text: Column) -> Column:
    """Distinct lower-case words of four letters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) >= 4))


def link_score(seconds: np.ndarray, mentions: int, shared: np.ndarray, words: int) -> np.ndarray:
    """Likelihood score of reply links: nearness in time, a mention of the author, shared words."""
    near = np.exp(-np.maximum(seconds, 0.0) / TAU_SECONDS)
    return WEIGHTS["time"] * near + WEIGHTS["mention"] * mentions + WEIGHTS["overlap"] * shared / max(words, 1)


def _mentioned(text: str, authors: dict[str, np.ndarray], lengths: list[int]) -> list[np.ndarray]:
    """The messages of each author whom the text names with an @ before the name."""
    named = {text[at : at + n] for at in (m.end() for m in re.finditer("@", text)) for n in lengths}
    return [authors[a] for a in named if a in authors]


def _best_parents(rows: pa.Table) -> pa.Table:
    """msg, score, at, parent: the likeliest parent among one block of a channel of each message of another.

    Rows: the columns of `_PAIR`; those of block `theirs` are offered to those of block
    `mine`. Offers are counted through the postings of the words, whatever their distance.
    """
    rows = rows.sort_by("rank")
    block, mine, theirs = rows["block"].to_numpy(), rows["mine"][0].as_py(), rows["theirs"][0].as_py()
    asks, offers = rows.filter(pa.array(block == mine)), rows.filter(pa.array(block == theirs))
    n, same = offers.num_rows, mine == theirs
    out: list[tuple[int, float, int]] = []  # (asking row, score, offered row)
    if n and asks.num_rows:
        at, asked_at = offers["at"].to_numpy(), asks["at"].to_numpy()
        lists, asked = offers["words"].combine_chunks(), asks["words"].combine_chunks()
        vocabulary, ids = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        order = np.argsort(ids, kind="stable")
        postings = np.repeat(np.arange(n), lists.value_lengths().to_numpy())[order]
        starts = np.searchsorted(ids[order], np.arange(len(vocabulary) + 1))
        words = asked.flatten().to_numpy()
        bounds = np.concatenate([[0], np.cumsum(asked.value_lengths().to_numpy())])
        found = np.searchsorted(vocabulary, words)
        found[found == len(vocabulary)] = 0
        hit = vocabulary[found] == words if len(vocabulary) else np.zeros(len(words), bool)
        if same:  # only what stands before a row: the part of a posting list before its own place
            ends = np.empty(len(ids), np.int64)
            ends[order] = np.arange(len(ids))
        else:
            ends = starts[np.minimum(found + 1, len(starts) - 1)]
        authors: dict[str, list[int]] = {}
        for i, name in enumerate(offers["author"].to_pylist()):
            if name is not None and len(name) > 2:
                authors.setdefault(name, []).append(i)
        theirs_of = {a: np.array(i) for a, i in authors.items()}
        lengths = sorted({len(a) for a in authors})
        texts = asks["named"].to_pylist()
        close = np.searchsorted(at, asked_at - FAR_SECONDS)
        for k in range(asks.num_rows):
            limit = k if same else n
            if not limit:
                continue
            lo, hi = bounds[k], bounds[k + 1]
            lists_k = [postings[starts[v] : e] for v, e, h in zip(found[lo:hi], ends[lo:hi], hit[lo:hi]) if h]
            shared = np.bincount(np.concatenate(lists_k), minlength=limit) if lists_k else np.zeros(limit, np.int64)
            tops: list[tuple[float, int]] = []

            def best_of(places: np.ndarray, mentions: int) -> None:
                scores = link_score(asked_at[k] - at[places], mentions, shared[places], hi - lo)
                last = len(places) - 1 - int(scores[::-1].argmax())
                tops.append((float(scores[last]), int(places[last])))

            first = min(int(close[k]), limit)
            if first and lists_k:  # far away the words decide, of equally many shared the latest
                best_of(np.array([first - 1 - int(shared[:first][::-1].argmax())]), 0)
            if first < limit:
                best_of(np.arange(first, limit), 0)
            for places in _mentioned(texts[k], theirs_of, lengths) if texts[k] else ():
                if len(places := places[places < limit]):
                    best_of(places, 1)
            if tops and max(tops)[0] >= THRESHOLD:
                out.append((k, *max(tops)))
    mine_at, theirs_at = pa.array([k for k, _, _ in out], pa.int64()), pa.array([p for _, _, p in out], pa.int64())
    columns = [asks["msg"].take(mine_at), pa.array([s for _, s, _ in out], pa.float64()), offers["at"].take(theirs_at), offers["msg"].take(theirs_at)]
    return pa.table(columns, names=["msg", "score", "at", "parent"])


def candidate_links(messages: DataFrame) -> DataFrame:
    """The likeliest parent of each message of interleaved channels.

    messages: msg (unique), channel, at (seconds, double), author, text. A reply's
    candidates are all messages of its channel before it, at any distance. Each is scored
    by time, by a mention of its author and by shared words; the best, of equals the
    latest, becomes the parent if it scores at least THRESHOLD, else the message begins a
    thread. Channels are cut into blocks of BLOCK messages, and each block meets itself
    and each earlier one in a task of its own. The work grows with the square of a
    channel's length, as its messages share words; words are compared by 64-bit hashes.
    Result: msg, channel, at, author, parent (null for a beginning), score.

    Messages with null time, text or author are kept: no time means a thread of its own.
    """
    m = messages.select("msg", F.coalesce("channel", F.lit("")).alias("channel"), "at", "author", F.coalesce("text", F.lit("")).alias("text"))
    timed = m.where(F.col("at").isNotNull()).select(
        "msg", "channel", "at", "author", F.when(F.col("text").contains("@"), F.col("text")).alias("named"),
        F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("words"),
    )
    ranked = split_rank(timed, ["channel"], [F.col("at"), F.col("msg")], F.floor(F.col("at") / 86_400), "rank")
    ranked = cut_lineage(ranked.withColumn("block", F.floor(F.col("rank") / BLOCK)), "ranked")
    blocks = ranked.groupBy("channel").agg(F.max("block").alias("last"))
    pairs = ranked.join(F.broadcast(blocks), "channel") if blocks.count() <= BROADCAST_CHANNELS else ranked.join(blocks, "channel")
    earlier = F.transform(F.sequence(F.lit(0), F.col("block")), lambda b: F.struct(F.col("block").alias("mine"), b.cast("long").alias("theirs")))
    later = F.transform(F.sequence(F.col("block"), F.col("last")), lambda b: F.struct(b.alias("mine"), F.col("block").alias("theirs")))
    pairs = pairs.select(*_PAIR, F.inline(F.array_union(earlier, later)))
    kind = ranked.schema["msg"].dataType.simpleString()
    tops = pairs.groupBy("channel", "mine", "theirs").applyInArrow(_best_parents, f"msg {kind}, score double, at double, parent {kind}")
    best = tops.groupBy("msg").agg(F.max(F.struct("score", "at", "parent")).alias("best"))
    linked = m.join(best, "msg", "left")
    return linked.select("msg", "channel", "at", "author", F.col("best.parent").alias("parent"), F.col("best.score").alias("score"))


_PAIR = ["msg", "channel", "at", "author", "named", "words", "rank", "block"]
#: Messages of a channel that one task holds against as many others.
BLOCK = 1 << 15
BROADCAST_CHANNELS = 100_000
#: From here on the time term (below 1e-15) is less than any difference in shared words.
FAR_SECONDS = 36 * TAU_SECONDS
#: A link needs this score: close in time, or fairly close with a mention or shared words.
THRESHOLD = 0.6


def tree_depths(links: DataFrame, group: list[str], longest: int) -> DataFrame:
    """Root and depth of each node of link trees by pointer doubling.

    links: the group columns, node, parent (null at roots). Each round doubles the
    distance that a node has jumped, so ceil(log2(longest)) + 1 rounds reach every root;
    nodes that reach none (circles, parents that are no node) are left out. Result: group
    columns, node, root, depth.
    """
    spark = links.sparkSession
    done = links.where(F.col("parent").isNull()).select(*group, "node", F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"))
    going = links.where(F.col("parent").isNotNull()).select(*group, "node", F.col("parent").alias("at"), F.lit(1).cast("long").alias("steps"))
    folder = scratch(spark, "ended")
    done.write.parquet(f"{folder}/round=0")
    for k in range(1, math.ceil(math.log2(max(longest, 2))) + 2):
        ended = spark.read.schema(done.schema).parquet(folder)  # all rounds so far, one folder
        roots = ended.select(*group, F.col("node").alias("at"), "root", "depth")
        jumps = going.select(*group, F.col("node").alias("at"), F.col("at").alias("to"), F.col("steps").alias("more"))
        steps = cut_lineage(
            going.join(roots, [*group, "at"], "left").join(jumps, [*group, "at"], "left")
            .select(*group, "node", F.coalesce("to", "at").alias("at"), "root", (F.col("steps") + F.coalesce("depth", "more", F.lit(0))).alias("steps")),
            "doubling",
        )
        steps.where(F.col("root").isNotNull()).select(*group, "node", "root", F.col("steps").alias("depth")).write.parquet(f"{folder}/round={k}")
        going = steps.where(F.col("root").isNull()).select(*group, "node", "at", "steps")
        if going.isEmpty():
            break
    return spark.read.schema(done.schema).parquet(folder)


def latest_messages(rows: DataFrame) -> DataFrame:
    """One row per (conv, msg): the one received last, of equal ones that of the largest ref."""
    received = Window.partitionBy("conv", "msg").orderBy(F.col("received_at").asc_nulls_first(), F.col("ref").asc_nulls_first())
    # No row comes after the latest. Most messages have one row: ranks would be cut before the shuffle, by a sort more.
    last = rows.withColumn("_next", F.lead(F.lit(1)).over(received)).where("_next IS NULL")
    return last.drop("_next", "received_at")


def _with_facts(messages: DataFrame) -> DataFrame:
    """messages with n, n_role, n_idx and n_parent of their conversation: its messages, and those that fill the fields."""
    filled = [F.count(c).alias(f"n_{c}") for c in ("role", "idx", "parent") if c in messages.columns]
    return messages.join(messages.groupBy("conv").agg(F.count("*").alias("n"), *filled), "conv")


def _as_they_are(messages: DataFrame) -> DataFrame:
    return messages


def reply_links(messages: DataFrame, timed: Callable[[DataFrame], DataFrame] = _as_they_are) -> DataFrame:
    """conv, msg, parent (null: it begins the conversation), score, kind, pos: the likeliest parent of each message.

    messages: conv, msg, ref, parent, idx, at; `timed` adds `at` where it is missing, and
    is only asked about conversations whose order hangs on it. Candidates are the message
    at the place before, the stated parent, and the message before in time (of equal times
    that of the smaller ref), each scored by WEIGHTS, nearness in time as in link_score().
    A message at place 0, without a parent where others state one, or first in time is a
    candidate for a beginning by the same weight. Where all messages of a conversation
    state their places, parents cannot win and are not looked up. Time only counts in
    conversations that state neither places nor parents: mentions and shared words weigh
    less than any statement, and between two speakers they tell no earlier message from
    another, so that they are left to candidate_links(). A message of whose candidates
    none exists has no row. kind names the strongest evidence, pos is the place that
    follows from it, null for a parent.
    """
    return _links(cut_lineage(_with_facts(messages), "facts"), timed, [])


def _links(known: DataFrame, timed: Callable[[DataFrame], DataFrame], carried: list[str]) -> DataFrame:
    """The links of reply_links() with the carried columns of their messages; known: as of _with_facts()."""
    weight = lambda kind: F.lit(WEIGHTS[kind])
    candidate = lambda score, parent, kind, pos: F.struct(score.alias("score"), parent.alias("parent"), F.lit(kind).alias("kind"), pos.cast("long").alias("pos"))
    fields = ["conv", "msg", "parent", *dict.fromkeys(["n", "n_idx", "n_parent", *carried])]

    silent = cut_lineage(timed(known.where("n_idx = 0 AND n_parent = 0")).select(*dict.fromkeys([*fields, "ref"]), "at"), "silent")
    ranked = split_rank(silent, ["conv"], [F.col("at").asc_nulls_first(), F.col("ref")], F.floor(F.col("at") / 3_600_000_000), "idx")
    placed = known.where("idx IS NOT NULL").select(*fields, F.lit(None).cast("long").alias("at"), F.col("idx").cast("long").alias("idx"))
    ordered = _after_places(placed.unionByName(ranked.select(*fields, "at", "idx")))
    begins = F.col("idx") == 0
    by_place = F.when(F.col("up").isNotNull() | begins, candidate(weight("place"), F.col("up"), "place", F.col("idx")))
    seconds = (F.col("at") - F.coalesce("at_up", "at")) / 1e6
    near = F.when(begins, weight("time")).otherwise(weight("time") * F.exp(-F.coalesce(seconds, F.lit(0.0)) / TAU_SECONDS))
    by_time = candidate(near, F.col("up"), "time", F.col("idx"))
    first = ordered.select(*fields, F.when(F.col("n_idx") > 0, by_place).otherwise(by_time).alias("c"))

    # Parents are looked up where places leave something open.
    names = known.where("n_parent > 0 AND n_idx < n").select("conv", F.col("msg").alias("parent"), F.lit(True).alias("there"))
    unplaced = known.where("n_parent > 0 AND n_idx < n AND idx IS NULL").select(*fields, F.lit(None).cast(first.schema["c"].dataType).alias("c"))
    asking = first.where("n_parent > 0 AND n_idx < n").unionByName(unplaced).join(names, ["conv", "parent"], "left")
    states = F.when(F.col("there"), candidate(weight("parent"), F.col("parent"), "parent", F.lit(None)))
    silent_root = F.when(F.col("parent").isNull() & (F.col("n_idx") == 0), candidate(weight("parent"), F.lit(None).cast("string"), "parent", F.lit(None)))
    second = asking.select(*fields, F.greatest("c", states, silent_root).alias("c"))
    settled = first.where("n_parent = 0 OR n_idx = n")
    links = settled.unionByName(second).where("c IS NOT NULL")
    return links.select("conv", "msg", *carried, "c.parent", "c.score", "c.kind", "c.pos")


#: Places of a conversation that one task looks at together.
PLACES = 1000


def _after_places(ordered: DataFrame) -> DataFrame:
    """Add up and at_up, the message at the place before (idx - 1) and its time; of several there the largest.

    Conversations are cut into pieces of PLACES places, and the last place of a piece
    stands in the next one too.
    """
    piece = F.floor(F.col("idx") / PLACES)
    pieces = ordered.withColumn("_piece", F.explode(F.sequence(piece, F.floor((F.col("idx") + 1) / PLACES))))
    before = Window.partitionBy("conv", "_piece").orderBy("idx").rangeBetween(-1, -1)
    met = pieces.withColumn("up", F.max("msg").over(before)).withColumn("at_up", F.max("at").over(before))
    return met.where(F.col("_piece") == piece).drop("_piece")


def conversation_positions(messages: DataFrame, timed: Callable[[DataFrame], DataFrame] = _as_they_are) -> DataFrame:
    """conv, msg, ref, role, blank, pos of every conversation whose links form one chain.

    messages: conv, msg, ref, parent, idx, role (null: unusable), blank, and at, which
    `timed` adds where it is missing. The links are those of reply_links(). Conversations
    are broken, and left out, if a role is unusable, if they state some places but not 0,
    1, 2 and so on (a link then is missing), or if the links are no single chain from one
    beginning.
    """
    fields = ["conv", "msg", "ref", "role", "blank"]
    known = cut_lineage(_with_facts(messages).where("n_role = n AND (n_idx = 0 OR n_idx = n)").drop("n_role"), "facts")
    links = cut_lineage(_links(known, timed, ["n", *fields[2:]]).drop("score"), "links")
    # Each place has one before it, so that the last of n is n - 1 only if all are there
    # and differ; ranks in time always do. Whether stated parents are one chain is found
    # by walking them.
    placed, chains = links.where("kind != 'parent'"), links.where("kind = 'parent'").select(*fields, "parent", "n")
    shape = placed.groupBy("conv").agg(F.max("n").alias("n"), F.count("*").alias("n_links"), F.max("pos").alias("last"))
    whole = placed.select(*fields, "pos").join(shape.where("n_links = n AND last = n - 1").select("conv"), "conv")
    chained = chain_places(chains.where(F.col("n") <= LONGEST_WALK))
    longest = chains.agg(F.max("n")).first()[0] or 1
    if longest > LONGEST_WALK:
        chained = chained.unionByName(_doubled(cut_lineage(chains.where(F.col("n") > LONGEST_WALK), "chains"), longest))
    return whole.unionByName(chained).select(*fields, "pos")


#: Longest conversation whose chain is walked in the memory of one task (about 20 MB).
LONGEST_WALK = 1 << 16


def chain_places(chains: DataFrame) -> DataFrame:
    """conv, msg, ref, role, blank, pos of the conversations whose stated parents are one chain, walked one by one.

    chains: conv, msg, ref, role, blank, parent (null at a beginning) and n, the number of
    messages of the conversation. A task holds one conversation and one batch of rows at
    a time.
    """
    kinds = [(c, chains.schema[c].dataType.simpleString()) for c in ("conv", "msg", "ref", "role", "blank", "n")]
    schema = ", ".join([*(f"{c} {kind}" for c, kind in kinds[:-1]), "pos bigint"])
    rows = chains.select(*[c for c, _ in kinds], "parent").repartition("conv").sortWithinPartitions("conv")
    return rows.mapInArrow(_walk_chains, schema)


def _walk_chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose conversation is one chain, with their places; rows are in the order of conversations."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows, last = pa.Table.from_batches([batch]), batch.column("conv")[-1]
        rest = rows if rest is None else pa.concat_tables([rest, rows])
        if rest["conv"][0] != last:  # the last conversation of the batch may go on in the next one
            whole = pc.index(rest["conv"], last).as_py()
            yield from _walked(rest.slice(0, whole)).to_batches()
            rest = rest.slice(whole)
    if rest is not None:
        yield from _walked(rest).to_batches()


def _walked(rows: pa.Table) -> pa.Table:
    """rows with pos in place of n and parent, for the conversations that are one chain from one beginning."""
    convs, messages, parents, sizes = (rows[c].to_pylist() for c in ("conv", "msg", "parent", "n"))
    places: list[int | None] = [None] * len(convs)
    start = 0
    while start < len(convs):
        end = start
        after: dict[str | None, int] = {}  # the reply to each message; null leads to the beginning
        while end < len(convs) and convs[end] == convs[start]:
            after[parents[end]] = end
            end += 1
        path, at = [], after.get(None)
        while at is not None and len(path) < end - start:
            path.append(at)
            at = after.get(messages[at])
        if len(path) == sizes[start]:  # a fork leaves one of its replies out, a circle is never entered
            for pos, k in enumerate(path):
                places[k] = pos
        start = end
    pos = pa.array(places, pa.int64())
    return rows.drop_columns(["n", "parent"]).append_column("pos", pos).filter(pos.is_valid())


def _doubled(chains: DataFrame, longest: int) -> DataFrame:
    """chain_places() for conversations of any length, by pointer doubling."""
    depths = tree_depths(chains.select("conv", F.col("msg").alias("node"), "parent"), ["conv"], longest)
    depths = depths.select("conv", F.col("node").alias("msg"), F.col("depth").alias("pos"))
    # Of n messages the deepest is at n - 1 only if each has one reply.
    deepest = depths.groupBy("conv").agg(F.max("pos").alias("last"))
    sound = chains.select("conv", "n").distinct().join(deepest, "conv").where("last = n - 1").select("conv")
    return chains.join(sound, "conv").join(depths, ["conv", "msg"]).select("conv", "msg", "ref", "role", "blank", "pos")


def kept_turns(positions: DataFrame) -> DataFrame:
    """conv, turn, ref, speaker: the turns of the conversations that are worth keeping.

    System and tool messages are left out. A conversation is dropped if an assistant
    message is blank, if nothing but blanks remains, or if its last message is the user's;
    the other blank messages are left out.
    """
    spoken = positions.where(F.col("role").isin("user", "assistant")).withColumn("_slice", F.floor(F.col("pos") / 1000))
    shown = ~F.col("blank")
    # Slices of long conversations: what each has, then over all slices of a conversation.
    has = spoken.groupBy("conv", "_slice").agg(
        F.count(F.when(F.col("blank") & (F.col("role") == "assistant"), 1)).alias("bad"),
        F.count(F.when(shown, 1)).alias("shown"),
        F.max(F.when(shown, 2 * F.col("pos") + F.when(F.col("role") == "assistant", 1).otherwise(0))).alias("last"),
    )
    all_of = Window.partitionBy("conv")
    before = all_of.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = has.select("conv", "_slice", F.coalesce(F.sum("shown").over(before), F.lit(0)).alias("before"), F.sum("bad").over(all_of).alias("bad"), F.max("last").over(all_of).alias("last"))
    # Odd: the last message shown is the assistant's; null: none is shown.
    good = slices.where("bad = 0 AND last % 2 != 0").select("conv", "_slice", "before")
    inner = Window.partitionBy("conv", "_slice").orderBy("pos")
    turns = spoken.where(shown).withColumn("turn", F.row_number().over(inner) - 1).join(good, ["conv", "_slice"])
    return turns.select("conv", (F.col("turn") + F.col("before")).cast("int").alias("turn"), "ref", F.col("role").alias("speaker"))


_STEPS = {name: leaf.split(".") for name, leaf in {
    "current": "current_node",
    "node": "mapping.*",
    "parent": "mapping.*.parent",
    "role": "mapping.*.message.author.role",
    "msg_id": "mapping.*.message.id",
    "hidden": "mapping.*.message.metadata.is_visually_hidden_from_conversation",
    "part": "mapping.*.message.content.parts.[]",
    "text": "mapping.*.message.content.text",
    "child": "mapping.*.children.[]",
}.items()}
_SHOWN = re.compile(SHOWN)


def tree_path(text: str | None) -> list[tuple[int, str, str | None, bool]]:
    """pos, node, role and blank of the messages on the path of an exported conversation, read off its level columns.

    The path runs from current_node through the parents to the root; pos counts from
    there. Hidden nodes and nodes without a message are left out, though they have a pos.
    Broken paths and texts that are no JSON give nothing. A node without a `parent` field
    has the node whose children list it, of several the first in the record.
    """
    shredded = shred_record(text, list(_STEPS.values()))
    if shredded is None:
        return []
    leaf = dict(zip(_STEPS, shredded))
    names, (parents, _, levels) = leaf["node"][0], leaf["parent"]
    owner = lambda reps: accumulate((r <= 1 for r in reps), initial=-1)  # noqa: E731 (the node of each entry, after one for none)
    listed: dict[str, str | None] = {}
    if 2 in levels:
        children, reps, depths = leaf["child"]
        for i, child, depth in zip(islice(owner(reps), 1, None), children, depths):
            if depth >= 4 and child is not None:
                listed.setdefault(child, names[i])
    path = path_from(leaf["current"][0][0], names, parents, levels, listed)
    if not path:
        return []
    # Blank or not: the parts of each message, and `text` in their place.
    parts, reps, depths = leaf["part"]
    said = {names[i] for i, part, depth in zip(islice(owner(reps), 1, None), parts, depths) if depth >= 6 and part is not None and _SHOWN.search(part)}
    said |= {n for n, plain, depth in zip(names, leaf["text"][0], leaf["text"][2]) if depth == 5 and plain is not None and _SHOWN.search(plain)}
    (roles, _, at_role), at_id, hidden = leaf["role"], leaf["msg_id"][2], leaf["hidden"][0]
    return [(pos, names[i], roles[i], names[i] not in said) for pos, i in enumerate(path) if (at_role[i] >= 4 or at_id[i] >= 4) and hidden[i] != "true"]


def path_from(start: str | None, names: list, parents: list, levels: list[int], listed: dict[str, str | None]) -> list[int] | None:
    """Places of the nodes from the root down to the start; null if the path is broken.

    names, parents and levels are a record's nodes, their parent fields and the definition
    levels of those (below 3: no such field); listed gives the parents of nodes without
    the field.
    """
    place = {name: i for i, name in enumerate(names) if name is not None}
    if start not in place:
        return None
    path: list[int] = []
    seen: set[int] = set()
    at = start
    while at:
        i = place.get(at, -1)
        if i < 0 or i in seen:
            return None
        seen.add(i)
        path.append(i)
        at = parents[i] if levels[i] >= 3 else listed.get(at)
    return path[::-1]

"""Chat formatting (operator 6): a prefix tree of conversations.

Conversations that share initial turns share the nodes of those turns. Every node's tokens are emitted once, in one
depth-first stream; a node carries its place in that stream, the position id of its first token (the tokens of its
ancestors come before), and the intervals of the stream in which its ancestors lie, to which, besides itself, its
tokens may attend. Loss falls on the bodies of assistant turns.

Template: ``<|turn|>`` role ``<|text|>`` text ``<|end|>`` and a line break. In roles and texts each ``<``, ``[`` and
backslash is followed by a backslash, so no control string of this or other templates (``</s>``, ``[INST]``) is left in
them, and taking those backslashes away gives back the text. Head, body and end of a turn are tokenized on their own.

A node's key is a running hash of the turns down to it. The tree's depth-first order comes from sorting conversations
by their paths: a node stands where the first conversation that holds it stands. Turns of a conversation stream
through one task in order and are never gathered; nodes of very common first turns meet in pre-aggregated groups.
Ranks, places and intervals are worked out on narrow tables; tokens, as packed ids, move once to be told apart, once to
the conversations that read them back and once into their order, and are never broadcast.

Defined results: null texts and roles count as empty; turns are ordered by (turn, role, text), nulls first, so ties
and repeated rows have one order and each row is a turn; rows without a conv_id are one conversation; a very long text is
one body like any other; an empty table gives empty results; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common, graphs, packing, pretokens

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"


def escape(text: str) -> str:
    return re.sub(r"[<\[\\]", lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"([<\[\\])\\", r"\1", text)


@functools.lru_cache(2)
def codec(path: str):
    """(encode text -> packed ids, decode packed ids -> text, bytes an id) without special tokens, whatever strings the text has.

    Packed ids are little-endian unsigned numbers, of 16 bits if all ids fit. Encoding keeps the ids of pre-tokens at hand,
    where no special string can be left in an escaped text; decoding joins the tokens' bytes, as byte-level BPE does.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    vocabulary, specials = t.get_vocab(), t.get_added_tokens_decoder()
    most = max([*vocabulary.values(), *specials])
    kind, width = ("H", 2) if most < 1 << 16 else ("I", 4)
    cut, cache = pretokens.cutter(path), packing.Ids(path, kind)
    told_apart = all(re.search(r"<[^\\]|\[[^\\]", x.content) for x in specials.values())
    back = {c: b for b, c in packing.byte_letters().items()}
    pieces = [b""] * (most + 1)
    for word, k in vocabulary.items():
        pieces[k] = bytes(back[c] for c in word) if all(c in back for c in word) else word.encode()
    for k, token in specials.items():
        pieces[k] = token.content.encode()

    def encode(text: str) -> bytes:
        if told_apart and text not in (TEXT, END) and not text.startswith(TURN):
            return b"".join(b"".join(map(cache.__getitem__, cut(x))) for x in pretokens.text_blocks(text)) if text else b""
        return packing.little(t.encode(text, add_special_tokens=False).ids, kind) if text else b""

    def decode(ids: bytes) -> str:
        return b"".join(map(pieces.__getitem__, np.frombuffer(ids, f"<u{width}").tolist())).decode()

    return encode, decode, width


ROWS = "conv_id long, depth int, node binary, parent binary, tokens binary, n_tokens long, body_start int, body_end int, loss boolean, position long, path binary"


def turn_nodes(conversations: DataFrame, path: str) -> DataFrame:
    """A row for each turn with its node's key, parent and tokens; a conversation's last row has its path."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    arrow = common.to_arrow(ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, _, width = codec(path)
        head_end, end = encode(TEXT), encode(END)
        head_of = functools.lru_cache(1000)(lambda role: encode(TURN + escape(role)) + head_end)
        conv, depth, key, position, keys = object(), 0, b"", 0, bytearray()
        last: list | None = None  # held back until it is known whether the conversation goes on
        for batch in batches:
            for part in common.slices(batch):
                out: list[list] = []
                for c, role, text in zip(*(part.column(n).to_pylist() for n in ("conv_id", "role", "text")), strict=True):
                    if last is not None:
                        if c != conv:
                            last[-1] = bytes(keys)
                        out.append(last)
                    if c != conv or last is None:
                        conv, depth, key, position, keys = c, 0, b"", 0, bytearray()
                    parent = key
                    h = xxhash.xxh3_128(key)
                    h.update(b"%d:" % len(role.encode()))
                    h.update(role.encode())
                    h.update(text.encode())
                    key = h.digest()
                    keys += key[:8]
                    head = head_of(role)
                    body = encode(escape(text))
                    tokens = head + body + end
                    n = len(tokens) // width
                    last = [c, depth, key, parent, tokens, n, len(head) // width, (len(head) + len(body)) // width, role == "assistant", position, None]
                    position += n
                    depth += 1
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
        if last is not None:
            last[-1] = bytes(keys)
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(last, arrow, strict=True)], schema=arrow)

    return common.map_arrow(rows, run, ROWS)


def running(df: DataFrame, order: list[str], value: str | None, out: str, shared: common.Shared) -> DataFrame:
    """Adds the sum of ``value`` (or the number) of all rows before, in the global order, without one task for all rows."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id())
    dealt = shared.keep(dealt, out)
    amount = F.col(value) if value else F.lit(1)
    totals = dealt.groupBy("_p").agg(F.sum(amount).alias("t"))  # a row for each partition
    before = totals.select("_p", (F.sum("t").over(W.orderBy("_p")) - F.col("t")).alias("_b"))
    local = F.coalesce(F.sum(amount).over(W.partitionBy("_p").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return dealt.join(F.broadcast(before), "_p").withColumn(out, (local + F.col("_b")).cast("long")).drop("_p", "_b")


def prefix_tree(conversations: DataFrame, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, members, tokens).

    nodes: node, parent, depth, n_tokens, body_start, body_end, loss, position, at (place in the stream), uses (turns that
    share it), owner (the rank of its first conversation); members: conv_id, rank, depth, node; tokens: node, tokens (packed
    ids), a row for each turn.
    """
    shared = common.Shared(conversations.sparkSession)
    rows = shared.keep(turn_nodes(conversations, path), "rows")
    convs = running(rows.filter("path is not null").select("conv_id", (F.col("depth") + 1).alias("n"), "path"), ["path", "conv_id"], None, "rank", shared)
    convs = shared.keep(convs.select("conv_id", "rank", "n"), "convs")
    total = convs.agg(F.sum("n")).first()[0] or 0
    key = F.coalesce("conv_id", F.lit(-(1 << 62)))
    narrow = [x for x in rows.columns if x not in ("path", "tokens")]
    ranked = graphs.spread_join(rows.select(key.alias("c"), *narrow), convs.select(key.alias("c"), "rank", "n"), ["c"], "n", ["rank"], total)
    nodes = ranked.groupBy("node").agg(F.min("rank").alias("owner"), F.count(F.lit(1)).alias("uses"), *[F.first(x).alias(x) for x in ("parent", "depth", "n_tokens", "body_start", "body_end", "loss", "position")])
    nodes = running(nodes, ["owner", "depth"], "n_tokens", "at", shared)
    return shared.keep(nodes, "nodes"), shared.keep(ranked.select("conv_id", "rank", "depth", "node"), "members"), rows.select("node", "tokens")


def along(nodes: DataFrame, members: DataFrame, columns: list[str]) -> DataFrame:
    """Members with their nodes' columns, each conversation together and in order."""
    total = nodes.agg(F.sum("uses")).first()[0] or 0
    joined = graphs.spread_join(members, nodes, ["node"], "uses", columns, total)
    return joined.repartition("rank").sortWithinPartitions("rank", "depth")


PLACED = "node binary, parent binary, depth int, at long, n_tokens long, position long, loss_start int, loss_end int, attends array<struct<first:long,end:long>>"


def emit(nodes: DataFrame, members: DataFrame, tokens: DataFrame) -> DataFrame:
    """The stream: every node once, with its tokens, its position ids' start and its ancestors' intervals (joined where they touch)."""
    wanted = ["parent", "owner", "at", "n_tokens", "position", "body_start", "body_end", "loss"]
    arrow = common.to_arrow(PLACED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, spans = None, []
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["rank"] != rank:
                    rank, spans = r["rank"], []
                if r["owner"] == rank:
                    start, end = (r["body_start"], r["body_end"]) if r["loss"] else (0, 0)
                    out.append((r["node"], r["parent"], r["depth"], r["at"], r["n_tokens"], r["position"], start, end, [{"first": a, "end": b} for a, b in spans]))
                if spans and spans[-1][1] == r["at"]:
                    spans[-1] = (spans[-1][0], r["at"] + r["n_tokens"])
                else:
                    spans.append((r["at"], r["at"] + r["n_tokens"]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    placed = common.map_arrow(along(nodes, members, wanted), run, PLACED)
    return placed.join(tokens.dropDuplicates(["node"]), "node")


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"


BLOCK = 512  # stream places by which intervals meet the nodes that start in them


def under_intervals(stream: DataFrame, members: DataFrame) -> DataFrame:
    """(conv_id, rank, position, tokens, loss_start, loss_end, wanted): all of the stream to which a conversation's last node may attend, and itself.

    Found by places alone: its intervals are cut at blocks, and each block has the nodes that start in it. ``wanted`` is
    how many tokens the intervals have. Tokens join last, by place.
    """
    shared = common.Shared(stream.sparkSession)
    last = members.groupBy("rank").agg(F.max(F.struct("depth", "node", "conv_id")).alias("m")).select("rank", "m.node", "m.conv_id")
    ends = stream.join(last.groupBy("node").agg(F.count(F.lit(1)).alias("uses")), "node")
    total = members.count()
    own = F.struct(F.col("at").alias("first"), (F.col("at") + F.col("n_tokens")).alias("end"))
    ends = ends.select("node", "uses", F.concat("attends", F.array(own)).alias("spans"))
    found = graphs.spread_join(last, ends, ["node"], "uses", ["spans"], total)
    wanted = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    cut = found.select("conv_id", "rank", wanted.alias("wanted"), F.inline("spans"))
    cut = shared.keep(cut.select("*", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor((F.col("end") - 1) / BLOCK))).alias("block")), "cut")
    node = F.struct("at", "position", "loss_start", "loss_end")
    blocks = stream.withColumn("block", F.floor(F.col("at") / BLOCK)).groupBy("block").agg(F.collect_list(node).alias("held"))
    uses = cut.groupBy("block").agg(F.count(F.lit(1)).alias("uses"))
    met = graphs.spread_join(cut, blocks.join(uses, "block"), ["block"], "uses", ["held"], cut.count())
    inside = F.filter("held", lambda x: (x["at"] >= F.col("first")) & (x["at"] < F.col("end")))
    met = shared.keep(met.select("conv_id", "rank", "wanted", F.inline(inside)), "met")
    uses = met.groupBy("at").agg(F.count(F.lit(1)).alias("uses"))
    return graphs.salted_join(met, stream.select("at", "tokens").join(uses, "at"), "at", "uses", ["tokens"], met.count())


def read_back(nodes: DataFrame, members: DataFrame, tokens: DataFrame, path: str) -> DataFrame:
    """Per conversation, from the emitted stream: digests of the turns and of all text under the loss mask."""
    return rebuilt(common.Shared(nodes.sparkSession).keep(emit(nodes, members, tokens), "stream"), members, path)


def rebuilt(stream: DataFrame, members: DataFrame, path: str) -> DataFrame:
    """As ``read_back``: intervals say which tokens a conversation has, positions their order, loss spans what is learned.

    Fails if the positions of a conversation's tokens leave a gap or overlap, or its intervals hold other than whole nodes.
    """
    arrow = common.to_arrow(DIGEST)
    parse = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*)" + re.escape(END), re.S).fullmatch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decode, width = codec(path)
        rank, state, wanted = None, None, 0

        def done() -> tuple:
            c, n, turns, loss_n, loss, chars, tokens = state
            if tokens != wanted:
                raise ValueError(f"the intervals of conversation {c} have {wanted} tokens, its nodes {tokens}")
            return c, n, turns.hexdigest(), loss_n, loss.hexdigest(), chars, tokens

        names = ("rank", "conv_id", "wanted", "position", "tokens", "loss_start", "loss_end")
        for batch in batches:
            for part in common.slices(batch):
                out = []
                for r, conv, want, position, ids, start, end in zip(*(part.column(n).to_pylist() for n in names), strict=True):
                    if r != rank:
                        if state is not None:
                            out.append(done())
                        rank, state, wanted = r, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0], want
                    if position != state[6]:
                        raise ValueError(f"position {position} after {state[6]} tokens of conversation {state[0]}")
                    text = decode(ids)
                    role, body = map(unescape, parse(text).groups())
                    state[1] += 1
                    state[2].update(f"{role}\n{body}\n".encode())
                    if end > start:
                        under = unescape(decode(ids[width * start : width * end]))
                        state[3] += len(under)
                        state[4].update(under.encode())
                    state[5] += len(text)
                    state[6] += len(ids) // width
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(done(), arrow, strict=True)], schema=arrow)

    rows = under_intervals(stream, members).repartition("rank").sortWithinPartitions("rank", "position")
    return common.map_arrow(rows, run, DIGEST)


CONTROL = "</s>[INST] ok [/INST]"


def op6_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and of conversation -1, read back from the emitted stream."""
    rows = common.load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    path = pretokens.default_path("byte_bpe_50k.json")
    return read_back(*prefix_tree(rows.unionByName(extra), path), path).drop("n_tokens")


OP6_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)),
t AS (SELECT *, 24 + length(role) + length(text) + length(regexp_replace(role || text, '[^<\[\\]', '', 'g')) AS chars FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

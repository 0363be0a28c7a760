"""Edits of parse trees with string labels, as operations on columns of nodes.

The trees of a batch are the columns of their nodes in preorder, each with its level (1 for the root); levels alone say what
is below what: a node is inner if the next one is deeper, and as many nodes end after a node as the level falls. So label
edits are maps of columns, removals are masks, and a splice removes a node and lifts what is below it. What an edit asks of a
node's children goes up, and what it asks of the nodes above goes down, level by level, for all trees of the batch at once.
Columns are Arrow arrays inside Spark's tasks, without a shuffle; only ids of words and symbols come from joins.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parsewright.functions.arrays import arrow_column, in_pieces, listed

#: Forms of be, and the words and symbols of auxiliaries.
BE = ("be", "is", "are", "been", "am", "was", "were")
BE_SYMBOLS = ("VP", "VP-A", "VB")
AUXILIARIES = ("must", "may", "will", "can", "should", "have", "would", "does", "do", "shall", "could", "might", "did", "has", "had")
AUX_SYMBOLS = ("VP", "MD", "VB")
VERB_PHRASES = ("VP-A", "VB")
ALL = ("rmpunc", "flat", "pas", "aux", "rmhead")  # the preset's edits, in order

NODE = "struct<level:int,head:string,symbol:string,label:string>"


@dataclass
class Trees:
    """The nodes of a batch of trees: ``ends[k]`` to ``ends[k + 1]`` are tree k's, of which there are none where it is not ``valid``."""

    valid: np.ndarray
    ends: np.ndarray
    level: np.ndarray
    head: np.ndarray
    symbol: np.ndarray
    label: np.ndarray

    def tree(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.valid)), np.diff(self.ends))

    def following(self, end: int) -> np.ndarray:
        """The level of the next node of the tree, ``end`` after the last."""
        out = np.append(self.level[1:], end)
        out[self.ends[1:][np.diff(self.ends) > 0] - 1] = end
        return out

    def inner(self) -> np.ndarray:
        return self.following(0) > self.level

    def levels(self) -> list[np.ndarray]:
        """The nodes of each level from the roots down, in preorder."""
        by = np.argsort(self.level, kind="stable")
        return np.split(by, np.flatnonzero(np.diff(self.level[by])) + 1) if len(by) else []

    def parents(self) -> np.ndarray:
        """Each node's parent, -1 for a root: the last node before it one level up."""
        out, levels = np.full(len(self.level), -1), self.levels()
        for above, at in zip(levels, levels[1:]):
            out[at] = above[np.searchsorted(above, at) - 1]
        return out

    def only(self, keep: np.ndarray, **new: np.ndarray) -> Trees:
        """The nodes to keep, with some columns replaced."""
        ends = np.concatenate([[0], np.cumsum(keep)])[self.ends]
        return Trees(self.valid, ends, *[new.get(f, getattr(self, f))[keep] for f in FIELDS])

    def named(self, where: np.ndarray, **new: np.ndarray) -> Trees:
        """New heads or symbols, with the label that says so where asked."""
        made = {f: new.get(f, getattr(self, f)) for f in ("head", "symbol")}
        return replace(self, **made, label=np.where(where, made["head"] + "/" + made["symbol"], self.label))


FIELDS = ("level", "head", "symbol", "label")


def strings(values: list[str]) -> np.ndarray:
    out = np.empty(len(values), object)
    out[:] = values
    return out


# Text to nodes and back

_NODE_TOKEN = {k: re.compile(v, re.ASCII) for k, v in {"(": r"(?s)([(]?)\s*((?:\\.|[^()\s\\]|\\$)+)\s*([)\s]*)", "[": r"(?s)([\[]?)\s*((?:\\.|[^\[\]\s\\]|\\$)+)\s*([\]\s]*)"}.items()}
_SPACE, _ESCAPED, _SPECIAL = re.compile(r"\s", re.ASCII), re.compile(r"(?s)\\(.)"), re.compile(r"([()\\])")


def _levels(text: str) -> tuple[list[int], list[str]] | None:
    """Levels and labels of one tree's nodes."""
    token = _NODE_TOKEN["[" if text.lstrip(" ").startswith("[") else "("]
    levels, labels, level, at = [], [], 1, 0
    for m in token.finditer(text):
        if text[at : m.start()].strip(" ") or (labels and level < 2):
            return None
        at = m.end()
        levels.append(level)
        labels.append(_ESCAPED.sub(r"\1", m[2]) if "\\" in m[2] else m[2])
        level += len(m[1]) - len(_SPACE.sub("", m[3]))
    return (levels, labels) if labels and level == 1 and not text[at:].strip(" ") else None


def from_texts(texts: list[str | None]) -> Trees:
    found = [_levels(x) if x is not None else None for x in texts]
    ends = np.concatenate([[0], np.cumsum([len(x[0]) if x else 0 for x in found])])
    level = np.array([v for x in found if x for v in x[0]], np.int64)
    label = [v for x in found if x for v in x[1]]
    none = strings([""] * len(label))
    out = Trees(np.array([x is not None for x in found], bool), ends, level, none, none, strings(label))
    head, symbol = [], []
    for x, inner in zip(label, out.inner().tolist()):
        four = x.split("~") if inner else ()
        if len(four) >= 4:
            head.append("~".join(four[1:-2]))
            symbol.append(four[0])
        elif "/" in x:
            h, _, y = x.rpartition("/")
            head.append(h)
            symbol.append(y)
        else:
            head.append("" if inner else x)
            symbol.append(x if inner else "???")
    return replace(out, head=strings(head), symbol=strings(symbol))


def from_nodes(rows: pa.Array) -> Trees:
    nodes, valid = rows.flatten(), rows.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.where(valid, rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
    return Trees(valid, np.concatenate([[0], np.cumsum(sizes)]).astype(int), nodes.field("level").to_numpy(zero_copy_only=False).astype(int), *[strings(nodes.field(f).to_pylist()) for f in FIELDS[1:]])


def to_nodes(n: Trees) -> pa.Array:
    kinds = [pa.int32(), pa.string(), pa.string(), pa.string()]
    return listed(n.valid.tolist(), n.ends, pa.StructArray.from_arrays([pa.array(getattr(n, f), k) for f, k in zip(FIELDS, kinds)], FIELDS))


def to_texts(n: Trees) -> list[str | None]:
    """Parentheses and backslashes in labels are escaped; parentheses close after a node as its level falls to the next one's."""
    ends = np.maximum(n.level - n.following(1), 0).tolist()
    shown = [("(" if inner else "") + (_SPECIAL.sub(r"\\\1", x) if "(" in x or ")" in x or "\\" in x else x) + ")" * e for x, inner, e in zip(n.label, n.inner().tolist(), ends)]
    at = n.ends.tolist()
    return [" ".join(shown[at[k] : at[k + 1]]) if ok else None for k, ok in enumerate(n.valid.tolist())]


def _column(tree: Column, kind: str, read: bool, make: Callable[[Trees], pa.Array]) -> Column:
    """``make`` of the trees of a column of texts (``read``) or of arrays of nodes."""

    def run(rows: pa.Array) -> pa.Array:
        return in_pieces(rows, lambda x: make(from_texts(x) if read else from_nodes(x)), read)

    return arrow_column(run, kind)(tree)


def read(tree: Column) -> Column:
    """The nodes of one s-expression; null where the text is null, empty or not one tree.

    Parentheses are round or square as the first character says; a backslash takes the next character as it is. Inner
    labels are ``SYM~head~n~m`` or, as these edits print them, ``head/SYM``; leaves are ``head/SYM``, cut at the last slash.
    """
    return _column(tree, f"array<{NODE}>", True, to_nodes)


def write(nodes: Column) -> Column:
    """Back to text."""
    return _column(nodes, "string", False, lambda n: pa.array(to_texts(n), pa.string()))


# The edits

def _lower(heads: np.ndarray) -> np.ndarray:
    return strings([x.translate(_LOWER) for x in heads])


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")  # A-Z only, as the tree tools do


def set_labels(n: Trees) -> Trees:
    return n.named(np.ones(len(n.level), bool))


def convert(n: Trees, table: tuple[tuple[str, str], ...]) -> Trees:
    """Map symbols by a conversion table, of which the first match wins; what has no or an empty target stays."""
    first = {s: t for s, t in reversed(table)}
    to = strings([first.get(x) or "" for x in n.symbol])
    mapped = to != ""
    out = n.named(mapped & (n.head != ""), symbol=np.where(mapped, to, n.symbol))
    return replace(out, label=np.where(mapped & (n.head == ""), to, out.label))


def _spliced(n: Trees, out: np.ndarray, parent: np.ndarray) -> Trees:
    """Without the nodes that go out; what is below one rises by a level for each."""
    above = np.zeros(len(out), int)
    for at in n.levels()[1:]:
        above[at] = above[parent[at]] + out[parent[at]]
    return n.only(~out, level=n.level - above)


def _head_chains(n: Trees, up: bool, splice: bool) -> Trees:
    """From the bottom up: a node whose only child is a leaf of the same head becomes that leaf; with ``up`` symbols rise."""
    parent, levels = n.parents(), n.levels()
    symbol, leaf, out = n.symbol.copy(), ~n.inner(), np.zeros(len(n.level), bool)
    kids = np.bincount(parent[parent >= 0], minlength=len(parent))
    for at in levels[:0:-1]:
        above = parent[at]
        same = (n.head[above] != "") & (n.head[above] == n.head[at])
        if up:
            symbol[above[same]] = symbol[at[same]]  # the last such child's stays
        if splice:
            becomes = same & leaf[at] & (kids[above] == 1)
            symbol[above[becomes]], leaf[above[becomes]] = symbol[at[becomes]], True
            out[at] = becomes | (same & ~leaf[at])
    return _spliced(n.named(n.head != "", symbol=symbol), out, parent)


def flatten(n: Trees, up: bool = False) -> Trees:
    """Splice inner children that share their parent's head; with ``up`` the parent takes the last such child's symbol."""
    return _head_chains(n, up, True)


def propagate(n: Trees, up: bool = False) -> Trees:
    """The symbols of ``flatten`` without its splices."""
    return _head_chains(n, up, False)


def merge_verbs(n: Trees, words: tuple[str, ...], symbols: tuple[str, ...]) -> Trees:
    """Under such a word's verb phrase, splice inner verb phrases and take over the last one's head and symbol."""
    parent, inner = n.parents(), n.inner()
    among = lambda x, names: np.fromiter((v in names for v in x), bool, len(x))
    leads = inner & among(_lower(n.head), words) & among(n.symbol, symbols)
    head, symbol, mark, out = n.head.copy(), n.symbol.copy(), np.zeros(len(inner), bool), np.zeros(len(inner), bool)
    for at in n.levels()[:0:-1]:
        takes = at[leads[parent[at]] & among(symbol[at], VERB_PHRASES)]
        above = parent[takes]
        head[above], symbol[above], mark[above] = head[takes], symbol[takes], True  # the last one's stay
        out[takes] = inner[takes]
    return _spliced(n.named(mark, head=head, symbol=symbol), out, parent)


def raise_marks(n: Trees) -> Trees:
    """A closing ! or ? becomes the root's last child, as PUNCX: the last node in preorder ends the right edge of the tree."""
    last = n.ends[1:][np.diff(n.ends) > 1] - 1
    last = last[(n.symbol[last] == "PUNC") & ((n.head[last] == "!") | (n.head[last] == "?"))]
    at = np.zeros(len(n.level), bool)
    at[last] = True
    return replace(n.named(at, symbol=np.where(at, "PUNCX", n.symbol)), level=np.where(at, 2, n.level))


def strip_punctuation(n: Trees) -> Trees:
    """At every node the last child goes, with what is below it, if it is PUNC and not the only one."""
    parent = n.parents()
    kids = np.flatnonzero(parent >= 0)
    last = np.full(len(parent), -1)
    last[parent[kids]] = kids
    out = np.zeros(len(parent), bool)
    out[kids] = (last[parent[kids]] == kids) & (parent[kids] != kids - 1) & (n.symbol[kids] == "PUNC")
    for at in n.levels()[1:]:
        out[at] |= out[parent[at]]
    return n.only(~out)


def drop_heads(n: Trees) -> Trees:
    return replace(n, label=np.where(n.inner(), n.symbol, n.label))


def lower_heads(n: Trees) -> Trees:
    return n.named(n.head != "", head=_lower(n.head))


def expand_leaves(n: Trees) -> Trees:
    """A leaf ``head/SYM`` becomes ``(SYM head)``."""
    leaf = ~n.inner()
    twice = np.repeat(np.arange(len(leaf)), 1 + leaf)
    second = np.concatenate([[False], twice[1:] == twice[:-1]]) if len(twice) else np.zeros(0, bool)
    label = np.where(second, n.head[twice], np.where(leaf[twice], n.symbol[twice], n.label[twice]))
    ends = np.concatenate([[0], np.cumsum(1 + leaf)])[n.ends]
    return Trees(n.valid, ends, n.level[twice] + second, n.head[twice], n.symbol[twice], label)


@dataclass(frozen=True)
class Edits:
    """What to do to a tree, in order. ``vocab`` and ``convsym`` ask tables, so they are for ``edited`` only."""

    steps: tuple[str, ...]
    table: tuple[tuple[str, str], ...] = ()  # symbol conversion, first match wins
    up: bool = False
    max_id: int | None = None

    def apply(self, n: Trees) -> Trees:
        """The edited trees."""
        out = self.begin(n)
        for step in self.flat_steps():
            out = self.step(out, step)
        return expand_leaves(out) if "lf" in self.steps else out

    def begin(self, n: Trees) -> Trees:
        return convert(set_labels(n), self.table)  # once at the start and again as a step

    def flat_steps(self) -> list[str]:
        return [s for step in self.steps for s in (ALL if step == "all" else (step,)) if s != "lf"]  # lf is always last

    def step(self, n: Trees, step: str) -> Trees:
        edits: dict[str, Callable[[Trees], Trees]] = {
            "conv": lambda n: convert(n, self.table),
            "flat": lambda n: flatten(n, self.up),
            "noflat": lambda n: propagate(n, self.up),
            "pas": lambda n: merge_verbs(n, BE, BE_SYMBOLS),
            "aux": lambda n: merge_verbs(n, AUXILIARIES, AUX_SYMBOLS),
            "upqpunc": raise_marks,
            "rmpunc": strip_punctuation,
            "rmhead": drop_heads,
            "lower": lower_heads,
        }
        if step not in edits:
            raise ValueError(f"{step} needs tables: use edited()" if step in ("vocab", "convsym") else f"no edit {step}")
        return edits[step](n)


def edit(tree: Column, edits: Edits) -> Column:
    """The edited tree as text; null where the input is null, empty or not a tree."""
    return _column(tree, "string", True, lambda n: pa.array(to_texts(edits.apply(n)), pa.string()))


def both(tree: Column, edits: Edits) -> Column:
    """Two lines: the tree as it was read, and the edited one. Leaves of both are expanded if they are at all."""

    def lines(n: Trees) -> pa.Array:
        plain, made = to_texts(expand_leaves(n) if "lf" in edits.steps else n), to_texts(edits.apply(n))
        return pa.array([None if x is None else [x, y] for x, y in zip(plain, made)], pa.list_(pa.string()))

    return _column(tree, "array<string>", True, lines)


def numbered(df: DataFrame, key: str, nodes: str, table: DataFrame, field: str, max_id: int | None = None) -> DataFrame:
    """Heads (where there are any) or symbols of the nodes as ids of ``table`` (word, id), by a join on the word.

    Unknown ones, and ids above ``max_id``, become the id of UNK, 0 without one.
    """
    known = table.select(F.col("word").alias("_w"), F.col("id").cast("long").alias("_id"))
    if max_id is not None:
        known = known.filter(F.col("_id") <= max_id)
    unk = known.agg(F.coalesce(F.max(F.when(F.col("_w") == "UNK", F.col("_id"))), F.lit(0)).alias("_unk"))  # one row
    asked = df.select(F.col(key).alias("_key"), F.posexplode(F.transform(nodes, lambda x: x[field])).alias("_at", "_w"))
    ids = asked.join(known, "_w", "left").crossJoin(F.broadcast(unk)).groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("_id", "_unk").cast("string").alias("_id")))).alias("_ids"))

    def of(x: Column, k: Column) -> Column:
        got = F.get(F.col("_ids"), k)["_id"]
        head, symbol = (got, x["symbol"]) if field == "head" else (x["head"], got)
        return F.struct(x["level"].alias("level"), head.alias("head"), symbol.alias("symbol"), F.concat_ws("/", head, symbol).alias("label")).cast(NODE)

    named = (lambda x, k: F.when(x["head"] != "", of(x, k)).otherwise(x)) if field == "head" else of
    return df.join(ids, df[key] == F.col("_key"), "left").withColumn(nodes, F.transform(nodes, named)).drop("_key", "_ids")


def edited(df: DataFrame, key: str, tree: str, edits: Edits, vocab: DataFrame | None = None, symbols: DataFrame | None = None) -> DataFrame:
    """``df`` with its trees edited; ``vocab`` and ``symbols`` (word, id) serve the steps ``vocab`` and ``convsym``."""
    steps = edits.flat_steps()
    if not {"vocab", "convsym"} & set(steps):
        return df.withColumn(tree, edit(F.col(tree), edits))
    nodes = lambda text, make: _column(F.col(tree), f"array<{NODE}>", text, lambda n: to_nodes(make(n)))
    out = df.withColumn(tree, nodes(True, edits.begin))
    for step in steps:
        if step in ("vocab", "convsym"):
            table = vocab if step == "vocab" else symbols
            out = numbered(out, key, tree, table, "head" if step == "vocab" else "symbol", edits.max_id)
        else:
            out = out.withColumn(tree, nodes(False, lambda n, step=step: edits.step(n, step)))
    return out.withColumn(tree, _column(F.col(tree), "string", False, lambda n: pa.array(to_texts(expand_leaves(n) if "lf" in edits.steps else n), pa.string())))


# Lists and counts

def rule_lines(tree: Column, edits: Edits, right: bool = False, heads: bool = False, width: int = 30) -> Column:
    """A line for each inner node with a head: its symbol and its children's, padded, with head detail if asked."""

    def side(kids: list[str], own: str) -> str:
        return f"{' '.join(kids)} => {own}" if right else f"{own} <= {' '.join(kids)} "

    def lines(n: Trees) -> pa.Array:
        n = edits.apply(n)
        parent, inner = n.parents(), n.inner()
        full = np.where(n.head != "", n.head, n.label) + "/" + n.symbol
        for at in n.levels()[-2::-1]:  # an inner node without a head is named by its first child
            bare = at[inner[at] & (n.head[at] == "")]
            full[bare] = full[bare + 1] + "/" + n.symbol[bare]
        kids: list[list[int]] = [[] for _ in parent]
        for k, up in enumerate(parent.tolist()):
            if up >= 0:
                kids[up].append(k)
        keep = inner & (n.head != "")
        made = []
        for k in np.flatnonzero(keep).tolist():
            line = side([n.symbol[x] for x in kids[k]], n.symbol[k])
            made.append(line.ljust(width) + side([full[x] for x in kids[k]], full[k]) if heads else line)
        return listed([True] * len(n.valid), np.concatenate([[0], np.cumsum(keep)])[n.ends], pa.array(made, pa.string()))

    return _column(tree, "array<string>", True, lines)


def child_counts(tree: Column, edits: Edits) -> Column:
    """Children of each inner node of the edited tree, in preorder."""

    def counts(n: Trees) -> pa.Array:
        n = edits.apply(n)
        parent, inner = n.parents(), n.inner()
        kids = np.bincount(parent[parent >= 0], minlength=len(parent))
        return listed([True] * len(n.valid), np.concatenate([[0], np.cumsum(inner)])[n.ends], pa.array(kids[inner], pa.int32()))

    return _column(tree, "array<int>", True, counts)


def max_children(tree: Column, edits: Edits) -> Column:
    """Most children of a node of the edited tree; a lone leaf counts 0 here."""
    return F.coalesce(F.array_max(child_counts(tree, edits)), F.lit(0))


def pick(df: DataFrame, tree: str, edits: Edits, exactly: int | None = None, at_most: int | None = None) -> DataFrame:
    """Rows whose edited tree has exactly, or at most, so many children at a node."""
    most = max_children(F.col(tree), edits)
    return df.filter(F.col(tree).isNotNull() & (most == exactly if exactly is not None else most <= at_most))


def with_steps(edits: Edits, *steps: str) -> Edits:
    return replace(edits, steps=(*edits.steps, *steps))

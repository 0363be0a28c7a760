"""Trees as node rows. A tree's text is read inside its own row, so no shuffle is needed.

Reading walks the tokens of a batch of trees into columns of nodes; folds over arrays of structs would copy these at each step.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parsewright.functions.arrays import arrow_column, in_pieces, let, listed, scan

NODE = "struct<node_id:int,parent_id:int,child_idx:int,label:string,symbol:int,head:int,numc:int,epos:int,elen:int,is_leaf:boolean,level:int,last:int>"


def node_array(tree: Column) -> Column:
    """Preorder nodes of an s-expression with integer labels ``(sym ...)`` or ``(head/sym ...)`` and leaves ``head/sym``.

    A lone leaf without parentheses is a tree of one node. Null for null or empty text.
    """
    return arrow_column(_read, f"array<{NODE}>")(tree)


TOKEN = re.compile(r"[()]|[^() ]+")
FIELDS = ("parent_id", "child_idx", "label", "numc", "epos", "elen", "is_leaf", "level", "last")


def _read(texts: pa.Array) -> pa.Array:
    return in_pieces(texts, _nodes)


def _nodes(texts: list[str | None]) -> pa.Array:
    """The nodes of all texts in columns, one pass over the tokens of each; what an inner node lacks is filled at its end."""
    ends, made = [0], {f: [] for f in FIELDS}
    parent, place, labels, numc, epos, elen, leaf, level, last = made.values()
    for text in texts:
        first, leaves, path, opened = len(labels), 0, [], False
        for token in TOKEN.findall(text) if text and text.strip(" ") else ():
            if token == "(":
                opened = True
                continue
            if token == ")":
                opened = False
                if path:
                    n = path.pop()
                    elen[n], last[n] = leaves - epos[n], len(labels) - first
                continue
            n = len(labels)
            parent.append(path[-1] - first if path else -1)
            place.append(numc[path[-1]] if path else 0)
            if path:
                numc[path[-1]] += 1
            labels.append(token)
            numc.append(0)
            epos.append(leaves)
            leaf.append(not opened)
            level.append(len(path) + 1)
            if opened:
                path.append(n)
                elen.append(None)
                last.append(None)
            else:
                leaves += 1
                elen.append(1)
                last.append(n + 1 - first)
            opened = False
        ends.append(len(labels))
    ids = np.arange(len(labels), dtype=np.int32) - np.repeat(np.array(ends[:-1], np.int32), np.diff(ends))
    parts = [x.split("/") for x in labels]
    made["node_id"], made["symbol"], made["head"] = ids, [int(x[-1]) for x in parts], [int(x[0]) if len(x) > 1 else None for x in parts]
    kinds = {"label": pa.string(), "is_leaf": pa.bool_()}
    names = [f.split(":")[0] for f in NODE[7:-1].split(",")]
    return listed([x is not None and x.strip(" ") != "" for x in texts], ends, pa.StructArray.from_arrays([pa.array(made[f], kinds.get(f, pa.int32())) for f in names], names))


def node_expression(tree: Column) -> Column:
    """As ``node_array``, inside the JVM and far slower: folds copy what they carry at each step."""
    tokens = F.regexp_extract_all(tree, F.lit(r"[()]|[^() ]+"), F.lit(0))
    return F.when(F.length(F.trim(tree)) > 0, _folded(tokens))


MADE = "struct<kind:int,label:string,level:int,leaf:boolean,parent:int,child_idx:int,epos:int,last:int,leaves:int,kids:int>"


def _folded(tokens: Column) -> Column:
    # One pass over the tokens. ``path``: the open nodes with their children so far. Each token makes a node (kind 1) or
    # what is known of an inner node at its end (kind 2, ``parent`` is the node); results gather in blocks, so time
    # grows with the tokens. As inner nodes are numbered by preorder too, sorting their ends puts each at its rank.
    start = F.struct(F.array().cast("array<struct<node:int,kids:int>>").alias("path"), F.lit("").alias("before"), F.lit(0).alias("leaves"), F.lit(0).alias("n"), F.lit(None).cast(MADE).alias("made"))

    def step(acc: Column, token: Column) -> Column:
        opens, closes, leaf = token == "(", token == ")", acc["before"] != "("
        path = acc["path"]
        depth = F.size(path)
        top, above = F.get(path, depth - 1), F.slice(path, F.lit(1), F.greatest(depth - 1, F.lit(0)))
        bumped = F.when(depth > 0, F.concat(above, F.array(F.struct(top["node"].alias("node"), (top["kids"] + 1).alias("kids"))))).otherwise(path)
        inner = F.concat(bumped, F.array(F.struct(acc["n"].alias("node"), F.lit(0).alias("kids"))))
        names = ("kind", "label", "level", "leaf", "parent", "child_idx", "epos", "last", "leaves", "kids")
        row = lambda *v: F.struct(*[x.alias(n) for x, n in zip(v, names, strict=True)]).cast(MADE)
        no = F.lit(None)
        node = row(F.lit(1), token, depth + 1, leaf, F.coalesce(top["node"], F.lit(-1)), F.coalesce(top["kids"], F.lit(0)), acc["leaves"], no, no, no)
        end = row(F.lit(2), no, no, no, top["node"], no, no, acc["n"], acc["leaves"], top["kids"])
        return F.struct(
            F.when(opens, path).when(closes, above).when(leaf, bumped).otherwise(inner).alias("path"),
            token.alias("before"),
            (acc["leaves"] + F.when(opens | closes | ~leaf, 0).otherwise(1)).alias("leaves"),
            (acc["n"] + F.when(opens | closes, 0).otherwise(1)).alias("n"),
            F.when(opens, F.lit(None).cast(MADE)).when(closes, end).otherwise(node).alias("made"),
        )

    def finish(found: Column, closed: Column) -> Column:
        def node(n: Column, k: Column) -> Column:
            end = F.get(closed, k - n["epos"])  # of an inner node: before it are k - epos others
            return F.struct(
                k.alias("node_id"),
                n["parent"].alias("parent_id"),
                n["child_idx"].alias("child_idx"),
                n["label"].alias("label"),
                F.element_at(F.split(n["label"], "/"), -1).cast("int").alias("symbol"),
                F.when(n["label"].contains("/"), F.get(F.split(n["label"], "/"), F.lit(0)).cast("int")).alias("head"),
                F.when(n["leaf"], 0).otherwise(end["kids"]).alias("numc"),
                n["epos"].alias("epos"),
                F.when(n["leaf"], 1).otherwise(end["leaves"] - n["epos"]).alias("elen"),
                n["leaf"].alias("is_leaf"),
                n["level"].alias("level"),
                F.when(n["leaf"], k + 1).otherwise(end["last"]).alias("last"),
            )

        return F.transform(found, node)

    made = scan(tokens, start, step, lambda s, t: s["made"], MADE)
    ends = lambda m: F.array_sort(F.transform(F.filter(m, lambda x: x["kind"] == 2), lambda x: F.struct(x["parent"].alias("node"), x["last"].alias("last"), x["leaves"].alias("leaves"), x["kids"].alias("kids"))))
    both = let(made, lambda m: F.struct(F.filter(m, lambda x: x["kind"] == 1).alias("found"), ends(m).alias("closed")))
    return let(both, lambda x: finish(x["found"], x["closed"]))


def with_nodes(df: DataFrame, tree: str = "e_tree", out: str = "nodes") -> DataFrame:
    return df.withColumn(out, node_array(F.col(tree)))


def nodes(df: DataFrame, key: str = "pair_id", tree: str = "e_tree") -> DataFrame:
    """A row for each node: key, node_id (preorder), parent_id (-1: root), child_idx, symbol, head, numc, epos, elen, is_leaf, level."""
    rows = df.select(key, F.inline(node_array(F.col(tree))))
    return rows.drop("label", "last")


def words_of(nodes_col: Column) -> Column:
    """Heads of the leaves, in order."""
    return F.transform(F.filter(nodes_col, lambda n: n["is_leaf"]), lambda n: n["head"])


def _rules(nodes_col: pa.Array) -> pa.Array:
    def of(piece: pa.Array) -> pa.Array:
        n = piece.flatten()
        sizes = np.asarray(pc.fill_null(pc.list_value_length(piece), 0))
        begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
        symbol = pc.cast(n.field("symbol"), pa.string()).to_pylist()
        parent = np.asarray(n.field("parent_id"))
        texts: list[list[str]] = [[x] for x in symbol]
        for k, up in enumerate(np.where(parent < 0, -1, parent + begin).tolist()):  # in preorder, so children come in their order
            if up >= 0:
                texts[up].append(symbol[k])
        inner = ~np.asarray(n.field("is_leaf").to_numpy(zero_copy_only=False), bool)
        at = np.flatnonzero(inner)
        rule = pa.array([" ".join(texts[k]) for k in at.tolist()], pa.string())
        ends = np.concatenate([[0], np.cumsum(inner)])[np.concatenate([[0], np.cumsum(sizes)])]
        return listed(piece.is_valid().to_pylist(), ends, pa.StructArray.from_arrays([n.field("node_id").take(pa.array(at)), n.field("numc").take(pa.array(at)), rule], ["node_id", "numc", "rule"]))

    return in_pieces(nodes_col, of, False)


def rule_array(nodes_col: Column) -> Column:
    """node_id, numc and rule ``parent child child ...`` of each inner node."""
    return arrow_column(_rules, "array<struct<node_id:int,numc:int,rule:string>>")(nodes_col)


def rules(df: DataFrame, nodes_col: str = "nodes") -> DataFrame:
    """A row for each inner node: the key columns, node_id and its rule ``parent child child ...`` as text."""
    return df.select(*[c for c in df.columns if c != nodes_col], F.inline(rule_array(F.col(nodes_col))))


def max_children(nodes_col: Column, leaf: int = 1) -> Column:
    """Most children of a node; ``leaf`` is what a lone leaf counts as (the two counting tools differ: 1 and 0)."""
    return F.greatest(F.array_max(F.transform(nodes_col, lambda n: n["numc"])), F.lit(leaf))


def replace_heads(nodes_col: Column, tree: Column, max_id: int, unk: int = 1) -> Column:
    """The tree's text with heads above ``max_id`` replaced, in one regular pass over its tokens."""
    tokens = F.regexp_extract_all(tree, F.lit(r"[() ]|[^() ]+"), F.lit(0))
    fixed = F.transform(tokens, lambda t: F.when(t.rlike(r"^\d+/") & (F.get(F.split(t, "/"), F.lit(0)).cast("int") > max_id), F.concat(F.lit(f"{unk}/"), F.get(F.split(t, "/"), F.lit(1)))).otherwise(t))
    return F.array_join(fixed, "")


def to_text(nodes_col: Column) -> Column:
    """An array of node structs (as ``node_array`` makes it) back to its s-expression.

    A node opens at its place in preorder; as many parentheses close after a leaf as the level falls to the next node.
    """
    n = F.col(nodes_col) if isinstance(nodes_col, str) else nodes_col

    def one(x: Column, k: Column) -> Column:
        ends = F.when(x["is_leaf"], F.greatest(x["level"] - F.coalesce(F.get(n, k + 1)["level"], F.lit(1)), F.lit(0))).otherwise(0)
        return F.concat(F.when(x["is_leaf"], F.lit("")).otherwise(F.lit("(")), x["label"], F.repeat(F.lit(")"), ends))

    return F.array_join(F.transform(n, one), " ")

"""EM training: parameters join to pairs by key, a chart per pair gives expected counts, group-bys give new parameters."""

from __future__ import annotations

import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parsewright.functions.lengths import CHINESE_BAND, DEFAULT_BAND, Band, sentence_ok
from parsewright.functions.tables import kept

from . import corpus, estep, params, trees
from .chart import Chart, Node, Viterbi, orders


@dataclass(frozen=True)
class Config:
    """How the model is trained. Defaults are the shipped configuration's."""

    iterations: int = 3
    chinese: bool = True
    cutoff: bool = True  # phrases only from the phrase table
    fertility: bool = True  # t over single words, with a fertility table
    shared_words: bool = True  # one table of inserted words for all contexts
    old_rules: bool = True  # orders without, insertions by (parent, child)
    lambda1: float | None = None  # phrase weight; None: one trained for each phrase
    lambda1_scaled: bool = False  # lambda1 to the power of the phrase's length
    lambda2: float = 1.0
    train_floor: float = 0.0
    test_floor: float = 1e-5
    align_floor: float = 0.0
    reset_lambda: bool = False  # by default lambda1 counts add up over iterations

    frozen: tuple[str, ...] = ()  # tables that training leaves as they are: t, lambda1, r, n

    @property
    def band(self) -> Band:
        return CHINESE_BAND if self.chinese else DEFAULT_BAND

    def with_options(self, **options) -> Config:
        return replace(self, **options)


@dataclass
class Model:
    """Parameter tables; ``equal`` is the first phase, in which every probability is the same."""

    config: Config
    allowed: DataFrame | None = None
    t: DataFrame | None = None
    fert: DataFrame | None = None
    lambda1: DataFrame | None = None
    r: DataFrame | None = None
    n: DataFrame | None = None
    insword: DataFrame | None = None
    equal: bool = True


#: Pairs of a block, which are alike and go through the chart together.
BLOCK = 64


def tasks(spark: SparkSession) -> int:
    """So many that all cores are busy: trees and charts take milliseconds for a few kilobytes, which partitions by size would leave to few tasks."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fitting(pairs: DataFrame, config: Config, blocks: bool = False) -> DataFrame:
    """(pair_id, f, nodes, n_e, ok): trees read, and whether the pair fits the limits.

    Sizes are counted in the tree's text, so that trees that don't fit are not read: their nodes are null. With ``blocks``
    pairs are sorted by lengths and the tree's shape over ranges of rows, and every ``BLOCK`` of a range have a ``block``.
    """
    size = F.regexp_count("e_tree", F.lit(r"[^() ]+"))
    leaves = size - (F.length("e_tree") - F.length(F.translate("e_tree", "(", "")))
    ok = sentence_ok(size, leaves, F.size("f"), config.band.columns(leaves)[1], config.lambda1 is None or config.lambda1 != 0, config.lambda2 != 0)
    rows = pairs.select("pair_id", "f", "e_tree", leaves.alias("n_e"), (ok & (F.coalesce(F.get("f", F.lit(0)), F.lit(1)) != 0)).alias("ok"))  # F led by a 0 is a manual skip
    if blocks:
        by = ["ok", "n_e", F.size("f"), F.regexp_replace("e_tree", "[^() ]+", ""), "pair_id"]
        rows = rows.repartitionByRange(tasks(pairs.sparkSession), *by).sortWithinPartitions(*by).withColumn("block", F.floor(F.monotonically_increasing_id() / BLOCK))
    return trees.with_nodes(rows.withColumn("e_tree", F.when(F.col("ok"), F.col("e_tree")))).select("pair_id", "f", "nodes", "n_e", "ok", *(["block"] if blocks else []))


def stretches(rows: DataFrame, config: Config) -> DataFrame:
    """The lookup keys of all fitting pairs. They stay the same over iterations."""
    return corpus.spans(rows.filter("ok").select("pair_id", "f", "nodes"), config.band, with_null=True)


@dataclass
class Keys:
    """What the fitting pairs ask of the tables. It stays the same over iterations."""

    stretches: DataFrame  # pair_id, epos, elen, fpos, flen, e, f
    phrases: DataFrame  # pair_id, f, epos, elen, e
    labels: DataFrame  # pair_id, kind (r: a rule, n: a context), label; each once a pair


def keys_of(rows: DataFrame, config: Config, allowed: DataFrame | None = None) -> Keys:
    """Of a start from a phrase table that alone allows phrases, ``allowed``, only its own phrases of several words are asked for: no other is ever counted."""
    rule = trees.rules(rows.filter("ok").select("pair_id", "nodes"))
    key = params.rule_key_old(F.col("rule")) if config.old_rules else F.col("rule")
    labels = rule.select("pair_id", F.lit("r").alias("kind"), key.alias("label")).unionByName(contexts(rows, config).select("pair_id", F.lit("n").alias("kind"), F.col("ctx").alias("label")))
    asked, found = stretches(rows, config), phrases(rows)
    if allowed is not None and config.cutoff:
        several = allowed.filter(F.col("e").contains(" ")).select("e").distinct()
        known = lambda df: df.filter("elen = 1").unionByName(asking(df.filter("elen > 1")).join(several, "e", "left_semi").select(*df.columns))
        asked, found = known(asked), known(found)
    return Keys(asked, found, labels.distinct())


def prepare(pairs: DataFrame, config: Config) -> tuple[DataFrame, Keys]:
    rows = fitting(pairs, config)
    return rows, keys_of(rows, config)


def written(pairs: DataFrame, config: Config, allowed: DataFrame | None = None) -> tuple[DataFrame, Keys]:
    """As ``prepare``, each written once: trees are read once for all iterations, and plans of iterations stay small."""
    rows = checkpointed(fitting(pairs, config, blocks=True))
    keys = keys_of(rows, config, allowed)
    # fertility tables need stretches in the first phase alone, where they are read once
    asked = keys.stretches if config.fertility else checkpointed(keys.stretches)
    return rows, Keys(asked, *together([keys.phrases, keys.labels]))


def free(model: Model) -> bool:
    """Whether any stretch may translate any phrase, so that no table needs to be asked."""
    return model.equal and (model.allowed is None or not model.config.cutoff)


def asking(keys: DataFrame) -> DataFrame:
    """Keys whose join never broadcasts: tables of phrases or words grow with the corpus, and take many times their size on disk."""
    return keys.hint("merge")


def lookup(keys: DataFrame, model: Model) -> DataFrame:
    """Adds prob to the stretches; those of probability 0 leave. Not for fertility tables, whose products the chart takes.

    In the equal phase only phrases of several words are asked for: the chart knows what word to word is.
    """
    c = model.config
    if model.equal:
        rows = params.t_lookup_equal(asking(keys.filter("elen > 1 OR flen > 1")), model.allowed, True, c.fertility)
    else:
        rows = asking(keys).join(model.t.select("e", "f", "prob"), ["e", "f"])
    return rows.filter("prob > 0")


def phrases(rows: DataFrame) -> DataFrame:
    """(pair_id, f, epos, elen, e) of the non-unary nodes of fitting pairs, whose spans are distinct; made inside each row."""
    made = rows.filter("ok").select("pair_id", "f", trees.words_of(F.col("nodes")).cast("array<string>").alias("_e"), F.filter("nodes", lambda n: n["numc"] != 1).alias("n"))
    made = made.select("pair_id", "f", "_e", F.explode("n").alias("n"))
    e = F.array_join(F.slice("_e", F.col("n.epos") + 1, F.col("n.elen")), " ")
    return made.select("pair_id", "f", F.col("n.epos").alias("epos"), F.col("n.elen").alias("elen"), e.alias("e"))


#: What is gathered for a pair, with its type; null where nothing was found.
FOUND = {
    "t": "array<struct<epos:int,elen:int,fpos:int,flen:int,prob:double>>", "tw": "array<struct<epos:int,elen:int,f:string,prob:double>>", "fert": "array<struct<epos:int,elen:int,n:int,prob:double>>",
    "l1": "array<struct<epos:int,elen:int,l1:double>>", "r": "map<string,array<double>>", "n": "map<string,array<double>>", "words": "map<string,double>",
}


def gathered(rows: DataFrame, keys: Keys, model: Model) -> DataFrame:
    """A row for each fitting pair with all parameters that its chart needs. Gathering is bounded by the pair limits.

    All that is found meets its pair in one group. Under fertility the single-word entries and the fertilities of a pair's
    phrases are gathered, not its stretches.
    """
    c = model.config
    parts: list[DataFrame] = []
    part = lambda df, name, *columns: parts.append(df.select("pair_id", F.struct(*columns).alias(name)))
    if c.fertility and not model.equal:
        words = keys.phrases.select("pair_id", "epos", "elen", "e", F.explode(F.array_distinct("f").cast("array<string>")).alias("f"))
        part(asking(words).join(model.t.select("e", "f", "prob"), ["e", "f"]), "tw", "epos", "elen", "f", "prob")
        part(asking(keys.phrases.select("pair_id", "epos", "elen", "e")).join(model.fert.select("e", "n", "prob"), "e"), "fert", "epos", "elen", "n", "prob")
    elif not free(model):
        part(lookup(keys.stretches, model), "t", "epos", "elen", "fpos", "flen", "prob")
    if c.lambda1 is None:
        longer = keys.phrases.filter("elen > 1").select("pair_id", "epos", "elen", "e")
        table = model.lambda1 if model.lambda1 is not None else model.allowed.select("e", F.lit(0.0).alias("prob")).distinct()
        part(params.lambda1_lookup(asking(longer), table, model.equal, c.cutoff and model.allowed is not None), "l1", "epos", "elen", "l1")
    if not model.equal:
        label = lambda kind, name: keys.labels.filter(F.col("kind") == kind).select("pair_id", F.col("label").alias(name))
        r = model.r.groupBy("rule").agg(F.transform(F.sort_array(F.collect_list(F.struct("perm", "prob"))), lambda x: x["prob"]).alias("p"))
        part(label("r", "rule").join(r, "rule"), "r", "rule", "p")
        if c.shared_words:
            side = model.n.groupBy("ctx").agg(*[F.sum(F.when(F.col("ins") == k, F.col("prob")).otherwise(0.0)).alias(f"s{k}") for k in range(3)])
            part(label("n", "ctx").join(side, "ctx"), "n", "ctx", F.array("s0", "s1", "s2").alias("p"))
            words = rows.filter("ok").select("pair_id", F.explode(F.array_distinct("f").cast("array<string>")).alias("word"))
            part(asking(words).join(model.insword, "word"), "words", "word", "prob")
        else:  # full tables: only the words of the pair itself
            words = rows.filter("ok").select("pair_id", F.explode(F.array_distinct(F.concat(F.array(F.lit(0)), F.col("f"))).cast("array<string>")).alias("word"))
            full = asking(label("n", "ctx").join(words, "pair_id")).join(model.n, ["ctx", "word"])
            part(full, "n", F.concat_ws("#", "ctx", "ins", "word").alias("ctx"), F.array("prob").alias("p"))
    out = rows.filter("ok")
    names = [x.columns[1] for x in parts]
    if parts:
        every = parts[0]
        for x in parts[1:]:
            every = every.unionByName(x, allowMissingColumns=True)
        every = every.groupBy("pair_id").agg(*[F.collect_list(n).alias(n) for n in names])
        as_kept = lambda n: F.map_from_entries(n) if FOUND[n].startswith("map") else F.col(n)
        out = out.join(every.select("pair_id", *[F.when(F.size(n) > 0, as_kept(n)).alias(n) for n in names]), "pair_id", "left")
    return out.withColumns({n: F.lit(None).cast(kind) for n, kind in FOUND.items() if n not in names})


def contexts(rows: DataFrame, c: Config) -> DataFrame:
    """(pair_id, node_id, ctx): under which context each node's insertions stand; the root's is TOP's rule."""
    n = F.col("nodes")
    kids = lambda x: F.array_join(F.transform(F.filter(n, lambda y: y["parent_id"] == x["node_id"]), lambda y: y["symbol"].cast("string")), " ")

    def context(x):
        parent = F.get(n, x["parent_id"])
        top = F.concat(F.lit("0 "), x["symbol"].cast("string"))
        if c.old_rules:
            return F.when(x["parent_id"] < 0, F.concat(top, F.lit("|0"))).otherwise(F.concat(F.concat_ws(" ", parent["symbol"], x["symbol"]), F.lit("|0")))
        return F.when(x["parent_id"] < 0, F.concat(top, F.lit("|0"))).otherwise(F.concat(F.concat_ws(" ", parent["symbol"].cast("string"), kids(parent)), F.lit("|"), x["child_idx"].cast("string")))

    made = F.transform(n, lambda x: F.struct(x["node_id"].alias("node_id"), context(x).alias("ctx")))
    return rows.filter("ok").select("pair_id", F.inline(made))


#: Columns of a gathered row; structs come as one array a field, which Arrow hands over without a Python object an entry.
GATHERED = {
    "pair_id": (), "f": (), "n_e": (), "r": (), "n": (), "words": (),
    "nodes": ("node_id", "parent_id", "child_idx", "symbol", "head", "numc", "epos", "elen", "is_leaf"),
    "t": ("epos", "elen", "fpos", "flen", "prob"), "tw": ("epos", "elen", "f", "prob"), "fert": ("epos", "elen", "n", "prob"), "l1": ("epos", "elen", "l1"),
}


def flat(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"{c}.{x}").alias(f"{c}__{x}") if x else F.col(c) for c, xs in GATHERED.items() for x in xs or ("",)], *[c for c in rows.columns if c == "block"])


def spread(rows: DataFrame) -> DataFrame:
    """Gathered rows over all cores, those of a block in one task."""
    return flat(rows).repartition(tasks(rows.sparkSession), *[c for c in rows.columns if c == "block"])


class Row:
    """A gathered row: ``nodes`` as dictionaries, the tables as tuples of arrays (None where nothing was found)."""

    def __init__(self, row):
        self.pair_id, self.f, self.n_e, self.r, self.n, self.words = row.pair_id, row.f, row.n_e, row.r, row.n, row.words
        names = GATHERED["nodes"]
        self.nodes = [dict(zip(names, x, strict=True)) for x in zip(*[getattr(row, f"nodes__{n}").tolist() for n in names], strict=True)]
        for table in ("t", "tw", "fert", "l1"):
            columns = tuple(getattr(row, f"{table}__{n}") for n in GATHERED[table])
            setattr(self, table, None if columns[0] is None else columns)


def translations(row, config: Config, model_free: bool, equal: bool) -> dict[tuple[int, int], np.ndarray]:
    """[first, length] of every phrase's stretches, by (epos, elen); [0, 0] is the empty word."""
    f = [str(int(x)) for x in row.f]
    n = len(f)
    out: dict[tuple[int, int], np.ndarray] = {}
    if equal:
        for x in row.nodes:
            key = (x["epos"], x["elen"])
            if x["numc"] == 1 or not (model_free or key[1] == 1):
                continue
            t = out[key] = np.zeros((n + 1, n + 1))
            low, high = config.band.of(key[1]) if model_free else (1, 1)
            for m in range(low, min(high, n) + 1):
                t[: n - m + 1, m] = params.EQUAL ** (1 + m * config.fertility)
            if key[1] == 1:
                t[0, 0] = params.EQUAL
    if row.t is not None:
        epos, elen, fpos, flen, prob = row.t
        code = epos.astype(np.int64) * 1024 + elen
        by = np.argsort(code, kind="stable")
        keys, begin = np.unique(code[by], return_index=True)
        for key, at in zip(keys.tolist(), np.split(by, begin[1:]), strict=True):
            t = out.setdefault((key // 1024, key % 1024), np.zeros((n + 1, n + 1)))
            t[fpos[at], flen[at]] = prob[at]
    if row.fert is None:
        return out
    words: dict[tuple[int, int], dict[str, float]] = {}
    if row.tw is not None:
        for epos, elen, word, prob in zip(*[x.tolist() for x in row.tw], strict=True):
            words.setdefault((epos, elen), {})[word] = prob
    for epos, elen, m, prob in zip(*[x.tolist() for x in row.fert], strict=True):
        key = (epos, elen)
        low, high = config.band.of(elen)
        if m > n or not (low <= m <= high or (m == 0 and elen == 1)):
            continue
        t = out.setdefault(key, np.zeros((n + 1, n + 1)))
        if m == 0:
            t[0, 0] = prob
            continue
        one = np.array([words.get(key, {}).get(w, 0.0) for w in f])
        product = np.ones(n - m + 1)
        for k in range(m):
            product = product * one[k : n - m + 1 + k]
        t[: n - m + 1, m] = prob * product
    return out


def as_map(value) -> dict:
    return {} if value is None else dict(value)


def build(row, config: Config, model_free: bool, equal: bool, floor: float) -> tuple[Chart, list[str | None], list[str], dict]:
    """The chart of a gathered row, with each node's rule and insertion context, and the translations found."""
    f = [int(x) for x in row.f]
    n = len(f)
    listed = row.nodes
    kids: list[list[int]] = [[] for _ in listed]
    for x in listed:
        if x["parent_id"] >= 0:
            kids[x["parent_id"]].append(x["node_id"])
    symbol = [x["symbol"] for x in listed]
    r, nn, words = as_map(row.r), as_map(row.n), as_map(row.words)
    l1 = phrase_weights(row)
    t_of = translations(row, config, model_free, equal)
    nodes, t, rules, ctxs = [], [], [], []
    for k, x in enumerate(listed):
        parent = x["parent_id"]
        rule = " ".join(str(symbol[c]) for c in [k, *kids[k]]) if kids[k] else None
        if rule and config.old_rules:
            rule = "9999 " + rule.split(" ", 1)[1]
        if parent < 0:
            ctx = f"0 {symbol[k]}|0"
        elif config.old_rules:
            ctx = f"{symbol[parent]} {symbol[k]}|0"
        else:
            ctx = " ".join(str(symbol[c]) for c in [parent, *kids[parent]]) + f"|{x['child_idx']}"
        count = math.factorial(len(kids[k])) if kids[k] else 0
        if equal:
            order = np.full(count, params.EQUAL)
            none, right, left = params.EQUAL, np.full(n, params.EQUAL), np.full(n, params.EQUAL)
        else:
            order = np.zeros(count)
            known = r.get(rule) if rule else None
            if known is not None:
                order[: len(known)] = known[:count]
            if config.shared_words:
                s = nn.get(ctx)
                s0, s1, s2 = s if s is not None else (0.0, 0.0, 0.0)
                w = np.array([words.get(str(z), 0.0) for z in f])
                none, right, left = s0, s1 * w, s2 * w
            else:
                one = lambda i, z: float(nn.get(f"{ctx}#{i}#{z}", (0.0,))[0])  # noqa: E731, B023
                none, right, left = one(0, 0), np.array([one(1, z) for z in f]), np.array([one(2, z) for z in f])
        if config.lambda1 is None:
            lam = l1.get((x["epos"], x["elen"]), 0.0)
        else:
            lam = config.lambda1 ** x["elen"] if config.lambda1_scaled else config.lambda1
        nodes.append(Node(symbol[k], x["head"], kids[k], x["epos"], x["elen"], config.band.of(x["elen"])[1], order + floor, none + floor, right + floor, left + floor, lam))
        t.append(t_of.get((x["epos"], x["elen"]), np.zeros((n + 1, n + 1))) + floor)
        rules.append(rule)
        ctxs.append(ctx)
    return Chart(nodes, n, t, config.lambda2), rules, ctxs, t_of


def phrase_weights(row) -> dict[tuple[int, int], float]:
    return {} if row.l1 is None else {(a, b): p for a, b, p in zip(*[x.tolist() for x in row.l1], strict=True)}


TABLES = {t: GATHERED[t] for t in ("t", "tw", "fert", "l1")}
#: Rows that a task makes before it hands them on.
HELD = 20_000
EVENTS = "kind string, a string, b string, i int, cnt double, pair_id long"


def events(data: DataFrame, model: Model, floor: float, count: bool = True) -> DataFrame:
    """E-step: per pair a ``prob`` row (cnt: its probability, i: its E words) and, if asked, expected counts to be summed.

    Kinds: t (e, f), fert (e, i words), lambda1 and lambda1n (e), r (rule, order i), n (context, word, side i); with shared
    words n (context, side i) and insword (word in b). Those of several pairs may be one row; only ``prob`` has a pair.
    """
    config, equal, model_free = model.config, model.equal, free(model)
    if not count and model_free and config.lambda1 is not None:
        return spread(data).mapInPandas(lambda frames: shape_events(frames, config, floor), EVENTS)
    tables = TABLES
    return spread(data).mapInArrow(lambda batches: estep.events(batches, tables, config, model_free, equal, floor, count, HELD), EVENTS)


def _totals(data: DataFrame, model: Model, floor: float, make, schema: str) -> DataFrame:
    config, equal, model_free = model.config, model.equal, free(model)
    # where nothing is looked up a task makes few charts, so rows stay where they are
    rows = flat(data) if model_free and equal and config.lambda1 is not None else spread(data)
    return rows.mapInArrow(lambda batches: make(batches, TABLES, config, model_free, equal, floor), schema)


def order_counts(data: DataFrame, model: Model, floor: float) -> DataFrame:
    """(rule, perm, cnt): expected counts of orders over all pairs. No other counts are made."""
    made = _totals(data, model, floor, estep.order_counts, "rule string, perm int, cnt double")
    return made.groupBy("rule", "perm").agg(F.sum("cnt").alias("cnt"))


def count_totals(data: DataFrame, model: Model, floor: float) -> DataFrame:
    """A row for each pair of a probability: its expected orders, insertions (none, right or left), translations, and foreign
    words made by either. Summed where the pair is: a pair's hundreds of counts are no rows."""
    return _totals(data, model, floor, estep.count_totals, "pair_id long, orders double, insertions double, translations double, foreign_words double")


#: Shapes whose probability a worker remembers over its tasks.
SHAPES = 100_000
_shapes: dict[tuple[Config, float], dict[tuple[bytes, bytes, int], float]] = {}


def shape_events(frames: Iterator[pd.DataFrame], config: Config, floor: float) -> Iterator[pd.DataFrame]:
    """``prob`` rows where nothing is looked up: every parameter is then the same, so a pair's probability hangs on its tree's
    shape and its number of foreign words alone. A chart is made for each of these that a worker meets, not for each pair."""
    known = _shapes.setdefault((config, floor), {})
    for frame in frames:
        probs = []
        for row in frame.itertuples(index=False):
            key = (np.asarray(row.nodes__parent_id, np.int32).tobytes(), np.asarray(row.nodes__elen, np.int32).tobytes(), len(row.f))
            if key not in known:
                if len(known) >= SHAPES:
                    known.clear()
                known[key] = build(Row(row), config, True, True, floor)[0].total
            probs.append(known[key])
        yield pd.DataFrame({"kind": "prob", "a": "", "b": "", "i": frame["n_e"].astype("int32"), "cnt": probs, "pair_id": frame["pair_id"]})


def update(model: Model, sums: DataFrame) -> Model:
    """M-step from summed counts (kind, a, b, i, cnt)."""
    c = model.config
    pick = lambda kind: sums.filter((F.col("kind") == kind) & (F.col("cnt") > 0))
    t = params.normalize(pick("t").select(F.col("a").alias("e"), F.col("b").alias("f"), "cnt"), ["e"])
    fert = params.normalize(pick("fert").select(F.col("a").alias("e"), F.col("i").alias("n"), "cnt"), ["e"]) if c.fertility else None
    l1 = None
    if c.lambda1 is None:
        both = sums.filter(F.col("kind").isin("lambda1", "lambda1n")).groupBy(F.col("a").alias("e")).agg(F.sum(F.when(F.col("kind") == "lambda1", F.col("cnt")).otherwise(0.0)).alias("cnt"), F.sum(F.when(F.col("kind") == "lambda1n", F.col("cnt")).otherwise(0.0)).alias("ncnt"))
        l1 = params.lambda1_update(model.lambda1, both, c.reset_lambda)
    r = params.normalize(pick("r").select(F.col("a").alias("rule"), F.col("i").alias("perm"), "cnt"), ["rule"])
    # absent orders of a rule have probability 0: fill them, so that arrays keep their places
    counts = F.size(F.split("rule", " ")) - 1
    factorial = F.element_at(F.array(*[F.lit(len(orders(k))) for k in range(1, 5)]), counts)
    r = r.select("rule").distinct().select("rule", F.explode(F.sequence(F.lit(0), factorial - 1)).alias("perm")).join(r, ["rule", "perm"], "left").select("rule", "perm", F.coalesce("prob", F.lit(0.0)).alias("prob"))
    ins = pick("n").select(F.col("a").alias("ctx"), F.col("i").alias("ins"), F.col("b").alias("word"), "cnt")
    if c.shared_words:
        n = params.normalize(ins.groupBy("ctx", "ins").agg(F.sum("cnt").alias("cnt")), ["ctx"])
        words = pick("insword").groupBy(F.col("b").alias("word")).agg(F.sum("cnt").alias("cnt"))
        total = words.agg(F.sum("cnt").alias("_total"))
        insword = words.crossJoin(F.broadcast(total)).select("word", (F.col("cnt") / F.col("_total")).alias("prob"))  # one row
    else:
        n, insword = params.normalize(ins, ["ctx"]), None
    made = Model(c, model.allowed, t, fert, l1, r, n, insword, False)
    for name in c.frozen:
        for table in {"t": ("t", "fert"), "n": ("n", "insword")}.get(name, (name,)):
            setattr(made, table, getattr(model, table))
    return made


def from_dumps(config: Config, t_rows: DataFrame, rn_rows: DataFrame) -> Model:
    """A model from rows of the ``ttable`` and ``rntable`` sources."""
    t = t_rows.filter("kind = 't'").select("e", "f", "prob")
    fert = t_rows.filter("kind = 'fert'").select("e", "n", "prob")
    l1 = t_rows.filter("kind = 'lambda1'").select("e", "prob", F.lit(0.0).alias("cnt"), F.lit(0.0).alias("ncnt"))
    r = rn_rows.filter("kind = 'r'").select("rule", F.col("i").alias("perm"), "prob")
    sides = rn_rows.filter("kind = 'n'").select(F.concat_ws("|", "rule", F.col("i").cast("string")).alias("ctx"), "ins", "word", "prob")
    words = rn_rows.filter("kind = 'insword'").select("word", "prob") if config.shared_words else None
    return Model(config, None, t, fert, l1, r, sides.drop("word") if config.shared_words else sides, words, False)


def read_config(*texts: str) -> dict[str, str]:
    """``Name="value"`` lines of several configuration texts; later ones override; # starts a comment."""
    out: dict[str, str] = {}
    for text in texts:
        for line in text.splitlines():
            line = line.split("#", 1)[0].strip()
            if "=" in line:
                name, _, value = line.partition("=")
                out[name.strip()] = value.strip().strip("\"'")
    return out


def perplexity(probs: DataFrame) -> DataFrame:
    """One row from (pair_id, n_e, prob): pairs, zero (of probability 0 or not finite), e_words, log2, perplexity."""
    good = (F.col("prob") > 0) & ~F.isnan("prob") & (F.col("prob") < F.lit(float("inf")))
    out = probs.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(~good).alias("zero"), F.sum(F.when(good, F.col("n_e")).otherwise(0)).alias("e_words"), F.sum(F.when(good, F.log2("prob"))).alias("log2"))
    return out.withColumn("perplexity", F.pow(F.lit(2.0), -F.col("log2") / F.col("e_words")))


@dataclass
class Fit:
    model: Model
    history: DataFrame  # iteration, part, pairs, ng, zero, e_words, log2, perplexity


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage by a table in the shared folder, whose size joins can go by."""
    return kept(df)


def together(tables: list[DataFrame]) -> list[DataFrame]:
    """Each ``checkpointed``, side by side: small tables leave cores idle and wait for their plans."""
    with ThreadPoolExecutor(len(tables)) as pool:
        return list(pool.map(checkpointed, tables))


def train(pairs: DataFrame, allowed: DataFrame | None = None, test: DataFrame | None = None, config: Config = Config(), start: Model | None = None, final_test: bool = False) -> Fit:
    """EM over (pair_id, e_tree, f). Each iteration tests (if there is a test part), then trains; the last model is returned.

    ``allowed`` (e, f) is the phrase table of the equal-probability start.
    """
    spark = pairs.sparkSession
    model = start or Model(config, allowed=allowed if allowed is None else checkpointed(allowed))
    only = model.allowed if start is None else None
    parts = {"train": written(pairs, config, only)}
    if test is not None:
        parts["test"] = written(test, config, only)
    bad = {k: a.filter("NOT ok").count() for k, (a, _) in parts.items()}
    history = []
    still = {y for x in config.frozen for y in {"t": ("t", "fert"), "n": ("n", "insword")}.get(x, (x,))}  # what training leaves as it is

    def measure(found: DataFrame, part: str, iteration: int) -> None:
        row = perplexity(found.filter("kind = 'prob'").select("pair_id", F.col("i").alias("n_e"), F.col("cnt").alias("prob"))).first()
        history.append((iteration, part, row["pairs"], bad[part], row["zero"], row["e_words"] or 0, row["log2"] or 0.0, row["perplexity"] or float("nan")))

    for k in range(1, config.iterations + 1 + final_test):
        if test is not None:
            measure(checkpointed(events(gathered(*parts["test"], model), model, config.test_floor, False)), "test", k)
        if k > config.iterations:
            break
        data = events(gathered(*parts["train"], model), model, config.train_floor)
        # counts are summed as they are made; a pair's probability stays a row of its own
        sums = checkpointed(data.groupBy("kind", "a", "b", "i", "pair_id").agg(F.sum("cnt").alias("cnt")))
        measure(sums, "train", k)
        model = update(model, sums.drop("pair_id"))
        names = [x for x in ("t", "fert", "lambda1", "r", "n", "insword") if getattr(model, x) is not None and x not in still]
        for name, table in zip(names, together([getattr(model, x) for x in names]), strict=True):
            setattr(model, name, table)
    schema = "iteration int, part string, pairs long, ng long, zero long, e_words long, log2 double, perplexity double"
    return Fit(model, spark.createDataFrame(history, schema))


def derivations(pairs: DataFrame, model: Model, make, schema: str, floor: float | None = None) -> DataFrame:
    """Rows that ``make(row, viterbi, total)`` yields for the best derivation of every fitting pair."""
    config = model.config
    data = spread(gathered(*written(pairs, config), model))  # what the pairs are made from is not read for each table
    low, equal, model_free = config.align_floor if floor is None else floor, model.equal, free(model)
    from pyspark.sql import types as T

    names = [f.name for f in T._parse_datatype_string(schema)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in map(Row, frame.itertuples(index=False)):
                chart = build(row, config, model_free, equal, low)[0]
                out += list(make(row, Viterbi(chart), chart.total))
            yield pd.DataFrame(out, columns=names)

    return data.mapInPandas(run, schema)

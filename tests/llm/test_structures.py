"""Near copies, conversations, pages and the whole pipeline."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from parsewright.llm import chat, graphs, html_text, simhash

ODD = [(900, None), (901, ""), (902, " \n"), (903, "x " * 20000), (904, "twin"), (904, "twin")]


def brute_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(k) for k in range(len(prints))]


def test_fingerprint_in_blocks(monkeypatch):
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 4, 40, 700):
        text = " ".join(rng.choice(["Ab", "c", "É", "dd"]) for _ in range(n))
        for size in (1, 7, 300, 1 << 15):
            monkeypatch.setattr(simhash, "SHINGLES", size)
            assert simhash.fingerprint(text) == brute_print(text)


def test_masks_cover_every_pair():
    masks = simhash.covering_masks(3)
    rng = random.Random(1)
    assert len(masks) == 15
    for _ in range(3000):
        flips = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        assert any(m & flips == 0 for m in masks)


@pytest.mark.parametrize("chunk", [4, 1024])
def test_links_against_all_pairs(spark, chunk):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(12)]
    prints = sorted({b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(25)})
    nodes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, k, 1) for k, p in enumerate(prints)], "fp long, node long, n long")
    label = {r["node"]: r["label"] for r in graphs.connected(simhash.near_pairs(nodes, 3, len(prints), chunk)).collect()}
    assert [label.get(k, k) for k in range(len(prints))] == brute_components(prints)


def test_groups(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(40):
        w = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.randint(1, 80))]
        for _ in range(rng.randint(1, 4)):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            texts.append(" ".join(rng.choice([w, v])))
    docs = [(1000 - k, t, 7) for k, t in enumerate(texts)] + [(i, t, 7) for i, t in ODD]
    rows = simhash.groups(spark.createDataFrame(docs, "doc_id long, text string, fp int")).collect()
    assert len(rows) == len(docs)
    got = {(r["doc_id"], r["fp"] % (1 << 64)): r["component_id"] for r in rows}
    prints = [brute_print(t) for _, t, _ in docs]
    group = brute_components(prints)
    for k, (i, _, _) in enumerate(docs):
        assert got[i, prints[k]] == min(docs[j][0] for j in range(len(docs)) if group[j] == group[k])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.groups(empty).count() == 0
    loose = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (7, "a b c d"), (None, "zz")], "doc_id long, text string")
    assert collections.Counter(r["component_id"] for r in simhash.groups(loose).collect()) == {7: 3, None: 1}


def test_hot_keys_join(spark):
    rows = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN 1 ELSE id END AS k", "id")
    table = rows.groupBy("k").count().selectExpr("k", "count AS n", "k * 2 AS v")
    out = graphs.spread_join(rows, table, ["k"], "n", ["v"], 5000)
    assert out.count() == 5000
    assert out.filter("v IS NULL OR v <> k * 2").count() == 0


def test_salted_join(spark, monkeypatch):
    monkeypatch.setattr(graphs, "LEAST_HOT", 50)
    rows = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 1 ELSE id END AS k", "id")
    table = rows.groupBy("k").count().selectExpr("k", "count AS n", "k * 2 AS v")
    out = graphs.salted_join(rows, table, "k", "n", ["v"], 3000)
    assert sorted(map(tuple, out.collect())) == sorted((1 if i % 3 == 0 else i, i, 2 * (1 if i % 3 == 0 else i)) for i in range(3000))


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 180)] + [(500, k) for k in range(501, 900)] + [(5, 5)]
    label = {r["node"]: r["label"] for r in graphs.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert label == {k: 100 for k in range(101, 181)} | {k: 500 for k in range(501, 900)}


def test_long_paths_settle_and_leave_one_table(spark, tmp_path, monkeypatch):
    import os

    rng = random.Random(3)
    order = rng.sample(range(1000, 1400), 400)
    path = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long")
    monkeypatch.setattr(graphs.common, "shared_dir", lambda _: str(tmp_path))
    out = graphs.connected(path).collect()
    assert {r["node"]: r["label"] for r in out} == dict.fromkeys(range(1001, 1400), 1000)
    assert len([d for _, dirs, _ in os.walk(tmp_path) for d in dirs if d.startswith(("edges", "large"))]) == 1


def test_one_row_of_each_component_stays(spark):
    rng = random.Random(4)
    text = " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 99)) for _ in range(300))
    rows = [(7, text, "p"), (7, text, "q"), (3, text + " ", "r"), (None, text, "s"), (None, "alone in the corpus here", "t"), (9, "alone in the corpus here", "u"), (9, "another text of that id", "v"), (None, None, "w"), (None, None, "x")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, name string, fp int, component int").withColumn("_h", F.lit(1))
    kept = sorted((r["doc_id"] or -1, r["text"] or "") for r in simhash.keep_one(docs).collect())
    assert kept == [(-1, ""), (3, text + " "), (9, "alone in the corpus here"), (9, "another text of that id")]
    assert simhash.keep_one(docs).columns == docs.columns


def test_arrow_batches_keep_the_sessions_own_size(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.getAll.get(key)
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    try:
        spark.conf.set(key, "64m")
        assert simhash.groups(docs).count() == 1
        assert spark.conf.get(key) == "64m"
    finally:
        spark.conf.unset(key) if held is None else spark.conf.set(key, held)


# Conversations

TURNS = [(1, 0, "user", "hi <s> [INST] \\ x"), (1, 1, "assistant", "é\n<|end|>\n"), (2, 0, "user", "hi <s> [INST] \\ x"), (2, 1, "assistant", "other"), (2, 2, "user", None), (2, 3, "assistant", ""), (3, 0, None, "<|endoftext|>"),
         (4, 0, "user", "a"), (4, 0, "user", "a"), (4, 0, "assistant", "b"), (5, None, "we\nird <|text|>", "[\\"), (5, 2, "assistant", "<\\"), (None, 0, "user", "lost"), (6, 0, "user", "hi <s> [INST] \\ x")]


@pytest.fixture
def tree(spark):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    df = spark.createDataFrame([(*t, 1) for t in TURNS], "conv_id long, turn long, role string, text string, depth int")
    return path, *chat.prefix_tree(df, path)


def test_escape():
    rng = random.Random(1)
    for _ in range(500):
        t = "".join(rng.choice("<[\\]|a>") for _ in range(rng.randint(0, 12)))
        e = chat.escape(t)
        assert chat.unescape(e) == t
        assert not any(s in e for s in ("<|", "[I", "</", "<s"))


def test_codec_against_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    t = tokenizers.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    encode, decode, width = chat.codec(path)
    assert width == 2
    for text in ["", chat.TEXT, chat.END, chat.TURN + "user", *map(chat.escape, ["<|endoftext|> a <|x|>", "it's  12½ o'clock\n\t x", "中文 字", "é" * 300, "\u1e9e ꟎"])]:
        ids = encode(text)
        assert np.frombuffer(ids, "<u2").tolist() == t.encode(text, add_special_tokens=False).ids
        assert decode(ids) == text


def test_read_back(tree):
    path, *made = tree
    by = collections.defaultdict(list)
    for c, turn, role, text in TURNS:
        by[c].append((turn if turn is not None else -1, role or "", text or ""))
    rows = {r["conv_id"]: r for r in chat.read_back(*made, path).collect()}
    assert set(rows) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        r = rows[c]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == sum(len(chat.TURN + chat.escape(a) + chat.TEXT + chat.escape(t) + chat.END) for _, a, t in turns)


def test_stream(tree):
    _, nodes, members, tokens = tree
    rows = sorted(chat.emit(nodes, members, tokens).collect(), key=lambda r: r["at"])
    at = {r["node"]: r for r in rows}
    assert len(rows) == len(at) == nodes.count()
    end = 0
    for r in rows:
        assert r["at"] == end  # gapless, each node once
        end += r["n_tokens"]
        up, covered, position = r["parent"], set(), 0
        while up:
            p = at[bytes(up)] if bytes(up) in at else at[up]
            covered |= set(range(p["at"], p["at"] + p["n_tokens"]))
            position += p["n_tokens"]
            up = p["parent"]
        assert r["position"] == position
        assert {x for s in r["attends"] for x in range(s["first"], s["end"])} == covered
    first = [r for r in rows if r["depth"] == 0]
    assert len(first) == 5  # conversations 1, 2 and 6 share a turn
    open_path = []
    for r in rows:  # depth first: a node's parent is on the path of the node before it
        open_path = open_path[: r["depth"]]
        assert r["depth"] == 0 or bytes(open_path[-1]) == bytes(r["parent"])
        open_path.append(r["node"])


def shifted(stream):
    return stream.withColumn("position", F.expr("position + int(depth = 1)"))


def shortened(stream):
    return stream.withColumn("attends", F.expr("transform(attends, x -> struct(x.first AS first, x.end - 1 AS end))"))


def unattended(stream):
    return stream.withColumn("attends", F.expr("slice(attends, 1, 0)"))


@pytest.mark.parametrize("wrong", [shifted, shortened, unattended])
def test_read_back_sees_a_wrong_stream(tree, monkeypatch, wrong):
    path, *made = tree
    emit = chat.emit
    monkeypatch.setattr(chat, "emit", lambda *a: wrong(emit(*a)))
    with pytest.raises(Exception, match="of conversation"):
        chat.read_back(*made, path).collect()


def test_read_back_uses_the_loss_spans(tree, monkeypatch):
    path, *made = tree
    emit = chat.emit
    monkeypatch.setattr(chat, "emit", lambda *a: emit(*a).withColumn("loss_end", F.col("loss_start")))
    assert {r["loss_chars"] for r in chat.read_back(*made, path).collect()} == {0}


def test_no_conversations(spark):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    made = chat.prefix_tree(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), path)
    assert chat.read_back(*made, path).count() == 0


# Pages

def page_text(page):
    tree = html_text.parse(page)
    return "\n".join(html_text.decode(tree, html_text.model().margins(html_text.features(tree))))


def test_extraction_on_made_pages():
    rng = random.Random(77)
    right = wrong = missed = 0
    for _ in range(150):
        page, main = html_text.made_page(rng)
        got = set(page_text(page).split("\n")) - {""}
        right, wrong, missed = right + len(got & main), wrong + len(got - main), missed + len(main - got)
    assert wrong <= 0.01 * right
    assert missed <= 0.01 * right


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="cookie-notice">We use cookies to make this better. Please accept.</div><div class="ad">Buy one of these now.</div>
<article><h1>A &amp; B</h1><p><b>First&nbsp;para<br>goes   on here with words, and more words to read. It has sentences.<p>Second para is <a href="x">linked</a> to a place and has an end.
<table><tr><td>cell one<td>cell two</table></article><section class="comments"><p>I liked this very much. Thank you.</p></section><form><label>Name</label><input></form><footer>&copy; someone</footer></body></html>"""


def test_extraction_of_a_page(spark):
    want = "A & B\nFirst para goes on here with words, and more words to read. It has sentences.\nSecond para is linked to a place and has an end.\ncell one\ncell two"
    pages = spark.createDataFrame([(1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "u", "<"), (5, "u", "<div>" * 3000), (6, "u", "<!-- open"), (None, "u", PAGE)], "page_id long, url string, html string")
    rows = html_text.extract(pages).collect()
    got = {r["page_id"]: r["text"] for r in rows}
    assert got[1] == got[None] == want
    assert all(got[k] == "" for k in (2, 3, 5, 6))
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_decoding_against_all_closed_sets():
    """Of all sets of nodes closed under taking parents (with the root) the one of the largest total."""
    rng = random.Random(6)
    for _ in range(200):
        n = rng.randint(2, 9)
        tree = html_text.Tree()
        for k in range(n):
            tree.add("#text", rng.randrange(k) if k else -1, text=str(k))
        margin = np.array([rng.choice([-2.5, -1, -0.3, 0.4, 1, 3]) + rng.random() / 100 for _ in range(n)])
        sets = [{0, *(k + 1 for k in range(n - 1) if bits >> k & 1)} for bits in range(1 << (n - 1))]
        best = max((s for s in sets if all(k == 0 or tree.parent[k] in s for k in s)), key=lambda s: sum(margin[k] for k in s))
        assert html_text.decode(tree, margin) == [str(k) for k in sorted(best) if k]


def leaves(page):
    return [t for t in html_text.parse(page).text if t]


def test_markup_as_browsers_read_it():
    assert leaves('<p class=a">Second<p title=\'x > y\' id="q>r">Third<p a="un>closed') == ["Second", "Third", "closed"]
    assert leaves("<p>x <math><mi>a</mi><mo>=</mo><mn>1</mn></math> y <svg><text>in</text></svg><noscript>z</noscript></p>") == ["x a=1 y inz"]
    assert leaves("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e<table><tr><td>1<td>2<tr><td>3</table>") == ["a", "b", "c", "d", "e", "1", "2", "3"]
    assert leaves("<p>a<table><tr><td><p>b<p>c</table>d") == ["a", "b", "c", "d"]
    assert leaves("<p>a &lt;b&gt; &#233;&nbsp;c<script>if (a<b) x='</p>'</script><style>p{}</style> d") == ["a <b> é c d"]
    assert leaves("a < b <3 </> <p") == ["a < b <3 </>"]


def test_deep_pages_take_time_in_proportion():
    import time

    def seconds(n):
        page = "<div>" * n + "<li>x</li><p>y" * n
        began = time.perf_counter()
        tree = html_text.parse(page)
        html_text.decode(tree, np.ones(len(tree.tag)))
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(100_000) < 25 * max(seconds(10_000), 0.02)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_extraction_of_the_tables_pages(folder):
    """Blocks of the article, read by a plain pattern that fits these pages alone, against what is extracted."""
    import os

    if not os.path.isdir(folder):
        pytest.skip("no tables here")
    rows = duckdb.sql(f"SELECT html FROM '{folder}/pages.parquet' WHERE html IS NOT NULL").fetchall()
    right = wrong = missed = 0
    for (page,) in rows:
        body = re.search(r"(?s)<article>(.*?)</article>", page)
        want = collections.Counter(leaves(re.sub(r'(?s)<(div|aside|section|ul|nav|form)[^>]*>.*?</\1>', "", body[1])) if body else [])
        got = collections.Counter(t for t in page_text(page).split("\n") if t)
        right, wrong, missed = right + (got & want).total(), wrong + (got - want).total(), missed + (want - got).total()
    assert right > 100
    assert right / (right + missed) >= 0.98
    assert right / (right + wrong) >= 0.98


# Registered SQL

@pytest.mark.parametrize("name", ["op6_prefix_tree", "op10_url_reputation"])
def test_oracles(spark, tmp_path, name):
    from parsewright.llm import registry

    conv = [(c, t, r, x) for c, t, r, x in TURNS if c is not None]
    spark.createDataFrame(conv, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    hosts = ["a.example.com", "www.example.com", "b.net", "c.org", "d.c.org", "e.com", "f.e.com"]
    rng = random.Random(1)
    html = lambda: rng.choice([None, "", "<p>One. Two.</p>", "<script>a. b. c. d. e.</script><!-- x. y. --><P>" + "End. " * 6, "<a href=x>A. B. C. D. E.</a>F." * 2])
    urls = [(k, f"http://{rng.choice(hosts)}{rng.choice(['', ':80'])}/{rng.choice(['en', 'es', 'fr', 'casino', 'pills'])}/{k}", html()) for k in range(300)] + [(301, None, "x"), (302, "http://a.co.uk", "y")]
    spark.createDataFrame(urls, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    for t in ("conversations", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(registry.ORACLES[name]).df()
    got = registry.QUERIES[name](spark, str(tmp_path)).toPandas()[list(want.columns)]
    key = want.columns[0]
    pd.testing.assert_frame_equal(got.sort_values(key).reset_index(drop=True).astype(str), want.sort_values(key).reset_index(drop=True).astype(str))


# Pipeline

def test_pipeline_against_its_parts(spark, tmp_path):
    """run() against the stages' rules worked out plainly, where they can be: copies, test items and packing."""
    public = pytest.importorskip("public_tokenizers")
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = random.Random(8)
    stems = {"aa": "ba da ga la ma".split(), "bb": "eth oth ith uth ath".split()}
    docs, labels = [], []
    for k in range(300):
        lang = "ab"[k % 2] * 2
        w = [rng.choice(stems[lang]) + rng.choice(stems[lang]) for _ in range(rng.randint(30, 90))]
        if k % 10 == 0:
            for _ in range(5):
                w[rng.randrange(len(w))] = rng.choice(["vileword", "nastyword"])
        docs.append([k, " ".join(w), lang, "s", 1, 0.5])
        labels.append((k, 1, int(k % 10 == 0)))
    item = " ".join(rng.choice(stems["aa"]) + rng.choice(stems["bb"]) for _ in range(25))
    for k in range(5):
        docs.append([400 + k, docs[3][1], docs[3][2], "s", 1, 0.5])
        docs.append([500 + k, docs[7 + k][1] + " " + item, "aa", "s", 1, 0.5])
    docs += [[600, None, None, None, None, None], [601, "!!", "aa", "s", 1, 0.5]]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score double").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r["doc_id"] for r in rows}
    clean = [d for d in docs if d[0] < 600 and "vileword" not in d[1] and "nastyword" not in d[1] and d[0] % 10 or 400 <= d[0] < 500]
    prints = [brute_print(d[1]) for d in clean]
    group = brute_components(prints)
    want = {min(clean[j][0] for j in range(len(clean)) if group[j] == g) for g in set(group)}
    want = {k for k in want if not 500 <= k < 600}
    assert kept == want
    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    texts = {d[0]: d[1] for d in docs}
    assert sum(r["length"] for r in rows) == sum(len(t.encode(texts[k], add_special_tokens=False).ids) + 1 for k in kept)
    by = collections.Counter()
    for r in rows:
        by[r["sequence_id"]] += r["length"]
    assert max(by.values()) <= 1024
    assert len(by) <= int(np.ceil(sum(by.values()) / 1024)) + 2


def test_stages_keep_extra_columns(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(1, "some text here", "en", 1, 2, 3), (1, "some text here", "en", 1, 2, 3), (None, "b", "en", 1, 2, 3), (2, None, None, 1, 2, 3)], "doc_id long, text string, lang string, score int, fp int, rank int")
    for rows, (name, stage) in zip((4, 3, 3, 4), corpus_pipeline.STAGES[:-1], strict=True):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert out.count() == rows, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0

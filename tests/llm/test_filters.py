"""Toxicity, quality, language, decontamination and url rules on small corpora."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from parsewright.llm import decontamination as D
from parsewright.llm import language, quality, toxicity, url_rules

ODD = [(900, None), (901, ""), (902, "  \n "), (903, "x " * 20000), (None, "some text"), (904, "twin"), (904, "twin")]


def words(rng, n, stems="ba be bi bo bu da de di do du ka ke ki ko ku".split()):
    return [rng.choice(stems) + rng.choice(stems) for _ in range(n)]


# Toxicity

def test_segments_against_all_pairs():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 25)
        scores = [rng.choice([-0.5, -0.5, -0.5, 1.0, 2.0, 0.7]) for _ in range(n)]
        got = toxicity.maximal_segments([(k, s) for k, s in enumerate(scores) if s != -0.5], 0.5)

        def maximal(a, b):  # repeatedly the best segment, then left and right of it
            best = max(((sum(scores[i:j]), -(j - i), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
            if best is None or best[0] <= 0:
                return []
            return [*maximal(a, best[2]), (best[2], best[3], best[0]), *maximal(best[3], b)]

        assert sum(s for _, _, s in got) == pytest.approx(sum(s for _, _, s in maximal(0, n)))
        assert max((s for _, _, s in got), default=0) == pytest.approx(max((s for _, _, s in maximal(0, n)), default=0))


@pytest.fixture
def toxic(spark):
    rng = random.Random(1)
    docs, labels = [], []
    for k in range(600):
        text = words(rng, 60)
        bad = k % 6 == 0
        if bad:
            for _ in range(4):
                text[rng.randrange(60)] = rng.choice(["vileword", "nastyword", "grossling", "grossness"])
        docs.append((k, " ".join(text)))
        labels.append((k, int(bad)))
    return spark.createDataFrame(docs + ODD, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")


def test_toxicity(toxic):
    docs, labels = toxic
    model = toxicity.fit(docs, labels, train=toxicity.in_fit())
    rows = toxicity.score(docs, model, passages=True).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 600 and toxicity.common.crc_mod_py(r["doc_id"], 5) == 0]
    assert sum((r["score"] >= 0.5) == (r["doc_id"] % 6 == 0) for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["score"] < 0.5 for r in rows if r["doc_id"] is None or r["doc_id"] >= 900)
    assert any("vileword" in p for r in rows for p in r["passages"])


def test_toxicity_without_labels(toxic):
    docs, labels = toxic
    model = toxicity.fit(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score(docs, model).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


# Quality

def brute_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_counts(spark):
    rng = random.Random(3)
    texts = ["", " \n ", "a", "a\na\na \na", "# * <é> |&%$", "x\x85y\xa0z", "a b c d e f a b c d e f", " ".join(map(str, range(20000))) + " 1 2 3 4 5"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) + rng.choice(["", "\nl l\nl l"]) for _ in range(150)]
    docs = spark.createDataFrame([*enumerate(texts), (None, None)], "doc_id long, text string")
    for r in quality.judge(docs).collect():
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert got == brute_quality(texts[r["doc_id"]] if r["doc_id"] is not None else "")
        assert r["base_failed"] == (got[0] < 10 or 100 * got[4] > 20 * got[0])
        assert not (r["kept"] and r["base_failed"])
    assert quality.judge(docs.limit(0)).count() == 0


def test_quality_bands(spark):
    rng = random.Random(4)
    good = "\n".join(" ".join(words(rng, 12)).capitalize() + "." for _ in range(40))
    noise = " ".join("".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(6)) for _ in range(600))
    loop = " ".join(f"{k % 7}{'abc' * 9}{k % 4}" for k in range(900))
    docs = spark.createDataFrame([(1, good), (2, noise), (3, loop)], "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in quality.judge(docs).collect()} == {1: True, 2: False, 3: False}


def test_fitted_limits_catch_planted_texts(spark):
    """Among texts of many lengths, some thousand copies and extra columns: loops and noise go, the others stay."""
    rng = random.Random(8)
    vocabulary = words(rng, 400, "an be con de er for ge hu in ka lo mi no or pa ra se ti un ve".split())
    prose = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", ".", ","]) for _ in range(n))
    loop = lambda n: " ".join(f"{rng.randint(0, 9999)} the same four words" for _ in range(n // 5))
    noise = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJ") for _ in range(7)) for _ in range(n))
    half = lambda n: prose(n // 4) + " " + loop(2 * n)
    kinds = [("clean", prose)] * 600 + [("loop", loop)] * 30 + [("noise", noise)] * 30 + [("half", half)] * 10
    rows = [(kind, make(rng.randint(*((60, 1500) if kind != "half" else (1500, 3000))))) for kind, make in kinds]
    rows += [("clean", rows[5][1])] * 1000 + [("clean", prose(60000))]
    docs = spark.createDataFrame([(k, text, kind, "x") for k, (kind, text) in enumerate(rows)], "doc_id long, text string, kept string, bin string")
    kept = collections.Counter()
    for r in quality.judge(docs).collect():
        assert not r["base_failed"]
        kept[rows[r["doc_id"]][0]] += r["kept"]
    total = collections.Counter(kind for kind, _ in rows)
    assert kept["clean"] >= 0.99 * total["clean"]
    for kind in ("loop", "noise", "half"):
        assert kept[kind] <= 0.1 * total[kind], kind


# Language

@pytest.fixture
def tongues(spark):
    rng = random.Random(5)
    stems = {"aa": "ba da ga la".split(), "bb": "eth oth ith uth".split(), "cc": "zök zük zäk zek".split()}
    rows = [(k, " ".join(words(rng, 25, stems[lang])), lang if k % 17 else None) for k, lang in zip(range(600), list(stems) * 200, strict=True)]
    return spark.createDataFrame(rows + [(i, t, None) for i, t in ODD] + [(950, "12 !?", "aa")], "doc_id long, text string, lang string")


def test_language(tongues):
    model = language.fit(tongues, train=language.in_fit())
    rows = {r["doc_id"]: r for r in language.predict(tongues, model).collect()}
    truth = dict(zip(range(600), ["aa", "bb", "cc"] * 200, strict=True))
    held = [k for k in truth if language.common.crc_mod_py(k, 4) == 2]
    assert sum(rows[k]["lang_pred"] == truth[k] for k in held) >= 0.99 * len(held)
    for k in (900, 901, 902, 950):
        assert (rows[k]["lang_pred"], rows[k]["score"]) == ("und", 0.0)
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    assert language.predict(tongues.limit(0), model).count() == 0
    assert {r["lang_pred"] for r in language.predict(tongues, language.fit(tongues.limit(0))).collect()} == {"und"}


def test_codes_part_all_languages():
    for n in (2, 3, 5, 7, 8, 20):
        m = language.code_matrix(n)
        distance = (m.shape[1] - m @ m.T) / 2
        assert all(distance[i, j] >= max(1, n // 4) for i in range(n) for j in range(i))


def test_grams_in_blocks(monkeypatch):
    import numpy as np

    rng = random.Random(10)
    for n in (1, 2, 3, 9, 200):
        for _ in range(20):
            text = "".join(rng.choice("aB é.  1ß中") for _ in range(n))
            made = []
            for size in (1, 2, 3, 7, 1 << 18):
                monkeypatch.setattr(language, "BLOCK", size)
                made.append(language.gram_counts(text))
            assert all((x is None) == (made[0] is None) and (x is None or np.allclose(x, made[0])) for x in made)


# Decontamination

def brute_score(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 2, h[i][j - 1] - 2)
    return max(map(max, h))


def brute_match(item, text):
    if not item:
        return False
    passages = [item[k : k + 13] for k in range(len(item) - 12)] if len(item) > 13 else []
    return brute_score(item, text) >= 0.6 * 2 * len(item) - 1e-9 or any(brute_score(x, text) >= 0.8 * 26 for x in passages)


def test_passage_score():
    import numpy as np

    rng = random.Random(16)
    for _ in range(100):
        a, b = [rng.randint(1, 4) for _ in range(rng.randint(13, 20))], [rng.randint(1, 4) for _ in range(rng.randint(1, 25))]
        score, at = D.best_passage(np.array(a), np.array(b))
        assert score == max(brute_score(a[k : k + 13], b) for k in range(len(a) - 12)) == brute_score(a[at : at + 13], b)


def test_half_an_item_is_found(spark):
    rng = random.Random(12)
    item = words(rng, 40)
    edited = item[10:30]
    edited[9] = "changed"
    docs = [(1, " ".join(words(rng, 30) + item[:20] + words(rng, 30))), (2, " ".join(words(rng, 30) + item[25:35] + words(rng, 30))), (3, " ".join(edited)), (4, "這是一個測試句子" + "很長的句子" * 3)]
    items = [(1, " ".join(item)), (2, "前面這是一個測試句子後面")]
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1), (3, 1), (4, 2)}


def test_a_block_of_many_words():
    item = " ".join(f"w{k}" for k in range(1_700_000))
    block = D.Block.of([(1, item)], 3, 0.6)
    _, starts, at, seed = block.finder()(["x w5 w6 w7 y w9 w10", "w1699997 w1699998 w1699999"])
    assert [(block.places[s][0][1], p) for p, s in zip(at.tolist(), seed.tolist(), strict=True)] == [(5, 1), (1699997, starts[1])]


def test_alignment_score():
    import numpy as np

    rng = random.Random(6)
    for _ in range(300):
        a, b = ([rng.randint(1, 4) for _ in range(rng.randint(1, 12))] for _ in range(2))
        score, first, end = D.smith_waterman(np.array(a), np.array(b))
        assert score == brute_score(a, b)
        assert score == 0 or brute_score(a, b[first:end]) == score


@pytest.mark.parametrize("most_bytes", [1 << 20, 200])
def test_decontamination_finds_every_match(spark, most_bytes):
    rng = random.Random(7)
    items = [(k, " ".join(words(rng, rng.randint(4, 30)))) for k in range(25)] + [(30, ""), (31, None), (32, "one two"), (33, items_text := " ".join(words(rng, 12))), (34, items_text)]
    docs = []
    for k in range(220):
        text = words(rng, rng.randint(0, 60))
        if k % 2:
            item = rng.choice(items[:25])[1].split()
            if len(item) > 13 and k % 4 == 1:
                at, n = rng.randint(0, len(item) - 10), rng.randint(9, 18)
                item = item[at : at + n]
            for _ in range(rng.randint(0, len(item) // (3 if k % 4 == 3 else 10))):
                at = rng.randrange(len(item))
                how = rng.randint(0, 2)
                item[at : at + (how != 1)] = [[rng.choice(["new", "word"])], ["put"], []][how]
                if not item:
                    item = ["z"]
            text += item + words(rng, 5)
        docs.append((k, " ".join(text).title() if k % 3 else ", ".join(text)))
    docs += [(500, "say One, Two!"), (None, items_text), *ODD]
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), most_bytes=most_bytes).collect()}
    cut = lambda t: re.findall(r"\w+", (t or "").lower())
    want = {(i, j) for i, t in docs for j, x in items if brute_match(cut(x), cut(t)[:400])}
    assert got == want
    assert (500, 32) in got
    kept = D.clean(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), most_bytes=most_bytes).collect()
    clean = [(i, t) for i, t in docs if not any(brute_match(cut(x), cut(t)[:400]) for _, x in items)]
    assert collections.Counter((r["doc_id"], r["text"]) for r in kept) == collections.Counter(clean)


def test_decontamination_finds_short_edited_items(spark):
    rng = random.Random(9)
    items, docs = [], []
    for k in range(40):
        item = [f"i{k}w{x}" for x in range(3 + k % 8)]
        items.append((k, " ".join(item)))
        for _ in range(8):
            text = list(item)
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(text))
                text[at : at + 1] = rng.choice([["new"], ["new", text[at]], []] if len(text) > 1 else [["new"]])
            docs.append((len(docs), " ".join(["before", *text, "after"])))
    items += [(90, "w1 w2 w3 w4 w5"), (91, "a b c d e f g h")]
    docs += [(900, "w1 w2 y w4 w5"), (901, "a b x d e y g h")]
    want = {(i, j) for i, t in docs for j, x in items if brute_score(x.split(), t.split()) >= 0.6 * 2 * len(x.split()) - 1e-9}
    assert {(900, 90), (901, 91)} <= want
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in D.contaminated(d, b).collect()} == want
    assert {r["doc_id"] for r in D.clean(d, b).collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_decontamination_of_nothing(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert D.contaminated(docs, bench.limit(0)).count() == 0
    assert D.contaminated(docs.limit(0), bench).count() == 0
    assert D.clean(docs, bench.limit(0)).count() == len(ODD)


# Urls

URLS = ["http://A.B.com/x?y", "https://example.com/en/1", "https://www.example.com/en/1", "http://x.www.example.com/en/#z", "http://q.net/es/a", "http://q.net/fr?x", "http://q.net", "nothing", None, "://", "http://notcom/x", "http://badexample.com/en/", "http://com/", "a://b://c/d?e", "http://lone.org/p"]


def test_urls(spark):
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(URLS)] * 2, "page_id long, url string, host string")
    rows = url_rules.judge(pages).collect()
    assert len(rows) == 2 * len(URLS)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in rows}
    want = [("a.b.com", "/x", "com/"), ("example.com", "/en/1", "example.com/en/"), ("www.example.com", "/en/1", "www.example.com/en/"), ("x.www.example.com", "/en/", "www.example.com/en/"),
            ("q.net", "/es/a", "net/es/"), ("q.net", "/fr", None), ("q.net", "", None), ("", "", None), ("", "", None), ("", "", None), ("notcom", "/x", None), ("badexample.com", "/en/", "com/"), ("com", "/", "com/"), ("b:", "//c/d", None), ("lone.org", "/p", None)]
    assert got == dict(enumerate(want))
    assert all(r["verdict"] in ("allow", "block") for r in rows)
    assert url_rules.judge(pages.limit(0)).count() == 0


def test_names_and_registered_domains(spark):
    rows = [("a.co.uk:8080", "a.co.uk", "a.co.uk", "co.uk"), ("b.a.co.uk", "b.a.co.uk", "a.co.uk", "co.uk"), ("u:p@x.y.org:1", "x.y.org", "y.org", "org"), ("com", "com", "com", "com"), ("", "", "", ""), ("co.uk", "co.uk", "co.uk", "co.uk")]
    df = spark.createDataFrame([r[:1] for r in rows], "host string").withColumn("name", url_rules.name_of(F.col("host")))
    got = df.select("host", "name", url_rules.domain_of(F.col("name")), url_rules.suffix_of(F.col("name"))).collect()
    assert sorted(map(tuple, got)) == sorted(rows)


def test_posterior_against_binomial_sums(spark):
    """For whole numbers a and b, P(Beta(a, b) >= x) is a binomial sum."""
    cases = [(a, b) for a in (1, 2, 7, 40, 300) for b in (1, 3, 9, 250)]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in cases], "a double, b double")
    for x in (0.5, 0.9):
        want = {(a, b): sum(math.comb(a + b - 1, j) * x**j * (1 - x) ** (a + b - 1 - j) for j in range(a)) for a, b in cases}
        for r in df.withColumn("p", url_rules.probability_above(F.col("a"), F.col("b"), x)).collect():
            assert r["p"] == pytest.approx(want[int(r["a"]), int(r["b"])], abs=2e-4)


def test_hosts_differ_by_their_pages(spark):
    """What tells good documents from bad ones is learned: hosts of one suffix part by their pages' text, not by their names."""
    rng = random.Random(5)
    vocabulary = words(rng, 60)
    prose = lambda: " ".join(rng.choice(vocabulary) for _ in range(40)) + "."
    vile = lambda: prose() + " Filth, rubbish and $$$ | trash!"
    docs = [(k, prose() if k % 3 else vile()) for k in range(300)] + [(None, "x"), (301, None)]
    labels = [(k, int(k % 3 > 0 or k % 2), int(k % 3 == 0 and k % 2), "z") for k in range(300)] + [(301, 1, 0, "z"), (None, 0, 0, "z"), (5, None, None, "z")]
    docs = spark.createDataFrame([(*d, "y") for d in docs], "doc_id long, text string, token string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, weight string")
    telling = url_rules.learn(docs, labels)
    assert {r.token for r in telling.collect() if r.weight < -1} == {"filth", "rubbish", "and", "trash", "$", "|", ",", "!"}
    rows = [(f"http://cheap-pills{h}.org/{k}", f"<p>{prose()}</p>") for h in range(3) for k in range(20)]
    rows += [(f"http://plain.org/{k}", f"<p>{vile()}</p>") for k in range(20)] + [("http://plain.org/x", f"<p>{prose()}</p>"), ("http://new.org/", None), ("http://cheap-pills0.org/l", f"<a href='x'>{vile()}</a>")]
    pages = spark.createDataFrame([(k, *r, 1) for k, r in enumerate(rows)], "page_id long, url string, html string, name int")
    got = collections.defaultdict(set)
    for r in url_rules.judge(pages, rules=(), telling=telling).collect():
        got[r["host"]].add(r["verdict"])
    assert got == {**{f"cheap-pills{h}.org": {"allow"} for h in range(3)}, "plain.org": {"block"}, "new.org": got["new.org"]}
    assert url_rules.judge(pages.limit(0), rules=(), telling=telling).count() == 0
    assert url_rules.learn(docs, labels.limit(0)).collect() == url_rules.learn(docs.limit(0), labels).collect() == [("", 0.0)]
    held = {(r.good, r.called_good): r["count"] for r in url_rules.agreement(docs, labels.filter("quality is not null"), F.col("doc_id") % 5 == 0).collect()}
    assert set(held) == {(0, 0), (1, 1)}


def test_reputation_shrinks(spark):
    outcomes = [("good.x.org", 1)] * 50 + [("bad.x.org", 0)] * 50 + [("new.y.org", 0)] + [("z.net", 1)] * 20
    pages = spark.createDataFrame([(1, "http://good.x.org/"), (2, "http://bad.x.org/"), (3, "http://unseen.x.org/"), (4, "http://z.net/"), (5, "http://sub.z.net/"), (6, "http://else.where/")], "page_id long, url string")
    rows = {r["page_id"]: r for r in url_rules.judge(pages, spark.createDataFrame(outcomes, "host string, good int"), rules=()).collect()}
    assert [rows[k]["verdict"] for k in (1, 2, 4, 5)] == ["allow", "block", "allow", "allow"]
    assert rows[1]["bound"] > rows[3]["bound"] > rows[2]["bound"]
    assert rows[4]["bound"] < 1  # one half and fewer outcomes pull harder


def test_verdict_does_not_depend_on_the_number_of_others(spark):
    """The same loop and the same prose among 10, 100 and 1,000 other texts."""
    rng = random.Random(12)
    vocabulary = words(rng, 300)
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)) + "."
    loop = " ".join(f"{rng.randint(0, 999)} of one and the same" for _ in range(160))
    plain = prose(300)
    for others in (10, 100, 1000):
        rows = [(-1, loop), (-2, plain), *((k, prose(rng.randint(60, 900))) for k in range(others))]
        kept = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert not kept[-1] and kept[-2], others


def test_every_segment_of_a_text_counts():
    """Two hundred telling passages say more than fifty; none is left out."""
    model = toxicity.ToxicModel(scores={"vile": 9.0}, drift=1.0, lam=1.0, k=0.1)
    text = lambda n: ["vile", *["calm"] * 9] * n
    counts = [50, 100, 200]
    evidence = []
    for n in counts:
        segments = model.segments(text(n))
        assert len(segments) == n
        evidence.append(model.evidence([s for _, _, s in segments], 2000))
    assert evidence[0] < evidence[1] < evidence[2]

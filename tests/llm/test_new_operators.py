"""Filter audit, collocations and page text against plain Python on small tables with nulls, empties, repeats, ties and clashing columns."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from moteflow.llm import collocations, filter_audit, html_blocks

DOCS = "doc_id long, text string, lang string, source string, mask int"


def audit(rows, labels):
    """The report by brute force."""
    fails = []
    for doc, text, _, part, _ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {c for c, bad in zip("ABCD", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), re.search(r"[#$%&*|]", t)), strict=True) if bad}
        if doc is not None and any(d is not None and d < doc and (x or "") == t for d, x, *_ in rows):
            f.add("E")
        good, bad = (any(lab[i] == 1 for lab in labels if lab[0] == doc and doc is not None) for i in (1, 2))
        fails.append((part or "", f, good, bad))
    out = {}
    for part in {p for p, *_ in fails}:
        mine, shapley = [x for x in fails if x[0] == part], Counter()
        for order in itertools.permutations("ABCDE"):
            for i, c in enumerate(order):
                before = set(order[:i])
                gone = [x for x in mine if c in x[1] and not x[1] & before]
                shapley[c] += len(gone)
                out[part, "".join(order), i + 1] = [sum(not x[1] & (before | {c}) for x in mine), len(gone), sum(c in x[1] and bool(x[1] & before) for x in mine),
                                                    sum(x[1] == {c} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for key in [k for k in out if k[0] == part]:
            out[key].append(shapley[key[1][key[2] - 1]])
    return out


def test_filter_audit_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "TRIE_BYTES", 500)
    r = random.Random(3)
    body = [" ".join(r.choice("ab cd éf gh ij kl".split()) + str(r.randint(0, k)) for _ in range(n)) for n, k in ((250, 500), (250, 3), (40, 9), (210, 900))]
    texts = [*body, body[0] + "!", body[0][:300], body[0][:300] + "é", "", None, "# A", "A B C", " \t", body[3] + " $", "x" * 50_000, "x" * 50_000 + "y"]
    rows = [(i, t, "en", f"s{i % 2}" if i % 5 else None, 7) for i, t in enumerate(texts)]
    rows += [(100 + i, r.choice(texts), "en", r.choice(["s0", "s1", ""]), 1) for i in range(120)]
    rows += [rows[0], (rows[1][0], rows[1][1], "en", "other", 0), (None, body[0], "en", "s0", 0), (-5, body[1], None, "s1", 0), (200, body[2], "en", "s0", 0)]
    labels = [(0, 1, 0), (0, 0, 1), (1, 1, None), (150, 1, 1), (None, 1, 1), (101, None, 1), (999, 1, 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = filter_audit.audit_filters(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = audit(rows, labels)
    assert {(x.part, x.filter_order, x.step): [x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley] for x in got} == want and len(got) == len(want)
    assert filter_audit.audit_filters(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_radix_trie_tells_texts_apart():
    r, trie, want = random.Random(1), filter_audit.RadixTrie(), {}
    texts = [bytes(r.choice(b"ab\xff") for _ in range(r.randint(0, 9))) for _ in range(3000)]
    for i, t in enumerate(texts):
        node = trie.terminal(t)
        assert node[2] == want.get(t)
        node[2] = want[t] = i
    assert sorted(trie.values()) == sorted(want.values())
    assert trie.bytes <= sum(map(len, want))


def grams(rows, longest):
    f, n = Counter(), Counter()
    for text, lang, _ in rows:
        low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f.update((lang or "und", *w[i : i + k]) for i in range(len(w) - k + 1))
    return f, n


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_collocations_equal_brute_force(spark, monkeypatch, longest):
    monkeypatch.setattr(collocations, "WINDOW_BYTES", 400)
    r = random.Random(longest)
    v = ["the", "of", "Ab", "cd", "É", "\x00", "x\"y", "a'b", "zz", "q r"]
    rows = [(r.choice("., ;\n").join(" ".join(r.choice(v[: r.randint(2, 10)]) for _ in range(r.randint(0, 9))) for _ in range(20)), r.choice(["en", "de", None]), 1) for _ in range(60)]
    rows += [("one two three four five six seven. " * 12, "fr", 1), ("  \t", "en", 1), ("", None, 1), (None, "en", 1), rows[0], ("lone " * 3000, "es", 1)]
    docs = spark.createDataFrame(rows, "text string, lang string, n long").repartition(3)
    f, n = grams(rows, longest)
    got = {(x.lang, *x.phrase.split(" ")): x.f for x in collocations.phrase_counts(docs, longest, 5).collect()}
    assert got == {k: c for k, c in f.items() if len(k) == 2 or c >= 5}
    want = {}
    for key, a in f.items():
        lang, w = key[0], key[1:]
        if len(w) < 2 or a < 10:
            continue
        if any(len(o) > len(key) and o[0] == lang and c >= 10 and 100 * c >= 50 * a and any(o[i : i + len(w)] == w for i in range(1, len(o))) for o, c in f.items()):
            continue
        score, cut = min((1_000_000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w)))
        want.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, *w[:cut]], f[lang, *w[cut:]]))
    for top in (7, 2000):
        rows_ = collocations.mine_collocations(docs, longest, 10, 50, top).collect()
        found = sorted((x.lang, x["rank"], x.phrase, x.a, x.l, x.r, x.n, x.score) for x in rows_)
        assert found == sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, x in want.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top]))
    if longest > 2:
        paths = collocations.compact_paths(collocations.phrase_counts(docs, longest, 10), longest).where("lang = 'fr'").collect()
        assert {x.path_words for x in paths} == {7} and {x.f for x in paths} == {12} and len(paths) == 7 - longest + 2
    assert collocations.mine_collocations(docs.limit(0), longest).count() == 0


def test_hot_pairs_change_no_count(spark, monkeypatch):
    rows = [(" ".join(f"hot pair w{i * j % 50} tail" for j in range(200)), "en") for i in range(30)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    assert ("en", b"hot", b"pair") in collocations._hot_pairs(docs, 10)
    hot = {tuple(x) for x in collocations.phrase_counts(docs).collect()}
    monkeypatch.setattr(collocations, "HOT", 2.0)
    assert collocations._hot_pairs(docs, 10) == set()
    assert {tuple(x) for x in collocations.phrase_counts(docs).collect()} == hot


def test_blocks_of_a_page():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><!-- <p>no</p> --><nav><ul><li><a href="/a">Home<li><a href='/b'>Two</a></ul></nav>
    <article class="post x"><h1>A &amp; B</h1><p>one <b>two</b>three<br>four&nbsp; five<p data-x="a>b">six</p></div><p>it<i>al</i>ic &lt;p&gt; 1 < 2<div class=comments><p>me</article><footer>&copy; x</footer> tail"""
    got = html_blocks.blocks(page)
    assert [b.text for b in got] == ["Home", "Two", "A & B", "one twothree four five", "six", "italic <p> 1 < 2", "me", "© x", "tail"]
    assert [b.label for b in got] == [False, False, True, True, True, True, False, False, False]
    assert got[0].linked == 1 and got[3].linked == 0 and [b.tag for b in got[:4]] == ["li", "li", "h1", "p"]
    assert html_blocks.blocks("") == [] and html_blocks.blocks("<p>") == [] and [b.text for b in html_blocks.blocks("<p>a</p")] == ["a</p"]
    deep = "<div>" * 50_000 + "<p>x"
    assert [b.text for b in html_blocks.blocks(deep)] == ["x"]
    assert [b.text for b in html_blocks.blocks("<p>a<script>" + "<p>" * 1000)] == ["a"]


def test_gradient_equals_differences():
    r = np.random.default_rng(1)
    model = html_blocks.Labeller(3)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    sizes = np.array([3, 1, 5, 3])
    x, y = r.random((sizes.sum(), html_blocks.FEATURES)) * 0.2, r.integers(0, 2, sizes.sum()).astype(float)

    def loss():
        e = np.tanh(x @ model.w["embed"])
        sides = [html_blocks._run(html_blocks.Packed(sizes, s == "b"), e @ model.w[f"in_{s}"] + model.w[f"gate_{s}"], model.w[f"recur_{s}"], False)[0] for s in "fb"]
        p = html_blocks._sigmoid(np.concatenate([*sides, e], axis=1) @ model.w["out"] + model.w["bias"])[:, 0]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g = model._gradient(x, sizes, y)
    for name, w in model.w.items():
        for _ in range(3):
            at = tuple(r.integers(0, s) for s in w.shape)
            old, h = w[at], 1e-3
            w[at] = old + h
            up = loss()
            w[at] = old - h
            down = loss()
            w[at] = old
            assert abs((up - down) / (2 * h) - g[name][at]) < 2e-5


def test_page_text(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    model = html_blocks.fit_labeller(pages)
    rows = pages.collect()
    got = {x.page_id: x.text for x in html_blocks.extract_text(pages, model).collect()}
    right = sum(got[p.page_id] == "\n".join(b.text for b in html_blocks.blocks(p.html) if b.label) for p in rows)
    assert right == len(rows)
    article = re.compile(r"<article>(.*?)</article>", re.S)
    assert all(got[p.page_id].split() == html_blocks.unescape(re.sub(r"<[^>]*>", " ", article.search(p.html)[1])).split() for p in rows)
    fresh = html_blocks.layouts([html_blocks.blocks(p.html) for p in rows], 200, seed=77)
    score = model.scores([p for p, _ in fresh])
    assert np.mean((score >= 0.5) == np.concatenate([y for _, y in fresh])) > 0.97
    text = "This is a plain article of some length, with many words to read in it. " * 4
    odd = [(1, "u", None), (1, "u", None), (None, "u", ""), (2, None, f"<div class=content><p>{text}</p></div><div class=footer>Contact us</div>"), (3, "u", "<nav><a href=x>Home</a></nav>"), (4, "u", f"<article><p>{text}" + "<p>word word." * 5000)]
    table = spark.createDataFrame([(*o, "b") for o in odd], "page_id long, url string, html string, blocks string")
    out = html_blocks.extract_text(table, model).collect()
    assert sorted((x.page_id or 0, x.text[:4]) for x in out) == [(0, ""), (1, ""), (1, ""), (2, "This"), (3, ""), (4, "This")]
    assert next(x.text for x in out if x.page_id == 2) == text.strip() and len(next(x.text for x in out if x.page_id == 4).split("\n")) == 5001
    whole = html_blocks.label_blocks(table, model).where("page_id = 2").first()["blocks"]
    assert [(b["tag"], b["main"]) for b in whole] == [("p", True), ("div", False)]
    assert html_blocks.extract_text(table.limit(0), model).count() == 0

"""Ranked lexical search, phrase mining and main-text extraction against plain Python on small tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lumisift.llm import lexical, maintext, phrases


# ranked lexical search
def _terms(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in found]


def ranked(docs, items, top=10):
    """Brute force over (doc_id, text) and (item_id, text) lists."""
    terms = [(d, _terms(t)) for d, t in docs if _terms(t)]
    n_docs, total = len(terms), sum(len(t) for _, t in terms)
    df = Counter(t for _, words in terms for t in set(words))
    out = []
    for item, text in items:
        scores = []
        for doc, words in terms:
            m, tf, score = 100 - 75 + (75 * len(words) * n_docs) // total, Counter(words), 0
            for t in _terms(text):
                if tf[t]:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += weight * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scores, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=repr)


def test_ranked_documents(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = ["a", "B", "çà", "x1", "日本", "The", "of"] + [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i, " ,".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 60)))) for i in range(700)]
    docs += [(7, docs[7][1]), (None, docs[9][1]), (None, docs[9][1]), (1000, None), (1001, ""), (1002, "., "), (1003, "w3 " * 50_000)]
    docs += [(2000 + i, "w1 w2 w59 w59") for i in range(300)]  # copies: ties, one long run in the trie
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 25)))) for i in range(30)]
    items += [(3, "w59 W59 w2"), (3, "w59 W59 w2"), (None, "w7"), (50, None), (51, "-"), (52, "absent words")]
    monkeypatch.setattr(lexical, "SHARD_DOCS", 128)
    d = spark.createDataFrame([(k, t, 1, "q") for k, t in docs], "doc_id long, text string, score int, terms string").repartition(3)
    b = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id int, text string, rank int")
    expected = ranked(docs, items)
    for block in (1 << 20, 900):
        got = [tuple(r) for r in lexical.ranked_documents(d, b, block_bytes=block).collect()]
        assert sorted(got, key=repr) == expected
    assert lexical.ranked_documents(d.limit(0), b).count() == 0
    assert lexical.ranked_documents(d, b.limit(0)).count() == 0


def test_trie_bounds():
    """No document scores above the bound of a node over it, and few are read for a rare term."""
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 12, 400)
    ranks = np.concatenate([np.sort(rng.choice(40, s, False)) for s in sizes])
    tfs = rng.integers(1, 9, len(ranks))
    trie = lexical.Trie(np.arange(400), rng.integers(25, 300, 400), np.concatenate([[0], np.cumsum(sizes)]), ranks, tfs)
    assert sorted(trie.ids) == list(range(400)) and trie.end[0] == 400
    for i, below in enumerate(trie.children):
        if below:
            spans = sorted((trie.first[c], trie.end[c]) for c in below)
            assert spans[0][0] == trie.first[i] and spans[-1][1] == trie.end[i]
            assert all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
        else:
            assert trie.end[i] - trie.first[i] <= lexical.LEAF
    nodes = len(trie.first)
    best = {}
    for key, tf in zip(trie.node_keys.tolist(), trie.node_tfs.tolist()):
        best[divmod(key, nodes)] = tf
    for key, tf in zip(trie.keys.tolist(), trie.tfs.tolist()):
        term, at = divmod(key, trie.count)
        for i in range(nodes):
            if trie.first[i] <= at < trie.end[i]:
                assert best[(term, i)] >= tf


# phrase collocations
def collocations(docs, min_count, top, longest=5):
    """Brute force over (text, lang) pairs."""
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    f = {p: c for p, c in f.items() if c >= min_count}
    out = {}
    for (lang, p), a in f.items():
        if len(p) > 1:
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            longer = [c for (o, q), c in f.items() if o == lang and len(q) > len(p) and any(
                q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * c >= 100 * a for c in longer):
                out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return [(lang, i, p.decode(), -a, l, r, n[lang], -score) for lang, rows in out.items()
            for i, (score, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]


def _phrase_docs():
    rng = random.Random(11)
    words = ["A", "b", "ç", "日本", "x-1", "\x00", "\u00a0", "The"] + [f"w{i}" for i in range(12)]
    docs = []
    for i in range(260):
        body = rng.choices(words, [3] * 8 + [1] * 12, k=rng.randrange(0, 40))
        body = "".join(w + rng.choice([" ", " ", " ", " ", "\t ", ", ", "\n", ".", "  "]) for w in body)
        docs.append((body, rng.choice(["en", "en", "de", None, ""])))
    # fixed phrases, one inside another; a phrase of late words; copies; nothing at all
    docs += [("one two three four five six", "en")] * 30 + [("two three four", "en")] * 6 + [(None, "en"), ("", None), (" .\t", "fr")]
    docs += [(f"rare pair {i}", "en") for i in range(25)] + [("same same same same " * 40, "de")]
    return docs


@pytest.mark.parametrize("bits", [24, 3])
def test_collocations(spark, bits, monkeypatch):
    monkeypatch.setattr(phrases, "FLUSH_BYTES", 3000)
    monkeypatch.setattr(phrases, "PAIR_CHUNK", 32)
    if bits == 3:  # every pair shares its bucket with others, and all places are taken
        monkeypatch.setattr(phrases, "PAIR_BITS", 4)
    docs = _phrase_docs()
    df = spark.createDataFrame([(i, t, lang, 1, "q") for i, (t, lang) in enumerate(docs)],
                               "doc_id long, text string, lang string, k int, phrase string").repartition(3)
    for shards, top in ((4, 2000), (1, 5)) if bits == 24 else ((3, 2000),):
        got = sorted(tuple(r) for r in phrases.collocations(df, min_count=8, top=top, shards=shards, place_bits=bits).collect())
        assert got == sorted(collocations(docs, 8, top))


def test_collocations_without_rows(spark):
    none = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(none).count() == 0
    empty = spark.createDataFrame([(None, None), ("", "en"), ("..", "en")], "text string, lang string")
    assert phrases.collocations(empty, min_count=1).count() == 0


def test_phrase_arithmetic_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, n, l, r = 3 * 10**9, 9 * 10**15, 4 * 10**12, 7 * 10**12
    row = spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long").select(
        (phrases._big(F.col("a") * 1000) * phrases._big(F.col("n"))).alias("over"),
        (phrases._big(F.col("l")) * phrases._big(F.col("r"))).alias("under")).select(F.expr("over div under").alias("s")).first()
    assert row.s == 1000 * a * n // (l * r)


def test_equal_keys_are_told_apart():
    """Phrases whose 64-bit keys collide are still counted by their words."""
    ids = np.array([1, 2, 3, 1, 2, 3, 4, -1])
    at = np.array([0, 1, 3, 4, 5])
    found, counts = phrases._grouped(np.zeros(5, np.uint64), ids, at, 2)
    assert sorted((int(ids[i]), int(ids[i + 1]), int(c)) for i, c in zip(found, counts)) == [(1, 2, 2), (2, 3, 2), (3, 4, 1)]


# main text
LONG = "A sentence that is long enough to be the text of an article, with a second half that goes on. " * 3


def _main(html):
    return maintext.main_text(html)[0]


def test_main_text_of_an_article():
    page = f"""<!DOCTYPE html><html><head><title>T &amp; U</title><style>p {{}}</style><script>var t="</p><p>no</p>";</script></head>
    <body class="has-sidebar"><header class="site"><h1>Site</h1></header><nav><ul><li><a href="/a">one</a></li><li>two</ul></nav>
    <div class="cookie-notice"><p>{LONG}</p></div><div id="ad-top">{LONG}</div>
    <main><article><header><h1>Head&shy;line &#233;&nbsp;x</h1></header><p><b>First</b>
    line<br>and   more {LONG}</p><p>Short.</p><ul><li>item one</li><li>item <a href="#">two</a></li></ul>
    <div class="advert">{LONG}</div><blockquote>Quote &lt;b&gt;</blockquote><form>{LONG}<input></form>
    <p>Last &amp;amp; end</p><ul class="x"><li><a href="1">link one</a></li><li><a href="2">link two</a></li></ul></article>
    <section id="comments"><h2>Comments</h2><article class="comment"><p>{LONG} reader</p></article></section></main>
    <aside><p>{LONG}</p></aside><footer>&copy; site</footer></body></html>"""
    long = LONG.strip()
    assert maintext.main_text(page) == ("\n\n".join([
        "Head\u00adline \u00e9 x", f"First line and more {long}", "Short.", "item one", "item two", "Quote <b>", "Last &amp; end"]), "T & U")


def test_main_text_without_article_elements():
    links = "".join(f'<li><a href="/{i}">menu entry {i}</a></li>' for i in range(12))
    page = f"<body><div><ul>{links}</ul></div><div><div><h2>Title</h2><p>{LONG}<p>{LONG}<p>Brief.<p>{LONG}<p>End.</div></div><div>Terms <a>of use</a></div></body>"
    long = LONG.strip()
    assert _main(page) == "\n\n".join(["Title", long, long, "Brief.", long, "End."])
    framed = f"<form id='page'><div class='menu-bar'>{links}</div><p>{LONG}</p><p>Tail</p></form>"
    assert _main(framed) == long + "\n\nTail"


def test_main_text_of_odd_pages():
    for none in (None, "", "   ", "<html></html>", "<script>x", "<p></p>", "<nav>menu</nav>", "<!-- a", "<a"):
        assert _main(none) == ""
    assert _main("plain text") == "plain text" and _main("<") == "<"
    assert _main("<p>a<p>b &lt; c") == "a\n\nb < c"
    assert _main("<p>a <b>b</p><!-- open <p>c</p>") == "a b"
    assert _main("<div><button>x<p>y</div><p>z") == "z"
    assert _main("<p>1 < 2 and 3 > 2</p>") == "1 < 2 and 3 > 2"
    assert _main("<p>cut <a hre") == "cut"
    assert _main("<article><p>x</p></article>") == "x"


def test_main_text_is_linear_on_hostile_pages():
    import time

    start = time.time()
    for part in ("<", "<!--", "<a ", "</", "<![CDATA[", "<!", "<?", "&", "<div>", "</div>", "<p", "<li>", "<div><a>", "<b x='", '<p a="b>'):
        _main("<p>text</p>" + part * 40_000)
        _main("<p>text</p>" + part * 40_000 + ">")
    assert time.time() - start < 60


def test_extract_pages(spark):
    rows = [(1, "u", "<p>Caf&eacute; \U0001F600</p>", "t"), (2, None, None, "t"), (None, "v", "", None), (1, "u", "<p>Caf&eacute; \U0001F600</p>", "t"),
            (4, "w", "<p>&#xD800;x</p>", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((tuple(r)[:4] for r in maintext.extract_pages(df).collect()), key=repr)
    expected = [(1, "u", "Caf\u00e9 \U0001F600", 6)] * 2 + [(2, None, "", 0), (None, "v", "", 0), (4, "w", "\ufffdx", 2)]
    assert got == sorted(expected, key=repr)
    assert maintext.extract_pages(df.limit(0)).count() == 0


def test_smoothing():
    assert np.allclose(maintext.smooth(np.full(7, 3.0)), 3.0)
    lifted = maintext.smooth(np.array([0, 0, 0, 9.0, 0, 0, 0]))
    assert lifted[3] == max(lifted) and np.allclose(lifted, lifted[::-1]) and lifted[0] == 0

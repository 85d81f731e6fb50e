"""Main text: planted pages, the suffix array against brute force, shards."""

import random

import numpy as np

from wxframe.llm import html_text as H

SCHEMA = "page_id long, url string, html string"


def main_text(page):
    main, others = H.split_main(H.blocks_of(page))
    return H.text_of(main, others, np.zeros(10_000, bool))


def test_structure():
    page = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";x("<p>no</p>")</script></head>
    <body class="no-sidebar"><nav><ul><li><a href="/x>y" title='a>b'>Menu</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad box">Buy</div>
    <header><h2>Site</h2></header><article class="post"><h1>One&nbsp;&#8211; &eacute; &amp;amp; a &lt; b &am</h1><p><b>Bold <i>it</i>al<br>next
    line<p>Second 1 < 2 <span class="share-button">Share</span><p class="advert">Ad</p><ul><li>a<li>b</ul><form><p>mail</p></form>
    <div id="comments"><article class="comment"><p>me too</p></article></div><p>Last</article><aside><p>Side</p></aside>
    <p>outside</p><footer>&copy; x &middot; y</footer>"""
    assert main_text(page) == "One – é &amp; a < b &am\nBold ital next line\nSecond 1 < 2\na\nb\nLast"
    assert main_text("<main><p>m</p><article><p>a</p></article></main>") == "a"
    assert main_text("<div role='main'><p>m</p></div><p>x</p>") == "m"
    assert main_text(None) == main_text("") == main_text("<script>x") == "" and main_text("plain  text") == "plain text"
    assert main_text("<p>a<p>b</div></p>c<textarea><p>t</textarea> d") == "a\nb\nc d"


def test_hosts(spark):
    df = spark.createDataFrame([("https://u@WWW.x.org:80/a?b",), (None,), ("odd",), ("http://h",)], "u string")
    assert [r.h for r in df.select(H.host_of(df.u).alias("h")).collect()] == ["www.x.org", "", "", "h"]


def test_suffix_array_against_brute_force():
    rnd = random.Random(3)
    for k in (1, 2, 3, 5, 8):
        pages = [[rnd.randrange(4) for _ in range(rnd.randint(0, 40))] for _ in range(6)]
        want = []
        for p, s in enumerate(pages):
            other = {tuple(t[j:j + k]) for q, t in enumerate(pages) if q != p for j in range(len(t) - k + 1)}
            mark = [False] * len(s)
            for j in range(len(s) - k + 1):
                if tuple(s[j:j + k]) in other:
                    mark[j:j + k] = [True] * k
            want.append(mark)
        got = H.covered([np.array(s, np.int64) for s in pages], k)
        assert [g.tolist() for g in got] == want
    assert H.covered([], 3) == []


def plain_pages(n=60):
    words = lambda s: " ".join(random.Random(s).choice("abcdefgh") + str(random.Random(s + k).random())[2:6] for k in range(12))
    note = words(1)
    rows = [(k, f"http://h{k % 2}.org/{k}", f"<body><div>{note}</div><p>{words(1000 + 50 * k)}</p><div>unique {k} {note}</div></body>")
            for k in range(n)]
    return rows, words


def test_pages_without_main_keep_their_unique_runs(spark):
    rows, words = plain_pages()
    rows.append((99, "http://alone.org/", rows[0][2]))
    df = spark.createDataFrame(rows, SCHEMA)
    want = {k: f"{words(1000 + 50 * k)}\nunique {k}" for k in range(60)} | {99: "\n".join(t for t, _ in H.blocks_of(rows[0][2]))}
    assert {r.page_id: r.text for r in H.extract(df).collect()} == want
    cut = H.extract(df, shard_bytes=500).collect()         # many shards a host: the same texts
    assert {r.page_id: r.text for r in cut} == want and len(cut) == len(rows)


def test_copied_articles_stay_and_edge_rows(spark):
    art = "<article><p>" + "same words in each copy of it " * 5 + "</p></article>"
    rows = [(1, "http://h/1", art), (2, "http://h/2", art), (2, "http://h/2", art), (None, None, "<p>x"), (4, "odd", None), (5, "http://h/5", ""),
            (6, "http://h/6", "<p>" + "long " * 200_000)]
    df = spark.createDataFrame([(*r, "clash", "k") for r in rows], SCHEMA + ", text string, host string")
    got = {r.page_id: r for r in H.extract(df).collect()}
    assert H.extract(df).count() == 7 and got[1].text == got[2].text == ("same words in each copy of it " * 5).strip()
    assert got[4].text == "" and got[5].n_chars == 0 and got[None].text == "x" and got[6].n_chars == 5 * 200_000 - 1
    assert H.extract(df.limit(0)).count() == 0


def test_article_inside_a_marked_wrapper():
    assert main_text("<div class='page has-sidebar'><p>x</p><article><p>a</p><p class='ad'>b</p></article></div>") == "a"
    assert main_text("<form><nav>n</nav><main><p>m</p></main></form>") == "m"
    assert main_text("<article><p>a</p></article><div class='related'><article>r</article></div>") == "a"
    assert main_text("<p>x</p><div class='comments'><article>c</article></div><aside><article>d</article></aside>") == "x"


def test_copies_and_phrases_inside_paragraphs_stay(spark):
    words = lambda s, n: " ".join(str(random.Random(100 * s + k).random())[2:8] for k in range(n))
    phrase, note, art = words(1, 9), words(2, 30), words(3, 40)
    rows = [(k, f"http://h/{k}", f"<p>{words(10 + k, 9)} {phrase} {words(50 + k, 9)}</p><p>{note}</p>") for k in range(5)]
    rows += [(k, f"http://h/{k}", f"<p>{art}</p>") for k in range(5, 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {k: f"{words(10 + k, 9)} {phrase} {words(50 + k, 9)}" for k in range(5)} | {k: art for k in range(5, 9)}
    for size in (H.SHARD_BYTES, 300):
        assert {r.page_id: r.text for r in H.extract(df, shard_bytes=size).collect()} == want

"""Line de-duplication against a search of every earlier document."""

import random

from wxframe.llm import line_dedup as L

SCHEMA = "doc_id long, text string, n_chars long"


def words(n, seed):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def brute_covered(texts, k, min_words):
    """Lines of text k inside a run of at least min_words words that an earlier text holds line by line."""
    new, sizes = L.lines_of(texts[k])
    out = set()
    for old in (L.lines_of(t)[0] for t in texts[:k]):
        for i in range(len(new)):
            for j in range(len(old)):
                n = 0
                while i + n < len(new) and j + n < len(old) and new[i + n] == old[j + n]:
                    n += 1
                if sum(sizes[i:i + n]) >= min_words:
                    out.update(range(i, i + n))
    return out


def test_passages_go_from_the_later_document(spark):
    short, passage, second = words(12, 1), words(60, 2), "\n".join([words(20, 3), words(20, 4), "", words(20, 5)])
    rows = [(1, f"{short}\n{passage}\nown one"), (2, f"{short}\nown two\n{passage}"), (3, f"{second}\nx\n{passage}"),
            (4, f"{passage}\nmine\n{second}"), (5, passage), (6, f"{short}\nclean"), (7, None), (8, ""), (9, "\n\n"),
            (10, f"{second}\nonly\n{passage}\n{second}"), (11, passage + "\n" + passage), (12, f"{words(49, 9)}"), (13, words(49, 9))]
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], SCHEMA)
    got = {r.doc_id: r for r in L.dedup(df).collect()}
    assert set(got) == {1, 2, 3, 4, 6, 7, 8, 9, 10, 12, 13}          # 5 and 11 hold nothing else
    assert got[1].text == rows[0][1] and got[6].text == rows[5][1] and got[3].text == f"{second}\nx"
    assert got[2].text == f"{short}\nown two" and got[4].text == "mine" and got[10].text == "only"
    assert got[7].text is None and got[8].text == "" and got[9].text == "\n\n"
    assert all(r.n_chars == len(r.text or "") for r in got.values())


def test_random_texts_lose_what_brute_force_finds(spark):
    rnd = random.Random(7)
    pool = [words(rnd.choice([3, 10, 30, 55]), 100 + k) for k in range(12)] + [""]
    texts = ["\n".join(rnd.choice(pool) if rnd.random() < .8 else words(8, rnd.random()) for _ in range(rnd.randint(1, 12)))
             for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in L.annotate(df, "result").collect():
        lines = texts[r.doc_id].split("\n")
        gone = brute_covered(texts, r.doc_id, L.MIN_WORDS)
        kept = r.result.text.split("\n") if r.result.n_removed < len(lines) else []
        assert len(kept) == len(lines) - r.result.n_removed
        # windows that no single source holds with their whole block may keep the block's short ends
        assert r.result.n_removed <= len(gone)
        left = [sum(L.lines_of(lines[k])[1]) for k in sorted(gone)]
        assert bool(gone) == (r.result.n_removed > 0), left


def test_hot_source_repeats_and_clashes(spark):
    passage = words(70, 1)
    rows = [(k, f"{passage}\n{words(9, 1000 + k)}", "x", "y") for k in range(300)] + [(1, f"{passage}\n{words(9, 1001)}", "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, line_key string, ranges string")
    out = L.dedup(df)
    assert out.columns == df.columns
    got = out.collect()
    assert len(got) == 301 and sum(passage in r.text for r in got) == 1
    assert L.dedup(df.limit(0)).count() == 0


def test_blocks():
    a, b = words(60, 1), words(60, 2)
    assert L.common_blocks(f"{a}\n{b}", f"{b}\n{a}", 50) == [(0, 1), (1, 2)]
    assert L.common_blocks(None, a, 50) == [] and L.common_blocks(a, None, 50) == []
    assert L.common_blocks(a + "\ntail", a + "\ntail\nmore", 50) == [(0, 2)]


def test_passages_that_cross_line_ends(spark):
    passage = words(60, 1).split()
    text = " ".join(passage)
    wrapped = "\n".join(" ".join(passage[k:k + 7]) for k in range(0, 60, 7))
    rows = [(1, f"start {text} end"), (2, f"one {text} line"), (3, f"x\nhead {wrapped} tail\n\ny"), (4, " ".join(passage)),
            (5, f"  keep {' '.join(passage[:49])} it"), (6, f"a\n{' '.join(passage[:30])}\n{' '.join(passage[30:])}\n\nb")]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in rows], SCHEMA)
    got = {r.doc_id: r.text for r in L.dedup(df).collect()}
    assert got == {1: rows[0][1], 2: "one line", 3: "x\nhead\ntail\n\ny", 5: rows[4][1], 6: "a\n\nb"}
    assert {r.doc_id: r.result.sources for r in L.annotate(df, "result").collect()}[2] == [1]


def test_words_equal_a_search_of_every_window(spark):
    rnd = random.Random(5)
    base = [words(1, k) for k in range(400)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            a = rnd.randrange(350)
            parts += base[a:a + rnd.randint(20, 90)] + [words(1, rnd.random())]
        texts.append("".join(w + rnd.choice([" ", " ", "\n"]) for w in parts))
    held, want = set(), {}
    for k, t in enumerate(texts):
        w, gone = t.split(), set()
        mine = [tuple(w[i:i + 50]) for i in range(len(w) - 49)]
        for i, x in enumerate(mine):
            if x in held:
                gone.update(range(i, i + 50))
        held.update(mine)
        want[k] = [x for i, x in enumerate(w) if i not in gone]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.result.text.split() for r in L.annotate(df, "result").collect()} == want


def test_scraps_of_near_copies_go(spark):
    words = [f"w{k}" for k in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:100] + ["other"] + words[101:])),              # two words are left
            (3, " ".join(words[:60] + [f"n{k}" for k in range(14)])), (4, " ".join(words[:60] + [f"m{k}" for k in range(16)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = lambda rest: {r.doc_id: len(r.text.split()) for r in L.dedup(docs, min_rest=rest).collect()}
    assert left(0.0) == {1: 200, 2: 1, 3: 14, 4: 16}
    assert left(0.2) == {1: 200, 4: 16}                      # a fifth of 74 words is more than 14
    docs = spark.createDataFrame([(1, " "), (2, None), (3, "a")], "doc_id long, text string")
    assert L.dedup(docs, min_rest=1.0).count() == 3  # unchanged documents stay, whatever they hold


def texts_of(df):
    return {r.doc_id: r.text for r in L.dedup(df).collect()}


def test_the_alignment_decides(monkeypatch):
    """Blocks around lines that occur once on both sides come from patience diff alone, moved ones too."""
    a, b, c = (words(70, k) for k in (1, 2, 3))
    old, new = L.words_in([f"{a} {b} {c}", f"x {c} y {a} z {b}"], 50)
    assert L.common_words(old, new) == [(1, 71), (72, 142), (143, 213)]
    monkeypatch.setattr(L, "patience", lambda *_: [])
    assert L.common_words(old, new) == []


def test_many_moved_blocks_and_repeats():
    blocks = [words(60, k) for k in range(60)]
    old, new = L.words_in([" ".join(blocks), " ".join(blocks[::-1])], 50)         # more rounds than ROUNDS
    assert L.united(L.common_words(old, new)) == [(0, 3600)]
    old, new = L.words_in(["w " * 5000, "v " + "w " * 3000], 50)                  # no line occurs once
    assert L.united(L.common_words(old, new)) == [(1, 3001)]
    assert L.common_words(*L.words_in([None, ""], 50)) == [] and L.words_in([], 50) == []


def test_a_source_that_holds_the_line_only(spark):
    """Document 1 holds 30 words of the passage that 2 and 3 share whole, and 0 another 30."""
    p = words(60, 4).split()
    rows = [(0, "q " + " ".join(p[30:])), (1, " ".join(p[:30]) + " r"), (2, "s " + " ".join(p) + " t"), (3, "u " + " ".join(p) + " v")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert texts_of(df) == {0: rows[0][1], 1: rows[1][1], 2: rows[2][1], 3: "u v"}


def test_very_long_text_nulls_and_repeated_rows(spark):
    long, passage = words(60_000, 8), words(55, 9)
    rows = [(None, passage), (1, None), (1, None), (2, f"{long}\n{passage}"), (3, f"head {long}"), (4, passage + " own"), (4, passage + " own")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in L.dedup(df).collect()), key=str)
    assert got == sorted([(None, passage), (1, None), (1, None), (2, long), (3, "head"), (4, "own"), (4, "own")], key=str)

"""Language identification, the language model and HTML extraction."""

import math
import random
from collections import Counter

import pytest

from millrace.llm import html_extract, language_id, quality_lm

EN = "the quick brown fox jumps over the lazy dog and then it runs with the others through the wood"
DE = "der schnelle braune fuchs springt über den faulen hund und läuft dann mit den anderen durch den wald"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, x, "clash", 0.5) for i, t, x in rows], "doc_id long, text string, lang string, score string, kept double")


def brute_profile(texts, size):
    n = Counter(g for t in texts for g in language_id.grams(t).tolist())
    return [g for g, _ in sorted(n.items(), key=lambda x: (-x[1], x[0]))[:size]]


def test_profiles_and_distance(spark):
    rows = [(i, EN if i % 2 else DE, "en" if i % 2 else "de") for i in range(40)] + [(None, EN, "xx"), (50, "abc", None), (51, None, "en")]
    docs = frame(spark, rows)
    found = language_id.profiles(docs.filter("doc_id is not null"), 30)
    by = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        by.setdefault(r.lang, []).append(r.gram)
    assert by == {"en": brute_profile([EN] * 20, 30), "de": brute_profile([DE] * 20, 30)}
    model = language_id.Profiles.collected(found, 30)
    for text in (EN, DE, "über", "x", "the dog"):
        mine = brute_profile([text], 30)
        far = {k: sum(abs(i - v.index(g)) if g in v else 30 for i, g in enumerate(mine)) for k, v in by.items()}
        best = min(sorted(far), key=far.get)
        assert model.predict(text) == (best, pytest.approx(1 - far[best] / (30 * len(mine))))


def test_identify_edges(spark):
    rows = [(i, EN if i % 2 else DE, "en" if i % 2 else "de") for i in range(60)] + [(None, EN, "zz"), (100, None, "en"), (101, "", None), (102, "123 !?", "de"), (103, "the dog", None), (7, EN, "en"), (104, "der hund " * 20000, None)]
    got = language_id.identify(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert {by[i].lang_pred for i in (100, 101, 102)} == {"und"} and by[103].lang_pred == "en" and by[104].lang_pred == "de"
    assert by[None].held_out is False and by[None].lang_pred == "en"
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert all(0 <= r.score <= 1 for r in got)
    assert language_id.identify(frame(spark, [])).count() == 0
    assert {r.lang_pred for r in language_id.identify(frame(spark, [(1, EN, None)])).collect()} == {"und"}


def test_language_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = [r for r in language_id.identify(docs).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) >= 0.97 * len(got)


def brute_model(texts):
    """P(unit | three units before) by the formulas, with dictionaries."""
    seqs = [(0xFFFF,) * 3 + units(t) for t in texts]
    counts = {4: Counter(s[i - 3 : i + 1] for s in seqs for i in range(3, len(s)))}
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    disc = {}
    for n, c in counts.items():
        k = Counter(c.values())
        y = k[1] / max(1, k[1] + 2 * k[2])
        disc[n] = [min(i, max(0.1 * i, i - (i + 1) * y * k[i + 1] / k[i])) if k[i] else 0.5 * i for i in (1, 2, 3)]

    def p(g):
        if not g:
            return 1 / 65536
        n = len(g)
        same = {h: v for h, v in counts[n].items() if h[:-1] == g[:-1]}
        if not same:
            return p(g[1:])
        d = lambda v: disc[n][min(v, 3) - 1]
        total = sum(same.values())
        own = (same[g] - d(same[g])) / total if g in same else 0.0
        return own + sum(map(d, same.values())) / total * p(g[1:])

    return p


def units(text):
    raw = text.encode("utf-16-le")
    return tuple(int.from_bytes(raw[i : i + 2], "little") for i in range(0, len(raw), 2))


def brute_perplexity(p, text):
    s = (0xFFFF,) * 3 + units(text)
    logs = [math.log(p(s[i - 3 : i + 1])) for i in range(3, len(s))]
    return math.exp(-sum(logs) / len(logs))


def test_kneser_ney(spark):
    """Perplexities, thresholds and verdicts against the formulas."""
    rng = random.Random(5)
    words = [[*EN.split(), "ABC 123", "ABC 123"], DE.split(), "привет мир как дела сегодня хорошо".split(), "漢字仮名 交じり 文章 漢字仮名".split()]
    rows = [(i, " ".join(rng.choices(words[i % 4], k=12)), ["en", "de", "ru", None][i % 4]) for i in range(80)]
    rows += [(100, "привет мир", "ru"), (101, "ыыыыыы ыыы", "ru"), (102, "漢字仮名", "ja"), (103, "жжжж", "ja"), (104, "ABC 123", "en"), (105, "ZZZ 999", "en"), (106, "😀 😀", "en"), (None, EN[:50], "en"), (7, EN, "en"), (107, " \n", "en"), (108, "", None), (109, None, "en")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, trusted string, held int")
    ids = [i for i in range(80) if i % 3]
    got = quality_lm.classify(df, spark.createDataFrame([(i,) for i in ids], "id long"), quantile=0.5).collect()
    held = {r.id for r in spark.range(80).filter("pmod(xxhash64(id), 4) = 0").collect()}
    p = brute_model([t for i, t, _ in rows if i in ids and i not in held])
    want = {}
    for i, t, lang in rows:
        want.setdefault(i, []).append(brute_perplexity(p, t) if t and t.strip() else None)
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    for r in got:
        assert r.perplexity is None if want[r.doc_id] == [None] else any(r.perplexity == pytest.approx(x, rel=1e-4) for x in want[r.doc_id])
    apart = [(r.perplexity, r.lang) for r in got if r.doc_id in ids and r.doc_id in held]
    assert len(apart) >= 3
    for r in got:
        own = sorted(x for x, lang in apart if lang == r.lang and lang is not None) or sorted(x for x, _ in apart)
        assert r.threshold == own[(len(own) - 1) // 2] and r.kept == (r.perplexity is not None and r.perplexity <= r.threshold)
    by = {r.doc_id: r.perplexity for r in got}
    assert by[100] < by[101] and by[102] < by[103] and by[104] < by[105]


def test_classify(spark, sf_dir):
    rows = [(i, EN + f" {i}", "en") for i in range(30)] + [(40, "!!! $$$ %%% QQQ", "en"), (41, None, "en"), (42, "", None), (43, EN, None), (44, "### ###", "fr"), (None, EN, "en"), (3, EN, "en")]
    ids = spark.createDataFrame([(i,) for i in [*range(30), 3, None, 999]], "id long")
    got = quality_lm.classify(frame(spark, rows), ids).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert not by[40].kept and not by[41].kept and not by[42].kept and by[43].kept and not by[44].kept
    assert by[41].perplexity is None
    assert quality_lm.classify(frame(spark, []), ids).count() == 0
    assert not any(r.kept or r.perplexity for r in quality_lm.classify(frame(spark, rows), ids.limit(0)).collect())
    # the smallest tables have too few labels for a quantile
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id: r.kept for r in quality_lm.classify(docs, labels.filter("quality = 1").select("doc_id")).collect()}
    marks = labels.collect()
    good, bad = ([kept[r.doc_id] for r in marks if r.quality == q] for q in (1, 0))
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.2 * len(bad)


LONG = "This is a sentence of the article that is long enough to be sure about it, and it has the words of a text. "
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">{LONG}</div><div id="content"><h1>Head &amp; more</h1><p>{LONG}<b>bo</b>ld&nbsp;end</p><p>Short.</p><p>{LONG}
 second<br>line</p><!-- <p>hidden</p> --><div class="adBox">{LONG}</div><ul><li>{LONG}</li></ul></div>
<div class="links"><a href="a">{LONG}</a></div><aside>{LONG}</aside><form><p>{LONG}</p></form>
<section id="comments"><p>{LONG}</p></section><p>far short</p><footer>&copy; {LONG}</footer></body></html>"""


def test_main_text():
    s = " ".join(LONG.split())
    assert html_extract.main_text(PAGE) == "\n\n".join(["Head & more", s + " bold end", "Short.", s + " second line", s]), html_extract.main_text(PAGE)
    assert html_extract.main_text("<article><p>tiny</p></article><p>other</p>") == "tiny"
    assert html_extract.main_text("<p>" + LONG + "<p>a < b & c <b>" + LONG).split("\n\n")[1].startswith("a < b & c This")
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<p></p>") == ""
    assert html_extract.main_text("<script>x") == ""
    assert len(html_extract.main_text("<article>" + "<p>" + LONG * 2000 + "</p></article>")) > 200_000
    assert html_extract.main_text("<" * 50_000 + "a" * 10) is not None


def test_extract_edges(spark, sf_dir):
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (None, None, None, "t"), (1, "u", PAGE, "t"), (2, "v", "", "t")], "page_id long, url string, html string, text string")
    got = html_extract.extract(pages).collect()
    assert sorted(str(r.page_id) for r in got) == ["1", "1", "2", "None"]
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract(pages.limit(0)).count() == 0
    for r in html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect():
        assert r.text and "track(" not in r.text and "©" not in r.text


def test_words_have_no_fixed_alphabet(spark):
    """Prose, its words shuffled and noise of the same shape, in an alphabet without classes of its own."""
    import random

    rng = random.Random(3)
    letters = [chr(c) for c in range(0x430, 0x450)]
    vocabulary = ["".join(rng.choices(letters, k=rng.randint(3, 8))) for _ in range(60)]
    after = {w: rng.sample(vocabulary, 2) for w in vocabulary}

    def prose(n=80):
        out = [rng.choice(vocabulary)]
        while len(out) < n:
            out.append(rng.choice(after[out[-1]]))
        return out

    good, other = prose(), prose()
    rows = [(i, " ".join(prose()), "ru") for i in range(60)]
    rows += [(100, " ".join(good), "ru"), (101, " ".join(rng.sample(good, len(good))), "ru"), (102, " ".join("".join(rng.choices(letters, k=len(w))) for w in good), "ru"), (103, " ".join(other), "ru"), (103, " ".join(other), "ru")]
    got = quality_lm.classify(frame(spark, rows), spark.createDataFrame([(i,) for i in range(60)], "id long")).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert 1.3 * by[100].perplexity < by[101].perplexity and 1.3 * by[101].perplexity < by[102].perplexity
    assert by[100].kept and by[103].kept and not by[101].kept and not by[102].kept
    assert len({r.perplexity for r in got if r.doc_id == 103}) == 1
    # a trusted document is scored like one that was not counted
    assert sorted(r.perplexity for r in got if r.doc_id < 60)[0] > 0.8 * by[100].perplexity


def test_profiles_limit_before_the_shuffle(spark):
    plan = language_id.profiles(frame(spark, [(1, EN, "en")]), 10)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize(
    ("markup", "kept"),
    [
        ('<div title="a hidden gem"><p>@</p></div>', True),
        ('<div data-id="comment-box"><p>@</p></div>', True),
        ('<div class="article-share-free"><p>@</p></div>', True),
        ('<div class="no-sidebar"><p>@</p></div>', True),
        ('<p class="cookie-notice">@</p>', False),
        ("<p hidden>@</p>", False),
        ('<p><span style="display:none">@ <span>@</span> @</span></p>', False),
        ('<table><tr><td class="sidebar">@</td></tr></table>', False),
        ('<ul><li class="promo">@<li>@</ul>', True),
        ('<article class="comment"><p>@</p></article>', False),
        ('<article class="post comment-open"><p>@</p></article>', True),
        ("<div><noscript><p>@</p></div>", False),
        ('<p class="ad">@<p>@</p>', True),
    ],
)
def test_marks_of_elements(markup, kept):
    found = html_extract.main_text(f"<body><div>{markup.replace('@', LONG)}</div><p>{LONG} and the end of it.</p></body>")
    assert found.count(LONG.strip()) == (2 if kept else 1) if "<article" not in markup or not kept else found == LONG.strip()


def test_short_page():
    assert html_extract.main_text("<body><p>One line.</p><p>Two &amp; more.</p></body>") == "One line.\n\nTwo & more."
    assert html_extract.main_text("<body><nav><a href=a>Menu</a></nav></body>") == ""

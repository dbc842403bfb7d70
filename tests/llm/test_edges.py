"""Nulls, empty and odd texts, repeated rows, empty tables and clashing column names, for every operator and stage."""

import importlib.util

import pytest
from pyspark.sql import functions as F

from tracefold.llm import langid
from tracefold.llm.chat_format import preference_format, with_foreign_reply
from tracefold.llm.decontaminate import decontaminate, drop_contaminated
from tracefold.llm.html_extract import expression, extract, infer, main_text
from tracefold.llm.line_dedup import line_dedup
from tracefold.llm.mixing import hypergeometric, mix, mix_summary, mixed_texts, split_quotas
from tracefold.llm.near_dedup import drop_near_duplicates, near_duplicates
from tracefold.llm.secret_scan import secret_scan
from tracefold.llm.substring_dedup import substring_dedup
from tracefold.llm.topk import quantised, top_k

FIELDS = "doc_id long, text string, lang string, source string, n_chars long, score double, n long, words string"
LONG = " ".join(f"w{i}" for i in range(5000))
ODD = [
    (1, None, "en", None, None, 0.5, 1, "x"), (2, "", None, "a", 0, None, None, None), (3, "   \n\t ", "en", "a", 5, 0.1, 2, "y"), (4, LONG, "en", "b", len(LONG), 0.2, 3, "z"),
    (4, LONG, "en", "b", len(LONG), 0.2, 3, "z"), (None, "null id text here now", "en", "a", 4, 0.2, 1, ""), (5, "12345 !!", "fr", "b", 8, 0.3, 1, ""), (6, "a\nb\nc\na\nb\nc", "en", "a", 11, 0.1, 1, ""),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, FIELDS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], FIELDS)


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_decontaminate(spark, odd, none):
    b = bench(spark, [(1, "w10 w11 w12 w13 w14 w15 w16 w17 w18 w19 w20"), (2, "W4000 w4001"), (None, None), (3, ""), (1, "w10 w11 w12 w13 w14 w15 w16 w17 w18 w19")])
    rows = decontaminate(odd, b).collect()
    assert len(rows) == len(ODD)
    assert sorted((r.n_words, r.n_hit, r.items) for r in rows if r.doc_id == 4) == [(5000, 13, ["1", "2"])] * 2
    assert all(not r.contaminated for r in rows if r.doc_id != 4)
    assert decontaminate(odd, bench(spark, [])).where("contaminated").count() == 0
    assert decontaminate(none, b).count() == 0
    assert drop_contaminated(odd, b).count() == len(ODD) - 2


def test_mix(spark, odd, none):
    rows = mix_summary(odd).collect()
    assert len(rows) == len(ODD) and sum(r.taken for r in rows) > 0 and all(r.taken <= 2 * r["size"] for r in rows)
    assert {r.source for r in rows} == {None, "a", "b"}
    assert mix_summary(none).count() == 0
    empty = mix_summary(odd.withColumn("text", F.lit(None).cast("string"))).collect()
    assert {(r["size"], r.target, r.taken) for r in empty} == {(0, 0.0, 0)}
    documents, pieces = mix(odd, block_words=7, shard_words=500)
    assert pieces.select("shard").distinct().count() > 4
    assert pieces.groupBy("row", "pass").agg(F.sum("words").alias("w")).join(documents, "row").where("w > size").count() == 0


def test_hypergeometric_draw_inverts_the_distribution(spark):
    from math import comb

    for total, good, drawn in ((10, 4, 5), (7, 7, 3), (9, 0, 4), (60, 25, 30), (5, 2, 5)):
        mass = [comb(good, k) * comb(total - good, drawn - k) / comb(total, drawn) if drawn - k >= 0 else 0 for k in range(good + 1)]
        us = [(i + 0.5) / 200 for i in range(200)]
        rows = spark.createDataFrame([(u, total, good, drawn) for u in us], "u double, total long, good long, drawn long")
        got = [r.x for r in rows.select(F.expr(hypergeometric("u", "total", "good", "drawn")).alias("x")).collect()]
        assert got == [next(k for k in range(good + 1) if sum(mass[: k + 1]) > u) for u in us]


def test_tree_splits_the_quotas(spark):
    quotas = [1000, 3, 0, 250]
    rows = split_quotas(spark.createDataFrame([(quotas,)], "q array<bigint>"), 16, 5).orderBy("shard").collect()
    assert [r.shard for r in rows] == list(range(16)) and [sum(r.q[i] for r in rows) for i in range(4)] == quotas
    assert all(r.off[i] == sum(x.q[i] for x in rows[: r.shard]) for r in rows for i in range(4))
    assert {sum(r.q) for r in rows} <= {78, 79} and len({r.q[3] for r in rows}) > 1


def test_mix_draws_blocks_of_the_pool(spark):
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(i % 37)), "abc"[min(i % 7, 2)]) for i in range(400)] + [(None, "x y z", None), (5, "x y", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    documents, pieces = mix(docs, block_words=40, shard_words=500)
    got = pieces.join(documents.select("row", "source", "target"), "row").collect()
    blocks = {}
    for r in got:
        blocks.setdefault((r.source, r["pass"], r.source_block), set()).add(r.shard)
    assert all(len(s) == 1 for s in blocks.values())  # disjoint
    assert len({r.shard for r in got}) == 32
    for source in {r.source for r in got}:
        assert sum(r.words for r in got if r.source == source) == round(next(r.target for r in got if r.source == source))
        first = {b for s, p, b in blocks if s == source and p == 0}
        # a second pass starts when the first is whole, and a part of a pass is no prefix of it
        assert first == set(range(max(first) + 1)) if any(s == source and p == 1 for s, p, b in blocks) else True
    partly = [sorted(b for s, p, b in blocks if (s, p) == k) for k in {(s, p) for s, p, _ in blocks}]
    assert any(b != list(range(len(b))) for b in partly)
    other = mix(docs, block_words=40, shard_words=500, seed=18)[1].groupBy("doc_id").agg(F.sum("words").alias("w")).collect()
    mine = pieces.groupBy("doc_id").agg(F.sum("words").alias("w")).collect()
    assert {(r.doc_id, r.w) for r in other} != {(r.doc_id, r.w) for r in mine}
    texts = {}
    for d, t, _ in rows:
        texts.setdefault(d, []).append(t.split())
    mixed = mixed_texts(docs, pieces).collect()
    assert sum(len(r.text.split()) for r in mixed) == sum(r.words for r in got) and len(mixed) == len(got)
    assert all(any(r.text in " ".join(w) for w in texts[r.doc_id]) for r in mixed)


def test_lines(spark, odd, none):
    rows = {r.row.doc_id: r for r in line_dedup(odd).collect()}
    assert rows[6].text == "a\nb\nc" and rows[6].n_removed == 3
    assert rows[1].text is None and rows[2].text == "" and rows[4].text == LONG
    assert line_dedup(none).count() == 0 and line_dedup(odd).count() == len(ODD)


def test_near_and_substring(spark, odd, none):
    rows = near_duplicates(odd).collect()
    assert len(rows) == len(ODD) and all(r.kept for r in rows)
    assert {r.n_shingles for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert near_duplicates(none).count() == 0
    more = odd.unionByName(spark.createDataFrame([(9, "start " + LONG + " end", "en", "b", 1, 0.1, 1, "")], FIELDS))
    cut = {r.doc_id: r for r in substring_dedup(more).collect()}
    assert (cut[9].n_removed, cut[9].kept_text) == (5000, "start end") and cut[4].n_removed == 0 and cut[None].kept_text == "null id text here now"
    assert substring_dedup(none).count() == 0


def test_secrets_and_language(spark, odd, none):
    assert secret_scan(odd).count() == len(ODD) and secret_scan(none).count() == 0
    model = langid.fit(odd)
    got = {r.row.doc_id: (r.lang_pred, r.score) for r in langid.identify(odd, model).collect()}
    assert {got[i] for i in (1, 2, 3, 5)} == {("und", 0.0)} and got[4][0] in ("en", "fr")
    assert langid.fit(none).languages == [] and {r.lang_pred for r in langid.identify(odd, langid.fit(none)).collect()} == {"und"}
    assert langid.identify(none, model).count() == 0


def test_forward_sums_all_segmentations():
    import numpy as np

    pieces = [b"a", b"b", b"ab", b" ", b" a", b"aba"]
    probs = np.array([[0.1], [0.2], [0.3], [0.15], [0.05], [0.2]])
    model = langid.Model(["x"], pieces, probs)

    def brute(s):
        return 1.0 if not s else sum(probs[i][0] * brute(s[len(p) :]) for i, p in enumerate(pieces) if s.startswith(p))

    for word in (b"a", b"abab", b"abaabab" * 6):
        data = np.frombuffer(word, np.uint8)
        got = model.scorer()(data, np.array([0]), np.array([len(word)]))[0, 0]
        if len(word) < 20:
            assert abs(np.exp(got) - brute(b" " + word)) < 1e-12
        assert np.isfinite(got)

    # pieces of more than eight bytes, and long runs by the pass that keeps the last values only
    pieces += [b"ab" * 6, b"a" * 9, b" " + b"ab" * 5]
    probs = np.array([[0.1, 0.2], [0.2, 0.1], [0.3, 0.1], [0.15, 0.2], [0.05, 0.1], [0.2, 0.1], [0.2, 0.0], [0.01, 0.3], [0.4, 0.1]])
    model = langid.Model(["x", "y"], pieces, probs)
    lookup, table = langid.Lookup.of(pieces), np.vstack([probs, np.zeros((1, 2))])
    for word in (b"ab" * 7, b"aaaaaaaaaaab", b"ba", b"ab" * 900 + b"a" * 700 + b"ba" * 300):
        data = np.frombuffer(word, np.uint8)
        got = model.scorer()(data, np.array([0]), np.array([len(word)]))[0]
        run = langid.forward_run(np.frombuffer(b" " + word, np.uint8), lookup, table)
        whole = langid.forward(np.frombuffer(b" " + word, np.uint8)[None], np.array([len(word) + 1]), lookup, table)[0][0]
        assert np.allclose(got, run) and np.allclose(run, whole)
        if len(word) < 20:
            walk = lambda s, k: 1.0 if not s else sum(probs[i][k] * walk(s[len(p) :], k) for i, p in enumerate(pieces) if s.startswith(p))
            assert np.allclose(np.exp(got), [walk(b" " + word, k) for k in (0, 1)])


def test_expected_counts_match_all_segmentations():
    import numpy as np
    import pyarrow as pa

    pieces = [b"a", b"b", b"ab", b" ", b" a", b"aba"]
    probs = np.array([[0.1, 0.3], [0.2, 0.1], [0.3, 0.1], [0.15, 0.2], [0.05, 0.2], [0.2, 0.1]])
    rows = [("x", b"abab", 3), ("y", b"aab", 2), ("y", b"b", 1)]

    def walks(s):
        return [()] if not s else [(i, *rest) for i, p in enumerate(pieces) if s.startswith(p) for rest in walks(s[len(p) :])]

    want = np.zeros((6, 2))
    for lang, word, n in rows:
        k = "xy".index(lang)
        found = walks(b" " + word)
        weights = [np.prod([probs[i, k] for i in w]) for w in found]
        for w, weight in zip(found, weights, strict=True):
            for i in w:
                want[i, k] += n * weight / sum(weights)
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.binary(), pa.int64()), strict=True)], names=["lang", "word", "n"])
    (got,) = langid._expected(["x", "y"], pieces, probs)(iter([batch]))
    out = np.zeros((6, 2))
    out[got.column(1).to_numpy(), got.column(0).to_numpy()] = got.column(2).to_numpy()
    assert np.allclose(out, want)


def test_language_without_words_or_spaces(spark):
    import random

    rng = random.Random(5)
    latin = lambda words: " ".join(rng.choice(words) for _ in range(30))
    han = lambda: "".join(rng.choice("的一是不了人我在有他这中大来上国个到说们为子和你地出道也时年得就那要下以生会自着去之过家学对可") for _ in range(150))
    rows = [(i, latin("the and of house with some river".split()), "en") for i in range(40)] + [(i, latin("der und die haus mit fluss ein".split()), "de") for i in range(40, 80)]
    rows += [(80, "", "zz"), (81, " ", "zz"), (82, None, "yy")] + [(i, han(), "zh") for i in range(100, 140)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.languages == ["de", "en", "zh"]
    fresh = [(0, latin("the and of house".split()), "en"), (1, latin("der und mit ein".split()), "de"), (2, han(), "zh"), (3, "x" * 400_000, None), (4, "的" * 100_000, "zh"), (5, "é" * 501 + "的", None)]
    got = langid.identify(spark.createDataFrame(fresh, "doc_id long, text string, lang string"), model).collect()
    assert len(got) == 6 and all(r.lang_pred == r.row.lang for r in got if r.row.lang) and all(0 <= r.score <= 1 for r in got)
    nothing = langid.fit(spark.createDataFrame([(1, " ", "en")], "doc_id long, text string, lang string"))
    assert nothing.languages == [] and langid.identify(docs, nothing).where("lang_pred <> 'und'").count() == 0


def test_long_words_are_cut_between_characters():
    import numpy as np

    from tracefold.llm.arrays import words

    for text in ("a" * 1000, "的" * 333 + " b", "x " + "é" * 77 + "😀" * 50 + " y" * 3, ""):
        data = np.frombuffer(text.encode(), np.uint8)
        starts, ends, first = langid.chunked(*words(np.array([0, len(data)]), data), data)
        parts = [data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
        assert "".join(parts) == "".join(text.split()) and all(0 < len(p.encode()) <= langid.CHUNK for p in parts)
        assert first.tolist() == [0, len(parts)]


def test_html(spark):
    rows = [(1, "http://h/x", None), (2, None, ""), (3, "odd", "<p>bare &amp; text<p>two <b>bold"), (3, "odd", "<p>bare &amp; text<p>two <b>bold")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted(r.text for r in extract(pages).collect()) == ["", "", "bare & text\ntwo bold", "bare & text\ntwo bold"]
    assert extract(pages.limit(0)).count() == 0
    page = "<body><header>site</header><nav>m</nav><article><h1>T</h1><div class='cookie-notice'>c</div><p>one\n two<br>three</p><form>f</form><script>if (a<b) '</p>'</script><section id='comments'>r</section><ul><li>x<li>y</ul></article><aside>s</aside><footer>f</footer>"
    assert main_text(page) == "T\none two three\nx\ny"
    site = lambda t, *ps: f"<body><div class=top>Site</div><div id=c><h2>{t}</h2>{''.join(f'<p>{p}</p>' for p in ps)}</div><div class=bottom>All rights</div>"
    wrapper = infer([site("one", "first words here"), site("two", "other words", "and more of them"), site("six", "last of all these")])
    assert expression(wrapper) == "<#root><body><div.top>#text</><div.c><h2>#slot</>(<p>#slot</>)+</><div.bottom>#text</></></>"
    assert main_text(site("t", "p1", "p2", "p3"), wrapper) == "t\np1\np2\np3"
    assert len(main_text("<div>" * 20000 + "deep")) == 4


def test_html_names_that_only_look_like_chrome():
    parts = ["<h2 id='discussion'>Discussion</h2>", "<section id='related-work'><p>Others did this</p></section>", "<p class='alert'>Heed this</p>", "<p class='social-history'>He drank</p>", "<div class='cookies-recipe'>Bake</div>", "<header><h1>Title</h1></header>"]
    page = f"<html><head><title>x</title><body><div class='page-header'>site</div><main>{''.join(parts)}<div class='relatedPosts'>r</div><ul class='share-links'><li>s</ul></main>"
    assert main_text(page) == "Discussion\nOthers did this\nHeed this\nHe drank\nBake\nTitle"


def test_html_chrome_names():
    gone = ["<div class='in-article-ad'>x</div>", "<section id='reader-comments'><p>x</section>", "<div class='commentBody'>x</div>", "<div class='cookie-law-info'>x</div>", "<ul class='share-bar'><li>x</ul>", "<div class='newsletter-signup'>x</div>", "<div class='site-footer'>x</div>"]
    kept = ["<div class='article-header'><h1>Title</h1></div>", "<div class='post-content'><p>Text</p></div>", "<div class='author-note'>Note</div>", "<div class='advice'>Advice</div>"]
    for page in (f"<body><article>{''.join(kept + gone)}</article>", f"<body><div id=main>{''.join(gone + kept)}</div>"):
        assert main_text(page) == "Title\nText\nNote\nAdvice"


def test_html_wrapper_of_hosts_without_article_elements(spark):
    """Two templates on one host, a host with a part that every article repeats, and articles with teasers, against the texts they were made of."""
    import random

    rng = random.Random(3)
    sentence = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    rows, want = [], {}
    for i in range(120):
        title, body = sentence(3), [sentence(rng.randrange(8, 60)) for _ in range(rng.randrange(1, 6))]
        links = "".join(f"<li><a href=/x>{sentence(1)}</a>" for _ in range(5))
        ps = "".join(f"<p>{p}</p>" for p in body)
        kind = i % 3
        if kind == 0:
            page = f"<body><div id=top><ul>{links}</ul></div><div class=story-{i}><h1>{title}</h1>{ps}</div><div class=end>{sentence(2)}</div>"
        elif kind == 1:
            page = f"<body><table><tr><td class=l>{sentence(2)}<td class=text><h1>{title}</h1>{ps}</table>"
        else:
            page = f"<html><body><main><article><h1>{title}</h1>{ps}<div class=about-us>We write for you</div></article><article><a href=/y>{sentence(2)}</a></article></main></body></html>"
        rows.append((i, f"http://{'one' if kind < 2 else 'two'}.example/{i}", page))
        want[i] = "\n".join([title, *body])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("x"), "blocks": F.lit(1), "node": F.lit("n")}).repartition(5)
    got = {r.page_id: r for r in extract(pages).collect()}
    short = [i for i in want if got[i].text != want[i]]
    assert len(got) == 120 and not short and all(got[i].n_chars == len(want[i]) for i in want)


@pytest.mark.parametrize("page", ["<a " * 16_000, "<b>x</i></p></td>" * 60_000, '<a href="' * 100_000, "<p><table><td>" * 40_000, "<ul><li>" * 60_000 + "</b>" * 60_000, "<" * 500_000])
def test_html_of_a_megabyte_of_stray_markup(page):
    import time

    began = time.time()
    main_text(page)
    assert time.time() - began < 10


def test_chat(spark):
    rows = [(1, False, 0, "user", "hi"), (1, False, 1, "assistant", "yes"), (1, True, 0, "user", "hi"), (1, True, 1, "assistant", "no <|end|>"), (2, False, 0, None, None), (None, True, 0, "user", "x"), (1, False, 2, "user", "é")]
    turns = spark.createDataFrame(rows, "pair_id long, rejected boolean, turn long, role string, text string")
    by = {r.pair_id: r for r in preference_format(turns).collect()}
    assert by[1].prompt == "<|user|>\nhi<|end|>\n" and by[1].n_prompt == 1
    a, b = map(int, by[1].chosen_mask.split(":"))
    assert by[1].chosen[a:b] == "yes<|end|>\n" and "no < |end|>" in by[1].rejected
    assert (by[2].chosen, by[2].rejected, by[2].prompt) == ("<|none|>\n<|end|>\n", "", "") and by[None].n_rejected == 1
    assert preference_format(turns.limit(0)).count() == 0


def test_top_k(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [-1.0]), (None, [9.0, 9.0]), (50, [0.5, 0.5]), (6, [1.0, None])]
    v = quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(v, v.where("vec_id % 50 = 0"), 2).collect())
    assert got == [(0, 1, 1, 65536), (0, 2, 2, 65536), (50, 1, 0, 32768), (50, 2, 1, 32768)]
    assert top_k(v.limit(0), v.limit(0)).count() == 0


def test_top_k_over_many_groups(spark, monkeypatch):
    """Clustered vectors, repeated ids and rows, several groups and packs, against all pairs."""
    import random

    from tracefold.llm import topk

    monkeypatch.setattr(topk, "GROUP", 40)
    monkeypatch.setattr(topk, "PACK", 3)
    monkeypatch.setattr(topk, "SPLIT", 2)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 1)
    rng = random.Random(4)
    rows = []
    for i in range(400):
        centre = [(-3.0 if (i // 40 >> d) & 1 else 3.0) for d in range(4)]
        rows.append((i, [c + rng.uniform(-1, 1) for c in centre][: 3 + i % 2]))
    rows += [(50, rows[50][1])] * 3 + [(50, [9.0, 9.0, 9.0, 9.0]), (7, [1.0, 1.0, 1.0, 1.0]), (7, [1.0, 1.0, 1.0, 1.0])]
    v = quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(v, v.where("vec_id % 50 = 0"), 5).collect())
    ints = [(i, [int((256 * x) // 1) for x in e] + [0] * (4 - len(e))) for i, e in rows]
    want = []
    for n, (i, q) in enumerate(ints):
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), j) for m, (j, x) in enumerate(ints) if m != n)[:5]
            want += [(i, rank, j, -score) for rank, (score, j) in enumerate(scored, 1)]
    assert got == sorted(want)


def test_chat_long_and_foreign_replies(spark):
    long = [(7, side, i, "user" if i % 2 == 0 else "assistant", f"t{i}" if i < 3000 or not side else "other") for side in (False, True) for i in range(4000)]
    (r,) = preference_format(spark.createDataFrame(long, "pair_id long, rejected boolean, turn long, role string, text string")).collect()
    assert (r.n_prompt, r.n_chosen, r.n_rejected) == (3000, 1000, 1000) and len(r.chosen_mask.split(",")) == 500
    assert all(r.chosen[int(a) : int(b)] == f"t{3001 + 2 * k}<|end|>\n" for k, (a, b) in enumerate(x.split(":") for x in r.chosen_mask.split(",")))
    rows = [(0, 0, "user", "q0", 1), (0, 1, "assistant", "a0", 1), (1, 0, "user", "q1", 1), (1, 1, "assistant", "a1", 1), (1, 2, "user", "thanks", 1), (2, 0, "user", "q2", 1), (3, 0, "assistant", None, 1), (4, 0, "assistant", "alone", 1), (None, 0, "user", "x", 1)]
    turns = with_foreign_reply(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rejected int"))
    by = {r.pair_id: r for r in preference_format(turns).collect()}
    assert set(by) == {0, 1, 2, 3, 4, None} and (by[None].n_chosen, by[None].n_rejected) == (1, 0)
    assert by[0].prompt == "<|user|>\nq0<|end|>\n" and (by[0].chosen, by[0].rejected) == ("<|assistant|>\na0<|end|>\n", "<|assistant|>\na1<|end|>\n")
    assert (by[1].n_prompt, by[1].n_chosen, by[1].n_rejected) == (1, 2, 2) and by[1].rejected_mask == "14:24"
    assert (by[2].n_prompt, by[2].n_chosen, by[2].n_rejected) == (1, 0, 0) and (by[3].n_chosen, by[3].n_rejected) == (1, 0) == (by[4].n_chosen, by[4].n_rejected)


def test_secrets_of_a_long_text(spark):
    text = "é " + " ".join(f"token=abc{i:05d}x aZ3{i:05d}qWerTyUiOpLkJ" for i in range(20_000))
    (r,) = secret_scan(spark.createDataFrame([(1, text, "a")], "doc_id long, text string, source string")).collect()
    assert len(r.base) == 20_000 and len(r["all"]) == 40_000
    assert all(text[s.start : s.end].endswith(s.value) for s in r["all"][:: 997])


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")
def test_pipeline(spark, odd, none, tmp_path):
    import corpus_pipeline

    items = bench(spark, [(1, "w10 w11 w12 w13 w14 w15 w16 w17 w18 w19")])
    for name, docs in (("odd", odd), ("none", none)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        items.write.parquet(str(tmp_path / name / "benchmark.parquet"))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path / name))
            assert out.columns == docs.columns and out.count() <= docs.count()
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()}
    assert got == {None, 6}
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_texts_of_one_id_are_judged_apart(spark):
    fields = "doc_id long, text string"
    # at the place where one text repeats lines, the other has clean ones
    lines = spark.createDataFrame([(1, "a\nb\nc"), (None, "a\nb\nc\nd"), (None, "p\nq\nr\ns"), (7, "a\nb\nc\nx"), (7, "k\nl\nm\nn"), (9, "p\nq\nr\nt")], fields)
    rows = {(r.row.doc_id, r.text) for r in line_dedup(lines).collect()}
    assert rows == {(None, "a\nb\nc\nd"), (None, "p\nq\nr\ns"), (1, ""), (7, "x"), (7, "k\nl\nm\nn"), (9, "t")}
    same_place = line_dedup(spark.createDataFrame([(None, "a\nb\nc\nd"), (None, "a\nb\nc\ne")], fields)).collect()
    assert sorted(r.n_removed for r in same_place) == [0, 3]

    base = " ".join(f"u{i}" for i in range(200))
    other = " ".join(f"v{i}" for i in range(200))
    docs = [(3, "one text alone"), (3, base), (3, other), (5, base + " end"), (6, other + " end"), (None, base + " more"), (None, "nobody has this"), (None, "null ids " + LONG), (None, "null ids " + LONG + " end")]
    frame = spark.createDataFrame(docs, fields)
    got = near_duplicates(frame).collect()
    assert len(got) == len(docs)
    assert {(r.doc_id, r.component_id, r.kept) for r in got if r.doc_id is not None} == {(3, 3, True), (5, 3, False), (6, 3, False)}
    assert sorted((r.component_id or 0, r.kept) for r in got if r.doc_id is None) == [(0, False), (0, True), (0, True), (3, False)]
    kept = [r.text for r in drop_near_duplicates(frame).collect()]
    assert len(kept) == 5 and {"one text alone", base, other, "nobody has this"} < set(kept)

    item = bench(spark, [(1, base)])
    assert {r.text for r in drop_contaminated(frame, item).collect()} == {t for _, t in docs if not t.startswith(base)}


def test_secret_copied_within_one_owner(spark):
    copied, own = "zQ9xK2mW7vB4nR8tY3pL", "aB3dE6gH9jK2mN5pQ8sT"
    docs = [(i, f"v {copied} and token={copied}", "one") for i in range(40)] + [(50, f"v {own} e", "one")]
    rows = {r.doc_id: r for r in secret_scan(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    assert (rows[0].n_live, rows[0].n_example) == (0, 1)
    assert [(s.kind, s.n_repositories) for s in rows[0]["all"]] == [(0, 40)]
    assert [(s.kind, s.value, s.n_repositories) for s in rows[50]["all"]] == [(3, own, 1)]

"""Fill-in-middle, prefix trie and quality network against brute force, and clashing column names for every operator and stage."""

import hashlib
import importlib.util
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracefold.llm import fill_middle, langid, prefix_trie, quality_cnn, wavelet
from tracefold.llm import queries as q
from tracefold.llm.chat_format import preference_format, with_foreign_reply
from tracefold.llm.decontaminate import decontaminate, drop_contaminated
from tracefold.llm.line_dedup import line_dedup
from tracefold.llm.mixing import mix_summary
from tracefold.llm.near_dedup import drop_near_duplicates, near_duplicates
from tracefold.llm.secret_scan import secret_scan
from tracefold.llm.substring_dedup import substring_dedup
from tracefold.llm.topk import quantised, top_k

#: Names that the operators use themselves, now or in earlier versions.
INTERNAL = "row hash n h1 h2 form output prefix_chars middle_chars score predicted held_out chunks quality lang_pred doc copy text_hash words lines covered n_lines n_removed kept n_words n_hit items _bad_id _gone_id _gone_hash _bad_hash _dup_id _dup_hash _covered _lines _n_lines _n_removed _lang_text _lang_pred _lang_score shingle bucket component size target taken piece shard base all spans p span".split()


def named(df):
    return df.select(*df.columns, *[F.lit(f"x{i}").alias(c) for i, c in enumerate(INTERNAL) if c not in df.columns])


def test_clashing_names(spark, tmp_path):
    texts = ["a\nb\nc\na\nb\nc", "the quick brown fox jumps over the lazy dog by the old river bank", "the quick brown fox jumps over the lazy dog by the old river bank!", None, ""]
    plain = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = named(plain)
    bench = named(spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog by the")], "item_id long, text string"))
    model = langid.fit(docs)
    network = quality_cnn.fit(docs, named(spark.createDataFrame([(1, 1), (0, 0)], "doc_id long, quality int")), rows=2, steps=2)
    operators = [
        lambda d: decontaminate(d, bench), mix_summary, lambda d: langid.identify(d, model), near_duplicates, secret_scan, substring_dedup, line_dedup, fill_middle.fill_in_middle, lambda d: quality_cnn.score(d, network),
    ]
    for operator in operators:
        ours, bare = (sorted(str([v for v in r if not hasattr(v, "asDict")]) for r in operator(d).collect()) for d in (docs, plain))
        assert ours == bare and len(ours) == 5
    for operator, left in ((lambda d: drop_contaminated(d, bench), 3), (drop_near_duplicates, 4)):
        out = operator(docs)
        assert out.columns == docs.columns and out.count() == left
    turns = named(spark.createDataFrame([(0, 0, "user", "q"), (0, 1, "assistant", "a"), (5, 0, "user", "q")], "conv_id long, turn long, role string, text string"))
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(turns)).count() == 3
    assert preference_format(with_foreign_reply(turns)).count() == 2
    vectors = quantised(named(spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<double>")))
    assert top_k(vectors, vectors, 1).count() == 2
    if importlib.util.find_spec("corpus_pipeline"):
        import corpus_pipeline

        bench.write.parquet(str(tmp_path / "benchmark.parquet"))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns and 3 <= out.count() <= 5
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 5


def test_wavelet_ranks_and_bisection():
    rng = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 8, n).astype(np.uint8)
        matrix, at = wavelet.WaveletMatrix(symbols), np.arange(n + 1)
        for wanted in (frozenset({3}), frozenset({0, 5, 7}), frozenset(range(1, 8)), frozenset(range(8))):
            want = np.concatenate(([0], np.cumsum(np.isin(symbols, list(wanted)))))
            assert (matrix.count(wanted, at) == want).all()
            k = np.arange(want[-1] + 2)
            assert matrix.locate(wanted, k, np.zeros(len(k)), np.full(len(k), n)).tolist() == [int(np.argmax(want >= x)) if want[-1] >= x else n for x in k]


def units_of(text, unit):
    import re

    return list(text) if unit == "char" else re.findall(r"[^ \t\n\v\f\r]*[ \t\n\v\f\r]|[^ \t\n\v\f\r]+$", text) if unit == "word" else text.splitlines(keepends=True) if text.isascii() else re.findall(r"[^\n]*\n|[^\n]+$", text)


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_fill_in_middle_units(spark, unit):
    texts = {1: "é😀ü a\n\nб b  c\n", 2: "", 3: None, 4: "x", 5: "a <M> b", 6: "ends without", 7: "\n", 8: " ", 9: "😀" * 70, None: "no id", 10: "<P", 11: "a<\nS>", 12: "word " * 50_000 + "é"}
    docs = spark.createDataFrame([(i, t, "k") for i, t in texts.items() for _ in range(1 + (i == 4))], "doc_id long, text string, form string")
    rows = fill_middle.fill_in_middle(docs, unit=unit).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(rows) == len(texts) + 1 and {r.form for r in rows} >= {"plain"}
    for r in rows:
        t = texts[r.row.doc_id] or ""
        digest = hashlib.sha256(f"1:{'' if r.row.doc_id is None else r.row.doc_id}".encode()).hexdigest()
        h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
        units = units_of(t, unit)
        assert r.row.form == "k" and r.n == len(units) and r.back == t
        a, b = sorted(x % (len(units) + 1) for x in h[:2])
        prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        form = "plain" if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
        assert r.form == form
        assert r.output == {"plain": t, "psm": f"<P>{prefix}<S>{suffix}<M>{middle}", "spm": f"<S>{suffix}<P>{prefix}<M>{middle}"}[form]
        assert (r.prefix_chars, r.middle_chars) == ((None, None) if form == "plain" else (len(prefix), len(middle)))
    assert fill_middle.fill_in_middle(docs.where("false")).count() == 0


def brute_trie(rows):
    """Nodes from (conv_id, turn, role, text) rows by the contract's words."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x, key=lambda y: (y[0], y[1], y[2], hashlib.md5(f"{len(y[2])}:{y[2]}{y[3]}".encode()).hexdigest()))] for c, x in own.items()}
    paths = {c: tuple(own.get(c - c % 5, [])[: zlib.crc32(str(c).encode()) % 9] + x[zlib.crc32(str(c).encode()) % 9 :]) for c, x in own.items()}
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def below(node):
        out, todo = [], [node]
        while todo:
            out.append(todo.pop())
            todo += children.get(out[-1], [])
        return out

    result = []
    for node, cs in members.items():
        tree = below(node)
        ends = ",".join(map(str, sorted(c for c in cs if paths[c] == node)))
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in tree if x)
        result.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children.get(node, [])), sum(x not in children for x in tree), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(result, key=str)


@pytest.mark.parametrize("shard_paths", [1, 7, 50_000])
def test_trie_against_brute_force(spark, shard_paths, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 16)
    if shard_paths == 7:
        monkeypatch.setattr(prefix_trie, "FEW_NODES", 0)
    rng = random.Random(shard_paths)
    rows = []
    for c in range(160):  # few texts, so that many prefixes are shared over shards
        rows += [(c, i, rng.choice(["u", "a"]), rng.choice(["", "x", "é"])) for i in range(rng.choice([0, 1, 2, 4, 12]))]
    rows += [(c, i, "u", f"t{i}") for c in range(200, 400) for i in range(3)]  # copies
    rows += [(c, i, "u", f"deep{i}" if i < 290 else f"{c}") for c in (500, 501, 505) for i in range(300)]
    rows += [(600, None, None, None), (600, 1, "u", "b"), (600, 1, "a", "b"), (600, 1, "a", "b"), (None, 0, "u", "lost"), (603, 2, "u", "z"), (604, None, "u", "n"), (604, 5, None, None)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = prefix_trie.prefix_trie(prefix_trie.rebuilt(frame), shard_paths=shard_paths)
    assert got.columns == "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_trie(rows)


def test_trie_of_nothing_and_of_turnless_ones(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(empty)).count() == 0
    rows = [(c, 0, "u", "only") for c in range(1, 40)]  # donors of most are absent, so many lose their turn
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted((tuple(r) for r in prefix_trie.prefix_trie(prefix_trie.rebuilt(frame)).collect()), key=str) == brute_trie(rows)


def test_network_gradients_and_scores():
    rng = np.random.default_rng(5)
    texts = [b"", b"a", bytes(rng.integers(97, 100, 57).tolist()), bytes(rng.integers(0, 256, 64).tolist()), bytes(rng.integers(97, 123, 1000).tolist())]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    padded, first = quality_cnn.padded_blocks(offsets, np.frombuffer(b"".join(texts), np.uint8))
    docs = []
    for i in range(len(texts)):
        begins, ends, _ = quality_cnn.chunk_bounds(np.array([first[i + 1] - first[i]]))
        assert begins[0] == 0 and ends[-1] == first[i + 1] - first[i] and all(b < e for b, e in zip(begins[1:], ends, strict=False))
        docs.append((i % 2, [(int(e - b), padded[(first[i] + b) * 64 : (first[i] + e) * 64 + 8]) for b, e in zip(begins, ends, strict=True)]))
    drawn = [(label, [(n, x.astype(np.int16).tobytes()) for n, x in chunks]) for label, chunks in docs]
    w = quality_cnn.train(drawn, steps=3, seed=1, batch=4)
    network = quality_cnn.Network(w, 0.25)

    def brute(weights, chunks):  # window by window
        total = size = 0.0
        for n, x in chunks:
            found = [np.einsum("wd,wdf->f", weights["bytes"][x[s : s + 8]], weights["filters"]) for s in range(0, 64 * n, 2)]
            hidden = np.maximum(np.maximum(np.max(found, axis=0) + weights["bias"], 0) @ weights["mix"] + weights["mix_bias"], 0)
            total, size = total + n * (hidden @ weights["out"] + weights["out_bias"])[0], size + n
        return total / size

    got = network.score(offsets, np.frombuffer(b"".join(texts), np.uint8))
    want = [1 / (1 + np.exp(-brute(w, chunks) - 0.25)) for _, chunks in docs]
    assert np.allclose(got, want, atol=1e-5)

    double = {k: v.astype(float) for k, v in w.items()}
    loss = lambda weights: np.mean([np.log1p(np.exp(-(2 * label - 1) * brute(weights, chunks))) for label, chunks in docs])
    gradient = quality_cnn.gradients(double, docs)
    for name, g in gradient.items():
        flat = int(np.abs(g).argmax())
        changed = [{**double, name: double[name].copy()} for _ in range(2)]
        for weights, step in zip(changed, (1e-5, -1e-5), strict=True):
            weights[name].flat[flat] += step
        assert abs((loss(changed[0]) - loss(changed[1])) / 2e-5 - g.flat[flat]) < 1e-4 * max(1, abs(g.flat[flat]))


def test_quality_held_out(spark):
    import duckdb

    quality = dict(duckdb.execute("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").fetchall())
    rows = q.op13_quality_cnn(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in quality]
    assert len(held) > 90 and sum(r.predicted == quality[r.doc_id] for r in held) >= 0.97 * len(held)


def test_quality_corner_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "good"), (3, "good"), (None, "nobody"), (4, "w " * 200_000)], "doc_id long, text string")
    fields = "doc_id long, quality int"
    nothing = quality_cnn.fit(docs, spark.createDataFrame([], fields))
    assert {r.score for r in quality_cnn.score(docs, nothing).collect()} == {0.5}
    odd = quality_cnn.fit(docs, spark.createDataFrame([(3, 1), (2, 1), (2, 0), (None, 1), (4, None), (4, 7), (99, 1)], fields))
    assert not odd.weights and len({r.score for r in quality_cnn.score(docs, odd).collect()}) == 1
    some = quality_cnn.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(10)], fields), rows=3, steps=3)
    got = quality_cnn.score(docs, some).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert quality_cnn.score(docs.where("false"), some).count() == 0


def test_html_keeps_what_only_looks_like_chrome():
    from tracefold.llm.html_extract import main_text

    parts = ["<section class='social-policy'><p>Policy text</p></section>", "<div id='share'><p>Shares fell</p></div>", "<section id='privacy-notices'><p>On notices</p></section>", "<div class='newsletter'><p>A letter</p></div>"]
    inline = "<p>Press <button>OK</button> now, <label>reader</label>.</p><xmp>a <b> & c</xmp><p>Where <math><mi>x</mi></math> is</p><aside><p>A quote of hers</p></aside>"
    gone = "<button>Share</button><nav>menu</nav><form><label>Mail</label><input></form><div class='comments'><p>Nice</p></div><aside><a href=/x>Elsewhere</a></aside><div class='ad'>Buy</div>"
    page = f"<html><body><article><h1>T</h1>{''.join(parts)}{gone}{inline}</article></body></html>"
    assert main_text(page) == "T\nPolicy text\nShares fell\nOn notices\nA letter\nPress OK now, reader.\na <b> & c\nWhere x is\nA quote of hers"


def test_html_template_by_alignment_alone():
    """Menus and ends without a name, between which the text stands in elements of the same kind, go by the host's pages alone."""
    from tracefold.llm.html_extract import expression, infer, main_text

    rng = random.Random(6)
    sentence = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    bodies = [[sentence(12) for _ in range(rng.randrange(1, 5))] for _ in range(9)]
    site = lambda ps: f"<body><div><a href=/>Home</a> <a href=/n>News</a></div><div>{''.join(f'<p>{p}</p>' for p in ps)}</div><div>All rights reserved</div></body>"
    pages = [site(b) for b in bodies]
    wrapper = infer(pages)
    changed = sum(main_text(p, wrapper) != main_text(p) for p in pages)
    assert changed == 9 and [main_text(p, wrapper) for p in pages] == ["\n".join(b) for b in bodies]
    assert main_text(site(["fresh words of a new page"]), wrapper) == "fresh words of a new page"
    lead = "<p class='lead'>Correction: a name was wrong</p>"
    for n in (3, 5):
        articles = [f"<body><article><h1>{sentence(2)}</h1>{lead}<p>{sentence(9)}</p></article></body>" for _ in range(n)]
        assert all("Correction" in main_text(p, infer(articles)) for p in articles)
    assert expression(infer(["<p>a</p><ul><li>x<li>y</ul><p>b</p>", "<p>a</p><p>c</p>"])) == "<#root>(<p>#slot</>)+(<ul>(<li>#text</>)+</>)?(<p>#text</>)?</>"
    assert expression(infer(["<h2>a</h2><p>b</p><h2>c</h2><p>d</p>", "<h2>a</h2><p>e</p>"])) == "<#root>(<h2>#slot</><p>#slot</>)+</>"


def brute_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignment_of_streams():
    from tracefold.llm import html_wrapper as hw

    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        pairs = hw.matches(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs) and len({i for i, _ in pairs}) == len(pairs) == len({j for _, j in pairs}) == brute_lcs(a, b)

    def fits(node, tokens):
        """Whether an element stream matches the wrapper's regular expression, tried in all ways."""
        import re

        def pattern(n, top):
            inner = "".join(pattern(k, False) for k in n.kids)
            body = "t" if n.mark == hw.TEXT else f"(?:{inner})" if n.mark.startswith("(") else f"{n.mark}<{inner}>"
            return body if top else f"(?:{body})*" if n.times > n.pages else f"(?:{body})?"

        return re.fullmatch(pattern(node, True), tokens) is not None

    def page(depth=0):
        return [(rng.choice("abc"), page(depth + 1) if depth < 2 else []) if rng.random() < 0.8 else None for _ in range(rng.randrange(5))]

    def tokens(kids, out, parent):
        for k in kids:
            out.append((parent, hw.TEXT if k is None else k[0], str(rng.random()) if k is None else None))
            if k is not None:
                tokens(k[1], out, len(out) - 1)
        return out

    stream = lambda kids: "".join("t" if k is None else f"{k[0]}<{stream(k[1])}>" for k in kids)
    for _ in range(60):
        pages = [page() for _ in range(rng.randrange(1, 5))]
        wrapper = None
        for p in pages:
            own, nodes = hw.of_page(hw.stream(tokens(p, [(-1, "r", None)], 0)))
            assert len(nodes) == len(tokens(p, [(-1, "r", None)], 0)) and set(nodes) <= set(hw.ordered(own))
            wrapper = own if wrapper is None else hw.merge(wrapper, own)
        again = hw.read(hw.written(wrapper))
        assert hw.written(again) == hw.written(wrapper) and again.pages == len(pages)
        assert all(fits(again, f"r<{stream(p)}>") for p in pages)


def test_html_wrappers_meet_over_many_buckets(spark, monkeypatch):
    from tracefold.llm import html_extract

    monkeypatch.setattr(html_extract, "ALIGNED", 2)
    rows = [(i, f"http://{'big' if i % 5 else 'small'}.example/{i}", f"<body><div>Menu of the site</div><div><p>text {i} of a page {i * 7}</p></div><div>End of it</div></body>") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    read = html_extract.parsed(pages)
    wrappers = {r.host: r.wrapper for r in html_extract.fit_wrappers(read).collect()}
    assert wrappers == {r.host: r.wrapper for r in html_extract.fit_wrappers(read.repartition(7)).collect()} and set(wrappers) == {"big.example", "small.example"}
    assert {h: html_extract.read(w).pages for h, w in wrappers.items()} == {"big.example": 240, "small.example": 60}
    assert all(r.text == f"text {r.page_id} of a page {r.page_id * 7}" for r in html_extract.extract(pages).collect())


def test_top_k_skips_blocks_and_rows_below_the_bound():
    from tracefold.llm import topk

    rng = np.random.default_rng(2)
    centres = rng.normal(0, 400, (20, 8)).round()
    vectors = [(c + rng.integers(-9, 10, (16, 8))).astype(float) for c in centres]
    scored = []

    class Counted:
        def __init__(self, i):
            self.i = i

        def __matmul__(self, q):
            scored.append(self.i)
            return vectors[self.i] @ q

        def __eq__(self, q):
            return vectors[self.i] == q

    blocks = [(np.arange(16) + 16 * i, np.ones(16, dtype=int), Counted(i)) for i in range(20)]
    ends = np.array([v.max(axis=0) for v in vectors]), np.array([v.min(axis=0) for v in vectors])
    every = np.concatenate(vectors)
    for n in range(0, 320, 16):
        q, limits = every[n], topk.bounds(every[n][None], *ends)[0]
        want = sorted((-int(s), i) for i, s in enumerate(every @ q) if i != n)[:5]
        before = len(scored)
        assert topk.best_of(q, n, blocks, limits, 5, float("-inf")) == want
        assert len(scored) - before < 10  # most of the 20 blocks can't reach the fifth score
        # a known fifth score lets no row below it through, and ties stay
        assert topk.best_of(q, n, blocks, limits, 5, float(-want[-1][0])) == want
        assert all(-s >= -want[2][0] for s, _ in topk.best_of(q, n, blocks, limits, 5, float(-want[2][0])))

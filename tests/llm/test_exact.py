"""Registered results against brute force, on odd rows and on a small table."""

import random

import brute
import pytest

from spanloom.llm import decontaminate, html_text, licenses, minhash, quality, queries, secrets, substring_dedup


def both(rows):
    return sorted(rows, key=repr)


@pytest.fixture(scope="session")
def small(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_decontamination(spark, odd, odd_rows, small, empty, sf_dir):
    texts = {i: t for i, t, _ in odd_rows}
    items = [(1, " ".join(texts[6].split()[5:40]).upper()), (2, "one"), (3, ""), (4, None), (10, texts[6][:300]), (2, "no id here")]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = both(brute.decontamination([(i, t) for i, t, _ in odd_rows], items))
    for block in (decontaminate.BLOCK_WORDS, 20):
        assert both(tuple(r) for r in decontaminate.score_documents(odd, table, block_words=block).collect()) == want
    for block in (decontaminate.BLOCK_WORDS, 20):
        kept = [r.doc_id for r in decontaminate.clean_documents(odd, table, block_words=block).collect()]
        assert both(kept) == both(r[0] for r in want if not r[2])
    assert decontaminate.score_documents(empty, table).count() == 0
    assert {r.n_hit for r in decontaminate.score_documents(odd, table.limit(0)).collect()} == {0}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert both(tuple(r) for r in queries.op8_decontamination(spark, sf_dir).collect()) == both(brute.decontamination(small[1], bench))


def test_a_short_passage_in_a_long_text_is_dropped(spark):
    words = [f"w{i}" for i in range(2000)]
    item = " ".join(f"q{i}" for i in range(40))
    passage = item.split()[9:22]
    rows = [(1, " ".join(words[:1000] + passage + words[1000:])), (2, " ".join(words)), (3, " ".join(words + passage[:-1])), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.clean_documents(docs, items).collect()} == {2, 3, 4, 5}
    scored = {r.doc_id: r for r in decontaminate.score_documents(docs, items).collect()}
    assert scored[1].n_hit == 13 and not scored[1].contaminated


def test_phrase_and_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a x b y c"), (3, "c b a")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b c")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.matches(docs, items).collect()] == [(1, "7", 0, 0, 3)]
    assert both(tuple(r) for r in decontaminate.matches(docs, items, slop=2).collect()) == [(1, "7", 0, 0, 3), (2, "7", 0, 0, 5)]


def test_substring_dedup(spark, odd, odd_rows, small, empty):
    known = [(i, t) for i, t, _ in odd_rows if i is not None]
    got = [tuple(r) for r in substring_dedup.drop_repeats(odd).collect()]
    assert both(r for r in got if r[0] is not None) == both(brute.substring_dedup(known))
    assert all(r[2] == 0 for r in got if r[0] is None)
    assert substring_dedup.drop_repeats(empty).count() == 0
    assert both(tuple(r) for r in substring_dedup.drop_repeats(small[0]).collect()) == both(brute.substring_dedup(small[1]))


@pytest.mark.parametrize("seed", range(3))
def test_substring_dedup_on_branching_texts(spark, seed):
    """Few words, many shared passages: branches, cycles, overlaps."""
    rng = random.Random(seed)
    pool = [[rng.choice("abcd") for _ in range(rng.randrange(3, 30))] for _ in range(8)]
    rows = [(rng.randrange(40), " ".join(w for _ in range(rng.randrange(1, 9)) for w in rng.choice(pool))) for _ in range(40)]
    rows = list({i: (i, t) for i, t in rows}.values())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for window, k in ((10, 3), (8, 8), (5, 2)):
        got = both(tuple(r) for r in substring_dedup.drop_repeats(docs, window, k).collect())
        assert got == both(brute.substring_dedup(rows, window))


def thue_morse(n, a, b):
    """A word and its complement, which every polynomial hash modulo a power of 2 takes for one."""
    s = [0]
    while len(s) < n:
        s += [1 - x for x in s]
    return "".join((a, b)[x] for x in s), "".join((b, a)[x] for x in s)


def test_substring_dedup_leaves_no_shuffle_files_of_finished_jobs(spark, small, monkeypatch):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x for x in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}
    monkeypatch.setattr(substring_dedup, "discard", lambda *a: None)  # as where the driver does not get to its garbage
    before = files()
    substring_dedup.drop_repeats(small[0])
    assert not files() - before


def test_words_that_polynomial_hashes_confuse(spark):
    pairs = [thue_morse(n, a, b) for n in (1024, 2048, 4096) for a, b in ("ab", "cd", "xy", "pq", "mn", "ef", "gh")]
    fill = [f"w{i}" for i in range(39)]
    rows = [(1, " ".join([*fill, *(a for a, _ in pairs)])), (2, " ".join([*fill, *(b for _, b in pairs)])), (3, " ".join([*fill, *(a for a, _ in pairs)]) + " end")]
    # the same for words as letters of a long sequence
    rows += [(4, thue_morse(4096, "u ", "v ")[0]), (5, thue_morse(4096, "u ", "v ")[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert both(tuple(r) for r in substring_dedup.drop_repeats(docs).collect()) == both(brute.substring_dedup(rows))
    items = [(1, " ".join(a for a, _ in pairs[:14]))]
    got = decontaminate.score_documents(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert both(tuple(r) for r in got) == both(brute.decontamination(rows, items)) and [r.n_hit for r in got if r.doc_id == 2] == [0]
    for block in (1, 1000):
        many = items + [(2, " ".join(fill)), (3, pairs[3][1])]
        got = decontaminate.score_documents(docs, spark.createDataFrame(many, "item_id long, text string"), block_words=block).collect()
        assert both(tuple(r) for r in got) == both(brute.decontamination(rows, many))
    classes = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert classes[1] == classes[3] != classes[2]


def test_quality_base(spark, odd, odd_rows, empty):
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = quality.judge(odd)
    assert both(tuple(r) for r in got.select(*names).collect()) == both(brute.quality_base(i, t) for i, t, _ in odd_rows)
    assert all(not r.kept for r in got.where("base_failed").collect())
    assert quality.judge(empty).count() == 0


def test_quality_keeps_clean_and_drops_damaged(spark, sf_dir):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in queries.op3_quality(spark, sf_dir).collect() if r.doc_id in labels and not r.base_failed]
    assert sum(r.kept == bool(labels[r.doc_id]) for r in rows) >= 0.95 * len(rows)


def test_posteriors_against_brute_force(spark, sf_dir):
    rows = quality.judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    passed = [r for r in rows if not r.base_failed]
    votes = [[r.pattern // 3**i % 3 for i in range(len(quality.RULES))] for r in passed]
    for r, v in zip(passed, votes, strict=True):
        # the votes themselves, for three of the rules
        assert v[1] == (0 if r.n_symbols > 0.2 * r.n_words else 2 if r.n_symbols <= 0.05 * r.n_words else 1)
        assert v[3] == (0 if r.n_repeat_words > 0.3 * r.n_words else 2 if r.n_repeat_words <= 0.15 * r.n_words else 1)
        assert v[4] == (0 if r.n_dup_lines > 0.25 * r.n_lines else 2 if r.n_dup_lines <= 0.1 * r.n_lines else 1)
    for r, p in zip(passed, brute.posteriors(votes), strict=True):
        assert abs(r.quality - p) < 1e-6 and r.kept == (r.quality >= 0.5)


def test_em_learns_accuracies():
    share, table, good = quality.fit({8: 900, 0: 80, 2: 10, 6: 10}, 2)
    assert 0.8 < share < 0.99 and good[8] > 0.9 and good[0] < 0.1


def test_secrets(spark, odd, odd_rows, empty, sf_dir):
    tricky = [
        (1, "secret=token: abcdefgh"), (2, "Token=\"abc\" API_KEY : 'ABCDEF0123' apikey=zzzzzz"), (3, "😀😀 password=abcdef AKIA" + "A" * 30), (4, "deadbeef" * 3 + "x" + "0" * 23), (5, "AKIA" * 6 + " AKIAX"),
        (6, "ghp_" + "a1" * 20), (10, "xoxb-1234567890-abcdef AIza" + "Sy_-" * 10 + " eyJhbGciOi.eyJzdWIiOiIx.SflKxwRJSMeKKF2QT4 xox ghp_short"), (11, "-----BEGIN PRIVATE KEY----- -----BEGIN RSA  PRIVATE"), (7, "passwd=12345 passwd=123456"), (8, "-----BEGIN RSA PRIVATE KEY-----"), (9, "token=" * 50),
    ]
    docs = spark.createDataFrame([(i, t) for i, t, _ in odd_rows] + [(1000 + i, t) for i, t in tricky], "doc_id long, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = secrets.find_secrets(docs).collect()
    for r in found:
        assert sorted(r.found) == r.found
    digest = queries.secret_digest(secrets.find_secrets(docs))
    assert both(tuple(r) for r in digest.collect()) == both((i, *brute.secrets(t), brute.secret_spans(t)) for i, t in rows)
    known = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert both(tuple(r) for r in queries.op9_secrets(spark, sf_dir).collect()) == both((i, *brute.secrets(t), brute.secret_spans(t)) for i, t in known.items())
    secrets.BROADCAST_ROWS, usual = 0, secrets.BROADCAST_ROWS
    assert secrets.find_secrets(docs).collect() and both(tuple(r) for r in queries.secret_digest(secrets.find_secrets(docs)).collect()) == both(tuple(r) for r in digest.collect())
    secrets.BROADCAST_ROWS = usual
    assert secrets.find_secrets(empty).count() == 0 and secrets.find_secrets(odd).count() == len(odd_rows)
    kinds = {s.kind for r in found for s in r.found}
    assert {"github", "pem"} <= kinds


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf_dir, name):
    import sys

    sys.path.insert(0, "tests")
    from compare import compare, duck

    assert compare(spark, duck(sf_dir), sf_dir, queries.queries()[name], queries.oracle_sql()[name]) is None


def test_trigram_queries():
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == [frozenset({"aki", "kia"})]
    assert secrets.needs_scan(secrets.trigram_query("[0-9a-f]+"))
    assert secrets.trigram_query("(abc|xyz)d?") == [frozenset({"abc"}), frozenset({"xyz"})]
    assert secrets.needs_scan(secrets.trigram_query("(abc)*d"))


def test_html(spark):
    pages = spark.createDataFrame(
        [
            (1, "u", None), (2, "u", ""), (3, None, "<p>" + "long words here " * 20 + "<p>Short.<div class='comments'><p>nice &amp; so on</div>"), (4, "u", "<![weird]><nav>menu</nav>"),
            (5, "u", "<body><div id=sidebar>links</div><div class=main><h1>T&eacute;</h1><p>" + "some text " * 30 + "</p><p>x</p><form>f</form></div><footer>c</footer>"), (6, "u", "<p>a</b></i><br>b&nbsp;c\n d" + " e" * 10_000),
        ],
        "page_id long, url string, html string",
    )
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert got[1] == got[2] == got[4] == ""
    assert got[3] == ("long words here " * 20).strip() + "\nShort."
    assert got[5] == "Té\n" + ("some text " * 30).strip() + "\nx"
    assert got[6].startswith("a b c d e e")
    assert html_text.extract(pages.limit(0)).count() == 0


def test_html_names_on_wrappers():
    long = "<h1>Title</h1><p>" + "some text " * 40 + "</p><p>Short.</p><p>" + "more words " * 40 + "</p>"
    want = "Title\n" + ("some text " * 40).strip() + "\nShort.\n" + ("more words " * 40).strip()
    menu, talk = "<div class='menu'><a>one</a> <a>two</a></div>", "<div id='comments'><p>" + "I agree " * 300 + "</p></div>"
    cards = "<div class='related'><article class='card'><p>" + "another page " * 30 + "</p></article></div>"
    for wrapped in (
        f"<div class='content-sidebar-wrap'>{menu}<div>{long}</div></div>", f"<body>{menu}<div class='layout has-sidebar'>{long}</div></body>", f"<article class='post no-comments'>{long}</article>",
        f"<div class='content-sidebar-wrap'><article class='post no-comments'>{long}</article>{talk}</div>", f"<main class='has-sidebar'>{menu}{long}</main>{talk}",
        f"<div class='page-with-menu'><div class='widget'><article>{long}</article></div></div>", f"<div class='has-sidebar'><article>{long}</article>{cards}</div>",
    ):
        assert html_text.main_text(wrapped) == want, wrapped[:60]
    halves = "<div class='post no-comments'><p>" + "some text " * 40 + "</p></div>"
    assert html_text.main_text("<h1>Title</h1>" + menu + halves * 2) == "Title\n" + "\n".join([("some text " * 40).strip()] * 2)
    assert html_text.main_text(f"<article></article><div class='has-sidebar'>{long}</div>") == want
    assert html_text.main_text("<article><p>A short one.</p></article>" + talk) == "A short one."
    assert html_text.main_text(halves * 2) == "\n".join([("some text " * 40).strip()] * 2)


def test_html_article_over_sibling_containers():
    para = lambda word, n: f"<p>{(word + ' text ') * n}</p>"
    want = lambda *parts: "\n".join(((w + " text ") * n).strip() if n else w for w, n in parts)
    menu = "<ul>" + "<li><a>x</a></li>" * 30 + "</ul>"
    page = f"<body>{menu}<div id=post><section>{para('some', 100)}{para('more', 130)}</section><section>{para('closing', 9)}<p>End.</p>{para('last', 6)}</section></div></body>"
    assert html_text.main_text(page).endswith(want(("some", 100), ("more", 130), ("closing", 9), ("End.", 0), ("last", 6)))
    table = f"<body><table><tr><td>{para('opening', 20)}</td></tr><tr><td>{para('some', 300)}{para('more', 300)}</td></tr><tr><td>{para('closing', 20)}</td></tr></table>{'<br>' * 30}{menu}</body>"
    assert want(("opening", 20), ("some", 300), ("more", 300), ("closing", 20)) in html_text.main_text(table)
    assert html_text.main_text(page).split("\n").count("x") <= 3 and html_text.main_text(table).split("\n").count("x") <= 3


def test_html_clustering_decides():
    """Ratio, smoothing and threshold select the lines, on pages with article elements and without."""
    para = lambda word, n: f"<p>{(word + ' text ') * n}</p>"
    body = "<ul>" + "<li><a>item</a></li>" * 12 + "</ul><h1>Title here</h1>" + para("some", 60) + para("more", 80) + "<p>End.</p>" + "<div><a>one</a></div>" * 12
    whole = ["Title here", ("some text " * 60).strip(), ("more text " * 80).strip(), "End."]
    for page in (f"<body>{body}</body>", f"<body><div>{body}</div></body>", f"<body><article>{body}</article></body>"):
        def cut(sigma=html_text.SIGMA, threshold=html_text.THRESHOLD, page=page):
            p = html_text.Lines()
            p.feed(page)
            p.close()
            return html_text.content_lines(p.lines, p.elements, p.named, p.hidden, sigma, threshold)

        usual = cut()
        assert [x for x in usual if x in whole] == whole and usual.count("item") <= 6 and usual.count("one") <= 6
        assert len(cut(threshold=0)) == 28 > len(usual)
        assert len(cut(threshold=1.5)) < len(usual) and cut(threshold=3, sigma=0.34) == whole[1:3] and cut(sigma=0.34) != usual


def test_html_deep_nesting_is_linear():
    import time

    def took(n):
        page = "<div class='menu'>x" * n + "<p>" + "some text " * 50 + "</p>" + "</i>" * n
        began = time.process_time()
        html_text.main_text(page)
        return time.process_time() - began

    took(1000)
    assert took(16_000) < 8 * max(took(4000), 0.05)


def test_html_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "u", "<p>a text</p>", "n", 3, "t")], "page_id long, url string, html string, name string, n_chars int, text string")
    assert [tuple(r) for r in html_text.extract(rows).collect()] == [(1, "u", "a text", 6)]


def test_html_articles_whole(spark, sf_dir):
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in queries.op10_html(spark, sf_dir).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "<br>" in b else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_licenses(spark, odd, odd_rows, empty):
    apache = licenses.TEMPLATES["Apache-2.0-header"]
    docs = spark.createDataFrame([(1, "the of and " * 500 + apache.replace("You may obtain", "Anyone may obtain") + " the end " * 300), (2, "Released UNDER the mit license."), (3, None), (4, "license " * 2000), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert got[1].license == "Apache-2.0-header" and 0.9 < got[1].coverage < 1 and got[1].start == 1500
    assert (got[2].license, got[2].coverage, got[2].start, got[2].stop) == ("MIT", 1.0, 0, 5)
    assert got[3].license is None and got[4].license is None and got[5].licenses == []
    assert licenses.scan_licenses(odd).count() == len(odd_rows) and licenses.scan_licenses(empty).count() == 0


def test_licenses_against_brute_force(spark, small, sf_dir):
    """Every notice that stands whole is found whole; no more words are aligned than any alignment could."""
    whole = {n: t for n, t in licenses.TEMPLATES.items() if n.endswith("text")}
    rng = random.Random(8)
    rows = list(small[1])
    for i, (name, text) in enumerate(whole.items()):
        w = text.split()
        for j in rng.sample(range(len(w)), len(w) // 12):
            w[j] = "changed"
        rows += [(10**6 + 2 * i, f"some words before {text} and after"), (10**6 + 2 * i + 1, " ".join(w))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    for r in licenses.scan_licenses(docs).collect():
        found = {x.license: x for x in r.licenses}
        for name, template in licenses.TEMPLATES.items():
            if brute.holds(texts[r.doc_id], template):
                assert found[name].coverage == 1.0
            if name in found:
                n = len(brute.alnum(template))
                most = brute.common_words(texts[r.doc_id], template)
                assert 0.8 * n <= found[name].n_aligned <= most
        if r.doc_id >= 10**6:
            name = list(whole)[(r.doc_id - 10**6) // 2]
            assert name in found and found[name].coverage > 0.85
    got = {r.doc_id: r.license for r in queries.op7_licenses(spark, sf_dir).collect()}
    assert all(got[i] is not None for i, t in small[1] if any(brute.holds(t, x) for x in licenses.TEMPLATES.values()))


def test_repeated_notices(spark):
    before, after = "the of and the software to this in and is " * 3, "the and of license under a the rights " * 3
    rows = [(name, n, before + (text + "\n") * n + after) for name, text in licenses.TEMPLATES.items() for n in (1, 2, 3, 9)]
    docs = spark.createDataFrame([(i, text) for i, (_, _, text) in enumerate(rows)], "doc_id long, text string")
    found = {r.doc_id: {x.license: x.coverage for x in r.licenses} for r in licenses.scan_licenses(docs).collect()}
    assert all(found[i].get(name) == 1.0 for i, (name, _, _) in enumerate(rows))
    edited = licenses.TEMPLATES["MIT-opening"].replace("free of charge", "at no cost at all").replace("Permission is", "Leave is") + "\n"
    r = licenses.scan_licenses(spark.createDataFrame([(1, before + edited * 5 + after)], "doc_id long, text string")).first()
    assert r.license == "MIT-opening" and r.coverage > 0.9


def test_patience_alignment_is_rising_and_equal():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.choice("abcdefghij") for _ in range(rng.randrange(20))] for _ in range(2))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    assert licenses.align(list("abcdef"), list("xabcyef")) == [(0, 1), (1, 2), (2, 3), (4, 5), (5, 6)]


def test_near_duplicates(spark, odd, odd_rows, small, empty):
    def classes(rows):
        sets = {i: brute.shingles(t) for i, t in rows}
        ids = sorted(sets)
        head = {i: i for i in ids}

        def find(i):
            while head[i] != i:
                i = head[i]
            return i

        for n, b in enumerate(ids):
            for a in ids[:n]:
                if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and brute.jaccard(sets[a], sets[b]) >= 0.8:
                    x, y = find(a), find(b)
                    head[max(x, y)] = min(x, y)
        return {i: find(i) for i in ids}

    for docs, rows in ((odd, [(i, t) for i, t, _ in odd_rows]), small):
        got = minhash.near_duplicates(docs).collect()
        want = classes([r for r in rows if r[0] is not None])
        assert len(got) == len(rows) and all(r.class_id == want.get(r.doc_id) for r in got)
    assert minhash.near_duplicates(empty).count() == 0


def test_large_buckets_lose_no_link(spark):
    """A hub that is not the least id, chains, and many dissimilar texts in one bucket."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(60):
        v = list(base)
        for j in rng.sample(range(100), 2):
            v[j] = f"r{rng.random()}"
        rows.append((i, " ".join(v)))
    rows.append((500, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    sets = {i: brute.shingles(t) for i, t in rows}
    for i in sets:
        for j in sets:
            if brute.jaccard(sets[i], sets[j]) >= 0.8:
                assert got[i] == got[j]


def test_dart_signatures_estimate_weighted_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    e = rng.integers(0, 2**63, 300, dtype=np.uint64)
    wa, wb = rng.integers(1, 6, 300).astype(float), rng.integers(1, 6, 300).astype(float)
    sig = minhash.dart_signatures(np.concatenate([e, e]), np.concatenate([wa, wb]), np.array([0, 300, 600]), 2000)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()) < 0.05

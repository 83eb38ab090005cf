"""The ten operators against brute force, round trips and held-out accuracy, and on nulls, empty and repeated rows and empty tables."""

import collections
import hashlib
import html
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import chat, components, decontaminate, jaccard, langid, licenses, packing, quality, queries, repetition, urlfilter, wrapper

SF = "/root/testdata/sf0.001"
LOWER = {i: i + 32 for i in range(65, 91)}
ODD = "doc_id long, text string, lang string, source string, n_words string, kept string, score string"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, columns whose names operators add."""
    long = " ".join(f"word{i % 977} of{i}" for i in range(20000))
    rows = [(1, None, None), (2, "", "en"), (3, "  \n\t ", "en"), (4, "a b", "en"), (4, "a b", "en"), (5, "A B", None), (6, long, "en"), (7, long + " end", None), (8, "12 !! 34", "en"), (None, "a c", "en")]
    return spark.createDataFrame([(*r, "src0", "x", "y", "z") for r in rows], ODD)


def oracle(sql, sf=SF):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    q = con.execute(sql)
    names = [d[0] for d in q.description]
    return sorted(tuple(sorted(zip(names, r, strict=True))) for r in q.fetchall())


def plain(df):
    return sorted(tuple(sorted(r.asDict().items())) for r in df.collect())


# ------------------------------------------------------------------ op1


def test_suffix_array_gives_the_longest_matches():
    random.seed(5)
    for _ in range(60):
        docs = [[random.randrange(random.choice([1, 2, 3, 50])) for _ in range(random.randrange(0, 40))] for _ in range(4)]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in docs])]).astype(np.int64)
        code = np.array([y for x in docs for y in x], np.int64)
        for least in (1, 3, 8, 9):
            want = []
            for x in docs:
                for i in range(len(x)):
                    best = 0
                    for j in range(len(x)):
                        k = 0
                        while j != i and i + k < len(x) and j + k < len(x) and x[i + k] == x[j + k]:
                            k += 1
                        best = max(best, k)
                    want.append(best if best >= least else 0)
            assert repetition.longest_matches(code, offsets, least).tolist() == want


def test_op1_equals_sql(spark):
    assert plain(queries.op1_repetition_rules(spark, SF)) == oracle(queries.SQL["op1_repetition_rules"])


@pytest.mark.parametrize("name", ["op5_jaccard_join", "op6_decontamination", "op9_chat_formatting"])
def test_equal_to_sql(spark, name):
    assert plain(queries.QUERIES[name](spark, SF)) == oracle(queries.SQL[name])


def test_op1_on_odd_rows(odd):
    got = repetition.rules(odd).collect()
    assert len(got) == odd.count() and got[0].asDict().keys() >= {"lang", "source", "score"}
    assert all(r.base_failed and not r.kept for r in got if not (r.text or "").strip())
    assert {r.kept for r in got if r.doc_id in (6, 7)} == {True}
    assert repetition.rules(odd.limit(0)).count() == 0


# ------------------------------------------------------------------ op2, op8


def test_op2_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = queries.op2_quality_classifier(spark, "/root/testdata/sf0.01").join(labels, "doc_id").filter("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.97


def test_op2_without_labels_and_on_odd_rows(spark, odd):
    none = spark.createDataFrame([(1, None), (6, 1)], "doc_id long, quality int")
    model, x = quality.learn(odd, none)
    assert model is None and {r.score for r in quality.scored(x, model).collect()} == {0.5}
    assert quality.accepted(odd, model).count() == odd.count() and quality.accepted(odd.limit(0), model).count() == 0


def test_op8_held_out_and_undetermined(spark, odd):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = queries.op8_language_id(spark, sf).join(docs, "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    model = langid.fit(spark.read.parquet(f"{sf}/documents.parquet"), F.lit(True), 200)
    found = langid.identify(odd, model).collect()
    assert {r.doc_id: r.lang_pred for r in found if not re.search("[a-zA-Z]", r.text or "")} == {1: "und", 2: "und", 3: "und", 8: "und"}
    assert all(r.lang_score == 0 for r in found if r.lang_pred == "und")
    assert langid.fit(odd.limit(0), F.lit(True)) is None and {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}


# ------------------------------------------------------------------ op3, op4


def test_op3_equals_sql(spark):
    assert plain(queries.op3_license_scan(spark, SF)) == oracle(queries.SQL["op3_license_scan"])


def test_op3_on_odd_rows(spark, odd):
    texts = [("x Released UNDER the MIT licence Released under the MIT License", ["MIT"]), ("This work is licensed under the GNU General Public License, version", ["GPL-3.0"]), ("Licensed under CC BY-NC", [])]
    df = spark.createDataFrame([(t,) for t, _ in texts], "text string")
    assert {r.text: r.licenses for r in licenses.scan(df).collect()} == dict(texts)
    assert {r.n_licenses for r in licenses.scan(odd).collect()} == {0} and licenses.scan(odd.limit(0)).count() == 0
    assert licenses.scan(df, [("short", "two words")]).filter("n_licenses > 0").count() == 0


def test_op3_many_full_templates(spark):
    """Three hundred templates of up to 400 words as a table, in whole, edited and marginal copies: equal to brute force over all stretches."""
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    templates = [(f"t{i:03}", rnd.choices(vocabulary, k=rnd.choice([5, 8, 12, 40, 150, 400]))) for i in range(300)]
    shingled = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    texts = []
    for _ in range(120):
        noise, (_, t) = rnd.choices(vocabulary, k=rnd.randrange(60)), rnd.choice(templates)
        t = list(t)
        for at in rnd.sample(range(len(t)), min(len(t), rnd.choice([0, 0, 1, 2, len(t) // 25, len(t) // 20]))):
            t[at] = "edited"
        if rnd.random() < 0.3:
            half = len(t) // 2
            t = t[half:] + t[:half]
        if rnd.random() < 0.3:
            t = t[: len(t) * rnd.choice([82, 85, 95]) // 100]
        texts.append(noise + t + rnd.choices(vocabulary, k=rnd.randrange(60)))
    sets = [(i, set(shingled(t)), len(t) - 4) for i, t in templates]
    want = {}
    for d, w in enumerate(texts):
        s = shingled(w)
        want[d] = [i for i, own, n in sets if own & set(s) and any(100 * len(own & set(s[at : at + n])) >= 80 * len(own) for at in range(len(s)))]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(texts)], "doc_id long, text string")
    known = spark.createDataFrame([(i, " ".join(t)) for i, t in templates] + [(None, "one two three four five"), ("none", None), ("short", "two words")], "id string, text string")
    found = licenses.scan(df, known)
    assert {r.doc_id: r.licenses for r in found.collect()} == want and sum(map(len, want.values())) > 60
    # the plan holds the templates as one literal: its expressions do not grow with them
    lambdas = lambda x: x._jdf.queryExecution().executedPlan().toString().count("lambdafunction(")
    assert lambdas(found) == lambdas(licenses.scan(df))


def test_op3_bands_keep_their_promise(spark):
    for r in licenses.index(spark.createDataFrame(licenses.TEMPLATES, "id string, text string")).collect():
        j = r.least / (2 * r.n - r.least)
        assert (1 - j) ** len(r["keys"]) <= licenses.MISS


def test_op3_template_bounds(spark, monkeypatch):
    df = spark.createDataFrame([(1, "Released under the MIT License"), (None, None)], "doc_id long, text string")
    assert licenses.scan(df, []).filter("n_licenses > 0").count() == 0
    twice = licenses.scan(df, [("MIT", "Released under the MIT License"), ("MIT", "released UNDER the mit license")])
    assert sorted(r.n_licenses for r in twice.collect()) == [0, 1]
    monkeypatch.setattr(licenses, "TEMPLATE_CHARACTERS", 10)
    with pytest.raises(ValueError):
        licenses.scan(df)


def test_op3_stays_in_the_engine(documents):
    plan = licenses.scan(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_op4_rules_by_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    for r in queries.op4_url_filter(spark, "/root/testdata/sf0.01").join(pages, "page_id").collect():
        rest = r.url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0].translate(LOWER)
        path = re.split(r"[?#]", rest[len(re.split(r"[/?#]", rest)[0]) :])[0]
        fits = [(h, p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda x: len(x[0] + x[1]), default=None)
        assert (r.host, r.path, r.rule) == (host, path, best and best[0] + best[1])
        if best:
            assert r.verdict == best[2]
        else:
            assert r.verdict == ("block" if re.search("cheap-pills|spam-farm|free-bets|adult-x|casino-win|ads-track", host) else "allow")


def test_op4_on_odd_urls(spark):
    df = spark.createDataFrame([(None,), ("",), ("no host",), ("HTTP://A.Example.COM/en/77?x",), ("https://net/de/x",), ("x://h#/de/",)], "url string")
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(df, queries.URL_RULES, None).collect()}
    assert got[None] == got[""] == ("", "", None, "allow") and got["no host"][:2] == ("", "")
    assert got["HTTP://A.Example.COM/en/77?x"] == ("a.example.com", "/en/77", "example.com/en/7", "allow") and got["https://net/de/x"][2] == "net/de/" and got["x://h#/de/"][:2] == ("h", "")
    assert urlfilter.fit(df.limit(0), "url", F.lit(True)) is None


def test_op4_scores_are_exact_on_many_ngrams(spark):
    """More different n-grams than 65,536, against the models by dictionaries."""
    draw = random.Random(4)
    urls = [(f"http://{''.join(draw.choices('abcdefghijklmnopqrstuvwxyz0123456789-', k=40))}.example/", i % 3 > 0) for i in range(2500)]
    df = spark.createDataFrame(urls, "url string, good boolean")
    got = {r.url: r.url_score for r in urlfilter.judge(df, [], urlfilter.fit(df, "url", F.col("good"))).collect()}
    grams, before = ({c: collections.Counter() for c in (True, False)} for _ in range(2))
    ends = lambda u: [(("\x02" * 4 + u)[i : i + 4], u[i]) for i in range(len(u))]
    for u, good in urls:
        for c, x in ends(u):
            for k in range(5):
                grams[good][c[4 - k :] + x] += 1
                before[good][k, c[4 - k :]] += 1
    assert len({c + x for u, _ in urls for c, x in ends(u)}) > 1 << 16
    for u, _ in urls[:100]:
        want = 0.0
        for c, x in ends(u):
            for good in (True, False):
                p = 1 / 256
                for k in range(5):
                    p = (grams[good][c[4 - k :] + x] + urlfilter.STRENGTH * p) / (before[good][k, c[4 - k :]] + urlfilter.STRENGTH)
                want += np.log(p) if good else -np.log(p)
        assert abs(got[u] - want / len(u)) < 1e-9


# ------------------------------------------------------------------ op5


def brute_classes(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted = collections.defaultdict(set)
    for i, s in sets.items():
        shared = collections.Counter(j for g in s for j in inverted[g])
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for g in s:
            inverted[g].add(i)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_op5_equals_brute_force(spark, documents, k, percent):
    random.seed(k)
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    base = " ".join(f"w{random.randrange(10**6)}" for _ in range(120)).split()
    for i in range(60):  # near copies of one text, some far enough from the first to need the second look
        words = list(base)
        for _ in range(random.choice([0, 1, 1, 2, 3])):
            words[random.randrange(len(words))] = f"edit{i}"
        rows.append((10_000 + i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(df, k, percent).collect()}
    assert got == brute_classes(rows, k, percent)


def test_op5_on_odd_rows(spark, odd):
    found = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(odd, 3, 90).collect()]
    got = sorted(x for x in found if x[0] is not None)
    assert len(found) == odd.count() and [x for x in found if x[0] is None] == [(None, 1, None)]
    assert [x for x in got if x[0] < 6] == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4), (5, 1, 4)] and {c for i, _, c in got if i in (6, 7)} == {6}
    assert jaccard.classes(odd.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7), (300, 200), (200, 300)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{100 + i: 100 for i in range(20)}, 200: 200, 300: 200}


# ------------------------------------------------------------------ op6


def brute_hits(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    patterns = collections.defaultdict(set)
    for i, t in items:
        w = word.findall((t or "").translate(LOWER))
        m = min(10, len(w))
        for j in range(len(w) - m + 1 if m else 0):
            patterns[tuple(w[j : j + m])].add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = word.findall((t or "").translate(LOWER)), set(), set()
        for m in {len(p) for p in patterns}:
            for j in range(len(w) - m + 1):
                if p := patterns.get(tuple(w[j : j + m])):
                    hit.update(range(j, j + m))
                    found |= p
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_op6_equals_brute_force(spark, documents, odd):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    items = [(r.item_id, r.text) for r in bench] + [(900, "of the"), (901, None), (902, ""), (903, "THE")]
    extra = [(5000, bench[0].text + " x " + bench[1].text), (5001, "of the of the THE"), (5002, " ".join(bench[2].text.split()[:9]))]
    docs = [(r.doc_id, r.text) for r in documents.collect()] + [(r.doc_id, r.text) for r in odd.collect()] + extra
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got), key=str) == brute_hits(docs, items)


def test_op6_in_blocks_and_empty(spark, documents, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = plain(decontaminate.contamination(documents.select("doc_id", "text"), bench).drop("text"))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 3000)
    assert len(decontaminate.blocks(bench)) > 1 and plain(decontaminate.contamination(documents.select("doc_id", "text"), bench).drop("text")) == whole
    assert decontaminate.contamination(documents, bench.limit(0)).filter("contaminated").count() == 0 and decontaminate.contamination(documents.limit(0), bench).count() == 0


# ------------------------------------------------------------------ op7


@pytest.mark.parametrize(("source", "want"), [
    ("<p>a<b>b</b>c<br>d<p>e &amp; &lt;f&gt; &nbsp; g", "abc d e & <f> g"),
    ('<body><nav>x</nav><main><article><header>h</header><h1>T</h1><p>one <a href="x">two</a>.</p><aside>no</aside><form>f</form><div class="comments"><p>c</p></div></article><article class="comment">z</article></main><footer>q</footer>', "T one two."),
    ('<div id="cookie-notice">n</div><div class="content"><p>yes<!-- no --> it</p><script>var a="<p>"</script></div>', "yes it"),
    ("<article><ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>1<td>2<tr><td>3</table></article>", "a b c 1 2 3"),
    ('<article>x<span class="ad">buy</span>y</article>', "xy"), ("", ""), ("a < b", "a < b"), ("<article><div>a<div>b</div>c</div>", "a b c"),
    # nothing else is dropped: a name counts only as a whole
    ('<article><div id="form-of-state"><p>body</p></div></article>', "body"),
    ('<article><p>one</p><section class="related-work"><p>two</p></section></article>', "one two"),
    # a teaser beside the text is not the article
    ('<body><article>Read this too</article><div class="text"><p>The text is much longer than its teaser.</p><p>It goes on.</p></div></body>', "The text is much longer than its teaser. It goes on."),
])
def test_op7_single_pages(source, want):
    assert wrapper.main_text(source, None) == want


def test_op7_simple_tree_matching_by_brute_force():
    """Scores against all matchings that keep the order of children; aligned pairs are such a matching."""
    draw = random.Random(8)

    def tree(depth):
        v = wrapper.View(draw.choice("abc"), False, [])
        v.children = [tree(depth - 1) for _ in range(draw.randrange(4))] if depth else []
        return v

    def brute(a, b):
        if a.label != b.label:
            return 0

        def lists(x, y):
            return max(lists(x[1:], y), lists(x, y[1:]), brute(x[0], y[0]) + lists(x[1:], y[1:]) if brute(x[0], y[0]) else 0) if x and y else 0

        return 1 + lists(a.children, b.children)

    for _ in range(150):
        a, b = tree(3), tree(3)
        b.label = a.label
        assert wrapper.Matcher().score(a, b) == brute(a, b) == len(wrapper.align(a, b))
    x, y = ([wrapper.View(c, True, []) for c in draw.choices("abc", k=400)] for _ in range(2))
    pairs = wrapper._by_place(x, y)
    assert pairs and all(p.label == q.label for p, q in pairs) and [y.index(q) for _, q in pairs] == sorted({y.index(q) for _, q in pairs})


def test_op7_trees_survive_packing_and_merging():
    pages = [wrapper.view_of(wrapper.parse(x)) for x in ("<body><div>a</div><p>x<p>y<ul><li>1</ul></body>", "<body><h1>t</h1><p>z<section><p>q</section><ul><li>1<li>2</ul></body>")]
    assert all(wrapper.packed(wrapper.unpacked(wrapper.packed(p))) == wrapper.packed(p) for p in pages)
    both = wrapper.unpacked(wrapper.packed(pages[0]))
    wrapper.merge(both, pages[1])
    assert all(len(wrapper.align(p, both)) == len(wrapper.number(p)) for p in pages)  # every node of either has its place


def _article(source):
    inner = re.sub(r"</?b>", "", re.search(r"<article>(.*?)</article>", source, re.S)[1])
    return " ".join(html.unescape(re.sub(r"<[^>]+>", " ", inner)).split())


def test_op7_on_test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in queries.op7_html_extraction(spark, SF).collect()}
    for p in pages.collect():
        want = _article(p.html)
        assert got[p.page_id] == (want, len(want))


def test_op7_needs_the_wrapper(spark):
    """The test pages without any telling element or class: the wrapper finds the articles; with an emptied wrapper, or a single page's own text, some are lost."""
    plain_names = lambda c: F.regexp_replace(F.regexp_replace(c, "<(/?)(?:article|nav|footer)\\b", "<$1div"), ' class="ad"', "")
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: _article(r.html) for r in pages.collect()}
    bare = pages.withColumn("html", plain_names(F.col("html")))
    wrappers = wrapper.induce(bare.select("page_id", "html", urlfilter.host_of(F.col("url")).alias("host")))
    got = {r.page_id: r.text for r in wrapper.extract(bare, wrappers=wrappers).collect()}
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)
    emptied = wrappers.withColumns({"region": F.array().cast("array<int>"), "template": F.array().cast("array<struct<node:int,text:bigint>>")})
    without = {r.page_id: r.text for r in wrapper.extract(bare, wrappers=emptied).collect()}
    assert sum(without[i] == want[i] for i in want) < sum(got[i] == want[i] for i in want)


def test_op7_templates_are_what_a_host_repeats(spark):
    page = "<body><div>Site name</div><div>Story {i} of today</div><div>All about us</div></body>"
    rows = [(i, f"http://h.example/{i}", page.format(i=i)) for i in range(30)] + [(100, "http://one.example/", "<p>x y</p>"), (101, None, None), (102, "http://h.example/", "")]
    rows += [(200 + i, f"http://neutral.example/{i}", f"<body><div class=a><div>Link {i % 7}</div><div>Way {i % 5}</div></div><div class=b><h2>Title {i}</h2><div><p>All of story {i} is told here at some length</p><p>{'and on ' * (i % 4)}</p></div></div><div class=c><div>Made in {i % 3}</div></div></body>") for i in range(30)]
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Story 3 of today" and got[100] == "x y" and got[101] == got[102] == ""
    assert got[206] == "Title 6 All of story 6 is told here at some length and on and on" and got[204] == "Title 4 All of story 4 is told here at some length"
    assert wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string").limit(0)).count() == 0


def test_op7_copies_of_an_article_are_no_template(spark):
    """Copies under other menus, exact and near ones, keep their text; what different articles share is still template."""
    page = "<body><div>Menu {i} of this page</div><article>{a}</article></body>"
    one, last = "<p>First words of it</p><p>More of the same</p>", "<p>Its last words</p>"
    rows = [(i, f"http://copies.example/{i}", page.format(i=i, a=one)) for i in range(25)]
    rows += [(100 + i, f"http://tail.example/{i}", page.format(i=i, a=one + last if i < 22 else f"<p>Other {i}</p>")) for i in range(60)]
    rows += [(200 + i, f"http://near.example/{i}", page.format(i=i, a=f"{one}<p>Seen {i} times</p>")) for i in range(25)]
    rows += [(300 + i, f"http://shared.example/{i}", page.format(i=i, a=f"<p>Send it on</p><p>All the different words of article {i} and no others</p>")) for i in range(25)]
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    whole = "First words of it More of the same"
    assert {got[i] for i in range(25)} == {whole} and {got[100 + i] for i in range(22)} == {f"{whole} Its last words"} and got[159] == "Other 59"
    assert got[207] == f"{whole} Seen 7 times" and got[307] == "All the different words of article 7 and no others"


def test_op7_long_pages_repeated_rows_and_further_columns(spark):
    long = "<article>" + "".join(f"<div><p>{i}</p><i>x</i></div><section>{i}</section>" for i in range(3000)) + "</article>"
    deep = "<div>" * 3000 + "deep down" + "</div>" * 3000
    rows = [(1, "http://l.example/1", long, "a", 5), (1, "http://l.example/1", long, "a", 5), (2, "http://l.example/2", long, "b", 6), (3, "http://l.example/3", deep, "c", 7)]
    got = wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, host int")).collect()
    assert len(got) == 4 and len({r.text for r in got if r.page_id < 3}) == 1 and got[0].n_chars == len(got[0].text)
    assert {r.text for r in got if r.page_id == 3} == {"deep down"}


# ------------------------------------------------------------------ op9


def test_op9_round_trip_of_hostile_text():
    random.seed(3)
    make = lambda: "".join(random.choice(["\\", "\n", "### ", "</turn>", "a", "###", "\n</turn>\n", "ü", "user"]) for _ in range(random.randrange(0, 8)))
    for _ in range(3000):
        turns = [(make(), make()) for _ in range(3)]
        out = [chat.render(*t) for t in turns]
        parser = chat.Parser()
        assert [x[:2] for x in parser.feed("".join(o[0] for o in out))] == turns and parser.done()
        assert all(chat.unescape(o[0][o[1] : o[2]]) == t[1] for o, t in zip(out, turns, strict=True))


def test_op9_digests(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    by = collections.defaultdict(list)
    for r in [*rows]:
        by[r.conv_id].append((r.turn, r.role, r.text))
    by[-7] = [(0, "user", queries.HARD_TEXT), (1, "assistant", queries.HARD_TEXT)]
    got = queries.op9_chat_formatting(spark, SF).collect()
    assert len(got) == len(by)
    for r in got:
        turns = sorted(by[r.conv_id])
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()


def test_op9_on_odd_rows(spark):
    rows = [(1, 1, "assistant", None), (1, 0, None, "x"), (1, 0, None, "x"), (None, None, "assistant", "y")]
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.read_back(chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert got == {1: (3, 0), None: (1, 1)}
    assert chat.read_back(chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


# ------------------------------------------------------------------ op10


def test_knapsack_and_cutting_stock():
    value, counts = packing.price(np.array([0.5, 0.34]), np.array([5, 3]), 11)
    assert abs(value - 1.18) < 1e-9 and counts.tolist() == [1, 2]
    demand, size = np.array([4, 30, 11]), np.array([7, 5, 3])
    patterns, use = packing.cutting_stock(demand, size, 16)
    assert np.allclose(patterns @ use, demand) and (size @ patterns <= 16).all() and use.sum() <= (demand @ size) / 16 * 1.2


def check_packing(pieces, ids, capacity=2048):
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
        assert p.doc_tokens == len(ids[p.doc_id]) and p.ids_crc32 == zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4"))
    for d, own in by_doc.items():
        ends = [0, *np.cumsum([p.length for p in sorted(own, key=lambda p: p.start)])]
        assert [p.start for p in sorted(own, key=lambda p: p.start)] == ends[:-1] and ends[-1] == len(ids[d])
    for own in by_seq.values():
        ends = [0, *np.cumsum([p.length for p in sorted(own, key=lambda p: p.offset)])]
        assert [p.offset for p in sorted(own, key=lambda p: p.offset)] == ends[:-1] and ends[-1] <= capacity
    assert set(by_doc) == set(ids)
    return sum(capacity - n for n in (sum(p.length for p in s) for s in by_seq.values()) if n & (n - 1))


def test_op10_places_every_id_once(spark, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    extra = [(5000, None), (5001, ""), (5002, "don't <|endoftext|>, ÉCOLE. x.,y 3.14 <|ENDOFTEXT|> \u0130stanbul \u00a0 a\u0301"), (5003, "Wort, " * 6000)]
    rows = [(r.doc_id, r.text) for r in documents.collect()] + extra
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for d, t in rows}
    pieces, encoded = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), queries.tokenizer_path())
    found = pieces.collect()
    padding = check_packing(found, ids)
    assert padding <= 0.01 * sum(map(len, ids.values()))
    sequences = {r.sequence_id: r.ids for r in packing.sequences(pieces, encoded).collect()}
    assert sum(map(len, sequences.values())) == sum(map(len, ids.values()))


def test_op10_on_few_and_no_rows(spark):
    one = spark.createDataFrame([(1, "a"), (1, "a")], "doc_id long, text string")
    assert sum(p.length for p in packing.pack(one, queries.tokenizer_path())[0].collect()) == 4
    assert packing.pack(one.limit(0), queries.tokenizer_path())[0].count() == 0


def test_op10_with_other_tokenizers(spark, documents, tmp_path):
    """One whose settings forbid the way by words, and one whose ids need 32 bits."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    large = Tokenizer(models.WordLevel({**{f"w{i}": i for i in range(70_000)}, "[UNK]": 70_000}, unk_token="[UNK]"))
    large.pre_tokenizer = pre_tokenizers.Whitespace()
    large.save(str(tmp_path / "large.json"))
    rows = [(r.doc_id, r.text) for r in documents.limit(60).collect()] + [(9001, "w69999 w3 " * 3000), (9002, None)]
    for path in (queries.tokenizer_path("byte_bpe_50k.json"), str(tmp_path / "large.json")):
        tokenizer = Tokenizer.from_file(path)
        ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for d, t in rows}
        pieces, encoded = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), path)
        check_packing(pieces.collect(), ids)
        assert sorted(x for r in packing.sequences(pieces, encoded).collect() for x in r.ids) == sorted(x for v in ids.values() for x in v)


def test_op1_long_texts_by_the_other_way(monkeypatch):
    """Beyond RANKED_WORDS common prefixes are counted in text order: the same results."""
    random.seed(6)
    for _ in range(40):
        docs = [[random.randrange(random.choice([1, 2, 3, 50])) for _ in range(random.randrange(0, 60))] for _ in range(4)]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in docs])]).astype(np.int64)
        code = np.array([y for x in docs for y in x], np.int64)
        want = repetition.longest_matches(code, offsets, 3).tolist()
        monkeypatch.setattr(repetition, "RANKED_WORDS", 1)
        assert repetition.longest_matches(code, offsets, 3).tolist() == want
        monkeypatch.undo()


def test_op8_learns_rare_languages_from_a_bounded_sample(spark):
    """A language of three rows among many of another is learnt; repeated ids do not fill the sample."""
    rows = [(i, f"the cat and the dog went to town number {i} with their friends", "en") for i in range(3000)] + [(None, "der hund und die katze gingen in die stadt", "de")] * 2000 + [(9000 + i, "kissa ja koira menivät kaupunkiin ystävien kanssa", "fi") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True), 300)
    assert model.languages == ["de", "en", "fi"]
    got = {r.text[:5]: r.lang_pred for r in langid.identify(docs, model).collect()}
    assert got == {"the c": "en", "der h": "de", "kissa": "fi"}


def test_op8_scores_by_brute_force(spark, documents):
    """A model's probabilities, from texts' n-grams counted in plain Python."""
    model = langid.fit(documents, F.lit(True), 200)
    known = langid.letter_table()
    for r in langid.identify(documents.limit(30), model).collect():
        letters = [int(known[ord(c)]) for c in r.text]
        total, n = np.zeros(len(model.languages)), 0
        for order in langid.ORDERS:
            for i in range(len(letters) - order + 1):
                part = letters[i : i + order]
                if any(part):
                    h = 0
                    for x in part:
                        h = (h * 0x9E3779B97F4A7C15 + x + order) % 2**64
                    h ^= h >> 29
                    f = (h * 0xBF58476D1CE4E5B9) % 2**64 >> (64 - 15)
                    total, n = total + model.weights[f] * model.idf[f] * langid.SCALE, n + 1
        if n:
            x = (total / n + model.bias) / model.temperature
            p = np.exp(x - x.max()) / np.exp(x - x.max()).sum()
            assert abs(p.max() - r.lang_score) < 1e-4 and model.languages[int(p.argmax())] == r.lang_pred


def test_op2_by_brute_force(spark, documents):
    """Statistics, class covariances and log densities of the labelled documents, one by one."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model, x = quality.learn(documents, labels.select("doc_id", "quality"))
    values = {r.doc_id: np.array(r.x) for r in x.collect()}
    by = {0: [], 1: []}
    for r in labels.collect():
        by[r.quality].append(values[r.doc_id])
    means = [np.mean(by[c], axis=0) for c in (0, 1)]
    scatter = [sum(np.outer(v - m, v - m) for v in by[c]) for c, m in zip((0, 1), means, strict=True)]
    n = sum(map(len, by.values()))
    pooled = sum(scatter) / (n - 2)
    spread = np.diag(pooled).clip(1e-9)
    pooled = pooled + np.diag(quality.FLOOR * spread)
    covs = [(1 - quality.POOLED - quality.DIAGONAL) * s / (len(by[c]) - 1) + quality.POOLED * pooled + quality.DIAGONAL * np.diag(np.diag(pooled)) + np.diag(quality.FLOOR * spread) for c, s in zip((0, 1), scatter, strict=True)]
    for r in quality.scored(x, model).collect():
        log = [np.log(len(by[c]) / n) - 0.5 * np.linalg.slogdet(covs[c])[1] - 0.5 * (values[r.doc_id] - means[c]) @ np.linalg.inv(covs[c]) @ (values[r.doc_id] - means[c]) for c in (0, 1)]
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(log[1] - log[0], -500, 500)))) < 1e-6
    text = "Ab! cd cd #x\nAb! cd cd #x\nzz"
    words = text.split()
    s = quality.statistics(__import__("pyarrow").array([text]))[0]
    want = [np.log1p(20 / (len(words) + 5)), np.log1p(20 / (len(words) + 5)), None, None, None, np.log1p(20 / (len(words) + 5)), np.log((4 + 8) / (len(words) + 8)), 1 / 6, np.log1p(len(words))]
    assert all(w is None or abs(a - w) < 1e-9 for a, w in zip(s, want, strict=True))


def test_op4_limit_holds_on_unseen_families(spark):
    """Hosts of one rejected family are taken out of training: the limit comes from unseen hosts and still tells most of the others."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    model = urlfilter.fit(pages, "url", urlfilter.seeded(F.col("url"), queries.URL_RULES))
    got = urlfilter.judge(pages, [], model).select("url", "verdict", urlfilter.seeded(F.col("url"), []).alias("good")).collect()
    assert sum((r.verdict == "allow") == r.good for r in got) >= 0.98 * len(got)


def test_op4_repeated_rows_clashing_names_and_long_urls(spark):
    rows = [("http://casino-win.example/a", 1)] * 3 + [(f"http://shop{i}.example/{'long/' * 30000}", 2) for i in range(3)] + [("http://shop.example/b", 3)]
    df = spark.createDataFrame([(u, n, "x", "y", 0.0) for u, n in rows], "url string, n int, verdict string, host string, url_score double")
    model = urlfilter.fit(df, "url", urlfilter.seeded(F.col("url"), []))
    got = urlfilter.judge(df, [], model).collect()
    assert len(got) == 7 and len({(r.verdict, r.url_score) for r in got if r.n == 1}) == 1 and {r.host for r in got if r.n == 3} == {"shop.example"}


def test_op9_long_texts_and_further_columns(spark):
    long = "### Assistant: </turn> \\ " * 20000
    df = spark.createDataFrame([(1, 0, "user", long, "x"), (1, 1, "assistant", long, "y"), (1, 2, "assistant", long, "y")], "conv_id long, turn long, role string, text string, formatted string")
    r = chat.read_back(chat.formatted(df)).first()
    assert r.n_turns == 3 and r.loss_chars == 2 * len(long) and r.loss_sha256 == hashlib.sha256((long + long).encode()).hexdigest()


def test_op10_ignores_further_columns(spark):
    df = spark.createDataFrame([(1, "a b c", 9, b"x", 7)], "doc_id long, text string, n int, ids binary, sequence_id int")
    assert [r.length for r in packing.pack(df, queries.tokenizer_path())[0].collect()] and packing.pack(df, queries.tokenizer_path())[0].columns == [x.split()[0] for x in packing.PIECES.split(", ")]

"""URL filter, BPE, HTML and packing."""

import hashlib
import html
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarn.llm import bpe, html_extract, packing, url_filter
from tests.oracle import compare

P = pytest.importorskip("public_tokenizers")
D = "/root/testdata/sf0.01"


def test_urls(spark):
    compare(spark, "op1", url_filter.op1_url_filter, url_filter.OP1_SQL, D)
    rows = [(1, "HTTP://A.Net/x"), (2, None), (3, "no scheme"), (4, "http://net"), (5, "http://xnet/"), (6, "http://www.example.net/en/a?b"), (7, "http://example.net/en"), (8, "ftp://example.com/de/#x"), (8, "ftp://example.com/de/#x"), (9, "x://y.org/fr/ü/\nz"), (10, "://")]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'clash' AS host", "'k' AS _keys", "'l' AS keys", "'m' AS found", "'o' AS row", "9 AS id")
    for bound in (url_filter.MAX_BITS, 1):
        out = url_filter.filter_urls(df, url_filter.RULES, bound=bound).collect()
        assert all((r._keys, r["keys"], r.found, r.row, r.id) == ("k", "l", "m", "o", 9) for r in out) and len(out) == len(rows)
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out}
        assert got[1] == ("a.net", "/x", "net/", "block") and got[2] == got[3] == got[10] == ("", "", None, "allow")
        assert got[4][2] is None and got[5][2] is None and got[6][2:] == ("example.net/en/", "allow") and got[7][2] == "net/"
        assert got[8][2:] == ("example.com/de/", "block") and got[9] == ("y.org", "/fr/ü/\nz", "org/fr/", "allow")
    assert url_filter.filter_urls(df, {}).where("rule is not null").count() == 0
    assert url_filter.filter_urls(df.limit(0), url_filter.RULES).count() == 0


def test_cascade(spark):
    """Exact over a universe with many false positives at each level."""
    every = spark.range(20000).selectExpr("xxhash64(id) AS h1", "xxhash64(id, 'second') AS h2", "id % 7 = 0 AS listed")
    c = url_filter.build(every.drop("listed"), every.where("listed").drop("listed"))
    rows = every.toPandas()
    assert (c.listed(rows.h1.to_numpy(), rows.h2.to_numpy()) == rows.listed.to_numpy()).all() and len(c.levels) > 2


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(path))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.codec(path, P.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab  \n\t'sltdmrev12.,!é你😀　\x1c"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=4))
def test_bpe_property(reference, texts):
    enc, codec = reference
    for t, ids in zip(texts, codec.encode_many(texts), strict=True):
        assert ids.tolist() == enc.encode_ordinary(t) and codec.decode(ids) == t.encode()


def thue_morse():
    """Pre-tokens that collide under every polynomial modulo 2^64."""
    return [(-100 - 2 * k - f, "".join("ab"[(i.bit_count() + f) % 2] for i in range(1024 << k)) + " end") for k in range(3) for f in range(2)]


def test_bpe(spark, reference):
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "x" * 30000), (-4, " " * 5000), *thue_morse()], "doc_id long, text string"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = bpe.encoded(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.array(reference[0].encode_ordinary(texts[r.doc_id]), dtype="<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_packing(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "word " * 9000), (-4, "a <|endoftext|> b"), *thue_morse()], "doc_id long, text string"))
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    want = {k: np.array([*e.ids, 1], dtype="<u4") for k, e in zip(texts, tok.encode_batch(list(texts.values()), add_special_tokens=False), strict=True)}
    out = packing.packed(docs, P.path("byte_bpe_50k.json")).toPandas()
    assert set(out.doc_id) == set(want)
    for k, g in out.sort_values("start").groupby("doc_id"):
        at = 0
        for r in g.itertuples():
            assert r.start == at and r.doc_tokens == len(want[k]) and r.ids_crc32 == zlib.crc32(want[k][at : at + r.length].tobytes())
            at += r.length
        assert at == len(want[k])
    padding = 0
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.cumsum(g.length.to_numpy()) - g.length.to_numpy()).all()
        size = int(g.length.sum())
        padding += 0 if size & (size - 1) == 0 else 2048 - size
        assert size <= 2048
    assert padding == 0
    assert packing.packed(docs.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_least_squares():
    h = {1000: 50, 1048: 50, 500: 30, 24: 30, 1524: 30}
    plan = packing.Plan(h)
    assert sum(n * len(c) for c, n in plan.chosen) >= 180  # all but a few pieces lie in full windows


def simple(page):
    body = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub(r"</?[a-zA-Z][^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body.replace("<br>", " "))]
    return "\n".join(x for x in parts if x)


def test_html(spark):
    pages = spark.read.parquet(f"{D}/pages.parquet")
    want = {r.page_id: simple(r.html) for r in pages.collect()}
    for r in html_extract.extract(pages).collect():
        assert r.text == want[r.page_id] and r.n_chars == len(r.text)


def test_html_template(spark):
    """A constant paragraph without any telling name is learnt from the host's pages and goes; others stay."""
    page = "<html><body><div class='x'><p>Welcome to our site</p></div><div><h1>T{0}</h1><p>Text &eacute; {0} <b>bold</b>\n more</p><ul><li>one {0}<li>two {0}</ul></div><div id='comments'><p>nice</p></div><aside>side</aside><form><p>name</p></form><footer>f</footer></body></html>"
    rows = [(i, f"http://h.example/{i}", page.format(i)) for i in range(12)] + [(50, None, None), (51, "http://z/", ""), (52, "http://z/", "<p>a<p>b &lt; c <script>var x='<p>'</script> d<!-- e"), (53, "http://deep/", "<div>" * 3000 + "deep"), (54, "http://q/", "<p title='a>b'>ok</p> 1 < 2 <a href=\"x>broken")]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"T{i}\nText é {i} bold more\none {i}\ntwo {i}" for i in range(12))
    assert got[50] == got[51] == "" and got[52] == "a\nb < c d" and got[53] == "deep" and got[54].startswith("ok\n1 < 2")


def test_html_copies(spark):
    """Copies of one article, of equal or of unlike pages, do not make a template of it."""
    page = "<html><head><meta name='n' content='{0}'></head><body><article><h1>Title</h1><p>All of the text.</p></article></body></html>"
    rows = [(i, "http://copies.example/a", page.format(0)) for i in range(10)] + [(20 + i, None, page.format(0)) for i in range(10)] + [(40 + i, "http://nonce.example/a", page.format(i)) for i in range(10)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 30 and set(got.values()) == {"Title\nAll of the text."}


def test_packing_works_in_parts(spark, monkeypatch):
    """However large a batch is, few texts are encoded and cut at once; places are the same."""
    docs = spark.createDataFrame([(i, None if i % 9 == 5 else f"word{i} " * (i * 7 % 400)) for i in range(120)], "doc_id long, text string").coalesce(1)
    path, encoded = P.path("byte_bpe_50k.json"), packing.encoded
    want = sorted(packing.packed(docs, path, with_ids=True).collect())

    def few(texts, path):
        assert sum(map(len, texts[:-1])) <= 4000
        return encoded(texts, path)

    monkeypatch.setattr(packing, "encoded", few)
    monkeypatch.setattr(packing, "PART", 4000, raising=False)
    assert sorted(packing.packed(docs, path, with_ids=True).collect()) == want


def test_packing_added_tokens(spark):
    """Strings of added tokens have their ids, as in the tokenizer's own default."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    mark = "<|endoftext|>"
    texts = [f"ab{mark}cd", mark, f"{mark}{mark} x  {mark}", f"a  {mark}\n\nb é", "plain  text", "<|endoftext|", "", f"{mark} word" * 3000]
    rows = packing.packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), P.path("byte_bpe_50k.json"), with_ids=True).collect()
    for i, t in enumerate(texts):
        got = b"".join(r.ids for r in sorted(rows, key=lambda r: r.start) if r.doc_id == i)
        assert np.frombuffer(got, dtype="<u4").tolist() == [*tok.encode(t, add_special_tokens=False).ids, 1], t


def test_html_reference(spark):
    """A notice is learnt whatever the page of smallest id is: missing, cut off, of another layout, or without the notice."""
    page = "<html><body><article><h1>T{0}</h1><p>Text {0}</p>{1}</article></body></html>"
    notice = "<div class='x'><p>Welcome to our site</p></div>"
    odd = {"null": None, "cut": "<html><bo", "blank": "<html><body></body></html>", "layout": "<html><body><table><tr><td>Other</td></tr></table></body></html>", "lacks": page.format(0, "")}
    rows = [(100 * k, f"http://{name}/", h) for k, (name, h) in enumerate(odd.items())]
    rows += [(100 * k + i, f"http://{name}/{i}", page.format(i, notice)) for k, name in enumerate(odd) for i in range(1, 13)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[100 * k + i] == f"T{i}\nText {i}" for k in range(len(odd)) for i in range(1, 13))
    assert got[0] == got[200] == "" and got[300] == "Other" and got[400] == "T0\nText 0"


def test_html_articles():
    """All outermost articles count, in page order; an empty one does not hide the main text."""
    read = lambda page: [t for part in html_extract.article(html_extract.parse(page)) for _, t in html_extract.blocks(part)]
    assert read("<body><p>around</p><div><article>one<article><p>inner</p></article></article></div><article class='ad'>ad</article><article><p>two, the largest of them</p></article></body>") == ["one", "inner", "two, the largest of them"]
    assert read("<body><article> </article><main><p>main</p></main><p>rest</p></body>") == ["main"]


def test_html_renamed(spark):
    """Pages without any telling tag or class extract as those that have them: the host's pages tell the region."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    some = [r for r in pages.collect() if r.url][::2]
    hosts = Counter(re.sub(r"^.*?://([^/?#]*).*", r"\1", r.url, flags=re.S).lower() for r in some)
    rows = [r for r in some if hosts[re.sub(r"^.*?://([^/?#]*).*", r"\1", r.url, flags=re.S).lower()] >= 12]
    assert len(rows) > 800

    def renamed(page):
        for old, new in (("article", "q1"), ("nav", "q2"), ("footer", "q3")):
            page = re.sub(rf"<{old}\b[^>]*>", f'<div class="{new}">', page).replace(f"</{old}>", "</div>")
        return page.replace('class="ad"', 'class="q4"')

    made = spark.createDataFrame([(r.page_id, r.url, renamed(r.html)) for r in rows], "page_id long, url string, html string")
    want = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame([(r.page_id, r.url, r.html) for r in rows], "page_id long, url string, html string")).collect()}
    got = {r.page_id: r.text for r in html_extract.extract(made).collect()}
    assert got == want and all(want[r.page_id] == simple(r.html) for r in rows)


def test_html_votes_decide(spark, monkeypatch):
    """A constant notice goes because of the votes: it stays when they cannot pass. Parts of articles with ambiguous names stay; depth does not matter."""
    deep = "<div>" * 80, "</div>" * 80
    page = "<html><body>" + deep[0] + "<article><h1>T{0}</h1><p class='q'>Constant words</p><section id='discussion'><p>Talk {0}</p></section><p class='related-work'>Work {0}</p></article>" + deep[1] + "</body></html>"
    df = spark.createDataFrame([(i, f"http://h.example/{i}", page.format(i)) for i in range(12)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert got == {i: f"T{i}\nTalk {i}\nWork {i}" for i in range(12)}
    monkeypatch.setattr(html_extract, "CONSTANT", 2)
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert got == {i: f"T{i}\nConstant words\nTalk {i}\nWork {i}" for i in range(12)}


def test_html_wide():
    """Many siblings, alternating and with one more in front or in the middle, take about linear time."""
    import time

    row = "<p>a</p><div>b</div>"
    for other in (row * 2500, "<h2>x</h2>" + row * 2500, row * 1200 + "<ul><li>y</ul>" + row * 1300):
        start = time.time()
        a, b = (html_extract.parse(f"<body>{x}</body>") for x in (row * 2500, other))
        assert len(html_extract.match(a, b)) >= 4900 and time.time() - start < 1
    a, b = (html_extract.parse("<body>" + x + "</body>") for x in ("<p>1</p><table><tr><td>x</table><p>2</p>", "<div><p>0</p></div><table><tr><td>x</table><h1>z</h1><p>2</p>"))
    assert {p.tag for p, _ in html_extract.match(a, b)} >= {"table", "tr", "td", "p"}


def test_html_alignment_is_exact():
    """Simple tree matching finds as many pairs as the table filled cell by cell, on any runs."""
    import random

    from tarn.llm import html_extract as h

    def best(a, b):
        ra, rb = h._runs(a), h._runs(b)
        start, end = h._ends([(r[0].label,) for r in ra], [(r[0].label,) for r in rb])
        worth = lambda u, v: sum(best(p, q) for p, q in zip(u, v, strict=False)) if u[0].label == v[0].label else 0
        sure = [*zip(ra[:start], rb[:start], strict=True), *zip(ra[len(ra) - end :], rb[len(rb) - end :], strict=True)]
        x, y = ra[start : len(ra) - end], rb[start : len(rb) - end]
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, u in enumerate(x):
            for j, v in enumerate(y):
                table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + worth(u, v))
        return 1 + sum(worth(u, v) for u, v in sure) + table[len(x)][len(y)]

    r = random.Random(1)
    tree = lambda d: "".join(f"<{t}>{tree(d - 1)}</{t}>" for t in [r.choice(["div", "p", "ul", "b", "i"]) for _ in range(r.randint(0, 6))]) if d else "x"
    for _ in range(100):
        a, b = h.parse(tree(3)), h.parse(tree(3))
        pairs = h.match(a, b)
        assert len(pairs) == best(a, b)
        assert len(pairs) == len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs})


def test_html_wide_patterns():
    """Pages of 5000 siblings that alternate with different periods are aligned exactly, in a second or so each."""
    import time

    from tarn.llm import html_extract as h

    page = lambda pattern: h.parse("".join(f"<div class={pattern[i % len(pattern)]}>t</div>" for i in range(5000)))
    for one, two, pairs in (("ab", "abc", 3335), ("aab", "abb", 3334), ("abcd", "dcba", 2500)):
        start = time.time()
        assert len(h.match(page(one), page(two))) == pairs and time.time() - start < 4


def test_html_names_within_the_content():
    """Part names and ids do not cut parts of an article; whole names do, and formulas and what follows an empty comment stay."""
    from tarn.llm import html_extract as h

    kept = ['<p class="share-price">a</p>', '<h2 id="comments-on-the-theorem">a</h2>', '<section id="notice-of-appeal">a</section>', '<section id="footer-design">a</section>', '<section id="cookies">a</section>', '<div class="modal-logic">a</div>', '<table class="menu-prices"><tr><td>a</td></tr></table>', "<p><math>a</math></p>", "<p><!-->a<!-- --></p>"]
    gone = ['<div class="ad">a</div>', '<div class="x comment-list">a</div>', '<div class="share-buttons">a</div>', '<div role="navigation">a</div>', "<nav>a</nav>", '<div class="newsletter-signup">a</div>']
    for part, text in [*[(k, "one\na") for k in kept], *[(g, "one") for g in gone]]:
        page = f'<html><body><div id="sidebar">side</div><article><p>one</p>{part}</article><div class="footer-links">f</div></body></html>'
        assert "\n".join(h.aligned(page, page)[2]) == text, part

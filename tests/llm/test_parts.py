"""Parts of the operators against brute force and round trips."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rillmark.llm import _shared, decontam, html_extract, pii, warc
from rillmark.llm._shared import components


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=0, max_size=60))
def test_fm_index(symbols):
    line = np.array(symbols, dtype=np.int64)
    index = decontam.FMIndex(line)
    whole = [*symbols, 0]
    assert decontam.suffix_order(np.array(whole)).tolist() == sorted(range(len(whole)), key=lambda i: whole[i:])
    for pattern in ([1], [2, 1], [1, 1, 2], [4, 3]):
        low, high = index.search(np.array([pattern[::-1]]))
        found = sorted(index.locate(np.arange(low[0], max(high[0], low[0]))).tolist())
        assert found == [i for i in range(len(symbols)) if symbols[i : i + len(pattern)] == pattern]


def test_cut_spans(spark):
    docs = spark.createDataFrame([(1, "A b, C d! tail"), (2, "none"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "b c D")], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontam.removed_spans(docs, items).collect()}
    assert got == {1: "A ! tail", 2: "none", 3: None}


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 10**12), st.data())
def test_permutation(n, data):
    p = pii.Permutation(b"key")
    value = data.draw(st.integers(0, n - 1))
    there = p(value, n, "t")
    assert 0 <= there < n and p(there, n, "t", undo=True) == value


def test_permutation_is_one_to_one():
    p = pii.Permutation(b"key")
    for n in (1, 2, 7, 100, 1000):
        assert sorted(p(i, n, "x") for i in range(n)) == list(range(n))


def test_pseudonyms():
    p, q = pii.Permutation(b"key"), pii.Permutation(b"other")
    text = "card 4111 1111 1111 1111, +1 (743) 555-3220, a.b.16@mail8.example.com, 18.72.200.134, 2020-02-29, 31.12.1999, 123-45-6789, GB82 WEST 1234 5698 7654 32"
    new, kinds = pii.replace_values(text, lambda k, v: pii.pseudonym(k, v, p))
    assert sorted(kinds) == ["card", "date", "date", "email", "iban", "ipv4", "phone", "ssn"]
    assert pii.replace_values(new, lambda k, v: pii.pseudonym(k, v, lambda *a: p(*a, undo=True)))[0] == text
    assert pii.replace_values(text, lambda k, v: pii.pseudonym(k, v, q))[0] != new
    same = pii.replace_values("4111-1111-1111-1111 and 4111111111111111", lambda k, v: pii.pseudonym(k, v, p))[0].replace("-", "").split(" and ")
    assert same[0] == same[1] and pii.luhn_digit(same[0][:-1]) == same[0][-1]
    for stays in ("4111 1111 1111 1112", "300.1.1.1", "2021-02-29", "666-12-1234", "GB83 WEST 1234 5698 7654 32", "v1.2.3.4"):
        assert pii.replace_values(stays, lambda k, v: pii.pseudonym(k, v, p)) == (stays, [])


def test_telephone_numbers_link():
    """However a number is written, its pseudonym has the same digits; the country code and the spelling stay."""
    p = pii.Permutation(b"key")
    one = lambda t: pii.replace_values(t, lambda k, v: pii.pseudonym(k, v, p))
    for spellings, code in ((("+44 20 7946 0958", "+442079460958", "+44 (20) 7946-0958", "+44.2079460958"), "44"), (("+1 743 555 3220", "(743) 555-3220", "+1(743) 555-3220", "+17435553220"), ""), (("+3581234", "+358 1234"), "358")):
        found = [one(x) for x in spellings]
        digits = [pii.re.sub(r"\D", "", t).removeprefix(code or "1" if t[0] == "+" else "") for t, _ in found]
        assert len(set(digits)) == 1 and all(k == ["phone"] for _, k in found)
        assert all(t.startswith("+" + code) for t, _ in found if t[0] == "+" and code) and digits[0] not in [pii.re.sub(r"\D", "", x) for x in spellings]
        assert [pii.re.sub(r"\d", "0", t) for t, _ in found] == [pii.re.sub(r"\d", "0", x) for x in spellings]
    assert one("+12345") == ("+12345", []) and one("tel +3581234.")[1] == ["phone"]


def test_pseudonyms_of_the_whole_table(spark, sf_dir):
    """Every replaced document differs from its text only in letters and digits, its values come back with the inverse, and equal values go to equal ones."""
    from rillmark.llm.queries import PII_KEY, QUERIES

    p = pii.Permutation(PII_KEY)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op1_pii_pseudonyms"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts) and sum(r.n_replaced for r in rows) > 20
    linked = {}
    for r in rows:
        values = []
        again, kinds = pii.replace_values(texts[r.doc_id], lambda k, v: values.append((k, v)) or pii.pseudonym(k, v, p))
        assert (again, len(kinds)) == (r.text, r.n_replaced)
        assert pii.replace_values(r.text, lambda k, v: pii.pseudonym(k, v, lambda *a: p(*a, undo=True)))[0] == texts[r.doc_id]
        for k, v in values:
            assert linked.setdefault((k, v), pii.pseudonym(k, v, p)) == pii.pseudonym(k, v, p)
    known = {k: x for k, x in linked.items() if x}
    assert len(known) == len({(k, x) for (k, _), x in known.items()})


def test_salvage():
    rng = random.Random(3)
    payloads = [bytes(rng.randrange(256) for _ in range(rng.randrange(2000))) for _ in range(12)]
    digest = lambda x: __import__("base64").b32encode(__import__("hashlib").sha1(x).digest()).decode()
    records = [warc.record_bytes(k, "http://h/", x, digest(x), "response", None) for k, x in enumerate(payloads)]
    for pack in (warc.member, bytes):
        members = [pack(r) for r in records]
        data = b"".join(members)
        assert [r["page_id"] for _, _, rows, _ in warc.salvage(data) for r in rows] == list(range(12))
        # A broken byte in the middle of record 5, and the last record cut short.
        at = sum(map(len, members[:5])) + len(members[5]) // 2
        broken = data[:at] + bytes([data[at] ^ 255]) + data[at + 1 : -40]
        got = list(warc.salvage(broken))
        assert [r["page_id"] for _, _, rows, _ in got for r in rows] == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10]
        assert sum(n for _, n, _, _ in got) == len(broken)
        assert [(a, n) for a, n, _, why in got if why] == [(sum(map(len, members[:5])), len(members[5])), (sum(map(len, members[:11])), len(members[11]) - 40)]


def test_headers_of_any_length(spark):
    """Urls beyond 64 KB come back from members and from plain records, and so do the pages of which they are copies."""
    digest = lambda x: __import__("base64").b32encode(__import__("hashlib").sha1(x).digest()).decode()
    urls = ["http://h/" + "u" * n for n in (10, 65_300, 100_000, 300_000)]
    for pack in (warc.member, bytes):
        data = b"".join(pack(warc.record_bytes(k, u, b"x" * k, digest(b"x" * k), "response", None)) for k, u in enumerate(urls))
        assert [(r["page_id"], r["url"]) for _, _, rows, why in warc.salvage(data) for r in rows if not why] == list(enumerate(urls))
    pages = spark.createDataFrame([(1, urls[2], "<p>x"), (2, "http://h/b", "<p>x"), (3, urls[3], "<p>y")], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert {k: (r.url, r.record_type, r.refers_to, r.gap) for k, r in got.items()} == {1: (urls[2], "response", None, False), 2: ("http://h/b", "revisit", 1, False), 3: (urls[3], "response", None, False)}


def test_archives_are_bounded_and_complete(spark, monkeypatch, tmp_path):
    """Files are begun by bytes; every record has what readers ask for, and ids of its own also where pages repeat."""
    monkeypatch.setattr(warc, "FILE_BYTES", 3000)
    rng = random.Random(4)
    html = ["".join(chr(rng.randrange(33, 1000)) for _ in range(700)) for _ in range(20)]
    pages = spark.createDataFrame([(k % 15, f"http://h/{k}", html[k % 18]) for k in range(40)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "w"))
    files = [f for f in (tmp_path / "w").rglob("part-*")]
    assert len(files) > 5 and max(f.stat().st_size for f in files) <= 3000
    records = b"".join(zlib.decompressobj(31).decompress(f.read_bytes()[a:]) for f in files for a, n, rows, _ in warc.salvage(f.read_bytes()) if rows)
    ids = pii.re.findall(rb"WARC-Record-ID: (\S+)", records)
    assert len(ids) == len(set(ids)) == 40 == records.count(b"WARC-Date: ")
    assert set(pii.re.findall(rb"WARC-Refers-To: (\S+)", records)) <= set(ids) and records.count(b"WARC-Profile: ") == records.count(b"WARC-Type: revisit") == 22


def test_reading_time_is_linear():
    """Twice the records of an archive do not take four times as long (with room for noise)."""
    import time

    def seconds(n):
        data = b"".join(warc.member(warc.record_bytes(k, "http://h/", b"", "", "revisit", None)) + b"" for k in range(n)) + bytes(random.Random(1).randbytes(4 << 20))
        began = time.perf_counter()
        assert sum(len(rows) for _, _, rows, _ in warc.salvage(data)) == n
        return time.perf_counter() - began

    assert min(seconds(4000) for _ in range(3)) < 8 * min(seconds(1000) for _ in range(3)) + 0.2


def test_member_ends_in_nul():
    for size in (0, 1, 255, 1 << 24):
        data = warc.member(b"x" * size)
        assert data[-1] == 0
        out, rest = b"", data
        while rest:
            d = zlib.decompressobj(31)
            out, rest = out + d.decompress(rest), d.unused_data
        assert out == b"x" * size


def test_page_parts():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>H</header><nav><ul><li><a href="/x">x</a></li></ul></nav><!-- ad -->
    <div class="cookie-notice">We use</div><div class="ad">Buy</div><article><h1>De &amp; T</h1><p><b>Als <i>er</i>&nbsp;n…<br><p>A  <b>b</b>
 c</p><div class="share-box">Share</div><aside>side</aside><section id="comments"><p>reader</p></section><p>x &lt; y 3<4 <span class="ad">buy</span> end</article><form>f</form><footer>&copy;</footer></body></html>"""
    assert html_extract.main_text(page, set()) == "De & T\nAls er n…\nA b c\nx < y 3<4 end"
    assert html_extract.main_text("<div><p>hello<p>world<ul><li>a<li>b</ul></div> tail", set()) == "hello\nworld\na\nb\ntail"
    assert html_extract.main_text("", set()) == ""


def test_names_of_noise():
    """A class counts as noise if all its parts are names of noise or of containers."""
    page = lambda name: html_extract.main_text(f"<article><p>kept</p><div class='{name}'>part</div></article>", set())
    for name in ("share-box", "comments", "ad", "cookie-notice", "related-posts", "comment-3", "site footer", "newsletter_signup"):
        assert page(name) == "kept", name
    for name in ("social-science", "notice-of-meeting", "comment-count-3", "has-sidebar", "adventure", "reply-to-all"):
        assert page(name) == "kept\npart", name
    assert html_extract.main_text("<div class='post comment-count-3'><p>x</p></div>", set()) == "x"
    assert html_extract.main_text("<form action='/'><p>all of the page</p><button>b</button></form>", set()) == "all of the page"


def test_odd_pages_take_linear_time():
    import time

    began = time.perf_counter()
    for page, want in (("<a " * 350_000, None), ('<a "' * 250_001 + ">x", "x"), ("<div>" * 100_000 + "deep", "deep"), ("<div>" * 50_000 + "x" + "</b2>" * 50_000, "x"), ("<script></script " * 60_000, "</script"), ("<!--" * 250_000, "")):
        text = html_extract.main_text(page, set())
        assert want is None or text == want
    elements, texts = html_extract.parse("<div>" * 100_000 + "deep " * 1000)
    says = html_extract._contents(texts, elements)
    assert len({says(e) for e in elements}) == 1
    assert time.perf_counter() - began < 30


def test_importance_by_brute_force(spark, sf_dir):
    """Entropies of every branch of every host, counted page by page."""
    import math
    from collections import Counter, defaultdict

    rows = [(r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    rows += [(f"http://made.example/{k}", f"<body><div class='x1'><p>Welcome</p></div><div class='x2'><p>Story {k}</p><p>{'more' * (k % 3)}</p></div></body>") for k in range(9)] * 2
    hosts = defaultdict(set)
    for url, html in rows:
        hosts[url.split("/")[2].lower()].add(html)
    want = {}
    for host, pages in hosts.items():
        looks, says, depth, on = defaultdict(Counter), defaultdict(Counter), Counter(), Counter()
        for k, html in enumerate(pages):
            elements, texts = html_extract.parse(html)
            for e in html_extract.branches(elements):
                inside = []
                for o, text, _ in texts:
                    while o is not None and o is not e:
                        o = o.parent
                    if o is e:
                        inside += text.split()
                looks[e.path][tuple(dict.fromkeys(c.path for c in e.children))] += 1
                says[e.path][tuple(inside)] += 1
                depth[e.path] = max(depth[e.path], e.depth)
            on.update({e.path for e in html_extract.branches(elements)})
        for node, n in on.items():
            total = sum(looks[node].values())
            entropy = lambda counts: -sum(c / total * math.log(c / total, total) for c in counts.values())
            w = html_extract.GAMMA ** depth[node]
            want[host, node] = 1.0 if n < html_extract.MIN_PAGES else (1 - w) * entropy(looks[node]) + w * entropy(says[node])
    got = {(r.host, r.node): r.importance for r in html_extract.node_importance(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert any(x < html_extract.THRESHOLD for x in want.values())


def test_texts_of_the_whole_table(spark, sf_dir):
    """Every page's text against a reader of another kind: the paragraphs and headings of the article, as the standard library's parser sees them."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.out = False, []

        def handle_starttag(self, tag, attrs):
            self.inside |= tag == "article"
            if self.inside and tag in ("article", "h1", "p", "ul", "li"):
                self.out.append("")
            elif self.inside and tag == "br":
                self.out[-1] += " "

        def handle_endtag(self, tag):
            self.inside &= tag != "article"
            if self.inside and tag in ("h1", "p", "ul", "li"):
                self.out.append("")

        def handle_data(self, data):
            if self.inside:
                self.out[-1] += data

    from rillmark.llm.queries import QUERIES

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = QUERIES["op4_main_text"](spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        reader = Article()
        reader.feed(pages[r.page_id])
        reader.close()
        want = "\n".join(x for x in (" ".join(b.split()) for b in reader.out) if x)
        assert (r.text, r.n_chars) == (want, len(want))


def test_site_tree(spark):
    """Without any tell-tale name, what is alike on all pages of a host goes, what differs stays."""
    pages = [(k, f"http://h/{k}", f"<body><div class='x1'><p>Welcome to us</p></div><div class='x2'><p>Story {k} about {k * 7}</p></div><div class='x3'>All rights</div></body>") for k in range(12)]
    pages += [(100, "http://alone/", "<body><div class='x1'><p>Welcome to us</p></div></body>")]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"Story {k} about {k * 7}" for k in range(12)) and got[100] == "Welcome to us"


def test_site_tree_without_lists(spark):
    """With the lists switched off the tree alone takes what a site repeats, also inside an article."""
    pages = [(k, f"http://h/{k}", f"<body><nav><a href=/>Home</a></nav><article><h1>T{k}</h1><div class='box'>Subscribe today</div><p>Story {k}</p></article><footer>Imprint</footer></body>") for k in range(8)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string"), lists=False).collect()}
    assert all(got[k] == f"T{k}\nStory {k}" for k in range(8))


def test_site_of_copies(spark):
    """A page that many rows repeat counts once: it does not make the texts of its host look like boilerplate."""
    page = lambda k, wrap: f"<body><div class='x1'><p>Welcome to us</p></div>{wrap[0]}<div class='x2'><p>Story {k} about {k * 7}</p></div>{wrap[1]}</body>"
    plain, article = ("", ""), ("<article>", "</article>")
    pages = [(k, "http://plain/", page(max(k - 180, 0), plain)) for k in range(200)] + [(1000 + k, "http://article/", page(max(k - 180, 0), article)) for k in range(200)]
    pages += [(2000 + k, "http://same/", page(1, plain)) for k in range(9)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for k in range(200):
        assert got[k] == got[1000 + k] == f"Story {max(k - 180, 0)} about {max(k - 180, 0) * 7}"
    assert all(got[2000 + k] == "Welcome to us\nStory 1 about 7" for k in range(9))


@pytest.mark.parametrize("edges_a_part", [100_000, 20])
def test_components(spark, monkeypatch, edges_a_part):
    monkeypatch.setattr(_shared, "EDGES", edges_a_part)
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(0, k) for k in range(400, 450)] + [(k, k + 1) for k in range(500, 560)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in linked}


def brute_components(docs, n=5, percent=75):
    """doc_id -> smallest doc_id reachable, by comparing all pairs; rows with the same doc_id are one node."""
    ids = sorted({k for k, _ in docs})
    parent = {k: k for k in ids}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    vocabulary, sets = {}, []
    for k, t in docs:
        w = t.split()
        sets.append((k, {vocabulary.setdefault(x, len(vocabulary)) for x in ([tuple(w[i : i + n]) for i in range(len(w) - n + 1)] or [tuple(w)])}))
    m = np.zeros((len(sets), len(vocabulary)), dtype=np.float32)
    for i, (_, x) in enumerate(sets):
        m[i, list(x)] = 1
    size = m.sum(axis=1)
    for at in range(0, len(sets), 500):
        both = m[at : at + 500] @ m.T
        for i, j in zip(*np.nonzero(100 * both >= percent * (size[at : at + 500, None] + size[None, :] - both)), strict=True):
            x, y = sorted((root(sets[at + i][0]), root(sets[j][0])))
            parent[y] = x
    return {k: root(k) for k in ids}


def near(spark, docs):
    from rillmark.llm.minhash import near_duplicates

    return {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}


def edited(rng, k, base, edits):
    words = list(base)
    for _ in range(edits):
        words[rng.randrange(len(base))] = f"e{rng.randrange(40)}"
    return k, " ".join(words)


def test_near_duplicates_write_few_files(spark, monkeypatch):
    """Each local file that is written starts child processes, so their number follows the bytes and not the number of shuffle partitions."""
    from pathlib import Path

    from rillmark.llm import minhash

    rng, texts = random.Random(31), []
    for _ in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(80)]
        texts += [" ".join(words), " ".join([*words[:-1], "x"])]
    files, keep = {}, _shared.Scratch.keep

    def counted(self, df):
        out = keep(self, df)
        path = self.paths[id(out)][1]
        files[path] = len(list(Path(path.removeprefix("file:")).glob("part-*")))
        return out

    monkeypatch.setattr(_shared.Scratch, "keep", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        found = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found == {i: i - i % 2 for i in range(len(texts))}
    assert max(files.values()) <= 4, files


def test_near_copies_in_a_large_family(spark, monkeypatch):
    """A family whose members are often too far from each other is joined through others, in one block or in many; all is held against brute force."""
    from rillmark.llm import minhash

    rng = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    docs = [edited(rng, k, base, rng.randrange(0, 5)) for k in range(250)]
    for block in (None, 20, 7):
        if block:
            monkeypatch.setattr(minhash, "BLOCK", block)
        assert near(spark, docs) == brute_components(docs)
    assert len(set(near(spark, docs).values())) > 1


def test_three_thousand_near_copies(spark):
    """One family of 3,000 near copies of 120 words, with strays, against brute force."""
    rng = random.Random(6)
    base = [f"w{k}" for k in range(120)]
    docs = [edited(rng, k, base, rng.choice((1, 2, 3, 4, 5, 7))) for k in range(3000)]
    assert near(spark, docs) == brute_components(docs)


def test_rows_with_one_doc_id_and_different_texts(spark):
    """Each text of a document links, whichever of them names a class."""
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    docs = [(1, a), (1, b), (2, a + " tail"), (3, b + " tail"), (5, b), (4, a + " more"), (4, "x y z"), (4, a + " more"), (7, "x y z")]
    assert near(spark, docs) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 1} == brute_components(docs)


def test_common_counts_of_sets():
    """Frequent and rare values, on both sides, as sets would count them."""
    from rillmark.llm.minhash import _common

    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(40)]
    for left, right in ((sets, sets), (sets[:3], sets[3:]), (sets[:30], sets[30:32])):
        assert _common(left, right).tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in right] for x in left]


def test_features_cover_whole_texts():
    from rillmark.llm.quality_mil import PASSAGE, passage_features

    x, first = passage_features(pa.array(["a b c", None, "", "w " * (PASSAGE * 3 + 1)]))
    assert np.diff(first).tolist() == [1, 1, 1, 4]
    one, _ = passage_features(pa.array(["w " * (PASSAGE * 3 + 1)]))
    assert np.allclose(one, x[3:])


def test_links_of_repeated_vectors(spark):
    """Rows of equal vectors count each for the links of others; those that share vec_id and vector don't count for each other; doubles stay doubles; labels are kept apart."""
    from rillmark.llm.embed_dedup import near_vectors

    near = [1.0, 0.1]
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, near, 1), (5, [0.0, 1.0], 1), (5, [1.0, 0.0], 2), (6, [1.0, 0.0], 2), (7, [0.0, 1.0], 2)]
    for kind in ("float", "double"):
        got = sorted((r.vec_id, r.n_links, r.component_id) for r in near_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")).collect())
        assert got == [(1, 4, 1), (2, 4, 1), (3, 3, 1), (3, 3, 1), (4, 4, 1), (5, 0, 5), (5, 1, 5), (6, 1, 5), (7, 0, 7)]
    eps = 1e-9  # only doubles tell these two from a cosine of 0.98
    at = lambda c: [c, (1 - c * c) ** 0.5]
    rows = [(1, [1.0, 0.0], 1), (2, at(0.98 + eps), 1), (3, [0.0, 0.0], 1), (4, at(0.98 - eps), 2), (5, [1.0, 0.0], 2)]
    got = {r.vec_id: r.n_links for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0}


def test_gradients_and_scores_by_brute_force():
    """The model's scores bag by bag from the formulas, and its gradients against differences of the loss."""
    from rillmark.llm import quality_mil as q

    rng = np.random.default_rng(3)
    sizes = [1, 3, 2, 5]
    first, y = np.concatenate([[0], np.cumsum(sizes)]), np.array([0.0, 1.0, 1.0, 0.0])
    x = rng.standard_normal((first[-1], q.N_FEATURES))
    model = q.AttentionModel(rng, x.mean(axis=0), 1 / (x.std(axis=0) + 0.05))
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def brute():
        p, out = model.weights, []
        for a, b in zip(first[:-1], first[1:], strict=True):
            h = [np.tanh(((row - model.mean) * model.scale) @ p["W"] + p["B"]) for row in x[a:b]]
            e = [np.exp(p["w"] @ (np.tanh(v @ p["V"]) * sigmoid(v @ p["U"]))) for v in h]
            out.append(sigmoid(p["c"] @ sum(k / sum(e) * v for k, v in zip(e, h, strict=True)) + p["b"][0]))
        return np.array(out)

    f = model.forward(x, first)
    assert np.allclose(f["score"], brute())
    loss = lambda: -np.mean(y * np.log(brute()) + (1 - y) * np.log(1 - brute()))
    for name, grad in model.gradients(f, first, y).items():
        flat = model.weights[name].reshape(-1)
        for i in rng.choice(len(flat), min(6, len(flat)), replace=False):
            kept, step = flat[i], 1e-5
            flat[i] = kept + step
            up = loss()
            flat[i] = kept - step
            down = loss()
            flat[i] = kept
            assert abs((up - down) / (2 * step) - grad.reshape(-1)[i]) < 1e-6, name


def test_a_benchmark_of_many_blocks(spark, monkeypatch):
    """Block by block the benchmark gives what it gives as one, and the driver never asks for two blocks at once."""
    docs = spark.createDataFrame([(k, f"pre {' '.join(f'b{k % 7}x{j}' for j in range(15))} post") for k in range(20)] + [(99, None)], "doc_id long, text string")
    items = spark.createDataFrame([(k, " ".join(f"b{k}x{j}" for j in range(15))) for k in range(7)] + [(7, None), (8, "pre")], "item_id long, text string")
    view = lambda: sorted((r.doc_id, r.n_words, [list(x) for x in r.spans], list(r.items)) for r in decontam.mark(docs, items).collect())
    one = view()
    monkeypatch.setattr(decontam, "PHRASE_BYTES", 100)
    assert view() == one and one[0][3] == ["0", "8"]
    assert decontam.mark(docs, items.limit(0)).where("size(items) > 0").count() == 0


def test_mixed_rows_are_dealt_by_shard(spark, sf_dir):
    """mix_documents has each document as often as the plan takes it, in the plan's shards, shuffled inside them."""
    from collections import Counter

    from rillmark.llm.mixing import mix_documents, mix_plan

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = {r.doc_id: r for r in mix_plan(docs).collect()}
    rows = [(r.doc_id, r.part) for r in mix_documents(docs).withColumn("part", __import__("pyspark").sql.functions.spark_partition_id()).collect()]
    taken = Counter(k for k, _ in rows)
    assert all(taken[k] * r["size"] == r.taken for k, r in plan.items()) and set(taken) <= set(plan)
    shards = {}
    for k, part in rows:
        shards.setdefault(part, []).append({plan[k].shard_1, plan[k].shard_2} - {None})
    for own in shards.values():  # inside a partition the shards come one after another
        at = 0
        for choices in own:
            later = [s for s in choices if s >= at]
            assert later
            at = min(later)
    order = [k for k, _ in rows]
    assert order != sorted(order) and sum(a == b for a, b in zip(order, order[1:])) < len(order) / 10


def test_dense_label_against_brute_force(spark, monkeypatch):
    """Vectors at cosine 0.95 to each other, with planted pairs and copies: no link is lost, in one cell or in many."""
    from rillmark.llm import embed_dedup

    rng = np.random.default_rng(11)
    centre, noise = rng.standard_normal(64) / 8, rng.standard_normal((6000, 64)) / 8
    x = centre + 0.23 * noise
    x[3000:] = x[:3000] + 0.195 * noise[3000:]
    x = np.concatenate([x, x[:40], x[:40]]).astype(np.float32)
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    np.fill_diagonal(near, False)
    parent = list(range(len(x)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in zip(*np.nonzero(near), strict=True):
        p, q = sorted((root(int(a)), root(int(b))))
        parent[q] = p
    want = {k: (int(near[k].sum()), root(k)) for k in range(len(x))}
    vectors = spark.createDataFrame([(k, v, 1) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int")
    for cell in (None, 300):
        if cell:
            monkeypatch.setattr(embed_dedup, "CELL", cell)
        assert {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_vectors(vectors).collect()} == want


def test_training_reads_whole_texts(spark, monkeypatch):
    """All passages of a labelled text teach, and labels without a document take no place."""
    from rillmark.llm import quality_mil

    ids = [k for k in range(60) if zlib.crc32(str(k).encode()) % 5]
    docs = spark.createDataFrame([(k, "w " * (128 * (70 + k))) for k in ids[:6]], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in ids], "doc_id long, quality int")
    taught = []
    monkeypatch.setattr(quality_mil, "train", lambda bags, y: taught.append(sorted(map(len, bags))) or 0.5)
    monkeypatch.setattr(quality_mil, "MAX_DOCS", 6)
    quality_mil.fit(docs, labels)
    assert taught == [[70 + k for k in ids[:6]]]
    monkeypatch.setattr(quality_mil, "MAX_PASSAGES", 200)
    quality_mil.fit(docs, labels)
    assert 1 <= len(taught[1]) <= 2 and set(taught[1]) <= set(taught[0])

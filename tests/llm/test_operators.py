"""The ten operators against brute force, with nulls, empty tables, long texts, ties, repeats and clashing names."""

import base64
import hashlib
import itertools
import math
import random
import re
import textwrap
import time
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import documents, prose, texts
from vigilspark.llm import bpe, fingerprints, html_text, licenses, mixing, ngram_jaccard, quality, shared, suffix_dedup, token_counts, warc
from vigilspark.llm.blocks import Block
from vigilspark.llm.shared import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def empty(spark):
    return documents(spark).limit(0)


# 1. HTML extraction

PAGE = """<html><head><title>t</title></head><body class="no-sidebar"><header>Site</header><nav><a href=/>Home</a></nav><div class="cookie-notice">We use many cookies and this notice is a long one.</div>
<div id="content"><h1>Title</h1><p>First paragraph with a <a href="#">link</a>, long enough to be dense, and more of it.</p><ul><li>one</li><li>two</li></ul><p>Fish &amp; chips<br>again &lt;b&gt;</p></div>
<div class="ad">Buy this now</div><section id="comments"><p>A reader says a lot of things here, at length, and then some more.</p></section><form>Sign up</form><footer>(c)</footer><script>var x = "</p>";</script></body></html>"""


def test_html_main_text():
    assert html_text.main_text(PAGE) == "Title First paragraph with a link, long enough to be dense, and more of it. one two Fish & chips again <b>"
    assert [html_text.main_text(x) for x in (None, "", "plain", "<p>x", "<b>a</b>b", "<script>no", "<!-- no")] == ["", "", "plain", "x", "ab", "", ""]


def test_html_density_prefers_text_over_links():
    links = "".join(f"<li><a href=/{i}>link number {i} with words</a></li>" for i in range(40))
    assert html_text.main_text(f"<body><div><ul>{links}</ul></div><div><p>{'word ' * 60}</p><p>{'more ' * 50}</p></div></body>") == " ".join(["word"] * 60 + ["more"] * 50)


@pytest.mark.parametrize("wrapper", ["div class='content has-sidebar'", "div class=no-sidebar", "div id=page-with-nav", "div class=cookie-banner-ready", "form id=aspnetForm action=/"])
def test_html_wrappers_keep_their_page(wrapper):
    inner = f"<p>{'word ' * 60}</p><p>{'more ' * 50}</p><input value=x>"
    text = " ".join(["word"] * 60 + ["more"] * 50)
    close = f"</{wrapper.split()[0]}>"
    for body in (inner, f"<div>{inner}</div><div class=ad>Buy this</div>", f"<nav><a href=/>x</a></nav><article>{inner}</article>"):
        assert html_text.main_text(f"<body><{wrapper}>{body}{close}</body>") == text
    assert html_text.main_text(f"<body><{wrapper}>{close}<div class=sidebar>only this</div></body>") == "only this"


def test_html_articles_keep_their_parts():
    parts = "<section id=discussion><p>We discuss it.</p></section><p class=notice>Mind this.</p><div class=related-work><p>Others did so.</p></div>"
    page = f"<body><article><p>{'word ' * 60}</p>{parts}<div class=related-posts><p>Read more</p></div><div class=ad>Buy</div></article><ol id=comments><article class=comment-body><p>{'no ' * 200}</p></article></ol></body>"
    assert html_text.main_text(page) == "word " * 60 + "We discuss it. Mind this. Others did so."


ADVERTS_AND_COMMENTS = [
    '<div class="google-ad-slot"><p>Buy this now</p></div>', '<ins class="adsbygoogle">Buy this now</ins>', '<div class="outbrain"><a href=1>one</a> <a href=2>two</a></div>',
    '<div id="responses"><p>A reader says so, at some length.</p></div>', '<div class="user-thread"><p>A reader says so, at some length.</p></div>',
    '<div class="kommentare"><p>Ein Leser schreibt hier etwas mehr.</p></div>', '<div role="status">We use cookies on this site.</div>', '<div class="anzeige">Jetzt kaufen, bitte.</div>',
    '<section class="réactions"><p>Un lecteur écrit ceci, longuement.</p></section>', '<div class="publicidad">Compre esto ahora.</div>',
]


@pytest.mark.parametrize("extra", ADVERTS_AND_COMMENTS)
def test_html_adverts_and_comments_in_and_beside_articles(extra):
    article = f"<p>{'word ' * 60}</p><p>{'more ' * 50}</p>"
    text = " ".join(["word"] * 60 + ["more"] * 50)
    assert html_text.main_text(f"<body><article>{article}{extra}</article></body>") == text
    assert html_text.main_text(f"<body><article>{article}</article>{extra}</body>") == text
    assert html_text.main_text(f"<body><div class=content>{article}{extra}</div></body>") == text


def test_html_side_columns_and_names_that_only_look_alike():
    article = f"<p>{'word ' * 60}</p><p>{'more ' * 50}</p>"
    text = " ".join(["word"] * 60 + ["more"] * 50)
    for rail in ("<div class=rail><p>Short lines of a rail.</p><p>And more of them.</p></div>", "<div class=extra><p>Short lines here.</p><p>And more of them.</p></div>"):
        assert html_text.main_text(f"<body><div><article>{article}</article>{rail}</div></body>") == text
    for name in ("adsorption-study", "reading", "threads-of-silk", "shadow"):
        assert html_text.main_text(f"<body><article>{article}<div class='{name}'><p>It stays.</p></div></article></body>") == text + " It stays."


class _Slow(HTMLParser):
    """The page as nested lists [tag, children...]; texts are strings."""

    def __init__(self, page):
        super().__init__()
        self.root = ["html"]
        self.open = [self.root]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.open[-1].append([tag])
        self.open.append(self.open[-1][-1])

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        self.open[-1].append(data)


def slow_main_text(page):
    """The definition, node by node, counting anew for each."""
    root = _Slow(page).root
    nodes, up = [], {}

    def walk(node):
        nodes.append(node)
        for child in node[1:]:
            if isinstance(child, list):
                up[id(child)] = node
                walk(child)
    walk(root)
    below = lambda node: [x for c in node[1:] if isinstance(c, list) for x in (c, *below(c))]
    size = lambda node, linked: sum(len("".join(c.split())) * linked if isinstance(c, str) else size(c, linked or c[0] == "a") for c in node[1:])
    in_link = lambda node: node[0] == "a" or id(node) in up and in_link(up[id(node)])
    share = size(root, False) / size(root, True) if size(root, True) else 0

    def density(node):
        c = size(node, True)
        if not c:
            return 0.0
        links, t, lt = size(node, in_link(node)), max(len(below(node)), 1), max(sum(x[0] == "a" for x in below(node)), 1)
        lc = max(links, 1)
        base = math.log(c / max(c - links, 1) * lc + share * c + math.e)
        return max(c / t * max(math.log(max(c / lc * t / lt, 1.0)) / math.log(base), 0.0), 1e-9)
    kids = lambda node: [c for c in node[1:] if isinstance(c, list)]
    value = lambda node: sum(map(density, kids(node))) if kids(node) else density(node)
    best = lambda node: max([node, *below(node)], key=value)  # noqa: E731  the first of equals: outer, then earlier
    body = next(x for x in nodes if x[0] == "body")
    at, threshold = best(body), density(best(body))
    while at is not body:
        at = up[id(at)]
        threshold = min(threshold, density(at))
    chosen = set()

    def select(node):
        if density(node) >= threshold and density(node) > 0:
            chosen.add(id(best(node)))
            if best(node) is node:
                return
        for child in kids(node):
            if id(child) not in chosen:
                select(child)
    select(body)
    out = [""]

    def render(node, taken):
        taken = taken or id(node) in chosen
        edge = node[0] not in html_text.INLINE
        out.extend([""] * edge)
        for child in node[1:]:
            if isinstance(child, list):
                render(child, taken)
            elif taken:
                out[-1] += child
        out.extend([""] * edge)
    render(root, False)
    return " ".join(" ".join(x.split()) for x in out if x.split())


def test_html_density_against_its_definition():
    r = random.Random(12)

    def block(depth):
        kind = r.choice(("p", "p", "div", "ul", "links", "span"))
        if depth and kind == "div":
            return "<div>" + "".join(block(depth - 1) for _ in range(r.randrange(5))) + "</div>"
        words = " ".join(r.choice(("word", "and", "longer", "x")) for _ in range(r.choice((1, 4, 30, 90))))
        if kind == "links":
            return "<div>" + "".join(f"<a>{words[:30]}</a> " for _ in range(r.randrange(1, 6))) + "</div>"
        if kind == "ul":
            return "<ul>" + "".join(f"<li>{words[:20]}{r.choice(('', '<b>bold</b>', '<a>link</a>'))}</li>" for _ in range(4)) + "</ul>"
        return f"<{kind}>{words}{r.choice(('', '<a>some link</a>', '<i>it</i>'))} end</{kind}>".replace("<div", "<section").replace("</div", "</section")
    for _ in range(250):
        page = "<html><body>" + "".join(block(3) for _ in range(r.randrange(1, 6))) + "</body></html>"
        assert html_text.main_text(page) == slow_main_text(page.removeprefix("<html>").removesuffix("</html>")), page


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "x", "<a " * 100_000, "<span><p>x" * 25_000, "<li><ul>" + "<div>" * 20_000 + "<li>x</li>" * 20_000, "<b>" * 20_000 + "<div>" + "<i>" * 20_000 + "</b>" * 20_000, "<![CDATA[" * 50_000 + ">", "<script>" + "</script" * 50_000])
def test_html_time_is_in_proportion(page):
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 3


def test_html_link_lists_and_comments_in_articles():
    text = " ".join(["word"] * 90)
    links = "".join(f"<li><a href=/{i}>another story number {i}</a></li>" for i in range(6))
    page = f"<body><article><p>{text}</p><div class=side-col><ul>{links}</ul></div><p>See <a>this</a>.</p></article><div class=commentlist><p>{'reader says ' * 60}</p></div></body>"
    assert html_text.main_text(page) == text + " See this."
    assert html_text.main_text(f"<body><article><ul>{links}</ul></article></body>").startswith("another story number 0")


def test_html_query_shape(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    got = html_text.extract(df).collect()
    assert [r["n_chars"] for r in got] == [len(html_text.main_text(PAGE))] * 2 + [0] and got[0]["text"] == "x" and got[0]["text_"].startswith("Title")
    assert html_text.extract(df.limit(0)).count() == 0


# 2. fingerprints

def test_fingerprints(spark):
    got = fingerprints.fingerprint(documents(spark)).collect()
    order = sorted(texts(), key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = Counter()
    for (d, t), (_, o) in zip(order, order[1:] + order[:1]):
        t, o = t or "", o or ""
        half = len(t) // 2
        want[d, len(t), hashlib.sha256((t[:len(t) - half] + o[:half]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    by = {r["doc_id"]: r for r in got}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] != "" and by[2]["near_next"] == 1.0 and by[5]["fingerprint"] == ""
    assert by[3]["near_next"] > 0.9  # one word differs
    assert 0.3 < by[13]["near_edited"] < 0.7 and by[13]["near_next"] < 0.2
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    assert fingerprints.fingerprint(empty(spark)).count() == 0
    one = fingerprints.fingerprint(documents(spark).where("doc_id = 13")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0 > one[0]["near_edited"] > 0.3


def test_fingerprints_of_extreme_and_hot_ids(spark):
    ends = [(-(1 << 63), prose(1, 40)), ((1 << 63) - 1, prose(2, 40)), (0, prose(3, 40)), (None, prose(4, 40))]
    rows = ends + [(7, prose(100 + i, 12)) for i in range(200)] + [(None, prose(300 + i, 12)) for i in range(100)] + [(7, prose(100, 12))] * 3
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.sha256(r[1].encode()).hexdigest()))
    want = Counter()
    for (d, t), (_, o) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        want[d, hashlib.sha256((t[:len(t) - half] + o[:half]).encode()).hexdigest()] += 1
    got = fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in got.collect()) == want


def test_fingerprints_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "_REPEAT", 50)
    rows = [(7, prose(1, 20))] * 400 + [(None, "")] * 120 + [(None, None)] * 90 + [(i, prose(i, 12)) for i in range(40)] + [(7, prose(2, 20))] * 3
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    want = Counter()
    for (d, t), (_, o) in zip(order, order[1:] + order[:1]):
        t, half = t or "", len(t or "") // 2
        want[d, hashlib.sha256((t[:len(t) - half] + (o or "")[:half]).encode()).hexdigest(), (o or "") == t] += 1
    got = fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert Counter((r["doc_id"], r["edited_sha256"], r["near_next"] == 1.0) for r in got.collect()) == want


def _slow_features(text, rarity):
    """Selected windows of a text in order of place, by the definition."""
    n, w = len(text), fingerprints.WINDOW
    if n < 4 * w:
        found = [text] if 0 < n < fingerprints.SHORT_WINDOW else [text[i:i + fingerprints.SHORT_WINDOW] for i in range(n - fingerprints.SHORT_WINDOW + 1)] if n else []
    else:
        windows = [text[i:i + w] for i in range(n - w + 1)]
        steps = [int(fingerprints.window_entropy(np.frombuffer(x, np.uint8))[0]) for x in windows]
        rank = [rarity[e] if e else max(rarity) + 1 for e in steps]
        votes = Counter(min(range(i, i + w), key=lambda k: (rank[k], k)) for i in range(len(windows) - w + 1))
        found = [windows[i] for i in sorted(votes) if votes[i] >= fingerprints.POPULAR and steps[i]]
    return list(dict.fromkeys(found))


def _slow_mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 % (1 << 64)
    x ^= x >> 27
    x = x * 0x94D049BB133111EB % (1 << 64)
    return x ^ x >> 31


def test_selection_chains_and_likeness_by_definition():
    r = random.Random(8)
    samples = [prose(900 + i, r.choice((2, 9, 40, 160))).encode() for i in range(24)] + [b"", b"abc", b"a" * 300, ("é漢" * 90).encode(), b"ab" * 400]
    samples.append(samples[3][:-50] + b"z" * 50)
    rarity = r.sample(range(fingerprints.LEVELS + 1), fingerprints.LEVELS + 1)
    block = Block.of(pa.array(samples, pa.binary()))
    h, owner = fingerprints.selected_features(block, np.array(rarity))
    prints = fingerprints.bloom_chains(h, owner, len(samples))
    sets = []
    for i, text in enumerate(samples):
        wanted = _slow_features(text, rarity)
        hashes = [int(Block.of(pa.array([x], pa.binary())).span_hash(np.array([0]), np.array([len(x)]))[0]) for x in wanted]
        assert h[owner == i].tolist() == hashes
        chain = []
        for at in range(0, len(hashes), fingerprints.PER_FILTER):
            part = hashes[at:at + fingerprints.PER_FILTER]
            chain.append(({_slow_mix((x + k * 0x632BE59BD9B4E019) % (1 << 64)) % fingerprints.FILTER_BITS for x in part for k in range(fingerprints.HASHES)}, len(part)))
        bits, size = prints.of(i)
        assert size.tolist() == [n for _, n in chain]
        assert [set(np.flatnonzero(np.unpackbits(b.view(np.uint8))).tolist()) for b in bits] == [x for x, _ in chain]
        sets.append(chain)

    def slow_likeness(a, b):
        if a == b:
            return 1.0
        if not a or not b:
            return 0.0
        a, b = (b, a) if len(a) > len(b) else (a, b)
        total = 0.0
        for x, n in a:
            chance = lambda y: len(x) * len(y) / fingerprints.FILTER_BITS  # noqa: B023, E731
            total += n * max(min(1, max(0, (len(x & y) - chance(y)) / max(min(len(x), len(y)) - chance(y), 1e-9))) for y, _ in b)
        return total / max(sum(n for _, n in a), sum(n for _, n in b))
    for i, j in itertools.product(range(len(samples)), repeat=2):
        assert fingerprints.likeness(prints.of(i), prints.of(j)) == pytest.approx(slow_likeness(sets[i], sets[j]))


def test_window_entropy():
    data = np.frombuffer(prose(9, 60).encode() + b"a" * 80, np.uint8)
    got = fingerprints.window_entropy(data)
    for i in range(0, len(got), 7):
        c = np.bincount(data[i:i + fingerprints.WINDOW])
        c = c[c > 0] / fingerprints.WINDOW
        assert abs(-(c * np.log2(c)).sum() / np.log2(fingerprints.WINDOW) * fingerprints.LEVELS - got[i]) < 1.1


# 3. suffix-array dedup

def brute_removed(rows, length):
    where = Counter()
    data = [(t or "").encode() for _, t in rows]
    for b in data:
        where.update(b[i:i + length] for i in range(len(b) - length + 1))
    out = []
    for b in data:
        covered = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if where[b[i:i + length]] > 1:
                covered[i:i + length] = b"\x01" * length
        kept = bytes(x for x, c in zip(b, covered) if not c)
        out.append((len(b), sum(covered), len(re.findall(rb"\x01+", bytes(covered))), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup(spark):
    rows = [r for r in texts() if len(r[1] or "") < 20_000]
    df = documents(spark).where(F.coalesce(F.length("text"), F.lit(0)) < 20_000)
    got = suffix_dedup.remove_repeats(df).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == Counter((d, *x) for (d, _), x in zip(rows, brute_removed(rows, 200)))
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_suffix_dedup_random_small_alphabet(spark):
    r = random.Random(4)
    pieces = ["".join(r.choice("ab") for _ in range(n)) for n in (40, 230, 260, 199, 200, 201)]
    rows = [(i, "".join(r.choice(pieces) + r.choice(["", "x", "yy"]) for _ in range(r.randrange(1, 6)))) for i in range(40)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in got) == [(d, *x) for (d, _), x in zip(rows, brute_removed(rows, 200))]


def test_suffix_dedup_hot_leads(spark, monkeypatch):
    shared = prose(41, 90)
    rows = [(i, f"{prose(500 + i % 50, 40)} {shared} {prose(900 + i % 70, 40)}") for i in range(300)] + [(7, shared), (7, shared), (None, shared[:250])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = Counter((d, *x) for (d, _), x in zip(rows, brute_removed(rows, 200)))
    held = []
    compare = suffix_dedup.match_windows
    monkeypatch.setattr(suffix_dedup, "match_windows", lambda units, *rest: held.append(units.count()) or compare(units, *rest))
    for hot in (20, 10**9, 0):
        got = suffix_dedup.remove_repeats(df, hot=hot).collect()
        assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want
    assert len(held) == 2 and held[0] > 40


def test_suffix_dedup_tells_rows_of_one_id_apart(spark):
    # Two texts of one id whose 32-bit hashes agree, of which one repeats elsewhere; then many texts under one id.
    text = F.concat(F.sha2(F.col("id").cast("string"), 512), F.sha2(F.concat(F.lit("x"), "id"), 512))
    many = spark.range(300_000).select("id", text.alias("text"))
    twins = many.groupBy(F.hash("text").alias("h")).agg(F.count("*").alias("n"), F.min("text").alias("a"), F.max("text").alias("b")).where("n = 2").first()
    rows = [(1, twins.a), (1, twins.b), (2, twins.a)]
    want = Counter((d, *x) for (d, _), x in zip(rows, brute_removed(rows, 200)))
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want
    one = many.where("id < 60000").select(F.lit(5).cast("long").alias("doc_id"), "text").union(many.where("id < 30").select("id", "text"))
    found = suffix_dedup.remove_repeats(one).where("n_removed > 0").select("doc_id", "n_removed").collect()
    assert Counter(map(tuple, found)) == Counter({(5, 256): 30} | {(i, 256): 1 for i in range(30) if i != 5}) + Counter({(5, 256): 1})


def test_suffix_dedup_many_equal_rows(spark):
    # Rows equal in doc_id and text, equal texts under other ids, one id with many texts, ids that are strings.
    text, other = prose(60, 120), prose(61, 120)
    rows = [(1, text)] * 150 + [(2 + i, text) for i in range(150)] + [(None, other)] * 80 + [(9, f"{prose(70 + i, 9)} {other[:300]}") for i in range(60)] + [(None, None)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = Counter((d, *x) for (d, _), x in zip(rows, brute_removed(rows, 200)))
    for hot in (suffix_dedup.HOT, 10):
        got = suffix_dedup.remove_repeats(df, hot=hot).collect()
        assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want
    named = suffix_dedup.remove_repeats(df.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), decode=True).collect()
    assert Counter(("d%d" % d if d else None, *x) for d, *x in want.elements()) == Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in named)
    assert {r["kept"] for r in named if r["doc_id"] == "d1"} == {""}


# 4. WARC

def test_warc_round_trip(spark, tmp_path):
    rows = [(3, "u", "<p>x"), (1, "v", "<p>x"), (2, None, "<p>x"), (None, "w", "<p>x"), (5, "e", None), (4, "f", ""), (1, "v", "<p>x"), (9, "é\r\nz", "ÿ" * 100_000)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, payload string")
    warc.write_archives(df, f"file://{tmp_path}/a")
    got = warc.read_archives(spark, f"file://{tmp_path}/a").collect()
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        same = [j for j, _, x in rows if (x or "") == (h or "") and j is not None]
        want[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == min(same) else "revisit", None if i == min(same) else min(same)] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert {r["page_id"]: r["payload"] for r in got}[9].decode() == "ÿ" * 100_000
    warc.write_archives(df.limit(0), f"file://{tmp_path}/b")
    assert warc.read_archives(spark, f"file://{tmp_path}/b").count() == 0
    warc.write_archives(df, f"file://{tmp_path}/c", min_bytes=5)
    assert warc.read_archives(spark, f"file://{tmp_path}/c").where("record_type = 'revisit'").count() == 0


def test_warc_archives_start_with_the_dictionary_and_are_validated(spark, tmp_path):
    df = spark.range(400).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<html><p>page number "), F.col("id").cast("string"), F.sha2(F.col("id").cast("string"), 512)).alias("html"))
    warc.write_archives(df.repartition(1), f"file://{tmp_path}/a")
    data = max(tmp_path.glob("a/part-*"), key=lambda p: p.stat().st_size).read_bytes()
    assert data[:4] == (warc.DICTIONARY_MAGIC).to_bytes(4, "little") and len(list(warc.read_archive(data))) > 0
    for broken in (data[:-20], data + b"xx", data[:len(data) // 2]):
        with pytest.raises((warc.InvalidRecord, warc.zstandard.ZstdError)):
            list(warc.read_archive(broken))
    good = warc.build_record("response", "0", "u", b"abc", warc.sha1_base32(b"abc"), 3, [])
    assert warc.parse_record(good)[1] == b"abc"
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"abc", b"abd"), re.sub(rb"Content-Length: \d+\r\nWARC", b"Content-Length: 9\r\nWARC", good), good.replace(b"WARC-Date", b"WARC Date")):
        with pytest.raises(warc.InvalidRecord):
            warc.parse_record(bad)


def test_warc_archives_are_bounded_and_each_starts_with_the_dictionary(spark, tmp_path, monkeypatch):
    page = F.concat(F.lit("<html><p>page number "), F.col("id").cast("string"), F.repeat(F.sha2(F.col("id").cast("string"), 512), (F.col("id") % 9).cast("int")))
    df = spark.range(500).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), page.alias("html")).repartition(2)
    for frames, size in ((7, 1 << 20), (50, 9000)):
        monkeypatch.setattr(warc, "ARCHIVE_FRAMES", frames)
        monkeypatch.setattr(warc, "ARCHIVE_BYTES", size)
        path = tmp_path / str(frames)
        warc.write_archives(df, f"file://{path}")
        files = [p.read_bytes() for p in path.glob("part-*")]
        assert len(files) > 15 and all(f[:4] == warc.DICTIONARY_MAGIC.to_bytes(4, "little") for f in files)
        lead = int.from_bytes(files[0][4:8], "little")
        assert max(map(len, files)) < lead + size + 8 * frames + 3000 and max(sum(1 for _ in warc.read_archive(f)) for f in files) < frames
        got = warc.read_archives(spark, f"file://{path}")
        assert {(r["page_id"], bytes(r["payload"]).decode()) for r in got.collect()} == {(r["page_id"], r["html"]) for r in df.collect()}


def test_warc_reader_takes_time_in_proportion():
    packer = warc.zstandard.ZstdCompressor(level=1)

    def archive(n):
        return b"".join(packer.compress(warc.build_record("response", str(i), "u", p := random.Random(i).randbytes(900), warc.sha1_base32(p), 900, [])) for i in range(n))

    def seconds(data, n):
        began = time.process_time()
        assert sum(1 for _ in warc.read_archive(data)) == n
        return time.process_time() - began
    small, large = archive(2_000), archive(20_000)
    assert seconds(large, 20_000) < 25 * seconds(small, 2_000)


# 5. mixing

def water(sizes, cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free, left = {}, set(order), sum(sizes.values())
    while True:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > cap * sizes[s]]
        for s in over:
            target[s] = cap * sizes[s]
        free -= set(over)
        if not over or not free:
            return target | {s: left * weight[s] / total for s in free if s not in target}
        left = sum(sizes.values()) - sum(target.values())


def check_mix(rows, got, tolerance):
    size = lambda t: len(WORD.findall(t or ""))
    sizes, taken = Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    for s in {r[2] for r in rows}:
        sizes[s] += 0
    target = water(sizes)
    for r in got:
        assert r["size"] == size(r["text"]) and r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] == r["size"] * r["times"] and 0 <= r["times"] <= 3
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= tolerance(s)


def test_mixing_by_hash_thresholds(spark):
    r = random.Random(1)
    rows = [(i, prose(i, r.randrange(1, 30)), [None, "a", "b", "c", "dd"][min(4, int(r.expovariate(1)))]) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    check_mix(rows, got, lambda s: 30)
    assert {(x["doc_id"], x["times"]) for x in got} == {(x["doc_id"], x["times"]) for x in mixing.mix(df.repartition(7)).collect()}


def test_mixing_awkward_rows(spark):
    got = mixing.mix(documents(spark, clash=False)).collect()
    rows = [(r["doc_id"], r["text"], r["source"]) for r in got]
    assert len(rows) == len(texts())
    alike = Counter()  # rows that are equal in doc_id and text go together
    for r in rows:
        alike[r] += len(WORD.findall(r[1] or ""))
    check_mix(rows, got, lambda s: max(n for r, n in alike.items() if r[2] == s))
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mix(documents(spark).withColumn("size", F.lit("x"))).columns[-5:] == ["size_", "source_size", "target", "taken", "times"]


# 6. n-gram Jaccard join

def brute_components(rows, n, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(FOLD))
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    low = {d: d for d, _ in rows}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x
    key = lambda d: -(1 << 63) if d is None else d
    for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2):
        if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
            common = len(a & b)
            if 100 * common >= percent * (len(a) + len(b) - common):
                x, y = sorted((find(rows[i][0]), find(rows[j][0])), key=key)
                low[y] = x
    return Counter((d, len(s), find(d)) for (d, _), s in zip(rows, sets))


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80), (2, 50)])
def test_jaccard_components(spark, n, percent):
    r = random.Random(n)
    base = [prose(100 + i, size) for i, size in enumerate((12, 25, 40, 120, 400))]
    rows = list(texts())
    for i in range(150):
        w = r.choice(base).split()
        for _ in range(r.choice((0, 1, 1, 2, 6))):
            w[r.randrange(len(w))] = r.choice(("changed", "altered", "w" + str(r.randrange(9))))
        rows.append((100 + i, " ".join(w[: r.choice((len(w), len(w) - 1))])))
    df = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, rep string")
    got = ngram_jaccard.jaccard_components(df, n, percent).collect()
    assert Counter(tuple(x) for x in got) == brute_components(rows, n, percent)


def test_jaccard_tiles_of_large_clusters(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "TILE", 16)
    r = random.Random(9)
    rows = []
    for i in range(120):
        w = prose(50, 60).split()
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = "c" + str(r.randrange(1000))
        rows.append((i, " ".join(w)))
    got = ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert Counter(tuple(x) for x in got) == brute_components(rows, 3, 90)


def test_jaccard_large_cluster_is_not_tiled_against_itself(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "TILE", 16)
    r = random.Random(3)
    rows = []
    for i in range(260):
        w = prose(51, 200).split()
        for _ in range(1 if i < 240 else 5 + i % 4):  # near copies, and some at the edge of the threshold
            w[r.randrange(len(w))] = "c" + str(r.randrange(10**6))
        rows.append((i, " ".join(w)))
    made, tiles = [], ngram_jaccard._tiles
    monkeypatch.setattr(ngram_jaccard, "_tiles", lambda big, percent: made.append((out := tiles(big, percent), big)) or out)
    got = ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert Counter(tuple(x) for x in got) == brute_components(rows, 3, 90)
    # Every block against every block would make 3 * 260 / 8 rows of each member.
    assert made and made[0][1].count() > 240 and made[0][0].count() < 3 * 20 * 260


@pytest.mark.parametrize("percent", [40, 50, 60, 70, 80, 86, 87, 90])
def test_jaccard_candidates_right_at_the_threshold(percent):
    r = np.random.default_rng(percent)
    cells = ngram_jaccard.cell_digests if percent >= ngram_jaccard.PIGEONHOLE else ngram_jaccard.sampled_cells
    for size in (3, 10, 20, 31, 64, 127, 400):
        for nested in (False, True):
            sets = []
            for _ in range(200):
                if nested:  # the smaller set lies in the larger one
                    a = r.integers(0, 1 << ngram_jaccard.BITS, size, dtype=np.uint64)
                    b = a[:max(1, -(-size * percent // 100))]
                else:
                    common = -(-size * 2 * percent // (100 + percent))
                    both = r.integers(0, 1 << ngram_jaccard.BITS, 2 * size - common, dtype=np.uint64)
                    a, b = both[:size], both[size - common:]
                sets += [np.sort(a), np.sort(b)]
            off = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
            keys, owner = cells(np.concatenate(sets), off, percent)
            mine = [set(keys[owner == i].tolist()) for i in range(len(sets))]
            missed = sum(not mine[i] & mine[i + 1] for i in range(0, len(sets), 2))
            assert missed <= (0 if percent >= 80 else 1), (size, nested)


def test_jaccard_extreme_ids(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    rows = [(low, prose(1, 30)), (None, prose(2, 30)), (high, prose(2, 30)), (5, prose(1, 30)), (None, prose(3, 30)), (0, prose(4, 30))]
    got = ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    by = {(r["doc_id"], r["component_id"]) for r in got}
    assert len(got) == 6 and {(low, low), (5, low), (0, 0)} <= by and not any(c == low for d, c in by if d not in (low, 5))
    assert {c for d, c in by if d in (None, high)} in ({None}, {high})


def test_jaccard_empty_table(spark):
    assert ngram_jaccard.jaccard_components(empty(spark)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(5, 60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["id"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**{i: 5 for i in range(5, 61)}, 100: 100, 101: 100}


@pytest.mark.parametrize("chunk", [3, 250_000])
def test_components_rounds_take_three_exchanges(spark, monkeypatch, chunk):
    monkeypatch.setattr(shared, "CHUNK", chunk, raising=False)
    made, written = [], shared._written
    monkeypatch.setattr(shared, "_written", lambda df, name: made.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")) or written(df, name))
    r = random.Random(chunk)
    ids = r.sample(range(-(1 << 63), 1 << 63, 1 << 40), 60)
    # A path in no order, a hub, an id over many others, some of which have smaller neighbours, and repeats.
    groups = [list(zip(ids, ids[1:])), [(7, i) for i in range(8, 40)], [(2000, i) for i in range(1000, 1030)] + [(i, i - 200) for i in range(1000, 1030, 3)]]
    edges = [e if r.random() < 0.5 else e[::-1] for g in groups for e in g + g[:5]]
    expected = {i: min(min(e) for e in g) for g in groups for e in g for i in e}
    got = connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5).localCheckpoint()).collect()
    assert len(got) == len(expected) and {x["id"]: x["component"] for x in got} == expected
    assert made and max(made) <= 3


# 7. byte-level BPE

@pytest.fixture(scope="module")
def codecs():
    import public_tokenizers
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY))
    return bpe.Codec(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(codecs):
    ours, theirs = codecs
    r = random.Random(3)
    samples = [t or "" for _, t in texts()] + ["<|endoftext|> it's", "   \n\n x", "\u0000‍", "a" * 20_000, "ab" * 5000]
    samples += ["".join(r.choice("aeiounts '0é漢\n") for _ in range(r.randrange(60))) for _ in range(1500)]
    for s in samples:
        ids = ours.encode(s)
        assert ids.tolist() == theirs.encode_ordinary(s) and ours.decode(ids) == s.encode()


def test_bpe_pieces_of_any_bytes(codecs):
    ours, theirs = codecs
    r = random.Random(5)
    for _ in range(2000):
        data = b"".join(ours.table[r.randrange(50_000)] for _ in range(r.randrange(1, 5)))
        assert ours.encode_bytes(data) == theirs._core_bpe.encode_single_piece(data)


def test_bpe_query(spark, codecs):
    _, theirs = codecs
    got = bpe.token_digests(documents(spark)).collect()
    want = Counter()
    for d, t in texts():
        ids = theirs.encode_ordinary(t or "")
        want[d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in got) == want
    rows = bpe.encode_documents(documents(spark)).collect()
    assert rows[0]["n_tokens"] == "x" and rows[0]["n_tokens_"] == len(rows[0]["ids"]) and all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in rows)
    assert bpe.token_digests(empty(spark)).count() == 0


# 8. token counts

@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_by_line(spark, codecs, rule):
    _, theirs = codecs
    df = documents(spark).withColumnRenamed("n_tokens", "n_sections")
    got = Counter((r["doc_id"], r["n_tokens"], r["n_sections_"], tuple(r["section_tokens"]), r["n_crossing"]) for r in token_counts.count_tokens(df, rule=rule).collect())
    want = Counter()
    for d, t in texts():
        data = (t or "").encode()
        lines = re.findall(rb"[^\n]*\n|[^\n]+", data)
        owner = [i for i, x in enumerate(lines) for _ in x]
        counts, at, crossing = [0] * len(lines), 0, 0
        ids = theirs.encode_ordinary(t or "")
        for token in ids:
            held = owner[at:at + len(theirs.decode_single_token_bytes(token))]
            at += len(held)
            crossing += len(set(held)) > 1
            most = Counter(held)
            counts[{"start": held[0], "end": held[-1], "largest": min(most, key=lambda k: (-most[k], k))}[rule]] += 1
        want[d, len(ids), len(lines), tuple(counts), crossing] += 1
    assert got == want


def test_token_counts_by_field(spark):
    df = spark.createDataFrame([(1, "a b", None, "c"), (2, None, None, None)], "doc_id long, x string, y string, z string")
    got = [(r["n_tokens"], list(r["section_tokens"])) for r in token_counts.count_tokens(df, fields=["x", "y", "z"]).orderBy("doc_id").collect()]
    assert got[0][0] == sum(got[0][1]) and len(got[0][1]) == 3 and got[1][0] == sum(got[1][1])
    with pytest.raises(ValueError):
        token_counts.count_tokens(df, rule="none")


# 9. quality rules

def test_quality_counts_against_brute_force():
    r = random.Random(2)
    samples = [t for _, t in texts() if len(t or "") < 20_000] + ["x y\nx y\n\nx y\n#", "a b c\n" * 40] + [" ".join(r.choice("ab") for _ in range(r.randrange(1, 100))) for _ in range(60)]
    got = quality.measure(Block.of(pa.array(samples, pa.string())))
    for i, x in enumerate(samples):
        x = x or ""
        w = WORD.findall(x)
        n = len(w)
        seen = Counter(tuple(w[k:k + 3]) for k in range(n - 2))
        hit = {k + j for k in range(n - 2) if seen[tuple(w[k:k + 3])] > 1 for j in range(3)}
        lines = [y for y in x.split("\n") if WORD.search(y)]
        assert tuple(int(got[c][i]) for c in quality.COUNTS[:5]) == (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in x), len(lines) - len(set(lines)), len(hit))
        order = sorted(range(n), key=lambda k: w[k:])
        longest = [0] * n
        for a, b in zip(order, order[1:]):
            k = 0
            while max(a, b) + k < n and w[a + k] == w[b + k]:
                k += 1
            longest[a], longest[b] = max(longest[a], k), max(longest[b], k)
        spans = [(k, m) for k, m in enumerate(longest) if m >= quality.MIN_REPEAT]
        assert int(got["n_covered_words"][i]) == len({k + j for k, m in spans for j in range(m)}) and int(got["longest_repeat"][i]) == max((m for _, m in spans), default=0)


def test_quality_verdicts(spark):
    passage = prose(8, 40)
    rows = [(1, prose(1, 200)), (2, prose(2, 30)), (3, f"{passage} {prose(3, 60)} {passage} {prose(4, 20)}"), (4, None), (5, "same line here\n" * 30)]
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.judge(spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, kept string")).withColumn("kept", F.col("kept_")).collect()}
    assert got == {1: (False, True), 2: (True, False), 3: (False, False), 4: (True, False), 5: (True, False)}
    assert quality.judge(empty(spark)).count() == 0


# 10. license scans

def brute_licenses(text):
    units = [(i + 1, x) for i, x in enumerate((text or "").split("\n"))]
    if len(units) > 1:
        units.append((0, text))
    best = []
    for unit, x in units:
        w = re.sub(r"[\W_]+", " ", x.lower()).split()
        grams = {f"{a} {b}" for a, b in zip(w, w[1:])}
        for k, (name, template) in enumerate(licenses.TEMPLATES):
            own = set(licenses.template_grams(template))
            dice = 2 * len(grams & own) / (len(grams) + len(own))
            if 100 * dice >= licenses.THRESHOLD_PERCENT:
                best.append((-dice, unit, k, name))
    first = min(best, default=None)
    return (first[3], round(-first[0], 6), len({b[1] for b in best}), ",".join(sorted({b[3] for b in best}))) if first else (None, None, 0, "")


def test_licenses(spark):
    rows = [(i, t) for i, (_, t) in enumerate(texts())] + [(100, "x\nReleased under the MIT License.\ny"), (101, "Licensed under   the Apache-License; VERSION 2.0"), (102, "Licensed under CC BY-NC 4.0."), (102, "Licensed under CC BY-NC 4.0."), (103, licenses.TEMPLATES[13][1].replace(":", "\n")), (None, "MIT")]
    got = licenses.license_scan(spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, matches string")).collect()
    assert Counter(tuple(r) for r in got) == Counter((d, *brute_licenses(t)) for d, t in rows)
    assert licenses.license_scan(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        licenses.license_scan(empty(spark), [("x", "one")])


def test_licenses_in_batches_of_templates(spark, monkeypatch):
    full = dict(licenses.full_texts())
    rows = [(1, licenses.TEMPLATES[3][1]), (2, f"{prose(5, 40)}\n\n{full['MIT']}\n\n{prose(6, 30)}"), (3, "x\nReleased under the MIT License.\nLicensed under CC BY 4.0."), (4, None), (5, full["ISC"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, licenses.license_scan(df).collect()))
    monkeypatch.setattr(licenses, "MAX_TEMPLATE_GRAMS", 2500)
    assert sorted(map(tuple, licenses.license_scan(df).collect())) == want and want[1][1] == "MIT"


def test_licenses_in_passages(spark):
    full = dict(licenses.full_texts())
    notes = dict(enumerate(t for _, t in licenses.TEMPLATES))
    wrap = lambda t: "\n".join(f" * {x}" for x in textwrap.wrap(t, 60))
    rows = [(name, text) for name, text in full.items()]
    rows += [(name, f"{prose(5, 80)}\n\n{text}\n\n{prose(6, 300)}") for name, text in full.items() if name != "GPL-3.0"]
    rows += [("GPL-3.0", f"/*\n * {prose(1, 9)}\n *\n{wrap(notes[13])}\n */\n{prose(2, 60)}"), ("BSD-3-Clause", f"{prose(3, 30)}\n{wrap(notes[3])}\n{prose(4, 50)}"), ("MIT", f"# {prose(7, 12)}\n{wrap(notes[17])}\n{prose(8, 40)}")]
    rows += [("MIT", "We made this at home for fun. Released under the MIT License."), ("MIT", full["MIT"].replace("\n\n", "\r").replace("\n", " ").replace("\r", "\n")), (None, f"{prose(9, 400)}\n{prose(10, 30)}"), (None, full["GPL-3.0"][:9000])]
    got = dict(licenses.license_scan(spark.createDataFrame(list(enumerate(t for _, t in rows)), "doc_id long, text string")).select("doc_id", F.split("licenses", ",")).collect())
    assert [(i, n, got[i]) for i, (n, _) in enumerate(rows) if (n or "") not in got[i] or not n and got[i] != [""]] == []
    one = licenses.license_scan(spark.createDataFrame([(1, rows[-4][1])], "doc_id long, text string")).first()
    assert tuple(one) == (1, "MIT", 1.0, 1, "MIT")


def test_licenses_in_long_texts(spark):
    full = dict(licenses.full_texts())
    lines = [prose(1000 + i, 7) for i in range(10_000)]
    common = "subject to the terms of the license and to the following conditions of use"
    text = "\n".join([*lines, full["MIT"], *lines, *[common] * 50])
    started = time.time()
    got = licenses.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.license == "MIT" and got.dice == 1.0
    assert time.time() - started < 30

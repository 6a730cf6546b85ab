"""Main text of pages, alignment of two tokenizers, hard negatives."""

import hashlib
import html
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from msgscreen.llm import alignment, hardnegatives, queries, sitetree
from msgscreen.llm.sitetree import Page

from .conftest import SF0001

P = pytest.importorskip("public_tokenizers")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


# ---------------------------------------------------------------- main text of pages
@pytest.mark.parametrize("source, want", [
    ("", ""), ("   ", ""), ("plain  text\n here", "plain text here"),
    ("<p>a<p>b<div>c<span class=ad>x<span>y</span>z</span>d</div>e", "a\nb\ncd\ne"),
    ('<a title="x>y" href=1>t</a> &amp; &lt;b&gt; &#233;&nbsp;x<br>y', "t & <b> é x y"),
    ("<div>a<!-- c --></div><!--> b<!-- open", "a\nb"), ('a<div class="cut off', "a"), ("5 < 6 and <3 x </ p>", "5 < 6 and <3 x </ p>"),
    ("<head><title>t</title><p>no closing head", "no closing head"), ('<script>if (a<b) "</p>"</script>ok<style>x', "ok"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>", "a\nb\nc"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ("<article><header><h1>T</h1></header><p>x</p><form>f</form><footer>f</footer><aside>s</aside><div class='comments'>c</div></article>", "T\nx"),
    ("<header>Site</header><main><h2>H</h2><div class=post-body>x</div></main><div id=cookie-notice>n</div><div role=navigation>m</div>", "H\nx"),
    ("<div class='page has-sidebar'><p>kept</p><div class=sidebar>s</div></div>", "kept"), ("<div hidden>x</div><div aria-hidden=true>y</div>z", "z"),
])
def test_text_of_one_page(source, want):
    assert Page(source).text() == want


def test_long_and_odd_pages_end():
    for source in ("<div>" * 20_000 + "x", "<b>" * 50_000 + "x", '<a "' * 50_000, "<!--" * 50_000, "<span class='a'>" * 5_000 + "x", "&" * 100_000, "<p>" + "word " * 200_000):
        assert isinstance(Page(source).text(), str)


def _site():
    """Hosts with a page frame that no tag or name gives away, copied articles, and a host of one page."""
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("lorem ipsum dolor sit amet consetetur elitr sed diam".split()) + str(rng.randrange(1000)) for _ in range(n))
    rows, want = [], {}
    for i in range(24):
        body = [text(20) for _ in range(1 + i % 4)]
        paragraphs = "".join(f"<p>{p}</p>" for p in body)
        rows.append((i, f"https://frame.example/{i}", f"<html><body><div><p>The same words on all pages</p></div><div><h2>T{i}</h2>{paragraphs}</div><div>Imprint and more</div></body></html>"))
        want[i] = "\n".join([f"T{i}", *body])
    article = f"<p>{text(30)}</p>"
    for i in range(30, 50):  # one article, copied, under menus that differ
        rows.append((i, "http://copies.example:80/", f"<nav>m{i}</nav><article>{article}</article><p>beside {i}</p>"))
        want[i] = re.sub("<[^>]*>", "", article)
    for i in range(60, 70):  # a box inside the article that all pages have
        rows.append((i, "http://USER@Box.example/x", f"<article><p>{(t := text(9))}</p><div>Read our letter</div></article>"))
        want[i] = t
    rows += [(80, "http://one.example/", "<div>alone</div>"), (81, None, "<p>no host</p>"), (82, "http://one.example/", None), (83, "http://frame.example/", ""), (80, "http://one.example/", "<div>alone</div>")]
    want |= {80: "alone", 81: "no host", 82: "", 83: ""}
    return rows, want


@pytest.mark.parametrize("table", [200_000, 0])
def test_what_repeats_on_a_site_goes(spark, table):
    rows, want = _site()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("mine")).withColumn("removed", F.lit(1)).repartition(3)
    out = sitetree.extract(df, table_branches=table)
    assert out.columns == [*df.columns, "text"] and out.select("host", "removed").distinct().count() == 1
    got = [(r.page_id, r.text) for r in out.collect()]
    assert Counter(got) == Counter((i, want[i]) for i, _, _ in rows)
    assert sitetree.extract(df.where("false")).count() == 0


def test_importance_by_the_formula(spark):
    """Counts by hand: presentation, content and their damped sum for each node of a host."""
    rows, _ = _site()
    rows = [r for r in rows if r[1] and "frame.example" in r[1]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    by_node, seen = defaultdict(list), set()
    for _, _, source in rows:
        whole, found = Page(source or "").facts()
        for node, style, content, kind in found:
            if (node, whole) not in seen:
                seen.add((node, whole))
                by_node[node].append((style, content, kind))
    def entropy(values):
        m = len(values)
        return 1.0 if m == 1 else -sum(c / m * math.log(c / m, m) for c in Counter(values).values())
    for r in sitetree.style_tree(df).collect():
        pages = by_node.pop(r.node)
        styles = {s: [c for t, c, _ in pages if t == s] for s, _, _ in pages}
        content = sum(len(c) / len(pages) * entropy(c) for c in styles.values())
        presentation, damped = entropy([s for s, _, _ in pages]), 0.9 ** len(styles)
        assert (r.pages, r.styles) == (len(pages), len(styles)) and r.outside == 0
        assert abs(r.importance - ((1 - damped) * presentation + damped * content)) < 1e-9 and r.kind == sitetree.PLAIN
    assert not by_node


def test_every_branch_of_the_tables_pages_is_in_the_tree(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    tree = sitetree.style_tree(pages).cache()
    kinds = {r.kind: r["count"] for r in tree.groupBy("kind").count().collect()}
    hosts = tree.select("host").distinct().count()
    assert kinds[sitetree.MAIN_ELEMENT] == hosts and kinds[sitetree.FURNITURE] >= 3 * hosts
    busy = tree.where("pages > 150").select("kind", "presentation", "content").collect()
    # menus, adverts and footers come from few texts, articles from many
    assert busy and max(r.content for r in busy if r.kind == sitetree.FURNITURE) < min(r.content for r in busy if r.kind == sitetree.MAIN_ELEMENT)


def test_op11(spark):
    """The pages' generator puts the text into an article element: the same text by a pattern."""
    want = {}
    for r in spark.read.parquet(f"{SF0001}/pages.parquet").collect():
        inner = r.html[r.html.index("<article>") + 9:r.html.rindex("</article>")]
        blocks = [" ".join(html.unescape(re.sub("<br>|</?b>", " ", x)).split()) for x in re.split("</?(?:h1|p)>", inner)]
        text = "\n".join(x for x in blocks if x)
        want[r.page_id] = (r.url, text, len(text))
    assert {r.page_id: (r.url, r.text, r.n_chars) for r in queries.op11_sitetree(spark, SF0001).collect()} == want


# ---------------------------------------------------------------- alignment
def plain_alignment(text, both):
    """Ids and shared ends of the whole text, without words or recursion."""
    ids = both._ids(text) if text else None
    if ids is None:
        return "", [], 0, 0
    ends_a, ends_b = (np.cumsum([len(t[i]) for i in x]).tolist() for t, x in zip((both.bytes_a, both.bytes_b), ids, strict=True))
    groups, links, i, j = [], [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        p, q = ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1
        groups.append(",".join(map(str, ids[0][i:p])) + "|" + ",".join(map(str, ids[1][j:q])))
        links.append((ids[0][p - 1], ids[1][q - 1]))
        i, j = p, q
    return ";".join(groups), links, len(ids[0]), len(ids[1])


def brute_alignment(rows):
    both = alignment.Aligner(A, B)
    known = {t: plain_alignment(t, both) for _, t in rows}
    count = Counter(x for _, t in rows for x in known[t][1])
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for key, t in rows:
        groups, links, n_a, n_b = known[t]
        out.append((key, n_a, n_b, len(links), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links),
                    hashlib.sha256(groups.encode()).hexdigest() if groups else ""))
    return Counter(out)


@pytest.mark.parametrize("seed", range(3))
def test_shared_cuts(seed):
    rng = np.random.default_rng(seed)
    for _ in range(200):
        n = int(rng.integers(1, 400))
        a, b = (np.sort(np.append(rng.choice(n, rng.integers(0, n + 1), replace=False), n)) for _ in range(2))
        if rng.random() < 0.2:  # no cut but the last
            a, b = np.append(np.arange(0, 2 * n, 2), 4 * n), np.append(np.arange(1, 2 * n, 2), 4 * n)
        at_a, at_b = alignment.shared_cuts(a, b)
        want = sorted(set(a.tolist()) & set(b.tolist()))
        assert a[at_a].tolist() == want and b[at_b].tolist() == want


def test_words_align_as_whole_texts():
    both, rng = alignment.Aligner(A, B, kept=50), random.Random(1)
    odd = ["  a  b ", "\n\tx y\r\n z", "▁a b", "a ▁ b c", "<s> hi <|endoftext|> x", "é" * 300, "a" * 3000, "\x1c a \x1cb c\x85 d", "it 's 'tis don't", "漢字 仮名 \U0001f600 x", " ", "   ", "\x00 a", "ﬁ  ﬂ", "12 345 67a"]
    odd += ["".join(rng.choice(" \n\tab'st.,1é漢▁ \x1c​<|>") for _ in range(rng.randrange(1, 60))) for _ in range(1500)]
    for t, (groups, links, n_a, n_b) in zip(odd, both.texts(odd), strict=True):
        want = plain_alignment(t, both)
        assert (groups, n_a, n_b) == (want[0], want[2], want[3]), t
        assert np.frombuffer(links, "<u4").tolist() == [a * 65536 + b for a, b in want[1]]


@pytest.mark.parametrize("table", [4_000_000, 0])
def test_alignment_rows(docs, rows, none, table):
    cols = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    out = alignment.align(docs, A, B, table_links=table)
    assert out.columns == cols and Counter(map(tuple, out.collect())) == brute_alignment(rows)
    assert alignment.align(none, A, B, table_links=table).count() == 0
    groups = alignment.align(docs.where("doc_id = 1"), A, B, with_groups=True).first()
    assert hashlib.sha256(groups.groups.encode()).hexdigest() == groups.groups_sha256


def test_op12(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()]
    got = queries.op12_alignment(spark, SF0001)
    assert Counter(map(tuple, got.collect())) == brute_alignment(rows)


# ---------------------------------------------------------------- hard negatives
def brute_negatives(rows, anchors, relabel=lambda i, x: x, n_pos=5, n_neg=3):
    fine = [(i, relabel(i, x), [math.floor(256 * c) for c in v]) for i, v, x in rows if x is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = Counter()
    for k, (a, label, x) in enumerate(fine):
        if a is None or not anchors(a):
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y, strict=False)), i is None, i or 0, other) for j, (i, other, y) in enumerate(fine) if j != k)
        for s, no, i, _ in [r for r in scored if r[3] == label][:n_pos]:
            fits = [r for r in scored if r[3] != label and 50 * -s <= 100 * -r[0] <= 95 * -s][:n_neg]
            out.update((a, None if no else i, n, None if r[1] else r[2], -s, -r[0]) for n, r in enumerate(fits, 1))
    return out


def _vectors(n=150, d=12, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=d) + 0.6], int(rng.integers(0, 2)) if i % 3 else 0) for i in range(n)]
    bad = [None, [], [float("nan")] * d, [float("inf")] * d, [None] * d, [1.0, 2.0]]
    rows += [(500 + i, v, 1) for i, v in enumerate(bad)] + [(600, rows[0][1], None), (0, rows[3][1], 0), (0, rows[3][1], 0), (None, rows[4][1], 1), (None, rows[5][1], 0)]
    return rows


@pytest.mark.parametrize("cell", [None, 7])
def test_hard_negatives(spark, monkeypatch, cell):
    if cell:
        monkeypatch.setattr(hardnegatives, "CELL_ROWS", cell)
        monkeypatch.setattr(hardnegatives, "FIELDS", 3)
    rows = _vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("row", F.lit("x")).withColumn("SCORE", F.lit(0)).repartition(3)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10)
    got = hardnegatives.mine(df, F.col("vec_id") % 10 == 0, moved)
    want = brute_negatives(rows, lambda i: i % 10 == 0, lambda i, x: (x + 1) % 10 if i is not None and i % 7 == 0 else x)
    assert Counter(map(tuple, got.collect())) == want and len(want) > 50
    assert hardnegatives.mine(df.where("false"), F.col("vec_id") % 10 == 0).count() == 0
    assert hardnegatives.mine(df.where("vec_id = 3"), F.col("vec_id") >= 0).count() == 0


@pytest.mark.parametrize("scale", [1, 300, 10**6, 10**8])
def test_packed_products_are_exact(scale):
    rng = np.random.default_rng(2)
    block = rng.integers(-scale, scale + 1, (5000, 9))
    for anchor in rng.integers(-scale, scale + 1, (4, 9)):
        packed = hardnegatives.Packed(block, int(anchor.min()), int(anchor.max()))
        assert packed.scores(anchor).tolist() == [sum(int(a) * int(b) for a, b in zip(anchor, row, strict=True)) for row in block]
    with pytest.raises(OverflowError):
        hardnegatives.Packed(np.full((2, 9), 2**40), 0, 2**40)

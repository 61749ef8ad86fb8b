"""Main text of pages, the pipeline, and the registered queries with their SQL."""
import html as entities
import re

import duckdb
import pytest

import corpus_pipeline
from touchline.llm import html
from touchline.llm.queries import ORACLE, QUERIES

from brute import SF


def text(page):
    return "\n".join(t for t, _ in html.read_blocks(page))


@pytest.mark.parametrize(
    "page, want",
    [
        ("", ""),
        ("plain &lt;text&gt; &amp;amp; &nbsp; here", "plain <text> &amp; here"),
        ("<article><h1>A</h1><p>b <b>c</b>\n d<p>e</article>", "A\nb c d\ne"),
        ("<nav>x</nav><div class='ad'>y</div><article><p>z</p></article><footer>f</footer>", "z"),
        ("<body class='sidebar'><p>kept</p><aside>no</aside><div id=comments><p>no</p></div></body>", "kept"),
        ("<main><p>a</p><form>no</form><section class='reader-comments'><article>no</article></section></main>", "a"),
        ("<article><header><h1>t</h1></header><p>x</p></article><header>no</header>", "t\nx"),
        ("<script>var t = '</p>';</script><style>p{}</style><p>x", "x"),
        ("<p title='a > b'>x<br>y</p><!-- c --><p hidden>no</p><p style='display: none'>no</p>", "x y"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\nb\nc\nd"),
        ("<p>open <b>bold<p>next</p><script>never closed", "open bold\nnext"),
        ("<p a=\"unclosed>x</p><p>y</p>", "x\ny"),
        ("a < b and <3 c", "a < b and <3 c"),
        ("<![CDATA[no]]><?php no ?><p>x</p>", "x"),
    ],
)
def test_blocks(page, want):
    assert text(page) == want


STORY = "<p>A long story with many words to tell.</p><p>It goes on.</p>"


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<div class='content no-sidebar'>{STORY}</div><div class='sidebar'><p>no</p></div>", True),
        (f"<div id=page class='has-sidebar'>{STORY}</div><p>end</p>", "end"),
        (f"<section class='post social'><article>{STORY}</article></section><p>foot</p>", True),
        (f"<div class='social'><main>{STORY}</main></div><div><p>{'other words ' * 20}</p></div>", True),
        (f"<div class='widget'>{STORY}</div><p>end</p>", "end"),
        (f"<div class='widget'><div class='notice'>{STORY}</div><div class='ad'>no</div></div>", True),
        (f"<div class='comments'>{STORY}</div>", True),
        (f"<p>short</p><div class='comments'>{STORY}</div>", "short only"),
        (f"<article>{STORY}</article><div class='related'><article>{'teaser ' * 50}</article></div>", True),
        (f"<form>{STORY}<script>no</script><select><option>no</select></form>", True),
        (f"<div class='sidebar'>{STORY}</div><div class='content'><p>{'other words ' * 20}</p></div>", "other only"),
        (f"<div hidden>{STORY}</div>", ""),
    ],
)
def test_rules_keep_the_article(page, want):
    story = "A long story with many words to tell.\nIt goes on."
    other = {True: story, "end": story + "\nend", "short only": "short", "other only": ("other words " * 20).strip(), "": ""}
    assert text(page) == other[want]


def test_very_deep_and_long_pages():
    assert text("<div>" * 20_000 + "x") == "x"
    assert len(text("<p>" + "word " * 500_000)) == 5 * 500_000 - 1


def test_pages_keep_their_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S).group(1)
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)


def test_template_of_a_site_goes(spark):
    page = lambda i, extra="": f"<div><p>About this site</p><ul><li>Home</li></ul></div><div><p>Story number {i}</p>{extra}</div>"
    rows = [(i, f"https://Site.example/{i}", page(i)) for i in range(12)] + [(50 + i, f"https://other.example/{i}", page(i)) for i in range(5)]
    rows += [(90, None, page(90)), (91, "https://site.example/91", None), (92, "no url", ""), (93, "https://site.example/93", "<div><p>About this site</p></div>")]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story number {i}" for i in range(12))
    assert all(got[50 + i] == f"About this site\nHome\nStory number {i}" for i in range(5))
    assert (got[90], got[91], got[92]) == ("About this site\nHome\nStory number 90", "", "")
    assert got[93] == "About this site"  # nothing else would remain
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html.extract(empty).count() == 0


def test_templates_of_sections_and_small_hosts_go(spark):
    """Three sections of a third of a host each, a box on two pages of a hundred, and a host of six pages."""
    page = lambda i, box: f"<div><p>{box}</p></div><div><p>Story number {i}</p></div>"
    rows = [(i, f"https://large.example/{i}", page(i, f"Section {i % 3}")) for i in range(60)]
    rows += [(100 + i, f"https://hot.example/{i}", page(i, f"Layout {i}" if i >= 20 else "Rare layout")) for i in range(1000)]
    rows += [(2000 + i, f"https://small.example/{i}", page(i, "All pages")) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story number {i}" for i in range(60))
    assert all(got[100 + i] == (f"Layout {i}\n" if i >= 20 else "") + f"Story number {i}" for i in range(1000))
    assert all(got[2000 + i] == f"Story number {i}" for i in range(6))


def test_pipeline_stages(spark, docs):
    before, rows = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns
        assert after.count() <= rows
        before = after
        rows = after.count()
    assert before.where("text like '%[EMAIL]%'").count() > 0


def test_pipeline_run_packs_every_kept_document(spark):
    out = corpus_pipeline.run(spark, SF).toPandas()
    whole = out.groupby("doc_id").agg(n=("length", "sum"), want=("doc_tokens", "max"))
    assert (whole["n"] == whole["want"]).all() and len(whole) > 100
    assert (out["tokens"].map(len) == 4 * out["length"]).all()


def test_pipeline_takes_odd_rows(spark, odd):
    docs = odd.selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as long) as n_chars")
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).count()
        stage(spark, docs.limit(0), SF).count()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "labels", "pages", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = db.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, want.fetchall()))


STORY = "The council met on Monday and agreed to repair the old bridge before winter comes. "


@pytest.mark.parametrize("page, want", [
    (f'<main><div class="story"><p>{STORY * 4}</p></div><section><article>Teaser one here</article><article>Teaser two here</article></section></main>', (STORY * 4).strip()),
    (f'<a href="/">Menu</a><form action="/x"><div><p>{STORY * 3}</p><input></div></form>', "Menu\n" + (STORY * 3).strip()),
    (f'<div><p>{STORY * 3}</p></div><article class="comment">{"I think so too. " * 9}</article><article class="comment">{"Me as well. " * 9}</article>', (STORY * 3).strip()),
    (f'<div><p>{STORY}</p></div><div class="related"><p>{"Other news of the town and the county. " * 9}</p></div>', STORY.strip()),
    (f'<div><p>Short.</p></div><div class="widget"><a href="/a">{"One more link to read. " * 20}</a></div>', "Short."),
    (f'<article class="post has-comments"><p>{STORY}</p></article>', STORY.strip()),
    (f'<article class="comments-open"><p>{STORY * 3}</p></article><p>Foot</p>', (STORY * 3).strip()),
    (f'<form class="login"><p>Log in to comment on this page</p></form><p>{STORY}</p>', STORY.strip()),
])
def test_shapes_of_pages(page, want):
    assert "\n".join(t for t, _ in html.read_blocks(page)) == want


def test_recurrence_against_brute_force(spark):
    """Subtrees on six pages and on more than 1 % of a host's go, counted by hand; other pages keep all."""
    def page(i, host):
        boxes = "".join(f"<div><p>Box {k} of {host} stands here.</p></div>" for k in range(1, 8) if i % k == 0)
        return f"<body>{boxes}<div><p>Own words of page {i} on {host}.</p></div></body>"

    rows = [(100 * h + i, f"http://h{h}.org/{i}", page(i, f"h{h}")) for h, n in ((0, 40), (1, 13), (2, 5)) for i in range(n)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for h, n in ((0, 40), (1, 13), (2, 5)):
        often = {k for k in range(1, 8) if (seen := sum(i % k == 0 for i in range(n))) >= 6 and seen > 0.01 * n}
        for i in range(n):
            left = [f"Box {k} of h{h} stands here." for k in range(1, 8) if i % k == 0 and k not in often]
            assert got[100 * h + i] == "\n".join([*left, f"Own words of page {i} on h{h}."])

"""Articles and what lies beside them."""

from timberline.llm import html


def test_article_in_furniture_hides_no_story():
    assert html.main_text("<div id='story'><p>main text</p></div><aside><article>teaser</article></aside>") == "main text"
    assert html.main_text("<div id='story'>main text</div><article>second</article>") == "main text\nsecond"


def test_boxes_repeated_inside_articles_go(spark):
    pages = [f"<body><article><h1>head {i}</h1><div class='box'>same every time</div><p>story {i}</p></article></body>" for i in range(12)]
    copies = [f"<body><p>page {i}</p><article><div class='body'>one story on all pages</div></article></body>" for i in range(12)]
    rows = [(i, "http://h/", p) for i, p in enumerate(pages)] + [(100 + i, "http://g/", p) for i, p in enumerate(copies)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: f"head {i}\nstory {i}" for i in range(12)}, **{100 + i: f"page {i}\none story on all pages" for i in range(12)}}

import html as entities
import re

import pytest

from assayer.llm import html


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.01/pages.parquet")


@pytest.fixture(scope="module")
def weights(pages):
    return html.learn(pages)


def test_articles_are_found_whole(pages, weights):
    for row in html.extract(pages, weights).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", row.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>|<br>", article)
        texts = (" ".join(entities.unescape(re.sub("</?b>", "", b)).split()) for b in blocks)
        assert row.text == "\n".join(t for t in texts if t) and row.n_chars == len(row.text)


PAGE = """<html><body><header><h1>Site</h1></header><nav><a href=x>Home page</a></nav><div id="content"><h1>Big  news</h1>
<p>One two &amp; three<br>four five six seven eight.<div class="ad">buy now</div><p>Second para with <a href="y">link</a>ed
words.<ul><li>item a<li>item b</ul><script>if(a<b)"</p>"</script><!-- <p>no</p> --><div class="post comments"><p>I hate
it</p></div><form>Name<input></form></div><div class=sidebar><p>other stuff here</p></div><footer>c 2020</footer>"""


def test_what_is_left_out(weights):
    text = html.main_text(PAGE, weights)
    assert text.startswith("Big news\nOne two & three four five six seven eight.\nSecond para with linked words.")
    assert not re.search("Site|Home|buy|hate|Name|other|2020|if\\(|no", text)


def brute_region(scores):
    best, at = 0.0, (0, 0)
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            if sum(scores[i:j]) > best + 1e-9:
                best, at = sum(scores[i:j]), (i, j)
    return sum(scores[at[0] : at[1]])


def test_region_is_the_maximum(weights):
    parts = list(html.parse(PAGE))
    scores = []
    for kind, name, text, aside, _ in parts:
        if kind == "tag":
            w = html.DEFAULT.get(name, html.OTHER_TAG)
            scores.append(max(w, html.ASIDE_TAG) if aside else w)
        else:
            scores.append(len(text.split()) * (0.0 if aside else html.DEFAULT.get(name, html.OTHER_WORD)))
    begin, end = html.region(parts, html.DEFAULT)
    assert abs(sum(scores[begin:end]) - brute_region(scores)) < 1e-9


def test_odd_pages(spark, weights):
    cases = {None: "", "": "", " ": "", "plain text only": "plain text only", "<p>a": "a", "a < b": "a < b", "<p attr='x>y</p>": "y"}
    rows = [(i, None, page, 1) for i, page in enumerate(cases)] + [(None, "u", "<" * 5000, 1), (None, "u", "<!--" * 5000, 1)]
    rows += [(50, "u", "<script>" * 3000, 1), (51, "u", "<p>w</p>" * 20000, 1), (51, "u", "<p>w</p>" * 20000, 1)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = html.extract(table, weights).collect()
    texts = {r.page_id: r.text for r in got if r.page_id is not None}
    assert [texts[i] for i in range(len(cases))] == list(cases.values())
    assert texts[50] == "" and texts[51].count("w") == 20000 and len(got) == len(rows)
    assert html.extract(table.where("false")).count() == 0
    assert html.learn(table) == html.DEFAULT

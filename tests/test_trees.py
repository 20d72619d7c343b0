"""Trees of page elements on small pages, against what each rule says of them."""

from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from pagelens.functions import htmltree
from pagelens.operators import trees

BOX = "struct<x:double,y:double,w:double,h:double>"
NODE = f"page int, id string, tag string, place int, text string, image boolean, box {BOX}"


def nodes(spark, rows):
    """Rows of id, text, image and width; the tag is the id's last name, boxes are squares."""
    full = [(1, i, i.split("__")[-1].split("_")[0], k, text, image, (0.0, 0.0, float(w), float(w))) for k, (i, text, image, w) in enumerate(rows)]
    return spark.createDataFrame(full, NODE)


def test_build(spark):
    html = "<html><body><p>a <b>b</b><br>c</p><p><img src=x><script>no</script></p></div></body></html>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "<p>x<p>y")], "page_id int, html string")
    out = {(r["page_id"], r["id"]): r for r in trees.build(pages, "page_id", "html").collect()}
    top = "html_1__body_1"
    assert [k for p, k in out if p == 1] == ["html_1", "html_1__head_1", top, f"{top}__p_1", f"{top}__p_1__b_1", f"{top}__p_1__br_1", f"{top}__p_2", f"{top}__p_2__img_1", f"{top}__p_2__script_1"]
    assert out[1, f"{top}__p_1"]["text"] == "a bc" and out[1, f"{top}__p_2"]["text"] == "" and out[1, f"{top}__p_2__img_1"]["image"]
    assert not any(p in (2, 3) for p, _ in out)
    assert (out[4, f"{top}__p_1"]["text"], out[4, f"{top}__p_2"]["text"], out[4, "html_1"]["text"]) == ("x", "y", "xy")


def shown(e):
    return e if isinstance(e, str) else f"<{e.tag}>{''.join(map(shown, e.kids))}</{e.tag}>"


@pytest.mark.parametrize("source,want", [
    ("<p>x<p>y", "<p>x</p><p>y</p>"), ("<ul><li>a<ul><li>b</ul><li>c</ul>", "<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "<table><tbody><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></tbody></table>"),
    ("<table><tr><td><table><tr><td>1</table>2<td>3</table>", "<table><tbody><tr><td><table><tbody><tr><td>1</td></tr></tbody></table>2</td><td>3</td></tr></tbody></table>"),
    ("<b>1<p>2</b>3</p>", "<b>1</b><p><b>2</b>3</p>"), ("<p>1<b>2<i>3</b>4</i>5</p>", "<p>1<b>2<i>3</i></b><i>4</i>5</p>"), ("<p><b>x<p>y", "<p><b>x</b></p><p><b>y</b></p>"),
    ("<table>a<tr><td>x</table>", "a<table><tbody><tr><td>x</td></tr></tbody></table>"), ("<a>1<a>2</a>", "<a>1</a><a>2</a>"), ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"),
    ("<select><option>a<option>b</select>z", "<select><option>a</option><option>b</option></select>z"), ("<div><p>a</div>b</p>c", "<div><p>a</p></div>b<p></p>c"),
    ("<h1>a<h2>b</h1>c", "<h1>a</h1><h2>b</h2>c"), ("<p title=it's>a</p>'x", "<p>a</p>'x"), ("a<!-- <p> -->b<!x>c</ y>d<e", "abcd"), ("1 < 2 &amp;&lt;p>", "1 < 2 &<p>"),
])
def test_browser_tree(source, want):
    """Trees as the HTML standard has them."""
    assert shown(htmltree.parse(source)) == f"<html><head></head><body>{want}</body></html>"


def test_browser_tree_head_and_depth():
    assert shown(htmltree.parse("<title>a<b></title><script>'<p>'</script>x")) == "<html><head><title>a<b></title><script>'<p>'</script></head><body>x</body></html>"
    deep = htmltree.parse("<div>" * 5000 + "x" + "<b>" * 5000 + "y")
    assert shown(deep).count("<div>") == 5000 and "x" in shown(deep) and shown(deep).count("y") == 3  # two in the body tags


class Events(HTMLParser):
    """A second reading of well-formed pages: texts and the tags that are open around them."""

    def __init__(self):
        super().__init__()
        self.open, self.seen = [], []

    def handle_starttag(self, tag, attrs):
        if tag == "p" and "p" in self.open:
            del self.open[self.open.index("p") :]
        if tag not in htmltree.VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            del self.open[len(self.open) - 1 - self.open[::-1].index(tag) :]

    def handle_data(self, data):
        self.seen.append((data, [t for t in self.open if t != "b"]))


def test_build_against_second_reading(spark):
    """On the driver's pages: the same texts below the same blocks (formatting aside, which a browser reopens)."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    nodes = {}
    for r in trees.build(pages, "page_id", "html").collect():
        nodes.setdefault(r["page_id"], []).append(r)
    for page in pages.collect():
        events = Events()
        events.feed(page["html"])
        for block in ("nav", "article", "footer", "h1"):
            want = "".join(t for t, tags in events.seen if block in tags).strip()
            assert next(n["text"] for n in nodes[page["page_id"]] if n["tag"] == block) == want
        texts = [t for t, tags in events.seen if "p" in tags and "script" not in tags]
        assert sum(n["tag"] == "p" for n in nodes[page["page_id"]]) == page["html"].count("<p>") + ("</p>" in page["html"].split("<script>")[0])
        assert "".join(n["text"] for n in nodes[page["page_id"]] if n["tag"] == "p") == "".join(t.strip() for t in texts)


def test_empty(spark):
    x = nodes(spark, [("a_1", "t", False, 9), ("a_1__b_1", " ", False, 9), ("a_1__b_1__c_1", "", False, 9), ("a_1__b_2", "", False, 9), ("a_1__b_2__img_1", "", True, 5), ("a_1__img_1", "", True, 1)])
    assert {(r["id"], r["parent"]) for r in trees.without_empty(x, "page").collect()} == {("a_1", None), ("a_1__b_2", "a_1"), ("a_1__b_2__img_1", "a_1__b_2")}


def test_dressing(spark):
    x = nodes(spark, [("p_1", "one two", False, 9), ("p_1__b_1", "two", False, 9), ("p_1__b_1__div_1", "two", True, 9), ("p_2", "x", False, 9), ("p_2__b_1", "x", False, 9)])
    out = {r["id"]: r["parent"] for r in trees.without_dressing(x, "page").collect()}
    assert out == {"p_1": None, "p_1__b_1__div_1": "p_1", "p_2": None, "p_2__b_1": "p_2"}


def test_single(spark):
    x = nodes(spark, [("a_1", "t", False, 9), ("a_1__b_1", "t", False, 8), ("a_1__b_1__c_1", "t", False, 8), ("a_1__b_1__c_1__d_1", "u", False, 7), ("e_1", "", False, 5), ("e_1__img_1", "", True, 5)])
    out = {r["id"]: (r["parent"], r["image"]) for r in trees.without_single(x, "page").collect()}
    assert out == {"a_1": (None, False), "a_1__b_1__c_1__d_1": ("a_1", False), "e_1": (None, True)}


def test_images(spark):
    box = lambda x, y: (float(x), float(y), 10.0, 10.0)
    rows = [("r_1", False, box(0, 0), ""), ("r_1__img_1", True, box(0, 0), "a"), ("r_1__img_2", True, box(11, 3), "b"), ("s_1", False, box(0, 0), ""), ("s_1__img_1", True, box(0, 0), "c"), ("s_1__img_2", True, box(40, 40), "d")]
    x = spark.createDataFrame([(1, i, i, k, t, im, b) for k, (i, im, b, t) in enumerate(rows)], NODE)
    out = {r["id"]: (r["image"], r["text"]) for r in trees.merged_images(x, "page").collect()}
    assert out == {"r_1": (True, "a b"), "s_1": (False, ""), "s_1__img_1": (True, "c"), "s_1__img_2": (True, "d")}


def test_subdivided_and_rolled_up(spark):
    x = nodes(spark, [("a_1", "", False, 10), ("a_1__b_1", "", False, 10), ("a_1__b_1__c_1", "", False, 4), ("a_1__b_1__c_2", "", False, 4), ("a_1__b_2", "", False, 10)])
    out = trees.subdivided(x, x.where("id = 'a_1'"), "page", F.lit(10.0), 1)
    assert {r["id"] for r in out.collect()} == {"a_1__b_1", "a_1__b_2"}
    g = spark.createDataFrame([(1, "top", "a_1"), (1, "mid", "a_1__b_1"), (1, "mid", "a_1__b_2"), (1, "low", "a_1__b_1__c_1")], "page int, grp string, node string")
    assert {(r["grp"], r["below"]) for r in trees.rolled_up(g, "page", "grp", "node").collect()} == {("top", "mid"), ("mid", "low")}
    empty = x.where("page = 0")
    for f in (trees.without_empty, trees.without_dressing, trees.without_single, trees.merged_images, trees.leaf_counts):
        assert f(empty, "page").count() == 0


def test_sections(spark):
    box = lambda x, y, w, h: (float(x), float(y), float(w), float(h))
    boxes = [box(0, 0, 1000, 3000), box(0, 0, 1000, 100), box(10, 10, 300, 50), box(0, 150, 500, 200), box(500, 160, 500, 180), box(0, 500, 400, 100), box(20, 520, 100, 20), box(0, 700, 1000, 300), box(0, 1100, 600, 50)]
    rows = [(1, f"n{k}", f"n{k}", k, "", False, b) for k, b in enumerate(boxes)]
    x = spark.createDataFrame(rows, NODE)
    sizes = spark.createDataFrame([(1, 1000.0, 3000.0), (2, 10.0, 10.0)], "page int, page_w double, page_h double")
    assert {r["id"] for r in trees.sections(x, sizes, "page").collect()} == {"n1", "n3", "n4", "n5", "n7", "n8"}
    assert trees.sections(x.where("page = 0"), sizes, "page").count() == 0


def test_sections_of_few_leaves(spark):
    """Sections in one call with their subdivision: a wide section of four leaves gives way, a narrow-children one stays."""
    box = lambda y, h, w=1000.0: (0.0, float(y), w, float(h))
    rows = [("b_1", box(0, 400)), *[(f"b_1__p_{k}", box(100 * k - 100, 100)) for k in (1, 2, 3, 4)], ("b_2", box(400, 400)), *[(f"b_2__p_{k}", box(300 + 100 * k, 100, 500.0)) for k in (1, 2, 3, 4)]]
    x = spark.createDataFrame([(1, i, "p", k, "", False, b) for k, (i, b) in enumerate(rows)], NODE)
    sizes = spark.createDataFrame([(1, 1000.0, 2000.0)], "page int, page_w double, page_h double")
    assert {r["id"] for r in trees.sections(x, sizes, "page").collect()} == {"b_1", "b_2"}
    assert {r["id"] for r in trees.sections(x, sizes, "page", most=3).collect()} == {f"b_1__p_{k}" for k in (1, 2, 3, 4)} | {"b_2"}
    assert {r["id"] for r in trees.sections(x, sizes, "page", most=4).collect()} == {"b_1", "b_2"}

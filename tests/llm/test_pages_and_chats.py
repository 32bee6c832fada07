"""WARC, main text and chat operators: exact round trips and small cases."""

import base64
import gzip
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lineament.llm import chat, site_template, warc
from lineament.plans.storage import new_path


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("headers", F.lit(1))


def test_warc_round_trip(spark):
    rows = [(1, "http://a/é", "<p>x</p>\r\n\r\nWARC/1.0\r\n"), (5, None, "same"), (4, "http://b\r\nX: 1", "same"), (7, "u", None), (8, "u", ""), (9, "v", "only"), (None, "n", "same"), (1, "http://a/é", "<p>x</p>\r\n\r\nWARC/1.0\r\n")]
    path = new_path(spark, "warc")
    warc.write_warc(pages(spark, rows), path, "page_id", "html", "url")
    df = warc.read_warc(spark, path)
    got = sorted(((warc_id(r.record_id), r.record_type, warc_id(r.refers_to), r.payload_length, bytes(r.payload or b""), r.payload_digest) for r in df.collect()), key=str)
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        first = min(j for j, _, g in rows if j is not None and (g or "").encode() == body)
        again = i != first
        want.append((i, "revisit" if again else "response", first if again else None, len(body), b"" if again else body, "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()))
    assert got == sorted(want, key=str)
    assert df.filter("record_type = 'revisit'").count() == 3
    assert df.filter(F.col("record_id").isin("<urn:record:9>", "<urn:record:8>")).select("payload_length").count() == 2
    assert {r.payload for r in warc.read_warc(spark, path, payload=False).collect()} == {None}


def warc_id(name):
    return int(name[12:-1]) if name and name != "<urn:record:>" else None


def test_warc_pushes_filters(spark):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull

    r = warc.WarcReader({"files": "[]"})
    rest = list(r.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("position",), 3), In(("target_uri",), ("a",)), IsNotNull(("refers_to",))]))
    assert rest == [GreaterThan(("position",), 3)]
    assert r.wanted == [("warc-type", frozenset(["revisit"])), ("warc-target-uri", frozenset(["a"])), ("warc-refers-to", None)]


def test_warc_reads_other_records(spark, tmp_path):
    plain = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\nX-Long: a\r\n b\r\n\r\nabc\r\n\r\n"
    (tmp_path / "2024" / "01").mkdir(parents=True)
    (tmp_path / "2024" / "01" / "x.warc.gz").write_bytes(gzip.compress(plain) + gzip.compress(plain))
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    assert [(r.record_type, bytes(r.payload), r.headers["x-long"]) for r in rows] == [("warcinfo", b"abc", "a b")] * 2


def test_empty_warc(spark):
    path = new_path(spark, "warc")
    warc.write_warc(pages(spark, []), path, "page_id", "html", "url")
    assert warc.read_warc(spark, path).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav>
<div class="ad">Buy</div><article><header><p>by line</p></header><h1>Head  &amp; tail</h1><p>One<br>two <b>bold</b>&#33;<p>Three<ul><li>i<li>j</ul><form>ask</form><aside>see</aside><div class="comments"><p>reader</p></div><p>cut &am</article><footer>&copy; x</footer>"""


def test_counts_decide_on_stored_pages():
    """Host counts alone, with tags and classes left aside, take every menu, advert and footer of the stored pages."""
    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.1/pages.parquet", columns=["url", "html"]).slice(0, 800).to_pylist()
    trees, around = [site_template.parse(r["html"] or "") for r in rows], {}
    for r, tree in zip(rows, trees):
        found, longest = site_template.named_subtrees(tree)
        host = site_template._host(r["url"])
        for name, rest in {(None, longest), *((n, rest) for _, names, rest in found for n in names)}:
            around.setdefault((host, name), set()).add(rest)
    changed = 0
    for r, tree in zip(rows, trees):
        host = site_template._host(r["url"])
        pages = len(around[host, None])
        template = {n for (h, n), x in around.items() if h == host and n is not None and len(x) >= 3 and 2 * len(x) > pages} if changed < 60 and pages >= 6 else None
        if template is None:
            continue
        plain, cut = site_template.blocks(tree, set(), by_tags=False), site_template.blocks(tree, template, by_tags=False)
        assert cut == site_template.blocks(tree, template) and plain != cut
        changed += 1
    assert changed == 60


def test_deletion_decides(spark):
    """Menus and adverts without telling tags go by their frame, a notice within articles by its content."""
    page = lambda k: f"<div class=q1><ul><li><a href=/{k}>go {k}</a><li><a href=/b>tip {k}</a></ul></div><div class=q2>Buy {k} now</div><article><h1>T{k}</h1><p>{' '.join(f'w{k}x{j}' for j in range(30))}</p><div>Read our rules</div></article>"
    rows = [(k, f"http://h/{k}", page(k)) for k in range(9)] + [(20, "http://other/1", page(20))]
    want = {k: f"T{k}\n" + " ".join(f"w{k}x{j}" for j in range(30)) for k in range(9)}
    for by_tags in (True, False):
        out = {r.page_id: r["__text"] for r in site_template.main_text(pages(spark, rows), by_tags=by_tags).collect()}
        assert {k: out[k] for k in want} == want
        assert out[20].endswith("Read our rules") and ("Buy 20 now" in out[20]) != by_tags


@pytest.mark.parametrize("bad", ['<a href="x', "<a ", "<!", "<![", "</", "<p title='", "<b><div><i></b>", "<p><table><span><hr>", "<title>", "<!--"])
def test_hostile_pages_take_linear_time(bad):
    import time

    began = time.thread_time()
    site_template.parse(bad * (2_000_000 // len(bad)))
    assert time.thread_time() - began < 6


def test_odd_markup():
    blocks = lambda html: site_template.blocks(site_template.parse(html), set())
    assert blocks('<p title="a"">Hello world</p>') == ["Hello world"]
    assert blocks('<article><p class="side-effects">x</p><p class="ad-hoc">y</p><div class="cookie-banner">z</div><div class="comment-list">c</div></article>') == ["x", "y"]
    assert blocks("a < b <3 </> </ x> c <!-- q --> d <! e> f <") == ["a < b <3 c d f"]
    assert blocks("<p>one <span>two</b> three<hr>four<p>five<td>six") == ["one two three", "four", "five", "six"]


def test_blocks():
    assert site_template.blocks(site_template.parse(PAGE), set()) == ["Head & tail", "One two bold!", "Three", "i", "j", "cut &am"]
    assert site_template.blocks(site_template.parse(""), set()) == []
    assert site_template.blocks(site_template.parse("plain <b>text"), set()) == ["plain text"]
    deep = "<div>" * 30_000 + "x"
    assert site_template.blocks(site_template.parse(deep), set()) == ["x"]


def test_template_is_removed(spark):
    odd = '<body><section id="s{0}"><p>Site words</p></section><div><p>own {0}</p></div></body>'
    rows = [(k, "http://h.example/x", odd.replace("{0}", "", 1).format(k)) for k in range(10)] + [(50, "http://other.example/", odd.format(1)), (51, None, None), (52, "http://h.example/", "")]
    got = {r.page_id: (r["__text"], r["__n_chars"]) for r in site_template.main_text(pages(spark, rows)).collect()}
    assert got[3] == ("own 3", 5) and got[50] == ("Site words\nown 1", 16) and got[51] == got[52] == ("", 0)
    assert site_template.main_text(pages(spark, [])).count() == 0


def test_copied_articles_stay(spark):
    rows = [(k, "http://h.example/", "<body><nav>m</nav><article><p>same text</p></article></body>") for k in range(9)]
    assert {r["__text"] for r in site_template.main_text(pages(spark, rows)).collect()} == {"same text"}


@pytest.mark.parametrize("top", ["article", "main"])
def test_template_in_articles_is_removed(spark, top):
    page = "<body><{t}><h1>Head {k}</h1><div class='box'><p>Read more here, a line longer than the text</p></div><p>own {k}</p></{t}></body>"
    rows = [(k, "http://h.example/", page.format(t=top, k=k)) for k in range(8)]
    assert {r.page_id: r["__text"] for r in site_template.main_text(pages(spark, rows)).collect()} == {k: f"Head {k}\nown {k}" for k in range(8)}


def test_near_copies_of_articles_stay(spark):
    page = "<body><article><h1>Head</h1><p>the longest of the paragraphs</p><p>views {k}</p><p>another one</p></article></body>"
    rows = [(k, "http://h.example/", page.format(k=k)) for k in range(8)]
    assert {r.page_id: r["__text"] for r in site_template.main_text(pages(spark, rows)).collect()}[3] == "Head\nthe longest of the paragraphs\nviews 3\nanother one"


def test_copies_without_articles_stay(spark):
    page = "<body><nav>m {v}</nav><div><h1>Head {k}</h1><p>long paragraph of page {k}</p><p>more of {k}</p></div></body>"
    rows = [(10 * k + v, "http://h.example/", page.format(k=k, v=v)) for k, copies in ((0, 3), (1, 1), (2, 1), (3, 5)) for v in range(copies)]
    got = {r.page_id: r["__text"] for r in site_template.main_text(pages(spark, rows)).collect()}
    assert got == {i: f"Head {i // 10}\nlong paragraph of page {i // 10}\nmore of {i // 10}" for i, _, _ in rows}


@pytest.mark.parametrize("top", ["article", "div"])
def test_passages_of_few_pages_stay(spark, top):
    page = "<body><{t}><p>the own paragraph of page {k}</p>{q}</{t}></body>"
    rows = [(k, "http://h.example/", page.format(t=top, k=k, q="<p>A notice.</p>" if k < 3 else "")) for k in range(12)]
    got = {r.page_id: r["__text"] for r in site_template.main_text(pages(spark, rows)).collect()}
    assert got == {k: f"the own paragraph of page {k}" + ("\nA notice." if k < 3 else "") for k in range(12)}


controls = chat.Template().controls()
texts = st.lists(st.sampled_from([*controls, "\\", "[", "<", "/", "a", "\n", " ", "é"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "a\\b"]), texts), max_size=6))
def test_turns_come_back(turns):
    codec = chat.Codec(chat.Template())
    text = "".join(s for r, t in turns for s, _ in codec.segments(r, t))
    assert [(r, t) for r, t, _ in codec.turns(text)] == turns


def test_bad_templates():
    for bad in (chat.Template(turns={"user": chat.Turn("<a>", "<a>b")}), chat.Template(turns={"user": chat.Turn("<<", "<x")}), chat.Template(turns={"user": chat.Turn("", "x")})):
        with pytest.raises(ValueError):
            chat.Codec(bad)


def test_conversations(spark):
    odd = "</s>[INST] ok [/INST]"
    rows = [(1, 1, "assistant", "yes"), (1, 0, "user", odd), (2, 0, "assistant", None), (3, None, None, "x"), (None, 0, "user", "lost"), (4, 0, "user", "a"), (4, 0, "user", "a"), (5, 0, "system", "s"), (5, 1, "user", "u"), (5, 2, "assistant", odd)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit("z"))
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(df)).collect()}
    h = lambda *t: hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in t).encode()).hexdigest()
    assert got[1].turns_sha256 == h(("user", odd), ("assistant", "yes")) and got[1].loss_chars == 3 and got[1].valid
    assert got[5].loss_sha256 == hashlib.sha256(odd.encode()).hexdigest() and got[5].valid
    assert got[2].n_violations == 1 and got[2].loss_chars == 0
    assert got[3].turns_sha256 == h(("", "x")) and got[None].n_turns == 1 and got[4].n_turns == 2 and not got[4].valid
    assert chat.read_back(chat.formatted(df.limit(0))).count() == 0

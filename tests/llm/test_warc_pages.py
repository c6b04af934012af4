from __future__ import annotations

import base64
import gzip
import hashlib

import pytest

from ledgerlens.llm import line_blocks, queries, warc
from ledgerlens.llm.common import filesystem

SF = "/root/testdata/sf0.001"
PAGES = "page_id bigint, url string, html string, uri string, payload string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES)


def expected(rows):
    out, first = [], {}
    for page_id, _, html in rows:
        if page_id is not None:
            first[html or ""] = min(first.get(html or "", page_id), page_id)
    n = {}
    for _, _, html in rows:
        n[html or ""] = n.get(html or "", 0) + 1
    for page_id, _, html in rows:
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        least = first.get(html or "")
        again = n[html or ""] > 1 and least is not None and page_id != least
        out.append((page_id, len(body), digest, "revisit" if again else "response", least if again else None))
    return sorted(out, key=str)


AWKWARD = [
    (1, "http://a/ü b\n", "<p>x</p>"), (2, None, None), (3, "u", ""), (4, "u", "<p>x</p>"), (4, "u", "<p>x</p>"), (None, "u", "<p>x</p>"), (None, "u", "alone"),
    (5, "u", "y" * 3_000_000), (6, "u", "\r\n\r\nWARC/1.1\r\n\x1f\x8b\x08 é \U0001f600"),
]


@pytest.mark.parametrize("split", [40, 1000, 1 << 23])
def test_archives_at_any_split(spark, split):
    manifest = warc.write_warc(pages(spark, AWKWARD), file_bytes=2000)
    rows = warc.read_warc(manifest, split_bytes=split).collect()
    assert sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in rows), key=str) == expected(AWKWARD)
    bodies = {r["page_id"]: r["payload"] for r in rows if r["record_type"] == "response"}
    assert bodies[5] == b"y" * 3_000_000 and bodies[6].decode() == AWKWARD[-1][2]


def test_archives_are_plain_gzip_members(spark):
    manifest = warc.write_warc(pages(spark, AWKWARD)).collect()
    text = b""
    for row in manifest:
        system, path = filesystem(row["uri"])
        data = system.open_input_file(path).read()
        assert len(data) == row["size"]
        text += gzip.decompress(data)
    assert text.count(b"WARC-Type: response") + text.count(b"WARC-Type: revisit") == len(AWKWARD)


def test_false_magic_is_passed_over(tmp_path):
    body = b"payload"
    member = warc.response_member(1, "u", body, warc.digest32(body))
    path = tmp_path / "x.warc"
    path.write_bytes(b"\x1f\x8b\x08 no member" + gzip.compress(b"not a record") + member + b"\x1f\x8b" + member)
    size = path.stat().st_size
    for step in (1, 7, size):
        found = [place for at in range(0, size, step) for place, *_ in warc.records(str(path), at, min(at + step, size))]
        assert len(found) == 2
    path.write_bytes(member[:-20])
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.records(str(path), 0, size))


def test_warc_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, queries.op3_warc(spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == expected(rows)


def test_no_pages(spark):
    empty = pages(spark, [])
    assert warc.read_warc(warc.write_warc(empty)).count() == 0
    assert line_blocks.extract_main_text(empty).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>";</script></head><body class="has-sidebar">
<header><a href=/>Site</a></header><nav><ul><li>Menu one</li></ul></nav><div id="cookie-notice">We use cookies, please agree to all of them now</div>
<div class="ad">Buy this very good thing today</div>%s<aside>Side bar text that is long enough to matter here</aside>
<section class="comments"><article>A reader says something at length about it</article></section><form>Name <input name=x></form>
<footer>&copy; all of it</footer></body></html>"""
ARTICLE = "<h1>Head &amp; tail</h1><p>First   paragraph <b>with</b>\n markup&#33;</p><p>Short.<p>Third<br>line"


@pytest.mark.parametrize("shape", ["<article>%s</article>", "<main><div class=post>%s</div></main>", "<div class=post>%s</div>", "%s"])
def test_article_without_furniture(shape):
    assert line_blocks.main_text(PAGE % (shape % ARTICLE)) == "Head & tail\nFirst paragraph with markup!\nShort.\nThird line"


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), ("<p></p>", ""), ("plain <unclosed", "plain <unclosed"), ("<script>x", "x"), ("<nav>Menu<article><p>Text</p></article>", "Text"), ("a" * 200_000, "a" * 200_000), ("<p>&lt;b&gt; &nbsp; x</p>", "<b> x"), ("<p a='>'>q</p><!-- c <p>no</p> -->", "q")])
def test_odd_pages(page, text):
    assert line_blocks.main_text(page) == text


def test_text_query(spark):
    import html
    import re

    rows = {r["page_id"]: r for r in queries.op6_main_text(spark, SF).collect()}
    for page in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = re.search(r"<article>(.*)</article>", page["html"], re.DOTALL)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", b)))).strip() for b in re.split(r"</?(?:p|h1)>", article)]
        text = "\n".join(b for b in blocks if b)
        assert (rows[page["page_id"]]["text"], rows[page["page_id"]]["n_chars"]) == (text, len(text))
        unmarked = page["html"].replace("<article>", "<div>").replace("</article>", "</div>")
        for tag in ("nav", "footer"):
            unmarked = unmarked.replace(f"<{tag}>", "<div>").replace(f"</{tag}>", "</div>")
        assert line_blocks.main_text(unmarked) == text

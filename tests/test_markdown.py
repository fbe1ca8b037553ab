"""CommonMark: the standard's rules on small texts, odd input, and pages that use it."""

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from presswork.functions.markdown import commonmark_html, render

CASES = [
    ("# T\ntext", "<h1>T</h1>\n<p>text</p>\n"),
    ("Intro\n- a\n- b", "<p>Intro</p>\n<ul>\n<li>a</li>\n<li>b</li>\n</ul>\n"),
    ("1. one\n2. two", "<ol>\n<li>one</li>\n<li>two</li>\n</ol>\n"),
    ("3) x\n4) y", "<ol start=\"3\">\n<li>x</li>\n<li>y</li>\n</ol>\n"),
    ("> quote\nlazy\n\nafter", "<blockquote>\n<p>quote\nlazy</p>\n</blockquote>\n<p>after</p>\n"),
    ("- a\n  - b\n    - c\n- d", "<ul>\n<li>a\n<ul>\n<li>b\n<ul>\n<li>c</li>\n</ul>\n</li>\n</ul>\n</li>\n<li>d</li>\n</ul>\n"),
    ("- a\n\n- b", "<ul>\n<li>\n<p>a</p>\n</li>\n<li>\n<p>b</p>\n</li>\n</ul>\n"),
    ("- a\n\n  b\n- c", "<ul>\n<li>\n<p>a</p>\n<p>b</p>\n</li>\n<li>\n<p>c</p>\n</li>\n</ul>\n"),
    ("```py\nx < 1\n\n```\nz", "<pre><code class=\"language-py\">x &lt; 1\n\n</code></pre>\n<p>z</p>\n"),
    ("    code\n\n    more\n\nt", "<pre><code>code\n\nmore\n</code></pre>\n<p>t</p>\n"),
    ("_emph_ and __strong__ snake_case_x", "<p><em>emph</em> and <strong>strong</strong> snake_case_x</p>\n"),
    ("***a** b*", "<p><em><strong>a</strong> b</em></p>\n"),
    ("**a *b* c**", "<p><strong>a <em>b</em> c</strong></p>\n"),
    ("*foo**bar*", "<p><em>foo**bar</em></p>\n"),
    ("a  \nb\\\nc", "<p>a<br />\nb<br />\nc</p>\n"),
    ("`` a`b ``", "<p><code>a`b</code></p>\n"),
    ("[x](http://a/?b=1&c \"t\") ![i *j*](/u)", "<p><a href=\"http://a/?b=1&amp;c\" title=\"t\">x</a> <img src=\"/u\" alt=\"i j\" /></p>\n"),
    ("[foo]\n\n[foo]: /url 'the title'", "<p><a href=\"/url\" title=\"the title\">foo</a></p>\n"),
    ("Head\n===\nSub\n---\n", "<h1>Head</h1>\n<h2>Sub</h2>\n"),
    ("***\n---\n___", "<hr />\n<hr />\n<hr />\n"),
    ("a\n***\nb", "<p>a</p>\n<hr />\n<p>b</p>\n"),
    ("<b>x</b> &amp; &copy; <http://a.b>", "<p>&lt;b&gt;x&lt;/b&gt; &amp; © <a href=\"http://a.b\">http://a.b</a></p>\n"),
    ("> - a\n> - b\n>\n> c", "<blockquote>\n<ul>\n<li>a</li>\n<li>b</li>\n</ul>\n<p>c</p>\n</blockquote>\n"),
    ("- a\n> q", "<ul>\n<li>a</li>\n</ul>\n<blockquote>\n<p>q</p>\n</blockquote>\n"),
    ("- foo\n\n      bar", "<ul>\n<li>\n<p>foo</p>\n<pre><code>bar\n</code></pre>\n</li>\n</ul>\n"),
    ("1.  A\n\n    > q", "<ol>\n<li>\n<p>A</p>\n<blockquote>\n<p>q</p>\n</blockquote>\n</li>\n</ol>\n"),
    ("- \n  foo", "<ul>\n<li>foo</li>\n</ul>\n"),
    ("-\n\n  foo", "<ul>\n<li></li>\n</ul>\n<p>foo</p>\n"),
    ("- a\n-\n- c", "<ul>\n<li>a</li>\n<li></li>\n<li>c</li>\n</ul>\n"),
    ("The number is\n14. no", "<p>The number is\n14. no</p>\n"),
    ("# foo ##\n####### x\n#5", "<h1>foo</h1>\n<p>####### x\n#5</p>\n"),
    ("\\*not\\* \\a", "<p>*not* \\a</p>\n"),
    ("[a [b](c) d](e)", "<p>[a <a href=\"c\">b</a> d](e)</p>\n"),
    ("*[x*](y)", "<p>*<a href=\"y\">x*</a></p>\n"),
    ("- a\n - b\n  - c", "<ul>\n<li>a</li>\n<li>b</li>\n<li>c</li>\n</ul>\n"),
    ("- a\n* b", "<ul>\n<li>a</li>\n</ul>\n<ul>\n<li>b</li>\n</ul>\n"),
    ("> ```\n> x\nout", "<blockquote>\n<pre><code>x\n</code></pre>\n</blockquote>\n<p>out</p>\n"),
    ("", ""),
    ("- a\n  > b\n  ```\n  c\n  ```\n- d", "<ul>\n<li>a\n<blockquote>\n<p>b</p>\n</blockquote>\n<pre><code>c\n</code></pre>\n</li>\n<li>d</li>\n</ul>\n"),
    ("\tfoo", "<pre><code>foo\n</code></pre>\n"),
    ("- foo\n\n\tbar", "<ul>\n<li>\n<p>foo</p>\n<p>bar</p>\n</li>\n</ul>\n"),
    ("foo\n    bar", "<p>foo\nbar</p>\n"),
    ("* * *", "<hr />\n"),
    ("- foo\n***\n- bar", "<ul>\n<li>foo</li>\n</ul>\n<hr />\n<ul>\n<li>bar</li>\n</ul>\n"),
    ("```\naaa", "<pre><code>aaa\n</code></pre>\n"),
    ("```\n```", "<pre><code></code></pre>\n"),
    ("foo*bar*baz 5*6*7", "<p>foo<em>bar</em>baz 5<em>6</em>7</p>\n"),
    ("**foo", "<p>**foo</p>\n"),
    ("*a `*`*", "<p><em>a <code>*</code></em></p>\n"),
    ("__foo, __bar__, baz__", "<p><strong>foo, <strong>bar</strong>, baz</strong></p>\n"),
    ("- a\r\n- b\rc", "<ul>\n<li>a</li>\n<li>b\nc</li>\n</ul>\n"),
    ("![][x]\n\n[X]: <a b> (t)", '<p><img src="a%20b" alt="" title="t" /></p>\n'),
    ("<x@y.example>", '<p><a href="mailto:x@y.example">x@y.example</a></p>\n'),
]


@pytest.mark.parametrize("text, html", CASES)
def test_rules(text, html):
    assert render(text) == html


def test_raw_html_on_demand(spark):
    assert render("a <b class='x'>c</b> < d", raw_html=True) == "<p>a <b class='x'>c</b> &lt; d</p>\n"
    row = spark.createDataFrame([("*a*",), ("",), (None,)], "t string").select(commonmark_html(F.col("t")).alias("h")).collect()
    assert [r.h for r in row] == ["<p><em>a</em></p>\n", "", None]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab *_`[]()!<>#-+1.\\\n\t&\"'~=:", max_size=60))
def test_any_text_gives_balanced_tags(text):
    html = render(text)
    for tag in ("p", "em", "strong", "ul", "ol", "li", "blockquote", "pre", "code"):
        assert html.count(f"</{tag}>") == html.count(f"<{tag}>") + html.count(f"<{tag} ")


@pytest.mark.parametrize("text", [">" * 5000 + "a", "[" * 20_000, "*a " * 20_000, "- " * 3000 + "x", "a **" * 20_000, "_(_" * 10_000, "".join("`" * k + " " for k in range(200))])
def test_long_odd_texts_end(text):
    assert render(text)

import pytest

from tillbook.llm.html_text import main_text, smoothed

LONG = "This is a long enough sentence with some words in it, and here is another clause."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        (f"<nav>Menu</nav><article><h1>A title</h1><p>{LONG}</p><p>x</p></article><footer>(c)</footer>", f"A title {LONG} x"),
        (f"<article><p>one<b>two</b>  three\n four<br>five</p><ul><li>a<li>b</ul><p>{LONG}", f"onetwo three four five a b {LONG}"),
        ("<article><p>a &amp; b &lt;c&gt; &eacute;&#233;&nbsp;d</p></article>", "a & b <c> éé d"),
        (f"<div class='ad'>Buy now</div><main><p>{LONG}</p><div class='share-buttons social'>Tweet</div></main>", LONG),
        (f"<header>Site</header><article><header><h2>Head</h2></header><p>{LONG}</p><aside>Aside</aside><form><label>Mail</label></form></article>", f"Head {LONG}"),
        (f"<article><p>{LONG}</p></article><section id='comments'><article class='comment'><p>{LONG} First!</p></article></section>", LONG),
        (f"<div id='cookie-notice'>We use cookies. {LONG}</div><div class='content'><p>{LONG}</p><p>{LONG}</p></div>", f"{LONG} {LONG}"),
        (f"<script>var t='</p><article>no';</script><style>p{{}}</style><article><p>{LONG}</p><script>x</script></article>", LONG),
        (f"<article><p>{LONG}<!-- hidden --><p hidden>no<p style='display:none'>no<p>yes</article>", f"{LONG} yes"),
        (f"<body><nav><ul><li><a>open<article><p>{LONG}</p></article>", LONG),
        (f"<body class='has-sidebar'><article class='no-comments'><p>{LONG}</p></article>", LONG),
        ("<article>Thes in.<p><b>Thes in.<br></article>", "Thes in. Thes in."),
        ("just text", "just text"),
        (f"<article><h1>T</h1><div class='content'><p>{LONG}</p><section class='story'><p>End.</p></section></div></article>", f"T {LONG} End."),
        (f"<main><p>Before.</p><article><p>{LONG}</p></article></main>", LONG),
        (f"<div class='post'><p>{LONG}</p><table><tr><td>1<td>2</table></div><div class='widget'>{LONG}</div>", f"{LONG} 1 2"),
    ],
)
def test_main_text(html, text):
    assert main_text(html) == text


def test_page_without_containers():
    links = "".join(f"<li><a href='/{i}'>link {i}</a></li>" for i in range(12))
    paragraphs = "".join(f"<p>{LONG} {i}</p>" for i in range(6))
    found = main_text(f"<html><body><ul>{links}</ul>{paragraphs}<ul>{links}</ul></body></html>")
    assert found == " ".join(f"{LONG} {i}" for i in range(6))


def test_ratios_decide_over_names():
    paragraphs = "".join(f"<p>{LONG} {i}</p>" for i in range(8))
    whole = " ".join(f"{LONG} {i}" for i in range(8))
    card = "<article class='card'><a href='/x'><b>More</b></a></article>"
    assert main_text(f"<main>{paragraphs}{card}</main>") == whole
    assert main_text(f"<body>{paragraphs}{card}</body>") == whole
    assert main_text(f"<main>{paragraphs}<article class='card'><p>A teaser.</p></article></main>").startswith(whole)
    half = "".join(f"<p>{LONG} {i}</p>" for i in range(8, 16))
    assert main_text(f"<main>{paragraphs}<article>{half}</article></main>") == " ".join(f"{LONG} {i}" for i in range(16))
    assert main_text(f"<article>{paragraphs}</article><article class='card'><a href='/x'><b>More</b></a></article>") == whole


def test_containers_may_be_boilerplate():
    comment = f"<article class='comment'><p>{LONG} First!</p></article>"
    assert main_text(f"<article><p>{LONG}</p></article>{comment}") == LONG
    assert main_text(f"<article><p>{LONG}</p>{comment}</article>") == LONG
    assert main_text(comment) == f"{LONG} First!"
    assert main_text(f"<article class='post format-aside'><p>{LONG}</p></article>") == LONG


def test_smoothing_keeps_a_constant():
    assert smoothed(__import__("numpy").ones(7)).tolist() == pytest.approx([1.0] * 7)

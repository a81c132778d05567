"""Pages and their main text."""

ARTICLE = "<p>One, two three. Four; five six seven, eight nine ten.</p><p>Short.</p>"
TEXT = "One, two three. Four; five six seven, eight nine ten.\n\nShort."
PAGES = [
    ("", ""), ("<p", ""), ("<script>x, y.", ""), ("plain &amp; text", "plain & text"), ("a < b, c", "a < b, c"),
    (f"<html><head><title>T, t.</title></head><body><nav><ul><li><a href=/>Home</a></ul></nav>{ARTICLE}<footer>f, g.</footer>", TEXT),
    (f"<body><header>Site, head.</header><div class='wrap'><div id=main-text>{ARTICLE}</div><div class=sidebar><p>Side, bar. A, b, c.</p></div></div>", TEXT),
    (f"<article><h1>Title</h1>{ARTICLE}</article><section class='comments'><p>Nice one, thanks. I, too, think so.</p></section>", "Title\n\n" + TEXT),
    (f"<main>{ARTICLE}<form><p>Your name, please.</p><button>Go</button></form><aside><p>By the way, a.</p></aside></main>", TEXT),
    (f"<div class=cookie-notice>We use cookies, ok.</div><article>{ARTICLE}<div class='ad'>Buy, now.</div></article>", TEXT),
    ("<article><p><b>First, part.<br>next<p>Second &eacute;&nbsp;x, y.<ul><li>l, one<li>two</ul></article>", "First, part. next\n\nSecond é x, y.\n\nl, one\n\ntwo"),
    (f"<article>{ARTICLE}<!-- <p>no, no.</p> --><style>p{{}}</style><script>var t='</p>';</script></article>", TEXT),
]

"""Pages whose main text was lost."""

from journalsieve.llm import html_cut

LONG = "A long paragraph with many words, that goes on and on for some time, and then some more. It ends here."


def test_raw_elements_end_where_lower_case_is_longer():
    for name in ("SCRIPT", "Style", "script"):
        page = f"<article><p>\u0130stanbul. {LONG}</p><{name.lower()}>var x = 1;</{name}><p>After. {LONG}</p></article>"
        assert html_cut.extract(page)[0] == f"\u0130stanbul. {LONG}\n\nAfter. {LONG}"


def test_names_of_the_articles_own_element():
    for tag in ("article class='post category-social'", "main class=has-sidebar", "article class='post comments-open'",
                "div class='content with-sidebar'", "div id=content class=with-sidebar", "div role=main class=no-menu"):
        end = tag.split()[0]
        page = (f"<{tag}><div class=entry-header><h1>The title</h1></div><p>{LONG}</p><div class=sidebar>Most read today."
                f"</div><div class=post-comments><p>I say: {LONG}</p></div></{end}>")
        assert html_cut.extract(page)[0] == f"The title\n\n{LONG}", tag


def test_names_around_the_text_still_count():
    for tag in ("div class=sidebar", "div class=post-share", "div class=main-menu", "div class='post-comments open'",
                "article class=comment", "section id=comments", "nav class=content"):
        assert html_cut.extract(f"<article><p>{LONG}</p></article><{tag}><p>Beside. {LONG}</p></{tag.split()[0]}>")[0] == LONG


def signs_only(page):
    return "\n\n".join(b.text for b in html_cut.read_page(page)[0] if b.score > 0)


ODD_PAGES = {
    # page: main text
    f"<article><h2>Ham</h2><p>Yes.<p>{LONG}<ul><li>2 eggs<li>flour<li>1 l of milk</ul><p>{LONG}</article>":
        f"Ham\n\nYes.\n\n{LONG}\n\n2 eggs\n\nflour\n\n1 l of milk\n\n{LONG}",
    f"<div class=post><p>{LONG}<figure><img src=x><figcaption>Harbour</figcaption></figure><p>So.</div><footer><p>{LONG}</footer>":
        f"{LONG}\n\nHarbour\n\nSo.",
    f"<article><p>{LONG}<ol><li><a href=1>Smith, The history of the harbour and its many ships, 1999</a>"
    f"<li><a href=2>Jones, A short tale of two harbours and a long road, 2003</a></ol></article>":
        f"{LONG}\n\nSmith, The history of the harbour and its many ships, 1999\n\n"
        "Jones, A short tale of two harbours and a long road, 2003",
    f"<div class=elementor-widget>{''.join(f'<p>{i} {LONG} {LONG}</p>' for i in range(14))}<p>Short.</div>"
    f"<div class=widget><p>{LONG}</div>":
        "\n\n".join([*(f"{i} {LONG} {LONG}" for i in range(14)), "Short."]),
    f"<div class='page has-sidebar'><p>{LONG} {LONG}<p>Short.<p>{LONG} {LONG}</div><div class=sidebar><p>{LONG} {LONG}</div>":
        f"{LONG} {LONG}\n\nShort.\n\n{LONG} {LONG}",
    f"<article><p>{LONG}<math><mi>x</mi><mo>=</mo><mn>2</mn></math></p><noscript><p>Shown without scripts.</p></noscript>"
    f"<object data=x>A chart of ships.</object><script>no()</script><p>{LONG}</article>":
        f"{LONG}x=2\n\nShown without scripts.\n\nA chart of ships.\n\n{LONG}",
    f"<main><p>{LONG}</p><div class=comments>{''.join(f'<article><p>{i} {LONG} {LONG}</p></article>' for i in range(30))}</div></main>":
        LONG,
}


def test_the_cut_decides_on_odd_pages():
    turned = blocks = 0
    for page, wanted in ODD_PAGES.items():
        text, n_blocks, _, n_turned = html_cut.extract(page)
        assert text == wanted
        assert signs_only(page) != wanted
        turned, blocks = turned + n_turned, blocks + n_blocks
    assert turned > blocks / 3


def test_labels_of_a_page_are_a_least_cut():
    """All labellings of small pages: none costs less than the one found."""
    pages = [f"<div class=promo><p>{LONG}<p>So.<ul><li>a<li><a href=x>b</a></ul></div><p>{LONG}",
             f"<article><h1>T</h1><div class=widget><p>{LONG}</p><p>{LONG}</p></div><aside>x. <p>y</aside></article>",
             f"<div><div><p>{LONG}</div><p>Hm.<p>{LONG}</div><nav><a href=x>Home</a></nav>"]
    for page in pages:
        scores, edges = html_cut.graph(*html_cut.read_page(page))

        def cost(labels):
            return (sum(max(-s, 0) if x else max(s, 0) for s, x in zip(scores, labels))
                    + sum(c for a, b, c in edges if labels[a] != labels[b]))
        best = min(cost([m >> i & 1 for i in range(len(scores))]) for m in range(1 << len(scores)))
        assert len(scores) < 16 and abs(cost(html_cut.minimum_cut(scores, edges)) - best) < 1e-6

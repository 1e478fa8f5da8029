"""Generated pages of many templates, with the main text that each should give."""

import random

SYLLABLES = "an be ca do el fi go hu in jo ka lu me no or pa qui ra so tu".split()

#: §N links, §S short and §L long boilerplate, §T title, §P paragraph, §Q short paragraph, §I list item: the last four are content
TEMPLATES = [
    "<html><head><title>x</title></head><body><nav><ul>§N§N§N</ul></nav><div class=ad>§L</div><article><h1>§T</h1><p>§P</p><p>§P</p></article><footer>§S</footer></body></html>",
    "<div class='site has-sidebar'><article><h1>§T</h1><p>§P</p><p>§Q</p></article><div class=sidebar><p>§L</p></div></div>",
    "<div class='content-sidebar-wrap'><main><h1>§T</h1><p>§P</p><p>§P</p></main><aside><p>§L</p></aside></div>",
    "<body class='header-fixed page'><div class='header-fixed page'><header><a href=x>§S</a></header><article><p>§P</p><p>§P</p></article></div>",
    "<div class='no-comments post'><h1>§T</h1><p>§P</p><p>§P</p></div><footer><p>§L</p></footer>",
    "<article><h1>§T</h1><p>§P</p><section id=discussion><h2>§T</h2><p>§P</p></section></article><div id=comments><p>§L</p><p>§L</p></div>",
    "<article><p>§P</p><p class='comment-on-law'>§P</p><p>§P</p></article><section class=comments><h3>§S</h3><p>§L</p></section>",
    "<div id=page><div id=masthead><p>§S</p></div><div id=content><h1>§T</h1><p>§P</p><p>§P</p><ul><li>§I</li><li>§I</li></ul></div><div id=footer><p>§L</p></div></div>",
    "<main><article class=post><header><h1>§T</h1></header><p>§P</p><p>§P</p></article></main><div id=comments><ol><li><article class='comment-body'><p>§L</p></article></li><li><article class='comment-body'><p>§L</p></article></li></ol></div>",
    "<table><tr><td class=menu>§N§N</td><td><h1>§T</h1><p>§P</p><p>§P</p></td></tr><tr><td class=copyright>§S</td></tr></table>",
    "<header class='site-header'><h2>§S</h2></header><div class='entry-content'><h1>§T</h1><p>§P</p><blockquote>§P</blockquote></div><div class='related-posts'><p>§L</p></div>",
    "<div class='cookie-notice'><p>§L</p></div><div class=story><h1>§T</h1><p>§P</p><p>§P</p></div>",
    "<div style='display:none'><p>§L</p></div><article><p>§P</p><p>§P</p></article>",
    "<div role=navigation>§N§N§N</div><div role=main><h1>§T</h1><p>§P</p><p>§P</p></div><div role=contentinfo class=footer><p>§S</p></div>",
    "<div class=container><div class=row><div class='col-8 main-column'><h1>§T</h1><p>§P</p><p>§P</p></div><div class='col-4 widgets'><p>§L</p></div></div></div>",
    "<article><h1>§T</h1><p>§P</p><form><p>§L</p><input></form><p>§P</p></article>",
    "<article><h1>§T</h1><div class='share-buttons'>§N§N</div><p>§P</p><h2>§T</h2><p>§P</p></article>",
    "<div class='with-footer layout'><div class='search-enabled'><article><p>§P</p><p>§P</p></article></div><div class=footer>§S</div></div>",
    "<h1>§T</h1><p>§P</p><p>§P</p><p>§P</p><div class='newsletter-signup'><p>§L</p></div>",
    "<article><p>" + "<b>" * 100 + "<div>§P</div>" + "</b>" * 100 + "<p>§P</p></article><footer>§S</footer>",
    "<article><p><i>§P<p><b>§P</article><div class=promo>§L</div>",
    "<div class='page no-sidebar'><div class='breadcrumbs'>§N§N</div><div class=prose><h1>§T</h1><p>§P</p><p>§P</p></div><div class='pagination'>§N§N</div></div>",
    "<article><h1>§T</h1>" + "<p>§P</p>" * 40 + "</article><div class='sponsored'><p>§L</p></div><footer>§S</footer>",
    "<section class=articles><article><h1>§T</h1><p>§P</p><p>§P</p></article></section><aside class=related><p>§L</p></aside><nav>§N§N</nav>",
]


def words(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def sentence(rng, n):
    return words(rng, n).capitalize() + "."


def fill(template, rng):
    """(html, text) of a template: each mark gets a text of its kind."""
    out, want = [], []
    for k, piece in enumerate(template.split("§")):
        if not k:
            out.append(piece)
            continue
        kind, rest = piece[0], piece[1:]
        if kind == "N":
            out.append(f"<li><a href='/{k}'>{words(rng, 1)}</a></li>")
        elif kind == "S":
            out.append(words(rng, 4))
        elif kind == "L":
            out.append(sentence(rng, rng.randint(12, 30)))
        else:
            n = {"T": (4, 9), "P": (25, 60), "Q": (5, 8), "I": (6, 12)}[kind]
            text = words(rng, rng.randint(*n)).capitalize() if kind == "T" else sentence(rng, rng.randint(*n))
            out.append(text)
            want.append(text)
        out.append(rest)
    return "".join(out), "\n".join(want)


def pages(seed, copies=8):
    rng = random.Random(seed)
    return [fill(t, rng) for t in TEMPLATES for _ in range(copies)]

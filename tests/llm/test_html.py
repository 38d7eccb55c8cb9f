"""The page tree and its densities against plain recursive versions; broken and very long pages."""

import math
import random
import time

import pytest

from mailgrain.llm import html_density as h

TAGS = "div p b a span li ul ol td tr table dt dd dl section h1 option select tbody thead form".split()


def random_page(rng):
    tokens = []
    for _ in range(rng.randrange(1, 60)):
        kind = rng.random()
        tokens.append(("open", rng.choice(TAGS)) if kind < 0.5 else ("close", rng.choice(TAGS)) if kind < 0.75 else ("text", rng.choice(["x", "some words", " ", "a longer piece of text, " * 3])))
    return tokens


def walked(tokens):
    """The tree as [tag, parent, children], built by walking up from the open element."""
    root = here = ["#root", None, []]
    for kind, x in tokens:
        if kind == "text":
            if here[2] and isinstance(here[2][-1], str):
                here[2][-1] += x
            else:
                here[2].append(x)
            continue
        if kind == "close":
            node = here
            while node is not root and node[0] != x:
                node = node[1]
            if node is not root:
                here = node[1]
            elif x == "p":
                here[2].append(["p", here, []])
            continue
        if x in h.ENDS_P:
            node = here
            while node[0] in h.INLINE:
                node = node[1]
            if node[0] == "p":
                here = node[1]
        if x in h.CLOSES:
            node, scope = here, h.SCOPES.get(x, {"table"})
            while node is not root and node[0] not in scope:
                if node[0] in h.CLOSES[x]:
                    here = node[1]
                node = node[1]
        here[2].append([x, here, []])
        here = here[2][-1]
    return root


def shape(node):
    """(tag, children) of either kind of tree, neighbouring texts joined."""
    tag, children = (node[0], node[2]) if isinstance(node, list) else (node.tag, node.children)
    out = []
    for c in children:
        if isinstance(c, str) and out and isinstance(out[-1], str):
            out[-1] += c
        else:
            out.append(c if isinstance(c, str) else shape(c))
    return tag, out


def nodes_below(node):
    yield node
    for c in node.children:
        if isinstance(c, h.Node):
            yield from nodes_below(c)


def counts(node, in_link=False):
    """(C, T, LC, LT) of a subtree, by its definition: every text and tag counted, those in links again; no dropped block."""
    if node.drop:
        return 0, 0, 0, 0
    counted = node.tag not in h.INLINE or node.tag == "a"
    link = in_link or node.tag == "a"
    total = [0, int(counted), 0, int(node.tag == "a")]
    for c in node.children:
        got = (len(c.strip()), 0, len(c.strip()) if link else 0, 0) if isinstance(c, str) else counts(c, link)
        total = [x + y for x, y in zip(total, got)]
    return tuple(total)


def test_tree_equals_the_walked_one():
    rng = random.Random(5)
    for _ in range(1500):
        tokens = random_page(rng)
        page = "".join(x if k == "text" else f"<{x}>" if k == "open" else f"</{x}>" for k, x in tokens)
        assert shape(h.parse(page)) == shape(walked(tokens)), page


def test_densities_equal_their_definition():
    rng = random.Random(6)
    for _ in range(400):
        page = "".join(x if k == "text" else f"<{x}>" if k == "open" else f"</{x}>" for k, x in random_page(rng) if x != "a")
        page += "<div>Some words <a href=x>and a link</a> <a href=y>or two</a></div>"
        root = h.parse(page)
        order = h._measure(root)
        h._densities(order, root)
        C, _, LC, _ = counts(root)
        assert len(order) == len(list(nodes_below(root)))
        for n in order:
            c, t, lc, lt = counts(n)
            assert (n.chars, n.tags, n.link_chars, n.link_tags) == (c, t, lc, lt)
            base = math.log(c / max(c - lc, 1) * lc + LC / max(C, 1) * c + math.e)
            want = c / max(t, 1) * max(math.log(c / max(lc, 1) * max(t, 1) / max(lt, 1)), 0) / max(math.log(base), 1e-3) if c else 0
            assert n.density == pytest.approx(want)


def test_quotes_open_a_value_only_after_an_equals_sign():
    text = "dear reader, " * 30
    for link in ("<a href=/o'brien>O'Brien</a>", '<a href=/o"brien>O\'Brien</a>', "<a 'x>O'Brien</a>", "<a title='a > b' x>O'Brien</a>", '<a title = "a > b">O\'Brien</a>', "<a href=/a/>O'Brien</a>"):
        assert h.main_text(f"<body><p>Hello {link} {text}</p><p>End</p></body>") == f"Hello O'Brien {text.strip()} End"
    # a quote that nothing closes ends with the tag
    assert h.main_text(f'<body><p title="x>Hello {text}</p><p>It\'s the end</p></body>') == f"Hello {text.strip()} It's the end"
    # names inside values mark nothing
    assert h.main_text(f"<body><div title='class=sidebar' data-id=menu><p>{text}</p></div></body>") == text.strip()
    assert h.main_text(f"<body><p>{text}</p><script>if (a</b) x</script foo><p>After</p><a href='cut").endswith("After")


@pytest.mark.parametrize("page", [
    "<a " * 350_000, "<div>" * 100_000, "<div>" * 50_000 + "</x>" * 50_000, "<li><ul>" + "<div>" * 50_000 + "<li></li>" * 50_000,
    "<p><object>" + "<b>" * 50_000 + "<div></div>" * 50_000, '<a x=">" ' * 50_000, "<script>" + "</script " * 50_000, "<!--" * 100_000,
    "<a b='" * 50_000 + ">", "<" * 500_000, "<div class='" + "a-" * 200_000 + "'>x</div>"],
    ids="open deep stray items inline quotes raw comments values signs class".split())
def test_long_broken_pages_take_linear_time(page):
    began = time.process_time()
    h.main_text(page)
    assert time.process_time() - began < 20

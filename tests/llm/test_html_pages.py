"""Main text of pages whose wrappers, headings or icons look like boilerplate."""

import random
import re

import pytest

from verdictlake.llm.html_blocks import BLOCK, MARKED, SHORT, attributes_of, main_text


@pytest.mark.parametrize("name", ["page-with-sidebar", "no-sidebar", "header-fixed", "has-menu", "menu", "sidebar widget"])
def test_wrapper_of_an_article_is_no_boilerplate(name):
    page = f'<body><nav>Home</nav><div class="{name}"><article><p>Text of the page.</p></article><div class="comments-list"><p>Nice!</p></div></div></body>'
    assert main_text(page) == "Text of the page."


def test_articles_of_comments_stay_out():
    page = '<article><p>Text.</p></article><section class="comments"><article><p>Nice!</p></article></section>'
    assert main_text(page) == "Text."
    assert main_text('<div hidden><article><p>Text.</p></article></div>') == ""


def test_headings_within_an_article():
    page = '<article><h2 id="social">Social</h2><h2 id="social-policy">Policy</h2><div class="article-header"><p>Head</p></div><div class="share">Share</div><p>Text.</p></article>'
    assert main_text(page) == "Social Policy Head Text."


@pytest.mark.parametrize("icon", ["<svg class=i />", "<math/>", "<select>", "<object data=x>", "<canvas>", "<svg><path d='M0'/></svg>"])
def test_text_after_an_icon(icon):
    assert main_text(f"<article><p>One {icon}two.</p><p>Three.</p></article>") == "One two. Three."
    assert main_text(f"<article><p>One.</p></article>{'<script>var x;'}<article>no</article>") == "One."


LONG = "This is the text of the page and it is long enough for the rules to see that it is good. " * 4


def test_short_blocks_take_the_nearer_label():
    page = f"<nav>Menu</nav><div>By A. Writer</div><div>{LONG}</div><div>The end.</div><footer>Foot</footer>"
    assert main_text(page) == f"By A. Writer {LONG.strip()} The end."


def test_single_links_in_an_article():
    page = "<article><h1><a href=x>Title of five words here</a></h1><p>Text.</p><p><a href=y>A paragraph that is one link</a></p><p>More.</p><ul><li><a href=1>one of the many links</a><li><a href=2>two of the many links</a></ul></article>"
    assert main_text(page) == "Title of five words here Text. A paragraph that is one link More."


def test_language_without_listed_stop_words():
    text = "Tämä sivu kertoo järvistä ja metsistä, joita pohjoisessa riittää kaikille kulkijoille vuoden ympäri. " * 4
    assert main_text(f"<nav>Valikko</nav><div>{text}</div><footer>Loppu</footer>") == text.strip()


@pytest.mark.parametrize(
    "attribute",
    ['title="hidden gems"', 'aria-label="The hidden city"', 'data-hidden="false"', 'data-id="menu"', 'data-role="header"', 'title="id=comments"', "title='class=\"menu\" hidden'", "data-x=\"a>b\" title=menu"],
)
def test_attributes_count_by_whole_name(attribute):
    assert main_text(f"<article><div {attribute}><p>Text.</p></div></article>") == "Text."
    assert main_text(f"<article><p {attribute}>Text.</p></article>") == "Text."


def test_attributes_are_read_one_after_the_other():
    assert attributes_of(" a=1 B='x y' c=\"d e\" hidden a=2 data-id = z/") == {"a": "1", "b": "x y", "c": "d e", "hidden": "", "data-id": "z/"}
    assert attributes_of("") == {} and "x" in attributes_of(' = "lost" x')


def test_page_in_a_form():
    assert main_text('<body><form id="aspnetForm"><nav>Menu</nav><article><p>Text.</p></article></form></body>') == "Text."
    assert main_text(f'<body><form action=/><div class=menu>Menu</div><div>{LONG}</div><div>{LONG}</div></form></body>') == f"{LONG.strip()} {LONG.strip()}"
    assert main_text("<article><p>Text.</p><form><p>Mail</p><input></form></article>") == "Text."


def test_short_paragraphs_without_an_article():
    p = "This is a paragraph of the page that isn't long but it is the text that was meant for all of us to read here."
    assert 70 < len(p) < 137
    assert main_text(f"<nav>Menu</nav><div><p>{p}</p><p>{p}</p></div><footer>Foot</footer>") == f"{p} {p}"


def test_short_comments_and_cdata_end_where_html_ends_them():
    assert main_text("<article><p>One.</p><!--><p>Two.</p><!---><p>Three.</p><!-- x --!><p>Four.</p></article>") == "One. Two. Three. Four."
    assert main_text("<article><p>One.</p><![CDATA[x><p>Two.</p></article>") == "One. Two."


def test_hidden_inline_text_buttons_and_custom_elements():
    page = '<article><p>One <span hidden>no</span>two<button>Share</button>, <i style="display: none">no</i>three.</p><x-box class="menu">no</x-box><p>Four.</p><button>no</button></article>'
    assert main_text(page) == "One two, three. Four."


def test_ids_of_sections_are_anchors():
    for name in ("social", "notice", "related"):
        assert main_text(f'<article><section id="{name}"><h2>About</h2><p>Text.</p></section></article>') == "About Text."
        assert main_text(f'<article><p>Text.</p><section class="{name}"><p>no</p></section></article>') == "Text."


# ---- a plain twin: the rules said once more over a tree, with walks in place of positions ----------


class Node:
    def __init__(self, name, attributes, parent):
        self.name, self.attributes, self.parent, self.children = name, attributes, parent, []


def made_page(rng, depth=0):
    """A well-formed page of nested elements as a tree, and its markup."""
    say = lambda n: " ".join(rng.choice(["the", "of", "and", "to", "is", "lake", "forest", "river", "stone", "bird"]) for _ in range(n))
    root = Node("body", {}, None)

    def grow(node, level):
        for _ in range(rng.randrange(1, 5)):
            roll = rng.random()
            if level < 4 and roll < 0.45:
                name = rng.choice(["div", "div", "section", "article", "nav", "footer", "header", "form", "ul", "x-part"])
                mark = {"class": rng.choice(["menu", "cookie-notice", "content", "no-sidebar"])} if rng.random() < 0.3 else {"id": rng.choice(["social", "top"])} if rng.random() < 0.2 else {"hidden": ""} if rng.random() < 0.05 else {}
                child = Node(name, mark, node)
                node.children.append(child)
                grow(child, level + 1)
            else:
                child = Node(rng.choice(["p", "p", "p", "h2", "li"]), {}, node)
                node.children.append(child)
                for _ in range(rng.randrange(1, 3)):
                    text = say(rng.choice([1, 3, 8, 20, 45, 60])) + " "
                    if rng.random() < 0.25:
                        link = Node("a", {"href": "x"}, child)
                        link.children.append(text)
                        child.children.append(link)
                    else:
                        child.children.append(text)

    grow(root, depth)
    return root


def markup(node):
    if isinstance(node, str):
        return node
    attributes = "".join(f' {k}="{v}"' for k, v in node.attributes.items())
    return f"<{node.name}{attributes}>{''.join(map(markup, node.children))}</{node.name}>"


def plain_text(root):
    """The text by both passes, each rule by a walk over the tree or over all blocks."""
    stop = {"the", "of", "and", "to", "is"}

    def ancestors(n):
        while n is not None:
            yield n
            n = n.parent

    def article_of(n):
        found = [a for a in ancestors(n) if a.name == "article"]
        return found[-1] if found else None

    def boilerplate(n):
        """hard, named or None, of the element alone."""
        inside = any(a.name == "article" for a in ancestors(n.parent))
        if n.name in ("nav", "footer") or (n.name == "header" and not inside) or ("hidden" in n.attributes and n.name not in ("body", "article")):
            return "hard"
        word = n.attributes.get("class", "") or ("" if n.name == "section" and inside else n.attributes.get("id", ""))
        whole, last = word in MARKED, word.split("-")[-1] in MARKED and "no" not in word.split("-")
        if n.name not in ("body", "article") and (whole or (last and not inside)):
            return "named"
        return "named" if n.name == "form" else None

    def bad(n, plain):
        return any((k := boilerplate(a)) == "hard" or (k == "named" and a not in plain) for a in ancestors(n))

    leaves = []

    def walk(n):
        for c in n.children:
            if isinstance(c, str) or c.name == "a":
                leaves.append((c if isinstance(c, str) else c.children[0], not isinstance(c, str), n))
            else:
                leaves.append((None, False, None))
                walk(c)
                leaves.append((None, False, None))

    walk(root)
    blocks, run = [], []
    for text, linked, node in [*leaves, (None, False, None)]:
        if node is not None:
            run.append((text, linked, node))
        elif run:
            joined = " ".join("".join(t for t, *_ in run).split())
            blocks.append({"text": joined, "linked": sum(len(t.strip()) for t, is_link, _ in run if is_link), "node": run[0][2]})
            run = []
    articles = [n for n in every(root) if n.name == "article"]
    plain = set()
    if not any(not bad(a, plain) for a in articles):
        hard = lambda n: any(boilerplate(a) == "hard" for a in ancestors(n))
        wrapped = [a for a in articles if not hard(a.parent)]
        if wrapped:
            plain = {x for a in wrapped for x in ancestors(a.parent) if boilerplate(x) == "named"}
        elif not articles or True:
            sizes = {}
            for b in blocks:
                if not hard(b["node"]):
                    named = [x for x in ancestors(b["node"]) if boilerplate(x) == "named"]
                    sizes.setdefault(named[-1] if named else None, []).append(len(b["text"]) - b["linked"])
            total = sum(sum(v) for v in sizes.values())
            most = max(sizes, key=lambda k: sum(sizes[k]), default=None)
            if most is not None and sum(sizes[most]) > 0.5 * total:
                plain = {most}
    for b in blocks:
        b["bad"], b["article"] = bad(b["node"], plain), article_of(b["node"])
        # an article that lies in boilerplate is none
        if b["article"] is not None and b["bad"]:
            b["article"] = None
        b["words"] = b["text"].lower().split()
        b["density"] = b["linked"] / len(b["text"])
        b["heading"] = b["node"].name == "h2"
    free = [b for b in blocks if not b["bad"]]
    prose = [w for b in free if b["density"] <= 0.33 for w in b["words"]]
    listed = sum(w in stop for w in prose) >= 0.15 * len(prose)
    links_only = lambda b: b["density"] > 0.8 and not b["heading"]
    for k, b in enumerate(free):
        share = sum(w in stop for w in b["words"]) / len(b["words"]) if listed else 1.0
        size = len(b["text"])
        if b["article"] is not None:
            beside = [o for o in (free[k - 1] if k else None, free[k + 1] if k + 1 < len(free) else None) if o is not None and o["article"] is b["article"]]
            bulk = any(links_only(o) for o in beside)
            b["label"] = "bad" if bulk and links_only(b) and len(b["words"]) > 3 else "good" if size >= SHORT and b["density"] <= 0.33 else "short"
        elif b["density"] > 0.33:
            b["label"] = "bad"
        elif size < SHORT:
            b["label"] = "bad" if b["linked"] else "short"
        elif share >= 0.2:
            b["label"] = "good" if size > 200 else "near"
        else:
            b["label"] = "near" if share >= 0.1 or size <= 200 else "bad"
    if not any(b["label"] == "good" for b in free):
        for b in free:
            if b["label"] == "near" and (not listed or sum(w in stop for w in b["words"]) >= 0.2 * len(b["words"])):
                b["label"] = "good"
    decided = [b["label"] for b in free]
    out = []
    for k, b in enumerate(free):
        if decided[k] in ("good", "bad"):
            final = decided[k]
        else:
            near = []
            for step in (-1, 1):
                j = k + step
                while 0 <= j < len(free) and free[j]["article"] is b["article"] and decided[j] not in ("good", "bad"):
                    j += step
                if 0 <= j < len(free) and free[j]["article"] is b["article"]:
                    near.append((abs(j - k), decided[j]))
                elif b["article"] is None:
                    bare = not blocks[0 if step < 0 else -1]["bad"]
                    if 0 <= j < len(free) or bare:
                        near.append((abs(j - k) - (0 if b["heading"] else 0.5), "bad"))
            labels = {x for _, x in near}
            if b["article"] is not None:
                final = "good" if "good" in labels or len(near) < 2 else "bad"
            elif not near:
                final = "bad"
            elif len(labels) == 1:
                final = labels.pop()
            else:
                final = "good" if "good" in {x for d, x in near if d == min(d for d, _ in near)} else "bad"
        if final == "good":
            out.append(b["text"])
    return " ".join(out)


def every(node):
    yield node
    for c in node.children:
        if not isinstance(c, str):
            yield from every(c)


def test_two_hundred_made_pages_equal_the_plain_twin():
    rng, some = random.Random(14), 0
    for k in range(200):
        root = made_page(rng)
        page = markup(root)
        want = plain_text(root)
        assert main_text(page) == want, (k, page)
        some += bool(want)
    assert some > 100


def test_blocks_are_found_without_the_article_element():
    """The rules, and not the element, find the text: pages of long and short paragraphs lose their article tags."""
    rng = random.Random(15)
    say = lambda n: " ".join(rng.choice(["the", "of", "and", "lake", "forest", "river", "stone", "bird", "cloud", "was"]) for _ in range(n)).capitalize() + "."
    for _ in range(20):
        body = [say(rng.choice([3, 10, 30, 60, 90])) for _ in range(rng.randrange(4, 12))] + [say(60)]
        page = f"<nav><ul><li><a href=1>Home</a></ul></nav><div class=ad>Buy the lake.</div><article><h1>{say(5)}</h1>{''.join(f'<p>{b}</p>' for b in body)}</article><footer>Foot</footer>"
        assert main_text(re.sub("article", "div", page)) == main_text(page) != ""
    assert "article" in BLOCK

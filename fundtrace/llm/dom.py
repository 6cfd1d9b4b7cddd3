"""A small tolerant DOM, its tree of blocks, simple tree matching, and wrappers: which slots of a tree hold content."""

import re
import sys
from html.parser import HTMLParser

import numpy as np

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Opening one of these ends an open element of the second kind.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "html", "body", "title"}
#: Elements whose text readers don't see as text of the page.
UNSEEN = set("head script style noscript template button select textarea input iframe object svg canvas audio video title".split())
#: Kinds and roles of elements that aren't main text by their meaning.
AGAINST = set("nav header footer aside form dialog menu".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Names of what surrounds main text, and names that parts of an article have as well. Neither decides alone, see against.
NAMES = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|adsense|adbox|banners?|sponsor\w*|promo\w*|sidebars?|widgets?|nav\w*|menus?|breadcrumbs?|pagination|pager|cookies?|consent|gdpr|"
    r"popups?|modals?|overlay|comments?|commentlist|replies|reply|disqus|share|sharing|social|"
    r"newsletter|subscribe|subscription|signup|login|footers?|masthead|topbar|toolbar|copyright|paywall)(?:$|[-_\s\d])", re.I)
UNCLEAR = re.compile(
    r"(?:^|[-_\s])(?:side|aside|notices?|notifications?|alerts?|respond|discussion|feedback|related|recommended|search|foot|headers?|skip|hidden)(?:$|[-_\s\d])", re.I)
#: What an element's hint says: main text, or its name or kind speaks against it.
MAIN, UNCLEAR_NAME, NAME, KIND = 1, -1, -2, -3
#: Elements that hold other blocks, elements of running text, controls of forms, and roots of a page.
CONTAINERS = set("div section ul ol dl table center fieldset details tr td".split())
PROSE = HEADINGS | set("p blockquote pre ul ol dl table figure figcaption".split())
CONTROLS = set("button select textarea input".split())
ROOTS = set("#root html body".split())


class Node:
    __slots__ = ("tag", "attrs", "children", "text")

    def __init__(self, tag, attrs=None, text=None):
        self.tag, self.attrs, self.children, self.text = tag, attrs or {}, [], text


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def _close(self, tags, barrier):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in barrier:
                return

    def handle_starttag(self, tag, attrs):
        if tag in ENDS:
            self._close(ENDS[tag], {"ul", "ol", "dl", "table", "select"})
        if tag in ENDS_P:
            self._close({"p"}, BLOCK - {"p"})
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and len(self.open) > 1 and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if tag not in BLOCK and self.open[i].tag in BLOCK:
                return

    def handle_data(self, data):
        self.open[-1].children.append(Node("#text", text=data))


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


class Block:
    """A block element: runs of inline text and blocks in order; chars and links are those of its own runs, all_* of its whole tree."""

    __slots__ = ("tag", "label", "hint", "items", "chars", "links", "all_chars", "all_links", "heading", "form", "size", "own", "shape", "full", "slot")

    def __init__(self, tag, label, hint):
        self.tag, self.label, self.hint, self.items = tag, label, hint, []
        self.chars = self.links = 0
        self.heading, self.form = tag in HEADINGS, False

    @property
    def children(self):
        return [x for x in self.items if x.__class__ is Block]


def hidden(node: Node) -> bool:
    a = node.attrs
    return "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()


def hint(node: Node, in_article: bool) -> int:
    """MAIN for article and main, KIND or a name's hint if they speak against main text, else 0."""
    a, tag = node.attrs, node.tag
    if tag in ("article", "main"):
        return MAIN
    if tag in ROOTS:
        return 0
    if tag in AGAINST:
        # An article's own heading may stand in a header of its own.
        return 0 if tag == "header" and in_article and any(c.tag in ("h1", "h2") for c in node.children) else KIND
    if not a:
        return 0
    if a.get("role", "").lower() in ROLES:
        return KIND
    names = a.get("class", ""), a.get("id", "")
    return NAME if any(map(NAMES.search, names)) else UNCLEAR_NAME if any(map(UNCLEAR.search, names)) else 0


def against(b: Block, linked: bool) -> bool:
    """Whether a block isn't main text by its kind, or by its name and other features together: that the name is a clear one, that
    it is mostly links, has controls of a form, holds blocks with such names, or is a container and no running text."""
    if b.hint >= 0 or b.hint == KIND:
        return b.hint == KIND
    kids = b.children
    named = bool(kids) and 2 * sum(c.hint in (NAME, UNCLEAR_NAME) for c in kids) >= len(kids)
    return sum(map(bool, (b.hint == NAME, linked, b.form, named, b.tag in CONTAINERS))) >= 2


def blocks(root: Node) -> Block:
    """The tree of blocks of a page."""
    top = Block(root.tag, root.tag, 0)
    run, linked = [], []

    def end(block):
        text = " ".join("".join(run).split())
        if text:
            block.items.append(text)
            block.chars += len(text)
            block.links += min(len(text), sum(linked))
        run.clear()
        linked.clear()

    order, stack = [top], [(c, top, False, False) for c in reversed(root.children)]
    while stack:
        node, block, article, link = stack.pop()
        if node is None:
            end(block)
        elif node.tag == "#text":
            run.append(node.text)
            if link:
                linked.append(len(node.text.strip()))
        elif node.tag == "br":
            run.append("\n")
        elif node.tag in UNSEEN or hidden(node):
            block.form = block.form or node.tag in CONTROLS
            end(block) if node.tag in BLOCK else None
        else:
            h = hint(node, article)
            inside = article or h > 0
            if node.tag in BLOCK or h == KIND or (h == NAME and node.tag == "a"):
                end(block)
                made = Block(node.tag, f"{node.tag}.{re.sub('[0-9]+', '', node.attrs.get('class', ''))}", h)
                block.items.append(made)
                order.append(made)
                stack.append((None, made, inside, link))
                block = made
            stack.extend((c, block, inside, link or node.tag == "a") for c in reversed(node.children))
    end(top)
    for b in reversed(order):
        kids = b.children
        own = "\0".join(x for x in b.items if x.__class__ is str)
        b.own = hash(own) if own else 0
        b.shape = hash((b.label, *[c.shape for c in kids]))
        b.full = hash((b.shape, b.own, *[c.full for c in kids]))
        b.size = 1 + sum(c.size for c in kids)
        b.all_chars, b.all_links = b.chars + sum(c.all_chars for c in kids), b.links + sum(c.all_links for c in kids)
        b.heading = b.heading or any(c.heading for c in kids)
        b.form = b.form or any(c.form for c in kids)
    for i, b in enumerate(order):
        b.slot = i
    return top


def in_order(top: Block) -> list[Block]:
    """Blocks by slot."""
    out, stack = [None] * top.size, [top]
    while stack:
        b = stack.pop()
        out[b.slot] = b
        stack += b.children
    return out


class Matching:
    """Simple tree matching: the largest number of blocks of two trees that are matched with equal labels, parents with parents
    and siblings in order. Of equally large matchings one with equal texts is preferred."""

    def __init__(self):
        self.known: dict = {}

    def weight(self, x: Block, y: Block) -> int:
        if x.shape == y.shape:
            return x.size
        if x.label != y.label:
            return 0
        if x.size == 1 or y.size == 1:
            return 1
        key = (x.shape, y.shape)
        if key not in self.known:
            self.known[key] = 1 + sum(self.weight(a, b) for a, b in self.siblings(x.children, y.children))
        return self.known[key]

    def siblings(self, xs: list[Block], ys: list[Block]) -> list[tuple[Block, Block]]:
        """Matched pairs of two lists of siblings. Equal first or last trees are matched in some best matching, so they are
        taken off first: those with equal texts, then those of equal shape."""
        out, tail = [], []
        i = j = 0
        m, n = len(xs), len(ys)
        for equal in (lambda a, b: a.full == b.full, lambda a, b: a.shape == b.shape):
            while i < m and j < n and equal(xs[i], ys[j]):
                out.append((xs[i], ys[j]))
                i, j = i + 1, j + 1
            while i < m and j < n and equal(xs[m - 1], ys[n - 1]):
                m, n = m - 1, n - 1
                tail.append((xs[m], ys[n]))
        if i < m and j < n:
            out += self._between(xs[i:m], ys[j:n])
        return out + tail[::-1]

    def _row(self, x: Block, ys: list[Block]) -> np.ndarray:
        return np.array([(w + 0.001 * (x.own == y.own != 0)) if (w := self.weight(x, y)) else 0 for y in ys])

    def _scores(self, xs: list[Block], ys: list[Block]) -> np.ndarray:
        """Best weight of xs against each number of first ys."""
        best = np.zeros(len(ys) + 1)
        for x in xs:
            best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + self._row(x, ys)))
        return best

    def _between(self, xs: list[Block], ys: list[Block]) -> list[tuple[Block, Block]]:
        """By halves, so that memory is a row of the table for lists of any length."""
        if not xs or not ys:
            return []
        if len(xs) == 1:
            row = self._row(xs[0], ys)
            return [(xs[0], ys[int(row.argmax())])] if row.max() > 0 else []
        half = len(xs) // 2
        cut = int((self._scores(xs[:half], ys) + self._scores(xs[half:][::-1], ys[::-1])[::-1]).argmax())
        return self._between(xs[:half], ys[:cut]) + self._between(xs[half:], ys[cut:])


def match(a: Block, b: Block) -> list[tuple[Block, Block]]:
    """Matched pairs of two trees, from the roots down; none if the roots' labels differ."""
    if a.label != b.label:
        return []
    # Nested calls of plain functions, as deep as the page.
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * (a.size + b.size) + 1000))
    matching, out, todo = Matching(), [], [(a, b)]
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        if x.size > 1 and y.size > 1:
            todo += matching.siblings(x.children, y.children)
    return out


#: A slot's text is constant outside the region of the article if so large a share of its pages have it; within the region, where
#: articles may share a passage, if so large a share has it and of this many pages at least.
CONSTANT, CONSTANT_INSIDE, LEAST_PAGES = 0.5, 0.9, 3
#: What kind and name of an element add to the weight of its text.
FOR, AGAINST_WEIGHT = 3.0, 0.1
#: An element is descended into while it holds so large a share of the text. Outside the region a container of bare text counts from
#: this share of its text; running text and what has a heading count at any length.
MOST, BESIDE = 0.6, 0.1
#: A block is a list of links if so much of its text is links.
LINKS = 0.8
KEEP, DROP, PASS = range(3)


def _region(path: list[Block], constant: np.ndarray) -> int:
    """Which element of the path to the largest text is the article: the lowest article, else one with a heading that varies, else
    the last. What is beside the largest text within it is main text too."""
    def headed(b, tags):
        return any(not constant[c.slot] and (c.tag in tags or (c.tag == "header" and c.hint == 0)) for c in b.children)

    for what in (lambda b: b.tag == "article", lambda b: headed(b, ("h1",)), lambda b: b.hint == MAIN, lambda b: headed(b, ("h2",))):
        for i in range(len(path) - 1, -1, -1):
            if path[i].tag not in ROOTS and what(path[i]):
                return i
    return len(path) - 1


def wrapper(top: Block, stats: np.ndarray) -> np.ndarray:
    """KEEP, DROP or PASS (its children are judged by themselves) for each slot of a tree, and 4 added where the slot's text is constant.

    stats: for each slot the number of pages that have it, those with the same text, and characters of its own text, of all below
    it, and of links below it, summed over these pages. Length, constancy and link share of the slots lead to the region of the
    article. Within it a slot goes only if its text is constant, or if it is no main text by several features (see against); of
    fewer than LEAST_PAGES pages, constancy counts only outside it. Lists of links go at the top of a page and beside the largest text.
    """
    order = in_order(top)
    k, same, own, chars, links = stats.T
    inside = (own > 0) & (k >= LEAST_PAGES) & (same >= CONSTANT_INSIDE * k)
    outside = (own > 0) & (k > 0) & (same >= np.where(k >= LEAST_PAGES, CONSTANT, 1) * k)
    linked = links > 0.5 * np.maximum(chars, 1)
    mass = np.zeros(len(order))
    for i in range(len(order) - 1, -1, -1):
        kids = [c.slot for c in order[i].children]
        loose = max(0.0, chars[i] - chars[kids].sum() - (own[i] if outside[i] else 0)) if kids else (0 if outside[i] else chars[i])
        factor = FOR if order[i].hint == MAIN else AGAINST_WEIGHT if order[i].hint in (NAME, KIND) else 1
        mass[i] = factor * ((0 if linked[i] else loose) + mass[kids].sum())
    out = np.full(len(order), DROP)
    path = [top]
    while kids := path[-1].children:
        best = max(kids, key=lambda c: mass[c.slot])
        if mass[best.slot] < MOST * mass[path[-1].slot] or not best.children or mass[best.slot] <= 0:
            break
        path.append(best)
    at = _region(path, outside)
    region = path[at]
    roots = [region]
    for above, below in zip(path[:at], path[1 : at + 1]):
        out[above.slot] = PASS
        roots += [c for c in above.children if c is not below and not against(c, linked[c.slot]) and not linked[c.slot] and mass[c.slot] > 0
                  and (c.heading or c.tag in PROSE or mass[c.slot] >= BESIDE * mass[region.slot])]
    on_path = {b.slot for b in path[at:]}
    # What is kept, but for blocks below that speak against it.
    todo = [(r, False) for r in roots]
    while todo:
        b, listed = todo.pop()
        if b in roots or b.slot in on_path or not (against(b, linked[b.slot]) or (listed and b.children and links[b.slot] > LINKS * chars[b.slot])):
            out[b.slot] = KEEP
            # Within an article, lists of links are its references.
            top_of_page = b.tag in ROOTS or (b.slot in on_path and b is not path[-1] and region.tag != "article")
            todo += [(c, top_of_page) for c in b.children]
    return out + 4 * np.where(out == KEEP, inside, outside)


def own_stats(top: Block) -> np.ndarray:
    """stats of a page alone: nothing is known to be constant."""
    return np.array([(1, 0, b.chars, b.all_chars, b.all_links) for b in in_order(top)], float)


def flat(page: Block, pairs: list[tuple[Block, Block]]) -> list[list]:
    """The page's blocks by slot, plain enough for JSON: slot of the reference or -1, whether their texts are equal, whether it speaks
    against main text (see against), whether it is running text or has a heading, characters, link characters, and items (texts, and numbers of blocks). pairs: (block of the reference, block of the page)."""
    of = {y.slot: x for x, y in pairs}
    out = []
    for b in in_order(page):
        x = of.get(b.slot)
        out.append([-1 if x is None else x.slot, x is not None and x.own == b.own, against(b, 2 * b.all_links > b.all_chars), b.heading or b.tag in PROSE, b.all_chars, b.all_links, [i if i.__class__ is str else i.slot for i in b.items]])
    return out


def text(page: list[list], decided: np.ndarray) -> str:
    """The texts of a page (see flat) in content slots, in page order."""
    main = max((b[4] for b in page if b[0] >= 0 and decided[b[0]] % 4 == KEEP), default=0)
    out, stack = [], [(0, DROP)]
    while stack:
        at, state = stack.pop()
        if at.__class__ is str:
            out.append(at)
            continue
        slot, same, opposed, lead, chars, links, items = page[at]
        if slot >= 0:
            state, same = decided[slot] % 4, same and decided[slot] >= 4
        else:
            if opposed:
                state = DROP
            elif state == PASS:  # a block that the reference lacks, beside the main element
                state = KEEP if 2 * links <= chars and (lead or chars >= BESIDE * main) else DROP
            if state == DROP:
                continue
        stack.extend((i, state) for i in reversed(items) if i.__class__ is int or (state == KEEP and not same))
    return " ".join(out)

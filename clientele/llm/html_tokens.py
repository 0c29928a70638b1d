"""A page as a balanced stream of block tags and text, tolerant of missing and stray end tags."""

import re

# Element classes of HTML.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
# An element of the key ends an open element of the value, up to the nearest element that holds it.
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
      |<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*)>
      |<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)
      |(?P<text>[^<]+|<)""",
    re.S | re.X,
)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


# Elements nested deeper lie side by side, so that a tree of any page can be walked.
DEEPEST = 200


class Node:
    """A block element. ``kids`` holds nodes and text runs, a run as [raw text, characters inside links]."""

    __slots__ = ("name", "marks", "kids")

    def __init__(self, name: str, marks: str = ""):
        self.name, self.marks, self.kids = name, marks, []

    @property
    def token(self) -> str:
        return f"{self.name}.{self.marks}" if self.marks else self.name


def _marks(rest: str) -> str:
    """The words of class, id and role without digits, sorted: what tells templates apart."""
    found = set()
    for _, a, b, c in ATTRIBUTE.findall(rest):
        found.update(w for w in re.split(r"[^a-z]+", (a or b or c).lower()) if w)
    return ".".join(sorted(found))


def parse(html: str, shut=lambda token: False) -> Node:
    """The page's tree below a node named ``#page``.

    From ``DEEPEST`` levels on an element is a mark between the texts before, in and after it. Only an element
    that ``shut`` says is left out still holds its text, with all that is nested in it.
    """
    root = Node("#page")
    stack, links, at, end = [root], 0, 0, len(html)
    beside = []  # names of the open elements that lie side by side
    while at < end:
        m = TOKEN.match(html, at)
        at = m.end()
        text = m["text"]
        if text is not None:
            kids = stack[-1].kids
            if not kids or isinstance(kids[-1], Node):
                kids.append([[], 0])
            kids[-1][0].append(text)
            if links:
                kids[-1][1] += len(text)
            continue
        name = m["name"] or m["name2"]
        if name is None:
            continue
        name, rest = name.lower(), m["rest"] or m["rest2"] or ""
        if m["end"] or m["end2"]:
            if name == "a":
                links = max(links - 1, 0)
            if name not in INLINE and name in beside:
                del beside[len(beside) - 1 - beside[::-1].index(name) :]
                stack[-1].kids.append(Node("#end"))
                links = 0
            elif name not in INLINE:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name == name:
                        del stack[i:]
                        beside.clear()
                        links = 0
                        break
            continue
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at)
            at = end if stop is None else max(html.find(">", stop.end()) + 1, stop.end())
            continue
        if name == "br" or name == "wbr" or name == "img":
            kids = stack[-1].kids
            if name == "br" and kids and not isinstance(kids[-1], Node):
                kids[-1][0].append(" ")
            continue
        if name in INLINE:
            links += name == "a"
            continue
        if name in CLOSED_BY:
            ended, holders = CLOSED_BY[name]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in holders:
                    break
                if stack[i].name in ended:
                    del stack[i:]
                    break
        # Any block ends an open paragraph.
        if stack[-1].name == "p":
            stack.pop()
        node = Node(name, _marks(rest) if rest else "")
        stack[-1].kids.append(node)
        if name not in VOID and not rest.endswith("/"):
            if len(stack) < DEEPEST or len(stack) == DEEPEST and shut(node.token):
                stack.append(node)
            else:
                beside.append(name)
            links = 0
    return root

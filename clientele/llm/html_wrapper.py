"""Main text of web pages by wrappers: union-free regular expressions inferred from pages of one host.

A page is a stream of tags and text. Neighbouring groups of equal tags fold into one
repeated group. Two streams are aligned tag by tag: texts that differ become a slot, tags
that only one side has become optional, and what the alignment makes adjacent folds again.
Aligning wrappers is the same operation, so tasks align their own pages first and only
wrappers are shuffled. The wrapper also sums how much text and link text its groups hold.

The host's wrapper then says which groups are the article, and each page is read along it.
"""

import html
import json
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_tokens import Node, parse
from .jobs import HIDDEN, stage

# Pages of one host for one task to read. It grows with the table, so that at most HOT_HOSTS are split.
PAGES_A_TASK = 1000
HOT_HOSTS = 100_000
FANIN = 64
HOSTS_HELD = 2000
LONGEST_GROUP = 4
FEW_PAGES = 2
# Pages of one template that must share a text where the host has other templates.
MANY_PAGES = 20

# Elements and words of class, id or role that never belong to an article.
OUTSIDE = frozenset(
    "head nav header footer aside form button select option fieldset dialog menu noscript template svg object "
    "canvas audio video script style textarea iframe".split()
)
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices notification alert popup modal overlay sidebar aside menu nav navbar navigation breadcrumb "
    "breadcrumbs header masthead footer copyright share sharing social related recommended recommendations comment "
    "comments disqus reply replies respond newsletter subscribe subscription signup login search pagination pager "
    "widget widgets toolbar skip hidden".split()
)
CENTRE = frozenset(("article", "main"))
# Elements that hold a page or an article, whatever words their class, id or role has.
WHOLE = frozenset(("html", "body", "article", "main"))
# What readers say varies as the article does, so a container of these words stays outside.
REPLY_WORDS = frozenset("comment comments disqus reply replies respond".split())
TEXT = "#"
OPEN, DOUBTFUL, SHUT = range(3)


_KINDS: dict[str, int] = {}


def _kind(token: str) -> int:
    """Whether an element may hold article text, kept for the tokens met lately."""
    kind = _KINDS.get(token)
    if kind is None:
        if len(_KINDS) >= 1 << 14:
            _KINDS.clear()
        kind = _KINDS[token] = _judged(token)
    return kind


def _judged(token: str) -> int:
    """Doubtful is an element where only one word or a form speaks against it."""
    name, _, marks = token.partition(".")
    if name in WHOLE:
        return OPEN
    found = OUTSIDE_WORDS.intersection(marks.split("."))
    if name in OUTSIDE and name != "form" or found & REPLY_WORDS or len(found) > 1:
        return SHUT
    return DOUBTFUL if found or name == "form" else OPEN


def _shut(token: str) -> bool:
    return _kind(token) == SHUT


# A wrapper group is [token, pages, repeated, optional, characters, link characters, texts, groups]. The texts
# of a slot are [whether pages differ in them, hashes of those that every page has].
TOKEN, PAGES, MANY, MAYBE, CHARS, LINKED, SAME, KIDS = range(8)


def wrapper_of(node: Node) -> list:
    """One page as a wrapper."""
    kids = []
    for kid in node.kids:
        if isinstance(kid, Node):
            kids.append(wrapper_of(kid))
        else:
            text = "".join(kid[0]).strip()
            if text:
                # The text itself stays with the page; a hash tells whether it is the same on all.
                kids.append([TEXT, 1, False, False, len(text), min(kid[1], len(text)), [False, [hash_text(text)]], []])
    return [node.token, 1, False, False, 0, 0, None, fold(kids)]


def hash_text(text: str) -> int:
    raw = text.encode("utf-8", "replace")
    return zlib.crc32(raw) << 32 | zlib.adler32(raw)


def fold(groups: list) -> list:
    """Neighbouring equal groups become one repeated group, single tags first, then runs of several."""
    out = []
    for g in groups:
        if out and out[-1][TOKEN] == g[TOKEN] and g[TOKEN] != TEXT:
            out[-1] = align(out[-1], g, False)
            out[-1][MANY] = True
        else:
            out.append(g)
    for period in range(2, LONGEST_GROUP + 1):
        i = 0
        while i + 2 * period <= len(out):
            a, b = out[i : i + period], out[i + period : i + 2 * period]
            if [g[TOKEN] for g in a] == [g[TOKEN] for g in b]:
                both = [align(x, y, False) for x, y in zip(a, b)]
                name = "(" + "|".join(g[TOKEN] for g in a) + ")"
                rest = out[i + 2 * period :]
                while len(rest) >= period and [g[TOKEN] for g in rest[:period]] == [g[TOKEN] for g in both]:
                    both = [align(x, y, False) for x, y in zip(both, rest)]
                    rest = rest[period:]
                pages = max(g[PAGES] for g in both)
                out = out[:i] + [[name, pages, True, False, 0, 0, None, both]] + rest
            i += 1
    return out


def align(a: list, b: list, pages: bool = True) -> list:
    """One group that stands for both; ``pages`` tells whether they come from different pages."""
    count = a[PAGES] + b[PAGES] if pages else max(a[PAGES], b[PAGES])
    same = a[SAME]
    if a[SAME] != b[SAME]:
        # Pages share what both have; neighbours on one page bring together what each has.
        mine, other = set(a[SAME][1]), set(b[SAME][1])
        same = [pages or a[SAME][0] or b[SAME][0], sorted(mine & other if pages else mine | other)]
    return [
        a[TOKEN],
        count,
        a[MANY] or b[MANY],
        a[MAYBE] or b[MAYBE],
        a[CHARS] + b[CHARS],
        a[LINKED] + b[LINKED],
        same,
        _align_all(a[KIDS], b[KIDS], pages),
    ]


def _align_all(x: list, y: list, pages: bool) -> list:
    left, right = [g[TOKEN] for g in x], [g[TOKEN] for g in y]
    if left == right:
        return [align(a, b, pages) for a, b in zip(x, y)]
    # Longest common subsequence of tags: the least mismatch.
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = (
                best[i + 1][j + 1] + 1 if left[i] == right[j] else max(best[i + 1][j], best[i][j + 1])
            )
    out, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        if left[i] == right[j]:
            out.append(align(x[i], y[j], pages))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out.append([*x[i][:MAYBE], True, *x[i][CHARS:]])
            i += 1
        else:
            out.append([*y[j][:MAYBE], True, *y[j][CHARS:]])
            j += 1
    out += [[*g[:MAYBE], True, *g[CHARS:]] for g in x[i:] + y[j:]]
    return fold(out)


def regex(group: list) -> str:
    """The wrapper as a readable regular expression over tags; ``#`` is a slot, quoted hashes are constants."""
    if group[TOKEN] == TEXT:
        inner = "#" if group[SAME][0] or len(group[SAME][1]) > 1 else f"'{group[SAME][1][0]:x}'"
    else:
        body = " ".join(regex(g) for g in group[KIDS])
        inner = f"( {body} )" if group[TOKEN][0] == "(" else f"<{group[TOKEN]}> {body} </{group[TOKEN].partition('.')[0]}>"
    mark = {(False, False): "", (False, True): "?", (True, False): "+", (True, True): "*"}[group[MANY], group[MAYBE]]
    return f"( {inner} ){mark}" if mark and inner[0] != "(" else inner + mark


def _sums(group: list) -> tuple[int, int]:
    chars, linked = group[CHARS], group[LINKED]
    for g in group[KIDS]:
        a, b = _sums(g)
        chars, linked = chars + a, linked + b
    return chars, linked


def _is_centre(token: str) -> bool:
    name, _, marks = token.partition(".")
    return name in CENTRE or "main" in marks.split(".")


def _unlinked(group: list) -> int:
    """Characters outside of links in all that is not surely outside an article."""
    if group[TOKEN] != TEXT and _kind(group[TOKEN]) == SHUT:
        return 0
    return group[CHARS] - group[LINKED] + sum(_unlinked(g) for g in group[KIDS])


def _varies(group: list, most: int) -> bool:
    """Whether pages differ in a text of the group; doubtful groups count that hold over half of ``most``."""
    if group[TOKEN] == TEXT:
        return group[SAME][0]
    kind = _kind(group[TOKEN])
    if kind == SHUT or kind == DOUBTFUL and 2 * _unlinked(group) <= most:
        return False
    return any(_varies(g, most) for g in group[KIDS])


# How a slot comes to be read: inside a marked article, inside one below an element that only its weight
# speaks for, or outside of any.
MARKED, DOUBTED, PLAIN = RANKS = range(3)


class Reader:
    """Reads pages through the slots of their host's wrapper.

    Only the wrapper is judged: each of its text groups gets a rank or is no slot. A page is matched with the
    wrapper, its texts are read through the slots they stand in, and those of the best rank that the page
    has are its article, so that templates of one host may differ. What no slot holds is not read.
    """

    def __init__(self, wrapper: list):
        self.wrapper = wrapper
        # Where all pages are alike, being alike tells nothing.
        self.most = _unlinked(wrapper)
        self.varied = _varies(wrapper, self.most)
        self.weights, self.shared, self.slots, self.ways, self.flat = {}, set(), {}, set(), {}
        self._weigh(wrapper)
        self._find_shared(wrapper, [])
        self._choose(wrapper, PLAIN, False, False, wrapper)

    def _weigh(self, group: list) -> int:
        """Unlinked characters that tell pages of the host apart, noted for each group."""
        if group[TOKEN] == TEXT:
            differs = group[SAME][0] or group[PAGES] < FEW_PAGES or not self.varied
            total = group[CHARS] - group[LINKED] if differs else 0
        else:
            total = sum(self._weigh(g) for g in group[KIDS])
            total = 0 if _kind(group[TOKEN]) == SHUT else total
        self.weights[id(group)] = total
        return total

    def _find_shared(self, group: list, above: list) -> None:
        """Notes the texts whose being alike tells that they are no article.

        They stand on nearly all pages of the host, or on many pages that differ elsewhere:
        in the outermost element that has hardly more pages than the text.
        """
        if group[TOKEN] == TEXT:
            pages = group[PAGES]
            host = 10 * pages >= 9 * self.wrapper[PAGES]
            template = next((g for g in above if 10 * pages >= 9 * g[PAGES]), group)
            if pages >= FEW_PAGES and host or pages >= MANY_PAGES and _varies(template, self.most):
                self.shared.add(id(group))
        for g in group[KIDS]:
            self._find_shared(g, [*above, group])

    def _choose(self, group: list, rank: int, doubted: bool, listed: bool, whole: list) -> bool:
        """Ranks the slots below ``group``; tells whether there are any.

        ``doubted``: an element above is read for its weight alone; ``listed``: a link list is above;
        ``whole``: the marked article, or the page, of which a doubtful element must hold over half.
        """
        any_slot = False
        for g in group[KIDS]:
            token = g[TOKEN]
            if token == TEXT:
                if rank != PLAIN or not listed:
                    self.slots[id(g)] = rank
                    any_slot = True
                continue
            kind = _kind(token)
            if kind == SHUT or kind == DOUBTFUL and not self._holds_most(g, whole):
                continue
            if rank == PLAIN and _is_centre(token):
                below = self._choose(g, DOUBTED if doubted or kind == DOUBTFUL else MARKED, False, False, g)
            else:
                below = self._choose(g, rank, doubted or kind == DOUBTFUL, listed or self._links(g), whole)
            if below:
                self.ways.add(id(g))
                any_slot = True
        return any_slot

    def _holds_most(self, group: list, whole: list) -> bool:
        """Whether it holds over half of what an average page has in ``whole``, on the pages that have it."""
        return 2 * self.weights[id(group)] * whole[PAGES] > self.weights[id(whole)] * group[PAGES]

    def _links(self, group: list) -> bool:
        chars, linked = _sums(group)
        return chars > 0 and 2 * linked > chars

    def blocks(self, page: Node) -> list[str]:
        found = [[] for _ in RANKS]
        self._read(page, self.wrapper, found)
        return next((blocks for blocks in found if blocks), [])

    def _pairs(self, node: Node, group: list):
        """The node's kids, each with its group."""
        groups = self.flat.get(id(group))
        if groups is None:
            groups = self.flat[id(group)] = _flat(group[KIDS])
        at = 0
        for kid in node.kids:
            token = kid.token if isinstance(kid, Node) else TEXT
            # The next group of this tag; a repeated one may be met again, so the search starts at the last one.
            place = next((i for i in range(at, len(groups)) if groups[i][TOKEN] == token), None)
            if place is None:
                place = next((i for i in range(at) if groups[i][TOKEN] == token), None)
            else:
                at = place
            if place is not None:
                yield kid, groups[place]

    def _read(self, node: Node, group: list, found: list) -> None:
        """Adds the node's texts to the blocks of their slots' ranks."""
        for kid, own in self._pairs(node, group):
            if isinstance(kid, Node):
                if id(own) in self.ways:
                    self._read(kid, own, found)
            elif id(own) in self.slots:
                rank = self.slots[id(own)]
                if rank != PLAIN or not self._boilerplate(own, kid):
                    text = " ".join(html.unescape("".join(kid[0])).split())
                    if text:
                        found[rank].append(text)

    def _boilerplate(self, group: list, run: list) -> bool:
        """Outside of a marked article: text that all pages of the host or template share."""
        return self.varied and id(group) in self.shared and hash_text("".join(run[0]).strip()) in group[SAME][1]


def _flat(groups: list) -> list:
    """Groups in order, those of a repeated run in place of it."""
    out = []
    for g in groups:
        out += _flat(g[KIDS]) if g[TOKEN][0] == "(" else [g]
    return out


def host_of(url: str = "url"):
    found = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(found)


WRAPPER = "host string, part int, wrapper string, pages long"


def _own_wrappers(batches):
    """A wrapper for each host of a task; many hosts are sent on in between."""
    part, held = TaskContext.get().partitionId() % FANIN, {}

    def send():
        hosts = list(held)
        texts = [json.dumps(held[h], separators=(",", ":")) for h in hosts]
        parts = pa.array([part] * len(hosts), pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), parts, pa.array(texts, pa.string()), pa.array([held[h][PAGES] for h in hosts], pa.int64())],
            ["host", "part", "wrapper", "pages"],
        )

    for batch in batches:
        for host, text in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            own = wrapper_of(parse(text, _shut))
            held[host] = align(held[host], own) if host in held else own
            if len(held) >= HOSTS_HELD:
                yield send()
                held.clear()
    if held:
        yield send()


def _aligned(table: pa.Table) -> pa.Table:
    """One wrapper of a host, in an order that does not depend on the order of arrival."""
    texts = sorted(table["wrapper"].to_pylist())
    out = json.loads(texts[0])
    for text in texts[1:]:
        out = align(out, json.loads(text))
    return pa.table(
        {
            "host": pa.array([table["host"][0].as_py()], pa.string()),
            "part": pa.array([table["part"][0].as_py()], pa.int32()),
            "wrapper": pa.array([json.dumps(out, separators=(",", ":"))], pa.string()),
            "pages": pa.array([out[PAGES]], pa.int64()),
        }
    )


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, pages) over all pages; a host's tasks meet in ``FANIN`` parts first, so a hot host is no one task's."""
    narrow = pages.select(host_of().alias("host"), F.coalesce(pages["html"], F.lit("")).alias("html"))
    own = narrow.mapInArrow(_own_wrappers, WRAPPER)
    parts = own.groupBy("host", "part").applyInArrow(_aligned, WRAPPER)
    return parts.groupBy("host").applyInArrow(_aligned, WRAPPER).select("host", "wrapper", "pages")


def _read(batches):
    readers = {}
    for batch in batches:
        texts = []
        for text, wrapper in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist()):
            reader = readers.get(wrapper)
            if reader is None:
                if len(readers) >= 256:
                    readers.clear()
                reader = readers[wrapper] = Reader(json.loads(wrapper))
            texts.append("\n".join(reader.blocks(parse(text, _shut))))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"]
        )


def main_text(pages: DataFrame, pages_a_task: int = PAGES_A_TASK) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    Blocks of the article in page order, one a line; white space inside a block is one
    space, character references are decoded. The wrapper of a host says which of its text slots
    are article, and a page is read through them: those in ``article`` or
    ``main`` elements where the page has such text, else all that are neither in link
    lists nor the same on all pages of the host (of two or more) that have their place in
    the page, if these are nine in ten or at least 20 that differ elsewhere. Menus, headers,
    footers, sidebars, notices, adverts, forms, scripts, styles and comments are left out
    by element and by words of class, id and role. Such words on html, body, article and
    main mean nothing; a form or an element with one such word (comments apart) is read
    where it holds over half of the unlinked text that tells the host's pages apart: of an average
    page's, or inside a marked article the article's. A null or empty html gives an empty
    text; pages without a host in their url share a wrapper; very long texts are read whole; repeated
    rows give equal texts; other columns are not read; an empty table gives no rows.
    A host of more than ``pages_a_task`` pages is read by several tasks.
    """
    rows = pages.select(
        pages["page_id"].cast("long").alias("page_id"),
        pages["url"].alias("url"),
        F.coalesce(pages["html"], F.lit("")).alias("html"),
        host_of().alias("host"),
    )
    salt, split = HIDDEN + "salt", HIDDEN + "split"
    known = stage(wrappers(pages), "wrappers")
    total = known.agg(F.sum("pages")).first()[0] or 0
    share = max(pages_a_task, -(-total // HOT_HOSTS))
    known = known.withColumn(split, F.ceil(F.col("pages") / share).cast("long"))
    hot = stage(known.where(F.col(split) > 1).select("host", split), "hosts")
    rows = rows.join(hot, "host", "left").withColumn(salt, F.expr(f"pmod(xxhash64(page_id, url), coalesce({split}, 1L))"))
    copies = known.select("host", "wrapper", F.explode(F.sequence(F.lit(0).cast("long"), F.col(split) - 1)).alias(salt))
    joined = rows.join(copies, ["host", salt])
    read = joined.select("page_id", "url", "html", "wrapper").mapInArrow(_read, "page_id long, url string, text string")
    return read.withColumn("n_chars", F.char_length("text").cast("long"))

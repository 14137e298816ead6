"""Main text of web pages by consensus host paths.

Every page's containers are scored by the text they hold (less inside links, more in elements whose
name or class speaks for an article), from the best one the page climbs to the whole article around it,
and votes for that path: the tags from the body down, with their classes, digits generalised. A table
cell is no container: a table is part of its article. Spark counts the votes per host. Each page is then
extracted again with its host's winning path; a page that has no text there uses its own best path,
and one without any container the whole body.

Left out everywhere: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments, by tag or by words in class, id or role. Words decide only where they name a part of
the page, not where a wrapper of the text mentions one (see ``_left_out``); if they would leave
nothing, only the tags count.

Defined cases: null or empty html gives an empty text; a null or odd url belongs to a host of its own
kind (the text before the path, or the empty host); repeated rows give repeated results; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from dialwise.session import broadcast_if_small, frozen

# The start of a comment, a declaration, or a tag with its name.
_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([A-Za-z][^\s/>]*))")
_SPECIAL = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")

# Elements by their part in HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_DROPPED = frozenset(
    "nav header footer aside form button select menu dialog noscript template svg math head"
    " canvas object audio video".split()
)
_CONTAINERS = frozenset("body main article section div".split())
_BLOCKS = frozenset(
    "address article blockquote body caption center dd details dialog div dl dt fieldset figcaption"
    " figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section"
    " summary table tbody td tfoot th thead tr ul aside".split()
)
# Words in class, id or role that speak against or for the main text.
_AGAINST = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments"
    " consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar"
    " navigation newsletter notice notices notification pager pagination popup promo promotion"
    " recommended related reply replies respond share sharing sidebar signup social sponsor"
    " sponsored subscribe toolbar topbar widget contentinfo complementary search".split()
)
_FOR = frozenset("article body content entry main post story text".split())
# A name that begins so ("no-sidebar", "has-comments") tells what the element has, not what it is.
_HAVING = frozenset("no has with without".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Share of a page's text that makes a container its main one where there is no article or main.
NEARLY_ALL = 0.95


def _names(attributes: str) -> tuple[str, set[str], bool, bool, bool]:
    """The first class and all words of class, id and role; whether a word speaks against the element,
    whether a name ends with such a word ("post-comments", not "comments-wrap"), whether it is the main role."""
    first, words, against, named, main = "", set(), False, False, False
    for m in _ATTRIBUTE.finditer(attributes):
        names = (m[2] or m[3] or m[4] or "").split()
        if m[1].lower() == "class" and names:
            first = names[0]
        main |= m[1].lower() == "role" and "main" in names
        for name in names:
            parts = _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
            words.update(parts)
            if parts and not (len(parts) > 1 and parts[0] in _HAVING):
                against |= not _AGAINST.isdisjoint(parts)
                named |= parts[-1] in _AGAINST
    return first, words, against, named, main


class _Part:
    """The page, a main, an article, or an element with a word that speaks against it."""

    def __init__(self, above=None, tag="", against=False, named=False, for_=False, main=False):
        self.above, self.tag, self.against, self.named = above, tag, against, named
        self.for_, self.main, self.out = for_, main, False
        # Characters: all, those in no part with a word against it, and of these those that speak for
        # themselves and those in a main or an article further down (headings count in the first only).
        self.all = self.plain = self.speaks = self.sections = 0
        self.has_main = self.has_article = False


def _left_out(parts: list[_Part]) -> None:
    """Mark the parts that are left out for their names; ``parts`` in the order of the page.

    A part with a word against it stays if it holds a main; or if it holds most of the text of the part
    around it, or the article there, and no other text there is a better candidate: text in another
    main or article, and for a part that is named so or has no word for it, any that speaks for itself.
    """
    for p in reversed(parts[1:]):
        up = p.above
        up.all += p.all
        up.has_main |= p.has_main or p.main and p.all > 0
        up.has_article |= p.has_article or p.tag == "article" and not p.against and p.all > 0
        if not p.against:
            up.plain += p.plain
            up.sections += p.plain
            up.speaks += p.speaks
    for p in parts[1:]:
        up = p.above
        if up.out or not p.against:
            p.out = up.out
            continue
        loose = not p.named or p.tag == "article" and p.for_
        most = 2 * p.all > up.all
        rival = up.sections if loose and p.for_ else up.speaks
        p.out = not (
            p.has_main
            or (most or loose and p.has_article) and not rival
            or loose and p.for_ and p.has_article and most
        )


class _Tags:
    """Where tags end: at the next ``>`` outside quotes.

    Every quote is followed once, whichever tags lead to it, so that a page of tags without an end
    takes no longer than others.
    """

    def __init__(self, html: str):
        self.html = html
        self.after: dict[int, int] = {}
        self.special = (-1, -1)

    def _next_special(self, at: int) -> int:
        start, place = self.special
        if not start <= at <= place:
            m = _SPECIAL.search(self.html, at)
            place = m.start() if m else len(self.html)
            self.special = (at, place)
        return place

    def end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag whose attributes start at ``at``, -1 without one."""
        html, seen, found = self.html, [], -1
        while True:
            place = self._next_special(at)
            if place == len(html):
                break
            if html[place] == ">":
                found = place
                break
            if place in self.after:
                found = self.after[place]
                break
            seen.append(place)
            close = html.find(html[place], place + 1)
            if close < 0:
                break
            at = close + 1
        for place in seen:
            self.after[place] = found
        return found


class _Paths:
    """The different paths of a page's containers as a tree: parent, own name, check sum and length."""

    def __init__(self):
        self.known: dict[tuple[int, str], int] = {}
        self.parent, self.name, self.sum, self.length = [], [], [], []

    def below(self, parent: int, name: str) -> int:
        at = self.known.get((parent, name))
        if at is None:
            at = self.known[parent, name] = len(self.parent)
            raw = name.encode("utf-8", "surrogatepass")
            whole = raw if parent < 0 else b"/" + raw
            self.sum.append(zlib.crc32(whole, self.sum[parent] if parent >= 0 else 0))
            self.length.append(len(whole) + (self.length[parent] if parent >= 0 else 0))
            self.parent.append(parent)
            self.name.append(name)
        return at

    def chain(self, at: int) -> list[int]:
        """The containers from the outermost one to ``at``."""
        steps = []
        while at >= 0:
            steps.append(at)
            at = self.parent[at]
        return steps[::-1]

    def path(self, at: int) -> str:
        return "/".join(self.name[i] for i in self.chain(at))

    def find(self, path: str) -> int:
        """The container with a path, -1 without one."""
        raw = path.encode("utf-8", "surrogatepass")
        want = (zlib.crc32(raw), len(raw))
        for at, have in enumerate(zip(self.sum, self.length)):
            if have == want and self.path(at) == path:
                return at
        return -1

    def summed(self, own: dict[int, float], share: float = 1.0) -> list[float]:
        """Per container its own value and ``share`` of those right below it, all the way up."""
        total = [float(own.get(i, 0)) for i in range(len(self.parent))]
        for at in range(len(total) - 1, -1, -1):
            if self.parent[at] >= 0:
                total[self.parent[at]] += share * total[at]
        return total


class Blocks(list):
    """The blocks of a page: (container, text, share of it inside links, whether a name speaks for it).

    ``paths`` is the tree of containers; a block outside of all has container -1.
    """

    def __init__(self, rows, paths: _Paths):
        super().__init__(rows)
        self.paths = paths


def blocks(html: str) -> Blocks:
    """The page's blocks of text outside what is left out, in order, in time linear in the page."""
    found: list = []
    stack: list[tuple[str, bool, bool, _Part]] = []  # tag, left out, for, part around it
    opened: dict[str, list[int]] = defaultdict(list)  # the places in the stack of each tag
    blocky: list[int] = []  # the places in the stack of blocks
    paths, inside = _Paths(), [-1]
    dropped, links, speaks, headings = 0, 0, 0, 0
    pieces: list[tuple[str, _Part, bool]] = []
    page = part = _Part()
    parts, tags = [page], _Tags(html)
    at = searched = 0

    def flush():
        if pieces:
            found.append((inside[-1], pieces.copy(), speaks > 0))
            pieces.clear()

    def text_until(end: int):
        if end > at and not dropped:
            piece = html[at:end]
            piece = unescape(piece) if "&" in piece else piece
            pieces.append((piece, part, links > 0))
            n = len(piece.strip())
            part.all += n
            if not headings:
                part.plain += n
                part.speaks += n if speaks else 0

    def pop():
        nonlocal dropped, links, speaks, headings, part
        tag, out, for_, part = stack.pop()
        opened[tag].pop()
        dropped -= out
        speaks -= for_
        links -= tag == "a"
        headings -= tag in _HEADINGS
        if tag in _BLOCKS or tag in _CONTAINERS:
            blocky.pop()
        if tag in _CONTAINERS:
            inside.pop()

    while True:
        m = _OPEN.search(html, searched)
        if m and m[4] is not None:
            end = tags.end(m.end())
            if end < 0:
                # Not a tag: its characters are text.
                searched = m.end()
                continue
        text_until(m.start() if m else len(html))
        if not m:
            break
        if m[4] is None:
            close, width = ("-->", 3) if m[1] else (">", 1)
            end = html.find(close, m.end() if m[1] else m.start())
            at = searched = end + width if end >= 0 else len(html)
            continue
        attributes = html[m.end() : end]
        at = searched = end + 1
        tag = m[4].lower()
        if tag == "br":
            pieces.append((" ", part, False)) if not dropped else None
            continue
        if tag in _BLOCKS and not dropped:
            flush()
        if m[3]:
            if opened[tag] and (tag in _BLOCKS or not blocky or opened[tag][-1] > blocky[-1]):
                start = opened[tag][-1]
                while len(stack) > start:
                    pop()
            continue
        if tag in _VOID or attributes.endswith("/") and tag not in _BLOCKS:
            continue
        if tag in _RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            end = html.find(">", close.end()) if close else -1
            at = searched = end + 1 if end >= 0 else len(html)
            continue
        if tag in _BLOCKS:
            # A paragraph ends where another block begins, a list item where the next one does.
            for own in ("p", tag) if tag in ("li", "dt", "dd", "tr", "td", "th") else ("p",):
                if blocky and stack[blocky[-1]][0] == own:
                    start = blocky[-1]
                    while len(stack) > start:
                        pop()
        if tag == "body":
            while stack:
                pop()
        first, words, against, named, main = (
            _names(attributes) if "=" in attributes else ("", set(), *[False] * 3)
        )
        out = tag in _DROPPED
        for_ = tag in ("article", "main") or bool(words & _FOR)
        if tag in _CONTAINERS:
            name = f"{tag}.{re.sub(r'[0-9]+', '#', first)}" if first else tag
            inside.append(paths.below(inside[-1], name))
        if tag in _BLOCKS or tag in _CONTAINERS:
            blocky.append(len(stack))
        opened[tag].append(len(stack))
        stack.append((tag, out, for_, part))
        dropped += out
        speaks += for_
        links += tag == "a"
        headings += tag in _HEADINGS
        main |= tag == "main"
        against &= tag not in ("html", "body") and not main
        if not dropped and (against or main or tag == "article"):
            part = _Part(part, tag, against, named, bool(words & _FOR), main)
            parts.append(part)
    flush()
    _left_out(parts)
    return Blocks(_kept(found, False) or _kept(found, True), paths)


def _kept(found: list, everything: bool) -> list[tuple[int, str, float, bool]]:
    """The blocks that have text outside the parts left out, or with it."""
    kept = []
    for container, pieces, speaks in found:
        inside = [(piece, linked) for piece, part, linked in pieces if everything or not part.out]
        text = " ".join("".join(piece for piece, _ in inside).split())
        if text:
            linked = sum(len(piece) for piece, linked in inside if linked)
            kept.append((container, text, min(1.0, linked / len(text)), speaks))
    return kept


def best_path(found: Blocks) -> str | None:
    """The path of the whole text around the container with the best score.

    A block counts half as much at each level up, so the best container may be a part of the article.
    Of equally good ones the last in the page counts.
    """
    worth: dict[int, float] = defaultdict(float)
    for container, text, linked, speaks in found:
        worth[container] += len(text) * (1 - linked) * (1.5 if speaks else 1)
    worth.pop(-1, None)
    if not worth:
        return None
    score = found.paths.summed(worth, 0.5)
    held = found.paths.summed(dict.fromkeys(worth, 1))
    return _whole(found, max((i for i, n in enumerate(held) if n), key=lambda i: (score[i], i)))


def _whole(found: Blocks, best: int) -> str:
    """Of ``best`` and the containers around it: the outermost article, else the innermost main, else
    the innermost one that holds nearly all text, and the ones right around that whose class speaks for
    them."""
    paths = found.paths
    chain = paths.chain(best)
    tags = [paths.name[i].partition(".")[0] for i in chain]
    if "article" in tags:
        return paths.path(chain[tags.index("article")])
    if "main" in tags:
        return paths.path(chain[len(tags) - 1 - tags[::-1].index("main")])
    sizes: dict[int, float] = defaultdict(float)
    for container, text, _, _ in found:
        sizes[container] += len(text)
    least = NEARLY_ALL * sum(sizes.values())
    total = paths.summed(sizes)
    at = len(chain) - 1
    while at and total[chain[at]] < least:
        at -= 1
    while at and not _FOR.isdisjoint(_WORD.findall(paths.name[chain[at - 1]].partition(".")[2].lower())):
        at -= 1
    return paths.path(chain[at])


def main_text(html: str, path: str | None) -> str:
    """The blocks below the path; else below the page's own best path; else all."""
    found = blocks(html)
    for chosen in (path, best_path(found)):
        top = found.paths.find(chosen) if chosen is not None else -1
        if top < 0:
            continue
        # Containers come after those around them.
        below = [i == top for i in range(len(found.paths.parent))]
        for i in range(top + 1, len(below)):
            below[i] |= found.paths.parent[i] >= 0 and below[found.paths.parent[i]]
        inside = [text for container, text, _, _ in found if container >= 0 and below[container]]
        if inside:
            return " ".join(inside)
    return " ".join(text for _, text, _, _ in found)


def _votes(html: pa.Array) -> pa.Array:
    return pa.array([best_path(blocks(h)) for h in html.to_pylist()], pa.string())


def _extract(html: pa.Array, path: pa.Array) -> pa.Array:
    pages = zip(html.to_pylist(), path.to_pylist())
    return pa.array([main_text(h, p) for h, p in pages], pa.string())


def host_of(url: str | Column) -> Column:
    column = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    return F.lower(F.regexp_extract(column, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?([^/?#]*)", 1))


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path: of each host the path with most votes, of equal ones the last by name."""
    html = F.coalesce("html", F.lit(""))
    votes = (
        pages.select(host_of("url").alias("host"), F.arrow_udf(_votes, StringType())(html).alias("path"))
        .where("path IS NOT NULL")
        .groupBy("host", "path")
        .agg(F.count(F.lit(1)).alias("votes"))
    )
    return votes.groupBy("host").agg(F.max_by("path", F.struct("votes", "path")).alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    (won,) = broadcast_if_small(frozen(host_paths(pages), "host-paths"))
    placed = rows.withColumn("host", host_of("url")).join(won, "host", "left")
    text = F.arrow_udf(_extract, StringType())("html", "path")
    return placed.select("page_id", "url", text.alias("text")).withColumn(
        "n_chars", F.length("text").cast("long")
    )

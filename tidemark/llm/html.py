"""Main text of HTML pages by minimum-cut labelling of their text blocks.

A page is read into blocks: runs of text between block-level tags, each with what its ancestors say.  A fixed
linear classifier gives each block a score; positive scores are capacities from the source (content),
negative ones to the sink (boilerplate).  Consecutive blocks are tied by an edge that weakens with their
distance in the DOM, and blocks of one container to the next block of that container.  The minimum cut
is the labelling with the least sum of overruled scores and cut ties; it is found by max-flow.  A block whose
score is at least the sum of its ties keeps its sign in some minimum cut, so such blocks are
settled first, again and again, and only what is left goes through augmenting paths.

A block carries the evidence of its innermost telling ancestor: comments, adverts, forms and footers inside an article are
boilerplate at any length.

Edge cases: null and empty pages, an empty table and pages without content blocks give an empty text or no rows; columns of the names used inside are ignored; pages cut off in a
tag, a comment or a script lose only that; character references are decoded as browsers do; repeated rows are extracted
one by one; deep or very long pages are read without recursion, whole.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import bounded_batches, slices

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z""", re.S)
_ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_NAME = re.compile(r"[a-z]+")
_PLAIN = re.compile(r"(?<![\w-])[a-z]+(?=[-_](?:\d+|box|section|area|list|block|wrapper|container|slot)\b)")

BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SKIP = RAW | frozenset("head noscript template svg object canvas select button datalist audio video".split())
ENDS_ITEM = {"li": ("li", ("ul", "ol", "menu")), "dd": ("dd dt", ("dl",)), "dt": ("dd dt", ("dl",)), "tr": ("tr td th", ("table",)),
             "td": ("td th", ("table", "tr")), "th": ("td th", ("table", "tr")), "option": ("option", ("select",))}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Fixed values of the classifier: what ancestors' tags and names say about a block.
PAGE_PARTS = frozenset("nav aside footer form menu dialog fieldset".split())
BOILERPLATE_NAMES = frozenset("""ad ads adbox adslot advert advertisement advertising banner breadcrumb breadcrumbs byline comment comments commentlist complementary
consent contentinfo cookie cookies copyright disclaimer disqus disclosure footer footnav form gdpr header login masthead menu menubar modal nav navbar
navigation newsletter notice notification overlay pager pagination popup promo promoted promotion recommended reply replies related search share sharing
sidebar signup sitemap skip social sponsor sponsored subscribe subscription tags toolbar topbar widget""".split())
CONTENT_NAMES = frozenset("article articlebody body content entry main maincontent post postbody story text".split())
# Names that mark a box as boilerplate whatever it is written on, where they are a whole class or id.
STRONG_NAMES = frozenset("""ad ads advert advertisement comment comments commentlist recommended related replies reply promo promoted sidebar sponsored
newsletter disqus""".split())
IN_PART, IN_NAMED, IN_ARTICLE, IN_CONTENT, HEADING, LINK, SKIPPED, IN_STRONG = 1, 2, 4, 8, 16, 32, 64, 128
W_PART, W_NAMED, W_ARTICLE, W_CONTENT, W_LINKS, W_HEADING, W_WORD, W_SENTENCE, BIAS = -8.0, -8.0, 4.0, 2.0, -4.0, 0.3, 0.9, 0.8, -1.0
TIE, SIBLING = 0.8, 0.4


@dataclass
class Block:
    text: str
    flags: int
    linked: int  # characters inside links
    path: tuple[int, ...]  # numbers of the block-level ancestors


def _own_flags(tag: str, attrs: str, above: int) -> int:
    flags = above
    if tag == "a":
        flags |= LINK
    if tag in SKIP:
        flags |= SKIPPED
    if tag in HEADINGS:
        flags |= HEADING
    good = IN_ARTICLE if tag in ("article", "main") else 0
    bad = IN_PART if tag in PAGE_PARTS or tag == "header" and not above & (IN_ARTICLE | IN_CONTENT) else 0
    if attrs and tag not in ("html", "body", "a"):
        for m in _ATTR.finditer(attrs):
            said = (m[1] or m[2] or m[3] or "").lower()
            names = set(_NAME.findall(said))
            strong = STRONG_NAMES & {*said.split(), *_PLAIN.findall(said)}
            if strong or names & BOILERPLATE_NAMES and not good:
                bad |= IN_NAMED | (IN_STRONG if strong else 0)
            elif names & CONTENT_NAMES:
                good |= IN_CONTENT
        if _HIDDEN.search(attrs):
            flags |= SKIPPED
    # The innermost evidence counts: a boilerplate box inside the article is none of it; an article inside a box that
    # only its name speaks against is one, but not inside a page part or among comments or adverts.
    if bad:
        return flags & ~(IN_ARTICLE | IN_CONTENT) | bad
    if good and not flags & (IN_PART | IN_STRONG):
        return flags & ~IN_NAMED | good
    return flags


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in page order."""
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = [("", 0, 0)]  # tag, number of the element, flags
    pieces: list[str] = []
    linked = serial = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(_html.unescape("".join(pieces)).split())
            if text:
                out.append(Block(text, stack[-1][2] & ~LINK, linked, tuple(n for t, n, _ in stack if not t or t in BLOCK)))
            pieces.clear()
            linked = 0

    def close(names: tuple[str, ...] | list[str], fence: tuple[str, ...] | frozenset) -> None:
        """Pop up to the nearest element of these names unless a fence stands before it."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                del stack[k:]
                return
            if stack[k][0] in fence:
                return

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        stop = m.start() if m else end
        if stop > at and not stack[-1][2] & SKIPPED:
            pieces.append(page[at:stop])
            if stack[-1][2] & LINK:
                linked += stop - at
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag in BLOCK:
                flush()
                close([tag], () if tag != "p" else ("div", "article", "section", "td", "body"))
            else:
                close([tag], BLOCK)
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if stack[-1][2] & SKIPPED and tag == "body":
                close(["head"], ())
            close(["p"], BLOCK - {"p"} - HEADINGS)
            if tag in ENDS_ITEM:
                names, fence = ENDS_ITEM[tag]
                close(names.split(), fence)
        if tag in VOID:
            continue
        attrs = m[3] or m[6] or ""
        serial += 1
        stack.append((tag, serial, _own_flags(tag, attrs, stack[-1][2])))
        if attrs.endswith("/") and tag not in BLOCK and tag not in RAW and tag != "a":
            stack.pop()
        elif tag in RAW:
            done = re.compile(rf"</{tag}[^>]*(?:>|\Z)", re.I).search(page, at)
            at = done.end() if done else end
            stack.pop()
    flush()
    return out


def score(b: Block) -> float:
    """Above 0: content."""
    words = b.text.count(" ") + 1
    s = BIAS + W_WORD * min(math.log(1 + words), 5.0)
    if b.text[-1] in ".!?…。؟\"”»":
        s += W_SENTENCE
    if b.linked:
        s += W_LINKS * min(1.0, b.linked / len(b.text))
    for flag, w in ((IN_PART, W_PART), (IN_NAMED, W_NAMED), (IN_ARTICLE, W_ARTICLE), (IN_CONTENT, W_CONTENT), (HEADING, W_HEADING)):
        if b.flags & flag:
            s += w
    return s


def ties(parts: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: neighbours, weaker the further apart in the DOM, and next blocks of a container."""
    out = []
    last: dict[int, int] = {}
    for i, b in enumerate(parts):
        if i:
            a = parts[i - 1].path
            same = 0
            for x, y in zip(a, b.path, strict=False):
                if x != y:
                    break
                same += 1
            out.append((i - 1, i, TIE / max(1, len(a) + len(b.path) - 2 * same)))
        box = b.path[-2] if len(b.path) > 1 else -1
        if box in last and last[box] != i - 1:
            out.append((last[box], i, SIBLING))
        last[box] = i
    return out


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Content labels of a minimum cut: the fewest overruled scores plus cut ties; undecided blocks are boilerplate."""
    n = len(scores)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, c in edges:
        near[i][j] = near[i].get(j, 0.0) + c
        near[j][i] = near[j].get(i, 0.0) + c
    unary, label = list(scores), [None] * n
    todo = deque(range(n))
    while todo:  # settle blocks that their ties cannot overrule
        i = todo.popleft()
        if label[i] is not None or unary[i] == 0 or abs(unary[i]) < sum(near[i].values()):
            continue
        label[i] = unary[i] > 0
        for j, c in near[i].items():
            unary[j] += c if label[i] else -c
            del near[j][i]
            if label[j] is None:
                todo.append(j)
        near[i] = {}
    if None in label:
        for i, content in enumerate(_flow(unary, near, [k for k in range(n) if label[k] is None])):
            if content is not None:
                label[i] = content
    return label


def _flow(unary: list[float], near: list[dict[int, float]], nodes: list[int]) -> list[bool | None]:
    """Shortest augmenting paths from blocks with source capacity to blocks with sink capacity."""
    n = len(unary)
    give = [max(0.0, u) for u in unary]
    take = [max(0.0, -u) for u in unary]
    room = [dict(x) for x in near]  # residual capacities
    while True:
        back: dict[int, int] = {i: -1 for i in nodes if give[i] > 1e-12}
        queue, goal = deque(back), -1
        while queue:
            i = queue.popleft()
            if take[i] > 1e-12:
                goal = i
                break
            for j, c in room[i].items():
                if c > 1e-12 and j not in back:
                    back[j] = i
                    queue.append(j)
        if goal < 0:
            inside = set(back)  # what the source still reaches
            out: list[bool | None] = [None] * n
            for i in nodes:
                out[i] = i in inside
            return out
        path = [goal]
        while back[path[-1]] >= 0:
            path.append(back[path[-1]])
        push = min(take[goal], give[path[-1]], *(room[path[k + 1]][path[k]] for k in range(len(path) - 1)))
        take[goal] -= push
        give[path[-1]] -= push
        for k in range(len(path) - 1):
            room[path[k + 1]][path[k]] -= push
            room[path[k]][path[k + 1]] = room[path[k]].get(path[k + 1], 0.0) + push


def main_text(page: str | None) -> str:
    parts = blocks(page) if page else []
    if not parts:
        return ""
    keep = min_cut([score(b) for b in parts], ties(parts))
    return "\n".join(b.text for b, k in zip(parts, keep, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row; ``pages`` has page_id, url, html."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            texts = [main_text(h) for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))],
                                             names=["page_id", "url", "text", "n_chars"])

    bounded_batches(pages.sparkSession)
    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")

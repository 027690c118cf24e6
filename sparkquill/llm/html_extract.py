"""Main-text extraction by minimum-cut labelling.

A page is cut into blocks at block-level tags. A logistic classifier over a block's place in the DOM, its links and its words gives
the log-odds of content; these costs become capacities from the source and to the sink. Blocks that follow each other and
blocks with the same parent are joined by smoothness edges. The minimum cut, found by augmenting paths, separates content from
boilerplate. All costs are finite: what a page's marks say (menus, forms, class names) is evidence with a fitted weight, which a
block's own text and its neighbours can outweigh. The classifier is fitted to the labelled pages of `labelled_pages`.
Only what a browser doesn't show (scripts, styles, hidden elements) is no block at all.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill.llm.common import table, text_chunks

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|</?[a-zA-Z][^>]*>|[^<]+|<", re.S)
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
#: One attribute: its whole name, and its value if it has one.
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "textarea", "title", "object", "canvas"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: What an open tag of this name closes by itself.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Block tags that close an open paragraph.
ENDS_P = BLOCK - {"html", "head", "body"}
AWAY = {"nav", "footer", "aside", "form", "menu", "header", "select", "button", "dialog", "fieldset"}
HOME = {"article", "main"}
#: Words of class names, ids and roles that speak of boilerplate and of content.
AWAY_WORD = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|signup|"
    r"nav\w*|menu|breadcrumbs?|footer|header|masthead|side-?bar|widget|related|recommend\w*|share|sharing|social|comments?|"
    r"disqus|replies|respond|login|search|pagination|pager|tags?|toolbar|complementary|contentinfo",
    re.I,
)
HOME_WORD = re.compile(r"article|content|entry|post|story|main|text|body", re.I)
#: A class that begins so tells how the page is laid out, not what the element is.
LAYOUT = re.compile(r"(?:has|no|is|with|without|hide|show)[-_]", re.I)
TITLES = {"header", "masthead", "banner"}
#: Strength of the ridge that keeps fitted weights finite, largest cost of a block, and capacities of the smoothness edges.
RIDGE, LARGEST, FOLLOWS, SIBLINGS = 0.001, 8.0, 0.3, 1.2
#: Cost of the best block of a page where no block would be content: more than the edges of a block with one neighbour of the other kind on each side.
FOR_PAGE = 2 * (FOLLOWS + SIBLINGS) + 0.1


class Open:
    """What is known inside an open tag."""

    __slots__ = ("name", "number", "away", "strong", "weak", "inside", "home", "home_hint", "pure")

    def __init__(self, name="", number=0, away=False, strong=False, weak=False, inside=False, home=False, home_hint=False, pure=False):
        self.name, self.number, self.away, self.strong, self.weak = name, number, away, strong, weak
        self.inside, self.home, self.home_hint, self.pure = inside, home, home_hint, pure

    def child(self, name: str, number: int, said: list[str], gone: bool) -> "Open":
        """The state in a tag of this name; `said` are its class tokens, id and role."""
        new = Open(name, number, self.away, self.strong, self.weak, self.inside, self.home, self.home_hint, self.pure)
        titled = name == "header" and self.home  # an article's own header holds its title
        new.away |= name in AWAY and not titled or gone
        if name == "main" or name in HOME and not self.pure:  # class names outside say little of what is in an article
            new.home, new.strong, new.weak, new.pure = True, False, False, False
        elif name not in ("html", "body"):
            # a name of nothing but boilerplate, on an element without a name of content: articles in it are teasers or comments
            kinds = [[w for w in re.split(r"[-_]+", t) if w] for t in said if not LAYOUT.match(t)]
            plain = any(HOME_WORD.fullmatch(w) for ws in kinds for w in ws)
            new.pure |= not self.home and not plain and any(ws and all(AWAY_WORD.fullmatch(w) for w in ws) for ws in kinds)
            for token in said:
                words = [w for w in re.split(r"[-_]+", token) if w]
                if LAYOUT.match(token) or not words:
                    continue
                away = [bool(AWAY_WORD.fullmatch(w)) and not (self.home and w.lower() in TITLES) for w in words]
                if self.home:
                    new.inside |= away[0] or away[-1]
                else:
                    # the last word names the element: main-nav is a menu, nav-open is not
                    new.strong |= away[-1] or bool(AWAY_WORD.fullmatch(token))
                    new.weak |= away[0]
                    new.home_hint |= any(HOME_WORD.fullmatch(w) for w in words) and not any(away)
        return new


class Block:
    __slots__ = ("parts", "tag", "parent", "at", "linked")

    def __init__(self, tag: str, parent: int, at: Open):
        self.parts, self.tag, self.parent, self.at, self.linked = [], tag, parent, at, 0


def attributes(token: str, name: str) -> tuple[list[str], bool, bool]:
    """(class tokens, id and role; whether a browser hides the element; whether it is marked as not for readers)."""
    said, hidden, mute = [], False, False
    for m in ATTRIBUTE.finditer(token, len(name) + 1):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key in ("class", "id", "role"):
            said += value.split()
        elif key == "hidden":
            hidden = True
        elif key == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
        elif key == "aria-hidden":
            mute = value.strip().lower() == "true"
    return said, hidden, mute


def blocks(page: str) -> list[tuple[Block, str]]:
    """(block, its text) in page order; blocks without text are left out."""
    stack = [Open()]
    out, current, number, links, unseen = [], None, 0, 0, 0
    at, size, closed_last = 0, len(page), page.rfind(">")
    while at < size:
        rest = at > closed_last
        if rest:  # no tag can end any more: what is left is text, up to an open comment
            at, token = size, page[at:].partition("<!--")[0]
            if not token:
                break
        else:
            m = TOKEN.match(page, at)
            at, token = m.end(), m.group()
        if rest or token[0] != "<" or token == "<":
            if unseen:
                continue
            if current is None:
                tag = next((s.name for s in reversed(stack) if s.name in BLOCK), "")
                holder = next((s.number for s in reversed(stack[:-1]) if s.name in BLOCK or not s.name), 0)
                current = Block(tag, holder, stack[-1])
                out.append(current)
            current.parts.append(token)
            if links:
                current.linked += len(token)
            continue
        named = NAME.match(token)
        if not named:
            continue
        name = named.group(1).lower()
        if token[1] == "/":
            if name in BLOCK:
                current = None
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    links -= sum(s.name == "a" for s in stack[i:])
                    del stack[i:]
                    break
                if name not in BLOCK and stack[i].name in BLOCK:
                    break
            if unseen > len(stack) - 1:
                unseen = 0
            continue
        if name in RAW:
            if not token.endswith("/>"):
                end = re.compile(rf"</{name}\b[^>]*>|\Z", re.I).search(page, at)
                at = end.end()
            continue
        if name in BLOCK:
            current = None
            closed = CLOSES.get(name, set()) | ({"p"} if name in ENDS_P else set())
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in closed:
                    links -= sum(s.name == "a" for s in stack[i:])
                    del stack[i:]
                    break
                if stack[i].name in BLOCK and stack[i].name not in closed:
                    break
            if unseen > len(stack) - 1:
                unseen = 0
        if name == "br" and current is not None:
            current.parts.append(" ")
        if name in VOID or token.endswith("/>"):
            continue
        number += 1
        said, hidden, mute = attributes(token, name) if len(token) > len(name) + 2 else ([], False, False)
        stack.append(stack[-1].child(name, number, said, mute))
        links += name == "a"
        if (hidden or name == "head") and not unseen:
            unseen = len(stack) - 1  # up to where this tag ends
    found = ((b, " ".join(html.unescape("".join(b.parts)).split())) for b in out)
    return [(b, t) for b, t in found if t]


FEATURES = (
    "bias", "home", "outside", "home_hint", "away", "strong", "weak", "inside", "paragraph", "heading", "item", "links", "home_links", "words", "sentences", "short",
)
ENDS = re.compile(r"[.!?…。！？](?:\s|$|[\"'”’)])")


def linked(b: Block, t: str) -> float:
    """The share of a block's text that is in links."""
    return min(1.0, b.linked / max(1, len(t)))


def features(found: list[tuple[Block, str]]) -> list[list[float]]:
    """A row of FEATURES for each block of a page. `outside` is the share of the page's text that lies in its articles, for blocks that don't."""
    total = sum(len(t) for _, t in found) or 1
    share = sum(len(t) for b, t in found if b.at.home and not b.at.away) / total
    rows = []
    for b, t in found:
        at, words, ends = b.at, len(t.split()), len(ENDS.findall(t))
        home = at.home and not at.away
        rows.append([
            1.0, float(home), share * (not home), float(at.home_hint and not home), float(at.away), float(at.strong), float(at.weak and not at.strong), float(at.inside),
            float(b.tag in ("p", "pre", "blockquote", "dd", "figcaption")), float(b.tag in ("h1", "h2", "h3", "h4", "h5", "h6")), float(b.tag in ("li", "td", "th", "dt")),
            linked(b, t), linked(b, t) * home, math.log1p(words) / 2, min(3, ends) / 3, float(words <= 4 and not ends),
        ])
    return rows


#: Pages for the classifier. [+n] is a content block of n words in sentences, [-n] a block of boilerplate; a ! after n means that no sentence ends.
PAGES = (
    "<body><header><a href=x>[-2!]</a></header><nav><ul><li><a href=x>[-1!]</a><li><a href=x>[-2!]</a></ul></nav><div class=ad>[-12]</div><article><h1>[+9!]</h1><p>[+60]</p><p>[+4]</p><p>[+120]</p></article><footer>[-14]</footer></body>",
    "<nav><a href=x>[-1!]</a></nav><div class='sidebar'><p>[-20]</p><a href=x>[-5!]</a></div><main><h1>[+6!]</h1><p>[+80]</p><h2>[+3!]</h2><p>[+30]</p><ul><li>[+6!]<li>[+14]</ul></main><div class=footer>[-9!]</div>",
    "<div id=header>[-4!]</div><div id=nav><ul><li><a href=x>[-1!]</a><li><a href=x>[-1!]</a></ul></div><div id=content><h1>[+7!]</h1><p>[+45]</p><p>[+7]</p><p>[+90]</p></div><div id=comments><p>[-25]</p><p>[-10]</p></div><div id=footer>[-8!]</div>",
    "<div class='container has-sidebar'><article><h1>[+8!]</h1><p>[+50]</p><p>[+5]</p><aside>[-15]</aside><form>[-6]<button>[-1!]</button></form><p>[+70]</p></article></div><footer>[-10]</footer>",
    "<article class='post hentry tag-news'><header><h1>[+10!]</h1></header><p>[+35]</p><blockquote>[+20]</blockquote><p>[+66]</p><div class=comments><p>[-30]</p><p>[-12]</p></div><div class='share-buttons'><a href=x>[-1!]</a></div></article>",
    "<table><tr><td><a href=x>[-2!]</a><td><a href=x>[-2!]</a></tr></table><div><p>[+40]</p><p>[+6]</p><p>[+85]</p></div><div><a href=x>[-3!]</a></div><div>[-5!]</div>",
    "<div><a href=x>[-2!]</a><a href=x>[-3!]</a></div><div><h1>[+6!]</h1><p>[+30]</p><p>[+12]</p><pre>[+20!]</pre><p>[+55]</p></div><div><p><a href=x>[-8!]</a></p><p><a href=x>[-7!]</a></p></div><div>[-6!]</div>",
    "<div class='related'><article><h3><a href=x>[-7!]</a></h3></article></div><div class='story-body'><p>[+90]</p><p>[+8]</p><p>[+75]</p><p>[+40]</p></div><div class='cookie-notice'><p>[-18]</p></div>",
    "<div class='nav-open'><div class='page-wrap'><main><p>[+44]</p><p>[+3]</p><div class='comment-list'><p>[-22]</p></div><div class='newsletter'><p>[-14]</p></div></main></div></div>",
    "<body><p>[+25]</p><p>[+60]</p><p>[+6]</p></body>",
    "<div class='promo-banner'><p>[-11]</p></div><div><dl><dt>[+2!]<dd>[+18]<dt>[+2!]<dd>[+25]</dl><p>[+33]</p></div><div><ul><li><a href=x>[-3!]</a><li><a href=x>[-4!]</a></ul></div><div>[-7!]</div>",
    "<section class=content><h2>[+5!]</h2><p>[+70]</p><figure><figcaption>[+9]</figcaption></figure><p>[+28]</p></section><section><h2>[-2!]</h2><ul><li><a href=x>[-6!]</a><li><a href=x>[-5!]</a></ul></section>",
    "<div class=top-menu><a href=x>[-1!]</a></div><article><p>[+5]</p><p>[+150]</p><ul><li>[+8]<li>[+3!]</ul><div class='ad-slot'>[-9]</div><p>[+24]</p><div class=tags><a href=x>[-1!]</a></div></article><article><p>[+64]</p></article>",
    "<div><div>[+55]</div><div>[+90]</div><div>[+22]</div></div><div><div>[-3!]</div><div><a href=x>[-2!]</a></div></div>",
    "<div><span>[-2!]</span></div><div>[+130]</div><div>[-5!]</div><div>[-3!]</div>",
    "<div><div>[-4!]</div><div>[-2!]</div></div><div><div>[+38]</div><div>[+75]</div><div>[+16]</div></div>",
    "<nav><a href=x>[-1!]</a><a href=x>[-2!]</a></nav><article><h1>[+4!]</h1><p>[+30]</p><ul><li><a href=x>[+6!]</a><li><a href=x>[+4!]</a><li><a href=x>[+7!]</a></ul><p>[+9]</p><div class=tags><a href=x>[-1!]</a><a href=x>[-1!]</a></div></article>",
    "<header><a href=x>[-2!]</a></header><article><h2>[+3!]</h2><ul><li><a href=x>[+5!]</a><li><a href=x>[+8!]</a><li><a href=x>[+3!]</a></ul></article><ul><li><a href=x>[-1!]</a><li><a href=x>[-3!]</a></ul>",
    "<article><h1>[+5!]</h1><p>[+70]</p></article><div class=related><article><h3><a href=x>[-6!]</a></h3><p>[-9]</p></article><article><p>[-7]</p></article></div><div id=comments><article><p>[-21]</p></article></div>",
    "<div role=navigation><a href=x>[-2!]</a></div><div><p>[+52]</p><p>[+9]</p></div><div aria-hidden=true>[-3!]</div><div role=contentinfo>[-12]</div>",
)
MARK = re.compile(r"\[([+-])(\d+)(!?)\]")
#: Signs that carry a label through the cutting into blocks.
CONTENT, OTHER = "\ue001", "\ue000"


def labelled_pages(pages=PAGES) -> list[tuple[list[tuple[Block, str]], list[bool]]]:
    """(blocks, labels) of each page."""

    def words(m) -> str:
        n = int(m[2])
        ends = "" if m[3] else "."
        return (CONTENT if m[1] == "+" else OTHER) + " ".join("word" + (ends if i == n - 1 or i % 12 == 11 else "") for i in range(n))

    out = []
    for page in pages:
        found = blocks(MARK.sub(words, page))
        out.append(([(b, t.strip(CONTENT + OTHER)) for b, t in found], [t[0] == CONTENT for _, t in found]))
    return out


@lru_cache
def weights() -> tuple[float, ...]:
    """Weights of FEATURES: logistic regression with a ridge, by Newton's method, over all blocks of the labelled pages."""
    import numpy as np

    pages = labelled_pages()
    x = np.array([row for found, _ in pages for row in features(found)])
    y = np.array([float(v) for _, labels in pages for v in labels])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (p - y) / len(y) + RIDGE * w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(y) + RIDGE * np.eye(len(w)), slope)
    return tuple(float(v) for v in w)


def evidence(found: list[tuple[Block, str]]) -> list[float]:
    """Log-odds of content of each block, no larger than LARGEST either way."""
    w = weights()
    return [max(-LARGEST, min(LARGEST, sum(a * b for a, b in zip(w, row)))) for row in features(found)]


def minimum_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which blocks are on the source's side. costs: log-odds, as capacity from the source or to the sink.

    Flow goes from each block on to the nearest ones that the sink still takes from. Blocks that are reached when none is
    left can't reach the sink any more: they are the source's side, and later searches pass them by, so that
    a search stays near its block on a page of any length.
    """
    n = len(costs)
    give, take = [max(z, 0.0) for z in costs], [max(-z, 0.0) for z in costs]
    near: list[list[int]] = [[] for _ in range(n)]
    to, room = [], []
    for a, b, c in edges:
        near[a].append(len(to))
        near[b].append(len(to) + 1)
        to += (b, a)
        room += (c, c)
    cut_off = [False] * n
    for i in range(n):
        while give[i] > 1e-9 and not cut_off[i]:
            came, queue, at = {i: -1}, deque([i]), -1
            while queue:
                a = queue.popleft()
                if take[a] > 1e-9:
                    at = a
                    break
                for e in near[a]:
                    if room[e] > 1e-9 and to[e] not in came and not cut_off[to[e]]:
                        came[to[e]] = e
                        queue.append(to[e])
            if at < 0:
                for a in came:
                    cut_off[a] = True
                break
            path, a = [], at
            while a != i:
                path.append(came[a])
                a = to[came[a] ^ 1]
            flow = min(give[i], take[at], *(room[e] for e in path))
            give[i] -= flow
            take[at] -= flow
            for e in path:
                room[e] -= flow
                room[e ^ 1] += flow
    return cut_off


def label(found: list[tuple[Block, str]]) -> list[bool]:
    """Which blocks are content: the labelling whose costs and smoothness edges between different labels are least in sum.

    A page has a text, unless all it has is marked as boilerplate or links. Where no block is content by its own cost and its neighbours',
    the costs of the blocks that nothing marks (else of those whose class names speak of both kinds) are raised until the best one's is FOR_PAGE.
    """
    costs = evidence(found)
    kept = parted(found, costs)
    if any(kept) or not found:
        return kept
    speaks = [not b.at.away and not b.at.pure and (b.at.home or linked(b, t) < 0.5) for b, t in found]
    plain = [s and not (b.at.strong or b.at.weak or b.at.inside) for s, (b, _) in zip(speaks, found)]
    chosen = plain if any(plain) else speaks
    if not any(chosen):
        return kept
    lift = FOR_PAGE - max(z for z, c in zip(costs, chosen) if c)
    return parted(found, [z + lift if c else z for z, c in zip(costs, chosen)])


def parted(found: list[tuple[Block, str]], costs: list[float]) -> list[bool]:
    """The minimum cut of a page's blocks at these costs."""
    if all(z > 0 for z in costs) or all(z <= 0 for z in costs):
        return [z > 0 for z in costs]
    edges, last = [], {}
    for i, (b, _) in enumerate(found):
        if i:
            edges.append((i - 1, i, FOLLOWS))
        if b.parent in last and last[b.parent] != i - 1:
            edges.append((last[b.parent], i, SIBLINGS))
        elif b.parent in last:
            edges[-1] = (i - 1, i, FOLLOWS + SIBLINGS)
        last[b.parent] = i
    return minimum_cut(costs, edges)


def main_text(page: str | None) -> str:
    """The main text of one page: its content blocks, white space inside each made one space, joined by line breaks."""
    found = blocks(page or "")
    return "\n".join(t for (_, t), keep in zip(found, label(found)) if keep)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """One row per input row: the columns in keep, text (empty if there is none), n_chars (code points).

    Null html counts as empty. Null or repeated ids keep their rows; an empty table gives none; other columns aren't read.
    """
    names = [*keep, "text", "n_chars"]

    def run(batches):
        import pyarrow as pa

        for part in text_chunks(batches):
            texts = [main_text(t) for t in part.column(part.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names,
            )

    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in (pages.schema[c] for c in keep))
    return pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_col}`")).mapInArrow(run, f"{schema}, text string, n_chars bigint")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))

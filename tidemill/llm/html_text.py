"""Main text of web pages: gradient-boosted trees over DOM-node features with hierarchical decoding.

Every element gets features of itself, its subtree, its ancestors and its siblings; boosted trees give the odds that its
subtree holds main text. Decoding walks the tree once from below and picks the best set of kept elements in which no
kept element has a dropped ancestor. No labels come with the pages, so the trees learn from a bounded sample whose
semantic tags give the answer, and from the same texts set in other layouts, where class names and shapes must do.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.sample import smallest_hashes

SAMPLE, TREES, DEPTH, RATE, BINS, LEAST, FEW = 300, 40, 4, 0.3, 32, 20, 50
# Element names, and tokens of attributes that name what an element is for.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())  # their content is no markup; without an end tag it goes to the end of the page
ASIDE = frozenset("noscript template iframe svg select button object canvas".split())  # their content is no text of the page
NESTED = frozenset("template svg object".split())  # of those, the ones that may hold their like
BLOCKS = frozenset("html body p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr td th section article main aside nav header footer form pre blockquote figure figcaption address fieldset hr details summary center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LANDMARKS = frozenset("nav aside header footer form".split())
GOOD = frozenset("article body content entry main post story text".split())
BAD = frozenset("ad ads advert advertisement alert author banner breadcrumb breadcrumbs caption comment comments consent cookie copyright disqus footer form header login menu meta nav navbar navigation newsletter notice pager pagination popup promo promoted related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget".split())
# Elements whose start ends an open p, or an open element of the same kind.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# quotes count right after an equals sign only, and only where they are closed; nothing that was read is given back
TOKEN = re.compile(r"<!--(?s:.*?)(?:-->|\Z)|<![^>]*+>|<\?[^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|itemprop|hidden|aria-hidden)(?![^\s=/])(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]++))?+", re.I)
BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(sorted(BLOCKS))})(?![a-zA-Z0-9:-])", re.I)
FEATURES = 27


class Page:
    """The elements of a page: parent, tag and attribute tokens, and its text in blocks, each owned by an element."""

    def __init__(self, source: str):
        self.parent, self.tag, self.tokens = [-1], ["#root"], [frozenset()]
        self.blocks: list[tuple[int, str]] = []  # owner, text
        self.runs: list[tuple[int, int, int]] = []  # element, characters, characters in links
        self.controls: list[int] = []
        self.read(source)

    def read(self, source: str) -> None:
        """One pass over the source; what is open is known by tag and by block, so no step looks through all of it."""
        stack, blocks, at, buffer, links = [0], [0], 0, [], 0  # blocks: places of open blocks on the stack
        open_: dict[str, int] = {}
        last_close, missing = source.rfind(">"), set()  # missing: elements of which an open one is closed nowhere further on

        def flush() -> None:
            if buffer:
                text = re.sub(r"\s+", " ", "".join(buffer)).strip()
                if text:
                    self.blocks.append((stack[blocks[-1]], text))
                buffer.clear()

        def add(text: str) -> None:
            if text:
                text = html.unescape(text)
                buffer.append(text)
                n = len(text) if not text.isspace() else 0
                if n:
                    self.runs.append((stack[-1], n, n if links else 0))

        def shut(place: int) -> None:
            """Closes all that is open from a place of the stack on."""
            nonlocal links
            for e in stack[place:]:
                open_[self.tag[e]] -= 1
                links -= self.tag[e] == "a"
            del stack[place:]
            while blocks[-1] >= place:
                blocks.pop()

        while at < len(source):
            m = TOKEN.search(source, at) if at <= last_close else None
            if not m:
                comment = source.find("<!--", at)
                add(source[at : comment if comment >= 0 else None])
                break
            add(source[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                if open_.get(tag):
                    if tag in BLOCKS:
                        flush()
                    place = len(stack) - 1
                    while self.tag[stack[place]] != tag:
                        place -= 1
                    shut(place)
                elif tag == "p":
                    flush()
                continue
            if tag in RAW:
                if not m[3].endswith("/"):
                    end = None if tag in missing else re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                    if end:
                        at = end.end()
                    else:
                        missing.add(tag)
                        at = len(source)
                if tag == "textarea":
                    self.controls.append(stack[-1])
                continue
            if tag in ASIDE:
                if not m[3].endswith("/"):
                    at = self.beyond(source, tag, at, missing)
                if tag in ("button", "select"):
                    self.controls.append(stack[-1])
                continue
            if tag in VOID:
                if tag == "br":
                    buffer.append(" ")
                elif tag == "hr":
                    flush()
                elif tag == "input":
                    self.controls.append(stack[-1])
                continue
            if tag in BLOCKS:
                flush()
                ends = CLOSES.get(tag, ())
                for k in range(len(blocks) - 1, 0, -1):
                    name = self.tag[stack[blocks[k]]]
                    if name == "p" or name in ends:
                        shut(blocks[k])
                        break
                    if name not in ("td", "th", "dd"):
                        break
            tokens = set()
            if m[3].strip():
                for name, value in ATTRIBUTE.findall(m[3]):
                    tokens.update(["hidden"] if name.lower() == "hidden" else re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
            self.parent.append(stack[-1])
            self.tag.append(tag)
            self.tokens.append(frozenset(tokens))
            stack.append(len(self.tag) - 1)
            open_[tag] = open_.get(tag, 0) + 1
            links += tag == "a"
            if tag in BLOCKS:
                blocks.append(len(stack) - 1)
        flush()

    @staticmethod
    def beyond(source: str, tag: str, at: int, missing: set[str]) -> int:
        """Where an element of ASIDE ends that began before ``at``. One that isn't closed, or not before the next of its kind where
        they can't nest, ends at the next tag of a block, so that it takes none of the page's text along."""
        marks, depth = re.compile(rf"<(/?){tag}(?![a-zA-Z0-9:-])[^>]*>", re.I), 1
        for mark in marks.finditer(source, at):
            if mark[1]:
                depth -= 1
            elif tag in NESTED and tag not in missing:
                depth += not mark[0].endswith("/>")
            else:
                break
            if not depth:
                return mark.end()
        missing.add(tag)
        block = BLOCK_TAG.search(source, at)
        return block.start() if block else len(source)

    def features(self) -> np.ndarray:
        n = len(self.tag)
        parent = np.array(self.parent)
        own = np.zeros((n, 6))  # of the subtree: characters, linked characters, elements, blocks, blocks that end like sentences, form controls
        own[:, 2] = 1
        for e, chars, linked in self.runs:
            own[e, 0] += chars
            own[e, 1] += linked
        for e, text in self.blocks:
            own[e, 3] += 1
            own[e, 4] += text[-1] in ".!?…\"”»"
        for e in self.controls:
            own[e, 5] += 1
        paragraphs = np.array([t == "p" for t in self.tag], float)
        good = np.array([bool(t & GOOD) or g in ("article", "main") for t, g in zip(self.tokens, self.tag)], float)
        bad = np.array([bool(t & BAD) for t in self.tokens], float)
        landmark = np.array([g in LANDMARKS for g in self.tag], float)
        depth, over_good, over_bad, over_landmark = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        place, children = np.zeros(n), np.zeros(n)
        for e in range(1, n):
            p = parent[e]
            depth[e] = depth[p] + 1
            over_good[e], over_bad[e], over_landmark[e] = over_good[p] + good[p], over_bad[p] + bad[p], over_landmark[p] + landmark[p]
            place[e] = children[p]
            children[p] += 1
        before = np.cumsum(own[:, 0]) - own[:, 0]
        total, p_in = own.copy(), paragraphs.copy()
        for e in range(n - 1, 0, -1):
            total[parent[e]] += total[e]
            p_in[parent[e]] += p_in[e]
        up = np.maximum(parent, 0)
        chars, linked, elements, blocks, sentences, controls = total.T
        like = np.zeros(n)
        groups: dict[tuple[int, str], int] = {}
        for e in range(1, n):
            groups[(self.parent[e], self.tag[e])] = groups.get((self.parent[e], self.tag[e]), 0) + 1
        for e in range(1, n):
            like[e] = groups[(self.parent[e], self.tag[e])]
        tag = lambda names: np.array([g in names for g in self.tag], float)
        return np.stack([
            depth, np.log1p(chars), np.log1p(elements), chars / elements, linked / np.maximum(chars, 1), np.log1p(blocks), sentences / np.maximum(blocks, 1), chars / np.maximum(blocks, 1),
            np.log1p(controls), np.log1p(p_in), place, children[up], chars / np.maximum(chars[up], 1), before / max(1.0, own[:, 0].sum()), like,
            good, bad, landmark, np.minimum(over_good, 3), np.minimum(over_bad, 3), np.minimum(over_landmark, 3),
            tag(HEADINGS), tag({"p"}), tag({"li", "ul", "ol"}), tag({"article", "main"}), tag({"html", "body", "#root", "head"}), tag({"head"}),
        ], axis=1)

    def kept(self, odds: np.ndarray) -> np.ndarray:
        """The best set of kept elements; an element can be kept only if its parent is."""
        n = len(self.tag)
        gain = odds.astype(float)
        gain[0] = 0
        for e in range(n - 1, 0, -1):
            if gain[e] > 0:
                gain[self.parent[e]] += gain[e]
        keep = np.zeros(n, bool)
        keep[0] = True
        for e in range(1, n):
            keep[e] = keep[self.parent[e]] and gain[e] > 0
        return keep

    def decode(self, odds: np.ndarray) -> str:
        """The text of the kept elements."""
        keep = self.kept(np.clip(odds, -4, 4))
        return "\n".join(t for e, t in self.blocks if keep[e])

    def truth(self) -> np.ndarray:
        """Whether an element's subtree holds main text, by semantic tags: within article or main, outside what serves otherwise."""
        n = len(self.tag)
        inside, out = np.zeros(n, bool), np.zeros(n, bool)
        for e in range(1, n):
            p = self.parent[e]
            inside[e] = inside[p] or self.tag[e] in ("article", "main")
            out[e] = out[p] or self.tag[e] in LANDMARKS or (bool(self.tokens[e] & BAD) and self.tag[e] not in ("article", "main"))
        holds = np.zeros(n, bool)
        for e, _ in self.blocks:
            holds[e] |= inside[e] and not out[e]
        for e in range(n - 1, 0, -1):
            holds[self.parent[e]] |= holds[e]
        return holds


class Boosted:
    """Gradient-boosted regression trees on the logistic loss, over binned features."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T)], axis=1)
        rate = y.mean()
        self.start = float(np.log((rate + 1e-3) / (1 - rate + 1e-3)))
        odds, self.trees = np.full(len(y), self.start), []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-odds))
            tree, step = self.tree(binned, y - p, p * (1 - p))
            odds += step
            self.trees.append(tree)
        return self

    def tree(self, x: np.ndarray, g: np.ndarray, h: np.ndarray):
        """A complete tree: for each level and node a feature and the bin up to which rows go left; values of the leaves."""
        node = np.zeros(len(x), np.int64)
        feature, cut = np.zeros((DEPTH, 1 << DEPTH), np.int64), np.full((DEPTH, 1 << DEPTH), 1 << 30)
        width = BINS + 1
        for level in range(DEPTH):
            best = np.full(1 << level, 1e-6)
            for f in range(x.shape[1]):
                key = node * width + x[:, f]
                size = (1 << level) * width
                gs, hs, ns = (np.bincount(key, w, size).reshape(-1, width).cumsum(axis=1) for w in (g, h, np.ones(len(g))))
                gl, hl, nl = gs[:, :-1], hs[:, :-1], ns[:, :-1]
                gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain[(nl < LEAST) | (nt - nl < LEAST)] = -1
                at = gain.argmax(axis=1)
                top = gain[np.arange(len(at)), at]
                better = top > best
                best[better], feature[level, : len(at)][better], cut[level, : len(at)][better] = top[better], f, at[better]
            node = node * 2 + (x[np.arange(len(x)), feature[level, node]] > cut[level, node])
        values = RATE * np.bincount(node, g, 1 << DEPTH) / (np.bincount(node, h, 1 << DEPTH) + 1)
        return (feature, cut, values), values[node]

    def odds(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T)], axis=1)
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, values in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(DEPTH):
                node = node * 2 + (binned[rows, feature[level, node]] > cut[level, node])
            total += values[node]
        return total


def relaid(main: list[str], rest: list[str], pick: random.Random) -> tuple[str, set[str]]:
    """The same texts in another layout, and which of its texts are the main ones."""
    esc = lambda t: html.escape(t, quote=False)
    words = [w for t in rest for w in t.split()] or ["more"]
    some = lambda: " ".join(pick.choice(words) for _ in range(pick.randint(2, 14)))
    links = lambda n: "".join(f'<li><a href="#">{esc(pick.choice(words))}</a></li>' for _ in range(n))
    box = lambda names: pick.choice(["div", "section", "aside"]) + ' ' + pick.choice(["class", "id"]) + f'="{pick.choice(names)}"'

    def wrap(opening: str, inner: str) -> str:
        return f"<{opening}>{inner}</{opening.split()[0]}>"

    def extra() -> str:
        kind = pick.randrange(8)
        if kind == 0:
            return wrap(box(["ad", "ads", "advert", "sponsored", "promo-box"]), esc(some()) if pick.random() < 0.5 else f"<p>{esc(some())}</p>")
        if kind == 1:
            return wrap(box(["sidebar", "widget", "related-posts", "social-share"]), f"<h3>{esc(some())}</h3><ul>{links(pick.randint(2, 6))}</ul>")
        if kind == 2:
            return wrap(box(["cookie-notice", "alert", "notice", "site-banner"]), f"<p>{esc(some())}.</p>")
        if kind == 3:
            return wrap(pick.choice(["form", 'form class="newsletter"', 'div class="login-form"']), f"<label>{esc(some())}</label><input type=text><button>{esc(some())}</button>")
        if kind == 4:
            inner = "".join(wrap('div class="comment"' if pick.random() < 0.7 else "li", f"<p>{esc(pick.choice(main) if pick.random() < 0.3 else some() + '.')}</p>") for _ in range(pick.randint(1, 5)))
            return wrap(pick.choice(['section class="comments"', 'div id="comments"', 'ol class="comment-list"', 'div class="reader-comments"']), inner)
        if kind == 5:
            return wrap(pick.choice(["nav", 'div class="menu"', 'ul class="navigation"', 'div class="breadcrumbs"']), f"<ul>{links(pick.randint(3, 9))}</ul>")
        if kind == 6:
            return wrap("aside", f"<h4>{esc(some())}</h4><p>{esc(some())}.</p>")
        return wrap(box(["share", "tags", "author-meta", "subscribe"]), f"<p>{esc(some())}</p>")

    body = [f"<h1>{esc(main[0])}</h1>"]
    for t in main[1:]:
        body.append(f"<p>{esc(t)}</p>" if pick.random() < 0.8 else f"<h2>{esc(t)}</h2>" if len(t) < 60 else f"<blockquote>{esc(t)}</blockquote>")
        if pick.random() < 0.1:
            body.append(extra())
    container = pick.choice(["article", "main", 'div class="content"', 'div id="main-content"', 'section class="post-body"', 'div class="entry"', 'div class="article-text"', "div"])
    parts = [extra() for _ in range(pick.randint(1, 4))] + [wrap(container, "".join(body))] + [extra() for _ in range(pick.randint(1, 4))]
    top = wrap(pick.choice(["header", 'div class="site-header"']), f"<div>{esc(some())}</div>")
    bottom = wrap(pick.choice(["footer", 'div class="footer"']), f"&copy; {esc(some())}")
    return f"<html><head><title>{esc(main[0])}</title></head><body>{top}{''.join(parts)}{bottom}</body></html>", container


def paragraphs(page: Page) -> np.ndarray:
    """Whether each block looks like running text: where no tags tell, such blocks of a page serve as its main text."""
    return np.array([len(t) >= 40 and t[-1] in ".!?…\"”»" or page.tag[e] in ("p", "h1") and not any(page.tokens[e] & BAD) for e, t in page.blocks], bool)


def examples(sources: list[str], tagged: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features and answers of pages, and of their texts in three other layouts each."""
    for number, source in enumerate(sources):
        page = Page(source)
        if tagged:
            holds = page.truth()
            yield page.features(), holds
            leaf = [(t, bool(holds[e])) for e, t in page.blocks]
        else:
            leaf = [(t, h) for (_, t), h in zip(page.blocks, paragraphs(page).tolist())]
        main = [t for t, h in leaf if h]
        for k in range(3) if main else ():
            pick = random.Random(number * 3 + k)
            source, _ = relaid(main[: pick.randint(2, 12)], [t for t, h in leaf if not h], pick)
            again = Page(source)
            yield again.features(), relaid_truth(again)


def relaid_truth(again: Page) -> np.ndarray:
    """Whether an element of a page by ``relaid`` holds main text: the container's subtree does; what was put into it as an extra
    bears a bad token or a landmark tag."""
    at = max((e for e in range(len(again.tag)) if again.tag[e] == "h1"), default=0)
    inside, out, right = (np.zeros(len(again.tag), bool) for _ in range(3))
    for e in range(1, len(again.tag)):
        p = again.parent[e]
        inside[e] = inside[p] or e == again.parent[at]
        out[e] = out[p] or again.tag[e] in LANDMARKS or (inside[p] and bool(again.tokens[e] & BAD))
    for e, _ in again.blocks:
        right[e] |= inside[e] and not out[e]
    for e in range(len(right) - 1, 0, -1):
        right[again.parent[e]] |= right[e]
    return right


PLAIN = "<h1>A title</h1><p>The first sentence of a text.</p><p>A second one follows, and it is somewhat longer than the first.</p><li>Home</li><li>About us</li><li>More</li>"


def train(pages: DataFrame) -> Boosted:
    """Trees from the SAMPLE pages of smallest hash whose tags tell the main text; only these come to the driver. Where under
    FEW pages have such tags, others join them by their running text in other layouts; where nothing has text, a plain
    page does."""
    whole = pages.filter(F.length("html").between(1, 200_000))
    tagged = F.lower("html").rlike("<(article|main)[ >]")
    found = list(examples(smallest_hashes(whole.filter(tagged), ["page_id", "html"], SAMPLE, "html"), True))
    if len(found) < 4 * FEW:
        found += examples(smallest_hashes(whole.filter(~tagged), ["page_id", "html"], SAMPLE, "html"), False)
    if len(found) < 4 * FEW:
        found += examples([PLAIN] * FEW, False)
    return Boosted().fit(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]).astype(float))


def main_texts(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages(page_id, url, html)``.

    ``text`` is the main text of the whole html: kept blocks in page order, joined by a newline, character references
    decoded, white space in a block turned into single spaces. Null and empty html gives an empty text, as does a page
    without main text. The trees are trained on a bounded sample of the table (see ``train``). Very long pages, with
    any number of unclosed elements, take time linear in their length. Repeated rows get equal results; other columns,
    whatever their names, are ignored; an empty table gives an empty result.
    """
    trees = train(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                read = [Page(s or "") for s in part.column(2).to_pylist()]
                sizes = np.cumsum([0] + [len(p.tag) for p in read])
                odds = trees.odds(np.concatenate([p.features() for p in read]))
                texts = [p.decode(odds[a:b]) for p, a, b in zip(read, sizes[:-1], sizes[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_boosted_html_text(spark, sf_dir):
    """The main text of every page."""
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))

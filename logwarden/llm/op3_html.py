"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks in page order. Each block has a vector of its tag path (hashed names of the open elements, and of
the words of their class, id and role), of its words (hashed), and of its length, links and signs. A bidirectional LSTM
reads the whole page and says of each block whether it belongs to the article. Of a long page the vectors of ``WINDOW`` blocks are held at a
time; the states of both directions go on from piece to piece, so each block is seen in the context of the whole page at any length.

The network is trained in numpy on pages written from templates (whose blocks are known) filled with words of a bounded sample of the
given pages, and on that sample itself, labelled by the meaning of its elements where that is plain (``plain_label``).

Cases: null or empty html gives an empty text, and so does a page without a block of the article; broken markup is read as far as it
goes (a ``<`` that starts no tag is text; open elements end with the page); pages of any length are read whole; equal rows are read each
on their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html as html_lib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.llm.common import map_batches, ship, table
from logwarden.llm.lstm import BiLSTM
from logwarden.llm.text import text_of

SAMPLE = 300
SAMPLE_CHARS = 40_000
MADE_PAGES = 500
HIDDEN = 16
PATH_DIMENSIONS = 160
WORD_DIMENSIONS = 24
#: Blocks of a page held as vectors at once; the states of the network are carried over a longer page from piece to piece.
WINDOW = 256
#: Long pages read side by side.
ABREAST = 64

# ---- cutting a page into blocks

#: Elements that end a block of text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html"
    " iframe label legend li link main menu meta nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul video".split()
)
_EMPTY_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose content is no text.
_DROPPED = "script|style|noscript|template|textarea|svg|math|object|canvas"
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
_SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(" + _DROPPED + r")\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*+>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>"
    r"|<[!?/][^>]*+>",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Block:
    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: tuple[str, ...], linked: int):
        self.text, self.path, self.linked = text, path, linked


def _decode(raw: str) -> str:
    if "&" in raw:
        raw = raw.replace("&amp;", "&") if raw.count("&amp;") == raw.count("&") else html_lib.unescape(raw)
    return " ".join(raw.split())


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return (tag,)
    words = [w.lower() for m in _NAMED.finditer(attributes) for w in _NAME_WORD.findall(m[1] or m[2] or m[3] or "")]
    return (tag, *["." + w for w in words])


def cut_blocks(page: str) -> list[Block]:
    """Leaf blocks with text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    inline: list[tuple[str, tuple[str, ...]]] = []
    held: dict[str, int] = {}  # names of all open elements, so that a block costs the different ones and not the depth
    opened: dict[str, int] = {}  # block elements on the stack, by tag
    parts: list[str] = []
    linked = in_link = at = 0

    def hold(names: tuple[str, ...]) -> None:
        for name in names:
            held[name] = held.get(name, 0) + 1

    def release(names: tuple[str, ...]) -> None:
        for name in names:
            if held[name] == 1:
                del held[name]
            else:
                held[name] -= 1

    def cut(i: int) -> None:
        for tag, own in stack[i:]:
            opened[tag] -= 1
            release(own)
        del stack[i:]

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _decode("".join(parts))
            parts.clear()
            if text:
                out.append(Block(text, tuple(held), linked))
        linked = 0

    def close(tags: set[str] | frozenset[str], stop: set[str]) -> None:
        if not any(map(opened.get, tags)):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in stop:
                return
            if stack[i][0] in tags:
                cut(i)
                return

    for m in _MARKUP.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if in_link:
                linked += len(piece)
        at = m.end()
        tag = m[3] or m[6]
        if not tag:
            continue
        tag, ending, attributes = tag.lower(), m[2] or m[5], m[4] or m[7] or ""
        if tag not in BLOCK_TAGS:
            if tag == "a":
                in_link = 0 if ending else 1
            if ending:
                for i in range(len(inline) - 1, -1, -1):
                    if inline[i][0] == tag:
                        release(inline.pop(i)[1][1:])
                        break
            elif "=" in attributes and len(own := _names(tag, attributes)) > 1 and not attributes.endswith("/"):
                inline.append((tag, own))
                hold(own[1:])
            continue
        flush()
        if ending:
            if tag == "p" or tag not in _EMPTY_TAGS:
                close({tag}, set())
                if tag not in ("p", "br"):
                    for _, own in inline:
                        release(own[1:])
                    inline.clear()
            continue
        if tag in _ENDS_P:
            close({"p"}, {"table", "td", "th", "button", "dialog"})
        if tag in _SAME:
            close(*_SAME[tag])
        if tag not in _EMPTY_TAGS:
            own = _names(tag, attributes)
            stack.append((tag, own))
            opened[tag] = opened.get(tag, 0) + 1
            hold(own)
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


# ---- vectors


_slots: dict[str, tuple[int, int]] = {}


def _slot(name: str) -> tuple[int, int]:
    got = _slots.get(name)
    if got is None:
        if len(_slots) > 100_000:
            _slots.clear()
        h = zlib.crc32(name.encode("utf-8", "surrogatepass"))
        got = _slots[name] = (h % PATH_DIMENSIONS, (h >> 12) % PATH_DIMENSIONS)
    return got


FEATURES = PATH_DIMENSIONS + WORD_DIMENSIONS + 7


def block_vectors(blocks: list[Block]) -> np.ndarray:
    out = np.zeros((len(blocks), FEATURES), np.float32)
    for i, b in enumerate(blocks):
        for name in b.path:
            j, k = _slot(name)
            out[i, j] += 1
            out[i, k] += 0.5
        words = b.text.split(" ")
        share = 1 / len(words) ** 0.5
        for w in words:
            out[i, PATH_DIMENSIONS + len(w) * 7 % WORD_DIMENSIONS if len(w) > 12 else PATH_DIMENSIONS + (ord(w[0]) * 31 + ord(w[-1]) * 7 + len(w)) % WORD_DIMENSIONS] += share
        size = len(b.text)
        out[i, -7:] = (np.log1p(size) / 5, np.log1p(len(words)) / 4, min(b.linked / size, 1.0), b.text[-1] in ".!?:;", b.text[-1] in ",|", "|" in b.text or "©" in b.text or "»" in b.text, len(b.path) / 8)
    return out


class Labeller:
    def __init__(self, net: BiLSTM):
        self.net = net

    def article(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page which blocks are part of the article."""
        out = [np.zeros(len(p), bool) for p in pages]
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        short = [i for i in order if len(pages[i]) <= WINDOW]
        for lo in range(0, len(short), 256):
            part = short[lo : lo + 256]
            lengths = np.array([len(pages[i]) for i in part])
            x = np.zeros((int(lengths[-1]), FEATURES, len(part)), np.float32)
            for j, i in enumerate(part):
                x[: lengths[j], :, j] = block_vectors(pages[i])
            s = self.net.scores(x, lengths)
            good = s[:, 1] > s[:, 0]
            for j, i in enumerate(part):
                out[i][:] = good[: lengths[j], j]
        long = order[len(short) :]
        for lo in range(0, len(long), ABREAST):
            part = [pages[i] for i in long[lo : lo + ABREAST]]
            scores = self.net.long_scores(lambda j, a, b: block_vectors(part[j][a:b]), [len(p) for p in part], WINDOW)  # noqa: B023 (used at once)
            for i, s in zip(long[lo:], scores):
                out[i][:] = s[:, 1] > s[:, 0]
        return out

    def main_text(self, htmls: list[str]) -> list[str]:
        pages = [cut_blocks(h) for h in htmls]
        return ["\n".join([b.text for b, keep in zip(p, kept) if keep]) for p, kept in zip(pages, self.article(pages))]


# ---- training

#: What the names of elements, classes and ids say plainly.
ASIDE_NAMES = frozenset(
    "nav aside footer form button select label title head dialog menu iframe .nav .navbar .navigation .menu .menubar .breadcrumb .breadcrumbs .topbar .header .masthead .footer .foot .sidebar .side .aside .widget .ad .ads .advert .adverts"
    " .advertisement .adbox .sponsor .sponsored .promo .promoted .cookie .cookies .consent .gdpr .notice .alert .banner .popup .modal .overlay .toast .comment .comments .reply .replies .respond .disqus .discussion .form .search .subscribe"
    " .newsletter .signup .login .share .sharing .social .follow .related .recommended .more .tags .pagination .pager .copyright .legal .skip".split()
)
ARTICLE_NAMES = frozenset("article main .article .post .entry .story .content .body .main .text .prose".split())


def plain_label(path: tuple[str, ...]) -> int | None:
    """1: part of the article, 0: not, None: the names do not say."""
    names = set(path)
    if names & ASIDE_NAMES or "header" in names and not names & {"article"}:
        return 0
    return 1 if names & ARTICLE_NAMES else None


def made_page(rng: random.Random, words: list[str]) -> tuple[str, list[int]]:
    """A page from a random template, and the label of each of its blocks."""
    some = lambda lo, hi: " ".join(rng.choice(words) for _ in range(rng.randint(lo, hi)))
    pick = rng.choice
    labels: list[int] = []
    parts: list[str] = []

    def add(text: str, label: int) -> str:
        labels.append(label)
        return html_lib.escape(text, quote=False)

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{k}">{add(some(1, 3), 0)}</a></li>' for k in range(n))

    def box(names: list[str], lo: int = 3, hi: int = 14, tags: tuple[str, ...] = ("div", "section", "aside", "p")) -> str:
        tag, name = pick(tags), pick(names)
        inner = f"<p>{add(some(lo, hi), 0)}</p>" if tag != "p" and rng.random() < 0.5 else add(some(lo, hi), 0)
        more = f"<p>{add(some(lo, hi), 0)}</p>" if tag != "p" and rng.random() < 0.3 else ""
        return f'<{tag} {pick(["class", "id", "class"])}="{name}">{inner}{more}</{tag}>'

    adverts = ["ad", "ads", "advert", "ad-box", "advertisement", "sponsored", "promo", "ad banner", "google-ads", "promoted"]
    notices = ["cookie", "cookie-notice", "notice", "banner", "consent", "alert", "popup", "gdpr-banner", "notice-bar"]
    related = ["related", "share", "social-share", "newsletter", "subscribe", "tags", "recommended", "pagination", "more-links", "widget"]

    def form() -> str:
        return f'<form action="/s"><label>{add(some(1, 3), 0)}</label><input name="q"><button>{add(some(1, 2), 0)}</button></form>'

    def comments() -> str:
        name = pick(["comments", "comment-list", "user-comments", "discussion", "replies"])
        wrap = pick([('<div class="comment"><p>', "</p></div>"), ("<p>", "</p>"), ("<li>", "</li>")])
        rows = "".join(wrap[0] + add(some(3, 40), 0) + wrap[1] for _ in range(rng.randint(1, 5)))
        return f'<{(t := pick(["section", "div", "ol"]))} {pick(["class", "id"])}="{name}">' + rows + f"</{t}>"

    def side() -> str:
        tag = pick(["aside", "div"])
        head = f' class="{pick(["sidebar", "side", "widget-area"])}"' if tag == "div" or rng.random() < 0.5 else ""
        inner = f"<h3>{add(some(1, 3), 0)}</h3>"
        inner += f"<ul>{links(rng.randint(1, 5))}</ul>" if rng.random() < 0.6 else f"<p>{add(some(3, 30), 0)}</p>"
        return f"<{tag}{head}>{inner}</{tag}>"

    def header() -> str:
        tag = pick(["header", "div", "header"])
        return f"<{tag}" + (' class="header"' if tag == "div" else "") + f">{pick(['<h1>', '<p>', '<div>'])}{add(some(1, 5), 0)}</{tag}>"

    def nav() -> str:
        return pick([lambda: f"<nav><ul>{links(rng.randint(2, 8))}</ul></nav>", lambda: f'<div class="{pick(["menu", "nav", "navbar", "breadcrumbs"])}"><ul>{links(rng.randint(1, 7))}</ul></div>', lambda: f"<nav>{add(some(2, 6), 0)}</nav>"])()

    def body() -> str:
        wrap = pick([("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="main">', "</div>"), ('<div class="post-body">', "</div>")])
        out = [wrap[0]]
        if rng.random() < 0.8:
            level = pick(["h1", "h1", "h2"])
            out.append(f"<{level}>{add(some(1, 9), 1)}</{level}>")
        for _ in range(rng.randint(1, 14)):
            roll = rng.random()
            if roll < 0.55:
                out.append(f"<p>{add(some(1, 60), 1)}</p>")
            elif roll < 0.7:
                out.append(f"<p><b>{add(some(1, 30), 1)}<br><p>{add(some(1, 30), 1)}</p>")
            elif roll < 0.78:
                out.append("<ul>" + "".join(f"<li>{add(some(1, 15), 1)}</li>" for _ in range(rng.randint(1, 4))) + "</ul>")
            elif roll < 0.84:
                out.append(f"<h2>{add(some(1, 6), 1)}</h2>")
            elif roll < 0.88:
                out.append(f"<blockquote>{add(some(3, 30), 1)}</blockquote>")
            elif roll < 0.92:
                out.append(box(adverts))
            elif roll < 0.95:
                out.append(box(related))
            else:
                out.append(f"<div>{add(some(2, 40), 1)}</div>")
        return "".join(out) + wrap[1] * (rng.random() < 0.95)

    if rng.random() < 0.9:
        parts.append(f"<head><title>{add(some(1, 10), 0)}</title></head>")
    parts.append("<body>")
    before = [nav, header, lambda: box(notices), lambda: box(adverts), form, side]
    after = [lambda: f"<footer>{add('© ' + some(2, 20), 0)}</footer>", lambda: f'<div class="footer">{add(some(2, 20), 0)}</div>', comments, side, lambda: box(adverts), lambda: box(related), form, lambda: box(notices)]
    for _ in range(rng.randint(0, 4)):
        parts.append(pick(before)())
    parts.append(body())
    for _ in range(rng.randint(0, 4)):
        parts.append(pick(after)())
    parts.append("</body>")
    return "".join(parts), labels


def train(pages: list[str], made: int = MADE_PAGES, epochs: int = 10) -> Labeller | None:
    """Labeller from sampled pages and made ones."""
    if not pages:
        return None
    rng = random.Random(23)
    cut = [cut_blocks(p) for p in pages]
    words = [w for blocks in cut for b in blocks for w in b.text.split()[:40]] or ["a"]
    examples: list[tuple[np.ndarray, np.ndarray]] = []
    for blocks in cut:
        labels = [plain_label(b.path) for b in blocks]
        if blocks and None not in labels:
            examples.append((block_vectors(blocks), np.array(labels)))
    for _ in range(made):
        page, labels = made_page(rng, words)
        blocks = cut_blocks(page)
        if len(blocks) == len(labels):
            examples.append((block_vectors(blocks), np.array(labels)))
    examples.sort(key=lambda e: len(e[1]))
    batches = []
    for lo in range(0, len(examples), 32):
        part = examples[lo : lo + 32]
        lengths = np.array([len(y) for _, y in part])
        x, y = np.zeros((int(lengths[-1]), FEATURES, len(part)), np.float32), np.zeros((int(lengths[-1]), len(part)), np.int64)
        for j, (a, b) in enumerate(part):
            x[: len(b), :, j], y[: len(b), j] = a, b
        batches.append((x, y, lengths))
    net = BiLSTM(FEATURES, HIDDEN, 2)
    net.fit(batches, epochs, 0.02)
    return Labeller(net)


def fit_labeller(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> Labeller | None:
    """Labeller trained with at most ``sample`` pages, of each its first ``SAMPLE_CHARS`` code points: those of smallest id hash, or of smallest text hash where no page has an id.

    None only if no page has html."""
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.left(F.col(html_col).cast("string"), F.lit(SAMPLE_CHARS)).alias("html")).where("html is not null")
    ids = rows.where("html <> '' and page_id is not null").select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    got = rows.join(F.broadcast(ids), "page_id").select("html").orderBy("html").toArrow()
    if not got.num_rows:
        got = rows.where("html <> ''").orderBy(F.xxhash64("html"), "html").limit(sample).select("html").toArrow()
    return train(got.column("html").to_pylist())


def extract_main_text(pages: DataFrame, labeller: Labeller | None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    ship(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(labeller)

    def extract(batch: pa.RecordBatch) -> dict:
        htmls = text_of(batch.column(2))
        model = shared.value
        texts: list[str] = []
        for lo in range(0, len(htmls), 500):
            texts += model.main_text(htmls[lo : lo + 500]) if model else [""] * len(htmls[lo : lo + 500])
        return {"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return map_batches(rows, extract, "page_id long, url string, text string, n_chars long")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return extract_main_text(pages, fit_labeller(pages))

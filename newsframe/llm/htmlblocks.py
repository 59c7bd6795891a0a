"""HTML extraction: a bidirectional LSTM labels every text block of a page as main text or not."""

import re
from html import unescape
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from newsframe.llm.common import bounded_sample
from newsframe.llm.textbytes import LOWER, span_hashes, text_bytes, word_spans

RAW = "script|style|textarea"  # what holds characters, not tags; all others are containers
TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>])(?:[^<>"']++|"[^"]*"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"""
    r"""|<(/?)([a-z][a-z0-9:-]*)((?:[^<>"']++|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*>""", re.DOTALL | re.IGNORECASE)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
NAME = re.compile(r"[a-z]+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}}
PATH, WORDS, OTHER = 128, 16, 6
WIDTH = PATH + WORDS + OTHER
#: What the sample's own blocks are labelled by, from the names on their tag path.
MAIN_NAMES = frozenset(("article", "main"))
SIDE_NAMES = frozenset("nav header footer aside form head title button menu ad ads advert advertisement comment comments sidebar notice "
                       "cookie banner related share promo newsletter breadcrumb".split())
SAMPLE_PAGES = 600


def page_blocks(html: str) -> list[tuple[tuple[str, ...], str, float]]:
    """(names on the tag path, text, share of its characters in links) of every block with text, in page order.

    A block is the text between two block-level tags; inline tags do not cut it, a line break is a space. Scripts,
    styles and the like and comments hold no text. End tags without a start are ignored and unclosed ones close with
    their parent; a ``<`` that begins no tag is text.
    """
    found, stack, pieces, links, anchors = [], [], [], 0, 0

    def close():
        nonlocal links
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                names = tuple(dict.fromkeys(name for _, own in stack for name in own))
                found.append((names, text, min(1.0, links / len(text))))
            pieces.clear()
        links = 0

    def say(piece):
        nonlocal links
        if "&" in piece:
            piece = unescape(piece)
        pieces.append(piece)
        if anchors:
            links += len(piece)

    at = 0
    for match in TOKEN.finditer(html):
        if match.start() > at:
            say(html[at:match.start()])
        at = match.end()
        tag = match.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                anchors = max(0, anchors - 1) if match.group(2) else anchors + 1
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        close()
        anchors = 0
        if tag in VOID:
            continue
        if match.group(2):
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    del stack[depth:]
                    break
            continue
        over = CLOSES.get(tag)
        if stack and (stack[-1][0] == "p" or over and stack[-1][0] in over):
            stack.pop()
        attributes = match.group(4)
        own = [tag]
        if "=" in attributes:
            own += [f".{name}" for values in NAMES.findall(attributes) for name in NAME.findall("".join(values).lower())]
        if not attributes.rstrip().endswith("/"):
            stack.append((tag, own))
    if at < len(html):
        say(html[at:])
    close()
    return found


_slots: dict[str, tuple[int, float]] = {}


def _slot(name: str) -> tuple[int, float]:
    """Place and sign of a path name in the hashed path vector."""
    if name not in _slots:
        if len(_slots) > 100_000:
            _slots.clear()
        number = crc32(name.encode())
        _slots[name] = (number % PATH, 1.0 if number & 0x10000 else -1.0)
    return _slots[name]


def block_features(pages: list[list[tuple]]) -> np.ndarray:
    """One row per block: hashed tag path, hashed words, and length, links, marks, depth and place on the page."""
    flat = [block for page in pages for block in page]
    rows = np.zeros((len(flat), WIDTH), np.float32)
    if not flat:
        return rows
    known: dict[tuple, np.ndarray] = {}
    for at, (names, _, links) in enumerate(flat):
        if names not in known:
            path = np.zeros(PATH, np.float32)
            for name in names:
                place, sign = _slot(name.lstrip("."))
                path[place] += sign
                place, sign = _slot(f"{name.lstrip('.')} again")
                path[place] += sign
            known[names] = path
        rows[at, :PATH] = known[names]
        rows[at, PATH + WORDS + 1] = links
        rows[at, PATH + WORDS + 2] = len(names) / 8
    buffer, offsets = text_bytes(pa.array([block[1] for block in flat], pa.string()))
    base, lowered = offsets[0], LOWER[buffer[offsets[0]:offsets[-1]]]
    starts, ends, running = word_spans(lowered, offsets - base)
    counts = np.diff(running)
    owner = np.repeat(np.arange(len(flat)), counts)
    slot = (span_hashes(lowered, starts, ends) % np.uint64(WORDS)).astype(np.int64)
    rows[:, PATH:PATH + WORDS] = np.bincount(owner * WORDS + slot, minlength=len(flat) * WORDS).reshape(-1, WORDS) / np.maximum(counts, 1)[:, None]
    marks = np.concatenate(([0], np.cumsum(np.isin(lowered, np.frombuffer(b".,;:!?", np.uint8)))))
    rows[:, PATH + WORDS] = np.log1p(counts) / 4
    rows[:, PATH + WORDS + 3] = np.minimum(1, (marks[offsets[1:] - base] - marks[offsets[:-1] - base]) / np.maximum(counts, 1))
    place = np.concatenate([(np.arange(len(page)) + 0.5) / len(page) for page in pages if page])
    rows[:, PATH + WORDS + 4], rows[:, PATH + WORDS + 5] = place, 1
    return rows


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BlockLabeller:
    """A bidirectional LSTM over the blocks of a page, with one sigmoid per block."""

    def __init__(self, hidden: int = 16, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.hidden, self.p = hidden, {}
        for way in "fb":
            self.p[f"x{way}"] = rng.standard_normal((WIDTH, 4 * hidden)) / np.sqrt(WIDTH)
            self.p[f"h{way}"] = rng.standard_normal((hidden, 4 * hidden)) / np.sqrt(hidden)
            self.p[f"b{way}"] = np.concatenate((np.ones(hidden), np.zeros(3 * hidden)))
        self.p["o"] = rng.standard_normal(2 * hidden) / np.sqrt(2 * hidden)
        self.p["c"] = np.zeros(1)

    def _run(self, way: str, x: np.ndarray, live: np.ndarray):
        """States for every step; a step beyond a page's end leaves its state as it is."""
        steps, pages, size = x.shape[0], x.shape[1], self.hidden
        drive = x @ self.p[f"x{way}"] + self.p[f"b{way}"]
        h, c = np.zeros((pages, size)), np.zeros((pages, size))
        kept = []
        for step in range(steps):
            gates = drive[step] + h @ self.p[f"h{way}"]
            f, i, o = (_sigmoid(gates[:, at * size:(at + 1) * size]) for at in range(3))
            g = np.tanh(gates[:, 3 * size:])
            new = f * c + i * g
            on = live[step][:, None]
            squashed = np.tanh(new)
            kept.append((h, c, f, i, o, g, squashed))
            h, c = np.where(on, o * squashed, h), np.where(on, new, c)
            kept[-1] += (h,)
        return kept

    def _logits(self, x: np.ndarray, live: np.ndarray):
        forward, backward = self._run("f", x, live), self._run("b", x[::-1], live[::-1])
        states = np.concatenate((np.stack([s[-1] for s in forward]), np.stack([s[-1] for s in backward])[::-1]), axis=2)
        return states @ self.p["o"] + self.p["c"], states, forward, backward

    @staticmethod
    def _padded(pages: list[np.ndarray]):
        steps = max(len(page) for page in pages)
        x, live = np.zeros((steps, len(pages), WIDTH)), np.zeros((steps, len(pages)), bool)
        for at, page in enumerate(pages):
            x[:len(page), at], live[:len(page), at] = page, True
        return x, live

    def label(self, pages: list[np.ndarray], cells: int = 20_000) -> list[np.ndarray]:
        """For every page the probabilities of its blocks; pages of like length share a padded batch."""
        out: list = [np.zeros(0)] * len(pages)
        order = [at for at in sorted(range(len(pages)), key=lambda at: len(pages[at])) if len(pages[at])]
        while order:
            size = max(1, min(len(order), cells // len(pages[order[min(len(order), 64) - 1]])))
            batch, order = order[:size], order[size:]
            x, live = self._padded([pages[at] for at in batch])
            scores = _sigmoid(self._logits(x, live)[0])
            for column, at in enumerate(batch):
                out[at] = scores[:len(pages[at]), column]
        return out

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], steps: int = 420, batch: int = 32, rate: float = 0.02,
            seed: int = 13) -> "BlockLabeller":
        """Adam on the cross entropy of the block labels, through time in both directions."""
        rng, size = np.random.default_rng(seed), self.hidden
        first, second = ({name: np.zeros_like(value) for name, value in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            chosen = rng.integers(0, len(pages), batch)
            x, live = self._padded([pages[at] for at in chosen])
            goal = np.zeros(live.shape)
            for column, at in enumerate(chosen):
                goal[:len(labels[at]), column] = labels[at]
            logits, states, forward, backward = self._logits(x, live)
            error = (_sigmoid(logits) - goal) * live / live.sum()
            slopes = {"o": np.einsum("tp,tph->h", error, states), "c": error.sum(keepdims=True).reshape(1)}
            flow = error[:, :, None] * self.p["o"]
            for way, kept, xs, on, ds in (("f", forward, x, live, flow[:, :, :size]), ("b", backward, x[::-1], live[::-1], flow[::-1, :, size:])):
                dx, dh_w = np.zeros((len(xs), batch, 4 * size)), np.zeros((size, 4 * size))
                dh, dc = np.zeros((batch, size)), np.zeros((batch, size))
                for t in range(len(xs) - 1, -1, -1):
                    h, c, f, i, o, g, squashed, _ = kept[t]
                    mask = on[t][:, None]
                    dh = dh + ds[t]
                    dnew = (dh * o * (1 - squashed ** 2) + dc) * mask
                    gates = np.concatenate((dnew * c * f * (1 - f), dnew * g * i * (1 - i), dh * squashed * o * (1 - o) * mask,
                                            dnew * i * (1 - g ** 2)), axis=1)
                    dx[t] = gates
                    dh_w += h.T @ gates
                    dh = np.where(mask, gates @ self.p[f"h{way}"].T, dh)
                    dc = np.where(mask, dnew * f, dc)
                slopes[f"x{way}"] = np.einsum("tpd,tpg->dg", xs, dx, optimize=True)
                slopes[f"h{way}"], slopes[f"b{way}"] = dh_w, dx.sum((0, 1))
            pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for name, slope in slopes.items():
                first[name] = 0.9 * first[name] + 0.1 * slope
                second[name] = 0.999 * second[name] + 0.001 * slope ** 2
                self.p[name] = self.p[name] - pace * (first[name] / (1 - 0.9 ** step)) / (np.sqrt(second[name] / (1 - 0.999 ** step)) + 1e-8)
        return self


#: Names of containers for pages that the sample does not show: what holds the main text, and what does not.
MAIN_PATHS = ["article", "main", "main article", "main div.content", "div.article.body", "div.post.content", "section.entry.content",
              "div.story.text", "div.main.text", "article div.body", "article section", "div.content article", "", "", "div", "div.container",
              "div.wrapper div", "div.page", "section"]
SIDE_PATHS = ["nav ul li", "header", "header div.logo", "header nav ul li", "footer", "footer p", "footer div.copyright", "aside p", "aside ul li",
              "div.sidebar ul li", "div.side.bar p", "div.menu ul li", "div.nav li", "div.ad", "div.ads p", "div.advert p", "aside.advertisement p",
              "div.sponsored p", "div.promo p", "div.banner p", "div.cookie.notice p", "div.notice p", "div.alert p", "div.consent p",
              "section.notice p", "form p", "form label", "form.search", "form.newsletter div", "div.newsletter form", "div.subscribe form p",
              "button", "div.login form", "section.comments div.comment p", "div.comments p", "div.comment p", "ol.comments li p", "ul.comment.list li",
              "section.comments h2", "div.reply p", "div.discussion p", "div.related ul li", "section.related p", "div.share li", "div.social",
              "div.breadcrumb li", "div.tags li", "div.popup p", "div.widget p", "section.reader.comments article p", "head title", "div.byline",
              "p.disclaimer", "div.footer p", "div.header p", "div.top.bar"]


def _names(path: str, leaf: str = "") -> tuple[str, ...]:
    names = ["html", "body"]
    for step in [*path.split(), *leaf.split()]:
        tag, *own = step.split(".")
        names += [tag, *[f".{name}" for name in own]]
    return tuple(dict.fromkeys(names))


def composed_page(texts: list[str], rng: np.random.Generator):
    """A made-up page of blocks and labels: the sample's own texts under containers that it may not show."""
    pick = lambda: texts[rng.integers(len(texts))]
    short = lambda: " ".join(pick().split()[:1 + rng.integers(6)])
    blocks, labels = [], []

    def side(path, long):
        text = pick() if long else short()
        blocks.append((_names(path), text, float(rng.random() < 0.5) if not long else 0.0))
        labels.append(0)

    def some(most):
        for path in rng.choice(SIDE_PATHS, rng.integers(0, most + 1)):
            long = rng.random() < 0.5
            for _ in range(1 + rng.integers(5)):
                side(path, long)

    bare = rng.random() < 0.15
    some(0 if bare else 4)
    main = MAIN_PATHS[rng.integers(len(MAIN_PATHS))]
    for number in range(1 + rng.integers(12)):
        if number == 0 and rng.random() < 0.8:
            blocks.append((_names(main, "h1"), short(), 0.0))
            labels.append(1)
        leaf = ("p", "p", "p", "p", "h2", "ul li", "blockquote p", "div p", "", "table tr td", "pre")[rng.integers(11)]
        blocks.append((_names(main, leaf), pick() if rng.random() < 0.8 else short(), 0.0))
        labels.append(1)
        if rng.random() < 0.12:
            side(f"{main} {SIDE_PATHS[rng.integers(len(SIDE_PATHS))]}", rng.random() < 0.5)
    some(0 if bare else 5)
    return blocks, np.array(labels, np.float64)


def fit_labeller(pages: DataFrame, key: str = "page_id", html: str = "html", sample_pages: int = SAMPLE_PAGES, seed: int = 0) -> BlockLabeller:
    """A labeller from at most ``sample_pages`` pages, the least by a hash of the key, and as many composed ones.

    The sample has no given labels: blocks under ``article`` or ``main``, and not under a name that says otherwise,
    count as main text, and pages without such a name only lend their texts. An empty sample gives composed pages of
    a few plain words.
    """
    rows = bounded_sample(pages.filter(F.col(html).isNotNull()).select(F.col(key), F.col(html).alias("html")), F.col(key), sample_pages, seed).collect()
    rows.sort(key=lambda row: row["html"])
    parsed = [blocks for blocks in (page_blocks(row["html"]) for row in rows) if blocks]
    plain = lambda names: {name.lstrip(".") for name in names}
    shown = [page for page in parsed if any(plain(names) & MAIN_NAMES for names, _, _ in page)]
    labels = [np.array([float(bool(plain(names) & MAIN_NAMES) and not plain(names) & SIDE_NAMES) for names, _, _ in page]) for page in shown]
    texts = [text for page in parsed for _, text, _ in page] or ["one", "two words", "a few more words here"]
    rng = np.random.default_rng(17)
    for _ in range(max(900, len(shown))):
        page, marks = composed_page(texts, rng)
        shown.append(page)
        labels.append(marks)
    edges = np.cumsum([len(page) for page in shown])[:-1]
    return BlockLabeller().fit(np.split(block_features(shown).astype(np.float64), edges), labels)


def extract_main_text(pages: DataFrame, model: BlockLabeller, html: str = "html", text: str = "text", chars: str = "n_chars",
                      batch: int = 256) -> DataFrame:
    """Adds the main text and its number of code points; every block of the whole page is labelled.

    Blocks are joined in page order by one space. Null, empty and text-free pages have an empty text; repeated rows
    get equal texts; other columns pass through, and columns named like the results are replaced.
    """
    kept = [name for name in pages.columns if name not in (text, chars)]
    source = pages.select(*kept)
    at = kept.index(html)
    out = StructType([*source.schema.fields, StructField(text, StringType()), StructField(chars, LongType())])
    names = out.names

    def extract(batches):
        for rows in batches:
            for first in range(0, rows.num_rows, batch):
                part = rows.slice(first, batch)
                parsed = [page_blocks(page or "") for page in part.column(at).to_pylist()]
                edges = np.cumsum([len(page) for page in parsed])[:-1]
                scores = model.label(np.split(block_features(parsed), edges))
                texts = [" ".join(block[1] for block, score in zip(page, row, strict=True) if score >= 0.5)
                         for page, row in zip(parsed, scores, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string()),
                                                  pa.array([len(one) for one in texts], pa.int64())], names)

    return source.mapInArrow(extract, out)

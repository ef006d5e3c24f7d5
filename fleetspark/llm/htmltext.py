"""Main text of web pages: a linear-chain CRF over the leaf blocks of the DOM.

A leaf block is a run of text between two block-level tags; white space in it is one
space. Its features are its ancestors' tags, the kinds of words in their class, id and
role (the nearest ones apart), and its own text: length, links, punctuation. The chain
scores a block's features and each change between article and boilerplate; Viterbi
decoding marks all blocks of a page at once.

Labelled pages: a bounded sample of the table's pages that mark their article themselves
(``article``, ``main``), each as it is and again with its texts dressed in another layout,
where the kind of every block is known. While such pages are few, plain filler sentences
are dressed too. Every page of the table is then marked over all its blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspark.llm.base import chunks

SAMPLE, SAMPLE_CHARS, FEWEST = 600, 20_000, 300
ROUNDS, RATE, DECAY = 200, 0.1, 2e-4

# Elements of HTML by the way they are read.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
HIDDEN = frozenset("head svg math template select datalist button canvas audio video object applet map".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}

#: Kinds of words in class, id and role attributes.
HINTS = {
    "content": "article content contents main post entry story body text prose",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc tabs pagination pager",
    "header": "header masthead topbar logo brand tagline",
    "footer": "footer foot copyright legal colophon contentinfo bottom",
    "side": "sidebar aside side widget rail related recommended popular trending complementary",
    "notice": "cookie cookies consent gdpr privacy notice alert popup modal overlay warning announcement banner",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted adsense",
    "form": "form search login signin signup subscribe subscription newsletter register poll",
    "comment": "comment comments commentlist reply replies respond responses discussion disqus feedback",
    "share": "share sharing social follow tweet",
    "byline": "byline meta author date tags",
}
KIND_OF = {word: kind for kind, words in HINTS.items() for word in words.split()}
MARKS = ("article", "main", "nav", "aside", "header", "footer", "form")
TAGS = (*MARKS, *"section div p ul ol li dl table td blockquote pre figure figcaption details dialog menu address fieldset h1 h2 h3 h4 h5 h6".split())
LEXICON = {"copyright": "© copyright rights reserved", "cookie": "cookie cookies consent privacy", "ask": "subscribe newsletter sign login email password search", "talk": "comment comments reply posted", "advert": "advertisement sponsored advert"}

FEATURES = {
    name: i
    for i, name in enumerate(
        [
            "bias", "first", "last", "sentence", "upper", "after_h1",
            *(f"in {t}" for t in TAGS), *(f"own {t}" for t in TAGS), *(f"mark {t}" for t in ("none", *MARKS)),
            *(f"hint {k}" for k in HINTS), *(f"near {k}" for k in ("none", *HINTS)),
            *(f"links {i}" for i in range(4)), *(f"words {i}" for i in range(6)), *(f"says {k}" for k in LEXICON),
        ]
    )
}
_SAYS = {word: FEATURES[f"says {k}"] for k, words in LEXICON.items() for word in words.split()}
_WORDS, _LINKS = (2, 5, 10, 20, 50), (0.05, 0.4, 0.8)

_TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)>|<[!?/][^>]*>|<[a-zA-Z/!?][^>]*\Z""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_LETTERS = re.compile("[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I) for name in RAW}


class Element:
    """An open block-level element: its tag and the features it hands to the text in it."""

    __slots__ = ("tag", "within", "mark", "near", "article_kinds")

    def __init__(self, tag: str, attributes: str, parent: "Element | None"):
        self.tag = tag
        within = parent.within if parent else frozenset()
        self.mark, self.near = (parent.mark, parent.near) if parent else ("none", "none")
        # Kinds named between the text and the nearest mark.
        self.article_kinds = parent.article_kinds if parent else frozenset()
        names = {f"in {tag}"}
        if tag in MARKS:
            self.mark, self.article_kinds = tag, frozenset()
        if "=" in attributes:
            kinds = []
            for found in _ATTRIBUTE.finditer(attributes):
                for word in _LETTERS.findall(found[1] or found[2] or found[3] or ""):
                    if word.lower() in KIND_OF:
                        kinds.append(KIND_OF[word.lower()])
            if kinds:
                odd = [k for k in kinds if k != "content"]
                self.near = (odd or kinds)[-1]
                self.article_kinds |= set(kinds)
                names.update(f"hint {k}" for k in kinds)
        new = {FEATURES[n] for n in names if n in FEATURES}
        self.within = within if new <= within else within | new


def leaf_blocks(html: str) -> list[tuple[str, Element, float]]:
    """(text, innermost block, share of letters in links) of every block with text, in order.

    Broken markup is read as browsers do in the main: a block closes an open paragraph,
    list items and cells close their likes, stray end tags count for nothing.
    """
    root = Element("body", "", None)
    stack, found = [root], []
    parts: list[str] = []
    linked = 0
    in_link = hidden = 0
    hidden_by = ""

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append((text, stack[-1], min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def close(tags: tuple[str, ...], stops: tuple[str, ...] = ()) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                del stack[k:]
                return
            if stack[k].tag in stops:
                return

    def take(piece: str) -> None:
        nonlocal linked
        if piece and not hidden:
            if "&" in piece:
                piece = unescape(piece)
            parts.append(piece)
            if in_link:
                linked += len(piece.strip())

    at, size = 0, len(html)
    while at < size:
        token = _TOKEN.search(html, at)
        if not token:
            take(html[at:])
            break
        take(html[at : token.start()])
        at = token.end()
        if token[0].startswith("<![CDATA["):
            continue
        slash, tag, rest = (token[1], token[2], token[3]) if token[2] else (token[4], token[5], token[6])
        if not tag:
            continue
        tag = tag.lower()
        if hidden:
            if tag == hidden_by:
                hidden += -1 if slash else not rest.endswith("/")
            elif hidden_by == "head" and tag in ("body", "article", "main", "div", "p", "h1"):
                hidden = 0
            if hidden or slash:
                if not slash and tag in RAW:
                    end = _RAW_END[tag].search(html, at)
                    at = end.end() if end else size
                continue
        if tag in RAW:
            if not slash:
                end = _RAW_END[tag].search(html, at)
                at = end.end() if end else size
        elif tag in HIDDEN:
            if not slash and not rest.endswith("/"):
                hidden, hidden_by = 1, tag
        elif tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = 0 if slash else 1
        elif tag in BLOCKS:
            flush()
            in_link = 0
            if slash:
                close((tag,))
                continue
            if tag in CLOSES:
                close(CLOSES[tag], STOPS[tag])
            if tag not in ("body", "html"):
                close(("p",), ("td", "th", "li", "dd", "blockquote", "article", "section", "main", "div"))
            if tag not in VOID:
                stack.append(Element(tag, rest, stack[-1]))
    flush()
    return found


def page_features(blocks: list[tuple[str, Element, float]]) -> list[list[int]]:
    """Numbers of the features that hold, for each block of a page."""
    rows, after = [], False
    for i, (text, element, linked) in enumerate(blocks):
        own = FEATURES.get(f"own {element.tag}")
        words = text.split(" ")
        row = [*element.within, FEATURES["bias"], FEATURES[f"mark {element.mark}"], FEATURES[f"near {element.near}"]]
        row.append(FEATURES[f"links {sum(linked > x for x in _LINKS)}"])
        row.append(FEATURES[f"words {sum(len(words) > x for x in _WORDS)}"])
        if own is not None:
            row.append(own)
        if i == 0:
            row.append(FEATURES["first"])
        if i == len(blocks) - 1:
            row.append(FEATURES["last"])
        if text[-1] in ".!?…\"”":
            row.append(FEATURES["sentence"])
        if text[0].isupper():
            row.append(FEATURES["upper"])
        if after:
            row.append(FEATURES["after_h1"])
        if len(words) <= 50:
            row.extend({_SAYS[w] for w in map(str.lower, words) if w in _SAYS})
        after = after or element.tag == "h1"
        rows.append(row)
    return rows


# Where texts of labelled pages stand: `tag.class#id` steps joined by blanks, then the kind of text and how many at most.
ARTICLES = (
    "article", "main article", "main", "article.post", "article div.text", "main div.body", "div#content", "div.article-body", "div.post div.entry",
    "section.content", "div.story", "div.text", "div.page div.main", "div.prose", "table tr td.content", "div#main div", "div", "body", "main section", "div.body section",
)
PARTS = ("p",) * 24 + ("ul li", "ul li", "ol li", "blockquote p", "blockquote", "h2", "h3", "pre", "table tr td", "div", "figure figcaption", "dl dd", "section p")
BEFORE = (
    "header.site-header div.logo|brand|1", "header h1|brand|1", "header p|brand|2", "header.masthead p|brand|1", "div#header div.title|brand|1", "div.topbar div|brand|1", "header nav ul li a|menu|5",
    "nav ul li a|menu|6", "nav a|menu|3", "nav.menu ul li a|menu|5", "div#nav ul li a|menu|5", "ul.navigation li a|menu|4", "div.main-menu a|menu|3", "div.breadcrumb ul li a|menu|3", "div ul li a|menu|5", "table tr td.menu a|menu|4",
    "div.cookie-notice p|notice|2", "div.cookie-banner|notice|1", "div.alert p|notice|1", "div#consent div p|notice|2", "div.modal p|notice|2", "p.notice|notice|1", "section.announcement p|notice|1", "div.overlay|notice|1",
    "div.ad|advert|1", "div.promo p|advert|1", "div.banner|advert|1", "div#ads p|advert|2", "div.search form p|form|1", "form.login label|form|2", "form label|form|2", "aside.sidebar ul li a|side|3", "div#sidebar div.widget p|side|2", "aside p|side|2",
)
WITHIN = (
    "div.ad|advert|1", "div.advertisement|advert|1", "div.sponsored p|advert|1", "aside p|side|2", "aside|side|1", "div.related ul li a|side|3", "div.share|share|1", "ul.social li a|share|2", "form p|form|1", "div.newsletter p|form|1",
    "div.newsletter form label|form|2", "nav ul li a|menu|3", "footer p|byline|1", "div.byline|byline|1", "section.comments article p|comment|2", "div.notice p|notice|1",
)
AFTER = (
    "div#comments ol.commentlist li p|comment|3", "section.comments div.comment p|comment|3", "section#comments article.comment p|comment|3", "div.discussion div.reply p|comment|2", "div.comments ul li|comment|3", "section.responses p|comment|2", "div.comments h3|talk|1",
    "section.comments h2|talk|1", "section#respond h3|talk|1", "section#respond form p|form|2", "div.newsletter form p|form|2", "form p|form|2", "aside.sidebar ul li a|side|4", "aside p|side|2", "aside h3|talk|1", "aside.related h4|side|2", "div#sidebar div.widget p|side|2",
    "section.related p a|side|3", "div.recommended ul li|side|3", "div.sponsored p|advert|1", "div.ads|advert|1", "div ul li a|side|4", "footer p|footer|2", "footer|footer|1", "footer.site-footer nav ul li a|menu|3", "footer ul li a|menu|3", "footer small|footer|1",
    "div#footer div|footer|1", "div.footer p|footer|1", "div.copyright|footer|1", "div.legal p|footer|1", "div|footer|1", "div.cookie-notice p|notice|1", "table tr td.footer|footer|1",
)

# Fixed filler words of kinds that a page itself need not hold.
_PHRASES = {
    "footer": ["© {w} {w}. All rights reserved.", "© {w} · {s}", "{w} · Imprint · Privacy · Contact"],
    "notice": ["We use cookies. {s}", "This site uses cookies to {w} your {w}. Accept", "{s}"],
    "form": ["Email {w}", "Subscribe to our newsletter: {s}", "Search {w}", "Your name", "{w}"],
    "advert": ["Advertisement", "Sponsored: {s}", "{s}", "{s}"],
    "comment": ["{s}", "{s} {s}", "{w} wrote: {s}"],
    "talk": ["Comments", "3 comments", "Leave a reply", "Related"],
    "byline": ["By {w} {w}", "Posted in {w}, {w}"],
    "share": ["Share {w}", "Tweet"],
    "brand": ["{w} {w}", "The {w} {w}", "{w}"],
}
_FILLER = "one of many plain words that stand here for a text in some language of the world and make up a line".split()


def own_labels(blocks: list[tuple[str, Element, float]]) -> list[int]:
    """Labels of a page that marks its article: inside it, and in nothing else named within."""
    odd = set(HINTS) - {"content", "byline"}
    return [int(e.mark in ("article", "main") and not odd & e.article_kinds) for _, e, _ in blocks]


def dressed(texts: dict[str, list[str]], seed: int) -> tuple[str, list[int]]:
    """A page of these texts in a layout that the seed picks, and the labels of its blocks."""
    rng = np.random.default_rng(seed)
    sentences = [s.strip() for t in texts["content"] for s in re.findall(r"[^.]+\.", t)[:4] if s.strip(" .")] or [" ".join(_FILLER)]
    some = lambda items: items[int(rng.integers(len(items)))]
    word = lambda: some(some(sentences).split()).strip(".,") or "word"
    page: list[str] = []
    labels: list[int] = []

    def put(path: str, text: str, label: int) -> None:
        tags = []
        for step in path.split():
            tag, *names = re.split("(?=[.#])", step)
            if tag != "body":
                tags.append((tag, "".join(f' {"class" if n[0] == "." else "id"}="{n[1:]}"' for n in names)))
        text = text.replace("&", "&amp;").replace("<", "&lt;")
        page.append("".join(f"<{t}{a}>" for t, a in tags) + text + "".join(f"</{t}>" for t, _ in reversed(tags)))
        labels.append(label)

    def other(where: str, item: str) -> None:
        path, kind, most = item.split("|")
        for _ in range(int(rng.integers(1, int(most) + 1))):
            if kind == "menu":
                text = some(texts["menu"] or [word()])
            elif kind == "side":
                text = some(sentences)[: int(rng.integers(20, 200))].strip()
            else:
                text = some(_PHRASES[kind])
                while "{" in text:
                    text = text.replace("{w}", word(), 1) if "{w}" in text else text.replace("{s}", some(sentences))
            put(f"{where} {path}", text or "more", 0)

    wrap = some(ARTICLES)
    bare = wrap in ("div", "body")
    for item in rng.permutation(BEFORE)[: int(rng.integers(0, 5))]:
        other("", str(item))
    if rng.random() < 0.8:
        put(f"{wrap} {'header ' if wrap.startswith('article') and rng.random() < 0.3 else ''}h1", some(texts["title"] or sentences), 1)
    for text in texts["content"] or sentences:
        put(wrap if bare and rng.random() < 0.1 else f"{wrap} {'p' if bare else some(PARTS)}", text, 1)
        if not bare and rng.random() < 0.08:
            other(wrap, some(WITHIN))
    for item in rng.permutation(AFTER)[: int(rng.integers(0, 6))]:
        other(wrap.split()[0] if wrap.startswith("main") and rng.random() < 0.4 else "", str(item))
    return "".join(page), labels


def labelled(htmls: list[str]) -> list[tuple[list[list[int]], list[int]]]:
    """Features and labels of the sampled pages, as they are and dressed in other layouts."""
    pages, sources = [], []
    for html in htmls:
        blocks = leaf_blocks(html)
        labels = own_labels(blocks)
        if any(labels):
            pages.append((page_features(blocks), labels))
            inside = [t for (t, _, _), y in zip(blocks, labels) if y]
            titles = [t for t, e, _ in blocks if e.tag == "h1"]
            sources.append({"content": [t for t in inside if t not in titles][:12], "title": titles[:1], "menu": [t for t, e, x in blocks if x > 0.8 and len(t) < 40][:8]})
    while len(sources) < FEWEST:
        sources.append({"content": [" ".join(_FILLER[i:] + _FILLER[:i]).capitalize() + "." for i in range(5)], "title": ["Some plain words"], "menu": ["Start", "More", "Contact"]})
    for i, texts in enumerate(sources):
        html, labels = dressed(texts, i)
        blocks = leaf_blocks(html)
        if len(blocks) == len(labels):
            pages.append((page_features(blocks), labels))
    return pages


def train(pages: list[tuple[list[list[int]], list[int]]], rounds: int = ROUNDS, rate: float = RATE, decay: float = DECAY) -> tuple[np.ndarray, np.ndarray]:
    """Weights (content against boilerplate) and 2 x 2 step scores by gradient ascent on the conditional likelihood."""
    pages = sorted(pages, key=lambda page: -len(page[1]))  # so that the pages still going on at a block are the first ones
    longest, n = len(pages[0][1]), len(pages)
    length = np.array([len(labels) for _, labels in pages])
    live = np.arange(longest)[None] < length[:, None]
    x = np.zeros((length.sum(), len(FEATURES)), np.float32)
    for t, row in enumerate(row for rows, _ in pages for row in rows):
        x[t, row] = 1
    y = np.zeros((n, longest))
    y[live] = np.concatenate([labels for _, labels in pages])
    both, going = live[:, 1:], live.sum(0).tolist()
    seen = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & both).sum() for b in (0, 1)] for a in (0, 1)], float)
    values = np.zeros(len(FEATURES) + 4)
    first, second = np.zeros_like(values), np.zeros_like(values)
    for turn in range(1, rounds + 1):
        weights, step = values[:-4], values[-4:].reshape(2, 2)
        score = np.zeros((n, longest, 2))
        score[live, 1] = x @ weights.astype(np.float32)
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0]
        for t in range(1, longest):
            k = going[t]
            ahead[:k, t] = np.logaddexp(ahead[:k, t - 1, 0, None] + step[0], ahead[:k, t - 1, 1, None] + step[1]) + score[:k, t]
        for t in range(longest - 2, -1, -1):
            k = going[t + 1]
            after = score[:k, t + 1] + behind[:k, t + 1]
            behind[:k, t] = np.logaddexp(step[:, 0] + after[:, [0]], step[:, 1] + after[:, [1]])
        norm = np.logaddexp(ahead[:, 0, 0] + behind[:, 0, 0], ahead[:, 0, 1] + behind[:, 0, 1])
        content = np.exp(np.minimum((ahead[..., 1] + behind[..., 1] - norm[:, None])[live], 0))
        pairs = (ahead[:, :-1, :, None] + (score + behind)[:, 1:, None, :] - norm[:, None, None, None])[both]
        expected = np.exp(np.minimum(pairs + step, 0)).sum(0)
        slope = np.r_[(y[live] - content).astype(np.float32) @ x, (seen - expected).ravel()] / len(x) - decay * values
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        values = values + rate * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.999**turn)) + 1e-8)
    return values[:-4], values[-4:].reshape(2, 2)


def viterbi(scores: list[float], step: list[list[float]]) -> list[int]:
    """Best labels where article scores ``scores`` and boilerplate 0; ties go to the article."""
    if not scores:
        return []
    low, high, back = 0.0, scores[0], []
    for s in scores[1:]:
        stay, fall = low + step[0][0], high + step[1][0]
        rise, keep = low + step[0][1], high + step[1][1]
        back.append((int(fall >= stay), int(keep >= rise)))
        low, high = max(stay, fall), max(rise, keep) + s
    label = int(high >= low)
    labels = [label]
    for choice in reversed(back):
        label = choice[label]
        labels.append(label)
    return labels[::-1]


def main_text(html: str, weights: list[float], step: list[list[float]]) -> str:
    """Article blocks of a page, a line each."""
    blocks = leaf_blocks(html)
    marks = viterbi([sum([weights[f] for f in row]) for row in page_features(blocks)], step)
    return "\n".join([text for (text, _, _), mark in zip(blocks, marks) if mark])


def fit(pages: DataFrame, sample: int = SAMPLE) -> tuple[list[float], list[list[float]]]:
    """Weights from at most ``sample`` pages chosen by hash, none longer than SAMPLE_CHARS.

    Only a page that marks its article can be a labelled one. The bound keeps what the
    driver gets below sample x SAMPLE_CHARS characters.
    """
    code = F.xxhash64("page_id", "url", "html")
    marked = pages.filter(F.length("html").between(1, SAMPLE_CHARS) & F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    share = min(1.0, 4 * sample / max(1, pages.count()))
    picked = marked.select("html", code.alias("code")).filter(F.pmod("code", F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    rows = picked.orderBy("code", "html").limit(sample).collect()
    weights, step = train(labelled([r["html"] for r in rows]))
    return weights.tolist(), step.tolist()


def extracted(pages: DataFrame, model: tuple[list[float], list[list[float]]]) -> DataFrame:
    """One row per input row: page_id, url, text (main text), n_chars (its code points)."""
    weights, step = model
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, htmls in chunks(batch, "html"):
                texts = [main_text(h, weights, step) for h in htmls]
                keys = [batch.column(c).slice(first, len(texts)) for c in ("page_id", "url")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    return pages.select("page_id", "url", "html").mapInArrow(run, schema)


def page_texts(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The main text of every page, by a model fitted to a sample of the same table.

    NULL and empty html, and pages without article blocks, give the empty text; NULL ids
    and addresses stay; repeated rows each get their row, with equal texts; an empty table
    gives none; html of any length is read whole. Other columns are not read.
    """
    return extracted(pages, fit(pages, sample))

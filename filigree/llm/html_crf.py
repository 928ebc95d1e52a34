"""Main text of web pages by a linear-chain CRF over the leaf blocks of a page.

A leaf block is a run of text between two block boundaries. Its features come from the tags,
classes and ids of its ancestors and from its text; the chain adds how likely main text
follows main text. Weights are fitted on labelled pages (`labelled_pages`), in which each
region is marked as article or not; decoding is Viterbi, one page at a time.
"""
from __future__ import annotations

import functools
import html
import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element kinds of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset"
    " figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol"
    " option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg math audio video select".split())
#: A start tag of the first kind ends an open element of the second.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "p": ("p",),
}
#: Elements that such an end does not reach over.
SCOPES = frozenset("body html table ul ol dl td th article section div main aside nav form blockquote".split())

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)", re.S
)
NAMES = re.compile(r"""(?:^|\s)(class|id|role|data-main)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[A-Za-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[^\W\d_]+")


class Node:
    """An open element: its features beside its parent's, and their summed weight."""

    __slots__ = ("tag", "parent", "features", "score", "label")

    def __init__(self, tag: str, parent: Node | None, features: tuple[str, ...], weights: dict[str, float], label: int | None):
        self.tag, self.parent, self.features = tag, parent, features
        self.score = (parent.score if parent else 0.0) + sum(weights.get(f, 0.0) for f in features)
        self.label = label if label is not None or parent is None else parent.label


@functools.lru_cache(maxsize=4096)
def _element(tag: str, attributes: str) -> tuple[tuple[str, ...], int | None]:
    found, label = [f"in:{tag}"], None
    for name, *values in NAMES.findall(attributes):
        value = "".join(values)
        if name.lower() == "data-main":
            label = int(value == "1")
            continue
        found += {f"name:{x.lower()}" for x in PART.findall(CAMEL.sub(" ", value))}
    return tuple(found), label


class Block:
    __slots__ = ("node", "text", "linked")

    def __init__(self, node: Node, text: str, linked: int):
        self.node, self.text, self.linked = node, text, linked


def leaf_blocks(page: str, weights: dict[str, float]) -> list[Block]:
    """Leaf blocks with text, in page order.

    Character references are decoded and white space becomes single spaces. Scripts, styles,
    titles and other raw content give no text. Missing and stray end tags are tolerated.
    """
    top = node = Node("", None, (), weights, None)
    out: list[Block] = []
    parts: list[str] = []
    linked, in_link = 0, False

    def end_block():
        nonlocal parts, linked
        if parts:
            text = SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.append(Block(node, text, linked))
            parts, linked = [], 0

    at = 0
    lowered = None
    while True:
        token = TOKEN.search(page, at)
        piece = page[at : token.start()] if token else page[at:]
        if piece:
            if "&" in piece:
                piece = html.unescape(piece)
            parts.append(piece)
            if in_link:
                linked += len(piece)
        if not token:
            break
        at = token.end()
        closing, tag = token.group(1), token.group(2)
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = not closing
        elif tag in RAW:
            if not closing and not token.group(3).endswith("/"):
                lowered = page.lower() if lowered is None else lowered
                if len(lowered) != len(page):  # some letters get longer in lower case
                    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), page)
                stop = lowered.find(f"</{tag}", at)
                if stop >= 0:
                    at = stop
                elif tag in ("script", "style"):
                    at = len(page)
            if tag in BLOCKS:
                end_block()
        elif tag in BLOCKS:
            end_block()
            if closing:
                seek = node
                while seek.parent is not None and seek.tag != tag:
                    seek = seek.parent
                node = seek.parent if seek.parent is not None else node
                in_link = False
            elif tag not in VOID:
                ends, seek = CLOSES.get(tag, ("p",)), node
                while seek.parent is not None and seek.tag not in ends and seek.tag not in SCOPES:
                    seek = seek.parent
                while seek.parent is not None and seek.tag in ends:
                    node = seek = seek.parent
                features, label = _element(tag, token.group(3))
                node = Node(tag, node, features, weights, label)
    end_block()
    return out


def own_features(block: Block) -> list[str]:
    """Features of the block itself: its tag and its text."""
    text, tag = block.text, block.node.tag
    n = len(text)
    scope = block.node
    while scope.parent is not None and scope.tag not in SCOPES:
        scope = scope.parent
    found = [f"tag:{tag}", f"within:{scope.tag}>{tag}", f"size:{min(9, int(math.log2(n)))}", f"linked:{min(4, 4 * block.linked // n)}", "bias"]
    if text[-1] in ".!?…\"”»":
        found.append("ends")
    if text.count(",") + text.count(". ") >= 2:
        found.append("sentences")
    if n <= 120:
        found += [f"word:{w}" for w in set(WORD.findall(text.lower()))]
        if "©" in text or "|" in text:
            found.append("sign")
    return found


def ancestors(block: Block) -> list[str]:
    found, node = [], block.node
    while node is not None:
        found += node.features
        node = node.parent
    return found


# --- labelled pages -----------------------------------------------------------------------

# Names that sites give to the parts of a page, and phrases found there.
OTHER_NAMES = {
    "nav": "nav navbar menu main-menu navigation breadcrumb breadcrumbs topnav pagination pager",
    "header": "header site-header masthead topbar banner logo branding tagline",
    "footer": "footer site-footer copyright legal colophon bottom credits",
    "sidebar": "sidebar side-bar widget related related-posts recommended trending popular rail tags toc",
    "notice": "cookie cookie-notice consent gdpr notice alert banner newsletter paywall popup modal overlay",
    "ad": "ad ads advert advertisement sponsored promo promoted sponsor adsense banner-ad",
    "form": "search search-form subscribe signup login contact-form newsletter-form",
    "comments": "comments comment comment-list commentlist discussion replies reader-comments respond disqus",
    "share": "share social share-buttons follow toolbar meta",
}
PHRASES = {
    "nav": "Home|About|Contact|News|Products|Blog|Login|Archive|Help",
    "header": "Daily News|Welcome to our site|Your source for everything|Skip to content",
    "footer": "© 2024 Example Ltd.|All rights reserved.|Privacy policy|Terms of use|Imprint|Contact us",
    "sidebar": "Related articles|Most read|You may also like|Recent posts|Tags|Read more",
    "notice": "We use cookies to improve your experience.|By using this site you accept cookies.|Accept all|Please disable your ad blocker.",
    "ad": "Advertisement|Sponsored|Buy now and save|Limited offer|Shop now",
    "form": "Subscribe to our newsletter|Enter your email address|Search|Send|Sign up|Your name",
    "comments": "Comments|Leave a reply|Reply|Posted by|3 comments|Log in to comment|says",
    "share": "Share|Tweet|Print|Follow us|Share this article",
}
SYLLABLES = "ka lo mi ter san vel dor en pra sti on ul fe gri ba nes to ru".split()
COMMON = "the of and a to in is for on more with that it as we you your our all now new at from this not are was by or an"
MAIN_NAMES = "content post post-content entry entry-content article article-body story main-content text body"


class _Maker:
    """Writes one labelled page; data-main marks the regions."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def pick(self, words: str, by: str = " ") -> str:
        return self.rng.choice(words.split(by))

    def word(self) -> str:
        """Made up, or one that any part of a page may hold, so that words tell little on their own."""
        roll = self.rng.random()
        if roll < 0.3:
            return self.pick(COMMON)
        if roll < 0.4:
            return self.pick(self.pick(PHRASES[self.pick(" ".join(PHRASES))], "|").strip(".©").lower())
        return "".join(self.rng.choice(SYLLABLES) for _ in range(self.rng.randint(1, 4)))

    def sentence(self, most: int = 18) -> str:
        words = [self.word() for _ in range(self.rng.randint(1, most))]
        for i in range(len(words) - 1):
            if self.rng.random() < 0.08:
                words[i] += self.rng.choice([",", ",", "&amp;", "%", "***", ":"])
        return " ".join(words).capitalize() + self.rng.choice([".", ".", ".", "!", "?", ""])

    def prose(self, most: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(1, most)))

    def close(self, tag: str) -> str:
        return "" if tag in ("p", "li") and self.rng.random() < 0.2 else f"</{tag}>"

    def named(self, kind: str) -> str:
        if self.rng.random() < 0.1:
            return ""
        return f' {self.rng.choice(["class", "class", "id"])}="{self.pick(OTHER_NAMES[kind])}"'

    def other(self, kind: str) -> str:
        rng = self.rng
        tags = {"nav": ["nav", "div", "nav"], "header": ["header", "div"], "footer": ["footer", "footer", "div"],
                "sidebar": ["aside", "div"], "form": ["form", "form"], "comments": ["section", "div", "ol"]}
        tag = rng.choice(tags.get(kind, ["div", "div", "section", "p"]))
        bare = tag in ("nav", "footer", "aside", "header", "form")
        name = "" if bare and rng.random() < 0.6 else self.named(kind) or f' class="{kind}"'
        phrase = lambda: self.pick(PHRASES[kind], "|") if rng.random() < 0.6 else self.sentence(8)
        if kind in ("nav", "share") or kind == "sidebar" and rng.random() < 0.5:
            body = "<ul>" + "".join(f'<li><a href="/{i}">{phrase()}</a>{self.close("li")}' for i in range(rng.randint(2, 7))) + "</ul>"
        elif kind == "comments":
            body = f"<h3>{phrase()}</h3>" + "".join(
                f'<div{rng.choice(["", " class=comment"])}><p>{self.word()} {self.pick("says|wrote|posted|replied", "|")}</p><p>{self.prose(4)}{self.close("p")}</div>'
                for _ in range(rng.randint(1, 4))
            )
        elif kind == "form":
            body = f'<label>{phrase()}</label><input type="text"><button>{phrase()}</button>'
        elif tag == "p" or rng.random() < 0.5:
            body = " ".join(rng.choice([phrase, lambda: self.prose(3)])() for _ in range(rng.randint(1, 2)))
        else:
            body = "".join(f"<p>{rng.choice([phrase, lambda: self.prose(3)])()}{self.close('p')}" for _ in range(rng.randint(1, 3)))
        return f"<{tag}{name} data-main=0>{body}</{tag}>"

    def main(self) -> str:
        rng = self.rng
        parts = [f"<h1>{self.sentence(9)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.randint(1, 14)):
            roll = rng.random()
            if roll < 0.66:
                parts.append(f"<p>{rng.choice(['', '', '<b>'])}{self.prose()}{rng.choice(['', '', '<br>'])}{self.close('p')}")
            elif roll < 0.74:
                parts.append(f"<h{rng.randint(2, 4)}>{self.sentence(7)}</h2>".replace("</h2>", "</h3>" if rng.random() < 0.1 else "</h2>"))
            elif roll < 0.8:
                parts.append("<ul>" + "".join(f"<li>{self.sentence()}{self.close('li')}" for _ in range(rng.randint(1, 5))) + "</ul>")
            elif roll < 0.84:
                parts.append(f"<blockquote>{self.prose(2)}</blockquote>")
            elif roll < 0.87:
                parts.append("<table>" + "".join(f"<tr><th>{self.word()}<td>{self.sentence(4)}</tr>" for _ in range(rng.randint(1, 4))) + "</table>")
            elif roll < 0.9:
                parts.append(f"<figure><img src=x><figcaption>{self.sentence(8)}</figcaption></figure>")
            elif roll < 0.93:
                parts.append(f'<p>{self.sentence()} <a href="/x">{self.sentence(3)}</a> {self.sentence()}</p>')
            else:
                parts.append(self.other(rng.choice(["ad", "ad", "share", "sidebar", "notice", "form"])))
        if rng.random() < 0.25:
            parts.append(self.other("comments"))
        body = "".join(parts)
        roll = rng.random()
        if roll < 0.5:
            return f"<article data-main=1>{body}</article>"
        if roll < 0.65:
            return f"<main data-main=1>{body}</main>"
        if roll < 0.95:
            return f'<div {rng.choice(["class", "id"])}="{self.pick(MAIN_NAMES)}" data-main=1>{body}</div>'
        return f"<div data-main=1>{body}</div>"

    def page(self) -> str:
        rng = self.rng
        before = [k for k in ("header", "nav", "notice", "ad", "form", "nav") if rng.random() < 0.45]
        after = [k for k in ("share", "comments", "sidebar", "ad", "form", "notice", "footer") if rng.random() < 0.4]
        if rng.random() < 0.3:
            before.append("sidebar")
        inner = "".join(map(self.other, before)) + self.main() + "".join(map(self.other, after))
        if rng.random() < 0.4:
            inner = f'<div class="{rng.choice(["page", "wrapper", "container", "site"])}">{inner}</div>'
        return f"<html><head><title>{self.sentence(5)}</title></head><body>{inner}</body></html>"


def labelled_pages(n: int, seed: int = 1) -> list[str]:
    """Pages in which the attribute data-main (1 or 0) marks article and other regions."""
    return [_Maker(seed * 1_000_003 + i).page() for i in range(n)]


# --- the chain ----------------------------------------------------------------------------

#: Labelled pages and rounds of fitting; features of fewer blocks than this don't count.
PAGES, ROUNDS, SEEN, SHRINK = 900, 160, 3, 5e-4


class Chain:
    """Weights of features for label 1 (label 0 has none) and of label pairs."""

    def __init__(self, weights: dict[str, float], steps: list[list[float]], starts: list[float]):
        self.weights, self.steps, self.starts = weights, steps, starts

    def decode(self, scores: list[float]) -> list[int]:
        """The best labels for the label-1 scores of a page's blocks (Viterbi)."""
        if not scores:
            return []
        (a, b), (c, d) = self.steps
        no, yes = self.starts[0], self.starts[1] + scores[0]
        back = []
        for score in scores[1:]:
            to_no, to_yes = (no + a, 0) if no + a >= yes + c else (yes + c, 1), (no + b, 0) if no + b > yes + d else (yes + d, 1)
            back.append((to_no[1], to_yes[1]))
            no, yes = to_no[0], to_yes[0] + score
        labels = [int(yes > no)]
        for pair in reversed(back):
            labels.append(pair[labels[-1]])
        return labels[::-1]

    def main_text(self, page: str | None) -> str:
        blocks = leaf_blocks(page or "", self.weights)
        weight = self.weights.get
        scores = [b.node.score + sum(weight(f, 0.0) for f in own_features(b)) for b in blocks]
        return "\n\n".join(b.text for b, main in zip(blocks, self.decode(scores)) if main)


def fit_chain(pages: list[str]) -> Chain:
    """Maximum likelihood with a quadratic penalty, by AdaGrad over all pages at once.

    Pages are padded to one length, so forward and backward sums run over all of them.
    """
    parsed = [[(ancestors(b) + own_features(b), b.node.label or 0) for b in leaf_blocks(p, {})] for p in pages]
    parsed = [p for p in parsed if p]
    seen = Counter(f for p in parsed for fs, _ in p for f in set(fs))
    index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= SEEN))}
    n, longest = len(parsed), max(map(len, parsed))
    real, gold = np.zeros((n, longest), bool), np.zeros((n, longest), int)
    owner, feature = [], []
    for i, page in enumerate(parsed):
        for t, (found, label) in enumerate(page):
            real[i, t], gold[i, t] = True, label
            known = [index[f] for f in found if f in index]
            feature += known
            owner += [i * longest + t] * len(known)
    owner, feature = np.array(owner), np.array(feature)
    pair = real[:, 1:]
    w, steps, starts = np.zeros(len(index)), np.zeros((2, 2)), np.zeros(2)
    power = [np.full_like(x, 1e-8) for x in (w, steps, starts)]
    gold_steps = np.array([[((gold[:, :-1] == a) & (gold[:, 1:] == b) & pair).sum() for b in (0, 1)] for a in (0, 1)])
    gold_starts = np.array([(gold[:, 0] == 0).sum(), (gold[:, 0] == 1).sum()])
    for _ in range(ROUNDS):
        score = np.zeros((n, longest, 2))
        score[:, :, 1] = np.bincount(owner, w[feature], n * longest).reshape(n, longest)
        ahead, behind = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        ahead[:, 0] = starts + score[:, 0]
        for t in range(1, longest):
            step = np.logaddexp.reduce(ahead[:, t - 1, :, None] + steps, axis=1) + score[:, t]
            ahead[:, t] = np.where(real[:, t, None], step, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(steps + (score[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where(real[:, t + 1, None], step, behind[:, t + 1])
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        chance = np.exp(ahead + behind - total[:, None, None])
        wrong = np.where(real, chance[:, :, 1] - gold, 0.0)
        pairs = np.exp(
            ahead[:, :-1, :, None] + steps + (score[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]
        )
        grads = [
            np.bincount(feature, wrong.reshape(-1)[owner], len(w)) / n + SHRINK * w,
            ((pairs * pair[:, :, None, None]).sum(axis=(0, 1)) - gold_steps) / n + SHRINK * steps,
            (chance[:, 0].sum(axis=0) - gold_starts) / n + SHRINK * starts,
        ]
        for x, g, p in zip((w, steps, starts), grads, power):
            p += g * g
            x -= 0.4 * g / np.sqrt(p)
    return Chain({f: float(w[i]) for f, i in index.items()}, steps.tolist(), starts.tolist())


@functools.cache
def trained() -> Chain:
    """The chain fitted on the labelled pages, once per process."""
    return fit_chain(labelled_pages(PAGES))


def main_texts(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of `pages`.

    A null or empty page, or one without main text, has an empty text. Rows are independent,
    so repeated ones give repeated results.
    """
    shared = pages.sparkSession.sparkContext.broadcast(chain or trained())

    @F.pandas_udf("string")
    def extract(html_text: pd.Series) -> pd.Series:
        return pd.Series([shared.value.main_text(x) for x in html_text], dtype=object)

    out = pages.select("page_id", "url", extract(F.coalesce("html", F.lit(""))).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))

"""A page's elements, the text in them, and features of every element."""

from __future__ import annotations

import html
import re
import zlib

import numpy as np

# Fixed values of HTML: elements without contents, elements whose contents are no text of the page,
# elements that end a line of text, and what an opening element closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe svg textarea title head".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup "
    "option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
#: Elements through which an implied end does not reach.
WALL = frozenset("article aside body div footer form header html main nav ol section table td ul dl".split())

#: Words in class, id and role that speak for or against main text (fixed lists).
FOR = "article content main body post story entry text page blog news".split()
AGAINST = (
    "nav menu header footer foot sidebar side aside ad ads advert promo sponsor banner cookie notice "
    "consent alert popup modal comment comments reply form login subscribe newsletter share social "
    "related breadcrumb widget copyright toolbar search pagination thread disqus replies responses "
    "discussion reactions feedback talkback".split()
)
TAGS = (
    "p div span a b li ul article main section nav header footer aside form h1 h2 h3 table td "
    "blockquote pre figure button label".split()
)

#: Slots that tokens of class, id and role are hashed to; an element also has those of all around it.
TOKEN_SLOTS = 32

_TAG = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*+(?:>|$)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S
)
_END = {name: re.compile(rf"</{name}(?![^\s/>])", re.I | re.A) for name in RAW}
_ATTRIBUTE = re.compile(r"""(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_TOKEN = re.compile(r"[a-z]+")
_SIGNS = re.compile(r"[.!?,;:]")


class Page:
    """Elements in page order; element 0 stands for the page."""

    def __init__(self, source: str):
        self.tag, self.attributes, self.parent, self.depth = ["#page"], [""], [0], [0]
        self.pieces: list[tuple[int, int, str]] = []  # element, block, text
        self.read(source)

    def read(self, source: str) -> None:
        stack, block, at = [0], 0, 0
        for m in _TAG.finditer(source):
            if m.start() < at:
                continue  # inside an element without text
            self.text(source[at : m.start()], stack[-1], block)
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            block += name in BLOCK
            if m[1]:
                open_ = [self.tag[i] for i in stack]
                if name in open_[1:]:
                    while self.tag[stack.pop()] != name:
                        pass
                continue
            closes = CLOSES.get(name, frozenset()) | ({"p"} if name in BLOCK else frozenset())
            if closes:
                for depth in range(len(stack) - 1, 0, -1):
                    tag = self.tag[stack[depth]]
                    if tag in closes:
                        del stack[depth:]
                        break
                    if tag in WALL:
                        break
            if name in RAW and name != "head":
                if name == "svg" and m[3].endswith("/"):
                    continue  # closed at once
                end = _END[name].search(source, at)
                close = source.find(">", end.start()) if end else -1
                at = len(source) if close < 0 else close + 1
                continue
            if name not in VOID:
                self.tag.append(name)
                self.attributes.append(m[3])
                self.parent.append(stack[-1])
                self.depth.append(self.depth[stack[-1]] + 1)
                if not m[3].endswith("/"):
                    stack.append(len(self.tag) - 1)
            elif name == "br":
                self.text(" ", stack[-1], block)
        self.text(source[at:], stack[-1], block)

    def text(self, piece: str, element: int, block: int) -> None:
        if piece:
            self.pieces.append((element, block, html.unescape(piece) if "&" in piece else piece))

    def features(self) -> np.ndarray:
        """One row per element."""
        n = len(self.tag)
        own, links, signs, words = np.zeros((4, n))
        below, paragraphs, children, heads = np.zeros((4, n))
        for element, _, piece in self.pieces:
            size = len(piece.strip())
            own[element] += size
            if size:
                signs[element] += len(_SIGNS.findall(piece))
                words[element] += piece.count(" ") + 1
        is_link = [t == "a" for t in self.tag]
        good, bad, inside = np.zeros((3, n))
        position, slots = np.zeros(n), np.zeros((n, TOKEN_SLOTS))
        for i in range(1, n):
            p = self.parent[i]
            position[i] = children[p]
            children[p] += 1
            slots[i] = slots[p]
            if self.attributes[i]:
                tokens = _TOKEN.findall(" ".join(_ATTRIBUTE.findall(self.attributes[i])).lower())
                good[i] = sum(t in _FOR for t in tokens)
                bad[i] = sum(t in _AGAINST for t in tokens)
                slots[i, [zlib.crc32(t.encode()) % TOKEN_SLOTS for t in tokens]] = 1
            against = bad[i] > 0 or self.tag[i] in _AGAINST
            inside[i] = max(inside[p], float(against)) if not against else 1.0
        total, linked = own.copy(), np.where(is_link, own, 0.0)
        all_signs, all_words = signs.copy(), words.copy()
        largest = np.zeros(n)
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            if is_link[i]:
                linked[i] = total[i]
            total[p] += total[i]
            linked[p] += linked[i]
            all_signs[p] += all_signs[i]
            all_words[p] += all_words[i]
            below[p] += below[i] + 1
            heads[p] += heads[i] + (self.tag[i] in _HEADS)
            paragraphs[p] += self.tag[i] == "p"
            largest[p] = max(largest[p], total[i])
        parent = np.array(self.parent)
        column = np.array([_TAG_NUMBER.get(t, len(TAGS)) for t in self.tag])
        one_hot = np.zeros((n, len(TAGS) + 1))
        one_hot[np.arange(n), column] = 1
        stats = [
            np.log1p(own),
            np.log1p(total),
            total / max(total[0], 1),
            total / (below + 1),
            linked / np.maximum(total, 1),
            all_signs / np.maximum(all_words, 1),
            all_words / np.maximum(children, 1),
            np.array(self.depth, dtype=float),
            position,
            position / np.maximum(children[parent], 1),
            children,
            children[parent],
            paragraphs,
            paragraphs[parent],
            heads,
            heads[parent],
            linked[parent] / np.maximum(total[parent], 1),
            total / np.maximum(total[parent], 1),
            total / np.maximum(largest[parent], 1),
            np.minimum(good, 3),
            np.minimum(bad, 3),
            good[parent],
            bad[parent],
            inside,
            np.arange(n) / n,
        ]
        return np.column_stack([*stats, one_hot, one_hot[parent], slots])

    def decide(self, margins: np.ndarray) -> np.ndarray:
        """Which elements' own text is main text, without contradictions along the tree.

        An element is taken with all below it, left with all below it, or open, and then its children
        decide for themselves at the price of a small penalty. The best total is found bottom up. So
        nothing below a rejected element comes back, and nothing below a taken one is lost.
        """
        n = len(self.tag)
        own = np.zeros(n)
        for element, _, piece in self.pieces:
            own[element] += len(piece.strip())
        vote = np.clip(margins, -6, 6) * (np.log1p(own) + 0.25)
        take, leave = vote.copy(), -vote
        mixed = np.where(own > 0, np.abs(vote), 0.0) - PENALTY
        best = np.zeros(n)
        for i in range(n - 1, -1, -1):
            best[i] = max(take[i], leave[i], mixed[i])
            if i:
                p = self.parent[i]
                take[p] += take[i]
                leave[p] += leave[i]
                mixed[p] += best[i]
        state = np.zeros(n, dtype=np.int64)  # 1 taken, -1 left, 0 open
        chosen = np.zeros(n, dtype=bool)
        for i in range(n):
            above = state[self.parent[i]] if i else 0
            if above:
                state[i] = above
            elif take[i] >= leave[i] and take[i] >= mixed[i]:
                state[i] = 1
            elif leave[i] >= mixed[i]:
                state[i] = -1
            chosen[i] = state[i] > 0 or (state[i] == 0 and vote[i] > 0)
        return chosen

    def text_of(self, chosen: np.ndarray) -> str:
        """The chosen elements' text, block after block."""
        blocks: dict[int, list[str]] = {}
        for element, block, piece in self.pieces:
            if chosen[element]:
                blocks.setdefault(block, []).append(piece)
        lines = (" ".join("".join(parts).split()) for parts in blocks.values())
        return "\n\n".join(line for line in lines if line)


#: What it costs to decide an element's children one by one.
PENALTY = 1.0
_HEADS = frozenset(["h1", "h2"])
_FOR, _AGAINST = frozenset(FOR), frozenset(AGAINST)
_TAG_NUMBER = {t: i for i, t in enumerate(TAGS)}

"""HTML extraction: a linear-chain conditional random field over the leaf blocks of a page.

Blocks are described by their ancestors' tags and class words and by their text; the field is trained by
forward-backward gradients on labelled pages, which are written in many makes with their labels, and
decoded by Viterbi.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm import makes

#: Written pages that the field is trained on, and rounds over them.
WRITTEN_PAGES, ROUNDS = 1000, 6

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|[^<]+|<", re.DOTALL)
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_WORDS = re.compile(r"[a-zA-Z]+")
RAW = frozenset("script style textarea title noscript template iframe svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: Start tags that end an open element of these kinds.
ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
MAIN, OTHER = 1, 0


@dataclass
class Element:
    """An open or closed element: its feature words, the sections around it, and sums over what it holds."""

    tag: str
    words: tuple[str, ...]
    sections: frozenset[str]
    parent: Element | None
    first: int = 0
    last: int = 0
    chars: int = 0
    linked: int = 0
    prose: int = 0  # letters outside links of the paragraphs right below it


@dataclass
class Block:
    parent: Element
    text: str
    linked: int  # letters within links


#: Elements that tell what they hold, at any distance.
SECTIONS = frozenset("article main aside nav footer header form section table".split())
#: Elements beyond which an end that a start tag implies doesn't reach.
SCOPES = frozenset("ul ol table dl select div article section nav aside main header footer form blockquote figure fieldset details dialog body".split())
#: Nearest elements whose words describe a block, and letters of a class word that count.
NEAREST, STEM = 8, 6


@lru_cache(maxsize=50_000)
def _labels(tag: str, attrs: str) -> tuple[str, ...]:
    """An element's feature words: its tag, and the stems of the words of its class, id and role."""
    names = " ".join(a or b or c for a, b, c in _NAMES.findall(attrs))
    return (f"<{tag}>", *sorted({f".{w.lower()[:STEM]}" for w in _WORDS.findall(html.unescape(names))}))


def parse(page: str) -> list[Block]:
    """The leaf blocks in page order: text between block-level tags, references decoded, white space made one space. Linear in the page."""
    root = Element("", (), frozenset(), None)
    stack: list[Element] = [root]
    opened: Counter = Counter()
    out: list[Block] = []
    text: list[str] = []
    linked = links = at = 0

    def flush() -> None:
        nonlocal linked
        words = " ".join("".join(text).split())
        if words:
            b = Block(stack[-1], words, min(linked, len(words)))
            out.append(b)
            for e in (b.parent, b.parent.parent) if b.parent.tag in ("p", "li", "blockquote") and b.parent.parent else (b.parent,):
                e.prose += len(words) - b.linked
            b.parent.chars += len(words)
            b.parent.linked += b.linked
        text.clear()
        linked = 0

    def pop() -> Element:
        e = stack.pop()
        opened[e.tag] -= 1
        e.last = len(out)
        e.parent.chars += e.chars
        e.parent.linked += e.linked
        return e

    n = len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m["tag"]
        if tag is None:
            piece = m["cdata"] if m["cdata"] is not None else "" if m[0].startswith(("<!", "<?")) else html.unescape(m[0])
            text.append(piece)
            if links:
                linked += len(piece.strip())
            continue
        tag = tag.lower()
        if m["close"]:
            if tag == "a":
                links = max(0, links - 1)
            if tag == "br" or tag == "p" and not opened["p"]:
                text.append(" ") if tag == "br" else flush()
                continue
            if opened[tag]:
                flush()
                links = 0
                while pop().tag != tag:
                    pass
            continue
        if tag in BLOCKS:
            flush()
            links = 0
            ends = ENDS.get(tag, _P)
            if any(opened[t] for t in ends):
                cut, i = None, len(stack) - 1
                while i > 0 and stack[i].tag not in SCOPES:
                    cut = i if stack[i].tag in ends else cut
                    i -= 1
                while cut is not None and len(stack) > cut:
                    pop()
        elif tag == "br":
            text.append(" ")
        if tag in VOID or m["attrs"].endswith("/"):
            continue
        if tag in RAW:
            end = _RAW_ENDS[tag].search(page, at)
            if tag in ("textarea", "noscript"):
                flush()
            at = end.end() if end else n
            continue
        if tag == "a":
            links += 1
        elif tag in BLOCKS:
            around = stack[-1].sections
            stack.append(Element(tag, _labels(tag, m["attrs"]), around | {tag} if tag in SECTIONS and tag not in around else around, stack[-1], len(out)))
            opened[tag] += 1
    flush()
    while len(stack) > 1:
        pop()
    root.last = len(out)
    return out


_P = {"p"}
_RAW_ENDS = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|$)", re.IGNORECASE) for tag in RAW}


def _nearest(e: Element) -> list[Element]:
    found = []
    while e.parent is not None and len(found) < NEAREST:
        found.append(e)
        e = e.parent
    return found


def _share(part: int, whole: int) -> int:
    return 4 * part // whole if whole else 0


def _core(blocks: list[Block]) -> tuple[int, int]:
    """The blocks of the element that holds the most prose right below it, or within its sections."""
    best, seen = None, set()
    for b in blocks:
        for e in _nearest(b.parent)[:3]:
            if id(e) not in seen:
                seen.add(id(e))
                if best is None or e.prose > best.prose:
                    best = e
    return (best.first, best.last) if best else (0, 0)


def describe(blocks: list[Block]) -> list[tuple[str, ...]]:
    """Each block's features: words of its nearest elements, the sections around it, its length, links and closing mark, and its place by the page's core of prose and its title."""
    first, last = _core(blocks)
    whole = sum(len(b.text) for b in blocks)
    title, out = False, []
    for i, b in enumerate(blocks):
        path = _nearest(b.parent)
        own = path[0].words if path else ()
        title = title or b.parent.tag == "h1"
        place = "in" if first <= i < last else "before" if i < first else "after"
        up = [*path[:3], *[b.parent] * (3 - len(path))]
        t = b.text
        size, link = min(8, len(t).bit_length()), _share(b.linked, len(t))
        out.append((
            *{w for e in path for w in e.words}, *(f"own{w}" for w in own), "pair" + "".join(e.tag + ">" for e in reversed(path[:2])), *(f"section {x}" for x in b.parent.sections),
            f"len{size}", f"link{link}", f"end{t[-1] if not t[-1].isalnum() else 'a'}", "©" if "©" in t else "-", f"core {place}", f"core {place} len{size}", f"core {place} link{link}",
            f"core {place} {b.parent.tag}", f"title {title}", f"links {_share(up[1].linked, up[1].chars)}", f"links above {_share(up[2].linked, up[2].chars)}", f"share {_share(up[1].chars, whole)}",
        ))
    return out


@dataclass
class Field:
    """Weights of features for main text against other, and of steps between the two labels."""

    weights: dict[str, float] = field(default_factory=dict)
    steps: list[list[float]] = field(default_factory=lambda: [[0.0, 0.0], [0.0, 0.0]])

    def scores(self, rows: list[tuple[str, ...]]) -> list[float]:
        get = self.weights.get
        return [sum([get(f, 0.0) for f in fs]) for fs in rows]

    def viterbi(self, s: list[float]) -> list[int]:
        if not s:
            return []
        (a, b), (c, d) = self.steps
        other, main, back = 0.0, s[0], []
        for x in s[1:]:
            o, m = (other + a, main + c), (other + b, main + d)
            back.append((int(o[1] > o[0]), int(m[1] > m[0])))
            other, main = max(o), max(m) + x
        y = [int(main > other)]
        for pair in reversed(back):
            y.append(pair[y[-1]])
        return y[::-1]

    def train_on(self, rows: list[tuple[str, ...]], labels: list[int], rate: float, squares: dict) -> None:
        """One step along the gradient of the labels' log-likelihood, by forward and backward sums, scaled by past squares."""
        s, w, n = self.scores(rows), self.steps, len(rows)
        add = lambda p, q: max(p, q) + math.log1p(math.exp(-abs(p - q)))
        forward, backward = [(0.0, s[0])], [(0.0, 0.0)]
        for x in s[1:]:
            o, m = forward[-1]
            forward.append((add(o + w[0][0], m + w[1][0]), add(o + w[0][1], m + w[1][1]) + x))
        for x in reversed(s[1:]):
            o, m = backward[-1]
            backward.append((add(w[0][0] + o, w[0][1] + x + m), add(w[1][0] + o, w[1][1] + x + m)))
        backward.reverse()
        total = add(*forward[-1])
        gradient: defaultdict = defaultdict(float)
        for i in range(n):
            off = labels[i] - math.exp(forward[i][1] + backward[i][1] - total)
            for f in rows[i]:
                gradient[f] += off
        for i in range(1, n):
            gradient[labels[i - 1], labels[i]] += 1
            for a in (0, 1):
                for b in (0, 1):
                    gradient[a, b] -= math.exp(forward[i - 1][a] + w[a][b] + b * s[i] + backward[i][b] - total)
        for f, g in gradient.items():
            squares[f] = squares.get(f, 1e-2) + g * g
            change = rate * g / math.sqrt(squares[f])
            if isinstance(f, tuple):
                self.steps[f[0]][f[1]] += change
            else:
                self.weights[f] = self.weights.get(f, 0.0) + change


def train(marked: Iterable[str] = (), written: int = WRITTEN_PAGES) -> Field:
    """A field from labelled pages: ``written`` ones of many makes (``makes.py``) and any further ``marked`` in the same way.

    Nothing of the table to be extracted is read, so its size doesn't matter and its pages are all unseen.
    """
    shown = [x for page in chain(makes.pages(written, seed=1), marked) if MAIN in (x := labelled(page))[1]]
    crf, squares = Field(), {}
    for k in range(ROUNDS):
        for fs, ys in shown:
            crf.train_on(fs, ys, 0.3 / (k + 1), squares)
    return crf


def labelled(page: str) -> tuple[list[tuple[str, ...]], list[int]]:
    """Features and labels of a written page, whose main blocks begin with a mark that is taken off first."""
    blocks = parse(page)
    ys = [MAIN if makes.MARK in b.text else OTHER for b in blocks]
    for b in blocks:
        b.text = b.text.replace(makes.MARK, "")
    return describe(blocks), ys


def main_text(page: str, crf: Field) -> str:
    blocks = parse(page)
    keep = crf.viterbi(crf.scores(describe(blocks)))
    return "\n".join(b.text for b, y in zip(blocks, keep, strict=True) if y == MAIN)


def extract(pages: DataFrame, crf: Field) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages(page_id, url, html)``, from the whole html.

    Null and empty pages and pages without main text give an empty text; repeated rows and null ids are
    extracted like others; an empty table gives no rows; other columns are not read. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h or "", crf) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")

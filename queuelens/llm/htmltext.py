"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

Blocks
    The page is read tag by tag (no tree is built): a stack holds the open elements, block elements cut the text into
    leaf blocks, inline elements, formulas, drawings, scripts and ``br`` do not. Scripts, styles, comments and other
    parts without text are passed over; text in ``noscript`` and ``object`` is a block for the model to judge. A head
    without an end tag ends before the first text or element that cannot stand in it. Character references are decoded,
    white space inside a block becomes one space, and empty blocks vanish.

Model
    Each block has features of its ancestors (tags, words of classes and ids, form or list around it) and of its
    text (length, share of linked text, ending, ...). A linear-chain CRF with two states (main text or not) has a
    weight per feature and state and per pair of states; it is trained by maximum likelihood with gradient steps on
    labelled pages and decoded by Viterbi. ``fit`` takes any labelled pages (a bounded sample, default 600 made by
    ``pagemaker``); words of classes that training has not seen are ignored.

Edge cases: null and empty pages give an empty text; unclosed and stray tags, text outside of elements and cut-off
pages are read as far as they go; repeated rows are judged each on its own; pages of any length are read whole.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_of, whole_rows
from .pagemaker import pages as made_pages

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"
                 r"|<[!?][^>]*(?:>|\Z)", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
NAME_WORD = re.compile(r"[a-z]+")
#: HTML elements by their role in cutting a page.
FORMULA = frozenset("math maction merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace "
                    "msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics annotation "
                    "annotation-xml".split())
INLINE = FORMULA | frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small "
                             "span strike strong sub sup time tt u var wbr script style template svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template svg iframe canvas head title textarea select annotation annotation-xml".split())
IN_HEAD = frozenset("base head link meta noscript script style template title".split())
LEAVES_SVG = frozenset("article aside b blockquote body center code dd div dl dt em footer form h1 h2 h3 h4 h5 h6 header hr i "
                       "img li main menu nav ol p pre section small span strong sub sup table u ul var".split())
RAW = frozenset("script style textarea title".split())
RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
                   "h6 header hr main menu nav ol p pre section table ul".split())


class Block:
    """Text of a leaf block, how much of it is linked, and what stands around it."""

    __slots__ = ("text", "linked", "around", "tag", "words")

    def __init__(self, text: str, linked: int, around: frozenset[str], tag: str, words: tuple[str, ...]):
        self.text, self.linked, self.around, self.tag, self.words = text, linked, around, tag, words


class Element:
    """An open element. ``around`` has the features of all block elements down to it; nested elements that add
    nothing share it, so that deep pages stay cheap."""

    __slots__ = ("name", "words", "around", "block")

    def __init__(self, name: str, words: tuple[str, ...], above: Element | None):
        self.name, self.words = name, words
        outer = above.around if above else frozenset()
        if name in INLINE:
            self.around, self.block = outer, above.block if above else None
        else:
            own = {"in " + name, *("class " + w for w in words)}
            self.around, self.block = outer if own <= outer else outer | own, self


class Stack(list):
    """Open elements with their number by name."""

    def __init__(self):
        super().__init__()
        self.open: Counter[str] = Counter()
        self.silent = 0

    def enter(self, name: str, words: tuple[str, ...]) -> None:
        self.append(Element(name, words, self[-1] if self else None))
        self.open[name] += 1
        self.silent += name in SILENT

    def leave(self, depth: int) -> None:
        """Close all elements from ``depth`` on."""
        for element in self[depth:]:
            self.open[element.name] -= 1
            self.silent -= element.name in SILENT
        del self[depth:]

    def close(self, name: str, within: frozenset[str] = frozenset()) -> None:
        """Close the innermost element of a name, unless one of ``within`` stands inside of it."""
        if self.open[name]:
            for depth in range(len(self) - 1, -1, -1):
                if self[depth].name in within:
                    return
                if self[depth].name == name:
                    self.leave(depth)
                    return


ITEMS, HOLDERS = frozenset("li td th tr dt dd option".split()), frozenset("ul ol table dl select menu".split())


def leaf_blocks(page: str) -> list[Block]:
    """Non-empty leaf blocks in page order."""
    stack, out = Stack(), []
    parts: list[tuple[str, bool]] = []
    place: Element | None = None
    at, end = 0, len(page)

    def flush() -> None:
        if parts:
            text = " ".join(references.unescape("".join(p for p, _ in parts)).split())
            if text:
                out.append(Block(text, sum(len(p) for p, linked in parts if linked),
                                 place.around if place else frozenset(), place.name if place else "none",
                                 place.words if place else ()))
            parts.clear()

    def add(text: str) -> None:
        nonlocal place
        if stack.silent and stack[-1].name == "head" and text.strip():
            stack.close("head")
        if text and not stack.silent:
            if not parts:
                place = stack[-1].block if stack else None
            parts.append((text, stack.open["a"] > 0))

    while at < end:
        hit = TAG.search(page, at)
        if hit is None:
            add(page[at:])
            break
        add(page[at:hit.start()])
        at = hit.end()
        name = (hit[2] or hit[5] or "").lower()
        if not name:
            continue
        closing, attrs = bool(hit[1] or hit[4]), hit[3] if hit[2] else hit[6]
        if closing:
            if name not in INLINE and not stack.silent:
                flush()
            stack.close(name)
            if name not in INLINE and not stack.silent:  # the end of a silent part that was left open cuts as well
                flush()
            continue
        if stack.open["head"] and not stack.open["noscript"] and name not in IN_HEAD:  # its end tag may be left out
            stack.close("head")
        if stack.open["svg"] and name in LEAVES_SVG and not stack.open["foreignobject"]:
            stack.close("svg")
        if name not in INLINE:
            if not stack.silent:
                flush()
        elif name in ("br", "wbr", "img"):
            if name == "br":
                add(" ")
            continue
        if name in RAW:  # its text holds no tags
            close = RAW_END[name].search(page, at)
            at = close.end() if close else end
            continue
        if name in VOID:
            continue
        if name in ENDS_P:
            stack.close("p")
        elif name in ITEMS:
            stack.close(name, HOLDERS)
        if attrs and attrs.endswith("/") and (name in FORMULA or name in ("svg", "iframe", "object") or stack.open["svg"]):
            continue
        words = ()
        if attrs and "=" in attrs:
            words = tuple(w for found in NAMES.findall(attrs) for w in NAME_WORD.findall("".join(found).lower()))
        stack.enter(name, words)
    flush()
    return out


def features(blocks: list[Block]) -> list[list[str]]:
    """Feature names of each block."""
    out = []
    n = len(blocks)
    for k, block in enumerate(blocks):
        text, size = block.text, len(block.text)
        names = {"bias"}
        names.add("tag " + block.tag)
        names |= block.around
        names.update("own class " + w for w in block.words)
        words = text.count(" ") + 1
        names.add(f"words {min(6, words.bit_length())}")
        share = block.linked / max(1, size)
        names.add("links " + ("none" if not block.linked else "some" if share < 0.3 else "many" if share < 0.8 else "all"))
        names.add("ends " + ("stop" if text[-1] in ".!?…\"”»" else "other"))
        if "," in text:
            names.add("comma")
        if "©" in text[:40]:
            names.add("copyright")
        if k == 0:
            names.add("first")
        if k == n - 1:
            names.add("last")
        out.append(sorted(names))
    return out


class Crf:
    """Two-state linear-chain CRF: ``weights`` by feature and state, ``pairs`` by state and next state."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, pairs: np.ndarray):
        self.names, self.weights, self.pairs = names, weights, pairs

    def rows(self, blocks: list[Block]) -> list[list[int]]:
        return [[self.names[f] for f in row if f in self.names] for row in features(blocks)]

    def viterbi(self, blocks: list[Block]) -> list[int]:
        """The likeliest states."""
        if not blocks:
            return []
        score = np.array([self.weights[row].sum(axis=0) for row in self.rows(blocks)]).tolist()
        (aa, ab), (ba, bb) = self.pairs.tolist()
        a, b = score[0]
        back = []
        for x, y in score[1:]:
            from_a, from_b = (a + aa >= b + ba), (a + ab >= b + bb)
            back.append((0 if from_a else 1, 0 if from_b else 1))
            a, b = (a + aa if from_a else b + ba) + x, (a + ab if from_b else b + bb) + y
        state = 0 if a >= b else 1
        states = [state]
        for step in reversed(back):
            state = step[state]
            states.append(state)
        return states[::-1]

    def main_text(self, page: str | None) -> str:
        blocks = leaf_blocks(text_of(page))
        return "\n".join(b.text for b, s in zip(blocks, self.viterbi(blocks)) if s)


def _marginals(score: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State marginals and summed pair marginals of one chain (forward-backward, normalised per step)."""
    n = len(score)
    grow = np.exp(score - score.max(axis=1, keepdims=True))
    step = np.exp(pairs)
    ahead, behind = np.empty((n, 2)), np.ones((n, 2))
    ahead[0] = grow[0] / grow[0].sum()
    for k in range(1, n):
        ahead[k] = ahead[k - 1] @ step * grow[k]
        ahead[k] /= ahead[k].sum()
    for k in range(n - 2, -1, -1):
        behind[k] = step @ (grow[k + 1] * behind[k + 1])
        behind[k] /= behind[k].sum()
    state = ahead * behind
    state /= state.sum(axis=1, keepdims=True)
    both = ahead[:-1, :, None] * step[None] * (grow[1:] * behind[1:])[:, None, :]
    both /= both.sum(axis=(1, 2), keepdims=True)
    return state, both.sum(axis=0)


def fit(labelled: list[tuple[str, list[int]]] | None = None, rounds: int = 25, rate: float = 0.3,
        shrink: float = 1e-3) -> Crf:
    """Train on (page, label per leaf block); default: 600 made pages."""
    chains, names = [], {}
    for page, labels in made_pages(600) if labelled is None else labelled:
        blocks = leaf_blocks(page)
        if len(blocks) != len(labels):
            raise ValueError("a labelled page has a label for each leaf block")
        if blocks:
            rows = [[names.setdefault(f, len(names)) for f in row] for row in features(blocks)]
            chains.append((rows, np.array(labels)))
    weights, pairs = np.zeros((len(names), 2)), np.zeros((2, 2))
    seen_w, seen_p = np.full_like(weights, 1e-8), np.full_like(pairs, 1e-8)
    flat = [(np.repeat(np.arange(len(r)), [len(x) for x in r]), np.concatenate(r)) for r, _ in chains]
    for _ in range(rounds):
        for batch in range(0, len(chains), 20):
            grad_w, grad_p = -shrink * weights, -shrink * pairs
            for (row, col), (rows, labels) in zip(flat[batch:batch + 20], chains[batch:batch + 20]):
                score = np.zeros((len(rows), 2))
                np.add.at(score, row, weights[col])
                state, both = _marginals(score, pairs)
                miss = np.eye(2)[labels] - state
                np.add.at(grad_w, col, miss[row])
                np.add.at(grad_p, (labels[:-1], labels[1:]), 1)
                grad_p -= both
            seen_w += grad_w ** 2
            seen_p += grad_p ** 2
            weights += rate * grad_w / np.sqrt(seen_w)
            pairs += rate * grad_p / np.sqrt(seen_p)
    return Crf(names, weights, pairs)


def extract(pages: DataFrame, model: Crf, html_col: str = "html", keep: bool = True) -> DataFrame:
    """``row`` (all columns; without the page if ``keep`` is false) and ``text``, the main text, per row of ``pages``."""
    held = pages if keep else pages.drop(html_col)
    frame = whole_rows(pages, html_col).withColumn("row", F.struct(*[F.col(f"row.`{c}`").alias(c) for c in held.columns]))
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, f"in_{html_col}", 4 << 20):
            texts = [sent.value.main_text(page) for page in batch.column(f"in_{html_col}").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    return frame.mapInArrow(run, f"row {frame.schema['row'].dataType.simpleString()}, text string")

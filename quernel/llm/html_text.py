"""HTML extraction: a bidirectional LSTM in numpy labels every block of a page as main text or not.

A page is read into blocks: runs of text between block-level tags, in page order, with the path of tags
(and their class and id words) above them. A block's inputs are its path's hashed parts, its hashed words
and a few measures; the network reads the whole sequence in both directions, so a block's label depends on
all others. The main text is what is labelled as such. The network is trained on pages that a seeded
generator makes, with known labels, the same way each time; nothing is learnt from the pages at hand.

Comments, scripts, styles and markup are no text. Character references are decoded, white space inside a
block becomes one space, blocks are trimmed and joined by one space. Self-closed svg and math are empty; of an
embedded element without its end only the tag is skipped, but a script or style without one lasts to the page's end.

Input cases: null and empty html give an empty text; html without tags is one block; unclosed and stray tags
are accepted; very long pages are read whole; repeated rows get equal results; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm.bytehash import chunks, hashes, words
from quernel.llm.common import ship, table, text_or_empty

PATH_BUCKETS, WORD_BUCKETS, MEASURES = 1024, 256, 6
INPUT, HIDDEN = 16, 12
PAGES, STEPS, BATCH, SEED = 700, 260, 48, 11
#: Innermost elements that a block's path input has at most.
DEPTH = 32
#: Cells (pages x blocks) that are labelled at once.
CELLS = 1 << 15

_INLINE = frozenset("a abbr b bdi bdo big cite code data dfn em font i ins del kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object")
#: An opening tag of these ends an open element of the same kind (or an open p).
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_ENDS_OWN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BOUNDS = frozenset("table ul ol dl select nav article section div body".split())

_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^<>]*)>", re.S)
_ATTRIBUTE = re.compile(r"""(?i)\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_CLOSE_RAW = {t: re.compile(rf"(?i)</{t}\s*>") for t in _RAW}


def path_part(tag: str, attributes: str) -> tuple[str, ...]:
    """An element's parts for the path: its tag, and the words of its class, id and role."""
    out = [tag]
    for m in _ATTRIBUTE.finditer(attributes):
        out += [f".{w}" for w in re.split(r"[^a-z]+", (m[2] or m[3] or m[4] or "").lower()) if w]
    return tuple(out)


class Element:
    """An open element; its path is its own part and those of the elements above it that aren't inline."""

    __slots__ = ("above", "part", "tag")

    def __init__(self, tag: str, part: tuple[str, ...], above: Element | None):
        self.tag, self.part, self.above = tag, part, above


def path_of(element: Element | None) -> tuple[tuple[str, ...], ...]:
    """The parts of the ``DEPTH`` innermost elements of a path that aren't inline, outermost first."""
    out: list = []
    while element is not None and len(out) < DEPTH:
        out.append(element.part)
        element = element.above
    return tuple(reversed(out))


def blocks(page: str) -> list[tuple[tuple[tuple[str, ...], ...], str, int]]:
    """The blocks of a page: path, text and number of characters inside links. Work is in proportion to the page, however deep it nests."""
    out: list[tuple] = []
    stack: list[tuple[str, Element | None]] = []  # tags, and the innermost element that isn't inline
    open_: dict[str, list[int]] = defaultdict(list)  # the places of each tag in the stack
    texts: list[str] = []
    linked = 0
    endless: set[str] = set()

    def flush():
        nonlocal linked
        if texts:
            text = " ".join("".join(texts).split())
            texts.clear()
            if text:
                out.append((path_of(stack[-1][1] if stack else None), text, min(linked, len(text))))
        linked = 0

    def add(piece: str):
        nonlocal linked
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            texts.append(piece)
            if open_["a"]:
                linked += len(piece.strip())

    def cut_at(k: int):
        while len(stack) > k:
            open_[stack.pop()[0]].pop()

    def last(tags) -> int:
        """The place of the innermost open one of some tags, -1 if there is none."""
        return max((open_[t][-1] for t in tags if open_[t]), default=-1)

    at, size = 0, len(page)
    while at < size:
        m = _MARK.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing = bool(m[1] or m[4])
        if not closing and tag in _CLOSE_RAW:
            if (m[3] or m[6] or "").rstrip().endswith("/"):
                continue
            end = None if tag in endless else _CLOSE_RAW[tag].search(page, at)
            if end:
                at = end.end()
            elif tag in ("script", "style"):
                at = size
            else:  # only the tag is skipped; no later one has an end either
                endless.add(tag)
            continue
        if tag == "br" or tag == "hr":
            flush()
            continue
        if tag in _VOID:
            continue
        inline = tag in _INLINE
        if not inline:
            flush()
        if closing:
            k = last((tag,))
            # An inline element's end doesn't reach beyond the innermost element that isn't inline.
            if k >= 0 and not (inline and stack[-1][1] is not stack[k][1]):
                cut_at(k)
        else:
            if tag in _ENDS_P or tag in _ENDS_OWN:
                k = last(_ENDS_OWN.get(tag, set()) | ({"p"} if tag in _ENDS_P else set()))
                if k >= 0 and k >= last(_BOUNDS):
                    cut_at(k)
            above = stack[-1][1] if stack else None
            open_[tag].append(len(stack))
            stack.append((tag, above if inline else Element(tag, path_part(tag, m[3] or m[6] or ""), above)))
    flush()
    return out


def _bucket(text: str, n: int) -> int:
    return zlib.crc32(text.encode()) % n


@lru_cache(1 << 16)
def path_buckets(path: tuple[tuple[str, ...], ...]) -> tuple[int, ...]:
    """Hashed parts of a path: each part by itself, the last element's parts once more as such, and pairs of neighbours' tags."""
    parts = {w for p in path for w in p} | {f"last:{w}" for p in path[-1:] for w in p} | {f"{a[0]}>{b[0]}" for a, b in zip(path, path[1:], strict=False)}
    return tuple(sorted({_bucket(p, PATH_BUCKETS) for p in parts}))


def page_inputs(found: list, paths: np.ndarray, word: np.ndarray) -> np.ndarray:
    """What the input layer has for each block: sums of path and word weights, and measures."""
    n = len(found)
    out = np.zeros((n, INPUT + MEASURES), np.float32)
    texts = [t for _, t, _ in found]
    counts = np.zeros(n)
    for first, last, data, offsets in chunks(pa.array(texts, pa.large_string())):
        starts, ends, at = words(data, offsets, True)
        w = (hashes(data, starts, ends, True) % np.uint64(WORD_BUCKETS)).astype(np.int64)
        counts[first:last] = np.diff(at)
        if len(w):
            out[first:last, :INPUT] = np.add.reduceat(word[w], at[:-1].clip(max=len(w) - 1)) / np.maximum(1, np.diff(at))[:, None]
    for k, (path, text, linked) in enumerate(found):
        b = path_buckets(path)
        if b:
            out[k, :INPUT] += paths[list(b)].sum(0) / np.sqrt(len(b))
        out[k, INPUT:] = measures(text, linked, int(counts[k]), k, n)
    return out


def measures(text: str, linked: int, n_words: int, k: int, n: int) -> tuple[float, ...]:
    size = max(1, len(text))
    return np.log1p(n_words) / 4, linked / size, (text.count(".") + text.count(",")) / max(1, n_words), float(text[-1:] in ".!?"), (k + 1) / n, np.log1p(n) / 4


class Labeller:
    """Input layer, bidirectional LSTM and a logistic output for each block."""

    def __init__(self, rng: np.random.Generator):
        n = lambda *s: (rng.standard_normal(s) / np.sqrt(s[-2])).astype(np.float32)
        h, d = HIDDEN, INPUT + MEASURES
        self.p = {"paths": n(PATH_BUCKETS, INPUT) * np.float32(8), "words": n(WORD_BUCKETS, INPUT) * np.float32(2), "bi": np.zeros(INPUT, np.float32), "Wx": n(d, 8 * h), "bx": np.zeros(8 * h, np.float32), "U": n(2, h, 4 * h), "w": n(2 * h + d, 1)[:, 0], "b": np.zeros(1, np.float32)}
        self.p["bx"].reshape(2, 4, h)[:, 1] = 1  # remember at first

    def forward(self, raw: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits (page, block) from raw inputs (page, block, ...); mask has which blocks there are."""
        p, h = self.p, HIDDEN
        pages, time, d = raw.shape
        x = np.concatenate([np.tanh(raw[:, :, :INPUT] + p["bi"]), raw[:, :, INPUT:]], 2)
        g = (x.reshape(-1, d) @ p["Wx"] + p["bx"]).reshape(pages, time, 2, 4 * h).transpose(1, 2, 0, 3)
        g = np.stack([g[:, 0], g[::-1, 1]], 1)
        m = mask.T.astype(np.float32)
        m = np.stack([m, m[::-1]], 1)[:, :, :, None]
        s, c = np.zeros((2, pages, h), np.float32), np.zeros((2, pages, h), np.float32)
        hs, kept = np.empty((time, 2, pages, h), np.float32), []
        for t in range(time):
            a = g[t] + s @ p["U"]
            gates = 0.5 * np.tanh(0.5 * a[:, :, : 3 * h]) + 0.5
            i, f, o, new = gates[:, :, :h], gates[:, :, h : 2 * h], gates[:, :, 2 * h :], np.tanh(a[:, :, 3 * h :])
            c1 = f * c + i * new
            tc = np.tanh(c1)
            if keep:
                kept.append((s, c, i, f, o, new, tc))
            s, c = m[t] * (o * tc) + (1 - m[t]) * s, m[t] * c1 + (1 - m[t]) * c
            hs[t] = s
        both = np.concatenate([hs[:, 0].transpose(1, 0, 2), hs[::-1, 1].transpose(1, 0, 2), x], 2)
        logit = both @ p["w"] + p["b"][0]
        return (logit, (raw, x, m, kept, both)) if keep else logit

    def gradients(self, cache, d_logit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters, and of the input layer's sums."""
        p, h = self.p, HIDDEN
        raw, x, m, kept, both = cache
        pages, time, d = x.shape
        out = {"w": np.einsum("pt,ptk->k", d_logit, both), "b": d_logit.sum(keepdims=True).reshape(1)}
        dboth = d_logit[:, :, None] * p["w"]
        dhs = np.stack([dboth[:, :, :h].transpose(1, 0, 2), dboth[:, ::-1, h : 2 * h].transpose(1, 0, 2)], 1)
        dx = dboth[:, :, 2 * h :].copy()
        dg = np.empty((time, 2, pages, 4 * h), np.float32)
        out["U"] = np.zeros_like(p["U"])
        ds, dc = np.zeros((2, pages, h), np.float32), np.zeros((2, pages, h), np.float32)
        for t in range(time - 1, -1, -1):
            s0, c0, i, f, o, new, tc = kept[t]
            ds = ds + dhs[t]
            dh, dcm = m[t] * ds, m[t] * dc
            do = dh * tc * o * (1 - o)
            dc1 = dcm + dh * o * (1 - tc * tc)
            a = np.concatenate([dc1 * new * i * (1 - i), dc1 * c0 * f * (1 - f), do, dc1 * i * (1 - new * new)], 2)
            dg[t] = a
            out["U"] += s0.transpose(0, 2, 1) @ a
            ds = (1 - m[t]) * ds + a @ p["U"].transpose(0, 2, 1)
            dc = (1 - m[t]) * dc + dc1 * f
        dg = np.concatenate([dg[:, 0], dg[::-1, 1]], 2).transpose(1, 0, 2).reshape(-1, 8 * h)
        out["Wx"], out["bx"] = x.reshape(-1, d).T @ dg, dg.sum(0)
        dx += (dg @ p["Wx"].T).reshape(pages, time, d)
        dsum = dx[:, :, :INPUT] * (1 - x[:, :, :INPUT] ** 2)
        out["bi"] = dsum.sum((0, 1))
        return out, dsum

    def label(self, pages: list[list]) -> list[np.ndarray]:
        """For each page's blocks whether they are main text. Pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(len(b), bool) for b in pages]
        order = sorted((k for k, b in enumerate(pages) if b), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            most = len(pages[order[at]])
            to = at
            while to < len(order) and (to == at or (to - at + 1) * len(pages[order[to]]) <= CELLS) and len(pages[order[to]]) <= max(16, 1.3 * most):
                to += 1
            group = order[at:to]
            time = len(pages[group[-1]])
            raw, mask = np.zeros((len(group), time, INPUT + MEASURES), np.float32), np.zeros((len(group), time), bool)
            flat = page_group_inputs([pages[k] for k in group], self.p["paths"], self.p["words"])
            for r, (k, f) in enumerate(zip(group, flat, strict=True)):
                raw[r, : len(f)], mask[r, : len(f)] = f, True
            logit = self.forward(raw, mask)
            for r, k in enumerate(group):
                out[k] = logit[r, : len(pages[k])] > 0
            at = to
        return out


def page_group_inputs(group: list[list], paths: np.ndarray, word: np.ndarray) -> list[np.ndarray]:
    return [page_inputs(b, paths, word) for b in group]


#: What the training pages are made of: (class words, tag) of containers of either kind.
_MAIN = [("article", ""), ("article", "post"), ("main", ""), ("main", "content"), ("div", "content"), ("div", "post-body"), ("div", "entry-content"), ("div", "article-text"), ("section", "story"), ("div", "main-text"), ("div", ""), ("section", "")]
_NOT_MAIN = {
    "before": [("nav", ""), ("nav", "menu"), ("header", ""), ("header", "site-header"), ("div", "header"), ("div", "menu"), ("ul", "navigation"), ("div", "breadcrumbs"), ("div", "topbar"), ("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "banner"), ("div", "cookie-notice"), ("div", "notice"), ("div", "alert"), ("div", "consent"), ("form", "search"), ("form", ""), ("div", "promo"), ("div", "sponsored"), ("aside", "notice"), ("div", "advertisement"), ("div", "cookie"), ("div", "skip-link"), ("div", "popup")],
    "after": [("footer", ""), ("footer", "site-footer"), ("div", "footer"), ("aside", ""), ("aside", "sidebar"), ("div", "sidebar"), ("div", "side"), ("div", "related"), ("div", "share"), ("div", "social"), ("section", "comments"), ("div", "comments"), ("div", "comment-list"), ("ol", "comments"), ("div", "comment"), ("form", "newsletter"), ("form", "login"), ("form", "subscribe"), ("div", "ad"), ("div", "advert"), ("div", "promo"), ("div", "legal"), ("div", "copyright"), ("div", "tags"), ("div", "widget"), ("form", "comment-form"), ("div", "reader-comments"), ("div", "disqus")],
}
_INSIDE = [("div", "ad"), ("aside", ""), ("div", "share"), ("form", "subscribe"), ("div", "related"), ("aside", "promo"), ("div", "advert"), ("div", "notice"), ("nav", "toc")]


def made_page(rng: np.random.Generator) -> tuple[str, list[bool]]:
    """A page and the labels of its blocks. Texts are made of random letters; marks of kind are in structure and measure."""
    label: list[bool] = []
    syllables = ["".join(rng.choice(list("abcdefghiklmnoprstuvwzäéñ"), rng.integers(1, 4))) for _ in range(30)]

    def text(lo: int, hi: int) -> str:
        n = int(rng.integers(lo, hi + 1))
        w = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(n)]
        if rng.random() < 0.15:
            w = [x + str(rng.choice(["&amp;&amp;&amp;", "***", "###", "%%%"])) for x in w]
        elif rng.random() < 0.15:
            w = [x.upper() + "!!" for x in w]
        for k in range(0, n, int(rng.integers(5, 15))):
            w[k] = w[k].capitalize() + str(rng.choice(["", ",", "."]))
        return " ".join(w) + str(rng.choice(["", ".", "."]))

    def put(tag: str, inner: str, kind: bool, attributes: str = "") -> str:
        label.append(kind)
        end = "" if tag in ("p", "li") and rng.random() < 0.2 else f"</{tag}>"
        return f"<{tag}{attributes}>{inner}{end}"

    def attributes(words_: str) -> str:
        if not words_:
            return ""
        return f' {"id" if rng.random() < 0.3 else "class"}="{words_}{rng.choice(["", "", " box", " wide", "-inner"])}"'

    def other(tag: str, words_: str) -> str:
        out = [f"<{tag}{attributes(words_)}>"]
        shape = rng.random()
        if tag in ("ul", "ol") or tag == "nav" or shape < 0.35:
            own = tag in ("ul", "ol")
            out.append("" if own else "<ul>")
            for _ in range(int(rng.integers(2, 8))):
                long = "comment" in words_
                inner = text(3, 40) if long else text(1, 3)
                out.append(put("li", inner if long else f'<a href="/{len(label)}">{inner}</a>', False))
            out.append("" if own else "</ul>")
        elif tag == "form" or shape < 0.45:
            out.append(put("label" if rng.random() < 0 else "div", text(1, 4), False))
            out.append('<input name="q">')
            out.append(put("button", text(1, 2), False))
        elif shape < 0.7:
            out.append(text(2, 25))
            label.append(False)
        else:
            if rng.random() < 0.4:
                out.append(put(f"h{rng.integers(2, 5)}", text(1, 4), False))
            for _ in range(int(rng.integers(1, 5))):
                out.append(put("p", text(2, 60 if "comment" in words_ else 25), False))
        out.append(f"</{tag}>")
        return "".join(out)

    out = ['<!DOCTYPE html><html><head><meta charset="utf-8">']
    out.append(put("title", text(2, 10), False) if rng.random() < 0.9 else "")
    out.append("<style>p{margin:0}</style><script>var t='</p>';</script></head><body>")
    wrap = rng.random() < 0.3
    out.append('<div class="page">' if wrap else "")
    pick = lambda pool: pool[int(rng.integers(len(pool)))]
    for _ in range(int(rng.integers(0, 5))):
        out.append(other(*pick(_NOT_MAIN["before"])))
    tag, words_ = pick(_MAIN) if rng.random() < 0.6 else ("article", "")
    bare = rng.random() < 0.08
    out.append("" if bare else f"<{tag}{attributes(words_)}>")
    header = rng.random() < 0.2
    if rng.random() < 0.85:
        out.append(("<header>" if header else "") + put("h1", text(2, 10), True) + ("</header>" if header else ""))
    for _ in range(int(rng.choice([1, 2, 4, 7, 12, 25]))):
        kind = rng.random()
        if kind < 0.72:
            inner = text(1, int(rng.choice([3, 20, 60, 120])))
            label.append(True)
            if rng.random() < 0.15:
                inner = f"<b>{inner}" if rng.random() < 0.5 else f"<b>{inner}</b>"
                if rng.random() < 0.4:
                    inner += "<br>" + text(1, 10)
                    label.append(True)
            elif rng.random() < 0.15:
                inner += f' <a href="/{len(label)}">{text(1, 4)}</a> ' + text(1, 9)
            out.append(f"<p>{inner}" + ("</p>" if rng.random() < 0.9 else ""))
        elif kind < 0.8:
            out.append(put(f"h{rng.integers(2, 4)}", text(1, 6), True))
        elif kind < 0.87:
            t = str(rng.choice(["ul", "ol"]))
            out.append(f"<{t}>" + "".join(put("li", text(1, 20), True) for _ in range(int(rng.integers(1, 6)))) + f"</{t}>")
        elif kind < 0.9:
            out.append("<blockquote>" + put("p", text(3, 40), True) + "</blockquote>")
        elif kind < 0.92:
            out.append("<table><tr>" + put("td", text(1, 5), True) + put("td", text(1, 5), True) + "</tr></table>")
        elif kind < 0.94:
            out.append(put("pre", text(3, 20), True))
        elif kind < 0.96:
            out.append("<figure>" + put("figcaption", text(2, 12), True) + "</figure>")
        else:
            out.append(other(*pick(_INSIDE)))
    out.append("" if bare else f"</{tag}>")
    for _ in range(int(rng.integers(0, 5))):
        out.append(other(*pick(_NOT_MAIN["after"])))
    if rng.random() < 0.5:
        out.append(f"<footer>&copy; {text(2, 12)}</footer>")
        label.append(False)
    return "".join(out) + ("</div>" if wrap else "") + "</body></html>", label


@lru_cache(1)
def trained() -> Labeller:
    """The labeller, trained on made pages; the same each time."""
    rng = np.random.default_rng(SEED)
    data = []
    while len(data) < PAGES:
        page, label = made_page(rng)
        found = blocks(page)
        if len(found) == len(label) and found:
            data.append((found, np.array(label, np.float32)))
    data.sort(key=lambda d: len(d[0]))
    net = Labeller(rng)
    prepared = []
    for found, label in data:
        path = [np.array(path_buckets(b[0]), np.int64) for b in found]
        zero = np.zeros((PATH_BUCKETS, INPUT), np.float32)
        m = page_inputs(found, zero, zero[:WORD_BUCKETS])[:, INPUT:]
        word = []
        for first, last, raw, offsets in chunks(pa.array([b[1] for b in found], pa.large_string())):
            starts, ends, at = words(raw, offsets, True)
            w = (hashes(raw, starts, ends, True) % np.uint64(WORD_BUCKETS)).astype(np.int64)
            word += [w[at[k] : at[k + 1]] for k in range(last - first)]
        prepared.append((path, word, m, label))
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    for step in range(1, STEPS + 1):
        start = int(rng.integers(0, max(1, len(prepared) - BATCH)))
        batch = prepared[start : start + BATCH]
        time = max(len(b[3]) for b in batch)
        raw, mask, want = np.zeros((len(batch), time, INPUT + MEASURES), np.float32), np.zeros((len(batch), time), bool), np.zeros((len(batch), time), np.float32)
        for r, (path, word, m, label) in enumerate(batch):
            n = len(label)
            mask[r, :n], want[r, :n], raw[r, :n, INPUT:] = True, label, m
            for k in range(n):
                if len(path[k]):
                    raw[r, k, :INPUT] = net.p["paths"][path[k]].sum(0) / np.sqrt(len(path[k]))
                if len(word[k]):
                    raw[r, k, :INPUT] += net.p["words"][word[k]].mean(0)
        logit, cache = net.forward(raw, mask, keep=True)
        d = np.where(mask, 0.5 * np.tanh(0.5 * logit) + 0.5 - want, 0).astype(np.float32) / mask.sum()
        grads, dsum = net.gradients(cache, d)
        grads["paths"], grads["words"] = np.zeros_like(net.p["paths"]), np.zeros_like(net.p["words"])
        for r, (path, word, _, label) in enumerate(batch):
            for k in range(len(label)):
                if len(path[k]):
                    grads["paths"][path[k]] += dsum[r, k] / np.sqrt(len(path[k]))
                if len(word[k]):
                    np.add.at(grads["words"], word[k], dsum[r, k] / len(word[k]))
        rate = 0.02 * min(1.0, step / 15) * (0.2 if step > 0.8 * STEPS else 1.0)
        for k, g in grads.items():
            m1, m2 = moments[k]
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            net.p[k] = (net.p[k] - rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def extract(pages: list[str], net: Labeller) -> list[str]:
    """The main texts of pages."""
    found = [blocks(p) for p in pages]
    return [" ".join(b[1] for b, ok in zip(f, keep, strict=True) if ok) for f, keep in zip(found, net.label(found), strict=True)]


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page. Narrow."""
    ship(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts = extract(text_or_empty(part.column(2).to_pylist()), sent.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))

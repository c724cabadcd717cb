"""Main text of web pages: a recurrent network labels the leaf blocks of each page in context."""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import span_hashes, table, utf8, words

#: The network is fitted on about so many pages at most, drawn by a hash of their ids.
SAMPLE_PAGES = 160
EPOCHS = 24
#: Made pages for each page of the sample.
VARIANTS = 3
PATH_BUCKETS, WORD_BUCKETS = 8192, 2048
#: Training pages that must have a tag or name for it to have a vector of its own; all others have the zero vector.
LEAST_PAGES = 8
PATH_DIM, WORD_DIM, HIDDEN = 16, 8, 16
#: Bytes of HTML and pages that one pass holds.
SLICE_BYTES = 4_000_000
BATCH_PAGES = 256

#: Elements without text, up to their end tag; svg and object may end in themselves.
_DROPPED = r"<(?:svg|object)(?=[\s/])(?:[^>\"']|\"[^\"]*\"|'[^']*')*/>|<(script|style|noscript|template|svg|iframe|object|textarea|select)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|{_DROPPED}|</?([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
_NAME = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[a-z]+")
_BLOCKS = frozenset("html head title body main article section header footer nav aside form fieldset div p ul ol li dl dt dd h1 h2 h3 h4 h5 h6 table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary hr center".split())
_VOID = frozenset(("hr",))
#: A tag that opens closes open ones of these kinds above it.
_CLOSES = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), **{t: ("p",) for t in ("div", "ul", "ol", "section", "article", "header", "footer", "nav", "aside", "form", "table", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "main", "figure")}}
#: Stands before each run of main text in training pages; parsed pages have none.
MARK = "\ue000"
#: Elements that frame a page and are not its text, wherever they stand.
_FRAME = frozenset("head nav aside footer form".split())
#: Words of names that say of an element inside an article that readers wrote it; for labels only.
_READERS = frozenset("comment comments commentlist replies disqus".split())


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int = 0


@dataclass
class _Open:
    tag: str
    names: tuple[str, ...] = field(default=())


def leaf_blocks(page: str) -> list[Block]:
    """The runs of text between block-level tags, in page order, with the open tags and their class, id and role words.

    Comments, scripts, styles and form controls have no text. Character references are decoded, white space becomes one space.
    """
    out: list[Block] = []
    stack: list[_Open] = []
    held: list[str] = []
    linked = anchors = 0

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", entities.unescape("".join(held))).strip()
        if text:
            out.append(Block(tuple(x for o in stack for x in (o.tag, *o.names)), text, linked))
        held.clear()
        linked = 0

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            held.append(page[at : m.start()])
            if anchors:
                linked += m.start() - at
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        closing = page[m.start() + 1] == "/"
        if tag == "br":
            held.append(" ")
        elif tag == "a":
            anchors = 0 if closing else 1
        if tag not in _BLOCKS:
            continue
        flush()
        anchors = 0
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
        elif tag not in _VOID:
            if stops := _CLOSES.get(tag):
                while stack and stack[-1].tag in stops:
                    stack.pop()
            stack.append(_Open(tag, tuple(f"{tag}.{w}" for a in _NAME.findall(m[3]) for x in a for w in _PART.findall(x.lower())) if m[3] else ()))
    if at < len(page):
        held.append(page[at:])
    flush()
    return out


def marked(part: str) -> str:
    """A part of a page with MARK before each run of its text."""
    return re.sub(r">(?=[^<]*[^<\s])", f">{MARK}", re.sub(r"^(?=[^<]*[^<\s])", MARK, part))


def labelled(page: str) -> tuple[list[Block], np.ndarray]:
    """The blocks of a page with marks, without these, and which of them are main text: those with a mark, but for those in elements that frame a page or that name themselves as readers' comments."""
    blocks = leaf_blocks(page)
    label = np.array([MARK in b.text and not _FRAME.intersection(b.path) and not any(x.partition(".")[2] in _READERS for x in b.path) for b in blocks], float)
    for b in blocks:
        b.text = _SPACE.sub(" ", b.text.replace(MARK, "")).strip()
    return [b for b in blocks if b.text], label[[bool(b.text) for b in blocks]]


def article_of(page: str) -> tuple[int, int] | None:
    """Where the one article element of a page (or, without, its one main element) has its content; None if there is no such element or several."""
    for tag in ("article", "main"):
        opened, closed = re.findall(rf"<{tag}(?=[\s>])", page, re.I), list(re.finditer(rf"</{tag}\s*>", page, re.I))
        if len(opened) == len(closed) == 1:
            start = re.search(rf"<{tag}(?=[\s>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>", page, re.I)
            if start and start.end() <= closed[0].start():
                return start.end(), closed[0].start()
    return None


def made_page(article: str, bag: list[str], rng: np.random.Generator) -> str:
    """A page around the content of an article, with marks in the article only: templates with telling, with meaningless and without names, and other blocks around and inside, readers' comments among them."""
    nameless = rng.random() < 0.15

    def some(low: int, high: int) -> str:
        return " ".join(rng.choice(bag, int(rng.integers(low, high))))

    def pick(choices: list):
        return choices[int(rng.integers(len(choices)))]

    def name(*words: str) -> str:
        if nameless:
            return ""
        word = pick(list(words)) if rng.random() < 0.55 else "".join(rng.choice(list("abcdefghijklmnoprstuvwxyz"), int(rng.integers(1, 8))))
        return f' {pick(["class", "class", "id"])}="{word}"'

    def links(low: int, high: int) -> str:
        kind = pick(["ul", "ul", "p", "div"])
        all_ = [f'<a href="/{k}">{some(1, 4)}</a>' for k in range(int(rng.integers(low, high)))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in all_) + "</ul>" if kind == "ul" else f"<{kind}>" + pick([" | ", " ", " · "]).join(all_) + f"</{kind}>"

    def box(tag: str, names: tuple[str, ...], inner: str) -> str:
        return f"<{tag}{name(*names) if names else ''}>{inner}</{tag}>"

    kinds = {
        "menu": lambda: pick([box("nav", (), links(3, 9)), box("div", ("menu", "navbar", "nav-links", "topnav"), links(3, 9)), links(4, 9)]),
        "header": lambda: box(pick(["header", "div"]), ("site-header", "masthead", "top"), pick([f"<p>{some(1, 6)}</p>", f"<h2>{some(1, 4)}</h2><p>{some(2, 8)}</p>", some(1, 5)])),
        "notice": lambda: box("div", ("cookie-notice", "consent", "alert", "banner", "gdpr"), f"<p>{some(5, 30)}</p>" + pick(["", f"<button>{some(1, 3)}</button>"])),
        "advert": lambda: box(pick(["div", "aside"]), ("ad", "advert", "sponsored", "promo", "banner-ad"), pick([some(3, 20), f"<p>{some(3, 20)}</p>", f'<a href="/x">{some(2, 9)}</a>'])),
        "side": lambda: box(pick(["aside", "div"]), ("sidebar", "widget", "secondary", "related"), f"<h3>{some(1, 4)}</h3>" + pick([links(2, 8), f"<p>{some(4, 30)}</p>"])),
        "form": lambda: box("form", (), f"<p>{some(2, 12)}</p><label>{some(1, 3)}</label><input name=q>"),
        "crumbs": lambda: box("div", ("breadcrumb", "path"), " &gt; ".join(f'<a href="/{k}">{some(1, 3)}</a>' for k in range(3))),
        "share": lambda: box("div", ("share", "social", "tags", "byline"), links(2, 5)),
        "comments": lambda: box(pick(["section", "div", "ol"]), ("comments", "comment-list", "discussion", "replies", "responses"), f"<h3>{some(1, 4)}</h3>" + "".join(box(pick(["div", "li"]), ("comment", "reply", "message"), f"<p><b>{some(1, 3)}</b> {some(1, 3)}</p><p>{some(4, 80)}</p>") for _ in range(int(rng.integers(1, 6))))),
        "footer": lambda: box(pick(["footer", "div"]), ("footer", "site-footer", "colophon", "legal"), pick([f"&copy; {some(2, 12)}", f"<p>&copy; {some(1, 5)} &middot; {some(2, 20)}</p>", links(2, 6) + f"<p>{some(3, 15)}</p>"])),
    }
    draw = lambda kind, share: kinds[kind]() if rng.random() < share else ""
    if rng.random() < 0.15:  # paragraphs that are no p elements
        own = name("text", "para", "block")
        article = re.sub(r"<p(?=[\s>])[^>]*>", f"<div{own}>", article).replace("</p>", "</div>")
    parts = re.split(r"(?=<(?:p|div)[\s>])", article)
    for k in range(1, len(parts)):
        turn = rng.random()
        if parts[k].startswith("<div"):
            turn = 0.5
        if turn > 0.9:  # a short one
            parts[k] = re.sub(r"^(<p[^>]*>)\s*((?:[^\s<]+\s+){1,3})[^<]*(?=</p>)", lambda m: m[1] + m[2].strip(), parts[k])
        elif turn < 0.06:
            parts[k] = re.sub(r"^<p[^>]*>", "<h2>", parts[k]).replace("</p>", "</h2>")
        elif turn < 0.12:
            parts[k] = "<ul><li>" + re.sub(r"^<p[^>]*>", "", parts[k]).replace("</p>", "</li></ul>")
        elif turn < 0.16:
            parts[k] = "<blockquote>" + parts[k] + "</blockquote>"
        parts[k] = marked(parts[k])
        if rng.random() < 0.04:
            parts[k] += kinds[pick(["advert", "share", "side"])]()
    body = marked(parts[0]) + "".join(parts[1:])
    shell = pick(["article", "main", "div", "div", "div", "section", "td", ""])
    body += draw("comments", 0.5)
    inner = body if not shell else f"<{shell}{name('post-content', 'content', 'story', 'entry', 'article-body', 'main-text', 'post') if shell != 'td' else ''}>{body}</{shell}>"
    above = draw("header", 0.4) + draw("menu", 0.8) + draw("notice", 0.25) + draw("crumbs", 0.2) + draw("advert", 0.4) + draw("side", 0.15)
    below = draw("share", 0.3) + draw("form", 0.2) + draw("comments", 0.45) + draw("side", 0.35) + draw("advert", 0.2) + draw("notice", 0.1) + draw("footer", 0.8)
    if shell == "td":
        inner, below = f"<table><tr><td>{links(2, 8)}</td>{inner}</tr></table>", below
    elif rng.random() < 0.4:
        inner = f"<div{name('wrapper', 'container', 'page', 'layout')}>{draw('side', 0.1)}{inner}{draw('side', 0.5)}</div>"
    return f"<html><head><title>{some(2, 9)}</title></head><body{name('home', 'page', 'single') if rng.random() < 0.3 else ''}>{above}{inner}{below}</body></html>"


def training_pages(page: str, seed: int) -> list[str]:
    """A page with marks in its article, and made pages around that article; none if the page does not say where its article is."""
    place = article_of(page)
    if place is None:
        return []
    start, end = place
    rng = np.random.default_rng(seed)
    bag = [w for b in leaf_blocks(page) for w in b.text.split()][:600] or ["text"]
    bag = [entities.escape(w) for w in bag]
    return [page[:start] + marked(page[start:end]) + page[end:], *(made_page(page[start:end], bag, rng) for _ in range(VARIANTS))]


@dataclass
class Network:
    values: dict[str, np.ndarray]


def _new(rng: np.random.Generator) -> dict[str, np.ndarray]:
    width = PATH_DIM + WORD_DIM + 3
    out = {"path": rng.normal(0, 0.3, (PATH_BUCKETS, PATH_DIM)), "word": rng.normal(0, 0.1, (WORD_BUCKETS, WORD_DIM)), "out": rng.normal(0, 0.3, 2 * HIDDEN + width), "bias": np.zeros(1)}
    for d in "fb":
        out[f"w{d}"] = rng.normal(0, 0.2, (width + HIDDEN, 4 * HIDDEN))
        out[f"g{d}"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)
    return out


_PATHS: dict[tuple[str, ...], np.ndarray] = {}


def _path_ids(path: tuple[str, ...]) -> np.ndarray:
    if path not in _PATHS:
        if len(_PATHS) > 50_000:
            _PATHS.clear()
        _PATHS[path] = np.array([zlib.crc32(x.encode()) % PATH_BUCKETS for x in dict.fromkeys(path)] or [0], np.int64)
    return _PATHS[path]


@dataclass
class Features:
    path: np.ndarray
    path_at: np.ndarray
    word: np.ndarray
    word_at: np.ndarray
    plain: np.ndarray


def features(blocks: list[Block]) -> Features:
    paths = [_path_ids(b.path) for b in blocks]
    raw, offsets = utf8(pa.array([b.text for b in blocks], pa.large_string()))
    starts, ends, bounds = words(raw, offsets)
    hashed = (span_hashes(raw, starts, ends, lower=True) >> np.uint64(40)).astype(np.int64) % WORD_BUCKETS
    lengths = np.diff(offsets)
    links = np.array([b.linked for b in blocks], float) / np.maximum(lengths, 1)
    plain = np.stack([np.log1p(lengths) / 5 - 0.8, np.minimum(links, 1), np.log1p(np.diff(bounds)) / 4 - 0.6], axis=1)
    return Features(np.concatenate(paths), np.concatenate([[0], np.cumsum([len(p) for p in paths])]), hashed, bounds, plain)


def _mean(table_: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.vstack([np.zeros((1, table_.shape[1])), np.cumsum(table_[ids], axis=0)])
    return (sums[at[1:]] - sums[at[:-1]]) / np.maximum(np.diff(at), 1)[:, None]


def _inputs(values: dict[str, np.ndarray], f: Features) -> np.ndarray:
    return np.hstack([_mean(values["path"], f.path, f.path_at) * 2, _mean(values["word"], f.word, f.word_at), f.plain])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _pass(w: np.ndarray, g: np.ndarray, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
    """One direction over x[step, page, feature]; steps beyond a page's end leave its state as it is."""
    h, c = np.zeros((x.shape[1], HIDDEN)), np.zeros((x.shape[1], HIDDEN))
    out, tape = np.zeros((*x.shape[:2], HIDDEN)), []
    for t in range(len(x)):
        joined = np.hstack([x[t], h])
        z = joined @ w + g
        i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        u = np.tanh(z[:, 3 * HIDDEN :])
        c2 = f * c + i * u
        s = np.tanh(c2)
        m = mask[t][:, None]
        tape.append((joined, i, f, o, u, c, s, m))
        c, h = np.where(m, c2, c), np.where(m, o * s, h)
        out[t] = h
    return out, tape


def _back(w: np.ndarray, tape: list, grad: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    dw, dg, dx = np.zeros_like(w), np.zeros(w.shape[1]), np.zeros((len(tape), grad.shape[1], dim))
    dh, dc = np.zeros(grad.shape[1:]), np.zeros(grad.shape[1:])
    for t in range(len(tape) - 1, -1, -1):
        joined, i, f, o, u, c, s, m = tape[t]
        dh = dh + grad[t]
        live = np.where(m, dh, 0)
        dc2 = np.where(m, dc, 0) + live * o * (1 - s * s)
        dz = np.hstack([dc2 * u * i * (1 - i), dc2 * c * f * (1 - f), live * s * o * (1 - o), dc2 * i * (1 - u * u)])
        dw += joined.T @ dz
        dg += dz.sum(axis=0)
        dj = dz @ w.T
        dx[t] = dj[:, :dim]
        dh = np.where(m, 0, dh) + dj[:, dim:]
        dc = np.where(m, 0, dc) + dc2 * f
    return dw, dg, dx


def _padded(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of pages one after the other as [step, page, feature], the mask, and each row's step."""
    page = np.repeat(np.arange(len(counts)), counts)
    step = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    x = np.zeros((int(counts.max()), len(counts), rows.shape[1]))
    x[step, page] = rows
    return x, np.arange(len(x))[:, None] < counts[None, :], step


def probabilities(network: Network, f: Features, counts: np.ndarray) -> np.ndarray:
    """Of each block: that it belongs to the main text. `counts`: the blocks of each page."""
    v = network.values
    rows = _inputs(v, f)
    x, mask, step = _padded(rows, counts)
    page = np.repeat(np.arange(len(counts)), counts)
    ahead, _ = _pass(v["wf"], v["gf"], x, mask)
    back, _ = _pass(v["wb"], v["gb"], x[::-1], mask[::-1])
    return _sigmoid(np.hstack([ahead[step, page], back[::-1][step, page], rows]) @ v["out"] + v["bias"][0])


def fit(pages: list[str], seed: int = 7) -> Network:
    """Train on the blocks of pages that say where their article is, and of pages made around these articles, by Adam on the whole binary cross-entropy."""
    rng = np.random.default_rng(seed)
    v = _new(rng)
    sequences = [x for k, p in enumerate(pages) for q in training_pages(p, k) if (x := labelled(q))[0]]
    if not sequences:
        return Network(v)
    first, second = ({k: np.zeros_like(x) for k, x in v.items()} for _ in range(2))
    turn = 0
    pages_with = np.zeros(PATH_BUCKETS, np.int64)
    for blocks, _ in sequences:
        pages_with[np.unique(np.concatenate([_path_ids(b.path) for b in blocks]))] += 1
    known = (pages_with >= LEAST_PAGES)[:, None]
    v["path"] *= known
    prepared = []
    order = sorted(range(len(sequences)), key=lambda k: len(sequences[k][0]))
    for at in range(0, len(order), 48):
        part = [sequences[k] for k in order[at : at + 48]]
        prepared.append((features([b for s, _ in part for b in s]), np.array([len(s) for s, _ in part]), np.concatenate([y for _, y in part])))
    width = PATH_DIM + WORD_DIM + 3
    for _ in range(EPOCHS):
        for k in rng.permutation(len(prepared)):
            f, counts, label = prepared[k]
            rows = _inputs(v, f)
            x, mask, step = _padded(rows, counts)
            page = np.repeat(np.arange(len(counts)), counts)
            ahead, tape_f = _pass(v["wf"], v["gf"], x, mask)
            back, tape_b = _pass(v["wb"], v["gb"], x[::-1], mask[::-1])
            joined = np.hstack([ahead[step, page], back[::-1][step, page], rows])
            error = (_sigmoid(joined @ v["out"] + v["bias"][0]) - label) / len(label)
            d = error[:, None] * v["out"]
            grads = {"out": joined.T @ error, "bias": np.array([error.sum()])}
            gf, gb = np.zeros_like(ahead), np.zeros_like(back)
            gf[step, page], gb[step, page] = d[:, :HIDDEN], d[:, HIDDEN : 2 * HIDDEN]
            grads["wf"], grads["gf"], dx = _back(v["wf"], tape_f, gf, width)
            grads["wb"], grads["gb"], dxb = _back(v["wb"], tape_b, gb[::-1], width)
            drows = d[:, 2 * HIDDEN :] + (dx + dxb[::-1])[step, page]
            grads["path"], grads["word"] = np.zeros_like(v["path"]), np.zeros_like(v["word"])
            for name, ids, place, cut, gain in (("path", f.path, f.path_at, slice(0, PATH_DIM), 2.0), ("word", f.word, f.word_at, slice(PATH_DIM, PATH_DIM + WORD_DIM), 1.0)):
                n = np.diff(place)
                np.add.at(grads[name], ids, np.repeat(drows[:, cut] * gain / np.maximum(n, 1)[:, None], n, axis=0))
            grads["path"] *= known
            turn += 1
            for name, g in grads.items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.99 * second[name] + 0.01 * g * g
                v[name] -= 0.02 * (first[name] / (1 - 0.9**turn)) / (np.sqrt(second[name] / (1 - 0.99**turn)) + 1e-8)
    return Network({k: x.astype(np.float32) for k, x in v.items()})


def train(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Network:
    """Fit on about `sample_pages` pages at most, drawn by a hash of page_id and url."""
    n = pages.count()
    share = F.pmod(F.xxhash64("page_id", "url"), F.lit(1_000_000)) / 1_000_000
    rows = pages.where("html is not null").where(share < min(1.0, sample_pages / max(n, 1))).select("page_id", "html").orderBy("page_id", "html").collect()
    return fit([r["html"] for r in rows])


def main_text(network: Network, pages: list[str | None]) -> list[str]:
    """The main text of each page: the blocks that the network takes for it, joined by line feeds; null or empty pages give an empty text."""
    parsed = [leaf_blocks(p) if p else [] for p in pages]
    out = [""] * len(pages)
    order = sorted((k for k in range(len(pages)) if parsed[k]), key=lambda k: len(parsed[k]))
    for at in range(0, len(order), BATCH_PAGES):
        part = order[at : at + BATCH_PAGES]
        flat = [b for k in part for b in parsed[k]]
        counts = np.array([len(parsed[k]) for k in part])
        keep = probabilities(network, features(flat), counts) >= 0.5
        begin = 0
        for k, n in zip(part, counts, strict=True):
            out[k] = "\n".join(flat[j].text for j in range(begin, begin + n) if keep[j])
            begin += n
    return out


def extract(pages: DataFrame, network: Network) -> DataFrame:
    """Rows (page_id, url, text, n_chars), one for each row of `pages`; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            sizes = np.cumsum([len(x) if x else 0 for x in batch.column("html").to_pylist()]) if batch.num_rows else []
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES, "right")))
                part = batch.slice(at, to - at)
                texts = main_text(network, part.column("html").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
                at = to

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all `pages`."""
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(pages))

"""Main text of web pages by a recurrent block labeller, written in numpy.

A page is cut into its leaf blocks in page order. Each block is a vector: the tags, classes and ids on its path,
hashed; its words, hashed; and a few densities. A bidirectional LSTM reads the whole sequence and labels every
block from all of it. Training uses a bounded sample of the given pages, and pages composed of their blocks in other
layouts; labels come from what the layout itself says (``teacher``), by backpropagation through time.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import narrow, register, table
from arbora.llm.shingles import word_hashes

PATH_DIMS = 128
WORD_DIMS = 32
EXTRA = 4
HIDDEN = 16
#: The sample that training may see, in pages, and of each page so many blocks.
SAMPLE_PAGES = 240
SAMPLE_BLOCKS = 160
STEPS = 600
BATCH = 24
LANES = 64

# Elements that start a block, whose text is not shown, or that have no end.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select"
    " summary table tbody td tfoot th thead tr ul".split())
HIDDEN_ELEMENTS = "script|style|noscript|template|title|textarea|svg|iframe|object|canvas"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Opening the key ends an open element of the values.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({HIDDEN_ELEMENTS})\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|[^<]++|<", re.S | re.I)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z0-9]+")
_BLANK = re.compile(r"[\x20\x09-\x0D]+")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    linked: int


def _marks(tag: str, attributes: str) -> tuple[str, ...]:
    out = [tag]
    if attributes:
        for _, a, b, c in _NAMES.findall(attributes):
            out += ["." + part for part in _PART.findall((a or b or c).lower())]
    return tuple(out)


def leaf_blocks(page: str) -> list[Block]:
    """The page's blocks with text, in order. White space inside a block is one space; entities are decoded."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = 0
    links = 0

    def close():
        nonlocal linked
        if parts:
            text = _BLANK.sub(" ", "".join(parts)).strip(" ")
            if text:
                out.append(Block(text, tuple(m for _, marks in stack for m in marks), linked))
            parts.clear()
        linked = 0

    def pop_to(i: int):
        nonlocal links
        links -= sum(tag == "a" for tag, _ in stack[i:])
        del stack[i:]

    for token in _TOKEN.finditer(page):
        word = token.group()
        if word[0] != "<" or word == "<":
            text = html.unescape(word)
            parts.append(text)
            linked += len(text) if links else 0
            continue
        if token.group(1):
            continue
        end, name, attributes = token.group(2, 3, 4) if token.group(3) else token.group(5, 6, 7)
        if not name:
            continue
        tag = name.lower()
        if end:
            if tag in BLOCKS:
                close()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop_to(i)
                    break
                if tag not in BLOCKS and stack[i][0] in BLOCKS:
                    break
            continue
        if tag == "br":
            parts.append(" ")
        if tag in BLOCKS:
            close()
            for i in range(len(stack) - 1, -1, -1):
                open_tag = stack[i][0]
                if open_tag == "p" or open_tag in ENDS.get(tag, ()):
                    pop_to(i)
                    break
                if open_tag in BLOCKS:
                    break
        if tag not in VOID and not attributes.endswith("/"):
            stack.append((tag, _marks(tag, attributes)))
            links += tag == "a"
    close()
    return out


# What a layout calls its main part, and what it calls the rest.
MAIN = frozenset("article main .article .main .content .post .entry .story .body .text".split())
REST = frozenset(
    "nav aside footer header form menu button dialog select .nav .navbar .navigation .menu .sidebar .side .footer .header"
    " .ad .ads .advert .advertisement .sponsored .promo .banner .cookie .cookies .consent .notice .alert .popup .modal"
    " .comment .comments .reply .replies .discussion .respond .share .social .related .recommended .newsletter .subscribe"
    " .signup .login .search .breadcrumb .breadcrumbs .pagination .widget .toolbar .skip .copyright .meta .tags".split())


def teacher(path: tuple[str, ...]) -> int:
    """1 if the layout says that a block on this path belongs to the main text."""
    return int(any(m in MAIN for m in path) and not any(m in REST for m in path))


def _vectors(blocks: list[Block], cache: dict) -> np.ndarray:
    n = len(blocks)
    out = np.zeros((n, PATH_DIMS + WORD_DIMS + EXTRA), np.float32)
    texts = [b.text.encode() for b in blocks]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    words, count = word_hashes(np.frombuffer(b"".join(texts), np.uint8), offsets)
    owner = np.repeat(np.arange(n), count)
    place = owner * WORD_DIMS + (words % np.uint64(WORD_DIMS)).astype(np.int64)
    bag = np.bincount(place, minlength=n * WORD_DIMS).reshape(n, WORD_DIMS)
    for i, b in enumerate(blocks):
        v = cache.get(b.path)
        if v is None:
            v = np.zeros(PATH_DIMS, np.float32)
            for mark in set(b.path):
                v[zlib.crc32(mark.encode()) % PATH_DIMS] = 1
            if len(cache) > 50_000:
                cache.clear()
            cache[b.path] = v
        out[i, :PATH_DIMS] = v
        out[i, -EXTRA:] = (min(2.0, np.log1p(count[i]) / 5), b.linked / max(1, len(b.text)),
                           sum(map(b.text.count, ".,;!?")) / max(1, len(b.text)) * 10, i / n)
    # Unit length, so a very long block weighs no more than a short one.
    out[:, PATH_DIMS : PATH_DIMS + WORD_DIMS] = bag / np.maximum(1, np.sqrt((bag * bag).sum(1)))[:, None]
    return out


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _lstm(x: np.ndarray, live: np.ndarray, p: dict, d: str, cache: list | None = None) -> np.ndarray:
    """States (t, n, h) of inputs x (t, n, f); where ``live`` (t, n) is 0 the state passes through unchanged."""
    steps, lanes, _ = x.shape
    h = p[d + "U"].shape[0]
    gates_in = x @ p[d + "W"] + p[d + "b"]
    out = np.zeros((steps, lanes, h), np.float32)
    state, cell = np.zeros((lanes, h), np.float32), np.zeros((lanes, h), np.float32)
    for t in range(steps):
        a = gates_in[t] + state @ p[d + "U"]
        i, f, o = _sigmoid(a[:, :h]), _sigmoid(a[:, h : 2 * h]), _sigmoid(a[:, 2 * h : 3 * h])
        g = np.tanh(a[:, 3 * h :])
        on = live[t][:, None]
        new_cell = np.where(on, f * cell + i * g, cell)
        squashed = np.tanh(new_cell)
        new_state = np.where(on, o * squashed, state)
        if cache is not None:
            cache.append((i, f, o, g, cell, squashed, state, on))
        state, cell = new_state, new_cell
        out[t] = state
    return out


def _lstm_back(x, p, d, cache, d_out, grads):
    h = p[d + "U"].shape[0]
    d_state = np.zeros_like(d_out[0])
    d_cell = np.zeros_like(d_state)
    d_gates = np.empty((len(x), x.shape[1], 4 * h), np.float32)
    for t in range(len(x) - 1, -1, -1):
        i, f, o, g, cell, squashed, state, on = cache[t]
        d_new = d_state + d_out[t]
        live = np.where(on, d_new, 0)
        d_c = d_cell + live * o * (1 - squashed**2)
        a = np.concatenate([d_c * g * i * (1 - i), d_c * cell * f * (1 - f), live * squashed * o * (1 - o),
                            d_c * i * (1 - g * g)], 1)
        a = np.where(on, a, 0)
        d_gates[t] = a
        grads[d + "U"] += state.T @ a
        d_state = np.where(on, a @ p[d + "U"].T, d_new)
        d_cell = np.where(on, d_c * f, d_cell)
    flat = d_gates.reshape(-1, 4 * h)
    grads[d + "W"] += x.reshape(len(flat), -1).T @ flat
    grads[d + "b"] += flat.sum(0)


def block_scores(p: dict, x: np.ndarray, live: np.ndarray, caches: tuple | None = None) -> np.ndarray:
    """Logits (t, n) that blocks are main text."""
    ahead = _lstm(x, live, p, "f", caches and caches[0])
    back = _lstm(x[::-1], live[::-1], p, "b", caches and caches[1])[::-1]
    return ahead @ p["fv"] + back @ p["bv"] + x @ p["xv"] + p["c"], ahead, back


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, pages))
    x = np.zeros((longest, len(pages), PATH_DIMS + WORD_DIMS + EXTRA), np.float32)
    live = np.zeros((longest, len(pages)), bool)
    for i, v in enumerate(pages):
        x[: len(v), i], live[: len(v), i] = v, True
    return x, live


def train(pages: list[tuple[np.ndarray, np.ndarray]], hidden: int = HIDDEN, steps: int = STEPS, batch: int = BATCH,
          seed: int = 3) -> dict[str, np.ndarray]:
    """Fit on (vectors, labels) of pages."""
    rng = np.random.default_rng(seed)
    f = PATH_DIMS + WORD_DIMS + EXTRA
    p = {}
    for d in "fb":
        p[d + "W"] = rng.normal(0, f**-0.5, (f, 4 * hidden)).astype(np.float32)
        p[d + "U"] = rng.normal(0, hidden**-0.5, (hidden, 4 * hidden)).astype(np.float32)
        p[d + "b"] = np.zeros(4 * hidden, np.float32)
        p[d + "b"][hidden : 2 * hidden] = 1
        p[d + "v"] = rng.normal(0, 0.3, hidden).astype(np.float32)
    p["xv"], p["c"] = np.zeros(f, np.float32), np.zeros(1, np.float32)
    first, second = ({n: np.zeros_like(a) for n, a in p.items()} for _ in range(2))
    for step in range(1, steps + 1 if pages else 1):
        chosen = [pages[i] for i in rng.integers(0, len(pages), batch)]
        x, live = _padded([v for v, _ in chosen])
        y = np.zeros(live.shape, np.float32)
        for i, (_, labels) in enumerate(chosen):
            y[: len(labels), i] = labels
        caches: tuple[list, list] = ([], [])
        logits, ahead, back = block_scores(p, x, live, caches)
        d = np.where(live, _sigmoid(logits) - y, 0).astype(np.float32) / live.sum()
        grads = {n: np.zeros_like(a) for n, a in p.items()}
        grads["fv"], grads["bv"] = np.einsum("tn,tnh->h", d, ahead), np.einsum("tn,tnh->h", d, back)
        grads["xv"], grads["c"] = np.einsum("tn,tnf->f", d, x), d.sum(keepdims=True)[0]
        _lstm_back(x, p, "f", caches[0], d[:, :, None] * p["fv"], grads)
        _lstm_back(x[::-1], p, "b", caches[1], (d[:, :, None] * p["bv"])[::-1], grads)
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = 0.02 * min(1.0, step / 20) * 0.1 ** (step / steps)
        for n, g in grads.items():
            g = g * min(1.0, 1.0 / (size + 1e-9))
            first[n] += 0.1 * (g - first[n])
            second[n] += 0.01 * (g * g - second[n])
            p[n] -= (rate * first[n] / (1 - 0.9**step) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


def compose(rng: np.random.Generator, texts: list[str]) -> str:
    """A page in a layout of its own, all parts filled with the same kind of text."""

    def some(n):
        return [html.escape(texts[i]) for i in rng.integers(0, len(texts), n)]

    def short():
        return " ".join(some(1)[0].split()[: int(rng.integers(1, 5))])

    def pick(*options):
        return options[int(rng.integers(0, len(options)))]

    def paragraphs(n):
        return "".join(f"<{(t := pick('p', 'p', 'p', 'li', 'h2', 'blockquote', 'div'))}>{x}</{t}>" for x in some(n))

    def links():
        return "<ul>" + "".join(f'<li><a href="/x">{short()}</a></li>' for _ in range(int(rng.integers(2, 7)))) + "</ul>"

    def rest():
        part = pick("nav", "aside", "footer", "header", "form", "div", "div", "div", "section")
        name = pick(*[m[1:] for m in sorted(REST) if m[0] == "."])
        mark = f' {pick("class", "id")}="{name}"' if part in ("div", "section") or rng.random() < 0.3 else ""
        inner = pick(links(), paragraphs(int(rng.integers(1, 4))), some(1)[0])
        return f"<{part}{mark}>{inner}</{part}>"

    def rests(most):
        return "".join(rest() for _ in range(int(rng.integers(0, most))))

    opening, closing = pick(("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"),
                            ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"),
                            ('<div id="post-body">', "</div>"), ('<div class="entry-text">', "</div>"))
    body = f"<h1>{some(1)[0]}</h1>" + "".join(
        paragraphs(int(rng.integers(1, 6))) + (rest() if rng.random() < 0.3 else "") for _ in range(int(rng.integers(1, 4))))
    return f"<html><body>{rests(4)}{opening}{body}{closing}{rests(4)}</body></html>"


def fit_block_labeller(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE_PAGES,
                       seed: int = 3) -> dict[str, np.ndarray] | None:
    """Train on about ``sample`` pages chosen by a hash of their id, and as many composed of their blocks."""
    rows = narrow(pages, id=pages[id_col].cast("string"), html=pages[html_col].cast("string")).where("html is not null")
    total = rows.count()
    place = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page, text, path, linked = [], [], [], []
            for i, source in zip(batch.column("id").to_pylist(), batch.column("html").to_pylist()):
                for b in leaf_blocks(source)[:SAMPLE_BLOCKS]:
                    page.append(i)
                    text.append(b.text[:2000])
                    path.append(list(b.path))
                    linked.append(b.linked)
            yield pa.record_batch([pa.array(page, pa.string()), pa.array(text, pa.string()),
                                   pa.array(path, pa.list_(pa.string())), pa.array(linked, pa.int64())],
                                  names=["page", "text", "path", "linked"])

    found: dict[str, list[Block]] = {}
    chosen = rows.where(place < min(1.0, sample / max(1, total))).mapInArrow(
        sampled, "page string, text string, path array<string>, linked long").toArrow()
    for page, text, path, linked in zip(*(chosen.column(c).to_pylist() for c in ("page", "text", "path", "linked"))):
        found.setdefault(page, []).append(Block(text, tuple(path), linked))
    blocks = [found[k] for k in sorted(found, key=str)]
    texts = [b.text for page in blocks for b in page]
    if not texts:
        return None
    rng = np.random.default_rng(seed)
    blocks += [leaf_blocks(compose(rng, texts)) for _ in range(sample)]
    cache: dict = {}
    return train([(_vectors(b, cache), np.array([teacher(x.path) for x in b], np.float32)) for b in blocks if b], seed=seed)


def label_pages(pages: list[list[Block]], p: dict, cache: dict) -> list[np.ndarray]:
    """For each page, which of its blocks are main text. Pages of similar length are read side by side."""
    out = [np.zeros(0, bool)] * len(pages)
    order = [i for i in np.argsort([len(b) for b in pages], kind="stable") if pages[i]]
    for a in range(0, len(order), LANES):
        lanes = order[a : a + LANES]
        # A very long page is read alone, so padding stays small.
        while len(lanes) > 1 and len(lanes) * len(pages[lanes[-1]]) > 20_000:
            x, live = _padded([_vectors(pages[lanes[-1]], cache)])
            out[lanes[-1]] = block_scores(p, x, live)[0][:, 0] > 0
            lanes = lanes[:-1]
        x, live = _padded([_vectors(pages[i], cache) for i in lanes])
        keep = block_scores(p, x, live)[0] > 0
        for k, i in enumerate(lanes):
            out[i] = keep[: len(pages[i]), k]
    return out


def extract_text(pages: DataFrame, model: dict | None, id_col: str = "page_id", url_col: str = "url",
                 html_col: str = "html") -> DataFrame:
    """page_id, url, text (main blocks joined by a line break), n_chars, n_blocks, n_main.

    A null or textless page gives an empty text; repeated rows give repeated results, an empty table none; other
    columns are not read. Without a model nothing counts as main text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                found = [leaf_blocks(x or "") for x in part.column("html").to_pylist()]
                main = label_pages(found, model, cache) if model else [np.zeros(len(b), bool) for b in found]
                texts = ["\n".join(b.text for b, m in zip(blocks, keep) if m) for blocks, keep in zip(found, main)]
                yield pa.record_batch(
                    [part.column("id"), part.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64()), pa.array([len(b) for b in found], pa.int64()),
                     pa.array([int(m.sum()) for m in main], pa.int64())],
                    names=["page_id", "url", "text", "n_chars", "n_blocks", "n_main"])

    rows = narrow(pages, id=pages[id_col].cast("long"), url=pages[url_col].cast("string"),
                  html=pages[html_col].cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_main long")


@register("op4_html_text")
def op4_html_text(spark, sf_dir):
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return extract_text(pages, fit_block_labeller(pages))

"""Main text of web pages: a recurrent labeller over the page's leaf blocks.

A page becomes the sequence of its leaf blocks. A bidirectional LSTM (numpy) reads for each
block a hashed vector of its tag path and one of its words, and labels it with both
directions' context as main text or not. It is trained here, on a bounded sample of pages
whose blocks are labelled by the names of the elements around them.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmine.llm import texts

#: Pages that the labeller is fitted on, at most; they are the ones of least hashed id.
SAMPLE_PAGES = 160
PATH_DIMS, WORD_DIMS, HIDDEN = 96, 32, 16

# Elements that never break a block, hold no text, or close each other.
INLINE = frozenset(
    ("a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark",
     "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "img")
)
#: Elements of formulas: part of the sentence around them, their tags only part the words.
MATH = frozenset(
    ("math", "mi", "mn", "mo", "ms", "mtext", "mspace", "mrow", "mfrac", "msqrt", "mroot", "mstyle", "merror", "mpadded",
     "mphantom", "mfenced", "menclose", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mmultiscripts",
     "mprescripts", "none", "mtable", "mtr", "mlabeledtr", "mtd", "maction", "semantics", "annotation", "annotation-xml")
)
#: Elements of drawings that hold no text of their own, so that an icon parts no sentence.
DRAWN = frozenset(
    ("svg", "g", "path", "circle", "ellipse", "line", "rect", "polygon", "polyline", "use", "defs", "symbol", "image", "marker",
     "mask", "pattern", "filter", "clippath", "lineargradient", "radialgradient", "stop", "animate", "tspan", "textpath")
)
VOID = frozenset(
    ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
)
CLOSES_ITSELF = frozenset(("p", "li", "dt", "dd", "tr", "td", "th", "option"))
# Names that mark what is not the article, for the training labels.
OUTER_TAGS = frozenset(
    ("nav", "header", "footer", "aside", "form", "button", "select", "noscript", "iframe", "menu", "dialog", "title", "head")
)
OUTER_NAMES = frozenset(
    ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "cookie", "cookies", "consent", "notice",
     "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "header", "comment", "comments",
     "disqus", "share", "social", "related", "newsletter", "subscribe", "signup", "widget", "popup", "modal", "pagination")
)
#: Furniture put around sampled pages in training, so that containers a sample lacks are known.
FURNITURE = (
    '<aside class="sidebar"><h3>{0}</h3><p>{1}</p></aside>',
    '<div id="comments" class="comments"><div class="comment"><p>{1}</p></div><div class="comment"><p>{2}</p></div></div>',
    '<section class="comments"><h2>{0}</h2><p>{2}</p></section>',
    '<div class="cookie-notice"><p>{1}</p><button>{0}</button></div>',
    '<form action="#"><label>{0}</label><input name="q"><p>{1}</p></form>',
    '<header class="site-header"><div>{0}</div><p>{1}</p></header>',
    '<div class="sponsored ad banner"><p>{2}</p></div>',
    '<div class="related"><ul><li><a href="#">{0}</a></li><li><a href="#">{1}</a></li></ul></div>',
    '<ul class="menu"><li><a href="#">{0}</a></li><li><a href="#">{0}</a></li></ul>',
    '<div class="share social">{0}</div>', '<div class="newsletter subscribe"><p>{1}</p></div>',
    "<noscript>{1}</noscript>", '<div role="navigation"><a href="#">{0}</a></div>', '<p class="notice">{1}</p>',
)

_RAW = "script|style|template|textarea"
_PIECE = re.compile(
    rf"<!--.*?(?:-->|\Z)|(?P<open><(?P<raw>{_RAW})\b[^>]*>).*?(?:</(?P=raw)\s*>|\Z)"
    r"|(?P<tag></?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|</?[a-zA-Z][^>]*>|<[!?][^>]*>)|(?P<text>[^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
_NAME = re.compile(r"<(/?)([a-zA-Z][\w:-]*)")
_MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_PART = re.compile(r"[a-z]+|\d+")


def _read_tag(tag: str) -> tuple[bool, str, tuple[str, ...]]:
    """(closing, name, words of class, id and role)."""
    m = _NAME.match(tag)
    if not m:
        return False, "", ()
    marks = " ".join(a or b or c for a, b, c in _MARK.findall(tag)).lower()
    return m[1] == "/", m[2].lower(), tuple(_PART.findall(marks))


def leaf_blocks(page: str) -> list[tuple[str, tuple, int]]:
    """(text, path, characters inside links) of the leaf blocks in page order; a path is the
    open elements as (name, marks). References are decoded, white space is one space. Formulas
    are text of the element around them; texts of drawings are blocks under ``svg``."""
    blocks: list[tuple[str, tuple, int]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    path, links, linked = (), 0, 0
    known: dict[str, tuple] = {}

    def close() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            blocks.append((text, path, linked))
        parts.clear()
        linked = 0

    at = 0
    while m := _PIECE.match(page, at):
        at = m.end()
        if m["text"] is not None:
            if not parts or not path:
                path = tuple(stack)
            parts.append(m["text"])
            linked += len(m["text"]) if links else 0
            continue
        if m["tag"] is None:
            # In a drawing, unlike elsewhere, such an element can close itself.
            if m["raw"] and m["open"].endswith("/>") and any(n == "svg" for n, _ in stack):
                at = m.end("open")
            continue
        closing, name, marks = known.get(m["tag"]) or known.setdefault(m["tag"], _read_tag(m["tag"]))
        if not name:
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in MATH:
            if parts:
                parts.append(" ")
            continue
        if name not in INLINE and name not in DRAWN:
            close()
        if m["tag"].endswith("/>") and (name in DRAWN or any(n == "svg" for n, _ in stack)):
            continue
        if name == "a":
            links = 0 if closing else 1
        if closing:
            names = [n for n, _ in stack]
            if name in names:
                del stack[len(names) - 1 - names[::-1].index(name) :]
        elif name not in VOID:
            if name in CLOSES_ITSELF:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
                    if stack[k][0] not in INLINE and stack[k][0] not in DRAWN and stack[k][0] not in CLOSES_ITSELF:
                        break
            stack.append((name, marks))
    close()
    return blocks


def named_label(path: tuple, has_article: bool) -> bool:
    """Training label: inside the article (or the body of a page without one) and inside no
    element whose tag or marks name something else."""
    inside = any(n in ("article", "main") for n, _ in path) if has_article else any(n == "body" for n, _ in path)
    return inside and not any(n in OUTER_TAGS or OUTER_NAMES.intersection(marks) for n, marks in path)


def _slot(token: str) -> int:
    h = 2166136261
    for c in token.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return h % PATH_DIMS


def features(pages: list[list[tuple[str, tuple, int]]]) -> list[np.ndarray]:
    """Per page an array (blocks, dims): tag path, words, and shape of every block."""
    flat = [b for page in pages for b in page]
    out = np.zeros((len(flat), PATH_DIMS + WORD_DIMS + 6), np.float32)
    slots: dict[tuple, list[int]] = {}
    for i, (_, path, _) in enumerate(flat):
        if path not in slots:
            slots[path] = [_slot(t) for n, marks in path for t in (n, *(f".{k}" for k in marks))] + [_slot(f"last {path[-1][0]}" if path else "")]
        out[i, slots[path]] = 1
    data, offsets = texts.utf8(pa.array([b[0] for b in flat], pa.string()))
    starts, ends, words = texts.word_spans(data, offsets)
    hashes = texts.span_hashes(texts.prefix_hashes(data, texts.FOLDED_CODES), starts, ends)
    owner = np.repeat(np.arange(len(flat)), np.diff(words))
    bucket = (hashes % np.uint64(WORD_DIMS)).astype(np.int64)
    counts = np.bincount(owner * WORD_DIMS + bucket, minlength=len(flat) * WORD_DIMS).reshape(-1, WORD_DIMS)
    n_words = np.diff(words)
    out[:, PATH_DIMS : PATH_DIMS + WORD_DIMS] = np.sqrt(counts) / np.maximum(1, np.sqrt(n_words))[:, None]
    size = np.maximum(1, np.diff(offsets))
    shape = out[:, PATH_DIMS + WORD_DIMS :]
    shape[:, 0] = np.log1p(n_words) / 5
    shape[:, 1] = [b[2] / max(1, len(b[0])) for b in flat]
    shape[:, 2] = [b[0][-1] in ".!?" for b in flat]
    shape[:, 3] = size / np.maximum(1, n_words) / 10
    cuts = np.cumsum([len(p) for p in pages])[:-1]
    shape[:, 4] = np.concatenate([np.arange(len(p)) / max(1, len(p)) for p in pages] or [[]])
    shape[:, 5] = 1
    return np.split(out, cuts)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _padded(pages: list[np.ndarray], reverse: bool) -> np.ndarray:
    steps = max(len(p) for p in pages)
    out = np.zeros((steps, len(pages), pages[0].shape[1]), np.float32)
    for i, p in enumerate(pages):
        out[: len(p), i] = p[::-1] if reverse else p
    return out


class BlockLabeller:
    """Bidirectional LSTM with one output per step."""

    def __init__(self, dims: int, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p: dict[str, np.ndarray] = {"out": rng.normal(0, 0.1, (2 * hidden,)).astype(np.float32), "bias": np.zeros(1, np.float32)}
        for d in ("f", "b"):
            self.p[f"x{d}"] = rng.normal(0, 1 / np.sqrt(dims), (dims, 4 * hidden)).astype(np.float32)
            self.p[f"h{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden)).astype(np.float32)
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1  # gates remember at first
            self.p[f"c{d}"] = bias

    def _run(self, x: np.ndarray, d: str, keep: bool):
        """States of all steps; ``keep`` also returns what the gradient needs. Padding comes
        last and is never read."""
        n = self.hidden
        steps, rows, _ = x.shape
        given = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        h, c = np.zeros((rows, n), np.float32), np.zeros((rows, n), np.float32)
        out, trace = np.zeros((steps, rows, n), np.float32), []
        for t in range(steps):
            z = given[t] + h @ self.p[f"h{d}"]
            gate = _sigmoid(z[:, : 3 * n])
            i, f, o, g = gate[:, :n], gate[:, n : 2 * n], gate[:, 2 * n :], np.tanh(z[:, 3 * n :])
            before, c = c, f * c + i * g
            tc = np.tanh(c)
            if keep:
                trace.append((i, f, o, g, before, tc, h))
            h = o * tc
            out[t] = h
        return out, trace

    def _scores(self, pages: list[np.ndarray], keep: bool = False):
        xs = {"f": _padded(pages, False), "b": _padded(pages, True)}
        hs, traces = {}, {}
        for d in xs:
            hs[d], traces[d] = self._run(xs[d], d, keep)
        both = []
        for k, p in enumerate(pages):
            both.append(np.concatenate([hs["f"][: len(p), k], hs["b"][: len(p), k][::-1]], axis=1))
        return [b @ self.p["out"] + self.p["bias"] for b in both], both, xs, traces

    def predict(self, pages: list[np.ndarray], blocks: int = 20_000) -> list[np.ndarray]:
        """True where a block is main text. Pages of similar length go together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        while order:
            group = [order.pop()]
            longest = len(pages[group[0]])
            while order and longest * (len(group) + 1) <= blocks:
                group.append(order.pop())
            for i, score in zip(group, self._scores([pages[i] for i in group])[0], strict=True):
                out[i] = score > 0
        return out

    def gradient(self, pages: list[np.ndarray], labels: list[np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
        n = self.hidden
        scores, both, xs, traces = self._scores(pages, keep=True)
        total = sum(len(p) for p in pages)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        steps = max(len(p) for p in pages)
        back = {d: np.zeros((steps, len(pages), n), np.float32) for d in xs}
        loss = 0.0
        for k, (score, b, y) in enumerate(zip(scores, both, labels, strict=True)):
            prob = _sigmoid(score)
            loss -= float(np.log(np.where(y, prob, 1 - prob) + 1e-7).sum())
            err = (prob - y).astype(np.float32) / total
            grad["out"] += b.T @ err
            grad["bias"] += err.sum()
            back["f"][: len(y), k] = err[:, None] * self.p["out"][:n]
            back["b"][: len(y), k] = (err[:, None] * self.p["out"][n:])[::-1]
        for d, x in xs.items():
            dh, dc = np.zeros((len(pages), n), np.float32), np.zeros((len(pages), n), np.float32)
            for t in range(steps - 1, -1, -1):
                i, f, o, g, before, tc, h = traces[d][t]
                dh = dh + back[d][t]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate(
                    [dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1
                )
                grad[f"x{d}"] += x[t].T @ dz
                grad[f"h{d}"] += h.T @ dz
                grad[f"c{d}"] += dz.sum(axis=0)
                dh, dc = dz @ self.p[f"h{d}"].T, dc * f
        return loss / total, grad

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 25, batch: int = 32, rate: float = 0.02, seed: int = 11) -> float:
        """Adam; returns the last epoch's mean loss."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, losses = 0, []
        for _ in range(epochs):
            losses = []
            order = rng.permutation(len(pages))
            for a in range(0, len(order), batch):
                ids = order[a : a + batch]
                loss, grad = self.gradient([pages[i] for i in ids], [labels[i] for i in ids])
                losses.append(loss)
                step += 1
                for k, g in grad.items():
                    g = np.clip(g, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
        return float(np.mean(losses)) if losses else 0.0


def _furnished(page: str, rng: np.random.Generator) -> str:
    """The page with some furniture before and behind its article, in words of its own."""
    words = re.sub(r"<[^>]*>", " ", page).split() or ["text"]

    def phrase(n: int) -> str:
        at = int(rng.integers(0, max(1, len(words) - n)))
        return entities.escape(" ".join(words[at : at + n])) + "."

    def some() -> str:
        picks = rng.choice(len(FURNITURE), size=int(rng.integers(0, 4)), replace=False)
        return "".join(FURNITURE[k].format(phrase(2), phrase(12), phrase(30)) for k in picks)

    for mark in ("<article", "<main"):
        at, end = page.find(mark), page.rfind("</" + mark[1:])
        if 0 <= at < end:
            inner = page[at:end].replace("</p>", "</p>" + some(), 1) if rng.random() < 0.3 else page[at:end]
            return page[:at] + some() + inner + page[end : end + len(mark) + 2] + some() + page[end + len(mark) + 2 :]
    return re.sub(r"(<body[^>]*>)(.*)(</body>)", lambda m: m[1] + some() + m[2] + some() + m[3], page, count=1, flags=re.DOTALL)


def train(sample: list[str], seed: int = 3) -> BlockLabeller:
    """A labeller fitted on the sampled pages, as they are, furnished, and with their article
    and main elements turned into plain divisions."""
    rng = np.random.default_rng(seed)
    pages: list[str] = []
    for page in sample:
        pages += [page, _furnished(page, rng), re.sub(r"(</?)(?:article|main)\b", r"\1div", _furnished(page, rng))]
    cut = [b for b in (leaf_blocks(p) for p in pages) if b]
    labels = []
    for blocks in cut:
        has_article = any(n in ("article", "main") for _, path, _ in blocks for n, _ in path)
        labels.append(np.array([named_label(path, has_article) for _, path, _ in blocks]))
    labeller = BlockLabeller(PATH_DIMS + WORD_DIMS + 6)
    labeller.fit(features(cut), labels)
    return labeller


def extract_main_text(
    pages: DataFrame, sample_pages: int = SAMPLE_PAGES, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ("url",)
) -> DataFrame:
    """(key, kept columns, text, n_chars): the blocks labelled as main text, joined by \\n.

    The labeller is fitted on ``sample_pages`` pages at most (those of least hashed key) and
    applied to every block of every page; nothing of a page is dropped otherwise or cut off.
    Null and empty pages have empty text; null keys and repeated rows are passed on; an
    empty table gives no rows.
    """
    spark = pages.sparkSession
    # A draw of about four times the sample by hash, so that few rows are ordered. A draw that
    # falls short (copies of few pages share their hashes) gives way to the least hashes of all.
    placed = pages.filter(F.length(html) > 0).withColumn("__dm_h", F.xxhash64(key, html))
    n_pages = placed.count()
    draw = min(1.0, 4.0 * sample_pages / max(1, n_pages))
    drawn = placed.filter(F.shiftright("__dm_h", 32) <= int(draw * ((1 << 32) - 1)) - (1 << 31))
    for some in (drawn, placed):
        sample = [r[0] for r in some.orderBy("__dm_h").limit(sample_pages).select(html).collect()]
        if len(sample) >= min(sample_pages, n_pages):
            break
    model = spark.sparkContext.broadcast(train(sample) if sample else None)
    rows = pages.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(html).alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts.slices(batches, "_html", 1 << 20):
            blocks = [leaf_blocks(h or "") for h in batch.column("_html").to_pylist()]
            main = model.value.predict(features(blocks)) if any(blocks) else [()] * len(blocks)
            found = ["\n".join(b[0] for b, m in zip(page, mask, strict=True) if m) for page, mask in zip(blocks, main, strict=True)]
            own = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                names=[*batch.schema.names[:-1], "text", "n_chars"],
            )

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    out = rows.mapInArrow(run, ", ".join([*kinds, "text string", "n_chars long"]))
    return out.withColumnsRenamed({"_key": key, **{f"_k{i}": c for i, c in enumerate(keep)}})

"""HTML extraction: a bidirectional LSTM in numpy labels every text block of a page.

A page is cut into blocks: the text between two borders of block-level elements, in page order. Each block
is a vector of its tag path (hashed tags, classes and ids of the open block-level elements), its hashed words
and a few measures. A recurrent pass over the whole sequence in both directions gives every block the
context of the document; blocks with a probability of one half and more are the main text, joined by one space.

The weights are trained here, in one task, on a bounded sample: the ``sample`` pages with the smallest hash among those
that declare their text with ``article`` or ``main`` and have at most ``SAMPLE_BYTES`` bytes. Their declared blocks are
the labels, less those inside navigation, asides, forms and the like. As other pages declare nothing, each sample page is also
written anew under other names: the text in plain containers, with menus, notices, adverts, side columns, forms and reader
comments made of other text around and inside it; ``MADE`` pages of made-up words stand in when the sample is small or empty. All
else reads whole pages: no block and no character is dropped or cut before labelling.

Character references are decoded after the markup is read; all Unicode white space, also that of references, becomes one
space. ``br`` is white space. Raw text elements (scripts, styles, titles, text areas), comments and a tag that the page's end cuts
off have no text. A null or empty html gives an empty text, as does a page without main blocks; null ids and
urls stay, repeated rows are rows of their own with equal answers. A long page is read in pieces of ``CHUNK`` blocks with the state
carried on, so its vectors never exist together. An empty table gives no rows. Only page_id, url and html are read.
"""

from __future__ import annotations

import html as references
import random
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 300
SAMPLE_BYTES = 1 << 16
MADE = 120
EPOCHS = 8
HIDDEN = 16
PATH_SLOTS, WORD_SLOTS, MEASURES = 256, 64, 7
WIDTH = PATH_SLOTS + WORD_SLOTS + MEASURES
CHUNK = 8192  # blocks whose vectors exist together

# Fixed values of HTML: elements whose borders end a block, elements whose content is no markup, elements without content.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html label legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template tfoot th thead tr ul".split()
)
RAW_TAGS = "script style title textarea iframe noembed noframes xmp"
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An element of the left side ends when one of the right side begins in the same parent.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}
ENDS_PARAGRAPH = BLOCK_TAGS - {"button", "label", "legend", "caption", "body", "html", "head", "tr", "td", "th", "tbody", "thead", "tfoot", "option", "optgroup", "template", "noscript"}
NOT_TEXT = frozenset("nav aside footer form header button select label dialog menu noscript template".split())

ATTRIBUTES = r"""(?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*+"""
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({'|'.join(RAW_TAGS.split())})\b{ATTRIBUTES}>.*?(?:</\1[\s/>]|\Z)|<(/?)([a-z][^\s/>]*)({ATTRIBUTES})(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S | re.I
)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
NAME = re.compile(r"[a-z]+")


class Slots(dict):
    """The slot of each word or name, remembered; emptied when it grows past ``most``."""

    def __init__(self, slots: int, most: int = 200_000):
        super().__init__()
        self.slots, self.most = slots, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = crc32(word.encode("utf-8", "surrogatepass")) % self.slots
        return value


def blocks_of(page: str | None) -> list[tuple]:
    """(path, text, characters inside links) of each block with text; a path is a tuple of (tag, names)."""
    page, out, path, parts, linked, in_link, at = page or "", [], [], [], 0, 0, 0

    def close():
        nonlocal parts, linked
        text = " ".join(references.unescape("".join(parts)).split()) if parts else ""
        if text:
            out.append((tuple(path), text, linked))
        parts, linked = [], 0

    def add(text):
        nonlocal linked
        if text:
            parts.append(text)
            if in_link:
                linked += len(text)

    for token in TOKEN.finditer(page):
        add(page[at : token.start()])
        at = token.end()
        if token[1]:  # the end of a raw element may lack its bracket
            at = page.find(">", at - 1) + 1 or len(page) if at < len(page) else at
            if token[1].lower() in ("textarea", "iframe", "xmp"):
                close()
            continue
        if token[3] is None:
            continue
        tag = token[3].lower()
        if tag == "a":
            in_link = 0 if token[2] else 1
        elif tag == "br":
            add(" ")
        if tag not in BLOCK_TAGS:
            continue
        close()
        if token[2]:
            if any(tag == t for t, _ in path):
                while path.pop()[0] != tag:
                    pass
            continue
        if tag in ENDS_PARAGRAPH and path and path[-1][0] == "p":
            path.pop()
        while path and tag in ENDED_BY.get(path[-1][0], ()):
            path.pop()
        if tag not in VOID_TAGS:
            names = " ".join(NAMED.findall(token[4])) if "=" in token[4] else ""
            path.append((tag, tuple(NAME.findall(names.lower()))))
    add(page[at:])
    close()
    return out


class Vectors:
    """Vectors of blocks; those of paths are remembered."""

    def __init__(self, most: int = 20_000):
        self.paths, self.most, self.names, self.words = {}, most, Slots(PATH_SLOTS), Slots(WORD_SLOTS)

    def path(self, path: tuple) -> np.ndarray:
        found = self.paths.get(path)
        if found is None:
            if len(self.paths) >= self.most:
                self.paths.clear()
            found = np.zeros(PATH_SLOTS, np.float32)
            for k, (tag, names) in enumerate(path):
                last = k == len(path) - 1
                for token in [f"<{tag}", *names, *([f"={tag}"] if last else [])]:
                    found[self.names[token]] = 1
            self.paths[path] = found
        return found

    def of(self, blocks: list[tuple], first: int, total: int) -> np.ndarray:
        """The vectors of blocks that begin at place ``first`` of a page of ``total`` blocks."""
        out = np.zeros((len(blocks), WIDTH), np.float32)
        sizes, slots = [], []
        for k, (path, text, linked) in enumerate(blocks):
            words = text.split(" ")
            sizes.append(len(words))
            slots += map(self.words.__getitem__, words)
            out[k, :PATH_SLOTS] = self.path(path)
            out[k, PATH_SLOTS + WORD_SLOTS :] = (
                np.log1p(len(text)) / 8, np.log1p(len(words)) / 6, min(1, linked / len(text)), text[-1] in ".!?…\"”", text.count(",") / len(words), (first + k) / total, first + k == 0,
            )
        rows = np.repeat(np.arange(len(blocks)), sizes)
        counts = np.bincount(rows * WORD_SLOTS + np.array(slots, int), minlength=len(blocks) * WORD_SLOTS).reshape(-1, WORD_SLOTS) if len(blocks) else np.zeros((0, WORD_SLOTS))
        out[:, PATH_SLOTS : PATH_SLOTS + WORD_SLOTS] = counts / np.sqrt((counts**2).sum(1, keepdims=True)).clip(1)
        return out


# The network: for both directions input weights, recurrent weights and bias of the gates (in, forget, out, new); then the output.
def start(rng: np.random.Generator) -> dict:
    net = {}
    for side in ("f", "b"):
        net[f"w{side}"] = rng.normal(0, 0.08, (WIDTH, 4 * HIDDEN))
        net[f"u{side}"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
        net[f"c{side}"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)
        net[f"o{side}"] = rng.normal(0, 0.3, HIDDEN)
    net["bias"] = np.zeros(1)
    return net


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def recur(projected: np.ndarray, u: np.ndarray, state, keep: list | None = None):
    """Hidden states (steps, pages, HIDDEN) of gates projected from the input, and the last state."""
    h, c = state
    out = np.empty((*projected.shape[:2], HIDDEN), projected.dtype)
    for t in range(len(projected)):
        z = projected[t] + h @ u
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        before = (h, c)
        c = f * c + i * g
        bent = np.tanh(c)
        h = out[t] = o * bent
        if keep is not None:
            keep.append((*before, i, f, o, g, bent))
    return out, (h, c)


def _zero(pages: int, kind=np.float32):
    return np.zeros((pages, HIDDEN), kind), np.zeros((pages, HIDDEN), kind)


def _turned(sizes: np.ndarray, steps: int) -> np.ndarray:
    """For each (step, page) the step at the same distance from the page's end; steps behind the end stay."""
    t = np.arange(steps)[:, None]
    return np.where(t < sizes, sizes - 1 - t, t)


def learn(sequences: list[tuple], epochs: int = EPOCHS, seed: int = 5, rate: float = 0.01, batch: int = 24) -> dict:
    """Weights from (vectors, labels) of pages, by gradients through time and adaptive moments."""
    rng = np.random.default_rng(seed)
    net = start(rng)
    first, second, step = {k: np.zeros_like(v) for k, v in net.items()}, {k: np.zeros_like(v) for k, v in net.items()}, 0
    for epoch in range(epochs):
        by_size = sorted(rng.permutation(len(sequences)).tolist(), key=lambda k: len(sequences[k][1]) // 8)
        groups = [by_size[k : k + batch] for k in range(0, len(by_size), batch)]
        for at in rng.permutation(len(groups)):
            step += 1
            chosen = [sequences[k] for k in groups[at]]
            change = _gradients(net, chosen)
            pace = rate * (0.5 if epoch >= epochs // 2 else 1) * (0.3 if epoch >= epochs - 1 else 1)
            for k, g in change.items():
                g = np.clip(g, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                net[k] = net[k] - pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


def _gradients(net: dict, chosen: list[tuple]) -> dict:
    sizes = np.array([len(y) for _, y in chosen])
    steps, pages = sizes.max(), len(chosen)
    x, y = np.zeros((steps, pages, WIDTH)), np.zeros((steps, pages))
    for k, (v, labels) in enumerate(chosen):
        x[: len(labels), k], y[: len(labels), k] = v, labels
    valid = np.arange(steps)[:, None] < sizes
    turn, column = _turned(sizes, steps), np.arange(pages)
    kept, hidden = {}, {}
    for side in ("f", "b"):
        inputs = x if side == "f" else x[turn, column]
        kept[side] = []
        hidden[side], _ = recur(inputs @ net[f"w{side}"] + net[f"c{side}"], net[f"u{side}"], _zero(pages, float), kept[side])
    logits = hidden["f"] @ net["of"] + (hidden["b"] @ net["ob"])[turn, column] + net["bias"]
    slope = (_sigmoid(logits) - y) * valid / valid.sum()
    out = {"bias": np.array([slope.sum()])}
    for side in ("f", "b"):
        back = slope if side == "f" else slope[turn, column]
        inputs = x if side == "f" else x[turn, column]
        out[f"o{side}"] = np.einsum("tp,tph->h", back, hidden[side])
        gates = np.zeros((steps, pages, 4 * HIDDEN))
        dh, dc = _zero(pages, float)
        du = np.zeros_like(net[f"u{side}"])
        for t in range(steps - 1, -1, -1):
            h, c, i, f, o, g, bent = kept[side][t]
            dh = dh + back[t][:, None] * net[f"o{side}"]
            dc = dc + dh * o * (1 - bent**2)
            gates[t] = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * bent * o * (1 - o), dc * i * (1 - g**2)], 1)
            du += h.T @ gates[t]
            dh, dc = gates[t] @ net[f"u{side}"].T, dc * f
        flat = gates.reshape(-1, 4 * HIDDEN)
        out[f"w{side}"], out[f"u{side}"], out[f"c{side}"] = inputs.reshape(-1, WIDTH).T @ flat, du, flat.sum(0)
    return out


class Labeller:
    """Probabilities of blocks under trained weights."""

    def __init__(self, net: dict):
        self.net = {k: v.astype(np.float32) for k, v in net.items()}
        self.vectors = Vectors()

    def label(self, pages: list[list[tuple]], chunk: int = CHUNK):
        """For each page of blocks the probabilities, in order; pages of like size go through together."""
        out = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        group = []
        for k in order:
            if len(pages[k]) > chunk:
                out[k] = self._long(pages[k], chunk)
                continue
            # The last one is the longest, and all are padded to it.
            if group and len(pages[k]) * (len(group) + 1) > chunk:
                self._together(group, pages, out)
                group = []
            group.append(k)
        if group:
            self._together(group, pages, out)
        return out

    def _together(self, group, pages, out):
        sizes = np.array([len(pages[k]) for k in group])
        steps, column = sizes.max(), np.arange(len(group))
        turn, logits = _turned(sizes, steps), 0
        flat = np.concatenate([self.vectors.of(pages[k], 0, len(pages[k])) for k in group])
        place = np.concatenate([np.arange(n) for n in sizes]), np.repeat(column, sizes)
        for side in ("f", "b"):
            x = np.zeros((steps, len(group), 4 * HIDDEN), np.float32)
            x[place] = flat @ self.net[f"w{side}"] + self.net[f"c{side}"]
            hidden, _ = recur(x if side == "f" else x[turn, column], self.net[f"u{side}"], _zero(len(group)))
            found = hidden @ self.net[f"o{side}"]
            logits = logits + (found if side == "f" else found[turn, column])
        for j, k in enumerate(group):
            out[k] = _sigmoid(logits[: sizes[j], j] + self.net["bias"])

    def _long(self, page, chunk):
        logits = np.zeros(len(page), np.float32)
        for side in ("f", "b"):
            state, starts = _zero(1), list(range(0, len(page), chunk))
            for s in starts if side == "f" else reversed(starts):
                x = self.vectors.of(page[s : s + chunk], s, len(page)) @ self.net[f"w{side}"] + self.net[f"c{side}"]
                hidden, state = recur((x if side == "f" else x[::-1])[:, None], self.net[f"u{side}"], state)
                found = hidden[:, 0] @ self.net[f"o{side}"]
                logits[s : s + chunk] += found if side == "f" else found[::-1]
        return _sigmoid(logits + self.net["bias"])


# Training pages.
# Names that pages give to containers of each kind.
CONTENT = "content post entry story text main body page article single blog document".split()
AROUND = {
    "menu": "nav menu navbar navigation breadcrumb tabs links".split(),
    "header": "header masthead branding top logo site banner".split(),
    "footer": "footer bottom copyright legal imprint credits".split(),
    "side": "sidebar aside related widget recommended popular rail".split(),
    "advert": "ad ads advert advertisement sponsored promo sponsor".split(),
    "notice": "cookie notice consent popup alert newsletter gdpr modal".split(),
    "form": "search login subscribe signup form contact".split(),
    "comments": "comments comment discussion replies respond thread responses".split(),
}
ELEMENT = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "advert": "div", "notice": "div", "form": "form", "comments": "section"}
MARK = "\ue000"  # begins the blocks of the text in pages that are made here


def declared(blocks: list[tuple]) -> np.ndarray | None:
    """Labels of a page that declares its text, or None."""
    inside = [any(t in ("article", "main") for t, _ in path) for path, _, _ in blocks]
    if not any(inside):
        return None
    around = {name for names in AROUND.values() for name in names} - set(CONTENT)
    shown = [not any(t in NOT_TEXT or around & set(names) for t, names in path) for path, _, _ in blocks]
    return np.array(inside, float) * shown


def _around(rng: random.Random, kind: str, words: list[str], long: list[str]) -> str:
    """The markup of one container that is not text."""
    short = lambda a, b: " ".join(rng.choice(words) for _ in range(rng.randint(a, b)))
    link = lambda: f'<a href="/x">{short(1, 4)}</a>'
    if kind in ("menu", "side"):
        items = [f"<li>{link()}</li>" for _ in range(rng.randint(2, 8))]
        inner = f"<ul>{''.join(items)}</ul>" if rng.random() < 0.8 else " | ".join(link() for _ in range(rng.randint(2, 6)))
        if kind == "side" and rng.random() < 0.5:
            inner = f"<h3>{short(1, 3)}</h3>{inner if rng.random() < 0.5 else f'<p>{rng.choice(long)}</p>'}"
    elif kind == "form":
        inner = f"<label>{short(1, 3)}</label><input name=q><button>{short(1, 2)}</button>" + (f"<p>{short(4, 14)}.</p>" if rng.random() < 0.3 else "")
    elif kind == "comments":
        inner = f"<h3>{short(1, 3)}</h3>" + "".join(f'<div class="{rng.choice(["comment", "reply", "item"])}"><b>{short(1, 2)}</b><p>{rng.choice(long)}</p></div>' for _ in range(rng.randint(1, 5)))
    elif kind == "footer":
        inner = f"&copy; {short(1, 3)} &middot; {short(3, 10)}." + (f"<p>{link()} {link()}</p>" if rng.random() < 0.4 else "")
    else:
        inner = f"{short(3, 14)}." if rng.random() < 0.7 else f"<p>{rng.choice(long)}</p>" + (link() if rng.random() < 0.5 else "")
    name, tag = rng.choice(AROUND[kind]), ELEMENT[kind]
    if tag != "div" and rng.random() < 0.5:
        return f"<{tag}>{inner}</{tag}>"
    name = rng.choice([name, f"{name}-{rng.choice(['box', 'area', 'list', 'wrap'])}", f"site-{name}"])
    return f'<div {rng.choice(["class", "id"])}="{name}">{inner}</div>'


def made_page(rng: random.Random, text: list[tuple[str, str]], long: list[str]) -> str:
    """A page that holds the text's blocks (tag, text) in a container, other things around and sometimes inside."""
    words = " ".join(long).split()
    parts = [f"<{tag}>{MARK}{references.escape(t, quote=False)}</{tag}>" for tag, t in text]
    for kind in rng.sample(["advert", "side", "menu", "form", "notice"], rng.choice([0, 0, 1, 2])):
        parts.insert(rng.randint(0, len(parts)), _around(rng, kind, words, long))
    if rng.random() < 0.15:
        parts.append(_around(rng, "comments", words, long))
    name = rng.choice(CONTENT)
    name = rng.choice([name, f"{name}-{rng.choice(CONTENT)}", f"{rng.choice(CONTENT)}-body"])
    tag, names = rng.choice([("article", ""), ("main", ""), ("div", f' class="{name}"'), ("div", f' id="{name}"'), ("section", f' class="{name}"')])
    body = f"<{tag}{names}>{''.join(parts)}</{tag}>"
    before = [_around(rng, k, words, long) for k in rng.sample(["header", "menu", "notice", "advert", "form"], rng.randint(0, 4))]
    after = [_around(rng, k, words, long) for k in rng.sample(["side", "comments", "form", "advert", "menu", "notice"], rng.randint(0, 4))]
    page = "".join([*before, body, *after, _around(rng, "footer", words, long) if rng.random() < 0.8 else ""])
    return f'<html><body><div class="{rng.choice(["wrapper", "container", "page", "layout"])}">{page}</div></body></html>' if rng.random() < 0.4 else f"<html><body>{page}</body></html>"


def training(pages: list[str], made: int = MADE, seed: int = 9) -> list[tuple]:
    """(vectors, labels) of sample pages, of the same pages written anew, and of pages of made-up words."""
    rng, vectors, out = random.Random(seed), Vectors(), []

    def add(blocks, labels):
        out.append((vectors.of(blocks, 0, len(blocks)), labels))

    def add_made(text, long):
        blocks = blocks_of(made_page(rng, text, long))
        add([(path, t.lstrip(MARK), linked) for path, t, linked in blocks], np.array([t[0] == MARK for _, t, _ in blocks], float))

    sets = []
    for page in pages:
        blocks = blocks_of(page)
        labels = declared(blocks) if blocks else None
        if labels is not None:
            add(blocks, labels)
            text = [(path[-1][0] if path and path[-1][0] in ("h1", "h2", "p", "li") else "p", t) for (path, t, _), y in zip(blocks, labels, strict=True) if y]
            if text:
                sets.append(text)
    for k, text in enumerate(sets):
        add_made(text, [t for _, t in sets[k - 1]])
    syllables = "ba de ki lo mu ra se ti no va".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    sentence = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b))).capitalize() + rng.choice([".", ".", "!", "", "?"])
    for _ in range(made):
        long = [" ".join(sentence(4, 14) for _ in range(rng.randint(1, 5))) for _ in range(6)]
        text = [("h1", sentence(2, 8))] + [(rng.choice(["p", "p", "p", "p", "li", "h2"]), rng.choice([*long, sentence(1, 3)])) for _ in range(rng.randint(1, 14))]
        add_made(text, long)
    return out


def weights(pages: DataFrame, sample: int = SAMPLE) -> dict:
    """Weights learned in one task from at most ``sample`` pages; the driver gets the weights alone."""
    def fit(batches):
        html = [page for batch in batches for page in batch.column(0).to_pylist()]
        net = learn(training(html))
        yield pa.RecordBatch.from_arrays([pa.array(list(net)), pa.array([v.astype("<f4").tobytes() for v in net.values()], pa.binary()), pa.array([list(v.shape) for v in net.values()])], ["name", "data", "shape"])

    chosen = pages.filter((F.octet_length("html") <= SAMPLE_BYTES) & F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    chosen = chosen.select("html", F.xxhash64("url", "html").alias("order")).orderBy("order", "html").limit(sample)
    # A constant row keeps the task when the sample is empty.
    rows = chosen.select("html").repartition(1).mapInArrow(fit, "name string, data binary, shape array<bigint>").collect()
    if not rows:
        return learn(training([]))
    return {r["name"]: np.frombuffer(r["data"], "<f4").reshape(r["shape"]) for r in rows}


def main_text(pages: DataFrame, net: dict | None = None, sample: int = SAMPLE) -> DataFrame:
    """(page_id, url, text, n_chars), one row for each row of pages."""
    pages = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    net = net or weights(pages, sample)

    def extract(batches):
        labeller = Labeller(net)
        for batch in batches:
            for s in range(0, batch.num_rows, 64):
                some = batch.slice(s, 64)
                blocks = [blocks_of(page) for page in some.column(2).to_pylist()]
                text = [" ".join(t for (_, t, _), p in zip(b, found, strict=True) if p >= 0.5) for b, found in zip(blocks, labeller.label(blocks), strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.mapInArrow(extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def query(spark, folder: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{folder}/pages.parquet"))

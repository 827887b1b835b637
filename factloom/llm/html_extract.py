"""Main text of web pages by site style trees: what a host's pages share in presentation and content is removed branch by branch."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, slices, written
from .url_filter import host_of

# Fixed values of HTML and of common page markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg object select button canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
NOISE_TAGS = frozenset("nav footer aside form menu dialog head".split()) | RAW
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside menu nav navbar navigation breadcrumb breadcrumbs header masthead footer notice notices cookie cookies consent alert disclaimer popup modal overlay newsletter subscribe signup comment comments disqus replies respond share sharing social related recommended widget".split()
)
#: Words of class names that say nothing themselves.
FILLER_WORDS = frozenset("area bar block body bottom box col column container content inner item items left link links list main page panel right row section site slot thread top unit wrap wrapper".split())
CONTENT_TAGS = frozenset(("article", "main"))

#: What markup says beforehand about a node, added to its importance in the style tree, which is between 0 and 1.
CONTENT, NEUTRAL, DOUBTFUL, NOISE = 1.0, 0.0, -0.35, -1.0

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(class|id|role|aria-hidden|hidden)(?=[\s=/>]|\Z)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW}
_DIGITS = re.compile(r"\d+")


@dataclass
class Element:
    tag: str
    key: int
    prior: float
    content: bool
    children: list = field(default_factory=list)


@dataclass
class Page:
    """blocks: (style node, prior, inside an article, text); children: for each style node the tags and classes of what it holds on this page."""

    blocks: list = field(default_factory=list)
    children: dict = field(default_factory=dict)


def _hash(*parts) -> int:
    return xxhash.xxh64_intdigest("\x00".join(map(str, parts))) - (1 << 63)


def _named(value: str, own: bool) -> float:
    """What a class or id says: a name made of noise words is noise; one that only holds some is noise outside an article, doubtful inside."""
    out = NEUTRAL
    for name in value.split():
        words = {w for w in re.split(r"[^a-z0-9]+", name) if w} - FILLER_WORDS
        if own:  # a header inside an article may be its own
            words -= {"header", "masthead"}
        if words and not NOISE_WORDS.isdisjoint(words):
            out = min(out, NOISE if words <= NOISE_WORDS or not own else DOUBTFUL)
    return out


def _open(tag: str, attrs: str, up: Element, markup: bool) -> tuple[Element, str]:
    name, prior = tag, NOISE if tag in NOISE_TAGS or tag == "header" and not up.content else NEUTRAL
    if attrs:
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id"):
                name += f"{'.' if key == 'class' else '#'}{_DIGITS.sub('0', value)}"
                if tag not in ("html", "body", *CONTENT_TAGS):
                    prior = min(prior, _named(value, up.content))
            elif key == "role":
                prior = NOISE if value in NOISE_ROLES else prior
            elif key == "hidden" or value == "true":
                prior = NOISE
    if not markup and tag not in RAW and tag != "head":
        prior = NEUTRAL
    content = up.content or tag in CONTENT_TAGS
    # within an article text is content, unless a name above it speaks against it
    prior = min(prior, up.prior) if min(prior, up.prior) < NEUTRAL else CONTENT if content and markup else NEUTRAL
    return Element(tag, _hash(up.key, name), prior, content and markup), name


def parse(source: str, host: str = "", markup: bool = True) -> Page:
    """Blocks of a page in order. Unclosed, crossed and missing tags are taken as browsers take them, as far as blocks go.

    A style node is known by a hash of its host and the names on its path, so depth costs nothing. Without `markup`
    names and tags say nothing, apart from what is no text at all.
    """
    page = Page()
    root = Element("", _hash(host), NEUTRAL, False)
    stack, text, live = [root], [], Counter()
    at, n = 0, len(source)

    def flush() -> None:
        if text:
            words = html.unescape("".join(text)).split()
            text.clear()
            if words:
                top = stack[-1]
                page.blocks.append((top.key, top.prior, top.content, " ".join(words)))

    def cut(i: int) -> None:
        live.subtract(e.tag for e in stack[i:])
        del stack[i:]

    def close(names: tuple, until: frozenset = frozenset()) -> None:
        if not any(live[t] for t in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                flush()
                cut(i)
                return
            if stack[i].tag in until:
                return

    while at < n:
        m = _TAG.search(source, at)
        if m is None:
            text.append(source[at:])
            break
        if m.start() > at:
            text.append(source[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        block = tag in BLOCK
        if m[1] or m[4]:
            if tag == "p" and not live["p"]:
                flush()
            elif block:
                close((tag,), frozenset(("article", "table")) - {tag})
            elif live[tag]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        cut(i)
                        break
                    if stack[i].tag in BLOCK:
                        break
            continue
        if tag == "br":
            text.append(" ")
            continue
        if block:
            flush()
            if tag not in ("html", "body"):
                close(("p",), frozenset(("td", "th", "button", "table")))
                if tag in CLOSES:
                    close(CLOSES[tag], frozenset(("ul", "ol", "dl", "table")))
        element, name = _open(tag, m[3] or m[6] or "", stack[-1], markup)
        page.children.setdefault(stack[-1].key, []).append(name)
        if tag in RAW:
            end = _END[tag].search(source, at)
            at = end.end() if end else n
        elif tag not in VOID and not (m[0].endswith("/>") and not block):
            stack.append(element)
            live[tag] += 1
    flush()
    return page


def main_blocks(blocks: list, gone: set | None = None) -> list[str]:
    """The texts that stay. blocks: (prior, inside an article, text); gone: places of blocks whose branch the style tree removes.

    If text inside an article or main element is left, only such text counts. The tree never takes all of a page.
    """
    kept = [b for i, b in enumerate(blocks) if b[0] > NOISE and not (gone and i in gone)] or [b for b in blocks if b[0] > NOISE]
    inside = [b for b in kept if b[1]]
    return [b[2] for b in (inside or kept)]


_PARSED = "chunk long, nodes array<long>, marks array<long>, shapes array<long>, flags array<int>, prior array<double>, image binary"


def _parsed(markup: bool, chunk_bytes: int):
    """A row a chunk of pages: their blocks, one after another, without those that markup shows to be noise.

    marks: hashes of node and text; shapes: hashes of what the node holds on the page; flags: 1 for the first block of its
    node on the page, 2 for the first of its mark, 3 for both. image: the pages with their texts, in Arrow's compressed form.
    """
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "html", chunk_bytes):
                cols: list[list] = [[] for _ in kinds]
                inside_of, texts, ends = [], [], [0]
                for host, source in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                    page = parse(source, host, markup)
                    known: set = set()
                    shapes = {}
                    for node, prior, inside, text in page.blocks:
                        if prior <= NOISE:
                            continue
                        mark = _hash(node, text)
                        if node not in shapes:
                            shapes[node] = _hash(*page.children.get(node, ()))
                        flag = (node not in known) + 2 * ((node, mark) not in known)
                        known |= {node, (node, mark)}
                        for c, v in zip(cols, (node, mark, shapes[node], flag, prior), strict=True):
                            c.append(v)
                        inside_of.append(inside)
                        texts.append(text)
                    ends.append(len(texts))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(c, k)) for c, k in ((cols[4], pa.float64()), (inside_of, pa.bool_()), (texts, pa.string()))]
                image = _packed(pa.record_batch([part.column("id"), part.column("url"), *lists], names=["id", "url", "prior", "inside", "texts"]))
                yield pa.record_batch([pa.array([chunk]), *(pa.array([c], pa.list_(k)) for c, k in zip(cols, kinds, strict=True)), pa.array([image], pa.binary())], names=["chunk", "nodes", "marks", "shapes", "flags", "prior", "image"])
                chunk += 1

    return run


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each page. gone: places, in its chunk, of the blocks that go."""
    for batch in batches:
        for image, gone in zip(batch.column("image"), batch.column("gone"), strict=True):
            pages = pa.ipc.open_stream(image.as_buffer()).read_next_batch()
            out = set(gone.as_py() or ())
            texts, first = [], 0
            for block in zip(*(pages.column(k).to_pylist() for k in ("prior", "inside", "texts")), strict=True):
                n = len(block[0])
                texts.append("\n\n".join(main_blocks(list(zip(*block, strict=True)), {i - first for i in range(first, first + n) if i in out} if out else None)))
                first += n
            yield pa.record_batch([pages.column("id"), pages.column("url"), pa.array(texts, pa.string()), pa.array(np.fromiter(map(len, texts), np.int64, len(texts)))], names=["id", "url", "text", "n_chars"])


def importances(blocks: DataFrame, gamma: float, pseudo: float) -> DataFrame:
    """node, mark, importance of every content node. blocks: node, mark, shape, flag of each block.

    The pages of a host are merged: elements of the same path form one style node, its texts are content nodes. With m pages
    that show a node, its presentation importance is the entropy of what it holds; a content node on n pages has importance
    1 - log n. Logarithms are to the base m + pseudo: as if `pseudo` more pages had shown something else, so that few pages
    say little, at any number. A node weighs (1 - gamma) * presentation + gamma * the mean of its content over pages; a
    content node the same with its own content, and no more than its node: a unique text in a branch that otherwise repeats goes with it.
    """
    shapes = blocks.where("flag % 2 = 1").groupBy("node", "shape").agg(F.count("*").alias("n"))
    node = shapes.groupBy("node").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    base = F.log(F.col("m") + pseudo)
    # -sum p ln p = ln m - (sum n ln n) / m; what is missing to the base is the entropy of the pseudo pages
    node = node.select("node", base.alias("base"), (1 - F.col("nlogn") / F.col("m") / base).alias("presentation"))
    texts = blocks.where("flag >= 2").groupBy("node", "mark").agg(F.count("*").alias("n")).join(node, "node")
    texts = written(texts.select("node", "mark", "n", "presentation", (1 - F.log("n") / F.col("base")).alias("content")), "contents")
    mean = texts.groupBy("node").agg((F.sum(F.col("n") * F.col("content")) / F.sum("n")).alias("mean"))
    weigh = lambda c: (1 - gamma) * F.col("presentation") + gamma * F.col(c)
    return texts.join(mean, "node").select("node", "mark", F.least(weigh("content"), weigh("mean")).alias("importance"))


def extract(
    pages: DataFrame,
    threshold: float = 0.3,
    gamma: float = 0.9,
    pseudo: float = 4.0,
    markup: bool = True,
    chunk_bytes: int = SLICE_BYTES,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """One row per page: id, url, text, n_chars.

    A block of text goes if the importance of its content node in the host's style tree, plus what markup says beforehand, is under
    `threshold`; a branch goes if all its blocks do. Markup says noise (-1: goes whatever the tree says) of menus, headers,
    footers, sidebars, notices, adverts, forms, scripts, styles, buttons, graphics and reader comments, known by tag, role or
    class; doubtful (-0.35) of names in an article that only hold such a word, as in "related-work"; content (1: stays) of all
    else in an article or main element, as what a site repeats there may be an article in copies; nothing of the rest. If
    text within an article or main element is left, only such text counts. With markup=False the tree decides alone.

    Null html, and pages without text, give an empty text; a null url, or one without host, belongs to the host "". Repeated rows
    give repeated results (and weigh twice in the tree). Texts are whole, whatever their length; nesting may be of any depth.
    Each page is parsed once; blocks, not pages, are routed to the tree's counts, and places of what goes come back to the
    chunk of pages that they are of. Chunks hold about chunk_bytes of html, or one longer page, and are compressed, so little is shuffled even
    where places of what goes are too many to broadcast.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    kind = pages.schema[id_col].dataType.simpleString()
    parsed = written(rows.mapInArrow(_parsed(markup, chunk_bytes), _PARSED), "pages", "zstd")
    zipped = F.arrays_zip("nodes", "marks", "shapes", "flags", "prior")
    blocks = parsed.select("chunk", F.posexplode(zipped).alias("pos", "b")).select("chunk", "pos", F.col("b.nodes").alias("node"), F.col("b.marks").alias("mark"), F.col("b.shapes").alias("shape"), F.col("b.flags").alias("flag"), F.col("b.prior").alias("prior"))
    # where markup decides alone, no importance is needed
    open_ = blocks.where((F.col("prior") < threshold) & (F.col("prior") + 1 >= threshold))
    low = importances(open_, gamma, pseudo).where(F.col("importance") < threshold - DOUBTFUL)
    gone = open_.join(low, ["node", "mark"]).where(F.col("importance") + F.col("prior") < threshold).groupBy("chunk").agg(F.collect_list("pos").alias("gone"))
    gone = written(gone, "gone")  # of known size: where little goes it is broadcast, and pages stay where they are
    judged = parsed.select("chunk", "image").join(gone, "chunk", "left").select("image", "gone")
    return judged.mapInArrow(_judged, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col)

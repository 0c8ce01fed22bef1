"""Main text of web pages: markup where it says what a block is, repeats across a host's pages where it does not."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import in_arrow, materialize, only, release
from .suffix import ranges, repeated_spans

#: A comment, a declaration or a tag. A quote counts only after an equals sign, and only if it is closed; the possessive form never tries a tag twice.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

#: Elements by kind.
RAW = frozenset("script style textarea title xmp iframe noframes".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CHROME = frozenset("head nav header footer aside form script style noscript template iframe noframes svg canvas object button select textarea title menu dialog xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Words of a class, id or role that mark what is not the article; and words that may stand beside them in such a name.
MARKS = frozenset("ad ads adbox adslot adunit adblock advert adverts advertisement advertising adsense sponsored sponsor promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login search share sharing social related recommended comments comment respond disqus widget complementary contentinfo pagination pager skip".split())
BESIDE = frozenset("site page main top bottom left right primary secondary global wrapper wrap container box block area section inner outer list links link bar content slot unit panel item items group holder button buttons icons form body header text thread posts articles stories bottom mobile desktop sticky fixed small large".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words that a name of readers' comments ends in, and words before them that only say whether there are any; marks that a paragraph of an article may bear by itself.
COMMENTS = frozenset("comment comments commentlist commentary respond disqus discussion".split())
STATES = frozenset("no has with without open closed allow enable enabled disable disabled".split())
SAID_OF_TEXT = frozenset("search alert share sharing social related recommended login signup skip menu promo promotion banner".split())
PARAGRAPHS = frozenset("p li blockquote td dd dt figcaption caption".split())
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|style\s*=\s*[\"'][^\"']*display\s*:\s*none", re.I)


def words_of(name: str) -> list[str]:
    return [w for w in re.split(r"[_\-]+|\d+", name) if w]


def names_comments(words: list[str]) -> bool:
    """Whether a name is that of readers' comments: its last word is one for them, whoever they are by, and the first does not only say whether there are any."""
    return bool(words) and words[-1] in COMMENTS and words[0] not in STATES


def named(name: str, marks: frozenset[str]) -> bool:
    """Whether a class, id or role is a mark: one of its words (parted by - and _) is, and the others are marks or such as stand beside them."""
    words = words_of(name)
    return names_comments(words) or any(w in marks for w in words) and all(w in marks or w in MARKS or w in BESIDE for w in words)


def marked_by_name(element: str, attributes: str) -> bool:
    """Whether class, id or role say that the element is not the article, or it is hidden. A heading's id is an anchor; an article is left out only as a comment; of paragraphs a name of one word that may as well say what they are about does not count."""
    if element in ("html", "body", "main"):
        return False
    if element != "article" and _HIDDEN.search(attributes):
        return True
    names = [name for m in _NAMES.finditer(attributes) if not (element in HEADINGS and m[1].lower() == "id") for name in (m[2] or m[3] or m[4] or "").lower().split()]
    if element == "article":
        return any(named(name, COMMENTS) for name in names)
    return any(named(name, MARKS) for name in names if not (element in PARAGRAPHS and name in SAID_OF_TEXT))


def blocks(html: str) -> tuple[list[str], list[tuple[str, bool]]]:
    """The article's blocks; and, in page order, the blocks outside it with whether markup names them as something else.

    An article is what stands in an article or main element, without parts named as something else; a form around it does not count, one in it does. White space in a block is
    one space; character references are decoded; inline elements do not part words; br is white space.
    """
    inside: list[str] = []
    outside: list[tuple[str, bool]] = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []
    opened: Counter[str] = Counter()
    chrome = main = form = False

    def flush() -> None:
        words = " ".join(unescape("".join(text)).split())
        text.clear()
        if words:
            inside.append(words) if main and not (chrome or form) else outside.append((words, chrome or form))

    at = 0
    while at < len(html):
        found = _TOKEN.search(html, at)
        if not found:
            text.append(html[at:])
            break
        text.append(html[at : found.start()])
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if name in BLOCK or name in CHROME:
            flush()
        if found[1]:
            while opened[name]:
                last, chrome, main, form = stack.pop()
                opened[last] -= 1
                if last == name:
                    break
            continue
        if name == "br":
            text.append(" ")
        if name in VOID or found[3].endswith("/") and name not in BLOCK:
            continue
        stack.append((name, chrome, main, form))
        opened[name] += 1
        chrome = chrome or name != "form" and name in CHROME or bool(found[3]) and marked_by_name(name, found[3])
        if name in ("article", "main"):
            main, form = True, form and main
        form = form or name == "form"
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(html, at)
            at = end.start() if end else len(html)
    flush()
    return inside, outside


def host_of(url: Column) -> Column:
    """What stands between the first `://` and the next `/`, `?` or `#`, lower-cased; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def codes(host: str, parts: list[tuple[str, bool]]) -> bytes:
    """Four bytes for each word of the parts, mixed with the host: words of different hosts do not match."""
    salt = zlib.crc32(host.encode("utf-8", "surrogatepass"))
    return np.array([zlib.crc32(w.encode("utf-8", "surrogatepass"), salt) for p, _ in parts for w in p.split()], ">u4").tobytes()


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", words: int = 8) -> DataFrame:
    """A row for each row of pages: page_id, url, text (blocks joined by one newline; empty if none), n_chars (code points), n_repeated (words
    outside an article that stand in runs repeated on the host).

    Every page's blocks outside of an article form its token stream; the streams of all pages of a host are sorted as suffixes, and runs of
    `words` words that stand in two distinct pages of it are boilerplate. Each page is then judged by its runs and its markup: on a page without an
    article, blocks that markup does not name keep the words not covered by such runs. Blocks of an article or main element are the text, without menus,
    headers, footers, asides, forms, scripts, styles and parts whose class, id or role names them as adverts, notices, comments and the like; an
    article is never cut by repeats, since copies of a whole article are no boilerplate, so its words are not in the streams.

    Streams are sorted around shared anchors (see suffix.repeated_spans), so a host with a third of all pages is dealt over all
    tasks. Pages are parsed twice, so that only streams are stored, not texts. A null html is empty and gives an empty text; a null url is carried and
    is the empty host; ids, null or repeated, are carried; an empty table gives no rows.
    """
    kind = dict(pages.dtypes)[id_col]
    rows = only(pages, id_col, url_col, html_col).withColumn("host", host_of(F.col(f"`{url_col}`")))

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield {"page_id": batch.column(0), "stream": [codes(host, blocks(page or "")[1]) for host, page in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True)]}

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out: dict = {"inside": [], "parts": [], "stream": []}
            for host, page in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True):
                inside, outside = blocks(page or "")
                undecided = not inside and any(not c for _, c in outside)
                out["inside"].append("\n".join(inside))
                # where markup decides, only the blocks' sizes are looked at again
                out["parts"].append([{"text": p if undecided else None, "size": len(p.split()), "chrome": c} for p, c in outside])
                out["stream"].append(codes(host, outside))
            yield {"page_id": batch.column(0), "url": batch.column(1)} | out

    outside = materialize(in_arrow(rows, streams, f"page_id {kind}, stream binary"))
    found = repeated_spans(outside, "page_id", "stream", 4 * words, apart=True).select(F.col("doc_id").alias("s_id"), F.col("text_hash").alias("s_hash"), "spans")
    release(pages.sparkSession, outside)
    read = in_arrow(rows, parsed, f"page_id {kind}, url string, inside string, parts array<struct<text:string,size:int,chrome:boolean>>, stream binary").withColumn("hash", F.xxhash64("stream")).drop("stream")
    judged = read.join(found.hint("merge"), F.col("page_id").eqNullSafe(F.col("s_id")) & (F.col("hash") == F.col("s_hash")), "left").select("page_id", "url", "inside", "parts", "spans")

    def unique(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            texts, repeats = [], []
            for inside, parts, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                covered = {k for s in spans or () for k in range(-(-s["start"] // 4), s["end"] // 4)}
                at, left, repeat = 0, [inside] if inside else [], 0
                for part in parts:
                    n = part["size"]
                    # a run that only reaches into a block from its neighbour says nothing of the block's own words, unless it covers all of them
                    gone = np.array([k in covered for k in range(at, at + n)])
                    for lo, hi in zip(*ranges(gone), strict=True):
                        gone[lo:hi] = hi - lo >= min(words, n)
                    repeat += int(gone.sum())
                    if part["text"] and not part["chrome"] and (text := " ".join(w for w, g in zip(part["text"].split(), gone.tolist(), strict=True) if not g)):
                        left.append(text)
                    at += n
                texts.append("\n".join(left))
                repeats.append(repeat)
            yield {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_repeated": repeats}

    verdicts = in_arrow(judged, unique, f"page_id {kind}, url string, text string, n_repeated long")
    return verdicts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_repeated")

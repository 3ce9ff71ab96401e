"""Main text of web pages by equivalence-class template deduction.

Template tokens are tags named by their place in the page (containers above them with their classes).  Over all pages
of a host, tokens with the same occurrence vector (which page has them how often) form an equivalence class.  Classes
that are common enough on the host are valid; nested by place they are the host's template, and what they enclose are
its slots.  A slot's text is summed over the host, without links and without what stands in noise containers; the slots
of the richest article-like place are extracted from every page, the rest of the template is dropped.

An occurrence vector is carried as its size and an order-free checksum, so a host with a third of all pages is
aggregated partially like any other; only a template (one row for each host, bounded by the tokens a page can have) is
joined back to the pages.  A page that has none of its host's slots, or whose
host has none, is extracted by its own tokens alone.

Defined results: null and empty pages give empty text; pages without a host share one template; repeated rows get
equal results; a page without an article slot, in its host's template and by itself, gives the text outside all noise containers.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import stored

COMMON = 10  #: a token belongs to the template if at least one page in so many has it
MOST_DEPTH = 12  #: containers that name a place, counted from the root
# Elements by their role in HTML.
CONTAINERS = frozenset("html body main article section div header footer nav aside form figure ul ol dl table "
                       "blockquote details dialog menu".split())
BLOCKS = CONTAINERS | frozenset("address p h1 h2 h3 h4 h5 h6 li dt dd pre tr td th thead tbody tfoot caption hr "
                                "figcaption fieldset legend summary hgroup search".split())
RAW = frozenset("script style noscript template textarea title iframe svg math canvas object select option "
                "button".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
NOISE_TAGS = frozenset("nav header footer aside form menu dialog head".split())
NOISE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment "
                        "comments cookie cookies disclaimer footer header menu nav navbar navigation newsletter "
                        "notice notices popup promo promoted promotion related share sharing sidebar social sponsor "
                        "sponsored subscribe widget".split())
ARTICLE_TAGS = frozenset("article main".split())
ARTICLE_WORDS = frozenset("article content entry main post story".split())

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<!--(?:.*?-->|.*)|<[!?][^>]*>"""
                 r"""|<(/?)([a-zA-Z][^\s/>]*+)[^>]*>""", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
WORD = re.compile(r"[a-z]+")


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, attributes or text): kind is open, close or text; raw elements and comments are left out."""
    at = 0
    lower = None
    for_raw: dict[str, bool] = {}
    while True:
        m = TAG.search(page, at)
        if not m:
            yield "text", "", page[at:]
            return
        if m.start() > at:
            yield "text", "", page[at:m.start()]
        at = m.end()
        name = (m.group(2) or m.group(5) or "").lower()
        if not name:
            continue
        if m.group(1) or m.group(4):
            yield "close", name, ""
        elif name in RAW and not (m.group(3) or "").endswith("/"):
            if lower is None:
                lower = page.lower()
                lower = lower if len(lower) == len(page) else re.sub("[A-Z]", lambda x: x.group().lower(), page)
            end = -1 if for_raw.get(name) else lower.find(f"</{name}", at)
            if end < 0:
                for_raw[name] = True  # none further on either
                if name in ("script", "style", "textarea", "title"):
                    return
                continue
            close = page.find(">", end)
            at = len(page) if close < 0 else close + 1
            if name not in ("script", "style"):
                yield "text", "", " "
        else:
            yield "open", name, m.group(3) or ""


def _named(name: str, attributes: str) -> str:
    """The tag with the words of its class, id and role; digits don't count."""
    if not attributes or "=" not in attributes:
        return name
    words = sorted({w for v in NAMES.findall(attributes) for w in WORD.findall(v.lower())})
    return ".".join([name, *words])


def is_noise(token: str) -> bool:
    name, *words = token.split(".")
    return name in NOISE_TAGS or not NOISE_WORDS.isdisjoint(words)


def is_article(token: str) -> bool:
    name, *words = token.split(".")
    return name in ARTICLE_TAGS or not ARTICLE_WORDS.isdisjoint(words)


def walk(page: str) -> Iterator[tuple[str, str, tuple[str, ...], bool]]:
    """(kind, token or text, containers around it, whether a link is open)."""
    stack: list[str] = []
    names: list[str] = []
    links = 0
    for kind, name, rest in events(page):
        if kind == "text":
            yield "text", rest, tuple(stack), links > 0
        elif name == "a":
            links = 1 if kind == "open" else 0
        elif name in CONTAINERS or name == "head":
            if kind == "open":
                token = _named(name, rest)
                yield "open", token, tuple(stack), False
                if name == "body" and "head" in names:
                    cut = names.index("head")
                    del names[cut:], stack[cut:]
                stack.append(token)
                names.append(name)
            elif name in names:
                cut = len(names) - 1 - names[::-1].index(name)
                yield "close", stack[cut], tuple(stack[:cut]), False
                del names[cut:], stack[cut:]
        elif kind == "open":
            yield ("block" if name in BLOCKS else "break" if name == "br" else "inline"), name, tuple(stack), False
        else:
            yield ("block" if name in BLOCKS else "inline"), name, tuple(stack), False


def place(stack: tuple[str, ...]) -> str:
    return "/".join(stack[:MOST_DEPTH])


def tokens_of(page: str) -> dict[str, list[int]]:
    """Of each place of the page: how often it occurs, and the characters of plain text directly or deeper in it."""
    found: dict[str, list[int]] = {}
    for kind, value, stack, linked in walk(page):
        if kind == "open" and len(stack) < MOST_DEPTH:
            found.setdefault(place((*stack, value)), [0, 0])[0] += 1
        elif kind == "text" and not linked and not any(map(is_noise, stack)):
            size = len(value.split())
            for i in range(1, min(len(stack), MOST_DEPTH) + 1) if size else ():
                key = place(stack[:i])
                if key in found:
                    found[key][1] += size
    return found


def main_text(page: str, slots: list[str]) -> str | None:
    """Blocks of the slots of a page, joined by an empty line; None if the page has none of the slots."""
    wanted = set(slots)
    seen = not wanted
    blocks, now = [], []

    def close() -> None:
        text = " ".join(entities.unescape("".join(now)).split())
        if text:
            blocks.append(text)
        now.clear()

    for kind, value, stack, _ in walk(page):
        if kind in ("open", "close", "block"):
            close()
            seen = seen or kind == "open" and place((*stack, value)) in wanted
        elif kind == "break":
            now.append(" ")
        elif kind == "text" and not any(map(is_noise, stack)):
            if not wanted or any(place(stack[:i]) in wanted for i in range(1, len(stack) + 1)):
                now.append(value)
    close()
    return "\n\n".join(blocks) if seen else None


def page_text(page: str, slots: list[str]) -> str:
    """Main text by the host's template, or by the page's own tokens if it follows another layout or the host has none."""
    text = main_text(page, slots) if slots else None
    if text is None:
        own = [{"token": t, "pages": 1, "words": n, "vector": 0} for t, (_, n) in tokens_of(page).items()]
        text = main_text(page, _slots(own))
    return text or ""


def tokens(column: Column) -> Column:
    @F.arrow_udf("array<struct<token:string,times:int,words:long>>")
    def scan(pages: pa.Array) -> pa.Array:
        token, times, size, offsets = [], [], [], [0]
        for page in pages:
            for name, (n, chars) in tokens_of(page.as_py() or "").items():
                token.append(name)
                times.append(n)
                size.append(chars)
            offsets.append(len(token))
        rows = pa.StructArray.from_arrays([pa.array(token, pa.string()), pa.array(times, pa.int32()),
                                           pa.array(size, pa.int64())], names=["token", "times", "words"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)

    return scan(column)


def host_of(url: str) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def _slots(template: list[dict]) -> list[str]:
    """Places to extract: the outermost article-like place of the class with most text."""
    valid = {t["token"]: t for t in template}
    articles = []
    for token in valid:
        stack = token.split("/")
        if is_article(stack[-1]) and not any(map(is_noise, stack)) and not any(map(is_article, stack[:-1])):
            articles.append(token)
    # Real article elements before containers that are only named so.
    for level in (lambda t: t.split("/")[-1].split(".")[0] == "article" or any(
            x.startswith(t + "/") and x.split("/")[-1].split(".")[0] == "article" for x in valid), lambda t: True):
        some = [t for t in articles if level(t) and valid[t]["words"] > 0]
        if some:
            inner = [x for t in some for x in valid if x.startswith(t + "/")
                     and x.split("/")[-1].split(".")[0] == "article"]
            classes: dict[int, int] = {}
            for t in inner or some:
                classes[valid[t]["vector"]] = classes.get(valid[t]["vector"], 0) + valid[t]["words"]
            best = max(classes, key=lambda v: (classes[v], v))
            chosen = inner or some
            # Other article classes belong to the same slot if they hold as much per page; alternatives of a layout do.
            rich = max(valid[t]["words"] / max(1, valid[t]["pages"]) for t in chosen if valid[t]["vector"] == best)
            return [t for t in chosen if 10 * valid[t]["words"] >= rich * valid[t]["pages"]]
    return []


def templates(pages: DataFrame) -> DataFrame:
    """host, slots: the places to extract on each host's pages."""
    rows = pages.select("host", F.xxhash64("html").alias("page"), F.explode(tokens(F.col("html"))).alias("t"))
    vectors = stored(rows.groupBy("host", "t.token").agg(
        F.count("*").alias("pages"), F.sum("t.words").alias("words"),
        F.bit_xor(F.xxhash64("page", "t.times")).alias("vector")), "page-tokens")
    sizes = vectors.groupBy("host").agg(F.max("pages").alias("host_pages"))
    valid = vectors.join(sizes, "host").where(F.col("pages") * COMMON >= F.col("host_pages"))
    listed = valid.groupBy("host").agg(F.collect_list(F.struct("token", "pages", "words", "vector")).alias("template"))

    @F.arrow_udf("array<string>")
    def chosen(found: pa.Array) -> pa.Array:
        return pa.array([_slots(x) for x in found.to_pylist()], pa.list_(pa.string()))

    return stored(listed.select("host", chosen(F.col("template")).alias("slots")), "templates")


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    read = pages.select("page_id", "url", "html", host_of("url").alias("host"))

    @F.arrow_udf("string")
    def texts(page: pa.Array, slots: pa.Array) -> pa.Array:
        return pa.array([page_text(p.as_py() or "", s.as_py() or []) for p, s in zip(page, slots, strict=True)],
                        pa.string())

    found = read.join(templates(read), "host", "left")
    return (found.select("page_id", "url", texts(F.col("html"), F.col("slots")).alias("text"))
            .withColumn("n_chars", F.char_length("text").cast("long")))

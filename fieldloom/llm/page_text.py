"""HTML extraction by nearest-URL page differencing.

Every page is cut into text lines, its blocks, once. The different pages of a host (equal line lists are one page) are
sorted by URL path; each is paired with the neighbour whose path is nearer by edit distance, their lines are aligned by a
longest common subsequence of line hashes, and shared lines, the host's template, are deleted. Lines within menus, headers,
footers, sidebars, notices, adverts, forms and reader comments never count as text, and where a page marks its article
(article, main or role=main), neither do lines outside it.

Two articles may quote the same passage, which differencing alone would lose. So within a marked article shared lines are
deleted only where they are template: short lines (at most template_words words) outside paragraphs, headings, quotations
and tables, in an unbroken run from the article's first or last line on, which both neighbours by path share in order, in
articles that share less than half of their words. Without such marks every shared line goes.

Neighbours are found on slim rows dealt by range over (host, path), so that one host may span many tasks; tasks exchange
their edge rows only. What is joined are line hashes, not pages.

Defined results: null html gives an empty text; a null url is of the empty host; equal pages of a host are paired as the
first of them by path; equal paths are ordered by the pages' lines; a page alone on its host, or beside equal pages only,
keeps all its lines; rows that repeat a page_id are pages of their own; an empty table gives an empty one; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import broadcast_if_small, materialize, tidy

#: Elements whose content is no text of the page.
DROPPED = frozenset("nav header footer aside form button select textarea noscript iframe template dialog svg math canvas object menu title".split())
#: Words of class, id and role that mark such elements.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar "
    "header footer masthead cookie cookies consent notice notices newsletter subscribe popup modal overlay share sharing social related comment comments "
    "respond disqus contentinfo complementary search login signup copyright".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol option optgroup p pre section summary table tbody td tfoot th thead title tr ul video audio".split()
)
#: Elements whose lines are prose of an article, never its template.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table caption tr td th dt dd figcaption".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest2>[^>]*)(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORD = re.compile(r"[a-z0-9]+")
_WHITE = re.compile(r"\s+")


def page_lines(source: str | None) -> tuple[list[tuple[str, bool, bool, bool]], bool]:
    """The page's lines as (text, within a dropped element, within the article, prose), and whether it marks an article."""
    lines: list[tuple[str, bool, bool, bool]] = []
    block = ""  # the block element whose start or end came last, empty after an end
    held: list[str] = []
    dropped: list[str] = []  # open elements from the outermost dropped one on, by name
    main: list[str] = []
    marked = False
    at = 0
    source = source or ""
    closes: dict[str, int] = {}  # where an element is closed last

    def flush():
        text = _WHITE.sub(" ", html.unescape("".join(held))).strip()
        held.clear()
        if text:
            lines.append((text, bool(dropped), bool(main), block in PROSE))

    def last_close(name):
        if name not in closes:
            closes[name] = max((m.start() for m in re.finditer("</" + re.escape(name), source, re.I)), default=-1)
        return closes[name]

    for token in _TOKEN.finditer(source):
        if token.start() > at:
            held.append(source[at : token.start()])
        at = token.end()
        name = (token["name"] or token["name2"] or "").lower()
        if not name:
            if token["raw"] is None and not token[0].startswith("<!--"):
                flush()  # a doctype or processing instruction
            continue
        end, rest = token["end"] or token["end2"], token["rest"] or token["rest2"] or ""
        if name == "br":
            held.append(" ")
            continue
        if name not in BLOCKS and name not in DROPPED and not rest and not dropped:
            continue
        inside = name in BLOCKS or name in DROPPED
        words = {} if end or not rest else {k.lower(): set(_WORD.findall(v.lower())) for k, v in _ATTRIBUTE.findall(rest)}
        is_main = name in ("article", "main") or "main" in words.get("role", ())
        drops = name in DROPPED or (name not in ("html", "body", "article", "main") and any(v & MARKS for v in words.values()))
        if inside or drops:
            flush()
            block = "" if end else name
        if end:
            if name in dropped:
                del dropped[len(dropped) - 1 - dropped[::-1].index(name) :]
            elif name in main:
                del main[len(main) - 1 - main[::-1].index(name) :]
        elif name in _VOID or rest.rstrip().endswith("/"):
            pass
        elif dropped and is_main and not main and last_close(dropped[0]) < at:
            dropped.clear()  # a dropped element that is never closed ends where the article begins
            main.append(name)
            marked = True
        elif dropped:
            if name == dropped[0] or drops:
                dropped.append(name)
        elif drops:
            dropped.append(name)
        elif is_main:
            main.append(name)
            marked = True
    held.append(source[at:])
    flush()
    return lines, marked


_KEPT_BYTES = 32 << 20  # of bit rows that one alignment keeps


def _bit_rows(a: list[int], b: list[int]):
    """Bit rows of the longest common subsequence of a's prefixes with b: bit j is 0 where b[j] adds to its length."""
    places: dict[int, list[int]] = {x: [] for x in a}
    for j, x in enumerate(b):
        if x in places:
            places[x].append(j)
    # masks of frequent lines are kept, those of the many rare ones made when needed
    masks = {x: sum(1 << j for j in js) for x, js in places.items() if len(js) > 8}
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & (masks[x] if x in masks else sum(1 << j for j in places[x]))
        row = ((row + hit) | (row - hit)) & full
        yield row


def _lengths(row: int, n: int) -> list[int]:
    """Common lengths with all prefixes of b, from the empty one on."""
    out, bits = [0], bin(row | 1 << n)[:2:-1]  # from the lowest bit on
    for c in bits:
        out.append(out[-1] + (c == "0"))
    return out


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in a of one longest common subsequence with b.

    Bit rows take a machine word for 64 lines of b at once, so time is the product of the lengths by 64, whatever repeats;
    where the rows of all of a would be large, a is halved and b cut where the halves' lengths add up to the most."""
    lo, na, nb = 0, len(a), len(b)
    while lo < na and lo < nb and a[lo] == b[lo]:
        lo += 1
    tail = 0
    while tail < na - lo and tail < nb - lo and a[na - 1 - tail] == b[nb - 1 - tail]:
        tail += 1
    head, end = [*range(lo)], [*range(na - tail, na)]
    a, b = a[lo : na - tail], b[lo : nb - tail]
    if not a or not b:
        return head + end
    if len(a) > 1 and len(a) * (len(b) // 8 + 32) > _KEPT_BYTES:
        half = len(a) // 2
        for first in _bit_rows(a[:half], b):
            pass
        for last in _bit_rows(a[half:][::-1], b[::-1]):
            pass
        x, y = _lengths(first, len(b)), _lengths(last, len(b))[::-1]
        cut = max(range(len(b) + 1), key=lambda j: x[j] + y[j])
        middle = common_lines(a[:half], b[:cut]) + [half + k for k in common_lines(a[half:], b[cut:])]
    else:
        width = len(b) // 8 + 1
        rows = [r.to_bytes(width, "little") for r in _bit_rows(a, b)]
        middle, i, j = [], len(a), len(b)
        while i and j:
            if rows[i - 1][j - 1 >> 3] >> (j - 1 & 7) & 1:
                j -= 1
                continue
            i -= 1
            if not i or rows[i - 1][j - 1 >> 3] >> (j - 1 & 7) & 1:
                middle.append(i)
                j -= 1
        middle.reverse()
    return head + [lo + k for k in middle] + end


def text_of(lines: list[tuple[str, bool, bool, bool]], marked: bool, shared: set[int], both: set[int] = frozenset(), template_words: int = 8) -> str:
    """The text of page_lines, without shared lines (positions shared with the nearer neighbour, and with both)."""
    kept = [k for k, (_, dropped, main, _) in enumerate(lines) if not dropped and (main or not marked)]
    if not marked:
        return "\n".join(lines[k][0] for k in kept if k not in shared)
    words = {k: len(lines[k][0].split()) for k in kept}
    if 2 * sum(words[k] for k in kept if k in both) < sum(words.values()):
        is_template = lambda k: k in both and not lines[k][3] and words[k] <= template_words
        lo, hi = 0, len(kept)
        while lo < hi and is_template(kept[lo]):
            lo += 1
        while hi > lo and is_template(kept[hi - 1]):
            hi -= 1
        kept = kept[lo:hi]
    return "\n".join(lines[k][0] for k in kept)


def cut_pages(pages: DataFrame) -> DataFrame:
    """row, page_id, url, host, path, page (a hash of the lines), hashes (of the lines), lines, dropped, main, prose
    (arrays) and marked of every row; one parse a page."""

    @tidy
    def run(batches):
        for batch in batches:
            made = {c: [] for c in ("page", "hashes", "lines", "dropped", "main", "prose", "marked")}
            for source in batch.column("html"):
                lines, marked = page_lines(source.as_py())
                digests = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest() for t, *_ in lines]
                made["page"].append(hashlib.blake2b(b"".join(digests), digest_size=8).digest())
                made["hashes"].append([int.from_bytes(d, "little", signed=True) for d in digests])
                for c, x in zip(("lines", "dropped", "main", "prose"), zip(*lines, strict=True) if lines else ((),) * 4, strict=True):
                    made[c].append(list(x))
                made["marked"].append(marked)
            made["page"] = [int.from_bytes(d, "little", signed=True) for d in made["page"]]
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), *[pa.list_(pa.bool_())] * 3, pa.bool_())
            names = [c for c in batch.schema.names if c != "html"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(x, k) for x, k in zip(made.values(), kinds, strict=True))], names=[*names, *made])

    url = F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(url, "://([^/?#]*)", 1))
    path = F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), path.alias("path"), "html")
    return rows.mapInArrow(run, "row long, page_id long, url string, host string, path string, page long, hashes array<long>, lines array<string>, dropped array<boolean>, main array<boolean>, prose array<boolean>, marked boolean")


def neighbours(cut: DataFrame, furthest: int = 64) -> DataFrame:
    """host, page, near, other: of every different page of a host the neighbour whose path is nearest by edit distance among
    the two next in order (distances beyond furthest are alike, the one before is taken), and the other one, or null."""
    slim = cut.groupBy("host", "page").agg(F.min("path").alias("path"))
    slim = slim.repartitionByRange("host", "path", "page").withColumn("part", F.spark_partition_id())
    slim = materialize(slim, "paths")
    row = F.struct("host", "path", "page")
    edges = slim.groupBy("part").agg(F.min(row).alias("first"), F.max(row).alias("last"))  # two rows of each task
    over = Window.orderBy("part")
    edges = edges.select("part", F.lag("last").over(over).alias("before"), F.lead("first").over(over).alias("after"))
    inner = Window.partitionBy("part").orderBy("host", "path", "page")
    found = slim.select("*", F.lag(row).over(inner).alias("p"), F.lead(row).over(inner).alias("n")).join(F.broadcast(edges), "part")
    found = found.select("host", "path", "page", F.coalesce("p", "before").alias("p"), F.coalesce("n", "after").alias("n"))
    other = lambda c: F.when(F.col(f"{c}.host") == F.col("host"), F.col(c))
    found = found.withColumns({"p": other("p"), "n": other("n")})

    def far(c):
        steps = F.levenshtein("path", F.coalesce(F.col(f"{c}.path"), F.lit("")), furthest)
        return F.when(steps < 0, furthest + 1).otherwise(steps)

    before = F.col("n").isNull() | (F.col("p").isNotNull() & (far("p") <= far("n")))
    near, rest = F.when(before, F.col("p.page")).otherwise(F.col("n.page")), F.when(before, F.col("n.page")).otherwise(F.col("p.page"))
    return found.select("host", "page", near.alias("near"), rest.alias("other")).where("near is not null")


def shared_lines(cut: DataFrame) -> DataFrame:
    """host, page, shared, both: of every different page of a host the positions of the lines that it shares, in order,
    with its nearer neighbour, and with both."""
    lines = cut.groupBy("host", "page").agg(F.first("hashes").alias("hashes"))  # equal in all rows of a page
    lines = materialize(lines, "lines")
    pairs = lines.join(neighbours(cut), ["host", "page"])
    for c in ("near", "other"):
        pairs = pairs.join(lines.select("host", F.col("page").alias(c), F.col("hashes").alias(f"{c}_hashes")), ["host", c], "left")

    @tidy
    def align(batches):
        for batch in batches:
            shared, both = [], []
            for x, y, z in zip(*(batch.column(c).to_pylist() for c in ("hashes", "near_hashes", "other_hashes")), strict=True):
                found = common_lines(x, y)
                shared.append(found)
                both.append(sorted(set(found) & set(common_lines(x, z))) if found and z else [])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("page"), pa.array(shared, kind), pa.array(both, kind)], names=["host", "page", "shared", "both"])

    found = pairs.select("host", "page", "hashes", "near_hashes", "other_hashes").mapInArrow(align, "host string, page long, shared array<int>, both array<int>")
    return found.where(F.size("shared") > 0)


def extract_pages(pages: DataFrame, template_words: int = 8, limit: int = 500_000) -> DataFrame:
    """page_id, url, text of every page. The shared lines are broadcast while they are at most limit rows, else joined."""
    cut = materialize(cut_pages(pages), "pages")
    shared = materialize(shared_lines(cut), "shared")
    rows = cut.drop("hashes", "path").join(broadcast_if_small(shared, limit=limit), ["host", "page"], "left")

    @tidy
    def run(batches):
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("lines", "dropped", "main", "prose", "marked", "shared", "both"))
            texts = [text_of(list(zip(t, d, m, p, strict=True)), marked, set(s or ()), set(b or ()), template_words) for t, d, m, p, marked, s, b in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return rows.select("page_id", "url", "lines", "dropped", "main", "prose", "marked", "shared", "both").mapInArrow(run, "page_id long, url string, text string")

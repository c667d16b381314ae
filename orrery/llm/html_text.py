"""Main text of web pages, by differences between pages with neighbouring URLs.

Pages of a host are put in the order of their URL paths. Each page is paired with the neighbour
whose path shares the longer beginning with its own; the lines of both (the text of one block
each) are aligned by their longest common subsequence, and what the two share is boilerplate.

Two guards make the result right where differences alone can't: a page whose neighbour has
mostly the same lines is a copy of it, so nothing is deleted for that pair; and what the markup
itself marks as surroundings goes whether it is shared or not, as does all that stands outside
the article on a page that marks one. Inside the article the differences decide.

Only digests of lines travel to the pairing; pages are joined to the few lines that the
differences delete, and their html is never moved for it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from os.path import commonprefix
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.shared import Names, documents, spool, struct_of, without

ADDED = ["text", "n_chars"]
#: Pages in URL order are paired within runs of this many, which one task holds as digests; a run also sees the page before and the page after it.
RUN_PAGES = 256
#: Cells of the table that aligns lines; longer pages are halved first.
TABLE_CELLS = 1 << 20
#: A pair that shares more than this part of the longer page's main lines is a pair of copies.
COPY_SHARE = 0.8
#: Elements whose content is not text, or not the main text.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object"}
CHROME = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "head"}
#: Words in a class, id or role that mark an element as no part of the main text.
CHROME_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|complementary|contentinfo|cookies?|consent|disclaimer|footer|header|"
    r"login|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|popup|promo\w*|related|replies|search|share|sharing|sidebar|"
    r"signup|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])",
    re.I,
)
LANDMARKS = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q",
    "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")


def _marked(attributes: str) -> bool:
    return any(CHROME_WORDS.search(a or b or c) for a, b, c in _MARKS.findall(attributes)) if "=" in attributes else False


def blocks(html: str) -> list[tuple[str, bool, bool]]:
    """The page's lines in order: text, whether it is in a landmark, whether in chrome.

    A chrome element ends with its own end tag, or with that of an element around it. Tags that
    are never closed don't matter otherwise.
    """
    found: list[tuple[str, bool, bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, str]] = []  # open elements that count: name, kind
    inside = {"landmark": 0, "chrome": 0}

    def flush() -> None:
        text = _SPACE.sub(" ", unescape("".join(parts))).strip()
        parts.clear()
        if text:
            found.append((text, inside["landmark"] > 0, inside["chrome"] > 0))

    at = 0
    for m in _TAG.finditer(html):
        if m.start() < at:
            continue
        closing, name = m[1], (m[2] or "").lower()
        parts.append(html[at : m.start()])
        at = m.end()
        if not name or name in INLINE and not (name in ("a", "span") and stack and stack[-1][0] == name):
            if name in INLINE and not closing and _marked(m[3]):
                flush()
                stack.append((name, "chrome"))
                inside["chrome"] += 1
            elif name in INLINE and closing and stack and stack[-1][0] == name:
                flush()
                inside[stack.pop()[1]] -= 1
            continue
        flush()
        if closing:
            if any(n == name for n, _ in stack):
                while True:
                    n, kind = stack.pop()
                    if kind in inside:
                        inside[kind] -= 1
                    if n == name:
                        break
        elif name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
        elif name not in VOID and not m[3].rstrip().endswith("/"):
            kind = "chrome" if name in CHROME or _marked(m[3]) else "landmark" if name in LANDMARKS else ""
            if kind or any(n == name for n, _ in stack):
                stack.append((name, kind))
                if kind:
                    inside[kind] += 1
    parts.append(html[at:])
    flush()
    return found


def main_lines(lines: list[tuple[str, bool, bool]]) -> list[int]:
    """Places of the lines of the landmarks, or of the whole page if it has none, less chrome."""
    marked = any(mark and not chrome for _, mark, chrome in lines)
    return [i for i, (_, mark, chrome) in enumerate(lines) if not chrome and (mark or not marked)]


def main_text(html: str, deleted: frozenset[int] = frozenset()) -> str:
    """The main lines less what is deleted."""
    lines = blocks(html)
    return " ".join(lines[i][0] for i in main_lines(lines) if i not in deleted)


def _row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of a with each beginning of b."""
    row = np.zeros(len(b) + 1, dtype=np.int32)
    for x in a:
        row[1:] = np.where(b == x, row[:-1] + 1, row[1:])
        np.maximum.accumulate(row, out=row)
    return row


def _aligned(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Places in a of a longest common subsequence with b: by a table, or halved until one is small enough."""
    if not len(a) or not len(b):
        return []
    if len(a) == 1:
        return [0] if (b == a[0]).any() else []
    if len(a) * len(b) > TABLE_CELLS:
        half = len(a) // 2
        k = int(np.argmax(_row(a[:half], b) + _row(a[half:][::-1], b[::-1])[::-1]))
        return [*_aligned(a[:half], b[:k]), *(half + i for i in _aligned(a[half:], b[k:]))]
    table = np.zeros((len(a) + 1, len(b) + 1), dtype=np.int32)
    for i in range(len(a) - 1, -1, -1):
        np.maximum(table[i + 1, :-1], np.where(b == a[i], table[i + 1, 1:] + 1, 0), out=table[i, :-1])
        table[i] = np.maximum.accumulate(table[i, ::-1])[::-1]
    found, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j] and table[i, j] == table[i + 1, j + 1] + 1:
            found.append(i)
            i, j = i + 1, j + 1
        elif table[i + 1, j] >= table[i, j + 1]:
            i += 1
        else:
            j += 1
    return found


def common_subsequence(a: list, b: list) -> list[int]:
    """Places in a of a longest common subsequence with b. Memory grows with the lines, not with their product."""
    both = {x: k for k, x in enumerate(set(a) & set(b))}
    at_a, at_b = [i for i, x in enumerate(a) if x in both], [j for j, x in enumerate(b) if x in both]
    low, tail = 0, 0
    while low < min(len(at_a), len(at_b)) and a[at_a[low]] == b[at_b[low]]:
        low += 1
    while tail < min(len(at_a), len(at_b)) - low and a[at_a[-1 - tail]] == b[at_b[-1 - tail]]:
        tail += 1
    mid_a, mid_b = at_a[low : len(at_a) - tail], at_b[low : len(at_b) - tail]
    middle = _aligned(*(np.array([both[lines[i]] for i in at], dtype=np.int64) for lines, at in ((a, mid_a), (b, mid_b))))
    return [*at_a[:low], *(mid_a[i] for i in middle), *at_a[len(at_a) - tail :]]


def address(url: str | None) -> tuple[str, str]:
    """Host and path; a URL that can't be read is a path of no host."""
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").lower(), parts.path
    except ValueError:
        return "", url or ""


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page: its address, 8 bytes for each of its lines that are no chrome, their places, and the places of its main lines."""
    for batch in batches:
        hosts, paths, lines, places, main = [], [], [], [], []
        for url, html in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            host, path = address(url)
            found = blocks(html or "")
            hosts.append(host)
            paths.append(path)
            places.append([i for i, (_, _, chrome) in enumerate(found) if not chrome])
            lines.append(b"".join(xxhash.xxh3_64_digest(found[i][0].encode(errors="replace")) for i in places[-1]))
            main.append(main_lines(found))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(x, t) for x, t in zip((hosts, paths, lines, places, main), (None, None, pa.binary(), *[pa.list_(pa.int32())] * 2)))],
            ["rid", "host", "path", "lines", "places", "main"],
        )


def _shared(table: pa.Table) -> pa.Table:
    """Of a run of pages in URL order: the places of the lines each shares with its neighbour."""
    rows = sorted(table.to_pylist(), key=lambda r: r["rank"])
    keys = [[r["lines"][i : i + 8] for i in range(0, len(r["lines"]), 8)] for r in rows]
    main = [[k for k, i in zip(ks, r["places"]) if i in own] for r, ks in zip(rows, keys) for own in [set(r["main"])]]
    rids, deleted = [], []
    for i, row in enumerate(rows):
        if not row["own"]:
            continue  # the page before or after the run, a neighbour only
        beside = [k for k in (i - 1, i + 1) if 0 <= k < len(rows) and rows[k]["host"] == row["host"]]
        if not beside or not keys[i]:
            continue
        other = max(beside, key=lambda k: len(commonprefix([row["path"], rows[k]["path"]])))
        common = common_subsequence(keys[i], keys[other])
        if common and len(common_subsequence(main[i], main[other])) <= COPY_SHARE * max(len(main[i]), len(main[other])):
            rids.append(row["rid"])
            deleted.append([row["places"][j] for j in common])
    return pa.table({"rid": pa.array(rids, pa.int64()), "deleted": pa.array(deleted, pa.list_(pa.int32()))})


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h or "", frozenset(d or ())) for h, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        counts = pa.array([len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), counts, batch.column(2)], [*ADDED, "row"])


def extract_text(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Every row of pages, less its html, with text and n_chars.

    pages has to be a stored table. A null html counts as empty and gives an empty text; a null
    URL is of no host. Repeated rows are copies of each other, and no lines go for that. Columns
    of pages named like an added column, in any case, are replaced; all other names are free. An
    empty table gives an empty table.
    """
    spark = pages.sparkSession
    names = Names(without(pages, [html_col, *ADDED]).columns)
    rows = pages.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"), names.pack().alias("row"))
    narrow = rows.select("rid", "url", "html").mapInArrow(_digests, "rid long, host string, path string, lines binary, places array<int>, main array<int>")
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = narrow.where(F.length("lines") > 0).repartitionByRange(n, "host", "path", "rid").sortWithinPartitions("host", "path", "rid")
    ordered = spool(ordered.withColumn("nth", F.monotonically_increasing_id()), "pages")
    part, nth = F.shiftright("nth", 33), F.col("nth").bitwiseAND(F.lit((1 << 33) - 1))
    before = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row per partition
    ranked = ordered.withColumn("part", part).join(before, "part").withColumn("rank", F.col("before") + nth)
    runs = F.array_distinct(F.array(*[F.floor((F.col("rank") + k) / RUN_PAGES) for k in (-1, 0, 1)]))
    shared = ranked.select("rid", "host", "path", "lines", "places", "main", "rank", F.explode(runs).alias("run"))
    shared = shared.withColumn("own", F.col("run") == F.floor(F.col("rank") / RUN_PAGES))
    deleted = spool(shared.groupBy("run").applyInArrow(_shared, "rid long, deleted array<int>"), "shared-lines")
    packed = rows.join(deleted, "rid", "left").select("html", "deleted", "row")
    return packed.mapInArrow(_extract, struct_of(packed, text="string", n_chars="long")).select(*names.unpack(), *ADDED)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(documents(spark, sf_dir, "pages").select("page_id", "url", "html"))

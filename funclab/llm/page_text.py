"""The main text of web pages: elements that never hold it go, then lines that a nearby page has too.

A page that marks its article keeps all lines of the article, whoever quotes them; on all others,
lines are judged by the pages next to them.

Pages of a host are ordered by URL path, and each is paired with the neighbour whose path begins
most alike. The longest common subsequence of both pages' lines is what the site prints on either,
and is deleted. Only hashes of lines are compared and sorted; texts are met again by a row hash.
"""

from __future__ import annotations

import html as entities
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funclab.plans.settle import shared_dir

# Elements of HTML by their part in a page, and words in class names and ids.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe svg math textarea title xmp noembed noframes object audio video canvas".split())
NEVER = set("nav aside footer form button select datalist dialog menu head noscript".split())
WORDS = set(
    "ad ads advert advertisement advertising adsbygoogle banner sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup menu nav navbar navigation breadcrumb "
    "breadcrumbs sidebar widget widgets footer masthead topbar comment comments disqus replies respond share sharing social "
    "related recommended recommendations toolbar pagination pager login".split()
)
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""")
_CLASS_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {name: re.compile(f"</{name}[\\s/>]", re.I) for name in RAW}
_ADDRESS = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?([^/?#]*)([^?#]*)"
_HIDDEN = re.compile(r"\shidden(?:[\s=]|$)|display\s*:\s*none", re.I)


def _shut(name: str, attributes: str, inside: bool) -> bool:
    """True for an element that never holds main text. ``inside``: it stands in an article."""
    if name in NEVER or (name == "header" and not inside):
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    if _HIDDEN.search(attributes):
        return True
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "role" and value.lower() in ROLES or key == "aria-hidden" and value.lower() == "true":
            return True
        if key in ("class", "id") and name[0] != "h" and any(w.lower() in WORDS for w in _CLASS_WORD.findall(value)):
            return True
    return False


def article_blocks(page: str | None) -> tuple[list[str], bool]:
    """Text blocks of a page in order, without elements that never hold main text.

    Where the page marks an article or main part that has text, only that part's blocks, and true.
    """
    page = page or ""
    out, text, stack = [], [], []  # stack: (name, shut, in article)
    shut = inside = False
    at, n = 0, len(page)

    def cut():
        line = " ".join(entities.unescape("".join(text)).split())
        if line:
            out.append((line, inside))
        text.clear()

    while at < n:
        i = page.find("<", at)
        if i < 0:
            i = n
        if i > at and not shut:
            text.append(page[at:i])
        if i == n:
            break
        follows = page[i + 1 : i + 2]
        if follows in ("!", "?"):
            end = page.find("-->", i + 4) if page.startswith("<!--", i) else page.find(">", i)
            at = n if end < 0 else end + (3 if page.startswith("<!--", i) else 1)
            continue
        tag = _TAG.match(page, i)
        if tag is None:
            if not (follows.isalpha() or follows == "/"):
                if not shut:
                    text.append("<")
                at = i + 1
                continue
            end = page.find(">", i)  # a quote that never ends, or a tag that never does
            at = n if end < 0 else end + 1
            continue
        at, name = tag.end(), tag[1].lower()
        if name in BLOCKS:
            cut()
        elif name == "br":
            text.append(" ")
        if page[i + 1] == "/":
            if any(name == s[0] for s in stack):
                while stack.pop()[0] != name:
                    pass
        elif name in RAW:
            end = _RAW_END[name].search(page, at)
            at = n if end is None else page.find(">", end.start()) + 1 or n
            continue
        elif name not in VOID and not tag[2].endswith("/"):
            if name in BLOCKS and stack and stack[-1][0] == "p" or stack and stack[-1][0] == name and name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                stack.pop()
                shut, inside = stack[-1][1:] if stack else (False, False)
            stack.append((name, shut or _shut(name, tag[2], inside), inside or name in ("article", "main")))
        shut, inside = stack[-1][1:] if stack else (False, False)
    cut()
    marked = [line for line, held in out if held]
    return (marked, True) if marked else ([line for line, _ in out], False)


def blocks(page: str | None) -> list[str]:
    return article_blocks(page)[0]


def common(a: list, b: list) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``."""
    both = set(a) & set(b)
    ia, ib = [i for i, x in enumerate(a) if x in both], [i for i, x in enumerate(b) if x in both]
    return _common([a[i] for i in ia], [b[i] for i in ib], ia)


def _rows(a, b, keep):
    """Bit rows of the LCS table: bit j of a row is clear where taking b[j] makes it longer."""
    masks: dict = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | (1 << j)
    full = (1 << len(b)) - 1
    v, rows = full, []
    for x in a:
        m = masks.get(x, 0)
        v = ((v + (v & m)) | (v & ~m)) & full
        if keep:
            rows.append(v)
    return rows if keep else v


def _lengths(a, b):
    """LCS length of a with every prefix of b."""
    v, out = _rows(a, b, False), [0]
    for j in range(len(b)):
        out.append(out[-1] + (not v >> j & 1))
    return out


def _common(a, b, places, most=1 << 29):
    if not a or not b:
        return []
    if len(a) == 1:
        return [places[0]] if a[0] in b else []
    if len(a) * len(b) > most:  # in halves, so that the table stays small
        half = len(a) // 2
        left, right = _lengths(a[:half], b), _lengths(a[half:][::-1], b[::-1])[::-1]
        k = max(range(len(b) + 1), key=lambda j: left[j] + right[j])
        return _common(a[:half], b[:k], places[:half], most) + _common(a[half:], b[k:], places[half:], most)
    rows, out, j = _rows(a, b, True), [], len(b)
    for i in range(len(a) - 1, -1, -1):
        below = rows[i - 1] if i else (1 << len(b)) - 1
        length = lambda v: j - (v & ((1 << j) - 1)).bit_count()
        if length(rows[i]) > length(below):
            j = (~rows[i] & ((1 << j) - 1)).bit_length() - 1
            out.append(places[i])
    return out[::-1]


def shared_lines(own, sizes, other) -> list[int]:
    """Lines to delete: those in common, unless the other page is a copy of most of this one."""
    places = common(own, other)
    return [] if 2 * sum(sizes[i] for i in places) > sum(sizes) else places


def _alike(a, b):
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _facts(batches):
    import pyarrow as pa
    import xxhash

    for b in batches:
        hashes, sizes, marked = [], [], []
        for page in b.column(3):
            lines, held = article_blocks(page.as_py())
            marked.append(held)
            hashes.append([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63) for x in lines])
            sizes.append([len(x) for x in lines])
        arrays = [b.column(0), b.column(1), b.column(2), pa.array(hashes, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32())), pa.array(marked, pa.bool_())]
        yield pa.RecordBatch.from_arrays(arrays, names=["row", "host", "path", "lines", "sizes", "marked"])


def _edges(batches):
    """First and last page of a partition."""
    from pyspark import TaskContext

    import pyarrow as pa

    first = last = None
    for b in batches:
        if b.num_rows:
            first = b.slice(0, 1) if first is None else first
            last = b.slice(b.num_rows - 1, 1)
    if first is not None:
        for k, b in enumerate((first, last)):
            where = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([k], pa.int32())]
            yield pa.RecordBatch.from_arrays([*where, *b.columns[1:4]], names=["part", "side", "host", "path", "lines"])


def _decide(before, after):
    def decide(batches):
        from pyspark import TaskContext

        import pyarrow as pa

        def rows():
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns))

        def chosen(prev, now, follow):
            if now[5]:  # all that is left of the page is its article, and what other pages have of it is quoted
                return []
            near = [x for x in (prev, follow) if x is not None and x[0] == now[1]]
            other = max(near, key=lambda x: _alike(x[1], now[2]), default=None)
            return shared_lines(now[3], now[4], other[2]) if other else []

        part = TaskContext.get().partitionId()
        prev, now, out = before.get(part), None, []
        for row in rows():
            if now is not None:
                if drop := chosen(prev, now, row[1:4]):
                    out.append((now[0], drop))
                prev = now[1:4]
            now = row
        if now is not None and (drop := chosen(prev, now, after.get(part))):
            out.append((now[0], drop))
        columns = list(zip(*out)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.list_(pa.int32()))], names=["row", "drop"])

    return decide


def _texts(batches):
    import pyarrow as pa

    for b in batches:
        out = []
        for page, drop in zip(b.column(2), b.column(3)):
            lines, gone = blocks(page.as_py()), set(drop.as_py() or ())
            out.append("\n".join(x for i, x in enumerate(lines) if i not in gone))
        arrays = [b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text", "n_chars"])


def shared_by_neighbours(pages: DataFrame) -> DataFrame:
    """row (hash of a page's columns) and the places of the lines that it shares with its neighbour."""
    shared_dir(pages.sparkSession)
    part = lambda k: F.regexp_extract(F.coalesce("url", F.lit("")), _ADDRESS, k)
    keyed = pages.select(_row().alias("row"), F.lower(part(1)).alias("host"), part(2).alias("path"), "html")
    facts = keyed.mapInArrow(_facts, "row long, host string, path string, lines array<long>, sizes array<int>, marked boolean")
    order = ["host", "path", "row"]
    facts = facts.dropDuplicates(["row"]).repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()
    # Two pages for each partition: their number is the number of tasks, not of pages.
    edges = facts.mapInArrow(_edges, "part int, side int, host string, path string, lines array<long>").collect()
    edges = sorted((e["part"], e["side"], (e["host"], e["path"], e["lines"])) for e in edges)
    before = {p: edges[i - 1][2] for i, (p, side, _) in enumerate(edges) if side == 0 and i}
    after = {p: edges[i + 1][2] for i, (p, side, _) in enumerate(edges) if side == 1 and i + 1 < len(edges)}
    return facts.mapInArrow(_decide(before, after), "row long, drop array<int>")


def _row():
    return F.xxhash64("page_id", "url", "html")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    A null or empty page has an empty text, a page without another of its host keeps its lines, a
    null URL is a host of its own name, and repeated rows get the same text. A page is compared
    with one neighbour only; where most of its text stands there too it is a copy and keeps all.
    Other columns are not read.
    """
    drops = shared_by_neighbours(pages)
    rows = pages.select(_row().alias("row"), F.col("page_id").cast("long"), "url", "html")
    rows = rows.join(drops, "row", "left").select("page_id", "url", "html", "drop")
    return rows.mapInArrow(_texts, "page_id long, url string, text string, n_chars long")

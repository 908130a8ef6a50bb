"""Main text of web pages by a site style tree: the DOMs of a host are merged, and branches that say the same on page after
page are of low importance and are taken out of each page."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from hazardframe.llm.common import row_blocks, small_or_not
from hazardframe.llm.url_filter import host_of

# A quoted value may hold ">" but not "<", which keeps the search linear on broken pages.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^<>"']|"[^"<]*"|'[^'<]*')*|[^<>]*)>|<[!?][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""(?i)\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAME = re.compile(r"[A-Za-z]+")
SPACES = re.compile(r"\s+")

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong "
                   "sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe svg template".split())
# Presentation nodes without text to read.
SILENT = frozenset("head script style noscript template button select textarea iframe object svg canvas".split())
# Furniture unless they hold an article; a form and what is only named like furniture also stay with most of the page's text.
FURNITURE = frozenset("nav footer aside form dialog menu".split())
FURNITURE_NAMES = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu "
                            "breadcrumb breadcrumbs sidebar header masthead footer cookie cookies consent gdpr notice popup modal overlay newsletter subscribe "
                            "signup login search share sharing social comment comments disqus reply replies respond related widget toolbar pagination".split())
ARTICLE = frozenset(["article", "main"])
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = frozenset("ul ol dl table select menu".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6".split())
COMMENT = frozenset(["comment", "reply"])
LEAST_PAGES, LEAST_IMPORTANCE = 8, 0.1
NAMED_WEIGHT = 0.5  # what is named like furniture counts as half as important


def _named(attributes: str) -> tuple[str, bool, bool, bool]:
    """Class and id as part of a branch's name; whether a whole label (every word of it) names furniture, or a comment; and whether
    the element is hidden."""
    label, named, comment, hidden = "", False, False, False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id", "role"):
            label += "." + "-".join(NAME.findall(value))
            for one in value.split():
                words = NAME.findall(one)
                named = named or (bool(words) and FURNITURE_NAMES.issuperset(words))
                comment = comment or (bool(words) and COMMENT.issuperset(words))
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            hidden = True
    return label, named, comment, hidden


def page_blocks(page: str) -> list[tuple[str, bool, str]]:
    """(branch, inside an article, text) of the page's blocks in order, without what :func:`judged_blocks` takes for furniture."""
    return [(branch, article, text) for branch, article, text, taken, _ in judged_blocks(page) if not taken]


def judged_blocks(page: str) -> list[tuple[str, bool, str, str, str]]:
    """(branch, inside an article, text, furniture, named) of all the page's blocks in order.

    A branch is the path of block elements with their classes. Tags that are left open are closed by what cannot stand inside
    them; stray end tags are ignored; inline tags do not part a block. ``furniture`` is the outermost branch around the block
    that this page takes for furniture by its tag or name, or empty; ``named`` the innermost one that only looks like it.
    What holds an article is no furniture, nor is a form or a named element with more than half of the page's text.
    """
    out: list[tuple[str, bool, str, int]] = []
    buffer: list[str] = []
    # (tag, branch, silent, in an article, number of the innermost element that looks like furniture)
    stack: list[tuple[str, str, bool, bool, int]] = [("", "", False, False, -1)]
    # Of each element that looks like furniture: the one around it, its branch, whether much text saves it, an article in it, characters
    suspects: list[list] = []
    here = 0

    def flush() -> None:
        if buffer:
            text = SPACES.sub(" ", entities.unescape("".join(buffer))).strip()
            buffer.clear()
            if text:
                out.append((stack[-1][1], stack[-1][3], text, stack[-1][4]))
                if stack[-1][4] >= 0:
                    suspects[stack[-1][4]][4] += len(text)

    find, end = TOKEN.search, len(page)
    while here < end:
        m = find(page, here)
        stop = m.start() if m else end
        if stop > here and not stack[-1][2]:
            buffer.append(page[here:stop])
        if not m:
            break
        here = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br" and not stack[-1][2]:
                buffer.append(" ")
            continue
        flush()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag == "body":
            stack[1:] = [x for x in stack[1:] if x[0] == "html"]
        while stack[-1][0] in ("p", *(f"h{i}" for i in range(1, 7))):
            stack.pop()
        closes = CLOSED_BY.get(tag)
        if closes:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in closes:
                    del stack[i:]
                    break
                if stack[i][0] in LISTS:
                    break
        if tag in VOID:
            continue
        label, named, comment, hidden = _named(m[3]) if m[3] else ("", False, False, False)
        _, above, silent, article, suspect = stack[-1]
        branch = f"{above}/{tag}{label}"
        if not silent and tag not in ("html", "body"):
            silent = hidden or tag in SILENT or (tag in ARTICLE and comment)
            if tag in ARTICLE:
                if not silent and suspect >= 0:
                    suspects[suspect][3] = True
            elif not silent:
                # A header belongs to the article it stands in.
                by_tag = tag in FURNITURE or (tag == "header" and not article)
                if by_tag or named:
                    suspects.append([suspect, branch, not by_tag or tag == "form", False, 0])
                    suspect = len(suspects) - 1
        if tag in RAW:
            close = re.compile(f"</{tag}\\b[^>]*>", re.I).search(page, here)
            here = close.end() if close else end
            continue
        stack.append((tag, branch, silent, article or tag in ARTICLE, suspect))
    flush()
    for around, _, _, article, chars in reversed(suspects):
        if around >= 0:
            suspects[around][3] = suspects[around][3] or article
            suspects[around][4] += chars
    most = sum(len(t) for _, _, t, _ in out) / 2
    taken: list[str] = []
    for around, branch, by_text, article, chars in suspects:
        outer = taken[around] if around >= 0 else ""
        taken.append(outer or ("" if article or (by_text and chars > most) else branch))
    return [(branch, article, text, taken[k] if k >= 0 else "", suspects[k][1] if k >= 0 else "") for branch, article, text, k in out]


def _branches(branch: str) -> list[str]:
    """The branch itself and those it grows from, without the page's root."""
    cuts = [i for i, c in enumerate(branch) if c == "/"][1:] + [len(branch)]
    return [branch[:c] for c in cuts if not branch[:c].rsplit("/", 1)[1].startswith(("html", "body"))]


def style_tree(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Merge the pages of each host: (host, branch, pages, importance) of all branches; what a page takes for furniture is a leaf.

    ``importance`` is the entropy of what the branch says on the host's different pages, over the logarithm of their number:
    1 when every page says something else, 0 when all say the same; ``NAMED_WEIGHT`` times that if it looks like furniture. Pages with equal text count as one page, so a much
    copied article does not look like furniture. Counts are summed before they are shuffled, so a host with very many
    pages makes no hot key.
    """
    rows = pages.select(host_of(F.col(url)).alias("host"), F.col(html).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in row_blocks(batches, 1, 8_000_000):
            met, hosts, keys, branches, says, looks = set(), [], [], [], [], []
            for host, page in zip(part.column(0).to_pylist(), texts):
                found = judged_blocks(page)
                key = xxhash.xxh64_intdigest("\n".join(t for _, _, t, taken, _ in found if not taken)) >> 1
                if (host, key) in met:
                    continue
                met.add((host, key))
                text: dict[str, xxhash.xxh64] = {}
                named = {n for *_, n in found} | {taken for *_, taken, _ in found}
                for branch, _, t, taken, _ in found:
                    # Leaves only: what is inside furniture, or around it, says nothing about the rest of the page.
                    for b in [taken] if taken else _branches(branch):
                        text.setdefault(b, xxhash.xxh64()).update(t + "\n")
                for b, h in text.items():
                    hosts.append(host)
                    keys.append(key)
                    branches.append(b)
                    says.append(h.intdigest() >> 1)
                    looks.append(b in named)
            yield pa.RecordBatch.from_pydict({"host": pa.array(hosts, pa.string()), "page": pa.array(keys, pa.int64()),
                                              "branch": pa.array(branches, pa.string()), "says": pa.array(says, pa.int64()),
                                              "named": pa.array(looks, pa.bool_())})

    seen = rows.mapInArrow(run, "host string, page bigint, branch string, says bigint, named boolean")
    seen = seen.groupBy("host", "page", "branch", "says").agg(F.max("named").alias("named"))
    each = seen.groupBy("host", "branch", "says").agg(F.count(F.lit(1)).alias("c"), F.max("named").alias("named"))
    entropy = F.when(F.col("pages") > 1, (F.log("pages") - F.col("s") / F.col("pages")) / F.log("pages")).otherwise(F.lit(1.0))
    return (each.groupBy("host", "branch").agg(F.sum("c").alias("pages"), F.sum(F.col("c") * F.log("c")).alias("s"), F.max("named").alias("named"))
            .select("host", "branch", "pages", (entropy * F.when(F.col("named"), NAMED_WEIGHT).otherwise(1.0)).alias("importance")))


def main_text(pages: DataFrame, url: str = "url", html: str = "html", into: str = "main_text", least_pages: int = LEAST_PAGES,
              least_importance: float = LEAST_IMPORTANCE) -> DataFrame:
    """Add ``into``: the blocks of the page's article, one a line, without furniture and branches of low importance.

    A page with text in an ``article`` or ``main`` element gives that text, any other page all that is left of it. A
    branch is of low importance when at least ``least_pages`` different pages of the host have it and its importance is
    below ``least_importance``; headings and paragraphs of an article are never taken for furniture. Character references
    are decoded, white space becomes single blanks. Null and empty pages give an empty text, a null url is a host of its
    own name (empty), repeated rows get equal texts. All columns stay; one named ``into`` is replaced.

    The branches of low importance are few and small; each page gets its host's by a join, broadcast only when they are
    known to be small.
    """
    pages = pages.drop(into)
    low = (style_tree(pages, url, html).filter((F.col("pages") >= least_pages) & (F.col("importance") < least_importance))
           .groupBy("host").agg(F.sort_array(F.collect_set("branch")).alias("low")))
    joined = pages.alias("p").join(small_or_not(low).alias("l"), host_of(F.col(f"p.`{url}`")) == F.col("l.host"), "left")
    columns = [F.col(f"p.`{c}`") for c in pages.columns]
    schema = pages.withColumn(into, F.lit("")).schema
    at, n, names_out = pages.columns.index(html), len(columns), [*pages.columns, into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sources in row_blocks(batches, at):
            texts = []
            for page, taken in zip(sources, part.column(n).to_pylist()):
                found, low = page_blocks(page), set(taken or ())
                if low:
                    kept = []
                    for branch, article, t in found:
                        names = _branches(branch)
                        if article and names and names[-1].rsplit("/", 1)[1].split(".")[0] in TEXT_BLOCKS:
                            names = names[:-1]
                        if low.isdisjoint(names):
                            kept.append((branch, article, t))
                    found = kept
                article = [t for _, a, t in found if a]
                texts.append("\n".join(article or [t for _, _, t in found]))
            yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(texts, pa.string())], names=names_out)

    return joined.select(*columns, F.col("l.low").alias("__low")).mapInArrow(run, schema)

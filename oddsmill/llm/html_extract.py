"""Main text of web pages by consensus host paths.

1. Each page's containers are scored by the text they hold themselves (directly, or in blocks that are not containers), less what stands in
   links and in parts of a page that are never article text by element or by class. An article element, or a main element around no article,
   has the text of all containers in it.
2. The best container's path, its generalised tag-class steps from the root (digits dropped, so ``post-12`` and
   ``post-97`` are one), is the page's vote. Votes are summed per host in Spark; a page also votes, at a discount, for
   every other container in reach of its best, so that hosts settle on paths that work for most pages.
3. Every page is extracted again below that of its own paths that has most votes on its host, below those beside it that have COMPANION of
   these votes, and from what the containers around them hold themselves.

Pages are streamed; votes are rows of host, path and shape (the digest of a page's host and paths), added up before they are shuffled.
"""

from __future__ import annotations

import hashlib
import html
import re
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._exchange import estimated_bytes
from ._store import release, small_batches, written

#: Votes of a path beside the winning one, as a part of the winner's, from which it belongs to the article too.
COMPANION = 0.25
#: Size of the table of shapes, as it's stored, up to which it is broadcast; parts into which a shape's pages are split beyond that.
BROADCAST_BYTES, SALTS = 4 << 20, 16

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas".split())
#: Elements that are never part of an article.
FOREIGN = frozenset("nav header footer aside form button select dialog menu head".split()) | RAW
BLOCK = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article body div main section td".split())
#: Start tags that end an open paragraph, and items that end an open one of their kind.
ENDS_P = BLOCK - frozenset(("html", "body"))
ENDS_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_WITHIN = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

#: Words of class names and ids that mark parts which are not article text.
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar|side|widget|footer|header|masthead|"
    r"comments?|replies|disqus|respond|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|"
    r"related|recommended|pagination|pager|toolbar|copyright|legal|disclaimer)(?:$|[\s_-])",
    re.I,
)
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
DIGITS = re.compile(r"\d+")


class Container:
    """A node that may hold the article: its path, its parent container, how much of its own text is outside and inside links, and its root.

    The root is the article (or else main) element whose text the container's is, or the container itself; credit is a root's score.
    """

    __slots__ = ("path", "tag", "parent", "text", "linked", "index", "root", "credit")

    def __init__(self, path: str, tag: str, parent: Container | None, index: int):
        self.path, self.tag, self.parent, self.index = path, tag, parent, index
        self.text = self.linked = 0
        above = parent.root if parent else self
        self.root = above if above.tag == "article" or (above.tag == "main" and tag != "article") else self
        self.credit = 0.0

    @property
    def own(self) -> int:
        """Text of its own, if most of it isn't links."""
        return max(0, self.text - 2 * self.linked)


class Page:
    """Containers of a page and its blocks of text, each with the chain of containers that holds it."""

    def __init__(self, source: str | None):
        self.containers: list[Container] = []
        self.blocks: list[tuple[int, str]] = []
        self._parse(source or "")
        for c in self.containers:
            # an article or main element counts more than a div with as much text
            c.root.credit += c.own * {"article": 1.5, "main": 1.2, "body": 0.5}.get(c.root.tag, 1.0)
        self.roots = [c for c in self.containers if c.credit > 0]

    def _flush(self, parts: list[str], container: int) -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                self.blocks.append((container, text))
            parts.clear()

    def _parse(self, source: str) -> None:
        stack: list[tuple[str, int, bool, str]] = []  # tag, container, foreign, path
        parts: list[str] = []
        at, end = 0, len(source)
        links = 0
        match = TOKEN.match
        while at < end:
            m = match(source, at)
            at = m.end()
            name = m[2]
            container = stack[-1][1] if stack else -1
            if name is None:
                text = m[0]
                if text[0] == "<" and len(text) > 1:
                    continue  # a comment or declaration
                if stack and stack[-1][2]:
                    continue
                parts.append(text)
                if container >= 0:
                    size = len(text) - text.count(" ")
                    self.containers[container].text += size
                    self.containers[container].linked += size if links else 0
                continue
            name = name.lower()
            if m[1]:
                if name == "a":
                    links = max(0, links - 1)
                if name == "br":
                    parts.append(" ")
                elif name == "p" and not any(s[0] == "p" for s in stack):
                    self._flush(parts, container)
                else:
                    for depth in range(len(stack) - 1, -1, -1):
                        if stack[depth][0] in BLOCK and name not in BLOCK and stack[depth][0] != name:
                            break  # an inline end tag doesn't close a block
                        if stack[depth][0] == name:
                            if any(s[0] in BLOCK for s in stack[depth:]):
                                self._flush(parts, container)
                                links = 0
                            del stack[depth:]
                            break
                continue
            if name in ENDS_P:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == "p":
                        self._flush(parts, container)
                        del stack[depth:]
                        break
                    if stack[depth][0] in CONTAINER or stack[depth][0] in ("table", "ul", "ol", "dl"):
                        break
            if name in ENDS_SAME:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] in ENDS_SAME[name]:
                        self._flush(parts, container)
                        del stack[depth:]
                        break
                    if stack[depth][0] in ENDS_WITHIN[name]:
                        break
            container = stack[-1][1] if stack else -1
            foreign = stack[-1][2] if stack else False
            path = stack[-1][3] if stack else ""
            if name in BLOCK:
                self._flush(parts, container)
            if name == "br":
                parts.append(" ")
            if name == "a":
                links += 1
            if name in VOID:
                continue
            marks = {k.lower(): (a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(m[3])} if m[3] else {}
            if name in RAW and name != "svg" and name != "math":
                close = re.compile(rf"</{name}\b", re.I).search(source, at)
                if close is None:
                    if name in ("script", "style", "textarea", "title"):
                        return self._flush(parts, container)
                else:
                    at = close.start()
            kind = f"{marks.get('class', '')} {marks.get('id', '')}"
            foreign = foreign or name in FOREIGN or "hidden" in marks or marks.get("aria-hidden") == "true" or "display:none" in marks.get("style", "").replace(" ", "") or (name not in ("html", "body", "article", "main") and NOISE.search(kind) is not None)
            if name in BLOCK or name in FOREIGN:
                classes = ".".join(sorted(DIGITS.sub("", c) for c in marks.get("class", "").split()))
                path = f"{path}/{name}.{classes}" if classes else f"{path}/{name}"
            if name in CONTAINER and not foreign:
                self.containers.append(Container(path, name, self.containers[container] if container >= 0 else None, len(self.containers)))
                container = len(self.containers) - 1
            stack.append((name, container, foreign, path))
        self._flush(parts, stack[-1][1] if stack else -1)

    def best(self) -> Container | None:
        """The root of most credit, the first of equals."""
        return max(self.roots, key=lambda c: (c.credit, -c.index), default=None)

    def votes(self) -> dict[str, int]:
        """Every path of a root with its votes in thousandths, 0 for those far from the best."""
        best = self.best()
        out: dict[str, int] = {}
        for c in self.roots:
            share = c.credit / best.credit
            out[c.path] = max(out.get(c.path, 0), 1000 if c is best else round(500 * share) if share >= 0.5 else 0)
        return out

    def text(self, paths: list[str]) -> str:
        """All blocks below roots of the first path and below roots of the others beside them, and those that containers around them but the body
        hold themselves; below the page's own best without paths, all blocks if it has none."""
        chosen = [c for c in self.roots if paths and c.path == paths[0]]
        if not chosen:
            best = self.best()
            if best is None:
                return "\n".join(t for _, t in self.blocks)
            chosen = [best]
        beside = {c.parent for c in chosen}
        chosen += [c for c in self.roots if c.path in paths[1:] and c.parent in beside]
        inside = [False] * len(self.containers)
        for c in chosen:
            inside[c.index] = True
        for c in self.containers:
            inside[c.index] = inside[c.index] or (c.parent is not None and inside[c.parent.index])
        for c in chosen:
            above = c.parent
            while above is not None:
                inside[above.index] = inside[above.index] or (above.tag != "body" and above.own > 0)
                above = above.parent
        return "\n".join(t for k, t in self.blocks if k >= 0 and inside[k])


def shape_of(host: str, paths) -> bytes:
    """Pages of one host with the same paths have the same shape."""
    return hashlib.blake2b("\0".join([host, *sorted(paths)]).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def page_votes(pages: DataFrame) -> DataFrame:
    """host, path, shape, votes: the pages' votes, added up per path and shape."""

    def vote(batches):
        for batch in batches:
            tally: dict[tuple[str, str, bytes], int] = {}
            for url, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                host, votes = host_of(url), Page(source).votes()
                shape = shape_of(host, votes)
                for path, weight in votes.items():
                    tally[host, path, shape] = tally.get((host, path, shape), 0) + weight
            columns = list(zip(*tally)) or [(), (), ()]
            types = (pa.string(), pa.string(), pa.binary())
            yield pa.record_batch([*(pa.array(c, t) for c, t in zip(columns, types)), pa.array(list(tally.values()), pa.int64())], ["host", "path", "shape", "votes"])

    small_batches(pages.sparkSession)
    votes = pages.select("url", "html").mapInArrow(vote, "host string, path string, shape binary, votes long")
    named = votes.where("host is not null and path is not null and shape is not null")  # as joins would say on one side only
    return named.groupBy("host", "path", "shape").agg(F.sum("votes").alias("votes"))


def _best_first(votes: str, *columns: str):
    return F.array_sort(F.collect_list(F.struct((-F.col(votes)).alias("v"), *columns)))


def host_paths(pages: DataFrame) -> DataFrame:
    """host, paths array<string>: the voted paths of each host, best first; to look at, as extracted() has no list per host."""
    total = page_votes(pages).groupBy("host", "path").agg(F.sum("votes").alias("votes")).where("votes > 0")
    return total.groupBy("host").agg(F.transform(_best_first("votes", "path"), lambda x: x["path"]).alias("paths"))


def shape_paths(pages: DataFrame, companion: float = COMPANION) -> DataFrame:
    """shape, paths array<string>: of a shape's paths the one with most votes on the host, then those with companion of its votes."""
    votes = page_votes(pages)
    total = votes.groupBy("host", "path").agg(F.sum("votes").alias("total"))
    # votes are kept so that both sides of the join read one exchange, and pages are parsed for it once
    ranked = votes.join(total, ["host", "path"]).groupBy("shape").agg(_best_first("total", "path", "votes").alias("found"))
    enough = F.filter("found", lambda x: x["v"] <= F.col("found")[0]["v"] * companion)
    return ranked.select("shape", F.transform(enough, lambda x: x["path"]).alias("paths"))


def extracted(pages: DataFrame) -> DataFrame:
    """pages' columns without html, then text, for every row of pages(url, html).

    Null or empty html gives an empty text; a null or broken url is the host ''. A repeated page votes each time and is extracted each time.
    Character references are decoded; white space in a block becomes one space; blocks are joined in page order by line feeds. Nothing else of the
    article is dropped or cut. A column of pages named text is replaced.
    """
    winners = written(shape_paths(pages), "page-shapes")
    keep = [c for c in pages.columns if c not in ("html", "text")]
    plain = pages.select(*(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(keep)), F.col("url").alias("_url"), F.col("html").alias("_html"))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)

    def with_shape(batches):
        for batch in batches:
            urls, sources = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            shapes = [shape_of(host_of(u), Page(s).votes()) for u, s in zip(urls, sources)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shapes, pa.binary())], [*batch.schema.names, "shape"])

    shaped = plain.mapInArrow(with_shape, schema + ", shape binary")
    # shapes are few where hosts have templates: then no html is shuffled. Else a shape's pages, of which one may have a third, part by a salt
    size = estimated_bytes(winners)
    if size is not None and size <= BROADCAST_BYTES:
        joined = shaped.join(F.broadcast(winners), "shape", "left")
    else:
        salted = winners.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
        joined = shaped.withColumn("_salt", F.pmod(F.xxhash64("_url", F.length("_html"), F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")).join(salted, ["shape", "_salt"], "left")
    names = [f"_c{i}" for i in range(len(keep))]
    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema if f.name in names) + ", text string"

    def extract(batches):
        for batch in batches:
            sources, paths = batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()
            texts = [Page(s).text(p or []) for s, p in zip(sources, paths)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(texts, pa.string())], [*names, "text"])
        release()

    found = joined.select(*names, "_html", "paths").mapInArrow(extract, out_schema)
    return found.toDF(*keep, "text")


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    out = extracted(pages.select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

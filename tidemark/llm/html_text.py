"""HTML extraction with site style trees.

The DOMs of one host's pages are merged by presentation: a node of the site's tree is a path of tags with their classes, ids
and roles. A node that holds text and stands on `enough` pages of the host gets an importance from entropy:

* content: one minus the mean, over the distinct texts t that the site has there, of log(pages with t) / log(pages with the
  node); a text that is on every page adds nothing, a text of its own on each page adds all;
* presentation: the entropy, in the same base, of the child layouts that the node has over the pages.

A node's importance is 0.9 of the first and 0.1 of the second (the weighting of one level of the published formula). What entropy says
counts for m / (m + 25), 0.85 at most, m being the host's pages with the node; the rest is a prior from markup, which so decides on
thin hosts: 0 for nav, header, footer, aside, form and the like and for classes, ids and roles of menus, adverts, notices, sidebars or
comments; 1 inside the part that a page marks as its article or main part; 0.2 outside of it; 0.6 where a page marks none. A node too rare
to be judged on its own takes, in place of entropy, the mean importance of its branch: of the judged nodes below the nearest node above it
that has any on the page.

Where to cut comes from the host's own distribution: the threshold that parts its text nodes, each weighted by its pages, with
the greatest variance between both sides, as long as the sides' means are `gap` apart; the upper side is parted again in the same way. The
threshold stands if there is one and the marked main part lies above it; else, as on a host whose nodes are all alike, the prior decides. Branches under the threshold are cut, and so are
single texts that nearly every page of the host with that node has (a share `everywhere` of them, whatever their number). Plain
content tags inside a marked article or main part (p, h1, li ..., without classes, also where that part itself has a name) are never cut,
so copies of an article on a host do not make it a notice.

Scale: a page is parsed twice. The first pass sends (host, node, text hash) counts, combined in each block of pages and again
before the shuffle; no page's text is shuffled and no group is gathered; of a host's distribution 64 counts meet. The second pass needs
the tree of the page's host. While all trees have at most `most_broadcast` nodes, they are broadcast as arrays, 12 bytes a node; else
pages and trees are dealt by host, a host of many pages in several parts that get a tree each, and sorted so that a
tree comes once, before its pages.

Defined results: null or empty html gives an empty text; a null or odd url has host ''; markup that is never closed ends where
HTML says; rows are never merged or dropped. A text of a block is decoded, its white space made one space, and trimmed.
"""

from __future__ import annotations

import functools
import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Tables, parts, parts_of, table, written

#: Elements without an end tag. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page. Fixed values.
RAW = frozenset("script style noscript template textarea title iframe object svg canvas audio video select math noframes".split())
#: Of these, the ones that run to the end of the page where they are never closed. Fixed values.
_TO_END = frozenset("script style noscript template textarea title iframe noframes".split())
#: Elements inside a line of text. Fixed values.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Plain elements of an article. Fixed values.
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption div section main article body html header details summary address hgroup center".split())
#: Elements that are not content. Fixed values.
NOISE = frozenset("nav footer aside form button input dialog menu head".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form status".split())
_P_ENDS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_NOISE_NAME = re.compile(
    r"(?:^|[-_\s])(?:nav|navbar|navigation|menu|menus|sidebar|sidebars|sidenav|side|footer|foot|masthead|banner|banners|ad|ads|adv|advert|adverts|advertisement|advertising|adslot|adbox|sponsor|sponsored|promo|promotion|"
    r"cookie|cookies|consent|gdpr|notice|notices|notification|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|breadcrumb|breadcrumbs|comment|comments|commentlist|reply|replies|respond|"
    r"disqus|related|recommended|widget|toolbar|pagination|pager|copyright|legal|disclaimer|skip|search|form)(?:$|[-_\s\d])",
    re.IGNORECASE,
)
#: Names that are noise outside the main part only.
_HEAD_NAME = re.compile(r"(?:^|[-_\s])(?:header)(?:$|[-_\s\d])", re.IGNORECASE)
_STATE_NAME = re.compile(r"(?<!\S)(?:has|no|with|without|is)[-_]\S+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_TAG = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>")
_ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_DIGITS = re.compile(r"\d+")
#: The most that entropy counts against the prior.
TRUST = 0.85
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), _HOST, 1))


@functools.lru_cache(maxsize=100_000)
def _look(tag: str, attrs: str) -> tuple[str, bool, bool, bool, bool]:
    """Signature of an element; whether its markup says it is noise, marks the main part, is plain, or is a header of the page."""
    if not attrs.strip(" /"):
        return tag, tag in NOISE, tag in ("article", "main"), tag in PLAIN, tag == "header"
    found = {m[1].lower(): html_lib.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)}
    names = f"{found.get('class', '')} {found.get('id', '')}"
    said = _HUMP.sub("-", _STATE_NAME.sub("", names))
    role = found.get("role", "").lower()
    style = found.get("style", "").replace(" ", "").lower()
    prop = found.get("itemprop", "").lower()
    main = tag in ("article", "main") or role in ("main", "article") or prop == "articlebody"
    noise = tag in NOISE or role in ROLES or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style
    noise = noise or tag not in ("body", "html") and prop != "articlebody" and bool(_NOISE_NAME.search(said))
    named = _DIGITS.sub("", " ".join(sorted(names.split())))
    return f"{tag}.{named}.{role}" if named or role else tag, noise, main and not noise, tag in PLAIN and not named, tag == "header" or tag not in ("body", "html") and bool(_HEAD_NAME.search(said))


@functools.lru_cache(maxsize=200_000)
def _path(above: int, signature: str) -> int:
    return xxhash.xxh64_intdigest(f"{above}/{signature}") - (1 << 63)


def parse(page: str | None) -> tuple[list[tuple[int, bool, bool, bool, str]], Counter, dict[int, int]]:
    """Blocks in page order: (node, noise by markup, in the main part, plain up to that part, text); layouts seen: (node, its
    children's signatures); and each node's branch, the node that it is in (nodes come after their branches)."""
    blocks: list[tuple[int, bool, bool, bool, str]] = []
    layouts: Counter = Counter()
    parents: dict[int, int] = {}
    if not page:
        return blocks, layouts, parents
    # tag, node, noise, in main, plain, is a block, children
    stack: list[tuple] = [("", 0, False, False, True, True, [])]
    opened: Counter = Counter()
    text: list[str] = []
    unclosed: set[str] = set()
    owner = stack[-1]

    def flush() -> None:
        nonlocal text
        if text:
            said = "".join(text)
            said = " ".join((html_lib.unescape(said) if "&" in said else said).split())
            if said:
                blocks.append((owner[1], owner[2], owner[3], owner[4], said))
            text = []

    def close(depth: int) -> None:
        nonlocal owner
        while len(stack) > depth:
            gone = stack[-1]
            if gone[5] or gone[0] not in INLINE or gone[2] != stack[-2][2]:
                flush()
            stack.pop()
            opened[gone[0]] -= 1
            if gone[6]:
                layouts[(gone[1], hash_of(",".join(gone[6])))] += 1
        owner = stack[-1]

    at, lower, end = 0, None, len(page)
    while at < end:
        found = _TAG.search(page, at)
        if not found:
            text.append(page[at:])
            break
        if found.start() > at:
            text.append(page[at : found.start()])
        at = found.end()
        if found[0] == "<!--":
            stop = page.find("-->", at)
            at = end if stop == -1 else stop + 3
            continue
        if not found[2]:
            continue
        tag, attrs = found[2].lower(), found[3]
        while attrs.count('"') % 2 and (more := page.find(">", at)) != -1:
            attrs += ">" + page[at:more]
            at = more + 1
        if found[1]:
            if opened[tag] > 0:
                depth = len(stack) - 1
                while stack[depth][0] != tag:
                    depth -= 1
                close(depth)
            elif tag in _P_ENDS:
                flush()
            continue
        if tag in VOID:
            if tag == "br":
                text.append(" ")
            elif tag == "hr":
                flush()
            continue
        if tag in ("svg", "math") and attrs.rstrip().endswith("/"):
            continue
        if tag in RAW or tag == "head":
            if lower is None:
                lower = page.lower() if len(page.lower()) == len(page) else re.sub("[A-Z]+", lambda m: m[0].lower(), page)
            stop = -1 if tag in unclosed else lower.find(f"</{tag}", at)
            if stop != -1:
                stop = page.find(">", stop)
                at = end if stop == -1 else stop + 1
            elif tag in _TO_END:
                at = end
            else:
                unclosed.add(tag)
            continue
        signature, noise, main, plain, head = _look(tag, attrs)
        inline = tag in INLINE
        if inline and signature == tag and not noise:
            continue
        if not inline and tag in _P_ENDS and opened["p"] > 0:
            depth = len(stack) - 1
            while stack[depth][0] != "p":
                depth -= 1
            close(depth)
        if tag in _CLOSES:
            ends, barrier = _CLOSES[tag]
            depth, cut = len(stack) - 1, 0
            while depth > 0 and stack[depth][0] not in barrier:
                if stack[depth][0] in ends:
                    cut = depth
                depth -= 1
            if cut:
                close(cut)
        above = stack[-1]
        if not inline or noise != above[2]:
            flush()
        noise_here = head and not (above[3] or main) or noise
        above[6].append(signature)
        stack.append((tag, _path(above[1], signature), above[2] or noise_here, above[3] or main, main or above[4] and (plain or inline), not inline, []))
        parents.setdefault(stack[-1][1], above[1])
        opened[tag] += 1
        owner = stack[-1]
    close(1)
    flush()
    return blocks, layouts, parents


def hash_of(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def priors(blocks: list[tuple]) -> list[float]:
    """What markup says of each block's node: see above."""
    outside = 0.2 if any(b[2] and not b[1] for b in blocks) else 0.6
    return [0.0 if b[1] else 1.0 if b[2] else outside for b in blocks]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, node, kind, value, pages, prior): kind 0 the node itself, 1 a text in it, 2 a layout of its children; prior summed over pages."""
    for batch in batches:
        seen: dict[tuple, list] = {}
        for part in parts_of([batch]):
            for host, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                blocks, layouts, _ = parse(page)
                own = {(host, node, 2, layout): 0.0 for node, layout in layouts} | {(host, node, 0, 0): 0.0 for node, _ in layouts}
                own |= {(host, b[0], 1, hash_of(b[4])): 0.0 for b in blocks} | {(host, b[0], 0, 0): prior for b, prior in zip(blocks, priors(blocks), strict=True)}
                for key, prior in own.items():
                    entry = seen.setdefault(key, [0, 0.0])
                    entry[0] += 1
                    entry[1] += prior
        rows = list(seen)
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64())
        columns = [pa.array([r[n] for r in rows], kind) for n, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([x[0] for x in seen.values()], pa.int64()), pa.array([x[1] for x in seen.values()], pa.float64())], names=["host", "node", "kind", "value", "pages", "prior"])


def importance(counts: DataFrame) -> DataFrame:
    """host, node, m (pages with the node), entropy (0.9 of content and 0.1 of layout), prior, and importance (both, by trust)."""
    log = F.log(F.col("pages").cast("double"))
    nodes = counts.groupBy("host", "node").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("pages"))).alias("m"), F.sum(F.when(F.col("kind") == 1, log)).alias("repeated"), F.sum(F.when(F.col("kind") == 1, 1)).alias("texts"),
        F.sum(F.when(F.col("kind") == 2, F.col("pages"))).alias("laid"), F.sum(F.when(F.col("kind") == 2, F.col("pages") * log)).alias("laid_logs"), F.sum("prior").alias("said"),
    )
    base = F.log(F.greatest(F.col("m"), F.lit(2)).cast("double"))
    content = F.when(F.col("m") > 1, 1 - F.col("repeated") / (F.col("texts") * base)).otherwise(1.0)
    layout = F.when((F.col("m") > 1) & (F.col("laid") > 0), (F.log(F.col("laid").cast("double")) - F.col("laid_logs") / F.col("laid")) / base).otherwise(1.0)
    entropy = 0.9 * F.greatest(F.lit(0.0), content) + 0.1 * F.least(F.lit(1.0), layout)
    found = nodes.where(F.col("texts") > 0).select("host", "node", "m", entropy.alias("entropy"), (F.col("said") / F.col("m")).alias("prior"))
    trust = F.least(F.lit(TRUST), F.col("m") / (F.col("m") + 25))
    return found.withColumn("importance", trust * F.col("entropy") + (1 - trust) * F.col("prior"))


def split(weights: np.ndarray) -> tuple[int, float]:
    """Where to part a histogram so that the variance between both sides is greatest: (first bin of the upper side, distance of the
    sides' means in bins); of equally good places the middle one."""
    at = np.arange(len(weights), dtype=np.float64)
    low = np.cumsum(weights)[:-1]
    high = weights.sum() - low
    sums = np.cumsum(weights * at)[:-1]
    good = (low > 0) & (high > 0)
    if not good.any():
        return 0, 0.0
    apart = np.where(good, ((weights * at).sum() - sums) / np.where(good, high, 1) - sums / np.where(good, low, 1), 0.0)
    between = low * high * apart**2
    best = np.flatnonzero(between >= between.max() * (1 - 1e-9))
    cut = int(best[len(best) // 2])
    return cut + 1, float(apart[cut])


BINS = 64


def _threshold(gap: float):
    def find(weights: list[float], main: list[float]) -> float | None:
        """The importance at which the host is cut, or None if the prior has to decide."""
        whole, inside = np.array(weights), np.array(main)
        cut = 0
        while (step := split(whole[cut:]))[1] >= gap * BINS:
            cut += step[0]
        agrees = not inside.sum() or (inside * np.arange(BINS)).sum() / inside.sum() >= cut
        return cut / BINS if cut and agrees else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(w, m) for w, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["host", "cut"])

    return run


def site_trees(pages: DataFrame, tables: Tables, url: str = "url", html: str = "html", gap: float = 0.25, everywhere: float = 0.8, enough: int = 5) -> DataFrame:
    """host, node, importance (null for a row about a text), text (hash of a text on nearly all pages with the node), cut (of the host, null if
    the prior decides), m."""
    slim = pages.select(host_of(F.col(url)).alias("host"), F.col(html).cast("string").alias("h"))
    counts = slim.mapInArrow(_counts, "host string, node long, kind int, value long, pages long, prior double")
    counts = tables.written(counts.groupBy("host", "node", "kind", "value").agg(F.sum("pages").alias("pages"), F.sum("prior").alias("prior")), "style-trees")
    nodes = tables.written(importance(counts), "importance")
    at = F.least(F.lit(BINS - 1), F.floor(F.col("importance") * BINS)).cast("int")
    bins = nodes.groupBy("host", at.alias("bin")).agg(F.sum("m").alias("w"), F.sum(F.when(F.col("prior") > 0.9, F.col("m")).otherwise(0)).alias("main"))
    each = lambda of: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.coalesce(F.map_from_arrays("bins", of)[i.cast("int")].cast("double"), F.lit(0.0)))
    hosts = bins.groupBy("host").agg(F.collect_list(F.struct("bin", "w", "main")).alias("all")).select("host", F.col("all.bin").alias("bins"), F.col("all.w").alias("w"), F.col("all.main").alias("main"))
    cuts = hosts.select("host", each("w").alias("weights"), each("main").alias("inside")).mapInArrow(_threshold(gap), "host string, cut double")
    judged = nodes.where(F.col("m") >= enough)
    texts = counts.where("kind = 1").join(judged.select("host", "node", "m"), ["host", "node"]).where((F.col("pages") > 1) & (F.col("pages") >= everywhere * F.col("m")))
    rows = judged.select("host", "node", "importance", F.lit(None).cast("long").alias("text"), "m").unionByName(texts.select("host", "node", F.lit(None).cast("double").alias("importance"), F.col("value").alias("text"), "m"))
    return rows.join(cuts, "host")


class SiteTree:
    """The tree of one host: judged nodes in order, their importance, texts of nearly all pages, and where to cut."""

    def __init__(self, nodes=(), scores=(), texts=(), cut: float | None = None):
        order = np.argsort(np.array(nodes, dtype=np.int64), kind="stable")
        self.nodes, self.scores = np.array(nodes, dtype=np.int64)[order], np.array(scores, dtype=np.float32)[order]
        self.texts, self.cut = frozenset(texts), cut

    def importance(self, node: int) -> float | None:
        at = int(np.searchsorted(self.nodes, node))
        return float(self.scores[at]) if at < len(self.nodes) and self.nodes[at] == node else None


def main_text(page: str | None, tree: SiteTree | None = None) -> str:
    """Text of the page without the branches and texts that its site's tree cuts."""
    tree = tree or SiteTree()
    blocks, _, parents = parse(page)
    prior = priors(blocks)
    held = any(b[2] and not b[1] for b in blocks)
    score = [tree.importance(b[0]) if tree.cut is not None else None for b in blocks]
    if any(s is None for s in score) and tree.cut is not None:
        total, many = Counter(), Counter()
        for b, s in zip(blocks, score, strict=True):
            if s is not None:
                total[b[0]] += s
                many[b[0]] += 1
        for node in reversed(parents):
            total[parents[node]] += total[node]
            many[parents[node]] += many[node]
        branch: dict[int, float | None] = {0: total[0] / many[0] if many[0] else None}
        for node, above in parents.items():
            branch[node] = total[node] / many[node] if many[node] else branch[above]
        # where no branch is judged, the prior is all there is
        score = [s if s is not None else p if branch[b[0]] is None else TRUST * branch[b[0]] + (1 - TRUST) * p for s, p, b in zip(score, prior, blocks, strict=True)]
    out = []
    for (_, noise, main, plain, said), p, s in zip(blocks, prior, score, strict=True):
        if not (main and plain and not noise):
            if s < tree.cut if tree.cut is not None else p < 0.5 and (held or noise):
                continue
            if tree.texts and hash_of(said) in tree.texts:
                continue
        out.append(said)
    return "\n".join(out)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", most_broadcast: int = 500_000, many_pages: int = 20_000) -> DataFrame:
    """One row per row of pages: key, url, text, n_chars."""
    spark = pages.sparkSession
    slim = pages.select(F.col(key).alias("k"), F.col(url).cast("string").alias("u"), F.col(html).cast("string").alias("h"), host_of(F.col(url)).alias("host"))
    with Tables() as tables:
        trees = written(site_trees(pages, tables, url, html), "site-trees")
    entries = trees.count()
    schema = f"k {slim.schema['k'].dataType.simpleString()}, u string, text string, n_chars long"
    row = F.struct(F.collect_list(F.when(F.col("importance").isNotNull(), F.col("node"))).alias("nodes"), F.collect_list("importance").alias("scores"), F.collect_set("text").alias("texts"), F.max("cut").alias("cut"))
    by_host = trees.groupBy("host").agg(row.alias("tree"))

    def texts(part: pa.RecordBatch, found: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string()), pa.array([len(f) for f in found], pa.int64())], names=["k", "u", "text", "n_chars"])

    if entries <= most_broadcast:
        held = spark.sparkContext.broadcast({r["host"]: SiteTree(**r["tree"].asDict()) for r in by_host.collect()})

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts_of(batches):
                yield texts(part, [main_text(h, held.value.get(host)) for h, host in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)])

        return slim.mapInArrow(apply, schema).withColumnsRenamed({"k": key, "u": url})

    total = slim.count()
    many_pages = max(many_pages, -(-total // 100_000))  # so that at most 100,000 hosts are large
    large = F.broadcast(slim.groupBy("host").count().where(F.col("count") > many_pages).select("host", F.ceil(F.col("count") / many_pages).cast("int").alias("n_parts")))
    none, no_tree = [F.lit(None).cast(slim.schema[c].dataType).alias(c) for c in ("k", "u", "h")], F.lit(None).cast(by_host.schema["tree"].dataType).alias("tree")
    of_pages = slim.join(large, "host", "left").select("k", "u", "h", "host", F.pmod(F.xxhash64("u", "h"), F.coalesce("n_parts", F.lit(1))).cast("int").alias("part"), F.lit(1).alias("page"), no_tree)
    of_trees = by_host.join(large, "host", "left").select(*none, "host", F.explode(F.sequence(F.lit(0), F.coalesce("n_parts", F.lit(1)) - 1)).alias("part"), F.lit(0).alias("page"), "tree")
    dealt = of_pages.unionByName(of_trees).repartition(parts(spark, total * 20_000), "host", "part").sortWithinPartitions("host", "part", "page")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, of = SiteTree(), None
        for part in parts_of(batches):
            found, keep = [], []
            for n, (h, host, page) in enumerate(zip(*(part.column(c).to_pylist() for c in ("h", "host", "page")), strict=True)):
                if not page:
                    tree, of = SiteTree(**part.column("tree")[n].as_py()), host
                else:
                    found.append(main_text(h, tree if of == host else None))
                    keep.append(n)
            yield texts(part.take(pa.array(keep, pa.int32())), found)

    return dealt.mapInArrow(merge, schema).withColumnsRenamed({"k": key, "u": url})


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))

"""Main text of web pages by a style tree of each site.

Pages become block trees. A node is named by the tags, classes and ids from the root to it, so the trees of one
host merge into one site tree. Two entropies weigh a node. Presentation: how evenly the pages spread over the
child sequences seen at the node. Content: one less the mean entropy of the text blocks below the node over the
pages that hold the node; a text on all of them counts 0, a text on one page counts 1. Nodes of low weight, found on
``MIN_PAGES`` or more different pages, are template and their branches go. What a page itself says about a
branch is presentation too: elements for navigation, headers, footers, sidebars, notices, adverts, forms, scripts
and reader comments, by tag, role, class or id, go on any page. A class or id is only evidence: a name that tells a
state (``no-sidebar``, ``comments-closed``) or a subject (``copyright-law``) says nothing, an element whose name holds
further words stays if it has more than half of the text, a form too unless it is mostly controls, and no element
goes by its name if the page's only article is inside. Where a page has an article or main element, that
is read, and beside it the blocks whose node the tree of the site weighs ``HIGH`` or more. Inside it branches of low
weight go, with or without a class or id, but headings stay, and so does a frequent paragraph whose node also holds
the paragraphs of the text. Equal pages of a host count once.

Defined cases: a null or empty html gives an empty text; a null url belongs to no site; unclosed, stray and cut
tags are read as a browser would; a page without text gives an empty text; repeated rows give a row each; an
empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from minekit.llm.common import bounded_batches, cut

#: Weight of content against presentation, weight under which a node is template, and pages that a node needs.
CONTENT_WEIGHT, LOW, MIN_PAGES = 0.9, 0.2, 8
#: Weight from which a block beside the article is main text.
HIGH = 0.5
#: Weight that the article as a whole needs before branches inside it may go.
ARTICLE_WEIGHT = 0.5

# Names that the HTML standard and common usage give to elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th "
    "thead tr ul".split()
)
CLOSES_P = BLOCK - {"body", "caption", "head", "html", "tbody", "td", "tfoot", "th", "thead", "tr", "legend"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
NOISE_TAGS = set(
    "head title nav footer aside form script style noscript template button select option input textarea iframe svg canvas object "
    "embed dialog menu search".split()
)
NOISE_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Names of noise elements; the second set says so only beside words of the first and of FILLER_WORDS.
NOISE_WORDS = set(
    "ad ads advert adverts advertisement advertisements advertising adsense banner sponsor sponsored promo promos promotion "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars footer footers masthead cookie cookies gdpr "
    "newsletter subscribe signup login popup modal comment comments disqus toolbar pagination pager".split()
)
VAGUE_WORDS = set(
    "consent notice notices subscription overlay reply replies respond share sharing social related recommended recommendations widget "
    "widgets copyright".split()
)
FILLER_WORDS = set(
    "area articles bar block body bottom box button buttons center col column container content fixed float form group holder icons inner "
    "item items left line links list main more outer page panel post posts primary right row section site small sticky stories text thread "
    "title top unit wrap wrapper you".split()
)
STATE_WORDS = set("allowed closed collapsed disabled enabled has hide is no not off on open show with without".split())
#: Characters of text that a control of a form outweighs.
CONTROL = 40
CONTROLS = set("button input select textarea".split())
ARTICLE_WORDS = set("article post entry content story main".split())
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>])*+)(>|\Z)""", re.S
)
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Paths of the headings of an article.
HEADING = r"/h[1-6]$"
#: Numbers in class names and ids that are too long to name a kind of element.
DIGITS = re.compile(r"\d{3,}")


def attributes(raw: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(raw)} if raw and not raw.isspace() else {}


def says_noise(tag: str, given: dict[str, str], in_article: bool) -> str:
    """Why an element is noise: ``sure`` by what it is, ``name`` by a plain name, ``hint`` by a name with further words, ``form``, or not."""
    if tag == "form":
        return "form"
    if tag in NOISE_TAGS or (tag == "header" and not in_article):
        return "sure"
    if not given or tag in ("html", "body", "article", "main"):
        return ""
    if given.get("role", "").lower() in NOISE_ROLES or "hidden" in given or given.get("aria-hidden") == "true":
        return "sure"
    if "display:none" in given.get("style", "").replace(" ", "").lower():
        return "sure"
    said = ""
    for name in f"{given.get('class', '')} {given.get('id', '')}".split():
        words = {w.lower() for w in WORD.findall(name)}
        if words & STATE_WORDS:
            continue
        further = {w for w in words - NOISE_WORDS - VAGUE_WORDS - FILLER_WORDS if len(w) > 1}
        if words & (NOISE_WORDS | VAGUE_WORDS) and not further:
            return "name"
        if words & NOISE_WORDS or ("header" in words and not words & ARTICLE_WORDS):
            said = "hint"
    return said


def letters(text: str) -> int:
    return len(text) - sum(map(text.count, " \n\t\r"))


class Region:
    """An element that a name or a form makes doubtful, judged when the page is read."""

    __slots__ = ("why", "above", "core", "text", "controls")

    def __init__(self, why: str, above: Region | None) -> None:
        self.why, self.above, self.core, self.text, self.controls = why, above, False, 0, 0


class Element:
    __slots__ = ("tag", "path", "noise", "core", "marked", "children", "block", "region")

    def __init__(self, tag: str, path: str, noise: bool, core: bool, marked: bool, block: bool, region: Region | None = None) -> None:
        self.tag, self.path, self.noise, self.core, self.marked, self.block, self.region = tag, path, noise, core, marked, block, region
        self.children: list[str] = []


class Page:
    """One pass over a page: text blocks (path, in the article, marked, text) and the child sequences of its nodes."""

    def __init__(self, source: str) -> None:
        #: Blocks as (path, in the article, marked, text per region).
        self.found: list[tuple[str, bool, bool, list[tuple[Region | None, str]]]] = []
        self.shapes: list[tuple[Region | None, tuple[str, str]]] = []
        self.regions: list[Region] = []
        self.free_core = False
        self.stack = [Element("", "", False, False, False, True)]
        self.run: list[tuple[Region | None, str]] = []
        at, end = 0, len(source)
        while at < end:
            m = TOKEN.search(source, at)
            if not m:
                self._text(source[at:])
                break
            self._text(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
            elif m[4]:  # a start tag cut off by the end of the page opens nothing
                self._start(tag, m[3])
                if tag in RAW:
                    close = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(source, at)
                    stop = close.start() if close else end
                    self._text(source[at:stop])
                    at = stop
        self._flush()
        while len(self.stack) > 1:
            self._pop()
        gone = self._judged()
        whole = ((path, core, marked, " ".join("".join(t for r, t in parts if r not in gone).split())) for path, core, marked, parts in self.found)
        self.blocks = [b for b in whole if b[3]]
        self.styles = {s for region, s in self.shapes if region not in gone}

    def _judged(self) -> set[Region]:
        """The regions that go; one inside a region that goes, goes with it."""
        gone: set[Region] = set()
        # a plain name is believed whatever the text, so the share counts what is outside of such regions
        for r in self.regions:
            if r.above in gone or (r.why == "name" and not (r.core and not self.free_core)):
                gone.add(r)
        whole = sum(letters(t) for *_, parts in self.found for r, t in parts if r not in gone)
        for r in self.regions:
            if r.above in gone:
                gone.add(r)
            elif r not in gone and r.why != "name":
                stays = (r.core and not self.free_core) or 2 * r.text > whole
                if not stays or (r.why == "form" and r.controls * CONTROL >= r.text):
                    gone.add(r)
        return gone

    def _text(self, text: str) -> None:
        if text and not self.stack[-1].noise:
            self.run.append((self.stack[-1].region, html.unescape(text) if "&" in text else text))

    def _block(self) -> Element:
        return next(e for e in reversed(self.stack) if e.block)

    def _flush(self) -> None:
        if self.run:
            owner = self._block()
            self.found.append((owner.path, owner.core, owner.marked, self.run))
            for region, text in self.run:
                while region:
                    region.text += letters(text)
                    region = region.above
            self.run = []

    def _pop(self) -> None:
        e = self.stack.pop()
        if e.block and not e.noise:
            shape = [c for i, c in enumerate(e.children) if not i or c != e.children[i - 1]]
            self.shapes.append((e.region, (e.path, " ".join(shape))))

    def _close(self, tags: set[str], scope: set[str]) -> None:
        """Close the nearest open element of ``tags``, if no element of ``scope`` stands before it."""
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                self._flush()
                while len(self.stack) > i:
                    self._pop()
                return
            if self.stack[i].tag in scope:
                return

    def _start(self, tag: str, raw: str) -> None:
        if tag in ("html", "body") and any(e.tag == tag for e in self.stack):
            return
        if tag == "body":
            self._close({"head"}, set())
        if tag in CLOSES_P:
            self._close({"p"}, {"td", "th", "li", "blockquote", "div", "section", "article", "button"})
        if tag in CLOSED_BY:
            self._close(CLOSED_BY[tag], SCOPE[tag])
        block = tag in BLOCK
        if block:
            self._flush()
        if tag in VOID:
            if tag in ("br", "hr", "img", "input", "wbr"):
                self.run.append((self.stack[-1].region, " " if tag != "wbr" else ""))
            if tag == "input" and "hidden" not in raw.lower():
                self._control()
            return
        if tag in CONTROLS:
            self._control()
        above, given = self.stack[-1], attributes(raw)
        name = given.get("class", "") or given.get("id", "")
        step = tag
        if name:
            named = f"{tag}.{'.'.join(sorted(given.get('class', '').split()))}#{given.get('id', '')}"
            step = DIGITS.sub("0", named.replace("/", "_"))
        core = above.core or tag in ("article", "main") or given.get("role", "").lower() == "main" or given.get("itemprop") == "articleBody"
        why = "" if above.noise else says_noise(tag, given, above.core)
        noise, region = above.noise or why == "sure", above.region
        if why and not noise:
            region = Region(why, region)
            self.regions.append(region)
        if core and not above.core and not noise:
            self.free_core |= region is None
            holder = region
            while holder:
                holder.core, holder = True, holder.above
        if block:
            above_block = self._block()
            above_block.children.append(step)
            path = f"{above_block.path}/{step}"
        else:
            path = above.path
        self.stack.append(Element(tag, path, noise, core, (above.marked or bool(name)) and above.core, block, region))

    def _control(self) -> None:
        holder = self.stack[-1].region
        while holder:
            holder.controls, holder = holder.controls + 1, holder.above

    def _end(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                if any(e.block for e in self.stack[i:]):
                    self._flush()
                while len(self.stack) > i:
                    self._pop()
                return
            if self.stack[i].tag in ("article", "main", "td", "th", "body") and tag not in ("body", "html", "article", "main", "table", "tr", "td", "th", "div", "section"):
                return


PARSED = "blocks array<struct<path:string,core:boolean,marked:boolean,text:string>>, styles array<struct<path:string,style:string>>"


def parse(sources: pd.Series) -> pd.DataFrame:
    rows = []
    for source in sources:
        page = Page(source)
        rows.append((
            [dict(zip(("path", "core", "marked", "text"), b)) for b in page.blocks],
            [{"path": p, "style": s} for p, s in sorted(page.styles) if p],
        ))
    return pd.DataFrame(rows, columns=["blocks", "styles"])


def ancestors(path):
    """Column of the paths from the root's child down to ``path`` itself."""
    steps = F.split(path, "/")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(steps), F.lit(2))), lambda n: F.array_join(F.slice(steps, 1, n), "/"))


def judged_paths(pages: DataFrame) -> DataFrame:
    """(host, path, low, in_article_too, high): paths whose blocks go, and paths whose blocks stay beside an article."""
    known = pages.filter(F.col("host") != "")
    single = known.select(
        "host", "print",
        F.array_distinct(F.transform("blocks", lambda b: F.struct(b["path"].alias("path"), F.xxhash64(b["text"]).alias("feature"), b["core"].alias("core")))).alias("features"),
        F.col("styles"),
    ).dropDuplicates(["host", "print"])
    features = single.select("host", F.explode("features").alias("f")).select("host", "f.*")
    counted = features.groupBy("host", "path", "core", "feature").agg(F.count(F.lit(1)).alias("n"))
    leaves = counted.groupBy("host", "path", "core").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.log("n")).alias("logs"))
    nodes = leaves.withColumn("node", F.explode(ancestors("path"))).groupBy("host", "node").agg(F.sum("kinds").alias("kinds"), F.sum("logs").alias("logs"))
    own = F.array_distinct(F.flatten(F.transform(F.array_distinct(F.col("features.path")), ancestors)))
    held = single.select("host", F.explode(own).alias("node")).groupBy("host", "node").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") >= MIN_PAGES)
    shapes = single.select("host", F.explode("styles").alias("s")).groupBy("host", F.col("s.path").alias("node"), "s.style").agg(F.count(F.lit(1)).alias("n"))
    totals = shapes.groupBy("host", "node").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.log("n")).alias("n_log_n"), F.count(F.lit(1)).alias("styles"))
    presentation = totals.select(
        "host", "node", F.when(F.col("styles") > 1, (F.log("all") - F.col("n_log_n") / F.col("all")) / F.log("all")).otherwise(F.lit(0.0)).alias("presentation")
    )
    weighed = nodes.join(held, ["host", "node"]).join(presentation, ["host", "node"], "left").select(
        "host", "node",
        ((1 - CONTENT_WEIGHT) * F.coalesce("presentation", F.lit(0.0)) + CONTENT_WEIGHT * (1 - F.col("logs") / F.log("m") / F.col("kinds"))).alias("weight"),
    )
    cores = single.filter(F.exists("features", lambda f: f["core"])).groupBy("host").agg(F.count(F.lit(1)).alias("m"))
    article = leaves.filter("core").groupBy("host").agg(F.sum("kinds").alias("kinds"), F.sum("logs").alias("logs")).join(cores, "host").select(
        "host", (1 - F.coalesce(F.try_divide("logs", F.log("m")), F.lit(0.0)) / F.col("kinds")).alias("article_weight")
    )
    below = leaves.withColumn("node", F.explode(ancestors("path"))).join(weighed, ["host", "node"])
    judged = below.groupBy("host", "path").agg(
        F.bool_or("core").alias("core"), F.bool_or(~F.col("core")).alias("free"), F.bool_or(F.col("weight") < LOW).alias("low"),
        F.coalesce(F.bool_or((F.col("node") == F.col("path")) & (F.col("weight") >= HIGH)), F.lit(False)).alias("high"),
    ).join(article, "host", "left").select(
        "host", "path", "core", "free", "low", (F.col("low") & (F.coalesce("article_weight", F.lit(1.0)) >= ARTICLE_WEIGHT)).alias("in_article_too"),
        (F.col("high") & ~F.col("low") & F.col("free") & F.col("article_weight").isNotNull()).alias("high"),
    )
    # a heading below no class or id stays in any case
    may_go = ~F.col("path").rlike(HEADING) | F.col("path").contains(".")
    return judged.filter((F.col("free") & (F.col("low") | F.col("high"))) | (F.col("core") & F.col("in_article_too") & may_go)).drop("core", "free")


def main_texts(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars."""
    bounded_batches(pages.sparkSession, 500)
    source = F.coalesce(F.col(html_column), F.lit(""))
    rows = pages.select(
        F.col(id_column).alias("id"), F.col(url_column).alias("url"),
        F.lower(F.regexp_extract(F.coalesce(F.col(url_column), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)).alias("host"),
        F.xxhash64(source).alias("print"), source.alias("source"),
    )
    parsed = cut(rows.withColumn("p", pandas_udf(parse, PARSED)("source")).select("id", "url", "host", "print", "p.*"))
    judged = cut(judged_paths(parsed))
    lists = ("outside", "inside", "beside")
    if judged.isEmpty():
        told = parsed.withColumns({c: F.array().cast("array<string>") for c in lists})
    else:
        # only paths that a page has are attached to it
        own = parsed.select("host", "print", F.explode(F.array_distinct(F.col("blocks.path"))).alias("path")).distinct()
        found = own.join(judged, ["host", "path"]).groupBy("host", "print").agg(
            F.collect_set(F.when(F.col("low"), F.col("path"))).alias("outside"),
            F.collect_set(F.when(F.col("in_article_too"), F.col("path"))).alias("inside"),
            F.collect_set(F.when(F.col("high"), F.col("path"))).alias("beside"),
        )
        told = parsed.join(found, ["host", "print"], "left")
        told = told.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in lists})
    told = told.withColumn("has_core", F.exists("blocks", lambda b: b["core"]))
    chosen = F.filter(
        "blocks",
        lambda b: F.when(b["core"], ~((b["marked"] | ~b["path"].rlike(HEADING)) & F.array_contains(F.col("inside"), b["path"])))
        .when(F.col("has_core"), F.array_contains(F.col("beside"), b["path"]))
        .otherwise(~F.array_contains(F.col("outside"), b["path"])),
    )
    text = F.array_join(F.transform(chosen, lambda b: b["text"]), "\n")
    out = told.select(F.col("id").alias(id_column), F.col("url").alias(url_column), text.alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))

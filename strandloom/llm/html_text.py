"""Main text of web pages: the style trees of each site and of all sites decide which branches are noise."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import join_counted, scan, stage

RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
#: A tag (slash, name, attributes), or what holds no text: a comment, a declaration, a raw element whole.
TOKEN = re.compile(
    rf"""<(/?)(?!(?i:{"|".join(sorted(RAW))})[\s/>])([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*)>|<!--.*?(?:-->|\Z)"""
    rf"""|<(?i:({"|".join(sorted(RAW))}))\b[^>]*>.*?(?:</(?i:\4)[^>]*>|\Z)|<[!?/][^>]*>""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img math nobr picture source".split())
#: An opening tag of the left closes an open element of the right, if no element of the limits lies between.
P_ENDS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure details".split())
SAME_ENDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

#: Controls and pictures: their text is never the page's.
CONTROLS = frozenset("form head button select option input dialog menu svg canvas object audio video map".split())
#: Tags and roles that say furniture; a hint that the trees' counts outweigh.
FURNITURE_TAGS = frozenset("nav footer aside".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
# Words of class and id names of page furniture, and words that say nothing beside them.
FURNITURE_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr
    notice sidebar rail widget menu nav navbar navigation topnav breadcrumb breadcrumbs footer masthead topbar header related recommended
    share sharing social subscribe newsletter signup login popup modal overlay toolbar pagination pager skip copyright legal side""".split()
)
#: Of these, words that an article or main element uses for parts of its own.
ARTICLE_WORDS = frozenset("header masthead banner notice skip copyright legal overlay side related recommended menu nav navigation footer toolbar".split())
FILLER_WORDS = frozenset("top bottom left right main site page global box block bar slot wrapper wrap container inner outer list item items area section col row link links button buttons bars x c layer text message".split())
#: Names of readers' comments.  Comments are as rich as an article, so no entropy tells them from it: they go by name.
COMMENT_WORDS = frozenset("comment comments commentlist respond disqus replies".split())
MAIN_TAGS = frozenset(("article", "main"))
#: Elements nested deeper belong to their ancestor at this depth, as in browsers.
DEPTH = 512


@dataclass
class Node:
    tag: str
    key: int
    parent: int
    depth: int
    gone: bool
    hint: bool
    main: bool
    holds_main: bool = False
    low: bool = False
    children: list[str] = field(default_factory=list)


@dataclass
class Page:
    """Blocks in order (node, text), and of every node its parent, depth, whether the page itself
    calls it furniture, and the sequences of children that it was met with."""

    blocks: list[tuple[int, str]]
    nodes: dict[int, tuple[int, int, bool]]
    styles: dict[int, set[str]]


def names_of(attrs: dict[str, str]) -> list[list[str]]:
    """The words of each class name and of the id, in lower case."""
    found = (attrs.get("class", "") + " " + attrs.get("id", "")).split()
    return [re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) for name in found]


def is_furniture(tag: str, attrs: dict[str, str], inside_main: bool) -> bool:
    """Whether tag, role or names hint at furniture.

    A name hints only if it is made of furniture words and fillers alone ("cookie-banner", not
    "has-sidebar" or "share-prices"); inside an article or main element fewer words do.
    """
    if tag in FURNITURE_TAGS or (tag == "header" and not inside_main) or attrs.get("role", "").lower() in FURNITURE_ROLES:
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    hints = FURNITURE_WORDS - ARTICLE_WORDS if inside_main else FURNITURE_WORDS
    return any(any(w in hints for w in words) and all(w in FURNITURE_WORDS or w in FILLER_WORDS for w in words) for words in names_of(attrs))


def is_gone(tag: str, attrs: dict[str, str]) -> bool:
    """Controls, what is hidden, and readers' comments: never text of the page, whatever the trees say."""
    if tag in CONTROLS:
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        return True
    return any(words and words[0] in COMMENT_WORDS for words in names_of(attrs))


KEYS: dict[tuple[int, str], int] = {}


def key_of(parent: int, name: str) -> int:
    """The signed 64-bit name of a path: a hash of the parent's and the element's own name."""
    import xxhash

    found = KEYS.get((parent, name))
    if found is None:
        if len(KEYS) > 200_000:
            KEYS.clear()
        digest = xxhash.xxh64_intdigest(f"{parent}/{name}".encode("utf-8", "surrogatepass"), 3)
        found = KEYS[parent, name] = digest - (1 << 64) if digest >> 63 else digest
    return found


def parse(page: str) -> Page:
    root = Node("", 0, 0, 0, False, False, False)
    stack, made, blocks, styles = [root], [root], [], {}
    held: list[str] = []
    owner: Node | None = None

    def flush() -> None:
        nonlocal owner
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text and owner is not None:
                blocks.append((owner, text))
            held.clear()
        owner = None

    def close() -> None:
        node = stack.pop()
        if not node.gone and node.tag not in INLINE:
            styles.setdefault(node.key, set()).add(" ".join(node.children))

    def put(text: str) -> None:
        nonlocal owner
        if stack[-1].gone:
            return
        if owner is None:
            if not text.strip():
                return
            owner = next(n for n in reversed(stack) if n.tag not in INLINE)
        held.append(text)

    at = 0
    for m in TOKEN.finditer(page):
        start = m.start()
        if start > at:
            put(page[at:start])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if any(n.tag == tag for n in stack[1:]):
                if tag not in INLINE:
                    flush()
                while stack[-1].tag != tag:
                    close()
                close()
            elif tag in ("p", "br"):
                flush()
            continue
        if tag in ("br", "wbr"):
            if tag == "br" and owner is not None:
                held.append("\n")
            continue
        if tag not in INLINE:
            flush()
        if tag in P_ENDS:
            _close_to(stack, "p", ("table", "td", "th", "button", "article", "section", "div"), close)
        if tag in SAME_ENDS:
            for same in {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,)):
                _close_to(stack, same, SAME_ENDS[tag], close)
        attrs = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(m[3])} if m[3] and not m[3].isspace() else {}
        above = stack[-1]
        gone = above.gone or is_gone(tag, attrs)
        if tag in INLINE or gone:
            node = Node(tag, above.key, above.parent, above.depth, gone, above.hint, above.main)
        else:
            name = tag + "".join(sorted("." + re.sub(r"\d{2,}", "0", c) for c in attrs.get("class", "").split())) + ("#" + re.sub(r"\d{2,}", "0", attrs["id"]) if attrs.get("id") else "")
            above.children.append(name)
            starts_main = tag in MAIN_TAGS or attrs.get("role", "").lower() == "main" or attrs.get("itemprop") == "articleBody"
            if starts_main:
                for n in stack:
                    n.holds_main = True
            if above.depth >= DEPTH:
                node = Node(tag, above.key, above.parent, above.depth, False, above.hint, above.main)
            else:
                node = Node(tag, key_of(above.key, name), above.key, above.depth + 1, False, is_furniture(tag, attrs, above.main), above.main or starts_main)
        if tag in VOID or m[3].endswith("/") and tag in ("svg", "path"):
            continue
        stack.append(node)
        if not gone and tag not in INLINE:
            made.append(node)
    rest = page[at:]
    cut_tag = rest.rfind("<")  # a tag that the end of the page cuts off
    put(rest[:cut_tag] if cut_tag >= 0 and re.match(r"<[/!a-zA-Z]", rest[cut_tag:]) else rest)
    flush()
    while len(stack) > 1:
        close()
    # Furniture by the page's own signs: hinted, below such a branch, or outside of the main element.
    low = {0: False}
    for n in made[1:]:
        outside = root.holds_main and not n.main and not n.holds_main
        n.low = (n.hint and not n.holds_main) or low.get(n.parent, False) or outside
        low[n.key] = low.get(n.key, True) and n.low
    return Page([(n.key, t) for n, t in blocks], {n.key: (n.parent, n.depth, low[n.key]) for n in made[1:]}, styles)


def _close_to(stack: list[Node], tag: str, limits: tuple[str, ...], close) -> None:
    """Close the innermost open ``tag``, and what is open inside it, unless a limit stands between."""
    for node in reversed(stack[1:]):
        if node.tag == tag:
            while stack[-1] is not node:
                close()
            close()
            return
        if node.tag in limits:
            return


def main_text(page: str, dropped: frozenset[int] | set[int], held: frozenset[int] | set[int]) -> str:
    """Text of the blocks whose nodes the trees hold, in page order."""
    return text_of(parse(page), dropped, held)


def text_of(found: Page, dropped: frozenset[int] | set[int], held: frozenset[int] | set[int]) -> str:
    """A node that the trees do not know is judged by the page's own signs, and so is a page of which the trees leave nothing."""

    def own(key: int) -> bool:
        return key not in found.nodes or not found.nodes[key][2]

    kept = [t for k, t in found.blocks if k in held or (k not in dropped and own(k))]
    return "\n\n".join(kept or [t for k, t in found.blocks if own(k)])


def skeleton_of(found: Page) -> tuple[list[int], int]:
    """The nodes with text of a page, in order, and their hash."""
    import xxhash

    own = sorted({k for k, _ in found.blocks if k})
    return own, xxhash.xxh64_intdigest(",".join(map(str, own)), 5) - (1 << 63)


def likeness(text: str, host: str) -> str:
    """What a text has in common with those of other pages: without the name of its host, with all numbers alike."""
    return re.sub(r"\d+", "0", text.replace(host, "") if host else text)


KEYS_OF_FEATURES = ["node", "kind", "feature", "parent", "depth"]


def style_features(pages: DataFrame) -> DataFrame:
    """``_host, node, kind, feature, parent, depth, n, low``: what the pages hold, counted; ``pages`` has ``_host, _html``.

    Kinds: 0 a node itself, 1 a text of its own blocks, 2 a sequence of its children; 3 a node with text in
    a skeleton (the set of a page's nodes with text, in ``feature``), 4 a page (its hash in ``node``) and its skeleton.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows = []
            for host, page, digest in zip(*(batch.column(k).to_pylist() for k in range(3))):
                found = parse(page or "")
                texts = {(k, xxhash.xxh64_intdigest(likeness(t, host).encode("utf-8", "surrogatepass"), 1) - (1 << 63)) for k, t in found.blocks if k}
                rows += [(host, k, 1, x, 0, 0, 0) for k, x in texts]
                rows += [(host, k, 2, xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 2) - (1 << 63), 0, 0, 0) for k, many in found.styles.items() if k for s in many]
                rows += [(host, k, 0, 0, parent, depth, int(low)) for k, (parent, depth, low) in found.nodes.items()]
                own, skeleton = skeleton_of(found)
                rows += [(host, k, 3, skeleton, 0, 0, 0) for k in own]
                rows.append((host, digest, 4, skeleton, 0, 0, 0))
            cols = list(zip(*rows)) or [()] * 7
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["_host", "node", "kind", "feature", "parent", "depth", "low"])

    met = scan(pages.select("_host", "_html", page_hash()), run, "_host string, node long, kind int, feature long, parent long, depth int, low long")
    return stage(met.groupBy("_host", *KEYS_OF_FEATURES).agg(F.count(F.lit(1)).alias("n"), F.sum("low").alias("low")), "style-features")


def page_hash() -> Column:
    """Pages of one host and text are one."""
    return F.xxhash64("_host", "_html").alias("_page")


def style_trees(pages: DataFrame, gamma: float = 0.9, features: DataFrame | None = None) -> DataFrame:
    """``_host, node, pages, low, importance`` of the merged pages of each host; the host ``''`` stands for all.

    A node is a path of element names from the root.  Its children sequences are its
    presentation styles and the texts of its own blocks (``likeness``) its content.  With m pages that hold
    the node, content importance is one less the mean over texts of log n / log m (n pages with
    that text), presentation importance the entropy of the styles to the base m (both 1 on a
    single page); a node with l styles has composite importance ``(1 - gamma**l) * presentation
    + gamma**l * mean`` over its children and its content.  ``low`` is the share of its pages
    whose own signs call the node furniture.  Counts are summed by node and text before anything
    meets (``features``), so one host may hold any share of the pages.
    """
    keys = KEYS_OF_FEATURES
    met = (style_features(pages) if features is None else features).filter("kind <= 2")
    every = met.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("low").alias("low")).select(F.lit("").alias("_host"), *keys, "n", "low")
    met = met.filter("_host <> ''").select("_host", *keys, "n", "low").unionByName(every)
    n, kind = F.col("n").cast("double"), F.col("kind")
    nodes = met.groupBy("_host", "node").agg(
        F.max(F.when(kind == 0, n)).alias("m"), F.max("low").alias("low"), F.max("depth").alias("depth"), F.max_by("parent", F.when(kind == 0, n)).alias("parent"),
        F.sum(F.when(kind == 1, F.log(n))).alias("text_log"), F.count(F.when(kind == 1, n)).alias("texts"),
        F.sum(F.when(kind == 2, n * F.log(n))).alias("style_log"), F.sum(F.when(kind == 2, n)).alias("style_n"), F.count(F.when(kind == 2, n)).alias("styles"),
    )
    log_m = F.when(F.col("m") > 1, F.log("m"))
    content = F.when(F.col("texts") > 0, F.coalesce(1 - F.col("text_log") / (F.col("texts") * log_m), F.lit(1.0)))
    look = F.when(F.col("styles") > 0, F.coalesce((F.log("style_n") - F.col("style_log") / F.col("style_n")) / log_m, F.lit(1.0)))
    nodes = stage(
        nodes.select(
            "_host", "node", "parent", "depth", F.col("m").cast("long").alias("pages"), (F.col("low") / F.col("m")).alias("low"), content.alias("content"),
            F.least(F.coalesce(look, F.lit(0.0)), F.lit(1.0)).alias("look"), F.pow(F.lit(gamma), F.greatest(F.col("styles"), F.lit(1))).alias("g"),
        ),
        "style-nodes",
    )
    # Importance is own + down * (sum over the children), a linear recurrence: sums over 1, 2, 4, ... levels in as many rounds.
    many = nodes.groupBy(F.col("_host").alias("_ph"), F.col("parent").alias("_p")).agg(F.count(F.lit(1)).alias("child_n"))
    held = nodes.join(many, (F.col("_host") == F.col("_ph")) & (F.col("node") == F.col("_p")), "left")
    parts = F.col("child_n") + F.when(F.col("content").isNull(), 0).otherwise(1)
    own = F.when(F.col("child_n").isNull(), F.coalesce("content", F.lit(0.0))).otherwise((1 - F.col("g")) * F.col("look") + F.col("g") * F.coalesce("content", F.lit(0.0)) / parts)
    held = held.select("_host", "node", "parent", "depth", "pages", "low", F.col("content").isNotNull().alias("texts"), own.alias("importance"), (F.col("g") / parts).alias("down"))
    held = stage(held, "style-own")
    above = held.select(F.col("_host").alias("_ah"), F.col("node").alias("_a"), F.col("down").alias("weight"))
    held = held.join(above, (F.col("_host") == F.col("_ah")) & (F.col("parent") == F.col("_a")), "left").drop("_ah", "down", "parent")
    levels = 1
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    while levels < deepest:
        held = stage(held, "style-sums")
        sums = held.filter("_a is not null").groupBy(F.col("_host").alias("_sh"), F.col("_a").alias("_s")).agg(F.sum(F.col("weight") * F.col("importance")).alias("sum"))
        up = held.select(F.col("_host").alias("_uh"), F.col("node").alias("_u"), F.col("_a").alias("_ua"), F.col("weight").alias("_uw"))
        held = held.join(sums, (F.col("_host") == F.col("_sh")) & (F.col("node") == F.col("_s")), "left").withColumn("importance", F.col("importance") + F.coalesce("sum", F.lit(0.0)))
        held = held.join(up, (F.col("_host") == F.col("_uh")) & (F.col("_a") == F.col("_u")), "left")
        held = held.select("_host", "node", "pages", "low", "texts", "importance", F.col("_ua").alias("_a"), (F.col("weight") * F.col("_uw")).alias("weight"))
        levels *= 2
    return held.select("_host", "node", "pages", "low", "texts", "importance")


def shrunk(importance: Column, pages: Column, low: Column | None, toward: Column | None, most: int) -> Column:
    """Importance counted as one vote for every page after the first, ``most`` at most, beside two votes
    of the pages' own signs or five of the tree of all sites."""
    votes = F.least(pages - 1, F.lit(most))
    ground, weight = (1 - low, 2) if toward is None else (toward, 5)
    return (votes * importance + weight * ground) / (votes + weight)


def judge_nodes(trees: DataFrame, least: float) -> DataFrame:
    """``_host, node, score, keep`` of every node with text that stands on two pages at least, of its host or of all.

    The tree of all sites backs off to the pages' own signs and a host's tree to that of all
    sites; the lesser of both scores counts, since a small host shows little repetition.
    """
    every = trees.filter("_host = '' and texts").select(F.col("node").alias("_n"), F.col("pages").alias("_all"), shrunk(F.col("importance"), F.col("pages"), F.col("low"), None, 30).alias("_every"))
    hosts = trees.filter("_host <> '' and texts").join(every, F.col("node") == F.col("_n"))
    score = F.least(F.col("_every"), shrunk(F.col("importance"), F.col("pages"), None, F.col("_every"), 30))
    hosts = hosts.filter("_all >= 2").select("_host", "node", score.alias("score"))
    alone = every.filter("_all >= 2").select(F.lit("").alias("_host"), F.col("_n").alias("node"), F.col("_every").alias("score"))
    return hosts.unionByName(alone).withColumn("keep", F.col("score") >= least)


def name_in_host(column: str) -> Column:
    return F.concat("_host", F.lit("\x00"), F.col(column).cast("string"))


def skeleton_judgements(features: DataFrame, judged: DataFrame) -> DataFrame:
    """``_skeleton, n, _dropped, _held``: of every skeleton of a host in how many different pages it is, and which of its nodes the trees drop and hold.

    The nodes of each skeleton meet the judged nodes of its host by node, so no list is longer than a page's
    nodes, whatever a host holds.  Nodes of very many skeletons are dealt out.
    """
    bones = features.filter("kind = 3").select("_host", name_in_host("node").alias("_node"), "node", "feature")
    many = bones.groupBy(F.col("_node").alias("_many")).agg(F.count(F.lit(1)).alias("n"))
    verdicts = judged.select(name_in_host("node").alias("_judged"), "keep").join(many, F.col("_judged") == F.col("_many")).select("_judged", "keep", "n")
    met = join_counted(bones, stage(verdicts, "style-judged"), "_node", "_judged", "n", ["feature"])
    lists = met.groupBy(name_in_host("feature").alias("_listed")).agg(F.collect_list(F.when(~F.col("keep"), F.col("node"))).alias("_dropped"), F.collect_list(F.when(F.col("keep"), F.col("node"))).alias("_held"))
    skeletons = features.filter("kind = 4").groupBy(name_in_host("feature").alias("_skeleton")).agg(F.count(F.lit(1)).alias("n"))
    return stage(skeletons.join(lists, F.col("_skeleton") == F.col("_listed"), "left").drop("_listed"), "style-skeletons")


def page_judgements(features: DataFrame, skeletons: DataFrame) -> DataFrame:
    """``_key, n, _dropped, _held``: of every page (its hash) how often it is there, and what its skeleton drops and holds."""
    pages = features.filter("kind = 4").select(F.col("node").alias("_key"), name_in_host("feature").alias("_bones"), F.col("n").alias("_copies"))
    return stage(join_counted(pages, skeletons, "_bones", "_skeleton", "n", ["_key"]).select("_key", F.col("_copies").alias("n"), "_dropped", "_held"), "style-pages")


def small_judgements(skeletons: DataFrame, most: int) -> dict[str, tuple[list[int], list[int]]] | None:
    """The skeletons with judged nodes, if all of them, counted first, take at most ``most`` bytes."""
    some = skeletons.filter((F.size("_dropped") > 0) | (F.size("_held") > 0))
    size = some.agg(F.sum(F.octet_length("_skeleton") + 8 * (F.size("_dropped") + F.size("_held")))).first()[0] or 0
    return {r["_skeleton"]: (r["_dropped"], r["_held"]) for r in some.collect()} if size <= most else None


def extract_main_text(pages: DataFrame, least: float = 0.75, most: int = 4 << 20, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The article of every page, without menus, notices, adverts, forms, comments and markup.

    The pages of a host are merged into a style tree and those of all hosts into another; a
    block stays if the score of its node, an entropy-based importance (``judge_nodes``), is
    ``least`` or more.  Tags, roles, names and the place outside an article or main element are
    two votes against up to thirty of the counts; alone they judge only nodes that no second page
    holds.  Controls, hidden elements and readers' comments always go.  Character references are
    decoded, white space inside a block becomes one space, and blocks are joined by two line feeds.

    What the trees say of each skeleton, the set of a page's nodes with text, is sent to all tasks if it takes at
    most ``most`` bytes; else pages are joined with it, and their html is shuffled once.  Both give the same rows.

    Returns ``id_col, url_col, text, n_chars``.  A null, empty or blank page has an empty
    text; a page without a host is judged by the tree of all sites.  Repeated rows give
    repeated rows, an empty table none; other columns are ignored.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    source = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"), host.alias("_host"))
    features = style_features(source)
    skeletons = skeleton_judgements(features, judge_nodes(style_trees(source, features=features), least))
    small = small_judgements(skeletons, most)
    if small is None:
        own = page_judgements(features, skeletons)
        rows = join_counted(source.select("_id", "_url", "_html", page_hash()), own, "_page", "_key", "n", ["_id", "_url"]).select("_id", "_url", "_html", "_dropped", "_held")
    else:
        rows = source.select("_id", "_url", "_html", "_host")
        small = pages.sparkSession.sparkContext.broadcast(small)

    def texts(batch: pa.RecordBatch) -> list[str]:
        columns = [batch.column(k).to_pylist() for k in range(2, batch.num_columns)]
        if small is None:
            return [main_text(p or "", frozenset(d or ()), frozenset(h or ())) for p, d, h in zip(*columns)]
        parsed = ((parse(p or ""), host) for p, host in zip(*columns))
        return [text_of(found, *map(frozenset, small.value.get(f"{host}\0{skeleton_of(found)[1]}", ((), ())))) for found, host in parsed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = texts(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], names=["_id", "_url", "text", "n_chars"])

    id_type, url_type = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))
    return scan(rows, run, f"_id {id_type}, _url {url_type}, text string, n_chars long").withColumnsRenamed({"_id": id_col, "_url": url_col})

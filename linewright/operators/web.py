"""Direction of the text blocks, lists and cards of web pages, by the share of right-to-left letters.

A page is cut into tags and texts; start and end tags are matched, which gives each element the interval from its start to its end. What an
element contains, or is contained in, are differences of running sums over the page's order, so there is neither a join nor a walk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Letters counted as right to left and as left to right, and the share from which a block is right to left.
RTL_LETTERS = r"\x{590}-\x{8FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}"
LTR_LETTERS = r"A-Za-z\x{C0}-\x{24F}\x{370}-\x{3FF}\x{400}-\x{4FF}"
SHARE = 0.4
#: Elements that are blocks, elements whose text is code, elements in which nothing is a block, elements without content.
BLOCK_TAGS = ("p", "li", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6")
CODE_TAGS = ("pre", "code")
SKIPPED_TAGS = (*CODE_TAGS, "svg")
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
#: Elements whose start ends an open paragraph.
PARAGRAPH_ENDS = ("address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul")
#: Attributes by which elements are editors, controls, side rows, user messages, quotable parts, cut rows or cards.
EDITOR = r"""\bcontenteditable\s*=\s*["']?true|\bclass\s*=\s*["'][^"']*\bmonaco-editor\b|\bdata-testid\s*=\s*["']worked-for-collapsible["']"""
CONTROL = r"""\brole\s*=\s*["']?button\b"""
SIDE = r"""\bdata-testid\s*=\s*["']conversation-(?:row-sidebar|list-item)["']"""
USER = r"""\bdata-testid\s*=\s*["']user-input-step["']|\baria-label\s*=\s*["']User message["']"""
QUOTABLE = r"""\bdata-quotable\s*=\s*["']?true\b"""
CUT = r"""\bclass\s*=\s*["'](?:[^"']*\s)?truncate[\s"']"""
CARD = r"""\bclass\s*=\s*["'](?:[^"']*\s)?artifact-card[\s"']"""
#: Comments, elements whose content is no markup, tags, texts.
_PIECE = r"(?s)<!--.*?(?:-->|\z)|(?i:<(script|style|textarea)\b[^>]*+>.*?(?:</\1\s*>|\z))|</?[A-Za-z][^>]*+(?:>|\z)|[^<]++|<"


def classify(text: str | Column) -> Column:
    """rtl, ltr, or null without a right-to-left letter (as of a null text)."""
    text = F.coalesce(text, F.lit(""))
    return sided(F.regexp_count(text, F.lit(f"[{RTL_LETTERS}]")), F.regexp_count(text, F.lit(f"[{LTR_LETTERS}]")))


def sided(right: str | Column, left: str | Column) -> Column:
    """The direction of a text with so many letters of either side."""
    right, left = (F.col(x) if isinstance(x, str) else x for x in (right, left))
    return F.when(right == 0, F.lit(None).cast("string")).when(right >= SHARE * (right + left), F.lit("rtl")).otherwise(F.lit("ltr"))


def page_parts(pages: DataFrame) -> DataFrame:
    """Rows (page_id, pos, kind, tag, attributes, text) of pages (page_id, html): kind is start, end, void (a start without content) or text. Comments are left out; scripts, styles and text areas are texts."""
    parts = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(_PIECE), F.lit(0))).alias("pos", "part")).where(~F.col("part").startswith("<!--"))
    raw = F.col("part").rlike(r"(?i)^<(?:script|style|textarea)\b")
    tag = F.lower(F.regexp_extract("part", r"^</?([A-Za-z][A-Za-z0-9-]*)", 1))
    kind = F.when(raw | ~F.col("part").rlike("^</?[A-Za-z]"), F.lit("text")).when(F.col("part").startswith("</"), F.lit("end")).when(F.lower(tag).isin(*VOID_TAGS) | F.col("part").rlike(r"/\s*>\z"), F.lit("void")).otherwise(F.lit("start"))
    rows = parts.select("page_id", "pos", kind.alias("kind"), tag.alias("tag"), "part", raw.alias("raw"))
    shown = F.when(F.col("raw"), F.regexp_replace("part", r"^<[^>]*>|(?i)</(?:script|style|textarea)\s*>\z", "")).otherwise(F.col("part"))
    return rows.select("page_id", "pos", "kind", F.when(F.col("kind") != "text", F.col("tag")).alias("tag"), F.when(F.col("kind") == "start", F.col("part")).alias("attributes"), F.when(F.col("kind") == "text", shown).alias("text"))


def _intervals(parts: DataFrame) -> DataFrame:
    """`parts` without end tags; starts have `stop`, the place where their element ends.

    An end tag ends the last open element of its name, one without such an element nothing. A paragraph ends where a block starts; a list item that has no end
    of its own ends at the next item of its list; other elements without an end end with the element around them, at last with the page.
    """
    page = Window.partitionBy("page_id").orderBy("pos")
    named = Window.partitionBy("page_id", "tag").orderBy("pos")
    step = F.when(F.col("kind") == "start", 1).when(F.col("kind") == "end", -1).otherwise(0)
    rows = parts.withColumn("step", step).withColumn("sum", F.sum("step").over(named)).withColumn("open", F.col("sum") - F.least(F.lit(0), F.min("sum").over(named)))
    rows = rows.withColumn("level", F.when(F.col("kind") == "start", F.col("open")).when(F.col("kind") == "end", F.lag("open", 1, 0).over(named)))
    pair = Window.partitionBy("page_id", "tag", "level", "matched").orderBy("pos")
    rows = rows.withColumn("matched", F.col("level") > 0)
    rows = rows.withColumn("own", F.when(F.lead("kind").over(pair) == "end", F.lead("pos").over(pair)))
    lists = F.when(F.col("tag").isin("ul", "ol"), F.col("step")).otherwise(0)
    rows = rows.withColumn("lists", F.sum(lists).over(page)).withColumn("here", F.when((F.col("kind") == "end") & F.col("tag").isin("ul", "ol"), F.col("lists") + 1).otherwise(F.col("lists")))
    edge = (F.col("tag") == "li") & (F.col("kind") == "start") | F.col("tag").isin("ul", "ol") & (F.col("kind") == "end")
    back = F.desc("pos")  # what comes later is what came before when one walks back
    after = Window.partitionBy("page_id", "here").orderBy(back).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("next_item", F.when(F.col("tag") == "li", F.min(F.when(edge, F.col("pos"))).over(after)))
    later = Window.partitionBy("page_id").orderBy(back).rowsBetween(Window.unboundedPreceding, -1)
    block = F.col("kind").isin("start", "void") & F.col("tag").isin(*PARAGRAPH_ENDS)
    rows = rows.withColumn("next_block", F.when(F.col("tag") == "p", F.min(F.when(block, F.col("pos"))).over(later)))
    stays = F.when((F.col("kind") == "start") & F.col("own").isNotNull(), 1).when((F.col("kind") == "end") & F.col("matched"), -1).otherwise(0)
    rows = rows.withColumn("stays", stays).withColumn("around", F.sum("stays").over(page) + (F.col("stays") < 0).cast("int"))
    closing = F.min(F.when(F.col("stays") < 0, F.col("pos"))).over(Window.partitionBy("page_id", "around").orderBy(back).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("own", F.coalesce("own", F.when(F.col("kind") == "start", closing)))
    last = F.max("pos").over(Window.partitionBy("page_id")) + 1
    own = F.when(F.col("tag") == "p", F.least("own", "next_block")).when(F.col("tag") == "li", F.least("own", "next_item")).otherwise(F.col("own"))
    return rows.where("kind in ('start', 'text')").select("page_id", "pos", "kind", "tag", "attributes", "text", F.when(F.col("kind") == "start", F.coalesce(own, last)).alias("stop"))


_FLAGS = ("code", "skip", "control", "side", "user", "card")


def page_elements(pages: DataFrame) -> DataFrame:
    """Rows (page_id, pos, stop, tag, parent, parent_tag, block, rtl, ltr, first, length, card) of the elements of pages.

    rtl and ltr count the letters of its whole subtree but code, first and length tell where that text is in the page's (`page_prose`). `block`: it takes
    a direction, being a paragraph, item, quote, heading, quotable part of a user's message, span of a card or cut row of a side bar, outside code, editors and controls (rows of side
    bars may be controls). `parent` is the start of the element around it, `card` whether it is a card.
    """
    a = F.coalesce(F.col("attributes"), F.lit(""))
    has = lambda pattern: a.rlike(f"(?is){pattern}")
    rows = _intervals(page_parts(pages))
    marks = {"code": F.col("tag").isin(*CODE_TAGS), "skip": F.col("tag").isin(*SKIPPED_TAGS) | has(EDITOR), "control": (F.col("tag") == "button") | has(CONTROL), "side": has(SIDE), "user": has(USER), "card": has(CARD)}
    rows = rows.withColumns({name: F.coalesce(mark, F.lit(False)).cast("int") for name, mark in marks.items()} | {"quotable": has(QUOTABLE), "cut": has(CUT)})
    whole = F.coalesce(F.col("text"), F.lit(""))
    rows = rows.withColumns({"r": F.regexp_count(whole, F.lit(f"[{RTL_LETTERS}]")), "l": F.regexp_count(whole, F.lit(f"[{LTR_LETTERS}]")), "n": F.length(whole)}).drop("text", "attributes")
    turn = lambda at, sign: F.struct(at.alias("at"), F.lit(sign).alias("sign"))
    events = rows.withColumn("e", F.explode(F.when(F.col("kind") == "start", F.array(turn(F.col("pos"), 1), turn(F.col("stop"), -1))).otherwise(F.array(turn(F.col("pos"), 0))))).select("*", "e.at", "e.sign").drop("e")
    order = Window.partitionBy("page_id").orderBy("at", "sign", F.when(F.col("sign") < 0, -F.col("pos")).otherwise(F.col("pos")))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    events = events.withColumns({f"in_{f}": F.coalesce(F.sum(F.col(f) * F.col("sign")).over(before), F.lit(0)) for f in _FLAGS} | {"depth": F.coalesce(F.sum("sign").over(before), F.lit(0))})
    prose = (F.col("kind") == "text") & (F.col("in_code") == 0)
    events = events.withColumns({f"all_{c}": F.sum(F.when(prose, F.col(c)).otherwise(0)).over(order) for c in ("r", "l", "n")})
    opened = F.col("sign") == 1
    roles = events.where("kind = 'start'").withColumn("o", F.explode(F.when(opened, F.array(F.struct(F.col("depth").alias("d"), F.lit(False).alias("own")), F.struct((F.col("depth") + 1).alias("d"), F.lit(True).alias("own")))).otherwise(F.array(F.struct(F.lit(-1).alias("d"), F.lit(True).alias("own"))))))
    around = Window.partitionBy("page_id", "o.d").orderBy("pos", F.col("o.own").cast("int")).rowsBetween(Window.unboundedPreceding, -1)
    roles = roles.withColumn("up", F.last(F.when(F.col("o.own"), F.struct("pos", "tag")), ignorenulls=True).over(around))
    at_start = lambda c: F.max(F.when(opened & ~F.col("o.own"), F.col(c)))
    counts = {"rtl": "all_r", "ltr": "all_l", "length": "all_n"}
    elements = roles.groupBy("page_id", "pos").agg(F.max("stop").alias("stop"), F.max("tag").alias("tag"), at_start("up.pos").alias("parent"), at_start("up.tag").alias("parent_tag"), F.max("quotable").alias("quotable"), F.max("cut").alias("cut"), *(F.max(f).alias(f) for f in _FLAGS), *(at_start(f"in_{f}").alias(f"in_{f}") for f in _FLAGS), at_start("all_n").alias("first"), *(F.max(F.when(~opened, F.col(c))).alias(f"{name}_end") for name, c in counts.items()), *(at_start(c).alias(f"{name}_start") for name, c in counts.items()))
    inside = lambda f: F.col(f"in_{f}") > 0
    within = lambda f: (F.col(f"in_{f}") + F.col(f)) > 0
    chosen = F.col("tag").isin(*BLOCK_TAGS) | (F.col("quotable") & inside("user")) | ((F.col("tag") == "span") & inside("card")) | (F.col("cut") & inside("side"))
    block = chosen & ~within("skip") & (~within("control") | within("side"))
    return elements.select("page_id", "pos", "stop", "tag", "parent", "parent_tag", block.alias("block"), *((F.col(f"{n}_end") - F.col(f"{n}_start")).alias(n) for n in counts), "first", (F.col("card") > 0).alias("card"))


def page_prose(pages: DataFrame) -> DataFrame:
    """Rows (page_id, prose): the texts of pages outside code, in order."""
    rows = _intervals(page_parts(pages)).withColumn("code", F.coalesce(F.col("tag").isin(*CODE_TAGS), F.lit(False)).cast("int"))
    turn = lambda at, sign: F.struct(at.alias("at"), F.lit(sign).alias("sign"))
    events = rows.where("kind = 'text' or code = 1").withColumn("e", F.explode(F.when(F.col("kind") == "start", F.array(turn(F.col("pos"), 1), turn(F.col("stop"), -1))).otherwise(F.array(turn(F.col("pos"), 0)))))
    inside = F.sum(F.col("code") * F.col("e.sign")).over(Window.partitionBy("page_id").orderBy("e.at", "e.sign"))
    texts = events.withColumn("inside", inside).where("kind = 'text' and inside = 0")
    return texts.groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x.text), "").alias("prose"))


def page_blocks(pages: DataFrame) -> DataFrame:
    """Rows (page_id, block_no, tag, text, dir) of the blocks of pages (page_id, html): the text of the whole subtree but code. A null page has no rows, entities stay as they are."""
    blocks = page_elements(pages).where("block")
    rows = blocks.withColumn("block_no", F.row_number().over(Window.partitionBy("page_id").orderBy("pos")) - 1)
    text = F.coalesce(F.substring("prose", F.col("first") + 1, F.col("length")), F.lit(""))
    return rows.join(page_prose(pages), "page_id", "left").select("page_id", "block_no", "tag", text.alias("text"), sided("rtl", "ltr").alias("dir"))


def page_lists(pages: DataFrame) -> DataFrame:
    """Rows (page_id, list_no, items, rtl_items, dir) of the lists of pages that have items: the running number of its ul or ol start, from 0, and the items that stand right in it. A list is rtl when at least half of its items are, else it has no direction. Items outside lists have no row."""
    each = page_elements(pages).where("tag in ('ul', 'ol', 'li')")
    rows = each.withColumn("list_no", F.count_if(F.col("tag") != "li").over(Window.partitionBy("page_id").orderBy("pos")) - 1)
    own = F.when((F.col("tag") == "li") & F.col("parent_tag").isin("ul", "ol"), F.col("parent")).when(F.col("tag") != "li", F.col("pos"))
    rows = rows.withColumn("list", own).where("list is not null")
    item = (F.col("tag") == "li") & F.col("block")
    found = rows.groupBy("page_id", "list").agg(F.max(F.when(F.col("tag") != "li", F.col("list_no"))).cast("int").alias("list_no"), F.count_if(item).alias("items"), F.count_if(item & (sided("rtl", "ltr") == "rtl")).alias("rtl_items")).where("items > 0").drop("list")
    return found.withColumn("dir", list_side("items", "rtl_items"))


def list_side(items: str, rtl_items: str) -> Column:
    return F.when(2 * F.col(rtl_items) >= F.col(items), F.lit("rtl"))


def page_cards(pages: DataFrame) -> DataFrame:
    """Rows (page_id, card_no, blocks, rtl_blocks, marked) of the cards of pages: a card is marked if any block in it, however deep, is right to left. Blocks of a card inside a card count for both."""
    rows = page_elements(pages).where("block or card").withColumn("rtl_block", F.col("block") & F.coalesce(sided("rtl", "ltr") == "rtl", F.lit(False)))
    turn = lambda at, sign: F.struct(at.alias("at"), F.lit(sign).alias("sign"))
    events = rows.withColumn("e", F.explode(F.when(F.col("card"), F.array(turn(F.col("pos"), 1), turn(F.col("stop"), -1))).otherwise(F.array(turn(F.col("pos"), 1)))))
    order = Window.partitionBy("page_id").orderBy("e.at", "e.sign", F.when(F.col("e.sign") < 0, -F.col("pos")).otherwise(F.col("pos")))
    started = F.col("e.sign") == 1
    events = events.withColumns({"n": F.count_if(started & F.col("block")).over(order), "m": F.count_if(started & F.col("rtl_block")).over(order)}).where("card")
    at = lambda c, sign: F.max(F.when(F.col("e.sign") == sign, F.col(c)))
    cards = events.groupBy("page_id", "pos").agg((at("n", -1) - at("n", 1)).alias("blocks"), (at("m", -1) - at("m", 1)).alias("rtl_blocks"))
    return cards.select("page_id", (F.row_number().over(Window.partitionBy("page_id").orderBy("pos")) - 1).alias("card_no"), "blocks", "rtl_blocks", (F.col("rtl_blocks") > 0).alias("marked"))
